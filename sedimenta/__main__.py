"""Command line: plan, chunks, embed, eval, config, providers, init, check."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys

from sedimenta.errors import SedimentaError, UserError

CONFIG = os.path.join(os.path.expanduser("~"), ".sedimenta", "config.json")
DATABASES = ("parquet", "chroma", "pgvector", "pinecone", "qdrant")
log = logging.getLogger("sedimenta")


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sedimenta")
    p.add_argument("--verbose", action="store_true", help="tell what is done")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("plan", "chunks", "embed"):
        c = sub.add_parser(name)
        c.add_argument("files", nargs="+")
        for flag, kind in (("--splitter", str), ("--chunk-size", int), ("--overlap", int), ("--collection", str), ("--metadata", str), ("--model", str), ("--provider", str), ("--plan", str), ("--tokens", str)):
            c.add_argument(flag, type=kind)
        c.add_argument("--planner", help="let a language model propose the plan (anthropic, openai, google or auto)")
        c.add_argument("--out", default="chunks.txt" if name == "chunks" else None)
        c.add_argument("--store", default="vectors")
        c.add_argument("--db", choices=DATABASES)
        c.add_argument("--force", action="store_true")
        if name == "chunks":
            c.add_argument("--show", type=int, default=0, help="print so many chunks")
        if name == "embed":
            c.add_argument("--dry-run", action="store_true", help="plan and cost, nothing is embedded or stored")
            c.add_argument("--checkpoint", type=int, help="chunks that are stored before they are recorded")
    c = sub.add_parser("eval")
    for name in ("manifest", "corpus", "queries"):
        c.add_argument(name)
    c.add_argument("--out", default="evaluation")
    c.add_argument("--tokens", default="byte_bpe_50k")
    c = sub.add_parser("config")
    c.add_argument("action", choices=("set", "get", "list", "path"))
    c.add_argument("path", nargs="?")
    c.add_argument("value", nargs="?")
    sub.add_parser("providers")
    c = sub.add_parser("init")
    for flag in ("--provider", "--model", "--db", "--collection", "--key", "--url"):
        c.add_argument(flag)
    c = sub.add_parser("check")
    c.add_argument("--provider")
    c.add_argument("--db", choices=DATABASES)
    return p


def _plan(args, path: str, runtime: dict, settings):
    from sedimenta.plans.embed_plan import heuristic_plan, load_plan, merge_plan, parse_metadata

    meta = parse_metadata(args.metadata) if args.metadata else None
    given = {"splitter": args.splitter, "chunk_size": args.chunk_size, "overlap": args.overlap, "collection": args.collection or runtime["collection"], "metadata": meta}
    if args.plan:
        with open(args.plan, encoding="utf-8") as f:
            return merge_plan(load_plan(f.read()), **given, embedding_model=args.model)
    if args.planner:
        from sedimenta.plans import planner

        name, key = planner.choose(dict(os.environ), settings, None if args.planner == "auto" else args.planner)
        proposed = planner.proposed_plan(path, runtime["model"], planner.asker(name, key, base=os.environ.get(f"{name.upper()}_BASE_URL")), meta)
        return merge_plan(proposed, **given)
    return heuristic_plan(path, runtime["model"], **given)


def _config(args, settings) -> None:
    if args.action == "set":
        settings.set(args.path or "", args.value or "")
        settings.save()
    elif args.action == "get":
        print(settings.shown().get(args.path, "(unset)"))
    elif args.action == "list":
        print("\n".join(f"{k} = {v}" for k, v in settings.shown().items()))
    else:
        print(CONFIG)


def _init(args, settings) -> None:
    """Store defaults, a provider's key and a database's address, without asking."""
    provider = args.provider or settings.get("defaults.provider") or "hash"
    for path, value in (("defaults.provider", args.provider), ("defaults.model", args.model), ("defaults.db", args.db), ("defaults.collection", args.collection), (f"apiKeys.{provider}", args.key), (f"dbs.{args.db}.url", args.url)):
        if value:
            settings.set(path, value)
    settings.save()
    print(f"stored {CONFIG}")


def missing(env: dict, settings, provider: str, db: str) -> list[str]:
    """What a run with this provider and database still lacks."""
    out = []
    if provider != "hash" and not (env.get(f"{provider.upper()}_API_KEY") or settings.get(f"apiKeys.{provider}")):
        out.append(f"provider {provider}: set {provider.upper()}_API_KEY")
    if db == "pinecone" and not (env.get("PINECONE_API_KEY") or settings.get("apiKeys.pinecone")):
        out.append("database pinecone: set PINECONE_API_KEY")
    if db == "pgvector" and not (env.get("DATABASE_URL") or settings.get("dbs.pgvector.url")):
        out.append("database pgvector: set DATABASE_URL")
    return out


def _evaluate(args) -> int:
    from sedimenta.operators import retrieval
    from sedimenta.session import local_session
    from sedimenta.sources.files import expand_inputs, parse_files, read_files

    result = retrieval.evaluate_files(local_session(), args.manifest, args.queries, expand_inputs([args.corpus]), args.corpus, parse_files, read_files, args.tokens)
    retrieval.write_result(result, args.out)
    print(json.dumps(result["experiments"], indent=2))
    return 0 if result["ok"] else 1


def _work(args, settings) -> int:
    from sedimenta.plans import config as conf

    runtime = conf.resolve({"provider": args.provider, "model": args.model, "collection": args.collection, "db": args.db}, dict(os.environ), settings)
    from sedimenta.operators import export
    from sedimenta.sources.files import expand_inputs

    paths = expand_inputs(args.files)
    if args.command == "plan":
        shown = [_plan(args, p, runtime, settings).to_json() for p in paths]
        if args.out:
            export.check_target(args.out, paths)
            with open(args.out + ".tmp", "w", encoding="utf-8") as f:
                f.write("\n".join(shown) + "\n")
            os.replace(args.out + ".tmp", args.out)
        else:
            print("\n".join(shown))
        return 0
    from pyspark.sql import functions as F

    from sedimenta.operators import pipeline, sinks
    from sedimenta.operators.embedding import provider
    from sedimenta.operators.file_chunks import file_chunks
    from sedimenta.session import local_session
    from sedimenta.sources.blocks import file_hashes

    if args.out:
        export.check_target(args.out, paths)
    if args.command == "embed" and args.dry_run and (args.out or args.force or args.checkpoint):
        raise UserError("a dry run stores nothing: it takes neither --out nor --force nor --checkpoint")
    if args.command == "embed" and not args.dry_run and (lacking := missing(dict(os.environ), settings, runtime["provider"], runtime["db"])):
        raise UserError("; ".join(lacking))
    spark = local_session()
    tokens = args.tokens or "byte_bpe_50k"
    groups: dict = {}
    for p in paths:
        plan = _plan(args, p, runtime, settings)
        groups.setdefault(plan.to_json(), (plan, []))[1].append(p)
    for plan, own in groups.values():
        log.info("%s: %d files, %s", plan.collection, len(own), plan.to_json())
        if args.command == "chunks" or args.dry_run:
            chunks = file_chunks(spark, own, plan, tokens)
            if args.command == "chunks":
                print(export.write_report(chunks, plan, args.out))
                if args.show:
                    export.preview(chunks, args.show)
            else:
                print(plan.to_json())
                export.preview(chunks, 20)
            export.cost_summary(chunks, plan.embedding_model).show()
            continue
        store = sinks.collections(spark, runtime["db"], dict(os.environ), settings, os.path.abspath(args.store))
        chunked = lambda changed, plan=plan: file_chunks(spark, [r["source_path"] for r in changed.collect()], plan, tokens)
        tell = lambda done, todo: print(f"{done}/{todo}", file=sys.stderr)
        done = pipeline.run(spark, chunked, file_hashes(spark, own), plan, provider(runtime["provider"], runtime["key"]), store, os.path.join(os.path.abspath(args.store), "_ledger"), args.force, tokens=tokens, checkpoint=args.checkpoint or pipeline.CHECKPOINT, tell=tell)
        print(f"{plan.collection}: {done}")
        if args.out:
            if runtime["db"] != "parquet":
                raise UserError("vectors are exported from parquet collections")
            get = lambda k: F.get_json_object("metadata", f"$.{k}")
            rows = store.read(plan.collection).select(get("sourcePath").alias("source_path"), get("chunkIndex").cast("int").alias("chunk_index"), "chunk_id", F.col("content").alias("text"), F.col("metadata").alias("meta_json"), F.lit(plan.embedding_model).alias("model"), F.size("vector").alias("dim"), "vector")
            export.export_vectors(rows, os.path.abspath(args.out), inputs=paths)
    return 0


def main(argv: list[str]) -> int:
    args = _parser().parse_args(argv)
    # the engine is only loaded once there is something to do
    from sedimenta.plans import config as conf
    from sedimenta.plans.embed_plan import DEFAULT_MODELS

    logging.basicConfig(format="%(message)s")
    log.setLevel(logging.INFO if args.verbose else logging.WARNING)
    try:
        settings = conf.Config(CONFIG)
        if args.command == "config":
            _config(args, settings)
        elif args.command == "init":
            _init(args, settings)
        elif args.command == "providers":
            for name, model in {**DEFAULT_MODELS, "hash": "hash-64"}.items():
                ready = name == "hash" or bool(os.environ.get(f"{name.upper()}_API_KEY") or settings.get(f"apiKeys.{name}"))
                print(f"{name:8} {'ready' if ready else 'no key':7} {model}")
        elif args.command == "check":
            runtime = conf.resolve({"provider": args.provider, "db": args.db}, dict(os.environ), settings)
            lacking = missing(dict(os.environ), settings, runtime["provider"], runtime["db"])
            print("\n".join(lacking) or "ready")
            return 1 if lacking else 0
        elif args.command == "eval":
            return _evaluate(args)
        else:
            return _work(args, settings)
        return 0
    except SedimentaError as e:
        print(f"error: {e}", file=sys.stderr)
        return e.exit_code
    except KeyboardInterrupt:
        print("interrupted; what is stored is kept, the next run goes on from there", file=sys.stderr)
        return 130
    except Exception as e:
        # errors of tasks come wrapped by the engine
        known = next((c for c in (SedimentaError, *_classes()) if f"{c.__name__}: " in str(e)), None)
        if known is None or args.verbose:
            raise
        print("error: " + str(e).rpartition(f"{known.__name__}: ")[2].split("\n")[0], file=sys.stderr)
        return known.exit_code


def _classes() -> list[type]:
    from sedimenta import errors

    return [c for c in vars(errors).values() if isinstance(c, type) and issubclass(c, SedimentaError)]


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
