"""The registered queries of the subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm import boilerplate, budget, encode, lookalike, markup, mixing, neighbours
from sedimenta.sources.tables import spread_table, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.similar_pairs(spread_table(spark, folder, "chunk_vectors", "vec_id", "model", "dim", "vector", "embedded_at"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return markup.markup_found(spread_table(spark, folder, "sections", "section_id", "source_path", "text"), spread_table(spark, folder, "markdown_units", "unit_id", "kind", "text"))


def p2_clean(spark: SparkSession, folder: str) -> DataFrame:
    sections = markup.clean_sections(spread_table(spark, folder, "sections", "section_id", "source_path", "text")).withColumn("rec_table", F.lit("sections"))
    units = markup.clean_units(spread_table(spark, folder, "markdown_units", "unit_id", "kind", "text")).withColumn("rec_table", F.lit("markdown_units"))
    return sections.unionByName(units).select("rec_table", "rec_id", "clean")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return boilerplate.body_codes(spread_table(spark, folder, "html_candidates", "page_id", "html"))


def p5_bodies(spark: SparkSession, folder: str) -> DataFrame:
    return boilerplate.main_bodies(spread_table(spark, folder, "html_candidates", "page_id", "html")).select("page_id", "body")


def p6_token_budget(spark: SparkSession, folder: str) -> DataFrame:
    return budget.token_budget(spread_table(spark, folder, "documents", "doc_id", "text", "source", "lang", "doc_domain", "source_path"))


def p6_against_estimates(spark: SparkSession, folder: str) -> DataFrame:
    return budget.budget_against_estimates(spread_table(spark, folder, "documents", "doc_id", "text", "source", "lang", "doc_domain", "source_path"), table(spark, folder, "cost_estimates"))


def p6_given_budget(spark: SparkSession, folder: str) -> DataFrame:
    """p6_token_budget over given sizes, the bytes of each text."""
    docs = table(spark, folder, "documents")
    return budget.token_budget(docs, sizes=docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("tokens")))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode.encode_documents(spread_table(spark, folder, "documents", "doc_id", "text"))


def _mixture(spark: SparkSession, folder: str, **how) -> DataFrame:
    return mixing.mix_sources(spread_table(spark, folder, "documents", "doc_id", "text", "source", "lang", "doc_domain", "source_path"), table(spark, folder, "mix_targets"), **how)


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """As many tokens as the sources with a target hold; the exponent is bisected to the limits of repetition."""
    return _mixture(spark, folder, epochs=1.0)


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.reached_shares(p9_mixture(spark, folder), table(spark, folder, "mix_targets"))


def p9_even_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The exponent is bisected to an entropy, here that of eight even sources; the budget gives way to the limits of repetition."""
    return mixing.reached_shares(_mixture(spark, folder, epochs=1.0, wanted_entropy=math.log(8)), table(spark, folder, "mix_targets"))


def p9_exact_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Without a budget the shares are exactly the targets, and the scarcest source sizes the mixture."""
    return mixing.reached_shares(_mixture(spark, folder), table(spark, folder, "mix_targets"))


def p9_given_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """p9_mixture over given sizes, the characters of each document."""
    docs = table(spark, folder, "documents").select("doc_id", "source", F.col("n_chars").alias("tokens"))
    return mixing.mix_sources(docs, table(spark, folder, "mix_targets"), epochs=1.0, sizes=docs.filter("tokens > 0"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.lookalike_pairs(spread_table(spark, folder, "documents", "doc_id", "text"))


def p10_classes(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.lookalike_classes(spread_table(spark, folder, "documents", "doc_id", "text"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p2_found, p2_clean, p5_found, p5_bodies, p6_token_budget, p6_against_estimates, p6_given_budget, p8_ids, p9_mixture, p9_shares, p9_even_shares, p9_exact_shares, p9_given_mixture, p10_found, p10_classes)}



def _p10_forms() -> str:
    """The form in which texts that look the same are equal, in SQL, from a table of its own (not that of the operator)."""
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    span = lambda *ends: "".join(chr(c) for a, b in ends for c in range(a, b + 1))
    # Letters and the Latin ones they look like; blanks; hyphens; what doesn't show; ligatures and Roman numerals
    alike = (
        "аaɑaсcϲcԁdеeɡgһhіiјjϳjӏlоoοoօoрpԛqѕsνvѵvԝwхxуyүy" "АAΑAВBΒBСCϹCЕEΕEϜFԌGНHΗHІIΙIӀIЈJͿJКKΚKМMΜMϺMΝNОOΟOՕOРPΡPԚQЅSТTΤTѴVԜWХXΧXУYҮYΥYΖZᏃZ" "ӓäӒÄёëЁËїïЇÏӧöӦÖӱÿӰŸѐèЀÈӑăӐĂӗĕӖĔόóΌÓΪÏΫŸ"
    )
    blanks = span((0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
    hyphens = span((0x2010, 0x2011), (0x58A, 0x58A), (0xFE63, 0xFE63), (0xFF0D, 0xFF0D))
    unseen = span((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x180B, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF))
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F) if c != 0xFF0D)
    several = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "Ⅷ": "VIII", "Ⅶ": "VII", "Ⅲ": "III", "Ⅻ": "XII", "Ⅱ": "II", "Ⅳ": "IV", "Ⅵ": "VI", "Ⅸ": "IX", "Ⅺ": "XI", "ⅷ": "viii", "ⅶ": "vii", "ⅲ": "iii", "ⅻ": "xii", "ⅱ": "ii", "ⅳ": "iv", "ⅵ": "vi", "ⅸ": "ix", "ⅺ": "xi"}
    single = dict(zip("ⅠⅤⅩⅬⅭⅮⅯⅰⅴⅹⅼⅽⅾⅿ", "IVXLCDMivxlcdm"))
    source = alike[::2] + blanks + hyphens + wide + "".join(single) + unseen
    target = alike[1::2] + " " * len(blanks) + "-" * len(hyphens) + "".join(chr(ord(c) - 0xFEE0) for c in wide) + "".join(single.values())
    form = "nfc_normalize(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)))"
    for k, v in several.items():
        form = f"replace({form}, {quote(k)}, {quote(v)})"
    return f"nfc_normalize(translate({form}, {quote(source)}, {quote(target)}))"


def _p10_sql() -> str:
    return f"""
        WITH f AS (SELECT doc_id, text, {_p10_forms()} AS form FROM documents WHERE text IS NOT NULL)
        SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM f a JOIN f b ON a.form = b.form AND a.text <> b.text AND a.doc_id < b.doc_id
        WHERE regexp_matches(a.form, '[^\\s\\p{{Z}}\\p{{Cc}}\\p{{Cf}}]')"""


def _p10_classes_sql() -> str:
    return f"""
        WITH f AS (SELECT doc_id, text, {_p10_forms()} AS form FROM documents WHERE text IS NOT NULL),
        v AS (SELECT * FROM f WHERE regexp_matches(form, '[^\\s\\p{{Z}}\\p{{Cc}}\\p{{Cf}}]')),
        g AS (SELECT form, count(DISTINCT text) AS n_texts, min(doc_id) AS look_id FROM v GROUP BY form HAVING count(DISTINCT text) > 1)
        SELECT doc_id, look_id, min(doc_id) OVER (PARTITION BY form, text) AS exact_id, n_texts FROM v JOIN g USING (form)"""


SQL: dict[str, str] = {
    # exact: a collection of one cell, as the smaller tables are, is compared as a whole
    "p1_found": """
        WITH u AS (SELECT DISTINCT ON (vec_id) vec_id, model, CAST(vector AS DOUBLE[]) AS v FROM chunk_vectors
                   WHERE model IS NOT NULL AND len(vector) = dim AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
        c AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.v, b.v) AS s FROM u a JOIN u b ON a.model = b.model AND a.vec_id <> b.vec_id),
        r AS (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS rank FROM c)
        SELECT DISTINCT least(a, b) AS vec_id_a, greatest(a, b) AS vec_id_b FROM r WHERE rank <= 10 AND s >= 0.85""",
    "p6_given_budget": """
        SELECT coalesce(nullif(regexp_replace(lower(trim(source)), '[\\s_-]+', '-', 'g'), ''), 'unknown') AS source,
            coalesce(nullif(regexp_replace(regexp_replace(lower(trim(lang)), '[\\s_-]+', '-', 'g'), '-.*$', ''), ''), 'unknown') AS lang,
            coalesce(nullif(regexp_replace(lower(trim(doc_domain)), '[\\s_-]+', '-', 'g'), ''), 'unknown') AS doc_domain,
            count(*) AS n_docs, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS n_chars, CAST(sum(coalesce(strlen(text), 0)) AS BIGINT) AS n_tokens
        FROM documents GROUP BY 1, 2, 3""",
    "p10_found": _p10_sql(),
    "p10_classes": _p10_classes_sql(),
    # weights target^(1-t) * natural^t, t bisected to the limits; documents in the order of their digest until half of one is over
    "p9_given_mixture": """
        WITH RECURSIVE d AS (SELECT doc_id, coalesce(nullif(regexp_replace(lower(trim(source)), '[\\s_-]+', '-', 'g'), ''), 'unknown') AS source, n_chars AS tokens FROM documents WHERE n_chars > 0),
        t AS (SELECT coalesce(nullif(regexp_replace(lower(trim(source)), '[\\s_-]+', '-', 'g'), ''), 'unknown') AS source, sum(target_share) AS share, min(max_repeats) AS repeats FROM mix_targets GROUP BY 1),
        s AS (SELECT source, sum(tokens)::DOUBLE AS n, any_value(share) AS share, any_value(repeats) AS repeats FROM d JOIN t USING (source) WHERE share > 0 AND repeats > 0 GROUP BY source),
        p AS (SELECT source, n, repeats, share / sum(share) OVER () AS target, n / sum(n) OVER () AS held, sum(n) OVER () AS budget FROM s),
        b(i, low, high) AS (
            SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
            UNION ALL
            SELECT i + 1, CASE WHEN bool_and(fits) THEN any_value(low) ELSE any_value((low + high) / 2) END, CASE WHEN bool_and(fits) THEN any_value((low + high) / 2) ELSE any_value(high) END
            FROM (SELECT i, low, high, w / sum(w) OVER () * budget <= n * repeats * (1 + 1e-12) AS fits
                  FROM (SELECT b.*, p.*, pow(held, (low + high) / 2) * pow(target, 1 - (low + high) / 2) AS w FROM b, p WHERE i < 60))
            GROUP BY i),
        w AS (SELECT source, n, repeats, raw / sum(raw) OVER () * budget AS wanted FROM (SELECT p.*, pow(held, high) * pow(target, 1 - high) AS raw FROM p, b WHERE i = 60)),
        k AS (SELECT source, least(floor(wanted / n), repeats) AS passes, CASE WHEN floor(wanted / n) < repeats THEN wanted - floor(wanted / n) * n ELSE 0 END AS rest FROM w),
        o AS (SELECT doc_id, source, tokens, passes, rest, CAST('0x' || substr(md5('7/' || source || '/' || doc_id), 1, 15) AS BIGINT) AS place FROM d JOIN k USING (source)),
        c AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY place % 4096, place, doc_id ROWS UNBOUNDED PRECEDING) - tokens / 2 AS spent FROM o)
        SELECT doc_id, source, tokens, CAST(passes + CASE WHEN spent <= rest THEN 1 ELSE 0 END AS INTEGER) AS uses FROM c WHERE passes + CASE WHEN spent <= rest THEN 1 ELSE 0 END > 0""",
}
