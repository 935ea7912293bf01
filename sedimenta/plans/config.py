"""Configuration: a JSON file with dotted paths, environment, and how both and flags are merged."""

from __future__ import annotations

import json
import os
import tempfile
from urllib.parse import urlsplit, urlunsplit

from sedimenta.errors import UserError
from sedimenta.plans.embed_plan import DEFAULT_MODELS

#: Paths that can be set; which of them are keys and which URLs.
VENDORS = ("openai", "google", "voyage", "cohere")
KEYS = frozenset(f"apiKeys.{v}" for v in (*VENDORS, "pinecone", "qdrant"))
URLS = frozenset(("dbs.pgvector.url", "dbs.qdrant.url", "dbs.chroma.url"))
PATHS = ("defaults.provider", "defaults.db", "defaults.model", "defaults.collection", *(f"models.{v}" for v in (*VENDORS, "local")), *sorted(KEYS), "dbs.pgvector.url", "dbs.pinecone.indexName", "dbs.qdrant.url", "dbs.chroma.url")


def mask_key(key: str | None) -> str:
    return "(unset)" if not key else "***" if len(key) <= 8 else f"{key[:4]}…{key[-4:]}"


def mask_url(url: str | None) -> str:
    """A URL without its password and most of its user name; what isn't a URL is masked like a key."""
    if not url:
        return "(unset)"
    parts = urlsplit(url)
    if not parts.scheme or not parts.netloc:
        return mask_key(url)
    user, host = parts.username or "", parts.netloc.rpartition("@")[2]
    user = user[:2] + "…" if len(user) > 4 else user
    login = user + (":***" if parts.password else "")
    return urlunsplit(parts._replace(netloc=f"{login}@{host}" if login else host))


class Config:
    def __init__(self, path: str):
        self.path, self.values = path, {}
        if os.path.exists(path):
            try:
                with open(path, encoding="utf-8") as f:
                    self.values = json.load(f)
                if not isinstance(self.values, dict):
                    raise ValueError("not an object")
            except ValueError as e:
                raise UserError(f"invalid configuration {path}: {e}") from None

    def get(self, path: str):
        at = self.values
        for part in path.split("."):
            at = at.get(part) if isinstance(at, dict) else None
        return at

    def set(self, path: str, value: str) -> None:
        if path not in PATHS:
            raise UserError(f"{path} can't be set; known: {', '.join(PATHS)}")
        at = self.values
        *parents, last = path.split(".")
        for part in parents:
            at = at.setdefault(part, {})
        at[last] = value

    def save(self) -> None:
        """Written beside the file, readable by the owner only, and moved over it."""
        os.makedirs(os.path.dirname(os.path.abspath(self.path)), exist_ok=True)
        handle, fresh = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(self.path)))
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(self.values, f, indent=2)
        os.chmod(fresh, 0o600)
        os.replace(fresh, self.path)

    def shown(self) -> dict[str, str]:
        """All set paths, keys and URLs masked."""
        out = {}
        for p in PATHS:
            v = self.get(p)
            if v is not None:
                out[p] = mask_key(v) if p in KEYS else mask_url(v) if p in URLS else str(v)
        return out


def resolve(flags: dict, env: dict, config: Config) -> dict:
    """Provider, model, database and collection: flag, then environment, then configuration, then default."""
    pick = lambda flag, name, path, default=None: flags.get(flag) or env.get(name) or config.get(path) or default
    provider = pick("provider", "SEDIMENTA_PROVIDER", "defaults.provider", "hash")
    model = flags.get("model") or env.get("SEDIMENTA_MODEL") or config.get("defaults.model") or config.get(f"models.{provider}") or DEFAULT_MODELS.get(provider, "hash-64")
    key = env.get(f"{provider.upper()}_API_KEY") or config.get(f"apiKeys.{provider}")
    return {"provider": provider, "model": model, "db": pick("db", "SEDIMENTA_DB", "defaults.db", "parquet"), "collection": pick("collection", "SEDIMENTA_COLLECTION", "defaults.collection"), "key": key}
