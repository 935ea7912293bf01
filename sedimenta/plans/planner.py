"""Plans proposed by a language model over HTTPS: how vendors are asked, and which one is chosen."""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from sedimenta.errors import ProviderError, UserError
from sedimenta.plans.embed_plan import EmbedPlan, model_plan
from sedimenta.sources.blocks import open_file

#: Models asked by default, bytes of a file that are shown, most tokens of an answer.
MODELS = {"anthropic": "claude-haiku-4-5-20251001", "openai": "gpt-4o-mini", "google": "gemini-2.0-flash"}
SHOWN, MOST_TOKENS = 4096, 1024
VERSION = "2023-06-01"


@dataclass(frozen=True)
class Vendor:
    """How a prompt is sent, and where the answer stands in what comes back."""

    url: str
    headers: dict[str, str]
    body: dict
    read: Callable[[dict], str]


def vendor(name: str, key: str, model: str, prompt: str, base: str | None = None) -> Vendor:
    """The request for a prompt; ``base`` replaces the vendor's address."""
    said = [{"role": "user", "content": prompt}]
    if name == "anthropic":
        body = {"model": model, "max_tokens": MOST_TOKENS, "messages": said}
        read = lambda a: "".join(part.get("text", "") for part in a["content"])
        return Vendor(f"{base or 'https://api.anthropic.com'}/v1/messages", {"x-api-key": key, "anthropic-version": VERSION}, body, read)
    if name == "openai":
        body = {"model": model, "messages": said, "response_format": {"type": "json_object"}}
        return Vendor(f"{base or 'https://api.openai.com'}/v1/chat/completions", {"Authorization": f"Bearer {key}"}, body, lambda a: a["choices"][0]["message"]["content"])
    if name == "google":
        body = {"contents": [{"parts": [{"text": prompt}]}], "generationConfig": {"responseMimeType": "application/json"}}
        at = f"{base or 'https://generativelanguage.googleapis.com'}/v1beta/models/{urllib.parse.quote(model, safe='')}:generateContent"
        return Vendor(at, {"x-goog-api-key": key}, body, lambda a: "".join(part.get("text", "") for part in a["candidates"][0]["content"]["parts"]))
    raise UserError(f"no planner named {name}; known: {', '.join(MODELS)}")


def asker(name: str, key: str, model: str | None = None, base: str | None = None, timeout: float = 60.0) -> Callable[[str], str]:
    """A function from prompt to answer."""

    def ask(prompt: str) -> str:
        v = vendor(name, key, model or MODELS.get(name, ""), prompt, base)
        call = urllib.request.Request(v.url, json.dumps(v.body).encode(), {"Content-Type": "application/json", **v.headers}, method="POST")
        try:
            with urllib.request.urlopen(call, timeout=timeout) as answer:
                return v.read(json.loads(answer.read()))
        except urllib.error.HTTPError as e:
            raise ProviderError(f"{name} answered {e.code}", e.code == 429 or e.code >= 500, e.code) from None
        except (urllib.error.URLError, TimeoutError) as e:
            raise ProviderError(f"{name}: {type(e).__name__}", True) from None
        except (ValueError, KeyError, IndexError, TypeError):
            raise ProviderError(f"{name}: the answer isn't of the known form") from None

    return ask


def choose(env: dict, config, name: str | None = None) -> tuple[str, str]:
    """Vendor and key: the one named outright or in the environment, else the first whose key is set, else one of the configuration."""
    name = name or env.get("SEDIMENTA_PLANNER")
    stored = lambda v: config.get(f"apiKeys.{v}") if v != "anthropic" else None
    if name:
        if name not in MODELS:
            raise UserError(f"no planner named {name}; known: {', '.join(MODELS)}")
        key = env.get(f"{name.upper()}_API_KEY") or stored(name)
        if not key:
            raise UserError(f"planner {name} needs a key: set {name.upper()}_API_KEY")
        return name, key
    for v in MODELS:
        if key := env.get(f"{v.upper()}_API_KEY"):
            return v, key
    for v in MODELS:
        if key := stored(v):
            return v, key
    raise UserError("no planner has a key: set " + ", ".join(f"{v.upper()}_API_KEY" for v in MODELS))


def head_of(path: str) -> str:
    """The first bytes of a file, as text."""
    with open_file(path) as f:
        return f.read(SHOWN).decode("utf-8", "ignore")


def proposed_plan(path: str, embedding_model: str, ask: Callable[[str], str], metadata: dict | None = None) -> EmbedPlan:
    """The plan that a model proposes for a file; given metadata win over proposed ones."""
    plan = model_plan(head_of(path), path, embedding_model, ask)
    return EmbedPlan(plan.splitter, plan.chunk_size, plan.overlap, plan.collection, plan.embedding_model, {**plan.metadata, **(metadata or {})})
