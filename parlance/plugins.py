"""User-defined extractors and sinks, and the routing of requests to providers with fallback."""

from __future__ import annotations

import importlib
import json
import os
import re
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from email.utils import parsedate_to_datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Extractor:
    """A named function from a prompt to a reply; it runs in Arrow batches, prompt by prompt, and a failure costs its prompt only."""

    id: str
    version: str
    types: tuple[str, ...]
    reply: Callable[[str], str]
    initialize: Callable[[], None] | None = None
    teardown: Callable[[], None] | None = None

    def run(self, prompts: DataFrame, use: Callable[[DataFrame], object]) -> object:
        """``use`` of the replies, between the extractor's start and its end; it has to be done with them when it returns."""
        if self.initialize:
            self.initialize()
        try:
            return use(self.replies(prompts))
        finally:
            if self.teardown:
                self.teardown()

    def replies(self, prompts: DataFrame) -> DataFrame:
        """session_id, reply and error of each (session_id, prompt)."""
        call = self.reply

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out: list[tuple[str | None, str | None]] = []
                for p in b.column(1).to_pylist():
                    try:
                        out.append((call(p), None))
                    except Exception as e:
                        out.append((None, f"{type(e).__name__}: {e}"))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r for r, _ in out], pa.string()), pa.array([e for _, e in out], pa.string())], names=["session_id", "reply", "error"])

        return prompts.select("session_id", "prompt").mapInArrow(rows, "session_id string, reply string, error string")


class Registry:
    def __init__(self) -> None:
        self.known: dict[str, Extractor] = {}

    def add(self, e: Extractor) -> None:
        if e.id in self.known:
            raise ValueError(f"extractor {e.id} is registered already")
        self.known[e.id] = e

    def load(self, path: str, config: dict | None = None) -> Extractor:
        """``package.module:factory``, called with the configuration."""
        module, _, name = path.partition(":")
        e = getattr(importlib.import_module(module), name or "factory")(config or {})
        self.add(e)
        return e

    def chosen(self, ids: list[str] | None = None) -> list[Extractor]:
        """All, or those named; unknown names choose nothing."""
        return [e for e in self.known.values() if ids is None or e.id in ids]


class ProviderError(Exception):
    """kind: auth, format, rate_limit, timeout or other."""

    def __init__(self, kind: str, message: str = "", retry_after_s: float | None = None):
        super().__init__(message or kind)
        self.kind, self.retry_after_s = kind, retry_after_s


def retry_after_s(header: str | None, now: float | None = None) -> float | None:
    """Seconds of a Retry-After header: a number, or a date (never below 0)."""
    if not header:
        return None
    try:
        return float(header)
    except ValueError:
        pass
    try:
        return max(0.0, parsedate_to_datetime(header).timestamp() - (time.time() if now is None else now))
    except ValueError:
        return None


def error_of_status(status: int, retry_after: str | None = None, provider: str = "", body: str = "") -> ProviderError:
    kind = {401: "auth", 403: "auth", 429: "rate_limit", 408: "timeout", 504: "timeout"}.get(status, "other")
    said = f"request failed provider={provider} status={status}" + (f" body={body[:500]}" if body else "")
    return ProviderError(kind, said, retry_after_s(retry_after) if kind == "rate_limit" else None)


#: The model of each provider by budget.
MODELS = {
    "openai": {"cheap": "gpt-4o-mini", "standard": "gpt-4o", "premium": "gpt-4o"},
    "deepseek": {"cheap": "deepseek-chat", "standard": "deepseek-chat", "premium": "deepseek-reasoner"},
    "anthropic": {"cheap": "claude-3-5-haiku-latest", "standard": "claude-3-5-sonnet-latest", "premium": "claude-3-opus-latest"},
    "ollama": {"cheap": "llama3.2:3b", "standard": "llama3.1:8b", "premium": "llama3.1:70b"},
}
#: Base address, whether a key is needed, whether JSON mode is known (chat completions).
CHAT = {"openai": ("https://api.openai.com", True, True), "deepseek": ("https://api.deepseek.com", True, True), "ollama": ("http://127.0.0.1:11434", False, False)}


def text_of_content(content: object) -> str:
    """A reply's content: a string, or its text parts run together."""
    if isinstance(content, str):
        return content
    if not isinstance(content, list):
        raise ProviderError("format", "expected a string or a list of text parts")
    return "".join(p if isinstance(p, str) else p.get("text", "") if isinstance(p, dict) and p.get("type") == "text" and isinstance(p.get("text"), str) else "" for p in content)


def request(provider: str, messages: list[dict], model: str, config: dict | None = None, temperature: float | None = None, max_tokens: int | None = None, as_json: bool = False) -> dict:
    """url, headers and body of a completion."""
    config = config or {}
    key = config.get("api_key")
    if provider != "anthropic":
        base, needed, json_mode = CHAT[provider]
        if needed and not key:
            raise ProviderError("auth", f"no key for provider={provider}")
        body: dict = {"model": model, "messages": messages}
        body |= {k: v for k, v in (("temperature", temperature), ("max_tokens", max_tokens)) if v is not None}
        if as_json and json_mode:
            body["response_format"] = {"type": "json_object"}
        headers = {"content-type": "application/json"} | ({"authorization": f"Bearer {key}"} if key else {})
        return {"url": config.get("base_url", base).rstrip("/") + "/v1/chat/completions", "headers": headers, "body": body}
    if not key:
        raise ProviderError("auth", f"no key for provider={provider}")
    system = [m["content"] for m in messages if m["role"] == "system"] + (["Return only valid JSON."] if as_json else [])
    body = {"model": model, "max_tokens": max_tokens or 4096, "messages": [m for m in messages if m["role"] != "system"]}
    if temperature is not None:
        body["temperature"] = temperature
    if system:
        body["system"] = "\n\n".join(system)
    return {"url": config.get("base_url", "https://api.anthropic.com").rstrip("/") + "/v1/messages", "headers": {"content-type": "application/json", "x-api-key": key, "anthropic-version": "2023-06-01"}, "body": body}


def reply_of(provider: str, response: dict) -> dict:
    """content and tokens of a provider's parsed response."""
    usage = response.get("usage") or {}
    if provider == "anthropic":
        if not response.get("content"):
            raise ProviderError("format", f"no content from provider={provider}")
        return {"content": text_of_content(response["content"]), "tokens": {"input": usage.get("input_tokens", 0), "output": usage.get("output_tokens", 0)}}
    message = ((response.get("choices") or [{}])[0] or {}).get("message") or {}
    if "content" not in message:
        raise ProviderError("format", f"no message from provider={provider}")
    return {"content": text_of_content(message["content"]), "tokens": {"input": usage.get("prompt_tokens", 0), "output": usage.get("completion_tokens", 0)}}


def completer(provider: str, config: dict, send: Callable[[dict], tuple[int, dict, dict]], budget: str = "cheap") -> Callable[[str], str]:
    """A prompt-to-reply function over ``send`` (a request to status, headers and parsed body); a timeout of ``send`` counts as one."""
    model = config.get("model") or MODELS.get(provider, MODELS["openai"])[budget]

    def call(prompt: str) -> str:
        try:
            status, headers, body = send(request(provider, [{"role": "user", "content": prompt}], model, config))
        except TimeoutError as e:
            raise ProviderError("timeout", f"provider={provider}: {e}") from e
        if status >= 400:
            raise error_of_status(status, headers.get("retry-after"), provider, str(body))
        return reply_of(provider, body)["content"]

    return call


def routes(config: dict | None, budget: str) -> list[tuple[str, str]]:
    """(provider, model) in the order of the configuration; without providers the first of MODELS. The task and its size don't count."""
    entries = (config or {}).get("providers") or {"openai": {}}
    return [(name, (own or {}).get("model") or MODELS.get(name, MODELS["openai"])[budget]) for name, own in entries.items()]


def preferred(config: dict, provider_and_model: str | None) -> dict:
    """The configuration with one provider moved to the front, its model set; ``provider/model``."""
    if not provider_and_model:
        return config
    provider, _, model = provider_and_model.partition("/")
    if not provider or not model:
        raise ValueError(f"expected provider/model, got {provider_and_model}")
    old = (config.get("llm") or {}).get("providers") or {}
    first = {provider: {**(old.get(provider) or {}), "model": model}}
    return {**config, "llm": {**(config.get("llm") or {}), "providers": first | {k: v for k, v in old.items() if k != provider}}}


@dataclass
class Router:
    """Providers in order: the first that answers counts. Errors of credentials or format end it; others pass to the next.

    One failure is raised as it is, several together; an error that is no provider's ends it at once, with those before.
    """

    providers: list[tuple[str, Callable[[str], str]]]
    tried: list[str] = field(default_factory=list)

    def __call__(self, prompt: str) -> str:
        failed: list[Exception] = []
        for name, call in self.providers:
            self.tried.append(name)
            try:
                return call(prompt)
            except ProviderError as e:
                if e.kind in ("auth", "format"):
                    raise
                failed.append(e)
            except Exception as e:
                if not failed:
                    raise
                raise ExceptionGroup("every provider failed", [*failed, e]) from e
        if len(failed) == 1:
            raise failed[0]
        raise ExceptionGroup("every provider failed", failed) if failed else ValueError("no providers")


def evidence(session_id: str, message_id: str, excerpt: str) -> dict:
    """A piece of evidence as extractors give it."""
    return {"session_id": session_id, "message_id": message_id, "excerpt": excerpt}


def define(id: str, version: str, types: tuple[str, ...], reply: Callable[[str], str], **hooks) -> Callable[[dict], Extractor]:
    """A factory, as ``Registry.load`` calls it."""
    if not id or not types:
        raise ValueError("an extractor needs an id and types")
    return lambda config: Extractor(id, version, types, reply, **hooks)


@dataclass
class SessionProvider:
    """A named way to pull payloads for a table of session ids."""

    id: str
    pull: Callable[[DataFrame], DataFrame]


@dataclass
class Sink:
    """Takes the results of the types it supports."""

    name: str
    types: tuple[str, ...]
    deliver: Callable[[DataFrame], None]


def file_sink(name: str, folder: str, types: tuple[str, ...]) -> Sink:
    """JSON lines of the results, and the markdown of those that have it, by repository."""
    def deliver(rows: DataFrame) -> None:
        if not folder:
            raise ValueError("the file sink needs a folder")
        rows.write.mode("append").partitionBy("repo").json(f"{folder}/results")
        ended = F.when(F.col("markdown").endswith("\n"), F.col("markdown")).otherwise(F.concat("markdown", F.lit("\n")))
        rows.filter(F.col("markdown").isNotNull()).select("repo", ended.alias("value")).write.mode("append").partitionBy("repo").text(f"{folder}/markdown")

    return Sink(name, types, deliver)


def one_file_each(results: DataFrame, folder: str) -> DataFrame:
    """``<folder>/<repo>/pending/<id>.json``, and ``.md`` where there is markdown, for each result, on a folder that all
    machines mount; id and error of each (null: delivered). Files are written beside and moved, so none is half there."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            errors = []
            for r in b.to_pylist():
                try:
                    own = os.path.join(folder, re.sub("[^a-zA-Z0-9._-]", "_", r.get("repo") or "_global"), "pending")
                    os.makedirs(own, exist_ok=True)
                    text = r.pop("markdown", None)
                    put(os.path.join(own, f"{r['id']}.json"), json.dumps(r, indent=2, ensure_ascii=False, default=str) + "\n")
                    if text is not None:
                        put(os.path.join(own, f"{r['id']}.md"), text if text.endswith("\n") else text + "\n")
                    errors.append(None)
                except Exception as e:
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(errors, pa.string())], names=["id", "error"])

    return results.mapInArrow(rows, "id string, error string")


def put(path: str, text: str) -> None:
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(path + ".tmp", path)


class Buffer:
    """Captures that could not be sent, as files of a folder: the newest ``keep`` stay, and they are sent again oldest first."""

    def __init__(self, folder: str, keep: int = 50):
        self.folder, self.keep = folder, keep
        os.makedirs(folder, exist_ok=True)

    def files(self) -> list[str]:
        paths = [os.path.join(self.folder, n) for n in os.listdir(self.folder) if n.endswith(".json")]
        return sorted(paths, key=lambda p: (os.stat(p).st_mtime_ns, p))

    def save(self, capture: dict) -> str:
        path = os.path.join(self.folder, f"{time.time_ns()}-{uuid.uuid4().hex[:8]}.json")
        put(path, json.dumps(capture))
        for old in self.files()[: -self.keep]:
            os.remove(old)
        return path

    def flush(self, send: Callable[[dict], bool]) -> int:
        """Sends until one fails; files that cannot be read go. The number sent."""
        sent = 0
        for path in self.files():
            try:
                with open(path, encoding="utf-8") as f:
                    capture = json.load(f)
            except ValueError:
                os.remove(path)
                continue
            if not send(capture):
                break
            os.remove(path)
            sent += 1
        return sent


def run_sinks(results: DataFrame, sinks: list[Sink]) -> list[dict]:
    """Each sink gets its results; a failing sink counts all of its rows as failed, the others go on."""
    report = []
    for s in sinks:
        own = results.filter(F.col("type").isin(*s.types))
        n = own.count()
        try:
            if n:
                s.deliver(own)
            report.append({"sink": s.name, "delivered": n, "failed": 0, "error": None})
        except Exception as e:
            report.append({"sink": s.name, "delivered": 0, "failed": n, "error": str(e)[:200]})
    return report
