"""Configuration: where it comes from, defaults of the trigger rules, lists of providers."""

from __future__ import annotations

import importlib.util
import json
import os
from dataclasses import dataclass, field

from parlance.functions import patterns as P

#: Files that are looked for, the first that can be read counts: a Python module with a dict ``config``, or JSON.
FILES = ("parlance_config.py", "parlance.json")
DEFAULTS = {"distillers": ["pitfall-card"], "sinks": ["file"], "llm": {"providers": {"openai": {}}}}


def load(folder: str = ".", files: tuple[str, ...] = FILES) -> dict:
    """The first file that gives a dict, else the defaults; one that fails is passed over."""
    for name in files:
        path = os.path.join(folder, name)
        try:
            if name.endswith(".json"):
                with open(path, encoding="utf-8") as f:
                    found = json.load(f)
            else:
                spec = importlib.util.spec_from_file_location("parlance_config", path)
                module = importlib.util.module_from_spec(spec)
                spec.loader.exec_module(module)
                found = module.config
        except Exception:
            continue
        if isinstance(found, dict):
            return found
    return {**DEFAULTS, "dump_dir": os.environ.get("PARLANCE_DUMP_DIR")}


def provider_list(raw: str | None, default: tuple[str, ...] = ("toolhost",)) -> list[str]:
    """Names parted by commas, each once, in order."""
    return list(dict.fromkeys(x for x in map(str.strip, (raw or "").split(",")) if x)) or list(default)


@dataclass(frozen=True)
class Triggers:
    """Every field has a default of its own."""

    enabled: bool = True
    processing_mode: str = "full"
    window_ms: int = 300_000
    threshold: int = 3
    severity_keywords: tuple[str, ...] = field(default=P.SEVERITY)
    semantic_keywords: tuple[str, ...] = field(default=P.SEMANTIC)
    manual_triggers: tuple[str, ...] = field(default=P.MANUAL)
    max_size: int = 8
    max_wait_ms: int = 1_500
    max_pending: int = 50
    distill: bool = True

    @classmethod
    def merged(cls, given: dict | None) -> Triggers:
        """Of a nested configuration; what is not said is the default, and the switches are on unless they are false."""
        given = given or {}
        limits, often = given.get("thresholds") or {}, (given.get("thresholds") or {}).get("frequency") or {}
        batch, rate = given.get("batch") or {}, given.get("rate_limit") or {}
        said = {"processing_mode": given.get("processing_mode"), "window_ms": often.get("window_ms"), "threshold": often.get("threshold"), "max_size": batch.get("max_size"), "max_wait_ms": batch.get("max_wait_ms"), "max_pending": rate.get("max_pending")}
        said |= {k: tuple(limits[k]) for k in ("severity_keywords", "semantic_keywords", "manual_triggers") if limits.get(k) is not None}
        return cls(enabled=given.get("enabled") is not False, distill=(given.get("distill") or {}).get("enabled") is not False, **{k: v for k, v in said.items() if v is not None})
