"""Named capabilities and settings: what a deployment can plug in, found by name and loaded when first asked for."""

from __future__ import annotations

import importlib
import inspect
from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import SparkSession

#: The kinds of providers.
CAPABILITIES = ("sampler", "scenes", "ocr", "asr", "vision", "events", "embedding", "vectors", "llm", "storage", "source")


@dataclass
class Registry:
    """Providers by capability and name: a factory, or "module:attribute" that is imported on first use."""

    made: dict[tuple[str, str], Callable | str] = field(default_factory=dict)
    aliases: dict[tuple[str, str], str] = field(default_factory=dict)
    broken: dict[tuple[str, str], str] = field(default_factory=dict)

    def register(self, capability: str, name: str, factory: Callable | str, *also: str) -> None:
        if capability not in CAPABILITIES:
            raise KeyError(f"unknown capability {capability!r}")
        self.made[capability, name] = factory
        for a in also:
            self.aliases[capability, a] = name

    def provider(self, capability: str, name: str):
        """A decorator that registers a factory."""
        return lambda f: (self.register(capability, name, f), f)[1]

    def names(self, capability: str) -> list[str]:
        return sorted(n for c, n in self.made if c == capability)

    def build(self, capability: str, name: str, settings: dict | None = None):
        """The provider, given the settings its factory accepts; one that fails to load is noted and reported."""
        key = (capability, self.aliases.get((capability, name), name))
        if key not in self.made:
            raise KeyError(f"no {capability} named {name!r}; known: {', '.join(self.names(capability))}")
        factory = self.made[key]
        if isinstance(factory, str):
            module, _, attribute = factory.partition(":")
            try:
                factory = self.made[key] = getattr(importlib.import_module(module), attribute)
            except (ImportError, AttributeError) as e:
                self.broken[key] = str(e)
                raise
        accepted = inspect.signature(factory).parameters
        open_ended = any(p.kind is p.VAR_KEYWORD for p in accepted.values())
        return factory(**{k: v for k, v in (settings or {}).items() if open_ended or k in accepted})


    def first(self, capability: str, names: list[str], settings: dict | None = None):
        """(name, provider) of the first of the names that there is and that loads; an error tells why each of them did not."""
        why = []
        for name in names:
            try:
                return name, self.build(capability, name, settings)
            except (ImportError, AttributeError, KeyError) as e:
                why.append(f"{name}: {e}")
        raise LookupError(f"no {capability} of {', '.join(names) or 'none'} could be had ({'; '.join(why)})")


@dataclass(frozen=True)
class Settings:
    """All settings with their defaults; unknown names are errors."""

    top_k: int = 10
    lexical_weight: float = 1.0
    vector_weight: float = 1.0
    cooccurrence_boost: float = 0.25
    merge_gap: float = 2.0
    min_silence: float = 2.0
    chain_gap: float = 120.0
    chapter_seconds: float = 300.0
    max_segment: float = 45.0
    min_segment: float = 4.0
    min_scene: float = 1.5
    max_frames: int = 2000

    @classmethod
    def load(cls, spark: SparkSession | None = None, **overrides) -> Settings:
        """Defaults, then the session's chronofact.* entries, then overrides; values take the defaults' types."""
        known = {f.name: f for f in fields(cls)}
        values = {}
        if spark is not None:
            for name in known:
                v = spark.conf.get(f"chronofact.{name}", None)
                if v is not None:
                    values[name] = v
        values.update(overrides)
        if bad := set(values) - set(known):
            raise KeyError(f"unknown settings: {', '.join(sorted(bad))}")
        return replace(cls(), **{k: type(getattr(cls, k))(v) for k, v in values.items()})


#: The registry that the library's own null providers are in.
default = Registry()


@default.provider("llm", "null")
def null_llm():
    """Answers nothing: answers stay extractive."""
    return lambda prompt, system=None: None


@default.provider("vision", "null")
def null_vision():
    return lambda frames: []


@default.provider("asr", "null")
def null_asr():
    return lambda audio: []


@default.provider("ocr", "null")
def null_ocr():
    return lambda frames: []
