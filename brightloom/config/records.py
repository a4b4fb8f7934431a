"""Configurations as checked, immutable records: kinds are tables of fields and rules, and read and write canonical JSON."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from types import MappingProxyType
from typing import Any, NamedTuple

from brightloom.core.canonical import canonical_dumps, canonical_loads
from brightloom.core.errors import ConfigError

VERSION = 1
SEED_MAX = 2**32 - 1


class Field(NamedTuple):
    """A field's type (int, float, str, counts or floats), default, bounds and choices."""

    kind: str
    default: Any
    low: float | None = None
    high: float | None = None
    choices: tuple[str, ...] | None = None


Rule = tuple[str, Callable[[Mapping[str, Any]], bool]]


def _bounded(name: str, value: Any, low: float | None, high: float | None) -> Any:
    if (low is not None and value < low) or (high is not None and value > high):
        raise ConfigError(f"{name} must be within [{low}, {high}]: {value!r}")
    return value


def require_int(name: str, value: Any, *, minimum: int | None = None, maximum: int | None = None) -> int:
    if type(value) is not int:
        raise ConfigError(f"{name} must be a whole number: {value!r}")
    return _bounded(name, value, minimum, maximum)


def require_float(name: str, value: Any, *, minimum: float | None = None, maximum: float | None = None) -> float:
    if type(value) not in (int, float) or not math.isfinite(value):
        raise ConfigError(f"{name} must be a finite number: {value!r}")
    return _bounded(name, float(value), minimum, maximum)


def require_str(name: str, value: Any, *, allowed: tuple[str, ...] | None = None) -> str:
    if not isinstance(value, str) or (allowed is not None and value not in allowed):
        raise ConfigError(f"{name} must be a string{f' of {sorted(allowed)}' if allowed else ''}: {value!r}")
    return value


def _checked(name: str, value: Any, f: Field) -> Any:
    if f.kind == "int":
        return require_int(name, value, minimum=f.low, maximum=f.high)
    if f.kind == "float":
        return require_float(name, value, minimum=f.low, maximum=f.high)
    if f.kind == "str":
        return require_str(name, value, allowed=f.choices)
    if f.kind == "counts":
        if not isinstance(value, Mapping) or set(value) - set(f.choices or ()):
            raise ConfigError(f"{name} must map names of {f.choices} to counts: {value!r}")
        return MappingProxyType({k: require_int(f"{name}[{k}]", v, minimum=f.low) for k, v in value.items()})
    if not isinstance(value, (list, tuple)) or not value:
        raise ConfigError(f"{name} must be a list of numbers, not empty: {value!r}")
    return tuple(require_float(f"{name}[{i}]", v, minimum=f.low, maximum=f.high) for i, v in enumerate(value))


_KINDS: dict[str, tuple[dict[str, Field], tuple[Rule, ...]]] = {}


def register_config(kind: str, fields: dict[str, Field], rules: tuple[Rule, ...] = ()) -> None:
    if not kind or kind in _KINDS:
        raise ConfigError(f"no kind, or one that is there already: {kind!r}")
    _KINDS[kind] = (fields, rules)


def registered_kinds() -> list[str]:
    return sorted(_KINDS)


class Config(Mapping):
    """A record of a kind; fields are items and attributes."""

    def __init__(self, kind: str, **values: Any):
        if kind not in _KINDS:
            raise ConfigError(f"unknown kind {kind!r}; there are {registered_kinds()}")
        fields, rules = _KINDS[kind]
        if unknown := set(values) - set(fields):
            raise ConfigError(f"{kind}: unknown fields {sorted(unknown)}")
        held = {n: _checked(f"{kind}.{n}", values.get(n, f.default), f) for n, f in fields.items()}
        for text, holds in rules:
            if not holds(held):
                raise ConfigError(f"{kind}: {text}")
        object.__setattr__(self, "kind", kind)
        object.__setattr__(self, "_held", MappingProxyType(held))

    def __getitem__(self, name: str) -> Any:
        return self._held[name]

    def __iter__(self):
        return iter(self._held)

    def __len__(self) -> int:
        return len(self._held)

    def __getattr__(self, name: str) -> Any:
        try:
            return self.__dict__["_held"][name]
        except KeyError:
            raise AttributeError(name) from None

    def __setattr__(self, name: str, value: Any) -> None:
        raise ConfigError("a configuration does not change")

    def samples(self, name: str) -> int:
        """A field in milliseconds as samples at the record's rate."""
        return self["sample_rate"] * self[name] // 1000


def config_to_dict(config: Config) -> dict[str, Any]:
    plain = lambda v: dict(v) if isinstance(v, Mapping) else list(v) if isinstance(v, tuple) else v
    return {"kind": config.kind, "schema_version": VERSION} | {n: plain(v) for n, v in config.items()}


def config_to_json(config: Config) -> str:
    return canonical_dumps(config_to_dict(config))


def config_from_dict(data: Any) -> Config:
    """A record from just its fields, its kind and its version."""
    if not isinstance(data, dict) or not isinstance(data.get("kind"), str) or data["kind"] not in _KINDS:
        raise ConfigError(f"not a configuration of a kind of {registered_kinds()}")
    if type(data.get("schema_version")) is not int or data["schema_version"] != VERSION:
        raise ConfigError("unknown version")
    values = {k: v for k, v in data.items() if k not in ("kind", "schema_version")}
    if missing := set(_KINDS[data["kind"]][0]) - set(values):
        raise ConfigError(f"missing fields {sorted(missing)}")
    return Config(data["kind"], **values)


def config_from_json(text: str | bytes) -> Config:
    return config_from_dict(canonical_loads(text))


# The kinds, with defaults and bounds.
register_config(
    "feature",
    {
        "sample_rate": Field("int", 16000, 1000, 192000),
        "frame_ms": Field("int", 25, 1),
        "hop_ms": Field("int", 10, 1),
        "n_fft": Field("int", 512, 2),
        "n_mels": Field("int", 64, 1, 512),
        "fmin": Field("float", 20.0, 0.0),
        "fmax": Field("float", 7600.0, 0.0),
        "window": Field("str", "hann", choices=("hann", "hamming", "blackman")),
    },
    (
        ("hop_ms must not exceed frame_ms", lambda c: c["hop_ms"] <= c["frame_ms"]),
        ("n_fft must be a power of two", lambda c: c["n_fft"].bit_count() == 1),
        ("n_fft must cover a frame", lambda c: c["n_fft"] >= c["sample_rate"] * c["frame_ms"] // 1000),
        ("fmin must be below fmax, fmax no higher than half the rate", lambda c: c["fmin"] < c["fmax"] <= c["sample_rate"] / 2),
    ),
)
register_config(
    "generation",
    {
        "domain": Field("str", "weather"),
        "seed": Field("int", 20260926, 0, SEED_MAX),
        "counts": Field("counts", {"train": 64, "dev": 16, "test": 16}, 0, choices=("train", "dev", "test")),
        "n_speakers": Field("int", 4, 1, 64),
        "noise_snr_db": Field("floats", (30.0, 15.0), 0.0, 100.0),
    },
    (("domain must not be empty", lambda c: bool(c["domain"])), ("counts must ask for one utterance at least", lambda c: sum(c["counts"].values()) > 0)),
)
register_config(
    "stream",
    {
        "sample_rate": Field("int", 16000, 1000, 192000),
        "chunk_ms": Field("int", 160, 10, 10000),
        "buffer_capacity_ms": Field("int", 3200),
        "lookahead_ms": Field("int", 320, 0),
        "stability_threshold": Field("float", 0.7),
    },
    (
        ("buffer_capacity_ms must hold four chunks", lambda c: c["buffer_capacity_ms"] >= 4 * c["chunk_ms"]),
        ("lookahead_ms must not exceed buffer_capacity_ms", lambda c: c["lookahead_ms"] <= c["buffer_capacity_ms"]),
        ("stability_threshold must be within (0, 1]", lambda c: 0 < c["stability_threshold"] <= 1),
    ),
)
register_config(
    "train",
    {
        "encoder": Field("str", "tcn", choices=("tcn", "gru")),
        "hidden_size": Field("int", 64, 4, 1024),
        "layers": Field("int", 2, 1, 4),
        "dropout": Field("float", 0.1, 0.0, 0.9),
        "epochs": Field("int", 10, 1, 100_000),
        "batch_size": Field("int", 16, 1, 4096),
        "learning_rate": Field("float", 3e-3, 1e-6, 1.0),
        "intent_loss_weight": Field("float", 1.0, 0.0, 100.0),
        "slot_loss_weight": Field("float", 1.0, 0.0, 100.0),
        "grad_clip_norm": Field("float", 5.0, 1e-6, 100.0),
        "seed": Field("int", 20260926, 0, SEED_MAX),
    },
    (("one loss weight must be positive", lambda c: c["intent_loss_weight"] + c["slot_loss_weight"] > 0),),
)
