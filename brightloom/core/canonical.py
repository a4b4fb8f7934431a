"""Canonical JSON, hashes over it, seeds from hashes, and atomic files for small envelopes."""

from __future__ import annotations

import hashlib
import json
import math
import os
import re
import tempfile
from typing import Any

from brightloom.core.errors import SchemaError, ValidationError

MAX_ARTIFACT_BYTES = 256 * 1024 * 1024
_ID = re.compile(r"[a-z][a-z0-9]*(?:-[a-z0-9]+)*")


def _plain(value: Any) -> None:
    if isinstance(value, dict):
        for k, v in value.items():
            if not isinstance(k, str):
                raise ValidationError(f"keys must be strings: {k!r}")
            _plain(v)
    elif isinstance(value, (list, tuple)):
        for v in value:
            _plain(v)
    elif isinstance(value, float):
        if not math.isfinite(value):
            raise ValidationError("numbers must be finite")
    elif value is not None and not isinstance(value, (str, int, bool)):
        raise ValidationError(f"not a JSON value: {type(value).__name__}")


def canonical_dumps(value: Any) -> str:
    """JSON with sorted keys and no spaces; only JSON's own types, finite numbers."""
    _plain(value)
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def canonical_loads(text: str | bytes) -> Any:
    """Parses JSON; duplicate keys, bad UTF-8 and non-finite numbers are errors."""

    def unique(pairs: list) -> dict:
        out = dict(pairs)
        if len(out) != len(pairs):
            raise SchemaError("duplicate object key")
        return out

    def reject(name: str) -> None:
        raise SchemaError(f"not a finite number: {name}")

    try:
        return json.loads(text.decode("utf-8") if isinstance(text, bytes) else text, object_pairs_hook=unique, parse_constant=reject)
    except (UnicodeDecodeError, json.JSONDecodeError) as e:
        raise SchemaError(str(e)) from e


def stable_hash(value: Any) -> str:
    return hashlib.sha256(canonical_dumps(value).encode("utf-8")).hexdigest()


def derive_seed(*parts: Any) -> int:
    """The low 32 bits of the first 64 of the parts' hash."""
    return int(stable_hash(list(parts))[8:16], 16)


def make_rng(seed: int):
    import numpy as np

    if isinstance(seed, bool) or not isinstance(seed, int) or not 0 <= seed < 2**32:
        raise ValidationError(f"seed must be an int in [0, 2**32): {seed!r}")
    return np.random.Generator(np.random.PCG64(seed))


def validate_id(value: Any, field: str = "id") -> str:
    if not isinstance(value, str) or not 1 <= len(value) <= 64 or not _ID.fullmatch(value):
        raise ValidationError(f"{field} must be a kebab-case id of at most 64 characters: {value!r}")
    return value


def exact_keys(value: Any, keys: set[str], what: str) -> dict:
    """``value`` if it is an object with just these keys."""
    if not isinstance(value, dict):
        raise SchemaError(f"{what} must be an object")
    if (extra := sorted(set(value) - keys)) or (missing := sorted(keys - set(value))):
        raise SchemaError(f"{what}: unknown keys {extra}" if extra else f"{what}: missing keys {missing}")
    return value


def write_atomic(path: str, text: str) -> None:
    """Writes a small file next to its place, then renames it."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
            f.write(text)
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise


def write_json(path: str, value: Any) -> None:
    write_atomic(path, canonical_dumps(value) + "\n")


def read_json(path: str, max_bytes: int = MAX_ARTIFACT_BYTES) -> dict:
    if os.path.getsize(path) > max_bytes:
        raise SchemaError(f"{path} is larger than {max_bytes} bytes")
    with open(path, "rb") as f:
        value = canonical_loads(f.read())
    if not isinstance(value, dict):
        raise SchemaError(f"{path} must hold one object")
    return value
