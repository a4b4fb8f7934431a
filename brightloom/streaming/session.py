"""Streaming understanding with bounded state: frames commit once their audio and the lookahead have arrived.

``StreamSession`` is the state machine; its ``snapshot`` is plain JSON from which
``restore`` goes on. ``stream_sessions`` runs it as a stateful Structured
Streaming operator, keyed by session, with the snapshot as state;
``run_sessions`` runs its counting part alone.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.core.canonical import canonical_dumps, canonical_loads, exact_keys
from brightloom.core.errors import SchemaError, StreamingError, ValidationError
from brightloom.signal import kernels as k


SETTINGS = ("rate", "frame", "hop", "lookahead", "capacity", "stability", "n_fft")
STATE = ("pending", "pushed", "frames", "done", "tags", "context", "hidden", "total", "intent", "posterior", "stable", "stable_intent", "first_frame_ms", "first_stable_ms", "revisions")


class AudioBuffer:
    """Samples not consumed yet, no more than ``capacity``; overflow is an error, never truncation."""

    def __init__(self, capacity: int):
        if type(capacity) is not int or capacity < 1:
            raise ValidationError(f"capacity must be a positive whole number: {capacity!r}")
        self.capacity, self._held = capacity, np.zeros(0)

    @property
    def pending(self) -> int:
        return len(self._held)

    def append(self, samples: np.ndarray) -> None:
        x = np.asarray(samples, float)
        if x.ndim != 1 or not np.isfinite(x).all():
            raise StreamingError("samples must be one row of finite numbers")
        if len(self._held) + len(x) > self.capacity:
            raise StreamingError("the buffer is full")
        self._held = np.concatenate([self._held, x])

    def peek(self) -> np.ndarray:
        return self._held.copy()

    def consume(self, count: int) -> np.ndarray:
        if type(count) is not int or not 0 <= count <= len(self._held):
            raise StreamingError(f"{count!r} samples are not there")
        out, self._held = self._held[:count], self._held[count:]
        return out

    def clear(self) -> None:
        self._held = np.zeros(0)


class StreamSession:
    """Audio in, tags and a running intent out. Tags never change once committed and don't depend on the chunking."""

    def __init__(self, model, rate: int = 16000, frame: int = 400, hop: int = 160, lookahead: int = 5120, capacity: int = 51200, stability: float = 0.7, n_fft: int = 512):
        self.model, self.rate, self.frame, self.hop, self.lookahead, self.capacity, self.stability, self.n_fft = model, rate, frame, hop, lookahead, capacity, stability, n_fft
        self.pending, self.pushed, self.frames, self.done = np.zeros(0), 0, 0, False
        self.tags: list[str] = []
        self.context, self.hidden, self.total = np.zeros((0, model.spec["n_mels"])), None, 0.0
        self.intent = self.posterior = self.stable = self.stable_intent = self.first_frame_ms = self.first_stable_ms = None
        self.revisions = 0

    def push(self, samples: np.ndarray) -> int:
        if self.done:
            raise StreamingError("the session is finished")
        if len(self.pending) + len(samples) > self.capacity:
            raise StreamingError("the buffer is full")
        self.pending = np.concatenate([self.pending, np.asarray(samples, float)])
        self.pushed += len(samples)
        return self._commit(self.lookahead)

    def finalize(self) -> dict:
        if self.done:
            raise StreamingError("the session is finished")
        self._commit(0)
        self.done = True
        if not self.frames:
            raise StreamingError("shorter than one frame")
        keys = ("intent", "posterior", "stable", "tags", "first_frame_ms", "first_stable_ms", "revisions")
        return {n: getattr(self, n) for n in keys} | {"audio_ms": self.pushed / self.rate * 1000}

    def snapshot(self) -> dict:
        """All that the session knows, in JSON's own types."""
        plain = lambda v: v.tolist() if isinstance(v, np.ndarray) else [x.tolist() for x in v] if isinstance(v, list) and v and isinstance(v[0], np.ndarray) else v
        return {"schema": "brightloom.stream-state", "schema_version": 1, "model_hash": self.model.model_hash} | {n: plain(getattr(self, n)) for n in (*SETTINGS, *STATE)}

    @classmethod
    def restore(cls, value: dict, model) -> StreamSession:
        """The session of a snapshot taken with the same model; counters that cannot be are a SchemaError."""
        exact_keys(value, {"schema", "schema_version", "model_hash", *SETTINGS, *STATE}, "stream state")
        if value["schema"] != "brightloom.stream-state" or value["schema_version"] is True or value["schema_version"] != 1:
            raise SchemaError("unknown schema or version")
        if value["model_hash"] != model.model_hash:
            raise SchemaError("the state is of another model")
        counters = [value[n] for n in ("pushed", "frames", "revisions")]
        if any(type(n) is not int or n < 0 for n in counters) or len(value["tags"]) != value["frames"] or not set(value["tags"]) <= set(model.spec["tags"]):
            raise SchemaError("counters and tags don't fit")
        if len(value["pending"]) != value["pushed"] - value["frames"] * value["hop"] or len(value["pending"]) > value["capacity"]:
            raise SchemaError("pending audio doesn't fit the counters")
        if value["intent"] is not None and value["intent"] not in model.spec["intents"]:
            raise SchemaError("unknown intent")
        out = cls(model, **{n: value[n] for n in SETTINGS})
        for n in STATE:
            setattr(out, n, value[n])
        out.pending, out.context = np.array(value["pending"], float), np.array(value["context"], float).reshape(-1, model.spec["n_mels"])
        out.hidden = None if value["hidden"] is None else [np.array(h, float) for h in value["hidden"]]
        out.total = np.array(value["total"], float) if isinstance(value["total"], list) else 0.0
        return out

    def _commit(self, extra: int) -> int:
        count = max(0, k.frame_count(self.pushed - extra, self.frame, self.hop) - self.frames)
        if not count:
            return 0
        framed = k.frames(self.pending, self.frame, self.hop)[:count]
        bank = k.mel_filterbank(self.rate, self.n_fft, self.model.spec["n_mels"], 20.0, min(7600.0, self.rate / 2))
        mel = np.log(np.maximum(k.stft_power(framed * k.window("hann", self.frame), self.n_fft) @ bank.T, k.LOG_FLOOR)).astype(np.float32)
        self.pending = self.pending[count * self.hop :]
        field = self.model.receptive_field
        if field is None:
            states, self.hidden = self.model.encode(mel, self.hidden)
        else:
            # The frames that the encoder looks back on come along; their own states are known already.
            joined = np.concatenate([self.context, mel])
            states = self.model.encode(joined)[0][-count:]
            self.context = joined[max(0, len(joined) - field + 1) :]
        self.tags += [self.model.spec["tags"][i] for i in self.model.slot_logits(states).argmax(axis=1)]
        self.frames += count
        now = self.pushed / self.rate * 1000
        self.first_frame_ms = now if self.first_frame_ms is None else self.first_frame_ms
        self.total = self.total + states.sum(axis=0)
        from brightloom.model.net import softmax

        p = softmax(self.model.intent_logits(self.total, self.frames))
        self.intent, self.posterior = self.model.spec["intents"][int(p.argmax())], float(p.max())
        self.stable = self.posterior >= self.stability
        if self.stable:
            if self.stable_intent is None:
                self.first_stable_ms = now
            self.revisions += self.stable_intent not in (None, self.intent)
            self.stable_intent = self.intent
        return count


def _scratch(spark: SparkSession) -> str:
    """A new folder in the shared one; a temporary one only where none is named and all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise StreamingError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="brightloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/brightloom-{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"


RESULT = "session_id string, seq bigint, committed bigint, tags array<string>, intent string, posterior double, stable boolean, revisions bigint, finished boolean, error string"


def stream_sessions(chunks: DataFrame, model, **settings) -> DataFrame:
    """A stream of chunks (session_id, seq, samples, last) as a stream of updates (``RESULT``).

    A row that comes out has the tags committed by that chunk and the intent so
    far. A session's chunks are taken in the order of ``seq`` within a
    micro-batch, and in order of arrival between them; a chunk that is not the
    next one is an error of the session, after which it takes no more, as is an
    overflow. State is a snapshot, so a lost executor costs a batch, not a session.
    """
    spec, weights = model.spec, model.weights

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        from brightloom.model.net import JointModel

        own = JointModel(spec, weights)
        at, failed, held = state.get if state.exists else (0, None, None)
        session = StreamSession(own, **settings) if held is None else StreamSession.restore(canonical_loads(held), own)
        rows = []
        for row in pd.concat(list(parts)).sort_values("seq", kind="stable").itertuples():
            before = session.frames
            try:
                if failed is None:
                    if row.seq != at:
                        raise StreamingError(f"chunk {at} is missing")
                    session.push(np.asarray(row.samples, float))
                    if row.last:
                        session.finalize()
                    at += 1
            except StreamingError as e:
                failed = str(e)
            stable = None if session.stable is None else bool(session.stable)
            rows.append((key[0], row.seq, session.frames, session.tags[before:], session.intent, session.posterior, stable, session.revisions, session.done, failed))
        state.update((at, failed, canonical_dumps(session.snapshot())))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])

    return chunks.groupBy("session_id").applyInPandasWithState(step, RESULT, "at bigint, failed string, held string", "append", "NoTimeout")


def run_sessions(spark: SparkSession, events: DataFrame, frame: int = 400, hop: int = 160, lookahead: int = 5120) -> DataFrame:
    """Each user's events as pushes of audio: (user_id, pushed, committed, final_frames), from a stateful streaming query.

    Events go to the shared scratch folder, are read as a stream until all are
    taken, and state is kept between micro-batches. Counts do not depend on the
    order of events, so none is kept.
    """
    at = _scratch(spark)
    pushes = events.select("user_id", "event_id", F.col("ts").cast("string").alias("ts"), ((F.abs("value") * 100).cast("long") + 160).alias("n"))
    pushes.write.parquet(f"{at}/in")

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        pushed, n = state.get if state.exists else (0, 0)
        for part in chunks:
            pushed += int(part["n"].sum())
            n += len(part)
        state.update((pushed, n))
        yield pd.DataFrame({"user_id": [key[0]], "chunks": [n], "pushed": [pushed], "committed": [k.frame_count(pushed - lookahead, frame, hop)], "final_frames": [k.frame_count(pushed, frame, hop)]})

    source = spark.readStream.schema(pushes.schema).option("maxFilesPerTrigger", 4).parquet(f"{at}/in")
    out = "user_id bigint, chunks bigint, pushed bigint, committed bigint, final_frames bigint"
    states = source.groupBy("user_id").applyInPandasWithState(step, out, "pushed bigint, n bigint", "update", "NoTimeout")
    # Update rows go to files of their batch; the last state of a key is the one with most chunks.
    query = states.writeStream.outputMode("update").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{at}/out/batch={i}")).start()
    query.awaitTermination()
    rows = spark.read.schema(out).parquet(f"{at}/out")
    best = F.max(F.struct("chunks", "pushed", "committed", "final_frames"))
    return rows.groupBy("user_id").agg(best.alias("x")).select("user_id", "x.chunks", "x.pushed", "x.committed", "x.final_frames")
