"""Signal kernels over tables, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def log_mel_columns(rows: DataFrame, samples: str = "samples", **config) -> DataFrame:
    """``rows`` with ``mel`` (array of frames) instead of the samples; null samples give null."""
    rest = [c for c in rows.columns if c not in (samples, "mel")]
    schema = T.StructType([rows.schema[c] for c in rest]).add("mel", T.ArrayType(T.ArrayType(T.FloatType())))

    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from brightloom.signal.kernels import log_mel

        for batch in batches:
            mel = [None if v.as_py() is None else log_mel(np.asarray(v.as_py(), np.float64), **config).tolist() for v in batch[samples]]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in rest], pa.array(mel, pa.list_(pa.list_(pa.float32())))], [*rest, "mel"])

    return rows.select(*rest, samples).mapInArrow(run, schema)


def power_columns(rows: DataFrame, config: dict, samples: str = "samples") -> DataFrame:
    """``rows`` with ``power`` (frames of power spectra under a hann window) instead of the samples; null samples give null."""
    rest = [c for c in rows.columns if c not in (samples, "power")]
    schema = T.StructType([rows.schema[c] for c in rest]).add("power", T.ArrayType(T.ArrayType(T.DoubleType())))
    length, hop = (round(config["rate"] * config[k] / 1000) for k in ("frame_ms", "hop_ms"))

    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from brightloom.signal.kernels import frames, stft_power, window

        for batch in batches:
            found = [None if v.as_py() is None else stft_power(frames(np.asarray(v.as_py(), float), length, hop) * window("hann", length), config["n_fft"]).tolist() for v in batch[samples]]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in rest], pa.array(found, pa.list_(pa.list_(pa.float64())))], [*rest, "power"])

    return rows.select(*rest, samples).mapInArrow(run, schema)


def log_mel_summary(rows: DataFrame) -> DataFrame:
    """Frames and mean of short signals at 1 kHz: vec_id, n_frames, mean_log_mel."""
    from pyspark.sql import functions as F

    mel = log_mel_columns(rows, rate=1000, frame_ms=16, hop_ms=8, n_fft=16, n_mels=4, low=20.0, high=480.0)
    flat = F.flatten("mel")
    total = F.aggregate(flat, F.lit(0.0), lambda s, x: s + x)
    return mel.select("vec_id", F.size("mel").cast("long").alias("n_frames"), F.round(total / F.size(flat), 5).alias("mean_log_mel"))


def wav_columns(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` with ``audio`` (sample_rate, samples, error): unreadable files have an error and no samples."""
    rest = [c for c in files.columns if c not in (content, "audio")]
    schema = T.StructType([files.schema[c] for c in rest]).add("audio", T._parse_datatype_string("sample_rate int, samples array<float>, error string"))

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        from brightloom.core.errors import AudioError
        from brightloom.signal.kernels import parse_wav

        kind = pa.struct([("sample_rate", pa.int32()), ("samples", pa.list_(pa.float32())), ("error", pa.string())])
        for batch in batches:
            out = []
            for value in batch[content]:
                try:
                    rate, samples = parse_wav(value.as_py() or b"")
                    out.append({"sample_rate": rate, "samples": samples.tolist(), "error": None})
                except AudioError as e:
                    out.append({"sample_rate": None, "samples": None, "error": str(e)})
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in rest], pa.array(out, kind)], [*rest, "audio"])

    return files.select(*rest, content).mapInArrow(run, schema)
