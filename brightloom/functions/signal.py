"""Signal arithmetic as Column functions; transforms that need an FFT are in brightloom.signal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def frame_count(n_samples: Column, frame_length: int, hop: int) -> Column:
    whole = ((n_samples - frame_length) / hop).cast("bigint") + 1
    return F.when(n_samples < frame_length, F.lit(0)).otherwise(whole).cast("bigint")


def frames(samples: Column, frame_length: int, hop: int) -> Column:
    n = frame_count(F.size(samples).cast("bigint"), frame_length, hop)
    cut = lambda f: F.slice(samples, (f * hop + 1).cast("int"), F.lit(frame_length))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), cut)).otherwise(F.array())


#: Cosine coefficients of periodic windows.
WINDOWS = {"hann": (0.5, 0.5, 0.0), "hamming": (0.54, 0.46, 0.0), "blackman": (0.42, 0.5, 0.08)}


def window_value(name: str, n: Column, length: int) -> Column:
    a, b, c = WINDOWS[name]
    turn = n * (2 * 3.141592653589793 / length)
    return F.lit(a) - F.lit(b) * F.cos(turn) + F.lit(c) * F.cos(turn * 2)


def hz_to_mel(hz: Column) -> Column:
    return F.log10(hz / 700.0 + 1.0) * 2595.0


def mel_to_hz(mel: Column) -> Column:
    return (F.pow(F.lit(10.0), mel / 2595.0) - 1.0) * 700.0


def to_pcm16(sample: Column) -> Column:
    """Clipped, scaled by 32767, truncated toward zero."""
    return (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sample.cast("double"))) * 32767).cast("smallint")


def from_pcm16(value: Column) -> Column:
    return (value / F.lit(32767.0)).cast("float")


def stream_frames(pushed: Column, frame_length: int, hop: int, lookahead: int) -> Column:
    """Frames committed once so many samples were pushed."""
    return frame_count(pushed - lookahead, frame_length, hop)


def snr_gain(signal_power: Column, noise_power: Column, snr_db: Column) -> Column:
    return F.sqrt(signal_power / (noise_power * F.pow(F.lit(10.0), snr_db / 10.0)))
