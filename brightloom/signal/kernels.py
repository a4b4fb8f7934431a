"""Signal kernels in numpy: PCM, WAV, framing, log-mel features, synthesis."""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

from brightloom.core.errors import AudioError

LOG_FLOOR = 1e-10
_WINDOWS = {"hann": (0.5, 0.5, 0.0), "hamming": (0.54, 0.46, 0.0), "blackman": (0.42, 0.5, 0.08)}


def to_pcm16(samples: np.ndarray) -> bytes:
    x = np.asarray(samples, np.float64)
    if not np.isfinite(x).all():
        raise AudioError("samples must be finite")
    return (np.clip(x, -1.0, 1.0) * 32767).astype("<i2").tobytes()


def from_pcm16(data: bytes) -> np.ndarray:
    if len(data) % 2:
        raise AudioError("16-bit data must have an even number of bytes")
    return (np.frombuffer(data, "<i2") / 32767.0).astype(np.float32)


def build_wav(pcm: bytes, rate: int) -> bytes:
    """A mono 16-bit file with the usual 44-byte header."""
    fmt = struct.pack("<HHIIHH", 1, 1, rate, 2 * rate, 2, 16)
    return b"RIFF" + struct.pack("<I", 36 + len(pcm)) + b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(pcm)) + pcm


def parse_wav(data: bytes) -> tuple[int, np.ndarray]:
    """Rate and samples of a strict mono 16-bit file; other chunks are passed over."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise AudioError("not a RIFF/WAVE file")
    if struct.unpack_from("<I", data, 4)[0] != len(data) - 8:
        raise AudioError("the RIFF size doesn't match the file")
    at, rate, pcm = 12, None, None
    while at < len(data):
        if at + 8 > len(data):
            raise AudioError("cut-off chunk header")
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        body = data[at + 8 : at + 8 + size]
        if len(body) != size:
            raise AudioError("cut-off chunk")
        if name == b"fmt ":
            if rate is not None or size != 16:
                raise AudioError("one fmt chunk of 16 bytes is needed")
            kind, channels, rate, per_second, align, bits = struct.unpack("<HHIIHH", body)
            if (kind, channels, bits, align) != (1, 1, 16, 2) or per_second != 2 * rate:
                raise AudioError("only mono 16-bit PCM is read")
            if not 1000 <= rate <= 192000:
                raise AudioError(f"rate out of bounds: {rate}")
        elif name == b"data":
            if rate is None or pcm is not None:
                raise AudioError("one data chunk after fmt is needed")
            pcm = body
        at += 8 + size + size % 2
    if rate is None or not pcm:
        raise AudioError("no samples")
    return rate, from_pcm16(pcm)


def frame_count(n: int, length: int, hop: int) -> int:
    return 0 if n < length else (n - length) // hop + 1


def frames(samples: np.ndarray, length: int, hop: int) -> np.ndarray:
    """A view [frames, length] without the tail."""
    n = frame_count(len(samples), length, hop)
    if not n:
        return np.empty((0, length), samples.dtype)
    return np.lib.stride_tricks.sliding_window_view(samples, length)[:: hop][:n]


@lru_cache(64)
def window(name: str, length: int) -> np.ndarray:
    a, b, c = _WINDOWS[name]
    turn = 2 * np.pi * np.arange(length) / length
    return a - b * np.cos(turn) + c * np.cos(2 * turn)


def stft_power(framed: np.ndarray, n_fft: int) -> np.ndarray:
    if framed.shape[-1] > n_fft:
        raise AudioError("frames are longer than the transform")
    return np.abs(np.fft.rfft(framed, n_fft)) ** 2


def hz_to_mel(hz):
    return 2595.0 * np.log10(1.0 + np.asarray(hz, float) / 700.0)


def mel_to_hz(mel):
    return 700.0 * (10.0 ** (np.asarray(mel, float) / 2595.0) - 1.0)


@lru_cache(64)
def mel_filterbank(rate: int, n_fft: int, n_mels: int, low: float, high: float) -> np.ndarray:
    """Triangles of height 1, evenly spaced in mel: [n_mels, n_fft / 2 + 1]."""
    edges = mel_to_hz(np.linspace(hz_to_mel(low), hz_to_mel(high), n_mels + 2))
    bins = np.arange(n_fft // 2 + 1) * rate / n_fft
    left, mid, right = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    bank = np.maximum(0.0, np.minimum((bins - left) / (mid - left), (right - bins) / (right - mid)))
    peak = bank.max(axis=1, keepdims=True)
    if (peak <= 0).any():
        raise AudioError("a mel filter covers no bin; use fewer filters or a longer transform")
    return bank / peak


def log_mel(samples: np.ndarray, rate: int = 16000, frame_ms: float = 25, hop_ms: float = 10, n_fft: int = 512, n_mels: int = 64, low: float = 20.0, high: float = 7600.0, window_name: str = "hann") -> np.ndarray:
    length, hop = round(rate * frame_ms / 1000), round(rate * hop_ms / 1000)
    framed = frames(np.asarray(samples, np.float64), length, hop)
    power = stft_power(framed * window(window_name, length), n_fft)
    return np.log(np.maximum(power @ mel_filterbank(rate, n_fft, n_mels, low, high).T, LOG_FLOOR)).astype(np.float32)


def tone(freq: float, n: int, rate: int, amplitude: float = 1.0, phase: float = 0.0) -> np.ndarray:
    return amplitude * np.sin(2 * np.pi * freq * np.arange(n) / rate + phase)


def chirp(start: float, end: float, n: int, rate: int, amplitude: float = 1.0) -> np.ndarray:
    t, total = np.arange(n) / rate, n / rate
    return amplitude * np.sin(2 * np.pi * (start * t + (end - start) * t * t / (2 * total)))


def formants(freqs: list[float], n: int, rate: int, amplitude: float = 1.0) -> np.ndarray:
    mixed = sum(tone(f, n, rate) / k for k, f in enumerate(freqs, 1))
    peak = np.abs(mixed).max() if n else 0.0
    return amplitude * mixed / peak if peak > 0 else mixed


def noise(n: int, amplitude: float, rng: np.random.Generator) -> np.ndarray:
    return np.clip(rng.normal(0.0, amplitude / 3, n), -amplitude, amplitude)


def apply_snr(signal: np.ndarray, noise_: np.ndarray, snr_db: float) -> np.ndarray:
    power, other = np.mean(signal**2), np.mean(noise_**2)
    if power <= 0 or other <= 0:
        raise AudioError("signal and noise must not be silent")
    return np.clip(signal + noise_ * np.sqrt(power / (other * 10 ** (snr_db / 10))), -1.0, 1.0)


def fade(signal: np.ndarray, rate: int, attack_ms: float = 5, release_ms: float = 5) -> np.ndarray:
    out = np.array(signal, float)
    for ms, ramp in ((attack_ms, slice(None)), (release_ms, slice(None, None, -1))):
        n = min(len(out), round(rate * ms / 1000))
        curve = 0.5 - 0.5 * np.cos(np.pi * np.arange(n) / max(1, n))
        view = out[ramp]
        view[:n] *= curve
    return out
