"""PCM samples in NumPy, for use inside Arrow-fed functions."""

from __future__ import annotations

import io
import wave

import numpy as np


def pcm16(raw: bytes, channels: int = 1) -> np.ndarray:
    """Samples of little-endian 16-bit PCM between -1 and 1; several channels are averaged, half a sample at the end is left out."""
    x = np.frombuffer(raw[: len(raw) // (2 * channels) * 2 * channels], "<i2").astype(np.float64) / 32768
    return x if channels == 1 else x.reshape(-1, channels).mean(1)


def decoded(content: bytes) -> tuple[np.ndarray, int] | None:
    """(mono samples, rate) of a RIFF file of 16-bit PCM; None for anything else."""
    try:
        with wave.open(io.BytesIO(content)) as w:
            if w.getsampwidth() != 2:
                return None
            return pcm16(w.readframes(w.getnframes()), w.getnchannels()), w.getframerate()
    except (wave.Error, EOFError):
        return None


def encoded(x: np.ndarray, rate: int) -> bytes:
    """A mono RIFF file of samples between -1 and 1."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.clip(np.round(x * 32768), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def resampled(x: np.ndarray, rate: int, to: int, zeros: int = 16) -> np.ndarray:
    """Band-limited resampling: each new sample is a sum of old ones weighted by a Hann-windowed sinc of the lesser rate's width.

    ceil(n x to / rate) samples; phases repeat every to / gcd samples, so only their weights are worked out.
    """
    if rate == to or not len(x):
        return x.astype(np.float64)
    g = int(np.gcd(rate, to))
    up, down = to // g, rate // g
    n = -(-len(x) * up // down)
    low = min(1.0, to / rate)  # cut-off, as a share of the old rate's half
    reach = int(np.ceil(zeros / low))
    padded = np.concatenate((np.zeros(reach), x.astype(np.float64), np.zeros(reach + down + 1)))
    out = np.zeros(n)
    taps = np.arange(-reach + 1, reach + 1)
    for phase in range(min(up, n)):
        k = np.arange(phase, n, up)
        at = k * down // up
        t = (taps - (phase * down % up) / up) * low
        weight = np.where(np.abs(t) <= zeros, low * np.sinc(t) * np.cos(np.pi * t / (2 * zeros)) ** 2, 0.0)
        for start in range(0, len(k), 65536):
            rows = at[start : start + 65536, None] + taps[None, :] + reach
            out[k[start : start + 65536]] = padded[rows] @ weight
    return out
