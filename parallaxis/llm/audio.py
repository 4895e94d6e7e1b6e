"""Audio columns: 8-bit PCM stored as WAV, polyphase resampling, overlapped log-mel frames and energy segments."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import small_batches

#: Bytes that text payloads are filled up to a multiple of, with blanks.
ALIGN = 192
#: Samples, after resampling, that are framed at once.
BLOCK = 1 << 17


@dataclass(frozen=True)
class AudioRules:
    """Rates in samples a second; frames in samples of the target rate; gates in decibels above the quietest frames."""

    rate: int = 16000
    target_rate: int = 6000
    taps: int = 8
    frame: int = 240
    hop: int = 120
    n_fft: int = 256
    mels: int = 16
    patch: int = 16
    open_db: float = 1.0
    close_db: float = 0.5
    min_frames: int = 2


# Storing


def _le(value: Column, width: int) -> Column:
    """A non-negative number as little-endian bytes."""
    hexed = F.lpad(F.hex(value.cast("long")), 2 * width, "0")
    return F.unhex(F.concat(*(F.substring(hexed, 2 * i + 1, 2) for i in reversed(range(width)))))


def wav_of(payload: Column, rate: int = AudioRules.rate) -> Column:
    """Bytes as the samples of a mono 8-bit WAV file; an odd number of them gets the format's filler byte."""
    n = F.length(payload)
    filler = F.when(n % 2 == 1, F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("")))
    fixed = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8) + b"data"
    return F.concat(F.lit(b"RIFF"), _le(n + n % 2 + 36, 4), F.lit(b"WAVE" + fixed), _le(n, 4), payload, filler)


def text_payload(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) filled with blanks up to a positive multiple of ALIGN."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    n = F.length(raw)
    whole = F.greatest(F.ceil(n / F.lit(ALIGN)), F.lit(1)) * ALIGN
    return F.concat(raw, F.encode(F.repeat(F.lit(" "), (whole - n).cast("int")), "UTF-8"))


def read_wav(media: bytes) -> tuple[int, np.ndarray]:
    """Rate and the 8-bit samples of a mono WAV file, by its chunk list."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("mono 8-bit PCM is read only")
        elif name == b"data":
            return rate, np.frombuffer(media, np.uint8, size, at + 8)
        at += 8 + size + size % 2
    raise ValueError("no samples")


# Features


@cache
def _polyphase(up: int, down: int, taps: int) -> np.ndarray:
    """Rows of filter taps, one for each phase: a windowed sinc that passes what both rates can hold."""
    half = taps * max(up, down)
    n = np.arange(-half, half + 1)
    cut = 1 / max(up, down)
    h = cut * np.sinc(cut * n) * np.kaiser(len(n), 6.0) * up
    width = -(-len(h) // up)
    phases = np.zeros((up, width))
    for p in range(up):
        own = h[p::up]
        phases[p, : len(own)] = own
    return phases


def resample(samples: np.ndarray, rate: int, target: int, taps: int) -> Iterator[np.ndarray]:
    """The signal in -1..1 at the target rate, block by block; output k stands at time k / target."""
    up, down = target // gcd(rate, target), rate // gcd(rate, target)
    phases = _polyphase(up, down, taps)
    width = phases.shape[1]
    half = taps * max(up, down)
    total = -(-len(samples) * up // down)
    for lo in range(0, total, BLOCK // up * up):
        hi = min(total, lo + BLOCK // up * up)
        out = np.empty(hi - lo)
        # Output k uses input i with weight h[k * down - i * up + half].
        first = lo * down // up - width - 1
        last = hi * down // up + width + 1
        x = np.zeros(last - first)
        a, b = max(first, 0), min(last, len(samples))
        if b > a:
            x[a - first : b - first] = (samples[a:b].astype(np.float64) - 128) / 128
        windows = np.lib.stride_tricks.sliding_window_view(x, width)
        for j in range(min(up, hi - lo)):
            t = (lo + j) * down + half
            phase, newest = t % up, t // up
            rows = -(-(hi - lo - j) // up)
            begin = newest - first - width + 1
            out[j::up] = windows[begin : begin + (rows - 1) * down + 1 : down] @ phases[phase, ::-1]
        yield out


@cache
def _mel_bank(rate: int, n_fft: int, mels: int) -> np.ndarray:
    """Triangles of equal width in mel, as columns over the spectrum's bins."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), mels + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, n_fft // 2 + 1)[:, None]
    rise = (f - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall))


@cache
def _window(n: int) -> np.ndarray:
    return np.hanning(n + 1)[:-1]


def log_mel(samples: np.ndarray, rate: int, rules: AudioRules) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel frames in steps of 1/64 decibel and each frame's energy in decibels; a short end is filled with silence."""
    window, bank = _window(rules.frame), _mel_bank(rules.target_rate, rules.n_fft, rules.mels)
    mels, energy = [], []
    held, left = np.zeros(0), -(-len(samples) * rules.target_rate // rate)
    for block in resample(samples, rate, rules.target_rate, rules.taps) if left else (held,):
        left -= len(block)
        x = np.concatenate([held, block]) if len(held) else block
        n = max(0, (len(x) - rules.frame) // rules.hop + 1)
        if left <= 0:  # the end: one more frame if samples are left over
            n = max(1, -(-(len(x) - rules.frame) // rules.hop) + 1)
            x = np.concatenate([x, np.zeros((n - 1) * rules.hop + rules.frame - min(len(x), (n - 1) * rules.hop + rules.frame))])
        if n:
            f = np.lib.stride_tricks.as_strided(x, (n, rules.frame), (x.strides[0] * rules.hop, x.strides[0])) * window
            z = np.fft.rfft(f, rules.n_fft)
            power = z.real**2 + z.imag**2
            mels.append(np.rint(10 * np.log10(power @ bank + 1e-9) * 64).astype(np.int16))
            energy.append(np.round(10 * np.log10(power.mean(axis=1) + 1e-9), 6))
        held = x[n * rules.hop :]
    return np.concatenate(mels), np.concatenate(energy)


def segments(energy: np.ndarray, rules: AudioRules) -> list[tuple[int, int]]:
    """Frames [from, to) of active spans: one opens above the upper gate and lasts while above the lower one."""
    floor = np.sort(energy)[(len(energy) - 1) // 10]
    low = np.append(np.append(False, energy >= floor + rules.close_db), False)
    cut = np.flatnonzero(low[1:] != low[:-1])
    loud = np.concatenate([[0], np.cumsum(energy >= floor + rules.open_db)])
    return [(a, b) for a, b in zip(cut[::2].tolist(), cut[1::2].tolist(), strict=True) if loud[b] > loud[a] and b - a >= rules.min_frames]


_END_OF_STREAM = struct.pack("<iI", -1, 0)


@cache
def _tensor_schema(patch: int, mels: int) -> tuple[pa.Schema, bytes]:
    fields = [("start_ms", pa.float64()), ("end_ms", pa.float64()), ("active_frames", pa.int32()), ("log_mel", pa.fixed_shape_tensor(pa.int16(), [patch, mels]))]
    schema = pa.schema(fields)
    return schema, schema.serialize().to_pybytes()


def tensor_batch(mels: np.ndarray, spans: list[tuple[int, int]], rules: AudioRules) -> bytes:
    """An Arrow stream of fixed-shape tensors, [patch, mels] each, with the span of time each covers and how much of it is active."""
    n = -(-len(mels) // rules.patch)
    full = np.full((n * rules.patch, rules.mels), np.iinfo(np.int16).min, dtype=np.int16)
    full[: len(mels)] = mels
    on = np.zeros(len(mels) + 1, dtype=np.int64)
    for a, b in spans:
        on[a] += 1
        on[b] -= 1
    active = np.add.reduceat(np.cumsum(on)[:-1], np.arange(0, len(mels), rules.patch))
    ms = 1000 * rules.hop / rules.target_rate
    first = np.arange(n) * rules.patch
    last = np.minimum(first + rules.patch, len(mels))
    schema, head = _tensor_schema(rules.patch, rules.mels)
    kind = schema.field("log_mel").type
    patches = pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(pa.array(full.ravel()), rules.patch * rules.mels))
    cols = [pa.array(first * ms), pa.array((last - 1) * ms + 1000 * rules.frame / rules.target_rate), pa.array(active.astype(np.int32)), patches]
    return head + pa.RecordBatch.from_arrays(cols, schema=schema).serialize().to_pybytes() + _END_OF_STREAM


def audio_features(df: DataFrame, media_col: str = "media", rules: AudioRules | None = None) -> DataFrame:
    """The input with samples (binary, as read back), n_frames, spans (milliseconds of active segments) and
    tensors (an Arrow stream of fixed-shape log-mel patches with their time spans).

    Each row depends on its own bytes only: equal media give equal features, ties and repeated rows alike. Null media
    gives null features; a file without samples gives one silent frame; what is no WAV file raises. Long media
    are resampled and framed in blocks. Input columns named like a feature are replaced.
    """
    rules = rules or AudioRules()
    small_batches(df.sparkSession)
    made = ["samples", "n_frames", "spans", "tensors"]
    keep = [c for c in df.columns if c.lower() not in made]
    at = keep.index(media_col)
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"`{c}` {fields[c]}" for c in keep), "samples binary, n_frames long, spans array<struct<start_ms:double,end_ms:double>>, tensors binary"])
    span = pa.list_(pa.struct([("start_ms", pa.float64()), ("end_ms", pa.float64())]))
    ms, tail = 1000 * rules.hop / rules.target_rate, 1000 * rules.frame / rules.target_rate

    def one(media: bytes | None) -> tuple:
        if media is None:
            return None, None, None, None
        rate, samples = read_wav(media)
        mels, energy = log_mel(samples, rate, rules)
        found = segments(energy, rules)
        times = [{"start_ms": a * ms, "end_ms": (b - 1) * ms + tail} for a, b in found]
        return samples.tobytes(), len(mels), times, tensor_batch(mels, found, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                rows = [one(m) for m in part.column(at).to_pylist()]
                cols = [[r[i] for r in rows] for i in range(4)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], span), pa.array(cols[3], pa.binary())], names=[*keep, *made])

    return df.select(*keep).mapInArrow(run, schema)
