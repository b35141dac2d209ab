"""Media columns: texts' bytes as WAV files, and spectral-peak pair fingerprints of what is read back.

The payload is stored as mono 8-bit samples. Features come from the bytes that
the wave module reads back: a short-time Fourier transform, the strongest bin
of each band and frame, and pairs of successive strong peaks, each pair coded
with the time at which it starts.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from samphire.llm.common import map_text

#: The samples of a frame; payloads are padded to a multiple of it.
FRAME = 192
#: Limits of the bands, in bins of the transform; bin 0 (the mean) is in none.
BANDS = (1, 4, 10, 22, 46, 97)
PAD = b" "


def padded(text: str | None, unit: int = FRAME) -> bytes:
    """UTF-8 bytes, with bytes 32 up to a positive multiple of ``unit``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(1, -(-len(raw) // unit)) * unit, PAD)


def write_wav(payload: bytes, rate: int = 8000) -> bytes:
    with io.BytesIO() as file:
        with wave.open(file, "wb") as out:
            out.setnchannels(1)
            out.setsampwidth(1)
            out.setframerate(rate)
            out.writeframes(payload)
        return file.getvalue()


def read_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as file:
        if (file.getnchannels(), file.getsampwidth()) != (1, 1):
            raise ValueError("mono 8-bit samples are expected")
        return file.readframes(file.getnframes())


def spectrogram(samples: bytes, window: np.ndarray, block: int = 4096):
    """Magnitudes of half-overlapping frames, in blocks of frames, so that memory doesn't follow a file's length."""
    x = np.frombuffer(samples, np.uint8)
    silence = np.full(FRAME // 2, 128, np.uint8)
    x = np.concatenate([silence, x, np.full(-len(x) % FRAME, 128, np.uint8), silence])
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[:: FRAME // 2]
    for i in range(0, len(frames), block):
        yield i, np.abs(np.fft.rfft((frames[i : i + block].astype(np.float32) - 128) * window, axis=1))


def peak_pairs(samples: bytes, window: np.ndarray) -> np.ndarray:
    """int64 codes, by time: start frame << 24 | first bin << 16 | second bin << 8 | frames between them.

    A peak is a band's strongest bin in a frame where it is at least as strong as in the frames before and after. Each
    peak pairs with the next peak of its own band and the next one of the band above, at most 63 frames later. The
    strongest bins of neighbouring bands in a frame that holds a peak of either pair too; in place of frames between them
    their code has the ratio of their strengths (64 to 255), so that sounds of one frame have a fingerprint.
    """
    bins, power = [], []
    for _, magnitude in spectrogram(samples, window):
        at = [np.argmax(magnitude[:, a:b], axis=1) + a for a, b in zip(BANDS, BANDS[1:], strict=False)]
        bins.append(np.stack(at, axis=1))
        power.append(np.take_along_axis(magnitude, bins[-1], axis=1))
    bins, power = np.concatenate(bins), np.concatenate(power)
    edge = np.full((1, power.shape[1]), -1, power.dtype)
    peak = (power >= np.concatenate([edge, power[:-1]])) & (power >= np.concatenate([power[1:], edge])) & (power > 0)
    times = [np.flatnonzero(peak[:, k]) for k in range(peak.shape[1])]
    codes = []
    for k in range(len(times) - 1):
        a = np.flatnonzero(peak[:, k] | peak[:, k + 1])
        ratio = np.log2((power[a, k].astype(np.float64) + 1e-3) / (power[a, k + 1].astype(np.float64) + 1e-3))
        level = np.clip(np.rint(12 * ratio) + 160, 64, 255).astype(np.int64)
        codes.append(a.astype(np.int64) << 24 | bins[a, k].astype(np.int64) << 16 | bins[a, k + 1].astype(np.int64) << 8 | level)
    for k, t in enumerate(times):
        for other in {k, min(k + 1, len(times) - 1)}:
            to = times[other]
            after = np.searchsorted(to, t, side="right")
            ok = after < len(to)
            a, b = t[ok], to[after[ok]]
            near = b - a <= 63
            a, b = a[near], b[near]
            codes.append(a.astype(np.int64) << 24 | bins[a, k].astype(np.int64) << 16 | bins[b, other].astype(np.int64) << 8 | (b - a))
    return np.unique(np.concatenate(codes)) if codes else np.empty(0, np.int64)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = 8000) -> DataFrame:
    """(id, n_bytes, media, payload, fingerprint) of every whole text.

    ``media``: the WAV file. ``payload``: its samples, as read back. ``fingerprint``: time-coded pairs of spectral peaks.
    Null and empty texts give one frame of padding, whose constant spectrum still has a defined fingerprint. Equal texts
    give equal values; repeated rows give a row each; null ids stay null; other columns are ignored.
    """

    def make():
        window = np.hanning(FRAME).astype(np.float32)

        def work(texts):
            n_bytes, stored, payloads, codes, ends = [], [], [], [], [0]
            for text in texts:
                n_bytes.append(len((text or "").encode("utf-8", "surrogatepass")))
                stored.append(write_wav(padded(text), rate))
                payloads.append(read_wav(stored[-1]))
                codes.append(peak_pairs(payloads[-1], window))
                ends.append(ends[-1] + len(codes[-1]))
            prints = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *codes])))
            return [pa.array(n_bytes, pa.int64()), pa.array(stored, pa.binary()), pa.array(payloads, pa.binary()), prints]

        return work

    fields = [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("media", T.BinaryType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("fingerprint", T.ArrayType(T.LongType())),
    ]
    return map_text(docs, [id_col], fields, make, text_col)


def media_digests(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Lengths and digests of what ``media_columns`` returns."""
    return media.select(
        id_col,
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.size("fingerprint"), F.sha2(F.array_join("fingerprint", ",").cast("binary"), 256)).alias("feature"),
    )
