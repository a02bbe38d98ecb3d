"""Chroma audio fingerprints of media columns.

A recording (PCM WAV bytes) becomes frames of energy by pitch class.  Filters, evaluated
on an integral image over the frames, compare the energy of neighbouring areas; sixteen
of them, quantised to two bits in Gray code, make up one packed 32-bit integer a frame.
Two recordings are aligned by the histogram of the offsets at which their integers nearly
agree, and the bit errors at the best offset say whether they are the same.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean, release, tidy
from .hashing import mix

U64 = np.uint64
#: Seconds of a frame, frames a frame is moved by, and the range of pitches in Hz.
FRAME_SECONDS, OVERLAP, LOW, HIGH = 0.3715, 3, 28.0, 2600.0
#: Frames of the widest filter.
WIDTH = 16
#: Fixed rule: filters cycle through six shapes; height and width grow with the round.
FILTERS = tuple((i % 6, (5 * i) % 12, 2 + i % 4, 4 + 3 * (i % 5)) for i in range(16))
#: Limits between the four levels of a filter's response (a log ratio).
LEVELS = (-0.25, 0.0, 0.25)
#: Frames that have to agree at an offset to look at it, and the share of bits in error
#: up to which recordings are the same there.
VOTES, ERRORS, SHORTEST = 2, 0.25, 8
#: Bits of 64 that may be in error where frames agree, and bytes of prints in a block.
NEAR, BLOCK = 10, 1 << 18


def read_wav(payload: bytes) -> tuple[np.ndarray, int]:
    """Mono samples from -1 to 1 and their rate; what is no PCM WAV has no samples."""
    try:
        with wave.open(io.BytesIO(payload or b"")) as w:
            kind = {1: np.uint8, 2: "<i2", 4: "<i4"}[w.getsampwidth()]
            data = np.frombuffer(w.readframes(w.getnframes()), kind).astype(np.float32)
            data = (data - 128) / 128 if w.getsampwidth() == 1 else data / float(1 << (8 * w.getsampwidth() - 1))
            return data.reshape(-1, w.getnchannels()).mean(1), w.getframerate()
    except (wave.Error, EOFError, KeyError, ValueError):
        return np.empty(0, np.float32), 1


def write_wav(samples: np.ndarray, rate: int) -> bytes:
    """16-bit mono WAV of samples from -1 to 1."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


_FOLD: dict[tuple[int, int], np.ndarray] = {}


def _fold(frame: int, rate: int) -> np.ndarray:
    """Matrix that adds spectral energy up by pitch class."""
    if (frame, rate) not in _FOLD:
        hz = np.fft.rfftfreq(frame, 1 / rate)
        m = np.zeros((len(hz), 12), np.float32)
        use = np.flatnonzero((hz >= LOW) & (hz <= HIGH))
        m[use, np.round(12 * np.log2(hz[use] / 440.0)).astype(int) % 12] = 1
        _FOLD[frame, rate] = m
    return _FOLD[frame, rate]


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Energy by pitch class of every frame, each frame of unit length."""
    frame = 1 << max(4, round(np.log2(rate * FRAME_SECONDS)))
    hop = frame // OVERLAP
    if len(samples) < frame:
        return np.empty((0, 12), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(samples, frame)[::hop]
    power = np.abs(np.fft.rfft(frames * np.hanning(frame).astype(np.float32), axis=1)).astype(np.float32) ** 2
    out = power @ _fold(frame, rate)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def fingerprint(samples: np.ndarray, rate: int) -> np.ndarray:
    """One packed 32-bit integer for each frame from which the widest filter fits."""
    image = chroma(samples, rate)
    n = len(image) - WIDTH + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    image = np.hstack([image, image])  # pitch classes go round
    total = np.zeros((image.shape[0] + 1, image.shape[1] + 1))
    total[1:, 1:] = image.cumsum(0).cumsum(1)
    t = np.arange(n)

    def area(t0, t1, y0, y1):
        return total[t + t1, y1] - total[t + t0, y1] - total[t + t1, y0] + total[t + t0, y0]

    out = np.zeros(n, np.uint32)
    for shape, y, h, w in FILTERS:
        half, third, rise = w // 2, max(1, w // 3), max(1, h // 2)
        whole = area(0, w, y, y + h)
        if shape == 0:
            part = area(0, w, y, y + rise)
        elif shape == 1:
            part = area(0, half, y, y + h)
        elif shape == 2:
            part = area(0, half, y, y + rise) + area(half, w, y + rise, y + h)
        elif shape == 3:
            part = area(third, w - third, y, y + h)
        elif shape == 4:
            part = area(0, half, y + rise, y + h)
        else:
            whole, part = area(0, w, 0, 12), whole
        level = np.searchsorted(LEVELS, np.log((part + 0.01) / (whole - part + 0.01)))
        out = out << np.uint32(2) | (level ^ level >> 1).astype(np.uint32)
    return out


def fingerprints(media: DataFrame) -> DataFrame:
    """media_id, n_frames, prints (packed 32-bit integers) and class_key of ``media``
    (media_id, payload): recordings with equal integers share class_key.

    A null or unreadable payload, or a recording too short, has no integers and class_key
    null.  Repeated rows repeat; an empty table gives no rows.
    """

    def build(batches):
        for batch in (b.slice(at, 32) for b in batches for at in range(0, b.num_rows, 32)):
            prints = [fingerprint(*read_wav(x)) for x in batch.column("payload").to_pylist()]
            keys = [int(mix(p.astype(U64) + (np.arange(len(p), dtype=U64) << U64(32))).sum(dtype=U64).astype(np.int64)) if len(p) else None for p in prints]
            cells = [batch.column("media_id"), pa.array(map(len, prints), pa.int32()), pa.array([p.tobytes() for p in prints], pa.binary()), pa.array(keys, pa.int64())]
            yield pa.RecordBatch.from_arrays(cells, names=["media_id", "n_frames", "prints", "class_key"])

    return lean(media).select("media_id", "payload").mapInArrow(tidy(build), "media_id long, n_frames int, prints binary, class_key long")


def bit_errors(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, float]:
    """Frames that overlap when b begins ``offset`` frames into a, and bits in error there."""
    lo, hi = max(0, offset), min(len(a), len(b) + offset)
    if hi <= lo:
        return 0, 1.0
    return hi - lo, float(np.bitwise_count(a[lo:hi] ^ b[lo - offset : hi - offset]).sum() / (32 * (hi - lo)))


def _by_length(prints: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places, integers and bits (+1 and -1) of the prints of each length, at most 512 together."""
    lengths, out = np.array(list(map(len, prints))), []
    for n in np.unique(lengths[lengths >= SHORTEST]):
        rows = np.flatnonzero(lengths == n)
        step = int(max(1, min(512, (1 << 19) // n)))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            ints = np.stack([prints[i] for i in some])
            bits = np.unpackbits(ints.view(np.uint8), axis=1).astype(np.float32)
            out.append((some, ints, 2 * bits - 1))
    return out


def alignments(asks: list[np.ndarray], all_: list[np.ndarray]) -> dict[tuple[int, int], tuple[int, int, int, float]]:
    """(votes, offset, frames, bit error) of each pair of places that aligns.

    The bits in error of every pair are measured at every offset, as products of matrices;
    the offset with most votes (then the smallest) of those within ERRORS counts.
    """
    best: dict[tuple[int, int], tuple[int, int, int, float]] = {}
    queries = _by_length(asks)
    for rows, a, x in _by_length(all_):
        for cols, b, y in queries:
            for offset in range(SHORTEST - b.shape[1], a.shape[1] - SHORTEST + 1):
                lo, hi = max(0, offset), min(a.shape[1], b.shape[1] + offset)
                n = hi - lo
                same = x[:, 32 * lo : 32 * hi] @ y[:, 32 * (lo - offset) : 32 * (hi - offset)].T
                i, j = np.nonzero(same >= 32 * n * (1 - 2 * ERRORS))
                for at in range(0, len(i), 1 << 14):
                    p, q = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
                    wrong = np.bitwise_count(a[p, lo:hi] ^ b[q, lo - offset : hi - offset]).astype(np.int32)
                    votes = ((wrong[:, :-3] + wrong[:, 3:]) <= NEAR).sum(1)
                    for k in np.flatnonzero(votes >= VOTES).tolist():
                        pair = int(cols[q[k]]), int(rows[p[k]])
                        if pair not in best or votes[k] > best[pair][0]:
                            best[pair] = int(votes[k]), offset, n, float(wrong[k].sum() / (32 * n))
    return best


def align(queries: DataFrame, media: DataFrame) -> DataFrame:
    """Alignments of the classes of ``queries`` with those of ``media``, both as
    ``fingerprints`` returns them.

    Returns query_key, class_key, offset (frames of the recording before the query),
    votes, frames (overlap) and bit_error.  An offset has a vote for each frame at which two
    integers three frames apart have at most NEAR of 64 bits in error; of the offsets with
    VOTES, SHORTEST frames and at most ERRORS, the one with most votes (then the smallest).
    One row for a pair of classes, however many recordings they have.  Recordings without a
    class_key, and classes of fewer than SHORTEST integers, align with nothing; an empty
    side gives no rows; other columns are ignored.

    No key finds integers with many bits in error, so all pairs are measured: both sides
    are dealt to blocks of about BLOCK bytes, and each two blocks are one task's matrices.
    """
    one = lambda df, key: df.filter("class_key IS NOT NULL").groupBy(F.col("class_key").alias(key)).agg(F.first("prints").alias("prints"))
    asks, all_ = cut(one(queries, "query_key")), cut(one(media, "class_key"))
    deal = lambda df: 1 + int(df.agg(F.sum(F.length("prints"))).first()[0] or 0) // BLOCK
    m, n = deal(asks), deal(all_)
    part = lambda key, k: F.pmod(F.xxhash64(key), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = asks.select(part("query_key", m).alias("i"), every(n).alias("j"), "query_key", "prints")
    right = all_.select(every(m).alias("i"), part("class_key", n).alias("j"), "class_key", "prints")

    def measure(a: pa.Table, b: pa.Table) -> pa.Table:
        x, y = ([np.frombuffer(v, np.uint32) for v in t.column("prints").to_pylist()] for t in (a, b))
        found = alignments(x, y)
        keys = [a.column("query_key").to_pylist(), b.column("class_key").to_pylist()]
        rows = [(keys[0][p], keys[1][q], o, v, f, e) for (p, q), (v, o, f, e) in found.items()]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.float64()]
        columns = zip(*rows) if rows else [()] * len(kinds)
        release()
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["query_key", "class_key", "offset", "votes", "frames", "bit_error"])

    blocks = left.groupBy("i", "j").cogroup(right.groupBy("i", "j"))
    return blocks.applyInArrow(measure, "query_key long, class_key long, offset int, votes long, frames int, bit_error double")


def melody(vector: list[float], rate: int = 5512, note: float = 0.125) -> np.ndarray:
    """A recording of a vector: one note for each component, a semitone for every step."""
    t = np.arange(int(rate * note)) / rate
    fade = np.minimum(1, np.minimum(t, t[::-1]) / 0.01)
    tones = [np.sin(2 * np.pi * 110.0 * 2 ** (k / 12) * t) * fade * 0.5 for k in range(36)]
    steps = [int(np.floor((x if x is not None and np.isfinite(x) else 0.0) * 40)) + 7 * i for i, x in enumerate(vector or [])]
    return np.concatenate([tones[s % 36] for s in steps]).astype(np.float32) if steps else np.empty(0, np.float32)


def recordings(vectors: DataFrame, clip: bool = False, rate: int = 5512) -> DataFrame:
    """media_id and payload (WAV) of ``vectors`` (vec_id, embedding).

    With ``clip``, what a listener might have recorded: from the ninth note on, quieter
    and with hiss.  A null vector gives a recording of no samples.
    """

    def build(batches):
        for batch in (b.slice(at, 32) for b in batches for at in range(0, b.num_rows, 32)):
            out = []
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist()):
                s = melody(v, rate)
                if clip:
                    s = s[int(rate * 0.125) * 8 :] * 0.6
                    s = s + np.random.default_rng(abs(i or 0)).normal(0, 0.002, len(s)).astype(np.float32)
                out.append(write_wav(s, rate))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary())], names=["media_id", "payload"])

    return lean(vectors).select("vec_id", "embedding").mapInArrow(tidy(build), "media_id long, payload binary")


def search(vectors: DataFrame, every: int = 50) -> DataFrame:
    """Clips of the recordings whose id ``every`` divides, searched in all recordings.

    One row for each recording: media_id, class_id (the smallest id of its class of equal
    fingerprints), n_frames and matches: the query classes found in its class, as
    (query_id, offset, frames, bit_error) by query_id.
    """
    media = cut(fingerprints(recordings(vectors)).drop("payload"))
    clips = cut(fingerprints(recordings(vectors.filter(F.col("vec_id") % every == 0), clip=True)))
    names = clips.groupBy(F.col("class_key").alias("query_key")).agg(F.min("media_id").alias("query_id"))
    found = align(clips, media).join(names, "query_key")
    found = found.groupBy("class_key").agg(F.array_sort(F.collect_list(F.struct("query_id", "offset", "frames", F.round("bit_error", 6).alias("bit_error")))).alias("matches"))
    classes = media.filter("class_key IS NOT NULL").groupBy("class_key").agg(F.min("media_id").alias("class_id")).join(found, "class_key", "left")
    out = media.join(classes, "class_key", "left")
    none = F.array().cast("array<struct<query_id:bigint,offset:int,frames:int,bit_error:double>>")
    return out.select("media_id", F.coalesce("class_id", "media_id").alias("class_id"), "n_frames", F.coalesce("matches", none).alias("matches"))
