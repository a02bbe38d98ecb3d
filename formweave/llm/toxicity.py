"""Toxicity by compression distance.

zstandard dictionaries are trained on windows of toxic texts and, apart from these, on
windows of ordinary texts.  A text goes in windows through two compressors: one has the
ordinary dictionary's content, the other has the toxic dictionary's content in front of
the same.  A toxic text is ordinary for the most part, so ordinary words are as short
under either, and what only toxic texts repeat sets the two lengths apart.  For the same
reason the toxic dictionary is trained on those pieces of toxic texts that the ordinary
compressor leaves longest: what it compresses well tells nothing.

There are two such pairs.  Beside a long ordinary dictionary hardly any ordinary piece is
shorter under the toxic compressor, beside a short one rare toxic pieces still are.  The
differences over the windows of a text are summed up in a few numbers, and a logistic
curve turns these into a score whose threshold is 0.5.  It is calibrated on whole texts
of documents that no dictionary was trained on.

Of a trained dictionary the content is used and not the tables of code lengths: windows
are so short that the tables would level out the few bytes that matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, lean, small_side, tidy
from .compression import compressor, lengths, normal, windows

#: Bounds of what is learned from: labelled documents of a class, and windows of such a
#: document (evenly from its begin to its end) with the bytes of each.  One document of
#: CALIBRATE calibrates the curve; the dictionaries are trained on the others.
SAMPLES, PLACES, SAMPLE, CALIBRATE = 4096, 64, 64, 3
#: Pairs of dictionaries: bytes of the ordinary and of the toxic content, and the matches
#: that training weighs in toxic pieces.
PAIRS = ((1 << 20, 1 << 13, 6), (1 << 17, 1 << 13, 8))
#: Bytes of segments and of matches that training weighs; bytes of a piece of toxic text,
#: the share of pieces that the toxic dictionary is trained on, and the most of them.
ORDINARY_SEGMENT, ORDINARY_MATCH, TOXIC_SEGMENT = 256, 8, 16
PIECE, HARD, PIECES = 8, 0.3, 1 << 18
#: Bytes of the windows (a text is cut in both ways) and zstandard level.
WINDOWS, LEVEL = (64, 32), 5
#: Numbers that sum up the windows of one width under one pair.
NUMBERS = 6


@dataclass(frozen=True)
class Model:
    """Contents of the ordinary and the toxic side of every pair, and the curve over
    standardised numbers.  Without pairs nothing is evidence."""

    pairs: tuple[tuple[bytes, bytes], ...]
    centre: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float


def gains(parts: list[bytes], plain: zstandard.ZstdCompressor, toxic: zstandard.ZstdCompressor) -> np.ndarray:
    """Bytes that each window is shorter under the toxic compressor."""
    return (lengths(parts, plain) - lengths(parts, toxic)).astype(float)


def _numbers(text: str, pairs) -> list[float]:
    """The sums of a whole text: for each pair and width NUMBERS of them, 0 without a window."""
    data, out = normal(text), []
    cuts = [windows(data, width) for width in WINDOWS]
    for plain, toxic in pairs:
        for parts in cuts:
            gain = np.sort(gains(parts, plain, toxic))[::-1]
            n = len(gain)
            out += [gain.mean(), gain.sum() / n**0.5, gain[0], gain[: max(1, n // 8)].mean(), (gain >= 3).mean(), np.maximum(gain - 1, 0).sum() / n] if n else [0.0] * NUMBERS
    return out


def _train(samples: list[bytes], size: int, segment: int, match: int) -> bytes:
    """Content of a dictionary trained on ``samples``; samples that are too few to train
    are the content themselves."""
    try:
        made = zstandard.train_dictionary(size, samples, k=segment, d=match).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[:size] or b" " * PIECE
    held = b"\0".join(samples)
    # the content begins where bytes of the samples do; the tables before it are no text
    return made[next(i for i in range(8, len(made)) if made[i : i + match] in held) :]


def dictionaries(bad: list[bytes], good: list[bytes]) -> tuple[tuple[bytes, bytes], ...]:
    """The contents of every pair, trained on windows of toxic and of ordinary texts."""
    pieces = [p for w in bad for p in windows(w, PIECE)]
    pieces = pieces[:: -(-len(pieces) // PIECES)]
    out = []
    for size, toxic_size, match in PAIRS:
        ordinary = _train(good, size, ORDINARY_SEGMENT, ORDINARY_MATCH)
        left = lengths(pieces, compressor(ordinary, LEVEL))
        hard = [p for p, n in zip(pieces, left >= np.quantile(left, 1 - HARD)) if n]
        out.append((ordinary, _train(hard, toxic_size, TOXIC_SEGMENT, match) + ordinary))
    return tuple(out)


def compressors(model: Model) -> list[tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]]:
    """The ordinary and the toxic compressor of every pair."""
    return [tuple(compressor(d, LEVEL) for d in pair) for pair in model.pairs]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights and bias (last) of a weighted logistic regression, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (weight * (y - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _flat(share: float) -> Model:
    """A model without evidence: every score is ``share``."""
    return Model((), (), (), (), float(np.clip(np.log(max(share, 1e-6) / max(1 - share, 1e-6)), -13, 13)))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from ``docs`` (doc_id, text) as marked by ``labels`` (doc_id, toxic 0 or 1).

    The labelled documents of each class with the least hash in each of SAMPLES buckets
    are taken, so reruns agree.  Of rows that share an id one teaches, the one whose text
    has the least hash.  A document marked twice counts as toxic if once so.  Null labels,
    null texts and labels of absent documents teach nothing.  With one class or none,
    every score is that class's share (0.5 without labels).

    The driver receives at most PLACES windows of SAMPLE bytes of each document taken for
    the dictionaries, and a few numbers of each taken for the curve.
    """
    marks = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).withColumn("h", F.xxhash64("doc_id"))
    shares = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    share = shares.get(1, 0) / sum(shares.values()) if shares else 0.5
    chosen = marks.groupBy("toxic", F.pmod("h", F.lit(SAMPLES)).alias("bucket")).agg(F.min_by("doc_id", "h").alias("doc_id"))
    chosen = cut(chosen.select("doc_id", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit("curve")), F.lit(CALIBRATE)) == 0).alias("curve")))
    texts = docs.select("doc_id", "text").filter("text IS NOT NULL").join(small_side(chosen, 2 * SAMPLES), "doc_id").withColumn("h", F.xxhash64("text"))

    def pieces(batches):
        for batch in batches:
            out = []
            for text in as_bytes(batch.column("text")):
                parts = windows(normal(text.decode()), SAMPLE)
                step = max(1, -(-len(parts) // PLACES))
                out.append(b"\0".join(parts[::step]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "toxic", "h")), pa.array(out, pa.binary())], names=["doc_id", "toxic", "h", "found"])

    one = lambda rows: rows.groupBy("doc_id", "toxic").agg(F.min_by("found", "h").alias("found")).collect()
    taught = one(lean(texts.filter("NOT curve").drop("curve")).mapInArrow(tidy(pieces), "doc_id long, toxic int, h long, found binary"))
    taught = [[p for r in sorted(taught) if r["toxic"] == t for p in bytes(r["found"]).split(b"\0") if p] for t in (0, 1)]
    if not taught[0] or not taught[1]:
        return _flat(share)
    pairs = dictionaries(taught[1], taught[0])
    sent = docs.sparkSession.sparkContext.broadcast(Model(pairs, (), (), (), 0.0))

    def numbers(batches):
        tools = compressors(sent.value)
        for batch in batches:
            x = [_numbers(t.decode(), tools) for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "toxic", "h")), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "toxic", "h", "found"])

    rows = one(lean(texts.filter("curve").drop("curve")).mapInArrow(tidy(numbers), "doc_id long, toxic int, h long, found array<double>"))
    sent.destroy()
    rows.sort()
    y = np.array([float(r["toxic"]) for r in rows])
    if len(set(y)) < 2:
        return _flat(share)
    x = np.array([r["found"] for r in rows])
    weight = np.where(y == 1, shares[1] / (y == 1).sum(), shares[0] / (y == 0).sum())
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    w = _logistic((x - centre) / scale, y, weight / weight.mean())
    return Model(pairs, tuple(centre), tuple(scale), tuple(w[:-1]), float(w[-1]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1, higher: likelier toxic) of every row of ``docs``.

    Whole texts are scored; a null or empty text has no window and gets the score of a
    text without evidence.  Rows without an id are scored too.  Repeated rows repeat;
    other columns are ignored; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def build(batches):
        m = sent.value
        tools = compressors(m)
        for batch in batches:
            x = np.array([_numbers(t.decode(), tools) for t in as_bytes(batch.column("text"))]).reshape(batch.num_rows, len(m.centre))
            z = ((x - m.centre) / m.scale) @ np.array(m.weights) + m.bias
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["doc_id", "score"])

    return lean(docs).select("doc_id", "text").mapInArrow(tidy(build), "doc_id long, score double")
