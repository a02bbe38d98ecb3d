"""Language identification by compression.

Each language has a raw-content dictionary: samples of its text.  A text goes, in
windows over its whole length, through a compressor for every language; the language
whose dictionary leaves the fewest bytes is chosen, and the choice is rejected when
the runner-up is nearly as short.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, cut, lean, small_side, tidy
from .compression import compressor, lengths, normal, spread, windows

#: Bounds of what is learned from: samples of a language, bytes that one sample sends (of
#: its whole normalised text, from PLACES places), bytes of a dictionary, and bytes of all
#: dictionaries together, which they share evenly when languages are many.
SAMPLES, SENT, DICTIONARY, TOTAL = 128, 1 << 13, 1 << 16, 1 << 23
#: Places of a text, from its begin to its end, that a sample is taken from.
PLACES = 16
#: Bytes of a window, zstandard level, and the smallest margin as a share of the best
#: length that is accepted.
WINDOW, LEVEL, MARGIN = 1024, 7, 0.01

UNKNOWN = "und"


def fit(docs: DataFrame) -> dict[str, bytes]:
    """Dictionaries by language from ``docs`` (doc_id, text, lang).

    Rows with a null language, or a text that is null or has no letter, teach nothing.
    Of each language the rows with the least hash in each of SAMPLES buckets are taken,
    so any number of rows gives a sample of bounded size and reruns agree; rows that
    repeat teach once.  Every value of ``lang`` is learned: with many of them the
    dictionaries are smaller.  An empty table gives no languages.
    """
    taught = docs.filter("lang IS NOT NULL AND text RLIKE '\\\\p{L}'").select("lang", "text", F.xxhash64("doc_id", "lang", "text").alias("h"))
    chosen = taught.groupBy("lang", F.pmod("h", F.lit(SAMPLES)).alias("bucket")).agg(F.min("h").alias("h")).select("lang", "h")
    chosen = cut(chosen)
    languages = chosen.select("lang").distinct().count()
    size = max(256, min(DICTIONARY, TOTAL // max(1, languages)))

    def sample(batches):
        for batch in batches:
            parts = [spread(normal(t.decode()), SENT, PLACES) for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), pa.array(parts, pa.binary())], names=["lang", "h", "part"])

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        parts = rows.sort_by("h").column("part").to_pylist()
        share = max(64, size // len(parts))
        content = b" ".join(spread(p, share, min(PLACES, max(2, share // 64))) for p in parts)[:size]
        # a dictionary has 8 bytes at least, so the language of one short word is learned, too
        return pa.table({"lang": [key[0].as_py()], "content": pa.array([content.ljust(8)], pa.binary())})

    rows = lean(taught.join(small_side(chosen, 1 << 18), ["lang", "h"]).select("lang", "text", "h")).mapInArrow(tidy(sample), "lang string, h long, part binary")
    rows = rows.groupBy("lang", "h").agg(F.first("part").alias("part")).groupBy("lang").applyInArrow(build, "lang string, content binary")
    return {r["lang"]: bytes(r["content"]) for r in rows.collect()}


def classify(docs: DataFrame, model: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """All columns of ``docs`` with lang_pred, score (0 to 1) and accepted.

    ``score`` is the share of the best language when a language weighs 2 to the minus
    the bytes that it takes; ``accepted`` is false for a margin under ``margin`` and for
    ``und``.  lang_pred is ``und``, at score 0, if the text is null or has no letter, or
    no language was learned.  Columns of those names are replaced.  Ties go to the first
    language by name, and are not accepted when there are two languages or more.  Repeated
    rows repeat; rows without an id are classified too; an empty table gives no rows.
    """
    names = sorted(model)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score", "accepted")
    fields = [f.name for f in docs.schema.fields]

    def build(batches):
        tools = [compressor(sent.value[k], LEVEL) for k in names]
        for batch in batches:
            pred, score, accepted = [], [], []
            for text in as_bytes(batch.column("text")):
                text = text.decode()
                if not names or not any(map(str.isalpha, text)):
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    accepted.append(False)
                    continue
                parts = windows(normal(text), WINDOW)
                size = np.array([lengths(parts, t).sum() for t in tools])
                best = int(size.argmin())
                rest = np.delete(size, best)
                pred.append(names[best])
                score.append(float(1 / np.exp2(-(np.minimum(size - size[best], 1000)).astype(float)).sum()))
                accepted.append(bool(len(rest) == 0 or rest.min() - size[best] > margin * size[best]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())], names=[*fields, "lang_pred", "score", "accepted"])

    schema = T.StructType(list(docs.schema.fields)).add("lang_pred", "string").add("score", "double").add("accepted", "boolean")
    return lean(docs).mapInArrow(tidy(build), schema)
