"""Mixing sources to target weights by blocks of words.

The texts of a source, laid end to end, are packed into blocks of a fixed number of
words.  The mixture is a row of slots, dealt to output shards; each shard draws from a
multinomial how many of its slots go to each source.  The k-th slot of a source takes
the block at ``permutation(k mod blocks)``, a pseudorandom permutation of the source's
block indices that is anew for every pass over them, so blocks repeat only when all have
been taken.  Slots and blocks are joined by index; nothing is sampled or shuffled whole.

Everything random is a function of the seed and of stable keys: reruns agree.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lean, semi_join, small_side, tidy
from .hashing import mix, mix_int

U64 = np.uint64
#: Words of a block (less in a source of few words), output shards, rounds of the
#: permutation, slots made from one row, rows of a packing bucket and buckets of a shelf.
BLOCK, SHARDS, ROUNDS, RUN, BUCKET, SHELF = 64, 64, 24, 1 << 14, 512, 1024
#: How often a source may be taken.
MOST = 3
WEIGHTS = (5, 2, 1)

WORD = r"[^\x20\x09-\x0D]+"


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Swap-or-not: a pseudorandom permutation of range(n) for every key, elementwise."""
    x, n = index.astype(U64), n.astype(U64)
    for r in range(ROUNDS):
        k = mix(key + U64((2 * r + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        other = (k % n + n - x) % n
        swap = mix(np.maximum(x, other) ^ mix(k)) & U64(1)
        x = np.where(swap == 1, other, x)
    return x.astype(np.int64)


def targets(sizes: dict[str | None, int], weights: tuple = WEIGHTS, most: int = MOST) -> dict[str | None, float]:
    """Words to take of each source: all sizes shared by weight, none above ``most`` times
    its size, the excess reshared by weight.  Sources by code point, null last."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), list(names), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * unit > most * sizes[s]]
        if not full:
            out |= {s: weight[s] * unit for s in open_}
            break
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def shard_counts(slots: list[int], shards: int, seed: int) -> np.ndarray:
    """Slots of every shard (rows) for each source (columns), drawn shard by shard from a
    multinomial over what is left, so the columns add up to ``slots``."""
    random = np.random.default_rng(seed)
    left = np.array(slots, np.int64)
    out = np.zeros((shards, len(slots)), np.int64)
    for i in range(shards):
        size = int(left.sum()) // (shards - i)
        if size:
            draw = np.minimum(random.multinomial(size, left / left.sum()), left)
            while (short := size - int(draw.sum())) > 0:
                room = left - draw
                draw += np.minimum(random.multinomial(short, room / room.sum()), room)
            out[i] = draw
            left -= draw
    return out


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words and tie of every row; a null text has no words.  The
    tie is a hash of all columns, by which rows that share an id are told apart."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), _tie(docs).alias("tie"))


def _tie(docs: DataFrame):
    """Nulls are told apart from the columns beside them by their places."""
    return F.xxhash64(*[F.struct(F.col(f"`{c}`").cast("string").alias("v"), F.lit(i).alias("i")) for i, c in enumerate(docs.columns)])


def pack(rows: DataFrame) -> DataFrame:
    """Adds ``start``: the word of its source at which each row begins.

    Rows are laid in order of a hash bucket, so no source is sorted in one task: sums are
    run over the shelves of a source, over the buckets of a shelf, and over the rows of a
    bucket, and added up.
    """
    buckets = max(1, math.ceil(rows.count() / BUCKET))
    rows = rows.withColumn("bucket", F.pmod("tie", F.lit(buckets))).withColumn("shelf", F.floor(F.col("bucket") / SHELF))
    before = lambda keys, *order: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    run = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    total = cut(rows.groupBy("source", "shelf", "bucket").agg(F.sum("size").alias("total")))
    shelf = total.groupBy("source", "shelf").agg(F.sum("total").alias("total")).select(F.col("source").alias("s"), F.col("shelf").alias("h"), run("total", before(["source"], "shelf")).alias("base"))
    total = total.withColumn("part", run("total", before(["source", "shelf"], "bucket"))).join(shelf, F.col("source").eqNullSafe(F.col("s")) & (F.col("shelf") == F.col("h")))
    base = total.select(F.col("source").alias("s"), F.col("bucket").alias("b"), (F.col("base") + F.col("part")).alias("base"))
    rows = rows.withColumn("inner", run("size", before(["source", "bucket"], "tie", "doc_id")))
    rows = rows.join(base, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    return rows.withColumn("start", F.col("base") + F.col("inner")).drop("s", "b", "base", "inner", "bucket", "shelf")


def plan(docs: DataFrame, seed: int = 7, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """The mixture of ``docs`` (doc_id, source, text).

    Returns the packed rows (doc_id, source, size, tie, start, source_size, target) and the
    pieces (shard, slot, source_no, start, first, words): what each slot takes of the row
    of its source that begins at ``start``, from its word ``first`` on.
    Sources are few: their sizes and the shard counts are held on the driver.
    """
    spark = docs.sparkSession
    rows = cut(pack(cut(sized(docs))))
    sizes = {r["source"]: r["size"] for r in rows.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    goal = targets(sizes)
    names = [s for s in goal if sizes[s]]
    length = {s: max(1, min(BLOCK, sizes[s] // 256)) for s in names}
    blocks = {s: -(-sizes[s] // length[s]) for s in names}
    slots = [min(MOST * blocks[s], round(goal[s] * blocks[s] / sizes[s])) for s in names]
    counts = shard_counts(slots, shards, seed) if names else np.zeros((0, 0), np.int64)
    first = np.cumsum(counts, axis=0) - counts
    no = {s: i for i, s in enumerate(names)}
    facts = [(s, sizes[s], float(goal[s]), no.get(s, -1), length.get(s, 1)) for s in goal]
    facts = spark.createDataFrame(facts, "s string, source_size long, target double, source_no int, length int")
    rows = rows.join(F.broadcast(facts), F.col("source").eqNullSafe(F.col("s"))).drop("s")

    runs = [(i, j, int(first[i, j]), int(counts[i, j]), int(blocks[names[j]]), mix_int(seed * 1000003 + j) - (1 << 63)) for i in range(len(counts)) for j in range(len(names)) if counts[i, j]]
    runs = spark.createDataFrame(runs, "shard int, source_no int, k long, n long, blocks long, key long")
    runs = runs.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))))
    runs = runs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard", "source_no", "run")

    def draw(batches):
        for batch in batches:
            for r in batch.to_pylist():
                k = np.arange(r["k"] + r["run"] * RUN, r["k"] + min(r["n"], (r["run"] + 1) * RUN))
                n = np.full(len(k), r["blocks"], np.int64)
                key = mix(U64(r["key"] + (1 << 63)) + (k // n).astype(U64))
                cells = [np.full(len(k), r["shard"], np.int32), k, np.full(len(k), r["source_no"], np.int32), permute(k % n, n, key)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], names=["shard", "slot", "source_no", "block"])

    drawn = runs.mapInArrow(tidy(draw), "shard int, slot long, source_no int, block long")
    covered = rows.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / F.col("length")), F.floor((F.col("start") + F.col("size") - 1) / F.col("length")))))
    low, high = F.greatest("start", F.col("block") * F.col("length")), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("length"))
    covered = covered.select("source_no", "block", "start", (low - F.col("start")).alias("first"), (high - low).alias("words"))
    # the planner sees how few runs there are, not how many slots they make
    pieces = drawn.hint("merge").join(covered, ["source_no", "block"]).select("shard", "slot", "source_no", "start", "first", "words")
    return rows.drop("length"), pieces


def taken(docs: DataFrame, seed: int = 7) -> DataFrame:
    """What the mix takes of every row of ``docs``: doc_id, source, size, source_size,
    target and taken (words, repeats counted).

    A null source is a source of its own, the last.  Null and empty texts have size 0 and
    nothing is taken of them.  Rows with equal ids are rows of their own; rows that are
    equal in all columns are neighbours in their source.  An empty table gives no rows.
    """
    rows, pieces = plan(docs, seed)
    # a row is known by its source and where it begins there
    sums = pieces.groupBy("source_no", "start").agg(F.sum("words").alias("taken"))
    out = rows.withColumn("key", F.when(F.col("size") > 0, F.col("start"))).join(sums.withColumnRenamed("start", "key"), ["source_no", "key"], "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mixture as documents: for the n-th time that words of a row are taken, a row
    with its other columns and those words as its text (n_chars, if there, follows).

    A text that is taken whole stays as it is; of others the words taken are joined by one
    space.  Rows of which nothing is taken, texts without words among them, are left out.
    Rows that share an id or a text, but not all columns, are rows of their own; of rows
    equal in all columns as many come out as are taken of them together.
    """
    rows, pieces = plan(docs, seed)
    sums = pieces.groupBy("source_no", "start", "first", "words").agg(F.count("*").alias("times"))
    of = rows.filter("size > 0").select("source_no", "start", "tie")
    # rows that are equal share what is taken of any of them
    sums = sums.join(of, ["source_no", "start"]).groupBy("tie", "first", "words").agg(F.sum("times").alias("times"))
    taken_of = sums.groupBy(F.col("tie").alias("_mix_tie")).agg(F.array_sort(F.collect_list(F.struct("first", "words", "times"))).alias("_mix_parts"))
    keyed = docs.withColumn("_mix_tie", _tie(docs))
    repeated = cut(rows.groupBy(F.col("tie").alias("_mix_tie")).count().filter("count > 1").select("_mix_tie"))
    if repeated.take(1):
        once = semi_join(keyed, repeated, "_mix_tie").dropDuplicates(["_mix_tie"])
        keyed = keyed.join(small_side(repeated, 1 << 20), "_mix_tie", "left_anti").unionByName(once)
    keyed = keyed.join(taken_of, "_mix_tie").drop("_mix_tie")
    fields = [f.name for f in docs.schema.fields]
    text_at = fields.index("text")

    def build(batches):
        for batch in batches:
            at, texts = [], []
            for i, (text, parts) in enumerate(zip(batch.column("text").to_pylist(), batch.column("_mix_parts").to_pylist())):
                words = text.encode().split()
                for n in range(1, max(p["times"] for p in parts) + 1):
                    some = [p for p in parts if p["times"] >= n]
                    if sum(p["words"] for p in some) == len(words):
                        texts.append(text)
                    else:
                        texts.append(b" ".join(b" ".join(words[p["first"] : p["first"] + p["words"]]) for p in some).decode())
                    at.append(i)
            columns = [batch.column(f).take(pa.array(at, pa.int64())) for f in fields]
            columns[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=fields)

    out = lean(keyed).mapInArrow(tidy(build), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in fields else out
