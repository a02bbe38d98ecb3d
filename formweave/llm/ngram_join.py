"""N-gram Jaccard self-join by a token-group matrix.

Every text becomes its set of distinct ``k``-word shingles.  Two sets link when
``den * |x & y| >= num * |x | y|``.  The join is exact:

1.  *Candidates.*  If the Jaccard similarity of x and y is at least t, then under any
    common order of the tokens their prefixes of ``n - ceil(t n) + MEET`` tokens share
    MEET tokens; where a set is small, ``+ 1`` and one token.  The order puts rare tokens
    first, by a sketch of fixed size that counts the tokens of all texts, so that passages
    that many texts share are not candidates' meeting points.  Its counters are one byte
    each on a scale of logarithms, so they tell counts apart up to ``2**42``.  The sketch
    only sets the order; what it gets wrong costs time, never a link.
2.  *Groups.*  Sets that meet are partitioned into groups of similar sets: each set
    goes to the smallest centre (the first set of a token) with which it shares MEET
    prefix tokens, and on to that centre's own centre.  The token-group
    matrix holds the union of the members' prefixes of every group.
3.  *Bound.*  A set queries a group only if MEET of its prefix tokens are in the
    group's union by way of other sets.  In a group of several blocks the union of all
    tokens bounds again: tokens of x that no other set of the group has count against
    every pair, so x qualifies only if ``u(x) + min u <= k``, where u counts such
    tokens and k is the largest symmetric difference of a linked pair.
4.  *Open.*  Only qualifying sets are compared with the members of their group, as
    products of 0/1 matrices, and a spanning forest of the links is returned, never all
    pairs.  A group of several blocks is opened in two steps.  First each block is compared
    within itself and with one set of the group, its pivot: n sets, at most n links.  What
    is now in the pivot's component needs no comparison with each other.  Only sets outside
    of it are compared with the whole group, and of that only with the sets whose distance
    to the pivot differs by no more than a link allows (Jaccard distance is a metric).  So
    a family of n near copies costs n rows; m sets outside cost m n / BLOCK_SETS rows at most.

Links become components.  Equal sets are one vertex, so copies cost one row each.

Shingles are 64-bit hashes of word hashes, and a set is identified by 64 bits of its
hash sum; the odds of a collision among N sets are N**2 / 2**65.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashing as H
from .common import as_bytes, cut, lean, relieve, semi_join, small_side, sweep, tidy, written
from .components import components

#: Counters of the order's sketch (one byte each when broadcast) and rows it travels in.
SKETCH, SKETCH_ROWS = 1 << 22, 64
#: Levels of a counter for every doubling.
STEPS = 6
#: Prefix tokens that the prefixes of a linked pair share, unless a set is small.
MEET = 4
#: Times that the way from a set to the centre of its family is doubled.
JUMPS = 3
#: Sets and tokens of a block.
BLOCK_SETS, BLOCK_TOKENS = 256, 1 << 18
#: Shells of distance from a group's pivot.
SHELLS = 32

U64 = np.uint64


def set_id(tokens: np.ndarray) -> int:
    """64-bit identity of a set of tokens (0 for the empty set)."""
    if not len(tokens):
        return 0
    total = int(H.mix(tokens).sum(dtype=U64)) ^ (len(tokens) * 0x9E3779B97F4A7C15)
    return int(np.array(H.mix_int(total) or 1, U64).astype(np.int64))


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, tokens) of each text of a batch."""
    for held in H.chunks(enumerate(as_bytes(batch.column("text")))):
        words, at = H.hash_words([t for _, t in held], lower=True)
        for j, (row, _) in enumerate(held):
            yield row, H.shingles(words[at[j] : at[j + 1]], k)


def _sketch_slots(tokens: np.ndarray, slots: int) -> np.ndarray:
    return (tokens >> U64(13)).astype(np.int64) & (slots - 1)


def _levels(counts: np.ndarray) -> np.ndarray:
    """One byte for each count: STEPS levels for every doubling."""
    return np.minimum(np.round(STEPS * np.log2(1.0 + counts)), 255).astype(np.uint8)


def _add(width: int):
    """Sums of the counts of each part that a task reads, one batch after another."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
                counts = zlib.decompress(counts)
                counts = np.frombuffer(counts, np.uint32 if len(counts) == 4 * width else U64)
                total[part] = total.get(part, np.zeros(width, U64)) + counts
        for part, counts in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([0], pa.int32()), pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())], names=["part", "salt", "counts"])

    return run


def read_sets(docs: DataFrame, k: int, slots: int = SKETCH, carry: tuple[str, ...] = ()) -> tuple[DataFrame, np.ndarray]:
    """What one pass over all texts gives: (doc_id, n_shingles, set_id) and the columns
    ``carry`` of every row, and the levels of the counts of hashed tokens over all texts,
    ``slots`` bytes on the driver whatever the input.

    The counts of a task travel in SKETCH_ROWS parts.  They are summed up in two steps,
    first in as many sums of a part as the root of the shuffle's partitions, so that no task
    reads the counts of all tasks.
    """
    width = slots // SKETCH_ROWS
    fields = [T.StructField(f.name, f.dataType) for f in docs.schema.fields if f.name in carry]  # null in rows of counts
    kinds = [T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("set_id", T.LongType()), *fields, T.StructField("part", T.IntegerType()), T.StructField("salt", T.IntegerType()), T.StructField("counts", T.BinaryType())]
    names = [f.name for f in kinds]

    def build(batches):
        total, seen, at = np.zeros(slots, np.uint32), None, 0
        for batch in batches:
            n, ids = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for row, tokens in _sets(batch, k):
                n[row], ids[row] = len(tokens), set_id(tokens)
                np.add.at(total, _sketch_slots(tokens, slots), 1)
            seen, at = [batch.column(f.name) for f in fields], at + batch.num_rows
            none = [pa.nulls(batch.num_rows, t) for t in (pa.int32(), pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(ids), *seen, *none], names=names)
        if total.any():
            from pyspark import TaskContext

            parts = [zlib.compress(total[i * width : (i + 1) * width].tobytes(), 1) for i in range(SKETCH_ROWS)]
            none = [pa.nulls(SKETCH_ROWS, t) for t in (pa.int64(), pa.int64(), pa.int64(), *[c.type for c in seen])]
            salt = [TaskContext.get().partitionId()] * SKETCH_ROWS
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(SKETCH_ROWS), pa.int32()), pa.array(salt, pa.int32()), pa.array(parts, pa.binary())], names=names)

    made = cut(lean(docs).select("doc_id", "text", *carry).mapInArrow(tidy(build), T.StructType(kinds)))
    salts = math.isqrt(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = made.filter("part IS NOT NULL").select("part", F.pmod("salt", F.lit(max(1, salts))).alias("salt"), "counts")
    for keys in (("part", "salt"), ("part",)):
        counts = counts.repartition(*keys).mapInArrow(tidy(_add(width)), "part int, salt int, counts binary")
    order = np.zeros(slots, np.uint8)
    for r in counts.collect():
        order[r["part"] * width : (r["part"] + 1) * width] = _levels(np.frombuffer(zlib.decompress(bytes(r["counts"])), U64).astype(float))
    return made.filter("part IS NULL").drop("part", "salt", "counts"), order


def prefix_length(n: int, num: int, den: int) -> int:
    """Tokens of a set of n of which a linked set has at least ``need`` in its own prefix."""
    return min(n, n - -(-num * n // den) + (MEET if n >= 2 * MEET else 1))


def need(num: int, den: int):
    """Prefix tokens that a set of ``n`` tokens shares with any set that it links with.

    A linked set has at least ``ceil(n num / den)`` tokens, all of them shared; if that
    makes 2 MEET both prefixes are long enough for MEET, otherwise for one.
    """
    return F.when(F.ceil(F.col("n") * num / F.lit(den)) >= 2 * MEET, MEET).otherwise(1)


def _prefixes(docs: DataFrame, k: int, num: int, den: int, order) -> DataFrame:
    """(token, set_id): the rarest tokens of each set, once for each set and task."""

    def build(batches):
        counts, seen = order.value, set()
        for batch in batches:
            token, ids = [], []
            for _, tokens in _sets(batch, k):
                h = set_id(tokens)
                if h == 0 or h in seen:
                    continue
                if len(seen) >= 1 << 18:
                    seen.clear()
                seen.add(h)
                p = prefix_length(len(tokens), num, den)
                rank = counts[_sketch_slots(tokens, len(counts))]
                # tokens are sorted, so a stable sort by count breaks ties by the token
                first = tokens[np.argsort(rank, kind="stable")[:p]]
                token.append(first.astype(np.int64))
                ids.append(np.full(p, h, np.int64))
            if token:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token)), pa.array(np.concatenate(ids))], names=["token", "set_id"])

    return lean(docs).select("text").mapInArrow(tidy(build), "token long, set_id long")


def _tokens(docs: DataFrame, k: int) -> DataFrame:
    """(set_id, n, tokens): the token set as packed longs."""

    def build(batches):
        for batch in batches:
            ids, n, packed, size = [], [], [], 0
            for _, tokens in _sets(batch, k):
                ids.append(set_id(tokens))
                n.append(len(tokens))
                packed.append(tokens.tobytes())
                size += len(packed[-1])
                if size > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(packed, pa.binary())], names=["set_id", "n", "tokens"])
                    ids, n, packed, size = [], [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(packed, pa.binary())], names=["set_id", "n", "tokens"])

    return lean(docs).select("text").mapInArrow(tidy(build), "set_id long, n long, tokens binary")


class _Block:
    """The token sets of a block and how many tokens any two have in common."""

    def __init__(self, tokens: list[bytes], num: int, den: int, prune: bool):
        sets = [np.frombuffer(t, U64) for t in tokens]
        n = np.array([len(s) for s in sets], np.int64)
        of = np.repeat(np.arange(len(sets)), n)
        union, at, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        # the block's token union: what no other set here has counts against every pair
        alone = np.bincount(of[held[at] == 1], minlength=len(sets))
        self.keep = np.flatnonzero(den * (n - alone) >= num * n) if prune else np.arange(len(sets))
        self.n, self.num, self.den = n[self.keep], num, den
        new = np.full(len(sets), -1)
        new[self.keep] = np.arange(len(self.keep))
        column = np.cumsum(held > 1) - 1
        live = (held[at] > 1) & (new[of] >= 0)
        row, col = new[of[live]], column[at[live]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        self.common = np.zeros((len(self.keep), len(self.keep)), np.float64)
        width = 4096
        for lo in range(0, int(col[-1]) + 1 if len(col) else 0, width):
            a, b = np.searchsorted(col, (lo, lo + width))
            m = np.zeros((len(self.keep), width), np.float32)
            m[row[a:b], col[a:b] - lo] = 1
            self.common += m @ m.T

    def unions(self) -> np.ndarray:
        return self.n[:, None] + self.n[None, :] - self.common

    def linked(self) -> np.ndarray:
        return self.den * self.common >= self.num * self.unions()

    def forest(self, hit: np.ndarray, ids: np.ndarray, known: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Links that join what is not yet joined; sets of equal ``known`` already are."""
        root = list(range(len(ids)))
        if known is not None:
            first: dict[int, int] = {}
            root = [first.setdefault(c, i) for i, c in enumerate(known.tolist())]

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        edges = []
        for x, y in zip(*np.nonzero(np.triu(hit, 1))):
            a, b = find(x), find(y)
            if a != b:
                root[a] = b
                edges.append((ids[x], ids[y]))
        return edges


def _open(num: int, den: int):
    """Compares the queries of a group of one block with its members: a forest of links."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.groupby("set_id", sort=True).agg({"tokens": "first", "query": "max", "member": "max"}).reset_index()
        made = _Block(block["tokens"].tolist(), num, den, True)
        ids, query, member = (block[c].to_numpy()[made.keep] for c in ("set_id", "query", "member"))
        ask = query.astype(bool)[:, None] & member.astype(bool)[None, :]
        return pd.DataFrame(made.forest(made.linked() & (ask | ask.T), ids), columns=["u", "v"], dtype="int64")

    return run


def _near_pivot(num: int, den: int):
    """Compares the sets of a block with each other and with the group's pivot: the links of
    a forest, and for each set (as u) its similarity with the pivot in the group (as v)."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.groupby("set_id", sort=True).agg({"tokens": "first", "group": "first", "pivot": "max"}).reset_index()
        ids, at = block["set_id"].to_numpy(), int(block["pivot"].to_numpy().argmax())
        made = _Block(block["tokens"].tolist(), num, den, False)
        near = made.common[at] / made.unions()[at]
        near[at] = 1.0
        links = pd.DataFrame(made.forest(made.linked(), ids), columns=["u", "v"], dtype="int64").assign(near=np.nan)
        return pd.concat([links, pd.DataFrame({"u": ids, "v": block["group"], "near": near})])

    return run


def _outside(num: int, den: int):
    """Compares the sets outside of the pivot's component that a block asks for with the
    sets that it holds: the links that join two components."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.groupby("set_id", sort=True).agg({"tokens": "first", "component": "first", "ask": "max", "held": "max"}).reset_index()
        made = _Block(block["tokens"].tolist(), num, den, True)
        ids, known, ask, held = (block[c].to_numpy()[made.keep] for c in ("set_id", "component", "ask", "held"))
        pair = ask.astype(bool)[:, None] & held.astype(bool)[None, :]
        return pd.DataFrame(made.forest(made.linked() & (pair | pair.T), ids, known), columns=["u", "v"], dtype="int64")

    return run


def links(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, slots: int = SKETCH) -> DataFrame:
    """Edges (u, v) between set ids: a subset of all links with the same components.

    ``docs`` (doc_id, text): rows without an id, and texts without words, link with
    nothing; equal sets are one vertex; an empty table gives no edges.
    """
    docs = docs.filter("doc_id IS NOT NULL")
    return _links(docs, *read_sets(docs, k, slots), k, num, den)


def _links(docs: DataFrame, sets: DataFrame, levels: np.ndarray, k: int, num: int, den: int) -> DataFrame:
    spark = docs.sparkSession
    order = spark.sparkContext.broadcast(levels)
    prefixes, drop = written(_prefixes(docs, k, num, den, order), "prefixes")
    order.destroy()
    relieve(spark)  # the joins that follow need what hashing has left behind
    # copies of a set in several tasks meet here as one; min and max need no list of members
    meeting = prefixes.groupBy("token").agg(F.min("set_id").alias("centre"), F.max("set_id").alias("other")).filter("centre <> other").select("token", "centre")
    met = cut(prefixes.join(meeting, "token").distinct())
    drop()
    del prefixes, meeting
    relieve(spark)
    # sets that meet too few tokens in all link with nothing
    enough = met.groupBy("set_id").agg(F.count("*").alias("tokens")).join(sets.filter("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n")), "set_id")
    facts = cut(enough.filter(F.col("tokens") >= need(num, den)).select("set_id", "doc_id", "n"))
    met = met.join(facts.select("set_id"), "set_id", "left_semi")

    group = _groups(met)
    # token-group matrix: the rarest tokens of a group's members, and whether one set alone has them
    matrix = met.join(group, "set_id").groupBy("token", "group").agg(F.min("set_id").alias("one"), F.max("set_id").alias("two"))
    shared = met.join(matrix, "token").filter("one <> two or one <> set_id").groupBy("set_id", "group").agg(F.count("*").alias("shared"))
    ask = shared.join(facts, "set_id").filter(F.col("shared") >= need(num, den))
    ask = cut(ask.select("set_id", "group", "n", "doc_id"))
    ask, group = _merged(ask, group)
    # a link is asked from both of its ends, so a member that asks nothing has none
    member = ask.select("set_id", "n", "doc_id").distinct().join(group, "set_id").withColumn("member", F.lit(True))
    roles = ask.withColumn("query", F.lit(True)).join(member, ["set_id", "group", "n", "doc_id"], "full")
    roles = cut(_blocks(roles.withColumn("member", F.coalesce("member", F.lit(False))).withColumn("query", F.coalesce("query", F.lit(False)))))

    del met, group, matrix, shared, ask, member, enough, facts
    sweep(spark)
    tokens, drop = written(_tokens(semi_join(docs, roles.select("doc_id").distinct(), "doc_id"), k).drop("n"), "sets")
    roles = roles.drop("doc_id")
    units = roles.filter("blocks = 1").groupBy("set_id", "group").agg(F.max("query").alias("query"), F.max("member").alias("member"))
    edges = _with_tokens(units, tokens).groupBy("group").applyInPandas(_open(num, den), "u long, v long")
    large = roles.filter("blocks > 1")
    if large.take(1):
        edges = edges.unionByName(_large(large, tokens, num, den))
    edges = cut(edges)
    drop()
    del tokens, roles, units, large
    sweep(spark)
    return edges


def _with_tokens(units: DataFrame, tokens: DataFrame) -> DataFrame:
    """``units`` with the tokens of their sets; while they are few, without a shuffle."""
    return tokens.join(small_side(cut(units), 1 << 18), "set_id")


def _large(roles: DataFrame, tokens: DataFrame, num: int, den: int) -> DataFrame:
    """Links of the groups of several blocks, in the two steps of the module's docstring."""
    roles = _bounded(roles, tokens, num, den).groupBy("set_id", "group").agg(F.max("blocks").alias("blocks"), F.max("n").alias("n"))
    roles = cut(roles)
    pivot = roles.groupBy("group").agg(F.min(F.struct(F.col("set_id") != F.col("group"), "set_id"))["set_id"].alias("set_id"), F.max("blocks").cast("int").alias("blocks"))
    mine = roles.select("set_id", "group", F.pmod(F.xxhash64("set_id"), "blocks").cast("int").alias("i"), F.lit(False).alias("pivot"))
    copies = pivot.select("set_id", "group", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.lit(True).alias("pivot"))
    units = mine.unionByName(copies).groupBy("set_id", "group", "i").agg(F.max("pivot").alias("pivot"))
    found = cut(_with_tokens(units, tokens).groupBy("group", "i").applyInPandas(_near_pivot(num, den), "u long, v long, near double"))
    edges = found.filter("near IS NULL OR isnan(near)").select("u", "v")
    del units, mine, copies
    label = components(edges).withColumnRenamed("u", "set_id")
    known = found.filter("near IS NOT NULL AND NOT isnan(near)").groupBy(F.col("u").alias("set_id"), F.col("v").alias("group")).agg(F.max("near").alias("near"))
    known = known.join(label, "set_id", "left").withColumn("component", F.coalesce("component", "set_id")).join(roles.select("set_id", "group", "n"), ["set_id", "group"])
    main = pivot.select("set_id", "group").join(label, "set_id", "left").select("group", F.coalesce("component", "set_id").alias("main"))
    sweep(tokens.sparkSession)
    known = cut(known.join(main, "group").withColumns({"out": F.col("component") != F.col("main"), "shell": F.floor(F.col("near") * SHELLS).cast("int")}))

    def dealt(rows: DataFrame, shell: str, count: str) -> DataFrame:
        size = rows.groupBy("group", "shell").agg(F.count("*").alias("sets"), F.sum("n").alias("held"))
        return size.select("group", F.col("shell").alias(shell), F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("held") / BLOCK_TOKENS)).cast("int").alias(count))

    asking, holding = dealt(known.filter("out"), "a", "asks"), dealt(known, "b", "holds")
    # sets of two shells can't link if the shells are further apart than a link's distance
    apart = (F.abs(F.col("a") - F.col("b")) - 1) * den <= SHELLS * (den - num)
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    pairs = cut(asking.join(holding, "group").filter(apart).withColumn("i", every("asks")).withColumn("j", every("holds")))
    place = lambda c: F.pmod(F.xxhash64("set_id"), c).cast("int")
    rows = known.select("set_id", "group", "shell", "component", "out")
    on = lambda shell, count, at: (rows["group"] == pairs["group"]) & (rows["shell"] == pairs[shell]) & (place(pairs[count]) == pairs[at])
    unit = [rows["set_id"], rows["group"], "a", "i", "b", "j", rows["component"]]
    asks = rows.filter("out").join(pairs, on("a", "asks", "i")).select(*unit, F.lit(True).alias("ask"), F.lit(False).alias("held"))
    holds = rows.join(pairs, on("b", "holds", "j")).select(*unit, F.lit(False).alias("ask"), F.lit(True).alias("held"))
    across = _with_tokens(asks.unionByName(holds), tokens).groupBy("group", "a", "i", "b", "j").applyInPandas(_outside(num, den), "u long, v long")
    return edges.unionByName(across)


def _groups(met: DataFrame) -> DataFrame:
    """(set_id, group): every set goes to the smallest centre with which it shares MEET
    tokens, and on to that centre's own centre, so that a family is one group and not one
    for each of its edits.  A centre is never larger than the set, so this ends."""
    near = met.groupBy("set_id", "centre").count().filter(F.col("count") >= MEET).groupBy("set_id").agg(F.min("centre").alias("centre"))
    group = cut(met.select("set_id").distinct().join(near, "set_id", "left").select("set_id", F.coalesce("centre", "set_id").alias("group")))
    for _ in range(JUMPS):
        up = group.select(F.col("set_id").alias("group"), F.col("group").alias("above"))
        group = cut(group.join(up, "group", "left").select("set_id", F.coalesce("above", "group").alias("group")))
    return group


def _merged(ask: DataFrame, group: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups whose centre asks a smaller group become one with it; who asks a part asks
    the whole.  Otherwise every set of a large family would ask each of its groups."""
    up = ask.select(F.col("set_id").alias("group"), F.col("group").alias("asked")).groupBy("group").agg(F.min("asked").alias("above"))
    up = group.select("group").distinct().join(up, "group", "left").select("group", F.least("group", F.coalesce("above", "group")).alias("above"))
    for _ in range(2):
        next_ = up.select(F.col("group").alias("above"), F.col("above").alias("higher"))
        up = cut(up.join(next_, "above", "left").select("group", F.coalesce("higher", "above").alias("above")))
    ask = ask.join(up, "group").drop("group").withColumnRenamed("above", "group").distinct()
    return cut(ask), group.join(up, "group").select("set_id", F.col("above").alias("group"))


def _blocks(roles: DataFrame) -> DataFrame:
    """``roles`` with the number of blocks of each group; a single set has nothing to open."""
    size = roles.groupBy("group").agg(F.count("*").alias("sets"), F.sum("n").alias("held")).filter("sets > 1")
    size = size.select("group", F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("held") / BLOCK_TOKENS)).alias("blocks"))
    return roles.join(size, "group")


def _bounded(roles: DataFrame, tokens: DataFrame, num: int, den: int) -> DataFrame:
    """Of groups of several blocks, the sets that qualify.

    u(x) counts the tokens that no other set of the group holds.  A linked pair has
    ``|x ^ y| <= (n_x + n_y) (den - num) / (den + num)`` and ``n_y <= n_x den / num``, and
    at least ``u(x) + u(y)`` tokens differ.  The blocks are dealt anew for what is left.
    """

    def spread(batches):
        for batch in batches:
            for row in batch.to_pylist():
                token = np.frombuffer(row["tokens"], U64)
                part = token % U64(row["parts"])
                order = np.argsort(part, kind="stable")
                at = np.searchsorted(part[order], np.arange(row["parts"] + 1, dtype=U64))
                packed = [token[order[lo:hi]].tobytes() for lo, hi in zip(at, at[1:])]
                n = row["parts"]
                yield pa.RecordBatch.from_arrays([pa.array([row["group"]] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([row["set_id"]] * n, pa.int64()), pa.array(packed, pa.binary())], names=["group", "part", "set_id", "tokens"])

    def count(part: pd.DataFrame) -> pd.DataFrame:
        of = np.repeat(np.arange(len(part)), [len(t) // 8 for t in part["tokens"]])
        _, first, held = np.unique(np.frombuffer(b"".join(part["tokens"]), U64), return_index=True, return_counts=True)
        alone = np.bincount(of[first[held == 1]], minlength=len(part))
        return pd.DataFrame({"group": part["group"], "set_id": part["set_id"], "alone": alone})

    parts = roles.groupBy("group").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).alias("parts"))
    # only the sets of these groups meet their tokens; while they are few, without a shuffle
    wanted = cut(roles.select("set_id", "group").join(parts, "group"))
    held = tokens.join(small_side(wanted, 1 << 18), "set_id").select("group", "set_id", "parts", "tokens").mapInArrow(tidy(spread), "group long, part int, set_id long, tokens binary")
    alone = held.groupBy("group", "part").applyInPandas(count, "group long, set_id long, alone long")
    alone = alone.groupBy("group", "set_id").agg(F.sum("alone").alias("alone"))
    rows = cut(roles.drop("blocks").join(alone, ["group", "set_id"], "left").withColumn("alone", F.coalesce("alone", F.lit(0))))
    least = rows.groupBy("group").agg(F.min("alone").alias("least"))
    most = (F.col("n") + F.floor(F.col("n") * den / num)) * (den - num) / F.lit(den + num)
    rows = rows.join(least, "group").filter((F.col("alone") + F.col("least") <= most) & (den * (F.col("n") - F.col("alone")) >= num * F.col("n")))
    return _blocks(rows.drop("alone", "least"))


def ngram_join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, slots: int = SKETCH) -> DataFrame:
    """Near-duplicate classes of ``docs`` (doc_id, text; other columns are ignored).

    Returns one row for each input row: doc_id, n_shingles (size of its set) and
    component_id, the smallest doc_id reachable by links, its own included.

    Null and empty texts, and texts without words, have an empty set and link with
    nothing.  A text with fewer than k words is one shingle.  Repeated rows give
    repeated rows; rows that share an id but not a text are rows of their own, each in
    the class of its text.  A row without doc_id has its set's size and a null
    component_id; it links nothing.  An empty table gives no rows.
    """
    return classes(docs, k, num, den, slots).select("doc_id", "n_shingles", "component_id")


def classes(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, slots: int = SKETCH, carry: tuple[str, ...] = ()) -> DataFrame:
    """As ``ngram_join``, with class_key and the columns ``carry`` of ``docs``: rows are
    of one class if they have the same class_key.  It is null where nothing links."""
    sets, levels = read_sets(docs, k, slots, carry)
    known = sets.filter("doc_id IS NOT NULL")
    found = components(_links(docs.filter("doc_id IS NOT NULL"), known, levels, k, num, den))
    # a component's label is a set; its smallest doc_id is what is asked for
    least = known.filter("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    label = cut(least.join(found.withColumnRenamed("u", "set_id"), "set_id", "left").withColumn("class_key", F.coalesce("component", "set_id")))
    smallest = label.groupBy("class_key").agg(F.min("least").alias("component_id"))
    label = label.join(smallest, "class_key").select("set_id", "class_key", "component_id")
    links_ = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    out = sets.join(label, "set_id", "left")
    component = F.when(links_, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.when(links_, F.col("class_key")).alias("class_key"), *carry)
