"""Merkle manifest of a dataset: a tree over the rows of every source, a tree over those.

Leaves are dealt to ranges of their order, and a count of every range says at which index of
its tree each begins.  A range then goes through a *mountain range*: a stack with, for every
level, the nodes that wait for their parent.  The FANOUT-th node of a run carries, as adding
one carries in a number of that base, and so does the last node of a tree, whose run may be
short: the run becomes a node of the level above, which may carry in turn.  Nothing is padded.

A range seldom begins or ends with a run.  Nodes whose run reaches into other ranges (the
peaks that are left, and what comes before the first whole run) are merged by Spark, level by
level: there are a few of them for each range and level, however many leaves there are.

The way from a node to the root is joined downwards, run by run, so each leaf meets what its
run shares once.  Digests are lowercase hex text throughout.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, small_side, tidy

#: Children of a node: an index is cut by so many bits a level.
BITS = 4
FANOUT = 1 << BITS
HEX = 64
LEAF, NODE, OPEN = 0, 1, 2
STEPS = "array<struct<kids:string,at:int>>"


def digest_of(columns: list[Column]) -> Column:
    """Digest of a row: of each column its bytes in UTF-8, a colon and its value, and a
    hyphen for a null.  Integers are decimal."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text]), 256)


def tree_key(source: Column) -> Column:
    """A name of a source that is never null and sorts as sources do, null first."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), source.cast("string")))


class Range:
    """The mountain range of consecutive leaves of one tree, from index ``first`` on."""

    def __init__(self, tree: str, first: int, total: int, emit: Callable):
        self.tree, self.next, self.total, self.emit = tree, first, total, emit
        self.waiting: list[tuple[int, list[str]]] = []  # by level: first index, digests

    def add(self, digest: str) -> None:
        """The next leaf, and all carries that it causes."""
        level, node = 0, self.next
        self.next += 1
        while True:
            last = (self.total - 1) >> (BITS * level)
            if last == 0:  # the root of its tree
                return
            if level == len(self.waiting):
                self.waiting.append((node, []))
            begin, held = self.waiting[level]
            if not held:
                begin = node
                self.waiting[level] = (begin, held)
            held.append(digest)
            if node & (FANOUT - 1) != FANOUT - 1 and node != last:
                return
            run = node & ~(FANOUT - 1)
            whole = begin == run
            if not whole:  # an earlier range has the begin of this run
                self.open(level)
                return
            kids = "".join(held)
            digest = hashlib.sha256(kids.encode()).hexdigest()
            self.waiting[level] = (node + 1, [])
            level, node = level + 1, node >> BITS
            self.emit(NODE, self.tree, level, node, digest, kids, self.total)

    def open(self, level: int) -> None:
        begin, held = self.waiting[level]
        for i, d in enumerate(held):
            self.emit(OPEN, self.tree, level, begin + i, d, None, self.total)
        self.waiting[level] = (begin + len(held), [])

    def close(self) -> None:
        """Peaks that are left belong to runs that go on in later ranges."""
        for level in range(len(self.waiting)):
            self.open(level)


@dataclass
class Forest:
    """Trees as they are written: ``table`` (kind, tree, level, node, digest, kids, total and
    the columns of leaves), ``merged`` by level, and levels above the leaves."""

    table: DataFrame
    merged: list[DataFrame]
    levels: int

    def leaves(self) -> DataFrame:
        return self.table.filter(F.col("kind") == LEAF)

    def nodes(self, level: int) -> DataFrame:
        """tree, node, digest, kids and total of all nodes of a level from 1 on."""
        names = ["tree", "node", "digest", "kids", "total"]
        own = self.table.filter((F.col("kind") == NODE) & (F.col("level") == level)).select(*names)
        return own.unionByName(self.merged[level - 1].select(*names))

    def roots(self) -> DataFrame:
        """tree, digest of every tree; a lone leaf is its root."""
        out = self.leaves().filter("total = 1").select("tree", "digest")
        for level in range(1, self.levels + 1):
            out = out.unionByName(self.nodes(level).filter(_is_root(level)).select("tree", "digest"))
        return out


def _is_root(level: int) -> Column:
    return F.shiftright(F.col("total") - 1, BITS * level) == 0


def grow(leaves: DataFrame, order: list[str], keep: list[str]) -> Forest:
    """Trees of ``leaves`` (tree, digest, the columns of ``order`` and ``keep``).

    Leaves of a tree are in ``order``; those that are equal in it follow one another as they
    come, so they must not differ in their digests.  Rows are dealt by tree, order and place,
    so neither a large tree nor many equal rows are one task's.  No leaves, no trees.
    """
    spark = leaves.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = ["tree", *order, "place"]
    placed = leaves.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(parts, *by).sortWithinPartitions(*by)
    placed = cut(placed.withColumn("part", F.spark_partition_id()))
    within = Window.partitionBy("tree")
    ranges = placed.groupBy("tree", "part").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(within.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ranges = cut(ranges.select("tree", "part", F.coalesce(before, F.lit(0)).alias("first"), F.sum("rows").over(within).alias("total")))
    most = ranges.agg(F.max("total")).first()[0] or 1
    levels = -(-(most - 1).bit_length() // BITS)
    # a range is in one task either way, and in order again
    rows = placed.join(small_side(ranges, 1 << 17), ["tree", "part"]).sortWithinPartitions("tree", "part", *order, "place")
    rows = rows.select("tree", "part", "first", "total", "digest", *keep)
    kept = [f for f in rows.schema.fields if f.name in keep]
    schema = T._parse_datatype_string("kind int, tree string, level int, node long, digest string, kids string, total long")
    schema = T.StructType(schema.fields + [T.StructField(f.name, f.dataType) for f in kept])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records: list[tuple] = []
        emit = lambda *cells: records.append(cells)
        at, now = None, None
        types = None

        def flush() -> pa.RecordBatch:
            cells = list(zip(*records))
            columns = [pa.array(c, t) for c, t in zip(cells, (pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64()))]
            columns += [pa.nulls(len(records), t) for t in types]
            records.clear()
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            types = [batch.column(f.name).type for f in kept]
            n, own = batch.num_rows, []
            columns = [batch.column(c).to_pylist() for c in ("tree", "part", "first", "total", "digest")]
            for tree, part, first, total, digest in zip(*columns):
                if at != (tree, part):
                    if now:
                        now.close()
                    at, now = (tree, part), Range(tree, first, total, emit)
                own.append(now.next)
                now.add(digest)
            fixed = [pa.array([LEAF] * n, pa.int32()), batch.column("tree"), pa.array([0] * n, pa.int32()), pa.array(own, pa.int64()), batch.column("digest"), pa.nulls(n, pa.string()), batch.column("total")]
            yield pa.RecordBatch.from_arrays([*fixed, *[batch.column(f.name) for f in kept]], names=schema.names)
            if records:
                yield flush()
        if now:
            now.close()
            if records:
                yield flush()

    table = cut(rows.mapInArrow(tidy(build), schema))
    merged: list[DataFrame] = []
    for level in range(levels):
        open_ = table.filter((F.col("kind") == OPEN) & (F.col("level") == level)).select("tree", "node", "digest", "total")
        if merged:
            open_ = open_.unionByName(merged[-1].filter(~_is_root(level)).select("tree", "node", "digest", "total"))
        run = open_.groupBy("tree", F.shiftright("node", BITS).alias("node"), "total").agg(F.array_sort(F.collect_list(F.struct("node", "digest"))).alias("run"))
        kids = F.array_join(F.col("run")["digest"], "")
        merged.append(cut(run.select("tree", "node", "total", kids.alias("kids"), F.sha2(kids, 256).alias("digest"))))
    return Forest(table, merged, levels)


def proofs(forest: Forest, keep: list[str], rest: DataFrame | None = None) -> DataFrame:
    """Every leaf with its way up: the columns of ``keep``, digest, subroot (of its tree),
    root and steps (kids: digests of the run, at: the own place in it), from the leaf on.

    ``rest`` (tree, steps, root) is the way of each tree on from its root; without it the
    root is that of the tree.
    """

    def ended(tops: DataFrame) -> DataFrame:
        """Roots of trees, which go on with the way of their tree."""
        if rest is None:
            return tops.withColumns({"steps": F.array().cast(STEPS), "root": F.col("digest")})
        return tops.join(rest, "tree")

    names = ["tree", "node", "kids", "steps", F.col("digest").alias("subroot"), "root"]
    above = None
    for level in range(forest.levels, 0, -1):
        here = forest.nodes(level)
        out = ended(here.filter(_is_root(level))).select(*names)
        if above is not None:
            up = above.select("tree", F.col("node").alias("up"), F.col("kids").alias("up_kids"), F.col("steps").alias("up_steps"), "subroot", "root")
            below = here.filter(~_is_root(level)).withColumn("up", F.shiftright("node", BITS)).join(up, ["tree", "up"])
            step = F.struct(F.col("up_kids").alias("kids"), F.col("node").bitwiseAND(FANOUT - 1).cast("int").alias("at"))
            out = out.unionByName(below.select("tree", "node", "kids", F.concat(F.array(step), "up_steps").cast(STEPS).alias("steps"), "subroot", "root"))
        above = out
    lone = ended(forest.leaves().filter("total = 1").select("tree", F.lit(0).cast("long").alias("node"), F.lit(None).cast("string").alias("kids"), "digest")).select(*names)
    runs = lone if above is None else lone.unionByName(above)
    leaves = forest.leaves().select("tree", F.shiftright("node", BITS).alias("run"), F.col("node").bitwiseAND(FANOUT - 1).cast("int").alias("at"), "digest", *keep)
    leaves = leaves.join(runs.withColumnRenamed("node", "run"), ["tree", "run"])
    own = F.when(F.col("kids").isNull(), F.array().cast(STEPS)).otherwise(F.array(F.struct("kids", "at")))
    return leaves.select(*keep, "digest", "subroot", "root", F.concat(own, "steps").alias("steps"))


def siblings(steps: Column) -> Column:
    """Digests of the others of every run on the way up, end to end."""
    return F.array_join(F.transform(steps, lambda s: F.concat(_left(s), _right(s))), "")


def _left(step: Column) -> Column:
    return F.substring(step["kids"], F.lit(1), step["at"] * HEX)


def _right(step: Column) -> Column:
    return F.substring(step["kids"], (step["at"] + 1) * HEX + 1, F.lit(FANOUT * HEX))


def fold(digest: Column, steps: Column) -> Column:
    """The root that ``digest`` leads to with the siblings of ``steps``."""
    return F.aggregate(steps, digest, lambda below, s: F.sha2(F.concat(_left(s), below, _right(s)), 256))


def manifest(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The manifest of ``docs``: tree (``null`` as a null, the tree over all sources too), level,
    node and digest of every node, and top: whether the tree is that over the sources.

    Sources and rows are as for ``audit``.
    """
    own, top = _forests(docs.select("doc_id", "source", digest_of([F.col(c) for c in columns]).alias("digest")), ["doc_id"])
    out = None
    for forest, over in ((own, False), (top, True)):
        for level in range(forest.levels + 1):
            nodes = forest.nodes(level) if level else forest.leaves()
            name = F.lit(None).cast("string") if over else F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30))
            nodes = nodes.select(name.alias("tree"), F.lit(level).alias("level"), "node", "digest", F.lit(over).alias("top"))
            out = nodes if out is None else out.unionByName(nodes)
    return out


def _forests(rows: DataFrame, keep: list[str]) -> tuple[Forest, Forest]:
    """The trees of all sources and the tree over them, of rows with doc_id, source, digest."""
    leaves = cut(rows.withColumn("tree", tree_key(F.col("source"))).drop("source"))
    own = grow(leaves, ["doc_id", "digest"], keep)
    over = own.roots().select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    return own, grow(over, ["name"], ["name"])


def audit(docs: DataFrame, columns: list[str], found: dict[str, Column], where: Column) -> DataFrame:
    """Every row of ``docs`` held against the root of all: doc_id, leaf, subroot, root,
    proof_sha256 (digest of its siblings up to the root), folded_root (from what is found now
    and the siblings of old) and verified (whether it is the root).

    Where ``where`` holds, the row's columns are found as the expressions of ``found``; a null
    condition is none.  Leaves are in order of doc_id, null first, rows that share an id in
    that of their digests; rows that are equal are leaves of their own.  A null source is the
    first source.  Nulls, empty texts and columns besides ``columns`` make no difference to
    others; one row is its own root; an empty table gives no rows.
    """
    forged = F.when(where, digest_of([found.get(c, F.col(c)) for c in columns]))
    rows = docs.select("doc_id", "source", digest_of([F.col(c) for c in columns]).alias("digest"), forged.alias("forged"))
    own, top = _forests(rows, ["doc_id", "forged"])
    rest = proofs(top, ["name"]).select(F.col("name").alias("tree"), "steps", "root")
    out = proofs(own, ["doc_id", "forged"], rest)
    out = out.withColumn("folded_root", fold(F.coalesce("forged", "digest"), F.col("steps")))
    proof = F.sha2(siblings(F.col("steps")), 256)
    return out.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
