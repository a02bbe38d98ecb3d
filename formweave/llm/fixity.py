"""Merkle fixity audit of WARC replicas.

Records are hashed one by one.  Ranges of FANOUT consecutive record ids form the nodes
of a tree, each with a digest over its children's digests, and with its records and
bytes, so that the offset of any record follows from the nodes on the way to it.  Two
replicas are compared at the roots; the audit then descends only into nodes that differ.
Only digests are shuffled, never contents, and a node is built from FANOUT children.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Children of a node: ids are cut by so many bits a level.
BITS = 6
FANOUT = 1 << BITS


def warc_record(url: Column, content: Column) -> Column:
    """A WARC/1.1 resource record as text: named fields, an empty line, the content.
    A null url or content is empty; lengths are in bytes."""
    url, content = F.coalesce(url, F.lit("")), F.coalesce(content, F.lit(""))
    head = [F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(content).cast("string"), F.lit("\r\n\r\n")]
    return F.concat(*head, content, F.lit("\r\n\r\n"))


def leaves(records: DataFrame) -> DataFrame:
    """node (the record id), digest, records and bytes of ``records`` (record_id, record).

    A null id counts as the smallest long.  Records that share an id are one leaf whose
    digest does not depend on their order: sums over their digests, which aggregate
    before the shuffle however many there are.  A null record is an empty one.
    """
    record = F.coalesce("record", F.lit(""))
    rows = records.select(F.coalesce("record_id", F.lit(-(1 << 63))).alias("node"), F.sha2(record, 256).alias("d"), F.octet_length(record).cast("long").alias("b"))
    part = lambda at: F.sum(F.conv(F.substring("d", at, 15), 16, 10).cast("decimal(38,0)"))
    sums = F.concat_ws(":", F.count("*"), *[part(1 + 15 * i) for i in range(4)])
    digest = F.when(F.count("*") == 1, F.max("d")).otherwise(F.sha2(sums, 256))
    return rows.groupBy("node").agg(digest.alias("digest"), F.count("*").alias("records"), F.sum("b").alias("bytes"))


def parents(level: DataFrame) -> DataFrame:
    """Nodes one level up: the digest covers the ordered children and their places."""
    child = F.struct("node", "digest", "records", "bytes")
    rows = level.groupBy(F.shiftright("node", BITS).alias("node")).agg(F.array_sort(F.collect_list(child)).alias("c"), F.sum("records").alias("records"), F.sum("bytes").alias("bytes"))
    line = F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["node"].cast("string"), x["digest"], x["bytes"].cast("string"))), ",")
    return rows.select("node", F.sha2(line, 256).alias("digest"), "records", "bytes")


def tree(records: DataFrame, levels: int | None = None) -> list[DataFrame]:
    """Levels from the leaves to the roots (one of ids from 0 on, one of negative ids)."""
    out = [cut(leaves(records))]
    while levels is None or len(out) <= levels:
        out.append(cut(parents(out[-1])))
        if levels is None and out[-1].filter("node NOT IN (0, -1)").isEmpty():
            break
    return out


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """Records in which two replicas (record_id, record) differ.

    Returns record_id, status (changed; missing: only on the left; extra: only on the
    right), left_offset and right_offset: the bytes before the record in its replica, in
    order of ids, null where it is absent; left_bytes, right_bytes, left_digest and
    right_digest.  Equal replicas give no rows, and so do two empty ones; against an empty
    replica all records are missing or extra.
    """
    a = tree(left)
    b = tree(right)
    while len(a) < len(b):
        a.append(cut(parents(a[-1])))
    while len(b) < len(a):
        b.append(cut(parents(b[-1])))
    open_ = None
    for at in range(len(a) - 1, -1, -1):
        sides = []
        for side, name in ((a[at], "left"), (b[at], "right")):
            up = F.shiftright("node", BITS) if open_ is not None else F.lit(0).cast("long")
            side = side.withColumn("up", up)
            if open_ is not None:
                # children of differing nodes only
                side = side.join(open_.select(F.col("node").alias("up"), F.col(f"{name}_offset").alias("above")), "up")
            else:
                side = side.withColumn("above", F.lit(0).cast("long"))
            before = Window.partitionBy("up").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
            side = side.withColumn("offset", F.col("above") + F.coalesce(F.sum("bytes").over(before), F.lit(0)))
            sides.append(side.select("node", *[F.col(c).alias(f"{name}_{c}") for c in ("digest", "bytes", "offset")]))
        both = sides[0].join(sides[1], "node", "full").filter(~F.col("left_digest").eqNullSafe(F.col("right_digest")))
        if at:
            # where a side has no such node its children would begin nowhere
            both = both.withColumns({f"{n}_offset": F.coalesce(f"{n}_offset", F.lit(0)) for n in ("left", "right")})
        open_ = cut(both)
    status = F.when(F.col("right_digest").isNull(), "missing").when(F.col("left_digest").isNull(), "extra").otherwise("changed")
    names = [f"{n}_{c}" for c in ("offset", "bytes", "digest") for n in ("left", "right")]
    return open_.select(F.col("node").alias("record_id"), status.alias("status"), *names)
