"""Exact substring removal by fixed-block anchors.

A window of WINDOW words that repeats contains a whole block of BLOCK words wherever its
first copy is cut into consecutive blocks, if BLOCK is at most half of WINDOW.  So:

1.  *Index and probe.*  Every text's non-overlapping blocks are reference blocks, and its
    hashes of every rolling BLOCK words are probes.  They meet within a chunk of texts
    first, and then in buckets by hash; positions where a probe meets a block of another
    document are hits.  Of what a chunk has settled only the smallest block and the largest
    document of a hash go on to its bucket, so a passage that very many texts share is
    some positions of each chunk there and not one of each text.
2.  *Extend.*  Only windows around a hit can repeat.  Their hashes over all WINDOW words
    meet again in buckets, which find the smallest document of each; overlapping windows
    that repeat make up the maximal exact repeats.
3.  *Remove.*  Words that such a window of a smaller document covers are removed.

Between the steps positions travel as packed arrays, a few bytes each; texts travel only
if they hold a hit.  Texts with equal word sequences are one: all but the smallest of
them are removed whole and are no part of the search.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .common import as_bytes, cut, lean, semi_join, small_side, tidy

U64 = np.uint64
WINDOW, BLOCK = 50, 25
#: Bytes of text hashed and packed together, bytes whose probes meet before they are dealt
#: to buckets, and words dealt to one bucket.
CHUNK, MEETING, SHARE = 2 << 20, 4 << 20, 1 << 21


def _ints(values: np.ndarray) -> bytes:
    """Small integers, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unints(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def _join(parts: list[bytes]) -> bytes:
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def _split(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def _pack(doc: np.ndarray, pos: np.ndarray, value: np.ndarray | None = None) -> bytes:
    """(doc, position, value) in order of doc and position: ids and gaps are compressed."""
    edge = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.empty(0, np.int64)
    gap = np.diff(pos, prepend=0)
    gap[edge] = pos[edge]
    parts = [_ints(np.diff(doc[edge], prepend=0)), _ints(np.diff(np.append(edge, len(doc)))), _ints(gap)]
    return _join(parts + ([value.tobytes()] if value is not None else []))


def _unpack(data: bytes, kind=np.uint32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = _split(data)
    ids, counts, gap = (_unints(p) for p in parts[:3])
    doc = np.repeat(np.cumsum(ids), counts)
    total = np.cumsum(gap)
    first = np.cumsum(counts) - counts
    pos = total - np.repeat(total[first] - gap[first], counts) if len(gap) else gap
    return doc, pos, np.frombuffer(parts[3], kind) if len(parts) > 3 else np.empty(0, kind)


def _unpack_all(blobs, kind=np.uint32) -> list[np.ndarray]:
    found = [_unpack(b, kind) for b in blobs] or [_unpack(_pack(*[np.empty(0, np.int64)] * 2), kind)]
    return [np.concatenate(x) for x in zip(*found)]


def _deal(bucket: np.ndarray, *arrays: np.ndarray):
    """The arrays' elements of each bucket, in order."""
    order = np.argsort(bucket, kind="stable")
    ends = np.flatnonzero(np.diff(bucket[order], append=-1) != 0) + 1
    at = 0
    for end in ends:
        some = order[at:end]
        yield int(bucket[some[0]]), [a[some] for a in arrays]
        at = end


def _doc_part(doc: np.ndarray, parts: int) -> np.ndarray:
    return (H.mix(doc.astype(np.int64).view(U64)) % U64(parts)).astype(np.int64)


def _runs(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by value, start of each run of equal values, and the run of each element."""
    order = np.argsort(value, kind="stable")
    v = value[order]
    new = np.concatenate(([True], v[1:] != v[:-1]))
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _to_docs(doc: np.ndarray, other: np.ndarray, parts: int) -> list[tuple]:
    """(part, doc, other) dealt to the documents' parts, without repeats."""
    rows = []
    for part, (d, o) in _deal(_doc_part(doc, parts), doc, other):
        order = np.lexsort((o, d))
        d, o = d[order], o[order]
        keep = np.concatenate(([True], (d[1:] != d[:-1]) | (o[1:] != o[:-1])))
        rows.append((part, d[keep], o[keep]))
    return rows


def word_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_words and the digest of the words joined by single spaces of every row."""

    def build(batches):
        for batch in batches:
            n, digest = [], []
            for text in as_bytes(batch.column("text")):
                words = text.split()
                n.append(len(words))
                digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_words", "whole"])

    return lean(docs).select("doc_id", "text").mapInArrow(tidy(build), "doc_id long, n_words long, whole string")


def _met(doc: np.ndarray, pos: np.ndarray, start: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of positions in runs of equal hashes: whether each is a hit (a probe that meets a
    block of a smaller document, or a block that a probe of a larger one meets), whether it
    is a block, and the smallest document of a block and the largest of all in its run."""
    block = pos % BLOCK == 0
    least = np.minimum.reduceat(np.where(block, doc, np.iinfo(np.int64).max), start)[run]
    most = np.maximum.reduceat(doc, start)[run]
    return (least < most) & ((doc > least) | (block & (doc < most))), block, least, most


def _probes(docs: DataFrame, buckets: int) -> DataFrame:
    """Hashes of every rolling BLOCK words of texts of a window or more; a position that is
    a multiple of BLOCK is a reference block.  Rows are bucket and packed, the hashes of a
    bucket, or part (as bucket) and found, hits that a chunk has settled by itself."""
    names, kinds = ["bucket", "packed", "found"], [pa.int32(), pa.binary(), pa.binary()]

    def rows(hashes, doc, pos):
        h, doc, pos = np.concatenate(hashes), np.concatenate(doc), np.concatenate(pos)
        order, start, run = _runs(h)
        d, p = doc[order], pos[order]
        hit, block, least, most = _met(d, p, start, run)
        hits = _to_docs(d[hit], p[hit], buckets)
        # settled positions stay here, but for one that shows the run's block and one its largest document
        first = np.zeros(len(d), bool)
        for shows in (block & (d == least), d == most):
            at = np.flatnonzero(shows)
            first[at[np.unique(run[at], return_index=True)[1]]] = True
        keep = np.sort(order[~hit | first])
        dealt = list(_deal(((h[keep] >> U64(32)) % U64(buckets)).astype(np.int64 if buckets > 65535 else np.uint16), doc[keep], pos[keep], h[keep].astype(np.uint32)))
        cells = [
            [b for b, _ in dealt] + [r[0] for r in hits],
            [_pack(*x) for _, x in dealt] + [None] * len(hits),
            [None] * len(dealt) + [_pack(r[1], r[2]) for r in hits],
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, kinds)], names=names)

    def build(batches):
        hashes, doc, pos, size = [], [], [], 0
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for held in H.chunks(zip(ids, as_bytes(batch.column("text"))), CHUNK):
                words, at = H.hash_words([t for _, t in held])
                for j, (doc_id, text) in enumerate(held):
                    size += len(text)
                    if at[j + 1] - at[j] >= WINDOW:
                        h = H.window_hashes(words[at[j] : at[j + 1]], BLOCK)
                        hashes.append(h)
                        doc.append(np.full(len(h), doc_id))
                        pos.append(np.arange(len(h)))
                if hashes and size >= MEETING:
                    yield rows(hashes, doc, pos)
                    hashes, doc, pos, size = [], [], [], 0
        if hashes:
            yield rows(hashes, doc, pos)

    return lean(docs).select("doc_id", "text").mapInArrow(tidy(build), "bucket int, packed binary, found binary")


def _hits(parts: int):
    """The hits of a bucket, by document, beside those that chunks have settled."""

    def run(bucket: pd.DataFrame) -> pd.DataFrame:
        settled = bucket[bucket["packed"].isna()].rename(columns={"bucket": "part"})[["part", "found"]]
        bucket = bucket[bucket["packed"].notna()]
        if bucket.empty:
            return settled
        doc, pos, value = _unpack_all(bucket["packed"])
        order, start, run = _runs(value)
        doc, pos = doc[order], pos[order]
        hit = _met(doc, pos, start, run)[0]
        rows = _to_docs(doc[hit], pos[hit], parts)
        return pd.concat([settled, pd.DataFrame({"part": [r[0] for r in rows], "found": [_pack(r[1], r[2]) for r in rows]})])

    return run


def _extend(buckets: int):
    """Hashes of the windows around the hits of a part's documents, dealt to buckets."""

    def run(texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        doc, pos, _ = _unpack_all(found["found"])
        order = np.argsort(doc, kind="stable")
        doc, pos = doc[order], pos[order]
        hashes, docs, starts = [], [], []
        for held in H.chunks(zip(texts["doc_id"], (t.encode() for t in texts["text"])), CHUNK):
            words, at = H.hash_words([t for _, t in held])
            for j, (doc_id, _) in enumerate(held):
                n = at[j + 1] - at[j] - WINDOW + 1
                a, b = np.searchsorted(doc, (doc_id, doc_id + 1))
                if n <= 0 or a == b:
                    continue
                near = np.zeros(n + 1, np.int64)
                np.add.at(near, np.clip(pos[a:b] - (WINDOW - BLOCK), 0, n), 1)
                np.add.at(near, np.clip(pos[a:b] + 1, 0, n), -1)
                near = np.flatnonzero(np.cumsum(near[:n]) > 0)
                hashes.append(H.window_hashes(words[at[j] : at[j + 1]], WINDOW)[near])
                docs.append(np.full(len(near), doc_id))
                starts.append(near)
        if not hashes:
            return pd.DataFrame({"bucket": [], "packed": []})
        h = np.concatenate(hashes)
        out = list(_deal(((h >> U64(40)) % U64(buckets)).astype(np.int64), np.concatenate(docs), np.concatenate(starts), h))
        return pd.DataFrame({"bucket": [b for b, _ in out], "packed": [_pack(*x) for _, x in out]})

    return run


def _repeats(parts: int):
    """Windows whose words also start in a smaller document: their hashes, by document."""

    def run(bucket: pd.DataFrame) -> pd.DataFrame:
        doc, _, value = _unpack_all(bucket["packed"], U64)
        order, start, run = _runs(value)
        doc, value = doc[order], value[order]
        again = doc > np.minimum.reduceat(doc, start)[run]
        rows = _to_docs(doc[again], value[again].view(np.int64), parts)
        found = [_join([_ints(np.diff(d, prepend=0)), o.tobytes()]) for _, d, o in rows]
        return pd.DataFrame({"part": [r[0] for r in rows], "found": found})

    return run


def _remove(texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    """Kept words of a part's documents, by the hashes of their windows that repeat."""
    pairs = [_split(f) for f in found["found"]]
    doc = np.concatenate([np.cumsum(_unints(p[0])) for p in pairs] or [np.empty(0, np.int64)])
    value = np.concatenate([np.frombuffer(p[1], np.int64) for p in pairs] or [np.empty(0, np.int64)]).view(U64)
    order = np.argsort(doc, kind="stable")
    doc, value = doc[order], value[order]
    rows = []
    for held in H.chunks(zip(texts["doc_id"], (t.encode() for t in texts["text"])), CHUNK):
        hashed, at = H.hash_words([t for _, t in held])
        for j, (doc_id, text) in enumerate(held):
            a, b = np.searchsorted(doc, (doc_id, doc_id + 1))
            hit = np.isin(H.window_hashes(hashed[at[j] : at[j + 1]], WINDOW), value[a:b])
            if not hit.any():
                continue
            words = text.split()
            edge = np.zeros(len(words) + 1, np.int64)
            edge[: len(hit)] += hit
            edge[WINDOW : WINDOW + len(hit)] -= hit
            gone = np.cumsum(edge[:-1]) > 0
            kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
            rows.append((doc_id, hashlib.sha256(b" ".join(words)).hexdigest(), int(gone.sum()), kept.decode()))
    return pd.DataFrame(rows, columns=["doc_id", "whole", "n_removed", "kept"])


def removals(docs: DataFrame, facts: DataFrame) -> DataFrame:
    """doc_id, whole, n_removed and kept (text) of the documents of ``docs`` that lose
    words but are no copies of a smaller document.  ``facts`` is ``word_texts(docs)``."""
    first = facts.filter(F.col("n_words") >= WINDOW).groupBy("whole").agg(F.min("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"))
    first = cut(first)
    words = first.agg(F.sum("n_words")).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(words / SHARE))
    some = semi_join(docs.select("doc_id", "text"), first.select("doc_id").distinct(), "doc_id")
    hits = cut(_probes(some, buckets).groupBy("bucket").applyInPandas(_hits(buckets), "part int, found binary"))

    def with_texts(found: DataFrame, function, schema: str) -> DataFrame:
        """Cogroups the parts' findings with the texts of the documents found."""
        ids = found.groupBy("part").applyInPandas(_found_docs, "doc_id long")
        texts = semi_join(docs.filter("text IS NOT NULL").select("doc_id", "text"), cut(ids), "doc_id").mapInArrow(_with_part(buckets), "part int, doc_id long, text string")
        return texts.groupBy("part").cogroup(found.groupBy("part")).applyInPandas(function, schema)

    windows = with_texts(hits, _extend(buckets), "bucket int, packed binary")
    again = cut(windows.groupBy("bucket").applyInPandas(_repeats(buckets), "part int, found binary"))
    return with_texts(again, _remove, "doc_id long, whole string, n_removed long, kept string")


def _found_docs(found: pd.DataFrame) -> pd.DataFrame:
    """The documents of a part that anything was found in, once each."""
    return pd.DataFrame({"doc_id": np.unique(np.concatenate([np.cumsum(_unints(_split(f)[0])) for f in found["found"]]))})


def _with_part(parts: int):
    def run(batches):
        for batch in batches:
            part = _doc_part(np.array(batch.column("doc_id"), np.int64), parts).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), batch.column("doc_id"), batch.column("text")], names=["part", "doc_id", "text"])

    return run


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text; other columns are ignored): doc_id,
    n_words, n_removed and kept_sha256, the digest of the kept words joined by one space.

    Null and empty texts have no words, and a text of fewer than WINDOW words loses none.
    Rows with a null doc_id are neither smaller nor larger than any: they keep all words.
    Rows that repeat a doc_id don't remove from each other.  An empty table gives no rows.
    """
    facts = cut(word_texts(docs))
    known = docs.filter("doc_id IS NOT NULL")
    lost = removals(known, facts.filter("doc_id IS NOT NULL")).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept").dropDuplicates(["doc_id", "whole"])
    least = facts.filter("doc_id IS NOT NULL").groupBy("whole").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").drop("most")
    # texts that repeat are few beside all; while they are, a text of very many copies meets its own here
    out = facts.join(small_side(cut(least), 1 << 18), "whole", "left").join(lost, ["doc_id", "whole"], "left")
    copy = (F.col("n_words") >= WINDOW) & (F.col("least") < F.col("doc_id"))
    removed = F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    digest = F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "whole"))
    return out.select("doc_id", "n_words", removed.cast("long").alias("n_removed"), digest.alias("kept_sha256"))
