"""The Merkle manifest against a tree in a loop and against SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from formweave.llm import catalog, manifest, sql

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, digest string, tree string, node string, forged string, steps string"
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def row_digest(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree_of(digests):
    """The root, and for each leaf its runs and places."""
    ways, level, at = [[] for _ in digests], digests, list(range(len(digests)))
    while len(level) > 1:
        runs = [level[i : i + 16] for i in range(0, len(level), 16)]
        for way, i in zip(ways, range(len(at))):
            way.append((runs[at[i] // 16], at[i] % 16))
            at[i] //= 16
        level = ["".join(r) and h("".join(r)) for r in runs]
    return level[0], ways


def brute(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    parts, tops = {}, []
    for s in names:
        some = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, row_digest(r[:5])))
        top, ways = tree_of([row_digest(r[:5]) for r in some])
        parts[s] = (some, top, ways)
        tops.append(top)
    root, above = tree_of(tops)
    out = []
    for s, rest in zip(names, above):
        some, top, ways = parts[s]
        for r, way in zip(some, ways):
            leaf, way = row_digest(r[:5]), way + rest
            text = r[4]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            now = row_digest((*r[:4], text))
            for run, at in way:
                now = h("".join(run[:at] + [now] + run[at + 1 :]))
            proof = h("".join("".join(run[:at] + run[at + 1 :]) for run, at in way))
            out.append((r[0], leaf, top, root, proof, now, now == root))
    return sorted(out, key=repr)


def audit(docs):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return sorted(map(tuple, manifest.audit(docs, COLUMNS, {"text": lower}, tampered).collect()), key=repr)


def table(sizes, rng):
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            text = rng.choice([None, "", "ABC é 漢字", f"Text {i}", "same", "x" * 3000])
            rows.append((i, source, rng.choice([None, "en"]), rng.choice([None, i]), text, *["clash"] * 5))
            i += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 1},
        {None: 1, "": 2, "s": 16, "t": 17, "null": 15},
        {"hot": 700, "b": 33, None: 256, "é": 257, "Z": 1},
        {f"s{i}": 1 + i % 3 for i in range(300)},
        {"one": 4097},
    ],
)
def test_trees(spark, sizes):
    rows = table(sizes, random.Random(len(sizes)))
    docs = spark.createDataFrame(rows, SCHEMA)
    assert audit(docs) == brute(rows)


@pytest.mark.parametrize("parts", [1, 2, 13])
def test_ranges_begin_anywhere(spark, parts):
    """However the leaves are dealt to ranges, the trees are the same."""
    rows = table({"a": 530, "b": 40}, random.Random(3))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    got = audit(spark.createDataFrame(rows, SCHEMA).repartition(5))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute(rows)


@pytest.mark.parametrize("cuts", [[], [1], [16], [15, 17], [5, 21, 22, 260, 300], [256, 512]])
def test_mountain_range(cuts):
    """Pieces of a tree give its nodes, or what has to be merged into them, and nothing twice."""
    total = 600
    digests = [h(str(i)) for i in range(total)]
    nodes, opened = {}, {0: {}, 1: {}, 2: {}}

    def emit(kind, tree, level, node, digest, kids, _):
        if kind == manifest.NODE:
            assert nodes.setdefault((level, node), digest) is digest and h(kids) == digest
        else:
            assert opened[level].setdefault(node, digest) is digest

    bounds = [0, *cuts, total]
    for a, b in zip(bounds, bounds[1:]):
        part = manifest.Range("t", a, total, emit)
        for d in digests[a:b]:
            part.add(d)
        part.close()
    # a range leaves fewer nodes than two runs a level
    assert all(len(v) <= 30 * len(bounds) for v in opened.values())
    level = digests
    for k in range(1, 4):
        level = [h("".join(level[i : i + 16])) for i in range(0, len(level), 16)]
        runs = {n >> 4 for n in opened[k - 1]}
        for i, d in enumerate(level):
            assert ((k, i) in nodes) != (i in runs)
            if (k, i) in nodes:
                assert nodes[k, i] == d
            elif k < 3:
                opened[k][i] = d


def test_equal_rows_null_ids_and_empty_tables(spark):
    rng = random.Random(5)
    rows = table({"a": 20}, rng)
    rows += [rows[0]] * 40 + [(None, None, None, None, None, *["x"] * 5)] * 3 + [(7, "a", "en", 1, "other", *["x"] * 5)]
    assert audit(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert audit(spark.createDataFrame([], SCHEMA)) == []
    assert manifest.manifest(spark.createDataFrame([], SCHEMA), COLUMNS).count() == 0


def test_manifest_has_every_node(spark):
    rows = table({"a": 300, None: 17, "b": 1}, random.Random(8))
    found = manifest.manifest(spark.createDataFrame(rows, SCHEMA), COLUMNS).collect()
    counts = defaultdict(int)
    for r in found:
        counts[r.top, r.tree, r.level] += 1
    assert counts == {(False, "a", 0): 300, (False, "a", 1): 19, (False, "a", 2): 2, (False, "a", 3): 1, (False, None, 0): 17, (False, None, 1): 2, (False, None, 2): 1, (False, "b", 0): 1, (True, None, 0): 3, (True, None, 1): 1}
    assert {r.digest for r in found if r.top and r.level == 1} == {brute(rows)[0][3]}


def test_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    found = catalog.queries()["op12_merkle_manifest"](spark, folder)
    result = con.execute(sql.ORACLES["op12_merkle_manifest"])
    assert [d[0] for d in result.description] == found.columns
    got = sorted(map(tuple, found.collect()))
    assert got == sorted(result.fetchall()) and 0 < sum(not r[6] for r in got) < len(got)
