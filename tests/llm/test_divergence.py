"""The divergence audit against sums in a loop and against SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from formweave.llm import catalog, divergence, sql

SCHEMA = "doc_id long, text string, lang string, source string, value string, item string, term string, rank string, part string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least, top):
    counts, groups, inside = defaultdict(Counter), set(), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]
        counts[lang, source].update(found)
        inside[lang].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in inside[lang].items() if n >= least]
        sources = sorted(s for x, s in groups if x == lang)
        share = lambda c, n: 1 + 10**9 * (c + 5) // (n + 5 * len(kept))
        n = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: share(counts[lang, s][t], n[s]) for t in kept} for s in sources}
        q = {t: share(sum(counts[lang, s][t] for s in sources), sum(n.values())) for t in kept}
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            some = [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", some)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, *x, i) for i, x in enumerate(found[: top if part == "term" else None], 1)]
    return sorted(out)


def corpus(seed, n=260, sources=9):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{'xyz'[i % 3] * (i % 4)}" for i in range(60)] + ["ÉTÉ", "été", "日本", "𠮷", "﷐", "Abc", "aBC"]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(40)))
        rows.append((i, rng.choice([text, text, text.upper(), text.replace(" ", "9_-"), None, ""]), rng.choice(["en", "en", "de", None, ""]), rng.choice([*(f"s{j}" for j in range(sources)), None]), *["clash"] * 5))
    rows += [rows[3]] * 30  # one row many times
    rows += [(900, None, "xx", "only", *["x"] * 5), (901, "rare words", "yy", "a", *["x"] * 5), (902, None, "yy", "b", *["x"] * 5)]
    return rows


@pytest.mark.parametrize("least, top", [(1, 5), (4, 50), (30, 50)])
def test_audit(spark, least, top):
    rows = corpus(least)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert sorted(map(tuple, divergence.audit(docs, least, top).collect())) == brute(rows, least, top)


def test_small_blocks_and_tries(spark, monkeypatch):
    """Tries that are given out early, blocks of few leaves and few sources, and shuffled
    facts instead of broadcast ones give the same."""
    rows = corpus(11)
    for name, value in (("HELD", 20), ("TOGETHER", 50), ("LEAVES", 3), ("SOURCES", 2), ("STRETCH", 16)):
        monkeypatch.setattr(divergence, name, value)
    met = divergence._met
    monkeypatch.setattr(divergence, "_met", lambda rows, facts, on, salt, most: met(rows, facts, on, salt, 0))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(map(tuple, divergence.audit(docs, 4, 50).collect())) == brute(rows, 4, 50)


def test_no_rows(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    blank = spark.createDataFrame([(1, None, None, None, *["x"] * 5), (2, "", "en", "a", *["x"] * 5), (2, "1 2", "en", "b", *["x"] * 5)], SCHEMA)
    assert sorted(map(tuple, divergence.audit(blank).collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_filter_misses_no_term(spark, monkeypatch):
    """With two words of bits next to nothing is kept out, and the rows are the same."""
    rows = corpus(21)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    words = divergence.frequent_terms(docs, 4)
    inside = Counter()
    for _, text, lang, *_ in rows:
        inside.update({(lang or "", t) for t in divergence.terms((text or "").encode())})
    kept = {x for x, n in inside.items() if n >= 4}
    passed = {(lang, t) for lang, t in inside if divergence._passes(divergence._hashes([t], divergence._seed(lang)), words)[0]}
    assert kept <= passed and len(passed - kept) < 5
    monkeypatch.setattr(divergence, "FILTER_BITS", 7)
    monkeypatch.setattr(divergence, "HASHES", 40)
    assert sorted(map(tuple, divergence.audit(docs, 4, 50).collect())) == brute(rows, 4, 50)


@pytest.mark.parametrize("burst", [1024, 3, 1])
def test_trie(monkeypatch, burst):
    """Ordered by bytes, whatever the order of entry; prefixes of others are leaves, too."""
    rng = random.Random(2)
    words = ["".join(rng.choice("abé日") for _ in range(rng.randrange(1, 9))).encode() for _ in range(3000)] + [b"a" * 3000, b"a" * 2999]
    monkeypatch.setattr(divergence, "BURST", burst)
    trie, want = divergence.Trie(), defaultdict(lambda: [0, 0])
    for w in words:
        source = rng.choice("xyz")
        trie.add(w, source, 2, 1)
        want[w, source][0] += 2
        want[w, source][1] += 1
    walked = list(trie.walk())
    assert [w for w, _ in walked] == sorted(set(words)) and trie.size == len(walked)
    assert {(w, s): c for w, leaf in walked for s, c in leaf.items()} == want


def test_long_texts_in_stretches(monkeypatch):
    monkeypatch.setattr(divergence, "STRETCH", 1000)
    rng = random.Random(6)
    text = "".join(rng.choice("aé日 .Z9") for _ in range(50_000)).encode()
    parts = list(divergence._stretches(text))
    assert len(parts) > 30 and [t for p in parts for t in divergence.terms(p)] == divergence.terms(text)
    assert list(divergence._stretches(b"x" * 5000)) == [b"x" * 5000] and list(divergence._stretches(b"")) == [b""]


def test_shares_are_exact():
    rng = random.Random(9)
    counts = [rng.randrange(10 ** rng.randrange(1, 15)) for _ in range(2000)]
    totals = [c + 5 + rng.randrange(10 ** rng.randrange(1, 15)) for c in counts]
    got = divergence.shares(np.array(counts, np.int64), np.array(totals, np.int64)).tolist()
    assert got == [1 + 10**9 * (c + 5) // n for c, n in zip(counts, totals)]


def test_shares_in_the_plan_are_exact(spark):
    rows = [(10**14 + 7, 10**15 + 11), (0, 5), (3 * 10**12, 4 * 10**13 + 1), (95, 100)]
    found = spark.createDataFrame(rows, "c long, n long").select(divergence._share("c", "n")).collect()
    assert [r[0] for r in found] == [1 + 10**9 * (c + 5) // n for c, n in rows]


def test_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    found = catalog.queries()["op13_source_divergence"](spark, folder)
    result = con.execute(sql.ORACLES["op13_source_divergence"])
    assert [d[0] for d in result.description] == found.columns
    got, want = sorted(map(tuple, found.collect())), sorted(result.fetchall())
    assert got == want and {r[2] for r in got} == {"pair", "term"}


def test_counts_many_terms_at_once(spark, monkeypatch):
    """Occurrences are pooled and counted as arrays: small pools and terms that are forgotten
    between texts give the same rows, and no counter is entered by itself."""
    for name, value in (("HELD", 20), ("TOGETHER", 5), ("POOLED", 7), ("LEAVES", 3), ("STRETCH", 16)):
        monkeypatch.setattr(divergence, name, value)
    rows = corpus(11)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(map(tuple, divergence.audit(docs, 3, 20).collect())) == brute(rows, 3, 20)
    calls = []
    monkeypatch.setattr(divergence.Trie, "add", lambda *a: calls.append(a))
    texts = [b"one two one", b"two three"] * 40
    numbers = divergence.Numbers("en", np.full(2, 2**64 - 1, np.uint64))
    found = [[numbers[w] for w in divergence.terms(t)] for t in texts]
    assert found[:2] == [[0, 1, 0], [1, 2]] and found[2:4] == found[:2] and not calls
    assert divergence.Numbers("en", np.zeros(2, np.uint64))[b"one"] == -1
