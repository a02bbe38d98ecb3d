"""Divergence of sources by the terms that they use.

Every partition enters its terms in a byte trie for each language, whose leaves number them,
and sums occurrences and documents of each number and source in arrays.  A trie gives its leaves in the order of their UTF-8
bytes.  Terms in too few documents are kept out of the tries as far as a filter of hashes can
tell (all documents are hashed for it first): it lets some of them through, and never keeps
out others.  Leaves are dealt to ranges of (language, term), so every range is a range of prefixes;
there the tries of all partitions come as one ordered stream and are merged into one, leaf by
leaf, and terms in too few documents of their language are left out.  What is kept goes on in
blocks of consecutive leaves: a block and the totals of two blocks of sources give all sums of
their pairs, so no task holds a vocabulary and none holds all sources.

All arithmetic is in integers: a share is 1 + floor(SCALE * (count + 5) / (total + 5 * terms)).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, cut, lean, small_side, tidy

#: Documents of its language that a kept term is in, scale of shares, what is added to each
#: count, and ranks of terms that are reported.
LEAST, SCALE, ADDED, TOP = 30, 10**9, 5, 50
#: Suffixes of a node of a trie, leaves that the tries of a task hold before they are given
#: out, terms whose numbers a task remembers, occurrences (and counters) that are summed
#: together, leaves of a block, sources of a block, and parts that a group of any size is
#: dealt to where it is joined.
BURST, HELD, TOGETHER, POOLED, LEAVES, SOURCES, SALTS = 1024, 200_000, 500_000, 1 << 21, 512, 128, 32

#: Bytes of a long text that are cut at once.
STRETCH = 1 << 20

#: Bits of the filter (16 MB), and hashes counted together before they are given out.
FILTER_BITS, HASHES = 27, 1 << 21

#: What is no letter of a term becomes a space, and A-Z lower case.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))

_BETWEEN = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and of characters beyond ASCII, A-Z in lower case."""
    return text.translate(_FOLD).split()


class Trie:
    """A byte trie; a leaf has counters by source, or the number of its term where counters
    are kept in arrays beside the trie.  What is below a node stands in one table
    of suffixes until there are more than BURST of them, which are then dealt to nodes by
    their first byte: so inner nodes are few, and a path that does not fork has none."""

    __slots__ = ("kids", "held", "size")

    def __init__(self):
        self.kids: dict[int, Trie] | None = None  # by first byte
        self.held: dict[bytes, dict[str, list[int]] | int] = {}  # suffixes; with kids the empty one only
        self.size = 0  # leaves, kept at the root only

    def at(self, term: bytes, number: int | None = None) -> dict[str, list[int]] | int:
        """The leaf of a term; a new one has ``number``, or without it no counters yet."""
        node, i, n = self, 0, len(term)
        while node.kids is not None and i < n:
            below = node.kids.get(term[i])
            if below is None:
                below = node.kids[term[i]] = Trie()
            node, i = below, i + 1
        suffix = term[i:] if i else term
        leaf = node.held.get(suffix)
        if leaf is None:
            leaf = node.held[suffix] = {} if number is None else number
            self.size += 1
            if len(node.held) > BURST:
                node.burst()
        return leaf

    def burst(self) -> None:
        self.kids = {}
        for suffix, leaf in self.held.items():
            if suffix:
                self.kids.setdefault(suffix[0], Trie()).held[suffix[1:]] = leaf
        self.held = {b"": self.held[b""]} if b"" in self.held else {}

    def add(self, term: bytes, source: str, count: int, documents: int) -> None:
        leaf = self.at(term)
        cell = leaf.get(source)
        if cell is None:
            leaf[source] = [count, documents]
        else:
            cell[0] += count
            cell[1] += documents

    def walk(self) -> Iterator[tuple[bytes, dict[str, list[int]] | int]]:
        """Terms and leaves in order of their bytes."""
        stack: list[tuple[bytes, Trie]] = [(b"", self)]
        while stack:
            prefix, node = stack.pop()
            for suffix in sorted(node.held):
                yield prefix + suffix, node.held[suffix]
            for byte in sorted(node.kids or (), reverse=True):
                stack.append((prefix + bytes((byte,)), node.kids[byte]))


LEAF = "lang string, term string, sources array<string>, counts array<long>, documents array<long>"
BLOCK = "lang string, terms array<string>, sums array<long>, names array<string>, term_at array<int>, source_at array<int>, counts array<long>"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows of strings (as bytes or text), lists of them and lists of numbers, as Arrow."""
    columns, names = [], []
    for cells, field in zip(zip(*rows), schema.split(", ")):
        name, kind = field.split(" ")
        flat = [x for c in cells for x in c] if kind.startswith("array") else list(cells)
        if "string" in kind:
            values = pa.array([x if isinstance(x, bytes) else x.encode() for x in flat], pa.binary()).cast(pa.string())
        else:
            values = pa.array(flat, pa.int32() if "int" in kind else pa.int64())
        if kind.startswith("array"):
            values = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, cells)]), pa.int32()), values)
        columns.append(values)
        names.append(name)
    return pa.RecordBatch.from_arrays(columns, names=names)


def _stretches(text: bytes) -> Iterator[bytes]:
    """A very long text in parts that end between terms."""
    at = 0
    while len(text) - at > STRETCH:
        end = _BETWEEN.search(text, at + STRETCH)
        if end is None:
            break
        yield text[at : end.start()]
        at = end.start()
    yield text[at:] if at else text


def named(column: str) -> Column:
    """A null language or source is the empty one."""
    return F.coalesce(F.col(column), F.lit("")).alias(column)


def _seed(lang: str) -> int:
    return zlib.crc32(b"\0" + lang.encode())


def _hashes(found: set[bytes], seed: int) -> np.ndarray:
    """Hashes of terms, one language's seed among them."""
    return np.fromiter(map(zlib.crc32, found, repeat(seed)), np.uint32, len(found))


def frequent_terms(docs: DataFrame, least: int) -> np.ndarray:
    """A filter of the hashes of all terms in at least ``least`` documents of their language,
    in words of 64 bits.  It has the same size whatever the input, and what comes to the
    driver are its words.  Terms that share a hash are counted together, so none is missed.
    """

    def build(batches):
        held: list[np.ndarray] = []
        size = 0

        def counts() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(n)], names=["hash", "n"])

        for batch in batches:
            seeds = [_seed(x) for x in batch.column("lang").to_pylist()]
            for seed, text in zip(seeds, as_bytes(batch.column("text"))):
                held.append(_hashes(set().union(*map(terms, _stretches(text))), seed))
                size += len(held[-1])
                if size > HASHES:
                    yield counts()
                    size = 0
        if held:
            yield counts()

    found = lean(docs.select(named("lang"), "text")).mapInArrow(tidy(build), "hash long, n long")
    found = found.groupBy("hash").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    placed = found.selectExpr(f"hash >> {32 - FILTER_BITS} AS place")
    words = placed.groupBy(F.expr("place >> 6").alias("word")).agg(F.expr("bit_or(1L << CAST(place & 63 AS INT))").alias("bits")).toPandas()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _passes(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """1 for hashes that the filter lets through."""
    place = (hashes >> np.uint32(33 - (len(words) * 64).bit_length())).astype(np.int64)
    return (words[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1)


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The different keys in order, and the sums of the values of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begins = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else order
    return (keys[begins], *(np.add.reduceat(v[order], begins) if len(keys) else v for v in values))


class Numbers(dict):
    """Numbers of a language's terms, as its trie has them, and -1 for a term that the filter
    keeps out.  A term is looked for in the filter and the trie when it is met first."""

    def __init__(self, lang: str, words: np.ndarray):
        self.trie, self.seed, self.words = Trie(), _seed(lang), memoryview(words)
        self.shift = 33 - (len(words) * 64).bit_length()

    def __missing__(self, term: bytes) -> int:
        place = zlib.crc32(term, self.seed) >> self.shift
        found = self[term] = self.trie.at(term, self.trie.size) if self.words[place >> 6] >> (place & 63) & 1 else -1
        return found


def count_terms(docs: DataFrame, words: np.ndarray) -> DataFrame:
    """Leaves of the tries of all partitions: lang, term, and for each source of the leaf
    occurrences and documents, of terms that the filter ``words`` lets through.  A term comes
    once for each trie that has it; tries are given out and begun anew when they hold HELD
    leaves, or POOLED counters."""
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def build(batches):
        known: dict[str, Numbers] = {}
        groups: dict[tuple[str, str], int] = {}
        pool: list[np.ndarray] = []  # numbers of the terms of a text
        owners: list[int] = []  # and its group
        # counters by group and number: keys, occurrences, documents
        counters: list[tuple[np.ndarray, ...]] = []

        def enter() -> None:
            if pool:
                numbers, owner = np.concatenate(pool), np.array(owners, np.int64)
                text = np.repeat(np.arange(len(pool)), [len(x) for x in pool])
                inside = numbers >= 0
                keys, n = np.unique(text[inside] << 32 | numbers[inside], return_counts=True)
                counters.append(_sums(owner[keys >> 32] << 32 | keys & 0xFFFFFFFF, n, np.ones_like(n)))
                pool.clear()
                owners.clear()
            if len(counters) > 1:
                counters[:] = [_sums(*map(np.concatenate, zip(*counters)))]

        def leaves() -> Iterator[pa.RecordBatch]:
            if counters:
                keys, n, documents = counters[0]
                langs = sorted(known)
                found = [list(known[x].trie.walk()) for x in langs]
                sizes = np.array([len(x) for x in found])
                first = dict(zip(langs, np.cumsum(sizes) - sizes))
                place = np.concatenate([np.empty(0, np.int64), *(np.argsort(np.array([i for _, i in x], np.int64)) for x in found)])
                names = sorted({s for _, s in groups})
                rank = {s: i for i, s in enumerate(names)}
                start, source = (np.array(x, np.int64) for x in zip(*((first[x], rank[s]) for x, s in groups)))
                group = keys >> 32
                leaf = start[group] + place[start[group] + (keys & 0xFFFFFFFF)]
                source = source[group]
                order = np.lexsort((source, leaf))
                ends = np.concatenate(([0], np.cumsum(np.bincount(leaf, minlength=sizes.sum()))))
                spoken, words_ = np.repeat(np.arange(len(langs)), sizes), [t for x in found for t, _ in x]
                for i in range(0, len(words_), 4096):
                    j = min(i + 4096, len(words_))
                    at = order[ends[i] : ends[j]]
                    listed = lambda x: pa.ListArray.from_arrays(pa.array(ends[i : j + 1] - ends[i], pa.int32()), x)  # noqa: B023, E731
                    columns = [pa.array(langs).take(pa.array(spoken[i:j])), pa.array(words_[i:j], pa.binary()).cast(pa.string()), listed(pa.array(names).take(pa.array(source[at])))]
                    yield pa.RecordBatch.from_arrays([*columns, listed(pa.array(n[at])), listed(pa.array(documents[at]))], names=["lang", "term", "sources", "counts", "documents"])
            for x in (known, groups, counters):
                x.clear()

        pooled = 0
        for batch in batches:
            langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            for lang, source, text in zip(langs, sources, as_bytes(batch.column("text"))):
                numbers = known.get(lang)
                if numbers is None:
                    numbers = known[lang] = Numbers(lang, sent.value)
                group = groups.setdefault((lang, source), len(groups))
                parts = [np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)) for found in map(terms, _stretches(text))]
                pool.append(parts[0] if len(parts) == 1 else np.concatenate(parts))
                owners.append(group)
                pooled += len(pool[-1])
                if pooled > POOLED:
                    enter()
                    pooled = 0
            if sum(map(len, known.values())) > TOGETHER:
                for numbers in known.values():
                    numbers.clear()
            if sum(x.trie.size for x in known.values()) > HELD or sum(len(x[0]) for x in counters) > POOLED:
                enter()
                pooled = 0
                yield from leaves()
        enter()
        yield from leaves()

    return lean(docs.select(named("lang"), named("source"), "text")).mapInArrow(tidy(build), LEAF)


def merge_tries(leaves: DataFrame, least: int) -> DataFrame:
    """Kept terms of all languages in blocks of consecutive leaves: lang, terms, sums
    (occurrences in the language), and names, term_at, source_at, counts: the occurrences of
    every term in every source that has it.

    Leaves are dealt to ranges of (lang, term) and come in order, so a leaf is complete when
    the next one begins, and only a block is held.
    """
    parts = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = leaves.repartitionByRange(parts, "lang", "term").sortWithinPartitions("lang", "term")

    def merged(cells: list[tuple]) -> tuple:
        """Names of sources in order, then leaf and source of each counter, occurrences and documents."""
        leaf, counts, documents = (np.concatenate([c[i] for c in cells]) for i in (0, 2, 3))
        coded = pa.concat_arrays([c[1] for c in cells]).dictionary_encode()
        names = coded.dictionary.to_pylist()
        order = sorted(range(len(names)), key=names.__getitem__)
        rank = np.empty(len(names), np.int64)
        rank[order] = np.arange(len(names))
        keys, counts, documents = _sums(leaf << 32 | rank[coded.indices.to_numpy()], counts, documents)
        return [names[i] for i in order], keys >> 32, keys & 0xFFFFFFFF, counts, documents

    def block(lang: str, trie: Trie, cells: list[tuple]) -> list[tuple]:
        if not trie.size:
            return []
        names, leaf, source, counts, documents = merged(cells)
        within = _sums(leaf, documents)[1]
        found = [(t, i) for t, i in trie.walk() if within[i] >= least]
        if not found:
            return []
        place = np.full(trie.size, -1, np.int64)
        place[[i for _, i in found]] = np.arange(len(found))
        inside = np.flatnonzero(place[leaf] >= 0)
        term_at, source, counts = place[leaf[inside]], source[inside], counts[inside]
        used = np.unique(source)
        return [(lang, [t for t, _ in found], _sums(term_at, counts)[1].tolist(), [names[i] for i in used], term_at.tolist(), np.searchsorted(used, source).tolist(), counts.tolist())]

    def build(batches):
        at, term, number, trie = None, None, 0, Trie()
        cells: list[tuple] = []  # of the block: leaf, source, occurrences, documents
        for batch in batches:
            rows = []
            lists = [batch.column(c) for c in ("sources", "counts", "documents")]
            ends = lists[0].offsets.to_numpy() - lists[0].offsets[0].as_py()
            sources, counts, documents = (x.flatten() for x in lists)
            counts, documents = counts.to_numpy(), documents.to_numpy()
            numbers: list[int] = []
            begin = 0

            def deal(end: int) -> None:
                if end > begin:
                    some = slice(ends[begin], ends[end])
                    leaf = np.repeat(np.array(numbers, np.int64), np.diff(ends[begin : end + 1]))
                    cells.append((leaf, sources[some], counts[some], documents[some]))

            for i, (lang, text) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("term").to_pylist())):
                if lang != at or text != term:
                    if lang != at or trie.size >= LEAVES:
                        deal(i)
                        rows += block(at, trie, cells)
                        at, trie, cells, numbers, begin = lang, Trie(), [], [], i
                    term = text
                    number = trie.at(text.encode(), trie.size)
                numbers.append(number)
            deal(batch.num_rows)
            if sum(len(c[0]) for c in cells) > POOLED:
                names, leaf, source, *summed = merged(cells)
                cells = [(leaf, pa.array(names).take(pa.array(source)), *summed)]
            if rows:
                yield _batch(rows, BLOCK)
        if rows := block(at, trie, cells):
            yield _batch(rows, BLOCK)

    return ranged.mapInArrow(tidy(build), BLOCK)


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (counts + ADDED) / totals), exactly: the quotient is found by three
    digits of a thousand, so nothing overflows below totals of 9e15."""
    quotient, rest = np.divmod(counts + ADDED, totals)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, totals)
        quotient = quotient * 1000 + digit
    return quotient + 1


def _share(count: str, total: str) -> Column:
    return F.expr(f"1 + (CAST({SCALE} AS DECIMAL(10, 0)) * CAST({count} + {ADDED} AS DECIMAL(20, 0))) div CAST({total} AS DECIMAL(20, 0))")


def _met(rows: DataFrame, facts: DataFrame, on: list[str], salt: Column, most: int) -> DataFrame:
    """``rows`` with ``facts`` of their key.  Many facts are there once for each of SALTS
    parts of the rows, so a key with a third of all rows is not one task's."""
    if facts.count() <= most:
        return rows.join(F.broadcast(facts), on)
    salted = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")).join(salted, [*on, "salt"]).drop("salt")


def pair_sums(blocks: DataFrame, facts: DataFrame) -> DataFrame:
    """lang, source, item and value for every two sources of a language, the first smaller:
    the sum of the differences of their shares over all kept terms."""
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    sides = facts.withColumn("side", F.floor(number / SOURCES)).groupBy("lang", "side").agg(F.array_sort(F.collect_list(F.struct("source", "weight"))).alias("m"))
    one = lambda c: sides.select("lang", F.col("side").alias(f"side_{c}"), F.col("m")["source"].alias(f"names_{c}"), F.col("m")["weight"].alias(f"weights_{c}"))
    duos = cut(one("a").join(one("b"), "lang").filter("side_a <= side_b"))
    # a language without kept terms has sources, too, whose sums are 0
    empty = facts.select("lang").distinct().select("lang", *[F.array().cast(f.split(" ")[1]).alias(f.split(" ")[0]) for f in BLOCK.split(", ")[1:]])
    rows = _met(blocks.unionByName(empty), duos, ["lang"], F.col("terms"), 256)

    def dense(row: dict, side: str) -> np.ndarray:
        place = {s: i for i, s in enumerate(row[f"names_{side}"])}
        column = np.array([place.get(s, -1) for s in row["names"]], np.int64)
        out = np.zeros((len(row["terms"]), len(place)), np.int64)
        if row["terms"]:
            at = column[np.array(row["source_at"], np.int64)]
            inside = at >= 0
            out[np.array(row["term_at"], np.int64)[inside], at[inside]] = np.array(row["counts"], np.int64)[inside]
        return shares(out, np.array(row[f"weights_{side}"], np.int64)) if len(out) else out

    def build(batches):
        held: dict[tuple, tuple] = {}

        def sums() -> Iterator[pa.RecordBatch]:
            for (lang, one_, other), (names_a, names_b, total) in held.items():
                i, j = np.triu_indices(len(names_a), 1) if one_ == other else (x.ravel() for x in np.indices(total.shape))
                if len(i):
                    columns = [pa.array([lang] * len(i)), pa.array(names_a).take(pa.array(i)), pa.array(names_b).take(pa.array(j)), pa.array(total[i, j])]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "item", "value"])
            held.clear()

        for batch in batches:
            for row in batch.to_pylist():
                key = (row["lang"], row["side_a"], row["side_b"])
                if key not in held:
                    if len(held) == 64:
                        yield from sums()
                    held[key] = (row["names_a"], row["names_b"], np.zeros((len(row["names_a"]), len(row["names_b"])), np.int64))
                total = held[key][2]
                a, b = dense(row, "a"), dense(row, "b")
                step = max(1, (1 << 20) // total.size)
                for k in range(0, len(a), step):
                    total += np.abs(a[k : k + step, :, None] - b[k : k + step, None, :]).sum(axis=0)
        yield from sums()

    found = rows.mapInArrow(tidy(build), "lang string, source string, item string, value long")
    return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """How the sources of a language differ: lang, source, part, item, value and rank.

    Part ``pair`` has each other source and the sum of the differences of shares over all
    terms in at least ``least`` documents of the language; part ``term`` the terms that the
    source has and uses more than the language does, to rank ``top``.  Ranks go by value,
    the largest first, then by the bytes of the item.

    A null text, language or source is an empty one.  A source without terms, and a language
    without kept ones, has its pairs; the only source of a language has none.  Rows that
    repeat count as often; other columns make no difference; an empty table gives no rows.
    A task holds the numbers of all words of its longest text besides its tries.
    """
    groups = cut(docs.select(named("lang"), named("source")).distinct())
    blocks = cut(merge_tries(cut(count_terms(docs, frequent_terms(docs, least))), least))
    cells = blocks.select("lang", "terms", "sums", "names", F.explode(F.arrays_zip("term_at", "source_at", "counts")).alias("c"))
    cells = cells.select("lang", F.expr("terms[c.term_at]").alias("item"), F.expr("sums[c.term_at]").alias("all"), F.expr("names[c.source_at]").alias("source"), F.col("c.counts").alias("count"))
    totals = cells.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    sizes = blocks.groupBy("lang").agg(F.sum(F.size("terms")).alias("terms"), F.sum(F.expr("aggregate(sums, 0L, (a, x) -> a + x)")).alias("lang_total"))
    facts = groups.join(totals, ["lang", "source"], "left").join(small_side(sizes, 1 << 17), "lang", "left").na.fill(0, ["total", "terms", "lang_total"])
    facts = cut(facts.select("lang", "source", (F.col("total") + ADDED * F.col("terms")).alias("weight"), (F.col("lang_total") + ADDED * F.col("terms")).alias("lang_weight")))

    half = pair_sums(blocks, facts.select("lang", "source", "weight"))
    pair = half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    more = _met(cells, facts, ["lang", "source"], F.col("item"), 1 << 17)
    more = more.select("lang", "source", "item", (_share("count", "weight") - _share("all", "lang_weight")).alias("value")).filter("value > 0")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    parts = [pair.withColumn("rank", rank), more.withColumn("rank", rank).filter(F.col("rank") <= top)]
    return parts[0].withColumn("part", F.lit("pair")).unionByName(parts[1].withColumn("part", F.lit("term"))).select("lang", "source", "part", "item", "value", "rank")
