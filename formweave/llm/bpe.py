"""Byte-level BPE encoding and decoding with a pair occurrence index.

The distinct pre-tokens of a stretch of a partition are laid end to end as linked
symbols.  An index maps every mergeable pair to all its positions; the ranks of the
pairs that occur are taken from a heap in ascending order, each is applied at all its
positions, and the pairs that a merge creates are added to their lists.  Entries whose
pair has gone are skipped when their rank comes up.

A merge can create a pair of a lower rank than its own.  Within one word the lowest
rank must then come first, so such a word is encoded again on its own.

Encodings of words are held between batches, up to ``CACHE_WORDS`` of them; the first
``KEPT_WORDS``, among which are the frequent ones, outlive that and the task.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import operator
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import as_bytes, lean, tidy

#: Fixed value: the published pre-token pattern of byte-level BPE.  White space is the
#: Unicode property, without the separators U+001C-U+001F that Python's ``\s`` adds.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Words whose encodings a worker holds in a task and keeps between tasks, and bytes of
#: text encoded together.
CACHE_WORDS, KEPT_WORDS, STRETCH = 500_000, 150_000, 1 << 20


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: bytes that print stand for
    themselves, the others for the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairEncoder:
    """Encodes and decodes with one vocabulary in the tokenizers library's JSON."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        byte = byte_alphabet()
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.rank = {(vocab[a] << 20) | vocab[b]: r for r, (a, b) in reversed(list(enumerate(merges)))}
        self.made = [vocab[a + b] for a, b in merges]
        self.pairs = [(vocab[a], vocab[b]) for a, b in merges]
        self.first = [0] * 256
        for c, b in byte.items():
            self.first[b] = vocab[c]
        self.piece = {str(i): bytes(byte[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.piece |= {str(i): t.encode() for t, i in self.special.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = regex.compile(PATTERN)
        self.cache: dict[str, str] = {}
        self.decimal = [str(i) for i in range(max(map(int, self.piece)) + 1)]

    def pre_tokens(self, text: str) -> list[str]:
        """Pre-tokens in order; special tokens stand alone."""
        if self.split is None or not any(s in text for s in self.special):
            return self.pattern.findall(text)
        parts = self.split.split(text)
        return list(chain.from_iterable([p] if i % 2 else self.pattern.findall(p) for i, p in enumerate(parts)))

    def _greedy(self, symbols: list[int]) -> list[int]:
        """One word: the lowest rank first, the leftmost of equal ranks first.  Ranks wait
        in a heap, so a word of n bytes takes n log n steps."""
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = lambda i: self.rank.get((symbols[i] << 20) | symbols[after[i]]) if after[i] < n else None
        waiting = [(r, i) for i in range(n) if (r := rank(i)) is not None]
        heapq.heapify(waiting)
        while waiting:
            r, i = heapq.heappop(waiting)
            # what is no longer there, or has become another pair, is skipped
            if symbols[i] < 0 or rank(i) != r:
                continue
            j = after[i]
            symbols[i], symbols[j] = self.made[r], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (i, before[i]):
                if k >= 0 and (q := rank(k)) is not None:
                    heapq.heappush(waiting, (q, k))
        return [s for s in symbols if s >= 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Token ids of each word, by the pair occurrence index over all of them."""
        made, pairs, first, get = self.made, self.pairs, self.first, self.rank.get
        raw = [w.encode() for w in words]
        sym: list[int] = []
        starts = [0]
        for b in raw:
            sym.extend([first[x] for x in b])
            sym.append(-1)  # between words; it is in no pair
            starts.append(len(sym))
        after = list(range(1, len(sym) + 1))
        before = list(range(-1, len(sym) - 1))
        index: dict[int, list[int]] = {}
        for i, r in enumerate(map(get, map(operator.add, map((1 << 20).__mul__, sym), sym[1:]))):
            if r is not None:
                if r in index:
                    index[r].append(i)
                else:
                    index[r] = [i]
        active = list(index)
        heapq.heapify(active)
        again: set[int] = set()
        while active:
            r = heapq.heappop(active)
            places = index.pop(r)
            places.sort()
            new, (a, b) = made[r], pairs[r]
            high = new << 20
            for i in places:
                if sym[i] != a:
                    continue
                j = after[i]
                if sym[j] != b:
                    continue
                sym[i], sym[j] = new, -2
                after[i] = k = after[j]
                before[k] = i
                if (q := get(high + sym[k])) is not None:
                    if q < r:
                        again.add(i)
                    if q in index:
                        index[q].append(i)
                    else:
                        index[q] = [i]
                        heapq.heappush(active, q)
                h = before[i]
                if h >= 0 and (q := get((sym[h] << 20) + new)) is not None:
                    if q < r:
                        again.add(i)
                    if q in index:
                        index[q].append(h)
                    else:
                        index[q] = [h]
                        heapq.heappush(active, q)
        out = [[s for s in sym[a : b - 1] if s >= 0] for a, b in zip(starts, starts[1:])]
        for w in {bisect_right(starts, i) - 1 for i in again}:
            out[w] = self._greedy([first[x] for x in raw[w]])
        return out

    def encode(self, texts: list[str]) -> list[str]:
        """Ids of each text in decimal, joined by commas."""
        words = [self.pre_tokens(t) for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.shrink()
        fresh = list(set(chain.from_iterable(words)).difference(self.cache))
        special, text = [w for w in fresh if w in self.special], self.decimal
        for w, ids in zip(fresh, self.encode_words(fresh)):
            self.cache[w] = ",".join([text[i] for i in ids])
        for w in special:
            self.cache[w] = str(self.special[w])
        get = self.cache.__getitem__
        return [",".join(map(get, w)) for w in words]

    def shrink(self) -> None:
        if len(self.cache) > KEPT_WORDS:
            self.cache = dict(islice(self.cache.items(), KEPT_WORDS))

    def decode(self, ids: str) -> str:
        """Text of comma-joined ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.piece.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""


_LOADED: dict[str, BytePairEncoder] = {}


def _encoder(spec: str, key: str) -> BytePairEncoder:
    """One encoder for each worker, kept between tasks."""
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = BytePairEncoder(spec)
    return _LOADED[key]


def _stretches(texts: list[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= STRETCH:
            yield held
            held, size = [], 0
    if held:
        yield held


def _run(docs: DataFrame, vocabulary: str, schema: str, make, keep: bool) -> DataFrame:
    """Broadcasts the vocabulary (a file of fixed size) and encodes each batch.  Without
    ``keep`` a worker has nothing left of the encoder when its task is done."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = f.read()
    key = hashlib.sha256(spec.encode()).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast(spec)

    def build(batches):
        encoder = _encoder(sent.value, key)
        for batch in batches:
            ids: list[str] = []
            for held in _stretches(as_bytes(batch.column("text"))):
                ids += encoder.encode([t.decode() for t in held])
            yield make(encoder, batch, ids)
        if keep:
            encoder.shrink()
        else:
            _LOADED.clear()  # the worker goes on to something else

    return lean(docs).mapInArrow(tidy(build), schema)


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens and ids (array of int) of every row of ``docs``.

    A null text is the empty text and has no ids.  Repeated rows repeat; an empty table
    gives no rows; other columns are ignored.
    """

    def make(encoder, batch, ids):
        lists = [np.fromstring(x, np.int32, sep=",") for x in ids]
        sizes = np.array([len(x) for x in lists], np.int64)
        values = pa.array(np.concatenate(lists) if lists else np.empty(0, np.int32))
        packed = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), values)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), packed], names=["doc_id", "n_tokens", "ids"])

    return _run(docs.select("doc_id", "text"), vocabulary, "doc_id long, n_tokens long, ids array<int>", make, keep=False)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and text of every row of ``encoded`` (doc_id, ids); null ids: empty text."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = f.read()
    key = hashlib.sha256(spec.encode()).hexdigest()
    sent = encoded.sparkSession.sparkContext.broadcast(spec)

    def build(batches):
        encoder = _encoder(sent.value, key)
        for batch in batches:
            texts = [encoder.decode(",".join(map(str, x or ()))) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(build), "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Digests of the ids of every text and of what they decode to: doc_id, n_tokens,
    ids_sha256, decoded_sha256.  Rows as for ``encode``; the ids stay in the worker."""

    def make(encoder, batch, ids):
        n = pa.array([x.count(",") + 1 if x else 0 for x in ids], pa.int64())
        coded = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in ids])
        plain = pa.array([hashlib.sha256(encoder.decode(x).encode()).hexdigest() for x in ids])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), n, coded, plain], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _run(docs.select("doc_id", "text"), vocabulary, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make, keep=True)
