"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

The symbols of a word wait in an agenda: every adjacent pair whose concatenation is a
piece is an entry, entries come up by score and, at equal scores, from left to right.  An
entry whose symbols have changed since is skipped; the others merge and enter the pairs
that they make.  What is left are the pieces of the word, and a symbol that is no piece
goes as its bytes.

A text is cut into words where no piece can reach across (before a space that follows
something else, and between characters that no piece has side by side), so words are encoded
once however often they occur, and a cut never changes the ids.

``compare`` holds the ids of whole texts against the sentencepiece library in the same Arrow
batches, and ``round_trip`` does so for every word that a batch has first.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import operator
import struct
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from .bpe import _stretches as stretches
from .common import as_bytes, lean, tidy

# The space mark of the format, and its codes of piece types.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

#: Words whose encodings a worker holds, those that it keeps between tasks, and characters
#: of the longest word that is held at all.
CACHE_WORDS, KEPT_WORDS, LONG_WORD = 500_000, 350_000, 256

# The format replaces each byte that is part of no character, not each run of them.
codecs.register_error("formweave-bytewise", lambda e: ("�", e.start + 1))


def message(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message, in order."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            i, shift = i + 1, shift + 7
            if data[i - 1] < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        wire = key & 7
        if wire == 0:
            value, i = varint(i)
        else:
            n = 8 if wire == 1 else 4
            if wire == 2:
                n, i = varint(i)
            value, i = data[i : i + n], i + n
        yield key >> 3, value


class PieceEncoder:
    """Encodes and decodes with one model file."""

    def __init__(self, model: bytes):
        spec: list[tuple[int, int | bytes]] = list(message(model))
        entries = [dict(message(v)) for f, v in spec if f == 1]
        trainer = dict(next((message(v) for f, v in spec if f == 2), ()))
        rules = dict(next((message(v) for f, v in spec if f == 3), ()))
        if trainer.get(3, 1) != 2:
            raise ValueError("the vocabulary is not of the merge type")
        self.fallback = bool(trainer.get(35, 0))
        self.unknown_surface = trainer.get(44, b" \xe2\x81\x87 ").decode()
        self.prefix, self.squeeze, self.escape = (bool(rules.get(f, 1)) for f in (3, 4, 5))
        self.suffix = bool(trainer.get(24, 0))
        pieces = [e[1].decode() for e in entries]
        kinds = [e.get(3, NORMAL) for e in entries]
        scores = [struct.unpack("<f", e[2])[0] if 2 in e else 0.0 for e in entries]
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        # what is not the plain rule is left to the library's own normaliser
        self.plain = not rules.get(2) and not self.squeeze and self.escape and not self.suffix
        order = {s: i for i, s in enumerate(sorted(set(scores), reverse=True))}
        mergeable = {i for i, k in enumerate(kinds) if k in (NORMAL, USER, UNUSED)}
        self.rank = {pieces[i]: order[scores[i]] for i in mergeable}
        self.unused = {pieces[i] for i, k in enumerate(kinds) if k == UNUSED}
        self.unknown = next((i for i, k in enumerate(kinds) if k == UNKNOWN), 0)
        self.ids = {pieces[i]: str(i) for i in mergeable} | {p: str(i) for i, (p, k) in enumerate(zip(pieces, kinds)) if k in (CONTROL, UNKNOWN)}
        self.byte = {int(p[3:5], 16): str(i) for i, (p, k) in enumerate(zip(pieces, kinds)) if k == BYTE}
        surface = {CONTROL: b"", UNKNOWN: self.unknown_surface.encode()}
        self.surface = {str(i): bytes([int(p[3:5], 16)]) if k == BYTE else surface.get(k, p.replace(MARK, " ").encode()) for i, (p, k) in enumerate(zip(pieces, kinds))}
        self.leads = {str(i) for i, (p, k) in enumerate(zip(pieces, kinds)) if p.startswith(MARK) and k in (NORMAL, USER, UNUSED)}
        self.silent = {str(i) for i, k in enumerate(kinds) if k == CONTROL}
        self.user = {pieces[i] for i in mergeable if kinds[i] == USER}
        self.touching = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        self.whole = regex.compile("(" + "|".join(map(regex.escape, sorted(self.user, key=len, reverse=True))) + ")") if self.user else None
        # no piece reaches across a space that follows something else
        self.by_word = self.plain and self.prefix and not self.user and not any(a != MARK and b == MARK for a, b in self.touching)
        self.cache: dict[str, str] = {}
        self.parts: dict[str, str] = {}
        self.wrong: set[str] = set()

    def split(self, text: str) -> list[str]:
        """Words of a text, each without the space mark before it: what is between single
        spaces, with the spaces beyond the first of a run in front."""
        if not text:
            return []
        if not self.by_word:
            return [text]
        words = text.replace(MARK, " ").split(" ")
        if "" not in words:
            return words
        out, run = [], 0
        for w in words:
            if w:
                out.append(" " * run + w)
                run = 0
            else:
                run += 1
        # a run at the end is a word of spaces, which has a mark before it as any other
        return [*out, " " * (run - 1)] if run else out

    def normal(self, text: str) -> str:
        """The text as symbols see it."""
        if not self.plain:
            return self.library.normalize(text)
        return (MARK + text if self.prefix and text else text).replace(" ", MARK)

    def agenda(self, symbols: list[str], fixed: frozenset[int] = frozenset()) -> list[str]:
        """Pieces that the adjacent pairs of ``symbols`` merge to; those at ``fixed`` stay."""
        n, rank = len(symbols), self.rank.get
        numbers = list if n <= LONG_WORD else lambda x: array("q", x)
        after, before = numbers(range(1, n + 1)), numbers(range(-1, n - 1))
        waiting = [(r, i, p) for i, p in enumerate(map(operator.add, symbols, islice(symbols, 1, None))) if (r := rank(p)) is not None]
        if fixed:
            waiting = [x for x in waiting if x[1] not in fixed and x[1] + 1 not in fixed]
        heapq.heapify(waiting)
        # an unused piece is taken apart again as it was last entered
        made = {p: (symbols[i], symbols[i + 1]) for _, i, p in waiting if p in self.unused} if self.unused else {}
        while waiting:
            _, i, pair = heapq.heappop(waiting)
            j = after[i]
            # either symbol may have gone or grown since
            if not symbols[i] or j >= n or len(symbols[i]) + len(symbols[j]) != len(pair):
                continue
            symbols[i], symbols[j] = pair, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(p := pair + symbols[k])) is not None and k not in fixed:
                    heapq.heappush(waiting, (r, i, p))
                    if p in self.unused:
                        made[p] = (pair, symbols[k])
            h = before[i]
            if h >= 0 and (r := rank(p := symbols[h] + pair)) is not None and h not in fixed:
                heapq.heappush(waiting, (r, h, p))
                if p in self.unused:
                    made[p] = (symbols[h], pair)

        def apart(piece: str) -> Iterator[str]:
            if piece in self.unused and piece in made:
                for part in made[piece]:
                    yield from apart(part)
            else:
                yield piece

        left = [s for s in symbols if s]
        return [p for s in left for p in apart(s)] if made else left

    def encode_word(self, word: str) -> str:
        """Ids of one word (or text, if texts are not split) in decimal, joined by commas.  It
        is cut wherever no piece holds both neighbours, and the parts are encoded once, too."""
        word = MARK + word.replace(" ", MARK) if self.by_word else self.normal(word)
        if self.whole is not None:
            symbols, kept = [], []
            for i, part in enumerate(self.whole.split(word)):
                kept += [len(symbols)] if i % 2 else []
                symbols += [part] if i % 2 else part
            return ",".join(self._numbers(self.agenda(symbols, frozenset(kept))))
        touching, known, out, start = self.touching, self.parts.get, [], 0
        for i in range(1, len(word) + 1):
            if word[i - 1 : i + 1] in touching:
                continue
            part, start = word[start:i], i
            found = known(part)
            if found is None:
                found = ",".join(self._numbers(self.agenda(list(part))))
                if len(part) <= LONG_WORD:
                    self.parts[part] = found
            out.append(found)
        return ",".join(out)

    def _numbers(self, pieces: list[str]) -> list[str]:
        """Ids of pieces; what is no piece goes as bytes or as unknown."""
        out: list[str] = []
        for p in pieces:
            number = self.ids.get(p)
            if number is not None:
                out.append(number)
            elif self.fallback:
                out += [self.byte[b] for b in p.encode()]
            else:
                out.append(str(self.unknown))
        return out

    def _one_unknown(self, ids: str) -> str:
        """Neighbours that are unknown are one."""
        numbers, u = ids.split(","), str(self.unknown)
        return ",".join([n for i, n in enumerate(numbers) if n != u or i == 0 or numbers[i - 1] != u])

    def encode(self, texts: list[str], check: bool = False) -> list[str]:
        """Ids of each text in decimal, joined by commas.  With ``check`` the library encodes
        each new word, too, and those that it encodes otherwise are ``wrong``."""
        words = [self.split(t) for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.shrink()
        known, long = self.cache, {}
        fresh = list(set().union(*words).difference(known))
        for w in fresh:
            (long if len(w) > LONG_WORD else known)[w] = self.encode_word(w)
        if long:
            known = known | long
        if check:
            # the library gives an empty text no mark
            fresh = [w for w in fresh if w]
            self.wrong.update(w for w, same in zip(fresh, self.agrees(fresh, [known[w] for w in fresh])) if not same)
        get = known.__getitem__
        out = [",".join(map(get, w)) for w in words]
        return out if self.fallback else [self._one_unknown(x) for x in out]

    def sound(self, text: str) -> bool:
        """Whether the library agrees on every word of a text encoded with ``check``."""
        return not self.wrong or self.wrong.isdisjoint(self.split(text))

    def shrink(self) -> None:
        if len(self.cache) > KEPT_WORDS:
            self.cache = dict(islice(self.cache.items(), KEPT_WORDS))
        if len(self.parts) > KEPT_WORDS:
            self.parts = dict(islice(self.parts.items(), KEPT_WORDS))

    def decode(self, ids: str) -> str:
        """Text of comma-joined ids.  The space mark that the first piece begins with is
        the one put before the text, unless the model puts none there."""
        if not ids:
            return ""
        numbers = ids.split(",")
        data = b"".join(map(self.surface.__getitem__, numbers))
        if self.prefix or self.squeeze:
            for n in numbers:
                if n in self.silent:
                    continue
                if n in self.leads:
                    data = data[1:]
                # models that squeeze spaces drop all that a text begins with
                if not (self.squeeze and n in self.leads and self.surface[n] == b" "):
                    break
        return data.decode("utf-8", "formweave-bytewise")

    def agrees(self, texts: list[str], ids: list[str]) -> list[bool]:
        """Whether the library gives the same ids."""
        return [",".join(map(str, x)) == y for x, y in zip(self.library.encode(texts, num_threads=1), ids)]


_LOADED: dict[str, PieceEncoder] = {}


def _encoder(model: bytes) -> PieceEncoder:
    """One encoder for each worker, kept between tasks."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = PieceEncoder(model)
    return _LOADED[key]


def _run(rows: DataFrame, model: str, schema: str, make) -> DataFrame:
    """Broadcasts the model, a file of fixed size; ``make`` turns a batch into another."""
    with open(model, "rb") as f:
        sent = rows.sparkSession.sparkContext.broadcast(f.read())

    def build(batches):
        encoder = _encoder(sent.value)
        for batch in batches:
            yield make(encoder, batch)
        encoder.shrink()

    return lean(rows).mapInArrow(tidy(build), schema)


def _encoded(encoder: PieceEncoder, batch: pa.RecordBatch, then, check: bool = False) -> list:
    """``then`` of texts and their ids, by stretches of the batch, end to end."""
    out: list = []
    for held in stretches(as_bytes(batch.column("text"))):
        texts = [t.decode() for t in held]
        out += then(texts, encoder.encode(texts, check))
    return out


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens and ids (array of int) of every row of ``docs``, without begin or
    end ids.

    A null text is the empty text and has no ids.  Repeated rows repeat; an empty table
    gives no rows; other columns are ignored.  A word of n characters that cannot be cut
    takes n log n steps and about 150 bytes a character.
    """

    def make(encoder, batch):
        lists = [np.fromstring(x, np.int32, sep=",") for x in _encoded(encoder, batch, lambda texts, ids: ids)]
        sizes = np.array([len(x) for x in lists], np.int64)
        values = pa.array(np.concatenate(lists) if lists else np.empty(0, np.int32))
        packed = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), values)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), packed], names=["doc_id", "n_tokens", "ids"])

    return _run(docs.select("doc_id", "text"), model, "doc_id long, n_tokens long, ids array<int>", make)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of every row of ``encoded`` (doc_id, ids); null ids: empty text."""

    def make(encoder, batch):
        texts = [encoder.decode(",".join(map(str, x or ()))) for x in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return _run(encoded.select("doc_id", "ids"), model, "doc_id long, text string", make)


def compare(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and agrees of every row: whether the library gives the text the same ids."""

    def make(encoder, batch):
        same = _encoded(encoder, batch, encoder.agrees)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(same, pa.bool_())], names=["doc_id", "agrees"])

    return _run(docs.select("doc_id", "text"), model, "doc_id long, agrees boolean", make)


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """Digests of the ids of every text and of what they decode to, and whether the library
    gives all its words the same ids: doc_id, n_tokens, ids_sha256, decoded_sha256, agrees.
    Rows as for ``encode``; the ids stay in the worker."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()

    def make(encoder, batch):
        def digests(texts, ids):
            plain = [sha(encoder.decode(x)) for x in ids]
            return list(zip([x.count(",") + 1 if x else 0 for x in ids], map(sha, ids), plain, map(encoder.sound, texts)))

        cells = _encoded(encoder, batch, digests, check=True)
        n, coded, plain, same = zip(*cells) if cells else ((), (), (), ())
        columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(plain, pa.string()), pa.array(same, pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees"])

    return _run(docs.select("doc_id", "text"), model, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean", make)
