"""The SentencePiece operator against the library, with the public model and changed ones."""

import hashlib
import random

import pytest
import sentencepiece

from formweave.llm import catalog, piece_bpe

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, agrees string, ids string"


def number(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(no, value):
    if isinstance(value, int):
        return number(no << 3) + number(value)
    wire = 5 if no == 2 and len(value) == 4 else 2
    return number(no << 3 | wire) + (number(len(value)) if wire == 2 else b"") + value


def changed(model, kinds=None, **flags):
    """The model with other types of some pieces and other settings of text or training."""
    out = b""
    for no, value in piece_bpe.message(model):
        if no == 1:
            entry = dict(piece_bpe.message(value))
            entry |= {3: kinds[entry[1].decode()]} if kinds and entry[1].decode() in kinds else {}
            value = b"".join(field(k, v) for k, v in entry.items())
        elif no == 3:
            value = b"".join(field(k, v) for k, v in (dict(piece_bpe.message(value)) | flags.get("rules", {})).items() if v != b"")
        elif no == 2 and "training" in flags:
            # a setting that comes again has the later value
            value += b"".join(field(k, v) for k, v in flags["training"].items())
        out += field(no, value)
    return out


@pytest.fixture(scope="module")
def model():
    with open(catalog.piece_model(), "rb") as f:
        return f.read()


def odd_texts(n=3000):
    rng = random.Random(1)
    parts = [" ", "  ", "▁", "a", "the", "hello", "\n", "\t", "é", "日", "𠮷", "\x00", ".", "1", "<s>", "<0x41>", "ing", "A", "́", "   ", "‍", "\x1c", "�", "and"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(n)]
    return [*texts, "", " ", "a" * 5000, "ab" * 3000, " " * 3001, "日" * 2000, "\n" * 50, "x" * 50000]


@pytest.mark.parametrize(
    "change",
    [
        {},
        {"kinds": {"▁the": 4, "hello": 4, "an": 4}},
        {"kinds": {"▁the": 5, "▁hel": 5, "the": 5, "ing": 5, "▁▁": 5}},
        {"kinds": {"▁the": 5, "and": 5, "in": 4}},
        {"rules": {3: 0}},
        {"rules": {4: 1}},
        {"rules": {3: 0, 4: 1}},
        {"training": {35: 0}, "kinds": {f"<0x{i:02X}>": 1 for i in range(256)}},
    ],
)
def test_ids_and_texts_are_the_librarys(model, change):
    model = changed(model, **change)
    encoder, library = piece_bpe.PieceEncoder(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = odd_texts()
    ids = encoder.encode(texts)
    want = library.encode(texts)
    assert [x for x, i, w in zip(texts, ids, want) if i != ",".join(map(str, w))] == []
    assert encoder.agrees(texts, ids) == [True] * len(texts)
    assert [encoder.decode(i) for i in ids] == library.decode(want)


def test_any_ids_decode_like_the_library(model):
    """Lone bytes, control and unknown pieces anywhere."""
    encoder, rng = piece_bpe.PieceEncoder(model), random.Random(2)
    lists = [[rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(259) for _ in range(rng.randrange(8))] for _ in range(5000)]
    lists += [[1, 2, 264], [2], [0, 264], [1, 5, 264], [259, 264]]
    assert [encoder.decode(",".join(map(str, x))) for x in lists] == encoder.library.decode(lists)


def test_words_are_given_up_and_encoded_again(model, monkeypatch):
    monkeypatch.setattr(piece_bpe, "CACHE_WORDS", 50)
    monkeypatch.setattr(piece_bpe, "KEPT_WORDS", 10)
    encoder, texts = piece_bpe.PieceEncoder(model), odd_texts(400)
    for at in range(0, len(texts), 40):
        some = texts[at : at + 40]
        assert all(encoder.agrees(some, encoder.encode(some)))


def test_a_wrong_id_is_seen(model, monkeypatch):
    encoder = piece_bpe.PieceEncoder(model)
    assert encoder.agrees(["a b", "c"], ["264,287", "1"]) == [True, False]
    encoder.encode(odd_texts(300), check=True)
    assert not encoder.wrong
    right = encoder.encode_word
    monkeypatch.setattr(encoder, "encode_word", lambda w: "5" if w == "bad" else right(w))
    encoder.encode(["some bad words", "good ones"], check=True)
    assert [encoder.sound(t) for t in ("some bad words", "good ones", "")] == [False, True, True]


def test_words_by_spaces(model):
    encoder = piece_bpe.PieceEncoder(model)
    for text in ["", " ", "  ", "a", " a", "a ", "a  b", "  a   b  ", "▁a▁▁b▁", "a\n b"]:
        assert "".join(piece_bpe.MARK + w.replace(" ", piece_bpe.MARK) for w in encoder.split(text)) == encoder.normal(text)


def test_only_merge_type_vocabularies(model):
    with pytest.raises(ValueError, match="merge type"):
        piece_bpe.PieceEncoder(changed(model, training={3: 1}))


def test_tables(spark, model):
    texts = [None, "", " ", "one", "one", "two words", *odd_texts(200)]
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)] + [(3, "one", "x", "y"), (None, "no id", None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    path = catalog.piece_model()
    encoded = piece_bpe.encode(docs, path)
    want = sorted(((i, tuple(library.encode(t or ""))) for i, t, *_ in rows), key=repr)
    assert sorted(((r.doc_id, tuple(r.ids)) for r in encoded.collect()), key=repr) == want
    assert sorted(((r.doc_id, r.text) for r in piece_bpe.decode(encoded, path).collect()), key=repr) == sorted(((i, library.decode(list(x))) for i, x in want), key=repr)
    assert {r.agrees for r in piece_bpe.compare(docs, path).collect()} == {True}
    none = spark.createDataFrame([], SCHEMA)
    assert [f(none, path).count() for f in (piece_bpe.encode, piece_bpe.compare, piece_bpe.round_trip)] == [0, 0, 0]


def test_query(spark, model):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        ids = library.encode(r.text or "")
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)), True))
    assert sorted(map(tuple, catalog.queries()["op11_sentence_piece_round_trip"](spark, DATA).collect())) == sorted(want)
