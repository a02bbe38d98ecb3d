"""The index of labels against comparing all pairs, and folding against unicodedata."""

import random
import unicodedata

import pytest

from formweave.functions import similarity as S
from formweave.operators import folding, lookup, similar
from formweave.plans import fill_plan


def texts(rng, n, words, least=1, most=5):
    out = set()
    while len(out) < n:
        t = " ".join(rng.choice(words) for _ in range(rng.randint(least, most)))
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(t) + 1)
            t = t[:i] + rng.choice(["", "x", "e", "é", "日"]) + t[i + rng.randint(0, 1) :]
        if t.strip():
            out.add(" ".join(t.split()))
    return sorted(out)


WORDS = "name of the investor address city bank account number no date birth tax residence contact phone a b aa abab".split()


def all_pairs(labels, names, score, least, allowed=lambda a, b: True):
    out = {}
    for label in labels:
        best = None
        for i, name in enumerate(names):
            s = score(label, name) if allowed(label, name) else -1
            if s >= least and (best is None or s > best[0]):
                best = (s, name)
        if best:
            out[label] = (best[1], best[0])
    return out


def frames(spark, labels, names):
    return spark.createDataFrame([(x,) for x in labels], "label_norm string").repartition(3), spark.createDataFrame([(n, i) for i, n in enumerate(names)], "field_norm string, first long").repartition(3)


@pytest.mark.parametrize("least", [0.68, 0.82, 0.97])
def test_sequences(spark, least):
    rng = random.Random(int(least * 100))
    labels, names = texts(rng, 220, WORDS), texts(rng, 180, WORDS)
    rng.shuffle(names)
    found = similar.closest(*frames(spark, labels + [""], names + [""]), least)
    assert {r.label_norm: (r.matched, r.score) for r in found.collect()} == all_pairs(labels, names, S.sequence_ratio, least)


def test_word_sets(spark):
    rng = random.Random(4)
    labels, names = texts(rng, 220, WORDS, 1, 7), texts(rng, 180, WORDS, 1, 7)
    rng.shuffle(names)
    found = similar.closest(*frames(spark, labels, names), 86.0, tokens=True)
    assert {r.label_norm: (r.matched, r.score) for r in found.collect()} == all_pairs(labels, names, S.token_set_score, 86.0)


def test_a_significant_word_in_common(spark):
    rng = random.Random(5)
    labels, names = texts(rng, 120, WORDS), texts(rng, 120, WORDS)
    long = lambda t: {w for w in t.split() if len(w) >= 3}
    found = similar.closest(*frames(spark, labels, names), 0.7, overlap=True)
    assert {r.label_norm: (r.matched, r.score) for r in found.collect()} == all_pairs(labels, names, S.sequence_ratio, 0.7, lambda a, b: bool(long(a) & long(b)))


def test_names_that_differ_in_a_number(spark):
    """A sheet of names that are all alike: of each label only few are compared."""
    names = [f"account field {i}" for i in range(3000)]
    labels = [f"acount field {i}" for i in range(0, 3000, 7)]
    want, have = frames(spark, labels, names)
    found = similar.closest(want, have, 0.82)
    assert {r.label_norm: r.matched for r in found.collect()} == {x: x.replace("acount", "account") for x in labels}
    both = lambda df, key: similar._ranked(df.selectExpr(key, f"{key} AS form").select(key, similar.F.length("form").alias("len"), similar.F.explode(similar._pairs("form")).alias("token")), key, counts)
    counts = similar._counted(have.select("field_norm", similar.F.explode(similar._pairs("field_norm")).alias("token")))
    a, b = both(want, "label_norm"), both(have, "field_norm")
    met = similar._by_pairs(a.withColumnsRenamed({"len": "l_len", "at": "l_at"}), b.withColumnsRenamed({"len": "f_len", "at": "f_at"}), 0.95)
    assert met.distinct().count() < len(labels) * len(names) / 10


@pytest.mark.parametrize("tokens", [False, True])
def test_short_texts_by_spellings(spark, tokens):
    """Few characters and many spaces: what the spellings settle is what comparing all says."""
    rng = random.Random(11)
    made = lambda n: sorted({" ".join("".join(rng.choice("aab  ") for _ in range(rng.randint(1, 12))).split()) for _ in range(n)} - {""})
    labels, names = made(260), made(200)
    rng.shuffle(names)
    least, score = (86.0, S.token_set_score) if tokens else (0.68, S.sequence_ratio)
    found = similar.closest(*frames(spark, labels, names), least, tokens=tokens)
    assert {r.label_norm: (r.matched, r.score) for r in found.collect()} == all_pairs(labels, names, score, least)


@pytest.mark.parametrize("tokens", [False, True])
def test_numbered_names_are_hardly_compared(spark, monkeypatch, tokens):
    """Labels whose rarest pairs are those of their number: before, each met hundreds of names."""
    names = [f"account field {i}" for i in range(2000)]
    labels = [f"{wrong} {i}" for i in range(0, 2000, 5) for wrong in ("account feild", "acount field")]
    met, compare = [], similar._compare
    monkeypatch.setattr(similar, "_compare", lambda pairs, *rest: met.append(pairs.count()) or compare(pairs, *rest))
    found = similar.closest(*frames(spark, labels, names), 86.0 if tokens else 0.82, tokens=tokens)
    assert {r.label_norm: r.matched for r in found.collect()} == {x: "account field " + x.split()[-1] for x in labels}
    assert sum(met) < 30 * len(labels)


def test_nothing_to_compare(spark):
    want, have = frames(spark, ["a b"], [])
    assert similar.closest(want, have, 0.82).count() == 0 and similar.closest(want, have, 86.0, tokens=True).count() == 0
    with pytest.raises(ValueError, match="two thirds"):
        similar.closest(want, have, 0.6)


ODD = ["Oﬃce No", "Ｎame", "plain", None, "", "№ 5", "㎏", "é", "é", "ａ（b）c", " x", "Ⅷ", "日本"]


@pytest.mark.parametrize("small", [True, False])
def test_folding(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(folding, "STRINGS", 0)
    rng = random.Random(3)
    rows = [(i, rng.choice(ODD), rng.choice(ODD)) for i in range(300)]
    got = folding.folded(spark.createDataFrame(rows, "i long, a string, b string"), "a", "b")
    form = lambda x: x and unicodedata.normalize("NFKC", x)
    assert got.columns == ["i", "a", "b"] and sorted(map(tuple, got.collect())) == [(i, form(a) if a is not None else None, form(b) if b is not None else None) for i, a, b in rows]


def test_folding_leaves_ascii_alone(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "i long, a string")
    assert folding.folded(rows, "a") is rows


def test_a_plan_folds_fields_and_sheet(spark):
    sheet = [(1, "Ｈome", None, "Office No", None, "12", None), (2, "", None, "Ｎame", None, "Ann", None), (3, "", None, "Ａmount（net）", None, "7", None)]
    sheet = spark.createDataFrame(sheet, "row_no long, Section string, Page string, Field string, Index string, Value string, Choices string")
    fields = spark.createDataFrame([(1, "Home", "Oﬃce No"), (2, "", "Name"), (3, "", "amount"), (4, "Ｈｏｍｅ", "Office No")], "field_no long, section string, label string")
    plan = {r.field_no: (r.label, r.value, r.rule) for r in fill_plan.fill_plan(sheet, fields, None).collect()}
    assert plan == {1: ("office no", "12", "exact section"), 2: ("name", "Ann", "exact label"), 3: ("amount", "7", "exact label"), 4: ("office no", "12", "exact section")}
    keys = {r.row_no: (r.field_norm, r.section_norm, r.Field) for r in lookup.with_keys(sheet).collect()}
    assert keys[1] == ("office no", "home", "Office No") and keys[3] == ("amountnet", "", "Ａmount（net）")


def test_later_keys_are_not_compared_without_need(spark, monkeypatch):
    """A field whose first key has a name asks nothing about its others, as it did before."""
    from formweave.operators import resolve

    asked, best = [], resolve.best_labels
    monkeypatch.setattr(resolve, "best_labels", lambda fields, *rest: asked.append({r.label_norm for r in fields.collect()}) or best(fields, *rest))
    sheet = spark.createDataFrame([(1, "bank account", "", None, None, "A"), (2, "home town", "", None, None, "B")], "row_no long, field_norm string, section_norm string, Page long, Index long, Value string")
    fields = [(1, "Bank Acount: the number", ""), (2, "Home Town: of birth", ""), (3, "See below: Home Tovn", "Note"), (4, "nothing like it", ""), (5, "Home: Town", "Hone Town"), (6, "", "")]
    fields = spark.createDataFrame(fields, "field_no long, label string, label_short string").selectExpr("*", "field_no AS emit_no", "CAST(NULL AS BIGINT) AS page", "'' AS section_norm", "'' AS placement")
    got = {r.field_no: (r.value, r.key_no, r.match) for r in resolve.resolve_keys(fields, sheet).collect()}
    assert got == {1: ("A", 0, "similar"), 2: ("B", 0, "exact"), 5: ("B", 0, "similar")}
    assert asked == [{"bank acount", "home town", "note", "nothing like it", "hone town"}, {"see below"}, {"see below home tovn"}]
