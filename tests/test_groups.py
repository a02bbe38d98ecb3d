"""Groups of options against holding every text against every group."""

import random
import re

from formweave.operators import options as P


def norm(t):
    t = " ".join(t.split()).lower()
    return re.sub(r"[!-/:-@\[-`{-~]", "", t)


def loop(fields, groups):
    out = []
    for n, text in fields:
        t, hits = norm(text), []
        for labels in groups:
            own = [norm(x) for x in labels]
            if len(labels) < 2 or not any(own):
                continue
            at = 0
            for x in own:
                at = t.find(x, at)
                if at < 0:
                    break
                at += len(x)
            if at >= 0 or t.replace(" ", "") == "".join(own).replace(" ", ""):
                hits.append(("".join(own), labels))
        out += [(n, x) for x in min(hits)[1]] if hits else [(n, text)]
    return sorted(out)


def test_any_number_of_groups(spark):
    rng = random.Random(7)
    words = ["annual", "report", "tax", "form", "a", "b", "no", "K-1", "letter", "of", "zu", "§"]
    label = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 2))).title()
    groups = [[label() for _ in range(rng.randint(1, 3))] for _ in range(250)] + [["a", "b"], ["-", "!"], ["zu", "§"]] + [[f"One thing {i}", f"other {i}"] for i in range(11_000)]
    fields = [(i, rng.choice(["", "Send: ", "Notice of "]) + ", ".join(label() for _ in range(rng.randint(0, 4)))) for i in range(250)]
    fields += [(900, "one thing 10999 and other 10999"), (901, "AnnualReport Tax"), (902, ""), (903, "one thing 5 other 6")]
    got = P.group_rows(spark.createDataFrame(fields, "row_no long, Field string"), spark.createDataFrame([(g,) for g in groups], "labels array<string>"))
    assert sorted(map(tuple, got.collect())) == loop(fields, groups)


def test_no_groups(spark):
    fields = spark.createDataFrame([(1, "x")], "row_no long, Field string")
    assert [tuple(r) for r in P.group_rows(fields, spark.createDataFrame([], "labels array<string>")).collect()] == [(1, "x")]


def test_pieces_of_texts_are_never_broadcast(spark, tmp_path, monkeypatch):
    """A small table of texts has many more pieces: it was the side that was broadcast."""
    spark.range(3000).selectExpr("id AS row_no", "concat('Customer ', id, IF(id % 10 = 0, ' annual report, tax form', '')) AS Field").write.parquet(str(tmp_path / "t"))
    fields = spark.read.parquet(str(tmp_path / "t"))
    groups = spark.createDataFrame([(["Annual report", "Tax form"],)], "labels array<string>")
    rows = None
    for most in (P.GROUPS, 0):
        monkeypatch.setattr(P, "GROUPS", most)
        got = P.group_rows(fields, groups)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert ("rightHint=(strategy=broadcast)" in plan) == bool(most) and ("leftHint=(strategy=merge)" in plan) == (not most)
        rows = rows or sorted(map(tuple, got.collect()))
        assert sorted(map(tuple, got.collect())) == rows and len(rows) == 3300
