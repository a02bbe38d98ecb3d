"""The most similar name of a sheet: an index of pairs of characters.

Two similarities bound how many pairs of neighbouring characters (with a space at either
end) two texts must share.  If a match has M characters of texts of a and b characters, the
others of one break at most two pairs each and those of the other one each, so of a + 1 pairs
3 M - a - b + 1 are left; with 2 M >= t (a + b) that is at least (1.5 t - 1)(a + b) + 1, which
is above 0 for any t from 2/3 on.  Sorting words changes no pair.

By that bound, texts meet at the *rarest* pairs of each (prefix filter), if their lengths
allow it and as many pairs can still follow (positional filter), and only what meets is
compared.  Thresholds come down in steps: who finds a name above a step needs none below it.

Names that are alike but for a number share their rarest pairs with many.  So short texts meet
first by equal *spellings*, with a character left out on both sides or two of the name; the
labels for which no other name can be as similar as the one found need no pairs at all.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from ..sources.shared import cut

#: Steps above the threshold asked for.
STEPS = (0.95, 0.88)
#: Different pairs (or words) whose counts are broadcast, and best names that a task holds.
COUNTS, HELD = 1 << 17, 100_000
#: Characters, and words where these are compared, of names that are spelt with less; labels
#: have two less, so that all names within reach are spelt.
SPELT, SPELT_WORDS = 32, 5


def _shuffled(df: DataFrame) -> DataFrame:
    """For a join whose side is never broadcast.  The planner takes spellings, pairs and words
    for as large as the texts that they are made of, which is hundreds of times too small."""
    return df.hint("merge")


def _small(df: DataFrame, most: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= most else _shuffled(df)


def _form(c: str, tokens: bool) -> Column:
    """What is compared: the text, or its different words in order."""
    if not tokens:
        return F.col(c)
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(c, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != ""))), " ")


def _pairs(c: str) -> Column:
    """Pairs of neighbouring characters, each with a number that tells repeats apart."""
    padded = F.concat(F.lit(" "), F.col(c), F.lit(" "))
    found = F.transform(F.sequence(F.lit(1), F.length(c) + 1), lambda i: F.substring(padded, i, F.lit(2)))
    number = lambda x, i: F.size(F.filter(F.slice(found, F.lit(1), i + 1), lambda y: y == x))
    return F.transform(found, lambda x, i: F.concat(x, number(x, i).cast("string")))


def _ranked(rows: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """``rows`` (key, token, and more) with ``at``: the place of the token among those of its
    key, the rarest in the sheet first."""
    met = rows.join(counts, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return met.withColumn("at", F.row_number().over(Window.partitionBy(key).orderBy("n", "token")) - 1).drop("n")


def _least(t: float, both: Column) -> Column:
    """Pairs that two texts of ``both`` characters together share at a similarity of t."""
    return F.greatest(F.ceil((1.5 * t - 1) * both + 1 - 1e-9), F.lit(1))


def _by_pairs(labels: DataFrame, names: DataFrame, t: float) -> DataFrame:
    """Label and name of all that may be similar as texts (label_norm, field_norm)."""

    def side(df: DataFrame, c: str) -> DataFrame:
        # a partner has at least so many characters
        prefix = F.col(f"{c}_len") + 1 - _least(t, F.col(f"{c}_len") * (1 + t / (2 - t))) + 1
        return df.filter(F.col(f"{c}_at") < prefix)

    met = side(labels, "l").join(_shuffled(side(names, "f")), "token")
    least = _least(t, F.col("l_len") + F.col("f_len"))
    near = 2 * F.least("l_len", "f_len") >= t * (F.col("l_len") + F.col("f_len")) - 1e-9
    follow = 1 + F.least(F.col("l_len") - F.col("l_at"), F.col("f_len") - F.col("f_at")) >= least
    return met.filter(near & follow).select("label_norm", "field_norm")


def _by_words(mine: DataFrame, theirs: DataFrame, t: float) -> DataFrame:
    """Those whose common words make up most of the left one (key, token, at, size: all its
    words with a space each, before: those of the words that are rarer)."""
    most = (F.col("size") - 1) * (2 - 2 * t) / (2 - t) + 1e-9
    return mine.filter(F.col("before") <= most).join(_shuffled(theirs), "token").select("label_norm", "field_norm")


def _words(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, F.explode(F.split("form", " ")).alias("token"))


def _counted(tokens: DataFrame) -> DataFrame:
    return _small(cut(tokens.groupBy("token").agg(F.count("*").alias("n"))), COUNTS)


def _weighed(tokens: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    weight = F.length("token") + 1
    w = Window.partitionBy(key)
    ranked = _ranked(tokens, key, counts)
    before = F.coalesce(F.sum(weight).over(w.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranked.withColumns({"before": before, "size": F.sum(weight).over(w)})


def _dealt(df: DataFrame, *by: str) -> DataFrame:
    """Rows for Python by their key: small rows that are long work stay in many tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _less(words: tuple) -> set[tuple]:
    """The words with a character less: one of a word, or the space between any two."""
    out = set()
    for n, word in enumerate(words):
        rest = words[:n] + words[n + 1 :]
        out.update(tuple(sorted((*rest, word[:i] + word[i + 1 :]))) for i in range(len(word)))
        out.update(tuple(sorted((*rest[:m], word + other, *rest[m + 1 :]))) for m, other in enumerate(rest))
    return out


def _spellings(form: str, tokens: bool, most: int) -> list[set[str]]:
    """The text with 0 to ``most`` characters left out; of words in any order."""
    if not tokens:
        return [set(map("".join, combinations(form, len(form) - k))) if k <= len(form) else set() for k in range(most + 1)]
    levels = [{tuple(form.split(" "))}]
    for _ in range(most):
        levels.append(set().union(*map(_less, levels[-1])))
    return [{" ".join(words) for words in level} for level in levels]


def _spelt(rows: DataFrame, key: str, tokens: bool, out: int) -> DataFrame:
    """id (a hash of the key), less (characters left out, up to ``out``) and spelling (a hash)
    of texts that are short enough."""

    def spell(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 500):
                part = frame.iloc[at : at + 500]
                levels = [level for form in part["form"] for level in _spellings(form, tokens, out)]
                sizes = [len(level) for level in levels]
                texts = np.array([t for level in levels for t in level], dtype=object)
                yield pd.DataFrame({
                    "id": np.repeat(np.repeat(part["id"].to_numpy(), out + 1), sizes), "less": np.repeat(np.tile(np.arange(out + 1), len(part)), sizes),
                    "spelling": pd.util.hash_array(texts, categorize=False).view("int64"),
                })

    short = rows.filter(F.length("form") <= SPELT - (2 - out) * 2)
    if tokens:
        short = short.filter(F.size(F.split("form", " ")) <= SPELT_WORDS - (2 - out) * 2)
    return _dealt(short.select(F.xxhash64(key).alias("id"), "form"), "id").mapInPandas(spell, "id long, less int, spelling long")


def _near(labels: DataFrame, names: DataFrame, tokens: bool) -> DataFrame:
    """Label and name of all short ones that are equal with up to one character left out on
    either side, or two of the name; hashes may bring others with them."""
    mine = _spelt(labels, "label_norm", tokens, 1).select("spelling", F.col("id").alias("l_id"), F.col("less").alias("l_less"))
    theirs = _spelt(names, "field_norm", tokens, 2).select("spelling", F.col("id").alias("f_id"), F.col("less").alias("f_less"))
    met = mine.join(_shuffled(theirs), "spelling").filter("f_less < 2 OR l_less = 0").select("l_id", "f_id").distinct()
    met = met.join(_shuffled(labels.select("label_norm", F.xxhash64("label_norm").alias("l_id"))), "l_id")
    return met.join(_shuffled(names.select("field_norm", F.xxhash64("field_norm").alias("f_id"))), "f_id").select("label_norm", "field_norm")


def _others(a: Column) -> Column:
    """What a label of ``a`` characters can have at most in common with a name that ``_near``
    does not bring: with M common characters one of a + b has 2 M / (a + b), and it lacks two
    of the label, or one and two of the name, or three of the name.  Common words alone lack
    a word and a space, which is the first case."""
    return F.greatest((a - 2) / F.greatest(a - 1, F.lit(1)), 2 * (a - 1) / (2 * a + 1), 2 * a / (2 * a + 3))


def _compare(pairs: DataFrame, threshold: float, tokens: bool) -> DataFrame:
    """label_norm, matched and score: the best of the pairs of each label.  A task keeps the
    best it has seen, and asks cheap bounds first."""

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple] = {}

        def given() -> pd.DataFrame:
            rows = [(label, name, score, -first) for label, (score, first, name) in held.items()]
            held.clear()
            return pd.DataFrame(rows, columns=["label_norm", "matched", "score", "first"])

        for frame in frames:
            for label, name, first in zip(frame["label_norm"], frame["field_norm"], frame["first"]):
                top = held.get(label, (threshold, float("-inf"), None))
                if tokens:
                    score = S.token_set_score(label, name)
                else:
                    match = difflib.SequenceMatcher(None, label, name)
                    if match.real_quick_ratio() < top[0] or match.quick_ratio() < top[0]:
                        continue
                    score = match.ratio()
                if (score, -first) >= top[:2]:
                    held[label] = (score, -first, name)
                    if len(held) > HELD:
                        yield given()
        if held:
            yield given()

    found = pairs.mapInPandas(best, "label_norm string, matched string, score double, first long")
    pick = F.max_by(F.struct("matched", "score"), F.struct("score", -F.col("first")))
    return found.groupBy("label_norm").agg(pick.alias("m")).select("label_norm", "m.matched", "m.score")


def closest(want: DataFrame, have: DataFrame, threshold: float, tokens: bool = False, overlap: bool = False) -> DataFrame:
    """label_norm, matched and score: for each label of ``want`` (distinct) the most similar
    of ``have`` (field_norm, first; distinct), of equals that with the smallest ``first``.

    Similarity is that of sequences, or with ``tokens`` of word sets (0 to 100), at least
    ``threshold``, which is above 2/3 of the scale.  With ``overlap`` both must have a
    significant word in common.  Blank labels and names meet nothing.
    """
    t = threshold / 100 if tokens else threshold
    if t <= 2 / 3:
        raise ValueError("thresholds up to two thirds say nothing about pairs of characters")
    labels = cut(want.filter("label_norm <> ''").select("label_norm", _form("label_norm", tokens).alias("form")).filter("form <> ''"))
    names = cut(have.filter("field_norm <> ''").select("field_norm", "first", _form("field_norm", tokens).alias("form")).filter("form <> ''"))
    out: list[DataFrame] = []
    open_ = lambda df: reduce(lambda d, done: d.join(_shuffled(done), "label_norm", "left_anti"), out, df)

    def compared(pairs: DataFrame, least: float) -> DataFrame:
        pairs = pairs.distinct().join(_shuffled(names.select("field_norm", "first")), "field_norm")
        if overlap:
            pairs = pairs.filter(F.arrays_overlap(T.significant_words("label_norm"), T.significant_words("field_norm")))
        return cut(_compare(_dealt(pairs, "label_norm"), least, tokens))

    def by_words(step: float) -> list[DataFrame]:
        return [_by_words(open_(heavy_labels), of_names, step), _by_words(heavy_names, open_(of_labels), step)]

    if tokens:
        of_names, of_labels = _words(names, "field_norm"), _words(labels, "label_norm")
        heavy_names = cut(_weighed(of_names, "field_norm", _counted(of_labels)))
        heavy_labels = cut(_weighed(of_labels, "label_norm", _counted(of_names)))
        out.append(compared(reduce(DataFrame.unionByName, by_words(1.0)), 100.0))
    near = compared(_near(cut(open_(labels)), names, tokens), threshold).join(_shuffled(labels.select("label_norm", "form", F.length("form").alias("len"))), "label_norm")
    served = (F.col("len") <= SPELT - 2) & (F.col("score") / (100 if tokens else 1) > _others(F.col("len")) + 1e-9)
    if tokens:
        served = served & (F.size(F.split("form", " ")) <= SPELT_WORDS - 2)
    out.append(cut(near.filter(served).select("label_norm", "matched", "score")))
    labels = cut(open_(labels))
    if labels.isEmpty():
        return reduce(DataFrame.unionByName, out)

    spread = lambda df, key: df.select(key, F.length("form").alias("len"), F.explode(_pairs("form")).alias("token"))
    as_side = lambda df, c: df.withColumnsRenamed({"len": f"{c}_len", "at": f"{c}_at"})
    counts = _counted(spread(names, "field_norm"))
    by_name = cut(as_side(_ranked(spread(names, "field_norm"), "field_norm", counts), "f"))
    by_label = cut(as_side(_ranked(spread(labels, "label_norm"), "label_norm", counts), "l"))
    for step in [s for s in STEPS if s > t] + [t]:
        found = [_by_pairs(open_(by_label), by_name, step)] + (by_words(step) if tokens else [])
        out.append(compared(reduce(DataFrame.unionByName, found), threshold if step == t else step * 100 if tokens else step))
    return reduce(DataFrame.unionByName, out)
