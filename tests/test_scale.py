"""Steps whose work must not grow faster than their input."""

import re

from formweave.operators import resolve as R
from formweave.plans import resolving

D = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(map(str, df.collect()))


def test_labels_of_few_rows_and_of_many_resolve_alike(spark, monkeypatch):
    few = _rows(resolving.resolve_cascade(spark, D)), _rows(resolving.resolve_keys(spark, D))
    monkeypatch.setattr(R, "ROWS", 4)  # most labels have six rows, the first and last fewer
    assert (_rows(resolving.resolve_cascade(spark, D)), _rows(resolving.resolve_keys(spark, D))) == few


def test_plan_shuffles_fields_a_few_times(spark):
    plan = resolving.flagship_fill_plan(spark, D)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 8 and "FlatMapGroupsInPandas" not in plan


def test_no_shuffle_for_few_answers(spark):
    from formweave.plans import choosing

    for query in (choosing.two_column_boxes, choosing.option_groups, choosing.tick_similar):
        plan = query(spark, D)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_sections_without_options_are_no_window(spark):
    from formweave.operators import options as P

    rows = spark.createDataFrame([(1, "Recipient 4", 1, "a", 0, ""), (2, "Recipient 4", 1, "b", 0, ""), (3, "Recipient 5", 1, "c", 7, ""), (4, None, None, "x", 8, ""), (5, "Other", 1, "y", 9, "")], "row_no long, Section string, Page long, Field string, Index long, Choices string")
    out = P.collapse_recipients(rows)
    assert {r["row_no"]: (r["Field"], r["Index"], r["Choices"]) for r in out.collect()} == {1: ("Recipient 4 – item 1", 4, "checkbox"), 2: ("Recipient 4 – item 2", 4, "checkbox"), 3: ("c", 7, ""), 4: ("x", 8, ""), 5: ("y", 9, "")}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan and "count(1) windowspecdefinition" not in plan


def test_pages_of_boxes_are_streamed(spark):
    from formweave.operators import occurrence as O

    rows = spark.createDataFrame([(1, 0, 1, "a", True, 0.0, 0.0), (1, 0, 2, "b", True, 0.4, 0.0), (1, 0, 3, "a", False, 0.0, 0.0), (1, 0, 4, "c", True, None, 0.0), (1, 0, 5, "d", True, None, 0.0), (2, 0, 6, "a", True, 0.0, 0.0)], "doc_id long, page long, emit_no long, k string, is_checkbox boolean, x0 double, y0 double")
    rows = rows.selectExpr("*", "x0 + 4 AS x1", "y0 + 4 AS y1", "'v' AS value")
    out = O.write_once_boxes(rows, ["doc_id", "page"], ["k"])
    assert sorted(r["emit_no"] for r in out.collect()) == [1, 4, 5, 6] and out.columns == rows.columns
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()


def test_longest_run_deals_lines_once(spark):
    from formweave.plans import placing

    plan = placing.longest_run(spark, D)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_similar_labels_and_their_sheet_are_not_broadcast(spark):
    from formweave.operators import similar

    labels = spark.createDataFrame([("acount 1", "acount 1")], "label_norm string, form string")
    names = spark.createDataFrame([("account 1", "account 1")], "field_norm string, form string")
    near = similar._near(labels, names, False)
    assert near.collect() == [("acount 1", "account 1")]
    words = similar._by_words(similar._weighed(similar._words(labels, "label_norm"), "label_norm", similar._counted(similar._words(names, "field_norm"))), similar._words(names, "field_norm"), 0.86)
    for df in (near, words.select("field_norm"), resolving.resolve_exact(spark, D), resolving.resolve_agent(spark, D), resolving.resolve_token_sets(spark, D)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and plan.count("BroadcastHashJoin") == (df.columns == ["field_norm"])  # counted words are


def test_stored_rows_leave_no_shuffle(spark):
    import time

    from formweave.sources.shared import stored

    files = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+\.data", spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().toString()))
    before = files()
    kept = stored(spark.range(1000).repartition(3, "id"))
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before and kept.count() == 1000


def test_label_on_the_left_looks_at_nothing_above(spark):
    from formweave.operators import spatial as P
    from formweave.plans.base import given

    slots, blocks = given(spark, D, "slots"), given(spark, D, "blocks")
    found = P.left_label(slots, blocks)
    assert found._jdf.queryExecution().executedPlan().toString().count("Join") == 1
    # slots of the query may share a number
    assert _rows(found) == _rows(P.nearest_label(slots, blocks).filter("how = 'row'").select("field_no", "label").distinct())
