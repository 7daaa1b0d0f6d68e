"""A stored web moves only the pages that are asked for."""

from pyspark.sql import functions as F

from tidewater.plans.crawling import stored_web
from tidewater.sources.html import table_rows


def test_only_pages_that_are_asked_for_move(spark):
    pages = spark.range(5000).select(F.concat(F.lit("u"), "id").alias("url"), F.repeat(F.lit("x"), 100).alias("html"))
    requests = spark.createDataFrame([("a", "u7"), ("b", "u7"), ("b", "none"), ("c", None)], "root string, url string")
    answers = stored_web(pages)(requests)
    assert sorted((r.root, r.url or "", r.html is not None) for r in answers.collect()) == [("a", "u7", True), ("b", "none", False), ("b", "u7", True), ("c", "", False)]
    assert "BroadcastHashJoin" in answers._jdf.queryExecution().executedPlan().toString()


def test_rows_of_a_table_do_not_carry_the_table(spark):
    rows = "".join(f"<tr><td>{n}</td></tr>" for n in range(50))
    page = spark.createDataFrame([(f"<table id='x'><thead><tr><th>A</th></tr></thead><tbody>{rows}</tbody></table>",)], "html string")
    found = table_rows(page, "x", strict=True)
    assert sorted(int(r.cells["A"]) for r in found.collect()) == list(range(50))
    [generate] = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Generate" in line]
    assert "_t#" not in generate
