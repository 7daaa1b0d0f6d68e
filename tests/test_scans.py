"""Trees of pages don't outlive their page."""

import gc

from pyspark.sql import functions as F

from tidewater.sources import html as H


def test_trees_go_with_their_page():
    gc.collect()
    gc.disable()
    try:
        for n in range(20):
            assert H.scan(f"<div><h2>A {n} <a href='/x'>b</a></h2><p>c</p></div>")["text"] == f"A {n} b c"
        assert sum(isinstance(x, H.Node) for x in gc.get_objects()) == 0
    finally:
        gc.enable()


def test_scans_in_chunks(spark):
    pages = spark.range(3 * H.CHUNK + 5).repartition(1).select("id", F.concat(F.lit("<h1>t"), "id", F.lit("</h1><a href='/"), "id", F.lit("'>l</a>")).alias("html"))
    rows = pages.select("id", H.page_scan("html").alias("s")).collect()
    assert len(rows) == 3 * H.CHUNK + 5 and all(r.s.headings[0].title == f"t{r.id}" and r.s.links[0].href == f"/{r.id}" for r in rows)
