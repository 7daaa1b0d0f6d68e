"""The crawl that fetches: the visits of a crawl over known links, each address asked once, through lost tasks and restarts."""

import os
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidewater.operators import relational
from tidewater.plans import crawling
from tidewater.sources.fetch import Throttle, fetch
from tidewater.sources.journal import Journal

NO_PAUSE = Throttle(2, 0, 0)


def site(n, seed, sites=3):
    """{url: html} of pages whose links are known, and those links."""
    rng = random.Random(seed)
    at = lambda k: f"https://w{k % sites}.example/p/{k}"
    pages, links = {}, []
    for k in range(n):
        targets = [rng.randrange(k % sites, n, sites) for _ in range(rng.randrange(6))]
        pages[at(k)] = "<p>page</p>" + "".join(f'<a href="/p/{t}">x</a>' for t in targets)
        links += [(at(k), pos, at(t)) for pos, t in enumerate(targets)]
    return pages, links, [(at(k), at(k)) for k in range(sites)]


def visits(df):
    return sorted((r.root, r.url, r.depth, r.visit) for r in df.select("root", "url", "depth", "visit").collect())


@pytest.mark.parametrize("budget", [6, 1000])
def test_same_visits_as_over_known_links(spark, budget):
    pages, links, roots = site(36, budget)
    web = crawling.stored_web(spark.createDataFrame(list(pages.items()), "url string, html string"))
    starts = spark.createDataFrame([*roots, *roots, (None, None)], "root string, url string")
    crawled = crawling.crawl_sites(starts, web, max_depth=2, max_pages=budget)
    known = relational.crawl(spark.createDataFrame(roots, "root string, url string"), spark.createDataFrame(links, "url string, pos int, target string"), 2, budget)
    assert visits(crawled.visits) == visits(known)
    assert {r.root: r.pages_visited for r in crawled.stats().collect()} == {r.root: r["count"] for r in known.groupBy("root").count().collect()}


def test_missing_pages_cost_no_budget(spark):
    html = "".join(f'<a href="/{k}">x</a>' for k in ("gone1", "gone2", "a", "gone3", "b", "c", "file.pdf")) + '<a href="mailto:x@y.z">m</a><a href="https://other.example/a">o</a>'
    pages = {"https://h.example/": html, **{f"https://h.example/{k}": f"<h1>{k}</h1>" for k in "abc"}}
    web = crawling.stored_web(spark.createDataFrame(list(pages.items()), "url string, html string"))
    crawled = crawling.crawl_sites(spark.createDataFrame([("https://h.example/", "https://h.example/")], "root string, url string"), web, max_pages=3)
    assert [(r.url[-1], r.visit) for r in crawled.visits.orderBy("visit").collect()] == [("/", 0), ("a", 1), ("b", 2)]
    asked = {r.url.rsplit("/", 1)[-1] for r in crawled.asked.collect()}
    assert asked == {"", "gone1", "gone2", "a", "gone3", "b"}  # c is beyond the budget
    assert crawled.stats().head()[1:] == (3, 3)


def test_nothing_to_crawl(spark):
    empty = spark.createDataFrame([], "root string, url string")
    web = crawling.stored_web(spark.createDataFrame([], "url string, html string"))
    for roots, budget in ((empty, 5), (spark.createDataFrame([("https://h/", "https://h/")], "root string, url string"), 0)):
        crawled = crawling.crawl_sites(roots, web, max_pages=budget)
        assert crawled.visits.count() == 0 and crawled.visits.columns == ["root", "url", "depth", "visit", "text", "headings", "links"]
    assert crawling.crawl_sites(spark.createDataFrame([("https://h/", "https://h/")], "root string, url string"), web).stats().head()[1:] == (0, 1)


def counted(folder, pages, fail=None):
    """Answers from ``pages``; notes each request in a file, and breaks at ``fail`` the first time."""

    def get(url):
        mark = f"{folder}/broken"
        if url == fail and not os.path.exists(mark):
            open(mark, "w").close()
            os._exit(1)
        with open(f"{folder}/asked", "a") as f:
            f.write(url + "\n")
        return (200, "text/html", pages[url].encode()) if url in pages else (404, "text/html", b"")

    return get


def test_a_new_driver_goes_on_where_the_last_one_stopped(spark, tmp_path):
    pages, links, roots = site(36, 4)
    starts = spark.createDataFrame(roots, "root string, url string")
    known = visits(relational.crawl(starts, spark.createDataFrame(links, "url string, pos int, target string"), 2, 30))
    middle = next(u for _, u, depth, _ in known if depth == 2)
    web = lambda: crawling.live_web(counted(str(tmp_path), pages, middle), NO_PAUSE, journal=f"file://{tmp_path}/journal")
    with pytest.raises(Exception, match="(?i)worker|abort|exit"):
        crawling.crawl_sites(starts, web(), max_depth=2, max_pages=30, state=f"file://{tmp_path}/state")
    crawled = crawling.crawl_sites(starts, web(), max_depth=2, max_pages=30, state=f"file://{tmp_path}/state")
    assert visits(crawled.visits) == known
    asked = (tmp_path / "asked").read_text().split()
    assert len(asked) == len(set(asked)) == crawled.asked.count()
    again = crawling.crawl_sites(starts, web(), max_depth=2, max_pages=30, state=f"file://{tmp_path}/state")
    assert visits(again.visits) == known and (tmp_path / "asked").read_text().split() == asked


def test_a_lost_task_asks_for_nothing_twice(tmp_path):
    """A session that retries tasks: a worker dies among the requests of a site, and the task starts again."""
    script = f"""
import sys
sys.path.insert(0, {str(Path(__file__).parent.parent)!r})
from pyspark.sql import SparkSession
from tests.test_crawling import counted, site
from tidewater.plans import crawling
from tidewater.sources.fetch import Throttle
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
pages, links, roots = site(9, 6, 1)
get = counted({str(tmp_path)!r}, pages, links[-1][2])
crawled = crawling.crawl_sites(spark.createDataFrame(roots, "root string, url string"), crawling.live_web(get, Throttle(2, 0, 0), journal="file://{tmp_path}/journal"), max_pages=100, max_depth=3)
print("ASKED", crawled.asked.count(), crawled.visits.where("url = '" + links[-1][2] + "'").count())
"""
    run = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=300, cwd=Path(__file__).parent.parent)
    said = next(x for x in run.stdout.splitlines() if x.startswith("ASKED")).split()
    asked = (tmp_path / "asked").read_text().split()
    assert (tmp_path / "broken").exists() and said[2] == "1"
    assert len(asked) == len(set(asked)) == int(said[1])


def test_journal_keeps_answers_and_errors(spark, tmp_path):
    folder = f"file://{tmp_path}/kept"
    calls = tmp_path / "calls"

    def get(url):
        with calls.open("a") as f:
            f.write(url)
        if url == "b":
            raise TimeoutError(url)
        return 200, "text/html", url.encode() * 3

    requests = spark.createDataFrame([("a", "i"), ("b", "i"), (None, "i")], "url string, insurer_id string")
    first, second = (sorted(map(repr, fetch(requests, get, throttle=NO_PAUSE, journal=folder).collect())) for _ in range(2))
    assert first == second and sorted(calls.read_text()) == ["a", "b"]
    assert Journal(folder).read("a") == (200, "text/html", b"aaa", None) and Journal(folder).read("b")[3] == "TimeoutError: b"
    assert Journal(folder).read("c") is None
    assert fetch(requests, get, throttle=NO_PAUSE).where(F.col("content").isNotNull()).count() == 1
