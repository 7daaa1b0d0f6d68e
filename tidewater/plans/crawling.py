"""A crawl that fetches: level by level from each site's root, within a budget of pages, and resumable."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.urls import absolute_url
from tidewater.operators import classifying
from tidewater.sources.fetch import Answer, Throttle, fetch, html_of, http_get
from tidewater.sources.html import page_scan
from tidewater.sources.staging import kept_at, staged

#: Requests (root, url, any more) to answers: the same rows with ``html``, null where there is no page.
Web = Callable[[DataFrame], DataFrame]


def live_web(get: Callable[[str], Answer] | None = None, throttle: Throttle = Throttle(), timeout: float = 20, journal: str | None = None) -> Web:  # noqa: B008 - frozen
    """Pages over HTTP: the requests of one site one after the other, as many sites at a time as the throttle allows."""

    def ask(requests: DataFrame) -> DataFrame:
        answers = fetch(requests, get or http_get(timeout), "url", "root", throttle, journal=journal)
        return answers.select(*requests.columns, html_of().alias("html"))

    return ask


def stored_web(pages: DataFrame, url: str = "url", html: str = "html") -> Web:
    """Pages of an earlier crawl: a table of addresses and what they answered.

    Requests are staged, so that their size is known: pages that no one asks for are left out before any page is moved.
    """
    known = pages.select(F.col(url).alias("at_"), F.col(html).alias("html"))

    def ask(requests: DataFrame) -> DataFrame:
        wanted = staged(requests, "requests")
        hit = known.join(wanted.select(F.col("url").alias("at_")).distinct(), "at_")
        return wanted.join(hit, F.col("url") == F.col("at_"), "left").select(*requests.columns, "html")

    return ask


@dataclass(frozen=True)
class Crawl:
    """visits: root, url, depth, visit, text, headings, links of each page seen; asked: root, url, depth, found of each request."""

    visits: DataFrame
    asked: DataFrame

    def stats(self) -> DataFrame:
        """root, pages_visited, pages_skipped (requests that brought no page)."""
        return self.asked.groupBy("root").agg(F.count_if("found").alias("pages_visited"), F.count_if(~F.col("found")).alias("pages_skipped"))


def _links(pages: DataFrame) -> DataFrame:
    """Crawlable links (root, url, at) of scanned pages; ``at`` is where a queue would have them."""
    found = pages.select("root", F.col("url").alias("base"), "visit", F.posexplode("links").alias("pos", "link"))
    resolved = found.withColumn("url", absolute_url(F.col("base"), F.col("link.href")))
    wanted = (F.col("link.href") != "") & classifying.is_crawlable(F.col("link.href"), F.col("url"), F.col("root"))
    return resolved.where(wanted).groupBy("root", "url").agg(F.min(F.struct("visit", "pos")).alias("at"))


def _numbered(rows: DataFrame, order: Column) -> DataFrame:
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("root").orderBy(order, "url")))


def _asked(queue: DataFrame, level: DataFrame | None, scans: DataFrame | None, web: Web, depth: int, max_pages: int) -> DataFrame:
    """One round: the urls of the queue that weren't asked in this level, as far as each site's budget goes, with what they answered, parsed and numbered."""
    open_ = queue if level is None else queue.join(level.select("root", "url"), ["root", "url"], "left_anti")
    seen = F.lit(0)
    if scans is not None:
        open_, seen = open_.join(scans.where("found").groupBy("root").agg(F.count(F.lit(1)).alias("n")), "root", "left"), F.coalesce("n", F.lit(0))
    numbered = _numbered(open_.withColumn("before", seen.cast("long")), F.col("at"))
    # The first condition cuts each task's rows before the shuffle.
    batch = numbered.where((F.col("nth") <= max_pages) & (F.col("nth") <= max_pages - F.col("before"))).select("root", "url", "at", "before")
    found = F.col("html").isNotNull()
    parsed = web(batch).select("root", "url", "at", "before", F.lit(depth).alias("depth"), found.alias("found"), F.when(found, page_scan("html")).alias("scan"))
    nth = F.row_number().over(Window.partitionBy("root", "found").orderBy("at", "url"))
    visit = F.when(F.col("found"), F.col("before") + nth - 1)
    return parsed.select("root", "url", "at", "depth", "found", visit.alias("visit"), "scan.*")


def crawl_sites(roots: DataFrame, web: Web, max_depth: int = 3, max_pages: int = 80, state: str | None = None) -> Crawl:
    """Breadth-first from ``roots`` (root, url: the address to begin with), each url of a site once.

    A page that answers counts against the site's budget; a request without a page doesn't,
    so that a level is asked for in rounds: each takes as many urls, in the order of a queue, as
    the budget has left. Answers are parsed once and staged with their links before anything reads
    them. ``state``, a folder that driver and executors share, makes the crawl resumable: rounds that
    stand there are read instead of asked, so that a driver that starts again, with the same
    roots and limits, goes on where the last one stopped. Give ``live_web`` a journal for tasks that die inside a round.
    Rows without a root or url are left out; a site named twice is crawled once. ``max_pages`` below 1 visits nothing.
    """
    keep = (lambda df, name: kept_at(df, f"{state}/{name}")) if state else staged
    first = F.struct(F.lit(0).cast("long").alias("visit"), F.lit(0).alias("pos")).alias("at")
    queue = staged(roots.where("root IS NOT NULL AND url IS NOT NULL").groupBy("root", "url").agg(F.first(first).alias("at")), "queue")
    scans: DataFrame | None = None
    for depth in range(max_depth + 1):
        level: DataFrame | None = None
        for n in range(max_pages + 1):
            said = keep(_asked(queue, level, scans, web, depth, max_pages), f"round-{depth}-{n}")
            scans = said if scans is None else scans.unionByName(said)
            if said.isEmpty():
                break
            level = said if level is None else level.unionByName(said)
        if level is None or depth == max_depth:
            break
        named = _links(scans.where(F.col("found") & (F.col("depth") == depth)))
        queue = staged(named.join(scans.select("root", "url"), ["root", "url"], "left_anti"), "queue")
    return Crawl(scans.where("found").select("root", "url", "depth", "visit", "text", "headings", "links"), scans.select("root", "url", "depth", "found"))
