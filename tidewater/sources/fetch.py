"""Fetching over HTTP as a DataFrame operator: few tasks at a time, a pause before each request, and errors as data."""

from __future__ import annotations

import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.sources.files import MAX_BYTES
from tidewater.sources.journal import Entry, Journal

#: Status, content type and body of an answer.
Answer = tuple[int, str, bytes]
AGENT = "Mozilla/5.0 (compatible; tidewater)"


@dataclass(frozen=True)
class Throttle:
    """At most ``parallel`` requests at a time, and none for one group while another of it runs; seconds of pause before each, drawn evenly."""

    parallel: int = 2
    least: float = 1.5
    most: float = 4.0

    def __post_init__(self) -> None:
        if self.most < self.least:
            raise ValueError("the longest pause must not be shorter than the shortest")

    def wait(self) -> None:
        if self.most > 0:
            time.sleep(random.uniform(self.least, self.most))


def http_get(timeout: float = 30, most: int = MAX_BYTES) -> Callable[[str], Answer]:
    """A plain GET, of ``file:`` addresses too. Bodies are read only as far as it takes to see that they are too large."""

    def get(url: str) -> Answer:
        request = urllib.request.Request(url, headers={"User-Agent": AGENT})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310
                return answer.status or 200, answer.headers.get("Content-Type", ""), answer.read(most + 1)
        except urllib.error.HTTPError as error:
            return error.code, error.headers.get("Content-Type", ""), b""

    return get


def fetch(requests: DataFrame, get: Callable[[str], Answer] | None = None, url: str = "url", group: str = "insurer_id", throttle: Throttle = Throttle(), most: int = MAX_BYTES, journal: str | None = None) -> DataFrame:  # noqa: B008 - frozen
    """``requests`` with status, content_type, content and error.

    A group's requests are in one task, one after the other; there are as many tasks as may run
    in parallel. Answers other than 2xx, bodies of more than ``most`` bytes, and what ``get`` raises
    have an error and no content. A null or empty url isn't asked for. With ``journal``, a folder
    that all executors share, each answer is kept there as soon as it is there: a task that starts
    again, and any later action, takes it from the folder, without a pause.
    """
    ask = get or http_get(most=most)
    added = [T.StructField("status", T.IntegerType()), T.StructField("content_type", T.StringType()), T.StructField("content", T.BinaryType()), T.StructField("error", T.StringType())]
    schema = T.StructType([*requests.schema.fields, *added])

    kept = Journal(journal) if journal else None

    def one(address: str | None) -> Entry:
        if not address:
            return None, None, None, "no address"
        answer = kept.read(address) if kept else None
        if answer is None:
            answer = asked(address)
            if kept:
                kept.write(address, answer)
        return answer

    def asked(address: str) -> Entry:
        throttle.wait()
        try:
            status, kind, body = ask(address)
        except Exception as error:  # noqa: BLE001 - a failed request is data
            return None, None, None, f"{type(error).__name__}: {error}"
        if not 200 <= status < 300:
            return status, kind, None, f"status {status}"
        return (status, kind, None, "too large") if len(body) > most else (status, kind, body, None)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            answers = [one(x) for x in part[url]]
            yield part.assign(**{f.name: pd.Series([a[i] for a in answers], index=part.index, dtype=object) for i, f in enumerate(added)})

    return requests.repartition(throttle.parallel, group).mapInPandas(run, schema)


def html_of(content_type: str = "content_type", content: str = "content") -> Column:
    """The answer's text, null where it isn't HTML."""
    return F.when(F.lower(content_type).contains("text/html"), F.decode(content, "UTF-8"))


def strict(answers: DataFrame) -> DataFrame:
    """The same answers, but any error among them fails the job."""
    return answers.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.concat_ws(" ", "error", F.lit("in a fetch"))).cast("string")))
