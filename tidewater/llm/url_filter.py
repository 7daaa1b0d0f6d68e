"""URL filters: a trie over reversed host labels and path segments, with longest-match precedence."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.shared import map_batches, own

#: Rules are broadcast as a trie while their text is at most so long; beyond, they are joined.
MAX_BROADCAST_CHARS = 32 << 20
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is a host, and from its first slash on a path prefix; ``action`` is allow or block."""

    action: str
    pattern: str

    @property
    def parts(self) -> tuple[str, str]:
        host, slash, path = self.pattern.partition("/")
        return host, slash + path

    @property
    def rank(self) -> tuple[int, int, str]:
        """The longest pattern wins, then the longer host; of one pattern listed both ways, block."""
        return len(self.pattern), len(self.parts[0]), self.action


@dataclass
class _Segment:
    """A path so far: whole segments lead on, and rules may end inside the next segment."""

    on: dict[str, _Segment] = field(default_factory=dict)
    ends: dict[str, Rule] = field(default_factory=dict)
    lengths: list[int] = field(default_factory=list)


@dataclass
class _Label:
    on: dict[str, _Label] = field(default_factory=dict)
    paths: _Segment | None = None


class UrlTrie:
    def __init__(self, rules: Iterable[Rule]):
        self.root = _Label()
        for rule in rules:
            host, path = rule.parts
            label = self.root
            for part in reversed(host.split(".")):
                label = label.on.setdefault(part, _Label())
            label.paths = at = label.paths or _Segment()
            *whole, last = path.split("/")
            for part in whole:
                at = at.on.setdefault(part, _Segment())
            if last not in at.ends or rule.rank > at.ends[last].rank:
                at.ends[last] = rule
            at.lengths = sorted({len(x) for x in at.ends})

    def match(self, host: str, path: str) -> Rule | None:
        """The longest rule for the host or a parent domain of it whose path begins the url's."""
        best: Rule | None = None
        label, segments = self.root, path.split("/")
        for part in reversed(host.split(".")):
            label = label.on.get(part)
            if label is None:
                break
            at = label.paths
            for segment in segments:
                if at is None:
                    break
                for n in at.lengths:
                    rule = at.ends.get(segment[:n]) if n <= len(segment) else None
                    if rule and (best is None or rule.rank > best.rank):
                        best = rule
                at = at.on.get(segment)
        return best


def split_url(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url column; both empty where it is null or has no ``://``."""
    text = F.coalesce(F.col(url), F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(text, pattern, 1), _UPPER, _UPPER.lower()), F.regexp_extract(text, pattern, 2)


def url_filter(pages: DataFrame, rules: list[Rule], default: str = "allow", max_broadcast_chars: int = MAX_BROADCAST_CHARS) -> DataFrame:
    """One row for each row of ``pages`` (page_id, url, any more): page_id, host, path, rule, verdict.

    A rule fits its host and all subdomains if the url's path begins with the rule's path; the
    longest fitting rule decides, and ``default`` where none fits (rule is then null). A null
    url, or one without ``://``, has an empty host and path. Repeated rows get the same result
    each; without rules every verdict is the default; extra columns are ignored.
    """
    host, path = split_url()
    rows = own(pages, "page_id", "url").select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    if sum(len(rule.pattern) for rule in rules) > max_broadcast_chars:
        return _joined(rows, rules, default)
    trie = pages.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        urls = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
        found = [trie.value.match(h, p) for h, p in urls]
        columns = [*batch.columns, pa.array([r and r.pattern for r in found], pa.string()), pa.array([r.action if r else default for r in found], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "host", "path", "rule", "verdict"])

    return map_batches(rows, run, "page_id long, host string, path string, rule string, verdict string")


def _joined(rows: DataFrame, rules: list[Rule], default: str) -> DataFrame:
    """The same verdicts for rule lists too long to broadcast: each distinct host and path looks up its own prefixes."""
    spark = rows.sparkSession
    table = spark.createDataFrame([(*r.parts, r.pattern, r.action, len(r.pattern), len(r.parts[0])) for r in rules], "host string, start string, rule string, verdict string, n int, m int")
    lengths = sorted({len(r.parts[1]) for r in rules})
    urls = rows.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    starts = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    keys = urls.select("host", "path", F.explode(hosts).alias("h")).select("host", "path", "h", F.explode(starts).alias("start"))
    found = keys.join(table.withColumnRenamed("host", "h"), ["h", "start"])
    best = Window.partitionBy("host", "path").orderBy(F.desc("n"), F.desc("m"), F.desc("verdict"))
    first = found.withColumn("nth", F.row_number().over(best)).where("nth = 1").select("host", "path", "rule", "verdict")
    return rows.join(first, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
