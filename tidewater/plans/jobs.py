"""Jobs over stored tables: document mappings, download queues, reprocessing and retry rounds."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.text import slugify
from tidewater.functions.urls import MEDIA_TYPES, detect_extension, ensure_scheme, local_path, media_type, suffix
from tidewater.operators.relational import absent, by_insurers, lookup
from tidewater.operators.sections import SCHEMAS, policy_sections
from tidewater.sources.documents import stored_documents, write_documents
from tidewater.sources.fetch import Answer, Throttle, fetch, http_get
from tidewater.sources.files import MAX_BYTES, read_queue, text_of, write_envelope
from tidewater.sources.staging import staged, unstaged

Extractors = dict[str, Callable[[bytes], str]]

MAPPED_TYPES = ("policy_wording", "brochure")
MAPPING = ("insurer_id", "insurer_name", "product_id", "product_name", "document_id", "document_type", "source_url", "local_path", "anchor_text", "discovered_from_url", "discovery_method")
PENDING = ("insurer_id", "insurer_name", "document_id", "document_type", "product_id", "product_name", "source_url", "page_url", "anchor_text", "discovery_method", "extension")


def _named(documents: DataFrame, insurers: DataFrame, products: DataFrame) -> DataFrame:
    out = lookup(documents, insurers.select("insurer_id", F.col("name").alias("insurer_name")), "insurer_id", "insurer_name")
    # Products are as small as a file and as large in memory as names of files are: not to be broadcast.
    return lookup(out, products.select("product_id", F.col("name").alias("product_name")).hint("merge"), "product_id", "product_name")


def _blank(columns: tuple[str, ...]) -> list:
    return [F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns]


def document_mappings(documents: DataFrame, insurers: DataFrame, products: DataFrame, every: bool = False) -> DataFrame:
    """Which document belongs to which product: wordings and brochures with a product, or with ``every`` all documents."""
    kept = documents if every else documents.where(F.col("document_type").isin(*MAPPED_TYPES) & (F.coalesce("product_id", F.lit("")) != ""))
    return _named(kept, insurers, products).withColumn("discovered_from_url", F.col("page_url")).select(*_blank(MAPPING))


def download_jobs(documents: DataFrame, insurers: DataFrame, products: DataFrame) -> DataFrame:
    """Documents of known insurers, with the product's name where there is a product."""
    known = documents.join(insurers.select("insurer_id", F.col("name").alias("insurer_name")), "insurer_id")
    return lookup(known, products.select("product_id", F.col("name").alias("product_name")), "product_id", "product_name", None)


def pending_downloads(documents: DataFrame, insurers: DataFrame, products: DataFrame, files: DataFrame) -> DataFrame:
    """Documents with an address whose file is not in the listing (local_path)."""
    open_ = absent(documents.where(F.coalesce("source_url", F.lit("")) != ""), files, "local_path")
    return _named(open_, insurers, products).select(*_blank(PENDING))


def jobs_by_insurer(jobs: DataFrame, order: str = "document_id") -> DataFrame:
    """(insurer_id, jobs): each insurer's document ids in order; ``explode`` is the way back."""
    return jobs.groupBy("insurer_id").agg(F.array_sort(F.collect_list(order)).alias("jobs"))


def flattened(groups: DataFrame) -> DataFrame:
    """(insurer_id, pos, document_id): the groups of ``jobs_by_insurer`` as single jobs again, in order."""
    return groups.select("insurer_id", F.posexplode("jobs").alias("pos", "document_id"))


def job_source(spark: SparkSession, queue: str, documents: DataFrame) -> DataFrame:
    """The entries of the queue file where there is one, else ``documents``."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(queue)
    exists = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return read_queue(spark, queue) if exists else documents


@dataclass(frozen=True)
class Download:
    folder: str = "data/documents"
    queue: str = "data/document_download_queue.json"
    throttle: Throttle = Throttle()
    retries: int = 2
    timeout: float = 30.0


def known_kinds(documents: DataFrame) -> DataFrame:
    """``documents`` with extension and content_type by their address; null without one."""
    url = ensure_scheme(F.coalesce("source_url", F.lit("")))
    kind = F.when(url != "", detect_extension(url))
    return documents.withColumn("extension", kind).withColumn("content_type", F.when(kind.isNotNull(), F.coalesce(media_type(kind), F.lit(""))))


def _supported() -> Column:
    return F.coalesce(F.col("extension").isin(*MEDIA_TYPES), F.lit(False))


def with_contents(rows: DataFrame, extractors: Extractors | None = None, folder: str = Download.folder, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``rows`` of ``process_documents`` that carry their ``content`` (null: nothing fetched), which stays: no byte is moved."""
    size = F.octet_length("content")
    taken = F.coalesce(_supported() & (size > 0) & (size <= max_bytes), F.lit(False))
    place = local_path(folder, F.col("insurer_id"), F.coalesce(F.nullif(slugify(F.col("document_id")), F.lit("")), F.col("document_id")), F.col("extension"))
    made = known_kinds(rows).withColumns({"_taken": taken, "_path": place}).withColumn("_text", text_of(F.col("_path"), F.when(F.col("_taken"), F.col("content")), extractors))
    pick = lambda new, old: F.when(F.col("_taken"), new).otherwise(F.col(old))
    done = {"local_path": pick(F.col("_path"), "local_path"), "content_hash": pick(F.sha2("content", 256), "content_hash"), "extracted_text": pick(F.col("_text"), "extracted_text")}
    return made.withColumns(done).drop("_taken", "_path", "_text")


def process_documents(documents: DataFrame, contents: DataFrame | None, extractors: Extractors | None = None, folder: str = Download.folder, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``documents`` (document_id, insurer_id, source_url, local_path, content_hash, extracted_text, any more) after download.

    ``contents``: (document_id, content) that was fetched, or None where nothing is downloaded.
    Adds extension and content_type. Without an address a document stays as it is; of a kind that isn't supported it
    gets these two only; without download its path is null and its text empty; with content
    of a fitting size it gets path, hash and text, and otherwise stays as it was.
    """
    if contents is None:
        known, supported = known_kinds(documents), _supported()
        return known.withColumns({"local_path": F.when(~supported, F.col("local_path")), "extracted_text": F.when(supported, F.lit("")).otherwise(F.col("extracted_text"))})
    joined = documents.join(contents.select("document_id", "content"), "document_id", "left")
    return with_contents(joined, extractors, folder, max_bytes).drop("content")


@dataclass(frozen=True)
class Downloaded:
    """documents: what was stored, with local_path, content_hash, extracted_text and round; left: the jobs that failed in every round, which is what the queue holds now."""

    documents: DataFrame
    left: DataFrame


def live_answers(settings: Download, get: Callable[[str], Answer] | None = None, journal: str | None = None) -> Callable[[DataFrame, int], DataFrame]:
    """Jobs and the round's number to the same jobs with ``content``, over HTTP; with a journal, a task that starts anew asks for nothing twice."""

    def ask(left: DataFrame, n: int) -> DataFrame:
        answers = fetch(left, get or http_get(settings.timeout), "source_url", "insurer_id", settings.throttle, journal=journal and f"{journal}/{n}")
        return answers.select(*left.columns, "content")

    return ask


def download(spark: SparkSession, settings: Download, documents: DataFrame, insurers: DataFrame, products: DataFrame, answers: Callable[[DataFrame, int], DataFrame] | None = None, extractors: Extractors | None = None) -> Downloaded:
    """Fetches what is pending, stores it as files, tries failures again, and leaves the rest in the queue.

    Jobs are the entries of ``settings.queue`` where there is one, else the documents whose file isn't
    below ``settings.folder``. Each round asks once for what is left (``answers``, by default over HTTP
    as the throttle allows), keeps the answers in a table, and stores those of a supported kind and
    size as files, all of a round or none. Only failures go on; after ``settings.retries`` more rounds
    the queue is written anew.
    """
    ask = answers or live_answers(settings)
    files = stored_documents(spark, settings.folder).select(F.concat(F.lit(f"{settings.folder}/"), "path").alias("local_path"))
    jobs = job_source(spark, settings.queue, pending_downloads(documents, insurers, products, files))
    left, done = staged(jobs.select(*PENDING), "jobs"), None
    for n in range(settings.retries + 1):
        if left.isEmpty():
            break
        blank = {c: F.lit(None).cast("string") for c in ("local_path", "content_hash", "extracted_text")}
        fetched = staged(with_contents(ask(left, n).withColumns(blank), extractors, settings.folder, MAX_BYTES), "answers")
        stored = fetched.where("local_path IS NOT NULL")
        write_documents(stored.withColumn("path", F.expr(f"substring(local_path, {len(settings.folder) + 2})")), settings.folder)
        now = staged(stored.drop("content").withColumn("round", F.lit(n)), "stored")
        done = now if done is None else done.unionByName(now)
        left = staged(fetched.where("local_path IS NULL").select(*PENDING), "left")
        unstaged(fetched)
    write_envelope(left, settings.queue, datetime.now(UTC).isoformat(timespec="seconds"), "documents", ["insurer_id", "document_id"])
    if done is None:
        done = left.select(*PENDING, *[F.lit(None).cast("string").alias(c) for c in ("local_path", "content_hash", "extracted_text", "content_type")], F.lit(None).cast("int").alias("round")).limit(0)
    # Joins with either are sort merges, as they are with stored documents.
    return Downloaded(done.hint("merge"), left.hint("merge"))


def missing_text(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("extracted_text").isNull() | (F.col("extracted_text") == ""))


def newest(documents: DataFrame, most: int | None = None) -> DataFrame:
    """The latest ``most``, equal stamps in order of id, or all, whose order doesn't matter then."""
    return documents if most is None else documents.orderBy(F.desc("updated_at"), "document_id").limit(most)


@dataclass(frozen=True)
class Reprocessed:
    """Documents with new hash and text, their sections and mappings, what is left to download, and one row of counters."""

    documents: DataFrame
    sections: DataFrame
    mappings: DataFrame
    pending: DataFrame
    stats: DataFrame


@dataclass(frozen=True)
class Reprocess:
    insurers: tuple[str, ...] = ()
    strict_filters: bool = False
    only_missing_text: bool = False
    limit: int | None = None
    with_sections: bool = True

    def documents(self, documents: DataFrame, insurers: DataFrame) -> DataFrame:
        out = by_insurers(documents, insurers, list(self.insurers), self.strict_filters) if self.insurers else documents
        out = missing_text(out) if self.only_missing_text else out
        return newest(out, self.limit)

    def sections(self, documents: DataFrame, products: DataFrame, schemas=SCHEMAS) -> DataFrame:
        """Sections of every document that has a product and a text, whatever its type."""
        known = documents.join(products.select("product_id", "category"), "product_id").where(F.coalesce("extracted_text", F.lit("")) != "")
        return policy_sections(known.select(F.col("document_id").alias("doc_id"), "category", F.col("extracted_text").alias("text")), schemas)

    def run(self, documents: DataFrame, insurers: DataFrame, products: DataFrame, files: DataFrame, extractors: Extractors | None = None, schemas=SCHEMAS) -> Reprocessed:
        """Hash and text of the chosen documents anew from ``files`` (path, content), joined by local_path.

        A document without a file is pending, one whose file has no supported suffix is skipped;
        the others are processed, mapped, and those with a product cut into sections.
        """
        chosen = self.documents(documents, insurers)
        kind = suffix(F.col("local_path"))
        # Files are hashed and read where they lie; what moves is a hash and a text.
        read = files.select(F.col("path").alias("local_path"), F.col("content"))
        ready = F.when(kind.isin(*MEDIA_TYPES), F.col("content"))
        read = read.select("local_path", F.sha2(ready, 256).alias("_hash"), text_of(F.col("local_path"), ready, extractors).alias("_text"), F.lit(True).alias("_found"))
        joined = chosen.join(read, "local_path", "left")
        joined = staged(joined.withColumn("_state", F.when(F.col("_found").isNull(), "missing").when(kind.isin(*MEDIA_TYPES), "processed").otherwise("skipped")), "chosen")
        done = joined.where("_state = 'processed'").withColumns({"content_hash": F.col("_hash"), "extracted_text": F.col("_text"), "extension": kind})
        done = done.select(*documents.columns, *[c for c in ("content_hash",) if c not in documents.columns])
        cut = self.sections(done, products, schemas)
        sections = staged(cut if self.with_sections else cut.limit(0), "sections")
        pending = _named(joined.where("_state = 'missing'"), insurers, products).select(*_blank(PENDING))
        counts = joined.agg(*[F.count_if(F.col("_state") == s).alias(f"documents_{s}") for s in ("processed", "missing", "skipped")])
        stats = counts.withColumn("sections_written", F.lit(sections.count()))
        return Reprocessed(done, sections, document_mappings(done, insurers, products, every=True), pending, stats)


def reprocess_stats(documents: DataFrame) -> DataFrame:
    """One row of counters over (document_id, product_id, insurer_id, extension, local_path, extracted_text)."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return documents.agg(
        F.count(F.lit(1)).alias("documents"),
        F.countDistinct(F.when(has("product_id"), F.col("product_id"))).alias("products"),
        F.countDistinct("insurer_id").alias("insurers"),
        F.count_if(~has("local_path")).alias("missing_files"),
        F.count_if(has("local_path") & ~F.coalesce(F.col("extension"), F.lit("")).isin(*MEDIA_TYPES)).alias("unsupported"),
        F.count_if(has("extracted_text")).alias("with_text"),
        F.count_if(has("extracted_text") & has("product_id")).alias("sectioned"),
    )


def retry_rounds(jobs: DataFrame, attempt, rounds: int, key: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """Runs ``attempt(jobs, round)``, which returns the keys that succeeded, ``rounds`` + 1 times on what is left.

    Returns (done: key and round, left). Only failures go on to the next round; each round's
    successes are staged, so that no attempt is made twice.
    """
    left, done = jobs, None
    for n in range(rounds + 1):
        succeeded = staged(attempt(left, n).select(key).distinct().withColumn("round", F.lit(n)), "round")
        done = succeeded if done is None else done.unionByName(succeeded)
        left = left.join(succeeded.select(key), key, "left_anti")
    return done, left
