"""The whole ingestion: directory, crawl, products and documents, files, sections, upserts, mappings and the queue of what is left."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import relational as R
from tidewater.operators.sections import SCHEMA_VERSION
from tidewater.plans import ingest, jobs
from tidewater.plans.crawling import Web, crawl_sites
from tidewater.sources.documents import write_documents
from tidewater.sources.files import json_sorted, write_csv, write_envelope
from tidewater.sources.staging import staged
from tidewater.sources.tables import StoredTable

#: Stored tables of an ingestion, below its folder, and how rows get into them.
TABLES = {"insurers": R.INSURERS, "products": R.PRODUCT_ROWS, "documents": R.DOCUMENT_ROWS, "sections": R.SECTION_ROWS}
BUCKETS = 16


def stored(folder: str, name: str) -> StoredTable:
    return StoredTable(f"{folder}/{name}", TABLES[name].keys, BUCKETS)


def _upserted(folder: str, name: str, rows: DataFrame) -> DataFrame:
    """The table after ``rows`` went in; buckets that none of them falls into aren't read or written."""
    table, columns = stored(folder, name), TABLES[name]
    incoming = staged(rows.select(*columns.keys, *columns.kept, *columns.written).withColumn("seq", F.lit(1).cast("long")), f"new-{name}")
    touched = [r[0] for r in incoming.select(table.bucket()).distinct().collect()]  # as many as there are buckets, at most
    now = table.read(rows.sparkSession, touched)
    merged = columns.apply(incoming.drop("seq").limit(0) if now is None else now, incoming)
    table.replace(merged) if now is None else table.rewrite(merged, touched)
    return table.read(rows.sparkSession)


@dataclass(frozen=True)
class Ingested:
    """The tables after the run, and of this run the mappings, what is left to download, and a row of counters for each site."""

    insurers: DataFrame
    products: DataFrame
    documents: DataFrame
    sections: DataFrame
    mappings: DataFrame
    pending: DataFrame
    stats: DataFrame


def run(
    spark: SparkSession,
    pages: DataFrame,
    web: Web,
    folder: str,
    stamp: str,
    limits: ingest.Limits = ingest.Limits(),  # noqa: B008 - frozen
    answers: Callable[[DataFrame], DataFrame] | None = None,
    extractors: jobs.Extractors | None = None,
    sources: tuple[ingest.Source, ...] = ingest.SOURCES,
) -> Ingested:
    """From the regulator's ``pages`` (url, html) to stored tables below ``folder``.

    ``web`` answers the crawl and ``answers`` adds ``content`` to documents (default: HTTP, a few at a time); without
    ``limits.download`` no document is asked for. Insurers without a site, or beyond ``limits.max_insurers``,
    aren't crawled. Documents become files below ``limits.documents_dir``, an address that all
    executors share. A run over the same pages changes nothing but the stamps.
    """
    found = staged(ingest.directory(pages, sources, limits.max_insurers), "insurers")
    now = F.lit(stamp)
    kept = found.withColumns({"metadata_json": json_sorted(F.col("metadata")), "raw_json": json_sorted(F.col("metadata")), "updated_at": now})
    insurers = _upserted(folder, "insurers", kept)

    sites = staged(ingest.with_site(found).select("insurer_id", "root"), "sites")
    crawl = crawl_sites(sites.select("root", F.col("root").alias("url")), web, limits.max_depth, limits.max_pages)
    visits = crawl.visits.join(sites, "root").select("insurer_id", F.col("url").alias("page_url"), "visit", "text", "headings", "links")
    products, matched = ingest.found_in(staged(visits, "scans"))
    products = staged(products, "products")
    documents = staged(ingest.merged_documents(matched), "documents")
    if limits.download:
        ask = answers or (lambda rows: jobs.live_answers(jobs.Download())(rows, 0))
        fetched = staged(jobs.with_contents(ask(documents), extractors, limits.documents_dir), "fetched")
        new = fetched.where("local_path IS NOT NULL")
        write_documents(new.withColumn("path", F.expr(f"substring(local_path, {len(limits.documents_dir) + 2})")), limits.documents_dir)
        documents = fetched.drop("content")
    else:
        documents = jobs.process_documents(documents, None)
    cut = ingest.sections_of(documents, products, limits).join(documents.select(F.col("document_id").alias("doc_id"), "product_id"), "doc_id")
    sections = cut.select("product_id", "section_name", "category", F.lit(SCHEMA_VERSION).alias("schema_version"), F.col("content").alias("section_body"), "confidence", F.col("doc_id").alias("source_document_id"))

    said = lambda key: F.coalesce(F.try_element_at("metadata", F.lit(key)), F.lit(""))
    rows = documents.withColumns({key: said(key) for key in ("anchor_text", "page_url", "discovery_method")} | {"extension": F.coalesce("extension", said("extension"))})
    mappings = staged(jobs.document_mappings(rows, found, products), "mappings")
    pending = staged(jobs.pending_downloads(rows, found, products, rows.where("local_path IS NOT NULL").select("local_path")), "pending")
    write_csv(mappings, f"{folder}/product_document_mappings.csv")
    write_envelope(mappings, f"{folder}/product_document_mappings.json", stamp, "records", ["insurer_id", "document_id"])
    write_envelope(pending, f"{folder}/document_download_queue.json", stamp, "documents", ["insurer_id", "document_id"])

    json_list: Column = F.to_json("tags")
    products_ = products.withColumns({"discovered_from_url": F.try_element_at("metadata", F.lit("page_url")), "tags_json": json_list, "metadata_json": json_sorted(F.col("metadata")), "updated_at": now})
    documents_ = documents.withColumns({"metadata_json": json_sorted(F.col("metadata")), "updated_at": now})
    return Ingested(insurers, _upserted(folder, "products", products_), _upserted(folder, "documents", documents_), _upserted(folder, "sections", sections), mappings, pending, crawl.stats())
