"""From tables of pages to insurers, products, documents and sections, ready to upsert."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.text import clean_text, slugify
from tidewater.functions.urls import absolute_url, detect_extension, ensure_scheme, media_type, primary_url, stem
from tidewater.operators import classifying
from tidewater.operators.relational import DOCUMENTS, PRODUCTS, match_in_scope
from tidewater.operators.sections import SCHEMAS, policy_sections
from tidewater.sources.html import page_links, page_scan, table_rows
from tidewater.sources.staging import staged


@dataclass(frozen=True)
class Source:
    """A regulator's table: its address, the table's id, and header to column names."""

    key: str
    url: str
    table_id: str
    columns: dict[str, str]
    description: str = ""


_GENERAL = {
    "Sr. No.": "serial_no",
    "Insurer": "insurer_name",
    "Registered/Corporate Address": "address",
    "CEO/CMD": "leader_name",
    "Appointed Actuary": "appointed_actuary",
    "Telephone no./Fax no./ Web address of the Insurer": "contacts",
    "Website": "website",
}
#: The regulator's tables and their headers.
SOURCES = (
    Source("general", "https://irdai.gov.in/list-of-general-insurers", "nonlifeinsurers", _GENERAL, "Non-life (general) insurers"),
    Source(
        "life",
        "https://irdai.gov.in/list-of-life-insurers1",
        "lifeinsurers",
        {
            "Sl.No": "serial_no",
            "Name": "insurer_name",
            "Regn. No": "registration_number",
            "Address": "address",
            "Name of the Chairman / MD & CEO": "leader_name",
            "Designation": "leader_designation",
            "Email of Chairman/CEO/MD": "leader_email",
            "Appointed Actuary": "appointed_actuary",
            "Telephone/Fax": "contacts",
            "Email-id of Insurer": "insurer_email",
        },
        "Life insurers",
    ),
    Source("health", "https://irdai.gov.in/list-of-health-insurers", "healthl", _GENERAL, "Standalone health insurers"),
)


@dataclass(frozen=True)
class Limits:
    max_pages: int = 80
    max_depth: int = 3
    max_insurers: int | None = None
    documents_dir: str = "data/documents"
    section_types: tuple[str, ...] = ("policy_wording",)
    schemas: dict = field(default_factory=lambda: SCHEMAS)
    download: bool = True


def insurer_rows(rows: DataFrame, source: Source, cells: str = "cells") -> DataFrame:
    """Table rows (cells map<header, text>) to the source's columns: trimmed, blanks null, with category, source_url and website_url."""
    named = [F.nullif(F.trim(F.try_element_at(F.col(cells), F.lit(header))), F.lit("")).alias(name) for header, name in source.columns.items()]
    others = [c for c in rows.columns if c != cells]
    out = rows.select(*others, *named, F.lit(source.key).alias("category"), F.lit(source.url).alias("source_url"))
    site = [F.col(c) for c in ("website", "contacts") if c in out.columns]
    return out.withColumn("website_url", F.nullif(primary_url(*site), F.lit("")))


def insurer_union(parts: list[DataFrame]) -> DataFrame:
    """All categories in one table whose columns are the union of theirs."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def insurers(rows: DataFrame, skip: tuple[str, ...] = ("pos",)) -> DataFrame:
    """Normalised rows to (insurer_id, name, category, source_url, website_url, metadata): all but the category that isn't blank is metadata."""
    fields = [c for c in rows.columns if c not in (*skip, "category")]
    site = F.coalesce(F.nullif(F.col("website_url"), F.lit("")), F.col("website") if "website" in rows.columns else F.lit(None), F.lit(""))
    pairs = F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[F.col(f"`{c}`").cast("string") for c in fields]))
    metadata = F.map_filter(pairs, lambda _, v: v.isNotNull() & (v != ""))
    identity = slugify(F.concat_ws("-", "category", "insurer_name"))
    return rows.select(identity.alias("insurer_id"), F.col("insurer_name").alias("name"), "category", "source_url", site.alias("website_url"), metadata.alias("metadata"))


def directory(pages: DataFrame, sources: tuple[Source, ...] = SOURCES, most: int | None = None) -> DataFrame:
    """Regulator pages (url, html) to insurers, the first ``most`` in order of source and row; a page without its table is an error."""
    parts = [insurer_rows(table_rows(pages.where(F.col("url") == s.url).select("html"), s.table_id, strict=True), s) for s in sources]
    rows = insurer_union(parts)
    if most is not None:
        rows = rows.orderBy(F.array_position(F.array(*[F.lit(s.key) for s in sources]), F.col("category")), "pos").limit(most)
    return insurers(rows)


def page_links_of(pages: DataFrame) -> DataFrame:
    """(root, url, html) to crawlable links (root, url, pos, target)."""
    found = pages.select("root", "url", F.posexplode(page_links("html")).alias("pos", "link")).select("root", "url", "pos", "link.href")
    resolved = found.withColumn("target", absolute_url(F.col("url"), F.col("href")))
    return resolved.where((F.col("href") != "") & classifying.is_crawlable(F.col("href"), F.col("target"), F.col("root"))).select("root", "url", "pos", "target")


def scanned(pages: DataFrame) -> DataFrame:
    """(insurer_id, page_url, visit, html) with text, headings and links instead of the html, each page parsed once."""
    return pages.select("insurer_id", "page_url", "visit", page_scan("html").alias("scan")).select("insurer_id", "page_url", "visit", "scan.*")


def product_candidates(scans: DataFrame) -> DataFrame:
    """Scanned pages to products in page order, from headings that sound like one."""
    read = scans.select("insurer_id", "page_url", "visit", F.col("text").alias("page_text"), "headings")
    found = read.select("insurer_id", "page_url", "visit", "page_text", F.posexplode("headings").alias("pos", "h")).where(classifying.potential_product(F.col("h.title")))
    title = F.col("h.title")
    link = F.when(F.col("h.href") != "", absolute_url(F.col("page_url"), F.col("h.href"))).otherwise(F.col("page_url"))
    return found.select(
        "insurer_id",
        "page_url",
        "visit",
        "pos",
        slugify(F.concat_ws("-", F.col("insurer_id"), title)).alias("product_id"),
        title.alias("name"),
        classifying.category(title, F.col("page_text")).alias("category"),
        link.alias("product_url"),
        F.col("h.description").alias("description"),
        classifying.tags(title).alias("tags"),
        F.create_map(F.lit("heading_level"), F.col("h.level"), F.lit("page_url"), F.col("page_url")).alias("metadata"),
    )


def document_id(insurer_id: Column, url: Column, kind: Column) -> Column:
    return slugify(F.concat_ws("-", insurer_id, stem(url), kind))


def document_candidates(scans: DataFrame) -> DataFrame:
    """Scanned pages to links to documents of a required type that look like downloads."""
    read = scans.select("insurer_id", "page_url", "visit", F.posexplode("links").alias("pos", "link")).where(F.col("link.href") != "")
    found = read.withColumn("source_url", absolute_url(F.col("page_url"), F.col("link.href"))).withColumn("anchor_text", clean_text(F.col("link.text")))
    kind = classifying.document_type(F.col("anchor_text"), F.col("source_url"))
    wanted = found.where(classifying.is_document_link(F.col("anchor_text"), F.col("source_url"))).withColumn("document_type", kind).where(F.col("document_type").isin(*classifying.REQUIRED_TYPES))
    links = wanted.where(classifying.is_download_link(F.col("anchor_text"), F.col("source_url"), F.col("link.attributes"), F.col("link.ancestors")))
    extension = detect_extension(F.col("source_url"))
    return links.select(
        "insurer_id",
        "page_url",
        "visit",
        "pos",
        document_id(F.col("insurer_id"), F.col("source_url"), F.col("document_type")).alias("document_id"),
        "document_type",
        "source_url",
        "anchor_text",
        extension.alias("extension"),
        F.coalesce(media_type(extension), F.lit("application/octet-stream")).alias("media_type"),
    )


@dataclass(frozen=True)
class Harvest:
    products: DataFrame
    documents: DataFrame
    sections: DataFrame


def found_in(scans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scanned pages to merged products, and links to documents with the product that each belongs to."""
    candidates = product_candidates(scans)
    names = ("anchor_text", "page_url", "extension", "discovery_method")
    metadata = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(F.col("anchor_text"), F.col("page_url"), F.col("extension"), F.lit("crawl")))
    sequence = F.struct("visit", "pos")
    matched = match_in_scope(document_candidates(scans), candidates).withColumns({"seq": sequence, "metadata": metadata})
    return PRODUCTS.apply(candidates.withColumn("seq", sequence)), matched


def merged_documents(matched: DataFrame) -> DataFrame:
    """One row for each document; what isn't there yet is null."""
    blank = {c: F.lit(None).cast("string") for c in ("local_path", "content_hash", "extracted_text") if c not in matched.columns}
    return DOCUMENTS.apply(matched.withColumns(blank))


def sections_of(documents: DataFrame, products: DataFrame, limits: Limits) -> DataFrame:
    """Sections of the documents that have a product and a text."""
    wordings = documents.join(products.select("product_id", "category"), "product_id").where(F.coalesce("extracted_text", F.lit("")) != "")
    return policy_sections(wordings.select(F.col("document_id").alias("doc_id"), "category", F.col("extracted_text").alias("text"), "document_type"), limits.schemas, limits.section_types)


def harvest(pages: DataFrame, texts: DataFrame, limits: Limits = Limits()) -> Harvest:  # noqa: B008 - frozen
    """Visited pages (insurer_id, page_url, visit, html) and texts of documents (source_url, extracted_text) to merged products, documents and sections."""
    products, matched = found_in(staged(scanned(pages), "scans"))
    documents = merged_documents(matched.join(texts, "source_url", "left"))
    return Harvest(products, documents, sections_of(documents, products, limits))


def with_site(insurer: DataFrame) -> DataFrame:
    """Insurers that have a site to crawl, with its root."""
    return insurer.withColumn("root", ensure_scheme(F.col("website_url"))).where(F.coalesce("root", F.lit("")) != "")
