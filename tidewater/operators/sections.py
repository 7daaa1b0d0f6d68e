"""Policy texts into canonical sections: lines, headings, islands between headings, and matching by alias."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions.text import heading_title, is_clean_heading, lines

FIRST_TITLE = "Overview"
SCHEMA_VERSION = "1.0"
EXACT, BY_ALIAS = 1.0, 0.8
#: Sections of each category in order, with their aliases.
SCHEMAS = {
    "health": (
        ("Key Features", ("key features", "key highlights")),
        ("Eligibility", ("eligibility", "who can buy")),
        ("Coverage", ("coverage", "benefits covered", "inclusions", "sum insured")),
        ("Exclusions", ("exclusions", "what is not covered")),
        ("Waiting Periods", ("waiting periods", "waiting period")),
        ("Premium Illustration", ("premium", "premium chart")),
        ("Renewal", ("renewal",)),
        ("Claims", ("claim process", "claims")),
    ),
    "motor": (
        ("Key Features", ("key features", "highlights")),
        ("Eligibility", ("eligibility", "who can buy")),
        ("Coverage", ("coverage", "benefits", "own damage cover", "liability cover")),
        ("Add-ons", ("add-ons", "optional covers")),
        ("Exclusions", ("exclusions",)),
        ("Claims", ("claims", "claim process")),
        ("Premium Illustration", ("premium",)),
    ),
    "life_term": (
        ("Key Features", ("key features", "highlights")),
        ("Eligibility", ("eligibility", "entry age")),
        ("Plan Options", ("plan options", "plan variants", "coverage options")),
        ("Benefits", ("benefits", "death benefit", "maturity benefit", "survival benefit")),
        ("Exclusions", ("exclusions", "suicide clause")),
        ("Premium Payment", ("premium payment", "premium")),
        ("Policy Term", ("policy term", "term options")),
        ("Claims", ("claims", "claim process")),
    ),
    "life_savings": (
        ("Key Features", ("key features", "highlights")),
        ("Eligibility", ("eligibility", "entry age")),
        ("Plan Options", ("plan options", "policy options", "policy variants")),
        ("Benefits", ("benefits", "maturity benefit", "survival benefit", "death benefit")),
        ("Bonus", ("bonus", "participation in profits")),
        ("Premium Payment", ("premium payment",)),
        ("Surrender Value", ("surrender value", "loan")),
        ("Claims", ("claims",)),
    ),
}

Schemas = dict[str, tuple[tuple[str, tuple[str, ...]], ...]]


def definitions(spark: SparkSession, schemas: Schemas = SCHEMAS) -> DataFrame:
    """(category, version, ordinal, section_name, aliases): small, and the same for any input."""
    rows = [(c, SCHEMA_VERSION, i, name, list(aliases)) for c, sections in schemas.items() for i, (name, aliases) in enumerate(sections)]
    return spark.createDataFrame(rows, "category string, version string, ordinal int, section_name string, aliases array<string>")


def supported_categories(spark: SparkSession, schemas: Schemas = SCHEMAS) -> DataFrame:
    return definitions(spark, schemas).select("category").distinct().orderBy("category")


def document_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, line) of each cleaned, non-blank line."""
    return docs.select(key, F.posexplode(lines(F.col(text))).alias("pos", "line"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def section_array(text: Column) -> Column:
    """array<struct<title, content>>: the lines below each heading, joined; headings without lines vanish.

    The places of the headings cut the text's own array of lines, in time linear in the lines:
    neither a window nor a shuffle is needed. A null text gives null.
    """

    def cut(rows: Column, heads: Column) -> Column:
        def section(k: Column) -> Column:
            start, end = F.coalesce(F.get(heads, k - 1), F.lit(-1)), F.coalesce(F.get(heads, k), F.size(rows))
            title = F.when(k == 0, FIRST_TITLE).otherwise(heading_title(F.get(rows, start)))
            return F.struct(title.alias("title"), F.array_join(F.slice(rows, start + 2, end - start - 1), "\n").alias("content"))

        return F.filter(F.transform(F.sequence(F.lit(0), F.size(heads)), section), lambda s: s["content"] != "")

    places = lambda rows: F.filter(F.transform(rows, lambda x, i: F.when(is_clean_heading(x), i)), lambda i: i.isNotNull())
    return F.when(text.isNotNull(), _let(lines(text), lambda rows: _let(places(rows), lambda heads: cut(rows, heads))))


def split_sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ordinal, title, content) of each document's sections."""
    return docs.select(key, F.posexplode(section_array(F.col(text))).alias("ordinal", "section")).select(key, "ordinal", "section.title", "section.content")


def _matched(rows: DataFrame, key: str, schemas: Schemas) -> DataFrame:
    """(key, category, sections) to a row for each section that the category defines; all inside the document's row."""
    defined = definitions(rows.sparkSession, schemas).groupBy("category", "version").agg(F.array_sort(F.collect_list(F.struct("ordinal", "section_name", "aliases"))).alias("defined"))
    title = lambda s: F.lower(s["title"])
    exact = lambda s, d: title(s) == F.lower(d["section_name"])
    fits = lambda d: F.filter("sections", lambda s: exact(s, d) | F.exists(d["aliases"], lambda a: title(s).contains(a)))
    first = lambda d: F.get(F.transform(fits(d), lambda s: F.struct(s["content"].alias("content"), F.when(exact(s, d), EXACT).otherwise(BY_ALIAS).alias("confidence"))), F.lit(0))
    joined = rows.join(F.broadcast(defined), "category")
    each = F.transform("defined", lambda d: F.struct(d["ordinal"].alias("ordinal"), d["section_name"].alias("section_name"), first(d).alias("hit")))
    # Not a filter on the sections: that would be pushed below them and cut every text twice.
    found = joined.select(key, "category", "version", F.explode(F.when(F.size("sections") > 0, each)).alias("m"))
    content, confidence = F.coalesce("m.hit.content", F.lit("")), F.coalesce("m.hit.confidence", F.lit(0.0))
    return found.select(key, "category", F.col("version").alias("schema_version"), "m.ordinal", "m.section_name", content.alias("content"), confidence.alias("confidence"))


def match_sections(sections: DataFrame, products: DataFrame, schemas: Schemas = SCHEMAS, key: str = "doc_id") -> DataFrame:
    """For each document of ``products`` (key, category) a row for each section its category defines.

    Of a document's sections the first that equals the name, or holds an alias, gives content
    and confidence; where none does, they are empty and 0. Documents without sections, and
    unknown categories, give no rows.
    """
    gathered = sections.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ordinal", "title", "content"))).alias("sections"))
    return _matched(products.select(key, "category").join(gathered, key), key, schemas)


def policy_sections(docs: DataFrame, schemas: Schemas = SCHEMAS, doc_types: tuple[str, ...] | None = None) -> DataFrame:
    """(doc_id, category, text[, document_type]) to canonical sections; ``doc_types`` limits the kinds of documents. No shuffle."""
    if doc_types is not None:
        docs = docs.where(F.col("document_type").isin(*doc_types))
    return _matched(docs.select("doc_id", "category", section_array(F.col("text")).alias("sections")), "doc_id", schemas)


def sections_by_window(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``split_sections`` for documents whose lines already are rows (key, pos, line): a gaps-and-islands window."""
    order = Window.partitionBy(key).orderBy("pos")
    rows = document_lines(docs, key, text).withColumn("head", is_clean_heading(F.col("line")))
    islands = rows.withColumn("island", F.sum(F.col("head").cast("int")).over(order))
    title = F.coalesce(F.max(F.when(F.col("head"), heading_title(F.col("line")))), F.lit(FIRST_TITLE))
    body = F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("pos", "line"))))
    grouped = islands.groupBy(key, "island").agg(title.alias("title"), body.alias("body")).where(F.size("body") > 0)
    content = F.array_join(F.transform("body", lambda x: x["line"]), "\n")
    ordinal = F.row_number().over(Window.partitionBy(key).orderBy("island")) - 1
    return grouped.select(key, ordinal.alias("ordinal"), "title", content.alias("content"))


def running_sum(rows: DataFrame, key: str, place: str, value: Column, name: str, block: int) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over rows of the key from the first up to this, by ``place`` (0, 1, 2, ...).

    A segmented scan: sums inside blocks of places, a scan over the blocks' totals, and both added
    up. No window holds more than a block's rows, or a key's blocks, so that one key may hold any number of rows.
    """
    blocked = rows.withColumns({"value_": value.cast("long"), "block_": F.floor(F.col(place) / block).cast("long")})
    inside = blocked.withColumn("local_", F.sum("value_").over(Window.partitionBy(key, "block_").orderBy(place)))
    totals = blocked.groupBy(F.col(key).alias("key_"), F.col("block_").alias("at_")).agg(F.sum("value_").alias("total_"))
    before = Window.partitionBy("key_").orderBy("at_").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("key_", "at_", F.coalesce(F.sum("total_").over(before), F.lit(0)).alias("base_"))
    joined = inside.join(bases, F.col(key).eqNullSafe(F.col("key_")) & (F.col("block_") == F.col("at_")))
    return joined.select(*rows.columns, (F.col("base_") + F.col("local_")).alias(name))


def sections_of_lines(rows: DataFrame, key: str = "doc_id", block: int = 10_000) -> DataFrame:
    """``split_sections`` of texts that are stored as cleaned lines (key, pos from 0 on, line), one text over as many tasks as it has blocks.

    Lines of a section are joined block by block before the blocks' pieces meet; a section is
    one value, as it is in the result.
    """
    marked = rows.select(key, "pos", "line", is_clean_heading(F.col("line")).alias("head"))
    islands = running_sum(marked, key, "pos", F.col("head").cast("int"), "island", block)
    title = F.max(F.when(F.col("head"), heading_title(F.col("line")))).alias("title")
    body = F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("pos", "line"))))
    part = F.floor(F.col("pos") / block).alias("part")
    pieces = islands.groupBy(key, "island", part).agg(title, body.alias("body")).select(key, "island", "part", "title", F.when(F.size("body") > 0, F.array_join(F.transform("body", lambda x: x["line"]), "\n")).alias("said"))
    joined = F.array_sort(F.collect_list(F.when(F.col("said").isNotNull(), F.struct("part", "said"))))
    whole = pieces.groupBy(key, "island").agg(F.coalesce(F.max("title"), F.lit(FIRST_TITLE)).alias("title"), joined.alias("parts"))
    whole = whole.withColumn("content", F.array_join(F.transform("parts", lambda x: x["said"]), "\n")).withColumn("filled", F.size("parts") > 0)
    numbered = running_sum(whole.select(key, "island", "title", "content", "filled"), key, "island", F.col("filled").cast("int"), "nth", block)
    return numbered.where("filled").select(key, (F.col("nth") - 1).cast("int").alias("ordinal"), "title", "content")
