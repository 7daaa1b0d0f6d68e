"""Product search: facets, contiguous substring search, sorting, offset pages, counts, typeahead and small list operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.text import highlight
from tidewater.operators.search_index import SearchIndex, build_search_index

PAGE_SIZE, SUGGESTIONS, RECENT = 8, 6, 6
SUMMARY = ("id", "name", "insurer", "rating", "priceFrom", "coverageType", "coverageAmount", "tags", "categoryId", "policyExcerpt", "policyDocumentUrl", "highlights")
SEARCHED = ("name", "insurer", "policyExcerpt", "policyWording", "tags")


@dataclass(frozen=True)
class ProductQuery:
    """Absent or empty fields don't filter. ``sort``: relevance (catalogue order), price_low, price_high or rating."""

    category: str | None = None
    search: str | None = None
    insurers: tuple[str, ...] = ()
    coverage_types: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    sort: str = "relevance"
    page: int = 1
    page_size: int = PAGE_SIZE


@dataclass(frozen=True)
class Page:
    items: DataFrame
    total: int
    page: int
    page_size: int
    query: ProductQuery = field(repr=False, default=ProductQuery())

    @property
    def pages(self) -> int:
        return -(-self.total // self.page_size)

    def clamped(self, wanted: int) -> int:
        return max(1, min(wanted, self.pages))


def clamped_page(wanted: Column, total: Column, page_size: int = PAGE_SIZE) -> Column:
    """``Page.clamped`` for columns."""
    return F.greatest(F.lit(1).cast("long"), F.least(wanted, F.ceil(total / page_size)))


def query_string(fields: dict[str, Column]) -> Column:
    """A form-encoded query string: nulls are left out, arrays repeat their key; empty without any value."""

    def pairs(name: str, values: Column) -> Column:
        return F.transform(F.filter(values, lambda x: x.isNotNull()), lambda x: F.concat(F.lit(f"{name}="), F.url_encode(x.cast("string"))))

    said = F.array_join(F.flatten(F.array(*[F.coalesce(pairs(n, c), F.array().cast("array<string>")) for n, c in fields.items()])), "&")
    return F.when(said != "", F.concat(F.lit("?"), said)).otherwise("")


INSURERS = "id string, name string, logoUrl string, rating double, totalProducts int"
CATEGORIES = "id string, label string, icon string, productCount int"
PRODUCTS = (
    "id string, name string, insurer string, rating double, priceFrom int, coverageType string, coverageAmount string, tags array<string>, categoryId string, policyExcerpt string, "
    "policyDocumentUrl string, highlights array<string>, policyWording string, reviews array<struct<id:string,rating:int>>"
)


def in_memory(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table of the catalogue from records, with ``ordinal`` for their order; fields that are missing are null."""
    kinds = T.StructType.fromDDL(schema)
    return spark.createDataFrame([(i, *[r.get(n) for n in kinds.names]) for i, r in enumerate(rows)], T.StructType([T.StructField("ordinal", T.IntegerType()), *kinds.fields]))


def haystack(columns: tuple[str, ...] = SEARCHED) -> Column:
    """All searched fields in lower case, joined by spaces; stored beside the products it saves lowering them anew."""
    return F.lower(F.concat_ws(" ", *columns))


def facets(products: DataFrame, query: ProductQuery) -> DataFrame:
    """Equality and IN filters reach the scan; tags match if any is shared."""
    out = products
    if query.category:
        out = out.where(F.col("categoryId") == query.category)
    if query.insurers:
        out = out.where(F.col("insurer").isin(*query.insurers))
    if query.coverage_types:
        out = out.where(F.col("coverageType").isin(*query.coverage_types))
    if query.tags:
        out = out.where(F.arrays_overlap("tags", F.array(*map(F.lit, query.tags))))
    return out


def matching(products: DataFrame, query: ProductQuery, index: SearchIndex | None = None) -> DataFrame:
    """Facets, and the query as one contiguous substring of the haystack, by an index of it where there is one."""
    out = facets(products, query)
    if not query.search:
        return out
    return out.join(index.matching(query.search), "ordinal", "left_semi") if index else out.where(haystack().contains(query.search.lower()))


def build_index(products: DataFrame, folder: str) -> SearchIndex:
    """An index of the haystacks of ``products`` (ordinal, searched fields)."""
    return build_search_index(products, haystack(), folder)


def order(query: ProductQuery) -> list[Column]:
    """Ties keep the catalogue's order, in ``ordinal``."""
    by = {"price_low": [F.col("priceFrom").asc()], "price_high": [F.col("priceFrom").desc()], "rating": [F.col("rating").desc()]}
    return [*by.get(query.sort, []), F.col("ordinal").asc()]


def summary() -> list[Column]:
    return [*map(F.col, SUMMARY), F.get("reviews", F.lit(0)).alias("lastReview")]


def page_rows(products: DataFrame, query: ProductQuery, index: SearchIndex | None = None) -> DataFrame:
    """The products of one page in order: a single top-k of offset plus limit, never a full sort."""
    return _page(matching(products, query, index), query)


def _page(found: DataFrame, query: ProductQuery) -> DataFrame:
    start = (max(1, query.page) - 1) * query.page_size
    return found.orderBy(*order(query)).offset(start).limit(query.page_size)


def search(products: DataFrame, query: ProductQuery, index: SearchIndex | None = None) -> Page:
    """One page and the number of all products that match, both from one job: the matches are counted as they pass into the top-k."""
    total = Observation()
    rows = _page(matching(products, query, index).observe(total, F.count(F.lit(1)).alias("n")), query).select(*summary())
    items = rows.collect()  # a page
    return Page(products.sparkSession.createDataFrame(items, rows.schema), total.get["n"], max(1, query.page), query.page_size, query)


#: What ``facet_counts`` counts by default: names, and what they stand for.
FACETS = {"category": "categoryId", "insurer": "insurer", "coverage": "coverageType", "tag": "tags"}


def facet_counts(products: DataFrame, query: ProductQuery, index: SearchIndex | None = None, columns: dict[str, str] | None = None) -> DataFrame:
    """(facet, value, n): the number of matches for each value of each facet, lists by element, and their total as the facet ``total``.

    One scan and one shuffle for all facets, counted in part before it. A value that repeats in a list counts once; nulls aren't counted.
    """
    named = columns or FACETS
    kinds = dict(products.dtypes)

    def pair(facet: str) -> Callable[[Column], Column]:
        return lambda x: F.struct(F.lit(facet).alias("facet"), x.cast("string").alias("value"))

    pairs = [F.transform(F.array_distinct(F.col(c)) if kinds[c].startswith("array") else F.array(F.col(c)), pair(f)) for f, c in named.items()]
    total = F.array(F.struct(F.lit("total").alias("facet"), F.lit("").alias("value")))
    each = matching(products, query, index).select(F.explode(F.flatten(F.filter(F.array(total, *pairs), lambda x: x.isNotNull()))).alias("x")).select("x.*")
    return each.where(F.col("value").isNotNull()).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def detail(products: DataFrame, product_id: str) -> DataFrame:
    """The product of that id; an error where there is none."""
    found = products.where(F.col("id") == product_id).limit(1)
    if found.isEmpty():
        raise LookupError("Product not found")
    return found


def suggestions(products: DataFrame, categories: DataFrame, text: str, most: int = SUGGESTIONS) -> DataFrame:
    """(ordinal, id, name, label): names that contain ``text``, in catalogue order; none for an empty text."""
    hits = products.where(F.lower("name").contains(text.lower())) if text else products.limit(0)
    first = hits.select("ordinal", "id", "name", "categoryId").orderBy("ordinal").limit(most)
    labels = categories.select(F.col("id").alias("categoryId"), "label")
    return first.join(labels, "categoryId", "left").select("ordinal", "id", "name", F.coalesce("label", F.lit("All")).alias("label")).orderBy("ordinal")


def category_counts(categories: DataFrame, products: DataFrame) -> DataFrame:
    counts = products.groupBy(F.col("categoryId").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return categories.join(counts, "id", "left").withColumn("productCount", F.coalesce("n", F.lit(0)).cast("long")).drop("n")


def tag_facet(page: DataFrame) -> DataFrame:
    """The distinct tags of one page, in order of first appearance."""
    listed = page.agg(F.array_sort(F.collect_list(F.struct("ordinal", "tags"))).alias("rows"))
    return listed.select(F.posexplode(F.array_distinct(F.flatten(F.transform("rows", lambda r: r["tags"])))).alias("pos", "tag"))


def recent_searches(events: DataFrame, user: str, term: str, at: str, most: int = RECENT) -> DataFrame:
    """(user, pos, term): each user's latest distinct trimmed terms, newest first. Older ones are cut after a partial maximum."""
    last = events.select(user, F.trim(term).alias("term"), at).where("term <> ''").groupBy(user, "term").agg(F.max(at).alias("last"))
    nth = F.row_number().over(Window.partitionBy(user).orderBy(F.desc("last"), F.desc("term")))
    return last.withColumn("nth", nth).where(F.col("nth") <= most).select(user, (F.col("nth") - 1).alias("pos"), "term")


def remember(previous: Column, term: Column, most: int = RECENT) -> Column:
    """A list of searches with one more in front."""
    return F.slice(F.array_distinct(F.concat(F.array(F.trim(term)), previous)), 1, most)


def toggle(items: Column, item: Column) -> Column:
    """Without ``item`` if it was there, else with it at the end."""
    return F.when(F.array_contains(items, item), F.array_remove(items, item)).otherwise(F.array_append(items, item))


def numbered_ids(items: Column) -> Column:
    """Each element's id with its place appended."""
    return F.transform(items, lambda x, i: F.concat(x, F.lit("-"), i.cast("string")))


def highlighted(products: DataFrame, column: str, query: str) -> DataFrame:
    return products.withColumn("segments", highlight(F.col(column), query))
