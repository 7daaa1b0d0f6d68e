"""Order-dependent joins, merges and upserts: everything a sequential program gets from insertion order, with explicit ordinals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from tidewater.sources.staging import staged


def _apart(rows: DataFrame, key: str, blank: Column) -> Column:
    """A hash of the key, but for rows that have no partner one of their plain columns: they may be most rows and must not meet in one task."""
    plain = [F.col(f"`{f.name}`") for f in rows.schema if isinstance(f.dataType, AtomicType)]
    return F.when(blank, F.xxhash64(*plain)).otherwise(F.xxhash64(key))


_SAME = "_apart = _a"


def lookup(rows: DataFrame, table: DataFrame, key: str, value: str, default: str = "") -> DataFrame:
    """``rows`` with ``value`` of the ``table`` row of equal ``key``, or the default. Rows without a key, null or empty, have no partner."""
    blank = F.coalesce(F.col(key).cast("string"), F.lit("")) == ""
    side = table.where(~blank).select(F.col(key).cast(rows.schema[key].dataType).alias("_k"), F.xxhash64(F.col(key).cast(rows.schema[key].dataType)).alias("_a"), value)
    joined = rows.withColumn("_apart", _apart(rows, key, blank)).join(side, (F.col(key) == F.col("_k")) & F.expr(_SAME), "left")
    return joined.withColumn(value, F.coalesce(value, F.lit(default))).drop("_apart", "_k", "_a")


def _by_key(rows: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    """``rows`` joined with the distinct ``keys`` (_k); null keys have no partner and are dealt."""
    side = keys.where("_k IS NOT NULL").distinct().withColumn("_a", F.xxhash64("_k"))
    return rows.withColumn("_apart", _apart(rows, key, F.col(key).isNull())).join(side, (F.col(key) == F.col("_k")) & F.expr(_SAME), how).drop("_apart", "_a")


def absent(rows: DataFrame, listing: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` is not in the listing; null keys are absent."""
    return _by_key(rows, listing.select(F.col(key).cast(rows.schema[key].dataType).alias("_k")), key, "left_anti")


def resolve_names(names: DataFrame, needles: list[str]) -> DataFrame:
    """(insurer_id, name) rows that any needle is part of, in either column, ignoring case; blank needles count for nothing."""
    kept = [n.strip().lower() for n in needles if n.strip()]
    if not kept:
        return names.limit(0)
    wanted = F.array(*map(F.lit, kept))
    either = F.exists(wanted, lambda n: F.contains(F.lower("insurer_id"), n) | F.contains(F.lower("name"), n))
    return names.where(either).orderBy("insurer_id")


def by_insurers(rows: DataFrame, names: DataFrame, needles: list[str], strict: bool = False) -> DataFrame:
    """Rows of the insurers that the needles name. Where they name none, all rows; none at all if ``strict``."""
    resolved = resolve_names(names, needles)
    if not strict and (not needles or resolved.isEmpty()):
        return rows
    return rows.join(resolved.select("insurer_id"), "insurer_id", "left_semi")


#: Characters of the pieces by which names and texts meet.
PIECE = 4
#: Names of a scope that are held against each of its texts directly, and texts that one piece may lead to before they are dealt over tasks.
FEW_NAMES, HEAVY = 32, 10_000


def _pieces(text: Column, width: int) -> Column:
    """The different pieces of ``width`` characters; none of a shorter text."""
    n = F.char_length(text) - width + 1
    if width == 0:
        return F.array(F.lit(""))
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(width))))).otherwise(F.array().cast("array<string>"))


def substring_pairs(texts: DataFrame, names: DataFrame, keys: list[str], text: str, name: str, few: int = FEW_NAMES, heavy: int = HEAVY) -> DataFrame:
    """Each row of ``texts`` with each row of ``names`` that has the same ``keys`` and whose ``name`` the ``text`` contains, ignoring case.

    Columns besides the keys must have different names. Null names, and null or empty texts, match nothing; an empty name is part of any text.
    In a scope of few names each is held against each text. In others a text meets only the names
    whose rarest piece of four characters it has (shorter names: the whole name), rarest by the
    number of texts that have it, and a name with a piece that no text has meets none. A piece that leads to very many texts is
    salted. So work follows the hits and near hits, not the product of texts and names.
    """
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    low_text, low_name = F.lower(F.col(f"t.{text}")), F.lower(F.col(f"n.{name}"))
    said = texts.where(F.coalesce(F.col(text), F.lit("")) != "").select(F.struct(*texts.columns).alias("t"))
    known = names.where(F.col(name).isNotNull()).select(F.struct(*names.columns).alias("n"))
    out = [F.col(f"t.{c}").alias(c) for c in texts.columns] + [F.col(f"n.{c}").alias(c) for c in names.columns if c not in keys]
    sizes = staged(known.groupBy(*[F.col(f"n.{k}").alias(k) for k in keys]).agg(F.count(F.lit(1)).alias("size")).select(F.struct(*keys).alias("s"), "size"), "scopes")
    sized = known.join(sizes, same("n", "s"))
    direct = said.join(sized.where(F.col("size") <= few), same("t", "n")).where(F.contains(low_text, low_name)).select(*out)
    large = sizes.where(F.col("size") > few)
    if large.isEmpty():
        return direct
    crowd = staged(sized.where(F.col("size") > few).select("n", low_name.alias("low"), F.least(F.char_length(low_name), F.lit(PIECE)).alias("width")), "names")
    widths = [r[0] for r in crowd.select("width").distinct().collect()]  # at most five
    scoped = said.join(large, same("t", "s"), "left_semi")
    each = scoped.select("t", F.explode(F.array_distinct(F.flatten(F.array(*[_pieces(low_text, w) for w in widths])))).alias("piece"))
    posts = each.groupBy(F.struct(*[f"t.{k}" for k in keys]).alias("s"), F.col("piece").alias("p")).agg(F.count(F.lit(1)).alias("texts"))
    own = F.coalesce(*[F.when(F.col("width") == w, _pieces(F.col("low"), w)) for w in widths])
    distinct = crowd.select(F.struct(*[f"n.{k}" for k in keys]).alias("n"), "low", own.alias("pieces")).distinct()
    counted = distinct.select("n", "low", F.size("pieces").alias("all"), F.explode("pieces").alias("piece")).join(posts, [*same("n", "s"), F.col("piece") == F.col("p")])
    rarest = counted.groupBy("n", "low").agg(F.min_by("piece", F.struct("texts", "piece")).alias("p"), F.min("texts").alias("texts"), F.count(F.lit(1)).alias("found"), F.first("all").alias("all"))
    keyed = rarest.where(F.col("found") == F.col("all")).select(F.col("n").alias("k"), F.col("low").alias("low_"), "p", F.ceil(F.col("texts") / heavy).cast("int").alias("salts"))
    keyed = staged(keyed, "keyed")
    chosen = staged(keyed.select(F.col("k").alias("c"), "p", "salts").distinct(), "pieces")
    met = each.join(chosen, [*same("t", "c"), F.col("piece") == F.col("p")]).select("t", "piece", F.pmod(F.xxhash64("t"), F.col("salts")).cast("int").alias("salt"))
    spread = crowd.join(keyed, [*same("n", "k"), F.col("low") == F.col("low_")]).select("n", "low", "p", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt_"))
    pairs = met.join(spread, [*same("t", "n"), F.col("piece") == F.col("p"), F.col("salt") == F.col("salt_")]).where(F.contains(low_text, F.col("low")))
    return direct.unionByName(pairs.select(*out))


def match_products(documents: DataFrame, products: DataFrame, scope: tuple[str, ...] = ("insurer_id", "page_url")) -> DataFrame:
    """``documents`` (scope, document_id, anchor_text) with product_id of the first product whose name the anchor contains.

    Within its scope products are in the order of ``pos``. A scope's only product needs no match;
    otherwise a document without one gets null. The first is a minimum rather than a sort.
    """
    keys = list(scope)
    named = products.select(*keys, "product_id", "name", "pos")
    single = products.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min_by("product_id", "pos").alias("_only"))
    hits = substring_pairs(documents.select(*keys, "document_id", "anchor_text"), named, keys, "anchor_text", "name")
    first = hits.groupBy(*keys, "document_id").agg(F.min_by("product_id", "pos").alias("_hit"))
    joined = documents.join(first, [*keys, "document_id"], "left").join(single, keys, "left")
    return joined.withColumn("product_id", F.coalesce("_hit", F.when(F.col("_n") == 1, F.col("_only")))).drop("_n", "_only", "_hit")


def match_in_scope(documents: DataFrame, products: DataFrame) -> DataFrame:
    """``match_products`` by page, and for documents of pages without products, by all that their insurer's pages had up to then.

    ``documents`` (insurer_id, page_url, visit, document_id, anchor_text, any more), ``products``
    (insurer_id, page_url, visit, pos, product_id, name). Pages and products are never paired
    without a hit.
    """
    pages = products.select("insurer_id", "page_url").distinct()
    own = match_products(documents.join(pages, ["insurer_id", "page_url"], "left_semi"), products)
    at = F.struct("visit", "pos")
    firsts = products.groupBy("insurer_id", "product_id").agg(F.min(at).alias("_at"), F.min_by("name", at).alias("_name")).withColumnRenamed("product_id", "_product")
    bare = documents.join(pages, ["insurer_id", "page_url"], "left_anti")
    asked = bare.select("insurer_id", "document_id", "visit", "anchor_text").distinct()
    hits = substring_pairs(asked, firsts, ["insurer_id"], "anchor_text", "_name").where(F.col("_at.visit") <= F.col("visit"))
    first = hits.groupBy("insurer_id", "document_id", "visit", "anchor_text").agg(F.min_by("_product", "_at").alias("_hit"))
    # A page has a single candidate if the insurer's second product was seen after it.
    nth = F.row_number().over(Window.partitionBy("insurer_id").orderBy("_at", "_product"))
    two = firsts.withColumn("_nth", nth).where(F.col("_nth") <= 2).groupBy("insurer_id").agg(F.min_by("_product", "_nth").alias("_only"), F.min("_at").alias("_one"), F.max(F.when(F.col("_nth") == 2, F.col("_at"))).alias("_two"))
    first = first.withColumnsRenamed({c: f"_{c}" for c in ("insurer_id", "document_id", "visit", "anchor_text")})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("insurer_id", "document_id", "visit", "anchor_text")]
    found = bare.join(first, same, "left").select(*bare.columns, "_hit").join(two, "insurer_id", "left")
    sole = (F.col("_one.visit") <= F.col("visit")) & (F.col("_two").isNull() | (F.col("_two.visit") > F.col("visit")))
    borrowed = found.withColumn("product_id", F.coalesce("_hit", F.when(sole, F.col("_only")))).drop("_hit", "_only", "_one", "_two")
    return own.unionByName(borrowed)


@dataclass(frozen=True)
class Merge:
    """How versions of a record become one: per column the first seen, the first non-empty, the union of lists, or maps in which later keys win."""

    key: str
    order: str
    first: tuple[str, ...] = ()
    first_filled: tuple[str, ...] = ()
    united: tuple[str, ...] = ()
    later_wins: tuple[str, ...] = ()

    def apply(self, rows: DataFrame) -> DataFrame:
        """One row for each key. Lists and maps are merged by element, with a partial aggregate before each shuffle, so that versions are never gathered."""
        at = F.col(self.order)
        made = [F.min_by(F.struct(*self.first), at).alias("_first"), F.count(F.lit(1)).alias("_n")] if self.first else [F.count(F.lit(1)).alias("_n")]
        for c in self.first_filled:
            filled = F.coalesce(F.col(c), F.lit("")) != ""
            made.append(F.coalesce(F.min_by(F.when(filled, F.col(c)), F.when(filled, at)), F.min_by(c, at)).alias(c))
        out = rows.groupBy(F.col(self.key).alias("_key")).agg(*made)
        for c in self.united:
            each = rows.select(F.col(self.key).alias("_of"), at.alias("_at"), F.posexplode(c).alias("_p", "_v"))
            first = each.groupBy("_of", "_v").agg(F.min(F.struct("_at", "_p")).alias("_o"))
            listed = first.groupBy("_of").agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_v"))), lambda x: x["_v"]).alias(c))
            empty = F.array().cast(rows.schema[c].dataType)
            out = self._joined(out, listed).withColumn(c, F.coalesce(c, empty))
        for c in self.later_wins:
            each = rows.select(F.col(self.key).alias("_of"), at.alias("_at"), F.explode(c).alias("_k", "_v"))
            last = each.groupBy("_of", "_k").agg(F.max_by(F.struct("_v"), "_at").alias("_l"))
            listed = last.groupBy("_of").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_l._v")))).alias(c))
            out = self._joined(out, listed).withColumn(c, F.coalesce(c, F.create_map().cast(rows.schema[c].dataType)))
        columns: list[Column] = [F.col("_key").alias(self.key), *[F.col(f"_first.{c}").alias(c) for c in self.first]]
        return out.select(*columns, *self.first_filled, *self.united, *self.later_wins)

    @staticmethod
    def _joined(out: DataFrame, listed: DataFrame) -> DataFrame:
        return out.join(listed, F.col("_key").eqNullSafe(F.col("_of")), "left").drop("_of")


#: Products: metadata later wins, tags united, description first non-empty, all else as first seen.
PRODUCTS = Merge("product_id", "seq", ("insurer_id", "name", "category", "product_url"), ("description",), ("tags",), ("metadata",))
#: Documents: metadata later wins, path and text first non-empty, all else as first seen, nulls included.
DOCUMENTS = Merge("document_id", "seq", ("insurer_id", "product_id", "document_type", "source_url", "content_hash"), ("local_path", "extracted_text"), (), ("metadata",))


def first_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the earliest."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("_r")).select(key, "_r.*")


@dataclass(frozen=True)
class Upsert:
    """A table's key, the columns a conflict leaves alone, and those it overwrites; of several versions the last in order counts."""

    keys: tuple[str, ...]
    kept: tuple[str, ...]
    written: tuple[str, ...]

    def apply(self, existing: DataFrame, incoming: DataFrame, order: str = "seq") -> DataFrame:
        """The table after the upsert. One struct for each version keeps its columns together, nulls included.

        ``incoming`` has the column ``order``; rows of ``existing`` come before all of them. One
        shuffle by key, with a partial maximum before it.
        """
        columns = [*self.keys, *self.kept, *self.written]
        old = existing.select(*columns, F.lit(None).cast("long").alias(order))
        rows = old.unionByName(incoming.select(*columns, F.col(order).cast("long")))
        at = F.struct(F.col(order).isNotNull(), order)
        made = [F.max_by(F.struct(*self.written), at).alias("_new")]
        if self.kept:
            made.append(F.min_by(F.struct(*self.kept), at).alias("_old"))
        merged = rows.groupBy(*self.keys).agg(*made)
        return merged.select(*self.keys, *[F.col(f"_old.{c}") for c in self.kept], *[F.col(f"_new.{c}") for c in self.written])


INSURERS = Upsert(("insurer_id",), ("source_url",), ("name", "category", "website_url", "metadata_json", "raw_json", "updated_at"))
PRODUCT_ROWS = Upsert(("product_id",), ("insurer_id",), ("name", "category", "product_url", "description", "discovered_from_url", "tags_json", "metadata_json", "updated_at"))
DOCUMENT_ROWS = Upsert(("document_id",), ("insurer_id",), ("product_id", "document_type", "source_url", "local_path", "content_hash", "extracted_text", "metadata_json", "updated_at"))
SECTION_ROWS = Upsert(("product_id", "section_name"), ("category",), ("schema_version", "section_body", "confidence", "source_document_id"))


def upsert_sections(existing: DataFrame, incoming: DataFrame, order: str = "seq", keep_best: bool = False) -> DataFrame:
    """Sections: the last version counts even if it is empty, or with ``keep_best`` the one of highest confidence."""
    if not keep_best:
        return SECTION_ROWS.apply(existing, incoming, order)
    columns = [*SECTION_ROWS.keys, *SECTION_ROWS.kept, *SECTION_ROWS.written]
    rows = existing.select(*columns, F.lit(-1).cast("long").alias(order)).unionByName(incoming.select(*columns, F.col(order).cast("long")))
    best = F.max_by(F.struct(*SECTION_ROWS.written), F.struct("confidence", order)).alias("_new")
    merged = rows.groupBy(*SECTION_ROWS.keys).agg(best, F.min_by(F.struct(*SECTION_ROWS.kept), order).alias("_old"))
    return merged.select(*SECTION_ROWS.keys, "_old.*", "_new.*")


def violations(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose non-null ``key`` has no parent."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def without_parents(child: DataFrame, deleted: DataFrame, key: str, parent_key: str) -> DataFrame:
    """What is left of ``child`` when the deletion of its parents cascades; rows without a parent stay."""
    return _by_key(child, deleted.select(F.col(parent_key).cast(child.schema[key].dataType).alias("_k")), key, "left_anti")


def parents_set_null(child: DataFrame, deleted: DataFrame, key: str, parent_key: str) -> DataFrame:
    """``child`` with ``key`` null where its parent is deleted."""
    joined = _by_key(child, deleted.select(F.col(parent_key).cast(child.schema[key].dataType).alias("_k")), key, "left")
    return joined.withColumn(key, F.when(F.col("_k").isNull(), F.col(key))).drop("_k")


def crawl(roots: DataFrame, links: DataFrame, max_depth: int = 3, max_pages: int = 80) -> DataFrame:
    """Breadth-first visits (root, url, depth, visit) along ``links`` (url, pos, target), each url once, at most ``max_pages`` a root.

    Levels are DataFrames; within one, urls come in the order in which a queue would yield them:
    by the visit of the page that first names them, then by place on it. ``roots``: (root, url).
    Each level is staged, so that no level is computed twice and lineage stays short.
    """
    visited = roots.select("root", "url", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("visit"))
    frontier = visited
    for depth in range(1, max_depth + 1):
        named = frontier.join(links, "url").select("root", F.col("target").alias("url"), F.struct("visit", "pos").alias("at"))
        fresh = named.groupBy("root", "url").agg(F.min("at").alias("at")).join(visited.select("root", "url"), ["root", "url"], "left_anti")
        # Spark cuts each task's rows to the budget before the shuffle.
        nth = F.row_number().over(Window.partitionBy("root").orderBy("at", "url"))
        ranked = fresh.withColumn("nth", nth).where(F.col("nth") <= max_pages)
        seen = visited.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
        placed = ranked.join(seen, "root").select("root", "url", F.lit(depth).alias("depth"), (F.col("n") + F.col("nth") - 1).alias("visit"))
        frontier = staged(placed.where(F.col("visit") < max_pages), "level")
        visited = visited.unionByName(frontier)
    return visited
