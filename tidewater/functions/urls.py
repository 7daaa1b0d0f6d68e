"""URL scalars: schemes, domains, extensions, paths and resolution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.functions.text import let

#: File kinds that documents may have, and their media types.
MEDIA_TYPES = {
    ".pdf": "application/pdf",
    ".doc": "application/msword",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
}
WEB_ADDRESS = r"(?i)(https?://[^\s,;]+|www\.[^\s,;]+)"


def ensure_scheme(url: Column) -> Column:
    """``//host/path`` gets https; anything else, a bare ``www.host`` too, stays."""
    return F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url)


def authority(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def same_domain(a: Column, b: Column) -> Column:
    """Equal, non-empty authorities, port and case included."""
    return (authority(a) == authority(b)) & (authority(a) != "")


#: Schemes whose addresses can be relative to another.
RELATIVE = ("", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms", "prospero", "rtsp", "rtsps", "sftp", "svn", "svn+ssh", "ws", "wss")
#: Scheme, authority with its slashes, path, query and fragment with their marks.
_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"


def _split(url: Column) -> Column:
    """struct<scheme, authority, path, query, fragment>."""
    bare = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    named = lambda u: [F.regexp_extract(u, _PARTS, k) for k in range(1, 6)]

    def parts(u: Column) -> Column:
        scheme, authority_, path, query, fragment = named(u)
        said = lambda part, mark: F.nullif(part, F.lit(mark))  # noqa: E731 - a mark alone says nothing
        empty = F.lit("")
        return F.struct(F.lower(scheme).alias("scheme"), F.coalesce(said(authority_, "//"), empty).alias("authority"), path.alias("path"), F.coalesce(said(query, "?"), empty).alias("query"), F.coalesce(said(fragment, "#"), empty).alias("fragment"))

    return let(bare, parts)


def _without_dots(segments: Column) -> Column:
    """Segments after ``.`` and ``..`` were followed, joined; never empty."""
    step = lambda kept, s: F.when(s == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).when(s == ".", kept).otherwise(F.array_append(kept, s))
    followed = F.aggregate(segments, F.array().cast("array<string>"), step)
    more = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return let(F.array_join(F.concat(followed, more), "/"), lambda path: F.when(path == "", "/").otherwise(path))


def _merged(base: Column, path: Column) -> Column:
    """A base's path and one that isn't empty, put together."""

    def tidy(steps: Column) -> Column:
        inner = F.filter(F.slice(steps, 2, F.greatest(F.size(steps) - 2, F.lit(0))), lambda s: s != "")
        return F.when(F.size(steps) > 2, F.concat(F.slice(steps, 1, 1), inner, F.slice(steps, -1, 1))).otherwise(steps)

    above = let(F.split(base, "/"), lambda x: F.when(F.element_at(x, -1) != "", F.slice(x, 1, F.size(x) - 1)).otherwise(x))
    steps = F.when(path.startswith("/"), F.split(path, "/")).otherwise(F.concat(above, F.split(path, "/")))
    return let(steps, lambda s: let(tidy(s), _without_dots))


def _put_together(u: Column, b: Column) -> Column:
    """``u`` onto ``b``, both split."""
    own, empty = u["authority"] != "", u["path"] == ""
    authority_ = F.when(own, u["authority"]).otherwise(b["authority"])
    path = F.when(own, u["path"]).when(empty, b["path"]).otherwise(_merged(b["path"], u["path"]))
    query = F.when(~own & empty & (u["query"] == ""), b["query"]).otherwise(u["query"])
    scheme = F.when(b["scheme"] != "", F.concat(b["scheme"], F.lit(":"))).otherwise("")
    behind = lambda p: F.when((authority_ != "") & (p != "") & ~p.startswith("/"), F.concat(F.lit("/"), p)).otherwise(p)
    return F.concat(scheme, authority_, let(path, behind), query, u["fragment"])


def absolute_url(base: Column, url: Column) -> Column:
    """``url`` resolved against ``base`` (RFC 3986, 5.2); empty where ``url`` is empty or null.

    An address of another scheme, or of one that knows no relative addresses, stays as it is, and
    so does any without a base. A scheme equal to the base's may stand before a relative address. Empty segments
    inside a path go; a query or fragment that is a mark alone goes.
    """

    def resolved(x: Column) -> Column:
        u, b = x["u"], x["b"]
        foreign = ((u["scheme"] != "") & (u["scheme"] != b["scheme"])) | ~b["scheme"].isin(*RELATIVE)
        return F.when(x["given"] == "", "").when((x["onto"] == "") | foreign, x["given"]).otherwise(_put_together(u, b))

    given, onto = F.coalesce(url, F.lit("")), F.coalesce(base, F.lit(""))
    both = let(F.struct(given.alias("given"), onto.alias("onto")), lambda x: F.struct(x["given"].alias("given"), x["onto"].alias("onto"), _split(x["given"]).alias("u"), _split(x["onto"]).alias("b")))
    return let(both, resolved)


def primary_url(*candidates: Column) -> Column:
    """The first web address in the first candidate that has one, without trailing punctuation; else empty."""

    def first(text: Column) -> Column:
        found = F.regexp_replace(F.regexp_extract(text, WEB_ADDRESS, 1), r"[).,;]+$", "")
        return F.nullif(F.when(F.lower(found).startswith("www."), F.concat(F.lit("https://"), found)).otherwise(found), F.lit(""))

    return F.coalesce(*map(first, candidates), F.lit(""))


def suffix(url: Column) -> Column:
    """The lower-cased suffix of the last path segment, query string included; empty where there is none."""
    last = F.regexp_extract(url, r"([^/]*)/*$", 1)
    return F.lower(F.regexp_extract(last, r".(\.[^.]+)$", 1))


def detect_extension(url: Column) -> Column:
    """A supported suffix; ``.pdf`` where that occurs anywhere; else the suffix, or ``.dat`` without one."""
    own = suffix(url)
    return (
        F.when(own.isin(*MEDIA_TYPES), own)
        .when(F.lower(url).contains(".pdf"), F.lit(".pdf"))
        .when(own != "", own)
        .otherwise(F.lit(".dat"))
    )


def media_type(extension: Column) -> Column:
    return F.coalesce(*[F.when(extension == e, F.lit(m)) for e, m in MEDIA_TYPES.items()])


def local_path(base: str, insurer_id: Column, document_slug: Column, extension: Column) -> Column:
    return F.concat_ws("/", F.lit(base), insurer_id, F.concat(document_slug, extension))


def stored_path(stored: Column, exists: Column, extension: Column, url: Column, fallback_base: str, insurer_id: Column, document_slug: Column) -> Column:
    """The stored path while its file exists; else one built from the recorded extension, the url's suffix, or ``.pdf``."""
    ext = F.coalesce(F.nullif(extension, F.lit("")), F.nullif(suffix(url), F.lit("")), F.lit(".pdf"))
    dotted = F.when(ext.startswith("."), ext).otherwise(F.concat(F.lit("."), ext))
    return F.when(exists & (F.coalesce(stored, F.lit("")) != ""), stored).otherwise(local_path(fallback_base, insurer_id, document_slug, dotted))


def stem(url: Column) -> Column:
    """The last segment, query string included, without its suffix."""
    last = F.regexp_extract(url, r"([^/]*)/*$", 1)
    return F.regexp_replace(last, r"(.)\.[^.]+$", "$1")


def words_of_url(url: Column) -> Column:
    """Lower case, with hyphens, underscores, slashes and ``%20`` as spaces."""
    return F.regexp_replace(F.lower(url), "-|_|/|%20", " ")
