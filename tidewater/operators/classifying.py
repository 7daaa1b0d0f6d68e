"""Keyword ladders: product names, categories, tags, document types and download links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.functions.urls import authority, same_domain, words_of_url

#: Keyword lists; of categories and document types the first that fits decides.
PRODUCT_WORDS = ("plan", "policy", "insurance", "cover", "product")
DOCUMENT_TYPES = {
    "policy_wording": ("policy wording", "policy wordings", "policy document", "policy schedule"),
    "brochure": ("brochure", "leaflet"),
    "prospectus": ("prospectus", "sales brochure"),
}
DOCUMENT_WORDS = ("policy", "wording", "brochure", "prospectus", "schedule", "leaflet")
CATEGORIES = {
    "health": ("health", "medi", "mediclaim", "hospital"),
    "motor": ("motor", "car", "bike", "vehicle", "auto"),
    "life_term": ("term", "term plan", "life cover"),
    "life_savings": ("traditional", "savings", "endowment", "money back", "investment"),
}
REQUIRED_TYPES = ("brochure", "policy_wording", "prospectus")
DOCUMENT_SUFFIXES = (".pdf", ".doc", ".docx")
SKIPPED_SUFFIXES = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".zip", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".mp4", ".mp3", ".avi", ".mov")
SKIPPED_SCHEMES = ("mailto:", "tel:", "javascript:")
URL_HINTS = ("download", "downloads", "product-brochure", "productbrochure", "policy-wording", "policy_wording", "policywording", "policy-document")
TEXT_HINTS = ("download", "downloads", "brochure", "product brochure", "policy wording", "policy wordings", "policy document", "policy schedule")


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether ``text`` contains any of ``words``; both lower case."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def _low(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def potential_product(title: Column, words: tuple[str, ...] = PRODUCT_WORDS) -> Column:
    return has_any(_low(title), words) & (F.char_length(title) > 5)


def category(title: Column, page_text: Column, categories: dict[str, tuple[str, ...]] = CATEGORIES) -> Column:
    """The first category with a word in the title or the page's text; ``other`` without one."""
    text = F.concat(_low(title), F.lit(" "), _low(page_text))
    return F.coalesce(*[F.when(has_any(text, words), F.lit(name)) for name, words in categories.items()], F.lit("other"))


def tags(title: Column, categories: dict[str, tuple[str, ...]] = CATEGORIES) -> Column:
    """All categories with a word in the title, as array<string>."""
    return F.filter(F.array(*[F.when(has_any(_low(title), words), F.lit(name)) for name, words in categories.items()]), lambda x: x.isNotNull())


def document_type(anchor: Column, url: Column, types: dict[str, tuple[str, ...]] = DOCUMENT_TYPES) -> Column:
    """By the anchor's text before the url's; ``other`` where neither tells."""
    text, raw = _low(anchor), _low(url)
    spaced = F.regexp_replace(raw, "[-_]", " ")
    by_text = [F.when(has_any(text, words), F.lit(name)) for name, words in types.items()]
    by_url = [F.when(has_any(spaced, words) | has_any(raw, tuple(w.replace(" ", "") for w in words)), F.lit(name)) for name, words in types.items()]
    return F.coalesce(*by_text, *by_url, F.lit("other"))


def path_only(url: Column) -> Column:
    return F.regexp_replace(F.lower(url), r"[?#].*$", "")


def is_document_link(anchor: Column, url: Column, words: tuple[str, ...] = DOCUMENT_WORDS) -> Column:
    """A document suffix, and a document word in the anchor's text or the url's path."""
    path = path_only(url)
    suffixed = reduce(lambda a, b: a | b, [path.endswith(s) for s in DOCUMENT_SUFFIXES])
    return suffixed & has_any(F.concat(_low(anchor), F.lit(" "), words_of_url(path)), words)


def is_download_link(anchor: Column, url: Column, attributes: Column, ancestors: Column) -> Column:
    """Hints in the url, the anchor's text, its attributes, or those of its nearest ancestors (array<string> each)."""
    hinted = lambda items: F.exists(F.coalesce(items, F.array().cast("array<string>")), lambda x: has_any(F.lower(x), TEXT_HINTS))
    return has_any(_low(url), URL_HINTS) | has_any(_low(anchor), TEXT_HINTS) | hinted(attributes) | hinted(ancestors)


def is_crawlable(href: Column, absolute: Column, root: Column) -> Column:
    """A page of the root's own domain, not a file or another scheme."""
    schemes = reduce(lambda a, b: a | b, [href.startswith(s) for s in SKIPPED_SCHEMES])
    files = reduce(lambda a, b: a | b, [path_only(absolute).endswith(s) for s in SKIPPED_SUFFIXES])
    return ~schemes & ~files & same_domain(absolute, root) & (authority(root) != "")
