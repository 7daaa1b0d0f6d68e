"""Text scalars: white space, scripts, slugs, headings and highlighted segments."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the Unicode sense, spelled out so that every engine agrees.
WHITE = r"[\s\x0B\x1C-\x1F\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: The same, apart: what ends a line, and what only separates words.
BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
BLANKS = "\t\x1f\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"
_ASCII_WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f "
DEVANAGARI = r"[\x{0900}-\x{097F}]+"


def strip_edges(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "")


def squeeze(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, f"{WHITE}+", " "))


def strip_script(text: Column, script: str = DEVANAGARI) -> Column:
    return F.regexp_replace(text, script, "")


def clean_text(text: Column) -> Column:
    return squeeze(strip_script(text))


@cache
def _residues() -> tuple[str, str, dict[str, str]]:
    """What compatibility decomposition leaves of characters in ASCII: those that become one character, these, and the others.

    Decomposition goes character by character, and what isn't ASCII is dropped, so that a table says it all.
    """
    one, other = {}, {}
    for point in range(0x80, 0x110000):
        if 0xD800 <= point < 0xE000:
            continue
        left = unicodedata.normalize("NFKD", chr(point)).encode("ascii", "ignore").decode()
        if left:
            (one if len(left) == 1 else other)[chr(point)] = left
    return "".join(one), "".join(one.values()), other


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it stands there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _ranges(characters: Iterable[str]) -> str:
    """A class of characters in as few ranges as hold it: each one costs a comparison for every character looked at."""
    spans: list[list[int]] = []
    for point in sorted(map(ord, characters)):
        if spans and spans[-1][1] == point - 1:
            spans[-1][1] = point
        else:
            spans.append([point, point])
    return "[" + "".join(f"\\x{{{x:x}}}-\\x{{{y:x}}}" for x, y in spans) + "]"


def plain_ascii(text: Column) -> Column:
    """Compatibility decomposition (NFKD) without what is not ASCII. Only texts with other characters are looked at further."""
    one, ascii_, other = _residues()
    pairs = F.map_from_arrays(F.array(*map(F.lit, other)), F.array(*map(F.lit, other.values())))

    def spelled(t: Column) -> Column:
        # Of what has no single character, each kind is looked up once, however long the text is.
        kinds = F.array_join(F.array_distinct(F.split(F.regexp_replace(t, r"[\x00-\x7F]+", ""), "")), "")
        found = F.regexp_extract_all(kinds, F.lit(_ranges(other)), F.lit(0))
        return F.regexp_replace(F.aggregate(found, t, lambda a, c: F.replace(a, c, F.try_element_at(pairs, c))), r"[^\x00-\x7F]+", "")

    def folded(t: Column) -> Column:
        return F.when(t.rlike(r"[^\x00-\x7F]"), let(F.translate(t, one, ascii_), spelled)).otherwise(t)

    return let(text, folded)


def slugify(text: Column) -> Column:
    """Lower-case ASCII words joined by hyphens; hyphens at the ends and underscores stay."""
    kept = F.regexp_replace(plain_ascii(text), r"[^\w\s\x0B\x1C-\x1F-]+", "")
    return F.regexp_replace(F.lower(F.trim(kept, F.lit(_ASCII_WHITE))), r"[-\s\x0B\x1C-\x1F]+", "-")


def ordered_distinct(items: Column) -> Column:
    """Each non-empty item once, in order of first appearance."""
    return F.array_distinct(F.filter(items, lambda x: x.isNotNull() & (x != "")))


def lines(text: Column) -> Column:
    """Cleaned, non-blank lines, in two character-wise passes and one cheap expression over the whole text.

    Every kind of break becomes a newline (two for CR LF, as blank lines go anyway), every kind
    of blank a space.
    """
    plain = F.translate(strip_script(text), BREAKS + BLANKS, "\n" * len(BREAKS) + " " * len(BLANKS))
    split = F.split(F.regexp_replace(plain, "  +", " "), "\n")
    return F.filter(F.transform(split, lambda x: F.trim(x)), lambda x: x != "")


def is_heading(line: Column) -> Column:
    """A short line that is upper-case for the most part, or has no letters, or reads like a title."""
    return is_clean_heading(strip_edges(line))


def is_clean_heading(line: Column) -> Column:
    """``is_heading`` for a line without white space at its ends. Long lines are done after a look at their length."""
    title = heading_title(line)
    uppers = F.char_length(F.regexp_replace(title, r"[^\p{Lu}]+", ""))
    lowers = F.char_length(F.regexp_replace(title, r"[^\p{Ll}]+", ""))
    words = F.size(F.filter(F.split(title, f"{WHITE}+"), lambda w: w != ""))
    return F.char_length(title).between(1, 120) & (words <= 12) & ((uppers >= lowers) | title.rlike(r"^[A-Z][A-Za-z0-9\s/&,-]{3,}$"))


def heading_title(line: Column) -> Column:
    return F.rtrim(line, F.lit(":"))


def highlight(text: Column, query: str) -> Column:
    """``text`` as array<struct<text, match>>: what any word of ``query`` matches, ignoring case, and what lies between.

    A blank query gives one unmatched segment. Matches are leftmost; of words that match at one
    place the first in the query wins.
    """
    tokens = [t for t in re.split(r"\s+", query.strip()) if t]
    whole = F.array(F.struct(text.alias("text"), F.lit(False).alias("match")))
    if not tokens:
        return whole
    pattern = "(?iu)(" + "|".join(re.sub(r"([^\w\s])", r"\\\1", t) for t in tokens) + ")"
    marked = F.split(F.regexp_replace(text, pattern, "\x00\x01$1\x00"), "\x00")
    parts = F.transform(marked, lambda p: F.struct(F.regexp_replace(p, "^\x01", "").alias("text"), p.startswith("\x01").alias("match")))
    found = F.filter(parts, lambda p: p["text"] != "")
    return F.when(text == "", whole).otherwise(found)
