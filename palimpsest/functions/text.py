"""Scalar text functions: Column in, Column out, all built-in expressions.

White space and word characters are those of Unicode, as ``(?U)`` makes Java's
regular expressions read them.  Null in gives null out unless a docstring says
otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# A cut-off cross-reference note that some bodies carry, and how prose and comment are joined.
REFERENCE_NOTE = r"(?U)(?:\n\s*|\s*(?:;\s*)+)eferred to in [^\n]*"
COMMENT_HEADING = "\n\nComment\n\n"
# Fixed value: what stands for a table without rows.
NO_ITEMS = "_No items._"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+\z", "")


def collapse_space(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.btrim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalized_body(c: Column, drop_note: bool = True) -> Column:
    """Line ends as line feeds, no white space at the end, the cut-off note gone if asked for."""
    text = rstrip(F.replace(c, F.lit("\r\n"), F.lit("\n")))
    return rstrip(F.regexp_replace(text, REFERENCE_NOTE, "")) if drop_note else text


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def combined_text(prose: Column, comment: Column) -> Column:
    """Prose, and the comment under its heading if there is one."""
    some = F.coalesce(strip(comment), F.lit("")) != ""
    return F.when(some, F.concat(prose, F.lit(COMMENT_HEADING), comment)).otherwise(prose)


def trimmed_number(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"[.:]+\z", "")


def chapter_of(path: Column, colon: bool = False) -> Column:
    """What stands before the first full stop (or colon, if that separates too)."""
    return F.regexp_extract(path, r"\A[^.:]*" if colon else r"\A[^.]*", 0)


def ordinal_of(path: Column, colon: bool = False) -> Column:
    """What stands after the first separator; the whole path if there is none."""
    mark = "[.:]" if colon else r"\."
    return F.when(path.rlike(mark), F.regexp_extract(path, rf"\A.*?{mark}((?s).*)\z", 1)).otherwise(path)


def natural_key(c: Column, width: int = 20) -> Column:
    """A string that sorts runs of digits as numbers."""
    padded = F.regexp_replace(c, r"([0-9]+)", "0" * width + "$1")
    return F.regexp_replace(padded, rf"0*([0-9]{{{width}}})(?![0-9])", "$1")


def number_first_key(c: Column) -> Column:
    """Plain numbers by value, then all other strings."""
    n = F.when(c.rlike(r"\A[0-9]+\z"), c.try_cast("decimal(38,0)"))
    return F.struct(n.isNull(), n, c)


def ordinal_key(c: Column) -> Column:
    """Parts between full stops or colons as (number, letters behind it)."""
    parts = F.split(F.replace(c, F.lit(":"), F.lit(".")), r"\.", -1)
    number = lambda p: F.coalesce(F.regexp_extract(p, r"\A([0-9]*)", 1).try_cast("decimal(38,0)"), F.lit(0))
    return F.transform(parts, lambda p: F.struct(number(p).alias("n"), F.regexp_extract(p, r"\A[0-9]*(.*)\z", 1).alias("tail")))


def filled_url(template: Column, year: Column, path: Column) -> Column:
    """The template with {year} and {path} filled in; empty if it asks for more, or is null."""
    out = F.replace(F.replace(template, F.lit("{year}"), year.cast("string")), F.lit("{path}"), path)
    return F.when(template.isNull() | out.contains("{"), F.lit("")).otherwise(out)


def first_filled(*cols: Column) -> Column:
    """The first that is neither null nor empty, else empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def snippet(c: Column, size: int = 280) -> Column:
    """One line of at most ``size`` characters, with an ellipsis if cut."""
    return truncated(F.translate(strip(c), "\n", " "), size)


def truncated(c: Column, size: int) -> Column:
    """Without white space at the ends, and at most ``size`` characters, the last an ellipsis if cut."""
    one = strip(c)
    return F.when(F.length(one) <= size, one).otherwise(F.concat(rstrip(F.substring(one, 1, size - 1)), F.lit("…")))


def body_excerpt(c: Column, size: int = 800, back: int = 80) -> Column:
    """At most ``size`` characters, cut at a blank if one is among the last ``back``."""
    text = rstrip(c)
    cut = F.substring(text, 1, size)
    gap = F.instr(F.reverse(cut), " ")  # 1 for a blank at the very end
    at = F.length(cut) - gap
    kept = F.when((gap > 0) & (at > size - back), F.substring(cut, F.lit(1), at)).otherwise(cut)
    return F.when(F.length(text) <= size, text).otherwise(F.concat(rstrip(kept), F.lit("…")))


def excerpt_around(body: Column, quote: Column, context: int = 100) -> Column:
    """The quote with ``context`` characters on both sides; the quote alone if it isn't there."""
    at = F.instr(F.lower(body), F.lower(quote)) - 1
    start = F.greatest(F.lit(0), at - context)
    end = F.least(F.length(body), at + F.length(quote) + context)
    cut = F.substring(body, start + 1, end - start)
    return F.when(at < 0, quote).otherwise(F.concat(F.when(start > 0, F.lit("…")).otherwise(""), cut, F.when(end < F.length(body), F.lit("…")).otherwise("")))


def search_snippet(body: Column, query: Column, size: int = 240) -> Column:
    """About ``size`` characters around the first term of the query (three characters or more) that occurs, cut at blanks."""
    one = collapse_space(body)
    terms = F.filter(F.split(F.lower(collapse_space(query)), " "), lambda t: F.length(t) >= 3)
    places = F.filter(F.transform(terms, lambda t: F.instr(F.lower(one), t)), lambda p: p > 0)
    at = F.get(places, F.lit(0)) - 1
    start = F.greatest(F.lit(0), at - size // 3)
    end = F.least(F.length(one), start + size)
    piece = F.substring(one, start + 1, end - start)
    led = F.when(start > 0, F.concat(F.lit("…"), F.when(piece.contains(" "), F.regexp_replace(piece, r"\A[^ ]* ", "")).otherwise(piece))).otherwise(piece)
    both = F.when(end < F.length(one), F.concat(F.regexp_replace(led, r" [^ ]*\z", ""), F.lit("…"))).otherwise(led)
    head = F.concat(rstrip(F.regexp_replace(F.substring(one, 1, size - 1), r" [^ ]*\z", "")), F.lit("…"))
    return F.when(F.length(one) <= size, one).when(at.isNull(), head).otherwise(strip(both))


def all_capitals(c: Column) -> Column:
    """Three letters or more, and every letter a capital."""
    return ~c.rlike(r"[\p{L}&&[^\p{Lu}]]") & c.rlike(r"(?:\p{L}\P{L}*){3}")


def markdown_escape(c: Column) -> Column:
    """What a cell may hold: bars escaped, line ends as blanks; null is empty."""
    return F.translate(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), "\n\r", "  ")


def markdown_row(*cols: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[markdown_escape(c.cast("string")) for c in cols]), F.lit(" |"))


def markdown_table(heads: Sequence[str], rows: Column) -> Column:
    """A table of rows (an array of :func:`markdown_row`), or a line that there are none."""
    top = "\n".join(("| " + " | ".join(heads) + " |", "|" + "---|" * len(heads)))
    return F.when(F.coalesce(F.size(rows), F.lit(0)) > 0, F.concat_ws("\n", F.lit(top), rows)).otherwise(NO_ITEMS)


def embedding_text(heading: Column, body: Column) -> Column:
    return strip(F.concat(F.coalesce(heading, F.lit("")), F.lit("\n\n"), F.coalesce(body, F.lit(""))))


def entity_tag(c: Column) -> Column:
    """The first 16 hex digits of a value's SHA-1, by its JSON."""
    return F.substring(F.sha1(F.to_json(c)), 1, 16)


def contains_folded(body: Column, needle: Column) -> Column:
    """Whether the needle, literally, occurs in any case."""
    return F.contains(F.lower(body), F.lower(needle))
