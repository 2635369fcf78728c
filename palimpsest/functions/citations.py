"""The citation grammar as Column expressions.

A citation is any run of sign words, a chapter (digits and perhaps a letter),
perhaps a separator and the rest of a section number, perhaps subdivisions in
brackets.  Text behind it is ignored.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words and signs that announce a citation, and the shape of what follows.
SIGNS = (
    r"iowa code",
    r"i\.?\s*c\.?",
    r"iowa\s+ct\.?\s*r\.?",
    r"iowa\s+r\.?\s*civ\.?\s*p\.?",
    r"iowa\s+r\.?\s*crim\.?\s*p\.?",
    r"iowa\s+r\.?\s*app\.?\s*p\.?",
    r"iowa\s+r\.?\s*evid\.?",
    r"iowa\s+rs?\.?\s*(?:of\s+)?prof(?:'l|essional)?\.?\s*conduct",
    r"iowa\s+rules?\s+of\s+(?:civil|criminal|appellate)\s+procedure",
    r"iowa\s+rules?\s+of\s+evidence",
    r"iowa\s+rules?\s+of\s+professional\s+conduct",
    r"§§?",
    r"sec(?:tion|s\.?|\.)?",
    r"ch(?:apter|\.)?",
    r"rules?\.?",
    r"r\.",
)
SIGN = r"(?:\s*(?:" + "|".join(SIGNS) + r")\s*)"
NUMBER = r"(\d+[A-Z]?)(?:\s*([.:])\s*(\w[\w.]*))?((?:\s*\([^)]+\))*)"
FREE_TEXT = r"(?:(?:Iowa Code\s+)?(?:§§?|\bsec(?:tion|s\.?|\.)?\b|\bI\.?C\.?\b|\bch(?:apter|\.)?\b)\s*)?\d+[A-Z]?(?:\.\w+)?(?:\s*\([^)]+\))*"
SERIES_ITEM = r"\d+[A-Z]?(?:[.:][\w.]+)?"
SERIES_LIST = SERIES_ITEM + r"(?:(?:\s*(?:,|;|&|\band\b|\bor\b))+\s+" + SERIES_ITEM + r")+"
CHAPTER_SERIES = r"\bchapters?\s+(" + SERIES_LIST + r")"
SECTION_SERIES = r"\b(?:sections?|§§?)\s+(" + SERIES_LIST + r")"
SECTION_ITEM = r"\d+[A-Z]?[.:][\w.]+"

_WHOLE = r"(?iU)\A\s*" + SIGN + r"*+\s*" + NUMBER


def parse(text: Column) -> Column:
    """struct<chapter, section, subdivisions, path, chapter_only>, null if the text is no citation."""
    got = lambda k: F.regexp_extract(text, _WHOLE, k)
    section = F.when(got(3) != "", F.concat(got(1), got(2), got(3)))
    subs = F.regexp_extract_all(got(4), F.lit(r"(?U)\(\s*([^)\s]+)\s*\)"), 1)
    made = F.struct(
        got(1).alias("chapter"),
        section.alias("section"),
        F.when(section.isNotNull(), subs).otherwise(F.array().cast("array<string>")).alias("subdivisions"),
        F.coalesce(section, got(1)).alias("path"),
        section.isNull().alias("chapter_only"),
    )
    return F.when(text.rlike(_WHOLE), made)


def has_sign(text: Column) -> Column:
    """Whether the text begins with a sign word."""
    return text.rlike(r"(?iU)\A" + SIGN)


def find_all(text: Column) -> Column:
    """All substrings of free text that have the shape of a citation, in order."""
    return F.regexp_extract_all(text, F.lit("(?iU)" + FREE_TEXT), 0)


def spans(c: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, raw>> of all matches of ``pattern`` (never empty ones), in characters; ``group``: of that part, which must end its match.

    One pass of the pattern puts a mark before and behind each match; what
    lies between marks has the lengths that add up to the offsets.
    """
    before, behind = "\x01", "\x02"
    flagged = "(?iU)" + pattern
    marked = F.regexp_replace(F.translate(c, before + behind, "\x03\x03"), flagged, f"{before}$0{behind}")
    pieces = F.filter(F.split(marked, behind, -1), lambda p: p.contains(before))
    sizes = F.transform(pieces, lambda p: F.struct((F.instr(p, before) - 1).alias("gap"), (F.length(p) - 1).alias("both")))
    none = F.array().cast("array<struct<start: int, end: int>>")

    def added(done: Column, size: Column) -> Column:
        last = F.coalesce(F.get(done, F.size(done) - 1)["end"], F.lit(0))
        return F.array_append(done, F.struct((last + size["gap"]).alias("start"), (last + size["both"]).alias("end")))

    def named(s: Column) -> Column:
        raw = F.substring(c, s["start"] + 1, s["end"] - s["start"])
        raw = F.regexp_extract(raw, flagged, group) if group else raw
        return F.struct((s["end"] - F.length(raw)).alias("start"), s["end"].alias("end"), raw.alias("raw"))

    return F.transform(F.aggregate(sizes, none, added), named)


#: How a section and a chapter are announced in each style.
FORMS = {"long": ("Iowa Code § ", "Iowa Code ch. "), "short": ("I.C. § ", "I.C. ch. "), "bare": ("", "")}


def render(c: Column, style: str = "long") -> Column:
    """A parsed citation in ``long``, ``short`` or ``bare`` form, its subdivisions appended; null for null."""
    section, chapter = FORMS[style]
    body = F.concat(c["path"], F.array_join(F.transform(c["subdivisions"], lambda s: F.concat(F.lit("("), s, F.lit(")"))), ""))
    return F.concat(F.when(c["chapter_only"], F.lit(chapter)).otherwise(F.lit(section)), body)
