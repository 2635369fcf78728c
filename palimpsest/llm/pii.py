"""Personal data, also in disguise, with spans in the source text.

Plain identifiers are found in the text as it is.  For disguised ones two
transducers rewrite the text and keep where each part came from: the first puts
ASCII for look-alike characters and drops invisible ones, the second reads
spelled digits and "at"/"dot" disguises.  The same detectors then run over the
rewritten text, and what they find is mapped back through both maps.  Spans
that need no rewriting, or that lie within a plain one of their kind, add nothing.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import documents_of
from .tokens import slices

#: Kinds in the order that sorts spans of one start.
KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# Leftmost matches of plain [0-9]+ start at the first digit of a run, so looking behind saves rescans of long runs.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def plain_spans(text: str) -> list[Span]:
    """Identifiers of each kind, leftmost and without overlap within a kind."""
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        # The address starts where the run of local characters before @ does, behind the last address.
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)
    for m in _IP.finditer(text):
        # Only the value counts, however many zeros lead it.
        if all(len(v) <= 3 and int(v or "0") <= 255 for v in (p.lstrip("0") for p in m[0].split("."))):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


class Rewriting:
    """A rewritten text and where its parts came from."""

    def __init__(self, source: str, pattern: re.Pattern, write: Callable[[re.Match], str | None]):
        parts: list[str] = []
        #: Starts in the new text; for each part where it lies in the source and whether it is a copy.
        self.starts: list[int] = []
        self.parts: list[tuple[int, int, bool]] = []
        size = last = 0

        def add(text: str, a: int, b: int, copy: bool) -> None:
            nonlocal size
            if text:
                parts.append(text)
                self.starts.append(size)
                self.parts.append((a, b, copy))
                size += len(text)

        self.changed = False
        for m in pattern.finditer(source):
            new = write(m)
            if new is None or new == m[0]:
                continue
            add(source[last : m.start()], last, m.start(), True)
            add(new, m.start(), m.end(), False)
            last = m.end()
            self.changed = True
        add(source[last:], last, len(source), True)
        self.text = "".join(parts) if self.changed else source

    def source_span(self, start: int, end: int) -> tuple[int, int, bool]:
        """The source of new[start:end], and whether any of it was rewritten."""
        i, j = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        a, _, copied = self.parts[i]
        b, c, copied_end = self.parts[j]
        new_end = b + end - self.starts[j] if copied_end else c
        return a + start - self.starts[i] if copied else a, new_end, not (copied and copied_end and i == j)


# Letters of other scripts that look like ASCII ones.
LOOK_ALIKES = dict(zip(
    "аеорсухіѕјһԁӏԛԝАВЕКМНОРСТХІЅЈУοανρικτυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
    "aeopcyxisjhdlqwABEKMHOPCTXISJYoavpiktuABEZHIKMNOPTYX",
))
DASHES = "‐‑‒–—―−"
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
INVISIBLE = "­​‌‍⁠﻿"
# Names of digits in English, German, French and Spanish, and of signs.
DIGITS = {
    name: digit
    for names in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for digit, name in zip("0123456789", names.split())
} | {"oh": "0", "zwo": "2"}
TOP_DOMAINS = "com|org|net|edu|gov|info|biz|io|co|dev|app|uk|de|fr|es|eu|us|ca|example|test"


@cache
def characters() -> dict[str, str]:
    """ASCII for each look-alike: the fixed ones, decimal digits of all scripts, and compatibility forms."""
    out = dict(LOOK_ALIKES) | dict.fromkeys(DASHES, "-") | dict.fromkeys(SPACES, " ") | dict.fromkeys(INVISIBLE, "") | {"。": "."}
    for i in (*range(0x00B5, 0xD800), *range(0xE000, 0x1_0000), *range(0x1_D400, 0x1_D800), *range(0x1_F100, 0x1_F200)):
        c = chr(i)
        if c in out or c in "ªº²³¹":
            continue
        if unicodedata.category(c) == "Nd":
            out[c] = str(unicodedata.decimal(c))
        else:
            plain = unicodedata.normalize("NFKC", c)
            if len(plain) == 1 and "!" <= plain <= "~":
                out[c] = plain
    return out


def _class_of(chars: str) -> str:
    """Inside of a character class with runs written as ranges."""
    codes, out = sorted(map(ord, chars)), []
    i = 0
    while i < len(codes):
        j = i
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        out.append(re.escape(chr(codes[i])) + (("-" + re.escape(chr(codes[j]))) if j > i else ""))
        i = j + 1
    return "".join(out)


_NAMES = "|".join(sorted(DIGITS, key=len, reverse=True))  # "un" must not cut "uno" short
_NUMBER = f"(?:(?:double |triple )?(?:{_NAMES}))"
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_DOT = rf"(?:\x20{{0,3}}{_OPEN}\x20{{0,3}}(?:dot|punto|punkt|point|\.)\x20{{0,3}}{_CLOSE}\x20{{0,3}}|\x20{{1,3}}(?:dot|punto|punkt)\x20{{1,3}}|_(?:dot|punto|punkt)_)"
_LABEL = r"[A-Za-z0-9-]{1,63}"
_DISGUISE = re.compile(
    rf"(?P<at>\x20{{0,3}}{_OPEN}\x20{{0,3}}(?:at|arroba|@)\x20{{0,3}}{_CLOSE}\x20{{0,3}}|(?<=[A-Za-z0-9_])\x20{{1,3}}@\x20{{0,3}}(?=[A-Za-z0-9])|(?<=[A-Za-z0-9_])@\x20{{1,3}}(?=[A-Za-z0-9])"
    rf"|(?<=[A-Za-z0-9_])(?:\x20{{1,3}}(?:at|arroba)\x20{{1,3}}|_(?:at|arroba)_)(?={_LABEL}(?:\.{_LABEL})*{_DOT}{_LABEL}))"
    rf"|(?P<word>(?<=[A-Za-z0-9_])\x20(?:at|arroba)\x20(?=(?:{_LABEL}\.)+(?:{TOP_DOMAINS})(?![A-Za-z0-9-])))"
    rf"|(?P<dot>(?<=[A-Za-z0-9_]){_DOT}(?=[A-Za-z0-9]))"
    rf"|(?P<plus>\b(?:plus|más)\x20{{1,3}}(?=[0-9]|{_NUMBER}\b)|{_OPEN}plus{_CLOSE}\x20{{0,3}})"
    rf"|(?P<number>\b{_NUMBER}(?:[\x20-]{{1,2}}{_NUMBER})*\b)"
    r"|(?P<digits>(?<![A-Za-z0-9])(?=[0-9OoIl]*[0-9])[0-9OoIl]{2,}(?![A-Za-z0-9]))",
    re.IGNORECASE,
)
_ONE_NUMBER = re.compile(rf"(?:(double|triple) )?\b({_NAMES})\b", re.IGNORECASE)
_IN_DIGITS = str.maketrans("OoIl", "0011")


def _write_disguise(m: re.Match) -> str | None:
    kind = m.lastgroup
    if kind == "at":
        return "@"
    if kind == "word":
        # A word "at" before a plain domain is prose unless what precedes it can be no word.
        start = m.start()
        while start and m.string[start - 1] in _LOCAL:
            start -= 1
        return "@" if re.search(r"[0-9._+%-]", m.string[start : m.start()].strip(".")) else None
    if kind == "dot":
        return "."
    if kind == "plus":
        return "+"
    if kind == "number":
        return "".join(DIGITS[x[2].lower()] * {"double": 2, "triple": 3}.get((x[1] or "").lower(), 1) for x in _ONE_NUMBER.finditer(m[0]))
    return m[0].translate(_IN_DIGITS) if sum(c.isdigit() for c in m[0]) * 2 >= len(m[0]) else None


@cache
def _alike() -> re.Pattern:
    return re.compile(f"[{_class_of(''.join(characters()))}]")


@cache
def _hints() -> str:
    """What every text with an added span has, for a quick look at a batch (RE2, no look-around).

    Each text that a transducer changes matches, but for lone names of digits: to be in a span of
    digits, a name must have a digit or another name behind or before blanks, dots, hyphens and brackets,
    and in an address it only stands for itself, if it is ASCII (the others are hints).  RE2's ASCII ``\\b`` holds wherever Python's does here:
    letters beyond ASCII that equal ASCII ones without case are hints themselves.
    """
    alike = "".join(characters()) + "\u0130\u0131"
    names, multiple, between = _NAMES, "(double|triple) ", "[ ().-]+"
    return (
        "[" + "".join(f"\\x{{{ord(a):x}}}-\\x{{{ord(b):x}}}" for a, b in _runs(alike)) + "]"
        rf"|(?i:{'|'.join(n for n in DIGITS if not n.isascii())})"
        rf"|(?i:{_OPEN} {{0,3}}(at|arroba|@|dot|punto|punkt|point|plus|\.) {{0,3}}{_CLOSE}| (dot|punto|punkt) |_(dot|punto|punkt)_| @|@ "
        rf"|\b{multiple}({names})\b|\b({names}){between}([0-9]|({multiple})?({names})\b)|[0-9]{between}({names})\b"
        rf"|\b(plus|más) {{1,3}}([0-9]|({multiple})?({names}))| (at|arroba) ([a-z0-9-]+\.)+({TOP_DOMAINS})"
        r"|(^|[^a-z0-9])[0-9oil]*([0-9][oil]|[oil][0-9])[0-9oil]*([^a-z0-9]|$))"
    )


def _runs(chars: str) -> list[tuple[str, str]]:
    codes, out = sorted(map(ord, chars)), []
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return [(chr(a), chr(b)) for a, b in out]


def disguised_spans(text: str, plain: list[Span]) -> list[Span]:
    """Spans of the source that only the rewritten text shows."""
    first = Rewriting(text, _alike(), lambda m: characters()[m[0]])
    second = Rewriting(first.text, _DISGUISE, _write_disguise)
    if not (first.changed or second.changed):
        return []
    taken: dict[str, list[tuple[int, int]]] = {}
    for kind, a, b in plain:
        taken.setdefault(kind, []).append((a, b))
    for spans in taken.values():
        spans.sort()
    out = []
    for kind, a, b in plain_spans(second.text):
        x, y, new = second.source_span(a, b) if second.changed else (a, b, False)
        p, q, newer = first.source_span(x, y) if first.changed else (x, y, False)
        while p < q and text[p] in " ":
            p += 1
        while q > p and text[q - 1] in " ":
            q -= 1
        if new or newer:
            spans = taken.get(kind, [])
            k = bisect_right(spans, (p, len(text) + 1))  # the last plain span that starts at p or before
            if not (k and spans[k - 1][1] >= q):
                out.append((kind, p, q))
    return out


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in in_order(spans))


def batch_spans(texts: pa.Array) -> Iterator[tuple[str | None, list[Span], list[Span]]]:
    """For each text (no nulls): the text if it has spans, its plain spans and all its spans."""
    plain = pc.match_substring_regex(texts, r"@|\+[0-9]|[0-9][. -]?[0-9]").to_pylist()
    hinted = pc.match_substring_regex(texts, _hints()).to_pylist()
    for i, (p, h) in enumerate(zip(plain, hinted)):
        if not (p or h):
            yield None, [], []
            continue
        text = texts[i].as_py()
        base = plain_spans(text) if p else []
        yield text, base, base + disguised_spans(text, base) if h else base


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` (plain spans), ``base_sha256`` (of the plain spans, written) and ``spans`` (all, written as kind:start:end).

    Offsets count code points.  Null or empty text has no spans.  Rows are read
    one by one, so repeated rows, ties and null ids need no rule; an empty table
    stays empty, and the time is in proportion to the length of a text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                cols: list[list] = [[] for _ in range(6)]
                for _, base, spans in batch_spans(part.column(1).cast(pa.string())):
                    for c, kind in zip(cols, KINDS):
                        c.append(sum(s[0] == kind for s in base))
                    cols[4].append(hashlib.sha256(written(base).encode()).hexdigest())
                    cols[5].append(written(spans))
                types = [pa.int64()] * 4 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return documents_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the kind of its first in brackets."""
    out, at = [], 0
    for kind, a, b in in_order(spans):
        if a >= at:
            out.append(text[at:a] + f"<{kind.upper()}>")
        at = max(at, b)
    return "".join(out) + text[at:]


def mask_private(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, with the personal data in ``text_col`` masked.

    Null text stays null and empty text empty.  Rows are read one by one, so
    repeated rows, ties and other columns, whatever their names, stay as they
    are; an empty table stays empty.
    """
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, where):
                column = part.column(where).cast(pa.string())
                texts = column.fill_null("").to_pylist()
                for i, (text, _, spans) in enumerate(batch_spans(column.fill_null(""))):
                    if spans:
                        texts[i] = masked(text, spans)
                new = pa.array([t if v else None for t, v in zip(texts, column.is_valid().to_pylist())], part.schema.field(where).type)
                yield part.set_column(where, part.schema.field(where), new)

    return docs.mapInArrow(run, docs.schema)
