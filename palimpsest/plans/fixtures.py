"""The driver's tables seen as a versioned corpus.

Sources are languages, chapters the numbers of ``documents.source``, sections
the documents; review status and repeals come from ``labels``.  Conversations
stand for histories: each turn is a version that the next one ends.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.sources import probes as probe_files


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("source")).distinct()


def nodes(spark: SparkSession, sf_dir: str, headings: bool = True) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("chapter", F.regexp_extract("source", "[0-9]+", 0))
    flags = table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("bad"))
    head = F.substring_index("text", "\n", 1) if headings else F.lit("")
    sections = d.join(flags, "doc_id", "left").select(F.col("doc_id").alias("node_id"), F.col("lang").alias("source"), F.concat("chapter", F.lit("."), "doc_id").alias("path"), F.col("chapter").alias("parent_path"), head.alias("heading"), F.coalesce("bad", F.lit(False)).alias("is_repealed"))
    tops = d.select("lang", "chapter").distinct()
    tops = tops.select((-F.abs(F.xxhash64("lang", "chapter"))).alias("node_id"), F.col("lang").alias("source"), F.col("chapter").alias("path"), F.lit(None).cast("string").alias("parent_path"), F.concat(F.lit("Chapter "), "chapter").alias("heading"), F.lit(False).alias("is_repealed"))
    return sections.unionByName(tops)


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("quality") == 1, "approved").when(F.col("quality") == 0, "rejected").otherwise("pending")
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return d.select(
        F.col("doc_id").alias("version_id"),
        F.col("doc_id").alias("node_id"),
        F.col("text").alias("body"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).alias("effective_from"),
        F.lit(None).cast("date").alias("effective_to"),
        status.alias("review_status"),
        text.content_hash(F.col("text")).alias("content_hash"),
    )


def histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("turn") * 30).cast("int"))
    status = F.when(F.col("conv_id") % 10 == 0, "rejected").when(F.col("turn") % 4 == 3, "pending").otherwise("approved")
    d = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("version_id"), F.col("conv_id").alias("node_id"), F.col("text").alias("body"), start.alias("effective_from"), status.alias("review_status"))
    return d.withColumn("effective_to", F.lead("effective_from").over(W.partitionBy("node_id").orderBy("effective_from")))


def history_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("node_id")).distinct().select("node_id", F.col("node_id").cast("string").alias("path"), (F.col("node_id") % 7 == 0).alias("is_repealed"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which each history is asked for."""
    days = F.explode(F.array(*[F.lit(d).cast("date") for d in ("2023-12-31", "2024-01-15", "2024-03-01", "2024-12-31")]))
    return history_nodes(spark, sf_dir).select("node_id", days.alias("day"))


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next snapshot: every tenth section is missing, every seventh amended, some are new, and some also are in another source under the same path."""
    d = table(spark, sf_dir, "documents").where("doc_id % 10 <> 0")
    d = d.withColumn("id", F.when(F.col("doc_id") % 13 == 0, F.col("doc_id") + 10_000_000).otherwise(F.col("doc_id")))
    chapter = F.regexp_extract("source", "[0-9]+", 0)
    body = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("AMENDED "), "text")).otherwise(F.col("text"))
    sources = F.when(F.col("doc_id") % 17 == 0, F.array("lang", F.concat("lang", F.lit("2")))).otherwise(F.array("lang"))
    d = d.select(F.concat(chapter, F.lit("."), "id").alias("path"), chapter.alias("chapter"), F.substring_index("text", "\n", 1).alias("heading"), body.alias("body"), text.content_hash(body).alias("content_hash"), sources.alias("sources"))
    return d.withColumn("source", F.explode("sources")).drop("sources")


def snapshot_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chapters that the snapshot covers: all but those with a 3; those with a 2 are reserved."""
    d = table(spark, sf_dir, "documents").select(F.explode(F.array("lang", F.concat("lang", F.lit("2")))).alias("source"), F.regexp_extract("source", "[0-9]+", 0).alias("chapter"))
    d = d.distinct().where(~F.col("chapter").contains("3"))
    return d.withColumns({"title": F.concat(F.lit("Title "), "chapter"), "reserved": F.col("chapter").contains("2")})


def briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that cite and quote sections: a sentence that does, and the whole document."""
    d = table(spark, sf_dir, "documents").withColumn("chapter", F.regexp_extract("source", "[0-9]+", 0))
    body = F.concat(F.lit("See chapter "), "chapter", F.lit(" and section "), "chapter", F.lit("."), "doc_id", F.lit(', "'), F.substring("text", 11, 60), F.lit('". Not over 30 days, nor section 999.'), "doc_id", F.lit(". "), "text")
    return d.select(F.col("doc_id").alias("text_id"), F.col("lang").alias("source"), body.alias("body"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("call_id"), F.col("user_id").alias("key"), F.col("ts").alias("at"))


def tier(key: F.Column) -> F.Column:
    return F.element_at(F.array(*[F.lit(t) for t in ("free", "solo", "firm", "custom")]), (key % 4 + 1).cast("int"))


def code_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A probe of codes, one sample for each document: a right section, a second one (of another chapter, but for every third document) and one without a right number."""
    part = lambda number, heading, body: F.struct(number.alias("number"), heading.alias("heading"), body.alias("body_text"), F.array(F.concat(F.lit(" [C"), "doc_id", F.lit("] ")), F.lit(" ")).alias("history_brackets"))
    d = table(spark, sf_dir, "documents")
    own = part(F.concat("doc_id", F.lit(".1A")), F.concat(F.lit(" "), "lang"), F.concat("text", F.lit(" \n\neferred to in §1.2")))
    sections = F.array(own, part(F.concat(F.col("doc_id") + F.col("doc_id") % 3, F.lit(".2")), F.col("lang"), F.col("text")), part(F.concat("doc_id", F.lit("-3")), F.col("lang"), F.col("text")))
    sample = F.struct(F.col("doc_id").cast("string").alias("chapter"), F.concat(F.lit(" Title "), "lang").alias("chapter_title"), sections.alias("sections"))
    made = d.select(F.to_json(F.struct(F.lit("2026").alias("code_year"), F.array(sample).alias("samples"))).alias("value"))
    return made.select(F.from_json("value", probe_files.CODE_SCHEMA).alias("p")).select("p.*")


def rules_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A probe of rules, one sample for each document: a rule with a comment and a long heading, a reserved one, and one of another chapter."""
    d = table(spark, sf_dir, "documents")
    rule = lambda number, heading, comment, reserved: F.struct(number.alias("number"), heading.alias("heading"), F.col("lang").alias("division"), F.col("text").alias("body_text"), comment.alias("comment_text"), reserved.alias("reserved"))
    long = F.concat(F.rpad(F.lit("Head "), 300, "x"), F.lit(" Form 1 "), F.rpad(F.col("lang"), 300, "y"))
    rules = F.array(
        rule(F.concat("doc_id", F.lit(":1.2.")), long, F.col("lang"), F.lit(False)),
        rule(F.concat("doc_id", F.lit(":1.3")), F.col("lang"), F.lit(""), F.lit(True)),
        rule(F.concat(F.col("doc_id") + 1, F.lit(".4")), F.col("lang"), F.lit(""), F.lit(False)),
    )
    sample = F.struct(F.col("doc_id").cast("string").alias("chapter"), F.col("lang").alias("chapter_title"), (F.col("doc_id") % 5 == 0).alias("reserved"), rules.alias("rules"))
    made = d.select(F.to_json(F.struct(F.lit("2026-04-01").alias("edition_date"), F.array(sample).alias("samples"))).alias("value"))
    return made.select(F.from_json("value", probe_files.RULES_SCHEMA).alias("p")).select("p.*")


def rich_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters as the text of rich-text files: a head, and two sections, one with the document and its notes."""
    one = F.regexp_replace(F.regexp_replace("text", r"[\[\]§]", ""), r"\s+", " ")
    body = F.concat(F.lit("CHAPTER "), "doc_id", F.lit("\n"), F.upper("lang"), F.lit(" LAW "), F.col("doc_id") % 7, F.lit("\n"), "doc_id", F.lit(".1 Theft defined.\n"), one, F.lit("\n[C51, §1]\nReferred to in §714.2, 714.3\n\n\nEnd.\n"), "doc_id", F.lit(".2 Degrees.\nText."))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), body.alias("text"))


def rule_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule book for each document: contents, then bodies with its text in small letters, a comment and a history note over two lines.

    By the id, up to two further rules (3.1, 3.2) about the language, under a
    division of their own or not, and up to three page headers.
    """
    prose = F.btrim(F.regexp_replace(F.lower("text"), r"[^a-z]+", " "))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chapter"), prose.alias("prose"), F.coalesce("lang", F.lit("")).alias("lang"), (F.col("doc_id") % 3).cast("int").alias("further"), (F.col("doc_id") % 4).cast("int").alias("headers"), (F.col("doc_id") % 2 == 1).alias("odd"))
    rule = lambda n, *rest: F.concat(F.lit("Rule "), "chapter", F.lit(f":{n} "), *[F.lit(r) if isinstance(r, str) else r for r in rest])
    chapter = F.concat(F.lit("CHAPTER "), "chapter")
    lang = F.col("lang")
    headers = F.slice(F.array(*[F.concat(F.lit("April 2026 RULES Ch "), "chapter", F.lit(f", p.{n}")) for n in (1, 2, 3)]), F.lit(1), F.col("headers"))
    division = F.when(F.col("odd") & (F.col("further") > 0), F.array(F.lit("DIVISION III"))).otherwise(F.array().cast("array<string>"))
    listed = F.slice(F.array(*[rule(f"3.{n}", f"Extra {n} ", lang) for n in (1, 2)]), F.lit(1), F.col("further"))
    told = F.slice(F.array(*[x for n in (1, 2) for x in (rule(f"3.{n}", f"EXTRA {n}"), F.concat(F.lit(f"it says {n} in "), lang, F.lit(".")))]), F.lit(1), 2 * F.col("further"))
    contents = [chapter, F.lit("RULES OF CONDUCT"), F.lit("DIVISION I"), F.lit("GENERAL"), rule("1.0", "Terms and"), F.lit("how they are used"), rule("1.1", "Competence"), F.concat(F.lit("Rules "), "chapter", F.lit(":1.2 to 1.4 Reserved")), F.lit("DIVISION II"), rule("2.1", "Advisor")]
    bodies = [
        F.lit(" "), F.lit("DIVISION I"), F.lit("GENERAL"), rule("1.0", "TERMS AND HOW"), F.lit("THEY ARE USED"), F.lit("a term is a word."), F.lit("[Court Order April 20, 2005;"), F.lit("September 1, 2010]"), rule("1.1.", "Competence. A lawyer shall be competent."),
        F.concat(F.lit("text "), "prose"), F.lit("Comment"), F.lit("[1] First reason"), F.lit("goes on."), F.lit("[2] Second reason."), rule("2.1", "ADVISOR"), F.lit("a lawyer advises."),
    ]
    return d.select("chapter", F.posexplode(F.concat(F.array(*contents), division, listed, headers, F.array(*bodies), told)).alias("line_no", "line"))


#: Lines on a page of :func:`as_pdf`.
PAGE_ROWS = 50
_UNBROKEN = re.compile("[^ \t-\r]+")


def as_pdf(rows: list[str], spaced: bool) -> bytes:
    """A PDF file of lines: 50 on a page, words parted by blanks or by gaps alone, and each fifth word drawn in two parts.

    Codes are the places of a character among those of the file; a map says
    which they are.
    """
    signs = sorted({" "}.union(*rows))
    code = {c: b"%04x" % i for i, c in enumerate(signs, 1)}
    number = np.zeros(ord(signs[-1]) + 1, ">u2")
    number[[ord(c) for c in signs]] = np.arange(1, len(signs) + 1)
    digits, ends = number[np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), np.uint32)].tobytes().hex(), [0, *accumulate(4 * len(row) for row in rows)]
    parts: list[bytes] = []
    for at in range(0, max(1, len(rows)), PAGE_ROWS):
        shown = []
        for i, row in enumerate(rows[at : at + PAGE_ROWS]):
            begin = ends[at + i]
            words = [digits[begin + 4 * m.start() : begin + 4 * m.end()] for m in _UNBROKEN.finditer(row)] if not spaced else [digits[begin : ends[at + i + 1]]]
            for n in range(4, len(words), 5):
                words[n] = f"{words[n][:8]}> -90 <{words[n][8:]}" if len(words[n]) > 12 else words[n]
            shown.append(b"1 0 0 1 50 %d Tm [<%s>] TJ" % (780 - 14 * i, "> -400 <".join(words).encode()))
        parts.append(zlib.compress(b"BT /F1 10 Tf\n" + b"\n".join(shown) + b"\nET"))
    pairs = [b"<%s> <%s>" % (code[c], c.encode("utf-16-be", "surrogatepass").hex().encode()) for c in signs]
    mapped = b"\n".join(b"%d beginbfchar\n%s\nendbfchar" % (len(pairs[i : i + 100]), b"\n".join(pairs[i : i + 100])) for i in range(0, len(pairs), 100))
    stream = lambda data, keys=b"": b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), keys, data)
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        b"<< /Type /Pages /Count %d /Kids [%s] /Resources << /Font << /F1 3 0 R >> >> >>" % (len(parts), b" ".join(b"%d 0 R" % (6 + 2 * i) for i in range(len(parts)))),
        b"<< /Type /Font /Subtype /Type0 /BaseFont /Plain /Encoding /Identity-H /DescendantFonts [4 0 R] /ToUnicode 5 0 R >>",
        b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Plain /DW 500 >>",
        stream(mapped),
    ]
    for i, part in enumerate(parts):
        objects += [b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents %d 0 R >>" % (7 + 2 * i), stream(part, b"/Filter /FlateDecode")]
    out, places = bytearray(b"%PDF-1.7\n"), []
    for n, o in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, o)
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out) + b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF" % (len(objects) + 1, table, len(objects) + 1, len(out))


def pdf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a PDF file, a line of the text on a line: ``path`` (its id), ``content``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            made = (as_pdf((t or "").split("\n"), i % 2 == 0) for i, t in zip(ids, b.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(map(str, ids), pa.string()), pa.array(made, pa.binary())], ["path", "content"])

    return table(spark, sf_dir, "documents").select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "text").mapInArrow(run, "path string, content binary")
