"""Probe files: nested JSON of chapters and their sections or rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text

_TEXTS = "array<string>"
CODE_SCHEMA = f"code_year string, source_base_url string, samples array<struct<chapter: string, chapter_title: string, url: string, citation_pdf_url: string, sections: array<struct<number: string, heading: string, body_text: string, history_brackets: {_TEXTS}, acts_citations: {_TEXTS}, referred_to_in: {_TEXTS}, citation_pdf_url: string, citation_html_url: string, source_rtf_url: string>>>>"
RULES_SCHEMA = f"edition_date string, source_base_url string, samples array<struct<chapter: string, chapter_title: string, reserved: boolean, chapter_pdf_url: string, page_count: int, rule_count: int, parse_notes: {_TEXTS}, rules: array<struct<number: string, heading: string, division: string, body_text: string, comment_text: string, history_brackets: {_TEXTS}, reserved: boolean>>>>"
# The shapes of chapter, section and rule numbers, and the longest heading.
CODE_CHAPTER, CODE_NUMBER = r"\A\d+[A-Z]?\z", r"\A(\d+[A-Z]?)\.([\w.()-]+)\z"
RULES_CHAPTER, RULES_NUMBER = r"\A\d+\z", r"\A(\d+)[:.]([\w.:()-]+)\z"
LONGEST_HEADING = 500


def read_probe(spark: SparkSession, path: str, rules: bool = False) -> DataFrame:
    return spark.read.schema(RULES_SCHEMA if rules else CODE_SCHEMA).json(path, multiLine=True)


def required(c: Column, name: str) -> Column:
    """Trimmed text; a missing or blank value stops the job."""
    t = text.strip(c)
    return F.when(F.coalesce(t, F.lit("")) == "", F.raise_error(F.lit(f"missing or empty {name}"))).otherwise(t)


def filled(c: Column) -> Column:
    """Trimmed texts that aren't blank; null is none."""
    return F.filter(F.transform(F.coalesce(c, F.array().cast(_TEXTS)), text.strip), lambda s: s != "")


def _chapters(probe: DataFrame, *more: str) -> DataFrame:
    one = probe.select(*[c for c in ("code_year", "edition_date") if c in probe.columns], F.posexplode("samples").alias("chapter_no", "s"))
    return one.withColumn("chapter", required(F.col("s.chapter"), "chapter"))


def split_heading(heading: Column) -> tuple[Column, Column]:
    """A heading over the limit is cut before the first "Form" mark, else at the limit; the second is what moves to the body."""
    at = F.regexp_instr(heading, F.lit(r"\bForm (?:1|A|I)\b"))
    long = F.length(heading) > LONGEST_HEADING
    formed = long & (at > 1) & (at <= LONGEST_HEADING + 1)
    return (
        F.when(formed, text.strip(F.substring(heading, F.lit(1), at - 1))).when(long, text.rstrip(F.substring(heading, 1, LONGEST_HEADING))).otherwise(heading),
        F.when(formed, F.substring(heading, at, F.length(heading))).otherwise(F.lit("")),
    )


def parse_code(probe: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chapters, sections and skipped sections.

    A wrong year or chapter number, and a missing heading, stop the job; a
    section whose number has no right shape, or another chapter's prefix, is skipped.
    """
    year = F.when(F.col("code_year").rlike(r"\A[0-9]+\z"), F.col("code_year").cast("int")).otherwise(F.raise_error(F.concat(F.lit("code_year must be a number, not "), F.coalesce("code_year", F.lit("null")))))
    c = _chapters(probe).withColumn("year", year)
    c = c.withColumn("chapter", F.when(F.col("chapter").rlike(CODE_CHAPTER), F.col("chapter")).otherwise(F.raise_error(F.concat(F.lit("unexpected chapter number "), F.col("chapter")))))
    chapters = c.select("chapter_no", "chapter", text.strip(F.coalesce("s.chapter_title", F.lit(""))).alias("title"), "year", F.col("s.citation_pdf_url").alias("pdf_url"))
    s = c.select("chapter_no", "chapter", F.posexplode("s.sections").alias("section_no", "x")).withColumn("number", required(F.col("x.number"), "number"))
    prefix = F.regexp_extract("number", CODE_NUMBER, 1)
    reason = F.when(prefix == "", "number has no right shape").when(prefix != F.col("chapter"), "number belongs to another chapter")
    s = s.withColumn("reason", reason).withColumn("heading", text.strip(F.coalesce("x.heading", F.lit(""))))
    skipped = s.where("reason is not null").select("chapter", "number", "reason", "heading")
    heading = F.when(F.col("heading") == "", F.raise_error(F.concat(F.lit("section "), F.col("number"), F.lit(" has no heading")))).otherwise(F.col("heading"))
    body = text.normalized_body(F.coalesce("x.body_text", F.lit("")))
    sections = s.where("reason is null").select(
        "chapter_no", "section_no", "chapter", F.col("number").alias("path"), text.ordinal_of(F.col("number")).alias("ordinal"), heading.alias("heading"), body.alias("body"), text.content_hash(body).alias("content_hash"),
        *[filled(F.col(f"x.{c}")).alias(c) for c in ("history_brackets", "acts_citations", "referred_to_in")],
    )
    return chapters, sections, skipped


def parse_rules(probe: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As :func:`parse_code` for rules: an ISO edition date, both separators, reserved placeholders skipped."""
    day = F.col("edition_date").try_cast("date")
    c = _chapters(probe).withColumn("edition", F.when(day.isNotNull(), day).otherwise(F.raise_error(F.lit("edition_date must be an ISO date"))))
    c = c.withColumn("chapter", F.when(F.col("chapter").rlike(RULES_CHAPTER), F.col("chapter")).otherwise(F.raise_error(F.concat(F.lit("unexpected chapter number "), F.col("chapter")))))
    r = c.select("chapter_no", "chapter", F.posexplode("s.rules").alias("section_no", "x")).withColumn("number", text.trimmed_number(required(F.col("x.number"), "number")))
    prefix = F.regexp_extract("number", RULES_NUMBER, 1)
    reason = F.when(F.coalesce("x.reserved", F.lit(False)), "reserved").when(prefix == "", "number has no right shape").when(prefix != F.col("chapter"), "number belongs to another chapter")
    r = r.withColumn("reason", reason).withColumn("raw_heading", text.strip(F.coalesce("x.heading", F.lit(""))))
    skipped = r.where("reason is not null").select("chapter", "number", "reason", F.col("raw_heading").alias("heading"))
    heading, moved = split_heading(F.col("raw_heading"))
    prose = text.normalized_body(F.concat_ws("\n\n", F.nullif(moved, F.lit("")), F.coalesce("x.body_text", F.lit(""))), drop_note=False)
    body = text.combined_text(prose, text.normalized_body(F.coalesce("x.comment_text", F.lit("")), drop_note=False))
    rules = r.where("reason is null").select(
        "chapter_no", "section_no", "chapter", F.col("number").alias("path"), text.ordinal_of(F.col("number"), True).alias("ordinal"), heading.alias("heading"), F.coalesce("x.division", F.lit("")).alias("division"), body.alias("body"), text.content_hash(body).alias("content_hash"), filled(F.col("x.history_brackets")).alias("history_brackets"),
    )
    n = rules.groupBy("chapter").agg(F.count(F.lit(1)).alias("n_rules"))
    chapters = c.select("chapter_no", "chapter", text.strip(F.coalesce("s.chapter_title", F.lit(""))).alias("title"), F.coalesce("s.reserved", F.lit(False)).alias("reserved"), "edition").join(n, "chapter", "left").fillna(0, ["n_rules"])
    return chapters, rules, skipped


def to_probe(sections: DataFrame, chapters: DataFrame, year: int) -> DataFrame:
    """The JSON form of a snapshot, one row for each chapter's sample; ``write.text`` makes the file."""
    own = sections.groupBy("chapter").agg(F.array_sort(F.collect_list(F.struct("section_no", F.col("path").alias("number"), "heading", F.col("body").alias("body_text")))).alias("s"))
    body = F.transform(F.coalesce("s", F.array().cast("array<struct<section_no: int, number: string, heading: string, body_text: string>>")), lambda x: x.dropFields("section_no"))
    d = chapters.join(own, "chapter", "left").select(F.lit(str(year)).alias("code_year"), F.array(F.struct("chapter", F.col("title").alias("chapter_title"), body.alias("sections"))).alias("samples"))
    return d.select(F.to_json(F.struct("*")).alias("value"))


def to_rules_probe(rules: DataFrame, notes: DataFrame, edition: str) -> DataFrame:
    """The JSON form of a rule book (rules and notes of :func:`rules_text.parse`), one row for each chapter."""
    rule = F.struct("n", F.col("rule").alias("number"), "heading", "division", F.col("prose").alias("body_text"), F.col("comment").alias("comment_text"), F.col("history").alias("history_brackets"))
    own = rules.groupBy("chapter").agg(F.array_sort(F.collect_list(rule)).alias("r"), F.count(F.lit(1)).cast("int").alias("rule_count"))
    said = notes.groupBy("chapter").agg(F.array_sort(F.collect_list(F.concat_ws(" ", "rule", "note"))).alias("parse_notes"))
    d = own.join(said, "chapter", "full_outer")
    sample = F.struct("chapter", F.lit(False).alias("reserved"), F.coalesce("rule_count", F.lit(0)).alias("rule_count"), F.coalesce("parse_notes", F.array().cast(_TEXTS)).alias("parse_notes"), F.transform("r", lambda x: x.dropFields("n")).alias("rules"))
    return d.select(F.to_json(F.struct(F.lit(edition).alias("edition_date"), F.array(sample).alias("samples"))).alias("value"))
