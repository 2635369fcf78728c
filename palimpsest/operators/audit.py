"""Audit of free text: are its citations good, its quotations true, its law fresh?"""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import citations as grammar
from palimpsest.functions import text
from palimpsest.operators import links
from palimpsest.operators.joins import left_known
from palimpsest.operators.temporal import current_versions, visible
from palimpsest.sources.scratch import stored

# What counts as a quotation, how far its citation may be, when a quotation is nearly right, where passages end, and how much of one is shown.
QUOTE = re.compile(r'[“"]([^”"]{6,}?)[”"]')
WINDOW, FUZZY = 400, 0.85
MOST_CHARS = 250_000
PASSAGE_END, SHOWN = r"(?U)(?<=[.\n])\s+", 300
TERM = r"""(?iU)(["“‘’'][^"”‘’']{1,60}["”‘’']|[A-Za-z][A-Za-z0-9\-\s]{0,60}?)\s+(?:means|shall\s+mean|is\s+defined\s+as)\s+([^.]{1,400}\.)"""


def validate_citations(texts: DataFrame, nodes: DataFrame, versions: DataFrame, key: str = "text_id", body: str = "body", include_pending: bool = False) -> DataFrame:
    """``key``, ``pos``, ``start``, ``end``, ``raw``, ``path``, ``status``, ``node_id``, ``candidates`` of each citation in the texts (which have a ``source``).

    *valid*; *repealed* (flagged, or a section without a visible text);
    *not_found*, with the first paths of its chapter; *parse_error*.
    """
    # Whole texts are read once; what cites in them is used several times.
    cited = stored(links.scan(texts, key, body, carry=["source"]), "citations").withColumn("citation", F.struct("path", "chapter", "chapter_only"))
    live = current_versions(versions, include_pending).select("node_id", F.lit(True).alias("_text"))
    r = left_known(links.resolve(cited, nodes), live, "node_id")
    gone = F.col("is_repealed") | (~F.col("chapter_only") & F.col("_text").isNull())
    status = F.when(F.col("path").isNull(), "parse_error").when(F.col("node_id").isNull(), "not_found").when(gone, "repealed").otherwise("valid")
    r = r.withColumn("status", status)
    missed = r.where("status = 'not_found'").select("source", "citation").distinct().withColumn("_key", F.struct("source", "citation.chapter"))
    near = links.candidates(missed.dropDuplicates(["_key"]), nodes, "_key").select(F.col("_key.source").alias("_s"), F.col("_key.chapter").alias("_c"), "candidates")
    out = r.join(near, (F.col("source") == F.col("_s")) & (F.col("chapter") == F.col("_c")) & (F.col("status") == "not_found"), "left")
    return out.select(key, "pos", "start", "end", "raw", "path", "chapter_only", "status", "node_id", F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates"))


def citation_report(checked: DataFrame, key: str = "text_id") -> DataFrame:
    return checked.groupBy(key).agg(*_citation_counts())


def _citation_counts() -> list[Column]:
    states = ("valid", "repealed", "not_found", "parse_error")
    return [F.count(F.lit(1)).alias("n_citations"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in states]]


def likeliest(want: str, passages: Sequence[str]) -> tuple[float, int]:
    """(ratio, place) of the passage most like ``want``, the first of equal ones; (0, -1) if none has a ratio over 0.

    The one that shares the most runs of three characters is compared first, then the
    others in order of what their lengths allow, so that most need no comparison.
    """
    if not passages:
        return 0.0, -1
    match = difflib.SequenceMatcher(None, "", want, autojunk=False)
    letters, runs = list(Counter(want).items()), {want[k : k + 3] for k in range(len(want) - 2)}
    shared = [sum(g in p for g in runs) for p in passages]
    first = shared.index(max(shared))
    bounds = sorted((-2 * min(len(p), len(want)) / max(1, len(p) + len(want)), i) for i, p in enumerate(passages) if i != first)
    best, at = 0.0, -1
    for bound, i in [(-1.0, first), *bounds]:
        if -bound < best:
            break
        p = passages[i]
        # What the letters allow, as quick_ratio has it.
        if i != first and 2.0 * sum(min(n, p.count(c)) for c, n in letters) / max(1, len(p) + len(want)) < best:
            continue
        match.set_seq1(p)
        ratio = match.ratio()
        if ratio > best or (ratio == best and i < at):
            best, at = ratio, i
    return best, at


#: Quotations of one section from which on its runs of three characters are kept.
INDEXED_FROM = 8


class Passages:
    """The passages of one section, for any number of quotations.

    A passage with a ratio of ``FUZZY`` to a quotation, T characters both
    together, matches it in M >= FUZZY * T / 2 characters, in no more than
    T - 2 M + 1 runs; each run of n characters holds n - 2 common runs of three.
    So the two share at least (5 * FUZZY / 2 - 2) * T - 2 of those, counted with
    repeats.  Passages that do are compared first; one that reaches ``FUZZY``
    is better than all others.
    """

    def __init__(self, folded: Sequence[str]):
        self.folded, self._held, self._asked = list(folded), None, 0

    def _shared(self, want: str) -> list[int]:
        if self._held is None:
            self._held = {}
            for i, p in enumerate(self.folded):
                for g, n in Counter(p[k : k + 3] for k in range(len(p) - 2)).items():
                    self._held.setdefault(g, []).append((i, n))
        shared = [0] * len(self.folded)
        for g, n in Counter(want[k : k + 3] for k in range(len(want) - 2)).items():
            for i, m in self._held.get(g, ()):
                shared[i] += min(n, m)
        return shared

    def likeliest(self, want: str) -> tuple[float, int]:
        """As :func:`likeliest` of all passages."""
        self._asked += 1
        if self._asked < INDEXED_FROM:
            return likeliest(want, self.folded)
        near = [i for i, n in enumerate(self._shared(want)) if n >= (2.5 * FUZZY - 2) * (len(want) + len(self.folded[i])) - 2 - 1e-9]
        score, at = likeliest(want, [self.folded[i] for i in near])
        return (score, near[at]) if score >= FUZZY else likeliest(want, self.folded)


def _excerpt(body: str, low: str, quote: str, low_quote: str, context: int = 100) -> str:
    """As :func:`text.excerpt_around`, of a text and a quotation that are there in small letters too."""
    at = low.find(low_quote)
    if at < 0:
        return quote
    start, end = max(0, at - context), min(len(body), at + len(quote) + context)
    return ("…" if start else "") + body[start:end] + ("…" if end < len(body) else "")


#: Quotations of one section that are compared in one group, and of several.
GROUP_QUOTES, BUCKET_QUOTES = 2_000, 64


def compared(quotes: DataFrame, sections: DataFrame) -> DataFrame:
    """Adds ``status``, ``score``, ``passage`` to quotations (``quote``, ``node_id``, not null) of sections (``node_id``, ``body``).

    *exact*, *fuzzy*, *not_found*, or *section_unresolved* without a section.
    Both meet by buckets of sections: a text moves once for every ``GROUP_QUOTES``
    of its quotations, and is cut into passages once.  A bucket holds some
    ``BUCKET_QUOTES`` quotations, or all those of a load of one section.
    """
    folded = lambda c: F.lower(text.collapse_space(c))
    buckets = max(1, -(-quotes.count() // BUCKET_QUOTES))
    bucket = lambda c: F.expr(f"pmod(xxhash64({c}), {buckets}L)")
    quoted = quotes.groupBy("node_id").agg(F.ceil(F.count(F.lit(1)) / GROUP_QUOTES).cast("int").alias("_loads"))
    q = quotes.join(quoted, "node_id").withColumns({"_load": F.expr("cast(pmod(xxhash64(quote, start), _loads) as int)"), "_low": F.lower("quote"), "_folded": folded(F.col("quote")), "_bucket": bucket("node_id")}).drop("_loads")
    passages = F.filter(F.transform(F.split("body", PASSAGE_END), text.strip), lambda p: p != "")
    s = sections.join(quoted.withColumnRenamed("node_id", "_node").withColumnRenamed("_loads", "_n"), F.col("node_id") == F.col("_node"))
    s = s.select(F.col("node_id").alias("_node"), F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_part"), "body", F.lower("body").alias("low"), folded(F.col("body")).alias("folded"), passages.alias("passages"))
    s = s.withColumns({"folded_passages": F.transform("passages", folded), "_group": bucket("_node")})
    kept = quotes.columns
    fields = ", ".join(f"`{c}` {t}" for c, t in quotes.dtypes) + ", status string, score double, passage string"

    def run(q: pa.Table, s: pa.Table) -> pa.Table:
        place = {node: i for i, node in enumerate(s["_node"].to_pylist())}
        # One section at a time, so that one is held in full.
        own: dict[int, list[int]] = {}
        for i, node in enumerate(q["node_id"].to_pylist()):
            own.setdefault(node, []).append(i)
        texts, out = [q[c].to_pylist() for c in ("quote", "_low", "_folded")], [None] * q.num_rows
        for node, rows in own.items():
            held = s.slice(place[node], 1).to_pylist()[0] if node in place else None
            known = Passages(held["folded_passages"]) if held else None
            for i in rows:
                quote, low, folded = (t[i] for t in texts)
                if held is None:
                    out[i] = ("section_unresolved", 0.0, "")
                elif folded in held["folded"]:
                    out[i] = ("exact", 1.0, _excerpt(held["body"], held["low"], quote, low))
                else:
                    score, at = known.likeliest(folded)
                    found = held["passages"][at] if at >= 0 else ""
                    out[i] = ("fuzzy" if score >= FUZZY else "not_found", score, found[:SHOWN] + ("…" if len(found) > SHOWN else ""))
        made = [pa.array([r[k] for r in out], t) for k, t in ((0, pa.string()), (1, pa.float64()), (2, pa.string()))]
        return pa.Table.from_arrays([*(q[c] for c in kept), *made], [*kept, "status", "score", "passage"])

    return q.groupBy("_bucket", "_load").cogroup(s.groupBy("_group", "_part")).applyInArrow(run, fields).where("quote is not null")


def quotes_of(texts: DataFrame, key: str = "text_id", body: str = "body", carry: Sequence[str] = ()) -> DataFrame:
    """``key``, ``carry``, ``quote_no``, ``quote``, ``start``, ``end``, and the citations within reach: ``near`` (distance, order, path)."""
    own = [key, *carry]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for *known, b in pdf[[*own, body]].itertuples(index=False):
                for no, m in enumerate(QUOTE.finditer(b or "")):
                    quote, (a, z) = m[1].strip(), m.span(1)
                    low = max(0, a - WINDOW)
                    near = [{"distance": max(a - low - e, s + low - z, 0), "nth": i, "raw": raw} for i, (s, e, raw) in enumerate(links.free_spans(b[low : z + WINDOW]))]
                    if quote:
                        rows.append((*known, no, quote, a, z, near))
            yield pd.DataFrame(rows, columns=[*own, "quote_no", "quote", "start", "end", "near"])

    kinds = dict(texts.dtypes)
    found = texts.select(*own, body).mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in own) + ", quote_no int, quote string, start int, end int, near array<struct<distance: int, nth: int, raw: string>>")
    read = F.transform("near", lambda x: F.struct(x["distance"].alias("distance"), x["nth"].alias("nth"), grammar.parse(x["raw"])["path"].alias("path")))
    return found.withColumn("near", F.filter(read, lambda x: x["path"].isNotNull()))


def verify_quotes(texts: DataFrame, nodes: DataFrame, versions: DataFrame, key: str = "text_id", body: str = "body", citation: Column | None = None, include_pending: bool = False) -> DataFrame:
    """``key``, ``quote_no``, ``quote``, ``start``, ``end``, ``path``, ``node_id``, ``status``, ``score``, ``passage``.

    Each quotation goes with the nearest citation that resolves, else the
    nearest; ``citation`` overrides this where it parses.  *exact*, *fuzzy* or
    *not_found* in the node's current text; *section_unresolved*; *no_citation*.
    """
    given_texts = texts if citation is None else texts.withColumn("_given", citation.cast("string"))
    q = stored(quotes_of(given_texts, key, body, ["source", *(["_given"] if citation is not None else [])]), "quotes")
    n = nodes.select(F.col("source").alias("_s"), F.col("path").alias("_p"), F.col("node_id"))
    if citation is not None:
        given = grammar.parse(F.col("_given"))["path"]
        q = q.withColumn("near", F.when(given.isNotNull(), F.array(F.struct(F.lit(0).alias("distance"), F.lit(0).alias("nth"), given.alias("path")))).otherwise(F.col("near"))).drop("_given")
    pairs = q.select(key, "quote_no", "source", F.explode("near").alias("c")).join(n, (F.col("source") == F.col("_s")) & (F.col("c.path") == F.col("_p")), "left")
    best = pairs.withColumn("_rank", F.row_number().over(W.partitionBy(key, "quote_no").orderBy(F.col("node_id").isNull(), "c.distance", "c.nth"))).where("_rank = 1").select(key, "quote_no", F.col("c.path").alias("path"), "node_id")
    now = current_versions(versions, include_pending).select("node_id", F.col("body").alias("_body"))
    r = stored(q.drop("near", "source").join(best, [key, "quote_no"], "left"), "quotes")
    out = [key, "quote_no", "quote", "start", "end", "path", "node_id"]
    unknown = r.where("node_id is null").select(*out, F.when(F.col("path").isNull(), "no_citation").otherwise("section_unresolved").alias("status"), F.lit(0.0).alias("score"), F.lit("").alias("passage"))
    return unknown.unionByName(compared(r.where("node_id is not null").select(*out), now.withColumnRenamed("_body", "body")))


def audit(texts: DataFrame, nodes: DataFrame, versions: DataFrame, since: Column, key: str = "text_id", body: str = "body") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Citations, quotations, and the open versions of cited nodes that start on or after ``since``."""
    cites = validate_citations(texts, nodes, versions, key, body)
    quotes = verify_quotes(texts, nodes, versions, key, body)
    cited = cites.where("node_id is not null").select(key, "node_id").distinct()
    fresh = versions.where(F.col("effective_to").isNull() & visible() & (F.col("effective_from") >= since))
    return cites, quotes, cited.join(fresh.select("node_id", "version_id", "effective_from"), "node_id")


def audit_report(cites: DataFrame, quotes: DataFrame, fresh: DataFrame, key: str = "text_id") -> DataFrame:
    """One row for each text: counts, and the problems as Markdown rows in order."""
    # Both are read once; a row is never empty.
    rows = lambda order, wrong, *cells: F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(wrong, F.struct(order, text.markdown_row(*cells).alias("row"))))), lambda x: x["row"]), "\n"), F.lit(""))
    cited = cites.groupBy(key).agg(*_citation_counts(), rows("pos", F.col("status") != "valid", F.col("raw"), F.col("status")).alias("citation_rows"))
    quoted = quotes.groupBy(key).agg(F.count(F.lit(1)).alias("n_quotes"), F.count_if(F.col("status") == "exact").alias("n_exact"), rows("quote_no", F.col("status") != "exact", F.col("quote"), F.col("status"), F.round("score", 3)).alias("quote_rows"))
    n_fresh = fresh.groupBy(key).agg(F.count(F.lit(1)).alias("n_amended"))
    out = cited.join(quoted, key, "full_outer").join(n_fresh, key, "left")
    none = F.lit(text.NO_ITEMS)
    return out.withColumns({"citation_rows": F.coalesce("citation_rows", none), "quote_rows": F.coalesce("quote_rows", none)}).fillna(0)


# Heads of the tables, and how much of a quotation and of a passage they show.
CITATION_HEADS = ("Status", "As cited", "Chapter", "Section", "Heading", "Official URL", "Candidates (if missing)")
QUOTE_HEADS = ("Status", "Score", "Quoted text", "Section", "Closest passage")
AMENDED_HEADS = ("Section", "Heading", "Effective from", "Official URL")
SUMMARY_HEADS = ("Metric", "Count")
QUOTE_CHARS, PASSAGE_CHARS, MOST_CANDIDATES = 80, 100, 3


def audit_tables(texts: DataFrame, nodes: DataFrame, cites: DataFrame, quotes: DataFrame, fresh: DataFrame, since: str | None, url: Column | None = None, key: str = "text_id") -> DataFrame:
    """``key`` and four Markdown tables: ``summary``, ``citations``, ``quotes``, ``amended_since``; one row for each of ``texts``.

    ``cites``, ``quotes`` and ``fresh`` are the parts of :func:`audit`; ``url``
    is a column of ``nodes``.  Each part is grouped once, so a task holds what
    one text cites and quotes, no more.
    """
    n = nodes.select("node_id", F.col("path").alias("_path"), F.col("heading").alias("_heading"), (F.lit("") if url is None else url).alias("_url"))
    in_order = lambda order, row: F.transform(F.array_sort(F.collect_list(F.struct(order, row.alias("_row")))), lambda x: x["_row"])
    counted = lambda status: F.count_if(F.col("status") == status)

    chapter, section = text.chapter_of(F.col("path"), colon=True), F.when(~F.col("chapter_only"), F.col("path"))
    cited = text.markdown_row(F.col("status"), F.col("raw"), chapter, section, F.col("_heading"), F.col("_url"), F.array_join(F.slice("candidates", 1, MOST_CANDIDATES), ", "))
    c = left_known(cites, n, "node_id").groupBy(key).agg(in_order("pos", cited).alias("_c"), F.count(F.lit(1)).alias("_n"), counted("valid").alias("_valid"), counted("repealed").alias("_repealed"), counted("not_found").alias("_missing"))

    quoted = text.markdown_row(F.col("status"), F.format_string("%.2f", "score"), text.truncated(F.col("quote"), QUOTE_CHARS), F.col("_path"), text.truncated(F.coalesce("passage", F.lit("")), PASSAGE_CHARS))
    q = left_known(quotes, n, "node_id").groupBy(key).agg(in_order("quote_no", quoted).alias("_q"), F.count(F.lit(1)).alias("_nq"), counted("exact").alias("_exact"), counted("fuzzy").alias("_fuzzy"), counted("not_found").alias("_missed"))

    amended = text.markdown_row(F.col("_path"), F.col("_heading"), F.col("effective_from"), F.col("_url"))
    f = fresh.join(n, "node_id").groupBy(key).agg(in_order("_path", amended).alias("_f"), F.count(F.lit(1)).alias("_nf"))

    metrics = {
        "Citations — total": "_n", "Citations — valid": "_valid", "Citations — repealed": "_repealed", "Citations — missing": "_missing",
        "Quotes — total": "_nq", "Quotes — exact": "_exact", "Quotes — fuzzy": "_fuzzy", "Quotes — missed": "_missed", "Sections amended since": "_nf",
    }
    none = "_No `since` date supplied; freshness check skipped._" if since is None else f"_No cited sections amended since {since}._"
    out = texts.select(key).join(c, key, "left").join(q, key, "left").join(f, key, "left")
    return out.select(
        key,
        text.markdown_table(SUMMARY_HEADS, F.array(*[text.markdown_row(F.lit(name), F.coalesce(F.col(col), F.lit(0))) for name, col in metrics.items()])).alias("summary"),
        text.markdown_table(CITATION_HEADS, F.col("_c")).alias("citations"),
        text.markdown_table(QUOTE_HEADS, F.col("_q")).alias("quotes"),
        F.when(F.col("_nf") > 0, text.markdown_table(AMENDED_HEADS, F.col("_f"))).otherwise(none).alias("amended_since"),
    )


def citation_payloads(texts: DataFrame, nodes: DataFrame, versions: DataFrame, key: str = "text_id", body: str = "body", most_chars: int = MOST_CHARS, include_pending: bool = False) -> DataFrame:
    """One row for each text: ``key``, ``error``, ``n_citations`` and ``citations`` in order, each with an excerpt of the text it cites.

    Texts over ``most_chars`` characters are answered with an error and not
    read, and one without citations with an empty array.  Null counts as empty.
    """
    fits = F.coalesce(F.length(body), F.lit(0)) <= most_chars
    found = validate_citations(texts.where(fits), nodes, versions, key, body, include_pending)
    now = current_versions(versions, include_pending).select("node_id", text.body_excerpt(F.col("body")).alias("excerpt"))
    named = left_known(left_known(found, now, "node_id"), nodes.select("node_id", "heading"), "node_id")
    each = F.array_sort(F.collect_list(F.struct("pos", "start", "end", "raw", "path", "status", "heading", "excerpt", "candidates")))
    lists = named.groupBy(key).agg(each.alias("citations"), F.count(F.lit(1)).alias("n_citations"))
    error = F.when(~fits, F.format_string(f"text is longer than {most_chars} characters"))
    out = texts.select(key, error.alias("error")).join(lists, key, "left")
    return out.select(key, "error", F.coalesce("n_citations", F.lit(0)).alias("n_citations"), F.coalesce("citations", F.array().cast(lists.schema["citations"].dataType)).alias("citations"))


def definitions(nodes: DataFrame, versions: DataFrame, term: str, chapter: str | None = None, limit: int = 25, include_pending: bool = False) -> DataFrame:
    """``node_id``, ``path``, ``nth``, ``term``, ``definition`` of passages that define ``term``.

    The first ``4 * limit`` current texts that hold the term, in order of
    source, path and start, are read; a limit that is part of the contract.
    """
    needle = term.strip().strip('"').lower()
    if not needle:
        return versions.limit(0).select("node_id", F.lit("").alias("path"), F.lit(0).alias("nth"), F.lit("").alias("term"), F.lit("").alias("definition"))
    some = versions.where(F.col("effective_to").isNull() & visible(include_pending) & text.contains_folded(F.col("body"), F.lit(needle))).join(nodes.select("node_id", "source", "path"), "node_id")
    some = some if chapter is None else some.where(F.col("path").startswith(chapter + "."))
    some = some.orderBy("source", "path", F.desc("effective_from")).limit(4 * limit)
    both = F.arrays_zip(F.regexp_extract_all("body", F.lit(TERM), 1).alias("term"), F.regexp_extract_all("body", F.lit(TERM), 2).alias("definition"))
    hit = some.select("source", "node_id", "path", "effective_from", F.posexplode(both).alias("nth", "x"))
    hit = hit.select("source", "node_id", "path", "effective_from", "nth", text.strip(F.col("x.term")).alias("term"), text.strip(F.col("x.definition")).alias("definition")).where(F.contains(F.lower("term"), F.lit(needle)))
    return hit.orderBy("source", "path", F.desc("effective_from"), "nth").limit(limit).select("node_id", "path", "nth", "term", "definition")
