"""The queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embedding_dedup, fingerprints, jaccard_join, line_dedup, packing, pii, prefix_trie, quality_classifier, quality_rules, structure_repair, token_store, toxicity
from .common import read_table, scratch_dir


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_repeated_lines(read_table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = scratch_dir(spark, "token-store")
    token_store.write_store(read_table(spark, sf_dir, "documents"), store, tokenizer_file("byte_bpe_50k.json"), end_id=2)
    return token_store.read_digests(spark, store).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_private(read_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=0, size=2048)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_documents(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(read_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_groups(read_table(spark, sf_dir, "documents"), size=5, percent=80)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality_classifier.score_documents(docs, quality_classifier.train(docs, read_table(spark, sf_dir, "labels")), threshold=0.7)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints.fingerprint_edits(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure_repair.repair(structure_repair.damaged(read_table(spark, sf_dir, "conversations")))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"), least=0.95)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(read_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_token_store": op2_token_store,
    "op3_pii": op3_pii,
    "op4_packing": op4_packing,
    "op5_quality_rules": op5_quality_rules,
    "op6_bpe": op6_bpe,
    "op7_toxicity": op7_toxicity,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_fingerprints": op10_fingerprints,
    "op11_structure_repair": op11_structure_repair,
    "op12_embedding_dedup": op12_embedding_dedup,
    "op13_prefix_trie": op13_prefix_trie,
}


def _crc32(text: str) -> str:
    """SQL for the unsigned crc32 of an ASCII string: each byte is added to the remainder, then eight bits of that are shifted out."""
    steps = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: [ord(({text})[i]), -1, -1, -1, -1, -1, -1, -1, -1]))"
    shift = "xor(c >> 1, 3988292384 * (c & 1))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {steps}), lambda c, e: CASE WHEN e < 0 THEN {shift} ELSE xor(c, e) END), 4294967295::BIGINT)"


def _repair_sql() -> str:
    """The repair as a recursion from each conversation's last turn to its first; v<state> holds (cost, letters, turns) of the cheapest way on."""
    nl = "chr(10)"
    put = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
    lead = {0: "CASE r.i WHEN 's' THEN r.v1 WHEN 'u' THEN r.v2 END", 1: "CASE r.i WHEN 'u' THEN r.v2 END", 2: "CASE r.i WHEN 'a' THEN r.v3 END", 3: "CASE r.i WHEN 'u' THEN r.v2 END"}

    def way(rest: str, cost: str, letter: str, turn: str) -> str:
        turns = f"list_concat([{turn}], ({rest}).t)" if turn else f"({rest}).t"
        return f"{{'c': ({rest}).c + {cost}, 'a': '{letter}' || ({rest}).a, 't': {turns}}}"

    def own(s: int) -> str:
        to, role = put[s]
        extra = "3 * r.truncated"
        keep = f"CASE WHEN r.must = 0 AND ({lead[s]}).c IS NOT NULL THEN {way(f'({lead[s]})', extra, 'K', 'r.role || chr(58) || r.text')} END"
        rename = f"CASE WHEN r.must = 0 THEN {way(f'r.v{to}', f'3 + {extra}', 'R', f"'{role}:' || r.text")} END"
        return f"list_min(list_filter([{way(f'r.v{s}', '4', 'D', '')}, {keep}, {rename}], lambda w: w IS NOT NULL)) AS b{s}"

    insert = {0: "b2", 1: "b2", 2: "b3", 3: "b2"}
    twice = {0: "b3", 1: "b3"}
    closed = []
    for s in range(4):
        ways = [f"b{s}", way(insert[s], "3", "I", f"'{put[s][1]}:'")]
        if s in twice:
            ways.append(way(f"({way(twice[s], '3', 'I', chr(39) + 'assistant:' + chr(39))})", "3", "I", "'user:'"))
        closed.append(f"list_min([{', '.join(ways)}]) AS v{s}")
    none = "[]::VARCHAR[]"
    end = f"{{'c': 0::BIGINT, 'a': '', 't': {none}}} AS v0, {{'c': 6::BIGINT, 'a': 'II', 't': ['user:', 'assistant:']}} AS v1, {{'c': 3::BIGINT, 'a': 'I', 't': ['assistant:']}} AS v2, {{'c': 0::BIGINT, 'a': '', 't': {none}}} AS v3"
    solid = r"'[^\x20\x09-\x0D]'"
    blanks = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
    return f"""
WITH RECURSIVE fated AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS fate
  FROM conversations),
harmed AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy
  FROM fated WHERE fate <> 0),
placed AS (
  SELECT *, row_number() OVER o AS k, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, left(role, 1) AS i, lag(left(role, 1)) OVER o AS prior
  FROM harmed WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
judged AS (
  SELECT *, (NOT regexp_matches(text, {solid}))::INT AS blank, (regexp_matches(text, {solid}) AND nth > 1)::INT AS dup,
         (regexp_matches(text, {solid}) AND nth = 1 AND right(rtrim(text, {blanks}), 1) NOT IN ('.', '!', '?'))::INT AS truncated
  FROM placed),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank)::BIGINT AS blank, sum(dup)::BIGINT AS duplicate, sum(truncated)::BIGINT AS truncated,
         count(*) FILTER (WHERE prior IS NOT NULL AND prior || i NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS n
  FROM judged GROUP BY conv_id),
solved AS (
  SELECT conv_id, n AS k, {end} FROM counted
  UNION ALL
  SELECT conv_id, k - 1, {', '.join(closed)} FROM (
    SELECT r.conv_id, r.k, {', '.join(own(s) for s in range(4))}
    FROM (SELECT s.*, j.role, j.text, j.i, j.blank + j.dup AS must, j.truncated FROM solved s JOIN judged j ON j.conv_id IS NOT DISTINCT FROM s.conv_id AND j.k = s.k) r) x)
SELECT c.conv_id, coalesce(n.gaps, 0) AS gaps, coalesce(n.blank, 0) AS blank, coalesce(n.duplicate, 0) AS duplicate, coalesce(n.truncated, 0) AS truncated, coalesce(n.illegal, 0) AS illegal,
       coalesce(s.v0.c, 0) AS cost, coalesce(s.v0.a, '') AS audit, sha256(coalesce(array_to_string(s.v0.t, {nl}), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN counted n ON n.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN solved s ON s.conv_id IS NOT DISTINCT FROM c.conv_id AND s.k = 0
"""

_LOWER = "translate(trim(l, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op11_structure_repair": _repair_sql(),
    "op12_embedding_dedup": """
WITH RECURSIVE usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
unit AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM usable),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.vec_id <> b.vec_id AND len(a.u) = len(b.u) AND list_dot_product(a.u, b.u) >= 0.95),
reach AS (
  SELECT vec_id, vec_id AS other FROM embeddings
  UNION
  SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.other),
named AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM named
""",
    "op13_prefix_trie": f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS r
  FROM conversations WHERE conv_id IS NOT NULL),
counted AS (SELECT conv_id, count(*) AS total FROM turns GROUP BY conv_id),
convs AS (SELECT conv_id, total, {_crc32("conv_id::VARCHAR")} % 6 AS h FROM counted),
rebuilt AS (
  SELECT c.conv_id, t.r AS d, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.r <= c.h
  UNION ALL
  SELECT c.conv_id, t.r - c.h + least(c.h, coalesce(b.total, 0)), t.role, t.text
  FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.r > c.h LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 100),
paths AS (
  SELECT conv_id, d, length(text) AS chars, list([role, text]) OVER (PARTITION BY conv_id ORDER BY d) AS k FROM rebuilt
  UNION ALL
  SELECT conv_id, 0, 0, [] FROM convs),
lengths AS (SELECT conv_id, max(d) AS len FROM paths GROUP BY conv_id),
nodes AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars FROM paths GROUP BY k, d),
ends AS (SELECT k, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM paths JOIN lengths USING (conv_id) WHERE d = len GROUP BY k),
kids AS (SELECT list_slice(k, 1, d - 1) AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
below AS (
  SELECT list_slice(n.k, 1, x) AS k, sum((n.n_convs - 1) * n.chars)::BIGINT AS saved_tokens, count(*) FILTER (WHERE kids.n IS NULL) AS n_leaves
  FROM (SELECT *, unnest(range(d + 1)) AS x FROM nodes) n LEFT JOIN kids ON kids.k = n.k GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes n JOIN below ON below.k = n.k LEFT JOIN kids ON kids.k = n.k LEFT JOIN ends ON ends.k = n.k LEFT JOIN nodes p ON n.d > 0 AND p.k = list_slice(n.k, 1, n.d - 1)
""",
    "op1_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(str_split(coalesce(text, ''), chr(10))) AS l,
         unnest(range(len(str_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (SELECT doc_id, pos, l, {_LOWER} AS k FROM lines),
frequent AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT doc_id, pos, l, (k IN (SELECT k FROM frequent)) AS gone FROM keyed)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op8_jaccard_join": r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
each AS (SELECT doc_id, len(ws) AS m, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM worded),
runs AS (
  SELECT doc_id, m, i, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) AS x
  FROM each WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
flat AS (SELECT DISTINCT doc_id, hash(x) AS x FROM runs WHERE i <= m - 5 OR i = 0),
sized AS (SELECT doc_id, count(x) AS n FROM documents LEFT JOIN flat USING (doc_id) GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id <> b.doc_id
  JOIN sized p ON p.doc_id = a.doc_id JOIN sized q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n
  HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))),
reach AS (
  SELECT doc_id, doc_id AS other FROM sized
  UNION
  SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other)
SELECT sized.doc_id, n AS n_shingles, min(other) AS component_id
FROM sized JOIN reach ON reach.doc_id = sized.doc_id GROUP BY sized.doc_id, n
""",
    "op5_quality_rules": rf"""
WITH worded AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(str_split(coalesce(text, ''), chr(10)), lambda x: trim(x, chr(32)||chr(9)||chr(11)||chr(12)||chr(13)) <> '') AS ls
  FROM documents),
each AS (SELECT doc_id, len(ws) AS m, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM worded),
windows AS (
  SELECT doc_id, i, w, CASE WHEN i <= m - 8 THEN hash(w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o, lead(w, 5) OVER o, lead(w, 6) OVER o, lead(w, 7) OVER o) END AS h
  FROM each WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT doc_id, i, w, h IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, h) > 1 AS a FROM windows),
covered AS (SELECT doc_id, w, max(a) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS c FROM again),
counted AS (
  SELECT doc_id, count(*) FILTER (WHERE c) AS n_repeat_words, count(*) FILTER (WHERE w IN ({", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)})) AS n_stop,
         count(*) FILTER (WHERE ends_with(w, '!!')) AS n_shouts
  FROM covered GROUP BY doc_id),
measured AS (
  SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(ls) AS n_lines, n_stop, n_shouts
  FROM worded LEFT JOIN counted USING (doc_id)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_repeat_words / n_words <= 0.3 AND word_chars / n_words BETWEEN 2 AND 20 AND n_symbols / word_chars <= 0.1
       AND n_dup_lines / n_lines <= 0.3 AND n_stop / n_words >= 0.01 AND n_shouts / n_words <= 0.3 AS kept
FROM judged
""",
}
