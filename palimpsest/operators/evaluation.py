"""Retrieval evaluation, traces of question turns, and usage quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Calls a day by tier (null: no limit) and what a tier may use.
QUOTAS = {"free": 200, "solo": 5_000, "firm": 50_000, "custom": None}
MONTHLY_CHATS, DAILY_CHATS = 20_000, 50


def score_rankings(rankings: DataFrame, judgements: DataFrame, loaded: DataFrame, k: int = 5) -> DataFrame:
    """``query_id``, ``n_available``, ``n_matched``, ``precision``, ``recall``, ``hit`` at ``k``.

    Expected paths that aren't loaded don't count, and queries left without one
    are skipped.  Precision is over what was returned, not over ``k``.
    """
    want = judgements.select("query_id", "path").distinct().join(loaded.select("path").distinct(), "path", "left_semi")
    got = rankings.where(F.col("rank") <= k).select("query_id", "path")
    n_got = got.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_returned"))
    matched = want.join(got.distinct(), ["query_id", "path"], "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("n_matched"))
    out = want.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_available")).join(n_got, "query_id", "left").join(matched, "query_id", "left").fillna(0)
    return out.select("query_id", "n_available", "n_matched", (F.col("n_matched") / F.greatest("n_returned", F.lit(1))).alias("precision"), (F.col("n_matched") / F.col("n_available")).alias("recall"), (F.col("n_matched") > 0).alias("hit"))


def summarise(scores: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """``tag`` (null: all queries), ``n``, ``mean_precision``, ``mean_recall``, ``n_hits``."""
    measures = [F.count(F.lit(1)).alias("n"), F.avg("precision").alias("mean_precision"), F.avg("recall").alias("mean_recall"), F.count_if(F.col("hit")).alias("n_hits")]
    whole = scores.agg(*measures).withColumn("tag", F.lit(None).cast("string")).where("n > 0")
    if tags is None:
        return whole.select("tag", "n", "mean_precision", "mean_recall", "n_hits")
    return whole.select("tag", "n", "mean_precision", "mean_recall", "n_hits").unionByName(scores.join(tags.select("query_id", "tag"), "query_id").groupBy("tag").agg(*measures))


#: A trace: the calls of one turn with what they returned.
TRACE = "array<struct<name: string, arguments: map<string,string>, result: struct<query: string, hits: array<struct<path: string, citation: string, heading: string>>, section: string, chapter: string, sections: array<string>>>>"
#: Names of the calls that search and that look up, unless others are given.
SEARCH, LOOKUP = "search", "lookup"


def answer_uses(answer: Column, hit: Column) -> Column:
    """Whether the answer repeats the hit's path, else its citation; blank ones never count."""
    held = lambda c: (F.coalesce(F.btrim(c), F.lit("")) != "") & F.contains(answer, F.btrim(c))
    return F.coalesce(held(hit["path"]) | held(hit["citation"]), F.lit(False))


def derive_trace(turns: DataFrame, search: str = SEARCH) -> DataFrame:
    """Adds to (``trace``, ``answer``) what can be told from it.

    ``top_result_used``: null if no search had hits, true if the answer uses
    the first hit of any, else false.
    """
    searches = F.filter("trace", lambda c: c["name"] == search)
    d = turns.withColumn("_s", F.coalesce(searches, F.array().cast(TRACE)))
    with_hits = F.filter("_s", lambda c: F.coalesce(F.size(c["result"]["hits"]), F.lit(0)) > 0)
    used = F.exists(with_hits, lambda c: answer_uses(F.col("answer"), F.get(c["result"]["hits"], F.lit(0))))
    return d.select(
        "*",
        F.transform("_s", lambda c: F.coalesce(F.nullif(c["arguments"]["query"], F.lit("")), c["result"]["query"], F.lit(""))).alias("search_queries"),
        F.coalesce(F.size("trace"), F.lit(0)).alias("num_tool_calls"),
        F.size("_s").alias("num_searches"),
        F.when(F.size(with_hits) > 0, used).alias("top_result_used"),
    ).drop("_s")


def question_of(messages: Column) -> Column:
    """Text of the last message of the user."""
    return F.try_element_at(F.filter(messages, lambda m: m["role"] == "user"), F.lit(-1))["text"]


def retrieved_paths(trace: Column, search: str = SEARCH, lookup: str = LOOKUP) -> Column:
    """Paths that search hits and look-ups brought, each once, in order of appearance."""
    none = F.array().cast("array<string>")

    def of(c: Column) -> Column:
        r = c["result"]
        hits = F.coalesce(F.transform(r["hits"], lambda h: h["path"]), none)
        looked = F.when(r["section"].isNotNull(), F.array(r["section"])).when(r["chapter"].isNotNull(), F.concat(F.array(r["chapter"]), F.coalesce(r["sections"], none))).otherwise(none)
        return F.when(c["name"] == search, hits).when(c["name"] == lookup, looked).otherwise(none)

    return F.array_distinct(F.filter(F.flatten(F.transform(F.coalesce(trace, F.array().cast(TRACE)), of)), lambda p: p.isNotNull() & (p != "")))


def score_turns(turns: DataFrame, loaded: DataFrame) -> DataFrame:
    """Adds ``cited_paths``, ``retrieval_hit``, ``cite_hit`` (null if nothing expected is loaded) and ``abstained`` (out-of-scope turns).

    Turns have ``turn_id``, ``kind``, ``expected_paths``, ``trace``, ``answer``.
    """
    d = turns.withColumn("retrieved", retrieved_paths(F.col("trace")))
    d = d.withColumn("cited_paths", F.array_sort(F.filter("retrieved", lambda p: F.contains(F.coalesce("answer", F.lit("")), p))))
    there = d.select("turn_id", F.explode("expected_paths").alias("path")).join(loaded.select("path").distinct(), "path", "left_semi").groupBy("turn_id").agg(F.array_sort(F.collect_set("path")).alias("expected_here"))
    d = d.join(there, "turn_id", "left")
    hit = lambda c: F.when(F.col("expected_here").isNotNull(), F.arrays_overlap("expected_here", c))
    asked = F.coalesce(F.size("expected_paths"), F.lit(0)) > 0
    return d.withColumns({"retrieval_hit": hit("retrieved"), "cite_hit": hit("cited_paths"), "abstained": F.when(~asked & (F.col("kind") == "out_of_scope"), F.size("cited_paths") == 0)})


def score_kinds(scored: DataFrame) -> DataFrame:
    yes = lambda c: F.count_if(F.col(c)).alias(f"n_{c}")
    return scored.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), yes("retrieval_hit"), yes("cite_hit"), yes("abstained"))


def sources_footer(turns: DataFrame, most: int = 8) -> DataFrame:
    """Adds ``footer``: of the paths brought up, those the answer repeats, or all if it repeats none; the first ``most``."""
    brought = retrieved_paths(F.col("trace"))
    d = turns.withColumn("_all", brought).withColumn("_cited", F.filter("_all", lambda p: F.contains(F.coalesce("answer", F.lit("")), p)))
    return d.withColumn("footer", F.slice(F.when(F.size("_cited") > 0, F.col("_cited")).otherwise(F.col("_all")), 1, most)).drop("_all", "_cited")


def excerpt_for_model(body: Column, rank: Column, first: int = 4_000, rest: int = 800) -> Column:
    """The top hit may be longer than the others; both end at a blank if one is near."""
    from palimpsest.functions.text import body_excerpt

    return F.when(rank <= 1, body_excerpt(body, first)).otherwise(body_excerpt(body, rest))


def flat_messages(messages: DataFrame) -> DataFrame:
    """User, assistant and system messages with their text parts joined by line feeds."""
    shown = F.filter("parts", lambda p: p["type"] == "text")
    return messages.where(F.col("role").isin("user", "assistant", "system")).withColumn("text", F.array_join(F.transform(shown, lambda p: p["text"]), "\n"))


def fold_events(events: DataFrame) -> DataFrame:
    """``run_id``, ``answer``, ``n_steps``, ``n_completed``, ``n_failed``, ``state`` of each run's event stream.

    Events have ``seq``, ``type`` (tool_start, delta, done, error) and ``text``.
    Starting a step, the first piece of the answer and the end complete the open
    one; an error fails it and replaces the answer.  What follows an end is ignored.
    """
    w = W.partitionBy("run_id").orderBy("seq")
    ended = F.max(F.col("type").isin("done", "error").cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1))
    live = events.withColumn("_ended", F.coalesce(ended, F.lit(0))).where("_ended = 0")
    by = live.groupBy("run_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == "delta", F.struct("seq", "text")))), lambda x: x["text"]), "").alias("said"),
        F.count_if(F.col("type") == "tool_start").alias("n_steps"),
        F.max(F.when(F.col("type") == "done", "success").when(F.col("type") == "error", "failed")).alias("state"),
        F.max(F.when(F.col("type") == "error", F.col("text"))).alias("reason"),
        F.max(F.when(F.col("type") == "tool_start", F.col("seq"))).alias("last_step"),
        F.min(F.when(F.col("type") == "delta", F.col("seq"))).alias("first_delta"),
    )
    # The last step is open unless the answer began behind it or the run ended well.
    open_step = (F.col("n_steps") > 0) & ~F.coalesce(F.col("first_delta") > F.col("last_step"), F.lit(False))
    failed = F.when(F.coalesce(F.col("state") == "failed", F.lit(False)) & open_step, 1).otherwise(0)
    answer = F.when(F.col("state") == "failed", F.concat(F.lit("The request failed: "), F.coalesce("reason", F.lit("")))).when((F.col("state") == "success") & (F.col("said") == ""), "(no answer returned)").otherwise(F.col("said"))
    running = F.when(F.col("state").isNull() & open_step, 1).otherwise(0)
    return by.select("run_id", answer.alias("answer"), "n_steps", (F.col("n_steps") - failed - running).alias("n_completed"), failed.alias("n_failed"), F.coalesce("state", F.lit("running")).alias("state"))


def quota_of(tier: Column) -> Column:
    """Calls a day; null for no limit; unknown tiers get the least."""
    c = F.when(tier == "custom", F.lit(None).cast("long"))
    for name, n in QUOTAS.items():
        if n is not None:
            c = c.when(tier == name, F.lit(n).cast("long"))
    return c.otherwise(F.lit(QUOTAS["free"]).cast("long"))


def allowed_features(asked: DataFrame, tiers: DataFrame) -> DataFrame:
    """Adds ``allowed`` to (``tier``, ``feature``): whether the tier's ``features`` in ``tiers`` (one row each) hold it; unknown tiers may nothing."""
    own = tiers.select("tier", F.col("features").alias("_features"))
    held = F.coalesce(F.array_contains("_features", F.col("feature")), F.lit(False))
    return asked.join(own, "tier", "left").withColumn("allowed", held).drop("_features")


def _left(quota: Column, used: Column) -> Column:
    """What is left of a quota; null if there is no limit."""
    return F.when(quota.isNotNull(), F.greatest(quota - used, F.lit(0)))


def daily_quota(calls: DataFrame, quota: Column) -> DataFrame:
    """Adds to calls (``call_id``, ``key``, ``at``) ``day`` (UTC), ``used``, ``allowed`` and ``remaining``.

    A running count by key and day: each key and day is a window of its own.
    """
    d = calls.withColumn("day", F.to_date("at")).withColumn("quota", quota)
    d = d.withColumn("used", F.row_number().over(W.partitionBy("key", "day").orderBy("at", "call_id")))
    return d.withColumns({"allowed": F.coalesce(F.col("used") <= F.col("quota"), F.lit(True)), "remaining": _left(F.col("quota"), F.col("used"))})


def usage(calls: DataFrame, quota: Column) -> DataFrame:
    """By key and day, without ranking the calls: ``used``, ``n_refused``, ``remaining``."""
    d = calls.withColumn("day", F.to_date("at")).withColumn("quota", quota).groupBy("key", "day", "quota").agg(F.count(F.lit(1)).alias("used"))
    return d.select("key", "day", "used", F.greatest(F.col("used") - F.col("quota"), F.lit(0)).alias("n_refused"), _left(F.col("quota"), F.col("used")).alias("remaining"))


def chat_caps(calls: DataFrame, daily: int = DAILY_CHATS, monthly: int = MONTHLY_CHATS) -> DataFrame:
    """Adds ``code``: 503 beyond the month's total of all, 429 beyond a key's own day, else 200.

    The place of a call within its month comes from totals of seconds, and from
    its rank within its second: no window holds more than the seconds of a
    month, or the calls of one second.
    """
    d = calls.withColumn("day", F.to_date("at")).withColumn("month", F.trunc("at", "month"))
    d = d.withColumn("second", F.date_trunc("second", F.col("at").cast("timestamp_ntz")))
    per = d.groupBy("month", "second").agg(F.count(F.lit(1)).alias("n"))
    before = per.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("month").orderBy("second").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("second", "before")
    d = d.join(before, "second").withColumn("of_month", F.col("before") + F.row_number().over(W.partitionBy("second").orderBy("at", "call_id")))
    d = d.withColumn("of_day", F.row_number().over(W.partitionBy("key", "day").orderBy("at", "call_id")))
    code = F.when(F.col("of_month") > monthly, 503).when(F.col("of_day") > daily, 429).otherwise(200)
    return d.withColumn("code", code).drop("second", "before")
