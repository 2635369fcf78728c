"""Streams with state give what the batch operators give, in any split."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import evaluation
from palimpsest.streaming import stateful

BASE = 1_704_067_200_000_000  # 2024-01-01


def in_micro_batches(spark, rows, schema, tmp_path, make, starts=2):
    """Write rows as files, start the stream after some, and again after the rest."""
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for k, some in enumerate(rows):
        df = spark.createDataFrame(some, schema).withColumn("at", F.timestamp_micros("at_us"))
        df.drop("at_us").coalesce(1).write.mode("append").parquet(source)
        if k == len(rows) // 2 or k == len(rows) - 1:
            stream = spark.readStream.schema(df.drop("at_us").schema).option("maxFilesPerTrigger", 1).parquet(source)
            stateful.append_to(make(stream), out, checkpoint).awaitTermination(120)
    return spark.read.parquet(out)


def split_late(rng, rows, late_us, parts):
    """Rows in an order in which none is later than ``late_us``, some twice, cut into batches."""
    order = sorted(rows, key=lambda r: r[-1] + rng.randrange(late_us))
    order += rng.sample(order, len(order) // 10)
    order = sorted(order, key=lambda r: r[-1] + rng.randrange(late_us))
    cuts = sorted(rng.sample(range(1, len(order)), parts - 1))
    return [order[a:b] for a, b in zip([0, *cuts], [*cuts, len(order)])]


@pytest.mark.parametrize("seed", [1])
def test_running_quota(spark, tmp_path, seed):
    rng = random.Random(seed)
    calls = [(i, rng.choice([1, 1, 1, 2, 3]), BASE + rng.randrange(3 * 86_400) * 1_000_000) for i in range(150)]
    quota = F.when(F.col("key") == 3, F.lit(None)).otherwise(F.lit(5)).cast("long")
    batches = [*split_late(rng, calls, 3_000_000_000, 4), [(9999, 77, BASE + 30 * 86_400_000_000)], [(9998, 77, BASE + 31 * 86_400_000_000)]]
    got = in_micro_batches(spark, batches, "call_id long, key long, at_us long", tmp_path, lambda s: stateful.daily_quota(s, quota, "1 hour")).where("key < 77")
    d = spark.createDataFrame(calls, "call_id long, key long, at_us long").withColumn("at", F.timestamp_micros("at_us"))
    want = evaluation.daily_quota(d, quota).collect()
    rows = lambda x: sorted((r.call_id, r.key, str(r.day), r.used, r.allowed, r.remaining) for r in x)
    assert rows(got.collect()) == rows(want)


def test_event_folds(spark, tmp_path):
    rng = random.Random(2)
    kinds = ["tool_start", "delta", "delta", "tool_start", "done", "error"]
    events = []
    for run in range(25):
        at = BASE + rng.randrange(86_400) * 1_000_000
        for seq in range(rng.randrange(1, 8)):
            at += rng.randrange(1, 60_000_000)
            events.append((run, seq, rng.choice(kinds), rng.choice(["a", "", None]), at))
    batches = [*split_late(rng, events, 3_000_000_000, 3), [(777, 1, "done", None, BASE + 9 * 86_400_000_000)], [(778, 1, "done", None, BASE + 19 * 86_400_000_000)]]
    got = in_micro_batches(spark, batches, "run_id long, seq long, type string, text string, at_us long", tmp_path, stateful.fold_events).where("run_id < 777")
    want = evaluation.fold_events(spark.createDataFrame(events, "run_id long, seq long, type string, text string, at_us long"))
    rows = lambda x: sorted((r.run_id, r.answer, r.n_steps, r.n_completed, r.n_failed, r.state) for r in x.collect())
    assert rows(got) == rows(want)


def test_quota_state_is_by_buckets(spark, tmp_path):
    """Many keys share few groups, and null keys, repeated calls and quotas of null count as in the batch."""
    calls = [(i, None if i % 7 == 0 else i % 400, BASE + (i * 7919 % 86_400) * 1_000_000) for i in range(1200)]
    quota = F.when(F.col("key") % 5 == 0, F.lit(None)).otherwise(F.lit(2)).cast("long")
    batches = [calls[:700], calls[600:], [(9999, 777, BASE + 30 * 86_400_000_000)], [(9998, 777, BASE + 31 * 86_400_000_000)]]
    seen = []

    def make(stream):
        made = stateful.daily_quota(stream, quota, "1 day")
        seen.append(made._jdf.queryExecution().analyzed().toString())
        return made

    got = in_micro_batches(spark, batches, "call_id long, key long, at_us long", tmp_path, make).where("key is null or key < 777")
    want = evaluation.daily_quota(spark.createDataFrame(calls, "call_id long, key long, at_us long").withColumn("at", F.timestamp_micros("at_us")), quota)
    rows = lambda x: sorted((r.call_id, -1 if r.key is None else r.key, str(r.day), r.used, r.allowed, r.remaining) for r in x.collect())
    assert rows(got) == rows(want)
    assert "bucket" in seen[0]
