"""A store of blobs that only a finished run changes."""

import os
import subprocess
import sys
from collections import Counter

import pytest

from palimpsest.sources import blobstore


def contents(store):
    return Counter(bytes(r.content) for r in store.read().collect())


@pytest.mark.parametrize("told", [0, 1_000_000])
def test_each_content_once(spark, tmp_path, monkeypatch, told):
    monkeypatch.setattr(blobstore, "MOST_TOLD", told)
    store = blobstore.BlobStore(spark, f"file://{tmp_path}/store")
    assert contents(store) == {} and store.read().columns == ["content_hash", "byte_size", "content"]
    one = spark.createDataFrame([(b"a", 1), (b"a", 2), (b"", 3), (None, 4), ("ü".encode(), 5)], "content binary, content_hash long")
    store.add(one)
    assert contents(store) == {b"a": 1, b"": 1, "ü".encode(): 1}
    store.add(one)
    store.add(one.where("1 = 0"))
    assert len(os.listdir(tmp_path / "store" / "manifests")) == 1
    store.add(spark.createDataFrame([(bytearray([i % 7]) * 9,) for i in range(300)] + [(b"a",)], "CONTENT binary").repartition(5))
    assert contents(store) == {b"a": 1, b"": 1, "ü".encode(): 1, **{bytes([i]) * 9: 1 for i in range(7)}}
    assert {(r.content_hash, r.byte_size) for r in store.read().collect() if r.byte_size == 0} == {("e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855", 0)}
    with pytest.raises(Exception, match="only grows"):
        store.read().write.format("blob_packs").mode("overwrite").option("path", store.path).save()
    # What no manifest names doesn't count, and can be cleared away.
    before = contents(store)
    stray = tmp_path / "store" / "packs" / "dead"
    stray.mkdir()
    (stray / "000000-1.parquet").write_bytes(b"half a file")
    assert contents(store) == before
    store.clean()
    assert os.listdir(stray) == [] and contents(store) == before


FAILING = """
import sys
from collections import Counter
from pyspark import TaskContext
from pyspark.sql import SparkSession
from palimpsest.sources import blobstore
spark = SparkSession.builder.master("local[2,3]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.adaptive.enabled", "false").config("spark.sql.execution.arrow.maxRecordsPerBatch", "5").getOrCreate()
path = sys.argv[1]
store = blobstore.BlobStore(spark, path)


def failing(attempts):
    def run(batches):
        yield from batches
        if TaskContext.get().attemptNumber() < attempts:
            raise RuntimeError("lost")

    return run


rows = spark.range(400).selectExpr("sha2(string(id % 200), 256) content_hash", "8L byte_size", "encode(repeat(string(id % 200), 50000), 'UTF-8') content").dropDuplicates(["content_hash"])
try:
    rows.mapInArrow(failing(9), rows.schema).write.format("blob_packs").mode("append").option("path", path).option("group_bytes", 1).save()
    print("SAVED")
except Exception as e:
    print("FAILED", store.read().count())
rows.mapInArrow(failing(2), rows.schema).write.format("blob_packs").mode("append").option("path", path).option("group_bytes", 1).save()
print("THEN", store.read().count(), store.read().select("content_hash").distinct().count())
"""


def test_failing_tasks_write_nothing_twice(tmp_path):
    """Each task fails twice, after its rows: their packs don't count.  A run that fails to the end leaves the store as it was."""
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    got = subprocess.run([sys.executable, "-c", FAILING, str(tmp_path / "store")], cwd=top, env={**os.environ, "PYTHONPATH": top}, capture_output=True, text=True, timeout=240)
    assert "FAILED 0" in got.stdout and "THEN 200 200" in got.stdout, got.stdout + got.stderr[-2000:]
    packs = [f for d in os.scandir(tmp_path / "store" / "packs") for f in os.scandir(d) if f.name.endswith(".parquet")]
    assert len(packs) > 4  # those of failed attempts are still there, in no manifest
