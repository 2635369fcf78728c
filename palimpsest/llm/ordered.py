"""Long sequences in order: sorted runs of rows, and hashes of values one after another.

A group may hold a third of all rows, so no group is sorted by itself: rows
are dealt by ranges of group and position, and a long group lies in several
partitions, in order.  What a partition holds of a group is a run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a text that ranges are cut by (the sample of range bounds passes through the driver), and of a piece of a group's text.
RANGE_CHARS, PIECE_CHARS = 64, 1 << 20


def in_runs(rows: DataFrame, ranges: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    """``rows`` dealt by ``ranges``, sorted by ``order`` in each partition, with the partition's number as ``part``."""
    return rows.repartitionByRange(*ranges).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())


def hash_in_order(rows: DataFrame, key: Sequence[str], order: Sequence[str], value: str, sep: str) -> DataFrame:
    """``key`` and ``sha256``: of each group's values, ascending by ``order``, with ``sep`` between them.

    Groups that lie within one partition are hashed there.  The others leave
    pieces of up to ``PIECE_CHARS``, which one task hashes as they pass; it
    holds one piece at a time.  Rows whose value is null must be left out
    before; null keys are keys like others.
    """
    rows = in_runs(rows.select(*key, *order, value), [F.col(c) for c in (*key, *order)], [F.col(c) for c in (*key, *order)])
    fields = [(f.name, f.dataType.simpleString()) for f in rows.select(*key).schema]
    keys = ", ".join(f"{n} {t}" for n, t in fields)
    at = list(key)

    def emit(held: list, schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(held, schema=schema)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, part, last, first, no, parts, size, out = None, 0, None, True, 0, [], 0, []

        def close(open_: bool) -> None:
            nonlocal no, parts, size
            row = dict(zip(at, last))
            if open_ or no:
                out.append(row | {"part": part, "no": no, "piece": sep.join(parts), "sha256": None})
            else:
                out.append(row | {"part": part, "no": 0, "piece": None, "sha256": hashlib.sha256(sep.join(parts).encode()).hexdigest()})
            no, parts, size = no + 1 if open_ else 0, [], 0

        for b in batches:
            schema = schema or pa.schema([b.schema.field(c) for c in at] + [("part", pa.int32()), ("no", pa.int64()), ("piece", pa.string()), ("sha256", pa.string())])
            cols = [b.column(b.schema.get_field_index(c)).to_pylist() for c in at]
            part = b.column(b.num_columns - 1)[0].as_py() if b.num_rows else part
            for k, v in zip(zip(*cols), b.column(b.schema.get_field_index(value)).to_pylist()):
                if k != last:
                    if last is not None:
                        close(first)
                        first, no = False, 0
                    last = k
                elif size > PIECE_CHARS:
                    close(True)
                parts.append(v)
                size += len(v) + len(sep)
            if out:
                yield emit(out, schema)
                out = []
        if last is not None:
            close(True)
            yield emit(out, schema)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, last, h, out = None, None, None, []
        for b in batches:
            schema = schema or pa.schema([b.schema.field(c) for c in at] + [("sha256", pa.string())])
            cols = [b.column(b.schema.get_field_index(c)).to_pylist() for c in at]
            for k, v in zip(zip(*cols), b.column(b.schema.get_field_index("piece")).to_pylist()):
                if k != last:
                    if last is not None:
                        out.append(dict(zip(at, last)) | {"sha256": h.hexdigest()})
                    last, h = k, hashlib.sha256(v.encode())
                else:
                    h.update((sep + v).encode())
            if out:
                yield emit(out, schema)
                out = []
        if last is not None:
            yield emit([dict(zip(at, last)) | {"sha256": h.hexdigest()}], schema)

    # The partition's number stands last, so that workers find it without a name that could clash.
    runs = rows.select(*key, value, "part").mapInArrow(local, f"{keys}, part int, no bigint, piece string, sha256 string")
    from .common import stored

    runs = stored(runs, "hashed-runs")
    pieces = runs.where("sha256 IS NULL").select(*key, "part", "no", "piece").repartition(*key).sortWithinPartitions(*key, "part", "no")
    return runs.where("sha256 IS NOT NULL").select(*key, "sha256").unionByName(pieces.mapInArrow(joined, f"{keys}, sha256 string"))
