"""Best-fit packing by bin completion.

Only lengths matter for packing, and there are at most ``size`` of them, so the
plan is made on the histogram of lengths: how many sequences get which filling.
The documents then find their places by their rank within their length, which
is a count by (length, salt), a small running sum, and a window in each pair;
a length has as many salts as its count asks for.  Pieces of the full length
are sequences of their own and are not ranked.

The plan is made by bin completion.  The largest length left is taken, and the
search branches over the fillings around it, those of least waste first; sums
of the lengths left (exact, as bits of an integer) say which waste is possible.
Only undominated fillings count: no members may be replaced by one longer
length left that also fits.  A branch is left when the sequences so far and a
lower bound for the rest are no fewer than in the best plan known, which is
best fit decreasing at first.  A filling is repeated while the histogram
allows, or, as a later branch, used once; so the cost does not grow with the
number of documents.  The search ends with a proof that the plan is the best,
or after ``SEARCH_NODES`` nodes with the best plan known.

Where best fit is further from the bound than rounding could be, many pieces
have few lengths, and a good plan mixes fillings in proportions that repeats
don't reach.  Then fillings are weighed first: each length gets a price, a
filling that is worth more than a sequence takes another's place, and prices
follow, until none is.  Whole repeats of these fillings are the head of one
branch, whose rest is searched like any histogram.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents_of, stored
from .tokens import ENCODED_BYTES, library_encoder, slices

#: Nodes of the search for a plan (fillings looked at), after which the best plan known is taken.
SEARCH_NODES = 20_000
#: Windows in which pieces are ranked, beyond one for each length, and about the least pieces of a window.
WINDOWS, WINDOW_ROWS = 50_000, 1_000
#: Most changes of price.
PRICES = 1_000


def _add_sums(sums: int, x: int, n: int, room: int) -> int:
    """Bits of the sums up to ``room`` after at most ``n`` more members ``x``."""
    n, step, mask = min(n, room // x), 1, (2 << room) - 1
    while n > 0 and sums != mask:
        k = min(step, n)
        sums |= (sums << k * x) & mask
        n -= k
        step *= 2
    return sums


def dominated(filling: list[int], waste: int, counts: np.ndarray) -> bool:
    """Whether a length left over may replace members whose sum it reaches, or be added, within ``waste``."""
    none, one, more = 1, 0, 0  # sums of no, one, two or more members
    for x in filling:
        more |= (more | one) << x
        one |= 1 << x
    left = counts.copy()
    np.subtract.at(left, filling, 1)
    for y in np.flatnonzero(left > 0).tolist():
        # Members of sum y - waste to y go; one member y for another is no change.
        low = max(0, y - waste)
        window = (1 << y - low + 1) - 1
        if (none | more) >> low & window or one >> low & (window >> 1):
            return True
    return False


def fillings(room: int, counts: np.ndarray) -> Iterator[list[int] | None]:
    """Undominated fillings of ``room`` (longest member first), by waste, then those with longer members first; None for each dominated one."""
    have = [x for x in np.flatnonzero(counts[: room + 1]).tolist() if x]
    number = counts.tolist()
    reach = [1]
    for x in have:
        reach.append(_add_sums(reach[-1], x, number[x], room))
    for total in range(room, -1, -1):
        if not reach[-1] >> total & 1:
            continue
        # (Number of lengths still open, sum still to reach, members); every state can be completed.
        stack: list[tuple[int, int, list[int]]] = [(len(have), total, [])]
        while stack:
            k, rest, members = stack.pop()
            if not rest:
                yield None if dominated(members, room - total, counts) else members
                continue
            k = min(k, bisect_right(have, rest))
            x = have[k - 1]
            for n in range(min(number[x], rest // x) + 1):
                if reach[k - 1] >> rest - n * x & 1:
                    stack.append((k - 1, rest - n * x, members + [x] * n))


def best_fit(histogram: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """The plan of best fit decreasing, as :func:`plan_sequences` returns it."""
    open_: dict[int, list[tuple[list[int], int]]] = {}  # by room left
    for x in sorted(histogram, reverse=True):
        n = histogram[x]
        while n:
            room = min((r for r in open_ if r >= x), default=size)
            filling, times = open_[room].pop() if room in open_ else ([], n)
            if room in open_ and not open_[room]:
                del open_[room]
            each = min(room // x, n)
            used = min(times, n // each)
            if filling and used < times:
                open_.setdefault(room, []).append((filling, times - used))
            open_.setdefault(room - each * x, []).append((filling + [x] * each, used))
            n -= used * each
    return [entry for entries in open_.values() for entry in entries]


def _worthiest(lengths: np.ndarray, prices: np.ndarray, size: int) -> np.ndarray:
    """How often each length is in the filling of most worth."""
    worth, last = np.zeros(size + 1), np.full(size + 1, -1)
    for room in range(int(lengths[0]), size + 1):
        fits = lengths[: np.searchsorted(lengths, room, "right")]
        got = worth[room - fits] + prices[: len(fits)]
        k = int(got.argmax())
        worth[room], last[room] = (got[k], k) if got[k] > worth[room - 1] else (worth[room - 1], -1)
    out, room = np.zeros(len(lengths)), size
    while room >= lengths[0]:
        if last[room] < 0:
            room -= 1
        else:
            out[last[room]] += 1
            room -= int(lengths[last[room]])
    return out


def weighed(counts: np.ndarray, size: int) -> tuple[list[tuple[list[int], int]], float]:
    """Fillings with whole repeats, none more than the histogram allows, and a number of sequences that no plan goes below (0 if prices didn't settle).

    The relaxed plan, in which repeats may be fractions, by the simplex method
    over fillings made as they are needed.
    """
    lengths = np.flatnonzero(counts)
    wanted = counts[lengths].astype(float)
    fills = np.diag(size // lengths).astype(float)  # a column for each filling
    settled = False
    for _ in range(PRICES):
        prices = np.linalg.solve(fills.T, np.ones(len(lengths)))
        new = _worthiest(lengths, prices, size)
        if prices @ new <= 1 + 1e-9:
            settled = True
            break
        amount, change = np.linalg.solve(fills, wanted), np.linalg.solve(fills, new)
        ratio = np.where(change > 1e-9, np.maximum(amount, 0) / np.where(change > 1e-9, change, 1), np.inf)
        fills[:, int(ratio.argmin())] = new
    amount = np.linalg.solve(fills, wanted)
    whole = np.floor(np.maximum(amount, 0) + 1e-6).astype(int)
    plan, left = [], counts.copy()
    for column, times in zip(fills.T.astype(int), whole):
        some = column > 0
        times = min(times, int((left[lengths[some]] // column[some]).min()))
        if times > 0:
            left[lengths] -= column * times
            plan.append((np.repeat(lengths, column)[::-1].tolist(), times))
    return plan, float(amount.sum()) if settled else 0.0


def plan_sequences(histogram: dict[int, int], size: int, nodes: int = SEARCH_NODES) -> list[tuple[list[int], int]]:
    """[(lengths of one sequence, how many sequences)], all documents of the histogram placed."""
    counts = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    best = best_fit(histogram, size)
    fewest, bound = sum(t for _, t in best), _bound(counts, size)
    if fewest - bound > len(histogram):
        head, least = weighed(counts, size)
        rest = {x: n - sum(f.count(x) * t for f, t in head) for x, n in histogram.items()}
        some = [*head, *plan_sequences({x: n for x, n in rest.items() if n}, size, nodes // 2)]
        bound = max(bound, int(np.ceil(least - 1e-6 * max(1.0, least))))
        if sum(t for _, t in some) < fewest:
            best, fewest = some, sum(t for _, t in some)

    def branches() -> Iterator[tuple[list[int], np.ndarray, int] | None]:
        largest = int(np.flatnonzero(counts)[-1])
        others = counts.copy()
        others[largest] -= 1
        for rest in fillings(size - largest, others):
            if rest is None:
                yield None
                continue
            need = np.bincount([largest, *rest], minlength=size + 1)
            some = need > 0
            times = int((counts[some] // need[some]).min())
            for t in {times: 0, 1: 0}:
                yield [largest, *rest], need, t

    stack, path, used = [branches()] if fewest > bound else [], [], 0
    while stack and nodes:
        branch = next(stack[-1], ())
        if branch == ():
            stack.pop()
            if path:
                _, need, times = path.pop()
                counts += need * times
                used -= times
            continue
        nodes -= 1
        if branch is None:
            continue
        filling, need, times = branch
        counts -= need * times
        if counts.any() and used + times + _bound(counts, size) < fewest:
            path.append(branch)
            used += times
            stack.append(branches())
            continue
        if not counts.any() and used + times < fewest:
            best, fewest = [(f, t) for f, _, t in [*path, branch]], used + times
            if fewest == bound:
                break
        counts += need * times
    return best


def lower_bound(histogram: dict[int, int], size: int) -> int:
    """No packing has fewer sequences: by the lengths over half, which need one each, and by waste that no filling avoids."""
    counts = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    return _bound(counts, size)


def _bound(counts: np.ndarray, size: int) -> int:
    lengths, half = np.arange(size + 1), size // 2
    number, total = np.cumsum(counts), np.cumsum(counts * lengths)
    # Lengths under k are left out: those over size - k are alone, the others over half take in some of those up to half.
    k = np.arange(half + 1)
    over = number[-1] - number[half]
    spare = size * (number[size - k] - number[half]) - (total[size - k] - total[half])
    small = total[half] - total[np.maximum(k - 1, 0)] * (k > 0)
    best = int((over + np.maximum(0, -((spare - small) // size))).max())
    # The fullest that a sequence can get around a length over half, and without one.
    sums = 1
    for x in np.flatnonzero(counts[: half + 1]).tolist():
        sums = _add_sums(sums, x, int(counts[x]), size) if x else sums
    bits = np.unpackbits(np.frombuffer(sums.to_bytes(size // 8 + 1, "little"), np.uint8), bitorder="little")[: size + 1]
    full = np.maximum.accumulate(np.where(bits, lengths, 0))
    big = lengths[half + 1 :]
    rest = int(total[-1] - (counts[half + 1 :] * (big + full[size - big])).sum())
    return max(best, int(over) + (-(-rest // int(full[size])) if rest > 0 else 0))


def slots_of(plan: list[tuple[list[int], int]], size: int) -> np.ndarray:
    """Rows (length, first rank, copies in a sequence, first sequence, offset of the first copy), sorted.

    Ranks of a length are dealt to the plan's entries one after another.  There
    are as many rows as distinct lengths in the plan's entries.
    """
    rank = np.zeros(size + 1, np.int64)
    rows, sequence = [], 0
    for filling, times in plan:
        at = 0
        for x, n in sorted(((x, filling.count(x)) for x in set(filling)), reverse=True):
            rows.append((x, rank[x], n, sequence, at))
            rank[x] += n * times
            at += n * x
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, spread long"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int, with_ids: bool = False) -> DataFrame:
    """Texts as ids with ``end_id``, longer ones cut so that all pieces but the first have ``size`` ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, n = library_encoder(tokenizer), 0
        for batch in batches:
            for part in slices(batch, most=ENCODED_BYTES):
                ids, bounds = encode(part.column(1).cast(pa.string()))
                cols: list[list] = [[] for _ in range(7)]
                for k, doc in enumerate(part.column(0).to_pylist()):
                    own = np.append(ids[bounds[k] : bounds[k + 1]], end_id).astype("<u4")
                    edges = [0, *range(len(own) % size or size, len(own) + 1, size)]
                    for i, (a, b) in enumerate(zip(edges, edges[1:])):
                        raw = own[a:b].tobytes()
                        crc = zlib.crc32(raw)
                        n += 1
                        # By id, text and place in the task, so that copies and null ids part too.
                        spread = ((doc or 0) * 0x9E3779B97F4A7C15 + n * 0xC2B2AE3D27D4EB4F + crc >> 24) & 0x7FFFFFFF
                        for c, v in zip(cols, (doc, i, a, b - a, crc, spread, raw)):
                            c.append(v)
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "spread", "ids"]
                k = 7 if with_ids else 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:k], types)], names=names[:k])

    return docs.mapInArrow(cut, PIECES + (", ids binary" if with_ids else ""))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Places of all documents in sequences of at most ``size`` ids.

    One row for each piece: ``doc_id``, ``piece``, ``start``, ``length``,
    ``ids_crc32``, ``sequence_id``, ``offset`` (and ``ids``, little-endian
    unsigned 32-bit integers, if asked for).

    Null or empty text is the end id alone.  Repeated rows and equal or null ids
    are packed as rows of their own; an empty table gives an empty result.
    Which of several pieces of one length gets which place is arbitrary but
    fixed once the pieces are written, before they are ranked.
    """
    pieces = stored(token_pieces(documents_of(docs, id_col, text_col), tokenizer, end_id, size, with_ids), "pieces")
    spark = pieces.sparkSession
    # At most size rows, whatever the number of documents.
    histogram = {r["length"]: r["n"] for r in pieces.where(F.col("length") < size).groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    most = max(WINDOW_ROWS, sum(histogram.values()) // WINDOWS)
    windows = [-(-histogram.get(x, 0) // most) or 1 for x in range(size)]
    salted = pieces.withColumn("salt", F.pmod(F.col("spread"), F.get(F.split(F.lit(",".join(map(str, windows))), ",").cast("array<bigint>"), F.col("length"))))
    # One row for each window, a bounded number.
    before, seen = {}, dict.fromkeys(histogram, 0)
    for r in salted.where(F.col("length") < size).groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).orderBy("length", "salt").collect():
        before[r["length"], r["salt"]] = seen[r["length"]]
        seen[r["length"]] += r["n"]
    plan = plan_sequences(histogram, size)
    held = spark.sparkContext.broadcast((slots_of(plan, size), before))
    ranked = salted.where(F.col("length") < size).withColumn("rank", F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    # A full piece is a sequence; where it lies in the written table makes its number, behind those of the plan.
    full = pieces.where(F.col("length") == size).withColumns({"length": F.col("length").cast("long"), "sequence_id": F.monotonically_increasing_id() + sum(t for _, t in plan), "offset": F.lit(0).cast("long")}).select(*names)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, first = held.value
        key = (table[:, 0] << 48) + table[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            length = col["length"].to_numpy(zero_copy_only=False).astype(np.int64)
            rank = col["rank"].to_numpy(zero_copy_only=False) + np.array([first[k] for k in zip(length.tolist(), col["salt"].to_pylist())], np.int64)
            row = table[np.searchsorted(key, (length << 48) + rank, "right") - 1]
            turn = rank - row[:, 1]
            sequence, offset = row[:, 3] + turn // row[:, 2], row[:, 4] + turn % row[:, 2] * length
            arrays = [col["doc_id"], col["piece"], col["start"], pa.array(length), col["ids_crc32"], pa.array(sequence), pa.array(offset)]
            if with_ids:
                arrays = [*arrays, col["ids"]]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    placed = ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + (", ids binary" if with_ids else ""))
    return placed.select(*names).unionByName(full)
