"""Repair of the turn structure of conversations.

A conversation should read: a system turn if it likes, then turns of user and
assistant in alternation.  Rows are kept, given another role, deleted, and
turns without text are inserted, at least total cost.  Costs to go are found
backward over rows and states of that grammar; a walk forward then takes the
first letter, in ASCII, of those whose cost is exactly what remains.  In every
state each letter leads to one state only, so the walk's letters are the least
string of all cheapest repairs.

The costs of a row are a small matrix over states, and matrices of adjacent
rows multiply (least sums), so a conversation of any length is repaired as
pieces: one pass gives each piece's matrix, their products give the costs to
go at each piece's end, those give each piece's exit for each entry, and then
every piece is walked by itself.  Conversations within one partition and of at
most ``PIECE_ROWS`` turns are repaired where they are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .ordered import RANGE_CHARS, hash_in_order, in_runs

#: Costs.
RENAME, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Turns, and characters of their text, that make a piece.
PIECE_ROWS, PIECE_CHARS = 16_384, 1 << 22
_FAR = 1 << 60
#: States: start, after system, after user, after assistant.  Where each initial leads (None: nowhere), and the role that may be put in at each.
_NEXT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
_PUT, _PUT_ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
_NOWHERE = (None,) * 4
#: Pairs of adjacent initials that are right.
_PAIRS = {("s", "u"), ("u", "a"), ("a", "u")}
_SOLID, _BLANKS = re.compile(r"[^\x20\x09-\x0D]"), "\x20\x09\x0a\x0b\x0c\x0d"

#: What is said of a conversation, and what a piece needs besides.
RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_PIECE = "no bigint, codes binary, initials string, roles array<string>, texts array<string>, matrix array<bigint>, n bigint, first_turn bigint, last_turn bigint, least_turn bigint, turns bigint"


def _with_inserts(v: list[int]) -> list[int]:
    """Costs when turns may be inserted first; no more than one in a row can help between user and assistant, two at the start."""
    u, a = min(v[2], INSERT + v[3]), min(v[3], INSERT + v[2])
    return [min(v[0], INSERT + u), min(v[1], INSERT + u), u, a]


END = _with_inserts([0, _FAR, _FAR, 0])


def _before(code: int, leads: tuple, after: list[int]) -> list[int]:
    """Costs to go before a row, from those behind it.  code: 0 must go, 1 sound, 2 truncated."""
    v = [DELETE + x for x in after]
    if code:
        add = TRUNCATED if code == 2 else 0
        for s in range(4):
            v[s] = min(v[s], RENAME + add + after[_PUT[s]])
            if leads[s] is not None:
                v[s] = min(v[s], add + after[leads[s]])
    return _with_inserts(v)


def _costs(codes: bytes, initials: str, after: list[int]) -> list[list[int]]:
    out = [after]
    for code, i in zip(reversed(codes), reversed(initials)):
        out.append(_before(code, _NEXT.get(i, _NOWHERE), out[-1]))
    out.reverse()
    return out


def _walk(codes: bytes, initials: str, costs: list[list[int]], s: int, ends: bool) -> tuple[str, list[tuple[int, str | None]], int]:
    """Letters of the edits, the turns left as (row or -1, role put in or None), and the state behind; ``ends``: nothing follows."""
    audit, turns = [], []
    for k, code in enumerate(codes):
        now, after, leads = costs[k], costs[k + 1], _NEXT.get(initials[k], _NOWHERE)
        while True:
            add = TRUNCATED if code == 2 else 0
            if now[s] == DELETE + after[s]:
                audit.append("D")
            elif now[s] == INSERT + now[_PUT[s]]:
                audit.append("I")
                turns.append((-1, _PUT_ROLE[s]))
                s = _PUT[s]
                continue
            elif leads[s] is not None and now[s] == add + after[leads[s]]:
                audit.append("K")
                turns.append((k, None))
                s = leads[s]
            else:
                audit.append("R")
                turns.append((k, _PUT_ROLE[s]))
                s = _PUT[s]
            break
    while ends and s in (1, 2):
        audit.append("I")
        turns.append((-1, _PUT_ROLE[s]))
        s = _PUT[s]
    return "".join(audit), turns, s


def _text_of(turns: list, roles: list, texts: list) -> str:
    return "\n".join(f"{put or roles[k]}:{texts[k] if k >= 0 else ''}" for k, put in turns)


def _matrix(codes: bytes, initials: str) -> list[int]:
    """Least cost from each state before the piece to each behind it, row by row."""
    cols = [_costs(codes, initials, [0 if s == e else _FAR for s in range(4)])[0] for e in range(4)]
    return [min(cols[e][s], _FAR) for s in range(4) for e in range(4)]


class _Piece:
    """Turns of one conversation, one after another."""

    def __init__(self):
        self.codes, self.initials, self.roles, self.texts = bytearray(), [], [], []
        self.chars = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = self.least_turn = None

    def add(self, turn: int | None, role: str, text: str, code: int, fault: str | None) -> None:
        initial = role[:1] if role[:1] in ("s", "u", "a") else "-"
        if self.initials and (self.initials[-1], initial) not in _PAIRS:
            self.illegal += 1
        if not self.codes:
            self.first_turn = turn
        if turn is not None and (self.last_turn is None or turn != self.last_turn):
            self.turns += 1
            self.least_turn = turn if self.least_turn is None else self.least_turn
        self.last_turn = turn
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        self.codes.append(code)
        self.initials.append(initial)
        self.roles.append(role if code else None)
        self.texts.append(text if code else None)
        self.chars += len(text) if code else 0

    def counts(self) -> dict:
        return {"blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal}

    def whole(self) -> dict:
        codes, initials = bytes(self.codes), "".join(self.initials)
        costs = _costs(codes, initials, END)
        audit, turns, _ = _walk(codes, initials, costs, 0, True)
        text = _text_of(turns, self.roles, self.texts)
        return self.counts() | {"gaps": _gaps(self.least_turn, self.last_turn, self.turns), "cost": costs[0][0], "audit": audit, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()}

    def part(self, no: int) -> dict:
        codes, initials = bytes(self.codes), "".join(self.initials)
        own = {k: getattr(self, k) for k in ("first_turn", "last_turn", "least_turn", "turns", "roles", "texts")}
        return self.counts() | own | {"no": no, "codes": codes, "initials": initials, "matrix": _matrix(codes, initials), "n": len(codes)}


def _gaps(least: int | None, most: int | None, turns: int) -> int:
    if least is None:
        return 0
    return (most - least + 1 - turns + 2**63) % 2**64 - 2**63  # as bigint wraps


def _reader(most_rows: int, most_chars: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order to whole results, or pieces where a conversation is long or may go on in another partition.

        A row whose ``text`` is null tells that the text with this digest is met for the first time in this turn; such
        rows come before the texts with the same beginning.
        """
        names = ["conv_id", "part", "no", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256", "codes", "initials", "roles", "texts", "matrix", "n", "first_turn", "last_turn", "least_turn", "turns"]
        kinds = {"conv_id": pa.int64(), "part": pa.int32(), "audit": pa.string(), "repaired_sha256": pa.string(), "codes": pa.binary(), "initials": pa.string(), "roles": pa.list_(pa.string()), "texts": pa.list_(pa.string()), "matrix": pa.list_(pa.int64())}
        schema = pa.schema([(n, kinds.get(n, pa.int64())) for n in names])
        part, piece, no, conv, seen, cell, new, done, first = 0, _Piece(), 0, None, False, None, set(), set(), True
        out: list[dict] = []

        def close(open_: bool) -> None:
            nonlocal piece, no
            out.append({"conv_id": conv, "part": part} | (piece.part(no) if open_ or no else piece.whole()))
            piece, no = _Piece(), no + 1

        for b in batches:
            for c, p, turn, role, cut, text, digest, n in zip(*(x.to_pylist() for x in b.columns)):
                part = p
                if not seen or c != conv:
                    if seen:
                        close(first)
                        first = False
                    seen, conv, no, cell = True, c, 0, None
                if cell != (turn, role, cut):
                    cell, new, done = (turn, role, cut), set(), set()
                if text is None:
                    if digest is not None:
                        new.add(digest)
                    continue
                for _ in range(n):
                    if len(piece.codes) >= most_rows or piece.chars >= most_chars:
                        close(True)
                    if not _SOLID.search(text):
                        piece.add(turn, role, text, 0, "blank")
                    elif digest in new and digest not in done:
                        done.add(digest)
                        cut_off = text.rstrip(_BLANKS)[-1] not in ".!?"
                        piece.add(turn, role, text, 2 if cut_off else 1, "truncated" if cut_off else None)
                    else:
                        piece.add(turn, role, text, 0, "duplicate")
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if seen:
            close(True)
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return read


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal rows of a batch as one, so that a row repeated a million times doesn't fill a partition."""
    for b in batches:
        t = pa.Table.from_batches([b]).group_by([n for n in b.schema.names if n != "n"], use_threads=False).aggregate([("n", "sum")])
        yield from t.rename_columns([*[n for n in b.schema.names if n != "n"], "n"]).select(b.schema.names).combine_chunks().to_batches()


def _costs_to_go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, part, no, matrix in order -> conv_id, part, no, the costs behind each piece, whether it is the last, and the whole cost."""
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("no", pa.int64()), ("after", pa.list_(pa.int64())), ("ends", pa.bool_()), ("cost", pa.int64())])
    held: list = []

    def solved() -> pa.RecordBatch:
        after, out = END, []
        for k, (c, p, no, m) in enumerate(reversed(held)):
            now = [min(m[4 * s + e] + after[e] for e in range(4)) for s in range(4)]
            out.append({"conv_id": c, "part": p, "no": no, "after": after, "ends": k == 0, "cost": now[0]})
            after = now
        return pa.RecordBatch.from_pylist(out, schema=schema)

    for b in batches:
        for row in zip(*(x.to_pylist() for x in b.columns)):
            if held and row[0] != held[0][0]:
                yield solved()
                held = []
            held.append(row)
    if held:
        yield solved()


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state behind a piece for each state before it."""
    for b in batches:
        out = []
        for codes, initials, after in zip(*(b.column(i).to_pylist() for i in (3, 4, 5))):
            costs = _costs(codes, initials, after)
            out.append([_walk(codes, initials, costs, s, False)[2] for s in range(4)])
        ends = pa.array([x[:1] + "" + x[-1:] for x in b.column(4).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.list_(pa.int32())), ends, *b.columns[6:]], ["conv_id", "part", "no", "exits", "edges", *b.schema.names[6:]])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces' exits and counts in order -> each piece's entry, and with the last piece the conversation's counts."""
    names = ["blank", "duplicate", "truncated", "illegal"]
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("no", pa.int64()), ("entry", pa.int32()), ("last", pa.bool_()), ("gaps", pa.int64()), *[(n, pa.int64()) for n in names]])
    rows: list[dict] = []

    def solved() -> pa.RecordBatch:
        s, total, turns, least, last, edge, out = 0, dict.fromkeys(names, 0), 0, None, None, "", []
        for r in rows:
            out.append({"conv_id": r["conv_id"], "part": r["part"], "no": r["no"], "entry": s, "last": False})
            s = r["exits"][s]
            for n in names:
                total[n] += r[n]
            if not r["n"]:
                continue
            total["illegal"] += bool(edge) and (edge, r["edges"][0]) not in _PAIRS
            edge = r["edges"][-1]
            turns += r["turns"] - (r["first_turn"] is not None and r["first_turn"] == last)
            least = r["least_turn"] if least is None else least
            last = r["last_turn"]
        out[-1] |= {"last": True, "gaps": _gaps(least, last, turns)} | total
        return pa.RecordBatch.from_pylist(out, schema=schema)

    for b in batches:
        for row in b.to_pylist():
            if rows and row["conv_id"] != rows[0]["conv_id"]:
                yield solved()
                rows = []
            rows.append(row)
    if rows:
        yield solved()


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        audits, texts = [], []
        for codes, initials, roles, said, after, ends, s in zip(*(b.column(i).to_pylist() for i in range(3, 10))):
            audit, turns, _ = _walk(codes, initials, _costs(codes, initials, after), s, ends)
            audits.append(audit)
            texts.append(_text_of(turns, roles, said) if turns else None)
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(audits, pa.string()), pa.array(texts, pa.string())], ["conv_id", "part", "no", "audit", "repaired"])


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n: the rows as a fault injector leaves them, ``n`` of each (0: dropped), by crc32 of ``conv_id:turn`` modulo 20; nulls count as one blank."""
    blank = F.lit(" ")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), blank).alias("role"), F.coalesce(F.col("text").cast("string"), blank).alias("text"))
    name = lambda c: F.coalesce(F.col(c).cast("string"), blank)
    rows = rows.withColumn("fate", F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20)
    fate = F.col("fate")
    return rows.select(
        "conv_id", F.when(fate != 0, F.col("turn")).alias("turn"), F.when(fate == 4, F.lit("user")).when(fate == 0, F.lit("")).otherwise(F.col("role")).alias("role"),
        F.when(fate.isin(0, 1), F.lit("")).when(fate == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).cast("long").alias("n"))


def repair(rows: DataFrame) -> DataFrame:
    """One row for each conv_id of ``rows`` (conv_id, turn, role, text, n: so many equal rows, 0 for none): what is wrong with it, the cheapest repair and its hash.

    Rows of equal turn stand in order of role, then text; null turns come
    first; a null conv_id is a conversation like others; other columns are
    ignored; no rows give no conversations.  Null roles and texts must have
    been replaced.  Of equal role and text the first row stays, so a repeated
    row is a duplicate.
    """
    rows = rows.select("conv_id", "turn", "role", "text", "n").mapInArrow(_collapsed, "conv_id bigint, turn bigint, role string, text string, n bigint")
    cut, digest = F.substring("text", 1, RANGE_CHARS).alias("cut"), F.unhex(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 32)).alias("digest")
    rows = rows.select("conv_id", "turn", "role", cut, "text", digest, "n")
    solid = rows.where("n > 0").where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("conv_id", "turn", "role", "cut", "digest")
    new = solid.groupBy("conv_id", "role", "cut", "digest").agg(F.min("turn").alias("turn"), F.max(F.col("turn").isNull()).alias("unnumbered"))
    new = new.select("conv_id", F.when(~F.col("unnumbered"), F.col("turn")).alias("turn"), "role", "cut", F.lit(None).cast("string").alias("text"), "digest", F.lit(0).cast("long").alias("n"))
    place = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("cut")]
    runs = in_runs(rows.unionByName(new), place, [*place, F.col("text").asc_nulls_first()])
    read = runs.select("conv_id", "part", "turn", "role", "cut", "text", "digest", "n").mapInArrow(_reader(PIECE_ROWS, PIECE_CHARS), f"conv_id bigint, part int, no bigint, {RESULT}, {_PIECE.replace('no bigint, ', '')}")
    read = stored(read, "repairs")
    names = ["conv_id", *[x.split()[0] for x in RESULT.split(", ")]]

    pieces = read.where("no IS NOT NULL")
    at = ["conv_id", "part", "no"]
    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"]) & (a["part"] == b["part"]) & (a["no"] == b["no"])
    go = pieces.select(*at, "matrix").repartition("conv_id").sortWithinPartitions(*at)
    go = stored(go.mapInArrow(_costs_to_go, "conv_id bigint, part int, no bigint, after array<bigint>, ends boolean, cost bigint"), "costs")
    stats = ["n", "turns", "first_turn", "last_turn", "least_turn", "blank", "duplicate", "truncated", "illegal"]
    counts = ", ".join(f"{c} bigint" for c in stats)
    exits = pieces.join(go, same(pieces, go)).select(*[pieces[c] for c in (*at, "codes", "initials")], go["after"], *[pieces[c] for c in stats])
    exits = exits.mapInArrow(_exits, f"conv_id bigint, part int, no bigint, exits array<int>, edges string, {counts}")
    entries = exits.repartition("conv_id").sortWithinPartitions(*at).mapInArrow(_entries, "conv_id bigint, part int, no bigint, entry int, last boolean, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint")
    entries = stored(entries, "entries")
    walks = pieces.join(go, same(pieces, go)).join(entries, same(pieces, entries)).select(*[pieces[c] for c in (*at, "codes", "initials", "roles", "texts")], go["after"], go["ends"], entries["entry"])
    walks = stored(walks.mapInArrow(_walks, "conv_id bigint, part int, no bigint, audit string, repaired string"), "walks")
    audits = walks.groupBy("conv_id").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("part", "no", "audit"))), lambda x: x["audit"])).alias("audit"))
    hashes = hash_in_order(walks.where("repaired IS NOT NULL"), ["conv_id"], ["part", "no"], "repaired", "\n")
    total = entries.where("last").drop("part", "no", "entry", "last")
    first = go.groupBy("conv_id").agg(F.max_by("cost", F.struct(-F.col("part"), -F.col("no"))).alias("cost"))
    on = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"])
    long = total.join(first, on(total, first)).join(audits, on(total, audits)).join(hashes, on(total, hashes), "left")
    long = long.select(total["conv_id"], *[F.col(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal")], first["cost"], audits["audit"], F.coalesce(hashes["sha256"], F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))
    return read.where("no IS NULL").select(*names).unionByName(long)
