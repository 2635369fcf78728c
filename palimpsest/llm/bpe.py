"""Byte-level BPE encoding and decoding with a rank queue.

The pairs of a word wait in buckets by merge rank.  A bitmap in three levels of
64-bit words says which ranks have waiting pairs, so find-first-set on three
words gives the next rank in constant time, however long the word.  Positions
are those of a doubly linked list of the parts; an entry whose part was merged
meanwhile is stale and skipped when it comes up.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import documents_of
from .tokens import Encoder, slices


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class RankQueue:
    """What waits by rank, with find-first-set on three levels of bitmaps."""

    def __init__(self):
        self.low: dict[int, int] = {}
        self.mid: dict[int, int] = {}
        self.top = 0
        self.buckets: dict[int, list] = {}

    def bucket(self, rank: int) -> list:
        """The bucket of a rank, made if need be."""
        found = self.buckets.get(rank)
        if found is None:
            found = self.buckets[rank] = []
            a, b = rank >> 6, rank >> 12
            self.low[a] = self.low.get(a, 0) | 1 << (rank & 63)
            self.mid[b] = self.mid.get(b, 0) | 1 << (a & 63)
            self.top |= 1 << b
        return found

    def first(self) -> int:
        """The least rank that has a bucket."""
        b = (self.top & -self.top).bit_length() - 1
        m = self.mid[b]
        a = b << 6 | (m & -m).bit_length() - 1
        x = self.low[a]
        return a << 6 | (x & -x).bit_length() - 1

    def drop(self, rank: int) -> None:
        del self.buckets[rank]
        a, b = rank >> 6, rank >> 12
        self.low[a] = x = self.low[a] & ~(1 << (rank & 63))
        if not x:
            self.mid[b] = m = self.mid[b] & ~(1 << (a & 63))
            if not m:
                self.top &= ~(1 << b)


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match of the pattern, however long."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    # The part at i spans word[i:end[i]]; before[i] is where the part before it begins.
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    queue = RankQueue()
    get = ranks.get
    for i in range(n - 1):
        rank = get(word[i : i + 2])
        if rank is not None:
            heappush(queue.bucket(rank), i)
    while queue.top:
        rank = queue.first()
        bucket = queue.buckets[rank]
        i = heappop(bucket)
        if not bucket:
            queue.drop(rank)
        j = end[i]
        if not j or j >= n:
            continue  # stale: merged into the part before it, or the last part now
        k = end[j]
        if get(word[i:k]) != rank:
            continue  # stale: one of its parts has grown
        end[i], end[j] = k, 0
        if k < n:
            before[k] = i
            if (r := get(word[i : end[k]])) is not None:
                heappush(queue.bucket(r), i)
        p = before[i]
        if p >= 0 and (r := get(word[p:k])) is not None:
            heappush(queue.bucket(r), p)
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


#: Words up to this many bytes are encoded together.
SHORT_WORD = 48


class PairTable:
    """Rank of two adjacent parts, by their ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k] for k in sorted(pairs)], np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, or -1."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)


def encode_short_words(words: list[bytes], table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many words one after another, and how many each has.

    One queue serves all words: a bucket holds the places in any of them that
    wait for a rank.  Of each word, its leftmost place of the least rank is
    merged at a time, so that a lower rank that a merge brings up comes first.
    """
    size = np.array([len(w) for w in words], np.int64)
    n = int(size.sum())
    ends = np.cumsum(size)
    owner = np.repeat(np.arange(len(words)), size)
    ids = table.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    after, before = np.arange(1, n + 2), np.arange(-1, n)  # one more for the end
    after[ends - 1] = n
    before[ends - size] = -1
    live = np.ones(n, bool)
    waits = np.full(n + 1, -1, np.int64)  # rank of the pair that begins at a place
    queue = RankQueue()

    def push(places: np.ndarray, ranks: np.ndarray) -> None:
        waits[places] = ranks
        some = ranks >= 0
        if not some.all():
            places, ranks = places[some], ranks[some]
        if len(ranks) == 1:
            queue.bucket(int(ranks[0])).append(places)
        elif len(ranks):
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            starts = [0, *cuts.tolist()]
            for r, a, b in zip(ranks[starts].tolist(), starts, [*starts[1:], len(ranks)]):
                queue.bucket(r).append(places[a:b])

    first = np.flatnonzero(after[:n] < n)
    push(first, table.find(ids[first], ids[first + 1]))
    while queue.top:
        rank = queue.first()
        held = queue.buckets[rank]
        queue.drop(rank)
        at = held[0] if len(held) == 1 else np.concatenate(held)
        at = at[waits[at] == rank]  # the others are stale
        if len(at) > 1:
            at = np.unique(at)
            same = np.flatnonzero(owner[at[1:]] == owner[at[:-1]]) + 1
            if len(same):
                queue.bucket(rank).append(at[same])
                at = np.delete(at, same)
        if not len(at):
            continue
        gone = after[at]
        ids[at] = rank
        live[gone] = False
        waits[gone] = -1
        then = after[gone]
        after[at] = then
        before[then] = at  # the place behind the last is never read
        waits[at] = -1
        right = at[then < n]
        if len(right):
            push(right, table.find(ids[right], ids[after[right]]))
        left = before[at]
        inside = left >= 0
        if inside.any():
            left = left[inside]
            push(left, table.find(ids[left], rank))
    return ids[live], np.bincount(owner[live], minlength=len(words))


_coders: dict[tuple[str, str], tuple[Encoder, list[bytes]]] = {}


def coder(path: str, pattern: str) -> tuple[Encoder, list[bytes]]:
    """Encoder by the ranks of ``path``, and the bytes of each id; kept for the life of the Python worker."""
    if (path, pattern) not in _coders:
        ranks = load_ranks(path)
        split = regex.compile(pattern)

        table = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            table[i] = token
        pairs = PairTable(ranks)

        def many(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            words, count = [], []
            for p in parts:
                own = split.findall(p)
                count.append(len(own))
                words += own
            raw = [w.encode() for w in words]
            ids: list = [None] * len(raw)
            short = []
            for i, w in enumerate(raw):
                if (whole := ranks.get(w)) is not None:
                    ids[i] = (whole,)
                elif len(w) > SHORT_WORD:
                    ids[i] = encode_word(w, ranks)
                else:
                    short.append(i)
            if short:
                flat, size = encode_short_words([raw[i] for i in short], pairs)
                flat, at = flat.tolist(), 0
                for i, n in zip(short, size.tolist()):
                    ids[i] = flat[at : at + n]
                    at += n
            length, at = [], 0
            for n in count:
                length.append(sum(map(len, ids[at : at + n])))
                at += n
            return np.array([i for x in ids for i in x], np.int64), np.array(length, np.int64)

        _coders[path, pattern] = Encoder(many, lambda text: many([text])[0], "<u2" if len(table) <= 1 << 16 else "<u4"), table
    return _coders[path, pattern]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by commas) and ``decoded_sha256`` (of the bytes the ids stand for); ``ids`` if asked for.

    Each match of ``pattern`` is encoded by itself, without special tokens.
    Null or empty text has no ids.  Rows are encoded one by one: repeated rows
    and equal or null ids need no rule, an empty table stays empty, and a text
    or a word may be as long as memory holds one text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, table = coder(ranks_path, pattern)
        for batch in batches:
            for part in slices(batch):
                flat, bounds = encode(part.column(1).cast(pa.string()))
                flat = flat.tolist()
                n, ids, back, raw = [], [], [], []
                for a, b in zip(bounds, bounds[1:]):
                    own = flat[a:b]
                    n.append(len(own))
                    ids.append(hashlib.sha256(",".join(map(str, own)).encode()).hexdigest())
                    back.append(hashlib.sha256(b"".join([table[i] for i in own])).hexdigest())
                    raw.append(own)
                cols, names = [part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols, names = [*cols, pa.array(raw, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return documents_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else ""))


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id`` and ``text`` of lists of ids (null: empty); bytes that aren't UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = coder(ranks_path, pattern)[1]
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([b"".join([table[i] for i in ids or ()]).decode(errors="replace") for ids in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(encoded[id_col].cast("long").alias("doc_id"), encoded[ids_col].alias("ids")).mapInArrow(run, "doc_id long, text string")
