"""Encoding of whole texts inside tasks, each distinct word once.

Byte-level vocabularies split a text by a pattern before any merge, and no
match of that pattern crosses from a non-blank character to a blank, or takes
a blank that a non-blank follows together with what stands before it.  A text
in which no two white-space characters touch, and that ends in no blank, can be cut before each
blank and line feed, and the ids of the parts joined.  Arrow splits a batch
and numbers its distinct parts; only parts that are not among those kept from
earlier batches are encoded, and the ids of the batch are gathered by Arrow.  Other texts are encoded as they are,
in pieces that end before a blank between two non-blank characters.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Two adjacent characters that some engine takes for white space, or a blank at the end.
_TWO_BLANKS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]{2}| \z"
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Distinct parts kept between batches (half of them, the ones met most, when there are more), and the bytes of the longest that are kept.
MOST_PARTS, LONGEST_PART = 500_000, 64
#: Bytes of text that an operator takes at a time, and that are encoded at a time: more repeat each other's words.
SLICE_BYTES, ENCODED_BYTES = 4 << 20, 8 << 20


def safe_pieces(text: str, least: int = 1 << 16) -> Iterator[str]:
    """``text`` in pieces of ``least`` characters or more, cut before a blank between two non-blanks."""
    at = 0
    while len(text) - at > 2 * least and (m := _SAFE_CUT.search(text, at + least)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


class Encoder:
    """Texts to ids.

    ``encode_parts`` gets strings to be encoded each by itself and returns their
    ids one after another and how many each has.
    """

    def __init__(self, encode_parts: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], encode_text: Callable[[str], np.ndarray], dtype: str):
        self.encode_parts, self.encode_text, self.dtype = encode_parts, encode_text, dtype
        self.reset()

    def reset(self) -> None:
        self.known = pa.array([""], pa.string())
        self.ends = np.zeros(2, np.int32)  # of the parts' ids in ``flat``, in order of ``known``
        self.flat = np.zeros(0, self.dtype)
        self.used = np.zeros(1, np.int32)  # batches in which a part was met, halved from time to time

    def _trim(self) -> None:
        """Of too many parts, those met in the most batches stay."""
        order = np.argsort(-self.used[1:], kind="stable")[: MOST_PARTS // 2]
        stay = np.concatenate([[0], 1 + np.sort(order)])
        ids = pa.ListArray.from_arrays(pa.array(self.ends), pa.array(self.flat)).take(pa.array(stay))
        self.known, self.used = self.known.take(pa.array(stay)), self.used[stay] // 2
        self.ends = ids.offsets.to_numpy(zero_copy_only=False).astype(np.int32)
        self.flat = ids.values.to_numpy(zero_copy_only=False).astype(self.dtype)

    def _slots(self, keys: pa.Array) -> tuple[np.ndarray, int]:
        """Where the ids of each of the (distinct) parts are, and how many of all parts are to be kept."""
        found = pc.index_in(keys, value_set=self.known)
        new = pc.is_null(found).to_numpy(zero_copy_only=False)
        slots = pc.fill_null(found, 0).to_numpy(zero_copy_only=False).astype(np.int32)
        self.used[slots[~new]] += 1
        if not new.any():
            return slots, len(self.known)
        at = np.flatnonzero(new)
        # Long ones come last, so that they can go when they have been used.
        long = pc.greater(pc.binary_length(keys.take(pa.array(at))), LONGEST_PART).to_numpy(zero_copy_only=False)
        at = np.concatenate([at[~long], at[long]])
        parts = keys.take(pa.array(at))
        ids, length = self.encode_parts([k if k[0] == "\n" else " " + k for k in parts.to_pylist()])
        slots[at] = len(self.known) + np.arange(len(at), dtype=np.int32)
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(length, dtype=np.int32)])
        self.flat = np.concatenate([self.flat, ids.astype(self.dtype)])
        self.known = pa.concat_arrays([self.known, parts[: len(at) - int(long.sum())]])
        self.used = np.concatenate([self.used, np.ones(len(self.known) - len(self.used), np.int32)])
        return slots, len(self.known)

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without adjacent blanks, and where each text's begin and end."""
        led = pc.binary_join_element_wise(pa.scalar("\n"), texts, pa.scalar(""))
        parts = pc.split_pattern(pc.replace_substring(led, "\n", " \n"), " ")
        coded = pc.dictionary_encode(parts.flatten())
        if len(self.known) > MOST_PARTS:
            self._trim()
        slots, kept = self._slots(coded.dictionary)
        # Arrow copies each part's run of ids; a part of a text is one list.
        taken = pa.ListArray.from_arrays(pa.array(self.ends), pa.array(self.flat)).take(pa.array(slots[coded.indices.to_numpy(zero_copy_only=False)]))
        ids, ends = taken.values.to_numpy(zero_copy_only=False), taken.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        bounds = ends[parts.offsets.to_numpy(zero_copy_only=False) - parts.offsets[0].as_py()]
        self.ends = self.ends[: kept + 1]
        self.flat = self.flat[: self.ends[-1]]
        # Each text was led by a line feed, which is one id.
        return np.delete(ids, bounds[:-1]), bounds - np.arange(len(bounds))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and n + 1 bounds."""
        odd = pc.match_substring_regex(pc.binary_join_element_wise(pa.scalar("\n"), texts, pa.scalar("")), _TWO_BLANKS).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._plain(texts)
        ids, bounds = self._plain(texts.filter(pa.array(~odd)))
        out, k = [], 0
        for i, o in enumerate(odd):
            if o:
                out.append(np.concatenate([self.encode_text(x) for x in safe_pieces(texts[i].as_py())]))
            else:
                out.append(ids[bounds[k] : bounds[k + 1]])
                k += 1
        return np.concatenate(out).astype(self.dtype), np.concatenate([[0], np.cumsum([len(x) for x in out])])


def slices(batch: pa.RecordBatch, text: str | int = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of about ``most`` bytes of the column ``text`` (its name or place)."""
    if not batch.num_rows:
        return
    at = batch.schema.get_field_index(text) if isinstance(text, str) else text
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(size, (size[at - 1] if at else 0) + most)) + 1
        yield batch.slice(at, end - at)
        at = end


_encoders: dict[str, Encoder] = {}


def library_encoder(path: str) -> Encoder:
    """Encoder by the tokenizers library; kept for the life of the Python worker."""
    if path not in _encoders:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        # Byte-level vocabularies write a blank as U+0120 and a line feed as U+010A.
        opens = np.zeros(t.get_vocab_size(), bool)
        for token, i in t.get_vocab().items():
            opens[i] = token[0] in "ĠĊ"

        def one(text: str) -> np.ndarray:
            return np.array(t.encode(text, add_special_tokens=False).ids, np.int64)

        def many(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            alone = [i for i, p in enumerate(parts) if p[-1].isspace() or len(p) > LONGEST_PART]
            apart = set(alone)
            joined = [i for i in range(len(parts)) if i not in apart] if alone else range(len(parts))
            ids, length, whose = [], [], []
            for k in range(0, len(joined), 1024):
                run = joined[k : k + 1024]
                # Parts begin with their only blank, so the ids that open with one show where each begins.
                own = np.array(t.encode_batch_fast(["".join([parts[i] for i in run])], add_special_tokens=False)[0].ids, np.int64)
                at = np.flatnonzero(opens[own])
                if len(at) != len(run):
                    alone.extend(run)
                    continue
                ids.append(own)
                length.append(np.diff(np.append(at, len(own))))
                whose.extend(run)
            for i in alone:
                ids.append(one(parts[i]))
                length.append([len(ids[-1])])
                whose.append(i)
            flat, length = np.concatenate([np.zeros(0, np.int64), *ids]), np.concatenate([np.zeros(0, np.int64), *length]).astype(np.int64)
            if not alone:
                return flat, length
            # Back into the order of the parts.
            order = np.argsort(np.array(whose), kind="stable")
            start = (np.cumsum(length) - length)[order]
            length = length[order]
            ends = np.cumsum(length)
            return flat[np.repeat(start - (ends - length), length) + np.arange(len(flat))], length

        _encoders[path] = Encoder(many, one, "<u2" if t.get_vocab_size() <= 1 << 16 else "<u4")
    return _encoders[path]
