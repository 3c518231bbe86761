"""Byte-pair encoding of whole Arrow columns with the tokenizers library.

The library's byte-level pre-tokenizer cuts a text into pre-tokens, which are merged independently of
each other, so a text's ids are its pre-tokens' ids in turn. The cuts are found here for whole batches
at once, and each distinct pre-token is encoded by the library once and kept in a bounded table. Texts
for which that is not certain (an added token's string, characters that this Unicode version may class
otherwise) are encoded by the library whole.
"""
from __future__ import annotations

import functools
from itertools import chain

import numpy as np
import pyarrow as pa

from .wordhash import span_hashes, text_bytes

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: Longest pre-token, in bytes, that is kept in the table.
KEPT = 48
#: Pre-tokens that are kept; the table starts anew when it is full.
MOST = 1_500_000
#: First code point that is left to the library, so that the class table stays within old, settled blocks.
SETTLED = 0x0530
_SLOTS = 1 << 22
_PROBES = (0, 21, 42)


@functools.cache
def _classes() -> np.ndarray:
    """Class of each settled code point; 0 marks one that the library must decide."""
    import regex

    out = np.full(SETTLED, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s"), (0, r"\p{Cn}")):
        test = regex.compile(pattern)
        out[[c for c in range(SETTLED) if test.fullmatch(chr(c))]] = kind
    out[0x1C:0x20] = 0  # white space in some engines only
    return out


@functools.cache
def _byte_letters() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: itself where it prints, else 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _decoded(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte position, class) of each character of UTF-8 data."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    first = data[lead].astype(np.int32)
    code = first
    if len(lead) < len(data):
        two = (first >= 0xC0) & (first < 0xE0)
        nxt = data[np.minimum(lead + 1, len(data) - 1)].astype(np.int32)
        code = np.where(two, ((first & 0x1F) << 6) | (nxt & 0x3F), first)
        code = np.where(first >= 0xE0, SETTLED, code)
    kinds = np.append(_classes(), np.uint8(0))
    return lead, kinds[np.minimum(code, SETTLED)]


def cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where pre-tokens start, and for each row whether its cuts are certain."""
    lead, kind = _decoded(data)
    n = len(lead)
    char = data[lead]
    row_at = np.searchsorted(lead, offsets)
    opens = np.zeros(n + 1, bool)
    opens[row_at] = True  # the first character of a row, and the end
    opens[n] = True
    doubt = np.concatenate([[0], np.cumsum(kind == 0)])
    certain = doubt[row_at[1:]] == doubt[row_at[:-1]]
    new = np.ones(n, bool)
    new[1:] = kind[1:] != kind[:-1]
    new |= opens[:-1]
    space = kind == SPACE
    ends_run = np.zeros(n, bool)  # last white space before something else in the same row
    ends_run[:-1] = space[:-1] & ~space[1:] & ~opens[1:-1]
    # The last white space of a run stands apart from those before it; a blank is taken by what follows.
    start = new.copy()
    start |= ends_run
    after = np.zeros(n, bool)
    after[1:] = ends_run[:-1]
    blank_before = np.zeros(n, bool)
    blank_before[1:] = ends_run[:-1] & (char[:-1] == 32)
    start &= ~(after & blank_before)
    # 's 't 'm 'd 're 've 'll stand apart where an apostrophe opens a pre-token.
    marks = np.flatnonzero((char == 39) & start)
    if len(marks):
        padded = np.append(char, [0, 0])
        one, two = padded[marks + 1], padded[marks + 2]
        stop = np.append(opens, [True, True])
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8)) & ~stop[marks + 1]
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | ((one == ord("l")) & (two == ord("l")))
        pair &= ~stop[marks + 1] & ~stop[marks + 2]
        for found, size in ((marks[short], 2), (marks[pair & ~short], 3)):
            for k in range(1, size):
                start[found + k] = False
            past = found + size
            past = past[past < n]
            # Letters that follow open a pre-token of their own; a run of others was never joined to these.
            start[past] |= ~(space[past] & ~opens[past] & ~new[past])
    return lead[start], certain


class BytePairEncoder:
    """Encodes Arrow string columns; a pre-token is encoded by the library the first time it is seen."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self._clear()

    def vocabulary(self) -> int:
        """The largest id."""
        return max(self.library.get_vocab(with_added_tokens=True).values())

    def _clear(self) -> None:
        self.slot_key = np.zeros(_SLOTS, np.uint64)
        self.slot_at = np.full(_SLOTS, -1, np.int32)
        self.spill: dict[int, int] = {}
        self.first = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int32)
        self.flat = np.zeros(1 << 18, np.uint32)
        self.known = self.used = 0

    def _learn(self, hashes: np.ndarray, texts: list[bytes]) -> None:
        """Encode pre-tokens by the library's model alone: their cuts are known already."""
        tokenize, letters = self.model.tokenize, _byte_letters()
        found = [[t.id for t in tokenize(text.decode("latin-1").translate(letters))] for text in texts]
        sizes = np.fromiter(map(len, found), np.int32, len(found))
        total, many = int(sizes.sum()), len(found)
        while self.known + many > len(self.first):
            self.first, self.size = np.append(self.first, np.zeros_like(self.first)), np.append(self.size, np.zeros_like(self.size))
        while self.used + total > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        new = slice(self.known, self.known + many)
        self.first[new], self.size[new] = self.used + np.cumsum(sizes) - sizes, sizes
        self.flat[self.used:self.used + total] = np.fromiter(chain.from_iterable(found), np.uint32, total)
        left = np.arange(many)
        for shift in _PROBES:
            slot = (hashes[left] >> np.uint64(shift) & np.uint64(_SLOTS - 1)).astype(np.int64)
            taken, pick = np.unique(slot, return_index=True)
            pick = pick[self.slot_at[taken] < 0]
            self.slot_key[slot[pick]], self.slot_at[slot[pick]] = hashes[left[pick]], self.known + left[pick]
            left = np.delete(left, pick)
        self.spill.update(zip(hashes[left].tolist(), (self.known + left).tolist()))
        self.used += total
        self.known += many

    def _lookup(self, hashes: np.ndarray) -> np.ndarray:
        at = np.full(len(hashes), -1, np.int32)
        left = np.arange(len(hashes))
        for shift in _PROBES:
            slot = (hashes[left] >> np.uint64(shift) & np.uint64(_SLOTS - 1)).astype(np.int64)
            good = self.slot_key[slot] == hashes[left]
            good &= self.slot_at[slot] >= 0
            at[left[good]] = self.slot_at[slot[good]]
            left = left[~good]
        if self.spill:
            for i in left.tolist():
                at[i] = self.spill.get(int(hashes[i]), -1)
        return at

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, row offsets); null counts as empty."""
        data, offsets = text_bytes(column)
        rows = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(rows + 1, np.int64)
        starts, certain = cuts(data, offsets)
        whole = data.tobytes()
        for mark in self.added:
            at = whole.find(mark)
            while at >= 0:
                certain[np.searchsorted(offsets, at, side="right") - 1] = False
                at = whole.find(mark, at + 1)
        ends = np.append(starts[1:], len(data))
        row = np.searchsorted(offsets, starts, side="right") - 1
        use = certain[row]
        starts, ends, row = starts[use], ends[use], row[use]
        hashes = span_hashes(data, starts, ends)
        if self.known > MOST:
            self._clear()
        brief = ends - starts <= KEPT
        at = np.full(len(hashes), -1, np.int32)
        at[brief] = self._lookup(hashes[brief])
        missing = np.flatnonzero((at < 0) & brief)
        if len(missing):
            fresh, pick = np.unique(hashes[missing], return_index=True)
            pick = missing[pick]
            self._learn(fresh, [whole[s:e] for s, e in zip(starts[pick].tolist(), ends[pick].tolist())])
            at[missing] = self._lookup(hashes[missing])
        # Long pre-tokens and uncertain rows are encoded as they come.
        direct: dict[int, np.ndarray] = {}
        for i in np.flatnonzero(~brief).tolist():
            direct[i] = np.array(self.library.encode_batch_fast([whole[starts[i]:ends[i]].decode()], add_special_tokens=False)[0].ids, np.uint32)
        size = np.where(at >= 0, self.size[at], 0).astype(np.int64)
        for i, ids in direct.items():
            size[i] = len(ids)
        rest: dict[int, np.ndarray] = {}
        for r in np.flatnonzero(~certain).tolist():
            rest[r] = np.array(self.library.encode_batch_fast([whole[offsets[r]:offsets[r + 1]].decode()], add_special_tokens=False)[0].ids, np.uint32)
        per_row = np.bincount(row, size, rows).astype(np.int64)
        for r, ids in rest.items():
            per_row[r] = len(ids)
        out_offsets = np.concatenate([[0], np.cumsum(per_row)])
        out = np.empty(out_offsets[-1], np.uint32)
        # Place of each pre-token's first id: its row's start and what the row's earlier ones take.
        ahead = np.cumsum(size) - size
        if len(row):
            base = np.zeros(rows, np.int64)
            opener = np.concatenate([[True], row[1:] != row[:-1]])
            base[row[opener]] = ahead[opener]
            place = out_offsets[row] + ahead - base[row]
            table = at >= 0
            n = size[table]
            total = int(n.sum())
            step = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(place[table], n) + step] = self.flat[np.repeat(self.first[at[table]], n) + step]
            for i, ids in direct.items():
                out[place[i]:place[i] + len(ids)] = ids
        for r, ids in rest.items():
            out[out_offsets[r]:out_offsets[r] + len(ids)] = ids
        return out, out_offsets
