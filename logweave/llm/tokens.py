"""Token ids of many texts through the tokenizers library, each distinct piece of text encoded once per worker.

A byte-level tokenizer cuts a text at fixed places (before a single blank, between letters and digits,
and so on) and encodes what lies between on its own. Texts are cut at a subset of these places with
array operations; the pieces' ids come from the library and are kept in a table of bounded size.
Texts where the cut is not certain (rare blanks) and other kinds of tokenizer are encoded whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from logweave.llm.words import ragged, segment_hashes

BLANK, GAP, LETTER, DIGIT, MARK, WHOLE = range(6)
_classes = np.full(256, MARK, np.uint8)
_classes[[9, 10, 11, 12, 13]] = GAP
_classes[32] = BLANK
_classes[48:58] = DIGIT
_classes[65:91] = LETTER
_classes[97:123] = LETTER
_classes[39] = WHOLE  # an apostrophe may join the letters after it
_classes[128:] = WHOLE
_unsure = np.zeros(256, bool)
_unsure[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True  # first bytes of blanks outside ASCII
_RARE_BLANKS = re.compile("[\x1c-\x1f\x85\xa0  -     　]")

def _byte_signs() -> dict[int, int]:
    """The printable sign that stands for a byte in byte-level vocabularies: itself, or the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + n for n, b in enumerate(rest)}


_BYTE_SIGNS = _byte_signs()


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces start, a subset of the places where a byte-level tokenizer cuts; and whether it may cut them further."""
    kind = _classes[data]
    after_c3 = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7))  # Latin-1 letters
    kind[after_c3] = LETTER
    kind[after_c3 + 1] = LETTER
    gap = kind <= GAP
    start = np.zeros(len(data), bool)
    before, now = kind[:-1], kind[1:]
    gap_before, gap_now = gap[:-1], gap[1:]
    solid_next = np.zeros(len(data), bool)
    solid_next[:-1] = ~gap[1:]
    ends = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    solid_next[ends] = False
    start[1:] = np.where(
        gap_now,
        ~gap_before | solid_next[1:],
        np.where(gap_before, before == GAP, (now != before) & (now != WHOLE) & (before != WHOLE)),
    )
    start[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(start)
    whole = np.concatenate(([0], np.cumsum(kind == WHOLE)))
    return starts, whole[np.append(starts[1:], len(data))] > whole[starts]


class PieceTable:
    """Ids by the hash of a piece: open addressing over arrays, emptied when full."""

    def __init__(self, slots: int = 1 << 22):
        self.slots = slots
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(self.slots, np.uint64)
        self.entry = np.zeros(self.slots, np.int32)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(20)).astype(np.int64) & (self.slots - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Entry of each key, or -1."""
        found = np.full(len(keys), -1, np.int64)
        slot = self._slot(keys)
        open_ = np.arange(len(keys))
        while len(open_):
            there = self.keys[slot]
            hit = there == keys[open_]
            found[open_[hit]] = self.entry[slot[hit]]
            on = ~hit & (there != 0)
            open_, slot = open_[on], (slot[on] + 1) & (self.slots - 1)
        return found

    def add(self, keys: np.ndarray, ids: list[list[int]]) -> None:
        """Put in new, distinct keys."""
        lengths = np.array([len(x) for x in ids], np.int64)
        number = len(self.starts) + np.arange(len(keys))
        starts = len(self.ids) + np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
        self.ids = np.concatenate([self.ids, np.array([i for x in ids for i in x], np.uint32)])
        self.starts, self.lengths = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, lengths])
        slot = self._slot(keys)
        open_ = np.arange(len(keys))
        while len(open_):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[open_[free]]  # of several keys for a slot, the last stays
            won = self.keys[slot] == keys[open_]
            self.entry[slot[won]] = number[open_[won]]
            open_, slot = open_[~won], (slot[~won] + 1) & (self.slots - 1)


class Encoder:
    """``encode`` gives the ids of the rows of a chunk, each row closed by ``end_id``."""

    def __init__(self, tokenizer_json: str, end_id: int, slots: int = 1 << 22):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.encode_special_tokens = True
        self.end_id = end_id
        spec = json.loads(tokenizer_json)
        cuts = spec.get("pre_tokenizer") or {}
        self.by_piece = (
            cuts.get("type") == "ByteLevel" and cuts.get("use_regex", True) and not cuts.get("add_prefix_space")
            and not spec.get("normalizer") and spec["model"]["type"] == "BPE"
        )
        self.model = self.tokenizer.model
        self.table = PieceTable(slots)
        self.vocabulary = self.tokenizer.get_vocab_size()

    def _piece_ids(self, pieces: list[bytes], further: np.ndarray) -> list[list[int]]:
        """Ids of pieces: straight from the model, or by way of the whole tokenizer where a piece may be cut further."""
        tokenize = self.model.tokenize
        out = [[] if more else [t.id for t in tokenize(x.decode("latin-1").translate(_BYTE_SIGNS))] for x, more in zip(pieces, further.tolist())]
        numbers = np.flatnonzero(further).tolist()
        for number, ids in zip(numbers, self._ids([pieces[n].decode() for n in numbers])):
            out[number] = ids
        return out

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _whole_rows(self, data: np.ndarray, offsets: np.ndarray) -> list[int]:
        if not self.by_piece:
            return list(range(len(offsets) - 1))
        at = np.flatnonzero(_unsure[data])
        rows = np.unique(np.searchsorted(offsets, at, "right") - 1)
        return [int(r) for r in rows if _RARE_BLANKS.search(data[offsets[r] : offsets[r + 1]].tobytes().decode())]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after the other, and the rows' bounds in them."""
        rows = len(offsets) - 1
        whole = self._whole_rows(data, offsets)
        if whole:
            return self._mixed(data, offsets, whole)
        starts, further = piece_starts(data, offsets) if len(data) else (np.zeros(0, np.int64), np.zeros(0, bool))
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        keys = segment_hashes(data, starts, ends)
        keys[keys == 0] = 1
        entry = self.table.find(keys)
        new = np.flatnonzero(entry < 0)
        if len(new):
            fresh, first = np.unique(keys[new], return_index=True)
            if 2 * (len(self.table.starts) + len(fresh)) > self.table.slots:
                self.table.clear()
                fresh, first = np.unique(keys, return_index=True)
                new = np.arange(len(keys))
                if 2 * len(fresh) > self.table.slots:
                    self.table = PieceTable(self.table.slots * 4)
            text = data.tobytes()
            chosen = new[first]
            pieces = [text[a:b] for a, b in zip(starts[chosen].tolist(), ends[chosen].tolist())]
            self.table.add(fresh, self._piece_ids(pieces, further[chosen]))
            entry[new] = self.table.find(keys[new])
        lengths = self.table.lengths[entry]
        ids = self.table.ids[ragged(self.table.starts[entry], lengths)]
        before = np.concatenate(([0], np.cumsum(lengths)))
        bounds = before[np.searchsorted(starts, offsets)]
        out = np.full(len(ids) + rows, self.end_id, np.uint32)
        closed = bounds + np.arange(rows + 1)
        keep = np.ones(len(out), bool)
        keep[closed[1:] - 1] = False
        out[keep] = ids
        return out, closed

    def _mixed(self, data: np.ndarray, offsets: np.ndarray, whole: list[int]) -> tuple[np.ndarray, np.ndarray]:
        parts, bounds, at = [], [0], 0
        text = data.tobytes()
        for row in [*whole, len(offsets) - 1]:
            if row > at:
                ids, inner = self.encode(data[offsets[at] : offsets[row]], offsets[at : row + 1] - offsets[at])
                parts.append(ids)
                bounds.extend((inner[1:] + bounds[-1]).tolist())
            if row < len(offsets) - 1:
                ids = self._ids([text[offsets[row] : offsets[row + 1]].decode()])[0]
                parts.append(np.array([*ids, self.end_id], np.uint32))
                bounds.append(bounds[-1] + len(ids) + 1)
            at = row + 1
        return np.concatenate(parts), np.array(bounds)


_encoders: dict[tuple, Encoder] = {}


def worker_encoder(tokenizer_json: str, end_id: int) -> Encoder:
    """The encoder of this worker process, with the pieces that earlier tasks have encoded."""
    key = (hash(tokenizer_json), end_id)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(tokenizer_json, end_id)
    return _encoders[key]


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()
