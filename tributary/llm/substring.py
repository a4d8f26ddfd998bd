"""Removes word windows that an earlier document holds: fixed-block anchors, probes, maximal repeats.

Each document's words are cut into non-overlapping blocks of BLOCK words, the
index; every rolling run of BLOCK words is a probe. Since a window has at least
2 * BLOCK - 1 words, it holds a whole indexed block of any document that it
repeats. Index and probes meet bucket by bucket; a probe hits if its words
are an indexed block somewhere and stand in two documents or more. Hits extend to
all windows made of nothing but repeated runs around a hit; these windows are
compared by 128-bit hashes against the smallest doc_id that holds them, and windows that
lose merge into maximal repeats, which are removed.

Null texts have no words. A null doc_id counts as larger than all others; rows
with equal doc_ids don't remove each other's words. Texts shorter than a window
stay whole. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import exchange as x
from .common import Rolling, blocked

WINDOW = 13
OUTPUTS = {"n_words": "long", "n_removed": "long", "kept": "string", "kept_sha256": "string"}
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_letters, _grams, _more = Rolling(21), Rolling(22), Rolling(23)


def _words(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes in a row, and the place of each text's first word (one more than there are texts)."""
    b = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    edge = np.diff(np.concatenate([[True], _SPACE[b], [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    at = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    return _letters.words(b, starts, ends), np.searchsorted(starts, at)


class _Block:
    """Hashes of all runs of words of a block of documents."""

    def __init__(self, pdf: pd.DataFrame, window: int):
        self.block = (window + 1) // 2
        self.raw = x.texts_of(pdf)
        self.ids = pdf["doc_id"].to_numpy(np.int64)
        parts, at = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
        for i, j in x.runs(np.array([len(r) for r in self.raw]), 1 << 20):
            h, a = _words(self.raw[i:j])
            parts.append(h)
            at.append(a[1:] + at[-1][-1])
        self.words, self.at = np.concatenate(parts), np.concatenate(at)
        self.row = np.repeat(np.arange(len(self.raw)), np.diff(self.at))

    def starts(self, size: int) -> np.ndarray:
        """Where runs of size words within one document start."""
        place = np.arange(len(self.words))
        return place[place + size <= self.at[self.row + 1]]

    def hashes(self, starts: np.ndarray, size: int, other: bool = False) -> np.ndarray:
        r = _more if other else _grams
        return r.slices(r.prefixes(self.words), starts, starts + size)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, outputs: tuple[str, ...] = ("n_words", "n_removed", "kept"), block_bytes: int | None = None, relayed: bool | None = None) -> DataFrame:
    """doc_id and outputs for each row of docs; kept is the remaining words joined by one space."""
    rows, total, blocks = blocked(docs, id_col, text_col, block_bytes)
    to = x.route(total, blocks, relayed)

    def probes(b: _Block) -> tuple[np.ndarray, x.Keys]:
        starts = b.starts(b.block)
        return starts, x.Keys(b.hashes(starts, b.block) if len(starts) else np.zeros(0, np.uint64))

    def first(block: int, pdf: pd.DataFrame):
        b = _Block(pdf, window)
        starts, keys = probes(b)
        if len(starts):
            own = b.row[starts]
            indexed = keys.reduce(np.maximum, ((starts - b.at[own]) % b.block == 0).astype(np.uint8))
            several = (keys.reduce(np.minimum, own) != keys.reduce(np.maximum, own)).astype(np.uint8)
            yield from x.messages(block, "probe", keys, indexed | several << 1, to, narrow=True)

    def meet(keys: x.Keys, value: np.ndarray) -> np.ndarray:
        """1: in several documents; 2: indexed too."""
        several = keys.reduce(np.add, 1 + (value >> 1).astype(np.int64)) > 1
        indexed = keys.reduce(np.bitwise_or, value) & 1
        return np.where(several, 1 + indexed, 0).astype(np.uint8)[keys.inverse]

    def windows(b: _Block, candidate: np.ndarray) -> x.Keys:
        return x.Keys(b.hashes(candidate, window), b.hashes(candidate, window, other=True))

    def second(block: int, pdf: pd.DataFrame, got: pd.DataFrame):
        b = _Block(pdf, window)
        starts, keys = probes(b)
        if not len(starts):
            return
        code = np.zeros(len(b.words) + 1, np.uint8)
        code[starts] = x.answered(got, "probe", "u1")[keys.inverse]
        shared, hit = np.cumsum(np.concatenate([[0], code > 0])), np.cumsum(np.concatenate([[0], code > 1]))
        place, span = b.starts(window), window - b.block + 1
        candidate = place[(shared[place + span] - shared[place] == span) & (hit[place + span] > hit[place])]
        if not len(candidate):
            return
        mask = np.zeros(len(b.words), bool)
        mask[candidate] = True
        yield x.carried(block, to, np.packbits(mask).tobytes())
        keys = windows(b, candidate)
        yield from x.messages(block, "window", keys, keys.reduce(np.minimum, b.ids[b.row[candidate]]).astype("<i8"), to)

    def oldest(keys: x.Keys, value: np.ndarray) -> np.ndarray:
        """1 where a document of another block has a smaller id."""
        return (keys.reduce(np.minimum, value)[keys.inverse] < value).astype(np.uint8)

    def last(_: int, pdf: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        b = _Block(pdf, window)
        removed = np.zeros(len(b.words), bool)
        mask = x.answered(got, "carry", "u1")
        if len(mask):
            candidate = np.flatnonzero(np.unpackbits(mask, count=len(b.words)))
            keys, own = windows(b, candidate), b.ids[b.row[candidate]]
            lost = (x.answered(got, "window", "u1")[keys.inverse] > 0) | (own > keys.reduce(np.minimum, own)[keys.inverse])
            edge = np.bincount(candidate[lost], minlength=len(b.words) + 1)[: len(b.words) + 1] - np.bincount(candidate[lost] + window, minlength=len(b.words) + 1)[: len(b.words) + 1]
            removed = np.cumsum(edge)[: len(b.words)] > 0
        table = []
        for k, raw in enumerate(b.raw):
            gone = removed[b.at[k] : b.at[k + 1]]
            words = raw.split()
            kept = b" ".join(words if not gone.any() else compress(words, ~gone))
            values = {"n_words": len(words), "n_removed": int(gone.sum())}
            if "kept" in outputs:
                values["kept"] = kept.decode("utf-8", "replace")
            if "kept_sha256" in outputs:
                values["kept_sha256"] = hashlib.sha256(kept).hexdigest()
            table.append(tuple(values[o] for o in outputs))
        return pd.DataFrame(table, columns=list(outputs))

    return x.passes(
        rows, first, second, last,
        {"probe": ("<u4", None, "u1", meet)}, {"window": ("<u8", "<u8", "<i8", oldest)},
        ", ".join(f"{o} {OUTPUTS[o]}" for o in outputs), to,
    )
