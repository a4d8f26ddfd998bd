"""Benchmark decontamination: suffix arrays of training shards, binary-searched with every test suffix.

A shard is a run of whole documents of bounded size. Its suffix array holds, in
the order of their words' 64-bit hashes, the suffixes at word starts that could
begin a test window at all (their first words occur as such in a test item); a
suffix is cut at the window's length and at its document's end. Every suffix of
a test item is looked up by binary search, which gives all places of its window;
overlapping places merge into the longest verbatim stretches.

Shards need nothing from each other, so the corpus is never shuffled. The test
items are read in blocks of bounded size; each block is broadcast and passes over
the corpus once, in one chain of stages.

Null texts have no words; long ones form a shard of their own. Items without words are ignored; items with the same id
count once, and a null item id counts as the id "". Repeated documents give
repeated rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Rolling, free_name, release

WINDOW = 10
#: Bytes of training text in one suffix array, and of test text in one broadcast.
SHARD_BYTES = 1 << 20
ITEM_BYTES = 16 << 20
#: Leading words that a suffix must share with a test suffix to enter the array; all of a shorter window.
LEAD = 3
#: Test suffixes that are looked up at once.
CHUNK = 1 << 16

_IN_WORD = np.zeros(256, bool)
_IN_WORD[0x30:0x3A] = _IN_WORD[0x61:0x7B] = _IN_WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rolling = Rolling(11)
_over_words = Rolling(12)


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row, and the place of each text's first word (one more than there are texts)."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    joined = b"\x00".join(raw) + b"\x00"
    b = _LOWER[np.frombuffer(joined, np.uint8)]
    edge = np.diff(np.concatenate([[False], _IN_WORD[b], [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    hashes = _rolling.words(b, starts, ends)
    at = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    return hashes, np.searchsorted(starts, at)


def _keys(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """The suffix at each start as big-endian words, which sort as text; beyond its end stand zeros."""
    k = starts[:, None] + np.arange(width)
    w = np.where(k < ends[:, None], words[np.minimum(k, len(words) - 1)], np.uint64(0))
    return np.ascontiguousarray(w.astype(">u8")).view(f"S{8 * width}").ravel()


class _Lead:
    """Test windows that are found by their first ``lead`` words, in the order of those words' hashes."""

    def __init__(self, words: np.ndarray, start: np.ndarray, size: np.ndarray, lead: int):
        self.lead = lead
        grams = _grams(words, start, lead)
        order = np.argsort(grams, kind="stable")
        self.grams, self.start, self.size = grams[order], start[order].astype(np.int32), size[order].astype(np.int32)
        self.mask = np.uint64((1 << min(max(16, (8 * len(grams)).bit_length()), 25)) - 1)
        self.bits = np.zeros(int(self.mask) + 1, bool)
        self.bits[grams & self.mask] = True

    def places(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a shard's suffixes begin like a test suffix, and the test windows that begin like one of these."""
        last = len(words) - self.lead + 1
        none = np.zeros(0, np.int64)
        if last <= 0:
            return none, none
        grams = _grams(words, np.arange(last), self.lead)
        near = np.flatnonzero(self.bits[grams & self.mask])
        g = grams[near]
        near, g = (v[self.grams[np.minimum(np.searchsorted(self.grams, g), len(self.grams) - 1)] == g] for v in (near, g))
        own = np.unique(g)
        low, high = np.searchsorted(self.grams, own, "left"), np.searchsorted(self.grams, own, "right")
        n = high - low
        return near, np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(own) else none


class Tests:
    """All windows of a block of test items. Only the texts are sent; each worker indexes them once, in about five times their bytes."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.items, self.window, self._index = items, window, None

    def __getstate__(self):
        return {"items": self.items, "window": self.window, "_index": None}

    def index(self) -> tuple[np.ndarray, np.ndarray, list[_Lead]]:
        """Words of all items, the place of each item's first, and its windows by the length of their lead."""
        if self._index is None:
            words, at = words_of([t for _, t in self.items])
            n = np.diff(at)
            size = np.minimum(n, self.window)
            count = np.where(n > 0, n - size + 1, 0)
            start = np.repeat(at[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if len(n) else n
            size = np.repeat(size, count)
            leads = [(lead, size >= LEAD if lead == LEAD else size == lead) for lead in range(1, LEAD + 1)]
            self._index = words, at, [_Lead(words, start[own], size[own], lead) for lead, own in leads if own.any()]
        return self._index

    def find(self, texts: list[str | None]) -> list[tuple[int, np.ndarray, np.ndarray, list[str]]]:
        """For each text: its words, merged stretches (start, end) of hit words, and the sorted items found."""
        test_words, item_at, leads = self.index()
        words, at = words_of(texts)
        begins: list[list[np.ndarray]] = [[] for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        for lead in leads:
            places, tests = lead.places(words)
            if not len(places):
                continue
            owner = np.searchsorted(at, places, side="right") - 1
            keys = _keys(words, places, at[owner + 1], self.window)
            order = np.argsort(keys, kind="stable")  # the suffix array of this shard
            ranked = keys[order]
            for k in range(0, len(tests), CHUNK):
                own = tests[k : k + CHUNK]
                start, size = lead.start[own].astype(np.int64), lead.size[own].astype(np.int64)
                low, first, inverse = np.unique(_keys(test_words, start, start + size, self.window), return_index=True, return_inverse=True)
                # Above all suffixes that begin with the window: what lies beyond it is filled with ones.
                high = low.view(np.uint8).reshape(-1, 8 * self.window).copy()
                high[np.arange(8 * self.window)[None, :] >= 8 * size[first][:, None]] = 255
                lo, hi = np.searchsorted(ranked, low, "left"), np.searchsorted(ranked, np.ascontiguousarray(high).view(low.dtype).ravel(), "right")
                hit = np.flatnonzero(hi > lo)
                if not len(hit):
                    continue
                holders = np.argsort(inverse, kind="stable")
                cuts = np.concatenate([[0], np.cumsum(np.bincount(inverse, minlength=len(low)))])
                item = np.searchsorted(item_at, start, side="right") - 1
                for t in hit.tolist():
                    names = {self.items[i][0] for i in np.unique(item[holders[cuts[t] : cuts[t + 1]]]).tolist()}
                    found = np.sort(order[lo[t] : hi[t]])
                    docs, begin = np.unique(owner[found], return_index=True)
                    for d, s in zip(docs.tolist(), np.split(places[found], begin[1:]), strict=True):
                        begins[d].append(np.stack([s - at[d], s - at[d] + size[first[t]]]))
                        items[d].update(names)
        out = []
        for d, runs in enumerate(begins):
            s, e = merged(*np.hstack(runs)) if runs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            out.append((int(at[d + 1] - at[d]), s.astype(np.int32), e.astype(np.int32), sorted(items[d])))
        return out


def _grams(words: np.ndarray, starts: np.ndarray, lead: int) -> np.ndarray:
    return _over_words.slices(_over_words.prefixes(words), starts, starts + lead)


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping or touching stretches as one."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return start[new], end[np.concatenate([new[1:], [True]])]


def shards(texts: list[str | None], size: int = SHARD_BYTES) -> Iterator[list[str | None]]:
    """Runs of whole texts of about size characters."""
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t or "")
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


_HITS = "struct<n_words:long,starts:array<int>,ends:array<int>,items:array<string>>"


def _search(text: Column, tests) -> Column:
    @F.pandas_udf(_HITS.removeprefix("struct<").removesuffix(">").replace(":", " ").replace(",", ", "))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            rows = [r for shard in shards(list(s)) for r in tests.value.find(shard)]
            yield pd.DataFrame(rows, columns=["n_words", "starts", "ends", "items"])
        release()

    return run(text)


def _together(a: Column, b: Column) -> Column:
    @F.pandas_udf("n_words long, starts array<int>, ends array<int>, items array<string>")
    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for x, y in zip(a.itertuples(), b.itertuples(), strict=True):
            s, e = merged(np.concatenate([x.starts, y.starts]), np.concatenate([x.ends, y.ends])) if len(x.starts) + len(y.starts) else (x.starts, x.ends)
            rows.append((x.n_words, s, e, sorted({*x.items, *y.items})))
        return pd.DataFrame(rows, columns=["n_words", "starts", "ends", "items"])

    return run(a, b)


def hits(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", into: str = "hits", window: int = WINDOW, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """docs with a struct column ``into``: n_words, starts and ends of merged hit stretches, items.

    A column of that name in docs is an error. An empty table of either kind gives no hits.
    """
    if free_name(docs, into) != into:
        raise ValueError(f"docs has a column {into}")
    rows = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // item_bytes))
    out = docs
    for k in range(blocks):
        own = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        # Bounded by item_bytes, whatever the size of the table.
        tests = docs.sparkSession.sparkContext.broadcast(Tests([tuple(r) for r in own.collect()], window))
        if k == 0:
            out = out.withColumn(into, _search(F.col(text_col), tests))
        else:
            more = free_name(out, f"{into}_more")
            out = out.withColumn(more, _search(F.col(text_col), tests)).withColumn(into, _together(F.col(into), F.col(more))).drop(more)
    return out


def n_hit(found: Column) -> Column:
    return F.aggregate(F.zip_with(found["ends"], found["starts"], lambda e, s: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)


def items_digest(found: Column) -> Column:
    return F.sha2(F.array_join(found["items"], ","), 256)


def digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(names).encode()).hexdigest()
