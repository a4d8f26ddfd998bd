"""Counting keys of all documents by blocks of documents and buckets of keys.

A corpus has too many rolling windows to shuffle a row for each. Here a block of
documents sends, for each bucket of the hash space, one row with its distinct keys
packed as bytes; the bucket's task merges what all blocks sent and answers each
block with one number for each key sent, in the order sent. Keys that are frequent
within a block are sent once, so a bucket holds at most one entry for each block
and key, whatever the number of copies; blocks and buckets are both of bounded size.

All passes over the documents use one shuffle of the texts by block.

Where blocks times buckets would be too many messages, they go over relays: a block sends a row for each coarse
bucket, a relay takes the rows of a group of blocks for one coarse bucket and sends one row for each fine bucket in it,
and answers go back the same way. Messages then grow with the blocks times the root of the buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MESSAGE = "bucket long, channel string, block long, n long, key binary, more binary, value binary"
ANSWER = "block long, channel string, bucket long, value binary"


def distinct(h1: np.ndarray, h2: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the distinct keys in key order, the number of each key among them, and their sorted order's edges."""
    order = np.argsort(h1)
    a = h1[order]
    new = a[1:] != a[:-1]
    if h2 is not None:
        b = h2[order]
        if (~new & (b[1:] != b[:-1])).any():
            order = np.lexsort((h2, h1))
            a, b = h1[order], h2[order]
            new = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    edge = np.concatenate([[True], new]) if len(order) else np.zeros(0, bool)
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.cumsum(edge) - 1
    return order, inverse, np.flatnonzero(edge)


class Keys:
    """The distinct keys of one channel in one block, with a value for each."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray | None = None):
        self.order, self.inverse, self.edges = distinct(h1, h2)
        first = self.order[self.edges]
        self.h1, self.h2 = h1[first], None if h2 is None else h2[first]

    def reduce(self, how: np.ufunc, values: np.ndarray) -> np.ndarray:
        return how.reduceat(values[self.order], self.edges) if len(self.edges) else values[:0]

    def counts(self) -> np.ndarray:
        return np.diff(np.concatenate([self.edges, [len(self.order)]]))


@dataclass(frozen=True)
class Route:
    """bits: of the buckets; sent: of those that blocks send to, fewer if their messages go over relays."""

    bits: int
    sent: int

    @property
    def relayed(self) -> bool:
        return self.sent < self.bits

    @property
    def group(self) -> int:
        """Blocks whose messages one relay takes together."""
        return 1 << (self.bits - self.sent)


def route(total: int, blocks: int, relayed: bool | None = None) -> Route:
    bits = max(5, (total // BUCKET_BYTES).bit_length())
    relayed = blocks << bits > MOST_MESSAGES if relayed is None else relayed
    return Route(bits, bits // 2 if relayed else bits)


def messages(block: int, channel: str, keys: Keys, values: np.ndarray, to: Route, narrow: bool = False) -> Iterator[tuple]:
    """A row for each bucket. narrow: 32 bits beside the bucket's, for filters; else, and over relays, all 64 and h2."""
    bits, narrow = to.sent, narrow and not to.relayed
    starts = np.searchsorted(keys.h1, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist() + [len(keys.h1)]
    key = ((keys.h1 >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype("<u4") if narrow else keys.h1.astype("<u8")
    for k in range(1 << bits):
        i, j = starts[k], starts[k + 1]
        if j > i:
            yield k, channel, block, j - i, key[i:j].tobytes(), b"" if keys.h2 is None else keys.h2[i:j].tobytes(), values[i:j].tobytes()


def carried(block: int, to: Route, value: bytes) -> tuple:
    """A note of a block to itself for the next pass."""
    return block % (1 << to.sent), "carry", block, 0, b"", b"", value


def frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["bucket", "channel", "block", "n", "key", "more", "value"])


#: channel -> (key type, type of h2 or None, type of values, how entries of equal keys become the answers), or a
#: function from all messages of a bucket to one answer for each
Merge = dict[str, tuple[str, str | None, str, Callable[[Keys, np.ndarray], np.ndarray]] | Callable[[pd.DataFrame], list[bytes]]]


def _fine(key: bytes, to: Route) -> np.ndarray:
    """Where the fine buckets of a coarse one begin among a message's keys, which are in order; one place more than there are."""
    h = np.frombuffer(key, "<u8")
    within = (h >> np.uint64(64 - to.bits)) & np.uint64(to.group - 1)
    return np.searchsorted(within, np.arange(to.group + 1, dtype=np.uint64))


def _cut(data: bytes, places: np.ndarray, n: int) -> list[bytes]:
    size = len(data) // n if n else 0
    return [data[i * size : j * size] for i, j in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)]


def _relay(key: tuple, pdf: pd.DataFrame, to: Route, sizes: Callable | None) -> pd.DataFrame:
    """What a group of blocks sent to a coarse bucket, as one message for each fine bucket."""
    coarse, channel, group = int(key[0]), key[1], int(key[2])
    held: list[tuple[list, list, list, int]] = [([], [], [], 0) for _ in range(to.group)]
    for m in pdf.sort_values("block").itertuples():
        places = _fine(m.key, to)
        if sizes is None:
            values = _cut(m.value, places, m.n)
        else:
            ends = np.concatenate([[0], np.cumsum(sizes(m.more))])[places].tolist()
            values = [m.value[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]
        for k, (a, b, c) in enumerate(zip(_cut(m.key, places, m.n), _cut(m.more, places, m.n), values, strict=True)):
            if a:
                keys, more, value, n = held[k]
                keys.append(a)
                more.append(b)
                value.append(c)
                held[k] = keys, more, value, n + len(a) // 8
    return frame([(coarse * to.group + k, channel, group, n, b"".join(keys), b"".join(more), b"".join(value)) for k, (keys, more, value, n) in enumerate(held) if n])


def _back(key: tuple, pdf: pd.DataFrame, got: pd.DataFrame, to: Route) -> pd.DataFrame:
    """The answers of a coarse bucket's fine ones, dealt to the blocks that asked, in the order of their keys."""
    pdf = pdf.sort_values("block")
    answer = {int(b) % to.group: v for b, v in zip(got["bucket"], got["value"], strict=True)}
    counts = [np.diff(_fine(k, to)) for k in pdf["key"]]
    asked = np.sum(counts, axis=0)
    size = {k: len(v) // int(asked[k]) for k, v in answer.items()}
    at, rows = dict.fromkeys(answer, 0), []
    for block, n in zip(pdf["block"], counts, strict=True):
        parts = []
        for k in np.flatnonzero(n).tolist():
            end = at[k] + int(n[k]) * size[k]
            parts.append(answer[k][at[k] : end])
            at[k] = end
        rows.append((block, key[1], int(key[0]), b"".join(parts)))
    return pd.DataFrame(rows, columns=["block", "channel", "bucket", "value"])


def answers(sent: DataFrame, merge: Merge, to: Route) -> DataFrame:
    """What each block gets back; merge functions see the entries of one bucket ordered by block."""

    def bucket(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if key[1] == "carry":
            return pd.DataFrame({"block": pdf["block"], "channel": key[1], "bucket": key[0], "value": pdf["value"]})
        pdf = pdf.sort_values("block")
        if callable(merge[key[1]]):
            return pd.DataFrame({"block": pdf["block"].to_numpy(), "channel": key[1], "bucket": key[0], "value": merge[key[1]](pdf)})
        key_type, more_type, value_type, how = merge[key[1]]
        key_type = "<u8" if to.relayed else key_type
        h1 = np.frombuffer(b"".join(pdf["key"]), key_type)
        h2 = None if more_type is None else np.frombuffer(b"".join(pdf["more"]), more_type)
        out = how(Keys(h1, h2), np.frombuffer(b"".join(pdf["value"]), value_type))
        parts = np.split(out, np.cumsum(pdf["n"])[:-1])
        return pd.DataFrame({"block": pdf["block"].to_numpy(), "channel": key[1], "bucket": key[0], "value": [p.tobytes() for p in parts]})

    if not to.relayed:
        return sent.groupBy("bucket", "channel").applyInPandas(bucket, ANSWER)
    asked = sent.where("channel != 'carry'").withColumn("group", F.floor(F.col("block") / to.group)).groupBy("bucket", "channel", "group")
    fine = asked.applyInPandas(lambda k, pdf: _relay(k, pdf, to, getattr(merge[k[1]], "sizes", None)), MESSAGE)
    found = fine.groupBy("bucket", "channel").applyInPandas(bucket, ANSWER)
    back = found.select(F.floor(F.col("bucket") / to.group).alias("coarse"), "channel", F.col("block").alias("group"), "bucket", "value").groupBy("coarse", "channel", "group")
    dealt = asked.cogroup(back).applyInPandas(lambda k, pdf, got: _back(k, pdf, got, to), ANSWER)
    return dealt.unionByName(sent.where("channel = 'carry'").select("block", "channel", "bucket", "value"))


def answered(pdf: pd.DataFrame, channel: str, dtype: str) -> np.ndarray:
    """A block's answers in the order of its keys."""
    own = pdf[pdf["channel"] == channel].sort_values("bucket")
    return np.frombuffer(b"".join(own["value"]), dtype)


#: Bytes of text whose keys one bucket holds, about as many bytes again.
BUCKET_BYTES = 64 << 20


#: Messages between blocks and buckets above which they go over relays.
MOST_MESSAGES = 1 << 22


def texts_of(pdf: pd.DataFrame) -> list[bytes]:
    return [t.encode("utf-8", "replace") for t in pdf["text"]]


def runs(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole items whose sizes sum to about limit."""
    at, held = 0, 0
    for k, n in enumerate(sizes):
        held += int(n)
        if held >= limit:
            yield at, k + 1
            at, held = k + 1, 0
    if at < len(sizes):
        yield at, len(sizes)


def _ordered(pdf: pd.DataFrame) -> pd.DataFrame:
    """A block's rows in one order for all passes, whatever order the shuffle delivers; ties are equal rows."""
    return pdf.sort_values(["doc_id", "no_id", "text"], ignore_index=True)


def passes(docs: DataFrame, first: Callable, second: Callable, last: Callable, merge1: Merge, merge2: Merge, out: str, to: Route) -> DataFrame:
    """Three passes over blocks of documents with two exchanges between.

    docs: doc_id, no_id, text, block. first(block, pdf), second(block, pdf, answers) -> messages;
    last(block, pdf, answers) -> the columns of out, which follow doc_id, in the order of pdf.
    """
    by_block = docs.groupBy("block")
    one = answers(by_block.applyInPandas(lambda k, pdf: frame(list(first(int(k[0]), _ordered(pdf)))), MESSAGE), merge1, to)
    sent = by_block.cogroup(one.groupBy("block")).applyInPandas(lambda k, pdf, got: frame(list(second(int(k[0]), _ordered(pdf), got))), MESSAGE)
    two = answers(sent, merge2, to)

    def rows(key: tuple, pdf: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        pdf = _ordered(pdf)
        return pd.concat([pdf[["doc_id", "no_id"]], last(int(key[0]), pdf, got)], axis=1)

    named = by_block.cogroup(two.groupBy("block")).applyInPandas(rows, f"doc_id long, no_id boolean, {out}")
    return named.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")


