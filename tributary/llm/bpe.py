"""BPE encoding and decoding with a public vocabulary; long texts by tree concatenation.

White space is dropped by the vocabulary's own splitter, so a text falls apart
at ASCII white space into chunks whose ids don't depend on their neighbours.
Chunks are encoded once per worker and kept in a bounded cache.

A text of more than ``leaf`` characters is cut into halves, wherever the middle falls, down to leaves of at most that
size. Leaves are encoded without regard to their neighbours and joined pairwise: what touches the join is encoded afresh
in a window that grows on both sides until both agree. At white space they agree at once, so the window is the torn
chunk. Within an unsplit run longer than a leaf it grows by tokens until its outer ones are those of both sides;
since every adjacent pair of tokens is then one that the merge rules give, the joined list is the encoding of the whole.

Leaves of texts above ``spread`` characters are encoded in separate tasks, and the joins made where the text's row is;
the others are encoded in place.

Nulls count as empty texts, which have no ids and decode to the empty text. Long texts are encoded whole.
Repeated rows give repeated rows; an empty table gives an empty table. The vocabulary file's place is a parameter
and must be readable on every executor.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, release

LEAF = 2048
SPREAD = 1 << 16
CACHE = 60_000
#: Rows that leave a worker at once.
ROWS = 256
#: n_joins: how many joins of halves made the text's ids, 0 for one that is no longer than a leaf.
OUTPUTS = {"ids": "array<int>", "decoded": "string", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "n_joins": "long"}
_SPACES = " \t\n\x0b\f\r"


class _Cache(dict):
    """What make gives for each key; emptied when full, since junk never repeats."""

    def __init__(self, make, limit: int):
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        self[key] = out = self.make(key)
        return out


class _Half:
    """A stretch of text: its chunks' encodings (a torn chunk that is still growing stands as text), its outer chunks, and whether it begins or ends with white space."""

    def __init__(self, text: str, pairs: list):
        chunks = text.encode("utf-8", "surrogatepass").split()
        self.pairs = pairs
        self.first, self.last = (c.decode("utf-8", "surrogatepass") for c in ((chunks[0], chunks[-1]) if chunks else (b"", b"")))
        self.begins, self.ends = text[:1] in _SPACES, text[-1:] in _SPACES

    @classmethod
    def of(cls, a: _Half, b: _Half, pairs: list, first: str, last: str) -> _Half:
        out = cls("", pairs)
        out.first, out.last, out.begins, out.ends = first, last, a.begins, b.ends
        return out


class Encoder:
    """Encodes whole texts with the tokenizers library's vocabulary at ``path``."""

    def __init__(self, path: str, leaf: int = LEAF):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        if spec.get("decoder") is not None or model["type"] != "BPE":
            raise ValueError("this operator joins tokens of a BPE vocabulary without a decoder")
        self.path = path
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.leaf = leaf
        self.cache = _Cache(self._chunk, CACHE)
        self.runs = _Cache(lambda run: self._pair(self.leaf_ids(run if run.isascii() else run.translate(self.byte_names), True)), CACHE)
        self.specials = re.compile("|".join(map(re.escape, self.special)))
        self.split = self._plain_split(spec)

    def build(self, suffix: str):
        """The merge rules alone, read again so that they aren't held by workers that never need them."""
        from tokenizers.models import BPE

        with open(self.path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        return BPE(model["vocab"], merges, **({"end_of_word_suffix": suffix} if suffix else {}))

    @cached_property
    def whole(self):
        return self.build(self.suffix)

    @cached_property
    def inner(self):
        """Without word ends, for the leaves before the last."""
        return self.build("") if self.suffix else self.whole

    def _plain_split(self, spec: dict):
        """For chunks of plain characters: the vocabulary's own split pattern, if its steps are the ones known here.

        Plain are printable ASCII and Latin letters that NFC leaves alone and
        whose lower case is one letter; on these the pattern means the same in
        either regex engine, and byte-level names of ASCII are the characters.
        """
        import regex

        try:
            (nfc, space, lower), (split, level) = spec["normalizer"]["normalizers"], spec["pre_tokenizer"]["pretokenizers"]
            known = (nfc["type"], space["type"], lower["type"], split["type"], split["behavior"], split["invert"], level["type"], level["add_prefix_space"], level["use_regex"]) == ("NFC", "Replace", "Lowercase", "Split", "Removed", True, "ByteLevel", False, False)
        except (KeyError, TypeError, ValueError):
            return None
        if not known or not self.suffix:
            return None
        self.plain = regex.compile(r"[!-~\u00C0-\u012F\u0131-\u0148\u014A-\u017E]+").fullmatch
        # Bytes of Latin letters (0xC3 to 0xC5, then 0x80 to 0xBF) get the names that pre_tokenize_str shows.
        level = self.tokenizer.pre_tokenizer
        self.byte_names = {}
        for c in range(0xC0, 0x17F):
            if self.plain(chr(c)):
                self.byte_names[c] = "".join(p for p, _ in level.pre_tokenize_str(chr(c)))
        return regex.compile(split["pattern"]["Regex"]).findall

    def forget(self) -> None:
        """Empties the caches, since a worker outlives its task."""
        self.cache.clear()
        self.runs.clear()
        release()

    def _chunk(self, chunk: bytes) -> tuple[bytes, bytes]:
        text = chunk.decode("utf-8", "surrogatepass")
        if len(text) > self.leaf:
            return self._pair(self.long_chunk(text))
        if self.split and self.plain(text) and not (self.special and self.specials.search(text)):
            runs = self.split(text.lower())
            if len(runs) == 1:
                return self.runs[runs[0]]
            pairs = [self.runs[r] for r in runs]
            return b"".join([p[0] for p in pairs]), b"".join([p[1] for p in pairs])
        return self._pair(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _pair(self, ids: list[int]) -> tuple[bytes, bytes]:
        return struct.pack(f"<{len(ids)}I", *ids), "".join([f"{self.names[i]} " for i in ids]).encode()

    def long_chunk(self, text: str) -> list[int]:
        ids: list[int] = []
        for piece in self.pieces(text):
            if isinstance(piece, int):
                ids.append(piece)
            else:
                ids += self.tree([(piece[i : i + self.leaf], None) for i in range(0, len(piece), self.leaf)])
        return ids

    def pieces(self, text: str) -> list[int | str]:
        """The ids of special tokens and the unsplit runs, in order."""
        out: list[int | str] = []
        parts = re.split("(" + "|".join(map(re.escape, self.special)) + ")", text) if self.special else [text]
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                normal = self.tokenizer.normalizer.normalize_str(part) if self.tokenizer.normalizer else part
                out += [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]
        return out

    def leaf_ids(self, run: str, last: bool) -> list[int]:
        return [t.id for t in (self.whole if last else self.inner).tokenize(run)] if run else []

    def _width(self, token: int) -> int:
        name = self.names[token]
        return len(name) - len(self.suffix) if self.suffix and name.endswith(self.suffix) else len(name)

    def tree(self, leaves: list[tuple[str, list[int] | None]]) -> list[int]:
        """Joins leaves (run, ids or None) pairwise, level by level."""
        level = [(run, self.leaf_ids(run, k == len(leaves) - 1) if ids is None else ids) for k, (run, ids) in enumerate(leaves)]
        while len(level) > 1:
            level = [
                (level[k][0] + level[k + 1][0], self.join(*level[k], *level[k + 1], last=k + 2 >= len(level))) if k + 1 < len(level) else level[k]
                for k in range(0, len(level), 2)
            ]
        return level[0][1] if level else []

    def join(self, a: str, left: list[int], b: str, right: list[int], last: bool) -> list[int]:
        reach = 32
        while True:
            i, p = len(left), 0
            while i and p < reach:
                i -= 1
                p += self._width(left[i])
            j, q = 0, 0
            while j < len(right) and q < reach:
                q += self._width(right[j])
                j += 1
            window = self.leaf_ids(a[len(a) - p :] + b[:q], last and j == len(right))
            agree_left = i == 0 or window[:2] == left[i : i + 2]
            agree_right = j == len(right) or window[-2:] == right[j - 2 : j]
            if agree_left and agree_right and (len(window) >= 4 or i == 0 or j == len(right)):
                return left[:i] + window + right[j:]
            reach *= 2

    def encode_bytes(self, text: str | None) -> tuple[bytes, bytes, int]:
        """ids as little-endian unsigned 32-bit integers, the decoded text, and the number of joins."""
        text = text or ""
        if len(text) <= self.leaf:
            return *self._bytes(self._pairs(text)), 0
        return self.concatenated([(text[i : i + self.leaf], None) for i in range(0, len(text), self.leaf)])

    def _pairs(self, text: str) -> list[tuple[bytes, bytes]]:
        return list(map(self.cache.__getitem__, text.encode("utf-8", "surrogatepass").split()))

    def _bytes(self, pairs: list[tuple[bytes, bytes]]) -> tuple[bytes, bytes]:
        return b"".join([p[0] for p in pairs]), b"".join([p[1] for p in pairs])[:-1]

    def concatenated(self, leaves: list[tuple[str, list[tuple[bytes, bytes]] | None]]) -> tuple[bytes, bytes, int]:
        """Joins leaves (text, its encoded chunks or None) pairwise, level by level, by halves."""
        level = [_Half(t, self._pairs(t) if pairs is None else pairs) for t, pairs in leaves]
        joins = len(level) - 1
        while len(level) > 1:
            level = [self._joined(level[k], level[k + 1]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        pairs = [self.cache[p.encode("utf-8", "surrogatepass")] if isinstance(p, str) else p for p in level[0].pairs]
        return *self._bytes(pairs), joins

    def _joined(self, a: _Half, b: _Half) -> _Half:
        """A torn chunk is encoded afresh, at once or, if it is longer than a leaf, when it is whole."""
        if not a.pairs or not b.pairs or a.ends or b.begins:
            return _Half.of(a, b, a.pairs + b.pairs, a.first if a.pairs else b.first, b.last if b.pairs else a.last)
        torn = a.last + b.first
        pair = torn if len(torn) > self.leaf else self.cache[torn.encode("utf-8", "surrogatepass")]
        return _Half.of(a, b, a.pairs[:-1] + [pair] + b.pairs[1:], torn if len(a.pairs) == 1 else a.first, torn if len(b.pairs) == 1 else b.last)

    def decode(self, ids) -> str:
        return " ".join([self.names[i] for i in ids if i < len(self.names)])


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, leaf: int = LEAF) -> Encoder:
    if (path, leaf) not in _encoders:
        _encoders[path, leaf] = Encoder(path, leaf)
    return _encoders[path, leaf]


def _outputs(ids: bytes, decoded: bytes, joins: int, outputs: tuple[str, ...]) -> tuple:
    make = {
        "ids": lambda: np.frombuffer(ids, "<u4").astype("int32"),
        "decoded": lambda: decoded.decode("utf-8", "replace"),
        "n_tokens": lambda: len(ids) // 4,
        "ids_sha256": lambda: hashlib.sha256(ids).hexdigest(),
        "decoded_sha256": lambda: hashlib.sha256(decoded).hexdigest(),
        "n_joins": lambda: joins,
    }
    return tuple(make[o]() for o in outputs)


def encoded(text: Column, path: str, outputs: tuple[str, ...] = ("ids",), leaf: int = LEAF) -> Column:
    """A struct column of ``outputs`` for each text, encoded in place."""

    @F.pandas_udf(", ".join(f"{o} {OUTPUTS[o]}" for o in outputs))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        enc = encoder(path, leaf)
        for s in parts:
            for at in range(0, len(s), ROWS):
                yield pd.DataFrame([_outputs(*enc.encode_bytes(t), outputs) for t in s.iloc[at : at + ROWS]], columns=list(outputs))
        enc.forget()

    return run(text)


def decoded(ids: Column, path: str) -> Column:
    """The text that a list of ids decodes to; null ids count as an empty list."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(path)
        for s in parts:
            yield pd.Series([enc.decode(() if x is None else x) for x in s], dtype=object)

    return run(ids)


def encode(docs: DataFrame, path: str, text_col: str = "text", outputs: tuple[str, ...] = ("ids",), into: str = "bpe", leaf: int = LEAF, spread: int = SPREAD) -> DataFrame:
    """docs with a struct column ``into`` of outputs; texts above spread characters are encoded by many tasks.

    A column of that name in docs is an error. One task holds the ids of one text, which its row needs anyhow.
    """
    if free_name(docs, into) != into:
        raise ValueError(f"docs has a column {into}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    huge = F.length(text) > spread
    rest = docs.where(~huge).withColumn(into, encoded(F.col(text_col), path, outputs, leaf))
    long = docs.where(huge)
    size = max(leaf, -(-(spread // 4) // leaf) * leaf)  # whole leaves, so that a text is cut alike in place and here
    pieces = (
        long.select(F.col(text_col).alias("text")).withColumn("key", F.sha2("text", 256)).dropDuplicates(["key"])
        .mapInPandas(lambda parts: _cut(parts, size), "key string, at int, piece string")
        .repartition(F.col("key"), F.col("at"))
        .mapInPandas(lambda parts: _encode_pieces(parts, path, leaf), "key string, at int, piece string, ids array<binary>, decoded array<binary>")
    )
    joined = pieces.groupBy("key").applyInPandas(lambda k, pdf: _join_pieces(k, pdf, path, leaf, outputs), f"key string, out struct<{', '.join(f'{o}:{OUTPUTS[o]}' for o in outputs)}>")
    key = free_name(docs, "text_key")
    wide = long.withColumn(key, F.sha2(F.col(text_col), 256)).join(joined.select(F.col("key").alias(key), F.col("out").alias(into)), key).drop(key)
    return rest.unionByName(wide)


def _cut(parts: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        for key, text in zip(pdf["key"], pdf["text"], strict=True):
            for at in range(0, len(text), 64 * size):
                pieces = [text[i : i + size] for i in range(at, min(at + 64 * size, len(text)), size)]
                yield pd.DataFrame({"key": key, "at": range(at // size, at // size + len(pieces)), "piece": pieces}).astype({"at": "int32"})


def _encode_pieces(parts: Iterator[pd.DataFrame], path: str, leaf: int) -> Iterator[pd.DataFrame]:
    """The chunks of each leaf of a piece, leaves set apart by an empty mark."""
    enc = encoder(path, leaf)
    for pdf in parts:
        for k in range(len(pdf)):
            row, ids, decoded = pdf.iloc[k], [], []
            for i in range(0, len(row["piece"]), leaf):
                pairs = enc._pairs(row["piece"][i : i + leaf])
                ids += [p[0] for p in pairs] + [_MARK]
                decoded += [p[1] for p in pairs] + [_MARK]
            yield pd.DataFrame({"key": [row["key"]], "at": [row["at"]], "piece": [row["piece"]], "ids": [ids], "decoded": [decoded]})
    enc.forget()


#: Ends the chunks of a leaf; no chunk's ids have an odd number of bytes.
_MARK = b"."


def _join_pieces(key: tuple, pdf: pd.DataFrame, path: str, leaf: int, outputs: tuple[str, ...]) -> pd.DataFrame:
    enc, leaves = encoder(path, leaf), []
    for piece, ids, decoded in pdf.sort_values("at")[["piece", "ids", "decoded"]].itertuples(index=False):
        pairs, at = [], 0
        for i, d in zip(ids, decoded, strict=True):
            if i == _MARK:
                leaves.append((piece[at : at + leaf], pairs))
                pairs, at = [], at + leaf
            else:
                pairs.append((bytes(i), bytes(d)))
    out = pd.DataFrame({"key": [key[0]], "out": [dict(zip(outputs, _outputs(*enc.concatenated(leaves), outputs), strict=True))]})
    enc.forget()
    return out
