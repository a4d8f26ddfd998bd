"""Removes bytes of long repeated strings, by prefix-free parsing.

Triggers: the least rolling hash of TRIGGER bytes among each ``length / 2 - TRIGGER + 1`` successive places. The
trigger of a string of ``length`` bytes is the least one (the first of equals) that begins in its first half, so every
string has one, equal strings have it at the same place, and triggers cut a text into phrases of less than half a
string. The strings of one trigger form a run; what they cover is the trigger's context: the end of the phrase before
it (the dictionary side) and the text from the trigger on (the parse side).

1. Contexts, and the parse strings that all strings of a trigger share, are counted over the corpus. A context that
   occurs twice makes all its strings repeats; a parse string that occurs once makes none.
2. Of the rest, triggers with equal parse strings meet in one range of the corpus order. There the parse sides are put
   in order as a suffix array and the reversed dictionary sides as another, each with its longest common prefixes.
   Both together give the corpus order of all strings of these triggers: two strings agree if and only if their parse
   sides lie in one run of the first array whose prefixes are long enough, and their dictionary sides in one run of
   the second. Bytes are compared here, not hashes.
3. A parse string of more than ``hot`` triggers would make one range too large. The strings of such triggers are
   told apart one by one, by 128 hash bits, and so spread over all ranges.

Contexts are told apart by 128 hash bits. Texts of more than PIECE bytes are worked on in pieces that overlap by a
string less one byte, since a trigger depends on its string alone.

Null counts as an empty text; texts shorter than length stay whole; repeated rows remove each other's bytes like any
other repeats; a null doc_id keeps its row. An empty table gives an empty table. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import exchange as x
from .common import Rolling, blocked

LENGTH = 200
TRIGGER = 8
PIECE = 1 << 20
#: Triggers with one parse string that are put in order together.
HOT = 4096
#: Contexts that are put in order at once, more where one parse string has more.
RANGE = 1 << 15
OUTPUTS = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept": "binary", "kept_sha256": "string"}
_a, _b = Rolling(31), Rolling(32)
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a place within a part, which holds less than two pieces and some.
_PLACE = np.uint64((1 << 22) - 1)


def reach(length: int) -> int:
    """How many places a string's trigger can begin at."""
    return length // 2 - TRIGGER + 1


def _least(a: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` successive values, from running minima within blocks of that width."""
    n = len(a)
    padded = np.full(-(-n // width) * width, np.uint64((1 << 64) - 1))
    padded[:n] = a
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


class _Part:
    """Triggers of a run of segments, none of which sees another."""

    def __init__(self, segments: list[bytes], length: int):
        sizes = np.array([len(s) for s in segments], np.int64)
        self.bytes = np.frombuffer(b"".join(segments), np.uint8)
        self.ends = np.cumsum(sizes)
        self.trigger = self.low = self.high = np.zeros(0, np.int64)
        n = len(self.bytes)
        if n < length:
            return
        width = reach(length)
        eight = np.ndarray((n - TRIGGER + 1,), "<u8", buffer=self.bytes.tobytes(), strides=(1,))
        with np.errstate(over="ignore"):
            h = (eight ^ (eight >> np.uint64(29))) * _ODD
        h = ((h ^ (h >> np.uint64(32))) * _ODD & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        of = (_least(h, width)[: n - length + 1] & _PLACE).astype(np.int64)
        whole = np.ones(len(of), bool)
        for end in self.ends[:-1].tolist():
            whole[max(end - length + 1, 0) : end] = False
        start = np.flatnonzero(whole)
        if not len(start):
            return
        of = of[start]
        edge = np.flatnonzero(of[1:] != of[:-1])
        first, last = np.concatenate([[0], edge + 1]), np.concatenate([edge, [len(of) - 1]])
        self.trigger, self.low, self.high = of[first], start[first], start[last]

    def hashes(self, *ranges: tuple[np.ndarray, np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """128 bits for the slices of each of several (starts, ends)."""
        pa, pb = _a.prefixes(self.bytes), _b.prefixes(self.bytes)
        return [(_a.slices(pa, i, j), _b.slices(pb, i, j)) for i, j in ranges]


def _segments(raw: list[bytes], length: int) -> tuple[list[int], list[int], list[bytes]]:
    """(text, place in it, bytes) of segments: whole texts, and overlapping pieces of long ones."""
    own, at, out = [], [], []
    for k, r in enumerate(raw):
        for i in range(0, max(len(r) - length + 1, 1) if len(r) > PIECE + length else 1, PIECE):
            own.append(k)
            at.append(i)
            out.append(r[i : i + PIECE + length - 1] if len(r) > PIECE + length else r)
    return own, at, out


def _join(parts: list[np.ndarray], dtype) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype), *parts])


#: What a block carries for each trigger: no string repeated, all, to be put in order, the same and all repeated, and the last two told apart one by one.
_NONE, _ALL, _OPEN, _HOLDER, _OPEN_ONE, _HOLDER_ONE = range(6)


class _Block:
    """The triggers of a block of texts."""

    def __init__(self, pdf: pd.DataFrame, length: int):
        self.length = length
        self.raw = x.texts_of(pdf)
        self.own, self.at, segments = _segments(self.raw, length)
        self.runs = list(x.runs(np.array([len(s) for s in segments]), PIECE))
        self.parts = [_Part(segments[i:j], length) for i, j in self.runs]
        self.cuts = np.cumsum([0, *(len(p.trigger) for p in self.parts)])

    def counted(self) -> tuple[x.Keys, x.Keys]:
        """Keys of contexts and of parse strings, part by part."""
        one, two = [], []
        for p in self.parts:
            if len(p.trigger):
                context, parse = p.hashes((p.low, p.high + self.length), self._parse(p, slice(None)))
                one.append(context)
                two.append(parse[0])
        return x.Keys(_join([h for h, _ in one], np.uint64), _join([h for _, h in one], np.uint64)), x.Keys(_join(two, np.uint64))

    def _parse(self, p: _Part, which) -> tuple[np.ndarray, np.ndarray]:
        t = p.trigger[which]
        return t, t + self.length - reach(self.length) + 1

    def chosen(self, state: np.ndarray, *codes: int):
        """(part, its chosen triggers, their numbers in the block), by part."""
        for k, p in enumerate(self.parts):
            which = np.flatnonzero(np.isin(state[self.cuts[k] : self.cuts[k + 1]], codes))
            if len(which):
                yield p, which, which + self.cuts[k]

    def contexts(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
        """Of triggers to be put in order, ordered by parse string: its hash, number, sizes before the trigger (least, most), and the contexts joined."""
        keys, numbers, least, most, texts = [], [], [], [], []
        for p, which, number in self.chosen(state, _OPEN, _HOLDER):
            keys.append(p.hashes(self._parse(p, which))[0][0])
            numbers.append(number)
            least.append(p.trigger[which] - p.high[which])
            most.append(p.trigger[which] - p.low[which])
            b = p.bytes.tobytes()
            texts += [b[i:j] for i, j in zip(p.low[which].tolist(), (p.high[which] + self.length).tolist(), strict=True)]
        keys = _join(keys, np.uint64)
        order = np.argsort(keys, kind="stable")
        numbers, least, most = (_join(v, np.int64).astype(np.int64)[order] for v in (numbers, least, most))
        return keys[order], numbers, least, most, [texts[k] for k in order.tolist()]

    def strings(self, state: np.ndarray) -> tuple[x.Keys, np.ndarray, list[tuple[_Part, np.ndarray]]]:
        """Keys of the strings of hot triggers, the triggers' numbers, and (part, starts) by part."""
        h1, h2, of, places = [], [], [], []
        for p, which, number in self.chosen(state, _OPEN_ONE, _HOLDER_ONE):
            n = p.high[which] - p.low[which] + 1
            start = np.repeat(p.low[which] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            a, b = p.hashes((start, start + self.length))[0]
            h1.append(a)
            h2.append(b)
            of.append(np.repeat(number, n))
            places.append((p, start))
        return x.Keys(_join(h1, np.uint64), _join(h2, np.uint64)), _join(of, np.int64).astype(np.int64), places


def _prefixes(rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of byte rows of given sizes (zeros beyond): each row's rank, and how much each shares with the one before it."""
    by_size = np.argsort(sizes, kind="stable")
    order = by_size[np.argsort(rows[by_size].view(f"S{rows.shape[1]}").ravel(), kind="stable")]
    ranked, size = rows[order], sizes[order]
    differ = ranked[1:] != ranked[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank, np.concatenate([[0], np.minimum(shared, np.minimum(size[1:], size[:-1]))])


def repeated_strings(contexts: list[bytes], least: np.ndarray, most: np.ndarray, weight: np.ndarray, length: int) -> np.ndarray:
    """Whether the string that begins d bytes before a context's trigger occurs twice, by context and d."""
    width, n = reach(length), len(contexts)
    out = np.zeros((n, width), bool)
    parse, dictionary = np.zeros((n, length), np.uint8), np.zeros((n, max(width - 1, 1)), np.uint8)
    for k, (c, m) in enumerate(zip(contexts, most.tolist(), strict=True)):
        own = np.frombuffer(c, np.uint8)
        parse[k, : len(c) - m] = own[m:]
        dictionary[k, :m] = own[:m][::-1]
    parse_rank, parse_shared = _prefixes(parse, length - least)
    dictionary_rank, dictionary_shared = _prefixes(dictionary, most)
    for d in range(width):
        has = np.flatnonzero((least <= d) & (d <= most))
        if not len(has):
            continue
        run = np.cumsum(parse_shared < length - d)[parse_rank[has]]
        other = np.cumsum(dictionary_shared < d)[dictionary_rank[has]]
        _, string = np.unique(run * (n + 1) + other, return_inverse=True)
        out[has, d] = np.bincount(string, weight[has])[string] > 1
    return out


def _in_order(pdf: pd.DataFrame, length: int) -> list[bytes]:
    """For each message of contexts: bits of their repeated strings, a range of the corpus order at a time."""
    keys = np.frombuffer(b"".join(pdf["key"]), "<u8")
    least, most, weight = np.frombuffer(b"".join(pdf["more"]), np.uint8).reshape(-1, 3).astype(np.int64).T
    text, sizes = b"".join(pdf["value"]), most + length - least
    ends = np.cumsum(sizes)
    order = np.argsort(keys, kind="stable")
    new = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]])) if len(keys) else np.zeros(0, np.int64)
    out = np.zeros((len(keys), -(-reach(length) // 8)), np.uint8)
    for i, j in x.runs(np.diff(np.concatenate([new, [len(keys)]])), RANGE):
        own = order[new[i] : new[j] if j < len(new) else len(keys)]
        contexts = [text[e - s : e] for s, e in zip(sizes[own].tolist(), ends[own].tolist(), strict=True)]
        out[own] = np.packbits(repeated_strings(contexts, least[own], most[own], weight[own], length), axis=1)
    cuts = np.concatenate([[0], np.cumsum(pdf["n"].to_numpy())])
    return [out[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, outputs: tuple[str, ...] = ("n_bytes", "n_removed", "n_spans", "kept"), block_bytes: int | None = None, hot: int = HOT, relayed: bool | None = None) -> DataFrame:
    """doc_id and outputs for each row of docs; kept is the remaining bytes joined. length: 18 to 500."""
    rows, size, blocks = blocked(docs, id_col, text_col, block_bytes)
    to = x.route(size, blocks, relayed)

    def first(block: int, pdf: pd.DataFrame):
        context, parse = _Block(pdf, length).counted()
        yield from x.messages(block, "context", context, context.counts().astype("<u4"), to)
        yield from x.messages(block, "parse", parse, parse.counts().astype("<u4"), to, narrow=True)

    def total(keys: x.Keys, value: np.ndarray) -> np.ndarray:
        """The number of occurrences, doubled, and 1 more for the first block that sent the key."""
        n = np.minimum(keys.reduce(np.add, value.astype(np.int64)), (1 << 31) - 1) * 2
        out = n[keys.inverse]
        out[keys.reduce(np.minimum, np.arange(len(value)))] += 1
        return out.astype("<u4")

    def second(block: int, pdf: pd.DataFrame, got: pd.DataFrame):
        own = _Block(pdf, length)
        context, parse = own.counted()
        n_context = x.answered(got, "context", "<u4")[context.inverse]
        n_parse = x.answered(got, "parse", "<u4")[parse.inverse] >> 1
        holds, n_context = (n_context & 1).astype(bool), n_context >> 1
        one = np.zeros(len(n_parse), bool)  # one occurrence of each context
        one[context.order[context.edges]] = True
        holder = (n_context > 1) & holds & one & (n_parse > n_context)
        state = np.where(holder, _HOLDER, np.where(n_context > 1, _ALL, np.where(n_parse > 1, _OPEN, _NONE))).astype(np.uint8)
        state[(state >= _OPEN) & (n_parse > hot)] += 2
        yield x.carried(block, to, state.tobytes())
        keys, number, least, most, texts = own.contexts(state)
        weight = np.where(state[number] == _HOLDER, 2, 1)
        sizes = np.stack([least, most, weight], axis=1).astype(np.uint8)
        starts = np.searchsorted(keys, np.arange(1 << to.sent, dtype=np.uint64) << np.uint64(64 - to.sent)).tolist() + [len(keys)]
        for k, (i, j) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
            if j > i:
                yield k, "context bytes", block, j - i, keys[i:j].astype("<u8").tobytes(), sizes[i:j].tobytes(), b"".join(texts[i:j])
        strings, of, _ = own.strings(state)
        yield from x.messages(block, "string", strings, np.minimum(strings.reduce(np.add, np.where(state[of] == _HOLDER_ONE, 2, 1)), 2).astype(np.uint8), to)

    def repeated(keys: x.Keys, value: np.ndarray) -> np.ndarray:
        return (keys.reduce(np.add, value.astype(np.int64)) > 1).astype(np.uint8)[keys.inverse]

    def last(_: int, pdf: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        own = _Block(pdf, length)
        state = x.answered(got, "carry", "u1")
        known = (state == _ALL) | (state == _HOLDER) | (state == _HOLDER_ONE)
        _, number, _, _, _ = own.contexts(state)
        flags = np.unpackbits(x.answered(got, "context bytes", "u1").reshape(len(number), -1), axis=1) if len(number) else np.zeros((0, 8), np.uint8)
        row = np.full(len(state), -1)
        row[number] = np.arange(len(number))
        strings, _, places = own.strings(state)
        hit = x.answered(got, "string", "u1")[strings.inverse] > 0 if len(strings.inverse) else np.zeros(0, bool)
        hits, at = {}, 0
        for p, start in places:
            hits[id(p)] = start[hit[at : at + len(start)]]
            at += len(start)
        gone = [np.zeros(len(r), bool) for r in own.raw]
        for k, (p, (i, j)) in enumerate(zip(own.parts, own.runs, strict=True)):
            mine = slice(own.cuts[k], own.cuts[k + 1])
            opened = np.flatnonzero(row[mine] >= 0)
            which, d = np.nonzero(flags[row[mine][opened]])
            found = np.concatenate([p.trigger[opened[which]] - d, hits.get(id(p), np.zeros(0, np.int64))])
            n = len(p.bytes)
            edge = np.bincount(np.concatenate([p.low[known[mine]], found]), minlength=n + 1) - np.bincount(np.concatenate([p.high[known[mine]] + length, found + length]), minlength=n + 1)
            covered = np.cumsum(edge)[:n] > 0
            begin = 0
            for s, end in zip(range(i, j), p.ends.tolist(), strict=True):
                a = own.at[s]
                gone[own.own[s]][a : a + end - begin] |= covered[begin:end]
                begin = end
        table = []
        for r, g in zip(own.raw, gone, strict=True):
            kept = np.frombuffer(r, np.uint8)[~g].tobytes() if g.any() else r
            values = {"n_bytes": len(r), "n_removed": int(g.sum()), "n_spans": int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()), "kept": kept}
            if "kept_sha256" in outputs:
                values["kept_sha256"] = hashlib.sha256(kept).hexdigest()
            table.append(tuple(values[o] for o in outputs))
        return pd.DataFrame(table, columns=list(outputs))

    def in_order(pdf: pd.DataFrame) -> list[bytes]:
        return _in_order(pdf, length)

    def sizes(more: bytes) -> np.ndarray:
        """Bytes of each context of a message."""
        least, most, _ = np.frombuffer(more, np.uint8).reshape(-1, 3).astype(np.int64).T
        return most + length - least

    in_order.sizes = sizes
    return x.passes(
        rows, first, second, last,
        {"context": ("<u8", "<u8", "<u4", total), "parse": ("<u4", None, "<u4", total)}, {"context bytes": in_order, "string": ("<u8", "<u8", "u1", repeated)},
        ", ".join(f"{o} {OUTPUTS[o]}" for o in outputs), to,
    )
