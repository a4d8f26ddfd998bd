"""SimHash near-duplicates: fingerprints, pigeonring candidates, connected components.

The fingerprint takes the majority of each bit over the XXH64 hashes of all word
shingles. Two fingerprints link if at most DISTANCE bits differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, joined_by_size, release, stash
from .components import components

SHINGLE = 3
SEED = 42


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(shingle, len(words))
    h, n, ones = xxhash.xxh64_intdigest, len(words) - k + 1, np.zeros(64, np.int64)
    a, b = starts[:n].tolist(), ends[k - 1 :].tolist()
    for at in range(0, n, 1 << 15):
        hashes = np.array([h(joined[i:j], seed) for i, j in zip(a[at : at + (1 << 15)], b[at : at + (1 << 15)], strict=True)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(text: Column, shingle: int = SHINGLE, seed: int = SEED) -> Column:
    """The fingerprint of each text as a signed long with the same 64 bits."""

    @F.pandas_udf("long")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series(np.array([fingerprint(t, shingle, seed) for t in s], np.uint64).view(np.int64))
        release()

    return run(text)


# --- links ----------------------------------------------------------------------------

#: Segments of the ring of 64 bits, for up to 2 differing bits.
SEGMENTS = 5
DISTANCE = 2
#: A bucket above this size is split by the next segment of its chain.
BUCKET = 64


def _segments() -> list[int]:
    """The mask of each segment."""
    bounds = [round(k * 64 / SEGMENTS) for k in range(SEGMENTS + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _budgets() -> list[int]:
    """How many bits the first l segments of a chain may differ in together, for l = 1, 2, ..

    By the pigeonring principle two fingerprints within DISTANCE have a segment from
    which on all these budgets hold, going round the ring.
    """
    return [(l + 1) * DISTANCE // SEGMENTS for l in range(SEGMENTS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keys(level: int) -> Column:
    """The buckets of a fingerprint (column fp) for the chain start in column ``start``: array of (start, free, part).

    Part holds the segments that must be equal and ``level`` more, which may differ in one bit together and stand
    there with bit ``free`` left out. Fingerprints that keep the chain's budgets so far share the bucket that leaves
    out the bit in which they differ.
    """
    segments, equal = _segments(), _budgets().count(0)
    out = None
    for start in range(SEGMENTS):
        fixed = sum(segments[(start + k) % SEGMENTS] for k in range(equal))
        loose = sum(segments[(start + k) % SEGMENTS] for k in range(equal, equal + level))
        bits = [b for b in range(64) if loose >> b & 1] or [-1]
        parts = [(fixed | loose) & ~(1 << b if b >= 0 else 0) for b in bits]
        made = F.array(*[F.struct(F.lit(start).alias("start"), F.lit(b).alias("free"), F.col("fp").bitwiseAND(F.lit(_signed(p))).alias("part")) for b, p in zip(bits, parts, strict=True)])
        out = made if out is None else F.when(F.col("start") == start, made).otherwise(out)
    return out


def _forest(own: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the chain's budgets and thus the full Hamming check let through; compared in strips."""
    segments, budget = _segments(), _budgets()
    f = np.sort(np.asarray(own, np.int64)).view(np.uint64)
    root = list(range(len(f)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    a_links, b_links = [], []
    for at in range(0, len(f), 256):
        x = f[at : at + 256, None] ^ f[None, at:]
        ok, total = np.triu(np.ones(x.shape, bool), 1), np.zeros(x.shape, np.uint8)
        for k, limit in enumerate(budget):
            total += np.bitwise_count(x & np.uint64(segments[(start + k) % SEGMENTS]))
            ok &= total <= limit
        a, b = np.nonzero(ok)
        for i, j in zip((a + at).tolist(), (b + at).tolist(), strict=True):
            p, q = find(i), find(j)
            if p != q:
                root[max(p, q)] = min(p, q)
                a_links.append(i)
                b_links.append(j)
    signed = f.view(np.int64)
    return signed[a_links], signed[b_links]


def _compared(members: Column, start: Column) -> Column:
    @F.pandas_udf("array<struct<a:long,b:long>>")
    def run(members: pd.Series, start: pd.Series) -> pd.Series:
        found = [_forest(m, s) for m, s in zip(members, start, strict=True)]
        return pd.Series([[{"a": int(x), "b": int(y)} for x, y in zip(a, b, strict=True)] for a, b in found], dtype=object)

    return run(members, start)


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (column fp) within DISTANCE, transitively the same classes.

    Buckets hold fingerprints with equal leading segments of one chain start. A bucket of up to
    ``bucket`` fingerprints is compared in place; a larger one is split by the chain's next
    segment, within its budget, and again by the one after. What remains differs in one bit and
    the last segment only, so it holds at most 2 ** 14 fingerprints, compared in strips.
    """
    last, out = _budgets().count(1), None
    chains = distinct.select("fp", F.explode(F.array(*[F.lit(k) for k in range(SEGMENTS)])).alias("start"))
    for level in range(last + 1):
        keyed = stash(chains.select("fp", "start", F.explode(_keys(level)).alias("key")))
        sizes = stash(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
        big = sizes.where(F.lit(level < last) & (F.col("n") > bucket))
        total = keyed.count()
        members = joined_by_size(keyed, sizes.where(F.lit(level == last) | (F.col("n") <= bucket)), "key", "n", total)
        own = members.groupBy("key").agg(F.collect_list("fp").alias("members"))
        near = own.select(F.explode(_compared(F.col("members"), F.col("key.start"))).alias("l")).select("l.a", "l.b")
        out = near if out is None else out.union(near)
        if big.isEmpty():
            break
        chains = joined_by_size(keyed, big, "key", "n", total).select("fp", "start").distinct()
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, carry: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, fp (signed long), component_id (the smallest doc_id reachable by links) and ``carry`` for each row of docs.

    Nulls and texts without words have fingerprint zero and link like any other. Texts are whole,
    however long. A null doc_id keeps its row; a component whose doc_ids are all null has none.
    Repeated rows give repeated rows. An empty table gives an empty table. Other columns of docs are not looked at.
    """
    more = [c.alias(f"carry{k}") for k, c in enumerate(carry)]
    rows = stash(docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprints(F.col(text_col), shingle, seed).alias("fp"), *more))
    distinct = stash(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    root = components(links(distinct.select("fp"))).select(F.col("node").alias("fp"), "component")
    # A component's fingerprints are many, not its rows, so minima are taken before any row is looked at.
    linked = stash(distinct.join(root, "fp"))
    merged = linked.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    of_linked = joined_by_size(linked, merged, "component", "size", linked.count()).select("fp", "component_id", "component", "n")
    of_alone = distinct.join(root, "fp", "left_anti").select("fp", F.col("least").alias("component_id"), F.col("fp").alias("component"), "n")
    of = stash(of_linked.union(of_alone).withColumnRenamed("component", "group"))
    found = joined_by_size(rows, of, "fp", "n", rows.count())
    return found.select("doc_id", "fp", "component_id", *[f"carry{k}" for k in range(len(carry))], *(["group"] if carry else []))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each group of near-duplicates, with all its columns: the smallest doc_id, null last.

    Rows of one doc_id in one group are told apart by 128 hash bits of all columns; of
    fully equal rows one stays. Rows meet the list of those to keep by these bits, so texts are shuffled
    only where that list is too large for a broadcast (its size is known, since it is written first).
    """
    every = [F.col(f"`{c}`") for c in docs.columns]
    k1, k2 = F.xxhash64(*every), F.xxhash64(F.lit(1), *reversed(every))
    rows = stash(near_duplicates(docs, id_col, text_col, carry=(k1, k2)))
    first = rows.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "carry0", "carry1")).alias("r")).select("r.carry0", "r.carry1")
    n1, n2 = free_name(docs, "row_hash1"), free_name(docs, "row_hash2")
    first = first.select(F.col("carry0").alias(n1), F.col("carry1").alias(n2))
    copies = rows.groupBy(F.col("carry0").alias(n1), F.col("carry1").alias(n2)).agg(F.count("*").alias("n"))
    first = stash(first.join(copies, [n1, n2]))
    hashed = docs.withColumn(n1, k1).withColumn(n2, k2)
    kept = hashed.join(first.where("n = 1").select(n1, n2), [n1, n2], "left_semi")
    if not first.where("n > 1").isEmpty():
        # Fully equal rows are made one in their own partition before any shuffle.
        several, total = first.where("n > 1"), rows.count()
        key = free_name(docs, "row_key")
        several = several.select(F.struct(n1, n2).alias(key), F.col("n").alias(f"{key}_n"))
        again = joined_by_size(hashed.withColumn(key, F.struct(n1, n2)), several, key, f"{key}_n", total)
        kept = kept.unionByName(again.drop(key).dropDuplicates([n1, n2]))
    return kept.select(*every)


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
