"""Quality scores: ridge on random Fourier features of document statistics, calibrated by isotonic regression.

Statistics describe the whole text (lengths, character classes, repetition of
words and lines). cos(Wx + b) with Gaussian W approximates a Gaussian kernel;
the normal equations are summed per partition and then per row of the matrix,
so the driver holds one matrix of fixed size. A third of the labelled rows,
chosen by a hash, is kept from the ridge and calibrates its scores.

Null counts as an empty text, which has all-zero statistics and gets a score like
any other. Several labels of one doc_id count as their mean. Labels that are null
are dropped; without labels of both classes every score is the share of label 1,
or 0.5 if there are none. Long texts are read whole. Repeated rows get equal scores; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = 256
RIDGE = 1e-3
BINS = 2000
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_STATS = 24


def statistics(text: str | None) -> np.ndarray:
    """What describes a whole text, in bounded numbers."""
    out = np.zeros(_STATS)
    if not text:
        return out
    raw = text.encode("utf-8", "replace")
    n = len(raw)
    hist = np.zeros(256, np.int64)
    b = np.frombuffer(raw, np.uint8)
    for at in range(0, n, 1 << 20):
        hist += np.bincount(b[at : at + (1 << 20)], minlength=256)
    words = raw.split()
    m = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    counts = Counter(words)
    pairs = Counter(zip(words, words[1:], strict=False)) if m > 1 else {}
    upper, lower, digit = hist[65:91].sum(), hist[97:123].sum(), hist[48:58].sum()
    punct = hist[33:48].sum() + hist[58:65].sum() + hist[91:97].sum() + hist[123:127].sum()
    w = max(m, 1)
    share = lambda chars: hist[list(chars)].sum() / w
    capital = sum(map(bytes.istitle, counts)) / max(len(counts), 1)
    values = (
        np.log1p(n), np.log1p(m), n / w / 10, upper / n, lower / n, digit / n, punct / n, hist[128:].sum() / n,
        share(b"!"), share(b"|"), share(b"#$%&*@^~<>{}[]=\\_"), share(b".?"), share(b",;:"), share(b"\n"), share(b"/-+"), share(b"\"'()"),
        len(counts) / w, max(counts.values(), default=0) / w, len(pairs) / max(m - 1, 1), sum(map(bytes.__eq__, words, words[1:])) / w,
        len(set(lines)) / max(len(lines), 1), np.log1p(m / max(len(lines), 1)), capital, float(hist.max()) / n,
    )
    out[: len(values)] = values
    return out


def stats_column(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([statistics(t) for t in s], dtype=object)

    return run(text)


class Scorer:
    """Statistics -> standardised -> Fourier features -> ridge -> isotonic steps."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, prior: float, seed: int = 7):
        self.mean, self.deviation, self.prior = mean, deviation, prior
        rng = np.random.default_rng(seed)
        self.w = rng.normal(size=(len(mean), FEATURES)) / np.sqrt(len(mean))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)
        self.beta: np.ndarray | None = None
        self.steps: tuple[np.ndarray, np.ndarray] | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -5, 5)
        return np.hstack([np.cos(z @ self.w + self.b) * np.sqrt(2 / FEATURES), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.beta is None or self.steps is None:
            return np.full(len(x), self.prior)
        return np.clip(np.interp(self.raw(x), *self.steps), 0, 1)


def isotonic(at: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The nondecreasing fit to means at sorted places, by pooling adjacent violators."""
    pools: list[list[float]] = []
    for m, w in zip(mean, weight, strict=True):
        pools.append([m, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            total = a[1] + b[1]
            pools.append([(a[0] * a[1] + b[0] * b[1]) / total, total, a[2] + b[2]])
    return np.repeat([p[0] for p in pools], [int(p[2]) for p in pools])


def fit(labelled: DataFrame) -> Scorer:
    """labelled: doc_id, stats array<double>, label double."""
    size = _STATS
    moments = labelled.select("label", F.posexplode("stats").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.avg("label").alias("p"), F.min("label").alias("lo"), F.max("label").alias("hi")).collect()
    mean, deviation, prior = np.zeros(size), np.ones(size), 0.5
    for r in moments:
        mean[r["k"]], deviation[r["k"]], prior = r["m"], max(r["s"], 1e-6), r["p"]
    scorer = Scorer(mean, deviation, float(prior))
    if not moments or (moments[0]["lo"] >= 0.5) == (moments[0]["hi"] >= 0.5):
        return scorer
    part = F.pmod(F.xxhash64("doc_id"), F.lit(3))

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for pdf in parts:
            if len(pdf):
                f = scorer.features(np.vstack(list(pdf["stats"])))
                total += f.T @ np.hstack([f, pdf["label"].to_numpy(float)[:, None]])
        yield pd.DataFrame({"row": range(len(total)), "v": list(total)})

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"row": [key[0]], "v": [np.sum(np.vstack(list(pdf["v"])), axis=0)]})

    # Rows of partitions' matrices are summed in two steps, so no task holds a row of every partition.
    sent = labelled.where(part != 0).select("stats", "label").mapInPandas(sums, "row int, v array<double>").withColumn("part", F.spark_partition_id() % 64)
    some = sent.groupBy("row", "part").applyInPandas(add, "row int, v array<double>")
    rows = some.groupBy("row").applyInPandas(add, "row int, v array<double>").collect()
    normal = np.zeros((FEATURES + 1, FEATURES + 2))
    for r in rows:
        normal[r["row"]] = r["v"]
    n = max(normal[-1, -2], 1)  # the last feature is 1, so its square counts the rows
    scorer.beta = np.linalg.solve(normal[:, :-1] + RIDGE * n / FEATURES * np.eye(FEATURES + 1), normal[:, -1])

    @F.pandas_udf("double")
    def raw(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series(scorer.raw(np.vstack(list(s))) if len(s) else np.zeros(0))

    # Scores fall into bins of fixed number, so what comes to the driver is bounded.
    bins = labelled.where(part == 0).select(F.floor(F.least(F.greatest(raw("stats"), F.lit(-1.0)), F.lit(2.0)) * BINS / 3).alias("bin"), "label").groupBy("bin").agg(F.avg("label").alias("m"), F.count("*").alias("n")).orderBy("bin").collect()
    if bins:
        at = (np.array([r["bin"] for r in bins]) + 0.5) * 3 / BINS
        scorer.steps = at, isotonic(at, np.array([r["m"] for r in bins]), np.array([r["n"] for r in bins]))
    return scorer


def labels_of(labels: DataFrame, label_col: str, keep: Column, id_col: str = "doc_id") -> DataFrame:
    """doc_id, label: one row for each id that the fold ``keep`` allows."""
    own = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & keep)
    return own.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.avg(F.col(label_col).cast("double")).alias("label"))


def quality(stats: Column, scorer: Scorer) -> Column:
    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series(scorer.score(np.vstack(list(s))) if len(s) else np.zeros(0))

    return run(stats)
