"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier on its posteriors.

1. Voters. Fixed ones know insults, abuse, threats and patterns of address, shouting and emphasis, whatever the labels
   say. Mined ones: terms (whole words and word beginnings of 4 and 5 letters) are counted in toxic
   and other labelled texts; those that speak clearly for toxicity are dealt over voters by kind and hash. Each says
   "toxic" where one of its terms occurs and abstains elsewhere; three more voters say "clean" where
   no fixed voter, no mined word and no mined beginning speaks. A text's label is one more voter.
2. The label model is a tree of voters under a hidden class: each voter's chances given the class and the voter that it
   depends on most. Accuracies, the pairs that depend on each other and how much are estimated together by expectation
   maximisation, which starts from the votes.
3. A logistic classifier over the terms, mined and fixed, is trained on the posterior labels.

Fitting takes at most about ``max_rows`` labelled documents, chosen by a hash of doc_id. Among
them texts count once for each group of near copies (equal least hash of three-word shingles), with the mean of their
labels, so a group of copies doesn't outvote other texts. The lexicon holds every term that is frequent and clear
enough; the sample alone bounds it. Null counts as an empty text, which has no terms and gets the
classifier's bias; long texts are read whole. Several labels of one doc_id count as their mean. Without toxic labels every
score is 0, without others it is nearly 1. Repeated rows get equal scores; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ROWS = 20_000
#: In how many different toxic texts a term must be.
MIN_DOCS = 4
#: How many times likelier a term must be in toxic texts.
MIN_RATIO = 12.0
VOTERS = 8
_WORD = re.compile(r"\w+")
#: What the voters that owe nothing to labels look for.
INSULTS = ("idiot", "idiots", "moron", "morons", "imbecile", "fool", "fools", "loser", "losers", "jerk", "clown", "dumb", "dumbass", "stupid", "pathetic", "bastard", "bitch", "asshole", "scum", "vermin")
ABUSE = ("trash", "garbage", "filth", "filthy", "worthless", "useless", "disgusting", "vile", "crap", "shit", "fuck", "fucking", "damn", "hell", "ugly", "rotten")
THREATS = ("kill", "die", "hurt", "destroy", "beat", "smash", "burn", "hang", "shoot", "hate", "hates", "despise", "suffer", "regret")
_PATTERNS = (
    re.compile(r"\b(?:you|your|u)\b[^.!?\n]{0,20}\b(?:" + "|".join(INSULTS + ABUSE) + r")\b"),
    re.compile(r"\b(?:shut up|go away|get lost|drop dead|nobody (?:likes|wants|asked)|i hate|hate you)\b"),
    re.compile(r"!{3,}|\b[a-z]\*{2,}[a-z]?"),
)


def terms_of_word(word: str) -> tuple[str, ...]:
    """w:word, 4:begi, 5:begin - the kinds keep voters apart."""
    out = [f"w:{word}"]
    if len(word) > 4:
        out.append(f"4:{word[:4]}")
    if len(word) > 5:
        out.append(f"5:{word[:5]}")
    return tuple(out)


def terms(text: str | None) -> set[str]:
    return {t for w in set(_WORD.findall((text or "").lower())) for t in terms_of_word(w)}


_FIXED_TERMS = tuple(frozenset(words) for words in (INSULTS, ABUSE, THREATS))


def fixed_votes(text: str | None) -> list[int]:
    """1 for each voter without labels that speaks: the three lexicons, the patterns, and shouting."""
    lower = (text or "").lower()
    words = set(_WORD.findall(lower))
    shouted = sum(w.isupper() and len(w) > 3 for w in set(_WORD.findall(text or "")))
    return [int(bool(words & t)) for t in _FIXED_TERMS] + [int(bool(p.search(lower))) for p in _PATTERNS] + [int(shouted > 5 and 4 * shouted > len(words))]


def near_key(text: str | None) -> str:
    """Equal for equal texts, and mostly for near copies: the least hash of three-word shingles, or the short text itself."""
    import xxhash

    words = (text or "").lower().encode("utf-8", "replace").split()
    if len(words) < 8:
        return " ".join(w.decode() for w in words)
    return str(min(xxhash.xxh64_intdigest(b" ".join(words[k : k + 3])) for k in range(len(words) - 2)))


class Classifier:
    """A logistic function of a bias and the weights of the terms that occur."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.cache: dict[str, tuple[str, ...]] = {}

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "cache": {}}

    def score(self, text: str | None) -> float:
        if self.bias == -np.inf:
            return 0.0
        cache, hits = self.cache, set()
        if len(cache) > 300_000:
            cache.clear()
        for w in set(_WORD.findall((text or "").lower())):
            own = cache.get(w)
            if own is None:
                own = cache[w] = tuple(t for t in terms_of_word(w) if t in self.weights)
            if own:
                hits.update(own)
        z = self.bias + sum(self.weights[t] for t in sorted(hits))
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def _tree(joint: np.ndarray, least: float) -> list[tuple[int, int]]:
    """(voter, the voter it depends on or -1): the tree of most mutual information given the class; weaker ties than ``least`` are left out.

    joint: class, voter, vote, voter, vote.
    """
    each = np.einsum("cvava->cva", joint)
    prior = each[:, 0].sum(axis=1)
    expected = each[:, :, :, None, None] * each[:, None, None, :, :] / prior[:, None, None, None, None]
    shared = (joint * np.log(joint / expected)).sum(axis=(0, 2, 4))
    n, out, inside = len(shared), [(0, -1)], [0]
    while len(inside) < n:
        rest = [k for k in range(n) if k not in inside]
        ties = shared[np.ix_(rest, inside)]
        i, j = np.unravel_index(ties.argmax(), ties.shape)
        out.append((rest[i], inside[j] if ties[i, j] > least else -1))
        inside.append(rest[i])
    return out


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Posterior chances of class 1. votes: rows by voters of 1, -1 and 0 (abstains); start: first chances."""
    n, voters = votes.shape
    code = votes + 1
    hit = np.zeros((n, voters, 3), np.float32)
    np.put_along_axis(hit, code[:, :, None], 1, axis=2)
    flat = hit.reshape(n, -1)
    p = np.clip(start, 0.02, 0.98)
    for _ in range(rounds):
        # While the classes are vague, all voters seem to depend on each other.
        ties = 0.005 if np.maximum(p, 1 - p).mean() > 0.85 else np.inf
        joint = np.stack([(flat * q[:, None].astype(np.float32)).T @ flat for q in (1 - p, p)]).astype(float).reshape(2, voters, 3, voters, 3)
        joint = joint / n + 0.1 / n  # no chance is zero
        for k in range(voters):  # a voter agrees with itself
            own = np.einsum("cab->ca", joint[:, k, :, k, :]) - 0.2 / n
            joint[:, k, :, k, :] = np.maximum(own, 1e-12)[:, :, None] * np.eye(3) + 1e-15
        gain = np.full(n, np.log(p.mean() / (1 - p.mean())))
        for k, parent in _tree(joint, ties):
            if parent < 0:
                chance = np.einsum("cvava->cva", joint)[:, k]
                chance = chance / chance.sum(axis=1, keepdims=True)
                like = np.log(chance[1] / chance[0])[code[:, k]]
            else:
                chance = joint[:, k, :, parent, :]
                chance = chance / chance.sum(axis=1, keepdims=True)
                like = np.log(chance[1] / chance[0])[code[:, k], code[:, parent]]
            gain += like
        new = 1 / (1 + np.exp(-np.clip(gain, -30, 30)))
        done = np.abs(new - p).max() < 1e-4
        p = np.clip(new, 1e-6, 1 - 1e-6)
        if done:
            break
    return p


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, text_col: str = "text", id_col: str = "doc_id") -> Classifier:
    """labels: doc_id, label double, one row for each id."""
    none = Classifier({}, -np.inf)
    n = labels.count()
    if not n:
        return none

    @F.pandas_udf("string")
    def near(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([near_key(t) for t in s], dtype=object)

    own = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1e6 < max_rows / n)  # about max_rows rows, so small
    sample = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(own), "doc_id")
        .groupBy("doc_id").agg(F.max("text").alias("text"), F.max("label").alias("label"))
        .groupBy(near("text").alias("key")).agg(F.max("text").alias("text"), F.avg("label").alias("label"))
    )

    def doc_terms(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Counts of terms, summed within the task."""
        hot, cold, nh, nc = Counter(), Counter(), 0, 0
        for pdf in parts:
            for text, label in zip(pdf["text"], pdf["label"], strict=True):
                (hot if label >= 0.5 else cold).update(terms(text))
                nh, nc = nh + (label >= 0.5), nc + (label < 0.5)
        hot[""], cold[""] = nh, nc
        keys = list(hot.keys() | cold.keys())
        yield pd.DataFrame({"term": keys, "hot": [hot[k] for k in keys], "cold": [cold[k] for k in keys]})

    counts = sample.select("text", "label").mapInPandas(doc_terms, "term string, hot long, cold long").groupBy("term").agg(F.sum("hot").alias("hot"), F.sum("cold").alias("cold"))
    sizes = counts.where("term = ''").first()
    if not sizes or not sizes["hot"] or not sizes["cold"]:
        return none if not sizes or not sizes["hot"] else Classifier({}, 50.0)
    ratio = ((F.col("hot") + 0.0) / sizes["hot"]) / ((F.col("cold") + 0.5) / sizes["cold"])
    chosen = counts.where((F.col("term") != "") & (F.col("hot") >= MIN_DOCS) & (ratio >= MIN_RATIO)).select("term").toPandas()
    mined = set(chosen["term"])
    lexicon = sorted(mined | {f"w:{w}" for t in _FIXED_TERMS for w in t})
    index = {t: k for k, t in enumerate(lexicon)}

    @F.pandas_udf("found array<int>, fixed array<int>")
    def voted(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            yield pd.DataFrame([(sorted(index[t] for t in terms(x) if t in index), fixed_votes(x)) for x in s], columns=["found", "fixed"])

    rows = sample.select(voted("text").alias("v"), "label").select("v.*", "label").toPandas()
    label = rows["label"].to_numpy(float)
    voter = np.array([((0 if t[0] == "w" else VOTERS) + zlib.crc32(t.encode()) % VOTERS) if t in mined else 2 * VOTERS for t in lexicon])
    votes = np.zeros((len(rows), 2 * VOTERS + 1), int)
    for k, f in enumerate(rows["found"]):
        votes[k, voter[f]] = 1
    groups = [np.array(rows["fixed"].tolist(), int), votes[:, :VOTERS], votes[:, VOTERS : 2 * VOTERS]]
    clean = [np.where(v.any(axis=1), 0, -1) for v in groups]
    ballot = np.column_stack([*groups, *clean, np.where(label >= 0.5, 1, -1)])
    ballot = ballot[:, (ballot != 0).any(axis=0)]  # voters that never speak tell nothing
    start = 1 / (1 + np.exp(-ballot.sum(axis=1)))
    return _logistic(Sparse(rows["found"], len(lexicon)), label_model(ballot, start), lexicon)


class Sparse:
    """Rows of ones at given columns, and zeros: 4 bytes for each term that occurs, taken up in chunks of rows."""

    def __init__(self, found: pd.Series, n_cols: int, chunk: int = 1 << 20):
        self.sizes = np.array([len(f) for f in found], np.int64)
        self.shape = (len(self.sizes), n_cols)
        self.col = np.concatenate([np.zeros(0, np.int32), *found]).astype(np.int32, copy=False)
        self.start = np.concatenate([[0], np.cumsum(self.sizes)])
        cuts = np.searchsorted(self.start, np.arange(0, len(self.col) + chunk, chunk))
        self.cuts = np.unique(np.concatenate([[0], np.minimum(cuts, self.shape[0]), [self.shape[0]]]))

    def chunks(self) -> Iterator[tuple[slice, np.ndarray]]:
        """Rows, and the columns of their ones."""
        for i, j in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            yield slice(i, j), self.col[self.start[i] : self.start[j]]

    def times(self, v: np.ndarray) -> np.ndarray:
        out = np.zeros(self.shape[0])
        for rows, col in self.chunks():
            at = self.start[rows.start : rows.stop + 1] - self.start[rows.start]
            out[rows] = np.diff(np.concatenate([[0.0], np.cumsum(v[col])])[at])
        return out

    def transposed_times(self, v: np.ndarray) -> np.ndarray:
        out = np.zeros(self.shape[1])
        for rows, col in self.chunks():
            out += np.bincount(col, np.repeat(v[rows], self.sizes[rows]), self.shape[1])
        return out


def _logistic(x: Sparse, y: np.ndarray, lexicon: list[str], steps: int = 300) -> Classifier:
    w, b, n = np.zeros(x.shape[1]), 0.0, x.shape[0]
    vw, vb, last = w, b, 1.0
    # A step for each term from a bound of the curvature, so one long text slows only its own terms.
    size = x.sizes + 1.0
    rate_w, rate_b = 1 / (x.transposed_times(size) / (4 * n) + 5e-5), 4 * n / size.sum()
    for _ in range(steps):
        g = 1 / (1 + np.exp(-np.clip(x.times(vw) + vb, -50, 50))) - y
        nw, nb = vw - rate_w * (x.transposed_times(g) / n + 5e-5 * vw), vb - rate_b * g.mean()
        t = (1 + np.sqrt(1 + 4 * last * last)) / 2
        vw, vb = nw + (last - 1) / t * (nw - w), nb + (last - 1) / t * (nb - b)
        w, b, last = nw, nb, t
    return Classifier(dict(zip(lexicon, map(float, w), strict=True)), float(b))


def toxicity(text: Column, classifier: Classifier) -> Column:
    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([classifier.score(t) for t in s], dtype=float)

    return run(text)
