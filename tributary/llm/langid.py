"""Language identification: the family first, then one-versus-one linear SVMs within it.

A text is a vector of hashed byte trigrams of its lower-cased whole, square roots
of counts at unit length. Linear SVMs (squared hinge, L2) separate each pair of
families; within the winning family, each pair of its languages. Languages absent
from ``FAMILIES`` form the family "other".

Fitting takes at most about ``max_rows`` labelled rows, dealt evenly over the
languages and chosen by a hash of doc_id and text length. Texts that are null or without a letter get
"und" and score 0; long texts are read whole. With no labelled rows, every text gets "und"; with one language, every text
with a letter gets it. An empty table gives an empty table. Rows with a null
language are never learned from; repeated rows are learned as often as they are
sampled and each gets its own prediction.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release

#: Families of common languages.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "pl": "slavic", "cs": "slavic", "uk": "slavic", "bg": "slavic", "sk": "slavic",
}
DIMENSIONS = 2048
MAX_ROWS = 2400
#: Languages learned, the most frequent first; with more names than this the column isn't one of languages.
MAX_LANGS = 120
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def vector(text: str) -> np.ndarray:
    b = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8).astype(np.int32)
    counts = np.zeros(DIMENSIONS)
    for at in range(0, len(b), 1 << 18):  # bounded memory for very long texts
        c = b[at : at + (1 << 18) + 2]
        if len(c) >= 3:
            h = c[:-2] * 40503 + c[1:-1] * 10007 + c[2:] * 2741
            counts += np.bincount((h ^ (h >> 11)) & (DIMENSIONS - 1), minlength=DIMENSIONS)
    v = np.sqrt(counts)
    return (v / max(np.linalg.norm(v), 1e-12)).astype(np.float32)


def _svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 200) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM, by accelerated gradient descent; classes weigh alike."""
    y = y.astype(np.float32)
    weight = (np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)) * c).astype(np.float32)
    rate = np.float32(1.0 / (1e-3 + 4.4 * c))  # rows have unit length, and the bias adds as much
    w = v = np.zeros(x.shape[1] + 1, np.float32)
    last = 1.0
    for _ in range(steps):
        pull = 2 * weight * y * np.maximum(0, 1 - y * (x @ v[:-1] + v[-1]))
        new = v - rate * (np.float32(1e-3) * v - np.append(pull @ x, pull.sum()))
        t = (1 + np.sqrt(1 + 4 * last * last)) / 2
        v, w, last = (new + np.float32((last - 1) / t) * (new - w)).astype(np.float32), new, t
    return w[:-1].copy(), float(w[-1])


class Model:
    """Families, languages and the separators between pairs of either."""

    def __init__(self, x: np.ndarray, langs: list[str], families: dict[str, str]):
        family = np.array([families.get(g, "other") for g in langs], dtype=object)
        lang = np.array(langs, dtype=object)
        self.members = {f: sorted(set(lang[family == f])) for f in sorted(set(family))}
        self.separators: dict[tuple[str, str, str], tuple[np.ndarray, float]] = {}
        self._fit("", list(self.members), family, x)
        for f, own in self.members.items():
            self._fit(f, own, lang, x)

    def _fit(self, level: str, names: list[str], of: np.ndarray, x: np.ndarray) -> None:
        for a, b in itertools.combinations(names, 2):
            rows = (of == a) | (of == b)
            self.separators[level, a, b] = _svm(x[rows], np.where(of[rows] == a, 1.0, -1.0))

    def _choose(self, level: str, names: list[str], v: np.ndarray) -> tuple[str, float]:
        """The name with most wins (then the largest margins), and how sure its least sure win is."""
        wins, margins, least = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), dict.fromkeys(names, 50.0)
        for a, b in itertools.combinations(names, 2):
            w, bias = self.separators[level, a, b]
            m = float(v @ w) + bias
            wins[a if m >= 0 else b] += 1
            for name, own in ((a, m), (b, -m)):
                margins[name] += own
                least[name] = min(least[name], own)
        best = max(names, key=lambda n: (wins[n], margins[n]))
        return best, 1 / (1 + float(np.exp(-4 * np.clip(least[best], -50, 50))))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.members or text is None or not _LETTER.search(text):
            return UNKNOWN, 0.0
        v = vector(text)
        family, p = self._choose("", list(self.members), v)
        lang, q = self._choose(family, self.members[family], v)
        return lang, p * q


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_ROWS, max_langs: int = MAX_LANGS, families: dict[str, str] = FAMILIES) -> Model:
    """Learns from rows with text and language; about max_rows of them, 20 at least for each of up to max_langs languages."""
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(F.col(lang_col).alias("lang")).count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()}
    if not counts:
        return Model(np.zeros((0, DIMENSIONS)), [], families)
    each = max(20, max_rows // len(counts))
    shares = F.create_map(*[F.lit(x) for g, n in counts.items() for x in (g, each / n)])
    # Copies of one row share a hash; the text's length sets other rows of the same id apart.
    draw = F.pmod(F.xxhash64(F.col(id_col), F.length(text_col)), F.lit(1_000_000)) / 1e6

    @F.pandas_udf("binary")
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([vector(t).astype("<f2").tobytes() for t in s], dtype=object)
        release()

    sample = rows.where(draw < shares[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), vectors(F.col(text_col)).alias("v")).collect()
    x = np.frombuffer(b"".join([r["v"] for r in sample]), "<f2").astype(np.float32).reshape(-1, DIMENSIONS)
    return Model(x, [r["lang"] for r in sample], families)


def language(text: Column, model: Model) -> Column:
    """struct<lang_pred, score> of each text."""

    @F.pandas_udf("lang_pred string, score double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            yield pd.DataFrame([model.predict(t) for t in s], columns=["lang_pred", "score"])
        release()

    return run(text)
