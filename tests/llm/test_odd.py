"""Very long texts, nulls, repeated rows and columns whose names the operators use themselves."""

import random

import brute
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tributary.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tributary.llm import bpe, decontaminate, langid, pii, repeats, simhash, substring, toxicity  # noqa: E402
from tributary.llm import quality as q  # noqa: E402
from tributary.llm.queries import tokenizer_path  # noqa: E402

NAMES = ["fp", "component_id", "group", "least", "n", "block", "hits_more", "n_words", "score", "stats", "label", "row_hash1", "row_key", "text_key", "language", "carry0", "no_id"]


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgé") for _ in range(r.randint(2, 7))) for _ in range(5000)]
    say = lambda k: " ".join(r.choice(words) for _ in range(k))
    long = say(350_000)
    rows = [(1, long), (2, None), (3, ""), (3, ""), (None, say(40)), (5, long[1000:1400]), (6, say(30)), (6, "other " + say(30)), (7, "x" * 300_000), (8, say(40))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in NAMES:
        df = df.withColumn(name, F.lit("own"))
    return df.cache(), rows


def same(got, want):
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_repeats_and_substrings(docs):
    df, rows = docs
    got = {r["doc_id"]: r for r in repeats.remove_repeats(df, outputs=("n_bytes", "n_removed", "n_spans", "kept")).collect()}
    assert got[1]["n_removed"] >= 400 - 8 and got[5]["n_removed"] == got[5]["n_bytes"] and got[7]["n_removed"] == 300_000 and got[6]["n_removed"] == 0
    same(substring.dedup(df, outputs=("n_words", "n_removed", "kept_sha256")).collect(), brute.substring(rows, 13))


def test_simhash(docs):
    df, rows = docs
    fps = [(i, brute.simhash(t)) for i, t in rows]
    least = brute.components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    same(simhash.near_duplicates(df).select("doc_id", simhash.hexed(F.col("fp")), "component_id").collect(), [(i, f"{fp:016x}", c) for (i, fp), (_, c) in zip(fps, least, strict=True)])
    kept = simhash.representatives(df)
    assert kept.columns == df.columns and kept.count() == 8  # the two texts of document 6 aren't alike; the null text and both empty ones are


def test_decontaminate(docs):
    df, rows = docs
    items = [(1, rows[0][1][5000:5200]), (2, None), (3, "zz")]
    found = decontaminate.hits(df, df.sparkSession.createDataFrame(items, "item_id long, text string"), into="found", item_bytes=150)
    h = F.col("found")
    assert set(df.columns) < set(found.columns)
    same(found.select("doc_id", h["n_words"], decontaminate.n_hit(h), F.size(h["items"]), decontaminate.items_digest(h), decontaminate.n_hit(h) > 0).collect(), expected(rows, items))
    with pytest.raises(ValueError):
        decontaminate.hits(df, df, into="STATS")


def expected(rows, items):
    """The long text is searched by its own known place, the others by brute force."""
    short = [(i, t) for i, t in rows if t is None or len(t) < 100_000]
    out = brute.contamination(short, items, 10)
    import re

    own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", items[0][1])
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", rows[0][1])
    windows = {tuple(own[k : k + 10]) for k in range(len(own) - 9)}
    hit = set()
    for k in range(len(words) - 9):
        if tuple(words[k : k + 10]) in windows:
            hit |= set(range(k, k + 10))
    out.append((1, len(words), len(hit), 1, brute.sha(b"1"), True))
    return [*out, (7, 1, 0, 0, brute.sha(b""), False)]


def test_texts_one_by_one(docs):
    from tokenizers import Tokenizer

    df, rows = docs
    t = Tokenizer.from_file(tokenizer_path())
    got = bpe.encode(df, tokenizer_path(), outputs=("n_tokens", "ids_sha256", "decoded_sha256"), into="tokens", spread=200_000).select("doc_id", "tokens.*").collect()
    import numpy as np

    want = []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha(t.decode(ids, skip_special_tokens=False).encode())))
    same(got, want)
    model = langid.fit(df.withColumn("lang", F.when(F.col("doc_id") < 6, "aa").otherwise("bb")))
    out = df.select("doc_id", "text", langid.language(F.col("text"), model).alias("p"), pii.pii_redacted(F.col("text")).alias("r"), q.stats_column(F.col("text")).alias("s")).collect()
    assert len(out) == len(rows) and all((r["p"]["lang_pred"] == "und") == (not r["text"]) and len(r["s"]) == 24 for r in out)
    labels = df.sparkSession.createDataFrame([(1, 1.0), (6, 0.0), (5, 1.0), (8, 0.0)], "doc_id long, label double")
    c = toxicity.fit(df, labels)
    assert all(0 <= r[0] <= 1 for r in df.select(toxicity.toxicity(F.col("text"), c)).collect())


def test_pipeline_stages_keep_columns(docs, spark):
    df, _ = docs
    df = df.withColumn("lang", F.lit("en")).withColumn("source", F.lit("s"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, "/root/testdata/sf0.001")
        assert out.columns == df.columns and out.count() > 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, df, "/root/testdata/sf0.001").count() == df.count()
