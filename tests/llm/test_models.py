"""Operators with models or parsers: exactness against libraries and brute force, held-out accuracy, odd rows."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tributary.llm")
from tributary.llm import bpe, embeddings, langid, pii, toxicity  # noqa: E402
from tributary.llm import quality as q  # noqa: E402
from tributary.llm.queries import tokenizer_path  # noqa: E402

SF = "/root/testdata/sf0.01"
ODD = [(1, None, "x"), (2, "", "x"), (None, "Hello World", None), (1, "Hello World", "x"), (1, "Hello World", "x"), (3, "\t \n", "x"), (4, "ab" * 5000, "x"), (5, "é́ ŐÝ <|endoftext|>x's 12.5", "x"), (6, "123 456", "x"), (7, "some words, and more of them " * 90, "x")]
SCHEMA = "doc_id long, text string, LANG_PRED string"


def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_bpe_trees_equal_the_library():
    t, e, r = reference(), bpe.Encoder(tokenizer_path(), leaf=32), random.Random(4)
    for k in range(300):
        letters = r.choice(["ab", "aeinrst", "ab'1!é", "你好aß", "thein<|endoftext|>", "the ine ", "e\u0301 a\t\n", "a\u00a0\u2003\x1c b"])
        text = "".join(r.choice(letters) for _ in range(r.choice([5, 40, 400, 1500])))
        ids, decoded, joins = e.encode_bytes(text + (" tail" if k % 2 else ""))
        assert (joins > 0) == (len(text) + 5 * (k % 2) > 32)
        want = t.encode(text + (" tail" if k % 2 else ""), add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want and decoded.decode() == t.decode(want, skip_special_tokens=False)


def test_bpe_on_rows_and_spread_leaves(spark):
    t = reference()
    for spread in (1 << 16, 300, 100):
        out = bpe.encode(odd(spark), tokenizer_path(), outputs=("n_tokens", "ids", "decoded", "n_joins"), leaf=64, spread=spread)
        assert out.columns == ["doc_id", "text", "LANG_PRED", "bpe"]
        for r in out.collect():
            want = t.encode(r["text"] or "", add_special_tokens=False).ids
            assert r["bpe"]["n_joins"] == max(-(-len(r["text"] or "") // 64) - 1, 0)
            assert (r["bpe"]["ids"], r["bpe"]["n_tokens"], r["bpe"]["decoded"]) == (want, len(want), t.decode(want, skip_special_tokens=False))
    again = out.select("bpe.decoded", bpe.decoded(F.col("bpe.ids"), tokenizer_path()).alias("d")).collect()
    assert all(r[0] == r[1] for r in again) and len(again) == len(ODD)


def plain_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.BASE.index(s[0])))


def test_pii_base_spans_equal_the_patterns():
    f, r = pii.Finder(), random.Random(2)
    for letters in ("a1.@-+ b", "12. 3-+@(", "0123456789 -", "+1 (23).-4@a.", "@a.é1%İ"):
        for _ in range(4000):
            t = "".join(r.choice(letters) for _ in range(r.choice([5, 20, 60])))
            assert [s for s in f.spans(t) if s[0] in pii.BASE] == plain_spans(t), t


def test_pii_more_kinds_and_redaction(spark):
    t = "SSN: 123-45-6789, pay GB82 WEST 1234 5698 7654 32 or http://bob:secret@host/x; mail a.b@c.org"
    spans = pii.finder().spans(t)
    assert [t[a:b] for _, a, b in spans if t[a:b]] and {k for k, _, _ in spans} == {"account", "iban", "login", "email"} or {"account", "iban", "login"} <= {k for k, _, _ in spans}
    assert "6789" not in pii.redact(t, spans) and "secret" not in pii.redact(t, spans) and pii.redact("plain text", []) == "plain text"
    assert [r[0] for r in odd(spark).select(pii.pii_redacted(F.col("text"))).collect()] == [t for _, t, _ in ODD]
    assert odd(spark).select(pii.pii_digest(F.col("text")).alias("p")).count() == len(ODD)
    t = "I live at 221B Baker Street, London or 12 N. Oak Avenue, Apt 4, Springfield, IL 62704; Hauptstraße 5, rue de Rivoli 10. In 12 days the street is 5 km. token = \"04dbebab91ab85\" http://u%s:p@h/" % ("x" * 400)
    assert [(k, t[a:b]) for k, a, b in pii.finder().spans(t)] == [("address", "221B Baker Street, London"), ("address", "12 N. Oak Avenue, Apt 4, Springfield, IL 62704"), ("address", "Hauptstraße 5"), ("address", "rue de Rivoli 10"), ("secret", "04dbebab91ab85"), ("login", "u" + "x" * 400 + ":p")]
    assert [k for k, _, _ in pii.finder().spans("GB82 WEST 1234 5698 7654 32 and GB82WEST12345698765433 and xGB82WEST12345698765432")] == ["iban"]
    for cue in ("http://", "@", "+1", ".1", "1 ", "gb8", "GB8", "token=", "1 A street ", "rue A "):
        assert isinstance(pii.finder().spans(cue * 50_000), list)
    assert pii.finder().spans("a" * 200_000) == [] and pii.finder().spans("1." * 100_000) == [("ip", *s) for s in [m.span() for m in re.finditer(r"\d+\.\d+\.\d+\.\d+", "1." * 100_000)]]


def test_language_held_out_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    model = langid.fit(docs.where(fold != 2))
    own = docs.where(fold == 2).select("lang", langid.language(F.col("text"), model).alias("p")).select("lang", "p.*").toPandas()
    assert (own["lang"] == own["lang_pred"]).mean() > 0.98 and own["score"].between(0, 1).all()
    got = odd(spark).select("text", langid.language(F.col("text"), model).alias("p")).collect()
    assert all((r["p"]["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", r["text"] or "")) for r in got)
    empty = langid.fit(docs.where("false"))
    assert empty.predict("hello") == ("und", 0.0)


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    stats = docs.select("doc_id", q.stats_column(F.col("text")).alias("stats"))
    scorer = q.fit(stats.join(q.labels_of(labels, "quality", fold != 1), "doc_id"))
    own = stats.where(fold == 1).join(labels, "doc_id").select("quality", q.quality(F.col("stats"), scorer).alias("s")).toPandas()
    assert ((own["s"] >= 0.5) == own["quality"]).mean() > 0.95
    assert all(0 <= r[0] <= 1 for r in odd(spark).select(q.quality(q.stats_column(F.col("text")), scorer)).collect())
    none = q.fit(stats.join(q.labels_of(labels.where("false"), "quality", fold != 1), "doc_id"))
    assert none.score(np.zeros((2, 24))).tolist() == [0.5, 0.5]


def test_isotonic_is_nondecreasing_and_keeps_the_mean():
    r = np.random.default_rng(1)
    m, w = r.random(50), r.integers(1, 9, 50)
    fit = q.isotonic(np.arange(50), m, w)
    assert (np.diff(fit) >= 0).all() and abs((fit * w).sum() - (m * w).sum()) < 1e-9


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    c = toxicity.fit(docs, q.labels_of(labels, "toxic", fold != 0))
    own = docs.where(fold == 0).join(labels, "doc_id").select("toxic", toxicity.toxicity(F.col("text"), c).alias("s")).toPandas()
    assert ((own["s"] >= 0.5) == own["toxic"]).mean() > 0.95
    assert all(0 <= r[0] <= 1 for r in odd(spark).select(toxicity.toxicity(F.col("text"), c)).collect())
    assert toxicity.fit(docs, q.labels_of(labels.where("false"), "toxic", fold != 0)).score("x") == 0.0


def test_toxicity_lexicon_is_whole_beside_a_group_of_copies(spark):
    long = " ".join(f"zq{k:05d}x" for k in range(5000))
    rows = [(k, long, 1.0) for k in range(60)]
    rows += [(100 + k, f"you moron number{k}", 1.0) for k in range(20)] + [(200 + k, f"a fine day number{k}", 0.0) for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label double")
    c = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "label"))
    assert "w:moron" in c.weights and "w:zq00001x" not in c.weights
    near = [(k, t if k > 99 else f"{t} only{k}", y) for k, t, y in rows]  # 60 near copies
    df = spark.createDataFrame(near, "doc_id long, text string, label double")
    c = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "label"))
    assert "w:moron" in c.weights and "w:zq00001x" not in c.weights
    shuffled = lambda k: " ".join(random.Random(k).sample(long.split(), 5000))
    rows = [(k, t if k > 99 else shuffled(k), y) for k, t, y in rows]  # 60 different texts with the same 5000 words
    df = spark.createDataFrame(rows, "doc_id long, text string, label double")
    c = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "label"))
    assert "w:moron" in c.weights and sum(t.startswith("w:zq") for t in c.weights) == 5000


def test_label_model_trusts_accurate_voters():
    r = np.random.default_rng(3)
    y = r.random(2000) < 0.3
    votes = np.stack([np.where(r.random(2000) < a, np.where(y, 1, -1), np.where(y, -1, 1)) for a in (0.95, 0.9, 0.85, 0.5)], axis=1)
    p = toxicity.label_model(votes, np.full(2000, 0.5) + 0.1 * votes[:, 0])
    assert ((p > 0.5) == y).mean() > 0.95


def test_label_model_sees_that_voters_copy_each_other():
    r = np.random.default_rng(4)
    y = r.random(4000) < 0.4
    vote = lambda a: np.where(r.random(4000) < a, np.where(y, 1, -1), np.where(y, -1, 1))
    copied, good = vote(0.7), [vote(0.85) for _ in range(4)]
    votes = np.stack([*good, *[np.where(r.random(4000) < 0.98, copied, -copied) for _ in range(6)]], axis=1)
    start = 1 / (1 + np.exp(-np.stack(good, axis=1).sum(axis=1) - 0.3 * copied))
    ours, best = toxicity.label_model(votes, start) > 0.5, np.stack(good, axis=1).sum(axis=1) + 0.5 * copied > 0
    assert (ours == y).mean() > (best == y).mean() - 0.02 > 0.85


def test_one_class_no_documents_and_clashing_names(spark):
    docs = spark.createDataFrame([(k, f"text number {k}", "x", 1.0) for k in range(30)], "doc_id long, text string, LABEL string, score double")
    for value, low, high in ((1.0, 0.9, 1.0), (0.0, 0.0, 0.1)):
        labels = docs.select("doc_id", F.lit(value).alias("label"))
        assert low <= toxicity.fit(docs, labels).score("text") <= high
        stats = docs.select("doc_id", q.stats_column(F.col("text")).alias("stats"))
        assert low <= q.fit(stats.join(labels, "doc_id")).score(np.zeros((1, 24)))[0] <= high
        one = langid.fit(docs.select("doc_id", "text", F.lit("xx").alias("lang"), "LABEL"))
        assert one.predict("text")[0] == "xx"
    none = docs.where("false")
    labels = docs.select("doc_id", F.lit(1.0).alias("label"))
    assert toxicity.fit(none, labels).score("x") == 0.0 and none.select(toxicity.toxicity(F.col("text"), toxicity.fit(none, labels))).collect() == []
    with pytest.raises(ValueError):
        bpe.encode(docs.withColumn("BPE", F.lit(1)), tokenizer_path())



def brute_links(rows):
    good = [(k, np.array(v, float), lab) for k, (_, v, lab) in enumerate(rows) if v is not None and lab is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    linked = set()
    for i, x, a in good:
        for j, y, b in good:
            if i < j and a == b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                linked.add((i, j))
    return linked


@pytest.mark.parametrize("shard", [8192, 40])
def test_embeddings(spark, shard):
    r = np.random.default_rng(5)
    base = r.normal(size=(20, 8))
    rows = []
    for k in range(220):
        v = base[k % 20] + (r.normal(size=8) * 0.05 if k % 3 else 0)
        rows.append((k * 3 % 220, [float(x) for x in v], int(k % 20 % 3)))
    rows += [(500, None, 1), (501, [0.0] * 8, 1), (502, [float("nan")] + [1.0] * 7, 1), (503, [None] + [1.0] * 7, 1), (504, rows[0][1], None), (None, rows[1][1], rows[1][2]), (505, [], 1), (506, [1.0, 2.0], 1), (507, [2.0, 4.0], 1), (508, [float("inf")] * 8, 1), rows[4], rows[4]]
    df = spark.createDataFrame([(*x, "n") for x in rows], "vec_id long, embedding array<double>, label int, N_LINKS string")
    got = sorted(map(tuple, embeddings.near_duplicates(df, shard=shard).select("vec_id", "n_links", "component_id", "kept").collect()), key=str)
    linked = brute_links(rows)
    degree = np.zeros(len(rows), int)
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, j in linked:
        degree[[i, j]] += 1
        root[find(i)] = find(j)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    want = sorted([(i, int(degree[k]), least.get(find(k)), i is not None and i == least.get(find(k))) for k, (i, _, _) in enumerate(rows)], key=str)
    assert got == want


def test_embeddings_empty(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_graph_recall_in_clusters():
    r = np.random.default_rng(6)
    centres = r.normal(size=(6, 32))
    x = np.vstack([centres[k % 6] * (k < 900) + r.normal(size=32) * (0.02 if k < 900 else 1) for k in range(1500)])
    x /= np.linalg.norm(x, axis=1)[:, None]
    g = embeddings.Graph(x)
    beam, seen, hit = embeddings.audited(g, x, 0.98 - 1e-4, True)
    found, true = embeddings.linked(g, x, x, 0.98, True, beam), x @ x.T >= 0.98
    np.fill_diagonal(true, False)
    assert seen >= 200 and hit >= 0.98 * seen and (found & ~true).sum() == 0 and found.sum() / true.sum() > 0.99


def test_rare_links_between_shards_are_audited_and_found():
    r = np.random.default_rng(7)
    x, q = r.normal(size=(4000, 32)), r.normal(size=(4000, 32))
    q[:60] = x[100:160] + r.normal(size=(60, 32)) * 0.03
    x, q = (v / np.linalg.norm(v, axis=1)[:, None] for v in (x, q))
    g, true = embeddings.Graph(x), q @ x.T >= 0.98
    beam, seen, hit = embeddings.audited(g, q, 0.98 - 1e-4, False)
    found = embeddings.linked(g, x, q, 0.98, False, beam)
    assert seen >= true.sum() >= 40 and hit >= 0.98 * seen and (found & ~true).sum() == 0 and found.sum() >= 0.98 * true.sum()
    assert sorted(embeddings._forest(found, False)) == sorted((int(i), 4000 + int(j)) for i, j in np.argwhere(found))


def test_a_shard_of_near_equal_vectors_needs_no_list_of_pairs():
    import resource

    r = np.random.default_rng(8)
    x = r.normal(size=32) + r.normal(size=(1500, 32)) * 0.001
    x /= np.linalg.norm(x, axis=1)[:, None]
    g = embeddings.Graph(x)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = embeddings.linked(g, x, x, 0.98, True, embeddings.audited(g, x, 0.98 - 1e-4, True)[0])
    assert found.sum() == 1500 * 1499 and len(list(embeddings._forest(found, True))) == 1499
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000  # kB
