"""The pipeline against plain versions of its stages, on a small corpus with odd rows."""

import brute
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tributary.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tributary.llm import langid, pii  # noqa: E402
from tributary.llm.queries import tokenizer_path  # noqa: E402


def test_stages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "SURE", 0.97)
    from tokenizers import Tokenizer

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    german = next(r["text"] for r in docs.where("lang = 'de' and length(text) > 500").orderBy("doc_id").collect()) + " und"
    odd = ["zq", "xq zzv", "jwq kx", "Vvv", "qqq", "wzx yq", "kkj", "Pf", "ub", "ymx"]
    more = spark.createDataFrame([(9001, None, "en", "s", None), (9002, "", "en", "s", 0), (9003, "12 34", "en", "s", 5), (None, "of the and one two", None, None, 18), (9004, "of the and one two", "en", "s", 18), (9004, "of the and one two", "en", "s", 18), *[(9020 + k, t, "en", "s", len(t)) for k, t in enumerate(odd)], (9015, german, "fr", "s", len(german))], docs.schema)
    docs.union(more).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf = str(tmp_path)
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    model = langid.fit(spark.read.parquet(f"{sf}/documents.parquet").where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 != 2))
    guess = [model.predict(r["text"]) for r in rows]
    kept = [(r["doc_id"], r["text"], g, r["source"], r["n_chars"]) for r, (g, score) in zip(rows, guess, strict=True) if g != "und" and score >= corpus_pipeline.SURE]
    assert (9015, "de") in {(r[0], r[2]) for r in kept} and len(kept) < sum(any(c.isalpha() for c in r["text"] or "") for r in rows)
    df = spark.read.parquet(f"{sf}/documents.parquet")
    frames = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, df, sf).write.parquet(str(tmp_path / f"out{k}"))
        df = spark.read.parquet(str(tmp_path / f"out{k}"))
        frames.append(df)
    key = lambda rows: sorted(rows, key=str)
    assert frames[0].columns == docs.columns and key(map(tuple, frames[0].collect())) == key(kept)

    fps = [(k, brute.simhash(r[1])) for k, r in enumerate(kept)]
    groups = {}
    for (k, _), (_, g) in zip(fps, brute.components(fps, lambda a, b: (a ^ b).bit_count() <= 2), strict=True):
        groups.setdefault(g, []).append(kept[k])
    ids = sorted(min(r[0] if r[0] is not None else 1 << 60 for r in g) for g in groups.values())
    assert sorted(r["doc_id"] for r in frames[1].collect()) == ids and frames[1].columns == docs.columns

    two = [tuple(r) for r in frames[1].collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {r[0] for r in brute.contamination([r[:2] for r in two], items, 10) if not r[-1]}
    assert key(map(tuple, frames[2].collect())) == key(r for r in two if r[0] in clean)

    finder = pii.finder()
    want = [(i, pii.redact(t, finder.spans(t)), la, s, len(pii.redact(t, finder.spans(t)))) for i, t, la, s, _ in map(tuple, frames[2].collect())]
    assert key(map(tuple, frames[3].collect())) == key(want)

    t = Tokenizer.from_file(tokenizer_path())
    for r in frames[4].join(frames[3].select("doc_id", "text"), "doc_id").collect():
        e = t.encode(r["text"], add_special_tokens=False).ids
        assert (r["ids"], r["n_tokens"], r["decoded"]) == (e, len(e), t.decode(e, skip_special_tokens=False))
    with monkeypatch.context() as m:
        m.setattr(corpus_pipeline, "LANGUAGES", ("de", "fr"))
        some = corpus_pipeline.language(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
        assert key(map(tuple, some.collect())) == key(r for r in kept if r[2] in ("de", "fr"))
    ran = corpus_pipeline.run(spark, sf)
    assert ran.select("doc_id", "n_tokens").exceptAll(frames[4].select("doc_id", "n_tokens")).isEmpty() and ran.count() == frames[4].count()


def test_empty_documents(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, docs.where(F.lit(False)), "/root/testdata/sf0.001").collect() == [], k
