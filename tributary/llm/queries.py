"""The contract queries: each applies one operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, embeddings, langid, pii, repeats, simhash, substring, toxicity
from . import quality as q
from .common import fold_of, read, stash

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(read(spark, sf_dir, "documents"), outputs=("n_bytes", "n_removed", "n_spans", "kept_sha256"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexed(F.col("fp")).alias("fingerprint"), "component_id")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, tokenizer_path(), outputs=("n_tokens", "ids_sha256", "decoded_sha256", "n_joins")).select("doc_id", "bpe.*")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = fold_of(F.col("doc_id"), 4)
    model = langid.fit(docs.where(fold != 2))
    return docs.select("doc_id", (fold == 2).alias("held_out"), langid.language(F.col("text"), model).alias("p")).select("doc_id", "held_out", "p.*")


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(read(spark, sf_dir, "documents"), outputs=("n_words", "n_removed", "kept_sha256"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", pii.pii_digest(F.col("text")).alias("p")).select("doc_id", "p.*")


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.hits(docs, read(spark, sf_dir, "benchmark"))
    h = F.col("hits")
    rows = found.select("doc_id", h["n_words"].alias("n_words"), decontaminate.n_hit(h).alias("n_hit"), F.size(h["items"]).cast("long").alias("n_items"), decontaminate.items_digest(h).alias("items_sha256"))
    return rows.withColumn("contaminated", F.col("n_hit") > 0)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = fold_of(F.col("doc_id"), 3)
    stats = stash(read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), q.stats_column(F.col("text")).alias("stats")))
    scorer = q.fit(stats.join(q.labels_of(read(spark, sf_dir, "labels"), "quality", fold != 1), "doc_id"))
    scored = stats.select("doc_id", (fold == 1).alias("held_out"), q.quality(F.col("stats"), scorer).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = fold_of(F.col("doc_id"), 5)
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    classifier = toxicity.fit(docs, q.labels_of(read(spark, sf_dir, "labels"), "toxic", fold != 0))
    scored = docs.select("doc_id", (fold == 0).alias("held_out"), toxicity.toxicity(F.col("text"), classifier).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_repeats, op2_simhash, op3_bpe, op4_language, op5_substring, op6_pii, op7_embeddings, op8_decontaminate, op9_quality, op10_toxicity)}


#: The definitions in DuckDB's SQL. The others hash, tokenise or learn in ways that SQL can't express, or hold byte windows that
#: are too many for it; tests compare those with plain versions.
_OP5 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
least_id AS (SELECT k, min(doc_id) AS d FROM g GROUP BY k),
gone AS (SELECT DISTINCT g.doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN least_id USING (k) WHERE d < g.doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS t FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p GROUP BY words.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) USING (doc_id)
"""
_OP7 = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
good AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.norm > 0 AND b.norm > 0 AND list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])) / a.norm / b.norm >= 0.98),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT v.vec_id, coalesce(n, 0) AS n_links, least(v.vec_id, coalesce(m, v.vec_id)) AS component_id, v.vec_id = least(v.vec_id, coalesce(m, v.vec_id)) AS kept
FROM v LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id) LEFT JOIN (SELECT a AS vec_id, min(b) AS m FROM reach GROUP BY a) USING (vec_id)
"""
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP8 = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents), t AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
items AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS k FROM (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM t WHERE len(ws) > 0)),
g AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, ws, s.n, unnest(range(1, len(ws) - s.n + 2)) AS i FROM w, (SELECT DISTINCT n FROM items) s)),
found AS (SELECT g.doc_id, g.i, g.n, items.item_id FROM g JOIN items ON g.n = items.n AND g.k = items.k),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM found) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_substring": _OP5, "op7_embeddings": _OP7, "op8_decontaminate": _OP8}
