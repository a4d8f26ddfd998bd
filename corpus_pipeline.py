"""The corpus pipeline: language ID, near-duplicates, decontamination, PII, BPE.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; all but the last
return the columns of docs. ``run`` writes each stage to the shared folder, so a
stage reads its predecessor's rows once they are final. Column names that a stage
needs for its own are chosen free of those of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import bpe, decontaminate, langid, pii, simhash
from tributary.llm.common import fold_of, free_name, read, stash
from tributary.llm.queries import tokenizer_path


#: Languages to keep; None keeps every language that documents are labelled with.
LANGUAGES: tuple[str, ...] | None = None
#: A text whose language is less sure than this has none that it could be kept for.
SURE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose predicted language is sure enough and among LANGUAGES; lang becomes that language.

    Null texts and texts without a letter have no language and go.
    """
    model = langid.fit(docs.where(fold_of(F.col("doc_id"), 4) != 2))
    own = free_name(docs, "language")
    pred = F.col(own)["lang_pred"]
    kept = (pred != langid.UNKNOWN) & (F.col(own)["score"] >= SURE) & (F.lit(True) if LANGUAGES is None else pred.isin(*LANGUAGES))
    return docs.withColumn(own, langid.language(F.col("text"), model)).where(kept).withColumn("lang", pred).drop(own)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: the one with the smallest doc_id."""
    return simhash.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    own = free_name(docs, "hits")
    found = decontaminate.hits(docs, read(spark, sf_dir, "benchmark"), into=own)
    return found.where(F.size(F.col(own)["starts"]) == 0).drop(own)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by placeholders; n_chars follows the text."""
    out = docs.withColumn("text", pii.pii_redacted(F.col("text")))
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else out


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the ids of the text, their number and the text they decode to."""
    own = free_name(docs, "bpe")
    out = bpe.encode(docs, tokenizer_path(), outputs=("n_tokens", "ids", "decoded"), into=own)
    return out.select("doc_id", "lang", "source", F.col(f"{own}.n_tokens"), F.col(f"{own}.ids"), F.col(f"{own}.decoded"))


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("BPE encoding and decoding", tokens),
]

#: Languages, SimHash and BPE can't be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


#: Rows that a Python worker takes at once; whole texts are long, and several workers share an executor.
ROWS = 1000


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS)
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
