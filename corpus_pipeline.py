"""A corpus pipeline over `documents`: toxicity, language, near-duplicates, contamination, packing.

Each stage takes the documents its predecessor kept and returns those it keeps, with the columns of
documents; the last returns packed pieces. Stages are written as Parquet in the shared folder. Null
texts pass the first stage and are rejected by the second, having no language; empty tables stay empty.
Every document is judged by itself, also where ids are null or repeated: contamination follows from the text, and
of near-duplicates the one of least id, then digest, stays. Only rows that repeat both id and text stay or go together.
"""

from __future__ import annotations

from functools import reduce

from public_tokenizers import path
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconry.llm import decontaminate, language, packing, simhash, toxicity
from beaconry.llm.common import fold, plain_text, sampled, stored, table
from beaconry.llm.queries import labelled
from beaconry.session import prepare

#: The setting of how many rows a stage hands to Python at once, and its value here. Texts may be long.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"

#: Most keys (of under a hundred bytes each in memory) that are broadcast.
FEW = 500_000


def ready(spark: SparkSession) -> SparkSession:
    """The session with the library's settings and small batches for Python, which `run` takes back."""
    prepare(spark).conf.set(BATCH, BATCH_ROWS)
    return spark


def without(docs: DataFrame, gone: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """`docs` whose `keys` are not a row of `gone`, nulls being equal.

    Keys of what goes are written and counted first: up to `FEW` are broadcast, so that no text is shuffled to drop
    them; more are joined as Spark sees fit.
    """
    listed = stored(gone.select(*(F.col(k).alias(f"_gone_{k}") for k in keys)).distinct(), "pipeline-gone")
    if listed.count() <= FEW:
        listed = F.broadcast(listed)
    same = reduce(lambda a, b: a & b, (c.eqNullSafe(F.col(f"_gone_{k}")) for k, c in keys.items()))
    return docs.join(listed, same, "left_anti").select(*docs.columns)


def digest() -> Column:
    """Half of the text's SHA-256, in bytes."""
    return F.unhex(F.substring(F.sha2(plain_text("text"), 256), 1, 32))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below 0.3, as learned from labels outside the held-out fold."""
    model = toxicity.learn(labelled(ready(spark), docs, sf_dir, "toxic", 4, 2, toxicity.DOCUMENTS))
    return toxicity.score(docs, model, out="_toxicity").where(F.col("_toxicity.score") < 0.3).drop("_toxicity")


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found and not ambiguous."""
    ready(spark)
    known = docs.where(F.col("lang").isNotNull() & (fold("doc_id", 3) != 1)).select("doc_id", "text", "lang")
    model = language.learn(sampled(known, language.DOCUMENTS, "doc_id", "lang"))
    return language.identify(docs, model, out="_language").where(~F.col("_language.ambiguous")).drop("_language")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near-duplicates; one without an id where none has one."""
    ready(spark)
    who = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", digest().alias("digest"))
    found = simhash.near_duplicates(docs.select(who.alias("who"), "text"), "who")
    gone = found.where(F.col("who") != F.col("component_id")).select("who.doc_id", "who.digest")
    return without(docs, gone, {"doc_id": F.col("doc_id"), "digest": digest()})


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which under a twentieth lies in benchmark passages."""
    found = decontaminate.contamination(docs.select(digest().alias("digest"), "text"), table(ready(spark), sf_dir, "benchmark"), "digest")
    return without(docs, found.where("contaminated"), {"digest": digest()})


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents cut and packed into sequences of 2048 tokens."""
    ready(spark)
    return packing.pack_documents(docs, path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", keep_clean),
    ("language", keep_known_language),
    ("near-duplicates", drop_near_duplicates),
    ("contamination", drop_contaminated),
    ("packing", pack),
]

#: SQL cannot express trained models and tokenizers; tests run the stages beside plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. The session's batches are as they were when it is done."""
    before = spark.conf.get(BATCH)
    try:
        docs = table(ready(spark), sf_dir, "documents")
        for name, stage in STAGES:
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    finally:
        spark.conf.set(BATCH, before)
    return docs
