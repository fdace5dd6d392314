"""A corpus pipeline of four stages: toxicity, language, near duplicates, packing.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. A doc_id
that is rejected in one of its rows leaves with all of them. Rows without a doc_id go by their text, behind all ids: they are
judged as others are, and rows with one text have one verdict. Texts of any length are judged whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixgrid.llm.batches import written
from helixgrid.llm.language import UNDETERMINED, language_id
from helixgrid.llm.near_dup import near_duplicates
from helixgrid.llm.packing import pack
from helixgrid.llm.toxicity import toxicity

#: Ids up to so many are sent to the documents; beyond that the documents are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Least posterior share of the predicted language.
LEAST_LANGUAGE_SCORE = 0.5


def _sent(ids: DataFrame) -> DataFrame:
    """Distinct ids, written, and marked for broadcast if they are few enough."""
    ids = written(ids.select("_key").distinct(), "ids")
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds _key: the doc_id, or for rows without one a number above 2 ** 62 that follows from the text."""
    by_text = F.pmod(F.xxhash64("text"), F.lit(1 << 62)) + F.lit(1 << 62)
    return docs.withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), by_text))


def _without(keyed: DataFrame, rejected: DataFrame) -> DataFrame:
    return keyed.join(_sent(rejected), "_key", "left_anti").select(keyed.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from all labels, does not predict to be toxic."""
    keyed = _keyed(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumnRenamed("doc_id", "_key")
    scored = toxicity(keyed, labels, id_col="_key", held_out=None)
    return _without(keyed, scored.where("predicted = 1")).drop("_key")


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is surely in one of the languages that the documents name."""
    keyed = _keyed(docs)
    found = language_id(keyed, id_col="_key", held_out=None)
    return _without(keyed, found.where((F.col("lang_pred") == UNDETERMINED) | (F.col("score") < LEAST_LANGUAGE_SCORE))).drop("_key")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of smallest doc_id, and one row of each document."""
    keyed = _keyed(docs)
    found = written(near_duplicates(keyed, id_col="_key").select("_key", "kept"), "groups")
    kept = _without(keyed, found.where(~F.col("kept")))
    again = found.where("kept").groupBy("_key").count().where("count > 1")
    if again.isEmpty():
        return kept.drop("_key")
    repeated = _sent(again)
    once = kept.join(repeated, "_key", "left_semi").select(kept.columns).dropDuplicates(["_key"])
    return kept.join(repeated, "_key", "left_anti").select(kept.columns).unionByName(once).drop("_key")


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences of 4096 tokens."""
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_languages),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack_documents),
]

#: SQL expresses none of the learned stages; tests/llm/test_pipeline.py holds them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
