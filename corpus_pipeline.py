"""The training-data pipeline: toxicity, exact and near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs of
the next. Counted as part of the subpackage llm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistaloom.llm import classify, decontaminate, exact_dedup, ngram_join, packing
from vistaloom.llm.queries import table
from vistaloom.llm.util import intermediate, maybe_in, record, saved
from vistaloom.shipping import ship


#: Characters of each executed plan's text that the driver keeps; it keeps a thousand plans, and those of the joins are long.
PLAN_TEXT = 4096


def _lean(spark: SparkSession) -> None:
    """Ships the package, and bounds what the driver keeps of plans that it has run."""
    ship(spark)
    spark.conf.set("spark.sql.maxPlanStringLength", PLAN_TEXT)


def _numbered(docs: DataFrame) -> DataFrame:
    """record (all columns of docs) and row (a number of its own for each row); written once, so that numbers stay."""
    return saved(docs.select(record(docs), F.monotonically_increasing_id().alias("row")), "numbered")


def _texts(numbered: DataFrame) -> DataFrame:
    """The rows for an operator, named by their numbers, so that null and repeated ids can't be mixed up."""
    return numbered.select(F.col("row").alias("doc_id"), F.col("record.text").cast("string").alias("text"))


def _without(numbered: DataFrame, rows: DataFrame) -> DataFrame:
    """The records but those of `rows` (row). Rows that miss a filter of them (of bounded size) don't move; the rest is joined."""
    rows = saved(rows.select("row", F.xxhash64("row").alias("key")), "dropped")
    keyed = numbered.select("record", "row", F.xxhash64("row").alias("key"))
    maybe, rest = maybe_in(keyed, "key", rows, "key")
    return rest.select("record.*").unionByName(maybe.join(rows.select("row"), "row", "left_anti").select("record.*"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half stay, all columns unchanged, whatever their ids; null and empty texts get the score of no features."""
    _lean(spark)
    return classify.drop_toxic(docs, table(spark, sf_dir, "labels"), classify.remainder("doc_id", 5) != 0)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased, null as empty) one row stays: the one with the largest doc_id (null is the smallest), any one of those that share it."""
    return exact_dedup.drop_duplicates(docs, largest=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that are linked by five-word shingles one row stays: the one with the smallest doc_id (null is the largest; of
    rows that share it, one). Rows are told apart by numbers, so a repeated id takes no other text along. Texts without words all stay."""
    numbered = _numbered(docs)
    groups = saved(ngram_join.near_duplicates(_texts(numbered)).select(F.col("doc_id").alias("row"), F.col("component_id").alias("component")), "groups")
    shared = groups.where("row <> component").select("component").distinct()
    members = groups.join(shared, "component", "left_semi").join(numbered.select("row", F.col("record.doc_id").cast("long").alias("doc_id")), "row")
    members = saved(members.select("row", "component", "doc_id"), "group-members")
    keep = members.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("keep"))
    return _without(numbered, members.join(keep, "component").where("row <> keep.row"))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds ten consecutive words of a benchmark item go, whatever their ids; null and empty texts stay."""
    numbered = _numbered(docs)
    found = decontaminate.contamination(_texts(numbered), table(spark, sf_dir, "benchmark"))
    return _without(numbered, found.where("contaminated").select(F.col("doc_id").alias("row")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens; every row is packed, null and empty texts as their end token alone."""
    return packing.pack(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_duplicates), ("ngram_jaccard_join", near_duplicates), ("decontamination", benchmark_passages), ("packing", packing_stage)]

#: SQL can express neither the classifier nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    _lean(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with intermediate(spark):
            docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
