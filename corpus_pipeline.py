"""The corpus pipeline over documents: quality, near copies, repeated passages, mixing, tokens.

Each stage is a (name, function) of STAGES; a function takes (spark, docs, sf_dir), where docs has the columns
doc_id, text, lang, source and n_chars, and returns a DataFrame that is written and read again as the docs of
the next one. All stages but the last return the columns of documents, and what a stage decides takes effect:

1. quality: documents that the classifier rejects go. The model learns from the labels of the folds that may
   be learned from, and from the texts of docs. Where nothing could be learned (no positives) all documents stay.
2. near_copies: of every group of near copies the row with the smallest doc_id stays (one of them, if an id
   repeats in the group); rows of one id with different texts are different documents. Documents without an id,
   and documents without words, are no one's copies and stay, of the latter one for each id.
3. repeats: bytes that a passage found elsewhere covers go from the texts, n_chars follows, and documents of
   which no word is left go. A character that loses one of its bytes goes whole.
4. mix: a document stands as often as the mix takes it (0, 1 or 2 times).
5. tokens: doc_id, n_tokens and the digests of the ids and of the decoded text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.bpe_chunks import digests
from stratalog.llm.common import documents, materialize
from stratalog.llm.jaccard_join import near_copies
from stratalog.llm.quality_classifier import classify, learned
from stratalog.llm.source_mix import mix, sized
from stratalog.llm.suffix_dedup import PASSAGE, suffix_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier accepts. Null and empty texts are scored as any other; repeated rows stay or go
    together; without positives among the documents all stay."""
    model = learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if model is None:
        return docs.select(*COLUMNS)
    plain = docs.select(*COLUMNS, F.col("text").alias("kept"))
    return classify(plain, model).where("predicted = 1").select("doc_id", F.col("kept").alias("text"), "lang", "source", "n_chars")


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the smallest id, and of its rows the one of the smallest hash. Rows without an id stay."""
    # rows are named by what they hold; rows that are equal in all columns are one
    rows = docs.select(*COLUMNS).withColumn("row", F.xxhash64(*COLUMNS))
    groups = near_copies(rows.select(F.col("row").alias("doc_id"), "text")).withColumnRenamed("doc_id", "row").distinct()
    ids = rows.where("doc_id IS NOT NULL").groupBy("row", "doc_id").agg(F.count("*").alias("times"))
    # documents without words are copies of nothing but the rows of their own id
    empty = F.col("n_shingles") == 0
    group = ids.join(groups, "row").select("row", "doc_id", "times", empty.alias("empty"), F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("group"))
    first = materialize(group.groupBy("empty", "group").agg(F.min(F.struct("doc_id", "row", "times")).alias("r")).select("r.row", "r.times"))
    once = rows.join(first.where("times = 1"), "row", "left_semi")
    more = rows.join(first.where("times > 1"), "row", "left_semi").dropDuplicates(["row"])
    return once.unionByName(more).unionByName(rows.where("doc_id IS NULL")).select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the bytes that strings of PASSAGE bytes cover which also start elsewhere. Null texts stay null;
    of texts that are equal as a whole and long enough nothing is left, and they go."""
    rows = docs.select(*COLUMNS).withColumn("row", F.xxhash64("text"))
    found = suffix_dedup(rows.select(F.col("row").alias("doc_id"), "text"), (PASSAGE,), with_text=True)
    cut = found.where("n_removed > 0").select(F.col("doc_id").alias("row"), "kept").dropDuplicates(["row"])
    text = F.coalesce("kept", "text")
    new = rows.join(cut, "row", "left").withColumn("text", text).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    return new.where(F.col("kept").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them whole. The choice follows from id and text, not from where a row lies;
    rows that are equal in both are taken or left together. Null texts weigh nothing and are never taken."""
    rows = docs.select(*COLUMNS).withColumn("row", F.xxhash64("doc_id", "text", "source"))
    taken = mix(sized(rows, "row")).select(F.col("doc_id").alias("row"), "copies").where("copies > 0").dropDuplicates(["row"])
    again = rows.join(taken, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return again.select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of every row; a null text has no ids."""
    return digests(docs)


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies_stage),
    ("repeats", repeats),
    ("mix", mixed),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
