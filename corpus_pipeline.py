"""From raw documents to token ids, one stage at a time.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept;
all but the last return the columns of ``documents``.

Every stage keeps documents apart whose id is null or repeated: where that occurs, rows
are told by a hash of id and text, and identical rows count as one document of several
copies.

1. language: rejects documents in which no language can be told: no letters at all,
   or letters whose n-gram order is far from every known language.
2. near_duplicates: of each group of documents linked by a Jaccard similarity of 0.8
   of five-word shingles, the one with the smallest id stays.
3. pii: personal data is replaced by its kind.
4. mixing: documents are repeated or left out so that sources meet their targets.
5. bpe: token ids of each text, and whether they decode to it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arterial.llm import bpe, jaccard_join, langid, mixing, pii, queries
from arterial.llm.textkernels import broadcast_within, settle, shared_folder

#: Least score of a document whose language counts as told.
MIN_LANGUAGE_SCORE = 0.2


def row_key(docs: DataFrame) -> tuple[Column, bool]:
    """What tells rows apart, and whether that is the id: it is where ids are neither null nor repeated."""
    odd = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    return (F.col("doc_id"), True) if odd.isEmpty() else (F.xxhash64("doc_id", "text"), False)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    profiles = langid.fit_profiles(docs, "text", "lang", F.lit(True), order_col="doc_id")
    told = langid.predict_language(docs, "text", profiles, pred_col="_lang_told", score_col="_lang_score")
    return told.where((F.col("_lang_told") != langid.UNDETERMINED) & (F.col("_lang_score") >= MIN_LANGUAGE_SCORE)).drop("_lang_told", "_lang_score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key, unique = row_key(docs)
    keyed = docs.withColumn("_key", key)
    groups = jaccard_join.similarity_components(keyed, "_key", "text", k=5, percent=80)
    copies = settle(groups.where("component_id < _key").select("_key"))
    kept = keyed.join(broadcast_within(copies, 32), "_key", "left_anti")
    return (kept if unique else kept.dropDuplicates(["_key"])).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs, "doc_id", "text").withColumn("n_chars", F.char_length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key, unique = row_key(docs)
    sized = docs.select("doc_id", "source", mixing.words(F.col("text")).alias("size"), key.alias("_key"))
    rated = queries.quality_weights(sized, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    taken = mixing.mix(rated, "_key", F.col("size"), "source", F.col("q")).where("taken > 0")
    copies = taken.groupBy("_key").agg(F.max((F.col("taken") / F.col("size")).cast("int")).alias("_copies"))
    joined = docs.withColumn("_key", key).join(copies, "_key")
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = queries.tokenizer_path(queries.BPE_VOCABULARY)
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), "text", path, "ids", "exact")
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "exact")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("pii", personal_data), ("mixing", mix_sources), ("bpe", token_ids)]
#: SQL can express neither the language profiles nor the bootstrap nor the merges; tests hold the stages against brute force.
ORACLE_SQL = None


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result but the last is written to the shared folder and read again, so that a later stage never repeats an earlier one.

    A stage's table is removed once the next one is written, so one copy of the corpus, the
    last stage's input, is left for the result to be read from.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    before = ""
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
