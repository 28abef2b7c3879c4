"""The ``op*`` queries: each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bpe, codes, imatch, jaccard_join, langid, lengths, merkle, mixing, pieces, pii, tiff, toxicity, url_filter
from .textkernels import broadcast_within, held_out, settle


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Fixed values of the query: (verdict, host, path).
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
BPE_VOCABULARY = "byte_bpe_50k.json"
PIECE_MODEL = "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    """Where the installed public tokenizer files are."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), "page_id", "url", URL_RULES).drop("url")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the columns of the base patterns: ``n_added``, spans beyond them, of these ``n_learned`` by the bootstrapped patterns and ``n_secret`` as credentials in fixed forms, which are seeds, and ``n_spans``, all spans."""
    docs = _table(spark, sf_dir, "documents")
    found = pii.by_document(pii.extract(docs, "doc_id", "text"))
    rows = docs.select("doc_id", pii.row_of(F.col("text")).alias("_row"))
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("_row") == F.col("row")), "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    counts = [count(f"n_{k}").alias(f"n_{k}") for k in pii.KINDS]
    n_base = sum((count(f"n_{k}") for k in pii.KINDS[1:]), count(f"n_{pii.KINDS[0]}"))
    return rows.select("doc_id", *counts, F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), count("n_added").alias("n_added"), count("n_learned").alias("n_learned"), (count("n_added") - count("n_learned")).alias("n_secret"), (n_base + count("n_added")).alias("n_spans"))


def id_buckets(docs: DataFrame, id_col: str, per_bucket: int = 2000, most: int = 1_000_000) -> DataFrame:
    """Deal rows into ranges of ids that hold about ``per_bucket`` rows, each closed by a copy (``tail`` true) of the first row of the next range; the last range is closed by the first row of all.

    Ranges are wider where there would be more than ``most`` of them; their limits, 8 bytes
    each, are what reaches the driver and the tasks.  Only ids pass through Python.  ``docs``
    must have no columns ``bucket, tail, to, _key, _e``; a null id is below all others.
    """
    taken = {"bucket", "tail", "to", "_key", "_e"} & set(docs.columns)
    if taken:
        raise ValueError(f"columns of these names would clash: {sorted(taken)}")
    spark = docs.sparkSession
    key = F.coalesce(F.col(id_col), F.lit(-(1 << 63)))
    n = docs.count()
    k = min(n // per_bucket, most)
    limits = docs.select(F.percentile_approx(key, [i / k for i in range(1, k)], max(10_000, 4 * k))).first()[0] if k > 1 else []
    shared = spark.sparkContext.broadcast(np.unique(np.array(limits, dtype=np.int64)))

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, ids.to_numpy(), side="right")).astype("int32")

    rows = docs.withColumn("_key", key).withColumn("bucket", range_of("_key"))
    firsts = settle(docs.select(key.alias("_key")).withColumn("bucket", range_of("_key")).groupBy("bucket").agg(F.min("_key").alias("_key")))
    # one row for each range: the range before it, or the last for the first
    before = F.lag("bucket").over(W.orderBy("bucket"))
    closes = firsts.withColumn("to", F.coalesce(before, F.max("bucket").over(W.partitionBy()))).select("_key", "to")
    both = rows.join(broadcast_within(closes, 16), "_key", "left")
    ends = F.array_compact(F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("t")), F.when(F.col("to").isNotNull(), F.struct(F.col("to").alias("b"), F.lit(True).alias("t")))))
    return both.withColumn("_e", F.explode(ends)).select(*docs.columns, F.col("_e.b").alias("bucket"), F.col("_e.t").alias("tail"))


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next document is the next in order of id (null first), then text; documents meet it in ranges of ids, so each text moves once."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lexicon = imatch.fit_lexicon(docs, "text")
    in_order = W.partitionBy("bucket").orderBy("tail", F.col("doc_id").asc_nulls_first(), "text")
    rows = id_buckets(docs, "doc_id").withColumns({"next": F.coalesce(F.lead("text").over(in_order), F.lit("")), "place": F.row_number().over(in_order)})
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next"), F.lit(1), cut))
    rows = rows.select("doc_id", "bucket", "tail", "place", "text", n.cast("long").alias("n_chars"), edited.alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    marked = imatch.fingerprints(rows, {"text": "fingerprint", "edited": "edited_fingerprint"}, lexicon, drop=("text", "edited"))
    marked = marked.withColumn("next_fingerprint", F.lead("fingerprint").over(W.partitionBy("bucket").orderBy("place"))).where("not tail")
    near = imatch.with_likeness(marked.drop("bucket", "tail", "place"), {"near_edited": ("fingerprint", "edited_fingerprint"), "near_next": ("fingerprint", "next_fingerprint")})
    return near.drop("next_fingerprint")


def op4_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = lengths.token_counts(_table(spark, sf_dir, "documents").select("text"), "text", tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return lengths.histogram(counts, "n_tokens")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", F.coalesce(held_out("doc_id"), F.lit(False)))
    labels = _table(spark, sf_dir, "labels").where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    model = toxicity.fit(docs, labels, "doc_id", "text", "toxic", ~F.col("held_out"))
    scored = toxicity.score(docs, "text", model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similarity_components(_table(spark, sf_dir, "documents"), "doc_id", "text", k=4, percent=85)


def quality_weights(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with column ``q``: 2 for documents labelled good, 0.5 for bad, 1 for unlabelled ones."""
    known = labels.groupBy("doc_id").agg(F.max("quality").alias("_quality"))
    return docs.join(known, "doc_id", "left").withColumn("q", F.when(F.col("_quality") == 1, 2.0).when(F.col("_quality") == 0, 0.5).otherwise(1.0)).drop("_quality")


QUALITY_SQL = "SELECT doc_id, CASE max(quality) WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END AS q FROM labels GROUP BY doc_id"


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = quality_weights(_table(spark, sf_dir, "documents").select("doc_id", "source", mixing.words(F.col("text")).alias("size")), _table(spark, sf_dir, "labels"))
    return mixing.mix(docs, "doc_id", F.col("size"), "source", F.col("q"))


def op8_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.digests(tiff.store_texts(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(held_out("doc_id"), F.lit(False)))
    profiles = langid.fit_profiles(docs, "text", "lang", ~F.col("held_out"), order_col="doc_id")
    return langid.predict_language(docs.select("doc_id", "held_out", "text"), "text", profiles).drop("text")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", tokenizer_path(BPE_VOCABULARY)).drop("text")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.checked(_table(spark, sf_dir, "documents"))


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", tokenizer_path(PIECE_MODEL)).drop("text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_pii": op2_pii,
    "op3_imatch": op3_imatch,
    "op4_token_histogram": op4_token_histogram,
    "op5_toxicity": op5_toxicity,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_mixing": op7_mixing,
    "op8_tiff": op8_tiff,
    "op9_language": op9_language,
    "op10_bpe": op10_bpe,
    "op11_vector_codes": op11_vector_codes,
    "op12_merkle": op12_merkle,
    "op13_pieces": op13_pieces,
}

#: DuckDB SQL of the queries that SQL can express on whole tables.
ORACLES: dict[str, str] = {"op7_mixing": mixing.oracle(QUALITY_SQL), "op11_vector_codes": codes.oracle(), "op12_merkle": merkle.CHECKED_SQL}
