"""Exact token-length histogram and what it answers.

Documents are aggregated by encoded length; sums over the suffix of the histogram
give totals, quantiles and truncated totals for every context limit.

Defined results: null and empty texts have length 0; texts of any length are encoded
whole; an empty table gives an empty histogram; repeated rows count each time; extra
columns pass through the counting (one of the count's name is replaced) and are ignored
by the histogram.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .textkernels import mapped, settle

#: Lengths in one part of the suffix sums.
PART = 1024


#: Runs of white space (as Unicode has it) that the encoder's regular expression is spared; shorter ones it splits itself.
_BLANKS = re.compile(r"(?<![\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000])[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}+")


def count_tokens(encoding, text: str) -> int:
    """Number of tokens of a text.

    The pattern takes a run of white space whole at the end of a text, else all of it but
    the last character, which goes with what follows; so a text can be cut there, and long
    runs, on which the regular expression would run out of stack, are merged directly.
    """
    n, at = 0, 0
    for m in _BLANKS.finditer(text) if len(text) >= 10_000 else ():
        n += len(encoding.encode_ordinary(text[at : m.start()]))
        at = m.end() - (m.end() < len(text))
        n += len(encoding._encode_single_piece(text[m.start() : at]))
    return n + len(encoding.encode_ordinary(text[at:] if at else text))


@lru_cache(maxsize=2)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def token_counts(docs: DataFrame, text_col: str, ranks_path: str, pattern: str, count_col: str = "n_tokens") -> DataFrame:
    """Replace the text by its number of tokens; the ranks file, under a MB, is broadcast."""
    with open(ranks_path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    kept = [c for c in docs.columns if c not in (text_col, count_col)]
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(ranks.value, pattern)
        for batch in batches:
            n = np.array([count_tokens(encoding, x.as_py() or "") for x in batch.column(names.index(text_col))], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in kept), pa.array(n)], names=[*kept, count_col])

    from pyspark.sql import types as T

    return mapped(docs, run, T.StructType([*(docs.schema[c] for c in kept), T.StructField(count_col, T.LongType())]))


def histogram(counts: DataFrame, count_col: str) -> DataFrame:
    """One row per length: ``length, n_docs`` and, with the context limit at that length, ``docs_over`` and ``tokens_over`` (documents longer than it and their tokens), ``docs_total, tokens_total`` (all), ``tokens_kept`` (total if each document is cut at the limit) and ``quantile`` (share of documents at most that long).

    Suffix sums run within parts of PART lengths, then over the parts.  The counts by
    length, few rows, are settled, so that documents are encoded once.
    """
    by = settle(counts.groupBy(F.col(count_col).alias("length")).agg(F.count("*").alias("n_docs")))
    by = by.withColumn("tokens", F.col("length") * F.col("n_docs")).withColumn("part", F.floor(F.col("length") / PART))
    after = W.orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1)
    parts = by.groupBy("part").agg(F.sum("n_docs").alias("pd"), F.sum("tokens").alias("pt"))
    all_rows = W.partitionBy()
    parts = parts.select("part", F.coalesce(F.sum("pd").over(after), F.lit(0)).alias("d_after"), F.coalesce(F.sum("pt").over(after), F.lit(0)).alias("t_after"), F.sum("pd").over(all_rows).alias("docs_total"), F.sum("pt").over(all_rows).alias("tokens_total"))
    within = W.partitionBy("part").orderBy(F.desc("length")).rowsBetween(W.unboundedPreceding, -1)
    out = by.join(parts, "part")
    over_d = F.coalesce(F.sum("n_docs").over(within), F.lit(0)) + F.col("d_after")
    over_t = F.coalesce(F.sum("tokens").over(within), F.lit(0)) + F.col("t_after")
    out = out.withColumn("docs_over", over_d).withColumn("tokens_over", over_t)
    kept = F.col("tokens_total") - F.col("tokens_over") + F.col("length") * F.col("docs_over")
    quantile = (F.col("docs_total") - F.col("docs_over")) / F.col("docs_total")
    return out.select("length", "n_docs", "docs_over", "tokens_over", "docs_total", "tokens_total", kept.alias("tokens_kept"), quantile.alias("quantile"))


def totals_at(hist: DataFrame, limits: list[int]) -> DataFrame:
    """``limit, docs_over, tokens_kept`` for any limits, also lengths that do not occur, from the histogram alone."""
    spark = hist.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "limit long")
    cell = F.broadcast(asked).join(hist.select("length", "n_docs"), F.lit(True), "left")
    return cell.groupBy("limit").agg(F.coalesce(F.sum(F.when(F.col("length") > F.col("limit"), F.col("n_docs"))), F.lit(0)).alias("docs_over"), F.coalesce(F.sum(F.least("length", "limit") * F.col("n_docs")), F.lit(0)).alias("tokens_kept"))


def length_at(hist: DataFrame, quantile: float) -> DataFrame:
    """``length``: the smallest length that at least that share of the documents does not exceed."""
    return hist.where(F.col("quantile") >= quantile).agg(F.min("length").alias("length"))
