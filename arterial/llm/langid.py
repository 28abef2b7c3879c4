"""Language identification by rank-order n-gram profiles.

A profile lists the ``profile_size`` most frequent letter n-grams (1 to 3) of a
language, most frequent first.  A document is compared to every profile by the
out-of-place distance: the sum over the document's own most frequent n-grams of
how far each rank is from the profile's, or ``profile_size`` where it is missing.

Defined results: null text or text without a letter gives ``und`` and score 0;
ties go to the language that sorts first; repeated rows are judged alike; an
empty table gives an empty result; with no training rows all give ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkernels import broadcast_within, mapped, runs

UNDETERMINED = "und"
#: Documents kept in memory at once while counting, in characters.
_BLOCK = 1 << 19
_fold: np.ndarray | None = None


def _folding() -> np.ndarray:
    """Code point to lower-case letter, or to a space for anything else."""
    global _fold
    if _fold is None:
        table = np.full(0x110000, 32, dtype=np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _fold = table
    return _fold


def letters(text: str | None) -> np.ndarray:
    """Folded code points with single spaces around each run of letters; empty without a letter."""
    if not text:
        return np.zeros(0, dtype=np.int64)
    codes = _folding()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    space = codes == 32
    keep = ~space
    if not keep.any():
        return np.zeros(0, dtype=np.int64)
    keep[1:] |= space[1:] & ~space[:-1]
    codes = codes[keep]
    return np.concatenate(([32] * int(codes[0] != 32), codes, [32] * int(codes[-1] != 32))).astype(np.int64)


def ngrams(codes: np.ndarray) -> np.ndarray:
    """Every 1-, 2- and 3-gram as one integer of 21 bits a letter, but those with a space in the middle or alone."""
    if not len(codes):
        return codes
    two = (codes[:-1] << 21) | codes[1:]
    three = (two[:-1] << 21) | codes[2:]
    return np.concatenate((codes[codes != 32], two, three[codes[1:-1] != 32]))


def ranked(grams: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by code."""
    kinds, counts = np.unique(grams, return_counts=True)
    if len(kinds) > size:
        edge = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= edge
        kinds, counts = kinds[keep], counts[keep]
    return kinds[np.lexsort((kinds, -counts))[:size]]


def fit_profiles(docs: DataFrame, text_col: str, lang_col: str, where: Column, profile_size: int = 400, docs_per_language: int = 2000, order_col: str | None = None) -> dict[str, list[int]]:
    """Learn profiles from the rows where ``where`` holds and text and language are not null.

    ``docs_per_language`` bounds the training sample: of each language about that
    many rows are used, chosen by a hash of ``order_col`` (default: the text), so
    reruns agree.  Counts are summed by Spark; only the top of each language's
    list, languages x profile_size numbers, reaches the driver.
    """
    labelled = docs.where(where & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = labelled.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"), (F.pmod(F.xxhash64(F.col(f"`{order_col or text_col}`")), F.lit(1 << 20)) / float(1 << 20)).alias("_draw"))
    shares = rows.groupBy("lang").agg((docs_per_language / F.count("*")).alias("_share"))
    sample = rows.join(broadcast_within(shares, 64), "lang").where(F.col("_draw") < F.col("_share")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[np.ndarray]] = {}
            held = 0

            def flush():
                for lang, parts in by.items():
                    kinds, counts = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(kinds), pa.string()), "gram": kinds, "n": counts.astype(np.int64)})
                by.clear()

            for lang, text in zip(batch.column(0), batch.column(1)):
                grams = ngrams(letters(text.as_py()))
                by.setdefault(lang.as_py(), []).append(grams)
                held += len(grams)
                if held > 8 * _BLOCK:
                    yield from flush()
                    held = 0
            yield from flush()

    from pyspark.sql import Window as W

    counts = mapped(sample, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = W.partitionBy("lang").orderBy(F.desc("n"), F.asc("gram"))
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= profile_size)
    profiles: dict[str, list[int]] = {}
    for r in top.orderBy("lang", "rank").collect():
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


def predict_language(docs: DataFrame, text_col: str, profiles: dict[str, list[int]], profile_size: int = 400, pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """Add the language of each text and a score: 1 is the profile's own order, 0 no n-gram in common.

    Columns of those names are replaced; all others pass through.
    """
    names = sorted(profiles)
    grams = [np.array(profiles[k], dtype=np.int64) for k in names]
    sorts = [np.argsort(g) for g in grams]
    sorted_grams = [g[s] for g, s in zip(grams, sorts)]
    kept = [c for c in docs.columns if c not in (pred_col, score_col)]
    source = docs.select(*[F.col(f"`{c}`") for c in kept])
    place = kept.index(text_col)

    def judge(text: str | None) -> tuple[str, float]:
        own = ranked(ngrams(letters(text)), profile_size)
        if not len(own) or not names:
            return UNDETERMINED, 0.0
        ranks = np.arange(len(own))
        best, least = UNDETERMINED, None
        for name, known, order in zip(names, sorted_grams, sorts):
            at = np.searchsorted(known, own)
            at[at == len(known)] = 0
            found = known[at] == own
            distance = int(np.where(found, np.abs(order[at] - ranks), profile_size).sum())
            if least is None or distance < least:
                best, least = name, distance
        return best, 1.0 - least / (profile_size * len(own))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in runs(batch.column(place)):
                part = batch.slice(at, n)
                out = [judge(x.as_py()) for x in part.column(place)]
                columns = [*part.columns, pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, pred_col, score_col])

    from pyspark.sql import types as T

    schema = T.StructType([*source.schema.fields, T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType())])
    return mapped(source, predict, schema)
