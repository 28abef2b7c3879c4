"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A text is the bag of its words' character n-grams (3 to 6 bytes of the
lower-cased word with its edges), hashed into buckets.  Each bucket has an
embedding; a text is their mean; a linear softmax over two classes gives the score.
Embeddings and softmax are trained together, in numpy, on a bounded sample of
labelled rows.  Misspellings share most n-grams with the words they come from.

Once trained, the mean and the linear layer commute: a bucket's embedding times the
softmax weights is one number, so the model that scores is one table of numbers, of
fixed size, and a text's logit is a mean over its n-grams.

Defined results: null and empty texts have no n-grams and get the score of the bias
alone; with no labelled rows every score is 0.5, with labels of one kind the bias
learns that kind; rows with a null label or id are not trained on; extra columns
pass through, and columns of the output names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkernels import _LOWER, _SPACE, mapped, settle, slices

BITS = 18
LENGTHS = (3, 4, 5, 6)
_BITS_LEFT = np.uint32(32 - BITS)


def subwords(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram of a slice of texts; words are edged by one blank each side."""
    rows = len(offsets) - 1
    text = np.full(len(raw) + 2 * rows, 32, dtype=np.uint8)
    if len(raw):
        lengths = np.diff(offsets)
        folded = _LOWER[raw]
        folded[_SPACE[raw]] = 32
        text[np.arange(len(raw)) + np.repeat(2 * np.arange(rows) + 1, lengths)] = folded
    owner = np.repeat(np.arange(rows), np.diff(offsets) + 2)
    space = text == 32
    wide = text.astype(np.uint32) + np.uint32(1)
    who, what = [], []
    for n in LENGTHS:
        m = len(text) - n + 1
        if m <= 0:
            continue
        code = np.zeros(m, dtype=np.uint32)
        inner = np.zeros(m, dtype=bool)
        for j in range(n):
            code = (code + wide[j : j + m]) * np.uint32(0x9E3779B1)
            code ^= code >> np.uint32(15)
            if 0 < j < n - 1:
                inner |= space[j : j + m]
        keep = np.flatnonzero(~inner)
        who.append(owner[keep])
        what.append((code[keep] * np.uint32(0x85EBCA77)) >> _BITS_LEFT)
    if not who:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint32)
    return np.concatenate(who), np.concatenate(what)


def train(bags: list[np.ndarray], counts: list[np.ndarray], labels: np.ndarray, dim: int, epochs: int, rate: float, seed: int) -> tuple[np.ndarray, float]:
    """Train embeddings, softmax and bias together by Adagrad; the number of each bucket and the bias."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << BITS, dim)).astype(np.float32)
    weights = rng.uniform(-1 / dim, 1 / dim, (dim, 2)).astype(np.float32)
    bias = np.zeros(2, dtype=np.float32)
    seen_v, seen_w, seen_b = np.full(1 << BITS, 1e-8, dtype=np.float32), np.full_like(weights, 1e-8), np.full_like(bias, 1e-8)
    size, batch = len(labels), 64
    for _ in range(epochs if size else 0):
        for at in np.array_split(rng.permutation(size), max(1, -(-size // batch))):
            own = [i for i in at if len(bags[i])]
            hidden = np.zeros((len(at), dim), dtype=np.float32)
            place = {i: p for p, i in enumerate(at)}
            if own:
                flat = np.concatenate([bags[i] for i in own])
                share = np.concatenate([counts[i] / counts[i].sum() for i in own]).astype(np.float32)
                begins = np.concatenate(([0], np.cumsum([len(bags[i]) for i in own])[:-1]))
                hidden[[place[i] for i in own]] = np.add.reduceat(vectors[flat] * share[:, None], begins, axis=0)
            logits = hidden @ weights + bias
            odds = np.exp(logits - logits.max(axis=1, keepdims=True))
            error = odds / odds.sum(axis=1, keepdims=True)
            error[np.arange(len(at)), labels[at]] -= 1
            error /= len(at)
            down = error @ weights.T
            grad_w, grad_b = hidden.T @ error, error.sum(axis=0)
            if own:
                step = np.repeat(down[[place[i] for i in own]], [len(bags[i]) for i in own], axis=0) * share[:, None]
                touched, inverse = np.unique(flat, return_inverse=True)
                grad = np.stack([np.bincount(inverse, step[:, d], len(touched)) for d in range(dim)], axis=1).astype(np.float32)
                seen_v[touched] += (grad * grad).mean(axis=1)
                vectors[touched] -= rate * grad / np.sqrt(seen_v[touched])[:, None]
            seen_w += grad_w * grad_w
            seen_b += grad_b * grad_b
            weights -= rate * grad_w / np.sqrt(seen_w)
            bias -= rate * grad_b / np.sqrt(seen_b)
    gap = weights[:, 1] - weights[:, 0]
    return (vectors @ gap).astype(np.float32), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, where: Column, max_rows: int = 6000, max_bytes: int = 64 << 20, dim: int = 8, epochs: int = 6, rate: float = 0.5, seed: int = 11) -> tuple[np.ndarray, float]:
    """Train on at most about ``max_rows`` rows and ``max_bytes`` of text of ``docs`` where ``where`` holds and ``labels`` has a label (one row per id).

    ``epochs`` is the number of passes over ``max_rows`` rows; fewer rows are passed over
    more often, up to ten times as often, so that small samples are learned as well.  Ids are sampled by their hash before texts are joined, and the sample is broadcast
    (its size is bounded by ``max_rows``), so texts are not shuffled.  n-grams are
    counted in Spark tasks; the bounded sample of bags meets in one task, which trains
    and returns the table of 2**BITS numbers.
    """
    # other columns may have any name, that of the label too
    docs = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"), where.alias("_where"))
    labels = labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").alias("_label"))
    sized = docs.where(F.col("_where") & F.col("_id").isNotNull()).select("_id", F.coalesce(F.octet_length("_text"), F.lit(0)).alias("_bytes"))
    ids = settle(sized.join(labels.where(F.col("_label").isNotNull()), "_id"))
    n, size = ids.agg(F.count("*"), F.sum("_bytes")).first()
    draw = F.pmod(F.xxhash64(F.col("_id"), F.lit(seed)), F.lit(1 << 20))
    share = min(1.0, max_rows / max(n, 1), max_bytes / max(size or 0, 1))
    chosen = ids.where(draw < (1 << 20) * share).select("_id", "_label").distinct()
    passes = round(epochs * min(10.0, max(1.0, max_rows / max(n * share, 1.0))))
    sample = docs.join(F.broadcast(chosen), "_id").select(F.col("_id").cast("long").alias("id"), F.col("_label").cast("int").alias("label"), F.col("_text").alias("text"))

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, raw, offsets in slices(batch.column(2)):
                who, what = subwords(raw, offsets)
                keys, counts = np.unique(who.astype(np.int64) << BITS | what, return_counts=True)
                rows = len(offsets) - 1
                ends = np.searchsorted(keys >> BITS, np.arange(rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, rows), batch.column(1).slice(row, rows), pa.ListArray.from_arrays(ends, pa.array((keys & ((1 << BITS) - 1)).astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(counts.astype(np.int32)))], names=["id", "label", "buckets", "counts"])

    def learn(table: pa.Table) -> pa.Table:
        order = np.lexsort((table.column("label").to_numpy(), table.column("id").to_numpy()))
        table = table.take(pa.array(order))
        labels = (table.column("label").to_numpy() == 1).astype(np.int64)
        bags, counts = ([np.asarray(x.values) for x in table.column(c)] for c in ("buckets", "counts"))
        numbers, bias = train(bags, counts, labels, dim, passes, rate, seed)
        return pa.table({"numbers": pa.array([numbers.tobytes()], pa.binary()), "bias": pa.array([bias])})

    bags = mapped(sample, bag, "id long, label int, buckets array<int>, counts array<int>")
    found = bags.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(learn, "numbers binary, bias double").first()
    if found is None:
        return np.zeros(1 << BITS, dtype=np.float32), 0.0
    return np.frombuffer(bytes(found["numbers"]), dtype=np.float32), found["bias"]


def score(docs: DataFrame, text_col: str, model: tuple[np.ndarray, float], score_col: str = "score") -> DataFrame:
    """Replace the text by ``score_col``, the chance that the text is toxic."""
    numbers, bias = docs.sparkSession.sparkContext.broadcast(model[0].tobytes()), model[1]
    kept = [c for c in docs.columns if c not in (text_col, score_col)]
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(numbers.value, dtype=np.float32)
        for batch in batches:
            logits = np.full(batch.num_rows, bias)
            for row, raw, offsets in slices(batch.column(names.index(text_col)), 1 << 19):
                who, what = subwords(raw, offsets)
                rows = len(offsets) - 1
                n = np.bincount(who, minlength=rows)
                logits[row : row + rows] += np.bincount(who, table[what], rows) / np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in kept), pa.array(1 / (1 + np.exp(-np.clip(logits, -50, 50))))], names=[*kept, score_col])

    return mapped(docs, run, T.StructType([*(docs.schema[c] for c in kept), T.StructField(score_col, T.DoubleType())]))
