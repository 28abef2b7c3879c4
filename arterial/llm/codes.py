"""Vector code compression: product codes with integer codebooks, found through lower bounds.

A vector is cut into parts, and each part is coded by its nearest codebook entry; the
codebooks are the result of a few rounds of assignment and floored means.  The nearest
entry is sought coarse to fine: means over ever smaller blocks of a part and the norm of
what the means leave (the residual) bound its distance to an entry from below, since
orthogonal components add up and norms differ by at most the norm of the difference.  An
entry is dropped only where its bound is above a distance already reached by another;
what survives is measured exactly in integers, so codes are those of a full search.

Per task only sums and counts for each part and entry leave the workers, and Spark adds
them before the driver takes the mean; what it collects and broadcasts is one codebook,
entries times dimension, whatever the number of rows.

Defined results: rows whose vector is null or holds a null, NaN or infinite component are
dropped; components are floored to integers after scaling and held within 2**24 either
way; vectors are filled with zeros to the longest, rounded up to a multiple of the number
of parts; equal distances go to the lower index; ids that repeat are ordered by their
components as seeds, null ids never seed while others do; with fewer rows than entries
the codebooks are as short; null labels are one label, NaN labels (of a floating type)
another; extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernels import broadcast_within, mapped, settle

#: Components are held within this, so that sums of squares fit 64 bits.
MOST = 1 << 24
#: Vectors handled at a time inside a task.
SLICE = 2048
#: Bounds are taken one by one where less than one in so many entries survives.
DENSE = 6


def scaled(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None, scale: int) -> DataFrame:
    """``id, label, vector`` of the rows that are kept; components still unscaled."""
    v = F.col(f"`{vector_col}`")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.col(f"`{label_col}`") if label_col else F.lit(None).cast("int")
    return vectors.select(F.col(f"`{id_col}`").alias("id"), label.alias("label"), v.alias("vector")).where(v.isNotNull() & ~bad)


def _matrix(lists: pa.Array, width: int, scale: int) -> np.ndarray:
    """Rows of floored scaled components, filled with zeros to ``width``."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    out = np.zeros((len(lists), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = np.clip(flat, -MOST, MOST).astype(np.int64)
    return out


class Codebook:
    """Entries of one part with what their lower bounds need."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        n, m = entries.shape
        # coarse to fine: 1, 2, 4, ... blocks while a block has at least two components
        self.cuts = [np.unique(np.arange(k + 1) * m // k) for k in (1 << i for i in range(max(m.bit_length(), 1))) if k == 1 or k * 2 <= m]
        self.sketches = [self._sketch(entries, c) for c in self.cuts]

    @staticmethod
    def _sketch(rows: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Block means, each times the root of the block's length, and the residual's norm: their squared distance is a lower bound."""
        sizes = np.diff(cuts)
        sums = np.add.reduceat(rows, cuts[:-1], axis=1) if len(sizes) else np.zeros((len(rows), 0))
        means = sums / np.sqrt(sizes)
        left = (rows.astype(np.float64) ** 2).sum(axis=1) - (means**2).sum(axis=1)
        return np.column_stack((means, np.sqrt(np.maximum(left, 0.0))))

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(index, squared distance) of each row's nearest entry, and how many exact distances it took."""
        n, k = len(rows), len(self.entries)
        if not n:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 0
        every = np.arange(n)
        alive = np.ones((n, k), dtype=bool)
        best, reach, tried = None, None, 0
        level = 0
        # while many entries survive, a level's bounds are taken for all at once, and the entry of the least bound is tried
        while level < len(self.cuts) and (level == 0 or np.count_nonzero(alive) > n * k // DENSE):
            bounds = self._bounds(self._sketch(rows, self.cuts[level]), level)
            bounds[~alive] = np.inf
            distance = ((rows - self.entries[bounds.argmin(axis=1)]) ** 2).sum(axis=1)
            tried += n
            best = distance if best is None else np.minimum(best, distance)
            # distances are integers: half a unit and a share cover the rounding of a bound
            reach = best * (1 + 1e-9) + 0.5
            alive &= bounds <= reach[:, None]
            level += 1
        row, entry = np.nonzero(alive)
        for fine in range(level, len(self.cuts)):
            mine, theirs = self._sketch(rows, self.cuts[fine])[row], self.sketches[fine][entry]
            keep = ((mine - theirs) ** 2).sum(axis=1) <= reach[row]
            row, entry = row[keep], entry[keep]
        exact = ((rows[row] - self.entries[entry]) ** 2).sum(axis=1)
        # survivors are in order of row and entry, and each row has its best guess at least
        starts = np.searchsorted(row, every)
        least = np.minimum.reduceat(exact, starts)
        place = np.where(exact == least[row], entry, k)
        return np.minimum.reduceat(place, starts), least, tried + len(row)

    def _bounds(self, sketch: np.ndarray, level: int) -> np.ndarray:
        own = self.sketches[level]
        return sum((sketch[:, i, None] - own[None, :, i]) ** 2 for i in range(own.shape[1]))


def _parts(rows: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    m = rows.shape[1] // parts
    for j in range(parts):
        yield j, np.ascontiguousarray(rows[:, j * m : (j + 1) * m])


def _sums(rows: DataFrame, books: np.ndarray, scale: int) -> DataFrame:
    """``part, entry, count, total`` of the rows assigned to each entry that has any."""
    parts, k, m = books.shape
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Codebook(b) for b in shared.value]
        count, total = np.zeros((parts, k), dtype=np.int64), np.zeros((parts, k, m), dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                for j, own in _parts(_matrix(batch.column(0).slice(at, SLICE), parts * m, scale), parts):
                    entry, _, _ = held[j].nearest(own)
                    count[j] += np.bincount(entry, minlength=k)
                    order = np.argsort(entry, kind="stable")
                    seen, first = np.unique(entry[order], return_index=True)
                    if m and len(seen):
                        total[j, seen] += np.add.reduceat(own[order], first, axis=0)
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(count[part, entry]), pa.array(total[part, entry].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "count", "total"])

    made = mapped(rows.select("vector"), run, "part long, entry long, count long, total array<long>")
    totals = F.array(*[F.sum(F.element_at("total", i + 1)) for i in range(m)]) if m else F.array().cast("array<long>")
    return made.groupBy("part", "entry").agg(F.sum("count").alias("count"), totals.alias("total"))


def fit_codebooks(rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> np.ndarray:
    """(parts, entries, components of a part) of integers; ``rows`` as :func:`scaled` gives them.

    The first entries are the parts of the rows with the smallest ids, in order of id.
    """
    longest = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    m = -(-longest // parts)
    seeds = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    first = _matrix(pa.array([r[0] for r in seeds], pa.list_(pa.float64())), parts * m, scale)
    books = np.ascontiguousarray(first.reshape(len(seeds), parts, m).transpose(1, 0, 2))
    for _ in range(rounds if len(seeds) else 0):
        for part, entry, count, total in _sums(rows, books, scale).collect():
            books[part, entry] = [t // count for t in total]
    return books


def encode(rows: DataFrame, books: np.ndarray, scale: int = 256) -> DataFrame:
    """``id, label, code`` (two hex digits, or as many as the last index needs, for each part) ``, error`` (squared distance to the coded vector)."""
    parts, k, m = books.shape
    shared = rows.sparkSession.sparkContext.broadcast(books)
    digits = max(2, len(f"{max(k - 1, 0):x}"))
    names = np.array([f"{i:0{digits}x}" for i in range(k)], dtype=f"S{digits}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Codebook(b) for b in shared.value]
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                piece = batch.slice(at, SLICE)
                n = piece.num_rows
                error, code = np.zeros(n, dtype=np.int64), np.empty((n, parts), dtype=f"S{digits}")
                for j, own in _parts(_matrix(piece.column(2), parts * m, scale), parts):
                    entry, distance, _ = held[j].nearest(own)
                    error += distance
                    code[:, j] = names[entry]
                joined = code.reshape(n, parts).view(f"S{parts * digits}").ravel().astype(str)
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(joined.tolist(), pa.string()), pa.array(error)], names=["id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return mapped(rows.select("id", "label", "vector"), run, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def decode(coded: DataFrame, books: np.ndarray, code_col: str = "code", vector_col: str = "vector", scale: int = 256) -> DataFrame:
    """Add the vector that each code stands for, unscaled; a null code gives null."""
    parts, k, m = books.shape
    digits = max(2, len(f"{max(k - 1, 0):x}"))
    flat = F.array(*[F.array(*[F.lit(float(x) / scale) for x in books[j].ravel()]) for j in range(parts)])
    place = lambda j: F.conv(F.substring(F.col(f"`{code_col}`"), F.lit(j * digits + 1), F.lit(digits)), 16, 10).cast("int")
    pieces = [F.slice(flat[j], place(j) * m + 1, m) for j in range(parts)]
    return coded.withColumn(vector_col, F.when(F.col(f"`{code_col}`").isNotNull(), F.concat(*pieces)))


def digest(books: np.ndarray) -> str:
    """Lowercase hex SHA-256 of all components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """``id_col, code, error, label_error`` (the error of all rows of the same label) ``, codebooks_sha256``."""
    rows = scaled(vectors, id_col, vector_col, label_col, scale)
    books = fit_codebooks(rows, parts, entries, rounds, scale)
    coded = settle(encode(rows, books, scale))
    # settled, so that Spark can split a label with many rows when it joins
    sums = settle(coded.groupBy("label").agg(F.sum("error").alias("label_error"))).withColumnRenamed("label", "_label")
    joined = coded.join(broadcast_within(sums, 24, F.coalesce(F.octet_length(F.col("_label").cast("string")), F.lit(0))), F.col("label").eqNullSafe(F.col("_label")))
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    """DuckDB SQL of :func:`compress` on ``embeddings``, by full search; vectors of one length that ``parts`` divides."""
    steps = [
        f"""kept AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"w AS (SELECT coalesce(max(len(v)), 0) // {parts} AS m FROM kept)",
        f"cut AS (SELECT r, j, v[j * m + 1 : (j + 1) * m] AS x, m FROM kept, w, range({parts}) AS t(j))",
        f"book0 AS (SELECT j, r - 1 AS e, x FROM cut WHERE r <= {entries})",
    ]
    for i in range(rounds + 1):
        steps.append(f"near{i} AS (SELECT c.r, c.j, min({{'d': coalesce(list_sum(list_transform(range(1, m + 1), lambda k: (c.x[k] - b.x[k]) * (c.x[k] - b.x[k]))), 0)::BIGINT, 'e': b.e}}) AS best FROM cut c JOIN book{i} b USING (j) GROUP BY c.r, c.j)")
        if i < rounds:
            steps.append(f"mean{i} AS (SELECT j, e, list(floor(s / n)::BIGINT ORDER BY k) AS x FROM (SELECT c.j, near{i}.best.e AS e, k, sum(c.x[k]) AS s, count(*) AS n FROM cut c JOIN near{i} USING (r, j), range(1, 1 + (SELECT m FROM w)) AS t(k) GROUP BY 1, 2, 3) GROUP BY j, e)")
            steps.append(f"book{i + 1} AS (SELECT j, e, coalesce(n.x, b.x) AS x FROM book{i} b LEFT JOIN mean{i} n USING (j, e))")
    steps.append(f"digest AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY j, e)) AS codebooks_sha256 FROM book{rounds})")
    steps.append(f"coded AS (SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY j) AS code, sum(best.d)::BIGINT AS error FROM near{rounds} GROUP BY r)")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (r), digest"
