"""Vectorised text kernels that run inside Arrow batches.

A batch of texts is one UTF-8 buffer plus offsets, so words and shingles are
hashed for many documents with a few numpy passes.  Batches are cut into
slices of about ``SLICE_BYTES`` to bound memory; one document is never cut.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_within, settle, shared_folder  # noqa: F401

SLICE_BYTES = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The six white-space bytes of the word pattern ``[^\x20\x09-\x0D]+``.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POW = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash base modulo 2**64, kept between calls."""
    global _POW
    if len(_POW) < n:
        more = np.full(max(n, 2 * len(_POW)), _BASE, dtype=np.uint64)
        more[0] = 1
        _POW = np.multiply.accumulate(more)
    return _POW[:n]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets from 0) of runs of rows of about ``limit`` bytes; null counts as empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, where, data = texts.buffers()
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(where, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        to = min(to, n)
        yield at, raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the A-Z-lower-cased words of a slice, and where each row's words begin (one more entry than rows)."""
    inside = ~_SPACE[raw]
    if not inside.any():
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < len(raw)]
    begins[first] = inside[first]
    at = np.flatnonzero(begins)
    chars = _LOWER[raw[inside]].astype(np.uint64)
    starts = np.flatnonzero(begins[inside])
    lengths = np.diff(starts, append=len(chars))
    place = np.arange(len(chars)) - np.repeat(starts, lengths)
    chars += np.uint64(1)
    chars *= powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(chars, starts)), np.searchsorted(at, offsets)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ascending distinct 64-bit shingle hashes) of each text; a text of 1 to k-1 words has one shingle, one without words none."""
    none = np.zeros(0, dtype=np.uint64)
    factors = mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    for row, raw, offsets in slices(texts):
        words, begins = word_hashes(raw, offsets)
        n = len(words) - k + 1
        grams = none
        if n > 0:
            grams = words[:n] * factors[0]
            for j in range(1, k):
                grams += words[j : j + n] * factors[j]
            grams = mix(grams)
        for i in range(len(offsets) - 1):
            a, b = int(begins[i]), int(begins[i + 1])
            if b - a >= k:
                yield row + i, np.unique(grams[a : b - k + 1])
            elif b > a:
                short = (words[a:b] * factors[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                yield row + i, mix(np.array([short], dtype=np.uint64))
            else:
                yield row + i, none


def runs(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(first row, number of rows) of runs of rows whose texts have about ``limit`` bytes, one row at least."""
    for first, _, offsets in slices(texts, limit):
        yield first, len(offsets) - 1


#: Bytes of the record batches that Spark hands to Python, so that long texts and wide rows cost an executor no more than short ones.
BATCH_BYTES = 1 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def mapped(rows: DataFrame, run: Callable, schema) -> DataFrame:
    """``rows.mapInArrow(run, schema)`` in batches of about BATCH_BYTES; a session that sets a smaller size keeps it."""
    conf = rows.sparkSession.conf
    size = conf.get(_BATCH_SETTING, None)
    if size is None or int(re.sub("[^0-9]", "", size)) > BATCH_BYTES:
        conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return rows.mapInArrow(run, schema)


def held_out(id_col: str):
    """True for rows whose crc32 of the id as text leaves 2 modulo 4; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2
