"""I-Match document fingerprints with randomised lexicon subsets.

The lexicon holds the terms whose document frequency, as a share of all documents,
lies in a band (an inverse-document-frequency band).  ``SUBSETS`` random subsets of
the lexicon keep from a half down to a 1024th of its terms.  For each subset a
document's distinct kept terms are sorted and hashed; the fingerprint lists these
hashes.  Sparse subsets survive edits of long texts, dense ones tell short texts
apart, and likeness is the share of subsets that agree at the best density.

A lexicon term occurs in at least ``low`` of the documents, so there are at most
(mean distinct terms a document) / ``low`` of them, however many documents there
are; that bound is checked before the lexicon is broadcast, and beyond it terms are
joined with the lexicon instead.

Defined results: null counts as empty; a text none of whose terms is in the lexicon
is fingerprinted by all its terms; texts without terms share one fingerprint; equal
texts have equal fingerprints; extra columns pass through, columns of the output
name are replaced; an empty table has an empty lexicon and result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkernels import mapped, settle

DENSITIES = 10
EACH = 5
SUBSETS = DENSITIES * EACH
#: Hex digits of each subset's hash.
DIGITS = 4
#: Largest lexicon that is broadcast; larger ones are joined.
MAX_BROADCAST_TERMS = 1_000_000


def terms(text: str | None) -> set[str]:
    """Distinct lower-cased white-space separated terms."""
    return set(text.lower().split()) if text else set()


#: Documents and terms after which a task empties its counter.
_CHUNK_DOCS, _CHUNK_TERMS = 5000, 300_000


def _count(texts: DataFrame, keep=None, low: float | None = None) -> DataFrame:
    """``term, df`` per chunk of documents.  ``keep``: a broadcast list of the only terms to count.  ``low``: leave out terms in a smaller share of their chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        n = 0
        wanted = set(keep.value) if keep is not None else None
        for batch in batches:
            for x in batch.column(0):
                own = terms(x.as_py())
                seen.update(own & wanted if wanted is not None else own)
                n += 1
                if wanted is None and (n >= _CHUNK_DOCS or len(seen) > _CHUNK_TERMS):
                    yield out(seen, n)
                    seen.clear()
                    n = 0
        if n:
            yield out(seen, n)

    def out(seen: Counter[str], n: int) -> pa.RecordBatch:
        kept = [(t, c) for t, c in seen.items() if low is None or c >= low * n]
        return pa.RecordBatch.from_pydict({"term": pa.array([t for t, _ in kept], pa.string()), "df": pa.array([c for _, c in kept], pa.int64())})

    return mapped(texts, run, "term string, df long")


def fit_lexicon(docs: DataFrame, text_col: str, low: float = 0.002, high: float = 0.2, least: int = 2) -> DataFrame:
    """``term`` of every term in the band: ``max(low * n, least) <= df <= high * n`` over all n documents.

    A term in at least that share of all documents is in at least that share of some
    chunk of them.  So a first pass names the terms that are frequent in some chunk, and
    a second counts just these in all documents, exactly; rare terms, nearly all of a
    vocabulary, are never shuffled.  If too many are named to broadcast, all are counted.
    """
    n = docs.count()
    texts = docs.select(F.col(f"`{text_col}`"))
    named = settle(_count(texts, low=low).select("term").distinct())
    if named.count() <= MAX_BROADCAST_TERMS:
        counts = _count(texts, docs.sparkSession.sparkContext.broadcast([r[0] for r in named.collect()]))
    else:
        counts = _count(texts)
    counts = counts.groupBy("term").agg(F.sum("df").alias("df"))
    return settle(counts.where((F.col("df") >= max(low * n, least)) & (F.col("df") <= high * n)).select("term"))


def _term_hash(term: str) -> int:
    return int.from_bytes(hashlib.blake2b(term.encode("utf-8", "replace"), digest_size=8).digest(), "little")


def _members(hashes: np.ndarray) -> np.ndarray:
    """Which subsets each term is in: one row of SUBSETS flags for each hash."""
    out = np.empty((len(hashes), SUBSETS), dtype=bool)
    for s in range(SUBSETS):
        x = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * (s + 1) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        out[:, s] = (x >> np.uint64(64 - 1 - s // EACH)) == 0
    return out


def fingerprint_of(hashes: np.ndarray, members: np.ndarray) -> str:
    """Fingerprint of the hashes of sorted distinct terms and their subset flags."""
    parts = []
    for s in range(SUBSETS):
        chosen = hashes[members[:, s]]
        parts.append(hashlib.blake2b(chosen.tobytes(), digest_size=DIGITS // 2).hexdigest() if len(chosen) else "-" * DIGITS)
    return "".join(parts)


class Lexicon:
    """Sorted terms with hashes and subset flags, for use inside tasks."""

    def __init__(self, listed: list[str]):
        self.place = {t: i for i, t in enumerate(sorted(listed))}
        self.hashes = np.array([_term_hash(t) for t in self.place], dtype=np.uint64)
        self.members = _members(self.hashes)

    def fingerprint(self, text: str | None) -> str:
        own = terms(text)
        at = sorted(self.place[t] for t in own if t in self.place)
        if at:
            return fingerprint_of(self.hashes[at], self.members[at])
        listed = sorted(own)
        hashes = np.array([_term_hash(t) for t in listed], dtype=np.uint64)
        return fingerprint_of(hashes, _members(hashes))


def fingerprints(docs: DataFrame, text_cols: dict[str, str], lexicon: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """Add for each ``{text column: output column}`` the fingerprint of the text; columns in ``drop`` are not returned."""
    kept = [c for c in docs.columns if c not in drop and c not in text_cols.values()]
    if lexicon.count() > MAX_BROADCAST_TERMS:
        return _joined(docs, text_cols, lexicon).select(*[F.col(f"`{c}`") for c in [*kept, *text_cols.values()]])
    shared = docs.sparkSession.sparkContext.broadcast([r[0] for r in lexicon.collect()])
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Lexicon(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                made = [pa.array([held.fingerprint(x.as_py()) for x in part.column(names.index(c))], pa.string()) for c in text_cols]
                yield pa.RecordBatch.from_arrays([*(part.column(names.index(c)) for c in kept), *made], names=[*kept, *text_cols.values()])

    schema = T.StructType([*(docs.schema[c] for c in kept), *(T.StructField(c, T.StringType()) for c in text_cols.values())])
    return mapped(docs, run, schema)


def _joined(docs: DataFrame, text_cols: dict[str, str], lexicon: DataFrame) -> DataFrame:
    """The same result for a lexicon too large to broadcast: terms are joined with it.  Rows are numbered and settled, so that numbers stay when a stage runs again."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    out = settle(docs.toDF(*names).withColumn("_row", F.monotonically_increasing_id()))
    made = []
    for text_col, name in text_cols.items():
        column = names[docs.columns.index(text_col)]
        listed = mapped(out.select("_row", column), _listed, "_row long, terms array<string>")
        own = listed.select("_row", F.explode("terms").alias("term"))
        kept = own.join(lexicon, "term").groupBy("_row").agg(F.sort_array(F.collect_list("term")).alias("kept"))
        # a text none of whose terms is in the lexicon is told by all of them
        chosen = listed.join(kept, "_row", "left").select("_row", F.coalesce("kept", "terms").alias("terms"))
        out = out.join(mapped(chosen, _hashed, f"_row long, `{name}` string"), "_row")
        made.append(name)
    return out.drop("_row").toDF(*[c if c not in text_cols.values() else f"_old_{c}" for c in docs.columns], *made)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([sorted(terms(x.as_py())) for x in part.column(1)], pa.list_(pa.string()))], names=["_row", "terms"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for x in batch.column(1):
            hashes = np.array([_term_hash(t) for t in sorted(x.as_py())], dtype=np.uint64)
            out.append(fingerprint_of(hashes, _members(hashes)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["_row", "fp"])


def likeness(a: list[str | None], b: list[str | None]) -> np.ndarray:
    """0 to 1 for each pair: equal fingerprints give 1; else the largest share, over densities with at least three subsets that hold terms of either, of subsets that agree."""
    blank = "-" * (SUBSETS * DIGITS)
    x, y = (np.frombuffer("".join([v or blank for v in c]).encode(), dtype=f"S{DIGITS}").reshape(-1, DENSITIES, EACH) for c in (a, b))
    empty = ("-" * DIGITS).encode()
    used = ((x != empty) | (y != empty)).sum(axis=2)
    same = ((x != empty) & (x == y)).sum(axis=2)
    best = np.where(used >= 3, same / np.maximum(used, 1), 0.0).max(axis=1, initial=0.0)
    return np.where([u is not None and u == v for u, v in zip(a, b)], 1.0, best)


def with_likeness(rows: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Add for each ``{output: (fingerprint column, fingerprint column)}`` their likeness; a null fingerprint is like nothing."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [pa.array(likeness(batch.column(names.index(a)).to_pylist(), batch.column(names.index(b)).to_pylist())) for a, b in pairs.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*names, *pairs])

    return mapped(rows, run, T.StructType([*rows.schema.fields, *(T.StructField(c, T.DoubleType()) for c in pairs)]))
