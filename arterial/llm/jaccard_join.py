"""N-gram Jaccard similarity join by vertical partitioning.

The global order of n-grams (the order of their 64-bit hashes) is cut into
contiguous fragments.  Two sets with ``100 * common >= percent * union`` differ in
at most ``(100 - percent) * n // percent`` n-grams, n the smaller size.  Each
difference touches one fragment, so with more fragments than that some fragment
holds the same non-empty part of both sets.  Documents that agree on a fragment
are candidates.  For a candidate pair the partial overlap of each coarse fragment
is counted separately, and the counts are summed per pair and tested exactly.

Equal sets are one class and only its smallest id makes keys.  Groups of candidates
are not expanded into pairs.  Each member is first tested against the group's smallest
id and links are closed into components.  Large groups whose members lie in different
components take new centres, and their members are tested against these, while that
brings components together.  The members that are left are compared inside tasks, large groups in blocks, by histograms
of their n-grams over the global order: the difference of two histograms is never more
than that of the sets, so a pair that it rules out cannot be similar, and only the
pairs that it leaves are returned and tested.  Keys that a sample shows to be frequent
are salted, so that no task holds all rows of one; the sample decides where rows go,
never what is found.

The result is the classes, not the links: members that are linked through others are
not tested against each other.

Defined results: null, empty and white-space-only texts have no n-grams and link
with nothing; texts of fewer words than n have one n-gram, the whole; a row with a null
id has its number of n-grams and no component (nothing could name it); several rows of
one id count as one document, whose set is the smallest by size, then hash; extra
columns are ignored, whatever their names; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected
from .textkernels import broadcast_within, mapped, mix, settle, shingle_sets

#: Coarse fragments in which partial overlaps are counted.
COARSE = 4
#: Keys held by this many of about SAMPLE documents are salted over SALTS parts.
FREQUENT, SAMPLE, SALTS = 10, 2000, 64
#: Pairs of one centre for each copy of its fragments.
HEAVY = 5000
#: Members up to which an open group is compared in blocks at once; larger ones take further centres while that helps.
LARGE = 256
#: Keys or n-grams after which a task hands on what it has.
HELD = 1 << 16
#: Members of a block of a group that is compared inside a task.
BLOCK = 256
#: Least and most cells of a set's histogram; between them it has two to four times as many cells as n-grams, half a byte each.
CELLS = (32, 8192)


def size_classes(percent: int, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower bounds of the size classes, ratio about 1.41, and the number of fragments of each."""
    bounds = [1]
    while bounds[-1] <= largest:
        bounds.append(max(bounds[-1] + 1, int(bounds[-1] * 1.4142)))
    differ = [(100 - percent) * (b - 1) // percent for b in bounds[1:]]
    return np.array(bounds[:-1]), np.array([0 if d == 0 else d + d // 20 + 1 for d in differ])


def fragment_keys(grams: np.ndarray, percent: int) -> np.ndarray:
    """One key for each part of a set of ascending hashes that a similar set may share, in each size class that the pair may have."""
    n = len(grams)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    smallest = -(-percent * n // 100)
    lows, parts = size_classes(percent, n)
    keys = []
    high = grams >> np.uint64(32)
    mixed = mix(grams)
    for c in range(int(np.searchsorted(lows, smallest, side="right")) - 1, int(np.searchsorted(lows, n, side="right"))):
        f = int(parts[c])
        if not f:
            continue
        part = (high * np.uint64(f)) >> np.uint64(32)
        begins = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        salt = np.uint64((c + 1) * 0xD1B54A32D192ED03 % (1 << 64))
        keys.append(mix(np.add.reduceat(mixed, begins) ^ mix(salt + part[begins])))
        if len(begins) <= (100 - percent) * n // percent:  # each part may be touched: those that are empty in both count too
            empty = np.setdiff1d(np.arange(f, dtype=np.uint64), part[begins])
            keys.append(mix(mix(salt + empty) + np.uint64(1)))
    return np.concatenate(keys) if keys else np.zeros(0, dtype=np.uint64)


def histogram(grams: np.ndarray) -> bytes:
    """Counts (15 at most, two to a byte) of ascending hashes over equal ranges of the global order; the number of ranges is a power of two."""
    cells = min(CELLS[1], max(CELLS[0], 1 << (2 * len(grams)).bit_length()))
    counts = np.minimum(np.bincount((grams >> np.uint64(65 - cells.bit_length())).astype(np.int64), minlength=cells), 15).astype(np.uint8)
    return (counts[::2] | counts[1::2] << 4).tobytes()


def counts_of(packed: bytes) -> np.ndarray:
    """The counts of a histogram."""
    both = np.frombuffer(packed, dtype=np.uint8)
    return np.stack([both & 15, both >> 4], axis=1).ravel()


def fold(counts: np.ndarray, cells: int) -> np.ndarray:
    """A histogram over fewer ranges."""
    return counts.astype(np.int16).reshape(cells, -1).sum(axis=1, dtype=np.int16)


def may_link(n: np.ndarray, rows: np.ndarray, i: int, among: np.ndarray, percent: int) -> np.ndarray:
    """Which of the rows ``among`` (indexes) may be similar to row i, by sizes and histograms."""
    small, large = np.minimum(n[among], n[i]), np.maximum(n[among], n[i])
    sized = small * 100 >= large * percent
    among, small = among[sized], small[sized]
    apart = np.abs(rows[among] - rows[i]).sum(axis=1, dtype=np.int64)
    return among[apart <= (100 - percent) * small // percent]


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """id, number of n-grams, two independent 64-bit hashes of the set, and its histogram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros(batch.num_rows, dtype=np.int64)
            a, b, cells = n.astype(np.uint64), n.astype(np.uint64), [b""] * batch.num_rows
            for row, grams in shingle_sets(batch.column(1), k):
                n[row] = len(grams)
                cells[row] = histogram(grams)
                if len(grams):
                    a[row] = grams.sum(dtype=np.uint64)
                    b[row] = mix(grams).sum(dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(cells, pa.binary())], names=["id", "n", "a", "b", "cells"])

    return mapped(docs, run, "id long, n long, a long, b long, cells binary")


def _keys(docs: DataFrame, k: int, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            out, who, held = [], [], 0
            for row, grams in shingle_sets(batch.column(1), k):
                out.append(fragment_keys(grams, percent))
                who.append(row)
                held += len(out[-1])
                if held > HELD:
                    yield pack(ids, out, who)
                    out, who, held = [], [], 0
            if held:
                yield pack(ids, out, who)

    def pack(ids: np.ndarray, out: list[np.ndarray], who: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.repeat(ids[who], [len(x) for x in out]))], names=["key", "id"])

    return mapped(docs, run, "key long, id long")


def _segments(docs: DataFrame, k: int) -> DataFrame:
    """(id, centers, coarse fragment, its n-grams) of each row of (id, text, a, centers) whose set has the hash ``a``."""
    edges_at = np.array([(j << 64) // COARSE for j in range(1, COARSE)], dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(2).to_pylist()
            who, parts, held = [], [], 0
            for row, grams in shingle_sets(batch.column(1), k):
                if not len(grams) or int(grams.sum(dtype=np.uint64).view(np.int64)) != wanted[row]:
                    continue
                who.append(row)
                parts += np.split(grams.view(np.int64), np.searchsorted(grams, edges_at))
                held += len(grams)
                if held > HELD:
                    yield pack(batch, who, parts)
                    who, parts, held = [], [], 0
            if who:
                yield pack(batch, who, parts)

    def pack(batch: pa.RecordBatch, who: list[int], parts: list[np.ndarray]) -> pa.RecordBatch:
        rows = pa.array(np.repeat(who, COARSE))
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32)
        grams = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts)))
        frag = pa.array(np.tile(np.arange(COARSE, dtype=np.int32), len(who)))
        return pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(3).take(rows), frag, grams], names=["id", "centers", "frag", "grams"])

    return mapped(docs, run, "id long, centers array<long>, frag int, grams array<long>")


def _whole_sets(texts: DataFrame, roles: DataFrame, k: int) -> DataFrame:
    """(id, centers, frag, grams) of the documents in ``roles`` (id, a, centers).

    ``roles`` is broadcast within a bound of bytes, so that texts stay where they are;
    beyond that both sides are shuffled by id.
    """
    return _segments(texts.join(broadcast_within(roles, 40, F.size("centers") * 8), "id").select("id", "text", "a", "centers"), k)


def overlaps(pairs: DataFrame, members: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """``common`` of each pair (x, y): partial overlaps of the fragments, summed.

    A document's fragments are sent to the first ids of its pairs, so that each pair
    moves one set, not two.  A first id of many pairs, a centre, has its fragments copied
    once for every HEAVY of them, and its partners are dealt over the copies.
    """
    heavy = settle(pairs.groupBy("x").agg(F.count("*").alias("_m")).where(F.col("_m") > HEAVY).select("x", F.ceil(F.col("_m") / HEAVY).cast("int").alias("salts")))
    salts = broadcast_within(heavy, 16)
    ends = pairs.select(F.col("y").alias("id"), "x").unionByName(pairs.select(F.col("x").alias("id"), "x"))
    roles = settle(ends.groupBy("id").agg(F.collect_set("x").alias("centers")).join(members.select("id", "a"), "id"))
    sets = _whole_sets(texts, roles, k)
    sent = sets.select("id", "frag", "grams", F.explode("centers").alias("x"))
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))
    own = sent.where("id = x").join(salts, "x", "left").select("x", "frag", copies.alias("salt"), F.col("grams").alias("gx"))
    salt = F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1))).cast("int")
    other = sent.where("id != x").join(salts, "x", "left").select("x", F.col("id").alias("y"), "frag", salt.alias("salt"), F.col("grams").alias("gy"))
    partial = other.join(own, ["x", "frag", "salt"]).select("x", "y", "frag", "salt", F.size(F.array_intersect("gx", "gy")).cast("long").alias("part"))
    return partial.groupBy("x", "y", "frag", "salt").agg(F.max("part").alias("part")).groupBy("x", "y").agg(F.sum("part").alias("common"))


def _possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y), with sizes, that sizes and histograms do not rule out."""
    ends = [sets.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("cells").alias(f"c{c}")) for c in ("x", "y")]
    rows = pairs.join(ends[0], "x").join(ends[1].drop("cy"), "y").where(F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * percent).join(ends[1].drop("ny"), "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for nx, ny, cx, cy in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5))):
                u, v = counts_of(cx), counts_of(cy)
                cells = min(len(u), len(v))
                apart = int(np.abs(fold(u, cells) - fold(v, cells)).sum())
                keep.append(apart <= (100 - percent) * min(nx, ny) // percent)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in range(4)], names=["x", "y", "nx", "ny"])

    return mapped(rows.select("x", "y", "nx", "ny", "cx", "cy"), run, "x long, y long, nx long, ny long")


def _linked(pairs: DataFrame, sets: DataFrame, members: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (x, y) that are similar enough, tested exactly."""
    near = settle(_possible(pairs, sets, percent))
    common = overlaps(near.select("x", "y"), members, texts, k)
    return near.join(common, ["x", "y"]).where(F.col("common") * 100 >= percent * (F.col("nx") + F.col("ny") - F.col("common"))).select("x", "y")


def _across(open_groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of members of one group that lie in different components and that sizes and histograms do not rule out.

    Members of a group are dealt into blocks of about BLOCK; each pair of blocks is
    compared in one task, which returns the pairs that are left.
    """
    blocks = open_groups.withColumn("nb", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    dealt = blocks.select("key", "id", "comp", "low", "block", other.alias("o")).select("key", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "id", "comp", "low", "block")
    rows = dealt.join(sets.select("id", "n", "cells"), "id").select("key", "i", "j", "id", "comp", "low", "block", "n", "cells")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def pairs_of(group: list[tuple]) -> list[tuple[int, int]]:
        _, i, j, *_ = group[0]
        counts = [counts_of(r[8]) for r in group]
        cells = min(map(len, counts))
        hist = np.stack([fold(c, cells) for c in counts])
        n, comp, block = (np.array([r[c] for r in group]) for c in (7, 4, 6))
        ids, low = [r[3] for r in group], group[0][5]
        out = []
        for a in range(1, len(group)):
            ok = comp[:a] != comp[a]
            if i != j:
                ok &= block[:a] != block[a]
            out += [(min(ids[a], ids[b]), max(ids[a], ids[b])) for b in may_link(n, hist, a, np.flatnonzero(ok), percent) if low not in (ids[a], ids[b])]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and row[:3] != group[0][:3]:
                    seen.update(pairs_of(group))
                    group = []
                group.append(row)
            if len(seen) > 50_000:
                yield pack(seen)
                seen = set()
        if group:
            seen.update(pairs_of(group))
        if seen:
            yield pack(seen)

    def pack(pairs: set[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"x": pa.array([p[0] for p in pairs], pa.int64()), "y": pa.array([p[1] for p in pairs], pa.int64())})

    return mapped(rows, run, "x long, y long").distinct()


def _groups(texts: DataFrame, n_docs: int, k: int, percent: int) -> DataFrame:
    """(key, id, low) of the keys that several documents hold; ``low`` is the smallest of them."""
    from pyspark.sql import Window as W

    some = texts.where(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(max(1, n_docs // SAMPLE))) == 0)
    hot = settle(_keys(some, k, percent).groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") >= FREQUENT).select("key", F.lit(True).alias("hot")))
    keys = _keys(texts, k, percent).join(broadcast_within(hot, 9), "key", "left")
    keys = keys.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(0).cast("int"))
    part = W.partitionBy("key", "salt")
    found = keys.withColumns({"low": F.min("id").over(part), "high": F.max("id").over(part)}).where("hot or low < high")
    found = settle(found.select("key", "id", "low", F.coalesce("hot", F.lit(False)).alias("hot")))
    ends = settle(found.where("hot").groupBy("key").agg(F.min("low").alias("least"), F.max("id").alias("most")).where("least < most").select("key", "least"))
    salted = found.where("hot").join(broadcast_within(ends, 16), "key").select("key", "id", F.col("least").alias("low"))
    return found.where("not hot").select("key", "id", "low").unionByName(salted)


def _open(groups: DataFrame, found: DataFrame) -> tuple[DataFrame, int]:
    """(key, id, low, comp, m) of the groups whose members lie in different components, and the number of pairs across components in the large ones."""
    named = groups.join(broadcast_within(found, 16), "id", "left").select("key", "id", "low", F.coalesce("component", "id").alias("comp"))
    parts = named.groupBy("key", "comp").agg(F.count("*").alias("c"))
    sums = settle(parts.groupBy("key").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("q"), F.count("*").alias("comps")).where("comps > 1 and m > 2"))
    pairs = sums.where(F.col("m") > LARGE).agg(F.sum((F.col("m") * F.col("m") - F.col("q")) / 2)).first()[0] or 0
    return settle(named.join(broadcast_within(sums.select("key", "m"), 24), "key")), int(pairs)


def similarity_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """``id_col``, ``n_shingles`` and ``component_id`` (the smallest id reachable by links) of every document."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    texts = rows.where("id is not null")
    sets = _sets(texts, k)
    if not texts.groupBy("id").count().where("count > 1").isEmpty():
        sets = sets.groupBy("id").agg(F.min(F.struct("n", "a", "b", "cells")).alias("s")).select("id", "s.*")
    sets = settle(sets)
    # equal sets are one class, named by its smallest id; empty sets stay alone
    classes = settle(sets.where("n > 0").groupBy("n", "a", "b").agg(F.min("id").alias("rep"), F.count("*").alias("m")).where("m > 1").drop("m"))
    members = settle(sets.drop("cells").join(broadcast_within(classes, 48), ["n", "a", "b"], "left").select("id", "n", F.coalesce("rep", "id").alias("rep"), "a"))
    single = texts.join(broadcast_within(members.where("rep <> id").select("id"), 32), "id", "left_anti")
    groups = _groups(single, members.count(), k, percent)

    stars = groups.where("id > low").select(F.col("low").alias("x"), F.col("id").alias("y")).distinct()
    links = settle(_linked(stars, sets, members, texts, k, percent))
    found = connected(links, "x", "y")
    open_groups, pairs = _open(groups, found)
    turn = 0
    while pairs > 0:
        # a centre drawn among the members lies in a large component more often than not
        large = open_groups.where(F.col("m") > LARGE)
        centre = large.groupBy("key").agg(F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), "id", "comp")).alias("c"))
        drawn = large.join(broadcast_within(settle(centre), 40), "key").where("comp <> c.comp and id <> low and c.id <> low")
        stars = drawn.select(F.least("id", "c.id").alias("x"), F.greatest("id", "c.id").alias("y")).distinct()
        links = settle(links.unionByName(_linked(stars, sets, members, texts, k, percent)))
        found = connected(links, "x", "y")
        before, turn = pairs, turn + 1
        open_groups, pairs = _open(groups, found)
        if pairs > 0.9 * before:
            break
    links = links.unionByName(settle(_linked(_across(open_groups, sets, percent), sets, members, texts, k, percent)))
    final = connected(links, "x", "y")
    named = members.join(broadcast_within(final.select(F.col("id").alias("rep"), "component"), 24), "rep", "left")
    out = named.select("id", "n", F.coalesce("component", "rep").alias("component"))
    out = out.unionByName(_sets(rows.where("id is null"), k).select("id", "n", F.lit(None).cast("long").alias("component")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
