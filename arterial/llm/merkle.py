"""Merkle manifest of a dataset: one root, and an authentication path for each row.

Rows are leaves, ordered by id within a group (a language, say); every ARITY consecutive
nodes become their hash until one, the group's root, is left; the groups' roots become
the dataset's root in the same way.  H is the lowercase hex SHA-256 of concatenated hex
digests.

Leaves are numbered by a range partitioning with prefix sums over partitions, so a group
of any size is spread.  Aligned blocks of ARITY ** DEPTH leaves are tasks' units: their roots are
the leaves of the next tier, and so on.  Inside a block a fractal traversal emits the
paths one after another: of the stacked subtrees of HEIGHT levels on a leaf's path it
keeps the existing ones and builds, one leaf a step, the desired ones that come next, so
it holds some ARITY ** HEIGHT digests for each stacked subtree instead of the tree.  A
block's path in the tiers above, computed once by the same traversal over block roots, is
appended to each of its paths.

Defined results: a null value hashes as ``-``, told apart from any text; the null group
is first; null ids come first, rows of equal id follow their leaf's digest; a repeated
row is a leaf of its own; columns that are not named take no part; an empty table gives
an empty manifest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .textkernels import broadcast_within, settle

ARITY = 8
#: Levels of a stacked subtree, and of a block unless given.
HEIGHT, DEPTH = 2, 4


def _h(parts: Sequence[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def depth(n: int) -> int:
    """Levels above n nodes until one is left."""
    d = 0
    while n > 1:
        n = -(-n // ARITY)
        d += 1
    return d


def leaf(*values: Column) -> Column:
    """Leaf digest of some values: each ``-`` if null, else its UTF-8 byte count, a colon and the value."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


class _Subtree:
    """Nodes of levels low to top - 1 over the leaves from ``base`` on, built one leaf a step."""

    def __init__(self, leaves: Sequence[str], base: int, low: int, top: int):
        self.leaves, self.at, self.end = leaves, base, min(base + ARITY**top, len(leaves))
        self.low, self.top = low, top
        self.first = [base // ARITY**level for level in range(top)]
        self.kept: dict[int, list[str]] = {level: [] for level in range(low, top)}
        self.open: list[list[str]] = [[] for _ in range(top + 1)]

    def _put(self, level: int, node: str) -> None:
        while True:
            if self.low <= level < self.top:
                self.kept[level].append(node)
            run = self.open[level]
            run.append(node)
            if level == self.top or len(run) < ARITY:
                return
            node = _h(run)
            run.clear()
            level += 1

    def step(self) -> None:
        """Take in one more leaf; the last one closes runs that are not full."""
        if self.at < self.end:
            self._put(0, self.leaves[self.at])
            self.at += 1
            if self.at == self.end:
                for level in range(self.top):
                    if self.open[level]:
                        node = _h(self.open[level])
                        self.open[level].clear()
                        self._put(level + 1, node)

    def finish(self) -> _Subtree:
        while self.at < self.end:
            self.step()
        return self

    def siblings(self, i: int, level: int) -> tuple[int, list[str]]:
        """Place of leaf i's ancestor in its run, and the run's others."""
        at = i // ARITY**level - self.first[level]
        run = at - at % ARITY
        others = self.kept[level][run : run + ARITY]
        del others[at % ARITY]
        return at % ARITY, others


def root_of(leaves: Sequence[str], levels: int) -> str:
    """The node ``levels`` above a block's leaves."""
    return _Subtree(leaves, 0, levels, levels).finish().open[levels][0] if levels else leaves[0]


def traverse(leaves: Sequence[str], levels: int) -> Iterator[tuple[str, str]]:
    """(shape, siblings) of each leaf in turn, up to ``levels`` levels: for each level two digits, the node's place in its run and the number of the others; the others' digests, joined."""
    tops = [min(low + HEIGHT, levels) for low in range(0, levels, HEIGHT)]
    existing = [_Subtree(leaves, 0, s * HEIGHT, top).finish() for s, top in enumerate(tops)]
    desired = [_Subtree(leaves, ARITY**top, s * HEIGHT, top) for s, top in enumerate(tops)]
    for i in range(len(leaves)):
        shape, others = [], []
        for tree in existing:
            for level in range(tree.low, tree.top):
                place, own = tree.siblings(i, level)
                shape.append(f"{place}{len(own)}")
                others += own
        yield "".join(shape), "".join(others)
        for s, top in enumerate(tops):
            desired[s].step()
            if (i + 1) % ARITY**top == 0:
                existing[s] = desired[s].finish()
                desired[s] = _Subtree(leaves, i + 1 + ARITY**top, s * HEIGHT, top)


def fold(node: str, shape: str, siblings: str) -> str:
    """The root that a leaf and its path lead to."""
    at = 0
    for level in range(0, len(shape), 2):
        place, count = int(shape[level]), int(shape[level + 1])
        cut, end = at + 64 * place, at + 64 * count
        node = sha256((siblings[at:cut] + node + siblings[cut:end]).encode()).hexdigest()
        at = end
    return node


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """Add ``i``, a row's place in its group from 0, and ``n``, the group's size; settled.

    Rows are put in ranges and sorted there; a row's place is its place in its partition
    and the group's rows in the partitions before.
    """
    ordered = [F.col(c).asc_nulls_first() for c in (group, *order)]
    placed = rows.repartitionByRange(*ordered).sortWithinPartitions(*ordered)
    placed = settle(placed.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()))
    parts = placed.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(F.count("*").alias("_count"), F.min("_at").alias("_first"))
    before = W.partitionBy("_g").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumns({"_before": F.coalesce(F.sum("_count").over(before), F.lit(0)), "n": F.sum("_count").over(W.partitionBy("_g"))})
    parts = broadcast_within(settle(parts), 64, F.coalesce(F.octet_length(F.col("_g").cast("string")), F.lit(0)))
    both = placed.join(parts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return both.withColumn("i", F.col("_at") - F.col("_first") + F.col("_before")).select(*rows.columns, "i", "n")


def _blocks(nodes: DataFrame, deep: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("i") / ARITY**deep).cast("long"))


def tiers(nodes: DataFrame, deep: int = DEPTH) -> list[DataFrame]:
    """``nodes`` (g, i, n, node), the roots of their blocks of ``deep`` levels, and so on until each group g has one; each but the first settled."""

    def roots(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("i")
        n = int(frame["n"].iloc[0])
        root = root_of(frame["node"].tolist(), min(deep, depth(n)))
        return pd.DataFrame({"g": frame["g"].iloc[:1], "i": frame["block"].iloc[0], "n": -(-n // ARITY**deep), "node": root})

    out = [nodes]
    while (nodes.agg(F.max("n")).first()[0] or 0) > 1:
        nodes = settle(_blocks(nodes.select("g", "i", "n", "node"), deep).groupBy("g", "block").applyInPandas(roots, "g long, i long, n long, node string"))
        out.append(nodes)
    return out


def _with_paths(nodes: DataFrame, above: DataFrame, run: Callable, schema: str, deep: int) -> DataFrame:
    """``run(block's rows in order, (shape, siblings) of each, the block's row of above)`` for each block; above: g, i (of the block), shape, siblings."""

    def over(own: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return run(own, [], None)
        own = own.sort_values("i")
        return run(own, traverse(own["node"].tolist(), min(deep, depth(int(own["n"].iloc[0])))), up.iloc[0])

    return _blocks(nodes, deep).groupBy("g", "block").cogroup(above.withColumnRenamed("i", "block").groupBy("g", "block")).applyInPandas(over, schema)


def _path_rows(own: pd.DataFrame, paths, up) -> pd.DataFrame:
    pairs = [(a + up["shape"], b + up["siblings"]) for a, b in paths]
    return pd.DataFrame({"g": own["g"], "i": own["i"], "shape": [a for a, _ in pairs], "siblings": [b for _, b in pairs]})


def _down(levels: list[DataFrame], above: DataFrame, deep: int) -> DataFrame:
    """Paths (g, i, shape, siblings) of the nodes of the first of ``levels``, from those of their groups' roots."""
    for nodes in reversed(levels):
        above = _with_paths(nodes, above, _path_rows, "g long, i long, shape string, siblings string", deep)
    return above


def proofs(rows: DataFrame, group: str, order: str, run: Callable[[pd.DataFrame, Iterator[tuple[str, str]]], pd.DataFrame] | None = None, schema: str | None = None, deep: int = DEPTH) -> DataFrame:
    """The path of each row of ``rows``, which have a group, an order column and ``node``, the leaf's digest.

    Returns the columns of ``rows`` with ``subroot``, ``root``, ``shape`` and ``siblings``
    (see :func:`traverse`).  With ``run`` and ``schema``, what ``run(rows of a block with
    subroot and root, their paths)`` makes of it, so that paths never leave the task.
    """
    numbered_rows = numbered(rows, group, order, "node")
    groups = numbered(numbered_rows.select(group).distinct().withColumn("_all", F.lit(0).cast("long")), "_all", group)
    groups = settle(groups.select(F.col(group).alias("_group"), F.col("i").alias("g"), "_all"))
    few = broadcast_within(groups, 32, F.coalesce(F.octet_length(F.col("_group").cast("string")), F.lit(0)))
    nodes = numbered_rows.join(few, F.col(group).eqNullSafe(F.col("_group"))).drop("_group", "_all")
    levels = tiers(nodes, deep)
    if len(levels) == 1:
        levels.append(nodes.select("g", "i", "n", "node"))
    subroots = levels[-1]
    n_groups = groups.count()
    top = tiers(subroots.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("i"), F.lit(n_groups).cast("long").alias("n"), "node"), deep)
    found = top[-1].select("node").first()
    root = found[0] if found else ""
    above = top[-1].select("g", "i", F.lit("").alias("shape"), F.lit("").alias("siblings"))
    above = _down(top[:-1], above, deep).select(F.col("i").alias("g"), F.lit(0).cast("long").alias("i"), "shape", "siblings")
    above = _down(levels[1:-1], above, deep).join(subroots.select(F.col("g").alias("_g"), F.col("node").alias("subroot")), F.col("g") == F.col("_g")).drop("_g")
    names = rows.columns

    def made(own: pd.DataFrame, paths, up) -> pd.DataFrame:
        own = own[names].assign(subroot=up["subroot"] if up is not None else None, root=root)
        joined = ((a + up["shape"], b + up["siblings"]) for a, b in paths)
        if run is not None:
            return run(own, joined)
        pairs = list(joined)
        return own.assign(shape=[a for a, _ in pairs], siblings=[b for _, b in pairs])

    if schema is None:
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "subroot string, root string, shape string, siblings string"])
    return _with_paths(nodes, above, made, schema, deep)


def _digests(own: pd.DataFrame, paths) -> pd.DataFrame:
    proof, folded = [], []
    for node, other, (shape, siblings) in zip(own["node"], own["tampered"], paths):
        proof.append(sha256(siblings.encode()).hexdigest())
        folded.append(fold(other or node, shape, siblings))
    out = own.rename(columns={"node": "leaf"}).assign(proof_sha256=proof, folded_root=folded)
    out["verified"] = out["folded_root"] == out["root"]
    return out[["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]]


def checked(docs: DataFrame, deep: int = DEPTH) -> DataFrame:
    """Manifest of ``documents`` by language, each row's path checked; where 3 divides the id's crc32, against a text whose A-Z are lower-cased."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    whole = lambda text: leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    lower = F.translate("text", upper, upper.lower())
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    rows = docs.select("doc_id", "lang", whole(F.col("text")).alias("node"), F.when(hit, whole(lower)).alias("tampered"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return proofs(rows, "lang", "doc_id", _digests, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean", deep)


#: DuckDB SQL of :func:`checked` on ``documents``: a recursive query for the levels of each language, another for those above.
CHECKED_SQL = """
WITH RECURSIVE table8 AS (
  SELECT list_transform(range(256), lambda x: list_reduce(list_concat([x], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
docs AS (
  SELECT doc_id, source, lang, n_chars, text,
         list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, c: xor(t[1 + (xor(a, c) & 255)]::BIGINT, a >> 8)) AS crc
  FROM documents, table8),
texts AS (
  SELECT doc_id, lang, coalesce(xor(crc, 4294967295) % 3 = 0, false) AS hit, list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR], lambda x: coalesce(strlen(x) || ':' || x, '-')) AS head, text,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM docs),
leaves AS (
  SELECT doc_id, lang, sha256(array_to_string(head, '') || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(array_to_string(head, '') || CASE WHEN hit THEN coalesce(strlen(low) || ':' || low, '-') ELSE coalesce(strlen(text) || ':' || text, '-') END) AS shown FROM texts),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
tree(lang, level, i, node, n) AS (
  SELECT lang, 0, i, leaf, count(*) OVER (PARTITION BY lang) FROM placed
  UNION ALL
  SELECT lang, level + 1, i // 8, sha256(string_agg(node, '' ORDER BY i)), (n + 7) // 8 FROM tree WHERE n > 1 GROUP BY lang, level, n, i // 8),
subroots AS (
  SELECT lang, node AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS r FROM tree WHERE n = 1),
over_all(level, i, node, n) AS (
  SELECT 0, r, subroot, count(*) OVER () FROM subroots
  UNION ALL
  SELECT level + 1, i // 8, sha256(string_agg(node, '' ORDER BY i)), (n + 7) // 8 FROM over_all WHERE n > 1 GROUP BY level, n, i // 8),
top AS (SELECT node AS root, level AS height FROM over_all WHERE n = 1),
runs AS (SELECT lang, level, i // 8 AS run, string_agg(node, '' ORDER BY i) AS nodes FROM tree WHERE n > 1 GROUP BY lang, level, i // 8),
top_runs AS (SELECT level, i // 8 AS run, string_agg(node, '' ORDER BY i) AS nodes FROM over_all WHERE n > 1 GROUP BY level, i // 8),
path(doc_id, lang, leaf, level, pos, proof, folded) AS (
  SELECT doc_id, lang, leaf, 0, i, '', shown FROM placed
  UNION ALL
  SELECT doc_id, p.lang, leaf, p.level + 1, p.pos // 8, proof || substr(nodes, 1, 64 * (p.pos % 8)) || substr(nodes, 64 * (p.pos % 8) + 65),
         sha256(substr(nodes, 1, 64 * (p.pos % 8)) || folded || substr(nodes, 64 * (p.pos % 8) + 65))
  FROM path p JOIN runs r ON r.lang IS NOT DISTINCT FROM p.lang AND r.level = p.level AND r.run = p.pos // 8),
upper_path(doc_id, leaf, subroot, level, pos, proof, folded) AS (
  SELECT doc_id, leaf, subroot, 0, r, proof, folded FROM path p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang AND s.height = p.level
  UNION ALL
  SELECT doc_id, leaf, subroot, p.level + 1, p.pos // 8, proof || substr(nodes, 1, 64 * (p.pos % 8)) || substr(nodes, 64 * (p.pos % 8) + 65),
         sha256(substr(nodes, 1, 64 * (p.pos % 8)) || folded || substr(nodes, 64 * (p.pos % 8) + 65))
  FROM upper_path p JOIN top_runs r ON r.level = p.level AND r.run = p.pos // 8)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM upper_path JOIN top ON upper_path.level = top.height
"""
