"""URL filter: rules first, gradient-boosted trees on lexical features for the rest.

Training labels are URLs with a known verdict (in the query: those that a rule
decides).  Features are lexical: lengths, depth, digit ratio, character entropy,
parameter counts, and statistics of the host's suffix in the training rows.  All
feature work is column expressions; the trees are Spark's own.

Defined results: a URL that is null or has no ``://`` has empty host and path, no
rule, and is judged by the trees like any other; with no labelled rows, or labels
of one kind only, the trees are replaced by that kind (``allow`` if none); extra
columns pass through, and columns of the output names are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkernels import broadcast_within, settle

#: (verdict, host, path)
Rule = tuple[str, str, str]
FEATURES = ("n_url", "n_host", "n_path", "depth", "labels", "digits", "entropy", "params", "marks", "secure", "suffix_n", "suffix_blocked")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits; null where none does.  ``rules`` is a short list and becomes one CASE."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _entropy(text: Column) -> Column:
    """Bits per character over the characters of a text: sorted, they form runs, whose lengths are the counts."""
    chars = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    n = F.greatest(F.size(chars), F.lit(1)).cast("double")
    runs = F.split(F.array_join(chars, ""), r"(?s)(?<=(.))(?!\1)")
    return F.aggregate(runs, F.lit(0.0), lambda acc, r: acc - F.when(r == "", 0.0).otherwise(F.char_length(r) / n * F.log2(F.greatest(F.char_length(r), F.lit(1)) / n)))


def with_features(pages: DataFrame, url_col: str) -> DataFrame:
    """Add ``host``, ``path``, ``suffix`` and the lexical features but the suffix statistics."""
    url = F.coalesce(F.col(f"`{url_col}`"), F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    rows = pages.withColumns({"host": host_of(F.col(f"`{url_col}`")), "path": path_of(F.col(f"`{url_col}`"))})
    count = lambda text, chars: F.length(F.regexp_replace(text, f"[^{chars}]", "")).cast("double")
    n = F.greatest(F.length(url), F.lit(1))
    return rows.withColumns({
        "suffix": F.substring_index("host", ".", -2),
        "n_url": F.length(url).cast("double"),
        "n_host": F.length("host").cast("double"),
        "n_path": F.length("path").cast("double"),
        "depth": count(F.col("path"), "/"),
        "labels": count(F.col("host"), "."),
        "digits": count(url, "0-9") / n,
        "entropy": _entropy(url),
        "params": F.when(query == "", 0.0).otherwise(count(query, "&") + 1),
        "marks": count(url, "%=_-"),
        "secure": url.startswith("https").cast("double"),
    })


#: Parts of the labelled rows; the suffix statistics of a row leave out those of its own part, so that its label is not among its features.
FOLDS = 5


def _with_suffix_statistics(rows: DataFrame, sure: Column) -> DataFrame:
    """Add ``suffix_n`` and ``suffix_blocked`` (smoothed share) over all rows with a ``label``; for those rows over the other folds, scaled to all."""
    per = settle(rows.where("label is not null").groupBy("suffix", "fold").agg(F.count("*").cast("double").alias("n"), F.sum("label").alias("s")))
    whole = per.groupBy("suffix").agg(F.sum("n").alias("all_n"), F.sum("s").alias("all_s"))
    stats = whole.join(per, "suffix").select("suffix", "fold", "all_n", "all_s", "n", "s")
    every = whole.select("suffix", F.lit(-1).alias("fold"), "all_n", "all_s", F.lit(0.0).alias("n"), F.lit(0.0).alias("s"))
    stats = settle(stats.unionByName(every))
    at = rows.withColumn("fold", F.when(sure, F.col("fold")).otherwise(F.lit(-1))).join(broadcast_within(stats, 80), ["suffix", "fold"], "left")
    n, s = F.coalesce(F.col("all_n") - F.col("n"), F.lit(0.0)), F.coalesce(F.col("all_s") - F.col("s"), F.lit(0.0))
    return at.withColumns({"suffix_n": F.when(sure, n * FOLDS / (FOLDS - 1)).otherwise(n), "suffix_blocked": (s + 1) / (n + 2)}).drop("all_n", "all_s", "n", "s")


def filter_urls(pages: DataFrame, id_col: str, url_col: str, rules: Sequence[Rule], train_rows: int = 50_000, trees: int = 20, depth: int = 3, seed: int = 7) -> DataFrame:
    """Add ``host, path, rule, verdict, score`` (chance of block by the trees).

    ``train_rows`` bounds the sample of labelled rows that the trees are fitted on,
    chosen by a hash of the id, so that reruns agree; both verdicts weigh the same in the
    fit.  Suffix statistics cover all labelled rows.  Features are computed once and settled.
    """
    made = ["host", "path", "rule", "verdict", "score"]
    kept = [c for c in pages.columns if c not in made or c == url_col]
    base = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.col(f"`{url_col}`").alias("_url"), F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{url_col}`")).alias("_hash"))
    rows = with_features(base, "_url")
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict, "label": (verdict == "block").cast("double"), "fold": F.pmod(F.xxhash64("_hash", F.lit(seed)), F.lit(FOLDS)).cast("int")}).drop("_url")
    rows = settle(rows)
    seen = {r["label"]: r["n"] for r in rows.where("label is not null").groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(seen) < 2:
        only = "block" if seen.get(1.0) else "allow"
        rows = rows.withColumn("score", F.lit(float(only == "block")))
    else:
        rows = _with_suffix_statistics(rows, F.col("label").isNotNull())
        model = fit_trees(rows.where("label is not null"), train_rows, trees, depth, seed)
        scored = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows))
        rows = scored.withColumn("score", vector_to_array("probability")[1])
    chosen = F.coalesce("ruled", F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return rows.select(*[F.col("_row")[c].alias(c) for c in kept if c not in ("host", "path")], "host", "path", "rule", chosen.alias("verdict"), "score")


def fit_trees(labelled: DataFrame, train_rows: int, trees: int, depth: int, seed: int) -> GBTClassificationModel:
    """Trees on FEATURES of a sample of at most about ``train_rows`` rows of ``labelled``, drawn by ``_hash``; the two labels weigh the same."""
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n = sum(counts.values())
    draw = F.pmod(F.col("_hash"), F.lit(1 << 20)) < int(min(1.0, train_rows / max(n, 1)) * (1 << 20))
    weight = F.when(F.col("label") == 1, n / 2 / counts.get(1.0, n)).otherwise(n / 2 / counts.get(0.0, n))
    sample = labelled.where(draw).withColumn("weight", weight)
    train = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample).select("features", "label", "weight")
    return GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, maxBins=64, stepSize=0.3, weightCol="weight").fit(train)
