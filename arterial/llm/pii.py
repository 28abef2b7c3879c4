"""Personal data: fixed patterns as seeds, and bootstrapped contextual extraction.

Seeds are what the base patterns find, and credentials in the forms that are published
or assigned by name (``token = "..."``).  The words beside each identifier-like token
are its lexical patterns.  Patterns and instances form a graph that Spark scores in
rounds: a pattern is as good for a kind as the share of its instances believed to be of
that kind (those that may be count less against it than those that can't); an instance is believed by the patterns it stands in (noisy or).  Instances
that are believed count as seeds of the next round, so they induce patterns in turn;
rounds end when none is added.  Belief only grows, so they do end.  Identifier-like
tokens that no base pattern knows are added where a high-confidence pattern introduces
them and they are believed.

Defined results: null counts as empty; texts without identifiers have no spans; spans
belong to a row, which is told by its id and its text, so rows of one id with different
texts keep their own spans, repeated rows have the same, and rows with a null id are
rows like others; spans are in code points, end exclusive; added spans never overlap
base spans; extra columns are kept or ignored as each function says, whatever their
names; empty tables give empty results.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkernels import broadcast_within, mapped, runs, settle

#: Kinds of the base patterns, and those that only the method adds.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
#: The base patterns.  The look-behind and the possessive counts change no match; they keep long runs linear.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile("[0-9]")
_NO_DIGITS = re.compile("[^0-9]+")
#: Identifier-like: a token with a digit or an at sign, or an at sign spelt out in brackets.
_TOKEN = re.compile(r"\S+")
_MARK = re.compile("[0-9@]")
_AT = re.compile(r"[\[(]\s?at\s?[\])]", re.I)
#: The look-behind lets a match begin at the start of a run only, which keeps long runs linear.
_SPELT = re.compile(r"(?<![^\s\[(])[^\s\[(]++\s?" + _AT.pattern + r"\s?\S+", re.I)
#: Seeds of credentials: published forms of access keys, and quoted values assigned to a telling name.
_SECRET_FORMS = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36})(?![A-Za-z0-9])")
_SECRET_GIVEN = re.compile(r"""\b(?:password|passwd|secret|token|api[_-]?key)["']?\s?[:=]\s?["']([^\s"']{8,})["']""", re.I)
_SECRET_LIKE = re.compile(r"(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9+/_=.-]{16,}\Z")
_EDGES = ".,;:!?()[]{}<>\"'"
_QUOTES = "()[]{}<>\"'"


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by kind as listed, then start."""
    out: list[tuple[str, int, int]] = []
    if not text:
        return out
    out += [("email", a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _NO_DIGITS.sub("", m.group())
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NO_DIGITS.sub("", m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def secret_seeds(text: str) -> list[tuple[int, int]]:
    """Ascending spans of credentials in a published form or assigned by name."""
    spans = [m.span() for m in _SECRET_FORMS.finditer(text)] if "AKIA" in text or "gh" in text else []
    if "=" in text or ":" in text:
        spans += [m.span(1) for m in _SECRET_GIVEN.finditer(text)]
    return apart(sorted(spans), [])


def apart(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ascending spans that overlap neither an earlier one kept nor any of ``taken`` (ascending)."""
    out, at, reach, last = [], 0, 0, 0
    for a, b in spans:
        # reach: the farthest end of the taken spans that begin before b
        while at < len(taken) and taken[at][0] < b:
            reach = max(reach, taken[at][1])
            at += 1
        if a >= last and a >= reach:
            out.append((a, b))
            last = b
    return out


def _candidates(text: str) -> list[tuple[int, int]]:
    """Ascending spans of identifier-like tokens, trimmed of punctuation at the edges."""
    spans = [m.span() for m in _TOKEN.finditer(text) if _MARK.search(m.group())]
    if _AT.search(text):
        spans = sorted(spans + [m.span() for m in _SPELT.finditer(text)])
    out = []
    for a, b in spans:
        token = text[a:b]
        a, b = a + len(token) - len(token.lstrip(_EDGES)), b - len(token) + len(token.rstrip(_EDGES))
        if a < b and (not out or a >= out[-1][1]):
            out.append((a, b))
    return out


def _name(text: str) -> str:
    """What tells instances and words apart: lower case, a digest where it is long."""
    low = text.lower()
    return low if len(low) <= 80 else "# " + hashlib.sha256(low.encode("utf-8", "surrogatepass")).hexdigest()


def words_before(text: str, low: int, end: int) -> list[str]:
    """The last two words of ``text[low:end]``, the nearest first, stripped of quotes and brackets; read backwards in growing windows."""
    width = 128
    while True:
        start = max(low, end - width)
        words = [w for w in (x.strip(_QUOTES) for x in text[start:end].split()) if w]
        if start == low or len(words) > 2:  # the first word of a window may be cut
            return words[:-3:-1]
        width *= 4


def contexts(text: str, spans: list[tuple[int, int]]) -> list[list[str]]:
    """Lexical patterns of each of the ascending spans: the word before, the two words before, and the word before with the word after.

    Words are whole, stripped of quotes and brackets; ``#`` stands for another span, ``^``
    and ``$`` for the ends of the text.  Only the gaps between spans are read, so the work
    is linear in the text.
    """
    groups: list[tuple[int, int, int]] = []  # (first span, past the last, end) of runs of overlapping spans
    for i, (a, b) in enumerate(spans):
        if groups and a < groups[-1][2]:
            groups[-1] = (groups[-1][0], i + 1, max(groups[-1][2], b))
        else:
            groups.append((i, i + 1, b))
    out: list[list[str]] = []
    for g, (first, past, end) in enumerate(groups):
        low = groups[g - 1][2] if g else 0
        high = spans[groups[g + 1][0]][0] if g + 1 < len(groups) else len(text)
        edge = ("#", "#") if g else ("^", "^")
        before = map(_name, words_before(text, low, spans[first][0]))
        one, two = (*before, *edge)[:2]
        after = "#" if g + 1 < len(groups) else "$"
        for m in _TOKEN.finditer(text, end, high):
            word = m.group().strip(_EDGES)
            if word:
                after = _name(word)
                break
        out += [[f"1 {one}", f"2 {two} {one}", f"3 {one} _ {after}"]] * (past - first)
    return out


def fits(kind: str, text: str) -> bool:
    """Whether a token may be a form of that kind that the base pattern does not know."""
    digits = len(_NO_DIGITS.sub("", text))
    if kind == "email":
        return "@" in text or _AT.search(text) is not None
    if kind == "ip":
        return text.count(".") >= 3 and digits >= 4 or text.count(":") >= 2 and re.fullmatch(r"[0-9A-Fa-f:.]+", text) is not None
    if kind == "secret":
        return _SECRET_LIKE.match(text) is not None
    return digits >= 12 if kind == "card" else 7 <= digits <= 15


def find(text: str | None) -> list[tuple[str | None, int, int]]:
    """(kind, start, end) of the seeds of a text, and of its other identifier-like tokens with no kind."""
    if not text or not (_MARK.search(text) or _AT.search(text)):
        return []
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    secrets = apart(secret_seeds(text), taken)
    taken = sorted(taken + secrets)
    return [*base, *(("secret", a, b) for a, b in secrets), *((None, a, b) for a, b in apart(_candidates(text), taken))]


MENTIONS = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.string())), ("may", pa.list_(pa.string()))])
MENTION_FIELDS = "id long, row long, kind string, start int, end int, instance string, patterns array<string>, may array<string>"
#: Characters of instances and patterns after which a task hands on what it has found.
_HELD = 1 << 20


def row_of(text: Column) -> Column:
    """What tells the rows of one id apart: a hash of the text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def mentions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every seed (with its kind) and every other identifier-like token (kind null), with its patterns and the kinds it may be."""
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), row_of(text).alias("row"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for batch in batches:
            for i, row, x in zip(batch.column(0), batch.column(1), batch.column(2)):
                text = x.as_py()
                found = sorted(find(text), key=lambda s: s[1:])
                if not found:
                    continue
                key = (i.as_py(), row.as_py())
                for (kind, a, b), patterns in zip(found, contexts(text, [s[1:] for s in found])):
                    token = text[a:b]
                    out.append((*key, kind, a, b, _name(token), patterns, [] if kind else [k for k in ALL_KINDS if fits(k, token)]))
                    held += 200
                    if held > _HELD:
                        yield pack(out)
                        out, held = [], 0
        if out:
            yield pack(out)

    def pack(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), MENTIONS)], schema=MENTIONS)

    return mapped(rows, run, MENTION_FIELDS)


#: What an instance that may be of a kind, but is not believed to be, counts against a pattern; one that can't be counts 1.
DOUBT = 0.25


def bootstrap(found: DataFrame, confidence: float = 0.8, belief: float = 0.8, support: int = 3) -> DataFrame:
    """Spans (id, row, kind, start, end) that the patterns add to the seeds in ``found``.

    ``support`` is the least number of different believed instances a pattern must have;
    a pattern's confidence for a kind is its believed instances over themselves, those that
    can't be of the kind, DOUBT times the rest, and one.  Patterns of at least half of
    ``confidence`` speak for an instance, those of at least ``confidence`` also introduce
    it.  Patterns with fewer instances than ``support`` can never matter and are left out
    once instances are counted.
    """
    all_edges = settle(found.select("instance", "kind", "may", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(F.max("kind").alias("kind"), F.max("may").alias("may")))
    is_open = F.col("kind").isNull()
    possible = F.array(*[F.count(F.when(is_open & F.array_contains("may", k), 1)) for k in ALL_KINDS])
    totals = settle(all_edges.groupBy("pattern").agg(F.count("*").alias("total"), possible.alias("possible")).where(F.col("total") >= support))
    edges = settle(all_edges.join(totals.select("pattern"), "pattern"))
    believed = settle(edges.where("kind is not null").select("instance", "kind").distinct())
    open_edges = edges.where(is_open).select("pattern", "instance", "may")
    ends = edges.select("pattern", "instance", is_open.cast("long").alias("open"))
    fresh = believed
    n = None
    while True:
        # only believed instances are counted, so each round adds those of the last
        more = ends.join(broadcast_within(fresh, 100), "instance").groupBy("pattern", "kind").agg(F.count("*").alias("n"), F.sum("open").alias("n_open"))
        n = settle(more if n is None else n.unionByName(more).groupBy("pattern", "kind").agg(F.sum("n").alias("n"), F.sum("n_open").alias("n_open")))
        place = F.array_position(F.array(*[F.lit(k) for k in ALL_KINDS]), F.col("kind")).cast("int")
        against = F.col("total") + 1 - (1 - DOUBT) * (F.element_at("possible", place) - F.col("n_open"))
        scored = n.where(F.col("n") >= support).join(totals, "pattern").select("pattern", "kind", (F.col("n") / against).alias("conf")).where(F.col("conf") >= confidence / 2)
        scored = settle(scored)
        offers = open_edges.join(broadcast_within(scored, 100), "pattern").where(F.array_contains("may", F.col("kind")))
        sure = offers.groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.ln(1 - F.col("conf"))))).alias("belief")).where(F.col("belief") >= belief)
        fresh = settle(sure.select("instance", "kind").join(believed, ["instance", "kind"], "left_anti"))
        if fresh.isEmpty():
            break
        believed = settle(believed.unionByName(fresh))
    rules = scored.where(F.col("conf") >= confidence).select("pattern", "kind")
    open_spans = found.where("kind is null").select("id", "row", "start", "end", "instance", F.explode("patterns").alias("pattern"), "may")
    kept = open_spans.join(broadcast_within(rules, 100), "pattern").where(F.array_contains("may", F.col("kind"))).join(believed, ["instance", "kind"], "left_semi")
    return kept.groupBy("id", "row", "start", "end").agg(F.min("kind").alias("kind")).select("id", "row", "kind", "start", "end")


def extract(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """(id, row, kind, start, end, added, learned) of all spans, repeated rows once; ``added`` tells those that no base pattern finds, ``learned`` those that the bootstrapped patterns do and no seed; ``row`` is :func:`row_of` the text."""
    found = settle(mentions(docs, id_col, text_col))
    seeds = found.where("kind is not null").select("id", "row", "kind", "start", "end", (~F.col("kind").isin(*KINDS)).alias("added"), F.lit(False).alias("learned"))
    return seeds.distinct().unionByName(bootstrap(found, **options).withColumns({"added": F.lit(True), "learned": F.lit(True)}))


def by_document(spans: DataFrame) -> DataFrame:
    """One row per (id, row): base counts by kind, ``base`` and ``spans`` as text, in the order of kind, then start."""
    order = F.array_position(F.array(*[F.lit(k) for k in ALL_KINDS]), F.col("kind"))
    item = F.struct(order.alias("o"), F.col("start"), F.col("end"), F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string")).alias("s"))
    text = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x["s"]), ",")
    counts = [F.count(F.when((F.col("kind") == k) & ~F.col("added"), 1)).alias(f"n_{k}") for k in KINDS]
    return spans.groupBy("id", "row").agg(*counts, text(F.collect_list(F.when(~F.col("added"), item))).alias("base"), text(F.collect_list(item)).alias("spans"), F.count(F.when(F.col("added"), 1)).alias("n_added"), F.count(F.when(F.col("learned"), 1)).alias("n_learned"))


def replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with each ascending span (start, end, kind) replaced by ``<KIND>``; of overlapping spans the first stands for all."""
    parts, at = [], 0
    for a, b, k in spans:
        if a >= at:
            parts += [text[at:a], f"<{k.upper()}>"]
        at = max(at, b)
    return "".join(parts) + text[at:]


def redact(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """``docs`` with every span that :func:`extract` finds replaced by ``<KIND>``; all rows and columns are kept, null texts too.

    Seeds are found again in the same pass; only the spans that the patterns add are joined.
    """
    found = settle(mentions(docs, id_col, text_col))
    spans = bootstrap(found, **options)
    added = settle(spans.groupBy(F.col("id").alias("_pii_id"), F.col("row").alias("_pii_row")).agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("_pii_spans")))
    plain = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)])
    place, key = docs.columns.index(text_col), docs.columns.index(id_col)
    joined = plain.join(broadcast_within(added, 64, F.size("_pii_spans") * 40), F.col(f"_c{key}").cast("long").eqNullSafe(F.col("_pii_id")) & (row_of(F.col(f"_c{place}")) == F.col("_pii_row")), "left").drop("_pii_id", "_pii_row")
    names = joined.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in runs(batch.column(place)):
                part = batch.slice(at, n)
                out = []
                for x, more in zip(part.column(place), part.column(part.num_columns - 1)):
                    text = x.as_py()
                    if text:
                        taken = [(a, b, k) for k, a, b in find(text) if k] + [(e["start"], e["end"], e["kind"]) for e in more.as_py() or ()]
                        text = replaced(text, sorted(taken)) if taken else text
                    out.append(text)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == place else part.column(i) for i in range(len(names) - 1)], names=names[:-1])

    return mapped(joined, run, T.StructType(list(plain.schema.fields))).toDF(*docs.columns)
