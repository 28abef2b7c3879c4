"""Vector codes, Merkle manifests and SentencePiece coding: against brute force, plain trees and the library."""

import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arterial.llm import codes, imatch, merkle, pieces, queries

NAN, INF = float("nan"), float("inf")

# ---- 11


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """The contract, one vector at a time."""
    keep = [(i, [max(-codes.MOST, min(codes.MOST, math.floor(256 * x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    m = -(-max((len(v) for _, v, _ in keep), default=0) // parts)
    keep = [(i, v + [0] * (m * parts - len(v)), label) for i, v, label in keep]
    seeds = sorted(keep, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[s[1][j * m : (j + 1) * m] for s in seeds] for j in range(parts)]
    near = lambda p, book: min((sum((a - b) ** 2 for a, b in zip(p, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for j in range(parts):
            got = {}
            for _, v, _ in keep:
                p = v[j * m : (j + 1) * m]
                got.setdefault(near(p, books[j])[1], []).append(p)
            for e, own in got.items():
                books[j][e] = [sum(c) // len(own) for c in zip(*own)]
    out, sums = [], {}
    for i, v, label in keep:
        best = [near(v[j * m : (j + 1) * m], books[j]) for j in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), label))
        sums[label] = sums.get(label, 0) + out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, code, error, sums[label], digest) for i, code, error, label in out), key=str)


def coded(df, **more):
    out = codes.compress(df, "vec_id", "embedding", "label", **more)
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize("m", [0, 1, 2, 3, 4, 7, 8, 48])
@pytest.mark.parametrize("size", [1, 6, 1000, codes.MOST])
def test_bounds_never_lose_the_nearest_entry(m, size):
    rng = np.random.default_rng(m + size)
    entries, rows = rng.integers(-size, size + 1, (64, m)), rng.integers(-size, size + 1, (700, m))
    entries[40] = entries[3]
    rows[:64] = entries
    index, distance, tried = codes.Codebook(entries).nearest(rows)
    full = ((rows[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (index == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
    assert m != 1 or size < 1000 or tried < full.size / 8  # bounds do spare work where they are tight


def test_codes_of_the_table_are_those_of_a_full_search(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet").limit(150)
    rows = [tuple(r) for r in df.collect()]
    assert coded(spark.createDataFrame(rows, df.schema)) == plain_codes(rows)


def test_codes_of_odd_rows(spark):
    rng = random.Random(1)
    vector = lambda n: [rng.uniform(-1, 1) for _ in range(n)]
    rows = [(i, vector(20), i % 3) for i in range(90)] + [(200, None, 1), (201, [NAN] * 20, 1), (202, [1.0, None], 1), (203, [INF, 1.0], 2), (204, [], 2), (205, vector(33), None), (206, [1e9, -1e9], None), (3, vector(20), 1), (3, vector(20), 1), (None, vector(20), None)]
    rows += rows[:2]
    schema = "vec_id long, embedding array<double>, label int"
    df = spark.createDataFrame(rows, schema).withColumns({"error": F.lit("clash"), "code": F.lit(1), "id": F.lit(2)})
    assert coded(df.repartition(5)) == plain_codes(rows)
    assert coded(spark.createDataFrame([], schema)) == [] and coded(spark.createDataFrame(rows[90:93], schema)) == []
    few = [(9, [0.5] * 16, None), (4, [0.25] * 16, None)]
    assert coded(spark.createDataFrame(few, schema)) == plain_codes(few)


def test_codes_decode_to_entries(spark, sf):
    rows = codes.scaled(spark.read.parquet(f"{sf}/embeddings.parquet"), "vec_id", "embedding", "label", 256)
    books = codes.fit_codebooks(rows)
    for r in codes.decode(codes.encode(rows, books), books).limit(20).collect():
        entries = [int(r["code"][2 * j : 2 * j + 2], 16) for j in range(16)]
        assert r["vector"] == [x / 256 for j, e in enumerate(entries) for x in books[j, e]]


# ---- 12


def plain_proof(levels, i):
    out = []
    for level in levels[:-1]:
        run = i // 8 * 8
        out += [x for j, x in enumerate(level[run : run + 8], run) if j != i]
        i //= 8
    return out


def tree_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([hashlib.sha256("".join(levels[-1][i : i + 8]).encode()).hexdigest() for i in range(0, len(levels[-1]), 8)])
    return levels


@pytest.mark.parametrize("n", [1, 2, 8, 9, 63, 64, 65, 511, 512, 513, 4096])
def test_traversal_gives_every_path(n):
    leaves = [hashlib.sha256(b"%d" % i).hexdigest() for i in range(n)]
    levels = tree_of(leaves)
    for i, (shape, siblings) in enumerate(merkle.traverse(leaves, merkle.depth(n))):
        if n < 600 or i % 61 == 0:
            assert siblings == "".join(plain_proof(levels, i))
        assert merkle.fold(leaves[i], shape, siblings) == levels[-1][0]
    assert merkle.root_of(leaves, merkle.depth(n)) == levels[-1][0]


def test_traversal_holds_few_nodes(monkeypatch):
    most = 0
    step = merkle._Subtree.step

    def watched(self):
        nonlocal most
        step(self)
        most = max(most, sum(map(len, self.kept.values())) + sum(map(len, self.open)))

    monkeypatch.setattr(merkle._Subtree, "step", watched)
    list(merkle.traverse(["0" * 64] * 4096, 4))
    assert most <= 64 + 8 + 8 * 5  # a subtree of two levels and open runs, not 4,096 leaves


def test_an_edited_leaf_or_path_is_found():
    leaves = [hashlib.sha256(b"%d" % i).hexdigest() for i in range(70)]
    root = tree_of(leaves)[-1][0]
    shape, siblings = list(merkle.traverse(leaves, merkle.depth(70)))[69]
    assert merkle.fold(leaves[69], shape, siblings) == root
    assert merkle.fold(leaves[0], shape, siblings) != root and merkle.fold(leaves[69], shape, "0" + siblings[1:]) != root


def plain_manifest(rows):
    """The contract: one row at a time."""
    h = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: h([part(v) for v in (r[0], r[3], r[2], r[4], t)])
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0], leaf(r, r[1]), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree_of([x[1] for x in sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]) for g in order}
    top = tree_of([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, (doc, node, r) in enumerate(sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))):
            siblings = plain_proof(trees[g], i) + plain_proof(top, k)
            hit = doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0
            lower = r[1].translate({c: c + 32 for c in range(65, 91)}) if hit and r[1] is not None else r[1]
            out.append((doc, node, trees[g][-1][0], top[-1][0], h(siblings), leaf(r, lower) == node))
    return sorted(out, key=str)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_manifest_of_odd_rows(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, "", "Abc É", "plain", "X" * 3000]), rng.choice(["en", "en", "en", None, "", "zz", "é"]), rng.choice([None, "web"]), rng.choice([None, 3])) for i in range(200)]
    rows += [(None, "A", "en", None, 1), (None, "B", "en", None, 1), (7, "same", "en", "s", 1), (7, "same", "en", "s", 1), (7, "Other", "en", "s", 1), (-5, "Z", "alone", None, None)]
    df = spark.createDataFrame(rows, DOCS).withColumns({"node": F.lit(1), "i": F.lit("clash"), "_at": F.lit(0)}).repartition(5)
    got = sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["verified"]) for r in merkle.checked(df, 1).collect()), key=str)
    assert got == plain_manifest(rows)  # over blocks of one level, so that there are several tiers
    assert all((r["folded_root"] == r["root"]) == r["verified"] for r in merkle.checked(df).collect())


def test_manifests_of_no_and_of_one_row(spark):
    assert merkle.checked(spark.createDataFrame([], DOCS)).collect() == []
    r = merkle.checked(spark.createDataFrame([(1, "a", None, None, None)], DOCS)).first()
    assert r["leaf"] == r["subroot"] == r["root"] and r["proof_sha256"] == hashlib.sha256(b"").hexdigest()


def test_paths_themselves_are_returned(spark):
    leaves = [hashlib.sha256(b"%d" % i).hexdigest() for i in range(20)]
    df = spark.createDataFrame([("g", i, x) for i, x in enumerate(leaves)], "g string, k int, node string").withColumnRenamed("g", "grp")
    levels = tree_of(leaves)
    for r in merkle.proofs(df, "grp", "k").collect():
        assert r["siblings"] == "".join(plain_proof(levels, r["k"])) and r["root"] == levels[-1][0] and merkle.fold(r["node"], r["shape"], r["siblings"]) == r["root"]


@pytest.mark.parametrize("name, table", [("op11_vector_codes", "embeddings"), ("op12_merkle", "documents")])
def test_queries_agree_with_sql(spark, sf, name, table):
    df = queries.QUERIES[name](spark, sf)
    c = duckdb.connect()
    c.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    result = c.execute(queries.ORACLES[name])
    cols = [x[0] for x in result.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(str, result.fetchall())) == sorted(str(tuple(r[x] for x in cols)) for r in df.collect())


# ---- 13


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path(queries.PIECE_MODEL))


@pytest.fixture(scope="module")
def model():
    return pieces.Model(pieces._read(queries.tokenizer_path(queries.PIECE_MODEL)))


def odd_texts(n):
    rng = random.Random(n)
    kinds = ["abcdefgh", "aeiou tnsr", "the and ing tion ", "日本語中文ひらがな한국", "\t\n  ▁ é́😀\U0010ffff", "0123456789.-/", "<s></s><0x0A><unk>", "aaaa", "     ab", " 　﻿\x00\x01"]
    return ["".join(rng.choice(rng.choice(kinds)) if rng.random() < 0.5 else rng.choice(kinds[rng.randrange(3)]) for _ in range(rng.choice([0, 1, 2, 5, 20, 100, 400]))) for _ in range(n)]


LONG = ["a" * 5000, " " * 5000, "ab" * 3000, "-" * 3000, "=_" * 2000, "".join(random.Random(9).choice("aeinrst") for _ in range(20_000))]


@pytest.mark.parametrize("short", [64, 2])
def test_pieces_are_those_of_the_library(library, model, monkeypatch, short):
    monkeypatch.setattr(pieces, "SHORT", short)
    texts = odd_texts(1500) + LONG
    ids, offsets = model.encode_batch(pa.array(texts))
    want = library.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == want
    assert [str(x, "utf-8") for x in model.decode_batch(ids, offsets)] == [library.decode(w) for w in want]


def test_any_ids_decode_as_in_the_library(library, model):
    rng = random.Random(4)
    for _ in range(4000):
        ids = [rng.choice([0, 1, 2, 29871, 35, 227, 132, 133, 200, 243, 259]) if rng.random() < 0.5 else rng.randrange(3, 259) if rng.random() < 0.6 else rng.randrange(32_000) for _ in range(rng.randrange(9))]
        assert model.decode(ids) == library.decode(ids)
    assert model.decode([-1, 5, 10**6]) == library.decode([5])


def test_a_long_word_without_a_place_to_cut_stays_fast(model):
    import time

    rng = random.Random(5)
    began = time.perf_counter()
    model.encode("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000)))
    assert time.perf_counter() - began < 60


def test_coding_of_odd_rows(spark, library):
    path = queries.tokenizer_path(queries.PIECE_MODEL)
    texts = [None, "", " ", "  two  blanks ", "naïve 東京 \x01", "same", "same", *LONG[:2]]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumns({"ids": F.lit("old"), "a.b": F.lit(1)})
    rows = {r["i"]: r for r in pieces.encode(df, "text", path).collect()}
    assert all(rows[i]["ids"] == library.encode(t or "", add_bos=True, add_eos=True) and rows[i]["a.b"] == 1 for i, t in enumerate(texts))
    back = pieces.decode(pieces.encode(df, "text", path), "ids", path)
    assert {r["i"]: r["decoded"] for r in back.collect()} == {i: library.decode(library.encode(t or "", add_bos=True, add_eos=True)) for i, t in enumerate(texts)}
    digest = {r["i"]: r for r in pieces.round_trip(df, "text", path).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        assert digest[i]["n_tokens"] == len(ids) and digest[i]["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert digest[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert pieces.round_trip(df.limit(0), "text", path).count() == 0
    lists = spark.createDataFrame([(None,), ([],), ([None, 5, 306],)], "ids array<int>")
    assert sorted(r["decoded"] for r in pieces.decode(lists, "ids", path).collect()) == sorted(["", "", library.decode([5, 306])])


def test_other_models_are_refused(model):
    def field(number, value):
        head = bytes([number << 3 | 2]) if number < 16 else bytes([(number << 3 & 127) | 2 | 128, number >> 4])
        return head + bytes([len(value)]) + value

    byte_pieces = b"".join(field(1, field(1, f"<0x{b:02X}>".encode()) + b"\x18\x06") for b in range(256))
    fallback = b"\x98\x02\x01"
    plain = b"\x20\x00"
    pieces.Model(byte_pieces + field(2, b"\x18\x02" + fallback) + field(3, plain))
    for bad in (
        byte_pieces + field(2, fallback) + field(3, plain),
        byte_pieces + field(2, b"\x18\x02") + field(3, plain),
        byte_pieces + field(2, b"\x18\x02" + fallback),
        byte_pieces + field(2, b"\x18\x02" + fallback) + field(3, plain + field(2, b"map")),
        byte_pieces + field(1, field(1, b"x") + b"\x18\x04") + field(2, b"\x18\x02" + fallback) + field(3, plain),
    ):
        with pytest.raises(ValueError):
            pieces.Model(bad)


# ---- 3


def test_lexicons_in_turn_give_their_own_fingerprints(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.sample(words, 12)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3).cache()
    for turn in range(10):
        listed = rng.sample(words, 25)
        lexicon = spark.createDataFrame([(w,) for w in listed], "term string")
        plain = imatch.Lexicon(listed)
        got = {r["i"]: r["fp"] for r in imatch.fingerprints(docs, {"text": "fp"}, lexicon).collect()}
        assert got == {i: plain.fingerprint(t) for i, t in enumerate(texts)}, turn


# ---- mended


def test_a_label_column_of_the_same_name_does_not_clash(spark):
    from arterial.llm import toxicity

    docs = spark.createDataFrame([(i, f"{'vile rot' if i % 2 else 'kind day'} {i}", 9, "x") for i in range(60)], "doc_id long, text string, toxic int, _where string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, "doc_id", "text", "toxic", F.col("doc_id") % 3 != 0)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, "text", model).collect()}
    assert min(got[i] for i in range(60) if i % 2) > max(got[i] for i in range(60) if not i % 2)


def test_centres_of_many_pairs_are_dealt_over_copies(spark, monkeypatch):
    from arterial.llm import jaccard_join

    rng = random.Random(7)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(90):
        own = list(base)
        own[rng.randrange(120)] = f"x{rng.random()}"
        texts.append(" ".join(own))
    texts += [" ".join(rng.choice(base) for _ in range(50)) for _ in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = {tuple(r) for r in jaccard_join.similarity_components(docs).collect()}
    monkeypatch.setattr(jaccard_join, "HEAVY", 4)
    assert {tuple(r) for r in jaccard_join.similarity_components(docs).collect()} == plain
    assert len({c for _, _, c in plain}) < 100


def test_spans_tell_where_they_come_from(spark):
    from arterial.llm import pii

    docs = spark.createDataFrame([(1, "mail a@b.org token = \"abcdefgh12345678\""), (2, "none")], "doc_id long, text string")
    got = {(r["kind"], r["added"], r["learned"]) for r in pii.extract(docs, "doc_id", "text").collect()}
    assert got == {("email", False, False), ("secret", True, False)}


def test_clashing_columns_of_ranges_are_an_error(spark):
    with pytest.raises(ValueError):
        queries.id_buckets(spark.createDataFrame([(1, 2)], "doc_id long, bucket int"), "doc_id")


def test_other_vocabularies_are_refused():
    import json

    from arterial.llm import bpe

    spec = json.loads(bpe._read(queries.tokenizer_path(queries.BPE_VOCABULARY)))
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {**spec["pre_tokenizer"], "add_prefix_space": True}}, {"model": {**spec["model"], "ignore_merges": True}}, {"added_tokens": [{**spec["added_tokens"][0], "lstrip": True}]}):
        with pytest.raises(ValueError):
            bpe.Codec(json.dumps(spec | change))
