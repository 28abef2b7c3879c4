"""The corpus pipeline: every stage against a plain version on the smallest tables."""

import duckdb
import pytest

import corpus_pipeline
from arterial.llm import mixing, pii, queries
from tests.llm.test_operators import brute_bootstrap, brute_components, brute_pii, replaced


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Rows before and after each stage, each written and read again."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(900001, None, "en", None, None), (900002, "12 34 !", "en", "src1", 7), (900003, "", None, "src1", 0)], docs.schema)
    kept = [docs.unionByName(odd)]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, kept[-1], sf).write.parquet(str(folder / name))
        kept.append(spark.read.parquet(str(folder / name)))
    return kept


def test_contract(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "pii", "mixing", "bpe"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_language_rejects_what_has_no_letters(stages):
    before, after = ({r["doc_id"]: r for r in s.collect()} for s in stages[:2])
    assert set(before) - set(after) == {900001, 900002, 900003} and all(before[i] == after[i] for i in after)


def test_language_scores_are_plain_distances(stages):
    """Out-of-place distances by plain loops over strings, for every document of the table."""
    rows = stages[0].collect()
    kept = {r["doc_id"] for r in stages[1].collect()}
    counts = {}
    for r in rows:
        if r["text"] is not None and r["lang"] is not None:
            for g, n in plain_grams(r["text"]).items():
                own = counts.setdefault(r["lang"], {})
                own[g] = own.get(g, 0) + n
    profiles = {k: top(c) for k, c in counts.items()}
    for r in rows:
        own = top(plain_grams(r["text"] or ""))
        best = min((sum(abs(i - p[g]) if g in p else 400 for g, i in own.items()) for p in profiles.values()), default=0)
        assert (r["doc_id"] in kept) == (bool(own) and 1 - best / (400 * len(own)) >= corpus_pipeline.MIN_LANGUAGE_SCORE)


def plain_grams(text):
    """Counts of the 1- to 3-grams of letters with single spaces around words, without those that have a space alone or in the middle."""
    s = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text)
    s = " " + " ".join(s.split()) + " "
    out = {}
    if s.strip():
        for n in (1, 2, 3):
            for i in range(len(s) - n + 1):
                g = s[i : i + n]
                if g != " " and not (n == 3 and g[1] == " "):
                    out[g] = out.get(g, 0) + 1
    return out


def top(counts):
    """Rank of the 400 most frequent n-grams, ties as the operator orders them: by code, shorter and smaller first."""
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    return {g: i for i, g in enumerate(sorted(counts, key=lambda g: (-counts[g], code(g)))[:400])}


def test_one_document_of_each_group_stays(stages):
    rows = sorted(stages[1].collect(), key=lambda r: r["doc_id"])
    groups = brute_components([r["text"] for r in rows], 5, 80)
    assert {r["doc_id"] for r in stages[2].collect()} == {rows[i]["doc_id"] for i, (_, c) in groups.items() if c == i}


def test_personal_data_is_gone(stages):
    before, after = ({r["doc_id"]: r for r in s.collect()} for s in stages[2:4])
    assert before.keys() == after.keys()
    texts = {i: r["text"] for i, r in before.items()}
    spans = {i: [(a, b, k) for k, a, b in brute_pii(t)] + [(a, b, k) for k, a, b in pii.find(t) if k not in (None, *pii.KINDS)] for i, t in texts.items()}
    for i, a, b, k in brute_bootstrap(texts):
        spans[i].append((a, b, k))
    assert {i: r["text"] for i, r in after.items()} == {i: replaced(t, spans[i]) for i, t in texts.items()}
    assert all(not pii.base_spans(r["text"]) and r["n_chars"] == len(r["text"]) for r in after.values())


def test_mix_follows_the_sql(stages, sf, tmp_path):
    stages[3].write.parquet(str(tmp_path / "docs"))
    c = duckdb.connect()
    c.execute(f"create view docs as select * from '{tmp_path}/docs/*.parquet'")
    c.execute(f"create view labels as select * from '{sf}/labels.parquet'")
    cur = c.execute(mixing.oracle(queries.QUALITY_SQL, rows="docs"))
    cols = [x[0] for x in cur.description]
    want = {}
    for row in cur.fetchall():
        r = dict(zip(cols, row))
        if r["taken"]:
            want[r["doc_id"]] = r["taken"] // r["size"]
    got = {}
    for r in stages[4].collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == want


def test_tokens_are_the_library_s(stages):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path(queries.BPE_VOCABULARY))
    texts = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    rows = stages[5].collect()
    assert len(rows) == stages[4].count()
    for r in rows:
        assert r["ids"] == t.encode(texts[r["doc_id"]], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])
    assert all(r["exact"] for r in rows)


def test_odd_rows_pass_every_stage(spark, sf, tmp_path):
    """Null and repeated ids, identical rows, columns of clashing names, and an empty table."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, score string, n string"
    body = "the house and the garden of the old town were full of people who came to see the river and the trees"
    rows = [(1, body, "en"), (1, body, "en"), (1, body.replace("old", "new") + " there", "en"), (None, body.upper() + " x", "en"), (None, "quite another text about letters and words that nobody wrote before", "en"), (2, None, "en"), (3, "mail me at x@y.zz please because the garden is full", None)]
    docs = spark.createDataFrame([(i, t, k, "s", None, "a", "b", "c") for i, t, k in rows], schema)
    for table in (docs, docs.limit(0)):
        kept = table
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{table.count()}-{name}")
            stage(spark, kept, sf).write.parquet(path)
            before, kept = kept, spark.read.parquet(path)
            assert name == "bpe" or set(kept.columns) == set(before.columns)
            texts = [r["text"] for r in kept.collect()] if name != "bpe" else []
            if table is docs and name == "near_duplicates":
                given = sorted({r["text"] for r in before.collect()})
                groups = {c for _, c in brute_components(given, 5, 80).values()}
                assert len(texts) == len(groups) == 4 and len({t.lower()[:60] for t in texts}) == 4
            if table is docs and name == "pii":
                assert "<EMAIL>" in " ".join(texts)
        assert (kept.count() > 0) == (table is docs)
