"""The registered queries: those with SQL against DuckDB, the others against plain Python versions."""

import re
from collections import Counter

import brute
import public_tokenizers
import pytest
from oracle_check import compare, duck
from tokenizers import Tokenizer

import corpus_pipeline
from meshlark.llm import plans
from meshlark.session import cut

WITH_SQL = [n for n in plans.QUERIES if n in plans.ORACLES]


@pytest.mark.parametrize("name", WITH_SQL)
def test_sql(spark, sf, name):
    assert compare(plans.QUERIES[name](spark, sf), duck(sf), plans.ORACLES[name]) is None


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()


def test_token_ids(spark, sf, docs):
    got = sorted(map(tuple, plans.op2(spark, sf).collect()))
    assert got == brute.ids_file([(r.doc_id, r.text) for r in docs])[0]


def test_leaks(spark, sf, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): r.matched for r in plans.op4(spark, sf).collect()}
    assert got == brute.leaks([(r.doc_id, r.text) for r in docs], items)
    assert got


def test_near_duplicates(spark, sf, docs):
    got = {r.doc_id: r.class_id for r in plans.op5(spark, sf).collect()}
    assert got == brute.classes([(r.doc_id, r.text) for r in docs])
    assert len(set(got.values())) < len(got)


def test_languages(spark, sf, docs):
    rows = [(r.doc_id, r.text, r.lang) for r in docs]
    known = brute.profiles(brute.training(rows))
    held = {r[0] for r in rows} - {r[0] for r in brute.training(rows)}
    got = {r.doc_id: r for r in plans.op7(spark, sf).collect()}
    for doc_id, text, _ in rows:
        lang, score = brute.language(text, known)
        assert (got[doc_id].lang_pred, got[doc_id].held_out) == (lang, doc_id in held)
        assert got[doc_id].score == pytest.approx(score)
    right = [got[d].lang_pred == lang for d, _, lang in rows if d in held]
    assert sum(right) > 0.95 * len(right)


def test_quality(spark, sf, docs):
    got = {r.doc_id: r for r in plans.op8(spark, sf).collect()}
    for d in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", d.text or "")
        windows = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
        count = Counter(windows)
        repeated = {j for k, x in enumerate(windows) if count[x] > 1 for j in range(k, k + 5)}
        lines = [x for x in (d.text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        base = (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in d.text or ""), len(lines) - len(set(lines)), len(repeated))
        r = got[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (len(w) < 10 or 100 * len(repeated) > 20 * len(w))
        assert not (r.kept and r.base_failed)
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    told = [got[d].kept == (q == 1) for d, q in good.items() if d in got and not got[d].base_failed]
    assert sum(told) >= 0.95 * len(told)


def test_token_counts(spark, sf, docs):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: tuple(r) for r in plans.op9(spark, sf).collect()}
    for d in docs:
        n = len(lib.encode(d.text or "", add_special_tokens=False).ids)
        assert got[d.doc_id] == (d.doc_id, len((d.text or "").encode()), n, n > 2048)


def test_round_trip(spark, sf, docs):
    got = {r.doc_id: tuple(r)[1:] for r in plans.op10(spark, sf).collect()}
    assert got == {d.doc_id: brute.round_trip(d.text) for d in docs}


def test_pipeline(spark, sf, docs):
    """Every stage against its plain version on its own input."""
    rows = [(d.doc_id, d.text, d.lang, d.source) for d in docs]
    table = spark.read.parquet(f"{sf}/documents.parquet")
    columns = table.columns
    after = []
    for name, stage in corpus_pipeline.STAGES:
        table = cut(stage(spark, table, sf), name)
        after.append({r.doc_id: r for r in table.collect()})
        assert table.count() == len(after[-1])
        assert name == "encode" or table.columns == columns
    known = brute.profiles(brute.training([r[:3] for r in rows]))
    told = {r[0]: brute.language(r[1], known) for r in rows}
    assert set(after[0]) == {d for d, (lang, score) in told.items() if lang != "und" and score >= 0.2}
    rows = [r for r in rows if r[0] in after[0]]
    clean = dict(zip([r[0] for r in rows], brute.clean_lines([(r[0], r[3], r[1]) for r in rows], 10), strict=True))
    assert {d: (r.text, r.n_chars) for d, r in after[1].items()} == {d: (t, len(t)) for d, t in clean.items()}
    of = brute.classes(list(clean.items()))
    assert set(after[2]) == set(of.values())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    dirty = {d for d, _ in brute.leaks([(d, clean[d]) for d in after[2]], items)}
    assert set(after[3]) == set(after[2]) - dirty
    assert {d: tuple(r)[1:] for d, r in after[4].items()} == {d: brute.round_trip(clean[d]) for d in after[3]}
