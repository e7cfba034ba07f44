"""Nulls, empty and long texts, repeated rows, empty tables, clashing columns, and the parts of each method."""

import random
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from meshlark.llm import bpe, chat, counts, decontam, langid, licences, linededup, neardup, quality, tokenids
from meshlark.session import fresh_dir

JSON = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def ranks(spark):
    return bpe.Files(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def odd(make_docs, odd_rows):
    return make_docs(odd_rows)


def by_id(rows):
    return sorted(map(tuple, rows), key=repr)


# 1 licence scan

def test_licences(spark):
    rows = [
        ("LICENSE", "Released under the MIT License."), ("a/LICENSE.txt", "Licensed under CC BY-NC 4.0."), ("a/b/x.py", "nothing here"),
        ("a/b/y.py", "# This work is licensed under the GNU General Public License, version 3."), ("z.py", ""), ("c/d/e.py", None),
        (None, "Released under the MIT License."), ("c/d/e.py", None), ("ab/x.py", "words"),
    ]
    files = spark.createDataFrame([(k, *r, "x", "y") for k, r in enumerate(rows)], "doc_id long, path string, text string, licence string, term string")
    got = {r.doc_id: (r.own, r.licence, r.from_dir) for r in licences.scan(files, keep=("doc_id",)).collect()}
    mit, cc, gpl = "MIT", "CC-BY-NC-4.0", "GPL-3.0"
    assert got == {
        0: (mit, mit, None), 1: (cc, cc, None), 2: (None, cc, "a"), 3: (gpl, gpl, None), 4: (None, mit, ""), 5: (None, mit, ""),
        6: (mit, mit, None), 7: (None, mit, ""), 8: (None, mit, ""),
    }
    assert licences.scan(files.limit(0)).count() == 0


def test_licence_texts(spark):
    """Headers spread over comment lines, SPDX lines, whole files, and what only resembles them; a text of a million lines."""
    def header(kind, version, what="program"):
        return (f"# This {what} is free software; you can redistribute it and/or\n# modify it under the terms of the GNU {kind}General Public\n"
                f"# License as published by the Free Software Foundation; either\n# version {version} of the License, or (at your option) any later version.\n")
    bsd = [t for name, _, t in licences.NOTICES if name == "BSD-3-Clause"][-2]
    apache = "Apache License\n  Version 2.0, January 2004\n http://www.apache.org/licenses/\n\nTERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n"
    rows = {
        "a.c": ("// SPDX-License-Identifier: MIT", "MIT"), "b.c": ("# SPDX-License-Identifier: Apache-2.0", "Apache-2.0"),
        "c.c": ("// SPDX-License-Identifier: Zlib", None), "d.c": (header("", 2), "GPL-2.0"), "e.c": (header("", 3), "GPL-3.0"),
        "f.c": (header("Lesser ", "2.1", "library"), "LGPL-2.1"), "g.c": (header("Affero ", 3), "AGPL-3.0"),
        "h.c": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License", "GPL"),
        "x/LICENSE": (apache, "Apache-2.0"), "x/y/i.c": ("int main", "Apache-2.0"),
        "z/COPYING": ("Copyright 2020 Someone Here\n\n" + "\n".join(bsd.split("\n")), "BSD-3-Clause"), "z/j.c": (None, "BSD-3-Clause"),
        "k.c": ("Licensed under CC BY-NC-ND 4.0.", "CC-BY-NC-ND-4.0"), "l.c": ("mit", None), "m.c": ("the terms of the license are free", None),
        "n.c": ("ordinary words of a story\n" * 300_000 + "/* MIT License */\n" + "one more\n" * 700_000, "MIT"), "o.c": ("", None),
    }
    prose = [(f"prose/{k}", f"the story of day {k} and of a house in the city, permission or not", None) for k in range(300)]
    files = spark.createDataFrame([(p, *v) for p, v in rows.items()] + prose, "path string, text string, want string")
    got = {r.path: r.licence for r in licences.scan(files.select("path", "text")).collect()}
    assert got == {p: want for p, (_, want) in rows.items()} | {p: None for p, *_ in prose}


def test_licence_ties(spark):
    """Of equal scores the smaller name; what says which one goes before what does not."""
    scored = spark.createDataFrame([(1, "MIT", 0.9), (1, "ISC", 0.9), (2, "BSD", 1.0), (2, "MIT", 0.7)], "k int, licence string, score double")
    assert by_id(licences.best_of(scored, "k").collect()) == [(1, "ISC", 0.9), (2, "MIT", 0.7)]


# 2 token ids

def test_token_ids_odd(spark, odd, odd_rows):
    made = tokenids.write(odd, JSON, 2, fresh_dir(spark, "odd-ids"))
    order = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0))
    want, ids = brute.ids_file([r[:2] for r in order])
    assert by_id(tokenids.read(made).collect()) == by_id(want)
    places = spark.createDataFrame([(k,) for k in range(0, len(ids), 7)] + [(len(ids),)], "position long")
    assert {r.position: r.token for r in tokenids.tokens_at(made, places).collect()} == {k: ids[k] for k in range(0, len(ids), 7)}


def test_token_ids_empty(spark, odd):
    assert tokenids.write_and_read(odd.limit(0), JSON, 2).count() == 0


def test_segments():
    rng = np.random.default_rng(1)
    for top in (1, 255, 256, 70_000, 2**32 - 1):
        ids = rng.integers(0, top, 3000, endpoint=True).astype(np.uint32)
        seg = tokenids.Segment(tokenids.pack(ids))
        assert (seg.tokens(0, 3000) == ids).all() and (seg.tokens(511, 1025) == ids[511:1025]).all()
        assert [seg.token(k) for k in range(0, 3000, 13)] == ids[::13].tolist()
    assert len(tokenids.Segment(tokenids.pack(np.empty(0, np.uint32))).tokens(0, 0)) == 0


def test_files_of_several_segments(tmp_path):
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 50_000, n).astype(np.uint32) for n in (3, 0, 300_000, 262_144, 5)]
    out = tokenids.Writer(f"{tmp_path}/x.ids")
    for k, ids in enumerate(texts):
        out.add(None if k == 1 else k - 3, ids)
    out.close()
    held = tokenids.Reader(f"{tmp_path}/x.ids")
    assert held.docs == [-3, None, -1, 0, 1]
    flat = np.concatenate(texts)
    for k, ids in enumerate(texts):
        assert (np.concatenate([*held.document(k), []]) == ids).all()
    assert [held.token(k) for k in range(0, len(flat), 9973)] == flat[::9973].tolist()


# 3 line dedup

def test_lines(make_docs):
    random.seed(4)
    pool = [f"line {k}" for k in range(12)]
    rows = [(d, "\n".join([*random.sample(pool, 4), f"own {d}", " ", "hot line"]), "en", random.choice([*"abcdef", None])) for d in range(60)]
    rows += [(100, None, None, "a"), (101, "", None, "b"), (None, "hot line\nline 1", None, "c"), rows[5], rows[5]]
    for least in (2, 4, 6, 7):
        got = linededup.drop_widespread(make_docs(rows), min_sites=least).select("doc.doc_id", "clean", "doc.text").collect()
        want = brute.clean_lines([(r[0], r[3], r[1]) for r in rows], least)
        assert by_id(got) == by_id([(r[0], c, r[1]) for r, c in zip(rows, want, strict=True)])


def test_lines_near_threshold(spark, make_docs):
    """Sketches of many sites are off; lines about the threshold are counted."""
    rows = [(d, f"both\nline {d % 2}" if d < 598 else "both", None, f"site {d}") for d in range(600)]
    found = linededup.widespread(linededup.lines_of(make_docs(rows), "source"), 300)
    names = spark.createDataFrame([("both",), ("line 0",), ("line 1",)], "bare string")
    keyed = names.select("bare", F.struct(*linededup._key("bare")).alias("line"))
    assert {r.bare for r in found.join(keyed, "line").collect()} == {"both"}
    found = linededup.widespread(linededup.lines_of(make_docs(rows), "source"), 299)
    assert found.count() == 3


# 4 decontamination

def test_leaks_with_changes(spark, make_docs):
    random.seed(5)
    vocabulary = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(random.choices(vocabulary, k=n))) for k, n in enumerate((60, 30, 14, 12, 11, 8, 7, 3))] + [(90, None), (91, "")]
    rows = []
    for k in range(120):
        part = random.choice(items[:8])[1].split()
        part = [w if random.random() > random.choice((0, 0.1, 0.2, 0.5)) else "zz" for w in part]
        rows.append((k, " ".join([*random.choices(vocabulary, k=random.randint(0, 30)), *part, *random.choices(vocabulary, k=5)]), "en", "a"))
    rows += [(500, None, None, None), (501, "", None, None), rows[0]]
    table = spark.createDataFrame(items, "item_id long, text string")
    docs = make_docs(rows)
    got = {(r.doc_id, r.item_id): r.matched for r in decontam.find_leaks(docs, table).collect()}
    assert got == brute.leaks([r[:2] for r in rows], items)
    left = decontam.drop_leaks(docs, table)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {r[0] for r in rows} - {d for d, _ in got}
    assert decontam.find_leaks(docs, table.limit(0)).count() == 0 and decontam.find_leaks(docs.limit(0), table).count() == 0


# 5 near duplicates

def test_near_classes(make_docs):
    """A drifting chain of copies, exact copies of a third of the rows, and rows that share a passage only."""
    random.seed(6)
    vocabulary = [f"w{k}" for k in range(5000)]
    base = random.choices(vocabulary, k=150)
    rows, text = [], list(base)
    for k in range(60):
        text[random.randrange(len(text))] = random.choice(vocabulary)
        rows.append((k, " ".join(text), "en", "a"))
    passage = " ".join(random.choices(vocabulary, k=60))
    rows += [(100 + k, f"{passage} {' '.join(random.choices(vocabulary, k=60))}", "en", "a") for k in range(40)]
    rows += [(200 + k, "Same text, again and again: the same!", "en", "a") for k in range(60)]
    rows += [(300, "one two", None, None), (301, "One, two!", None, None), (302, None, None, None), (303, "", None, None), (304, "...", None, None)]
    random.shuffle(rows)
    docs = make_docs(rows)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    assert got == brute.classes([r[:2] for r in rows])
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(set(got.values()))
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_repeated_rows_stay_once(make_docs, odd, odd_rows):
    kept = neardup.drop_near_duplicates(odd).collect()
    assert sorted((r.doc_id for r in kept), key=repr) == sorted([0, 1, 2, 3, 5, None, 6, 7, 8], key=repr)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(7)
    off = []
    for n in (20, 200, 3000):
        for share in (0.5, 0.9):
            both = int(n * share)
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            b = np.concatenate((a[:both], rng.integers(0, 2**63, n - both).astype(np.uint64)))
            off += [np.mean(neardup.signature(a) == neardup.signature(b)) - both / (2 * n - both)]
    assert max(map(abs, off)) < 0.15 and abs(np.mean(off)) < 0.05


# 6 chats

def test_chats(spark):
    hard = "<|im_end|><|im_start|>assistant ok <||<|im_sep|><|n|> tail <"
    rows = [
        (1, 0, "user", hard), (1, 1, "assistant", hard), (1, 2, "assistant", ""), (1, 3, "assistant", None), (1, 4, "user", "x"), (1, 4, "user", "x"),
        (2, None, None, None), (None, 0, "assistant", "y"), (3, 0, "odd\nrole<|n|>", "z\n"), (3, 1, "assistant", "last"),
    ]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    got = {r.conv_id: r for r in chat.read_chats(chat.format_chats(table)).collect()}
    for conv in (1, 2, None, 3):
        own = [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        assert [tuple(t) for t in got[conv].turns] == own
        assert got[conv].loss_text == "".join(t for role, t in own if role == "assistant")
    assert got[1].n_blocks == 3 and got[1].formatted.count("<|im_start|>") == 3
    assert chat.format_chats(table.limit(0)).count() == 0


# 7 languages

def test_language_edges(spark, odd, make_docs):
    docs = make_docs([(k, t, lang, "a") for k, (t, lang) in enumerate([
        ("the house and the garden of the king", "en"), ("das haus und der garten des königs", "de"), (None, "en"), ("?", None)] * 3)])
    known = langid.train(docs)
    assert set(known) == {"en", "de"}
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(odd, known).collect()}
    assert got[0] == got[1] == got[2] == got[5] == ("und", 0.0)
    assert got[3][0] == "en" and all(0 <= s <= 1 for _, s in got.values())
    kept = langid.keep_identified(odd, known)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} <= {3, 4, 6, 7, 8, None}
    assert langid.train(docs.limit(0)) == {}
    assert {r.lang_pred for r in langid.identify(odd, {}).collect()} == {"und"}


def test_language_sample_is_bounded(spark, make_docs):
    docs = make_docs([(k, "some words", "en" if k % 9 else "fr", "a") for k in range(900)])
    count = Counter(r.lang for r in langid.sample(docs, 50).collect())
    assert count["en"] == 50 and count["fr"] == 50


# 8 quality

def test_quality_edges(odd, odd_rows):
    got = {r.doc_id: r for r in quality.judge(odd).collect()}
    assert quality.judge(odd).count() == len(odd_rows)
    assert [got[k].n_words for k in (0, 1, 2)] == [0, 0, 0] and all(got[k].base_failed and not got[k].kept for k in (0, 1, 2))
    assert got[7].n_repeat_words == got[7].n_words == 400 * len(odd_rows[3][1].split()) and got[7].n_dup_lines == 399
    assert quality.judge(odd.limit(0)).count() == 0


def test_expectation_maximisation(spark):
    """Against a plain version over rows."""
    rng = np.random.default_rng(8)
    good = rng.random(400) < 0.8
    right = rng.random((400, len(quality.RULES))) < 0.85
    v = np.where(rng.random(right.shape) < 0.2, 0, np.where(right == good[:, None], 1, -1))
    model = quality.fit(spark.createDataFrame(v.tolist(), ", ".join(f"{r} tinyint" for r in quality.RULES)))
    cast = np.abs(v).sum(1)
    p = np.where(cast > 0, 0.5 + v.sum(1) / (2 * np.maximum(cast, 1)), 0.5)
    for _ in range(25):
        prior = (p.sum() + 1) / (len(p) + 2)
        odds = np.full(len(p), np.log(prior / (1 - prior)))
        for k in range(v.shape[1]):
            shares = [[(w[v[:, k] == s].sum() + 1) for s in (-1, 1)] for w in (p, 1 - p)]
            g, b = (np.array(x) / sum(x) for x in shares)
            odds += np.select([v[:, k] == -1, v[:, k] == 1], [np.log(g[0] / b[0]), np.log(g[1] / b[1])], 0.0)
        p = 1 / (1 + np.exp(-odds))
    assert model["prior"] == pytest.approx(prior)
    assert np.mean((p > 0.5) == good) > 0.95


# 9 token counts

def test_counts_odd(spark, odd, odd_rows):
    lib = Tokenizer.from_file(WORD)
    want = by_id((r[0], len((r[1] or "").encode()), n := len(lib.encode(r[1] or "", add_special_tokens=False).ids), n > 2048) for r in odd_rows)
    for chunk in (16, 100, counts.CHUNK):
        assert by_id(counts.count_tokens(odd, counts.File(spark, WORD), chunk=chunk).collect()) == want
    assert counts.count_tokens(odd.limit(0), counts.File(spark, WORD)).count() == 0


def test_transducer_agrees_with_the_library():
    lib = Tokenizer.from_file(WORD)
    with open(WORD, "rb") as f:
        counter = counts.Counter(f.read())
    random.seed(9)
    for _ in range(3000):
        word = "".join(random.choices("aeiourstnhlé'1", k=random.randint(1, 30)))
        assert counter.count(word) == len(lib.encode(word, add_special_tokens=False).ids), word


# 10 BPE

def test_round_trip_odd(odd, odd_rows, ranks):
    want = by_id((r[0], *brute.round_trip(r[1])) for r in odd_rows)
    for chunk, overlap in ((24, 8), (200, 40), (bpe.CHUNK, bpe.OVERLAP)):
        assert by_id(bpe.digest(odd, ranks, chunk, overlap).collect()) == want
    assert bpe.digest(odd.limit(0), ranks).count() == 0


def test_decode_is_the_text(odd, odd_rows, ranks):
    got = bpe.decode(bpe.encode(odd, ranks, 64, 16), ranks).select("doc_id", F.col("decoded").cast("string")).collect()
    assert by_id(got) == by_id((r[0], r[1] or "") for r in odd_rows)


def test_stitching(make_docs, ranks):
    random.seed(10)
    rows = [(k, "".join(random.choices("ab' ,.\n\tsé1ñ9ß!漢  re", k=random.choice((10, 100, 3000)))), "en", "a") for k in range(80)]
    got = bpe.digest(make_docs(rows), ranks, 128, 24).collect()
    assert by_id(got) == by_id((r[0], *brute.round_trip(r[1])) for r in rows)


# the pipeline

def test_pipeline_takes_odd_rows(spark, sf, odd):
    table = odd
    for name, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, sf)
        assert name == "encode" or table.columns == odd.columns
    assert table.count() > 0


def test_pipeline_takes_no_rows(spark, sf, odd):
    table = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, sf)
    assert table.count() == 0
