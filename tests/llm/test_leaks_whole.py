"""Decontamination against every alignment, without masks."""

import itertools
import random

import brute

from meshlark.llm import decontam


def test_masks_hit_every_stretch():
    """Any eight of twelve places hold the counted places of a mask; of fewer places, too."""
    counted = [{k for k, bit in enumerate(m) if bit == "1"} for m in decontam.MASKS]
    for equal in itertools.combinations(range(12), 8):
        assert any({k + j for k in m} <= set(equal) for m in counted for j in range(12)), equal


def test_short_items_with_changes(spark, make_docs):
    random.seed(11)
    vocabulary = [f"w{k}" for k in range(3000)]
    items = [(n, " ".join(random.sample(vocabulary, n))) for n in (8, 9, 10, 11, 12, 15, 18, 20, 25)]
    rows = []
    for _, text in items:
        n = len(text.split())
        changes = [(k,) for k in range(n)] + [(k, k + 1) for k in range(n - 1)] + [random.sample(range(n), 3) for _ in range(20)] + [
            random.sample(range(n), 4) for _ in range(20)]
        for places in changes:
            part = text.split()
            for k in places:
                part[k] = "zz"
            rows.append((len(rows), " ".join([*random.choices(vocabulary, k=12), *part, *random.choices(vocabulary, k=5)]), "en", "a"))
    got = {(r.doc_id, r.item_id): r.matched for r in decontam.find_leaks(make_docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute.leaks([r[:2] for r in rows], items)
    assert got == want and len(want) > 400


def test_long_passages_of_longer_items(spark, make_docs):
    """Fewer than half of the words, but many in a row; short passages, together under half, do not count."""
    random.seed(12)
    vocabulary = [f"w{k}" for k in range(5000)]
    items = [(n, " ".join(random.sample(vocabulary, n))) for n in (40, 59, 300)]
    rows, held = [], set()
    for item, text in items:
        for n in (9, 12, 13, 16, 29, 140):
            part = text.split()[5:5 + n]
            if n < item / 2:
                held |= {(len(rows), item)} if n >= 13 else set()
                rows.append((len(rows), " ".join(["yy"] * 20 + part + ["zz"] * 20), "en", "a"))
        apart = " ".join(text.split()[:9] + ["yy"] * 30 + text.split()[20:29])
        rows.append((len(rows), apart, "en", "a"))
    docs, table = make_docs(rows), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.matched for r in decontam.find_leaks(docs, table).collect()}
    assert set(got) == held and got == brute.leaks([r[:2] for r in rows], items)
    assert {r.doc_id for r in decontam.drop_leaks(docs, table).collect()} == {r[0] for r in rows} - {d for d, _ in held}
