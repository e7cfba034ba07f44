"""Periodic runs, exact dedup and conversation repair against plain versions."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlark.llm import exactdup, plans, runs, turns

LONG = "\n".join(f"line {k} of a very long text, {k * k} in all." for k in range(60_000))


# 11 periodic runs

def plain_runs(words):
    """(start, length, period) by trying every period."""
    found, n = [], len(words)
    for q in range(1, n // 4 + 1):
        start = 0
        while start + q < n:
            end = start
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end - start + q
            if length >= max(6, 4 * q) and not any(q % p == 0 and s <= start and s + m >= start + length for s, m, p in found):
                found.append((start, length, q))
            start = end + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_collapse(words, found):
    gone = {i for start, length, period in found for i in range(start + period, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_mismatches_are_squared_differences():
    rng = np.random.default_rng(3)
    for n in (1, 2, 8, 64):
        blocks, windows = rng.integers(0, 50, (5, n)).astype(np.uint64), rng.integers(0, 50, (5, 2 * n)).astype(np.uint64)
        want = [[sum((int(x) - int(y)) ** 2 for x, y in zip(b, w[k:k + n], strict=True)) for k in range(n)] for b, w in zip(blocks, windows, strict=True)]
        assert runs.mismatches(blocks, windows).tolist() == want


def test_runs_of_many_kinds():
    random.seed(7)
    for _ in range(1500):
        words = []
        while len(words) < random.choice((0, 5, 20, 60, 150)):
            kind = random.random()
            part = random.choices(range(random.choice((1, 2, 3, 50))), k=random.choice((1, 1, 2, 3, 5, 8, 13)))
            words += part * random.choice((1, 1, 2, 4, 5, 9)) if kind < 0.8 else words[-random.randint(1, 30):]
        want = plain_runs(words)
        assert runs.find_runs(np.array(words, np.uint64)) == want, words


def test_one_word_and_long_periods():
    assert runs.find_runs(np.zeros(100_000, np.uint64)) == [(0, 100_000, 1)]
    part = np.random.default_rng(1).integers(0, 1000, 3001).astype(np.uint64)
    words = np.concatenate([np.arange(5000, 5100, dtype=np.uint64), np.tile(part, 5)[:-7]])
    assert runs.find_runs(words) == [(100, 5 * 3001 - 7, 3001)]


def test_false_zeros_are_confirmed(monkeypatch):
    """With a tiny prime many sums vanish by chance; the words decide."""
    real = runs.mismatches
    monkeypatch.setattr(runs, "mismatches", lambda b, w: real(b, w) % 3)
    random.seed(8)
    for _ in range(200):
        words = random.choices(range(3), k=10) + random.choices(range(2), k=3) * 6 + random.choices(range(3), k=10)
        assert runs.find_runs(np.array(words, np.uint64)) == plain_runs(words)


def test_periodic_runs_of_odd_rows(spark, make_docs, odd_rows):
    rows = [*odd_rows, (20, "a b " * 30_000, "en", "a"), (21, LONG, "en", "a"), (22, "x y x y x y x y x y x y", "en", "a")]
    split = lambda text: re.findall(r"[^\x20\x09-\x0D]+", text or "")
    for at_once in (1, 1 << 16):
        got = runs.periodic_runs(make_docs(rows), at_once).collect()
        for r in got:
            words = split(dict((x[0], x[1]) for x in rows)[r.doc_id])
            found = [tuple(x) for x in r.runs]
            if len(words) < 10_000:
                assert found == plain_runs(words)
            assert r.n_words == len(words) and r.collapsed == plain_collapse(words, found)
        assert len(got) == len(rows)
        assert [tuple(x) for x in next(r.runs for r in got if r.doc_id == 20)] == [(0, 60_000, 2)]
    assert runs.periodic_runs(make_docs(rows).limit(0)).count() == 0


def test_repeating_ends(spark, make_docs):
    """The planted end of the contract, word by word."""
    import zlib

    rows = [(d, " ".join(f"w{k}" for k in range(d % 90)), "en", "a") for d in range(200)]
    got = {r.doc_id: r.text for r in plans.with_repeats(make_docs(rows)).collect()}
    for d, text, *_ in rows:
        words, h = text.split(), zlib.crc32(str(d).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        assert got[d].split() == words


# 12 exact dedup

def plain_groups(rows):
    bare = lambda text: re.sub(r"[\x20\x09-\x0D]", "", text or "")
    by_text = {}
    for k, r in enumerate(rows):
        by_text.setdefault(bare(r[1]), []).append((-len(r[1] or ""), r[0] is None, r[0], k))
    out = []
    for text, group in by_text.items():
        best = min(group, key=lambda g: (g[0], g[1], g[2] or 0, g[3]))
        out += [(r[2], best[2], len(group), r == best, hashlib.sha256(text.encode()).hexdigest()) for r in group]
    return sorted(out, key=repr)


def told(rows):
    return sorted(map(tuple, rows), key=repr)


def as_plain(got):
    """Of rows that are alike it is open which one is kept."""
    return sorted([(*r[:3], r[4]) for r in got], key=repr), sorted([(*r[:3], r[4]) for r in got if r[3]], key=repr)


def test_exact_groups(spark, make_docs, odd_rows):
    random.seed(9)
    texts = ["".join(random.choices("ab", k=random.choice((0, 1, 2, 3, 4, 5, 7, 8, 9, 16, 17)))) for _ in range(400)]
    rows = [(k, " ".join(t) if k % 3 else t, "en", "a") for k, t in enumerate(texts)]
    long = LONG[:200_000]
    rows += [*odd_rows, (900, long, "en", "a"), (901, long.replace("\n", " \n"), "en", "a"), (902, long[:-1] + "!", "en", "a"), (3, " ", None, None)]
    docs = make_docs(rows)
    for block in (1, exactdup.BLOCK):
        some = rows if block > 1 else rows[:400]
        got = told(exactdup.exact_duplicates(make_docs(some), block).collect())
        assert as_plain(got) == as_plain(plain_groups(some))
    left = exactdup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    want = [(r[0], r[2]) for r in plain_groups(rows) if r[3]]
    assert sorted((r.doc_id for r in left.collect()), key=repr) == sorted((w[0] for w in want), key=repr)
    assert exactdup.exact_duplicates(docs.limit(0)).count() == 0


def test_blocks_that_share_a_hash(spark):
    """Names tell blocks apart whatever the hash."""
    random.seed(10)
    rows = [(k, [bytes(random.choices(b"ab", k=random.choice((1, 2)))) for _ in range(random.choice((0, 1, 2, 3, 5)))]) for k in range(300)]
    table = spark.createDataFrame(rows, "row long, blocks array<binary>")
    for hashed in (lambda c: F.lit(1), lambda c: F.length(c), F.xxhash64):
        got = {r.row: (r.level, r.name) for r in exactdup.identities(table, hashed).collect()}
        of = {}
        for k, blocks in rows:
            of.setdefault(tuple(blocks), set()).add(got[k])
        assert len(got) == len(rows) and all(len(x) == 1 for x in of.values()) and len(set.union(*of.values())) == len(of)


def test_a_third_of_all_rows_is_one_text(spark, make_docs):
    rows = [(k, "the same text " * 200 if k % 3 == 0 else f"text {k} " * 100, "en", "a") for k in range(900)]
    got = exactdup.exact_duplicates(make_docs(rows), 256)
    assert as_plain(told(got.collect())) == as_plain(plain_groups(rows))


# 13 conversation repair

FORM = re.compile(r"(s?(ua)+)?\Z")
SHORT = {"u": "user", "a": "assistant"}


def plain_repair(rows):
    """The cheapest audit and its rows by trying every string of edits; rows are (role, text, fault) in order."""
    best = None
    for most in range(2 * len(rows) + 3):
        for inserts in itertools.combinations_with_replacement(range(len(rows) + 1), most):
            if best and 3 * most > best[0]:
                return best
            for edits in itertools.product("DKR", repeat=len(rows)):
                cost, roles, audit = 3 * most, [], ""
                for k in range(len(rows) + 1):
                    n = inserts.count(k)
                    roles += [("?", "")] * n
                    audit += "I" * n
                    if k == len(rows):
                        break
                    role, text, fault = rows[k]
                    cost += {"D": 4, "K": 0, "R": 3}[edits[k]] + 3 * (edits[k] != "D" and fault == "truncated")
                    audit += edits[k]
                    if edits[k] != "D":
                        cost += 100 * (fault in ("blank", "duplicate"))
                        roles.append((role if edits[k] == "K" else "?", text))
                if best and (cost, audit) >= best[:2] or cost >= 100:
                    continue
                for said in itertools.product("ua", repeat=sum(r == "?" for r, _ in roles)):
                    left = iter(said)
                    full = [(SHORT[next(left)] if r == "?" else r, t) for r, t in roles]
                    if FORM.match("".join(r[:1] for r, _ in full)) and all(r for r, _ in full):
                        best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in full))
        if best is None and most > 4:
            break
    return best


def first_faults(rows):
    out, seen = [], set()
    for role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        out.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""))
        seen.add((role, text))
    return out


KIND = "conv_id long, turn long, role string, text string, there boolean, audit string, fault string, cost long"


def test_cheapest_repairs(spark):
    random.seed(13)
    convs, rows = {}, []
    for conv in range(100):
        said = [(random.choice(("user", "assistant", "system", "tool", "unknown", "")), random.choice(("One.", "Two!", "no end", " ", "", "Three?\n")))
                for _ in range(random.choice((0, 1, 2, 2, 3, 3)))]
        numbers = sorted(random.sample(range(9), len(said)))
        convs[conv] = (said, numbers)
        rows += [(conv, t, *s, True, "x", "y", 1) for t, s in zip(numbers, said, strict=True)] + [(conv, 20, "user", "gone", False, "x", "y", 1)]
    random.shuffle(rows)
    got = {r.conv_id: r for r in turns.repair(spark.createDataFrame(rows, KIND), in_memory=8).collect()}
    assert set(got) == set(convs)
    for conv, (said, numbers) in convs.items():
        marked = first_faults(said)
        cost, audit, text = plain_repair(marked)
        r = got[conv]
        assert (r.cost, r.audit, r.repaired_sha256) == (cost, audit, hashlib.sha256(text.encode()).hexdigest()), (said, r)
        assert (r.blank, r.duplicate, r.truncated) == tuple(sum(f == x for *_, f in marked) for x in ("blank", "duplicate", "truncated"))
        assert r.gaps == (numbers[-1] - numbers[0] + 1 - len(numbers) if numbers else 0)
        assert r.illegal == sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(said))


def test_odd_conversations(spark):
    nothing = hashlib.sha256(b"").hexdigest()
    rows = [
        (1, None, None, None, True), (None, 1, "user", "Hi.", True), (None, None, "assistant", "Ho.", True), (2, 5, "user", "Hi.", None),
        (3, 4, "user", "Hi.", True), (3, 4, "user", "Hi.", True), (3, 4, "assistant", "Ho.", True),
    ]
    got = {r.conv_id: tuple(r)[1:] for r in turns.repair(spark.createDataFrame([(*r, "x", "y", 1) for r in rows], KIND)).collect()}
    assert got[1] == (0, 1, 0, 0, 0, 4, "D", nothing)
    assert got[2] == (0, 0, 0, 0, 0, 0, "", nothing)
    assert got[None][:7] == (0, 0, 0, 0, 0, 6, "IKKI")
    assert got[3][:7] == (0, 0, 1, 0, 1, 10, "IKKDI")
    assert turns.repair(spark.createDataFrame([], KIND)).count() == 0


@pytest.mark.parametrize("in_memory", [100, 1 << 20])
def test_a_conversation_that_holds_most_rows(spark, in_memory):
    """Its backpointers go to the scratch file, its rows pass through in many batches."""
    n = 40_000
    rows = spark.range(n).selectExpr(
        "IF(id % 4 = 0, id, 7) AS conv_id", "id AS turn", "IF(id % 3 = 0, 'user', 'assistant') AS role", "concat('Row ', id, IF(id % 5 = 0, '', '.')) AS text",
        "true AS there")
    got = {r.conv_id: r for r in turns.repair(rows, in_memory).collect()}
    mine = [(f"{'user' if k % 3 == 0 else 'assistant'}", f"Row {k}{'' if k % 5 == 0 else '.'}") for k in range(n) if k % 4]
    now = turns.Conversation(1 << 30)
    for k, (role, text, fault) in enumerate(first_faults(mine)):
        now.add(k, role, text, fault)
    want = now.result()
    assert (got[7].cost, got[7].audit, got[7].repaired_sha256) == want[5:]
    assert len(got) == n // 4 + 1 and len(got[7].audit) >= len(mine)
