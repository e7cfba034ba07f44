"""Periodic runs of words by block convolution: integer transforms find where blocks recur, extensions make runs of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from meshlark.functions.worker import once, ship

ship(__name__)
LEAST_LENGTH, LEAST_TIMES = 6, 4
PRIME, ROOT = 2013265921, 31  # 15 * 2**27 + 1 and a generator; twice the product of two residues fits in 64 bits
ELEMENTS = 1 << 19  # of a matrix of blocks that is transformed at once
WORDS_AT_ONCE = 1 << 16  # words of short texts that are looked through together
_P = np.uint64(PRIME)


def _roots(size: int, inverse: bool) -> list[np.ndarray]:
    """Powers of a root of unity for each halving of a transform of ``size``."""
    out, half = [], size // 2
    while half:
        w = pow(ROOT, (PRIME - 1) // (2 * half), PRIME)
        w = pow(w, -1, PRIME) if inverse else w
        powers = np.ones(1, np.uint64)
        while len(powers) < half:
            powers = np.concatenate([powers, powers * np.uint64(pow(w, len(powers), PRIME)) % _P])
        out.append(powers)
        half //= 2
    return out


def _ntt(rows: np.ndarray) -> np.ndarray:
    """The transform of each row modulo PRIME, in bit-reversed order."""
    many, size = rows.shape
    for w in once(("roots", size, False), lambda: _roots(size, False), 64):
        x = rows.reshape(many, -1, 2, len(w))
        a, b = x[:, :, 0], x[:, :, 1]
        rows = np.stack(((a + b) % _P, (a + _P - b) * w % _P), axis=2)
    return rows.reshape(many, size)


def _inverse_ntt(rows: np.ndarray) -> np.ndarray:
    """From bit-reversed order back, times the size."""
    many, size = rows.shape
    for w in reversed(once(("roots", size, True), lambda: _roots(size, True), 64)):
        x = rows.reshape(many, -1, 2, len(w))
        a, b = x[:, :, 0], x[:, :, 1] * w % _P
        rows = np.stack(((a + b) % _P, (a + _P - b) % _P), axis=2)
    return rows.reshape(many, size)


def mismatches(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Sums of squared differences, modulo PRIME, of each block of n words with its window at offsets 0 to n - 1.

    The sum of (x - y)**2 is that of x**2, of y**2 under the block, less twice that of x * y, a correlation. Windows
    have 2 n words, so a cyclic one of that size does not wrap at these offsets. Words are numbers below PRIME.
    """
    many, n = blocks.shape
    turned = np.zeros((many, 2 * n), np.uint64)
    turned[:, 0] = blocks[:, 0]
    turned[:, n + 1:] = blocks[:, :0:-1]
    products = _inverse_ntt(_ntt(turned) * _ntt(windows) % _P)[:, :n] * np.uint64(pow(2 * n, -1, PRIME)) % _P
    squares = np.zeros((many, 2 * n + 1), np.uint64)
    np.cumsum(windows * windows % _P, axis=1, out=squares[:, 1:])
    under = squares[:, n:2 * n] - squares[:, :n]
    own = (blocks * blocks % _P).sum(axis=1, dtype=np.uint64)
    return (own[:, None] + under + (_P - products) * np.uint64(2)) % _P


def _seeds(words: np.ndarray, gap: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distance, block) of the blocks of n words that recur n to 2 n - 1 words on, sorted.

    Only blocks of which every word recurs within fewer than 2 n words are transformed: no other can recur there.
    """
    count = len(words) // n
    near = np.flatnonzero(gap[:count * n].reshape(count, n).max(axis=1) < 2 * n) if n > 1 else np.flatnonzero(gap < 2)
    padded = np.concatenate([words, np.full(3 * n, words.max() + 1, np.uint64)])
    found = [np.empty((0, 2), np.int64)]
    for part in np.array_split(near, max(1, -(-len(near) * 2 * n // ELEMENTS))):
        if len(part):
            at = part[:, None] * n
            zero = mismatches(padded[at + np.arange(n)], padded[at + n + np.arange(2 * n)]) == 0
            which, offset = np.nonzero(zero)
            found.append(np.stack([offset + n, part[which]], axis=1))
    found = np.concatenate(found)
    found = found[np.lexsort((found[:, 1], found[:, 0]))]
    return found[:, 0], found[:, 1]


def _chains(distance: np.ndarray, block: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(distance, first block, number of blocks) of neighbouring blocks with one distance."""
    if len(distance):
        starts = np.flatnonzero(np.concatenate(([True], (np.diff(distance) != 0) | (np.diff(block) != 1))))
        yield from zip(distance[starts].tolist(), block[starts].tolist(), np.diff(np.append(starts, len(distance))).tolist(), strict=True)


def _confirmed(words: np.ndarray, n: int, d: int, first: int, many: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the chain's blocks that do recur word by word: all of it, but for a sum that PRIME divides."""
    start, end = first * n, (first + many) * n
    end = min(end, len(words) - d)
    same = words[start:end] == words[start + d:end + d]
    if same.all() and end == (first + many) * n:
        yield start, end
        return
    whole = same[:len(same) // n * n].reshape(-1, n).all(axis=1)
    for _, k, m in _chains(np.zeros(whole.sum(), np.int64), np.flatnonzero(whole)):
        yield start + k * n, start + (k + m) * n


def _reach(same, limit: int) -> int:
    """How many of the first ``limit`` places are the same, looked at in growing steps."""
    at, step = 0, 64
    while at < limit:
        found = same(at, min(at + step, limit))
        if not found.all():
            return at + int(found.argmin())
        at, step = at + len(found), step * 4
    return at


def find_runs(words: np.ndarray, longest: int | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ``words`` (numbers below PRIME), in order of start, then period.

    A run is a stretch of at least six words and four times its smallest period that no neighbouring word extends. At
    the scale n with n <= period < 2 n its words hold two whole blocks of n words side by side, and these recur one
    period on; so chains of recurring blocks, extended to both sides, give every run. A chain that lies in a run
    already known, at a multiple of its period, is that run again: smaller periods were found at smaller scales.
    ``longest`` bounds the length of a run where that is known.
    """
    size = len(words)
    longest = size if longest is None else longest
    if size < LEAST_LENGTH:
        return []
    order = np.argsort(words, kind="stable")
    gap = np.full(size, size, np.int64)
    again = words[order[1:]] == words[order[:-1]]
    gap[order[:-1][again]] = np.diff(order)[again]
    runs: list[tuple[int, int, int]] = []
    covers, reach = np.full(size, -1, np.int64), np.zeros(size, np.int64)  # the run at each place that reaches furthest, its end

    def known(first: int, end: int, d: int) -> bool:
        if covers[first] < 0:
            return False
        start, length, period = runs[covers[first]]
        return d % period == 0 and end + d <= start + length

    n = 1
    while LEAST_TIMES * n <= longest:
        new = []
        for d, first, many in _chains(*_seeds(words, gap, n)):
            if many < max(2, (3 * d + 1) // n - 1) or known(first * n, (first + many) * n, d):
                continue
            for start, end in _confirmed(words, n, d, first, many):
                if known(start, end, d):
                    continue
                back = _reach(lambda a, b: words[start - b:start - a][::-1] == words[start - b + d:start - a + d][::-1], start)
                on = _reach(lambda a, b: words[end + a:end + b] == words[end + a + d:end + b + d], size - d - end)
                length = end + on - (start - back) + d
                if length >= max(LEAST_LENGTH, LEAST_TIMES * d):
                    new.append((start - back, length, d))
        for start, length, d in sorted(set(new)):
            further = reach[start:start + length] < start + length
            covers[start:start + length][further] = len(runs)
            reach[start:start + length][further] = start + length
            runs.append((start, length, d))
        n *= 2
    return sorted(runs, key=lambda r: (r[0], r[2]))


_OUT = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
KIND = "n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def _together(texts: list[str | None]) -> Iterator[tuple[list, list[int], str]]:
    """(n_words, runs, collapsed) of each text. The texts' words are one sequence, with a word of its own between two."""
    numbers: dict[bytes, int] = {}
    words = [(text or "").encode().split() for text in texts]
    whole, starts = [], []
    for k, own in enumerate(words):
        starts.append(len(whole))
        whole += [numbers.setdefault(w, len(numbers)) for w in own]
        whole.append(numbers.setdefault(k, len(numbers)))
    found: list[list] = [[] for _ in words]
    runs = find_runs(np.array(whole, np.uint64), max((len(w) for w in words), default=0))
    of = np.searchsorted(starts, [r[0] for r in runs], side="right") - 1
    for k, (start, length, period) in zip(of.tolist(), runs, strict=True):
        found[k].append({"start": start - starts[k], "length": length, "period": period})
    for own, runs in zip(words, found, strict=True):
        if runs:
            change = np.zeros(len(own) + 1, np.int64)
            np.add.at(change, [r["start"] + r["period"] for r in runs], 1)
            np.add.at(change, [r["start"] + r["length"] for r in runs], -1)
            kept = [w for w, inside in zip(own, np.cumsum(change[:-1]).tolist(), strict=True) if not inside]
        else:
            kept = own
        yield len(own), runs, b" ".join(kept).decode()


def _groups(texts: list[str | None], most: int) -> Iterator[list[str | None]]:
    """Texts in order, together while they are short."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text or "") // 6 + 1
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _find(most: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in _groups(batch.columns[-1].to_pylist(), most):
                counts, runs, collapsed = zip(*_together(texts), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(at, len(texts)) for c in batch.columns[:-1]), pa.array(counts, pa.int64()), pa.array(runs, _OUT), pa.array(collapsed, pa.string())],
                    [*batch.schema.names[:-1], "n_words", "runs", "collapsed"])
                at += len(texts)

    return find


def periodic_runs(docs: DataFrame, words_at_once: int = WORDS_AT_ONCE) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of (doc_id, text).

    Words are what lies between characters of ``[\\x20\\x09-\\x0D]``. ``runs`` are the text's periodic runs (start,
    length, period, counted in words) by start, then period; ``collapsed`` is the text's words, joined by a blank,
    without those that any run holds after its first period. Runs may overlap.

    A null, empty or blank text has no words, no runs and an empty ``collapsed``. Rows that are alike are treated
    alike; an empty table gives no rows; columns other than doc_id and text are dropped. A text of any length is looked
    through whole by one task, in memory of about a hundred bytes a word.
    """
    bare = docs.select("doc_id", "text")
    return bare.mapInArrow(_find(words_at_once), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {KIND}")
