"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def ids_file(rows):
    """(doc_id, text) in order to (doc_id, start, n_tokens, crc) and all ids."""
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out, ids = [], []
    for doc_id, text in rows:
        own = lib.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, len(ids), len(own), zlib.crc32(np.array(own, dtype="<u4").tobytes())))
        ids += own
    return out, ids


def clean_lines(rows, least):
    """(doc_id, source, text) to the texts without the lines of ``least`` sources or more, but in their first document."""
    sites, first = defaultdict(set), {}
    blanks = " \t\r\v\f"
    for doc_id, source, text in rows:
        for line in (text or "").split("\n"):
            if key := line.strip(blanks):
                if source is not None:
                    sites[key].add(source)
                if doc_id is not None:
                    first[key] = min(first.get(key, doc_id), doc_id)
    keep = lambda d, x: not (k := x.strip(blanks)) or len(sites[k]) < least or (k in first and first[k] == d)
    return [None if t is None else "\n".join(x for x in t.split("\n") if keep(d, x)) for d, _, t in rows]


def shingles(text):
    w = words(text)
    count = Counter(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else {}
    return {(g, k) for g, n in count.items() for k in range(n)}


def classes(docs, least=0.8):
    """{doc_id: smallest doc_id of its class}, comparing all that share a shingle."""
    sets = {d: shingles(t) for d, t in docs}
    holders, common = defaultdict(list), Counter()
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    for ds in holders.values():
        for k, a in enumerate(ds):
            common.update((b, a) for b in ds[:k])
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for (a, b), n in common.items():
        if n >= least * (len(sets[a]) + len(sets[b]) - n):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return {d: root(d) for d in sets}


def leaks(docs, items, share=0.5):
    """{(doc_id, item_id): matched words}, trying every alignment; half of the words, or 13 of one stretch."""
    out = {}
    for item_id, item_text in items:
        item = words(item_text)
        span = min(12, len(item))
        for doc_id, text in docs if len(item) >= 8 else []:
            doc, held, longest = words(text), set(), 0
            where = defaultdict(list)
            for j, w in enumerate(doc):
                where[w].append(j)
            equal = Counter(j - k for k, w in enumerate(item) for j in where.get(w, ()))
            for shift in (x for x, n in equal.items() if n >= 8):
                at = [k for k in range(len(item)) if 0 <= k + shift < len(doc)]
                same = {k for k in at if item[k] == doc[k + shift]}
                stretch, end = set(), -1
                for k in at:
                    window = same & set(range(k, k + span))
                    if k + span - 1 in at and len(window) >= 8:
                        stretch, end = stretch | window if k <= end else window, k + span
                        longest = max(longest, len(stretch))
                        held |= window
            if len(held) >= share * len(item) or longest >= 13:
                out[doc_id, item_id] = max(len(held), out.get((doc_id, item_id), 0))
    return out


def round_trip(text):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = coder.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def grams(text):
    """The 300 most frequent n-grams of one to three letters, word edges written as chr(1)."""
    count = Counter()
    for word in "".join(x if x.isalpha() else " " for x in (text or "").lower()).split():
        edged = f"\1{word}\1"
        count.update(word)
        for n in (2, 3):
            count.update(edged[k:k + n] for k in range(len(edged) - n + 1))
    return count


def ranked(count):
    return sorted(count, key=lambda g: (-count[g], len(g), g))[:300]


def language(text, profiles):
    top = ranked(grams(text))
    if not top:
        return "und", 0.0
    far = {}
    for lang, profile in profiles.items():
        place = {g: k for k, g in enumerate(profile)}
        far[lang] = sum(abs(place[g] - k) if g in place else 300 for k, g in enumerate(top))
    best = min(sorted(far), key=far.get)
    return best, 1 - far[best] / (300 * len(top))


def profiles(rows):
    """(doc_id, text, lang) of the training rows to profiles, all rows taken."""
    count = defaultdict(Counter)
    for _, text, lang in rows:
        if lang is not None and text is not None:
            count[lang].update(grams(text))
    return {lang: ranked(c) for lang, c in count.items()}


def training(rows):
    return [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
