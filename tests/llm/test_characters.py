"""Splitting by this Python's character tables against the libraries, over all code points."""

import random

import brute
import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from meshlark.llm import bpe, counts, tokenids

POINTS = [k for k in range(0x110000) if not 0xD800 <= k < 0xE000]


def test_token_counts_of_every_character():
    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, "rb") as f:
        counter = counts.Counter(f.read())
    lib = Tokenizer.from_file(path)
    random.seed(2)
    texts = [f"x{chr(k)}y" for k in POINTS if k < 0x20000 or k % 97 == 0]
    texts += ["".join(chr(random.choice(POINTS[:0x20000])) for _ in range(4)) for _ in range(5_000)] + ["₹՘Ո͢", "x Ɤ y", "ใ₟"]
    for k in range(0, len(texts), 20_000):
        part = texts[k:k + 20_000]
        want = [len(x.ids) for x in lib.encode_batch(part, add_special_tokens=False)]
        got = [counter.count(x) for x in part]
        assert got == want, [(x, a, b) for x, a, b in zip(part, got, want, strict=True) if a != b][:5]


def test_byte_level_ids_of_every_character():
    """The splitting pattern of op10 in the regex package against tiktoken's."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        coder = bpe.Coder(f.read(), public_tokenizers.PATTERN)
    lib: tiktoken.Encoding = coder._encode
    random.seed(3)
    texts = [f"x {chr(k)}1" for k in POINTS if k < 0x20000 or k % 97 == 0]
    texts += ["".join(chr(random.choice(POINTS[:0x20000])) for _ in range(4)) for _ in range(5_000)]
    wrong = [x for x in texts if np.frombuffer(coder.encode(x), "<u4").tolist() != lib.encode_ordinary(x)]
    assert not wrong, [x.encode("unicode-escape") for x in wrong[:5]]


def test_token_ids_of_every_character():
    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, "rb") as f:
        ours = tokenids.Tokenizer(f.read())
    random.seed(4)
    texts = [f"x {chr(k)}1" for k in POINTS if k < 0x20000 or k % 97 == 0]
    texts += ["".join(chr(random.choice(POINTS[:0x20000])) for _ in range(4)) for _ in range(5_000)]
    lib = Tokenizer.from_file(path)
    for k in range(0, len(texts), 20_000):
        part = texts[k:k + 20_000]
        want = [x.ids for x in lib.encode_batch(part, add_special_tokens=False)]
        assert [np.frombuffer(ours.encode(x), "<u4").tolist() for x in part] == want


def test_stitching_unsettled_characters(make_docs, spark):
    random.seed(5)
    odd = [chr(k) for k in (0x18FC8, 0x18E1A, 0x1EEF1, 0xA7CB, 0x558, 0x20C0)]
    rows = [(k, "".join(random.choices([*odd, *"ab' 1.\n漢é"], k=random.choice((50, 700)))), "en", "a") for k in range(60)]
    files = bpe.Files(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = {r.doc_id: tuple(r)[1:] for r in bpe.digest(make_docs(rows), files, 128, 24).collect()}
    assert got == {r[0]: brute.round_trip(r[1]) for r in rows}
