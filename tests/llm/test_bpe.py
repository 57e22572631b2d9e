import hashlib
import random
import unicodedata

import numpy as np
import pytest

from framelark.llm import bpe

tokenizers = pytest.importorskip("tokenizers")

TEXTS = [
    "", "a", "<|endoftext|>Hi<|startoftext|> x<|endoftext|", "ΟΔΟΣ ΣΑΣ", "é İstanbul ǅ ﬁ ß", "it's they'll we've I'd 's\x1c\x1dq\x85z​w", "1234½²Ⅷ x_y--z!!　漢字 カタカナ 😀🏳️‍🌈",
    "\x00\x01 \x1f a᠎b", "x" * 5000, "ab" * 300 + "é" * 400, "K Å Ω ΑΣ. ﻿", "don't DON'T 'LL", "the quick brown fox " * 500,
]


@pytest.fixture(scope="module")
def both():
    return tokenizers.Tokenizer.from_file(bpe.vocabulary_path()), bpe.WordBpe(bpe.vocabulary_path())


def test_equals_library(both, odd_texts):
    theirs, mine = both
    for text in TEXTS + [t for _, t in odd_texts if t]:
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert mine.encode(text) == ids
        assert mine.decode(ids) == theirs.decode(ids, skip_special_tokens=False)


def test_every_code_point(both):
    """Between letters, so that class, case and composition all show; no difference in 1.1 million."""
    theirs, mine = both
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{chr(c)}b" for c in codes[at : at + 256]) for at in range(0, len(codes), 256)]
    wrong = [t for t, e in zip(texts, theirs.encode_batch(texts, add_special_tokens=False)) if mine.encode(t) != e.ids]
    assert not wrong, [hex(ord(t[1])) for t in wrong[:10]]


def test_random_strings_of_odd_code_points(both):
    """Marks in any order, compositions, white space and code points of later Unicode versions."""
    theirs, mine = both
    r = random.Random(5)
    odd = np.flatnonzero(bpe._unicode().odd).tolist()
    marks = [c for c in range(0x300, 0x20000) if unicodedata.combining(chr(c))]
    plain = [*range(0x20, 0x250), *range(0x370, 0x400), *range(0xAC00, 0xAC40), *range(0x1100, 0x1113), *range(0x1161, 0x1176), *range(0x11A8, 0x11C3), *range(0x900, 0x980), 0x11935, 0x11930, 0x3000, 0x85]
    texts = ["".join(chr(r.choice(r.choice((odd, marks, plain, plain)))) for _ in range(r.randrange(1, 24))) for _ in range(5_000)]
    wrong = [t for t, e in zip(texts, theirs.encode_batch(texts, add_special_tokens=False)) if mine.encode(t) != e.ids]
    assert not wrong, [list(map(hex, map(ord, t))) for t in wrong[:5]]


def test_long_words_by_heap(both, monkeypatch):
    theirs, mine = both
    monkeypatch.setattr(bpe, "SHORT", 2)
    for word in ("international", "thththth", "aaaaaaa", "éééàà", "anananana"):
        mine.known.clear()
        assert mine.encode(word) == theirs.encode(word, add_special_tokens=False).ids


def test_frames(odd_docs, no_docs, both):
    theirs, _ = both
    texts = {r.doc_id: r.text for r in odd_docs.collect() if r.doc_id not in (None, 15, 16)}
    for r in bpe.digests(odd_docs).collect():
        if r.doc_id in texts:
            ids = theirs.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
            text = theirs.decode(ids, skip_special_tokens=False)
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert bpe.digests(odd_docs).count() == odd_docs.count()
    assert bpe.digests(no_docs).count() == 0
    ids = bpe.tokens(odd_docs)
    assert bpe.decode(ids).count() == odd_docs.count()


def test_cache_stays_bounded(both, monkeypatch):
    _, mine = both
    monkeypatch.setattr(bpe, "CACHED_WORDS", 10)
    mine.encode(" ".join(f"word{chr(97 + i)}" for i in range(26)))
    assert len(mine.known) <= 10
