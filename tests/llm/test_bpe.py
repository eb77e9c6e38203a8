import hashlib

import numpy as np
import pytest

from sparkloom.llm import bpe

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    with open(PATH, encoding="utf-8") as f:
        source = f.read()
    return bpe.Tokenizer(source), bpe.token_names(source), tokenizers.Tokenizer.from_file(PATH)


TRICKY = ["", "it's <|endoftext|>we'll", "ΑΣ İi ẞ", "\x1c é ÅΩ", "#" * 500, "ab" * 300, "日本語 123 ½ ²", " \u0085x y", "a​b﻿😀👍🏽", "<|startoftext|>", "don't'S'RE", "́x", "𝔘𝔫𝔦"]


def test_equal_to_the_library(both, documents):
    own, names, other = both
    texts = TRICKY + [r.text for r in documents.collect()]
    for text, e in zip(texts, other.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == e.ids, text[:50]
        assert bpe.decode(ids, names) == other.decode(e.ids, skip_special_tokens=False)


def test_cuts_are_certain(both):
    own, _, _ = both
    for word in ("hello", "x日x", "zqjx", "naïveté", "qzqzqz"):
        data = word.encode()
        assert np.frombuffer(own.word(word), "<u4").tolist() == own.merge(data, True)


def test_heap_and_scan_agree(both):
    own, _, _ = both
    for text in ("abcabcabd" * 20, "z" * 200, "thequickbrownfox" * 9):
        ids = [own.alone[b] for b in text.encode()]
        assert own._heap(list(ids)) == own._scan(list(ids))


def test_columns(both, odd, none):
    own, names, other = both
    rows = bpe.decoded(bpe.encoded(odd, PATH), PATH).collect()
    want = []
    for r in odd.select("doc_id", "text").collect():
        e = other.encode(r.text or "", add_special_tokens=False)
        want.append((r.doc_id, hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest(), other.decode(e.ids, skip_special_tokens=False)))
    got = [(r.doc_id, hashlib.sha256(bytes(r.ids)).hexdigest(), r.text) for r in rows]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert bpe.decoded(bpe.encoded(none, PATH), PATH).count() == 0


def test_many_words_side_by_side_are_as_each_alone(both, documents):
    own, _, other = both
    words = sorted({w for r in documents.collect() for w in own.split(r.text or "")})[:5000]
    words += ["qzqzqz", "#" * 500, "日本語", "x" * 49, "x" * 48, "a"]
    assert len(words) > 1000
    assert own.ids_of(words) == list(map(own.word, words))
    assert own.ids_of(["z" * 200] * bpe.FEW) == [own.word("z" * 200)] * bpe.FEW
    texts = TRICKY + [" ".join(words)]
    for _ in range(2):
        assert own.encode_all(texts) == list(map(own.encode, texts))
    assert own.encode_all([]) == []


def test_forgotten_words_come_back(both, documents, monkeypatch):
    own, _, other = both
    monkeypatch.setattr(bpe, "MOST_WORDS", 20)
    for r in documents.limit(20).collect() * 2:
        assert np.frombuffer(own.encode(r.text or ""), "<u4").tolist() == other.encode(r.text or "", add_special_tokens=False).ids


def test_latin_texts_split_alike():
    every = map(chr, range(0x250))
    plain = "".join(c for c in every if not bpe.BEYOND_LATIN.search(c.lower())).lower()  # 24 letters have their lower case elsewhere
    for text in (plain, "a".join(plain), " ".join(plain)):
        assert bpe.SPLIT_LATIN.findall(text) == bpe.SPLIT.findall(text)
