import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tableguard.llm import bpe, queries
from tests.llm.helpers import documents, empty_documents, prose, write_tables

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
with open(PATH, encoding="utf-8") as file:
    VOCABULARY = bpe.Vocabulary(file.read())
ENCODER = bpe.Encoder(VOCABULARY)


def by_library(text):
    found = LIBRARY.encode(text or "", add_special_tokens=False)
    return found.ids, LIBRARY.decode(found.ids, skip_special_tokens=False)


def check(texts, encoder=ENCODER):
    for text, (ids, shown) in zip(texts, encoder.encode(list(texts)), strict=True):
        assert (np.frombuffer(ids, "<u4").tolist(), shown) == by_library(text), repr(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abeinorst'SIΣσ \t\n\x85\x1c<|>0é̈ßſ"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=5))
def test_any_text_as_the_library(texts):
    check(texts)


def test_words_special_tokens_and_long_runs():
    rng = random.Random(1)
    words = ["".join(rng.choice("abeinorst") for _ in range(rng.randint(1, 30))) for _ in range(5000)]
    check([" ".join(words), "a" * 3000, "ab" * 400, "x<|startoftext|> y<|endoftext|>z <|endoftext|><|endoftext|>", "<|ENDOFTEXT|>",
           "it's WE'LL don'T", "", " \n ", "ΑΣ ΣΑΣ İI", "!!!???...a1b22c333"])


def test_every_code_point_alone():
    step = 997
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, step, 111):
        check([" ".join(chars[at::step])])


def test_heap_and_scan_merge_alike():
    rng = random.Random(2)
    for _ in range(500):
        ids = VOCABULARY.base("".join(rng.choice("anbiterso") for _ in range(rng.randint(1, 48))))
        assert VOCABULARY._merge_scan(ids) == VOCABULARY._merge_heap(ids)


def test_compatibility_equals_merging_the_pair():
    rng = random.Random(3)
    whole = [i for t, i in VOCABULARY.ids.items() if not t.endswith("</w>") and t.isascii() and ENCODER._is_whole(i)][:4000]
    a, b = np.array(rng.choices(whole, k=3000)), np.array(rng.choices(whole, k=3000))
    got = VOCABULARY.compatible(a, b)
    for x, y, fine in zip(a.tolist(), b.tolist(), got.tolist()):
        base = [VOCABULARY.ids[c] for c in VOCABULARY.tokens[x] + VOCABULARY.tokens[y]]
        assert (VOCABULARY.merge_exactly(base) == [x, y]) == fine, (x, y)


def test_small_memory_changes_nothing():
    rng = random.Random(4)
    texts = [prose(rng, 30) for _ in range(60)]
    small = bpe.Encoder(VOCABULARY, memo_words=5)
    for at in range(0, 60, 7):
        check(texts[at:at + 7], small)
    assert small.exact < small.seen


def test_full_memory_keeps_what_is_in_use():
    small = bpe.Encoder(VOCABULARY, memo_words=80)
    for c in "abcdefghijklmnopqrstuvwxyz":
        check([" ".join(["often", *(f"{a}{c}{c}{c}" for a in "qxzjv")])], small)
    assert small.seen == 1 + 26 * 5     # every distinct word once, although more of them were met than are kept
    assert len(small.memo) + len(small.words_memo) + sum(map(len, small.older)) <= 80 + 30


def test_merging_together_equals_merging_alone():
    rng = random.Random(6)
    words = [VOCABULARY.base("".join(rng.choice("anbiterso") for _ in range(rng.choice([1, 2, 3, 9, 47, 48, 49, 90])))) for _ in range(3000)] + [[]]
    assert VOCABULARY.merge_together(words) == [VOCABULARY.merge_exactly(w) for w in words]
    assert VOCABULARY.merge_together([]) == []


def test_proposals_are_the_longest_tokens():
    rng = random.Random(7)
    for _ in range(300):
        word, at = "".join(rng.choice("aeinorsthd'1!") for _ in range(rng.randint(1, 30))), 0
        for token in VOCABULARY.propose(word):
            fits = [stop for stop in range(at + 1, len(word) + 1) if (word[at:] + VOCABULARY.suffix if stop == len(word) else word[at:stop]) in VOCABULARY.ids]
            assert VOCABULARY.ids[word[at:] + VOCABULARY.suffix if max(fits) == len(word) else word[at:max(fits)]] == token
            at = max(fits)


def test_pieces_end_where_the_library_has_white_space():
    check(["a\x1cb\x1d c\x1e\x1fd", "a\x85b\xa0c\u2028d\u3000e\u2000f", "x \u0301y \u0327\u0301z\u00a0\u0301", "J\u030c j\u030c \u01f0",
           "\u03a3 A\u03a3 \u03a3\u03a3", "a<|endoftext|>\u0301b", "it's'so..'s ''s it'S", "\x00a\x7fb\x01"])


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(5)
    texts = [None, "", "Hello  wörld", "a" * 2000, prose(rng, 30_000), "same", "same", (None, "no id"), "<|endoftext|>"]
    return documents(spark, texts).selectExpr("*", "1 AS id", "2 AS ids", "3 AS n_tokens", "'x' AS decoded_sha256")


def test_round_trip_to_the_normalised_text(spark, frame):
    back = bpe.decode_ids(bpe.encode_documents(frame, PATH), PATH).collect()
    text = {r.doc_id: r.text for r in frame.collect()}
    for r in back:
        words = ENCODER.split((text[r.doc_id] or "").replace("<|endoftext|>", "")) if "<|" not in (text[r.doc_id] or "") else ["<|endoftext|>"]
        assert r.text.split() == words


def test_query_as_the_library(spark, frame, tmp_path):
    docs = frame.filter("doc_id IS NOT NULL").select("doc_id", "text", "lang", "source", "n_chars")
    got = {r.doc_id: r for r in queries.QUERIES["op4_speculative_bpe"](spark, write_tables({"documents": docs}, tmp_path)).collect()}
    for r in docs.collect():
        ids, shown = by_library(r.text)
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest())
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == want


def test_empty_table(spark):
    assert bpe.encode_documents(empty_documents(spark), PATH).count() == 0


def test_memory_stays_small_over_many_distinct_words():
    encoder, letters = bpe.Encoder(VOCABULARY), str.maketrans("0123456789", "ghijklmnop")
    most = 0
    for k in range(0, 350_000, 10_000):
        for _ in encoder.encode([" ".join(f"{i:x}".translate(letters) for i in range(k, k + 10_000))]):
            pass
        most = max(most, sum(len(x) for x in (encoder.memo, encoder.words_memo, *encoder.older)))
    assert 100_000 < most < bpe.MEMO_WORDS + 40_000     # of 350,000 words met


def test_longest_tokens_of_many_words_together():
    rng = random.Random(8)
    words = ["".join(rng.choice("aeinorsthd'1!é漢\x00") for _ in range(rng.randint(1, 60))) for _ in range(500)] + ["a" * 3000]
    coded = [w.encode() for w in words]
    tokens, owner = VOCABULARY.propose_all(b"".join(coded), np.array([len(c) for c in coded]))
    spans = {t: len(VOCABULARY._symbols(VOCABULARY.tokens[t])) for t in set(tokens.tolist())}
    for k, word in enumerate(coded):
        at, symbols = 0, "".join(bpe.SYMBOLS[b] for b in word)
        for token in tokens[owner == k].tolist():
            fits = [(stop, t) for stop in range(at + 1, len(word) + 1)
                    if (t := VOCABULARY.ids.get(symbols[at:] + VOCABULARY.suffix if stop == len(word) else symbols[at:stop])) is not None]
            assert max(fits) == (at + spans[token], token)
            at += spans[token]
        assert at == len(word)


def test_rare_words_take_few_calls():
    """Calls of functions for each unmet word: about 16, and 53 when each was proposed on its own."""
    import sys

    rng = random.Random(9)
    texts = [" ".join("".join(rng.choice("abeinorst") for _ in range(12)) for _ in range(100)) for _ in range(30)]
    encoder, calls = bpe.Encoder(VOCABULARY), [0]
    check(texts[:2], encoder)

    def count(frame, event, arg):
        calls[0] += event in ("call", "c_call")

    before = encoder.exact
    sys.setprofile(count)
    try:
        got = list(encoder.encode(texts[2:]))
    finally:
        sys.setprofile(None)
    words = 100 * len(got)
    assert encoder.exact > before + words // 5      # many of them need merging too
    assert calls[0] < 25 * words, calls[0] / words
    check(texts, encoder)


def test_texts_shown_in_many_parts(monkeypatch):
    monkeypatch.setattr(bpe, "DECODE_TOKENS", 4)
    check(["", "one two three four five six", "", "a", "", "x<|endoftext|>y z", "", "wörld wörld wörld", ""], bpe.Encoder(VOCABULARY))
    assert list(bpe.Encoder(VOCABULARY).encode_bytes([])) == []
