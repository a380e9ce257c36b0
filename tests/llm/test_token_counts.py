"""Token counts against the tokenizer library, which makes the tokens."""

from __future__ import annotations

import random
from functools import cache

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidework.llm.token_counts import CHUNK, Counter, merge_count, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@cache
def counter() -> Counter:
    return Counter(PATH)


@cache
def library() -> Tokenizer:
    return Tokenizer.from_file(PATH)


def expected(text: str) -> int:
    return len(library().encode(text, add_special_tokens=False).ids)


def test_merges_take_the_lowest_rank_and_then_the_leftmost_pair():
    ranks = {("a", "b"): 1, ("b", "c"): 0, ("a", "a"): 2, ("aa", "a"): 3}
    assert merge_count(list("abc"), ranks) == 1  # a, bc
    assert merge_count(list("aaaa"), ranks) == 2  # aa, aa: the pair in the middle is gone
    assert merge_count(list("aaa"), ranks) == 2
    assert merge_count([], ranks) == 0


def test_every_code_point_beside_others():
    texts = (f"a{c}b 1{c}2 !{c}? {c} {c}{c}x  {c}" for c in map(chr, [*range(0xD800), *range(0xE000, 0x3FFFF, 5)]))
    assert not [t for t in texts if counter().count(t) != expected(t)]


def test_random_texts_and_special_names():
    pick = random.Random(5)
    parts = ["a", "b", " ", "  ", "\n", "'s", "'S", "1", "é", "漢", "🙂", "<|endoftext|>", "<|", "\x1c", "\0", "\xa0", "the"]
    for _ in range(4000):
        text = "".join(pick.choice(parts) for _ in range(pick.randint(0, 30)))
        assert counter().count(text) == expected(text), text


@pytest.mark.parametrize("piece", ["a", "ab", " ", "\n x", "漢", "word and "])
def test_long_texts(piece):
    text = piece * (CHUNK // len(piece) + 5000)
    assert counter().count(text) == expected(text)


def test_other_kinds_of_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        Counter(public_tokenizers.path("word_bpe_49k.json"))


def test_whole_table(documents):
    found = {r.doc_id: r for r in token_counts(documents).collect()}
    for row in documents.collect():
        text = row.text or ""
        mine = found.pop(row.doc_id)
        assert (mine.n_bytes, mine.n_tokens) == (len(text.encode()), expected(text))
        assert mine.over_limit == (mine.n_tokens > 1024)
    assert not found


def test_awkward_rows(awkward, nothing):
    found = sorted(tuple(r) for r in token_counts(awkward, limit=9).na.fill(-1, ["doc_id"]).collect())
    texts = [(-1 if r.doc_id is None else r.doc_id, r.text or "") for r in awkward.collect()]
    assert found == sorted((i, len(t.encode()), expected(t), expected(t) > 9) for i, t in texts)
    assert token_counts(nothing).count() == 0
