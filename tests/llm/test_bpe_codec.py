import random

import pytest
import regex

from seqlode.llm import bpe_codec as B
from seqlode.llm.registry import tokenizer_files

PATH, PATTERN = tokenizer_files()


def test_round_trip(messy):
    enc = B.encoding(PATH, PATTERN)
    rows = B.bpe_round_trip(messy, PATH, PATTERN).collect()
    assert len(rows) == messy.count()
    for r in rows:
        assert bytes(r.decoded) == (r.text or "").encode()
        assert list(r.token_ids) == enc.encode_ordinary(r.text or "")
        assert r.score in ("own", None, "")


def test_two_steps_agree_with_one(messy):
    one = B.digests(B.bpe_round_trip(messy, PATH, PATTERN)).collect()
    two = B.digests(B.bpe_decode(B.bpe_encode(messy, PATH, PATTERN), PATH, PATTERN)).collect()
    assert sorted(map(repr, one)) == sorted(map(repr, two))


def test_empty(empty):
    assert B.bpe_round_trip(empty, PATH, PATTERN).collect() == []


@pytest.mark.parametrize("seed", range(5))
def test_safe_chunks(seed):
    rng = random.Random(seed)
    parts = ["don't", " ", "  ", "\n", "x", "é😀", "12", "!!", "'ll", "\t", " ", "\x1c", "日本", " \n ", "_"]
    enc = B.encoding(PATH, PATTERN)
    for _ in range(60):
        text = "".join(rng.choices(parts, k=rng.randint(0, 120)))
        chunks = list(B.safe_chunks(text, rng.randint(1, 20)))
        assert "".join(chunks) == text
        assert [i for c in chunks for i in enc.encode_ordinary(c)] == enc.encode_ordinary(text)


def by_pieces(enc, text):
    return [i for piece in regex.findall(PATTERN, text) for i in enc._encode_single_piece(piece)]


@pytest.mark.parametrize("blanks", [" ", "\n", " \n", "\t \r\n", "\u3000 \xa0"])
def test_long_white_space(blanks):
    enc = B.encoding(PATH, PATTERN)
    rng = random.Random(len(blanks))
    run = "".join(rng.choices(blanks, k=2_000_000))
    for text in (run, "word" + run, run + "word", "a b." + run + "!x" + run[:70_000] + " é" + run[:5_000]):
        assert B.encode_text(enc, text) == by_pieces(enc, text)


@pytest.mark.parametrize("seed", range(3))
def test_runs_of_any_length(monkeypatch, seed):
    import re

    monkeypatch.setattr(B, "LONG_TEXT", 8)
    monkeypatch.setattr(B, "_LONG_RUN", re.compile(B._WHITE + "{2,}"))
    rng = random.Random(seed)
    enc = B.encoding(PATH, PATTERN)
    parts = ["don't", " ", "  ", "\n\n ", "x", "é😀", "12", "!!", "'ll", "\t", "\u3000\u3000", "日本", "_"]
    for _ in range(300):
        text = "".join(rng.choices(parts, k=rng.randint(0, 60)))
        assert B.encode_text(enc, text) == enc.encode_ordinary(text)


def test_other_patterns_are_left_whole():
    assert B._runs_apart(PATTERN)
    assert not B._runs_apart(r"\w+|\s*[\r\n]+|\s+(?!\S)|\s+") and not B._runs_apart(r"\S+|\s")


def test_long_white_space_in_a_table(make):
    from .conftest import rows_of

    docs = make(rows_of(["a" + " " * 1_500_000 + "b", "\n" * 1_200_000, "plain"]))
    rows = B.bpe_round_trip(docs, PATH, PATTERN).collect()
    assert all(bytes(r.decoded) == r.text.encode() for r in rows) and len(rows) == 3
