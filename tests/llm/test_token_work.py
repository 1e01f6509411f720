"""What the encoders do once per distinct piece, against the library's ids."""

import random
from array import array

import pytest

from rolloutlab.llm import tokens as T

KINDS = [("byte_level", "byte_bpe_50k.json"), ("word", "word_bpe_49k.json")]


def fresh(kind, name):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(T.tokenizer_path(name))
    tokenizer.encode_special_tokens = True
    return T.ENCODERS[kind](tokenizer), tokenizer


def texts(seed, n=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzÉßéüABC") for _ in range(rng.randint(1, 9)))
    mark = ["", "", "", ",", ".", "...", "!?", ";"]
    odd = ["", " ", "\t", "\n", "x\ty", "don't", "a-b.", "(so)", "日本。", "12,5", " ", ".", "Ġ", "Ġabc", "Ġ.", "×", "a÷."]
    return [" ".join(rng.choice(odd) if rng.random() < 0.15 else word() + rng.choice(mark) for _ in range(rng.randint(0, 200)))
            .replace("k ", "k\n") for _ in range(n)] + ["", " ", "\n", "a"]


@pytest.mark.parametrize("kind,name", KINDS)
@pytest.mark.parametrize("entries", [300_000, 50])
def test_ids_equal_the_library_over_lots_and_cache_turns(kind, name, entries, monkeypatch):
    monkeypatch.setattr(T, "CACHE_ENTRIES", entries)
    enc, tokenizer = fresh(kind, name)
    for seed in (1, 2, 1, 3):
        lot = texts(seed)
        assert enc.encode_many(lot) == [array("I", tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for t in lot]


@pytest.mark.parametrize("kind,name", KINDS)
def test_words_with_marks_need_no_call_each(kind, name, monkeypatch):
    enc, tokenizer = fresh(kind, name)
    calls, piece = [], enc.piece
    monkeypatch.setattr(enc, "piece", lambda p, pieces: calls.append(p) or piece(p, pieces))
    text = " ".join(f"{w}{m}" for w in ("alpha", "beta", "gamma", "delta") for m in ("", ",", ".", "!"))
    assert enc.encode(text) == array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
    assert not [c for c in calls if c[:1].isalpha()]               # before: every word with marks
