"""Spelling variants against a plain comparison of all words."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from conftest import SF_SMALL
from rolloutlab.llm import spelling as S

ALPHABET = "abcdefghijklmnopqrstuvwxyzàéÿÀ×"


def one_edit(a, b):
    """Whether the words differ by exactly one inserted, deleted or replaced code point."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    if len(a) == len(b):
        return a[k + 1:] == b[k + 1:]
    return a[k + 1:] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1:]


def near_sets(words):
    """Words by every result of dropping one code point: near words share one (or one is the other's)."""
    by = {}
    for w in words:
        for k in {w} | {w[:i] + w[i + 1:] for i in range(len(w))}:
            by.setdefault(k, []).append(w)
    near = {w: set() for w in words}
    for group in by.values():
        for a in group:
            near[a].update(b for b in group if one_edit(a, b))
    return near


def plain(counts, ratio=S.RATIO):
    near = near_sets(counts)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def result(df):
    rows = [(r["word"], (r["form"], r["root"], r["n"], r["n_near"], r["form_n"])) for r in df.collect()]
    assert len(dict(rows)) == len(rows)
    return dict(rows)


def vocabulary_of(rows, min_length=7, min_count=2):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(S.UPPER, S.LOWER))
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}


def some_words(rng, n):
    out = set()
    while len(out) < n:
        w = "".join(rng.choices(ALPHABET[:rng.choice([2, 4, len(ALPHABET)])], k=rng.randint(7, 12)))
        out.add(w)
        for _ in range(rng.randint(0, 4)):
            at, c = rng.randrange(len(w) + 1), rng.choice(ALPHABET)
            w = rng.choice([w[:at] + c + w[at:], w[:at] + w[at + 1:], w[:at] + c + w[at + 1:]])
            if len(w) >= 7:
                out.add(w)
    return sorted(out)


@pytest.mark.parametrize("lot", [7, S.LOT])
def test_both_searches_find_every_near_pair_once(lot):
    words = some_words(random.Random(lot), 1500)
    pairs = []
    for side in (0, 1):
        q, w = S.near_words(words, words, side, lot)
        pairs += [(words[a], words[b]) for a, b in zip(q.tolist(), w.tolist())]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(a, b) for a, near in near_sets(words).items() for b in near}


def test_intervals_of_the_index_are_the_suffixes_with_a_front():
    words = some_words(random.Random(2), 60) + ["z" * 40, "z" * 41]
    index = S.Index(*S.symbols_of(words, False))
    for pattern in ["a", "ab", "zzzzzzz", "z" * 39, *(w[1:] for w in words[:20])]:
        lo, hi = np.array([0]), np.array([index.words])
        for c in pattern[::-1]:
            symbol = S.SYMBOL[[ord(c)]].astype(np.int64)
            lo, hi = index.step(symbol, lo), index.step(symbol, hi)
        assert hi[0] - lo[0] == sum(w.endswith(pattern) for w in words)


def test_query_on_its_table(spark):
    rows = duckdb.execute(f"SELECT doc_id, text FROM '{SF_SMALL}/documents.parquet'").fetchall()
    want = plain(vocabulary_of(rows))
    got = result(S.op11_spelling_variants(spark, SF_SMALL))
    assert got == want and any(v[0] for v in got.values())


def test_buckets_and_parts_of_any_size(spark):
    rng = random.Random(9)
    words = some_words(rng, 300) + ["comm" + w for w in some_words(rng, 200)]
    counts = {w: rng.choice([2, 3, 20, 25, 400, 5000]) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    want = plain(counts)
    for bucket in (16, 10_000):
        assert result(S.spelling_variants(df, bucket=bucket)) == want


def test_chains_and_ties(spark):
    chain = {"abcdefg" + "h" * k: 2 * 10 ** k for k in range(9)}
    counts = chain | {"zzzzzzzz": 5, "zzzzzzza": 50, "zzzzzzzb": 50, "qqqqqqqq": 5, "qqqqqqqa": 49}
    got = result(S.spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n bigint")))
    assert got == plain(counts)
    assert got["abcdefg"][1] == "abcdefg" + "h" * 8 and got["zzzzzzzz"][0] == "zzzzzzza" and got["qqqqqqqq"][0] is None


def test_edge_rows(spark):
    long = "q" * 3000
    rows = [(1, None), (2, ""), (None, "Wörterbuch wörterbuch WÖRTERBUCH " * 3), (3, f"{long} {long}x {long}" * 2), (3, "repeated repeated"),
            (3, "repeated repeated"), (4, "abc defgh 1234567 ÀÉÎÕÜÝÿ àéîõüýÿ " * 40)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, word int, n int")
    assert result(S.spelling_variants(S.vocabulary(df))) == plain(vocabulary_of(rows))
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert S.spelling_variants(S.vocabulary(empty)).count() == 0
