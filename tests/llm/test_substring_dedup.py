"""Operator 4 against a dictionary of all windows."""

import hashlib
import random

import pytest

from rolloutlab.llm import substring_dedup as sd

SCHEMA = "doc_id bigint, text string, spans string, n_bytes int"          # clashing extra columns


def brute(rows, length):
    least = {}
    for d, t, *_ in rows:
        b = (t or "").encode()
        key = float("-inf") if d is None else d
        for i in range(len(b) - length + 1):
            w = b[i:i + length]
            least[w] = min(least.get(w, key), key)
    out = []
    for d, t, *_ in rows:
        b = (t or "").encode()
        key = float("-inf") if d is None else d
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if least[b[i:i + length]] < key:
                gone[i:i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    rows = df.collect()
    for r in rows:
        if "spans" in df.columns:
            assert sum(s.end - s.start for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows), key=repr)


@pytest.mark.parametrize("seed,alphabet,length,piece", [(0, "ab", 12, 5), (1, "abc", 9, 9), (2, "abcdefgh é", 14, 6), (3, "a", 6, 3)])
def test_random_texts_equal_brute_force(spark, seed, alphabet, length, piece, monkeypatch):
    rng = random.Random(seed)
    pool = ["".join(rng.choice(alphabet) for _ in range(rng.randint(5, 60))) for _ in range(12)]
    ids = rng.sample(range(-50, 500), 90)
    rows = [(i, "".join(rng.choice(pool) if rng.random() < 0.6 else rng.choice(alphabet) for _ in range(rng.randint(0, 8))), "", 0) for i in ids]
    rows += [(ids[0], rows[3][1], "", 0), (ids[5], rows[5][1], "", 0), (None, rows[7][1], "", 0), (None, None, "", 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert result(sd.repeated_substrings(df, length, piece, block_bytes=300, buckets=5)) == brute(rows, length)


def test_edge_rows(spark):
    long = "".join(random.Random(1).choice("abcdefghij ") for _ in range(150_000))
    rows = [(1, None, "", 0), (2, "", "", 0), (3, "x" * 49, "", 0), (4, "x" * 49, "", 0), (5, "y" * 50, "", 0), (6, "y" * 200, "", 0), (6, "y" * 200, "", 0),
            (9, long, "", 0), (8, "tail" + long[60_000:60_120] + "head", "", 0), (10, "é" * 25, "", 0), (11, "z" + "é" * 25, "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(sd.repeated_substrings(df)) == brute(rows, 50)
    assert result(sd.repeated_substrings(spark.createDataFrame([], SCHEMA))) == []
    with pytest.raises(ValueError):
        sd.repeated_substrings(df, 10, 11)


def test_stretches_move_no_window(spark, monkeypatch):
    rng = random.Random(2)
    base = "".join(rng.choice("abcd ") for _ in range(900))
    rows = [(i, base[rng.randrange(500):][:rng.randrange(400)] + rng.choice("xyz"), "", 0) for i in range(40)]
    want = brute(rows, 50)
    import numpy as np
    from rolloutlab.llm.vectext import text_bytes
    import pyarrow as pa
    data, offsets = text_bytes(pa.array([r[1] for r in rows]))
    whole = {}
    for step in (64, 333, 1 << 20):
        monkeypatch.setattr(sd, "STRETCH", step)
        found = [(int(s), int(h)) for p in sd.stretches(data, offsets, 50, 20) for s, h in zip(*p.windows(np.arange(len(p.start)))[:2])]
        whole[step] = sorted(found)
    assert whole[64] == whole[333] == whole[1 << 20]
    assert result(sd.repeated_substrings(spark.createDataFrame(rows, SCHEMA), block_bytes=500)) == want


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_query_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert result(sd.op4_substring_dedup(spark, sf)) == brute(rows, 50)
