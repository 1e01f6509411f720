"""Operators 2 and 8 against the tokenizers library, a brute-force layout check and exact round trips."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from rolloutlab.llm import packing, token_files
from rolloutlab.llm.tokens import encoder, tokenizer_path
from rolloutlab.llm.common import scratch

ODD = ["", " ", "a  b", "a \n b", "\n\n", "x\ty z", "it's we'll don''t a'b", "foo.\n\nbar  baz\n", " lead", "trail ",
       "é.à! ñ***", "<|endoftext|> x <|startoftext|>", "1 234 5.6,7", "é ́x", "\x1c a \x85b", "İ Σ ΑΣ.",
       "a\r\nb \r\n c", "x| y|", "日本語 テキスト。\n次", "word " * 9000]
ROWS = [(5, None, "x"), (1, "The cat sat.", "y"), (1, "The cat sat.", "y"), (None, "no id", "z"), (9, "", None), (7, "w " * 9000, "")]
SCHEMA = "doc_id bigint, text string, ids string"          # a clashing extra column


@pytest.mark.parametrize("name,kind", [("byte_bpe_50k.json", "byte_level"), ("word_bpe_49k.json", "word")])
def test_encoder_equals_library(name, kind):
    enc = encoder(tokenizer_path(name), kind)
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("ab \n\t.,'sé1|* Áx") for _ in range(rng.randint(1, 30))) for _ in range(1500)]
    for t in texts:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("seed", range(6))
def test_layout_holds_every_piece_once(seed):
    rng = random.Random(seed)
    counts = Counter(min(100, max(1, int(rng.expovariate(1 / rng.choice([5, 20, 60]))))) for _ in range(rng.choice([1, 7, 400])))
    plan = packing.layout(counts, 100, groups=rng.choice([1, 5, 40]))
    used = Counter()
    for n, pattern in plan:
        assert n > 0 and sum(k * c for k, c in pattern) <= 100
        for k, c in pattern:
            used[k] += n * c
    assert used == counts
    least = -(-sum(k * c for k, c in counts.items()) // 100)
    assert sum(n for n, _ in plan) <= max(least + 3, 1.25 * least)


def test_layout_of_nothing():
    assert packing.layout({}, 100) == []


@pytest.mark.parametrize("planes", ["byte", "bit"])
@pytest.mark.parametrize("width", [2, 4])
def test_planes_round_trip(planes, width):
    ids = np.random.default_rng(1).integers(0, 50_000, 777).astype(f"<u{width}")
    index, payload = token_files.pack_segment(ids, width, planes, block_ids=100)
    assert [e["n_ids"] for e in index] == [100] * 7 + [77]
    assert np.array_equal(np.concatenate(list(token_files.read_blocks(index, payload, width, planes))), ids)
    only = list(token_files.read_blocks(index, payload, width, planes, wanted={3}))
    assert len(only) == 1 and np.array_equal(only[0], ids[300:400])
    index[2]["crc32"] ^= 1
    with pytest.raises(ValueError):
        list(token_files.read_blocks(index, payload, width, planes))


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_files_round_trip(spark, planes):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    path = scratch(spark, "t")
    token_files.write_token_files(docs, path, tokenizer_path("byte_bpe_50k.json"), "byte_level", planes=planes, block_ids=64,
                                  segment_ids=100, partitions=3)
    back = token_files.read_token_files(spark, path).collect()
    enc = encoder(tokenizer_path("byte_bpe_50k.json"), "byte_level")
    want = sorted(((r[0] if r[0] is not None else -1, enc.tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0]) for r in ROWS))
    got = sorted(((r.doc_id if r.doc_id is not None else -1, list(r.ids)) for r in back))
    assert got == want
    at = 0
    for r in sorted(back, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
    order = [-1 if r.doc_id is None else r.doc_id for r in sorted(back, key=lambda r: r.start)]
    assert order == sorted(order)


def test_files_of_empty_table(spark):
    path = scratch(spark, "t")
    token_files.write_token_files(spark.createDataFrame([], SCHEMA), path, tokenizer_path("byte_bpe_50k.json"), "byte_level")
    assert token_files.read_token_files(spark, path).count() == 0


def check_packed(rows, texts, enc, capacity, end_id):
    """Every id once, no sequence over capacity, offsets without gaps."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    for doc, text in texts:
        ids = enc.tokenizer.encode(text or "", add_special_tokens=False).ids + [end_id]
        for r in by_doc[doc]:
            part = ids[r.start:r.start + r.length]
            assert r.start == r.piece * capacity and r.length == min(capacity, len(ids) - r.start)
            assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    total = sum(r.length for r in rows)
    return len(by_seq), -(-total // capacity)


def test_pack_edge_rows(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    enc = encoder(tokenizer_path("word_bpe_49k.json"), "word")
    rows = packing.pack(docs, tokenizer_path("word_bpe_49k.json"), "word", capacity=128).collect()
    used, least = check_packed(rows, [(r[0], r[1]) for r in ROWS], enc, 128, 1)
    assert used <= least + 1
    assert packing.pack(spark.createDataFrame([], SCHEMA), tokenizer_path("word_bpe_49k.json"), "word").count() == 0


def test_queries_on_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = packing.op2_best_fit_packing(spark, sf).collect()
    used, least = check_packed(rows, docs, encoder(tokenizer_path("word_bpe_49k.json"), "word"), 4096, 1)
    assert {r.doc_id for r in rows} == {d for d, _ in docs} and used <= 1.02 * least + 1
    enc = encoder(tokenizer_path("byte_bpe_50k.json"), "byte_level")
    at, want = 0, []
    for d, t in sorted(docs):
        ids = enc.tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in token_files.op8_token_files(spark, sf).collect()) == want
