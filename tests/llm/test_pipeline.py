"""The pipeline against brute-force versions of its stages, and on odd input."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from rolloutlab.llm import quality as q
from rolloutlab.llm.common import table
from rolloutlab.llm.tokens import encoder, tokenizer_path

from test_decontaminate import brute as leaks, words
from test_line_dedup import brute as line_brute
from test_minhash_dedup import brute as near_brute
from test_tokens_packing import check_packed

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages_equal_brute_force(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    out = cp.stored(cp.quality(spark, docs, SF), "t")
    good = {r.doc_id for r in q.op6_quality_qda(spark, SF).where("predicted = 1").collect()}
    assert out.columns == columns and rows_of(out) == rows_of(docs.where(F.col("doc_id").isin(list(good))))

    before, out = out, cp.stored(cp.lines(spark, out, SF), "t")
    gone = dict(line_brute([(r.doc_id, r.text) for r in before.collect()]))
    want = []
    for r in before.collect():
        kept = "\n".join(x for i, x in enumerate(r.text.split("\n")) if i not in gone.get(r.doc_id, ()))
        if r.doc_id not in gone:
            want.append(tuple(r))
        elif kept.strip(" \t\r\n"):
            want.append((r.doc_id, kept, r.lang, r.source, len(kept)))
    assert out.columns == columns and rows_of(out) == sorted(want, key=repr)

    before, out = out, cp.stored(cp.near_dedup(spark, out, SF), "t")
    keep = {d for d, _, c in near_brute([(r.doc_id, r.text) for r in before.collect()]) if d == c}
    assert out.columns == columns and rows_of(out) == rows_of(before.where(F.col("doc_id").isin(list(keep))))

    before, out = out, cp.stored(cp.decontaminate(spark, out, SF), "t")
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    grams = {tuple(w[k:k + 3]): 1 for _, t in items for w in [words(t)] for k in range(len(w) - 2)}
    texts = [(r.doc_id, r.text) for r in before.collect()]
    near = [(d, t) for d, t in texts if any(tuple(w[k:k + 3]) in grams for w in [words(t)] for k in range(len(w) - 2))]
    bad = {d for d, *_ in leaks(near, items)}
    assert out.columns == columns and rows_of(out) == rows_of(before.where(~F.col("doc_id").isin(list(bad))))

    packed = cp.packing(spark, out, SF).collect()
    used, least = check_packed(packed, [(r.doc_id, r.text) for r in out.collect()], encoder(tokenizer_path("word_bpe_49k.json"), "word"), 4096, 1)
    assert used <= 1.02 * least + 1
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in cp.run(spark, SF).collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in packed)


ODD = [(1, None, "en", "s", 0, "x", 1), (2, "", None, None, None, None, None), (None, "no id at all here", "en", "s", 1, "", 0),
       (3, "same line of some length\nother words stand here", "en", "s", 9, "", 0), (3, "same line of some length\nother words stand here", "en", "s", 9, "", 0),
       (4, "same line of some length", "en", "s", 9, "", 0), (5, "long words " * 30_000, "en", "s", 9, "", 0)]


@pytest.mark.parametrize("rows", [ODD, []])
def test_odd_rows_pass_every_stage(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, values int")
    for name, stage in cp.STAGES[:-1]:
        docs, before = cp.stored(stage(spark, docs, SF), "t"), docs
        assert docs.columns == before.columns and docs.count() <= before.count()
    out = cp.packing(spark, docs, SF)
    assert out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_one_row_of_each_group_under_shared_ids(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    rows = [(None, a), (None, a), (None, b), (None, b + " end"), (7, b), (7, c), (7, c), (9, c + " end"), (9, "fresh words of nine alone"), (None, None), (8, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", i) for i, (d, t) in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = cp.near_dedup(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted([(None, a), (7, b), (7, c), (9, rows[8][1]), (None, None), (8, "")], key=repr)


def test_last_line_of_a_document(spark):
    docs = spark.createDataFrame(ODD[3:6:2], "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, values int")
    out = cp.lines(spark, docs, SF).collect()
    assert [(r.doc_id, r.text, r.n_chars) for r in out] == [(3, ODD[3][1], 9)]          # document 4 lost its only line


def test_stage_names():
    assert [n for n, _ in cp.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "packing"] and cp.ORACLE_SQL is None
    assert re.match("A corpus", cp.__doc__)
