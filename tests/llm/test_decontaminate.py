"""Operator 10 against plain word edit distance over whole documents."""

import random
import re

import numpy as np
import pytest

from rolloutlab.llm import decontaminate as dc

DOCS = "doc_id bigint, text string, item_id int, distance string"       # clashing extra columns
ITEMS = "item_id bigint, text string, doc_id string"


def words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())


def least_edits(item, text):
    """Edit distance of the item to its closest run of the text."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def brute(docs, items, rate=0.2):
    out = []
    for d, text, *_ in docs:
        for i, wanted, *_ in items:
            w = words(wanted)
            if w and (e := least_edits(w, words(text))) <= int(rate * len(w)):
                out.append((d, i, e))
    return sorted(out, key=repr)


def edit(rng, text, k):
    x = text.split()
    for _ in range(k):
        kind, at = rng.randrange(3), rng.randrange(len(x))
        if kind == 0:
            x[at] = f"n{rng.random():.6f}"
        elif kind == 1:
            x.insert(at, f"n{rng.random():.6f}")
        else:
            x.pop(at)
    return " ".join(x)


def test_item_distance_equals_plain_dynamic_programme():
    rng = np.random.default_rng(0)
    for _ in range(300):
        item, text = (rng.integers(0, 4, rng.integers(1, 9)).astype(np.uint64) for _ in range(2))
        d, a, b = dc.item_distance(item, text)
        assert d == least_edits(item.tolist(), text.tolist())
        run, row = text[a:b].tolist(), list(range(b - a + 1))
        for i, w in enumerate(item.tolist(), 1):
            new = [i]
            for j, t in enumerate(run, 1):
                new.append(min(row[j - 1] + (w != t), row[j] + 1, new[-1] + 1))
            row = new
        assert row[-1] == d


def test_embedding_is_the_walk():
    seeds = np.array([5, 9], np.uint64)
    x = np.array([[1, 2, 3]], np.uint64)
    assert dc.embed(x, seeds).shape == (2, 1, 9)
    assert (dc.embed(np.concatenate([x, x]), seeds)[:, 0] == dc.embed(np.concatenate([x, x]), seeds)[:, 1]).all()


def test_planted_edits_equal_brute_force(spark):
    rng = random.Random(4)
    items = [(i, " ".join(f"v{rng.randrange(300)}" for _ in range(rng.choice([1, 3, 5, 12, 30, 60]))), "x") for i in range(25)]
    items += [(3, items[3][1], "again"), (90, "", ""), (91, None, None)]
    docs = []
    for d in range(160):
        i, text, _ = rng.choice(items[:25])
        n = len(text.split())
        body = [f"v{rng.randrange(300)}" for _ in range(rng.choice([0, 4, 80]))]
        planted = edit(rng, text, rng.randint(0, int(0.2 * n) + 1)) if n > 1 else text
        at = rng.randint(0, len(body))
        docs.append((d, " ".join(body[:at] + [planted.upper().replace(" ", ", ")] + body[at:]), 0, ""))
    got = dc.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    want = brute(docs, items)
    assert sorted(((r.doc_id, r.item_id, r.distance) for r in got), key=repr) == want and len(want) > 60
    blocks = dc.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), block_words=100).collect()
    assert sorted(map(repr, blocks)) == sorted(map(repr, got))


def test_edge_rows(spark):
    item = "one two three four five six seven eight nine ten"
    far = "w " * 40_000 + item
    docs = [(1, None, 0, ""), (2, "", 0, ""), (3, item, 0, ""), (3, item, 0, ""), (None, f"x {item} y {item}", 0, ""), (4, far, 0, "")]
    out = dc.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(7, item, "")], ITEMS)).collect()
    assert sorted((repr(r.doc_id), r.item_id, r.distance, r.first_word, r.last_word, r.n_passages) for r in out) == [
        ("3", 7, 0, 0, 9, 1), ("3", 7, 0, 0, 9, 1), ("4", 7, 0, 40_000, 40_009, 1), ("None", 7, 0, 1, 10, 2)]
    none = spark.createDataFrame([], ITEMS)
    assert dc.contamination(spark.createDataFrame(docs, DOCS), none).count() == 0
    assert dc.contamination(spark.createDataFrame([], DOCS), spark.createDataFrame([(7, item, "")], ITEMS)).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    # plain distances only where some word of the item occurs; the rest cannot match
    some = [(d, t) for d, t in docs if len(words(t)) < 3000]
    got = dc.op10_decontamination(spark, sf).collect()
    ids = {d for d, _ in some}
    inverted = {}
    for i, t in items:
        for w in range(len(words(t)) - 3):
            inverted.setdefault(tuple(words(t)[w:w + 4]), set()).add(i)
    near = []
    for d, t in some:
        w = words(t)
        hits = {i for k in range(len(w) - 3) for i in inverted.get(tuple(w[k:k + 4]), ())}
        near += brute([(d, t)], [x for x in items if x[0] in hits])
    assert sorted((r.doc_id, r.item_id, r.distance) for r in got if r.doc_id in ids) == sorted(near)


def test_repetitions_hold_the_worst_length_and_never_stop_short():
    import numpy as np
    import pytest

    from rolloutlab.llm import decontaminate as D
    rng = np.random.default_rng(3)
    items = [rng.integers(1, 2**62, n).astype(np.uint64) for n in [200] * 60 + [5, 11, 16]]
    reps = D.repetitions(items, D.RATE, D.SAMPLE, D.RECALL)
    assert reps >= max(D.repetitions(items[k:k + 1], D.RATE, D.SAMPLE, 0.99) for k in (0, 60, 61, 62))
    for n in (5, 11, 16, 200):
        words = rng.integers(1, 2**62, n).astype(np.uint64)
        hit = D.agreement([words], int(D.RATE * n), 2000, np.random.default_rng(8)) ** D.SAMPLE
        assert ((1 - hit) ** reps).mean() < 0.005
    with pytest.raises(ValueError):
        D.repetitions(items, D.RATE, 4096, D.RECALL)


@pytest.mark.parametrize("n", [5, 12, 30, 60, 120])
def test_keys_find_edited_windows_and_refuse_unrelated_ones(n):
    rng = np.random.default_rng(n)
    k = int(dc.RATE * n)
    vocabulary = rng.integers(1, 2**62, 20_000).astype(np.uint64)
    item = rng.choice(vocabulary, n)
    reps = dc.repetitions([item], dc.RATE, dc.SAMPLE, dc.RECALL)
    screen = dc.Screen([1], [item], dc.RATE, dc.SAMPLE, reps)
    near = [screen.agrees(item, dc.edited(item, k, rng)[None, :]) for _ in range(400)]
    far = [screen.agrees(item, rng.choice(vocabulary, (2 * k + 1, n))) for _ in range(100)]
    assert sum(near) >= 0.99 * len(near) and sum(far) <= 1
    front = item.copy()                                                 # all edits at the front
    front[:k] = rng.integers(1, 2**62, k)
    assert screen.agrees(item, front[None, :])
