"""Products with a heavy key and containment in a large dictionary: results and plans."""

import random
import re
from collections import Counter, defaultdict

from rolloutlab.operators import matching as M
from rolloutlab.operators import matrix as X


def plan(df):
    return df._jdf.queryExecution().toString()


def cells(df, *cols):
    return {tuple(r[c] for c in cols): r["v"] for r in df.collect()}


def test_heavy_key_is_spread_over_a_grid(spark):
    rng = random.Random(1)
    a = [(i, 0 if i % 3 == 0 else rng.randrange(1, 40), float(rng.randrange(9))) for i in range(600)]
    b = [(0 if j % 3 == 0 else rng.randrange(1, 40), j, float(rng.randrange(9))) for j in range(300)]
    left = spark.createDataFrame(a + a[:50], "i long, k long, v double")         # repeated cells add up
    right = spark.createDataFrame(b, "k long, j long, v double")
    want = defaultdict(float)
    by_k = defaultdict(list)
    for k, j, v in b:
        by_k[k].append((j, v))
    for i, k, v in a + a[:50]:
        for j, w in by_k[k]:
            want[i, j] += v * w
    for block in (16, X.BLOCK):
        assert cells(X.matmul(left, right, block=block), "i", "j") == dict(want)
    # 200 rows meet 100 rows of key 0: with blocks of 16, 13 x 7 cells of which none holds more than a few rows
    joined = X.block_join(left.groupBy("i", "k").agg({"v": "sum"}), right.withColumnRenamed("v", "w"), ["k"], ["i"], ["j"], 16)
    assert joined.where("k = 0").count() == 200 * 100
    p = plan(X.matmul(left, right, block=16))
    assert "CartesianProduct" not in p and re.search(r"_ra_at#\d+, _rb_at#\d+", p)


def test_batched_product_and_channels_with_a_heavy_key(spark):
    rng = random.Random(2)
    x = [(n, 0 if p % 3 else rng.randrange(5), p, float(rng.randrange(5))) for n in range(4) for p in range(60)]
    w = [(o, c, float(rng.randrange(5))) for o in range(50) for c in range(5)]
    want = defaultdict(float)
    for n, c, p, v in x:
        for o, c2, u in w:
            if c == c2:
                want[n, o, p] += v * u
    got = X.conv1x1(spark.createDataFrame(x, "batch long, c_in long, p long, v double"), spark.createDataFrame(w, "c_out long, c_in long, v double"), block=8)
    assert cells(got, "batch", "c_out", "p") == dict(want)
    a, b = spark.createDataFrame(x, "batch long, k long, i long, v double"), spark.createDataFrame([(n, *r) for n in range(4) for r in w], "batch long, j long, k long, v double")
    assert cells(X.matmul(a, b, ["batch"], block=8), "batch", "j", "i") == dict(want)


def plain(names, entries):
    """First entry, in order, that holds the name or stands in it, without case."""
    low = [(o, e.lower(), k) for o, e, k in sorted(entries)]
    return {n: next((k for _, e, k in low if e in n.lower() or n.lower() in e), None) for n in names}


def fuzzy(spark, names, entries):
    occ = spark.createDataFrame([(n, None) for n in names], "op string, key string")
    d = spark.createDataFrame(entries, "ord int, map_op string, key string")
    return M.match_fuzzy(occ, d)


def test_large_dictionary_equals_the_plain_scan(spark):
    rng = random.Random(3)
    syllables = ["con", "re", "lu", "max", "pool", "soft", "nn", "a", "ad", "mm", "Batch", "NORM", "_", "2d", "é"]

    def word(n):
        return "".join(rng.choices(syllables, k=n)) + (str(rng.randrange(10 ** 6)) if rng.random() < 0.7 else "")

    entries = [(i, word(rng.randint(2, 5)), f"k{i}") for i in range(100_000)]
    rng.shuffle(entries)
    names = list({word(rng.randint(1, 6)) for _ in range(300)} | {"zz-none", "x", "MM"})
    df = fuzzy(spark, names, entries)
    got = {r["op"]: r["key"] for r in df.collect()}
    assert got == plain(names, entries) and Counter(v is None for v in got.values())[False] > 50
    assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)


def test_short_empty_and_repeated_texts(spark):
    entries = [(5, "ab", "k5"), (2, "AB", "k2"), (7, "x", "k7"), (9, "longer entry", "k9"), (4, None, "k4")]
    names = ["ab", "b", "", "yxy", "ger", "nothing", "Q"]
    for more in ([], [(8, "", "k8")], [(0, "", "k0")]):
        got = {r["op"]: r["key"] for r in fuzzy(spark, names, entries + more).collect()}
        assert got == plain(names, [e for e in entries + more if e[1] is not None])
    assert [r["key"] for r in fuzzy(spark, ["a"], []).collect()] == [None]
