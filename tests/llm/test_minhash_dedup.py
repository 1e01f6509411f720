"""Operator 5 against exact Jaccard over all pairs."""

import random
import re

import pytest

from rolloutlab.llm import minhash_dedup as md

SCHEMA = "doc_id bigint, text string, component bigint, cid string"     # clashing extra columns


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return set()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if len(words) >= 5 else {tuple(words)}


def brute(rows):
    """(doc_id, n_shingles, component) by all pairs, with an inverted index."""
    sets = [shingles(r[1]) for r in rows]
    at = {}
    for i, s in enumerate(sets):
        for x in s:
            at.setdefault(x, []).append(i)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    seen = set()
    for group in at.values():
        for j in group[1:]:
            if (group[0], j) in seen:
                continue
        for a in range(len(group)):
            for b in range(a + 1, len(group)):
                i, j = group[a], group[b]
                if (i, j) in seen:
                    continue
                seen.add((i, j))
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    parent[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), low.get(find(i))) for i, r in enumerate(rows)), key=repr)


def result(df):
    out = df.collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=repr)


def noisy(rng, words, rate):
    return [w if rng.random() > rate else rng.choice(["new", "other", f"x{rng.random():.3f}"]) for w in words]


def test_groups_equal_brute_force(spark):
    rng = random.Random(5)
    rows, ids = [], iter(rng.sample(range(10_000), 2000))
    for _ in range(25):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 6, 40, 120]))]
        for _ in range(rng.choice([1, 2, 14])):
            rows.append((next(ids), " ".join(noisy(rng, base, rng.choice([0, 0.01, 0.03]))), 1, "c"))
    hub = [f"h{i}" for i in range(150)]                                       # a chain and a hub of weak links
    chain = list(hub)
    for k in range(30):
        chain[k * 5] = f"c{k}"
        rows.append((next(ids), " ".join(chain), 1, "c"))
    for _ in range(60):
        rows.append((next(ids), " ".join(noisy(rng, hub, 0.028)), 1, "c"))
    rows += [(next(ids), r[1].upper().replace(" ", " \n\t"), 0, None) for r in rows[:20]]
    assert result(md.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute(rows)


def test_edge_rows(spark):
    long = " ".join(f"l{i}" for i in range(30_000))
    rows = [(1, None, 1, "x"), (2, "", 1, "x"), (3, " \n\t", 1, "x"), (4, "one two", 1, "x"), (3, "ONE  two", 1, "x"), (5, "one two three", 1, None),
            (7, long, 1, "x"), (6, long + " tail", 1, "x"), (8, "a b c d e f", 1, "x"), (8, "a b c d e f", 1, "x"), (None, "a b c d e f", 1, "x"),
            (None, "lonely words without any id", 1, "x"), (9, "é É   x y", 1, "x")]
    assert result(md.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert result(md.near_duplicates(spark.createDataFrame([], SCHEMA))) == []


def test_least_matches_bounds_the_miss():
    least = md.least_matches(0.75, 128, 32, 1e-6)
    assert sorted(least) == [32, 64, 96, 128] and all(0 < m < 0.75 * n for n, m in least.items())


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_query_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert result(md.op5_minhash_dedup(spark, sf)) == brute(rows)
