"""Operator 5 - MinHash near-duplicates with sequential Bayesian verification.

1. Each text gets its set of word shingles, the set's size and fingerprint and
   a MinHash signature. Texts with the same set are one class.
2. Banding: classes that agree on all values of a band are candidates. In each
   band bucket every class is paired with one leader only (the member that meets
   most others), so a bucket of n classes gives n - 1 pairs.
3. Sequential Bayesian test: signatures of a pair are compared in batches; after
   each, a pair goes if the posterior probability of similarity >= threshold is
   below ``miss`` (uniform prior, precomputed least counts).
4. Survivors are verified on their full sets; links join components.
5. Members of one bucket that are not in one component by now are compared as in
   3 and 4, in blocks of bounded size that give back links only. So every
   candidate of the banding is verified, pruned by the test, or already inside
   one component.

With 32 bands of 4 values a pair at similarity 0.75 is missed by all bands with
probability 5e-6; ``miss`` adds at most its own share.

Edge cases: null texts and texts without words have an empty set and link with
nothing; fewer words than a shingle make the whole sequence one shingle; rows
that repeat an id share its component; a null id never becomes a component
while the group has another id; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloutlab.llm.common import components, id_text, stored, table
from rolloutlab.llm.vectext import LOWER, chunks, mix, ngram_hashes, span_hashes, text_bytes, word_spans

SHINGLE = 5
NUMERATOR, DENOMINATOR = 75, 100       # similarity >= 75 / 100, compared in whole numbers
BANDS, ROWS = 32, 4
BATCH = 32                             # signature values compared at a time
MISS = 1e-6                            # posterior probability below which a pair is pruned
CLASS = ["n", "h1", "h2"]              # what a class of equal sets is known by
BLOCK, BLOCK_VALUES = 2048, 2_000_000  # members and shingles of one side of a task that compares a split bucket

WORD_BYTE = np.ones(256, bool)
WORD_BYTE[[0x20, 9, 10, 11, 12, 13]] = False


def _multipliers(k: int) -> np.ndarray:
    return np.random.default_rng(77).integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int):
    """The sorted distinct shingle hashes of each text, as (values, bounds)."""
    low = LOWER[data]
    starts, ends, rows = word_spans(low, offsets, WORD_BYTE)
    words = span_hashes(low, starts, ends)
    bounds = np.searchsorted(rows, np.arange(len(offsets)))
    grams = ngram_hashes(words, n)
    out, sizes = [], []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= n:
            one = np.sort(grams[a:b - n + 1])
            one = one[np.concatenate([[True], one[1:] != one[:-1]])]
        elif b > a:
            one = ngram_hashes(words[a:b], b - a) ^ np.uint64(b - a)
        else:
            one = words[:0]
        out.append(one)
        sizes.append(len(one))
    return (np.concatenate(out) if out else words[:0]), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def signatures(values: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """k MinHash values (uint32) of each non-empty set; empty sets get zeros."""
    out = np.zeros((len(bounds) - 1, k), np.uint32)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        at = bounds[:-1][full]
        buffer = np.empty_like(values)
        for j, a in enumerate(_multipliers(k)):
            np.multiply(values, a, out=buffer)
            out[full, j] = np.minimum.reduceat(buffer, at) >> np.uint64(32)
    return out


def fingerprints(values: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Two order-free 64-bit fingerprints of each set."""
    out = []
    for salt in (0x1234567, 0xABCDEF1):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values ^ np.uint64(salt)))])
        out.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return out


def sketch(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_hash, n (set size), h1, h2 (set fingerprint), sig (binary) of every row."""

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in chunks(offsets):
                values, bounds = shingle_sets(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], shingle)
                sig = signatures(values, bounds, bands * rows)
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(np.diff(bounds)),
                                       *map(pa.array, fingerprints(values, bounds)), pa.array([s.tobytes() for s in sig], pa.binary())],
                                      names=["doc_id", "text_hash", "n", "h1", "h2", "sig"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id bigint, text_hash bigint, n bigint, h1 bigint, h2 bigint, sig binary")


def bands_of(sig: np.ndarray, rows: int) -> np.ndarray:
    """The band keys (uint64) of signatures."""
    parts = sig.reshape(len(sig), -1, rows).astype(np.uint64)
    key = np.broadcast_to(mix(np.arange(1, parts.shape[1] + 1, dtype=np.uint64)), parts.shape[:2]).copy()
    for r in range(rows):
        key = mix(key ^ parts[:, :, r])
    return key


def band_keys(classes: DataFrame, bands: int, rows: int) -> DataFrame:
    """(key, cid) for every band of every class."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            key = bands_of(np.stack([np.frombuffer(s, np.uint32) for s in batch.column(1).to_pylist()]), rows)
            cid = np.repeat(batch.column(0).to_numpy(), bands)
            yield pa.record_batch([pa.array(key.view(np.int64).ravel()), pa.array(cid)], names=["key", "cid"])

    return classes.select("cid", "sig").mapInArrow(run, "key bigint, cid bigint")


def least_matches(threshold: float, total: int, batch: int, miss: float) -> dict[int, int]:
    """After n compared values, the least matches with which a pair stays.

    With a uniform prior the posterior after m matches of n is Beta(m + 1, n - m + 1);
    P(similarity >= t) is the binomial tail P(X <= m), X ~ Bin(n + 1, t)."""
    out = {}
    for n in range(batch, total + 1, batch):
        tail, m = 0.0, -1
        for k in range(n + 1):
            tail += math.comb(n + 1, k) * threshold ** k * (1 - threshold) ** (n + 1 - k)
            if tail >= miss:
                m = k
                break
        out[n] = m
    return out


def bayes_prune(pairs: DataFrame, least: dict[int, int], batch: int) -> DataFrame:
    """Pairs (a, b, sig_a, sig_b) that stay, with their matching signature values."""

    def run(batches):
        for part in batches:
            if not part.num_rows:
                continue
            a, b = (np.stack([np.frombuffer(s, np.uint32) for s in part.column(i).to_pylist()]) for i in (2, 3))
            alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
            for n, need in least.items():
                matches[alive] += (a[alive, n - batch:n] == b[alive, n - batch:n]).sum(axis=1)
                alive = alive[matches[alive] >= need]
            idx = pa.array(alive)
            yield pa.record_batch([part.column(0).take(idx), part.column(1).take(idx), pa.array(matches[alive])], names=["a", "b", "matches"])

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a bigint, b bigint, matches bigint")


def verify(pairs: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def run(batches):
        for part in batches:
            left, right = part.column(2).to_pylist(), part.column(3).to_pylist()
            ok = []
            for x, y in zip(left, right):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = int((np.searchsorted(y, x, "right") - np.searchsorted(y, x, "left")).sum())
                ok.append(denominator * both >= numerator * (len(x) + len(y) - both))
            yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    x = sets.select(F.col("cid").alias("a"), F.col("values").alias("va"))
    y = sets.select(F.col("cid").alias("b"), F.col("values").alias("vb"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "va", "vb").mapInArrow(run, "a bigint, b bigint")


def compare_buckets(members: DataFrame, details: DataFrame, least: dict[int, int], batch: int, rows: int, num: int, den: int,
                    most: int = BLOCK, most_values: int = BLOCK_VALUES) -> DataFrame:
    """Links (a, b) between members (key, cid, c) of one bucket with different components c.

    A bucket is cut into parts of bounded size and every two parts are one
    task's work: signatures are compared batch by batch, what the Bayesian test
    leaves is verified on the full sets, and only a spanning forest of the links
    found comes out, so no list of pairs exists. Two members that share several
    buckets are compared in the first band they share."""
    wide = members.join(details, "cid")
    sizes = wide.groupBy("key").agg(F.ceil(F.greatest(F.count(F.lit(1)) / most, F.sum("n") / most_values)).cast("int").alias("parts"))
    cut = wide.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("cid"), "parts").cast("int"))
    # part p meets every part q: in the task (min, max)
    dealt = cut.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "key", F.least("part", "q").alias("i"), F.greatest("part", "q").alias("j"), "part", "cid", "c", "n", "sig", "values")

    def run(t: pa.Table) -> pa.Table:
        key = t["key"][0].as_py()
        cid, comp, n, part = (t[k].to_numpy() for k in ("cid", "c", "n", "part"))
        sig = np.stack([np.frombuffer(s, np.uint32) for s in t["sig"].to_pylist()])
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
        band = int(np.flatnonzero(bands_of(sig[:1], rows)[0].view(np.int64) == key)[0])
        x, y = sig[left], sig[right]
        alive = comp[left][:, None] != comp[right][None, :]
        if i == j:
            alive &= cid[left][:, None] < cid[right][None, :]
        small, large = np.minimum(n[left][:, None], n[right][None, :]), np.maximum(n[left][:, None], n[right][None, :])
        alive &= den * small >= num * large
        for b in range(band):                         # met in an earlier band already
            same = np.ones(alive.shape, bool)
            for r in range(b * rows, b * rows + rows):
                same &= x[:, r][:, None] == y[:, r][None, :]
            alive &= ~same
        a, b = np.nonzero(alive)
        matches = np.zeros(len(a), np.int64)
        for stop, need in least.items():
            for lo in range(0, len(a), 1 << 16):
                cut_ = slice(lo, lo + (1 << 16))
                matches[cut_] += (x[a[cut_], stop - batch:stop] == y[b[cut_], stop - batch:stop]).sum(axis=1)
            stay = matches >= need
            a, b, matches = a[stay], b[stay], matches[stay]
        values = t["values"]
        found, root = [], {}

        def top(k):
            while root.get(k, k) != k:
                root[k] = root.get(root[k], root[k])
                k = root[k]
            return k

        cached, at = None, -1
        for u, v in zip(left[a].tolist(), right[b].tolist()):
            p, q = top(int(comp[u])), top(int(comp[v]))
            if p == q:                                # joined by links of this task already
                continue
            if u != at:
                cached, at = np.frombuffer(values[u].as_py(), np.uint64), u
            other = np.frombuffer(values[v].as_py(), np.uint64)
            both = int((np.searchsorted(other, cached, "right") - np.searchsorted(other, cached, "left")).sum())
            if den * both >= num * (len(cached) + len(other) - both):
                root[p] = q
                found.append((int(cid[u]), int(cid[v])))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return dealt.groupBy("key", "i", "j").applyInArrow(run, "a bigint, b bigint")


def full_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(cid, values) of the wanted (cid, doc_id, n, h1, h2) classes, from the texts."""

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for lo, hi in chunks(offsets):
                values, bounds = shingle_sets(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], shingle)
                yield pa.record_batch([pa.array(np.diff(bounds)), *map(pa.array, fingerprints(values, bounds)),
                                       pa.array([values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())],
                                      names=["n", "h1", "h2", "values"])

    ids = wanted.select(F.col("doc_id").alias("id")).distinct()
    found = (docs.join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
             .withColumn("t", F.xxhash64("text")).dropDuplicates(["doc_id", "t"]).select("text"))
    sets = found.mapInArrow(run, "n bigint, h1 bigint, h2 bigint, values binary")
    return sets.join(wanted.select("cid", *CLASS), CLASS).select("cid", "values")


def groups(docs: DataFrame, shingle: int, similarity: tuple[int, int], bands: int, rows: int, batch: int, miss: float) -> tuple[DataFrame, DataFrame]:
    """The sketch of every row of (doc_id, text), and (*CLASS, doc_id, c) with the component c of every class.

    A class is known by its size and both fingerprints; its cid is a number given when the classes are written."""
    num, den = similarity
    sketches = stored(sketch(docs, shingle, bands, rows), "sketches")
    classes = stored(sketches.where("n > 0").groupBy(*CLASS).agg(F.min("doc_id").alias("doc_id"), F.any_value("sig").alias("sig"))
                     .withColumn("cid", F.monotonically_increasing_id()), "classes")
    keys = band_keys(classes, bands, rows)
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = stored(keys.join(shared, "key"), "buckets")
    # a bucket is led by its member that meets most others over all its buckets
    weights = buckets.groupBy("cid").agg(F.sum("size").alias("weight"))
    led = buckets.join(weights, "cid").groupBy("key").agg(F.max(F.struct("weight", "cid")).alias("top")).select("key", F.col("top.cid").alias("lead"))
    star = stored(buckets.join(led, "key").where("cid <> lead")
                  .select(F.least("cid", "lead").alias("a"), F.greatest("cid", "lead").alias("b")).distinct(), "star")
    limits = least_matches(num / den, bands * rows, batch, miss)

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs that stay in the Bayesian test and are similar enough on their full sets."""
        x = classes.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sig_a"))
        y = classes.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sig_b"))
        fitting = pairs.join(x, "a").join(y, "b").where(f"{den} * least(na, nb) >= {num} * greatest(na, nb)")
        left = stored(bayes_prune(fitting, limits, batch), "survivors")
        need = left.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
        sets = stored(full_sets(docs, classes.select("cid", "doc_id", *CLASS).join(need, "cid"), shingle), "full-sets")
        return stored(verify(left, sets, num, den), "links")

    links = linked(star)
    comps = components(links, "near-components")
    # members of one bucket in different components have not been compared yet, but for the star's pairs
    marked = (buckets.select("key", "cid").join(comps.withColumnRenamed("id", "cid"), "cid", "left")
              .select("key", "cid", F.coalesce("component", "cid").alias("c")))
    split = marked.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
    rest = stored(marked.join(split, "key"), "split-buckets")
    open_ = classes.join(rest.select("cid").distinct(), "cid")
    sets = stored(full_sets(docs, open_.select("cid", "doc_id", *CLASS), shingle), "full-sets")
    more = stored(compare_buckets(rest, open_.select("cid", "n", "sig").join(sets, "cid"), limits, batch, rows, num, den), "links")
    comps = components(links.unionAll(more), "near-components")
    return sketches, (classes.select("cid", "doc_id", *CLASS).join(comps.withColumnRenamed("id", "cid"), "cid", "left")
                      .select(*CLASS, "doc_id", F.coalesce("component", "cid").alias("c")))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: tuple[int, int] = (NUMERATOR, DENOMINATOR), bands: int = BANDS,
                    rows: int = ROWS, batch: int = BATCH, miss: float = MISS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    sketches, named = groups(id_text(docs, id_col, text_col), shingle, similarity, bands, rows, batch, miss)
    smallest = named.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    named = named.join(smallest, "c").select(*CLASS, "component_id")
    return (sketches.select("doc_id", *CLASS).join(named, CLASS, "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, similarity: tuple[int, int] = (NUMERATOR, DENOMINATOR), bands: int = BANDS,
                rows: int = ROWS, batch: int = BATCH, miss: float = MISS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, whole: that of the smallest id, then of the smallest hash of the text (equal rows: any).

    A row is known by its id, null or not, and its text's 64-bit hash, so other
    texts under the same id do not come with it. Rows without words all stay."""
    sketches, named = groups(id_text(docs, id_col, text_col), shingle, similarity, bands, rows, batch, miss)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("r")
    chosen = (sketches.where("n > 0").select(*CLASS, "doc_id", "text_hash").join(named.select(*CLASS, "c"), CLASS).groupBy("c").agg(first)
              .select("r.doc_id", "r.text_hash", F.lit(True)))
    wordless = sketches.where("n = 0").select("doc_id", "text_hash", F.lit(False)).distinct()
    kept = chosen.unionAll(wordless).toDF("__id", "__hash", "__words")
    same = docs[id_col].eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == F.col("__hash"))
    return (docs.join(kept, same).withColumn("__row", F.when(~F.col("__words"), F.monotonically_increasing_id()))
            .dropDuplicates(["__id", "__hash", "__row"]).select(*(f"`{c}`" for c in docs.columns)))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


ORACLE = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common, any_value(a.n) AS na, any_value(b.n) AS nb
          FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
near AS (SELECT a, b FROM pairs WHERE {DENOMINATOR} * common >= {NUMERATOR} * (na + nb - common)),
l AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT l.b, reach.c FROM reach JOIN l ON reach.id = l.a),
least AS (SELECT id, min(c) AS component_id FROM reach GROUP BY id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least.component_id, s.doc_id = least.component_id AS kept
FROM s JOIN least ON s.doc_id = least.id"""
