"""Operator 2 - best-fit packing with linear grouping.

Documents are cut into pieces of at most ``capacity`` tokens. Only the number
of pieces of each length matters for the layout, and there are at most
``capacity`` lengths, so the layout is made once, on a table of that bounded
size:

1. linear grouping: pieces longer than ``small`` are sorted by length and put
   into groups of equal cardinality; every length is rounded up to the largest
   of its group;
2. few-size configurations: the fullest sequence that holds the largest size
   left is found by dynamic programming over the few sizes and used as often
   as the demand allows, until nothing is left;
3. substitution: real lengths take the places of the rounded ones, which
   leaves some room;
4. best fit: small pieces, longest first, go where the room left is smallest.

The pieces themselves are ranked inside their length (spread over hash buckets,
so that a length held by a third of all pieces is not one task's work) and take
the place that the layout gives to their rank.

Edge cases: null or empty texts are one piece that holds the end id; a piece of
exactly ``capacity`` ids fills its sequence; repeated ids or rows are packed
once per input row; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolloutlab.llm.common import id_text, shuffle_width, stored, table
from rolloutlab.llm.tokens import encoded, encoder, tokenizer_path

CAPACITY = 4096
GROUPS = 256


def linear_groups(counts: dict[int, int], groups: int) -> list[list[list[int]]]:
    """Runs [length, count] by group, longest first; all groups have equally many pieces (the last may have fewer)."""
    total = sum(counts.values())
    size = max(1, -(-total // groups))
    out: list[list[list[int]]] = [[]]
    room = size
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            take = min(left, room)
            out[-1].append([length, take])
            left, room = left - take, room - take
            if room == 0:
                out.append([])
                room = size
    return [g for g in out if g]


def fullest(sizes: list[int], demand: list[int], must: int, capacity: int) -> dict[int, int]:
    """The configuration with the most tokens that holds one piece of group ``must``: {group: pieces}."""
    room = capacity - sizes[must]
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for j, s in enumerate(sizes):
        for _ in range(min(demand[j] - (j == must), room // s)):
            nxt = (reach | reach << s) & mask
            if nxt == reach:
                break
            steps.append((j, reach))
            reach = nxt
    best = reach.bit_length() - 1
    config = {must: 1}
    for j, before in reversed(steps):
        if not before >> best & 1:
            config[j] = config.get(j, 0) + 1
            best -= sizes[j]
    return config


def layout(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int | None = None) -> list[tuple[int, list[tuple[int, int]]]]:
    """Sequence patterns for pieces of the given lengths: [(how many sequences, [(length, pieces), ...])]."""
    small = capacity // 8 if small is None else small
    grouped = linear_groups({k: n for k, n in counts.items() if small < k <= capacity and n}, groups)
    sizes, demand = [g[0][0] for g in grouped], [sum(n for _, n in g) for g in grouped]
    bins: dict[int, list] = defaultdict(list)            # room left -> [(sequences, {length: pieces})]
    for must in range(len(sizes)):
        while demand[must]:
            config = fullest(sizes, demand, must, capacity)
            times = min(demand[j] // c for j, c in config.items())
            for j, c in config.items():
                demand[j] -= c * times
            while times:                                   # substitute real lengths, a run at a time
                same = min(grouped[j][0][1] // c for j, c in config.items())
                step = min(times, max(1, same))
                pattern: dict[int, int] = defaultdict(int)
                for j, c in config.items():
                    need = c if same else c * step
                    if same:
                        pattern[grouped[j][0][0]] += c
                        grouped[j][0][1] -= c * step
                        if not grouped[j][0][1]:
                            grouped[j].pop(0)
                        continue
                    while need:
                        run = grouped[j][0]
                        take = min(need, run[1])
                        pattern[run[0]] += take
                        run[1] -= take
                        need -= take
                        if not run[1]:
                            grouped[j].pop(0)
                bins[capacity - sum(k * n for k, n in pattern.items())].append((step, dict(pattern)))
                times -= step
    rooms = sorted(bins)
    for length in sorted((k for k in counts if k <= small and counts[k]), reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                n, pattern = bins[room].pop()
                if not bins[room]:
                    rooms.pop(at)
                    del bins[room]
            else:
                room, n, pattern = capacity, left, {}
            each = min(room // length, left)
            used = min(n, left // each)
            if pattern and used < n:
                if room not in bins:
                    insort(rooms, room)
                bins[room].append((n - used, pattern))
            left -= used * each
            rest = room - each * length
            if rest not in bins:
                insort(rooms, rest)
            bins[rest].append((used, pattern | {length: pattern.get(length, 0) + each}))
    return [(n, sorted(p.items(), reverse=True)) for group in bins.values() for n, p in group]


def places(patterns) -> dict[str, np.ndarray]:
    """Lookup arrays: of each run of ranks of a length, its first rank and where its pieces stand."""
    rows, ranks, sequence = [], defaultdict(int), 0
    for n, pattern in patterns:
        offset = 0
        for length, each in pattern:
            rows.append((length, ranks[length], sequence, each, offset))
            ranks[length] += n * each
            offset += length * each
        sequence += n
    rows.sort()
    names = ("length", "rank", "sequence", "each", "offset")
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(names)}


def pieces(docs: DataFrame, tokenizer: str, kind: str, end_id: int, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """Every document's pieces: doc_id, piece, start, length, ids_crc32."""

    def run(batches):
        enc = encoder(tokenizer, kind)
        end = np.array([end_id], "<u4").tobytes()
        step = 4 * capacity
        for batch in batches:
            ids = batch.column(0)
            at, piece, start, length, crc = [], [], [], [], []
            for lo, texts in encoded(batch.column(1), enc):
                for i, raw in enumerate(texts, lo):
                    raw += end
                    for k, cut in enumerate(range(0, len(raw), step)):
                        part = raw[cut:cut + step]
                        at.append(i)
                        piece.append(k)
                        start.append(cut // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
            yield pa.record_batch([ids.take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                                   pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                                  names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(docs: DataFrame, tokenizer: str, kind: str = "whole", end_id: int = 1, capacity: int = CAPACITY, groups: int = GROUPS,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its sequence and place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, tokenizer, kind, end_id, capacity, id_col, text_col), "pieces")
    spread = shuffle_width(spark)
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(spread)).cast("int"))
    per_bucket = cut.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = per_bucket.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n"))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    plan = places(layout(counts, capacity, groups))

    def place(batches):
        top = 1 << 45
        keys = plan["length"] * top + plan["rank"]
        for batch in batches:
            t = {k: batch.column(i).to_numpy(zero_copy_only=False) for i, k in enumerate(batch.schema.names)}
            run = np.searchsorted(keys, t["length"] * top + t["rank"], "right") - 1
            k = t["rank"] - plan["rank"][run]
            each = plan["each"][run]
            sequence = plan["sequence"][run] + k // each
            offset = plan["offset"][run] + k % each * t["length"]
            yield pa.record_batch([*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                                  names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = (cut.withColumn("in_bucket", rank).join(before.drop("n"), ["length", "bucket"])
              .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("in_bucket") + F.col("before")).cast("bigint").alias("rank")))
    return ranked.mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path("word_bpe_49k.json"), kind="word")
