"""Operator 11 - spelling variants by search schemes on a bidirectional FM-index.

Two words are near if they differ by one inserted, deleted or replaced code
point. One of a word's halves is then in both, so two searches find every near
word: match the left half exactly from the word's start and extend right with
one error, or match the right half exactly back from the word's end and extend
left with one error. A pair that both find counts for the first.

1. Words are counted by Spark (pre-aggregated) and written as a table.
2. The index is cut twice: by a word's first code points, for the first search,
   and by its last ones, for the second, each hashed to buckets of about
   ``bucket`` words. A query goes to the one bucket that can hold its matches. A
   bucket that a common beginning or end makes larger is cut into parts, every
   part of words meets every part of queries, and no task holds more.
3. A task builds the FM-index of its delimited words: suffixes are sorted by
   doubling up to the delimiter, equal ones by word, and a symbol and a rank pair
   give the next suffix-rank interval by binary search in the sorted (symbol,
   rank) list of the Burrows-Wheeler transform. For the first search the index
   holds the reversed words, so both searches add symbols at the front: the two
   directions of the index. All queries step together; a symbol can be put in
   or replaced only by those that occur in the interval. An interval of
   "delimiter, word, delimiter" has one rank, the word.
4. A task returns per query the number of near words and the best one; these
   are merged by word. Roots follow the forms by pointer doubling.

Edge cases: null or empty texts have no words; a null id is an empty one in the
deleted-letter rule; repeated rows count each; very long runs are words; ties
between near words go to the least in code-point order; a word without near
words has n_near 0; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloutlab.llm.common import stored, table

LETTERS = "A-Za-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10
EDGE = 3               # code points of a word that choose its bucket; the shorter half of the shortest word
BUCKET = 40_000        # words of one side of a task
LOT = 8192             # queries that step together
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PACK = 9              # symbols of 7 bits in the first sort key

#: byte (Latin-1) -> symbol in code-point order; 0 is the delimiter
SYMBOL = np.zeros(256, np.uint8)
SYMBOL[97:123] = np.arange(1, 27)
SYMBOL[192:256] = np.arange(27, 91)
SYMBOLS = 91


class Index:
    """FM-index of distinct words given as symbols, one array and bounds; words are numbered in symbol order."""

    def __init__(self, flat: np.ndarray, bounds: np.ndarray):
        self.words = n = len(bounds) - 1
        # every word with its closing delimiter
        text = np.insert(flat, bounds[1:], 0)
        bounds = bounds + np.arange(n + 1)
        size = len(text)
        end = np.repeat(bounds[1:] - 1, np.diff(bounds))
        key, place = np.zeros(size, np.int64), np.arange(size)
        for k in range(_PACK):
            key = key << 7 | text[np.minimum(place + k, end)]
        rank = np.unique(key, return_inverse=True)[1]
        step, longest = _PACK, int(np.diff(bounds).max(initial=1))
        while step < longest:                                  # the rank of a delimiter is 0, and ends a suffix
            rank = np.unique(rank * np.int64(size + 1) + rank[np.minimum(place + step, end)], return_inverse=True)[1]
            step *= 2
        # words in symbol order first, so that equal suffixes stand in the order of their words
        starts = bounds[:-1]
        self.order = np.argsort(rank[starts], kind="stable")
        number = np.empty(n, np.int64)
        number[self.order] = np.arange(n)
        suffixes = np.lexsort((np.repeat(number, np.diff(bounds)), rank))
        before = text[np.maximum(suffixes - 1, 0)].astype(np.int64)
        before[np.isin(suffixes, starts, assume_unique=True)] = 0
        self.bwt, self.size = before, size
        self.keys = np.sort(before * np.int64(size + 1) + np.arange(size))
        self.symbols = np.unique(before)

    def step(self, symbol: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """One bound of the interval after putting the symbol in front."""
        return np.searchsorted(self.keys, symbol * np.int64(self.size + 1) + rank)

    def fronts(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, symbol) of every symbol but the delimiter that stands before a suffix of the row's interval."""
        width = hi - lo
        wide = np.flatnonzero(width > 2 * len(self.symbols))
        slim = np.flatnonzero(width <= 2 * len(self.symbols))
        w = width[slim]
        row = np.repeat(slim, w)
        at = np.arange(len(row)) - np.repeat(np.cumsum(w) - w, w) + np.repeat(lo[slim], w)
        some = np.unique(row * 128 + self.bwt[at])
        row = np.concatenate([some >> 7, np.repeat(wide, len(self.symbols))])
        symbol = np.concatenate([some & 127, np.tile(self.symbols, len(wide))])
        keep = symbol > 0
        return row[keep], symbol[keep]

    def near(self, flat: np.ndarray, start: np.ndarray, length: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) pairs: the last ``exact`` symbols of the query match, the ones before with exactly one error."""
        query = np.arange(len(start))
        left = length.copy()                                    # symbols not matched yet
        lo, hi = np.zeros(len(start), np.int64), np.full(len(start), self.words, np.int64)
        for k in range(int(exact.max(initial=0))):
            now = exact[query] > k
            at = query[now]
            symbol = flat[start[at] + left[now] - 1].astype(np.int64)
            lo[now], hi[now] = self.step(symbol, lo[now]), self.step(symbol, hi[now])
            left[now] -= 1
            live = lo < hi
            query, left, lo, hi = query[live], left[live], lo[live], hi[live]
        none = np.empty(0, np.int64)
        erred, found, turn = (none, none, none, none), [], 0
        while len(query) or len(erred[0]):
            # states with their error behind them: whole ones are looked up, the others go on
            q, l, a, b = erred
            whole = l == 0
            zero = np.zeros(int(whole.sum()), np.int64)
            first, last = self.step(zero, a[whole]), self.step(zero, b[whole])
            found.append(q[whole][first < last] * np.int64(self.words) + first[first < last])
            q, l, a, b = q[~whole], l[~whole], a[~whole], b[~whole]
            symbol = flat[start[q] + l - 1].astype(np.int64)
            a, b = self.step(symbol, a), self.step(symbol, b)
            live = a < b
            grown = [(q[live], l[live] - 1, a[live], b[live])]
            if len(query):
                some = left > 0
                own = np.where(some, flat[start[query] + np.maximum(left - 1, 0)], 0).astype(np.int64)
                grown.append((query[some], left[some] - 1, lo[some], hi[some]))              # the word lacks the symbol
                row, symbol = self.fronts(lo, hi)
                a, b = self.step(symbol, lo[row]), self.step(symbol, hi[row])
                live = a < b
                row, symbol, a, b = row[live], symbol[live], a[live], b[live]
                grown.append((query[row], left[row], a, b))                                   # the word has one more
                other = (left[row] > 0) & (symbol != own[row])
                grown.append((query[row][other], left[row][other] - 1, a[other], b[other]))   # the word has another
                query, left, own, lo, hi = query[some], left[some] - 1, own[some], lo[some], hi[some]
                lo, hi = self.step(own, lo), self.step(own, hi)
                live = lo < hi
                query, left, lo, hi = query[live], left[live], lo[live], hi[live]
            erred = tuple(np.concatenate(x) for x in zip(*grown))
            turn += 1
            if turn % 32 == 0 and len(erred[0]):                # in long repetitive words ways meet
                erred = tuple(np.unique(np.stack(erred), axis=1))
        pairs = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        return pairs // self.words, self.order[pairs % self.words]


def symbols_of(words: list[str], backward: bool) -> tuple[np.ndarray, np.ndarray]:
    raw = [w.encode("latin-1") for w in words]
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    return SYMBOL[np.frombuffer(b"".join(r[::-1] for r in raw) if backward else b"".join(raw), np.uint8)], bounds


def near_words(words: list[str], queries: list[str], side: int, lot: int = LOT) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) places of the near pairs of one search; side 0 matches the left half exactly, side 1 the right one
    and leaves out words that also begin with the query's left half."""
    index = Index(*symbols_of(words, side == 0))
    flat, bounds = symbols_of(queries, side == 0)
    length = np.diff(bounds)
    half = length // 2
    out_q, out_w = [], []
    for at in range(0, len(queries), lot):
        cut = slice(at, at + lot)
        q, w = index.near(flat, bounds[:-1][cut], length[cut], (half if side == 0 else length - half)[cut])
        q = q + at
        if side:
            first = np.array([not words[b].startswith(queries[a][:h]) for a, b, h in zip(q.tolist(), w.tolist(), half[q].tolist())], bool)
            q, w = q[first], w[first]
        out_q.append(q)
        out_w.append(w)
    return np.concatenate(out_q) if out_q else np.empty(0, np.int64), np.concatenate(out_w) if out_w else np.empty(0, np.int64)


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, drop_every: int = 31, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """word, n: runs of letters, A-Z in lower case, of at least ``min_length`` code points and ``min_count`` occurrences.

    With ``drop_every`` a run loses the code point h % length if that number divides h, the crc32 of ``<id>:<run>``."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                       F.explode(F.expr(f"regexp_extract_all(`{text_col}`, '[{LETTERS}]{{{min_length},}}', 0)")).alias("run"))
    word = runs.select("id", F.translate("run", UPPER, LOWER).alias("word"))
    if drop_every:
        word = (word.withColumn("h", F.expr("crc32(concat(id, ':', word))")).withColumn("p", F.expr("cast(h % length(word) AS int)"))
                .select(F.expr(f"IF(h % {drop_every} = 0, concat(left(word, p), substring(word, p + 2)), word)").alias("word"))
                .where(f"length(word) >= {min_length}"))
    return word.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(f"n >= {min_count}")


def nearest_forms(words: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """word, n_near, near_n, near: for every word (word, n) that has near words their number and the best one."""
    total = max(1, -(-words.count() // bucket))
    sides = words.select("word", "n", F.posexplode(F.array(F.left("word", F.lit(EDGE)), F.right("word", F.lit(EDGE)))).alias("side", "edge"))
    dealt = sides.select("word", "n", "side", F.pmod(F.xxhash64("side", "edge"), F.lit(total)).cast("int").alias("bucket"))
    sizes = dealt.groupBy("side", "bucket").agg(F.ceil(F.count(F.lit(1)) / (2 * bucket)).cast("int").alias("parts"))
    cut = dealt.join(sizes, ["side", "bucket"]).withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "word"), "parts").cast("int"))
    # part p of the words meets every part of the queries, and the other way round; where p meets p a row is both
    meet = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("word", "n", "side", "bucket", F.explode(F.expr(
        "IF(part = other, array(struct(part AS i, part AS j, 3 AS what)), array(struct(part AS i, other AS j, 1 AS what), struct(other AS i, part AS j, 2 AS what)))"
    )).alias("at")).select("word", "n", "side", "bucket", "at.*")

    def run(t: pa.Table) -> pa.Table:
        what = t["what"].to_numpy()
        order = np.argsort(np.array(t["word"].to_pylist(), object), kind="stable")       # code-point order decides ties
        table_ = t.take(pa.array(order))
        what = what[order]
        words = table_.filter(pa.array((what & 1) > 0))
        queries = table_.filter(pa.array((what & 2) > 0))
        names, asked = words["word"].to_pylist(), queries["word"].to_pylist()
        q, w = near_words(names, asked, t["side"][0].as_py())
        n = words["n"].to_numpy()[w]
        best = np.lexsort((w, -n, q))
        at, first, count = np.unique(q[best], return_index=True, return_counts=True)
        top = w[best][first]
        return pa.table({"word": queries["word"].take(pa.array(at)), "n_near": pa.array(count.astype(np.int64)),
                         "near_n": pa.array(n[best][first].astype(np.int64)), "near": words["word"].take(pa.array(top))})

    found = (meet.groupBy("side", "bucket", "i", "j").applyInArrow(run, "word string, n_near bigint, near_n bigint, near string"))
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("b"))
            .select("word", "n_near", (-F.col("b.m")).alias("near_n"), F.col("b.near").alias("near")))


def roots(forms: DataFrame, ratio: int) -> DataFrame:
    """word, root: the end of the way along (word, form). A form occurs ``ratio`` times as often, so ways are short."""
    way = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(math.ceil(math.log2(63 / math.log2(ratio) + 1))):
        on = way.select(F.col("word").alias("root"), F.col("root").alias("end"))
        way = stored(way.join(on, "root", "left").select("word", F.coalesce("end", "root").alias("root"), F.col("end").isNotNull().alias("moved")), "spelling-roots")
        if way.where("moved").isEmpty():
            break
        way = way.drop("moved")
    return way.select("word", "root")


def spelling_variants(words: DataFrame, ratio: int = RATIO, bucket: int = BUCKET) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of (word, n), words being distinct runs of letters of at least 7 code points."""
    words = stored(words.select("word", "n"), "vocabulary")
    near = stored(nearest_forms(words, bucket), "near-words")
    joined = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
                                                     F.when(F.col("near_n") >= ratio * F.col("n"), F.struct("near", "near_n")).alias("f"))
    ends = roots(words.join(near, "word").where(f"near_n >= {ratio} * n").select("word", F.col("near").alias("form")), ratio)
    return (joined.join(ends, "word", "left")
            .select("word", F.col("f.near").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", F.col("f.near_n").alias("form_n")))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(vocabulary(table(spark, sf_dir, "documents", "doc_id", "text")))
