"""Operator 10 - benchmark decontamination by CGK embedding and bit-sampling LSH.

A document is contaminated by an item if some window of its words is within
``floor(rate * item words)`` edits (insert, delete, replace a word) of the item.

1. Item-sized windows: an item within k edits of a window shares one of its k+1
   equal segments with it word for word, so only windows that hold a segment at
   its place, give or take k words, are looked at. This loses nothing.
2. CGK embedding: a random walk reads a window; at step j it outputs the current
   word and moves on or stays by a random bit of (j, word). Few edits become few
   differing output positions.
3. Sampling: the words at ``sample`` random output positions are a key (of the first
   2 n steps, as later ones lie behind the end; the end itself never counts). Unrelated
   windows rarely share one word at one place, so few of them have a common key.
   A window is a candidate if it agrees with the item in one of the
   repetitions. Their number follows from the agreement measured on random
   edits of all items, and the item length that needs most decides: its windows
   with all k edits allowed are found with probability ``recall`` on average; the
   windows shifted by up to k words are further chances.
4. Candidates are verified by exact word edit distance.

Items are the query set, sent to the tasks in blocks of bounded size; every
document is read whole.

Edge cases: null or empty texts and items match nothing; an item shorter than
1 / rate words must stand verbatim; repeated items or documents are reported
each; two passages of one item in a document are one row (the closest, then
the first, with their number); empty tables give an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloutlab.llm.common import id_text, table
from rolloutlab.llm.vectext import LOWER, chunks, mix, ngram_hashes, span_hashes, text_bytes, word_spans

RATE = 0.2
RECALL = 0.999
SAMPLE = 2                    # outputs of a walk in a key
SAMPLED = 2                   # steps, in item lengths, that keys are drawn from
WALKS = 16                    # walks by which the agreement of an edited copy is measured
BLOCK_WORDS = 2_000_000       # item words sent to the tasks at a time
SCHEMA = "doc_id bigint, item_id bigint, distance int, first_word bigint, last_word bigint, n_passages int"
_END = np.uint64(0x5BD1E995)

WORD_BYTE = np.ones(256, bool)
for lo, hi in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    WORD_BYTE[lo:hi + 1] = False


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = LOWER[data]
    starts, ends, rows = word_spans(low, offsets, WORD_BYTE)
    return span_hashes(low, starts, ends), rows


def walk(windows: np.ndarray, seeds: np.ndarray, steps: int):
    """CGK walks over windows (w, n), one per seed: the words put out at each step, as (seeds, w)."""
    w, n = windows.shape
    flat = np.concatenate([windows, np.full((w, 1), _END, np.uint64)], axis=1).ravel()
    begin, at = np.arange(w) * (n + 1), np.zeros((len(seeds), w), np.int64)
    for j in range(steps):
        word = flat[begin + np.minimum(at, n)]
        yield word
        at += (mix(word ^ mix(seeds + np.uint64(j))[:, None]) & np.uint64(1)).astype(np.int64)


def embed(windows: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The whole walks: outputs (seeds, w, 3n)."""
    return np.stack(list(walk(windows, seeds, 3 * windows.shape[1])), axis=2)


def edited(words: np.ndarray, edits: int, rng) -> np.ndarray:
    """The item with random edits, cut or filled to its own length."""
    x = list(words)
    for _ in range(edits):
        kind, at = rng.integers(3), int(rng.integers(len(x)))
        new = np.uint64(rng.integers(1, 2**62))
        if kind == 0:
            x[at] = new
        elif kind == 1:
            x.insert(at, new)
        elif len(x) > 1:
            x.pop(at)
    n = len(words)
    x = x[:n] + [np.uint64(rng.integers(1, 2**62)) for _ in range(n - len(x))]
    return np.array(x, np.uint64)


def agreement(items: list[np.ndarray], edits: int, trials: int, rng) -> np.ndarray:
    """For items of one length, the share of outputs in which randomly edited copies agree with them, one per copy."""
    seeds, out, n = rng.integers(1, 2**62, WALKS).astype(np.uint64), [], len(items[0])
    for lo in range(0, len(items), 64):
        many = np.stack([w for item in items[lo:lo + 64] for w in (item, *(edited(item, edits, rng) for _ in range(trials)))])
        same = np.zeros((len(many) // (trials + 1), trials), np.int64)
        for word in walk(many, seeds, SAMPLED * n):
            lots = word.reshape(len(seeds), -1, trials + 1)
            same += ((lots[:, :, 1:] == lots[:, :, :1]) & (lots[:, :, :1] != _END)).sum(axis=0)
        out.append((same / (len(seeds) * SAMPLED * n)).ravel())
    return np.concatenate(out)


def repetitions(items: list[np.ndarray], rate: float, sample: int, recall: float, trials: int = 10) -> int:
    """Repetitions of ``sample`` bits after which a window with all allowed edits is missed with probability 1 - recall,
    for the item length for which that takes most. All items count; a recall that cannot be reached is an error."""
    rng = np.random.default_rng(11)
    by_length: dict[int, list[np.ndarray]] = {}
    for words in items:
        by_length.setdefault(len(words), []).append(words)
    reps = 1
    for n, same in sorted(by_length.items()):
        if (k := int(rate * n)) == 0:
            continue
        hit = agreement(same, k, max(trials, -(-400 // len(same))), rng) ** sample       # chance of one repetition, per edited window
        while ((1 - hit) ** reps).mean() > 1 - recall:
            reps *= 2
            if reps > 1 << 20:
                raise ValueError(f"recall {recall} is out of reach for items of {n} words with {sample} bits a key")
    return reps


def item_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edits between the item and any run of the text: (distance, first, one past the last word)."""
    n = len(text)
    cost = np.zeros(n + 1, np.int64)
    begin = np.arange(n + 1)
    step = np.arange(n + 1)
    for word in item:
        take = cost[:-1] + (text != word)
        drop = cost[1:] + 1
        best = np.concatenate([[cost[0] + 1], np.minimum(take, drop)])
        came = np.concatenate([[begin[0]], np.where(take <= drop, begin[:-1], begin[1:])])
        # inserting text words: the cheapest cell to the left plus the way from it
        lowered = best - step
        low = np.minimum.accumulate(lowered)
        first = np.maximum.accumulate(np.where(lowered == low, step, -1))
        cost, begin = low + step, came[first]
    end = int(cost.argmin())
    return int(cost[end]), int(begin[end]), end


class Screen:
    """One block of items with its segments and bit samples."""

    def __init__(self, ids: list[int], items: list[np.ndarray], rate: float, sample: int, reps: int):
        self.ids, self.items, self.sample, self.reps = ids, items, sample, reps
        self.edits = [int(rate * len(w)) for w in items]
        by_size: dict[int, list[tuple[int, int, np.uint64]]] = {}
        for i, (words, k) in enumerate(zip(items, self.edits)):
            size = len(words) // (k + 1)
            grams = ngram_hashes(words, size)
            for s in range(k + 1):
                by_size.setdefault(size, []).append((i, s * size, grams[s * size]))
        self.segments = {}
        for size, rows in by_size.items():
            h = np.array([r[2] for r in rows], np.uint64)
            order = np.argsort(h, kind="stable")
            self.segments[size] = (h[order], np.array([r[0] for r in rows])[order], np.array([r[1] for r in rows])[order])
        self.seeds = mix(np.arange(1, reps + 1, dtype=np.uint64))

    def windows(self, words: np.ndarray) -> dict[int, set[int]]:
        """Per item, the starts (before shifting) of windows that hold one of its segments."""
        out: dict[int, set[int]] = {}
        for size, (h, item, at) in self.segments.items():
            grams = ngram_hashes(words, size)
            left = np.searchsorted(h, grams, "left")
            hit = np.flatnonzero((left < len(h)) & (h[np.minimum(left, len(h) - 1)] == grams))
            for p in hit.tolist():
                k = int(left[p])
                while k < len(h) and h[k] == grams[p]:
                    out.setdefault(int(item[k]), set()).add(p - int(at[k]))
                    k += 1
        return out

    def agrees(self, item: np.ndarray, windows: np.ndarray) -> bool:
        """Whether a window shares the item's sampled outputs in some repetition (repetitions in growing lots)."""
        steps, lot, done = SAMPLED * len(item), 4, 0
        both = np.concatenate([item[None, :], windows])
        while done < self.reps:
            seeds = self.seeds[done:done + lot]
            at = mix(seeds[:, None] + np.arange(1, self.sample + 1, dtype=np.uint64)) % np.uint64(steps)
            shared = np.ones((len(seeds), len(windows)), bool)
            for j, word in enumerate(walk(both, seeds, steps)):
                if (now := (at == j).any(axis=1)).any():
                    first = word[now, :1]
                    shared[now] &= (word[now, 1:] == first) & (first != _END)
            if shared.any():
                return True
            done += len(seeds)
            lot *= 2
        return False

    def scan(self, words: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(item, distance, first word, last word, passages) of every item found in one document."""
        found = []
        for i, starts in self.windows(words).items():
            item, k = self.items[i], self.edits[i]
            n, best, passages = len(item), None, 0
            runs: list[list[int]] = []
            for s in sorted(starts):                       # starts of one passage lie within 2k words
                if runs and s - runs[-1][1] <= 2 * k:
                    runs[-1][1] = s
                else:
                    runs.append([s, s])
            for lo, hi in runs:
                a, b = lo - k, hi + k + 1
                rows = np.arange(a, b)[:, None] + np.arange(n)
                inside = (rows >= 0) & (rows < len(words))
                windows = np.where(inside, words[np.clip(rows, 0, len(words) - 1)], _END)
                if not self.agrees(item, windows):
                    continue
                lo_word, hi_word = max(0, a), min(len(words), b + n + k)
                d, first, end = item_distance(item, words[lo_word:hi_word])
                if d <= k:
                    passages += 1
                    if best is None or d < best[0]:
                        best = (d, lo_word + first, lo_word + end - 1)
            if best:
                found.append((i, *best, passages))
        return found

    def batch(self, column: pa.Array):
        """(row, found) of every text of a column in which an item was found."""
        data, offsets = text_bytes(column)
        for lo, hi in chunks(offsets):
            h, rows = word_hashes(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
            bounds = np.searchsorted(rows, np.arange(hi - lo + 1))
            near = np.zeros(hi - lo, bool)               # only texts that hold some segment are scanned one by one
            for size, (seg, _, _) in self.segments.items():
                grams = ngram_hashes(h, size)
                left = np.minimum(np.searchsorted(seg, grams), len(seg) - 1)
                near[rows[np.flatnonzero(seg[left] == grams)]] = True
            for r in np.flatnonzero(near).tolist():
                if found := self.scan(h[bounds[r]:bounds[r + 1]]):
                    yield lo + r, found


def item_blocks(items: DataFrame, block_words: int):
    """The items as (ids, words) blocks; an item longer than a block stands alone."""
    ids, words, size = [], [], 0
    for r in items.toLocalIterator():
        data = np.frombuffer((r["text"] or "").encode(), np.uint8)
        h, _ = word_hashes(data, np.array([0, len(data)], np.int64))
        if not len(h):
            continue
        if size and size + len(h) > block_words:
            yield ids, words
            ids, words, size = [], [], 0
        ids.append(r["doc_id"])
        words.append(h)
        size += len(h)
    if ids:
        yield ids, words


def contamination(docs: DataFrame, items: DataFrame, rate: float = RATE, recall: float = RECALL, sample: int = SAMPLE,
                  block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text") -> DataFrame:
    """One row per document and item that it holds a passage of: doc_id, item_id, distance, first_word, last_word, n_passages."""
    texts = id_text(docs, id_col, text_col)
    out = None
    for ids, words in item_blocks(id_text(items, item_col, item_text_col), block_words):
        screen = Screen(ids, words, rate, sample, repetitions(words, rate, sample, recall))

        def run(batches, screen=screen):
            for batch in batches:
                keys = batch.column(0).to_pylist()
                found = [(keys[row], screen.ids[i], *rest) for row, hits in screen.batch(batch.column(1)) for i, *rest in hits]
                if found:
                    yield pa.record_batch([pa.array([f[c] for f in found], t) for c, t in enumerate(_TYPES)],
                                          names=["doc_id", "item_id", "distance", "first_word", "last_word", "n_passages"])

        part = texts.mapInArrow(run, SCHEMA)
        out = part if out is None else out.unionAll(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def uncontaminated(docs: DataFrame, items: DataFrame, rate: float = RATE, recall: float = RECALL, sample: int = SAMPLE,
                   block_words: int = BLOCK_WORDS, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that hold a passage of no item."""
    at = docs.columns.index(text_col)
    for ids, words in item_blocks(id_text(items, item_col, item_text_col), block_words):
        screen = Screen(ids, words, rate, sample, repetitions(words, rate, sample, recall))

        def run(batches, screen=screen):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[row for row, _ in screen.batch(batch.column(at))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


_TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32())


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark"))
