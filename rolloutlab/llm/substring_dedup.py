"""Operator 4 - repeated substrings by blockwise suffix buckets over a cover sample.

A byte goes if it lies in a ``length``-byte string (a window) that also starts in
a document with a smaller id. Suffixes are never sorted all at once:

1. Cover sample. Of each window the position with the smallest ``piece``-byte
   hash is sampled. Equal windows sample the same place, which is what a
   difference cover gives for equal strings, with a third of its positions
   (a cover modulo 31, the largest for 50 bytes, holds 6 of 31). Consecutive
   windows with one sampled position are a run; a run's name is the hash of all
   bytes its windows cover, the rank that decides long ties at once.
2. One bucket at a time. (sample, name) entries are dealt to buckets by the
   sample's hash; a bucket is sorted on its own, so memory is that of a bucket.
   A name that stands in a smaller document too settles its whole run: all
   windows repeated. The smallest document's run is looked at window by window
   only if its sample also heads another name.
3. Those windows' hashes are dealt to buckets and sorted the same way.
4. Each block of texts gets its buckets' answers back, one or two bits an entry,
   and marks the bytes.

Texts stay in compressed blocks of whole documents; what goes through shuffles
is entries, bits and, twice, the blocks.

Edge cases: null texts are empty; texts shorter than a window lose nothing; a
null id counts as the smallest; rows with the same id are not smaller than each
other; texts of any length are cut into stretches, which moves no window; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloutlab.llm.common import id_text, shuffle_width, stored, table
from rolloutlab.llm.vectext import LETTER, mix, powers, text_bytes

LENGTH = 50
PIECE = 20
BLOCK_BYTES = 4 << 20
STRETCH = 1 << 20
NONE, REPEATED, OPEN = 0, 1, 2          # what a bucket says of an entry
_NULL_ID = np.iinfo(np.int64).min
_ENTRIES = "bucket int, block bigint, docs binary, counts binary, entries binary"
_ANSWERS = "block bigint, step int, bucket int, bits binary"


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    out = x
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[:len(out) - (width - span)], out[width - span:]) if span < width else out


class Stretch:
    """The runs of windows that start in data[lo:hi]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, length: int, piece: int):
        self.lo, self.length = lo, length
        part = data[lo:hi + length - 1]
        n = len(part)
        up, self.down = powers(n + 1)
        self.total = np.empty(n + 1, np.uint64)
        self.total[0] = 0
        np.cumsum(LETTER[part] * up[:n], out=self.total[1:])
        empty = np.empty(0, np.int64)
        self.start = self.count = self.doc = empty
        self.sample = self.name = np.empty(0, np.uint64)
        if n < length:
            return
        h = mix((self.total[piece:] - self.total[:-piece]) * self.down[:n - piece + 1])
        mask = np.uint64((1 << int(n).bit_length()) - 1)
        least = _sliding_least((h & ~mask) | np.arange(len(h), dtype=np.uint64), length - piece + 1)
        at = (least & mask).astype(np.int64)
        i = np.arange(len(at))
        doc = np.searchsorted(offsets, i + lo, "right") - 1
        whole = i + lo + length <= offsets[doc + 1]
        i, at, doc = i[whole], at[whole], doc[whole]
        if not len(i):
            return
        new = np.ones(len(i), bool)
        new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(i)]]) - 1
        self.start, self.count, self.doc = i[first] + lo, last - first + 1, doc[first]
        self.sample = h[at[first]]
        a, b = i[first], i[last] + length
        self.name = mix((self.total[b] - self.total[a]) * self.down[a] + (b - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, hash, run) of every window of the chosen runs."""
        count = self.count[chosen]
        run = np.repeat(chosen, count)
        at = self.start[run] + np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
        k = at - self.lo
        return at, mix((self.total[k + self.length] - self.total[k]) * self.down[k] ^ np.uint64(0xD1B54A32D192ED03)), run


def stretches(data, offsets, length: int, piece: int):
    for lo in range(0, len(data), STRETCH):
        yield Stretch(data, offsets, lo, min(lo + STRETCH, len(data)), length, piece)


class Dealt:
    """A block's distinct entries, dealt to buckets in a fixed order; answers come back in that order."""

    def __init__(self, keys: list[np.ndarray], doc: np.ndarray, buckets: int):
        bucket = (keys[0] >> np.uint64(40)) % np.uint64(buckets)
        order = np.lexsort((*reversed(keys), doc, bucket))
        new = np.ones(len(order), bool)
        for x in (bucket, doc, *keys):
            s = x[order]
            new[1:] &= s[1:] == s[:-1]
        new[1:] = ~new[1:]
        self.place = np.empty(len(order), np.int64)           # of each given entry among the distinct ones
        self.place[order] = np.cumsum(new) - 1
        pick = order[new]
        self.bucket, self.doc, self.keys = bucket[pick].astype(np.int64), doc[pick], [k[pick] for k in keys]
        self.used, self.begin = np.unique(self.bucket, return_index=True)
        self.end = np.concatenate([self.begin[1:], [len(pick)]]).astype(np.int64)

    def rows(self, block: int, ids: np.ndarray, pack) -> pa.RecordBatch:
        out: list[tuple] = []
        for b, lo, hi in zip(self.used.tolist(), self.begin.tolist(), self.end.tolist()):
            docs, counts = np.unique(self.doc[lo:hi], return_counts=True)
            out.append((b, block, ids[docs].tobytes(), counts.astype(np.uint32).tobytes(), pack(*(k[lo:hi] for k in self.keys))))
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.record_batch([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)],
                               names=["bucket", "block", "docs", "counts", "entries"])

    def answers(self, bits: dict[int, np.ndarray]) -> np.ndarray:
        """The answer of each entry as it was given."""
        every = np.empty(len(self.bucket), np.uint8)
        for b, lo, hi in zip(self.used.tolist(), self.begin.tolist(), self.end.tolist()):
            every[lo:hi] = bits[b][:hi - lo]
        return every[self.place]


def pack_runs(sample: np.ndarray, name: np.ndarray) -> bytes:
    """10 bytes an entry: 4 of the sample (the bucket holds more of it) and 6 of the name."""
    out = np.empty((len(sample), 10), np.uint8)
    out[:, :4] = (sample & np.uint64(0xFFFFFFFF)).astype("<u4").view(np.uint8).reshape(-1, 4)
    out[:, 4:] = np.ascontiguousarray(name).view(np.uint8).reshape(-1, 8)[:, :6]
    return out.tobytes()


def pack_windows(h: np.ndarray) -> bytes:
    return h.astype("<u8").tobytes()


def _gather(t: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, doc id, row) of all entries of a bucket."""
    raw, docs, rows = [], [], []
    for i, (d, c, e) in enumerate(zip(t["docs"].to_pylist(), t["counts"].to_pylist(), t["entries"].to_pylist())):
        x = np.frombuffer(e, np.uint8).reshape(-1, width)
        raw.append(x)
        docs.append(np.repeat(np.frombuffer(d, np.int64), np.frombuffer(c, np.uint32)))
        rows.append(np.full(len(x), i))
    return np.concatenate(raw), np.concatenate(docs), np.concatenate(rows)


def _reply(t: pa.Table, step: int, rows: np.ndarray, state: np.ndarray) -> pa.Table:
    cut = np.searchsorted(rows, np.arange(t.num_rows + 1))
    bits = [_to_bits(state[a:b]) for a, b in zip(cut[:-1], cut[1:])]
    return pa.table({"block": t["block"], "step": pa.array([step] * t.num_rows, pa.int32()), "bucket": t["bucket"],
                     "bits": pa.array(bits, pa.binary())})


def _to_bits(state: np.ndarray) -> bytes:
    return np.packbits(np.stack([state & 1, state >> 1], axis=1).ravel()).tobytes()


def _from_bits(raw: bytes) -> np.ndarray:
    x = np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, 2)
    return x[:, 0] | x[:, 1] << 1


def sort_runs(t: pa.Table) -> pa.Table:
    """One bucket of runs: which stand in a smaller document, which have to be opened."""
    raw, doc, rows = _gather(t, 10)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :6] = raw[:, 4:]
    sample, name = np.ascontiguousarray(raw[:, :4]).view("<u4").ravel(), wide.view("<u8").ravel()
    order = np.lexsort((doc, name, sample))
    s, n, d = sample[order], name[order], doc[order]
    new_s = np.ones(len(order), bool)
    new_s[1:] = s[1:] != s[:-1]
    new_n = new_s.copy()
    new_n[1:] |= n[1:] != n[:-1]
    of_n, of_s = np.cumsum(new_n) - 1, np.cumsum(new_s) - 1
    least = d[new_n][of_n]
    several = np.bincount(of_s, weights=new_n)[of_s] > 1
    state = np.empty(len(order), np.uint8)
    state[order] = np.where(d > least, REPEATED, np.where(several, OPEN, NONE))
    return _reply(t, 1, rows, state)


def sort_windows(t: pa.Table) -> pa.Table:
    """One bucket of windows: which stand in a smaller document."""
    raw, doc, rows = _gather(t, 8)
    h = np.ascontiguousarray(raw).view("<u8").ravel()
    order = np.lexsort((doc, h))
    new = np.ones(len(order), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    d = doc[order]
    state = np.empty(len(order), np.uint8)
    state[order] = np.where(d > d[new][np.cumsum(new) - 1], REPEATED, NONE)
    return _reply(t, 2, rows, state)


def text_blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """(block, ids, sizes, payload): whole documents in compressed blocks."""

    def run(batches):
        import zstandard
        from pyspark import TaskContext
        squeeze = zstandard.ZstdCompressor(level=3)
        task, made = TaskContext.get().partitionId(), 0
        ids: list = []
        texts: list = []
        size = 0

        def flush():
            nonlocal ids, texts, size, made
            row = pa.record_batch([pa.array([(task << 32) + made]), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()),
                                   pa.array([np.array([len(x) for x in texts], np.int64).tobytes()], pa.binary()),
                                   pa.array([squeeze.compress(b"".join(texts))], pa.binary())], names=["block", "ids", "sizes", "payload"])
            made, ids, texts, size = made + 1, [], [], 0
            return row

        for batch in batches:
            keys = batch.column(0).fill_null(_NULL_ID).to_pylist()
            data, offsets = text_bytes(batch.column(1))
            for k, a, b in zip(keys, offsets[:-1].tolist(), offsets[1:].tolist()):
                ids.append(k)
                texts.append(data[a:b].tobytes())
                size += b - a
                if size >= block_bytes:
                    yield flush()
        if ids:
            yield flush()

    return docs.mapInArrow(run, "block bigint, ids binary, sizes binary, payload binary")


def _open_block(ids: bytes, sizes: bytes, payload: bytes):
    import zstandard
    size = np.frombuffer(sizes, np.int64)
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    raw = zstandard.ZstdDecompressor().decompress(payload, max_output_size=int(offsets[-1]) or 1)
    return np.frombuffer(ids, np.int64), np.frombuffer(raw, np.uint8), offsets


def repeated_substrings(docs: DataFrame, length: int = LENGTH, piece: int = PIECE, block_bytes: int = BLOCK_BYTES, buckets: int | None = None,
                        id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed [start, end) byte ranges) of every row."""
    if not 0 < piece <= length:
        raise ValueError("a piece must be from 1 byte to a window's length")
    spark = docs.sparkSession
    n = buckets or shuffle_width(spark)
    blocks = stored(text_blocks(id_text(docs, id_col, text_col), block_bytes), "text-blocks")

    def runs_of(data, offsets):
        """All stretches of a block and its dealt runs."""
        parts = list(stretches(data, offsets, length, piece))
        if not parts:
            return parts, None
        return parts, Dealt([np.concatenate([getattr(p, k) for p in parts]) for k in ("sample", "name")],
                            np.concatenate([p.doc for p in parts]), n)

    def opened(parts, dealt, bits):
        """State of every run, and the windows of the open ones dealt to buckets: (states, starts, dealt windows)."""
        state = dealt.answers(bits) if len(dealt.doc) else np.empty(0, np.uint8)
        at, hashes, doc, base = [], [], [], 0
        for p in parts:
            a, h, run = p.windows(np.flatnonzero(state[base:base + len(p.start)] == OPEN))
            at.append(a)
            hashes.append(h)
            doc.append(p.doc[run])
            base += len(p.start)
        return state, np.concatenate(at), Dealt([np.concatenate(hashes)], np.concatenate(doc), n)

    def deal_runs(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, data, offsets = _open_block(row["ids"], row["sizes"], row["payload"])
                _, dealt = runs_of(data, offsets)
                if dealt is not None and len(dealt.doc):
                    yield dealt.rows(row["block"], ids, pack_runs)

    def answers_of(t: pa.Table, step: int) -> dict[int, np.ndarray]:
        return {b: _from_bits(x) for s, b, x in zip(t["step"].to_pylist(), t["bucket"].to_pylist(), t["bits"].to_pylist()) if s == step}

    def deal_windows(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            ids, data, offsets = _open_block(row["ids"], row["sizes"], row["payload"])
            parts, dealt = runs_of(data, offsets)
            if dealt is not None:
                _, _, windows = opened(parts, dealt, answers_of(right, 1))
                if len(windows.doc):
                    out.append(windows.rows(row["block"], ids, pack_windows))
        return pa.Table.from_batches(out, schema=entry_schema)

    def mark(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for row in left.to_pylist():
            ids, data, offsets = _open_block(row["ids"], row["sizes"], row["payload"])
            parts, dealt = runs_of(data, offsets)
            edge = np.zeros(len(data) + 1, np.int32)
            if dealt is not None:
                state, at, windows = opened(parts, dealt, answers_of(right, 1))
                again = at[windows.answers(answers_of(right, 2)) == REPEATED] if len(at) else at
                np.add.at(edge, again, 1)
                np.add.at(edge, again + length, -1)
                start, count = (np.concatenate([getattr(p, k) for p in parts]) for k in ("start", "count"))
                whole = state == REPEATED
                np.add.at(edge, start[whole], 1)
                np.add.at(edge, start[whole] + count[whole] - 1 + length, -1)
            gone = np.cumsum(edge[:-1]) > 0
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                g = gone[a:b]
                turn = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]]).astype(np.int8)))
                spans = turn.reshape(-1, 2)
                rows.append((None if ids[i] == _NULL_ID else int(ids[i]), b - a, int(g.sum()), len(spans),
                             hashlib.sha256(data[a:b][~g].tobytes()).hexdigest(), [{"start": int(x), "end": int(y)} for x, y in spans]))
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)],
                        names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    ints = pa.int64()
    kinds = (ints, ints, ints, ints, pa.string(), pa.list_(pa.struct([("start", ints), ("end", ints)])))
    entry_schema = pa.schema([("bucket", pa.int32()), ("block", ints), ("docs", pa.binary()), ("counts", pa.binary()), ("entries", pa.binary())])
    runs = blocks.mapInArrow(deal_runs, _ENTRIES)
    first = stored(runs.groupBy("bucket").applyInArrow(sort_runs, _ANSWERS), "run-answers")
    windows = blocks.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(deal_windows, _ENTRIES)
    second = stored(windows.groupBy("bucket").applyInArrow(sort_windows, _ANSWERS), "window-answers")
    return (blocks.groupBy("block").cogroup(first.unionAll(second).groupBy("block"))
            .applyInArrow(mark, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string,"
                                " spans array<struct<start:bigint,end:bigint>>"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_substrings(table(spark, sf_dir, "documents", "doc_id", "text")).drop("spans")
