"""Operator 8 - token ids in bit- or byte-plane files.

Ids of all documents, in ascending doc_id order, are cut into segments of whole
documents and each segment into blocks of a fixed number of ids (its last block
may be shorter). A block is transposed: plane k holds byte (or bit) k of every
id, and each plane is compressed with zstandard on its own. A segment is one
record of a Parquet file: the payload (planes one after the other), the chunk
index (ids, first id, crc32 and plane sizes of each block) and the directory of
its documents. Spark's commit protocol writes the files, so any store works and
a repeated task cannot leave half a segment; one block can be read through the
index without the others.

Edge cases: null or empty texts hold only the end id; a null doc_id sorts
first; repeated ids or rows are written once per input row, ordered by their
ids' bytes; a very long text makes one long segment; an empty table writes no
segments and reads back empty; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolloutlab.llm.common import id_text, scratch, shuffle_width, table
from rolloutlab.llm.tokens import encoded, encoder, tokenizer_path

BLOCK_IDS = 1 << 16
SEGMENT_IDS = 1 << 19
SEGMENT_SCHEMA = ("part int, segment int, n_ids bigint, width int, "
                  "doc_ids array<bigint>, doc_starts array<bigint>, doc_lengths array<bigint>, "
                  "chunk_index array<struct<first_id:bigint,n_ids:int,crc32:bigint,plane_sizes:array<int>>>, payload binary")


def to_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    """The byte or bit planes of a block of ids, lowest first."""
    raw = np.ascontiguousarray(ids).view(np.uint8).reshape(len(ids), ids.dtype.itemsize)
    if planes == "byte":
        return [raw[:, k].tobytes() for k in range(raw.shape[1])]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(bits.shape[1])]


def from_planes(parts: list[bytes], n: int, width: int, planes: str) -> np.ndarray:
    if planes == "byte":
        raw = np.stack([np.frombuffer(p, np.uint8) for p in parts], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in parts], axis=1)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view(f"<u{width}").reshape(n)


def pack_segment(ids: np.ndarray, width: int, planes: str, block_ids: int, level: int = 3) -> tuple[list[dict], bytes]:
    import zstandard
    squeeze = zstandard.ZstdCompressor(level=level)
    index, payload = [], []
    for at in range(0, len(ids), block_ids):
        block = ids[at:at + block_ids].astype(f"<u{width}")
        stored = [squeeze.compress(p) for p in to_planes(block, planes)]
        index.append({"first_id": at, "n_ids": len(block), "crc32": zlib.crc32(block.astype("<u4").tobytes()),
                      "plane_sizes": [len(s) for s in stored]})
        payload += stored
    return index, b"".join(payload)


def read_blocks(index, payload: bytes, width: int, planes: str, wanted=None):
    """Decode the blocks of a segment (or only those numbered in ``wanted``); a damaged block is an error."""
    import zstandard
    loose = zstandard.ZstdDecompressor()
    at = 0
    for k, entry in enumerate(index):
        sizes = entry["plane_sizes"]
        if wanted is None or k in wanted:
            n, cut, parts = entry["n_ids"], at, []
            size = n * 1 if planes == "byte" else (n + 7) // 8
            for s in sizes:
                parts.append(loose.decompress(payload[cut:cut + s], max_output_size=size))
                cut += s
            ids = from_planes(parts, n, width, planes)
            if zlib.crc32(ids.astype("<u4").tobytes()) != entry["crc32"]:
                raise ValueError("a block's ids do not match its crc32")
            yield ids
        at += sum(sizes)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, kind: str = "whole", end_id: int = 0, width: int = 4,
                      planes: str = "byte", block_ids: int = BLOCK_IDS, segment_ids: int = SEGMENT_IDS, partitions: int | None = None,
                      id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text and write the id files under ``path``.

    Texts are tokenized where they are read; only ids are shuffled, to ranges
    of doc_id whose bounds are quantiles of the ids (one aggregate over the id
    column), so no task holds more than its range."""
    spark = docs.sparkSession
    n = partitions or shuffle_width(spark)
    docs = id_text(docs, id_col, text_col)
    marks = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10_000).alias("q")).first()["q"] or []
    bounds = np.unique(np.array(marks, np.int64))
    parts = len(bounds) + 1

    def encode(batches):
        enc = encoder(tokenizer, kind)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids = batch.column(0)
            keys = ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            part = np.searchsorted(bounds, keys, "left").astype(np.int32)
            for lo, texts in encoded(batch.column(1), enc):
                rows = [np.frombuffer(b + end, "<u4") for b in texts]
                if width < 4:
                    if max(int(r.max()) for r in rows) >> (8 * width):
                        raise ValueError(f"an id needs more than {width} bytes")
                    rows = [r.astype(f"<u{width}") for r in rows]
                yield pa.record_batch([pa.array(part[lo:lo + len(rows)]), ids.slice(lo, len(rows)),
                                       pa.array([r.tobytes() for r in rows], pa.binary())],
                                      names=["part", "doc_id", "ids"])

    def write(batches):
        part, segment = None, 0
        held: list[tuple] = []
        size = 0

        def flush():
            nonlocal segment, size, held
            index, payload = pack_segment(np.frombuffer(b"".join(h[1] for h in held), f"<u{width}"), width, planes, block_ids)
            lengths = [len(h[1]) // width for h in held]
            starts = np.cumsum([0, *lengths])[:-1].tolist()
            row = {"part": part, "segment": segment, "n_ids": sum(lengths), "width": width, "doc_ids": [h[0] for h in held],
                   "doc_starts": starts, "doc_lengths": lengths, "chunk_index": index, "payload": payload}
            segment, size, held = segment + 1, 0, []
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for p, doc, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (p != part or size >= segment_ids):
                    yield flush()
                if p != part:
                    part, segment = p, 0
                held.append((doc, ids))
                size += len(ids) // width
        if held:
            yield flush()

    ints = pa.int64()
    schema = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("n_ids", ints), ("width", pa.int32()),
                        ("doc_ids", pa.list_(ints)), ("doc_starts", pa.list_(ints)), ("doc_lengths", pa.list_(ints)),
                        ("chunk_index", pa.list_(pa.struct([("first_id", ints), ("n_ids", pa.int32()), ("crc32", ints),
                                                            ("plane_sizes", pa.list_(pa.int32()))]))),
                        ("payload", pa.binary())])
    (docs.mapInArrow(encode, "part int, doc_id bigint, ids binary")
     .repartitionById(parts, F.col("part")).sortWithinPartitions("part", "doc_id", "ids")
     .mapInArrow(write, SEGMENT_SCHEMA)
     .withColumn("planes", F.lit(planes)).write.option("compression", "none").parquet(path))


def segment_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, segment, before): the ids that stand before each segment; reads no payload."""
    df = spark.read.schema(SEGMENT_SCHEMA).parquet(path).select("part", "segment", "n_ids")
    # one row per range here; segments are numbered inside their range
    ranges = df.groupBy("part").agg(F.sum("n_ids").alias("n"))
    ranges = ranges.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before_part"))
    inside = Window.partitionBy("part").orderBy("segment")
    return (df.withColumn("inside", F.sum("n_ids").over(inside) - F.col("n_ids")).join(ranges, "part")
            .select("part", "segment", (F.col("inside") + F.col("before_part")).alias("before")))


def _read(spark: SparkSession, path: str, name: str, sql_type: str, arrow_type: pa.DataType, per_doc) -> DataFrame:
    """doc_id, start, n_tokens and ``per_doc(ids)`` of every document; only these small rows are joined to the starts."""
    ints = pa.int64()
    fields = [("part", pa.int32()), ("segment", pa.int32()), ("doc_id", ints), ("inside", ints), ("n_tokens", ints), (name, arrow_type)]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.concatenate(list(read_blocks(row["chunk_index"], row["payload"], row["width"], row["planes"])))
                out = [(row["part"], row["segment"], d, s, n, per_doc(ids[s:s + n])) for d, s, n in
                       zip(row["doc_ids"], row["doc_starts"], row["doc_lengths"])]
                yield pa.record_batch([pa.array([o[i] for o in out], t) for i, (_, t) in enumerate(fields)], names=[f for f, _ in fields])

    df = spark.read.schema(SEGMENT_SCHEMA + ", planes string").parquet(path)
    rows = df.mapInArrow(run, f"part int, segment int, doc_id bigint, inside bigint, n_tokens bigint, {name} {sql_type}")
    return (rows.join(segment_starts(spark, path), ["part", "segment"])
            .select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", name))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, read back from the files."""
    return _read(spark, path, "ids", "array<bigint>", pa.list_(pa.int64()), lambda x: x.astype(np.int64))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files."""
    return _read(spark, path, "ids_crc32", "bigint", pa.int64(), lambda x: zlib.crc32(x.astype("<u4").tobytes()))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents", "doc_id", "text"), path, tokenizer_path("byte_bpe_50k.json"),
                      kind="byte_level", end_id=0, width=2)
    return read_digests(spark, path)
