"""Files of token ids: an adaptive context-mixing range coder over checksummed, independent blocks.

Documents are ordered by doc_id over range partitions; each partition becomes
one or more files through Spark's text sink, so that files commit and survive
lost executors like any other output. A line of a file is a segment: a run of
whole documents of LANES * BLOCK ids or more (fewer if the partition has fewer). In a line
ESC (27) stands for ESC ``1`` and the line feed for ESC ``2``, so that files can
be read in splits by their line feeds, whatever their size. A segment is

- ``TGS3``, the ids before it in its partition (unsigned 64 bits), the numbers of
  its documents and of its blocks, and the crc32 of what follows up to the
  coded blocks (unsigned 32 bits each; all integers are little-endian);
- for all documents a byte that is 1 if it has a doc_id, then the doc_ids as
  signed and the numbers of ids as unsigned 64-bit integers;
- for all blocks the number of ids, the number of coded bytes, and the crc32 of
  the ids as unsigned 32-bit integers (unsigned 32 bits each);
- the coded blocks. The ids of the segment's documents run on over them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.llm import coder
from tidegauge.llm.common import shared_dir, written
from tidegauge.llm.tokens import default_path, encode_column

END = 2
#: Blocks that are coded together, about, and segments of a file at most.
LANES, SEGMENTS = 1536, 64
_HEAD = struct.Struct("<4sQIII")


def _lanes(blocks: int) -> list[tuple[int, int]]:
    """Runs of about LANES blocks, that are coded together; under half as many more."""
    runs = max(1, (2 * blocks + LANES) // (2 * LANES))
    cuts = [blocks * k // runs for k in range(runs + 1)] if blocks else []
    return list(zip(cuts, cuts[1:]))


def segment(first: int, doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    """The bytes of documents with the given numbers of ids; ``first`` ids of the partition stand before them."""
    blocks = [ids[at : at + coder.BLOCK] for at in range(0, len(ids), coder.BLOCK)]
    coded = [c for a, b in _lanes(len(blocks)) for c in coder.encode(blocks[a:b])]
    places = np.array([(len(b), len(c), zlib.crc32(b.astype("<u4").tobytes())) for b, c in zip(blocks, coded)], "<u4")
    index = bytes(i is not None for i in doc_ids) + np.array([i or 0 for i in doc_ids], "<i8").tobytes() + np.array(counts, "<u8").tobytes() + places.tobytes()
    return _HEAD.pack(b"TGS3", first, len(doc_ids), len(blocks), zlib.crc32(index)) + index + b"".join(coded)


def documents(content: bytes) -> tuple[int, list[int | None], np.ndarray, np.ndarray]:
    """The ids before a segment, its documents' ids and numbers of ids, and all their ids, checksums verified."""
    magic, first, n, many, crc = _HEAD.unpack_from(content)
    at = _HEAD.size + 17 * n + 12 * many
    index = content[_HEAD.size : at]
    if magic != b"TGS3" or len(index) != 17 * n + 12 * many or zlib.crc32(index) != crc:
        raise ValueError("the index of a segment is damaged")
    doc_ids = [i if there else None for i, there in zip(np.frombuffer(index, "<i8", n, n).tolist(), index[:n])]
    places = np.frombuffer(index, "<u4", 3 * many, 17 * n).reshape(many, 3).astype(np.int64)
    ends = at + np.cumsum(places[:, 1])
    parts: list[np.ndarray] = []
    for a, b in _lanes(many):
        for k, ids in zip(range(a, b), coder.decode([content[ends[k] - places[k, 1] : ends[k]] for k in range(a, b)], places[a:b, 0].tolist())):
            if zlib.crc32(ids.astype("<u4").tobytes()) != places[k, 2]:
                raise ValueError("a block is damaged")
            parts.append(ids)
    return first, doc_ids, np.frombuffer(index, "<u8", n, 9 * n).astype(np.int64), np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def _line(content: bytes) -> bytes:
    return content.replace(b"\x1b", b"\x1b1").replace(b"\n", b"\x1b2")


def _unline(line: bytes) -> bytes:
    return line.replace(b"\x1b2", b"\n").replace(b"\x1b1", b"\x1b")


def write_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end: int = END) -> None:
    """Write the ids of each text of ``docs`` (doc_id, text), then ``end``, in ascending doc_id order, null first."""
    path = tokenizer or default_path()

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, list[int | None], list[int]]] = []
        first = size = 0

        def packed(runs: list[tuple[np.ndarray, list[int | None], list[int]]]) -> pa.RecordBatch:
            ids, doc_ids, counts = zip(*runs)
            line = _line(segment(first, list(chain.from_iterable(doc_ids)), list(chain.from_iterable(counts)), np.concatenate(ids)))
            return pa.RecordBatch.from_arrays([pa.array([line], pa.binary())], ["line"])

        for batch in batches:
            for at, ids, offsets in encode_column(batch.column(1), path):
                sizes = np.diff(offsets) + 1
                whole = np.full(int(sizes.sum()), end, np.uint32)
                keep = np.ones(len(whole), bool)
                keep[np.cumsum(sizes) - 1] = False
                whole[keep] = ids
                waiting.append((whole, batch.column(0).slice(at, len(sizes)).to_pylist(), sizes.tolist()))
                size += len(whole)
                while size >= 2 * LANES * coder.BLOCK:  # what stays is enough for a segment, so that the last one isn't small
                    ends = np.cumsum([len(w[0]) for w in waiting])
                    n = int(np.searchsorted(ends, LANES * coder.BLOCK)) + 1
                    yield packed(waiting[:n])
                    first, size, waiting = first + int(ends[n - 1]), size - int(ends[n - 1]), waiting[n:]
        if waiting:
            yield packed(waiting)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    coded = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").mapInArrow(lines, "line binary")
    coded.select(F.col("line").cast("string").alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", SEGMENTS).text(folder)


_READ = "part long, doc_id long, local long, n_tokens long, ids_crc32 long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, line in zip(batch.column(0).to_pylist(), batch.column(1)):
            first, doc_ids, counts, ids = documents(_unline(line.as_py()))
            ends, raw = np.cumsum(counts), ids.astype("<u4").tobytes()
            sums = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(counts), pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(first + ends - counts), pa.array(counts), pa.array(sums, pa.int64())],
                ["part", "doc_id", "local", "n_tokens", "ids_crc32"],
            )


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files of ``folder``, which are read in splits."""
    lines = spark.read.option("lineSep", "\n").text(folder)
    numbered = lines.select(F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long").alias("part"), F.col("value").cast("binary").alias("line"))
    rows = written(numbered.where(F.octet_length("line") > 0).mapInArrow(_read, _READ))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition that was written
    bases = rows.groupBy("part").agg(F.sum("n_tokens").alias("ids")).select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    return rows.join(bases, "part").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str | None = None, end: int = END) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each row of ``docs``, from files that were written and read back.

    Null and empty texts have the end id only. Rows that repeat a doc_id follow
    one another in the order of their texts' hashes; rows without doc_id come
    first. An empty table writes no ids and gives no rows; other columns are ignored.
    """
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    write_files(docs, folder, tokenizer, end)
    return read_files(spark, folder)
