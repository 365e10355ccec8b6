"""Token ids in Parquet list columns that support selective reads."""

import codecs
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.llm.bpe import _CUT_BYTES, _ID, MEMORY_BYTES, Words, _spec, byte_letters, id_lists, once_per_worker
from panelspark.llm.common import map_arrow, text_slices

END_ID = 1
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 128 << 10
# Writers of a few ids as bytes.
_PACKERS = [struct.Struct(f"<{n}I").pack for n in range(16)]
_SCHEMA = "doc_id bigint, part int, part_start bigint, n_tokens bigint, ids array<int>"


class LibraryEncoder(Words):
    """Encoder by the BPE model of the ``tokenizers`` library, asked once for each pre-token it remembers.

    The library's normalizer and splitter are asked for pieces with letters beyond U+024F alone; what they do to other
    pieces, which is to lower-case them and to cut them by the file's pattern, is done here.
    """

    def __init__(self, spec: bytes):
        super().__init__(spec, 2 * MEMORY_BYTES)
        self._letters = "".join(byte_letters())
        self._model = self.library(True).model
        self._tokenize = self._model.tokenize
        self.file["model"] = {**self.file["model"], "vocab": {}, "merges": []}  # not needed any more

    def encode_word(self, word: str) -> bytes:
        letters = word if word.isascii() and word.isprintable() else codecs.charmap_decode(word.encode(), "strict", self._letters)[0]
        ids = self._tokenize(letters)
        return _PACKERS[len(ids)](*[t.id for t in ids]) if len(ids) < len(_PACKERS) else np.array([t.id for t in ids], _ID).tobytes()


def _encode_part(batches: Iterator[pa.RecordBatch], spec) -> Iterator[pa.RecordBatch]:
    encoder = once_per_worker(spec, LibraryEncoder)
    part, done, end = TaskContext.get().partitionId(), 0, END_ID.to_bytes(_ID.itemsize, "little")
    for batch in text_slices(batches, limit=_CUT_BYTES):
        parts = [ids + end for ids in encoder.encode_texts(batch.column("text").to_pylist())]
        sizes = np.array([len(p) for p in parts], np.int64) // _ID.itemsize
        starts = done + np.cumsum(sizes) - sizes
        done += int(sizes.sum())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(np.full(len(parts), part, np.int32)),
                pa.array(starts),
                pa.array(sizes),
                id_lists(parts),
            ],
            names=["doc_id", "part", "part_start", "n_tokens", "ids"],
        )


def write_tokens(docs: DataFrame, tokenizer: str, path: str, encoding: str = "dictionary", compression: str = "snappy") -> None:
    """Encode whole texts, append the end id, and write files in ascending order of doc_id.

    Each task writes one range of doc_id as one file, its ids in a list column with
    ``dictionary`` or ``delta`` encoding (packed ids leave a slow ``compression`` little to gain), in row groups of ``ROW_GROUP_BYTES``
    and pages of ``PAGE_BYTES``; the files' page indexes let readers skip pages by doc_id.
    Rows carry the number of their file and where in that file's ids they start.

    NULL and empty texts have the end id alone. A NULL doc_id sorts first; rows of one doc_id are
    ordered by the hash of their text, and equal rows are interchangeable. Only where a doc_id repeats are texts hashed, so
    that its rows may lie in several ranges; else the sample that the ranges come from reads doc_ids alone.
    """
    spec = _spec(docs, tokenizer)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    repeats = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    hashed = rows.withColumn("_h", F.xxhash64("text") if repeats else F.lit(0).cast("bigint"))
    order = ["doc_id", "_h"] if repeats else ["doc_id"]
    ranged = hashed.repartitionByRange(*order).sortWithinPartitions(*order).drop("_h")
    options = {
        "parquet.block.size": ROW_GROUP_BYTES,
        "parquet.page.size": PAGE_BYTES,
        "parquet.enable.dictionary": "true" if encoding == "dictionary" else "false",
        "parquet.writer.version": "PARQUET_1_0" if encoding == "dictionary" else "PARQUET_2_0",
        "compression": compression,
        "maxRecordsPerFile": 0,
    }
    map_arrow(ranged, lambda it: _encode_part(it, spec), _SCHEMA).write.options(**options).parquet(path)


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The rows of a written folder, of doc_id from ``first`` to ``last`` if given: other row groups and pages are skipped."""
    rows = spark.read.schema(_SCHEMA).parquet(path)
    if first is not None:
        rows = rows.filter(F.col("doc_id") >= first)
    return rows if last is None else rows.filter(F.col("doc_id") <= last)


def global_starts(rows: DataFrame, all_rows: DataFrame) -> DataFrame:
    """Replace ``part, part_start`` by ``start``: the number of ids of all documents before.

    One row per file is summed up; the rows themselves are not shuffled.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = all_rows.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    shifts = shifts.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    # One row per written file, and so at most as many as there are shuffle partitions.
    joined = rows.join(F.broadcast(shifts), "part")
    return joined.withColumn("start", F.col("_shift") + F.col("part_start")).drop("part", "part_start", "_shift")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        flat, ends = memoryview(ids.values.to_numpy()).cast("B"), ids.offsets.to_numpy() * _ID.itemsize
        sums = [zlib.crc32(flat[a:b]) for a, b in zip(ends.tolist(), ends[1:].tolist())]
        columns = [batch.column(c) for c in ("doc_id", "part", "part_start", "n_tokens")]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(sums, pa.int64())], names=["doc_id", "part", "part_start", "n_tokens", "ids_crc32"]
        )


def checksums(rows: DataFrame) -> DataFrame:
    """The rows with the CRC-32 of their ids, as little-endian 32-bit integers, in place of the ids."""
    schema = "doc_id bigint, part int, part_start bigint, n_tokens bigint, ids_crc32 bigint"
    return map_arrow(rows.select("doc_id", "part", "part_start", "n_tokens", "ids"), _checksums, schema)
