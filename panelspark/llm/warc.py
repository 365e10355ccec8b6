"""WARC archives of pages, written and read as rows of bounded size.

A payload longer than a chunk is a run of rows, one per chunk, named by record and
chunk number; in the archive they are the segments of one record. Spark's text source
and sink move the bytes, so archives lie wherever Spark can read and write, large
files are split among tasks, and no task holds more of a payload than a chunk beside its input row.
"""

import hashlib
import urllib.parse
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.common import Scratch, map_arrow, small_side

VERSION = b"WARC/1.1\r\n"
_MARK = VERSION.rstrip()
CHUNK_BYTES = 64 << 10
# Equal payloads of at least this many bytes are stored once.
REVISIT_BYTES = 1000
DATE = "1970-01-01T00:00:00Z"
_BATCH_BYTES = 4 << 20
_RECORD = (
    "record string, page_id bigint, record_type string, chunk int, n_chunks int, payload_bytes bigint, "
    "payload_digest string, refers_to bigint, url string, data binary"
)


def payload_facts(pages: DataFrame) -> DataFrame:
    """Pages with their payload, its length and its SHA-1."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url") if "url" in pages.columns else F.lit(None).cast("string").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("bigint").alias("payload_bytes"),
        F.sha1(payload).alias("payload_digest"),
    )


def revisits(facts: DataFrame) -> DataFrame:
    """``payload_digest, payload_bytes, response`` of payloads that several pages share."""
    long = facts.filter(F.col("payload_bytes") >= REVISIT_BYTES)
    groups = long.groupBy("payload_digest", "payload_bytes").agg(
        F.max("page_id").alias("response"), F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"), F.count("page_id").alias("named")
    )
    shared = groups.filter("response is not null and (first < response or named < n)")
    return shared.select("payload_digest", "payload_bytes", "response")


def chunk_ends(payload: memoryview, size: int) -> list[int]:
    """Where the chunks of a payload end: every ``size`` bytes, and within whatever looks like a record's first line.

    A line end follows every chunk in the archive, so that line's text alone must not end one either.
    """
    ends, start, seen = [], 0, 0
    data = payload.obj
    while start < len(payload):
        end = min(start + size, len(payload))
        seen = max(seen, start)
        at = data.find(VERSION, seen, min(end + len(VERSION) - 1, len(payload)))
        if at >= 0 and at + 4 <= end:
            end, seen = at + 4, at + 4
        elif data.endswith(_MARK, start, end):
            end -= 4
        ends.append(end)
        start = end
    return ends or [0]


def _records(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    """One row per record or segment: its header and its block, without the line end that the sink adds."""
    task, count, out, size = TaskContext.get().partitionId(), 0, [], 0
    for batch in batches:
        columns = [batch.column(c) for c in ("page_id", "url", "payload", "payload_bytes", "payload_digest", "response")]
        for i in range(batch.num_rows):
            page, url, payload, length, digest, response = (c[i].as_py() for c in columns)
            revisit = response is not None and response != page
            view = memoryview(b"" if revisit else payload)
            ends = chunk_ends(view, chunk_bytes)
            record = f"{task:08x}{count:012x}"
            count += 1
            start = 0
            for number, end in enumerate(ends):
                kind = "revisit" if revisit else "response" if number == 0 else "continuation"
                head = [
                    f"WARC-Type: {kind}",
                    f"WARC-Record-ID: <urn:record:{record}:{number}>",
                    f"WARC-Date: {DATE}",
                    "Content-Type: text/html",
                    f"Content-Length: {end - start}",
                    f"WARC-Payload-Digest: sha1:{digest}",
                    f"Payload-Length: {length}",
                ]
                if page is not None:
                    head.append(f"Page-ID: {page}")
                if url is not None:
                    quoted = urllib.parse.quote(url, safe=":/?#[]@!$&'()*+,;=~")
                    head.append("WARC-Target-URI: " + quoted.replace("WARC/1.1", "WARC%2F1.1"))
                if revisit:
                    head.append(f"Refers-To-Page: {response}")
                    head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
                if len(ends) > 1:
                    head.append(f"WARC-Segment-Number: {number + 1}")
                    head.append(f"WARC-Segment-Origin-ID: <urn:record:{record}:0>")
                    head.append(f"Segment-Count: {len(ends)}")
                row = b"".join([VERSION, "\r\n".join(head).encode(), b"\r\n\r\n", view[start:end], b"\r\n"])
                start = end
                out.append(row)
                size += len(row)
                if size >= _BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


def write_warc(pages: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Write one record per row of ``page_id, url, html`` into archives under ``path``.

    The payload is the html in UTF-8 (NULL: empty). Of records with equal payloads of at least
    1000 bytes, that with the largest page_id is a response and the others revisit it. Rows
    that repeat the largest page_id are responses too; a row without a page_id revisits one that has it.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    facts = payload_facts(pages)
    shared = scratch.table(revisits(facts), "shared")
    rows = facts.join(small_side(shared), ["payload_digest", "payload_bytes"], "left")
    lines = map_arrow(rows, lambda it: _records(it, chunk_bytes), "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", "\r\n").text(path)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [
            ("record", pa.string()),
            ("page_id", pa.int64()),
            ("record_type", pa.string()),
            ("chunk", pa.int32()),
            ("n_chunks", pa.int32()),
            ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()),
            ("refers_to", pa.int64()),
            ("url", pa.string()),
            ("data", pa.binary()),
        ]
    )

    def number(text: str | None) -> int | None:
        return None if text is None else int(text)

    for batch in batches:
        out, size = [], 0
        for value in batch.column("value"):
            value = value.as_py()
            if not value:  # before the first record of a file
                continue
            head, _, block = value.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n"))
            length = int(fields["Content-Length"])
            if len(block) < length or block[length:].strip(b"\r\n"):
                raise ValueError(f"a record of {length} bytes has a block of {len(block)}")
            name = fields["WARC-Record-ID"].strip("<>").split(":")
            url = fields.get("WARC-Target-URI")
            out.append(
                (
                    name[2],
                    number(fields.get("Page-ID")),
                    "response" if fields["WARC-Type"] == "continuation" else fields["WARC-Type"],
                    int(name[3]),
                    int(fields.get("Segment-Count", 1)),
                    int(fields["Payload-Length"]),
                    fields["WARC-Payload-Digest"].removeprefix("sha1:"),
                    number(fields.get("Refers-To-Page")),
                    None if url is None else urllib.parse.unquote(url),
                    block[:length],
                )
            )
            size += length
            if size >= _BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The chunk rows of the archives under ``path``: one per record, or per segment of a long one.

    Columns: ``record, page_id, record_type, chunk, n_chunks, payload_bytes, payload_digest, refers_to, url, data``.
    """
    rows = spark.read.option("lineSep", VERSION.decode()).text(path).select(F.col("value").cast("binary").alias("value"))
    return map_arrow(rows, _parse, _RECORD)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Length and SHA-1 of each record whose chunks follow one another, carried from chunk to chunk."""
    record, sha, length = None, None, 0
    for batch in batches:
        out = []
        for name, data, chunk, last in zip(*(batch.column(c) for c in ("record", "data", "chunk", "n_chunks"))):
            name, chunk, last = name.as_py(), chunk.as_py(), last.as_py()
            if chunk == 0:
                record, sha, length = name, hashlib.sha1(), 0
            elif name != record:
                raise ValueError(f"record {name} has no first chunk")
            block = data.as_buffer()
            sha.update(block)
            length += block.size
            if chunk == last - 1:
                out.append((name, length, sha.hexdigest()))
        names = ["record", "read_bytes", "read_digest"]
        kinds = [pa.string(), pa.int64(), pa.string()]
        columns = zip(*out) if out else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)


def record_digests(chunks: DataFrame) -> DataFrame:
    """``record, read_bytes, read_digest`` of the payloads in a chunk table.

    Records of one chunk are digested where they are; only chunks of longer ones are shuffled,
    sorted by record and number, and digested one after another.
    """
    schema = "record string, read_bytes bigint, read_digest string"
    columns = ["record", "data", "chunk", "n_chunks"]
    short = map_arrow(chunks.filter("n_chunks = 1").select(*columns), _digests, schema)
    long = chunks.filter("n_chunks > 1").select(*columns).repartition("record").sortWithinPartitions("record", "chunk")
    return short.unionByName(map_arrow(long, _digests, schema))


def archive_index(spark: SparkSession, path: str) -> DataFrame:
    """Per record of the archives: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Length and digest of responses come from the bytes read back; a mismatch with the
    header fails the job. Those of revisits are the header's.
    """
    chunks = read_warc(spark, path)
    columns = ["record", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    # A response of one chunk is checked in the row it is read from.
    data = F.col("data")
    whole = chunks.filter("n_chunks = 1").select(
        *columns, F.octet_length(data).cast("bigint").alias("read_bytes"), F.sha1(data).alias("read_digest")
    )
    long = chunks.filter("n_chunks > 1")
    first = long.filter("chunk = 0").select(*columns).join(record_digests(long), "record", "left")
    every = whole.unionByName(first.select(*columns, "read_bytes", "read_digest"))
    same = F.col("read_bytes").eqNullSafe(F.col("payload_bytes")) & F.col("read_digest").eqNullSafe(F.col("payload_digest"))
    checked = F.when((F.col("record_type") == "revisit") | same, F.col("payload_digest")).otherwise(
        F.raise_error(F.concat(F.lit("payload differs from its digest: record "), F.col("record")))
    )
    return every.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")
