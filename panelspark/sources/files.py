"""Files as Spark lists them: one spelling of their paths, their first records, and what is wrong with them."""

import re
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Files that sheets are read from; compressed ones cannot be split.
SHEETS = "*.{csv,txt,csv.gz,txt.gz}"
_COMPRESSED = (".gz", ".bz2", ".zst")
_CHUNK = 1 << 16
# Of a record that never ends no more than this is looked at.
_LONGEST_HEAD = 1 << 24
_NO_ACCESS = "not opened: "


def file_path(encoded: Column | str = "_metadata.file_path") -> Column:
    """A scanned row's file under the name that it has in its store; the metadata has it percent-encoded."""
    column = F.col(encoded) if isinstance(encoded, str) else encoded
    return F.url_decode(F.replace(column, F.lit("+"), F.lit("%2B")))


def as_path(path: str) -> str:
    """A file's name as a path for a reader, which would take some characters for a pattern."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
# Tasks of each core that list folders.
_LISTING_TASKS = 4


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Folders read within are listed by a few tasks of each core; by default each has a task, which sends the driver more about itself than about files."""
    before = spark.conf.get(_LISTING, None)
    most = _LISTING_TASKS * spark.sparkContext.defaultParallelism
    spark.conf.set(_LISTING, str(most if before is None else min(most, int(before))))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_LISTING)
        else:
            spark.conf.set(_LISTING, before)


def listing(spark: SparkSession, paths: str | Sequence[str], pattern: str | None = None, recursive: bool = False) -> DataFrame:
    """``path, uri, length`` of the files that a reader of the same paths scans. No contents are read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    with few_listing_tasks(spark):
        found = reader.load(paths if isinstance(paths, str) else list(paths))
    return found.select(file_path().alias("path"), F.col("_metadata.file_path").alias("uri"), "length").distinct()


def list_files(spark: SparkSession, root: str, pattern: str = SHEETS) -> DataFrame:
    """Distinct ``path, length`` of the files under ``root``, at any depth. Only the listing is read, not the contents."""
    return listing(spark, root, pattern, recursive=True).select("path", "length")


def first_file(spark: SparkSession, root: str, pattern: str = "*.csv") -> str | None:
    """The first matching file directly in a directory, by name, as a path for a reader."""
    first = listing(spark, root, pattern).agg(F.min("path")).first()[0]
    return first and as_path(first)


def _opened(uri: str) -> pa.NativeFile:
    """A file's bytes, decompressed as its name says."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_stream(path, compression="detect")


def _opening_errors() -> tuple[type[BaseException], ...]:
    return (pa.ArrowInvalid, pa.ArrowNotImplementedError, ImportError)


def _head(uri: str) -> tuple[str | None, str | None]:
    """The first record of a delimited file and what went wrong; line breaks within quotes do not end it."""
    try:
        source = _opened(uri)
    except _opening_errors() as error:
        return None, f"{_NO_ACCESS}{error}"
    except OSError as error:
        return None, str(error)
    try:
        with source:
            data = b""
            while True:
                more = source.read(_CHUNK)
                data += more
                end = _record_end(data)
                if end is None and more and len(data) < _LONGEST_HEAD:
                    continue
                head = data if end is None else data[:end]
                return head.decode("utf-8-sig", "replace").rstrip("\r"), None
    except OSError as error:
        return None, str(error)


_RECORD = re.compile(rb'(?:[^"\n]|"[^"]*")*\n')


def _record_end(data: bytes) -> int | None:
    found = _RECORD.match(data)
    return found.end() - 1 if found else None


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_head(uri) for uri in batch.column("uri").to_pylist()]
        columns = [batch.column("path"), pa.array([h for h, _ in found], pa.string()), pa.array([f for _, f in found], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["path", "head", "fault"])


def file_heads(files: DataFrame) -> DataFrame:
    """``path, head, fault`` of listed files: the first record, of which a few blocks of bytes are read whatever the file's size.

    ``fault`` says why a file's head is missing. A store that only Spark's readers open gives :func:`not_opened` faults.
    """
    return files.select("path", "uri").mapInArrow(_heads, "path string, head string, fault string")


def not_opened(fault: Column) -> Column:
    """Whether a fault is that of a store, not of a file."""
    return F.coalesce(fault.startswith(_NO_ACCESS), F.lit(False))


def _fault(uri: str) -> str | None:
    """Why a file cannot be read to its end, if so: compressed files are decompressed whole, others opened."""
    try:
        with _opened(uri) as source:
            while source.read(1 << 20) and uri.endswith(_COMPRESSED):
                pass
    except _opening_errors() as error:
        return f"{_NO_ACCESS}{error}"
    except (OSError, EOFError) as error:
        return str(error)
    return None


def _faults(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_fault(uri) for uri in batch.column("uri").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(found, pa.string())], names=["path", "fault"])


def file_faults(spark: SparkSession, root: str, pattern: str = SHEETS, found: DataFrame | None = None) -> DataFrame:
    """``path, fault`` of the files under ``root`` that cannot be read to their end.

    A truncated or damaged compressed file, and one that may not be opened, would end a whole load. Each is
    found by a task of its own reading it in bounded blocks; files of a store that only Spark opens are not judged.
    ``found`` is a :func:`listing` of the files, where there is one, which spares another.
    """
    files = (listing(spark, root, pattern, recursive=True) if found is None else found).select("path", "uri")
    checked = files.mapInArrow(_faults, "path string, fault string")
    return checked.filter(F.col("fault").isNotNull() & ~not_opened(F.col("fault")))
