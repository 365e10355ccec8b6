"""Records of text files that many tasks read: a scan over splits finds where they begin.

A split does not know whether it begins inside quotes. So each split says what it does to either
state, the splits' answers are composed in order, one row per split, and each then
cuts its records knowing its start. Nothing is read by one task but what one record or one split holds.
"""

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from panelspark import schema as S
from panelspark.plans.lineage import has_shared_folder, materialise
from panelspark.sources.files import few_listing_tasks, file_path

_SPLIT = ("path", "start")
# Possessive, so that no length of a line costs stack or backtracking. Quotes count at the start of a cell only.
_INSIDE = r'[^"]*+(?:""[^"]*+)*+'
_CELLS = rf'(?:(?:"{_INSIDE}"[^,]*+|[^",][^,]*+|),)*+'
_OPENS = rf'{_CELLS}"{_INSIDE}\z'
_FROM_OUTSIDE = rf"\A{_OPENS}"
_FROM_INSIDE = rf'\A{_INSIDE}(?:\z|"[^,]*+,{_OPENS})'


def read_pieces(spark: SparkSession, paths: str | Sequence[str], separator: str | None = None, pattern: str | None = None, recursive: bool = False, **options) -> DataFrame:
    """``path, uri, start, id, value``: files cut at line breaks, or at ``separator``, by as many tasks as they have splits.

    ``uri`` is the path as Spark encodes it; ``start`` is the split's place in its file. Within a split the ids have no gaps, and order its pieces.
    """
    reader = spark.read.options(recursiveFileLookup=recursive, **options)
    if separator:
        reader = reader.option("lineSep", separator)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    with few_listing_tasks(spark):
        lines = reader.text(paths if isinstance(paths, str) else list(paths))
    return lines.select(
        file_path().alias("path"),
        F.col("_metadata.file_path").alias("uri"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("id"),
        "value",
    )


def _upto() -> Window:
    return Window.partitionBy(*_SPLIT).orderBy("id").rowsBetween(Window.unboundedPreceding, 0)


def _before_split() -> Window:
    return Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)


def _composed(df: DataFrame, window) -> DataFrame:
    """Add what the rows up to each make of either state, from ``a`` and ``b``, what each row makes of outside (0) and inside (1).

    A row leaves the state, swaps it or sets it. So the state is the one set last, swapped as often as was since.
    """
    swaps = F.sum((F.col("a") > F.col("b")).cast("int")).over(window)
    constant = F.when(F.col("a") == F.col("b"), F.struct(F.col("a").alias("v"), F.col("_swaps").alias("at")))
    return df.withColumn("_swaps", swaps).withColumn("_set", F.last(constant, ignorenulls=True).over(window))


def _after(start: Column) -> Column:
    """The state after a row of :func:`_composed`, given the one before the first."""
    since = F.when(F.col("_set").isNotNull(), F.col("_set.v") + F.col("_swaps") - F.col("_set.at")).otherwise(start + F.col("_swaps"))
    return (since % 2).cast("int")


def _quoting(lines: DataFrame) -> DataFrame:
    """Lines with ``a`` and ``b``: whether a quote is open after them if none, or one, is open before."""
    quoted = F.col("value").contains('"')
    return lines.withColumns(
        {
            "a": F.when(quoted, F.col("value").rlike(_FROM_OUTSIDE).cast("int")).otherwise(0),
            "b": F.when(quoted, F.col("value").rlike(_FROM_INSIDE).cast("int")).otherwise(1),
        }
    )


def _opens() -> Column:
    """Whether a line, begun outside quotes, ends inside."""
    return F.col("value").contains('"') & F.col("value").rlike(_FROM_OUTSIDE)


def has_line_breaks(lines: DataFrame) -> bool:
    """Whether a cell of any line holds a line break: only then does some line, begun outside quotes, end inside."""
    return bool(lines.filter(_opens()).limit(1).count())


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int, int]]:
    """The splits that a batch holds lines of, in order: ``(path, start)`` and the rows from, to."""
    if not batch.num_rows:
        return
    path, start = batch.column("path"), batch.column("start")
    other = pc.or_(pc.not_equal(path[1:], path[:-1]), pc.not_equal(start[1:], start[:-1]))
    cuts = [0, *(np.flatnonzero(other.to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows]
    for at, to in zip(cuts, cuts[1:]):
        yield (path[at].as_py(), start[at].as_py()), at, to


def _states(a: np.ndarray, b: np.ndarray, state: int) -> tuple[np.ndarray, np.ndarray]:
    """The states before and after each line, given the one before the first: a line leaves the state, swaps it or sets it."""
    swaps = np.cumsum(a > b)
    last = np.maximum.accumulate(np.where(a == b, np.arange(len(a)), -1))
    after = np.where(last >= 0, a[last] + swaps - swaps[last], state + swaps) % 2
    return np.concatenate(([state], after[:-1])), after


_FIGURES = "path string, start long, first long, n long, opens int, " + ", ".join(f"inside{s} long, end{s} int, open{s} long" for s in (0, 1))


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per split from its lines in order: lines, those that begin inside quotes, the state after them and the line
    that last opened a quote, for either state before them."""

    def row(key, f):
        return {"path": key[0], "start": key[1], **f}

    schema = pa.schema(
        [("path", pa.string()), ("start", pa.int64()), ("first", pa.int64()), ("n", pa.int64()), ("opens", pa.int32())]
        + [(f"{name}{s}", kind) for s in (0, 1) for name, kind in (("inside", pa.int64()), ("end", pa.int32()), ("open", pa.int64()))]
    )
    known, found = None, {}
    for batch in batches:
        done = []
        ids, a, b = (batch.column(c).to_numpy() for c in ("id", "a", "b"))
        for key, at, to in _runs(batch):
            if key != known:
                if known is not None:
                    done.append(row(known, found))
                known, found = key, {"first": int(ids[at]), "n": 0, "opens": 0, "inside0": 0, "end0": 0, "open0": None, "inside1": 0, "end1": 1, "open1": None}
            found["n"] += to - at
            found["opens"] = max(found["opens"], int(a[at:to].max()))
            for s in (0, 1):
                before, after = _states(a[at:to], b[at:to], found[f"end{s}"])
                found[f"inside{s}"] += int(before.sum())
                found[f"end{s}"] = int(after[-1])
                opened = np.flatnonzero(before < after)
                if len(opened):
                    found[f"open{s}"] = int(ids[at + opened[-1]])
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)
    if known is not None:
        yield pa.RecordBatch.from_pylist([row(known, found)], schema)


def _splits(lines: DataFrame) -> DataFrame:
    """A row per split with its lines and what precedes it in the file: state, lines and records."""
    known = _quoting(lines).select(*_SPLIT, "id", "a", "b").mapInArrow(_figures, _FIGURES)
    ordered = _composed(known.withColumnsRenamed({"end0": "a", "end1": "b"}), Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, 0))
    in_order = Window.partitionBy("path").orderBy("start")
    ordered = ordered.withColumn("_state", _after(F.lit(0))).withColumn("state", F.coalesce(F.lag("_state").over(in_order), F.lit(0)))

    def pick(name: str) -> Column:
        return F.when(F.col("state") == 1, F.col(f"{name}1")).otherwise(F.col(f"{name}0"))

    ordered = ordered.withColumn("records", F.col("n") - pick("inside"))
    before = _before_split()
    shifts = {"lines_before": F.coalesce(F.sum("n").over(before), F.lit(0)), "records_before": F.coalesce(F.sum("records").over(before), F.lit(0))}
    ordered = ordered.withColumns(shifts).withColumn("_open", F.col("lines_before") + pick("open") - F.col("first"))
    # A quote that is never closed opens no record: the file's lines from there on stand as they are.
    whole = Window.partitionBy("path")
    ends_inside = F.max_by("_state", "start").over(whole) == 1
    return ordered.select(
        *_SPLIT, "first", "state", "lines_before", "records_before", F.when(ends_inside, F.max("_open").over(whole)).alias("unclosed")
    )


# Rows, at most, of a table of splits that is broadcast; each has a path and a few numbers.
_BROADCAST_SPLITS = 500_000


def _few_splits(lines: DataFrame) -> bool:
    return len(lines._jdf.inputFiles()) + lines.rdd.getNumPartitions() <= _BROADCAST_SPLITS


def _beside(lines: DataFrame, splits: DataFrame) -> DataFrame:
    """The table of splits, for a join to their lines: broadcast if its rows, of which a file has one and each full task one more, are few."""
    return F.broadcast(splits) if _few_splits(lines) else splits


def _line_counts(lines: DataFrame, *more: Column) -> DataFrame:
    """Per split its lines and the first one's id; paths are decoded once a split, not once a line."""
    counts = lines.groupBy("uri", "start").agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("_first"), *more)
    return counts.withColumn("path", file_path("uri"))


def number_lines(lines: DataFrame, without: DataFrame | None = None, counts: DataFrame | None = None, named: Callable[[Column], Column] | None = None) -> DataFrame:
    """``path, row_idx, value``: every line with its 0-based number in its file; lines are neither shuffled nor sorted.

    Files whose ``path`` is in ``without`` are left out. ``counts`` are the lines' counts per split, where they are known;
    ``named`` makes the path that is shown out of a file's.
    """
    counts = _line_counts(lines) if counts is None else counts
    shifts = counts.select("uri", *_SPLIT, (F.coalesce(F.sum("_n").over(_before_split()), F.lit(0)) - F.col("_first")).alias("_shift"))
    shifts = shifts if without is None else shifts.join(without.select("path"), "path", "left_anti")
    shifts = shifts.select("uri", "start", "_shift", (named or _same)(F.col("path")).alias("path"))
    placed = lines.drop("path").join(_beside(lines, shifts), ["uri", "start"])
    return placed.select("path", (F.col("id") + F.col("_shift")).alias("row_idx"), "value")


def _same(path: Column) -> Column:
    return path


_RECORDS = "path string, row_idx long, line long, value string, whole boolean"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records from the lines of splits in order; of a record over split borders the lines of each split, as not whole.

    No more is held than a batch and the lines of the record that is open at its end.
    """
    known, state = None, 0
    held = None  # the record that is open: path, number, first line, whether it began in its split, and its lines

    def rows(path, number, line, value, whole):
        columns = [pa.array(path, pa.string()), pa.array(number, pa.int64()), pa.array(line, pa.int64()), value, pa.array(whole, pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, names=["path", "row_idx", "line", "value", "whole"])

    def ended(whole):
        path, number, line, began, parts = held
        values = pa.concat_arrays(parts)
        value = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values), "\n")
        return rows([path], [number], [line], value, [began and whole])

    for batch in batches:
        value = batch.column("value")
        ids, a, b = (batch.column(c).to_numpy() for c in ("id", "a", "b"))
        for key, at, to in _runs(batch):
            first, began, lines_before, records_before, unclosed = (batch.column(c)[at].as_py() for c in ("first", "state", "lines_before", "records_before", "unclosed"))
            if key != known:
                if held:
                    yield ended(False)
                known, state, held, number = key, began, None, records_before
            before, after = _states(a[at:to], b[at:to], state)
            state = int(after[-1])
            line = ids[at:to] - first + lines_before
            beyond = np.zeros(len(line), bool) if unclosed is None else line >= unclosed
            numbers = number + np.cumsum(1 - before) - 1
            number = int(numbers[-1]) + 1
            if unclosed is not None:
                numbers = numbers + np.where(beyond, line - unclosed, 0)
            begins = np.flatnonzero((before == 0) | beyond)
            n = to - at
            head = int(begins[0]) if len(begins) else n
            if head:  # lines of a record that began before them
                if held is None:
                    held = (key[0], int(numbers[0]), int(line[0]), False, [])
                held[-1].append(value.slice(at, head))
                if head < n or not after[-1]:
                    yield ended(True)
                    held = None
            if head == n:
                continue
            stops = np.append(begins[1:], n)
            if after[-1] and not beyond[-1]:  # the last record is open
                held = (key[0], int(numbers[begins[-1]]), int(line[begins[-1]]), True, [value.slice(at + int(begins[-1]), n - int(begins[-1]))])
                begins, stops = begins[:-1], stops[:-1]
            if len(begins):
                offsets = pa.array(np.append(begins, stops[-1]) - begins[0], pa.int32())
                lists = pa.ListArray.from_arrays(offsets, value.slice(at + int(begins[0]), int(stops[-1] - begins[0])))
                joined = pc.binary_join(lists, "\n")
                yield rows(pa.repeat(pa.scalar(key[0], pa.string()), len(begins)), numbers[begins], line[begins], joined, np.ones(len(begins), bool))
    if held:
        yield ended(False)


def cut_records(lines: DataFrame, without: DataFrame | None = None) -> DataFrame:
    """``path, row_idx, value``: the records of delimited files with their 0-based number in the file.

    A record goes on over line breaks within quotes, over as many splits as it takes; these breaks are read as
    line feeds. ``lines`` come as :func:`read_pieces` reads them: a split's lines in order in one task, which cuts them;
    they are neither shuffled nor sorted. Only the lines of records over split borders are, a record per border.
    A quote that its file never closes opens no record. Files whose ``path`` is in ``without`` are left out.
    """
    splits = _splits(lines)
    splits = splits if without is None else splits.join(without.select("path"), "path", "left_anti")
    placed = _quoting(lines.join(_beside(lines, splits), list(_SPLIT)))
    if not _few_splits(lines):  # the join has dealt the lines anew
        placed = placed.repartition(*_SPLIT).sortWithinPartitions(*_SPLIT, "id")
    cut = placed.select(*_SPLIT, "id", "value", "a", "b", "first", "state", "lines_before", "records_before", "unclosed").mapInArrow(_cut, _RECORDS)
    several = cut.filter("not whole").groupBy("path", "row_idx").agg(F.array_sort(F.collect_list(F.struct("line", "value"))).alias("_lines"))
    joined = F.array_join(F.transform("_lines", lambda x: x["value"]), "\n")
    return cut.filter("whole").select("path", "row_idx", "value").unionByName(several.select("path", "row_idx", joined.alias("value")))


def read_records(lines: DataFrame, line_breaks: bool | None = None, without: DataFrame | None = None, named: Callable[[Column], Column] | None = None) -> DataFrame:
    """``path, row_idx, value`` of delimited lines. ``line_breaks`` says whether quoted cells may hold line breaks;
    by default the lines are looked through for one first, and counted with it. Files whose ``path`` is in ``without`` are left out;
    ``named`` makes the path that is shown out of a file's."""
    counts = None
    if line_breaks is None and has_shared_folder(lines.sparkSession):
        counts = materialise(_line_counts(lines, F.max(_opens()).alias("_opens")))
        line_breaks = bool(counts.filter("_opens").limit(1).count())
    if has_line_breaks(lines) if line_breaks is None else line_breaks:
        cut = cut_records(lines, without)
        return cut.withColumn("path", named(F.col("path"))) if named else cut
    return number_lines(lines, without, counts, named)


# JSON documents


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def _nesting(pieces: DataFrame) -> DataFrame:
    """Pieces of JSON between closing braces, with their quotes (odd or even) and the braces and brackets they open.

    Parts between quotes are alternately outside and inside strings, so there is one count for either start.
    """
    parts = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"')
    columns = {"_parts": parts}
    side = {s: F.array_join(F.filter("_parts", lambda x, i: i % 2 == s), "") for s in (0, 1)}
    counted = {"q": (F.size("_parts") + 1) % 2}
    for s in (0, 1):
        counted[f"braces{s}"] = _count(side[s], "{")
        counted[f"brackets{s}"] = _count(side[s], "[") - _count(side[s], "]")
    return pieces.withColumns(columns).withColumns(counted).drop("_parts")


def _steps(rows: DataFrame, start: Column, suffix: str) -> DataFrame:
    """What each piece, with the brace that ends it, adds to the depth of braces and brackets, given its split's start state."""
    after = (start + F.col("_quotes")) % 2
    before = (start + F.col("_quotes") - F.col("q")) % 2
    braces = F.when(before == 0, F.col("braces0")).otherwise(F.col("braces1")) - F.when(after == 0, 1).otherwise(0)
    brackets = F.when(before == 0, F.col("brackets0")).otherwise(F.col("brackets1"))
    return rows.withColumns({f"db{suffix}": braces, f"dk{suffix}": brackets})


def cut_features(pieces: DataFrame) -> DataFrame:
    """``path, feature, text``: the objects in the array of each document's object, in order, as JSON texts.

    ``pieces`` are the documents cut at closing braces (``read_pieces`` with that separator). An object of the array
    ends with the brace that leaves one brace and one bracket open. String state and depth at a split's start follow from the splits
    before it, so a document is cut by as many tasks as it has splits.
    """
    quotes = F.sum("q").over(_upto())
    rows = _nesting(pieces).withColumn("_quotes", quotes)
    both = _steps(_steps(rows.drop("value"), F.lit(0), "0"), F.lit(1), "1")
    splits = both.groupBy(*_SPLIT).agg(F.sum("q").alias("q"), *[F.sum(f"{d}{s}").alias(f"{d}{s}") for d in ("db", "dk") for s in (0, 1)])
    before = _before_split()
    splits = splits.withColumn("state", (F.coalesce(F.sum("q").over(before), F.lit(0)) % 2).cast("int"))
    sums = {}
    for d in ("db", "dk"):
        own = F.when(F.col("state") == 0, F.col(f"{d}0")).otherwise(F.col(f"{d}1"))
        sums[f"{d}_before"] = F.coalesce(F.sum(own).over(before), F.lit(0))
    splits = splits.withColumns(sums).select(*_SPLIT, "state", "db_before", "dk_before")
    placed = _steps(rows.join(_beside(pieces, splits), list(_SPLIT)), F.col("state"), "")
    depth = {d: F.col(f"{d}_before") + F.sum(d).over(_upto()) for d in ("db", "dk")}
    closes = (F.col("_b") == 1) & (F.col("_k") == 1) & ((F.col("state") + F.col("_quotes")) % 2 == 0)
    placed = placed.withColumns({"_b": depth["db"], "_k": depth["dk"]}).withColumn("closes", closes.cast("int"))
    placed = placed.select(*_SPLIT, "id", "value", "closes")
    found = placed.groupBy(*_SPLIT).agg(F.sum("closes").alias("n"))
    found = found.select(*_SPLIT, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    number = F.col("shift") + F.sum("closes").over(_upto()) - F.col("closes")
    numbered = placed.join(_beside(pieces, found), list(_SPLIT)).withColumn("feature", number)
    grouped = numbered.groupBy("path", "feature").agg(
        F.array_sort(F.collect_list(F.struct("start", "id", "value"))).alias("_pieces"), F.max("closes").alias("whole")
    )
    text = F.concat(F.array_join(F.transform("_pieces", lambda p: p["value"]), "}"), F.lit("}"))
    # The first object follows the array's name; the others a comma.
    headed = F.regexp_replace(text, r'(?s)\A.*?"features"\s*:\s*\[', "")
    own = F.when(F.col("feature") == 0, headed).otherwise(F.regexp_replace(text, r"\A\s*,", ""))
    return grouped.filter("whole = 1").select("path", "feature", F.ltrim(own).alias("text"))


def read_collection(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``properties, geometry`` of the features of GeoJSON documents."""
    texts = cut_features(read_pieces(spark, path, separator="}"))
    schema = StructType([StructField("type", StringType()), *S.GEO_FEATURE])
    features = texts.select(F.from_json("text", schema).alias("f"))
    return features.filter(F.coalesce(F.col("f.type"), F.lit("Feature")) == "Feature").select("f.properties", "f.geometry")
