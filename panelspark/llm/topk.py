"""Exact top-k by inner product with vector-approximation files."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import Scratch, importable, small_side

SCALE = 256
# Cells of a component: its code is a byte.
CELLS = 256
# Approximated vectors and queries that one group holds, and queries whose bounds it holds at a time.
CHUNK = 8192
BLOCK = 1024
_STEP = 64
# Integers up to this are exact in doubles.
_EXACT = 2**52
_LARGEST = 10**38 - 1
_LONGS = (-(2**63), 2**63 - 1)
_FOUND = "query_row bigint, row bigint, low double, high double"


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


class VaFile:
    """Codes of some vectors' cells, with the place and width of each component's cells."""

    def __init__(self, codes: np.ndarray, low: np.ndarray, width: np.ndarray):
        self.floor = low + codes * width
        self.width = width

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Twice the lowest and highest inner product that any point of each cell can have."""
        middle = (2 * self.floor + self.width - 1) @ queries.T
        reach = np.abs(queries) @ (self.width - 1)
        return middle - reach, middle + reach


def survivors(va: VaFile, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """``(query, vector, low, high)`` of the vectors that may be among the k best of these for a query.

    Only cells are looked at: a vector stays if its highest possible product reaches the k-th highest of the
    lowest possible ones. Vectors with the query's own id take no part.
    """
    low, high = va.bounds(queries)
    own = ids[:, None] == query_ids[None, :]
    low[own] = high[own] = -np.inf
    kept = min(k, len(ids))
    floor = np.partition(low, len(ids) - kept, axis=0)[len(ids) - kept]
    at, q = np.nonzero((high >= floor) & ~own)
    return q, at, low[at, q], high[at, q]


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(rows, -1).astype(float)


def _scan(k: int):
    """The survivors of one group: codes of a chunk of vectors against a block of queries."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        is_query = table.column("is_query").to_pylist()
        flags = pa.array(is_query)
        queries, vectors = table.filter(flags), table.filter(pa.array([not q for q in is_query]))
        found = []
        if queries.num_rows and vectors.num_rows:
            low, width = (np.array(queries.column(c)[0].as_py(), float) for c in ("low", "width"))
            codes = _matrix(vectors.column("codes"), vectors.num_rows) + CELLS // 2
            va, ids, rows = VaFile(codes, low, width), vectors.column("vec_id").to_numpy(), vectors.column("row").to_numpy()
            points = _matrix(queries.column("ints"), queries.num_rows)
            query_ids, query_rows = queries.column("vec_id").to_numpy(), queries.column("row").to_numpy()
            for start in range(0, len(points), _STEP):
                some = slice(start, start + _STEP)
                q, at, lowest, highest = survivors(va, ids, points[some], query_ids[some], k)
                found.append((query_rows[some][q], rows[at], lowest, highest))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.empty(0, t) for t in (np.int64, np.int64, float, float)]
        return pa.table(dict(zip(("query_row", "row", "low", "high"), columns)))

    return run


def _upto(n: int) -> Column:
    return F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))


def _cells(table: DataFrame) -> DataFrame:
    """Per dimension the lowest value and the width of the cells of every component."""
    each = table.select("dim", F.posexplode("ints").alias("i", "x")).groupBy("dim", "i").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    width = F.greatest(F.expr(f"(high - low + {CELLS}) div {CELLS}"), F.lit(1))
    listed = each.groupBy("dim").agg(F.array_sort(F.collect_list(F.struct("i", "low", width.alias("width")))).alias("c"))
    return listed.select("dim", F.transform("c", lambda c: c["low"]).alias("low"), F.transform("c", lambda c: c["width"]).alias("width"))


def _scores(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """``query_row, row`` pairs with the query's and the vector's ids and their exact product; each vector is read once per pair, none copied."""
    queries = table.filter("is_query").select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("ints").alias("q"))
    vectors = table.select("row", "vec_id", F.col("ints").alias("v"))
    product = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0).cast("bigint"), lambda a, b: a + b)
    return pairs.join(vectors, "row").join(queries, "query_row").select("query_row", "row", "query_id", "vec_id", product.alias("score"))


def _best(scored: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _all_pairs_scores(k: int):
    """The k best of a group by exact integers, for components so large that bounds in doubles would not hold."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        is_query = np.array(table.column("is_query").to_pylist(), bool)
        every = np.array(table.column("ints").to_pylist(), dtype=object).reshape(table.num_rows, -1)
        ids, rows = table.column("vec_id").to_numpy(), table.column("row").to_numpy()
        out = []
        for q in np.flatnonzero(is_query).tolist():
            near = np.flatnonzero(~is_query & (ids != ids[q]))
            scores = every[near] @ every[q] if len(near) else []
            order = sorted(range(len(near)), key=lambda i: (-scores[i], ids[near[i]]))[:k]
            out += [(int(rows[q]), int(ids[q]), int(ids[near[i]]), str(max(-_LARGEST, min(_LARGEST, scores[i])))) for i in order]
        columns = list(zip(*out)) or [()] * 4
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_row", "query_id", "vec_id", "score"), columns, kinds)})

    return run


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best vectors of every query row, by integer inner product.

    ``vectors`` has ``vec_id, embedding``; ``is_query`` picks the queries among its rows.
    Components become ``floor(256 * x)``. Candidates are all rows but those with the query's
    vec_id and those of another dimension; ties go to the smaller vec_id. Vectors that are NULL or hold a NULL,
    NaN or infinite component, and rows without a vec_id, take no part. Every repeated query row
    gets its own result; a repeated candidate row is listed each time. With fewer than k
    candidates all are listed. Further columns are ignored; a score beyond 64 bits ranks as it is and is listed as the number of 64 bits next to it.

    1. Of equal vectors no query lists more than k besides itself, so of their rows those with the smallest ids stay, k + 1 of them,
       trimmed before the shuffle; a vector that a third of all rows hold is a few candidates.
    2. Every component becomes a byte, its cell's number. Codes are dealt into chunks and queries into blocks
       of bounded size; a group of both finds the vectors whose highest possible score reaches its k-th highest of the lowest possible.
       Only codes and queries are copied, no side is broadcast or held whole.
    3. Over all groups the k-th highest of a query's lowest scores leaves few vectors. Of these the 2 k of the highest
       bounds are read exactly; whatever bound is below the k-th score found then is done with, and only the others are read as well.
    """
    scratch = Scratch(vectors.sparkSession, "top-k")
    importable(vectors.sparkSession)
    ints = F.transform("embedding", lambda x: F.floor(F.lit(SCALE) * x.cast("double")).cast("bigint"))
    good = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    table = scratch.table(
        good.select(
            F.col("vec_id").cast("bigint").alias("vec_id"),
            ints.alias("ints"),
            F.size("embedding").alias("dim"),
            F.coalesce(is_query, F.lit(False)).alias("is_query"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "vectors",
    )
    peak = F.array_max(F.transform("ints", lambda x: F.abs(x.cast("double"))))
    n, q, most, widest = table.agg(F.count(F.lit(1)), F.count_if("is_query"), F.max(peak), F.max("dim")).first()
    n_chunks, n_blocks = max(1, math.ceil(n / CHUNK)), max(1, math.ceil(q / BLOCK))
    place = F.xxhash64("row")
    chunk, block = F.pmod(place, F.lit(n_chunks)), F.pmod(place, F.lit(n_blocks))
    group = ["chunk", "block", "dim"]

    def dealt(candidates: DataFrame, columns: list[str]) -> DataFrame:
        """Every candidate in a group with each block of queries."""
        rows = candidates.select(*columns, F.lit(False).alias("is_query"), chunk.alias("chunk"), F.explode(_upto(n_blocks)).alias("block"))
        asked = queries.select(*columns, F.lit(True).alias("is_query"), F.explode(_upto(n_chunks)).alias("chunk"), block.alias("block"))
        return rows.unionByName(asked)

    queries = table.filter("is_query")
    if most is not None and 4 * most * most * max(widest, 1) >= _EXACT:
        found = dealt(table, ["vec_id", "ints", "row", "dim"]).groupBy(*group)
        exact = found.applyInArrow(_all_pairs_scores(k), "query_row bigint, query_id bigint, vec_id bigint, score string")
        ranked = _best(exact.withColumn("score", F.col("score").cast("decimal(38,0)")), k)
        within = F.greatest(F.least("score", F.lit(_LONGS[1]).cast("decimal(38,0)")), F.lit(_LONGS[0]).cast("decimal(38,0)"))
        return ranked.select("query_id", "rank", "vec_id", within.cast("bigint").alias("score"))
    cells = small_side(scratch.table(_cells(table), "cells"))
    steps = F.zip_with(F.zip_with("ints", "low", lambda x, low: x - low), "width", lambda x, w: F.floor(x / w).cast("int") - CELLS // 2)
    copies = Window.partitionBy("ints").orderBy("vec_id", "row")
    once = table.withColumn("_copy", F.row_number().over(copies)).filter(F.col("_copy") <= k + 1)
    coded = once.join(cells, "dim").select("vec_id", "row", "dim", steps.cast("array<tinyint>").alias("codes"))
    coded = scratch.table(coded, "codes")
    # What tells the cells' places travels with the queries alone.
    coded = coded.withColumns({c: F.lit(None).cast("array<bigint>") for c in ("low", "width", "ints")})
    queries = queries.join(cells, "dim").withColumn("codes", F.lit(None).cast("array<tinyint>"))
    columns = ["vec_id", "row", "dim", "low", "width", "codes", "ints"]
    local = scratch.table(dealt(coded, columns).groupBy(*group).applyInArrow(_scan(k), _FOUND), "local")
    by_low = Window.partitionBy("query_row").orderBy(F.col("low").desc())
    floors = local.withColumn("_n", F.row_number().over(by_low)).filter(F.col("_n") <= k)
    floors = floors.groupBy("query_row").agg(F.min("low").alias("floor"), F.count(F.lit(1)).alias("n"))
    likely = local.join(floors, "query_row").filter((F.col("n") < k) | (F.col("high") >= F.col("floor")))
    by_high = Window.partitionBy("query_row").orderBy(F.col("high").desc(), "row")
    likely = scratch.table(likely.withColumn("place", F.row_number().over(by_high)).select("query_row", "row", "high", "place"), "likely")
    first = scratch.table(_scores(likely.filter(F.col("place") <= 2 * k).select("query_row", "row"), table), "first")
    sure = _best(first, k).groupBy("query_row").agg(F.min("score").alias("least"))
    # Bounds are twice the product's.
    rest = likely.filter(F.col("place") > 2 * k).join(sure, "query_row").filter(F.col("high") >= 2 * F.col("least"))
    scored = first.unionByName(_scores(rest.select("query_row", "row"), table))
    return _best(scored, k).select("query_id", "rank", "vec_id", "score")
