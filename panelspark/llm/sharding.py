"""Shards of near-equal bytes from a k-d tree over document metadata.

Only built-in expressions; the driver holds the tree alone, one cut per inner node.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import Scratch, constant_table, small_side

OVERHEAD = 16
# Metadata dimensions in the order that settles equal widths.
DIMENSIONS = ("source", "lang", "size", "doc_id")
_BITS = 20  # of a coordinate within a key; 32 more bits tell rows of one coordinate apart
_BINS = 4096
# A cut is good when the bin it falls into weighs less than this part of a shard.
_TOLERANCE = 0.0005
# Rows that one window of slot numbers holds, about.
_SLOT_ROWS = 50_000


@dataclass
class Node:
    """A range of shards; an inner node has a dimension, the cut on its key, and two children."""

    first: int
    count: int
    dimension: str | None = None
    cut: int = 0
    children: tuple = ()

    def shard(self) -> Column:
        """The first shard of the node that a row falls into, as an expression on its keys."""
        if not self.children:
            return F.lit(self.first)
        low, high = self.children
        return F.when(F.col(f"k_{self.dimension}") < self.cut, low.shard()).otherwise(high.shard())

    def leaves(self) -> list["Node"]:
        return [leaf for child in self.children for leaf in child.leaves()] if self.children else [self]


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + OVERHEAD


def _metadata(docs: DataFrame) -> list[Column]:
    """Size, text checksum and raw coordinates of every row; missing columns and NULLs have coordinate 0."""
    columns = dict(docs.dtypes)
    raw = {
        name: F.coalesce(F.xxhash64(name).cast("double") if name in ("source", "lang") else F.col(name).cast("double"), F.lit(0.0))
        if name in columns
        else F.lit(0.0)
        for name in DIMENSIONS
        if name != "size"
    }
    size = text_size(F.col("text"))
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return [
        F.col("doc_id").cast("bigint").alias("doc_id"),
        size.alias("size"),
        crc.alias("text_crc32"),
        F.log2(size.cast("double")).alias("c_size"),
        *[c.alias(f"c_{name}") for name, c in raw.items()],
    ]


def _keys(rows: DataFrame) -> list[Column]:
    """A long key per dimension: the coordinate's place in its range, then bits that tell equal ones apart."""
    ends = rows.agg(*[f(f"c_{d}").alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("low", F.min), ("high", F.max))]).first()
    other = F.xxhash64("doc_id", "text_crc32").bitwiseAND(F.lit(0xFFFFFFFF))
    keys = {}
    for d in DIMENSIONS:
        low, high = ends[f"low_{d}"], ends[f"high_{d}"]
        span = (high - low) if low is not None and high > low else 1.0
        place = F.floor((F.col(f"c_{d}") - F.lit(low or 0.0)) / F.lit(span) * F.lit(float((1 << _BITS) - 1)))
        keys[f"k_{d}"] = place.cast("bigint") * F.lit(1 << 32) + other
    return [F.col("doc_id"), F.col("size"), F.col("text_crc32"), *[k.alias(name) for name, k in keys.items()]]


def _split(rows: DataFrame, root: Node, nodes: list[Node], shard_bytes: float) -> None:
    """Give each node the cut at its weighted quantile along its widest dimension.

    The quantile is found by histograms of a few thousand bins, each over the bin of the last one in which
    the quantile lies, for all nodes at once; what is shuffled is one partial sum per bin and task.
    """
    placed = rows.withColumn("node", root.shard())
    widths = placed.filter(F.col("node").isin([n.first for n in nodes])).groupBy("node").agg(
        F.sum("size").alias("total"), *[f(f"k_{d}").alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("low", F.min), ("high", F.max))]
    )
    found = {r["node"]: r for r in widths.collect()}
    search = {}
    for node in nodes:
        row = found.get(node.first)
        if row is None:
            node.dimension = DIMENSIONS[0]
        else:
            node.dimension = max(DIMENSIONS, key=lambda d: (row[f"high_{d}"] >> 32) - (row[f"low_{d}"] >> 32))
            low, high = row[f"low_{node.dimension}"], row[f"high_{node.dimension}"] + 1
            # lowest and highest key, the weight still to find, the node
            search[node.first] = [low, high, row["total"] * (node.count // 2) / node.count, node]
    keys = F.array(*[F.col(f"k_{d}") for d in DIMENSIONS])
    while search:
        state = [(first, DIMENSIONS.index(n.dimension), low, high, float(wanted)) for first, (low, high, wanted, n) in search.items()]
        nodes_ = constant_table(rows.sparkSession, ["node", "dimension", "low", "high", "target"], state)
        inside = placed.join(nodes_, "node").withColumn("key", F.get(keys, F.col("dimension")))
        step = F.ceil((F.col("high") - F.col("low")) / _BINS).cast("bigint")
        bins = (
            inside.filter("key >= low and key < high")
            .groupBy("node", "target", ((F.col("key") - F.col("low")) / step).cast("bigint").alias("bin"))
            .agg(F.sum("size").alias("weight"), F.count(F.lit(1)).alias("n"))
        )
        # At most _BINS rows per node.
        running = bins.withColumn("upto", F.sum("weight").over(Window.partitionBy("node").orderBy("bin")))
        crossing = running.filter("upto >= target").groupBy("node").agg(F.min(F.struct("bin", "weight", "upto", "n")).alias("c"))
        rows_found = {r["node"]: r["c"] for r in crossing.collect()}
        for first, (low, high, wanted, node) in list(search.items()):
            c = rows_found.get(first)
            if c is None:  # the weight is that of all rows
                node.cut = high
                del search[first]
                continue
            width = -(-(high - low) // _BINS)
            start = low + c["bin"] * width
            before = c["upto"] - c["weight"]
            if c["n"] == 1 or width == 1 or c["weight"] <= _TOLERANCE * shard_bytes:
                node.cut = start if wanted - before <= c["upto"] - wanted else start + width
                del search[first]
            else:
                search[first] = [start, min(start + width, high), wanted - before, node]
    for node in nodes:
        half = node.count // 2
        node.children = (Node(node.first, half), Node(node.first + half, node.count - half))


def build_tree(rows: DataFrame, shards: int) -> Node:
    """The k-d tree over keyed rows, one level of nodes after another."""
    root = Node(0, shards)
    total = rows.agg(F.sum("size")).first()[0] or 0
    while nodes := [n for n in root.leaves() if n.count > 1]:
        _split(rows, root, nodes, total / shards)
    return root


def kd_shards(docs: DataFrame, shards: int | None = 40, target_bytes: int | None = None) -> DataFrame:
    """Every row's shard: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    A node with m shards is cut along the dimension in which its rows spread widest, at the point where
    m // 2 in m parts of its bytes lie below, until every leaf is one shard. The number of shards is given, or
    follows from ``target_bytes``. The law is ``bytes``: shards have nearly equal sums of ``size``,
    the bytes of the text (NULL: none) plus 16. Rows of one coordinate, such as a hot source or many equal
    texts, are told apart by a hash of doc_id and text, so that a group of any size is split. Rows
    equal in doc_id, text, source and lang share a shard. A NULL doc_id, lang or source has coordinate 0. ``slot`` numbers the
    rows of a shard from 0 without gaps; ``grown_shard`` is NULL under this law. Further
    columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    narrow = scratch.table(docs.select(*_metadata(docs)), "metadata")
    rows = scratch.table(narrow.select(*_keys(narrow)), "keys")
    if target_bytes:
        shards = max(1, -(-(rows.agg(F.sum("size")).first()[0] or 0) // target_bytes))
    tree = build_tree(rows, shards)
    placed = rows.select("doc_id", "size", "text_crc32", tree.shard().alias("shard"))
    return number_slots(placed, scratch).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def number_slots(placed: DataFrame, scratch: Scratch) -> DataFrame:
    """Number the rows of each shard from 0, in buckets of bounded size that tasks share."""
    largest = placed.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    buckets = largest // _SLOT_ROWS + 1
    bucketed = placed.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = bucketed.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    shifts = scratch.table(counts.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"), "shifts")
    order = Window.partitionBy("shard", "_bucket").orderBy("doc_id", "text_crc32")
    numbered = bucketed.withColumn("_place", F.row_number().over(order) - 1)
    return numbered.join(small_side(shifts), ["shard", "_bucket"]).withColumn("slot", F.col("_place") + F.col("_shift"))


def write_shards(docs: DataFrame, path: str, shards: int = 40) -> None:
    """Write the documents, with all their columns, into one folder per shard; a column of that name gives way."""
    docs = docs.drop("shard")
    scratch = Scratch(docs.sparkSession, "shards")
    narrow = scratch.table(docs.select(*_metadata(docs)), "metadata")
    keys = _keys(narrow)
    tree = build_tree(scratch.table(narrow.select(*keys), "keys"), shards)
    # A row's shard follows from the row itself, so rows that repeat stay as many as they are.
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *_metadata(docs)).select("row", *keys)
    whole.select("row.*", tree.shard().alias("shard")).write.partitionBy("shard").parquet(path)
