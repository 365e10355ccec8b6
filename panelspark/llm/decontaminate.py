"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Only built-in expressions; no Python runs on the executors.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import Scratch, matching, small_side

WIDTH = 5
# Containment in hundredths from which a document counts as contaminated.
THRESHOLD = 75
# Further sketch values beyond the fewest that cannot all be missing; so many more must be found.
EXTRA = 2


def shingles(text: Column) -> Column:
    """The distinct 64-bit hashes of a text's five-word shingles, as an array.

    Words are runs between white space (20, 09 to 0D) of the lower-cased text. A text of
    fewer words has its whole sequence as one shingle; NULL and wordless texts have none.
    """
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def from_words(w: Column) -> Column:
        at = [lambda i, j=j: F.get(w, i + j) for j in range(WIDTH)]
        rolled = F.transform(F.sequence(F.lit(0), F.size(w) - WIDTH), lambda i: F.xxhash64(*[a(i) for a in at]))
        short = F.array(F.xxhash64(F.lit("short"), F.array_join(w, " ")))
        none = F.array().cast("array<bigint>")
        return F.when(F.size(w) >= WIDTH, F.array_distinct(rolled)).when(F.size(w) > 0, short).otherwise(none)

    # A transform over one element evaluates the words once.
    return F.coalesce(F.transform(F.array(words), from_words)[0], F.array().cast("array<bigint>"))


def item_sketches(items: DataFrame) -> DataFrame:
    """Items with shingles: ``item_id, elements, q, need, partition, sketch``.

    Items are partitioned by set size, each partition from a power of two to the next.
    A sketch holds the smallest hashes of the set, a bottom-k MinHash. At least ``need``
    of the ``q`` shingles must be found, so at most ``q - need`` are missing; a sketch
    of ``gap + 1 + EXTRA`` values, where ``gap`` is the most that any item of the partition may
    miss, shares ``size(sketch) - (q - need)`` or more with every document that contains the item.
    """
    sets = items.filter("item_id is not null").select("item_id", shingles(F.col("text")).alias("elements"))
    # Repeated rows of an item are one item; several texts under one item_id are several.
    sized = sets.withColumn("q", F.size("elements")).filter("q > 0").distinct()
    upper = F.pow(F.lit(2), F.floor(F.log2("q")) + 1) - 1
    return sized.select(
        "item_id",
        F.xxhash64("item_id", "elements").alias("item"),
        "elements",
        "q",
        F.ceil(F.col("q") * THRESHOLD / 100).cast("int").alias("need"),
        F.floor(F.log2("q")).cast("int").alias("partition"),
        F.slice(F.array_sort("elements"), 1, F.floor(upper * (100 - THRESHOLD) / 100).cast("int") + 1 + EXTRA).alias("sketch"),
    )


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, n_item_shingles, n_contained, containment`` of every item found in a document.

    An item is found where the document holds at least 75 in 100 of its distinct five-word
    shingles, however long the document is. An item of fewer than five words is
    found only as a whole text. Items and documents that are NULL or without words, or have
    no id, are never found. Repeated rows count once; of several texts under one id each counts
    by itself and the fullest is returned. Further columns are ignored.

    The shingles of all documents meet the sketches, one row per value, broadcast where they are
    proven few and shuffled otherwise. Only documents with enough hits for an item are read again and compared in full.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    texts = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sketches = scratch.table(item_sketches(items), "items")
    values = scratch.table(
        sketches.select(
            F.explode("sketch").alias("value"), "item", (F.size("sketch") - (F.col("q") - F.col("need"))).alias("enough"), "need"
        ),
        "sketches",
    )
    probes = texts.select("doc_id", shingles(F.col("text")).alias("s")).withColumn("n", F.size("s"))
    probes = probes.select("doc_id", "n", F.explode("s").alias("value"))
    hits = probes.join(small_side(values), "value").filter("n >= need").select("doc_id", "item", "enough", "value").distinct()
    candidates = hits.groupBy("doc_id", "item").agg(F.count(F.lit(1)).alias("hits"), F.first("enough").alias("enough"))
    candidates = scratch.table(candidates.filter("hits >= enough").select("doc_id", "item"), "candidates")
    suspects = scratch.table(candidates.select("doc_id").distinct(), "suspects")
    again = texts.join(small_side(suspects), "doc_id", "left_semi").select("doc_id", shingles(F.col("text")).alias("s"))
    wanted = candidates.join(small_side(sketches.select("item", "item_id", "elements", "q", "need")), "item")
    found = again.join(wanted, "doc_id").withColumn("n_contained", F.size(F.array_intersect("s", "elements")))
    best = (
        found.filter("n_contained >= need")
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.struct((F.col("n_contained") / F.col("q")).alias("containment"), "n_contained", "q")).alias("b"))
    )
    return best.select(
        "doc_id",
        "item_id",
        F.col("b.q").cast("bigint").alias("n_item_shingles"),
        F.col("b.n_contained").cast("bigint").alias("n_contained"),
        F.col("b.containment").alias("containment"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents in which no item is found, with all their columns."""
    scratch = Scratch(docs.sparkSession, "contaminated")
    ids = scratch.table(contaminated(docs, items).select("doc_id").distinct(), "ids")
    return matching(docs, F.col("doc_id"), ids, "left_anti")
