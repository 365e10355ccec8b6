"""Spelling variants: words one edit apart, found by PartEnum signatures over their letters."""

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import Scratch, map_arrow, text_slices, whole_runs

LENGTH = 6
OCCURRENCES = 5
# A form is at least this many times as frequent.
RATIO = 5
# One occurrence in so many loses a letter.
DAMAGED = 199
_RUN = re.compile("[a-zÀ-ÿ]{%d,}" % LENGTH)
# A replaced letter changes a letter multiset in two elements, one more or less in one: of so many parts one agrees.
PARTS = {"replaced": 3, "inserted": 2}
# Words that one unit compares; a larger bucket is cut into blocks.
BUCKET = 512
# Distinct words that a task counts before it passes the counts on.
_HELD = 200_000
_U = np.uint64


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of one task per word, passed on whenever ``_HELD`` words are held."""
    counts: Counter = Counter()

    def pass_on() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
        counts.clear()
        return out

    for batch in text_slices(batches):
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts):
            if not text:
                continue
            # Of UTF-8 bytes only A-Z are lower-cased.
            found = Counter(_RUN.findall(text.lower().decode()))
            begun = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
            for run, n in found.items():
                h = zlib.crc32(run.encode(), begun)
                if h % DAMAGED == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                    if len(run) < LENGTH:
                        continue
                counts[run] += n
            if len(counts) >= _HELD:
                yield pass_on()
    yield pass_on()


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word, n`` of the words of whole texts with ``LENGTH`` code points or more and ``OCCURRENCES`` or more.

    A word is a run of the letters A-Z, a-z and U+00C0 to U+00FF, lower-cased in A-Z. Where the
    checksum of ``doc_id:run`` is a multiple of ``DAMAGED``, a code point of the run is deleted first. NULL and empty
    texts have no words; a NULL doc_id counts as an empty one.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Texts are cut into words and counted in the tasks, so a frequent word is a row per task.
    counts = map_arrow(rows, _counted, "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= OCCURRENCES)


@lru_cache(4096)
def _element(letter: str, times: int) -> int:
    """The hash of the ``times``-th of a letter in a word."""
    return xxhash.xxh64_intdigest(f"{letter}{times}")


def _parts(word: str, parts: int) -> list[int]:
    """A word's letters, and how often each occurs, as a set dealt into parts: the hash of each part."""
    out, times = [0] * parts, {}
    for letter in word:
        n = times[letter] = times.get(letter, 0) + 1
        out[(ord(letter) + n) % parts] ^= _element(letter, n)
    return out


def signatures(word: str) -> list[int]:
    """PartEnum signatures of a word: a hash for each part of its letter multiset, at either half, for each kind of edit.

    Multisets are binary vectors, dealt into one part more than the edit changes elements, so that two words one edit apart
    agree in a part. They also agree in the half of the shorter one that the edit is not in; with its length in
    the signature this keeps anagrams of other words out of a bucket. A word may be the shorter or the longer one of an insertion.
    """
    n = len(word)
    keys = []
    for kind, lengths in (("replaced", (n,)), ("inserted", (n, n - 1))):
        parts = list(enumerate(_parts(word, PARTS[kind])))
        for length in lengths:
            half = length // 2
            for anchor in (word[:half], "\x00" + word[half - length :]):
                head = f"{kind}{length}{anchor}"
                keys += [xxhash.xxh64_intdigest(f"{head}{i} {part}") for i, part in parts]
    return keys


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = np.array([signatures(w) for w in batch.column("word").to_pylist()], _U)
        width = keys.shape[1] if len(keys) else 1
        ends = np.arange(0, len(keys) * width + 1, width, dtype=np.int32)
        lists = pa.ListArray.from_arrays(ends, keys.reshape(-1).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), lists], names=["word", "n", "keys"])


def near(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes one word of the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, x in enumerate(a) if x != b[i]), len(a))
    return a[at:] == b[at + 1 :] if len(a) < len(b) else a[at + 1 :] == b[at + 1 :]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The near words of each unit, both ways; members of its left block meet those of its right one."""
    for table in whole_runs(batches, ["key", "left", "right"]):
        words, ns, blocks = (table.column(c).to_pylist() for c in ("word", "n", "block"))
        left, right = (table.column(c).to_pylist() for c in ("left", "right"))
        keys = np.stack([table.column(c).to_numpy() for c in ("key", "left", "right")])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), len(words)]
        a, b, n = [], [], []
        for start, stop in zip(cuts, cuts[1:]):
            whole = left[start] == right[start]
            columns = range(start, stop) if whole else [i for i in range(start, stop) if blocks[i] == right[start]]
            for i in range(start, stop):
                if not whole and blocks[i] != left[start]:
                    continue
                word = words[i]
                for j in range(i + 1, stop) if whole else columns:
                    if near(word, words[j]):
                        a += (word, words[j])
                        b += (words[j], word)
                        n += (ns[j], ns[i])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(n, pa.int64())], names=["word", "other", "n"])


def near_pairs(words: DataFrame, scratch: Scratch) -> DataFrame:
    """``word, other, n`` for every pair of near words of a table ``word, n``, both ways, as a table; n is the other's.

    Words meet in buckets of equal signatures. Buckets of one word are left out; of a large one, each pair of
    blocks is a unit of bounded size. No bucket is capped.
    """
    signed = map_arrow(words, _signed, "word string, n bigint, keys array<bigint>")
    keyed = scratch.table(signed.select("word", "n", F.explode("keys").alias("key")), "signatures")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    shared = shared.select("key", F.ceil(F.col("m") / BUCKET).cast("int").alias("blocks"))
    placed = (
        keyed.join(shared, "key")
        .withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("left", F.least("block", "other"))
        .withColumn("right", F.greatest("block", "other"))
        .select("key", "left", "right", "block", "word", "n")
    )
    dealt = placed.repartition("key", "left", "right").sortWithinPartitions("key", "left", "right")
    found = map_arrow(dealt, _verified, "word string, other string, n bigint")
    out = scratch.table(found.distinct(), "near")
    scratch.drop(keyed)
    return out


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """``word, root`` for every word of ``word, form``, as a table: chains are halved until each ends.

    A form is at least ``RATIO`` times as frequent, so a chain is no longer than the logarithm of the largest count.
    """
    table = scratch.table(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        above = table.filter("word <> root").select(F.col("root").alias("_above"), F.col("word").alias("root"))
        if not table.join(above, "root", "left_semi").limit(1).count():
            return table
        following = table.join(above, "root", "left").select("word", F.coalesce("_above", "root").alias("root"))
        table, before = scratch.table(following, "roots"), table
        scratch.drop(before)


def group_variants(words: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of a vocabulary ``word, n`` of distinct words.

    Two words are near if they differ by one inserted, deleted or replaced code point; words
    shorter than ``LENGTH`` may be missed. ``n_near`` counts a word's near words; ``form`` is the most frequent of them (of equal ones
    the first in code point order) if it is ``RATIO`` times as frequent or more, else NULL. ``root`` is where
    the forms lead to, the word itself without one. An empty vocabulary gives no rows.
    """
    scratch = Scratch(words.sparkSession, "spelling")
    words = scratch.table(words, "words")
    pairs = near_pairs(words, scratch)
    # Code point order is the order of UTF-8 bytes, which Spark compares strings by.
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("other").alias("word")))
    nearest = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = words.join(nearest, "word", "left")
    most = -F.col("best.n")
    formed = most >= F.col("n") * RATIO
    forms = scratch.table(
        joined.select(
            "word",
            F.when(formed, F.col("best.word")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(formed, most).alias("form_n"),
        ),
        "forms",
    )
    return forms.join(_roots(forms, scratch), "word").select("word", "form", "root", "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """:func:`group_variants` of the :func:`vocabulary` of whole texts; further columns of ``docs`` are left out."""
    return group_variants(vocabulary(docs))
