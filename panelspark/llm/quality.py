"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import Scratch, map_arrow, matching, text_slices
from panelspark.llm.language import TokenHashes, bigram_hashes, contexts, fit_logistic, logits

BUCKETS = 1 << 16
# Labelled documents, at most, that the target model is counted on and that the decision is fitted on.
TARGET = 20_000
FITTED = 5_000
SMOOTHING = 1.0
# Features without evidence that every text has besides its own, so that few features decide little.
NEUTRAL = 8
# Features of the text that every log weight is tempered to before the draw, so that a long text is not drawn for its length.
TEMPERED = 512
_U = np.uint64
_REPEAT = _U(0x9FB21C651E98DF25)
_BINS = 4096


def features(tokens: np.ndarray) -> np.ndarray:
    """The buckets of a text's words and word pairs. A token after itself is one pair, whatever the token."""
    if not len(tokens):
        return np.empty(0, np.int64)
    pairs = np.where(tokens == contexts(tokens), _REPEAT, bigram_hashes(tokens))
    return (np.concatenate((tokens, pairs)) % _U(BUCKETS)).astype(np.int64)


@dataclass
class Model:
    """The log ratio of target to raw probability per bucket, and the fit of the decision."""

    ratios: np.ndarray
    fit: tuple | None = None

    def weigh(self, tokens: np.ndarray) -> tuple[float, float]:
        """The importance weight's logarithm, and the same per feature, ``NEUTRAL`` ones included."""
        found = features(tokens)
        total = float(self.ratios[found].sum())
        return total, total / (len(found) + NEUTRAL)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of one task per bucket: one row for each that occurs."""
    hashes = TokenHashes()
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in text_slices(batches):
        for text, chosen in zip(batch.column("text").to_pylist(), batch.column("target").to_pylist()):
            found = features(hashes(text))
            np.add.at(raw, found, 1)
            if chosen:
                np.add.at(target, found, 1)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays(
        [pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"]
    )


def _sample(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """``_id, good, role`` of labelled documents: role 0 counts for the target, role 1 for the fit."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("_id")).agg(F.min("quality").alias("good"))
    known = known.join(docs.select(F.col("doc_id").cast("bigint").alias("_id")).distinct(), "_id", "left_semi")
    role = F.when(F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(4)) == 0, 1).otherwise(0)
    known = scratch.table(known.withColumn("role", role), "known")
    order = [F.xxhash64("_id"), F.col("_id")]
    target = known.filter("role = 0 and good = 1").orderBy(*order).limit(TARGET)
    fitted = known.filter("role = 1").orderBy(*order).limit(FITTED)
    return scratch.table(target.union(fitted), "sample")


def _weigh(batches: Iterator[pa.RecordBatch], model) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    hashes = TokenHashes()
    for batch in text_slices(batches):
        rows = [model.value.weigh(hashes(t)) for t in batch.column("text").to_pylist()]
        yield batch, np.array(rows, float).reshape(-1, 2)


def train_model(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> Model:
    """Bucket counts of all documents (raw) and of good labelled ones (target), and the fitted decision.

    Every task sums its own counts, so what is shuffled is a row per bucket and task. With labels of one
    kind alone, or none, the weight alone decides: texts at least as likely under the target are kept.
    """
    spark = docs.sparkSession
    sample = _sample(docs, labels, scratch)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("_id"), "text")
    marked = texts.join(F.broadcast(sample.filter("role = 0").select("_id", F.lit(True).alias("target"))), "_id", "left")
    counts = map_arrow(marked.select("text", "target"), _counts, "bucket int, raw bigint, target bigint")
    summed = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = summed.column("bucket").to_numpy()
    raw[at], target[at] = summed.column("raw").to_numpy(), summed.column("target").to_numpy()
    # The raw model also smooths the target's, so that a bucket without evidence has the ratio 1.
    base = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * BUCKETS)
    prior = BUCKETS * SMOOTHING
    model = Model(np.log((target + prior * base) / (target.sum() + prior) / base))
    held = spark.sparkContext.broadcast(model)
    fitted = texts.join(F.broadcast(sample.filter("role = 1").select("_id", "good")), "_id").select("text", "good")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, weights in _weigh(batches, held):
            yield pa.RecordBatch.from_arrays([batch.column("good"), pa.array(weights[:, 1])], names=["good", "x"])

    # At most FITTED rows of two numbers.
    rows = map_arrow(fitted.withColumn("good", F.col("good").cast("int")), run, "good int, x double").toArrow()
    x, y = rows.column("x").to_numpy().reshape(-1, 1), rows.column("good").to_numpy().astype(float)
    model.fit = fit_logistic(x, y) if 0 < y.sum() < len(y) else (np.zeros(1), np.ones(1), np.array([1.0, 1e-6]))
    return model


def weigh(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, log_weight, per_feature, log_odds, draw`` of every row, where draw tells repeated doc_ids apart."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64(F.col("doc_id").cast("bigint"), "text").alias("draw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, weights in _weigh(batches, held):
            odds = logits(weights[:, 1:], held.value.fit)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(weights[:, 0]), pa.array(weights[:, 1]), pa.array(odds), batch.column("draw")],
                names=["doc_id", "log_weight", "per_feature", "log_odds", "draw"],
            )

    schema = "doc_id bigint, log_weight double, per_feature double, log_odds double, draw bigint"
    return map_arrow(rows, run, schema)


def gumbel(draw: Column) -> Column:
    """Gumbel noise that a row's hash decides, so that every run draws alike."""
    uniform = (F.pmod(F.xxhash64(draw, F.lit(42)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.ln(-F.ln(uniform))


def kth_largest(rows: DataFrame, column: str, k: int) -> float:
    """The k-th largest value of a column, by histograms over ever smaller ranges."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    if low is None or k <= 0:
        return float("inf")
    value = F.col(column)
    while low < high:
        step = (high - low) / _BINS
        if low + step <= low:
            return low
        bin_ = F.least(F.floor((value - low) / step), F.lit(_BINS - 1))
        inside = rows.filter((value >= low) & (value <= high))
        bins = inside.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
        for row in sorted(bins.collect(), key=lambda r: -r["bin"]):  # at most _BINS rows
            if k <= row["n"]:
                low, high = row["low"], row["high"]
                break
            k -= row["n"]
        if k == 1:
            return high
    return low


def quality(docs: DataFrame, labels: DataFrame, keep: int | None = None) -> DataFrame:
    """``doc_id, log_weight, log_odds, key, kept`` of every row: a sample of the documents by importance.

    The importance weight of a text is the ratio of its probabilities under the hashed n-gram models of good
    and of all text. Each row's key is the logarithm of its weight, tempered to a text of ``TEMPERED`` features, plus Gumbel noise, and
    the ``keep`` rows of the largest keys are the sample (equal keys share their fate). Where ``keep`` is not
    given it is the number of rows that a logistic regression on the log weight per feature calls more likely good than not.

    NULL and empty texts have weight 1 and the odds of a text without evidence. Rows without a doc_id are sampled like others.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    weighed = weigh(docs, train_model(docs, labels, scratch))
    keyed = scratch.table(weighed.withColumn("key", F.col("per_feature") * TEMPERED + gumbel(F.col("draw"))).drop("per_feature"), "keyed")
    if keep is None:
        keep = keyed.filter("log_odds >= 0").count()
    least = kth_largest(keyed, "key", keep)
    return keyed.withColumn("kept", F.col("key") >= F.lit(least))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The sampled documents, with all their columns."""
    scratch = Scratch(docs.sparkSession, "good")
    kept = quality(docs, labels)
    dropped = scratch.table(kept.filter("not kept").select("draw").distinct(), "dropped")
    return matching(docs, F.xxhash64(F.col("doc_id").cast("bigint"), "text"), dropped, "left_anti")
