"""Toxicity from class-conditional Kneser-Ney models over words and word pairs."""

import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import Scratch, map_arrow, runs, shuffles_freed, small_side, text_slices
from panelspark.llm.language import START, TokenHashes, contexts, fit_logistic, logits, pair_hashes, word_hashes

FOLDS = 5
# Labelled documents, at most, that the score is calibrated on; the models are counted on all.
CALIBRATED = 5_000
# Absolute discount of a count.
DISCOUNT = 2.0
# Ratios nearer than this to what the backoff gives are left to the backoff.
TELLING = 0.1
# Entries of the model up to which tasks hold it, some 24 bytes each; a larger one is files that tasks map.
HELD = 1_500_000
# Entries, about, of such a file; a task that writes one holds them.
PIECE = 1 << 20
# Lengths of the passages whose log-likelihood ratio per word is compared; the whole text is another.
PASSAGES = (1, 3, 10)
FEATURES = 1 + 2 * len(PASSAGES)
_ENTRY = "h bigint, pair boolean, r double, g double"
_U = np.uint64


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


class Places:
    """Where hashes stand among sorted ones, looked for among those of the same leading bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(len(keys), 1).bit_length()
        self.shift = _U(64 - bits)
        counts = np.bincount((keys >> self.shift).astype(np.int64), minlength=1 << bits)
        self.first = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each, -1 where there is none."""
        slots = (wanted >> self.shift).astype(np.int64)
        at, stop = self.first[slots], self.first[slots + 1]
        found = np.full(len(wanted), -1, np.int64)
        left = np.flatnonzero(at < stop)
        at, stop = at[left], stop[left]
        while len(left):
            same = self.keys[at] == wanted[left]
            found[left[same]] = at[same]
            on = ~same & (at + 1 < stop)
            left, at, stop = left[on], at[on] + 1, stop[on]
        return found


@dataclass
class Model:
    """Log-likelihood ratios less that of an unseen word, by hash, sorted; and the fit of the score.

    A pair that is not among ``pairs`` has its second word's ratio plus the ratio of the weights with
    which the first word backs off.
    """

    words: np.ndarray
    word_ratios: np.ndarray
    backoffs: np.ndarray
    pairs: np.ndarray
    pair_ratios: np.ndarray
    fit: tuple | None = None

    @cached_property
    def _places(self) -> tuple[Places, Places]:
        return Places(self.words), Places(self.pairs)

    def __getstate__(self) -> dict:
        """Without the places, which each worker finds by itself."""
        return {k: v for k, v in self.__dict__.items() if k != "_places"}

    def features(self, tokens: np.ndarray) -> list[float]:
        """Per word: the ratio over the whole text, and the highest one of any passage of each length, by words and by pairs."""
        return self.features_of(tokens, np.array([len(tokens)]))[0].tolist()

    def features_of(self, tokens: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The features of many texts, whose tokens follow each other and end at ``ends``."""
        words, pairs = self._places
        at, start = words(tokens), words(np.array([START]))[0]
        single = _values(self.word_ratios, at, 0.0)
        backed = single + _values(self.backoffs, contexts(at, ends, start), 0.0)
        both = _values(self.pair_ratios, pairs(pair_hashes(contexts(tokens, ends), tokens)), backed)
        out = np.zeros((len(ends), FEATURES))
        for i, (start, end) in enumerate(zip([0, *ends.tolist()], ends.tolist())):
            if end > start:
                out[i] = [both[start:end].mean(), *_peaks(single[start:end]), *_peaks(both[start:end])]
        return out


def _peaks(ratios: np.ndarray) -> list[float]:
    """The highest mean of any passage of each length."""
    sums = np.concatenate(([0.0], np.cumsum(ratios)))
    return [(sums[n:] - sums[:-n]).max() / n for n in (min(p, len(ratios)) for p in PASSAGES)]


def _values(values: np.ndarray, at: np.ndarray, other: np.ndarray | float) -> np.ndarray:
    return np.where(at >= 0, values[at], other) if len(values) else np.broadcast_to(other, at.shape)


@dataclass
class Pieces:
    """Entries that no task holds, as files of the shared folder: a file for each value of the hashes' leading bits.

    Tasks map the files, so that memory holds what is read of them, once for all tasks of a machine.
    """

    folder: str
    bits: int
    written: set[int]

    @cached_property
    def _mapped(self) -> dict[int, list[tuple[np.ndarray, ...]]]:
        return {}

    def __getstate__(self) -> dict:
        """Without the mapped files, which each worker maps by itself."""
        return {k: v for k, v in self.__dict__.items() if k != "_mapped"}

    def _piece(self, number: int) -> list[tuple[np.ndarray, ...]]:
        """The words and the pairs of a piece: their hashes, sorted, and values."""
        if number not in self._mapped:
            file = pa.ipc.open_file(pa.memory_map(f"{self.folder}/{number}"))
            self._mapped[number] = [tuple(c.to_numpy() for c in file.get_batch(i).columns) for i in range(file.num_record_batches)]
        return self._mapped[number]

    def found(self, wanted: np.ndarray, pair: bool) -> list[np.ndarray]:
        """The hashes and values of the entries of these hashes, sorted ones; what has no entry is left out."""
        numbers = (wanted >> _U(64 - self.bits)).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(wanted)]
        found = [(wanted[:0], np.empty(0), np.empty(0))]
        for start, stop in zip(cuts, cuts[1:]):
            if start < stop and (number := int(numbers[start])) in self.written:
                h, r, g = self._piece(number)[pair]
                at = np.searchsorted(h, wanted[start:stop])
                at = at[at < len(h)]
                at = at[h[at] == wanted[start : start + len(at)]]
                found.append((h[at], r[at], g[at]))
        return list(map(np.concatenate, zip(*found)))

    def features_of(self, tokens: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The features of many texts, under the part of the model that they ask for."""
        words = self.found(np.unique(np.append(tokens, START)), False)
        pairs, ratios, _ = self.found(np.unique(pair_hashes(contexts(tokens, ends), tokens)), True)
        return Model(*words, pairs, ratios).features_of(tokens, ends)


@dataclass
class Trained:
    """A model that tasks hold or map, or the table ``h, pair, r, g`` of one where they can do neither; and the fit."""

    model: Model | Pieces | None
    table: DataFrame
    fit: tuple | None = None


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct word pairs of each document, with its class."""
    for batch in text_slices(batches):
        tokens, ends = word_hashes(batch.column("text").to_pylist())
        before = contexts(tokens, ends)
        hashes, starts = pair_hashes(before, tokens), [0, *ends.tolist()]
        firsts = [np.unique(hashes[a:b], return_index=True)[1] + a for a, b in zip(starts, starts[1:])]
        classes = np.repeat(np.array(batch.column("toxic").to_pylist(), np.int8), list(map(len, firsts)))
        first = np.concatenate(firsts)
        columns = [before[first].view(np.int64), tokens[first].view(np.int64), classes]
        yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["v", "w", "toxic"])


def labelled(docs: DataFrame, labels: DataFrame, folds: list[int], bound: int | None, scratch: Scratch, name: str) -> DataFrame:
    """``doc_id, text, toxic`` of the labelled documents of some folds, or of at most ``bound``, those of the smallest hashes."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & fold(F.col("doc_id")).isin(folds))
    usable = usable.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    present = usable.join(docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct(), "doc_id", "left_semi")
    some = present if bound is None else present.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    chosen = scratch.table(some, name)
    texts, side = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), small_side(chosen)
    if side is chosen:  # a join would shuffle the texts of all documents
        entries = chosen.select(_id_key().alias("h"), F.lit(False).alias("pair"), F.col("toxic").cast("double").alias("r"), F.lit(0.0).alias("g"))
        classes = _in_pieces(entries, entries.count(), scratch, f"{name}-classes")
        if classes is not None:
            keyed = texts.filter("doc_id is not null").withColumn("h", _id_key())
            return map_arrow(keyed, _with_classes(classes), "doc_id bigint, text string, toxic int")
    return texts.join(side, "doc_id")


def _id_key() -> Column:
    """Another number for each doc_id, with all leading bits; no two have the same."""
    return F.xxhash64("doc_id")


def _with_classes(classes: "Pieces") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The documents that have a class, with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy().view(_U)
            known, values, _ = classes.found(np.unique(h), False)
            rows = np.flatnonzero(np.isin(h, known))
            kept = batch.take(pa.array(rows))
            toxic = values[np.searchsorted(known, h[rows])].astype(np.int32)
            yield pa.RecordBatch.from_arrays([kept.column("doc_id"), kept.column("text"), pa.array(toxic)], names=["doc_id", "text", "toxic"])

    return run


def _discount(count: Column | str) -> Column:
    """What a count gives up to the backoff."""
    return F.least(F.col(count) if isinstance(count, str) else count, F.lit(DISCOUNT))


def count_model(train: DataFrame, scratch: Scratch) -> DataFrame:
    """Two Kneser-Ney models of order two, as a table ``h, pair, r, g`` of the ratios of their probabilities.

    A word's probability comes from the number of different words it follows, not from how
    often it occurs, so copies of a text add nothing. The class's discounted count backs off to the
    distribution of both classes together; a pair backs off to the pair's shared count,
    and that to the class's word. ``r`` is the logarithm of a word's or pair's ratio less that of an unseen word, ``g`` that of the weights
    with which the pairs that a word begins back off. What differs by less than ``TELLING`` from what
    is looked up otherwise is left out, whatever the size of the table.
    """
    pairs = map_arrow(train.select("text", "toxic"), _pairs, "v bigint, w bigint, toxic tinyint")
    ones = [F.count_if(F.col("toxic") == c).alias(f"n{c}") for c in (0, 1)]
    pairs = scratch.table(pairs.groupBy("v", "w").agg(*ones), "pairs")
    following = [F.count_if(F.col(f"n{c}") > 0).alias(f"k{c}") for c in (0, 1)]
    words = scratch.table(pairs.groupBy("w").agg(F.count(F.lit(1)).alias("k"), *following), "words")
    total = words.agg(F.count(F.lit(1)), *[x for k in ("k", "k0", "k1") for x in (F.sum(k), F.sum(_discount(k)))]).first()
    types, (all_pairs, all_off), *by_class = total[0], total[1:3], total[3:5], total[5:7]
    if not all_pairs or not by_class[0][0] or not by_class[1][0]:  # nothing to compare
        return scratch.table(train.sparkSession.createDataFrame([], _ENTRY), "ratios")

    def word_probability(c: int) -> Column:
        pairs_c, off_c = by_class[c]
        shared = (F.col("k") - _discount("k")) / all_pairs + all_off / all_pairs / (types + 1)
        return (F.col(f"k{c}") - _discount(f"k{c}")) / pairs_c + off_c / pairs_c * shared

    # An unseen word's probabilities are the backoff's alone.
    unseen = float(np.log(by_class[1][1] / by_class[1][0]) - np.log(by_class[0][1] / by_class[0][0]))
    scored = words.select("w", word_probability(0).alias("p0"), word_probability(1).alias("p1"))
    scored = scored.withColumn("r", F.ln(F.col("p1") / F.col("p0")) - unseen)
    sums = [x for c in (0, 1) for x in (F.sum(f"n{c}").alias(f"sum{c}"), F.sum(_discount(f"n{c}")).alias(f"off{c}"))]
    n = F.col("n0") + F.col("n1")
    before = pairs.groupBy("v").agg(F.sum(n).alias("sum"), F.sum(_discount(n)).alias("off"), *sums)
    weight = [F.when(F.col(f"sum{c}") > 0, F.col(f"off{c}") / F.col(f"sum{c}")).otherwise(1.0) for c in (0, 1)]
    before = before.withColumns({"u0": weight[0], "u1": weight[1], "g": F.ln(weight[1] / weight[0])})
    # Of a pair that the discount takes whole, in both classes together, the backoff is all that is left.
    told = pairs.filter(n > DISCOUNT).join(before, "v").join(scored, "w")

    def pair_probability(c: int) -> Column:
        shared = (n - _discount(n)) / F.col("sum") + F.col("off") / F.col("sum") * F.col(f"p{c}")
        own = F.when(F.col(f"sum{c}") > 0, (F.col(f"n{c}") - _discount(f"n{c}")) / F.col(f"sum{c}")).otherwise(0.0)
        return own + F.col(f"u{c}") * shared

    whole = told.withColumn("ratio", F.ln(pair_probability(1) / pair_probability(0)) - unseen)
    telling = whole.filter(F.abs(F.col("ratio") - F.col("r") - F.col("g")) >= TELLING)
    single = scored.select(F.col("w").alias("h"), "r").join(before.select(F.col("v").alias("h"), "g"), "h", "full")
    single = single.select("h", F.lit(False).alias("pair"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("r", "g")])
    single = single.filter(F.greatest(F.abs("r"), F.abs("g")) >= TELLING)
    rows = telling.select("v", "w", F.lit(True).alias("pair"), F.col("ratio").alias("r"), F.lit(0.0).alias("g"))
    ratios = scratch.table(single.unionAll(map_arrow(rows, _with_pair_keys, _ENTRY)), "ratios")
    scratch.drop(pairs, words)
    return ratios


def _with_pair_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v, w = (batch.column(c).to_numpy().view(_U) for c in ("v", "w"))
        columns = [pa.array(pair_hashes(v, w).view(np.int64)), *map(batch.column, ("pair", "r", "g"))]
        yield pa.RecordBatch.from_arrays(columns, names=["h", "pair", "r", "g"])


def _held(rows: pa.Table) -> Model:
    """The model of rows ``h, pair, r, g``."""
    return _model(*(rows.column(c).to_numpy() for c in ("h", "pair", "r", "g")))


def _model(h: np.ndarray, pair: np.ndarray, r: np.ndarray, g: np.ndarray) -> Model:
    h, pair = h.astype(np.int64).view(_U), pair.astype(bool)
    order = np.argsort(h)
    h, pair, r, g = h[order], pair[order], r[order], g[order]
    return Model(h[~pair], r[~pair], g[~pair], h[pair], r[pair])


def _piece_writer(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes the rows of each piece as a file, which gets its name when it is whole."""
    schema = pa.schema({"h": pa.uint64(), "r": pa.float64(), "g": pa.float64()})

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for (number,), rows in runs(batches, ["piece"]):
            model, draft = _held(rows), f"{folder}/.{uuid.uuid4().hex}"
            words, pairs = (model.words, model.word_ratios, model.backoffs), (model.pairs, model.pair_ratios, np.zeros(len(model.pairs)))
            with pa.OSFile(draft, "wb") as file, pa.ipc.new_file(file, schema) as out:
                for columns in (words, pairs):
                    out.write_batch(pa.RecordBatch.from_arrays(list(map(pa.array, columns)), schema=schema))
            os.replace(draft, f"{folder}/{number}")
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64())], names=["piece"])

    return write


def _in_pieces(table: DataFrame, entries: int, scratch: Scratch, name: str) -> Pieces | None:
    """A table ``h, pair, r, g`` as files that tasks map, if the shared folder is in the machines' own file system."""
    folder = scratch.local_path(name)
    if folder is None:
        return None
    bits = max(1, (entries // PIECE).bit_length())
    numbered = table.withColumn("piece", F.shiftrightunsigned("h", 64 - bits))
    dealt = numbered.repartition(1 << bits, "piece").sortWithinPartitions("piece")
    written = scratch.table(map_arrow(dealt, _piece_writer(folder), "piece bigint"), f"{name}-pieces")
    return Pieces(folder, bits, {row.piece for row in written.collect()})


def _features(texts: pa.Array, model: Model | Pieces) -> np.ndarray:
    return model.features_of(*word_hashes(texts.to_pylist()))


def _probability(x: np.ndarray, fit: tuple) -> np.ndarray:
    return 1 / (1 + np.exp(-logits(x, fit)))


def _keep(batch: pa.RecordBatch, names: list[str], x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(x.tolist(), pa.list_(pa.float64()))], names=[*names, "x"])


# A text's own key: 128 bits of it.
_TEXT_KEY = ("t1", "t2")


def _text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words and pairs of each text, by its key."""
    for batch in text_slices(batches):
        tokens, ends = word_hashes(batch.column("text").to_pylist())
        before = contexts(tokens, ends)
        kinds, starts = (tokens, before, pair_hashes(before, tokens)), [0, *ends.tolist()]
        found = [np.unique(np.concatenate([k[a:b] for k in kinds])) for a, b in zip(starts, starts[1:])]
        sizes = [len(f) for f in found]
        keys = [pa.array(np.repeat(batch.column(c).to_numpy(), sizes)) for c in _TEXT_KEY]
        yield pa.RecordBatch.from_arrays([*keys, pa.array(np.concatenate(found).view(np.int64))], names=[*_TEXT_KEY, "h"])


def _found_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = TokenHashes(words_only=True)
    for batch in text_slices(batches):
        x, entries = [], batch.column("entries")
        columns = [c.to_numpy(zero_copy_only=False) for c in entries.flatten().flatten()]
        ends = np.cumsum([0, *(n or 0 for n in pc.list_value_length(entries).to_pylist())]).tolist()
        for text, start, end in zip(batch.column("text").to_pylist(), ends, ends[1:]):
            x.append(_model(*(c[start:end] for c in columns)).features(hashes(text)))
        yield _keep(batch, list(_TEXT_KEY), np.array(x, float).reshape(len(x), FEATURES))


def _joined_features(docs: DataFrame, table: DataFrame) -> DataFrame:
    """``t1, t2, x``: the features of each different text, whose words and pairs are joined to a table that no task could hold.

    What meets in one task is one text's words; copies of a text count as one, and are dropped before their words are rows.
    """
    keyed = docs.select(*_text_key(F.col("text")), "text")
    once = keyed.groupBy(*_TEXT_KEY).agg(F.first("text").alias("text"))
    wanted = map_arrow(once, _wanted, "t1 bigint, t2 bigint, h bigint")
    entries = F.collect_list(F.struct("h", "pair", "r", "g")).alias("entries")
    found = wanted.join(table, "h").groupBy(*_TEXT_KEY).agg(entries)
    return map_arrow(once.join(found, list(_TEXT_KEY), "left"), _found_features, "t1 bigint, t2 bigint, x array<double>")


def train_model(docs: DataFrame, labels: DataFrame) -> Trained:
    """The models of both classes, from folds 1 to 3 of the labels, and the score's fit, from fold 4.

    Fold 0 is never read. The score is a logistic regression of the log-likelihood ratio per word over
    the whole text and over the passages in which it is highest. Labels other than 0 and 1 and rows
    without a document are left out. With one class alone, or none, every text scores the
    smoothed share of toxic labels in fold 4, 0.05 without any.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    with shuffles_freed(spark):
        table = count_model(labelled(docs, labels, [1, 2, 3], None, scratch, "counted"), scratch)
        entries = table.count()
        trained = Trained(_held(table.toArrow()) if entries <= HELD else _in_pieces(table, entries, scratch, "model"), table)
    sample = labelled(docs, labels, [4], CALIBRATED, scratch, "calibrated").select("text", F.col("toxic").cast("int").alias("toxic"))
    if trained.model is not None:
        held = spark.sparkContext.broadcast(trained.model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in text_slices(batches):
                yield _keep(batch, ["toxic"], _features(batch.column("text"), held.value))

        featured = map_arrow(sample, run, "toxic int, x array<double>")
    else:
        sample = scratch.table(sample, "sample")
        keyed = sample.select(*_text_key(F.col("text")), "toxic")
        featured = keyed.join(_joined_features(sample, table), list(_TEXT_KEY)).select("toxic", "x")
    rows = featured.toArrow()  # at most CALIBRATED rows of a few numbers
    if trained.model is not None:
        held.unpersist(blocking=True)
    x = np.array(rows.column("x").to_pylist(), float).reshape(rows.num_rows, FEATURES)
    y = rows.column("toxic").to_numpy().astype(float)
    if 0 < y.sum() < len(y):
        trained.fit = fit_logistic(x, y)
    else:
        share = (y.sum() + 0.05) / (len(y) + 1)
        trained.fit = (np.zeros(x.shape[1]), np.ones(x.shape[1]), np.array([0.0] * x.shape[1] + [np.log(share / (1 - share))]))
    return trained


def _text_scores(docs: DataFrame, trained: Trained) -> DataFrame:
    """``t1, t2, score`` of each different text under a model that tasks neither hold nor map."""
    fit = trained.fit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(batch.num_rows, FEATURES)
            columns = [*map(batch.column, _TEXT_KEY), pa.array(_probability(x, fit))]
            yield pa.RecordBatch.from_arrays(columns, names=[*_TEXT_KEY, "score"])

    return map_arrow(_joined_features(docs, trained.table), run, "t1 bigint, t2 bigint, score double")


def _with_scores(batches: Iterator[pa.RecordBatch], held, fit: tuple) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with the score of each row's text."""
    for batch in text_slices(batches):
        yield batch, _probability(_features(batch.column("text"), held.value), fit)


def score(docs: DataFrame, trained: Trained) -> DataFrame:
    """``doc_id, score`` of every row: how likely its whole text is toxic, from 0 to 1.

    Only the text is looked at. NULL, empty and wordless texts get the score of a text without any evidence.
    Repeated rows score alike; further columns are left out.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    if trained.model is None:
        return rows.select("doc_id", *_text_key(F.col("text"))).join(_text_scores(rows, trained), list(_TEXT_KEY)).select("doc_id", "score")
    held, fit = docs.sparkSession.sparkContext.broadcast(trained.model), trained.fit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, scores in _with_scores(batches, held, fit):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    return map_arrow(rows, run, "doc_id bigint, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted``: held_out marks the documents whose labels the models never see."""
    scored = score(docs, train_model(docs, labels))
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents predicted to be ordinary, with all their columns."""
    trained = train_model(docs, labels)
    if trained.model is None:
        toxic = _text_scores(docs, trained).filter("score >= 0.5")
        keys = {c: F.col(c) for c in _TEXT_KEY}
        names = {c: c + "_" * (1 + max([len(x) for x in docs.columns], default=0)) for c in keys}  # that docs does not have
        marked = toxic.select(*[keys[c].alias(names[c]) for c in keys])
        same = [key == F.col(names[c]) for c, key in zip(keys, [F.xxhash64(docs["text"]), F.xxhash64(F.lit(1), docs["text"])])]
        return docs.join(marked, same[0] & same[1], "left_anti")
    held, fit = docs.sparkSession.sparkContext.broadcast(trained.model), trained.fit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, scores in _with_scores(batches, held, fit):
            yield batch.filter(pa.array(scores < 0.5))

    return map_arrow(docs, run, docs.schema)
