"""Quality rules as a ledger: every rule is evaluated once, policies and ablations read its bits."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import map_arrow, text_slices
from panelspark.llm.shingles import _PLACES, mix, span_hashes, word_spans

WINDOW = 3
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
_U = np.uint64
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NEWLINE = 0x0A


@dataclass(frozen=True)
class Rule:
    """A rule's bit in the ledger and the SQL condition on measurements under which a text fails it."""

    name: str
    bit: int
    fails: str


@dataclass(frozen=True)
class Policy:
    """A version of what counts: a text is dropped if it fails a fatal rule, or more than ``spare`` of the others.

    ``revised`` gives rules other conditions than the ledger's; these are read off the stored measurements.
    """

    name: str
    version: int
    fatal: tuple[str, ...]
    others: tuple[str, ...] = ()
    spare: int = 0
    revised: tuple[tuple[str, str], ...] = ()


# A rule keeps its bit for ever; a new condition is a new rule or a policy's revision.
RULES = (
    Rule("few_words", 0, "n_words < 50"),
    Rule("repeated_words", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("many_symbols", 2, "10 * n_symbols > n_words"),
    Rule("repeated_lines", 3, "100 * n_dup_lines > 40 * n_lines"),
    Rule("short_words", 4, "word_chars < 2 * n_words"),
    Rule("long_words", 5, "word_chars > 20 * n_words"),
)
BASE = ("few_words", "repeated_words")
POLICIES = {
    "base": Policy("base", 1, BASE),
    "prose": Policy("prose", 2, (*BASE, "many_symbols", "repeated_lines", "short_words", "long_words")),
}
_BIT = {r.name: r.bit for r in RULES}


def mask(names: tuple[str, ...]) -> int:
    """The bits of some rules."""
    return sum(1 << _BIT[n] for n in names)


def _per_text(owner: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(owner, weights=weights, minlength=n).astype(np.int64)


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    if not len(keys):
        return np.empty(0, bool)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.empty(len(keys), bool)
    out[order] = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    return out


def measure_texts(texts: list[bytes | None]) -> dict[str, np.ndarray]:
    """The measurements of many texts at once, over one buffer of all their bytes.

    Words, lines and windows are compared by 64-bit hashes, within a text only.
    """
    n = len(texts)
    texts = [t or b"" for t in texts]
    buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends_at = np.cumsum([len(t) + 1 for t in texts])  # a line break ends each text
    starts, ends = word_spans(buffer)
    owner = np.searchsorted(ends_at, starts, side="right")
    n_words = _per_text(owner, n)
    letters = np.concatenate(([0], np.cumsum((buffer & 0xC0) != 0x80)))  # bytes that start a code point
    symbols = np.concatenate(([0], np.cumsum(_SYMBOL[buffer])))
    begins = ends_at - np.array([len(t) + 1 for t in texts], np.int64)
    # Lines with a word: those in which a word starts.
    breaks = np.flatnonzero(buffer == _NEWLINE)
    line_of = np.searchsorted(breaks, starts)
    lines = np.unique(line_of)
    line_starts = np.concatenate(([0], breaks + 1))[lines]
    line_owner = np.searchsorted(ends_at, line_starts, side="right")
    line_keys = mix(span_hashes(buffer, line_starts, breaks[lines]) ^ mix(line_owner.astype(_U) + _U(1)))
    n_lines = _per_text(line_owner, n)
    distinct = _per_text(line_owner[np.unique(line_keys, return_index=True)[1]], n)
    # Words covered by a window that occurs twice or more in the text.
    words = span_hashes(buffer, starts, ends)
    covered = np.zeros(len(words), bool)
    if len(words) >= WINDOW:
        m = len(words) - WINDOW + 1
        rolled = mix(owner[:m].astype(_U) + _U(1))
        for i in range(WINDOW):
            rolled = rolled + words[i : i + m] * _PLACES[i]
        whole = np.flatnonzero(owner[:m] == owner[WINDOW - 1 :])
        found = whole[_repeats(mix(rolled[whole]))]
        for i in range(WINDOW):
            covered[found + i] = True
    return {
        "n_words": n_words,
        "word_chars": _per_text(owner, n, letters[ends] - letters[starts]),
        "n_symbols": symbols[ends_at] - symbols[begins] if n else n_words,
        "n_lines": n_lines,
        "n_dup_lines": n_lines - distinct,
        "n_repeat_words": _per_text(owner[covered], n),
    }


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        found = measure_texts(batch.column("text").cast(pa.binary()).to_pylist())
        columns = [batch.column("doc_id"), *(pa.array(found[m], pa.int64()) for m in MEASURES)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *MEASURES])


def failed_bits(rules: tuple[Rule, ...] = RULES) -> Column:
    """The bits of all rules that a row of measurements fails."""
    bits = F.lit(0).cast("bigint")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(0).cast("bigint"))
    return bits


def ledger(docs: DataFrame) -> DataFrame:
    """``doc_id``, the measurements and ``failed``, the bits of the failed rules, of every row.

    Words are runs of characters other than U+0020 and U+0009 to U+000D; nothing is
    lower-cased. A NULL text counts as an empty one, which has no words and fails ``few_words``
    alone. Texts are read once and whole, whatever their length. Repeated rows are rows of their own, doc_id may be NULL, further
    columns are left out; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = ", ".join(["doc_id bigint", *(f"{m} bigint" for m in MEASURES)])
    return map_arrow(rows, _measure, schema).withColumn("failed", failed_bits())


def _bits_under(policy: Policy, bits: str) -> Column:
    """The ledger's bits with those of the policy's revised rules put anew."""
    column = F.col(bits)
    for name, fails in policy.revised:
        bit = 1 << _BIT[name]
        column = column.bitwiseAND(F.lit(~bit)).bitwiseOR(F.when(F.expr(fails), F.lit(bit)).otherwise(0).cast("bigint"))
    return column


def passes(policy: Policy, bits: Column) -> Column:
    """Whether bits pass a policy."""
    fatal = bits.bitwiseAND(F.lit(mask(policy.fatal))) != 0
    spent = F.bit_count(bits.bitwiseAND(F.lit(mask(policy.others)))) > policy.spare
    return ~(fatal | spent)


def apply_policy(rows: DataFrame, policy: Policy) -> DataFrame:
    """A ledger with ``kept`` and the ``policy`` that decided it; no text is read again."""
    named = rows.withColumn("_bits", _bits_under(policy, "failed"))
    return named.withColumns({"kept": passes(policy, F.col("_bits")), "policy": F.lit(f"{policy.name}-{policy.version}")}).drop("_bits")


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """What each rule of a policy does to a ledger: a row per rule.

    ``rule, bit, failed`` (rows that fail it), ``decisive`` (rows that the policy drops and would keep
    without the rule), ``decisive_words`` (their words), ``kept_without`` (rows kept without the rule), ``always_with`` (the bits of the
    policy that every row failing the rule fails), ``never_with`` (those that none of them fails).
    An empty ledger gives zeros, with all bits in both.

    Rows are summed up by their bits first, so what is shuffled is a row per task and combination of bits;
    every figure then comes from these rows by bitwise aggregates.
    """
    names = (*policy.fatal, *policy.others)
    every = mask(names)
    bits = _bits_under(policy, "failed").bitwiseAND(F.lit(every))
    groups = rows.select(bits.alias("bits"), "n_words").groupBy("bits").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("w"))
    kept = passes(policy, F.col("bits"))
    zero = F.lit(0).cast("bigint")
    figures = []
    for name in names:
        bit = 1 << _BIT[name]
        without = passes(policy, F.col("bits").bitwiseAND(F.lit(~bit)))
        fails = F.col("bits").bitwiseAND(F.lit(bit)) != 0
        total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), zero)
        figures.append(
            F.struct(
                F.lit(name).alias("rule"),
                F.lit(_BIT[name]).alias("bit"),
                total("n", fails).alias("failed"),
                total("n", without & ~kept).alias("decisive"),
                total("w", without & ~kept).alias("decisive_words"),
                total("n", without).alias("kept_without"),
                F.coalesce(F.bit_and(F.when(fails, F.col("bits"))), F.lit(every)).cast("bigint").alias("always_with"),
                F.coalesce(F.lit(every).cast("bigint").bitwiseAND(F.bitwise_not(F.bit_or(F.when(fails, F.col("bits"))))), F.lit(every)).cast("bigint").alias("never_with"),
            )
        )
    return groups.agg(F.array(*figures).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")


def judged(docs: DataFrame, policy: Policy = POLICIES["prose"]) -> DataFrame:
    """The ledger with ``base_failed`` (a rule of the base failed), ``kept`` and ``policy`` of every row."""
    rows = ledger(docs)
    base = F.col("failed").bitwiseAND(F.lit(mask(BASE))) != 0
    decided = apply_policy(rows, policy).withColumn("base_failed", base)
    return decided.withColumn("kept", F.col("kept") & ~F.col("base_failed"))
