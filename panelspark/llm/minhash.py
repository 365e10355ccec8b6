"""SuperMinHash signatures, banding, verification on full sets, and grouping."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.common import Scratch, map_arrow, matching, runs, small_side, text_slices
from panelspark.llm.components import components
from panelspark.llm.shingles import mix, shingle_sets

SLOTS = 128
BANDS = 32
_ROWS = SLOTS // BANDS
# A pair of similarity 0.75 agrees in 96 of 128 slots on average with a standard deviation
# of at most 4.9; three in a million agree in fewer than this many.
MIN_AGREE = 74
# Members of a bucket that one group compares, and so the bound of its memory.
BLOCK = 1024
# Hosts, and guests, of a unit that compares full sets.
UNIT = 512
_U = np.uint64
_FRACTION_BITS = 25


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """The SuperMinHash signature of each set, as a row of ``slots`` 32-bit values.

    Every element walks its own random permutation of the slots. At rank ``j`` it offers
    its slot a value in ``[j, j + 1)``, so a slot taken at an earlier rank cannot improve
    and a set is finished at the first rank that leaves no slot empty.
    """
    m = len(sets)
    empty = np.uint32(0xFFFFFFFF)
    out = np.full(m * slots, empty, np.uint32)
    sizes = np.array([len(s) for s in sets])
    if not sizes.sum():
        return out.reshape(m, slots)
    state = mix(np.concatenate(sets) + _U(0x9E3779B97F4A7C15))
    owner = np.repeat(np.arange(m), sizes)
    order = None
    for rank in range(slots):
        draw = mix(state + _U((rank + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        at = rank + (((draw >> _U(32)) * _U(slots - rank)) >> _U(32)).astype(np.int64)
        value = np.uint32(rank << _FRACTION_BITS) | (draw & _U((1 << _FRACTION_BITS) - 1)).astype(np.uint32)
        if order is None:
            slot = at
        else:
            row = np.arange(len(at))
            slot = order[row, at].astype(np.int64)
            order[row, at] = order[:, rank]
        np.minimum.at(out, owner * slots + slot, value)
        unfinished = (out.reshape(m, slots) == empty).any(axis=1)
        keep = unfinished[owner]
        if not keep.any():
            break
        if order is None:
            state, owner, at = state[keep], owner[keep], at[keep]
            order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(state), 1))
            order[np.arange(len(at)), at] = 0
        elif keep.mean() < 0.7:
            state, owner, order = state[keep], owner[keep], order[keep]
    return out.reshape(m, slots)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per band and row of ``signature``; the band's number is part of the key."""
    rows = signature.astype(_U).reshape(len(signature), BANDS, _ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=_U) * _U(0xA0761D6478BD642F), rows.shape[:2]).copy()
    for i in range(_ROWS):
        keys = mix(keys ^ (rows[:, :, i] + _U(0x9E3779B97F4A7C15)))
    return keys.view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        sets = shingle_sets(batch.column("text").cast(pa.binary()).to_pylist())
        signature = signatures(sets)
        sums = [[int(mix(s ^ _U(k)).sum(dtype=_U)) for s in sets] for k in (0x1234567, 0xABCDEF0123)]
        keys = band_keys(signature)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(np.array(sums[0], _U).view(np.int64)),
                pa.array(np.array(sums[1], _U).view(np.int64)),
                pa.ListArray.from_arrays(np.arange(0, BANDS * len(sets) + 1, BANDS, dtype=np.int32), keys.ravel()),
                pa.array([row.tobytes() for row in (signature & 0xFFFF).astype(np.uint16)], pa.binary()),
            ],
            names=["doc_id", "n", "f1", "f2", "bands", "sig"],
        )


def sketches(docs: DataFrame) -> DataFrame:
    """Set size, 128-bit set fingerprint, band keys and 16-bit signature of every document."""
    schema = "doc_id bigint, n bigint, f1 bigint, f2 bigint, bands array<bigint>, sig binary"
    return map_arrow(docs.select(F.col("doc_id").cast("bigint"), "text"), _sketch, schema)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        sets = shingle_sets(batch.column("text").cast(pa.binary()).to_pylist())
        ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        values = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.ListArray.from_arrays(ends, values)], names=["doc_id", "shingles"]
        )


def shingle_table(docs: DataFrame) -> DataFrame:
    """The sorted shingle hashes of every document."""
    return map_arrow(docs.select(F.col("doc_id").cast("bigint"), "text"), _sets, "doc_id bigint, shingles array<bigint>")


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (
            np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, SLOTS) for c in ("sig_a", "sig_b")
        )
        keep = pa.array((a == b).sum(axis=1) >= MIN_AGREE)
        yield batch.select(["a", "b"]).filter(keep)


def screen(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose sizes allow the similarity and whose signatures agree well enough."""
    side = classes.select("rep", "n", "sig")
    a = side.withColumnsRenamed({"rep": "a", "n": "n_a", "sig": "sig_a"})
    b = side.withColumnsRenamed({"rep": "b", "n": "n_b", "sig": "sig_b"})
    fits = F.greatest("n_a", "n_b") * 75 <= F.least("n_a", "n_b") * 100
    both = pairs.join(a, "a").join(b, "b").filter(fits).select("a", "b", "sig_a", "sig_b")
    return map_arrow(both, _agreeing, "a bigint, b bigint")


def _sets_of(ids: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The full sets of the documents with the given ids, as a table."""
    ids = scratch.table(ids, "ids")
    wanted = docs.select(F.col("doc_id").cast("bigint"), "text").join(small_side(ids), "doc_id", "left_semi")
    return scratch.table(shingle_table(wanted), "sets")


def verify(pairs: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs of a table whose full sets have 100 * intersection >= 75 * union, as a table.

    ``b`` is a pair's home: a unit holds one home with at most ``UNIT`` of its ``a``. So the set of a hub
    is sent once per unit, not once per pair, however many near copies it has.
    """
    counts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / UNIT).cast("int").alias("blocks"))
    counts = scratch.table(counts, "homes")
    block = F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int")
    guests = pairs.join(counts, "b").select(F.col("b").alias("home"), block.alias("guest_block"), F.col("a").alias("rep"), F.lit(True).alias("is_guest"))
    hosts = counts.select(F.col("b").alias("home"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("guest_block"), F.col("b").alias("rep"), F.lit(False).alias("is_guest"))
    units = guests.union(hosts).select("home", F.lit(0).alias("host_block"), "guest_block", F.col("rep").alias("label"), "rep", "is_guest")
    return _linked(scratch.table(units, "units"), docs, scratch)


def _linked(units: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The links between the hosts and the guests of units ``home, host_block, guest_block, label, rep, is_guest``, as a table."""
    sets = _sets_of(units.select(F.col("rep").alias("doc_id")).distinct(), docs, scratch)
    key = ["home", "host_block", "guest_block"]
    rows = units.join(sets.withColumnRenamed("doc_id", "rep"), "rep").repartition(*key).sortWithinPartitions(*key)
    out = scratch.table(map_arrow(rows, _links_within, "a bigint, b bigint").distinct(), "links")
    scratch.drop(sets, units)
    return out


def _near_members(batches: Iterator[pa.RecordBatch], best_only: bool) -> Iterator[pa.RecordBatch]:
    """What guests of a unit may be similar to hosts of other groups, within runs of one (key, host_block, guest_block).

    Guests are the rows that came as such, and hosts whose own guest block it is.
    With ``best_only``, each guest with the partner whose signature agrees most; else the
    pairs of groups that have any such members.
    """
    for (_, _, guest_block), table in runs(batches, ["key", "host_block", "guest_block"]):
        rep, label, n, own = (table.column(c).to_numpy() for c in ("rep", "label", "n", "own_block"))
        visiting = np.asarray(table.column("visiting"))
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, SLOTS)
        hosts = np.flatnonzero(~visiting)
        found: list[tuple[int, int, int]] = []
        groups: set[tuple[int, int]] = set()
        for i in np.flatnonzero(visiting | (own == guest_block)).tolist():
            low, high = np.minimum(n[hosts], n[i]), np.maximum(n[hosts], n[i])
            others = hosts[(label[hosts] != label[i]) & (high * 75 <= low * 100)]
            agree = (sig[others] == sig[i]).sum(axis=1)
            near = agree >= MIN_AGREE
            if not near.any():
                continue
            if best_only:
                best = int(agree.argmax())
                found += [(int(rep[i]), int(rep[others[best]]), int(agree[best]))]
            else:
                groups.update((min(int(label[i]), x), max(int(label[i]), x)) for x in np.unique(label[others[near]]).tolist())
        found = found or [(a, b, 0) for a, b in groups]
        a, b, agree = zip(*found) if found else ((), (), ())
        columns_ = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(agree, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns_, names=["a", "b", "agree"])


def _near(named: DataFrame, classes: DataFrame, scratch: Scratch, best_only: bool) -> DataFrame:
    """Pairs of members of one bucket that do not yet share a group: each one's best partner (``b``), or their groups.

    ``named`` has the buckets' members with the label of their group. Buckets that hold one group only,
    as those of many copies of a text do, are left out. In the rest the members of the largest group need no comparing among themselves:
    the others are guests, and meet all members as hosts, by signature, block by block. So a large bucket is
    shared by many tasks, and one stray member costs it one pass.
    """
    mixed = (
        named.groupBy("key", "label")
        .agg(F.count(F.lit(1)).alias("c"))
        .groupBy("key")
        .agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("m"))
        .filter("m > top.c")
        .select(
            "key",
            F.col("top.label").alias("major"),
            F.ceil(F.col("m") / BLOCK).cast("int").alias("host_blocks"),
            F.ceil((F.col("m") - F.col("top.c")) / BLOCK).cast("int").alias("guest_blocks"),
        )
    )
    place = F.xxhash64("rep")
    placed = named.join(scratch.table(mixed, "mixed"), "key").withColumns(
        {
            "home": F.pmod(place, F.col("host_blocks")).cast("int"),
            "own_block": F.when(F.col("label") == F.col("major"), -1).otherwise(F.pmod(place, F.col("guest_blocks")).cast("int")),
        }
    )
    hosts = placed.withColumns({"host_block": F.col("home"), "guest_block": F.explode(F.sequence(F.lit(0), F.col("guest_blocks") - 1)), "visiting": F.lit(False)})
    # A guest is in the unit of its own host block already.
    guests = placed.filter("own_block >= 0 and host_blocks > 1")
    guests = guests.withColumns({"host_block": F.explode(F.sequence(F.lit(0), F.col("host_blocks") - 1)), "guest_block": F.col("own_block"), "visiting": F.lit(True)})
    columns = ["key", "host_block", "guest_block", "own_block", "visiting", "label", "rep"]
    both = hosts.select(*columns).union(guests.filter("host_block <> home").select(*columns))
    units = both.join(classes.select("rep", "n", "sig"), "rep")
    key = ["key", "host_block", "guest_block"]
    dealt = units.repartition(*key).sortWithinPartitions(*key)
    pairs = map_arrow(dealt, lambda it: _near_members(it, best_only), "a bigint, b bigint, agree int")
    if best_only:
        pairs = pairs.groupBy("a").agg(F.max_by("b", F.struct("agree", "b")).alias("b"))
    return scratch.table(pairs.select("a", "b").distinct(), "near")


def _links_within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links between hosts and guests of each unit, by their full sets."""
    for _, table in runs(batches, ["home", "host_block", "guest_block"]):
        rep, label, guest = (np.asarray(table.column(c)) for c in ("rep", "label", "is_guest"))
        sets = [x.values.to_numpy() for x in table.column("shingles")]
        sizes = np.array([len(s) for s in sets])
        hosts = np.flatnonzero(~guest)
        a, b = [], []
        if len(hosts):
            values = np.concatenate([sets[h] for h in hosts])
            order = np.argsort(values, kind="stable")
            owner = np.repeat(np.arange(len(hosts)), sizes[hosts])[order]
            values = values[order]
            for g in np.flatnonzero(guest).tolist():
                low, high = (np.searchsorted(values, sets[g], side) for side in ("left", "right"))
                spans = high - low
                at = np.repeat(high - np.cumsum(spans), spans) + np.arange(spans.sum())
                common = np.bincount(owner[at], minlength=len(hosts))
                linked = (common * 100 >= (sizes[hosts] + sizes[g] - common) * 75) & (label[hosts] != label[g])
                a += np.minimum(rep[hosts[linked]], rep[g]).tolist()
                b += np.maximum(rep[hosts[linked]], rep[g]).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _links_between(groups: DataFrame, members: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """All links between the members of pairs of groups, as a table.

    The larger group of a pair is the home of the other's members. Hosts and guests of a home are cut into blocks,
    and each pair of blocks is a unit of bounded size that compares full sets; only links leave it. So a
    set is sent once per unit, not once per pair.
    """
    sizes = scratch.table(members.groupBy("label").agg(F.count(F.lit(1)).alias("size")), "sizes")
    size_a, size_b = (sizes.withColumnsRenamed({"label": c, "size": f"size_{c}"}) for c in ("a", "b"))
    a_hosts = F.col("size_a") >= F.col("size_b")
    paired = groups.join(size_a, "a").join(size_b, "b").select(
        F.when(a_hosts, F.col("a")).otherwise(F.col("b")).alias("home"),
        F.when(a_hosts, F.col("b")).otherwise(F.col("a")).alias("label"),
        F.greatest("size_a", "size_b").alias("hosts"),
    )
    guests = scratch.table(paired.join(members, "label").select("home", "hosts", "label", "rep"), "guests")
    homes = guests.groupBy("home").agg(
        F.ceil(F.max("hosts") / UNIT).cast("int").alias("host_blocks"), F.ceil(F.count(F.lit(1)) / UNIT).cast("int").alias("guest_blocks")
    )
    homes = scratch.table(homes, "homes")

    def dealt(rows: DataFrame, own: str, other: str, is_guest: bool) -> DataFrame:
        block = F.pmod(F.xxhash64("rep"), F.col(f"{own}_blocks")).cast("int")
        rows = rows.withColumn(f"{own}_block", block)
        rows = rows.withColumn(f"{other}_block", F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)))
        return rows.select("home", "host_block", "guest_block", "label", "rep", F.lit(is_guest).alias("is_guest"))

    hosted = members.withColumn("home", F.col("label")).join(homes, "home")
    visiting = guests.drop("hosts").join(homes, "home")
    units = scratch.table(dealt(hosted, "host", "guest", False).union(dealt(visiting, "guest", "host", True)), "units")
    scratch.drop(guests)
    return _linked(units, docs, scratch)


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members with the label of their group; those without a link are groups of their own."""
    known = labels.withColumnsRenamed({"node": "rep", "label": "known"})
    return members.join(known, "rep", "left").withColumn("label", F.coalesce("known", "rep")).drop("known")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Group documents whose sets of five-word shingles have a Jaccard similarity of 0.75 or more.

    Returns ``doc_id, n_shingles, component_id, kept`` for every row of ``docs``:
    ``component_id`` is the smallest doc_id reachable over links, ``kept`` marks that one.

    1. Each text becomes a SuperMinHash signature and a fingerprint of its set. Equal sets
       collapse to a class, so copies cost one row however many they are.
    2. Classes meet in buckets of equal bands. Each class is tested against the hub of the
       bucket that it shares most bands with, which joins groups of near copies by
       as many tests as they have members.
    3. In buckets that still hold several groups, size and signature screen members of different
       groups in blocks. Each class is tested against its best partner; of the groups that then still may
       be linked, all members are compared in units of bounded size.
       No bucket, and no number of partners, is capped.
    4. Every link is confirmed on the full sets; large-star and small-star steps find the groups.

    A similarity of 0.75 shares no band with probability 5e-6. Texts that are NULL or
    have no words have no shingles, and link with nothing. Rows without a doc_id link
    with nothing either, have a NULL component and are kept. Repeated rows are
    one node; a doc_id with several texts is one node with several sets. Further
    columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "near-duplicates")
    sets = scratch.table(sketches(docs), "sketches")
    usable = sets.filter("doc_id is not null and n > 0")
    classes = scratch.table(
        usable.groupBy("f1", "f2", "n").agg(
            F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sig").alias("sig")
        ),
        "classes",
    )
    banded = classes.select(F.explode("bands").alias("key"), "rep")
    hubs = banded.groupBy("key").agg(
        F.count(F.lit(1)).alias("m"), F.min("rep").alias("h1"), F.min_by("rep", F.xxhash64("rep", "key")).alias("h2")
    )
    members = scratch.table(banded.join(hubs.filter("m > 1").drop("m"), "key"), "members")
    spokes = (
        members.select("rep", F.explode(F.array_distinct(F.array("h1", "h2"))).alias("hub"))
        .filter("rep <> hub")
        .groupBy("rep", "hub")
        .agg(F.count(F.lit(1)).alias("bands"))
        .groupBy("rep")
        .agg(F.max_by("hub", F.struct("bands", -F.col("hub"))).alias("hub"))
        .select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    )
    first = verify(scratch.table(screen(spokes, classes), "spokes"), docs, scratch)
    labels = components(first, scratch)
    buckets = members.select("key", "rep")
    second = verify(_near(_labelled(buckets, labels), classes, scratch, best_only=True), docs, scratch)
    links = first.unionByName(second)
    labels = components(links, scratch)
    groups = _near(_labelled(buckets, labels), classes, scratch, best_only=False)
    last = _links_between(groups, _labelled(buckets.select("rep").distinct(), labels), docs, scratch)
    labels = components(links.unionByName(last), scratch)
    scratch.drop(members)
    named = classes.select("f1", "f2", "n", "rep").join(
        labels.withColumnsRenamed({"node": "rep", "label": "known"}), "rep", "left"
    )
    named = named.select("f1", "f2", F.col("n").alias("_n"), F.coalesce("known", "rep").alias("component"))
    out = sets.select("doc_id", "n", "f1", "f2").join(
        named, (F.col("n") == F.col("_n")) & sets["f1"].eqNullSafe(named["f1"]) & sets["f2"].eqNullSafe(named["f2"]), "left"
    )
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The document of each group that ``near_duplicates`` keeps, with all its columns.

    Rows without a doc_id stay; of rows that repeat a kept doc_id one stays.
    """
    scratch = Scratch(docs.sparkSession, "kept")
    kept = near_duplicates(docs).filter("kept and doc_id is not null")
    kept = scratch.table(kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_times")), "kept")
    repeated = scratch.table(kept.filter("_times > 1").select("doc_id"), "repeated")
    once = matching(docs, F.col("doc_id"), kept.select("doc_id"), "left_semi")
    if repeated.limit(1).count():
        again = matching(once, F.col("doc_id"), repeated, "left_semi").dropDuplicates(["doc_id"])
        once = matching(once, F.col("doc_id"), repeated, "left_anti").unionByName(again)
    return once.unionByName(docs.filter("doc_id is null"))
