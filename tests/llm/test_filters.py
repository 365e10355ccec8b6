"""Near duplicates, decontamination, toxicity, quality and the pipeline against brute force."""

import os
import random
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from panelspark.llm import common, decontaminate, language, minhash, quality, registry, toxicity
from panelspark.llm.components import components
from panelspark.llm.common import Scratch
from panelspark.llm.shingles import shingle_sets

FOLDER = "/root/testdata/sf0.001"
# Names that the operators use inside.
CLASHES = ["_key", "rep", "label", "n", "score", "ids", "draw", "key", "x", "shard", "component_id", "toxic"]


def words(rnd, n):
    return [rnd.choice("abcdefghijklmnopqrstuvwxyz") + str(rnd.randrange(400)) for _ in range(n)]


def odd_documents(spark, rows):
    """(doc_id, text) as documents with columns of clashing names."""
    full = [(i, t, "en", "s", None if t is None else len(t), *["c"] * len(CLASHES)) for i, t in rows]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    return spark.createDataFrame(full, schema + ", ".join(f"{c} string" for c in CLASHES))


def shingled(text):
    found = (text or "").encode().lower().split()
    if len(found) < 5:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + 5]) for i in range(len(found) - 4)}


def brute_components(rows):
    sets = [shingled(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None:
                continue
            common = len(sets[i] & sets[j])
            linked = common and 100 * common >= 75 * len(sets[i] | sets[j])
            if linked or rows[i][0] == rows[j][0] and sets[i] and sets[j]:
                parent[find(i)] = find(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc)
    return sorted(
        ((doc, len(sets[i]), min(d for d in groups[find(i)]) if doc is not None else None) for i, (doc, _) in enumerate(rows)),
        key=repr,
    )


@pytest.fixture(scope="module")
def duplicates():
    rnd = random.Random(5)
    rows, doc = [(None, "no id here at all"), (3, None), (4, ""), (5, " \t\n"), (6, "two words"), (7, "TWO  words"), (8, "two wördS")], 10
    base = words(rnd, 120)
    for edits in [0, 0, 0, *[rnd.randrange(0, 9) for _ in range(60)]]:  # a chain of near copies of all degrees
        text = list(base)
        for _ in range(edits):
            text[rnd.randrange(len(text))] = "edit" + str(rnd.randrange(10**6))
        rows.append((doc, " ".join(text)))
        doc += 1
    shared = words(rnd, 60)
    for _ in range(40):  # one passage in unlike documents
        rows.append((doc, " ".join(words(rnd, rnd.randrange(20, 90)) + shared)))
        doc += 1
    rows.append((doc, " ".join(words(rnd, 60_000))))
    rows.append((doc, rows[-1][1]))  # a repeated row
    return rows


def test_groups_equal_brute_force(spark, duplicates):
    out = minhash.near_duplicates(odd_documents(spark, duplicates)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=repr) == brute_components(duplicates)
    assert all(r.kept == (r.doc_id == r.component_id or r.doc_id is None) for r in out)


def test_one_document_of_each_group_stays(spark, duplicates):
    docs = odd_documents(spark, duplicates)
    out = minhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    want = sorted({g for d, _, g in brute_components(duplicates) if d is not None})
    got = [r.doc_id for r in out.collect()]
    assert sorted(d for d in got if d is not None) == want and got.count(None) == 1


def test_small_blocks_lose_no_link(spark, duplicates, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 7)
    monkeypatch.setattr(minhash, "UNIT", 5)
    out = minhash.near_duplicates(odd_documents(spark, duplicates)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=repr) == brute_components(duplicates)


def test_no_documents(spark):
    empty = odd_documents(spark, [(1, "x")]).limit(0)
    assert minhash.near_duplicates(empty).count() == 0


def test_signatures_estimate_similarity():
    rnd = np.random.default_rng(1)
    errors = []
    for share in (0.1, 0.5, 0.75, 0.95):
        common = rnd.integers(0, 1 << 63, int(400 * share), dtype=np.uint64)
        a, b = (np.concatenate((common, rnd.integers(0, 1 << 63, 400 - len(common), dtype=np.uint64))) for _ in "ab")
        x, y = minhash.signatures([a, b])
        errors.append(abs((x == y).mean() - len(common) / (800 - len(common))))
    assert max(errors) < 0.13
    one = np.array([5], np.uint64)
    assert (np.sort(minhash.signatures([one])[0] >> 25) == np.arange(128)).all()  # one element fills every rank once


def test_shingle_sets_follow_the_words():
    texts = ["A b c d e f", "a  B\tc\nd e f", "a b c d", "A B C D", "é b c d e", "É b c d e", "", " ", "a b c d e f a b c d e f"]
    sets = [s.tolist() for s in shingle_sets([t.encode() for t in texts])]
    assert [len(s) for s in sets] == [len(shingled(t)) for t in texts]
    assert sets[0] == sets[1] and sets[2] == sets[3] and sets[4] != sets[5]
    assert [s.tolist() for s in shingle_sets([None])] == [[]]


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 103), (103, 100), (101, 103)], "a bigint, b bigint")
    got = {(r.node, r.label) for r in components(links, Scratch(spark, "test")).collect()}
    assert got == {(i, 0) for i in range(61)} | {(100, 100), (101, 100), (103, 100)}


def brute_containment(docs, items):
    out = set()
    for d, t in docs:
        for i, u in items:
            have, want = shingled(t), shingled(u)
            if d is not None and i is not None and want and 100 * len(have & want) >= 75 * len(want):
                out.add((d, i, len(want), len(have & want)))
    return out


def test_items_in_documents_equal_brute_force(spark):
    rnd = random.Random(6)
    items = [(k, " ".join(words(rnd, n))) for k, n in enumerate([5, 6, 7, 9, 14, 30, 64, 65, 200])]
    items += [(50, None), (51, ""), (52, "only four words here"), (None, "a b c d e f"), (0, items[0][1])]
    docs = [(1, None), (2, ""), (3, "ONLY four words  here"), (4, "so only four words here"), (None, items[4][1])]
    for k, (_, text) in enumerate(items[:9]):
        for j, cut in enumerate((0, 1, 2, 0.2, 0.24, 0.3)):
            some = text.split()
            some = some[int(cut * len(some)) if isinstance(cut, float) else cut :]
            docs.append((100 + 10 * k + j, " ".join(words(rnd, rnd.randrange(2000)) + some + words(rnd, 50))))
    docs.append((900, " ".join(t or "" for _, t in items)))
    table = spark.createDataFrame([(*i, "z") for i in items], "item_id bigint, text string, partition string")
    got = decontaminate.contaminated(odd_documents(spark, docs), table)
    assert {(r.doc_id, r.item_id, r.n_item_shingles, r.n_contained) for r in got.collect()} == brute_containment(docs, items)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
    clean = decontaminate.drop_contaminated(odd_documents(spark, docs), table)
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, *_ in brute_containment(docs, items)}
    assert decontaminate.contaminated(odd_documents(spark, docs).limit(0), table).count() == 0


@pytest.fixture(scope="module")
def corpus(spark):
    """Documents of which some are toxic and some are junk, their labels, and both by doc_id."""
    rnd = random.Random(7)
    rows, labels, toxic, junk = [], [], set(), set()
    for d in range(1500):
        text = words(rnd, rnd.randrange(30, 200))
        if d % 7 == 0:
            toxic.add(d)
            for _ in range(rnd.randrange(1, 4)):
                text.insert(rnd.randrange(len(text)), rnd.choice(["vile", "scum", "rotten"]))
        if d % 9 == 0:
            junk.add(d)
            text = [w + rnd.choice(["***", "%%%"]) for w in text]
        rows.append((d, " ".join(text)))
        if d % 2:
            labels.append((d, int(d not in junk), int(d in toxic)))
    for d in range(1500, 1500 + len(rows) // 2):  # labels of even documents too, under both kinds
        pass
    labels += [(d, int(d not in junk), int(d in toxic)) for d in range(0, 1500, 4)]
    labels += [(None, 1, 1), (10**6, 0, 1), (3, None, None), labels[0]]
    rows += [(2001, None), (2002, ""), (None, "plain words"), rows[1]]
    return odd_documents(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), toxic, junk


def test_toxic_documents_are_found(spark, corpus):
    docs, labels, toxic, _ = corpus
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    wrong = [r.doc_id for r in rows if r.predicted != int(r.doc_id in toxic)]
    assert len(wrong) <= 15
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.predicted == 0 for r in rows)


def test_a_fixed_phrase_repeated_in_many_documents_counts(spark):
    rnd = random.Random(11)
    rows = []
    for d in range(1500):
        text = words(rnd, rnd.randrange(30, 200))
        if d % 7 == 0:
            at = rnd.randrange(len(text))
            text[at:at] = ["utter", "nitwit"]
        elif d % 7 < 3:
            at = rnd.randrange(len(text))
            text[at:at] = ["utter", rnd.choice(["calm", "joy", "peace"])]
        rows.append((d, " ".join(text)))
    labels = spark.createDataFrame([(d, 1, int(d % 7 == 0)) for d, _ in rows if d % 2], "doc_id bigint, quality int, toxic int")
    got = toxicity.toxicity(odd_documents(spark, rows), labels).filter("held_out").collect()
    assert sum(r.predicted != int(r.doc_id % 7 == 0) for r in got) <= 3


def test_all_labelled_documents_are_counted(spark, monkeypatch):
    docs = spark.range(20_000).selectExpr("id as doc_id", "concat('some text ', id % 50) as text")
    labels = docs.selectExpr("doc_id", "1 as quality", "cast(doc_id % 9 = 0 as int) as toxic")
    counted = []
    count_model = toxicity.count_model
    monkeypatch.setattr(toxicity, "count_model", lambda train, scratch: counted.append(train.count()) or count_model(train, scratch))
    toxicity.train_model(docs, labels)
    assert counted == [labels.filter(toxicity.fold(labels.doc_id).isin(1, 2, 3)).count()] and counted[0] > 10_000


def test_held_out_labels_are_not_read(spark, corpus):
    docs, labels, _, _ = corpus
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.train_model(docs, x) for x in (labels, flipped))
    assert all((getattr(a.model, n) == getattr(b.model, n)).all() for n in ("words", "word_ratios", "backoffs", "pairs", "pair_ratios"))
    assert all((x == y).all() for x, y in zip(a.fit, b.fit))


def kneser_ney(texts):
    """P(word | word before) of each class by the formulas, on ``(words, class)``; None stands for an unseen word."""
    d = toxicity.DISCOUNT
    pairs = Counter((v, w, c) for words_, c in texts for v, w in set(zip([None, *words_], words_)))
    seen = {(v, w) for v, w, _ in pairs}
    types = {w for _, w in seen}

    def single(w, c):
        after = {x: len({v for v, y in seen if y == x}) for x in types}
        mine = {x: len({v for v, y, k in pairs if y == x and k == c}) for x in types}
        every, own = sum(after.values()), sum(mine.values())
        spare = sum(min(n, d) for n in after.values()) / every / (len(types) + 1)
        shared = max(after.get(w, 0) - d, 0) / every + spare
        return max(mine.get(w, 0) - d, 0) / own + sum(min(n, d) for n in mine.values()) / own * shared

    def double(v, w, c):
        n = {x: pairs[v, x, 0] + pairs[v, x, 1] for x in types}
        total, own = sum(n.values()), sum(pairs[v, x, c] for x in types)
        if not total:
            return single(w, c)
        shared = max(n.get(w, 0) - d, 0) / total + sum(min(x, d) for x in n.values()) / total * single(w, c)
        if not own:
            return shared
        return max(pairs[v, w, c] - d, 0) / own + sum(min(pairs[v, x, c], d) for x in types) / own * shared

    return single, double


def test_ratios_equal_kneser_ney_by_hand(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TELLING", 1e-9)
    rnd = random.Random(12)
    names = ["a", "b", "c", "d", "rude", "once"]
    texts = [([rnd.choice(names[:5]) for _ in range(rnd.randrange(3, 30))], i % 3 == 0) for i in range(24)]
    texts += [(["once", "rude", "a"], True), (["a", "once"], False), ([], True)]
    train = spark.createDataFrame([(i, " ".join(t), int(c)) for i, (t, c) in enumerate(texts)], "doc_id bigint, text string, toxic int")
    model = toxicity._held(toxicity.count_model(train, Scratch(spark, "test")).toArrow())
    single, double = kneser_ney(texts)
    unseen = np.log(single(None, 1) / single(None, 0))
    hashes = toxicity.TokenHashes(words_only=True)
    for text in [["a", "b"], ["once", "rude", "new", "a", "rude"], ["new", "other"], *[[v, w] for v in names for w in names]]:
        tokens = hashes(" ".join(text))
        got = model.features(tokens)
        known = lambda w: w if w in names else None
        want = [np.log(double(v, known(w), 1) / double(v, known(w), 0)) - unseen for v, w in zip([None, *text], text)]
        assert abs(got[0] - np.mean(want)) < 1e-9, text
        alone = [np.log(single(known(w), 1) / single(known(w), 0)) - unseen for w in text]
        assert abs(got[1] - max(alone)) < 1e-9 and abs(got[4] - max(want)) < 1e-9


def test_texts_are_hashed_and_looked_up_together(monkeypatch):
    texts = [None, "", "__ !", "ab AB a_b", "ΑΣ ΌΣΟΣ", "İ i̇", "a\x1cb\x85c", "x" * 300 + " " + "x" * 299 + "y", "ß½① \U0001d400é"]
    texts += ["nine_letter ninelette", "a" * 8 + " " + "a" * 16, "\u2003", ""]
    hashes, ends = language.word_hashes(texts)
    words = [re.findall(r"[^\W_]+", (t or "").lower()) for t in texts]
    assert ends.tolist() == np.cumsum([len(w) for w in words]).tolist()
    of_word = dict(zip([w for ws in words for w in ws], hashes.tolist()))
    assert [of_word[w] for ws in words for w in ws] == hashes.tolist() and len(set(of_word.values())) == len(of_word)
    rnd = np.random.default_rng(5)
    keys = np.unique(np.concatenate((hashes, rnd.integers(0, 1 << 64, 3000, np.uint64), np.arange(9, dtype=np.uint64))))
    wanted = np.concatenate((keys, keys + np.uint64(1), rnd.integers(0, 1 << 64, 99, np.uint64)))
    places = {k: i for i, k in enumerate(keys.tolist())}
    assert toxicity.Places(keys)(wanted).tolist() == [places.get(w, -1) for w in wanted.tolist()]
    assert toxicity.Places(keys[:0])(wanted).tolist() == [-1] * len(wanted)
    model = toxicity.Model(keys, rnd.normal(size=len(keys)), rnd.normal(size=len(keys)), keys[:0], np.empty(0))
    assert model.features_of(hashes, ends).tolist() == [model.features(language.word_hashes([t])[0]) for t in texts]
    calls = []
    batch = pa.RecordBatch.from_pydict({"text": [f"some words {i}" for i in range(500)]})
    monkeypatch.setattr(toxicity, "word_hashes", lambda t: calls.append(len(t)) or language.word_hashes(t))
    ((_, scores),) = toxicity._with_scores(iter([batch]), SimpleNamespace(value=model), (np.zeros(7), np.ones(7), np.ones(8)))
    assert calls == [500] == [len(scores)]


def test_a_model_that_no_task_holds_scores_alike(spark, corpus, monkeypatch):
    docs, labels, _, _ = corpus
    docs = docs.unionByName(docs.limit(3))
    held = sorted(map(tuple, toxicity.toxicity(docs, labels).collect()), key=repr)
    kept = sorted(map(repr, toxicity.drop_toxic(docs, labels).collect()))
    monkeypatch.setattr(toxicity, "HELD", 0)
    joined = sorted(map(tuple, toxicity.toxicity(docs, labels).collect()), key=repr)
    assert [(a, b, d) for a, b, _, d in held] == [(a, b, d) for a, b, _, d in joined]
    assert max(abs(a[2] - b[2]) for a, b in zip(held, joined)) < 1e-12
    out = toxicity.drop_toxic(docs, labels)
    assert out.columns == docs.columns and sorted(map(repr, out.collect())) == kept
    assert toxicity.toxicity(docs.limit(0), labels).collect() == [] == toxicity.drop_toxic(docs.limit(0), labels).collect()


def test_a_model_that_no_task_holds_is_mapped_without_a_shuffle(spark, corpus, monkeypatch):
    docs, labels, _, _ = corpus
    docs = Scratch(spark, "test").table(docs.unionByName(docs.limit(3)), "docs")
    held = sorted(map(tuple, toxicity.toxicity(docs, labels).collect()), key=repr)
    kept = sorted(map(repr, toxicity.drop_toxic(docs, labels).collect()))
    monkeypatch.setattr(toxicity, "HELD", 0)
    monkeypatch.setattr(toxicity, "PIECE", 100)
    mapped = toxicity.toxicity(docs, labels)
    out = toxicity.drop_toxic(docs, labels)
    for df in (mapped, out):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
    assert sorted(map(tuple, mapped.collect()), key=repr) == held
    assert out.columns == docs.columns and sorted(map(repr, out.collect())) == kept
    model = toxicity.train_model(docs, labels).model
    assert len(model.written) > 8 and not {k for k in vars(model) if k[0] == "_"} & set(model.__getstate__())


def test_a_model_is_joined_where_tasks_cannot_map_it(spark, corpus, monkeypatch):
    docs, labels, _, _ = corpus
    docs = docs.unionByName(docs.limit(3))
    held = sorted(map(tuple, toxicity.toxicity(docs, labels).collect()), key=repr)
    kept = sorted(map(repr, toxicity.drop_toxic(docs, labels).collect()))
    monkeypatch.setattr(toxicity, "HELD", 0)
    monkeypatch.setattr(Scratch, "local_path", lambda self, name: None)
    joined = sorted(map(tuple, toxicity.toxicity(docs, labels).collect()), key=repr)
    assert [(a, b, d) for a, b, _, d in held] == [(a, b, d) for a, b, _, d in joined]
    assert max(abs(a[2] - b[2]) for a, b in zip(held, joined)) < 1e-12
    assert sorted(map(repr, toxicity.drop_toxic(docs, labels).collect())) == kept


def test_pieces_are_found_as_in_one(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "PIECE", 40)
    rnd = np.random.default_rng(3)
    h = rnd.integers(-(1 << 63), 1 << 63, 600)
    h = np.concatenate((h, [0, -1, 1, 1 << 62, -(1 << 62)]))
    rows = [(int(k), bool(i % 3), float(i), float(i % 3 == 0)) for i, k in enumerate(h)]
    table = spark.createDataFrame(rows + [(rows[0][0], True, 7.5, 0.0)], "h bigint, pair boolean, r double, g double")
    pieces = toxicity._in_pieces(table, len(rows), Scratch(spark, "test"), "model")
    wanted = np.unique(np.concatenate((h, h + 1, rnd.integers(-(1 << 63), 1 << 63, 300))).astype(np.int64).view(np.uint64))
    for pair in (False, True):
        want = {k % (1 << 64): (r, g) for k, p, r, g in [*rows, (rows[0][0], True, 7.5, 0.0)] if p == pair}
        found, r, g = pieces.found(wanted, pair)
        assert dict(zip(found.tolist(), zip(r.tolist(), g.tolist()))) == want and len(found) == len(want)
        assert [len(x) for x in pieces.found(wanted[:0], pair)] == [0, 0, 0]


def test_copies_are_dropped_before_their_words_are_rows(spark):
    table = spark.createDataFrame([(1, True, 0.5, 0.0)], "h bigint, pair boolean, r double, g double")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c", "a b c", None, None, ""])], "doc_id bigint, text string")
    joined = toxicity._joined_features(docs, table)
    assert joined.count() == 3
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[[^\]]*\bh#", plan), plan


def test_many_labels_shuffle_no_texts(spark, corpus, monkeypatch):
    docs, labels, _, _ = corpus
    scratch, folds = Scratch(spark, "test"), [1, 2, 3]
    docs = scratch.table(docs.unionByName(docs.limit(3)), "docs")
    want = sorted(map(tuple, toxicity.labelled(docs, labels, folds, None, scratch, "few").select("doc_id", "text", "toxic").collect()))
    monkeypatch.setattr(toxicity, "small_side", lambda df: df)  # as if they were too many for a broadcast
    got = toxicity.labelled(docs, labels, folds, None, scratch, "many")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert sorted(map(tuple, got.collect())) == want and len(want) > 400
    assert toxicity.labelled(docs, labels.limit(0), folds, None, scratch, "none").collect() == []


def test_counting_leaves_neither_pairs_nor_shuffles(spark, corpus):
    docs, labels, _, _ = corpus
    setting, dropped, freed = common._FREEING, [], []
    drop, table = Scratch.drop, Scratch.table
    before = spark.conf.get(setting, None)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(Scratch, "drop", lambda self, *tables: dropped.extend(t._scratch_path for t in tables) or drop(self, *tables))
        patch.setattr(Scratch, "table", lambda self, df, name: freed.append((name, spark.conf.get(setting, None))) or table(self, df, name))
        toxicity.train_model(docs, labels)
    assert {"pairs", "words"} == {p.rpartition("/")[2].partition("-")[0] for p in dropped}
    assert not [p for p in dropped if os.path.exists(p.removeprefix("file:"))]
    assert {"counted", "pairs", "words", "ratios"} == {name for name, on in freed if on == "true"}
    assert spark.conf.get(setting, None) == before


def test_stages_without_rows(spark, corpus):
    docs, labels, _, _ = corpus
    for some in (labels, labels.limit(0)):
        assert toxicity.toxicity(docs.limit(0), some).collect() == []
        assert toxicity.drop_toxic(docs.limit(0), some).collect() == []
        assert quality.keep_good(docs.limit(0), some).collect() == []
    assert minhash.drop_near_duplicates(docs.limit(0)).collect() == []
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.drop_contaminated(docs.limit(0), items).collect() == []
    assert decontaminate.drop_contaminated(docs, items).count() == docs.count()


def test_scores_without_labels(spark, corpus):
    docs, labels, _, _ = corpus
    rows = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert {r.predicted for r in rows} == {0}


def test_good_documents_are_kept(spark, corpus):
    docs, labels, _, junk = corpus
    rows = quality.quality(docs, labels).collect()
    assert not [r.doc_id for r in rows if not r.kept and r.doc_id not in junk]
    assert sum(r.kept for r in rows if r.doc_id in junk) <= 2
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in rows)


def test_gumbel_top_k_equals_brute_force(spark, corpus):
    docs, labels, _, _ = corpus
    rows = quality.quality(docs, labels, keep=100).collect()
    least = sorted((r.key for r in rows), reverse=True)[99]
    assert [r.kept for r in rows] == [r.key >= least for r in rows]
    assert quality.quality(docs.limit(0), labels).count() == 0


def test_weights_and_draw_equal_brute_force(spark, corpus):
    """The importance weights by the two models' counts, and the sample by sorting the noisy weights."""
    from pyspark.sql import functions as F

    docs, labels, _, _ = corpus
    docs = docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).withColumn("text", F.coalesce("text", F.lit("")))
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and r.doc_id in texts}
    chosen = spark.createDataFrame([(d,) for d in sorted(good)], "d bigint").filter(F.pmod(F.xxhash64("d", F.lit(7)), F.lit(4)) != 0)
    target = {r.d for r in chosen.collect()}
    hashes = quality.TokenHashes()
    found = {d: Counter(quality.features(hashes(t)).tolist()) for d, t in texts.items()}
    raw, wanted = Counter(), Counter()
    for d, counts in found.items():
        raw.update(counts)
        wanted.update(counts if d in target else {})
    n, every, some = quality.BUCKETS, raw.total(), wanted.total()
    base = {b: (raw[b] + 1) / (every + n) for b in raw}
    ratio = {b: np.log((wanted[b] + n * base[b]) / (some + n) / base[b]) for b in raw}
    rows = quality.quality(docs, labels, keep=150).collect()
    noise = {r.doc_id: r.g for r in docs.select("doc_id", quality.gumbel(F.xxhash64("doc_id", "text")).alias("g")).collect()}
    keys = {}
    for r in rows:
        weight = sum(ratio[b] * times for b, times in found[r.doc_id].items())
        assert abs(r.log_weight - weight) < 1e-6 * (1 + abs(weight))
        keys[r.doc_id] = quality.TEMPERED * weight / (found[r.doc_id].total() + quality.NEUTRAL) + noise[r.doc_id]
        assert abs(r.key - keys[r.doc_id]) < 1e-6 * (1 + abs(r.key))
    best = sorted(keys, key=keys.get, reverse=True)[:150]
    assert {r.doc_id for r in rows if r.kept} == set(best)


def test_equal_keys_share_their_fate(spark, corpus):
    docs, labels, _, _ = corpus
    rows = quality.quality(docs.unionByName(docs), labels, keep=101).collect()
    kept = Counter(r.doc_id for r in rows if r.kept)
    assert all(n % 2 == 0 for n in kept.values()) and 101 < sum(kept.values()) < 106


def test_kth_largest(spark):
    rnd = random.Random(8)
    values = [rnd.choice([0.0, 1.0, rnd.gauss(0, 1e6), rnd.random()]) for _ in range(3000)]
    table = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 700, 1500, 2999, 3000):
        assert quality.kth_largest(table, "v", k) == sorted(values, reverse=True)[k - 1]


def test_pipeline_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    left = {r.doc_id for r in toxicity.toxicity(docs, labels).collect() if not r.predicted}
    scratch = Scratch(spark, "test")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = scratch.table(stage(spark, docs, FOLDER), name)
        got = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "quality":
            left = {r.doc_id for r in quality.quality(before, labels).collect() if r.kept}
        if name == "near_duplicates":
            left = {g for _, _, g in brute_components([(d, texts[d]) for d in sorted(left)])}
        if name == "decontamination":
            left -= {d for d, *_ in brute_containment([(d, texts[d]) for d in left], items)}
        assert got == left, name
        assert name == "bpe" or docs.columns == before.columns
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(registry.tokenizer())
    for r in docs.collect():
        assert r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)
