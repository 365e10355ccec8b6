"""BPE, token files, top-k, licences, shards and archives against brute force and round trips."""

import hashlib
import math
import random
import textwrap
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelspark.llm import bpe, licenses, registry, sharding, tokens, topk, warc
from panelspark.llm.common import Scratch

ODD = [
    None, "", " \n", "<|startoftext|>hi<|endoftext|> x", "ΣΑΣ Σίσυφος", "İstanbul ǅ", "a\x1cb \x1d c", "é ́x ﬀ ½ ²³ ①",
    "it's don't we'll I'D", "日本語 テキスト 🙂👍🏽 1234567", "​﻿x᠎ y", "a\x85b　c d", "x" * 3000, "<|startoftext", "ab " * 20000,
]


def odd_texts():
    rnd = random.Random(1)
    ranges = [(32, 127), (0, 0x250), (0, 0x3000), (0, 0xD800), (0x10000, 0x1FFFF)]
    plain = ["".join(chr(rnd.choice([rnd.randrange(0x250), rnd.randrange(97, 123), 32, 39])) for _ in range(rnd.randrange(1, 16))) for _ in range(1500)]
    return ODD + plain + ["".join(chr(rnd.randrange(*rnd.choice(ranges))) for _ in range(rnd.randrange(1, 12))) for _ in range(1500)]


def documents(spark, texts):
    rows = [(None if i == 5 else i, t, "en", "s", "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, ids string, part string")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(registry.tokenizer())


def test_round_trip_equals_the_library(spark, library):
    texts = odd_texts()
    docs = documents(spark, texts)
    rows = bpe.decode(bpe.encode(docs, registry.tokenizer()), registry.tokenizer()).collect()
    encoded = {r.doc_id: library.encode(texts[5 if r.doc_id is None else r.doc_id] or "", add_special_tokens=False).ids for r in rows}
    assert len(rows) == len(texts)
    for r in rows:
        assert r.ids == encoded[r.doc_id], texts[r.doc_id or 5]
        assert r.decoded == library.decode(r.ids, skip_special_tokens=False)
    for r in bpe.round_trip_digests(docs, registry.tokenizer()).collect():
        ids = encoded[r.doc_id]
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.encode(docs.limit(0), registry.tokenizer()).count() == 0


def test_memory_forgets_without_changing_results(library, monkeypatch):
    monkeypatch.setattr(bpe, "_PAIRS", 50)
    with open(registry.tokenizer(), "rb") as file:
        own = bpe.WordBpe(file.read(), memory=4000)
    for t in odd_texts()[:500]:
        assert own.encode(t).tolist() == library.encode(t or "", add_special_tokens=False).ids
    for memory in (own.plain_ids, own.chunk_ids):
        assert 0 < len(memory) <= 30 and 0 < len(memory.old) <= 30 and memory.held <= memory.limit + 1000


def test_plain_texts_are_cut_into_pre_tokens_at_once(library):
    with open(registry.tokenizer(), "rb") as file:
        own = tokens.LibraryEncoder(file.read())
    asked, encode_word = [], own.encode_word
    own.plain_ids.make = lambda word: asked.append(word) or encode_word(word)
    text = "Word, (word) word. It's wordé!\x1cword7 WORD...\x85word"
    assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    words = ["word", ",", "(", ")", ".", "it", "'s", "wordé", "!\x1c", "7", "..."]
    assert asked == list(own.plain_ids) == words and not own.chunk_ids
    rnd = random.Random(4)
    for letters in ([chr(i) for i in range(0x250)], list("stdremlv' .,1ÀÞ") + ["\x1c", "\xa0"]):
        for _ in range(2000):
            plain = "".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 12))).lower()
            assert own.plain_pattern.findall(plain) == [w for c in bpe.chunks(plain) for w in own.pattern.findall(c)]
    usual = own.pattern.pattern
    assert [bpe._is_plain(t) for t in ("a", "é\xff", "ēɏ", "a<", "é<", "ē<", "ɐ", "aé日")] == [True] * 3 + [False] * 5
    assert bpe._plain_pattern("[a-z]+|\\p{N}").findall("ab ½7") == ["ab", "½", "7"] and bpe._USUAL == usual


def test_texts_of_a_slice_look_up_each_pre_token_once(library):
    with open(registry.tokenizer(), "rb") as file:
        spec = file.read()
    own, small = tokens.LibraryEncoder(spec), bpe.WordBpe(spec, memory=16_000)
    found, find = [], own.table.find
    own.table.find = lambda words: found.extend(words.to_pylist()) or find(words)
    texts = ["Word word's", None, "WORD'S ''s 'Tis", "", "日 word", " \n", "'ll'llama 12² it's"]
    same = lambda got, texts: [np.frombuffer(g, "<u4").tolist() for g in got] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert same(own.encode_texts(texts), texts)
    assert found == ["word", "'s", "''", "s", "'t", "is", "'ll", "ama", "1", "2", "²", "it"] == own.table.words.to_pylist()
    assert own.encode_texts([]) == [] and own.encode_texts([None, "", " "]) == [b""] * 3
    rnd, odd = random.Random(5), odd_texts()
    for letters in ([chr(i) for i in range(0x250)], list("stdremlv' .,1ÀÞ") + ["\x1c", "\xa0"], list("' srevltȺȾİ²1")):
        odd += ["".join(rnd.choice(letters) for _ in range(rnd.randrange(14))) for _ in range(2000)]
    rnd.shuffle(odd)
    for at in range(0, len(odd), 50):
        some = odd[at : at + 50]
        assert same(own.encode_texts(some), some) and same(small.encode_texts(some), some)
        assert small.table.words.nbytes + small.table.values.nbytes <= small.table.limit == 4000
    assert 0 < len(small.table.words) < len(own.table.words)


def test_real_texts_equal_the_library(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe.encode(docs, registry.tokenizer()).collect():
        assert r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, library, encoding):
    texts = odd_texts()
    docs = documents(spark, texts).orderBy(F.rand(3)).repartition(5)
    path = Scratch(spark, "test").path("tokens")
    tokens.write_tokens(docs, registry.tokenizer(), path, encoding)
    rows = tokens.read_tokens(spark, path)
    got = tokens.global_starts(tokens.checksums(rows), rows).collect()
    start = 0
    for doc, text in sorted(((None if i == 5 else i, t) for i, t in enumerate(texts)), key=lambda x: -1 if x[0] is None else x[0]):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        (r,) = [r for r in got if r.doc_id == doc]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert sorted(r.doc_id for r in tokens.read_tokens(spark, path, 100, 120).collect()) == list(range(100, 121))
    local = path.removeprefix("file://")
    encodings = set()
    for part in pq.ParquetDataset(local).files:
        meta = pq.ParquetFile(part).metadata
        for g in range(meta.num_row_groups):
            column = meta.row_group(g).column(meta.num_columns - 1)
            assert column.has_offset_index and meta.row_group(g).column(0).has_column_index
            encodings |= set(column.encodings)
    assert ("DELTA_BINARY_PACKED" in encodings) == (encoding == "delta")
    assert any("DICTIONARY" in e for e in encodings) == (encoding == "dictionary")


def test_no_token_rows(spark):
    path = Scratch(spark, "test").path("tokens")
    tokens.write_tokens(documents(spark, ["a"]).limit(0), registry.tokenizer(), path)
    rows = tokens.read_tokens(spark, path)
    assert tokens.global_starts(tokens.checksums(rows), rows).count() == 0


def brute_top(rows, k=5):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(a) == len(b))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CHUNK", 64)
    monkeypatch.setattr(topk, "BLOCK", 3)
    rnd = random.Random(2)
    rows = [(i, [rnd.choice([rnd.gauss(0, 1), 0.5, -0.25]) for _ in range(6)]) for i in range(600)]
    rows += [(i, rows[50][1]) for i in range(600, 640)]  # ties
    rows += [(700, None), (750, [None] * 6), (800, [math.nan] * 6), (850, [math.inf] + [0.0] * 5), (900, [1.0, 2.0]), (901, [2.0, 1.0]), (None, rows[0][1]), (950, []), (1000, [0.0] * 6)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<double>, row string, chunk int")
    got = topk.exact_top_k(table, F.col("vec_id") % 50 == 0).collect()
    assert sorted(map(tuple, got)) == brute_top(rows)
    assert topk.exact_top_k(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    big = [(i, [float(rnd.randrange(-(2**31), 2**31)) for _ in range(3)]) for i in range(101)]
    small = [(i, [x / 2**12 for x in v]) for i, v in big]
    for some in (small, [(i, [x / 4 for x in v]) for i, v in big]):
        table = spark.createDataFrame(some, "vec_id bigint, embedding array<double>")
        want = [r for r in brute_top(some) if abs(r[3]) < 2**62]
        assert [r for r in sorted(map(tuple, topk.exact_top_k(table, F.col("vec_id") % 50 == 0).collect())) if r in want] == want


def test_licences_and_their_heirs(spark):
    gpl = "This work is licensed under the GNU General Public License, version 3."
    rows = [
        ("a/LICENSE", "Released under the MIT License.\nand a note about it that is quite a bit longer than the line"),
        ("a/x", "code"), ("a/b/y", "some words of code that follow each other here\n" + gpl + "\nand many more of them after that line"), ("a/b/z", None), ("a/b/c/COPYING.txt", gpl), ("a/b/c/d/w", ""),
        ("e/v", "nothing to see"), ("top", "released under the mit license"), ("f/own", gpl.replace("3", "2")), ("f/own", gpl),
        (None, gpl), (None, "x"), ("ab/u", "u"),
    ]
    files = spark.createDataFrame([(*r, "z") for r in rows], "path string, text string, word string")
    got = Counter((r.path, r.licence, r.found, r.licence_path) for r in licenses.scan(files).collect())
    assert got == Counter(
        [
            ("a/LICENSE", "MIT", "own", None), ("a/x", "MIT", "inherited", "a/LICENSE"), ("a/b/y", "GPL-3.0", "own", None),
            ("a/b/z", "MIT", "inherited", "a/LICENSE"), ("a/b/c/COPYING.txt", "GPL-3.0", "own", None),
            ("a/b/c/d/w", "GPL-3.0", "inherited", "a/b/c/COPYING.txt"), ("e/v", "MIT", "inherited", "top"), ("top", "MIT", "own", None),
            ("f/own", "GPL-2.0", "own", None), ("f/own", "GPL-2.0", "own", None), (None, "GPL-3.0", "own", None), (None, None, "none", None),
            ("ab/u", "MIT", "inherited", "top"),
        ]
    )
    assert licenses.scan(files.limit(0)).count() == 0


def test_markers_cover_every_match():
    vectors, idf, other, markers = licenses.template_vectors()
    norms = Counter()
    for name, i, word, weight in vectors:
        if word not in markers:
            norms[name, i] += weight * weight
    assert max(norms.values()) < licenses.THRESHOLD**2


def shards_of(rows):
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r)
    return by_shard


def test_shards_have_near_equal_bytes(spark):
    rnd = random.Random(3)
    texts = ["copy of one text " * 5] * 3000 + ["w" * rnd.randrange(400) for _ in range(6000)] + [None, "", "ü" * 50]
    rows = [(None if i == 7 else i, t, rnd.choice(["en", "de", None]), rnd.choice(["s0", "s0", "s1"]), 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, shard int")
    got = sharding.kd_shards(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        text = (texts[7 if r.doc_id is None else r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 16, zlib.crc32(text), "bytes", None)
    by_shard = shards_of(got)
    assert sorted(by_shard) == list(range(40))
    sums = [sum(r.size for r in rs) for rs in by_shard.values()]
    assert max(sums) - min(sums) <= 8 * 420
    for rs in by_shard.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    assert sorted(map(tuple, sharding.kd_shards(docs.repartition(7)).collect()), key=repr) == sorted(map(tuple, got), key=repr)
    by_target = shards_of(sharding.kd_shards(docs, target_bytes=sum(sums) // 5).collect())
    assert len(by_target) in (5, 6)
    path = Scratch(spark, "test").path("shards")
    sharding.write_shards(docs, path, 4)
    assert spark.read.parquet(path).count() == len(rows) and spark.read.parquet(path).select("shard").distinct().count() == 4


def test_written_shards_hold_every_row_once(spark, tmp_path):
    """Rows of one doc_id and text may differ in source, and repeat."""
    rows = [(i % 50, f"text {i % 50} " * (i % 7), f"s{i % 10}", "en", i, "c") for i in range(500)]
    docs = spark.createDataFrame(rows * 2, "doc_id bigint, text string, source string, lang string, size bigint, k_source string")
    sharding.write_shards(docs, str(tmp_path / "out"), 8)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(repr, back.select(*docs.columns).collect())) == sorted(map(repr, docs.collect()))
    sums = [r[0] for r in back.groupBy("shard").agg({"text": "count"}).select("count(text)").collect()]
    assert len(sums) == 8


def test_slots_in_several_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "_SLOT_ROWS", 10)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for rs in shards_of(sharding.kd_shards(docs, 3).collect()).values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    assert sharding.kd_shards(docs.limit(0)).count() == 0


def test_archives_round_trip(spark):
    rnd = random.Random(4)
    long = "".join(rnd.choice("<p>é\r\n WARC/1.1\r\n") for _ in range(3000))
    payloads = [long, None, "", "x" * 999, "x" * 999, "y" * 1000, "y" * 1000, "y" * 1000, "\r\n\r\n", "WARC/1.1\r\nWARC-Type: x\r\n\r\n", "WARC/1.1\r\n" * 200, long, "é" * 700]
    pages = [(i, f"http://x/{i}?q=é\r\nWARC/1.1\r\n", p, "z") for i, p in enumerate(payloads)]
    pages += [(None, None, "y" * 1000, "z"), (None, None, "alone" * 400, "z"), (3, "u", "again", "z"), (3, "u", "again", "z")]
    table = spark.createDataFrame(pages, "page_id bigint, url string, html string, payload string")
    path = Scratch(spark, "test").path("warc")
    warc.write_warc(table, path, chunk_bytes=500)
    got = Counter(map(tuple, warc.archive_index(spark, path).collect()))
    want = Counter()
    for page, _, html, _ in pages:
        data = (html or "").encode()
        same = [p for p, _, h, _ in pages if (h or "").encode() == data and p is not None]
        first = max(same) if same and len(data) >= 1000 else page
        want[page, len(data), hashlib.sha1(data).hexdigest(), "response" if first == page else "revisit", None if first == page else first] += 1
    assert got == want
    chunks = warc.read_warc(spark, path)
    assert chunks.agg(F.max(F.octet_length("data"))).first()[0] <= 500
    whole = {r.record: r for r in warc.record_digests(chunks).collect()}
    assert len(whole) == len(pages)
    text = b"".join(open(f, "rb").read() for f in _files(path))
    assert text.count(b"WARC/1.1\r\nWARC-Type: ") == chunks.count() + 0
    urls = {r.page_id: r.url for r in chunks.filter("chunk = 0").collect()}
    assert urls[0] == pages[0][1]


def _files(path):
    import glob

    return sorted(glob.glob(path.removeprefix("file:").replace("//", "/") + "/part-*"))


def test_notices_wrapped_over_lines_or_inside_sentences(spark):
    rnd = random.Random(3)
    code = "\n".join(f"    value_{k} = compute(alpha{rnd.randrange(99)}, {k})" for k in range(60))

    def header(licence, width, mark):
        found = textwrap.wrap(licenses.TEMPLATES[licence][1], width)
        return "".join(f"{mark} {line}\n" for line in found)

    files = [
        ("a/mit.py", "# Copyright 2020 Some Body\n#\n" + header("MIT", 60, "#") + code, "MIT"),
        ("a/gpl.c", "/* tool */\n" + header("GPL-3.0", 50, " *") + code, "GPL-3.0"),
        ("a/apache.js", code + "\n" + header("Apache-2.0", 70, "//") + code, "Apache-2.0"),
        ("a/line.md", "These notes describe the tool in short. Released under the MIT License. They were written by several people at home.", "MIT"),
        ("a/code.py", code, None),
        ("a/words.txt", "The public may use free software with any license that permits it, and people modify it at home.", None),
    ]
    rows = [(p, t) for p, t, _ in files]
    got = {r.path: r.licence for r in licenses.scan(spark.createDataFrame(rows + rows[:1], "path string, text string")).collect()}
    assert got == {p: licence for p, _, licence in files}


def test_published_licence_texts(spark):
    folder = "/usr/share/common-licenses"
    code = "\n".join(f"    value_{k} = compute(alpha{k}, {k})" for k in range(60))
    bsd3 = open(f"{folder}/BSD").read()
    mpl = open(f"{folder}/MPL-2.0").read()
    notice = mpl[mpl.index("  This Source Code Form is subject") : mpl.index("If it is not possible")]
    lgpl = open(f"{folder}/LGPL-2.1").read()
    short = lgpl[lgpl.index("    This library is free") : lgpl.index("    You should have received a copy of the GNU Lesser General Public\n    License along")]
    mit = "MIT License\n\nCopyright (c) 2020 Some Body\n\n" + licenses._NOTICE_MIT + "\n\n" + licenses._DISCLAIMER_MIT
    files = [
        ("bsd/LICENSE", bsd3, "BSD-3-Clause"),
        ("bsd2/LICENSE", "Copyright 2020\n" + licenses._CLAUSES_BSD + licenses._DISCLAIMER_BSD, "BSD-2-Clause"),
        ("bsd/src/x.c", code, "BSD-3-Clause"),
        ("mit/terms", mit, "MIT"),
        ("mit/src/x.c", code, "MIT"),
        ("x/mpl.js", notice + code, "MPL-2.0"),
        ("x/lgpl.c", short + code, "LGPL-2.1"),
        *[(f"x/spdx{k}.c", f"// SPDX-License-Identifier: {i}\n" + code, n) for k, (i, n) in enumerate([("MIT", "MIT"), ("GPL-2.0-only", "GPL-2.0"), ("BSD-3-Clause", "BSD-3-Clause")])],
        *[(f"full{n}/COPYING", open(f"{folder}/{n}").read(), f"{n}.0") for n in ("GPL-2", "GPL-3", "LGPL-3")],
        *[(f"full{n}/LICENSE", open(f"{folder}/{n}").read(), n) for n in ("Apache-2.0", "MPL-2.0", "LGPL-2.1")],
        ("fullGPL-3/x.c", code, "GPL-3.0"),
        ("x/code.c", code, None),
    ]
    rows = [(p, t) for p, t, _ in files]
    got = {r.path: r.licence for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {p: licence for p, _, licence in files}


def test_marks_without_a_line_end_of_their_own(spark):
    mark = "WARC/1.1"
    payloads = [mark, "x" + mark, mark + "\r", mark * 3, "x" * 492 + mark + "tail", "x" * 492 + mark, "x" * 1492 + mark + "\r\n", "plain"]
    pages = [(i, f"http://x/{i}/" + (mark if i % 2 else mark + "/y%2F"), p) for i, p in enumerate(payloads)]
    path = Scratch(spark, "test").path("warc")
    warc.write_warc(spark.createDataFrame(pages, "page_id bigint, url string, html string"), path, chunk_bytes=500)
    got = {(r.page_id, r.payload_bytes, r.payload_digest) for r in warc.archive_index(spark, path).collect()}
    assert got == {(i, len(p), hashlib.sha1(p.encode()).hexdigest()) for i, _, p in pages}
    chunks = warc.read_warc(spark, path).collect()
    assert max(len(r.data) for r in chunks) <= 500
    assert {r.page_id: r.url for r in chunks} == {i: u for i, u, _ in pages}


def test_no_pages(spark):
    table = spark.createDataFrame([], "page_id bigint, url string, html string")
    path = Scratch(spark, "test").path("warc")
    warc.write_warc(table, path)
    assert warc.archive_index(spark, path).count() == 0
