"""The rule ledger, conversation repair and spelling variants against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import pairwise

import pytest

from panelspark.llm import registry, repair, rules, spelling

FOLDER = "/root/testdata/sf0.001"
SPACES = " \t\n\x0b\x0c\r"
CLASHES = ["n", "failed", "kept", "word", "seg", "id", "key", "symbol", "edits", "rows"]


def with_clashes(spark, rows, schema):
    extra = ", ".join(f"{c} string" for c in CLASHES)
    return spark.createDataFrame([(*r, *["c"] * len(CLASHES)) for r in rows], f"{schema}, {extra}")


# Rules


def measured(text):
    """The measurements of one text, counted one by one."""
    words = [w for w in re.split(f"[{SPACES}]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if x.strip(SPACES)]
    times = Counter(zip(words, words[1:], words[2:]))
    inside = {i + j for i in range(len(words) - 2) if times[tuple(words[i : i + 3])] > 1 for j in range(3)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines),
        sum(x in lines[:i] for i, x in enumerate(lines)), len(inside),
    )


def odd_texts():
    rnd = random.Random(5)
    texts = [None, "", " \n\t ", "a a a a", "a b\na b\n\na b", "x\x1cy\x85z w", "Ünï çôdé \U0001f600 #*$%&|<>", "a b c a b c", "a b c\na b C"]
    for _ in range(60):
        words = [rnd.choice(["ab", "ç", "#x", "Ab", "\U0001f600", "longerword"]) for _ in range(rnd.randrange(90))]
        texts.append("".join(w + rnd.choice([" ", "\n", "  ", "\r\n", "\x0b"]) for w in words))
    return texts


def test_measurements_equal_brute_force():
    texts = odd_texts()
    found = rules.measure_texts([None if t is None else t.encode() for t in texts])
    assert list(zip(*(found[m].tolist() for m in rules.MEASURES))) == [measured(t) for t in texts]
    assert all(len(v) == 0 for v in rules.measure_texts([]).values())


def test_texts_do_not_touch():
    """A window or line of one text is none of the next."""
    found = rules.measure_texts([b"a b c", b"a b c", b"same", b"same"])
    assert not found["n_repeat_words"].any() and not found["n_dup_lines"].any()


def test_ledger_decides_like_the_rules(spark):
    texts = odd_texts() + ["w " * 60, " ".join(f"word{i}" for i in range(60)), " ".join(f"word{i} #" for i in range(60))]
    rows = [(None if i == 3 else i, t) for i, t in enumerate(texts)] * 2
    out = rules.judged(with_clashes(spark, rows, "doc_id bigint, text string")).collect()
    assert len(out) == len(rows)
    want = {}
    for doc_id, text in rows:
        n, chars, symbols, lines, dup, repeat = measured(text)
        base = n < 50 or 100 * repeat > 50 * n
        kept = not (base or 10 * symbols > n or 100 * dup > 40 * lines or chars < 2 * n or chars > 20 * n)
        want[doc_id] = (n, chars, symbols, lines, dup, repeat, base, kept)
    assert {r["doc_id"]: (*(r[m] for m in rules.MEASURES), r["base_failed"], r["kept"]) for r in out} == want


def ledger_of(spark, bits):
    rows = [(i, b, 10 * i) for i, b in enumerate(bits)]
    return spark.createDataFrame(rows, "doc_id bigint, failed bigint, n_words bigint")


def test_policies_and_ablations(spark):
    rnd = random.Random(1)
    bits = [rnd.choice([0, 0, 1, 2, 3, 4, 8, 12, 20, 63]) for _ in range(300)]
    policy = rules.Policy("soft", 3, ("few_words",), ("repeated_words", "many_symbols", "repeated_lines"), spare=1)
    fails = lambda b: bool(b & 1) or (b & 14).bit_count() > 1
    rows = ledger_of(spark, bits)
    kept = {r["doc_id"]: r["kept"] for r in rules.apply_policy(rows, policy).collect()}
    assert kept == {i: not fails(b) for i, b in enumerate(bits)}
    for r in rules.ablations(rows, policy).collect():
        bit = 1 << r["bit"]
        hit = [b & 15 for b in bits if b & bit]
        decisive = [i for i, b in enumerate(bits) if fails(b) and not fails(b & ~bit)]
        assert (r["failed"], r["decisive"], r["decisive_words"]) == (len(hit), len(decisive), 10 * sum(decisive))
        assert r["kept_without"] == sum(not fails(b & ~bit) for b in bits)
        every, some = 15, 0
        for b in hit:
            every, some = every & b, some | b
        assert (r["always_with"], r["never_with"]) == (every, 15 & ~some)


def test_revised_policy_reads_measurements(spark):
    rows = ledger_of(spark, [1, 0, 1, 0])  # n_words 0, 10, 20, 30
    policy = rules.Policy("looser", 4, ("few_words",), revised=(("few_words", "n_words < 15"),))
    assert [r["kept"] for r in rules.apply_policy(rows, policy).orderBy("doc_id").collect()] == [False, False, True, True]


def test_empty_ledger(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert rules.judged(docs).collect() == []
    out = rules.ablations(rules.ledger(docs), rules.POLICIES["prose"]).collect()
    assert len(out) == 6 and all(r["failed"] == r["kept_without"] == 0 and r["always_with"] == r["never_with"] == 63 for r in out)


# Conversations


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = (conv, turn, "user" if kind == 4 else role, text)
        out += [] if kind == 0 else [row, row] if kind == 3 else [row]
    return out


def repaired_by_search(rows):
    """Everything the query returns of one conversation's rows, by going through all edits of each row in turn."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
    turns = [r[1] for r in rows if r[1] is not None]
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = text.strip(SPACES)
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {"": (0, "", ())}  # the roles' initials, shortened, to cost, edits and lines
    short = lambda x: x if len(x) < 2 else ("z" + x[-1])  # noqa: E731  begun, and how it ends

    def legal(state, initial):
        return initial in {"": "su", "s": "u", "u": "a"}.get(state, "a" if state.endswith("u") else "u")

    def offer(to, state, initial, entry):
        if legal(state, initial):
            new = short(state + initial)
            if new not in to or entry[:2] < to[new][:2]:
                to[new] = entry

    def inserted(states):
        for _ in range(3):
            for state, (cost, edits, lines) in list(states.items()):
                for name in ("user", "assistant"):
                    offer(states, state, name[0], (cost + 2, edits + "I", (*lines, f"{name}:")))
        return states

    best = inserted(best)
    for (_, _, role, text), fault in zip(rows, faults):
        following = {}
        for state, (cost, edits, lines) in best.items():
            drop = (cost + 3, edits + "D", lines)
            if state not in following or drop[:2] < following[state][:2]:
                following[state] = drop
            if fault not in ("b", "d"):
                more = fault == "t"
                offer(following, state, role[:1] or "-", (cost + more, edits + "K", (*lines, f"{role}:{text}")))
                for name in ("user", "assistant"):
                    offer(following, state, name[0], (cost + 2 + more, edits + "R", (*lines, f"{name}:{text}")))
        best = inserted(following)
    cost, edits, lines = min((v for k, v in best.items() if k == "" or k.endswith("a")), key=lambda v: v[:2])
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in pairwise(rows))
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in "bdt"), illegal, cost, edits, digest)


def conversations(seed):
    rnd = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "unknown"]
    texts = ["Yes.", "no", "Why?", "", " \t", None, "a! \n", "..", "Ünï.", "x\x1c"]
    rows = []
    for conv in [None, *range(25)]:
        for i in range(rnd.choice([1, 2, 5, 9, 30])):
            turn = rnd.choice([i, i, i, i + 2, None]) if conv != 3 else None
            rows.append((conv, turn, rnd.choice(roles), rnd.choice(texts)))
    return rows + rows[:4]


@pytest.mark.parametrize("segment", [1, 4, 256])
def test_repair_equals_search(spark, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT_ROWS", segment)
    rows = conversations(segment)
    given = with_clashes(spark, rows, "conv_id bigint, turn bigint, role string, text string")
    segments, found = repair.repair(repair.damage(given), given.select("conv_id"))
    left = damaged(rows)
    want = {c: repaired_by_search([r for r in left if r[0] == c]) for c in {r[0] for r in rows}}
    columns = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r["conv_id"]: tuple(r[c] for c in columns) for r in found.collect()} == want
    pieces = sorted(segments.collect(), key=lambda r: r["seg"])
    for conv in want:  # the segments hold the lines themselves
        mine = [r for r in pieces if r["conv_id"] == conv]
        assert "".join(r["edits"] for r in mine) == want[conv][6]
        assert hashlib.sha256("\n".join(x for r in mine for x in r["lines"]).encode()).hexdigest() == want[conv][7]


def test_one_conversation_holds_most_rows(spark, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT_ROWS", 16)
    rows = [(1, i, ["user", "assistant"][i % 2], f"t{i % 50}.") for i in range(3000)] + [(2, 0, "user", "Hello.")]
    found = {r["conv_id"]: r for r in repair.repair(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))[1].collect()}
    assert found[1]["duplicate"] == 2950 and found[1]["audit"] == "K" * 50 + "D" * 2950
    assert (found[2]["audit"], found[2]["cost"]) == ("KI", 2)


def test_empty_conversations(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    segments, found = repair.repair(repair.damage(empty), empty.select("conv_id"))
    assert segments.collect() == [] and found.collect() == []
    ids = spark.createDataFrame([(7,), (7,)], "conv_id bigint")
    (row,) = repair.repair(empty, ids)[1].collect()
    assert tuple(row) == (7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


# Spelling


def one_edit(word, letters):
    for i in range(len(word) + 1):
        for c in letters:
            yield word[:i] + c + word[i:]
            if i < len(word):
                yield word[:i] + c + word[i + 1 :]
        if i < len(word):
            yield word[:i] + word[i + 1 :]


def grouped(counts):
    near = {w: {x for x in one_edit(w, "abcdefghijklmnopqrstuvwxyzçéà÷") if x in counts and x != w} for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 5 * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), form[w] and counts[form[w]]))
    return out


def vocabulary_of(seed, size):
    rnd = random.Random(seed)
    counts = {}
    while len(counts) < size:
        base = "".join(rnd.choice("abcé") for _ in range(rnd.choice([6, 6, 7, 8])))
        for w in [base, *rnd.sample(list(one_edit(base, "abcé")), 5)]:
            if len(w) >= 6:
                counts[w] = rnd.choice([5, 25, 25, 125, 700, 9])
    return counts


@pytest.mark.parametrize("bucket", [8, 512])
def test_variants_equal_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(spelling, "BUCKET", bucket)
    counts = vocabulary_of(bucket, 700)
    out = spelling.group_variants(spark.createDataFrame(list(counts.items()), "word string, n bigint")).collect()
    assert {tuple(r) for r in out} == grouped(counts) and len(out) == len(counts)


def test_words_one_edit_apart_share_a_signature():
    rnd = random.Random(3)
    for _ in range(300):
        word = "".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(6, 12)))
        for other in one_edit(word, "abé"):
            if len(other) >= 6 and other != word:
                assert spelling.near(word, other) and set(spelling.signatures(word)) & set(spelling.signatures(other))


def test_vocabulary_equals_brute_force(spark):
    rnd = random.Random(4)
    words = ["Gardens", "gardens", "éclairs", "Éclairs", "straße÷x", "short", "ÿÿÿÿÿÿ", "abcdef", "İstanbul"]
    rows = [(None if i % 7 == 0 else i, " ".join(rnd.choice(words) + rnd.choice(["", ",", "1"]) for _ in range(400))) for i in range(90)]
    rows += [(100, None), (101, ""), (102, "abcdef" * 1000)] * 2
    want, lost = Counter(), 0
    for doc_id, text in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
                lost += 1
            if len(run) >= 6:
                want[run] += 1
    found = spelling.vocabulary(with_clashes(spark, rows, "doc_id bigint, text string")).collect()
    assert {r["word"]: r["n"] for r in found} == {w: n for w, n in want.items() if n >= 5}
    assert lost


def test_no_words(spark):
    assert spelling.spelling_variants(spark.createDataFrame([(1, "short ones"), (2, None)], "doc_id bigint, text string")).collect() == []
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_every_new_query_has_sql():
    assert {"op11_rule_ledger", "op12_conversation_repair", "op13_spelling_variants", "rule_ablations"} <= registry.oracle_sql().keys()
