"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For a vocabulary made of merges, the encoding of every prefix of a word ends in one
certain token: the only suffix of the prefix that is a token and is compatible with the
last token of what stands before it. An automaton lists the tokens that end at each
place, a test on pairs of tokens picks the one, and following the stored tokens back
from the end gives the ids that merging in rank order gives.
"""

import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer
from tokenizers.pre_tokenizers import Split

from panelspark.llm.common import map_arrow, text_slices

# White space of the normalizer. Python's str.split also cuts at 1C to 1F, which are not.
_GAPS = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
_ODD_GAPS = re.compile("[\x1c-\x1f]")
_LATIN_END = "\u0250"
# What keeps a text from being lower-cased as a whole: other letters, and what may be a special token.
_NOT_PLAIN = re.compile("[^\x00-\u024f]|<")
# The usual pattern of pre-tokens, all of whose properties stand in brackets.
_USUAL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Kinds of characters. Those after an apostrophe that are a pre-token with it, where it begins one.
_LETTER, _NUMBER, _SPACE, _SIGN = range(4)
_KINDS = {_LETTER: r"\p{L}", _NUMBER: r"\p{N}", _SPACE: r"\s"}
_ENDINGS = (b"s", b"t", b"m", b"d", b"re", b"ve", b"ll")
_WORD_END = "</w>"
# Bytes that a memory's younger generation may take; the older one is as large. Longer strings are not kept.
MEMORY_BYTES = 20 << 20
_ENTRY_BYTES = 200  # of a dictionary's slot and the heads of two strings
_LONGEST = 64
# Texts are cut into pre-tokens in slices of about this many bytes: the more, the fewer different pre-tokens to look up.
_CUT_BYTES = 2 << 20
# Pairs of tokens whose compatibility a worker remembers.
_PAIRS = 100_000
_PAIR_BITS = 20
_ID = np.dtype("<u4")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in printable}
    for i, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + i)
    return [letters[b] for b in range(256)]


class Memory(dict):
    """A mapping of strings to bytes that keeps between one and two generations of ``limit`` bytes."""

    def __init__(self, make: Callable[[str], bytes], limit: int = MEMORY_BYTES):
        super().__init__()
        self.make = make
        self.limit = limit
        self.held = 0
        self.old: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.keep(key, value)
        return value

    def keep(self, key: str, value: bytes) -> None:
        if len(key) <= _LONGEST:
            if self.held >= self.limit:
                self.old = dict(self)
                self.clear()
                self.held = 0
            self[key] = value
            self.held += _ENTRY_BYTES + len(key) + len(value)


class WordTable:
    """What strings become, as Arrow arrays in which many are looked up at once.

    Beyond ``limit`` bytes only those looked up last are kept, and none if these alone take more.
    """

    def __init__(self, make: Callable[[str], bytes], limit: int):
        self.make = make
        self.limit = limit
        self.words, self.values = pa.array([], pa.string()), pa.array([], pa.large_binary())

    def find(self, words: pa.StringArray) -> pa.LargeBinaryArray:
        """The bytes of some different strings."""
        at = pc.index_in(words, value_set=self.words)
        new = at.is_null()
        missing = words.filter(new)
        places = at.fill_null(0).to_numpy().copy()
        places[new.to_numpy(zero_copy_only=False)] = len(self.words) + np.arange(len(missing))
        made = pa.array([self.make(w) for w in missing.to_pylist()], pa.large_binary())
        every = pa.concat_arrays([self.values, made])
        found = every.take(pa.array(places))
        for kept in (pa.concat_arrays([self.words, missing]), every), (words, found), (words[:0], found[:0]):
            if kept[0].nbytes + kept[1].nbytes <= self.limit:
                self.words, self.values = kept
                break
        return found


def chunks(text: str | None) -> list[str]:
    """The runs of a text between white space. No pre-token and no special token spans white space."""
    if not text:
        return []
    return _GAPS.split(text) if _ODD_GAPS.search(text) else text.split()


def _is_plain(text: str) -> bool:
    """Whether a text has none of ``_NOT_PLAIN``; of ASCII and Latin-1 it is seen faster than by the pattern."""
    if "<" in text:
        return False
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return not _NOT_PLAIN.search(text)


def _plain_pattern(pattern: str) -> re.Pattern | regex.Pattern:
    """The pattern for lower-case plain texts. The usual one is spelled out for their few letters, digits and spaces, which ``re`` finds faster."""
    if pattern != _USUAL:
        return regex.compile(pattern)
    for kind in _KINDS.values():
        pattern = pattern.replace(kind, "".join(re.escape(c) for c in _plain_letters() if regex.match(kind, c)))
    return re.compile(pattern)


def _plain_letters() -> list[str]:
    """The characters of lower-case plain texts."""
    return sorted({c for i in range(ord(_LATIN_END)) for c in chr(i).lower()})


def _kind_table() -> np.ndarray:
    """The kind of each code point below U+10000, as far as lower-case plain texts have it."""
    table = np.full(1 << 16, _SIGN, np.uint8)
    for c in _plain_letters():
        for kind, name in _KINDS.items():
            if regex.match(name, c):
                table[ord(c)] = kind
    return table


def cut(data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pre-tokens and runs of spaces of lower-case plain UTF-8 texts start and the last one ends, and which are no spaces.

    It cuts as ``_USUAL`` does: a new kind of character starts a run, every number is one by itself, and an apostrophe that
    starts a run of signs is one with an ending after it. The texts must end in a space, which must stand between any two.
    """
    kinds = table[data]
    lead = np.flatnonzero(data >= 0xC0)
    for low, length in (0xC0, 2), (0xE0, 3):
        at = lead[(data[lead] >= low) & (data[lead] < low + 0x20)]
        points = data[at].astype(np.uint16) & (0xFF >> length + 1)
        for i in range(1, length):
            points = points << 6 | data[at + i] & 0x3F
        for i in range(length):
            kinds[at + i] = table[points]
    first = np.ones(len(data) + 1, bool)
    np.not_equal(kinds[1:], kinds[:-1], out=first[1:-1])
    numbers = np.flatnonzero(kinds == _NUMBER)
    first[numbers[data[numbers] & 0xC0 != 0x80]] = True
    marks = np.flatnonzero(data == ord("'"))
    marks = marks[first[marks]]
    for ending in _ENDINGS:
        at = marks
        for i, letter in enumerate(ending, 1):
            at = at[data[at + i] == letter]  # only the last byte, a space, has none after it
        first[at + 1] = False
        first[at + 1 + len(ending)] = True
    starts = np.flatnonzero(first).astype(np.int32)
    return starts, kinds[starts[:-1]] != _SPACE


class Words:
    """Cuts texts into pre-tokens as a ``tokenizers`` file does, and remembers what each becomes.

    The file must lower-case, use word ends over byte letters and have no decoder.
    """

    def __init__(self, spec: bytes, memory: int = MEMORY_BYTES):
        self.file = json.loads(spec)
        steps = [n["type"] for n in self.file["normalizer"]["normalizers"]]
        with_ends = self.file["model"].get("end_of_word_suffix") == _WORD_END
        if steps != ["NFC", "Replace", "Lowercase"] or not with_ends or self.file["decoder"]:
            raise ValueError("not a lower-casing BPE file with word ends and without a decoder")
        pattern = self.file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(pattern)
        self.plain_pattern = _plain_pattern(pattern)
        self.split = Split(Regex(pattern), "removed", invert=True)
        self.special = {t["content"]: t["id"] for t in self.file["added_tokens"]}
        self.special_cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        # Pre-tokens have one memory, and chunks of texts that are not plain another.
        self.plain_ids = Memory(self.encode_word, memory)
        self.chunk_ids = Memory(self._encode_chunk, memory // 4)
        # Pre-tokens of plain texts that are encoded together have a table.
        self.table = WordTable(self.encode_word, memory // 4)
        self.kinds = _kind_table() if pattern == _USUAL else None
        self._normalizer = None

    def library(self, with_model: bool) -> Tokenizer:
        """The library's tokenizer, or its normalizer and splitter alone, which take little memory."""
        model = {} if with_model else {"model": {**self.file["model"], "vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None}
        return Tokenizer.from_str(json.dumps({**self.file, **model}))

    def encode_word(self, word: str) -> bytes:
        raise NotImplementedError

    def _pre_tokens(self, piece: str) -> list[str]:
        """The pre-tokens of a piece. Beyond the Latin letters, what counts as a letter depends on
        the Unicode version, so the library's own normalizer and pre-tokenizer say it."""
        plain = piece.isascii()
        if plain or max(piece) < _LATIN_END:
            piece = (piece if plain else unicodedata.normalize("NFC", piece)).lower()
            if piece.isalpha():
                return [piece]
            # One sign or digit after letters is a pre-token of its own.
            return [piece[:-1], piece[-1]] if piece[:-1].isalpha() else self.pattern.findall(piece)
        if self._normalizer is None:
            self._normalizer = self.library(False).normalizer
        piece = self._normalizer.normalize_str(piece)
        return [piece[a:b] for _, (a, b) in self.split.pre_tokenize_str(piece)]

    def _encode_chunk(self, chunk: str) -> bytes:
        out = []
        for i, piece in enumerate(self.special_cut.split(chunk) if "<" in chunk else [chunk]):
            if i % 2:
                out.append(np.array([self.special[piece]], _ID).tobytes())
            elif piece:
                out.extend(map(self.plain_ids.__getitem__, self._pre_tokens(piece)))
        return b"".join(out)

    def encode_bytes(self, text: str | None) -> bytes:
        """The ids of a whole text, as ``tokenizers`` gives them without special tokens added, four bytes each.

        Letters below U+0250 have no other normal form than their own, so a text of these is lower-cased and cut at once.
        """
        if text and _is_plain(text):
            return b"".join(map(self.plain_ids.__getitem__, self.plain_pattern.findall(text.lower())))
        return b"".join(map(self.chunk_ids.__getitem__, chunks(text)))

    def encode_texts(self, texts: list[str | None]) -> list[bytes]:
        """The ids of some texts. Plain ones are cut together, and each of their different pre-tokens is looked up once."""
        plain = [i for i, t in enumerate(texts) if t and self.kinds is not None and _is_plain(t)]
        found = dict(zip(plain, self._encode_plain([texts[i].lower().encode() for i in plain]))) if plain else {}
        return [found[i] if i in found else self.encode_bytes(t) for i, t in enumerate(texts)]

    def _encode_plain(self, texts: list[bytes]) -> list[bytes]:
        data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        starts, is_word = cut(data, self.kinds)
        runs = pa.Array.from_buffers(pa.string(), len(is_word), [None, pa.py_buffer(starts), pa.py_buffer(data)])
        words = runs.filter(pa.array(is_word)).dictionary_encode()
        if not len(words):
            return [b""] * len(texts)
        ids = self.table.find(words.dictionary).take(words.indices)
        words_before = np.cumsum(np.append(False, is_word), dtype=np.int32)
        text_ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int32) - 1
        ends = np.frombuffer(ids.buffers()[1], np.int64)[words_before[np.searchsorted(starts, text_ends)]].tolist()
        view = memoryview(ids.buffers()[2])
        return [view[a:b].tobytes() for a, b in zip([0, *ends], ends)]

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), _ID)


class WordBpe(Words):
    """Encoder by prefix tables, and decoder."""

    def __init__(self, spec: bytes, memory: int = MEMORY_BYTES):
        super().__init__(spec, memory)
        vocabulary = self.file["model"]["vocab"]
        self.names = [""] * (max([*vocabulary.values(), *self.special.values()]) + 1)
        for name, number in [*vocabulary.items(), *self.special.items()]:
            self.names[number] = name
        self._build(self.file["model"])
        self.file["model"] = {**self.file["model"], "vocab": {}, "merges": []}  # not needed any more

    def _build(self, model: dict) -> None:
        """Number the tokens by the rank of their merge, single letters first."""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        made = {a + b for a, b in merges}
        letters = [t for t in model["vocab"] if t not in made]
        order = letters + [a + b for a, b in merges]
        if len(order) != len(model["vocab"]) or len(set(order)) != len(order):
            raise ValueError("a token has no merge, or several")
        rank = {t: i for i, t in enumerate(order)}
        self.packed = [np.array([model["vocab"][t]], _ID).tobytes() for t in order]
        self.left, self.right = list(range(len(order))), list(range(len(order)))
        self.joined: dict[int, int] = {}
        for a, b in merges:
            i = rank[a + b]
            self.left[i], self.right[i] = rank[a], rank[b]
            self.joined[rank[a] << _PAIR_BITS | rank[b]] = i
        self._compatible: dict[int, bool] = {}
        whole = [True] * len(letters)  # tokens that their own text encodes to
        for i in range(len(letters), len(order)):
            a, b = self.left[i], self.right[i]
            whole.append(whole[a] and whole[b] and self._test(a, b, i))
        byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        self.automaton = ahocorasick.Automaton()
        for i, token in enumerate(order):
            if whole[i]:
                ends = token.endswith(_WORD_END)
                units = "".join(chr(byte_of[c]) for c in (token[: -len(_WORD_END)] if ends else token))
                units = self._marked(units) if ends else units
                self.automaton.add_word(units, (i, len(units)))
        self.automaton.make_automaton()

    @staticmethod
    def _marked(units: str) -> str:
        """Units (one character for each byte) with the word end folded into the last."""
        return units[:-1] + chr(ord(units[-1]) + 256)

    def _test(self, a: int, b: int, limit: int) -> bool:
        """Whether no merge below ``limit`` joins text across the border of two tokens.

        The merges that made the tokens are undone, latest first, on the side where the
        latest happened; at each stage the two pieces at the border must not have a merge that comes sooner.
        """
        while True:
            if self.joined.get(a << _PAIR_BITS | b, limit) < limit:
                return False
            can_a, can_b = self.right[a] != a, self.left[b] != b
            if not can_a and not can_b:
                return True
            if can_a and (a > b or not can_b):
                limit, a = a, self.right[a]
            else:
                limit, b = b + 1, self.left[b]

    def compatible(self, a: int, b: int) -> bool:
        if len(self._compatible) >= _PAIRS:
            self._compatible.clear()
        known = self._compatible[a << _PAIR_BITS | b] = self._test(a, b, len(self.packed))
        return known

    def encode_word(self, word: str) -> bytes:
        units = self._marked(word.encode().decode("latin-1"))
        n = len(units)
        last, start = [-1] * n, [0] * n
        known = self._compatible.get
        for end, (token, length) in self.automaton.iter(units):
            if last[end] >= 0:
                continue
            before = end - length
            if before >= 0:
                a = last[before]
                if a < 0:
                    continue
                fits = known(a << _PAIR_BITS | token)
                if not (self.compatible(a, token) if fits is None else fits):
                    continue
            last[end], start[end] = token, before
        out, at = [], n - 1
        while at >= 0:
            out.append(self.packed[last[at]])
            at = start[at]
        out.reverse()
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """The names of the tokens joined by one space, special ones included."""
        return " ".join(map(self.names.__getitem__, ids.tolist()))


_loaded: dict[int, object] = {}


def once_per_worker(spec, make: Callable):
    """What ``make`` builds from a broadcast file, built once in each Python worker."""
    if (make, spec.value) not in _loaded:
        _loaded.clear()
        _loaded[make, spec.value] = make(spec.value)
    return _loaded[make, spec.value]


def id_lists(parts: list[bytes]) -> pa.ListArray:
    """The ids of some texts as lists, over one buffer."""
    ends = np.cumsum([0, *map(len, parts)]) // _ID.itemsize
    values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(parts))])
    return pa.ListArray.from_arrays(ends.astype(np.int32), values)


def _spec(df: DataFrame, path: str):
    """The tokenizer file, of a few megabytes, for all tasks."""
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode_batches(batches: Iterator[pa.RecordBatch], spec) -> Iterator[pa.RecordBatch]:
    bpe = once_per_worker(spec, WordBpe)
    for batch in text_slices(batches, limit=_CUT_BYTES):
        parts = bpe.encode_texts(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), id_lists(parts)], names=["doc_id", "ids"])


def decode_batches(batches: Iterator[pa.RecordBatch], spec) -> Iterator[pa.RecordBatch]:
    bpe = once_per_worker(spec, WordBpe)
    for batch in batches:
        ids = batch.column("ids")
        flat, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
        texts = [bpe.decode(flat[a:b]) for a, b in zip(ends, ends[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), ids, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"]
        )


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids`` for every row: the token ids of the whole text.

    A NULL or empty text has no ids. Rows may repeat, doc_id may be NULL, further
    columns are left out. Texts of any length are encoded whole.
    """
    spec = _spec(docs, path)
    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    return map_arrow(rows, lambda it: encode_batches(it, spec), "doc_id bigint, ids array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, decoded`` for rows of ``doc_id, ids``; NULL ids count as none."""
    spec = _spec(tokens, path)
    rows = tokens.select(F.col("doc_id").cast("bigint"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return map_arrow(rows, lambda it: decode_batches(it, spec), "doc_id bigint, ids array<int>, decoded string")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    for batch in batches:
        ids = batch.column("ids")
        flat, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
        names = [" ".join(map(str, flat[a:b].tolist())) for a, b in zip(ends, ends[1:])]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(np.diff(ends).astype(np.int64)),
                pa.array([hashlib.sha256(n.encode()).hexdigest() for n in names]),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in batch.column("decoded").to_pylist()]),
            ],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encoded, decoded and digested in one pass of each task."""
    spec = _spec(docs, path)
    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    return map_arrow(
        rows,
        lambda it: _digest(decode_batches(encode_batches(it, spec), spec)),
        "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    )
