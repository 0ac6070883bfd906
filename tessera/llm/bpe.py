"""Byte-pair encoding and decoding with a public vocabulary file.

``encode`` turns texts into token ids and ``decode`` turns ids back into text, both equal to
what the vocabulary file prescribes.  A word is encoded by the contiguous rank array: its
part ids and the ranks of adjacent pairs lie in two short arrays; the smallest rank is
found by a scan, the boundary behind it is deleted and only the two neighbouring ranks are
looked up anew.  The new words of some hundred texts do this in step, as the rows of two
matrices, each row losing one boundary a step.  Words beyond ``SHORT`` parts, where scanning
would be quadratic, take the same merges from a heap over a linked list.

Both run as Arrow batch functions: they are narrow (no shuffle), keep one bounded word
cache per Python worker and hold one batch at a time.

Cases: null text counts as empty (no tokens, empty decoding); texts of any length are
encoded whole; repeated rows stay repeated; an empty table gives an empty table; columns of
the input are kept, and an output name that is already taken raises ``ValueError``, as does a
vocabulary with another normaliser, splitter or decoder than the one modelled here.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

from tessera.llm.memory import trimmed

SHORT = 256
CACHE_WORDS = 50_000
_NONE = 1 << 30
#: A part that is in no pair; rows of the matrices that merge in step.
_PAD = (1 << 20) - 1
_ROWS = 4096

# Texts of these characters alone are normalised and split by Python itself; any other text
# takes the vocabulary file's own normaliser and splitter.  Left out are characters on which
# regular expression engines differ: separators, superscripts, fractions, ordinals.
_PLAIN = re.compile("[\x00-\x1b\x20-\x7f¡-©«-±´¶-¸»¿-įı-ž]*")
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    shifted = iter(range(256, 512))
    return [chr(b) if b in set(keep) else chr(next(shifted)) for b in range(256)]


# The normaliser and splitter that ``WordBpe.words`` models.
NORMALIZER = ["NFC", {"Regex": r"\s+"}, " ", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def check(j: dict) -> None:
    """Raise for a file whose coding this module does not model, rather than give other ids."""
    model, wrong = j["model"], []
    if model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
        wrong.append("model")
    steps = (j.get("normalizer") or {}).get("normalizers", [])
    if [x for n in steps for x in ([n["pattern"], n["content"]] if n["type"] == "Replace" else [n["type"]])] != NORMALIZER:
        wrong.append("normalizer")
    steps = (j.get("pre_tokenizer") or {}).get("pretokenizers", [])
    kinds = [n["type"] for n in steps]
    if kinds != ["Split", "ByteLevel"] or steps[0]["pattern"] != {"Regex": SPLIT} or (steps[0]["behavior"], steps[0]["invert"]) != ("Removed", True) or steps[1]["add_prefix_space"] or steps[1]["use_regex"]:
        wrong.append("pre_tokenizer")
    if j.get("decoder"):
        wrong.append("decoder")
    if any("<" not in t["content"] or any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")) for t in j["added_tokens"]):
        wrong.append("added_tokens")
    if wrong:
        raise ValueError(f"this vocabulary's {', '.join(wrong)} is not supported")


class WordBpe:
    """A vocabulary of merges with word ends, read from the text of its JSON file."""

    def __init__(self, spec: str):
        self.spec = spec
        j = json.loads(spec)
        check(j)
        model, vocab = j["model"], j["model"]["vocab"]
        end = model.get("end_of_word_suffix") or ""
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.final = [vocab[s + end] for s in symbols]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault(vocab[a] << 20 | vocab[b], r)
            self.made.append(vocab[a + b])
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.token = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for s, i in [*vocab.items(), *self.special.items()]:
            self.token[i] = s.encode()
        self.by_symbol = {s: b for b, s in enumerate(symbols)}
        # Pairs in ascending order, for many words at a time; the last one is larger than any.
        at = np.array(sorted(self.rank), dtype=np.int64)
        self.pairs = np.append(at, np.iinfo(np.int64).max)
        self.pair_rank = np.array([*map(self.rank.get, at.tolist()), _NONE], dtype=np.int32)
        self.made_of = np.array(self.made, dtype=np.int64)
        self.first = np.array([self.inner, self.final], dtype=np.int64)
        self.cache = _Cache(self.packed)
        self._tok = None

    # -- one word ---------------------------------------------------------------------

    def merge(self, word: bytes) -> list[int]:
        """Token ids of one word's UTF-8 bytes."""
        parts = [self.inner[b] for b in word]
        parts[-1] = self.final[word[-1]]
        return self.by_scan(parts) if len(parts) <= SHORT else self.by_heap(parts)

    def by_scan(self, parts: list[int]) -> list[int]:
        get, made = self.rank.get, self.made
        ranks = [get(a << 20 | b, _NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == _NONE:
                break
            i = ranks.index(best)
            parts[i] = made[best]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] << 20 | parts[i], _NONE)
            if i < len(ranks):
                ranks[i] = get(parts[i] << 20 | parts[i + 1], _NONE)
        return parts

    def by_heap(self, parts: list[int]) -> list[int]:
        get, made, n = self.rank.get, self.made, len(parts)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]

        def offer(i: int, j: int) -> None:
            if (r := get(parts[i] << 20 | parts[j])) is not None:
                heapq.heappush(queue, (r, i, parts[i], parts[j]))

        queue: list[tuple[int, int, int, int]] = []
        for i in range(n - 1):
            offer(i, i + 1)
        while queue:
            r, i, a, b = heapq.heappop(queue)
            j = right[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j], right[i] = made[r], -1, right[j]
            if right[j] >= 0:
                left[right[j]] = i
                offer(i, right[i])
            if left[i] >= 0:
                offer(left[i], i)
        return [p for p in parts if p >= 0]

    # -- many words -------------------------------------------------------------------

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pair = a << 20 | b
        at = np.searchsorted(self.pairs, pair)
        return np.where(self.pairs[at] == pair, self.pair_rank[at], _NONE)

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of words of at most ``SHORT`` bytes, those of like length in step."""
        out: list[bytes] = [b""] * len(words)
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        order = np.argsort(size, kind="stable")
        cuts = np.searchsorted(size[order], [1, 7, 10, 14, 20, 32, 64, 128, SHORT + 1])
        for a, b in zip(cuts, cuts[1:]):
            for at in range(a, b, _ROWS):
                self._in_step(words, order[at : min(at + _ROWS, b)], size, out)
        return out

    def _in_step(self, words: list[bytes], rows: np.ndarray, size: np.ndarray, out: list[bytes]) -> None:
        n = size[rows]
        text = np.frombuffer(b"".join(words[i] for i in rows.tolist()), dtype=np.uint8)
        parts = np.full((len(rows), n.max()), _PAD, dtype=np.int64)
        real = np.arange(parts.shape[1]) < n[:, None]
        last = np.zeros(real.shape, dtype=np.int64)
        last[np.arange(len(rows)), n - 1] = 1
        parts[real] = self.first[last[real], text]
        rank = self.ranks(parts[:, :-1], parts[:, 1:])
        while len(rows):
            done = np.ones(len(rows), dtype=bool) if not rank.shape[1] else rank.min(axis=1) == _NONE
            if done.any():
                ended = parts[done]
                held = ended != _PAD
                packed, ends = ended[held].astype("<u4").tobytes(), np.cumsum(held.sum(axis=1) * 4).tolist()
                for i, x, y in zip(rows[done].tolist(), [0, *ends], ends):
                    out[i] = packed[x:y]
                rows, parts, rank = rows[~done], parts[~done], rank[~done]
                if not len(rows):
                    return
            r, at = np.arange(len(rows)), rank.argmin(axis=1)
            parts[r, at] = self.made_of[rank[r, at]]
            keep = np.ones(parts.shape, dtype=bool)
            keep[r, at + 1] = False
            parts = parts[keep].reshape(len(rows), -1)
            keep = np.ones(rank.shape, dtype=bool)
            keep[r, at] = False
            rank = rank[keep].reshape(len(rows), -1)
            for there in (at - 1, at):
                ok = (there >= 0) & (there < rank.shape[1])
                i, j = r[ok], there[ok]
                rank[i, j] = self.ranks(parts[i, j], parts[i, j + 1])

    # -- one text ---------------------------------------------------------------------

    def words(self, text: str) -> list[str]:
        """The normalised words of a text that holds no special token."""
        if _PLAIN.fullmatch(text):
            return _WORDS.findall(text.lower())
        if self._tok is None:
            from tokenizers import Tokenizer

            self._tok = Tokenizer.from_str(self.spec)
        pieces = self._tok.pre_tokenizer.pre_tokenize_str(self._tok.normalizer.normalize_str(text))
        return [bytes(map(self.by_symbol.__getitem__, p)).decode() for p, _ in pieces]

    def packed(self, word: str) -> bytes:
        """Ids of one word of any length."""
        return array("I", self.merge(word.encode())).tobytes()

    def word(self, word: str) -> bytes:
        """Ids of one word of any characters."""
        out = self.cache.get(word) or self.cache.revived(word)
        if out is None:
            out = self.packed(word)
            if len(word) <= SHORT:
                self.cache[word] = out
        return out

    def learn(self, words: list[str]) -> None:
        """Put what short words lack in the cache there, all new ones merged in step."""
        self.cache.age()
        new = [w for w in words if w not in self.cache and len(w) <= SHORT // 4 and not self.cache.revived(w)]
        self.cache.update(zip(new, self.merge_many([w.encode() for w in new])))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if self.marks is None or "<" not in text:
            return b"".join(map(self.word, self.words(text)))
        return b"".join(self.special[p].to_bytes(4, "little") if p in self.special else b"".join(map(self.word, self.words(p))) for p in self.marks.split(text))

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """``encode`` of each text; the distinct words of plain ones are looked up once for all."""
        out: list[bytes] = [b""] * len(texts)
        plain = []
        for i, t in enumerate(texts):
            if _PLAIN.fullmatch(t) and not (self.marks and "<" in t and self.marks.search(t)):
                plain.append(i)
            else:
                out[i] = self.encode(t)
        if not plain:
            return out
        coded, last = plain_words(_BETWEEN.join(texts[i] for i in plain).lower().encode())
        words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        self.learn(words)
        packed = list(map(self.cache.__getitem__, words))
        del words, coded
        ids = np.frombuffer(b"".join(packed), dtype="<u4")
        # A slice has fewer than 2^31 ids: a text has fewer bytes, and a word no more ids than bytes.
        size = np.fromiter(map(len, packed), dtype=np.int32, count=len(packed)) // 4
        begin, length = np.cumsum(size, dtype=np.int32) - size, size[at]
        ends = np.cumsum(length, dtype=np.int32)
        where = np.repeat(begin[at] - ends + length, length)
        where += np.arange(len(where), dtype=np.int32)
        flat, ends = ids[where], np.append(0, ends)[last]
        for i, x, y in zip(plain, [0, *ends.tolist()], ends.tolist()):
            out[i] = flat[x:y].tobytes()
        return out

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 text of ids; the vocabulary has no decoder, so tokens are joined by a space."""
        a = array("I")
        a.frombytes(ids)
        return b" ".join(map(self.token.__getitem__, a))


#: Stands between plain texts, and in none.
_BETWEEN = "\x1c"
_SPACE, _LETTER, _DIGIT, _SIGN = range(4)
_KIND = np.full(256, _SIGN, dtype=np.uint8)
_KIND[[*range(9, 14), 32, 28]] = _SPACE
_KIND[[*range(97, 123), 0xC3, 0xC4, 0xC5]] = _LETTER
_KIND[48:58] = _DIGIT


def plain_words(text: bytes) -> tuple[pa.DictionaryArray, np.ndarray]:
    """What ``_WORDS`` finds in lower-case plain texts with ``_BETWEEN`` them, and how many words end with each text.

    All at once: a word begins where the kind of character changes and at every digit.  Of two
    bytes the first tells the kind, but for the signs of multiplication and division.
    """
    b = np.frombuffer(text + b"\x1c  ", dtype=np.uint8)
    kind = _KIND[b]
    second = np.flatnonzero((b & 0xC0) == 0x80)
    sign = second[(b[second - 1] == 0xC3) & ((b[second] == 0x97) | (b[second] == 0xB7))]
    kind[sign - 1] = _SIGN
    kind[second] = kind[second - 1]
    held = kind != _SPACE
    begins = np.append(True, kind[1:] != kind[:-1]) & held | (kind == _DIGIT)
    # An apostrophe that begins a word takes certain letters along.
    quote = np.flatnonzero((b == 0x27) & begins)
    one, two = b[quote + 1], b[quote + 2]
    short = np.isin(one, np.frombuffer(b"stmd", dtype=np.uint8))
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    taken = np.append(quote[short] + 1, quote[long] + 1)
    after = np.append(quote[short] + 2, quote[long] + 3)
    begins[taken] = False
    begins[after] |= kind[after] == _LETTER
    at = np.flatnonzero(begins)
    last = np.searchsorted(at, np.flatnonzero(b == 0x1C))
    offsets = np.append(np.flatnonzero(begins[held]), held.sum()).astype(np.int32)
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(b[held]))
    return words.dictionary_encode(), last


class _Cache(dict):
    """Ids by string, in two generations: what the younger one lacks is taken from the older before it is made."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make, self.older = make, {}

    def revived(self, key: str) -> bytes | None:
        if (out := self.older.get(key)) is not None:
            self[key] = out
        return out

    def __missing__(self, key: str) -> bytes:
        out = self.revived(key)
        if out is None:
            out = self.make(key)
            if len(key) <= SHORT:
                self[key] = out
        return out

    def forget(self) -> None:
        """Drop all words: a worker that waits for other stages' tasks must not hold them."""
        self.clear()
        self.older = {}

    def age(self) -> None:
        if len(self) > CACHE_WORDS:
            self.older = {}  # before the copy is made, not after
            self.older = dict(self)
            self.clear()


_LOADED: dict[int, WordBpe] = {}


def loaded(spec: str) -> WordBpe:
    """The vocabulary, built once for each Python worker."""
    key = hash(spec)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordBpe(spec)
    return _LOADED[key]


def read_vocabulary(path: str) -> str:
    """A vocabulary file's text; some megabytes, bounded by the vocabulary."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _added(df: DataFrame, *fields: T.StructField) -> T.StructType:
    taken = {c.lower() for c in df.columns} & {f.name.lower() for f in fields}
    if taken:
        raise ValueError(f"columns {sorted(taken)} are in the input already")
    return T.StructType([*df.schema.fields, *fields])


#: Rows and bytes of a batch that are in Python objects at a time.
_SLICE = 1024
_SLICE_BYTES = 1 << 19


def slices(b: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most so many rows, and so many bytes of text where a row has no more."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < b.num_rows:
        most = (ends[at - 1] if at else 0) + _SLICE_BYTES
        end = max(at + 1, min(at + _SLICE, int(np.searchsorted(ends, most, side="right"))))
        yield b.slice(at, end - at)
        at = end


def encode(df: DataFrame, spec: str, text: str = "text", ids: str = "token_ids", n: str = "n_tokens") -> DataFrame:
    """Add the token ids of ``text`` (packed little-endian unsigned 32-bit) and their number."""
    check(json.loads(spec))
    held = df.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(held.value)
        for whole in batches:
            for b in slices(whole, text):
                out = bpe.encode_many([t or "" for t in b.column(text).to_pylist()])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary()), pa.array([len(x) // 4 for x in out], pa.int64())], names=[*b.schema.names, ids, n])
        bpe.cache.forget()

    return df.mapInArrow(trimmed(run), _added(df, T.StructField(ids, T.BinaryType()), T.StructField(n, T.LongType())))


def decode(df: DataFrame, spec: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add the text that the packed token ids stand for."""
    held = df.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(held.value)
        for whole in batches:
            for b in slices(whole, ids):
                texts = pa.array([bpe.decode(x or b"") for x in b.column(ids).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*b.columns, pc.cast(texts, pa.string())], names=[*b.schema.names, out])

    return df.mapInArrow(run, _added(df, T.StructField(out, T.StringType())))
