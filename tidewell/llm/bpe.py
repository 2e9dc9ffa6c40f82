"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

A word starts as one symbol per byte.  The tree's leaves hold the rank of each pair of neighbours;
an inner node holds the smallest (rank, position) below it, so the root names the leftmost
lowest-rank merge.  A merge changes three leaves, each in a logarithmic walk; the word is done
when the root holds no rank.  A word of n bytes takes O(n log n), however long it is.

Texts are cut where no token can cross (white space), and a chunk's ids are kept for the next time
it turns up in the same worker (at most CACHE_CHUNKS of them, the last ones).
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import slices, vocabulary

CACHE_CHUNKS = 600_000
_NONE = 1 << 62
#: The public pre-tokenization patterns of the two tokenizer kinds.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: str.split() and re's \s also take these for white space; Unicode's White_Space does not.
SEPARATORS = re.compile("[\x1c-\x1f]")

def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for
    itself, the rest count up from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = {b: chr(b) for b in plain}, 0x100
    for b in range(256):
        if b not in out:
            out[b] = chr(extra)
            extra += 1
    return [out[b] for b in range(256)]


def merge_symbols(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merges a word's symbols until no pair has a rank. ranks: pair -> (rank, merged symbol)."""
    n = len(symbols)
    if n < 2:
        return symbols
    if n == 2:
        hit = ranks.get((symbols[0], symbols[1]))
        return [hit[1]] if hit else symbols
    width = 1 << (n - 2).bit_length()
    tree = [_NONE] * (2 * width)
    get = ranks.get
    for i in range(n - 1):
        if hit := get((symbols[i], symbols[i + 1])):
            tree[width + i] = hit[0] << 32 | i
    for k in range(width - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))
    syms = list(symbols)

    def put(i: int, value: int) -> None:
        k = width + i
        if tree[k] == value:
            return
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            low = a if a < b else b
            if tree[k] == low:
                return
            tree[k] = low
            k >>= 1

    while (top := tree[1]) < _NONE:
        i = top & 0xFFFFFFFF
        j = right[i]
        syms[i] = get((syms[i], syms[j]))[1]
        syms[j] = -1
        after = right[i] = right[j]
        if j < n - 1:
            put(j, _NONE)
        if after < n:
            left[after] = i
            hit = get((syms[i], syms[after]))
            put(i, hit[0] << 32 | i if hit else _NONE)
        else:
            put(i, _NONE)
        if (before := left[i]) >= 0:
            hit = get((syms[before], syms[i]))
            put(before, hit[0] << 32 | before if hit else _NONE)
    return [s for s in syms if s >= 0]


class Bpe:
    """A byte-level BPE vocabulary of the `tokenizers` JSON layout, of either public kind:
    word ends marked by a suffix (lower case, white space dropped), or spaces kept in the tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.path, self.vocab = path, dict(model["vocab"])
        self.suffix = model.get("end_of_word_suffix") or ""
        self.wordy = bool(self.suffix)
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError(f"{path}: not a byte-level BPE of the two kinds supported")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.byte_decoder = spec.get("decoder") is not None
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.alphabet = byte_alphabet()
        self.byte_of = {c: b for b, c in enumerate(self.alphabet)}
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault((self.vocab[a], self.vocab[b]), (rank, self.vocab[a + b]))
        self.byte_id = [self.vocab[c] for c in self.alphabet]
        self.last_id = [self.vocab.get(c + self.suffix, -1) for c in self.alphabet]
        self.pattern = regex.compile(WORD_PATTERN if self.wordy else BYTE_PATTERN)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        #: A character of every special token.
        self.mark = max(set.intersection(*map(set, self.special)), default="") if self.special else ""
        self.words: dict[str, list[int]] = {}
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.model, self.cutter, self.normalizer = library.model, library.pre_tokenizer, library.normalizer
        #: Characters looked at so far, and those of them that the library may take for another kind of character.
        self.checked: set[str] = set(map(chr, range(128)))
        self.odd: set[str] = set()

    def is_odd(self, text: str) -> bool:
        """Whether the library, whose Unicode tables are of another version than Python's and regex's,
        may lower, compose or cut this text otherwise. Characters are tried on the library once each."""
        if not self.checked.issuperset(text):
            for c in set(text) - self.checked:
                self.checked.add(c)
                if self._differs(c):
                    self.odd.add(c)
        return not self.odd.isdisjoint(text)

    def _differs(self, c: str) -> bool:
        kind = unicodedata.category(c)
        if kind in ("Cn", "Cs") or (kind[0] == "M" and c > "\uffff"):
            return True
        if self.wordy and any(self.normalizer.normalize_str(x) != self.normalize(x) for x in (c, f"a\u0301{c}\u0323", f"a{c}\u0301")):
            return True
        return any(self._library_cut(x) != self.split_words(x) for x in map(self.normalize, (f"a{c}{c}1{c}!{c}", f"a{c}", f"aa{c}a", f" {c}a{c} ")))

    def _library_cut(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self.cutter.pre_tokenize_str(text)]

    def words_of(self, text: str) -> list[str]:
        """The normalized words or pieces of a text without special tokens, as the library cuts it."""
        if not text.isascii() and self.is_odd(text):
            return self._library_cut(self.normalizer.normalize_str(text) if self.wordy else text)
        return self.split_words(self.normalize(text))

    def normalize(self, text: str) -> str:
        """What the word-end kind does before it splits. Every letter is lowered on its own, so a
        final sigma is not special; white space is left for the pattern to drop."""
        if not self.wordy:
            return text
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def split_words(self, text: str) -> list[str]:
        """The pattern's pieces of a normalized text; all letters, or all but one mark, need no search."""
        if self.wordy and text:
            if text.isalpha():
                return [text]
            if text[:-1].isalpha() and not text[-1].isspace():
                return [text[:-1], text[-1]]
        return self.pattern.findall(text)

    def parts(self, text: str) -> list[str]:
        """Special tokens and what stands between them."""
        return self.cut.split(text) if self.cut and self.mark in text else [text]

    def encode_word(self, word: str) -> list[int]:
        """Ids of one piece of the pattern."""
        ids = self.words.get(word)
        if ids is None:
            raw = word.encode("utf-8", "replace")
            symbols = [self.byte_id[b] for b in raw]
            if self.wordy:
                symbols[-1] = self.last_id[raw[-1]]
            ids = merge_symbols(symbols, self.ranks)
            if len(self.words) >= CACHE_CHUNKS:
                self.words.clear()
            if len(word) <= 64:
                self.words[word] = ids
        return ids

    def encode_chunk(self, text: str) -> list[int]:
        """Ids of a text, special tokens taken out first as the library does by default."""
        out: list[int] = []
        for part in self.parts(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                for word in self.words_of(part):
                    out += self.encode_word(word)
        return out

    def chunks(self, text: str) -> list[str]:
        """Pieces of a text that can be encoded on their own."""
        if self.wordy:
            return text.split() if not SEPARATORS.search(text) else [c for c in regex.split(r"\s+", text) if c]
        return space_units(text)

    def encode(self, text: str | None) -> list[int]:
        """Ids as tokenizers' encode(text, add_special_tokens=False) gives them; null is empty."""
        return [i for c in self.chunks(text or "") for i in self.encode_chunk(c)]

    def decode(self, ids: list[int]) -> str:
        """As tokenizers' decode(ids, skip_special_tokens=False)."""
        if not self.byte_decoder:  # without a decoder the library joins tokens with a space
            return " ".join(self.token[i] for i in ids)
        out = bytearray()
        for i in ids:
            t = self.token[i]
            out += t.encode() if i in self.special.values() or any(c not in self.byte_of for c in t) else bytes(self.byte_of[c] for c in t)
        return out.decode("utf-8", "replace")


_RUN = regex.compile(r"\s*\S+|\s+")


def space_units(text: str) -> list[str]:
    """Cuts a text where the space-keeping pattern always cuts: before each run of white space."""
    if not text:
        return []
    first, *rest = text.split(" ")
    # as much white space as there are spaces, line breaks and gaps between words: each gap is one of them
    words, gaps = text.split(), len(rest) + text.count("\n")
    if len(words) != gaps + 1 or len(text) - sum(map(len, words)) != gaps:
        return _RUN.findall(text)
    return [first, *[" " + x for x in rest]]


@lru_cache(maxsize=4)
def load_bpe(path: str) -> Bpe:
    """One model per file and worker."""
    return Bpe(path)


class Cache(dict):
    """chunk -> make(chunk) of the last `limit` chunks or so; long ones aren't kept. A full half becomes
    the older one, whose chunks move back when they turn up again, and replaces the one before."""

    def __init__(self, make: Callable[[str], object], limit: int = CACHE_CHUNKS):
        super().__init__()
        self.make, self.half, self.older = make, limit // 2, {}

    def __missing__(self, chunk: str):
        value = self.older.pop(chunk, None)
        if value is None:
            value = self.make(chunk)
        if len(chunk) <= 64:
            if len(self) >= self.half:
                self.older = dict(self)
                self.clear()
            self[chunk] = value
        return value


@lru_cache(maxsize=4)
def _texts(path: str) -> Cache:
    """chunk -> (its ids as text, its decoded tokens as text)."""
    bpe = load_bpe(path)

    def make(chunk: str) -> tuple[str, str]:
        ids = bpe.encode_chunk(chunk)
        return " ".join(map(str, ids)), bpe.decode(ids)

    return Cache(make)


def encode_documents(docs: DataFrame, vocab: str = "word_bpe_49k.json", text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds `ids` array<int> and `decoded` string to docs, row by row (no shuffle).

    Null and empty texts: no ids, empty decoded text. Texts of any length are encoded whole.
    Every other column passes; columns already named `ids` or `decoded` are replaced.
    """
    path = vocabulary(vocab)
    rest = [c for c in docs.columns if c not in (ids, decoded)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_bpe(path)
        cache = Cache(bpe.encode_chunk)
        for batch in (part for b in batches for part in slices(b, b.schema.get_field_index(text))):
            found = [[i for c in bpe.chunks(t or "") for i in cache[c]] for t in batch.column(text).to_pylist()]
            back = [bpe.decode(x) for x in found]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(found, pa.list_(pa.int32())), pa.array(back, pa.string())], [*rest, ids, decoded])

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest]
    return docs.select(*[f"`{c}`" for c in rest]).mapInArrow(run, ", ".join([*kinds, f"`{ids}` array<int>", f"`{decoded}` string"]))


def encode_digests(docs: DataFrame, vocab: str = "word_bpe_49k.json", text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of each row: the digests of what
    encode_documents() returns, taken while the row is in hand so that no id leaves the worker.

    For vocabularies without a decoder, whose decoded text is their tokens joined by a space.
    Null and empty texts: 0 tokens and the digests of the empty string. Repeated rows stay.
    """
    path = vocabulary(vocab)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, cache = load_bpe(path), _texts(path)
        assert not bpe.byte_decoder
        get = cache.__getitem__
        for batch in batches:
            counts, shas, backs = [], [], []
            for t in batch.column(1):
                pairs = list(map(get, bpe.chunks(t.as_py() or "")))
                written = " ".join([p[0] for p in pairs if p[0]])
                counts.append(written.count(" ") + 1 if written else 0)
                shas.append(hashlib.sha256(written.encode()).hexdigest())
                backs.append(hashlib.sha256(" ".join([p[1] for p in pairs if p[0]]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(backs, pa.string())], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = docs.selectExpr(f"`{key}` as key", f"`{text}` as text").mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("key", key)
