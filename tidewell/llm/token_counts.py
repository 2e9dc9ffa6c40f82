"""Token counts by a dynamic programme over prefixes.

For byte-level BPE the last token of a prefix is settled by the prefixes before it: it is the one
vocabulary entry t that ends there and may follow the last token of the prefix without t.  Two
tokens may stand side by side if merging their joined bytes gives the two back.  So one pass over a
piece gives the exact number of tokens of each of its prefixes, and a text's prefix counts are those
of its pieces added up.  They answer "how many tokens has text[:i]" and "where must I cut for n
tokens" without encoding anything again.

Texts whose vocabulary does not number its entries in merge order are refused.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .bpe import Bpe, Cache, load_bpe, space_units
from .common import slices, vocabulary

_WHITE = regex.compile(r"\s+")
_CONTRACTION = regex.compile(r"'(?:re|ve|ll)")
#: Pairs of tokens and pieces of text whose result a worker keeps; units whose tables are joined at a time.
_PAIRS, CACHE_PIECES, CACHE_UNITS, BLOCK_UNITS = 1_000_000, 600_000, 1_200_000, 1 << 16


class PrefixCounter:
    """Prefix counts for one space-keeping vocabulary."""

    def __init__(self, bpe: Bpe):
        if bpe.wordy:
            raise ValueError("prefix counts need a vocabulary that keeps white space")
        self.bpe = bpe
        self.by_bytes: dict[bytes, int] = {}
        #: Position of each entry in merge order; bytes come first.
        self.order: dict[int, int] = {i: -1 for i in bpe.byte_id}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for (a, b), (rank, c) in bpe.ranks.items():
            if c not in self.order:
                self.order[c], self.parts[c] = rank, (a, b)
            self.merged[a, b] = self.order[c]
        for i in self.order:
            self.by_bytes[bytes(bpe.byte_of[ch] for ch in bpe.token[i])] = i
        #: The length of the longest entry that begins, or ends, in these three bytes.
        self.begun: dict[bytes, int] = {}
        self.reach: dict[bytes, int] = {}
        for entry in sorted(self.by_bytes, key=len):
            if len(entry) > 2:
                self.begun[entry[:3]] = self.reach[entry[-3:]] = len(entry)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.counted: Cache = Cache(lambda piece: self.piece(piece.encode("utf-8", "replace")), CACHE_PIECES)
        #: unit -> its prefix table without the 0 at its start, as native 32-bit numbers.
        self.units: Cache = Cache(lambda unit: array("i", self._unit(unit)[1:]).tobytes(), CACHE_UNITS)

    def adjacent(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b, joined, encode as just (a, b).

        They don't if some merge across the seam comes before the merges that build a and b
        are done. Undo the youngest of these again and again, and look at the seam each time.
        """
        key = (a, b)
        known = self.pairs.get(key)
        if known is None:
            order, parts, merged = self.order, self.parts, self.merged
            limit, before_right, known = 1 << 60, False, True
            while True:
                seam = merged.get((a, b))
                # a merge at the seam wins over one of the same rank to its right, not to its left
                if seam is not None and (seam < limit or (seam == limit and before_right)):
                    known = False
                    break
                ra, rb = order[a], order[b]
                if ra < 0 and rb < 0:
                    break
                if ra > rb:
                    limit, before_right, a = ra, False, parts[a][1]
                else:
                    limit, before_right, b = rb, True, parts[b][0]
            if len(self.pairs) >= _PAIRS:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def piece(self, raw: bytes) -> list[int]:
        """counts[i] = number of tokens of raw[:i], for one piece of the pattern."""
        counts, last = [0], [-1]
        find, adjacent, known, reach = self.by_bytes.get, self.adjacent, self.pairs.get, self.reach.get
        first = self.begun.get(raw[:3], 2)
        for end in range(1, len(raw) + 1):
            if end <= first and (whole := find(raw[:end])) is not None:  # an entry encodes as itself
                counts.append(1)
                last.append(whole)
                continue
            low = end - reach(raw[end - 3 : end], 2) if end > 3 else 1
            for start in range(low if low > 1 else 1, end):
                if (token := find(raw[start:end])) is not None:
                    before = last[start]
                    fits = known((before, token))
                    if fits or (fits is None and adjacent(before, token)):
                        counts.append(counts[start] + 1)
                        last.append(token)
                        break
        return counts

    def tables(self, text: str | None) -> Iterator[np.ndarray]:
        """The prefix table of a whole text in parts, its first 0 left out: entry i of all parts
        together is the exact number of tokens of text[: i + 1]. Null and empty texts have none.

        A part covers BLOCK_UNITS units, so a text of any length needs bounded memory here.
        """
        base, before = 0, ""
        for part in self.bpe.parts(text or ""):
            if part in self.bpe.special:
                # a special token that is cut short is ordinary text and may join what stands before it
                tail = space_units(before)[-1] if before else ""
                joined = base - (self._table(tail)[-1] if tail else 0)
                own = [joined + self._table(tail + part[:k])[-1] for k in range(1, len(part))]
                base += 1
                yield np.array([*own, base], np.int64)
                before = ""
                continue
            before = part
            units = space_units(part)
            for at in range(0, len(units), BLOCK_UNITS):
                found = list(map(self.units.__getitem__, units[at : at + BLOCK_UNITS]))
                table = np.frombuffer(b"".join(found), np.int32).astype(np.int64)
                sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 2
                totals = table[np.cumsum(sizes) - 1]
                ends = base + np.cumsum(totals)
                yield table + np.repeat(ends - totals, sizes)
                base = int(ends[-1])

    def prefixes(self, text: str | None) -> list[int]:
        """counts[i] = number of tokens of text[:i] encoded on its own, for each i in code points."""
        return [0, *(c for part in self.tables(text) for c in part.tolist())]

    def count(self, text: str | None) -> int:
        """Tokens of a whole text; null is empty."""
        total = 0
        for part in self.tables(text):
            total = int(part[-1])
        return total

    def budget(self, text: str | None, limit: int) -> tuple[int, int]:
        """(tokens of the text, the most code points whose every prefix fits in `limit` tokens)."""
        total = at = 0
        fits = -1
        for part in self.tables(text):
            if fits < 0:
                over = part > limit
                first = int(over.argmax())
                if over[first]:
                    fits = at + first
            at += len(part)
            total = int(part[-1])
        return total, at if fits < 0 else fits

    def _unit(self, unit: str) -> list[int]:
        """The table of one unit; without a run of white space or a quote it has no special tails."""
        if "'" in unit or unit[:2].isspace():
            return self._table(unit)
        first, *rest = self.bpe.words_of(unit)
        out = self._chars(first, self.piece(first.encode("utf-8", "replace"))) if not rest else list(self._by_char(first))
        for piece in rest:
            total = out[-1]
            out += [total + c for c in self._by_char(piece)[1:]]
        return out

    def _table(self, text: str) -> list[int]:
        """counts of one ordinary text's prefixes.

        Where a prefix ends inside a piece that the pattern would cut otherwise if the text ended
        there (a run of white space, a contraction), the tail that differs has its own programme.
        """
        out, total, at, k = [0], 0, 0, 0
        pieces = self.bpe.words_of(text)
        while k < len(pieces):
            piece = pieces[k]
            k += 1
            end = at + len(piece)
            run = _WHITE.match(text, at)
            if run and (run.end() > at + 1 or run.end() == end):
                # the whole run of white space: prefixes end in it as one piece
                out += [total + c for c in self._by_char(run.group())[1:]]
                total += self.counted[piece][-1]
                if end < run.end():  # the run gave up its last character to the next piece
                    word, seen = pieces[k], run.end() - end
                    k += 1
                    out += [total + c for c in self._by_char(word)[seen + 1 :]]
                    total += self.counted[word][-1]
                    end += len(word)
            else:
                counts = self._by_char(piece)
                if _CONTRACTION.fullmatch(piece):
                    counts[2] = 2  # cut short, the quote and the letter are two pieces
                out += [total + c for c in counts[1:]]
                total += counts[-1]
            at = end
        return out

    @staticmethod
    def _chars(piece: str, counts: list[int]) -> list[int]:
        """Of counts by byte, those at the ends of code points."""
        if len(counts) == len(piece) + 1:
            return counts
        following = piece.encode("utf-8", "replace")[1:] + b"\0"
        return [0, *(c for c, b in zip(counts[1:], following, strict=True) if b & 0xC0 != 0x80)]

    def _by_char(self, piece: str) -> list[int]:
        """counts[i] = tokens of piece[:i], i in code points."""
        return self._chars(piece, self.counted[piece])


@lru_cache(maxsize=2)
def load_counter(path: str) -> PrefixCounter:
    """One counter per file and worker."""
    return PrefixCounter(load_bpe(path))


def count_tokens(docs: DataFrame, vocab: str = "byte_bpe_50k.json", limit: int = 512, text: str = "text", key: str = "doc_id", prefixes: bool = False) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit, fits long[, prefix_tokens array<int>]) of each row.

    n_bytes is the text's length in UTF-8, over_limit is n_tokens > limit, fits the code points of
    the longest prefix of which no shorter one passes the limit, read from the text's prefix table.
    The table is made part by part; with `prefixes` the whole of it is returned, too:
    prefix_tokens[i] is the exact count of the text's first i code points. Null and empty texts:
    zeros. Repeated rows stay, null keys pass, other columns don't matter. No shuffle; whole texts
    of any length.
    """
    path = vocabulary(vocab)
    kind = docs.schema[key].dataType.simpleString()
    names = ["key", "n_bytes", "n_tokens", "over_limit", "fits"] + ["prefix_tokens"] * prefixes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load_counter(path)
        for batch in (part for b in batches for part in (slices(b, 1) if prefixes else [b])):
            sizes, tokens, fits, tables = [], [], [], []
            for t in batch.column(1):
                s = t.as_py() or ""
                n, fit = counter.budget(s, limit)
                tokens.append(n)
                fits.append(fit)
                sizes.append(len(s) if s.isascii() else len(s.encode("utf-8", "replace")))
                if prefixes:
                    tables.append(counter.prefixes(s))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_()), pa.array(fits, pa.int64())]
            if prefixes:
                columns.append(pa.array(tables, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"key {kind}, n_bytes long, n_tokens long, over_limit boolean, fits long" + ", prefix_tokens array<int>" * prefixes
    return docs.selectExpr(f"`{key}` as key", f"`{text}` as text").mapInArrow(run, schema).withColumnRenamed("key", key)
