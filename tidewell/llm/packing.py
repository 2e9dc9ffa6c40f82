"""Sum-of-squares packing of tokenized documents into sequences.

Each task packs the rows it reads, in order, so nothing is shuffled and no source or document can
become hot.  A document's full windows are cut off first; its rest goes where it leaves the sum of
squares of the numbers of partially filled windows, level by level, smallest.  These numbers are the
level array; one pass over it finds the level.  No more than `max_open` windows stay open: beyond
that, and at the end, the fullest are topped up with cut pieces of the emptiest.  What remains at the
end of a task is one window, cut into powers of two, which need no padding.
"""

from __future__ import annotations

import struct
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import SEPARATORS, Cache, load_bpe
from .common import vocabulary

CACHE_CHUNKS = 1_000_000
#: Bytes of pieces that a task holds before it hands them on.
OUT_BYTES = 4_000_000
#: (document key, start, length, document's tokens, ids as little-endian bytes)
Piece = tuple


class SumOfSquares:
    """Online packer. add() and finish() yield closed sequences, each a list of pieces."""

    def __init__(self, capacity: int = 4096, max_open: int = 512):
        self.capacity, self.max_open = capacity, max_open
        #: levels[h]: partially filled windows that hold h tokens; 0 and capacity are never partial.
        self.levels = np.zeros(capacity + 1, np.int64)
        self.windows: dict[int, deque[list[Piece]]] = {}
        self.n_open = 0

    def level_for(self, size: int) -> int:
        """The level (0: a new window) for `size` < capacity; the fullest of equals."""
        cap, n = self.capacity, self.levels
        from_level = n[: cap - size + 1]
        cost = 2 * (n[size:] - from_level)
        cost += 2  # n[h] - 1 and n[h + size] + 1, squared, against before
        cost[-1] = 1 - 2 * from_level[-1]  # a full window isn't partial
        cost = np.where(from_level > 0, cost, np.iinfo(np.int64).max)
        cost[0] = 2 * n[size] + 1
        return len(cost) - 1 - int(cost[::-1].argmin())

    def _take(self, level: int) -> list[Piece]:
        at = self.windows[level]
        window = at.popleft()
        if not at:
            del self.windows[level]
        self.levels[level] -= 1
        self.n_open -= 1
        return window

    def _put(self, level: int, window: list[Piece]) -> Iterator[list[Piece]]:
        if level == self.capacity:
            yield window
        elif level:
            self.levels[level] += 1
            self.windows.setdefault(level, deque()).append(window)
            self.n_open += 1

    def add(self, key: object, ids: bytes) -> Iterator[list[Piece]]:
        """Places one document's ids (little-endian, 4 bytes each)."""
        total, cap = len(ids) // 4, self.capacity
        whole = total // cap * cap
        for start in range(0, whole, cap):
            yield [(key, start, cap, total, ids[4 * start : 4 * (start + cap)])]
        if size := total - whole:
            level = self.level_for(size)
            window = self._take(level) if level else []
            window.append((key, whole, size, total, ids[4 * whole :]))
            yield from self._put(level + size, window)
            if self.n_open > self.max_open:
                yield from self.settle()

    def settle(self) -> Iterator[list[Piece]]:
        """Tops up the fullest windows with pieces of the emptiest until one is left."""
        order = deque((h, w) for h in sorted(self.windows, reverse=True) for w in self.windows[h])
        self.windows.clear()
        self.levels[:] = 0
        self.n_open = 0
        while len(order) > 1:
            level, window = order.popleft()
            while level < self.capacity and order:
                donor_level, donor = order.pop()
                key, start, size, total, ids = donor.pop()
                moved = min(size, self.capacity - level)
                window.append((key, start, moved, total, ids[: 4 * moved]))
                level += moved
                if moved < size:
                    donor.append((key, start + moved, size - moved, total, ids[4 * moved :]))
                if donor_level > moved:
                    order.append((donor_level - moved, donor))
            if level == self.capacity:
                yield window
            else:
                order.appendleft((level, window))
                break
        for level, window in order:
            yield from self._put(level, window)

    def finish(self) -> Iterator[list[Piece]]:
        """Closes all: full windows, and the last one as sequences of 2**k tokens."""
        yield from self.settle()
        for level in list(self.windows):
            for window in self.windows[level]:
                todo = deque(window)
                left = level
                while left:
                    room = 1 << (left.bit_length() - 1)
                    left -= room
                    out = []
                    while room:
                        key, start, size, total, ids = todo.popleft()
                        n = min(size, room)
                        out.append((key, start, n, total, ids[: 4 * n]))
                        room -= n
                        if n < size:
                            todo.appendleft((key, start + n, size - n, total, ids[4 * n :]))
                    yield out
        self.windows.clear()
        self.levels[:] = 0
        self.n_open = 0


@lru_cache(maxsize=2)
def _ids_of(path: str) -> Cache:
    """white-space-free chunk -> its ids as bytes. The merges are the tokenizers library's; the cut into
    words is ours, as the library's takes three times as long for one word."""
    own = load_bpe(path)
    byte, tokenize = own.alphabet, own.model.tokenize

    def make(chunk: str) -> bytes:
        ids: list[int] = []
        for part in own.cut.split(chunk):
            if part in own.special:
                ids.append(own.special[part])
                continue
            for word in own.words_of(part):
                if not (word.isascii() and word.isprintable()):
                    word = "".join([byte[b] for b in word.encode("utf-8", "replace")])
                ids += [x.id for x in tokenize(word)]
        return struct.pack(f"<{len(ids)}I", *ids)

    return Cache(make, CACHE_CHUNKS)


def text_ids(text: str | None, path: str, end_id: int) -> bytes:
    """A document's ids and the end id, as bytes. The vocabulary drops white space, so its chunks
    between white space stand alone; texts with separators that only Python takes for white space
    go to the library whole."""
    cache = _ids_of(path)
    text = text or ""
    body = cache.make(text) if SEPARATORS.search(text) else b"".join(map(cache.__getitem__, text.split()))
    return body + struct.pack("<I", end_id)


def pack_documents(docs: DataFrame, vocab: str = "word_bpe_49k.json", end_id: int = 2, capacity: int = 4096, max_open: int = 512, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per piece: (key, start, length, doc_tokens, sequence_id, offset, ids binary).

    start counts the document's ids before the piece, offset the sequence's; ids are little-endian
    unsigned 32-bit. Every id of a document and its end id lies in exactly one piece; sequences hold
    `capacity` ids, but for the last of a task, which are powers of two. sequence_id is the task's
    partition times 2**32 plus a running number, so a task that runs again gives the same rows.
    Null and empty texts are one end id. Repeated rows are packed as often as they occur, null keys
    pass, an empty table gives no rows, other columns don't matter.
    """
    path = vocabulary(vocab)
    kind = docs.schema[key].dataType.simpleString()
    names = ["key", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = SumOfSquares(capacity, max_open)
        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        rows: list[tuple] = []
        held = made = 0
        key_type = None

        def closed(sequences: Iterable[list[Piece]]) -> None:
            nonlocal held, made
            for window in sequences:
                offset = 0
                for k, start, n, total, ids in window:
                    rows.append((k, start, n, total, first + made, offset, ids))
                    offset += n
                    held += len(ids) + 64
                made += 1

        def batch_out() -> pa.RecordBatch:
            nonlocal held
            columns = list(zip(*rows, strict=True))
            out = pa.RecordBatch.from_arrays([pa.array(columns[0], key_type), *(pa.array(c, t) for c, t in zip(columns[1:], types, strict=True))], names)
            rows.clear()
            held = 0
            return out

        for batch in batches:
            key_type = batch.column(0).type
            for k, t in zip(batch.column(0), batch.column(1), strict=True):
                closed(packer.add(k.as_py(), text_ids(t.as_py(), path, end_id)))
                if held > OUT_BYTES:
                    yield batch_out()
        closed(packer.finish())
        if rows:
            yield batch_out()

    schema = f"key {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return docs.selectExpr(f"`{key}` as key", f"`{text}` as text").mapInArrow(run, schema).withColumnRenamed("key", key)


def piece_digests(pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    """pack_documents() with the ids as their CRC-32."""
    return pieces.select(key, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
