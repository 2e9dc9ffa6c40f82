"""Near-duplicate documents by MinHash with tensored banding.

Two small collections of `side` signatures, each the hash of `rows` minima, give side * side tables:
the key of table (i, j) is signature i of the one with signature j of the other.  That takes
2 * side * rows minima where as many plain bands would take side * side * 2 * rows.

Documents that share a key are candidates.  Only the smallest id of a bucket is linked to the rest,
first within each map task, so no bucket is ever gathered or paired up.  The connected parts of
these links are then checked on full shingle sets, in blocks that count all their intersections as
a matrix product; only a spanning forest of the true links leaves a task.  The blocks of a part of
up to PAIRED blocks are all compared with each other.  Of a larger one, every text goes into one
block, the blocks' representatives (one for each group found) into blocks of their own, and a part
that has become one group is done, whatever its size.  What is left is a chain of weak candidates:
its members are sketched again by more rows, which break it into smaller parts, and so on; after the
last of LEVELS all blocks of a part are compared, so no pair that meets in the tables is left out.

Documents with equal shingle sets are one from the start (by a 128-bit hash of the set).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, mark, materialize

U64 = np.uint64
#: Bytes that are hashed at a time; longer texts are taken in pieces cut at white space.
SPAN = 1 << 20
BLOCK_DOCS, BLOCK_SHINGLES, PAIRED = 512, 1_000_000, 8
#: Table keys that a worker makes at a time.
KEYS_AT_ONCE = 600_000
#: (rows, side) of the tables that break large parts up: they miss a pair of similarity 0.85 with a chance of 0.0005 % and 0.0006 %.
LEVELS = ((5, 22), (8, 40))
#: Parts of more than a block, up to which they are broadcast.
MAX_BROADCAST = 50_000


def _constants(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.int64).astype(U64) * U64(2) + U64(1)


_BYTE = _constants(11, 256)
_BYTE[[0x20, *range(0x09, 0x0E)]] = 0
_IS_WHITE = _BYTE == 0
_BASE, _STEP = _constants(12, 1)[0], _constants(13, 1)[0]
_LENGTH = _constants(14, 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_POWERS = np.ones(1, U64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.concatenate([np.ones(1, U64), np.full(max(64, n), _BASE, U64)]))
    return _POWERS


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word of lower-cased bytes."""
    if len(raw) > SPAN:
        out, at = [], 0
        while at < len(raw):
            end = min(len(raw), at + SPAN)
            while end < len(raw) and not _IS_WHITE[raw[end]]:
                end += 1
            out.append(_word_hashes(raw[at:end]))
            at = end
        return np.concatenate(out)
    return _word_hashes(raw)


def _word_hashes(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return np.empty(0, U64)
    inside = np.concatenate([[False], ~_IS_WHITE[b], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, U64)
    lengths = ends - starts
    place = np.arange(len(b)) - np.repeat(starts, np.diff(np.append(starts, len(b)))) if starts[0] == 0 else np.concatenate([np.zeros(starts[0], np.int64), np.arange(starts[0], len(b)) - np.repeat(starts, np.diff(np.append(starts, len(b))))])
    values = _BYTE[b] * _powers(int(place.max()) + 1)[place]
    return mix(np.add.reduceat(values, starts) + lengths.astype(U64))


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a whole text's word shingles; A-Z count as a-z, words are
    what stands between ASCII white space. Fewer words than `size`: one shingle of them all;
    none: empty."""
    words = word_hashes((text or "").encode("utf-8", "replace").lower())
    n = len(words)
    if not n:
        return words
    take = min(n, size)
    total = np.full(n - take + 1, _LENGTH[take % 64], U64)
    for k in range(take):
        total = total * _STEP + words[k : n - take + 1 + k]
    return np.unique(mix(total))


class Tensor:
    """The two collections of signatures."""

    def __init__(self, rows: int = 3, side: int = 12, seed: int = 5):
        self.rows, self.side = rows, side
        self.a, self.b = _constants(seed, 2 * side * rows), _constants(seed + 1, 2 * side * rows)
        self.left, self.right = _constants(seed + 2, side), _constants(seed + 3, side)
        self.fold = _constants(seed + 4, rows)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """2 * side values of a nonempty set."""
        low = None
        for at in range(0, len(hashes), 4096):
            part = (self.a[:, None] * hashes[None, at : at + 4096] + self.b[:, None]).min(axis=1)
            low = part if low is None else np.minimum(low, part)
        return mix((mix(low).reshape(-1, self.rows) * self.fold).sum(axis=1, dtype=U64))

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """n x (side * side) table keys of n signatures."""
        u, v = signatures[:, : self.side] * self.left, signatures[:, self.side :] * self.right
        return mix(mix(u)[:, :, None] + mix(v)[:, None, :] * U64(3)).reshape(len(signatures), -1)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == U64 else x, pa.int64())


def sketch(docs: DataFrame, text: str, key: str, size: int, tensor: Tensor, extra: str | None = None) -> DataFrame:
    """(key, n, h1, h2, sig binary[, extra]): set size, hash of the set, signatures of each row."""
    columns = [f"`{key}` as key", f"`{text}` as text"] + ([f"`{extra}` as extra"] if extra else [])
    kept = [f"{alias} {docs.schema[c].dataType.simpleString()}" for alias, c in (("key", key), ("extra", extra)) if c]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, h1, h2, sig = [], [], [], []
            for t in batch.column(1):
                s = shingles(t.as_py(), size)
                n.append(len(s))
                h1.append(int(s.sum(dtype=U64).view(np.int64)) if len(s) else 0)
                h2.append(int(mix(s ^ _BASE).sum(dtype=U64).view(np.int64)) if len(s) else 0)
                sig.append(tensor.signature(s).tobytes() if len(s) else None)
            out = [batch.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays(out + ([batch.column(2)] if extra else []), ["key", "n", "h1", "h2", "sig"] + (["extra"] if extra else []))

    return docs.selectExpr(*columns).mapInArrow(run, ", ".join([kept[0], "n long, h1 long, h2 long, sig binary", *kept[1:]]))


def _stars(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of (key, node) pairs: the distinct keys, their smallest nodes, and distinct (node, smallest) links."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    first = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, bool)
    least = nodes[first][np.cumsum(first) - 1] if len(keys) else nodes
    apart = nodes != least
    links = np.unique(np.stack([nodes[apart], least[apart]], axis=1), axis=0) if apart.any() else np.empty((0, 2), np.int64)
    return keys[first], nodes[first], links[:, 0], links[:, 1]


def candidate_links(sets: DataFrame, tensor: Tensor) -> DataFrame:
    """(a, b) links that join whatever shares a table key within a part. sets: (node long, sig binary, part long).

    A map task links the members of its own buckets and sends on one row a bucket, and each link as a
    bucket of its own; so however large a bucket is, it gets a row from each map task at most.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, KEYS_AT_ONCE // tensor.side**2)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                sigs = np.frombuffer(b"".join(part.column(1).to_pylist()), U64).reshape(part.num_rows, -1)
                nodes = part.column(0).to_numpy()
                keys = mix(tensor.keys(sigs) ^ part.column(2).to_numpy().view(U64)[:, None])
                keys, least, a, b = _stars(keys.ravel(), np.repeat(nodes, keys.shape[1]))
                own = mix(mix(a.view(U64)) + b.view(U64) * _STEP)
                yield pa.RecordBatch.from_arrays([_long(np.concatenate([keys, own, own])), _long(np.concatenate([least, a, b]))], ["bucket", "node"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if parts:
            _, _, a, b = _stars(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            yield pa.RecordBatch.from_arrays([_long(a), _long(b)], ["a", "b"])

    return sets.select("node", "sig", "part").mapInArrow(spread, "bucket long, node long").repartition("bucket").mapInArrow(gather, "a long, b long")


def true_links(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Spanning links (node, smallest node of its part) of the graph in which sets are linked when
    100 * intersection >= percent * union. Counts every pair, by matrix products."""
    k = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(k), sizes)
    shared = np.zeros((k, k), np.float32)
    few = max(2, min(8, k // 16))
    order = np.argsort(code, kind="stable")
    for c in range(2, few + 1):  # shingles of few sets: their pairs one by one
        held = owner[order[np.repeat(count == c, count)]].reshape(-1, c)
        for p in range(c):
            for q in range(p + 1, c):
                np.add.at(shared, (held[:, p], held[:, q]), 1)
    many = count > few
    number = np.cumsum(many) - 1
    use = many[code]
    rows, cols = owner[use], number[code[use]]
    step = max(1, 4_000_000 // k)
    product = np.zeros((k, k), np.float32)
    place = np.argsort(cols, kind="stable")
    rows, cols = rows[place], cols[place]
    for at in range(0, int(many.sum()), step):
        lo, hi = np.searchsorted(cols, [at, at + step])
        has = np.zeros((k, step), np.float32)
        has[rows[lo:hi], cols[lo:hi] - at] = 1
        product += has @ has.T
    links = np.empty((k, k), bool)
    for i in range(k):
        both = (shared[i] + shared[:, i] + product[i]).astype(np.int64)
        links[i] = both * 100 >= percent * (sizes[i] + sizes - both)
    np.fill_diagonal(links, False)
    out, left = [], np.ones(k, bool)
    for i in range(k):
        if left[i]:
            left[i] = False
            part, todo = [i], [i]
            while todo:
                new = np.flatnonzero(links[todo.pop()] & left)
                left[new] = False
                todo += new.tolist()
                part += new.tolist()
            least = int(ids[part].min())
            out += [(int(ids[j]), least) for j in part if ids[j] != least]
    return out


def _blocks(nodes: DataFrame, by: str) -> DataFrame:
    """Adds to (node, n, ...) nb, the number of blocks of a row's part `by`. Only parts of more than a
    block are joined back, so a part of any size is not dealt to one task unless they are many."""
    sizes = nodes.groupBy(by).agg(F.count("*").alias("k"), F.sum("n").alias("w"))
    sizes = sizes.select(by, F.greatest(F.ceil(F.col("k") / BLOCK_DOCS), F.ceil(F.col("w") / BLOCK_SHINGLES)).cast("int").alias("nb"))
    large = materialize(sizes.where("nb > 1"), "large-parts")
    if large.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        large = F.broadcast(large)
    return nodes.join(large, by, "left").withColumn("nb", F.coalesce("nb", F.lit(1)))


def _verified(blocks: DataFrame, percent: int, size: int) -> DataFrame:
    """(a, b, nb): spanning forests of the true links among the texts of each (part, p, q)."""

    def compare(table: pa.Table) -> pa.Table:
        nodes, sets, seen = [], [], set()
        for node, t in zip(table.column("node").to_pylist(), table.column("text"), strict=True):
            s = shingles(t.as_py(), size)
            if len(s) and (mark := (node, s.tobytes())) not in seen:
                seen.add(mark)
                nodes.append(node)
                sets.append(s)
        found = true_links(np.array(nodes, np.int64), sets, percent) if len(sets) > 1 else []
        a, b = ([x[i] for x in found] for i in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "nb": pa.array([table.column("nb")[0].as_py()] * len(found), pa.int32())})

    return blocks.groupBy("part", "p", "q").applyInArrow(compare, "a long, b long, nb int")


def _dealt(nb: str = "nb", salt: int = 0) -> F.Column:
    return F.expr(f"cast(pmod(xxhash64(node, {salt}), {nb}) as int)")


def _true_links(docs: DataFrame, members: DataFrame, percent: int, size: int, levels: tuple = LEVELS) -> list[DataFrame]:
    """Links (a, b) that connect whatever is linked within a part. docs: (node, text); members:
    (node, n, part), one row a node."""
    members = materialize(_blocks(members, "part"), "members")
    # sorted with spill on both sides, at every size
    texts = docs.join(members.hint("merge"), "node")
    rounds = bool(levels) and members.where(F.col("nb") > PAIRED).limit(1).count() > 0
    if rounds:
        texts = materialize(texts, "texts")
    # one block alone, with every other one, or (in rounds) on its own for now
    others = F.when(F.col("nb") > PAIRED, F.array("i")) if rounds else F.when(F.lit(False), F.array("i"))
    others = others.when(F.col("nb") > 1, F.filter(F.sequence(F.lit(0), F.col("nb") - 1), lambda j: j != F.col("i"))).otherwise(F.array("i"))
    pairs = texts.withColumn("i", _dealt()).withColumn("j", F.explode(others))
    local = _verified(pairs.select("part", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), "node", "text", "nb"), percent, size)
    if not rounds:
        return [local]
    local = materialize(local, "local")
    # there, a link is (member, smallest member of its group in the block)
    many = F.col("nb") > PAIRED
    large, texts = members.where(many).drop("nb"), texts.where(many).select("node", "text")
    grouped = materialize(large.join(local.where(many).select(F.col("a").alias("node"), F.col("b").alias("first")), "node", "left"), "grouped")
    # one member of each group found there, in blocks of their own; links again name the smallest
    least = _blocks(grouped.where("first is null").drop("first"), "part")
    across = texts.join(least.hint("merge"), "node").select("part", _dealt(salt=1).alias("p"), F.lit(0).alias("q"), "node", "text", "nb")
    across = materialize(_verified(across, percent, size), "across")
    # parts that are still several groups
    named = grouped.withColumn("first", F.coalesce("first", "node")).join(across.select(F.col("a").alias("first"), "b"), "first", "left")
    several = named.groupBy("part").agg(F.min(F.coalesce("b", "first")).alias("lo"), F.max(F.coalesce("b", "first")).alias("hi")).where("lo <> hi").select("part")
    several = materialize(several, "several")
    n = several.limit(MAX_BROADCAST + 1).count()
    links = [local, across]
    if n:
        left = materialize(large.join(F.broadcast(several) if n <= MAX_BROADCAST else several, "part", "left_semi"), "left")
        texts = materialize(texts.join(left.hint("merge"), "node"), "texts")
        tensor = Tensor(*levels[0])
        finer = sketch(texts, "text", "node", size, tensor, extra="part").withColumnRenamed("key", "node").withColumnRenamed("extra", "part")
        again = connected_components(candidate_links(finer, tensor), "candidates").withColumnRenamed("component", "part")
        links += _true_links(texts.select("node", "text"), left.drop("part").join(again, "node"), percent, size, levels[1:])
    return links


def near_duplicates(docs: DataFrame, percent: int = 85, size: int = 5, rows: int = 3, side: int = 12, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, component_id, kept) of each row of docs; key must be bigint.

    Links are 100 * intersection >= percent * union of shingle sets, confirmed on full sets; the
    tables miss a pair of similarity s with a chance of 1 - (1 - (1 - s**rows)**side)**2.

    Rows without words: size 0, linked with nothing. Null keys: component null, kept, linked with
    nothing. Repeated rows are alike; rows that share a key but not a text are judged each by its
    text, and texts whose smallest key is the same are one. Other columns don't matter, an empty
    table gives no rows. A key of another type is refused.
    """
    if (kind := docs.schema[key].dataType.simpleString()) != "bigint":
        raise TypeError(f"{key} is {kind}; near duplicates need a bigint key")
    tensor = Tensor(rows, side)
    sketches = materialize(sketch(docs, text, key, size, tensor), "sketches")
    sets = materialize(sketches.where("n > 0 and key is not null").groupBy("h1", "h2").agg(F.min("key").alias("node"), F.first("n").alias("n"), F.first("sig").alias("sig")), "sets")
    since = mark()
    parts = connected_components(candidate_links(sets.withColumn("part", F.lit(0).cast("long")), tensor), "candidates").withColumnRenamed("component", "part")
    members = parts.join(sets.groupBy("node").agg(F.sum("n").alias("n")), "node").select("node", "n", "part")
    texts = docs.select(F.col(f"`{key}`").alias("node"), F.col(f"`{text}`").alias("text")).where("node is not null")
    links = _true_links(texts, members, percent, size)
    links = reduce(DataFrame.union, [x.select("a", "b") for x in links])
    groups = connected_components(links, "links").withColumnRenamed("node", "rep")
    discard(docs.sparkSession, since)
    # a group of equal sets, however many rows it has, is one row here
    named = sets.select("h1", "h2", F.col("node").alias("rep")).join(groups, "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("component"))
    return (
        sketches.select("key", "n", "h1", "h2")
        .join(named, ["h1", "h2"], "left")
        .select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("key").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("key"))).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
    )


def drop_near_duplicates(docs: DataFrame, percent: int = 85, **options: int) -> DataFrame:
    """docs with one row of each group of near duplicates (its smallest doc_id), in the columns of
    docs. Repeated rows of a kept doc_id become one; rows with a null doc_id all stay."""
    kept = near_duplicates(docs, percent, **options).where("kept and doc_id is not null").select("doc_id").distinct()
    columns = [f"`{c}`" for c in docs.columns]
    one = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*columns)
    return one.union(docs.where("doc_id is null").select(*columns))
