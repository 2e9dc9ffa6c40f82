"""Near-duplicate embeddings by an inverted multi-index.

The halves of the unit vectors have codebooks of their own; their product is a grid of cells, and a
vector's two codes name its cell.  A query visits cells by the sum of its two half distances (the
multi-sequence order: a heap over the two sorted lists), as many as it takes for the target recall,
and is compared in double precision with all vectors there.

How many cells that is comes from a calibration: sample vectors are turned by just the angle of the
threshold, into random directions and along differences of sample vectors, and the rank of the
turned vector's cell in the order of its origin is noted; the larger need holds.  The codebooks and the calibration use a bounded sample; every vector is indexed
and every vector is a query.

Equal vectors are one from the start.  A task takes a row of the grid (one code of the left half), so a
query is sent there once for all the cells of the row that it visits.  Crowded rows are cut into blocks
of members and blocks of queries, and each pair of blocks is a task of bounded size that returns, for each row with a link, a
count and one link of a spanning forest, never the pairs.  A pair that only one side finds counts for
both and joins their components.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize

SAMPLE = 20_000
PROBES = 2_000
CELL = 256
MEMBERS, QUERIES = 4096, 8192
MAX_CODES = 1024


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k centres of the rows of x, by Lloyd's rounds from distinct rows."""
    rng = np.random.default_rng(seed)
    pool = np.unique(x, axis=0)
    centres = pool[rng.choice(len(pool), min(k, len(pool)), replace=False)]
    for _ in range(rounds):
        code = nearest(x, centres)
        total = np.zeros_like(centres)
        np.add.at(total, code, x)
        n = np.bincount(code, minlength=len(centres))
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to centres."""
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)[None], 0)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    for at in range(0, len(x), 4096):
        out[at : at + 4096] = distances(x[at : at + 4096], centres).argmin(1)
    return out


def multi_sequence(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int]]:
    """(i, j) in ascending order of left[i] + right[j]."""
    a, b = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    heap, seen = [(left[a[0]] + right[b[0]], 0, 0)], {(0, 0)}
    while heap:
        _, p, q = heapq.heappop(heap)
        yield int(a[p]), int(b[q])
        for u, v in ((p + 1, q), (p, q + 1)):
            if u < len(a) and v < len(b) and (u, v) not in seen:
                seen.add((u, v))
                heapq.heappush(heap, (left[a[u]] + right[b[v]], u, v))


class MultiIndex:
    """Two codebooks and the number of cells to visit."""

    def __init__(self, sample: np.ndarray, n: int, threshold: float, recall: float, seed: int = 7):
        self.half = sample.shape[1] // 2
        k = int(min(MAX_CODES, max(1, round(math.sqrt(n / CELL))), max(1, len(sample) // 8)))
        self.books = [k_means(sample[:, : self.half], k, seed), k_means(sample[:, self.half :], k, seed + 1)]
        self.visits = self._calibrate(sample, threshold, recall, seed + 2)

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return nearest(x[:, : self.half], self.books[0]), nearest(x[:, self.half :], self.books[1])

    def cell(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return i * len(self.books[1]) + j

    def _calibrate(self, sample: np.ndarray, threshold: float, recall: float, seed: int) -> int:
        """Cells to visit so that a neighbour at the threshold is met with a chance of `recall`."""
        rng = np.random.default_rng(seed)
        x = sample[rng.choice(len(sample), PROBES, replace=len(sample) < PROBES)]
        left, right = distances(x[:, : self.half], self.books[0]), distances(x[:, self.half :], self.books[1])
        isotropic = rng.normal(size=x.shape)
        # the sample's own spread may lie in a few directions, which the codebooks then resolve finely
        a = rng.integers(len(sample), size=len(x))
        b = (a + rng.integers(1, max(2, len(sample)), size=len(x))) % len(sample)
        need = 1
        for side in (isotropic, sample[a] - sample[b]):
            side -= (side * x).sum(1)[:, None] * x
            side /= np.maximum(np.linalg.norm(side, axis=1), 1e-300)[:, None]
            y = threshold * x + math.sqrt(max(0.0, 1 - threshold**2)) * side
            i, j = self.codes(y)
            at = left[np.arange(len(x)), i] + right[np.arange(len(x)), j]
            ranks = np.array([(left[q][:, None] + right[q][None] <= at[q]).sum() for q in range(len(x))])
            need = max(need, int(np.quantile(ranks, recall, method="higher")))
        return need

    def visited(self, x: np.ndarray) -> list[list[int]]:
        """The cells that each row of x visits, nearest first; its own is among them."""
        left, right = distances(x[:, : self.half], self.books[0]), distances(x[:, self.half :], self.books[1])
        own = self.cell(*self.codes(x)).tolist()
        out = []
        for a, b, home in zip(left, right, own, strict=True):
            cells = []
            for i, j in multi_sequence(a, b):
                cells.append(i * len(b) + j)
                if len(cells) >= self.visits:
                    break
            out.append(cells if home in cells else [*cells, home])
        return out


def _unit(v: list | None) -> np.ndarray | None:
    """The unit vector in double precision; None if there is no direction."""
    if v is None or not v or any(x is None for x in v):
        return None
    x = np.array(v, np.float64)
    if not np.isfinite(x).all():
        return None
    top = np.abs(x).max()
    if not top:
        return None
    x = x / top  # so that squares neither vanish nor overflow
    return x / np.linalg.norm(x) + 0.0


def units_of(raw: np.ndarray) -> np.ndarray:
    """The unit vectors of rows, in double precision; each row's depends on that row alone."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)) + 0.0


def compare(ids: np.ndarray, units: np.ndarray, weights: np.ndarray, cells: list[list[int]], query_ids: np.ndarray, queries: np.ndarray, query_weights: np.ndarray, homes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For queries and members of found links: (id, linked rows, smallest id of the part).

    cells are those the members visit, homes those of the queries: a member counts only the queries
    that it does not find by its own visits, so that a pair counts once for each end.
    """
    link = queries @ units.T >= threshold
    order = np.argsort(ids)
    place = np.minimum(np.searchsorted(ids, query_ids, sorter=order), len(ids) - 1)
    itself = np.flatnonzero(ids[order[place]] == query_ids)
    link[itself, order[place[itself]]] = False
    # few rows have links: all that follows looks at these alone
    finds, met = np.flatnonzero(link.any(1)), np.flatnonzero(link.any(0))
    if not len(finds):
        return (np.empty(0, np.int64),) * 3
    other = link[np.ix_(finds, met)]
    query_ids, ids = query_ids[finds], ids[met]
    joint = other | (query_ids[:, None] == ids[None])
    q, m = query_ids.copy(), ids.copy()
    far = np.iinfo(np.int64).max
    while True:
        q2 = np.minimum(q, np.where(joint, m[None], far).min(1))
        m2 = np.minimum(m, np.where(joint, q2[:, None], far).min(0))
        if (q2 == q).all() and (m2 == m).all():
            break
        q, m = q2, m2
    known, at = np.unique(homes[finds], return_inverse=True)
    flat = np.concatenate([np.asarray(cells[i], np.int64) for i in met])
    owner = np.repeat(np.arange(len(met)), [len(cells[i]) for i in met])
    spot = np.minimum(np.searchsorted(known, flat), len(known) - 1)
    visits = np.zeros((len(known), len(met)), bool)
    visits[spot[known[spot] == flat], owner[known[spot] == flat]] = True
    node, first, at_node = np.unique(np.concatenate([query_ids, ids]), return_index=True, return_inverse=True)
    n = np.zeros(len(node), np.int64)
    np.add.at(n, at_node, np.concatenate([other @ weights[met], query_weights[finds] @ (other & ~visits[at])]))
    least = np.concatenate([q, m])[first]
    told = (n > 0) | (least != node)
    return node[told], n[told], least[told]


def near_vectors(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.999, embedding: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, n_links, component_id, kept) of each row; key must be bigint.

    Links join rows whose vectors have a cosine of `threshold` or more; n_links counts the other rows
    that a row is linked to, equal vectors included. A link that either side finds is one of both. Vectors that are null, empty or zero or hold a
    null or non-finite component, and rows with a null key, link with nothing (component the key
    itself). Of vectors of unequal length, the shorter count as padded with zeros. A repeated row is
    another row. Other columns don't matter, an empty table gives no rows.
    """

    # vectors travel as they were given, in single precision if that is what they are in, and become
    # unit vectors in double precision wherever they are compared
    single = "float" in vectors.schema[embedding].dataType.simpleString()
    kind, width = ("<f4", 4) if single else ("<f8", 8)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(1).to_pylist()
            units = [_unit(v) for v in given]
            raw = [None if u is None else np.array(v, kind).tobytes().rstrip(b"\0").ljust(width, b"\0") for u, v in zip(units, given, strict=True)]
            marks = [None if u is None else hashlib.sha256(u.astype("<f8").tobytes().rstrip(b"\0")).digest() for u in units]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array(marks, pa.binary())], ["key", "raw", "h"])

    rows = vectors.select(F.col(f"`{key}`").alias("key"), F.col(f"`{embedding}`").alias("e")).mapInArrow(read, "key long, raw binary, h binary")
    rows = materialize(rows, "vectors")
    sets = rows.where("raw is not null and key is not null").groupBy("h").agg(F.min("key").alias("node"), F.count("*").alias("weight"), F.min("raw").alias("raw"))
    sets = materialize(sets, "distinct")
    size = sets.agg(F.count("*").alias("n"), F.max(F.length("raw")).alias("bytes")).first()
    dim = -(-(size["bytes"] or 0) // (2 * width)) * 2  # even

    def matrix(column: pa.Array) -> np.ndarray:
        return units_of(np.frombuffer(b"".join(u.ljust(width * dim, b"\0") for u in column.to_pylist()), kind).reshape(-1, dim))

    if not size["n"]:
        links = sets.selectExpr("node", "0L as n", "node as least").limit(0)
    else:
        sample = matrix(pa.array([bytes(r[0]) for r in sets.orderBy("h", "node").limit(SAMPLE).select("raw").collect()], pa.binary()))
        index = MultiIndex(sample, size["n"], threshold, recall)
        columns = len(index.books[1])
        spot = pa.struct([("row", pa.int32()), ("columns", pa.list_(pa.int32()))])

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column(2))
                home, cells, spots = index.cell(*index.codes(x)), index.visited(x), []
                for found in cells:
                    by: dict[int, list[int]] = {}
                    for c in found:
                        by.setdefault(c // columns, []).append(c % columns)
                    spots.append([{"row": r, "columns": js} for r, js in by.items()])
                out = [pa.array(home, pa.int32()), pa.array(cells, pa.list_(pa.int32())), pa.array(spots, pa.list_(spot))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *out], ["node", "weight", "raw", "home", "cells", "spots"])

        placed = sets.select("node", "weight", "raw").mapInArrow(place, "node long, weight long, raw binary, home int, cells array<int>, spots array<struct<row:int,columns:array<int>>>")
        placed = materialize(placed, "cells")
        # a row of the grid is one code of the left half: a query goes there once for all its cells in it
        none = F.lit(None).cast("array<int>")
        members = placed.select(F.floor(F.col("home") / columns).cast("int").alias("row"), "node", "weight", "raw", "home", "cells", none.alias("columns"))
        queries = placed.select(F.explode("spots").alias("spot"), "node", "weight", "raw", "home").select("spot.row", "node", "weight", "raw", "home", none.alias("cells"), "spot.columns")
        count = lambda df, block, name: df.groupBy("row").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
        sizes = F.broadcast(count(members, MEMBERS, "mb").join(count(queries, QUERIES, "qb"), "row"))  # at most MAX_CODES rows
        # members go to every block of queries and queries to every block of members
        own = lambda n: F.expr(f"cast(pmod(xxhash64(node), {n}) as int)")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        rest = ("node", "weight", "raw", "home", "cells", "columns")
        tasks = members.join(sizes, "row").select("row", own("mb").alias("m"), every("qb").alias("q"), *rest).union(queries.join(sizes, "row").select("row", every("mb").alias("m"), own("qb").alias("q"), *rest))

        def verify(table: pa.Table) -> pa.Table:
            member = np.array([v is None for v in table.column("columns").to_pylist()]) if table.num_rows else np.empty(0, bool)
            weight, home, node = (table.column(c).to_numpy() for c in ("weight", "home", "node"))
            found: list[tuple] = []
            if member.any() and not member.all():
                x = matrix(table.column("raw"))
                cells = table.column("cells").to_pylist()
                place, asked = np.flatnonzero(member), np.flatnonzero(~member)
                visits = table.column("columns").filter(pa.array(~member)).to_pylist()
                flat = np.concatenate([np.asarray(v, np.int64) for v in visits])
                owner = np.repeat(asked, [len(v) for v in visits])
                for j in np.unique(home[place] % columns):
                    m, q = place[home[place] % columns == j], owner[flat == j]
                    if len(q):
                        found.append(compare(node[m], x[m], weight[m], [cells[i] for i in m], node[q], x[q], weight[q], home[q], threshold))
            ids, n, least = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
            return pa.table({"node": pa.array(ids, pa.int64()), "n": pa.array(n, pa.int64()), "least": pa.array(least, pa.int64())})

        links = tasks.groupBy("row", "m", "q").applyInArrow(verify, "node long, n long, least long")
    links = materialize(links, "links")
    parts = connected_components(links.select(F.col("node").alias("a"), F.col("least").alias("b")), "vector-links")
    per_node = sets.select("h", "node", "weight").join(links.groupBy("node").agg(F.sum("n").alias("n")), "node", "left").join(parts, "node", "left")
    out = rows.select("key", F.when(F.col("key").isNotNull(), F.col("h")).alias("h")).join(per_node, "h", "left")
    return out.select(
        F.col("key").alias(key),
        F.coalesce(F.coalesce("n", F.lit(0)) + F.col("weight") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "node", "key").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
