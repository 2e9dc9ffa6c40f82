"""Quality scores by a regularised quadratic discriminant.

Every text becomes a short vector of transformed statistics (logarithms of sizes, square roots of
shares).  The classes' means and covariances come from one pass of sums over all labelled rows;
each covariance is shrunk towards the pooled one and towards the diagonal.  A score is the logistic
of the difference of the two log densities, from Mahalanobis distances by Cholesky factors that are
computed once and sent with the task, plus the log of the class shares.

Only the text enters a vector: no label, language, source or id does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

FEATURES = ("words", "word_length", "symbols", "exclamations", "capitals", "pipes", "distinct", "echoes", "repeated_lines", "stops", "digits", "line_length", "other_marks", "top_word")
_D = len(FEATURES)
#: Words added to the denominators of shares.
_PRIOR = 8


def _classes() -> np.ndarray:
    """byte -> row of a table of character classes."""
    groups = [b"#*$%&|<>", b"!", bytes(range(65, 91)), b"|", b".,;:?", b"0123456789", b"\"'()-/@_=+[]{}~^\\`", bytes(range(97, 123))]
    table = np.zeros((len(groups), 256), np.int64)
    for i, g in enumerate(groups):
        table[i, list(g)] = 1
    return table


_TABLE = _classes()


def features(text: str | None) -> list[float]:
    """The vector of one whole text; null and empty texts give zeros."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * _D
    symbols, exclaims, capitals, pipes, stops, digits, marks, small = (_TABLE @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256)).tolist()
    ink = sum(map(len, words))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    # shares of few words are drawn towards none, so that short texts aren't outliers
    shares, letters = n + _PRIOR, ink + 5 * _PRIOR
    return [
        math.log1p(n),
        math.log(ink / n),
        math.sqrt(symbols / letters),
        math.sqrt(exclaims / shares),
        math.sqrt(capitals / (capitals + small + 5 * _PRIOR)),
        math.sqrt(pipes / shares),
        math.log((len(counts) + _PRIOR) / shares),
        math.sqrt(sum(map(eq, words, words[1:])) / shares),
        math.sqrt((len(lines) - len(set(lines))) / (len(lines) + 1)),
        math.sqrt(stops / shares),
        math.sqrt(digits / letters),
        math.log(n / len(lines)),
        math.sqrt(marks / letters),
        math.sqrt(max(counts.values()) / shares),
    ]


def text_features(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, f0..fn double): one row per document, repeated rows too."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(1)], np.float64).reshape(-1, _D)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[:, i]) for i in range(_D))], ["key", *(f"f{i}" for i in range(_D))])

    schema = f"key {kind}, " + ", ".join(f"f{i} double" for i in range(_D))
    return docs.selectExpr(f"`{key}` as key", f"`{text}` as text").mapInArrow(run, schema)


@dataclass(frozen=True)
class Shrinkage:
    """How far a class covariance goes towards the pooled one, how far its off-diagonal part is
    damped, what is added to the diagonal (in pooled variances), and the scale of the log odds."""

    pooled: float = 0.15
    diagonal: float = 0.1
    floor: float = 0.1
    temperature: float = 4.0


@dataclass
class Discriminant:
    """Per class: mean and inverse Cholesky factor of standardised vectors, log determinant, log share."""

    shift: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray
    temperature: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """P(class 1) of each row."""
        z = (x - self.shift) / self.scale
        density = [c - 0.5 * np.square((z - m) @ f.T).sum(axis=1) for m, f, c in zip(self.means, self.factors, self.constants, strict=True)]
        odds = np.clip((density[1] - density[0]) / self.temperature, -700, 700)
        return 1 / (1 + np.exp(-odds))


def fit(counts: np.ndarray, sums: np.ndarray, products: np.ndarray, shrink: Shrinkage = Shrinkage()) -> Discriminant | None:
    """From per-class row counts, sums and sums of outer products; None unless both classes have rows."""
    if (counts < 1).any():
        return None
    total = counts.sum()
    shift = sums.sum(axis=0) / total
    scale = np.sqrt(np.maximum(np.diag(products.sum(axis=0)) / total - shift**2, 1e-12))
    means = (sums / counts[:, None] - shift) / scale
    covs = []
    for n, s, p in zip(counts, sums, products, strict=True):
        m = s / n
        covs.append((p / n - np.outer(m, m)) / np.outer(scale, scale))
    pooled = sum(n * c for n, c in zip(counts, covs, strict=True)) / total
    factors, constants = [], []
    for n, c in zip(counts, covs, strict=True):
        c = (1 - shrink.pooled) * c + shrink.pooled * pooled
        c = (1 - shrink.diagonal) * c + shrink.diagonal * np.diag(np.diag(c)) + shrink.floor * np.eye(len(c))
        low = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(low))
        constants.append(math.log(n / total) - np.log(np.diag(low)).sum())
    return Discriminant(shift, scale, means, np.array(factors), np.array(constants), shrink.temperature)


def train(vectors: DataFrame, labels: DataFrame, folds: int = 5, shrink: Shrinkage = Shrinkage()) -> Discriminant | None:
    """Fits on every labelled row outside the held-out fold (CRC-32 of the id as text, mod `folds`, is 0).

    labels: (doc_id, quality 0/1); rows with other or null qualities are left out, equal label rows
    count once, and a document's row counts as often as it occurs. The pass sums products in Spark
    and hands back two rows, whatever the input's size.
    """
    use = labels.where("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").alias("key"), F.col("quality").cast("int").alias("q")).distinct()
    use = use.where(F.crc32(F.col("key").cast("string").cast("binary")) % folds != 0)
    f = [F.col(f"f{i}") for i in range(_D)]
    pairs = [(i, j) for i in range(_D) for j in range(i, _D)]
    rows = vectors.join(use, "key").groupBy("q").agg(F.count("*").alias("n"), *(F.sum(x) for x in f), *(F.sum(f[i] * f[j]) for i, j in pairs)).collect()
    counts, sums, products = np.zeros(2), np.zeros((2, _D)), np.zeros((2, _D, _D))
    for r in rows:
        q = r[0]
        counts[q] = r[1]
        sums[q] = r[2 : 2 + _D]
        for (i, j), v in zip(pairs, r[2 + _D :], strict=True):
            products[q, i, j] = products[q, j, i] = v
    return fit(counts, sums, products, shrink)


def score(vectors: DataFrame, model: Discriminant | None, key: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    """(key, score, predicted) of each vector; without a model (a class has no labels) 0.5."""
    kind = vectors.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(_D)], axis=1)
            s = model.scores(x) if model is not None else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["key", "score", "predicted"])

    return vectors.select("key", *(f"f{i}" for i in range(_D))).mapInArrow(run, f"key {kind}, score double, predicted int").withColumnRenamed("key", key)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, shrink: Shrinkage = Shrinkage()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    Null and empty texts have the zero vector's score; null ids pass (held_out false), repeated rows
    get equal scores, other columns don't matter, an empty table gives no rows. The vectors are
    written once to the shared folder and read for training and for scoring.
    """
    vectors = materialize(text_features(docs), "vectors")
    model = train(vectors, labels, folds, shrink)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))
    return score(vectors, model, threshold=threshold).select("doc_id", held.alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, shrink: Shrinkage = Shrinkage()) -> DataFrame:
    """docs that score at least `threshold`, in the columns of docs, whatever their names.

    Null and empty texts have the zero vector's score; null keys, ties at the threshold (kept) and
    repeated rows are judged by their text alone, each row on its own; an empty table gives no rows.
    Without labels of both classes every row scores 0.5. Scores are made from the texts a second time,
    which costs less than writing vectors and texts side by side.
    """
    model = train(materialize(text_features(docs), "vectors"), labels, folds, shrink)
    kind = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column("text")], np.float64).reshape(-1, _D)
            s = model.scores(x) if model is not None else np.full(len(x), 0.5)
            yield batch.filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, kind)
