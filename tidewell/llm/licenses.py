"""License scans by diagonal voting.

Every text's rolling word k-gram hashes are joined with the positions of the same k-grams in the
templates.  A hit votes for the diagonal (word position minus template position); hits of a copy of
a template pile up on one diagonal, and an inserted or lost word moves the rest to a neighbouring
one.  Votes are summed by diagonal in Spark; then neighbouring diagonals of a document are merged
and each span is verified: a phrase must be there word for word, a notice to a stated share,
less for short notices, so that three inserted words and a lost one leave each its label.

Templates are phrases (hashed by 2 words) and notices (by 4).  They are the small side of the join
and broadcast only while they have at most MAX_BROADCAST positions.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from heapq import heappop, heappush
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .near_dup import SPAN, U64, _BASE, _BYTE, _STEP, _constants, _powers, mix

MAX_BROADCAST = 100_000
#: Grams of a text that go into one row.
CHUNK = 65_536
PHRASE_K, NOTICE_K = 2, 4
#: Grams of a notice that three inserted words and a lost one break, and the least share whatever is lost.
LOST, LEAST_SHARE = 3 * (NOTICE_K - 1) + NOTICE_K, 0.4

#: Phrases of the query's contract, with their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Further phrases that name a license.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "bsd license": "bsd",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "eclipse public license": "epl",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0": "cc0",
    "public domain": "public-domain",
    "unlicense org": "unlicense",
}

#: Public license notices.
NOTICES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software.""",
    "apache": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License.""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without
even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License
for more details.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "mpl": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means.""",
    "cc-by": """This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of
this license, visit http://creativecommons.org/licenses/by/4.0/""",
}

_TABLE = _BYTE.copy()
_TABLE[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = 0
_GAP = _TABLE == 0
_SALT = _constants(31, 8)
SENTINEL = 0x5E47


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    k: int
    base: bool = False

    @cached_property
    def n_words(self) -> int:
        return len(words(self.text))


def default_templates() -> list[Template]:
    return [*(Template(v, t, PHRASE_K, True) for t, v in BASE_PHRASES.items()), *(Template(v, t, PHRASE_K) for t, v in PHRASES.items()), *(Template(v, t, NOTICE_K) for v, t in NOTICES.items())]


def words(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word: runs of digits, letters a-z (capitals lowered) and non-ASCII characters."""
    raw = (text or "").encode("utf-8", "replace").lower()
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + SPAN)
        while end < len(raw) and not _GAP[raw[end]]:
            end += 1
        out.append(_words(np.frombuffer(raw, np.uint8, end - at, at)))
        at = end
    return np.concatenate(out) if out else np.empty(0, U64)


def _words(b: np.ndarray) -> np.ndarray:
    inside = np.concatenate([[False], ~_GAP[b], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, U64)
    begin = np.zeros(len(b), np.int64)
    begin[starts[1:]] = np.diff(starts)
    place = np.maximum(np.arange(len(b)) - starts[0] - np.cumsum(begin), 0)
    values = _TABLE[b] * _powers(int(place.max()) + 1)[place]
    return mix(np.add.reduceat(values, starts) + (ends - starts).astype(U64) * _BASE)


def grams(codes: np.ndarray, k: int) -> np.ndarray:
    """The rolling hashes of k words, one for each position that has k words from there."""
    n = len(codes) - k + 1
    if n < 1:
        return np.empty(0, np.int64)
    total = np.full(n, _SALT[k], U64)
    for i in range(k):
        total = total * _STEP + codes[i : i + n]
    return mix(total).view(np.int64)


def template_positions(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """(k, hash, template, at): every k-gram of every template."""
    rows = [(0, SENTINEL, -1, 0)]
    for i, t in enumerate(templates):
        if t.n_words < t.k:
            raise ValueError(f"template of fewer than {t.k} words: {t.text!r}")
        rows += [(t.k, int(h), i, at) for at, h in enumerate(grams(words(t.text), t.k))]
    df = spark.createDataFrame(rows, "k int, hash long, template int, at int")
    return F.broadcast(df) if len(rows) <= MAX_BROADCAST else df


def merge_spans(hits: Iterable[tuple[int, int, list[int]]], templates: list[Template], share: float, slack: int, lost: int = LOST) -> Iterator[tuple[int, int, int, float]]:
    """(template, first word, last word, share of its grams) of each verified span.

    hits: (template, diagonal, template positions), in order of template and diagonal. A phrase needs
    all of its grams on one diagonal. A notice's hits are taken in text order and cut where the
    diagonal moves by more than `slack` or the template starts over; a span counts with `share` of
    its grams, or, as a few edits cost a short notice more than that, with all but `lost` of them and
    LEAST_SHARE at least. What is held is bounded by the template, not by the number of hits.
    """
    for template, group in groupby(hits, key=lambda h: h[0]):
        t = templates[template]
        if t.k == PHRASE_K:
            for _, diagonal, at in group:
                if len(at) == t.n_words - t.k + 1:
                    yield template, diagonal, diagonal + t.n_words - 1, 1.0
        else:
            need = t.n_words - t.k + 1
            enough = min(share, max((need - lost) / need, LEAST_SHARE))
            for first, last, found in _runs(_votes((d, at) for _, d, at in group), need + slack, slack):
                if found / need >= enough:
                    yield template, first, last + t.k - 1, found / need


def _votes(diagonals: Iterable[tuple[int, list[int]]]) -> Iterator[tuple[int, int]]:
    """(word, template position) of diagonals in ascending order, by word."""
    waiting: list[tuple[int, int]] = []
    for diagonal, at in diagonals:
        while waiting and waiting[0][0] < diagonal:  # later diagonals begin at `diagonal` or after it
            yield heappop(waiting)
        for a in at:
            heappush(waiting, (diagonal + a, a))
    while waiting:
        yield heappop(waiting)


def _runs(votes: Iterable[tuple[int, int]], reach: int, slack: int) -> Iterator[tuple[int, int, int]]:
    """(first word, last word, distinct template positions) of each run of votes. A run that ends
    `reach` words before a vote can't go on."""
    runs: dict[int, list] = {}  # [first word, last word, last position, positions]
    ends: dict[int, int] = {}  # diagonal: the one run that ends there, as a vote on it always continues that run
    begun, sweep = 0, 0
    for word, a in votes:
        if word > sweep:
            for r in [r for r, run in runs.items() if run[1] + reach < word]:
                first, last, at, seen = runs.pop(r)
                if ends.get(last - at) == r:
                    del ends[last - at]
                yield first, last, len(seen)
            sweep = word + reach
        # the run whose end this vote continues: on the same or the nearest diagonal, further on in the template
        diagonal, best = word - a, None
        for move in range(slack + 1):
            near = [ends[d] for d in {diagonal - move, diagonal + move} if d in ends]
            near = [r for r in near if a > runs[r][2] and word > runs[r][1]]
            if near:
                best = min(near)
                break
        if best is None:
            best, begun = begun, begun + 1
            runs[best] = [word, word, a, {a}]
        else:
            run = runs[best]
            del ends[run[1] - run[2]]
            run[1], run[2] = word, a
            run[3].add(a)
        ends[diagonal] = best
    for first, last, _, seen in runs.values():
        yield first, last, len(seen)


_PLACE_SQL = "label string, base boolean, notice boolean, first_word long, last_word long, share double"
_PLACE = [pa.string(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.float64()]


def license_places(docs: DataFrame, templates: list[Template] | None = None, share: float = 0.6, slack: int = 6, text: str = "text", key: str = "doc_id", lost: int = LOST) -> DataFrame:
    """(row, key, n_words, label, base, notice, first_word, last_word, share): one row for each
    verified place of a template, in words from 0, and one with null from label on for each row of
    docs. A notice needs `share` of its grams or all but `lost` of them, see merge_spans().

    Null and empty texts: no words, no places. Repeated rows have a `row` of their own each, null
    keys pass, other columns don't matter, an empty table gives no rows. Texts of any length are
    read whole; a text's grams travel in rows of at most CHUNK, its diagonals in rows of at most a
    template's length, and the worker streams over them, so no text's hits are gathered.
    """
    templates = default_templates() if templates is None else templates
    sizes = sorted({t.k for t in templates})
    kind = docs.schema[key].dataType.simpleString()
    names = ["row", "key", "n_words", "k", "base", "hashes"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for row, k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                codes = words(t.as_py())
                n = len(codes)
                rows.append((row, k, n, 0, 0, np.array([SENTINEL], np.int64)))
                for size in sizes:
                    h = grams(codes, size)
                    for at in range(0, len(h), CHUNK):
                        rows.append((row, k, n, size, at, h[at : at + CHUNK]))
                        held += len(rows[-1][-1])
                if held > 500_000:
                    yield pack(rows, batch.column(1).type)
                    rows, held = [], 0
            if rows:
                yield pack(rows, batch.column(1).type)

    def pack(rows: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
        c = list(zip(*rows, strict=True))
        offsets = np.concatenate([[0], np.cumsum([len(h) for h in c[5]])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(c[5])))
        return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], key_type), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int32()), pa.array(c[4], pa.int64()), lists], names)

    ids = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    hashed = ids.mapInArrow(read, f"row long, key {kind}, n_words long, k int, base long, hashes array<long>")
    grams_df = hashed.select("row", "key", "n_words", "k", "base", F.posexplode("hashes").alias("i", "hash"))
    votes = grams_df.join(template_positions(docs.sparkSession, templates), ["k", "hash"])
    # every row of docs votes once for template -1, so rows without hits stay
    by_row = votes.repartition("row").groupBy("row", "key", "n_words", "template", (F.col("base") + F.col("i") - F.col("at")).alias("diagonal"))
    diagonals = by_row.agg(F.sort_array(F.collect_list("at")).alias("at")).sortWithinPartitions("row", "template", "diagonal")
    place = ["row", "key", "n_words", "label", "base", "notice", "first_word", "last_word", "share"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_type = pa.null()
        out: list[tuple] = []

        def rows() -> Iterator[tuple]:
            nonlocal key_type
            for batch in batches:
                key_type = batch.column(1).type
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        def flush() -> pa.RecordBatch:
            c = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(c, [pa.int64(), key_type, pa.int64(), *_PLACE], strict=True)], place)

        for row, group in groupby(rows(), key=lambda r: r[0]):
            _, k, n, *_ = next(group)
            out.append((row, k, n, *[None] * 6))
            for template, first, last, found in merge_spans(((r[3], r[4], r[5]) for r in group), templates, share, slack, lost):
                t = templates[template]
                out.append((row, k, n, t.label, t.base, t.k == NOTICE_K, first, last, found))
                if len(out) >= 8192:
                    yield flush()
            if len(out) >= 8192:
                yield flush()
        if out:
            yield flush()

    return diagonals.mapInArrow(verify, f"row long, key {kind}, n_words long, {_PLACE_SQL}").withColumnRenamed("key", key)


def license_spans(docs: DataFrame, templates: list[Template] | None = None, key: str = "doc_id", **options) -> DataFrame:
    """(key, n_words, spans) of each row of docs: license_places() gathered by row, by label and place.
    For texts whose places fit one row; license_report() needs no such gathering."""
    places = license_places(docs, templates, key=key, **options)
    span = F.when(F.col("label").isNotNull(), F.struct("label", "base", "notice", "first_word", "last_word", "share"))
    return places.groupBy("row", key).agg(F.max("n_words").alias("n_words"), F.array_sort(F.collect_list(span)).alias("spans")).drop("row")


def license_report(places: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score) from license_places().

    score is 0 without a place, 0.5 for a phrase, and 0.5 plus half the share found of a notice.
    Counts, ends and label sets only: partial aggregates of bounded size.
    """
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    base = lambda c: F.when(F.col("base"), F.col(c))
    score = F.when(F.col("notice"), 0.5 + F.col("share") / 2).when(F.col("label").isNotNull(), 0.5).otherwise(0.0)
    return (
        places.groupBy("row", key)
        .agg(
            F.max("n_words").alias("n_words"),
            F.count(base("label")).alias("n_base"),
            F.min(base("first_word")).alias("first_word"),
            F.max(base("first_word")).alias("last_word"),
            joined(base("label")).alias("base_labels"),
            joined("label").alias("labels"),
            F.least(F.max(score), F.lit(1.0)).alias("score"),
        )
        .drop("row")
    )
