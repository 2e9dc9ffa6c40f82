"""Line-first cleaning, in DataFrame functions only.

Each line with a word is put to three rules: punctuation (too many marks), navigation (a run of
separators between a few words) and boilerplate (a short line with a stock phrase).  Lines that
fail are removed.  A document is rejected if it fails the base rules (too few words, too many words
in repeated windows) or if its removed lines held too much of its text.

A repeated row, a hot source or a long text is just a row here: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space, symbols and the stock phrases of boilerplate lines.
WHITE = r"[\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
MARKS = r"[#*$%&|<>!^~={}\\_]"
SEPARATORS = "[|»›•·]"
BOILERPLATE = (
    "all rights reserved",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "uses cookies",
    "accept cookies",
    "enable javascript",
    "subscribe to our newsletter",
    "sign up for our newsletter",
    "click here to",
    "log in to continue",
    "share this article",
    "skip to content",
    "back to top",
    "lorem ipsum",
)


@dataclass(frozen=True)
class Rules:
    """Limits; the base ones are part of the query's contract."""

    min_words: int = 20
    window: int = 8
    max_repeat_percent: int = 30
    min_marks: int = 5
    marks_percent: int = 15
    min_separators: int = 3
    words_per_separator: int = 4
    stock_line_chars: int = 200
    max_lost_percent: int = 30


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda's variable is never inlined again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WHITE + "+"), lambda w: w != "")


def repeated_words(words: Column, window: int, hash_of: Callable[[Column], Column] = F.xxhash64) -> Column:
    """Words that lie in a window found twice or more in `words`, first occurrences included.

    Windows are sorted by hash and place in one long, and neighbours of equal hash compared word by
    word; where two that differ have one hash, which could hide a third, they are sorted by their words.
    """

    def covered(spots: Column) -> Column:
        steps = F.transform(spots, lambda p, i: F.when(i == F.size(spots) - 1, F.lit(window)).otherwise(F.least(F.lit(window), (F.get(spots, i + 1) - p).cast("int"))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def beside(n: Column, same: Callable[[Column], Column]) -> Column:
        """The places whose neighbour before or after is the same; same(k) compares k - 1 and k."""
        return F.filter(F.sequence(F.lit(0), n - 1), lambda k: F.when(k > 0, same(k)).otherwise(False) | F.when(k < n - 1, same(k + 1)).otherwise(False))

    def by_words(n: Column) -> Column:
        own = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.slice(words, i + 1, window).alias("w"), i.alias("i")))
        spots = lambda keys: F.array_sort(F.transform(beside(n, lambda k: F.get(keys, k - 1)["w"] == F.get(keys, k)["w"]), lambda k: F.get(keys, k)["i"].cast("long")))
        return let(F.sort_array(own), lambda keys: let(spots(keys), covered))

    def search(hashes: Column) -> Column:
        n = F.size(hashes)

        def packed(bits: Column) -> Column:
            low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
            keys = F.sort_array(F.transform(hashes, lambda h, i: F.call_function("shiftleft", h, bits).bitwiseOR(i.cast("long"))))

            def flagged(keys: Column) -> Column:
                at = lambda k: F.get(keys, k).bitwiseAND(low).cast("int")
                hashed = lambda k: F.call_function("shiftrightunsigned", F.get(keys, k - 1), bits) == F.call_function("shiftrightunsigned", F.get(keys, k), bits)
                alike = lambda k: F.slice(words, at(k - 1) + 1, window) == F.slice(words, at(k) + 1, window)
                hits = beside(n, lambda k: hashed(k) & alike(k))
                clash = F.exists(F.sequence(F.lit(1), n - 1), lambda k: hashed(k) & ~alike(k))
                return F.when(clash, by_words(n)).otherwise(let(F.array_sort(F.transform(hits, lambda k: at(k).cast("long"))), covered))

            return let(keys, flagged)

        return F.when(F.size(F.array_distinct(hashes)) < n, let(F.length(F.bin(n.cast("long"))), packed)).otherwise(F.lit(0).cast("long"))

    def windows(codes: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(codes) - (window - 1)), lambda i: hash_of(F.slice(codes, i, window)))

    hashes = let(F.transform(words, lambda w: F.xxhash64(w)), windows)
    return F.when(F.size(words) > window, let(hashes, search)).otherwise(F.lit(0).cast("long"))


def ink(text: Column) -> Column:
    """Code points that aren't white space."""
    return F.length(F.regexp_replace(text, WHITE + "+", ""))


def line_fails(line: Column, rules: Rules) -> Column:
    """Whether a line breaks one of the three rules; lines without a word don't."""
    marks = F.regexp_count(line, F.lit(MARKS))
    seps = F.regexp_count(line, F.lit(SEPARATORS))
    n_words = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    punctuation = (marks >= rules.min_marks) & (marks * 100 >= ink(line) * rules.marks_percent)
    navigation = (seps >= rules.min_separators) & (n_words <= (seps + 1) * rules.words_per_separator)
    stock = (F.length(line) <= rules.stock_line_chars) & F.lower(line).rlike("|".join(BOILERPLATE))
    return punctuation | navigation | stock


def clean_lines(docs: DataFrame, rules: Rules = Rules(), text: str = "text", prefix: str = "") -> DataFrame:
    """Adds the columns of the rules to docs, row by row, their names after `prefix`:

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, kept (boolean),
    n_lines, n_removed_lines, removed_chars (long), cleaned_text (string).

    Null and empty texts have no words: zeros, base_failed, not kept, cleaned_text empty. Columns
    of docs with these names are replaced; null keys and repeated rows pass as they are.
    """
    made = [prefix + c for c in ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_removed_lines", "removed_chars", "cleaned_text"]]
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in made]
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w, rules.window).alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        def of_good(good: Column) -> Column:
            cleaned = F.array_join(good, "\n")
            return let(
                F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
                lambda full: F.struct(
                    (F.size(full) - F.size(F.array_distinct(full))).cast("long").alias("n_dup_lines"),
                    F.size(full).cast("long").alias("n_lines"),
                    (F.size(lines) - F.size(good)).cast("long").alias("n_removed_lines"),
                    cleaned.alias("cleaned_text"),
                ),
            )

        return let(F.filter(lines, lambda x: ~line_fails(x, rules)), of_good)

    w, ln, lost, symbols = (F.col(f"{prefix}_{c}_") for c in ("words", "lines", "lost", "symbols"))
    step = docs.select(*rest, let(words_of(t), of_words).alias(f"{prefix}_words_"), let(F.split(t, "\n"), of_lines).alias(f"{prefix}_lines_"), F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias(f"{prefix}_symbols_"))
    step = step.withColumn(f"{prefix}_lost_", F.when(ln["n_removed_lines"] > 0, w["word_chars"] - ink(ln["cleaned_text"])).otherwise(F.lit(0)).cast("long"))
    failed = (w["n_words"] < rules.min_words) | (w["n_repeat_words"] * 100 > w["n_words"] * rules.max_repeat_percent)
    kept = ~failed & (lost * 100 <= w["word_chars"] * rules.max_lost_percent)
    values = [w["n_words"], w["word_chars"], symbols, ln["n_dup_lines"], w["n_repeat_words"], failed, kept, ln["n_lines"], ln["n_removed_lines"], lost, ln["cleaned_text"]]
    return step.select(*rest, *[v.alias(n) for v, n in zip(values, made, strict=True)])


def quality_rules(docs: DataFrame, rules: Rules = Rules(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """The verdicts of clean_lines() by key, without the texts."""
    return clean_lines(docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")), rules, text).select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_removed_lines", "removed_chars")


def keep_clean(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """docs without the rejected documents, failing lines removed, in the columns of docs; n_chars,
    if there, counts the text that is left. Clean documents pass unchanged."""
    p = "__rule_"  # a column of docs with a name of the rules' keeps its values
    out = clean_lines(docs, rules, prefix=p).where(f"{p}kept")
    changed = F.col(f"{p}n_removed_lines") > 0
    cols = {"text": F.when(changed, F.col(f"{p}cleaned_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        cols["n_chars"] = F.when(changed, F.length(f"{p}cleaned_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumns(cols).select(*[f"`{c}`" for c in docs.columns])


def oracle_sql(rules: Rules = Rules()) -> str:
    """DuckDB SQL for quality_rules() over documents."""
    white, word = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]+"
    count = lambda x, p: f"len(regexp_extract_all({x}, '{p}'))"
    ink_sql = lambda x: f"length(regexp_replace({x}, '{white}+', '', 'g'))"
    k = rules.window
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{word}') AS w, string_split(t, chr(10)) AS l FROM d),
win AS (SELECT r, unnest(range(1, len(w) - {k} + 2)) AS i, w FROM w WHERE len(w) >= {k}),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w[i:i + {k - 1}]) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, sum(least({k}, coalesce(nx - i, {k}))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nx FROM dup) GROUP BY r),
line AS (SELECT r, unnest(l) AS x, generate_subscripts(l, 1) AS j FROM w),
bad AS (SELECT r, j, x,
    ({count('x', MARKS)} >= {rules.min_marks} AND {count('x', MARKS)} * 100 >= {ink_sql('x')} * {rules.marks_percent})
    OR ({count('x', SEPARATORS)} >= {rules.min_separators} AND {count('x', word)} <= ({count('x', SEPARATORS)} + 1) * {rules.words_per_separator})
    OR (length(x) <= {rules.stock_line_chars} AND regexp_matches(lower(x), '{'|'.join(BOILERPLATE)}')) AS b,
    regexp_matches(x, '{word}') AS full_line, {ink_sql('x')} AS chars FROM line),
ln AS (SELECT r, count(*) FILTER (WHERE full_line) AS n_lines,
    count(*) FILTER (WHERE full_line) - count(DISTINCT x) FILTER (WHERE full_line) AS n_dup_lines,
    count(*) FILTER (WHERE b) AS n_removed_lines, coalesce(sum(chars) FILTER (WHERE b), 0) AS removed_chars FROM bad GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, {ink_sql('t')}::BIGINT AS word_chars, {count('t', SYMBOLS)}::BIGINT AS n_symbols,
    n_dup_lines::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, n_lines::BIGINT AS n_lines,
    n_removed_lines::BIGINT AS n_removed_lines, removed_chars::BIGINT AS removed_chars
  FROM w JOIN ln USING (r) LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed,
  NOT (n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words)
    AND removed_chars * 100 <= word_chars * {rules.max_lost_percent} AS kept, n_lines, n_removed_lines, removed_chars
FROM m"""
