"""Attribute lists of playlist tags: K=V,K="V,with,commas"."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A key, then a quoted value (closed, or running to the end) or a plain one up to a comma.
PAIR = r'([^=,]+)=("[^"]*"?|[^,]*)'


def attribute_map(text: Column) -> Column:
    """map<string,string>: quotes protect commas and are dropped, an unclosed one takes the rest,
    later duplicates win, nothing is unescaped."""
    # an unclosed quote swallows all that follows: cut there first
    whole = F.regexp_extract_all(text, F.lit(r'[^=,]+=(?:"[^"]*"|"[^"]*$|[^",][^,]*|(?=,|$))'), 0)
    pairs = F.transform(
        whole,
        lambda p: F.struct(
            F.trim(F.substring_index(p, "=", 1)).alias("key"),
            F.regexp_replace(F.substr(p, F.instr(p, "=") + 1), '^"|"$', "").alias("value")
        )
    )
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def text_of(m: Column, key: str) -> Column:
    return F.try_element_at(m, F.lit(key))


def int_of(m: Column, key: str) -> Column:
    """Null when absent or not a number."""
    return F.when(text_of(m, key).rlike(r"^[+-]?\d{1,18}$"), text_of(m, key).try_cast("long"))


def double_of(m: Column, key: str) -> Column:
    return F.when(text_of(m, key).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text_of(m, key).try_cast("double"))


def bool_of(m: Column, key: str) -> Column:
    """YES is true, anything else false, absent null."""
    return text_of(m, key) == "YES"


def resolution_of(m: Column, key: str = "RESOLUTION") -> Column:
    """struct(width, height); null unless WxH."""
    v = text_of(m, key)
    return F.when(v.rlike(r"^\d+x\d+$"), F.struct(F.split(v, "x")[0].cast("int").alias("width"), F.split(v, "x")[1].cast("int").alias("height")))


def frame_rate(text: Column) -> Column:
    """30000/1001 or a plain number."""
    p = F.split(text, "/")
    return F.when(F.size(p) == 2, F.try_divide(p[0].try_cast("double"), p[1].try_cast("double"))).otherwise(text.try_cast("double"))


def byte_range(text: Column) -> Column:
    """length[@offset]; a missing offset stays null."""
    p = F.split(text, "@")
    return F.when(p[0].rlike(r"^\d+$"), F.struct(p[0].cast("long").alias("length"), F.when(F.size(p) == 2, p[1].try_cast("long")).alias("offset")))


def problem(m: Column, tag: str, **kinds: str) -> Column:
    """The first missing or malformed required attribute as struct(code, tag, attribute, value), else null.

    kinds: attribute (underscores for dashes) -> int, double or text.
    """
    rule = {"int": int_of, "double": double_of, "text": text_of}
    checks = []
    for name, kind in kinds.items():
        key = name.replace("_", "-")
        raw = text_of(m, key)
        make = lambda code, key=key, raw=raw: F.struct(
            F.lit(code).alias("code"), F.lit(tag).alias("tag"), F.lit(key).alias("attribute"), raw.alias("value")
        )
        checks += [F.when(raw.isNull(), make("missingRequiredAttribute")), F.when(rule[kind](m, key).isNull(), make("invalidAttributeValue"))]
    return F.coalesce(*checks)
