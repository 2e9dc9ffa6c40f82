"""Scalar formatting and parsing of playlist, subtitle and JSON text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAME = r"\{\$([^}]+)\}"


def decimal(x: Column, places: int = 3, trim: bool = True) -> Column:
    """Seconds with `places` decimals; trailing zeros go, but one decimal stays, unless trim is off; null stays null."""
    text = F.when(x.isNotNull(), F.format_string(f"%.{places}f", x.cast("double")))
    return F.regexp_replace(text, r"(\.\d+?)0+$", "$1") if trim else text


def iso8601(micros: Column) -> Column:
    """UTC time of microseconds since 1970, with milliseconds."""
    ms = F.floor(micros / 1000).cast("long")
    return F.concat(F.date_format(F.timestamp_micros(ms * 1000), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))


def parse_iso8601(text: Column) -> Column:
    """Timestamp of ISO 8601 text, with fractional seconds or without; null if neither."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSXXX")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))


def json_time(seconds: Column) -> Column:
    """An integer if integral and below a million, else one decimal."""
    return F.when(
        (seconds == F.floor(seconds)) & (seconds < 1e6), F.floor(seconds).cast("long").cast("string")
    ).otherwise(F.format_string("%.1f", F.round(seconds, 1)))


def json_escape(text: Column) -> Column:
    """Only backslash and quote are escaped."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def _clock(ms: Column, short: bool) -> Column:
    full = F.format_string(
        "%02d:%02d:%02d.%03d", F.floor(ms / 3600000).cast("long"), F.floor(ms / 60000).cast("long") % 60,
        F.floor(ms / 1000).cast("long") % 60, ms % 1000
    )
    brief = F.format_string("%02d:%02d.%03d", F.floor(ms / 60000).cast("long") % 60, F.floor(ms / 1000).cast("long") % 60, ms % 1000)
    return F.when(ms < 3600000, brief).otherwise(full) if short else full


def vtt_time(seconds: Column, short: bool = False) -> Column:
    """HH:MM:SS.mmm, milliseconds cut off; `short` leaves out zero hours."""
    return _clock(F.floor(seconds * 1000).cast("long"), short)


def cue(begin: Column, end: Column, text: Column, position: Column | None = None, align: Column | None = None) -> Column:
    """A WebVTT cue of seconds, hours left out when zero; position in percent and alignment where not null."""
    settings = [
        F.concat(F.lit(f" {name}:"), value.cast("string"), F.lit(end_)) for name, value,
        end_ in (("position", position, "%"), ("align", align, "")) if value is not None
    ]
    settings = [F.coalesce(x, F.lit("")) for x in settings]
    return F.concat(vtt_time(begin, True), F.lit(" --> "), vtt_time(end, True), *settings, F.lit("\n"), text, F.lit("\n"))


def ttml_time(seconds: Column) -> Column:
    """HH:MM:SS.mmm, milliseconds rounded."""
    return _clock(F.round(seconds * 1000).cast("long"), False)


def parse_timecode(text: Column) -> Column:
    """Seconds of HH:MM:SS[.fraction]; null for anything else, frame counts included."""
    ok = text.rlike(r"^\d+:\d+:\d+(\.\d+)?$")
    p = F.split(text, ":")
    return F.when(
        ok,
        F.try_element_at(p, F.lit(1)).cast("double") * 3600 + F.try_element_at(p, F.lit(2)).cast("double") * 60 + F.try_element_at(p, F.lit(3)).cast("double")
    )


def xml_escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def fill_template(template: Column, segment: Column, part: Column, ext: Column) -> Column:
    """Puts values for {segment}, {part} and {ext}."""
    out = F.replace(template, F.lit("{segment}"), segment.cast("string"))
    return F.replace(F.replace(out, F.lit("{part}"), part.cast("string")), F.lit("{ext}"), ext)


def file_name(pattern: Column, index: Column) -> Column:
    """The first %d becomes the index; later ones stay."""
    at = F.instr(pattern, "%d")
    return F.when(at > 0, F.concat(F.substr(pattern, F.lit(1), at - 1), index.cast("string"), F.substr(pattern, at + 2))).otherwise(pattern)


def file_extension(name: Column, default: str = "ts") -> Column:
    return F.when(F.instr(name, ".") > 0, F.substring_index(name, ".", -1)).otherwise(F.lit(default))


def variable_names(text: Column) -> Column:
    """The names of {$name} references, in order, repeats included; empty and unfinished ones don't count."""
    return F.regexp_extract_all(text, F.lit(NAME), 1)


#: Characters from which a text is not resolved any further: definitions that name each other twice would double it each time.
MAX_RESOLVED = 1_000_000


def resolve_variables(text: Column, values: Column) -> Column:
    """Replaces each {$name} that `values` (a map) defines; unknown references stay.

    Definitions are applied in the order of their names, over and over until nothing changes, as often as
    there are definitions at most: chains of any length resolve however they are ordered, cycles end.
    """
    entries = F.array_sort(F.map_entries(values))
    put = lambda t, e: F.replace(t, F.concat(F.lit("{$"), e["key"], F.lit("}")), F.coalesce(e["value"], F.lit("")))
    once = lambda t: F.aggregate(entries, t, lambda t, e: F.when(F.length(t) < MAX_RESOLVED, put(t, e)).otherwise(t))
    start = F.struct(text.alias("now"), F.lit(None).cast("string").alias("before"))
    more = lambda s: s["now"].contains("{$") & ~s["now"].eqNullSafe(s["before"]) & (F.length(s["now"]) < MAX_RESOLVED)
    passes = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(entries)))
    return F.aggregate(
        passes, start, lambda s, _: F.when(more(s), F.struct(once(s["now"]).alias("now"), s["now"].alias("before"))).otherwise(s)
    )["now"]


def unresolved(text: Column, values: Column) -> Column:
    """Names that `values` does not define, once each, sorted."""
    return F.array_sort(F.array_except(F.array_distinct(variable_names(text)), F.map_keys(values)))


def query_item(url: Column, name: str) -> Column:
    """The first query item of that name."""
    return F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1)


def quoted(name: str, value: Column) -> Column:
    return F.concat(F.lit(f'{name}="'), value.cast("string"), F.lit('"'))


def plain(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}="), value.cast("string"))


def flag(name: str, value: Column) -> Column:
    """NAME=YES, or nothing."""
    return F.when(value, F.lit(f"{name}=YES"))


def attribute_list(*items: Column) -> Column:
    """Joins attributes by commas; null ones are left out."""
    return F.concat_ws(",", *items)
