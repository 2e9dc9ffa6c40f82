"""TTML subtitles: cues, styles and regions of whole documents, and documents of cues."""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Attributes of a style, by their TTML names.
STYLE = {
    "font_family": "fontFamily", "font_size": "fontSize", "color": "color", "background_color": "backgroundColor",
    "text_align": "textAlign", "font_style": "fontStyle", "font_weight": "fontWeight", "text_outline": "textOutline"
}
#: The opening tag of a rendered document.
SPACES = 'xmlns="http://www.w3.org/ns/ttml" xmlns:ttp="http://www.w3.org/ns/ttml#parameter" xmlns:tts="http://www.w3.org/ns/ttml#styling" ttp:profile="http://www.w3.org/ns/ttml/profile/imsc1/text"'


def _elements(source: str) -> tuple[str | None, str | None, list[tuple[str, dict, str]]]:
    """(error, language, elements): each p, and each style in the head and region, as (kind, attributes, text).

    The text of a p is what stands in it and in its spans. Entities are decoded, CDATA is text, comments
    are none; nothing outside the document is read."""
    found: list[tuple[str, dict, str]] = []
    open_: list[str] = []
    state: dict = {"tt": False, "language": None, "p": None, "text": []}

    def begin(name: str, attributes: dict) -> None:
        name = name.rpartition(":")[2]
        open_.append(name)
        if name == "tt":
            state.update(tt=True, language=attributes.get("xml:lang"))
        elif name == "region" or (name == "style" and "head" in open_):
            found.append((name, attributes, ""))
        elif name == "p":
            state.update(p=attributes, text=[])

    def end(name: str) -> None:
        if open_.pop() == "p" and state["p"] is not None:
            found.append(("p", state["p"], "".join(state["text"]).strip()))
            state["p"] = None

    def characters(text: str) -> None:
        if state["p"] is not None and open_ and open_[-1] in ("p", "span"):
            state["text"].append(text)

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = begin, end, characters
    try:
        parser.Parse(source.encode("utf-8", "replace"), True)
    except expat.ExpatError:
        return "invalidXML", None, []
    error = "missingTT" if not state["tt"] else "missingLanguage" if not state["language"] else None
    return error, state["language"], [] if error else found


def elements(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, language, pos, kind, attributes, text, error): the elements p, style and region of each text, in
    order; one row with the error invalidXML, missingTT or missingLanguage for a text without."""
    kind = docs.schema[key].dataType.simpleString()
    names = ["key", "language", "pos", "kind", "attributes", "text", "error"]
    types = [pa.string(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, source in zip(batch.column(0), batch.column(1), strict=True):
                if not source.is_valid:
                    continue
                error, language, found = _elements(source.as_py())
                rows = [
                    (language, i, kind, list(a.items()), t, None) for i, (kind, a, t) in enumerate(found)
                ] if not error else [(None, None, None, None, None, error)]
                if rows:
                    columns = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k.as_py()] * len(rows), batch.column(0).type), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                        names
                    )

    schema = f"key {kind}, language string, pos int, kind string, attributes map<string,string>, text string, error string"
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def _at(name: str) -> Column:
    return F.try_element_at("attributes", F.lit(name))


def cues(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, language, pos, begin, end, text, region, style, error): one row per p with both times, in
    seconds, numbered from 0.

    Texts that are no XML, or without a tt element or a language, give one row with the error invalidXML,
    missingTT or missingLanguage; a cue whose time is no clock time has the error invalidTimecode."""
    from pyspark.sql.window import Window

    e = elements(docs, key, text).where(
        "error is not null or (kind = 'p' and map_contains_key(attributes, 'begin') and map_contains_key(attributes, 'end'))"
    )
    place = F.when(F.col("error").isNull(), F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1)
    e = e.select(
        key, "language", place.alias("pos"), T.parse_timecode(F.trim(_at("begin"))).alias("begin"),
        T.parse_timecode(F.trim(_at("end"))).alias("end"), "text", _at("region").alias("region"), _at("style").alias("style"), "error"
    )
    return e.withColumn("error", F.coalesce("error", F.when(F.col("begin").isNull() | F.col("end").isNull(), "invalidTimecode")))


def styles(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, id, ...): the styles in the head of each text that have an id."""
    e = elements(docs, key, text).where("kind = 'style'")
    return e.select(
        key, "pos", F.coalesce(_at("xml:id"), _at("id")).alias("id"), *[_at(f"tts:{v}").alias(k) for k, v in STYLE.items()]
    ).where("id <> ''")


def regions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, id, x, y, width, height): the regions of each text that have an id, in percent; 0 where
    origin or extent isn't a pair."""
    def pair(name: str, i: int) -> Column:
        p = F.filter(F.split(_at(name), " "), lambda s: s != "")
        return F.when(F.size(p) == 2, F.coalesce(F.replace(F.get(p, F.lit(i)), F.lit("%"), F.lit("")).try_cast("double"), F.lit(0.0))).otherwise(0.0)

    e = elements(docs, key, text).where("kind = 'region'")
    place = [
        pair("tts:origin", 0).alias("x"), pair("tts:origin", 1).alias("y"), pair("tts:extent", 0).alias("width"),
        pair("tts:extent", 1).alias("height")
    ]
    return e.select(key, "pos", F.coalesce(_at("xml:id"), _at("id")).alias("id"), *place).where("id <> ''")


def _listed(rows: DataFrame, key: str, line: Column, order: str, name: str) -> DataFrame:
    """(key, name): the lines of each key in order, joined by line breaks."""
    g = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), line.alias("x")))).alias("_l"))
    return g.select(key, F.array_join(F.transform("_l", lambda v: v["x"]), "\n").alias(name))


def render(
    cue_rows: DataFrame, key: str = "doc_id", language: str = "en", style_rows: DataFrame | None = None,
    region_rows: DataFrame | None = None
) -> DataFrame:
    """(key, text): a TTML document of each key's cues (begin, end, text; region and style if there), with
    the styles and regions (as styles() and regions() give them) in its head."""
    given = lambda n: F.coalesce(F.concat(F.lit(f' {n}="'), F.col(n), F.lit('"')), F.lit("")) if n in cue_rows.columns else F.lit("")
    cue = F.concat(
        F.lit('      <p begin="'), T.ttml_time(F.col("begin")), F.lit('" end="'), T.ttml_time(F.col("end")), F.lit('"'), given("region"),
        given("style"), F.lit(">"), T.xml_escape(F.col("text")), F.lit("</p>")
    )
    ordered = cue_rows.withColumn("_order", F.struct("begin", "end"))
    out = _listed(ordered, key, cue, "_order", "_cues")
    head = F.lit("")
    if style_rows is not None:
        parts = [F.coalesce(F.concat(F.lit(f' tts:{v}="'), F.col(k), F.lit('"')), F.lit("")) for k, v in STYLE.items()]
        out = out.join(
            _listed(style_rows, key, F.concat(F.lit('      <style xml:id="'), "id", F.lit('"'), *parts, F.lit("/>")), "pos", "_styles"),
            key, "left"
        )
        head = F.concat(head, F.coalesce(F.concat(F.lit("    <styling>\n"), "_styles", F.lit("\n    </styling>\n")), F.lit("")))
    if region_rows is not None:
        whole = lambda c: (F.col(c) == F.round(c)) & F.col(c).between(0, 100)
        percent = lambda c: F.when(whole(c), F.format_string("%d%%", F.col(c).cast("long"))).otherwise(F.format_string("%.2f%%", c))
        line = F.concat(
            F.lit('      <region xml:id="'), "id", F.lit('" tts:origin="'), percent("x"), F.lit(" "), percent("y"),
            F.lit('" tts:extent="'), percent("width"), F.lit(" "), percent("height"), F.lit('"/>')
        )
        out = out.join(_listed(region_rows, key, line, "pos", "_regions"), key, "left")
        head = F.concat(head, F.coalesce(F.concat(F.lit("    <layout>\n"), "_regions", F.lit("\n    </layout>\n")), F.lit("")))
    head = F.when(head != "", F.concat(F.lit("  <head>\n"), head, F.lit("  </head>\n"))).otherwise("")
    start = f'<?xml version="1.0" encoding="UTF-8"?>\n<tt {SPACES} xml:lang="{language}">\n'
    return out.select(
        key, F.concat(F.lit(start), head, F.lit("  <body>\n    <div>\n"), "_cues", F.lit("\n    </div>\n  </body>\n</tt>")).alias("text")
    )


def segments(documents: DataFrame, sequence: str, begin: str, duration: str, text: str = "text") -> DataFrame:
    """documents with `content`: each text as the one sample of a media segment, times in milliseconds."""
    from .binary import media_segment
    from .writers import written

    make = lambda n, at, length, body: media_segment(n, 1, at, [(length, 0, True, (body or "").encode())])
    return written(documents, [sequence, begin, duration, text], make)
