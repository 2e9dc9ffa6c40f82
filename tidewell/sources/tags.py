"""Further tags and playlists as text: low latency, I-frames, subtitles, thumbnails, recordings, steering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators.playlists import join_lines, last_segments
from .sinks import part_line

C = F.col


def tag(name: str, *items: Column) -> Column:
    return F.concat(F.lit(f"#EXT-X-{name}:"), T.attribute_list(*items))


def iframe_line() -> Column:
    size = F.concat(C("resolution.width").cast("string"), F.lit("x"), C("resolution.height").cast("string"))
    return tag(
        "I-FRAME-STREAM-INF", T.plain("BANDWIDTH", C("bandwidth")), T.plain("RESOLUTION", size), T.quoted("CODECS", C("codecs")),
        T.quoted("URI", C("uri"))
    )


def session_data_line() -> Column:
    return tag(
        "SESSION-DATA", T.quoted("DATA-ID", C("data_id")), T.quoted("VALUE", C("value")), T.quoted("URI", C("uri")),
        T.quoted("LANGUAGE", C("language"))
    )


def steering_line() -> Column:
    return tag("CONTENT-STEERING", T.quoted("SERVER-URI", C("server_uri")), T.quoted("PATHWAY-ID", C("pathway_id")))


def session_key_line() -> Column:
    return tag(
        "SESSION-KEY", T.plain("METHOD", C("method")), T.quoted("URI", C("uri")), T.plain("IV", C("iv")),
        T.quoted("KEYFORMAT", C("key_format"))
    )


def part_inf_line(target: Column) -> Column:
    return tag("PART-INF", T.plain("PART-TARGET", T.decimal(target)))


def preload_hint_line() -> Column:
    return tag(
        "PRELOAD-HINT", T.plain("TYPE", C("type")), T.quoted("URI", C("uri")), T.plain("BYTERANGE-START", C("start")),
        T.plain("BYTERANGE-LENGTH", C("length"))
    )


def rendition_report_line() -> Column:
    return tag("RENDITION-REPORT", T.quoted("URI", C("uri")), T.plain("LAST-MSN", C("last_msn")), T.plain("LAST-PART", C("last_part")))


def skip_line(skipped: Column, removed: Column | None = None) -> Column:
    """removed: ids of date ranges, joined by tabs."""
    gone = T.quoted("RECENTLY-REMOVED-DATERANGES", F.array_join(removed, "\t")) if removed is not None else F.lit(None).cast("string")
    return tag("SKIP", T.plain("SKIPPED-SEGMENTS", skipped), gone)


def start_line(offset: Column, precise: Column) -> Column:
    return tag("START", T.plain("TIME-OFFSET", T.decimal(offset)), T.flag("PRECISE", precise))


def define_line() -> Column:
    """DEFINE of a row of definitions (name, value, kind)."""
    return F.when(
        C("kind") == "value", tag("DEFINE", T.quoted("NAME", C("name")), T.quoted("VALUE", C("value")))
    ).when(C("kind") == "import", tag("DEFINE", T.quoted("IMPORT", C("name")))).otherwise(tag("DEFINE", T.quoted("QUERYPARAM", C("name"))))


def date_range_line() -> Column:
    """DATERANGE of a row of date ranges; client attributes by name, all quoted."""
    client = F.transform(F.array_sort(F.map_entries("client")), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"')))
    day = lambda c: T.iso8601(F.unix_micros(c))
    return tag(
        "DATERANGE", T.quoted("ID", C("id")), T.quoted("START-DATE", day("start_date")), T.quoted("CLASS", C("class")),
        T.quoted("END-DATE", day("end_date")), T.plain("DURATION", T.decimal(C("duration"))),
        T.plain("PLANNED-DURATION", T.decimal(C("planned_duration"))), T.flag("END-ON-NEXT", C("end_on_next")),
        F.when(F.size(client) > 0, F.array_join(client, ","))
    )


def splice_attributes(section: Column, out_of_network: Column) -> Column:
    """The DATERANGE attributes of a splice section (binary) as a map: its command, and OUT or IN."""
    digits = F.concat(F.lit("0x"), F.hex(section))
    return F.create_map(F.lit("SCTE35-CMD"), digits, F.when(out_of_network, "SCTE35-OUT").otherwise("SCTE35-IN"), digits)


def description_line() -> Column:
    """MEDIA of a row of audio descriptions (group_id, language, name, is_default, characteristics, uri)."""
    yes = F.when(C("is_default"), "YES").otherwise("NO")
    return tag(
        "MEDIA", F.lit("TYPE=AUDIO"), T.quoted("GROUP-ID", C("group_id")), T.quoted("LANGUAGE", C("language")), T.quoted("NAME", C("name")),
        T.plain("DEFAULT", yes), F.lit("AUTOSELECT=YES"),
        T.quoted("CHARACTERISTICS", C("characteristics")), T.quoted("URI", C("uri")),
    )


def low_latency_playlist(
    segments: DataFrame, parts: DataFrame, keys: list[str], target: float, part_target: float, open_segments: Column
) -> DataFrame:
    """(keys, text): parts stand before the EXTINF of their segment; a segment that is open (or null
    duration) has parts only, and the part after the last is hinted. segments: (keys, segment, duration,
    uri); parts: (keys, segment, part, duration, uri, independent, gap)."""
    p = parts.select(*keys, C("segment").alias("_s"), C("part").cast("long").alias("_o"), part_line().alias("_line"))
    s = segments.where(C("duration").isNotNull() & ~open_segments).select(
        *keys, C("segment").alias("_s"), F.lit(1 << 40).alias("_o"),
        F.concat(F.lit("#EXTINF:"), T.decimal(C("duration"), 5), F.lit(",\n"), C("uri")).alias("_line")
    )
    body = join_lines(p.unionByName(s), keys, ["_s", "_o"], "_line", "_body")
    head = f"#EXTM3U\n#EXT-X-VERSION:9\n#EXT-X-TARGETDURATION:{-int(-target // 1)}\n#EXT-X-SERVER-CONTROL:CAN-BLOCK-RELOAD=YES,HOLD-BACK={_plain(3 * target)},PART-HOLD-BACK={_plain(3 * part_target)}\n#EXT-X-PART-INF:PART-TARGET={_plain(part_target)}\n#EXT-X-MEDIA-SEQUENCE:"
    first = segments.groupBy(*keys).agg(F.min("segment").alias("_first"))
    return body.join(first, keys).select(*keys, F.concat(F.lit(head), C("_first").cast("string"), F.lit("\n"), "_body").alias("text"))


def _plain(x: float) -> str:
    text = f"{x:.5f}".rstrip("0")
    return text + "0" if text.endswith(".") else text


def iframe_playlist(frames: DataFrame, keys: list[str], order: str, version: int = 7, init: str | None = None) -> DataFrame:
    """(keys, text) of keyframes (duration, length, offset, uri, discontinuity)."""
    line = F.concat(
        F.when(C("discontinuity"), "#EXT-X-DISCONTINUITY\n").otherwise(""), F.lit("#EXTINF:"), T.decimal(C("duration"), 3, False),
        F.lit(",\n#EXT-X-BYTERANGE:"), C("length").cast("string"), F.lit("@"), C("offset").cast("string"), F.lit("\n"), C("uri")
    )
    body = join_lines(frames.withColumn("_line", line), keys, [order], "_line", "_body")
    target = frames.groupBy(*keys).agg(F.coalesce(F.ceil(F.max("duration")), F.lit(6)).cast("long").alias("_t"))
    head = F.concat(
        F.lit(f"#EXTM3U\n#EXT-X-VERSION:{version}\n#EXT-X-TARGETDURATION:"), C("_t").cast("string"),
        F.lit("\n#EXT-X-I-FRAMES-ONLY\n" + (f'#EXT-X-MAP:URI="{init}"\n' if init else ""))
    )
    return body.join(target, keys).select(*keys, F.concat(head, "_body", F.lit("#EXT-X-ENDLIST\n")).alias("text"))


def recording(segments: DataFrame, keys: list[str], order: str, final: bool, template: str | None = None, init: str | None = None) -> DataFrame:
    """(keys, text): an EVENT playlist while recording, VOD with ENDLIST when final; names kept, or
    renumbered by a template with {index}. Durations are not trimmed; the target is that of whole microseconds,
    so that the noise of a sum does not add a second."""
    s = segments
    name = C("uri")
    if template:
        s = s.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
        name = F.replace(F.lit(template), F.lit("{index}"), C("_i").cast("string"))
    line = F.concat(
        F.when(C("discontinuity"), "#EXT-X-DISCONTINUITY\n").otherwise(""), F.lit("#EXTINF:"), T.decimal(C("duration"), 3, False),
        F.lit(",\n"), name
    )
    body = join_lines(s.withColumn("_line", line), keys, [order], "_line", "_body")
    target = segments.groupBy(*keys).agg(F.coalesce(F.ceil(F.round(F.max("duration"), 6)), F.lit(6)).cast("long").alias("_t"))
    kind = "VOD" if final else "EVENT"
    head = F.concat(
        F.lit("#EXTM3U\n#EXT-X-VERSION:7\n#EXT-X-TARGETDURATION:"), C("_t").cast("string"),
        F.lit(f"\n#EXT-X-PLAYLIST-TYPE:{kind}\n" + (f'#EXT-X-MAP:URI="{init}"\n' if init else ""))
    )
    return body.join(target, keys).select(*keys, F.concat(head, "_body", F.lit("#EXT-X-ENDLIST\n" if final else "")).alias("text"))


def subtitle_playlist(segments: DataFrame, keys: list[str], index: str, size: int = 5) -> DataFrame:
    """(keys, text): the last `size` subtitle segments, version 3 after the target."""
    kept = last_segments(segments, keys, index, size)
    body = join_lines(
        kept.withColumn("_line", F.concat(F.lit("#EXTINF:"), T.decimal(C("duration")), F.lit(",\n"), C("uri"))), keys, [index], "_line",
        "_body"
    )
    info = kept.groupBy(*keys).agg(F.ceil(F.max("duration")).cast("long").alias("_t"), F.max("evicted").alias("_e"))
    return body.join(info, keys).select(
        *keys,
        F.concat(
            F.lit("#EXTM3U\n#EXT-X-TARGETDURATION:"), C("_t").cast("string"), F.lit("\n#EXT-X-VERSION:3\n#EXT-X-MEDIA-SEQUENCE:"),
            C("_e").cast("string"), F.lit("\n"), "_body"
        ).alias("text")
    )


def tile_vtt(tiles: DataFrame, keys: list[str], base: str, width: int, height: int) -> DataFrame:
    """(keys, vtt) of tiles (sheet, tile_column, tile_row, start, duration)."""
    g = tiles.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "sheet", "tile_row", "tile_column", "duration"))).alias("_c"))

    def cue(t: Column, i: Column) -> Column:
        place = F.concat_ws(
            ",", (t["tile_column"] * width).cast("string"), (t["tile_row"] * height).cast("string"), F.lit(str(width)), F.lit(str(height))
        )
        return F.concat(
            (i + 1).cast("string"), F.lit("\n"), T.vtt_time(t["start"]), F.lit(" --> "), T.vtt_time(t["start"] + t["duration"]),
            F.lit(f"\n{base}sheet"), t["sheet"].cast("string"), F.lit(".jpg#xywh="), place, F.lit("\n")
        )

    return g.select(*keys, F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform("_c", cue), "\n")).alias("vtt"))


def steering_json(pathways: Column, ttl: Column) -> Column:
    return F.concat(
        F.lit('{"VERSION":1,"TTL":'), ttl.cast("string"), F.lit(',"PATHWAY-PRIORITY":['),
        F.array_join(F.transform(pathways, lambda p: F.concat(F.lit('"'), p, F.lit('"'))), ","), F.lit("]}")
    )


def inject_keys(playlists: DataFrame, key: str, text: str, key_uri: str, every: int = 0) -> DataFrame:
    """playlists with KEY lines put before the first EXTINF and then before every `every`-th (0: only the first)."""
    parts = F.split(text, "(?m)^(?=#EXTINF:)")
    head = F.element_at(parts, 1)
    starts = head.startswith("#EXTINF:")
    rest = F.when(starts, parts).otherwise(F.slice(parts, 2, F.size(parts)))
    line = F.lit(f'#EXT-X-KEY:METHOD=AES-128,URI="{key_uri}"\n')
    due = lambda i: (i == 0) | (F.lit(every > 0) & (i % max(1, every) == 0))
    body = F.transform(rest, lambda p, i: F.when(due(i), F.concat(line, p)).otherwise(p))
    return playlists.withColumn(text, F.concat(F.when(starts, "").otherwise(head), F.array_join(body, "")))


def interstitials(ranges: DataFrame) -> DataFrame:
    """Date ranges that name an asset: its kind and URI, restrictions, resume offset, skip and preload."""
    a = lambda k: F.try_element_at(C("client"), F.lit(k))
    keep = (
        "X-ASSET-URI", "X-ASSET-LIST", "X-RESTRICT", "X-RESUME-OFFSET", "X-SKIP-AFTER", "X-SKIP-BUTTON-START", "X-com.apple.hls.preload",
        "X-PRELOAD-AHEAD"
    )
    return ranges.where(a("X-ASSET-URI").isNotNull() | a("X-ASSET-LIST").isNotNull()).withColumns({
        "asset_kind": F.when(a("X-ASSET-URI").isNotNull(), "uri").otherwise("list"),
        "asset": F.coalesce(a("X-ASSET-URI"), a("X-ASSET-LIST")), "restrictions": F.array_sort(F.split(a("X-RESTRICT"), ",")),
        "resume_offset": a("X-RESUME-OFFSET").try_cast("double"), "skip_after": a("X-SKIP-AFTER").try_cast("double"),
        "preload_uri": a("X-com.apple.hls.preload"), "others": F.map_filter("client", lambda k, _: ~k.isin(*keep)),
    })


def reload_request(url: Column) -> Column:
    """struct(msn, part, skip) of a blocking reload's query; null without a number in _HLS_msn."""
    item = lambda n: T.query_item(url, n)
    number = lambda n: F.when(item(n).rlike(r"^\d{1,18}$"), item(n).try_cast("long"))
    return F.when(
        number("_HLS_msn").isNotNull(),
        F.struct(
            number("_HLS_msn").alias("msn"), number("_HLS_part").alias("part"),
            F.when(item("_HLS_skip").isin("YES", "v2"), item("_HLS_skip")).alias("skip")
        )
    )
