"""Playlists as rows: lines, then headers, segments, variants, renditions and the rest.

A text is split into lines once; what depends on the lines before it (the tags that wait for a URI,
the ones that stay in force) is a window over the lines of its document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import attributes as A
from ..functions import text as T

#: Tags that make a playlist a master or a media one.
MASTER_TAGS = ("#EXT-X-STREAM-INF:", "#EXT-X-I-FRAME-STREAM-INF:", "#EXT-X-MEDIA:")
MEDIA_TAGS = ("#EXTINF:", "#EXT-X-TARGETDURATION:")

#: Encryption methods, kinds of renditions and of preload hints.
METHODS = ("NONE", "AES-128", "SAMPLE-AES", "SAMPLE-AES-CTR")
RENDITIONS = ("AUDIO", "VIDEO", "SUBTITLES", "CLOSED-CAPTIONS")
HINTS = ("PART", "MAP")

#: The attributes that a tag must have, with their kind or the values allowed, by kind of playlist.
REQUIRED = {
    "master": {
        "EXT-X-STREAM-INF": {"BANDWIDTH": "int"},
        "EXT-X-I-FRAME-STREAM-INF": {"BANDWIDTH": "int", "URI": "text"},
        "EXT-X-MEDIA": {"TYPE": RENDITIONS, "GROUP-ID": "text", "NAME": "text"},
        "EXT-X-SESSION-DATA": {"DATA-ID": "text"},
        "EXT-X-SESSION-KEY": {"METHOD": METHODS},
        "EXT-X-CONTENT-STEERING": {"SERVER-URI": "text"},
        "EXT-X-START": {"TIME-OFFSET": "double"},
    },
    "media": {
        "EXT-X-KEY": {"METHOD": METHODS},
        "EXT-X-MAP": {"URI": "text", "BYTERANGE": "range"},
        "EXT-X-DATERANGE": {"ID": "text", "START-DATE": "date"},
        "EXT-X-PART": {"URI": "text", "DURATION": "double"},
        "EXT-X-PART-INF": {"PART-TARGET": "double"},
        "EXT-X-PRELOAD-HINT": {"TYPE": HINTS, "URI": "text"},
        "EXT-X-RENDITION-REPORT": {"URI": "text"},
        "EXT-X-SKIP": {"SKIPPED-SEGMENTS": "int"},
        "EXT-X-START": {"TIME-OFFSET": "double"},
    },
}
#: Tags of one whole number, and names under which problems of a tag are told.
NUMBERS = ("EXT-X-TARGETDURATION", "EXT-X-MEDIA-SEQUENCE", "EXT-X-DISCONTINUITY-SEQUENCE")
TOLD_AS = {"EXT-X-SESSION-KEY": "EXT-X-KEY"}

#: What is said of texts that can't be scanned.
SAID = {
    "emptyManifest": "The manifest is empty or contains only whitespace.",
    "missingHeader": "The playlist does not start with #EXTM3U.",
    "ambiguousPlaylistType": "Unable to determine if the manifest is a master or media playlist.",
}


def _trimmed(text: Column) -> Column:
    """The lines of a text, empty ones included."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\r\n|\n|\r"), lambda x: F.btrim(x, F.lit(" \t")))


def _numbered(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Explodes the array _l to (columns, line_no, line, tag, value, is_uri), empty lines left out."""
    rows = rows.select(*columns, F.posexplode("_l").alias("_n", "line")).where("line <> ''")
    mark = F.col("line").startswith("#")
    return rows.select(
        *columns, (F.col("_n") + 1).alias("line_no"), "line",
        F.when(mark, F.substring_index("line", ":", 1)).alias("tag"),
        F.when(mark & (F.instr("line", ":") > 0), F.substr("line", F.instr("line", ":") + 1)).alias("value"),
        (~mark).alias("is_uri"),
    )


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(key, *keep, line_no, line, tag, value, is_uri): trimmed lines that aren't empty, numbered from 1.

    tag is the part of a # line up to its colon; comments have the tag of their text."""
    return _numbered(docs.select(F.col(key), *(keep or []), _trimmed(F.col(text)).alias("_l")), [key, *(keep or [])])


def _kind_and_error(rows: Column) -> tuple[Column, Column]:
    """(master or media, error code) of the array of a text's lines; one of them is null."""
    found = F.filter(rows, lambda x: x != "")
    has = lambda tags: F.exists(found, lambda x: reduce(Column.__or__, [x.startswith(t) for t in tags]))
    master = has(MASTER_TAGS)
    error = F.when(F.size(found) == 0, "emptyManifest").when(F.element_at(found, 1) != "#EXTM3U", "missingHeader")
    error = error.when(~master & ~has(MEDIA_TAGS), "ambiguousPlaylistType")
    return F.when(error.isNull(), F.when(master, "master").otherwise("media")), error


def classify(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(key, *keep, kind, error): master, media, or the error emptyManifest, missingHeader, ambiguousPlaylistType."""
    kind, error = _kind_and_error(_trimmed(F.col(text)))
    return docs.select(key, *(keep or []), kind.alias("kind"), error.alias("error"))


def _problem(code: str, *message: Column | str) -> Column:
    text = F.concat(*[m if isinstance(m, Column) else F.lit(m) for m in message])
    return F.struct(F.lit(code).alias("code"), text.alias("message"))


def _bad_value(tag: str, attribute: str, value: Column) -> Column:
    return _problem("invalidAttributeValue", "Invalid value '", value, f"' for attribute '{attribute}' in {tag}.")


def _range_problem(value: Column) -> Column:
    """Of LENGTH[@OFFSET]."""
    p = F.filter(F.split(value, "@"), lambda x: x != "")
    length, offset = F.try_element_at(p, F.lit(1)), F.try_element_at(p, F.lit(2))
    whole = r"^[+-]?\d{1,18}$"
    bad = F.when(F.coalesce(~length.rlike(whole), F.lit(True)), _bad_value("EXT-X-BYTERANGE", "length", value))
    return bad.when(~offset.rlike(whole), _bad_value("EXT-X-BYTERANGE", "offset", offset))


def _attribute_problem(tag: str, rules: dict, m: Column) -> Column:
    checks, told = [], TOLD_AS.get(tag, tag)
    good = {"int": A.int_of, "double": A.double_of, "text": A.text_of, "date": lambda m, k: T.parse_iso8601(A.text_of(m, k))}
    for name, kind in rules.items():
        raw = A.text_of(m, name)
        if kind == "range":
            checks.append(F.when(raw.isNotNull(), _range_problem(raw)))
            continue
        checks.append(F.when(raw.isNull(), _problem("missingRequiredAttribute", f"Missing required attribute '{name}' in {told}.")))
        if kind != "text":
            wrong = ~raw.isin(*kind) if isinstance(kind, tuple) else good[kind](m, name).isNull()
            checks.append(F.when(wrong, _bad_value(told, name, raw)))
    return F.coalesce(*checks)


def line_problem(kind: Column, m: Column) -> Column:
    """What is wrong with a tag's value, as struct(code, message); null if nothing is. m: its attribute map."""
    tag, value = F.col("tag"), F.col("value")
    out = F.when(
        tag == "#EXT-X-VERSION",
        F.when(version(value).isNull(), _problem("invalidVersion", "Invalid or unsupported EXT-X-VERSION value: ", value, "."))
    )
    for which, tags in REQUIRED.items():
        for name, rules in tags.items():
            out = out.when((kind == which) & (tag == f"#{name}"), _attribute_problem(name, rules, m))
    media = kind == "media"
    number = F.col("line_no").cast("string")
    for name in NUMBERS:
        out = out.when(
            media & (tag == f"#{name}"),
            F.when(~value.rlike(r"^[+-]?\d{1,18}$"), _problem("invalidTagFormat", f"Invalid format for tag '{name}' at line ", number, "."))
        )
    seconds = extinf_seconds(value)
    out = out.when(media & (tag == "#EXTINF"), F.when(seconds.isNull(), _bad_value("EXTINF", "duration", value)))
    out = out.when(media & (tag == "#EXT-X-BYTERANGE"), _range_problem(value))
    return out.when(
        media & (tag == "#EXT-X-PROGRAM-DATE-TIME"),
        F.when(T.parse_iso8601(value).isNull(), _bad_value("EXT-X-PROGRAM-DATE-TIME", "date", value))
    )


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kind, line_no, line, tag, value, is_uri, problem): lines() of every text with its kind, and
    what is wrong with a line as struct(code, message). A text that is no playlist has one line, its
    kind null. One pass without a shuffle."""
    rows = docs.select(key, _trimmed(F.col(text)).alias("_l"))
    kind, error = _kind_and_error(F.col("_l"))
    rows = rows.select(key, kind.alias("kind"), error.alias("_e"), F.when(error.isNull(), F.col("_l")).otherwise(F.array(F.lit("#"))).alias("_l"))
    said = reduce(lambda c, x: c.when(F.col("_e") == x[0], x[1]), SAID.items(), F.when(F.lit(False), ""))
    listed = [f"#{t}" for tags in REQUIRED.values() for t in tags]
    out = _numbered(rows, [key, "kind", "_e"])
    out = out.withColumn("_m", F.when(F.col("tag").isin(listed), A.attribute_map(F.col("value"))))
    known = F.col("kind").isNotNull() & F.col("value").isNotNull()
    problem = F.when(F.col("kind").isNull(), _problem("", said).withField("code", F.col("_e"))).when(known, line_problem(F.col("kind"), F.col("_m")))
    return out.withColumn("problem", problem).drop("_e", "_m")


def problems(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, code, message) of each text that is refused: its first bad line, or else a STREAM-INF that no
    URI follows or a missing target duration."""
    d = scanned.groupBy(key).agg(
        F.min_by("problem", F.when(F.col("problem").isNotNull(), F.col("line_no"))).alias("p"), F.first("kind").alias("kind"),
        F.max(
            F.when((F.col("tag") == "#EXT-X-STREAM-INF") & F.col("value").isNotNull(), F.col("line_no"))
        ).alias("_i"), F.max(F.when(F.col("is_uri"), F.col("line_no"))).alias("_u"),
        F.bool_or((F.col("tag") == "#EXT-X-TARGETDURATION") & F.col("value").isNotNull()).alias("_t"),
    )
    waits = (F.col("kind") == "master") & (F.col("_i") > F.coalesce("_u", F.lit(0)))
    no_uri = F.when(waits, _problem("missingURI", "Missing URI after EXT-X-STREAM-INF at line ", F.col("_i").cast("string"), "."))
    no_target = F.when(
        (F.col("kind") == "media") & ~F.coalesce("_t", F.lit(False)),
        _problem("missingRequiredTag", "Missing required tag: EXT-X-TARGETDURATION.")
    )
    return d.select(key, F.coalesce("p", no_uri, no_target).alias("p")).where("p is not null").select(key, "p.*")


def extinf_seconds(value: Column) -> Column:
    """The duration of an EXTINF's value; null if it is none."""
    first = F.trim(F.substring_index(F.regexp_replace(value, "^,+", ""), ",", 1))
    return F.when(first.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), first.try_cast("double"))


def _last(tag: str, value: str = "value") -> Column:
    """The value of a document's last such tag."""
    return F.max_by(F.col(value), F.when(F.col("tag") == tag, F.col("line_no")))


def _seen(tag: str) -> Column:
    return F.bool_or(F.coalesce(F.col("tag") == tag, F.lit(False)))


def version(value: Column) -> Column:
    """1 to 10, else null."""
    v = F.when(value.rlike(r"^\d{1,3}$"), value.try_cast("int"))
    return F.when(v.between(1, 10), v)


def media_headers(line_rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document: version, target_duration, media_sequence, discontinuity_sequence, playlist_type,
    flags, part_target, server control (map), and error when a required tag is missing or bad."""
    h = line_rows.groupBy(key).agg(
        _last("#EXT-X-VERSION").alias("_v"), _last("#EXT-X-TARGETDURATION").alias("_t"), _last("#EXT-X-MEDIA-SEQUENCE").alias("_m"),
        _last("#EXT-X-DISCONTINUITY-SEQUENCE").alias("_d"),
        _last("#EXT-X-PLAYLIST-TYPE").alias("playlist_type"), _seen("#EXT-X-ENDLIST").alias("has_endlist"),
        _seen("#EXT-X-I-FRAMES-ONLY").alias("iframes_only"), _seen("#EXT-X-INDEPENDENT-SEGMENTS").alias("independent_segments"),
        _last("#EXT-X-PART-INF").alias("_p"), _last("#EXT-X-SERVER-CONTROL").alias("_s"),
        _seen("#EXT-X-SERVER-CONTROL").alias("has_server_control"), _last("#EXT-X-START").alias("_start"),
        _last("#EXT-X-SKIP").alias("_skip"),
        F.count_if(F.col("tag") == "#EXT-X-PRELOAD-HINT").alias("hints"), F.count_if(F.col("tag") == "#EXT-X-DEFINE").alias("definitions"),
        F.count_if(F.col("tag") == "#EXT-X-PART").alias("parts"),
    )
    h = h.withColumn("_c", A.attribute_map(F.coalesce(F.col("_s"), F.lit("")))).withColumn(
        "_start", A.attribute_map(F.coalesce(F.col("_start"), F.lit("")))
    )
    control = F.col("_c")
    target = F.when(F.col("_t").rlike(r"^-?\d{1,9}$"), F.col("_t").try_cast("int"))
    number = lambda c: F.coalesce(F.when(F.col(c).rlike(r"^\d{1,18}$"), F.col(c).try_cast("long")), F.lit(0).cast("long"))
    return h.select(
        key, version(F.col("_v")).alias("version"), target.alias("target_duration"), number("_m").alias("media_sequence"),
        number("_d").alias("discontinuity_sequence"), "playlist_type", "has_endlist", "iframes_only", "independent_segments",
        A.double_of(A.attribute_map(F.coalesce(F.col("_p"), F.lit(""))), "PART-TARGET").alias("part_target"), "has_server_control",
        F.struct(
            A.bool_of(control, "CAN-BLOCK-RELOAD").alias("can_block_reload"),
            A.double_of(control, "CAN-SKIP-UNTIL").alias("can_skip_until"),
            A.bool_of(control, "CAN-SKIP-DATERANGES").alias("can_skip_dateranges"), A.double_of(control, "HOLD-BACK").alias("hold_back"),
            A.double_of(control, "PART-HOLD-BACK").alias("part_hold_back")
        ).alias("server_control"),
        F.struct(
            A.double_of(F.col("_start"), "TIME-OFFSET").alias("time_offset"),
            F.coalesce(A.bool_of(F.col("_start"), "PRECISE"), F.lit(False)).alias("precise")
        ).alias("start"),
        A.int_of(
            A.attribute_map(F.coalesce(F.col("_skip"), F.lit(""))), "SKIPPED-SEGMENTS"
        ).alias("skipped_segments"), "hints", "definitions", "parts",
        F.when(F.col("_t").isNull(), F.struct(F.lit("missingRequiredTag").alias("code"), F.lit("EXT-X-TARGETDURATION").alias("tag"))).when(
            F.col("_v").isNotNull() & version(F.col("_v")).isNull(),
            F.struct(F.lit("invalidVersion").alias("code"), F.lit("EXT-X-VERSION").alias("tag"))
        ).alias("error"),
    )


def key_struct(m: Column) -> Column:
    """A KEY's attributes as a struct; null without a KEY."""
    return F.when(
        m.isNotNull(),
        F.struct(
            A.text_of(m, "METHOD").alias("method"), A.text_of(m, "URI").alias("uri"), A.text_of(m, "IV").alias("iv"),
            A.text_of(m, "KEYFORMAT").alias("key_format"), A.text_of(m, "KEYFORMATVERSIONS").alias("key_format_versions")
        )
    )


def segments(line_rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, duration, title, uri, byte_range, date, discontinuity, gap, key_tag, map, bitrate).

    EXTINF, BYTERANGE, PROGRAM-DATE-TIME, DISCONTINUITY and GAP wait for the next URI; KEY, MAP and
    BITRATE hold for all that follow. A URI without EXTINF is dropped.
    """
    w = Window.partitionBy(key).orderBy("line_no")
    r = line_rows.withColumn("_g", F.coalesce(F.sum(F.col("is_uri").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    held = lambda tag: F.last(
        F.when(F.col("tag") == tag, F.coalesce(F.col("value"), F.lit(""))), ignorenulls=True
    ).over(w.rowsBetween(Window.unboundedPreceding, 0))
    r = r.withColumns({"_key": held("#EXT-X-KEY"), "_map": held("#EXT-X-MAP"), "_rate": held("#EXT-X-BITRATE")})
    at_uri = lambda c: F.max(F.when(F.col("is_uri"), F.col(c)))
    g = r.groupBy(key, "_g").agg(
        at_uri("line").alias("uri"), at_uri("_key").alias("_key"), at_uri("_map").alias("_map"), at_uri("_rate").alias("_rate"),
        _last("#EXTINF").alias("_inf"), _last("#EXT-X-BYTERANGE").alias("_range"), _last("#EXT-X-PROGRAM-DATE-TIME").alias("_date"),
        _seen("#EXT-X-DISCONTINUITY").alias("discontinuity"), _seen("#EXT-X-GAP").alias("gap")
    )
    g = g.where("uri is not null and _inf is not null")
    title = F.trim(F.substr("_inf", F.instr("_inf", ",") + 1))
    # maps are columns of their own, so that each list is taken apart once
    g = g.withColumn("_km", A.attribute_map(F.col("_key"))).withColumn("_mm", A.attribute_map(F.col("_map")))
    m = F.col("_mm")
    return g.select(
        key, (F.row_number().over(Window.partitionBy(key).orderBy("_g")) - 1).alias("pos"), extinf_seconds(F.col("_inf")).alias("duration"),
        F.when(
            (F.instr("_inf", ",") > 0) & (title != ""), title
        ).alias("title"), "uri", A.byte_range(F.col("_range")).alias("byte_range"), T.parse_iso8601(F.col("_date")).alias("date"), "discontinuity", "gap", key_struct(F.col("_km")).alias("key_tag"),
        F.when(
            F.col("_map").isNotNull(),
            F.struct(A.text_of(m, "URI").alias("uri"), A.byte_range(A.text_of(m, "BYTERANGE")).alias("byte_range"))
        ).alias("map"), F.col("_rate").try_cast("long").alias("bitrate"),
    )


def tagged(line_rows: DataFrame, tag: str, key: str = "doc_id") -> DataFrame:
    """(key, pos, line_no, attrs) of each line with that tag, in order."""
    r = line_rows.where(F.col("tag") == tag)
    return r.select(
        key, (F.row_number().over(Window.partitionBy(key).orderBy("line_no")) - 1).alias("pos"), "line_no",
        A.attribute_map(F.coalesce(F.col("value"), F.lit(""))).alias("attrs")
    )


def variants(line_rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Variant streams: a STREAM-INF binds to the next URI, a later one replaces one that waits; error where
    BANDWIDTH is missing or bad, or no URI follows."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    r = line_rows.withColumn("_g", F.coalesce(F.sum(F.col("is_uri").cast("int")).over(w), F.lit(0)))
    g = r.groupBy(key, "_g").agg(
        F.max(F.when(F.col("is_uri"), F.col("line"))).alias("uri"), _last("#EXT-X-STREAM-INF").alias("_i"),
        F.count_if(F.col("tag") == "#EXT-X-STREAM-INF").alias("_n")
    ).where("_n > 0")
    m = A.attribute_map(F.coalesce(F.col("_i"), F.lit("")))
    g = g.withColumn("m", m)
    t = lambda k: A.text_of(F.col("m"), k)
    known = lambda k, *values: F.when(t(k).isin(*values), t(k))
    return g.select(
        key, (
            F.row_number().over(Window.partitionBy(key).orderBy("_g")) - 1
        ).alias("pos"), F.coalesce("uri", F.lit("")).alias("uri"), A.int_of(F.col("m"),
        "BANDWIDTH").alias("bandwidth"), A.int_of(F.col("m"), "AVERAGE-BANDWIDTH").alias("average_bandwidth"),
        t("CODECS").alias("codecs"), t("SUPPLEMENTAL-CODECS").alias("supplemental_codecs"), A.resolution_of(F.col("m")).alias("resolution"), A.double_of(F.col("m"), "FRAME-RATE").alias("frame_rate"), known(
            "HDCP-LEVEL", "NONE", "TYPE-0", "TYPE-1"
        ).alias("hdcp_level"), known("VIDEO-RANGE", "SDR", "HLG", "PQ").alias("video_range"),
        t("AUDIO").alias("audio"), t("VIDEO").alias("video"), t("SUBTITLES").alias("subtitles"),
        t("CLOSED-CAPTIONS").alias("closed_captions"), t("REQ-VIDEO-LAYOUT").alias("video_layout"),
        F.coalesce(
            A.problem(F.col("m"), "EXT-X-STREAM-INF", BANDWIDTH="int"),
            F.when(
                F.col("uri").isNull(),
                F.struct(
                    F.lit("missingURI").alias("code"), F.lit("EXT-X-STREAM-INF").alias("tag"), F.lit("URI").alias("attribute"),
                    F.lit(None).cast("string").alias("value")
                )
            )
        ).alias("error"),
    )


def _project(rows: DataFrame, key: str, tag: str, fields: dict[str, Column], **required: str) -> DataFrame:
    return rows.select(key, "pos", *[c.alias(n) for n, c in fields.items()], A.problem(F.col("attrs"), tag, **required).alias("error"))


def _t(k: str) -> Column:
    return A.text_of(F.col("attrs"), k)


def _yes(k: str) -> Column:
    return F.coalesce(A.bool_of(F.col("attrs"), k), F.lit(False))


def renditions(line_rows: DataFrame, key: str = "doc_id") -> DataFrame:
    f = {
        "type": _t("TYPE"), "group_id": _t("GROUP-ID"), "name": _t("NAME"), "uri": _t("URI"), "language": _t("LANGUAGE"),
        "assoc_language": _t("ASSOC-LANGUAGE"), "is_default": _yes("DEFAULT"), "autoselect": _yes("AUTOSELECT"), "forced": _yes("FORCED"),
        "instream_id": _t("INSTREAM-ID"), "characteristics": _t("CHARACTERISTICS"), "channels": _t("CHANNELS")
    }
    return _project(tagged(line_rows, "#EXT-X-MEDIA", key), key, "EXT-X-MEDIA", f, TYPE="text", GROUP_ID="text", NAME="text")


def iframe_variants(line_rows: DataFrame, key: str = "doc_id") -> DataFrame:
    f = {"bandwidth": A.int_of(F.col("attrs"), "BANDWIDTH"), "uri": _t("URI"), "codecs": _t("CODECS"), "resolution": A.resolution_of(F.col("attrs"))}
    return _project(tagged(line_rows, "#EXT-X-I-FRAME-STREAM-INF", key), key, "EXT-X-I-FRAME-STREAM-INF", f, BANDWIDTH="int", URI="text")


def session_data(line_rows: DataFrame, key: str = "doc_id") -> DataFrame:
    return _project(
        tagged(line_rows, "#EXT-X-SESSION-DATA", key), key, "EXT-X-SESSION-DATA",
        {"data_id": _t("DATA-ID"), "value": _t("VALUE"), "uri": _t("URI"), "language": _t("LANGUAGE")}, DATA_ID="text"
    )


def session_keys(line_rows: DataFrame, key: str = "doc_id") -> DataFrame:
    return _project(
        tagged(line_rows, "#EXT-X-SESSION-KEY", key), key, "EXT-X-SESSION-KEY",
        {"method": _t("METHOD"), "uri": _t("URI"), "iv": _t("IV"), "key_format": _t("KEYFORMAT")}, METHOD="text"
    )


def steering(line_rows: DataFrame, key: str = "doc_id") -> DataFrame:
    return _project(
        tagged(line_rows, "#EXT-X-CONTENT-STEERING", key), key, "EXT-X-CONTENT-STEERING",
        {"server_uri": _t("SERVER-URI"), "pathway_id": _t("PATHWAY-ID")}, SERVER_URI="text"
    )


def definitions(line_rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """name, value and kind (value, import, queryparam); tags that name none are left out."""
    rows = tagged(line_rows, "#EXT-X-DEFINE", key)
    kind = F.when(_t("NAME").isNotNull(), "value").when(_t("IMPORT").isNotNull(), "import").when(_t("QUERYPARAM").isNotNull(), "queryparam")
    return rows.select(
        key, "pos", F.coalesce(_t("NAME"), _t("IMPORT"), _t("QUERYPARAM")).alias("name"),
        F.when(kind == "value", F.coalesce(_t("VALUE"), F.lit(""))).alias("value"), kind.alias("kind")
    ).where("kind is not null")


def resolved(table: DataFrame, line_rows: DataFrame, columns: tuple[str, ...], key: str = "doc_id") -> DataFrame:
    """table with the references in `columns` (of strings, or fields of structs) replaced by what the text
    defines by value; the last definition of a name holds."""
    d = definitions(line_rows, key).where("kind = 'value'")
    last = d.groupBy(key, "name").agg(F.max_by("value", "pos").alias("value"))
    values = last.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("_values"))
    out = table.join(values, key, "left")
    for c in columns:
        holder, _, field = c.partition(".")
        value = F.when(F.col("_values").isNotNull(), T.resolve_variables(F.col(c), F.col("_values"))).otherwise(F.col(c))
        out = out.withColumn(holder, F.when(F.col(holder).isNotNull(), F.col(holder).withField(field, value)) if field else value)
    return out.select(*table.columns)


def date_ranges(line_rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Date ranges with their X- attributes as a map; a bad END-DATE is null."""
    f = {
        "id": _t("ID"), "class": _t("CLASS"), "start_date": T.parse_iso8601(_t("START-DATE")), "end_date": T.parse_iso8601(_t("END-DATE")),
        "duration": A.double_of(F.col("attrs"), "DURATION"), "planned_duration": A.double_of(F.col("attrs"), "PLANNED-DURATION"),
        "end_on_next": _yes("END-ON-NEXT"), "client": F.map_filter("attrs", lambda k, _: k.startswith("X-"))
    }
    return _project(tagged(line_rows, "#EXT-X-DATERANGE", key), key, "EXT-X-DATERANGE", f, ID="text", START_DATE="text")


def parts(line_rows: DataFrame, key: str = "doc_id") -> DataFrame:
    f = {
        "uri": _t("URI"), "duration": A.double_of(F.col("attrs"), "DURATION"), "independent": _yes("INDEPENDENT"), "gap": _yes("GAP"),
        "byte_range": A.byte_range(_t("BYTERANGE"))
    }
    return _project(tagged(line_rows, "#EXT-X-PART", key), key, "EXT-X-PART", f, URI="text", DURATION="double")


def preload_hints(line_rows: DataFrame, key: str = "doc_id") -> DataFrame:
    return _project(
        tagged(line_rows, "#EXT-X-PRELOAD-HINT", key), key, "EXT-X-PRELOAD-HINT",
        {
            "type": F.when(_t("TYPE").isin("PART", "MAP"), _t("TYPE")), "uri": _t("URI"),
            "start": A.int_of(F.col("attrs"), "BYTERANGE-START"), "length": A.int_of(F.col("attrs"), "BYTERANGE-LENGTH")
        },
        TYPE="text", URI="text"
    )


def rendition_reports(line_rows: DataFrame, key: str = "doc_id") -> DataFrame:
    return _project(
        tagged(line_rows, "#EXT-X-RENDITION-REPORT", key), key, "EXT-X-RENDITION-REPORT",
        {"uri": _t("URI"), "last_msn": A.int_of(F.col("attrs"), "LAST-MSN"), "last_part": A.int_of(F.col("attrs"), "LAST-PART")},
        URI="text"
    )


def read_manifests(spark, path: str) -> DataFrame:
    """(path, text) of every playlist file under a path."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
