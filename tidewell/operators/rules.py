"""Validation rules over scanned playlists: each rule is a query that yields findings.

findings: (key, severity, message, field, rule_set, rule_id); severity is error, warning or info.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..sources import manifest as S
from ..stage import materialize

SEVERITY = {"error": 2, "warning": 1, "info": 0}


def sorted_join(rows: DataFrame) -> DataFrame:
    """A side of a join that has a row a document: shuffled and sorted, never broadcast. The optimizer would
    judge it by the few compressed bytes a row of its Parquet file and gather it in the driver."""
    return rows.hint("merge")


class Report:
    """Gathers findings. Rules about the same rows are tried in one pass over them."""

    def __init__(self, key: str, rule_set: str = "rfc8216"):
        self.key, self.rule_set, self.found = key, rule_set, []

    def finding(self, when: Column | str, rule: str, severity: str, field: str | Column, message: str | Column) -> Column:
        as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
        rule_set = "appleHLS" if rule.startswith("APPLE") else self.rule_set
        body = F.struct(
            F.lit(severity).alias("severity"), as_col(message).alias("message"), as_col(field).alias("field"),
            F.lit(rule_set).alias("rule_set"), F.lit(rule).alias("rule_id")
        )
        return F.when(F.expr(when) if isinstance(when, str) else when, body)

    def rules(self, rows: DataFrame, *rules: tuple) -> None:
        """rules: (condition, rule id, severity, field, message), all tried on each row."""
        hits = F.array_compact(F.array(*[self.finding(*r) for r in rules]))
        self.found.append(rows.select(self.key, F.explode(hits).alias("_f")).select(self.key, "_f.*"))

    def add(self, rows: DataFrame, rule: str, severity: str, field: str | Column, message: str | Column) -> None:
        """Every row is a finding."""
        self.rules(rows, (F.lit(True), rule, severity, field, message))

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.found)


def at(kind: str, field: str) -> Column:
    return F.concat(F.lit(f"{kind}["), F.col("pos").cast("string"), F.lit(f"].{field}"))


def double_text(x: Column) -> Column:
    """A double as the messages write it: at least one decimal."""
    return F.when(x == F.floor(x), F.concat(F.floor(x).cast("string"), F.lit(".0"))).otherwise(x.cast("string"))


def video_layout(text: Column) -> Column:
    """struct(channels, projection) of a REQ-VIDEO-LAYOUT: the last known token of each kind; others are ignored."""
    tokens = F.transform(F.split(text, ","), lambda t: F.trim(t))
    last = lambda *known: F.try_element_at(F.filter(tokens, lambda t: t.isin(*known)), F.lit(-1))
    return F.struct(
        last("CH-STEREO", "CH-MONO").alias("channels"),
        last("PROJ-RECT", "PROJ-EQUI", "PROJ-HEQU", "PROJ-PRIM", "PROJ-AIV").alias("projection")
    )


def layout_fits(source: Column, target: Column) -> Column:
    """Whether audio of `source` channels can be brought to `target` channels: never to more."""
    return source >= target


def master_findings(line_rows: DataFrame, key: str = "doc_id", variants: DataFrame | None = None) -> DataFrame:
    """Rules and recommendations for master playlists. variants: those of line_rows, if already scanned."""
    r = Report(key)
    v = S.variants(line_rows, key) if variants is None else variants
    m, d = S.renditions(line_rows, key), S.session_data(line_rows, key)
    # a document's group ids travel with its variants: references need no join per kind
    ids = lambda kind: F.collect_set(F.when(F.col("type") == kind, F.col("group_id")))
    groups = m.groupBy(key).agg(ids("AUDIO").alias("_a"), ids("SUBTITLES").alias("_s"), ids("CLOSED-CAPTIONS").alias("_c"))
    known = lambda ids, x: F.coalesce(F.array_contains(ids, x), F.lit(False))
    undefined = lambda attribute, c: F.concat(F.lit(f'{attribute} attribute references undefined GROUP-ID "'), F.col(c), F.lit('".'))
    look = video_layout(F.col("video_layout"))
    is_ = lambda part, x: F.coalesce(look[part] == x, F.lit(False))
    stereo, immersive = is_("channels", "CH-STEREO"), is_("projection", "PROJ-AIV")
    half, bare = is_("projection", "PROJ-HEQU"), look["channels"].isNull()
    layout = ("APPLE-2.9-video-layout", "warning", at("variants", "videoLayoutDescriptor"))
    r.rules(
        v.join(groups, key, "left"),
        ("bandwidth <= 0", "RFC8216-4.3.4.2-bandwidth", "error", at("variants", "bandwidth"), "BANDWIDTH must be a positive integer."),
        ("uri = ''", "RFC8216-4.3.4.2-uri", "error", at("variants", "uri"), "Variant stream must have a URI."),
        (
            "resolution is null", "RFC8216-4.3.4.2-resolution", "warning", at("variants", "resolution"),
            "Variants with video should include RESOLUTION."
        ),
        (
            F.col("audio").isNotNull() & ~known(F.col("_a"), F.col("audio")), "RFC8216-4.3.4.2-audio-ref", "error",
            at("variants", "audio"), undefined("AUDIO", "audio")
        ),
        (
            F.col("subtitles").isNotNull() & ~known(F.col("_s"), F.col("subtitles")), "RFC8216-4.3.4.2-subtitle-ref", "error",
            at("variants", "subtitles"), undefined("SUBTITLES", "subtitles")
        ),
        (
            F.col("closed_captions").isNotNull() & (F.col("closed_captions") != "NONE") & ~known(F.col("_c"), F.col("closed_captions")),
            "RFC8216-4.3.4.2-cc-ref", "error", at("variants", "closedCaptions"), undefined("CLOSED-CAPTIONS", "closed_captions")
        ),
        (
            "codecs is null", "APPLE-2.1-codecs", "warning", at("variants", "codecs"),
            "Apple recommends including CODECS attribute for all variant streams."
        ),
        (
            "resolution is not null and frame_rate is null", "APPLE-2.1-frame-rate", "warning", at("variants", "frameRate"),
            "Video variants should include FRAME-RATE."
        ),
        (
            "resolution.height >= 2160 and hdcp_level is null", "APPLE-2.6-hdcp", "info", at("variants", "hdcpLevel"),
            "4K content should specify HDCP-LEVEL."
        ),
        (
            "supplemental_codecs is not null and codecs is null", "APPLE-2.8-supplemental-codecs", "warning",
            at("variants", "supplementalCodecs"),
            "SUPPLEMENTAL-CODECS present without CODECS. The CODECS attribute should also be specified."
        ),
        (immersive & ~stereo, *layout, "PROJ-AIV needs CH-STEREO."),
        (half & bare, *layout, "PROJ-HEQU typically needs CH-STEREO."),
        (stereo & F.col("supplemental_codecs").isNull(), *layout, "CH-STEREO without SUPPLEMENTAL-CODECS."),
    )
    falls = F.col("bandwidth") < F.lag("bandwidth").over(Window.partitionBy(key).orderBy("pos"))
    tier = lambda h: F.bool_or(F.coalesce(F.col("resolution.height") >= h, F.lit(False))).cast("int").alias(f"h{h}")
    whole = v.withColumn("_f", falls).groupBy(key).agg(
        F.count("*").alias("n"), F.bool_or("_f").alias("falls"), F.countDistinct("video_range").alias("ranges"), tier(480), tier(720),
        tier(1080)
    )
    iframes = line_rows.groupBy(key).agg(F.count_if(F.col("tag") == "#EXT-X-I-FRAME-STREAM-INF").alias("iframes"))
    r.rules(
        iframes.join(whole, key, "left"),
        ("n is null", "RFC8216-general-variants", "warning", "variants", "Master playlist should have at least one variant."),
        ("iframes = 0", "APPLE-2.2-iframe", "info", "iFrameVariants", "Master playlist should include I-frame playlists."),
        (
            "n >= 3 and h480 + h720 + h1080 < 3", "APPLE-2.4-resolution-ladder", "info", "variants",
            "At least 3 quality tiers recommended (480p, 720p, 1080p)."
        ),
        ("falls", "APPLE-2.5-bandwidth-order", "info", "variants", "Variants should be listed in ascending bandwidth order."),
        (
            "ranges > 1", "APPLE-2.7-video-range", "warning", "variants",
            "Master playlist contains mixed VIDEO-RANGE values. Ensure proper variant grouping for HDR/SDR."
        ),
    )
    where = F.concat(F.lit("renditions["), "type", F.lit("|"), "group_id", F.lit("]"))
    r.rules(
        m.groupBy(key, "type", "group_id").agg(
            F.count("name").alias("n"), F.countDistinct("name").alias("d"), F.count_if("is_default").alias("defaults")
        ),
        ("d <> n", "RFC8216-4.3.4.1-group-id", "error", where, "Renditions with same TYPE and GROUP-ID must not duplicate NAME."),
        ("defaults > 1", "RFC8216-4.3.4.1-default", "warning", where, "At most one rendition in a group should have DEFAULT=YES."),
    )
    audio = m.where("type = 'AUDIO'").withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1)
    r.rules(
        audio,
        ("language is null", "APPLE-2.3-audio-group", "warning", at("renditions", "language"), "Audio renditions should specify LANGUAGE.")
    )
    place = F.concat(F.lit("sessionData["), F.col("pos").cast("string"), F.lit("]"))
    r.rules(
        d,
        (
            "value is not null and uri is not null", "RFC8216-4.3.4.5-session-data-value", "error", place,
            "SESSION-DATA must have VALUE or URI, not both."
        ),
        ("value is null and uri is null", "RFC8216-4.3.4.5-session-data-value", "error", place, "SESSION-DATA must have either VALUE or URI."),
    )
    twice = d.groupBy(key, "data_id").agg(F.count("language").alias("n"), F.countDistinct("language").alias("d")).where("n <> d")
    r.add(
        twice, "RFC8216-4.3.4.5-session-data-id", "error", "sessionData",
        F.concat(F.lit('SESSION-DATA with DATA-ID "'), "data_id", F.lit('" must not duplicate LANGUAGE.'))
    )
    return r.all()


def features(segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per media playlist: number and mean duration of segments, and which features they use."""
    use = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    return segments.groupBy(key).agg(
        F.count("*").alias("segments"), F.avg("duration").alias("mean"), use(F.col("duration") % 1 != 0).alias("decimals"),
        use(F.col("byte_range").isNotNull()).alias("ranges"), use(F.col("map").isNotNull()).alias("maps"),
        use(F.col("key_tag.iv").isNotNull()).alias("ivs"), use(
            F.col("key_tag.key_format").isNotNull() | F.col("key_tag.key_format_versions").isNotNull()
        ).alias("formats"),
    )


def required_version() -> Column:
    """The least version for the features of a row of features() joined to its header, low latency aside."""
    use = lambda c, v: F.when(F.col(c), v).otherwise(1)
    return F.greatest(
        use("decimals", 3), use("ranges", 4), use("iframes_only", 4), use("ivs", 2), use("formats", 5),
        F.when(F.col("maps") & ~F.col("iframes_only"), 6).otherwise(1), F.when(F.col("definitions") > 0, 8).otherwise(1)
    )


def required_version_master(hdcp: Column, definitions: Column, steering: Column) -> Column:
    """The least version of a master playlist: 10 with steering, 8 with definitions, 7 with HDCP levels."""
    return F.when(steering, 10).when(definitions, 8).when(hdcp, 7).otherwise(1)


def media_findings(line_rows: DataFrame, key: str = "doc_id", segments: DataFrame | None = None) -> DataFrame:
    """Rules and recommendations for media playlists, low latency included. segments: those of
    line_rows, if already scanned. Headers and the join of both are written once."""
    r = Report(key)
    h = materialize(S.media_headers(line_rows, key).where("error is null"), "headers")
    s, p = S.segments(line_rows, key) if segments is None else segments, S.parts(line_rows, key)
    hs = s.join(sorted_join(h.select(key, "version", "target_duration")), key)
    target = F.col("target_duration").cast("string")
    r.rules(
        hs,
        (
            F.round("duration") > F.col("target_duration"), "RFC8216-4.3.3.1-segment-duration", "error", at("segments", "duration"),
            F.concat(F.lit("Segment duration "), double_text(F.col("duration")), F.lit("s exceeds TARGETDURATION "), target, F.lit("s."))
        ),
        ("duration < 0", "RFC8216-4.3.2.1-extinf", "error", at("segments", "duration"), "Segment duration must not be negative."),
        ("uri = ''", "RFC8216-4.3.2.1-uri", "error", at("segments", "uri"), "Segment URI must not be empty."),
        (
            "key_tag.method <> 'NONE' and key_tag.uri is null", "RFC8216-4.3.2.4-key-uri", "error", at("segments", "key.uri"),
            "EXT-X-KEY with METHOD != NONE must have URI."
        ),
        (
            "key_tag.iv is not null and version < 2", "RFC8216-4.3.2.4-key-iv", "error", at("segments", "key.iv"),
            "EXT-X-KEY with IV requires version >= 2."
        ),
    )
    doc = h.join(sorted_join(features(s, key)), key, "left").fillna(
        False, ["decimals", "ranges", "maps", "ivs", "formats"]
    ).withColumn("required", required_version())
    low = "(has_server_control or part_target is not null or parts > 0 or hints > 0)"
    slow = "(not has_server_control and part_target is null)"
    r.rules(
        doc,
        ("target_duration <= 0", "RFC8216-4.3.3.1-integer", "error", "targetDuration", "TARGETDURATION must be a positive integer."),
        ("segments is null", "RFC8216-general-empty", "warning", "segments", "Playlist should have at least one segment."),
        (
            "playlist_type = 'VOD' and not has_endlist", "RFC8216-4.3.3.5-endlist-vod", "error", "hasEndList",
            "VOD playlists must contain EXT-X-ENDLIST."
        ),
        ("ranges and version < 4", "RFC8216-4.3.2.2-byterange-version", "error", "version", "EXT-X-BYTERANGE requires version >= 4."),
        (
            "maps and not iframes_only and version < 6", "RFC8216-4.3.2.5-map-version", "error", "version",
            "EXT-X-MAP without I-FRAMES-ONLY requires version >= 6."
        ),
        (
            "version < required", "RFC8216-4.4.3-version-match", "warning", "version",
            F.concat(
                F.lit("Features used require version >= "), F.col("required").cast("string"), F.lit(" but declared version is "),
                F.col("version").cast("string"), F.lit(".")
            )
        ),
        (
            "parts > 0 and part_target is null", "RFC8216bis-part-inf", "error", "partTargetDuration",
            "Playlists with PART tags must have EXT-X-PART-INF."
        ),
        (
            f"{low} and not has_server_control", "RFC8216bis-server-control", "warning", "serverControl",
            "LL-HLS playlists should have EXT-X-SERVER-CONTROL."
        ),
        (
            "server_control.part_hold_back < 3 * part_target", "RFC8216bis-hold-back", "warning", "serverControl.partHoldBack",
            "PART-HOLD-BACK should be >= 3x PART-TARGET."
        ),
        (f"{low} and version < 9", "RFC8216bis-version", "error", "version", "LL-HLS features require version >= 9."),
        ("mean < 4 or mean > 8", "APPLE-3.1-segment-duration", "info", "segments", "Segment durations should be approximately 6 seconds."),
        (f"not {slow} and target_duration > 4", "APPLE-3.2-target-duration", "info", "targetDuration", "TARGETDURATION should be <= 4 for LL-HLS."),
        (
            f"{slow} and target_duration <> 6 and segments > 0", "APPLE-3.2-target-duration", "info", "targetDuration",
            "TARGETDURATION should be 6 for standard playlists."
        ),
        ("not independent_segments", "APPLE-3.5-independent", "warning", "independentSegments", "EXT-X-INDEPENDENT-SEGMENTS recommended."),
        ("segments > 0 and not maps", "APPLE-3.4-fmp4", "info", "segments", "fMP4 (EXT-X-MAP) preferred over MPEG-TS."),
    )
    r.rules(
        p.join(sorted_join(h.where("parts > 0").select(key, "part_target")), key),
        (
            "duration > part_target", "RFC8216bis-part-duration", "error", at("partialSegments", "duration"),
            F.concat(
                F.lit("PART duration "), double_text(F.col("duration")), F.lit("s exceeds PART-TARGET "),
                double_text(F.col("part_target")), F.lit("s.")
            )
        )
    )
    return r.all()


def variable_rules(line_rows: DataFrame, fields: DataFrame, media: bool, key: str = "doc_id") -> DataFrame:
    """Rules of variable definitions. fields: (key, field, text) of everything that may hold references.

    Cycles of one and two definitions are found, as specified; longer ones are not looked for."""
    r = Report(key, "rfc8216")
    d = S.definitions(line_rows, key)
    if media:
        r.add(
            d.where("kind = 'import'"), "RFC8216bis-4.4.3.8-import", "error", "definitions",
            F.concat(F.lit('IMPORT "'), "name", F.lit('" requires a multivariant playlist context.'))
        )
    again = d.withColumn("_k", F.row_number().over(Window.partitionBy(key, "name").orderBy("pos"))).where("_k > 1")
    r.add(again, "RFC8216bis-4.4.3.8-duplicate", "warning", "definitions", F.concat(F.lit('Duplicate EXT-X-DEFINE name "'), "name", F.lit('".')))
    edges = d.where("kind = 'value'").select(key, "name", F.explode(F.array_distinct(T.variable_names(F.col("value")))).alias("ref"))
    r.add(
        edges.where("name = ref"), "RFC8216bis-4.4.3.8-circular", "error", "definitions",
        F.concat(F.lit('Circular reference: variable "'), "name", F.lit('" references itself.'))
    )
    back = edges.select(key, F.col("name").alias("ref"), F.col("ref").alias("name"))
    r.add(
        edges.where("name <> ref").join(back, [key, "name", "ref"], "left_semi"), "RFC8216bis-4.4.3.8-circular", "error", "definitions",
        F.concat(F.lit('Circular reference between "'), "name", F.lit('" and "'), "ref", F.lit('".'))
    )
    known = d.where("kind <> 'queryparam'").select(key, F.col("name").alias("ref")).distinct()
    uses = fields.select(key, "field", F.explode(T.variable_names(F.col("text"))).alias("ref"))
    r.add(
        uses.join(known, [key, "ref"], "left_anti"), "RFC8216bis-4.4.3.8-undefined", "error", F.col("field"),
        F.concat(F.lit('Undefined variable reference "{$'), "ref", F.lit('}".'))
    )
    return r.all()


def master_fields(line_rows: DataFrame, variants: DataFrame, key: str = "doc_id") -> DataFrame:
    one = lambda rows, kind: rows.where("uri like '%{$%'").select(key, at(kind, "uri").alias("field"), F.col("uri").alias("text"))
    return one(variants, "variants").unionByName(
        one(S.iframe_variants(line_rows, key), "iFrameVariants")
    ).unionByName(one(S.renditions(line_rows, key), "renditions"))


def media_fields(segments: DataFrame, key: str = "doc_id") -> DataFrame:
    one = lambda name, text: F.when(text.contains("{$"), F.struct(at("segments", name).alias("field"), text.alias("text")))
    found = F.array_compact(F.array(one("uri", F.col("uri")), one("key.uri", F.col("key_tag.uri")), one("map.uri", F.col("map.uri"))))
    return segments.select(key, F.explode(found).alias("_x")).select(key, "_x.*")


def validate(docs: DataFrame, rule_set: str = "all", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Findings of whole texts: rfc8216, appleHLS or all. A text that can't be scanned gives one error
    of rule_id `parse` (field: the kind of error), whatever the rule set, and no other finding.

    Texts are read once; scanned lines, segments, headers and variants are each written once to the
    shared folder. Only refused texts and two booleans decide what is planned.
    """
    staged = materialize(S.scan(docs, key, text), "lines")
    refused = materialize(S.problems(staged, key), "refused")
    out = [
        refused.select(
            key, F.lit("error").alias("severity"), F.col("message"), F.col("code").alias("field"), F.lit("rfc8216").alias("rule_set"),
            F.lit("parse").alias("rule_id")
        )
    ]
    good = staged.drop("problem")
    if refused.limit(1).count():
        good = good.join(sorted_join(refused.select(key)), key, "left_anti")
    for kind in ("master", "media"):
        rows = good.where(F.col("kind") == kind).drop("kind")
        if not staged.where(F.col("kind") == kind).limit(1).count():
            continue
        parts = materialize(S.variants(rows, key) if kind == "master" else S.segments(rows, key), kind)
        found = master_findings(rows, key, parts) if kind == "master" else media_findings(rows, key, parts)
        out.append(found if rule_set == "all" else found.where(F.col("rule_set") == rule_set))
        if rule_set != "appleHLS":
            fields = master_fields(rows, parts, key) if kind == "master" else media_fields(parts, key)
            out.append(variable_rules(rows, fields, kind == "media", key))
    return reduce(DataFrame.unionByName, out)


def roll_up(docs: DataFrame, findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document: errors, warnings, infos, and whether it is valid (no errors)."""
    f = findings.groupBy(key).agg(*[F.count_if(F.col("severity") == s).alias(f"{s}s") for s in SEVERITY])
    return docs.select(key).join(sorted_join(f), key, "left").fillna(0).withColumn("is_valid", F.col("errors") == 0)


def ladder_checks(variants: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Per ladder: mixed ranges, mixed codec families (before the dot), bandwidths that don't ascend."""
    w = Window.partitionBy(*keys).orderBy(order)
    v = variants.withColumn("_f", F.col("bandwidth") <= F.lag("bandwidth").over(w)).withColumn("_c", F.substring_index("codecs", ".", 1))
    return v.groupBy(*keys).agg(
        (F.countDistinct("video_range") > 1).alias("mixed_ranges"), (F.countDistinct("_c") > 1).alias("mixed_codecs"),
        F.coalesce(F.bool_or("_f"), F.lit(False)).alias("not_ascending")
    )


def redundancy(uris: DataFrame, keys: list[str]) -> DataFrame:
    """URIs that a document uses more than once."""
    return uris.groupBy(*keys, "uri").agg(F.count("*").alias("uses")).where("uses > 1")
