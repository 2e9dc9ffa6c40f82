"""Queries over playlists that are rendered from the driver's tables, scanned back and validated.

The SQL works on the tables alone: it never sees a playlist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import attributes as A
from ..functions import text as T
from ..operators import rules
from ..sources import manifest as S
from ..sources import sinks
from .registry import load, query


def media_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One media playlist per order: segments are its lines."""
    li = load(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    k = F.col("l_orderkey")
    none = F.lit(None)
    s = li.select(
        k.alias("doc_id"), (F.row_number().over(w) - 1).alias("pos"),
        (
            F.col("l_quantity") + F.when(F.col("l_linenumber") % 2 == 1, 0.5).otherwise(0.0) - F.when(F.col("l_discount") > 0.095, 60.0).otherwise(0.0)
        ).alias("duration"),
        F.when(F.col("l_linenumber") == 3, "Part, three").alias("title"), F.concat(
            F.lit("seg_"), F.col("l_partkey").cast("string"), F.lit(".ts")
        ).alias("uri"),
        F.when(
            F.col("l_linestatus") == "O", F.struct(F.col("l_partkey").alias("length"), none.cast("long").alias("offset"))
        ).alias("byte_range"), none.cast("timestamp").alias("date"), (F.col("l_returnflag") == "R").alias("discontinuity"), F.lit(False).alias("gap"),
        F.when(
            k % 5 == 0,
            F.struct(
                F.lit("AES-128").alias("method"), F.when(k % 10 == 0, "https://k/1").alias("uri"),
                F.when(k % 3 == 0, "0x0000000000000000000000000000000F").alias("iv"), F.when(k % 4 == 0, "identity").alias("key_format"),
                none.cast("string").alias("key_format_versions")
            )
        ).alias("key_tag"),
        F.when(
            k % 6 == 0, F.struct(F.lit("init.mp4").alias("uri"), none.cast("struct<length:bigint,offset:bigint>").alias("byte_range"))
        ).alias("map"), none.cast("long").alias("bitrate"),
    )
    h = li.select(k.alias("doc_id")).distinct().select(
        "doc_id", (F.col("doc_id") % 9 + 1).cast("int").alias("version"),
        F.when(F.col("doc_id") % 7 == 0, 0).when(F.col("doc_id") % 7 == 1, 6).otherwise(25).alias("target_duration"),
        (F.col("doc_id") % 50).alias("media_sequence"), F.lit(0).alias("discontinuity_sequence"),
        F.when(F.col("doc_id") % 2 == 0, "VOD").alias("playlist_type"), (F.col("doc_id") % 3 == 0).alias("has_endlist"),
        (F.col("doc_id") % 11 == 0).alias("iframes_only"), (F.col("doc_id") % 4 == 0).alias("independent_segments"),
    )
    return sinks.media_playlist(h, s)


#: The same segments, straight from the table. Versions under 3 write whole seconds.
MEDIA_SQL = """
WITH s AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
  l_extendedprice) - 1 AS pos,
  l_quantity + CASE WHEN l_linenumber % 2 = 1 THEN 0.5 ELSE 0 END - CASE WHEN l_discount > 0.095 THEN 60 ELSE 0 END AS d0, l_partkey,
  l_linestatus = 'O' AS ranged, l_returnflag = 'R' AS disc, l_linenumber FROM lineitem),
x AS (SELECT *, CASE WHEN k % 9 + 1 < 3 THEN round(d0) ELSE d0 END AS d, (k % 9 + 1)::INT AS v, CASE k % 7 WHEN 0 THEN 0 WHEN 1 THEN 6
  ELSE 25 END AS target FROM s),
g AS (SELECT k, any_value(v) AS v, any_value(target) AS target, avg(d) AS mean, bool_or(d <> trunc(d)) AS decimals, bool_or(ranged) AS ranged FROM x
  GROUP BY k),
n AS (SELECT *, greatest(1, CASE WHEN decimals THEN 3 ELSE 1 END, CASE WHEN ranged THEN 4 ELSE 1 END, CASE WHEN k % 11 = 0 THEN 4 ELSE 1 END, CASE
  WHEN k % 5 = 0 AND k % 3 = 0 THEN 2 ELSE 1 END, CASE WHEN k % 5 = 0 AND k % 4 = 0 THEN 5 ELSE 1 END, CASE WHEN k % 6 = 0 AND k % 11 <> 0 THEN 6
  ELSE 1 END) AS need FROM g)
"""


@query(MEDIA_SQL + """SELECT k AS doc_id, pos::INT AS pos, d::DOUBLE AS duration, CASE WHEN l_linenumber = 3 THEN 'Part, three' END AS title, 'seg_'
  || l_partkey || '.ts' AS uri, CASE WHEN ranged THEN l_partkey END AS range_length, disc AS discontinuity,
  CASE WHEN k % 5 = 0 AND k % 10 = 0 THEN 'https://k/1' END AS key_uri, CASE WHEN k % 6 = 0 THEN 'init.mp4' END AS map_uri FROM x""")
def manifest_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.1.1, 2.1.3, 2.1.4, 2.1.18–2.1.21, 2.2.3–2.2.5, 2.2.8–2.2.11, 2.12.1, 2.12.2: rendered and scanned back."""
    s = S.segments(S.lines(media_texts(spark, sf_dir)))
    return s.select(
        "doc_id", "pos", "duration", "title", "uri", F.col("byte_range.length").alias("range_length"), "discontinuity",
        F.col("key_tag.uri").alias("key_uri"), F.col("map.uri").alias("map_uri")
    )


@query("""SELECT DISTINCT l_orderkey AS doc_id, (l_orderkey % 9 + 1)::INT AS version, (CASE l_orderkey % 7 WHEN 0 THEN 0 WHEN 1 THEN 6
  ELSE 25 END)::INT AS target_duration, (l_orderkey % 50)::BIGINT AS media_sequence,
  CASE WHEN l_orderkey % 2 = 0 THEN 'VOD' END AS playlist_type, l_orderkey % 3 = 0 AS has_endlist, l_orderkey % 11 = 0 AS iframes_only,
  l_orderkey % 4 = 0 AS independent_segments FROM lineitem""")
def manifest_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.1.1, 2.1.5: headers of media playlists; version 1 is not written and counts as 1 here."""
    h = S.media_headers(S.lines(media_texts(spark, sf_dir)))
    return h.select(
        "doc_id", F.coalesce("version", F.lit(1)).alias("version"), "target_duration", "media_sequence", "playlist_type", "has_endlist",
        "iframes_only", "independent_segments"
    )


DOUBLE_TEXT = "CASE WHEN {0} = floor({0}) THEN {0}::BIGINT || '.0' ELSE {0}::VARCHAR END"

MEDIA_FINDINGS_SQL = MEDIA_SQL + f""", f AS (
SELECT k, 'error' AS severity, 'targetDuration' AS field, 'rfc8216' AS rule_set, 'RFC8216-4.3.3.1-integer' AS rule_id,
  'TARGETDURATION must be a positive integer.' AS message FROM g WHERE target <= 0
UNION ALL SELECT k, 'error', 'segments[' || pos || '].duration', 'rfc8216', 'RFC8216-4.3.3.1-segment-duration', 'Segment duration '
  || {DOUBLE_TEXT.format('d::DOUBLE')} || 's exceeds TARGETDURATION ' || target || 's.' FROM x WHERE round(d) > target
UNION ALL SELECT k, 'error', 'segments[' || pos || '].duration', 'rfc8216', 'RFC8216-4.3.2.1-extinf', 'Segment duration must not be negative.' FROM x
  WHERE d < 0
UNION ALL SELECT k, 'error', 'hasEndList', 'rfc8216', 'RFC8216-4.3.3.5-endlist-vod', 'VOD playlists must contain EXT-X-ENDLIST.' FROM g
  WHERE k % 2 = 0 AND k % 3 <> 0
UNION ALL SELECT k, 'error', 'segments[' || pos || '].key.uri', 'rfc8216', 'RFC8216-4.3.2.4-key-uri', 'EXT-X-KEY with METHOD != NONE must have URI.'
  FROM x WHERE k % 5 = 0 AND k % 10 <> 0
UNION ALL SELECT k, 'error', 'version', 'rfc8216', 'RFC8216-4.3.2.2-byterange-version', 'EXT-X-BYTERANGE requires version >= 4.' FROM g WHERE ranged
  AND v < 4 AND v > 1
UNION ALL SELECT k, 'error', 'version', 'rfc8216', 'RFC8216-4.3.2.5-map-version', 'EXT-X-MAP without I-FRAMES-ONLY requires version >= 6.' FROM g
  WHERE k % 6 = 0 AND k % 11 <> 0 AND v < 6 AND v > 1
UNION ALL SELECT k, 'warning', 'version', 'rfc8216', 'RFC8216-4.4.3-version-match', 'Features used require version >= ' || need
  || ' but declared version is ' || v || '.' FROM n WHERE v < need AND v > 1
UNION ALL SELECT k, 'info', 'segments', 'appleHLS', 'APPLE-3.1-segment-duration', 'Segment durations should be approximately 6 seconds.' FROM g
  WHERE mean < 4 OR mean > 8
UNION ALL SELECT k, 'info', 'targetDuration', 'appleHLS', 'APPLE-3.2-target-duration', 'TARGETDURATION should be 6 for standard playlists.' FROM g
  WHERE target <> 6
UNION ALL SELECT k, 'warning', 'independentSegments', 'appleHLS', 'APPLE-3.5-independent', 'EXT-X-INDEPENDENT-SEGMENTS recommended.' FROM g
  WHERE k % 4 <> 0
UNION ALL SELECT k, 'info', 'segments', 'appleHLS', 'APPLE-3.4-fmp4', 'fMP4 (EXT-X-MAP) preferred over MPEG-TS.' FROM g WHERE k % 6 <> 0)
"""


@query(MEDIA_FINDINGS_SQL + "SELECT k AS doc_id, severity, field, rule_set, rule_id, message FROM f")
def media_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.3.1, 2.3.2, 2.3.9–2.3.13, 2.3.25–2.3.28, 2.2.6, 2.12.3, 2.12.4."""
    return rules.validate(media_texts(spark, sf_dir)).select("doc_id", "severity", "field", "rule_set", "rule_id", "message")


@query(MEDIA_FINDINGS_SQL + """SELECT o.k AS doc_id, count(*) FILTER (WHERE severity = 'error') AS errors,
  count(*) FILTER (WHERE severity = 'warning') AS warnings, count(*) FILTER (WHERE severity = 'info') AS infos,
  count(*) FILTER (WHERE severity = 'error') = 0 AS is_valid
FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem) o LEFT JOIN f USING (k) GROUP BY 1""")
def findings_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.3.3, 2.3.4, 2.7.2."""
    docs = media_texts(spark, sf_dir)
    return rules.roll_up(docs, rules.validate(docs))


def master_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One master playlist per brand: variants are its parts, renditions the nations."""
    p = load(spark, sf_dir, "part")
    doc = F.substr("p_brand", F.lit(7)).cast("long")
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    z = F.col("p_size")
    none = F.lit(None).cast("string")
    v = p.select(
        doc.alias("doc_id"), (F.row_number().over(w) - 1).alias("pos"), F.concat(
            F.lit("v"), F.col("p_partkey").cast("string"), F.lit(".m3u8")
        ).alias("uri"), ((z - 3) * 100000).cast("long").alias("bandwidth"), F.lit(None).cast("long").alias("average_bandwidth"),
        F.when(F.col("p_type") != "ECONOMY", "avc1.4d401f,mp4a.40.2").alias("codecs"), F.when(z % 6 == 0, "dvh1.08.07/db4h").alias("supplemental_codecs"), F.when(
            z % 3 != 0, F.struct((z * 80).alias("width"), (z * 45).alias("height"))
        ).alias("resolution"), F.when(z % 5 != 0, F.lit(29.97)).alias("frame_rate"),
        F.when(z % 2 == 0, "TYPE-0").alias("hdcp_level"), F.when(z % 4 == 0, "PQ").when(z % 4 == 1, "SDR").alias("video_range"),
        F.concat(F.lit("g"), (z % 7).cast("string")).alias("audio"), none.alias("video"), none.alias("subtitles"),
        F.when(z % 9 == 0, "NONE").when(z % 9 == 1, "cc").alias("closed_captions"),
        F.when(z % 10 == 0, "CH-STEREO,PROJ-HEQU").when(z % 10 == 1, "PROJ-AIV").alias("video_layout"),
    )
    brands = p.select(doc.alias("doc_id")).distinct()
    n = load(spark, sf_dir, "nation")
    nk = F.col("n_nationkey")
    # every brand offers all nations' renditions: nations are a fixed, tiny dimension
    m = brands.crossJoin(F.broadcast(n)).select(
        "doc_id", nk.alias("pos"), F.lit("AUDIO").alias("type"), F.concat(
            F.lit("g"), F.col("n_regionkey").cast("string")
        ).alias("group_id"), F.concat(F.lit("n"), (nk % 6).cast("string")).alias("name"), F.when(nk % 3 != 0,
        "en").alias("language"), none.alias("assoc_language"), (nk % 2 == 0).alias("is_default"), F.lit(True).alias("autoselect"), F.lit(False).alias("forced"), none.alias("uri"), none.alias("instream_id"), F.lit("2").alias("channels"), none.alias("characteristics"),
    )
    return sinks.master_playlist(brands.select("doc_id", F.lit(7).alias("version"), F.lit(True).alias("independent_segments")), m, v)


MASTER_SQL = """
WITH b AS (SELECT DISTINCT substr(p_brand, 7)::BIGINT AS k FROM part),
v AS (SELECT substr(p_brand, 7)::BIGINT AS k, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos, p_partkey, p_size AS z, p_type,
  (p_size - 3) * 100000 AS bw FROM part),
m AS (SELECT n_nationkey AS pos, 'g' || n_regionkey AS grp, 'n' || n_nationkey % 6 AS name, n_nationkey % 2 = 0 AS def, n_nationkey % 3 <> 0 AS lang
  FROM nation),
mg AS (SELECT grp, count(*) AS n, count(DISTINCT name) AS d, count(*) FILTER (WHERE def) AS defs FROM m GROUP BY 1)
"""


@query(MASTER_SQL + """
SELECT k AS doc_id, 'error' AS severity, 'variants[' || pos || '].bandwidth' AS field, 'RFC8216-4.3.4.2-bandwidth' AS rule_id,
  'BANDWIDTH must be a positive integer.' AS message FROM v WHERE bw <= 0
UNION ALL SELECT k, 'warning', 'variants[' || pos || '].resolution', 'RFC8216-4.3.4.2-resolution', 'Variants with video should include RESOLUTION.'
  FROM v WHERE z % 3 = 0
UNION ALL SELECT k, 'error', 'renditions[AUDIO|' || grp || ']', 'RFC8216-4.3.4.1-group-id',
  'Renditions with same TYPE and GROUP-ID must not duplicate NAME.' FROM b, mg WHERE d <> n
UNION ALL SELECT k, 'warning', 'renditions[AUDIO|' || grp || ']', 'RFC8216-4.3.4.1-default',
  'At most one rendition in a group should have DEFAULT=YES.' FROM b, mg WHERE defs > 1
UNION ALL SELECT k, 'error', 'variants[' || pos || '].audio', 'RFC8216-4.3.4.2-audio-ref', 'AUDIO attribute references undefined GROUP-ID "g'
  || z % 7 || '".' FROM v WHERE NOT EXISTS (SELECT 1 FROM m WHERE grp = 'g' || z % 7)
UNION ALL SELECT k, 'error', 'variants[' || pos || '].closedCaptions', 'RFC8216-4.3.4.2-cc-ref',
  'CLOSED-CAPTIONS attribute references undefined GROUP-ID "cc".' FROM v WHERE z % 9 = 1
UNION ALL SELECT k, 'warning', 'variants[' || pos || '].codecs', 'APPLE-2.1-codecs',
  'Apple recommends including CODECS attribute for all variant streams.' FROM v WHERE p_type = 'ECONOMY'
UNION ALL SELECT k, 'warning', 'variants[' || pos || '].frameRate', 'APPLE-2.1-frame-rate', 'Video variants should include FRAME-RATE.' FROM v
  WHERE z % 3 <> 0 AND z % 5 = 0
UNION ALL SELECT k, 'info', 'iFrameVariants', 'APPLE-2.2-iframe', 'Master playlist should include I-frame playlists.' FROM b
UNION ALL SELECT k, 'warning', 'renditions[' || pos || '].language', 'APPLE-2.3-audio-group', 'Audio renditions should specify LANGUAGE.' FROM b, m
  WHERE NOT lang
UNION ALL SELECT k, 'info', 'variants', 'APPLE-2.4-resolution-ladder', 'At least 3 quality tiers recommended (480p, 720p, 1080p).' FROM (SELECT k,
  count(*) AS n, coalesce(max(CASE WHEN z % 3 <> 0 THEN z * 45 END), 0) AS h FROM v GROUP BY 1) WHERE n >= 3 AND h < 1080
UNION ALL SELECT k, 'info', 'variants', 'APPLE-2.5-bandwidth-order', 'Variants should be listed in ascending bandwidth order.'
  FROM (SELECT DISTINCT k FROM (SELECT k, bw < lag(bw) OVER (PARTITION BY k ORDER BY pos) AS f FROM v) WHERE f)
UNION ALL SELECT k, 'info', 'variants[' || pos || '].hdcpLevel', 'APPLE-2.6-hdcp', '4K content should specify HDCP-LEVEL.' FROM v WHERE z % 3 <> 0
  AND z * 45 >= 2160 AND z % 2 <> 0
UNION ALL SELECT k, 'warning', 'variants', 'APPLE-2.7-video-range',
  'Master playlist contains mixed VIDEO-RANGE values. Ensure proper variant grouping for HDR/SDR.' FROM (SELECT k FROM v WHERE z % 4 IN (0, 1)
  GROUP BY 1 HAVING count(DISTINCT z % 4) > 1)
UNION ALL SELECT k, 'warning', 'variants[' || pos || '].supplementalCodecs', 'APPLE-2.8-supplemental-codecs',
  'SUPPLEMENTAL-CODECS present without CODECS. The CODECS attribute should also be specified.' FROM v WHERE z % 6 = 0 AND p_type = 'ECONOMY'
UNION ALL SELECT k, 'warning', 'variants[' || pos || '].videoLayoutDescriptor', 'APPLE-2.9-video-layout', CASE
  WHEN z % 10 = 1 THEN 'PROJ-AIV needs CH-STEREO.' ELSE 'CH-STEREO without SUPPLEMENTAL-CODECS.' END FROM v WHERE z % 10 = 1 OR (z % 10 = 0
  AND z % 6 <> 0)""")
def master_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.1.2, 2.1.24, 2.1.26, 2.3.5–2.3.7, 2.3.15–2.3.24, 2.2.2, 2.2.14, 2.2.16, 2.8.1."""
    return rules.validate(master_texts(spark, sf_dir)).select("doc_id", "severity", "field", "rule_id", "message")


@query(MASTER_SQL + """SELECT k AS doc_id, count(DISTINCT CASE WHEN z % 4 IN (0, 1) THEN z % 4 END) > 1 AS mixed_ranges, count(DISTINCT CASE
  WHEN p_type <> 'ECONOMY' THEN 'avc1' END) > 1 AS mixed_codecs, coalesce(bool_or(f), false) AS not_ascending
FROM (SELECT *, bw <= lag(bw) OVER (PARTITION BY k ORDER BY pos) AS f FROM v) GROUP BY 1""")
def ladder_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.3.33, 2.3.20, 2.3.22."""
    return rules.ladder_checks(S.variants(S.lines(master_texts(spark, sf_dir))), ["doc_id"], "pos")


@query("""SELECT doc_id, count(*) FILTER (WHERE l <> '') AS line_count, count(*) FILTER (WHERE l LIKE '#%') AS marked, count(*) FILTER (WHERE l <> ''
  AND l NOT LIKE '#%') AS unmarked, coalesce(max(i) FILTER (WHERE l <> ''), 0)::INT AS last_line, coalesce(sum(length(l)) FILTER (WHERE l <> ''),
  0)::BIGINT AS chars
FROM (SELECT doc_id, trim(unnest(x)) AS l, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\n|\\r') AS x
  FROM documents)) GROUP BY 1""")
def line_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.1.1: the line table of every text."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    g = S.lines(docs).groupBy("doc_id").agg(
        F.count("*").alias("line_count"), F.count_if(~F.col("is_uri")).alias("marked"), F.count_if("is_uri").alias("unmarked"),
        F.max("line_no").alias("last_line"), F.sum(F.length("line")).alias("chars")
    )
    return docs.select("doc_id").join(g, "doc_id", "left").fillna(0)


@query(
    """SELECT c_custkey, c_name || ', ' || c_mktsegment AS name, c_nationkey::BIGINT AS nation, c_acctbal AS balance, c_nationkey % 2 = 0 AS even,
  NULL::BIGINT AS missing, c_custkey % 3000 || 'x' || 720 AS size FROM customer"""
)
def attribute_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.1.6, 2.1.11–2.1.14, 2.1.16: attribute lists written and read."""
    c = load(spark, sf_dir, "customer")
    text = T.attribute_list(
        T.plain("NAME", F.lit("early")), T.quoted("NAME", F.concat("c_name", F.lit(", "), "c_mktsegment")),
        T.plain("NATION", F.col("c_nationkey")), T.plain("BALANCE", F.col("c_acctbal")),
        T.plain("EVEN", F.when(F.col("c_nationkey") % 2 == 0, "YES").otherwise("NO")), T.plain("BAD", F.lit("12a")),
        T.plain("RESOLUTION", F.concat((F.col("c_custkey") % 3000).cast("string"), F.lit("x720")))
    )
    m = c.select("c_custkey", A.attribute_map(text).alias("m"))
    f = F.col("m")
    r = A.resolution_of(f)
    return m.select(
        "c_custkey", A.text_of(f, "NAME").alias("name"), A.int_of(f, "NATION").alias("nation"), A.double_of(f, "BALANCE").alias("balance"),
        A.bool_of(f, "EVEN").alias("even"), A.int_of(f, "BAD").alias("missing"),
        F.concat(r["width"].cast("string"), F.lit("x"), r["height"].cast("string")).alias("size")
    )


@query(
    """SELECT event_id, 'https://h/' || user_id || '/' || event_type || '/{$other}?t=' || (props::JSON->>'k') AS resolved, 'other' AS unknown,
  (props::JSON->>'k') AS item FROM events"""
)
def variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.9.1–2.9.5, 2.1.39, 2.1.40: references resolved, nested ones too."""
    k = F.get_json_object("props", "$.k")
    values = F.create_map(
        F.lit("host"), F.concat(F.lit("https://h/{$user}")), F.lit("user"), F.col("user_id").cast("string"), F.lit("kind"),
        F.col("event_type")
    )
    text = F.concat(F.lit("{$host}/{$kind}/{$other}?t="), k)
    return load(spark, sf_dir, "events").select(
        "event_id", T.resolve_variables(text, values).alias("resolved"), F.array_join(T.unresolved(text, values), ",").alias("unknown"),
        T.query_item(text, "t").alias("item")
    )


@query("""WITH c AS (SELECT user_id, event_id, event_type, value, coalesce(sum(value) OVER (PARTITION BY user_id
  ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i
  FROM events),
r AS (SELECT user_id, i, event_type, round(s, 3) AS s, round(s + value, 3) AS e FROM c),
t AS (SELECT *, CASE WHEN s = floor(s) AND s < 1000000 THEN s::BIGINT::VARCHAR ELSE printf('%.1f', round(s, 1)) END AS js, CASE WHEN e = floor(e)
  AND e < 1000000 THEN e::BIGINT::VARCHAR ELSE printf('%.1f', round(e, 1)) END AS je, floor(s * 1000)::BIGINT AS ms, floor(e * 1000)::BIGINT AS me
  FROM r)
SELECT user_id, '{"version":"1.2.0","chapters":[' || string_agg('{"startTime":' || js || ',"endTime":' || je || ',"title":"' || event_type || '"}', ',' ORDER BY i) || ']}' AS json,
 'WEBVTT' || chr(10) || chr(10) || string_agg(i || chr(10) || printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60,
  ms % 1000) || ' --> ' || printf('%02d:%02d:%02d.%03d', me // 3600000, me // 60000 % 60, me // 1000 % 60, me % 1000) || chr(10) || event_type
  || chr(10), chr(10) ORDER BY i) AS vtt FROM t GROUP BY 1""")
def chapter_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.2.40, 2.2.41, 2.9.8, 2.9.10: chapters as JSON and WebVTT."""
    from ..operators.patterns import running_sum

    e = running_sum(
        load(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value"), ["user_id"], "event_id", F.col("value"), "s",
        4096
    )
    c = e.select("user_id", "event_id", F.round("s", 3).alias("start"), F.round(F.col("s") + F.col("value"), 3).alias("end"), F.col("event_type").alias("title"))
    return sinks.chapters_json(c, ["user_id"], "event_id").join(sinks.cues_vtt(c, ["user_id"], "event_id"), "user_id")
