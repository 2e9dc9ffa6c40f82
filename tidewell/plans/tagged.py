"""Queries over single tags and small playlists: written from the tables, scanned back, checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import engine
from ..functions import media as M
from ..functions import text as T
from ..operators import pipeline, rules
from ..sources import manifest as S
from ..sources import sinks, tags
from ..sources.binary import splice_info_of
from ..sources.writers import splice_sections
from .registry import load, query


def scanned(rows: DataFrame, *texts: Column, key: str = "doc_id") -> DataFrame:
    """The line table of one text a row, its lines given as columns; null ones are left out."""
    return S.lines(rows.select(key, F.concat_ws("\n", F.lit("#EXTM3U"), *texts).alias("text")), key)


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "supplier").withColumn("doc_id", F.col("s_suppkey"))


def named(rows: DataFrame, line: Column, **columns: Column) -> DataFrame:
    """rows with a line made of the given columns."""
    return rows.withColumns(columns).withColumn("_line", line)


@query("""SELECT s_suppkey AS doc_id, s_suppkey * 1000 + 7 AS bandwidth, 'i/' || s_suppkey || '.m3u8' AS uri, CASE
  WHEN s_suppkey % 2 = 0 THEN 'avc1.4d' || s_nationkey END AS codecs,
  CASE WHEN s_suppkey % 3 = 0 THEN (s_suppkey + 16)::INT END AS width, s_suppkey % 5 = 0 AS bad FROM supplier""")
def iframe_variant_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.1.25, 2.2.15: I-frame variants written and scanned; one in five a second time without URI."""
    k = F.col("s_suppkey")
    s = suppliers(spark, sf_dir).withColumns({
        "bandwidth": k * 1000 + 7, "uri": F.concat(F.lit("i/"), k.cast("string"), F.lit(".m3u8")), "codecs": F.when(
            k % 2 == 0, F.concat(F.lit("avc1.4d"), F.col("s_nationkey").cast("string"))
        ),
        "resolution": F.when(k % 3 == 0, F.struct((k + 16).alias("width"), F.lit(9).alias("height"))),
    })
    found = S.iframe_variants(scanned(s, tags.iframe_line(), F.when(k % 5 == 0, "#EXT-X-I-FRAME-STREAM-INF:BANDWIDTH=5")))
    bad = found.groupBy("doc_id").agg(F.bool_or(F.col("error").isNotNull()).alias("bad"))
    return found.where("pos = 0").join(bad, "doc_id").select("doc_id", "bandwidth", "uri", "codecs", F.col("resolution.width").alias("width"), "bad")


@query("""SELECT s_suppkey AS doc_id, 'com.x.' || s_nationkey AS data_id, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS value, CASE
  WHEN s_suppkey % 2 = 1 THEN 'd.json' END AS data_uri, CASE WHEN s_suppkey % 3 = 0 THEN 'fr' END AS language,
  CASE WHEN s_suppkey % 2 = 0 THEN 'SAMPLE-AES' ELSE 'AES-128' END AS method, 'skd://' || s_suppkey AS key_uri, CASE
  WHEN s_suppkey % 4 = 0 THEN 'com.apple.streamingkeydelivery' END AS key_format,
  '/steer?' || s_suppkey AS server_uri, CASE WHEN s_suppkey % 3 <> 0 THEN 'CDN-' || s_nationkey END AS pathway_id FROM supplier""")
def session_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.1.27–2.1.29, 2.2.17–2.2.19, 2.2.50: session data, session keys and content steering."""
    k, nation = F.col("s_suppkey"), F.col("s_nationkey").cast("string")
    s = suppliers(spark, sf_dir)
    data = s.withColumns(
        {
            "data_id": F.concat(F.lit("com.x."), nation), "value": F.when(k % 2 == 0, F.col("s_name")),
            "uri": F.when(k % 2 == 1, "d.json"), "language": F.when(k % 3 == 0, "fr")
        }
    ).select("doc_id", tags.session_data_line().alias("a"))
    keys = s.withColumns({
        "method": F.when(k % 2 == 0, "SAMPLE-AES").otherwise("AES-128"), "uri": F.concat(F.lit("skd://"), k.cast("string")),
        "iv": F.lit(None).cast("string"),
        "key_format": F.when(k % 4 == 0, "com.apple.streamingkeydelivery"),
    }).select("doc_id", tags.session_key_line().alias("b"))
    steer = s.withColumns(
        {"server_uri": F.concat(F.lit("/steer?"), k.cast("string")), "pathway_id": F.when(k % 3 != 0, F.concat(F.lit("CDN-"), nation))}
    ).select("doc_id", tags.steering_line().alias("c"))
    rows = scanned(data.join(keys, "doc_id").join(steer, "doc_id"), F.col("a"), F.col("b"), F.col("c"))
    d = S.session_data(rows).select("doc_id", "data_id", "value", F.col("uri").alias("data_uri"), "language")
    e = S.session_keys(rows).select("doc_id", "method", F.col("uri").alias("key_uri"), "key_format")
    return d.join(e, "doc_id").join(S.steering(rows).select("doc_id", "server_uri", "pathway_id"), "doc_id")


@query("""SELECT s_suppkey AS doc_id, (s_suppkey * 0.5 - 9)::DOUBLE AS time_offset, s_suppkey % 2 = 0 AS precise, 'v' || s_nationkey AS name,
  CASE s_suppkey % 3 WHEN 0 THEN 'value' WHEN 1 THEN 'import' ELSE 'queryparam' END AS kind,
  CASE WHEN s_suppkey % 3 = 0 THEN s_name END AS value FROM supplier""")
def start_and_define_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.1.30, 2.1.31, 2.2.26, 2.2.27: start offsets and the three kinds of definitions."""
    k = F.col("s_suppkey")
    s = suppliers(spark, sf_dir).withColumns(
        {
            "name": F.concat(F.lit("v"), F.col("s_nationkey").cast("string")), "value": F.col("s_name"),
            "kind": F.when(k % 3 == 0, "value").when(k % 3 == 1, "import").otherwise("queryparam")
        }
    )
    rows = scanned(s, F.lit("#EXT-X-TARGETDURATION:6"), tags.start_line(k * 0.5 - 9, k % 2 == 0), tags.define_line())
    h = S.media_headers(rows).select("doc_id", "start.time_offset", "start.precise")
    return h.join(S.definitions(rows).select("doc_id", "name", "kind", "value"), "doc_id")


@query("""SELECT s_suppkey AS doc_id, s_suppkey / 8.0::DOUBLE + 1 AS part_target, true AS can_block_reload, s_suppkey / 4.0::DOUBLE + 9 AS hold_back,
  (s_suppkey / 8.0::DOUBLE + 1) * 3 AS part_hold_back, CASE WHEN s_suppkey % 2 = 0 THEN 24.0::DOUBLE END AS can_skip_until,
  CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 3 = 0 THEN true END AS can_skip_dateranges, CASE
  WHEN s_suppkey % 5 = 0 THEN s_suppkey + 3 END AS skipped_segments, 'p' || s_suppkey AS part_uri, s_suppkey / 8.0::DOUBLE + 0.5 AS part_duration,
  s_suppkey % 2 = 0 AS independent,
  s_suppkey % 7 = 0 AS gap, CASE WHEN s_suppkey % 4 = 0 THEN 'MAP' ELSE 'PART' END AS hint, 'h' || s_suppkey AS hint_uri, CASE
  WHEN s_suppkey % 3 = 0 THEN s_suppkey END AS hint_start, '../' || s_nationkey AS report_uri, s_suppkey + 100 AS last_msn, CASE
  WHEN s_suppkey % 2 = 1 THEN s_suppkey % 6 END AS last_part FROM supplier""")
def low_latency_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.1.33–2.1.38, 2.2.20–2.2.25, 2.2.34, 2.2.35: parts, part target, server control, hints, reports, skips."""
    k = F.col("s_suppkey")
    text = k.cast("string")
    s = suppliers(spark, sf_dir)
    part = s.withColumns(
        {"duration": k / 8 + 0.5, "uri": F.concat(F.lit("p"), text), "independent": k % 2 == 0, "gap": k % 7 == 0}
    ).select("doc_id", sinks.part_line().alias("a"))
    hint = s.withColumns(
        {
            "type": F.when(k % 4 == 0, "MAP").otherwise("PART"), "uri": F.concat(F.lit("h"), text), "start": F.when(k % 3 == 0, k),
            "length": F.lit(None).cast("long")
        }
    ).select("doc_id", tags.preload_hint_line().alias("b"))
    report = s.withColumns(
        {"uri": F.concat(F.lit("../"), F.col("s_nationkey").cast("string")), "last_msn": k + 100, "last_part": F.when(k % 2 == 1, k % 6)}
    ).select("doc_id", tags.rendition_report_line().alias("c"))
    none = F.lit(None).cast("double")
    control = sinks.server_control_line(k / 12 + 3, k / 8 + 1, k / 4 + 9, none, F.when(k % 2 == 0, 24.0), k % 3 == 0)
    head = s.select("doc_id", tags.part_inf_line(k / 8 + 1).alias("d"), control.alias("e"), F.when(k % 5 == 0, tags.skip_line(k + 3)).alias("f"))
    rows = scanned(head.join(part, "doc_id").join(hint, "doc_id").join(report, "doc_id"), F.lit("#EXT-X-TARGETDURATION:9"), *map(F.col, "defabc"))
    p = S.parts(rows).select("doc_id", F.col("uri").alias("part_uri"), F.col("duration").alias("part_duration"), "independent", "gap")
    q = S.preload_hints(rows).select("doc_id", F.col("type").alias("hint"), F.col("uri").alias("hint_uri"), F.col("start").alias("hint_start"))
    r = S.rendition_reports(rows).select("doc_id", F.col("uri").alias("report_uri"), "last_msn", "last_part")
    h = S.media_headers(rows).select(
        "doc_id", "part_target", "server_control.can_block_reload", "server_control.hold_back", "server_control.part_hold_back",
        "server_control.can_skip_until", "server_control.can_skip_dateranges", "skipped_segments"
    )
    return h.join(p, "doc_id").join(q, "doc_id").join(r, "doc_id")


#: Lines that refuse a playlist: (line, kind of error, message), by customer in turn. {} is the customer's key.
BAD_MEDIA = (
    ("#EXT-X-VERSION:{}0", "invalidVersion", "Invalid or unsupported EXT-X-VERSION value: {}0."),
    ("#EXT-X-TARGETDURATION:{}.5", "invalidTagFormat", "Invalid format for tag ''EXT-X-TARGETDURATION'' at line 3."),
    ("#EXT-X-MEDIA-SEQUENCE:n{}", "invalidTagFormat", "Invalid format for tag ''EXT-X-MEDIA-SEQUENCE'' at line 3."),
    ("#EXTINF:x{},", "invalidAttributeValue", "Invalid value ''x{},'' for attribute ''duration'' in EXTINF."),
    ("#EXT-X-BYTERANGE:{}@o", "invalidAttributeValue", "Invalid value ''o'' for attribute ''offset'' in EXT-X-BYTERANGE."),
    ('#EXT-X-KEY:URI="k{}"', "missingRequiredAttribute", "Missing required attribute ''METHOD'' in EXT-X-KEY."),
    ("#EXT-X-KEY:METHOD=M{}", "invalidAttributeValue", "Invalid value ''M{}'' for attribute ''METHOD'' in EXT-X-KEY."),
    ('#EXT-X-MAP:BYTERANGE="{}@0"', "missingRequiredAttribute", "Missing required attribute ''URI'' in EXT-X-MAP."),
    ("#EXT-X-PROGRAM-DATE-TIME:{}", "invalidAttributeValue", "Invalid value ''{}'' for attribute ''date'' in EXT-X-PROGRAM-DATE-TIME."),
    ('#EXT-X-DATERANGE:ID="{}"', "missingRequiredAttribute", "Missing required attribute ''START-DATE'' in EXT-X-DATERANGE."),
    ('#EXT-X-PART:URI="{}"', "missingRequiredAttribute", "Missing required attribute ''DURATION'' in EXT-X-PART."),
    ("#EXT-X-PART-INF:PART-TARGET=t{}", "invalidAttributeValue", "Invalid value ''t{}'' for attribute ''PART-TARGET'' in EXT-X-PART-INF."),
    ('#EXT-X-PRELOAD-HINT:TYPE=KEY,URI="{}"', "invalidAttributeValue", "Invalid value ''KEY'' for attribute ''TYPE'' in EXT-X-PRELOAD-HINT."),
    ("#EXT-X-RENDITION-REPORT:LAST-MSN={}", "missingRequiredAttribute", "Missing required attribute ''URI'' in EXT-X-RENDITION-REPORT."),
    ("#EXT-X-SKIP:SKIPPED-SEGMENTS=s{}", "invalidAttributeValue", "Invalid value ''s{}'' for attribute ''SKIPPED-SEGMENTS'' in EXT-X-SKIP."),
    ("#EXT-X-START:PRECISE=YES", "missingRequiredAttribute", "Missing required attribute ''TIME-OFFSET'' in EXT-X-START."),
    ("# fine {}", None, None),
)
BAD_MASTER = (
    ('#EXT-X-STREAM-INF:CODECS="{}"', "missingRequiredAttribute", "Missing required attribute ''BANDWIDTH'' in EXT-X-STREAM-INF."),
    ("#EXT-X-STREAM-INF:BANDWIDTH={}k", "invalidAttributeValue", "Invalid value ''{}k'' for attribute ''BANDWIDTH'' in EXT-X-STREAM-INF."),
    ("#EXT-X-STREAM-INF:BANDWIDTH={}", "missingURI", "Missing URI after EXT-X-STREAM-INF at line 3."),
    ("#EXT-X-I-FRAME-STREAM-INF:BANDWIDTH={}", "missingRequiredAttribute", "Missing required attribute ''URI'' in EXT-X-I-FRAME-STREAM-INF."),
    ('#EXT-X-MEDIA:TYPE=T{},GROUP-ID="g",NAME="n"', "invalidAttributeValue", "Invalid value ''T{}'' for attribute ''TYPE'' in EXT-X-MEDIA."),
    ('#EXT-X-MEDIA:TYPE=AUDIO,NAME="n{}"', "missingRequiredAttribute", "Missing required attribute ''GROUP-ID'' in EXT-X-MEDIA."),
    ('#EXT-X-SESSION-DATA:VALUE="{}"', "missingRequiredAttribute", "Missing required attribute ''DATA-ID'' in EXT-X-SESSION-DATA."),
    ('#EXT-X-SESSION-KEY:URI="{}"', "missingRequiredAttribute", "Missing required attribute ''METHOD'' in EXT-X-KEY."),
    ('#EXT-X-CONTENT-STEERING:PATHWAY-ID="{}"', "missingRequiredAttribute", "Missing required attribute ''SERVER-URI'' in EXT-X-CONTENT-STEERING."),
)
OTHER = (
    ("", "emptyManifest", "The manifest is empty or contains only whitespace."),
    ("#EXTINF:{},", "missingHeader", "The playlist does not start with #EXTM3U."),
    ("#EXTM3U\n#EXTINF:{},", "missingRequiredTag", "Missing required tag: EXT-X-TARGETDURATION."),
    ("#EXTM3U\n{}", "ambiguousPlaylistType", "Unable to determine if the manifest is a master or media playlist.")
)
BAD = [("#EXTM3U\n#EXT-X-TARGETDURATION:6\n" + a, b, c) for a, b, c in BAD_MEDIA] + [
    ('#EXTM3U\n#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="a",NAME="b"\n' + a, b, c) for a, b, c in BAD_MASTER
] + list(OTHER)
_CASES = " ".join(f"WHEN {i} THEN " + ("NULL" if c is None else "replace('" + c + "', '{}', c_custkey::VARCHAR)") for i, (_, _, c) in enumerate(BAD))
_CODES = " ".join(f"WHEN {i} THEN '{b}'" for i, (_, b, _) in enumerate(BAD) if b)


@query(f"""WITH c AS (SELECT c_custkey + 20 AS c_custkey, (c_custkey + 20) % {len(BAD)} AS i FROM customer)
SELECT c_custkey AS doc_id, CASE i {_CODES} END AS field, CASE i {_CASES} END AS message, CASE WHEN CASE i {_CODES} END IS NULL THEN 0
  ELSE 1 END::BIGINT AS refusals, CASE i {_CODES} END IS NOT NULL AS is_refused FROM c""")
def parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.1.1–2.1.3, 2.3.2, 2.12.4: playlists with each kind of scan error are refused with its first, and nothing else."""
    key = F.col("doc_id")
    texts = F.array(*[F.lit(a) for a, _, _ in BAD])
    c = load(spark, sf_dir, "customer").select((F.col("c_custkey") + 20).alias("doc_id"))
    docs = c.withColumn("text", F.replace(F.element_at(texts, (key % len(BAD) + 1).cast("int")), F.lit("{}"), key.cast("string")))
    found = rules.validate(docs).where("severity = 'error'")
    by = found.groupBy("doc_id").agg(
        F.max(F.when(F.col("rule_id") == "parse", F.col("field"))).alias("field"),
        F.max(F.when(F.col("rule_id") == "parse", F.col("message"))).alias("message"), F.count("*").alias("refusals")
    )
    return docs.select("doc_id").join(by, "doc_id", "left").withColumn(
        "refusals", F.coalesce("refusals", F.lit(0).cast("long"))
    ).withColumn("is_refused", F.col("field").isNotNull())


@query("""WITH s AS (SELECT s_suppkey AS k, s_suppkey % 2 AS a, s_suppkey % 3 AS b, s_suppkey % 5 AS c FROM supplier)
SELECT k AS doc_id, 'error' AS severity, 'definitions' AS field, 'RFC8216bis-4.4.3.8-import' AS rule_id,
  'IMPORT "imp" requires a multivariant playlist context.' AS message FROM s WHERE a = 0
UNION ALL SELECT k, 'warning', 'definitions', 'RFC8216bis-4.4.3.8-duplicate', 'Duplicate EXT-X-DEFINE name "v".' FROM s WHERE b = 0
UNION ALL SELECT k, 'error', 'definitions', 'RFC8216bis-4.4.3.8-circular', 'Circular reference: variable "v" references itself.' FROM s WHERE c = 0
UNION ALL SELECT k, 'error', 'definitions', 'RFC8216bis-4.4.3.8-circular', 'Circular reference between "v" and "w".' FROM s WHERE c = 1
UNION ALL SELECT k, 'error', 'definitions', 'RFC8216bis-4.4.3.8-circular', 'Circular reference between "w" and "v".' FROM s WHERE c = 1
UNION ALL SELECT k, 'error', 'segments[0].uri', 'RFC8216bis-4.4.3.8-undefined', 'Undefined variable reference "{$q}".' FROM s
UNION ALL SELECT k, 'error', 'segments[0].uri', 'RFC8216bis-4.4.3.8-undefined', 'Undefined variable reference "{$imp}".' FROM s WHERE a <> 0""")
def variable_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.3.29–2.3.32: imports in media playlists, repeated, circular and undefined variables."""
    k = F.col("s_suppkey")
    value = F.when(k % 5 == 0, "{$v}").when(k % 5 == 1, "{$w}").otherwise("x")
    lines = [
        F.lit("#EXTM3U\n#EXT-X-TARGETDURATION:6"), F.when(k % 2 == 0, '#EXT-X-DEFINE:IMPORT="imp"'), F.concat(
            F.lit('#EXT-X-DEFINE:NAME="v",VALUE="'), value, F.lit('"')
        ), F.lit('#EXT-X-DEFINE:NAME="w",VALUE="{$v}"'),
        F.when(k % 3 == 0, '#EXT-X-DEFINE:NAME="v",VALUE="y"'), F.lit('#EXT-X-DEFINE:QUERYPARAM="q"\n#EXTINF:6.0,\n{$imp}/{$q}/{$v}'),
    ]
    docs = suppliers(spark, sf_dir).select("doc_id", F.concat_ws("\n", *lines).alias("text"))
    return rules.validate(docs).where("rule_id like '%4.4.3.8%'").select("doc_id", "severity", "field", "rule_id", "message")


@query("""WITH s AS (SELECT s_suppkey AS k, s_suppkey % 2 = 0 AS inf, s_suppkey % 3 = 0 AS control, s_suppkey % 5 = 0 AS old,
  s_suppkey % 7 = 0 AS long FROM supplier)
SELECT k AS doc_id, 'RFC8216bis-part-inf' AS rule_id, 'error' AS severity, 'Playlists with PART tags must have EXT-X-PART-INF.' AS message FROM s
  WHERE NOT inf
UNION ALL SELECT k, 'RFC8216bis-server-control', 'warning', 'LL-HLS playlists should have EXT-X-SERVER-CONTROL.' FROM s WHERE NOT control
UNION ALL SELECT k, 'RFC8216bis-hold-back', 'warning', 'PART-HOLD-BACK should be >= 3x PART-TARGET.' FROM s WHERE control AND inf
UNION ALL SELECT k, 'RFC8216bis-version', 'error', 'LL-HLS features require version >= 9.' FROM s WHERE old
UNION ALL SELECT k, 'RFC8216bis-part-duration', 'error', 'PART duration 1.5s exceeds PART-TARGET 1.0s.' FROM s WHERE long AND inf""")
def low_latency_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.3.14: the rules of low latency playlists."""
    k = F.col("s_suppkey")
    version = F.when(k % 5 == 0, "#EXT-X-VERSION:7").otherwise("#EXT-X-VERSION:9")
    part = F.when(k % 7 == 0, '#EXT-X-PART:DURATION=1.5,URI="p"').otherwise('#EXT-X-PART:DURATION=1.0,URI="p"')
    lines = [
        F.lit("#EXTM3U"), version, F.lit("#EXT-X-TARGETDURATION:4"), F.when(k % 2 == 0, "#EXT-X-PART-INF:PART-TARGET=1.0"),
        F.when(k % 3 == 0, "#EXT-X-SERVER-CONTROL:CAN-BLOCK-RELOAD=YES,PART-HOLD-BACK=2.5"), F.lit("#EXTINF:4.0,\ns"), part
    ]
    docs = suppliers(spark, sf_dir).select("doc_id", F.concat_ws("\n", *lines).alias("text"))
    return rules.validate(docs).where("rule_id like 'RFC8216bis%'").select("doc_id", "rule_id", "severity", "message")


@query("""WITH s AS (SELECT s_suppkey AS k FROM supplier)
SELECT k AS doc_id, 'sessionData[0]' AS field, 'RFC8216-4.3.4.5-session-data-value' AS rule_id,
  'SESSION-DATA must have VALUE or URI, not both.' AS message FROM s WHERE k % 2 = 0
UNION ALL SELECT k, 'sessionData[1]', 'RFC8216-4.3.4.5-session-data-value', 'SESSION-DATA must have either VALUE or URI.' FROM s WHERE k % 3 = 0
UNION ALL SELECT k, 'sessionData', 'RFC8216-4.3.4.5-session-data-id', 'SESSION-DATA with DATA-ID "a" must not duplicate LANGUAGE.' FROM s
  WHERE k % 5 = 0""")
def session_data_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.3.8: session data with both, neither, or one language twice."""
    k = F.col("s_suppkey")
    first = F.when(
        k % 2 == 0, '#EXT-X-SESSION-DATA:DATA-ID="a",VALUE="v",URI="u",LANGUAGE="en"'
    ).otherwise('#EXT-X-SESSION-DATA:DATA-ID="a",VALUE="v",LANGUAGE="en"')
    second = F.when(k % 3 == 0, '#EXT-X-SESSION-DATA:DATA-ID="b"').otherwise('#EXT-X-SESSION-DATA:DATA-ID="b",URI="u"')
    third = F.when(k % 5 == 0, '#EXT-X-SESSION-DATA:DATA-ID="a",URI="w",LANGUAGE="en"').otherwise('#EXT-X-SESSION-DATA:DATA-ID="a",URI="w"')
    lines = [F.lit("#EXTM3U"), first, second, third, F.lit("#EXT-X-STREAM-INF:BANDWIDTH=1\nv")]
    docs = suppliers(spark, sf_dir).select("doc_id", F.concat_ws("\n", *lines).alias("text"))
    return rules.validate(docs).where("rule_id like '%session-data%'").select("doc_id", "field", "rule_id", "message")


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 10 WHEN p_size % 3 = 0 THEN 8 WHEN p_size % 2 = 0 THEN 7 ELSE 1 END AS version FROM part""")
def required_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.2.7, 2.7.8: the least version of master playlists, in the order of versions."""
    z = F.col("p_size")
    return load(spark, sf_dir, "part").select("p_partkey", rules.required_version_master(z % 2 == 0, z % 3 == 0, z % 5 == 0).alias("version"))


@query("""WITH e AS (SELECT event_id, value, event_id % 2 = 0 AS leaves, upper(printf('%08x', event_id)) AS id, trunc(value * 90000)::BIGINT AS t
  FROM events),
b AS (SELECT *, CASE WHEN leaves THEN 'EF' ELSE '4F' END AS f, 'FE' || upper(printf('%08x', t)) AS stamp, 'FE' || upper(printf('%08x',
  90000 * 30)) AS length FROM e),
h AS (SELECT *, '0xFC30' || CASE WHEN leaves THEN '23' ELSE '1E' END || '00000000000000FFF0' || CASE WHEN leaves THEN '14' ELSE '0F' END || '05'
  || id || '00' || f || stamp || CASE WHEN leaves THEN length ELSE '' END || '00000000' || '0000FFFFFFFF' AS x FROM b)
SELECT event_id, x AS command, CASE WHEN leaves THEN x END AS leaving, CASE WHEN NOT leaves THEN x END AS returning, 'splice_insert' AS kind,
  event_id AS splice_id, leaves AS out_of_network, t AS pts, CASE WHEN leaves THEN 2700000 END::BIGINT AS ticks FROM h""")
def splice_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.1.70, 2.1.71, 2.2.75, 2.9.80: splice sections written, put into date range attributes, and read back from their hex."""
    i = F.col("event_id")
    e = load(spark, sf_dir, "events").select("event_id", (i % 2 == 0).alias("leaves"), M.pts(F.col("value")).alias("t"))
    s = splice_sections(e.withColumn("n", F.when(F.col("leaves"), F.lit(2700000).cast("long"))), "event_id", "leaves", "t", "n")
    a = s.withColumn("a", tags.splice_attributes(F.col("section"), F.col("leaves")))
    at = lambda k: F.try_element_at("a", F.lit(k))
    read = splice_info_of(a.select("event_id", at("SCTE35-CMD").alias("hex")), "event_id", "hex")
    found = read.select(
        "event_id", F.col("command").alias("kind"), F.col("splice_id"), "out_of_network", "pts", F.col("duration_ticks").alias("ticks")
    )
    return a.select(
        "event_id", at("SCTE35-CMD").alias("command"), at("SCTE35-OUT").alias("leaving"), at("SCTE35-IN").alias("returning")
    ).join(found, "event_id")


@query("""SELECT s_suppkey, '#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="ad",LANGUAGE="l' || s_nationkey || '",NAME="' || s_name || '",DEFAULT=' || CASE
  WHEN s_suppkey % 2 = 0 THEN 'YES' ELSE 'NO' END || ',AUTOSELECT=YES,CHARACTERISTICS="public.accessibility.describes-video",URI="d/' || s_suppkey
  || '"' AS line,
  printf('%02d:%02d.%03d', s_suppkey // 60, s_suppkey % 60, 250) || ' --> ' || printf('%02d:%02d.%03d', (s_suppkey + 2) // 60, (s_suppkey + 2) % 60,
  0) || CASE WHEN s_suppkey % 3 = 0 THEN ' position:' || s_nationkey || '%' ELSE '' END || CASE WHEN s_suppkey % 2 = 0 THEN ' align:start'
  ELSE '' END || chr(10) || s_name || chr(10) AS cue,
  s_suppkey % 4 IN (0, 1, 3) AS simple FROM supplier""")
def accessibility_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.9.83, 2.9.12, 2.2.42, 2.9.60: audio description tags, cues with settings, simple ratios of rates."""
    k = F.col("s_suppkey")
    s = suppliers(spark, sf_dir).withColumns(
        {
            "group_id": F.lit("ad"), "language": F.concat(F.lit("l"), F.col("s_nationkey").cast("string")), "name": F.col("s_name"),
            "is_default": k % 2 == 0, "characteristics": F.lit("public.accessibility.describes-video"),
            "uri": F.concat(F.lit("d/"), k.cast("string"))
        }
    )
    rate = F.when(k % 4 == 0, 24000.0).when(k % 4 == 1, 96000.0).when(k % 4 == 2, 44100.0).otherwise(48000.0)
    text = T.cue(k + 0.25, k + 2.0, F.col("s_name"), F.when(k % 3 == 0, F.col("s_nationkey")), F.when(k % 2 == 0, "start"))
    return s.select("s_suppkey", tags.description_line().alias("line"), text.alias("cue"), M.simple_ratio(F.lit(48000.0), rate).alias("simple"))


@query("""WITH q AS (SELECT * FROM (VALUES ('360p', 640, 360, 800000, 64000), ('480p', 854, 480, 1400000, 96000), ('720p', 1280, 720, 2800000,
  128000), ('1080p', 1920, 1080, 5000000, 128000), ('2160p', 3840, 2160, 14000000, 192000)) AS t(name, w, h, v, a)),
n AS (SELECT n_nationkey AS k, q.* FROM nation, q WHERE h <= 360 + n_nationkey * 100)
SELECT k::BIGINT AS doc_id, '#EXTM3U' || chr(10) || '#EXT-X-VERSION:7' || chr(10) || '#EXT-X-INDEPENDENT-SEGMENTS' || chr(10)
  || string_agg('#EXT-X-STREAM-INF:BANDWIDTH=' || v + a || ',RESOLUTION=' || w || 'x' || h || chr(10) || name || '/playlist.m3u8' || chr(10), ''
  ORDER BY v + a) AS text FROM n GROUP BY 1""")
def preset_masters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.2.29, 2.2.53, 2.2.54, 2.7.3: master playlists of the presets up to a height, by bandwidth."""
    n = load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"))
    return pipeline.ladder_masters(n.join(F.broadcast(pipeline.presets(spark)), F.col("height") <= 360 + F.col("doc_id") * 100), "doc_id")


@query("""WITH s AS (SELECT s_suppkey AS k, s_acctbal FROM supplier)
SELECT k AS doc_id, '#EXTM3U' || chr(10) || '#EXT-X-VERSION:5' || chr(10) || '#EXT-X-TARGETDURATION:8' || chr(10) || CASE
  WHEN k > 0 THEN '#EXT-X-MEDIA-SEQUENCE:' || k || chr(10) ELSE '' END || '#EXT-X-KEY:METHOD=AES-128,URI="k"' || chr(10)
  || '#EXTINF:' || CASE WHEN k % 2 = 0 THEN '7.5' ELSE '7.0' END || ',one' || chr(10) || 'a' || k || chr(10) || '#EXT-X-DISCONTINUITY' || chr(10)
  || '#EXTINF:6.25,' || chr(10) || 'b' || chr(10) || '#EXT-X-ENDLIST' || chr(10) AS text, false AS refused FROM s""")
def regenerated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.12.5, 2.2.1, 2.2.30: playlists in odd spelling, scanned and written anew."""
    k = F.col("s_suppkey")
    lines = [
        F.lit("\n  #EXTM3U  \n# a comment\n#EXT-X-TARGETDURATION:8"), F.concat(F.lit("#EXT-X-MEDIA-SEQUENCE:"), k.cast("string")), F.lit(
            "#EXT-X-VERSION:5\n\n#EXT-X-KEY:URI=\"k\",METHOD=AES-128"
        ),
        F.when(k % 2 == 0, "#EXTINF:7.500, one ").otherwise("#EXTINF:7, one "), F.concat(F.lit("a"), k.cast("string")), F.lit(
            "#EXT-X-KEY:METHOD=AES-128,URI=\"k\"\n#EXT-X-DISCONTINUITY\n#EXTINF:6.250\nb\n#EXT-X-ENDLIST\nstray"
        ),
    ]
    docs = suppliers(spark, sf_dir).select("doc_id", F.concat_ws("\n", *lines).alias("text"))
    return engine.regenerate(docs).withColumn("refused", F.col("text").isNull())


@query(
    """SELECT s_suppkey AS doc_id, 'https://h' || s_nationkey || '/x/s.ts' AS uri, 'https://h' || s_nationkey || '/x/k' AS key_uri, 'https://h'
  || s_nationkey || '/x/{$none}' AS map_uri FROM supplier"""
)
def resolved_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.1.39, 2.1.40: variables that a playlist defines, resolved in its URIs, whatever the order of definitions."""
    nation = F.col("s_nationkey").cast("string")
    lines = [
        F.lit(
            '#EXTM3U\n#EXT-X-TARGETDURATION:8\n#EXT-X-DEFINE:NAME="a",VALUE="{$b}/x"\n#EXT-X-DEFINE:NAME="b",VALUE="https://{$c}"'
        ), F.concat(F.lit('#EXT-X-DEFINE:NAME="c",VALUE="h'), nation, F.lit('"')),
        F.lit('#EXT-X-KEY:METHOD=AES-128,URI="{$a}/k"\n#EXT-X-MAP:URI="{$a}/{$none}"\n#EXTINF:8.0,\n{$a}/s.ts'),
    ]
    docs = suppliers(spark, sf_dir).select("doc_id", F.concat_ws("\n", *lines).alias("text"))
    return engine.parse(docs)["segments"].select("doc_id", "uri", F.col("key_tag.uri").alias("key_uri"), F.col("map.uri").alias("map_uri"))


@query("""WITH p AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i, p_partkey % 3 AS m FROM part)
SELECT p_brand, p_partkey, 'spatial' AS kind, i = 1 AS is_default, CASE m WHEN 0 THEN 'atmos/' ELSE 'a' END || p_partkey || '.m3u8' AS uri FROM p
UNION ALL SELECT p_brand, p_partkey, 'stereo', false, CASE m WHEN 0 THEN 'stereo/' || p_partkey || '.m3u8' ELSE 'a' || p_partkey
  || '_stereo.m3u8' END FROM p""")
def spatial_renditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.4.12, 2.9.18: a spatial rendition and its stereo fallback for each track; the first track is the default."""
    k = F.col("p_partkey")
    uri = F.concat(F.when(k % 3 == 0, "atmos/").otherwise("a"), k.cast("string"), F.lit(".m3u8"))
    p = load(spark, sf_dir, "part").select("p_brand", "p_partkey", uri.alias("uri"))
    return pipeline.audio_renditions(p, ["p_brand"], "p_partkey").select("p_brand", "p_partkey", "kind", "is_default", "uri")


@query(
    """SELECT s_suppkey, 'captions' AS source, CASE WHEN s_suppkey % 2 = 0 THEN 'CC' ELSE 'SERVICE' END || s_nationkey AS id FROM supplier UNION ALL
  SELECT s_suppkey, 'subtitles', 's' || s_nationkey FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey, 'description', s_name
  FROM supplier WHERE s_suppkey % 5 = 0"""
)
def accessibility_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.4.13: captions, subtitles and descriptions of a configuration as one set of entries."""
    s, k = load(spark, sf_dir, "supplier"), F.col("s_suppkey")
    c = s.select("s_suppkey", M.instream_id(F.when(k % 2 == 0, "608").otherwise("708"), F.col("s_nationkey")).alias("id"))
    t = s.where(k % 3 == 0).select("s_suppkey", F.concat(F.lit("s"), F.col("s_nationkey").cast("string")).alias("id"))
    return pipeline.captions_and_more(c, t, s.where(k % 5 == 0).select("s_suppkey", F.col("s_name").alias("id"))).select("s_suppkey", "source", "id")
