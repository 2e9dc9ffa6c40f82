"""Scans and rules on literal playlists: each rule fires once, and not on a good playlist."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewell.functions import attributes as A
from tidewell.functions import text as T
from tidewell.operators import rules
from tidewell.sources import manifest as S
from tidewell.sources import sinks

GOOD_MASTER = """#EXTM3U
#EXT-X-VERSION:7
#EXT-X-INDEPENDENT-SEGMENTS
#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="snd",NAME="Main",DEFAULT=YES,AUTOSELECT=YES,LANGUAGE="en",URI="snd/main.m3u8"
#EXT-X-STREAM-INF:BANDWIDTH=910000,RESOLUTION=852x480,FRAME-RATE=25.000,CODECS="avc1.4d4028,mp4a.40.2",AUDIO="snd"
low.m3u8
#EXT-X-STREAM-INF:BANDWIDTH=2350000,RESOLUTION=1280x720,FRAME-RATE=25.000,CODECS="avc1.4d4028,mp4a.40.2",AUDIO="snd"
mid.m3u8
#EXT-X-STREAM-INF:BANDWIDTH=6120000,RESOLUTION=1920x1080,FRAME-RATE=25.000,CODECS="avc1.64002a,mp4a.40.2",AUDIO="snd"
top.m3u8
#EXT-X-I-FRAME-STREAM-INF:BANDWIDTH=154000,RESOLUTION=512x288,CODECS="avc1.42c01e",URI="i.m3u8"
"""
GOOD_MEDIA = """#EXTM3U
#EXT-X-VERSION:7
#EXT-X-TARGETDURATION:6
#EXT-X-PLAYLIST-TYPE:VOD
#EXT-X-INDEPENDENT-SEGMENTS
#EXT-X-MAP:URI="init.mp4"
#EXTINF:5.84,
s0.m4s
#EXTINF:6.0,A title
s1.m4s
#EXT-X-ENDLIST
"""
LOW = """#EXTM3U
#EXT-X-VERSION:9
#EXT-X-TARGETDURATION:4
#EXT-X-SERVER-CONTROL:CAN-BLOCK-RELOAD=YES,PART-HOLD-BACK=3.012
#EXT-X-PART-INF:PART-TARGET=1.004
#EXT-X-INDEPENDENT-SEGMENTS
#EXT-X-MAP:URI="init.mp4"
#EXTINF:4.0,
s0.m4s
#EXT-X-PART:DURATION=1.004,URI="s1.0.m4s",INDEPENDENT=YES
#EXT-X-PRELOAD-HINT:TYPE=PART,URI="s1.1.m4s"
#EXT-X-RENDITION-REPORT:URI="../a.m3u8",LAST-MSN=100,LAST-PART=2
"""

#: rule id -> (playlist, what to replace, with what, how often it fires)
CASES = [
    ("RFC8216-4.3.4.2-bandwidth", GOOD_MASTER, "BANDWIDTH=910000", "BANDWIDTH=0", 1),
    ("parse", GOOD_MASTER, "top.m3u8\n", "", 1),
    ("RFC8216-4.3.4.2-resolution", GOOD_MASTER, "RESOLUTION=1280x720,", "", 1),
    ("RFC8216-4.3.4.1-group-id", GOOD_MASTER, "#EXT-X-STREAM-INF:BANDWIDTH=910000", '#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="snd",NAME="Main",LANGUAGE="de"\n#EXT-X-STREAM-INF:BANDWIDTH=910000', 1),
    ("RFC8216-4.3.4.1-default", GOOD_MASTER, "#EXT-X-STREAM-INF:BANDWIDTH=910000", '#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="snd",NAME="x",LANGUAGE="de",DEFAULT=YES\n#EXT-X-STREAM-INF:BANDWIDTH=910000', 1),
    ("RFC8216-4.3.4.2-audio-ref", GOOD_MASTER, 'GROUP-ID="snd"', 'GROUP-ID="other"', 3),
    ("RFC8216-4.3.4.2-subtitle-ref", GOOD_MASTER, "FRAME-RATE=25.000,", 'FRAME-RATE=25.000,SUBTITLES="s",', 3),
    ("RFC8216-4.3.4.2-cc-ref", GOOD_MASTER, "FRAME-RATE=25.000,", 'FRAME-RATE=25.000,CLOSED-CAPTIONS="c",', 3),
    ("RFC8216-4.3.4.5-session-data-value", GOOD_MASTER, "#EXT-X-I-FRAME", '#EXT-X-SESSION-DATA:DATA-ID="a",VALUE="v",URI="u"\n#EXT-X-SESSION-DATA:DATA-ID="b"\n#EXT-X-I-FRAME', 2),
    ("RFC8216-4.3.4.5-session-data-id", GOOD_MASTER, "#EXT-X-I-FRAME", '#EXT-X-SESSION-DATA:DATA-ID="a",VALUE="v",LANGUAGE="en"\n#EXT-X-SESSION-DATA:DATA-ID="a",VALUE="w",LANGUAGE="en"\n#EXT-X-I-FRAME', 1),
    ("RFC8216-general-variants", '#EXTM3U\n#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="a",NAME="b"\n', "", "", 1),
    ("APPLE-2.1-codecs", GOOD_MASTER, 'CODECS="avc1.64002a,mp4a.40.2",', "", 1),
    ("APPLE-2.1-frame-rate", GOOD_MASTER, "RESOLUTION=1280x720,FRAME-RATE=25.000", "RESOLUTION=1280x720", 1),
    ("APPLE-2.2-iframe", GOOD_MASTER, "#EXT-X-I-FRAME", "#COMMENT", 1),
    ("APPLE-2.3-audio-group", GOOD_MASTER, 'LANGUAGE="en",', "", 1),
    ("APPLE-2.4-resolution-ladder", GOOD_MASTER, "1920x1080", "1920x1000", 1),
    ("APPLE-2.5-bandwidth-order", GOOD_MASTER, "BANDWIDTH=6120000", "BANDWIDTH=500", 1),
    ("APPLE-2.6-hdcp", GOOD_MASTER, "1920x1080", "3840x2160", 1),
    ("APPLE-2.7-video-range", GOOD_MASTER, "RESOLUTION=1280x720", "VIDEO-RANGE=PQ,RESOLUTION=1280x720", 0),
    ("APPLE-2.8-supplemental-codecs", GOOD_MASTER, 'CODECS="avc1.64002a,mp4a.40.2",', 'SUPPLEMENTAL-CODECS="dvh1.08.07/db4h",', 1),
    ("APPLE-2.9-video-layout", GOOD_MASTER, "RESOLUTION=1280x720", 'REQ-VIDEO-LAYOUT="CH-STEREO",RESOLUTION=1280x720', 1),
    ("RFC8216-4.3.3.1-integer", GOOD_MEDIA, "TARGETDURATION:6", "TARGETDURATION:0", 1),
    ("RFC8216-4.3.3.1-segment-duration", GOOD_MEDIA, "EXTINF:5.84", "EXTINF:6.5", 1),
    ("RFC8216-general-empty", "#EXTM3U\n#EXT-X-TARGETDURATION:6\n", "", "", 1),
    ("RFC8216-4.3.2.1-extinf", GOOD_MEDIA, "EXTINF:5.84", "EXTINF:-1.0", 1),
    ("RFC8216-4.3.3.5-endlist-vod", GOOD_MEDIA, "#EXT-X-ENDLIST", "", 1),
    ("RFC8216-4.3.2.4-key-uri", GOOD_MEDIA, "#EXTINF:6.0,", "#EXT-X-KEY:METHOD=AES-128\n#EXTINF:6.0,", 1),
    ("RFC8216-4.3.2.4-key-iv", GOOD_MEDIA.replace("VERSION:7", "VERSION:1"), "#EXTINF:5.84", '#EXT-X-KEY:METHOD=AES-128,URI="k",IV=0x1\n#EXTINF:5.84', 2),
    ("RFC8216-4.3.2.2-byterange-version", GOOD_MEDIA.replace("VERSION:7", "VERSION:3"), "#EXTINF:5.84,", "#EXT-X-BYTERANGE:100@5\n#EXTINF:5.84,", 1),
    ("RFC8216-4.3.2.5-map-version", GOOD_MEDIA, "VERSION:7", "VERSION:5", 1),
    ("RFC8216-4.4.3-version-match", GOOD_MEDIA, "VERSION:7", "VERSION:5", 1),
    ("RFC8216bis-part-inf", LOW, "#EXT-X-PART-INF:PART-TARGET=1.004\n", "", 1),
    ("RFC8216bis-server-control", LOW, "#EXT-X-SERVER-CONTROL:CAN-BLOCK-RELOAD=YES,PART-HOLD-BACK=3.012\n", "", 1),
    ("RFC8216bis-part-duration", LOW, "DURATION=1.004", "DURATION=1.1", 1),
    ("RFC8216bis-hold-back", LOW, "PART-HOLD-BACK=3.012", "PART-HOLD-BACK=2.0", 1),
    ("RFC8216bis-version", LOW, "VERSION:9", "VERSION:7", 1),
    ("APPLE-3.1-segment-duration", GOOD_MEDIA, "EXTINF:6.0,", "EXTINF:30.0,", 1),
    ("APPLE-3.2-target-duration", GOOD_MEDIA, "TARGETDURATION:6", "TARGETDURATION:7", 1),
    ("APPLE-3.2-target-duration", LOW, "TARGETDURATION:4", "TARGETDURATION:5", 1),
    ("APPLE-3.5-independent", GOOD_MEDIA, "#EXT-X-INDEPENDENT-SEGMENTS\n", "", 1),
    ("APPLE-3.4-fmp4", GOOD_MEDIA, '#EXT-X-MAP:URI="init.mp4"\n', "", 1),
    ("RFC8216bis-4.4.3.8-import", GOOD_MEDIA, "#EXTINF:6.0,", '#EXT-X-DEFINE:IMPORT="v"\n#EXTINF:6.0,', 1),
    ("RFC8216bis-4.4.3.8-duplicate", GOOD_MEDIA, "#EXTINF:6.0,", '#EXT-X-DEFINE:NAME="v",VALUE="1"\n#EXT-X-DEFINE:NAME="v",VALUE="2"\n#EXTINF:6.0,', 1),
    ("RFC8216bis-4.4.3.8-circular", GOOD_MEDIA, "#EXTINF:6.0,", '#EXT-X-DEFINE:NAME="a",VALUE="{$b}"\n#EXT-X-DEFINE:NAME="b",VALUE="{$a}"\n#EXT-X-DEFINE:NAME="c",VALUE="{$c}"\n#EXTINF:6.0,', 3),
    ("RFC8216bis-4.4.3.8-undefined", GOOD_MEDIA, "s0.m4s", '{$q}/{$v}.m4s\n#EXT-X-DEFINE:NAME="v",VALUE="1"\n#EXT-X-DEFINE:QUERYPARAM="q"', 1),
    ("parse", "", "", "", 1),
    ("parse", "#EXTM3U\n#EXT-X-VERSION:3\n", "", "", 1),
    ("parse", "#NOT\n#EXTINF:1,\nx\n", "", "", 1),
]


@pytest.fixture(scope="module")
def findings(spark):
    docs = [(-1, GOOD_MASTER), (-2, GOOD_MEDIA), (-3, LOW)] + [(i, text.replace(old, new) if old else text) for i, (_, text, old, new, _) in enumerate(CASES)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = {}
    for r in rules.validate(df).collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_every_rule_fires(findings):
    for i, (rule, *_, n) in enumerate(CASES):
        assert sum(f.rule_id == rule for f in findings.get(i, [])) == n, rule


def test_variant_without_uri(spark):
    """Texts like that are refused; tables may hold such variants."""
    lines = S.lines(spark.createDataFrame([(1, GOOD_MASTER.replace("top.m3u8\n", ""))], "doc_id long, text string"))
    assert [r.field for r in rules.master_findings(lines).collect() if r.rule_id == "RFC8216-4.3.4.2-uri"] == ["variants[2].uri"]


def test_good_playlists_have_no_findings(findings):
    assert [f.rule_id for f in findings.get(-1, [])] == [] and [f.rule_id for f in findings.get(-2, [])] == [] and [f.rule_id for f in findings.get(-3, [])] == []


def test_messages(findings):
    by = {(i, f.rule_id): f for i, fs in findings.items() for f in fs}
    long = next(f for (i, r), f in by.items() if r == "RFC8216-4.3.3.1-segment-duration" and i == 22)
    assert long.message == "Segment duration 6.5s exceeds TARGETDURATION 6s." and long.field == "segments[0].duration" and long.severity == "error"
    assert {f.field for f in findings[len(CASES) - 3]} == {"emptyManifest"} and {f.field for f in findings[len(CASES) - 1]} == {"missingHeader"} and {f.field for f in findings[len(CASES) - 2]} == {"ambiguousPlaylistType"}


MEDIA_HEAD, MASTER_HEAD = "#EXTM3U\n#EXT-X-TARGETDURATION:6\n", "#EXTM3U\n#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID=\"a\",NAME=\"b\"\n"
#: A text that is refused, the kind of error and its message.
REFUSED = [
    ("#EXTM3U\n#EXTINF:4,\nx\n", "missingRequiredTag", "Missing required tag: EXT-X-TARGETDURATION."),
    (MEDIA_HEAD + "#EXT-X-VERSION:99\n", "invalidVersion", "Invalid or unsupported EXT-X-VERSION value: 99."),
    (MEDIA_HEAD + "#EXT-X-VERSION:x\n#EXTINF:bad\n", "invalidVersion", "Invalid or unsupported EXT-X-VERSION value: x."),
    ("#EXTM3U\n#EXT-X-TARGETDURATION:6.5\n", "invalidTagFormat", "Invalid format for tag 'EXT-X-TARGETDURATION' at line 2."),
    (MEDIA_HEAD + "\n#EXT-X-MEDIA-SEQUENCE:one\n", "invalidTagFormat", "Invalid format for tag 'EXT-X-MEDIA-SEQUENCE' at line 4."),
    (MEDIA_HEAD + "#EXT-X-DISCONTINUITY-SEQUENCE:\n", "invalidTagFormat", "Invalid format for tag 'EXT-X-DISCONTINUITY-SEQUENCE' at line 3."),
    (MEDIA_HEAD + "#EXTINF:abc,t\nx\n", "invalidAttributeValue", "Invalid value 'abc,t' for attribute 'duration' in EXTINF."),
    (MEDIA_HEAD + "#EXT-X-BYTERANGE:a@1\n", "invalidAttributeValue", "Invalid value 'a@1' for attribute 'length' in EXT-X-BYTERANGE."),
    (MEDIA_HEAD + "#EXT-X-BYTERANGE:5@b\n", "invalidAttributeValue", "Invalid value 'b' for attribute 'offset' in EXT-X-BYTERANGE."),
    (MEDIA_HEAD + "#EXT-X-KEY:URI=\"k\"\n", "missingRequiredAttribute", "Missing required attribute 'METHOD' in EXT-X-KEY."),
    (MEDIA_HEAD + "#EXT-X-KEY:METHOD=ROT13\n", "invalidAttributeValue", "Invalid value 'ROT13' for attribute 'METHOD' in EXT-X-KEY."),
    (MEDIA_HEAD + "#EXT-X-MAP:BYTERANGE=\"1@2\"\n", "missingRequiredAttribute", "Missing required attribute 'URI' in EXT-X-MAP."),
    (MEDIA_HEAD + "#EXT-X-MAP:URI=\"i\",BYTERANGE=\"x\"\n", "invalidAttributeValue", "Invalid value 'x' for attribute 'length' in EXT-X-BYTERANGE."),
    (MEDIA_HEAD + "#EXT-X-PROGRAM-DATE-TIME:noon\n", "invalidAttributeValue", "Invalid value 'noon' for attribute 'date' in EXT-X-PROGRAM-DATE-TIME."),
    (MEDIA_HEAD + "#EXT-X-DATERANGE:START-DATE=\"2026-01-01T00:00:00Z\"\n", "missingRequiredAttribute", "Missing required attribute 'ID' in EXT-X-DATERANGE."),
    (MEDIA_HEAD + "#EXT-X-DATERANGE:ID=\"a\",START-DATE=\"soon\"\n", "invalidAttributeValue", "Invalid value 'soon' for attribute 'START-DATE' in EXT-X-DATERANGE."),
    (MEDIA_HEAD + "#EXT-X-PART:URI=\"p\"\n", "missingRequiredAttribute", "Missing required attribute 'DURATION' in EXT-X-PART."),
    (MEDIA_HEAD + "#EXT-X-PART-INF:PART-TARGET=x\n", "invalidAttributeValue", "Invalid value 'x' for attribute 'PART-TARGET' in EXT-X-PART-INF."),
    (MEDIA_HEAD + "#EXT-X-PRELOAD-HINT:TYPE=KEY,URI=\"u\"\n", "invalidAttributeValue", "Invalid value 'KEY' for attribute 'TYPE' in EXT-X-PRELOAD-HINT."),
    (MEDIA_HEAD + "#EXT-X-RENDITION-REPORT:LAST-MSN=1\n", "missingRequiredAttribute", "Missing required attribute 'URI' in EXT-X-RENDITION-REPORT."),
    (MEDIA_HEAD + "#EXT-X-SKIP:SKIPPED-SEGMENTS=1.5\n", "invalidAttributeValue", "Invalid value '1.5' for attribute 'SKIPPED-SEGMENTS' in EXT-X-SKIP."),
    (MEDIA_HEAD + "#EXT-X-START:PRECISE=YES\n", "missingRequiredAttribute", "Missing required attribute 'TIME-OFFSET' in EXT-X-START."),
    ("#EXTM3U\n#EXT-X-STREAM-INF:CODECS=\"x\"\nv\n", "missingRequiredAttribute", "Missing required attribute 'BANDWIDTH' in EXT-X-STREAM-INF."),
    ("#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH=1k\nv\n", "invalidAttributeValue", "Invalid value '1k' for attribute 'BANDWIDTH' in EXT-X-STREAM-INF."),
    ("#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH=1\nv\n#EXT-X-STREAM-INF:BANDWIDTH=2\n", "missingURI", "Missing URI after EXT-X-STREAM-INF at line 4."),
    (MASTER_HEAD + "#EXT-X-I-FRAME-STREAM-INF:BANDWIDTH=1\n", "missingRequiredAttribute", "Missing required attribute 'URI' in EXT-X-I-FRAME-STREAM-INF."),
    (MASTER_HEAD + "#EXT-X-MEDIA:TYPE=SOUND,GROUP-ID=\"a\",NAME=\"c\"\n", "invalidAttributeValue", "Invalid value 'SOUND' for attribute 'TYPE' in EXT-X-MEDIA."),
    (MASTER_HEAD + "#EXT-X-MEDIA:TYPE=AUDIO,NAME=\"c\"\n", "missingRequiredAttribute", "Missing required attribute 'GROUP-ID' in EXT-X-MEDIA."),
    (MASTER_HEAD + "#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID=\"a\"\n", "missingRequiredAttribute", "Missing required attribute 'NAME' in EXT-X-MEDIA."),
    (MASTER_HEAD + "#EXT-X-SESSION-DATA:VALUE=\"a\"\n", "missingRequiredAttribute", "Missing required attribute 'DATA-ID' in EXT-X-SESSION-DATA."),
    (MASTER_HEAD + "#EXT-X-SESSION-KEY:URI=\"a\"\n", "missingRequiredAttribute", "Missing required attribute 'METHOD' in EXT-X-KEY."),
    (MASTER_HEAD + "#EXT-X-CONTENT-STEERING:PATHWAY-ID=\"a\"\n", "missingRequiredAttribute", "Missing required attribute 'SERVER-URI' in EXT-X-CONTENT-STEERING."),
    (None, "emptyManifest", "The manifest is empty or contains only whitespace."),
]


def test_refused_texts(spark):
    good = [MEDIA_HEAD + "#EXT-X-MEDIA-SEQUENCE:+3\n#EXTINF:.5\nx\n", MEDIA_HEAD + "#EXT-X-SESSION-KEY:URI=\"not of media\"\n#EXTINF:,5\nx\n", MASTER_HEAD + "#EXTINF:not of master\n", MEDIA_HEAD + "#EXT-X-KEY\n#EXT-X-BYTERANGE:5@\n"]
    texts = [t for t, *_ in REFUSED] + good
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    by: dict = {}
    for f in rules.validate(df).collect():
        by.setdefault(f.doc_id, []).append(f)
    for i, (text, code, message) in enumerate(REFUSED):
        assert [(f.rule_id, f.field, f.message, f.severity) for f in by[i]] == [("parse", code, message, "error")], text
    for i in range(len(REFUSED), len(texts)):
        assert all(f.rule_id != "parse" for f in by[i]), texts[i]
    assert not any(r.is_valid for r in rules.roll_up(df, rules.validate(df)).collect() if r.doc_id < len(REFUSED))


def test_rule_sets(spark):
    df = spark.createDataFrame([(1, GOOD_MEDIA.replace("TARGETDURATION:6", "TARGETDURATION:0"))], "doc_id long, text string")
    assert {r.rule_set for r in rules.validate(df, "appleHLS").collect()} == {"appleHLS"}
    assert {r.rule_set for r in rules.validate(df, "rfc8216").collect()} == {"rfc8216"}
    r = rules.roll_up(df, rules.validate(df)).first()
    assert (r.errors, r.is_valid) == (3, False)


def test_media_round_trip(spark):
    text = """#EXTM3U
#EXT-X-VERSION:7
#EXT-X-TARGETDURATION:7
#EXT-X-MEDIA-SEQUENCE:5
#EXT-X-KEY:METHOD=AES-128,URI="k",IV=0x00000000000000000000000000000001
#EXT-X-MAP:URI="init.mp4",BYTERANGE="100@0"
#EXT-X-PROGRAM-DATE-TIME:2026-01-02T03:04:05.678Z
#EXTINF:5.84,first
a.m4s
#EXT-X-DISCONTINUITY
#EXT-X-GAP
#EXT-X-BYTERANGE:10@20
#EXTINF:6.0,
b.m4s
#EXT-X-KEY:METHOD=NONE
#EXTINF:1.5,
c.m4s
#EXT-X-ENDLIST
"""
    lines = S.lines(spark.createDataFrame([(1, text + "\n# comment\n\nstray.m4s\n")], "doc_id long, text string"))
    s = S.segments(lines)
    rows = s.orderBy("pos").collect()
    assert [(r.uri, r.duration, r.title, r.discontinuity, r.gap) for r in rows] == [("a.m4s", 5.84, "first", False, False), ("b.m4s", 6.0, None, True, True), ("c.m4s", 1.5, None, False, False)]
    assert [r.key_tag.method for r in rows] == ["AES-128", "AES-128", "NONE"] and rows[1].byte_range == (10, 20) and rows[2].map.byte_range == (100, 0)
    h = S.media_headers(lines)
    assert h.first().media_sequence == 5 and h.first().error is None
    assert sinks.media_playlist(h, s).first().text == text


def test_master_round_trip(spark):
    lines = S.lines(spark.createDataFrame([(1, GOOD_MASTER)], "doc_id long, text string"))
    v = S.variants(lines)
    assert [(r.pos, r.bandwidth, r.resolution.height, r.codecs, r.error) for r in v.orderBy("pos").collect()][0] == (0, 910000, 480, "avc1.4d4028,mp4a.40.2", None)
    head = spark.createDataFrame([(1, 7, True)], "doc_id long, version int, independent_segments boolean")
    back = sinks.master_playlist(head, S.renditions(lines), v).first().text
    assert back == GOOD_MASTER[: GOOD_MASTER.index("#EXT-X-I-FRAME")]
    i = S.iframe_variants(lines).first()
    assert (i.uri, i.bandwidth, i.resolution.width) == ("i.m3u8", 154000, 512)


def test_low_latency_and_the_rest(spark):
    text = LOW + '#EXT-X-DATERANGE:ID="d",START-DATE="2026-01-01T00:00:00Z",END-DATE="bad",DURATION=3.5,X-AD="1"\n#EXT-X-START:TIME-OFFSET=-3.5,PRECISE=YES\n#EXT-X-SKIP:SKIPPED-SEGMENTS=7\n#EXT-X-DATERANGE:CLASS="x"\n'
    lines = S.lines(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    p = S.parts(lines).first()
    assert (p.uri, p.duration, p.independent, p.gap, p.error) == ("s1.0.m4s", 1.004, True, False, None)
    assert S.preload_hints(lines).first().type == "PART" and S.rendition_reports(lines).first().last_msn == 100
    h = S.media_headers(lines).first()
    assert (h.part_target, h.server_control.part_hold_back, h.start.time_offset, h.start.precise, h.skipped_segments) == (1.004, 3.012, -3.5, True, 7)
    d, bad = S.date_ranges(lines).orderBy("pos").collect()
    assert d.client == {"X-AD": "1"} and d.end_date is None and d.duration == 3.5 and d.start_date == dt.datetime(2026, 1, 1)
    assert bad.error.code == "missingRequiredAttribute" and bad.error.attribute == "ID"
    m = S.lines(spark.createDataFrame([(1, '#EXTM3U\n#EXT-X-SESSION-KEY:METHOD=SAMPLE-AES,URI="k"\n#EXT-X-CONTENT-STEERING:SERVER-URI="/s",PATHWAY-ID="A"\n#EXT-X-STREAM-INF:CODECS="x"\nv\n')], "doc_id long, text string"))
    assert S.session_keys(m).first().method == "SAMPLE-AES" and S.steering(m).first().pathway_id == "A"
    assert S.variants(m).first().error.code == "missingRequiredAttribute"


@pytest.mark.parametrize("text,want", [
    ('A=1,B="x,y",C=z', {"A": "1", "B": "x,y", "C": "z"}),
    ('A=1,A=2', {"A": "2"}),
    ('A="open, to the end', {"A": "open, to the end"}),
    ("", {}),
    ('A="",B=', {"A": "", "B": ""}),
    ('A="x=y",B=c=d', {"A": "x=y", "B": "c=d"}),
])
def test_attribute_lists(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(A.attribute_map(F.col("t"))).first()[0] == want


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(T.decimal(F.lit(x))) for x in (6.0, 6.006, 6.1, 0.33334, 10.0)] == ["6.0", "6.006", "6.1", "0.333", "10.0"]
    assert one(T.vtt_time(F.lit(3661.9999))) == "01:01:01.999" and one(T.ttml_time(F.lit(3661.9999))) == "01:01:02.000" and one(T.vtt_time(F.lit(61.5), True)) == "01:01.500"
    assert one(T.parse_timecode(F.lit("01:00:01.5"))) == 3601.5 and one(T.parse_timecode(F.lit("00:00:01:12"))) is None
    assert one(T.file_name(F.lit("s_%d_%d.ts"), F.lit(7))) == "s_7_%d.ts" and one(T.fill_template(F.lit("seg{segment}.{part}.{ext}"), F.lit(1), F.lit(2), F.lit("mp4"))) == "seg1.2.mp4"
    assert one(A.frame_rate(F.lit("30000/1001"))) == pytest.approx(29.97003)
    assert one(T.variable_names(F.lit("{$a}{$}{$b}x{$c"))) == ["a", "b"]
