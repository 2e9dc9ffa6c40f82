"""What only larger or unlucky tables show: sides of joins that grow, open ties, noise of sums."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidewell.operators import audio, playlists, rules, transport
from tidewell.plans import binaries
from tidewell.sources import manifest as S
from tidewell.sources import sinks, tags

MEDIA = "#EXTM3U\n#EXT-X-TARGETDURATION:4\n#EXTINF:9.0,\na.ts\n#EXT-X-PART:DURATION=1.0,URI=\"p\"\n"


def plan_of(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_headers_are_not_broadcast(spark):
    """small as their file is, tables with a row a document stay out of the driver."""
    docs = spark.createDataFrame([(1, MEDIA), (2, MEDIA)], "doc_id long, text string")
    found = rules.media_findings(S.lines(docs))
    assert "Broadcast" not in plan_of(found)
    assert found.where("rule_id = 'RFC8216-4.3.3.1-segment-duration'").count() == 2


def test_counts_are_not_broadcast(spark):
    """nor are the counts of a document's findings."""
    docs = spark.createDataFrame([(1, MEDIA), (2, "#EXTM3U\n")], "doc_id long, text string")
    found = spark.range(2, 3).selectExpr("id as doc_id", "'error' as severity")
    out = rules.roll_up(docs, found)
    assert "Broadcast" not in plan_of(out)
    assert sorted((r.doc_id, r.errors, r.is_valid) for r in out.collect()) == [(1, 0, True), (2, 1, False)]


def test_chapters_without_length_keep_their_order(spark):
    """a chapter of no length and the next start alike; texts don't order numbers."""
    rows = [(1, 0, 0.0, 9.0, "a"), (1, 1, 9.0, 9.0, "z"), (1, 2, 9.0, 9.0, "b"), (1, 3, 9.0, 12.0, "c")]
    c = spark.createDataFrame(rows, "k long, i long, start double, end double, title string")
    json, vtt = sinks.chapters_json(c, ["k"], "i").first().json, sinks.cues_vtt(c, ["k"], "i").first().vtt
    assert [json.index(f'"{t}"') for t in "azbc"] == sorted(json.index(f'"{t}"') for t in "azbc")
    assert [vtt.index(f"\n{t}\n") for t in "azbc"] == sorted(vtt.index(f"\n{t}\n") for t in "azbc")


def test_skip_boundary_without_noise(spark):
    """0.1 + 0.2 ends 36 before 36.3, as whole microseconds."""
    s = spark.createDataFrame([(1, 0, 0.1), (1, 1, 0.2), (1, 2, 36.0)], "k long, i long, d double")
    assert playlists.skipped(s, ["k"], "i", "d", F.lit(36.0)).first().skipped_segments == 2


def test_target_without_noise(spark):
    """0.1 + 0.2 + 2.7 is 3 and a little as doubles; the target is 3."""
    s = spark.createDataFrame([(1, 0, 0.1 + 0.2 + 2.7, "a", False), (1, 1, 3.0000000000000004, "b", False)], "k long, i long, duration double, uri string, discontinuity boolean")
    assert "TARGETDURATION:3\n" in tags.recording(s, ["k"], "i", True).first().text


def test_latencies_are_added_in_order(spark):
    """F8: 1e16 swallows the ones that are added to it one by one, whatever order the rows lie in."""
    rows = [(1, i, 1e16 if i == 0 else 1.0, 1) for i in (4, 3, 2, 1, 0)]
    p = spark.createDataFrame(rows, "k long, i long, s double, b long").coalesce(1)
    assert transport.push_totals(p, ["k"], "i", "b", "s", F.lit(True)).first().mean_latency == 2e15


def test_digital_silence_has_no_mean(spark):
    """one window without any level takes the mean to -inf."""
    w = spark.createDataFrame([(1, 0, 0.001), (1, 1, 0.0), (2, 0, 0.001), (2, 1, 0.001)], "k long, i long, rms double")
    got = {r.k: r.mean_db for r in audio.silence(w, ["k"], "i", "rms", 0.5, 1.0).collect()}
    assert got == {1: float("-inf"), 2: pytest.approx(-60.0)}


def test_tracks_are_made_once(spark):
    """what reads the tracks reads a table, and makes and parses no file again."""
    assert "MapInArrow" not in plan_of(binaries.sample_places(spark, SF))
