"""Nothing is dropped or left out beyond a size: chains of variables, destinations, windows."""

import pytest
from pyspark.sql import functions as F

from tidewell import engine
from tidewell.functions import text as T
from tidewell.operators import patterns, transport


def resolve(spark, text, values):
    rows = spark.createDataFrame([(text, values)], "t string, v map<string,string>")
    return rows.select(T.resolve_variables(F.col("t"), F.col("v"))).first()[0]


def test_chains_of_definitions_resolve_in_any_order(spark):
    chain = {f"n{i:02d}": f"{i}-{{$n{i - 1:02d}}}" for i in range(1, 20)} | {"n00": "end"}
    assert resolve(spark, "{$n19}/{$x}", chain) == "-".join(map(str, range(19, 0, -1))) + "-end/{$x}"
    back = {f"n{i:02d}": f"{i}-{{$n{i + 1:02d}}}" for i in range(19)} | {"n19": "end"}
    assert resolve(spark, "{$n00}", back) == "-".join(map(str, range(19))) + "-end"
    assert resolve(spark, "plain", {}) == "plain" and resolve(spark, "{$a}", {"a": None}) == ""


def test_cycles_and_doubling_end(spark):
    assert "{$" in resolve(spark, "{$a}", {"a": "{$b}", "b": "{$a}"})
    assert len(resolve(spark, "{$k00}", {f"k{i:02d}": f"{{$k{i + 1:02d}}}{{$k{i + 1:02d}}}" for i in range(40)})) < 1 << 24


@pytest.mark.parametrize("most", [3, 1000])
def test_fan_out_of_any_number_of_destinations(spark, most):
    segments, targets = spark.range(20).withColumnRenamed("id", "segment"), spark.range(50).withColumnRenamed("id", "target")
    got = {(r.segment, r.target) for r in transport.fan_out(segments, targets, most).collect()}
    assert got == {(s, t) for s in range(20) for t in range(50)}


@pytest.mark.parametrize("span", [None, 1, 7, 1000])
def test_trailing_buckets_don_t_matter(spark, span):
    rows = spark.range(200).selectExpr("id % 3 as k", "id * 7 % 101 as t", "id as v")
    got = patterns.trailing(rows, ["k"], F.col("t"), 5, {"s": lambda w: F.sum("v").over(w)}, span)
    data = [(i % 3, i * 7 % 101, i) for i in range(200)]
    want = {v: sum(x for k2, t2, x in data if k2 == k and t - 5 <= t2 <= t) for k, t, v in data}
    assert {r.v: r.s for r in got.collect()} == want


def test_parsed_uris_are_resolved(spark):
    media = """#EXTM3U
#EXT-X-TARGETDURATION:4
#EXT-X-DEFINE:NAME="host",VALUE="https://{$dom}/x"
#EXT-X-DEFINE:NAME="dom",VALUE="h.example"
#EXT-X-KEY:METHOD=AES-128,URI="{$host}/k"
#EXT-X-MAP:URI="{$host}/i.mp4"
#EXT-X-PART:DURATION=1.0,URI="{$host}/p"
#EXTINF:4.0,
{$host}/{$other}/a.m4s
"""
    master = '#EXTM3U\n#EXT-X-DEFINE:NAME="p",VALUE="q"\n#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="g",NAME="n",URI="{$p}/a"\n#EXT-X-STREAM-INF:BANDWIDTH=7\n{$p}/v\n'
    t = engine.parse(spark.createDataFrame([(1, media), (2, master), (3, "#EXTM3U\n")], "doc_id long, text string"))
    s = t["segments"].first()
    assert (s.uri, s.key_tag.uri, s.map.uri) == ("https://h.example/x/{$other}/a.m4s", "https://h.example/x/k", "https://h.example/x/i.mp4")
    assert t["parts"].first().uri == "{$host}/p"
    assert (t["variants"].first().uri, t["renditions"].first().uri) == ("q/v", "q/a")
    assert [(r.doc_id, r.code) for r in t["problems"].collect()] == [(3, "ambiguousPlaylistType")]
