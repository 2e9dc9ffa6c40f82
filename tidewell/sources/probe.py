"""Descriptions of sources: container kinds, probe output, progress lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.attributes import frame_rate

#: Path extensions of containers that need no conversion.
CONTAINERS = ("mp4", "m4a", "m4v", "mov")
PROBE = "struct<format:struct<duration:string>,streams:array<struct<codec_type:string,codec_name:string,width:int,height:int,r_frame_rate:string,avg_frame_rate:string,bit_rate:string,sample_rate:string,channels:int,duration:string>>>"


def is_container(path: Column) -> Column:
    """By the extension alone; contents aren't read."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*CONTAINERS)


def source_info(json: Column) -> Column:
    """struct of a probe's JSON: duration, the first video and the first audio stream; null if it is no JSON object."""
    p = F.from_json(json, PROBE)
    first = lambda kind: F.get(F.filter(p["streams"], lambda s: s["codec_type"] == kind), F.lit(0))
    v, a = first("video"), first("audio")
    rate = F.when(v["r_frame_rate"].isNotNull(), frame_rate(v["r_frame_rate"]))
    return F.when(p.isNotNull(), F.struct(
        F.coalesce(
            p["format"]["duration"].try_cast("double"), F.array_max(F.transform(p["streams"], lambda s: s["duration"].try_cast("double")))
        ).alias("duration"), v.isNotNull().alias("has_video"), a.isNotNull().alias("has_audio"),
        v["width"].alias("width"), v["height"].alias("height"), v["codec_name"].alias("video_codec"), rate.alias("frame_rate"),
        v["bit_rate"].try_cast("long").alias("video_bitrate"),
        a["codec_name"].alias("audio_codec"), a["bit_rate"].try_cast("long").alias("audio_bitrate"),
        a["sample_rate"].try_cast("double").alias("sample_rate"), a["channels"].alias("channels"),
    ))


def progress_seconds(line: Column) -> Column:
    """Seconds of time=HH:MM:SS.xx in a line; null without one."""
    part = lambda i: F.regexp_extract(line, r"time=(\d{2}):(\d{2}):(\d{2}\.\d+)", i)
    return F.when(part(1) != "", part(1).try_cast("double") * 3600 + part(2).try_cast("double") * 60 + part(3).try_cast("double"))
