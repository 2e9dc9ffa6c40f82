"""Variant ladders: presets, bitrate ranges, codec strings, HDR and fallback variants, checks of settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Resolutions by name.
RESOLUTIONS = (
    ("SD 480p", 854, 480), ("HD 720p", 1280, 720), ("Full HD 1080p", 1920, 1080), ("QHD 1440p", 2560, 1440), ("4K UHD", 3840, 2160),
    ("Cinema 4K (DCI)", 4096, 2160), ("8K UHD", 7680, 4320)
)
#: Heights at which a bitrate tier ends, and megabits a second by codec and tier (vp9 as h265).
TIERS = (600, 800, 1200, 1600, 2400)
BITRATES = {
    "h264": ((1.0, 2.5), (2.5, 5.0), (4.0, 8.0), (8.0, 16.0), (15.0, 30.0), (40.0, 80.0)),
    "h265": ((0.5, 1.5), (1.5, 3.0), (2.5, 6.0), (4.0, 10.0), (8.0, 25.0), (25.0, 60.0)),
    "av1": ((0.4, 1.0), (1.0, 2.0), (1.5, 4.0), (3.0, 7.0), (6.0, 16.0), (15.0, 40.0)),
}
#: Heights at which an HEVC level ends, and the levels.
HEVC_LEVELS = ((720, 93), (1080, 120), (1440, 123), (2160, 150), (4320, 153))
#: Legal moves of a live pipeline.
TRANSITIONS = (
    ("idle", "starting"), ("starting", "running"), ("starting", "failed"), ("running", "stopping"), ("running", "failed"),
    ("stopping", "stopped"), ("stopping", "failed")
)
#: Key formats and system ids of the content protection systems.
KEY_FORMATS = {
    "widevine": "urn:uuid:edef8ba9-79d6-4ace-a3c8-27dcd51d21ed", "playready": "urn:uuid:9a04f079-9840-4286-ab92-e65be0885f95",
    "fairplay": "com.apple.streamingkeydelivery"
}
SYSTEM_IDS = {
    "widevine": "edef8ba9-79d6-4ace-a3c8-27dcd51d21ed", "playready": "9a04f079-9840-4286-ab92-e65be0885f95",
    "fairplay": "94ce86fb-07ff-4f43-adb8-93d2fa968ca2"
}


def system_id(system: Column) -> Column:
    """The id of a content protection system."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in SYSTEM_IDS.items() for x in kv]), system)


def _pick(x: Column, limits: tuple, values: tuple) -> Column:
    """values[i] for the first limit above x, the last value beyond all."""
    out = F.lit(values[-1])
    for limit, value in reversed(tuple(zip(limits, values, strict=False))):
        out = F.when(x < limit, F.lit(value)).otherwise(out)
    return out


def bitrate_range(height: Column, codec: Column, hdr: Column) -> Column:
    """struct(low, high) in bits a second; HDR takes a fifth more."""
    ends = []
    for side in (0, 1):
        value = F.lit(None).cast("long")
        for name, tiers in {**BITRATES, "vp9": BITRATES["h265"]}.items():
            value = F.when(codec == name, _pick(height, TIERS, tuple(int(t[side] * 1_000_000) for t in tiers)).cast("long")).otherwise(value)
        ends.append(F.when(hdr, F.floor(value * 120 / 100)).otherwise(value).cast("long"))
    return F.struct(ends[0].alias("low"), ends[1].alias("high"))


def recommended_bandwidth(height: Column, codec: Column, hdr: Column) -> Column:
    r = bitrate_range(height, codec, hdr)
    return F.floor((r["low"] + r["high"]) / 2).cast("long")


def codec_string(height: Column, codec: Column, hdr: Column) -> Column:
    level = _pick(height, tuple(x for x, _ in HEVC_LEVELS), (*(v for _, v in HEVC_LEVELS), 183)).cast("string")
    return (
        F.when(codec == "h265", F.concat(F.lit("hvc1."), F.when(hdr, "2.4").otherwise("1.6"), F.lit(".L"), level, F.lit(".B0")))
        .when(codec == "h264", F.when(hdr, "avc1.640033").otherwise("avc1.640028"))
        .when(codec == "av1", F.when(hdr, "av01.0.09M.10").otherwise("av01.0.09M.08"))
        .when(codec == "vp9", F.when(hdr, "vp09.02.10.10").otherwise("vp09.00.10.08"))
    )


def adaptive_ladder(spark: SparkSession, configs: DataFrame, codec: str = "codec", fallback: bool = True) -> DataFrame:
    """Rungs of each configuration (its columns, one named `codec`): HDR for every resolution, then the SDR
    fallback. h264 and vp9 stop at 4K UHD. The rungs are a fixed table of a few rows."""
    use = [r for r in RESOLUTIONS if r[0] != "Cinema 4K (DCI)"]
    rungs = spark.createDataFrame([(i, *r) for i, r in enumerate(use)], "rung int, name string, width int, height int")
    sets = spark.createDataFrame([(0, True)] + ([(1, False)] if fallback else []), "block int, hdr boolean")
    out = configs.crossJoin(F.broadcast(rungs)).crossJoin(F.broadcast(sets)).where((F.col("height") < 4320) | F.col(codec).isin("h265", "av1"))
    h, c = F.col("height"), F.col(codec)
    return out.withColumns(
        {
            "bandwidth": recommended_bandwidth(h, c, F.col("hdr")), "codecs": codec_string(h, c, F.col("hdr")),
            "video_range": F.when(F.col("hdr"), "PQ").otherwise("SDR"), "is_fallback": ~F.col("hdr")
        }
    ).drop("hdr")


def legal_transition(now: Column, following: Column) -> Column:
    return F.concat(now, F.lit(">"), following).isin(*[f"{a}>{b}" for a, b in TRANSITIONS])


def messages(*checks: tuple[Column, str | Column]) -> Column:
    """The messages of the checks that hold, in order."""
    as_col = lambda m: m if isinstance(m, Column) else F.lit(m)
    return F.array_compact(F.array(*[F.when(c, as_col(m)) for c, m in checks]))


def steering_problems(server: Column, pathways: Column, default: Column, interval: Column) -> Column:
    return messages(
        (server == "", "Server URI is empty"), (F.size(pathways) == 0, "No pathways configured"),
        (~F.array_contains(pathways, default), F.concat(F.lit("Default pathway '"), default, F.lit("' not found in pathways list"))),
        (interval <= 0, "Polling interval must be positive")
    )


def caption_problems(standard: Column, ids: Column) -> Column:
    """ids: service ids of the configuration, in order."""
    most = F.when(standard == "cea608", 4).otherwise(63)
    odd = F.transform(
        F.filter(ids, lambda i: (i < 1) | (i > most)),
        lambda i: F.concat(F.lit("Service ID "), i.cast("string"), F.lit(" out of range 1-"), most.cast("string"), F.lit(" for "), standard)
    )
    return F.concat(
        messages((F.size(ids) == 0, "No caption services configured")), odd,
        messages((F.size(F.array_distinct(ids)) != F.size(ids), "Duplicate service IDs found"))
    )


def session_data_problems(index: Column, data_id: Column, value: Column, uri: Column) -> Column:
    at = lambda m: F.concat(F.lit("Entry "), index.cast("string"), F.lit(": " + m))
    return messages(
        (data_id == "", at("DATA-ID is empty")), (value.isNotNull() & uri.isNotNull(), at("VALUE and URI are mutually exclusive")),
        (value.isNull() & uri.isNull(), at("either VALUE or URI must be provided"))
    )


def redundancy_problems(backups: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, problems) of backups (primary, backup_uris): variants without a backup, URIs used twice."""
    rows = backups.withColumn("_m", F.when(F.size("backup_uris") == 0, F.concat(F.lit("Variant '"), "primary", F.lit("' has no backup URIs"))))
    uris = backups.select(
        *keys, F.explode(F.concat(F.array("primary"), F.col("backup_uris"))).alias("u")
    ).groupBy(*keys).agg((F.count("u") != F.countDistinct("u")).alias("_d"))
    g = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("_m")).alias("_l")).join(uris, keys)
    return g.select(
        *keys,
        F.concat(
            "_l",
            F.when(F.col("_d"), F.array(F.lit("Duplicate URIs found across variants and backups"))).otherwise(F.array().cast("array<string>"))
        ).alias("problems")
    )


def pipeline_problem(c: dict[str, Column]) -> Column:
    """The first thing wrong with a live pipeline's settings, in fixed order; null if none is."""
    over = lambda n: F.when(c[n] <= 0, f"{n} must be greater than 0")
    video = lambda n: F.when(c["videoEnabled"] & (c[n] <= 0), f"{n} must be greater than 0 when video is enabled")
    return F.coalesce(
        *map(over, ("segmentDuration", "audioBitrate", "audioSampleRate", "audioChannels")),
        *map(video, ("videoBitrate", "videoWidth", "videoHeight", "videoFrameRate")),
        F.when(c["enableRecording"] & c["recordingDirectory"].isNull(), "recordingDirectory is required when recording is enabled"),
        F.when(c["enableDVR"] & (c["playlistType"] == "event"), "DVR requires slidingWindow playlist type, not event"),
        F.when(c["partTargetDuration"] >= c["segmentDuration"], "lowLatency partTargetDuration must be less than segmentDuration")
    )


def caption_mismatch(attribute: Column, group: Column) -> Column:
    return messages(
        (group.isNotNull() & attribute.isNull(), "Caption config provided but variant has no CLOSED-CAPTIONS attribute"),
        (attribute.isNotNull() & group.isNull(), "Variant has CLOSED-CAPTIONS attribute but no caption config provided"),
        (attribute != group, F.concat(F.lit("CLOSED-CAPTIONS attribute '"), attribute, F.lit("' does not match config groupID '"), group, F.lit("'")))
    )


def hdr_mismatch(video_range: Column, supplemental: Column, expected_range: Column, expected_supplemental: Column) -> Column:
    return messages(
        (video_range != expected_range, F.concat(F.lit("VIDEO-RANGE mismatch: expected "), expected_range, F.lit(", got "), video_range)),
        (video_range.isNull(), F.concat(F.lit("VIDEO-RANGE missing: expected "), expected_range)),
        (expected_supplemental.isNotNull() & supplemental.isNull(), "SUPPLEMENTAL-CODECS missing for Dolby Vision content"),
        (
            supplemental != expected_supplemental,
            F.concat(F.lit("SUPPLEMENTAL-CODECS mismatch: expected "), expected_supplemental, F.lit(", got "), supplemental)
        )
    )
