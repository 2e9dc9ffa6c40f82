"""The library's front: whole texts in, rows, findings and texts out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators import crypto, rules, segmenter
from .sources import manifest, sinks
from .sources.tags import recording


def parse(docs: DataFrame, key: str = "doc_id", text: str = "text") -> dict[str, DataFrame]:
    """Tables of whole texts: kinds, headers, segments, variants, renditions and the rest, by key.

    References to variables that a text defines by value are resolved in the URIs of segments, keys,
    maps, variants, I-frame variants, renditions, session keys and session data; those of parts,
    hints and reports are left as they stand. problems names the texts that are refused, and why.
    """
    scanned = manifest.scan(docs, key, text)
    master, media = (scanned.where(F.col("kind") == k) for k in ("master", "media"))
    own = lambda rows, table, *columns: manifest.resolved(table(rows, key), rows, columns, key)
    return {
        "kinds": manifest.classify(docs, key, text), "problems": manifest.problems(scanned, key),
        "headers": manifest.media_headers(media, key), "segments": own(media, manifest.segments, "uri", "key_tag.uri", "map.uri"),
        "parts": manifest.parts(media, key), "date_ranges": manifest.date_ranges(media, key),
        "preload_hints": manifest.preload_hints(media, key), "rendition_reports": manifest.rendition_reports(media, key),
        "variants": own(master, manifest.variants, "uri"), "renditions": own(master, manifest.renditions, "uri"),
        "iframe_variants": own(master, manifest.iframe_variants, "uri"), "session_data": own(master, manifest.session_data, "uri"),
        "session_keys": own(master, manifest.session_keys, "uri"), "steering": manifest.steering(master, key),
        "definitions": manifest.definitions(scanned, key),
    }


def generate(tables: dict[str, DataFrame], key: str = "doc_id") -> DataFrame:
    """(key, text) of media playlists from their tables."""
    return sinks.media_playlist(tables["headers"].where("error is null"), tables["segments"], key)


def validate(docs: DataFrame, rule_set: str = "all", key: str = "doc_id", text: str = "text") -> DataFrame:
    return rules.validate(docs, rule_set, key, text)


def parse_and_validate(docs: DataFrame, rule_set: str = "all", key: str = "doc_id", text: str = "text") -> tuple[dict[str, DataFrame], DataFrame]:
    return parse(docs, key, text), validate(docs, rule_set, key, text)


def regenerate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Media playlists scanned and written anew: one spelling for all."""
    return generate(parse(docs, key, text), key)


def segment(
    frames: DataFrame, keys: list[str], order: str, duration: str, keyframe: Column | None, target: float = 6.0,
    name: str = "segment_%d.m4s"
) -> tuple[DataFrame, DataFrame]:
    """(segments, playlists) of finished streams: cut at sync samples, VOD playlists with ENDLIST."""
    from .functions.text import file_name

    sync = F.lit(True) if keyframe is None else keyframe
    cut = segmenter.vod_cuts(frames, keys, order, duration, sync, target)
    rows = cut.groupBy(*keys, "segment_index").agg(
        F.count("*").alias("samples"), F.sum(duration).alias("duration"), F.min(order).alias("first_sample")
    )
    rows = rows.withColumn("uri", file_name(F.lit(name), F.col("segment_index"))).withColumn("discontinuity", F.lit(False))
    return rows, recording(rows, keys, "segment_index", True, init="init.mp4")


def segment_files(
    samples: DataFrame, keys: list[str], order: str, duration: str, payload: str, sync: str, target: float = 6.0, container: str = "fmp4",
    timescale: int = 90000
) -> DataFrame:
    """(keys, segment_index, content, samples, ticks): finished streams cut at sync samples, each segment
    written as fragmented MP4 or transport stream."""
    cut = segmenter.vod_cuts(samples, keys, order, duration, F.col(sync), target)
    ready = cut.withColumn("_ticks", F.round(F.col(duration) * timescale).cast("long"))
    return segmenter.vod_files(ready, keys, order, "_ticks", payload, sync, container, timescale)


def encrypt(segments: DataFrame, payload: str, key: Column, sequence: str) -> DataFrame:
    """segments with encrypted payloads, the IV of each from its sequence number."""
    return crypto.encrypt(segments, payload, key, crypto.iv_bytes(F.col(sequence)))


def transform(segments: DataFrame, hook) -> DataFrame:
    """The segment hook: any DataFrame -> DataFrame, as a step of the plan."""
    return hook(segments)
