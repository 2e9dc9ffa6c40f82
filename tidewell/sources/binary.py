"""Binary sources: boxes and sample tables of media files, ADTS frames, NAL units, ID3 and SCTE-35.

A file is one row of binary content.  Structures without a place in SQL are walked in the worker, batch
by batch; what they yield is flat rows, so a tree is (path, parent, depth, offset) rows.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Boxes that hold boxes, and boxes whose payload is left in the file.
CONTAINERS = frozenset("moov trak mdia minf stbl edts dinf mvex moof traf udta meta sinf schi".split())
LEFT = frozenset(("mdat", "free", "skip"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of every file under a path."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def stream_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of every file under a path as a stream: each is read once, when it is there."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(path).select("path", "content")


def rows_of(files: DataFrame, key: str, content: str, schema: str, walk: Callable[[bytes], list[tuple]]) -> DataFrame:
    """(key, *schema): the rows that `walk` finds in each file's bytes; none for null content."""
    made = StructType.fromDDL(schema)
    types = [to_arrow_type(f.dataType) for f in made]
    out = StructType([files.schema[key], *made.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in zip(batch.column(0), batch.column(1), strict=True):
                rows = walk(data.as_py()) if data.is_valid else []
                if rows:
                    columns = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k.as_py()] * len(rows), batch.column(0).type), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                        [f.name for f in out]
                    )

    return files.select(key, content).mapInArrow(run, out)


def boxes(data: bytes) -> list[tuple]:
    """(path, type, depth, parent offset, offset, size, header size, payload) of each box, in file order.

    A size of 1 means that 64 bits follow, 0 the rest of the parent. A box that would pass its parent's
    end ends the walk of that parent."""
    out: list[tuple] = []
    todo: list[tuple[int, int, str, int, int]] = [(0, len(data), "", 0, -1)]
    while todo:
        at, end, path, depth, parent = todo.pop()
        if end - at < 8:
            continue
        size, kind = struct.unpack_from(">I4s", data, at)
        name, head = kind.decode("latin-1"), 8
        if size == 1 and end - at >= 16:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            continue
        here = f"{path}/{name}"
        todo.append((at + size, end, path, depth, parent))
        out.append((here, name, depth, parent, at, size, head, None if name in LEFT or name in CONTAINERS else data[at + head : at + size]))
        if name in CONTAINERS:
            todo.append((at + head + (4 if name == "meta" else 0), at + size, here, depth + 1, at))
    return out


BOX = "path string, type string, depth int, parent long, offset long, size long, header int, payload binary"


def box_tree(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, box_path, type, ...) of every box of every file."""
    return rows_of(files, key, content, BOX.replace("path string", "box_path string"), boxes)


def _table(payload: bytes, fields: str, skip: int = 4) -> list[tuple]:
    """Rows of a full box that has a 32-bit count and then fixed records."""
    n = struct.unpack_from(">I", payload, skip)[0]
    size = struct.calcsize(">" + fields)
    return list(struct.iter_unpack(">" + fields, payload[skip + 4 : skip + 4 + n * size]))


def sample_table(found: dict[str, bytes]) -> tuple | None:
    """(stts, ctts, stsc, sizes, uniform size, chunk offsets, sync samples) of one stbl, or None if a
    mandatory box is missing. 32-bit chunk offsets win over 64-bit ones; ctts offsets are signed."""
    if not {"stts", "stsc", "stsz"} <= set(found) or not {"stco", "co64"} & set(found):
        return None
    pairs = lambda kind, f: [{"count": a, "value": b} for a, b in _table(found[kind], f)]
    uniform = struct.unpack_from(">I", found["stsz"], 4)[0]
    sizes = [] if uniform else [x[0] for x in _table(found["stsz"], "I", 8)]
    count = struct.unpack_from(">I", found["stsz"], 8)[0]
    offsets = [x[0] for x in (_table(found["stco"], "I") if "stco" in found else _table(found["co64"], "Q"))]
    return (
        pairs("stts", "II"), pairs("ctts", "Ii") if "ctts" in found else [],
        [{"first_chunk": a, "per_chunk": b} for a, b, _ in _table(found["stsc"], "III")], sizes, uniform, count, offsets,
        [x[0] for x in _table(found["stss"], "I")] if "stss" in found else None
    )


TRACK = "track int, handler string, timescale long, duration long, language string, stts array<struct<count:long,value:long>>, ctts array<struct<count:long,value:long>>, stsc array<struct<first_chunk:long,per_chunk:long>>, sizes array<long>, uniform_size long, sample_count long, chunk_offsets array<long>, sync array<long>, error string"


def tracks(data: bytes) -> list[tuple]:
    """One row per trak: handler, timescale, duration, language and sample table."""
    out: list[tuple] = []
    tree = boxes(data)
    for kind in (b for b in tree if b[0] == "/moov/trak"):
        inside = {b[1]: b[7] for b in reversed(tree) if b[4] > kind[4] and b[4] < kind[4] + kind[5] and b[7] is not None}
        mdhd = inside.get("mdhd", b"")
        scale = length = None
        language = None
        if len(mdhd) >= 22:
            wide = mdhd[0] == 1
            scale, length = struct.unpack_from(">IQ" if wide else ">II", mdhd, 20 if wide else 12)
            code = struct.unpack_from(">H", mdhd, 32 if wide else 20)[0]
            language = "".join(chr((code >> s & 31) + 96) for s in (10, 5, 0))
        handler = inside["hdlr"][8:12].decode("latin-1") if len(inside.get("hdlr", b"")) >= 12 else None
        table = sample_table(inside)
        out.append((len(out), handler, scale, length, language, *(table or ([], [], [], [], 0, 0, [], None)), None if table else "missingBox"))
    return out


def track_table(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    return rows_of(files, key, content, TRACK, tracks)


#: Sample rates by ADTS index.
ADTS_RATES = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)
ADTS = "offset long, length int, header int, profile int, sample_rate int, channels int"


def adts_frames(data: bytes) -> list[tuple]:
    """Frames of a raw AAC stream; damage is skipped a byte at a time, a cut last frame is left."""
    out, at = [], 0
    while at + 7 <= len(data):
        if data[at] != 0xFF or data[at + 1] & 0xF6 != 0xF0:
            at += 1
            continue
        head = 7 if data[at + 1] & 1 else 9
        rate, length = data[at + 2] >> 2 & 15, (data[at + 3] & 3) << 11 | data[at + 4] << 3 | data[at + 5] >> 5
        if rate >= len(ADTS_RATES) or length < head:
            at += 1
            continue
        if at + length > len(data):
            break
        out.append((at, length, head, (data[at + 2] >> 6) + 1, ADTS_RATES[rate], (data[at + 2] & 1) << 2 | data[at + 3] >> 6))
        at += length
    return out


def adts_header(profile: int, rate: int, channels: int, payload: int) -> bytes:
    """The 7-byte header of a frame of `payload` bytes."""
    n, r = payload + 7, ADTS_RATES.index(rate)
    return bytes([0xFF, 0xF1, (profile - 1) << 6 | r << 2 | channels >> 2, (channels & 3) << 6 | n >> 11, n >> 3 & 255, (n & 7) << 5 | 0x1F, 0xFC])


def adts_table(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    return rows_of(files, key, content, ADTS, adts_frames)


NAL = "position int, offset long, nal_type int, unit binary"


def nal_units(data: bytes, hevc: bool = False) -> list[tuple]:
    """Units between 3- or 4-byte start codes; trailing zeros belong to the next start code."""
    starts, at = [], 0
    while (at := data.find(b"\0\0\1", at)) >= 0:
        starts.append(at)
        at += 3
    out = []
    for i, s in enumerate(starts):
        end = starts[i + 1] if i + 1 < len(starts) else len(data)
        unit = data[s + 3 : end]
        if i + 1 < len(starts) and unit.endswith(b"\0"):
            unit = unit[:-1]
        if unit:
            out.append((len(out), s + 3, unit[0] >> 1 & 63 if hevc else unit[0] & 31, unit))
    return out


def nal_table(files: DataFrame, hevc: bool = False, key: str = "path", content: str = "content") -> DataFrame:
    return rows_of(files, key, content, NAL, lambda d: nal_units(d, hevc))


def access_units(nals: DataFrame, codec: str, key: str = "path") -> DataFrame:
    """(key, access_unit, nals, keyframe): a picture NAL closes a unit with what stands before it; what
    follows the last one is left."""
    from pyspark.sql.window import Window

    from ..functions import media as M

    vcl, w = M.is_vcl(F.lit(codec), F.col("nal_type")), Window.partitionBy(key).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    r = nals.withColumn("_v", vcl).withColumn("access_unit", F.coalesce(F.count_if("_v").over(w), F.lit(0)))
    return r.groupBy(key, "access_unit").agg(
        F.count("*").alias("nals"), F.bool_or("_v").alias("_v"),
        F.bool_or(M.is_keyframe(F.lit(codec), F.col("nal_type"))).alias("keyframe")
    ).where("_v").drop("_v")


def protected_pieces(data: bytes, kind: str) -> list[tuple]:
    """(position, piece, protected): the whole stream in order, cut where sample encryption begins and ends."""
    regions, at = [], 0
    if kind == "video":
        starts = []
        while (at := data.find(b"\0\0\0\1", at)) >= 0:
            starts.append(at)
            at += 4
        for s, end in zip(starts, [*starts[1:], len(data)], strict=False):
            if s + 4 < len(data) and data[s + 4] & 31 in (1, 5) and end - (s + 5) > 48:
                regions.append((s + 5 + 32, end))
    else:
        while at < len(data) - 7:
            if data[at] != 0xFF or data[at + 1] & 0xF0 != 0xF0:
                at += 1
                continue
            n = (data[at + 3] & 3) << 11 | data[at + 4] << 3 | data[at + 5] >> 5
            if n <= 0 or at + n > len(data):
                break
            regions.append((at + 7 + 16, at + n))
            at += n
    out, done = [], 0
    for begin, end in regions:
        end = begin + max(0, end - begin) // 16 * 16
        if end > begin:
            out += [(len(out), data[done:begin], False), (len(out) + 1, data[begin:end], True)]
            done = end
    return [*out, (len(out), data[done:], False)]


def fragment_samples(data: bytes) -> list[tuple]:
    """(sequence, track, sample, time, duration, offset, sync, payload) of a fragmented file's runs, as
    media_segment() and muxed_segment() write them."""
    out: list[tuple] = []
    tree = boxes(data)
    for moof in (b for b in tree if b[0] == "/moof"):
        inside = [b for b in tree if moof[4] < b[4] < moof[4] + moof[5]]
        sequence = next(struct.unpack_from(">I", b[7], 4)[0] for b in inside if b[1] == "mfhd")
        for traf in (b for b in inside if b[1] == "traf"):
            own = {b[1]: b[7] for b in inside if b[3] == traf[4]}
            track, time = struct.unpack_from(">I", own["tfhd"], 4)[0], struct.unpack_from(">Q", own["tfdt"], 4)[0]
            n, at = struct.unpack_from(">Ii", own["trun"], 4)
            at += moof[4]
            for i in range(n):
                length, size, flags, offset = struct.unpack_from(">IIIi", own["trun"], 12 + 16 * i)
                out.append((sequence, track, i, time, length, offset, not flags & 0x10000, data[at : at + size]))
                at, time = at + size, time + length
    return out


FRAGMENT = "sequence long, track long, sample int, time long, duration long, composition long, sync boolean, payload binary"


def fragment_table(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    return rows_of(files, key, content, FRAGMENT, fragment_samples)


def to_annex_b(data: bytes) -> bytes:
    """Length-prefixed units to start codes."""
    out, at = bytearray(), 0
    while at + 4 <= len(data):
        n = struct.unpack_from(">I", data, at)[0]
        out += b"\0\0\0\1" + data[at + 4 : at + 4 + n]
        at += 4 + n
    return bytes(out)


def to_length_prefixed(data: bytes) -> bytes:
    return b"".join(struct.pack(">I", len(u[3])) + u[3] for u in nal_units(data))


def crc32_mpeg(data: bytes) -> int:
    """Polynomial 04C11DB7, most significant bit first, start and no end of all ones."""
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


ID3 = "frame_id string, text string, size int"


def id3_frames(data: bytes) -> list[tuple]:
    """Frames of an ID3v2.4 tag; text frames decoded."""
    if len(data) < 10 or data[:3] != b"ID3":
        return []
    synch = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    end, at, out = min(len(data), 10 + synch(data[6:10])), 10, []
    while at + 10 <= end and data[at]:
        kind, n = data[at : at + 4].decode("latin-1"), synch(data[at + 4 : at + 8])
        body = data[at + 10 : at + 10 + n]
        text = None
        if kind.startswith("T") and body:
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "utf-8"), "replace").rstrip("\0")
        out.append((kind, text, n))
        at += 10 + n
    return out


def id3_tag(frames: list[tuple[str, str]]) -> bytes:
    """An ID3v2.4 tag of UTF-8 text frames."""
    synch = lambda n: bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])
    body = b"".join(k.encode() + synch(len(t.encode()) + 2) + b"\0\0" + b"\3" + t.encode() + b"\0" for k, t in frames)
    return b"ID3\4\0\0" + synch(len(body)) + body


SCTE = "command string, event_id long, out_of_network boolean, pts long, duration_ticks long, immediate boolean"


def splice_info(data: bytes) -> list[tuple]:
    """The splice command of a SCTE-35 section: null, insert or time_signal; nothing if malformed."""
    if len(data) < 14 or data[0] != 0xFC:
        return []
    kind, body = data[13], data[14:]

    def time_at(at: int) -> tuple[int | None, int]:
        if body[at] & 0x80:
            return (body[at] & 1) << 32 | struct.unpack_from(">I", body, at + 1)[0], at + 5
        return None, at + 1

    try:
        if kind == 0:
            return [("splice_null", None, None, None, None, None)]
        if kind == 6:
            return [("time_signal", None, None, time_at(0)[0], None, None)]
        if kind == 5:
            event, cancelled = struct.unpack_from(">IB", body)
            if cancelled & 0x80:
                return [("splice_insert", event, None, None, None, None)]
            flags, at, when, length = body[5], 6, None, None
            if flags & 0x40 and not flags & 0x10:
                when, at = time_at(at)
            if flags & 0x20:
                length = (body[at] & 1) << 32 | struct.unpack_from(">I", body, at + 1)[0]
            return [("splice_insert", event, bool(flags & 0x80), when, length, bool(flags & 0x10))]
    except (IndexError, struct.error):
        return []
    return []


def splice_info_of(rows: DataFrame, key: str, digits: str) -> DataFrame:
    """(key, command, splice_id, ...) of sections in hex, with or without 0x; none for what is no section."""
    raw = rows.select(key, F.unhex(F.regexp_replace(digits, "^0[xX]", "")).alias("_b"))
    return rows_of(raw, key, "_b", SCTE.replace("event_id", "splice_id"), splice_info)


def box(kind: str, *parts: bytes) -> bytes:
    """A box around its parts."""
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind.encode("latin-1")) + body


def full_box(kind: str, version: int, flags: int, *parts: bytes) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def muxed_segment(sequence: int, tracks: list[tuple[int, int, list[tuple[int, int, bool, bytes]]]], styp: bool = True) -> bytes:
    """styp, moof and mdat of a run of samples for each track: (track, base time, samples); a sample is
    (duration, composition offset, sync, payload)."""
    flags = lambda sync: 0x02000000 if sync else 0x01010000

    def moof(first: int) -> bytes:
        trafs, at = [], first
        for track, base_time, samples in tracks:
            run = b"".join(struct.pack(">IIIi", d, len(p), flags(s), c) for d, c, s, p in samples)
            trafs.append(
                box(
                    "traf", full_box("tfhd", 0, 0x020000, struct.pack(">I", track)), full_box("tfdt", 1, 0, struct.pack(">Q", base_time)),
                    full_box("trun", 1, 0x000F01, struct.pack(">Ii", len(samples), at), run)
                )
            )
            at += sum(len(p) for *_, p in samples)
        return box("moof", full_box("mfhd", 0, 0, struct.pack(">I", sequence)), *trafs)

    head = moof(len(moof(0)) + 8)
    start = box("styp", b"msdh", struct.pack(">I", 0), b"msdhmsix") if styp else b""
    return start + head + box("mdat", *(p for *_, samples in tracks for *_, p in samples))


def media_segment(sequence: int, track: int, base_time: int, samples: list[tuple[int, int, bool, bytes]], styp: bool = True) -> bytes:
    """styp, moof and mdat of one run of samples: (duration, composition offset, sync, payload)."""
    return muxed_segment(sequence, [(track, base_time, samples)], styp)
