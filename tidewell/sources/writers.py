"""Binary sinks: init segments, events, protection headers, splice sections."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .binary import box, full_box

#: Unity matrix of movie and track headers.
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
#: Handler, media header and sample entry kinds by track kind.
HANDLERS = {"video": b"vide", "audio": b"soun", "text": b"subt"}


def descriptor(tag: int, body: bytes) -> bytes:
    return bytes([tag, len(body)]) + body


def audio_config(profile: int, rate: int, channels: int) -> bytes:
    """AudioSpecificConfig of AAC."""
    from .binary import ADTS_RATES

    r = ADTS_RATES.index(rate)
    return bytes([profile << 3 | r >> 1, (r & 1) << 7 | channels << 3])


def sample_entry(kind: str, codec: str = "", width: int = 0, height: int = 0, rate: int = 48000, channels: int = 2, config: bytes = b"") -> bytes:
    """avc1 with avcC, hvc1 with hvcC, mp4a with esds, or stpp for text."""
    start = b"\0" * 6 + struct.pack(">H", 1)
    if kind == "video":
        name, conf = ("hvc1", "hvcC") if codec == "h265" else ("avc1", "avcC")
        return box(
            name, start, b"\0" * 16, struct.pack(">HHIIIH", width, height, 0x480000, 0x480000, 0, 1), b"\0" * 32,
            struct.pack(">Hh", 24, -1), box(conf, config)
        )
    if kind == "audio":
        dec = descriptor(4, b"\x40\x15" + b"\0" * 11 + descriptor(5, config or audio_config(2, rate, channels)))
        return box(
            "mp4a", start, b"\0" * 8, struct.pack(">HHHHI", channels, 16, 0, 0, rate << 16),
            full_box("esds", 0, 0, descriptor(3, b"\0\0\0" + dec + descriptor(6, b"\2")))
        )
    return box("stpp", start, b"http://www.w3.org/ns/ttml\0\0\0")


def sample_tables(
    durations: list[int], sizes: list[int], chunks: list[tuple[int, int]], offsets: list[int] | None = None, sync: list[int] | None = None,
    wide: bool = False
) -> list[bytes]:
    """stts, stsc, stsz, stco (or co64 if wide), and ctts and stss if given. chunks: (offset, samples) of each;
    sync: sample numbers from 1. Runs of equal values are written once, sizes that are all alike as one."""
    def runs(values: list[int]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for v in values:
            out = [*out[:-1], (out[-1][0] + 1, v)] if out and out[-1][1] == v else [*out, (1, v)]
        return out

    table = lambda name, rows, fields, version=0: full_box(
        name, version, 0, struct.pack(">I", len(rows)), *(struct.pack(f">{fields}", *r) for r in rows)
    )
    firsts = [(i + 1, n, 1) for i, (_, n) in enumerate(chunks) if i == 0 or chunks[i - 1][1] != n]
    alike = len(set(sizes)) == 1
    stsz = full_box("stsz", 0, 0, struct.pack(">II", sizes[0] if alike else 0, len(sizes)), b"" if alike else struct.pack(f">{len(sizes)}I", *sizes))
    out = [
        table("stts", runs(durations), "II"), table("stsc", firsts, "III"), stsz,
        table("co64" if wide else "stco", [(at,) for at, _ in chunks], "Q" if wide else "I")
    ]
    if offsets is not None:
        out.append(table("ctts", runs(offsets), "Ii", 1))
    if sync is not None:
        out.append(table("stss", [(s,) for s in sync], "I"))
    return out


def movie(handler: str, timescale: int, language: str, tables: list[bytes], duration: int = 0, payload: bytes = b"") -> bytes:
    """A file of one track: ftyp, moov with the given sample tables, mdat."""
    letters = [ord(c) - 96 for c in language]
    mdhd = full_box("mdhd", 0, 0, struct.pack(">IIIIHH", 0, 0, timescale, duration, letters[0] << 10 | letters[1] << 5 | letters[2], 0))
    hdlr = full_box("hdlr", 0, 0, b"\0" * 4, handler.encode(), b"\0" * 12, b"main\0")
    track = box("trak", box("mdia", mdhd, hdlr, box("minf", box("stbl", *tables))))
    return box("ftyp", b"isom", struct.pack(">I", 0)) + box("moov", track) + box("mdat", payload)


def init_segment(tracks: list[dict], timescale: int = 1000) -> bytes:
    """ftyp and moov of tracks (id, kind, timescale, language and what sample_entry takes); for fMP4, CMAF
    audio and video, and IMSC1 text."""
    ftyp = box("ftyp", b"iso6", struct.pack(">I", 0), b"iso6cmfcmp41")
    mvhd = full_box(
        "mvhd", 0, 0, struct.pack(">IIIIIH", 0, 0, timescale, 0, 0x10000, 0x100), b"\0" * 10, MATRIX, b"\0" * 24,
        struct.pack(">I", max(t["id"] for t in tracks) + 1)
    )
    traks, extends = [], []
    for t in tracks:
        kind = t["kind"]
        own = {k: v for k, v in t.items() if k not in ("id", "timescale", "language")}
        letters = [ord(c) - 96 for c in t.get("language", "und")]
        tkhd = full_box(
            "tkhd", 0, 3, struct.pack(">IIII", 0, 0, t["id"], 0), b"\0" * 12,
            struct.pack(">hhHH", 0, 0, 0x100 if kind == "audio" else 0, 0), MATRIX,
            struct.pack(">II", t.get("width", 0) << 16, t.get("height", 0) << 16)
        )
        mdhd = full_box("mdhd", 0, 0, struct.pack(">IIIIHH", 0, 0, t["timescale"], 0, letters[0] << 10 | letters[1] << 5 | letters[2], 0))
        hdlr = full_box("hdlr", 0, 0, b"\0" * 4, HANDLERS[kind], b"\0" * 12, b"main\0")
        head = {"video": full_box("vmhd", 0, 1, b"\0" * 8), "audio": full_box("smhd", 0, 0, b"\0" * 4), "text": full_box("sthd", 0, 0)}[kind]
        dinf = box("dinf", full_box("dref", 0, 0, struct.pack(">I", 1), full_box("url ", 0, 1)))
        empty = [full_box(n, 0, 0, b"\0" * k) for n, k in (("stts", 4), ("stsc", 4), ("stsz", 8), ("stco", 4))]
        stbl = box("stbl", full_box("stsd", 0, 0, struct.pack(">I", 1), sample_entry(**own)), *empty)
        traks.append(box("trak", tkhd, box("mdia", mdhd, hdlr, box("minf", head, dinf, stbl))))
        extends.append(full_box("trex", 0, 0, struct.pack(">IIIII", t["id"], 1, 0, 0, 0)))
    return ftyp + box("moov", mvhd, *traks, box("mvex", *extends))


def emsg(scheme: str, value: str, timescale: int, time: int, duration: int, event_id: int, data: bytes) -> bytes:
    """Version 1: the time is absolute."""
    return full_box("emsg", 1, 0, struct.pack(">IQII", timescale, time, duration, event_id), scheme.encode() + b"\0" + value.encode() + b"\0", data)


def pssh(system_id: str, data: bytes) -> bytes:
    return full_box("pssh", 0, 0, bytes.fromhex(system_id.replace("-", "")), struct.pack(">I", len(data)), data)


def pssh_hex(system_id: Column, data: Column) -> Column:
    """The hex digits of pssh() of a column, without leaving the JVM."""
    n = F.octet_length(data)
    word = lambda c: F.lpad(F.lower(F.hex(c.cast("long"))), 8, "0")
    return F.concat(word(n + 32), F.lit("7073736800000000"), F.replace(system_id, F.lit("-"), F.lit("")), word(n), F.lower(F.hex(data)))


def splice_section(command: str, event_id: int = 0, out_of_network: bool = False, pts: int | None = None, duration: int | None = None) -> bytes:
    """A SCTE-35 section; its checksum is left as all ones, as specified."""
    stamp = lambda t: struct.pack(">BI", 0xFE | t >> 32 & 1, t & 0xFFFFFFFF)
    if command == "splice_insert":
        kind, flags = 5, 0x80 * out_of_network | 0x40 | 0x20 * (duration is not None) | 0x10 * (pts is None) | 0x0F
        body = struct.pack(">IBB", event_id, 0, flags) + (stamp(pts) if pts is not None else b"") + (
            stamp(duration) if duration is not None else b""
        ) + struct.pack(">HBB", 0, 0, 0)
    elif command == "time_signal":
        kind, body = 6, stamp(pts) if pts is not None else b"\x7e"
    else:
        kind, body = 0, b""
    head = struct.pack(">BHBIBBHB", 0xFC, 0x3000 | (11 + len(body) + 4), 0, 0, 0, 0, 0xFFF0 | len(body) >> 8, len(body) & 0xFF)
    return head + bytes([kind]) + body + struct.pack(">HI", 0, 0xFFFFFFFF)


def written(rows: DataFrame, columns: list[str], make: Callable[..., bytes | None], name: str = "content") -> DataFrame:
    """rows with the bytes that `make` writes from their columns: a file, section or frame a row."""
    schema = StructType([*rows.schema.fields, StructField(name, BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = zip(*(batch.column(c).to_pylist() for c in columns), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([make(*v) for v in values], pa.binary())], [f.name for f in schema])

    return rows.mapInArrow(run, schema)


def splice_sections(rows: DataFrame, event: str, out: str, pts: str, duration: str) -> DataFrame:
    """rows with `section`: a splice_insert of each."""
    return written(rows, [event, out, pts, duration], lambda e, o, p, d: splice_section("splice_insert", e, o, p, d), "section")


def bits(data: bytes):
    """A reader of bits and exp-Golomb codes."""
    at = 0

    def read(n: int) -> int:
        nonlocal at
        v = 0
        for _ in range(n):
            v = v << 1 | (data[at >> 3] >> (7 - (at & 7)) & 1 if at >> 3 < len(data) else 0)
            at += 1
        return v

    def golomb() -> int:
        zeros = 0
        while zeros < 32 and not read(1):
            zeros += 1
        return (1 << zeros) - 1 + read(zeros)

    return read, golomb


def hevc_profile(sps: bytes) -> dict[str, int] | None:
    """Profile, tier, level, chroma format and size of an HEVC sequence parameter set (with its NAL header)."""
    raw = sps.replace(b"\0\0\3", b"\0\0")
    if len(raw) < 16:
        return None
    read, golomb = bits(raw[2:])
    read(4)
    layers = read(3)
    read(1)
    out = {"profile_space": read(2), "tier": read(1), "profile": read(5), "compatibility": read(32)}
    read(48)
    out["level"] = read(8)
    here = [(read(1), read(1)) for _ in range(layers)]
    if layers:
        read(2 * (8 - layers))
    for profile, level in here:
        read(88 * profile + 8 * level)
    golomb()
    out["chroma"] = golomb()
    if out["chroma"] == 3:
        read(1)
    out["width"], out["height"] = golomb(), golomb()
    return out
