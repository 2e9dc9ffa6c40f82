"""MPEG transport streams: 188-byte packets with tables and elementary data, written and read."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame

from .binary import crc32_mpeg, rows_of

#: Packet ids, stream types and stream ids of the streams written here.
PAT, PMT, VIDEO, AUDIO = 0, 0x1000, 0x100, 0x101
STREAMS = {VIDEO: (0x1B, 0xE0), AUDIO: (0x0F, 0xC0)}


class Writer:
    """Packets with a continuity counter per packet id, modulo 16."""

    def __init__(self):
        self.counters: dict[int, int] = {}

    def packets(self, pid: int, data: bytes, pcr: int | None = None, random_access: bool = False) -> bytes:
        out, at = bytearray(), 0
        while at < len(data):
            count = self.counters.get(pid, 0)
            self.counters[pid] = (count + 1) & 15
            first = at == 0
            field = b""
            if first and (pcr is not None or random_access):
                flags = 0x40 * random_access | 0x10 * (pcr is not None)
                field = bytes([flags]) + (struct.pack(">IH", pcr >> 1, (pcr & 1) << 15 | 0x7E00) if pcr is not None else b"")
            room = 184 - (len(field) + 1 if field else 0)
            part = data[at : at + room]
            pad = room - len(part)
            if field or pad:
                if not field and pad == 1:
                    head = b"\0"
                else:
                    body = field or b"\0"
                    pad_now = 184 - 1 - len(body) - len(part)
                    head = bytes([len(body) + pad_now]) + body + b"\xff" * pad_now
                control = 0x30
            else:
                head, control = b"", 0x10
            out += struct.pack(">BHB", 0x47, 0x4000 * first | pid, control | count) + head + part
            at += len(part)
        return bytes(out)

    def section(self, pid: int, body: bytes) -> bytes:
        return self.packets(pid, (b"\0" + body + struct.pack(">I", crc32_mpeg(body))).ljust(184, b"\xff"))

    def tables(self, pids: list[int]) -> bytes:
        pat = struct.pack(">BHHBBBHH", 0, 0xB000 | 13, 1, 0xC1, 0, 0, 1, 0xE000 | PMT)
        streams = b"".join(struct.pack(">BHH", STREAMS[p][0], 0xE000 | p, 0xF000) for p in pids)
        pmt = struct.pack(">BHHBBBHH", 2, 0xB000 | (13 + len(streams)), 1, 0xC1, 0, 0, 0xE000 | pids[0], 0xF000) + streams
        return self.section(PAT, pat) + self.section(PMT, pmt)

    def frame(self, pid: int, payload: bytes, pts: int, dts: int | None = None, keyframe: bool = False) -> bytes:
        stamp = lambda mark, t: struct.pack(">BHH", mark << 4 | t >> 29 & 14 | 1, (t >> 14 & 0xFFFE) | 1, (t << 1 & 0xFFFE) | 1)
        times = stamp(3, pts) + stamp(1, dts) if dts is not None and dts != pts else stamp(2, pts)
        size = 3 + len(times) + len(payload)
        head = struct.pack(
            ">IHBBB", 0x100 | STREAMS[pid][1], size if pid == AUDIO and size < 65536 else 0, 0x80, 0xC0 if len(times) == 10 else 0x80,
            len(times)
        )
        return self.packets(pid, head + times + payload, dts if dts is not None else pts, keyframe)


def segment(frames: list[tuple[int, int, int | None, bool, bytes]]) -> bytes:
    """A segment: tables, then frames (packet id, pts, dts, keyframe, payload)."""
    w = Writer()
    return w.tables(sorted({f[0] for f in frames})) + b"".join(w.frame(pid, data, pts, dts, key) for pid, pts, dts, key, data in frames)


UNIT = "pid int, position int, pts long, dts long, continuous boolean, payload binary"


def units(data: bytes) -> list[tuple]:
    """(pid, position, pts, dts, continuous, payload) of each elementary unit; bytes out of step are skipped."""
    held: dict[int, bytearray] = {}
    last: dict[int, int] = {}
    whole: dict[int, bool] = {}
    out: list[tuple] = []

    def time_at(b: bytes, at: int) -> int:
        return (b[at] >> 1 & 7) << 30 | b[at + 1] << 22 | b[at + 2] >> 1 << 15 | b[at + 3] << 7 | b[at + 4] >> 1

    def close(pid: int) -> None:
        pes = bytes(held.pop(pid, b""))
        if len(pes) >= 9 and pes[:3] == b"\0\0\1":
            flags, size = pes[7] >> 6, pes[8]
            out.append(
                (
                    pid, len(out), time_at(pes, 9) if flags & 2 else None, time_at(pes, 14) if flags == 3 else None, whole.get(pid, True),
                    pes[9 + size :]
                )
            )

    at = 0
    while at + 188 <= len(data):
        if data[at] != 0x47:
            at += 1
            continue
        _, word, control = struct.unpack_from(">BHB", data, at)
        pid, start = word & 0x1FFF, bool(word & 0x4000)
        body = at + 4 + (1 + data[at + 4] if control & 0x20 else 0)
        if start and pid in held:
            close(pid)
        if pid not in (PAT, PMT):
            if start:
                held[pid], whole[pid] = bytearray(), True
            if pid in held and control & 0x10:
                if pid in last and (last[pid] + 1) & 15 != control & 15:
                    whole[pid] = False
                held[pid] += data[body : at + 188]
            last[pid] = control & 15
        at += 188
    for pid in list(held):
        close(pid)
    return out


def unit_table(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    return rows_of(files, key, content, UNIT, units)
