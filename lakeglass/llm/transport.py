"""Operator 6: MPEG transport streams in a binary column.

Parsing (``units``), a stream a row: find the sync byte and find it again after garbage; assemble the program association
and program map tables and check their CRC; for each elementary stream check continuity counters (a repeated packet is
legal once, adaptation-only packets don't count, a discontinuity flag allows a jump), reassemble PES packets, unwrap 33-bit time stamps and
note random-access points. One row a PES packet: (doc_id, pid, stream_type, unit, pts, dts, random_access, lost, data).
lost counts the gaps of the counter, packets with the error flag and missing bytes noted while the unit was open; data of such a unit are what was there.
``programs`` returns the tables and counts of each stream instead.

No table of the data set has media. ``muxed`` makes streams from documents, two elementary streams each, and breaks some of
them by a rule of their doc_id: a lost packet, a repeated packet, garbage between packets, a flagged jump.

Defined results: a null or empty stream, or one without program tables, gives no unit. Units begun before the tables are known
are not seen. A gap before a stream's first unit belongs to no unit. Repeated rows and null doc_ids are streams of their own. Time stamps
that a unit doesn't have are null. Other columns are ignored. Bytes after the last whole packet are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, SYNC, NULL_PID = 188, 0x47, 0x1FFF
WRAP = 1 << 33


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


CRC_TABLE = _crc_table()


@lru_cache(4096)
def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ CRC_TABLE[(c >> 24) ^ b]
    return c


def packets(raw: bytes) -> Iterator[int]:
    """Places of the packets. After a byte that isn't in sync, the next place from which two more packets or the end follow."""
    at, end = 0, len(raw) - SIZE
    while at <= end:
        if raw[at] == SYNC:
            yield at
            at += SIZE
            continue
        while at <= end and not all(p >= len(raw) or raw[p] == SYNC for p in (at, at + SIZE, at + 2 * SIZE)):
            at = raw.find(b"\x47", at + 1)
            if at < 0:
                return


def stamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def table_of(section: bytes) -> tuple[int, bytes] | None:
    """(table id, body) of a whole section with a right CRC."""
    if len(section) < 12 or crc32_mpeg(section) != 0:
        return None
    return section[0], section[8:-4]


class Stream:
    def __init__(self, pid: int, kind: int):
        self.pid, self.kind, self.counter, self.last, self.twice = pid, kind, None, b"", False
        self.data: list[bytes] | None = None
        self.random = False
        self.lost = self.count = self.packets = self.gaps = self.repeats = 0
        self.times: dict[str, int] = {}


class Demuxer:
    def __init__(self) -> None:
        self.maps: dict[int, int] = {}
        self.streams: dict[int, Stream] = {}
        self.sections: dict[int, bytearray] = {}
        self.bad_tables = 0
        self.out: list[tuple] = []

    def section(self, pid: int, start: bool, payload: bytes) -> None:
        if start:
            skip = payload[0] + 1 if payload else 1
            if pid in self.sections:
                self.sections[pid] += payload[1:skip]
                self._close(pid)
            self.sections[pid] = bytearray(payload[skip:])
        elif pid in self.sections:
            self.sections[pid] += payload
        self._close(pid)

    def _close(self, pid: int) -> None:
        held = self.sections.get(pid)
        while held is not None and len(held) >= 3 and held[0] != 0xFF:
            size = 3 + ((held[1] & 15) << 8 | held[2])
            if len(held) < size:
                return
            self._table(bytes(held[:size]), pid)
            del held[:size]
        if held is not None and (not held or held[0] == 0xFF):
            self.sections.pop(pid, None)

    def _table(self, section: bytes, pid: int) -> None:
        t = table_of(section)
        if t is None:
            self.bad_tables += 1
        elif t[0] == 0 and pid == 0:
            for k in range(0, len(t[1]) - 3, 4):
                program, at = t[1][k] << 8 | t[1][k + 1], (t[1][k + 2] & 31) << 8 | t[1][k + 3]
                if program:
                    self.maps[at] = program
        elif t[0] == 2:
            body = t[1]
            k = 4 + ((body[2] & 15) << 8 | body[3])
            while k + 5 <= len(body):
                pid = (body[k + 1] & 31) << 8 | body[k + 2]
                if pid not in self.streams:
                    self.streams[pid] = Stream(pid, body[k])
                k += 5 + ((body[k + 3] & 15) << 8 | body[k + 4])

    def finish(self, s: Stream) -> None:
        if s.data is None:
            return
        raw = b"".join(s.data)
        s.data = None
        if len(raw) < 9 or raw[:3] != b"\0\0\1":
            s.lost = 0
            return
        size = raw[4] << 8 | raw[5]
        found: dict[str, int | None] = {"pts": None, "dts": None}
        if raw[7] & 0x80 and len(raw) >= 14:
            found["pts"] = stamp(raw[9:14])
            if raw[7] & 0x40 and len(raw) >= 19:
                found["dts"] = stamp(raw[14:19])
        for k, v in found.items():
            if v is not None:
                if (before := s.times.get(k)) is not None:
                    v += (before - v + WRAP // 2) // WRAP * WRAP
                s.times[k] = found[k] = v
        body = raw[9 + raw[8] :]
        if size:
            want = size - 3 - raw[8]
            s.lost += not s.lost and len(body) < want
            body = body[: max(0, want)]
        self.out.append((s.pid, s.kind, s.count, found["pts"], found["dts"], s.random, int(s.lost), body))
        s.count += 1
        s.lost = 0

    def feed(self, raw: bytes) -> None:
        for at in packets(raw):
            a, b, c = raw[at + 1], raw[at + 2], raw[at + 3]
            pid = (a & 31) << 8 | b
            if pid == NULL_PID:
                continue
            begin, jump, random = at + 4, False, False
            if c & 0x20:
                if raw[begin]:
                    jump, random = bool(raw[begin + 1] & 0x80), bool(raw[begin + 1] & 0x40)
                begin += 1 + raw[begin]
            s = self.streams.get(pid)
            if s is None:
                if (pid == 0 or pid in self.maps) and c & 0x10 and not a & 0x80 and begin < at + SIZE:
                    self.section(pid, bool(a & 0x40), raw[begin : at + SIZE])
                continue
            s.packets += 1
            if a & 0x80:
                s.gaps += 1
                s.lost += s.data is not None
                s.counter = None
                continue
            counter, packet = c & 15, raw[at : at + SIZE]
            if c & 0x10:
                if s.counter is not None and not jump:
                    if counter == s.counter and packet == s.last and not s.twice:
                        s.twice = True
                        s.repeats += 1
                        continue
                    if counter != (s.counter + 1) & 15:
                        s.gaps += 1
                        s.lost += s.data is not None
                s.counter, s.last, s.twice = counter, packet, False
                if a & 0x40:
                    self.finish(s)
                    s.data, s.random = [], random
                if s.data is not None:
                    s.data.append(raw[begin : at + SIZE])
            elif jump:
                s.counter = None

    def end(self) -> list[tuple]:
        for s in self.streams.values():
            self.finish(s)
        self.out.sort(key=lambda r: (r[0], r[2]))
        return self.out


UNIT = "doc_id long, pid int, stream_type int, unit int, pts long, dts long, random_access boolean, lost int, data binary"
PROGRAM = "doc_id long, program int, pid int, stream_type int, packets int, gaps int, repeats int, units int, bad_tables int"


def _demuxed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Demuxer]]:
    for b in batches:
        for i, raw in zip(b["doc_id"].to_pylist(), b["media"]):
            d = Demuxer()
            if (raw := raw.as_py()) is not None:
                d.feed(raw)
            d.end()
            yield i, d


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 20_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema.names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema.names)


def units(media: DataFrame) -> DataFrame:
    """A row for each PES packet of the streams in column media."""
    i, n, b = pa.int64(), pa.int32(), pa.bool_()
    schema = pa.schema(list(zip("doc_id pid stream_type unit pts dts random_access lost data".split(), (i, n, n, n, i, i, b, n, pa.binary()))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(((i, *row) for i, d in _demuxed(batches) for row in d.out), schema)

    return media.select(F.col("doc_id").cast("long").alias("doc_id"), "media").mapInArrow(run, UNIT)


def programs(media: DataFrame) -> DataFrame:
    """A row for each elementary stream of the program tables, with its counts."""
    n = pa.int32()
    schema = pa.schema(list(zip("doc_id program pid stream_type packets gaps repeats units bad_tables".split(), (pa.int64(), *[n] * 8))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(((i, min(d.maps.values()), s.pid, s.kind, s.packets, s.gaps, s.repeats, s.count, d.bad_tables) for i, d in _demuxed(batches) for s in d.streams.values()), schema)

    return media.select(F.col("doc_id").cast("long").alias("doc_id"), "media").mapInArrow(run, PROGRAM)


# Streams from documents

PMT_PID, PIDS, KINDS, FRAME, TABLES_EVERY = 0x1000, (0x100, 0x101), (0x1B, 0x0F), 1000, 40
FAULTS = ("none", "lost", "repeated", "garbage", "jump")


@lru_cache(64)
def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\0\0" + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


def _stamped(mark: int, t: int) -> bytes:
    return bytes([mark << 4 | (t >> 30 & 7) << 1 | 1, t >> 22 & 255, (t >> 15 & 127) << 1 | 1, t >> 7 & 255, (t & 127) << 1 | 1])


class Muxer:
    def __init__(self) -> None:
        self.counters: dict[int, int] = {}
        self.out: list[bytes] = []

    def packet(self, pid: int, start: bool, payload: bytes, flags: int | None = None, pcr: int | None = None) -> int:
        """Appends a packet; returns how much of the payload it took."""
        field = None
        if flags is not None or pcr is not None:
            field = bytes([(flags or 0) | (0x10 if pcr is not None else 0)]) + ((pcr << 15 | 0x7E00).to_bytes(6, "big") if pcr is not None else b"")
        room = SIZE - 4 - (1 + len(field) if field is not None else 0)
        took = min(room, len(payload))
        if took < room:
            field = (field if field is not None else b"") or (b"\0" if room - took > 1 or field is not None else b"")
            need = SIZE - 4 - took - 1
            field = field[:need] + b"\xff" * (need - len(field))
        c = self.counters[pid] = (self.counters.get(pid, -1) + 1) & 15
        head = bytes([SYNC, (0x40 if start else 0) | pid >> 8, pid & 255, (0x30 if field is not None else 0x10) | c])
        self.out.append(head + (bytes([len(field)]) + field if field is not None else b"") + payload[:took])
        return took

    def psi(self, pid: int, section: bytes) -> None:
        self.packet(pid, True, (b"\0" + section).ljust(SIZE - 4, b"\xff"))

    def tables(self) -> None:
        self.psi(0, _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
        body = (0xE000 | PIDS[0]).to_bytes(2, "big") + b"\xf0\0" + b"".join(bytes([k]) + (0xE000 | p).to_bytes(2, "big") + b"\xf0\0" for p, k in zip(PIDS, KINDS))
        self.psi(PMT_PID, _section(2, 1, body))

    def unit(self, pid: int, data: bytes, pts: int, dts: int | None, random: bool, jump: bool = False) -> None:
        times = _stamped(3 if dts is not None else 2, pts) + (_stamped(1, dts) if dts is not None else b"")
        pes = b"\0\0\1" + (b"\xe0" if pid == PIDS[0] else b"\xc0") + (len(data) + 3 + len(times)).to_bytes(2, "big") + bytes([0x80, 0xC0 if dts is not None else 0x80, len(times)]) + times + data
        if jump:
            self.counters[pid] = (self.counters[pid] + 5) & 15
        flags = (0x40 if random else 0) | (0x80 if jump else 0)
        at = self.packet(pid, True, pes, flags or None, pts if pid == PIDS[0] else None)
        while at < len(pes):
            at += self.packet(pid, False, pes[at : at + SIZE])


def frames_of(doc_id: int | None, text: str) -> tuple[list[tuple], str, int]:
    """What goes into a document's stream: (pid, data, pts, dts, random access) of each unit; its fault; the unit that has it."""
    raw = text.encode("utf-8", "surrogatepass")
    h = int.from_bytes(blake2b(str(doc_id).encode(), digest_size=8).digest(), "little")
    start = WRAP - 30_000 if h % 7 == 0 else h % 1_000_000 + 10_000
    frames = []
    for k in range(0, -(-len(raw) // FRAME)):
        pts = start + 3000 * k
        frames.append((PIDS[k % 2], raw[k * FRAME : (k + 1) * FRAME], pts, pts - 1500 if k % 4 == 0 else None, k % 8 == 0))
    return frames, FAULTS[h // 7 % len(FAULTS)], h // 64 % max(1, len(frames))


def mux(doc_id: int | None, text: str) -> bytes:
    m = Muxer()
    frames, fault, at = frames_of(doc_id, text)
    for k, (pid, data, pts, dts, random) in enumerate(frames):
        if k % TABLES_EVERY == 0:
            m.tables()
        begin = len(m.out)
        jump = fault == "jump" and k == at and pid in m.counters
        m.unit(pid, data, pts % WRAP, None if dts is None else dts % WRAP, random, jump)
        if k == at:
            if fault == "lost" and len(m.out) > begin + 2:
                del m.out[begin + 1]
            elif fault == "repeated":
                m.out.append(m.out[-1])
            elif fault == "garbage" and len(m.out) > begin + 1:
                m.out.insert(begin + 1, b"\0\x47garbage" * 5)
    if frames:
        m.out.append(bytes([SYNC, NULL_PID >> 8, NULL_PID & 255, 0x10]) + b"\xff" * 184)
    return b"".join(m.out)


def muxed(docs: DataFrame) -> DataFrame:
    """(doc_id, media): a stream for each document; null for null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                p = b.slice(k, 1000)
                media = [None if t is None else mux(i, t) for i, t in zip(p["doc_id"].to_pylist(), p["text"].to_pylist())]
                yield pa.RecordBatch.from_arrays([p["doc_id"], pa.array(media, pa.binary())], ["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, media binary")
