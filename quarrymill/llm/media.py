"""Media columns: payload bytes kept in MPEG transport streams.

`mux` stores bytes as one elementary stream of private data: a program association and a program
map table, then PES packets with 90 kHz time stamps, cut into 188-byte packets. Every
RAP_EVERY-th access unit is a random access point and carries a clock reference. `Demux` reads
any transport stream: it follows the tables, whose sections may run over several packets, to the elementary
streams of all programs, checks sections by their CRC, checks continuity counters, reassembles each stream's PES
packets apart, and gives payloads, time stamps and random access points.

Defined cases: a null or empty payload gives a stream with no access units, and reads back empty;
equal payloads give equal streams; a packet sent twice counts once; after a lost packet the rest of its unit is left
out and the unit counted as damaged; scrambled and damaged packets are left out and counted; where packets do not
begin with their mark, reading goes on at the next two that do; a packet cut short counts as damaged; an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops
from .staging import small_batches

#: Layout of the streams written here.
PACKET, SYNC, PMT_PID, ES_PID, PRIVATE, STREAM_ID = 188, 0x47, 0x1000, 0x100, 0x06, 0xBD
UNIT_BYTES, TICKS, RAP_EVERY = 8192, 3000, 8
BATCH_BYTES = 4 << 20
DEMUX_SCHEMA = "payload binary, pts array<bigint>, rap_offset array<bigint>, rap_pts array<bigint>, packets bigint, programs bigint, stream_type int, continuity_errors bigint, section_errors bigint"


@lru_cache(maxsize=4096)
def crc_mpeg2(data: bytes) -> int:
    """CRC-32/MPEG-2, most significant bit first, over a table section."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def section(table_id: int, number: int, body: bytes) -> bytes:
    length = 5 + len(body) + 4
    head = bytes([table_id, 0xB0 | length >> 8, length & 0xFF, number >> 8, number & 0xFF, 0xC1, 0, 0])
    return head + body + crc_mpeg2(head + body).to_bytes(4, "big")


PAT = section(0, 1, bytes([0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 0xFF]))
PMT = section(2, 1, bytes([0xE0 | ES_PID >> 8, ES_PID & 0xFF, 0xF0, 0, PRIVATE, 0xE0 | ES_PID >> 8, ES_PID & 0xFF, 0xF0, 0]))


def table_packet(pid: int, counter: int, body: bytes) -> bytes:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10 | counter & 15, 0])
    return head + body + b"\xff" * (PACKET - len(head) - len(body))


def pes_header(size: int, pts: int) -> bytes:
    stamp = bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, 1 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 1 | pts << 1 & 0xFE])
    return b"\x00\x00\x01" + bytes([STREAM_ID]) + (size + 8).to_bytes(2, "big") + b"\x84\x80\x05" + stamp


def clock(pts: int) -> bytes:
    """Program clock reference with a zero extension."""
    return ((pts & 0x1FFFFFFFF) << 15 | 0x7E00).to_bytes(6, "big")


def mux(payload: bytes) -> bytes:
    out, tables, counter = [], 0, 0
    for unit, start in enumerate(range(0, len(payload), UNIT_BYTES) or [0]):
        if unit % RAP_EVERY == 0:
            out += [table_packet(0, tables, PAT), table_packet(PMT_PID, tables, PMT)]
            tables += 1
        data = payload[start : start + UNIT_BYTES]
        if not data:
            break
        pts = unit * TICKS & 0x1FFFFFFFF
        data = pes_header(len(data), pts) + data
        extra = b"\x50" + clock(pts) if unit % RAP_EVERY == 0 else b""
        at, first = 0, 0x40
        while at < len(data):
            room = PACKET - 4 - (1 + len(extra) if extra else 0)
            body = data[at : at + room]
            at += len(body)
            head = bytes([SYNC, first | ES_PID >> 8, ES_PID & 0xFF])
            if extra or len(body) < room:
                field = extra or (b"\x00" if PACKET - 5 - len(body) else b"")
                field += b"\xff" * (PACKET - 5 - len(body) - len(field))
                out += [head, bytes([0x30 | counter, len(field)]), field, body]
            else:
                out += [head, bytes([0x10 | counter]), body]
            counter, first, extra = counter + 1 & 15, 0, b""
    return b"".join(out)


class Elementary:
    """One elementary stream: its PES packets reassembled as they arrive."""

    def __init__(self, program: int, pid: int, kind: int):
        self.program, self.pid, self.kind = program, pid, kind
        self.payload, self.size = [], 0
        self.pts: list[int | None] = []
        self.dts: list[int | None] = []
        self.raps: list[int] = []
        self.rap_pts: list[int | None] = []
        self.lost = self.damaged = 0
        self.unit: list[bytes] | None = None
        self.rap = self.broken = False

    def feed(self, starts: bool, random_access: bool, body: bytes, gap: bool) -> None:
        if gap:
            self.lost += 1
            self.broken = self.unit is not None  # what follows until the next unit has lost its place
        if starts:
            self.close()
            self.unit, self.rap, self.broken = [], random_access, False
        if self.unit is not None and not self.broken:
            self.unit.append(body)

    def close(self) -> None:
        if self.unit is None:
            return
        data, broken = b"".join(self.unit), self.broken
        self.unit, self.broken = None, False
        if data[:3] != b"\x00\x00\x01" or len(data) < 9:
            self.damaged += 1
            return
        start, length = 9 + data[8], int.from_bytes(data[4:6], "big")
        pts = _stamp(data, 9) if data[7] & 0x80 and len(data) >= 14 else None
        dts = _stamp(data, 14) if data[7] & 0xC0 == 0xC0 and len(data) >= 19 else pts
        body = data[start : 6 + length if length else None]
        self.damaged += broken or bool(length) and len(data) < 6 + length
        self.pts.append(pts)
        self.dts.append(dts)
        if self.rap:
            self.raps.append(self.size)
            self.rap_pts.append(pts)
        self.payload.append(body)
        self.size += len(body)

    def row(self) -> tuple:
        return (b"".join(self.payload), self.pts, self.raps, self.rap_pts)


def _stamp(data: bytes, at: int) -> int:
    a, b, c, d, e = data[at : at + 5]
    return (a >> 1 & 7) << 30 | b << 22 | c >> 1 << 15 | d << 7 | e >> 1


class Tables:
    """The table sections of one PID, which may begin anywhere in a packet and run over several."""

    def __init__(self):
        self.held: bytes | None = None
        self.damaged = 0

    def feed(self, starts: bool, body: bytes, gap: bool) -> list[bytes]:
        """Whole, checked sections that end in this packet."""
        out: list[bytes] = []
        if gap and self.held is not None:
            self.damaged += 1
            self.held = None
        if starts:
            point = body[0] if body else 0
            if 1 + point > len(body):
                self.damaged += 1
                self.held = None
                return out
            if self.held is not None:
                self._take(self.held + body[1 : 1 + point], out)
                if self.held is not None:  # a new section begins before the last one's end
                    self.damaged += 1
            self._take(body[1 + point :], out)
        elif self.held is not None:
            self._take(self.held + body, out)
        return out

    def _take(self, data: bytes, out: list[bytes]) -> None:
        self.held = None
        while data and data[0] != 0xFF:  # stuffing to the packet's end
            if len(data) < 3 or len(data) < (end := 3 + ((data[1] & 15) << 8 | data[2])):
                self.held = data
                return
            if end < 12 or crc_mpeg2(data[:end]):
                self.damaged += 1
            else:
                out.append(data[:end])
            data = data[end:]

    def end(self) -> None:
        self.damaged += self.held is not None
        self.held = None


class Demux:
    """A whole transport stream: programs, elementary streams in the order of program and PID, and errors."""

    def __init__(self, stream: bytes):
        self.programs: dict[int, int] = {}
        self.streams: dict[int, Elementary] = {}
        self.tables: dict[int, Tables] = {0: Tables()}
        self.last: dict[int, tuple[int, bytes, bool]] = {}
        self.packets = self.damaged = self.lost = 0
        self.read(stream)
        for s in self.streams.values():
            s.close()
        for t in self.tables.values():
            t.end()

    def read(self, stream: bytes) -> None:
        at, n = 0, len(stream)
        while at + PACKET <= n:
            if stream[at] != SYNC:
                self.damaged += 1
                at = self.resync(stream, at)
                continue
            self.packet(stream[at : at + PACKET])
            at += PACKET
        self.damaged += at < n  # a packet cut short

    @staticmethod
    def resync(stream: bytes, at: int) -> int:
        """The next place that begins two packets, or the last one."""
        at = stream.find(SYNC, at)
        while at >= 0 and at + PACKET < len(stream) and stream[at + PACKET] != SYNC:
            at = stream.find(SYNC, at + 1)
        return at if at >= 0 else len(stream)

    def packet(self, packet: bytes) -> None:
        self.packets += 1
        b1, b3 = packet[1], packet[3]
        if b1 & 0x80 or b3 & 0xC0:  # damaged on its way, or scrambled
            self.damaged += 1
            return
        pid, has, counter = (b1 & 31) << 8 | packet[2], b3 >> 4 & 3, b3 & 15
        start, flags = 4, 0
        if has & 2:
            flags = packet[5] if packet[4] else 0
            start = 5 + packet[4]
        if not has & 1 or pid == 0x1FFF or start > PACKET:
            return
        gap = False
        if pid in self.last:
            before, same, doubled = self.last[pid]
            if counter == before and packet[start:] == same and not doubled:
                self.last[pid] = (counter, same, True)  # a packet may be sent twice
                return
            gap = before + 1 & 15 != counter and not flags & 0x80
        self.last[pid] = (counter, packet[start:], False)
        self.lost += gap
        starts = bool(b1 & 0x40)
        if pid in self.streams:
            self.streams[pid].feed(starts, bool(flags & 0x40), packet[start:], gap)
        elif pid in self.tables:
            for found in self.tables[pid].feed(starts, packet[start:], gap):
                self.section(pid, found)

    def section(self, pid: int, data: bytes) -> None:
        if not data[5] & 1:  # not yet in force
            return
        if pid == 0 and data[0] == 0:
            for i in range(8, len(data) - 4, 4):
                number, where = data[i] << 8 | data[i + 1], (data[i + 2] & 31) << 8 | data[i + 3]
                if number:
                    self.programs[where] = number
                    self.tables.setdefault(where, Tables())
        elif pid in self.programs and data[0] == 2:
            i = 12 + ((data[10] & 15) << 8 | data[11])
            while i + 5 <= len(data) - 4:
                es = (data[i + 1] & 31) << 8 | data[i + 2]
                if es not in self.streams:
                    self.streams[es] = Elementary(self.programs[pid], es, data[i])
                i += 5 + ((data[i + 3] & 15) << 8 | data[i + 4])

    def ordered(self) -> list[Elementary]:
        return sorted(self.streams.values(), key=lambda s: (s.program, s.pid))

    def section_errors(self) -> int:
        """Damaged packets, sections and units."""
        return self.damaged + sum(t.damaged for t in self.tables.values()) + sum(s.damaged for s in self.streams.values())


def demux(stream: bytes) -> tuple:
    """(payload, pts, rap offsets, rap pts, packets, programs, stream type, continuity errors, section errors) of the first elementary stream."""
    read = Demux(stream)
    first = next(iter(read.ordered()), None)
    row = first.row() if first else (b"", [], [], [])
    return (*row, read.packets, len(read.programs), first.kind if first else None, read.lost, read.section_errors())


def payload_of(text: Column) -> Column:
    """UTF-8 bytes of the text, null as empty, with bytes 0 up to a positive multiple of 64."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    n = F.octet_length(raw)
    pad = F.when(n == 0, 64).otherwise(F.pmod(-n, F.lit(64)))
    return F.concat(raw, F.substring(F.unhex(F.lit("00" * 64)), F.lit(1), pad))


def mux_column(frame: DataFrame, key: str = "doc_id", payload: str = "payload") -> DataFrame:
    """(key, media) with each payload stored as a transport stream."""
    kind = frame.schema[key].dataType.simpleString()
    small_batches(frame.sparkSession)

    def run(batches):
        for batch in batches:
            for part in textops.slices(batch, 1, BATCH_BYTES):
                made = pa.array([mux(p or b"") for p in part.column(1).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), made], ["id", "media"])

    picked = frame.select(F.col(key).alias("id"), F.col(payload).alias("payload"))
    return picked.mapInArrow(run, f"id {kind}, media binary").withColumnRenamed("id", key)


def demux_column(frame: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """(key, media, program, pid, payload, time stamps, random access points, packet and error counts): a row for each
    elementary stream, in the order of program and PID; a stream without any gives one row without program and PID.
    Packet and error counts are those of the whole transport stream."""
    kind = frame.schema[key].dataType.simpleString()
    types = [pa.int64(), pa.int64(), pa.binary(), *[pa.list_(pa.int64())] * 3, pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    names = ["program", "pid", *(x.split()[0] for x in DEMUX_SCHEMA.split(", "))]

    def rows(media: bytes) -> list[tuple]:
        read = Demux(media)
        whole = (read.packets, len(read.programs))
        errors = (read.lost, read.section_errors())
        return [(s.program, s.pid, *s.row(), *whole, s.kind, *errors) for s in read.ordered()] or [(None, None, b"", [], [], [], *whole, None, *errors)]

    def run(batches):
        for batch in batches:
            for part in textops.slices(batch, 1, BATCH_BYTES):
                read = [rows(m or b"") for m in part.column(1).to_pylist()]
                at = pa.array([i for i, r in enumerate(read) for _ in r], pa.int64())
                columns = [pa.array(list(c), t) for c, t in zip(zip(*(x for r in read for x in r)), types)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), *columns], ["id", "media", *names])

    picked = frame.select(F.col(key).alias("id"), F.col(media).alias("media"))
    return picked.mapInArrow(run, f"id {kind}, media binary, program bigint, pid bigint, {DEMUX_SCHEMA}").withColumnRenamed("id", key)


def feature(frame: DataFrame) -> Column:
    """Packet, unit and access-point counts, last time stamp and errors of a stream that was read back."""
    return F.format_string(
        "packets=%d units=%d raps=%d last_pts=%d type=%d errors=%d",
        F.col("packets"), F.size("pts").cast("long"), F.size("rap_offset").cast("long"),
        F.coalesce(F.array_max("pts"), F.lit(-1)), F.coalesce(F.col("stream_type"), F.lit(-1)).cast("long"),
        F.col("continuity_errors") + F.col("section_errors"),
    )


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as a stream, read it back and describe both."""
    key = F.struct(F.col(id_col).alias("id"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"))
    read = demux_column(mux_column(docs.select(key.alias("key"), payload_of(F.col(text_col)).alias("payload")), "key"), "key")
    return read.select(
        F.col("key.id").alias(id_col),
        F.col("key.n_bytes").alias("n_bytes"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2(F.col("payload"), 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("payload"), -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2(F.col("media"), 256).alias("media_sha256"),
        feature(read).alias("feature"),
    )
