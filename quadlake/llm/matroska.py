"""Media columns: Matroska files as packet tables.

``packets`` walks the variable-length EBML elements of a file (known and unknown sizes, at any depth that matters),
reads tracks, clusters, simple blocks and block groups, undoes all four kinds of lacing, reads the cues, and gives a row
a packet: track, time stamp, byte range, key flag. ``mux`` writes 8-bit PCM in the same structure, so that bytes of any
kind can be stored as media and read back unchanged.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .common import small

EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
GROUP, BLOCK, SIMPLE, TIME = 0xA0, 0xA1, 0xA3, 0xE7
TOP = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}
FRAME, LACED, BLOCKS = 192, 8, 160  # bytes a frame, frames a block, blocks a cluster
RATE = 8000
XIPH, FIXED, EBML_LACING = 1, 2, 3


class Broken(ValueError):
    """The bytes are no Matroska file, or end before it does."""


def read_vint(b, at: int, keep: bool = False) -> tuple[int, int, int]:
    """Value, next position and length of the vint at a position; keep leaves the marker bit, as ids do. All ones: -1."""
    if at >= len(b):
        raise Broken("ends inside a number")
    n = 9 - b[at].bit_length()
    if n > 8 or at + n > len(b):
        raise Broken("bad number")
    raw = int.from_bytes(b[at : at + n], "big")
    value = raw if keep else raw & ((1 << 7 * n) - 1)
    if not keep and value == (1 << 7 * n) - 1:
        value = -1
    return value, at + n, n


def vint(value: int, n: int = 0) -> bytes:
    n = n or max(1, -(-(value + 1).bit_length() // 7))
    return ((1 << 7 * n) | value).to_bytes(n, "big")


def element(eid: int, body: bytes) -> bytes:
    return eid.to_bytes((eid.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(eid: int, value: int) -> bytes:
    return element(eid, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


HEAD = element(EBML, uint(0x4286, 1) + uint(0x42F7, 1) + uint(0x42F2, 4) + uint(0x42F3, 8) + element(0x4282, b"matroska") + uint(0x4287, 4) + uint(0x4285, 2))
AUDIO = element(TRACKS, element(0xAE, uint(0xD7, 1) + uint(0x73C5, 1) + uint(0x83, 2) + uint(0x9C, 1) + element(0x86, b"A_PCM/INT/LIT") + element(0xE1, element(0xB5, struct.pack(">d", RATE)) + uint(0x9F, 1) + uint(0x6264, 8))))


def lace_sizes(sizes: list[int], kind: int) -> bytes:
    """The head of a laced block: the number of frames less one, and what the kind of lacing says of their sizes."""
    out = bytes([len(sizes) - 1])
    if kind == XIPH:
        out += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif kind == EBML_LACING:
        out += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            n = next(n for n in range(1, 9) if abs(b - a) < (1 << 7 * n - 1) - 1)
            out += vint(b - a + (1 << 7 * n - 1) - 1, n)
    elif len(set(sizes)) > 1:
        raise ValueError("fixed lacing needs equal sizes")
    return out


def block(frames: list[bytes], rel: int, kind: int = FIXED, track: int = 1) -> bytes:
    kind = kind if len(frames) > 1 else 0
    head = vint(track) + struct.pack(">hB", rel, 0x80 | kind_bits(kind))
    return head + (lace_sizes([len(f) for f in frames], kind) if kind else b"") + b"".join(frames)


def kind_bits(kind: int) -> int:
    return {0: 0, XIPH: 0x02, FIXED: 0x04, EBML_LACING: 0x06}[kind]


def mux(payload: bytes) -> bytes:
    """One mono track of unsigned 8-bit samples; the payload is a positive multiple of FRAME bytes. Equal bytes, equal file."""
    per, ms = FRAME * LACED, FRAME * LACED * 1000 // RATE
    info = element(INFO, uint(0x2AD7B1, 1_000_000) + element(0x4489, struct.pack(">d", len(payload) * 1000 / RATE)) + element(0x4D80, b"quadlake") + element(0x5741, b"quadlake"))
    out, at, cues = [info, AUDIO], len(info) + len(AUDIO), []
    for c in range(0, len(payload), per * BLOCKS):
        start = c // per * ms
        body = [uint(TIME, start)]
        for k, b in enumerate(range(c, min(c + per * BLOCKS, len(payload)), per)):
            data = payload[b : min(b + per, c + per * BLOCKS)]
            n = len(data) // FRAME
            head = b"\x81" + struct.pack(">hB", k * ms, 0x84 if n > 1 else 0x80) + (bytes([n - 1]) if n > 1 else b"")
            body.append(element(SIMPLE, head + data))
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(0xBB, uint(0xB3, start) + element(0xB7, uint(0xF7, 1) + uint(0xF1, at))))
        out.append(cluster)
        at += len(cluster)
    out.append(element(CUES, b"".join(cues)))
    return HEAD + element(SEGMENT, b"".join(out))


@dataclass
class Parsed:
    tracks: dict[int, dict] = field(default_factory=dict)
    scale: int = 1_000_000
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time, track, offset of the cluster in the file
    packets: list[tuple[int, int, int, int, bool]] = field(default_factory=list)  # track, ns, offset, size, key
    clusters: list[int] = field(default_factory=list)


def _children(b, at: int, end: int):
    while at < end:
        eid, p, _ = read_vint(b, at, keep=True)
        size, p, _ = read_vint(b, p)
        stop = end if size < 0 else p + size
        if stop > end:
            raise Broken("an element ends after its parent")
        yield eid, at, p, stop, size < 0
        at = stop


def _int(b, p: int, q: int) -> int:
    return int.from_bytes(b[p:q], "big")


def _float(b, p: int, q: int) -> float:
    return 0.0 if p == q else struct.unpack(">f" if q - p == 4 else ">d", b[p:q])[0]


def _frames(b, p: int, q: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Track, relative time, flags, and byte ranges of the frames of a block."""
    track, p, _ = read_vint(b, p)
    if p + 3 > q:
        raise Broken("short block")
    rel, flags = struct.unpack_from(">hB", b, p)
    p += 3
    kind = flags >> 1 & 3
    if not kind:
        return track, rel, flags, [(p, q - p)]
    if p >= q:
        raise Broken("short block")
    n, p = b[p] + 1, p + 1
    if kind == 2:  # fixed
        if (q - p) % n:
            raise Broken("uneven fixed lacing")
        sizes = [(q - p) // n] * n
    elif kind == 1:  # Xiph
        sizes = []
        for _ in range(n - 1):
            s = 0
            while True:
                if p >= q:
                    raise Broken("short lacing")
                s, p = s + b[p], p + 1
                if b[p - 1] != 255:
                    break
            sizes.append(s)
    else:
        s, p, _ = read_vint(b, p)
        sizes = [s]
        for _ in range(n - 2):
            d, p, k = read_vint(b, p)
            d = (1 << 7 * k) - 1 if d < 0 else d
            s += d - ((1 << 7 * k - 1) - 1)
            sizes.append(s)
        sizes = sizes[: n - 1]
    if kind != 2:
        sizes.append(q - p - sum(sizes))
    if min(sizes) < 0 or p + sum(sizes) > q:
        raise Broken("lacing runs past its block")
    out = []
    for s in sizes:
        out.append((p, s))
        p += s
    return track, rel, flags, out


def _track(b, p: int, q: int) -> dict:
    t: dict = {"type": 0, "codec": "", "rate": 8000.0, "channels": 1, "bits": 0, "frame_ns": 0}
    for eid, _, x, y, _ in _children(b, p, q):
        if eid == 0xD7:
            t["number"] = _int(b, x, y)
        elif eid == 0x83:
            t["type"] = _int(b, x, y)
        elif eid == 0x86:
            t["codec"] = bytes(b[x:y]).decode("ascii", "replace")
        elif eid == 0x23E383:
            t["frame_ns"] = _int(b, x, y)
        elif eid == 0xE1:
            for e2, _, u, v, _ in _children(b, x, y):
                if e2 == 0xB5:
                    t["rate"] = _float(b, u, v)
                elif e2 == 0x9F:
                    t["channels"] = _int(b, u, v)
                elif e2 == 0x6264:
                    t["bits"] = _int(b, u, v)
    return t


def _cluster(b, p: int, q: int, open_end: bool, out: Parsed) -> int:
    """Reads a cluster; gives the position after it, which for one of unknown size is where the next top-level element starts."""
    time = 0
    at = p
    while at < q:
        eid, x, _ = read_vint(b, at, keep=True)
        if open_end and eid in TOP:
            return at
        size, x, _ = read_vint(b, x)
        y = x + size
        if size < 0 or y > q:
            raise Broken("an element ends after its cluster")
        if eid == TIME:
            time = _int(b, x, y)
        elif eid in (SIMPLE, GROUP):
            key = True
            if eid == GROUP:
                inner = [(e, u, v) for e, _, u, v, _ in _children(b, x, y)]
                key = not any(e == 0xFB for e, _, _ in inner)
                found = next(((u, v) for e, u, v in inner if e == BLOCK), None)
            else:
                found = (x, y)
            if found:
                track, rel, flags, frames = _frames(b, *found)
                key = bool(flags & 0x80) if eid == SIMPLE else key
                t = out.tracks.get(track, {})
                ns = (time + rel) * out.scale
                step = t.get("frame_ns", 0)
                width = t.get("channels", 1) * t.get("bits", 0) / 8 if t.get("codec", "").startswith("A_PCM") else 0
                for o, s in frames:
                    out.packets.append((track, ns, o, s, key))
                    ns += step or (round(s / width * 1e9 / t["rate"]) if width and t.get("rate") else 0)
        at = y
    return at


def parse(b: bytes) -> Parsed:
    """Everything a packet table needs. Raises Broken for bytes that are no whole Matroska file."""
    out = Parsed()
    eid, p, _ = read_vint(b, 0, keep=True)
    if eid != EBML:
        raise Broken("no EBML head")
    size, p, _ = read_vint(b, p)
    at = p + size
    if size < 0 or at > len(b):
        raise Broken("bad EBML head")
    while at < len(b):
        eid, p, _ = read_vint(b, at, keep=True)
        size, p, _ = read_vint(b, p)
        end = len(b) if size < 0 else p + size
        if end > len(b):
            raise Broken("ends inside the segment")
        if eid != SEGMENT:
            at = end
            continue
        base = at = p
        while at < end:
            eid, x, _ = read_vint(b, at, keep=True)
            size, x, _ = read_vint(b, x)
            y = end if size < 0 else x + size
            if y > end:
                raise Broken("an element ends after its segment")
            if eid == INFO:
                for e, _, u, v, _ in _children(b, x, y):
                    if e == 0x2AD7B1:
                        out.scale = _int(b, u, v)
            elif eid == TRACKS:
                for e, _, u, v, _ in _children(b, x, y):
                    if e == 0xAE:
                        t = _track(b, u, v)
                        out.tracks[t.get("number", 0)] = t
            elif eid == CLUSTER:
                out.clusters.append(at)
                y = _cluster(b, x, y, size < 0, out)
            elif eid == CUES:
                for e, _, u, v, _ in _children(b, x, y):
                    if e != 0xBB:
                        continue
                    parts = [(c, s, t) for c, _, s, t, _ in _children(b, u, v)]
                    time = next((_int(b, s, t) for c, s, t in parts if c == 0xB3), 0)
                    for c, s, t in parts:
                        if c == 0xB7:
                            at_ = {k: _int(b, m, n) for k, _, m, n, _ in _children(b, s, t)}
                            out.cues.append((time, at_.get(0xF7, 0), base + at_.get(0xF1, 0)))
            at = y
        at = end
    return out


PACKETS = "packet int, track long, pts_ns long, offset long, size long, key boolean, error string"


def packet_table(docs: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row a packet: the columns of keep, and PACKETS. What cannot be read gives one row with its error and no packet;
    a null gives no row. Columns of docs that are not kept don't matter, whatever their names."""
    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep) + ", " + PACKETS
    src = docs.select(*keep, F.col(media).alias("_media")).where("_media IS NOT NULL")

    def rows(batches):
        for b in small(batches):
            cols: list[list] = [[] for _ in range(7)]
            index: list[int] = []
            for i, x in enumerate(b.column(len(keep)).to_pylist()):
                try:
                    got = [(k, *p, None) for k, p in enumerate(parse(x).packets)]
                except Broken as e:
                    got = [(None,) * 6 + (str(e),)]
                for g in got:
                    index.append(i)
                    for c, v in zip(cols, g, strict=True):
                        c.append(v)
            kept = [b.column(j).take(pa.array(index, pa.int64())) for j in range(len(keep))]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays(kept + [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[*keep, "packet", "track", "pts_ns", "offset", "size", "key", "error"])

    return src.mapInArrow(rows, schema)


def features(parsed: Parsed, samples: np.ndarray) -> str:
    """Packets, clusters, cues, milliseconds, mean and deviation of the samples, sign changes about the mid level."""
    ms = sum(p[3] for p in parsed.packets) * 1000 // RATE
    x = samples.astype(np.int16) - 128
    turns = int(np.count_nonzero((x[1:] ^ x[:-1]) < 0))
    return f"packets={len(parsed.packets)};clusters={len(parsed.clusters)};cues={len(parsed.cues)};ms={ms};mean={x.mean():.3f};std={x.std():.3f};turns={turns}"


def store(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, n_bytes and media: the UTF-8 text (null: empty), padded with blanks to a positive multiple of FRAME."""
    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep) + ", n_bytes long, media binary"
    src = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_body"))

    def rows(batches):
        for b in small(batches):
            n, media = [], []
            for x in b.column(len(keep)):
                x = x.as_py()
                n.append(len(x))
                media.append(mux(x.ljust(max(1, -(-len(x) // FRAME)) * FRAME)))
            yield pa.RecordBatch.from_arrays([b.column(j) for j in range(len(keep))] + [pa.array(n, pa.int64()), pa.array(media, pa.binary())], names=[*keep, "n_bytes", "media"])

    return src.mapInArrow(rows, schema)


def digest(stored: DataFrame) -> DataFrame:
    """What the stored bytes of each document hold, read back by way of their packets."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def rows(batches):
        for b in small(batches):
            out: list[list] = [[] for _ in range(6)]
            for x in b.column(2):
                x = x.as_py()
                p = parse(x)
                body = b"".join(x[o : o + s] for _, _, o, s, _ in p.packets)
                for c, v in zip(out, (len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-16:]), len(x), hashlib.sha256(x).hexdigest(), features(p, np.frombuffer(body, np.uint8))), strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)] + [pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(rows, schema)


@C.small_batches
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document, with digests and features of its stored form, read back.

    Null and empty texts are one frame of blanks; repeated rows repeat, and equal texts have equal files; null doc_ids stay
    null; further columns are not read; no documents give no rows.
    """
    stored = C.stage(spark, store(C.table(spark, sf_dir, "documents").select("doc_id", "text")), "media")
    return C.stage(spark, digest(stored), "digests")


C.travels(__name__)
