"""MPEG audio streams as media columns: writing, resynchronising, tags, tables, checksums, durations and seek offsets.

A payload travels as ancillary data of silent MPEG-1 layer III frames: mono, 48 kHz, 224 kbit/s, so every frame has
672 bytes: 4 of header, 2 of checksum, 17 of side information (zeros: no main data) and 649 of ancillary data, of
which a frame carries one unit of 576. An ID3v2 tag and a frame with a table of variable-bitrate form (frame and byte counts, seek points)
go before them. The reader takes any layer and version, parses ID3 tags and the tables of variable-bitrate streams (Xing, Info,
VBRI), looks for the next frame where none begins, and verifies the checksum of each frame that has one: of layer III over
the side information, of layer I over the bit allocation, of layer II over that and the scale factor selection. Durations are
exact: samples are counted for each rate, less the encoder's delay and padding where the table states them. Frames of free format,
whose headers name no bit rate, get their size from where the next two headers of the kind lie.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluorite.llm.common import map_batches, stage

UNIT = 576
PAD = 255

# Fixed values of the MPEG audio header: kbit/s by index 1 to 14, Hz by index, for (version, layer).
KBPS = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

HEADER = bytes([0xFF, 0xFA, 0xC4, 0xC0])  # MPEG-1 layer III with checksum, 224 kbit/s, 48 kHz, mono
FRAME, SIDE, SAMPLES, RATE = 672, 17, 1152, 48000

#: A frame of free format has at most so many bytes: 640 kbit/s at the lowest rate.
MAX_FREE_BYTES = 5764


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        out = np.where(out & 0x8000, (out << 1) ^ 0x8005, out << 1) & 0xFFFF
    return out


CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """CRC-16 of each row of bytes, polynomial 0x8005, start 0xFFFF."""
    out = np.full(len(rows), 0xFFFF, np.uint32)
    for k in range(rows.shape[1]):
        out = ((out << 8) & 0xFFFF) ^ CRC[(out >> 8) ^ rows[:, k]]
    return out


def header(word: bytes, free: int = 0) -> tuple[int, int, int, int, int] | None:
    """(frame bytes, samples, Hz, side bytes, layer if a checksum follows or 0) of a 4-byte header; None if it is none.

    free: bytes of a frame of free format without its padding; 0 takes such headers for none.
    """
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer, kbps, hz = word[1] >> 3 & 3, 4 - (word[1] >> 1 & 3), word[2] >> 4, word[2] >> 2 & 3
    if version == 1 or layer == 4 or kbps == 15 or kbps == 0 and not free or hz == 3:
        return None
    first = version == 3
    bits, rate, padding = KBPS[1 if first else 2, layer][kbps - 1] * 1000, HERTZ[version][hz], word[2] >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
    size = (12 * bits // rate + padding) * 4 if layer == 1 else samples // 8 * bits // rate + padding
    if kbps == 0:
        size = free + padding * (4 if layer == 1 else 1)
    mono = word[3] >> 6 == 3
    side = 0 if layer < 3 else (17 if mono else 32) if first else (9 if mono else 17)
    return size, samples, rate, side, 0 if word[1] & 1 else layer


def free_size(stream: bytes, at: int, ends: tuple[int, ...]) -> int:
    """Bytes without padding of the frame of free format at ``at``; 0 if it is none.

    It is the distance to the first header that differs in padding and private bit alone and has one more at the same distance
    after it, or one of ``ends``, where frames may end; so a frame all alone has no size.
    """
    word = stream[at : at + 4]
    h = header(word, 1)
    if h is None or word[2] >> 4:
        return 0
    padding = lambda k: (stream[k + 2] >> 1 & 1) * (4 if word[1] & 6 == 6 else 1)
    alike = lambda k: stream[k : k + 2] == word[:2] and k + 2 < len(stream) and (stream[k + 2] ^ word[2]) & 0xFC == 0
    nxt = at + 4 + h[3]
    while (nxt := stream.find(word[:2], nxt + 1, at + MAX_FREE_BYTES + 2)) >= 0:
        if alike(nxt):
            size = nxt - at - padding(at)
            after = nxt + size + padding(nxt)
            if after in ends or alike(after):
                return size
    return 0


def duration(samples: dict[int, int]) -> int:
    """Microseconds, rounded down once, of numbers of samples by their rate in Hz."""
    whole = math.lcm(*samples)
    return sum(n * (whole // hz) for hz, n in samples.items()) * 1_000_000 // whole


def allocation_widths(frame: bytes) -> list[int]:
    """Bits of the allocation of each subband of a layer I or II frame."""
    version, layer, kbps, hz = frame[1] >> 3 & 3, 4 - (frame[1] >> 1 & 3), frame[2] >> 4, frame[2] >> 2 & 3
    if layer == 1:
        return [4] * 32
    if version != 3:
        return [4] * 4 + [3] * 7 + [2] * 19
    # Free format has the tables of the highest bit rates: its index 0 takes the last.
    rate, each = HERTZ[version][hz], KBPS[1, 2][kbps - 1] // (1 if frame[3] >> 6 == 3 else 2)
    if each < 56:
        return [4] * 2 + [3] * (10 if rate == 32000 else 6)
    return [4] * 11 + [3] * 12 + [2] * (7 if each >= 96 and rate != 48000 else 4)


def protected_bits(frame: bytes) -> str:
    """The bits that the checksum of a layer I or II frame covers, as zeros and ones."""
    mono, joint = frame[3] >> 6 == 3, frame[3] >> 6 == 1
    widths = allocation_widths(frame)
    bound = min(len(widths), 4 * ((frame[3] >> 4 & 3) + 1)) if joint else len(widths)
    layer = 4 - (frame[1] >> 1 & 3)
    body = "".join(f"{x:08b}" for x in frame[6:70])
    at, used = 0, 0
    for band, n in enumerate(widths):
        # From the bound on both channels of joint stereo share an allocation.
        for _ in range(1 if mono or band >= bound else 2):
            used += ("1" in body[at : at + n]) * (2 if not mono and band >= bound else 1)
            at += n
    return f"{frame[2]:08b}{frame[3]:08b}" + body[: at + (2 * used if layer == 2 else 0)]


def crc16_of_bits(bits: str) -> int:
    """As ``crc16``, of any number of bits."""
    whole = len(bits) // 8 * 8
    out = int(crc16(np.array([[int(bits[k : k + 8], 2) for k in range(0, whole, 8)]], np.uint8))[0])
    for bit in bits[whole:]:
        out = (out << 1 & 0xFFFF) ^ (0x8005 if (out >> 15) ^ int(bit) else 0)
    return out


def _text(raw: bytes) -> str:
    """A tag's text: a byte for its encoding, then the text up to its end."""
    kind = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(raw[0] if raw else 0, "latin-1")
    return raw[1:].decode(kind, "replace").rstrip("\0")


def read_id3v2(raw: bytes) -> list[tuple[str, str]]:
    """(frame id, value) of an ID3v2 tag of version 2 to 4; text is decoded, of other frames the size is given.

    What doesn't parse ends the list; a tag's padding too.
    """
    version, flags, body = raw[3], raw[5], raw[10:]
    safe = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    at = 0
    if flags & 0x40 and version > 2 and len(body) >= 4:
        at = safe(body) if version == 4 else 4 + struct.unpack_from(">I", body)[0]
    name, head = (3, 6) if version == 2 else (4, 10)
    out = []
    while at + head <= len(body) and re.fullmatch(rb"[A-Z0-9]+", body[at : at + name]):
        own = body[at : at + head]
        size = int.from_bytes(own[3:6], "big") if version == 2 else safe(own[4:8]) if version == 4 else int.from_bytes(own[4:8], "big")
        value = body[at + head : at + head + size]
        if version == 4 and own[9] & 2:
            value = value.replace(b"\xff\x00", b"\xff")
        if len(value) < size:
            break
        kind = own[:name].decode()
        # A user's own text frame has a name and a value.
        out.append((kind, _text(value).replace("\0", "=", 1) if kind[0] == "T" else f"{size} bytes"))
        at += head + size
    return out


def read_id3v1(raw: bytes) -> list[tuple[str, str]]:
    """(field, value) of a 128-byte ID3v1 tag; empty fields are left out."""
    fields = [("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97), ("comment", 97, 125 if raw[125] == 0 and raw[126] else 127)]
    out = [(k, raw[a:b].decode("latin-1").split("\0")[0].strip()) for k, a, b in fields]
    return [(k, v) for k, v in [*out, ("track", str(raw[126]) if raw[125] == 0 and raw[126] else ""), ("genre", str(raw[127]))] if v]


def read_table(stream: bytes, at: int, size: int, body: int) -> dict:
    """The variable-bitrate table of the frame at ``at``, whose main part begins at ``body``; {} without one.

    seek: how many bytes from this frame on each point of the table lies; points are evenly spread over the frames of Xing
    and Info, and lie each_frames apart in VBRI. delay, padding: samples that the encoder put before and after the sound, where an
    encoder's name follows the fields of Xing or Info.
    """
    frame = stream[at : at + size]
    name = stream[body : body + 4]
    if name in (b"Xing", b"Info") and body - at + 8 <= size:
        (flags,) = struct.unpack_from(">I", frame, body - at + 4)
        place, out = body - at + 8, {"kind": name.decode(), "frames": None, "bytes": None, "seek": []}
        for bit, key in ((1, "frames"), (2, "bytes")):
            if flags & bit and place + 4 <= size:
                (out[key],) = struct.unpack_from(">I", frame, place)
                place += 4
        if flags & 4 and place + 100 <= size:
            out["seek"] = [p * (out["bytes"] or 0) // 256 for p in frame[place : place + 100]]
            place += 100
        place += 4 if flags & 8 else 0
        # Name and version in 9 bytes, 12 of settings, then both counts in 12 bits each.
        if re.fullmatch(rb"[A-Za-z]{4}", frame[place : place + 4]) and place + 24 <= size:
            both = int.from_bytes(frame[place + 21 : place + 24], "big")
            out["delay"], out["padding"] = both >> 12, both & 4095
        return out
    if frame[36:40] == b"VBRI" and size >= 62:
        total, count, entries, scale, width, each = struct.unpack_from(">IIHHHH", frame, 46)
        raw = frame[62 : 62 + entries * width]
        steps = [int.from_bytes(raw[k : k + width], "big") * scale for k in range(0, len(raw) // max(1, width) * width, max(1, width))]
        return {"kind": "VBRI", "frames": count, "bytes": total, "seek": np.cumsum([0, *steps]).tolist()[: len(steps)], "each_frames": each}
    return {}


def write(payload: bytes) -> bytes:
    """A stream that carries ``payload``, a positive multiple of ``UNIT`` bytes."""
    n = len(payload) // UNIT
    frames = np.zeros((n + 1, FRAME), np.uint8)
    frames[:, :4] = np.frombuffer(HEADER, np.uint8)
    side = 6 + SIDE
    crc = int(crc16(np.concatenate([frames[:1, 2:4], frames[:1, 6:side]], 1))[0])
    frames[:, 4], frames[:, 5] = crc >> 8, crc & 255
    frames[1:, side : side + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    size = (n + 1) * FRAME
    seek = bytes(256 * (k * (n + 1) // 100) // (n + 1) for k in range(100))
    table = b"Xing" + struct.pack(">III", 7, n, size) + seek
    frames[0, side : side + len(table)] = np.frombuffer(table, np.uint8)
    text = b"\x00payload\x00" + str(len(payload)).encode()
    tag = b"TXXX" + struct.pack(">IH", len(text), 0) + text
    k = len(tag)
    return b"ID3\x03\x00\x00" + bytes([k >> 21 & 127, k >> 14 & 127, k >> 7 & 127, k & 127]) + tag + frames.tobytes()


def read(stream: bytes) -> dict:
    """What a stream holds: tags, their values, frames, offsets, samples, Hz, microseconds, skipped bytes, bad checksums, table, missing frames (None without a table).

    offsets: where each audio frame begins. A frame counts if it is in step with one of its kind, or another of its kind or
    the stream's end follows it; a frame that the stream cuts off doesn't. One of free format always needs what follows it. Bytes
    that belong to no tag or frame are skipped and counted. samples: those of all frames, rate: of the first; duration_us: of all
    samples at their own rates, less the encoder's delay at the first and padding at the last.
    """
    at, end, tags, values = 0, len(stream), [], []
    while stream[at : at + 3] == b"ID3" and at + 10 <= end:
        a, b, c, d = stream[at + 6 : at + 10]
        size = 10 + (a << 21 | b << 14 | c << 7 | d)
        values += read_id3v2(stream[at : at + size])
        at += size + (10 if stream[at + 5] & 16 else 0)
        tags.append("id3v2")
    # An ID3v1 tag may begin here; it doesn't if a frame that ends where the stream ends holds these bytes.
    tail = end - 128 if end - at >= 128 and stream[end - 128 : end - 125] == b"TAG" else end
    known: dict[bytes, tuple | None] = {}
    offsets, heads, skipped, rate, free = [], [], 0, 0, 0
    samples: dict[int, int] = {}
    table: dict = {}
    synced, kind, bad = False, None, 0
    while at + 4 <= end:
        if at == tail:
            tags.append("id3v1")
            values += read_id3v1(stream[at:end])
            at = end
            break
        word = stream[at : at + 4]
        h = known[word] if word in known else known.setdefault(word, header(word))
        sure, loose = False, word[0] == 255 and h is None and word[2] >> 4 == 0
        if loose:
            free = free if synced and free else free_size(stream, at, (tail, end))
            h = header(word, free)
        if h is not None and (at + h[0] <= tail or at + h[0] == end):
            # In step, a frame of the same kind follows; out of step, it takes two in a row, or one that ends the stream.
            after = at + h[0]
            follower = header(stream[after : after + 4], free if loose else 0)
            sure = synced and h[1:4] == kind and not loose or after >= end - 3 or tail - 3 <= after <= tail or follower is not None and follower[1:4] == h[1:4]
        if not sure:
            nxt = stream.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            nxt = min(nxt, tail) if at < tail else nxt
            # A size that has led astray is looked for anew.
            skipped, at, synced = (skipped, at, False) if loose and synced else (skipped + nxt - at, nxt, False)
            continue
        kind = h[1:4]
        if not offsets and not table:
            table = read_table(stream, at, h[0], at + 4 + (0 if word[1] & 1 else 2) + h[3])
            if table:
                at, synced = at + h[0], True
                continue
        offsets.append(at)
        heads.append(h[3] if h[4] == 3 else 0)
        if h[4] in (1, 2) and crc16_of_bits(protected_bits(stream[at : at + h[0]])) != int.from_bytes(stream[at + 4 : at + 6], "big"):
            bad += 1
        samples[h[2]] = samples.get(h[2], 0) + h[1]
        rate, last, at, synced = rate or h[2], h[2], at + h[0], True
    skipped += end - at if at < end else 0
    total, heard = sum(samples.values()), dict(samples)
    if heard:
        heard[rate] -= table.get("delay", 0)
        heard[last] -= table.get("padding", 0)
    us = max(0, duration(heard)) if heard else 0
    missing = None if table.get("frames") is None else table["frames"] - len(offsets)
    raw = np.frombuffer(stream, np.uint8)
    place, covered = np.array(offsets, np.int64), np.array(heads, np.int64)
    for k in set(heads) - {0}:
        own = place[covered == k][:, None]
        got = crc16(np.concatenate([raw[own + [2, 3]], raw[own + np.arange(6, 6 + k)]], 1))
        bad += int((got != (raw[own + 4].ravel().astype(np.uint32) << 8 | raw[own + 5].ravel())).sum())
    return {"tags": tags, "values": values, "offsets": place, "samples": total, "rate": rate, "duration_us": us, "skipped": skipped, "bad_checksums": bad, "table": table, "missing_frames": missing}


def payload_of(stream: bytes, offsets: np.ndarray) -> bytes:
    raw = np.frombuffer(stream, np.uint8)
    return raw[offsets[:, None] + np.arange(6 + SIDE, 6 + SIDE + UNIT)].tobytes()


def store(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write each text's bytes, padded to whole units, as a stream; returns the stored table: doc_id, n_bytes, media.

    A null text is empty; an empty one gets one unit of padding. A text may have any length: its stream takes 7 / 6 of its bytes,
    and a task holds a batch's streams. Repeated rows are stored each; other columns are ignored;
    an empty table stays empty.
    """

    def make():
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            raws = [(t or "").encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]
            media = [write(r + bytes([PAD]) * (-len(r) % UNIT if r else UNIT)) for r in raws]
            return pa.RecordBatch.from_pydict({"doc_id": b.column(0), "n_bytes": pa.array(list(map(len, raws)), pa.int64()), "media": pa.array(media, pa.binary())})

        return one

    rows = docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string"))
    return stage(map_batches(rows, "doc_id long, n_bytes long, media binary", make))


#: Frames between two stored seek offsets.
SEEK_FRAMES = 64


def describe(media: DataFrame) -> DataFrame:
    """Features of stored streams: what ``read`` finds, the exact duration, seek offsets and the payload's checksums.

    seek_offsets: the byte place of each ``SEEK_FRAMES``-th frame; table_seek: the points of the stream's own table; tags: the
    first value of each tag frame. ``media``: rows of ``store``; repeated rows are described each; equal texts have equal
    values; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, n_samples long, sample_rate int, duration_us long, skipped_bytes long, bad_checksums long, missing_frames long, seek_offsets array<long>, tags map<string,string>, table_seek array<long>"
    kinds = {"payload_sha256": pa.string(), "media_sha256": pa.string(), "feature": pa.string(), "sample_rate": pa.int32(), "seek_offsets": pa.list_(pa.int64()), "tags": pa.map_(pa.string(), pa.string()), "table_seek": pa.list_(pa.int64())}

    def make():
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            out: dict[str, list] = {}
            for doc, n, m in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                got = read(m)
                payload = payload_of(m, got["offsets"])
                frames, us = len(got["offsets"]), got["duration_us"]
                feature = f"{got['table'].get('kind', '-')}:{got['table'].get('frames')}:frames={frames}:samples={got['samples']}:hz={got['rate']}:us={us}:skipped={got['skipped']}:bad={got['bad_checksums']}:tags={'+'.join(got['tags'])}"
                row = {
                    "doc_id": doc, "n_bytes": n, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:]),
                    "media_bytes": len(m), "media_sha256": hashlib.sha256(m).hexdigest(), "feature": feature, "n_frames": frames, "n_samples": got["samples"], "sample_rate": got["rate"],
                    "duration_us": us, "skipped_bytes": got["skipped"], "bad_checksums": got["bad_checksums"], "missing_frames": got["missing_frames"], "seek_offsets": got["offsets"][::SEEK_FRAMES].tolist(),
                    "tags": list({k: v for k, v in reversed(got["values"])}.items()), "table_seek": got["table"].get("seek", []),
                }
                for k, v in row.items():
                    out.setdefault(k, []).append(v)
            return pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})

        return one

    return map_batches(media.select("doc_id", "n_bytes", "media"), schema, make)
