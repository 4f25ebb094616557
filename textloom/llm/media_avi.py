"""Media columns: motion-JPEG in AVI, written from and read back to bytes, with shots found by histogram differences.

The unit of storage is the quantised DCT coefficient: a block of 8 x 8 holds 64 payload bytes, byte k as the coefficient at place k
of the zigzag order. Every coefficient is coded in size category 8, whose extra bits are the byte itself, and with quantiser 1 the
entropy coding loses nothing. Frames are plain baseline JPEG, grey, SIDE x SIDE, each block its own restart interval.

Reading parses the RIFF chunks, finds frames by the index and decodes any grey baseline frame by its own Huffman tables: all restart
intervals of many frames go in lockstep, a symbol at each step, found in a table by the next 16 bits. The inverse DCT turns
coefficients to pixels. A shot ends where the difference of two frames' luma histograms exceeds what the shot has shown so far.

Defined cases: a null or empty text is one block of zeros. Equal texts give equal values. Very long texts give more frames.
Columns other than doc_id and text are ignored; a null doc_id stays null.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from textloom.llm import common

SIDE, FPS, UNIT = 64, 25, 64
BLOCKS = (SIDE // 8) ** 2
BINS, WINDOW, LEAST, SPREAD = 16, 8, 0.08, 3.0
#: Frames that are decoded in lockstep, and bytes of text whose files are read together.
AT_ONCE, TOGETHER = 128, 1 << 19
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _zigzag() -> np.ndarray:
    """Row-major place of each zigzag position: along diagonals, the direction changing from one to the next."""
    return np.array([r * 8 + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))])


ZIGZAG = _zigzag()
_k, _x = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
_COS = np.where(_k == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * _x + 1) * _k * np.pi / 16)
#: Coefficients in zigzag order, as a row, times this are the 64 pixels less 128.
INVERSE = np.einsum("ux,vy->uvxy", _COS, _COS).reshape(64, 64)[ZIGZAG].astype(np.float32)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


#: One code of 8 zero bits, for size category 8.
_ONE_CODE = bytes([0] * 7 + [1] + [0] * 8 + [8])
HEADER = b"\xff\xd8" + _segment(0xDB, b"\x00" + b"\x01" * 64) + _segment(0xC0, struct.pack(">BHHBBBB", 8, SIDE, SIDE, 1, 1, 0x11, 0)) + _segment(0xC4, b"\x00" + _ONE_CODE + b"\x10" + _ONE_CODE) + _segment(0xDD, b"\x00\x01") + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
_RESTART = np.array([[0xFF, 0xD0 + i % 8] for i in range(BLOCKS)], np.uint8)


def encode_frames(payload: bytes) -> list[bytes]:
    """JPEG frames of BLOCKS blocks; the last one is filled with zero bytes."""
    n = -(-len(payload) // (BLOCKS * UNIT))
    data = np.zeros((n, BLOCKS, UNIT), np.uint8)
    data.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    out = np.zeros((n, BLOCKS, 2 * UNIT + 2), np.uint8)
    out[:, :, 1 : 2 * UNIT : 2] = data
    out[:, :, 2 * UNIT :] = _RESTART
    frames = []
    for d, o in zip(data, out, strict=True):
        if (d == 0xFF).any():  # a data byte FF is followed by a stuffed 00
            scan = b"".join(row[:-2].tobytes().replace(b"\xff", b"\xff\x00") + row[-2:].tobytes() for row in o)
        else:
            scan = o.tobytes()
        frames.append(HEADER + scan[:-2] + b"\xff\xd9")
    return frames


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(payload: bytes) -> bytes:
    """A RIFF AVI file with an index; the comment holds the payload's length."""
    frames = encode_frames(payload)
    most = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", SIDE * SIDE, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"payload=%d" % len(payload)))
    movi, index, at = [], [], 4
    for f in frames:
        movi.append(_chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(movi[-1])
    body = b"AVI " + hdrl + info + _chunk(b"LIST", b"movi" + b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def _chunks(data: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, first byte, end byte) of the chunks between two places; a list's name is its kind."""
    while at + 8 <= end:
        name, size = struct.unpack_from("<4sI", data, at)
        at += 8
        if name in (b"RIFF", b"LIST"):
            yield bytes(data[at : at + 4]), at + 4, at + size
        else:
            yield name, at, at + size
        at += size + size % 2


@dataclass(frozen=True)
class Avi:
    frames: list[bytes]
    payload_bytes: int | None
    fps: float


def read_avi(media: bytes) -> Avi:
    """The video frames by the file's index (or in file order without one), frame rate and comment."""
    data = memoryview(media)
    kind, at, end = next(_chunks(data, 0, len(data)), (b"", 0, 0))
    if kind != b"AVI ":
        raise ValueError("no RIFF AVI file")
    frames, size, fps, base, index = [], None, float(FPS), 0, None
    movi: tuple[int, int] = (0, 0)
    for name, a, b in _chunks(data, at, end):
        if name == b"hdrl":
            for inner, x, _ in _chunks(data, a, b):
                if inner == b"avih":
                    fps = 1e6 / (struct.unpack_from("<I", data, x)[0] or 40_000)
        elif name == b"INFO":
            for inner, x, y in _chunks(data, a, b):
                if inner == b"ICMT" and bytes(data[x : x + 8]) == b"payload=":
                    size = int(bytes(data[x + 8 : y]))
        elif name == b"movi":
            movi, base = (a, b), a - 4
        elif name == b"idx1":
            index = [e for e in struct.iter_unpack("<4sIII", data[a : a + (b - a) // 16 * 16]) if e[0][2:] in (b"dc", b"db")]
    if index is not None:
        frames = [bytes(data[base + at + 8 : base + at + 8 + n]) for _, _, at, n in index]
    else:
        frames = [bytes(data[a:b]) for name, a, b in _chunks(data, *movi) if name[2:] in (b"dc", b"db")]
    return Avi(frames, size, fps)


@dataclass(frozen=True)
class Coding:
    """What a frame's header says: for each of the DC and AC table, by the next 16 bits, 256 times a code's length plus its symbol."""

    codes: np.ndarray
    quantiser: np.ndarray
    every: int  # blocks of a restart interval, 0 for all
    width: int
    height: int

    @property
    def blocks(self) -> int:
        return -(-self.width // 8) * -(-self.height // 8)


_codings: dict[bytes, Coding] = {}


def _coding(frame: bytes) -> tuple[Coding, int]:
    """(coding, first byte of the scan) of a grey baseline frame."""
    at = 2
    while frame[at + 1] != 0xDA:
        at += 2 + int.from_bytes(frame[at + 2 : at + 4], "big")
    at += 2 + int.from_bytes(frame[at + 2 : at + 4], "big")
    if (header := frame[:at]) not in _codings:
        if len(_codings) > 64:
            _codings.clear()
        _codings[header] = _parsed(header)
    return _codings[header], at


def _parsed(header: bytes) -> Coding:
    at, tables, quantiser, every, width, height = 2, {}, np.ones(64, np.int64), 0, 0, 0
    while at < len(header):
        marker, size = struct.unpack_from(">xBH", header, at)
        body = header[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            quantiser = np.frombuffer(body, np.uint8, 64, 1).astype(np.int64) if body[0] < 16 else np.frombuffer(body, ">u2", 64, 1).astype(np.int64)
        elif marker == 0xC0:
            _, height, width, parts = struct.unpack_from(">BHHB", body)
            if parts != 1:
                raise ValueError("only grey frames are read")
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline frames are read")
        elif marker == 0xC4:
            while body:
                kind, counts, symbols = body[0], body[1:17], body[17:]
                by_bits, code = np.zeros(1 << 16, np.uint32), 0
                for length, n in enumerate(counts, 1):
                    for _ in range(n):
                        room = 1 << 16 - length
                        by_bits[code * room : (code + 1) * room] = length << 8 | symbols[0]
                        symbols, code = symbols[1:], code + 1
                    code <<= 1
                tables[kind] = by_bits
                body = symbols
        elif marker == 0xDD:
            every = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            chosen = tables[body[2] >> 4], tables[16 + (body[2] & 15)]
    return Coding(np.concatenate(chosen), quantiser, every, width, height)


def decode_frames(frames: list[bytes]) -> list[np.ndarray]:
    """Of each grey baseline frame the coefficients in zigzag order times their quantisers, a row for each block."""
    out: list[np.ndarray] = [np.zeros((0, 64), np.int64)] * len(frames)
    alike: dict[int, list[tuple[int, int]]] = {}
    codings: dict[int, Coding] = {}
    for i, f in enumerate(frames):
        coding, at = _coding(f)
        codings[id(coding)] = coding
        alike.setdefault(id(coding), []).append((i, at))
    for key, places in alike.items():
        for a in range(0, len(places), AT_ONCE):
            part = places[a : a + AT_ONCE]
            rows = _decoded(codings[key], [frames[i][at : frames[i].rindex(b"\xff\xd9")] for i, at in part])
            for (i, _), own in zip(part, rows.reshape(len(part), -1, 64), strict=True):
                out[i] = own
    return out


def _decoded(coding: Coding, scans: list[bytes]) -> np.ndarray:
    """Coefficients of all blocks of scans that share a coding."""
    data = np.frombuffer(b"".join(scans) + b"\0", np.uint8)
    begins = np.cumsum([0, *map(len, scans)])
    mark = np.flatnonzero(data[:-1] == 0xFF)
    after = data[mark + 1]
    restarts = mark[(after >= 0xD0) & (after <= 0xD7)]
    gone = np.zeros(len(data), bool)  # the zero that follows a data byte FF, and restart markers
    gone[mark[after == 0] + 1] = True
    gone[restarts] = gone[restarts + 1] = True
    place = np.concatenate([[0], np.cumsum(~gone)])
    clean = np.concatenate([data[~gone], np.zeros(8, np.uint8)]).astype(np.uint64)
    words = clean[:-4] << np.uint64(32) | clean[1:-3] << np.uint64(24) | clean[2:-2] << np.uint64(16) | clean[3:-1] << np.uint64(8) | clean[4:]
    # Intervals: where they begin, in bits, their first block and number of blocks.
    starts = np.sort(np.concatenate([begins[:-1], restarts + 2]))
    frame = np.searchsorted(begins, starts, side="right") - 1
    nth = np.arange(len(starts)) - np.searchsorted(starts, begins[:-1])[frame]
    every = coding.every or coding.blocks
    block = frame * coding.blocks + nth * every
    left = np.minimum(every, coding.blocks - nth * every)
    bit, stop = place[starts] * 8, np.append(place[starts][1:], place[begins[-1]]) * 8
    live = left > 0
    bit, stop, block, left = bit[live], stop[live], block[live], left[live]
    k, last = np.zeros(len(bit), np.int64), np.zeros(len(bit), np.int64)
    out = np.zeros(len(scans) * coding.blocks * 64, np.int64)
    top = lambda at, n: (words[at >> 3] >> (np.uint64(40) - (at & 7).astype(np.uint64) - n)) & ((np.uint64(1) << n) - np.uint64(1))
    sixteen = np.uint64(16)
    while len(bit):
        if (bit >= stop).any():
            raise ValueError("a scan ends before its blocks do")
        code = coding.codes[top(bit, sixteen).astype(np.int64) + (k > 0) * (1 << 16)].astype(np.int64)
        if not code.all():
            raise ValueError("no such code")
        run, size = code >> 4 & 15, code & 15
        run[k == 0] = 0
        bit = bit + (code >> 8)
        value = top(bit, size.astype(np.uint64)).astype(np.int64)
        value = np.where((size > 0) & (value >> np.maximum(size - 1, 0) == 0), value - (1 << size) + 1, value)
        bit = bit + size
        first = k == 0
        last = np.where(first, last + value, last)
        ends = ~first & (size == 0) & (run != 15)
        k = np.where(ends, 64, k + run)
        put = (k < 64) & (first | (size > 0))
        out[block[put] * 64 + k[put]] = np.where(first, last, value)[put]
        k = k + 1
        done = k >= 64
        if done.any():
            k[done] = 0
            block, left = block + done, left - done
            live = left > 0
            if not live.all():
                bit, stop, block, left, k, last = bit[live], stop[live], block[live], left[live], k[live], last[live]
    return out.reshape(-1, 64) * coding.quantiser


def payload_of(rows: np.ndarray, size: int | None) -> bytes:
    """The bytes that the coefficients stand for."""
    data = np.where(rows < 0, rows + 255, rows).astype(np.uint8).tobytes()
    return data if size is None else data[:size]


def luma(frames: list[np.ndarray]) -> np.ndarray:
    """Histograms of frames' pixels, as shares, a row each."""
    out = np.zeros((len(frames), BINS))
    for i, blocks in enumerate(frames):
        pixels = np.clip(blocks.astype(np.float32) @ INVERSE + 128, 0, 255).astype(np.uint8)
        out[i] = np.bincount((pixels >> 4).ravel(), minlength=BINS) / pixels.size
    return out


def clips(histograms: np.ndarray) -> list[tuple[int, int]]:
    """(first frame, end frame) of each shot. A cut needs a difference over LEAST and over the mean of the last WINDOW differences of
    the shot by SPREAD deviations."""
    out, start, seen = [], 0, []
    for i in range(1, len(histograms)):
        d = float(np.abs(histograms[i] - histograms[i - 1]).sum() / 2)
        last = seen[-WINDOW:]
        limit = max(LEAST, float(np.mean(last) + SPREAD * np.std(last)) if len(last) > 1 else 2 * LEAST)
        if d > limit:
            out.append((start, i))
            start, seen = i, []
        else:
            seen.append(d)
    return [*out, (start, len(histograms))] if len(histograms) else []


def padded(text: bytes) -> bytes:
    return text + b"\0" * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def clip_rows(media: bytes) -> list[tuple[int, int, float, float]]:
    """(first frame, end frame, start second, end second) of each shot of a grey motion-JPEG AVI."""
    avi = read_avi(media)
    return [(a, b, a / avi.fps, b / avi.fps) for a, b in clips(luma(decode_frames(avi.frames)))]


def measured(files: list[bytes]) -> list[tuple[bytes, str]]:
    """(payload, feature) read from each of some stored files, whose frames are decoded together."""
    avis = [read_avi(m) for m in files]
    decoded = iter(decode_frames([f for a in avis for f in a.frames]))
    out = []
    for avi in avis:
        blocks = [next(decoded) for _ in avi.frames]
        hists = luma(blocks)
        mean = hists.mean(0) if len(hists) else np.zeros(BINS)
        shots = clips(hists)
        times = ",".join(f"{1000 * a // FPS}-{1000 * b // FPS}" for a, b in shots)
        rows = np.concatenate(blocks) if blocks else np.zeros((0, 64), np.int64)
        out.append((payload_of(rows, avi.payload_bytes), f"frames={len(blocks)};shots={len(shots)};ms={times};luma={' '.join(f'{x:.3f}' for x in mean)}"))
    return out


def media_columns(docs: DataFrame) -> DataFrame:
    """One row per document: its text stored as AVI and read back. No shuffle."""

    def read(held: list[tuple]) -> Iterator[tuple]:
        for (doc_id, n, media), (back, feature) in zip(held, measured([m for *_, m in held]), strict=True):
            yield doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature

    def rows(docs: Iterable[tuple]) -> Iterator[tuple]:
        held, size = [], 0
        for doc_id, text in docs:
            held.append((doc_id, len(text), write_avi(padded(text))))
            size += len(text)
            if size >= TOGETHER or len(held) >= AT_ONCE:
                yield from read(held)
                held, size = [], 0
        if held:
            yield from read(held)

    return common.map_docs(common.as_docs(docs), rows, SCHEMA, "doc_id")


def op10_media_avi(spark, sf_dir: str) -> DataFrame:
    return media_columns(common.table(spark, sf_dir, "documents"))
