"""ISO base media files: boxes, sample tables, keyframe byte ranges.

``probe`` walks the nested boxes of each file, decodes the sample tables of each track (also those of
movie fragments) and gives codec, duration and the byte ranges of the keyframes.  Payloads are
never decoded: an ``mdat`` box is stepped over by its size.  ``text_to_media`` stores bytes as a raw
track of fixed-size 8-bit frames, so that every text has a file whose tables can be held against it.

Defined results: a null or empty file has no tracks and the error ``empty``; a box that runs past its
parent, a table that runs past its box, boxes nested too deep, a count of more equal samples than the file has
bytes for, or an offset or duration beyond 2**62 gives the error that names it and no tracks, never a failed task;
a duration of all ones is unknown, so that of the sample table counts; a file
without ``moov`` has no tracks and no error; null text counts as empty and becomes one frame of
spaces; texts of any length are stored whole; equal contents give equal results, whichever rows they are in,
so repeated rows repeat; an empty table gives an empty result; clashing names: see ``common.beside``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioscope.llm.common import beside

#: Boxes whose payload is boxes only.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"mvex", b"moof", b"traf"}
#: Frames of FRAME bytes (WIDTH x HEIGHT grey samples), one keyframe and one chunk for each GROUP of them.
WIDTH, HEIGHT, GROUP, RATE = 16, 12, 12, 25
FRAME = WIDTH * HEIGHT
#: Containers inside containers (real files have 6 levels), the largest offset, and the durations that mean "unknown".
DEEPEST, FARTHEST, UNKNOWN = 24, 1 << 62, ((1 << 32) - 1, (1 << 64) - 1)
#: How many equal samples of a track or a run are listed one by one where all of them are keyframes.
LISTED = 1 << 16


class MediaError(ValueError):
    pass


@dataclass
class Track:
    track_id: int = 0
    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    stts: np.ndarray | None = None
    sync: np.ndarray | None = None
    stsc: np.ndarray | None = None
    sizes: np.ndarray | None = None  # one for each sample, or ``size`` for all ``count``
    size: int = 0
    count: int = 0
    chunks: np.ndarray | None = None
    fragments: list[np.ndarray] = field(default_factory=list)  # rows of offset, size, sync
    in_fragments: int = 0

    @property
    def n_samples(self) -> int:
        return self.count + self.in_fragments

    def listed_duration(self) -> int:
        if self.stts is None or not len(self.stts):
            return 0
        rows = self.stts.astype(np.float64)
        if rows[:, 0] @ rows[:, 1] >= FARTHEST:
            raise MediaError("duration out of range")
        return int((self.stts[:, 0].astype(np.int64) * self.stts[:, 1].astype(np.int64)).sum())

    def _chunked(self) -> tuple[np.ndarray, np.ndarray]:
        """The offset of each chunk that holds samples, and how many samples come before its end."""
        if not self.count:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.stsc is None or self.chunks is None or not len(self.stsc) or not len(self.chunks):
            raise MediaError("samples without chunks")
        if self.chunks.max() > FARTHEST:
            raise MediaError("chunk offset out of range")
        first = self.stsc[:, 0].astype(np.int64) - 1
        runs = np.diff(np.append(first, len(self.chunks)))
        if (runs < 0).any() or first[0] != 0:
            raise MediaError("stsc out of order")
        # Counts are summed, never laid out: a chunk may claim more samples than there are.
        upto = np.cumsum(np.repeat(self.stsc[:, 1].astype(np.int64), runs))
        if upto[-1] < self.count:
            raise MediaError("chunks hold fewer samples than stsz")
        used = int(np.searchsorted(upto, self.count)) + 1
        return self.chunks[:used].astype(np.int64), np.minimum(upto[:used], self.count)

    def _bytes_before(self, samples: np.ndarray) -> np.ndarray:
        if self.sizes is None:
            return samples * self.size
        return np.concatenate(([0], np.cumsum(self.sizes, dtype=np.int64)))[samples]

    def byte_ranges(self) -> tuple[np.ndarray, np.ndarray]:
        """Offset and size of what the samples hold, in decoding order: a range for each chunk and each listed sample or run of a fragment."""
        offsets, upto = self._chunked()
        sizes = np.diff(self._bytes_before(np.concatenate(([0], upto))))
        more = np.concatenate([np.zeros((0, 3), np.int64), *self.fragments])
        return np.append(offsets, more[:, 0]), np.append(sizes, more[:, 1])

    def keyframes(self) -> tuple[np.ndarray, np.ndarray]:
        """Offset and size of each keyframe; more than LISTED equal samples that are keyframes all have a range for each chunk."""
        offsets, upto = self._chunked()
        start = np.concatenate(([0], upto))[:-1]
        if self.sync is None and self.sizes is None and self.count > LISTED:
            found = offsets, (upto - start) * self.size
        else:
            key = np.arange(self.count)
            if self.sync is not None:
                key = np.unique(self.sync.astype(np.int64) - 1)
                key = key[(key >= 0) & (key < self.count)]
            chunk = np.searchsorted(upto, key, side="right")
            found = offsets[chunk] + self._bytes_before(key) - self._bytes_before(start)[chunk], np.full(len(key), self.size, np.int64) if self.sizes is None else self.sizes[key].astype(np.int64)
        more = np.concatenate([np.zeros((0, 3), np.int64), *self.fragments])
        more = more[more[:, 2] > 0]
        return np.append(found[0], more[:, 0]), np.append(found[1], more[:, 1])


def boxes(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int, int]]:
    """(kind, start of the box, start of its payload, end) of each box between start and end."""
    while start < end:
        if end - start < 8:
            raise MediaError(f"{end - start} bytes left over at {start}")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if end - start < 16:
                raise MediaError(f"truncated box at {start}")
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise MediaError(f"box {kind.decode('latin-1')} at {start} runs past its parent")
        yield kind, start, start + head, start + size
        start += size


def _table(data: bytes, at: int, end: int, kind: bytes, columns: int, code: str = ">u4", skip: int = 4) -> np.ndarray:
    _need(at, skip + 4, end, kind)
    count = struct.unpack_from(">I", data, at + skip)[0]
    width = np.dtype(code).itemsize
    _need(at, skip + 4 + count * columns * width, end, kind)
    out = np.frombuffer(data, code, count * columns, at + skip + 4)
    return out.reshape(count, columns) if columns > 1 else out


def _need(at: int, n: int, end: int, kind: bytes) -> None:
    if at + n > end:
        raise MediaError(f"{kind.decode('latin-1')} runs past its box")


def parse(data: bytes) -> list[Track]:
    """The tracks of a file; every count is held against the bytes that are left, so work and memory grow with the file only."""
    tracks: list[Track] = []
    defaults: dict[int, tuple[int, int]] = {}  # trex: size and flags by track
    state: dict = {}

    def walk(start: int, end: int, of: Track | None, depth: int) -> None:
        if depth > DEEPEST:
            raise MediaError(f"boxes nested too deep at {start}")
        for kind, box, at, stop in boxes(data, start, end):
            track = of
            if kind == b"trak":
                tracks.append(track := Track())
            if kind == b"moof":
                state.update({"moof": box, "next": None, "track": None})
            if kind in CONTAINERS:
                walk(at, stop, track, depth + 1)
                continue
            if kind == b"trex":
                _need(at, 24, stop, kind)
                _, tid, _, _, size, flags = struct.unpack_from(">IIIIII", data, at)
                defaults[tid] = size, flags
            elif kind == b"tfhd":
                _fragment_head(at, stop)
            elif kind == b"trun":
                _fragment_run(at, stop)
            elif track is not None:
                _leaf(kind, at, stop, track)

    def _claim(size: int, kind: bytes) -> None:
        # Samples that no table lists one by one have bytes of their own.
        state["claimed"] = state.get("claimed", 0) + size
        if state["claimed"] > len(data):
            raise MediaError(f"{kind.decode()} counts more samples than the file has bytes for")

    def _leaf(kind: bytes, at: int, stop: int, track: Track) -> None:
        if kind == b"tkhd":
            _need(at, 24, stop, kind)
            track.track_id = struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))[0]
        elif kind == b"mdhd":
            _need(at, 20, stop, kind)
            if data[at] == 1:
                _need(at, 32, stop, kind)
            track.timescale, length = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
            track.duration = 0 if length == UNKNOWN[data[at] == 1] else length
        elif kind == b"hdlr":
            _need(at, 12, stop, kind)
            track.handler = data[at + 8 : at + 12].decode("latin-1")
        elif kind == b"stsd":
            track.codec = next((k.decode("latin-1") for k, *_ in boxes(data, at + 8, stop)), "")
        elif kind == b"stts":
            track.stts = _table(data, at, stop, kind, 2)
        elif kind == b"stss":
            track.sync = _table(data, at, stop, kind, 1)
        elif kind == b"stsc":
            track.stsc = _table(data, at, stop, kind, 3)
        elif kind == b"stsz":
            _need(at, 12, stop, kind)
            size, count = struct.unpack_from(">II", data, at + 4)
            if size:
                _claim(count * size, kind)
                track.sizes, track.size, track.count = None, size, count
            else:
                track.sizes = _table(data, at, stop, kind, 1, skip=8)
                track.count = len(track.sizes)
        elif kind == b"stco":
            track.chunks = _table(data, at, stop, kind, 1)
        elif kind == b"co64":
            track.chunks = _table(data, at, stop, kind, 1, ">u8")

    def _fragment_head(at: int, stop: int) -> None:
        if "moof" not in state:
            raise MediaError("tfhd outside moof")
        _need(at, 8, stop, b"tfhd")
        flags, tid = struct.unpack_from(">II", data, at)
        flags &= 0xFFFFFF
        _need(at, 8 + 8 * bool(flags & 0x1) + 4 * sum(bool(flags & x) for x in (0x2, 0x8, 0x10, 0x20)), stop, b"tfhd")
        at += 8
        base = state["moof"]
        if flags & 0x1:
            base, at = struct.unpack_from(">Q", data, at)[0], at + 8
        at += 4 * bool(flags & 0x2) + 4 * bool(flags & 0x8)
        size, sample_flags = defaults.get(tid, (0, 0))
        if flags & 0x10:
            size, at = struct.unpack_from(">I", data, at)[0], at + 4
        if flags & 0x20:
            sample_flags = struct.unpack_from(">I", data, at)[0]
        state.update({"base": base, "size": size, "flags": sample_flags, "track": next((t for t in tracks if t.track_id == tid), None), "next": None})

    def _fragment_run(at: int, stop: int) -> None:
        track = state.get("track")
        if track is None:
            raise MediaError("trun of no track")
        _need(at, 8, stop, b"trun")
        flags, count = struct.unpack_from(">II", data, at)
        flags &= 0xFFFFFF
        each = [bool(flags & x) for x in (0x100, 0x200, 0x400, 0x800)]
        _need(at, 8 + 4 * bool(flags & 0x1) + 4 * bool(flags & 0x4) + 4 * count * sum(each), stop, b"trun")
        if not each[1]:
            _claim(count * max(1, state["size"]), b"trun")
        at += 8
        where = state["base"] if state["next"] is None else state["next"]
        if flags & 0x1:
            where, at = state["base"] + struct.unpack_from(">i", data, at)[0], at + 4
        first = None
        if flags & 0x4:
            first, at = struct.unpack_from(">I", data, at)[0], at + 4
        track.in_fragments += count
        if not any(each) and count > LISTED:
            # Equal samples with equal flags are one range each for the first and the others.
            size, others = state["size"], int((state["flags"] & 0x10000) == 0)
            if not 0 <= where <= FARTHEST:
                raise MediaError("trun offset out of range")
            one = others if first is None else int((first & 0x10000) == 0)
            track.fragments.append(np.array([(where, size, one), (where + size, (count - 1) * size, others)], np.int64))
            state["next"] = where + count * size
            return
        rows = np.frombuffer(data, ">u4", count * sum(each), at).reshape(count, sum(each)).astype(np.int64)
        sizes = rows[:, sum(each[:1])] if each[1] else np.full(count, state["size"], np.int64)
        how = rows[:, sum(each[:2])] if each[2] else np.full(count, state["flags"], np.int64)
        if first is not None and count and not each[2]:
            how[0] = first
        if not 0 <= where <= FARTHEST:
            raise MediaError("trun offset out of range")
        ends = where + np.cumsum(sizes)
        track.fragments.append(np.stack((ends - sizes, sizes, (how & 0x10000) == 0), axis=1).astype(np.int64))
        state["next"] = int(ends[-1]) if count else where

    try:
        walk(0, len(data), None, 0)
    except struct.error as e:
        raise MediaError(f"truncated table: {e}") from e
    return tracks


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


#: The unity matrix of movie and track headers.
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
FTYP = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp41")
HDLR = _full(b"hdlr", bytes(4), b"vide", bytes(12), b"grey frames\0")
HEADS = _full(b"vmhd", bytes(8), flags=1) + _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
STSD = _full(b"stsd", struct.pack(">I", 1), _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHII", WIDTH, HEIGHT, 0x480000, 0x480000), bytes(4), struct.pack(">H", 1), bytes(32), struct.pack(">Hh", 40, -1)))


def encode(payload: bytes) -> bytes:
    """A file with one raw track whose frames are the payload; its length is a positive multiple of FRAME."""
    n = len(payload) // FRAME
    groups, last = divmod(n, GROUP)
    chunks = groups + bool(last)
    runs = ([(1, GROUP, 1)] if groups else []) + ([(groups + 1, last, 1)] if last else [])
    wide = len(payload) > 0xF0000000

    def movie(first: int) -> bytes:
        offsets = first + FRAME * GROUP * np.arange(chunks, dtype=np.int64)
        stbl = _box(
            b"stbl", STSD, _full(b"stts", struct.pack(">III", 1, n, 1)), _full(b"stss", struct.pack(">I", chunks), (1 + GROUP * np.arange(chunks)).astype(">u4").tobytes()),
            _full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", *r) for r in runs]), _full(b"stsz", struct.pack(">II", FRAME, n)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
        )
        mdhd = _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0))
        tkhd = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(8), bytes(8), MATRIX, struct.pack(">II", WIDTH << 16, HEIGHT << 16), flags=3)
        mvhd = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, n, 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, _box(b"mdia", mdhd, HDLR, _box(b"minf", HEADS, stbl))))

    head = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) if wide else struct.pack(">I4s", 8 + len(payload), b"mdat")
    moov = movie(len(FTYP) + len(movie(0)) + len(head))
    return b"".join((FTYP, moov, head, payload))


def padded(text: str | None) -> tuple[bytes, int]:
    """The bytes of a text filled with spaces up to a positive multiple of FRAME, and how many it had."""
    b = (text or "").encode("utf-8")
    return b.ljust(max(1, -(-len(b) // FRAME)) * FRAME, b" "), len(b)


def read_back(data: bytes, track: Track) -> bytes:
    offsets, sizes = track.byte_ranges()
    if not len(offsets):
        return b""
    breaks = np.flatnonzero(offsets[1:] != offsets[:-1] + sizes[:-1]) + 1
    starts, ends = offsets[np.append(0, breaks)], (offsets + sizes)[np.append(breaks - 1, len(offsets) - 1)]
    return b"".join(data[a:b] for a, b in zip(starts.tolist(), ends.tolist()))


def feature(track: Track) -> str:
    keys = ",".join(f"{a}+{n}" for a, n in zip(*(x.tolist() for x in track.keyframes())))
    return f"codec={track.codec};handler={track.handler};timescale={track.timescale};duration={track.duration};samples={track.n_samples};keyframes={keys}"


_KEYFRAME = pa.struct([("offset", pa.int64()), ("size", pa.int64())])
_PLAIN = [("track_id", pa.int64()), ("handler", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("seconds", pa.float64()), ("n_samples", pa.int64())]
_TRACK = pa.struct([*_PLAIN, ("keyframes", pa.list_(_KEYFRAME))])


def describe(data: bytes | None) -> tuple[list[tuple], str | None]:
    """The values of _PLAIN and the keyframes' offsets and sizes for each track, or an error."""
    if not data:
        return [], "empty"
    try:
        out = []
        for t in parse(data):
            length = t.duration or t.listed_duration()
            if length > FARTHEST:
                raise MediaError("duration out of range")
            out.append((t.track_id, t.handler, t.codec, t.timescale, length, length / t.timescale if t.timescale else None, t.n_samples, t.keyframes()))
        return out, None
    except (MediaError, IndexError, OverflowError, UnicodeDecodeError, MemoryError) as e:
        return [], str(e) or type(e).__name__


def _lists(lengths: list[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths]), pa.int32()), values)


def _tracks(found: list[list[tuple]]) -> pa.Array:
    tracks = [t for f in found for t in f]
    key = [np.concatenate([np.zeros(0, np.int64), *[t[-1][i] for t in tracks]]) for i in (0, 1)]
    keyframes = _lists([len(t[-1][0]) for t in tracks], pa.StructArray.from_arrays([pa.array(k, pa.int64()) for k in key], fields=list(_KEYFRAME)))
    plain = [pa.array([t[i] for t in tracks], kind) for i, (_, kind) in enumerate(_PLAIN)]
    return _lists([len(f) for f in found], pa.StructArray.from_arrays([*plain, keyframes], fields=list(_TRACK)))


def probe(df: DataFrame, content: str) -> DataFrame:
    """``df`` without the binary column ``content``, with media_tracks and media_error."""

    def start():
        def make(values: pa.Array) -> list[pa.Array]:
            found = [describe(x.as_py()) for x in values]
            return [_tracks([t for t, _ in found]), pa.array([e for _, e in found], pa.string())]

        return make

    return beside(df, content, [pa.field("media_tracks", pa.list_(_TRACK)), pa.field("media_error", pa.string())], start, 64)


DIGESTS = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]


def text_digest(text: str | None) -> tuple:
    """Stores a text as media, reads it back through the sample tables, and gives the digests of both."""
    payload, n = padded(text)
    media = encode(payload)
    track = parse(media)[0]
    back = read_back(media, track)
    return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(track)


def text_to_media(df: DataFrame, text: str) -> DataFrame:
    """``df`` without ``text``, with media (binary)."""
    start = lambda: lambda values: [pa.array([encode(padded(t.as_py())[0]) for t in values], pa.binary())]
    return beside(df, text, [pa.field("media", pa.binary())], start, 64)


def media_digests(df: DataFrame, text: str) -> DataFrame:
    """``df`` without ``text``, with the columns of DIGESTS; files live for one row only."""

    def start():
        def make(values: pa.Array) -> list[pa.Array]:
            rows = [text_digest(t.as_py()) for t in values]
            return [pa.array(list(c), kind) for c, (_, kind) in zip(zip(*rows), DIGESTS)]

        return make

    return beside(df, text, [pa.field(*d) for d in DIGESTS], start)
