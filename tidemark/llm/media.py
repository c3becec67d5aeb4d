"""ISO media containers: writing bytes as uncompressed audio samples, and indexing any container's boxes.

The index walks nested boxes and decodes the sample tables of every track, and
those of movie fragments: codec, time scale, duration, and byte ranges of
samples and key frames. Payloads are never decoded. Every count is compared
with the bytes that there are before anything of its size is made.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes per sample, samples per chunk, and samples from one key frame to the next, as written here.
UNIT, CHUNK, KEY_EVERY, RATE = 192, 64, 16, 8000
CONTAINERS = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"))
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


FTYP = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"iso2")
HDLR = full(b"hdlr", bytes(4), b"soun", bytes(12), b"samples\0")
DINF = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
STSD = full(b"stsd", struct.pack(">I", 1), box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16)))


def padded(data: bytes, unit: int = UNIT) -> bytes:
    """``data`` with spaces up to a positive multiple of ``unit`` bytes."""
    return data + b" " * (-len(data) % unit if data else unit)


def container(payload: bytes) -> bytes:
    """A file whose only track holds ``payload`` as unsigned 8-bit samples, in units of UNIT bytes."""
    count = len(payload) // UNIT
    duration = count * UNIT
    chunks = -(-count // CHUNK)
    wide = len(payload) > 0xF000_0000
    runs = [(1, CHUNK, 1)] if count >= CHUNK else []
    if count % CHUNK:
        runs.append((count // CHUNK + 1, count % CHUNK, 1))
    keys = np.arange(1, count + 1, KEY_EVERY, dtype=">u4")

    def moov(first: int) -> bytes:
        offsets = first + np.arange(chunks, dtype=np.int64) * (CHUNK * UNIT)
        stbl = box(
            b"stbl",
            STSD,
            full(b"stts", struct.pack(">III", 1, count, UNIT)),
            full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", *r) for r in runs]),
            full(b"stsz", struct.pack(">II", UNIT, count)),
            full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
        )
        mdhd = full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, duration, 0x55C4, 0), version=1)
        minf = box(b"minf", full(b"smhd", bytes(4)), DINF, stbl)
        tkhd = full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, duration), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), MATRIX, bytes(8), version=1, flags=7)
        mvhd = full(b"mvhd", struct.pack(">QQIQ", 0, 0, RATE, duration), struct.pack(">IH", 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2), version=1)
        return box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, HDLR, minf)))

    head = 16 if len(payload) + 8 > 0xFFFF_FFFF else 8
    first = len(FTYP) + len(moov(0)) + head
    mdat = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if head == 16 else struct.pack(">I4s", len(payload) + 8, b"mdat")
    return b"".join((FTYP, moov(first), mdat, payload))


def boxes(data, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, first byte and end of each box's body in [start, end); stops where a size doesn't fit."""
    while end - start >= 8:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1 and end - start >= 16:
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        stop = end if size == 0 else start + size
        if stop < body or stop > end:
            return
        yield kind, body, stop
        start = stop


def layout(data) -> tuple[list[dict], dict[int, tuple[int, ...]], list[tuple[int, list[dict]]]]:
    """Tracks with a sample description (kind of box to its place), defaults of fragments by track number, and fragments.

    A fragment is the first byte of its box and, per track in it, the places
    of its header (``tfhd``) and of its runs (``trun``, a list).
    """
    found: list[dict] = []
    defaults: dict[int, tuple[int, ...]] = {}
    fragments: list[tuple[int, list[dict]]] = []

    def walk(start: int, end: int, into: dict, depth: int) -> None:
        for kind, a, b in boxes(data, start, end):
            if kind == b"trak":
                own: dict = {}
                walk(a, b, own, depth + 1)
                if b"stsd" in own:
                    found.append(own)
            elif kind == b"moof":
                fragments.append((start, []))
                walk(a, b, {}, depth + 1)
            elif kind == b"traf":
                own = {b"trun": []}
                walk(a, b, own, depth + 1)
                if fragments and b"tfhd" in own:
                    fragments[-1][1].append(own)
            elif kind == b"trun" and b"trun" in into:
                into[kind].append((a, b))
            elif kind == b"trex" and b - a >= 24:
                _, number, *rest = struct.unpack_from(">6I", data, a)
                defaults[number] = tuple(rest)
            elif kind in CONTAINERS and depth < 16:
                walk(a, b, into, depth + 1)
            else:
                into.setdefault(kind, (a, b))
            start = b

    walk(0, len(data), {}, 0)
    return found, defaults, fragments


def _array(data, at: tuple[int, int], skip: int, count: int, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    if skip + count * width > at[1] - at[0]:
        raise ValueError("a table ends early")
    return np.frombuffer(data, kind, count, at[0] + skip).astype(np.int64)


def _table(data, at: tuple[int, int], fields: int, kind: str = ">u4") -> np.ndarray:
    """A table that begins with its number of entries, of ``fields`` numbers each."""
    return _array(data, at, 8, fields * struct.unpack_from(">I", data, at[0] + 4)[0], kind).reshape(-1, fields)


def _sizes(data, at: dict) -> np.ndarray:
    """Sizes of a track's samples, from either form of the table."""
    if b"stsz" in at:
        fixed, count = struct.unpack_from(">II", data, at[b"stsz"][0] + 4)
        if fixed and fixed * count > len(data):
            raise ValueError("more samples than bytes")
        return np.full(count, fixed, np.int64) if fixed else _array(data, at[b"stsz"], 12, count, ">u4")
    bits, count = struct.unpack_from(">II", data, at[b"stz2"][0] + 4)
    bits &= 255
    if bits not in (4, 8, 16):
        raise ValueError("an unknown size of sizes")
    if bits != 4:
        return _array(data, at[b"stz2"], 12, count, f">u{bits // 8}")
    pairs = _array(data, at[b"stz2"], 12, (count + 1) // 2, ">u1")
    return np.stack([pairs >> 4, pairs & 15], axis=1).ravel()[:count]


def _samples(data, at: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets and sizes of a track's samples, and which are key samples, from the tables of the movie box."""
    for kind in (b"stsc", b"stts"):
        if kind not in at:
            raise ValueError(f"no {kind.decode()} box")
    if b"stsz" not in at and b"stz2" not in at:
        raise ValueError("no stsz box")
    if b"stco" not in at and b"co64" not in at:
        raise ValueError("no chunk offsets")
    sizes = _sizes(data, at)
    count = len(sizes)
    chunks = (_table(data, at[b"stco"], 1) if b"stco" in at else _table(data, at[b"co64"], 1, ">u8")).ravel()
    runs = _table(data, at[b"stsc"], 3)
    repeats = np.diff(np.append(runs[:, 0], len(chunks) + 1))
    if (len(runs) and runs[0, 0] != 1) or (repeats < 0).any() or (len(chunks) and not len(runs)):
        raise ValueError("the sample tables contradict each other")
    held = np.repeat(runs[:, 1], repeats)
    key = np.ones(count, bool)  # without the table every sample is a key sample
    if b"stss" in at:
        keys = _table(data, at[b"stss"], 1).ravel()
        if len(keys) and not 1 <= keys.min() <= keys.max() <= count:
            raise ValueError("the sample tables contradict each other")
        key[:] = False
        key[keys - 1] = True
    if held.sum() != count:
        raise ValueError("the sample tables contradict each other")
    before = np.cumsum(sizes) - sizes
    first = np.repeat(np.cumsum(held) - held, held)  # a sample's chunk's first sample
    return (np.repeat(chunks, held) + before - before[first] if count else before), sizes, key


def _run(data, run: tuple[int, int], size: int, flags: int, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, sizes and keys of one run of a fragment's samples; without an offset of its own it begins at ``at``."""
    head, count = struct.unpack_from(">II", data, run[0])
    head, place, first = head & 0xFFFFFF, run[0] + 8, None
    if head & 0x1:
        at += struct.unpack_from(">i", data, place)[0]
        place += 4
    if head & 0x4:
        first, place = struct.unpack_from(">I", data, place)[0], place + 4
    fields = [bit for bit in (0x100, 0x200, 0x400, 0x800) if head & bit]
    if not fields and (size * count > len(data) or count > len(data)):
        raise ValueError("more samples than bytes")
    rows = _array(data, run, place - run[0], count * len(fields), ">u4").reshape(count, len(fields))
    sizes = rows[:, fields.index(0x200)] if 0x200 in fields else np.full(count, size, np.int64)
    marks = rows[:, fields.index(0x400)].copy() if 0x400 in fields else np.full(count, flags, np.int64)
    if first is not None and count:
        marks[0] = first
    return at + np.cumsum(sizes) - sizes, sizes, marks & 0x10000 == 0


def _fragment(data, start: int, traf: dict, defaults: dict[int, tuple[int, ...]]) -> tuple[int, list]:
    """Number of a fragment's track, and its runs."""
    head, number = struct.unpack_from(">II", data, traf[b"tfhd"][0])
    place = traf[b"tfhd"][0] + 8
    _, _, size, flags = defaults.get(number, (0, 0, 0, 0))
    base = start
    for bit, kind in ((0x1, ">Q"), (0x2, ">I"), (0x8, ">I"), (0x10, ">I"), (0x20, ">I")):
        if head & bit:
            value = struct.unpack_from(kind, data, place)[0]
            place += struct.calcsize(kind)
            base, size, flags = (value if bit == 0x1 else base), (value if bit == 0x10 else size), (value if bit == 0x20 else flags)
    if base > len(data):
        raise ValueError("samples lie beyond the end")
    runs, at = [], base
    for run in traf[b"trun"]:
        own = struct.unpack_from(">I", data, run[0])[0] & 0x1
        runs.append(_run(data, run, size, flags, base if own else at))
        at = int(runs[-1][0][-1] + runs[-1][1][-1]) if len(runs[-1][0]) else at
    return number, runs


def indexed(data: bytes) -> dict:
    """The main track (the first with pictures, else the first) as a dictionary, and all of them under ``tracks``.

    Each has codec, time_scale, duration (in its units; None if unknown), and
    arrays: offsets and sizes of samples, numbers of key samples. Samples of
    movie fragments follow those of the movie box. Raises ValueError where the
    container has no readable tables, or samples outside the file.
    """
    try:
        found, defaults, fragments = layout(data)
        if not found:
            raise ValueError("no stsd box")
        runs: dict[int, list] = {}
        for start, trafs in fragments:
            for traf in trafs:
                number, more = _fragment(data, start, traf, defaults)
                runs.setdefault(number, []).extend(more)
        tracks = [_track(data, at, runs) for at in found]
    except (struct.error, IndexError) as error:
        raise ValueError("a table ends early") from error
    main = next((t for t in tracks if t["handler"] == "vide"), tracks[0])
    return main | {"tracks": tracks}


def _track(data, at: dict, runs: dict[int, list]) -> dict:
    if b"mdhd" not in at:
        raise ValueError("no mdhd box")
    a = at[b"mdhd"][0]
    scale, duration = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 else struct.unpack_from(">II", data, a + 12)
    if duration in (0xFFFF_FFFF, 0xFFFF_FFFF_FFFF_FFFF):
        duration = None
    elif duration >= 1 << 63:
        raise ValueError("no such duration")
    codec = data[at[b"stsd"][0] + 12 : at[b"stsd"][0] + 16].decode("latin-1")
    handler = data[at[b"hdlr"][0] + 8 : at[b"hdlr"][0] + 12].decode("latin-1") if b"hdlr" in at else ""
    number = 0
    if b"tkhd" in at:
        b = at[b"tkhd"][0]
        number = struct.unpack_from(">I", data, b + (20 if data[b] == 1 else 12))[0]
    parts = [_samples(data, at), *runs.get(number, [])]
    offsets, sizes, key = (np.concatenate([p[i] for p in parts]) for i in range(3))
    if len(sizes) and ((offsets < 0).any() or (offsets + sizes).max() > len(data) or sizes.sum() > len(data)):
        raise ValueError("samples lie beyond the end, or on each other")
    return {
        "codec": codec, "handler": handler, "time_scale": scale, "duration": duration, "ticks": sum(n * t for n, t in _table(data, at[b"stts"], 2).tolist()),
        "offsets": offsets, "sizes": sizes, "keys": np.flatnonzero(key) + 1,
    }


def payload(data: bytes, index: dict) -> bytes:
    """The stored samples in order; neighbouring samples are copied together."""
    offsets, sizes = index["offsets"], index["sizes"]
    if not len(offsets):
        return b""
    cut = np.flatnonzero(offsets[1:] != offsets[:-1] + sizes[:-1]) + 1
    starts = offsets[np.append(0, cut)]
    ends = (offsets + sizes)[np.append(cut, len(offsets)) - 1]
    return b"".join([data[a:b] for a, b in zip(starts.tolist(), ends.tolist())])


def key_ranges(index: dict) -> np.ndarray:
    """Offset and size of every key sample."""
    k = index["keys"] - 1
    return np.stack([index["offsets"][k], index["sizes"][k]], axis=1) if len(k) else np.empty((0, 2), np.int64)


def stored(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` (key, text) to key, n_bytes, media: each whole text as an ISO media file.

    A null text counts as empty; equal texts give equal files; repeated rows,
    null keys and an empty table give as many rows; other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()

    def write(batches):
        for batch in batches:
            texts = [(x.as_py() or "").encode() for x in batch.column(1)]
            media = [container(padded(x)) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array(media, pa.binary())], [key, "n_bytes", "media"]
            )

    return docs.select(key, "text").mapInArrow(write, f"`{key}` {kind}, n_bytes long, media binary")


INDEX_SCHEMA = (
    "codec string, time_scale long, duration long, n_samples long, key_offsets array<long>, key_sizes array<long>, "
    "media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string, error string, "
    "tracks array<string>"
)


def described(track: dict) -> str:
    """A track in a line: codec, time scale, duration, samples, key samples, and a checksum of their byte ranges."""
    ranges = key_ranges(track)
    return (
        f"codec={track['codec'].strip()};scale={track['time_scale']};duration={track['duration']};samples={len(track['sizes'])};"
        f"keys={len(ranges)};ranges={zlib.crc32(ranges.astype('<i8').tobytes()):08x}"
    )


def _row(data: bytes | None) -> dict:
    row = dict.fromkeys([x.split()[0] for x in INDEX_SCHEMA.split(", ")])
    if data is None:
        return row | {"error": "null"}
    row |= {"media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest()}
    try:
        index = indexed(data)
    except ValueError as error:
        return row | {"error": str(error)}
    body, ranges, feature = payload(data, index), key_ranges(index), described(index)
    return row | {
        "codec": index["codec"], "time_scale": index["time_scale"], "duration": index["duration"], "n_samples": len(index["sizes"]),
        "key_offsets": ranges[:, 0], "key_sizes": ranges[:, 1], "payload_bytes": len(body), "payload_sha256": hashlib.sha256(body).hexdigest(),
        "tail_crc32": zlib.crc32(body[-16:]), "feature": feature, "tracks": [described(t) for t in index["tracks"]],
    }


def media_index(media: DataFrame, column: str = "media") -> DataFrame:
    """Replace a binary column by what its containers' tables say (INDEX_SCHEMA).

    A null gives error ``null``; a file that isn't a readable container, or
    whose tables claim more than it has, gives null values and an error text
    instead of failing the job. The values are those of the main track
    (``indexed``); ``tracks`` describes all. Files are read whole; repeated
    rows and an empty table give as many rows. Other columns stay, unless they
    have a name of INDEX_SCHEMA: those are replaced.
    """
    names = [x.split()[0] for x in INDEX_SCHEMA.split(", ")]
    others = [c for c in media.columns if c != column and c not in names]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema if f.name in others)

    def read(batches):
        kinds = {"string": pa.string(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
        target = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in INDEX_SCHEMA.split(", "))])
        for batch in batches:
            rows = [_row(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            columns = [pa.array([r[f.name] for r in rows], f.type) for f in target]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*batch.schema.names[:-1], *target.names])

    return media.select(*[f"`{c}`" for c in others], f"`{column}`").mapInArrow(read, f"{schema}, {INDEX_SCHEMA}" if others else INDEX_SCHEMA)
