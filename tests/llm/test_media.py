import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.fixtures import ROWS, clashing, docs, empty
from tidemark.llm import media
from tidemark.llm.media import box, full


def test_every_text_round_trips(spark):
    got = media.media_index(media.stored(docs(spark))).collect()
    assert len(got) == len(ROWS)
    texts = {}
    for i, t, *_ in ROWS:
        b = (t or "").encode()
        b += b" " * (-len(b) % 192 if b else 192)
        texts.setdefault(i, set()).add((len((t or "").encode()), len(b), hashlib.sha256(b).hexdigest(), zlib.crc32(b[-16:])))
    for r in got:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) in texts[r.doc_id]
        assert r.error is None and r.codec == "raw " and r.duration == r.payload_bytes


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=40_000))
def test_container_round_trip(data):
    stored = media.container(media.padded(data))
    index = media.indexed(stored)
    assert media.payload(stored, index) == media.padded(data)
    for at, size in media.key_ranges(index):
        assert stored[at : at + size] == media.padded(data)[at - index["offsets"][0] :][:size]
    assert len(media.key_ranges(index)) == -(-len(index["sizes"]) // media.KEY_EVERY)


def sample_file(sizes, chunks, runs, keys=None, wide=False, before=b"", version=0):
    """A video track by hand, with samples of any sizes in any chunks."""
    data = [bytes([i % 251]) * n for i, n in enumerate(sizes)]
    mdat = box(b"mdat", *data)
    first = len(before) + 8
    at = first + np.cumsum([0, *sizes])
    held = [n for a, n, stop in runs for _ in range(stop - a)]
    starts = np.cumsum([0, *held])[:-1]
    offsets = [int(at[s]) for s in starts][:chunks]
    entry = box(b"avc1", bytes(78), box(b"avcC", b"\x01"))
    parts = [
        full(b"stsd", struct.pack(">I", 1), entry),
        full(b"stts", struct.pack(">III", 1, len(sizes), 10)),
        full(b"stsz", struct.pack(">II", 0, len(sizes)), struct.pack(f">{len(sizes)}I", *sizes)),
        full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", a, n, 1) for a, n, _ in runs]),
        full(b"co64", struct.pack(">I", chunks), struct.pack(f">{chunks}Q", *offsets)) if wide else full(b"stco", struct.pack(">I", chunks), struct.pack(f">{chunks}I", *offsets)),
    ]
    if keys is not None:
        parts.append(full(b"stss", struct.pack(">I", len(keys)), struct.pack(f">{len(keys)}I", *keys)))
    mdhd = full(b"mdhd", struct.pack(">QQIQ", 0, 0, 90, 900) if version else struct.pack(">IIII", 0, 0, 90, 900), bytes(4), version=version)
    moov = box(b"moov", box(b"trak", box(b"mdia", mdhd, box(b"minf", box(b"stbl", *parts)))))
    return before + mdat + moov, data


@pytest.mark.parametrize("wide,version,before", [(False, 0, b""), (True, 1, box(b"ftyp", b"isom", bytes(4))), (False, 0, box(b"free", bytes(99)))])
def test_foreign_tables(wide, version, before):
    sizes = [5, 1, 9, 30, 2, 2, 7]
    stored, data = sample_file(sizes, 3, [(1, 3, 3), (3, 1, 4)], [1, 4], wide, before, version)
    index = media.indexed(stored)
    assert (index["codec"], index["time_scale"], index["duration"], index["ticks"]) == ("avc1", 90, 900, 70)
    assert [stored[a : a + n] for a, n in zip(index["offsets"], index["sizes"])] == data
    assert [stored[a : a + n] for a, n in media.key_ranges(index)] == [data[0], data[3]]


def test_without_key_table_all_samples_are_keys():
    stored, data = sample_file([3, 4], 1, [(1, 2, 2)])
    assert len(media.key_ranges(media.indexed(stored))) == 2


def test_broken_files_give_errors(spark):
    good = media.container(media.padded(b"x" * 500))
    bad = [None, b"", b"abc", good[:-1], good[:300], good.replace(b"stco", b"stxx"), bytes(50), b"\xff" * 100, good[:60] + b"\0\0\0\1" + good[64:]]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate([*bad, good])], "k int, media binary")
    rows = {r.k: r for r in media.media_index(frame).collect()}
    assert all(rows[i].error for i in range(8)) and rows[9].error is None
    assert all(rows[i].feature is None for i in range(8))


def test_empty_and_clashing(spark):
    assert media.media_index(media.stored(empty(spark))).count() == 0
    assert media.stored(clashing(spark, "media", "n_bytes")).columns == ["doc_id", "n_bytes", "media"]
    frame = spark.createDataFrame([(1, 7, media.container(media.padded(b"")))], "codec int, k int, media binary")
    assert media.media_index(frame).first().codec == "raw "


def track(number, kind, codec, stbl, duration=900):
    tkhd = full(b"tkhd", struct.pack(">IIII", 0, 0, number, 0), bytes(64))
    hdlr = full(b"hdlr", bytes(4), kind, bytes(12))
    mdhd = full(b"mdhd", struct.pack(">IIII", 0, 0, 90, duration), bytes(4))
    stsd = full(b"stsd", struct.pack(">I", 1), box(codec, bytes(78)))
    return box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, box(b"minf", box(b"stbl", stsd, *stbl))))


def tables(sizes, first, short=None, keys=()):
    size = full(b"stsz", struct.pack(">II", 0, len(sizes)), struct.pack(f">{len(sizes)}I", *sizes))
    if short == 4:
        size = full(b"stz2", struct.pack(">II", 4, len(sizes)), bytes(a << 4 | b for a, b in zip(sizes[::2], [*sizes[1::2], 0])))
    elif short:
        size = full(b"stz2", struct.pack(">II", short, len(sizes)), struct.pack(f">{len(sizes)}{'BH'[short // 8 - 1]}", *sizes))
    return [
        full(b"stts", struct.pack(">III", 1, len(sizes), 10)), size, full(b"stsc", struct.pack(">IIII", 1, 1, len(sizes), 1)),
        full(b"stco", struct.pack(">II", 1, first)), full(b"stss", struct.pack(">I", len(keys)), struct.pack(f">{len(keys)}I", *keys)),
    ]


@pytest.mark.parametrize("short", [None, 4, 8, 16])
def test_all_tracks_are_indexed_and_pictures_come_first(short):
    sizes = [5, 1, 9, 3, 2]
    data = bytes(range(40))
    stored = box(b"mdat", data) + box(b"moov", track(1, b"soun", b"mp4a", tables([7, 7], 8)), track(2, b"vide", b"avc1", tables(sizes, 22, short, (1, 3))))
    index = media.indexed(stored)
    assert [t["codec"] for t in index["tracks"]] == ["mp4a", "avc1"] and index["codec"] == "avc1"
    assert media.payload(stored, index) == data[14:34] and media.payload(stored, index["tracks"][0]) == data[:14]
    assert media.key_ranges(index).tolist() == [[22, 5], [28, 9]]
    assert media._row(stored)["tracks"][1] == media.described(index)


def test_fragments():
    """Runs with sizes and marks of their own, with defaults, and with and without offsets."""
    none = [full(b"stts", bytes(4)), full(b"stsz", bytes(8)), full(b"stsc", bytes(4)), full(b"stco", bytes(4))]
    moov = box(b"moov", track(1, b"vide", b"avc1", none), box(b"mvex", full(b"trex", struct.pack(">5I", 1, 1, 10, 6, 0x10000))))

    def fragment(data, offset=None):
        head = 8 if offset is None else offset
        runs = [
            full(b"trun", struct.pack(">Ii", 2, head), struct.pack(">4I", 4, 0x2000000, 3, 0x10000), flags=0x601),
            full(b"trun", struct.pack(">II", 2, 0), flags=0x4),  # two of the default size, the first a key
        ]
        moof = box(b"moof", full(b"mfhd", bytes(4)), box(b"traf", full(b"tfhd", struct.pack(">I", 1), flags=0x20000), *runs))
        return moof + box(b"mdat", data) if offset is not None else fragment(data, len(moof) + 8)

    one, two = bytes(range(19)), bytes(range(100, 119))
    stored = moov + fragment(one) + fragment(two)
    index = media.indexed(stored)
    assert index["sizes"].tolist() == [4, 3, 6, 6] * 2 and media.payload(stored, index) == one + two
    assert index["keys"].tolist() == [1, 3, 5, 7]


def test_counts_beyond_the_file_are_errors():
    good = media.container(media.padded(b"x" * 500))
    at = good.index(b"stsz") + 8
    for fixed, count in ((1, 0xFFFFFFFF), (0, 0xFFFFFFFF), (0xFFFFFFFF, 0xFFFFFFFF), (192, 4)):
        assert media._row(good[:at] + struct.pack(">II", fixed, count) + good[at + 8 :])["error"]


@settings(max_examples=1500, deadline=None)
@given(st.data())
def test_changed_bytes_never_fail(data):
    """Any bytes of a file's boxes may be others: a row comes back, and nothing larger than the file is made."""
    sizes = [5, 1, 9, 3, 2]
    stored = bytearray(data.draw(st.sampled_from([
        media.container(media.padded(bytes(4000))),
        box(b"mdat", bytes(40)) + box(b"moov", track(1, b"vide", b"avc1", tables(sizes, 8, 4, (1,))), box(b"mvex", full(b"trex", struct.pack(">5I", 1, 1, 10, 6, 0))))
        + box(b"moof", box(b"traf", full(b"tfhd", struct.pack(">I", 1)), full(b"trun", struct.pack(">Ii", 2, 8), struct.pack(">2I", 4, 3), flags=0x201))),
    ])))
    for at, value in data.draw(st.lists(st.tuples(st.integers(0, min(len(stored), 900) - 1), st.sampled_from([0, 1, 2, 4, 8, 127, 128, 255])), max_size=6)):
        stored[at] = value
    row = media._row(bytes(stored))
    assert (row["error"] is None) == (row["feature"] is not None)
    assert row["payload_bytes"] is None or row["payload_bytes"] <= len(stored)
    assert all(row[c] is None or -(1 << 63) <= row[c] < 1 << 63 for c in ("time_scale", "duration", "n_samples"))
