"""Ogg: pages found anywhere in a file, packets put together from them, exact lengths; FLAC in Ogg is decoded.

A page begins with a capture pattern and has a checksum of its own, so pages are found from any byte on: a file is cut into
ranges, and a task reads the pages that begin in its range. A packet is cut into segments of 255 bytes, the last one shorter,
and may go on over page borders; within a page the pieces of packets follow from that table, and over pages from a window by
stream in order of the pages. A page that fails its checksum is missing: packets that lose a piece, and what stood on the
missing pages, are failed packets. A whole page inside a packet is passed over, unless the page around it is torn.

The last page's granule position tells how long a stream is, exactly. Vorbis and Opus go to the decoders given for `vorbis` and
`opus`; without one the file is an error row.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crestline.sources import bits, flac
from crestline.sources.registry import AudioError, AudioFormat, Routed, register_decoder, scan

#: Fixed values of the format: pattern, bytes of a header without its table, longest page, flags of a page.
PATTERN, HEADER, LONGEST_PAGE = b"OggS", 27, 27 + 255 + 255 * 255
CONTINUED, FIRST, LAST = 1, 2, 4
CRC = bits.Crc(0x04C11DB7, 32)
#: Pages whose checksums are computed together, and bytes of a file that are one task's share.
TOGETHER, SHARE_BYTES = 256, 64 << 20
#: Samples a second of Opus, and of the low-frequency channel its place by number of channels (as Vorbis orders them).
OPUS_RATE, LOW_PLACE = 48000, {6: 5, 7: 6, 8: 7}
PIECE = "struct<start:int,length:int,ends:boolean>"
PAGES = f"path string, serial bigint, page bigint, offset bigint, length bigint, granule bigint, flags int, pieces array<{PIECE}>, head binary, error string"
_TYPES = pa.schema([
    ("path", pa.string()), *[(c, pa.int64()) for c in ("serial", "page", "offset", "length", "granule")], ("flags", pa.int32()),
    ("pieces", pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ends", pa.bool_())]))), ("head", pa.binary()), ("error", pa.string()),
])


@dataclass
class Page:
    at: int
    length: int
    flags: int
    granule: int
    serial: int
    number: int
    #: Start within the page, length, and whether the packet ends there.
    pieces: list[tuple[int, int, bool]]


def _page(data: bytes, at: int) -> Page | None:
    """What a header says, if the page lies within the data; its checksum is not looked at."""
    if data[at : at + 4] != PATTERN or at + HEADER > len(data):
        return None
    version, flags, granule, serial, number, _, segments = struct.unpack_from("<BBqIIIB", data, at + 4)
    table = data[at + HEADER : at + HEADER + segments]
    length = HEADER + segments + sum(table)
    if version or len(table) < segments or at + length > len(data):
        return None
    pieces, start, size = [], HEADER + segments, 0
    for k, lace in enumerate(table):
        size += lace
        if lace < 255 or k == segments - 1:
            pieces.append((start, size, lace < 255))
            start, size = start + size, 0
    return Page(at, length, flags, granule, serial, number, pieces)


def pages(data: bytes, last: int | None = None) -> Iterator[Page]:
    """The whole pages with right checksums that begin before `last`, in order; none lies within another."""
    buffer, last = bits.padded(data), len(data) if last is None else last
    at = data.find(PATTERN)
    while 0 <= at < last:
        chain: list[Page] = []
        here = at
        while len(chain) < TOGETHER and here < last and (page := _page(data, here)) is not None:
            chain.append(page)
            here += page.length
        told = [struct.unpack_from("<I", data, p.at + 22)[0] for p in chain]
        part = buffer[at : here + 1].copy()
        for p in chain:
            part[p.at - at + 22 : p.at - at + 26] = 0
        starts = np.array([p.at - at for p in chain], np.int64)
        right = CRC.many(part, starts, starts + np.array([p.length for p in chain], np.int64)) == np.array(told, np.uint32)
        good = len(chain) if right.all() else int(np.argmin(right))
        yield from chain[:good]
        if good == len(chain) and chain:
            at = data.find(PATTERN, here)
        else:  # what only looked like a page is passed by a byte
            at = data.find(PATTERN, (chain[good].at if chain else at) + 1)


@dataclass
class Stream:
    """A logical stream: its packets (None: failed), and the place of its end."""

    packets: list[bytes | None]
    granule: int = 0
    number: int = -1
    open: list[bytes] | None = None


def streams(data: bytes) -> list[Stream]:
    """The logical streams of a whole file, in order of their first pages."""
    found: dict[int, Stream] = {}
    for page in pages(data):
        s = found.setdefault(page.serial, Stream([]))
        lost, goes_on = 0 <= s.number < page.number - 1, bool(page.flags & CONTINUED and page.pieces)
        if s.open is not None and page.pieces and (lost or not goes_on):
            s.packets.append(None)
            s.open = None
        if lost or (goes_on and s.open is None):  # an end whose beginning was on a missing page counts with that page
            s.packets.append(None)
        for k, (start, length, ends) in enumerate(page.pieces):
            raw = data[page.at + start : page.at + start + length]
            if k or not goes_on:
                s.open = [raw]
            elif s.open is None:
                continue
            else:
                s.open.append(raw)
            if ends:
                s.packets.append(b"".join(s.open))
                s.open = None
        s.number = page.number
        s.granule = page.granule if page.granule >= 0 else s.granule
    for s in found.values():
        if s.open is not None:
            s.packets.append(None)
    return list(found.values())


def identified(head: bytes) -> tuple[str, int, int, int] | None:
    """Codec, rate, channels, and samples before the first that counts, of a stream's first packet."""
    if head[:8] == b"OpusHead" and len(head) >= 19:
        return "Opus", OPUS_RATE, head[9], struct.unpack_from("<H", head, 10)[0]
    if head[:7] == b"\1vorbis" and len(head) >= 30:
        return "OGG Vorbis", struct.unpack_from("<I", head, 12)[0], head[11], 0
    if head[:5] == b"\x7fFLAC" and len(head) >= 51:
        info = _flac_info(head)
        return "FLAC", info.rate, info.channels, 0
    return None


def _flac_info(head: bytes) -> flac.StreamInfo:
    own = head[9:51]
    return flac.stream_info(lambda n, at: own[at : at + n], len(own))


def decode_ogg(data: bytes, extension: str = "ogg") -> tuple[AudioFormat, flac.Frames]:
    for s in streams(data):
        if s.packets and s.packets[0] is not None and (told := identified(s.packets[0])):
            break
    else:
        raise AudioError("FormatError", "no stream of a known codec in Ogg pages")
    name, *_ = told
    if name != "FLAC":
        raise Routed("opus" if name == "Opus" else "vorbis", name)
    info = _flac_info(s.packets[0])
    known = info.format()
    known.sample_count = known.sample_count or s.granule
    known.skipped_packets = sum(p is None for p in s.packets)
    # header packets begin with anything but the sync code of a frame
    coded = [p for p in s.packets[1:] if p is not None and p[:1] == b"\xff"]

    return known, flac.Frames(known, info, coded)


# ---- Pages, packets and streams as DataFrames -----------------------------------------------------------------------


def page_table(spark: SparkSession, directory: str, recursive: bool = False, share: int = SHARE_BYTES, extensions: tuple[str, ...] = ("ogg", "opus")) -> DataFrame:
    """The pages of every Ogg file, read by ranges of `share` bytes. `head`: the beginning of a stream's first page's body.
    A file that cannot be opened has a row with its error; one without pages has none."""
    from crestline.sources.ranges import system_of

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist(), strict=True):
                try:
                    system, place, _ = system_of(path)
                    with system.open_input_file(place) as file:
                        size = file.size()
                        data = file.read_at(max(0, min(share + LONGEST_PAGE, size - first)), first)
                except (OSError, pa.ArrowException) as e:
                    yield pa.RecordBatch.from_pylist([dict.fromkeys(_TYPES.names) | {"path": path, "error": str(e)}], _TYPES)
                    continue
                rows = []
                for p in pages(data, share):
                    pieces = [{"start": a, "length": n, "ends": ends} for a, n, ends in p.pieces]
                    head = data[p.at + p.pieces[0][0] : p.at + p.length][:64] if p.flags & FIRST and p.pieces else None
                    rows.append({"path": path, "serial": p.serial, "page": p.number, "offset": first + p.at, "length": p.length, "granule": p.granule, "flags": p.flags, "pieces": pieces, "head": head, "error": None})
                yield pa.RecordBatch.from_pylist(rows, _TYPES)

    wanted = scan(spark, directory, recursive).where(" OR ".join(f"lower(path) LIKE '%.{e}'" for e in extensions))
    ranges = wanted.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(share).cast("long"))).alias("first"))
    found = ranges.repartition("path", "first").mapInArrow(walk, PAGES)
    # what looks like a page inside a page that began in the range before
    before = Window.partitionBy("path").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("__end", F.max(F.col("offset") + F.col("length")).over(before)).where("error IS NOT NULL OR __end IS NULL OR offset >= __end").drop("__end")


def packets(table: DataFrame) -> DataFrame:
    """path, serial, seq, pieces (place and length of each), length, granule (of the page that it ends as its last packet),
    failed, lost_pages. Missing pages stand as one failed packet, with their number."""
    stream = Window.partitionBy("path", "serial").orderBy("offset")
    left_open = F.last(~F.element_at("pieces", -1)["ends"], ignorenulls=True).over(stream.rowsBetween(Window.unboundedPreceding, -1))
    good = table.where("error IS NULL").withColumn("pieces", F.when(F.size("pieces") > 0, F.col("pieces")))
    good = good.select("*", F.lag("page").over(stream).alias("__last"), F.coalesce(left_open, F.lit(False)).alias("__open"), (F.col("flags").bitwiseAND(CONTINUED) != 0).alias("__goes_on"))
    good = good.withColumn("lost_pages", F.coalesce(F.greatest(F.col("page") - F.col("__last") - 1, F.lit(0)), F.lit(0)))
    # an end without its beginning belongs to the missing page, if one is known, else it stands alone
    orphan = F.col("__goes_on") & ((F.col("lost_pages") > 0) | ~F.col("__open"))
    own = F.transform("pieces", lambda p, k: F.struct(
        (k + 1).alias("k"), (F.col("offset") + p["start"]).alias("offset"), p["length"].cast("long").alias("length"), p["ends"].alias("ends"),
        ((k > 0) | ~F.col("__goes_on") | (orphan & (F.col("lost_pages") == 0))).alias("begins"), ((k == 0) & orphan).alias("bad"), F.lit(0).cast("long").alias("lost"),
    ))
    missing = F.struct(F.lit(0).alias("k"), F.col("offset").alias("offset"), F.lit(0).cast("long").alias("length"), F.lit(False).alias("ends"), F.lit(True).alias("begins"), F.lit(True).alias("bad"), F.col("lost_pages").alias("lost"))
    empty = F.expr("cast(array() AS array<struct<k:int,offset:bigint,length:bigint,ends:boolean,begins:boolean,bad:boolean,lost:bigint>>)")
    rows = good.select("path", "serial", "offset", "granule", F.explode(F.concat(F.when(F.col("lost_pages") > 0, F.array(missing)).otherwise(empty), F.coalesce(own, empty))).alias("p"))
    rows = rows.select("path", "serial", F.col("offset").alias("page_at"), "granule", "p.*")
    order = Window.partitionBy("path", "serial").orderBy("page_at", "k")
    rows = rows.withColumn("__n", F.sum(F.col("begins").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # the packet that ends last on its page has the page's granule position
    last = Window.partitionBy("path", "serial", "page_at")
    rows = rows.withColumn("__final", F.col("ends") & (F.col("k") == F.max(F.when(F.col("ends"), F.col("k"))).over(last)))
    whole = rows.groupBy("path", "serial", "__n").agg(
        F.array_sort(F.collect_list(F.struct("page_at", "k", "offset", "length"))).alias("pieces"), F.sum("length").alias("length"), F.sum("lost").alias("lost_pages"),
        F.max(F.when(F.col("__final"), F.col("granule"))).alias("granule"), (F.max("begins") & F.max("ends") & ~F.max("bad")).alias("__whole"),
    )
    seq = F.row_number().over(Window.partitionBy("path", "serial").orderBy("__n")).cast("long") - 1
    return whole.select("path", "serial", seq.alias("seq"), F.transform("pieces", lambda p: F.struct(p["offset"].alias("offset"), p["length"].alias("length"))).alias("pieces"), "length", "granule", (~F.col("__whole")).alias("failed"), "lost_pages")


def payloads(found: DataFrame) -> DataFrame:
    """Adds `payload`, the bytes of each packet, read where the task is; null for failed ones."""
    from pyspark.sql import types as T

    from crestline.sources.ranges import system_of

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, path, file = [], None, None
            for name, pieces, failed in zip(batch.column("path").to_pylist(), batch.column("pieces").to_pylist(), batch.column("failed").to_pylist(), strict=True):
                if name != path:
                    if file is not None:
                        file.close()
                    system, place, _ = system_of(name)
                    path, file = name, system.open_input_file(place)
                out.append(None if failed else b"".join(file.read_at(p["length"], p["offset"]) for p in pieces))
            if file is not None:
                file.close()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "payload"])

    return found.mapInArrow(fetch, T.StructType([*found.schema.fields, T.StructField("payload", T.BinaryType())]))


def opus_samples(payload: Column) -> Column:
    """Samples at 48 kHz of an Opus packet, from its first two bytes; null where it has none."""
    byte = lambda k: F.conv(F.hex(F.substring(payload, k, 1)), 16, 10).cast("int")
    mode = F.shiftright(byte(1), 3)
    of = lambda sizes: F.get(F.array(*map(F.lit, sizes)), mode % len(sizes))
    size = F.when(mode < 12, of((480, 960, 1920, 2880))).when(mode < 16, of((480, 960))).otherwise(of((120, 240, 480, 960)))
    many = byte(1).bitwiseAND(3)
    return F.when(F.length(payload) > 0, size * F.when(many == 0, 1).when(many < 3, 2).otherwise(byte(2).bitwiseAND(63)))


def stream_table(table: DataFrame) -> DataFrame:
    """path, serial, codec, sample_rate, channels, sample_count of every stream of a known codec, from its first page and its
    last granule position: exact, and no packet is read."""

    @F.pandas_udf("codec string, sample_rate int, channels int, skip int")
    def told(heads):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.DataFrame([identified(bytes(h)) or (None, None, None, None) for h in heads], columns=["codec", "sample_rate", "channels", "skip"])

    ends = table.where("error IS NULL").groupBy("path", "serial").agg(F.max("granule").alias("granule"), F.max("head").alias("head")).where("head IS NOT NULL")
    found = ends.withColumn("t", told("head")).where("t.codec IS NOT NULL")
    return found.select("path", "serial", "t.codec", "t.sample_rate", "t.channels", F.greatest(F.col("granule") - F.col("t.skip"), F.lit(0)).alias("sample_count"))


# ---- Writer ---------------------------------------------------------------------------------------------------------


def write_pages(some: list[tuple[int, int, int, list[int], bytes]], serial: int) -> bytes:
    """Pages (flags, granule, number, table, body) one after the other, with their checksums."""
    made = [struct.pack("<4sBBqIIIB", PATTERN, 0, flags, granule, serial, number, 0, len(table)) + bytes(table) + body for flags, granule, number, table, body in some]
    ends = np.cumsum([len(page) for page in made])
    crcs = CRC.many(bits.padded(b"".join(made)), ends - [len(page) for page in made], ends)
    return b"".join(page[:22] + struct.pack("<I", crc) + page[26:] for page, crc in zip(made, crcs.tolist(), strict=True))


def write_page(flags: int, granule: int, serial: int, number: int, table: list[int], body: bytes) -> bytes:
    return write_pages([(flags, granule, number, table, body)], serial)


def write_ogg(payload: list[bytes], ends: list[int], serial: int = 1, segments: int = 255, headers: int = 1) -> bytes:
    """One stream; ends: the granule position at the end of each packet. A page has so many segments at most; each of the
    first `headers` packets ends its page."""
    out, table, body, number, granule, flags = [], [], b"", 0, -1, FIRST

    def flush(more: bool) -> None:
        nonlocal table, body, number, granule, flags
        out.append((flags, granule, number, table, body))
        table, body, number, granule = [], b"", number + 1, -1
        flags = CONTINUED if more else 0

    for k, (packet, end) in enumerate(zip(payload, ends, strict=True)):
        laces = [255] * (len(packet) // 255) + [len(packet) % 255]
        for j, lace in enumerate(laces):
            if len(table) == segments:
                flush(j > 0)
            table.append(lace)
            body += packet[255 * j : 255 * j + lace]
        granule = end
        if k < headers or k == len(payload) - 1:
            flush(False)
    return write_pages([(f | (LAST if k == len(out) - 1 else 0), *rest) for k, (f, *rest) in enumerate(out)], serial)


def write_flac(x: np.ndarray, rate: int, width: int = 16, block: int = 4096, **how: object) -> bytes:
    """Samples (channels, frames) as FLAC in Ogg."""
    starts = range(0, x.shape[1], block)
    frames = [flac.encode_frame(x[:, a : a + block], k, width) for k, a in enumerate(starts)]
    head = b"\x7fFLAC\1\0" + struct.pack(">H", 1) + flac.encode(x, rate, width, block)[:42]
    tags = b"\x84\0\0\x08" + bytes(8)
    return write_ogg([head, tags, *frames], [0, 0, *(min(x.shape[1], a + block) for a in starts)], headers=2, **how)


register_decoder("ogg", decode_ogg)
