"""Media columns: GIF streams stored in and decoded from binary columns, without an imaging library."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import table

CLEAR, END, FULL = 256, 257, 4096
#: Payload width in pixels, rows of a frame at most, and its time in hundredths of a second.
WIDTH, ROWS, DELAY = 64, 1024, 10
#: Pixels that a foreign stream may claim for its screen or a frame; the header alone would otherwise set the memory.
PIXELS = 1 << 26
SINGLE = [bytes([i]) for i in range(256)]


@dataclass(frozen=True)
class Frame:
    """A frame as stored (indices, in display order) and as shown (the composed screen, RGBA)."""

    left: int
    top: int
    width: int
    height: int
    delay_ms: int
    disposal: int
    transparent: int | None
    indices: bytes
    screen: np.ndarray


def code_widths(n: int, first: int = 8) -> np.ndarray:
    """Bits of the n codes that follow a clear code, itself excluded: the table grows by one entry a code, to 4096."""
    after = (1 << first) + 2 + np.maximum(np.arange(n) - 1, 0)
    return np.minimum(np.maximum(first + 1, np.floor(np.log2(after)).astype(int) + 1), 12)


WIDTHS = code_widths(FULL * 2)


def lzw_encode(data: bytes) -> bytes:
    """LZW codes of 8-bit samples, packed from the lowest bit, cleared whenever the table is full."""
    runs: list[list[int]] = [[CLEAR]]
    codes: list[int] = []
    put, free = codes.append, END + 1
    roots = [{-1: i} for i in range(256)]  # a node maps the next sample to a node; its own code is at -1
    rest = iter(data)
    node = roots[next(rest)] if data else None
    for b in rest:
        if (longer := node.get(b)) is not None:
            node = longer
            continue
        put(node[-1])
        node[b] = {-1: free}
        free += 1
        if free == FULL:
            put(CLEAR)
            runs.append(codes)
            codes, free = [], END + 1
            put = codes.append
            roots = [{-1: i} for i in range(256)]
        node = roots[b]
    if node:
        put(node[-1])
    put(END)
    runs.append(codes)
    flat = np.fromiter((c for r in runs for c in r), "<u2", sum(map(len, runs)))
    wide = np.concatenate([[9], *[WIDTHS[: len(r)] for r in runs[1:]]])
    bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(bits[np.arange(16) < wide[:, None]], bitorder="little").tobytes()


def lzw_decode(data: bytes, first: int = 8, limit: int | None = None) -> bytes:
    """The samples of an LZW code stream; ends at the end code, the data's end or ``limit`` samples.

    The width of each code follows from its place after the last clear code alone, so a run of codes is cut out of
    the bits at once, up to the next clear or end code.
    """
    clear, end = 1 << first, (1 << first) + 1
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)]).astype(np.uint32)
    words = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    total, at, made = len(data) * 8, 0, 0
    fixed = WIDTHS if first == 8 else code_widths(FULL * 2, first)
    out: list[bytes] = []
    while at + first < total and (limit is None or made < limit):
        w = fixed
        while True:  # a decoder may meet more codes than the table holds before the next clear code
            ends = at + np.cumsum(w)
            n = int(np.searchsorted(ends, total, side="right"))
            begin = ends[:n] - w[:n]
            codes = (words[begin >> 3] >> (begin & 7).astype(np.uint32)) & ((1 << w[:n]) - 1).astype(np.uint32)
            stop = np.flatnonzero((codes == clear) | (codes == end))
            if stop.size or n < len(w):
                break
            w = np.concatenate([w, np.full(len(w), 12)])
        m = int(stop[0]) if stop.size else n
        over = not stop.size or codes[m] == end
        at = total if over else int(ends[m])
        own = codes[:m]
        if not m:
            if over:
                break
            continue
        grown = FULL - end  # codes up to here add an entry each, but for the first
        if own[0] >= clear or (own[1:grown] > end + np.arange(1, len(own[1:grown]) + 1)).any() or (own >= FULL).any():
            raise ValueError("LZW code beyond the table")
        listed = own.tolist()
        table = SINGLE[:clear] + [b"", b""]
        add, put = table.append, out.append
        prev = table[listed[0]]
        put(prev)
        size = end + 1
        for c in listed[1:grown]:
            if c < size:
                e = table[c]
                add(prev + e[:1])
            else:
                e = prev + prev[:1]
                add(e)
            size += 1
            put(e)
            prev = e
        out += [table[c] for c in listed[grown:]]
        if limit is not None:
            made = sum(map(len, out))
        if over:
            break
    whole = b"".join(out)
    return whole if limit is None else whole[:limit]


def encode(payload: bytes, palette: bytes | None = None) -> bytes:
    """A GIF89a whose frames, 64 pixels wide and in order, hold the payload's bytes as palette indices.

    The payload's length must be a positive multiple of 64. The global palette is grey by default, so an index is its
    own brightness.
    """
    if not payload or len(payload) % WIDTH:
        raise ValueError("a payload is a positive multiple of 64 bytes")
    rows = len(payload) // WIDTH
    parts = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, ROWS), 0xF7, 0, 0), palette or bytes(i for i in range(256) for _ in range(3))]
    for top in range(0, rows, ROWS):
        own = payload[top * WIDTH : (top + ROWS) * WIDTH]
        parts += [b"\x21\xf9\x04", struct.pack("<BHB", 1 << 2, DELAY, 0), b"\x00", b"\x2c", struct.pack("<HHHHB", 0, 0, WIDTH, len(own) // WIDTH, 0), b"\x08"]
        stream = lzw_encode(own)
        for i in range(0, len(stream), 255):
            block = stream[i : i + 255]
            parts += [bytes([len(block)]), block]
        parts.append(b"\x00")
    return b"".join([*parts, b"\x3b"])


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        if at + n >= len(data):
            raise ValueError("the stream breaks off within a block")
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


def _colours(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 3 << (flags & 7) + 1
    if at + n > len(data):
        raise ValueError("the stream breaks off within a palette")
    return np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n


def frames(media: bytes, most: int = PIXELS) -> Iterator[Frame]:
    """Frames in order; palettes, transparency, interlacing and disposal (1 keep, 2 clear, 3 restore) are applied.

    Raises where the stream breaks off, a frame's samples are too few, or a screen or frame has more than ``most``
    pixels; frames before the fault have been given by then.
    """
    if media[:6] not in (b"GIF87a", b"GIF89a") or len(media) < 13:
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack_from("<HHB", media, 6)
    if width * height > most:
        raise ValueError(f"a screen of {width} x {height} pixels")
    at, colours = 13, None
    if flags & 0x80:
        colours, at = _colours(media, at, flags)
    screen = np.zeros((height, width, 4), np.uint8)
    delay, disposal, transparent = 0, 0, None
    while at < len(media):
        kind = media[at]
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = media[at + 1]
            body, after = _blocks(media, at + 2)
            if label == 0xF9 and len(body) >= 4:
                packed, hundredths, index = struct.unpack_from("<BHB", body)
                delay, disposal, transparent = hundredths * 10, packed >> 2 & 7, index if packed & 1 else None
            at = after
            continue
        if kind != 0x2C:
            raise ValueError(f"unknown block {kind:#x}")
        left, top, w, h, packed = struct.unpack_from("<HHHHB", media, at + 1)
        at, own = at + 10, colours
        if w * h > most:
            raise ValueError(f"a frame of {w} x {h} pixels")
        if packed & 0x80:
            own, at = _colours(media, at, packed)
        first = media[at]
        if not 1 < first < 9:
            raise ValueError(f"samples of {first} bits")
        stream, at = _blocks(media, at + 1)
        pixels = lzw_decode(stream, first, w * h)
        if len(pixels) < w * h:
            raise ValueError(f"{len(pixels)} samples for {w} x {h} pixels")
        grid = np.frombuffer(pixels, np.uint8).reshape(h, w)
        if packed & 0x40:
            order = np.concatenate([np.arange(s, h, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
            straight = np.empty_like(grid)
            straight[order] = grid
            grid = straight
        before = screen.copy() if disposal == 3 else None
        lookup = np.zeros((256, 4), np.uint8)
        if own is not None:
            lookup[: len(own), :3] = own
        lookup[:, 3] = 255
        seen = grid[: max(0, height - top), : max(0, width - left)]
        area = screen[top : top + seen.shape[0], left : left + seen.shape[1]]
        area[...] = lookup[seen] if transparent is None else np.where((seen == transparent)[..., None], area, lookup[seen])
        yield Frame(left, top, w, h, delay, disposal, transparent, grid.tobytes(), screen.copy())
        if disposal == 2:
            area[...] = 0
        elif before is not None:
            screen = before
        delay, disposal, transparent = 0, 0, None
    raise ValueError("the stream breaks off before its end mark")


def histogram(screen: np.ndarray) -> np.ndarray:
    """Pixels of each of 64 colours (two bits a channel); pixels still transparent are not counted."""
    high = screen[..., :3] >> 6
    colour = high[..., 0] << 4 | high[..., 1] << 2 | high[..., 2]
    return np.bincount(colour[screen[..., 3] > 0], minlength=64)


def padded(text: bytes) -> bytes:
    return text.ljust(max(1, -(-len(text) // WIDTH)) * WIDTH, b"\x00")


def store_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each whole text as UTF-8, zero-padded to a positive multiple of 64 bytes, as a GIF.

    Null and empty texts are 64 zero bytes. A text over 64 KiB takes several frames. Repeated rows stay; equal texts
    give equal media; other columns are not read; an empty table gives an empty result.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary() if pa.types.is_large_string(batch.column(1).type) else pa.binary())
            for i in range(0, batch.num_rows, 256):  # media of a few hundred texts are held at a time
                some = [t.as_py() or b"" for t in texts.slice(i, 256)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 256), pa.array(map(len, some), pa.int64()), pa.array([encode(padded(t)) for t in some], pa.binary())], names=["doc_id", "n_bytes", "media"])

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"))
    return own.mapInArrow(store, f"doc_id {dict(own.dtypes)['doc_id']}, n_bytes long, media binary")


FRAME = "frame int, left int, top int, width int, height int, delay_ms int, start_ms long, disposal int, transparent int, indices binary, rgba binary, colours array<long>"


def gif_frames(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row per frame: the kept columns, frame (from 0), place, time, stored indices, composed screen and its histogram.

    A null or empty media gives no row; a stream that breaks off, claims more than PIXELS or is no GIF gives the frames
    before the fault, then one row whose error column is set and whose frame columns are null. Frames leave one by one.
    """
    own = df.select(*keep, F.col(media).alias("__media"))
    types = dict(own.dtypes)
    names = [*keep, *[x.split()[0] for x in FRAME.split(", ")], "error"]
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in keep], FRAME, "error string"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [*[pa.int32()] * 6, pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.string()]
        def one(batch: pa.RecordBatch, row: int, *values) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[batch.column(c).slice(row, 1) for c in range(len(keep))], *[pa.array([v], k) for v, k in zip(values, kinds, strict=True)]], names=names)

        for batch in batches:
            for row, m in enumerate(batch.column(batch.num_columns - 1)):
                at = 0
                try:
                    for i, f in enumerate(frames(m.as_py()) if m.as_py() else ()):
                        yield one(batch, row, i, f.left, f.top, f.width, f.height, f.delay_ms, at, f.disposal, f.transparent, f.indices, f.screen.tobytes(), histogram(f.screen).tolist(), None)
                        at += f.delay_ms
                except (ValueError, IndexError, struct.error) as fault:
                    yield one(batch, row, *[None] * 12, str(fault))

    return own.mapInArrow(read, schema)


def read_payloads(stored: DataFrame) -> DataFrame:
    """store_texts rows with what the decoded frames say: payload length, digests, and a colour feature per document."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for m in batch.column(2):
                media = m.as_py()
                n, digest, tail, colours, shown = 0, hashlib.sha256(), b"", np.zeros(64, np.int64), 0
                for f in frames(media):
                    digest.update(f.indices)
                    n, tail, shown = n + len(f.indices), (tail + f.indices)[-WIDTH:], shown + 1
                    colours += histogram(f.screen)
                bins = " ".join(f"{c}:{colours[c]}" for c in np.flatnonzero(colours))
                rows.append((n, digest.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), f"{shown} frames; colours {bins} of {colours.sum()}", shown))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=names)

    kind = dict(stored.dtypes)["doc_id"]
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(read, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames int")


def op1_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_payloads(store_texts(table(spark, sf_dir, "documents")))
