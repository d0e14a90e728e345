"""Media columns: baseline JPEG parsed and Huffman-decoded in numpy, down to DC-only luminance thumbnails.

``decode_jpeg`` reads any column of baseline (sequential, 8-bit, Huffman) JPEG streams. Only DC coefficients of the
luminance are kept; AC codes are walked over, and scans of other components passed by. A value holds one stream or
several one after another (a motion JPEG); the thumbnails of several are stacked in order. Bytes after the last image
that begin no other are left alone. Null, empty, damaged or other data (progressive, arithmetic) gives null features and
``ok`` false, never an error; a header that claims more blocks than its scan has room for is damage, so memory follows
the bytes that are there. Restart intervals are independent, so all intervals of a run of images are decoded at once, one
numpy step for each block of an interval; an image without restart markers is a single one.

``encode_jpeg`` stores bytes as the DC coefficients of grey images of 24 blocks a row, a restart interval for each row,
with all quantisers 8: the mean grey level of a block, which is what a DC-only thumbnail shows, is then the byte itself,
and the round trip is exact. Null text counts as empty. Payloads above 195,840 bytes become several streams. Equal texts
have equal streams; repeated rows are encoded each for itself. Both directions work on about a megabyte at a time.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm._common import carried, field, id_field, map_texts, small_batches, text_chunks

BLOCKS = 24  # in a row of an encoded image
UNIT = BLOCKS * BLOCKS  # payloads are padded to a multiple of this many bytes
ROWS = 340 * BLOCKS  # most rows in an image: 8 x 8160 lines fit in the 16 bits of its height
PAD = 255
AT_ONCE = 1 << 20  # bytes of images that are encoded or decoded together

# Code lengths of the luminance DC table in the JPEG standard (Annex K.3), categories 0 to 11 in order.
DC_LENGTHS = (2, 3, 3, 3, 3, 3, 4, 5, 6, 7, 8, 9)


class NotBaseline(ValueError):
    """The data isn't a baseline JPEG stream."""


def canonical(counts: bytes, values: bytes) -> list[tuple[int, int, int]]:
    """(code, length, symbol) of a Huffman table from its DHT fields."""
    out, code, at = [], 0, 0
    if len(counts) != 16 or len(values) != sum(counts):
        raise NotBaseline("a table lacks values")
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            out.append((code, length, values[at]))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _dc_fields() -> tuple[bytes, bytes]:
    return bytes(DC_LENGTHS.count(n) for n in range(1, 17)), bytes(range(len(DC_LENGTHS)))


_AC_FIELDS = (bytes([1] + [0] * 15), b"\x00")  # one symbol, end of block, as the bit 0


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


@functools.lru_cache(maxsize=1024)
def _header(rows: int) -> bytes:
    dc = _dc_fields()
    return b"".join((
        b"\xff\xd8",
        _segment(0xDB, b"\x00" + bytes([8] * 64)),
        _segment(0xC0, b"\x08" + (8 * rows).to_bytes(2, "big") + (8 * BLOCKS).to_bytes(2, "big") + b"\x01\x01\x11\x00"),
        _segment(0xC4, b"\x00" + dc[0] + dc[1] + b"\x10" + _AC_FIELDS[0] + _AC_FIELDS[1]),
        _segment(0xDD, BLOCKS.to_bytes(2, "big")),
        _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
    ))


def runs(sizes: list[int], most: int = AT_ONCE) -> Iterator[slice]:
    """Stretches of a list with about ``most`` bytes, or of one entry."""
    begin = held = 0
    for i, n in enumerate(sizes):
        if i > begin and held + n > most:
            yield slice(begin, i)
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """JPEG streams of payloads whose lengths are multiples of ``UNIT``: one image for each ``ROWS`` rows."""
    images = [(n, p[k : k + ROWS * BLOCKS]) for n, p in enumerate(payloads) for k in range(0, len(p), ROWS * BLOCKS)]
    made: list[list[bytes]] = [[] for _ in payloads]
    for run in runs([len(x) for _, x in images]):
        for (n, _), stream in zip(images[run], _encode_images([x for _, x in images[run]])):
            made[n].append(stream)
    return [b"".join(x) for x in made]


def _encode_images(payloads: list[bytes]) -> list[bytes]:
    levels = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int32).reshape(-1, BLOCKS) - 128
    diff = levels.copy()
    diff[:, 1:] -= levels[:, :-1]
    size = np.frexp(np.abs(diff).astype(np.float32))[1]
    codes = np.zeros(12, np.int32)
    for code, _, symbol in canonical(*_dc_fields()):
        codes[symbol] = code
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff)
    bits = np.asarray(DC_LENGTHS, np.int32)[size] + size + 1  # the last one is the end of block
    value = ((codes[size] << size) | extra) << 1
    ends = np.cumsum(bits, axis=1)
    row_bytes = (ends[:, -1] + 7) >> 3
    row_start = np.cumsum(row_bytes) - row_bytes
    at = (ends - bits) + 8 * row_start[:, None]
    shifted = (value << (24 - bits - (at & 7))).ravel()
    byte, total = (at >> 3).ravel(), int(row_bytes.sum())
    made = sum(np.bincount(byte + k, weights=(shifted >> (16 - 8 * k)) & 255, minlength=total + 2) for k in range(3))[:total].astype(np.int64)
    made[row_start + row_bytes - 1] += (1 << (8 * row_bytes - ends[:, -1])) - 1  # padding with ones
    taken = 1 + (made == 255)  # an 0xFF is followed by a zero
    row_of = np.repeat(np.arange(len(row_bytes)), row_bytes)
    to = np.cumsum(taken) - taken + 2 * row_of
    row_end = np.add.reduceat(taken, row_start).cumsum() + 2 * np.arange(len(row_bytes))
    out = np.zeros(int(row_end[-1]) + 2, np.uint8)
    out[to] = made
    out[row_end] = 255

    rows = np.array([len(p) // BLOCKS for p in payloads])
    image_end = np.cumsum(rows)
    out[row_end + 1] = 0xD0 + (np.arange(len(row_end)) - np.repeat(image_end - rows, rows)) % 8
    out[row_end[image_end - 1] + 1] = 0xD9
    cuts = [0, *(row_end[image_end - 1] + 2).tolist()]
    scans = out.tobytes()
    return [_header(n) + scans[a:b] for n, a, b in zip(rows.tolist(), cuts, cuts[1:])]


@functools.lru_cache(maxsize=64)
def _lookup(table: bytes) -> np.ndarray:
    """For each 16 bits: code length x 256 + symbol (0: no such code), from the DHT fields of one table."""
    out = np.zeros(1 << 16, np.int32)
    for code, length, symbol in canonical(table[:16], table[16:]):
        out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
    return out


class Stream:
    """A value's bytes and where its markers may be: an 0xFF before anything but a zero or another 0xFF."""

    def __init__(self, raw: bytes) -> None:
        self.raw, self.data = raw, np.frombuffer(raw, np.uint8)
        after = self.data[1:]
        self.marks = np.flatnonzero((self.data[:-1] == 255) & (after != 0) & (after != 255))
        self.restart = (self.data[self.marks + 1] & 0xF8) == 0xD0
        self.others = self.marks[~self.restart]

    def scan_end(self, begin: int) -> tuple[int, np.ndarray]:
        """Where the scan that begins here ends, and the places of its restart markers."""
        k = int(np.searchsorted(self.others, begin))
        if k == len(self.others):
            raise NotBaseline("the scan has no end")
        a, b = np.searchsorted(self.marks, [begin, self.others[k]])
        return int(self.others[k]), self.marks[a:b]


def _scan(body: bytes, frame: dict, quant: dict, tables: dict, interval: int) -> dict | None:
    """What the scan of this header needs to be decoded, its place apart; None if the luminance isn't in it."""
    used = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
    inside = [p for p in frame["parts"] if p[0] in used]
    if len(inside) != body[0]:
        raise NotBaseline("a scan of unknown components")
    first, (wide, high) = frame["parts"][0], frame["scale"]
    if first not in inside:
        return None
    columns, rows = -(-frame["width"] * first[1] // (8 * wide)), -(-frame["height"] * first[2] // (8 * high))
    if len(inside) == 1:
        inside, across, down = [(first[0], 1, 1, first[3])], columns, rows
    else:
        across, down = -(-frame["width"] // (8 * wide)), -(-frame["height"] // (8 * high))
    order = [(i, used[p[0]]) for i, p in enumerate(inside) for _ in range(p[1] * p[2])]
    return {
        "interval": interval, "across": across, "down": down, "columns": columns, "rows": rows, "unit": inside[0][1:3], "quant": quant[first[3]],
        "order": [(i, tables[t >> 4], tables[0x10 | t & 15]) for i, t in order], "width": frame["width"], "height": frame["height"],
    }


def parse(stream: Stream, begin: int) -> tuple[dict, int]:
    """Read the markers of one image from ``begin``; returns what its luminance scan needs, and where the image ends."""
    raw = stream.raw
    if raw[begin : begin + 2] != b"\xff\xd8":
        raise NotBaseline("no start of image")
    at, quant, tables, interval = begin + 2, {}, {}, 0
    frame = found = None
    while True:
        while raw[at : at + 2] == b"\xff\xff":
            at += 1
        if len(raw) < at + 2 or raw[at] != 255:
            raise NotBaseline("a marker is missing")
        kind = raw[at + 1]
        if kind == 0xD9:
            if found is None:
                raise NotBaseline("no luminance")
            return found, at + 2
        size = int.from_bytes(raw[at + 2 : at + 4], "big")
        body = raw[at + 4 : at + 2 + size]
        if size < 2 or len(body) != size - 2:
            raise NotBaseline("a segment is cut off")
        at += 2 + size
        if kind == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                quant[body[k] & 15] = int.from_bytes(body[k + 1 : k + 2 + wide], "big")  # the DC quantiser
                k += 1 + 64 * (1 + wide)
        elif kind == 0xC4:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                tables[body[k]] = bytes(body[k + 1 : k + 17 + n])
                k += 17 + n
        elif kind == 0xDD:
            interval = int.from_bytes(body, "big")
        elif kind == 0xC0 and body[0] == 8 and frame is None:
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            frame = {"height": int.from_bytes(body[1:3], "big"), "width": int.from_bytes(body[3:5], "big"), "parts": parts}
            if not parts or not frame["width"] or not frame["height"] or any(not (1 <= p[1] <= 4 and 1 <= p[2] <= 4) for p in parts):
                raise NotBaseline("no frame")
            frame["scale"] = max(p[1] for p in parts), max(p[2] for p in parts)
        elif 0xC0 <= kind <= 0xCF and kind != 0xCC:
            raise NotBaseline("another coding process")
        elif kind == 0xDA:
            if frame is None:
                raise NotBaseline("no frame")
            end, restarts = stream.scan_end(at)
            scan = _scan(body, frame, quant, tables, interval)
            if scan is not None and found is None:
                if scan["across"] * scan["down"] * len(scan["order"]) > 4 * (end - at):  # a block has two bits at least
                    raise NotBaseline("more blocks than bits")
                found = scan | {"begin": at, "end": end, "restarts": restarts}
            at = end


def _decode_blocks(images: list[tuple[np.ndarray, dict]]) -> list[np.ndarray]:
    """DC values of every image's blocks, in the order of the scan."""
    pieces, firsts, blocks, owner = [], [], [], []
    tables: dict[bytes, int] = {}
    patterns = np.zeros((len(images), max(len(x["order"]) for _, x in images), 3), np.int64)
    steps, at = np.zeros(len(images), np.int64), 0
    for n, (data, x) in enumerate(images):
        for k, (part, dc, ac) in enumerate(x["order"]):
            patterns[n, k] = part, tables.setdefault(dc, len(tables)), tables.setdefault(ac, len(tables))
        steps[n] = len(x["order"])
        marks = x["restarts"]
        scan = data[x["begin"] : x["end"]]
        keep = np.ones(len(scan), bool)
        keep[1:] = (scan[1:] != 0) | (scan[:-1] != 255)
        keep[marks - x["begin"]] = keep[marks + 1 - x["begin"]] = False
        kept = np.cumsum(keep)
        total, every = x["across"] * x["down"], x["interval"] or x["across"] * x["down"]
        own = np.minimum(every, total - np.arange(0, total, every)) * len(x["order"])
        if len(own) != len(marks) + 1:
            raise NotBaseline("a restart marker is missing")
        firsts.append(at + np.concatenate(([0], kept[marks - x["begin"]])))
        pieces.append(scan[keep])
        at += len(pieces[-1])
        blocks.append(own)
        owner.append(np.full(len(own), n))
    first, count, own = np.concatenate(firsts), np.concatenate(blocks), np.concatenate(owner)
    flat = np.concatenate([*pieces, np.full(8, 255, np.uint8)])
    limit = 8 * at
    word = np.zeros(at + 1, np.uint64)  # the next 64 bits from each byte on
    for k in range(8):
        word |= flat[k : at + 1 + k].astype(np.uint64) << np.uint64(56 - 8 * k)
    lut = np.concatenate([_lookup(t) for t in tables])
    lanes = np.argsort(-count, kind="stable")
    at_bit, sizes, table_of, step_of = 8 * first[lanes], count[lanes], patterns[own[lanes]], steps[own[lanes]]
    place = np.cumsum(count) - count  # of each lane's blocks among all
    diff, to = np.zeros(int(count.sum()), np.int32), place[lanes]
    one, plain = np.int64(1), len(tables) == 2 and (steps == 1).all()

    def symbol(window: np.ndarray, used: np.ndarray, table: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        found = lut[((window >> (48 - used).astype(np.uint64)).astype(np.int64) & 0xFFFF) + (table << 16)]
        return found >> 8, found & 255

    lost = False
    for t in range(int(sizes[0])):
        n = int(np.searchsorted(-sizes, -t, side="left"))
        bit = at_bit[:n]
        if (bit >= limit).any():
            raise NotBaseline("the scan is cut off")
        if plain:
            dc, ac = int(patterns[0, 0, 1]), int(patterns[0, 0, 2])
        else:
            turn = t % step_of[:n]
            dc, ac = table_of[np.arange(n), turn, 1], table_of[np.arange(n), turn, 2]
        window, used = word[bit >> 3], bit & 7
        length, size = symbol(window, used, dc)
        lost |= bool((length == 0).any() or (size > 11).any())
        used = used + length + size
        extra = (window >> (64 - used).astype(np.uint64)).astype(np.int64) & ((one << size) - 1)
        diff[to[:n] + t] = np.where((size > 0) & (extra < (one << size >> 1)), extra - (one << size) + 1, extra)
        length, code = symbol(window, used, ac)
        lost |= bool((length == 0).any())
        bit = (bit & ~7) + used
        open_ = np.flatnonzero(code)
        done = bit + length
        k = np.ones(len(open_), np.int64)
        while len(open_):  # lanes whose block has AC coefficients: walk over them
            here = bit[open_]
            if (here >= limit).any():
                raise NotBaseline("the scan is cut off")
            length, code = symbol(word[here >> 3], here & 7, ac if isinstance(ac, int) else ac[open_])
            lost |= bool((length == 0).any())
            here = here + np.maximum(length, 1) + (code & 15)
            k = np.where(code == 0, 64, k + (code >> 4) + 1)
            bit[open_] = done[open_] = here
            open_, k = open_[k < 64], k[k < 64]
        at_bit[:n] = done
        if lost:
            raise NotBaseline("a code isn't in the table")
    out, begin = [], 0
    for n, (_, x) in enumerate(images):
        order = [part for part, _, _ in x["order"]]
        ends = np.cumsum(blocks[n])
        values = diff[begin : begin + int(ends[-1])].astype(np.int64)
        begin += len(values)
        # Differences begin anew with each interval; only those of the luminance are summed.
        own_first = np.tile(np.array(order) == 0, len(values) // len(order))
        kept = np.cumsum(values[own_first])
        starts = (ends - blocks[n]) // len(order) * order.count(0)
        base = np.concatenate(([0], kept))[starts]
        out.append((kept - np.repeat(base, blocks[n] // len(order) * order.count(0))).reshape(-1, order.count(0)))
    return out


_DAMAGE = (NotBaseline, LookupError, ArithmeticError, ValueError)


def thumbnails(streams: list[bytes | None]) -> list[tuple[int, int, int, np.ndarray] | None]:
    """(width, height, images, thumbnail) of each value: one grey level for each 8 x 8 block; None if it can't be read."""
    found: list[tuple[int, np.ndarray, dict]] = []
    bad: set[int] = set()
    for n, raw in enumerate(streams):
        own, at = [], 0
        try:
            stream = Stream(raw or b"")
            while not own or raw[at : at + 2] == b"\xff\xd8":
                image, at = parse(stream, at)
                own.append((n, stream.data, image))
            found += own
        except _DAMAGE:
            bad.add(n)
    grids: dict[int, list[np.ndarray]] = defaultdict(list)
    sizes: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def decode(group: list[tuple[int, np.ndarray, dict]]) -> list[np.ndarray]:
        made = []
        for (_, _, x), dc in zip(group, _decode_blocks([y[1:] for y in group]), strict=True):
            wide, high = x["unit"]
            grid = dc.reshape(x["down"], x["across"], high, wide).transpose(0, 2, 1, 3).reshape(x["down"] * high, x["across"] * wide)
            level = (grid[: x["rows"], : x["columns"]] * x["quant"] + 4 >> 3) + 128
            made.append(np.clip(level, 0, 255).astype(np.uint8))
        return made

    for run in runs([x["end"] - x["begin"] for _, _, x in found]):
        group = found[run]
        try:
            made = decode(group)
        except _DAMAGE:  # find out which of them it is
            made = []
            for x in group:
                try:
                    made.append((x, decode([x])[0]))
                except _DAMAGE:
                    bad.add(x[0])
            group, made = [x for x, _ in made], [y for _, y in made]
        for (n, _, x), grid in zip(group, made, strict=True):
            grids[n].append(grid)
            sizes[n].append((x["width"], x["height"]))
    out: list[tuple[int, int, int, np.ndarray] | None] = []
    for n in range(len(streams)):
        if n in bad:
            out.append(None)
            continue
        own, columns = grids[n], max(g.shape[1] for g in grids[n])
        grid = np.concatenate([np.pad(g, ((0, 0), (0, columns - g.shape[1]))) for g in own]) if len(own) > 1 else own[0]
        out.append((max(w for w, _ in sizes[n]), sum(h for _, h in sizes[n]), len(own), grid))
    return out


def average_hash(grid: np.ndarray) -> str:
    """64 bits, as 16 hex digits: which cells of the 8 x 8 reduction are lighter than its mean."""
    reduced = grid.astype(np.float64)
    for axis in (0, 1):
        edges = np.arange(9) * reduced.shape[axis] // 8
        first, past = np.minimum(edges[:-1], reduced.shape[axis] - 1), edges[1:]
        sums = np.concatenate([np.zeros_like(np.take(reduced, [0], axis)), np.cumsum(reduced, axis=axis)], axis=axis)
        past = np.maximum(past, first + 1)
        total = np.take(sums, past, axis) - np.take(sums, first, axis)
        reduced = total / (past - first).reshape((-1, 1) if axis == 0 else (1, -1))
    return np.packbits(reduced.ravel() > reduced.mean()).tobytes().hex()


def encode_jpeg(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 1 << 18) -> DataFrame:
    """Return id, n_bytes (of the text's UTF-8) and media (binary), one row for each row of ``docs``."""

    def make():
        def encode(texts: list[str | None]) -> dict:
            raw = [(t or "").encode() for t in texts]
            padded = [b + bytes([PAD]) * (max(UNIT, -(-len(b) // UNIT) * UNIT) - len(b)) for b in raw]
            return {"n_bytes": [len(b) for b in raw], "media": encode_payloads(padded)}

        return encode

    return map_texts(docs, id_col, text_col, [field("n_bytes", "bigint"), field("media", "binary")], make, batch_bytes)


def decode_jpeg(media: DataFrame, *, id_col: str = "doc_id", media_col: str = "media", keep: Sequence[str] = (), batch_bytes: int = 1 << 18) -> DataFrame:
    """Return id, the columns in ``keep``, ok, width, height, images, thumbnail and thumbnail_hash for each row."""
    fields = [field("ok", "boolean"), field("width", "int"), field("height", "int"), field("images", "int"), field("thumbnail", "binary"), field("thumbnail_hash", "string")]
    small_batches(media.sparkSession)
    keep = carried(keep, [id_col, *(f.name for f in fields)])
    kept = [T.StructField(c, media.schema[c].dataType, True) for c in keep]
    schema = T.StructType([id_field(media, id_col, id_col), *kept, *fields])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, streams in text_chunks(batches, batch_bytes):
            got = thumbnails(streams)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    *rows.columns[2:],
                    pa.array([x is not None for x in got], pa.bool_()),
                    *(pa.array([x and x[k] for x in got], pa.int32()) for k in range(3)),
                    pa.array([None if x is None else x[3].tobytes() for x in got], pa.binary()),
                    pa.array([None if x is None else average_hash(x[3]) for x in got], pa.string()),
                ],
                names=schema.names,
            )

    return media.select(F.col(id_col), F.col(media_col).cast("binary"), *(F.col(c) for c in keep)).mapInArrow(apply, schema)
