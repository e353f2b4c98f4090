"""GIF: samples stored as frames, and the reading of any GIF's frames."""

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTH = HEIGHT = 24
SAMPLES = WIDTH * HEIGHT
TOGETHER = 2048  # frames that are encoded in step
STREAMS = 512  # code streams that are decoded in step
SLOTS = 1024  # of an encoder's table, above the codes of a frame
OWN_PALETTE = 16  # every so many frames one bears a palette of its own


class Image(NamedTuple):
    """A frame as the file holds it."""

    left: int
    top: int
    width: int
    height: int
    interlaced: bool
    palette: np.ndarray
    delay_ms: int
    disposal: int
    hole: int | None
    bits: int
    codes: bytes


class Frame(NamedTuple):
    delay_ms: int
    pixels: np.ndarray  # (height, width) uint32, as shown: red in the lowest byte, then green, blue and opacity
    samples: np.ndarray  # the decoded palette indices of the frame's own rectangle


def lzw_codes(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """LZW of rows of 8-bit samples, all rows in step: their codes, from the clear to the end code, and how many each row has.

    Every row has its table of (code, sample) pairs, open addresses in SLOTS places; a row is short enough that no table fills up.
    """
    n, m = samples.shape
    if 4 * m > 3 * SLOTS:
        raise ValueError("rows are too long for the tables")
    samples = samples.astype(np.int32)
    codes = np.zeros((n, m + 2), np.uint16)
    codes[:, 0] = 256
    flat, row, count, free = codes.reshape(-1), np.arange(n) * (m + 2), np.ones(n, np.int64), np.full(n, 258, np.int32)
    keys, values, base = np.zeros(n * SLOTS, np.int32), np.zeros(n * SLOTS, np.int32), np.arange(n) * SLOTS
    prefix = samples[:, 0].copy()
    for i in range(1, m):
        key = (prefix << 8 | samples[:, i]) + 1
        at = base + ((key * 40503 >> 7) & (SLOTS - 1))
        held = keys[at]
        b = np.flatnonzero((held != 0) & (held != key))
        while len(b):
            at[b] = base[b] + ((at[b] + 1) & (SLOTS - 1))
            held[b] = keys[at[b]]
            b = b[(held[b] != 0) & (held[b] != key[b])]
        known = held != 0
        e = np.flatnonzero(~known)
        flat[row[e] + count[e]] = prefix[e]
        keys[at[e]], values[at[e]] = key[e], free[e]
        count[e] += 1
        free[e] += 1
        prefix = np.where(known, values[at], samples[:, i])
    for last in (prefix, 257):
        flat[row + count] = last
        count += 1
    return codes, count


def packed(codes: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of codes as bytes, lowest bits first, and how many bytes each row has. A code's size follows from its place: the reader's table grows by one with each code."""
    place = np.arange(codes.shape[1])
    width = np.where(place == 0, 9, np.maximum(9, np.floor(np.log2(256 + np.maximum(place, 1))).astype(int) + 1))
    offset = np.r_[0, np.cumsum(width)]
    bits = np.zeros((len(codes), -(-int(offset[-1]) // 8) * 8), np.uint8)
    codes = np.where(place < count[:, None], codes, 0).astype(np.uint16)
    for b in range(int(width.max())):
        has = width > b
        bits[:, offset[:-1][has] + b] = codes[:, has] >> b & 1
    return np.packbits(bits, axis=1, bitorder="little"), -(-offset[count] // 8)


def lzw(streams: list[bytes], bits: int) -> list[np.ndarray]:
    """The samples of code streams whose samples have `bits` bits, all streams in step, a code of each at a time.

    An entry of a table is a stretch of what has been put out: the string before and the sample behind it. A stream that ends early gives what it holds; a code beyond the table is an error.
    """
    n, clear = len(streams), 1 << bits
    sizes = np.array([len(x) for x in streams], np.int64)
    data = np.frombuffer(b"".join(streams) + bytes(8), np.uint8).astype(np.uint32)
    window = data[:-3] | data[1:-2] << 8 | data[2:-1] << 16
    limit = np.cumsum(sizes) * 8
    pos = limit - sizes * 8
    k = int(min(4096, clear + 3 + sizes.max(initial=0) * 8 // (bits + 1)))
    start, length, base = np.zeros(n * k, np.int32), np.zeros(n * k, np.int32), np.arange(n) * k
    size, free = np.full(n, bits + 1), np.full(n, clear + 2)
    last, last_length, out = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
    made: list[tuple] = []
    live = np.flatnonzero(pos + size <= limit)
    while len(live):
        p = pos[live]
        code = (window[p >> 3] >> (p & 7).astype(np.uint32)).astype(np.int64) & ((1 << size[live]) - 1)
        pos[live] = p + size[live]
        wiped = live[code == clear]
        size[wiped], free[wiped], last[wiped] = bits + 1, clear + 2, -1
        does = (code != clear) & (code != clear + 1)
        d, c = live[does], code[does]
        if len(d):
            plain, before = c < clear, last[d] >= 0
            fresh = (c == free[d]) & before
            if (~plain & ~fresh & (c >= free[d])).any():
                raise ValueError("a code beyond the table")
            entry = base[d] + np.where(plain | fresh, 0, c)
            source = np.where(plain, -1, np.where(fresh, last[d], start[entry]))
            size_of = np.where(plain, 1, np.where(fresh, last_length[d] + 1, length[entry]))
            made.append((d, out[d], size_of, source, c))
            g = d[before & (free[d] < 4096)]
            start[base[g] + free[g]], length[base[g] + free[g]] = last[g], last_length[g] + 1
            free[g] += 1
            size[g] += (free[g] == 1 << size[g]) & (size[g] < 12)
            last[d], last_length[d] = out[d], size_of
            out[d] += size_of
        live = live[code != clear + 1]
        live = live[pos[live] + size[live] <= limit[live]]
    if not made:
        return [np.zeros(0, np.uint8)] * n
    stream, at, size_of, source, code = (np.concatenate(x) for x in zip(*made, strict=True))
    first = np.cumsum(out) - out
    row = np.repeat(np.arange(len(at)), size_of)
    step = np.arange(len(row)) - np.repeat(np.cumsum(size_of) - size_of, size_of)
    place = first[stream][row] + at[row] + step
    origin = np.empty(len(row), np.int64)
    origin[place] = np.where(source[row] < 0, place, first[stream][row] + source[row] + step)
    value = np.zeros(len(row), np.uint8)
    literal = source < 0
    value[(first[stream] + at)[literal]] = code[literal]
    while True:  # what is copied from a copy comes from where that came from
        further = origin[origin]
        if (further == origin).all():
            break
        origin = further
    return np.split(value[origin], np.cumsum(out)[:-1])


def _grey(turn: int) -> bytes:
    """A palette of 256 greys, or for odd turns of as many colours."""
    i = np.arange(256, dtype=np.uint8)
    return np.stack([i, i, i] if turn % 2 == 0 else [i, 255 - i, i ^ 85], 1).tobytes()


def encode(payloads: list[bytes]) -> list[bytes]:
    """A GIF for each payload, whose frames are the payload's samples, SAMPLES bytes each; payloads are positive multiples of that.

    Delay, disposal and the transparent sample change from frame to frame, and every OWN_PALETTE-th has its own palette; the samples are the payload in any case.
    """
    counts = [len(x) // SAMPLES for x in payloads]
    frames = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, SAMPLES)
    streams: list[bytes] = []
    for at in range(0, len(frames), TOGETHER):
        data, used = packed(*lzw_codes(frames[at : at + TOGETHER]))
        streams += [row[:k].tobytes() for row, k in zip(data, used.tolist(), strict=True)]
    place = b"\x2c\0\0\0\0" + WIDTH.to_bytes(2, "little") + HEIGHT.to_bytes(2, "little")
    out, at = [], 0
    for n in counts:
        parts = [b"GIF89a" + WIDTH.to_bytes(2, "little") + HEIGHT.to_bytes(2, "little") + b"\xf7\0\0" + _grey(0)]
        for k in range(n):
            parts.append(b"\x21\xf9\x04" + bytes([k % 4 << 2 | k % 2, 4 + k % 13, 0, 32, 0]) + place)
            parts.append(b"\x87" + _grey(k // OWN_PALETTE) if k % OWN_PALETTE == OWN_PALETTE - 1 else b"\0")
            parts.append(b"\x08")
            data = streams[at + k]
            parts += [bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)]
            parts.append(b"\0")
        at += n
        out.append(b"".join(parts) + b"\x3b")
    return out


class Reader:
    """The canvas and the images of a GIF."""

    def __init__(self, data: bytes):
        if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
            raise ValueError("not a GIF")
        self.data = data
        self.width, self.height = int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
        self.canvas = np.zeros((self.height, self.width), np.uint32)

    def _palette(self, flags: int, at: int) -> tuple[np.ndarray, int]:
        n = 2 << (flags & 7)
        colours = np.zeros((256, 4), np.uint8)
        colours[:n, :3] = np.frombuffer(self.data, np.uint8, 3 * n, at).reshape(n, 3)
        colours[:, 3] = 255
        return colours.view("<u4")[:, 0], at + 3 * n

    def _chain(self, at: int) -> tuple[bytes, int]:
        data, got = self.data, []
        while data[at]:
            got.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(got), at + 1

    def images(self) -> Iterator[Image]:
        data, at = self.data, 13
        common = np.full(256, 255 << 24, np.uint32)
        if data[10] & 0x80:
            common, at = self._palette(data[10], at)
        delay, disposal, hole = 0, 0, None
        while at < len(data) and data[at] != 0x3B:
            if data[at] == 0x21:
                if data[at + 1] == 0xF9:
                    how = data[at + 3]
                    disposal, hole = how >> 2 & 7, data[at + 6] if how & 1 else None
                    delay = int.from_bytes(data[at + 4 : at + 6], "little")
                at = self._chain(at + 2)[1]
                continue
            if data[at] != 0x2C:
                raise ValueError("an unknown block")
            left, top, w, h = (int.from_bytes(data[at + i : at + i + 2], "little") for i in (1, 3, 5, 7))
            flags = data[at + 9]
            colours, at = self._palette(flags, at + 10) if flags & 0x80 else (common, at + 10)
            bits = data[at]
            codes, at = self._chain(at + 1)
            yield Image(left, top, w, h, bool(flags & 0x40), colours, delay * 10, disposal, hole, bits, codes)
            delay, disposal, hole = 0, 0, None

    def draw(self, image: Image, samples: np.ndarray) -> Frame:
        """The canvas with the image on it, as it is shown; then the image is disposed of."""
        samples = samples[: image.width * image.height]
        shown = np.pad(samples, (0, image.width * image.height - len(samples))) if len(samples) < image.width * image.height else samples
        shown = shown.reshape(image.height, image.width)
        if image.interlaced:
            rows = [r for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(first, image.height, step)]
            shown = shown[np.argsort(rows)]
        area = (slice(image.top, image.top + image.height), slice(image.left, image.left + image.width))
        canvas = self.canvas.copy()
        part = canvas[area]
        shown = shown[: part.shape[0], : part.shape[1]]
        drawn = image.palette[shown]
        part[...] = drawn if image.hole is None else np.where(shown == image.hole, part, drawn)
        if image.disposal == 2:
            self.canvas = canvas.copy()
            self.canvas[area] = 0
        elif image.disposal != 3:
            self.canvas = canvas
        return Frame(image.delay_ms, canvas, samples)


def decoded(images: list[Image]) -> list[np.ndarray]:
    """The samples of each image."""
    out: list[np.ndarray] = [np.zeros(0, np.uint8)] * len(images)
    for bits in {x.bits for x in images}:
        own = [i for i, x in enumerate(images) if x.bits == bits]
        for at in range(0, len(own), STREAMS):
            some = own[at : at + STREAMS]
            for i, samples in zip(some, lzw([images[i].codes for i in some], bits), strict=True):
                out[i] = samples
    return out


def frames(data: bytes) -> Iterator[Frame]:
    """The frames of a GIF as they are shown: palettes, transparency, interlacing and disposal applied. What is not a GIF, an unknown block or a code beyond the table is a ValueError."""
    reader = Reader(data)
    held: list[Image] = []
    for image in _and_end(reader.images()):
        if image is not None:
            held.append(image)
        if held and (image is None or len(held) == TOGETHER):
            for x, samples in zip(held, decoded(held), strict=True):
                yield reader.draw(x, samples)
            held = []


def _and_end(values: Iterator) -> Iterator:
    yield from values
    yield None


def histograms(pixels: list[np.ndarray]) -> np.ndarray:
    """For each frame the counts of 64 colours, two bits of each channel, over its opaque pixels."""
    p = np.concatenate([x.ravel() for x in pixels])
    of = np.repeat(np.arange(len(pixels)), [x.size for x in pixels])
    seen = p >= 1 << 24
    p, of = p[seen], of[seen]
    return np.bincount(of * 64 + (p >> 6 & 3) * 16 + (p >> 14 & 3) * 4 + (p >> 22 & 3), minlength=64 * len(pixels)).reshape(-1, 64)


def padded(raw: bytes) -> bytes:
    """raw with bytes 255 up to a positive multiple of SAMPLES."""
    return raw + b"\xff" * (-len(raw) % SAMPLES or (0 if raw else SAMPLES))


def stored(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the text's UTF-8 bytes, padded, as a GIF: n_bytes (unpadded) and media. A null text counts as empty: one frame of padding; an empty table gives an empty result. Columns of docs that bear a name of the result are replaced."""
    made = [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]
    kept = [c for c in docs.columns if c != text and c not in {f.name for f in made}]
    schema = T.StructType([docs.schema[c] for c in kept] + made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(len(kept)).cast(pa.binary())
            sizes = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = 0
            while at < batch.num_rows:  # so many texts as fill the frames that go together, one at least
                past = np.cumsum(-(-sizes[at:] // SAMPLES) + (sizes[at:] == 0))
                end = at + max(1, int(np.searchsorted(past, TOGETHER, side="right")))
                media = encode([padded(x.as_py() or b"") for x in values.slice(at, end - at)])
                columns = [batch.column(i).slice(at, end - at) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes[at:end]), pa.array(media, pa.binary())], names=schema.names)
                at = end

    return docs.select(*kept, text).mapInArrow(run, schema)


def timed_frames(media: DataFrame, column: str = "media", rgba: bool = True, digest: bool = False) -> DataFrame:
    """One row for each frame of each GIF: the other columns, frame, delay_ms, width, height, histogram (64 colours), and if asked for rgba (as shown) and, with the last frame, digest (of the whole: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256).

    Frames of many files are decoded together. A null has no frames, nor has a GIF without images (with digests, they have a row of which all but the digest is null); what is not a GIF fails the job, as a lost medium should not pass in silence. An empty table gives an empty result; columns that bear
    a name of the result are replaced.
    """
    made = [T.StructField(n, T.IntegerType()) for n in ("frame", "delay_ms", "width", "height")] + [T.StructField("histogram", T.ArrayType(T.LongType()))]
    made += [T.StructField("rgba", T.BinaryType())] * rgba
    parts = T.StructType([T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType())])
    made += [T.StructField("digest", parts)] * digest
    digest_type = pa.struct([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string())])
    kept = [c for c in media.columns if c != column and c not in {f.name for f in made}]
    schema = T.StructType([media.schema[c] for c in kept] + made)

    class Payload:
        """What is put together of a file's samples."""

        def __init__(self, data: bytes):
            self.sha, self.tail, self.size, self.data, self.n = hashlib.sha256(), b"", 0, data, 0

        def add(self, samples: bytes) -> None:
            self.sha.update(samples)
            self.tail, self.size, self.n = (self.tail + samples)[-32:], self.size + len(samples), self.n + 1

        def parts(self) -> dict:
            return {"payload_bytes": self.size, "payload_sha256": self.sha.hexdigest(), "tail_crc32": zlib.crc32(self.tail), "media_bytes": len(self.data), "media_sha256": hashlib.sha256(self.data).hexdigest()}

    def rows_of(batch: pa.RecordBatch, held: list[tuple]) -> pa.RecordBatch:
        drawn, numbers, digests = [], [], []
        for (_, reader, payload, image, last), samples in zip(held, decoded([x[3] for x in held]), strict=True):
            numbers.append(payload.n)
            drawn.append(reader.draw(image, samples))
            payload.add(drawn[-1].samples.tobytes())
            digests.append(payload.parts() if last and digest else None)
        at = pa.array([x[0] for x in held])
        columns = [batch.column(c).take(at) for c in range(len(kept))]
        columns += [pa.array(x, pa.int32()) for x in (numbers, [f.delay_ms for f in drawn], [f.pixels.shape[1] for f in drawn], [f.pixels.shape[0] for f in drawn])]
        flat = histograms([f.pixels for f in drawn]).reshape(-1)
        columns.append(pa.ListArray.from_arrays(pa.array((np.arange(len(drawn) + 1) * 64).astype(np.int32)), pa.array(flat)))
        columns += [pa.array([f.pixels.tobytes() for f in drawn], pa.binary())] * rgba + [pa.array(digests, digest_type)] * digest
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def no_frame(batch: pa.RecordBatch, i: int, payload: Payload | None) -> pa.RecordBatch:
        columns = [batch.column(c).slice(i, 1) for c in range(len(kept))] + [pa.nulls(1, pa.int32())] * 4 + [pa.nulls(1, pa.list_(pa.int64()))] + [pa.nulls(1, pa.binary())] * rgba
        return pa.RecordBatch.from_arrays([*columns, pa.array([payload and payload.parts()], digest_type)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            for i in range(batch.num_rows):
                data = batch.column(len(kept))[i].as_py()
                if data is None:
                    if digest:
                        yield no_frame(batch, i, None)
                    continue
                reader, payload, image = Reader(data), Payload(data), None
                for then in _and_end(reader.images()):
                    if image is not None:
                        held.append((i, reader, payload, image, then is None))
                    image = then
                    if len(held) >= TOGETHER:
                        yield rows_of(batch, held)
                        held = []
                if image is None and payload.n == 0 and digest and not any(x[2] is payload for x in held[-1:]):
                    yield no_frame(batch, i, payload)
            if held:
                yield rows_of(batch, held)

    return media.select(*kept, column).mapInArrow(run, schema)


def features(media: DataFrame, column: str = "media") -> DataFrame:
    """media with each GIF read back: payload_bytes, payload_sha256, tail_crc32 of its samples in order of frames, media_bytes, media_sha256 and feature.

    feature names the frames, their whole time and the colour histogram (bins of two bits a channel that aren't empty), summed over the rows of timed_frames(); all but one row of a
    file are summed where they are made. A null gives nulls; an empty table gives an empty result. Columns that bear a name of the result are replaced.
    """
    made = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kept = [c for c in media.columns if c != column and c not in made]
    numbered = media.select(F.monotonically_increasing_id().alias("row"), F.struct(*[media[c] for c in kept]).alias("kept"), F.col(column).alias("media"))
    rows = timed_frames(numbered, "media", rgba=False, digest=True)
    counts = F.array(*[F.sum(F.get("histogram", F.lit(i))) for i in range(64)])
    whole = rows.groupBy("row").agg(F.first("kept").alias("kept"), F.max("digest").alias("digest"), F.count("frame").alias("n"), F.sum("delay_ms").alias("ms"), counts.alias("counts"))
    bins = F.filter(F.transform("counts", lambda c, i: F.when(c > 0, F.concat_ws(":", i.cast("string"), c.cast("string")))), lambda x: x.isNotNull())
    feature = F.concat(F.lit("frames="), F.col("n"), F.lit(";ms="), F.coalesce("ms", F.lit(0)), F.lit(";colours="), F.array_join(bins, ","))
    return whole.select(*[F.col(f"kept.`{c}`").alias(c) for c in kept], "digest.*", F.when(F.col("digest").isNotNull(), feature).alias("feature"))
