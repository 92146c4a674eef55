"""Motion-JPEG in AVI: writing payloads, reading frames by the RIFF index, and finding shots.

A payload byte is the sample value of one 8x8 block: such a block has only a DC coefficient, 8 * (value - 128), which
a quantiser step of 8 keeps exactly, so a baseline JPEG frame holds it without loss. Frames are BLOCKS blocks wide and
at most BLOCKS high, all of a film the same; the last is filled up with zeros, and an INFO chunk holds the payload's
length. The Huffman tables are chosen so that code and extra bits of a DC difference take nine bits together and the end of a
block one. Fixed-width codes are written and read for a whole frame at once in numpy; frames with other tables go through
an ordinary baseline decoder, symbol by symbol.

Shots: the difference of neighbouring frames is half the L1 distance of their luminance histograms. A cut is where it
exceeds both a floor and the mean plus THREE standard deviations of the differences in a window before it. Each shot is
a clip row with its first and last frame and times. Histograms are of decoded pixels. Frames without Huffman tables, as many
AVI files have them, take the tables of the JPEG standard's annex K.

Rows: null and empty texts are a payload of 64 zero bytes; repeated rows get a result each; null and damaged media (no index,
no frame rate, a frame that cannot be decoded) give no clips; other columns are left out, whatever they are called; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import small_batches

BLOCKS, RATE = 64, 25
BINS, FLOOR, THREE, WINDOW = 32, 0.15, 3.0, 24
#: The zigzag order of a block's coefficients, by diagonals.
ZIGZAG = np.array([i * 8 + j for i, j in sorted(((i, j) for i in range(8) for j in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))])

_SEGMENT = lambda marker, body: struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body
_QUANT = _SEGMENT(0xDB, b"\0" + b"\x08" * 64)
_DC = _SEGMENT(0xC4, bytes([0x00, *[1] * 9, *[0] * 7, *range(8, -1, -1)]))  # size k has a code of 9 - k bits
_AC = _SEGMENT(0xC4, bytes([0x10, 1, *[0] * 15, 0]))  # the end of the block alone, one bit
_SCAN = _SEGMENT(0xDA, bytes([1, 1, 0, 0, 63, 0]))
#: Ten bits of a block by its DC difference + 255.
_size = np.array([int(abs(d)).bit_length() for d in range(-255, 256)])
_extra = np.array([d if d > 0 else d + (1 << int(k)) - 1 for d, k in zip(range(-255, 256), _size)])
CODE = (((((1 << (9 - _size)) - 2) << _size) + _extra) << 1).astype(np.uint64)
CODE[255] = 510 << 1
_BACK = np.full(1024, 1 << 14, np.int32)
_BACK[CODE.astype(int)] = np.arange(-255, 256)


# one frame

#: The Huffman tables of annex K, as numbers of codes by length, and symbols in order (DC tables count up).
_K_COUNTS = {0x00: "0 1 5 1 1 1 1 1 1 0 0 0 0 0 0 0", 0x01: "0 3 1 1 1 1 1 1 1 1 1 0 0 0 0 0", 0x10: "0 2 1 3 3 2 4 3 5 5 4 4 0 0 1 125", 0x11: "0 2 1 2 4 4 3 4 7 5 4 4 0 1 2 119"}
_K_AC = {
    0x10: "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282",
    0x11: "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f1",
}


def _standard() -> dict[int, dict[tuple[int, int], int]]:
    """Tables by class and id. After the symbols listed, the others follow in ascending order."""
    out = {}
    every = [run << 4 | size for run in range(16) for size in range(1, 11)]
    for name, counts in _K_COUNTS.items():
        n = bytes(map(int, counts.split()))
        symbols = list(bytes.fromhex(_K_AC[name])) if name & 0x10 else list(range(12))
        if name & 0x10:
            symbols += [s for s in every if s not in set(symbols)]
        out.update(_huffman(bytes([name]) + n + bytes(symbols[: sum(n)])))
    return out


def encode_frame(samples: np.ndarray) -> bytes:
    """A baseline JPEG with 8x8 pixels for each of the samples (rows x columns, a multiple of 4 in all)."""
    flat = samples.reshape(-1).astype(np.int32)
    v = CODE[np.diff(flat, prepend=128) + 255].reshape(-1, 4)
    bits = v[:, 0] << np.uint64(30) | v[:, 1] << np.uint64(20) | v[:, 2] << np.uint64(10) | v[:, 3]
    data = bits.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].reshape(-1).tobytes().replace(b"\xff", b"\xff\0")
    rows, columns = samples.shape
    size = _SEGMENT(0xC0, struct.pack(">BHHB", 8, rows * 8, columns * 8, 1) + bytes([1, 0x11, 0]))
    return b"".join((b"\xff\xd8", _QUANT, size, _DC, _AC, _SCAN, data, b"\xff\xd9"))


def _huffman(body: bytes) -> list[tuple[int, dict[tuple[int, int], int]]]:
    """(class and id, {(length, code): symbol}) of the tables in a DHT segment."""
    out, at = [], 0
    while at < len(body):
        table, code, k = {}, 0, at + 17
        for length in range(1, 17):
            for _ in range(body[at + length]):
                table[length, code] = body[k]
                code, k = code + 1, k + 1
            code <<= 1
        out.append((body[at], table))
        at = k
    return out


STANDARD = _standard()


def _fixed(dc: dict, ac: dict) -> bool:
    """Whether the tables are those that encode_frame() writes: all blocks take ten bits."""
    return all(n + s == 9 for (n, _), s in dc.items()) and [*dc.values()] == [*range(8, -1, -1)] and ac == {(1, 0): 0}


def _scan_slow(data: bytes, order: list[tuple], blocks: int, restart: int) -> dict[int, list[np.ndarray]]:
    """Coefficients of every block by component. order: (component, DC table, AC table) of the blocks of a unit."""
    bits = "".join(f"{b:08b}" for b in data)
    at, last, out = 0, {}, {c: [] for c, *_ in order}

    def symbol(table: dict) -> int:
        nonlocal at
        for n in range(1, 17):
            if (s := table.get((n, int(bits[at : at + n] or "0", 2)))) is not None and at + n <= len(bits):
                at += n
                return s
        raise ValueError("not a Huffman code")

    def number(size: int) -> int:
        nonlocal at
        if not size:
            return 0
        v = int(bits[at : at + size], 2)
        at += size
        return v if v >> (size - 1) else v - (1 << size) + 1

    for _ in range(blocks):
        for c, dc, ac in order:
            z = np.zeros(64, np.int32)
            z[0] = last[c] = last.get(c, 0) + number(symbol(dc))
            k = 1
            while k < 64:
                rs = symbol(ac)
                if not rs & 15:
                    if rs != 0xF0:
                        break
                    k += 16
                    continue
                k += rs >> 4
                z[min(k, 63)] = number(rs & 15)
                k += 1
            out[c].append(z)
    return out


def decode_frame(jpeg: bytes, whole: bool = True) -> np.ndarray:
    """Luminance of a baseline JPEG: pixels, or (not whole) the mean of each 8x8 block."""
    at, quant, huffman, restart, shape = 2, {}, dict(STANDARD), 0, None
    while True:
        if jpeg[at] != 0xFF:
            raise ValueError("not a marker")
        marker, n = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                quant[body[k] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, k + 1).astype(np.int32)
                k += 65 + 64 * wide
        elif marker == 0xC4:
            huffman.update(_huffman(body))
        elif marker == 0xC0:
            _, height, width, parts = struct.unpack_from(">BHHB", body)
            shape = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(parts)}
        elif 0xC1 <= marker <= 0xCF:
            raise ValueError("only baseline frames are intra frames of this format")
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            scan = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
            break
    if shape is None or not height or not width:
        raise ValueError("a frame without a size")
    data = jpeg[at : jpeg.rindex(b"\xff\xd9")]
    first = scan[0][0]
    h, v, q = shape[first]
    if len(scan) == 1 and not restart and _fixed(huffman[scan[0][1] >> 4], huffman[0x10 | scan[0][1] & 15]):
        rows, columns = -(-height // 8), -(-width // 8)
        raw = np.frombuffer(data.replace(b"\xff\0", b"\xff"), np.uint8)[: rows * columns * 10 // 8].reshape(-1, 5).astype(np.uint64)
        bits = raw[:, 0] << np.uint64(32) | raw[:, 1] << np.uint64(24) | raw[:, 2] << np.uint64(16) | raw[:, 3] << np.uint64(8) | raw[:, 4]
        codes = np.stack([bits >> np.uint64(s) & np.uint64(1023) for s in (30, 20, 10, 0)], 1).reshape(-1)
        dc = np.cumsum(_BACK[codes.astype(np.int64)])
        means = np.clip(np.round(dc * quant[q][0] / 8) + 128, 0, 255).astype(np.uint8).reshape(rows, columns)
        return np.kron(means, np.ones((8, 8), np.uint8))[:height, :width] if whole else means  # such blocks are flat
    if len(scan) == 1:
        h = v = 1
        most_h = most_v = 1
    else:
        most_h, most_v = max(s[0] for s in shape.values()), max(s[1] for s in shape.values())
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    order = [(c, huffman[t >> 4], huffman[0x10 | t & 15]) for c, t in scan for _ in range(1 if len(scan) == 1 else shape[c][0] * shape[c][1])]
    parts = [data] if not restart else [p for i, p in enumerate(_restarts(data))]
    z, left = [], across * down
    for p in parts:
        n = min(left, restart) if restart else left
        z += _scan_slow(p.replace(b"\xff\0", b"\xff"), order, n, restart)[first]
        left -= n
    coefficients = np.zeros((len(z), 64))
    coefficients[:, ZIGZAG] = np.stack(z) * quant[q]
    if whole:
        basis = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (0.5 if u else 0.5 / np.sqrt(2)) for x in range(8)] for u in range(8)])
        blocks = np.einsum("ux,nuv,vy->nxy", basis, coefficients.reshape(-1, 8, 8), basis)
    else:
        blocks = coefficients[:, :1].reshape(-1, 1, 1) / 8
    k = blocks.shape[1]
    out = blocks.reshape(down, across, v, h, k, k).transpose(0, 2, 4, 1, 3, 5).reshape(down * v * k, across * h * k)
    rows, columns = (height, width) if whole else (-(-height // 8), -(-width // 8))
    return np.clip(np.round(out) + 128, 0, 255).astype(np.uint8)[:rows, :columns]


def _restarts(data: bytes) -> list[bytes]:
    """Entropy-coded data between restart markers."""
    out, start, at = [], 0, data.find(b"\xff")
    while at >= 0:
        if 0xD0 <= data[at + 1] <= 0xD7:
            out.append(data[start:at])
            start = at + 2
        at = data.find(b"\xff", at + 2)
    return [*out, data[start:]]


# films


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(frames: list[bytes], width: int, height: int, comment: str = "", rate: int = RATE) -> bytes:
    """A film of JPEG frames, with an index and an INFO comment."""
    most = max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // rate, most * rate, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, rate, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width & 0xFFFF, height & 0xFFFF)
    picture = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", picture)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", comment.encode() + b"\0"))
    body, index, at = [], [], 4
    for f in frames:
        body.append(_chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(body[-1])
    return _chunk(b"RIFF", b"AVI " + header + info + _chunk(b"LIST", b"movi" + b"".join(body)) + _chunk(b"idx1", b"".join(index)))


def read_avi(media: bytes) -> tuple[float, str, list[bytes]]:
    """Frames a second, INFO comment, and the frames that the index lists."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    found: dict[bytes, tuple[int, int]] = {}

    def walk(at: int, end: int) -> None:
        while at + 8 <= end:
            name, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
            if name == b"LIST":
                kind = media[at + 8 : at + 12]
                found[kind] = (at + 8, n)
                if kind != b"movi":
                    walk(at + 12, at + 8 + n)
            else:
                found.setdefault(name, (at + 8, n))
            at += 8 + n + n % 2

    walk(12, min(len(media), 8 + struct.unpack_from("<I", media, 4)[0]))
    start, n = found[b"strh"]
    scale, rate = struct.unpack_from("<II", media, start + 20)
    if not rate:  # the main header has microseconds a frame
        scale, rate = struct.unpack_from("<I", media, found[b"avih"][0])[0], 1_000_000
        if not scale:
            raise ValueError("no frame rate")
    movi, at = found[b"movi"][0], found[b"idx1"]
    comment = b""
    if b"ICMT" in found:
        s, n = found[b"ICMT"]
        comment = media[s : s + n].rstrip(b"\0")
    entries = [struct.unpack_from("<4sIII", media, at[0] + k) for k in range(0, at[1] // 16 * 16, 16)]
    from_file = bool(entries) and media[movi + entries[0][2] : movi + entries[0][2] + 4] != entries[0][0]  # some writers count from the file's start
    base = 0 if from_file else movi
    return rate / max(1, scale), comment.decode("utf-8", "replace"), [media[base + o + 8 : base + o + 8 + size] for name, _, o, size in entries if name[2:4] in (b"dc", b"db")]


def store(payload: bytes) -> bytes:
    """A film of a payload whose length is a positive multiple of 64."""
    rows = min(BLOCKS, len(payload) // BLOCKS)
    per = rows * BLOCKS
    samples = np.frombuffer(payload + b"\0" * (-len(payload) % per), np.uint8).reshape(-1, rows, BLOCKS)
    return write_avi([encode_frame(s) for s in samples], 8 * BLOCKS, 8 * rows, f"payload={len(payload)}")


def histograms(frames: list[np.ndarray]) -> np.ndarray:
    """Share of each of BINS bands of luminance, a row a frame."""
    return np.array([np.bincount(f.reshape(-1) >> 3, minlength=BINS) / f.size for f in frames])


def shots(hist: np.ndarray) -> list[tuple[int, int]]:
    """First and last frame of every shot."""
    if not len(hist):
        return []
    diff = np.abs(np.diff(hist, axis=0)).sum(1) / 2
    starts = [0]
    for i, d in enumerate(diff):
        past = diff[max(starts[-1], i - WINDOW) : i]
        if d > FLOOR and (not len(past) or d > past.mean() + THREE * past.std()):
            starts.append(i + 1)
    return [(a, b - 1) for a, b in zip(starts, [*starts[1:], len(hist)])]


def clips(films: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """A row for each shot of each film: id, clip, first_frame, last_frame, start_s, end_s, luminance (mean), damaged (frames of it that cannot be read).

    A damaged frame is passed over: it makes no cut, and counts to the shot that it follows, or at the start to the first. A film without a readable
    frame, or without an index, has no clips.
    """
    small_batches(films.sparkSession)
    kind = films.schema[id_col].dataType.simpleString()
    columns = f"id {kind}, clip int, first_frame int, last_frame int, start_s double, end_s double, luminance double, damaged int"
    bad = (ValueError, KeyError, IndexError, struct.error)

    def cut(film: bytes) -> list[tuple]:
        rate, _, frames = read_avi(film)
        hist, light, at = [], [], []
        for i, f in enumerate(frames):  # pixels of one frame at a time
            try:
                seen = decode_frame(f)
            except bad:
                continue
            hist.append(histograms([seen])[0])
            light.append(float(seen.mean()))
            at.append(i)
        found = shots(np.array(hist))
        starts = [0, *(at[a] for a, _ in found[1:]), len(frames)]
        return [(k, first, last - 1, first / rate, last / rate, float(np.mean(light[a : z + 1])), last - first - (z + 1 - a)) for k, ((a, z), first, last) in enumerate(zip(found, starts, starts[1:]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, out = [], []
            for i, m in enumerate(b.column(1)):
                try:
                    made = cut(m.as_py() or b"")
                except bad:  # no film
                    continue
                rows += [i] * len(made)
                out += made
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *(pa.array([x[k] for x in out], t) for k, t in enumerate(kinds))], [x.split()[0] for x in columns.split(", ")])

    return films.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInArrow(run, columns).withColumnRenamed("id", id_col)


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, media: every text's UTF-8 bytes, filled up with zeros, as a film."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            media = [store(padded((t.as_py() or "").encode())) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(media, pa.binary())], ["id", "media"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, media binary").withColumnRenamed("id", id_col)


def padded(raw: bytes) -> bytes:
    """raw with zeros up to a positive multiple of 64."""
    return raw + b"\0" * (64 if not raw else -len(raw) % 64)


def digests(docs: DataFrame) -> DataFrame:
    """Writes every text as a film, reads the film back, and returns digests and features of what was read."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def one(text: str) -> tuple:
        raw = text.encode()
        media = store(padded(raw))
        rate, comment, frames = read_avi(media)
        seen = [decode_frame(f, whole=False) for f in frames]
        back = np.concatenate([s.reshape(-1) for s in seen]).tobytes()[: int(comment.removeprefix("payload="))]
        hist = histograms(seen)
        cuts = shots(hist)
        bands = np.bincount(np.frombuffer(back, np.uint8) >> 5, minlength=8)
        feature = f"frames={len(seen)};clips={len(cuts)};seconds={len(seen) / rate:.2f};times={','.join(f'{a / rate:.2f}-{(z + 1) / rate:.2f}' for a, z in cuts)};bands={','.join(map(str, bands))}"
        return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        for b in batches:
            rows = [one(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], [x.split()[0] for x in columns.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, columns)
