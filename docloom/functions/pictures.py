"""Pictures in Python workers: decode, cut, scale, encode.  Needs numpy alone; arrays are height x width x 3 bytes."""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Sequence

import numpy as np

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}  # by colour type
_FORMATS = ("jpeg", "png")

# Quantisation of luminance and chrominance at quality 50, row by row.
_LUMINANCE = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
_CHROMINANCE = (17, 18, 24, 47, 18, 21, 26, 66, 24, 26, 56, 99, 47, 66, 99, 99)  # the upper left 4 x 4; 99 elsewhere

#: Coefficients of a block from the lowest frequency on: diagonals, every other one upwards.
_ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))


def _chunks(content: bytes):
    at = len(_SIGNATURE)
    while at + 12 <= len(content):
        size, kind = struct.unpack_from(">I4s", content, at)
        body = content[at + 8 : at + 8 + size]
        if len(body) < size or zlib.crc32(kind + body) != struct.unpack_from(">I", content, at + 8 + size)[0]:
            raise OSError("the picture is damaged")
        yield kind, body
        at += 12 + size


def _unfiltered(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """Rows without PNG's filters; ``step`` is the bytes of a pixel."""
    rows = np.frombuffer(raw, np.uint8, height * (stride + 1)).reshape(height, stride + 1)
    out = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y, (kind, line) in enumerate(zip(rows[:, 0].tolist(), rows[:, 1:], strict=True)):
        if kind == 0:
            out[y] = line
        elif kind == 1:
            out[y] = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint64).astype(np.uint8).reshape(-1)
        elif kind == 2:
            out[y] = line + above
        elif kind in (3, 4):
            now, up = line.tolist(), above.tolist()
            for x in range(stride):
                left = now[x - step] if x >= step else 0
                if kind == 3:
                    guess = (left + up[x]) // 2
                else:
                    corner = up[x - step] if x >= step else 0
                    near = left + up[x] - corner
                    guess = min((left, up[x], corner), key=lambda v: abs(near - v))
                now[x] = (now[x] + guess) & 255
            out[y] = now
        else:
            raise OSError("the picture has an unknown filter")
        above = out[y]
    return out


def decode(content: bytes | None) -> np.ndarray:
    """The pixels of a PNG picture with 8 bits a channel, transparency dropped; OSError for anything else."""
    content = b"" if content is None else bytes(content)
    try:
        if not content.startswith(_SIGNATURE):
            raise OSError("not a PNG picture")
        found = list(_chunks(content))
        width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", dict(found)[b"IHDR"])
        if depth != 8 or interlaced or not width or not height:
            raise OSError("only plain PNG pictures with 8 bits a channel are read")
        step = _CHANNELS[colour]
        rows = _unfiltered(zlib.decompress(b"".join(body for kind, body in found if kind == b"IDAT")), height, width * step, step)
        pixels = rows.reshape(height, width, step)
        if colour == 3:
            palette = np.frombuffer(dict(found)[b"PLTE"], np.uint8).reshape(-1, 3)
            return palette[pixels[:, :, 0]]
        return np.repeat(pixels[:, :, :1], 3, axis=2) if step < 3 else np.ascontiguousarray(pixels[:, :, :3])
    except (KeyError, ValueError, IndexError, struct.error, zlib.error) as e:
        raise OSError(f"the picture can't be read: {e}") from e


def cut(picture: np.ndarray, box: Sequence[float]) -> np.ndarray:
    """The box x1, y1, x2, y2 of the picture, rounded half to even and cut at the edges; ValueError if nothing is in it."""
    x1, y1, x2, y2 = box
    if not (x2 > x1 and y2 > y1):
        raise ValueError(f"the box {box} is empty")
    height, width = picture.shape[:2]
    part = picture[max(0, round(y1)) : max(0, min(height, round(y2))), max(0, round(x1)) : max(0, min(width, round(x2)))]
    if not part.size:
        raise ValueError(f"the box {box} is not on the page")
    return part


def planes(picture: np.ndarray, side: int = 800) -> np.ndarray:
    """A layout model's input: 3 x side x side from 0 to 1, scaled by the four pixels around each centre."""

    def places(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(side) + 0.5) * n / side - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), (at - low).astype(np.float32)

    top, bottom, down = places(picture.shape[0])
    left, right, across = places(picture.shape[1])
    across, down = across[None, :, None], down[:, None, None]
    upper = picture[top][:, left] * (1 - across) + picture[top][:, right] * across
    lower = picture[bottom][:, left] * (1 - across) + picture[bottom][:, right] * across
    scaled = np.rint(upper * (1 - down) + lower * down)
    return np.ascontiguousarray((scaled / 255.0).astype(np.float32).transpose(2, 0, 1))


def encode(picture: np.ndarray, image_format: str = "png", jpeg_quality: int = 95) -> bytes:
    """PNG at compression level 6, or JPEG without subsampling of colours; ValueError for other formats."""
    if image_format not in _FORMATS:
        raise ValueError(f"unknown image format {image_format!r}")
    return _png(picture) if image_format == "png" else _jpeg(picture, jpeg_quality)


def _png(picture: np.ndarray) -> bytes:
    height, width = picture.shape[:2]
    rows = np.empty((height, 1 + width * 3), np.uint8)
    rows[:, 0] = 2  # each row less the one above
    flat = picture.reshape(height, -1)
    rows[:, 1:] = flat
    rows[1:, 1:] -= flat[:-1]

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return _SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


# -- JPEG ----------------------------------------------------------------------------------------


def _quantisers(quality: int) -> np.ndarray:
    quality = min(100, max(1, quality))
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    chroma = np.full((8, 8), 99)
    chroma[:4, :4] = np.reshape(_CHROMINANCE, (4, 4))
    both = np.stack([np.reshape(_LUMINANCE, (8, 8)), chroma])
    return np.clip((both * scale + 50) // 100, 1, 255)


def _coefficients(picture: np.ndarray, quantisers: np.ndarray) -> np.ndarray:
    """Quantised zigzag coefficients: a row a block, the three components of a place one after the other."""
    height, width = picture.shape[:2]
    padded = np.pad(picture, ((0, -height % 8), (0, -width % 8), (0, 0)), mode="edge").astype(np.float64)
    r, g, b = np.moveaxis(padded, 2, 0)
    y = 0.299 * r + 0.587 * g + 0.114 * b
    parts = np.stack([y - 128, (b - y) / 1.772, (r - y) / 1.402])
    blocks = parts.reshape(3, padded.shape[0] // 8, 8, padded.shape[1] // 8, 8).transpose(1, 3, 0, 2, 4)
    k, n = np.mgrid[:8, :8]
    cosines = np.cos((2 * n + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    found = cosines @ blocks @ cosines.T
    return np.rint(found / quantisers[[0, 1, 1]]).astype(np.int64).reshape(-1, 64)[:, _ZIGZAG]


def _code_lengths(counts: np.ndarray) -> dict[int, int]:
    """Symbol -> bits of its Huffman code, at most 16; no code is all ones."""
    weights = {int(s): int(counts[s]) for s in np.flatnonzero(counts)}
    while True:
        spare = -1  # takes the code of all ones, and is never written
        heap = [(n, s, (s,)) for s, n in [*weights.items(), (spare, 0)]]
        heapq.heapify(heap)
        depth = dict.fromkeys([*weights, spare], 0)
        while len(heap) > 1:
            (n, _, some), (m, tie, others) = heapq.heappop(heap), heapq.heappop(heap)
            for s in some + others:
                depth[s] += 1
            heapq.heappush(heap, (n + m, tie, some + others))
        if max(depth.values()) <= 16:
            del depth[spare]
            return depth
        weights = {s: (n + 1) // 2 for s, n in weights.items()}


def _codes(counts: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The table as it is written, and each symbol's code and length."""
    lengths = _code_lengths(counts)
    ordered = sorted(lengths, key=lambda s: (lengths[s], s))
    code, sizes = np.zeros(256, np.int64), np.zeros(256, np.int64)
    now = before = 0
    for s in ordered:
        now <<= lengths[s] - before
        before = lengths[s]
        code[s], sizes[s] = now, before
        now += 1
    return bytes(sum(v == n for v in lengths.values()) for n in range(1, 17)) + bytes(ordered), code, sizes


def _entropy_coded(z: np.ndarray) -> tuple[list[bytes], bytes]:
    """The tables of first and of other coefficients, and the coded blocks."""
    n = len(z)
    first = np.diff(z[:, 0].reshape(-1, 3), axis=0, prepend=0).reshape(-1)
    row, column = np.nonzero(z[:, 1:])
    column += 1
    follows = np.concatenate(([False], row[1:] == row[:-1]))[: len(row)]
    run = column - np.where(follows, np.roll(column, 1), 0) - 1
    values = np.concatenate([first, z[row, column]])
    bits = np.zeros(len(values), np.int64)
    for i in range(12):
        bits += np.abs(values) >= 1 << i
    longest = np.repeat(np.arange(len(row)), run // 16)  # runs of 16 zeros
    furthest = np.zeros(n, np.int64)
    np.maximum.at(furthest, row, column)
    open_ended = np.flatnonzero(furthest < 63)
    zeros = np.zeros(len(longest) + len(open_ended), np.int64)
    symbol = np.concatenate([bits[:n], (run % 16) << 4 | bits[n:], np.full(len(longest), 0xF0), np.zeros(len(open_ended), np.int64)])
    extra = np.concatenate([np.where(values > 0, values, values + (1 << bits) - 1), zeros])
    size = np.concatenate([bits, zeros])
    is_first = np.arange(len(symbol)) < n
    place = np.concatenate([np.arange(n) * 256, row * 256 + 2 * column + 1, row[longest] * 256 + 2 * column[longest], open_ended * 256 + 255])
    order = np.argsort(place, kind="stable")
    tables = [_codes(np.bincount(symbol[who], minlength=256)) for who in (is_first, ~is_first)]
    code = np.where(is_first, tables[0][1][symbol], tables[1][1][symbol])
    lengths = (np.where(is_first, tables[0][2][symbol], tables[1][2][symbol]) + size)[order]
    words = (code << size | extra)[order]
    out, rest = [], np.empty(0, np.uint8)
    for at in range(0, len(words), 1 << 18):  # bounded memory whatever the picture's size
        some, long = words[at : at + (1 << 18)], lengths[at : at + (1 << 18)]
        ends = np.cumsum(long)
        shift = np.repeat(ends, long) - 1 - np.arange(ends[-1])
        stream = np.concatenate([rest, (np.repeat(some, long) >> shift & 1).astype(np.uint8)])
        whole = len(stream) // 8 * 8
        out.append(np.packbits(stream[:whole]).tobytes())
        rest = stream[whole:]
    if len(rest):
        out.append(np.packbits(np.concatenate([rest, np.ones(8 - len(rest), np.uint8)])).tobytes())
    return [t[0] for t in tables], b"".join(out).replace(b"\xff", b"\xff\x00")


def _jpeg(picture: np.ndarray, quality: int) -> bytes:
    height, width = picture.shape[:2]
    quantisers = _quantisers(quality)
    tables, data = _entropy_coded(_coefficients(picture, quantisers))

    def segment(mark: int, body: bytes) -> bytes:
        return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body

    out = b"\xff\xd8" + segment(0xE0, b"JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00")
    for i, table in enumerate(quantisers):
        out += segment(0xDB, bytes([i, *table.reshape(-1)[_ZIGZAG].tolist()]))
    out += segment(0xC0, struct.pack(">BHHB", 8, height, width, 3) + bytes([1, 0x11, 0, 2, 0x11, 1, 3, 0x11, 1]))
    out += segment(0xC4, b"\x00" + tables[0]) + segment(0xC4, b"\x10" + tables[1])
    out += segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
    return out + data + b"\xff\xd9"
