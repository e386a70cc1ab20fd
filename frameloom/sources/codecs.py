"""Small per-file codecs used inside tasks: npy and vpp headers, png. No Spark here."""

from __future__ import annotations

import ast
import struct
import zlib

import numpy as np

# Signatures and the png colour types with their sample counts.
NPY_SIGNATURE = b"\x93NUMPY"
VPP_SIGNATURE = b"VPP\x00"
VPP_HEADER = 16
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
PNG_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
# Start and step (x0, y0, dx, dy) of the seven interlace passes.
PNG_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


class DecodeError(ValueError):
    """A file that cannot be read; its message becomes a value."""


def npy_header(head: bytes) -> tuple[np.dtype, tuple[int, ...], int]:
    """Element type, shape and data offset of an npy file."""
    if head[:6] != NPY_SIGNATURE or len(head) < 10:
        raise DecodeError("npy: bad header")
    wide = head[6] >= 2
    size = struct.unpack_from("<I" if wide else "<H", head, 8)[0]
    start = 12 if wide else 10
    if len(head) < start + size:
        raise DecodeError("npy: header is cut short")
    try:
        described = ast.literal_eval(head[start : start + size].decode("latin1").strip())
        kind, shape = np.dtype(described["descr"]), tuple(described["shape"])
    except (ValueError, SyntaxError, KeyError, TypeError) as problem:
        raise DecodeError("npy: bad header") from problem
    if described.get("fortran_order"):
        raise DecodeError("npy: fortran order is not supported")
    if kind.hasobject or kind.fields or kind.kind not in "biuf":
        raise DecodeError(f"npy: unsupported element type {kind}")
    return kind, shape, start + size


def frames_of_shape(shape: tuple[int, ...]) -> tuple[int, int, int, int]:
    """(frames, h, w, c) of an array: 3-d is one colour image when its last extent is the smallest."""
    if len(shape) == 2:
        return 1, shape[0], shape[1], 1
    if len(shape) == 3:
        if shape[2] < shape[0] and shape[2] < shape[1]:
            return 1, shape[0], shape[1], shape[2]
        return shape[0], shape[1], shape[2], 1
    if len(shape) == 4:
        return shape[0], shape[1], shape[2], shape[3]
    raise DecodeError(f"npy: {len(shape)}-dimensional array")


def vpp_header(head: bytes, length: int) -> tuple[int, int, int, int]:
    """(frames, h, w, c) of a vpp file; a cut last frame does not count."""
    if head[:4] != VPP_SIGNATURE or len(head) < VPP_HEADER:
        raise DecodeError("error vpp")
    w, h, c = struct.unpack_from("<3i", head, 4)
    if min(w, h, c) <= 0:
        raise DecodeError("error vpp")
    return (length - VPP_HEADER) // (w * h * c * 4), h, w, c


def npy_bytes(array: np.ndarray) -> bytes:
    """An npy file of a C-ordered array."""
    array = np.ascontiguousarray(array)
    text = repr({"descr": array.dtype.str, "fortran_order": False, "shape": array.shape}).encode("latin1")
    padding = -(10 + len(text) + 1) % 64
    text += b" " * padding + b"\n"
    return NPY_SIGNATURE + b"\x01\x00" + struct.pack("<H", len(text)) + text + array.tobytes()


def vpp_bytes(frames: np.ndarray) -> bytes:
    """A vpp file of an (n, h, w, c) array."""
    _, h, w, c = frames.shape
    return VPP_SIGNATURE + struct.pack("<3i", w, h, c) + frames.astype("<f4").tobytes()


def png_bytes(image: np.ndarray) -> bytes:
    """A png of an (h, w, c) array of uint8 or uint16 with 1 to 4 bands."""
    h, w, c = image.shape
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[c]
    depth = 8 * image.dtype.itemsize
    rows = np.ascontiguousarray(image.astype(image.dtype.newbyteorder(">"))).view(np.uint8).reshape(h, -1)
    lines = np.concatenate([np.zeros((h, 1), np.uint8), rows], axis=1)

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    header = struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, 0)
    return PNG_SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def png_array(content: bytes) -> np.ndarray:
    """Decode a png to (h, w, c) float32: 8-bit samples as 0..255, 16-bit as 0..65535.

    Palettes become three bands, transparency adds one, small gray depths are stretched to 0..255.
    """
    if content[:8] != PNG_SIGNATURE:
        raise DecodeError("not a png file")
    at, chunks, ended = 8, {}, False
    while at + 8 <= len(content):
        size, name = struct.unpack_from(">I4s", content, at)
        if at + 12 + size > len(content):
            if name == b"IDAT":
                chunks.setdefault(name, []).append(content[at + 8 : at + 8 + size])
            break
        body = content[at + 8 : at + 8 + size]
        if zlib.crc32(name + body) != struct.unpack_from(">I", content, at + 8 + size)[0]:
            raise DecodeError(f"{name.decode('latin1')}: CRC error")
        chunks.setdefault(name, []).append(body)
        at += 12 + size
        if name == b"IEND":
            ended = True
            break
    if b"IHDR" not in chunks:
        raise DecodeError("truncated file?")
    w, h, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", chunks[b"IHDR"][0])
    samples = PNG_SAMPLES.get(colour)
    if samples is None or w == 0 or h == 0:
        raise DecodeError("bad png header")
    unpacker = zlib.decompressobj()
    try:
        data = unpacker.decompress(b"".join(chunks.get(b"IDAT", [])))
    except zlib.error as problem:
        raise DecodeError(str(problem)) from problem
    raw = np.frombuffer(data, np.uint8)

    passes = PNG_PASSES if interlaced else ((0, 0, 1, 1),)
    image = np.zeros((h, w, samples), np.uint16)
    at = 0
    for x0, y0, dx, dy in passes:
        pw, ph = -(-(w - x0) // dx), -(-(h - y0) // dy)
        if pw <= 0 or ph <= 0:
            continue
        line = (pw * samples * depth + 7) // 8
        if raw.size < at + ph * (line + 1):
            raise DecodeError("truncated file?")
        rows = raw[at : at + ph * (line + 1)].reshape(ph, line + 1)
        at += ph * (line + 1)
        plain = _unfilter(rows[:, 1:], rows[:, 0], max(1, samples * depth // 8))
        image[y0::dy, x0::dx] = _samples(plain, pw, samples, depth)
    if not ended and at > raw.size:
        raise DecodeError("truncated file?")
    return _expand(image, colour, depth, chunks)


def _unfilter(filtered: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """Undo the row filters of all rows at once, along anti-diagonals of pixels.

    A byte depends on its left, upper and upper-left neighbours, which all lie on earlier
    diagonals, so each diagonal is one vector operation over the rows.
    """
    h, line = filtered.shape
    if np.any(kinds > 4):
        raise DecodeError("bad adaptive filter value")
    if not kinds.any():
        return filtered
    pixels = line // step
    source = filtered.reshape(h, pixels, step).astype(np.int16)
    done = np.zeros((h + 1, pixels + 1, step), np.int16)  # a zero border above and to the left
    for d in range(h + pixels - 1):
        y = np.arange(max(0, d - pixels + 1), min(h, d + 1))
        x = d - y
        left, up, corner = done[y + 1, x], done[y, x + 1], done[y, x]
        guess = left + up - corner
        to_left, to_up, to_corner = abs(guess - left), abs(guess - up), abs(guess - corner)
        nearest = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))
        kind = kinds[y][:, None]
        base = np.select(
            [kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) >> 1, nearest], default=0
        )
        done[y + 1, x + 1] = (source[y, x] + base) & 255
    return done[1:, 1:].reshape(h, line).astype(np.uint8)


def _samples(rows: np.ndarray, w: int, samples: int, depth: int) -> np.ndarray:
    if depth == 16:
        return rows.reshape(rows.shape[0], -1).copy().view(">u2").reshape(-1, w, samples)
    if depth == 8:
        return rows.reshape(-1, w, samples)
    bits = np.unpackbits(rows, axis=1).reshape(rows.shape[0], -1, depth)
    weights = 1 << np.arange(depth - 1, -1, -1)
    return (bits * weights).sum(axis=2)[:, : w * samples].reshape(-1, w, samples)


def _expand(image: np.ndarray, colour: int, depth: int, chunks: dict) -> np.ndarray:
    clear = chunks.get(b"tRNS", [None])[0]
    if colour == 3:
        if b"PLTE" not in chunks:
            raise DecodeError("missing palette")
        table = np.frombuffer(chunks[b"PLTE"][0], np.uint8).reshape(-1, 3)
        index = image[:, :, 0]
        if index.max(initial=0) >= len(table):
            raise DecodeError("palette index out of range")
        out = table[index].astype(np.float32)
        if clear is not None:
            alpha = np.full(len(table), 255, np.uint8)
            alpha[: len(clear)] = np.frombuffer(clear, np.uint8)[: len(table)]
            out = np.concatenate([out, alpha[index][:, :, None].astype(np.float32)], axis=2)
        return out
    full = 65535 if depth == 16 else 255
    out = image.astype(np.float32)
    if colour == 0 and depth < 8:
        out *= 255 // ((1 << depth) - 1)
    if clear is not None and colour in (0, 2):
        key = np.frombuffer(clear, ">u2")[: image.shape[2]].astype(image.dtype)
        alpha = np.where((image == key).all(axis=2), 0, full).astype(np.float32)
        out = np.concatenate([out, alpha[:, :, None]], axis=2)
    return out
