"""Payloads of detector messages to pixels: LZ4 with and without shuffled bits, and messages in CBOR.

Compressed payloads have the layout of the public HDF5 filters: a big-endian header (8 bytes: size of the data, 4 bytes:
size of a block), then each block behind its own size (4 bytes).  Of shuffled data, blocks hold a multiple of 8 elements,
bit plane after bit plane, and the last elements (less than 8) stand plain at the end."""

from __future__ import annotations

import struct

import numpy as np

#: Bytes of a block, as writers of such payloads choose it.
BLOCK = 8192
#: Bytes of blocks whose bits are spread out at once: each bit takes a byte then.
SPREAD = 1 << 19


def _shuffle(elements: np.ndarray) -> np.ndarray:
    """Bytes of the bit planes of each row of little-endian elements, lowest bit first."""
    n, m = elements.shape
    bits = np.unpackbits(elements.view(np.uint8).reshape(n, m, elements.itemsize), axis=2, bitorder="little")
    return np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little").reshape(n, -1)


def _unshuffle(planes: np.ndarray, kind: np.dtype) -> np.ndarray:
    """The elements of rows of bit planes: blocks of one size together, as many as SPREAD holds."""
    n, size = planes.shape
    m = size // kind.itemsize
    out, step = np.empty((n, m), kind), max(1, SPREAD // size)
    for at in range(0, n, step):
        some = planes[at : at + step]
        bits = np.unpackbits(some.reshape(len(some), 8 * kind.itemsize, m // 8), axis=2, bitorder="little")
        out[at : at + step] = np.ascontiguousarray(np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")).reshape(len(some), -1).view(kind)
    return out


def _codec():
    import pyarrow as pa

    return pa.Codec("lz4_raw")


def compress(px: np.ndarray, shuffled: bool, block: int = BLOCK) -> bytes:
    """A payload of unsigned 16- or 32-bit pixels."""
    kind = px.dtype
    raw, codec = px.tobytes(), _codec()
    parts = [struct.pack(">QI", len(raw), block)]
    step = 8 * kind.itemsize
    whole = len(raw) // step * step if shuffled else len(raw)
    for at in range(0, whole, block):
        piece = raw[at : min(at + block, whole)]
        if shuffled:
            piece = _shuffle(np.frombuffer(piece, kind)[None]).tobytes()
        packed = codec.compress(piece).to_pybytes()
        if not shuffled and len(packed) >= len(piece):
            packed = piece  # plain, as its size tells
        parts += [struct.pack(">I", len(packed)), packed]
    return b"".join([*parts, raw[whole:]])


def _blocks(payload: bytes, kind: np.dtype, shuffled: bool) -> tuple[int, list[tuple[int, bytes]], bytes]:
    """(bytes of the data, (size, bytes) of each decompressed block, the plain rest)."""
    if len(payload) < 12:
        raise ValueError("a compressed payload has no header")
    total, block = struct.unpack_from(">QI", payload)
    step = 8 * kind.itemsize if shuffled else 1
    block = block or BLOCK
    if block % step or total % kind.itemsize:
        raise ValueError(f"blocks of {block} bytes do not fit {kind}")
    codec, at, out = _codec(), 12, []
    whole = total // step * step
    for start in range(0, whole, block):
        size = min(block, whole - start)
        if at + 4 > len(payload):
            raise ValueError("a compressed payload ends early")
        (n,) = struct.unpack_from(">I", payload, at)
        piece = payload[at + 4 : at + 4 + n]
        at += 4 + n
        if len(piece) != n:
            raise ValueError("a compressed payload ends early")
        if not shuffled and n == size:
            out.append((size, piece))
            continue
        try:
            got = codec.decompress(piece, size).to_pybytes()
        except OSError as e:
            raise ValueError(f"a block cannot be decompressed: {e}") from e
        if len(got) != size:
            raise ValueError("a block cannot be decompressed")
        out.append((size, got))
    rest = payload[at:]
    if len(rest) != total - whole:
        raise ValueError("a compressed payload has another length than it says")
    return total, out, rest


def decompress(payloads: list[bytes], kind: np.dtype, shuffled: bool) -> list[np.ndarray]:
    """The pixels of payloads of one element type; blocks of one size are brought back to elements together.  What is
    damaged is an error."""
    kind = np.dtype(kind)
    found = [_blocks(p, kind, shuffled) for p in payloads]
    if not shuffled:
        return [np.frombuffer(b"".join(b for _, b in blocks), kind) for _, blocks, _ in found]
    by_size: dict[int, list[bytes]] = {}
    for _, blocks, _ in found:
        for size, b in blocks:
            by_size.setdefault(size, []).append(b)
    plain = {size: iter(_unshuffle(np.frombuffer(b"".join(bs), np.uint8).reshape(len(bs), size), kind)) for size, bs in by_size.items()}
    return [np.concatenate([*(next(plain[size]) for size, _ in blocks), np.frombuffer(rest, kind)]) if blocks or rest else np.zeros(0, kind) for _, blocks, rest in found]


# ---------------------------------------------------------------- CBOR
#: Tags of the public registry and of the detector's stream: arrays with a shape, typed arrays, compressed bytes.
SHAPED, COMPRESSED = 40, 56500
TYPED = {69: "<u2", 70: "<u4"}


class Tagged:
    """A value with its tag."""

    def __init__(self, tag: int, value):
        self.tag, self.value = tag, value


def read_cbor(raw: bytes):
    """A message as dicts, lists, bytes, texts, numbers and Tagged; anything behind it is an error."""
    value, at = _item(raw, 0)
    if at != len(raw):
        raise ValueError("there is something behind the message")
    return value


_BREAK = object()


def _item(raw: bytes, at: int):
    if at >= len(raw):
        raise ValueError("the message ends early")
    major, low = raw[at] >> 5, raw[at] & 31
    at += 1
    if low < 24:
        n = low
    elif low < 28:
        size = 1 << (low - 24)
        if at + size > len(raw):
            raise ValueError("the message ends early")
        n, at = int.from_bytes(raw[at : at + size], "big"), at + size
    elif low == 31 and major in (2, 3, 4, 5, 7):
        n = None  # up to a break
    else:
        raise ValueError(f"no item begins with {major}/{low}")
    if major == 0:
        return n, at
    if major == 1:
        return -1 - n, at
    if major in (2, 3):
        if n is None:
            parts, at = _until(raw, at, None)
            return (b"" if major == 2 else "").join(parts), at
        if at + n > len(raw):
            raise ValueError("the message ends early")
        part = bytes(raw[at : at + n])
        return (part if major == 2 else part.decode()), at + n
    if major == 4:
        return _until(raw, at, n)
    if major == 5:
        flat, at = _until(raw, at, None if n is None else 2 * n)
        return dict(zip(flat[::2], flat[1::2], strict=True)), at
    if major == 6:
        value, at = _item(raw, at)
        return Tagged(n, value), at
    if low == 31:
        return _BREAK, at
    if low in (25, 26, 27):
        return struct.unpack({25: ">e", 26: ">f", 27: ">d"}[low], raw[at - (1 << (low - 24)) : at])[0], at
    return {20: False, 21: True, 22: None, 23: None}.get(n, n), at


def _until(raw: bytes, at: int, n: int | None) -> tuple[list, int]:
    out: list = []
    while n is None or len(out) < n:
        value, at = _item(raw, at)
        if value is _BREAK:
            if n is not None:
                raise ValueError("a break within a list of known length")
            break
        out.append(value)
    return out, at


def write_cbor(value) -> bytes:
    """The shortest form of dicts, lists, bytes, texts, whole numbers, floats, None, booleans and Tagged."""

    def head(major: int, n: int) -> bytes:
        for low, size in ((24, 1), (25, 2), (26, 4), (27, 8)):
            if n < 24:
                return bytes([major << 5 | n])
            if n < 1 << 8 * size:
                return bytes([major << 5 | low]) + n.to_bytes(size, "big")
        raise ValueError("a number of more than 64 bits")

    if value is None or isinstance(value, bool):
        return bytes([0xF6 if value is None else 0xF4 + value])
    if isinstance(value, int):
        return head(0, value) if value >= 0 else head(1, -1 - value)
    if isinstance(value, float):
        return b"\xfb" + struct.pack(">d", value)
    if isinstance(value, bytes):
        return head(2, len(value)) + value
    if isinstance(value, str):
        return head(3, len(value.encode())) + value.encode()
    if isinstance(value, list):
        return head(4, len(value)) + b"".join(map(write_cbor, value))
    if isinstance(value, dict):
        return head(5, len(value)) + b"".join(write_cbor(x) for kv in value.items() for x in kv)
    if isinstance(value, Tagged):
        return head(6, value.tag) + write_cbor(value.value)
    raise TypeError(type(value))


def image_of(message: dict, channel: str) -> tuple[int | None, int, int, np.ndarray]:
    """(number, rows, columns, pixels) of an image message; elements of an unknown tag and other compressions are errors."""
    shaped = message["data"][channel]
    if not isinstance(shaped, Tagged) or shaped.tag != SHAPED:
        raise ValueError("the image has no shape")
    (rows, cols), body = shaped.value
    if not isinstance(body, Tagged) or body.tag not in TYPED:
        raise ValueError(f"elements of tag {getattr(body, 'tag', None)} cannot be read")
    kind = np.dtype(TYPED[body.tag])
    if isinstance(body.value, bytes):
        px = np.frombuffer(body.value, kind)
    elif isinstance(body.value, Tagged) and body.value.tag == COMPRESSED:
        how, size, raw = body.value.value
        if how not in ("bslz4", "lz4") or size != kind.itemsize:
            raise ValueError(f"compression {how!r} of elements of {size} bytes cannot be read")
        (px,) = decompress([raw], kind, how == "bslz4")
    else:
        raise ValueError("the image has no pixels")
    if len(px) != rows * cols:
        raise ValueError(f"{len(px)} pixels are not {rows} x {cols}")
    return message.get("image_id"), rows, cols, px


def image_message(number: int, px: np.ndarray, rows: int, cols: int, compression: str | None, channel: str = "threshold_1") -> bytes:
    """An image message of unsigned 16- or 32-bit pixels."""
    tag = {2: 69, 4: 70}[px.dtype.itemsize]
    body = px.tobytes() if compression is None else Tagged(COMPRESSED, [compression, px.dtype.itemsize, compress(px, compression == "bslz4")])
    return write_cbor({"type": "image", "series_id": 1, "image_id": int(number), "data": {channel: Tagged(SHAPED, [[rows, cols], Tagged(tag, body)])}})
