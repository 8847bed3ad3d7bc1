"""A small PNG codec on zlib: 8-bit RGBA out; 8-bit grey, RGB, palette and alpha in, not interlaced."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(image: np.ndarray) -> bytes:
    h, w = image.shape[:2]
    rows = np.zeros((h, 1 + 4 * w), np.uint8)
    rows[:, 1:] = image.reshape(h, 4 * w)
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 9)) + _chunk(b"IEND", b"")


def decode(data: bytes) -> np.ndarray:
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, parts, palette, clear, head = 8, [], None, None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = np.frombuffer(body, np.uint8)
        elif kind == b"IDAT":
            parts.append(body)
    if head is None or head[2] != 8 or head[3] not in _CHANNELS or head[6]:
        raise ValueError("only 8-bit PNG without interlacing is read")
    w, h, _, kind, *_ = head
    step = _CHANNELS[kind]
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(h, 1 + w * step)
    out = np.zeros((h, w * step), np.uint8)
    for y in range(h):
        line, up = raw[y, 1:].astype(int), out[y - 1].astype(int) if y else np.zeros(w * step, int)
        how = raw[y, 0]
        if how == 2:
            line = line + up
        elif how:  # the left neighbour is needed first
            for x in range(w * step):
                a, b = (line[x - step] & 255 if x >= step else 0), up[x]
                c = up[x - step] if x >= step else 0
                if how == 4:
                    p = a + b - c
                    guess = min((a, b, c), key=lambda v: abs(p - v))
                line[x] = (line[x] + (a if how == 1 else (a + b) // 2 if how == 3 else guess)) & 255
        out[y] = line & 255
    v = out.reshape(h, w, step)
    rgba = np.full((h, w, 4), 255, np.uint8)
    if kind == 3:
        rgba[..., :3] = palette[v[..., 0]]
        if clear is not None:
            rgba[..., 3] = np.concatenate((clear, np.full(256 - len(clear), 255, np.uint8)))[v[..., 0]]
    else:
        rgba[..., :3] = v[..., :3] if step >= 3 else v[..., :1]
        if step in (2, 4):
            rgba[..., 3] = v[..., -1]
    return rgba
