"""Baseline JPEG files out (K7): every colour at full size, Huffman tables made for each picture from its own counts."""

from __future__ import annotations

import heapq
import struct

import numpy as np

#: The standard's example tables (ITU T.81, K.1) for brightness and for colour, line by line.
BRIGHTNESS = (
    (16, 11, 10, 16, 24, 40, 51, 61), (12, 12, 14, 19, 26, 58, 60, 55), (14, 13, 16, 24, 40, 57, 69, 56), (14, 17, 22, 29, 51, 87, 80, 62),
    (18, 22, 37, 56, 68, 109, 103, 77), (24, 35, 55, 64, 81, 104, 113, 92), (49, 64, 78, 87, 103, 121, 120, 101), (72, 92, 95, 98, 112, 100, 103, 99),
)
COLOUR = (
    (17, 18, 24, 47, 99, 99, 99, 99), (18, 21, 26, 66, 99, 99, 99, 99), (24, 26, 56, 99, 99, 99, 99, 99), (47, 66, 99, 99, 99, 99, 99, 99),
    (99, 99, 99, 99, 99, 99, 99, 99), (99, 99, 99, 99, 99, 99, 99, 99), (99, 99, 99, 99, 99, 99, 99, 99), (99, 99, 99, 99, 99, 99, 99, 99),
)

#: Places of a block's numbers in the order of a file: along diagonals, turning at each end.
ZIGZAG = np.array([i * 8 + j for i, j in sorted(((i, j) for i in range(8) for j in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))])
_WAVES = np.sqrt(2 / 8) * np.cos((2 * np.arange(8) + 1) * np.arange(8)[:, None] * np.pi / 16) * np.where(np.arange(8)[:, None], 1, np.sqrt(0.5))


def scaled(table: tuple[tuple[int, ...], ...], quality: int) -> np.ndarray:
    """A table for a quality of 1 .. 100."""
    factor = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(table).ravel() * factor + 50) // 100, 1, 255)


def lengths(counts: dict[int, int]) -> dict[int, int]:
    """Bits of each symbol's Huffman code, 16 at most; the code of ones alone is left free."""
    while True:
        heap = [(0, 256, (256,))] + [(n, s, (s,)) for s, n in counts.items()]
        bits = dict.fromkeys([256, *counts], 0)
        heapq.heapify(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                bits[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(bits.values()) <= 16:
            return {s: n for s, n in bits.items() if s != 256}
        counts = {s: (n + 1) // 2 for s, n in counts.items()}


def codes(bits: dict[int, int]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Codes and their lengths by symbol, and the table as a file has it."""
    code, last, value, size = 0, 0, np.zeros(256, np.int64), np.zeros(256, np.int64)
    order = sorted(bits, key=lambda s: (bits[s], s))
    for s in order:
        code <<= bits[s] - last
        last = bits[s]
        value[s], size[s] = code, last
        code += 1
    return value, size, bytes(list(bits.values()).count(n) for n in range(1, 17)) + bytes(order)


def _magnitudes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many bits a number takes, and these bits; negative ones less one."""
    size = np.frexp(np.abs(v).astype(float))[1].astype(np.int64)
    return size, np.where(v < 0, v + (1 << size) - 1, v)


def encoded(image: np.ndarray, quality: int = 92) -> bytes:
    """A JPEG file of 8-bit grey, BGR or BGRA pixels; alpha isn't kept."""
    h, w = image.shape[:2]
    if image.ndim == 2:
        planes = [image.astype(float)]
    else:
        b, g, r = (image[..., k].astype(float) for k in range(3))
        y = 0.299 * r + 0.587 * g + 0.114 * b
        planes = [y, (b - y) / 1.772 + 128, (r - y) / 1.402 + 128]
    tables = [scaled(t, quality) for t in (BRIGHTNESS, COLOUR)[: min(2, len(planes))]]
    parts = []
    for k, plane in enumerate(planes):
        whole = np.pad(plane - 128, ((0, -h % 8), (0, -w % 8)), mode="edge")
        blocks = whole.reshape(whole.shape[0] // 8, 8, whole.shape[1] // 8, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
        parts.append(np.rint((_WAVES @ blocks @ _WAVES.T).reshape(-1, 64) / tables[min(k, 1)]).astype(np.int64)[:, ZIGZAG])
    c = len(planes)
    steps = [np.diff(p[:, 0], prepend=0) for p in parts]
    values, first = np.stack(parts, 1).reshape(-1, 64), np.stack(steps, 1).ravel()
    n = len(values)

    # What is written: (place, table, symbol, extra bits and how many); tables 0, 1 of steps and 2, 3 of the rest.
    kind = np.minimum(np.arange(n) % c, 1)
    size, extra = _magnitudes(first)
    events = [(np.arange(n) * 300, kind, size, extra, size)]
    block, at = np.nonzero(values[:, 1:])
    at += 1
    same = np.diff(block, prepend=-1) == 0
    run = at - np.where(same, np.roll(at, 1), 0) - 1
    size, extra = _magnitudes(values[block, at])
    events.append((block * 300 + at * 4 + 3, kind[block] + 2, run % 16 << 4 | size, extra, size))
    for k in range(3):
        long = np.flatnonzero(run // 16 > k)
        none = np.zeros(len(long), np.int64)
        events.append((block[long] * 300 + at[long] * 4 + k, kind[block[long]] + 2, none + 0xF0, none, none))
    short = np.flatnonzero(values[:, 63] == 0)
    none = np.zeros(len(short), np.int64)
    events.append((short * 300 + 299, kind[short] + 2, none, none, none))
    place, table, symbol, extra, more = (np.concatenate(v) for v in zip(*events, strict=True))
    order = np.argsort(place, kind="stable")
    table, symbol, extra, more = table[order], symbol[order], extra[order], more[order]

    value, size, huffman = np.zeros((4, 256), np.int64), np.zeros((4, 256), np.int64), b""
    for t in np.unique(table):
        found, count = np.unique(symbol[table == t], return_counts=True)
        value[t], size[t], own = codes(lengths(dict(zip(found.tolist(), count.tolist()))))
        huffman += bytes([(t // 2) << 4 | t % 2]) + own
    number, long = value[table, symbol] << more | extra, size[table, symbol] + more
    ends = np.cumsum(long)
    left = np.repeat(ends, long) - 1 - np.arange(ends[-1])
    bits = (np.repeat(number, long) >> left & 1).astype(np.uint8)
    body = np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes().replace(b"\xff", b"\xff\x00")

    def segment(mark: int, part: bytes) -> bytes:
        return struct.pack(">BBH", 0xFF, mark, len(part) + 2) + part

    quantised = b"".join(bytes([k]) + bytes(t[ZIGZAG].tolist()) for k, t in enumerate(tables))
    frame = struct.pack(">BHHB", 8, h, w, c) + b"".join(bytes([k + 1, 0x11, min(k, 1)]) for k in range(c))
    scan = bytes([c]) + b"".join(bytes([k + 1, min(k, 1) * 0x11]) for k in range(c)) + b"\x00\x3f\x00"
    head = b"\xff\xd8" + segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + segment(0xDB, quantised) + segment(0xC0, frame)
    return head + segment(0xC4, huffman) + segment(0xDA, scan) + body + b"\xff\xd9"
