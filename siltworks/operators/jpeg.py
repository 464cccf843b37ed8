"""Baseline JPEG images without an image library: Huffman codes, quantised 8 x 8 cosine transforms, chroma at lower resolution."""

from __future__ import annotations

import numpy as np

#: The path through a block's coefficients, lowest frequencies first, by diagonals.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_K = np.arange(8)
#: The orthonormal cosine transform of eight values.
COSINES = np.where(_K[:, None] == 0, np.sqrt(1 / 8), 0.5 * np.cos((2 * _K[None] + 1) * _K[:, None] * np.pi / 16))


class _Codes:
    """A Huffman table: for the next 16 bits of a stream, the symbol they begin with and the length of its code."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.symbol, self.length = np.zeros(1 << 16, np.int16), np.zeros(1 << 16, np.int8)
        code = at = 0
        for bits, n in enumerate(counts, 1):
            for _ in range(n):
                if at >= len(symbols) or code >= 1 << bits:
                    raise ValueError("broken code table")
                low = code << (16 - bits)
                self.symbol[low : low + (1 << (16 - bits))], self.length[low : low + (1 << (16 - bits))] = symbols[at], bits
                code, at = code + 1, at + 1
            code <<= 1
        self.symbol, self.length = self.symbol.tolist(), self.length.tolist()


class _Bits:
    """Bits of one stretch of a scan, stuffing removed. What lies beyond its end reads as zeros, up to a bound."""

    def __init__(self, data: bytes):
        self.data, self.at = data.replace(b"\xff\x00", b"\xff") + bytes(8), 0
        self.end = 8 * (len(self.data) - 8)

    def peek(self) -> int:
        byte, off = self.at >> 3, self.at & 7
        return (int.from_bytes(self.data[byte : byte + 3], "big") >> (8 - off)) & 0xFFFF

    def symbol(self, codes: _Codes) -> int:
        if self.at > self.end:
            raise ValueError("image data ends early")
        next_ = self.peek()
        length = codes.length[next_]
        if not length:
            raise ValueError("unknown code")
        self.at += length
        return codes.symbol[next_]

    def number(self, size: int) -> int:
        """A signed number of ``size`` bits: those that begin with 0 are negative."""
        if not size:
            return 0
        value = self.peek() >> (16 - size)
        self.at += size
        return value if value >> (size - 1) else value - (1 << size) + 1


def _block(bits: _Bits, dc: _Codes, ac: _Codes, last: int, out: np.ndarray) -> int:
    """One block's coefficients into ``out``; the new first coefficient."""
    size = bits.symbol(dc)
    if size > 11:
        raise ValueError("coefficient too large")
    first = last + bits.number(size)
    out[0] = first
    k = 1
    while k < 64:
        run, size = divmod(bits.symbol(ac), 16)
        if not size:
            if run != 15:
                break
            k += 16
            continue
        k += run
        if k > 63:
            raise ValueError("more than 64 coefficients")
        out[ZIGZAG[k]] = bits.number(size)
        k += 1
    return first


def _segments(data: bytes):
    """Marker and body of each segment; the scan's data comes as marker 0 after its header."""
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("no marker where one should be")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            return
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if size < 2 or at + 2 + size > len(data):
            raise ValueError("a segment ends early")
        yield marker, data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDA:
            end = at
            while end + 1 < len(data) and not (data[end] == 0xFF and data[end + 1] not in (0, *range(0xD0, 0xD8))):
                end = data.find(b"\xff", end + 1)
                if end < 0:
                    end = len(data)
            yield 0, data[at:end]
            at = end


def decode_jpeg(data: bytes) -> np.ndarray:
    """A baseline JPEG as (h, w, channels), grey or RGB; raises ``ValueError`` for other kinds and for damaged files."""
    tables: dict[int, np.ndarray] = {}
    codes: dict[int, _Codes] = {}
    frame, restart, scan, planes = None, 0, None, None
    for marker, body in _segments(data):
        if marker == 0xDB:
            at = 0
            while at < len(body):
                wide = 2 if body[at] >> 4 else 1
                values = np.frombuffer(body, ">u2" if wide == 2 else np.uint8, 64, at + 1)
                table = np.zeros(64)
                table[ZIGZAG] = values
                tables[body[at] & 15] = table
                at += 1 + 64 * wide
        elif marker == 0xC4:
            at = 0
            while at < len(body):
                counts = body[at + 1 : at + 17]
                codes[body[at]] = _Codes(counts, body[at + 17 : at + 17 + sum(counts)])
                at += 17 + sum(counts)
        elif marker in (0xC0, 0xC1):
            if body[0] != 8 or len(body) < 6 + 3 * body[5] or body[5] not in (1, 3):
                raise ValueError("only grey or three-channel images of 8 bits are read")
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            frame = (int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big"), parts)
        elif 0xC2 <= marker <= 0xCF and marker != 0xCC:
            raise ValueError("only baseline JPEG files are read")
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            scan = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
        elif marker == 0:
            if frame is None or scan is None or not frame[0] or not frame[1]:
                raise ValueError("image data without a header")
            planes = _scan(body, frame, scan, restart, tables, codes)
    if planes is None:
        raise ValueError("no image data")
    height, width, parts = frame
    if len(parts) == 1:
        return planes[0][:height, :width, None]
    y, cb, cr = (p[:height, :width].astype(float) for p in planes)
    rgb = np.stack([y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128)], -1)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)


def _scan(data: bytes, frame: tuple, scan: list, restart: int, tables: dict, codes: dict) -> list[np.ndarray]:
    height, width, parts = frame
    top_h, top_v = max(p[1] for p in parts), max(p[2] for p in parts)
    if not all(p[1] and p[2] for p in parts) or len(scan) != len(parts):
        raise ValueError("only scans of all channels are read")
    if len(parts) == 1:
        top_h = top_v = 1
        parts = [(parts[0][0], 1, 1, parts[0][3])]
    across, down = -(-width // (8 * top_h)), -(-height // (8 * top_v))
    blocks = [np.zeros((down * v, across * h, 64)) for _, h, v, _ in parts]
    use = {name: (codes[dc], codes[16 + ac]) for name, dc, ac in scan if dc in codes and 16 + ac in codes}
    if any(p[0] not in use or p[3] not in tables for p in parts):
        raise ValueError("a table is missing")
    # Restart marks cut the scan into stretches that do not depend on each other.
    stretches, at = [], 0
    for cut in [k for k in range(len(data) - 1) if data[k] == 0xFF and 0xD0 <= data[k + 1] <= 0xD7] if restart else []:
        stretches.append(data[at:cut])
        at = cut + 2
    stretches.append(data[at:])
    units = across * down
    for i, stretch in enumerate(stretches):
        bits, last = _Bits(stretch), [0] * len(parts)
        for unit in range(i * restart, min(units, (i + 1) * restart) if restart else units):
            row, col = divmod(unit, across)
            for c, (name, h, v, _) in enumerate(parts):
                dc, ac = use[name]
                for b in range(h * v):
                    last[c] = _block(bits, dc, ac, last[c], blocks[c][row * v + b // h, col * h + b % h])
        if restart and (i + 1) * restart >= units:
            break
    else:
        if restart and len(stretches) * restart < units:
            raise ValueError("image data ends early")
    out = []
    for (_, h, v, table), plane in zip(parts, blocks, strict=True):
        spectrum = (plane * tables[table]).reshape(*plane.shape[:2], 8, 8)
        values = np.einsum("ki,rckl,lj->ricj", COSINES, spectrum, COSINES, optimize=True).reshape(plane.shape[0] * 8, -1) + 128
        values = np.clip(np.rint(values), 0, 255).astype(np.uint8)
        out.append(values.repeat(top_v // v, 0).repeat(top_h // h, 1))
    return out


def quantised(grey: np.ndarray, step: np.ndarray | float) -> np.ndarray:
    """The coefficients of a grey image's blocks in steps of ``step``, as (rows, columns, 64); edges are repeated to whole blocks."""
    h, w = grey.shape
    padded = np.pad(np.asarray(grey, float), ((0, -h % 8), (0, -w % 8)), mode="edge") - 128
    cut = padded.reshape(padded.shape[0] // 8, 8, -1, 8)
    spectrum = np.einsum("ki,ricj,lj->rckl", COSINES, cut, COSINES, optimize=True)
    return np.rint(spectrum.reshape(*spectrum.shape[:2], 64) / step).astype(int)


def restored(coefficients: np.ndarray, step: np.ndarray | float, height: int, width: int) -> np.ndarray:
    """The grey image of quantised coefficients, in 0 to 255, not rounded."""
    spectrum = (coefficients * step).reshape(*coefficients.shape[:2], 8, 8)
    values = np.einsum("ki,rckl,lj->ricj", COSINES, spectrum, COSINES, optimize=True)
    return np.clip(values.reshape(coefficients.shape[0] * 8, -1)[:height, :width] + 128, 0, 255)


def within_a_level(coefficients: np.ndarray, grey: np.ndarray) -> np.ndarray:
    """Coefficients in steps of one, changed where they restore a pixel more than one level from ``grey``.

    Rounding 64 coefficients adds up to that at one pixel in some millions. There the coefficient goes up or down by one
    that leaves the least beyond the bound, until no pixel is; blocks within it stay as they are.
    """
    h, w = grey.shape
    wanted = np.pad(np.asarray(grey, float), ((0, -h % 8), (0, -w % 8)), mode="edge")
    off = np.abs(np.rint(restored(coefficients, 1, *wanted.shape)) - wanted)
    far = off.reshape(coefficients.shape[0], 8, -1, 8).max((1, 3)) > 1
    if not far.any():
        return coefficients
    out = coefficients.copy()
    waves = np.einsum("ki,lj->klij", COSINES, COSINES).reshape(64, 8, 8)
    for row, column in np.argwhere(far):
        pixels = wanted[8 * row : 8 * row + 8, 8 * column : 8 * column + 8]
        block = out[row, column]
        for _ in range(256):
            error = np.tensordot(block, waves, 1) + 128 - pixels
            beyond = lambda e: np.where(np.abs(np.rint(np.clip(e + pixels, 0, 255)) - pixels) > 1, np.abs(e) - 1.45, 0)
            if not beyond(error).any():
                break
            y, x = np.unravel_index(beyond(error).argmax(), (8, 8))
            turns = -np.sign(error[y, x] * waves[:, y, x])
            tried = error + turns[:, None, None] * waves
            cost = np.square(np.maximum(np.abs(tried) - 1.45, 0)).sum((1, 2)) + 1e-3 * np.square(tried).sum((1, 2))
            block[cost.argmin()] += int(turns[cost.argmin()])
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


#: Codes of one length for all symbols: 12 sizes of first coefficients, and runs and sizes of others.
_DC = list(range(12))
_AC = [0x00, 0xF0, *(16 * run + size for run in range(16) for size in range(1, 11))]


def encode_jpeg(grey: np.ndarray, step: int = 1) -> bytes:
    """A grey image of 8 bits as a baseline JPEG with the same ``step`` for all coefficients. Codes are plain, not short.

    With a step of one every pixel decodes to within one level of what it was.
    """
    h, w = grey.shape
    out = [b"\xff\xd8", _segment(0xDB, bytes([0] + [step] * 64)), _segment(0xC0, bytes([8, *divmod(h, 256), *divmod(w, 256), 1, 1, 0x11, 0]))]
    for kind, symbols, length in ((0x00, _DC, 4), (0x10, _AC, 8)):
        counts = [len(symbols) if k == length else 0 for k in range(1, 17)]
        out.append(_segment(0xC4, bytes([kind, *counts, *symbols])))
    out.append(_segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])))
    bits: list[str] = []

    def number(value: int, size: int) -> str:
        return format(value if value >= 0 else value + (1 << size) - 1, f"0{size}b") if size else ""

    last, code = 0, {s: format(k, "08b") for k, s in enumerate(_AC)}
    coefficients = quantised(grey, step)
    if step == 1:
        coefficients = within_a_level(coefficients, grey)
    for block in coefficients.reshape(-1, 64):
        line = block[ZIGZAG].tolist()
        size = abs(line[0] - last).bit_length()
        bits += [format(size, "04b"), number(line[0] - last, size)]
        last, run = line[0], 0
        end = max((k for k in range(1, 64) if line[k]), default=0)
        for value in line[1 : end + 1]:
            if not value:
                run += 1
                continue
            while run > 15:
                bits.append(code[0xF0])
                run -= 16
            size = abs(value).bit_length()
            bits += [code[16 * run + size], number(value, size)]
            run = 0
        if end < 63:
            bits.append(code[0x00])
    flat = "".join(bits)
    flat += "1" * (-len(flat) % 8)
    data = int(flat, 2).to_bytes(len(flat) // 8, "big").replace(b"\xff", b"\xff\x00") if flat else b""
    return b"".join([*out, data, b"\xff\xd9"])
