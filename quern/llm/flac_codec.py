"""A FLAC encoder and decoder for mono 8-bit audio, in lockstep over many frames with numpy.

Encoder: blocks of 576 samples; a frame is constant, verbatim, fixed (orders 0 to 2) or LPC (order 4, 12-bit
coefficients), whichever is estimated smallest, with Rice residuals in four partitions, CRC-8 and CRC-16, and a seek point
for every ``SEEK_EVERY`` frames. Decoder: any mono 8-bit stream of the format (every subframe kind, both Rice methods,
escape codes, partition orders, block sizes), verifying both checksums of every frame and the MD5 of the whole.
Frames that start at known offsets (the seek points) are decoded side by side, others after their predecessor.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np

BLOCK = 576
RATE = 8000
SEEK_EVERY = 1
CHUNK = 4096  # frames handled at a time
PARTS = 2  # partition order that the encoder uses
LPC_ORDER, LPC_BITS = 4, 12


class FlacError(ValueError):
    """A stream that isn't valid: bad sync code, reserved code, checksum or length."""


def _crc_table(poly: int, width: int) -> np.ndarray:
    top, mask = 1 << (width - 1), (1 << width) - 1
    table = np.zeros(256, dtype=np.uint32)
    for i in range(256):
        c = i << (width - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly) & mask if c & top else (c << 1) & mask
        table[i] = c
    return table


CRC8 = _crc_table(0x07, 8)
_T16 = _crc_table(0x8005, 16)


def _crc16_words() -> np.ndarray:
    word = np.arange(65536, dtype=np.uint32)
    first = _T16[word >> 8]
    return ((first << 8) & 0xFFFF) ^ _T16[(first >> 8) ^ (word & 0xFF)]


CRC16 = _crc16_words()


def crc16_rows(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-16 of the first lengths[i] bytes of each row. Zeros in front don't change it, so rows are right-aligned."""
    width = int(lengths.max(initial=0))
    width += width & 1
    at = np.arange(width)[None, :] - (width - lengths)[:, None]
    right = np.take_along_axis(rows, np.maximum(at, 0), axis=1)
    right[at < 0] = 0
    words = np.ascontiguousarray(right).view(">u2").astype(np.uint32).T.copy()
    crc = np.zeros(len(rows), dtype=np.uint32)
    for w in words:
        crc = CRC16[crc ^ w]
    return crc


def _number(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The frame numbers in the format's variable-length code: bytes (n x 7) and how many of them count."""
    out = np.zeros((len(i), 7), dtype=np.uint8)
    size = np.ones(len(i), dtype=np.int64)
    for n, limit in ((2, 1 << 7), (3, 1 << 11), (4, 1 << 16), (5, 1 << 21), (6, 1 << 26), (7, 1 << 31)):
        size[i >= limit] = n
    for n in np.unique(size):
        m = size == n
        v = i[m]
        if n == 1:
            out[m, 0] = v
            continue
        lead = (0xFF00 >> n) & 0xFF if n < 7 else 0xFE
        out[m, 0] = lead | (v >> (6 * (n - 1)))
        for j in range(1, n):
            out[m, j] = 0x80 | ((v >> (6 * (n - 1 - j))) & 0x3F)
    return out, size


def _zigzag(r: np.ndarray) -> np.ndarray:
    return ((r << 1) ^ (r >> 31)).astype(np.int32)


def _rice(z: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Rice parameter by frame and partition, and the bits of all residuals of a frame. z: frames x (BLOCK - order)."""
    part = BLOCK >> PARTS
    edges = [0, *[p * part - order for p in range(1, 1 << PARTS)], BLOCK - order]
    k = np.empty((len(z), 1 << PARTS), dtype=np.int64)
    bits = np.zeros(len(z), dtype=np.int64)
    for p in range(1 << PARTS):
        own = z[:, edges[p] : edges[p + 1]]
        n = own.shape[1]
        mean = own.sum(axis=1, dtype=np.int64) / n
        k[:, p] = np.clip(np.floor(np.log2(np.maximum(mean * 0.7, 1.0))), 0, 14)
        bits += 4 + n * (1 + k[:, p]) + (own >> k[:, p, None]).sum(axis=1, dtype=np.int64)
    return k, bits


def _lpc(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised predictor coefficients and shifts by frame (Levinson-Durbin on all frames at once)."""
    f = x.astype(np.float64)
    r = np.stack([np.einsum("ij,ij->i", f[:, : BLOCK - j], f[:, j:]) for j in range(LPC_ORDER + 1)], axis=1)
    r[:, 0] = r[:, 0] * 1.0001 + 1e-3
    a = np.zeros((len(x), LPC_ORDER))
    err = r[:, 0].copy()
    for i in range(LPC_ORDER):
        acc = r[:, i + 1] - np.einsum("ij,ij->i", a[:, :i], r[:, i:0:-1])
        g = acc / err
        a[:, :i] -= g[:, None] * a[:, :i][:, ::-1]
        a[:, i] = g
        err *= np.maximum(1 - g * g, 1e-9)
    most = np.maximum(np.abs(a).max(axis=1), 1e-6)
    shift = np.clip(LPC_BITS - 1 - np.ceil(np.log2(most)) - 1, 0, 15).astype(np.int64)
    top = (1 << (LPC_BITS - 1)) - 1
    return np.clip(np.rint(a * (1 << shift)[:, None]), -top, top).astype(np.int64), shift


def _put(bits: np.ndarray, width: int, row: np.ndarray, pos: np.ndarray, value: np.ndarray, n: int) -> None:
    at = row * width + pos
    for j in range(n):
        bits[at + j] = (value >> (n - 1 - j)) & 1


def encode_frames(x: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Encoded frames of x (frames x 576, int32 samples): rows of bytes, and each row's length."""
    n = len(x)
    order1 = np.diff(x, axis=1)
    order2 = np.diff(order1, axis=1)
    coef, shift = _lpc(x)
    guess = np.zeros((n, BLOCK - LPC_ORDER), dtype=np.int64)
    for j in range(LPC_ORDER):
        guess += coef[:, j, None] * x[:, LPC_ORDER - 1 - j : BLOCK - 1 - j]
    lpc = (x[:, LPC_ORDER:] - (guess >> shift[:, None])).astype(np.int32)
    kinds = []  # order, residual codes, parameters, bits
    for order, r in ((0, x), (1, order1), (2, order2), (LPC_ORDER, lpc)):
        z = _zigzag(r)
        k, bits = _rice(z, order)
        extra = 4 + 5 + LPC_ORDER * LPC_BITS if order == LPC_ORDER else 0
        kinds.append((order, z, k, bits + 8 + 8 * order + 6 + extra))
    cost = np.stack([c[3] for c in kinds], axis=1)
    choice = cost.argmin(axis=1)
    body = cost.min(axis=1)
    choice[body >= 8 + 8 * BLOCK] = 4
    choice[(x == x[:, :1]).all(axis=1)] = 5
    body = np.where(choice == 4, 8 + 8 * BLOCK, np.where(choice == 5, 16, body))
    num, num_size = _number(number)
    head = 4 + num_size + 1
    size = head + (body + 7) // 8 + 2
    width = int(size.max()) * 8
    bits = np.zeros(n * width, dtype=np.uint8)
    for c in range(6):
        row = np.flatnonzero(choice == c)
        if not len(row):
            continue
        pos = head[row] * 8
        if c == 5:
            _put(bits, width, row, pos + 8, x[row, 0] & 255, 8)
            continue
        if c == 4:
            _put(bits, width, row, pos, np.full(len(row), 2), 8)
            for j in range(BLOCK):
                _put(bits, width, row, pos + 8 + 8 * j, x[row, j] & 255, 8)
            continue
        order, z, k, _ = kinds[c]
        z, k = z[row], k[row]
        _put(bits, width, row, pos, np.full(len(row), (32 | (order - 1)) << 1 if order == LPC_ORDER else (8 | order) << 1), 8)
        pos = pos + 8
        for j in range(order):
            _put(bits, width, row, pos, x[row, j] & 255, 8)
            pos = pos + 8
        if order == LPC_ORDER:
            _put(bits, width, row, pos, np.full(len(row), LPC_BITS - 1), 4)
            _put(bits, width, row, pos + 4, shift[row], 5)
            pos = pos + 9
            for j in range(LPC_ORDER):
                _put(bits, width, row, pos, coef[row, j] & ((1 << LPC_BITS) - 1), LPC_BITS)
                pos = pos + LPC_BITS
        _put(bits, width, row, pos, np.full(len(row), PARTS), 6)
        pos = pos + 6
        part = BLOCK >> PARTS
        for p in range(1 << PARTS):
            own = z[:, max(0, p * part - order) : (p + 1) * part - order]
            kp = k[:, p]
            _put(bits, width, row, pos, kp, 4)
            pos = pos + 4
            length = (own >> kp[:, None]) + 1 + kp[:, None]
            ends = np.cumsum(length, axis=1)
            stop = (row * width + pos)[:, None] + ends - kp[:, None] - 1
            pos = pos + ends[:, -1]
            for kk in np.unique(kp):
                m = kp == kk
                at, v = stop[m].ravel(), own[m].ravel()
                bits[at] = 1
                for j in range(int(kk)):
                    bits[at + (j + 1)] = (v >> (int(kk) - 1 - j)) & 1
    rows = np.packbits(bits.reshape(n, width), axis=1)
    rows[:, 0:4] = (0xFF, 0xF8, 0x24, 0x02)
    each = np.arange(n)
    for j in range(int(num_size.max())):
        m = num_size > j
        rows[each[m], 4 + j] = num[m, j]
    rows[each, head - 1] = _crc8_heads(rows, head - 1)
    crc = crc16_rows(rows, size - 2)
    rows[each, size - 2] = crc >> 8
    rows[each, size - 1] = crc & 255
    return rows, size


def _crc8_heads(rows: np.ndarray, length: np.ndarray) -> np.ndarray:
    crc = np.zeros(len(rows), dtype=np.uint32)
    for j in range(int(length.max())):
        crc = np.where(length > j, CRC8[crc ^ rows[:, j]], crc)
    return crc


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload (unsigned bytes, a positive multiple of 576 long)."""
    frames = np.array([len(p) // BLOCK for p in payloads], dtype=np.int64)
    flat = np.frombuffer(b"".join(payloads), dtype=np.uint8)
    x = (flat.astype(np.int32) - 128).reshape(-1, BLOCK)
    number = np.concatenate([np.arange(f) for f in frames]) if len(frames) else np.zeros(0, dtype=np.int64)
    parts, sizes = [], []
    for i in range(0, len(x), CHUNK):
        rows, size = encode_frames(x[i : i + CHUNK], number[i : i + CHUNK])
        parts.append(rows[np.arange(rows.shape[1])[None, :] < size[:, None]].tobytes())
        sizes.append(size)
    data = b"".join(parts)
    size = np.concatenate(sizes) if sizes else np.zeros(0, dtype=np.int64)
    ends = np.concatenate([[0], np.cumsum(size)])
    out, f = [], 0
    for payload, n in zip(payloads, frames):
        n = int(n)
        own = size[f : f + n]
        start = ends[f : f + n] - ends[f]
        signed = (np.frombuffer(payload, dtype=np.uint8) ^ 128).tobytes()
        info = struct.pack(">HH", BLOCK, BLOCK) + int(own.min()).to_bytes(3, "big") + int(own.max()).to_bytes(3, "big")
        info += ((RATE << 44) | (7 << 36) | len(payload)).to_bytes(8, "big") + hashlib.md5(signed).digest()
        points = np.zeros(len(start[::SEEK_EVERY]), dtype=[("sample", ">u8"), ("offset", ">u8"), ("samples", ">u2")])
        points["sample"] = np.arange(0, n, SEEK_EVERY) * BLOCK
        points["offset"] = start[::SEEK_EVERY]
        points["samples"] = BLOCK
        table = points.tobytes()
        out.append(
            b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table
            + data[ends[f] : ends[f + n]]
        )
        f += n
    return out


def parse_head(stream: bytes) -> tuple[int, int, bytes, np.ndarray]:
    """Offset of the first frame, samples, MD5, and seek points (sample, offset) of a stream."""
    if stream[:4] != b"fLaC":
        raise FlacError("no fLaC mark")
    at, last, samples, md5, seek = 4, False, None, b"", np.zeros((0, 2), dtype=np.int64)
    while not last:
        if at + 4 > len(stream):
            raise FlacError("metadata is cut off")
        last, kind, size = stream[at] & 128, stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        block = stream[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(block[10:18], "big")
            if (packed >> 41) & 7 or ((packed >> 36) & 31) != 7:
                raise FlacError("not mono 8-bit audio")
            samples, md5 = packed & ((1 << 36) - 1), block[18:34]
        elif kind == 3:
            p = np.frombuffer(block, dtype=[("sample", ">u8"), ("offset", ">u8"), ("samples", ">u2")])
            p = p[p["sample"] != 0xFFFFFFFFFFFFFFFF]
            seek = np.stack([p["sample"].astype(np.int64), p["offset"].astype(np.int64)], axis=1)
        at += 4 + size
    if samples is None:
        raise FlacError("no STREAMINFO")
    return at, samples, md5, seek


class _Bits:
    """Big-endian bit reads at many positions of one buffer."""

    def __init__(self, buffer: bytes):
        self.raw = buffer + bytes(16)
        self.bytes = np.frombuffer(self.raw, dtype=np.uint8)
        self.words = np.ndarray((len(self.raw) - 7,), dtype=">u8", buffer=self.raw, strides=(1,))
        self.last = len(buffer)

    def window(self, pos: np.ndarray) -> np.ndarray:
        at = pos >> 3
        if len(at) and int(at.max()) > self.last:
            raise FlacError("frame is cut off")
        return self.words[at].astype(np.uint64) << (pos & 7).astype(np.uint64)

    def read(self, pos: np.ndarray, n: int) -> np.ndarray:
        return (self.window(pos) >> np.uint64(64 - n)).astype(np.int64) if n else np.zeros(len(pos), dtype=np.int64)

    def signed(self, pos: np.ndarray, n: int) -> np.ndarray:
        v = self.read(pos, n)
        return v - ((v >> (n - 1)) << n)

    def unary(self, pos: np.ndarray) -> np.ndarray:
        """Zeros before the next one bit."""
        count = np.zeros(len(pos), dtype=np.int64)
        left = np.arange(len(pos))
        while len(left):
            top = (self.window(pos[left] + count[left]) >> np.uint64(32)).astype(np.float64)
            q = np.where(top > 0, 1054 - (top.view(np.int64) >> 52), 32)
            count[left] += q
            left = left[top == 0]
        return count


def _residual(bits: _Bits, pos: np.ndarray, block: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Residuals (samples x frames) and the positions behind them."""
    out = np.zeros((block - order, len(pos)), dtype=np.int64)
    lead = bits.read(pos, 6)
    pos = pos + 6
    end = pos.copy()
    for code in np.unique(lead):
        method, parts = int(code) >> 4, int(code) & 15
        if method > 1 or block % (1 << parts) or (block >> parts) < order:
            raise FlacError("reserved residual coding")
        size, field = block >> parts, 4 + method
        col = np.flatnonzero(lead == code)
        p, i = pos[col], 0
        z = np.empty((block - order, len(col)), dtype=np.int64)
        for part in range(1 << parts):
            count = size - (order if part == 0 else 0)
            k = bits.read(p, field)
            p = p + field
            raw = k == (1 << field) - 1
            if raw.any():
                for one in np.flatnonzero(raw):
                    n = int(bits.read(p[one : one + 1], 5)[0])
                    at = p[one] + 5 + np.arange(count) * n
                    r = bits.signed(at, n) if n else np.zeros(count, dtype=np.int64)
                    z[i : i + count, one] = (r << 1) ^ (r >> 63)
                    p[one] += 5 + n * count
            live = np.flatnonzero(~raw)
            if len(live):
                q, kk = p[live], k[live]
                ku, down = kk.astype(np.uint64), (64 - kk).astype(np.uint64)
                words, shifted = bits.words, np.empty((count, len(live)), dtype=np.int64)
                if int((q >> 3).max()) > bits.last:
                    raise FlacError("frame is cut off")
                for j in range(count):
                    at = np.minimum(q >> 3, bits.last)
                    w = words[at].astype(np.uint64) << (q & 7).astype(np.uint64)
                    top = (w >> np.uint64(32)).astype(np.float64)
                    zeros = 1054 - (top.view(np.int64) >> 52)
                    if (top == 0).any():
                        zeros = bits.unary(q)
                        w = bits.window(q + zeros)
                        value = (w << np.uint64(1)) >> down
                    else:
                        value = (w << (zeros + 1).astype(np.uint64)) >> down
                    shifted[j] = (zeros << kk) | np.where(kk > 0, value, np.uint64(0)).astype(np.int64)
                    q = q + zeros + 1 + kk
                z[i : i + count, live] = shifted
                p[live] = q
            i += count
        out[:, col] = z
        end[col] = p
    return (out >> 1) ^ -(out & 1), end


def _restore_fixed(warm: np.ndarray, r: np.ndarray, order: int) -> np.ndarray:
    for j in range(order - 1, -1, -1):
        last = warm[order - 1 - j : order]
        for _ in range(j):
            last = np.diff(last, axis=0)
        r = np.cumsum(r, axis=0) + last[-1][None, :]
    return np.concatenate([warm, r], axis=0)


def _subframes(bits: _Bits, pos: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Samples (block x frames) of frames whose subframe begins at pos, and the bit positions behind them."""
    x = np.zeros((block, len(pos)), dtype=np.int64)
    head = bits.read(pos, 8)
    if (head >> 7).any():
        raise FlacError("subframe padding isn't zero")
    wasted = np.zeros(len(pos), dtype=np.int64)
    pos = pos + 8
    flag = np.flatnonzero(head & 1)
    if len(flag):
        wasted[flag] = bits.unary(pos[flag]) + 1
        pos[flag] += wasted[flag]
    end = pos.copy()
    kind = (head >> 1) & 63
    for key in np.unique(kind * 16 + wasted):
        code, lost = int(key) >> 4, int(key) & 15
        depth = 8 - lost
        col = np.flatnonzero((kind == code) & (wasted == lost))
        p = pos[col]
        if code == 0:
            got = np.repeat(bits.signed(p, depth)[None, :], block, axis=0)
            p = p + depth
        elif code == 1:
            got = np.stack([bits.signed(p + depth * j, depth) for j in range(block)])
            p = p + depth * block
        elif 8 <= code <= 12 or code >= 32:
            order = code - 8 if code < 32 else code - 31
            warm = np.zeros((order, len(col)), dtype=np.int64)
            for j in range(order):
                warm[j] = bits.signed(p, depth)
                p = p + depth
            if code < 32:
                r, p = _residual(bits, p, block, order)
                got = _restore_fixed(warm, r, order)
            else:
                precision = bits.read(p, 4) + 1
                shift = bits.signed(p + 4, 5)
                p = p + 9
                if (precision > 15).any() or (shift < 0).any():
                    raise FlacError("reserved predictor coding")
                coef = np.zeros((order, len(col)), dtype=np.int64)
                for j in range(order):
                    for n in np.unique(precision):
                        m = precision == n
                        coef[j, m] = bits.signed(p[m], int(n))
                    p = p + precision
                r, p = _residual(bits, p, block, order)
                got = np.concatenate([warm, r], axis=0)
                for i in range(order, block):
                    guess = coef[0] * got[i - 1]
                    for j in range(1, order):
                        guess += coef[j] * got[i - 1 - j]
                    got[i] += guess >> shift
        else:
            raise FlacError("reserved subframe kind")
        x[:, col] = got << lost
        end[col] = p
    return x, end


_SIZES = {1: 192, **{c: 576 << (c - 2) for c in range(2, 6)}, **{c: 256 << (c - 8) for c in range(8, 16)}}


def decode_frames(bits: _Bits, start: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Decode the frames that begin at the byte offsets. Groups of (which, numbers, samples (frames x block), ends)."""
    b = bits.bytes
    if int(start.max(initial=0)) > bits.last:
        raise FlacError("frame is cut off")
    if (b[start] != 0xFF).any() or ((b[start + 1] & 0xFE) != 0xF8).any():
        raise FlacError("no sync code")
    if (b[start + 1] & 1).any() or (b[start + 3] >> 4).any() or (b[start + 3] & 1).any():
        raise FlacError("reserved header bits, more channels or variable block sizes")
    if not np.isin((b[start + 3] >> 1) & 7, (0, 1)).all():
        raise FlacError("not 8-bit samples")
    lead = b[start + 4].astype(np.int64)
    extra = np.zeros(len(start), dtype=np.int64)
    for n, low in ((1, 0xC0), (2, 0xE0), (3, 0xF0), (4, 0xF8), (5, 0xFC), (6, 0xFE)):
        extra[lead >= low] = n
    number = np.where(extra == 0, lead, lead & ((1 << np.maximum(6 - extra, 0)) - 1))
    for j in range(1, int(extra.max(initial=0)) + 1):
        number = np.where(extra >= j, (number << 6) | (b[np.minimum(start + 4 + j, bits.last)] & 63), number)
    code, rate = b[start + 2] >> 4, b[start + 2] & 15
    at = start + 5 + extra
    block = np.zeros(len(start), dtype=np.int64)
    for c in np.unique(code):
        m = code == c
        if c in _SIZES:
            block[m] = _SIZES[int(c)]
        elif c in (6, 7):
            wide = int(c) - 5
            block[m] = bits.read(at[m] * 8, 8 * wide) + 1
            at[m] += wide
        else:
            raise FlacError("reserved block size")
    at = at + np.where(rate == 12, 1, np.where((rate == 13) | (rate == 14), 2, 0))
    span = np.arange(int((at - start).max(initial=0)))
    heads = b[np.minimum(start[:, None] + span[None, :], len(b) - 1)]
    if (_crc8_heads(heads, at - start) != b[at]).any():
        raise FlacError("header checksum differs")
    groups = []
    for n in np.unique(block):
        which = np.flatnonzero(block == n)
        x, end = _subframes(bits, (at[which] + 1) * 8, int(n))
        foot = (end + 7) >> 3
        size = foot - start[which]
        if (foot + 2 > bits.last).any():
            raise FlacError("frame is cut off")
        rows = b[np.minimum(start[which][:, None] + np.arange(int(size.max()))[None, :], len(b) - 1)]
        if (crc16_rows(rows, size) != ((b[foot].astype(np.uint32) << 8) | b[foot + 1])).any():
            raise FlacError("frame checksum differs")
        groups.append((which, number[which], np.ascontiguousarray(x.T).astype(np.int16), foot + 2))
    return groups


def decode(streams: list[bytes]) -> list[list[tuple[int, int, bytes]]]:
    """For each stream its PCM blocks in order: (first sample, byte offset of the frame, unsigned bytes). All checks are made."""
    base, heads, starts = 0, [], []
    for d, s in enumerate(streams):
        first, samples, md5, seek = parse_head(s)
        heads.append((base + first, samples, md5))
        offsets = np.unique(np.concatenate([[0], seek[:, 1]])) if samples else np.zeros(0, dtype=np.int64)
        for o in offsets:
            starts.append((d, base + first + int(o)))
        base += len(s)
    bits = _Bits(b"".join(streams))
    known = {at for _, at in starts}
    found: list[list[tuple[int, int, bytes]]] = [[] for _ in streams]
    limit = np.cumsum([len(s) for s in streams])
    while starts:
        following = []
        for i in range(0, len(starts), CHUNK):
            part = starts[i : i + CHUNK]
            at = np.array([a for _, a in part], dtype=np.int64)
            for which, number, x, end in decode_frames(bits, at):
                raw = (x + 128).astype(np.uint8)
                for w, n, row, e in zip(which.tolist(), number.tolist(), raw, end.tolist()):
                    d, a = part[w]
                    found[d].append((n, a - heads[d][0], row.tobytes()))
                    if e < limit[d] and e not in known:
                        known.add(e)
                        following.append((d, e))
        starts = following
    out = []
    for (_, samples, md5), blocks in zip(heads, found):
        blocks.sort(key=lambda b: b[1])
        if [b[0] for b in blocks] != list(range(len(blocks))):
            raise FlacError("frames are missing")
        first, rows = 0, []
        for _, offset, pcm in blocks:
            rows.append((first, offset, pcm))
            first += len(pcm)
        whole = b"".join(r[2] for r in rows)
        if len(whole) != samples:
            raise FlacError("the number of samples differs")
        if md5 != bytes(16) and hashlib.md5((np.frombuffer(whole, dtype=np.uint8) ^ 128).tobytes()).digest() != md5:
            raise FlacError("the MD5 of the samples differs")
        out.append(rows)
    return out
