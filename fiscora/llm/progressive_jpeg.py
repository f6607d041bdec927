"""Progressive JPEG in numpy: many images at once, restart intervals side by side.

decode() reads scans by spectral selection and successive approximation into coefficient arrays.
Within a scan, restart intervals are independent, so those of all images that share the scan's
parameters advance together, one Huffman symbol a step. rgb() dequantises, inverse-transforms in
fixed point (exact in double precision, so that equal images give equal pixels in any batch),
upsamples chroma and returns full-resolution tensors. encode() writes coefficient arrays in the
same form, one restart interval for each block or MCU.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections import defaultdict
from dataclasses import dataclass, field
from functools import cache, lru_cache

import numpy as np


def _zigzag() -> np.ndarray:
    """Natural index of each zigzag place."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()


# Huffman tables ---------------------------------------------------------------------------------


@cache
def lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16-bit window: symbol << 8 | code length; length 0 where no code fits."""
    out = np.zeros(1 << 16, np.int32)
    code, k = 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            out[code << (16 - length) : (code + 1) << (16 - length)] = symbols[k] << 8 | length
            code, k = code + 1, k + 1
        code <<= 1
    return out


@cache
def codes(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code and its length for each symbol."""
    value, bits = np.zeros(256, np.int64), np.zeros(256, np.int64)
    code, k = 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            value[symbols[k]], bits[symbols[k]] = code, length
            code, k = code + 1, k + 1
        code <<= 1
    return value, bits


def _table(by_length: dict[int, list[int]]) -> tuple[bytes, bytes]:
    return bytes(len(by_length.get(n, [])) for n in range(1, 17)), bytes(s for n in sorted(by_length) for s in by_length[n])


DC_TABLE = _table({2: [6, 5, 7], 4: [0, 4, 3], 6: [1, 2, 8], 8: [9, 10, 11]})
_COMMON = [0x06, 0x05, 0x00, 0x03, 0x04, 0x07]
AC_TABLE = _table({1: [0x06], 2: [0x05], 4: [0x00, 0x03], 5: [0x04, 0x07], 12: [x for r in range(16) for x in range(16 * r, 16 * r + 11) if x not in _COMMON and (x % 16 or x == 0xF0)]})
REFINE_TABLE = _table({1: [0x00], 3: [0x01, 0xF0], 8: [16 * r + 1 for r in range(1, 16)]})


# Bits -------------------------------------------------------------------------------------------


def pack(values: np.ndarray, bits: np.ndarray, lane: np.ndarray, n_lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of codes (values of so many bits, at most 31, in lane order), each lane filled up with
    ones to a whole byte, and each lane's number of bytes."""
    used = np.bincount(lane, bits, n_lanes).astype(np.int64)
    sizes = (used + 7) // 8
    ends = np.cumsum(np.bincount(lane, minlength=n_lanes))
    fill = sizes * 8 - used
    values, bits = np.insert(values, ends, (1 << fill) - 1).astype(np.uint64), np.insert(bits, ends, fill)
    kept = bits > 0
    values, bits = values[kept], bits[kept]
    total = int(sizes.sum())
    if not len(bits):
        return np.zeros(0, np.uint8), sizes
    at = np.cumsum(bits) - bits
    word = at >> 5
    shifted = values << (64 - (at & 31) - bits).astype(np.uint64)
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    sums = np.zeros(int(word[-1]) + 2, np.uint64)
    sums[word[first]] = np.add.reduceat(shifted, first)
    out = sums >> np.uint64(32)
    out[1:] |= sums[:-1] & np.uint64(0xFFFFFFFF)
    return out.astype(">u4").view(np.uint8)[:total], sizes


def with_markers(data: np.ndarray, sizes: np.ndarray, order: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """data with a zero after each FF and a restart marker after each lane that is not the last of
    its image; the number of bytes of each lane then."""
    n = len(sizes)
    lane = np.repeat(np.arange(n), sizes)
    full = data == 0xFF
    stuffed = np.bincount(lane[full], minlength=n)
    grown = sizes + stuffed + 2 * ~last
    before = np.cumsum(grown) - grown
    out = np.zeros(int(grown.sum()), np.uint8)
    inner = np.cumsum(full) - full
    first = np.cumsum(sizes) - sizes
    base = np.r_[inner, full.sum()][np.minimum(first, len(data))]
    out[before[lane] + np.arange(len(data)) - first[lane] + inner - base[lane]] = data
    ends = (before + grown)[~last]
    out[ends - 2] = 0xFF
    out[ends - 1] = 0xD0 + order[~last] % 8
    return out, grown


# Encoding ---------------------------------------------------------------------------------------


def magnitude(v: np.ndarray) -> np.ndarray:
    """Bits of |v|."""
    return np.frexp(np.abs(v).astype(np.float32))[1].astype(np.int64)


def first_codes(coefs: np.ndarray, low: int, high: int, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, bits, block) of an AC first scan; each block ends by itself."""
    band = coefs[:, low : high + 1].astype(np.int64)
    band = np.sign(band) * (np.abs(band) >> shift)
    n, width = band.shape
    block, place = np.nonzero(band)
    v = band[block, place]
    new = np.r_[True, block[1:] != block[:-1]] if len(block) else np.zeros(0, bool)
    run = np.where(new, place, place - np.r_[0, place[:-1]] - 1)
    size = magnitude(v)
    code, length = codes(*AC_TABLE)
    symbol = (run % 16) * 16 + size
    extra = np.where(v > 0, v, v + (1 << size) - 1)
    values, bits = code[symbol] << size | extra, length[symbol] + size
    long_runs = run // 16
    if long_runs.any():
        at = np.repeat(np.arange(len(run)), long_runs)
        values, bits = np.insert(values, at, code[0xF0]), np.insert(bits, at, length[0xF0])
        block = np.insert(block, at, block[at])
    ended = np.ones(n, bool)
    ended[np.flatnonzero(band[:, -1])] = False
    at = np.searchsorted(block, np.flatnonzero(ended), "right")
    return np.insert(values, at, code[0]), np.insert(bits, at, length[0]), np.insert(block, at, np.flatnonzero(ended))


def refine_codes(coefs: np.ndarray, low: int, high: int, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, bits, block) of an AC refinement scan that adds bit `shift`."""
    band = np.abs(coefs[:, low : high + 1].astype(np.int64)) >> shift
    sign = coefs[:, low : high + 1] < 0
    n, width = band.shape
    old, new = band > 1, band == 1
    code, length = codes(*REFINE_TABLE)
    out: list[tuple[np.ndarray, ...]] = []  # block, key within block, value, bits

    # Order within a block: a symbol stands before the correction bits of what it passes over.
    block, place = np.nonzero(new)
    zeros = np.cumsum(~old & ~new, 1)
    start = np.zeros(len(block), np.int64)
    same = np.r_[False, block[1:] == block[:-1]] if len(block) else np.zeros(0, bool)
    start[same] = place[:-1][same[1:]] + 1
    upto = zeros[block, place]
    before = np.where(start > 0, zeros[block, np.maximum(start - 1, 0)], 0)
    run = upto - before
    if (run > 15).any():  # a long run: say so after each 16 zeros, with the bits passed so far
        for i in np.flatnonzero(run > 15):
            z = np.flatnonzero(~old[block[i], start[i] : place[i]] & ~new[block[i], start[i] : place[i]]) + start[i]
            while run[i] > 15:
                out.append((np.array([block[i]]), np.array([2 * start[i]]), code[0xF0:0xF1], length[0xF0:0xF1]))
                start[i], z, run[i] = z[15] + 1, z[16:], run[i] - 16
    out.append((block, 2 * start, code[16 * run + 1] << 1 | ~sign[block, place], length[16 * run + 1] + 1))
    tail = np.full(n, 0, np.int64)
    np.maximum.at(tail, block, place + 1)
    rest = np.flatnonzero(tail < width)
    out.append((rest, 2 * tail[rest], np.full(len(rest), code[0]), np.full(len(rest), length[0])))
    block, place = np.nonzero(old)
    out.append((block, 2 * place + 1, band[block, place] & 1, np.ones(len(block), np.int64)))
    block, key, values, bits = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(block * (2 * width + 2) + key, kind="stable")
    return values[order], bits[order], block[order]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@lru_cache(256)
def _mcu_order(mcu_w: int, mcu_h: int) -> np.ndarray:
    """Blocks of a 4:2:0 image (Y, Cb, Cr in raster order each) in the order of interleaved scans."""
    r, c = np.divmod(np.arange(mcu_w * mcu_h), mcu_w)
    y = [(2 * r + dy) * 2 * mcu_w + 2 * c + dx for dy in (0, 1) for dx in (0, 1)]
    k = 4 * mcu_w * mcu_h + np.arange(mcu_w * mcu_h)
    return np.column_stack([*y, k, k + mcu_w * mcu_h]).reshape(-1)


def encode(images: list[tuple[int, int, np.ndarray]], comments: list[bytes]) -> list[bytes]:
    """4:2:0 images (MCUs across, MCUs down, coefficients[blocks, 64] in zigzag order with all
    quantisers 1, blocks of Y, then Cb, then Cr in raster order) as progressive JPEG files."""
    mcus = np.array([w * h for w, h, _ in images])
    coefs = np.concatenate([c for *_, c in images])
    base = np.cumsum(6 * mcus) - 6 * mcus
    interleaved = np.concatenate([_mcu_order(w, h) + b for (w, h, _), b in zip(images, base.tolist(), strict=True)])
    of = [np.concatenate([np.arange(b + lo * m, b + hi * m) for m, b in zip(mcus.tolist(), base.tolist(), strict=True)]) for lo, hi in ((0, 4), (4, 5), (5, 6))]
    files = [[b"\xff\xd8", _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"), _segment(0xFE, note), _segment(0xDB, b"\0" + b"\1" * 64), _segment(0xC2, struct.pack(">BHHB", 8, 16 * h, 16 * w, 3) + b"\1\x22\0\2\x11\0\3\x11\0"), _segment(0xC4, b"\0" + b"".join(DC_TABLE) + b"\x10" + b"".join(AC_TABLE) + b"\x11" + b"".join(REFINE_TABLE)), _segment(0xDD, b"\0\1")] for (w, h, _), note in zip(images, comments, strict=True)]

    def scan(parts: list[int], table: int, low: int, high: int, approx: int, values, bits, lane, lanes: np.ndarray) -> None:
        data, sizes = pack(values, bits, lane, int(lanes.sum()))
        ends = np.cumsum(lanes)
        last = np.zeros(len(sizes), bool)
        last[ends - 1] = True
        out, grown = with_markers(data, sizes, np.arange(len(sizes)) - np.repeat(ends - lanes, lanes), last)
        cuts = np.cumsum(grown)[ends - 1].tolist()
        head, raw, at = _segment(0xDA, bytes([len(parts), *[x for p in parts for x in (p, table)], low, high, approx])), out.tobytes(), 0
        for file, cut in zip(files, cuts, strict=True):
            file += [head, raw[at:cut]]
            at = cut

    dc = coefs[interleaved, 0].astype(np.int64) >> 1
    six = dc.reshape(-1, 6)
    diff = np.column_stack([six[:, :1], np.diff(six[:, :4], axis=1), six[:, 4:]]).reshape(-1)
    size = magnitude(diff)
    code, length = codes(*DC_TABLE)
    mcu = np.arange(len(dc)) // 6
    scan([1, 2, 3], 0x00, 0, 0, 0x01, code[size] << size | np.where(diff > 0, diff, diff + (1 << size) - 1), length[size] + size, mcu, mcus)
    for part, low, high in ((1, 1, 5), (1, 6, 63), (2, 1, 63), (3, 1, 63)):
        scan([part], 0x00, low, high, 0x01, *first_codes(coefs[of[part - 1]], low, high, 1), mcus * (4 if part == 1 else 1))
    scan([1, 2, 3], 0x00, 0, 0, 0x10, coefs[interleaved, 0].astype(np.int64) & 1, np.ones(len(dc), np.int64), mcu, mcus)
    for part in (1, 2, 3):
        scan([part], 0x01, 1, 63, 0x10, *refine_codes(coefs[of[part - 1]], 1, 63, 0), mcus * (4 if part == 1 else 1))
    return [b"".join([*f, b"\xff\xd9"]) for f in files]


# Decoding ---------------------------------------------------------------------------------------


@dataclass
class Component:
    ident: int
    h: int
    v: int
    table: int
    across: int = 0  # blocks that hold samples
    down: int = 0
    stride: int = 0  # blocks across with what fills up the last MCU
    rows: int = 0
    base: int = 0  # first block in the batch's coefficients


@dataclass
class Image:
    width: int = 0
    height: int = 0
    parts: list[Component] = field(default_factory=list)
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    comment: bytes = b""
    coefs: np.ndarray | None = None  # of the whole batch


def _read(data: bytes, image: Image, markers: list[int], start: int, end: int):
    """Yield (parts, dc tables, ac tables, low, high, before, shift, interval, from, to) of each scan."""
    at, tables, interval = start + 2, {}, 0
    if data[start : start + 2] != b"\xff\xd8":
        raise ValueError("no JPEG file")
    while at < end:
        marker = data[at + 1]
        if marker == 0xD9:
            return
        if marker == 0xFF:
            at += 1
            continue
        n = struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                image.quantisers[body[k] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, k + 1).astype(np.float64)
                k += 129 if wide else 65
        elif marker == 0xC2:
            _, image.height, image.width, count = struct.unpack_from(">BHHB", body)
            image.parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(count)]
            most_h, most_v = max(p.h for p in image.parts), max(p.v for p in image.parts)
            for p in image.parts:
                p.across, p.down = -(-(-(-image.width * p.h // most_h)) // 8), -(-(-(-image.height * p.v // most_v)) // 8)
                p.stride, p.rows = -(-image.width // (8 * most_h)) * p.h, -(-image.height // (8 * most_v)) * p.v
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only progressive JPEG files are read here")
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                counts = body[k + 1 : k + 17]
                tables[body[k]] = (counts, body[k + 17 : k + 17 + sum(counts)])
                k += 17 + sum(counts)
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xFE:
            image.comment = body
        elif marker == 0xDA:
            named = {p.ident: i for i, p in enumerate(image.parts)}
            parts = tuple(named[body[1 + 2 * i]] for i in range(body[0]))
            low, high, approx = body[1 + 2 * body[0] : 4 + 2 * body[0]]
            picks = [body[2 + 2 * i] for i in range(body[0])]
            dc, ac = tuple(tables.get(p >> 4) for p in picks), tables.get(0x10 | picks[0] & 15)
            stop = markers[bisect_left(markers, at)]
            yield parts, dc, ac, low, high, approx >> 4, approx & 15, interval, at, stop
            at = stop


def decode(files: list[bytes]) -> list[Image]:
    """Images with their coefficients: image.coefs[part.base + row * part.stride + column, zigzag]."""
    data = b"".join(files)
    raw = np.frombuffer(data + b"\xff\xd9", np.uint8)
    full = np.flatnonzero(raw[:-1] == 0xFF)
    after = raw[full + 1]
    markers = full[(after != 0) & ((after < 0xD0) | (after > 0xD7)) & (after != 0xFF)].tolist()
    images, todo, at, blocks = [], [], 0, 0
    for f in files:
        image, scans = Image(), []
        for x in _read(data, image, markers, at, at + len(f)):
            scans.append(x)
        for p in image.parts:
            p.base, blocks = blocks, blocks + p.stride * p.rows
        for k, x in enumerate(scans):
            todo.append((k, image, x))
        images.append(image)
        at += len(f)
    coefs = np.zeros((blocks, 64), np.int32)
    # A scan needs those before it in its own image; the same step of all images goes together.
    groups = defaultdict(list)
    for k, image, (parts, dc, ac, low, high, before, shift, interval, a, b) in todo:
        shape = tuple((image.parts[p].h, image.parts[p].v) for p in parts)
        groups[k, parts, shape, dc, ac, low, high, before, shift, interval].append((image, a, b))
    for key in sorted(groups, key=lambda g: g[0]):
        _scan(raw, coefs, groups[key], *key[1:])
    for image in images:
        image.coefs = coefs
    return images


@lru_cache(256)
def _block_order(parts: tuple[tuple[int, int, int, int, int], ...]) -> np.ndarray:
    """Blocks of a scan in its order, relative to each part's base: rows (place in MCU, block).
    parts: (h, v, across, down, stride)."""
    if len(parts) == 1:
        _, _, across, down, stride = parts[0]
        r, c = np.divmod(np.arange(across * down), across)
        return np.column_stack([np.zeros(len(r), np.int64), r * stride + c])
    mcu_w, rows = parts[0][4] // parts[0][0], []
    mcu_h = max(-(-down // v) for _, v, _, down, _ in parts)
    r, c = np.divmod(np.arange(mcu_w * mcu_h), mcu_w)
    for k, (h, v, _, _, stride) in enumerate(parts):
        for dy in range(v):
            for dx in range(h):
                rows.append(np.column_stack([np.full(len(r), k), (r * v + dy) * stride + c * h + dx]))
    return np.stack(rows, 1).reshape(-1, 2)


def _scan(raw, coefs, members, parts, shape, dc, ac, low, high, before, shift, interval) -> None:
    per_mcu = sum(h * v for h, v in shape) if len(parts) > 1 else 1
    address, part_of, lane_first, lane_count, pieces = [], [], [], [], []
    n_blocks = 0
    for image, a, b in members:
        own = [image.parts[p] for p in parts]
        order = _block_order(tuple((p.h, p.v, p.across, p.down, p.stride) for p in own))
        address.append(order[:, 1] + np.array([p.base for p in own])[order[:, 0]])
        part_of.append(order[:, 0])
        step = interval * per_mcu or max(len(order), 1)
        starts = np.arange(0, len(order), step)
        lane_first.append(starts + n_blocks)
        lane_count.append(np.minimum(step, len(order) - starts))
        n_blocks += len(order)
        pieces.append(raw[a:b])
    address, part_of = np.concatenate(address), np.concatenate(part_of)
    lane_first, lane_count = np.concatenate(lane_first), np.concatenate(lane_count)
    # Take out stuffing and restart markers; a lane ends where a marker or the piece ends.
    data = np.concatenate([np.r_[p, np.uint8(0xFF), np.uint8(0xD0)] for p in pieces])
    full = data == 0xFF
    nxt = np.r_[data[1:], np.uint8(0)]
    marker = full & (nxt >= 0xD0) & (nxt <= 0xD7)
    gone = marker | np.r_[False, marker[:-1]] | np.r_[False, full[:-1] & (data[1:] == 0)]
    kept = np.cumsum(~gone)
    ends = kept[np.flatnonzero(marker)]
    if len(ends) != len(lane_first):
        raise ValueError("a scan does not have the restart markers that its size asks for")
    bits = 8 * np.r_[0, ends[:-1]]
    clean = np.r_[data[~gone], np.zeros(16, np.uint8)]
    wide = np.zeros(len(clean) - 8, np.uint64)
    for k in range(8):
        wide |= clean[k : k + len(wide)].astype(np.uint64) << np.uint64(56 - 8 * k)
    if low == 0:
        _dc(coefs, wide, bits, address, part_of, lane_first, lane_count, dc, before, shift)
    elif before == 0:
        _ac_first(coefs, wide, bits, address, lane_first, lane_count, lookup(*ac), low, high, shift)
    else:
        _ac_refine(coefs, wide, bits, address, lane_first, lane_count, lookup(*ac), low, high, shift)


def _peek(wide: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The bits from place `at` on, at the top of 64."""
    return wide[at >> 3] << (at & 7).astype(np.uint64)


def _take(window: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The first n bits of each window, n from 0 to 16, as a number."""
    return ((window >> np.uint64(1)) >> (63 - n).astype(np.uint64)).astype(np.int64)


def _symbol(window: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = table[(window >> np.uint64(48)).astype(np.int64)]
    length = (found & 255).astype(np.int64)
    if not length.all():
        raise ValueError("no such Huffman code")
    return (found >> 8).astype(np.int64), length


def _signed(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where((v >> np.maximum(size - 1, 0)) & 1, v, v - (1 << size) + 1) * (size > 0)


def _dc(coefs, wide, bits, address, part_of, first, count, tables, before, shift) -> None:
    if before:
        place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        at = np.repeat(bits, count) + place
        target = address[np.repeat(first, count) + place]
        coefs[target, 0] |= ((_peek(wide, at) >> np.uint64(63)).astype(np.int32)) << shift
        return
    luts = np.stack([lookup(*t) for t in tables])
    bits = bits.copy()
    previous = np.zeros((len(bits), len(tables)), np.int64)
    for t in range(int(count.max(initial=0))):
        on = np.flatnonzero(count > t)
        block = first[on] + t
        part = part_of[block]
        window = _peek(wide, bits[on])
        found = luts[part, (window >> np.uint64(48)).astype(np.int64)].astype(np.int64)
        size, length = found >> 8, found & 255
        diff = _signed(_take(window << length.astype(np.uint64), size), size)
        previous[on, part] += diff
        coefs[address[block], 0] = previous[on, part] << shift
        bits[on] += length + size


def _ac_first(coefs, wide, bits, address, first, count, table, low, high, shift) -> None:
    flat = coefs.reshape(-1)
    at, block, end = bits.copy(), first.copy(), first + count
    k = np.full(len(at), low)
    turn = 0
    while len(at):
        window = _peek(wide, at)
        symbol, length = _symbol(window, table)
        run, size = symbol >> 4, symbol & 15
        rest = window << length.astype(np.uint64)
        value = size > 0
        k = k + run
        some = np.flatnonzero(value)
        extra = _take(rest, size)
        if (k[some] > high).any():
            raise ValueError("a run passes the end of its band")
        flat[address[block[some]] * 64 + k[some]] = _signed(extra[some], size[some]) << shift
        at = at + length + size
        k = k + 1
        if len(some) < len(at):
            none = np.flatnonzero(~value & (run < 15))
            r = run[none]
            block[none] += (1 << r) - 1 + _take(rest[none], r)
            at[none] += r
            k[none] = high + 1
        done = k > high
        block += done
        k[done] = low
        turn += 1
        if turn % 8 == 0 or len(at) < 64:
            on = block < end
            if not on.all():
                at, block, end, k = at[on], block[on], end[on], k[on]
        elif done.any():
            over = block >= end
            if over.any():  # stays, harmlessly, until the next clearing
                on = ~over
                at, block, end, k = at[on], block[on], end[on], k[on]


def _ac_refine(coefs, wide, bits, address, first, count, table, low, high, shift) -> None:
    band = coefs[address, low : high + 1]
    old = band != 0
    width = high - low + 1
    n_old = old.sum(1)
    before = np.zeros((len(address), width + 1), np.int16)  # zeros before each place
    np.cumsum(~old, axis=1, out=before[:, 1:], dtype=np.int16)
    zero_block, zero_place = np.nonzero(~old)
    zero_first = np.searchsorted(zero_block, np.arange(len(address) + 1))
    old_block, old_place = np.nonzero(old)
    old_first = np.searchsorted(old_block, np.arange(len(address) + 1))
    passed: list[tuple[np.ndarray, ...]] = []  # first in old_place, number, place of the first bit
    fresh: list[tuple[np.ndarray, ...]] = []
    at, block, end = bits.copy(), first.copy(), first + count
    k, left = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    while len(at):
        window = _peek(wide, at)
        symbol, length = _symbol(window, table)
        run, size = symbol >> 4, symbol & 15
        idle = left > 0  # inside a run of ended blocks: no symbol
        rest = window << length.astype(np.uint64)
        ending = idle | (size == 0) & (run < 15)
        told = np.where(ending, run, 0)
        extra = _take(rest, np.where(size > 0, 1, told))
        left = np.where(idle, left - 1, np.where(ending, (1 << told) - 1 + extra, 0))
        at = at + np.where(idle, 0, length + np.where(size > 0, 1, told))
        place = zero_first[block] + before[block, k] + run
        inside = ~ending & (place < zero_first[block + 1])
        to = np.full(len(at), width)
        to[inside] = zero_place[place[inside]]
        zeros = before[block, to] - before[block, k]
        n = to - k - zeros
        passed.append((old_first[block] + k - before[block, k], n, at))
        at = at + n
        new = np.flatnonzero(inside & (size > 0))
        fresh.append((block[new], to[new], np.where(extra[new], 1, -1)))
        k = to + 1
        done = k >= width
        k[done] = 0
        block = block + done
        on = block < end
        if not on.all():
            at, block, end, k, left = at[on], block[on], end[on], k[on], left[on]
    start, n, where = (np.concatenate(x) for x in zip(*passed, strict=True)) if passed else (np.zeros(0, np.int64),) * 3
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    index, place = np.repeat(start, n) + step, np.repeat(where, n) + step
    bit = ((wide[place >> 3] >> (63 - (place & 7)).astype(np.uint64)) & np.uint64(1)).astype(np.int32)
    target = address[old_block[index]] * 64 + low + old_place[index]
    flat = coefs.reshape(-1)
    now = flat[target]
    flat[target] = now + np.where(now > 0, bit, -bit) * (1 << shift)
    for b, p, v in fresh:
        flat[address[b] * 64 + low + p] = v << shift


# Pixels -----------------------------------------------------------------------------------------


def _transform() -> np.ndarray:
    """Zigzag coefficients -> pixels, times 2^13, as whole numbers."""
    x, u = np.meshgrid(np.arange(8), np.arange(8))
    c = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(0.125), 0.5)
    both = np.einsum("ur,vc->uvrc", c, c).reshape(64, 64)
    return np.round(both[ZIGZAG] * 8192)


TRANSFORM = _transform()


def pixels(image: Image, part: Component, coefs: np.ndarray) -> np.ndarray:
    """Samples of one part: (rows * 8, stride * 8) bytes."""
    scaled = coefs[part.base : part.base + part.stride * part.rows] * image.quantisers[part.table]
    values = np.floor((scaled @ TRANSFORM + 4096) / 8192) + 128
    cells = np.clip(values, 0, 255).astype(np.uint8).reshape(part.rows, part.stride, 8, 8)
    return cells.transpose(0, 2, 1, 3).reshape(part.rows * 8, part.stride * 8)


def planes(image: Image) -> tuple[bytes, bytes]:
    """What rgb() is made of: factors of the parts (across and down of each), and their samples."""
    return bytes(x for p in image.parts for x in (p.h, p.v)), b"".join(pixels(image, p, image.coefs).tobytes() for p in image.parts)


def rgb(image: Image) -> np.ndarray:
    """The image's full-resolution tensor (height, width, 3), chroma upsampled by repetition."""
    return rgb_of(image.height, image.width, *planes(image))


def rgb_of(height: int, width: int, factors: bytes, samples: bytes) -> np.ndarray:
    """rgb() of an image with these planes()."""
    most_h, most_v = max(factors[::2]), max(factors[1::2])
    data, at, full = np.frombuffer(samples, np.uint8), 0, []
    for h, v in zip(factors[::2], factors[1::2], strict=True):
        down, across = -(-height // (8 * most_v)) * v * 8, -(-width // (8 * most_h)) * h * 8
        part = data[at : at + down * across].reshape(down, across)
        full.append(np.repeat(np.repeat(part, most_v // v, 0), most_h // h, 1)[:height, :width].astype(np.int32))
        at += down * across
    if len(full) == 1:
        return np.repeat(full[0][..., None], 3, 2).astype(np.uint8)
    y, cb, cr = full[0] << 16, full[1] - 128, full[2] - 128
    # The usual factors 1.402, 0.344136, 0.714136, 1.772, times 2^16.
    out = np.stack([y + 91881 * cr, y - 22554 * cb - 46802 * cr, y + 116130 * cb], -1)
    return np.clip((out + 32768) >> 16, 0, 255).astype(np.uint8)
