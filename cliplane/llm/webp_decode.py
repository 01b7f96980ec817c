"""Lossless WebP, the reading side: prefix codes, back-references, colour cache, and the inverse transforms.

The stream of an image is read in two steps. The first finds where each symbol begins: the size of a whole pixel, or of a
whole back-reference, is computed for every bit position at once (NumPy), for each group of prefix codes; with one group
these are doubled to steps of four symbols, so walking takes one look-up for four. The second fills in the pixels: literals at once; a copied pixel points to the one it repeats, a pixel from the colour cache to
the last one before it with its slot, and the pointers are followed together by doubling.

Of many images the main streams are read side by side instead (`side_by_side`): each step reads one symbol of every image. The
longest ones, which would walk on alone, and any that is damaged take the way for one image.

The transforms of many images are undone together, the predictor along diagonals: a pixel at x + 2 y = t needs only pixels
of smaller t, so each t is one step for all images.
"""

from __future__ import annotations

import struct
from functools import cached_property, lru_cache

import numpy as np

#: Fixed values of the format: the order of code length codes.
ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
#: The 120 near distances: offsets to the left and above, nearest first.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))
PREDICTOR, CROSS, GREEN, PALETTE = range(4)
HASH = 0x1E35A7BD
#: Groups of prefix codes for which tables over all bit positions are built; more are read symbol by symbol.
GROUPS = 8
#: Bytes of the stream that such a table covers.
BLOCK = 1 << 18
#: Images of so few pixels are read symbol by symbol.
TINY = 48
#: So many of the longest images are read by themselves: a step that reads a symbol of fewer images doesn't pay.
LANES = 128
#: Entries of code tables (two bytes each) that are held for images read side by side.
ENTRIES = 1 << 24


# ---------------------------------------------------------------- bits and prefix codes


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def bits(self, n: int) -> int:
        if not n:
            return 0
        at = self.at
        self.at = at + n
        if self.at > self.end:
            raise ValueError("the stream ends early")
        return int.from_bytes(self.data[at >> 3 : (at >> 3) + 8], "little") >> (at & 7) & ((1 << n) - 1)

    def peek(self, at: int, n: int) -> int:
        return int.from_bytes(self.data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7) & ((1 << n) - 1)

    def bits_passed(self, n: int) -> None:
        self.at += n
        if self.at > self.end:
            raise ValueError("the stream ends early")


class Code:
    """Canonical prefix code as a table over the next `width` bits (first bit lowest)."""

    def entries(self) -> list[int]:
        """Symbol and, 5 bits up, size of each place of the table."""
        if self.listed is None:
            self.listed = (self.symbol.astype(np.int64) | self.size.astype(np.int64) << 5).tolist()
        return self.listed

    def __init__(self, lengths: np.ndarray | bytes):
        self.lengths = lengths if isinstance(lengths, bytes) else lengths.astype(np.uint8).tobytes()
        self.listed: list[int] | None = None
        self.runs: dict[int, tuple] = {}
        self.small = 0  # the least alphabet for which the same bits would mean the same code; 0 if they might not

    @cached_property
    def table(self) -> tuple[int, np.ndarray, np.ndarray]:
        """Width, and symbol and size of each place."""
        lengths = np.frombuffer(self.lengths, np.uint8)
        used = np.flatnonzero(lengths)
        if len(used) == 1:
            return 0, used.astype(np.int16), np.zeros(1, np.uint8)
        if not len(used):
            raise ValueError("a prefix code has no symbol")
        size = lengths[used].astype(np.int64)
        order = np.argsort(size, kind="stable")
        used, size = used[order], size[order]
        width = int(size[-1])
        span = 1 << (width - size)
        if span.sum() != 1 << width:
            raise ValueError("a prefix code is incomplete")
        flat = np.repeat(np.arange(len(used)), span)  # by the code read from its highest bit
        pick = flat[reverse(width)]
        return width, used.astype(np.int16)[pick], size.astype(np.uint8)[pick]

    @property
    def width(self) -> int:
        return self.table[0]

    @property
    def symbol(self) -> np.ndarray:
        return self.table[1]

    @property
    def size(self) -> np.ndarray:
        return self.table[2]


def _run(code: Code, bits: int) -> tuple[int, int, int, tuple[list[int], int]]:
    """What the whole symbols of a code for code lengths say that stand in the next 14 bits: how many symbols and lengths, their bits, the
    lengths and the last one that isn't 0. A symbol that repeats the last length ends them. Kept with the code for each pattern of bits."""
    both, mask, n, told, last = code.entries(), (1 << code.width) - 1, 0, 0, 0
    lengths: list[int] = []
    while True:
        s = both[bits >> n & mask]
        size, s = s >> 5, s & 31
        end = n + size + (0 if s < 16 else 3 if s == 17 else 7)
        if s == 16 or end > 14 or not size:
            break
        lengths += [s] if s < 16 else [0] * (3 + (bits >> n + size & 7) if s == 17 else 11 + (bits >> n + size & 127))
        last = s if 0 < s < 16 else last
        n, told = end, told + 1
    code.runs[bits] = found = (told, len(lengths), n, (lengths, last))
    return found


@lru_cache(maxsize=16)
def inner_code(many: int, shown: int) -> Code:
    """A code for code lengths, of which so many are told, three bits each; writers repeat themselves, so the last ones are kept."""
    lengths = bytearray(19)
    for k in range(many):
        lengths[ORDER[k]] = shown >> 3 * k & 7
    return Code(bytes(lengths))


@lru_cache(maxsize=1024)
def simple_code(alphabet: int, first: int, second: int) -> Code:
    """A code of one symbol (told twice) or two."""
    lengths = bytearray(alphabet)
    lengths[first] = lengths[second] = 1
    return Code(bytes(lengths))


_REVERSED: dict[int, np.ndarray] = {}


def reverse(width: int) -> np.ndarray:
    if width not in _REVERSED:
        x, out = np.arange(1 << width), np.zeros(1 << width, np.int64)
        for _ in range(width):
            out = (out << 1) | (x & 1)
            x >>= 1
        _REVERSED[width] = out
    return _REVERSED[width]


def read_symbol(r: Reader, code: Code) -> int:
    if not code.width:
        return int(code.symbol[0])
    at = r.at
    v = int.from_bytes(r.data[at >> 3 : (at >> 3) + 4], "little") >> (at & 7) & ((1 << code.width) - 1)
    r.at = at + int(code.size[v])
    if r.at > r.end:
        raise ValueError("the stream ends early")
    return int(code.symbol[v])


def read_code(r: Reader, alphabet: int) -> Code:
    if r.bits(1):
        two, wide = r.bits(1), r.bits(1)
        symbols = [r.bits(8 if wide else 1)] + ([r.bits(8)] if two else [])
        if max(symbols) >= alphabet:
            raise ValueError("a symbol is outside its alphabet")
        return simple_code(alphabet, symbols[0], symbols[-1])
    many = 4 + r.bits(4)
    code = inner_code(many, r.bits(3 * many))
    counted = r.bits(1)
    most = 2 + r.bits(2 + 2 * r.bits(3)) if counted else alphabet
    both, mask, runs = code.entries(), (1 << code.width) - 1, code.runs
    data, at, i, last = r.data, r.at, 0, 8
    v, left = 0, 0  # bits at hand
    found = [0] * alphabet
    while i < alphabet and most:
        if left < 14:
            v, left = int.from_bytes(data[at >> 3 : (at >> 3) + 8], "little") >> (at & 7), 64 - (at & 7)
        w = v & 0x3FFF
        told, many, n, new = runs[w] if w in runs else _run(code, w)
        if told <= most and many <= alphabet - i and many:
            found[i : i + many] = new[0]
            last = new[1] or last
            i += many
            most -= told
            at += n
            v >>= n
            left -= n
            continue
        most -= 1
        s = both[v & mask]
        n = s >> 5
        s &= 31
        if s < 16:
            found[i] = s
            i += 1
            last = s or last
        else:
            more = v >> n
            if s == 16:
                count, n = 3 + (more & 3), n + 2
                found[i : i + count] = [last] * count
            elif s == 17:
                count, n = 3 + (more & 7), n + 3
            else:
                count, n = 11 + (more & 127), n + 7
            i += count
            if i > alphabet:
                raise ValueError("too many code lengths")
        at += n
        v >>= n
        left -= n
    r.at = at
    if at > r.end:
        raise ValueError("the stream ends early")
    out = Code(bytes(found[:alphabet]))
    out.small = i + 1 if counted and not most else 0
    return out


def _prefix_value(code: int, r: Reader) -> int:
    if code < 4:
        return code + 1
    extra = (code - 2) >> 1
    return ((2 + (code & 1)) << extra) + r.bits(extra) + 1


# ---------------------------------------------------------------- pixels of an image


def _groups(r: Reader, n: int, cache_bits: int) -> list[list[Code]]:
    cache = 1 << cache_bits if cache_bits else 0
    out = []
    for _ in range(n):
        group: list[Code] = []
        begin, bits = 0, 0
        for alphabet in (280 + cache, 256, 256, 256, 40):
            # a description that fits any alphabet is read once, and known again by its bits
            at = r.at
            if bits and group[-1].small <= alphabet and r.peek(at, bits) == r.peek(begin, bits):
                r.bits_passed(bits)
                group.append(group[-1])
            else:
                group.append(read_code(r, alphabet))
                begin, bits = at, (r.at - at) * (group[-1].small > 0)
        out.append(group)
    return out


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def slots(pixels: np.ndarray, cache_bits: int) -> np.ndarray:
    """Slot of the colour cache of each pixel."""
    return (pixels.astype(np.uint32) * np.uint32(HASH)) >> np.uint32(32 - cache_bits)


class Coded:
    """An image whose codes are read and whose pixels are still to be read."""

    def __init__(self, r: Reader, width: int, height: int, main: bool):
        self.r, self.width, self.height = r, width, height
        self.cache_bits = 0
        if r.bits(1):
            self.cache_bits = r.bits(4)
            if not 1 <= self.cache_bits <= 11:
                raise ValueError("the colour cache has a wrong size")
        self.meta, self.tile = None, 0
        if main and r.bits(1):
            self.tile = r.bits(3) + 2
            self.meta = (decode_image(r, (width + (1 << self.tile) - 1) >> self.tile, (height + (1 << self.tile) - 1) >> self.tile, False) >> 8) & 0xFFFF
        self.groups = _groups(r, 1 if self.meta is None else int(self.meta.max()) + 1, self.cache_bits)
        self.begin = r.at

    def which(self) -> np.ndarray:
        """The group of each pixel."""
        return tiled(self.meta, self.tile, self.height, self.width).ravel()

    def pixels(self) -> np.ndarray:
        """The image, read by itself; its reader then stands behind it."""
        r, width, height, groups, out = self.r, self.width, self.height, self.groups, None
        r.at = self.begin
        for code in {id(c): c for g in groups for c in g}.values():
            _ = code.table  # a code that can't be read is told even if no pixel needs it
        if len(groups) <= GROUPS and (width * height > TINY or _constant(groups)):
            which = self.which().astype(np.uint8) if self.meta is not None and len(groups) > 1 else None
            out = _decode_all(r, width, height, groups, which, self.cache_bits)
        if out is None:
            r.at = self.begin
            out = _decode_each(r, width, height, groups, self.meta, self.tile, self.cache_bits)
        return out.reshape(height, width)


def _constant(groups: list[list[Code]]) -> bool:
    return len(groups) == 1 and not any(c.width for c in groups[0][:4]) and groups[0][0].symbol[0] < 256


def decode_image(r: Reader, width: int, height: int, main: bool) -> np.ndarray:
    return Coded(r, width, height, main).pixels()


def _decode_each(r: Reader, width: int, height: int, groups, meta, tile: int, cache_bits: int) -> np.ndarray:
    total = width * height
    out = [0] * total
    cache = [0] * (1 << cache_bits)
    shift = 32 - cache_bits
    i = 0
    while i < total:
        g = groups[0 if meta is None else int(meta[(i // width) >> tile, (i % width) >> tile])]
        s = read_symbol(r, g[0])
        if s < 256:
            red, blue, alpha = read_symbol(r, g[1]), read_symbol(r, g[2]), read_symbol(r, g[3])
            new = [alpha << 24 | red << 16 | s << 8 | blue]
        elif s < 280:
            n = _prefix_value(s - 256, r)
            back = _distance(_prefix_value(read_symbol(r, g[4]), r), width)
            if back > i or i + n > total:
                raise ValueError("a back-reference leaves the image")
            new = [out[i - back + k % back] for k in range(n)]
        else:
            new = [cache[s - 280]]
        for v in new:
            out[i] = v
            i += 1
            if cache_bits:
                cache[(HASH * v & 0xFFFFFFFF) >> shift] = v
    return np.array(out, np.uint32)


_NEAR = np.array([[x, y] for x, y in NEAR])


def _bits(window: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The next n (at most 30) bits at these places."""
    return (window[at] | window[at + 15] << 15) & ((1 << n) - 1)


def _prefix_values(code: np.ndarray, window: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of prefix codes whose extra bits begin at these places, and where those end."""
    code = code.astype(np.int64)
    extra = np.where(code < 4, 0, (code - 2) >> 1)
    base = np.where(code < 4, code + 1, ((2 + (code & 1)) << extra) + 1)
    return base + _bits(window, at, extra), at + extra


class Table:
    """For one group of codes: at each bit of a block, where the next symbol begins and how many pixels this one makes.

    Places are whole words and all of them lie inside their tables, so take() neither converts nor checks them."""

    def __init__(self, g: list[Code], window: np.ndarray, room: int, width: int):
        self.g, self.window = g, window
        sizes: dict[int, np.ndarray] = {}
        ends = np.arange(room)
        green, ahead = g[0], None
        for k, code in enumerate(g[:4]):
            if code.width:
                if id(code) not in sizes:
                    next_bits = window & ((1 << code.width) - 1)
                    sizes[id(code)] = code.size.take(next_bits, mode="clip")
                    ahead = ahead if k else next_bits
                size = sizes[id(code)]
                ends += size.take(ends, mode="clip") if k else size[:room]
        self.plain = bool(green.symbol.max() < 256)
        if not self.plain:
            symbol = np.full(room, green.symbol[0]) if ahead is None else green.symbol.take(ahead[:room], mode="clip")
            other = np.flatnonzero(symbol >= 256)
            alone = other + (sizes[id(green)][other] if green.width else 0)
            ends[other] = alone
            copy = symbol[other] < 280
            self.at, alone = other[copy], alone[copy]  # where a back-reference may begin
            self.count = np.ones(room, np.int32)
            if len(self.at):
                size, end = _prefix_values(symbol[self.at] - 256, window, alone)
                far = g[4]
                if far.width:
                    v = window[end] & ((1 << far.width) - 1)
                    code, end = far.symbol[v], end + far.size[v]
                else:
                    code = np.full(len(end), far.symbol[0])
                code, end = _prefix_values(code, window, end)
                near = _NEAR[np.minimum(code, 120) - 1]
                self.back = np.where(code > 120, code - 120, np.maximum(1, near[:, 0] + near[:, 1] * width))
                self.count[self.at], ends[self.at] = size, end
        np.minimum(ends, room - 1, out=ends)
        self.ends = ends

    def copied(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of these places (in order) begin a back-reference, and the distances of those."""
        if self.plain or not len(self.at):
            return np.zeros(len(at), bool), np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.at, at), len(self.at) - 1)
        is_copy = self.at[k] == at
        return is_copy, self.back[k[is_copy]]

    def symbols(self, at: np.ndarray) -> np.ndarray:
        """Green symbols that begin at these bits."""
        return self.g[0].symbol[self.window[at] & ((1 << self.g[0].width) - 1)]

    def values(self, at: np.ndarray) -> np.ndarray:
        """Literal pixels whose codes begin at these bits."""
        pixels = np.zeros(len(at), np.uint32)
        for code, place in zip(self.g, (8, 16, 0, 24), strict=False):
            if code.width:
                v = self.window[at] & ((1 << code.width) - 1)
                pixels |= code.symbol[v].astype(np.uint32) << np.uint32(place)
                at = at + code.size[v]
            else:
                pixels |= np.uint32(int(code.symbol[0]) << place)
        return pixels

    def walk(self, p: int, limit: int, need: int) -> np.ndarray:
        """Where symbols begin, four at a time, until there are as many as pixels are needed or the limit is passed."""
        two = self.ends.take(self.ends, mode="clip")
        four = two.take(two, mode="clip")
        step, found = memoryview(four), []
        for _ in range(0, need, 4):
            if p >= limit:
                break
            found.append(p)
            p = step[p]
        at = np.array(found, np.int64)
        for jump in (two, self.ends):
            both = np.empty((len(at), 2), np.int64)
            both[:, 0], both[:, 1] = at, jump.take(at, mode="clip")
            at = both.ravel()
        return at


def _decode_all(r: Reader, width: int, height: int, groups: list[list[Code]], which: np.ndarray | None, cache_bits: int) -> np.ndarray | None:
    """All pixels; None if the colour cache is asked for a slot that was never filled."""
    total = width * height
    first = groups[0]
    if _constant(groups):
        value = int(first[3].symbol[0]) << 24 | int(first[1].symbol[0]) << 16 | int(first[0].symbol[0]) << 8 | int(first[2].symbol[0])
        return np.full(total, value, np.uint32)
    out = np.zeros(total, np.uint32)
    hit = np.full(total if cache_bits else 0, -1, np.int32)  # slot of a pixel that comes from the cache
    copies: list[tuple[int, int, int]] = []
    of = None if which is None else memoryview(which)
    i = 0
    while i < total:
        begin = r.at >> 3
        raw = np.frombuffer(r.data, np.uint8, min(BLOCK + 16, len(r.data) - begin), begin)
        if not len(raw):
            raise ValueError("the stream ends early")
        # behind the block's end there are zero bits; positions that would need bits from there go to the next block
        pad = np.zeros(len(raw) + 32, np.int64)
        pad[: len(raw)] = raw
        word = pad[:-2] | pad[1:-1] << 8 | pad[2:] << 16
        window = np.empty((len(word) - 1, 8), np.int64)
        for k in range(8):
            np.right_shift(word[:-1], k, out=window[:, k])
        window &= 0x7FFF
        window = window.ravel()
        room = 8 * (len(raw) + 4)
        tables = [Table(g, window, room, width) for g in groups]
        last = begin + len(raw) >= len(r.data)
        limit = 8 * len(raw) + 1 if last else 8 * (len(raw) - 16)  # the last symbols may take no bits
        p, base = r.at - 8 * begin, 8 * begin
        if of is None:
            at = tables[0].walk(p, limit, total - i)
            at = at[: np.searchsorted(at, limit)]
        else:
            at, reached = [], i
            steps = [(memoryview(t.ends), None if t.plain else memoryview(t.count)) for t in tables]
            while reached < total and p < limit:
                step, count = steps[of[reached]]
                at.append(p)
                reached += 1 if count is None else count[p]
                p = step[p]
            at = np.array(at, np.int64)
        if not len(at):
            raise ValueError("the stream ends early")
        group = np.zeros(len(at), np.int64)
        if all(t.plain for t in tables):
            at = at[: total - i]
            places = i + np.arange(len(at))
            i += len(at)
            group = group[: len(at)] if of is None else which[places]
        else:
            if of is None:
                made = tables[0].count[at].astype(np.int64)
            else:  # the group of a symbol is that of its first pixel
                made, reached = [], i
                for x in at.tolist():
                    count = steps[of[reached]][1]
                    made.append(1 if count is None else count[x])
                    reached += made[-1]
                made = np.array(made, np.int64)
            upto = i + np.cumsum(made)
            many = int(np.searchsorted(upto, total)) + 1
            at, made, upto = at[:many], made[:many], upto[:many]
            places = upto - made
            group = group[: len(at)] if of is None else which[places]
            i = int(upto[-1])
            if i > total:
                raise ValueError("a back-reference leaves the image")
        r.at = base + int(tables[int(group[-1])].ends[at[-1]])
        if r.at > r.end:
            raise ValueError("the stream ends early")
        for k, t in enumerate(tables):
            mine = np.flatnonzero(group == k) if len(tables) > 1 else slice(None)
            own, to = at[mine], places[mine]
            if t.plain:
                out[to] = t.values(own)
                continue
            is_copy, back = t.copied(own)
            if len(back):
                if (back > to[is_copy]).any():
                    raise ValueError("a back-reference leaves the image")
                copies += zip(to[is_copy].tolist(), made[mine][is_copy].tolist(), back.tolist(), strict=True)
                own, to = own[~is_copy], to[~is_copy]
            if cache_bits:
                symbol = t.symbols(own)
                literal = symbol < 256
                hit[to[~literal]] = symbol[~literal] - 280
                own, to = own[literal], to[literal]
            out[to] = t.values(own)
    if len(groups) > 1:
        copies.sort()
    if not cache_bits or not (hit >= 0).any():
        for at_, n, back in copies:
            if back >= n:
                out[at_ : at_ + n] = out[at_ - back : at_ - back + n]
            else:
                out[at_ : at_ + n] = np.resize(out[at_ - back : at_], n)
        return out
    return _followed(out, hit, copies, cache_bits)


def _doubled(points: np.ndarray) -> np.ndarray:
    """Where each chain of pointers to smaller places ends."""
    while True:
        far = points[points]
        if np.array_equal(far, points):
            return points
        points = far


def _followed(out: np.ndarray, hit: np.ndarray, copies: list[tuple[int, int, int]], cache_bits: int) -> np.ndarray | None:
    """Fill in copied and cached pixels; None if a slot is asked for that no pixel before has filled."""
    points = np.arange(len(out))
    for at, n, back in copies:
        points[at : at + n] = at - back + np.arange(n) % back
    root = _doubled(points.copy())
    slot = np.where(hit >= 0, hit, slots(out, cache_bits).astype(np.int32))[root]
    order = np.argsort(slot, kind="stable")
    before = np.full(len(out), -1, np.int64)
    same = slot[order[1:]] == slot[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    asked = np.flatnonzero(hit >= 0)
    if (before[asked] < 0).any():
        return None
    points[asked] = before[asked]
    return out[_doubled(points)]


# ---------------------------------------------------------------- many images


#: Extra bits and least value of lengths and distances by their prefix code.
_EXTRA = np.array([0 if k < 4 else (k - 2) >> 1 for k in range(40)])
_BASE = np.array([k + 1 if k < 4 else ((2 + (k & 1)) << ((k - 2) >> 1)) + 1 for k in range(40)])
SYMBOL = 0xFFF


def code_tables(codes: list[Code]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tables of many codes: entries (symbol and, 12 bits up, size) one table after the other, the first entry and the width of each,
    and whether it is a code at all."""
    length = np.frombuffer(b"".join(c.lengths for c in codes), np.uint8)
    many = np.array([len(c.lengths) for c in codes])
    used = np.flatnonzero(length)
    code = np.repeat(np.arange(len(codes)), many)[used]
    symbol, size = (used - (np.cumsum(many) - many)[code]).astype(np.uint16), length[used].astype(np.int64)
    width = np.zeros(len(codes), np.int64)
    np.maximum.at(width, code, size)
    count = np.bincount(code, minlength=len(codes))
    alone = count == 1
    width[alone] = 0
    span = 1 << np.maximum(width[code] - size, 0)
    good = np.bincount(code, span, len(codes)) == 1 << width
    width[~good] = 0
    # by width, so that codes of one width are rows of one table; within a code by size, then symbol
    order = np.argsort(((width[code] << 40) | (code << 8) | np.where(alone[code], 0, size)), kind="stable")
    order = order[good[code[order]]]
    flat = np.repeat(symbol[order] | np.where(alone[code], 0, size)[order].astype(np.uint16) << np.uint16(12), span[order])
    first, at = np.zeros(len(codes), np.int64), 0
    out = np.zeros(max(1, len(flat)), np.uint16)
    for w in np.unique(width[good]).tolist():
        of = np.flatnonzero(good & (width == w))
        rows = flat[at : at + (len(of) << w)].reshape(len(of), 1 << w)
        out[at : at + rows.size] = rows.take(reverse(w), axis=1).ravel()
        first[of] = at + (np.arange(len(of)) << w)
        at += rows.size
    return out, first, width, good


def side_by_side(coded: list[Coded]) -> list[np.ndarray | None]:
    """The pixels of many images, of which each step reads one symbol; None for one that has to be read by itself."""
    known: dict[int, int] = {}
    codes: list[Code] = []
    for c in coded:
        for g in c.groups:
            for code in g:
                if id(code) not in known:
                    known[id(code)] = len(codes)
                    codes.append(code)
    entries, first, width, good = code_tables(codes)
    of = np.array([[known[id(code)] for code in g] for c in coded for g in c.groups])
    n_groups = np.array([len(c.groups) for c in coded])
    group0 = np.cumsum(n_groups) - n_groups
    base, mask = first[of], (1 << width[of]) - 1  # by group and code
    okay = np.logical_and.reduceat(good[of].all(1), group0)
    data = b"".join(c.r.data for c in coded) + bytes(16)
    byte = np.array([len(c.r.data) for c in coded])
    byte0 = np.cumsum(byte) - byte
    words = np.ndarray(len(data) - 8, "<i8", data, strides=(1,)).copy()  # the 8 bytes from each on
    total = np.array([c.width * c.height for c in coded])
    pixel0 = np.cumsum(total) - total
    start, limit = 8 * byte0 + [c.begin for c in coded], 8 * (byte0 + byte)
    across = np.array([c.width for c in coded])
    which = np.zeros(int(total.sum()), np.int64)
    for k in np.flatnonzero(n_groups > 1).tolist():
        which[pixel0[k] : pixel0[k] + total[k]] = coded[k].which()

    def next_bits(p: np.ndarray) -> np.ndarray:
        return words.take(p >> 3, mode="clip") >> (p & 7)

    singles, copies = [], []
    for lane in (np.flatnonzero(okay & (n_groups == 1)), np.flatnonzero(okay & (n_groups > 1))):
        several = bool(len(lane) and n_groups[lane[0]] > 1)
        p, at, left = start[lane], pixel0[lane], (pixel0 + total)[lane]
        b, m = base.T[:, group0[lane]], mask.T[:, group0[lane]]
        clear = several or m[3].any()
        alpha = entries.take(b[3])
        while len(lane):
            if several:
                g = group0[lane] + which.take(at)
                b, m = base.take(g, axis=0).T, mask.take(g, axis=0).T
            v = next_bits(p)
            green = entries.take(b[0] + (v & m[0]))
            e = green.astype(np.int64)
            size = e >> 12
            v >>= size
            red = entries.take(b[1] + (v & m[1]))
            n = red.astype(np.int64) >> 12
            size += n
            v >>= n
            blue = entries.take(b[2] + (v & m[2]))
            size += blue >> 12
            end = p + size
            if clear:
                alpha = entries.take(b[3] + (next_bits(end) & m[3]))
                end += alpha >> 12
            singles.append((at, green, red, blue, alpha))
            made = at + 1
            e &= SYMBOL
            other = (e >= 256).nonzero()[0]
            if len(other):
                s = e[other]
                q = p[other] + (green[other] >> 12)
                end[other] = q
                copy = s < 280
                if copy.any():
                    c, q, k = other[copy], q[copy], s[copy] - 256
                    v, bits = next_bits(q), _EXTRA[k]
                    length = _BASE[k] + (v & ((1 << bits) - 1))
                    far = entries.take(b[4][c] + (v >> bits & m[4][c])).astype(np.int64)
                    q += bits + (far >> 12)
                    k = far & SYMBOL
                    bits = _EXTRA[k]
                    copies.append((at[c], length, _BASE[k] + (next_bits(q) & ((1 << bits) - 1))))
                    end[c] = q + bits
                    made[c] += length - 1
            p, at = end, made
            on = at < left
            if not on.all():
                off = ~on
                okay[lane[off]] = (p[off] <= limit[lane[off]]) & (at[off] == left[off])
                lane, p, at, left = lane[on], p[on], at[on], left[on]
                if not several:
                    b, m = b[:, on], m[:, on]
                    clear, alpha = m[3].any(), alpha[on]
    joined = lambda parts, n: [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * n
    at, green, red, blue, alpha = joined(singles, 5)
    green &= SYMBOL
    to, length, back = joined(copies, 3)
    lane_of = np.repeat(np.arange(len(coded)), total)
    from_ = lane_of[to]
    near = _NEAR[np.minimum(back, 120) - 1]
    back = np.where(back > 120, back - 120, np.maximum(1, near[:, 0] + near[:, 1] * across[from_]))
    okay[from_[back > to - pixel0[from_]]] = False
    out = np.zeros(int(total.sum()), np.uint32)
    pixel = (alpha & 0xFF).astype(np.uint32) << 24 | (red & 0xFF).astype(np.uint32) << 16 | green.astype(np.uint32) << 8 | (blue & 0xFF)
    out[at] = pixel  # those of other symbols mean nothing and are filled in below
    # a copied pixel points to the one it repeats
    mine = okay[from_]
    to, length, back = to[mine], length[mine], back[mine]
    k = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    copied = np.repeat(to, length) + k
    points = np.arange(len(out))
    points[copied] = np.repeat(to - back, length) + k % np.repeat(back, length)
    _follow(points, copied)
    asked = np.flatnonzero(green >= 280)
    asked = asked[okay[lane_of[at[asked]]]]
    if len(asked):
        slot, asked = green[asked].astype(np.int64) - 280, at[asked]
        okay[_from_cache(out, points, asked, slot, lane_of[asked], pixel0, total, np.array([c.cache_bits for c in coded]))] = False
        copied = np.concatenate([copied, asked])
        _follow(points, copied)
    out[copied] = out[points[copied]]
    return [out[a : a + n].reshape(c.height, c.width) if good_ else None for c, a, n, good_ in zip(coded, pixel0.tolist(), total.tolist(), okay.tolist(), strict=True)]


def _follow(points: np.ndarray, some: np.ndarray) -> None:
    """Let some points go to where their chain ends."""
    while True:
        far = points[points[some]]
        if np.array_equal(far, points[some]):
            return
        points[some] = far


def _from_cache(out, points, asked, slot, lane, pixel0, total, cache_bits) -> np.ndarray:
    """Let pixels from the cache point to the last one before with their slot; gives the lanes that ask for one that was never filled."""
    lanes = np.unique(lane)
    hit = np.full(len(out), -1, np.int64)
    hit[asked] = slot
    k = np.arange(int(total[lanes].sum())) - np.repeat(np.cumsum(total[lanes]) - total[lanes], total[lanes])
    every, of = np.repeat(pixel0[lanes], total[lanes]) + k, np.repeat(lanes, total[lanes])
    root = points[every]
    hashed = (out[root] * np.uint32(HASH) >> (32 - cache_bits[of]).astype(np.uint32)).astype(np.int64)
    key = np.where(hit[root] >= 0, hit[root], hashed) | of << 11
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    before = np.full(len(out), -1, np.int64)
    before[every[order[1:][same]]] = every[order[:-1][same]]
    found = before[asked] >= 0
    points[asked[found]] = before[asked[found]]
    return np.unique(lane[~found])


def read_all(coded: list[Coded]) -> list[np.ndarray]:
    """Pixels of many images: the longest, and those that fail among others, by themselves."""
    out: list[np.ndarray | None] = [None] * len(coded)
    order = sorted(range(len(coded)), key=lambda k: -coded[k].width * coded[k].height)[LANES:]
    lanes: list[int] = []
    held = 0
    for k in order:
        codes = {id(code): code for g in coded[k].groups for code in g}
        room = sum(1 << max(code.lengths) for code in codes.values())
        if lanes and held + room > ENTRIES:
            _fill(coded, lanes, out)
            lanes, held = [], 0
        lanes.append(k)
        held += room
    _fill(coded, lanes, out)
    return [c.pixels() if x is None else x for c, x in zip(coded, out, strict=True)]


def _fill(coded: list[Coded], lanes: list[int], out: list[np.ndarray | None]) -> None:
    if len(lanes) > LANES // 2:
        for k, x in zip(lanes, side_by_side([coded[k] for k in lanes]), strict=True):
            out[k] = x


# ---------------------------------------------------------------- transforms


def _channels(x: np.ndarray) -> np.ndarray:
    """[..., 4] int32 in the order alpha, red, green, blue."""
    return np.stack([x >> 24, x >> 16 & 0xFF, x >> 8 & 0xFF, x & 0xFF], axis=-1).astype(np.int32)


def _packed(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.uint32) & 0xFF
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


BLACK = 0xFF000000
#: The neighbours (left, above, above right, above left, black) whose halved sums of halved sums predict in modes 0 to 10.
MEANS = np.array([[4, 4, 4, 4], [0, 0, 0, 0], [1, 1, 1, 1], [2, 2, 2, 2], [3, 3, 3, 3], [0, 2, 1, 1], [0, 0, 3, 3], [0, 0, 1, 1], [3, 3, 1, 1], [1, 1, 2, 2], [0, 3, 1, 2]])
#: Modes from here on aren't such means, and there are no more than so many.
SELECT, MODES = 11, 14


def half(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Halved sums of packed pixels, byte by byte."""
    return (a & b) + (((a ^ b) & np.uint32(0xFEFEFEFE)) >> np.uint32(1))


def plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.view(np.uint8) + b.view(np.uint8)).view(np.uint32)


def minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.view(np.uint8) - b.view(np.uint8)).view(np.uint32)


def byte_sums(x: np.ndarray) -> np.ndarray:
    """The sum of the four bytes of each packed pixel."""
    x = (x & np.uint32(0xFF00FF)) + (x >> np.uint32(8) & np.uint32(0xFF00FF))
    return (x & np.uint32(0xFFFF)) + (x >> np.uint32(16))


def predict(mode: int, left: np.ndarray, top: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Predictions in modes from SELECT on of packed pixels from their neighbours (corner: above left)."""
    if mode == SELECT:
        far = lambda a: byte_sums((np.maximum(a.view(np.uint8), corner.view(np.uint8)) - np.minimum(a.view(np.uint8), corner.view(np.uint8))).view(np.uint32))
        return np.where(far(top) < far(left), left, top)
    c = corner.view(np.uint8).astype(np.int16)
    if mode == 12:
        a = left.view(np.uint8).astype(np.int16) + top.view(np.uint8) - c
    else:
        a = half(left, top).view(np.uint8).astype(np.int16)
        d = a - c
        a += (d + (d < 0)) >> 1
    return np.clip(a, 0, 255).astype(np.uint8).view(np.uint32)


def tiled(x: np.ndarray, tile: int, h: int, w: int) -> np.ndarray:
    """The value of its tile at each pixel."""
    return np.repeat(np.repeat(x, 1 << tile, axis=0), 1 << tile, axis=1)[:h, :w]


def pixel_modes(modes: np.ndarray, tile: int, h: int, w: int) -> np.ndarray:
    """The predictor mode of each pixel: the first one is predicted from black, the first row from the left, the first column from above."""
    mode = (tiled(modes, tile, h, w) & 15).astype(np.int8)
    mode[mode >= MODES] = 0
    mode[0], mode[1:, 0] = 1, 2
    mode[0, 0] = 0
    return mode


def undo_predictors(images: list[tuple[np.ndarray, np.ndarray, int]]) -> list[np.ndarray]:
    """Undo the predictor of many images (pixels, modes by tile, tile bits) together, diagonal by diagonal."""
    size = np.array([x.size for x, _, _ in images])
    first = np.cumsum(size) - size
    c = np.concatenate([*(x.ravel() for x, _, _ in images), np.array([BLACK], np.uint32)])
    modes, when, above, corner_right = [], [], [], []
    for (x, m, tile), base in zip(images, first.tolist(), strict=True):
        h, w = x.shape
        at = base + np.arange(x.size).reshape(h, w)
        right = at - w + 1
        right[:, -1] = at[:, 0]  # beyond the last column stands the first pixel of the row
        modes.append(pixel_modes(m, tile, h, w).ravel())
        when.append((np.arange(w)[None, :] + 2 * np.arange(h)[:, None]).ravel())
        above.append(np.maximum(at - w, 0).ravel())
        corner_right.append(np.maximum(right, 0).ravel())
    mode, when = np.concatenate(modes), np.concatenate(when)
    kind = np.maximum(mode, SELECT - 1)  # all means are worked out as one
    order = np.lexsort((kind, when))
    mode, kind, when = mode[order], kind[order], when[order]
    top = np.concatenate(above)[order]
    beside = np.stack([np.maximum(order - 1, 0), top, np.concatenate(corner_right)[order], np.maximum(top - 1, 0), np.full(len(order), len(c) - 1)])
    means = [beside[MEANS[:, k][np.minimum(mode, SELECT - 1)], np.arange(len(order))] for k in range(4)]
    cuts = np.flatnonzero((when[1:] != when[:-1]) | (kind[1:] != kind[:-1])) + 1
    cuts = [0, *cuts.tolist(), len(order)]
    kinds = kind[np.array(cuts[:-1])].tolist() if len(order) else []
    for k, m in enumerate(kinds):
        a, b = cuts[k], cuts[k + 1]
        at = order[a:b]
        if m < SELECT:
            c[at] = plus(c[at], half(half(c[means[0][a:b]], c[means[1][a:b]]), half(c[means[2][a:b]], c[means[3][a:b]])))
        else:
            c[at] = plus(c[at], predict(m, c[beside[0, a:b]], c[beside[1, a:b]], c[beside[3, a:b]]))
    return [c[a : a + x.size].reshape(x.shape) for a, (x, _, _) in zip(first.tolist(), images, strict=True)]


def _bytes(x: np.ndarray) -> np.ndarray:
    """Packed pixels as bytes [..., 4] in the order blue, green, red, alpha (lowest first)."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(*x.shape, 4)


def _delta(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((t.view(np.int8).astype(np.int16) * c.view(np.int8)) >> 5).astype(np.uint8)


def cross_colour(x: np.ndarray, elements: np.ndarray, tile: int, undo: bool) -> np.ndarray:
    e, c = _bytes(tiled(elements, tile, *x.shape)), _bytes(x)
    red = c[..., 2] + _delta(e[..., 0], c[..., 1]) if undo else c[..., 2] - _delta(e[..., 0], c[..., 1])
    blue = _delta(e[..., 1], c[..., 1]) + _delta(e[..., 2], red if undo else c[..., 2])
    out = c.copy()
    out[..., 2] = red
    out[..., 0] = c[..., 0] + blue if undo else c[..., 0] - blue
    return out.view(np.uint32)[..., 0]


def subtract_green(x: np.ndarray, undo: bool) -> np.ndarray:
    c = _bytes(x).copy()
    for k in (0, 2):
        c[..., k] = c[..., k] + c[..., 1] if undo else c[..., k] - c[..., 1]
    return c.view(np.uint32)[..., 0]


def _bundle(size: int) -> int:
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


# ---------------------------------------------------------------- files


class Parsed:
    """A file whose pixels are read and whose transforms are still to be undone, the last one first."""

    def __init__(self, data: bytes):
        if len(data) < 25 or data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
            raise ValueError("not a lossless WebP file")
        size = struct.unpack("<I", data[16:20])[0]
        if len(data) < 20 + size or data[20] != 0x2F:
            raise ValueError("the stream ends early")
        r = Reader(data[21 : 20 + size])
        width, height = r.bits(14) + 1, r.bits(14) + 1
        r.bits(1)
        if r.bits(3):
            raise ValueError("unknown version")
        self.todo: list[tuple[int, int, np.ndarray | None, int]] = []
        w = width
        while r.bits(1):
            kind = r.bits(2)
            if kind in {t[0] for t in self.todo}:
                raise ValueError("a transform stands twice")
            if kind in (PREDICTOR, CROSS):
                tile = r.bits(3) + 2
                shape = (w + (1 << tile) - 1) >> tile, (height + (1 << tile) - 1) >> tile
                self.todo.append((kind, tile, decode_image(r, *shape, False), w))
            elif kind == GREEN:
                self.todo.append((kind, 0, None, w))
            else:
                n = r.bits(8) + 1
                table = _packed(np.cumsum(_channels(decode_image(r, n, 1, False)[0]), axis=0))
                self.todo.append((kind, _bundle(n), table, w))
                w = (w + (1 << _bundle(n)) - 1) >> _bundle(n)
        self.coded = Coded(r, w, height, True)
        self.x: np.ndarray | None = None

    def until_predictor(self) -> bool:
        """Undo transforms up to a predictor; whether there is one."""
        while self.todo and self.todo[-1][0] != PREDICTOR:
            kind, tile, extra, full = self.todo.pop()
            if kind == CROSS:
                self.x = cross_colour(self.x, extra, tile, True)
            elif kind == GREEN:
                self.x = subtract_green(self.x, True)
            else:
                index = (self.x >> 8) & 0xFF
                if tile:
                    each = 8 >> tile
                    index = index[:, :, None] >> (np.arange(1 << tile, dtype=np.uint32) * each) & ((1 << each) - 1)
                    index = index.reshape(len(index), -1)[:, :full]
                self.x = np.concatenate([extra, np.zeros(256, np.uint32)])[index]
        return bool(self.todo)


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """ARGB pixels [height, width] of lossless WebP files."""
    every = [Parsed(f) for f in files]
    for p, x in zip(every, read_all([p.coded for p in every]), strict=True):
        p.x = x
    waiting = [p for p in every if p.until_predictor()]
    if waiting:  # a transform stands once in a file, so there is one round
        tops = [p.todo.pop() for p in waiting]
        images = [(p.x, extra >> 8 & 0xFF, tile) for p, (_, tile, extra, _) in zip(waiting, tops, strict=True)]
        for p, x in zip(waiting, undo_predictors(images), strict=True):
            p.x = x
            p.until_predictor()
    return [p.x for p in every]


def decode(data: bytes) -> np.ndarray:
    """ARGB pixels [height, width] of one lossless WebP file."""
    return decode_many([data])[0]


def split(data: bytes) -> list[bytes]:
    """The files of several images that stand one after the other."""
    out, at = [], 0
    while at < len(data):
        n = 8 + struct.unpack("<I", data[at + 4 : at + 8])[0]
        out.append(data[at : at + n])
        at += n
    return out
