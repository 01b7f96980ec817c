"""Lossless WebP, the writing side: transforms, back-references, colour cache, groups of prefix codes.

Transforms are applied image by image; what comes after them is done for many images together (`_fields`): back-references are found
by one sort, codes are made and described side by side, and all fields become bits at once. A file depends on its image alone."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

from cliplane.llm.webp_decode import (
    BLACK, CROSS, GREEN, MEANS, MODES, NEAR, ORDER, PALETTE, PREDICTOR, SELECT, _bundle, _channels, _packed, byte_sums, cross_colour, half, minus, pixel_modes, predict, reverse, slots, subtract_green, tiled,
)

#: Pixels of the shortest and of the longest back-reference.
SHORTEST, LONGEST = 3, 4096
#: Odd numbers that mix three pixels to a key.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


#: Low bits of a key that are its place instead.
_PLACE = 24
#: So many pixels at least are written together.
ROOM = 1 << 17

#: Most bits of a code in the format.
MOST_BITS = 15


def _where(flags: np.ndarray) -> np.ndarray:
    return flags.nonzero()[0]


def _starts(many: np.ndarray) -> np.ndarray:
    """Where each of some stretches that stand one after the other begins, and the end of the last."""
    out = np.zeros(len(many) + 1, np.int64)
    np.cumsum(many, out=out[1:])
    return out


def code_lengths(count: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """Huffman code lengths of at most `most` bits (counts are flattened until they fit)."""
    out = np.zeros(len(count), np.int64)
    used = _where(count)
    out[used] = many_lengths(count[used].astype(np.int64), np.array([len(used)]), most)
    return out


def many_lengths(weight: np.ndarray, many: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """Huffman code lengths of many codes, told by the weights of their symbols, so many each; a symbol alone has length 1."""
    out = np.ones(len(weight), np.int64)
    first = _starts(many)
    left = _where(many > 1)
    while len(left):
        left = left[np.argsort(-many[left], kind="stable")]
        n = many[left]
        at = _starts(n)
        place = np.arange(at[-1]) + np.repeat(first[left] - at[:-1], n)
        w = weight[place]
        place = place[np.argsort(np.repeat(np.arange(len(left)), n) << 40 | w, kind="stable")]
        depth = _depths(weight[place], n)
        out[place] = depth
        over = np.maximum.reduceat(depth, at[:-1]) > most
        if over.any():
            again = place[np.repeat(over, n)]
            weight = weight.copy()
            weight[again] = (weight[again] + 1) >> 1
        left = left[over]
    return out


def _depths(weight: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Depths of the leaves of many Huffman trees, each told by its leaves' weights in order; the largest trees come first.

    Each step joins the two lightest of every tree that isn't ready: of its leaves and of the nodes made, both in order, and both
    with an end that never comes first."""
    at = _starts(n + 1)
    room, at = int(at[-1]), at[:-1]
    endless = np.int64(1) << 60
    queue = np.full(2 * room, endless)  # leaves, then nodes
    leaf = np.arange(len(weight)) + np.repeat(np.arange(len(n)), n)
    queue[leaf] = weight
    parent = np.zeros(2 * room, np.int64)
    i, j, node = at.copy(), at + room, at + room
    active = np.searchsorted(-n, -np.arange(1, int(n[0])) - 1, side="right").tolist()  # trees with more than k + 1 leaves
    for m in active:
        left, made, to = i[:m], j[:m], node[:m]
        total = 0
        for _ in range(2):
            a, b = queue.take(left), queue.take(made)
            is_leaf = a <= b
            parent[np.where(is_leaf, left, made)] = to
            total = total + np.minimum(a, b)
            left += is_leaf
            made += ~is_leaf
        queue[to] = total
        to += 1
    depth = np.zeros(2 * room, np.int64)
    last = at + room + n - 2  # the roots
    for m in active[1:]:
        down = last[:m]
        down -= 1
        depth[down] = depth.take(parent.take(down)) + 1
    return depth.take(parent.take(leaf)) + 1


def many_codes(lengths: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Codes (first bit lowest) and, below them in four bits, their sizes, of many codes told by the lengths of their symbols, so many each;
    a single symbol takes no bits."""
    out = np.zeros(len(lengths), np.int64)
    table = np.repeat(np.arange(len(many)), many)
    order = np.argsort(table << 4 | lengths, kind="stable")
    size = lengths[order]
    span = 1 << (MOST_BITS - size)
    ends = np.cumsum(span)
    first = _starts(many)[:-1]
    begin = ends - span
    begin -= np.repeat(begin[np.minimum(first, max(0, len(begin) - 1))], many) if len(begin) else 0
    out[order] = reverse(MOST_BITS)[begin & ((1 << MOST_BITS) - 1)] << 4 | size
    out[np.repeat(many == 1, many)] = 0
    return out


def codes(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code with its first bit lowest, size) of every symbol; a single symbol takes no bits."""
    used, both = _where(lengths), np.zeros(len(lengths), np.int64)
    both[used] = many_codes(lengths[used], np.array([len(used)]))
    return both >> 4, both & 15


def joined_bits(value: np.ndarray, size: np.ndarray, many: np.ndarray) -> list[bytes]:
    """Fields (at most 64 bits each) of many streams, so many each, as bytes, the lowest bit first."""
    value, ends = value.astype(np.uint64), np.cumsum(size)
    upto = ends[np.cumsum(many) - 1]
    before = np.concatenate([[0], upto[:-1]])
    word0 = _starts(((upto - before) >> 6) + 2)  # every stream begins with a whole word
    begin = ends - size
    begin += np.repeat(64 * word0[:-1] - before, many)
    word, shift = begin >> 6, (begin & 63).astype(np.uint64)
    first = np.concatenate([[0], _where(word[1:] != word[:-1]) + 1])  # fields don't overlap, so sums are unions
    out = np.zeros(int(word0[-1]), np.uint64)
    out[word[first]] = np.add.reduceat(value << shift, first)
    over = _where((begin & 63) + size > 64)  # at most one field of a word goes on in the next one
    out[word[over] + 1] += value[over] >> (np.uint64(64) - shift[over])
    data = out.tobytes()
    return [data[8 * k : 8 * k + n] for k, n in zip(word0.tolist(), ((upto - before + 7) >> 3).tolist(), strict=False)]


class Writer:
    def __init__(self) -> None:
        self.value: list[np.ndarray] = []
        self.size: list[np.ndarray] = []

    def many(self, value: np.ndarray, size: np.ndarray) -> None:
        self.value.append(value)
        self.size.append(size)

    def bytes(self) -> bytes:
        value = np.concatenate(self.value)
        return joined_bits(value, np.concatenate(self.size), np.array([len(value)]))[0]


def _told(gap: int, length: int) -> tuple[int, int, int]:
    """(value, size, tokens) of the zeros before a symbol (whole runs of 138, then a shorter run or one or two single ones) and its length."""
    tokens = [(18, 127)] * (gap // 138)
    gap %= 138
    tokens += [(18, gap - 11)] if gap > 10 else [(17, gap - 3)] if gap >= 3 else [(0, 0)] * gap
    value = n = 0
    for t, extra in [*tokens, (length, 0)]:
        value |= (_INNER_CODE[t] | extra << _INNER_BITS[t]) << n
        n += _INNER_BITS[t] + (3 if t == 17 else 7 if t == 18 else 0)
    return value, n, len(tokens) + 1


@lru_cache(maxsize=1)
def _usual_told() -> np.ndarray:
    """What is told of gaps up to 275 (one field has room for it) and lengths."""
    return np.array([_told(gap, length) for gap in range(276) for length in range(MOST_BITS + 1)], np.int64).T.copy()


def code_header(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and sizes of the fields that describe a prefix code."""
    used = _where(lengths)
    return many_headers(used, lengths[used], np.array([len(used)]), np.array([len(lengths)]))[:2]


def many_headers(symbol: np.ndarray, length: np.ndarray, many: np.ndarray, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values and sizes of the fields that describe many prefix codes, and where those of each begin (and the last end): a code has
    so many symbols, in order, with these lengths, out of its alphabet."""
    first = _starts(many)
    some = many > 0
    last = np.full(len(many), -1)
    last[some] = symbol[first[1:][some] - 1]
    simple = (many <= 2) & (last < 256)
    told = np.repeat(~simple, many)
    gap = symbol.copy()
    gap[1:] -= symbol[:-1] + 1
    gap[first[:-1][some]] = symbol[first[:-1][some]]
    gap, length, of = gap[told], length[told], np.repeat(np.arange(len(many)), many)[told]
    far = np.where(gap < 276, 0, gap // 138)  # whole runs of 138 are fields of their own
    gap -= 138 * far
    fields, bits, tokens = _usual_told().take(gap * (MOST_BITS + 1) + length, axis=1)
    rows = np.bincount(of, far + 1, len(many)).astype(np.int64)
    at = _starts(np.where(simple, 1, 2 + rows))
    value = np.full(at[-1], _INNER_CODE[18] | 127 << _INNER_BITS[18])
    size = np.full(at[-1], _INNER_BITS[18] + 7)
    to = np.cumsum(far + 1) - 1
    to += (at[:-1] + 2 - (np.cumsum(rows) - rows))[of]
    value[to], size[to] = fields, bits
    at0 = at[:-1][simple]
    one = np.where(some, last, 0)[simple]
    zero = np.zeros(len(many), np.int64)
    zero[some] = symbol[first[:-1][some]]
    two = many[simple] == 2
    value[at0] = np.where(two, 7 | zero[simple] << 3 | one << 11, 5 | one << 3)
    size[at0] = np.where(two, 19, 11)
    if not simple.all():
        at0, count = at[:-1][~simple], np.bincount(of, tokens + far, len(many)).astype(np.int64)[~simple]
        if (count < 2).any():
            raise ValueError("too few code lengths")
        value[at0], size[at0] = _INNER_HEAD
        whole, wide = count == alphabet[~simple], count > 1025
        value[at0 + 1] = np.where(whole, 0, 1 | np.where(wide, 6, 4) << 1 | (count - 2) << 4)
        size[at0 + 1] = np.where(whole, 1, np.where(wide, 18, 14))
    return value, size, at


#: Lengths of the code for code lengths (symbols 0 to 18): one for all images, made for how often texts' codes have each length.
INNER = np.array([3, 7, 7, 5, 4, 4, 4, 3, 3, 3, 4, 5, 6, 7, 7, 7, 7, 4, 4])
_INNER_CODE, _INNER_BITS = (x.tolist() for x in codes(INNER))
#: The field with which the description of a prefix code begins: how many lengths of the code for code lengths are told, and these.
_INNER_HEAD = 15 << 1 | sum(n << 5 + 3 * k for k, n in enumerate(INNER[ORDER].tolist())), 62


def _beside(x: np.ndarray) -> list[np.ndarray]:
    """The pixels to the left, above, above right and above left of each pixel (where there is none, a zero or the last ones), and black."""
    w, px = x.shape[1], x.ravel()
    wide = np.concatenate([px[max(0, len(px) - w) :], np.zeros(1, np.uint32), px])
    left, top, right, corner = (wide[w + 1 - back : len(wide) - back] for back in (1, w, w - 1, w + 1))
    return [left, top, right, corner, np.full(x.size, BLACK, np.uint32)]


def _predictions(beside: list[np.ndarray], mode: int) -> np.ndarray:
    if mode >= SELECT:
        return predict(mode, beside[0], beside[1], beside[3])
    a, b, c, d = (beside[k] for k in MEANS[mode])
    return half(half(a, b) if a is not b else a, half(c, d) if c is not d else c) if a is not c or b is not d else a


def do_predictor(x: np.ndarray, modes: np.ndarray, tile: int) -> np.ndarray:
    h, w = x.shape
    mode = pixel_modes(modes, tile, h, w).ravel()
    beside = _beside(x)
    flat = np.concatenate(beside)
    place = MEANS[np.minimum(mode, SELECT - 1)].T * x.size + np.arange(x.size)
    guess = half(half(flat[place[0]], flat[place[1]]), half(flat[place[2]], flat[place[3]]))
    for m in range(SELECT, MODES):
        i = _where(mode == m)
        if len(i):
            guess[i] = predict(m, beside[0][i], beside[1][i], beside[3][i])
    return minus(x.ravel(), guess).reshape(h, w)


def best_modes(x: np.ndarray, tile: int) -> np.ndarray:
    """For each tile the predictor mode with the smallest sum of differences."""
    h, w = x.shape
    beside = _beside(x)
    side = 1 << tile
    guess = np.stack([_predictions(beside, m) for m in range(MODES)])
    d = minus(np.broadcast_to(x.ravel(), guess.shape).copy(), guess).view(np.uint8)
    off = byte_sums(np.minimum(d, -d).view(np.uint32)).reshape(MODES, h, w)
    by_row = np.add.reduceat(off, np.arange(0, h, side), axis=1)
    return np.add.reduceat(by_row, np.arange(0, w, side), axis=2).argmin(0)


def best_elements(x: np.ndarray, tile: int) -> np.ndarray:
    """For each tile the cross-colour multipliers by least squares (green to red, green to blue, red to blue)."""
    signed = ((_channels(x) & 0xFF) ^ 0x80) - 0x80
    h, w, _ = signed.shape
    across = (w + (1 << tile) - 1) >> tile
    of = ((np.arange(h)[:, None] >> tile) * across + (np.arange(w)[None, :] >> tile)).ravel()
    tiles = across * ((h + (1 << tile) - 1) >> tile)
    red, green, blue = (signed[..., k].ravel().astype(np.float64) for k in (1, 2, 3))

    def slope(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        t = 32 * np.bincount(of, a * b, tiles) / np.maximum(np.bincount(of, a * a, tiles), 1)
        return np.clip(np.round(t), -128, 127).astype(np.int64)

    to_red = slope(green, red)
    to_blue = slope(green, blue)
    rest = blue - (to_blue[of] * green.astype(np.int64) >> 5)
    e = np.stack([np.full(tiles, 255), slope(red, rest) & 0xFF, to_blue & 0xFF, to_red & 0xFF], axis=1)
    return _packed(e).reshape(-1, across)


def _prefixed(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, extra value, extra bits) of lengths or distance codes >= 1; the usual ones are looked up."""
    if not len(v):
        return v, v, v
    if v.max() < _USUAL:
        return tuple(t.take(v) for t in _usual())
    return _prefix(v)


#: Lengths and distance codes below this are looked up.
_USUAL = 1 << 13


@lru_cache(maxsize=1)
def _usual() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _prefix(np.arange(_USUAL))


def _prefix(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = v <= 4
    u = np.maximum(v - 1, 2)
    top = np.frexp(u.astype(np.float64))[1] - 1
    second = u >> (top - 1) & 1
    code = np.where(low, v - 1, 2 * top + second)
    return code, np.where(low, 0, u & ((1 << (top - 1)) - 1)), np.where(low, 0, top - 1)


@lru_cache(maxsize=64)
def near_codes(width: int) -> dict[int, int]:
    """Distance code of each distance that has a short one."""
    return {max(1, p + q * width): k + 1 for k, (p, q) in reversed(list(enumerate(NEAR)))}


def copies_of(px: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Back-references (first pixel, length, distance): greedy, to the last place with the same three pixels."""
    return many_copies(px, np.array([len(px)]))


def many_copies(px: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Back-references of many images that stand one after the other, none from one to another."""
    n = len(px)
    none = np.zeros(0, np.int64)
    if n < 2 * SHORTEST:
        return none, none, none
    wide = px.astype(np.uint64)
    three = (wide[:-2] * _MIX[0] + wide[1:-1]) * _MIX[1] + wide[2:] * _MIX[2]
    # equal keys in order of their places; the same order whether or not the places are sorted with the keys
    three &= ~np.uint64((1 << _PLACE) - 1)
    if n < 1 << _PLACE:
        three |= np.arange(n - 2, dtype=np.uint64)
        three.sort()
        order = (three & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
        three >>= np.uint64(_PLACE)
    else:
        order = np.argsort(three, kind="stable")
        three = three[order]
    same = _where(three[1:] == three[:-1])
    a, b = order[same], order[same + 1]
    ends = np.cumsum(size)
    low = np.repeat(ends - size, size)  # no reference goes to before this, and three pixels within an image have to follow
    small = np.repeat(size < 2 * SHORTEST, size)
    for k in (1, 2):
        low[np.maximum(ends - k, 0)] = n
    low[small] = n
    right = (a >= low[b]) & (px[a] == px[b]) & (px[a + 1] == px[b + 1]) & (px[a + 2] == px[b + 2])
    a, b = a[right], b[right]
    if not len(a):
        return none, none, none
    back = np.zeros(n, np.int64)
    back[b] = b - a
    # as long as the distance stays the same the match goes on
    edge = np.append(_where(back[1:] != back[:-1]) + 1, n)
    upto = np.repeat(edge, np.diff(edge, prepend=0))
    is_some = back > 0
    some = _where(is_some)
    length = np.minimum(upto[some] - some + 2, LONGEST)
    before = _starts(is_some)
    then, many = memoryview(before[some + length]), len(some)  # the first match that begins where a match has ended
    taken, k = [], 0
    while k < many:
        taken.append(k)
        k = then[k]
    some, length = some[taken], length[taken]
    return some, length, back[some]


class Plane:
    """An image within a file: the fields before it (packed, with their size), its pixels and how they are written."""

    def __init__(self, before: tuple[int, int], x: np.ndarray, cache_bits: int = 0, lz: bool = False, group: np.ndarray | None = None):
        self.before, self.px, self.width = before, x.ravel(), x.shape[1]
        self.cache_bits, self.lz, self.group = cache_bits, lz, group
        self.groups = 1 if group is None else int(group.max()) + 1


def _hits(px: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Which pixels stand in their slot of the colour cache."""
    order = np.argsort(slot.astype(np.uint16), kind="stable")
    by_slot, by_px = slot[order], px[order]
    out = np.zeros(len(px), bool)
    out[order[1:][(by_slot[1:] == by_slot[:-1]) & (by_px[1:] == by_px[:-1])]] = True
    return out


def _distance_codes(back: np.ndarray, width: np.ndarray) -> np.ndarray:
    out = back + 120
    for w in set(width.tolist()):
        near = near_codes(w)
        table = np.arange(max(near) + 2) + 120
        table[list(near)] = list(near.values())
        i = _where((width == w) & (back < len(table)))
        out[i] = table[back[i]]
    return out


def _fields(planes: list[Plane]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, sizes and number of the fields of many images: what stands before each, its codes, and its pixels with back-references,
    colour cache and groups of codes."""
    size = np.array([len(p.px) for p in planes])
    first = _starts(size)
    px = np.concatenate([p.px for p in planes])
    n, first = len(px), first[:-1]
    lz = np.array([p.lz for p in planes])
    if lz.all():
        begin, length, back = many_copies(px, size)
    else:
        begin, length, back = many_copies(np.concatenate([p.px for p in planes if p.lz] or [px[:0]]), size[lz])
        begin = begin + np.repeat(first[lz] - _starts(size[lz])[:-1], size[lz])[begin]
    # of each pixel: whether it is written by itself; and whether anything is
    edges = np.zeros(2 * len(begin) + 2, np.int64)
    edges[1:-1:2], edges[2:-1:2], edges[-1] = begin, begin + length, n
    single = np.repeat(np.arange(len(edges) - 1) % 2 == 0, np.diff(edges))
    literal, cached = single, begin[:0]
    bits = np.array([p.cache_bits for p in planes])
    if bits.any():
        hit, slot = np.zeros(n, bool), np.zeros(n, np.int64)
        for k in _where(bits).tolist():
            mine = slice(first[k], first[k] + size[k])
            slot[mine] = slots(px[mine], int(bits[k]))
            hit[mine] = _hits(px[mine], slot[mine])
        literal, cached = single & ~hit, _where(single & hit)
        slot = slot[cached]
    literal = _where(literal)
    # units: groups of images
    groups = np.array([p.groups for p in planes])
    unit0 = _starts(groups)
    units, unit = int(unit0[-1]), np.repeat(unit0[:-1], size)
    for k in _where(groups > 1).tolist():
        unit[first[k] : first[k] + size[k]] += planes[k].group
    plane = np.repeat(np.arange(len(planes)), groups)
    of, of_copy = unit[literal], unit[begin]
    # tables: green, red and blue, alpha, distance of each unit; if green has no other symbols than bytes, all three colours share one
    literals = np.bincount(of, minlength=units)
    shared = (np.bincount(of_copy, minlength=units) == 0) & (bits[plane] == 0) & (literals > 0)
    end = np.cumsum(4 - shared)
    table = np.stack([end - 4 + shared, end - 3, end - 2, end - 1], axis=1)
    alphabet = np.zeros(int(end[-1]), np.int64)
    alphabet[table[:, 1]], alphabet[table[:, 2]], alphabet[table[:, 3]] = 256, 256, 40
    alphabet[table[:, 0]] = 280 + np.where(bits[plane] > 0, 1 << bits[plane], 0)  # the shared one is described as one that fits either alphabet
    base = _starts(alphabet)
    room, base = int(base[-1]), base[:-1]
    by_unit = base[table]
    byte = px[literal].view(np.uint8).reshape(-1, 4)
    from_ = by_unit.T[:2].take(of, axis=1)
    keys = [from_[0] + byte[:, 1], from_[1] + byte[:, 2], from_[1] + byte[:, 0]]
    alpha = byte[:, 3]
    one_alpha = len(alpha) > 0 and bool((alpha == alpha[0]).all())
    count = np.zeros(room, np.int64)
    if one_alpha:
        count[by_unit[:, 2] + int(alpha[0])] = literals
    else:
        keys.append(by_unit[:, 2][of] + alpha)
    more = []
    if len(cached):
        more.append(by_unit[:, 0][unit[cached]] + 280 + slot)
    if len(begin):
        length_code, length_extra, length_bits = _prefixed(length)
        width = np.array([p.width for p in planes])[plane[of_copy]]
        dist_code, dist_extra, dist_bits = _prefixed(_distance_codes(back, width))
        more += [by_unit[:, 0][of_copy] + 256 + length_code, by_unit[:, 3][of_copy] + dist_code]
    for k in keys + more:
        count += np.bincount(k, minlength=room)
    used = _where(count)
    of_used = np.repeat(np.arange(len(alphabet)), alphabet)[used]
    many = np.bincount(of_used, minlength=len(alphabet))
    lengths = many_lengths(count[used], many)
    entry = np.zeros(room, np.int64)
    entry[used] = many_codes(lengths, many)
    told, told_size, told_at = many_headers(used - base[of_used], lengths, many, alphabet)
    # descriptions of green, red, blue, alpha and distance
    five = table[:, [0, 1, 1, 2, 3]].ravel()
    rows = np.diff(told_at)[five]
    head = np.arange(int(rows.sum())) + np.repeat(told_at[:-1][five] - (np.cumsum(rows) - rows), rows)
    heads = np.add.reduceat(rows.reshape(-1, 5).sum(1), unit0[:-1])
    # pixels, by the place of the first that each field makes
    value, bits_of, is_field = np.zeros(n, np.int64), np.zeros(n, np.int64), single.copy()
    is_field[begin] = True

    def put(at: np.ndarray, parts: list) -> None:
        """One field for each place: codes (their keys) and extra values (values, sizes) one after the other."""
        v = s = None
        for part in parts:
            if isinstance(part, tuple):
                one, own = part
            else:
                one = entry.take(part)
                own = one & 15
                one >>= 4
            if v is None:
                v, s = one, own
            else:
                one <<= s
                v |= one
                s += own
        value[at], bits_of[at] = v, s

    put(literal, keys)
    if len(cached):
        put(cached, more[:1])
    if len(begin):
        put(begin, [more[-2], (length_extra.copy(), length_bits), more[-1], (dist_extra.copy(), dist_bits)])
    body = np.add.reduceat(is_field, first, dtype=np.int64)
    # before, heads, pixels of each image
    total = 1 + heads + body
    at = _starts(total)[:-1]
    out, out_size = np.empty(int(total.sum()), np.int64), np.empty(int(total.sum()), np.int64)
    out[at], out_size[at] = np.array([p.before for p in planes], np.int64).T
    to = np.arange(len(head)) + np.repeat(at + 1 - (np.cumsum(heads) - heads), heads)
    out[to], out_size[to] = told[head], told_size[head]
    to = np.arange(int(body.sum())) + np.repeat(at + 1 + heads - (np.cumsum(body) - body), body)
    out[to], out_size[to] = value[is_field], bits_of[is_field]
    return out, out_size, total


def planes(
    x: np.ndarray,
    predictor: np.ndarray | None = None,
    cross: np.ndarray | None = None,
    green: bool = False,
    palette: bool = False,
    cache_bits: int = 0,
    lz: bool = False,
    tile: int = 2,
    meta: np.ndarray | None = None,
    meta_tile: int = 4,
) -> list[Plane]:
    """The images within one lossless WebP file of ARGB pixels.

    predictor: modes, cross: elements, both by tile; transforms are applied in the order palette, predictor, cross, green.
    """
    x = np.asarray(x, np.uint32)
    height, width = x.shape
    out: list[Plane] = []
    said = [0, 0]  # fields that wait for the next image, and their size

    def say(*fields: tuple[int, int]) -> tuple[int, int]:
        for value, size in fields:
            said[:] = said[0] | int(value) << said[1], said[1] + size
        return said[0], said[1]

    def small(pixels: np.ndarray, *fields: tuple[int, int]) -> None:
        """An image of its own, without a cache, after some fields."""
        out.append(Plane(say(*fields, (0, 1)), pixels))
        said[:] = 0, 0

    say((width - 1, 14), (height - 1, 14), (not (x >> 24 == 255).all(), 1), (0, 3))
    if palette:
        table, index = np.unique(x, return_inverse=True)
        if len(table) > 256:
            raise ValueError("too many colours for a palette")
        c = _channels(table)
        c[1:] -= _channels(table)[:-1]
        small(_packed(c)[None, :], (1, 1), (PALETTE, 2), (len(table) - 1, 8))
        index, bundle = index.reshape(height, width), _bundle(len(table))
        if bundle:
            each, many = 8 >> bundle, 1 << bundle
            index = np.pad(index, ((0, 0), (0, -width % many))).reshape(height, -1, many)
            index = (index << (np.arange(many) * each)).sum(-1)
        x = (index.astype(np.uint32) << 8) | np.uint32(0xFF000000)
    if predictor is not None:
        small(predictor.astype(np.uint32) << 8 | np.uint32(0xFF000000), (1, 1), (PREDICTOR, 2), (tile - 2, 3))
        x = do_predictor(x, predictor, tile)
    if cross is not None:
        small(cross, (1, 1), (CROSS, 2), (tile - 2, 3))
        x = cross_colour(x, cross, tile, False)
    if green:
        say((1, 1), (GREEN, 2))
        x = subtract_green(x, False)
    say((0, 1), *([(1, 1), (cache_bits, 4)] if cache_bits else [(0, 1)]), (meta is not None, 1))
    group = None
    if meta is not None:
        small(meta.astype(np.uint32) << np.uint32(8) | np.uint32(0xFF000000), (meta_tile - 2, 3))
        group = tiled(meta, meta_tile, *x.shape).ravel()
    out.append(Plane((said[0], said[1]), x, cache_bits, lz, group))
    return out


def _files(lot: list[list[Plane]]) -> list[bytes]:
    value, size, total = _fields([p for f in lot for p in f])
    fields = np.add.reduceat(total, _starts(np.array([len(f) for f in lot]))[:-1])
    out = []
    for data in joined_bits(value, size, fields):
        pad = 1 - len(data) & 1
        out.append(b"RIFF" + struct.pack("<I", 13 + len(data) + pad) + b"WEBPVP8L" + struct.pack("<I", len(data) + 1) + b"\x2f" + data + b"\0" * pad)
    return out


def encode_many(files: Iterable[list[Plane]]) -> Iterator[bytes]:
    """Lossless WebP files, each told by its planes, ROOM pixels together."""
    lot: list[list[Plane]] = []
    room = 0
    for f in files:
        lot.append(f)
        room += sum(len(p.px) for p in f)
        if room >= ROOM:
            yield from _files(lot)
            lot, room = [], 0
    if lot:
        yield from _files(lot)


def encode(x: np.ndarray, **how) -> bytes:
    """One lossless WebP file of ARGB pixels; how: see planes()."""
    return next(encode_many([planes(x, **how)]))
