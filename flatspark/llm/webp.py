"""Lossless WebP (VP8L): a decoder for the whole format and an encoder.

The decoder reads prefix codes and groups of them, literals, back-references and the colour cache, and
inverts the predictor, cross-colour, subtract-green and palette transforms. Pixels are 32-bit ARGB
numbers in a (height, width) array. Prefix codes are read symbol by symbol; where only the green channel
varies, which is so for grey images after the right transforms, a symbol is one step of a short loop.

``decode_all`` reads such images of many files side by side, in lanes of bits that step together.

``encode`` writes any image. ``encode_grey`` writes many byte strings as grey images at once: symbols,
back-references, cache hits and bits of all of them come from array operations; the prefix codes are
those of each image alone.
"""

import functools
import zlib

import numpy as np

ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICTOR, CROSS, GREEN, PALETTE = range(4)
MULTIPLIER = 0x1E35A7BD

def _near() -> list[tuple[int, int]]:
    """The table of the format's specification: by growing distance, ties as listed there."""
    text = (
        "0,1 1,0 1,1 -1,1 0,2 2,0 1,2 -1,2 2,1 -2,1 2,2 -2,2 0,3 3,0 1,3 -1,3 3,1 -3,1 2,3 -2,3 3,2 -3,2 0,4 4,0 1,4 -1,4 4,1 -4,1 3,3 -3,3 "
        "2,4 -2,4 4,2 -4,2 0,5 3,4 -3,4 4,3 -4,3 5,0 1,5 -1,5 5,1 -5,1 2,5 -2,5 5,2 -5,2 4,4 -4,4 3,5 -3,5 5,3 -5,3 0,6 6,0 1,6 -1,6 6,1 -6,1 "
        "2,6 -2,6 6,2 -6,2 4,5 -4,5 5,4 -5,4 3,6 -3,6 6,3 -6,3 0,7 7,0 1,7 -1,7 5,5 -5,5 7,1 -7,1 4,6 -4,6 6,4 -6,4 2,7 -2,7 7,2 -7,2 3,7 -3,7 "
        "7,3 -7,3 5,6 -5,6 6,5 -6,5 8,0 4,7 -4,7 7,4 -7,4 8,1 8,2 6,6 -6,6 8,3 5,7 -5,7 7,5 -7,5 8,4 6,7 -6,7 7,6 -7,6 8,5 7,7 -7,7 8,6 8,7"
    )
    return [tuple(map(int, p.split(","))) for p in text.split()]


NEAR = _near()


class FormatError(ValueError):
    """Bytes that are no valid lossless image."""


#: A walk over symbols takes 2 to this power of them in a step, over so many bytes at a time.
JUMPS = 5
PART = 1 << 14


#: Bits of a lane of images that are read together, how many earlier it starts, and how often lanes are walked.
LANE, LEAD, ROUNDS = 1024, 192, 4
#: Zero bytes behind the images, over which lanes may run; a bit behind all; bytes of an image that is read alone.
SLACK, BEHIND, ALONE = 128, (1 << 31) - 1, 1 << 17
#: Bytes of images that are read together, at most; the places of their bits are 32-bit numbers.
TOGETHER = 1 << 26


class Bits:
    """Reads numbers from the lowest bit on."""

    def __init__(self, data: bytes):
        self.data, self.at, self.n = data, 0, 8 * len(data)

    def read(self, n: int) -> int:
        if self.at + n > self.n:
            raise FormatError("the data end early")
        first = self.at >> 3
        out = int.from_bytes(self.data[first : (self.at + n + 7) >> 3], "little") >> (self.at & 7)
        self.at += n
        return out & ((1 << n) - 1)

    def peek(self, n: int) -> int:
        first = self.at >> 3
        return (int.from_bytes(self.data[first : first + 4], "little") >> (self.at & 7)) & ((1 << n) - 1)


class Code:
    """A prefix code by its lengths. ``array``: by the next ``longest`` bits, symbol * 16 + length."""

    def __init__(self, lengths):
        lengths = np.frombuffer(bytes(lengths), dtype=np.uint8)
        used = np.flatnonzero(lengths)
        self.longest, self._table = 0, None
        if len(used) <= 1:
            self.only = int(used[0]) if len(used) else 0
            self.array = np.array([self.only << 4], dtype=np.int32)
            return
        self.only = None
        size_of = lengths[used].astype(np.int64)
        self.longest = longest = int(size_of.max())
        # Words in order fill the table from its start, if the first bit of a word is the highest.
        order = np.argsort(size_of, kind="stable")
        many = 1 << (longest - size_of[order])
        if many.sum() != 1 << longest:
            raise FormatError("a prefix code is not complete")
        entries = (used << 4 | size_of)[order].astype(np.int32)
        self.array = np.repeat(entries, many)[turned_places(longest)]

    @property
    def table(self) -> list[int]:
        if self._table is None:
            self._table = self.array.tolist()
        return self._table

    def read(self, bits: Bits) -> int:
        e = self.table[bits.peek(self.longest)]
        bits.at += e & 15
        if bits.at > bits.n:
            raise FormatError("the data end early")
        return e >> 4


@functools.lru_cache(maxsize=4096)
def small_code(lengths: tuple[int, ...]) -> Code:
    """The code of the lengths of another code."""
    return Code(lengths)


@functools.lru_cache(maxsize=None)
def single(symbol: int) -> Code:
    """The code of one symbol, which takes no bits."""
    return Code([0] * symbol + [1])


@functools.lru_cache(maxsize=None)
def turned_places(n: int) -> np.ndarray:
    """All numbers of n bits, with their bits in reverse."""
    out = np.zeros(1, dtype=np.int64)
    for k in range(n):
        out = np.concatenate([out, out + (1 << (n - 1 - k))])
    return out


@functools.lru_cache(maxsize=None)
def turned_words(n: int) -> list[int]:
    return turned_places(n).tolist()


#: The bits of a byte in reverse.
TURNED = [int(f"{b:08b}"[::-1], 2) for b in range(256)]


def mirror(word: int, n: int) -> int:
    return (TURNED[word & 255] << 8 | TURNED[word >> 8]) >> (16 - n)


def canonical(lengths) -> dict[int, int]:
    """Code word (first bit lowest) of each used symbol, by length and then symbol."""
    out, code, before = {}, 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - before
        out[s], before = mirror(code, n), n
        code += 1
    return out


def read_code(bits: Bits, size: int) -> Code:
    lengths = bytearray(size)
    simple = bits.peek(11)
    if simple & 7 == 5 and bits.at + 11 <= bits.n and simple >> 3 < size:
        bits.at += 11
        return single(simple >> 3)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        symbols = [bits.read(8 if wide else 1)] + ([bits.read(8)] if two else [])
        if max(symbols) >= size:
            raise FormatError("a symbol is out of range")
        if not two:
            return single(symbols[0])
        for s in symbols:
            lengths[s] = 1
        return Code(lengths)
    own = [0] * 19
    n = 4 + bits.read(4)
    packed_lengths = bits.read(3 * n)
    for i in range(n):
        own[ORDER[i]] = packed_lengths >> 3 * i & 7
    code = small_code(tuple(own))
    left = size
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
    at, before = 0, 8
    place, have, acc = bits.at, 0, 0
    table, mask = code.table, (1 << code.longest) - 1
    while at < size and left:
        left -= 1
        if place + 14 > have:  # a symbol takes at most 14 bits
            acc = int.from_bytes(bits.data[place >> 3 : (place >> 3) + 48], "little") >> (place & 7)
            have = (place & ~7) + 8 * 48
        e = table[acc & mask]
        acc >>= e & 15
        place += e & 15
        s = e >> 4
        if s < 16:
            lengths[at] = s
            before = s or before
            at += 1
            continue
        more = 2 if s == 16 else 3 if s == 17 else 7
        n = (acc & ((1 << more) - 1)) + (11 if s == 18 else 3)
        acc >>= more
        place += more
        if at + n > size:
            raise FormatError("code lengths run over")
        if s == 16:
            lengths[at : at + n] = bytes((before,)) * n
        at += n
    bits.at = place
    if place > bits.n:
        raise FormatError("the data end early")
    return Code(lengths)


def number(bits: Bits, prefix: int) -> int:
    """A length or distance from its prefix symbol."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def image_head(bits: Bits, width: int, height: int, main: bool) -> tuple:
    """Bits of the colour cache, the codes of each group, and the group of each tile with the bits of its size."""
    cache = bits.read(4) if bits.read(1) else 0
    if cache > 11:
        raise FormatError("the colour cache is too large")
    groups, tile, step = 1, None, 0
    if main and bits.read(1):
        step = bits.read(3) + 2
        tile = (read_image(bits, -(-width >> step), -(-height >> step), False) >> 8) & 0xFFFF
        groups = int(tile.max()) + 1
    codes = [[read_code(bits, n) for n in (280 + ((1 << cache) if cache else 0), 256, 256, 256, 40)] for _ in range(groups)]
    return cache, codes, tile, step


def only_green(codes: list[list[Code]], tile) -> bool:
    return tile is None and codes[0][0].only is None and all(c.only is not None for c in codes[0][1:4])


def read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image."""
    cache, codes, tile, step = image_head(bits, width, height, main)
    n, pixels = width * height, None
    if main and only_green(codes, tile):
        pixels = read_green(bits, width, n, codes[0], cache)
    if pixels is None:
        pixels = read_symbols(bits, width, n, codes, cache, tile, step)
    return pixels.reshape(height, width)


def away(far: int, width: int) -> int:
    """A distance in pixels from its code."""
    if far > 120:
        return far - 120
    dx, dy = NEAR[far - 1]
    return max(1, dx + dy * width)


def read_green(bits: Bits, width: int, n: int, codes: list[Code], cache: int) -> np.ndarray | None:
    """The last pixels of a file, where they differ in green only; None (and nothing read) if the cache needs an order.

    What a symbol is and where the next one begins is worked out for every bit at once; a walk from the
    first bit then meets the symbols. A cache place is known without an order if no two of the file's
    colours share one.
    """
    green, distance = codes[0], codes[4]
    place, total = bits.at, 0
    parts: list[tuple] = []
    while total < n:
        found, length, far, steps = green_symbols(bits, place, green, distance)
        many = np.ones(len(found), dtype=np.int64)
        many[(found >= 256) & (found < 280)] = length
        sums = np.cumsum(many) + total
        last = int(np.searchsorted(sums, n))
        if not len(found) or (last < len(sums) and sums[last] != n):
            raise FormatError("the data end early, or a back-reference is out of range")
        if last < len(found):
            found, steps = found[: last + 1], steps[: last + 1]
            kept = np.count_nonzero((found >= 256) & (found < 280))
            length, far = length[:kept], far[:kept]
        total = int(sums[len(found) - 1])
        place += int(steps.sum())
        parts.append((found, length, far))
    if place > bits.n:
        raise FormatError("the data end early")
    pixels = green_pixels(*(np.concatenate(x) for x in zip(*parts)), width, codes, cache)
    if pixels is not None:
        bits.at = place
    return pixels


def green_pixels(found: np.ndarray, length: np.ndarray, far: np.ndarray, width: int, codes: list[Code], cache: int) -> np.ndarray | None:
    """Pixels of symbols, lengths and distances; None if the cache needs an order."""
    _, red, blue, alpha, _ = codes
    base = alpha.only << 24 | red.only << 16 | blue.only
    values = found.astype(np.uint8)
    hits = np.flatnonzero(found >= 280)
    if len(hits):
        seen = np.flatnonzero(np.bincount(found, minlength=256)[:256])
        slots = (MULTIPLIER * (base | seen << 8) & 0xFFFFFFFF) >> (32 - cache)
        holds = np.full(1 << cache, -1)
        holds[slots] = seen
        asked = holds[found[hits] - 280]
        if np.count_nonzero(holds >= 0) < len(slots) or asked.min() < 0:
            return None
        values[hits] = asked
    repeat = np.flatnonzero((found >= 256) & (found < 280))
    if len(repeat):
        literal, out, before = values.tobytes(), bytearray(), 0
        for i, size, back in zip(repeat.tolist(), length.tolist(), far.tolist()):
            out += literal[before:i]
            before, done, back = i + 1, len(out), away(back, width)
            if back > done:
                raise FormatError("a back-reference is out of range")
            out += out[done - back : done - back + size] if back >= size else (out[done - back :] * (size // back + 1))[:size]
        values = np.frombuffer(bytes(out + literal[before:]), dtype=np.uint8)
    return values.astype(np.uint32) << np.uint32(8) | np.uint32(base)


def ahead(words: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """So many bits from a bit on; ``words``: the 64 bits from each byte on."""
    return ((words[at >> 3] >> (at & 7).astype(np.uint64)) & ((np.uint64(1) << count.astype(np.uint64)) - np.uint64(1))).astype(np.int64)


def grown(words: np.ndarray, prefix: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A length or distance, and the bit behind it."""
    count = np.where(prefix < 4, 0, (prefix - 2) >> 1)
    return np.where(prefix < 4, prefix, ((2 + (prefix & 1)) << count) + ahead(words, at, count)) + 1, at + count


def green_symbols(bits: Bits, place: int, green: Code, distance: Code) -> tuple[np.ndarray, ...]:
    """The symbols from a bit on that begin in the next ``PART`` bytes, the lengths and distances of references, and the bits of each."""
    start = place >> 3
    size = max(0, min(PART, len(bits.data) - start))
    raw = np.frombuffer(bits.data[start : start + size + 16] + bytes(16), dtype=np.uint8)
    words = np.ndarray((size + 9,), "<u8", raw, strides=(1,))
    near = np.ndarray((size,), "<u4", raw, strides=(1,))[:, None] >> np.arange(8, dtype=np.uint32)
    index = (near & np.uint32((1 << green.longest) - 1)).astype(np.uint16).ravel()
    step = (green.array & 15).astype(np.uint8)[index].astype(np.int32)

    symbols_of = green.array >> 4
    refers = np.flatnonzero(((symbols_of >= 256) & (symbols_of < 280))[index])
    length, at = grown(words, symbols_of[index[refers]] - 256, refers + step[refers])
    far = distance.array[ahead(words, at, np.full(len(at), distance.longest))]
    far, at = grown(words, far >> 4, at + (far & 15))
    step[refers] = at - refers
    # The walk takes 2 ** JUMPS symbols at a time; those between are looked up together.
    end = min(8 * size, bits.n - 8 * start)
    at, path = place & 7, []
    if at < end:
        leaps = [np.minimum(np.arange(end + 1, dtype=np.int32) + (step[: end + 1] if end < 8 * size else np.append(step, np.int32(0))), np.int32(end))]
        for _ in range(JUMPS):
            leaps.append(leaps[-1][leaps[-1]])
        leap = leaps.pop().item
        while at < end:
            path.append(at)
            at = leap(at)
    path = np.array(path, dtype=np.int32)
    if len(path):
        for leap in reversed(leaps):
            path = np.stack([path, leap[path]], axis=1).ravel()
        path = path[: int(np.searchsorted(path, end))]
    found = symbols_of[index[path]]
    which = np.searchsorted(refers, path[(found >= 256) & (found < 280)])
    return found, length[which], far[which], step[path]


class Joint:
    """The symbols of many green images, read at the same time.

    Their bits are dealt to lanes, which take a step at a time together. A lane starts a little before its
    own bits, anywhere; prefix codes fall into step soon. It is right if its first symbol is where the lane
    before it ends, and walked again from there if not. What is still apart then is left to ``read_green``.
    """

    def __init__(self, images: list[tuple]):
        """``images``: (bits, number of pixels, green code, distance code)."""
        readers, pixels, greens, distances = zip(*images)
        raw = np.frombuffer(b"".join([b.data for b in readers]) + bytes(SLACK), dtype=np.uint8)
        self.words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
        self.near = np.ndarray((len(raw) - 3,), "<u4", raw, strides=(1,)).astype(np.int64)
        self.table, self.base, self.mask = self.tables(greens)
        self.far_table, self.far_base, self.far_mask = self.tables(distances)
        symbol = self.table >> 4
        self.hop = ((self.table & 15) | ((symbol >= 256) & (symbol < 280)) << 4).astype(np.uint8)
        ends = np.cumsum([b.n for b in readers])
        starts = ends - [b.n - b.at for b in readers]
        at, whole = self.starts(starts, ends)
        self.cut(at, starts, ends, np.array(pixels), whole)

    @staticmethod
    def tables(codes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(c.array) for c in codes])
        return np.concatenate([c.array for c in codes]), np.cumsum(sizes) - sizes, sizes - 1

    def references(self, at: np.ndarray, entry: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lengths and distances of references that begin at some bits, and the bits behind them."""
        length, at = grown(self.words, (entry >> 4) - 256, at + (entry & 15))
        far = self.far_table[self.far_base[image] + ((self.words[at >> 3] >> (at & 7).astype(np.uint64)).astype(np.int64) & self.far_mask[image])]
        far, at = grown(self.words, far >> 4, at + (far & 15))
        return length, far, at

    def walk(self, at: np.ndarray, image: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Where symbols begin, a column for each lane, with the first one not before its limit; the rest is far behind."""
        lanes, live, rows = len(at), np.arange(len(at)), []
        base, mask = self.base[image], self.mask[image]
        while True:
            row = np.full(lanes, BEHIND, dtype=np.int32)
            row[live] = at
            rows.append(row)
            if len(rows) % 8 == 1:
                kept = np.flatnonzero(at < limit)
                if not len(kept):
                    return np.array(rows)
                if len(kept) < len(at):
                    at, live, limit, image, base, mask = (x[kept] for x in (at, live, limit, image, base, mask))
            place = ((self.near.take(at >> 3) >> (at & 7)) & mask) + base
            hop = self.hop.take(place)
            after = at + hop
            refers = np.flatnonzero(hop > 15)
            if len(refers):
                after[refers] = self.references(at[refers], self.table[place[refers]], image[refers])[2]
            at = after

    def starts(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bits at which symbols begin, and which images have all of theirs."""
        many = np.maximum(1, -(-(ends - starts) // LANE))
        image = np.repeat(np.arange(len(many)), many)
        nth = np.arange(len(image)) - (np.cumsum(many) - many)[image]
        begin = starts[image] + nth * LANE
        limit = np.minimum(begin + LANE, ends[image])
        entry, leave = np.empty_like(begin), np.empty_like(begin)
        lanes, at, walks = np.arange(len(begin)), begin - np.where(nth > 0, LEAD, 0), []
        low, high = begin.astype(np.int32), limit.astype(np.int32)
        newest = np.zeros(len(begin), dtype=np.int64)
        while True:
            path = self.walk(at, image[lanes], limit[lanes])
            for bound, first in ((low, entry), (high, leave)):
                first[lanes] = path[(path < bound[lanes]).sum(axis=0), np.arange(len(lanes))]
            newest[lanes] = len(walks)
            walks.append((lanes, path))
            lanes = 1 + np.flatnonzero((nth[1:] > 0) & (entry[1:] != leave[:-1]))
            if not len(lanes) or len(walks) == ROUNDS:
                break
            at = leave[lanes - 1]
        whole = np.ones(len(many), dtype=bool)
        whole[image[lanes]] = False
        found = [path[(path >= low[own]) & (path < np.where(newest[own] == k, high[own], 0))] for k, (own, path) in enumerate(walks)]
        return np.sort(np.concatenate(found)).astype(np.int64), whole

    def cut(self, at: np.ndarray, starts: np.ndarray, ends: np.ndarray, pixels: np.ndarray, whole: np.ndarray) -> None:
        """Symbols up to the number of pixels of each image."""
        low, high = np.searchsorted(at, starts), np.searchsorted(at, ends)
        image = np.repeat(np.arange(len(starts)), high - low)
        entry = self.table[((self.near[at >> 3] >> (at & 7)) & self.mask[image]) + self.base[image]]
        found, after, many = entry >> 4, at + (entry & 15), np.ones(len(at) + 1, dtype=np.int64)
        refers = np.flatnonzero((found >= 256) & (found < 280))
        length, far, after[refers] = self.references(at[refers], entry[refers], image[refers])
        many[refers + 1] = length
        many[0] = 0
        sums = np.cumsum(many)
        wanted = sums[low] + pixels
        stop = np.searchsorted(sums, wanted)
        self.parts: list[tuple | None] = [None] * len(starts)
        whole &= (stop > low) & (stop <= high) & (sums[np.minimum(stop, len(at))] == wanted) & (np.append(0, after)[np.minimum(stop, len(at))] <= ends)
        cuts = np.searchsorted(refers, np.stack([low, stop])).tolist()
        for i in np.flatnonzero(whole).tolist():
            own = slice(cuts[0][i], cuts[1][i])
            self.parts[i] = found[low[i] : stop[i]], length[own], far[own]


def read_symbols(bits: Bits, width: int, n: int, codes, cache: int, tile, step: int) -> np.ndarray:
    out = [0] * n
    colours = [0] * ((1 << cache) if cache else 0)
    shift = 32 - cache
    at = kept = 0
    group = codes[0]
    while at < n:
        if tile is not None:
            group = codes[int(tile[(at // width) >> step, (at % width) >> step])]
        s = group[0].read(bits)
        if s < 256:
            red, blue, alpha = group[1].read(bits), group[2].read(bits), group[3].read(bits)
            out[at] = alpha << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < 280:
            length = number(bits, s - 256)
            far = away(number(bits, group[4].read(bits)), width)
            if far > at or at + length > n:
                raise FormatError("a back-reference is out of range")
            for i in range(at, at + length):
                out[i] = out[i - far]
            at += length
        else:
            while kept < at:
                colours[(MULTIPLIER * out[kept] & 0xFFFFFFFF) >> shift] = out[kept]
                kept += 1
            out[at] = colours[s - 280]
            at += 1
    return np.array(out, dtype=np.uint32)


def channels(pixels: np.ndarray) -> np.ndarray:
    """(..., 4) of blue, green, red, alpha."""
    return np.ascontiguousarray(pixels, dtype="<u4").view(np.uint8).reshape(*pixels.shape, 4)


def packed(c: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(c.astype(np.uint8)).view("<u4").reshape(c.shape[:-1])


def predicted(mode: int, left, top, top_left, top_right):
    """A pixel from its neighbours (lists or arrays of four ints)."""
    mean = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b)]
    clamp = lambda x: 0 if x < 0 else 255 if x > 255 else x
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return mean(mean(left, top_right), top)
    if mode == 6:
        return mean(left, top_left)
    if mode == 7:
        return mean(left, top)
    if mode == 8:
        return mean(top_left, top)
    if mode == 9:
        return mean(top, top_right)
    if mode == 10:
        return mean(mean(left, top_left), mean(top, top_right))
    if mode == 11:
        by_left = sum(abs(t - c) for t, c in zip(top, top_left))
        by_top = sum(abs(a - c) for a, c in zip(left, top_left))
        return left if by_left < by_top else top
    if mode == 12:
        return [clamp(a + b - c) for a, b, c in zip(left, top, top_left)]
    if mode == 13:
        return [clamp(m + int((m - c) / 2)) for m, c in zip(mean(left, top), top_left)]
    return [0, 0, 0, 255]


def predict(pixels: np.ndarray, modes: np.ndarray, size: int, invert: bool) -> np.ndarray:
    """Adds the predictions to the residuals, or takes them off the pixels."""
    height, width = pixels.shape
    kinds = np.unique(np.asarray(modes) & 15)
    if len(kinds) == 1 and kinds[0] in (0, 1, 2):
        return summed(pixels, int(kinds[0])) if invert else differences(pixels, int(kinds[0]))
    source = channels(pixels).tolist()
    out = source if invert else channels(pixels).tolist()
    full = out if invert else source
    for y in range(height):
        for x in range(width):
            if not y:
                guess = full[0][x - 1] if x else [0, 0, 0, 255]
            elif not x:
                guess = full[y - 1][0]
            else:
                # Right of the last column stands the first pixel of the same row.
                right = full[y - 1][x + 1] if x + 1 < width else full[y][0]
                guess = predicted(int(modes[y >> size][x >> size]) & 15, full[y][x - 1], full[y - 1][x], full[y - 1][x - 1], right)
            if invert:
                out[y][x] = [(a + b) & 255 for a, b in zip(source[y][x], guess)]
            else:
                out[y][x] = [(a - b) & 255 for a, b in zip(source[y][x], guess)]
    return packed(np.array(out, dtype=np.uint8).reshape(height, width, 4))


BLACK = np.array([0, 0, 0, 255], dtype=np.uint8)


def edged(c: np.ndarray, mode: int, black=np.uint8(0)) -> np.ndarray:
    """Residuals of one mode for all places: 0 (black), 1 (left) or 2 (top); the edges have modes of their own."""
    out = c - black
    if mode == 1:
        out[1:, 1:] = c[1:, 1:] - c[1:, :-1]
    elif mode == 2:
        out[1:, 1:] = c[1:, 1:] - c[:-1, 1:]
    out[0, 1:] = c[0, 1:] - c[0, :-1]
    out[1:, 0] = c[1:, 0] - c[:-1, 0]
    return out


def differences(pixels: np.ndarray, mode: int) -> np.ndarray:
    return packed(edged(channels(pixels), mode, BLACK))


def summed(residuals: np.ndarray, mode: int) -> np.ndarray:
    """The pixels of :func:`differences`."""
    c = channels(residuals).copy()
    c[0, 0] += BLACK
    np.cumsum(c[0], axis=0, dtype=np.uint8, out=c[0])
    np.cumsum(c[:, 0], axis=0, dtype=np.uint8, out=c[:, 0])
    if mode == 1:
        c[1:] = np.cumsum(c[1:], axis=1, dtype=np.uint8)
        return packed(c)
    if mode == 2:
        c[1:, 1:] = np.cumsum(c[:, 1:], axis=0, dtype=np.uint8)[1:]
        return packed(c)
    c[1:, 1:] += BLACK
    return packed(c)


def cross(pixels: np.ndarray, elements: np.ndarray, size: int, invert: bool) -> np.ndarray:
    height, width = pixels.shape
    signed = lambda a: np.ascontiguousarray(a).view(np.int8).astype(np.int32)
    c = channels(pixels).copy()
    e = channels(elements)
    if elements.size > 1:
        e = e[np.arange(height)[:, None] >> size, np.arange(width)[None, :] >> size]
    delta = lambda t, v: ((signed(t) * signed(v)) >> 5).astype(np.uint8)
    red = c[..., 2].copy()
    by_green, by_red = delta(e[..., 0], c[..., 1]), delta(e[..., 1], c[..., 1])
    c[..., 2] = red + by_green if invert else red - by_green
    by_red += delta(e[..., 2], c[..., 2] if invert else red)
    c[..., 0] = c[..., 0] + by_red if invert else c[..., 0] - by_red
    return packed(c)


def green(pixels: np.ndarray, invert: bool) -> np.ndarray:
    c = channels(pixels).copy()
    for i in (0, 2):
        c[..., i] = c[..., i] + c[..., 1] if invert else c[..., i] - c[..., 1]
    return packed(c)


def palette_bits(size: int) -> int:
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


def opened(data: bytes) -> tuple[Bits, list[tuple], int, int]:
    """What follows the transforms of a RIFF file with one VP8L chunk, the transforms, and the stored image's width and height."""
    if len(data) < 25 or data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise FormatError("not a lossless WebP file")
    bits = Bits(data[21 : 20 + int.from_bytes(data[16:20], "little")])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise FormatError("unknown version")
    undo = []
    inner = width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (u[0] for u in undo):
            raise FormatError("a transform comes twice")
        if kind in (PREDICTOR, CROSS):
            size = bits.read(3) + 2
            undo.append((kind, size, read_image(bits, -(-inner >> size), -(-height >> size), False), inner))
        elif kind == GREEN:
            undo.append((kind, 0, None, inner))
        else:
            n = bits.read(8) + 1
            colours = channels(read_image(bits, n, 1, False)[0]).cumsum(axis=0, dtype=np.uint8)
            undo.append((kind, palette_bits(n), packed(colours), inner))
            inner = -(-inner >> palette_bits(n))
    return bits, undo, inner, height


def undone(pixels: np.ndarray, undo: list[tuple]) -> np.ndarray:
    for kind, size, extra, wide in reversed(undo):
        if kind == PREDICTOR:
            pixels = predict(pixels, (extra >> 8) & 255, size, True)
        elif kind == CROSS:
            pixels = cross(pixels, extra, size, True)
        elif kind == GREEN:
            pixels = green(pixels, True)
        else:
            each = 8 >> size
            x = np.arange(wide)
            index = ((pixels[:, x >> size] >> 8) & 255) >> (each * (x & ((1 << size) - 1))).astype(np.uint32) & ((1 << each) - 1)
            pixels = np.append(extra, np.zeros(256, np.uint32))[index].astype(np.uint32)
    return pixels


def decode(data: bytes) -> np.ndarray:
    """The (height, width) pixels of a RIFF file with one VP8L chunk."""
    bits, undo, inner, height = opened(data)
    return undone(read_image(bits, inner, height, True), undo)


def decode_all(files: list[bytes]) -> list[np.ndarray]:
    """:func:`decode` of each file; images whose green channel alone varies are read together."""
    heads, images, total = {}, [], 0
    for i, data in enumerate(files):
        if len(data) <= min(ALONE, TOGETHER - total):
            bits, undo, width, height = opened(data)
            cache, codes, tile, _ = image_head(bits, width, height, True)
            if only_green(codes, tile):
                heads[i] = undo, width, height, codes[0], cache
                images.append((bits, width * height, codes[0][0], codes[0][4]))
                total += len(data)
    out: list = [None] * len(files)
    for (i, (undo, width, height, codes, cache)), part in zip(heads.items(), Joint(images).parts if images else []):
        pixels = None if part is None else green_pixels(*part, width, codes, cache)
        if pixels is not None:
            out[i] = undone(pixels.reshape(height, width), undo)
    return [decode(data) if pixels is None else pixels for data, pixels in zip(files, out)]


class Writer:
    def __init__(self):
        self.value, self.n, self.parts = 0, 0, []

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n
        if self.n >= 4096:
            self.parts.append((self.value & ((1 << 4096) - 1)).to_bytes(512, "little"))
            self.value >>= 4096
            self.n -= 4096

    def size(self) -> int:
        return 8 * sum(map(len, self.parts)) + self.n

    def bytes(self) -> bytes:
        return b"".join(self.parts) + self.value.to_bytes((self.n + 7) >> 3, "little")


def lengths_of(symbols: list[int], counts: list[int], most: int = 15) -> list[int]:
    """Huffman code lengths, of at most ``most`` bits, of symbols; the lighter first, of equals the lesser."""
    n = len(symbols)
    if n < 2:
        return [1] * n
    while True:
        leaves = sorted(zip(counts, range(n)))
        # Leaves and inner nodes both come by growing weight: two queues, no heap.
        weight, above, leaf, inner = [c for c, _ in leaves], [0] * (2 * n - 1), 0, n
        for node in range(n, 2 * n - 1):
            if leaf < n and (inner >= node or weight[leaf] <= weight[inner]):
                one, leaf = leaf, leaf + 1
            else:
                one, inner = inner, inner + 1
            if leaf < n and (inner >= node or weight[leaf] <= weight[inner]):
                two, leaf = leaf, leaf + 1
            else:
                two, inner = inner, inner + 1
            above[one] = above[two] = node
            weight.append(weight[one] + weight[two])
        depth = [0] * (2 * n - 1)
        for node in range(2 * n - 3, -1, -1):
            depth[node] = depth[above[node]] + 1
        if max(depth[:n]) <= most:
            out = [0] * n
            for (_, i), d in zip(leaves, depth):
                out[i] = d
            return out
        counts = [(c + 1) // 2 for c in counts]


#: The code in which lengths are written: four bits for those to 12, five for the others. Complete.
OF_LENGTHS = [4] * 13 + [5] * 6
LENGTH_WORDS = canonical(OF_LENGTHS)
#: How a code with lengths opens, and its bits: no simple code, 19 lengths of the code of lengths, all symbols follow.
OPENING = (15 << 1 | sum(OF_LENGTHS[s] << (5 + 3 * i) for i, s in enumerate(ORDER)), 5 + 3 * len(ORDER) + 1)


def put_code(w: Writer, symbols: list[int], lengths: list[int], size: int) -> list[int]:
    """Writes the lengths of a code of ascending symbols; gives their words, which are empty if there is but one symbol."""
    if len(symbols) <= 1 and (not symbols or symbols[0] < 256):
        w.put(5 | (symbols[0] if symbols else 0) << 3, 11)  # a simple code of one symbol with 8 bits
        return [0] * len(symbols)
    acc, n = OPENING
    zero = LENGTH_WORDS[0]
    before = -1
    for s, length in zip([*symbols, size], [*lengths, -1]):
        gap = s - before - 1
        while gap:
            if gap < 3:
                acc |= zero << n
                n += 4
                gap -= 1
            elif gap < 11:
                acc |= (LENGTH_WORDS[17] | (gap - 3) << 5) << n
                n += 8
                gap = 0
            else:
                k = min(gap, 138)
                acc |= (LENGTH_WORDS[18] | (k - 11) << 5) << n
                n += 12
                gap -= k
        before = s
        if length > 0:
            acc |= LENGTH_WORDS[length] << n
            n += OF_LENGTHS[length]
    w.put(acc, n)
    if len(symbols) == 1:
        return [0]
    words, code, last = [0] * len(symbols), 0, 0
    for length, i in sorted(zip(lengths, range(len(symbols)))):
        if length != last:
            code <<= length - last
            turned, last = turned_words(length), length
        words[i] = turned[code]
        code += 1
    return words


def put_counts(w: Writer, counts, most: int = 15) -> tuple[list[int], list[int], list[int]]:
    """Writes the code of counted symbols; gives the symbols, their words and how many bits these take."""
    counts = np.asarray(counts)
    used = np.flatnonzero(counts)
    symbols = used.tolist()
    lengths = lengths_of(symbols, counts[used].tolist(), most)
    words = put_code(w, symbols, lengths, len(counts))
    return symbols, words, lengths if len(symbols) > 1 else [0] * len(symbols)


def prefix(value: int) -> tuple[int, int, int]:
    """Prefix symbol, extra bits and how many of a length or distance."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    high = v.bit_length() - 1
    second = (v >> (high - 1)) & 1
    return 2 * high + second, v & ((1 << (high - 1)) - 1), high - 1


def symbols(pixels: np.ndarray, repeats: bool, cache: int) -> list[tuple]:
    """Literals, (length, distance code) and cache indices of an image."""
    flat = pixels.ravel().tolist()
    width = pixels.shape[1]
    near = {dx + dy * width: i + 1 for i, (dx, dy) in reversed(list(enumerate(NEAR))) if dx + dy * width >= 1}
    colours, last, out, at, kept = [0] * (1 << cache), {}, [], 0, 0
    while at < len(flat):
        length, key = 0, tuple(flat[at : at + 3])
        if repeats and len(key) == 3:
            seen = last.get(key)
            if seen is not None:
                while at + length < len(flat) and length < 4096 and flat[seen + length] == flat[at + length]:
                    length += 1
        while cache and kept < at:
            colours[(MULTIPLIER * flat[kept] & 0xFFFFFFFF) >> (32 - cache)] = flat[kept]
            kept += 1
        if length >= 3:
            out.append((1, length, near.get(at - seen, at - seen + 120)))
        else:
            length = 1
            slot = (MULTIPLIER * flat[at] & 0xFFFFFFFF) >> (32 - cache) if cache else 0
            out.append((2, slot, 0) if cache and at and colours[slot] == flat[at] else (0, flat[at], 0))
        for i in range(at, at + length if repeats else at):
            last[tuple(flat[i : i + 3])] = i
        at += length
    return out


def put_image(w: Writer, pixels: np.ndarray, main: bool, repeats: bool = True, cache: int = 0, groups: np.ndarray | None = None, step: int = 2) -> None:
    """An entropy-coded image with Huffman codes. ``groups``: the code group of each tile of 2 ** step pixels."""
    w.put(1 if cache else 0, 1)
    if cache:
        w.put(cache, 4)
    if main:
        w.put(groups is not None, 1)
        if groups is not None:
            w.put(step - 2, 3)
            put_image(w, groups.astype(np.uint32) << 8, False)
    width = pixels.shape[1]
    n_groups = int(groups.max()) + 1 if groups is not None else 1
    counts = [[[0] * n for n in (280 + ((1 << cache) if cache else 0), 256, 256, 256, 40)] for _ in range(n_groups)]
    stream, at = [], 0
    for kind, a, b in symbols(pixels, repeats, cache):
        g = int(groups[(at // width) >> step, (at % width) >> step]) if groups is not None else 0
        if kind == 0:
            row = [(0, (a >> 8) & 255, 0, 0), (1, (a >> 16) & 255, 0, 0), (2, a & 255, 0, 0), (3, a >> 24, 0, 0)]
        elif kind == 1:
            length, distance = prefix(a), prefix(b)
            row = [(0, 256 + length[0], *length[1:]), (4, *distance)]
        else:
            row = [(0, 280 + a, 0, 0)]
        for c, s, _, _ in row:
            counts[g][c][s] += 1
        stream.append((g, row))
        at += a if kind == 1 else 1
    made = [[put_counts(w, c) for c in group] for group in counts]
    words = [[{s: (c, n) for s, c, n in zip(*code)} for code in group] for group in made]
    for g, row in stream:
        for c, s, extra, n in row:
            w.put(*words[g][c][s])
            w.put(extra, n)


def put_header(w: Writer, width: int, height: int) -> None:
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)
    w.put(0, 3)


def riff(body: bytes) -> bytes:
    chunk = b"\x2f" + body
    size = len(chunk)
    chunk += b"\0" * (size & 1)
    return b"RIFF" + (12 + len(chunk)).to_bytes(4, "little") + b"WEBPVP8L" + size.to_bytes(4, "little") + chunk


def encode(pixels: np.ndarray, transforms=(), repeats: bool = True, cache: int = 0, groups: np.ndarray | None = None, step: int = 2) -> bytes:
    """A compact file. ``transforms``: (PREDICTOR or CROSS, tile bits, elements), (GREEN,) or (PALETTE,), in order."""
    pixels = np.asarray(pixels, dtype=np.uint32)
    w = Writer()
    put_header(w, pixels.shape[1], pixels.shape[0])
    for kind, *more in transforms:
        w.put(1, 1)
        w.put(kind, 2)
        if kind in (PREDICTOR, CROSS):
            size, elements = more
            w.put(size - 2, 3)
            put_image(w, np.asarray(elements, np.uint32) << (8 if kind == PREDICTOR else 0), False)
            pixels = predict(pixels, elements, size, False) if kind == PREDICTOR else cross(pixels, np.asarray(elements, np.uint32), size, False)
        elif kind == GREEN:
            pixels = green(pixels, False)
        else:
            colours, index = np.unique(pixels, return_inverse=True)
            w.put(len(colours) - 1, 8)
            c = channels(colours)
            put_image(w, packed(np.concatenate([c[:1], c[1:] - c[:-1]]))[None], False)
            bits = palette_bits(len(colours))
            index = index.reshape(pixels.shape).astype(np.uint32)
            index = np.pad(index, ((0, 0), (0, -pixels.shape[1] % (1 << bits))))
            pixels = np.zeros((index.shape[0], index.shape[1] >> bits), dtype=np.uint32)
            for i in range(1 << bits):
                pixels |= index[:, i :: 1 << bits] << (8 + i * (8 >> bits))
    w.put(0, 1)
    put_image(w, pixels, True, repeats, cache, groups, step)
    return riff(w.bytes())


#: Bytes by which repeats are found.
GRAM = 6
#: Bytes of a back-reference, at least.
WORTH = 12
#: Longest code words that are written, and the colour cache's bits.
MOST, CACHE = 12, 10
LONGEST = 4096
#: Cache places of green residuals of 0 to 255, by opacity; with so many bits all differ.
PLACES = (MULTIPLIER * (np.array([[0], [255]]) << 24 | np.arange(256) << 8) & 0xFFFFFFFF) >> (32 - CACHE)
#: Longer strings are written in pieces of so many bytes.
LONG, PIECE = 1 << 20, 1 << 18
#: What ``encode_grey`` does with an image; the kind follows from its bytes alone.
KINDS = ("palette", "green and references", "predictor, green and cache", "cross-colour, references and cache")


def kind_of(payload: np.ndarray) -> int:
    """Few values make a palette; other kinds rotate with the checksum, so that a column has files of all."""
    return 0 if len(payload) <= LONGEST and np.count_nonzero(np.bincount(payload, minlength=256)) <= 16 else 1 + zlib.crc32(payload) % 3


def grey(payload: np.ndarray, width: int) -> np.ndarray:
    return (payload.astype(np.uint32) * np.uint32(0x010101) | np.uint32(0xFF000000)).reshape(-1, width)


def references(data: np.ndarray, row: np.ndarray, stop: np.ndarray) -> list[tuple[int, int, int]]:
    """(position, length, distance) of repeats within a row, in order and apart; ``stop``: the end of each position's row, 0 for none."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return []
    at = np.flatnonzero(np.arange(n) + GRAM <= stop[:n])
    words = np.ndarray((n,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))[at] << np.uint64(64 - 8 * GRAM)
    # By bytes and then place, which puts a row's equal ones side by side.
    if len(at) <= 1 << (64 - 8 * GRAM):
        words |= np.arange(len(at), dtype=np.uint64)
        words.sort()
        at = at[words & np.uint64((1 << (64 - 8 * GRAM)) - 1)]
        words >>= np.uint64(64 - 8 * GRAM)
    else:
        order = np.argsort(words, kind="stable")
        at, words = at[order], words[order]
    same = np.flatnonzero(words[1:] == words[:-1])
    same = same[row[at[same + 1]] == row[at[same]]]
    back = np.zeros(n, dtype=np.int64)
    back[at[same + 1]] = at[same + 1] - at[same]
    # Positions in a row with one distance make one long repeat.
    first = np.append(0, 1 + np.flatnonzero(back[1:] != back[:-1]))
    last = np.append(first[1:], n)
    live = (back[first] > 0) & (last - first + GRAM - 1 >= WORTH)
    out, free = [], 0
    for begin, end, far in zip(first[live].tolist(), last[live].tolist(), back[first[live]].tolist()):
        begin, end = max(begin, free), end + GRAM - 1
        while end - begin >= WORTH:
            size = min(end - begin, LONGEST)
            out.append((begin, size, far))
            begin += size
            free = begin
    return out


def prefixes(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`prefix` of many numbers."""
    v = value - 1
    high = np.frexp(np.maximum(v, 1).astype(np.float64))[1].astype(np.int64) - 1
    extra = np.where(v < 4, 0, high - 1)
    return np.where(v < 4, v, 2 * high + ((v >> np.maximum(high - 1, 0)) & 1)), np.where(v < 4, 0, v & ((1 << extra) - 1)), extra


@functools.lru_cache(maxsize=None)
def near_codes(width: int) -> dict[int, int]:
    """The codes of distances that point at near pixels."""
    return {dx + dy * width: i + 1 for i, (dx, dy) in reversed(list(enumerate(NEAR))) if dx + dy * width >= 1}


@functools.lru_cache(maxsize=1000)
def even_image(height: int, width: int, colour: int) -> tuple[int, int]:
    """Bits of an image of one colour, and their number."""
    w = Writer()
    put_image(w, np.full((height, width), colour, dtype=np.uint32), False, False)
    return int.from_bytes(w.bytes(), "little"), w.size()


def begun(w: Writer, payload: np.ndarray, width: int, kind: int) -> np.ndarray:
    """Writes what comes before the prefix codes; gives the green channel that they are for."""
    height = len(payload) // width
    put_header(w, width, height)
    left = payload
    if kind == 2:
        square = payload.reshape(height, width)
        tries = [edged(square, m) for m in (0, 1, 2)]
        weight = [float(np.square(np.bincount(x.ravel(), minlength=256), dtype=np.float64).sum()) for x in tries]
        mode = weight.index(max(weight))
        w.put(1 | PREDICTOR << 1 | 7 << 3, 6)
        w.put(*even_image(-(-height >> 9), -(-width >> 9), mode << 8))
        left = tries[mode].ravel()
    if kind == 3:
        # Red and blue less green: a factor of one is 32, for green to red and green to blue.
        w.put(1 | CROSS << 1 | 7 << 3, 6)
        w.put(*even_image(-(-height >> 9), -(-width >> 9), 32 << 8 | 32))
    else:
        w.put(1 | GREEN << 1, 3)
    w.put(0, 1)
    w.put(kind != 1, 1)
    if kind != 1:
        w.put(CACHE, 4)
    w.put(0, 1)
    return left


#: Symbols of the green code, with those of the cache.
GREENS = 280 + (1 << CACHE)


class Tokens:
    """Literals, cache hits and references of runs of bytes, as arrays.

    ``row``: the run of each byte, ``stop``: where runs end, ``seen``: which shades a run (256 of each) has had.
    """

    def __init__(self, green: np.ndarray, row: np.ndarray, kinds: np.ndarray, widths: list[int], stop: np.ndarray, seen: np.ndarray):
        # Greys have a place each in the cache (PLACES), so a pixel is in it if it has been in its run before.
        shade = row << 8 | green
        symbol = np.where(kinds[:, None] >= 2, 280 + PLACES[kinds & 1], np.arange(256)).astype(np.int32).ravel()[shade]
        first = np.full(len(seen), -1, dtype=np.int64)
        first[shade[::-1]] = np.arange(len(green))[::-1]
        first[seen] = -1
        first = first[first >= 0]
        symbol[first] = green[first]
        seen[shade[first]] = True
        repeats = np.array(references(green, row, np.where(kinds % 2 == 1, stop, 0)[row]), dtype=np.int64).reshape(-1, 3)
        start = repeats[:, 0]
        length, self.more, self.bits = prefixes(repeats[:, 1])
        inside = np.zeros(len(green) + 1, dtype=np.int8)
        inside[start] += 1
        inside[start + repeats[:, 1]] -= 1
        token = (np.cumsum(inside[:-1], dtype=np.int8) == 0) & (kinds > 0)[row]
        token[start] = True
        symbol[start] = 256 + length
        codes = np.array([near_codes(widths[r]).get(far, far + 120) for r, far in zip(row[start].tolist(), repeats[:, 2].tolist())], dtype=np.int64)
        distance, self.far_more, self.far_bits = prefixes(codes)
        self.at = np.flatnonzero(token)
        self.row = row[self.at]
        self.refers = np.searchsorted(self.at, start)
        self.place, self.far_place = self.row.astype(np.int64) * GREENS + symbol[self.at], row[start].astype(np.int64) * 40 + distance

    def counts(self, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """How often each row has each symbol, and each prefix of a distance."""
        return np.bincount(self.place, minlength=rows * GREENS).reshape(rows, GREENS), np.bincount(self.far_place, minlength=rows * 40).reshape(rows, 40)

    def written(self, codes) -> tuple[np.ndarray, np.ndarray]:
        """One number of at most 58 bits for each token (word, extra bits, and those of the distance), and its bits."""
        word, wide, far_word, far_wide = (c.ravel() for c in codes)
        value, n_bits = word[self.place], wide[self.place]
        refers = self.refers
        for part, bits in ((self.more.astype(np.uint64), self.bits), (far_word[self.far_place], far_wide[self.far_place]), (self.far_more.astype(np.uint64), self.far_bits)):
            value[refers] |= part << n_bits[refers].astype(np.uint64)
            n_bits[refers] += bits
        return value, n_bits


def empty_codes(rows: int) -> tuple[np.ndarray, ...]:
    return np.zeros((rows, GREENS), dtype=np.uint64), np.zeros((rows, GREENS), dtype=np.int64), np.zeros((rows, 40), dtype=np.uint64), np.zeros((rows, 40), dtype=np.int64)


def put_codes(w: Writer, kind: int, counts: np.ndarray, far_counts: np.ndarray, codes, i: int) -> None:
    """Writes the five codes of an image; their words and lengths go to row ``i`` of ``codes``."""

    def fill(own: np.ndarray, words_to: np.ndarray, wide_to: np.ndarray) -> None:
        used, words, lengths = put_counts(w, own, MOST)
        words_to[used], wide_to[used] = words, lengths

    fill(counts[: 280 if kind == 1 else GREENS], codes[0][i], codes[1][i])
    w.put(5 | 5 << 11 | (5 | (0 if kind == 2 else 255) << 3) << 22, 33)  # three simple codes: red, blue, opacity
    fill(far_counts, codes[2][i], codes[3][i])


def joined_bits(size: int, value: np.ndarray, n_bits: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """``size`` bytes with numbers of at most 58 bits in them, each from a bit on; these grow, and no two numbers share a bit."""
    out = np.zeros((size >> 3) + 2, dtype="<u8")
    word, shift = begin >> 6, begin & 63
    if len(word):
        first = np.append(0, 1 + np.flatnonzero(word[1:] != word[:-1]))
        out[word[first]] = np.bitwise_or.reduceat(value << shift.astype(np.uint64), first)
    over = np.flatnonzero(shift + n_bits > 64)
    out[word[over] + 1] |= value[over] >> (64 - shift[over]).astype(np.uint64)
    return out.view(np.uint8)[:size]


def encode_grey(data: np.ndarray, offsets: np.ndarray, widths: list[int]) -> list[bytes]:
    """A file for each run of bytes between offsets, a grey pixel for each byte."""
    rows = len(widths)
    green, files = data.copy(), [b""] * rows
    kinds, heads = np.zeros(rows, dtype=np.int64), [Writer() for _ in range(rows)]
    for i in range(rows):
        payload, width = data[offsets[i] : offsets[i + 1]], widths[i]
        kind = kind_of(payload)
        if kind == 0:
            files[i] = encode(grey(payload, width), [(PALETTE,)])
        elif len(payload) > LONG:
            files[i] = encode_long(payload, width, kind)
        else:
            kinds[i] = kind
            green[offsets[i] : offsets[i + 1]] = begun(heads[i], payload, width, kind)
    chosen = np.flatnonzero(kinds).tolist()
    if not chosen:
        return files
    row = np.repeat(np.arange(rows, dtype=np.int32), np.diff(offsets))
    tokens = Tokens(green, row, kinds, widths, offsets[1:], np.zeros(rows << 8, dtype=bool))
    counts, far_counts = tokens.counts(rows)
    codes = empty_codes(rows)
    for i in chosen:
        put_codes(heads[i], int(kinds[i]), counts[i], far_counts[i], codes, i)
    value, n_bits = tokens.written(codes)
    head_bits = np.array([w.size() for w in heads], dtype=np.int64)
    ends = np.concatenate([[0], np.cumsum(n_bits)])
    bounds = ends[np.searchsorted(tokens.at, offsets)]
    base = np.concatenate([[0], np.cumsum((head_bits + np.diff(bounds) + 7) >> 3)])
    begin = (base[:-1] * 8 + head_bits - bounds[:-1])[tokens.row] + ends[:-1]
    buffer = joined_bits(int(base[-1]), value, n_bits, begin)
    for i in chosen:
        head = np.frombuffer(heads[i].bytes(), dtype=np.uint8)
        buffer[base[i] : base[i] + len(head)] += head
        files[i] = riff(buffer[base[i] : base[i + 1]].tobytes())
    return files


def encode_long(payload: np.ndarray, width: int, kind: int) -> bytes:
    """As :func:`encode_grey`, of one run and piece by piece: symbols are made twice, to count and to write them."""
    w, kinds = Writer(), np.array([kind])
    green = begun(w, payload, width, kind)

    def pieces():
        seen = np.zeros(256, dtype=bool)
        for lo in range(0, len(green), PIECE):
            part = green[lo : lo + PIECE]
            yield Tokens(part, np.zeros(len(part), dtype=np.int32), kinds, [width], np.array([len(part)]), seen)

    counts, far_counts = np.zeros((1, GREENS), dtype=np.int64), np.zeros((1, 40), dtype=np.int64)
    for tokens in pieces():
        for total, own in zip((counts, far_counts), tokens.counts(1)):
            total += own
    codes = empty_codes(1)
    put_codes(w, kind, counts[0], far_counts[0], codes, 0)
    at = w.size()
    out = bytearray(w.bytes())
    for tokens in pieces():
        value, n_bits = tokens.written(codes)
        ends = np.cumsum(n_bits)
        buffer = joined_bits((at & 7) + int(ends[-1]) + 7 >> 3, value, n_bits, (at & 7) + ends - n_bits)
        if at & 7:
            buffer[0] += out.pop()
        at += int(ends[-1])
        out += buffer[: (at + 7 >> 3) - len(out)].tobytes()
    return riff(bytes(out))
