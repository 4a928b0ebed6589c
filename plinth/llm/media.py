"""Media columns: cropped or edited image copies by local descriptors.

Images are bytes in a column: binary PGM/PPM, or PNG of 8 bits a channel without
interlacing.  Of each image a pyramid of scales is built; corners are the local
maxima of the Harris response above a share of the largest; each gets an
orientation (the direction of the intensity centroid) and 128 intensity
comparisons in the patch turned to it.

The images, in order of their ids, are put in blocks of about 2048 * ``hot_word``
corners, kept in the shared folder.  Each pair of blocks is compared on its own, so
that all matches of two images meet in one task: only copies leave it, and nothing
is shuffled between blocks.  Corners take the room of the input; the comparisons,
like the matches by chance, grow with the square of the corners.

Corners match if they differ in at most ``max_distance`` of all bits.  Every match of
an image pair proposes a similarity transform (turn, scale, shift); the pair is a
copy when at least ``min_inliers`` matches at distinct places agree with one.

Which image pairs are measured so, over all their corners, is chosen by an index: in a
pair of blocks there are tables of ``key_bits`` sampled bits each, and corners that
agree on a table's bits are compared.  An image pair is measured if two matches found
so agree with each other and differ in few bits (1.5 times ``max_distance`` in
sum), or three agree.  There are as many tables as find two of ``min_inliers`` matches
that differ in three quarters of ``max_distance`` bits, wherever they are, with
probability ``recall``.  Common keys are compared in pieces of about
``CHUNK`` pairs, whole: no key, image or match is left out for being common.

Nulls, ties, odd input: null, empty, undecodable and featureless images match
nothing; null ids take no part; rows that share an id are versions of one image,
not paired with each other; of equally supported transforms the first match's is
reported; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm._util import checkpoint, quoted, shuffle_partitions

RADIUS, BITS, TURNS = 11, 128, 36
CHUNK = 1 << 15  # corner pairs compared at once
PART = 1 << 20  # corners of a block compared at once with all of another
MATCHES, HELD = 1 << 26, 1 << 20  # of two blocks by their keys, and of those unpacked at once
FULL_TURN, TURN_SLACK, SIZE_SLACK = 31416, 17, 1.5  # of matches that agree: 1/5,000 radians, 1/256 turns, sizes
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9], np.uint64)


def _png(data: bytes) -> np.ndarray | None:
    at, head, body = 8, None, []
    while at + 8 <= len(data):
        n, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        chunk = data[at + 8 : at + 8 + n]
        at += 12 + n
        if kind == b"IHDR":
            head = chunk
        elif kind == b"IDAT":
            body.append(chunk)
    if head is None or head[8] != 8 or head[9] not in (0, 2, 4, 6) or head[12]:
        return None
    w, h, c = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big"), {0: 1, 2: 3, 4: 2, 6: 4}[head[9]]
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, 1 + w * c)
    out = np.zeros((h, w * c), np.uint8)
    above = np.zeros(w * c, np.int64)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        if kind == 1:
            line = np.cumsum(line.reshape(w, c), axis=0).ravel() & 255
        elif kind == 2:
            line = (line + above) & 255
        elif kind in (3, 4):
            for i in range(w * c):
                left, up, corner = (line[i - c], above[i], above[i - c]) if i >= c else (0, above[i], 0)
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    d = (abs(p - left), abs(p - up), abs(p - corner))
                    guess = left if d[0] <= d[1] and d[0] <= d[2] else up if d[1] <= d[2] else corner
                line[i] = (line[i] + guess) & 255
        out[y], above = line, line
    out = out.reshape(h, w, c).astype(np.float32)
    return out[:, :, 0] if c < 3 else out[:, :, :3] @ np.array([0.299, 0.587, 0.114], np.float32)


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey values as floats, or None for what isn't a supported image."""
    try:
        if not data:
            return None
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
        if data[:2] not in (b"P5", b"P6"):
            return None
        fields, at = [], 2
        while len(fields) < 3:
            while data[at : at + 1].isspace():
                at += 1
            if data[at : at + 1] == b"#":
                at = data.index(b"\n", at)
                continue
            end = at
            while data[end : end + 1].isdigit():
                end += 1
            fields.append(int(data[at:end]))
            at = end
        w, h, most = fields
        c = 1 if data[:2] == b"P5" else 3
        if most > 255 or w * h == 0:
            return None
        x = np.frombuffer(data, np.uint8, w * h * c, at + 1).reshape(h, w, c).astype(np.float32)
        return x[:, :, 0] if c == 1 else x @ np.array([0.299, 0.587, 0.114], np.float32)
    except (ValueError, IndexError, zlib.error):
        return None


def _box(x: np.ndarray, r: int) -> np.ndarray:
    p = np.pad(x, ((r + 1, r), (r + 1, r)), "edge").cumsum(0).cumsum(1)
    n = 2 * r + 1
    return (p[n:, n:] - p[:-n, n:] - p[n:, :-n] + p[:-n, :-n]) / (n * n)


def _peak(x: np.ndarray, r: int) -> np.ndarray:
    """Largest value within ``r`` rows."""
    p = np.pad(x, ((r, r), (0, 0)), constant_values=-np.inf)
    return np.max([p[d : d + len(x)] for d in range(2 * r + 1)], axis=0)


def _resize(x: np.ndarray, h: int, w: int) -> np.ndarray:
    ys, xs = (np.arange(h) + 0.5) * x.shape[0] / h - 0.5, (np.arange(w) + 0.5) * x.shape[1] / w - 0.5
    y0, x0 = np.clip(np.floor(ys).astype(int), 0, x.shape[0] - 1), np.clip(np.floor(xs).astype(int), 0, x.shape[1] - 1)
    y1, x1 = np.minimum(y0 + 1, x.shape[0] - 1), np.minimum(x0 + 1, x.shape[1] - 1)
    fy, fx = np.clip(ys - y0, 0, 1)[:, None], np.clip(xs - x0, 0, 1)[None]
    return (x[y0][:, x0] * (1 - fx) + x[y0][:, x1] * fx) * (1 - fy) + (x[y1][:, x0] * (1 - fx) + x[y1][:, x1] * fx) * fy


def _pattern() -> np.ndarray:
    """Offsets of the comparisons for each of TURNS directions: [turn, bit, end, (y, x)]."""
    rng = np.random.default_rng(5)
    ends = np.clip(rng.normal(0, RADIUS / 2.2, (BITS, 2, 2)), -RADIUS + 1, RADIUS - 1)
    out = np.empty((TURNS, BITS, 2, 2), np.int64)
    for t in range(TURNS):
        a = 2 * np.pi * t / TURNS
        out[t] = np.rint(ends @ np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]]))
    return np.clip(out, -RADIUS, RADIUS)


PATTERN = _pattern()
DISC_Y, DISC_X = np.nonzero(np.add.outer(np.arange(-RADIUS, RADIUS + 1) ** 2, np.arange(-RADIUS, RADIUS + 1) ** 2) <= RADIUS**2)
DISC_Y, DISC_X = DISC_Y - RADIUS, DISC_X - RADIUS


def descriptors(image: np.ndarray, scales: tuple[float, ...] = (1.0, 0.7, 0.5), share: float = 0.04) -> tuple[np.ndarray, np.ndarray]:
    """(y, x, size, angle) of each corner, in pixels of the image, and its bits packed in 16 bytes."""
    places, bits = [], []
    for s in scales:
        h, w = round(image.shape[0] * s), round(image.shape[1] * s)
        if min(h, w) < 2 * RADIUS + 3:
            continue
        x = _box(image if s == 1 else _resize(image, h, w), 1)
        gy, gx = np.gradient(x)
        a, b, c = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        r = a * b - c * c - 0.05 * (a + b) ** 2
        inner = r[RADIUS + 1 : -RADIUS - 1, RADIUS + 1 : -RADIUS - 1]
        if not inner.size or inner.max() <= 1e-3:
            continue
        top = _peak(_peak(r, 2).T, 2).T
        peak = (r == top) & (r > share * inner.max())
        ys, xs = np.nonzero(peak[RADIUS + 1 : -RADIUS - 1, RADIUS + 1 : -RADIUS - 1])
        if not len(ys):
            continue
        ys, xs = ys + RADIUS + 1, xs + RADIUS + 1
        patch = x[ys[:, None] + DISC_Y, xs[:, None] + DISC_X]
        patch = patch - patch.mean(1, keepdims=True)
        angle = np.arctan2((patch * DISC_Y).sum(1), (patch * DISC_X).sum(1))
        turn = np.rint(angle / (2 * np.pi) * TURNS).astype(int) % TURNS
        p = PATTERN[turn]
        y, xx = ys[:, None, None] + p[..., 1], xs[:, None, None] + p[..., 0]
        v = x[y, xx]
        places.append(np.stack([(ys + 0.5) / s, (xs + 0.5) / s, np.full(len(ys), 1 / s), angle], 1))
        bits.append(np.packbits(v[..., 0] < v[..., 1], axis=1))
    if not places:
        return np.empty((0, 4)), np.empty((0, BITS // 8), np.uint8)
    return np.concatenate(places), np.concatenate(bits)


def consensus(m: np.ndarray, tolerance: float) -> tuple[int, float, float, float, float]:
    """(inliers, scale, turn, dy, dx) of the best transform; rows of ``m`` are
    (y, x, size, angle) in the one and in the other image."""
    a = m[:, 7] - m[:, 3]
    s = m[:, 6] / m[:, 2]
    ca, sa = np.cos(a) * s, np.sin(a) * s
    dy = m[:, 4] - (ca * m[:, 0] + sa * m[:, 1])
    dx = m[:, 5] - (ca * m[:, 1] - sa * m[:, 0])
    py = ca[:, None] * m[None, :, 0] + sa[:, None] * m[None, :, 1] + dy[:, None]
    px = ca[:, None] * m[None, :, 1] - sa[:, None] * m[None, :, 0] + dx[:, None]
    near = (py - m[None, :, 4]) ** 2 + (px - m[None, :, 5]) ** 2 <= (tolerance * np.maximum(1, m[None, :, 6])) ** 2
    cells, other = np.rint(m[:, :2] / 3).astype(int), np.rint(m[:, 4:6] / 3).astype(int)
    best, at = 0, 0
    for k in np.argsort(-near.sum(1), kind="stable"):
        if near[k].sum() <= best:
            break
        n = min(len({tuple(c) for c in cells[near[k]].tolist()}), len({tuple(c) for c in other[near[k]].tolist()}))
        if n > best:
            best, at = n, k
    return best, float(s[at]), float(a[at]), float(dy[at]), float(dx[at])


def pack_places(p: np.ndarray) -> np.ndarray:
    """(y, x, size, angle) in one number each: eighths of a pixel, hundredths, 1/10,000 radians."""
    q = [np.rint(p[:, 0] * 8), np.rint(p[:, 1] * 8), np.rint(p[:, 2] * 100), np.rint((p[:, 3] + 4) * 5000)]
    y, x, size, angle = (v.astype(np.int64) for v in q)
    return y << 44 | x << 26 | size << 16 | angle


def unpack_places(v: np.ndarray) -> np.ndarray:
    return np.stack([(v >> 44) / 8, (v >> 26 & 0x3FFFF) / 8, (v >> 16 & 0x3FF) / 100, (v & 0xFFFF) / 5000 - 4], 1)


def tables_needed(key_bits: int, max_distance: int, recall: float) -> int:
    """Tables of ``key_bits`` bits of which a pair at ``max_distance`` agrees on one with probability ``recall``."""
    p = math.comb(BITS - key_bits, max_distance) / math.comb(BITS, max_distance)
    if not p:
        raise ValueError("key_bits + max_distance must be at most 128")
    return 1 if p >= recall else math.ceil(math.log(1 - recall) / math.log(1 - p))


def table_bits(tables: int, key_bits: int) -> np.ndarray:
    """The bits of each table; each bit is used again only when all have been."""
    rng = np.random.default_rng(11)
    out, left = [], []
    for _ in range(tables):
        if len(left) < key_bits:
            more = rng.permutation(BITS).tolist()
            left += [b for b in more if b not in left] + [b for b in more if b in left]
        out.append(left[:key_bits])
        left = left[key_bits:]
    return np.array(out)


def pair_tables(key_bits: int, max_distance: int, min_inliers: int, recall: float) -> int:
    """Tables that find two of ``min_inliers`` matches that differ in three quarters of
    ``max_distance`` bits with probability ``recall``."""
    n, low, high = max(min_inliers, 2), 0.0, 1.0
    for _ in range(50):  # of a match's own probability
        q = (low + high) / 2
        low, high = (low, q) if 1 - (1 - q) ** n - n * q * (1 - q) ** (n - 1) >= recall else (q, high)
    return tables_needed(key_bits, max_distance * 3 // 4, high)


def shared_keys(h: np.ndarray, low: np.ndarray, n_a: int, mask: np.ndarray, max_distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Corners before and from ``n_a`` that agree on the bits of ``mask`` and are at most ``max_distance`` bits apart."""
    bits = len(h).bit_length()
    key = (h & mask[0]) * MIX[0] + (low & mask[1]) * MIX[1]
    key ^= key >> np.uint64(29)
    key *= MIX[2]
    key >>= np.uint64(bits)
    key <<= np.uint64(bits)
    key |= np.arange(len(h), dtype=np.uint64)
    key.sort()
    at = (key & np.uint64((1 << bits) - 1)).astype(np.int32)
    key >>= np.uint64(bits)
    same = np.concatenate([[False], key[1:] == key[:-1], [False]])
    at, begins = at[same[1:] | same[:-1]], ~same[:-1][same[1:] | same[:-1]]
    start = np.flatnonzero(begins)  # of the runs of two and more
    end = np.append(start[1:], len(at))
    k = np.add.reduceat(at < n_a, start, dtype=np.int64) if len(at) else start  # in each run those of the one side come first
    both = (k > 0) & (k < end - start)
    start, end, k = start[both], end[both], k[both]
    one = np.arange(k.sum()) + np.repeat(start - (np.cumsum(k) - k), k)
    other, n = np.repeat(start + k, k), np.repeat(end - start - k, k)
    total = np.cumsum(n)
    h, low = h[at], low[at]
    cut = 0
    while cut < len(n):
        base = total[cut - 1] if cut else 0
        to = max(cut + 1, int(np.searchsorted(total, base + CHUNK, "right")))
        m, x = n[cut:to], one[cut:to]
        y = np.arange(base, total[to - 1]) + np.repeat(other[cut:to] - (total[cut:to] - m), m)
        apart = np.bitwise_count(np.repeat(h[x], m) ^ h[y])
        apart += np.bitwise_count(np.repeat(low[x], m) ^ low[y])
        hit = np.flatnonzero(apart <= max_distance)
        if len(hit):
            yield at[x[np.searchsorted(total[cut:to], hit + base, "right")]], at[y[hit]] - n_a
        cut = to


def fits(m: np.ndarray, o: np.ndarray, tolerance: float) -> np.ndarray:
    """Whether the transform of each match of ``m`` takes the place of that of ``o`` to its other one."""
    a, s = m[:, 7] - m[:, 3], m[:, 6] / m[:, 2]
    ca, sa, y, x = np.cos(a) * s, np.sin(a) * s, o[:, 0] - m[:, 0], o[:, 1] - m[:, 1]
    return (m[:, 4] + ca * y + sa * x - o[:, 4]) ** 2 + (m[:, 5] + ca * x - sa * y - o[:, 5]) ** 2 <= (tolerance * np.maximum(1, o[:, 6])) ** 2


def agreeing(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, pair: np.ndarray, max_distance: int, tolerance: float) -> np.ndarray:
    """Of matches in the order of their pairs of images, the pairs of which two agree that differ
    in few bits, or three that differ in any number; ``tolerance`` is taken 1.5 times."""
    turn = ((b["place"] & 0xFFFF) * 256 // FULL_TURN).astype(np.uint8)[j] - ((a["place"] & 0xFFFF) * 256 // FULL_TURN).astype(np.uint8)[i]
    left = np.append(np.flatnonzero(pair[1:] != pair[:-1]) + 1, len(pair))
    left = np.repeat(left, np.diff(left, prepend=0)) - np.arange(len(pair))  # matches of its pair from each one on
    support, done, step = np.zeros(len(pair), np.int32), [np.empty(0, np.int64)], 1
    x = np.arange(len(pair))
    while len(x := x[left[x] > step]):  # each with the next of its pair, the one after that, and so on
        y = x + step
        alike = np.flatnonzero(np.abs((turn[x] - turn[y]).view(np.int8).astype(np.int16)) <= TURN_SLACK)
        u, v = x[alike], y[alike]
        if len(u):
            m, o = (np.hstack([unpack_places(a["place"][i[k]]), unpack_places(b["place"][j[k]])]) for k in (u, v))
            apart = m[:, 6] / m[:, 2] / (o[:, 6] / o[:, 2])
            alike = (apart <= SIZE_SLACK) & (apart >= 1 / SIZE_SLACK) & (i[u] != i[v]) & (j[u] != j[v])
            one, other = alike & fits(m, o, 1.5 * tolerance), alike & fits(o, m, 1.5 * tolerance)
            support[u[one]] += 1  # each is there once
            support[v[other]] += 1
            either = one | other
            u, v = u[either], v[either]
            bits = sum(np.bitwise_count(a[w][i[k]] ^ b[w][j[k]]).astype(np.int32) for w in ("h", "l") for k in (u, v))
            enough = pair[u[(bits * 2 <= 3 * max_distance) | (support[u] > 1) | (support[v] > 1)]]
            if len(enough):
                done.append(enough)
                x = x[~np.isin(pair[x], enough)]
        step += 1
    return np.unique(np.concatenate(done))


def hinted(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, after: int | None, masks: np.ndarray, max_distance: int, min_inliers: int, tolerance: float, limit: int | None) -> np.ndarray | None:
    """Pairs of an image of ``a`` and one of ``b`` (where ``after`` is given, one whose number is
    larger by more than that) that are worth measuring by the matches that share a table's key, as
    a's image << b's images.bit_length() | b's; None where there are more than ``limit`` of those."""
    first_a, first_b = np.append(0, ends_a[:-1]), np.append(0, ends_b[:-1])
    n_a, n_b = ends_a - first_a, ends_b - first_b
    image_a, image_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
    in_a, in_b, of_b = (int(x).bit_length() for x in (n_a.max(), n_b.max(), len(n_b)))
    corners = in_a + in_b
    packed_a = image_a << of_b + corners | np.arange(len(a)) - first_a[image_a] << in_b  # of a match: its images, then its corners
    packed_b = image_b << corners | np.arange(len(b)) - first_b[image_b]
    h, low = np.concatenate([a["h"], b["h"]]), np.concatenate([a["l"], b["l"]])
    m, held = np.empty(0, np.int64), 0
    for mask in masks:
        for i, j in shared_keys(h, low, len(a), mask, max_distance):
            if after is not None:
                later = image_a[i] + after < image_b[j]
                i, j = i[later], j[later]
            if held + len(i) > len(m):
                m.resize(held + len(i) + HELD, refcheck=False)
            m[held : held + len(i)] = packed_a[i] | packed_b[j]
            held += len(i)
        if limit is not None and held > limit:
            return None
    m = m[:held]
    m.sort()
    if min_inliers < 2:
        return np.unique(m >> corners)
    out, at = [np.empty(0, np.int64)], 0
    while at < len(m):  # some at a time, whole pairs
        to = int(np.searchsorted(m, (m[min(at + HELD, len(m)) - 1] >> corners) + 1 << corners))
        some, at = m[at:to], to
        some = some[np.concatenate([[True], some[1:] != some[:-1]])]  # some were found in several tables
        pair = some >> corners
        again = np.concatenate([[False], pair[1:] == pair[:-1], [False]])
        again = again[1:] | again[:-1]
        some, pair = some[again], pair[again]
        i = first_a[pair >> of_b] + (some >> in_b & (1 << in_a) - 1)
        j = first_b[pair & (1 << of_b) - 1] + (some & (1 << in_b) - 1)
        out.append(agreeing(a, b, i, j, pair, max_distance, tolerance))
    return np.concatenate(out)


def all_matches(a: np.ndarray, b: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the one and of the other of all corners at most ``max_distance`` bits apart."""
    step, found = max(1, CHUNK // len(b)), []
    for lo in range(0, len(a), step):
        apart = np.bitwise_count(a["h"][lo : lo + step, None] ^ b["h"])
        apart += np.bitwise_count(a["l"][lo : lo + step, None] ^ b["l"])
        found.append(np.flatnonzero(apart <= max_distance) + lo * len(b))
    return np.divmod(np.concatenate(found), len(b))


def promising(ms: np.ndarray, first: np.ndarray, sizes: np.ndarray, min_inliers: int, tolerance: float) -> np.ndarray:
    """Of groups of matches those of which one's transform fits at least ``min_inliers``,
    distinct or not; no group with that many at distinct places is left out."""
    out = np.zeros(len(first), bool)
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        step = max(1, (CHUNK >> 2) // int(n * n))
        for lo in range(0, len(at), step):
            rows = at[lo : lo + step]
            m = ms[(first[rows, None] + np.arange(n)).ravel()].reshape(len(rows), n, 8)
            a, s = m[:, :, 7] - m[:, :, 3], m[:, :, 6] / m[:, :, 2]
            ca, sa = np.cos(a) * s, np.sin(a) * s
            dy, dx = m[:, :, 4] - (ca * m[:, :, 0] + sa * m[:, :, 1]), m[:, :, 5] - (ca * m[:, :, 1] - sa * m[:, :, 0])
            y, x = m[:, None, :, 0], m[:, None, :, 1]
            py = ca[:, :, None] * y + sa[:, :, None] * x + dy[:, :, None]
            px = ca[:, :, None] * x - sa[:, :, None] * y + dx[:, :, None]
            fits = (py - m[:, None, :, 4]) ** 2 + (px - m[:, None, :, 5]) ** 2 <= (tolerance * np.maximum(1, m[:, None, :, 6])) ** 2
            out[rows] = fits.sum(2).max(1) >= min_inliers
    return out


CORNER = np.dtype([("place", "<i8"), ("h", "<u8"), ("l", "<u8")])


def block_copies(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, same: bool, chosen: np.ndarray, masks: np.ndarray, max_distance: int, min_inliers: int, tolerance: float) -> Iterator[tuple]:
    """(image of a, image of b, inliers, scale, turn, dy, dx) of the copies of two blocks
    of whole images, or of one (``same``), each pair of its images once."""
    assert len(masks) == len(chosen)
    first_a, first_b = np.append(0, ends_a[:-1]), np.append(0, ends_b[:-1])
    lo, part = 0, PART
    while lo < len(ends_a):  # some images at a time, fewer where copies are many, so that the matches of few are held
        begin = first_a[lo]
        hi = max(lo + 1, int(np.searchsorted(ends_a, begin + part, "right")))
        pairs = hinted(a[begin : ends_a[hi - 1]], b, ends_a[lo:hi] - begin, ends_b, lo if same else None, masks, max_distance, min_inliers, tolerance, MATCHES if hi - lo > 1 else None)
        if pairs is None:
            part = max(1, (ends_a[hi - 1] - begin) // 4)
            continue
        of_b = len(ends_b).bit_length()
        image_a, image_b = (pairs >> of_b) + lo, pairs & (1 << of_b) - 1
        cells = np.cumsum((ends_a - first_a)[image_a] * (ends_b - first_b)[image_b])
        at = 0
        while at < len(pairs):  # about PART << 5 pairs of corners at once
            to = max(at + 1, int(np.searchsorted(cells, (cells[at - 1] if at else 0) + (PART << 5), "right")))
            yield from measured(a, b, first_a, ends_a, first_b, ends_b, image_a[at:to], image_b[at:to], max_distance, min_inliers, tolerance)
            at = to
        lo = hi


def measured(a: np.ndarray, b: np.ndarray, first_a: np.ndarray, ends_a: np.ndarray, first_b: np.ndarray, ends_b: np.ndarray, image_a: np.ndarray, image_b: np.ndarray, max_distance: int, min_inliers: int, tolerance: float) -> Iterator[tuple]:
    """Those of the pairs of images (in order) that are copies by all matches of theirs."""
    places, pair = [np.empty((0, 2), np.int64)], [np.empty(0, np.int64)]
    for k in np.split(np.arange(len(image_a)), np.flatnonzero(np.diff(image_a)) + 1):  # with one image of a
        own, n = a[first_a[image_a[k[0]]] : ends_a[image_a[k[0]]]], (ends_b - first_b)[image_b[k]]
        others = np.concatenate([b[first_b[x] : ends_b[x]] for x in image_b[k]])
        i, j = all_matches(own, others, max_distance)
        of = np.repeat(k, n)[j]
        order = np.argsort(of, kind="stable")
        pair.append(of[order]), places.append(np.stack([own["place"][i], others["place"][j]], 1)[order])
    pair, places = np.concatenate(pair), np.concatenate(places)
    often = (np.bincount(pair, minlength=len(image_a)) >= min_inliers)[pair]
    pair, places = pair[often], places[often]
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    sizes = np.diff(np.append(first, len(pair)))
    ms = np.hstack([unpack_places(places[:, 0]), unpack_places(places[:, 1])])
    for k in np.flatnonzero(promising(ms, first, sizes, min_inliers, tolerance)):
        both = np.unique(places[first[k] : first[k] + sizes[k]], axis=0)
        best = consensus(np.hstack([unpack_places(both[:, 0]), unpack_places(both[:, 1])]), tolerance)
        if best[0] >= min_inliers:
            yield int(image_a[pair[first[k]]]), int(image_b[pair[first[k]]]), *best


def find_copies(images: DataFrame, id_col: str = "image_id", image_col: str = "image", min_inliers: int = 6, max_distance: int = 16, tolerance: float = 4.0, hot_word: int = 256, key_bits: int = 32, recall: float = 0.9) -> DataFrame:
    """``image_a < image_b, inliers, scale, turn, dy, dx``: the transform takes
    places of the first image to places of the second."""
    kind = images.schema[id_col].dataType.simpleString()
    chosen = table_bits(pair_tables(key_bits, max_distance, min_inliers, recall), key_bits)
    masks = np.zeros((len(chosen), BITS), np.uint8)
    np.put_along_axis(masks, chosen, 1, 1)
    masks = np.packbits(masks, axis=1).view("<u8")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for data in batch.column("_image"):
                image = decode(data.as_py())
                p, b = descriptors(image) if image is not None else (np.empty((0, 4)), np.empty((0, 16), np.uint8))
                c = np.empty(len(p), CORNER)
                c["place"], (c["h"], c["l"]) = pack_places(p), np.ascontiguousarray(b).view("<u8").T
                found.append(c.tobytes() or None)
            out = pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(found, pa.binary())], names=["_id", "_c"])
            yield out.filter(out.column("_c").is_valid())

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, held, size = TaskContext.get().partitionId() << 32, [], [], 0

        def close() -> pa.RecordBatch:
            ends = np.cumsum([sum(map(len, versions)) for versions in held])
            values = pa.array(ids, batch.schema.field("_id").type)
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), values)
            data = b"".join(c.tobytes() for versions in held for c in versions)
            return pa.RecordBatch.from_arrays([pa.array([number]), lists, pa.array([ends.astype("<i8").tobytes()], pa.binary()), pa.array([data], pa.binary())], names=["_b", "_ids", "_ends", "_c"])

        for batch in batches:  # in order of the ids
            for k, data in zip(batch.column("_id").to_pylist(), batch.column("_c"), strict=True):
                c = np.frombuffer(data.as_buffer(), CORNER)
                if ids and ids[-1] == k:
                    held[-1].append(c)
                else:
                    if size >= 2048 * hot_word:
                        yield close()
                        number, ids, held, size = number + 1, [], [], 0
                    ids.append(k), held.append([c])
                size += len(c)
        if ids:
            yield close()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                ids_a, ids_b = batch.column("_ids")[r].values, batch.column("_ids_b")[r].values
                (ends_a, ends_b), (a, b) = ([np.frombuffer(batch.column(f"{name}{side}")[r].as_buffer(), dtype) for side in ("", "_b")] for name, dtype in (("_ends", "<i8"), ("_c", CORNER)))
                same = batch.column("_b")[r] == batch.column("_b_b")[r]
                found = list(block_copies(a, b, ends_a, ends_b, same, chosen, masks, max_distance, min_inliers, tolerance))
                if found:
                    i, j, n, *rest = (list(c) for c in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([ids_a.take(pa.array(i)), ids_b.take(pa.array(j)), pa.array(n, pa.int32()), *[pa.array(v, pa.float64()) for v in rest]], names=["image_a", "image_b", "inliers", "scale", "turn", "dy", "dx"])

    entries = images.select(quoted(id_col).alias("_id"), quoted(image_col).alias("_image")).where("_id is not null and _image is not null")
    corners = checkpoint(entries.mapInArrow(describe, f"_id {kind}, _c binary"))
    ordered = corners.repartitionByRange(shuffle_partitions(images.sparkSession), "_id").sortWithinPartitions("_id")
    blocks = checkpoint(ordered.mapInArrow(gather, f"_b bigint, _ids array<{kind}>, _ends binary, _c binary"))
    others = blocks.toDF(*[f"{c}_b" for c in blocks.columns])
    pairs = blocks.hint("shuffle_replicate_nl").join(others, F.col("_b") <= F.col("_b_b"))  # each task reads blocks from the shared folder; nothing is shuffled
    return pairs.mapInArrow(compare, f"image_a {kind}, image_b {kind}, inliers int, scale double, turn double, dy double, dx double")


def draw(vector: np.ndarray, side: int = 96) -> np.ndarray:
    """A textured picture from a vector: a stand-in for media where a table has none."""
    rng = np.random.default_rng(xxhash.xxh3_64_intdigest(np.asarray(vector, np.float32).tobytes()))
    fine, coarse = rng.uniform(0, 150, (side // 5, side // 5)), rng.uniform(0, 105, (side // 16, side // 16))
    return (_resize(fine, side, side) + _resize(coarse, side, side)).astype(np.float32)


def pgm(image: np.ndarray) -> bytes:
    x = np.clip(np.rint(image), 0, 255).astype(np.uint8)
    return b"P5 %d %d 255\n" % (x.shape[1], x.shape[0]) + np.ascontiguousarray(x).tobytes()


def edited(image: np.ndarray, kind: int) -> np.ndarray:
    """A crop, a darker crop, a quarter turn or a smaller copy."""
    if kind == 0:
        return image[10:90, 6:86]
    if kind == 1:
        return 0.8 * image[4:92, 12:96] + 20
    if kind == 2:
        return np.rot90(image)
    return _resize(image, 67, 67)
