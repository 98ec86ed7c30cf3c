"""Copy detection among images by local descriptors.

A decoder turns a column into grey images (binary PGM, or rendered numbers).  Corners are found at scales a
quarter of an octave apart, down to the smallest that holds a patch: every place whose corner response is
the largest within REACH pixels, so their number follows the image's area and no limit cuts it.  Each gets
an orientation and a string of binary brightness tests turned with it.

Descriptors meet in Hamming tables: a descriptor is cut into CHUNKS keys, and descriptors that share a key
are compared bit by bit.  A pair of images is linked when SEEDS of its corners within SEED_BITS bits agree on
one turn, scale and shift and, all corners compared, MIN_MATCHES within MAX_BITS do, and at least MIN_SHARE
of the query's corners.  Tables miss a pair of corners only if each of its keys has a differing bit, and a pair of images only if all but one of its seeds
are missed; ``radius=1`` also looks up all keys that differ in one bit, which meets every pair of corners
within 2 CHUNKS - 1 = SEED_BITS bits, so that no link is missed.

Equal images are one class, described once, and pairs are between class representatives, so a group of
copies costs as much as one image.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm import scratch

SIDE = 96
#: Ratio of neighbouring scales, pixels within which a corner is the largest, its least response, and the patch's radius and margin.
STEP, REACH, RESPONSE, PATCH, MARGIN = 2 ** (1 / 4), 3, 50.0, 12, 13
TESTS, CHUNKS, TURNS = 256, 16, 64
#: Bits in which seeds (matches that tables find) differ at most, and seeds that must agree.
SEED_BITS, SEEDS = 31, 2
#: Bits in which matches differ at most when all corners are compared, matches that must agree, and their least share of the query's corners.
MAX_BITS, MIN_MATCHES, MIN_SHARE = 40, 4, 0.1
#: Bins of the consensus: turn (parts of a circle), scale (steps), shift in pixels.
TURN_BINS, SCALE_BIN, SHIFT_BIN = 16, 2, 24.0
#: Base corners and query images that meet at once, pairs compared at once, query corners of a block, rows of an image at once.
BASE_BLOCK, QUERY_IMAGES, PAIRS_AT_ONCE, QUERY_BLOCK, STRIP = 1 << 17, 32, 1 << 20, 1 << 17, 512
#: A corner: its place and direction in the image, its level of scale, its descriptor.
FEATURE = np.dtype([("x", "<f4"), ("y", "<f4"), ("angle", "<f4"), ("level", "<i4"), ("bits", "<u8", TESTS // 64)])


def _dealt(points: np.ndarray) -> np.ndarray:
    """An order of the tests in which those of a key say different things.

    How alike two tests are is worked out for a random image that is smooth over some pixels; a key takes,
    one after the other, the tests least like those it has.
    """
    def near(a, b):
        return np.exp(-((a[:, None] - b[None]) ** 2).sum(-1) / 32)

    a, b = points[:, 0], points[:, 1]
    like = near(a, a) + near(b, b) - near(a, b) - near(b, a)
    like = (like / np.sqrt(np.outer(like.diagonal(), like.diagonal()))) ** 2
    left, order = list(range(len(points))), []
    for _ in range(CHUNKS):
        key = [left.pop(0)]
        while len(key) < TESTS // CHUNKS:
            key.append(left.pop(int(like[np.ix_(left, key)].sum(1).argmin())))
        order += key
    return np.array(order)


def _pattern() -> np.ndarray:
    """(TURNS, TESTS, 2, 2): offsets (y, x) of each test's two points, for each turn.

    Points are spread evenly over a disc; of the pairs drawn those are tests whose points lie apart and
    not mainly along the patch's direction, which would say beforehand which of them is brighter.
    """
    rng = np.random.default_rng(5)
    r, t = PATCH * np.sqrt(rng.random((4 * TESTS, 2))), 2 * np.pi * rng.random((4 * TESTS, 2))
    points = np.stack([r * np.sin(t), r * np.cos(t)], -1)
    apart = np.abs(points[:, 0] - points[:, 1])
    points = points[(apart[:, 1] <= 2 * apart[:, 0]) & (apart.sum(1) >= 4)][:TESTS]
    points = points[_dealt(points)]
    a = np.arange(TURNS) * 2 * np.pi / TURNS
    turn = np.stack([np.stack([np.cos(a), np.sin(a)], -1), np.stack([-np.sin(a), np.cos(a)], -1)], 1)  # (y, x) by the angle from x to y
    return np.rint(np.einsum("tij,spj->tspi", turn, points)).astype(np.int64)


PATTERN = _pattern()
_Y, _X = np.mgrid[-8:9, -8:9]
_DISC = (_Y**2 + _X**2 <= 64).astype(np.float32)


def _over(x: np.ndarray, r: int, combine, fill: float) -> np.ndarray:
    """``combine`` over (2r + 1)-squares, with ``fill`` beyond the edges."""
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (r, r)
        y, n = np.pad(x, pad, constant_values=fill), x.shape[axis]
        x = reduce(combine, (y[:, i : i + n] if axis == 1 else y[:, :, i : i + n] for i in range(2 * r + 1)))
    return x


def _shrink(x: np.ndarray, f: float) -> np.ndarray:
    """Images ``f`` times smaller, by triangular weights."""
    for axis in (1, 2):
        n = x.shape[axis]
        m = max(1, round(n / f))
        centre = (np.arange(m) + 0.5) * n / m - 0.5
        at = np.floor(centre - f).astype(int)[:, None] + 1 + np.arange(int(np.ceil(2 * f)))
        w = np.maximum(0, 1 - np.abs(at - centre[:, None]) / f)
        w, at = (w / w.sum(1, keepdims=True)).astype(np.float32), np.clip(at, 0, n - 1)
        shape = [1, 1, 1]
        shape[axis] = m
        x = sum(np.take(x, at[:, t], axis) * w[:, t].reshape(shape) for t in range(at.shape[1]))
    return x


def _strip(level: np.ndarray, first: int, last: int) -> tuple[np.ndarray, ...]:
    """(image, x, y, angle, descriptor) of the corners in rows [first, last) of images of one scale."""
    low = max(0, first - MARGIN - REACH - 4)
    rows = level[:, low : last + MARGIN + REACH + 4]
    n, h, w = rows.shape
    soft = _over(rows, 1, np.add, 0.0) / 9
    gy, gx = np.zeros_like(soft), np.zeros_like(soft)
    gy[:, 1:-1], gx[:, :, 1:-1] = soft[:, 2:] - soft[:, :-2], soft[:, :, 2:] - soft[:, :, :-2]
    a, b, c = (_over(x, 2, np.add, 0.0) for x in (gx * gx, gy * gy, gx * gy))
    response = a * b - c * c - 0.05 * (a + b) ** 2
    peak = (response > RESPONSE) & (response >= _over(response, REACH, np.maximum, -np.inf))
    image, y, x = np.nonzero(peak[:, first - low : last - low, MARGIN : w - MARGIN])
    y, x = y + first - low, x + MARGIN
    patch = soft[image[:, None, None], y[:, None, None] + _Y, x[:, None, None] + _X] * _DISC
    angle = np.arctan2((patch * _Y).sum((1, 2)), (patch * _X).sum((1, 2)))
    o = PATTERN[np.rint(angle * TURNS / (2 * np.pi)).astype(int) % TURNS]
    softer = _over(rows, 2, np.add, 0.0)
    p = softer[image[:, None, None], y[:, None, None] + o[..., 0], x[:, None, None] + o[..., 1]]
    bits = np.packbits(p[..., 0] < p[..., 1], axis=1, bitorder="little").view("<u8").reshape(-1, TESTS // 64)
    return image, x, y + low, angle, bits


def describe(images: np.ndarray) -> list[np.ndarray]:
    """The corners (FEATURE records) of each of the images (n, height, width) of one size.

    Of equal responses within REACH each is a corner.  Flat images, and those too small for a patch, have
    none.  A large image is worked on by strips; it is held as single floats and so are its strips.
    """
    level, height = images.astype(np.float32), images.shape[1]
    found: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    k = 0
    while min(level.shape[1:]) > 2 * MARGIN:
        h, w = level.shape[1:]
        for at in range(MARGIN, h - MARGIN, STRIP):
            image, x, y, angle, bits = _strip(level, at, min(at + STRIP, h - MARGIN))
            f = np.zeros(len(image), FEATURE)
            f["x"], f["y"], f["angle"], f["level"], f["bits"] = (x + 0.5) * (images.shape[2] / w), (y + 0.5) * (height / h), angle, k, bits
            found.append(f)
            owner.append(image)
        level = _shrink(level, STEP)
        k += 1
    f = np.concatenate(found) if found else np.zeros(0, FEATURE)
    image = np.concatenate(owner) if owner else np.zeros(0, int)
    order = np.argsort(image, kind="stable")
    return np.split(f[order], np.searchsorted(image[order], np.arange(1, len(images))))


def _waves() -> np.ndarray:
    """(64, SIDE, SIDE): plane waves that a 64-number vector is rendered with."""
    t = (np.arange(SIDE) + 0.5) / SIDE
    f = np.cos(np.pi * np.outer(np.arange(2, 18, 2), t))
    return np.einsum("ay,bx->abyx", f, f).reshape(64, SIDE, SIDE)


WAVES = _waves()


def render(vectors: np.ndarray) -> np.ndarray:
    """Grey images (n, SIDE, SIDE) of 64-number vectors, 0 to 255: what stands in for media where a table has none."""
    x = np.tensordot(vectors, WAVES, 1)
    return np.clip(np.rint(128 + 60 * x), 0, 255).astype(np.uint8)


#: Turns a column into grey images, or None where there is none.
Decoder = Callable[[pa.Array], list[np.ndarray | None]]


def decode_numbers(column: pa.Array) -> list[np.ndarray | None]:
    """Images rendered from lists of 64 numbers; NaN counts as 0, other lists have no image."""
    rows = column.to_pylist()
    good = [i for i, v in enumerate(rows) if v is not None and len(v) == 64 and None not in v]
    out: list[np.ndarray | None] = [None] * len(rows)
    for at in range(0, len(good), 256):
        part = good[at : at + 256]
        for i, image in zip(part, render(np.nan_to_num(np.array([rows[i] for i in part], float)))):
            out[i] = image
    return out


_PGM = re.compile(rb"P5(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s")


def decode_pgm(column: pa.Array) -> list[np.ndarray | None]:
    """Images of binary PGM files of at most 255 grey levels; anything else has no image."""
    out: list[np.ndarray | None] = []
    for blob in column.to_pylist():
        m = _PGM.match(blob[:1024]) if blob else None
        w, h, most = map(int, m.groups()) if m else (0, 0, 0)
        whole = m and w and h and 0 < most < 256 and len(blob) - m.end() >= w * h
        out.append(np.frombuffer(blob, np.uint8, w * h, m.end()).reshape(h, w) if whole else None)
    return out


def _sample(image: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Brightness between pixels, by bilinear weights."""
    h, w = image.shape
    y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    y0, x0 = np.minimum(y.astype(int), max(h - 2, 0)), np.minimum(x.astype(int), max(w - 2, 0))
    y1, x1, fy, fx = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1), y - y0, x - x0
    return (image[y0, x0] * (1 - fx) + image[y0, x1] * fx) * (1 - fy) + (image[y1, x0] * (1 - fx) + image[y1, x1] * fx) * fy


def turned(image: np.ndarray, degrees: float, scale: float = 1.0) -> np.ndarray:
    """The image turned about its centre and ``scale`` times as large; what lies beyond its edge repeats the edge."""
    if scale < 1:
        image, scale = _shrink(image[None].astype(np.float32), 1 / scale)[0], 1.0
    h, w = image.shape
    a = np.deg2rad(degrees)
    y, x = np.mgrid[: round(h * scale), : round(w * scale)]
    y, x = (y + 0.5) / scale - h / 2, (x + 0.5) / scale - w / 2
    return _sample(image.astype(float), np.cos(a) * y - np.sin(a) * x + h / 2 - 0.5, np.sin(a) * y + np.cos(a) * x + w / 2 - 0.5)


def coarsened(image: np.ndarray, step: float) -> np.ndarray:
    """The image after its 8 x 8 blocks' cosine transforms are rounded to steps that grow with frequency, as lossy files do."""
    k = np.arange(8)
    c = np.cos(np.pi * np.outer(k, 2 * k + 1) / 16) / 2
    c[0] /= np.sqrt(2)
    h, w = (-(-n // 8) * 8 for n in image.shape)
    x = np.pad(image.astype(float), ((0, h - image.shape[0]), (0, w - image.shape[1])), "edge").reshape(h // 8, 8, w // 8, 8).transpose(0, 2, 1, 3)
    steps = step * (1 + np.add.outer(k, k))
    return (c.T @ (np.rint(c @ x @ c.T / steps) * steps) @ c).transpose(0, 2, 1, 3).reshape(h, w)[: image.shape[0], : image.shape[1]]


def cropped(image: np.ndarray, share: float, r: int) -> np.ndarray:
    """A window of ``share`` of each side; where hangs on ``r``."""
    h, w = (max(1, int(n * share)) for n in image.shape)
    y, x = r % (image.shape[0] - h + 1), (r >> 8) % (image.shape[1] - w + 1)
    return image[y : y + h, x : x + w]


#: Kinds of edits, of which an id takes one.
EDITS: dict[str, Callable[[np.ndarray, int], np.ndarray]] = {
    "cropped, turned by quarters, paler": lambda x, r: np.rot90(cropped(x, 0.8, r), (r >> 5) % 4) * 0.8 + 20,
    "turned by 5 to 30 degrees": lambda x, r: turned(x, 5 + r % 26),
    "0.7 to 1.4 times as large": lambda x, r: turned(x, 0, 0.7 + r % 71 / 100),
    "noisy": lambda x, r: x + np.random.default_rng(r).normal(0, 4, x.shape),
    "coarsened": lambda x, r: coarsened(x, 3 + r % 4),
    "cropped to six tenths": lambda x, r: cropped(x, 0.6, r),
    "turned, resized, cropped and coarsened": lambda x, r: coarsened(cropped(turned(x, 5 + r % 26, 0.8 + r % 41 / 100), 0.8, r), 2),
}


def edited(image: np.ndarray, ident: int) -> np.ndarray:
    """An edited copy of an image; how hangs on the id."""
    r = (ident * 0x9E3779B97F4A7C15 % (1 << 64)) >> 40
    edit = list(EDITS.values())[(r >> 16) % len(EDITS)]
    return np.clip(np.rint(edit(image, r)), 0, 255).astype(np.uint8)


def _digest(decode: Decoder):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                found = [(i, hashlib.sha256(repr(x.shape).encode() + x.tobytes()).digest()) for i, x in zip(part.column(0).to_pylist(), decode(part.column(1))) if x is not None]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([d for _, d in found], pa.binary())], names=["id", "digest"])

    return run


CORNERS = "id long, height int, width int, corners binary"


def _corners(decode: Decoder, edit: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 32):
                part = b.slice(at, 32)
                by_shape: dict[tuple, list] = {}
                for i, x in zip(part.column(0).to_pylist(), decode(part.column(1))):
                    if x is not None:
                        x = edited(x, i) if edit else x
                        by_shape.setdefault(x.shape, []).append((i, x))
                for (height, width), group in by_shape.items():
                    found = describe(np.stack([x for _, x in group]))
                    ids, n = pa.array([i for i, _ in group], pa.int64()), len(group)
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array([height] * n, pa.int32()), pa.array([width] * n, pa.int32()), pa.array([f.tobytes() for f in found], pa.binary())],
                        names=[c.split()[0] for c in CORNERS.split(", ")])

    return run


def corners(images: DataFrame, decode: Decoder = decode_numbers, edit: bool = False) -> DataFrame:
    """The corners of (id, media) rows, a row an image, of their images or of edited copies of them."""
    return images.select("id", "media").mapInArrow(_corners(decode, edit), CORNERS)


def _media(table: DataFrame, id_col: str, media_col: str) -> DataFrame:
    return table.selectExpr(f"cast(`{id_col}` as long) as id", f"`{media_col}` as media")


def classes(table: DataFrame, id_col: str = "vec_id", media_col: str = "embedding", decode: Decoder = decode_numbers) -> DataFrame:
    """(id, class_id): rows with equal images share the smallest id; rows without an image have no row here."""
    rows = scratch.write(_media(table, id_col, media_col).mapInArrow(_digest(decode), "id long, digest binary"), "image-digests")
    first = rows.groupBy("digest").agg(F.min("id").alias("class_id"))
    return scratch.write(rows.join(first, "digest").select("id", "class_id"), "image-classes")


class Images:
    """The corners of some images, one image behind the other."""

    def __init__(self, table: pa.Table | pa.RecordBatch):
        self.id = table.column("id").to_numpy()
        parts = [np.frombuffer(x, FEATURE) for x in table.column("corners").to_pylist()]
        size = np.array([len(p) for p in parts], np.int64)
        self.corner = np.concatenate(parts) if parts else np.zeros(0, FEATURE)
        self.bits = np.ascontiguousarray(self.corner["bits"])
        self.end = np.cumsum(size)
        self.start = self.end - size
        self.image = np.repeat(np.arange(len(size)), size)
        self.cx = table.column("width").to_numpy() / 2
        self.cy = table.column("height").to_numpy() / 2


class Tables:
    """A Hamming table for each key of the descriptors of some images."""

    def __init__(self, bits: np.ndarray):
        self.words = np.ascontiguousarray(bits.T)
        keys = bits.view("<u2")
        self.order = [np.argsort(keys[:, c], kind="stable").astype(np.int32) for c in range(CHUNKS)]
        self.first = [np.concatenate(([0], np.cumsum(np.bincount(keys[:, c], minlength=1 << 16)))) for c in range(CHUNKS)]

    def near(self, ask: np.ndarray, max_bits: int = SEED_BITS, radius: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, own) rows of pairs of descriptors that differ in at most ``max_bits`` bits and at most ``radius`` (0 or 1) bits of some key; each pair once."""
        keys = ask.view("<u2")
        words = np.ascontiguousarray(ask.T)
        masks = np.array([0, *(1 << i for i in range(16) if radius)], np.int64)
        row = np.repeat(np.arange(len(ask), dtype=np.int32), len(masks))
        for c in range(CHUNKS):
            probes = (keys[:, c, None] ^ masks).ravel()
            low = self.first[c][probes]
            n = self.first[c][probes + 1] - low
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            for at in range(0, total, PAIRS_AT_ONCE):
                stop = min(at + PAIRS_AT_ONCE, total)
                # the probes that these pairs belong to, and how many of each
                p, q = np.searchsorted(ends, [at, stop - 1], "right")
                some = slice(p, q + 1)
                size = np.minimum(ends[some], stop) - np.maximum(ends[some] - n[some], at)
                i = np.repeat(row[some], size)
                j = self.order[c][np.repeat(low[some] + n[some] - ends[some], size) + np.arange(at, stop)]
                differ = np.zeros(len(i), np.uint8)
                for w, (x, y) in enumerate(zip(words, self.words)):
                    differ += np.bitwise_count(x.take(i) ^ y.take(j))
                    if w % 2:
                        good = np.flatnonzero(differ <= max_bits)
                        i, j, differ = i[good], j[good], differ[good]
                # met under an earlier key
                apart = (words[:, i] ^ self.words[:, j]).T.copy().view("<u2")
                new = ~(np.bitwise_count(apart[:, :c]) <= radius).any(1)
                if new.any():
                    yield i[new].astype(np.int64), j[new].astype(np.int64)


def _votes(q: Images, b: Images, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query image, base image, query corners in the fullest bin) of the image pairs that the corner pairs (i, j) belong to."""
    qf, bf = q.corner[i], b.corner[j]
    qi, bi = q.image[i], b.image[j]
    steps = bf["level"] - qf["level"]
    scale, turn = STEP ** steps.astype(float), (bf["angle"] - qf["angle"]).astype(float)
    dx, dy = qf["x"] - q.cx[qi], qf["y"] - q.cy[qi]
    # where the query's centre would lie in the other image
    ox = bf["x"] - scale * (np.cos(turn) * dx - np.sin(turn) * dy)
    oy = bf["y"] - scale * (np.sin(turn) * dx + np.cos(turn) * dy)
    pair, place = np.unique(qi * len(b.id) + bi, return_inverse=True)
    most = np.zeros(len(pair), np.int64)
    # bins twice on each axis, half a bin apart, so that no agreement is cut by an edge
    for t in (0.0, 0.5):
        turns = np.floor(turn * TURN_BINS / (2 * np.pi) + t).astype(np.int64) % TURN_BINS
        for k in range(SCALE_BIN):
            scales = (steps + k) // SCALE_BIN
            for h in range(4):
                xs, ys = np.floor(ox / SHIFT_BIN + h % 2 / 2).astype(np.int64), np.floor(oy / SHIFT_BIN + h // 2 / 2).astype(np.int64)
                bins = np.stack([place, turns, scales, xs, ys, i])
                order = np.lexsort(bins[::-1])
                bins = bins[:, order]
                other = np.ones(bins.shape[1], bool)
                other[1:] = (bins[:5, 1:] != bins[:5, :-1]).any(0)
                fresh = other.copy()
                fresh[1:] |= bins[5, 1:] != bins[5, :-1]  # a corner counts once in a bin
                first = np.flatnonzero(other)
                np.maximum.at(most, bins[0, first], np.add.reduceat(fresh, first, dtype=np.int64) if len(first) else first)
    return pair // len(b.id), pair % len(b.id), most


def _several(image: np.ndarray, other: np.ndarray, n: int, corner: np.ndarray) -> np.ndarray:
    """Whether each pair's two images also meet at another corner of the first."""
    pair, place = np.unique(image * n + other, return_inverse=True)
    low, high = np.full(len(pair), np.iinfo(np.int64).max), np.full(len(pair), -1)
    np.minimum.at(low, place, corner)
    np.maximum.at(high, place, corner)
    return (low < high)[place]


def linked(q: Images, b: Images, tables: Tables, max_bits: int = MAX_BITS, min_matches: int = MIN_MATCHES, min_share: float = MIN_SHARE, radius: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query id, base id, matches) of the pairs of images whose corners agree on one shift, turn and scale."""
    for at in range(0, len(q.id), QUERY_IMAGES):
        last = min(at + QUERY_IMAGES, len(q.id))
        a, z = int(q.start[at]), int(q.end[last - 1])
        met = list(tables.near(q.bits[a:z], min(SEED_BITS, max_bits), radius))
        if not met:
            continue
        i, j = (np.concatenate(x) for x in zip(*met))
        i = i + a
        some = _several(q.image[i], b.image[j], len(b.id), i)
        if not some.any():
            continue
        qi, bi, n = _votes(q, b, i[some], j[some])
        seeded = np.flatnonzero(n >= SEEDS)
        for k in range(0, len(seeded), 256):
            rows, cols = [], []
            for u, v in zip(qi[seeded[k : k + 256]].tolist(), bi[seeded[k : k + 256]].tolist()):
                d = np.bitwise_count(q.bits[q.start[u] : q.end[u], None] ^ b.bits[None, b.start[v] : b.end[v]]).sum(2, dtype=np.int64)
                r, c = np.nonzero(d <= max_bits)
                rows.append(r + q.start[u])
                cols.append(c + b.start[v])
            if rows:
                u, v, n = _votes(q, b, np.concatenate(rows), np.concatenate(cols))
                good = n >= np.maximum(min_matches, min_share * (q.end - q.start)[u])
                yield q.id[u[good]], b.id[v[good]], n[good]


def _query_blocks(queries: DataFrame) -> Iterator[pa.Table]:
    """Query images in blocks of about QUERY_BLOCK corners, by ranges of ids."""
    total = queries.agg(F.sum(F.octet_length("corners"))).first()[0] or 0
    blocks = -(-total // (QUERY_BLOCK * FEATURE.itemsize))
    edges = [] if blocks < 2 else sorted(set(queries.select(F.percentile_approx("id", [i / blocks for i in range(1, blocks)], 10_000)).first()[0]))
    for low, high in zip([None, *edges], [*edges, None]):
        part = queries if low is None else queries.filter(F.col("id") > low)
        block = (part if high is None else part.filter(F.col("id") <= high)).toArrow()
        if block.num_rows:
            yield block


LINK = "query_id long, match_id long, matches long"


def _meet(shared, *options):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = Images(shared.value)

        def meet(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            base = Images(pa.Table.from_batches(parts).combine_chunks())
            for columns in linked(ask, base, Tables(base.bits), *options):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=[c.split()[0] for c in LINK.split(", ")])

        waiting, held = [], 0
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                waiting.append(part)
                held += sum(len(x) for x in part.column(3).to_pylist())
                if held >= BASE_BLOCK * FEATURE.itemsize:
                    yield from meet(waiting)
                    waiting, held = [], 0
        if waiting:
            yield from meet(waiting)

    return run


def match(queries: DataFrame, base: DataFrame, max_bits: int = MAX_BITS, min_matches: int = MIN_MATCHES, min_share: float = MIN_SHARE, radius: int = 0) -> DataFrame:
    """(query_id, match_id, matches) of images whose corners agree on one shift, turn and scale.

    Corner tables as ``corners`` makes them.  ``matches`` counts the query's corners in the fullest bin.
    Base corners stay where they are read.  Query images go to every task in blocks of bounded size, one
    block after the other: the driver holds one, and what a block finds is written before the next.
    """
    spark = base.sparkSession
    out = scratch.new_path(spark, "image-links")
    spark.createDataFrame([], LINK).write.parquet(out)
    for block in _query_blocks(queries):
        shared = spark.sparkContext.broadcast(block)
        base.mapInArrow(_meet(shared, max_bits, min_matches, min_share, radius), LINK).write.mode("append").parquet(out)
        shared.unpersist()
    return spark.read.schema(LINK).parquet(out)


def find_copies(table: DataFrame, id_col: str = "vec_id", media_col: str = "embedding", decode: Decoder = decode_numbers, every: int = 50, radius: int = 0) -> DataFrame:
    """query_id, class_id, n_links and links (match_id, matches) of each query: an edited copy of every row whose id is divisible by ``every``.

    All rows are searched.  Links name class representatives, most matches first, then the smallest id;
    ``classes`` has the members.  Rows whose media the decoder cannot read (null, another size or format)
    have no image and no row; a null id is no query, and its image is searched only under another id that
    has it.  Images without corners link to nothing.  Repeated rows are in one class.  An empty table gives
    an empty result.
    """
    member = classes(table, id_col, media_col, decode)
    rows = _media(table, id_col, media_col).filter("id is not null")
    copies = scratch.lookup(scratch.write(member.filter("id <> class_id").select(F.col("id").alias("_id")).distinct(), "image-copies"))
    base = scratch.write(corners(rows.join(copies, rows["id"] == copies["_id"], "left_anti"), decode), "corners")
    is_query = F.col("id") % every == 0
    asked, ask = member.filter(is_query).distinct(), scratch.write(corners(rows.filter(is_query), decode, edit=True), "query-corners")
    pairs = match(ask, base, radius=radius).groupBy("query_id", "match_id").agg(F.max("matches").alias("matches"))  # of repeated rows
    found = pairs.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("matches")).alias("n"), "match_id"))).alias("l"))
    links = F.transform("l", lambda x: F.struct(x["match_id"].alias("match_id"), (-x["n"]).alias("matches")))
    return asked.join(found, asked["id"] == found["query_id"], "left").select(
        F.col("id").alias("query_id"), "class_id", F.coalesce(F.size("l"), F.lit(0)).cast("long").alias("n_links"), F.coalesce(links, F.array().cast("array<struct<match_id: bigint, matches: bigint>>")).alias("links"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_copies(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
