"""Cropped and edited copies of images, by local descriptors.

Corners are found at several scales, their number growing with the area; each gets an
orientation from the intensity centroid around it and a string of binary tests at places that turn with it.
The tests are chosen once, from random ones on generated textures, for even and little
correlated bits. Samples of the strings' bits are the keys of Hamming tables, whose joins propose
pairs; a pair is a copy if enough of its matched corners agree on one similarity
transform (geometric consensus), fitted anew to the corners that support it, so
sizes between the scales lose nothing. Images are binary PGM or PPM, or PNG.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import bounded_batches, saved
from corpuslab.llm.grouping import resolve

#: Sizes of the pyramid's pixels, from the image's own; pixels of a level for each of its corners.
SCALES, AREA = tuple(round(2 ** (k / 3), 4) for k in range(-1, 8)), 400
TESTS, TABLES, BITS = 128, 6, 56
#: Shared keys that ask for a pivot first; most differing tests of a match; places that must agree, and one more for so many corners; pixels they may be off.
VOTES, NEAR, AGREE, MORE, OFF = 2, 24, 5, 40, 3.0
RADIUS = 9
DISC = np.argwhere(np.add.outer(np.arange(-RADIUS, RADIUS + 1) ** 2, np.arange(-RADIUS, RADIUS + 1) ** 2) <= RADIUS**2).T - RADIUS


_made: list[tuple[np.ndarray, np.ndarray]] = []


def _use(made: tuple[np.ndarray, np.ndarray]) -> None:
    """Workers take the driver's pattern."""
    _made[:] = [made]


def pattern() -> tuple[np.ndarray, np.ndarray]:
    """The pattern of tests, made at its first use."""
    if not _made:
        _made.append(_choose())
    return _made[0]


def _choose() -> tuple[np.ndarray, np.ndarray]:
    """Places of the binary tests (y, x, y, x), and the tests that each table samples.

    Of random tests those are taken that are even (true for a quarter to three quarters of all corners) and little correlated with the ones taken.
    """
    rng = np.random.default_rng(5)
    tests = rng.uniform(-RADIUS + 1, RADIUS - 1, (3000, 4))
    wide = (np.hypot(tests[:, 0], tests[:, 1]) < RADIUS - 0.5) & (np.hypot(tests[:, 2], tests[:, 3]) < RADIUS - 0.5) & (np.hypot(tests[:, 0] - tests[:, 2], tests[:, 1] - tests[:, 3]) > 2)
    tests = tests[wide]
    seen = []
    for _ in range(40):  # textures of waves of several lengths
        x = sum(resize(rng.uniform(-1, 1, (k, k)), 96, 96) * a for k, a in ((6, 50), (14, 45), (30, 35)))
        x = _blur(_blur(x))
        ys, xs, turn = corners(x, 30)
        seen.append(_tests(x, ys, xs, turn, tests))
    bits = np.concatenate(seen).astype(np.float64)
    mean = bits.mean(axis=0)
    bits = (bits - mean) / np.maximum(np.sqrt(mean * (1 - mean)), 1e-6)
    alike = np.abs(bits.T @ bits) / len(bits)
    order = np.argsort(np.abs(mean - 0.5), kind="stable")
    order = order[: int((np.abs(mean - 0.5) < 0.25).sum())]
    taken: list[int] = []
    for limit in (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 1.1):
        for j in order.tolist():
            if len(taken) < TESTS and j not in taken and (not taken or alike[j, taken].max() < limit):
                taken.append(j)
    sampled = np.stack([rng.permutation(len(taken))[:BITS] for _ in range(TABLES)])
    return tests[taken], sampled


def _png(data: bytes) -> np.ndarray | None:
    """Grey values of a PNG with 8 bits a sample and without interlacing; None for others and damaged ones."""
    at, head, packed, palette = 8, None, [], None
    while at + 12 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        head = body if kind == b"IHDR" else head
        palette = body if kind == b"PLTE" else palette
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    if head is None or len(head) < 13 or head[8] != 8 or head[12] != 0 or head[9] not in (0, 2, 3, 4, 6):
        return None
    width, height, planes = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big"), {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[head[9]]
    row = width * planes
    try:
        raw = zlib.decompressobj().decompress(b"".join(packed), height * (row + 1))
    except zlib.error:
        return None
    if not width or not height or len(raw) < height * (row + 1):
        return None
    lines = np.frombuffer(raw, np.uint8, height * (row + 1)).reshape(height, row + 1)
    out, above = np.empty((height, row), np.uint8), np.zeros(row, np.uint8)
    for y in range(height):
        how, line = lines[y, 0], lines[y, 1:].copy()
        if how == 1:
            line = np.add.accumulate(line.reshape(width, planes), axis=0, dtype=np.uint8).reshape(-1)
        elif how == 2:
            line += above
        elif how in (3, 4):
            now, up = line.tolist(), above.tolist()
            for i in range(row):
                a, b, c = (now[i - planes], up[i], up[i - planes]) if i >= planes else (0, up[i], 0)
                near = (a + b) >> 1 if how == 3 else min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                now[i] = now[i] + near & 255
            line = np.array(now, np.uint8)
        elif how:
            return None
        out[y] = above = line
    pixels = out.reshape(height, width, planes)
    if head[9] == 3:
        colours = np.frombuffer((palette or b"").ljust(768, b"\0")[:768], np.uint8).reshape(256, 3)
        pixels = colours[pixels[:, :, 0]]
    pixels = pixels.astype(np.float32)
    return pixels[:, :, :3] @ np.array([0.299, 0.587, 0.114], np.float32) if pixels.shape[2] > 2 else pixels[:, :, 0]


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey values of a P5, P6 or PNG image with 8 bits a sample; None for anything else, damaged or empty data."""
    if data and data[:8] == b"\x89PNG\r\n\x1a\n":
        return _png(data)
    if not data or data[:2] not in (b"P5", b"P6"):
        return None
    fields, at = [], 2
    while len(fields) < 3 and at < len(data):
        while at < len(data) and data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.find(b"\n", at) + 1 or len(data)
            continue
        end = at
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
        if end == at:
            return None
        fields.append(int(data[at:end]))
        at = end
    width, height, most = [*fields, 0, 0, 0][:3]
    planes = 3 if data[:2] == b"P6" else 1
    at += 1
    if most != 255 or not width or not height or len(data) - at < width * height * planes:
        return None
    pixels = np.frombuffer(data, np.uint8, width * height * planes, at).reshape(height, width, planes).astype(np.float32)
    return pixels @ np.array([0.299, 0.587, 0.114], np.float32) if planes == 3 else pixels[:, :, 0]


def encode(pixels: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + np.clip(pixels, 0, 255).astype(np.uint8).tobytes()


def _blur(x: np.ndarray) -> np.ndarray:
    """Binomial weights along the last two axes; edges stand for what lies beyond them."""
    tall = 2 * x
    tall[..., 1:, :] += x[..., :-1, :]
    tall[..., :-1, :] += x[..., 1:, :]
    tall[..., 0, :] += x[..., 0, :]
    tall[..., -1, :] += x[..., -1, :]
    out = 2 * tall
    out[..., 1:] += tall[..., :-1]
    out[..., :-1] += tall[..., 1:]
    out[..., 0] += tall[..., 0]
    out[..., -1] += tall[..., -1]
    out *= 1 / 16
    return out


def resize(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear."""
    r, c = (np.arange(height) + 0.5) * x.shape[0] / height - 0.5, (np.arange(width) + 0.5) * x.shape[1] / width - 0.5
    r0, c0 = np.clip(np.floor(r).astype(int), 0, x.shape[0] - 1), np.clip(np.floor(c).astype(int), 0, x.shape[1] - 1)
    r1, c1 = np.minimum(r0 + 1, x.shape[0] - 1), np.minimum(c0 + 1, x.shape[1] - 1)
    fr, fc = np.clip(r - r0, 0, 1)[:, None].astype(x.dtype), np.clip(c - c0, 0, 1)[None].astype(x.dtype)
    tall = x[r0] * (1 - fr) + x[r1] * fr
    return tall[:, c0] * (1 - fc) + tall[:, c1] * fc


def corners(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and angles of the strongest corners of a blurred image, far enough from its edge for their tests."""
    margin = RADIUS + 2
    slopes = np.zeros((3, *x.shape), dtype=x.dtype)
    gy, gx = x[2:, 1:-1] - x[:-2, 1:-1], x[1:-1, 2:] - x[1:-1, :-2]
    for out, u, v in zip(slopes[:, 1:-1, 1:-1], (gx, gy, gx), (gx, gy, gy)):
        np.multiply(u, v, out=out)
    a, b, c = _blur(_blur(slopes * x.dtype.type(0.25)))
    strength = a * b - c * c - 0.05 * (a + b) ** 2
    inner = strength[margin:-margin, margin:-margin]
    around = strength[margin - 1 : strength.shape[0] - margin + 1]
    tall = np.maximum(np.maximum(around[:-2], around[1:-1]), around[2:])
    wide = np.maximum(np.maximum(tall[:, margin - 1 : -margin - 1], tall[:, margin:-margin]), tall[:, margin + 1 : tall.shape[1] - margin + 1])
    ys, xs = np.nonzero((inner >= wide) & (inner > 1e-3))
    best = np.argsort(-inner[ys, xs], kind="stable")[:most]
    ys, xs = ys[best] + margin, xs[best] + margin
    patch = x[ys[:, None] + DISC[0], xs[:, None] + DISC[1]]
    return ys, xs, np.arctan2(patch @ DISC[0].astype(x.dtype), patch @ DISC[1].astype(x.dtype))


def _tests(x: np.ndarray, ys: np.ndarray, xs: np.ndarray, angle: np.ndarray, places: np.ndarray) -> np.ndarray:
    cos, sin = np.cos(angle)[:, None], np.sin(angle)[:, None]
    at = lambda i: x[np.rint(ys[:, None] + sin * places[:, i + 1] + cos * places[:, i]).astype(int), np.rint(xs[:, None] + cos * places[:, i + 1] - sin * places[:, i]).astype(int)]
    return at(0) < at(2)


def describe(pixels: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """``(corners, tests)``: x, y, scale and angle of the corners, one for each ``AREA`` pixels of a level at most, and their packed test bits."""
    found, tests = [], []
    least = 2 * RADIUS + 8
    places = pattern()[0]
    for scale in SCALES if pixels is not None else ():
        h, w = int(pixels.shape[0] / scale), int(pixels.shape[1] / scale)
        if min(h, w) < least:
            continue
        x = resize(pixels, h, w) if scale != 1.0 else pixels
        x = _blur(_blur(x.astype(np.float32)))
        ys, xs, turn = corners(x, max(4, (h - least) * (w - least) // AREA))
        if len(ys):
            tests.append(_tests(x, ys, xs, turn, places))
            found.append(np.stack([(xs + 0.5) * pixels.shape[1] / w, (ys + 0.5) * pixels.shape[0] / h, np.full(len(xs), scale), turn], axis=1))
    if not found:
        return np.zeros((0, 4), np.float32), np.zeros((0, TESTS // 8), np.uint8)
    return np.concatenate(found).astype(np.float32), np.packbits(np.concatenate(tests), axis=1)


def table_keys(tests: np.ndarray) -> np.ndarray:
    """Keys of an image's corners in all Hamming tables: the table's number and its sampled bits."""
    if not len(tests):
        return np.zeros(0, dtype=np.int64)
    bits = np.unpackbits(tests, axis=1)[:, pattern()[1]]  # corners x tables x bits
    value = np.zeros(bits.shape[:2], dtype=np.int64)
    for part in np.moveaxis(np.packbits(bits, axis=2), 2, 0):
        value = value << 8 | part
    return np.unique(value + (np.arange(TABLES, dtype=np.int64) << 56))


def pack(corners: np.ndarray, tests: np.ndarray) -> bytes:
    """Corners and tests in 22 bytes each: places as 65,535ths of the largest, numbers of scales, 256ths of a turn."""
    if not len(corners):
        return b""
    unit = np.float32(max(1.0, corners[:, :2].max()) / 65535)
    rows = np.empty((len(corners), 6 + TESTS // 8), np.uint8)
    rows[:, :4] = np.rint(corners[:, :2] / unit).astype(np.uint16).view(np.uint8).reshape(-1, 4)
    rows[:, 4] = np.abs(corners[:, 2:3] - np.array(SCALES, np.float32)).argmin(axis=1)
    rows[:, 5] = np.rint(corners[:, 3] * (128 / np.pi)).astype(int) % 256
    rows[:, 6:] = tests
    return unit.tobytes() + rows.tobytes()


def _unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    if not payload:
        return np.zeros((0, 4)), np.zeros((0, TESTS // 8), np.uint8)
    rows = np.frombuffer(payload, np.uint8, offset=4).reshape(-1, 6 + TESTS // 8)
    corners = np.empty((len(rows), 4))
    corners[:, :2] = rows[:, :4].copy().view(np.uint16) * np.frombuffer(payload, np.float32, 1).astype(float)
    corners[:, 2] = np.array(SCALES)[rows[:, 4]]
    corners[:, 3] = rows[:, 5] * (np.pi / 128)
    return corners, rows[:, 6:].copy()


def same_scene(u: bytes, v: bytes) -> bool:
    """Whether enough matched corners of two images agree on a similarity transform.

    Each match proposes one by its scales and angles; twice, the transform is fitted to the
    matches near it (least squares), which takes it from the pyramid's steps to the true size.
    """
    (ca, ta), (cb, tb) = _unpack(u), _unpack(v)
    least = AGREE + min(len(ca), len(cb)) // MORE
    if min(len(ca), len(cb)) < least:
        return False
    apart = np.bitwise_count(ta[:, None].view(np.uint64) ^ tb[None].view(np.uint64)).sum(axis=2, dtype=np.int32)
    best = apart.argmin(axis=1)
    mine = np.arange(len(ca))
    good = (apart[mine, best] <= NEAR) & (apart.argmin(axis=0)[best] == mine)
    a, b = ca[good], cb[best[good]]
    if len(a) < least:
        return False
    za, zb = a[:, 0] + 1j * a[:, 1], b[:, 0] + 1j * b[:, 1]
    z = b[:, 2] / a[:, 2] * np.exp(1j * (b[:, 3] - a[:, 3]))
    away = np.abs(za[None] - za[:, None])
    off = np.abs(z[:, None] * (za[None] - za[:, None]) + zb[:, None] - zb[None])
    near = off <= OFF * np.maximum(1, np.abs(z))[:, None] * 1.5 + 0.2 * np.abs(z)[:, None] * away
    for loose in (2.0, 1.0):
        n = np.maximum(near.sum(axis=1), 1)
        ma, mb = near @ za / n, near @ zb / n
        top = near @ (np.conj(za) * zb) - n * np.conj(ma) * mb
        z = top / np.maximum(near @ (np.abs(za) ** 2) - n * np.abs(ma) ** 2, 1e-9)
        off = np.abs(z[:, None] * (za[None] - ma[:, None]) + mb[:, None] - zb[None])
        size = np.abs(z)
        near = (off <= loose * OFF * np.maximum(1, size)[:, None]) & ((size > 0.1) & (size < 10))[:, None]
    most = int(near.sum(axis=1).argmax())
    # one corner can answer at several scales: places count, not matches
    cell = lambda p: len(np.unique(np.rint(p[near[most]] / 4)))
    return bool(min(cell(za), cell(zb)) >= least)


def same_scenes(us: list[bytes], vs: list[bytes], rows: int = 16) -> np.ndarray:
    """The matrix of :func:`same_scene`; pairs without enough corners that are near any of the other's can't match and aren't aligned."""
    out = np.zeros((len(us), len(vs)), dtype=bool)
    signs = lambda tests: np.unpackbits(np.concatenate(tests), axis=1).astype(np.float32) * 2 - 1
    mine, theirs = [_unpack(u)[1] for u in us], [_unpack(v)[1] for v in vs]
    some = [j for j, t in enumerate(theirs) if len(t)]
    if not some:
        return out
    other = signs([theirs[j] for j in some])
    starts = np.cumsum([0, *(len(theirs[j]) for j in some[:-1])])
    for lo in range(0, len(us), rows):
        here = [i for i in range(lo, min(lo + rows, len(us))) if len(mine[i])]
        if not here:
            continue
        near = signs([mine[i] for i in here]) @ other.T >= TESTS - 2 * NEAR
        near = np.logical_or.reduceat(near, starts, axis=1)
        count = np.add.reduceat(near.astype(np.int32), np.cumsum([0, *(len(mine[i]) for i in here[:-1])]), axis=0)
        for a, b in np.argwhere(count >= AGREE).tolist():
            out[here[a], some[b]] = same_scene(us[here[a]], vs[some[b]])
    return out


def image_copies(images: DataFrame) -> DataFrame:
    """``(id, n_corners, component_id, kept)``, a row for each row of ``images(id, image)``.

    Copies, directly or through others, share the smallest id; equal bytes are always
    copies. Null, empty, damaged or flat images have no corners and are copies of
    equal bytes only; null images of nothing. Rows that repeat each get their row. Null ids take part but name a
    component only if it has no other; other columns are ignored. Images that share ``VOTES`` keys with a
    pivot of theirs are compared, and in buckets too large for pivots to meet all pairs all that share the
    key, in blocks, unless they are already of one class.
    """
    bounded_batches(images.sparkSession)
    images = images.select("id", "image")
    kind = images.schema["id"].dataType.simpleString()
    def run(parts, made=pattern()):
        _use(made)
        for pdf in parts:
            rows = []
            for data in pdf["image"]:
                corners, tests = describe(decode(bytes(data) if data is not None else None))
                digest = hashlib.blake2b(bytes(data), digest_size=16).digest() if data is not None else None
                rows.append((len(corners), digest, pack(corners, tests)))
            out = pd.DataFrame(rows, columns=["n_corners", "digest", "payload"])
            yield out.assign(own=pdf["id"].array)[["own", "n_corners", "digest", "payload"]]

    def keyed(parts, made=pattern()):
        _use(made)
        for pdf in parts:
            yield pd.DataFrame({"id": pdf["id"], "keys": [table_keys(_unpack(p)[1]) for p in pdf["payload"]]})

    found = saved(images.mapInPandas(run, f"own {kind}, n_corners long, digest binary, payload binary"), "corners")
    # equal bytes are one image, with a short number that the written table fixes
    classes = found.where("digest is not null").groupBy("digest").agg(F.min("own").alias("least"), F.first("payload").alias("payload"))
    classes = saved(classes.withColumn("id", F.monotonically_increasing_id()), "images")
    one = classes.where("payload <> X''").select("id", "payload")
    buckets = one.mapInPandas(keyed, "id long, keys array<long>").select(F.explode("keys").alias("key"), "id")

    pairs = lambda us, vs: [same_scene(u, v) for u, v in zip(us, vs)]
    roots = resolve(buckets, one, pairs, same_scenes, votes=VOTES)
    named = saved(roots.join(classes.select("id", "least"), "id").groupBy("root").agg(F.min("least").alias("named")), "groups")
    names = classes.select("digest", "id", "least").join(roots.join(named, "root").select("id", "named"), "id", "left")
    names = saved(names.select("digest", F.coalesce("named", "least").alias("named")), "names")
    out = found.select("own", "n_corners", "digest").join(names, "digest", "left")
    component = F.coalesce("named", "own")
    return out.select(F.col("own").alias("id"), "n_corners", component.alias("component_id"), F.col("own").eqNullSafe(component).alias("kept"))


def render(number: int) -> bytes:
    """A test image for a row: of four rows in sequence, a scene, a crop of it, an edited copy of it, and a scene of its own."""
    kind = number % 4
    rng = np.random.default_rng([number // 4, kind == 3])
    scene = sum(resize(rng.uniform(-1, 1, (k, k)), 96, 96) * a for k, a in ((6, 50), (14, 45), (30, 35))) + 128
    if kind == 1:
        top, left = rng.integers(2, 14, 2)
        scene = scene[top : top + 80, left : left + 80]
    elif kind == 2:
        scene = 0.85 * scene + 12 + rng.normal(0, 1.5, scene.shape)
        scene[4:16, 60:92] = 240
    return encode(scene)


def rendered(rows: DataFrame, column: str) -> DataFrame:
    """``(id, image)``: the tables at hand hold no media, so each row of ``rows`` gets its :func:`render`."""

    def run(parts):
        for pdf in parts:
            yield pd.DataFrame({"id": pdf["id"], "image": [render(int(i)) if i == i and i is not None else None for i in pdf["id"]]})

    return rows.select(F.col(column).cast("long").alias("id")).mapInPandas(run, "id long, image binary")
