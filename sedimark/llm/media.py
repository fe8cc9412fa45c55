"""Copies of images by local descriptors: corners, binary tests, Hamming tables, geometry.

Images are grey and in the media column as PGM bytes (P5, 8 bits). Corners (Harris) are found at
three scales: all local maxima above a fixed strength; the centroid of the grey values around a
corner gives its direction; 128 comparisons of two smoothed pixels each, turned by that
direction, give its descriptor. Which comparisons is learned once, on the driver, from made-up
pictures: such as split corners evenly and agree with each other little.

Search. A descriptor is entered in 40 tables: its bits are put in three fixed orders, and each
order has eight windows of a fixed width. Whether two images are linked depends on them alone, not
on how many others there are. In the order in which the tests were chosen late bits agree with each
other more than early ones, so that some windows tell little apart; in a shuffled order all
windows are alike. What meets by chance still grows with the product of queries and stored corners;
beyond the corners for which `_width` gives the width this is logged. An
entry is a key and the name of its corner; a bitmap of the queries' keys, of a fixed size, leaves
out stored entries that no query can meet (where it fills up it only saves less). Corners that meet are looked up once and compared in full (at most
`radius` different bits); a match says how the query image would have to be turned, scaled and
moved. Matches of two images that agree in this, in overlapping cells, are counted by distinct
query corners; enough of them make a copy, cropped or edited as it may be.

Equal images are one class, on both sides, named by its smallest id: corners are entered once a
class and links are between classes, with membership beside them. So a third of all rows being
one image costs nothing more, and no group of copies is expanded into pairs.

The tables find a descriptor with a tenth of its bits changed in half of all cases or less, and
an image needs few of its descriptors; tests hold the result against comparing all descriptors.

Edge cases. Null, broken or empty images and images under 32 pixels: no corners, no class, never
matched. Flat images: the same. Null id: neither asked for nor reported. Repeated rows: one
result for an id; an id with two different images is in two classes. Ties: none, all links are
returned. Empty input: empty result. Other columns are ignored.
"""

from __future__ import annotations

import functools
import logging
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.llm.common import arrow_limits, written

log = logging.getLogger(__name__)

SCALES = (1.0, 1.4, 2.0)
TESTS, TURNS, REACH = 128, 32, 11
POOL = 1500  # comparisons of which the tests are chosen
_DISC = np.array([(y, x) for y in range(-7, 8) for x in range(-7, 8) if y * y + x * x <= 50])
_HEAD = re.compile(rb"P5\s+(\d+)\s+(\d+)\s+255\s")
#: log2 of the bits of the bitmap of the queries' keys.
BITMAP = 27
#: Bits of a window, whatever the input.
WIDTH = 44
#: In how many orders the bits of a descriptor are cut into windows.
ORDERS = 5
CORNER = "x float, y float, scale float, angle float, d0 bigint, d1 bigint"


def encode(pixels: np.ndarray) -> bytes:
    h, w = pixels.shape
    return b"P5 %d %d 255\n" % (w, h) + pixels.astype(np.uint8).tobytes()


def decode(data: bytes | None) -> np.ndarray | None:
    head = _HEAD.match(data or b"")
    if not head:
        return None
    w, h = int(head[1]), int(head[2])
    body = data[head.end() :]
    if len(body) < w * h or min(w, h) < 32:
        return None
    return np.frombuffer(body[: w * h], np.uint8).reshape(h, w).astype(np.float32)


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Mean over (2r + 1) squared pixels, edges repeated."""
    p = np.pad(a, r + 1, "edge").cumsum(0).cumsum(1)
    k = 2 * r + 1
    return (p[k:-1, k:-1] - p[:-k - 1, k:-1] - p[k:-1, :-k - 1] + p[:-k - 1, :-k - 1]) / (k * k)


def _resized(a: np.ndarray, by: float) -> np.ndarray:
    h, w = int(a.shape[0] / by), int(a.shape[1] / by)
    y, x = np.linspace(0, a.shape[0] - 1, h), np.linspace(0, a.shape[1] - 1, w)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, a.shape[0] - 1), np.minimum(x0 + 1, a.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    top = a[y0][:, x0] * (1 - fx) + a[y0][:, x1] * fx
    return top * (1 - fy) + (a[y1][:, x0] * (1 - fx) + a[y1][:, x1] * fx) * fy


def _found(image: np.ndarray, corners: int | None = None):
    """For each scale: the smoothed image, its corners (y, x), their angles, the scale and the
    factors back to the image."""
    for scale in SCALES:
        a = image if scale == 1 else _resized(_box(image, 1), scale)
        if min(a.shape) < 2 * REACH + 4:
            break
        soft = _box(a, 1)
        gy, gx = np.gradient(soft)
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        strength = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        inner = strength[REACH:-REACH, REACH:-REACH]
        around = np.lib.stride_tricks.sliding_window_view(
            strength[REACH - 2 : strength.shape[0] - REACH + 2, REACH - 2 : strength.shape[1] - REACH + 2], (5, 5)
        ).max((2, 3))
        y, x = np.nonzero((inner == around) & (inner > 50))
        best = np.lexsort((x, y, -inner[y, x]))[:corners]
        if not len(best):
            continue
        y, x = y[best] + REACH, x[best] + REACH
        disc = soft[y[:, None] + _DISC[:, 0], x[:, None] + _DISC[:, 1]]
        angle = np.arctan2(disc @ _DISC[:, 0].astype(np.float32), disc @ _DISC[:, 1].astype(np.float32))
        back = (image.shape[0] - 1) / (a.shape[0] - 1), (image.shape[1] - 1) / (a.shape[1] - 1)
        yield soft, y, x, angle, scale, back


def _turned(points: np.ndarray) -> np.ndarray:
    """Comparisons (test, point, (y, x)) in each direction, in pixels."""
    return np.stack(
        [
            np.rint(points @ np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]])).astype(int)
            for t in np.arange(TURNS) * 2 * np.pi / TURNS
        ]
    )


def _bits(turned: np.ndarray, soft, y, x, angle) -> np.ndarray:
    at = turned[np.rint(angle / (2 * np.pi / TURNS)).astype(int) % TURNS]
    v = soft[y[:, None, None] + at[..., 0], x[:, None, None] + at[..., 1]]
    return v[..., 0] < v[..., 1]


@functools.cache
def tests() -> np.ndarray:
    """The chosen comparisons in each direction. Tasks get them from the driver, so that all
    executors have the same."""
    rng = np.random.default_rng(1)
    pool = rng.uniform(1 - REACH, REACH - 1, (2 * POOL, 2, 2))
    pool = pool[(np.hypot(pool[..., 0], pool[..., 1]) <= REACH - 1).all(1)][:POOL]
    turned = _turned(pool)
    seen = [_bits(turned, *f[:4]) for _ in range(40) for f in _found(_picture(rng, 80).astype(np.float32))]
    bits = np.concatenate(seen).astype(float)
    even = bits.mean(0)
    usable = np.flatnonzero((even > 0.05) & (even < 0.95))
    alike = np.abs(np.corrcoef(bits[:, usable].T))
    order = np.argsort(np.abs(even[usable] - 0.5), kind="stable")
    chosen: list[int] = []
    for limit in np.arange(0.2, 1.05, 0.05):
        for j in order:
            if len(chosen) < TESTS and j not in chosen and (not chosen or alike[j, chosen].max() < limit):
                chosen.append(int(j))
    return turned[:, usable[chosen]]


def corners_of(image: np.ndarray, corners: int | None = None, turned: np.ndarray | None = None) -> list[tuple]:
    """(x, y, scale, angle, d0, d1) of an image's corners, in pixels of the image."""
    turned = tests() if turned is None else turned
    out = []
    for soft, y, x, angle, scale, (by, bx) in _found(image, corners):
        d = np.packbits(_bits(turned, soft, y, x, angle), axis=1, bitorder="little").view("<i8")
        out += zip((x * bx).tolist(), (y * by).tolist(), [scale] * len(x), angle.tolist(), d[:, 0].tolist(), d[:, 1].tolist())
    return out


def describe(images: DataFrame, corners: int | None = None) -> DataFrame:
    """A row per corner of images (image_id, image): image_id, content (a hash of the bytes),
    corner, x, y, scale, angle, d0, d1."""
    turned = tests()

    def run(batches):
        for batch in batches:
            rows = []
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a = decode(data)
                if a is not None:
                    content = np.uint64(xxhash.xxh3_64_intdigest(data)).astype(np.int64)
                    rows += [(i, content, n, *c) for n, c in enumerate(corners_of(a, corners, turned))]
            columns = list(zip(*rows)) if rows else [[] for _ in range(9)]
            kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.float32()] * 4, pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                ["image_id", "content", "corner", "x", "y", "scale", "angle", "d0", "d1"],
            )

    arrow_limits(images.sparkSession, 500)
    return images.select("image_id", "image").mapInArrow(
        run, f"image_id bigint, content bigint, corner int, {CORNER}"
    )


def _width(corners: int) -> int:
    """Bits of a window with which chance meetings stay in proportion to this many stored corners."""
    return min(64, max(24, corners.bit_length() + 10))


def _keys(d0: np.ndarray, d1: np.ndarray, width: int) -> np.ndarray:
    """For each descriptor its eight keys: `width` bits from every 16th on, mixed with the table."""
    halves = d0.view(np.uint64), d1.view(np.uint64)
    out = np.empty((len(d0), 8), np.uint64)
    for t in range(8):
        half, shift = divmod(16 * t, 64)
        key = halves[half] >> np.uint64(shift)
        if shift:
            key = key | (halves[1 - half] << np.uint64(64 - shift))
        key = key & np.uint64((1 << width) - 1)
        for by in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
            key = (key ^ (key >> np.uint64(31)) ^ np.uint64(t)) * np.uint64(by)
        out[:, t] = key ^ (key >> np.uint64(29))
    return out


@functools.cache
def _orders() -> list[np.ndarray]:
    rng = np.random.default_rng(3)
    return [rng.permutation(TESTS) for _ in range(ORDERS)]


def _shuffled_keys(d0: np.ndarray, d1: np.ndarray, width: int) -> np.ndarray:
    """For each descriptor the eight keys of each order of its bits."""
    bits = np.unpackbits(np.column_stack([d0, d1]).astype("<i8").view(np.uint8), axis=1, bitorder="little")
    out = []
    for n, order in enumerate(_orders()):
        d = np.ascontiguousarray(np.packbits(bits[:, order], axis=1, bitorder="little")).view("<i8")
        keys = _keys(np.ascontiguousarray(d[:, 0]), np.ascontiguousarray(d[:, 1]), width)
        out.append(keys ^ np.uint64(n * 0x9E3779B97F4A7C15 % (1 << 64)))
    return np.concatenate(out, axis=1)


def _entries(corners: DataFrame, width: int, wanted=None) -> DataFrame:
    """key, content, corner: a row for each corner and table, without those that the bitmap says
    nobody wants."""

    def run(batches):
        for batch in batches:
            d0, d1 = (batch.column(c).to_numpy() for c in ("d0", "d1"))
            keys = _shuffled_keys(d0, d1, width)
            at = np.repeat(np.arange(len(d0)), keys.shape[1])
            keys = keys.ravel()
            if wanted is not None:
                place = keys >> np.uint64(64 - BITMAP)
                hit = (wanted.value[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
                keys, at = keys[hit], at[hit]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), *(batch.column(c).take(pa.array(at)) for c in ("content", "corner"))],
                ["key", "content", "corner"],
            )

    return corners.select("content", "corner", "d0", "d1").mapInArrow(run, "key bigint, content bigint, corner int")


def _bitmap(entries: DataFrame) -> np.ndarray:
    """Which of 2 ** BITMAP ranges of keys occur: 16 MB, whatever the input."""
    place = F.shiftrightunsigned("key", 64 - BITMAP)
    words = (
        entries.groupBy(F.shiftright(place, 6).alias("word"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - BITMAP}) & 63 as int))")).alias("bits"))
        .toArrow()
    )
    out = np.zeros(1 << (BITMAP - 6), np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def _classes(described: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (content, image_id), firsts (content, class_id) and the corners of one image of
    each content."""
    members = described.filter("image_id is not null").select("content", "image_id").distinct()
    firsts = written(members.groupBy("content").agg(F.min("image_id").alias("class_id"), F.count(F.lit(1)).alias("size")))
    named = firsts.select("content", F.col("class_id").alias("image_id"))
    return members, firsts, described.join(named, ["content", "image_id"], "left_semi").drop("image_id")


def class_links(asked: DataFrame, stored: DataFrame, radius: int, least: int) -> DataFrame:
    """q, s, votes: the contents of a query and of a stored image that it is a copy of, from the
    corners (as described, one image of each content) of both."""
    if _width(n := stored.count()) > WIDTH:
        log.warning("%d corners: windows of %d bits meet by chance more than in proportion", n, WIDTH)
    sought = written(_entries(asked, WIDTH))
    wanted = asked.sparkSession.sparkContext.broadcast(_bitmap(sought))
    met = (
        sought.select("key", F.col("content").alias("q"), F.col("corner").alias("qc"))
        .join(_entries(stored, WIDTH, wanted).select("key", F.col("content").alias("s"), F.col("corner").alias("sc")), "key")
        .select("q", "qc", "s", "sc")
        .distinct()
    )
    side = lambda df, p: df.select(
        F.col("content").alias(p), F.col("corner").alias(f"{p}c"), *(F.col(c).alias(f"{p}_{c}") for c in ("x", "y", "scale", "angle", "d0", "d1"))
    )
    far = sum(F.bit_count(F.col(f"q_{d}").bitwiseXOR(F.col(f"s_{d}"))) for d in ("d0", "d1"))
    turn = F.col("s_angle") - F.col("q_angle")
    size = F.col("s_scale") / F.col("q_scale")
    moved_x = F.col("s_x") - size * (F.cos(turn) * F.col("q_x") - F.sin(turn) * F.col("q_y"))
    moved_y = F.col("s_y") - size * (F.sin(turn) * F.col("q_x") + F.cos(turn) * F.col("q_y"))
    both = lambda v: F.array(F.floor(v), F.floor(v + 0.5) + 0.5)
    matches = written(
        met.join(side(asked, "q"), ["q", "qc"])
        .join(side(stored, "s"), ["s", "sc"])
        .filter(far <= radius)
        .select(
            "q",
            "s",
            "qc",
            F.rint(F.log2(size)).alias("size"),
            # Overlapping cells: 30 degrees, a factor of two, 24 pixels.
            both(F.pmod(turn, F.lit(2 * np.pi)) / (np.pi / 6)).alias("turns"),
            both(moved_x / 24).alias("xs"),
            both(moved_y / 24).alias("ys"),
        )
    )
    # Pairs of images that share a corner or two by chance go before their matches enter cells.
    several = matches.select("q", "s", "qc").distinct().groupBy("q", "s").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    cells = (
        matches.join(several.select("q", "s"), ["q", "s"], "left_semi")
        .withColumn("turn", F.explode("turns"))
        .withColumn("cx", F.explode("xs"))
        .withColumn("cy", F.explode("ys"))
        .select("q", "s", F.pmod("turn", F.lit(12.0)).alias("turn"), "size", "cx", "cy", "qc")
        .distinct()
        .groupBy("q", "s", "turn", "size", "cx", "cy")
        .agg(F.count(F.lit(1)).alias("votes"))
    )
    return cells.groupBy("q", "s").agg(F.max("votes").alias("votes")).filter(F.col("votes") >= least)


def copies(queries: DataFrame, images: DataFrame, radius: int = 18, least: int = 4, corners: int | None = None):
    """Three tables: links (query_content, query_class, image_content, image_class, votes) between
    classes of equal images, by the number of corners that agree; query members and image members
    (content, image_id, class_id, size of the class). A content is a hash of the bytes; it names a
    class even where one id has several images."""
    # Pictures are read once and not moved; what is shuffled are corners.
    found = []
    for images_ in (queries.filter("image_id is not null"), images):
        members, firsts, distinct = _classes(written(describe(images_, corners)))
        found.append((members.join(firsts, "content").select("content", "image_id", "class_id", "size"), firsts, distinct))
    (of_query, first_q, asked), (of_image, first_s, stored) = found
    links = class_links(asked, stored, radius, least)
    return (
        links.join(first_q.select(F.col("content").alias("q"), F.col("class_id").alias("query_class")), "q")
        .join(first_s.select(F.col("content").alias("s"), F.col("class_id").alias("image_class")), "s")
        .select(F.col("q").alias("query_content"), "query_class", F.col("s").alias("image_content"), "image_class", "votes"),
        of_query,
        of_image,
    )


def _picture(rng: np.random.Generator, side: int) -> np.ndarray:
    """Clouds and rectangles."""
    coarse, fine = (_box(_box(rng.normal(0, 1, (side, side)), r), r) for r in (2, 1))
    a = 128 + 25 * coarse / coarse.std() + 25 * fine / fine.std()
    for y, x, h, w, g in rng.integers((0, 0, 6, 6, -60), (side - 8, side - 8, 30, 30, 60), (6, 5)).tolist():
        a[y : y + h, x : x + w] += g
    return a


def rendered(vectors: DataFrame, side: int = 80, edited: bool = False) -> DataFrame:
    """image_id, image from (vec_id, embedding): a picture of clouds and rectangles that the
    vector alone decides. edited: cut to a window of it, brighter, with less contrast and noise,
    and turned by a quarter for every other id."""

    def run(batches):
        for batch in batches:
            images = []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not v:
                    images.append(None)
                    continue
                seed = zlib.crc32(np.array([x or 0.0 for x in v], "<f4").tobytes())
                rng = np.random.default_rng(seed)
                a = _picture(rng, side)
                if edited:
                    y, x = rng.integers(0, side // 5, 2)
                    a = a[y : y + side * 4 // 5, x : x + side * 4 // 5]
                    a = 0.8 * a + 30 + rng.normal(0, 3, a.shape)
                    if (i or 0) // 20 % 2:
                        a = np.rot90(a)
                images.append(encode(np.clip(a, 0, 255)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(images, pa.binary())], ["image_id", "image"]
            )

    arrow_limits(vectors.sparkSession)
    return vectors.select("vec_id", "embedding").mapInArrow(run, "image_id bigint, image binary")


def find_edited(vectors: DataFrame, every: int = 20) -> DataFrame:
    """A row for every vector: vec_id, class_id (the smallest id with an equal picture, null
    without corners), and for ids divisible by `every`, which are the queries: copy_classes
    (ascending: the classes of pictures that its edited picture is a copy of), n_copies (pictures
    in these classes), votes (the most corners that agree with one of them). Others have nulls."""
    asked = vectors.filter(F.col("vec_id") % every == 0)
    links, of_query, of_image = copies(rendered(asked, edited=True), rendered(vectors))
    of_image = written(of_image)
    sizes = of_image.select(F.col("content").alias("image_content"), "size").distinct()
    lists = (
        links.join(sizes, "image_content")
        .groupBy(F.col("query_content").alias("content"))
        .agg(
            F.array_sort(F.collect_set("image_class")).alias("copy_classes"),
            F.sum("size").alias("n_copies"),
            F.max("votes").alias("votes"),
        )
    )
    of_query = (
        of_query.join(lists, "content")
        .groupBy(F.col("image_id").alias("vec_id"))
        .agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("copy_classes")))).alias("copy_classes"),
            F.sum("n_copies").alias("n_copies"),
            F.max("votes").alias("votes"),
        )
    )
    query = F.col("vec_id") % every == 0
    classes = of_image.groupBy(F.col("image_id").alias("vec_id")).agg(F.min("class_id").alias("class_id"))
    return (
        vectors.filter("vec_id is not null")
        .select("vec_id")
        .distinct()
        .join(classes, "vec_id", "left")
        .join(of_query, "vec_id", "left")
        .select(
            "vec_id",
            "class_id",
            F.when(query, F.coalesce("copy_classes", F.array().cast("array<bigint>"))).alias("copy_classes"),
            F.when(query, F.coalesce("n_copies", F.lit(0))).alias("n_copies"),
            F.when(query, F.coalesce("votes", F.lit(0))).alias("votes"),
        )
    )
