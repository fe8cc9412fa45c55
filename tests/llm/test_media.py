"""Copies of images: the search held against comparing all corners of all images."""

from collections import defaultdict

import numpy as np

from sedimark.llm import media

KIND = "image_id long, image binary"


def _all_pairs(queries, images, radius=18, least=4):
    """(query id, image id): votes, from all pairs of corners, without tables or keys."""
    of = lambda rows: {i: media.corners_of(a) for i, x in rows if (a := media.decode(x)) is not None}
    q, s = of(queries), of(images)
    out = {}
    for i, qs in q.items():
        for j, ss in s.items():
            if not qs or not ss:
                continue
            bits = lambda cs: np.array([c[4:] for c in cs], np.int64)
            far = np.bitwise_count((bits(qs)[:, None] ^ bits(ss)[None]).view(np.uint64)).sum(2)
            cells = defaultdict(set)
            for a, b in zip(*np.nonzero(far <= radius)):
                (qx, qy, qz, qa), (sx, sy, sz, sa) = qs[a][:4], ss[b][:4]
                turn, size = sa - qa, sz / qz
                x = sx - size * (np.cos(turn) * qx - np.sin(turn) * qy)
                y = sy - size * (np.sin(turn) * qx + np.cos(turn) * qy)
                both = lambda v: (np.floor(v), np.floor(v + 0.5) + 0.5)
                for t in both(turn % (2 * np.pi) / (np.pi / 6)):
                    for u in both(x / 24):
                        for v in both(y / 24):
                            cells[t % 12, np.rint(np.log2(size)), u, v].add(a)
            votes = max(map(len, cells.values()), default=0)
            if votes >= least:
                out[i, j] = votes
    return out


def _found(spark, queries, images):
    links, of_query, of_image = media.copies(spark.createDataFrame(queries, KIND), spark.createDataFrame(images, KIND))
    of_query, of_image = ([(r.image_id, r.content) for r in m.collect()] for m in (of_query, of_image))
    votes = {(r.query_content, r.image_content): r.votes for r in links.collect()}
    return {(i, j): votes[c, d] for i, c in of_query for j, d in of_image if (c, d) in votes}


def test_against_all_pairs(spark):
    """200 images; cropped, turned and brightened queries. All links of the brute force by tables
    with votes no higher, none besides."""
    rng = np.random.default_rng(2)
    vectors = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(200)], "vec_id long, embedding array<double>")
    plain = lambda df: [tuple(r) for r in df.select("image_id", "image").collect()]
    images = plain(media.rendered(vectors))
    queries = plain(media.rendered(vectors.filter("vec_id % 10 = 0"), edited=True))
    want, got = _all_pairs(queries, images), _found(spark, queries, images)
    assert {(i, i) for i, _ in queries} <= set(want)
    assert set(got) <= set(want) and len(got) >= 0.95 * len(want)
    assert all(v <= want[p] for p, v in got.items())
    assert sum(got.values()) >= 0.6 * sum(want[p] for p in got)


def test_find_edited(spark):
    """Classes of equal pictures, queries and links; nulls, repeated rows, clashing names."""
    rng = np.random.default_rng(5)
    v = [rng.normal(size=8).tolist() for _ in range(45)]
    rows = [(i, v[i], "k") for i in range(45)] + [(i, v[7], "k") for i in range(100, 160)]
    rows += [(500, None, "k"), (None, v[3], "k"), (21, v[21], "k"), (520, [], "k")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, class_id string")
    out = media.find_edited(vectors).collect()
    found = {r.vec_id: r for r in out}
    assert len(found) == len(out) == 45 + 60 + 2
    assert found[130].class_id == 7 and found[9].class_id == 9 and found[500].class_id is None
    assert {i for i, r in found.items() if r.copy_classes is not None} == {0, 20, 40, 100, 120, 140, 500, 520}
    assert list(found[120].copy_classes) == [7] and found[120].n_copies == 61 and found[120].votes >= 4
    assert list(found[20].copy_classes) == [20] and found[20].n_copies == 1
    assert (list(found[500].copy_classes), found[500].n_copies, found[500].votes) == ([], 0, 0)
    assert found[9].copy_classes is None and found[9].votes is None
    assert media.find_edited(vectors.limit(0)).count() == 0


def test_images_without_corners(spark):
    rows = [(1, b"junk"), (2, None), (3, media.encode(np.zeros((40, 40)))), (4, b""), (None, b"P5 90 90 255\n")]
    assert _found(spark, rows, rows) == {}


def test_one_id_with_two_images(spark):
    """Both images are found under the id; neither lends its corners to the other."""
    rng = np.random.default_rng(8)
    vectors = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(4)], "vec_id long, embedding array<double>")
    a, b, c, d = (r.image for r in media.rendered(vectors).orderBy("image_id").collect())
    got = _found(spark, [(1, a), (2, b), (3, c)], [(9, a), (9, b), (9, a), (10, b), (11, d)])
    assert set(got) == {(1, 9), (2, 9), (2, 10)}


def test_width_grows_with_the_corners():
    assert [media._width(n) for n in (0, 1 << 10, 1 << 20, 1 << 40, 1 << 60)] == [24, 24, 31, 51, 64]
    rng = np.random.default_rng(1)
    d0, d1 = rng.integers(-(1 << 63), (1 << 63) - 1, (2, 50))
    for width in (24, 40, 64):
        keys = media._keys(d0, d1, width)
        assert keys.shape == (50, 8) and len(np.unique(keys)) == 400
        near = media._keys(d0 ^ 1, d1, width)  # one bit: only tables whose window holds it differ
        assert set(np.flatnonzero((near != keys).any(0))) == {t for t in range(8) if any((16 * t + w) % 128 == 0 for w in range(width))}


def test_small_crops_of_large_images(spark):
    """A tenth of the area of a large picture; recall against comparing all descriptors."""
    rng = np.random.default_rng(12)
    whole, parts = [], []
    for i in range(6):
        soft = media._box(rng.normal(0, 1, (320, 320)), 2)
        a = 128 + 35 * soft / soft.std()
        for y, x, h, w, g in rng.integers((0, 0, 8, 8, -60), (300, 300, 40, 40, 60), (60, 5)).tolist():
            a[y : y + h, x : x + w] += g
        y, x = rng.integers(0, 320 - 101, 2)
        part = 0.9 * a[y : y + 101, x : x + 101] + 10 + rng.normal(0, 2, (101, 101))
        whole.append((i, media.encode(np.clip(a, 0, 255))))
        parts.append((i, media.encode(np.clip(part, 0, 255))))
    got = set(_found(spark, parts, whole))
    owed = {p for p in _all_pairs(parts, whole) if p[0] == p[1]}
    assert len(owed) >= 5 and len(owed & got) >= 0.9 * len(owed)
    assert len(got - {(i, i) for i in range(6)}) <= 1


def test_links_do_not_depend_on_the_number_of_images(spark):
    """Descriptors that differ in every window of 25 bits, and equal ones, among few and many others."""
    rng = np.random.default_rng(8)
    flips = sum(1 << b for b in (24, 40, 56)), sum(1 << (b - 64) for b in (72, 88, 104, 120))
    d = rng.integers(-(1 << 62), 1 << 62, (12, 2)).tolist()
    row = lambda content, n, d0, d1: (content, n, 20.0 * n, 10.0, 1.0, 0.0, d0, d1)
    kind = f"content long, corner int, {media.CORNER}"
    asked = [row(1, n, *d[n]) for n in range(6)] + [row(2, n, *d[n]) for n in range(6, 12)]
    stored = [row(11, n, *d[n]) for n in range(6)] + [row(12, n, d[n][0] ^ flips[0], d[n][1] ^ flips[1]) for n in range(6, 12)]
    others = [row(100 + n // 8, n % 8, *x) for n, x in enumerate(rng.integers(-(1 << 62), 1 << 62, (1 << 15, 2)).tolist())]
    links = lambda rows: {(r.q, r.s, r.votes) for r in media.class_links(spark.createDataFrame(asked, kind), spark.createDataFrame(rows, kind), 18, 4).collect()}
    few = links(stored)
    assert (1, 11, 6) in few and links(stored + others) == few


def test_few_corners_meet_by_chance():
    """400 pictures and 40 edited ones: of all pairs of corners that meet in a table most belong to
    one picture, and nearly all near pairs of these meet."""
    rng, stored, asked = np.random.default_rng(4), [], []
    for i in range(400):
        a = media._picture(rng, 80)
        stored += [(i, *c[4:]) for c in media.corners_of(np.clip(a, 0, 255).astype(np.float32))]
        if i % 10 == 0:
            part = 0.8 * a[5:69, 9:73] + 30 + rng.normal(0, 3, (64, 64))
            asked += [(i, *c[4:]) for c in media.corners_of(np.clip(part, 0, 255).astype(np.float32))]
    (q, q0, q1), (s, s0, s1) = (np.array(x, np.int64).T for x in (asked, stored))
    qk, sk = (media._shuffled_keys(a, b, media.WIDTH) for a, b in ((q0, q1), (s0, s1)))
    assert qk.shape[1] == 8 * media.ORDERS
    met = np.zeros((len(q), len(s)), bool)
    for t in range(qk.shape[1]):
        met |= qk[:, t, None] == sk[None, :, t]
    far = sum(np.bitwise_count((a[:, None] ^ b[None]).view(np.uint64)).astype(int) for a, b in ((q0, s0), (q1, s1)))
    own = q[:, None] == s[None]
    owed = own & (far <= 18)
    assert (met & ~own).sum() <= 0.02 * (met & own).sum()
    assert (met & owed).sum() >= 0.85 * owed.sum()
    early = np.zeros_like(met)  # eight windows of 32 bits in the order of the tests
    for a, b in zip(media._keys(q0, q1, 32).T, media._keys(s0, s1, 32).T):
        early |= a[:, None] == b[None]
    assert (early & ~own).sum() > 10 * max(1, (met & ~own).sum())
    assert (met & owed).sum() >= 0.99 * (early & owed).sum()
