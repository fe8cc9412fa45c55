import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from sedimark.llm import near, simhash
from sedimark.llm.components import components


def brute_print(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_roots(nodes, near):
    root = {n: n for n in nodes}
    find = lambda n: n if root[n] == n else find(root[n])
    for a in nodes:
        for b in nodes:
            if a < b and near(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def some_texts(rng, n=120):
    base = [" ".join(f"w{x}" for x in rng.integers(0, 300, 200)) for _ in range(n // 4)]
    out = []
    for i in range(n):
        w = base[int(rng.integers(len(base)))].split()
        for _ in range(int(rng.integers(0, 9))):
            w[int(rng.integers(len(w)))] = f"x{int(rng.integers(50))}"
        out.append((1000 - i, " ".join(w)))
    return out


def test_components_equal_brute_force(documents, odd_texts):
    rows = [r for r in odd_texts if r[0] is not None] + some_texts(np.random.default_rng(1))
    got = {r.doc_id: r for r in simhash.simhash_components(documents(rows)).collect()}
    fp = {i: brute_print(t) for i, t in rows}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == fp
    want = brute_roots(sorted(fp), lambda a, b: bin(fp[a] ^ fp[b]).count("1") <= 4)
    assert {i: r.component_id for i, r in got.items()} == want
    assert len(set(want.values())) < len(want)
    assert simhash.simhash_components(documents([])).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from([0, 2, 4, 8]), st.integers(1, 1500))
def test_index_links_what_brute_force_links(seed, radius, n):
    rng = np.random.default_rng(seed)
    centre = rng.integers(0, 2**63, max(1, n // 8)).astype(np.uint64)
    fp = centre[rng.integers(0, len(centre), n)]
    for _ in range(4):
        fp ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    group = np.sort(rng.integers(0, 3, n))
    order = np.lexsort((simhash.gray_rank(fp), group))
    fp, group = fp[order], group[order]
    near = (np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius) & (group[:, None] == group[None, :])
    want = np.arange(n)
    while True:
        new = np.array([want[row].min() for row in near])
        if (new == want).all():
            break
        want = new
    assert (simhash.linked_rows(fp, group, radius) == want).all()


def test_large_groups_are_dealt_out(spark):
    rng = np.random.default_rng(5)
    fp = (np.uint64(7) << np.uint64(50)) ^ rng.integers(0, 2**20, 600).astype(np.uint64)
    fps = [int(x) for x in np.unique(fp)]
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = {r.node: r.root for r in components(simhash.candidate_links(df, 4, most=50)).collect()}
    want = brute_roots(fps, lambda a, b: bin(a ^ b).count("1") <= 4)
    assert {x: got.get(x, x) for x in fps} == want


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(50)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {i: 1000 for i in range(1001, 1050)}


def test_near_duplicates_equal_brute_force(documents, odd_texts):
    rows = [r for r in odd_texts if r[0] is not None] + some_texts(np.random.default_rng(2))
    got = {r.doc_id: r.component_id for r in near.near_duplicates(documents(rows)).collect()}
    sets = {i: set(simhash.shingle_hashes(simhash.words(t), 5, True).tolist()) for i, t in rows}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    assert got == brute_roots(sorted(sets), alike)


def test_contiguous_changes_are_found(documents):
    """Copies with text added, cut off or replaced in one piece, at similarities of 0.8 to 0.9."""
    rng = np.random.default_rng(11)
    new = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    rows, frame = [], new(8)
    for i in range(0, 180, 2):
        w = frame + new(int(rng.integers(60, 500)))
        k = int(len(w) * rng.uniform(0.1, 0.24) * (0.5 if i % 6 == 4 else 1))
        at = int(rng.integers(8, len(w) - k))
        copy = [w + new(k), w[: len(w) - k], w[:at] + new(k) + w[at + k :]][i // 2 % 3]
        rows += [(i, " ".join(w)), (i + 1, " ".join(copy))]
    sets = {i: set(simhash.shingle_hashes(simhash.words(t), 5, True).tolist()) for i, t in rows}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    want = brute_roots(sorted(sets), alike)
    assert sum(i != r for i, r in want.items()) > 50
    got = {r.doc_id: r.component_id for r in near.near_duplicates(documents(rows)).collect()}
    assert got == want


def test_rounds_change_nothing(documents):
    """Groups tied by stars are those of all pairs; chains of copies that are far from the first."""
    rng = np.random.default_rng(4)
    w = [f"w{x}" for x in rng.integers(0, 10**6, 300)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(w)))
        at = int(rng.integers(0, 280))
        w = w[:at] + [f"n{x}" for x in rng.integers(0, 10**6, 20)] + w[at + 20 :]
    rows += some_texts(rng, 40)
    sets = {i: set(simhash.shingle_hashes(simhash.words(t), 5, True).tolist()) for i, t in rows}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    want = brute_roots(sorted(sets), alike)
    for rounds in (0, 2):
        got = {r.doc_id: r.component_id for r in near.near_duplicates(documents(rows), rounds=rounds).collect()}
        assert got == want


def test_first_of_each(documents):
    """Two different texts under one id both stay; repeated rows once; rows without an id all stay."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text), (3, text + " mehr"), (3, "ganz anderer Text"), (3, "ganz  anderer text"), (7, "x y"), (7, "x y"), (None, text), (None, text), (9, None), (8, "")]
    got = sorted(((r.doc_id, r.text) for r in near.first_of_each(documents(rows)).collect()), key=str)
    assert [(i, t) for i, t in got if i in (7, 8, 9, None)] == [(7, "x y"), (8, ""), (None, text), (None, text)]
    assert [t for i, t in got if i == 3 and t.startswith("w")] == [text + " mehr"]
    assert sum(i == 3 and not t.startswith("w") for i, t in got) == 1 and not any(i == 5 for i, _ in got)
