"""SimHash near-duplicates through a hierarchical index in Gray order.

Fingerprints. One bit for each of 64: set if it is set in over half of the shingle hashes
(XXH64 of the UTF-8 bytes, seed 42). Words are runs of bytes other than ASCII white space, A-Z
lower-cased; a text of fewer words than a shingle has one shingle; one without words has
fingerprint zero.

Index. Two fingerprints within r bits agree on at least a of r + a blocks of bits. Each distinct
fingerprint goes to a group for each choice of a blocks and its bits there; a grows with the
number of fingerprints, so that groups stay small. A group's fingerprints are sorted by Gray
rank. 32 neighbours make a leaf, eight nodes a parent; a node keeps the bits in which all below
agree, as a mask and a pattern, and pairs of nodes are taken apart from the top: the bits that a
pair has in common beyond its parents' are compared, the differences add up along the way, and a
pair beyond r is dropped with all that is below. What is left is compared fingerprint by
fingerprint. A group of over `most` fingerprints is dealt out as pairs of slices, so no task
holds an unbounded one, and only links that connect something new leave a task.

Recovery: every intermediate table is written to the shared folder; tasks are pure functions of
their rows.

Edge cases. Null text counts as empty. Repeated rows and equal texts share a fingerprint and so a
component. Null doc_id: ordered last, so it names a component only if no other id can. Empty
input: empty result. Other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimark.llm.common import arrow_limits, written
from sedimark.llm.components import components

SEED = 42
LEAF, FAN = 32, 8
#: Spreads the bits of a byte over the bytes of a word, so that 255 words add up without carry.
_SPREAD = np.zeros(256, np.uint64)
for _bit in range(8):
    _SPREAD |= ((np.arange(256, dtype=np.uint64) >> np.uint64(_bit)) & np.uint64(1)) << np.uint64(
        8 * _bit
    )


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(tokens: list[bytes], size: int, distinct: bool = False) -> np.ndarray:
    """XXH64 of each shingle of `size` words, repeats included unless distinct."""
    if not tokens:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if distinct and size == 1:
        found = [digest(w, SEED) for w in set(tokens)]
    elif len(tokens) <= size:
        found = [digest(b" ".join(tokens), SEED)]
    else:
        line = b" ".join(tokens)
        ends, at = [], -1
        for w in tokens:
            at += len(w) + 1
            ends.append(at)
        starts = [0] + [e + 1 for e in ends[: len(tokens) - size]]
        found = [digest(line[s:e], SEED) for s, e in zip(starts, ends[size - 1 :])]
        if distinct:
            found = list(set(found))
    return np.array(found, np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The majority of each bit."""
    n = len(hashes)
    if not n:
        return 0
    lanes = _SPREAD[hashes.astype("<u8").view(np.uint8)].reshape(n, 8)
    total = np.zeros((8, 8), np.int64)
    for i in range(0, n, 255):
        total += lanes[i : i + 255].sum(0).astype("<u8").view(np.uint8).reshape(8, 8)
    return int(np.packbits(2 * total.ravel() > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, distinct: bool = False) -> DataFrame:
    """doc_id, fp (bigint, the 64 bits), same (hash of the word sequence, bigint)."""

    def run(batches):
        for batch in batches:
            fps, same = [], []
            for text in batch.column(1):
                w = words(text.as_py())
                fps.append(fingerprint(shingle_hashes(w, shingle, distinct)))
                same.append(xxhash.xxh3_64_intdigest(b" ".join(w)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.array(fps, np.uint64).view(np.int64)),
                    pa.array(np.array(same, np.uint64).view(np.int64)),
                ],
                ["doc_id", "fp", "same"],
            )

    arrow_limits(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, fp bigint, same bigint"
    )


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each bit pattern in the Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _levels(fp: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[dict]:
    """The trees of all groups, level by level from the leaves: for each node its first row, the
    row behind its last, first child and number of children, mask and pattern; and each group's
    first node and number of nodes."""
    levels = []
    first, count, width = starts, sizes, LEAF
    rows_from, rows_to = np.arange(len(fp)), np.arange(1, len(fp) + 1)
    mask, pattern = np.full(len(fp), ~np.uint64(0)), fp
    while True:
        n = -(-count // width)
        base = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
        group = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(group)) - base[group]
        child = first[group] + place * width
        children = np.minimum(width, count[group] - place * width)
        varies = np.bitwise_or.reduceat(pattern ^ np.repeat(pattern[child], children), child)
        shared = np.bitwise_and.reduceat(mask, child) & ~varies
        rows_from, rows_to = rows_from[child], rows_to[child + children - 1]
        pattern, mask = pattern[child] & shared, shared
        levels.append(
            {"from": rows_from, "to": rows_to, "child": child, "children": children, "mask": mask, "pattern": pattern, "first": base, "count": n}
        )
        if n.max(initial=0) <= 1:
            return levels
        first, count, width = base, n, FAN


def _union(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Ties rows a and b together in root, in place; root names the smallest row."""
    while len(a):
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        lo, hi = np.minimum(x, y)[open_], np.maximum(x, y)[open_]
        np.minimum.at(root, hi, lo)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def linked_rows(fp: np.ndarray, group: np.ndarray, radius: int) -> np.ndarray:
    """For rows sorted by group and Gray rank: the smallest row of each one's component within
    its group, linking rows with at most `radius` different bits."""
    root = np.arange(len(fp))
    if not len(fp):
        return root
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(fp)]]))
    levels = _levels(fp, starts, sizes)
    for i in range(0, len(starts), 4096):
        top = levels[-1]["first"][i : i + 4096]
        _descend(levels, len(levels) - 1, top, top, np.zeros(len(top), np.int64), fp, root, radius)
    return root


def _descend(levels, depth, a, b, differ, fp, root, radius) -> None:
    level = levels[depth]
    if not depth:
        return _leaves(level, a, b, fp, root, radius)
    below = levels[depth - 1]
    for i in range(0, len(a), 16384):
        x, y, d = a[i : i + 16384], b[i : i + 16384], differ[i : i + 16384]
        across = np.arange(FAN)
        left = (level["child"][x][:, None, None] + across[None, :, None]) + 0 * across
        right = (level["child"][y][:, None, None] + across[None, None, :]) + 0 * across[:, None]
        good = (
            (across[None, :, None] < level["children"][x][:, None, None])
            & (across[None, None, :] < level["children"][y][:, None, None])
            & (left <= right)
        )
        known = np.broadcast_to((level["mask"][x] & level["mask"][y])[:, None, None], good.shape)[good]
        d = np.broadcast_to(d[:, None, None], good.shape)[good]
        left, right = left[good], right[good]
        shared = below["mask"][left] & below["mask"][right] & ~known
        d = d + np.bitwise_count((below["pattern"][left] ^ below["pattern"][right]) & shared)
        near = d <= radius
        if near.any():
            _descend(levels, depth - 1, left[near], right[near], d[near], fp, root, radius)


def _leaves(level, a, b, fp, root, radius) -> None:
    across = np.arange(LEAF)
    for i in range(0, len(a), 1024):
        x, y = a[i : i + 1024], b[i : i + 1024]
        # Nothing to find where both leaves are in one component throughout.
        xs, ys = level["from"][x][:, None] + across, level["from"][y][:, None] + across
        inx, iny = xs < level["to"][x][:, None], ys < level["to"][y][:, None]
        xs, ys = np.where(inx, xs, level["from"][x][:, None]), np.where(iny, ys, level["from"][y][:, None])
        rx, ry = root[xs], root[ys]
        todo = (rx != rx[:, :1]).any(1) | (ry != rx[:, :1]).any(1)
        if not todo.any():
            continue
        xs, ys, inx, iny = xs[todo], ys[todo], inx[todo], iny[todo]
        far = np.bitwise_count(fp[xs][:, :, None] ^ fp[ys][:, None, :])
        hit = (far <= radius) & inx[:, :, None] & iny[:, None, :] & (xs[:, :, None] < ys[:, None, :])
        k, p, q = np.nonzero(hit)
        _union(root, xs[k, p], ys[k, q])


def block_tables(n: int, radius: int, group: int = 2000) -> list[list[int]]:
    """Masks of the tables: for each, a bit mask of the blocks that must agree."""
    a = 1
    while a < 4 and n / 2 ** (64 * a / (radius + a)) > group:
        a += 1
    cuts = [round(64 * i / (radius + a)) for i in range(radius + a + 1)]
    masks = [(1 << hi) - (1 << lo) for lo, hi in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(masks, a)]


def candidate_links(distinct_fps: DataFrame, radius: int, most: int = 20_000) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (column fp) which can reach each other
    in steps of at most `radius` bits."""
    n = distinct_fps.count()
    masks = block_tables(n, radius)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    rows = distinct_fps.select(
        "fp",
        F.posexplode(
            F.array(*(F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")) for m in masks))
        ).alias("t", "key"),
    )
    large = (
        rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > most)
        if n > most
        else None
    )
    if large is not None and not (large := written(large)).isEmpty():
        rows = rows.join(large, ["t", "key"], "left").withColumn(
            "s", F.ceil(F.coalesce("c", F.lit(1)) / (most // 2))
        )
        mine = F.pmod(F.xxhash64("fp"), F.col("s"))
        rows = rows.withColumn("mine", mine).select(
            "fp",
            "t",
            "key",
            F.explode(
                F.transform(
                    F.sequence(F.lit(0).cast("long"), F.col("s") - 1),
                    lambda o: F.least(o, F.col("mine")) * F.col("s") + F.greatest(o, F.col("mine")),
                )
            ).alias("slice"),
        )
    else:
        rows = rows.withColumn("slice", F.lit(0).cast("long"))

    def run(batches):
        def found(part: pa.Table):
            fp = part.column("fp").to_numpy().view(np.uint64)
            keys = [part.column(c).to_numpy() for c in ("t", "key", "slice")]
            order = np.lexsort((gray_rank(fp), *keys[::-1]))
            fp, keys = fp[order], [k[order] for k in keys]
            new = np.zeros(len(fp), bool)
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            root = linked_rows(fp, np.cumsum(new), radius)
            tied = np.flatnonzero(root != np.arange(len(fp)))
            return pa.RecordBatch.from_arrays(
                [pa.array(fp[tied].view(np.int64)), pa.array(fp[root[tied]].view(np.int64))],
                ["a", "b"],
            )

        kept: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            kept.append(batch)
            held += batch.num_rows
            if held < 200_000:
                continue
            part = pa.Table.from_batches(kept)
            # The last group may go on in the next batch.
            keys = [part.column(c).to_numpy() for c in ("t", "key", "slice")]
            same = np.logical_and.reduce([k == k[-1] for k in keys])
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if cut:
                yield found(part.slice(0, cut))
                kept = part.slice(cut).to_batches()
                held = sum(b.num_rows for b in kept)
        if held:
            yield found(pa.Table.from_batches(kept))

    arrow_limits(distinct_fps.sparkSession, 10_000)
    return (
        rows.select("t", F.col("key"), "slice", "fp")
        .repartition("t", "key", "slice")
        .sortWithinPartitions("t", "key", "slice")
        .mapInArrow(run, "a bigint, b bigint")
    )


def simhash_components(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id that can be reached
    in steps of at most `radius` bits, its own included."""
    prints = written(fingerprints(docs, shingle).select("doc_id", "fp"))
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(candidate_links(distinct.select("fp"), radius))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_print = named.join(least, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
