"""Near-duplicates by shingles: SimHash finds most candidates, an exact prefix filter the others.

Two texts are linked if the sets of their five-word shingles have a Jaccard similarity of at least
0.8; a group is what links connect. Equal texts (the same words in the same order) are one text
throughout, known by a 64-bit hash of it, with membership beside it.

1. SimHash fingerprints over distinct words, which a few changed words hardly move, are linked in
   the Gray-order index of `simhash`. Its links are few, as they only connect what is near; each
   is checked on the shingles. Texts with one fingerprint are linked to the first of them.
2. What contiguous changes moved further, or what a link that failed had tied, is found exactly:
   with shingles in one order, rare ones first, two sets of the similarity share one of their
   first n - ceil(0.8 n) + 1. Texts send these to their shingle; a task keeps those that several
   have, row by row, whatever their number.
3. Of such a shingle, first every text is checked against one text of another group only, and
   groups that are found to belong together are joined, for as many rounds as that helps. So a
   large group is tied by stars and not by all its pairs. Only then all pairs that are left, of
   different groups, of sizes that can reach the similarity and with enough shingles behind the
   shared one, are checked.

No link is lost, as step 3 ends with all of them; the order of shingles comes from a sample and
costs time only. A pair is checked by sketches of the sets first, which rule out nearly all that
haven't the similarity and none that has. What is moved are hashes and sketches; texts are moved
for pairs that sketches don't rule out.

Edge cases. Null and empty texts are one text, without shingles, linked to nothing else. Repeated
rows and equal texts are one group. Null doc_id: left out. An id with two different texts is in
the groups of both. Ties: the smallest id names a group. Empty input: empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimark.llm.common import arrow_limits, written
from sedimark.llm.components import components
from sedimark.llm.simhash import candidate_links, fingerprint, shingle_hashes, words

SENT = 500_000  # rows of ids up to which they are sent to the documents, 8 MB
CENTRES = 2  # classes of shingles whose stars have centres of their own


def same_text(text: str = "text") -> Column:
    """A hash of the sequence of words: A-Z lower-cased, ASCII white space as single spaces."""
    low = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.xxhash64(F.trim(F.regexp_replace(low, r"[ \t-\r]+", " ")))


def sketch(hashes: np.ndarray) -> bytes:
    """A set of hashes as bits, four to eight a hash, a power of two of them."""
    size = 1 << max(6, (4 * len(hashes)).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(hashes & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def may_share(a: bytes, b: bytes, n: int, m: int, similarity: float) -> bool:
    """Whether sets of n and m hashes can have the similarity, by their sketches: each bit that only
    one of them has is a hash that the other hasn't. Never false for sets that have it."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    shared = min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))
    return shared > 0 and shared >= similarity * (n + m - shared) - 1e-9


def _texts(docs: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, same) and a row per text (same, fp, n, bits, first_id)."""

    def run(batches):
        for batch in batches:
            fps, sizes, bits = [], [], []
            for t in batch.column(2):
                w = words(t.as_py())
                h = shingle_hashes(w, shingle, True)
                fps.append(fingerprint(shingle_hashes(w, 1, True)))
                sizes.append(len(h))
                bits.append(sketch(h))
            numbers = pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(bits, pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *numbers], ["doc_id", "same", "fp", "n", "bits"])

    arrow_limits(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.filter("doc_id is not null").select("doc_id", same_text().alias("same"), "text")
    rows = written(rows.mapInArrow(run, f"doc_id {kind}, same bigint, fp bigint, n int, bits binary"))
    own = rows.groupBy("same").agg(*(F.first(c).alias(c) for c in ("fp", "n", "bits")), F.min("doc_id").alias("first_id"))
    return rows.select("doc_id", "same"), written(own)


def _possible(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs (a, b of texts; others kept) whose sketches don't rule them out."""
    asked = written(pairs.select(F.col("a").alias("same")).union(pairs.select("b")).distinct())
    few = asked.count() <= SENT
    own = written(texts.select("same", "n", "bits").join(F.broadcast(asked) if few else asked, "same", "left_semi"))
    side = lambda c: own.select(F.col("same").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches):
        for batch in batches:
            own = zip(*(batch.column(c).to_pylist() for c in ("bits_a", "bits_b", "n_a", "n_b")))
            keep = [may_share(*x, similarity) for x in own]
            yield batch.select(pairs_columns).filter(pa.array(keep, pa.bool_()))

    pairs_columns = list(pairs.columns)
    arrow_limits(pairs.sparkSession, 5000)
    return written(both.select(*pairs_columns, "bits_a", "bits_b", "n_a", "n_b").mapInArrow(run, ", ".join(f"{c} bigint" for c in pairs_columns)))


def _checked(pairs: DataFrame, texts: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of pairs (a, b of texts; others kept) that have the similarity: first by sketches, then
    by the texts themselves, which are looked up in docs by id for what is left."""
    pairs = _possible(pairs, texts, similarity)
    others = [c for c in pairs.columns if c not in ("a", "b")]
    asked = pairs.select(F.col("a").alias("same")).union(pairs.select("b")).distinct()
    named = written(texts.select("same", "first_id").join(asked, "same").select(F.col("same").alias("want"), F.col("first_id").alias("doc_id")))
    if named.count() <= SENT:  # two numbers a row: the texts of all documents stay where they are
        named = F.broadcast(named)
    rows = docs.select("doc_id", "text").join(named, "doc_id").withColumn("same", same_text()).filter("same = want")
    own = written(rows.dropDuplicates(["same"]).select("same", "text"))
    both = pairs.join(own.select(F.col("same").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(own.select(F.col("same").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches):
        known: dict = {}

        def hashes(key, text):
            if key not in known:
                if len(known) > 500:
                    known.clear()
                known[key] = np.sort(shingle_hashes(words(text), shingle, True))
            return known[key]

        for batch in batches:
            keep = []
            for a, b, t, u in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b"))):
                x, y = hashes(a, t), hashes(b, u)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared > 0 and shared >= similarity * (len(x) + len(y) - shared) - 1e-9)
            yield batch.select(["a", "b", *others]).filter(pa.array(keep, pa.bool_()))

    arrow_limits(pairs.sparkSession, 500)
    kinds = ", ".join(f"{c} bigint" for c in ("a", "b", *others))
    return written(both.select("a", "b", *others, "text_a", "text_b").mapInArrow(run, kinds))


def _by_simhash(texts: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) to be checked: within a fingerprint, and between fingerprints that are near."""
    firsts = written(texts.groupBy("fp").agg(F.min("same").alias("b"), F.count(F.lit(1)).alias("n")))
    within = texts.join(firsts.filter("n > 1"), "fp").filter("same <> b").select(F.col("same").alias("a"), "b")
    near = candidate_links(firsts.select("fp"), radius)
    name = lambda c: firsts.select(F.col("fp").alias(f"fp_{c}"), F.col("b").alias(c))
    across = near.select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b")).join(name("a"), "fp_a").join(name("b"), "fp_b").select("a", "b")
    return written(within.unionByName(across).distinct())


def _order(docs: DataFrame, shingle: int, sample: int = 20_000, most: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and counts of shingles that several texts of a sample have: an order, no
    more."""
    n = max(1, docs.count())
    key = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(17)), 11) / float(1 << 53)

    def run(batches):
        for batch in batches:
            for text in batch.column(0):
                h = shingle_hashes(words(text.as_py()), shingle, True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    found = (
        docs.filter(key < sample / n)
        .select("text")
        .mapInArrow(run, "h bigint")
        .groupBy("h")
        .agg(F.count(F.lit(1)).alias("c"))
        .filter("c > 1")
        .orderBy(F.desc("c"), "h")
        .limit(most)
        .toArrow()
    )
    h, c = found.column("h").to_numpy(), found.column("c").to_numpy()
    order = np.argsort(h)
    return h[order], c[order]


def _met(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """h, same, n, at of prefix shingles that several rows have."""
    shared = docs.sparkSession.sparkContext.broadcast(_order(docs, shingle))

    def heads(batches):
        usual, counts = shared.value
        for batch in batches:
            out = []
            for same, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                h = shingle_hashes(words(text.as_py()), shingle, True).view(np.int64)
                if not len(h):
                    continue
                count = np.zeros(len(h), np.int64)
                if len(usual):
                    at = np.minimum(np.searchsorted(usual, h), len(usual) - 1)
                    count = np.where(usual[at] == h, counts[at], 0)
                keep = len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1
                first = h[np.lexsort((h, count))[:keep]]
                # Number and place in one: both are below 2 ** 31.
                out.append((first, np.full(len(first), same), (len(h) << 31) + np.arange(len(first))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["h", "same", "place"])

    def several(batches):
        """Rows in the order of h: those whose h is also that of a neighbour."""
        held = None  # the last row, and whether it was handed on
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            if held is not None:
                t = pa.concat_tables([held[0], t])
            h = t.column("h").to_numpy()
            equal = h[1:] == h[:-1]
            keep = np.zeros(len(h), bool)
            keep[1:] |= equal
            keep[:-1] |= equal
            if held is not None and held[1]:
                keep[0] = False  # handed on before
            last = bool(keep[-1]) or bool(held is not None and held[1] and len(h) == 1)
            yield from t.filter(pa.array(keep)).to_batches()
            held = (t.slice(len(h) - 1), last)

    arrow_limits(docs.sparkSession)
    rows = docs.filter("doc_id is not null").select(same_text().alias("same"), "text")
    kind = "h bigint, same bigint, place bigint"
    sent = rows.select("same", "text").mapInArrow(heads, kind)
    arrow_limits(docs.sparkSession, 20_000)
    met = sent.repartition("h").sortWithinPartitions("h").mapInArrow(several, kind)
    n = F.shiftright("place", 31)
    return written(met.select("h", "same", n.cast("int").alias("n"), (F.col("place") - F.shiftleft(n, 31)).cast("int").alias("at")).distinct())


def _joined(parts: DataFrame, links: DataFrame) -> tuple[DataFrame, bool]:
    """parts (same, part) with the parts that links (a, b of parts) tie together joined; whether any
    were."""
    tied = components(links)
    some = not tied.isEmpty()
    if not some:
        return parts, False
    new = parts.join(tied.withColumnRenamed("node", "part"), "part", "left").select("same", F.coalesce("root", "part").alias("part"))
    return written(new), True


def _fits(similarity: float) -> Column:
    """Sizes of x and y that can reach the similarity, with enough shingles behind the shared one: at
    the first that two sets share, what follows must do."""
    near = (F.col("x.n") >= F.col("y.n") * similarity - 1e-9) & (F.col("y.n") >= F.col("x.n") * similarity - 1e-9)
    follows = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    return near & (follows >= similarity / (1 + similarity) * (F.col("x.n") + F.col("y.n")) - 1e-9)


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 4, rounds: int = 4) -> DataFrame:
    """doc_id, same, component_id, first_same: the smallest doc_id of the group, and of that one's
    texts the smallest `same`. A row per different (doc_id, text)."""
    members, texts = _texts(docs, shingle)
    parts = texts.select("same", F.col("same").alias("part"))
    found = _checked(_by_simhash(texts, radius), texts, docs, shingle, similarity)
    parts, _ = _joined(parts, found)
    met = _met(docs, shingle, similarity)
    for i in range(rounds):
        # Of each shingle one text is the centre of a star, by a hash that differs with the round
        # and with a few classes of shingles, so that large groups are met most often.
        own = met.join(parts, "same").withColumn("k", F.xxhash64("same", F.pmod("h", F.lit(CENTRES)), F.lit(i)))
        least = own.groupBy("h").agg(F.min(F.struct("k", "part", "same", "n", "at")).alias("c"), F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo < hi")
        x, y = own.alias("x"), least.select("h", "c.*").alias("y")
        stars = written(
            x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.part") != F.col("y.part")) & _fits(similarity))
            # A text and a group once.
            .groupBy(F.col("x.same").alias("a"), F.col("x.part").alias("p"), F.col("y.part").alias("q"))
            .agg(F.min(F.col("y.same")).alias("b"))
            .select("a", "b", "p", "q")
        )
        if stars.isEmpty():
            break
        good = _checked(stars, texts, docs, shingle, similarity)
        parts, some = _joined(parts, good.select(F.col("p").alias("a"), F.col("q").alias("b")))
        if not some:
            break
    # A part of the pairs first, which ties most of what is left, then all.
    for share in (16, 1):
        own = written(met.join(parts, "same"))
        x, y = own.alias("x"), own.alias("y")
        some_ = F.pmod(F.xxhash64("x.same", "y.same"), F.lit(share)) == 0
        pairs = written(
            x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.part") < F.col("y.part")) & some_ & _fits(similarity))
            .select(F.col("x.same").alias("a"), F.col("y.same").alias("b"), F.col("x.part").alias("p"), F.col("y.part").alias("q"))
            .distinct()
        )
        if not pairs.isEmpty():
            good = _checked(pairs, texts, docs, shingle, similarity)
            parts, _ = _joined(parts, good.select(F.col("p").alias("a"), F.col("q").alias("b")))
    named = parts.join(texts.select("same", "first_id"), "same")
    least = named.groupBy("part").agg(F.min(F.struct("first_id", "same")).alias("m"))
    of_text = named.select("same", "part").join(least, "part").select("same", F.col("m.first_id").alias("component_id"), F.col("m.same").alias("first_same"))
    return members.distinct().join(of_text, "same").select("doc_id", "same", "component_id", "first_same")


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: of each group of near-duplicates one row, that of the smallest
    doc_id; all rows without a doc_id. All columns, and what is dropped is what moves: rows that
    stay are not shuffled as long as the dropped ones are few enough to be sent to them."""
    groups = written(near_duplicates(docs))
    gone = groups.filter("not (doc_id = component_id and same = first_same)").select(F.col("doc_id").alias("_d"), F.col("same").alias("_s"))
    gone = written(gone)
    if gone.count() <= SENT:
        gone = F.broadcast(gone)
    rows = docs.withColumn("_same", F.when(F.col("doc_id").isNotNull(), same_text()))
    left = rows.join(gone, (F.col("doc_id") == F.col("_d")) & (F.col("_same") == F.col("_s")), "left_anti")
    # Rows repeated under one id: few, and one of them stays.
    counted = rows.filter("doc_id is not null").groupBy("doc_id", "_same").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = written(counted.select(F.col("doc_id").alias("_d"), F.col("_same").alias("_s")))
    on = (F.col("doc_id") == F.col("_d")) & (F.col("_same") == F.col("_s"))
    if again.isEmpty():
        return left.select(*docs.columns)
    single = left.join(again, on, "left_anti")
    return single.unionByName(left.join(again, on, "left_semi").dropDuplicates(["doc_id", "_same"])).select(*docs.columns)
