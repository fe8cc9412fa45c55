"""Quality by importance resampling over hashed n-grams.

Two generative models of a text as a set of hashed n-grams are fitted on labelled documents: one
of target text (good and not toxic), one of raw text (all labelled documents, as they come). Their
log ratio is a document's importance weight: high for what the target would rather write, far
below zero for a text with n-grams that the target avoids. Each bucket of the target model is
drawn towards the raw model with the strength of `prior` n-grams, so buckets with little evidence
say nothing. An n-gram counts once in a text, and equal texts once in the models.

N-grams are of words in lower case, of their shapes (runs of upper, lower, digit and each other
character), of pairs of shapes, and of a mark for a word that repeats one of the four before it.

Sampling is Gumbel top-k: log weight plus Gumbel noise from a hash of the id, the k largest kept.
Rejecting is a threshold on the weight and one on the part of it from n-grams that the target
avoids, both set on labelled documents that the models haven't seen.

The models are fitted on at most `sample` labelled documents (those with the smallest hash of
their id); everything else runs over all documents.

Edge cases. Null or empty text: weight 0 and rejected by `accepted`. Null labels: not learned
from. Null doc_id: weighed, its noise is that of a null. Ties of the sampling key: the smaller
doc_id. No labels: all weights are 0. Empty input: empty result. Columns named
log_weight, avoided or ngrams are replaced, others kept.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.llm.common import arrow_limits, written

BUCKETS = 1 << 18
_AVOIDED = -np.log(4)
_SHAPES = [(re.compile(p), s) for p, s in ((rb"[A-Z]+", b"A"), (rb"(?:[a-z]|[\x80-\xff])+", b"a"), (rb"[0-9]+", b"0"))]


class _Hasher:
    """Words to buckets, remembering frequent words."""

    def __init__(self, most: int = 200_000):
        self.known: dict[bytes, tuple[int, int]] = {}
        self.most = most

    def word(self, w: bytes) -> tuple[int, int]:
        """Buckets of the word and of its shape."""
        got = self.known.get(w)
        if got is None:
            shape = w
            for pattern, by in _SHAPES:
                shape = pattern.sub(by, shape)
            got = zlib.crc32(w.lower()) % BUCKETS, zlib.crc32(shape, 7) % BUCKETS
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[w] = got
        return got

    def ngrams(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").split()
        if not words:
            return np.zeros(0, np.int64)
        pairs = np.array(list(map(self.word, words)), np.int64)
        word, shape = pairs[:, 0], pairs[:, 1]
        again = np.zeros(len(word), bool)
        for back in range(1, 5):
            again[back:] |= word[back:] == word[:-back]
        marks = np.full(int(again.sum()), zlib.crc32(b"again", 9) % BUCKETS)
        two = (shape[1:] * 31 + shape[:-1] * 17 + 5) % BUCKETS
        return np.unique(np.concatenate([word, shape, two, marks]))


def counts(labelled: DataFrame) -> np.ndarray:
    """Of labelled (text, good): n-grams in target and in raw documents, by bucket: a table of
    fixed size, added up before it comes to the driver."""

    def run(batches):
        hasher, total = _Hasher(), np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for text, good in zip(batch.column(0), batch.column(1)):
                at = hasher.ngrams(text.as_py())
                total[1, at] += 1
                if good.as_py():
                    total[0, at] += 1
        used = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(total[0][used]), pa.array(total[1][used])], ["b", "t", "r"]
        )

    arrow_limits(labelled.sparkSession)
    rows = labelled.mapInArrow(run, "b bigint, t bigint, r bigint").groupBy("b")
    table = rows.agg(F.sum("t").alias("t"), F.sum("r").alias("r")).toArrow()
    out = np.zeros((2, BUCKETS), np.int64)
    at = table.column("b").to_numpy()
    out[0, at], out[1, at] = table.column("t").to_numpy(), table.column("r").to_numpy()
    return out


def log_ratios(found: np.ndarray, prior: float = 8.0) -> np.ndarray:
    """log p_target - log p_raw by bucket, the target model drawn to the raw one by `prior`
    n-grams in each bucket."""
    target, raw = found.astype(np.float64)
    if not target.sum():
        return np.zeros(BUCKETS)
    share = target.sum() / raw.sum()
    return np.log((target + prior * share) / ((raw + prior) * share))


def weighed(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """All columns of docs, log_weight, avoided (the part of it from n-grams that the target is
    less likely to write by a factor of four or more), ngrams (distinct ones)."""
    docs = docs.drop("log_weight", "avoided", "ngrams")
    shared = docs.sparkSession.sparkContext.broadcast(ratios.astype(np.float32))

    def run(batches):
        table, hasher = shared.value, _Hasher()
        for batch in batches:
            weights, avoided, n = [], [], []
            for text in batch.column("text"):
                each = table[hasher.ngrams(text.as_py())]
                weights.append(float(each.sum(dtype=np.float64)))
                avoided.append(float(each[each < _AVOIDED].sum(dtype=np.float64)))
                n.append(len(each))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(weights, pa.float64()), pa.array(avoided, pa.float64()), pa.array(n, pa.int64())],
                [*batch.schema.names, "log_weight", "avoided", "ngrams"],
            )

    arrow_limits(docs.sparkSession)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, log_weight double, avoided double, ngrams bigint")


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """text, good, check (a third is kept for the threshold): at most `sample` documents."""
    own = labels.filter("quality is not null and toxic is not null").select(
        F.col("doc_id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good")
    )
    n = own.count()
    order = F.xxhash64("doc_id", F.lit(23))
    if n > sample:
        own = own.orderBy(order, "doc_id").limit(sample)
    return (
        docs.select("doc_id", "text")
        .join(own, "doc_id")
        .select("text", "good", (F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(3)) == 0).alias("check"))
    )


def fit(docs: DataFrame, labels: DataFrame, sample: int = 12_000, keep: float = 0.995):
    """(log ratios by bucket, (threshold of log_weight, threshold of avoided)): each threshold
    loses at most 1 - keep of the good documents it is set on."""
    rows = written(labelled_sample(docs, labels, sample).dropDuplicates(["text"]))
    ratios = log_ratios(counts(rows.filter("not check").select("text", "good")))
    scored = weighed(rows.filter("check"), ratios).drop("text").toArrow()
    good = scored.column("good").to_numpy(zero_copy_only=False)
    if not good.any() or good.all():
        return ratios, (-np.inf, -np.inf)
    found, left = [], np.ones(len(good), bool)
    for name in ("log_weight", "avoided"):
        values = scored.column(name).to_numpy()
        found.append(_threshold(values[left & good], values[left & ~good], keep))
        left &= values >= found[-1]
    return ratios, tuple(found)


def _threshold(good: np.ndarray, bad: np.ndarray, keep: float) -> float:
    """Of the thresholds that keep a share of `keep` of the good values, the one with the fewest
    errors, a good one lost counting as ten bad ones kept."""
    highest = np.quantile(good, 1 - keep) if len(good) else -np.inf
    tries = np.concatenate([[-np.inf], np.unique(bad[bad < highest]) + 1e-6, [highest]])
    errors = [10 * (good < t).sum() + (bad >= t).sum() for t in tries]
    return float(tries[int(np.argmin(errors))])


def gumbel_top_k(weighed_docs: DataFrame, share: float, seed: int = 1, small: int = 50_000) -> DataFrame:
    """All columns, sampling_key, sampled: the floor(share * rows) rows with the largest keys.
    The last key that is still in is found by counting rows between quantiles, closer and closer,
    until few enough rows are left to be ordered."""
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) + 0.5) / float(1 << 53)
    rows = written(
        weighed_docs.withColumn("sampling_key", F.col("log_weight") - F.log(-F.log(u)))
    )
    n = rows.count()
    k = int(n * share)
    if k <= 0:
        return rows.withColumn("sampled", F.lit(False))
    left, rank = rows.select("sampling_key", "doc_id"), k
    while n > small:
        marks = left.agg(
            F.percentile_approx("sampling_key", [i / 64 for i in range(1, 64)], 10_000)
        ).first()[0]
        slot = F.size(F.filter(F.array(*map(F.lit, sorted(set(marks)))), lambda m: m <= F.col("sampling_key")))
        for r in left.groupBy(slot.alias("slot")).count().orderBy(F.desc("slot")).collect():
            if rank <= r["count"]:
                break
            rank -= r["count"]
        if r["count"] == n:  # all that is left is tied
            break
        left, n = left.filter(slot == r["slot"]), r["count"]
    order = [F.col("sampling_key").desc(), F.col("doc_id").asc_nulls_last()]
    edge = left.orderBy(*order).offset(rank - 1).limit(1).first()
    if edge.doc_id is None:
        not_after = F.lit(True)
    else:
        not_after = F.coalesce(F.col("doc_id") <= edge.doc_id, F.lit(False))
    return rows.withColumn(
        "sampled",
        (F.col("sampling_key") > edge.sampling_key)
        | ((F.col("sampling_key") == edge.sampling_key) & not_after),
    )


def weigh_and_sample(docs: DataFrame, labels: DataFrame, share: float = 0.5) -> DataFrame:
    """doc_id, log_weight, avoided, ngrams, accepted, sampling_key, sampled for each document."""
    ratios, thresholds = fit(docs, labels)
    found = weighed(docs.select("doc_id", "text"), ratios).drop("text")
    return gumbel_top_k(found, share).withColumn("accepted", accepted(thresholds))


def accepted(thresholds: tuple[float, float]):
    """Neither the whole weight nor what the target avoids is too low. A long text of ordinary
    n-grams would outweigh a few that the target never writes; hence the second part."""
    return (
        (F.col("ngrams") > 0)
        & (F.col("log_weight") >= thresholds[0])
        & (F.col("avoided") >= thresholds[1])
    )
