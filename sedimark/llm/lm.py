"""Language-model scores by a weighted backoff automaton.

States are the empty history, all training words, and all pairs of words that occur at least
`MINIMUM` times. A state has an arc for each word that follows it at least `MINIMUM` times; a word
without an arc takes the failure arc, with the state's weight, to the state of the history without
its first word, in the end to the empty one, where every word has its add-one probability. Counts
are discounted by `DISCOUNT` and interpolated: a state's failure weight is the mass that its arcs
leave, and an arc has its discounted share plus that weight times what the shorter history gives.
So the probabilities of each state sum to one. `MINIMUM` is the same for a corpus of any size: what
the model gathers grows with the corpus.

The automaton is never in one place. Documents are cut into blocks of about `BLOCK` tokens. A block
sends each of its n-grams once, with its training count, to the bucket of the n-gram's history; the
bucket adds the counts up, finds the arcs, and answers every block with the states and arcs that
its texts can reach. The block then walks its texts from left to right. N-grams travel as sorted
columns of word numbers, compressed, a row per block and bucket.

Hot histories. The arcs of words and pairs of at least a share `HOT` of all tokens (at most
3 / HOT of them: a pair with that share of all has half of it in blocks that hold at least
1 / 2 of that share in them) go to buckets by the whole n-gram; their sums are broadcast.
Words: the 1 / FLOOR most frequent ones at most have numbers, which every executor gets; others are
told apart by XXH64, pairs and triples by rotated hashes XORed. FLOOR, HOT and BLOCK change no score.
Counts are exact and over the whole training part.

Tokens: A-Z lower-cased, runs of bytes other than ASCII white space, then one end.

Edge cases. Null or empty text: the end token alone. Null doc_id: not held out. Repeated rows:
each trains and is scored. No training documents: every token has probability one. Empty input:
empty result. Other columns are ignored.
"""

from __future__ import annotations

import struct
from collections import Counter
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.llm.common import arrow_limits, written

FLOOR = 5e-7  # at most two million words have numbers
HOT = 1e-4
BLOCK = 500_000  # tokens
MINIMUM = 2  # count from which an n-gram has an arc, in a corpus of any size
DISCOUNT = 0.5
_PART = 3_000_000  # tokens a task
_END, _START = 0x2545F4914F6CDD1D, 0x1D8E4E27C47D124F  # in place of a hash
_TURN_PAIR, _TURN_TRIPLE = 23, 17


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _hash(word: bytes) -> int:
    h = xxhash.xxh64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def _joined(a: np.ndarray, b: np.ndarray, turn: int) -> np.ndarray:
    """The key of a pair from its words', of a triple from its pairs'."""
    b = b.view(np.uint64)
    return a ^ ((b << np.uint64(turn)) | (b >> np.uint64(64 - turn))).view(np.int64)


def _among(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The place of each key in a sorted table, -1 for others."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of integers from 0 to 2^63, each as its lowest bytes, then the next ones; zstd."""
    head, body = [struct.pack("<B", len(arrays))], []
    for a in arrays:
        a = np.ascontiguousarray(a, "<i8")
        width = 8 if len(a) and a.min() < 0 else (int(a.max()).bit_length() + 7) // 8 if len(a) else 0
        head.append(struct.pack("<QB", len(a), width))
        body.append(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    return zstandard.compress(b"".join(head + body), 3)


def unpacked(blob: bytes) -> list[np.ndarray]:
    blob = zstandard.decompress(blob)
    n, at, out = blob[0], 1 + 9 * blob[0], []
    for i in range(n):
        size, width = struct.unpack_from("<QB", blob, 1 + 9 * i)
        a = np.zeros((size, 8), np.uint8)
        a[:, :width] = np.frombuffer(blob, np.uint8, size * width, at).reshape(width, size).T
        out.append(a.view("<i8").reshape(-1))
        at += size * width
    return out


class Lookup:
    """bigint -> position among the keys it was made of, -1 for others: open addressing."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.value = np.full(1 << self.bits, -1, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.value[slot] < 0
            at, first = np.unique(slot[free], return_index=True)
            who = left[free][first]
            self.keys[at], self.value[at] = keys[who], who
            rest = np.ones(len(left), bool)
            rest[np.flatnonzero(free)[first]] = False
            left, slot = left[rest], (slot[rest] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = self.value[slot]
        wrong = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & (len(self.keys) - 1)
            out[wrong] = self.value[slot[wrong]]
            wrong = wrong[(out[wrong] >= 0) & (self.keys[slot[wrong]] != keys[wrong])]
        return out


@dataclass
class Vocabulary:
    """Numbers: 0.. for words in the order of `hashes`, then the end, then the start, then, in each
    block anew, words that have no number of their own."""

    hashes: np.ndarray
    counts: np.ndarray  # of numbered words, the end, the start
    tokens: int
    distinct: int
    complete: bool  # words without a number are in no arc
    hot: dict[int, np.ndarray] = field(default_factory=dict)  # size: sorted keys of hot histories

    @property
    def end(self) -> int:
        return len(self.hashes)

    def all_hashes(self, others: np.ndarray) -> np.ndarray:
        return np.concatenate([self.hashes, [_END, _START], others])


class _Numbered(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


class Reader:
    """Texts as word numbers. Words without a number get one until the next reset."""

    def __init__(self, vocabulary: Vocabulary, most: int = 400_000):
        self.known, self.most = Lookup(vocabulary.hashes), most
        self.first = vocabulary.end + 2
        self.reset()

    def reset(self):
        self.seen = _Numbered()
        self.number_of = np.zeros(0, np.int64)  # of seen words
        self.others = np.zeros(0, np.int64)  # hashes

    def texts(self, texts: list[str | None]) -> list[np.ndarray]:
        look, read = self.seen.__getitem__, []
        for t in texts:
            ws = words(t)
            read.append(np.fromiter(map(look, ws), np.int64, len(ws)))
        if fresh := list(islice(self.seen, len(self.number_of), None)):
            hashes = np.array([_hash(w) for w in fresh], np.int64)
            numbers = self.known(hashes).astype(np.int64)
            new = np.flatnonzero(numbers < 0)
            numbers[new] = self.first + len(self.others) + np.arange(len(new))
            self.number_of = np.concatenate([self.number_of, numbers])
            self.others = np.concatenate([self.others, hashes[new]])
        return [self.number_of[r] for r in read]


def _walk(stream: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """Start, words, end of each text in turn."""
    n = np.full(len(stream) + 2 * len(sizes), -1)
    ends = np.cumsum(sizes + 2) - 1
    n[ends], n[ends - sizes - 1] = end, end + 1
    n[n < 0] = stream
    return n


class Grams:
    """The different n-grams of a block by size, in the order in which they are sent: by bucket,
    then by word numbers. `at` has the n-gram that ends at each place, -1 for none that is sent. The
    start in the last place stands for all words that no arc can have: they ask for the state."""

    def __init__(self, n: np.ndarray, others: np.ndarray, v: Vocabulary, buckets: int):
        hashes, start, first = v.all_hashes(others), v.end + 1, v.end + 2
        self.columns, self.at, self.bucket, self.history, self.run = {}, {}, {}, {}, {}
        self.no_word, bits = start, max(1, int(len(hashes)).bit_length())
        numbers, sent = n, n != start
        if v.complete:  # other words leave states by failure arcs alone
            sent[1:] &= n[:-1] < first
            n = np.where(n < first, n, start)
        three = sent.copy()
        three[1:] &= sent[:-1]
        p = np.flatnonzero(sent)
        pairs, inverse = np.unique((n[p - 1] << bits) | n[p], return_inverse=True)
        a, b = pairs >> bits, pairs & ((1 << bits) - 1)
        keys = _joined(hashes[a], hashes[b], _TURN_PAIR)
        self.pair_at = np.full(len(n), -1)  # in the order of words
        self.pair_at[p] = inverse
        order = self._order(2, hashes[a], keys, v, buckets, a)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.columns[2] = [a[order], b[order]]
        self.at[2] = np.full(len(n), -1)
        self.at[2][p] = back[inverse]

        p = np.flatnonzero(three)
        bits = max(1, int(len(pairs)).bit_length())
        triples, inverse = np.unique((self.pair_at[p - 1] << bits) | self.pair_at[p], return_inverse=True)
        x, y = triples >> bits, triples & ((1 << bits) - 1)
        order = self._order(3, keys[x], _joined(keys[x], keys[y], _TURN_TRIPLE), v, buckets, x)
        again = np.empty(len(order), np.int64)
        again[order] = np.arange(len(order))
        x, y = x[order], y[order]
        self.columns[3] = [a[x], b[x], b[y]]
        self.at[3] = np.full(len(n), -1)
        self.at[3][p] = again[inverse]

        self.columns[1] = [np.arange(len(others)) + first]
        order = self._order(1, others, others, v, buckets, np.arange(len(others)))
        self.columns[1] = [self.columns[1][0][order]]
        self.word_order = order
        self.at[1] = np.full(len(n), -1)
        again = np.empty(len(order), np.int64)
        again[order] = np.arange(len(order))
        self.at[1][numbers >= first] = again[numbers[numbers >= first] - first]

    def _order(self, size, history, keys, v, buckets, number) -> np.ndarray:
        hot = _among(history, v.hot.get(size, np.zeros(0, np.int64))) >= 0
        mixed = np.where(hot, keys, history).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        bucket = ((mixed >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, number = bucket[order], number[order]
        self.bucket[size], self.history[size] = bucket, history[order]
        # Runs of one history within a bucket: what states are answered for.
        new = np.ones(len(order), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (number[1:] != number[:-1])
        self.run[size] = np.cumsum(new) - 1
        return order

    def counts(self, size: int, train: np.ndarray) -> np.ndarray:
        at = self.at[size]
        c = np.bincount(at[(at >= 0) & train], minlength=len(self.bucket[size]))
        return np.where(self.columns[size][-1] == self.no_word, 0, c)


def blocks(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """block, blob (word numbers, sizes of texts, hashes of words without a number), doc_ids, held;
    hot: pairs that make up half of HOT of the block's training part. Written."""
    shared, kind = docs.sparkSession.sparkContext.broadcast(v), docs.schema["doc_id"].dataType.simpleString()
    half, most = HOT / 2, BLOCK

    def run(batches):
        v = shared.value
        reader, row = Reader(v), TaskContext.get().partitionId() << 32
        kept, ids, held, size = [], [], [], 0

        def block():
            sizes = np.array([len(k) for k in kept], np.int64)
            stream = np.concatenate(kept) if kept else np.zeros(0, np.int64)
            rare, first = stream >= reader.first, reader.first
            used, local = np.unique(stream[rare], return_inverse=True)
            stream = stream.copy()
            stream[rare] = first + local
            others = reader.others[used - first]
            hashes, outside = v.all_hashes(others), np.concatenate(held)
            n = _walk(stream, sizes, v.end)
            train = np.repeat(~outside, sizes + 2)
            p = np.flatnonzero((n != v.end + 1) & train)
            pairs, c = np.unique((n[p - 1] << 32) | n[p], return_counts=True)
            often = c >= half * len(p)
            pairs, c = pairs[often], c[often]
            keys = _joined(hashes[pairs >> 32], hashes[pairs & 0xFFFFFFFF], _TURN_PAIR)
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([row], pa.int64()),
                    pa.array([packed(stream, sizes, others)], pa.binary()),
                    one(pa.concat_arrays(ids)),
                    one(pa.array(outside)),
                    one(pa.array(keys, pa.int64())),
                    one(pa.array(c, pa.int64())),
                ],
                ["block", "blob", "doc_ids", "held", "hot", "hot_c"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            kept += (read := reader.texts(batch.column("text").to_pylist()))
            ids.append(batch.column("doc_id"))
            held.append(batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool))
            size += sum(map(len, read))
            if size >= most:
                yield block()
                row, kept, ids, held, size = row + 1, [], [], [], 0
                if len(reader.seen) > reader.most:
                    reader.reset()
        if kept:
            yield block()

    schema = f"block bigint, blob binary, doc_ids array<{kind}>, held array<boolean>, hot array<bigint>, hot_c array<bigint>"
    arrow_limits(docs.sparkSession, 1000, "16m")
    return written(docs.select("doc_id", "held_out", "text").mapInArrow(run, schema))


def answers(of: DataFrame, shared, buckets: int, parts: int) -> DataFrame:
    """block, bucket, size, blob: for each n-gram that the block sent to the bucket its training
    count, 0 where it has no arc (words: any count), and for each history the sum of its arcs'
    counts and their number; and h, s, m: the sums of a bucket for each hot history. Written."""

    def send(batches):
        v = shared.value
        for batch in batches:
            for block, blob, held in zip(batch.column("block").to_pylist(), batch.column("blob"), batch.column("held")):
                stream, sizes, others = unpacked(blob.as_py())
                outside = np.array(held.as_py(), bool)
                n, train = _walk(stream, sizes, v.end), np.repeat(~outside, sizes + 2)
                grams = Grams(n, others, v, buckets)
                rows = []
                for size in (1, 2, 3):
                    counts, bucket, first = grams.counts(size, train), grams.bucket[size], v.end + 2
                    cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)) if len(bucket) else [0]
                    for lo, hi in zip(cuts[:-1], cuts[1:]):
                        columns = [c[lo:hi] for c in grams.columns[size]]
                        used = np.unique(np.concatenate([c[c >= first] for c in columns]))
                        for c in columns:
                            rare = c >= first
                            c[rare] = first + np.searchsorted(used, c[rare])
                        columns[0] = np.diff(columns[0], prepend=0)
                        rows.append((int(bucket[lo]), size, packed(counts[lo:hi], others[used - first], *columns)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block] * len(rows), pa.int64()),
                        pa.array([r[0] for r in rows], pa.int32()),
                        pa.array([r[1] for r in rows], pa.int8()),
                        pa.array([r[2] for r in rows], pa.binary()),
                    ],
                    ["block", "bucket", "size", "blob"],
                )

    def add(size: int, got: list[tuple], v: Vocabulary):
        keys, histories, counts, runs, numbered = [], [], [], [], v.all_hashes(np.zeros(0, np.int64))
        for _, blob in got:
            c, others, *columns = unpacked(blob)
            columns[0] = np.cumsum(columns[0])
            h = [numbered[np.minimum(x, v.end + 1)] for x in columns]
            for known, x in zip(h, columns):
                rare = x > v.end + 1
                known[rare] = others[x[rare] - v.end - 2]
            history, key, new = h[0], h[0], np.ones(len(c), bool)
            new[1:] = np.diff(columns[0]) != 0
            if size > 1:
                key = _joined(h[0], h[1], _TURN_PAIR)
            if size > 2:
                history, key = key, _joined(key, _joined(h[1], h[2], _TURN_PAIR), _TURN_TRIPLE)
                new[1:] |= np.diff(columns[1]) != 0
            keys.append(key)
            histories.append(history)
            counts.append(c)
            runs.append(new)
        _, at, back = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        c = np.bincount(back, np.concatenate(counts)).astype(np.int64)
        histories, runs = np.concatenate(histories), np.concatenate(runs)
        sums = ()
        if size > 1:
            c[c < MINIMUM] = 0
            h, of = np.unique(histories[at], return_inverse=True)
            s, m = (np.bincount(of, x, minlength=len(h)).astype(np.int64) for x in (c, c > 0))
            state = np.searchsorted(h, histories[runs])
            ends = np.cumsum([len(k) for k in keys])
            run_ends = np.cumsum(runs)[ends - 1]
            hot = np.flatnonzero((_among(h, v.hot[size]) >= 0) & (m > 0))
            sums = h[hot], s[hot], m[hot]
        lo = run_lo = 0
        blobs = []
        for i, k in enumerate(keys):
            own = [c[back[lo : lo + len(k)]]]
            lo += len(k)
            if size > 1:
                own += [s[state[run_lo : run_ends[i]]], m[state[run_lo : run_ends[i]]]]
                run_lo = run_ends[i]
            blobs.append(packed(*own))
        return [b for b, _ in got], blobs, sums

    def reduce(batches):
        v = shared.value

        def rows(bucket, size, got):
            to, blobs, sums = add(size, got, v)
            none = lambda k, n: pa.nulls(n, k)
            names = ["block", "bucket", "size", "blob", "h", "s", "m"]
            n = len(to)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(to, pa.int64()), pa.array([bucket] * n, pa.int32()), pa.array([size] * n, pa.int8()),
                    pa.array(blobs, pa.binary()), *[none(pa.int64(), n)] * 3,
                ],
                names,
            )
            if sums and len(sums[0]):
                n = len(sums[0])
                yield pa.RecordBatch.from_arrays(
                    [
                        none(pa.int64(), n), none(pa.int32(), n), pa.array([size] * n, pa.int8()), none(pa.binary(), n),
                        *(pa.array(x, pa.int64()) for x in sums),
                    ],
                    names,
                )

        now, got = None, []
        for batch in batches:
            for bucket, size, block, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "size", "block", "blob"))):
                if (bucket, size) != now:
                    if got:
                        yield from rows(*now, got)
                    now, got = (bucket, size), []
                got.append((block, blob))
        if got:
            yield from rows(*now, got)

    return written(
        of.select("block", "blob", "held")
        .mapInArrow(send, "block bigint, bucket int, size tinyint, blob binary")
        .repartition(parts, "bucket")
        .sortWithinPartitions("bucket", "size")
        .mapInArrow(reduce, "block bigint, bucket int, size tinyint, blob binary, h bigint, s bigint, m bigint")
    )


def walked(of: DataFrame, found: DataFrame, shared, sums: dict, buckets: int, parts: int) -> DataFrame:
    """A row per document of the blocks: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score."""
    kind = of.schema["doc_ids"].dataType.elementType.simpleString()

    def result(ids, held, blob, got, v: Vocabulary):
        stream, sizes, others = unpacked(blob)
        n = _walk(stream, sizes, v.end)
        grams = Grams(n, others, v, buckets)
        told: dict = {1: ([], [], []), 2: ([], [], []), 3: ([], [], [])}
        for size, answer in got:  # in the order of buckets
            for into, x in zip(told[size], unpacked(answer)):
                into.append(x)
        joined = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
        rare = np.zeros(len(others), np.int64)
        rare[grams.word_order] = joined(told[1][0])
        counts = np.concatenate([v.counts, rare])
        own = counts[n]
        base = (own + 1) / (v.tokens + v.distinct + 1)
        p, of_history = base.copy(), np.zeros(len(n))
        of_history[1:] = own[:-1]  # count of the word before, then of the pair before
        for size in (2, 3):
            c, s, m = (joined(x) for x in told[size])
            run = grams.run[size]
            if len(run):
                history = np.zeros(run[-1] + 1, np.int64)
                history[run] = grams.history[size]
                h, total, number = sums[size]
                hot = _among(history, v.hot[size])
                at = _among(history, h)
                s = np.where(hot >= 0, np.where(at >= 0, total[at] if len(h) else 0, 0), s)
                m = np.where(hot >= 0, np.where(at >= 0, number[at] if len(h) else 0, 0), m)
            where = np.flatnonzero((grams.at[size] >= 0) & (of_history > 0))
            g = grams.at[size][where]
            left = 1 - (s[run[g]] - DISCOUNT * m[run[g]]) / of_history[where]
            arc = np.where(c[g] > 0, c[g] - DISCOUNT, 0) / of_history[where]
            p[where] = arc + left * p[where]
            pair = np.zeros(len(n))
            pair[grams.at[size] >= 0] = c[grams.at[size][grams.at[size] >= 0]]
            of_history[1:] = pair[:-1]
        real = n != v.end + 1
        places = np.cumsum(sizes + 2) - sizes - 2
        total = lambda x: np.add.reduceat(np.where(real, x, 0), places)
        return pa.RecordBatch.from_arrays(
            [
                ids, held, pa.array(sizes + 1), pa.array(total((own > 0).astype(np.int64))),
                pa.array(np.full(len(sizes), v.tokens)), pa.array(total(np.log10(base))), pa.array(total(np.log10(p))),
            ],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    def run(batches):
        v, now = shared.value, None
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column("size")[i].as_py() == 0:
                    if now:
                        yield result(*now, v)
                    now = batch.column("doc_ids")[i].values, batch.column("held")[i].values, batch.column("blob")[i].as_py(), []
                else:
                    now[3].append((batch.column("size")[i].as_py(), batch.column("blob")[i].as_py()))
        if now:
            yield result(*now, v)

    own = of.select("block", F.lit(-1).alias("bucket"), F.lit(0).cast("tinyint").alias("size"), "blob", "doc_ids", "held")
    return (
        own.unionByName(found.filter("h is null").select("block", "bucket", "size", "blob"), allowMissingColumns=True)
        .repartition(parts, "block")
        .sortWithinPartitions("block", "bucket", "size")
        .mapInArrow(
            run,
            f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
            "base_score double, score double",
        )
    )


def word_counts(train: DataFrame) -> DataFrame:
    """w (hash), c: the training count of each word, written."""

    def run(batches):
        def rows(count):
            return pa.RecordBatch.from_arrays(
                [pa.array([_hash(w) for w in count], pa.int64()), pa.array(list(count.values()), pa.int64())],
                ["w", "c"],
            )

        count: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                count.update(words(text.as_py()))
            if len(count) > 600_000:
                yield rows(count)
                count.clear()
        yield rows(count)

    arrow_limits(train.sparkSession, 1000, "16m")
    return written(
        train.select("text")
        .mapInArrow(run, "w bigint, c bigint")
        .groupBy("w")
        .agg(F.sum("c").alias("c"))
    )


def vocabulary(train: DataFrame) -> Vocabulary:
    table, texts = word_counts(train), train.count()
    steps = [max(MINIMUM, 1 << j) for j in range(1, 45)]
    one = table.agg(
        F.count(F.lit(1)).alias("distinct"),
        F.coalesce(F.sum("c"), F.lit(0)).alias("tokens"),
        F.array(*(F.count_if(F.col("c") >= s) for s in steps)).alias("above"),
    ).first()
    bound = next(s for s, n in zip(steps, one.above) if n <= 1 / FLOOR)
    often = table.filter(F.col("c") >= bound).toArrow()
    w, c = (often.column(x).to_numpy() for x in ("w", "c"))
    order = np.lexsort((w, -c))
    hashes, counts = w[order], np.append(c[order], [texts, texts])
    v = Vocabulary(hashes, counts, one.tokens + texts, one.distinct + (texts > 0), bound <= MINIMUM)
    v.hot[2] = np.sort(v.all_hashes(np.zeros(0, np.int64))[counts >= HOT * max(1, v.tokens)])
    return v


def score(docs: DataFrame) -> DataFrame:
    """All of docs (doc_id, text, held_out) scored by a model of those that aren't held out."""
    sc = docs.sparkSession.sparkContext
    v = vocabulary(docs.filter("not held_out").select("text"))
    of = blocks(docs, v)
    hot = (
        of.select(F.explode(F.arrays_zip("hot", "hot_c")).alias("x"))
        .groupBy("x.hot")
        .agg(F.sum("x.hot_c").alias("c"))
        .filter(F.col("c") >= HOT / 2 * max(1, v.tokens))
    )
    v.hot[3] = np.sort(hot.select("hot").toArrow().column(0).to_numpy())
    parts = max(1, -(-v.tokens // _PART))
    buckets = 4 * parts
    shared = sc.broadcast(v)
    found = answers(of, shared, buckets, parts)
    summed = found.filter("h is not null").groupBy("size", "h").agg(F.sum("s").alias("s"), F.sum("m").alias("m")).toArrow()
    sums = {}
    for size in (2, 3):
        rows = summed.filter(pc.equal(summed.column("size"), size)).sort_by("h")
        sums[size] = tuple(rows.column(x).to_numpy() for x in ("h", "s", "m"))
    return walked(of, found, shared, sums, buckets, parts)


def score_held_out(docs: DataFrame) -> DataFrame:
    """All documents scored by a model of those whose id's crc32 mod 7 isn't 2."""
    from sedimark.llm.language import held_out

    return score(docs.select("doc_id", "text", held_out(parts=7, part=2).alias("held_out")))
