"""Language identification by prediction by partial matching.

For each language the labelled texts grow a context tree of bytes, three deep: how often each
symbol followed each context. A symbol seen n times in a context that was left t times towards d
different symbols has probability n / (t + d); the rest, d / (t + d), is the escape to the context
one byte shorter, in the end to a uniform choice. Statistics are frozen after training. A text's
code length under a language is the sum of its symbols' code lengths; the shortest wins.

Symbols are the 256 bytes of the lower-cased text, every run of what isn't a letter or a byte of one
being one space. Contexts are sparse tables of what the training sample has, so their size is bound
by the sample, whatever the corpus, and they are sent to each executor.

score is the posterior of the predicted language, all languages alike beforehand, given the mean
code lengths over at most `evidence` symbols; without that every text of some length has score 1.

Training reads a sample: the `sample` documents of each language with the smallest unsigned hash,
whole. Everything else reads all documents.

Edge cases. Null text or text without a letter: `und`, score 0. Null lang: not learned from. No
usable training text: everything is `und`. Ties of code length: the first name. Null doc_id:
scored, never held out. Columns named lang_pred, score or bits_per_symbol are replaced, others kept.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimark.llm.common import arrow_limits

SYMBOLS, DEPTH = 256, 3
_CLEAN = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))
_RUNS = re.compile(rb" {2,}")
_LETTER = re.compile(r"[^\W\d_]").search


def normal(text: str) -> bytes:
    raw = text.lower().encode("utf-8", "surrogatepass").translate(_CLEAN)
    return _RUNS.sub(b" ", raw).strip(b" ")


class Trees:
    """The frozen trees of all languages."""

    def __init__(self, texts: list[tuple[str, str]]):
        self.languages = sorted({lang for lang, _ in texts})
        raw = [(lang, normal(text)) for lang, text in texts]
        windows = [np.concatenate([self.windows(t) for own, t in raw if own == lang]) for lang in self.languages]
        # For each depth: keys of the known windows and their bits, keys of the known contexts and
        # the bits of an escape, by language. All escapes are in a known window's bits.
        self.levels = []
        for depth in range(DEPTH + 1):
            counted = [np.unique(w & ((1 << 8 * (depth + 1)) - 1), return_counts=True) for w in windows]
            if not counted:
                break
            keys = np.unique(np.concatenate([k for k, _ in counted]))
            if not len(keys):
                break
            contexts = np.unique(keys >> 8)
            place = np.searchsorted(contexts, keys >> 8)
            escapes, own = np.zeros((len(contexts), len(counted))), np.zeros((len(keys), len(counted)))
            shorter = self._resolved(keys)
            for i, (k, c) in enumerate(counted):
                n = np.zeros(len(keys))
                n[np.searchsorted(keys, k)] = c
                t = np.bincount(place, n, len(contexts))
                d = np.bincount(place, n > 0, len(contexts))
                escapes[:, i] = np.log2(np.where(t > 0, (t + d) / np.maximum(d, 1), 1))
                inside = np.log2(np.maximum((t + d)[place], 1) / np.maximum(n, 1))
                own[:, i] = np.where(n > 0, inside, escapes[place, i] + shorter[:, i])
            self.levels.append((keys, own, contexts, escapes))

    def windows(self, text: bytes) -> np.ndarray:
        """For each byte its number together with the three before it."""
        s = np.full(len(text) + DEPTH, 0x20, np.int64)
        s[DEPTH:] = np.frombuffer(text, np.uint8)
        at = s[: len(text)].copy()
        for i in range(1, DEPTH + 1):
            at = (at << 8) | s[i : i + len(text)]
        return at

    def _resolved(self, windows: np.ndarray) -> np.ndarray:
        """Bits of each window's last byte under each language, by the levels that there are."""
        out = np.zeros((len(windows), len(self.languages)))
        left = np.arange(len(windows))
        for depth in reversed(range(len(self.levels))):
            keys, own, contexts, escapes = self.levels[depth]
            w = windows[left] & ((1 << 8 * (depth + 1)) - 1)
            at = np.minimum(np.searchsorted(keys, w), len(keys) - 1)
            known = keys[at] == w
            out[left[known]] += own[at[known]]
            left, w = left[~known], w[~known] >> 8
            at = np.minimum(np.searchsorted(contexts, w), len(contexts) - 1)
            met = contexts[at] == w
            out[left[met]] += escapes[at[met]]
        out[left] += np.log2(SYMBOLS)
        return out

    def code_lengths(self, text: bytes, chunk: int = 1 << 18) -> np.ndarray:
        """Bits under each language, over the whole text."""
        total = np.zeros(len(self.languages))
        for i in range(0, len(text), chunk):
            back = min(i, DEPTH)
            at = self.windows(text[i - back : i + chunk])[back:]
            different, n = np.unique(at, return_counts=True)
            total += n @ self._resolved(different)
        return total


def labelled_sample(docs: DataFrame, sample: int) -> list[tuple[str, str]]:
    """(lang, text), at most `sample` for each language."""
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    key = F.xxhash64("doc_id", F.lit(11))
    counts = usable.groupBy("lang").count().collect()  # a row per language
    if not counts:
        return []
    # Twice the wanted share of each language by hash, then exactly `sample` of these.
    share = F.create_map(
        *(x for r in counts for x in (F.lit(r.lang), F.lit(min(1.0, (2 * sample + 50) / r["count"]))))
    )
    some = usable.filter(
        F.shiftrightunsigned(key, 11) / float(1 << 53) < F.element_at(share, F.col("lang"))
    )
    order = Window.partitionBy("lang").orderBy(F.shiftrightunsigned(key, 11), "doc_id", "text")
    chosen = some.select("lang", "text", F.row_number().over(order).alias("r"))
    return [(r.lang, r.text) for r in chosen.filter(F.col("r") <= sample).collect()]


def fit(docs: DataFrame, sample: int = 300) -> Trees:
    return Trees(labelled_sample(docs, sample))


def identify(docs: DataFrame, trees: Trees, evidence: int = 40) -> DataFrame:
    """All columns of docs, lang_pred, score, bits_per_symbol."""
    spark = docs.sparkSession
    docs = docs.drop("lang_pred", "score", "bits_per_symbol")
    shared = spark.sparkContext.broadcast(trees)

    def run(batches):
        model = shared.value
        for batch in batches:
            names, scores, rates = [], [], []
            for text in batch.column("text"):
                text = text.as_py()
                raw = normal(text) if text and model.languages and _LETTER(text) else b""
                if not raw:
                    names.append("und")
                    scores.append(0.0)
                    rates.append(None)
                    continue
                bits = model.code_lengths(raw)
                best = int(bits.argmin())
                worse = (bits - bits[best]) / len(raw) * min(len(raw), evidence)
                names.append(model.languages[best])
                scores.append(float(1 / np.exp2(-worse).sum()))
                rates.append(float(bits[best] / len(raw)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())],
                [*batch.schema.names, "lang_pred", "score", "bits_per_symbol"],
            )

    arrow_limits(spark)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, lang_pred string, score double, bits_per_symbol double")


def held_out(doc_id: str = "doc_id", parts: int = 5, part: int = 0) -> Column:
    """crc32 of doc_id as text falls on `part`; a null doc_id doesn't."""
    return F.coalesce(
        F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(False)
    )


def identify_held_out(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: trees from what isn't held out, over all documents."""
    own = docs.select("doc_id", "text", "lang")
    trees = fit(own.filter(~held_out()))
    found = identify(own.select("doc_id", "text"), trees)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
