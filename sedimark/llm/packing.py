"""Concatenate and cut: documents end to end as one stream of token ids, cut every `length` ids.

First pass: a task tokenizes its documents one after the other and writes the ids with each
document's place behind those before it in the same task. The totals of the tasks, one row each,
give by their prefix sums the place at which a task's ids start in the whole stream. Second pass:
place and length of a document say where it is cut, without order or neighbours; a document that
crosses a boundary gives a piece on either side. Sequences are full but for the last one, so a
corpus of any size wastes less than one sequence.

Both passes are row by row: no key, and so no hot key. The first pass's table is in the shared
folder, so a lost executor costs its running tasks only.

Ids. Texts of code points below U+0250 without the special token go through the rank file of the
same vocabulary, which gives the same ids several times faster (a test holds one against the
other); all others through the tokenizer file itself.

Edge cases. Null or empty text: the end id alone. Repeated rows: packed as often as they occur.
Null doc_id: kept. Empty input: empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimark.llm.common import arrow_limits, written

LENGTH, END = 2048, 1
_PLAIN = re.compile(r"[\x00-ɏ]*\Z").match


@lru_cache(maxsize=2)
def _encoder(tokenizer: str, ranks: str | None):
    """text -> list of ids."""
    from tokenizers import Tokenizer

    whole = None

    def by_file(text):
        nonlocal whole
        if whole is None:
            whole = Tokenizer.from_file(tokenizer)
        return whole.encode(text, add_special_tokens=False).ids

    if not ranks:
        return by_file
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
    ).encode_ordinary

    def by_ranks(text):
        return fast(text) if _PLAIN(text) and "<|" not in text else by_file(text)

    return by_ranks


def default_paths() -> tuple[str, str]:
    import public_tokenizers as p

    return p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken")


def tokenized(docs: DataFrame, tokenizer: str, ranks: str | None, end_id: int) -> DataFrame:
    """doc_id, task, before (ids of the task's documents before this one), n, ids (binary,
    little-endian, 32 bits each)."""

    def run(batches):
        encode, task, before = _encoder(tokenizer, ranks), TaskContext.get().partitionId(), 0
        for batch in batches:
            n, start, ids = [], [], []
            for text in batch.column(1):
                found = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                start.append(before)
                n.append(len(found))
                before += len(found)
                ids.append(found.tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([task] * len(n), pa.int64()),
                    pa.array(start, pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                ["doc_id", "task", "before", "n", "ids"],
            )

    arrow_limits(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, task bigint, before bigint, n bigint, ids binary"
    )


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    ranks: str | None = None,
    length: int = LENGTH,
    end_id: int = END,
) -> DataFrame:
    """A row per piece: doc_id, start (ids of the document before it), length, ids (binary,
    little-endian, 32 bits each), doc_tokens, sequence_id, offset."""
    if tokenizer is None:
        tokenizer, ranks = default_paths()
    ids = written(tokenized(docs, tokenizer, ranks, end_id))
    totals = ids.groupBy("task").agg(F.sum("n").alias("total"))  # a row per task
    upto = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = totals.select("task", (F.sum("total").over(upto) - F.col("total")).alias("base"))
    # Two numbers for each task of the first pass: a few MB even for 100,000 tasks.
    placed = ids.join(F.broadcast(starts), "task").select(
        "doc_id", (F.col("base") + F.col("before")).alias("place"), "n", "ids"
    )
    last = F.floor((F.col("place") + F.col("n") - 1) / length)
    cut = placed.withColumn(
        "sequence_id", F.explode(F.sequence(F.floor(F.col("place") / length), last))
    )
    begin = F.greatest(F.col("place"), F.col("sequence_id") * length)
    stop = F.least(F.col("place") + F.col("n"), (F.col("sequence_id") + 1) * length)
    return cut.select(
        "doc_id",
        (begin - F.col("place")).alias("start"),
        (stop - begin).alias("length"),
        F.substring(
            "ids", ((begin - F.col("place")) * 4 + 1).cast("int"), ((stop - begin) * 4).cast("int")
        ).alias("ids"),
        F.col("n").alias("doc_tokens"),
        "sequence_id",
        (begin - F.col("sequence_id") * length).alias("offset"),
    )
