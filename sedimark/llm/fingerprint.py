"""Document fingerprints as invertible Bloom lookup sketches, with built-in functions only.

A text is a set of paragraph digests. A sketch has 96 cells in three rows of 32; a digest falls
into one cell of each row, which keeps how many fell there and the XOR of digests and of their
check sums. Subtracting two sketches cell by cell leaves the digests in which the texts differ;
peeling takes them out: a cell that holds one digest gives it away, and removing it from its
other cells may leave further single ones. Peeling that gets stuck is tried again with a larger
sketch: 96 cells for each of so many parts of the digest space that a part holds few digests,
then six times as many parts. Should even that get stuck (it hasn't been seen), the two sets
are compared directly.

Paragraphs are lines, cut after a sentence end once they are 200 characters long and in any case
after 800. The first 600 characters of a text are cut every few words, so that a short text has
several digests; where they are cut doesn't depend on what follows. Everything works within a row: texts of n digests cost n * sqrt(n) steps at most.

Likeness is shared digests over all digests of the two texts, from the counts of both sketches
and the number peeled out of their difference; 1 for two texts without a digest.

Edge cases. Null text: as empty (no digest, empty sketch). Repeated paragraphs count once, but
the fingerprint starts with the hash of the whole text. Tied doc_id: ordered by text. Null doc_id:
last in descending order. One row: it is its own next. Empty input: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimark.llm.common import text_or_empty

ROWS, WIDTH, BITS = 3, 32, 5
PIECE = r"[^\n]{200,800}?[.!?]+(?=\s|$)|[^\n]{1,800}"
HEAD = 600
SMALL_PIECE = r"[^\n]{12,24}?(?:[.!?]+|[dnst])(?=\s|$)|[^\n]{12,24}?(?=\s|$)|[^\n]{1,24}"
PEELING_ROUNDS = 16
CELL = "struct<i:bigint,n:int,k:bigint,c:bigint>"
EMPTY = f"cast(struct(-1, 0, 0, 0) as {CELL})"
PLACE = 40  # bits of an item's place in a code
#: Of the 96 cells of a difference: with more in use, peeling gets stuck more often than not, and
#: the larger sketch is taken at once. The number that comes out is the same.
HOPELESS = 85

# Expressions are put together as SQL text, which the parser takes at once.


def digests(text: Column) -> Column:
    """The distinct paragraph digests of a text: array<bigint>, ascending."""
    pieces = F.concat(
        F.regexp_extract_all(F.substring(text, 1, HEAD), F.lit(SMALL_PIECE), F.lit(0)),
        F.regexp_extract_all(F.substring(text, HEAD + 1, 2**31 - 1), F.lit(PIECE), F.lit(0)),
    )
    return F.array_sort(F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p))))


def _bind(value: str, name: str, body: str) -> str:
    """body, in which `name` is value, evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def items_sql(of: str, n: int = 1) -> str:
    """What each digest of `of`, of which there are n, adds to a cell; the cell itself isn't named."""
    return f"transform({of}, d -> cast(struct(-1, {n}, d, xxhash64(d)) as {CELL}))"


def _codes_sql(items: str, after: str = "0") -> str:
    """The three cells of each item, each with the item's place above `after` in the lower bits."""
    cells = ", ".join(
        f"shiftleft((shiftright(e.k, {BITS * r}) & {WIDTH - 1}) + {WIDTH * r}, {PLACE}) | (j + {after})"
        for r in range(ROWS)
    )
    return f"flatten(transform({items}, (e, j) -> array({cells})))"


def summed_sql(items: str, codes: str, dense: bool = False) -> str:
    """The cells that `items` add up to, ascending: a fold over the sorted codes (numbers, which
    sort faster than structs), whose last cell is still open. Without empty cells; dense: with them."""
    state = f"struct<done:array<{CELL}>,at:{CELL}>"
    nothing = f"cast(struct(array(), {EMPTY}) as {state})"
    if dense:
        closed = lambda upto: (
            f"if(a.at.i < 0, array_repeat({EMPTY}, cast({upto} as int)), "
            f"concat(a.done, array(a.at), array_repeat({EMPTY}, cast({upto} - a.at.i - 1 as int))))"
        )
    else:
        closed = lambda upto: "if(a.at.n = 0 and a.at.k = 0, a.done, concat(a.done, array(a.at)))"
    cell, item = f"shiftright(x, {PLACE})", f"items[cast(x & {(1 << PLACE) - 1} as int)]"
    fold = (
        f"aggregate(array_sort({codes}), {nothing}, (a, x) -> if(a.at.i = {cell}, struct(a.done as done, "
        f"struct(a.at.i as i, a.at.n + {item}.n as n, a.at.k ^ {item}.k as k, a.at.c ^ {item}.c as c) as at), "
        f"struct({closed(cell)} as done, struct({cell} as i, {item}.n as n, {item}.k as k, {item}.c as c) as at)), "
        f"a -> {closed(str(ROWS * WIDTH))})"
    )
    return _bind(items, "items", fold)


def sketch(of: str) -> Column:
    """The sketch of the digests in the named column: its 96 cells as (i, n, k, c): number (-1 if
    empty), how many digests, XOR of digests, XOR of check sums."""
    return F.expr(summed_sql(items_sql(of), _codes_sql("items"), dense=True))


def subtract_sql(a: str, b: str) -> str:
    """The cells in which two sketches differ."""
    each = "struct(greatest(x.i, y.i) as i, x.n - y.n as n, x.k ^ y.k as k, x.c ^ y.c as c)"
    return f"filter(zip_with({a}, {b}, (x, y) -> {each}), e -> e.n <> 0 or e.k <> 0)"


def peel_sql(cells: str) -> str:
    """(ok, found): the digests recovered from a difference of sketches, as (k, n), n 1 for the
    first text's and -1 for the second's; ok if nothing is left. A round takes the digests of
    all single cells and takes them out of the cells."""
    state = f"struct<cells:array<{CELL}>,found:array<struct<k:bigint,n:int>>,going:boolean>"
    single = (
        "array_distinct(transform(filter(s.cells, c -> abs(c.n) = 1 and xxhash64(c.k) = c.c), "
        "c -> struct(c.k as k, c.n as n)))"
    )
    taken = f"transform(pure, p -> cast(struct(-1, -p.n, p.k, xxhash64(p.k)) as {CELL}))"
    still = f"transform(s.cells, (c, j) -> shiftleft(c.i, {PLACE}) | j)"
    rest = summed_sql(
        f"concat(s.cells, {taken})", f"concat({still}, {_codes_sql('pure', 'size(s.cells)')})"
    )
    step = _bind(
        single,
        "pure",
        f"if(size(pure) > 0, struct({rest} as cells, concat(s.found, pure) as found, true as going), "
        "struct(s.cells as cells, s.found as found, false as going))",
    )
    return (
        f"aggregate(sequence(1, {PEELING_ROUNDS}), cast(struct({cells}, array(), true) as {state}), "
        f"(s, r) -> if(s.going and size(s.cells) > 0, {step}, s), "
        "s -> struct(size(s.cells) = 0 as ok, s.found as found))"
    )


def _parts_sql(of: str, groups: str, salt: int) -> str:
    """The digests in groups * groups parts by further bits: groups first, then each again."""
    high = f"shiftrightunsigned(d, {ROWS * BITS + salt})"
    inner = (
        f"transform(sequence(0, {groups} - 1), "
        f"h -> filter(some, d -> pmod({high} div {groups}, {groups}) = h))"
    )
    outer = _bind(f"filter({of}, d -> pmod({high}, {groups}) = g)", "some", inner)
    return f"flatten(transform(sequence(0, {groups} - 1), g -> {outer}))"


def _larger_sql(a: str, b: str, load: int, salt: int) -> str:
    """(ok, d): peeling part by part, with `load` digests of both texts in a part on average."""
    items = f"concat({items_sql('u')}, {items_sql('v', -1)})"
    each = peel_sql(summed_sql(items, _codes_sql("items")))
    peeled = f"zip_with({_parts_sql(a, 'm', salt)}, {_parts_sql(b, 'm', salt)}, (u, v) -> {each})"
    total = _bind(
        peeled,
        "q",
        "struct(forall(q, p -> p.ok) as ok, aggregate(q, 0, (t, p) -> t + size(p.found)) as d)",
    )
    return _bind(f"ceil(sqrt((size({a}) + size({b})) / {load}))", "m", total)


def difference_sql(a: str, sketch_a: str, b: str, sketch_b: str) -> str:
    """The number of digests in which two texts differ, out of their subtracted sketches."""
    last = f"if(z.ok, z.d, size(array_except({a}, {b})) + size(array_except({b}, {a})))"
    third = _bind(_larger_sql(a, b, 8, 3), "z", last)
    second = _bind(_larger_sql(a, b, 48, 0), "w", f"if(w.ok, w.d, {third})")
    first = _bind(peel_sql("cells"), "o", f"if(o.ok, size(o.found), {second})")
    return _bind(
        subtract_sql(sketch_a, sketch_b), "cells", f"if(size(cells) > {HOPELESS}, {second}, {first})"
    )


def likeness(a: str, sketch_a: str, b: str, sketch_b: str) -> Column:
    """Of the texts whose digests and sketches are in the named columns."""
    total = f"(size({a}) + size({b}))"
    near = _bind(difference_sql(a, sketch_a, b, sketch_b), "e", f"({total} - e) / ({total} + e)")
    return F.expr(f"if({total} = 0, 1D, {near})")


def serialized(text: Column, of: Column, cells: Column) -> Column:
    """Hash of the whole text and number of digests in hex, then the cells in base64, 12 bytes
    each: number, count, XOR of digests, 16 bits of the XOR of check sums."""
    return F.concat(
        F.lpad(F.hex(F.xxhash64(text)), 16, "0"),
        F.lpad(F.hex(F.size(of)), 8, "0"),
        F.base64(
            F.unhex(
                F.array_join(
                    F.transform(
                        F.filter(cells, lambda c: c["n"] > 0),
                        lambda c: F.concat(
                            F.lpad(F.hex(c["i"] * 256 + c["n"] % 256), 4, "0"),
                            F.lpad(F.hex(c["k"]), 16, "0"),
                            F.lpad(F.hex(F.pmod(c["c"], F.lit(65536))), 4, "0"),
                        ),
                    ),
                    "",
                )
            )
        ),
    )


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, text, digests, sketch, fingerprint for each row."""
    return (
        docs.select("doc_id", text_or_empty().alias("text"))
        .withColumn("digests", digests(F.col("text")))
        .withColumn("sketch", sketch("digests"))
        .withColumn("fingerprint", serialized(F.col("text"), F.col("digests"), F.col("sketch")))
    )


def with_next(docs: DataFrame, bucket_rows: int = 500, most_buckets: int = 16_384) -> DataFrame:
    """doc_id, text, bucket, ordinal, next_text: the text of the next row in descending doc_id,
    after the last one the first. Rows are dealt out by quantiles of doc_id, and the first row
    of each bucket also stands at the end of the one before: one shuffle of the texts."""
    base = docs.select("doc_id", text_or_empty().alias("text"))
    buckets = min(most_buckets, max(64, docs.count() // bucket_rows))
    cuts = base.agg(
        F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 20 * buckets)
    ).first()[0]
    cuts = sorted(set(cuts or []), reverse=True)
    # Bucket 0 holds the largest ids; null ids come last.
    wide = 128
    parts = [cuts[i : i + wide] for i in range(0, len(cuts), wide)]
    if cuts:
        # Two steps: among the first cuts of the parts, then within one part.
        larger = lambda of: F.size(F.filter(of, lambda c: c > F.col("doc_id")))
        part = larger(F.array(*(F.lit(p[0]) for p in parts)))
        within = F.element_at(F.array(*(F.array(*map(F.lit, p)) for p in parts)), part)
        above = F.when(part == 0, F.lit(0)).otherwise((part - 1) * wide + larger(within))
    else:
        above = F.lit(0)
    at = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(above)
    at = at.cast("int")
    heads = (
        docs.select("doc_id")
        .groupBy(at.alias("bucket"))
        .agg(F.max("doc_id").alias("doc_id"))
        .orderBy("bucket")
        .collect()  # a row for each bucket
    )
    order = [F.col("last"), F.col("doc_id").desc_nulls_last(), F.col("text")]
    rows = base.withColumn("bucket", at).withColumn("last", F.lit(0))
    if heads:
        ids = [h["doc_id"] for h in heads if h["doc_id"] is not None]
        wanted = F.col("doc_id").isin(ids) if ids else F.lit(False)
        if any(h["doc_id"] is None for h in heads):
            wanted = wanted | F.col("doc_id").isNull()
        before = {h["bucket"]: heads[i - 1]["bucket"] for i, h in enumerate(heads)}
        firsts = (
            base.filter(wanted)
            .groupBy("doc_id")
            .agg(F.min("text").alias("text"))
            .withColumn("of", at)
            .withColumn(
                "bucket",
                F.element_at(
                    F.create_map(*(F.lit(x) for kv in before.items() for x in kv)), F.col("of")
                ),
            )
            .select("doc_id", "text", "bucket", F.lit(1).alias("last"))
        )
        rows = rows.unionByName(firsts)
    w = Window.partitionBy("bucket").orderBy(*order)
    return rows.withColumn("ordinal", F.row_number().over(w)).withColumn(
        "next_text", F.lead("text").over(w)
    )


def compare_versions(docs: DataFrame) -> DataFrame:
    """Each document against its edited version (the last third replaced by the beginning of the
    next document) and against the next document: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next."""
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    rows = with_next(docs)
    w = Window.partitionBy("bucket").orderBy("ordinal")
    made = (
        rows.withColumn(
            "edited",
            F.concat(
                F.substr(F.col("text"), F.lit(1), n - third),
                F.substr(F.coalesce("next_text", F.lit("")), F.lit(1), third),
            ),
        )
        .withColumn("digests", digests(F.col("text")))
        .withColumn("edited_digests", digests(F.col("edited")))
        .withColumn("sketch", sketch("digests"))
        .withColumn("edited_sketch", sketch("edited_digests"))
        .select(
            "doc_id",
            "bucket",
            "ordinal",
            "last",
            n.cast("long").alias("n_chars"),
            F.sha2("edited", 256).alias("edited_sha256"),
            serialized(F.col("text"), F.col("digests"), F.col("sketch")).alias("fingerprint"),
            serialized(F.col("edited"), F.col("edited_digests"), F.col("edited_sketch")).alias(
                "edited_fingerprint"
            ),
            "digests",
            "edited_digests",
            "sketch",
            "edited_sketch",
        )
        .withColumn("next_digests", F.lead("digests").over(w))
        .withColumn("next_sketch", F.lead("sketch").over(w))
        .filter("last = 0")
    )
    same = lambda kind: likeness(
        "digests", "sketch", f"{kind}_digests", f"{kind}_sketch"
    )
    return made.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        same("edited").alias("near_edited"),
        same("next").alias("near_next"),
    )
