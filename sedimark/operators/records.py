"""Contracts, deduplication, sampling and apportionment of training records.

Contracts add an `errors` column (array of strings, empty if all is well) instead of raising.
Order is always explicit: `first wins` needs the column that says what comes first.

Edge cases. A null rule doesn't hold; null groups are a group; empty input gives an empty result;
repeated rows count each; ties of an order go by the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimark.functions import text as tx


def checked(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df with errors: the names of the rules that hold for a row (null counts as not holding)."""
    found = F.array(*(F.when(c, F.lit(name)) for name, c in rules.items()))
    return df.withColumn("errors", F.array_compact(found))


def blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def required(*columns: str) -> dict[str, Column]:
    return {f"missing_{c}": blank(c) for c in columns}


def pair_rules(query="query", positive="document", lo=8, hi=2000) -> dict[str, Column]:
    """The pair quality gate: lengths, difference, language."""
    q, p = F.coalesce(F.col(query), F.lit("")), F.coalesce(F.col(positive), F.lit(""))
    return {
        "query_length": ~F.length(q).between(lo, hi),
        "positive_length": ~F.length(p).between(lo, hi),
        "query_equals_positive": tx.fold(q) == tx.fold(p),
        "not_german": ~tx.looks_german(F.concat_ws(" ", q, p)),
    }


def negative_rules(positive="positive", negatives="negatives", most=0.97) -> dict[str, Column]:
    p, ns = F.col(positive), F.coalesce(F.col(negatives), F.array().cast("array<string>"))
    same = F.exists(ns, lambda n: tx.fold(n) == tx.fold(p))
    own = F.array_distinct(tx.tokens(p))
    near = F.exists(
        ns,
        lambda n: (tx.fold(n) != tx.fold(p)) & (tx.jaccard(own, F.array_distinct(tx.tokens(n))) >= most),
    )
    return {"negative_equals_positive": same, "negative_too_similar": near}


def training_rules() -> dict[str, Column]:
    """The training-pair contract."""
    ns = F.col("negatives")
    types = F.array(*map(F.lit, tx.NEGATIVE_TYPES))
    return {
        **required("query", "positive", "source", "license"),
        "license_not_allowed": ~blank("license") & ~tx.license_of(F.col("license")).isin(*tx.ALLOWED_LICENSES),
        "lang_blank": F.col("lang").isNotNull() & blank("lang"),
        "negative_blank": F.exists(ns, lambda n: F.trim(F.coalesce(n, F.lit(""))) == ""),
        "negative_equals_positive": F.exists(ns, lambda n: tx.fold(n) == tx.fold(F.col("positive"))),
        "neg_type_unknown": F.size(F.array_except("neg_types", types)) > 0,
    }


def contract_report(checked_rows: DataFrame) -> DataFrame:
    """error, n."""
    return (
        checked_rows.select(F.explode("errors").alias("error"))
        .groupBy("error")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def missing_references(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of child whose key isn't in parent."""
    return child.join(
        parent.select(F.col(parent_key).alias("_parent")).distinct(),
        F.col(key) == F.col("_parent"),
        "left_anti",
    )


def first_by(df: DataFrame, key: list[Column], order: list) -> DataFrame:
    """The first row of each key. One that is alone or first survives the map side already."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def per_group(df: DataFrame, group: list, order: list, n: int) -> DataFrame:
    """The first n rows of each group, with nth."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= n)


def sample_to_targets(df: DataFrame, group: str, targets: dict[str, int], key: str, seed: str = "0") -> DataFrame:
    """As many rows of each group as its target, in the order of a hash; groups without a target
    stay whole."""
    if not targets:
        return df
    goal = F.create_map(*(F.lit(x) for kv in targets.items() for x in kv))
    aimed = F.coalesce(F.col(group).isin(*targets), F.lit(False))
    return df.filter(~aimed).unionByName(first_by_hash(df.filter(aimed), [F.col(group)], F.try_element_at(goal, F.col(group)), key, f"{seed}|"))


def capped_lists(df: DataFrame, key: str, per_domain: int | None = None, per_source: int | None = None) -> DataFrame:
    """Lists (domain, source) in hash order: at most per_domain of a domain, then at most per_source
    of a source, domains in ascending order."""
    out = df
    if per_domain is not None:
        out = first_by_hash(out, [tx.unknown(F.col("domain"))], F.lit(per_domain), key)
    if per_source is not None:
        w = Window.partitionBy(tx.unknown(F.col("source"))).orderBy(tx.unknown(F.col("domain")), F.md5(F.col(key).cast("string")), key)
        out = out.withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") <= per_source).drop("_nth")
    return out


def round_robin(df: DataFrame, group: str, order: list, total: int) -> DataFrame:
    """total rows, one of each group in turn, groups in ascending order."""
    w = Window.partitionBy(group).orderBy(*order)
    turn = df.withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= total)
    return turn.orderBy("turn", group).limit(total)


def stride_sample(df: DataFrame, group: str, order: list, budget: int) -> DataFrame:
    """Every n-th row of a group, n = max(1, rows // budget), up to budget rows."""
    w = Window.partitionBy(group).orderBy(*order)
    n = F.count(F.lit(1)).over(Window.partitionBy(group))
    stride = F.greatest(F.lit(1), F.floor(n / budget))
    at = F.row_number().over(w) - 1
    rows = df.withColumns({"_stride": stride, "_at": at})
    return rows.filter((F.pmod("_at", "_stride") == 0) & (F.col("_at") / F.col("_stride") < budget)).drop("_stride", "_at")


def first_by_hash(df: DataFrame, group: list, wanted: Column, key: str, seed: str = "") -> DataFrame:
    """Of each group the first `wanted` rows in the order of a hash of key, then key. Of large groups
    only rows near the edge are ordered: rows are counted by the first digits of the hash, whole
    digits are kept or dropped, and what is in the edge's digit alone is sorted."""
    mark = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))
    names = [f"_g{i}" for i in range(len(group))]
    rows = df.withColumns({n: g for n, g in zip(names, group)} | {"_m": mark, "_w": wanted}).withColumn("_d", F.substring("_m", 1, 3))
    digits = rows.groupBy(*names, "_d").agg(F.count(F.lit(1)).alias("_n"))  # at most 4096 rows a group
    before = Window.partitionBy(*names).orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    starts = digits.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(*names, "_d", "_n", "_start")
    same = [F.col(f"r.{n}").eqNullSafe(F.col(f"s.{n}")) for n in names]
    on = F.col("r._d") == F.col("s._d")
    for s in same:
        on = on & s
    j = rows.alias("r").join(starts.alias("s"), on).select("r.*", "s._n", "s._start")
    whole = j.filter("_start + _n <= _w").select(*df.columns)
    edge = j.filter("_start < _w and _start + _n > _w")
    w = Window.partitionBy(*names).orderBy("_m", key)
    part = edge.withColumn("_at", F.row_number().over(w) + F.col("_start")).filter("_at <= _w").select(*df.columns)
    return whole.unionByName(part)


def capped_share(df: DataFrame, flag: Column, cap: float, key: str) -> DataFrame:
    """All rows without the flag, and of those with it, in hash order, so many that their share
    is at most cap."""
    marked = F.coalesce(flag, F.lit(False))
    plain = df.agg(F.count_if(~marked)).first()[0]
    most = int(plain * cap / (1 - cap)) if cap < 1 else None
    if most is None:
        return df
    return df.filter(~marked).unionByName(first_by_hash(df.filter(marked), [], F.lit(most), key))


def largest_remainder(weights: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """key, budget: whole parts of total by weight, the rest to the largest fractions, ties to
    the larger key. weights is a row for each source."""
    one = Window.partitionBy()
    raw = F.col(weight) / F.sum(weight).over(one) * total
    rows = weights.select(key, raw.alias("raw")).withColumn("whole", F.floor("raw"))
    rest = F.lit(total) - F.sum("whole").over(one)
    nth = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("raw") - F.col("whole"), 9)), F.desc(key)))
    return rows.withColumns({"rest": rest, "nth": nth}).select(
        key, (F.col("whole") + (F.col("nth") <= F.col("rest")).cast("int")).alias("budget")
    )
