"""Access to nested rows: fields with a fallback, paths in JSON, positives in several encodings,
result maps, and the merge of settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names under which a metric may be found.
METRIC_NAMES = {
    "recall@100": ["recall@100", "recall_at_100", "recall100"],
    "ndcg@10": ["ndcg@10", "ndcg_at_10", "ndcg10"],
    "mrr@10": ["mrr@10", "mrr_at_10", "mrr10"],
    "retention_256": ["retention_256", "retention256", "m256_retention", "matryoshka_256_retention"],
}


def field(df: DataFrame, name: str, kind: str = "string", within: str = "metadata") -> Column:
    """A column, or where it is null or not there the entry of a map."""
    found = []
    if name in df.columns:
        found.append(F.col(name).cast(kind))
    if within in df.columns:
        found.append(F.try_element_at(F.col(within), F.lit(name)).cast(kind))
    return F.coalesce(*found) if found else F.lit(None).cast(kind)


def path(json: Column, *steps: str | int) -> Column:
    """What a JSON text has at a path, as text; null where a step is missing. Names may hold any
    character but a quote."""
    at = "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in steps)
    return F.get_json_object(json, "$" + at)


def metric(values: Column, name: str) -> Column:
    """A metric of a map<string,double> under any of its names, in any case."""
    low = F.transform_keys(values, lambda k, v: F.lower(k))
    names = METRIC_NAMES.get(name, [name])
    return F.coalesce(*(F.try_element_at(low, F.lit(n)) for n in names))


def positives(df: DataFrame, judged: Column | None = None, labels: bool = True) -> Column:
    """Distinct ids of the positives: judgements if there are any, else the union of
    positive_doc_ids, positive_doc_id, and candidates that are flagged or (labels) labelled 1."""
    none = F.array().cast("array<string>")
    parts = [none]
    if "positive_doc_ids" in df.columns:
        parts.append(F.coalesce(F.col("positive_doc_ids").cast("array<string>"), none))
    if "positive_doc_id" in df.columns:
        parts.append(F.array(F.col("positive_doc_id").cast("string")))
    if "candidates" in df.columns:
        names = df.schema["candidates"].dataType.elementType.names
        flag = lambda c: F.coalesce(c["is_positive"], F.lit(False)) if "is_positive" in names else F.lit(False)
        label = lambda c: F.coalesce(c["label"] == 1, F.lit(False)) if labels and "label" in names else F.lit(False)
        cs = F.coalesce("candidates", F.array().cast(df.schema["candidates"].dataType))
        parts.append(F.transform(F.filter(cs, lambda c: flag(c) | label(c)), lambda c: c["doc_id"].cast("string")))
    own = F.filter(F.array_distinct(F.concat(*parts)), lambda p: F.coalesce(p, F.lit("")) != "")
    if judged is None:
        return F.array_sort(own)
    return F.array_sort(F.when(judged.isNotNull() & (F.size(judged) > 0), F.array_distinct(judged.cast("array<string>"))).otherwise(own))


def results(rows: DataFrame) -> DataFrame:
    """query_id, doc_id, rank, score of rows (query_id, results: array of doc_id, score); the last
    row of a query counts, by `ord` if there is one."""
    if "ord" in rows.columns:
        rows = rows.groupBy("query_id").agg(F.max_by("results", "ord").alias("results"))
    return rows.select("query_id", F.posexplode("results").alias("p", "r")).select("query_id", "r.doc_id", (F.col("p") + 1).alias("rank"), "r.score")


def merged(base: dict, override: dict | None) -> dict:
    """Settings with others on top, nested ones merged in turn; neither is changed."""
    out = dict(base)
    for name, value in (override or {}).items():
        own = out.get(name)
        out[name] = merged(own, value) if isinstance(own, dict) and isinstance(value, dict) else value
    return out
