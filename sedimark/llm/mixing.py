"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells by source, language and topic. Starting from the observed tokens of
each cell, the cells' weights are scaled to the target share of every source, then of every
language, then of every topic, and again, until all three marginals hold. A cell's calibrated
probability is its wanted share of the token budget over what it has; documents are drawn by a
hash of their id, so a draw is the same in every run and on any partitioning.

Targets. By default a value's target is its share of tokens to the power `temper`, normalized,
which lifts small sources, languages and topics; given ones (value -> share) are normalized too.
Values without a target get none of the budget; targets of values that don't occur are left out.
A probability can't exceed one: cells that would need more are taken whole, and the rest of the
budget is spread over the others in proportion, over and over until it fits.

Size. Cells are one aggregation over the documents, pre-aggregated before the shuffle. Up to
`local_cells` cells are fitted on the driver (a few dozen bytes each); beyond, the same rounds run
as aggregations over the table of cells.

Topic, where the table has none: the most frequent of 16 hash classes among the words of six or
more letters, the smallest one in a tie; class 0 without such a word.

Edge cases. Null source or language: a value of its own (empty name). Null or empty text: no
tokens, probability of its cell. Null doc_id: drawn like any other. Equal rows: drawn alike.
Empty input: empty result. Columns with the names of the result (mix_...) are replaced,
others kept.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimark.llm.common import written

DIMENSIONS = ("mix_source", "mix_lang", "mix_topic")
TOPICS = 16
ROUNDS, CLOSE = 200, 1e-9  # on either path


def topic(text: str = "text") -> Column:
    classes = (
        f"transform(regexp_extract_all({text}, '[\\\\p{{L}}]{{6,}}', 0), "
        f"w -> pmod(hash(lower(w)), {TOPICS}))"
    )
    counted = (
        f"transform(sequence(0, {TOPICS - 1}), t -> struct(size(filter(h, x -> x = t)) as n, -t as t))"
    )
    return F.expr(
        f"coalesce(-array_max(element_at(transform(array({classes}), h -> {counted}), 1)).t, 0)"
    )


def token_count(text: str = "text") -> Column:
    """The default measure: a token for every four bytes begun."""
    return F.coalesce(F.ceil(F.octet_length(text) / 4), F.lit(0)).cast("long")


def with_cells(docs: DataFrame) -> DataFrame:
    return docs.withColumns(
        {
            "mix_source": F.coalesce(F.col("source"), F.lit("")),
            "mix_lang": F.coalesce(F.col("lang"), F.lit("")),
            "mix_topic": topic().cast("string"),
            "mix_tokens": token_count(),
        }
    )


def _targets(tokens: dict[str, float], given: dict[str, float] | None, temper: float) -> dict:
    wanted = {
        k: (given.get(k, 0.0) if given is not None else v**temper) if v > 0 else 0.0
        for k, v in tokens.items()
    }
    total = sum(wanted.values())
    return {k: v / total if total else 0.0 for k, v in wanted.items()}


def rake(cells, targets: list[np.ndarray], rounds: int = ROUNDS, close: float = CLOSE) -> np.ndarray:
    """Weights (summing to one) of cells = (codes by dimension, tokens), scaled to targets."""
    codes, tokens = cells
    w = tokens / tokens.sum()
    for _ in range(rounds):
        off = 0.0
        for c, t in zip(codes, targets):
            now = np.bincount(c, w, minlength=len(t))
            scale = np.divide(t, now, out=np.zeros_like(t), where=now > 0)
            w = w * scale[c]
            off = max(off, float(np.abs(now - t).max()))
        if off < close:
            break
    return w / w.sum() if w.sum() else w


def probabilities(tokens: np.ndarray, weights: np.ndarray, budget: float) -> np.ndarray:
    """Shares of each cell to draw so that the drawn tokens follow weights and add up to budget,
    as far as there are enough."""
    p = np.zeros(len(tokens))
    full = np.zeros(len(tokens), bool)
    for _ in range(len(tokens) + 1):
        left = budget - tokens[full].sum()
        open_ = ~full & (tokens > 0)
        mass = weights[open_].sum()
        if left <= 0 or not mass:
            break
        p[open_] = left * weights[open_] / mass / tokens[open_]
        over = open_ & (p >= 1)
        if not over.any():
            break
        p[over] = 1
        full |= over
    return np.clip(p, 0, 1)


def _rake_locally(cells: DataFrame, given, temper: float, share: float) -> DataFrame:
    table = cells.toPandas().sort_values(list(DIMENSIONS), ignore_index=True)
    tokens = table["tokens"].to_numpy(np.float64)
    codes, targets = [], []
    for name in DIMENSIONS:
        values, code = np.unique(table[name].to_numpy(str), return_inverse=True)
        have = np.bincount(code, tokens, minlength=len(values))
        wanted = _targets(dict(zip(values, have)), given.get(name), temper)
        codes.append(code)
        targets.append(np.array([wanted[v] for v in values]))
    w = rake((codes, tokens), targets)
    table["mix_weight"] = w
    table["mix_probability"] = probabilities(tokens, w, share * tokens.sum())
    # At most `local_cells` short rows, so they can go to every executor.
    fitted = cells.sparkSession.createDataFrame(
        table, "mix_source string, mix_lang string, mix_topic string, tokens long, mix_weight double, mix_probability double"
    )
    return F.broadcast(fitted)


def _rake_widely(cells: DataFrame, given, temper: float, share: float, rounds: int = ROUNDS) -> DataFrame:
    total = cells.agg(F.sum("tokens")).first()[0]
    budget = share * total
    state = cells.withColumn("w", F.col("tokens") / total)
    for name in DIMENSIONS:
        own = given.get(name)
        if own is None:
            goal = F.pow(F.sum("tokens"), temper)
        else:
            names = [x for kv in own.items() for x in (F.lit(kv[0]), F.lit(float(kv[1])))]
            goal = F.coalesce(F.try_element_at(F.create_map(*names), F.col(name)), F.lit(0.0))
        wanted = written(state.groupBy(name).agg(goal.alias(f"goal_{name}")))
        whole = wanted.agg(F.sum(f"goal_{name}")).first()[0] or 1.0
        share_of = wanted.select(name, (F.col(f"goal_{name}") / whole).alias(f"goal_{name}"))
        state = state.join(share_of, name)
    state = written(state)
    for _ in range(rounds):
        for name in DIMENSIONS:
            now = state.groupBy(name).agg(F.sum("w").alias("now"))
            scaled = F.when(F.col("now") > 0, F.col("w") * F.col(f"goal_{name}") / F.col("now"))
            state = state.join(now, name).withColumn("moved", F.coalesce(scaled, F.lit(0.0)))
            state = state.withColumn("off", F.abs(F.col("now") - F.col(f"goal_{name}")))
            state = state.drop("now", "w").withColumnRenamed("moved", "w")
            before = "most_off" if "most_off" in state.columns else "off"
            state = state.withColumn("most_off", F.greatest(before, "off")).drop("off")
        state = written(state)  # else the plan would double with each step
        if (state.agg(F.max("most_off")).first()[0] or 0.0) < CLOSE:
            break
        state = state.drop("most_off")
    state, full = state.withColumn("p", F.lit(0.0)), 0
    while True:
        left, mass = state.agg(
            F.lit(budget) - F.coalesce(F.sum(F.when(F.col("p") >= 1, F.col("tokens"))), F.lit(0)),
            F.sum(F.when(F.col("p") < 1, F.col("w"))),
        ).first()
        if not mass or left <= 0:
            break
        state = written(
            state.withColumn(
                "p",
                F.when(F.col("p") >= 1, F.lit(1.0)).otherwise(
                    F.least(F.lit(1.0), F.lit(left / mass) * F.col("w") / F.col("tokens"))
                ),
            )
        )
        now = state.filter("p >= 1").count()
        if now == full:  # no further cell is taken whole
            break
        full = now
    return state.select(*DIMENSIONS, "tokens", F.col("w").alias("mix_weight"), F.col("p").alias("mix_probability"))


def calibrated_cells(
    docs_with_cells: DataFrame,
    share: float,
    targets: dict[str, dict[str, float]] | None = None,
    temper: float = 0.7,
    local_cells: int = 100_000,
) -> DataFrame:
    """A row per cell that has tokens: the dimensions, tokens, mix_weight, mix_probability."""
    cells = written(
        docs_with_cells.groupBy(*DIMENSIONS)
        .agg(F.sum("mix_tokens").alias("tokens"))
        .filter("tokens > 0")
    )
    n = cells.count()
    if not n:
        return cells.withColumns({"mix_weight": F.lit(0.0), "mix_probability": F.lit(0.0)})
    way = _rake_locally if n <= local_cells else _rake_widely
    return way(cells, targets or {}, temper, share)


def mix(docs: DataFrame, share: float = 0.7, targets=None, temper: float = 0.7, seed: int = 5, local_cells: int = 100_000) -> DataFrame:
    """All columns of docs, the dimensions, mix_tokens, mix_weight, mix_probability, mix_sampled.
    The hashed draw of a document is below its cell's probability if it is sampled."""
    rows = with_cells(docs.drop("mix_weight", "mix_probability", "mix_sampled"))
    cells = calibrated_cells(rows, share, targets, temper, local_cells).drop("tokens")
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) / float(1 << 53)
    joined = rows.join(cells, list(DIMENSIONS), "left")
    p = F.coalesce("mix_probability", F.lit(0.0))
    added = (*DIMENSIONS, "mix_tokens", "mix_weight", "mix_probability", "mix_sampled")
    return joined.select(
        *(c for c in docs.columns if c not in added),
        *DIMENSIONS,
        "mix_tokens",
        F.coalesce("mix_weight", F.lit(0.0)).alias("mix_weight"),
        p.alias("mix_probability"),
        (draw < p).alias("mix_sampled"),
    )
