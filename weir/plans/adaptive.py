"""Measured filter order and key statistics, above Catalyst.

Spark keeps the written order of conjuncts.  With ``filter_opt`` some rows at
the head of the input are looked at: which of them fail which conjuncts.  The
conjunct that drops most rows for its cost goes first; the next is chosen by
what it drops of the rows that are left, so one that only repeats an earlier
one goes to the end.  Conjuncts that may raise stay where they were written,
and so does everything after them.
"""

from __future__ import annotations

from itertools import islice, permutations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from weir.functions.predicates import Predicate
from weir.plans.config import Config


def passes(df: DataFrame, conjuncts: list[Predicate], rows: int) -> np.ndarray:
    """Which of the first ``rows`` rows pass which conjunct, a row for each.

    Spark reads no more partitions than these rows need, and only the columns
    of the conjuncts.  The first rows may be unlike the others: the order may
    then be a poor one, the result is the same.
    """
    seen = df.select(*(p.column(df).alias(f"p{i}") for i, p in enumerate(conjuncts))).head(rows)
    return np.array([[bool(v) for v in r] for r in seen], bool).reshape(len(seen), len(conjuncts))


def greedy_order(seen: np.ndarray, costs: list[float]) -> list[int]:
    """Columns of ``seen`` by the rows they drop, of those that are left, for their cost; ties in the written order."""
    left, out, rest = np.ones(len(seen), bool), [], list(range(seen.shape[1]))
    while rest:
        best = max(rest, key=lambda i: ((left & ~seen[:, i]).sum() / costs[i], -costs[i], -i))
        out.append(best)
        rest.remove(best)
        left &= seen[:, best]
    return out


def measured_order(df: DataFrame, conjuncts: list[Predicate], rows: int = 1000) -> list[Predicate]:
    head = next((i for i, p in enumerate(conjuncts) if not p.movable()), len(conjuncts))
    if head < 2 or df.isStreaming:
        return conjuncts
    ranked = greedy_order(passes(df, conjuncts[:head], rows), [p.whole_cost() for p in conjuncts[:head]])
    return [conjuncts[i] for i in ranked] + conjuncts[head:]


def filtered(df: DataFrame, run: list[Predicate], config: Config, measure: bool = True) -> DataFrame:
    """``df`` under consecutive filters, in the order that ``config`` asks for; measured only if ``measure``."""
    conjuncts = [c for p in run for c in p.conjuncts()]
    if config.pipeline_permutation:
        conjuncts = list(next(islice(permutations(conjuncts), config.pipeline_permutation, None), conjuncts))
    elif config.filter_opt and measure:
        conjuncts = measured_order(df, conjuncts, config.sample_rows)
    for p in conjuncts:
        df = df.filter(p.column(df))
    return df


def profile_keys(df: DataFrame, key: str, top: int = 10) -> dict:
    """Range, commonest keys and their spread, with the strategy they suggest."""
    c: Column = df[key]
    low, high, n, distinct = df.agg(F.min(c), F.max(c), F.count(F.lit(1)), F.approx_count_distinct(c)).first()
    common = [(r[0], r[1]) for r in df.groupBy(c).count().orderBy(F.desc("count"), F.asc(key)).limit(top).collect()]
    mean = sum(k for _, k in common) / len(common) if common else 0.0
    spread = sum((k - mean) ** 2 for _, k in common) ** 0.5
    skewed = bool(common) and n > 0 and common[0][1] > 10 * n / max(distinct, 1)
    return {
        "min": low, "max": high, "rows": n, "distinct": distinct, "top": common, "dispersion": spread,
        "strategy": "partial aggregation, then a salted merge" if skewed else "partial and final aggregation",
    }
