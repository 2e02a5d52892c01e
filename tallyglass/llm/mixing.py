"""Mixing sources to target weights by entropy balancing.

Document rates r = q * exp(sum of lambdas), at most `cap`, are the closest to the base
rates q in relative entropy (weighted by tokens) among those that meet a token target for
every source, and for the values of further margins where some are asked for. The
multipliers solve the convex dual by Newton steps; every gradient and Hessian is one
distributed aggregate over cells (stratum, size, documents). Rates become whole copies by
systematic rounding along sizes, cell by cell; then copies are moved, by exchange where
that is nearer, until the stratum's words come near its target.
"""

from __future__ import annotations

from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

NOT_WHITE = r"[^\x20\x09-\x0D]+"
CAP = 3.0
#: Documents of one (group, size) cell that are numbered in one task.
CELL_ROWS = 512


def n_words(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(NOT_WHITE)).cast("long")


def capped_shares(sizes: list[tuple[str | None, int]], cap: float = CAP) -> dict[str | None, float]:
    """Targets by weights 1, 2, 3, 1, ... in code-point order (None last).

    They share the sum of all sizes; what goes beyond cap * size is shared again, by
    weight, among the sources that have room, until none is above.
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode()))
    weight = {s: 1 + i % 3 for i, (s, _) in enumerate(order)}
    size = dict(order)
    left, room, target = float(sum(size.values())), dict(weight), {}
    while room:
        each = left / sum(room.values())
        full = [s for s in room if each * weight[s] > cap * size[s]]
        if not full:
            return target | {s: each * weight[s] for s in room}
        for s in full:
            target[s] = cap * size[s]
            left -= target[s]
            del room[s]
    return target


def entropy_balance(
    cells: DataFrame, margins: dict[str, dict[str, float]], cap: float = CAP, steps: int = 60, tol: float = 1e-10
) -> dict[str, dict[str, float]]:
    """Dual multipliers by margin and value, for cells (one column a margin, tokens, base).

    A margin is a column with a token target for each of its values; a cell's rate is
    base * exp(sum of its multipliers), at most `cap`. Gradient and Hessian of the dual
    are summed on the cluster, by combination of values; capped cells add nothing to the
    Hessian. What reaches the driver is as large as the constraints and their
    combinations, whatever the documents. A target beyond what the cap lets be, or that
    contradicts another, is met as far as a damped Newton run gets.
    """
    spark = cells.sparkSession
    names = list(margins)
    place = {(m, v): i for i, (m, v) in enumerate((m, v) for m in names for v in margins[m])}
    want = np.array([margins[m][v] for m, v in place], float)
    lam = np.zeros(len(place))
    for _ in range(steps):
        now = cells.withColumn("__e", F.lit(0.0))
        for m in names:
            rows = [(v, float(lam[place[m, v]])) for v in margins[m]]
            table = F.broadcast(spark.createDataFrame(rows, f"`{m}` string, __l double"))  # one row a constraint
            now = now.join(table, m).withColumn("__e", F.col("__e") + F.col("__l")).drop("__l")
        tilt = F.col("base") * F.exp("__e")
        free = F.when(tilt < cap, F.col("tokens") * tilt).otherwise(0.0)
        found = now.groupBy(*names).agg(F.sum(F.col("tokens") * F.least(F.lit(cap), tilt)).alias("g"), F.sum(free).alias("h")).collect()
        grad, hess = -want.copy(), np.zeros((len(want), len(want)))
        for row in found:
            at = [place[m, row[m]] for m in names]
            grad[at] += row["g"]
            hess[np.ix_(at, at)] += row["h"]
        if (np.abs(grad) / np.maximum(1, want)).max(initial=0) < tol:
            break
        scale = np.maximum(hess.diagonal().max(initial=0), 1.0) * 1e-12
        step = np.linalg.lstsq(hess + scale * np.eye(len(want)), -grad, rcond=None)[0].clip(-1, 1)
        # A value all of whose cells are capped has no slope; it may only come down.
        lam += np.where(hess.diagonal() > 0, step, np.where(grad > 0, -1.0, 0.0))
    return {m: {v: float(lam[place[m, v]]) for v in margins[m]} for m in names}


def _greedy(size: np.ndarray, room: np.ndarray, rest: int) -> np.ndarray:
    """How many of each size (falling order) to take so that their sum stays within `rest`, large ones first."""
    take = np.zeros(len(size), np.int64)
    for i in range(len(size)):
        if 0 < size[i] <= rest and room[i]:
            take[i] = min(room[i], rest // size[i])
            rest -= take[i] * size[i]
    return take


def nearest(size: np.ndarray, copies: np.ndarray, least: np.ndarray, most: np.ndarray, target: float, tries: int = 64) -> np.ndarray:
    """`copies` by size (falling order) changed within [least, most] so that their words come near `target`.

    Greedy moves towards the target come first. Then one move beyond it, by each of up
    to `tries` sizes spread over all that can move, is made good by greedy moves the
    other way. The nearest sum wins; of equally near ones the first.
    """

    def toward(c: np.ndarray) -> np.ndarray:
        gap = target - float((c * size).sum())
        return c + _greedy(size, most - c, int(gap)) if gap > 0 else c - _greedy(size, c - least, int(-gap))

    off = lambda c: abs(target - float((c * size).sum()))
    best = toward(copies)
    for _ in range(4):
        start, here = best, off(best)
        if here < 1:
            break
        over = float((start * size).sum()) > target
        can = np.flatnonzero((start > least if over else start < most) & (size > 0))
        for i in can[np.unique(np.linspace(0, len(can) - 1, min(tries, len(can))).astype(int))] if len(can) else []:
            c = start.copy()
            c[i] += -1 if over else 1
            c = toward(toward(c))
            if off(c) < off(best) - 1e-9:
                best = c
        if off(best) >= here:
            break
    return best


def _fill(cells: pd.DataFrame) -> pd.DataFrame:
    """The copies of a stratum's cells, moved near its target."""
    cells = cells.sort_values("size", ascending=False)
    c, s, lo, hi = (cells[k].to_numpy(np.int64) for k in ("copies", "size", "least", "most"))
    return cells.assign(copies=nearest(s, c, lo, hi, float(cells["goal"].iloc[0])))


def mix(docs: DataFrame, cap: float = CAP, cell_rows: int = CELL_ROWS, margins: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies.

    `margins` may add further constraints: columns of `docs` with the share of all
    words that each of their values is to get (values without one are left out). Rates
    then differ within a source, by the product of tilts.

    Null text has no words; a null source is a source of its own. Documents without
    words take nothing. Rows that repeat a doc_id are documents of their own; which of
    two equal rows gets the odd copy does not show in the result. Only doc_id, source,
    text and the margins' columns are read. An empty input gives an empty result.
    """
    spark = docs.sparkSession
    more = dict(margins or {})
    grp = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "source"))
    extra = [F.col(m).cast("string").alias(f"m{i}") for i, m in enumerate(more)]
    by = ["grp", *(f"m{i}" for i in range(len(more)))]
    sized = staged(docs.select("doc_id", grp.alias("grp"), *extra, n_words().alias("size")), "sizes")
    if more:
        for i, shares in enumerate(more.values()):
            sized = sized.filter(F.col(f"m{i}").isin(list(shares)))
    cells = staged(sized.groupBy(*by, "size").agg(F.count(F.lit(1)).alias("n")), "cells")
    totals = {g: int(t) for g, t in cells.groupBy("grp").agg(F.sum(F.col("size") * F.col("n"))).collect()}
    named = {None if g == "n" else g[1:]: t for g, t in totals.items()}
    targets = {("n" if s is None else "s" + s): t for s, t in capped_shares(list(named.items()), cap).items()}
    whole = float(sum(totals.values()))
    asked = {"grp": targets} | {f"m{i}": {v: share * whole for v, share in shares.items()} for i, shares in enumerate(more.values())}
    lam = entropy_balance(cells.select(*by, (F.col("size") * F.col("n")).alias("tokens"), F.lit(1.0).alias("base")), asked, cap)

    rated = cells.withColumn("rate", F.lit(0.0))
    for column in by:
        rows = [(v, x) for v, x in lam[column].items()]
        rated = rated.join(F.broadcast(spark.createDataFrame(rows, f"{column} string, __l double")), column).withColumn("rate", F.col("rate") + F.col("__l")).drop("__l")
    known = F.broadcast(spark.createDataFrame([(g, totals[g], float(targets[g])) for g in totals], "grp string, source_size long, target double"))
    up = Window.partitionBy(*by).orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    step = lambda k: F.floor(F.col("rate") * k + 0.5)
    plan = (
        rated.join(known, "grp")
        .withColumn("rate", F.least(F.lit(cap), F.exp(F.least("rate", F.lit(log(cap))))))
        .withColumn("upto", F.sum("n").over(up))
        .withColumn("copies", step(F.col("upto")) - step(F.col("upto") - F.col("n")))
        .withColumn("goal", F.sum(F.col("rate") * F.col("size") * F.col("n")).over(Window.partitionBy(*by)))
        .withColumn("most", F.least(F.lit(int(cap)), F.floor("rate") + 1) * F.col("n"))
        .withColumn("least", F.greatest(F.lit(0), F.ceil("rate") - 1) * F.col("n"))
        .select(*by, "size", "n", "copies", "source_size", "target", "goal", "most", "least", F.ceil(F.col("n") / cell_rows).alias("salts"))
    )
    # A stratum here has one row per distinct size, so the longest text bounds it.
    plan = plan.groupBy(*by).applyInPandas(_fill, plan.schema).drop("goal", "most", "least")
    plan = staged(plan, "plan")
    key = F.xxhash64("doc_id")
    # Shuffled at every size: the plan grows with sources and sizes, and a hot cell can be split.
    joined = staged(sized.join(plan.hint("merge"), [*by, "size"]).withColumn("salt", F.pmod(key, F.col("salts"))), "planned")
    cell = [*by, "size"]
    salts = joined.groupBy(*cell, "salt").agg(F.count(F.lit(1)).alias("m"))
    first = salts.withColumn(
        "start", F.sum("m").over(Window.partitionBy(*cell).orderBy("salt").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")
    ).drop("m")
    place = F.row_number().over(Window.partitionBy(*cell, "salt").orderBy(key, "doc_id")) + F.col("start") - 1
    own = (F.floor(F.col("copies") / F.col("n")) + (F.col("place") < F.col("copies") % F.col("n")).cast("long")).cast("long")
    return (
        joined.join(first, [*cell, "salt"])
        .withColumn("place", place)
        .select("doc_id", "size", "source_size", "target", (own * F.col("size")).alias("taken"), own.alias("copies"))
    )
