"""Logistic calibration fitted by distributed Newton steps.

Every step is one partial aggregate of gradients and curvatures per group; only the sums (a few numbers per group) are
solved, in numpy inside tasks. No group is ever gathered, so one group may hold most of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions.prob import logit, sigmoid
from skyledger.session import materialize


def _dot(params: Column, xs: list[Column]) -> Column:
    total = params[0]
    for i, x in enumerate(xs):
        total = total + params[i + 1] * x
    return total


def fit_logistic(examples: DataFrame, groups: list[str], xs: list[str], y: str, w: str, l2: float = 1.0, iterations: int = 100,
                 tolerance: float = 1e-9, train_date: str | None = None, eval_dates: DataFrame | None = None, resolved_at: str | None = None, n: str | None = None) -> DataFrame:
    """Weighted logistic fits with a free intercept: `groups`, `coefficients` (intercept first), `status`, `rows`, `weight`.

    With `train_date` and `eval_dates(eval_date)` each evaluation date is its own fit over the rows of earlier dates; with
    `resolved_at` and `eval_dates(eval_date, first_at)` only over those whose label was known before the first decision of the
    evaluation date. Examples that are alike, and known to the same evaluation dates, are merged into one weighted row before a
    date is put beside them, and once more after: a Newton step reads one row per distinct example and date, never the examples.
    `n` names a column that counts the examples a row stands for.
    """
    k = len(xs) + 1
    gcols = [*groups, *(["eval_date"] if train_date else [])]
    sums_of = [F.sum("_w").alias("_w"), F.sum("_n").alias("_n")]
    single = examples.withColumns({"_w": F.col(w).cast("double"), "_n": (F.col(n) if n else F.lit(1)).cast("long")})
    if train_date is None:
        merged = materialize(single.groupBy(*groups, *xs, y).agg(*sums_of))
    else:
        merged = materialize(_known_before(single, groups, xs, y, train_date, resolved_at, eval_dates, sums_of))
    params = materialize(merged.select(*gcols).distinct().withColumn("coefficients", F.array(*[F.lit(0.0)] * k)))
    cols = [F.lit(1.0), *[F.col(x) for x in xs]]
    field_types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in params.schema.fields if f.name in gcols)
    out_schema = ", ".join(p for p in (field_types, "coefficients array<double>, moved double, status string, rows long, weight double") if p)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            coefficients, moved, status = [], [], []
            for row in batch.itertuples(index=False):
                beta = np.array(row.coefficients, dtype=float)
                g = np.array([getattr(row, f"g{i}") for i in range(k)])
                h = np.array([[getattr(row, f"h{min(i, j)}_{max(i, j)}") for j in range(k)] for i in range(k)])
                ridge = np.diag([0.0] + [l2] * (k - 1))
                if row.pos <= 0 or row.neg <= 0:
                    coefficients.append(beta.tolist()), moved.append(0.0), status.append("SINGLE_CLASS")
                    continue
                try:
                    step = np.linalg.solve(h + ridge + 1e-12 * np.eye(k), g - ridge @ beta)
                except np.linalg.LinAlgError:
                    coefficients.append(beta.tolist()), moved.append(0.0), status.append("FIT_FAILED")
                    continue
                size = float(np.max(np.abs(step)))
                # damp the first steps so that a badly scaled start cannot run away
                beta = beta + step * min(1.0, 4.0 / size if size > 4.0 else 1.0)
                coefficients.append(beta.tolist()), moved.append(size), status.append("FITTED")
            keys = {c: batch[c] for c in gcols}
            yield pd.DataFrame({**keys, "coefficients": coefficients, "moved": moved, "status": status, "rows": batch["rows"], "weight": batch["weight"]})

    fits = None
    for _ in range(iterations):
        p = sigmoid(_dot(F.col("coefficients"), [F.col(x) for x in xs]))
        rows = merged.join(params, gcols).withColumns({"_e": F.col("_w") * (F.col(y) - p), "_v": F.col("_w") * p * (1 - p)})
        aggs = [F.sum(F.col("_e") * c).alias(f"g{i}") for i, c in enumerate(cols)]
        aggs += [F.sum(F.col("_v") * cols[i] * cols[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]
        sums = rows.groupBy(*gcols).agg(
            F.first("coefficients").alias("coefficients"), *aggs, F.sum("_n").alias("rows"), F.sum("_w").alias("weight"),
            F.sum(F.when(F.col(y) == 1, F.col("_w")).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col(y) == 0, F.col("_w")).otherwise(0.0)).alias("neg"))
        fits = materialize(sums.mapInPandas(solve, out_schema))
        params = fits.select(*gcols, "coefficients")
        worst = fits.agg(F.max("moved")).first()[0]
        if worst is None or worst < tolerance:
            break
    settled = F.when((F.col("status") == "FITTED") & (F.col("moved") > 1e-4), "NOT_CONVERGED").otherwise(F.col("status"))
    return fits.withColumn("status", settled).drop("moved")


def _known_before(single: DataFrame, groups: list[str], xs: list[str], y: str, train_date: str, resolved_at: str | None, eval_dates: DataFrame, sums: list[Column]) -> DataFrame:
    """(groups, eval_date, xs, y, _w, _n): the distinct examples that each evaluation date may learn from, by both clocks.

    The calendar is one short array. With one clock an example counts from the first evaluation date after it, so its weight is a
    running sum, put beside the dates up to its next change. With two, an example's resolution counts only by its place among the
    calendar's first decisions, so examples resolved between two of them are alike.
    """
    rows = single.select(*groups, *xs, y, "_w", "_n", F.col(train_date).alias("_day"), *([F.col(resolved_at).alias("_known")] if resolved_at else []))
    if not resolved_at:
        alike = materialize(rows.groupBy(*groups, "_day", *xs, y).agg(*sums))
        calendar = eval_dates.agg(F.array_sort(F.collect_list("eval_date")).alias("_all"))
        first = F.size(F.filter("_all", lambda d: d <= F.col("_day"))) + 1
        placed = alike.select("_day").distinct().join(F.broadcast(calendar), F.lit(True)).select("_day", first.alias("_first"))
        steps = alike.join(placed, ["_day"]).groupBy(*groups, *xs, y, "_first").agg(*sums)
        order = Window.partitionBy(*groups, *xs, y).orderBy("_first")
        upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        stands = steps.withColumns({"_w": F.sum("_w").over(upto), "_n": F.sum("_n").over(upto), "_next": F.lead("_first").over(order)})
        dates = F.slice("_all", F.col("_first"), F.coalesce("_next", F.size("_all") + 1) - F.col("_first"))
        return stands.join(F.broadcast(calendar), F.lit(True)).select(*groups, F.explode(dates).alias("eval_date"), *xs, y, "_w", "_n")
    calendar = eval_dates.agg(F.array_sort(F.collect_list(F.struct("eval_date", "first_at"))).alias("_all"))
    # the first decisions that do not come after the resolution have not seen the label
    place = F.size(F.filter("_all", lambda f: f["first_at"] <= F.col("_known")))
    placed = rows.select("_known").distinct().join(F.broadcast(calendar), F.lit(True)).select("_known", place.alias("_place"))
    ranked = F.transform("_all", lambda f: F.struct(f["eval_date"].alias("eval_date"), F.size(F.filter("_all", lambda g: g["first_at"] <= f["first_at"])).alias("place")))
    calendar = calendar.select(ranked.alias("_all"))
    alike = rows.join(placed, ["_known"]).groupBy(*groups, "_day", "_place", *xs, y).agg(*sums)
    sees = F.filter("_all", lambda f: (f["eval_date"] > F.col("_day")) & (f["place"] > F.col("_place")))
    spread = alike.join(F.broadcast(calendar), F.lit(True)).withColumn("eval_date", F.explode(F.transform(sees, lambda f: f["eval_date"]))).drop("_all")
    return spread.groupBy(*groups, "eval_date", *xs, y).agg(*sums)


def walk_forward_calibration(rows: DataFrame, date: str, p: str, y: str, w: str, market: str | None = None, min_rows: int = 30,
                             l2: float = 1.0, eps: float = 1e-6, decided_at: str | None = None, resolved_at: str | None = None) -> DataFrame:
    """Platt (and market-aware) probabilities of each row from fits on strictly earlier dates, with the named fallback.

    With both clocks a label teaches a date only if it was resolved before that date's first decision. Rows without a label are
    calibrated and teach nothing. Without enough earlier rows or with one class only the raw probability stands.
    """
    xs = {"_x1": logit(F.col(p), eps)}
    if market is not None:
        xs["_x2"] = logit(F.col(market), eps)
    ready = rows.withColumns(xs)
    both = bool(decided_at and resolved_at)
    dates = rows.groupBy(F.col(date).alias("eval_date")).agg(F.min(decided_at).alias("first_at")) if both else rows.select(F.col(date).alias("eval_date")).distinct()
    known = ready.where(F.col(y).isNotNull())
    fits = fit_logistic(known.select(date, *xs, y, w, *([resolved_at] if both else [])), [], list(xs), y, w, l2, train_date=date, eval_dates=dates, resolved_at=resolved_at if both else None)
    fits = fits.withColumnRenamed("eval_date", date).withColumnRenamed("rows", "train_rows").drop("weight")
    joined = ready.join(fits, [date], "left")
    usable = F.col("status").isin("FITTED", "NOT_CONVERGED") & (F.col("train_rows") >= min_rows)  # the last coefficients stand; the reason tells
    value = sigmoid(_dot(F.col("coefficients"), [F.col(x) for x in xs]))
    reason = F.when(F.col("status").isNull(), "NO_PRIOR_DATES").when(F.col("train_rows") < min_rows, "INSUFFICIENT_ROWS").when(
        F.col("status") != "FITTED", F.col("status"))
    return joined.withColumns({"calibrated": F.when(usable, value).otherwise(F.col(p)), "fallback_reason": reason}).drop(*xs, "coefficients", "status")


def fit_platt(examples: DataFrame, p: str, y: str, scopes: list[str], min_rows: int = 30, l2: float = 1.0) -> DataFrame:
    """Fits per scope tuple and per first scope alone (`*` in the others); scopes with too few rows are left out."""
    first, rest = scopes[0], scopes[1:]
    base = examples.select(*scopes, logit(F.col(p)).alias("_x"), F.col(y).alias("_y"), F.lit(1.0).alias("_wt"))
    wide = base.withColumns({c: F.lit("*") for c in rest})
    fits = fit_logistic(base.unionByName(wide), scopes, ["_x"], "_y", "_wt", l2)
    return fits.where((F.col("rows") >= min_rows) & F.col("status").isin("FITTED", "NOT_CONVERGED")).select(
        *scopes, F.col("coefficients")[0].alias("intercept"), F.col("coefficients")[1].alias("slope"), "rows")


def apply_calibration(df: DataFrame, fits: DataFrame, p: str, scopes: list[str], name: str = "calibrated") -> DataFrame:
    """Calibrate by the exact scope, else by the `*` scope, else keep the raw value; adds the scope used."""
    first, rest = scopes[0], scopes[1:]
    exact = fits.where(F.col(rest[0]) != "*").select(*scopes, F.struct("intercept", "slope").alias("_a"))
    broad = fits.where(F.col(rest[0]) == "*").select(first, F.struct("intercept", "slope").alias("_b"))
    rows = df.join(exact, scopes, "left").join(broad, [first], "left")
    fit = F.coalesce("_a", "_b")
    value = F.when(fit.isNotNull(), sigmoid(fit["intercept"] + fit["slope"] * logit(F.col(p)))).otherwise(F.col(p))
    used = F.when(F.col("_a").isNotNull(), "exact").when(F.col("_b").isNotNull(), "fallback").otherwise("raw")
    return rows.withColumns({name: value, "calibration_scope": used}).drop("_a", "_b")


def calibrated_replay(rows: DataFrame, date: str, p: str, ask: str, y: str, scope: list[str], order: list[Column], edges: list[float]) -> DataFrame:
    """Walk-forward calibrated rows, best candidate per scope, and the result of each edge threshold."""
    from skyledger.operators import select
    from skyledger.operators.metrics import ratio

    fitted = walk_forward_calibration(rows.withColumn("_one", F.lit(1.0)), date, p, y, "_one").withColumn("cal_edge", F.col("calibrated") - F.col(ask))
    best = select.first_by_scope(fitted, scope, [F.round("cal_edge", 9).desc_nulls_last(), *order])
    grid = best.withColumn("threshold", F.explode(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: F.col("cal_edge") >= e)))
    pnl = F.col(y) - F.col(ask)
    return grid.groupBy("threshold").agg(F.count(F.lit(1)).alias("n"), F.sum(pnl).alias("pnl"), ratio(F.sum(pnl), F.sum(ask)).alias("rr"),
                                         F.avg(F.col(y).cast("double")).alias("hit_rate"))


def fit_clusters(clusters: DataFrame, date: str, mass: str, y: str, context: list[str], min_rows: int = 30, n: str | None = None) -> DataFrame:
    """Walk-forward basket calibration by mass alone and with context features, one row per cluster.

    `n` names a column that counts the clusters a row stands for. Both fits and their dates come from one table of distinct
    clusters, so `clusters` is read once for it and once for the result, and not again by the fits.
    """
    counted = clusters.withColumn("_n", (F.col(n) if n else F.lit(1)).cast("long"))
    alike = materialize(counted.groupBy(date, mass, *context, y).agg(F.sum("_n").alias("_n")))
    xs = {"_x0": logit(F.col(mass))} | {f"_x{i}": F.col(c).cast("double") for i, c in enumerate(context, 1)}
    known = alike.where(F.col(y).isNotNull()).withColumns(xs)
    dates = alike.select(F.col(date).alias("eval_date")).distinct()
    out = clusters.withColumns(xs)
    for name, used in (("mass_calibrated", [*xs][:1]), ("context_calibrated", [*xs])):
        fits = fit_logistic(known.select(date, *used, y, "_n"), [], used, y, "_n", train_date=date, eval_dates=dates, n="_n")
        out = out.join(fits.select(F.col("eval_date").alias(date), "coefficients", "status", F.col("rows").alias("_rows")), [date], "left")
        usable = F.col("status").isin("FITTED", "NOT_CONVERGED") & (F.col("_rows") >= min_rows)
        value = sigmoid(_dot(F.col("coefficients"), [F.col(x) for x in used]))
        out = out.withColumn(name, F.when(usable, value).otherwise(F.col(mass))).drop("coefficients", "status", "_rows")
    return out.drop(*xs)
