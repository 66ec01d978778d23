"""Ordered folds whose next step depends on what was kept before: caps, re-entry, ladder walks.

A group is first reduced by exact rules (rows that no fold state could accept are dropped slice by slice), then the
survivors stream through one sorted pass per group that holds only the running state, never the group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], dict],
                 step: Callable[[dict, tuple], tuple], inputs: list[str], outputs: str) -> DataFrame:
    """Stream each group in order through `step(state, input values) -> output values`; the state may be changed in
    place. Groups never leave their sorted partition and batches are released as they pass."""
    extra = StructType.fromDDL(outputs)
    schema = StructType([*df.schema.fields, *extra.fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            results = []
            marks = list(zip(*[batch[k].tolist() for k in keys]))
            values = zip(*[batch[c].tolist() for c in inputs])
            for mark, value in zip(marks, values):
                if mark != current:
                    current, state = mark, start()
                results.append(step(state, value))
            for position, field in enumerate(extra.fields):
                batch[field.name] = [r[position] for r in results]
            yield batch[[f.name for f in schema.fields]]

    ordered = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return ordered.mapInPandas(run, schema)


def prune_for_cap(df: DataFrame, keys: list[str], order: list[Column], cost: Column, cap: float) -> DataFrame:
    """Keep rows a greedy cap could still take.

    If a row is taken, every earlier row of the same cost was taken too (the remainder only falls), so beyond the
    first `cap/cost` rows of one cost nothing can be taken. The rule holds in any subset of the rows, so it is applied
    per input partition first, which splits a hot group, and then per group.
    """
    room = F.when(cost > 0, F.floor((cap + 1e-9) / cost)).otherwise(F.lit(2**62))
    slim = df.withColumns({"_cost": cost, "_room": room}).where(F.col("_cost") <= cap + 1e-9)
    slim = slim.withColumn("_pid", F.spark_partition_id())
    for extra in (["_pid"], []):
        by_cost = Window.partitionBy(*keys, "_cost", *extra).orderBy(*order)
        slim = slim.withColumn("_rn", F.row_number().over(by_cost)).where(F.col("_rn") <= F.col("_room"))
    return slim.drop("_cost", "_room", "_rn", "_pid")


def greedy_cap(df: DataFrame, keys: list[str], order: list[str], cost: str, cap: float) -> DataFrame:
    """Rows taken in order while the running cost stays within the cap; a row that does not fit is skipped whole and
    later, smaller rows may still fit. Adds `used` (running cost after the row)."""
    pruned = prune_for_cap(df, keys, [F.col(c) for c in order], F.col(cost), cap)

    def step(state, value):
        amount = value[0]
        if amount is None or state["used"] + amount > cap + 1e-9:
            return False, state["used"]
        state["used"] += amount
        return True, state["used"]

    folded = ordered_fold(pruned, keys, order, lambda: {"used": 0.0}, step, [cost], "taken boolean, used double")
    return folded.where("taken").drop("taken")


def greedy_cap_in_place(df: DataFrame, keys: list[str], row: Column, cap: float | Column, extra: list[Column] = ()) -> DataFrame:
    """The greedy cap over groups whose size another key bounds (a row a station on one date): each is folded as an array.

    `row` is a struct that begins with the order and holds `cost`. Gives the keys and the fields of the rows taken.
    """
    grouped = df.groupBy(*keys, *extra).agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    kind = grouped.schema["_rows"].dataType.simpleString()
    start = F.struct(F.lit(0.0).alias("used"), F.array().cast(kind).alias("took"))

    def step(acc: Column, r: Column) -> Column:
        fits = acc["used"] + r["cost"] <= cap + 1e-9
        return F.when(fits, F.struct((acc["used"] + r["cost"]).alias("used"), F.concat(acc["took"], F.array(r)).alias("took"))).otherwise(acc)

    taken = grouped.withColumn("_took", F.aggregate("_rows", start, step, lambda acc: acc["took"])).drop("_rows")
    return taken.withColumn("_r", F.explode("_took")).select(*keys, "_r.*")


def equal_cost_cap(df: DataFrame, keys: list[str], order: list[Column], cost: float, cap: float) -> DataFrame:
    """The greedy cap when every row costs the same: the first `cap/cost` rows, no fold needed."""
    from skyledger.operators.select import top_n

    return top_n(df, keys, order, int((cap + 1e-9) // cost)).drop("rank")


def edge_improve(df: DataFrame, keys: list[str], slice_by: Column, order: list[str], edge: str, ratio: float = 1.5) -> DataFrame:
    """Keep the first row, then rows whose edge is at least `ratio` times the last kept positive edge.

    Only a strict record high of positive edges can be kept after the first row, so everything else is dropped by a
    sliced running maximum before the fold.
    """
    from skyledger.operators import scan

    cols = [F.col(c) for c in order]
    positive = F.when(F.col(edge) > 0, F.col(edge))
    seen = scan.running(df, keys, slice_by, cols, {"_best": ("max", positive), "_n": ("sum", F.lit(1))}, inclusive=False)
    first = F.col("_n") == 0
    record = (F.col(edge) > 0) & (F.col("_best").isNull() | (F.col(edge) > F.col("_best")))
    slim = seen.where(first | record).drop("_best", "_n")

    def step(state, value):
        amount = value[0]
        usable = amount is not None and amount == amount
        if state["first"]:
            state["first"] = False
            state["last"] = amount if usable and amount > 0 else None
            return (True,)
        keep = usable and amount > 0 and (state["last"] is None or amount >= ratio * state["last"])
        if keep:
            state["last"] = amount
        return (keep,)

    folded = ordered_fold(slim, keys, order, lambda: {"first": True, "last": None}, step, [edge], "kept boolean")
    return folded.where("kept").drop("kept")


def two_cap_fold(df: DataFrame, keys: list[str], inner: list[str], order: list[str], cost: str, outer_cap: float,
                 inner_cap: float, slice_by: Column) -> DataFrame:
    """Whole-row rejection under an outer cap per `keys` and an inner cap per `keys + inner`; adds `cap_reason` (null = taken).

    `order` must identify a row inside its group and `slice_by` must not decrease along it. Both remainders only fall, so beyond
    the first `inner_cap/cost` rows of one cost in an inner group nothing can be taken: only the others enter the fold. Every row
    comes back: a rejected one is blamed on the outer cap if that was too full for it at its place, else on the inner one.
    """
    from skyledger.operators import scan

    order_cols = [F.col(c) for c in order]
    slim = df.select(*keys, *inner, *order, cost)
    pruned = prune_for_cap(slim, [*keys, *inner], order_cols, F.col(cost), inner_cap)
    width = len(inner)

    def step(state, value):
        amount, group = value[0], value[1:1 + width]
        held = state["inner"].get(group, 0.0)
        if state["outer"] + amount > outer_cap + 1e-9 or held + amount > inner_cap + 1e-9:
            return (False,)
        state["outer"] += amount
        state["inner"][group] = held + amount
        return (True,)
    run = ordered_fold(pruned, keys, order, lambda: {"outer": 0.0, "inner": {}}, step, [cost, *inner], "_taken boolean")
    ident = list(dict.fromkeys([*keys, *inner, *order]))
    full = df.join(run.where("_taken").select(*ident, "_taken"), ident, "left")
    spent = F.when(F.col("_taken"), F.col(cost)).otherwise(0.0)
    placed = scan.running(full, keys, slice_by, order_cols, {"_used": ("sum", spent, False)})
    reason = F.when(F.col("_taken"), None).when(F.col("_used") + F.col(cost) > outer_cap + 1e-9, "OUTER_CAP").otherwise("INNER_CAP")
    return placed.withColumn("cap_reason", reason.cast("string")).drop("_taken", "_used")
