"""Rules as boxes over a few dimensions, answered from a cube of cells.

A rule fixes one option in each dimension (a side, a floor, a window), and a row meets the options that its values satisfy. Rows
that meet the same options in all dimensions lie in one cell, so every question about a rule is a question about its cells. The
cube is closed one dimension at a time: a cell is handed to each option it meets in that dimension, the dimension is dropped,
and cells that have become equal are reduced at once. Counts and fingerprints add up, first rows take the minimum; no row is
ever paired with a rule by ranges.

A state is a rule's options as one integer in mixed radix: the option's index times the product of the sizes of the dimensions
before it.

Where a rule has few conditions the cube is not closed dimension by dimension: a row is handed to its states at once, each of one
dimension after the other, and states are reduced before the dimensions that every rule fixes are closed.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import prod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.operators import select
from skyledger.session import materialize

MOST_OPTIONS = 10_000  # of one dimension; options are a grammar known to the driver
SLACK = 1e-12


@dataclass(frozen=True)
class Dimension:
    """`labels[i]` names option i; `met` is the array of the indexes of the options that a row meets. Where `open` is set,
    option 0 leaves the dimension open, and other options count as conditions."""

    name: str
    labels: tuple[str, ...]
    met: Column
    open: bool = True

    def __post_init__(self):
        if not 0 < len(self.labels) <= MOST_OPTIONS:
            raise ValueError(f"{self.name} has {len(self.labels)} options; 1 to {MOST_OPTIONS} are allowed")


OPEN = "ANY"


def _ints(*columns: Column) -> Column:
    return F.array_compact(F.array(*[c.cast("int") for c in columns]))


def tests(name: str, options: list[tuple[str, Column]], open: bool = True) -> Dimension:
    """Options with a predicate each; a null predicate is not met."""
    first = [F.lit(0)] if open else []
    met = _ints(*first, *[F.when(test, F.lit(i)) for i, (_, test) in enumerate(options, len(first))])
    return Dimension(name, (*([OPEN] if open else []), *[label for label, _ in options]), met, open)


def values(name: str, column: Column, options: list[str], groups: list[tuple[str, Column]] = ()) -> Dimension:
    """One option for each value, found by one look-up, after options for groups of values."""
    known = len(groups) + 1
    met = [F.lit(0), *[F.when(test, F.lit(i)) for i, (_, test) in enumerate(groups, 1)]]
    if options:
        index = F.create_map(*[F.lit(x) for i, v in enumerate(options, known) for x in (v, i)])
        met.append(F.try_element_at(index, column))
    return Dimension(name, (OPEN, *[g for g, _ in groups], *options), _ints(*met))


def floors(name: str, column: Column, bounds: list[float]) -> Dimension:
    """Options `at least b`: a value meets the first k of the ascending bounds, so it needs k alone."""
    ordered = sorted(bounds)
    k = sum((F.coalesce(column >= b - SLACK, F.lit(False)).cast("int") for b in ordered), F.lit(0))
    return Dimension(name, (OPEN, *map(str, ordered)), F.sequence(F.lit(0), k))


def ceilings(name: str, column: Column, bounds: list[float]) -> Dimension:
    """Options `at most b`: a value meets the last k of the ascending bounds; written from the widest to the narrowest."""
    ordered = sorted(bounds, reverse=True)
    k = sum((F.coalesce(column <= b + SLACK, F.lit(False)).cast("int") for b in ordered), F.lit(0))
    return Dimension(name, (OPEN, *map(str, ordered)), F.sequence(F.lit(0), k))


def radices(dims: list[Dimension]) -> list[int]:
    sizes = [len(d.labels) for d in dims]
    if prod(sizes) >= 1 << 62:
        raise ValueError("the options of all dimensions do not fit one integer")
    return [prod(sizes[:i]) for i in range(len(sizes))]


def option_index(dims: list[Dimension], state: Column, name: str) -> Column:
    """Index of the option that a state fixes in one dimension."""
    i = [d.name for d in dims].index(name)
    return (F.floor(state / F.lit(radices(dims)[i])) if radices(dims)[i] > 1 else state).cast("long") % len(dims[i].labels)


def option(dims: list[Dimension], state: Column, name: str) -> Column:
    """Label of the option that a state fixes in one dimension."""
    i = [d.name for d in dims].index(name)
    index = F.floor(state / F.lit(1)).cast("long") if radices(dims)[i] == 1 else F.expr(f"state DIV {radices(dims)[i]}")
    return F.element_at(F.array(*[F.lit(x) for x in dims[i].labels]), (index % len(dims[i].labels) + 1).cast("int"))


def labelled(df: DataFrame, dims: list[Dimension]) -> DataFrame:
    """`df` with a column for each dimension, read from its column `state`."""
    return df.withColumns({d.name: option(dims, F.col("state"), d.name) for d in dims})


def cells(rows: DataFrame, dims: list[Dimension]) -> DataFrame:
    """`rows` with an array column `_m0`, `_m1`, ... for each dimension, unless they have them."""
    return rows if "_m0" in rows.columns else rows.withColumns({f"_m{i}": d.met for i, d in enumerate(dims)})


def close(df: DataFrame, keys: list[str], dims: list[Dimension], sums: dict, most: int | None = None) -> DataFrame:
    """(keys, state, conditions, sums) of every state that some row meets, with at most `most` conditions.

    `df` has a row a cell or more; `sums` maps a column to the aggregate that reduces it. The keys are part of every step, so a
    table that is dealt by them is never dealt again.
    """
    if most is not None:
        return _close_few(df, keys, dims, sums, most)
    left = df.withColumns({"state": F.lit(0).cast("long"), "conditions": F.lit(0)})
    for i, (dim, radix) in enumerate(zip(dims, radices(dims), strict=True)):
        grown = left.withColumn("_o", F.explode(f"_m{i}")).drop(f"_m{i}")
        grown = grown.withColumn("state", F.col("state") + F.col("_o").cast("long") * radix)
        if dim.open:
            grown = grown.withColumn("conditions", F.col("conditions") + (F.col("_o") > 0).cast("int"))
        left = grown.drop("_o")
        if i + 1 == len(dims) or i + 1 == len(dims) // 2:
            rest = [f"_m{j}" for j in range(i + 1, len(dims))]
            left = left.groupBy(*keys, "state", "conditions", *rest).agg(*[fn(name).alias(name) for name, fn in sums.items()])
    return left


def _close_few(df: DataFrame, keys: list[str], dims: list[Dimension], sums: dict, most: int) -> DataFrame:
    """`close` for at most `most` conditions: each step adds a condition of a later open dimension or none, and the options of the
    dimensions that are not open stay one array until the states are reduced."""
    open_at, fixed_at = ([i for i, d in enumerate(dims) if d.open is kind] for kind in (True, False))
    own, of = [*keys, *sums, *[f"_m{i}" for i in fixed_at]], radices(dims)
    radix = F.element_at(F.array(*[F.lit(r).cast("long") for r in (0, *[of[i] for i in open_at])]), F.col("_d") + 1)
    options = F.array(F.array(F.lit(0)), *[F.col(f"_m{i}") for i in open_at])
    left = df.withColumns({"state": F.lit(0).cast("long"), "conditions": F.lit(0), "_last": F.lit(0)})
    for i in fixed_at:
        left = left.where(F.size(f"_m{i}") > 0)
    for step in range(min(most, len(open_at))):
        masks = [f"_m{i}" for i in open_at] if step + 1 < most else []
        grown = left.select(*own, *masks, "state", "conditions", "_last", F.posexplode(options).alias("_d", "_s")).where("_d = 0 or _d > _last")
        grown = grown.select(*own, *masks, "state", "conditions", "_d", F.explode("_s").alias("_o")).where("_d = 0 or _o > 0")
        left = grown.select(*own, *masks, (F.col("state") + F.col("_o").cast("long") * radix).alias("state"), (F.col("conditions") + (F.col("_d") > 0).cast("int")).alias("conditions"),
                            F.when(F.col("_d") > 0, F.col("_d")).otherwise(len(open_at)).alias("_last"))
    fixed = [f"_m{i}" for i in fixed_at]
    left = left.groupBy(*keys, "state", "conditions", *fixed).agg(*[fn(name).alias(name) for name, fn in sums.items()])
    for i in fixed_at:
        left = left.withColumn("_o", F.explode(f"_m{i}")).withColumn("state", F.col("state") + F.col("_o").cast("long") * of[i]).drop("_o", f"_m{i}")
    return left.groupBy(*keys, "state", "conditions").agg(*[fn(name).alias(name) for name, fn in sums.items()]) if fixed else left


def supports(rows: DataFrame, keys: list[str], row_id: str, dims: list[Dimension], most: int | None = None) -> DataFrame:
    """(keys, state, conditions, matched, _a, _b): how many rows each state matches, and two order-free fingerprints of them.

    Rows are reduced to cells, or to states where these are few, in map tasks before anything moves, so a hot key costs as many
    rows as it has cells.
    """
    a, b = F.xxhash64(row_id), F.xxhash64(F.lit("b"), row_id)
    slim = cells(rows, dims).select(*keys, *[f"_m{i}" for i in range(len(dims))], a.alias("_a"), b.alias("_b"))
    if most is not None:
        return close(slim.withColumn("matched", F.lit(1).cast("long")), keys, dims, {"matched": F.sum, "_a": F.bit_xor, "_b": F.bit_xor}, most)
    start = slim.groupBy(*keys, *[f"_m{i}" for i in range(len(dims))]).agg(F.count(F.lit(1)).alias("matched"), F.bit_xor("_a").alias("_a"), F.bit_xor("_b").alias("_b"))
    return close(start, keys, dims, {"matched": F.sum, "_a": F.bit_xor, "_b": F.bit_xor}, most)


def distinct_behaviours(found: DataFrame, keys: list[str], dims: list[Dimension], minimum: int, apart: list[str]) -> DataFrame:
    """Of the states that match the same rows (and share the options of `apart`) the least complex, then the smallest state."""
    kept = found.where(F.col("matched") >= minimum)
    for name in apart:
        kept = kept.withColumn(f"_{name}", option(dims, F.col("state"), name))
    return select.first_by_scope(kept, [*keys, "matched", "_a", "_b", *[f"_{n}" for n in apart]], [F.col("conditions"), F.col("state")]).select(*keys, "state", "conditions", "matched")


def ranked(rows: DataFrame, scope: list[str], order: list[str], dims: list[Dimension], others: list[str | Column]) -> DataFrame:
    """Scope, order and `others` of the rows, their cells and `_rank`, their place in the order of their scope, stored.

    Cells and `others` are told after the rows have been dealt, so what the dimensions read is computed once a row and not once an option.
    """
    numbered = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*scope).orderBy(*order)))
    masks = [f"_m{i}" for i in range(len(dims))]
    return materialize(cells(numbered, dims).select(*scope, *order, *others, *masks, "_rank"))


def first_rows(rows: DataFrame, scope: list[str], order: list[str], dims: list[Dimension], payload: list[str], most: int | None = None, states: DataFrame | None = None) -> DataFrame:
    """(scope, state, conditions, order, payload): the first row that each state matches in each scope; of `states` alone, if given.

    In a scope only the first row of a cell can be first for any rule; the others go inside map tasks. What is left is numbered
    in the scope's order and stored, the cube is closed over these numbers, and the rows are found again by number. With few
    conditions hardly any two rows share a cell, so all rows are numbered (or come from `ranked`), and a row is found again once
    for all states that it is the first of.
    """
    masks, wanted = [f"_m{i}" for i in range(len(dims))], [c for c in (states.columns if states is not None else ()) if c in scope or c == "state"]

    def asked(firsts: DataFrame) -> DataFrame:
        return firsts if states is None else firsts.join(states.select(*wanted).distinct(), wanted, "left_semi")

    if most is None:
        leading = ranked(select.first_by_scope(cells(rows, dims), [*scope, *masks], [F.col(c) for c in order]), scope, order, dims, payload)
        firsts = asked(close(leading.select(*scope, "_rank", *masks), scope, dims, {"_rank": F.min}))
        return firsts.join(leading.select(*scope, "_rank", *order, *payload), [*scope, "_rank"]).drop("_rank")
    numbered = rows if "_rank" in rows.columns else ranked(rows, scope, order, dims, payload)
    firsts = asked(close(numbered.select(*scope, "_rank", *masks), scope, dims, {"_rank": F.min}, most))
    won = firsts.groupBy(*scope, "_rank").agg(F.collect_list(F.struct("state", "conditions")).alias("_won"))
    found = numbered.select(*scope, "_rank", *order, *payload).join(won, [*scope, "_rank"])
    return found.withColumn("_w", F.explode("_won")).select(*scope, "_w.state", "_w.conditions", *order, *payload)
