"""Distributions on ladders and on the fixed integer support."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.arrays import let, total
from skyledger.functions.prob import normal_cdf, standard_cdf
from skyledger.operators import scan

# fixed values: the integer support in degrees Fahrenheit.
LOW, HIGH = -20, 130
CELLS = HIGH - LOW + 1



def normalize(p: Column) -> Column:
    """Array divided by its sum; null when there is no positive mass or a negative cell."""
    def scaled(cells: Column) -> Column:
        bad = F.exists(cells, lambda x: x.isNull() | F.isnan(x) | (x < 0))
        return let(total(cells), lambda mass: F.when((mass > 0) & ~bad, F.transform(cells, lambda x: x / mass)))
    return let(p, scaled)


def normalize_ladder(df: DataFrame, keys: list[str], score: str, name: str) -> DataFrame:
    """Clip at zero and divide by the ladder sum; a ladder without mass becomes uniform."""
    clipped = df.withColumn("_s", F.greatest(F.coalesce(F.col(score), F.lit(0.0)), F.lit(0.0)))
    sized = scan.with_totals(clipped, keys, _sum=F.sum("_s"), _n=F.count(F.lit(1)))
    share = F.when(F.col("_sum") > 0, F.col("_s") / F.col("_sum")).otherwise(1.0 / F.col("_n"))
    return sized.withColumn(name, share).drop("_s", "_sum", "_n")


def bucket_ladder(df: DataFrame, final: str, each_side: int) -> DataFrame:
    """Left tail, unit buckets around the floor of the final value, right tail; one row per bucket."""
    centre = F.floor(F.col(final)).cast("double")
    rows = df.where(F.col(final).isNotNull()).withColumn(
        "bucket_index", F.explode(F.sequence(F.lit(0), F.lit(2 * each_side + 2))))
    lower = F.when(F.col("bucket_index") > 0, centre - each_side + F.col("bucket_index") - 1)
    upper = F.when(F.col("bucket_index") < 2 * each_side + 2, centre - each_side + F.col("bucket_index"))
    rows = rows.withColumns({"bucket_lower": lower, "bucket_upper": upper})
    inside = (F.col("bucket_lower").isNull() | (F.col(final) >= F.col("bucket_lower"))) & (
        F.col("bucket_upper").isNull() | (F.col(final) < F.col("bucket_upper")))
    return rows.withColumn("target", inside.cast("int"))


def fixed_support(df: DataFrame, low: int = LOW, high: int = HIGH) -> DataFrame:
    """One row per support cell with unit bounds; the two end cells are tails."""
    rows = df.withColumn("support_value", F.explode(F.sequence(F.lit(low), F.lit(high))))
    return rows.withColumns({
        "bucket_lower": F.when(F.col("support_value") > low, F.col("support_value").cast("double")),
        "bucket_upper": F.when(F.col("support_value") < high, F.col("support_value") + 1.0),
    })


def threshold_examples(df: DataFrame, final: str, offsets: list[int], low: bool = False) -> DataFrame:
    """Thresholds at half-even rounded offsets from the final value, with the binary target."""
    rows = df.where(F.col(final).isNotNull()).withColumn("_o", F.explode(F.array(*[F.lit(o) for o in offsets])))
    rows = rows.withColumn("threshold", F.rint(F.col(final) + F.col("_o"))).drop("_o")
    hit = F.col(final) <= F.col("threshold") if low else F.col(final) >= F.col("threshold")
    return rows.withColumn("target", hit.cast("int"))


def empirical_bucket_prob(candidates: DataFrame, residuals: DataFrame, window: str, mu: str, lower: str, upper: str,
                          residual: str, name: str, resolution: float = 1.0) -> DataFrame:
    """Share of a window's residuals that put the final value in `[lower, upper)`.

    Residuals are counted once per (window, value) and cumulated; a bucket's share is the difference of two as-of
    lookups into that cumulative table, so no residual list is ever held per row or per window. A window with no
    residual of its own uses all of them.
    """
    from skyledger.operators.asof import asof_join

    step = 1e-6
    base = residuals.where(F.col(residual).isNotNull()).select(F.col(window).alias("_w"), F.col(residual).alias("_v"))
    both = base.unionByName(base.withColumn("_w", F.lit("*")))
    counts = both.groupBy("_w", "_v").agg(F.count(F.lit(1)).alias("_n"))
    cum = scan.running(counts, ["_w"], F.floor(F.col("_v") / resolution), [F.col("_v")], {"_cum": ("sum", F.col("_n"))})
    sizes = counts.groupBy("_w").agg(F.sum("_n").alias("_size"))
    rows = candidates.join(sizes.select(F.col("_w").alias(window), F.col("_size").alias("_own")), [window], "left")
    rows = rows.withColumn("_w", F.when(F.col("_own").isNotNull(), F.col(window)).otherwise(F.lit("*"))).drop("_own")

    def clock(v: Column) -> Column:
        return F.timestamp_micros(F.round(v / step).cast("long"))
    # strictly-below counts: the residual clock must be before the bound's clock
    for side, bound in (("lo", lower), ("hi", upper)):
        rows = asof_join(rows, cum, ["_w"], clock(F.col(bound) - F.col(mu)), clock(F.col("_v")), {f"_{side}": F.col("_cum")},
                         exact=False, slice_us=int(resolution / step), prefix="").drop("matched_us")
    rows = rows.join(sizes, ["_w"], "left")
    below_hi = F.when(F.col(upper).isNull(), F.col("_size")).otherwise(F.coalesce("_hi", F.lit(0)))
    below_lo = F.when(F.col(lower).isNull(), F.lit(0)).otherwise(F.coalesce("_lo", F.lit(0)))
    return rows.withColumn(name, (below_hi - below_lo) / F.col("_size")).drop("_w", "_lo", "_hi", "_size")


def normal_bucket_prob(mu: Column, sigma: Column, lower: Column, upper: Column) -> Column:
    scale = F.greatest(sigma, F.lit(1e-6))
    below = F.when(lower.isNull(), F.lit(0.0)).otherwise(normal_cdf(lower, mu, scale))
    upto = F.when(upper.isNull(), F.lit(1.0)).otherwise(normal_cdf(upper, mu, scale))
    return F.greatest(upto - below, F.lit(0.0))


def normal_support(mu: Column, sigma: Column, low: int = LOW, high: int = HIGH) -> Column:
    """Normal mass per integer cell with half-degree edges; end cells hold the tails; sigma at least one half."""
    # location and scale are named once a row: in the lambda they would be computed anew for every cell
    shape = F.struct(mu.alias("mu"), (F.greatest(sigma, F.lit(0.5)) * math.sqrt(2.0)).alias("scale"))
    edges = let(shape, lambda at: F.transform(F.sequence(F.lit(low), F.lit(high - 1)), lambda v: standard_cdf((v + 0.5 - at["mu"]) / at["scale"])))

    def cells(cuts: Column) -> Column:
        upto = F.concat(cuts, F.array(F.lit(1.0)))
        below = F.concat(F.array(F.lit(0.0)), cuts)
        return F.zip_with(upto, below, lambda u, b: F.greatest(u - b, F.lit(0.0)))
    return normalize(let(edges, cells))


def monotone_bucket_prob(df: DataFrame, ladder: list[str]) -> DataFrame:
    """Bucket probability from survival at its two thresholds, made non-increasing per ladder.

    The decreasing isotonic fit of equally weighted cutpoints is the min-max formula: at cutpoint i the largest over
    ends j>=i of the smallest over starts k<=i of mean(k..j) is taken the other way round for a decreasing fit. A
    ladder has at most a few dozen cutpoints, so the formula runs as array functions inside the row of the ladder.
    """
    points = df.select(*ladder, F.explode(F.array(
        F.struct(F.col("lower_threshold").alias("t"), F.col("lower_survival").alias("s")),
        F.struct(F.col("upper_threshold").alias("t"), F.col("upper_survival").alias("s")))).alias("_c"))
    means = points.where("_c.t is not null and _c.s is not null").groupBy(*ladder, F.col("_c.t").alias("t")).agg(
        F.least(F.greatest(F.avg("_c.s"), F.lit(0.0)), F.lit(1.0)).alias("s"))
    curves = means.groupBy(*ladder).agg(F.array_sort(F.collect_list(F.struct("t", "s"))).alias("_curve"))
    # prefix sums once per ladder, so the mean of cutpoints k..j is one subtraction
    values = F.transform("_curve", lambda x: x["s"])
    sums = F.transform(F.sequence(F.lit(0), F.size("_curve")), lambda i: total(F.slice(values, 1, i)))
    curves = curves.withColumn("_sums", sums)
    n = F.size("_curve")

    def fitted(i: Column) -> Column:
        return F.array_min(F.transform(F.sequence(F.lit(1), i), lambda k: F.array_max(
            F.transform(F.sequence(i, n), lambda j: (F.get("_sums", j) - F.get("_sums", k - 1)) / (j - k + 1)))))
    fits = curves.select(*ladder, F.map_from_arrays(
        F.transform("_curve", lambda x: x["t"]),
        F.transform(F.sequence(F.lit(1), n), fitted)).alias("_fit"))
    rows = df.join(fits, ladder, "left")
    low = F.when(F.col("lower_threshold").isNull(), F.lit(1.0)).otherwise(F.try_element_at("_fit", F.col("lower_threshold")))
    high = F.when(F.col("upper_threshold").isNull(), F.lit(0.0)).otherwise(F.try_element_at("_fit", F.col("upper_threshold")))
    return rows.withColumn("probability", F.greatest(low - high, F.lit(0.0))).drop("_fit")


def condition_lower(p: Column, value: Column, low: int = LOW) -> Column:
    """Zero mass below an observed whole value and renormalise; a point mass there when nothing is left."""
    at = F.rint(value).cast("int") - low
    kept = F.transform(p, lambda x, i: F.when(i >= at, x).otherwise(0.0))
    point = F.transform(p, lambda x, i: F.when(i == at, 1.0).otherwise(0.0))
    return let(kept, lambda cells: let(total(cells), lambda mass: F.when(
        mass > 0, F.transform(cells, lambda x: x / mass)).otherwise(point)))


def _shift_whole(p: Column, steps: Column) -> Column:
    """Move an array by whole cells; what would leave it is added to its end cell."""
    n = F.size(p)
    right, left = F.least(F.greatest(steps, F.lit(0)), n), F.least(F.greatest(-steps, F.lit(0)), n)
    zero = F.lit(0.0)
    core = F.concat(F.array_repeat(zero, right), F.slice(p, left + 1, n - right - left), F.array_repeat(zero, left))
    ends = F.struct(total(F.slice(p, 1, left)).alias("low"), total(F.slice(p, n - right + 1, right)).alias("high"))
    return let(ends, lambda e: F.transform(core, lambda x, i: x + F.when(i == 0, e["low"]).otherwise(0.0) + F.when(i == n - 1, e["high"]).otherwise(0.0)))


def shift_distribution(p: Column, correction: Column) -> Column:
    """Move mass by a fractional number of degrees, split linearly; mass leaving the support stays at its end."""
    whole = F.floor(correction).cast("int")
    part = correction - F.floor(correction)
    return normalize(let(p, lambda cells: F.zip_with(
        _shift_whole(cells, whole), _shift_whole(cells, whole + 1), lambda a, b: a * (1.0 - part) + b * part)))


def hurdle_distribution(peak: Column, deltas: Column, high: Column, low: int = LOW, top: int = HIGH) -> Column:
    """Peak mass at the high so far, the remainder spread over positive deltas (array of mass for +1, +2, ...),
    clamped at the top cell."""
    at = F.rint(high).cast("int")

    def cell(v: Column) -> Column:
        stay = F.when(v == at, peak).otherwise(0.0)
        step = (v - at).cast("int")
        move = F.when((step >= 1) & (step <= F.size(deltas)) & (v < top), F.try_element_at(deltas, F.greatest(step, F.lit(1)))).otherwise(0.0)
        rest = F.when(v == top, total(F.slice(deltas, F.greatest(F.lit(top) - at, F.lit(1)), F.greatest(F.size(deltas) - F.greatest(F.lit(top) - at, F.lit(1)) + 1, F.lit(0))))).otherwise(0.0)
        return stay + (1.0 - peak) * (F.coalesce(move, F.lit(0.0)) + rest)
    return normalize(F.transform(F.sequence(F.lit(low), F.lit(top)), cell))


def ordinal_deltas(survival: Column) -> Column:
    """Mass per delta from survival P(delta >= k), k = 1.., made non-increasing by a running minimum."""
    falling = F.transform(survival, lambda x, i: F.array_min(F.slice(survival, 1, i + 1)))
    return let(falling, lambda f: F.transform(f, lambda x, i: F.greatest(
        x - F.when(i + 1 < F.size(f), F.get(f, i + 1)).otherwise(0.0), F.lit(0.0))))


def ladder_to_support(df: DataFrame, ladder: list[str], price: str, low: int = LOW, high: int = HIGH) -> DataFrame:
    """Project a half-open ladder onto the support, uniform inside each bucket.

    A ladder that leaves a cell uncovered, covers one twice, has a bucket without cells or no positive mass is
    rejected with a reason. Each bucket is spread over its own cells only; a ladder has as many cells as the support.
    """
    first = F.greatest(F.coalesce(F.col("bucket_lower").cast("int"), F.lit(low)), F.lit(low))
    last = F.least(F.coalesce(F.col("bucket_upper").cast("int") - 1, F.lit(high)), F.lit(high))
    rows = df.withColumns({"_a": first, "_z": last})
    rows = scan.with_totals(rows, ladder, _mass=F.sum(price), _neg=F.max((F.coalesce(F.col(price), F.lit(-1.0)) < 0).cast("int")),
                            _void=F.max((F.col("_a") > F.col("_z")).cast("int")))
    cells = rows.withColumn("cell", F.explode_outer(F.when(F.col("_a") <= F.col("_z"), F.sequence("_a", "_z"))))
    share = F.col(price) / F.col("_mass") / (F.col("_z") - F.col("_a") + 1)
    flat = cells.groupBy(*ladder, "cell").agg(F.sum(share).alias("_p"), F.count(F.lit(1)).alias("_k"),
                                              *[F.max(c).alias(c) for c in ("_mass", "_neg", "_void")])
    packed = flat.groupBy(*ladder).agg(
        F.array_sort(F.collect_list(F.when(F.col("cell").isNotNull(), F.struct("cell", "_p")))).alias("_cells"),
        F.max("_k").alias("_twice"), *[F.max(c).alias(c) for c in ("_mass", "_neg", "_void")])
    reason = (
        F.when((F.col("_neg") == 1) | (F.col("_mass") <= 0), F.lit("invalid_prices"))
        .when(F.col("_void") == 1, F.lit("bucket_without_cells"))
        .when(F.col("_twice") > 1, F.lit("overlapping_buckets"))
        .when(F.size("_cells") != high - low + 1, F.lit("uncovered_cells"))
    )
    return packed.withColumn("reason", reason).select(
        *ladder, F.when(F.col("reason").isNull(), F.transform("_cells", lambda x: x["_p"])).alias("p"), "reason")


def bucket_mass(p: Column, lower: Column, upper: Column, low: int = LOW) -> Column:
    """Mass of a support distribution inside inclusive bounds."""
    start = F.greatest(F.coalesce(F.ceil(lower), F.lit(low)) - low, F.lit(0)).cast("int")
    stop = F.least(F.coalesce(F.floor(upper), F.lit(low) + F.size(p) - 1) - low, F.size(p) - 1).cast("int")
    return F.when(stop >= start, total(F.slice(p, start + 1, F.greatest(stop - start + 1, F.lit(0))))).otherwise(0.0)


def fit_convex_weight(df: DataFrame, left: str, right: str, rounds: int = 3, steps: int = 20) -> DataFrame:
    """Blend weight in [0, 1] minimising mean log loss of the chosen cell's blended mass.

    The objective is convex, so a grid is narrowed around its best point; each round is one partial aggregate over
    the rows, and only the 21 grid losses come back.
    """
    centre, width = 0.5, 0.5
    for _ in range(rounds):
        lo, hi = max(0.0, centre - width), min(1.0, centre + width)
        grid = [lo + (hi - lo) * i / steps for i in range(steps + 1)]
        w = F.col("_w")
        loss = -F.log(F.greatest(F.least(w * F.col(left) + (1.0 - w) * F.col(right), F.lit(1.0)), F.lit(1e-12)))
        per = df.withColumn("_w", F.explode(F.array(*[F.lit(g) for g in grid]))).groupBy("_w").agg(F.avg(loss).alias("loss"))
        best = per.agg(F.min_by("_w", F.struct("loss", "_w")).alias("w"), F.min("loss").alias("loss"))
        row = best.first()
        centre, width = row["w"], (hi - lo) / steps
    return df.sparkSession.createDataFrame([(float(centre), float(row["loss"]))], "weight double, log_loss double")


# the temperature grid: 80 geometric steps from 0.25 to 8.
TEMPERATURES = tuple(0.25 * 32.0 ** (i / 79) for i in range(80))


def with_temperature(p: Column, temperature: Column) -> Column:
    """softmax(log p / T) of an array; equal to the normalised powers p^(1/T)."""
    logits = F.transform(p, lambda x: F.log(F.least(F.greatest(x, F.lit(1e-6)), F.lit(1.0 - 1e-6))) / temperature)
    powers = let(logits, lambda z: let(F.array_max(z), lambda top: F.transform(z, lambda x: F.exp(x - top))))
    return let(powers, lambda e: let(total(e), lambda mass: F.transform(e, lambda x: x / mass)))


def fit_temperatures(df: DataFrame, p: str, target_index: str, minimum: int, model: str = "model_name",
                     station: str = "station", grid: tuple[float, ...] = TEMPERATURES) -> DataFrame:
    """Best temperature per (model, station) and per model (`*`), where enough snapshots exist.

    The loss of each grid value is a partial aggregate per station; the model level adds the station sums up.
    """
    rows = df.withColumn("temperature", F.explode(F.array(*[F.lit(t) for t in grid])))
    chosen = F.try_element_at(with_temperature(F.col(p), F.col("temperature")), F.col(target_index) + 1)
    loss = -F.log(F.least(F.greatest(chosen, F.lit(1e-6)), F.lit(1.0 - 1e-6)))
    per = rows.groupBy(model, station, "temperature").agg(F.sum(loss).alias("_l"), F.count(F.lit(1)).alias("_n"))
    scoped = per.unionByName(per.withColumn(station, F.lit("*"))).groupBy(model, station, "temperature").agg(
        (F.sum("_l") / F.sum("_n")).alias("_loss"), F.sum("_n").alias("snapshots"))
    return scoped.where(F.col("snapshots") >= minimum).groupBy(model, station).agg(
        F.min_by("temperature", F.struct("_loss", "temperature")).alias("temperature"),
        F.min("_loss").alias("log_loss"), F.max("snapshots").alias("snapshots"))


def prune_duplicates(names: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected components over duplicate edges; the earliest name of a component represents it.

    `names(name, position)`, `edges(a, b)`. Labels spread to the smallest position over edges and then jump to their
    own label's label, so the rounds grow with the logarithm of the longest chain; each round is checkpointed.
    """
    from skyledger.session import cut_lineage

    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    links = both.join(names.select(F.col("name").alias("a"), F.col("position").alias("_pa")), ["a"]).join(
        names.select(F.col("name").alias("b"), F.col("position").alias("_pb")), ["b"]).select(
        F.col("_pa").alias("u"), F.col("_pb").alias("v"))
    links = cut_lineage(links)
    labels = cut_lineage(names.select(F.col("position").alias("node"), F.col("position").alias("label")))
    while True:
        near = links.join(labels.select(F.col("node").alias("v"), F.col("label").alias("_l")), ["v"]).groupBy(
            F.col("u").alias("node")).agg(F.min("_l").alias("_m"))
        hop = labels.join(near, ["node"], "left").withColumn("label2", F.least("label", F.coalesce("_m", "label")))
        jump = hop.alias("h").join(hop.select(F.col("node").alias("_n"), F.col("label2").alias("_ll")),
                                   F.col("label2") == F.col("_n"), "left")
        new = cut_lineage(jump.select("node", "label", F.least("label2", F.coalesce("_ll", "label2")).alias("new")))
        moved = new.where("new <> label").limit(1).count()
        labels = new.select("node", F.col("new").alias("label"))
        if not moved:
            break
    heads = names.select(F.col("position").alias("label"), F.col("name").alias("representative"))
    return names.join(labels, names["position"] == labels["node"]).join(heads, ["label"]).select(
        "name", "representative",
        F.when(F.col("name") == F.col("representative"), "RETAIN").otherwise("COLLAPSE_DUPLICATE").alias("decision"))


def ladders_from_json(df: DataFrame, ident: str, candidates: str, bounds: DataFrame, low: int = LOW, high: int = HIGH) -> DataFrame:
    """Model and market distributions on the support from a JSON candidate list and the inclusive bounds of its markets.

    `bounds`: market_id, lower, upper. An inclusive upper end becomes half-open by adding one degree.
    """
    parsed = F.from_json(F.col(candidates), "array<struct<market_id:string,fair_yes:double,yes_ask:double>>")
    rows = df.select(ident, F.explode(parsed).alias("c")).select(ident, "c.*").join(bounds, ["market_id"])
    rows = rows.withColumns({"bucket_lower": F.col("lower"), "bucket_upper": F.col("upper") + 1.0})
    model = ladder_to_support(rows, [ident], "fair_yes", low, high).select(ident, F.col("p").alias("model_p"), F.col("reason").alias("model_reason"))
    market = ladder_to_support(rows, [ident], "yes_ask", low, high).select(ident, F.col("p").alias("market_p"), F.col("reason").alias("market_reason"))
    return model.join(market, [ident])
