"""Summaries, calibration and evaluation metrics as one- or two-level aggregates.

The date is the independent unit: where a metric is date-equal, rows are averaged inside a date and dates are averaged
after. Every aggregate is map-side combinable, so a hot key costs no more than its share of the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.prob import log_loss
from skyledger.operators import scan


def ratio(top: Column, bottom: Column) -> Column:
    """Return over risk: null on missing or zero risk."""
    return F.when(bottom != 0, top / bottom)


def sharpe(pnl: Column) -> Column:
    """Mean over population deviation, null when the deviation is zero."""
    spread = F.stddev_pop(pnl)
    return F.when(spread != 0, F.avg(pnl) / spread)


# ---- slices ----

def slice_aggregates(minimum: int, hindsight: bool = False) -> list[Column]:
    """The slice summary over columns pnl (null = unresolved), entry, correct, edge, fair, liquidity, book_age."""
    resolved = F.count("pnl")
    pending = F.count(F.lit(1)) - resolved
    liquidity = F.avg("liquidity")
    risk = F.sum(F.when(F.col("pnl").isNotNull(), F.col("entry")))
    flags = F.concat_ws(
        ",",
        F.when(resolved < minimum, "LOW_N"),
        F.when(pending > resolved, "PENDING_HEAVY"),
        F.when(F.lit(hindsight), "HINDSIGHT_ONLY"),
        F.when(liquidity < 50.0, "EXECUTION_WEAK"),
    )
    return [
        F.count(F.lit(1)).alias("n"), resolved.alias("resolved"), pending.alias("pending"),
        F.avg(F.when(F.col("pnl").isNotNull(), F.col("correct").cast("double"))).alias("win_rate"),
        F.sum("pnl").alias("pnl"), risk.alias("risk"), ratio(F.sum("pnl"), risk).alias("rr"),
        sharpe(F.col("pnl")).alias("sharpe"), F.avg("entry").alias("avg_entry"), F.avg("edge").alias("avg_edge"),
        F.avg("fair").alias("avg_fair"), liquidity.alias("avg_liquidity"), F.avg("book_age").alias("avg_book_age"),
        F.when(flags == "", "OK").otherwise(flags).alias("flags"),
    ]


def summarize_slice(df: DataFrame, keys: list[str], minimum: int, hindsight: bool = False) -> DataFrame:
    return df.groupBy(*keys).agg(*slice_aggregates(minimum, hindsight))


def slice_tables(df: DataFrame, tables: dict[str, list[str]], minimum: int) -> DataFrame:
    """Several slicings in one pass by GROUPING SETS; `slice_table` names the set and `label` joins its key values."""
    keys = sorted({k for cols in tables.values() for k in cols})
    textual = df.withColumns({f"_g_{k}": F.coalesce(F.col(k).cast("string"), F.lit("missing")) for k in keys})
    sets = [[F.col(f"_g_{k}") for k in cols] for cols in tables.values()]
    grouped = textual.groupingSets(sets, *[F.col(f"_g_{k}") for k in keys]).agg(
        F.grouping_id().alias("_gid"), *slice_aggregates(minimum))
    name = None
    for table, cols in tables.items():
        gid = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in cols)
        label = F.concat_ws(" + ", *[F.col(f"_g_{k}") for k in cols])
        value = F.struct(F.lit(table).alias("t"), label.alias("l"))
        name = F.when(F.col("_gid") == gid, value) if name is None else name.when(F.col("_gid") == gid, value)
    return grouped.withColumns({"slice_table": name["t"], "label": name["l"]}).drop("_gid", *[f"_g_{k}" for k in keys])


def coverage_summary(df: DataFrame, opportunity: list[str]) -> DataFrame:
    """Row, resolved and exact distinct counts over the whole input."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.count("pnl").alias("resolved"),
        (F.count(F.lit(1)) - F.count("pnl")).alias("pending"),
        F.countDistinct(F.struct(*opportunity)).alias("unique_opportunities"),
        F.countDistinct("station").alias("stations"), F.countDistinct("market_date").alias("market_dates"),
        F.countDistinct("source").alias("sources"), F.countDistinct("strategy_bucket").alias("strategies"))


def calibration_bands(df: DataFrame, dims: dict[str, Column]) -> DataFrame:
    """Fair against hit rate per band of each dimension, all dimensions in one pass."""
    tagged = df.withColumn("_d", F.explode(F.array(*[
        F.struct(F.lit(n).alias("dim"), c.cast("string").alias("band")) for n, c in dims.items()])))
    done = F.col("correct").isNotNull()
    hit = F.avg(F.col("correct").cast("double"))
    fair = F.avg(F.when(done, F.col("fair")))
    return tagged.groupBy(F.col("_d.dim").alias("dim"), F.col("_d.band").alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.count("correct").alias("resolved"),
        (F.count(F.lit(1)) - F.count("correct")).alias("pending"), F.avg("fair").alias("avg_fair"),
        fair.alias("resolved_avg_fair"), hit.alias("hit_rate"), (hit - fair).alias("cal_error"))


def drawdown_summary(df: DataFrame, keys: list[str], slice_by: Column, order: list[Column], pnl: str) -> DataFrame:
    return scan.drawdown(df, keys, slice_by, order, F.col(pnl))


def scenario_summary(df: DataFrame, keys: list[str], slice_by: Column, order: list[Column]) -> DataFrame:
    """Cost, PnL, wins, weighted price, capacity, drawdown, Wilson interval and standard error per scenario.

    Expects cost, shares, vwap, fill_fraction, label (null = unresolved), disagreement.
    """
    from skyledger.functions.prob import wilson

    venue = F.col("label").isNotNull() & ~F.coalesce(F.col("disagreement"), F.lit(False))
    pnl = F.when(venue, F.when(F.col("label") == 1, F.col("shares") - F.col("cost")).otherwise(-F.col("cost")))
    rows = df.withColumns({"_v": venue, "_pnl": pnl})
    n, wins = F.count("_pnl"), F.sum(F.when(F.col("_v"), F.col("label")).otherwise(0))
    low, high = wilson(F.col("wins").cast("double"), F.col("venue_resolved").cast("double"))
    summary = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("executions"), n.alias("venue_resolved"),
        F.sum(F.when(F.col("_v"), F.col("cost")).otherwise(0.0)).alias("venue_cost"),
        F.sum("_pnl").alias("venue_pnl"), wins.cast("long").alias("wins"), (n - wins).cast("long").alias("losses"),
        ratio(F.sum(F.when(F.col("_v"), F.col("vwap") * F.col("shares"))),
              F.sum(F.when(F.col("_v"), F.col("shares")))).alias("weighted_vwap"),
        F.avg("fill_fraction").alias("avg_fill_fraction"), F.sum("cost").alias("capacity"),
        F.avg("_pnl").alias("mean_pnl"),
        F.when(n > 1, F.stddev_samp("_pnl") / F.sqrt(n)).alias("standard_error"))
    falls = scan.drawdown(rows.where("_v"), keys, slice_by, order, F.col("_pnl")).select(*keys, "max_drawdown")
    return summary.join(falls, keys, "left").withColumns({
        "venue_rr": ratio(F.col("venue_pnl"), F.col("venue_cost")),
        "win_low": low, "win_high": high,
        "max_drawdown": F.coalesce("max_drawdown", F.lit(0.0))})


def concentration(df: DataFrame, keys: list[str], parts: list[str], cost: str = "cost") -> DataFrame:
    """Largest share of cost held by one value of each part, in one grouped pass over partial sums."""
    whole = df.groupBy(*keys).agg(F.sum(cost).alias("_total"))
    out = whole
    for part in parts:
        per = df.groupBy(*keys, part).agg(F.sum(cost).alias("_c")).groupBy(*keys).agg(
            F.max("_c").alias(f"_max_{part}"), F.count(F.lit(1)).alias(f"{part}_count"))
        out = out.join(per, keys).withColumn(f"max_{part}_share", ratio(F.col(f"_max_{part}"), F.col("_total")))
    return out.drop("_total", *[f"_max_{p}" for p in parts])


def markout_summary(df: DataFrame) -> DataFrame:
    """Mean midpoint minus average price by horizon from a map column, over rows whose markouts are valid."""
    rows = df.where("markouts_valid").select("vwap", F.explode("markouts").alias("horizon", "midpoint"))
    return rows.groupBy("horizon").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("midpoint") - F.col("vwap")).alias("mean_markout"))


# ---- probability metrics ----

def binary_metrics(df: DataFrame, p: str, y: str, date: str, keys: list[str] | None = None) -> DataFrame:
    """Date-equal Brier and log loss of a clipped probability."""
    keys = keys or []
    clipped = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1.0 - 1e-6))
    rows = df.where(F.col(p).isNotNull() & ~F.isnan(p)).withColumn("_q", clipped)
    per_date = rows.groupBy(*keys, date).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(F.pow(F.col("_q") - F.col(y), F.lit(2.0))).alias("_b"),
        F.avg(log_loss(F.col("_q"), F.col(y))).alias("_l"), F.avg("_q").alias("_p"),
        F.avg(F.col(y).cast("double")).alias("_y"))
    return per_date.groupBy(*keys).agg(
        F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("dates"), F.avg("_b").alias("brier"),
        F.avg("_l").alias("log_loss"), F.avg("_p").alias("mean_probability"), F.avg("_y").alias("outcome_rate"))


def weighted_metrics(df: DataFrame, p: str, y: str, w: str, date: str, clip: float = 1e-6) -> DataFrame:
    """Weighted probability metrics with calibration in the large; all-zero weights count as one each."""
    q = F.least(F.greatest(F.col(p), F.lit(clip)), F.lit(1.0 - clip))
    rows = df.withColumn("_q", q)

    def mean(x: Column) -> Column:
        weighted = F.sum(F.col(w) * x) / F.sum(w)
        return F.when(F.sum(w) > 0, weighted).otherwise(F.avg(x))
    brier = mean(F.pow(F.col("_q") - F.col(y), F.lit(2.0)))
    return rows.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(date).alias("dates"), F.sum(w).alias("weight_sum"),
        mean(F.col("_q")).alias("mean_probability"), mean(F.col(y).cast("double")).alias("observed_rate"),
        brier.alias("brier"), mean(log_loss(F.col("_q"), F.col(y), clip)).alias("log_loss"),
        (mean(F.col(y).cast("double")) - mean(F.col("_q"))).alias("calibration_in_the_large"))


def reliability(df: DataFrame, p: str, y: str, w: str, width: float) -> DataFrame:
    """Left-closed fixed-width bins, the last one closed."""
    import math

    bins = max(1, math.ceil(1.0 / width))
    index = F.least(F.floor(F.col(p) / width), F.lit(bins - 1))
    return df.groupBy(index.alias("bin")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(w).alias("weight_sum"),
        F.when(F.sum(w) > 0, F.sum(F.col(w) * F.col(p)) / F.sum(w)).otherwise(F.avg(p)).alias("mean_probability"),
        F.when(F.sum(w) > 0, F.sum(F.col(w) * F.col(y)) / F.sum(w)).otherwise(F.avg(F.col(y).cast("double"))).alias("observed_rate"))


def right_closed_bin(value: Column, edges: list[float]) -> Column:
    """Index of the right-closed bin by comparison with the literal edges; the lowest edge is included."""
    chain = F.when(value.isNull() | (value < edges[0]) | (value > edges[-1]), F.lit(None).cast("int"))
    for index, edge in enumerate(edges[1:]):
        chain = chain.when(value <= edge, F.lit(index))
    return chain


def reliability_cut(df: DataFrame, p: str, y: str, edges: list[float], keys: list[str] | None = None) -> DataFrame:
    binned = df.withColumn("bin", right_closed_bin(F.col(p), edges)).where("bin is not null")
    return binned.groupBy(*(keys or []), "bin").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(p).alias("mean_probability"),
        F.avg(F.col(y).cast("double")).alias("observed_rate"))


def binned_report(df: DataFrame, value: str, p: str, y: str, edges: list[float], labels: list[str]) -> DataFrame:
    """Brier, log loss and mean absolute error per named right-closed interval."""
    names = F.array(*[F.lit(x) for x in labels])
    binned = df.withColumn("_b", right_closed_bin(F.col(value), edges)).where("_b is not null")
    return binned.groupBy(F.element_at(names, F.col("_b") + 1).alias("bin")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.col(y).cast("double")).alias("observed_rate"),
        F.avg(p).alias("mean_probability"), F.avg(F.pow(F.col(p) - F.col(y), F.lit(2.0))).alias("brier"),
        F.avg(log_loss(F.col(p), F.col(y))).alias("log_loss"), F.avg(F.abs(F.col(p) - F.col(y))).alias("mean_abs_error"))


def ece(df: DataFrame, p: str, y: str, date: str, edges: list[float]) -> DataFrame:
    """Expected calibration error and signed bias with date-equal weights over explicit left-closed edges."""
    last = len(edges) - 2
    chain = F.lit(None).cast("int")
    for index in range(last, -1, -1):
        upper = F.col(p) <= edges[index + 1] if index == last else F.col(p) < edges[index + 1]
        chain = F.when((F.col(p) >= edges[index]) & upper, F.lit(index)).otherwise(chain)
    per_date = df.withColumn("bin", chain).groupBy(date, "bin").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(p).alias("_p"), F.sum(F.col(y).cast("double")).alias("_y"))
    sized = scan.with_totals(per_date, [date], _size=F.sum("_n"))
    per_bin = sized.groupBy("bin").agg(
        F.sum("_n").alias("rows"), F.sum(F.col("_n") / F.col("_size")).alias("_w"),
        F.sum(F.col("_p") / F.col("_size")).alias("_wp"), F.sum(F.col("_y") / F.col("_size")).alias("_wy"))
    gap = F.abs(F.col("_wp") - F.col("_wy"))
    return per_bin.agg(
        F.sum("rows").alias("rows"), (F.sum(F.when(F.col("bin").isNotNull(), gap)) / F.sum("_w")).alias("ece"),
        ((F.sum("_wp") - F.sum("_wy")) / F.sum("_w")).alias("signed_bias"))


def paired_delta(df: DataFrame, candidate: str, reference: str, y: str, date: str) -> DataFrame:
    """Candidate minus reference losses per date, the input of a date bootstrap."""
    both = df.where(F.col(candidate).isNotNull() & F.col(reference).isNotNull())
    a, b = [F.least(F.greatest(F.col(c), F.lit(1e-6)), F.lit(1 - 1e-6)) for c in (candidate, reference)]
    return both.groupBy(date).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(log_loss(a, F.col(y)) - log_loss(b, F.col(y))).alias("log_loss_delta"),
        F.avg(F.pow(a - F.col(y), F.lit(2.0)) - F.pow(b - F.col(y), F.lit(2.0))).alias("brier_delta"))


def abstention_curve(df: DataFrame, p: str, ask: str, y: str, date: str, thresholds: list[float]) -> DataFrame:
    """Rows, dates, mean edge and date-equal unit PnL when trading only above each edge threshold."""
    edge = F.col(p) - F.col(ask)
    rows = df.where(edge.isNotNull()).withColumn("threshold", F.explode(F.filter(
        F.array(*[F.lit(t) for t in thresholds]), lambda t: edge >= t)))
    per_date = rows.groupBy("threshold", date).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(edge).alias("_e"), F.avg(F.col(y) - F.col(ask)).alias("_pnl"))
    return per_date.groupBy("threshold").agg(
        F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("dates"), (F.sum("_e") / F.sum("_n")).alias("mean_edge"),
        F.avg("_pnl").alias("date_equal_pnl"))


def score_distributions(df: DataFrame, p: str, target_index: Column, date: str, keys: list[str] | None = None) -> DataFrame:
    """Log loss, ranked probability score, threshold Brier, top-cell accuracy and entropy, date-equal."""
    cells = F.col(p)
    n = F.size(cells)
    from skyledger.operators.dists import normalize

    norm = df.withColumns({"_m": normalize(cells), "_i": target_index})
    chosen = F.least(F.greatest(F.try_element_at("_m", F.col("_i") + 1), F.lit(1e-12)), F.lit(1.0))
    start = F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("s"), F.lit(0).alias("k"))
    rps = F.aggregate("_m", start, lambda a, x: F.struct(
        (a["c"] + x).alias("c"),
        (a["s"] + F.pow(a["c"] + x - F.when(a["k"] >= F.col("_i"), 1.0).otherwise(0.0), F.lit(2.0))).alias("s"),
        (a["k"] + 1).alias("k")), lambda a: a["s"])
    top = F.array_position("_m", F.array_max("_m")) - 1
    entropy = F.aggregate("_m", F.lit(0.0), lambda a, x: a - x * F.log(F.least(F.greatest(x, F.lit(1e-12)), F.lit(1.0))))
    rows = norm.select(*(keys or []), date, (-F.log(chosen)).alias("_l"), rps.alias("_r"),
                       (rps / F.greatest(n - 1, F.lit(1))).alias("_t"), (top == F.col("_i")).cast("double").alias("_a"),
                       entropy.alias("_e"))
    per_date = rows.groupBy(*(keys or []), date).agg(
        F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(c) for c in ("_l", "_r", "_t", "_a", "_e")])
    return per_date.groupBy(*(keys or [])).agg(
        F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("dates"), F.avg("_l").alias("log_loss"),
        F.avg("_r").alias("rps"), F.avg("_t").alias("threshold_brier"), F.avg("_a").alias("top_accuracy"),
        F.avg("_e").alias("entropy"))


def ladder_metrics(df: DataFrame, ladder: list[str], p: str, y: str, progress: str, order: str,
                   keys: list[str] | None = None) -> DataFrame:
    """Grouped loss and top-bucket accuracy against the uniform and progress-bucket baselines.

    Ties on the top probability take the smallest bucket index.
    """
    keys = keys or []
    q = F.least(F.greatest(F.col(p), F.lit(1e-12)), F.lit(1.0))
    per = df.groupBy(*keys, *ladder).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.when(F.col(y) == 1, -F.log(q))).alias("_loss"),
        F.sum(F.when(F.col(y) == 1, 1)).alias("_w"),
        F.sum(F.pow(q - F.col(y), F.lit(2.0))).alias("_sq"), F.sum(F.col(y).cast("double")).alias("_pos"),
        F.max_by(y, F.struct(F.col(p), -F.col(order))).alias("_top"),
        F.max(F.when(F.col(progress), F.col(y)).otherwise(0)).alias("_prog"))
    size = F.col("_n").cast("double")
    uniform_brier = (F.col("_pos") * F.pow(1.0 / size - 1.0, F.lit(2.0)) + (size - F.col("_pos")) * F.pow(1.0 / size, F.lit(2.0))) / size
    return per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("groups"), (F.sum("_loss") / F.sum("_w")).alias("grouped_log_loss"),
        (F.sum("_sq") / F.sum("_n")).alias("grouped_brier"), F.avg(F.col("_top").cast("double")).alias("top_accuracy"),
        F.avg(F.log(size)).alias("uniform_log_loss"), F.avg(uniform_brier).alias("uniform_brier"),
        F.avg(F.col("_prog").cast("double")).alias("progress_accuracy"))


def pairwise_models(df: DataFrame, row: list[str], model: str, p: str, values: Column) -> DataFrame:
    """Agreement of every model pair over the rows they score.

    The predictions of one row become one array per row (as long as there are models); pairs are formed inside it and
    reduced map-side to a few sums, so no self join is run. `p` is an array of cells, `values` the cell values.
    """
    from skyledger.operators.dists import normalize

    one = df.withColumn("_p", normalize(F.col(p)))
    mean = F.aggregate(F.zip_with("_p", values, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    packed = one.withColumn("_e", mean).groupBy(*row).agg(
        F.array_sort(F.collect_list(F.struct(F.col(model).alias("m"), F.col("_p").alias("p"), F.col("_e").alias("e")))).alias("_ms"))
    pairs = packed.withColumn("_x", F.explode(F.flatten(F.transform("_ms", lambda a, i: F.transform(
        F.slice("_ms", i + 2, F.size("_ms")), lambda b: F.struct(a.alias("a"), b.alias("b")))))))
    a, b = F.col("_x.a.p"), F.col("_x.b.p")
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda acc, z: acc + z)
    flat = pairs.select(
        F.col("_x.a.m").alias("model_a"), F.col("_x.b.m").alias("model_b"), F.size(a).alias("_n"),
        dot(a, b).alias("_ab"), dot(a, a).alias("_aa"), dot(b, b).alias("_bb"),
        (F.aggregate(F.zip_with(a, b, lambda u, v: F.abs(u - v)), F.lit(0.0), lambda acc, z: acc + z) * 0.5).alias("_tv"),
        F.col("_x.a.e").alias("_ea"), F.col("_x.b.e").alias("_eb"),
        F.array_max(F.zip_with(a, b, lambda u, v: F.abs(u - v) - 1e-5 * F.abs(v))).alias("_far"))
    sums = flat.groupBy("model_a", "model_b").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("_n").alias("_n"), F.sum("_ab").alias("_ab"), F.sum("_aa").alias("_aa"),
        F.sum("_bb").alias("_bb"), F.avg("_tv").alias("mean_total_variation"),
        F.corr("_ea", "_eb").alias("_ce"), F.stddev_pop("_ea").alias("_sa"), F.stddev_pop("_eb").alias("_sb"),
        F.max(F.abs(F.col("_ea") - F.col("_eb")) - 1e-5 * F.abs(F.col("_eb"))).alias("_fare"), F.max("_far").alias("_far"),
        F.avg(F.abs(F.col("_ea") - F.col("_eb"))).alias("mean_abs_mean_difference"))
    n = F.col("_n").cast("double")
    # every row is normalised, so both cell sums equal the number of rows
    s = F.col("rows").cast("double")
    va, vb = F.col("_aa") / n - F.pow(s / n, F.lit(2.0)), F.col("_bb") / n - F.pow(s / n, F.lit(2.0))
    cov = F.col("_ab") / n - F.pow(s / n, F.lit(2.0))
    flat_cells = (va <= 1e-18) | (vb <= 1e-18)
    flat_means = (F.col("_sa") <= 1e-9) | (F.col("_sb") <= 1e-9) | (F.col("rows") < 2)
    return sums.select(
        "model_a", "model_b", "rows",
        F.when(flat_cells, (F.col("_far") <= 1e-8).cast("double")).otherwise(cov / F.sqrt(va * vb)).alias("probability_correlation"),
        F.when(flat_means, (F.col("_fare") <= 1e-8).cast("double")).otherwise(F.col("_ce")).alias("mean_correlation"),
        "mean_total_variation", "mean_abs_mean_difference")


def cluster_weights(df: DataFrame, date: str, station: str) -> DataFrame:
    """1/rows of the station-date, and that divided by the station-dates of the date."""
    cells = df.groupBy(date, station).agg(F.count(F.lit(1)).alias("_rows"))
    dates = cells.groupBy(date).agg(F.count(F.lit(1)).alias("_cells"))
    sized = df.join(cells, [date, station]).join(dates, [date])
    return sized.withColumn("station_date_weight", 1.0 / F.col("_rows")).withColumn(
        "market_date_weight", F.col("station_date_weight") / F.col("_cells")).drop("_rows", "_cells")


# ---- resampling ----

def cluster_bootstrap(per_date: DataFrame, date: str, metrics: dict[str, Column], reps: int, seed: str,
                      quantiles: tuple[float, ...] = (0.025, 0.975)) -> DataFrame:
    """Date-cluster bootstrap: resample dates with replacement `reps` times and return interval ends per metric.

    Input is one row per date. Slot j of repetition r takes the date at `hash(seed, r, j) mod n`, so any rerun or
    retry draws the same sample. Each date is joined to the draws that picked it and reduced per repetition.
    """
    values = per_date.select(date, *[c.alias(n) for n, c in metrics.items()])
    indexed = _date_index(values, date)
    size = indexed.agg(F.count(F.lit(1)).alias("_size"))
    reps_df = per_date.sparkSession.range(reps).select(F.col("id").alias("rep"))
    draws = reps_df.join(F.broadcast(size), F.lit(True)).withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("_size") - 1)))
    picked = draws.select("rep", draw_index(seed, F.col("rep"), F.col("slot"), F.col("_size")).alias("_idx"))
    # the same date drawn k times in a repetition is one weighted row
    weights = picked.groupBy("rep", "_idx").agg(F.count(F.lit(1)).alias("_k"))
    means = weights.join(indexed, ["_idx"]).groupBy("rep").agg(
        *[(F.sum(F.col("_k") * F.col(n)) / F.sum("_k")).alias(n) for n in metrics])
    return means.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in metrics])).alias("_x")).groupBy(
        F.col("_x.metric").alias("metric")).agg(
        *[F.percentile("_x.value", F.lit(q)).alias(f"q{int(q * 1000):03d}") for q in quantiles])


def bootstrap_rr(daily: DataFrame, date: str, cost: str, pnl: str, reps: int, seed: str) -> DataFrame:
    """Ratio bootstrap of summed PnL over summed cost with lower-index quantiles and the share of positive draws."""
    indexed = _date_index(daily.select(date, F.col(cost).alias("_c"), F.col(pnl).alias("_p")), date)
    size = indexed.agg(F.count(F.lit(1)).alias("_size"))
    reps_df = daily.sparkSession.range(reps).select(F.col("id").alias("rep"))
    draws = reps_df.join(F.broadcast(size), F.lit(True)).withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("_size") - 1)))
    picked = draws.select("rep", draw_index(seed, F.col("rep"), F.col("slot"), F.col("_size")).alias("_idx"))
    weights = picked.groupBy("rep", "_idx").agg(F.count(F.lit(1)).alias("_k"))
    sums = weights.join(indexed, ["_idx"]).groupBy("rep").agg(
        F.sum(F.col("_k") * F.col("_p")).alias("_p"), F.sum(F.col("_k") * F.col("_c")).alias("_c"))
    draws_rr = sums.select(F.coalesce(ratio(F.col("_p"), F.col("_c")), F.lit(0.0)).alias("v"))
    sorted_draws = draws_rr.agg(F.sort_array(F.collect_list("v")).alias("s"), F.avg((F.col("v") > 0).cast("double")).alias("probability_positive"))
    def at(q: float) -> Column:
        return F.element_at("s", F.floor(F.lit(q) * (F.size("s") - 1)).cast("int") + 1)
    return sorted_draws.select(at(0.05).alias("lower_5pct"), at(0.5).alias("median"), at(0.95).alias("upper_95pct"), "probability_positive")


def draw_index(seed: str, rep: Column, slot: Column, size: Column) -> Column:
    """Seeded draw in [0, size): the first 12 hex digits of md5(seed:rep:slot) modulo the size."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), rep.cast("string"), slot.cast("string")))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % size


def _date_index(per_date: DataFrame, date: str) -> DataFrame:
    """0-based position of each date; the input has one row per date, so it is as long as the calendar."""
    from pyspark.sql import Window

    return per_date.withColumn("_idx", (F.row_number().over(Window.orderBy(date)) - 1).cast("long"))
