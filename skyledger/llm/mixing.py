"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: sources in the order of their names share all words by weight; a target stops at MOST_PASSES times its source, and the
excess is shared anew by weight until none is above. Each round is one aggregate over the table of sources.

Schedule: slot t is the golden-ratio point t, a number in [0, 1), and belongs to the source whose stretch of the cumulative
targets holds it, so any run of slots has every source in nearly its share. Slots are ranked per source. Stream: a source's
documents are shuffled, by a hash of their ids and anew for every pass, laid end to end and cut into blocks of equal words, up
to the target. Slot and block of the same source and rank meet. Slots beyond the last block stay empty; blocks beyond the last
slot take slots of their own, spread evenly, so every source gives its target to the word.

No step puts a source into one task: ranks of slots run inside slices of SLICE slots, running words inside 4096 buckets of hashes,
and both are carried on by sums of slices and buckets.

A null text has no words. Null sources are one source, the last. Documents without words take part in no block. Rows that repeat
an id or a whole row are documents of their own; rows that are alike in all are interchangeable. Rows without an id are shuffled
as id '' is. An empty table, or one without words, gives no spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.common import text_key
from skyledger.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
BLOCK_WORDS = 256  # a store of 100 TB would take 65,536
SEED = 42
BITS = 40  # of a point
GOLDEN = 679_535_556_991  # 2^40 / golden ratio, odd, so 2^40 points differ
SLICE = 1 << 13
BUCKET_DIGITS = 3  # hex digits of a hash
KEY_DIGITS = 16  # of a pass's order


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Stored (row, doc_id, text_key, source, size, order): one narrow row a document."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select("doc_id", text_key().alias("text_key"), "source", size.alias("size"), name.alias("order"))
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()))


def _before(df: DataFrame, value: str, over: str) -> DataFrame:
    """`over`: sum of `value` over the rows earlier by `row`, a file and position in a stored table; one row a file is ranked."""
    files = df.withColumn("_file", F.shiftright("row", 33))
    own = F.sum(value).over(Window.partitionBy("_file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    sums = files.groupBy("_file").agg(F.sum(value).alias("_sum"))
    ahead = F.sum("_sum").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))
    base = sums.select("_file", F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    return files.join(base, "_file").withColumn(over, F.col("_ahead") + F.coalesce(own, F.lit(0))).drop("_file", "_ahead")


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """Stored (sid, source, source_size, weight, target, row): sid numbers sources by code point, null last."""
    by = rows.groupBy("source").agg(F.sum("size").alias("source_size")).orderBy(F.col("source").asc_nulls_last())
    placed = materialize(by.withColumn("row", F.monotonically_increasing_id()))
    ranked = _before(placed.withColumn("_one", F.lit(1)), "_one", "sid").drop("_one")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int")).cast("long")
    sources = materialize(ranked.withColumn("weight", weight))
    cap = F.col("source_size") * most
    level, stopped = 0.0, -1
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    while total:
        above = cap < F.lit(level) * F.col("weight")
        r = sources.agg(F.coalesce(F.sum(F.when(above, cap)), F.lit(0)), F.sum(F.when(~above, F.col("weight"))), F.count(F.when(above, 1))).first()
        if r[2] == stopped:
            break
        level, stopped = (total - r[0]) / r[1], r[2]
    return materialize(sources.withColumn("target", F.least(cap.cast("double"), F.lit(level) * F.col("weight"))))


def point(t: Column) -> Column:
    """The first BITS bits of the fraction of t / golden ratio, as an integer; products are kept below 2^63."""
    half, mask = BITS // 2, (1 << BITS) - 1
    low, high = t.bitwiseAND((1 << half) - 1), F.shiftright(t, half).bitwiseAND((1 << half) - 1)
    upper = F.shiftleft((high * GOLDEN).bitwiseAND((1 << half) - 1), half)
    return (low * GOLDEN + upper).bitwiseAND(mask)


def quotas(sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Sources with words: `quota` words and `blocks` blocks to take, and their stretch [low, high) of the points."""
    kept = sources.withColumn("quota", F.floor("target")).withColumn("blocks", F.ceil(F.col("quota") / block_words))
    total = sources.agg(F.sum("target")).first()[0] or 1.0
    points = F.floor(F.col("target") / F.lit(total) * float(1 << BITS))
    ends = _before(kept.withColumn("_points", points), "_points", "low")
    return ends.withColumn("high", F.col("low") + F.col("_points")).drop("row", "_points").filter("quota > 0")


def slots(sources: DataFrame, n_slots: int, n_sources: int) -> DataFrame:
    """(sid, rank, position): slots of every source in order. A source is found through the cell of a point; cells hold
    about one source each."""
    spark = sources.sparkSession
    cell_bits = min(20, max(6, (4 * n_sources).bit_length()))
    shift = BITS - cell_bits
    cells = sources.filter("high > low").select("sid", "low", "high", F.explode(F.sequence(F.shiftright("low", shift), F.shiftright(F.col("high") - 1, shift))).alias("cell"))
    points = spark.range(n_slots).select(F.col("id").alias("t"), point(F.col("id")).alias("x")).withColumn("cell", F.shiftright("x", shift))
    own = points.join(cells, "cell").filter("x >= low AND x < high").select("sid", "t", F.expr(f"t DIV {SLICE}").alias("slice"))
    counts = own.groupBy("sid", "slice").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("sid").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("sid", "slice", F.coalesce(earlier, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("sid", "slice").orderBy("t")) - 1
    ranked = own.withColumn("within", within).join(base, ["sid", "slice"])
    return ranked.select("sid", (F.col("before") + F.col("within")).alias("rank"), F.col("t").cast("double").alias("position"))


def blocks(rows: DataFrame, sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(sid, rank, row, doc_id, text_key, source, pass, from_word, n_words, at): pieces of documents in the blocks of their source, up to
    its quota; `at` is the place in the source's stream."""
    own = rows.filter("size > 0").join(sources.select("sid", F.col("source").alias("_source"), "source_size", "quota"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    key = F.substr("order", F.col("pass") * KEY_DIGITS + 1, F.lit(KEY_DIGITS))
    last_pass = F.expr("CAST((quota - 1) DIV source_size AS INT)")
    dealt = own.withColumn("pass", F.explode(F.sequence(F.lit(0), last_pass))).withColumn("key", key).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS)).drop("order")
    sums = dealt.groupBy("sid", "pass", "bucket").agg(F.sum("size").alias("_size"))
    ahead = F.sum("_size").over(Window.partitionBy("sid", "pass").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    base = sums.select("sid", "pass", "bucket", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    inside = F.sum("size").over(Window.partitionBy("sid", "pass", "bucket").orderBy("key", "doc_id", "text_key", "row").rowsBetween(Window.unboundedPreceding, -1))
    placed = dealt.withColumn("inside", F.coalesce(inside, F.lit(0))).join(base, ["sid", "pass", "bucket"])
    laid = placed.withColumn("begin", F.col("pass") * F.col("source_size") + F.col("ahead") + F.col("inside")).filter("begin < quota").withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("quota")))
    cut = laid.withColumn("rank", F.explode(F.expr(f"sequence(begin DIV {block_words}, (end - 1) DIV {block_words})")))
    at = F.greatest(F.col("begin"), F.col("rank") * block_words)
    n = F.least(F.col("end"), (F.col("rank") + 1) * block_words) - at
    return cut.select("sid", "rank", "row", "doc_id", "text_key", "source", "pass", (at - F.col("begin")).alias("from_word"), n.alias("n_words"), at.alias("at"))


def mix(rows: DataFrame, sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(position, sid, source, rank, pass, row, doc_id, text_key, from_word, n_words, at): the mix as spans of documents, in the order of
    (position, sid, at)."""
    stretches = materialize(quotas(sources, block_words))
    totals = stretches.agg(F.coalesce(F.sum("quota"), F.lit(0)).alias("words"), F.count("*").alias("sources")).first()
    n_slots = -(-totals.words // block_words)
    golden = materialize(slots(stretches, n_slots, totals.sources))
    found = golden.groupBy("sid").agg(F.count("*").alias("n"))
    short = stretches.join(found, "sid", "left").withColumn("n", F.coalesce("n", F.lit(0))).filter("n < blocks")
    added = short.select("sid", "blocks", F.explode(F.expr("sequence(n, blocks - 1)")).alias("rank"))
    added = added.select("sid", "rank", ((F.col("rank") + 0.5) * n_slots / F.col("blocks")).alias("position"))
    return blocks(rows, stretches, block_words).join(golden.unionByName(added), ["sid", "rank"])


def texts(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """(position, source, n_words, text): the blocks of the mix as texts, words joined by blanks; at most a block's words are gathered."""
    held = docs.select(F.col("doc_id").alias("_id"), text_key().alias("_key"), F.col("text").alias("_text")).dropDuplicates(["_id", "_key"])
    piece = F.array_join(F.slice(F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)), (F.col("from_word") + 1).cast("int"), F.col("n_words").cast("int")), " ")
    cut = spans.join(held, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))).select("position", "sid", "source", "rank", "at", "n_words", piece.alias("piece"))
    by = cut.groupBy("sid", "rank", "position", "source").agg(F.sum("n_words").alias("n_words"), F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("pieces"))
    return by.select("position", "source", "n_words", F.array_join(F.transform("pieces", lambda p: p.piece), " ").alias("text"))


def digest(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document: words that the spans of the mix take of it."""
    rows = sized(docs)
    sources = targets(rows, weights, most)
    taken = mix(rows, sources, block_words).groupBy("row").agg(F.sum("n_words").alias("taken"))
    own = rows.join(sources.select(F.col("source").alias("_source"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_source")))
    return own.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
