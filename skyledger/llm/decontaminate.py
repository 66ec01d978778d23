"""Benchmark passages in documents: a prefix-filtered join on rare shingles, verified word by word.

DataFrame functions only. Each item gives windows of `window` consecutive words. Containment of a whole window is asked
for, so one shingle of it is a sufficient prefix: the one that the fewest document positions hold. A document position that
holds this shingle fixes where the window must start (positional bound) and end (length bound); the words there are then
compared one by one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import lower_ascii, text_key
from skyledger.session import materialize

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
SHINGLE = 5
BLOCK_ROWS = 100_000  # prefix rows that are broadcast at a time; a larger benchmark goes over the documents in blocks


def word_array(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(lower_ascii(text), F.lit(WORD), 0), F.array().cast("array<string>"))


def shingle_hashes(words: Column, width: int) -> Column:
    """Hash of each run of `width` words by position, apart for each width; fewer words give an empty array."""
    last = F.size(words) - width
    runs = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(F.lit(width), *[F.get(words, i + k) for k in range(width)]))
    return F.when(last >= 0, runs).otherwise(F.array().cast("array<long>"))


def windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(words, item_ids) of each distinct run of `window` item words; a shorter item that has words is one window."""
    words = items.select("item_id", word_array(F.col("text")).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    cut = words.select("item_id", "words", F.explode(starts).alias("at")).select("item_id", F.slice("words", F.col("at"), window).alias("words"))
    return cut.groupBy("words").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))


def _shingled(win: DataFrame, shingle: int) -> DataFrame:
    """(words, item_ids, width, offset, hash) per shingle of a window; a window under `shingle` words is one shingle."""
    width = F.least(F.size("words"), F.lit(shingle))
    by_width = F.lit(None).cast("array<long>")
    for k in range(1, shingle + 1):
        by_width = F.when(width == k, shingle_hashes(F.col("words"), k)).otherwise(by_width)
    return win.select("words", "item_ids", width.alias("width"), F.posexplode(by_width).alias("offset", "hash"))


def _document_shingles(docs: DataFrame, widths: list[int]) -> DataFrame:
    """(doc_id, text_key, words, pos, hash): `pos` 0 stands for the document, then come all runs of each width in turn."""
    words = docs.select("doc_id", text_key().alias("text_key"), word_array(F.col("text")).alias("words"))
    hashes = F.concat(F.array(F.lit(0).cast("long")), *[shingle_hashes(F.col("words"), k) for k in widths])
    # the array is a column of its own: the generator then reads it inside generated code and copies no row that finds nothing;
    # it is never empty, and the outer form keeps Spark from adding a filter that would build it twice
    return words.withColumn("hashes", hashes).select("doc_id", "text_key", "words", F.posexplode_outer("hashes").alias("pos", "hash"))


def benchmark_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Per document (doc_id, text_key): n_words, spans [start, stop) of words inside window occurrences, item_ids.

    Null or empty texts have no words and no hits. Rows that repeat an id with the same text are one row here, with other
    text rows of their own. Other columns of either table are not read. An empty benchmark leaves all documents clean.
    """
    shingled = materialize(_shingled(windows(items, window), shingle))
    keys = materialize(shingled.select("width", "hash").distinct())
    widths = sorted(r.width for r in keys.select("width").distinct().collect())  # at most `shingle` numbers
    blocks = max(1, -(-keys.count() // BLOCK_ROWS))

    def block(df: DataFrame, b: int) -> DataFrame:
        return F.broadcast(df.filter(F.pmod("hash", F.lit(blocks)) == b))

    # how often all documents hold each shingle of the benchmark
    counted = [
        _document_shingles(docs, widths).select("pos", "hash").filter("pos > 0").join(block(keys, b), "hash").groupBy("hash").agg(F.count("*").alias("n"))
        for b in range(blocks)
    ]
    counts = materialize(reduce(DataFrame.unionByName, counted))
    # the prefix of a window: its rarest shingle, and the first of equals
    rarest = shingled.join(counts, "hash").groupBy("words").agg(F.min(F.struct("n", "offset", "width", "hash", "item_ids")).alias("p"))
    prefix = materialize(rarest.select("p.hash", "p.width", "p.offset", "p.item_ids", F.col("words").alias("item_words")))
    of_document = docs.sparkSession.range(1).select(*[F.lit(0 if f.name == "hash" else None).cast(f.dataType).alias(f.name) for f in prefix.schema])

    found = []
    for b in range(blocks):
        near = _document_shingles(docs, widths).join(F.broadcast(block(prefix, b).unionByName(of_document)), "hash")
        n, whole = F.size("words"), F.col("pos") == 0
        earlier = sum((F.when(F.col("width") > k, F.greatest(n - k + 1, F.lit(0))).otherwise(0) for k in widths), F.lit(0))
        start = F.col("pos") - 1 - earlier - F.col("offset")
        stop = start + F.size("item_words")
        inside = (start >= 0) & (stop <= n)
        same = F.slice("words", F.greatest(start + 1, F.lit(1)), F.greatest(F.size("item_words"), F.lit(0))) == F.col("item_words")
        hit = near.filter(whole | (inside & same))
        found.append(hit.select("doc_id", "text_key", n.alias("n_words"), F.when(~whole, F.struct(start.alias("start"), stop.alias("stop"))).alias("at"), F.when(~whole, F.col("item_ids")).alias("item_ids")))
    return (
        reduce(DataFrame.unionByName, found).groupBy("doc_id", "text_key")
        .agg(F.max("n_words").alias("n_words"), F.sort_array(F.collect_set("at")).alias("at"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"))
        .select("doc_id", "text_key", "n_words", _merged(F.col("at")).alias("spans"), "item_ids")
    )


def _merged(occurrences: Column) -> Column:
    """Sorted spans (start, stop) united where they touch or overlap."""
    spans, none = "array<struct<start:int,stop:int>>", F.lit(None).cast("int")
    zero = F.struct(F.array().cast(spans).alias("done"), none.alias("start"), none.alias("stop"))

    def closed(s: Column) -> Column:
        return F.when(s.start.isNull(), s.done).otherwise(F.concat(s.done, F.array(F.struct(s.start.alias("start"), s.stop.alias("stop")))))

    def add(s: Column, x: Column) -> Column:
        wider = F.struct(s.done.alias("done"), s.start.alias("start"), F.greatest(s.stop, x.stop).alias("stop"))
        return F.when(s.stop >= x.start, wider).otherwise(F.struct(closed(s).alias("done"), x.start.alias("start"), x.stop.alias("stop")))

    return F.aggregate(occurrences, zero, add, closed)


def digest(hits: DataFrame) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s.stop - s.start))
    return hits.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
