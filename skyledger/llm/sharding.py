"""Shards of bounded size by extendible hashing, with DataFrame functions only.

Every row has a 60-bit hash of its id and of its place among rows that repeat the id and text. A bucket is a prefix of hash
bits; only a bucket over the byte limit splits on one more bit, so a row's bucket is the shortest prefix of its hash whose
rows fit the limit. Bytes are summed once into cells of a fixed prefix length (some bits more than the total asks for);
all shorter prefixes are sums of cells. Cells that are still too large are summed anew at more bits, over their rows alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.common import text_key
from skyledger.session import materialize

BITS = 60
LIMIT = 256 << 20
SPARE_BITS = 4  # cells are about 2^SPARE_BITS to a full shard
STEP_BITS = 8


def hash_bits(*parts: Column) -> Column:
    """The first 60 bits of the MD5 of the parts' text, as a long that is not negative."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, BITS // 4), 16, 10).cast("long")


def prefix(hash60: Column, depth: Column | int) -> Column:
    """The first `depth` bits as a number."""
    shift = F.lit(BITS) - depth
    return F.call_function("shiftright", hash60, shift.cast("int"))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, copy, n_bytes, hash) per row. Rows alike in id and text are counted first and numbered from 0 as
    copies, so that any number of them spreads over shards."""
    rows = docs.select("doc_id", text_key().alias("text_key"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = rows.groupBy("doc_id", "text_key", "n_bytes").agg(F.count("*").alias("copies"))
    each = counted.select("doc_id", "text_key", "n_bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    # copy 0 of the only text of an id hashes by the id alone
    return each.withColumn("hash", hash_bits(name, F.when(F.col("copy") > 0, F.col("copy").cast("string"))))


def assign(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, text_key, copy, n_bytes, depth, shard, shard_bytes): `shard` is the bucket's prefix as a string of bits.

    Every shard holds at most `limit` bytes, except one whose rows agree in all 60 bits (a single larger row, as a rule),
    which stays as it is at depth 60. Null texts count 0 bytes. An empty table has no shards. Other columns are not read.
    """
    rows = materialize(sized(docs))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    depth = min(BITS, max(0, math.ceil(math.log2(max(1.0, total / limit)))) + SPARE_BITS)
    floor, open_rows, done = 0, rows, []
    while True:
        cells = open_rows.groupBy(prefix(F.col("hash"), depth).alias("cell")).agg(F.sum("n_bytes").alias("bytes"))
        levels = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(floor), F.lit(depth))).alias("depth"))
        up = F.call_function("shiftright", F.col("cell"), (F.lit(depth) - F.col("depth")).cast("int"))
        nodes = levels.withColumn("node", up)
        sums = nodes.groupBy("depth", "node").agg(F.sum("bytes").alias("shard_bytes"))
        fits = sums.filter((F.col("shard_bytes") <= limit) | (F.col("depth") == BITS))
        leaf = F.min(F.struct("depth", "node", "shard_bytes")).alias("leaf")
        directory = materialize(nodes.select("cell", "depth", "node").join(fits, ["depth", "node"]).groupBy("cell").agg(leaf).select("cell", "leaf.*"))
        placed = open_rows.withColumn("cell", prefix(F.col("hash"), depth)).join(directory, "cell", "left").drop("cell")
        if depth == BITS:
            done.append(placed)
            break
        placed = materialize(placed)
        done.append(placed.filter("depth is not null"))
        rest = placed.filter("depth is null").drop("depth", "node", "shard_bytes")
        if rest.isEmpty():
            break
        open_rows, floor, depth = rest, depth + 1, min(BITS, depth + STEP_BITS)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    bits = F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.conv(F.col("node").cast("string"), 10, 2), F.col("depth"), F.lit("0")))
    return out.select("doc_id", "text_key", "copy", "n_bytes", "depth", bits.alias("shard"), "shard_bytes")


def directory(assigned: DataFrame) -> DataFrame:
    """(shard, depth, first_slot, last_slot): the slots of the directory, indexed by as many bits as the deepest shard has."""
    shards = assigned.select("shard", "depth").distinct()
    most = shards.agg(F.max("depth").alias("most"))  # one row
    node = F.conv(F.when(F.col("depth") == 0, "0").otherwise(F.col("shard")), 2, 10).cast("long")
    width = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("most") - F.col("depth")).cast("int"))
    return shards.crossJoin(F.broadcast(most)).select("shard", "depth", (node * width).alias("first_slot"), (node * width + width - 1).alias("last_slot"))


def numbered(rows: DataFrame) -> DataFrame:
    """(at, id, key, copy) of stored rows (at, id, key): rows alike are numbered from 0, file by file, so that copies of one text are
    never in one task."""
    file = F.shiftright("at", 33)
    placed = rows.select("at", "id", "key", file.alias("file"))
    counts = placed.groupBy("id", "key", "file").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("id", "key").orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select(F.col("id").alias("b_id"), F.col("key").alias("b_key"), F.col("file").alias("b_file"), F.coalesce(ahead, F.lit(0)).alias("ahead"))
    within = F.row_number().over(Window.partitionBy("id", "key", "file").orderBy("at")) - 1
    own = placed.withColumn("within", within)
    joined = own.join(base, own.id.eqNullSafe(base.b_id) & (own.key == base.b_key) & (own.file == base.b_file))
    return joined.select("at", "id", "key", (F.col("ahead") + F.col("within")).alias("copy"))


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Rows with all their columns as Parquet below `path`, one folder per shard (the column `shard`, replaced if there).

    Rows alike in id and text take the places of their copies one by one, so a shard holds what was assigned to it.
    """
    place = assign(docs, limit).select(F.col("doc_id").alias("p_id"), F.col("text_key").alias("p_key"), F.col("copy").alias("p_copy"), "shard")
    packed = docs.select(F.struct(*[c for c in docs.columns if c != "shard"]).alias("row"), F.col("doc_id").alias("id"), text_key().alias("key"))
    stored = materialize(packed.withColumn("at", F.monotonically_increasing_id()))
    copies = numbered(stored)
    where = copies.join(place, copies.id.eqNullSafe(place.p_id) & (copies.key == place.p_key) & (copies.copy == place.p_copy)).select("at", "shard")
    stored.select("at", "row").join(where, "at").select("row.*", "shard").repartition("shard").write.partitionBy("shard").parquet(path)
