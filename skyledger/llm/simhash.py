"""SimHash fingerprints, an exact Hamming join by bit-sliced comparison, and the classes its links form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import FINGERPRINT_SEED, text_key
from skyledger.session import materialize

RADIUS = 3
SHINGLE = 3
BLOCK = 512  # lanes that are compared at once
TILE = 1024  # larger groups of candidates are dealt as pairs of tiles of about this many


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 hashes (seed 42) of a text's word shingles in order; fewer words than `width` are one shingle, no words none."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes fold A-Z and split at ASCII blanks only
    if not words:
        return np.zeros(0, np.uint64)
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1).tolist()
    k = max(1, len(words) - width + 1)
    stops = stops[width - 1 :] if len(words) >= width else stops[-1:]
    return np.fromiter((hashed(joined[a:b], FINGERPRINT_SEED) for a, b in zip(starts[:k], stops, strict=True)), np.uint64, k)


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """Majority bits of the hashes of a text's word shingles, as a signed long; no words: 0."""
    hashes = shingle_hashes(text, width)
    k = len(hashes)
    votes = np.zeros(64, np.int64)
    for at in range(0, k, 65_536):
        bits = np.unpackbits(hashes[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > k, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, fp) for every row; a null text has no words, so its fingerprint is zero."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t.as_py() or "", width) for t in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fps], ["doc_id", "text_key", "fp"])

    return docs.select("doc_id", text_key().cast("long").alias("text_key"), "text").mapInArrow(hashed, f"doc_id {kind}, text_key long, fp long")


# -- bit-sliced comparison --------------------------------------------------------------------------------------


def planes(fps: np.ndarray) -> np.ndarray:
    """64 bit planes of uint64 words: bit j of word w in plane b is bit b of fingerprint 64 w + j."""
    padded = np.zeros(-(-len(fps) // 64) * 64, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")).view(np.uint64)


def within(queries: np.ndarray, lanes: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Boolean matrix of query and lane pairs that differ in at most `radius` (under 4) bits.

    Each plane's differing lanes are added to two carry-save counter planes; a carry out of them, or a count over the
    radius, marks lanes as too far. A block of queries is given up once all of its lanes are.
    """
    sliced, n = planes(lanes), len(lanes)
    out = np.zeros((len(queries), n), bool)
    full = np.zeros(sliced.shape[1] * 64, bool)
    full[n:] = True
    beyond_end = np.packbits(full, bitorder="little").view(np.uint64)
    for at in range(0, len(queries), BLOCK):
        q = queries[at : at + BLOCK]
        ones = np.zeros((len(q), sliced.shape[1]), np.uint64)
        twos, far = ones.copy(), np.broadcast_to(beyond_end, ones.shape).copy()
        for b in range(64):
            flip = np.where((q >> np.uint64(b)) & np.uint64(1), ~np.uint64(0), np.uint64(0))
            differ = sliced[b][None, :] ^ flip[:, None]
            carry = ones & differ
            ones ^= differ
            far |= twos & carry
            twos ^= carry
            if radius < 3:
                far |= twos if radius == 1 else (twos & ones) if radius == 2 else (ones | twos)
            if b % 8 == 7 and (far == ~np.uint64(0)).all():
                break
        else:
            out[at : at + BLOCK] = np.unpackbits((~far).view(np.uint8), axis=1, bitorder="little")[:, :n].astype(bool)
    return out


def _spread(adjacent: np.ndarray) -> np.ndarray:
    """Smallest lane each lane reaches in a symmetric matrix of links."""
    n = len(adjacent)
    rows, cols = np.nonzero(adjacent)
    label = np.arange(n)
    while True:
        least = label.copy()
        np.minimum.at(least, rows, label[cols])
        least = np.minimum(least, least[least])
        if (least == label).all():
            return label
        label = least


def links_within(keys: np.ndarray, fps: np.ndarray, radius: int) -> np.ndarray:
    """Links that join all near fingerprints of equal key, keys sorted: one (fp, smaller fp of its local class) each.

    Groups are compared together in blocks of lanes; a find across two keys is a true link and is kept.
    """
    found = []
    edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
    at = 0
    while at < len(edges) - 1:
        end = at + 1
        while end < len(edges) - 1 and edges[end + 1] - edges[at] <= BLOCK:
            end += 1
        own = np.unique(fps[edges[at] : edges[end]])
        label = _spread(within(own, own, radius))
        moved = label != np.arange(len(own))
        found.append(np.stack([own[moved], own[label[moved]]], axis=1))
        at = end
    return np.concatenate(found) if found else np.zeros((0, 2), np.uint64)


def _prefixes(fp: Column) -> Column:
    """16 keys of 28 bits: one of four 16-bit blocks, and one of four 12-bit blocks of the other 48 bits.

    Fingerprints that differ in 3 bits or fewer agree in a whole block, and then in a whole block of the rest, so they
    share a key.
    """
    keys = []
    for i in range(4):
        block = F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))
        low = fp.bitwiseAND(F.lit((1 << (16 * i)) - 1)) if i else F.lit(0).cast("long")
        high = F.shiftleft(F.shiftrightunsigned(fp, 16 * i + 16), 16 * i) if i < 3 else F.lit(0).cast("long")
        rest = low.bitwiseOR(high)
        for j in range(4):
            part = F.shiftrightunsigned(rest, 12 * j).bitwiseAND(F.lit(0xFFF))
            keys.append(F.lit((4 * i + j) << 28).bitwiseOR(F.shiftleft(block, 12)).bitwiseOR(part))
    return F.array(*keys)


def hamming_links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b) links among distinct fingerprints `fp` that connect all that differ in at most `radius` (under 4) bits.

    Candidates share one of 16 keys. A group of more than `tile` is dealt as all pairs of its tiles, each a task's work
    of bounded size; every pair of its members meets in one of them.
    """
    if not 0 <= radius <= 3:
        raise ValueError("the keys find pairs of up to 3 differing bits")
    keyed = fps.select("fp", F.explode(_prefixes(F.col("fp"))).alias("key"))
    sizes = keyed.groupBy("key").count().filter("count > 1")
    grouped = keyed.join(sizes, "key")
    tiles = F.ceil(F.col("count") / tile).cast("int")
    own = F.pmod(F.xxhash64("fp"), tiles.cast("long")).cast("int")
    other = F.explode(F.when(F.col("count") <= tile, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), tiles - 1)))
    dealt = grouped.select("fp", "key", own.alias("own"), other.alias("other")).select("fp", "key", F.least("own", "other").alias("row"), F.greatest("own", "other").alias("col"))
    placed = dealt.withColumn("group", F.xxhash64("key", "row", "col")).select("group", "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys, held_fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def out(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
            pairs = links_within(keys, values, radius).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            keys = np.concatenate([held_keys, batch.column(0).to_numpy(zero_copy_only=False)])
            values = np.concatenate([held_fps, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if not len(keys):
                continue
            done = np.flatnonzero(keys != keys[-1])
            split = done[-1] + 1 if len(done) else 0
            if split:
                yield out(keys[:split], values[:split])
            held_keys, held_fps = keys[split:], values[split:]
        if len(held_keys):
            yield out(held_keys, held_fps)

    return placed.repartition("group").sortWithinPartitions("group").mapInArrow(compare, "a long, b long").distinct()


# -- classes ----------------------------------------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """(node, root) of the classes of links (a, b): alternating large-star and small-star steps until none changes.

    Each step is a stored table, so a lost executor costs one step. The smallest node is its class's root.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        edges = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        # each smaller neighbour, and the node itself, is tied to the smallest one
        stars = edges.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        edges = materialize(stars.filter("a <> b").distinct())
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_copies(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, fp, root, component_id): the class's smallest fingerprint and the smallest doc_id of it.

    Fingerprints link at `radius` or fewer differing bits; equal ones are one node. A row without an id counts as larger
    than all others; a class of such rows alone has a null component. Rows that repeat an id each count.
    """
    fps = materialize(fingerprints(docs, width))
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(hamming_links(nodes, radius))
    rooted = materialize(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "first"))
    classes = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = materialize(rooted.join(classes, "root").select("fp", "root", "component_id"))
    return fps.join(ids, "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
