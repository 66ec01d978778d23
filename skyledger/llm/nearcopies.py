"""Near copies of a corpus by SimHash, and by shingle sets where 64 bits cannot tell.

Texts whose SimHash fingerprints (op6: three-word shingles) differ in at most 3 bits are linked by op6's exact Hamming join.
Such fingerprints miss most pairs whose five-word shingles have a Jaccard similarity of 0.8: some 10 bits differ, often more.
Those are found besides: candidates share one of 40 keys of 5 minima each over the shingle hashes (a pair at 0.8 is missed
with a chance of 1.2e-7, a closer one with less), and every such link is checked on the whole shingle sets before it counts.
Equal sets are one node. Candidates are joined first, so a text goes to the others of its candidate class once; larger ones
are dealt as pairs of tiles. Classes are those of both kinds of links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import text_key
from skyledger.llm.simhash import RADIUS, components, fingerprint, hamming_links, shingle_hashes
from skyledger.session import materialize

SHINGLE = 5
LEAST = 0.8
BANDS, ROWS = 40, 5
TILE, TILE_SHINGLES = 1024, 1_000_000  # texts and shingles of a tile, about

_draw = np.random.default_rng(42)
XORS = _draw.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)
ODDS = _draw.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """BANDS keys, each of ROWS minima of the shingles under as many orders; no shingles, no keys."""
    if not len(shingles):
        return np.zeros(0, np.uint64)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(shingles), 512):
        part = shingles[at : at + 512, None] ^ XORS
        part *= ODDS
        np.minimum(least, part.min(axis=0), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ column) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys


def sketches(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, node, size, keys, fp) of every row: the hash and size of its shingle set, its candidate keys, and its
    SimHash fingerprint."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            nodes, sizes, keys, fps = [], [], [], []
            for t in batch.column(2):
                text = t.as_py() or ""
                own = np.unique(shingle_hashes(text, width))
                fps.append(fingerprint(text))
                nodes.append(xxhash.xxh64_intdigest(own.tobytes()))
                sizes.append(len(own))
                keys.append(band_keys(own).view(np.int64))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), listed, pa.array(fps, pa.int64())], ["doc_id", "text_key", "node", "size", "keys", "fp"])

    return docs.select("doc_id", text_key().cast("long").alias("text_key"), "text").mapInArrow(sketched, f"doc_id {kind}, text_key long, node long, size long, keys array<long>, fp long")


def links_among(sets: dict[int, np.ndarray], least: float) -> list[tuple[int, int]]:
    """Pairs of near sets that join all near ones of `sets` (sorted distinct hashes by name); no others."""
    names, m = list(sets), len(sets)
    if m < 2:
        return []
    sizes = np.array([len(s) for s in sets.values()])
    owner = np.repeat(np.arange(m), sizes)
    _, codes, times = np.unique(np.concatenate(list(sets.values())), return_inverse=True, return_counts=True)
    common = times[codes] > 1  # what one set alone has is in no intersection
    codes, owner = codes[common], owner[common]
    edges = np.searchsorted(owner, np.arange(m + 1))
    live_codes, live_owner = codes, owner
    alive, left, marked = np.ones(m, bool), m, np.zeros(len(times), bool)
    out = []
    for seed in range(m):
        if not alive[seed]:
            continue
        alive[seed] = False
        reached = [seed]
        while reached:
            i = reached.pop()
            own = codes[edges[i] : edges[i + 1]]
            marked[own] = True
            both = np.bincount(live_owner[marked[live_codes]], minlength=m)
            marked[own] = False
            near = np.flatnonzero(alive & (both >= least * (sizes + sizes[i] - both) - 1e-9))
            alive[near] = False
            out.extend((names[i], names[j]) for j in near)
            reached.extend(near.tolist())
            if alive.sum() * 2 < left:
                left = int(alive.sum())
                stays = alive[live_owner]
                live_codes, live_owner = live_codes[stays], live_owner[stays]
    return out


def checked_links(docs: DataFrame, members: DataFrame, least: float, width: int, tile: int) -> DataFrame:
    """(a, b) links of `members` (node, root, size, and the row `at` that holds its text) that are near copies."""
    sums = materialize(members.groupBy("root").agg(F.sum("size").alias("shingles"), F.count("*").alias("nodes")))
    tiles = F.greatest(F.ceil(F.col("shingles") / TILE_SHINGLES), F.ceil(F.col("nodes") / tile)).cast("int")
    spread = members.join(sums, "root").select("node", "root", "at", tiles.alias("tiles"))
    texts = docs.select("text", F.col("doc_id").alias("id"), text_key().cast("long").alias("key"))
    held = texts.join(spread.hint("merge"), texts.id.eqNullSafe(spread["at.doc_id"]) & (texts.key == spread["at.text_key"]))  # of any size, so never broadcast
    own = F.pmod(F.xxhash64("node"), F.col("tiles").cast("long")).cast("int")
    dealt = held.select("node", "root", "text", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    placed = dealt.select(F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("group"), "node", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(links: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"])

        group, sets = None, {}
        for batch in batches:
            for at, node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if at != group:
                    yield batch_of(links_among(sets, least))
                    group, sets = at, {}
                if node not in sets:  # rows alike in id and text
                    sets[node] = np.unique(shingle_hashes(text.as_py() or "", width))
        yield batch_of(links_among(sets, least))

    return placed.repartition("group").sortWithinPartitions("group").mapInArrow(compare, "a long, b long").distinct()


def simhash_links(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) links of the nodes of `rows` (node, fp) whose fingerprints differ in at most `radius` bits.

    A fingerprint is stood for by its smallest node: its other nodes are linked to that, and near fingerprints by theirs.
    """
    pairs = materialize(rows.select("node", "fp").distinct())
    heads = materialize(pairs.groupBy("fp").agg(F.min("node").alias("head")))
    same = pairs.join(heads, "fp").filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    near = hamming_links(heads.select("fp"), radius)
    near = near.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("head_a")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("head_b")), "b")
    return same.unionByName(near.select(F.col("head_a").alias("a"), F.col("head_b").alias("b")))


def near_copies(docs: DataFrame, least: float = LEAST, width: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """(doc_id, text_key, root, component_id) of every row: its class by SimHash and checked links, and the smallest doc_id of it.

    A row without an id counts as larger than all others; a class of such rows alone has a null component. Null texts and
    texts without words are alike.
    """
    rows = materialize(sketches(docs, width))
    nodes = materialize(rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "text_key")).alias("at"), F.first("size").alias("size"), F.first("keys").alias("keys")))
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    heads = materialize(keyed.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("held")).filter("held > 1"))
    candidates = keyed.join(heads, "key").filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    classes = components(candidates)
    classes = classes.unionByName(classes.select(F.col("root").alias("node"), "root").distinct())
    members = materialize(nodes.join(classes, "node").select("node", "root", "size", "at"))
    roots = components(simhash_links(rows).unionByName(checked_links(docs, members, least, width, tile)))
    rooted = materialize(nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first"))
    named = materialize(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    ids = materialize(rooted.join(named, "root").select("node", "root", "component_id"))
    return rows.join(ids, "node").select("doc_id", "text_key", "root", "component_id")
