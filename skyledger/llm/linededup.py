"""Line dedup: later documents lose the line blocks that a patience alignment finds in earlier ones.

Every line is hashed. Partners are found through what is rare: from each line the shortest run of lines that reaches
`least_words` words, forwards and backwards. A run that several documents hold belongs to the earliest of them (its owner: the
smallest doc_id, then the content key), and each later holder is aligned with that owner. A document thus has as many partners
as its runs have owners, and no two later copies are paired: what they share, they share with an earlier owner too.

Alignment of a document with an owner is a patience diff over the runs they share: places in the document rise, and a longest
rising chain of places in the owner is kept in order; runs of one diagonal that touch grow into one block. What the chain leaves
(blocks that moved, or that the document repeats) is aligned for itself. Every block is thus a stretch of consecutive lines that
stands line by line in the owner and has `least_words` words or more, and every such stretch of any earlier document is covered
by blocks. Blocks are deleted from the later document.

Blank lines are not counted in a block; those inside one go with it.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import text_key
from skyledger.session import materialize

LEAST_WORDS = 30


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, line_no, hash, words) of lines that have words, numbered without the blank ones; rows alike in id
    and text count once."""
    rows = docs.filter("text is not null and doc_id is not null").select("doc_id", text_key().cast("long").alias("text_key"), _filled("text").alias("lines"))
    lines = rows.select("doc_id", "text_key", F.posexplode("lines").alias("line_no", "line"))
    words = F.size(F.split("line", " +"))
    return lines.select("doc_id", "text_key", "line_no", F.xxhash64("line").alias("hash"), words.alias("words"))


def _filled(text: str) -> Column:
    """The trimmed lines of a text that are not empty."""
    return F.filter(F.transform(F.split(text, "\n"), lambda line: F.trim(line)), lambda line: line != "")


def rising(positions: list[int]) -> list[int]:
    """Indexes of a longest strictly rising subsequence (patience sorting)."""
    tops: list[int] = []
    top_at: list[int] = []
    back = [-1] * len(positions)
    for i, p in enumerate(positions):
        k = bisect.bisect_left(tops, p)
        if k:
            back[i] = top_at[k - 1]
        if k == len(tops):
            tops.append(p)
            top_at.append(i)
        else:
            tops[k], top_at[k] = p, i
    out, i = [], top_at[-1] if top_at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Blocks (first line, last line, first line in the owner) from the runs that a document shares with one owner, in the same form.

    First the blocks that lie in the same order in both, then those that moved or repeat.
    """
    longest: dict[tuple[int, int], int] = {}
    for first, last, there in runs:
        longest[first, there] = max(last, longest.get((first, there), last))
    anchors = sorted((first, last, there) for (first, there), last in longest.items())
    chain = set(rising([there for _, _, there in anchors]))
    in_order = [a for k, a in enumerate(anchors) if k in chain]
    blocks = grown(in_order)
    covered = {line for first, last, _ in blocks for line in range(first, last + 1)}
    left = [a for k, a in enumerate(anchors) if k not in chain and not covered.issuperset(range(a[0], a[1] + 1))]
    return sorted(blocks + grown(left))


def grown(anchors: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Anchors of one diagonal that touch or overlap, as one block each."""
    out: list[tuple[int, int, int]] = []
    for first, last, there in sorted(anchors, key=lambda a: (a[0] - a[2], a[0])):
        if out and out[-1][0] - out[-1][2] == first - there and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]), out[-1][2])
        else:
            out.append((first, last, there))
    return out


def least_runs(line_no: list[int], words: list[int], least_words: int) -> list[tuple[int, int]]:
    """Index ranges (first, last) of consecutive lines: from each line the shortest run of `least_words` or more, forwards
    and backwards. Every line of a longer run is in one of those that lie inside it."""
    out: set[tuple[int, int]] = set()
    start = 0
    for stop in range(1, len(line_no) + 1):
        if stop < len(line_no) and line_no[stop] == line_no[stop - 1] + 1:
            continue
        sums = [0]
        for w in words[start:stop]:
            sums.append(sums[-1] + w)
        for k in range(stop - start):
            last = bisect.bisect_left(sums, sums[k] + least_words)
            if last < len(sums):
                out.add((start + k, start + last - 1))
            first = bisect.bisect_right(sums, sums[k + 1] - least_words) - 1
            if first >= 0:
                out.add((start + first, start + k))
        start = stop
    return sorted(out)


def by_group(batches: Iterator[pa.RecordBatch], done) -> Iterator[pa.RecordBatch]:
    """`done` of each slice of whole groups; rows come sorted by the column `group`."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None and rest.num_rows:
            table = pa.concat_tables([rest, table])
        groups = table.column("group").to_numpy()
        other = np.flatnonzero(groups != groups[-1]) if len(groups) else []
        split = int(other[-1]) + 1 if len(other) else 0
        if split:
            yield done(table.slice(0, split))
        rest = table.slice(split)
    if rest is not None and rest.num_rows:
        yield done(rest)


def runs_of(held: DataFrame, least_words: int) -> DataFrame:
    """Stored (doc_id, text_key, run, more, first, last): the least runs of each document, named by 128 bits of their lines' hashes.

    `held` are the lines that several documents hold.
    """
    kind = held.schema["doc_id"].dataType.simpleString()

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(table: pa.Table) -> pa.RecordBatch:
            import xxhash

            c = {n: table.column(n).to_pylist() for n in ("doc_id", "text_key", "line_no", "words")}
            hashes = table.column("hash").to_numpy()
            ids = list(zip(c["doc_id"], c["text_key"], strict=True))
            rows, names, firsts, lasts = [], [], [], []
            at = 0
            while at < len(ids):
                end = at + 1
                while end < len(ids) and ids[end] == ids[at]:
                    end += 1
                for first, last in least_runs(c["line_no"][at:end], c["words"][at:end], least_words):
                    rows.append(at)
                    names.append(xxhash.xxh3_128_digest(hashes[at + first : at + last + 1].tobytes()))
                    firsts.append(c["line_no"][at + first])
                    lasts.append(c["line_no"][at + last])
                at = end
            taken = table.select(["doc_id", "text_key"]).take(pa.array(rows, pa.int64())).combine_chunks()
            columns = [pa.array(taken.column(n).to_pylist(), table.schema.field(n).type) for n in ("doc_id", "text_key")]
            halves = np.frombuffer(b"".join(names), "<i8").reshape(-1, 2)
            return pa.RecordBatch.from_arrays([*columns, pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(firsts, pa.int32()), pa.array(lasts, pa.int32())], ["doc_id", "text_key", "run", "more", "first", "last"])

        return by_group(batches, found)

    placed = held.select(F.xxhash64("doc_id", "text_key").alias("group"), "doc_id", "text_key", "line_no", "hash", "words")
    return materialize(placed.repartition("group").sortWithinPartitions("group", "doc_id", "text_key", "line_no").mapInArrow(runs, f"doc_id {kind}, text_key long, run long, more long, first int, last int"))


BLOCK = "struct<first:int,last:int,owner:{kind},owner_key:long,there:int>"


def aligned_blocks(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, text_key, blocks, cut): for each document that shares blocks with earlier ones, the blocks (first and last line,
    owner, first line there) and the lines in them, numbered without the blank ones.

    Rows without id or text lose nothing and own nothing. Rows alike in id and text are one document and stay as they are.
    """
    lines = materialize(lines_of(docs).distinct())
    # a line counts once for a document, since it may repeat in one
    several = lines.select("hash", "doc_id", "text_key").distinct().groupBy("hash").agg(F.count("*").alias("holders")).filter("holders > 1").select("hash")
    runs = runs_of(lines.join(several, "hash", "left_semi"), least_words)
    holds = runs.groupBy("run", "more").agg(F.min(F.struct("doc_id", "text_key", "first")).alias("o"), F.count("*").alias("times")).filter("times > 1")
    owners = materialize(holds.select("run", "more", F.col("o.doc_id").alias("owner"), F.col("o.text_key").alias("owner_key"), F.col("o.first").alias("there")))
    shared = runs.join(owners, ["run", "more"]).filter("doc_id <> owner or text_key <> owner_key")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def aligned(table: pa.Table) -> pa.RecordBatch:
            c = {n: table.column(n).to_pylist() for n in table.column_names}
            pairs: dict[tuple, dict[tuple, list[tuple[int, int, int]]]] = defaultdict(lambda: defaultdict(list))
            for doc, key, owner, owner_key, *run in zip(*(c[n] for n in ("doc_id", "text_key", "owner", "owner_key", "first", "last", "there")), strict=True):
                pairs[doc, key][owner, owner_key].append(tuple(run))
            found, cuts = [], []
            for partners in pairs.values():
                own = sorted((first, last, *owner, there) for owner, shared_runs in partners.items() for first, last, there in align(shared_runs))
                found.append([dict(zip(("first", "last", "owner", "owner_key", "there"), b, strict=True)) for b in own])
                cuts.append(sorted({line for b in own for line in range(b[0], b[1] + 1)}))
            id_type = table.schema.field("doc_id").type
            block = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("owner", id_type), ("owner_key", pa.int64()), ("there", pa.int32())])
            columns = [pa.array([d for d, _ in pairs], id_type), pa.array([k for _, k in pairs], pa.int64()), pa.array(found, pa.list_(block)), pa.array(cuts, pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "blocks", "cut"])

        return by_group(batches, aligned)

    placed = shared.select(F.xxhash64("doc_id", "text_key").alias("group"), "doc_id", "text_key", "first", "last", "owner", "owner_key", "there")
    return placed.repartition("group").sortWithinPartitions("group", "doc_id", "text_key").mapInArrow(by_document, f"doc_id {kind}, text_key long, blocks array<{BLOCK.format(kind=kind)}>, cut array<int>")


def repeated_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, text_key, cut): line numbers (blank lines not counted) that go from each later document; only documents that
    lose lines."""
    return aligned_blocks(docs, least_words).select("doc_id", "text_key", "cut")


def without_repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """All rows and columns of `docs`; texts of later documents without their repeated blocks (n_chars follows, if there).

    A document whose lines are all repeated keeps its row with an empty text. Blank lines between two lines that go, go too.
    """
    cuts = materialize(repeated_lines(docs, least_words))
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), text_key().cast("long").alias("key"), "text")
    # texts move once, at every size: the list of cuts has no bound that would let it be broadcast
    joined = packed.join(cuts.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "cut").hint("merge"), ["id", "key"], "left")
    # a column of its own, as each kept line is taken from it by number
    parted = joined.withColumn("lines", F.when(F.col("cut").isNotNull(), F.split("text", "\n")))
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    parted = parted.withColumn("filled", F.filter(every, lambda i: F.trim(F.get("lines", i)) != ""))
    parted = parted.withColumn("gone", F.flatten(F.transform("cut", lambda n, k: F.when(F.get("cut", k + 1) == n + 1, F.sequence(F.get("filled", n), F.get("filled", n + 1) - 1)).otherwise(F.array(F.get("filled", n))))))
    left = F.transform(F.array_except(every, "gone"), lambda i: F.get("lines", i))
    text = F.when(F.col("cut").isNull(), F.col("text")).when(F.size("cut") == F.size("filled"), "").otherwise(F.array_join(left, "\n"))
    changed = parted.select("row", text.alias("text"), "cut")
    columns = []
    for f in docs.schema:
        if f.name == "text":
            columns.append(F.col("text"))
        elif f.name == "n_chars":
            columns.append(F.when(F.col("cut").isNull(), F.col("row.n_chars")).otherwise(F.length("text").cast(f.dataType)).alias("n_chars"))
        else:
            columns.append(F.col("row").getField(f.name).alias(f.name))
    return changed.select(*columns)
