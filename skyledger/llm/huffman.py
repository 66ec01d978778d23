"""Token ids of documents in Huffman-coded files.

Ids are coded by a canonical prefix code of at most `LONGEST_CODE` bits, built from the counts of ids over all documents.
A file row is one document (a block): its bits start on a byte, and the bit offset of every `STRIDE`-th id is kept, so a
block is decoded alone, and all its strides side by side, by look-ups in one table of 2^LONGEST_CODE entries. Rows lie in
files by ascending doc_id. The code lengths define the code and are stored beside the rows, so files are read by their path alone.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from skyledger.llm.tokens import BYTE_BPE, encoder, public_path
from skyledger.session import materialize, new_table

LONGEST_CODE = 16
STRIDE = 64  # ids between checkpoints
SLICE_IDS = 1 << 20  # ids coded at once; a longer document is a slice of its own
FILE_IDS = 1 << 22  # ids of a file, about: rows of one doc_id are not parted
WIDEST = 1 << 16  # ids are held in 16 bits
END_ID = 2


# -- the code ---------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, longest: int = LONGEST_CODE) -> np.ndarray:
    """Bits of each id (0 where it never occurs): an optimal prefix code of at most `longest` bits by package-merge."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} ids do not fit codes of {longest} bits")
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    n = len(order)
    # each level merges the leaves with pairs of the level below; how many leaves a level takes tells the lengths
    plain = _huffman_depths(weights)
    if plain.max() <= longest:
        lengths[order] = plain
        return lengths
    levels, packages = [], np.zeros(0)
    for _ in range(longest):
        values = np.concatenate([weights, packages])
        rank = np.argsort(values, kind="stable")
        levels.append(rank < n)
        merged = values[rank]
        packages = merged[0 : len(merged) // 2 * 2 : 2] + merged[1 : len(merged) // 2 * 2 : 2]
    take, bits = 2 * n - 2, np.zeros(n, np.int64)
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        bits[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[order] = bits
    return lengths


def _huffman_depths(weights: np.ndarray) -> np.ndarray:
    heap = [(float(w), i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    parent, nodes = [-1] * (2 * len(weights) - 1), len(weights)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        parent[a[1]] = parent[b[1]] = nodes
        heapq.heappush(heap, (a[0] + b[0], nodes))
        nodes += 1
    depth = [0] * nodes
    for i in range(nodes - 2, -1, -1):
        depth[i] = depth[parent[i]] + 1
    return np.array(depth[: len(weights)])


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id: each is the one before plus one, widened by zero bits."""
    codes = np.zeros(len(lengths), np.uint32)
    code, last = 0, 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)).tolist():
        if lengths[i]:
            code <<= int(lengths[i]) - last
            last = int(lengths[i])
            codes[i] = code
            code += 1
    return codes


def decoding_table(lengths: np.ndarray, longest: int = LONGEST_CODE) -> np.ndarray:
    """For every `longest` next bits: the id times 32, plus its code's length."""
    codes, out = canonical_codes(lengths), np.zeros(1 << longest, np.uint32)
    for i in np.flatnonzero(lengths).tolist():
        free = longest - int(lengths[i])
        out[int(codes[i]) << free : (int(codes[i]) + 1) << free] = (i << 5) | int(lengths[i])
    return out


def encode_blocks(blocks: list[np.ndarray], codes: np.ndarray, lengths: np.ndarray) -> list[tuple[bytes, np.ndarray]]:
    """(bytes, bit offset of every STRIDE-th id) of each block of ids; blocks begin on bytes and end in zero bits."""
    sizes = np.array([len(b) for b in blocks])
    ids = np.concatenate(blocks) if blocks else np.zeros(0, np.int64)
    bits = lengths[ids].astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(bits)])
    own_bits = np.diff(ends[np.concatenate([[0], np.cumsum(sizes)])])
    byte_at = np.concatenate([[0], np.cumsum(own_bits + 7 >> 3)])
    begin_bits = np.cumsum(own_bits) - own_bits  # of blocks, if they were laid without gaps
    starts = ends[:-1] + np.repeat(byte_at[:-1] * 8 - begin_bits, sizes)
    out = np.zeros(int(byte_at[-1] * 8 + 31 >> 5) + 2, np.uint32)
    if len(ids):
        word = starts >> 5
        # each code lies in a pair of 32-bit words; codes that start in one word are added up without overlap
        shifted = codes[ids].astype(np.uint64) << (64 - (starts & 31) - bits).astype(np.uint64)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        pairs = np.add.reduceat(shifted, first)
        at = word[first]
        out[at] += (pairs >> np.uint64(32)).astype(np.uint32)
        out[at + 1] += (pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    data = out.astype(">u4").tobytes()
    id_at = np.concatenate([[0], np.cumsum(sizes)])
    return [(data[byte_at[k] : byte_at[k + 1]], starts[id_at[k] : id_at[k + 1] : STRIDE] - 8 * byte_at[k]) for k in range(len(blocks))]


def decode_blocks(payloads: list[bytes], checkpoints: list[np.ndarray], counts: list[int], table: np.ndarray, longest: int = LONGEST_CODE) -> list[np.ndarray]:
    """Ids of blocks: all strides of all blocks advance together, one id a step."""
    data = np.frombuffer(b"".join(payloads) + bytes(8), np.uint8)
    begin = np.cumsum([0] + [len(p) for p in payloads[:-1]]) * 8
    lanes = np.concatenate([c.astype(np.int64) + b for c, b in zip(checkpoints, begin.tolist(), strict=True)])
    sizes = np.concatenate([np.minimum(STRIDE, n - STRIDE * np.arange(len(c))) for c, n in zip(checkpoints, counts, strict=True)])
    ends = np.cumsum(sizes)
    to = ends - sizes
    out = np.zeros(int(ends[-1]), np.uint32)
    order = np.argsort(-sizes, kind="stable")  # lanes that end early fall off the end
    lanes, to, sizes = lanes[order], to[order], sizes[order]
    falling = -sizes
    for step in range(int(sizes[0])):
        live = int(np.searchsorted(falling, -step, "left"))
        p = lanes[:live]
        byte = p >> 3
        window = (data[byte].astype(np.uint32) << 16) | (data[byte + 1].astype(np.uint32) << 8) | data[byte + 2]
        entry = table[(window >> (24 - longest - (p & 7)).astype(np.uint32)) & np.uint32((1 << longest) - 1)]
        out[to[:live] + step] = entry >> 5
        lanes[:live] += (entry & 31).astype(np.int64)
    return np.split(out, np.cumsum(counts)[:-1])


# -- files ------------------------------------------------------------------------------------------------------


def token_table(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(doc_id, n_tokens, ids) with ids as little-endian unsigned 16-bit numbers; a null text is the end id alone."""
    path, kind = tokenizer or public_path(BYTE_BPE), docs.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = encoder(path, blank_joins=True), np.array([end_id], "<u4").tobytes()
        if max(end_id, *words.tokenizer.get_vocab().values()) >= WIDEST:
            raise ValueError(f"ids of {path} do not fit 16 bits")
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = [np.frombuffer(data + end, "<u4") for data in words.encode([t or "" for t in part.column(1).to_pylist()])]
                ids = pa.array([r.astype("<u2").tobytes() for r in rows], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(r) for r in rows], pa.int64()), ids], ["doc_id", "n_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, n_tokens long, ids binary")


def id_counts(ids: DataFrame) -> np.ndarray:
    """Count of each id over all rows; every task adds up its own, so as many rows as ids come to the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                data = b"".join(batch.column(0).slice(at, 1000).to_pylist())
                total += np.bincount(np.frombuffer(data, "<u2"), minlength=1 << 16)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["id", "n"])

    out = np.zeros(1 << 16, np.int64)
    for r in ids.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # 65,536 rows at most
        out[r.id] = r.n
    return out


def write_files(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int = END_ID, longest: int = LONGEST_CODE) -> str:
    """Writes `blocks` (row, doc_id, n_ids, payload, checkpoints) and `code` (id, bits) below a folder, and returns the folder; the
    default is one in the shared checkpoint folder. Blocks lie by ascending doc_id; `row` numbers them in this order, with gaps
    between files.

    Texts are encoded once into a stored table; global counts and the bounds of files come from that; blocks are coded once, before
    they are sorted, so only coded bits move. Rows that repeat an id follow each other in the order of their bits.
    """
    path = path or new_table(docs.sparkSession)
    ids = materialize(token_table(docs, tokenizer, end_id), compression="snappy")
    counts = id_counts(ids)
    lengths = code_lengths(counts, longest)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = canonical_codes(lengths)
        for batch in batches:
            sizes = np.cumsum(batch.column(2).to_numpy())
            at = 0
            while at < batch.num_rows:
                before = int(sizes[at - 1]) if at else 0
                end = max(at + 1, int(np.searchsorted(sizes, before + SLICE_IDS, "right")))
                part = batch.slice(at, end - at)
                coded = encode_blocks([np.frombuffer(data, "<u2") for data in part.column(1).to_pylist()], codes, lengths)
                marks = [m.astype("<u4").tobytes() for _, m in coded]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([b for b, _ in coded], pa.binary()), pa.array(marks, pa.binary())], ["doc_id", "n_ids", "payload", "checkpoints"])
                at = end

    coded = ids.select("doc_id", "ids", "n_tokens").mapInArrow(code, f"doc_id {kind}, n_ids long, payload binary, checkpoints binary").withColumn("digest", F.xxhash64("payload"))
    files = max(1, -(-int(counts.sum()) // FILE_IDS))
    numeric = isinstance(docs.schema["doc_id"].dataType, NumericType)
    bounds = file_bounds(ids, files) if numeric else []
    file = sum((F.coalesce(F.col("doc_id") > b, F.lit(False)).cast("int") for b in bounds), F.lit(0))
    if len(bounds) > 100:  # a look-up of the bound below in place of as many comparisons
        file = F.coalesce(F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: F.col("doc_id") > b)), F.lit(0))
    dealt = coded.repartitionById(len(bounds) + 1, file) if numeric else coded.repartitionByRange(files, "doc_id")
    ranged = dealt.sortWithinPartitions("doc_id", "digest").drop("digest")
    ranged.withColumn("row", F.monotonically_increasing_id()).write.parquet(f"{path}/blocks", compression="uncompressed")
    used = np.flatnonzero(lengths)
    code_rows = docs.sparkSession.createDataFrame([(int(i), int(lengths[i])) for i in used], "id int, bits int")
    code_rows.coalesce(1).write.parquet(f"{path}/code")
    return path


def file_bounds(ids: DataFrame, files: int) -> list:
    """Ascending ids of documents that part the table into about so many files; null ids come first."""
    if files == 1:
        return []
    shares = [k / files for k in range(1, files)]
    cut = ids.agg(F.percentile_approx("doc_id", shares, F.lit(100 * files)).alias("at")).first().at
    return sorted(set(cut or []))


def open_files(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray]:
    """(blocks, code lengths) of a folder that `write_files` wrote."""
    lengths = np.zeros(WIDEST, np.uint8)
    for r in spark.read.parquet(f"{path}/code").collect():  # as many rows as ids are in use
        lengths[r.id] = r.bits
    return spark.read.parquet(f"{path}/blocks"), lengths


def read_files(stored: DataFrame, lengths: np.ndarray, longest: int = LONGEST_CODE) -> DataFrame:
    """(row, doc_id, n_ids, ids) decoded from stored rows; ids little-endian unsigned 32-bit."""
    kind = stored.schema["doc_id"].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoding_table(lengths, longest)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                marks = [np.frombuffer(m, "<u4") for m in part.column(4).to_pylist()]
                ids = decode_blocks(part.column(3).to_pylist(), marks, part.column(2).to_pylist(), table, longest)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary())], ["row", "doc_id", "n_ids", "ids"])

    return stored.select("row", "doc_id", "n_ids", "payload", "checkpoints").mapInArrow(decode, f"row long, doc_id {kind}, n_ids long, ids binary")


def with_starts(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """`rows` and `start`: ids before each row. Sums run inside a file, and over the files, of which there is a row each."""
    part = F.shiftright("row", 33)  # the high bits of a row's number are its file's
    earlier = F.sum("n_ids").over(Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files = stored.groupBy(part.alias("part")).agg(F.sum("n_ids").alias("n_ids")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.withColumn("part", part).withColumn("earlier", F.coalesce(earlier, F.lit(0))).join(files, "part").withColumn("start", F.col("before") + F.col("earlier")).drop("part", "earlier", "before")


def digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each stored document, from its decoded ids."""
    stored, lengths = open_files(spark, path)
    decoded = read_files(stored, lengths).select("row", "doc_id", "n_ids", F.crc32("ids").alias("ids_crc32"))
    return with_starts(decoded, stored).select("doc_id", "start", F.col("n_ids").alias("n_tokens"), "ids_crc32")
