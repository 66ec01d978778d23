"""Best-fit packing of documents into token sequences by the sum-of-squares rule."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.tokens import WORD_BPE, encoder, public_path
from skyledger.session import materialize

LENGTH = 2048
END_ID = 0
STAGE_WORDS = 120_000  # words a worker remembers where the pipeline packs: last, in executors that earlier stages have filled
ROWS_AT_ONCE = 500  # texts whose ids are in memory at once
ROWS_A_TASK = 20_000  # pieces that meet in one packing task, about; more pieces make more tasks


def token_pieces(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID, most_words: int | None = None) -> DataFrame:
    """One row (doc_id, piece, start, length, ids) per `length` tokens of a text; ids are little-endian unsigned 32-bit.

    A null or empty text is the end id alone. Rows that repeat an id each give their own pieces. Only doc_id and text are
    read, so other columns may have any name. A worker remembers `most_words` words (the encoder's own number where none is
    given); words beyond them are encoded anew for each batch, which takes time but no memory.
    """
    path = tokenizer or public_path(WORD_BPE)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path, False, most_words).encode, np.array([end_id], "<u4").tobytes()
        for batch in (whole.slice(at, ROWS_AT_ONCE) for whole in batches for at in range(0, whole.num_rows, ROWS_AT_ONCE)):
            texts = batch.column(1).to_pylist()
            kept, piece, start, count, ids = [], [], [], [], []
            for row, data in enumerate(encode([t or "" for t in texts])):
                data += end
                for k, at in enumerate(range(0, len(data), 4 * length)):
                    kept.append(row)
                    piece.append(k)
                    start.append(at // 4)
                    ids.append(data[at : at + 4 * length])
                    count.append(len(ids[-1]) // 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(kept, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(count, pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "piece", "start", "length", "ids"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids binary")


class SquaresPacker:
    """Open sequences by residual gap. An item goes where the squared counts of open sequences per gap become smallest.

    Moving an item of size s from gap g to gap g - s changes that sum by 2 (n[g - s] - n[g]) + 2, or by 1 - 2 n[s] where it
    fills the gap; among equals the smallest gap wins. A sequence is opened only where no open one has room, since the
    aim is as few sequences as possible.
    """

    def __init__(self, length: int):
        self.length = length
        self.open = np.zeros(length + 1, np.int64)
        self.at_gap: list[list[int]] = [[] for _ in range(length + 1)]
        self.made = 0

    def place(self, size: int) -> tuple[int, int]:
        """(sequence, offset) of an item of 1..length tokens."""
        counts = self.open[size:]
        gaps = np.flatnonzero(counts)
        if len(gaps):
            change = 2 * (self.open[gaps] - counts[gaps]) + 2
            if gaps[0] == 0:
                change[0] = 1 - 2 * counts[0]
            gap = int(gaps[np.argmin(change)]) + size
            sequence = self.at_gap[gap].pop()
            self.open[gap] -= 1
        else:
            gap, sequence = self.length, self.made
            self.made += 1
        left = gap - size
        if left:
            self.at_gap[left].append(sequence)
            self.open[left] += 1
        return sequence, self.length - gap


def pack(pieces: DataFrame, length: int = LENGTH, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """Adds sequence_id and offset to rows that have a `length` of 1..`length` tokens; other columns are carried along.

    Pieces are dealt evenly over tasks, each takes its own from the longest to the shortest, and ids of sequences hold the
    task's number, so nothing is gathered. `pieces` should be a stored table: it is counted first.
    """
    names = [n for n in pieces.columns if n not in ("sequence_id", "offset")]
    tasks = max(1, -(-pieces.count() // rows_a_task))
    schema = pieces.select(*names).schema.add("sequence_id", "long", False).add("offset", "long", False)
    size_at = names.index("length")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base = SquaresPacker(length), TaskContext.get().partitionId() << 40
        for batch in batches:
            put = np.array([packer.place(n) for n in batch.column(size_at).to_pylist()], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(put[:, 0] + base), pa.array(put[:, 1])], [*names, "sequence_id", "offset"])

    dealt = pieces.select(*names).repartition(tasks).sortWithinPartitions(F.desc("length"), *[c for c in ("doc_id", "piece") if c in names])
    return dealt.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """Packed pieces of whole documents with their ids: doc_id, piece, start, length, ids, sequence_id, offset."""
    return pack(materialize(token_pieces(docs, tokenizer, length)), length)


def packing_digest(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, most_words: int | None = None) -> DataFrame:
    """The same packing with a checksum of each piece's ids in place of the ids, taken before pieces are dealt."""
    pieces = token_pieces(docs, tokenizer, length, most_words=most_words).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(materialize(pieces), length)


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
