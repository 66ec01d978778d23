"""Vector code compression: every vector as one byte for each of its parts.

Components become integers, vectors are cut into equal parts, and each part takes the index of the nearest entry of its
codebook. Distances come from dictionaries: the distinct integers of one dimension in a slice of rows are few, so their squared
differences to all entries are tabulated once, and a part's distances are rows of these tables, gathered and added by the
dictionary codes of its dimensions.

Codebooks start from the vectors of the smallest ids and move to the means of their parts in a fixed number of rounds. A round
is one pass over the stored integers: tasks return sums and counts of each entry, Spark adds them up, and as many numbers come
to the driver as the codebooks hold.

Rows whose vector is null or holds a null or non-finite component are left out. Vectors of unequal length, and those that do
not divide by the parts, are filled up with zeros. Integers stop at +-2^31; squared distances that pass a signed 64-bit number are
compared exactly and reported as the largest such number. Null ids come after all others, repeated ids in the order of their
integers, and repeated rows each have a row of the result. A table without vectors gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from skyledger.session import materialize

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
LARGEST = 1 << 31
SLICE_ROWS = 4096  # rows whose distances are in memory at once: 8 MB
SALTS = 16  # a label's sum is held so many times, so the rows of one label spread over tasks


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, ints) of the rows whose components are all finite numbers: floor(scale * x)."""
    x = F.col("embedding").cast("array<double>")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    kept = vectors.filter(F.col("embedding").isNotNull() & whole)
    limit = float(LARGEST)
    ints = F.transform(x, lambda v: F.floor(F.greatest(F.least(v * float(scale), F.lit(limit)), F.lit(-limit))).cast("long"))
    return kept.select("vec_id", "label", ints.alias("ints"))


def matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """Rows of one width; shorter ones end in zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(lists), width)
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def tables(values: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(dictionary codes of one dimension's values, squared differences of its distinct values to all entries)."""
    distinct, codes = np.unique(values, return_inverse=True)
    return codes, (distinct[:, None] - entries[None, :]) ** 2


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance to it) of each row; the lower index wins a tie."""
    reach = max(int(np.abs(m).max(initial=0)) for m in (part, book))
    if part.shape[1] * (2 * reach) ** 2 >= 1 << 63:  # exact numbers of any length
        part, book = part.astype(object), book.astype(object)
    total = np.zeros((len(part), len(book)), book.dtype)
    for d in range(part.shape[1]):
        codes, squares = tables(part[:, d], book[:, d])
        total += squares[codes]
    best = total.argmin(1)
    return best, total[np.arange(len(part)), best]


def split(width: int, parts: int) -> list[slice]:
    step = width // parts
    return [slice(p * step, (p + 1) * step) for p in range(parts)]


def sums(ints: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """(part, entry, d, total, n): sums over the parts nearest each entry, by dimension, and how many there are."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(books[0])
        total = np.zeros((k, width), np.int64)
        n = np.zeros((len(books), k), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                rows = matrix(batch.column(0).slice(at, SLICE_ROWS), width)
                for p, cut in enumerate(split(width, len(books))):
                    best, _ = nearest(rows[:, cut], books[p])
                    order = np.argsort(best, kind="stable")
                    used, first = np.unique(best[order], return_index=True)
                    n[p] += np.bincount(best, minlength=k)
                    if cut.stop > cut.start:
                        total[used, cut] += np.add.reduceat(rows[order, cut], first, axis=0)
        part, entry = np.nonzero(n)
        step = width // len(books)
        dims = np.arange(step)
        columns = [
            np.repeat(part, step), np.repeat(entry, step), np.tile(dims, len(part)),
            total[np.repeat(entry, step), np.repeat(part * step, step) + np.tile(dims, len(part))], np.repeat(n[part, entry], step),
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["part", "entry", "d", "total", "n"])

    found = ints.select("ints").mapInArrow(add, "part long, entry long, d long, total long, n long")
    return found.groupBy("part", "entry", "d").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def learn(ints: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks of the parts, one row an entry; none if there are no vectors."""
    longest = ints.agg(F.max(F.size("ints"))).first()[0]
    if longest is None:
        return []
    width = -(-longest // parts) * parts
    first = ints.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).select("ints").collect()
    seeds = np.zeros((len(first), width), np.int64)
    for row, r in zip(seeds, first, strict=True):
        row[: len(r.ints)] = r.ints
    books = [seeds[:, cut].copy() for cut in split(width, parts)]
    for _ in range(rounds):
        for r in sums(ints, books, width).collect():  # entries x width rows at most
            books[r.part][r.entry, r.d] = r.total // r.n
    return books


def encode(ints: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error): the indexes of the nearest entries in part order, two hex digits each, and the squared
    distances to them, added up."""
    id_kind, label_kind = (ints.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    schema = f"vec_id {id_kind}, label {label_kind}, code string, error long"
    if not books:
        return ints.sparkSession.createDataFrame([], schema)
    width = sum(b.shape[1] for b in books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                rows = matrix(part.column(2), width)
                codes = np.zeros((len(rows), len(books)), np.uint8)
                errors = np.zeros(len(rows), object)
                for p, cut in enumerate(split(width, len(books))):
                    best, distance = nearest(rows[:, cut], books[p])
                    codes[:, p], errors = best, errors + distance.astype(object)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([c.tobytes().hex() for c in codes]), pa.array([min(e, (1 << 63) - 1) for e in errors], pa.int64())], ["vec_id", "label", "code", "error"])

    return ints.select("vec_id", "label", "ints").mapInArrow(assign, schema)


def decode(codes: DataFrame, books: list[np.ndarray], scale: int = SCALE) -> DataFrame:
    """The columns of `codes` and `approximation`: the vector that its code stands for."""
    kept = [c for c in codes.columns if c != "approximation"]
    at = kept.index("code")

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.frombuffer(bytes.fromhex("".join(batch.column(at).to_pylist())), np.uint8).reshape(-1, len(books))
            found = np.concatenate([b[own[:, p]] for p, b in enumerate(books)], 1) / scale
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(found), pa.list_(pa.float64()))], [*kept, "approximation"])

    return codes.select(*kept).mapInArrow(look_up, codes.select(*kept).schema.add("approximation", ArrayType(DoubleType())))


def books_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def with_label_errors(coded: DataFrame) -> DataFrame:
    """`coded` and the sum of the errors of its label. Sums of labels are repeated under SALTS numbers, so a label that holds
    much of the table meets its sum in many tasks."""
    most = F.lit((1 << 63) - 1)
    by = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most.cast("decimal(38,0)")).cast("long").alias("label_error"))
    by = by.select(F.col("label").alias("_label"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    rows = coded.withColumn("_own", F.pmod(F.xxhash64("code", "vec_id"), F.lit(SALTS)).cast("int"))
    return rows.join(by, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_own") == F.col("_salt"))).drop("_label", "_own", "_salt")


def digest(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every whole vector; the integers are stored once for all passes."""
    ints = materialize(integers(vectors))
    books = learn(ints)
    coded = materialize(encode(ints, books))
    return with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))
