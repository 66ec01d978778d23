"""Fill-in-middle transformation by displacement scatter.

A text is cut into tokens (blanks before a word, then the word; blanks at the end of a text are one token), two cuts part it
into prefix, middle and suffix, and these are laid out anew between sentinels. All texts of a slice are handled as one array
of bytes: the cuts of all texts set differences at the starts of their parts, a running sum turns these into the shift of every
byte, and one scatter writes the outputs. `restore` finds the sentinels in an output, builds the same kind of difference array
for the bytes of the text, and gathers them back.

Rows without an id are cut as id '' is; a null text is an empty one, and an empty text stays plain. Every row is handled on its
own, so repeated rows give repeated results, and columns other than doc_id and text play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 42
FIM_PERCENT = 50  # texts that are laid out anew
SPM_PERCENT = 80  # of these, the suffix comes first
SLICE_BYTES = 2 << 20  # bytes of texts handled at once; a longer text is a slice of its own
SENTINELS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
WIDTH = 3
FORMS = ("plain", "psm", "spm")
PLAIN, PSM, SPM = range(3)
BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LETTER = np.isin(np.arange(256), [s[1] for s in SENTINELS.values()])


def draws(doc_id: str = "doc_id", seed: int = SEED) -> Column:
    """32 bytes that decide about a row: the sha256 of the seed and the id."""
    return F.unhex(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256))


# -- arrays of bytes --------------------------------------------------------------------------------------------


def token_ends(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions after each token of all texts, number of tokens before each bound)."""
    blank = BLANK[data]
    ends = np.zeros(len(data), bool)
    ends[:-1] = ~blank[:-1] & blank[1:]
    ends[bounds[1:][np.diff(bounds) > 0] - 1] = True
    at = np.flatnonzero(ends) + 1
    return at, np.searchsorted(at, bounds, "right")


def sentinels(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions of sentinels that lie inside one text, number of them before each bound)."""
    if len(data) < WIDTH:
        return np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    at = np.flatnonzero((data[:-2] == ord("<")) & LETTER[data[1:-1]] & (data[2:] == ord(">")))
    text = np.searchsorted(bounds, at, "right")
    at = at[at + WIDTH <= bounds[np.minimum(text, len(bounds) - 1)]]
    return at, np.searchsorted(at, bounds, "left")


def shifts(total: int, begins: list[np.ndarray], moves: list[np.ndarray]) -> np.ndarray:
    """Shift of every byte: parts k begin at begins[k] (of all texts) and move by moves[k]; parts follow each other, and empty
    parts begin where the next does."""
    begin, move = np.stack(begins, 1).ravel(), np.stack(moves, 1).ravel()
    steps = np.zeros(total + 1, np.int64)
    np.add.at(steps, begin, np.diff(move, prepend=0))
    return np.cumsum(steps[:total])


def layout(form: np.ndarray, begin: np.ndarray, prefix: np.ndarray, middle: np.ndarray, suffix: np.ndarray) -> dict[str, np.ndarray]:
    """Where the parts of each text lie in its output, which begins at `begin`."""
    mark = np.where(form == PLAIN, 0, WIDTH)
    late = begin + mark
    spm, psm = form == SPM, form == PSM
    first = np.where(spm, suffix, prefix)
    second = late + first + mark
    third = second + mark + np.where(spm, prefix, suffix)
    return {
        "prefix": np.where(spm, second, late),
        "middle": np.where(form == PLAIN, late + prefix, third),
        "suffix": np.where(spm, late, np.where(psm, second, late + prefix + middle)),
    }


def rearrange(data: np.ndarray, bounds: np.ndarray, numbers: np.ndarray, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> dict[str, np.ndarray]:
    """Outputs of all texts of a slice: `data` and `bounds`, with n, form, prefix_chars and middle_chars of each text.

    `numbers` has four unsigned integers for each text: two cuts, the choice to lay out anew, and the choice of the order.
    """
    begin, stop = bounds[:-1], bounds[1:]
    ends, before = token_ends(data, bounds)
    n = np.diff(before)
    units = numbers[:, :2].astype(np.int64) % (n + 1)[:, None]
    cuts = []
    for k in (units.min(1), units.max(1)):
        reached = ends[np.clip(before[:-1] + k - 1, 0, None)] if len(ends) else begin
        cuts.append(np.where(k == 0, begin, reached))
    held = np.diff(sentinels(data, bounds)[1]) > 0
    form = np.where((stop == begin) | held | (numbers[:, 2] % 100 >= fim_percent), PLAIN, np.where(numbers[:, 3] % 100 < spm_percent, SPM, PSM))
    prefix, middle, suffix = cuts[0] - begin, cuts[1] - cuts[0], stop - cuts[1]
    out_bounds = np.concatenate([[0], np.cumsum(stop - begin + np.where(form == PLAIN, 0, 3 * WIDTH))])
    to = layout(form, out_bounds[:-1], prefix, middle, suffix)
    shift = shifts(len(data), [begin, *cuts], [to["prefix"] - begin, to["middle"] - cuts[0], to["suffix"] - cuts[1]])
    out = np.zeros(int(out_bounds[-1]), np.uint8)
    out[np.arange(len(data)) + shift] = data
    anew = form != PLAIN
    for part, mark in SENTINELS.items():
        out[(to[part][anew] - WIDTH)[:, None] + np.arange(WIDTH)] = np.frombuffer(mark, np.uint8)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # bytes that begin a code point
    return {"data": out, "bounds": out_bounds, "n": n, "form": form, "prefix_chars": chars[cuts[0]] - chars[begin], "middle_chars": chars[cuts[1]] - chars[cuts[0]]}


def restored(out: np.ndarray, bounds: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of the texts whose outputs and forms are given. No part can hold or complete a sentinel, so an output
    has three."""
    begin, stop, anew = bounds[:-1], bounds[1:], form != PLAIN
    at, before = sentinels(out, bounds)
    marks = at[before[:-1][anew][:, None] + np.arange(3)] if anew.any() else np.zeros((0, 3), np.int64)
    from_, size = {p: begin.copy() for p in SENTINELS}, {p: np.zeros(len(begin), np.int64) for p in SENTINELS}
    size["prefix"] = stop - begin  # a plain text is all prefix
    spm = form[anew] == SPM
    first, second = marks[:, 1] - marks[:, 0] - WIDTH, marks[:, 2] - marks[:, 1] - WIDTH
    for part, place, length in (
        ("prefix", np.where(spm, marks[:, 1], marks[:, 0]), np.where(spm, second, first)),
        ("suffix", np.where(spm, marks[:, 0], marks[:, 1]), np.where(spm, first, second)),
        ("middle", marks[:, 2], stop[anew] - marks[:, 2] - WIDTH),
    ):
        from_[part][anew], size[part][anew] = place + WIDTH, length
    to_bounds = np.concatenate([[0], np.cumsum(sum(size.values()))])
    order = ("prefix", "middle", "suffix")
    starts = [to_bounds[:-1], to_bounds[:-1] + size["prefix"], to_bounds[:-1] + size["prefix"] + size["middle"]]
    shift = shifts(int(to_bounds[-1]), starts, [from_[p] - s for p, s in zip(order, starts, strict=True)])
    return out[np.arange(int(to_bounds[-1])) + shift], to_bounds


# -- tables -----------------------------------------------------------------------------------------------------


def slices(texts: pa.StringArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, bounds from 0) of slices of at most SLICE_BYTES, or one text; nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held else np.zeros(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + SLICE_BYTES, "right")) - 1)
        yield a, b, data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
        a = b


def strings(data: np.ndarray, bounds: np.ndarray) -> pa.StringArray:
    return pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data))


def fill_in_middle(docs: DataFrame, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row: its tokens, the form chosen, code points of prefix and
    middle (null for a plain one), and the text laid out in that form."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, bounds in slices(batch.column(1)):
                numbers = np.frombuffer(b"".join(batch.column(2).slice(a, b - a).to_pylist()), ">u4").reshape(-1, 8)[:, :4]
                out = rearrange(data, bounds, numbers, fim_percent, spm_percent)
                plain = out["form"] == PLAIN
                forms = pa.array(np.array(FORMS, object)[out["form"]], pa.string())
                chars = [pa.array(out[c], pa.int64(), mask=plain) for c in ("prefix_chars", "middle_chars")]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(out["n"], pa.int64()), forms, *chars, strings(out["data"], out["bounds"])], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select("doc_id", "text", draws(seed=seed).alias("draws"))
    return rows.mapInArrow(lay_out, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(rows: DataFrame) -> DataFrame:
    """The columns of `rows` and `restored`: the text, rebuilt from `output` and `form` alone."""
    kept = [c for c in rows.columns if c != "restored"]
    at, form_at = kept.index("output"), kept.index("form")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, bounds in slices(batch.column(at)):
                form = np.array([FORMS.index(f) for f in batch.column(form_at).slice(a, b - a).to_pylist()])
                yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in batch.columns], strings(*restored(data, bounds, form))], [*kept, "restored"])

    return rows.select(*kept).mapInArrow(gather, rows.select(*kept).schema.add("restored", "string"))


def digest(rows: DataFrame) -> DataFrame:
    """Checksums of the outputs and of the texts rebuilt from them."""
    back = restore(rows)
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
