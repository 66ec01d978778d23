"""Language of a text by unigram pieces, with the probability of a word summed over all its segmentations.

The vocabulary is fixed and public: pieces of a sentencepiece model that are letters only. Each language has its own piece
probabilities, learned by expectation-maximisation: a forward-backward pass over every segmentation of the training words
gives expected piece counts. A text's score in a language is the sum over its words (runs of letters, in lower case) of the
log of the forward probability; words are independent, so a distinct word is scored once and remembered.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import first_ranked, held_out
from skyledger.llm.tokens import public_path

PIECES = "piece_bpe_32k.model"
DOCS_A_LANGUAGE = 400  # labelled rows the fit takes of each language, at most
SMALL_ROWS = 200_000  # ids that may be broadcast; texts move to more of them by a shuffle
SCALED = 40  # letters; the sums of longer words are kept as logarithms
ROUNDS = 3
FLOOR = 1e-7  # probability of a letter that is no piece, and of a piece a language never used
MOST_WORDS = 250_000  # words a worker remembers before it starts anew
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def letter_pieces(path: str | None = None) -> list[str]:
    """Letters-only pieces of the public vocabulary in lower case; ▁ marks a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_path(PIECES))
    names = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return sorted({p for p in names if LETTERS.fullmatch(p.lstrip("▁")) and p == p.lower() and p.count("▁") <= 1})


class Lattice:
    """All pieces in each of some words of at most `width` letters: ids by (word, end, piece length); 0 is no piece."""

    def __init__(self, pieces: list[str]):
        self.factor = np.uint64(0x9E3779B97F4A7C15)
        self.hashes = np.array([self._hash("▁" + p[1:] if p.startswith("▁") else p) for p in pieces], np.uint64)
        order = np.argsort(self.hashes)
        self.sorted, self.ids = self.hashes[order], order + 1
        self.longest = max((len(p.lstrip("▁")) for p in pieces), default=1)
        if len(np.unique(self.sorted)) < len(pieces):
            raise ValueError("two pieces hash alike")

    def _hash(self, text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(self.factor) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def find(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.ids[at], 0)

    def edges(self, words: list[str]) -> Iterator[tuple[np.ndarray, int, list[dict[int, np.ndarray]]]]:
        """(indexes, length, ids[end][start]) for words of equal length; position 0 is the start mark, which stands first."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(lengths).tolist():
            all_rows = np.flatnonzero(lengths == n)
            step = max(1, 400_000 // (n + 1))
            for part in range(0, len(all_rows), step):
                rows = all_rows[part : part + step]
                joined = "".join(["▁" + words[i] for i in rows.tolist()])
                codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(rows), n + 1).astype(np.uint64) + np.uint64(1)
                found: list[dict[int, np.ndarray]] = [{} for _ in range(n + 2)]
                for start in range(n + 1):
                    h = np.zeros(len(rows), np.uint64)
                    for end in range(start + 1, min(n + 1, start + self.longest + (start == 0)) + 1):
                        h = h * self.factor + codes[:, end - 1]
                        found[end][start] = self.find(h)
                yield rows, n, found


def forward(found: list[dict[int, np.ndarray]], n: int, table: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Log probability of words by language, and the scaled forward values with their scales at each position.

    `table` has a row per piece id and a column per language. A single letter (or the start mark) always has a way through.
    """
    size, languages = len(found[1][0]), table.shape[1]
    alpha, log_scale = [np.ones((size, languages))], [np.zeros((size, languages))]
    for end in range(1, n + 2):
        total = np.zeros((size, languages))
        base = log_scale[-1]
        for start, ids in found[end].items():
            p = table[ids]
            if end - start == 1:
                p = np.maximum(p, FLOOR)
            total += alpha[start] * p * (np.exp(log_scale[start] - base) if n > SCALED else 1.0)
        if n > SCALED:  # rescaled, as long words would run out of range
            total = np.maximum(total, 1e-300)
            alpha.append(np.ones_like(total))
            log_scale.append(base + np.log(total))
        else:
            alpha.append(total)
            log_scale.append(base)
    return np.log(np.maximum(alpha[-1], 1e-300)) + log_scale[-1], alpha, log_scale


class UnigramModel:
    """Languages, their log priors and the piece table; picklable, about 1 MB a language."""

    def __init__(self, languages: list[str], prior: np.ndarray, pieces: list[str], table: np.ndarray):
        self.languages, self.prior, self.pieces, self.table = languages, prior, pieces, table
        self.lattice = Lattice(pieces)

    def log_probability(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.languages)))
        for rows, n, found in self.lattice.edges(words):
            out[rows] = forward(found, n, self.table)[0]
        return out


def expected_counts(model: UnigramModel, words: list[str], counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece by language; `counts` has a row per word and a column per language."""
    uses = np.zeros_like(model.table)
    for rows, n, found in model.lattice.edges(words):
        if n > SCALED:
            _long_counts(model.table, found, n, counts[rows], uses)
            continue
        _, alpha, _ = forward(found, n, model.table)
        beta = [np.zeros_like(alpha[0]) for _ in range(n + 2)]
        beta[n + 1][:] = 1.0
        weight = counts[rows] / np.maximum(alpha[-1], 1e-300)
        for end in range(n + 1, 0, -1):
            for start, ids in found[end].items():
                p = model.table[ids]
                if end - start == 1:
                    p = np.maximum(p, FLOOR)
                flow = p * beta[end]
                beta[start] += flow
                share = alpha[start] * flow * weight
                for k in range(share.shape[1]):
                    uses[:, k] += np.bincount(ids, share[:, k], len(uses))
    uses[0] = 0
    return uses


def _long_counts(table: np.ndarray, found: list[dict[int, np.ndarray]], n: int, counts: np.ndarray, uses: np.ndarray) -> None:
    """Adds the expected uses of pieces in long words; forward and backward sums are logarithms."""
    whole, _, ahead = forward(found, n, table)
    behind = [np.full_like(whole, -np.inf) for _ in range(n + 2)]
    behind[n + 1][:] = 0.0
    with np.errstate(divide="ignore"):
        for end in range(n + 1, 0, -1):
            for start, ids in found[end].items():
                p = table[ids]
                flow = np.log(np.maximum(p, FLOOR) if end - start == 1 else p) + behind[end]
                behind[start] = np.logaddexp(behind[start], flow)
                share = np.exp(ahead[start] + flow - whole) * counts
                for k in range(share.shape[1]):
                    uses[:, k] += np.bincount(ids, share[:, k], len(uses))


def fit(texts: list[tuple[str, str]], totals: dict[str, int], pieces: list[str], rounds: int = ROUNDS) -> UnigramModel:
    """From (language, text) pairs and the labelled rows of each language."""
    languages = sorted(totals)
    bags = {lang: Counter() for lang in languages}
    for lang, text in texts:
        bags[lang].update(words_of(text))
    words = sorted({w for bag in bags.values() for w in bag})
    counts = np.array([[bags[lang][w] for lang in languages] for w in words], float).reshape(len(words), len(languages))
    table = np.full((len(pieces) + 1, len(languages)), 1.0 / len(pieces))
    table[0] = 0
    prior = np.log(np.array([max(totals[lang], 1) for lang in languages], float) / max(sum(totals.values()), 1)) if languages else np.zeros(0)
    model = UnigramModel(languages, prior, pieces, table)
    for _ in range(rounds if words else 0):
        uses = expected_counts(model, words, counts) + 1e-3
        uses[0] = 0
        model.table = np.maximum(uses / uses.sum(axis=0), FLOOR)
        model.table[0] = 0
    return model


def learn(docs: DataFrame, pieces: list[str] | None = None, most: int = DOCS_A_LANGUAGE) -> UnigramModel:
    """Fits on at most `most` documents a language, in the order of a hash of their ids; never on the held-out fold."""
    labelled = docs.filter(~held_out() & F.col("lang").isNotNull())
    totals = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    ranked = first_ranked(labelled.filter("text is not null").select("lang", "doc_id").distinct(), "lang", F.xxhash64("doc_id"), ["doc_id"], most)
    ids = ranked.select("lang", "doc_id")  # at most `most` a language
    if most * len(totals) <= SMALL_ROWS:
        ids = F.broadcast(ids)
    chosen = labelled.filter("text is not null").join(ids, ["lang", "doc_id"], "left_semi")
    texts = [(r.lang, r.text) for r in chosen.select("lang", "text").collect()]
    return fit(sorted(texts), totals, pieces or letter_pieces())


class Scorer:
    """Scores of texts in one worker; remembers words."""

    def __init__(self, model: UnigramModel):
        self.model, self.index, self.scores = model, {}, np.zeros((0, len(model.languages)))

    def texts(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if len(self.index) > MOST_WORDS:
            self.index, self.scores = {}, np.zeros((0, len(self.model.languages)))
        index = self.index
        ids: list[np.ndarray] = []
        for text in texts:
            ws = words_of(text)
            ids.append(np.fromiter((index.setdefault(w, len(index)) for w in ws), np.int64, len(ws)))
        new = list(index)[len(self.scores) :]
        if new:
            self.scores = np.concatenate([self.scores, self.model.log_probability(new)])
        out = []
        for row in ids:
            if not len(row) or not self.model.languages:
                out.append((UNKNOWN, 0.0))
                continue
            total = self.scores[row].sum(axis=0) + self.model.prior
            best = int(np.argmax(total))
            out.append((self.model.languages[best], float(1.0 / np.exp(total - total[best]).sum())))
        return out


def predict(docs: DataFrame, model: UnigramModel) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row. The score is the posterior of the best language; a text that is
    null or has no letter gets `und` with score 0, as does every text where no language was learned. Only doc_id and text
    are read; rows that repeat an id each get a prediction."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = scorer.texts(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(score, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
