"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels name toxic documents, not tokens, so tokens are labelled first: a word or word beginning that training documents
hold far more often when toxic than chance allows marks its tokens. On those labelled tokens a two-tag chain is fitted
(tags: ordinary, toxic; features: the word and its beginnings; transitions within a sentence). Forward-backward marginals
of every token of a whole text are summed up to a few features, which a logistic fit on other training documents turns
into a score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.llm.common import first_ranked, held_out

MOST_TOXIC, MOST_CLEAN = 1200, 3000  # labelled documents the fit takes, at most, in the order of a hash of their ids
BEGINNINGS = (3, 4, 5, 6)
LEAST_DOCUMENTS = 4
STEPS = 40
MOST_WORDS = 250_000  # words a worker remembers before it starts anew
TOKEN = re.compile(r"[^\W_]+|[.!?\n]")
STOPS = ".!?\n"
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))


def units(word: str) -> list[str]:
    """The word itself and its proper beginnings, which carry a bar."""
    return [word, *(word[:k] + "|" for k in BEGINNINGS if len(word) > k)]


def folded(text: str) -> str:
    """Lower case, of equal length so that offsets hold."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def tokens(text: str) -> list[str]:
    return TOKEN.findall(folded(text))


def chain(emission: np.ndarray, stop: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Odds of the toxic tag before (`forward`, own emission included) and after each token.

    `emission` holds exp of the toxic minus the ordinary score, `trans[a, b]` the factor from tag a to b. Sentences are
    laid side by side by length, and all of one length take each step at once.
    """
    n = len(emission)
    fwd, bwd = np.ones(n), np.ones(n)
    edges = np.concatenate([[-1], np.flatnonzero(stop), [n]])
    starts, lengths = edges[:-1] + 1, np.diff(edges) - 1
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    i = 0
    while i < len(order):
        size = lengths[order[i]]
        j = int(np.searchsorted(lengths[order], size, "right"))
        at = starts[order[i:j]]
        r = emission[at]
        fwd[at] = r
        for k in range(1, size):
            r = emission[at + k] * (trans[0, 1] + r * trans[1, 1]) / (trans[0, 0] + r * trans[1, 0])
            fwd[at + k] = r
        b = np.ones(len(at))
        for k in range(size - 1, 0, -1):
            e = emission[at + k] * b
            b = (trans[1, 0] + e * trans[1, 1]) / (trans[0, 0] + e * trans[0, 1])
            bwd[at + k - 1] = b
        i = j
    return fwd, bwd


def marginals(emission: np.ndarray, stop: np.ndarray, trans: np.ndarray) -> np.ndarray:
    fwd, bwd = chain(emission, stop, trans)
    odds = fwd * bwd
    p = odds / (1.0 + odds)
    p[stop] = 0.0
    return p


class ToxicModel:
    """Feature weights, transitions and the document-level fit; a plain picklable object of a few MB at most."""

    def __init__(self, weights: dict[str, float], bias: float, trans: np.ndarray, document: np.ndarray):
        self.weights, self.bias, self.trans, self.document = weights, bias, trans, document

    def emission(self, word: str) -> float:
        w = self.weights
        return math.exp(min(30.0, self.bias + sum(w.get(u, 0.0) for u in units(word))))


def _near_key(words: list[str]) -> int:
    """Smallest hash of word triples: near copies mostly share it, so one of them trains."""
    return min((zlib.crc32(" ".join(t).encode("utf-8", "surrogatepass")) for t in zip(words, words[1:], words[2:])), default=zlib.crc32(" ".join(words).encode("utf-8", "surrogatepass")))


def telling_units(docs: list[tuple[int, list[str]]]) -> set[str]:
    """Units whose toxic documents are so many that chance (binomial at the base rate) would give none like it."""
    toxic, clean = Counter(), Counter()
    for label, words in docs:
        (toxic if label else clean).update({u for w in set(words) for u in units(w)})
    n_toxic = sum(label for label, _ in docs)
    rate = n_toxic / max(1, len(docs))
    found = set()
    if not 0 < rate < 1:
        return found
    limit = math.log(1e-3 / max(1, len(toxic)))
    for u, k in toxic.items():
        n = k + clean[u]
        if k >= LEAST_DOCUMENTS and k / n > max(0.8, rate):
            share = k / n  # Chernoff bound of at least k in n
            bound = -n * (share * math.log(share / rate) + ((1 - share) * math.log((1 - share) / (1 - rate)) if share < 1 else 0.0))
            if bound < limit:
                found.add(u)
    return found


def fit_chain(docs: list[tuple[int, list[str]]], marked: set[str], steps: int = STEPS) -> tuple[dict[str, float], float, np.ndarray]:
    """Weights, bias and transition factors of the chain, by gradient steps on the likelihood of the labelled tokens."""
    index: dict[str, int] = {}
    size = sum(len(words) + 1 for _, words in docs)
    at = np.fromiter((index.setdefault(w, len(index)) for _, words in docs for w in (*words, "\n")), np.int32, size)
    names = list(index)
    stop_id = np.array([w in STOPS for w in names])
    word_tag = np.array([not s and any(u in marked for u in units(w)) for w, s in zip(names, stop_id, strict=True)])
    of_toxic = np.repeat([label == 1 for label, _ in docs], [len(words) + 1 for _, words in docs])
    stop = stop_id[at]
    tags = word_tag[at] & of_toxic
    seen = Counter(u for w, s in zip(names, stop_id, strict=True) if not s for u in units(w))
    # a feature is a marked unit, or one of several words; each word then has a short list of features
    features = {u: k for k, u in enumerate(sorted(u for u, c in seen.items() if u in marked or c >= 3))}
    pairs = [(i, features[u]) for i, (w, s) in enumerate(zip(names, stop_id, strict=True)) if not s for u in units(w) if u in features]
    rows, cols = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
    weights, bias, trans = np.zeros(len(features)), -4.0, np.zeros((2, 2))
    inner = ~stop[1:] & ~stop[:-1]
    seen_pairs = np.array([[float((inner & (tags[:-1] == a) & (tags[1:] == b)).sum()) for b in (0, 1)] for a in (0, 1)])
    n, m1, m2, t1, t2 = max(1, int((~stop).sum())), 0.0, 0.0, 0.0, 0.0
    b1 = b2 = 0.0
    for step in range(1, steps + 1):
        score = bias + np.bincount(rows, weights[cols], len(names)) if len(rows) else np.full(len(names), bias)
        emission = np.exp(np.clip(score, -30, 30))[at]
        factors = np.exp(trans)
        fwd, bwd = chain(emission, stop, factors)
        p = fwd * bwd / (1 + fwd * bwd)
        # pair marginals of neighbours in one sentence
        a, e = fwd[:-1], emission[1:] * bwd[1:]
        a, e = a[inner], e[inner]
        whole = factors[0, 0] + factors[0, 1] * e + factors[1, 0] * a + factors[1, 1] * a * e
        joint = np.array([[(factors[0, 0] / whole).sum(), (factors[0, 1] * e / whole).sum()], [(factors[1, 0] * a / whole).sum(), (factors[1, 1] * a * e / whole).sum()]])
        del a, e, whole, emission, fwd, bwd
        miss = np.where(stop, 0.0, tags - p)
        by_word = np.bincount(at, miss, len(names))
        g = np.bincount(cols, by_word[rows], len(features)) - 1e-1 * weights if len(rows) else weights
        gb, gt = miss.sum(), seen_pairs - joint - 1e-1 * trans
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        b1, b2 = 0.9 * b1 + 0.1 * gb, 0.99 * b2 + 0.01 * gb * gb
        t1, t2 = 0.9 * t1 + 0.1 * gt, 0.99 * t2 + 0.01 * gt * gt
        rate, c1, c2 = 0.3 if step < steps * 0.7 else 0.1, 1 - 0.9**step, 1 - 0.99**step
        weights = weights + rate * (m1 / c1) / (np.sqrt(m2 / c2) + 1e-8)
        bias = bias + rate * (b1 / c1) / (math.sqrt(b2 / c2) + 1e-8)
        trans = trans + rate * (t1 / c1) / (np.sqrt(t2 / c2) + 1e-8)
    trans[0, 0] = min(trans[0, 0], 30.0)
    return {u: float(weights[k]) for u, k in features.items() if abs(weights[k]) > 0.02}, float(bias), np.exp(trans - trans.max())


def document_features(p: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows (1, log expected toxic tokens, largest marginal's log odds, log share) of documents that end before `ends`."""
    starts = np.concatenate([[0], ends[:-1]])
    some = ends > starts
    total, most, count = np.zeros(len(ends)), np.full(len(ends), 0.0), np.maximum(ends - starts, 1)
    if some.any():
        total[some] = np.add.reduceat(p, starts[some])
        most[some] = np.maximum.reduceat(p, starts[some])
    total, most = np.clip(total, 0.0, None), np.clip(most, 1e-6, 1 - 1e-6)
    return np.stack([np.ones(len(ends)), np.log(total + 0.01), np.log(most / (1 - most)), np.log(total / count + 1e-5)], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge Newton steps; columns are scaled first."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    mean[0], scale[0] = 0.0, 1.0
    z, w = (x - mean) / scale, np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [1e-2 * len(y)] * (x.shape[1] - 1)) * 0.1
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (weight * (y - p)) - ridge @ w
        hess = (z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + ridge
        w = w + np.clip(np.linalg.solve(hess, grad), -3, 3)
    out = w / scale
    out[0] = w[0] - (w[1:] * mean[1:] / scale[1:]).sum()
    return out


class Tagger:
    """Marginals of texts in one worker; remembers words."""

    def __init__(self, model: ToxicModel):
        self.model, self.index, self.values = model, {c: k for k, c in enumerate(STOPS)}, [1.0] * len(STOPS)

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Token marginals of the texts in a row, and where each text ends among them."""
        if len(self.index) > MOST_WORDS:
            self.index, self.values = {c: k for k, c in enumerate(STOPS)}, [1.0] * len(STOPS)
        index, parts, ends, total = self.index, [], [], 0
        for text in texts:
            ws = tokens(text) if text else []
            row = np.fromiter((index.setdefault(w, len(index)) for w in ws), np.int64, len(ws))
            parts += [row, np.zeros(1, np.int64)]
            total += len(row) + 1
            ends.append(total)
        self.values += [self.model.emission(w) for w in list(index)[len(self.values) :]]
        at = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return marginals(np.array(self.values)[at], at < len(STOPS), self.model.trans), np.array(ends, np.int64)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        p, ends = self.texts(texts)
        return 1 / (1 + np.exp(-np.clip(document_features(p, ends) @ self.model.document, -30, 30)))

    def tagged(self, texts: list[str | None], least: float = 0.5) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """(scores, spans) of texts: spans are character offsets [start, end) of runs of tokens whose marginal is at least `least`."""
        p, ends = self.texts(texts)
        scores = 1 / (1 + np.exp(-np.clip(document_features(p, ends) @ self.model.document, -30, 30)))
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        high = p >= least
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        for k in np.unique(np.searchsorted(ends, np.flatnonzero(high), "right")).tolist():
            joined, out = False, spans[k]
            for m, toxic in zip(TOKEN.finditer(folded(texts[k] or "")), high[begins[k] : int(ends[k])].tolist(), strict=False):
                if toxic and joined:
                    out[-1] = (out[-1][0], m.end())
                elif toxic:
                    out.append((m.start(), m.end()))
                joined = toxic
        return scores, spans

    def spans(self, text: str | None, least: float = 0.5) -> list[tuple[int, int]]:
        return self.tagged([text], least)[1][0]


def fit(rows: Iterable[tuple[int, str]], prior: float) -> ToxicModel:
    """From (label, text) rows; `prior` is the share of toxic among all labelled training documents."""
    once: dict[tuple[int, int], tuple[int, list[str]]] = {}
    shared: dict[str, str] = {}  # a word is in memory once, not once a token
    for label, text in rows:
        ws = [shared.setdefault(w, w) for w in tokens(text)]
        once.setdefault((label, _near_key(ws)), (label, ws))
    docs = list(once.values())
    chain_docs, other = [d for k, d in enumerate(docs) if k % 3 < 2], [d for k, d in enumerate(docs) if k % 3 == 2]
    if not {0, 1} <= {d[0] for d in chain_docs} or not {0, 1} <= {d[0] for d in other}:
        return ToxicModel({}, -20.0, np.ones((2, 2)), np.array([-4.0, 0.0, 0.0, 0.0]))  # nothing to tell apart: all score low
    marked = telling_units([(label, [w for w in ws if w not in STOPS]) for label, ws in chain_docs])
    clean = [d for d in chain_docs if not d[0]]
    weights, bias, trans = fit_chain([d for d in chain_docs if d[0]] + clean[: len(chain_docs) - len(clean)], marked)
    model = ToxicModel(weights, bias, trans, np.zeros(4))
    p, ends = Tagger(model).texts([" ".join(ws) for _, ws in other])
    y = np.array([label for label, _ in other], float)
    share = y.mean()
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    model.document = fit_logistic(document_features(p, ends), y, weight)
    return model


def learn(docs: DataFrame, labels: DataFrame) -> ToxicModel:
    """Fits on labelled documents outside the held-out fold: at most MOST_TOXIC toxic and MOST_CLEAN clean ones.

    A doc_id that is labelled more than once counts as toxic if any label says so; null labels count as none.
    """
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).filter(~held_out())
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    with_text = known.join(docs.filter("text is not null").select("doc_id").distinct(), "doc_id", "left_semi")
    sides = [first_ranked(with_text.filter(side), "toxic", F.xxhash64("doc_id"), ["doc_id"], most) for side, most in (("toxic = 1", MOST_TOXIC), ("toxic <> 1", MOST_CLEAN))]
    picked = sides[0].unionByName(sides[1]).select("doc_id", "toxic", F.xxhash64("doc_id").alias("nth"))
    rows = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(picked), "doc_id")  # a few thousand ids at most
    texts = sorted((r.nth, int(r.toxic == 1), r.text) for r in rows.collect())
    toxic = totals.get(1, 0)
    return fit([(label, text) for _, label, text in texts], toxic / max(1, sum(totals.values())))


def score(docs: DataFrame, model: ToxicModel, with_spans: bool = False) -> DataFrame:
    """Every row with all its columns, and `toxic_score` (double); with_spans adds `toxic_spans` (array of start, end).

    Only the text is read for it; a null or empty text has no tokens and gets the score of such. A document column of one of
    these names is replaced.
    """
    kept = [c for c in docs.columns if c not in ("toxic_score", "toxic_spans")]
    schema = docs.select(*kept).schema.add("toxic_score", "double", False)
    if with_spans:
        schema = schema.add("toxic_spans", SPANS)
    text_at = kept.index("text")

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column(text_at).to_pylist()
                scores, found = tagger.tagged(texts) if with_spans else (tagger.scores(texts), [])
                columns, names = [*part.columns, pa.array(scores, pa.float64())], [*kept, "toxic_score"]
                if with_spans:
                    spans = [[{"start": a, "stop": b} for a, b in own] for own in found]
                    columns.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))))
                    names.append("toxic_spans")
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(*kept).mapInArrow(tag, schema)
