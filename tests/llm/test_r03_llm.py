"""Document findings of the third round: each test fails on the code before."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from skyledger.llm import nearcopies, packing, secrets, simhash, tokens


def test_long_candidates_are_used_whole(spark):
    head = "k9Xw" * 150
    docs = spark.createDataFrame([(1, f"see {head}AAAA end"), (2, f"see {head}BBBB end"), (3, "a token=abcDEF0123456789 there"), (4, f"only {'abcdef' * 120} here")], "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.described(secrets.candidates(docs), docs).collect()}
    assert set(got) == {1, 2, 3} and got[1].value == head + "AAAA" and got[2].value == head + "BBBB"
    assert hashlib.sha256(got[1].value.encode()).hexdigest() != hashlib.sha256(got[2].value.encode()).hexdigest()

    kind = lambda c: "a" if c.islower() else "A" if c.isupper() else "9" if c.isdigit() else "-"
    table = {r.pair: r.log_p for r in secrets.transitions(secrets.corpus_words(docs)).collect()}
    for r in got.values():
        v, low = r.value, r.value.lower()
        assert r.length == len(v)
        assert r.changes == pytest.approx(sum(kind(a) != kind(b) for a, b in zip(v, v[1:])) / len(v))
        assert r.transition == pytest.approx(math.fsum(table.get(low[i : i + 2], -8.0) for i in range(len(v) - 1)) / len(v))
        assert r.distinct_share == pytest.approx(len(set(v)) / len(v))
        assert r.digit_share == pytest.approx(sum(c.isdigit() for c in v) / len(v))


def test_near_copies_join_fingerprints_within_three_bits(spark):
    """One shingle makes most of both texts, so their fingerprints are equal, though their shingle sets are far apart."""
    texts = ["a " * 60 + " ".join(f"{c}{i}" for i in range(20)) for c in "bc"] + [" ".join(f"d{i}" for i in range(50))]
    prints = [simhash.fingerprint(t) for t in texts]
    assert (prints[0] ^ prints[1]).bit_count() <= 3 < (prints[0] ^ prints[2]).bit_count()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in nearcopies.near_copies(docs).collect()} == {0: 0, 1: 0, 2: 2}


def test_packing_remembers_a_bounded_number_of_words(spark):
    path = tokens.public_path(tokens.WORD_BPE)
    e = tokens.WordEncoder(path, False, most_words=50)
    e.encode([" ".join(f"first{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(100))])
    held = len(e.known)
    texts = [" ".join(f"then{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300))]
    assert e.encode(texts) == e._whole(texts) and len(e.known) == held
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(1200)], "doc_id long, text string").coalesce(1)
    assert packing.ROWS_AT_ONCE < 1200 and packing.token_pieces(docs).agg(F.count_distinct("doc_id")).first()[0] == 1200


def test_a_fit_holds_a_word_once():
    """The texts of the fit are in the driver's memory, where a token took a string of its own."""
    import random
    import tracemalloc

    from skyledger.llm import toxicity

    r = random.Random(7)
    words = [f"ordinary{i}" for i in range(300)]
    rows = [(k % 2, " ".join(r.choices([*words, *(["vile"] * 30 if k % 2 else [])], k=500))) for k in range(400)]
    tracemalloc.start()
    model = toxicity.fit(iter(rows), 0.5)
    peak = tracemalloc.get_traced_memory()[1] / (400 * 500)
    tracemalloc.stop()
    assert peak < 90, peak  # bytes a token
    scores = toxicity.Tagger(model).scores([rows[0][1], rows[1][1], None])
    assert scores[0] < 0.5 < scores[1]
