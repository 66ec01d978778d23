"""Source mix, fill-in-middle and vector codes against plain versions, and on odd rows."""

import collections
import hashlib
import re

import numpy as np
import pytest
from skyledger.llm import codes, middle, mixing

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


def plain_middle(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by one row at a time."""
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    name = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(name[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    if h4 % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_middle_as_brute_force(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(middle, "SLICE_BYTES", 3000)
    marks = ["<P>", "a<S>b", "<<P <S <M", "<P", "P>x", "<P ><S", "x<", ">", "  <M> ", "<", "é<P", "\n \n", " a", "a ", "  é b", "😀 😀"]
    rows = [(1000 + 7 * k, t) for k, t in enumerate(marks * 12)]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = middle.restore(middle.fill_in_middle(docs)).collect()
    want = collections.Counter((d, *plain_middle(d, t), t or "") for d, t in docs.collect())
    assert collections.Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in got) == want
    assert {"psm", "spm", "plain"} == {r.form for r in got}


def test_middle_of_random_bytes_comes_back():
    draw = np.random.default_rng(5)
    for _ in range(200):
        texts = ["".join(draw.choice(list("ab <>PSM\né"), draw.integers(0, 12))) for _ in range(draw.integers(1, 9))]
        data = [t.encode() for t in texts]
        bounds = np.concatenate([[0], np.cumsum([len(d) for d in data])])
        numbers = draw.integers(0, 1 << 32, (len(texts), 4), dtype=np.uint32)
        out = middle.rearrange(np.frombuffer(b"".join(data), np.uint8), bounds, numbers, fim_percent=90)
        back, at = middle.restored(out["data"], out["bounds"], out["form"])
        assert [back[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)] == data


def test_middle_of_nothing(no_docs):
    assert middle.digest(middle.fill_in_middle(no_docs)).count() == 0


def plain_codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    ints = [[int(np.floor(x * scale)) for x in v] + [0] * (width - len(v)) for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, ints[k]))
    step, books, best = width // parts, [], []
    for p in range(parts):
        own = [v[p * step : (p + 1) * step] for v in ints]
        book = [own[k] for k in order[:entries]]
        for last in [False] * rounds + [True]:
            near = [min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book)) for v in own]
            if not last:
                for k in range(len(book)):
                    held = [v for v, n in zip(own, near, strict=True) if n[1] == k]
                    if held:
                        book[k] = [sum(c) // len(held) for c in zip(*held, strict=True)]
        books += [x for e in book for x in e]
        best.append(near)
    error = [sum(b[k][0] for b in best) for k in range(len(kept))]
    by = collections.Counter()
    for (_, _, lab), e in zip(kept, error, strict=True):
        by[lab] += e
    name = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    return collections.Counter((kept[k][0], "".join(f"{b[k][1]:02x}" for b in best), error[k], by[kept[k][2]], name) for k in range(len(kept)))


VECTORS = "vec_id long, embedding array<float>, label int"


def test_codes_as_brute_force(spark):
    draw = np.random.default_rng(3)
    near = [(int(i), [float(x) for x in draw.normal(0, 0.01, 8).astype(np.float32)], int(i) % 3) for i in draw.permutation(400)]
    odd = [
        (401, None, 1), (402, [NAN] * 8, 1), (403, [0.1] * 7 + [None], 1), (404, [INF] + [0.0] * 7, 2), (7, near[3][1], None), (7, near[3][1], None),
        (None, [0.25] * 8, None), (-1, [0.5] * 5, 9), (405, [], 9), (406, [-0.0001] * 8, 9),
    ]
    rows = near + odd
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS ints", "2 AS code", "3 AS error", "4 AS part", "5 AS label_error")
    got = collections.Counter(tuple(r) for r in codes.digest(df).collect())
    assert got == plain_codes([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows])


@pytest.mark.parametrize("rows", [[(k, [1.5e6 * (-1) ** k, 1e6 + k, -1e6, 3.0 * k], k % 2) for k in range(5)], [(1, [1.0] * 4, None)] * 3, [(1, [], 1)]])
def test_codes_of_large_few_and_empty_vectors(spark, rows):
    assert collections.Counter(tuple(r) for r in codes.digest(spark.createDataFrame(rows, VECTORS)).collect()) == plain_codes([(i, [float(np.float32(x)) for x in v], lab) for i, v, lab in rows])


def test_codes_beyond_the_integers_and_of_nothing(spark):
    far = spark.createDataFrame([(1, [3e38, -3e38, 0.0, 1.0], 1), (2, [0.0] * 4, 1)], VECTORS)
    assert {r.code for r in codes.digest(far).collect()} == {"00000000", "01010001"}  # a tie in the third part
    assert codes.digest(spark.createDataFrame([(1, None, 1)], VECTORS)).count() == 0


def test_codes_stand_for_vectors_near_the_given_ones(spark):
    ints = codes.integers(spark.read.parquet(f"{SF}/embeddings.parquet"))
    books = codes.learn(ints)
    by = {r.vec_id: r for r in codes.decode(codes.encode(ints, books), books).collect()}
    for r in ints.collect():
        gap = np.array(r.ints) - np.rint(np.array(by[r.vec_id].approximation) * codes.SCALE).astype(int)
        assert int((gap**2).sum()) == by[r.vec_id].error


def size_of(text):
    return len(re.findall(mixing.WORD, text or ""))


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing what is above anew, round by round."""
    total, names = sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full, goal = set(), dict.fromkeys(names, 0.0)
    while total:
        left = total - sum(most * sizes[s] for s in full)
        goal = {s: most * sizes[s] if s in full else left * weight[s] / sum(weight[x] for x in names if x not in full) for s in names}
        above = {s for s in names if s not in full and goal[s] > most * sizes[s]}
        if not above:
            break
        full |= above
    return goal


def assert_mixed(rows, docs):
    sizes = collections.Counter()
    for _, text, source in docs:
        sizes[source] += size_of(text)
    goal = plain_targets(sizes)
    assert collections.Counter((r.doc_id, r.size) for r in rows) == collections.Counter((d, size_of(t)) for d, t, _ in docs)
    taken = collections.Counter()
    given = {(d, size_of(t)): s for d, t, s in docs}
    for r in rows:
        source = given[r.doc_id, r.size]
        assert r.source_size == sizes[source] and r.target == pytest.approx(goal[source]) and 0 <= r.taken <= 3 * r.size
        taken[source] += r.taken
    for s, words in taken.items():
        assert goal[s] - 1 <= words <= goal[s] + 1e-6


def test_mix_reaches_its_targets(spark, odd_docs):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    assert_mixed(mixing.digest(given).collect(), [(r.doc_id, r.text, r.source) for r in given.collect()])
    few = [(d, t, None if d is None else f"s{d % 4}") for d, t in odd_docs.select("doc_id", "text").collect()]
    rows = spark.createDataFrame(few, "doc_id long, text string, source string").selectExpr("*", "1 AS row", "2 AS size", "3 AS rank", "4 AS sid", "5 AS target")
    first = mixing.digest(rows).collect()
    assert_mixed(first, few)
    assert collections.Counter(first) == collections.Counter(mixing.digest(rows.repartition(5)).collect())


def test_mix_of_one_of_many_and_of_empty_sources(spark):
    kind = "doc_id long, text string, source string"
    for docs in ([(1, "a b c", None)], [(1, "", "x"), (2, None, "y")], [(k, "w " * (k % 5), f"s{k}") for k in range(300)], [(1, "w " * 5000, "big"), (2, "a", "one"), (3, "", "none")]):
        assert_mixed(mixing.digest(spark.createDataFrame(docs, kind)).collect(), docs)
    assert mixing.digest(spark.createDataFrame([], kind)).count() == 0


def test_every_run_of_slots_is_near_the_weights(spark):
    rows = mixing.sized(spark.read.parquet(f"{SF}/documents.parquet"))
    sources = mixing.targets(rows)
    share = {r.sid: r.target for r in sources.collect()}
    total = sum(share.values())
    spans = mixing.mix(rows, sources, block_words=16).collect()
    order = [s for _, s, _ in sorted({(r.position, r.sid, r.rank) for r in spans})]
    assert len({(r.sid, r.rank) for r in spans}) == len(order)
    for a in range(0, len(order) - 500, 250):
        run = collections.Counter(order[a : a + 500])
        assert all(abs(run[s] - 500 * share[s] / total) < 8 for s in share)


def test_texts_of_the_mix(spark):
    docs = spark.createDataFrame([(k, " ".join(f"d{k}w{j}" for j in range(3 + k)), "ab"[k % 2]) for k in range(12)], "doc_id long, text string, source string")
    rows = mixing.sized(docs)
    spans = mixing.mix(rows, mixing.targets(rows), block_words=4)
    out = mixing.texts(spans, docs).collect()
    assert all(len(r.text.split()) == r.n_words <= 4 for r in out)
    words = collections.Counter(w for r in out for w in r.text.split())
    taken = {r.doc_id: r.taken for r in mixing.digest(docs, block_words=4).collect()}
    for doc, n in taken.items():
        assert sum(c for w, c in words.items() if w.startswith(f"d{doc}w")) == n


def test_points_are_golden(spark):
    golden = (5**0.5 - 1) / 2
    for t in (0, 1, 2, 1000, 123456, (1 << 30) + 7):
        x = spark.range(1).select(mixing.point(mixing.F.lit(t).cast("long")).alias("x")).first().x
        assert x == t * mixing.GOLDEN % (1 << mixing.BITS)
        assert t > 1000 or x / (1 << mixing.BITS) == pytest.approx(t * golden % 1, abs=1e-6)
