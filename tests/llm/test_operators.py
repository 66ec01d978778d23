"""Document operators against plain versions, and on odd rows."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from skyledger.llm import decontaminate, huffman, langid, linededup, media, packing, secrets, sharding, simhash, tokens, toxicity
from skyledger.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def given(spark):
    return texts_of(spark.read.parquet(f"{SF}/documents.parquet"))


def plain_hits(docs, items, window=10):
    word = re.compile(decontaminate.WORD)
    runs = collections.defaultdict(set)
    for item, text in items:
        w = word.findall((text or "").translate(FOLD))
        for a in range(max(1, len(w) - window + 1) if w else 0):
            runs[tuple(w[a : a + window])].add(str(item))
    out = set()
    for doc, text in docs:
        w, hit, found = word.findall((text or "").translate(FOLD)), set(), set()
        for n in {len(k) for k in runs}:
            for a in range(len(w) - n + 1):
                if items_of := runs.get(tuple(w[a : a + n])):
                    hit.update(range(a, a + n))
                    found |= items_of
        out.add((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def test_decontamination_as_brute_force(spark, odd_docs):
    items = [(1, "quick brown fox"), (2, "Over the LAZY dog and runs far away from all of the hounds"), (3, None), (4, "--"), (5, "word0 and of word1"), (11, "QUICK brown fox"), (12, "of word5 and of word6 and of word7 and of word8 and of")]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS words", "2 AS hash")
    got = decontaminate.digest(decontaminate.benchmark_hits(odd_docs, bench))
    assert {tuple(r) for r in got.collect()} == plain_hits(texts_of(odd_docs), items)


def test_decontamination_without_items_or_documents(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "quick brown fox")], "item_id long, text string")
    assert decontaminate.benchmark_hits(no_docs, bench).count() == 0
    none = decontaminate.digest(decontaminate.benchmark_hits(odd_docs, bench.filter("false"))).collect()
    assert len(none) == 12 and not any(r.contaminated for r in none)  # the row that repeats another counts once


def test_decontamination_in_blocks(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    monkeypatch.setattr(decontaminate, "BLOCK_ROWS", 300)
    got = {tuple(r) for r in decontaminate.digest(decontaminate.benchmark_hits(docs, bench)).collect()}
    assert got == plain_hits(texts_of(docs), [(r.item_id, r.text) for r in bench.collect()])


@pytest.mark.parametrize(("name", "joins"), [(tokens.BYTE_BPE, True), (tokens.WORD_BPE, False)])
def test_cached_ids_are_the_tokenizers(given, odd_docs, name, joins):
    encoder = tokens.WordEncoder(tokens.public_path(name), joins)
    every = [t for _, t in given if t] + ["", " ", "a  b", " x y ", "q\n\nz", "a\t \tb", "it's I'll\nwe've 3.5e", "ΑΣ é é   b", "a \nb c\n", "x..y,z., ...", "\x01a \x01 b\n\x01"] + [t for _, t in texts_of(odd_docs) if t]
    for _ in range(2):
        assert encoder.encode(every) == encoder._whole(every)


def test_ids_beyond_the_memory_of_a_worker(given, monkeypatch):
    monkeypatch.setattr(tokens, "MOST_WORDS", 50)
    monkeypatch.setattr(tokens, "SLICE_CHARS", 5000)
    encoder = tokens.WordEncoder(tokens.public_path(tokens.WORD_BPE), False)
    every = [t for _, t in given if t]
    assert encoder.encode(every) == encoder._whole(every)


def test_packing_keeps_every_id_once(odd_docs):
    rows = packing.pack_documents(odd_docs, length=64).collect()
    encoder = tokens.WordEncoder(tokens.public_path(tokens.WORD_BPE), False)
    whole = collections.Counter((d, encoder._whole([t or ""])[0] + bytes(4)) for d, t in texts_of(odd_docs))
    parts = collections.defaultdict(lambda: collections.defaultdict(list))
    for r in rows:
        assert r.length == len(r.ids) // 4 and r.start == 64 * r.piece
        parts[r.doc_id][r.piece].append(bytes(r.ids))
    for (doc, data), times in whole.items():
        for k, at in enumerate(range(0, len(data), 256)):
            assert parts[doc][k].count(data[at : at + 256]) >= times
    by_sequence = collections.defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for placed in by_sequence.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= 64
    assert len(by_sequence) <= 1.1 * sum(r.length for r in rows) / 64 + 2


def test_sum_of_squares_rule():
    packer = packing.SquaresPacker(10)
    assert [packer.place(n) for n in (7, 6, 3, 4)] == [(0, 0), (1, 0), (0, 7), (1, 6)]  # 3 fills gap 3, 4 fills gap 4
    assert packer.place(10) == (2, 0) and packer.open.sum() == 0


def test_packing_nothing(no_docs):
    assert packing.packing_digest(no_docs).count() == 0


def plain_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(runs) > 0)


def plain_classes(nodes, near):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if near(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def test_near_copies_as_brute_force(odd_docs):
    docs = texts_of(odd_docs)
    fps = {(d, t): plain_fingerprint(t) for d, t in docs}
    root = plain_classes(sorted(set(fps.values())), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for (d, _), fp in fps.items():
        if d is not None:
            least[root[fp]] = min(d, least.get(root[fp], d))
    expected = collections.Counter((d, f"{fps[d, t]:016x}", least.get(root[fps[d, t]])) for d, t in docs)
    near = simhash.near_copies(odd_docs)
    assert collections.Counter(tuple(r) for r in near.select("doc_id", simhash.hex_fingerprint(near.fp), "component_id").collect()) == expected


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(4)], base ^ np.uint64(0b1011)]))
    expected = np.array([[bin(int(a ^ b)).count("1") <= radius for b in fps] for a in fps])
    assert (simhash.within(fps, fps, radius) == expected).all()


def test_large_groups_are_compared_in_tiles(spark):
    rng = np.random.default_rng(3)
    fps = [0]
    for _ in range(300):  # a chain of single-bit steps, and far ones
        fps.append(fps[-1] ^ (1 << int(rng.integers(0, 63))))
    fps += [int(x) for x in rng.integers(0, 2**63, 50)]
    fps = sorted(set(fps))
    links = simhash.hamming_links(spark.createDataFrame([(f,) for f in fps], "fp long"), tile=8)
    roots = {r.node: r.root for r in simhash.components(links).collect()}
    expected = plain_classes(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    assert {f: roots.get(f, f) for f in fps} == expected


def test_no_documents_no_copies(no_docs):
    assert simhash.near_copies(no_docs).count() == 0


def test_later_documents_lose_common_blocks(odd_docs):
    out = linededup.without_repeats(odd_docs)
    assert out.schema == odd_docs.schema and out.count() == odd_docs.count()
    new, old = collections.defaultdict(list), collections.defaultdict(list)
    for d, t in texts_of(out):
        new[d].append(t)
    for d, t in texts_of(odd_docs):
        old[d].append(t)
    assert new[8] == ["own start"] and new[7] == old[7]
    for d in (1, 2, 3, 4, 5, None, 6, 9, 10):  # document 6 repeats 1, but a block of under 30 words stays
        assert sorted(map(str, new[d])) == sorted(map(str, old[d]))
    assert [t for d, t in texts_of(linededup.without_repeats(odd_docs, least_words=10)) if d == 6] == [""]
    assert linededup.without_repeats(odd_docs.filter("false")).count() == 0


def test_line_blocks_as_brute_force(spark, given):
    """Every deleted line stands in an earlier document; every shared passage of a whole long line is deleted."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    new = dict(texts_of(linededup.without_repeats(docs)))
    first = {}
    for d, t in sorted(given):
        for line in (t or "").split("\n"):
            first.setdefault(line.strip(" "), d)
    for d, t in given:
        left = collections.Counter((new[d] or "").split("\n"))
        gone = collections.Counter((t or "").split("\n")) - left
        assert all(first[line.strip(" ")] < d for line in gone if line.strip(" "))
        for line in left:
            assert len(line.split()) < 30 or first[line.strip(" ")] == d


def test_patience_blocks():
    assert linededup.rising([3, 1, 4, 2, 5]) in ([0, 2, 4], [1, 2, 4], [1, 3, 4])
    # lines 10..12 stand in the owner in order, 20 crosses them
    assert linededup.align([(0, 2, 7), (1, 3, 8), (5, 6, 1), (9, 9, 20)]) == [(0, 3, 7), (5, 6, 1), (9, 9, 20)]  # the second block moved
    assert linededup.align([(0, 0, 4), (1, 1, 4), (2, 2, 4)]) == [(0, 0, 4), (1, 1, 4), (2, 2, 4)]  # a repeated line
    assert linededup.align([(k, k, 0) for k in range(20_000)])[-1] == (19_999, 19_999, 0)


def test_languages_on_the_held_out_fold(spark):
    rows = QUERIES["op5_language_id"](spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in rows) and len(rows) == len(truth)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(odd_docs, no_docs):
    model = langid.learn(odd_docs)
    out = [(r.doc_id, r.lang_pred, r.score) for r in langid.predict(odd_docs, model).collect()]
    assert len(out) == odd_docs.count() and {(2, "und", 0.0), (3, "und", 0.0), (9, "und", 0.0)} <= set(out)
    assert {r.lang_pred for r in langid.predict(odd_docs, langid.learn(no_docs)).collect()} == {"und"}
    assert langid.predict(no_docs, model).count() == 0


def test_forward_sums_all_segmentations():
    pieces = ["a", "b", "ab", "ba", "▁a", "▁ab"]
    probability = {"a": 0.3, "b": 0.2, "ab": 0.1, "ba": 0.15, "▁a": 0.2, "▁ab": 0.05, "▁": langid.FLOOR}
    table = np.array([0.0, *[probability[p] for p in pieces]])[:, None]
    model = langid.UnigramModel(["x"], np.zeros(1), pieces, table)

    def total(text):
        return 1.0 if not text else sum(probability.get(text[:k], langid.FLOOR if k == 1 else 0.0) * total(text[k:]) for k in range(1, len(text) + 1))

    for word in ("a", "ab", "aba", "babba", "c", "ab" * 30):
        if len(word) < 12:
            assert np.isclose(np.exp(model.log_probability([word])[0, 0]), total("▁" + word))
        assert np.isfinite(model.log_probability([word])).all()


@pytest.mark.parametrize("long", [2, 40])
def test_expected_uses_of_pieces_in_words_of_any_length(long, monkeypatch):
    pieces = ["a", "abababababab", "ab", "b", "ba", "▁a", "▁abab"]
    table = np.random.default_rng(4).uniform(0.01, 0.2, (len(pieces) + 1, 2))
    table[0] = 0
    model = langid.UnigramModel(["x", "y"], np.zeros(2), pieces, table)
    assert model.lattice.longest == 12
    words, counts = ["ab", "abababababababc", "bab", "ab" * 19], np.array([[1.0, 2], [3, 0], [0, 1], [2, 2]])
    monkeypatch.setattr(langid, "SCALED", long)
    uses = langid.expected_counts(model, words, counts)

    def plain(text, k, language):
        """(probability, uses of piece k weighted by probability) over all segmentations."""
        best = [(1.0, 0.0)]
        for end in range(1, len(text) + 1):
            p = u = 0.0
            for start in range(max(0, end - 13), end):
                name = text[start:end]
                at = pieces.index(name) + 1 if name in pieces else 0
                q = table[at, language] if at else 0.0
                q = max(q, langid.FLOOR) if end - start == 1 else q
                p += best[start][0] * q
                u += best[start][1] * q + (best[start][0] * q if at == k else 0.0)
            best.append((p, u))
        return best[-1]

    for k in range(1, len(pieces) + 1):
        for language in range(2):
            want = sum(counts[i, language] * plain("▁" + w, k, language)[1] / plain("▁" + w, k, language)[0] for i, w in enumerate(words))
            assert np.isclose(uses[k, language], want)


def test_first_rows_by_hash(spark):
    rows = spark.range(5000).selectExpr("id AS doc_id", "CASE WHEN id % 10 = 0 THEN 'few' ELSE 'many' END AS lang")
    from pyspark.sql import functions as F
    from skyledger.llm.common import first_ranked

    hashed = {(r.lang, r.h, r.doc_id) for r in rows.withColumn("h", F.xxhash64("doc_id")).collect()}
    for most in (1, 50, 800):
        got = {r.doc_id for r in first_ranked(rows, "lang", F.xxhash64("doc_id"), ["doc_id"], most).collect()}
        assert got == {d for lang in ("few", "many") for _, _, d in sorted(x for x in hashed if x[0] == lang)[:most]}
    alike = spark.range(300).selectExpr("7L AS doc_id", "'x' AS lang")
    assert first_ranked(alike, "lang", F.xxhash64("doc_id"), ["doc_id"], 40).count() == 40


def test_toxicity_on_the_held_out_fold(spark):
    rows = {r.doc_id: r for r in QUERIES["op7_toxicity"](spark, "/root/testdata/sf0.1").collect()}
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect() if rows[r.doc_id].held_out]
    hits = sum(rows[d].predicted == 1 and t == 1 for d, t in labels)
    assert hits >= 0.75 * sum(t == 1 for _, t in labels) and hits >= 0.85 * sum(rows[d].predicted for d, _ in labels)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    texts = dict(texts_of(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id < 2000")))
    marked = [(d, [tuple(map(int, x.split("-"))) for x in r.spans.split(",")]) for d, r in rows.items() if r.spans and d in texts]
    assert marked and all(0 <= a < b <= len(texts[d]) for d, spans in marked for a, b in spans)


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, None), (None, 1), (77, 1)], "doc_id long, toxic int")
    model = toxicity.learn(odd_docs, labels)
    out = toxicity.score(odd_docs.withColumn("toxic_score", odd_docs.doc_id), model, with_spans=True)
    assert out.count() == odd_docs.count() and out.filter("toxic_score >= 0.5").count() == 0
    assert toxicity.score(no_docs, model).count() == 0
    assert toxicity.score(odd_docs, toxicity.learn(odd_docs, labels.filter("false"))).filter("toxic_score >= 0.5").count() == 0


def test_chain_marginals_as_enumeration():
    emission, stop = np.array([0.5, 3.0, 1.0, 2.0, 0.1]), np.array([False, False, True, False, False])
    trans = np.array([[1.0, 0.2], [0.4, 0.9]])
    expected = np.zeros(5)
    for a, b in ((0, 2), (3, 5)):
        n, total, mass = b - a, 0.0, np.zeros(b - a)
        for tags in np.ndindex(*[2] * n):
            w = np.prod([emission[a + i] ** t for i, t in enumerate(tags)]) * np.prod([trans[x, y] for x, y in zip(tags, tags[1:], strict=False)])
            total += w
            mass += w * np.array(tags)
        expected[a:b] = mass / total
    assert np.allclose(toxicity.marginals(emission, stop, trans), expected)


def test_toxic_spans_point_into_the_text():
    model = toxicity.ToxicModel({"idiot": 20.0}, -5.0, np.ones((2, 2)), np.array([0.0, 1.0, 0.0, 0.0]))
    text = "You İ are an Idiot, my idiot friend."
    assert [text[a:b] for a, b in toxicity.Tagger(model).spans(text)] == ["Idiot", "idiot"]


def test_token_files_give_back_every_id(odd_docs, no_docs):
    whole = tokens.WordEncoder(tokens.public_path(tokens.BYTE_BPE), True)._whole
    rows = [(d, whole([t or ""])[0] + (2).to_bytes(4, "little")) for d, t in texts_of(odd_docs)]
    path = huffman.write_files(odd_docs)
    got = huffman.read_files(*huffman.open_files(odd_docs.sparkSession.newSession(), path)).orderBy("row").collect()  # from the files alone
    assert collections.Counter((r.doc_id, bytes(r.ids)) for r in got) == collections.Counter(rows)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    digest = sorted(tuple(r) for r in huffman.digest(odd_docs.sparkSession, path).select("start", "n_tokens", "ids_crc32").collect())
    at = 0
    for (start, n, crc), r in zip(digest, got, strict=True):
        assert (start, n, crc) == (at, len(r.ids) // 4, zlib.crc32(bytes(r.ids)))
        at += n
    assert huffman.digest(no_docs.sparkSession, huffman.write_files(no_docs)).count() == 0


def test_token_files_of_many_files_and_of_text_ids(spark, monkeypatch):
    monkeypatch.setattr(huffman, "FILE_IDS", 2000)
    monkeypatch.setattr(huffman, "SLICE_IDS", 700)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = huffman.write_files(docs)
    assert spark.read.parquet(f"{path}/blocks").select("row").selectExpr("row >> 33 AS f").distinct().count() > 5
    whole = tokens.WordEncoder(tokens.public_path(tokens.BYTE_BPE), True)._whole
    at = 0
    found = {r.doc_id: r for r in huffman.digest(spark, path).collect()}
    for doc, text in sorted(texts_of(docs)):
        ids = whole([text or ""])[0] + (2).to_bytes(4, "little")
        assert (found[doc].start, found[doc].n_tokens, found[doc].ids_crc32) == (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4
    named = huffman.write_files(docs.selectExpr("CAST(doc_id AS STRING) AS doc_id", "text").limit(20))
    assert huffman.digest(spark, named).count() == 20


def test_ids_beyond_sixteen_bits_are_refused(odd_docs, monkeypatch):
    monkeypatch.setattr(huffman, "WIDEST", 50_000)
    with pytest.raises(Exception, match="16 bits"):
        huffman.token_table(odd_docs).write.format("noop").mode("overwrite").save()


@pytest.mark.parametrize("longest", [9, 12, 16])
def test_code_lengths(longest):
    counts = np.bincount((np.random.default_rng(1).zipf(1.3, 50_000) - 1) % 500, minlength=520)
    lengths = huffman.code_lengths(counts, longest)
    assert lengths.max() <= longest and np.isclose((0.5 ** lengths[lengths > 0].astype(float)).sum(), 1.0)
    assert ((lengths > 0) == (counts > 0)).all()
    ids = np.random.default_rng(2).choice(np.flatnonzero(counts), 1000)
    parts = [ids[:1], ids[1:130], ids[130:131], ids[131:]]
    blocks = huffman.encode_blocks(parts, huffman.canonical_codes(lengths), lengths)
    back = huffman.decode_blocks([b for b, _ in blocks], [m.astype("<u4") for _, m in blocks], [len(p) for p in parts], huffman.decoding_table(lengths, longest), longest)
    assert all((b == p).all() for b, p in zip(back, parts, strict=True))
    assert huffman.code_lengths(np.array([0, 5, 0])).tolist() == [0, 1, 0]


def test_media_round_trip(odd_docs, no_docs):
    rows = {(r.doc_id, r.payload_sha256): r for r in media.digest(odd_docs).collect()}
    for d, t in texts_of(odd_docs):
        data = (t or "").encode()
        payload = data + b" " * (192 * max(1, -(-len(data) // 192)) - len(data))
        r = rows[d, hashlib.sha256(payload).hexdigest()]
        stored = media.wrap(payload)
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32, r.media_bytes, r.media_sha256) == (len(data), len(payload), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest())
    assert media.digest(no_docs).count() == 0
    told = media.described(media.media_of(odd_docs)).select("doc_id", "description.codec", "description.n_samples").collect()
    assert len(told) == len(texts_of(odd_docs)) and {r.codec for r in told} == {"raw "}


def test_media_boxes():
    payload = bytes(range(256)) * 192 * 3
    found = media.describe(media.wrap(payload))
    assert (found["codec"], found["handler"], found["n_samples"]) == ("raw ", "soun", 768) and found["duration_s"] == len(payload) / media.RATE
    content = media.wrap(payload)
    assert [content[r["start"] : r["stop"]] for r in found["keyframes"]] == [payload[192 * k : 192 * k + 192] for k in range(0, 768, 100)]
    for junk in (None, b"", b"abc", b"\0\0\0\x08free", content[:200], content[:40] + b"\xff" * 100):
        media.describe(junk)


def test_shards_fit(odd_docs, no_docs):
    rows = sharding.assign(odd_docs, limit=200).collect()
    assert len(rows) == odd_docs.count()
    total = collections.Counter()
    for r in rows:
        assert len(r.shard) == r.depth
        total[r.shard] += r.n_bytes
    alone = {r.shard for r in rows if r.depth == sharding.BITS}
    assert all(total[r.shard] == r.shard_bytes and (r.shard_bytes <= 200 or r.shard in alone) for r in rows)
    names = sorted(total)
    assert not any(b.startswith(a) for a in names for b in names if a != b)
    for name in names:  # a bucket split only because it was too large
        if name:
            assert sum(n for s, n in total.items() if s.startswith(name[:-1])) > 200
    slots = sharding.directory(sharding.assign(odd_docs.filter("doc_id <> 4"), limit=200)).orderBy("first_slot").collect()
    assert slots[0].first_slot == 0 and slots[-1].last_slot + 1 <= 2 ** max(s.depth for s in slots)
    assert sharding.assign(no_docs).count() == 0


def test_hot_rows_spread_over_shards(spark):
    docs = spark.createDataFrame([(1, "x" * 50)] * 300 + [(i, "y" * 50) for i in range(2, 200)], "doc_id long, text string")
    rows = sharding.assign(docs, limit=2000).collect()
    assert len(rows) == 498 and max(r.shard_bytes for r in rows) <= 2000


def test_written_shards(odd_docs, tmp_path):
    sharding.write_shards(odd_docs, str(tmp_path / "out"), limit=400)
    back = odd_docs.sparkSession.read.parquet(str(tmp_path / "out"))
    assert back.count() == odd_docs.count() and {*back.columns} == {*odd_docs.columns, "shard"}


def test_written_shards_keep_the_limit(spark, tmp_path):
    rows = [(k % 40, "x" * (30 + k % 40), k) for k in range(400)] + [(1000, "y" * 50, k) for k in range(300)] + [(None, "z" * 20, 1)] * 9
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra long").repartition(5)
    sharding.write_shards(docs, str(tmp_path / "out"), limit=500)
    back = spark.read.schema("doc_id long, text string, extra long, shard string").parquet(str(tmp_path / "out")).collect()
    sizes = collections.Counter()
    for r in back:
        sizes[r.shard] += len(r.text)
    assert max(sizes.values()) <= 500
    assert collections.Counter((r.doc_id, r.text, r.extra) for r in back) == collections.Counter(rows)


def test_secret_scan(spark, odd_docs, no_docs):
    import random

    rng = random.Random(5)
    hexa = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    rows = []
    for i in range(240):
        rows.append((i, [f'use token = "{hexa(40)}" there', f"mail me.{i}@mail{i}.example.com now", f"at 172.24.{i}.22 and commit {hexa(40)} here", f"AKIA{''.join(rng.choices('ABCDEFGHIJ234567', k=16))} is it"][i % 4]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in secrets.scan(docs).collect()}
    for i in range(240):
        if zlib.crc32(str(i).encode()) % 5 == 0 and i in found:
            assert found[i].secret == (i % 4 in (0, 3))
    assert secrets.scan(odd_docs).count() >= 0 and secrets.scan(no_docs).count() == 0


def test_secret_scan_with_given_labels(spark):
    docs = spark.createDataFrame([(i, f"see id-{i:06d}-abc{i * 7919 % 1000003:07d}x end" if i % 2 else f"pw xK9{i * 7919 % 1000003:07d}QzT{i}Lp end") for i in range(80)], "doc_id long, text string")
    labelled = spark.createDataFrame([(i, 0, 1 - i % 2) for i in range(60)], "doc_id long, nth int, label int")
    found = {r.doc_id: r.secret for r in secrets.scan(docs, labelled).collect()}
    assert all(found[i] == (i % 2 == 0) for i in range(60, 80))


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns, name
        before = after
    left = {r.doc_id for r in before.select("doc_id").collect()}
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == left
    assert sum(r.length for r in packed) > 0


def test_stages_on_odd_rows(spark, odd_docs, no_docs):
    from skyledger.llm import stages

    once = stages.keep_one_of_near_copies(spark, odd_docs, SF)
    ids = collections.Counter(r.doc_id for r in once.collect())
    assert once.columns == odd_docs.columns and ids[1] == 1 and ids[6] == 0 and ids[5] == 2 and ids[None] == 1 and ids[2] == 1 and ids[3] == 0
    for stage in (stages.drop_toxic, stages.drop_contaminated, stages.drop_repeated_lines):
        assert stage(spark, odd_docs, SF).columns == odd_docs.columns
        assert stage(spark, no_docs, SF).count() == 0
