"""Whole results where a part of them was found before."""

import collections
import random

import pytest
from skyledger.llm import linededup, nearcopies, simhash, stages

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def similarity(a, b):
    return len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))


def edited_copies():
    """Texts and copies with some words replaced, of similarities around 0.8."""
    draw, out = random.Random(5), []
    for _ in range(12):
        base = [f"w{draw.randrange(5000)}" for _ in range(draw.randrange(60, 400))]
        out.append(" ".join(base))
        for edits in (1, 2, 4, 6, 9):
            copy = list(base)
            for at in draw.sample(range(len(copy)), edits):
                copy[at] = f"x{draw.randrange(10**6)}"
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("tile", [1024, 2])
def test_near_copies_of_five_words_and_similarity(spark, tile):
    texts = edited_copies()
    root = list(range(len(texts)))
    for i, a in enumerate(texts):
        for j in range(i):
            if similarity(a, texts[j]) >= 0.8:
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(docs, tile=tile).collect()}
    assert got == dict(enumerate(root)) and 12 < len(set(root)) < len(root)


def test_stage_drops_copies_beyond_three_bits_and_keeps_other_texts(spark):
    texts = edited_copies()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in stages.keep_one_of_near_copies(spark, docs, SF).collect()}
    far = [i for i in range(1, len(texts)) if i % 6 == 1 and similarity(texts[i], texts[i - 1]) >= 0.8 and (simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[i - 1])).bit_count() > 3]
    assert far and not kept & set(far)
    assert all(i in kept for i, a in enumerate(texts) if all(similarity(a, b) < 0.8 for b in texts[:i]))


def line(name, words):
    return " ".join(f"{name}{i}" for i in range(words))


def left_of(spark, *texts):
    out = linededup.without_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [r.text for r in sorted(out)]


def test_a_passage_is_looked_up_whole(spark):
    """Its second line has an earlier owner than the others, and several short lines make it."""
    one, two, three = line("a", 25), line("b", 9), line("c", 25)
    passage = "\n".join([one, two, three])
    assert left_of(spark, two, passage, passage) == [two, passage, ""]
    short = [line(f"s{i}x", 7) for i in range(9)]
    owners = short[1::2]  # every other line stands alone in an earlier document
    assert left_of(spark, *owners, "\n".join(short), "\n".join(["own", *short, "end"]))[-2:] == ["\n".join(short), "own\nend"]


def test_blocks_across_blank_lines(spark):
    one, two = line("a", 20), line("b", 20)
    passage = f"{one}\n\n{two}"
    assert left_of(spark, passage, f"own\n{one}\n \n\n{two}\n\nend") == [passage, "own\n\nend"]


def test_repeated_and_moved_blocks(spark):
    single, block, other = line("u", 5), line("p", 60), "\n".join([line("q", 20), line("r", 20)])
    assert left_of(spark, f"{single}\n{block}", f"{single}\nx\n{block}\ny\n{block}")[1] == f"{single}\nx\ny"
    first = f"{other}\n{single}\n{block}"
    assert left_of(spark, first, f"{block}\nown\n{other}\nown\n{other}") == [first, "own\nown"]


def test_least_runs_cover_every_longer_block():
    draw = random.Random(1)
    for _ in range(200):
        words = [draw.randrange(1, 12) for _ in range(12)]
        runs = linededup.least_runs(list(range(12)), words, 30)
        assert all(sum(words[a : b + 1]) >= 30 for a, b in runs)
        for a in range(12):
            for b in range(a, 12):
                inside = {i for x, y in runs if a <= x and y <= b for i in range(x, y + 1)}
                assert inside == (set(range(a, b + 1)) if sum(words[a : b + 1]) >= 30 else set())


def plain_left(texts, least=30):
    """What is left of each text when every stretch of lines that an earlier one holds goes, by comparing all stretches."""
    rows = [[x.strip() for x in t.split("\n") if x.strip()] for t in texts]
    out = []
    for k, own in enumerate(rows):
        gone = set()
        for other in rows[:k]:
            stretches = {tuple(other[a:b]) for a in range(len(other)) for b in range(a + 1, len(other) + 1)}
            for a in range(len(own)):
                for b in range(a + 1, len(own) + 1):
                    if tuple(own[a:b]) in stretches and sum(len(x.split()) for x in own[a:b]) >= least:
                        gone.update(range(a, b))
        out.append([x for i, x in enumerate(own) if i not in gone])
    return out


def test_blocks_of_random_documents_as_brute_force(spark):
    draw = random.Random(8)
    lines = [line(f"l{k}_", n) for k, n in enumerate((3, 5, 8, 8, 12, 15, 15, 20, 31, 40))]
    texts = []
    for _ in range(60):
        own = [draw.choice(lines) for _ in range(draw.randrange(1, 9))]
        if texts and draw.random() < 0.5:
            other = draw.choice(texts).split("\n")
            a = draw.randrange(len(other))
            own[draw.randrange(len(own)) :] = other[a : a + draw.randrange(1, 6)]
        texts.append("\n".join(own))
    texts = list(dict.fromkeys(texts))
    assert [[x for x in t.split("\n") if x] for t in left_of(spark, *texts)] == plain_left(texts)


def test_neighbours_that_no_earlier_document_has_stay(spark):
    p, q, x, y = line("p", 20), line("q", 15), line("x", 5), line("y", 5)
    later = "\n".join([p, q, line("own", 7)])
    assert left_of(spark, "\n".join([p, x, q, y, q]), later)[1] == later


def test_blocks_name_their_places(spark):
    p, q = line("p", 31), line("q", 15)
    rows = spark.createDataFrame([(1, f"{q}\n{p}\n{q}"), (2, f"own\n{p}\n{q}\n{p}")], "doc_id long, text string")
    (got,) = linededup.aligned_blocks(rows).collect()
    assert (got.doc_id, got.cut, [(b.first, b.last, b.owner, b.there) for b in got.blocks]) == (2, [1, 2, 3], [(1, 2, 1, 1), (2, 3, 1, 0)])
