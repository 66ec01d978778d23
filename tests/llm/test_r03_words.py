"""The budget of op2: the few words that the pipeline's stage remembers are not those of the query."""

from skyledger.llm import packing, tokens


def test_a_query_remembers_as_many_words_as_it_asks_for():
    path = tokens.public_path(tokens.WORD_BPE)
    few, many = tokens.encoder(path, False, packing.STAGE_WORDS), tokens.encoder(path, False)
    assert (few.most_words, many.most_words) == (packing.STAGE_WORDS, None) and tokens.MOST_WORDS > packing.STAGE_WORDS
    assert tokens.encoder(path, False) is many


def test_words_of_a_slice_are_looked_up_by_whole_keys():
    path = tokens.public_path(tokens.BYTE_BPE)
    same = "x" * 23  # with its blank as long as a key
    texts = [f"{same} {same}a {same}b {same}a\n{same} {same}b", "a\0 a a\0\0 \0a\n\0\na", "Ünïcödewörterstraßenbahn слово слова 字\n字 字", "z " + "long" * 500 + " z.\nz, " + "long" * 500]
    for name, joins in ((tokens.BYTE_BPE, True), (tokens.WORD_BPE, False)):
        for most in (None, 5):
            e = tokens.WordEncoder(tokens.public_path(name), joins, most_words=most)
            for _ in range(2):
                assert e.encode(texts) == e._whole(texts)
            assert len(e.known) + len(e.long) <= (most or tokens.MOST_WORDS)
    many = tokens.WordEncoder(path, True)
    words = [f"w{i:x}" for i in range(30_000)]
    for at in range(0, len(words), 7000):  # the table grows between slices, and numbers stay
        part = [" ".join(words[max(0, at - 500) : at + 7000])]
        assert many.encode(part) == many._whole(part)
    assert 30_000 <= len(many.known) <= 30_010
