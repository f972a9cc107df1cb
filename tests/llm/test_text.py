"""Words, shingles and the split into pieces, against the patterns they stand for."""

import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from dissensus.llm import pretokens, words

WORD = re.compile(words.WORD_PATTERN)
SPLIT = regex.compile(public_tokenizers.PATTERN)


def plain_words(text):
    return WORD.findall(text.translate({i: i + 32 for i in range(65, 91)}))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAzZ09é中 \n-_.'", max_size=30) | st.none(), max_size=6))
def test_words_are_those_of_the_pattern(texts):
    w = words.word_hashes(texts)
    expected = [plain_words(t or "") for t in texts]
    assert np.diff(w.bounds).tolist() == [len(x) for x in expected]
    flat = [x for row in expected for x in row]
    by_hash = dict(zip(w.hashes.tolist(), flat))
    assert [by_hash[h] for h in w.hashes.tolist()] == flat
    assert len(set(flat)) == len(by_hash)


def test_shingles():
    w = words.word_hashes(["a b c d e f", "A B c d e", "a b", "", None, "b c d e f"])
    found, bounds = words.shingles(w)
    assert np.diff(bounds).tolist() == [2, 1, 1, 0, 0, 1]
    assert found[0] == found[2] and found[1] == found[4] and len(set(found.tolist())) == 3


def test_chunks_cover_all_rows():
    _, offsets = words.utf8(pa.array(["x" * 50, "", None, "y" * 500, "z"]))
    for limit in (1, 60, 10_000):
        parts = list(words.chunks(offsets, limit))
        assert [lo for lo, _ in parts] == [0, *[hi for _, hi in parts[:-1]]] and parts[-1][1] == 5


def pieces(texts):
    cp, bounds = pretokens.codepoints(texts)
    begin = pretokens.starts(cp, bounds)
    whole = "".join(texts)
    ends = [*begin[1:], len(whole)]
    out = [[] for _ in texts]
    for a, b in zip(begin, ends):
        out[int(np.searchsorted(bounds, a, side="right")) - 1].append(whole[a:b])
    return out


def test_pieces_are_those_of_the_pattern():
    rng = random.Random(3)
    parts = ["a", "s", "re", "ll", "'", "'s", "'ve", " ", "  ", "\n", "\t", "1", "²", "é", "!", "中", "　", "\x85", "d"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(20_000)]
    for text, found in zip(texts, pieces(texts)):
        assert found == SPLIT.findall(text), text


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=20), min_size=1, max_size=5))
def test_pieces_of_any_text(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert pieces(texts) == [SPLIT.findall(t) for t in texts]


def test_memo_survives_clearing():
    memo = pretokens.Memo(lambda ps: [[ord(c) for c in p] for p in ps], kept=5)
    texts = ["a bb c", "dd e f g", "a bb c", ""]
    for _ in range(3):
        coded = memo.texts(texts)
        assert [coded.ids[a:b].tolist() for a, b in zip(coded.bounds, coded.bounds[1:])] == [[ord(c) for c in t] for t in texts]


def thue_morse(n):
    """A word over a and b and its complement: polynomial hashes take them for one."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return word, word.translate({97: "b", 98: "a"})


def test_words_with_constructed_collisions():
    for n in (1024, 2048, 8192):
        w = words.word_hashes(list(thue_morse(n)))
        assert len(set(w.hashes.tolist())) == 2


def test_a_memo_tells_pieces_of_one_hash_apart():
    encode = lambda pieces: [[len(p), *map(ord, p[:3])] for p in pieces]
    kept = pretokens.Memo(encode)
    for n in (1024, 2048):
        word, other = thue_morse(n)
        for texts in ([word, other], [word + " x " + other, other, "", word], [other], ["a b", word]):
            for memo in (pretokens.Memo(encode), kept):
                coded = memo.texts(texts)
                for i, t in enumerate(texts):
                    expected = [x for p in SPLIT.findall(t) for x in encode([p])[0]]
                    assert coded.ids[coded.bounds[i] : coded.bounds[i + 1]].tolist() == expected
