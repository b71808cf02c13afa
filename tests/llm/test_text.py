import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from brute import words
from incidentlens.llm import text as T

TEXTS = st.lists(st.none() | st.text(alphabet="aB é\t\n\x0b\x85\u00a0", max_size=12), max_size=8)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(1, 40))
def test_words_and_hashes(texts, limit):
    column = pa.array(texts, pa.string())
    found, hashes = [], []
    for part in T.slices(column, limit):
        w = T.words(part)
        hashes += w.hashes.tolist()
        for d in range(part.docs):
            at = range(w.first[d], w.first[d + 1])
            found.append([part.data[w.start[k]:w.end[k]].tobytes().decode() for k in at])
    assert found == [words(t) for t in texts]
    flat = [x for row in found for x in row]
    assert len(set(zip(flat, hashes))) == len(set(flat)) == len(set(hashes))
    assert T.word_counts(column).tolist() == [len(words(t)) for t in texts]


def test_grams_depend_on_words_alone():
    part = next(T.slices(pa.array(["a b c d", "x a b c", "A B C"])))
    w = T.words(part, T.LOWER)
    gram, whole = T.grams(w.hashes, w.first, 3)
    assert np.flatnonzero(whole).tolist() == [0, 1, 4, 5, 8]
    assert gram[0] == gram[5] == gram[8] != gram[1]


def test_sliced_arrays_and_long_texts():
    column = pa.array(["skip", "a b", None, "c " * 300_000, ""])[1:]
    assert T.word_counts(column).tolist() == [2, 0, 300_000, 0]
