import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.textops import buffers, sequence_ids, shingles, word_hashes, words

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbB \n\té", max_size=30)), max_size=8)


def split(text):
    return (text or "").encode().lower().split()


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_are_those_of_bytes_split(texts):
    low, starts, ends, ptr = words(*buffers(pa.array(texts, pa.string())))
    found = [low[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    assert [found[a:b] for a, b in zip(ptr[:-1], ptr[1:], strict=True)] == [split(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_hashes_tell_words_and_not_places(texts):
    low, starts, ends, ptr = words(*buffers(pa.array(texts, pa.string())))
    seen = {}
    for h, a, b in zip(word_hashes(low, starts, ends).tolist(), starts, ends, strict=True):
        assert seen.setdefault(low[a:b].tobytes(), h) == h
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 4))
def test_shingles_are_runs_of_words(texts, k):
    low, starts, ends, ptr = words(*buffers(pa.array(texts, pa.string())))
    found, at = shingles(word_hashes(low, starts, ends), ptr, k)
    seen = {}
    for text, a, b in zip(texts, at[:-1], at[1:], strict=True):
        w = split(text)
        runs = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] if w else []
        assert len(runs) == b - a
        for run, h in zip(runs, found[a:b].tolist(), strict=True):
            assert seen.setdefault(run, h) == h
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_sequence_ids_tell_sequences(texts):
    low, starts, ends, ptr = words(*buffers(pa.array(texts, pa.string())))
    ids = list(zip(*(x.tolist() for x in sequence_ids(word_hashes(low, starts, ends), ptr)), strict=True))
    for a in range(len(texts)):
        for b in range(len(texts)):
            assert (ids[a] == ids[b]) == (split(texts[a]) == split(texts[b]))


def test_a_word_longer_than_a_chunk():
    text = "x" * 700_000 + " y " + "x" * 700_000
    low, starts, ends, _ = words(*buffers(pa.array([text])))
    h = word_hashes(low, starts, ends)
    assert len(h) == 3 and h[0] == h[2] != h[1]


def test_a_sliced_column():
    column = pa.array(["a b", None, "c", "d e"]).slice(1, 3)
    low, starts, ends, ptr = words(*buffers(column))
    assert np.diff(ptr).tolist() == [0, 1, 2] and low[starts[0] : ends[0]].tobytes() == b"c"


def test_vector_forms_agree_with_the_tables():
    from tidemark.llm.textops import LOWER, SPACE, blanks, lowered

    every = np.arange(256, dtype=np.uint8)
    assert (lowered(every) == LOWER).all() and (blanks(every) == SPACE).all()
