import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from roadweave.llm.textbytes import chunks, shingles

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t ", max_size=30)), max_size=12)


def words(text):
    return [w for w in "".join(" " if c in "\t\n\r\x0b\x0c" else c for c in text or "").split(" ") if w]


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 40))
def test_words_and_hashes_do_not_depend_on_place(texts, size):
    seen = {}
    for c in chunks(pa.array(texts, pa.string()), size):
        starts, ends, doc = c.words
        h = c.hashes(starts, ends)
        for i in range(c.n):
            own = [bytes(c.buf[a:b]).decode() for a, b, d in zip(starts, ends, doc) if d == i]
            assert own == words(texts[c.lo + i])
        for a, b, x in zip(starts, ends, h.tolist()):
            assert seen.setdefault(bytes(c.buf[a:b]), x) == x
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_shingles_are_the_distinct_word_tuples(texts):
    hashes = {}
    for c in chunks(pa.array(texts, pa.string()), 50):
        doc, h, count = shingles(c)
        for i in range(c.n):
            w = words(texts[c.lo + i])
            own = [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else []
            got = sorted(count[doc == i].tolist())
            assert got == sorted(np.unique([str(x) for x in own], return_counts=True)[1].tolist()) if own else got == []
            hashes.setdefault(tuple(sorted(set(own))), set()).add(tuple(h[doc == i].tolist()))
    assert all(len(v) == 1 for v in hashes.values())
