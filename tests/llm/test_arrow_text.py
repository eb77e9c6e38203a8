import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm.arrow_text import SPACE, grams, shingle_set, slices, words

TEXT = st.text(alphabet=st.sampled_from("aAbé \n\t日😀\x1f#"), max_size=40)


@given(st.lists(st.one_of(st.none(), TEXT), max_size=8), st.integers(1, 60))
@settings(max_examples=150, deadline=None)
def test_words_are_those_of_the_pattern(texts, most):
    seen = {}
    for part in slices(pa.array(texts, pa.string()), most):
        w = words(part)
        for r in range(part.rows):
            own = [bytes(part.data[a:b]).decode() for a, b in zip(w.start[w.first[r] : w.first[r + 1]], w.end[w.first[r] : w.first[r + 1]], strict=True)]
            assert own == re.findall(r"[^\x20\x09-\x0D]+", texts[part.first + r] or "")
            for x, h in zip(own, w.hash[w.first[r] : w.first[r + 1]].tolist(), strict=True):
                assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)


def test_lower_folds_ascii_only():
    h = [words(next(slices(pa.array([x]))), lower=True).hash for x in ("ABÉ", "abÉ", "abé")]
    assert h[0] == h[1] != h[2]


def test_shingles():
    h = np.arange(1, 7, dtype=np.uint64)
    assert len(grams(h, 3)) == 4 and len(shingle_set(h[:2], 3)) == 1 and len(shingle_set(h[:0], 3)) == 0
    assert shingle_set(h[:2], 3)[0] != shingle_set(h[:1], 3)[0]
    assert SPACE.sum() == 6
