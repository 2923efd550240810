import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from braidmill.llm import textops as t

from .helpers import alnum_words, odd_documents, space_words

RULES = [(t.SPACE_WORDS, space_words), (t.ALNUM_WORDS, alnum_words)]


def hashes(texts, table):
    data, offsets = t.string_buffers(pa.array(texts, pa.string()))
    s, e, h, first = t.words(data, offsets, table)
    spelled = [bytes(data[a:b]) for a, b in zip(s, e, strict=True)]
    return spelled, h, first


def check(texts):
    for table, plain in RULES:
        spelled, h, first = hashes(texts, table)
        for i, x in enumerate(texts):
            own = spelled[first[i] : first[i + 1]]
            assert [w.decode().translate({k: k + 32 for k in range(65, 91)}) for w in own] == plain(x)
        lowered = [w.lower() for w in spelled]
        assert len(set(lowered)) == len({(w, int(v)) for w, v in zip(lowered, h, strict=True)}) == len(set(h.tolist()))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("aAbZ09 \t\n.é中\x00-"), max_size=30)), max_size=8))
def test_words(texts):
    check(texts)


def test_words_over_segments(monkeypatch):
    monkeypatch.setattr(t, "SEGMENT", 64)
    check([x for _, x in odd_documents()][:40])
    check(["x" * 500, "", "y" * 70 + " z"])


def test_slices_and_large_strings():
    a = pa.array(["zz", "ab c", None, "d"], pa.large_string())[1:]
    data, offsets = t.string_buffers(a)
    assert bytes(data) == b"ab cd" and offsets.tolist() == [0, 4, 4, 5]
    assert t.string_buffers(pa.array([], pa.string()))[1].tolist() == [0]


def test_grams():
    h = np.arange(6, dtype=np.uint64)
    assert len(t.gram_hashes(h, 5)) == 2 and len(t.gram_hashes(h, 7)) == 0
    assert t.gram_hashes(h, 2)[0] != t.gram_hashes(h[::-1].copy(), 2)[-1]
