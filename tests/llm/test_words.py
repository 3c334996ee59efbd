import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from faresight.llm.words import ALNUM, SPACED, Words, sequence_hashes

RX = ((ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (SPACED, r"[^\x20\x09-\x0D]+"))
TEXT = st.one_of(st.none(), st.text(st.sampled_from("aAzZ09 \t\n\x0b\x00_-é日😀\x7f\x80{`:/@["), max_size=40), st.text(max_size=20))


def expected(text, rx):
    return re.findall(rx, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_words_are_those_of_the_pattern(texts):
    for kind, rx in RX:
        w = Words(pa.array(texts, pa.string()), kind)
        seen = {}
        for i, t in enumerate(texts):
            got = [w.word(k).replace(b"\xff", b"\0").decode() for k in range(w.first[i], w.first[i + 1])]
            assert got == expected(t, rx)
        for h, k in zip(w.hashes().tolist(), range(len(w))):
            assert seen.setdefault(h, w.word(k)) == w.word(k)
        assert len(seen) == len({w.word(k) for k in range(len(w))})


def test_slices_and_long_words():
    texts = pa.array(["no", "x" * 3_000_000 + " y", "z", None])
    w = Words(texts[1:], SPACED)
    assert w.counts().tolist() == [2, 1, 0] and w.end[0] == 3_000_000
    alone = Words(pa.array(["x" * 3_000_000]), SPACED)
    assert w.hashes()[0] == alone.hashes()[0] and w.hashes()[2] == Words(pa.array(["z"]), SPACED).hashes()[0]


def test_sequences_depend_on_order():
    h = Words(pa.array(["a b c a b c b a"]), SPACED).hashes()
    s = sequence_hashes(h, 3)
    assert s[0] == s[3] and len(np.unique(s)) == 5 and len(sequence_hashes(h[:2], 3)) == 0
