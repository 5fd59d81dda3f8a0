import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from docketry.llm._words import ALNUM, SPACED, Words, joined, sliced

FOLD = {i: i + 32 for i in range(65, 91)}
alphabet = st.text(alphabet="aAbZ09 é\t\n.,-_\x0b\x1f\x7fßİ 漢", max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), alphabet), max_size=6))
def test_words_are_those_of_the_patterns(texts):
    for kind, pattern in ((ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (SPACED, r"[^\x20\x09-\x0D]+")):
        w = Words(pa.array(texts, pa.string()), kind, {})
        seen = {}
        for i, t in enumerate(texts):
            want = re.findall(pattern, (t or "").translate(FOLD))
            got = [bytes(w.bytes[a:b]).decode() for a, b in zip(w.starts[w.first[i] : w.first[i + 1]], w.ends[w.first[i] : w.first[i + 1]])]
            assert got == want
            for word, h in zip(want, w.hashes[w.first[i] : w.first[i + 1]].tolist()):
                assert seen.setdefault(word, h) == h
        assert len(set(seen.values())) == len(seen)


def test_joined():
    words = np.arange(1, 8, dtype=np.uint64)
    assert len(joined(words, 5)) == 3 and len(joined(words[:3], 5)) == 1 and len(joined(words[:0], 5)) == 0
    assert joined(words[:5], 5)[0] == joined(words, 5)[0] != joined(words[:4], 5)[0]


def test_long_texts_are_not_cut():
    batch = pa.RecordBatch.from_arrays([pa.array(["a " * 2_000_000, None, "b"])], names=["text"])
    parts = list(sliced([batch]))
    assert sum(p.num_rows for p in parts) == 3 and len(Words(parts[0].column("text"), SPACED, {}).hashes) == 2_000_000
