"""Word hashes from bytes against words from text."""

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from ledgerlake.llm import words

SIGNS = st.text(st.sampled_from("aAbBzZÉéß \t\n\x0b\x0c\r\x1c\x85 |9"), max_size=40)


@pytest.mark.parametrize("chunk", [3, 2**21])
def test_hashes_depend_on_the_folded_word_alone(monkeypatch, chunk):
    monkeypatch.setattr(words, "CHUNK", chunk)
    known: dict[bytes, int] = {}

    @given(st.lists(st.none() | SIGNS, max_size=6))
    def check(texts):
        hashes, of_text, line = words.hashed_words(pa.array(["skipped", *texts], pa.string()).slice(1))
        found = [(k, m) for k, t in enumerate(texts) for m in words._WORD.finditer(t or "")]
        assert of_text.tolist() == [k for k, _ in found]
        assert line.tolist() == [texts[k][: m.start()].count("\n") for k, m in found]
        for (_, m), value in zip(found, hashes.tolist(), strict=True):
            assert known.setdefault(m.group().encode().lower(), value) == value
        assert len(set(known.values())) == len(known)

    check()
