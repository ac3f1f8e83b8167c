"""Vectorised word hashes against the words themselves."""

from hypothesis import given, settings
from hypothesis import strategies as st

from lemmaforge.llm.words import blank_word_hashes, blank_words

TEXT = st.text(alphabet="aAbé漢 \n\t\x0b\x0c\r\xa0\x85\x00", max_size=30) | st.none() | st.sampled_from(["x" * 64, "x" * 65, "y" * 65 + " x", "\xa0"])


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=8))
def test_hashes_follow_words(texts):
    values, counts = blank_word_hashes(texts)
    words = [blank_words(t) for t in texts]
    assert counts.tolist() == [len(w) for w in words]
    flat = [w for own in words for w in own]
    pairs = set(zip(flat, values.tolist()))
    assert len(pairs) == len({w for w, _ in pairs}) == len({v for _, v in pairs})
