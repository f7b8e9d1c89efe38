"""Suffix arrays of linear grouping against sorting."""

from hypothesis import given, settings
from hypothesis import strategies as st

from sheafcalc.llm.lyndon import suffix_array


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=40))
def test_order(s):
    ends = [i for i, c in enumerate(s) if c == 0] + [len(s)]
    end = lambda i: next(e for e in ends if e >= i)
    key = lambda i: [(c, 0) for c in s[i : end(i)]] + [(0, end(i))]
    assert suffix_array(s) == sorted((i for i in range(len(s)) if s[i]), key=key)
