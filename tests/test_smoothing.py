import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from tapeworks.operators.recursive import smooth


def stepped(x, period, alpha):
    """The recurrence as it is defined, value by value."""
    out, known = [np.nan] * len(x), [k for k, v in enumerate(x) if v == v]
    if not known or len(x) - known[0] < period:
        return out
    head = x[known[0] : known[0] + period]
    gaps = any(v != v for v in head)
    at = known[0] if gaps else known[0] + period - 1
    value = x[at] if gaps else sum(head) / period
    for k in range(at, len(x)):
        value = value + alpha * (x[k] - value) if k > at and x[k] == x[k] else value
        out[k] = value
    return out


@given(st.lists(st.one_of(st.just(float("nan")), st.floats(-1e6, 1e6)), max_size=40), st.integers(1, 9))
def test_smoothing_equals_the_recurrence(values, period):
    x = np.array(values, dtype=float)
    np.testing.assert_allclose(smooth(x, period, 1 / period), stepped(x, period, 1 / period), rtol=1e-9, atol=1e-6)
