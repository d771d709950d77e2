import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from framefold.config import Settings, odd_kernel, slider_epsilon


def test_round_trip():
    made = Settings(stack_batch=20, colour=True)
    assert Settings.loaded(made.saved()) == made


@pytest.mark.parametrize("text", [None, "", "{", "[]", '{"stack_batch": 5}', '{"grid_size": "x"}'])
def test_any_fault_gives_defaults(text):
    assert Settings.loaded(text) == Settings()


@pytest.mark.parametrize("wrong", [{"stack_batch": 2}, {"grid_size": 3}, {"detector": "none"}, {"max_scale": 9.0}, {"stack_batch": 4, "stack_overlap": 4}])
def test_limits(wrong):
    with pytest.raises(ValueError):
        Settings(**wrong)


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 1000))
def test_odd(n):
    assert odd_kernel(n) % 2 == 1 and odd_kernel(n) - n in (0, 1)


def test_epsilon():
    assert slider_epsilon(-6) == pytest.approx(1e-6)
