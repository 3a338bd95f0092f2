"""Parts of the substring dedup that work on whole arrays."""

import numpy as np
import pyarrow as pa
from tidewheel.llm import substring_dedup as sd


def test_numbers_are_sorted_whether_or_not_places_fit():
    rng = np.random.default_rng(7)
    for top in (3, 1 << 40, 1 << 62):
        values = rng.integers(0, top, 500)
        order, in_order = sd._sorted(values)
        assert (in_order == np.sort(values)).all() and (values[order] == in_order).all()
        assert sorted(order.tolist()) == list(range(500))


def test_runs_of_windows_end_with_their_stretch():
    earlier = np.array([1, 1, 0, 1, 1, 1, 0, 0, 1, 1], bool)
    row, first, stop = sd._spans(earlier, np.array([4, 1, 3, 2]), 20)
    found = list(zip(row.tolist(), first.tolist(), stop.tolist()))
    assert found == [(0, 0, 21), (0, 3, 23), (1, 0, 20), (2, 0, 20), (3, 0, 21)]


def test_symbols_are_counted_by_digits_of_two_bits():
    rng = np.random.default_rng(9)
    symbols = rng.integers(0, 40, 300)
    wavelet = sd.WaveletMatrix(symbols, 6)
    at = rng.integers(0, 301, (2, 500))
    symbol = rng.integers(0, 40, 500)
    counted = wavelet.count(symbol, at) - wavelet.begin(symbol)
    expected = [[(symbols[:a] == s).sum() for a, s in zip(row, symbol)] for row in at]
    assert counted.tolist() == np.array(expected).tolist()
    # Half as many levels as bits: one look-up each.
    assert len(wavelet.levels) == 3


def test_words_are_no_objects():
    """No cache of words is held by a worker, and each was a call of Python."""
    assert not hasattr(sd, "WordHashes")
    lists = pa.array([[1, 2], None, [], [3]], pa.list_(pa.int64())).slice(1)
    assert sd._lengths(lists).tolist() == [0, 0, 1] and sd._flat(lists).tolist() == [3]
