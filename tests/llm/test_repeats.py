import numpy as np
import pytest

from docloom.llm import repeats as R


def windows(found):
    """(window, anchor, hash) of everything found."""
    return {(s, a, h) for a, h, lo, hi in zip(*(x.tolist() for x in found)) for s in range(lo, hi + 1)}


@pytest.mark.parametrize("sizes", [[5000], [300, 4000, 100, 0, 50, 900], [199, 200, 201, 1500], [10]])
def test_every_window_has_its_least_gram(sizes, monkeypatch):
    rng = np.random.default_rng(0)
    data = rng.integers(97, 100, sum(sizes)).astype(np.uint8)
    off = np.cumsum([0, *sizes])
    symbols = R.byte_symbols(data)
    found = windows(R.anchors(symbols, off, 200, 64))
    h = R.gram_hashes(symbols, 64) | np.uint64(1) if len(data) >= 64 else []
    want = set()
    for a, b in zip(off, off[1:]):
        for s in range(a, b - 199):
            least = h[s : s + 137].min()
            want |= {(s, s + i, int(least)) for i in np.flatnonzero(h[s : s + 137] == least).tolist()}
    assert found == want
    for part in (256, 700):  # long texts in parts
        monkeypatch.setattr(R, "PART", part)
        assert windows(R.anchors(symbols, off, 200, 64)) == want


def test_hashes_of_ranges_do_not_depend_on_their_place(monkeypatch):
    data = np.frombuffer(b"one two  one\tthree two x" * 50, np.uint8)
    start, end, bounds = R.words_of(data, np.array([0, 500, len(data)]))
    h = R.range_hashes(R.byte_symbols(data), start, end)
    by = {}
    for a, b, x in zip(start, end, h):
        assert by.setdefault(data[a:b].tobytes(), x) == x
    assert len(set(by.values())) == len(by)
    monkeypatch.setattr(R, "PART", 100)
    assert (R.range_hashes(R.byte_symbols(data), start, end) == h).all()
    assert bounds[-1] == len(start) == sum(len(t.split()) for t in (data[:500].tobytes(), data[500:].tobytes()))
