"""Lengths that never fit together: open windows stay within their bound, nothing is lost or padded."""

from lodestone.llm.packing import SumOfSquares


def test_open_windows_are_bounded():
    bins, out, most = SumOfSquares(2048, most_open=100_000, cut=lambda item, start: (item, start)), [], 0
    for i in range(5000):
        out += bins.put(i, 1025 + 2048 * (i % 50 == 0))
        most = max(most, bins.held)
    assert most <= 100_000 and len(out) > 4000
    out += bins.flush()
    seen, fills = {}, {}
    for item, start, n, window, at in out:
        item = item[0] if isinstance(item, tuple) else item
        seen.setdefault(item, []).append((start, n))
        fills.setdefault(window, []).append((at, n))
    for i in range(5000):
        at = 0
        for start, n in sorted(seen[i]):
            assert start == at
            at += n
        assert at == 1025 + 2048 * (i % 50 == 0)
    for pieces in fills.values():
        at = 0
        for start, n in sorted(pieces):
            assert start == at
            at += n
        assert at == 2048 or at & (at - 1) == 0  # no padding
