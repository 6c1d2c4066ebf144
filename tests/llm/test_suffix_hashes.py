"""Open: different texts whose sums of powers are equal pass for copies of each other in op7_suffix."""

import random

import pytest

from foliospark.llm import suffix_dedup as m


def twins(rnd):
    """Two different texts of 256 bytes with the same sum of bytes' values times powers of the base, modulo 2**64.

    Two blocks whose sums agree in the low bits are laid out in Thue-Morse order, which multiplies the difference by powers of two.
    """
    seen = {}
    while True:
        block = bytes(rnd.choice(b"abcdefghijklmnopqrstuvwxyz") for _ in range(4))
        low = sum(int(m.SPREAD[c]) * pow(m.BASE, i, 1 << 64) for i, c in enumerate(block)) & ((1 << 25) - 1)
        other = seen.setdefault(low, block)
        if other != block:
            break
    one, two = block, other
    for _ in range(6):
        one, two = one + two, two + one
    return one.decode(), two.decode()


@pytest.mark.xfail(strict=True, reason="regions are told by 64-bit sums of powers, which made-up texts can share")
def test_equal_sums_are_no_copies():
    rnd = random.Random(3)
    one, two = twins(rnd)
    for _ in range(400):  # the two share their first 144 bytes, and rarely the anchor
        head = "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ ") for _ in range(144))
        (*_, anchor, text), (*_, other_anchor, other) = (m.regions([(head + end).encode()]) for end in (one, two))
        assert (anchor[0], text[0]) != (other_anchor[0], other[0])
