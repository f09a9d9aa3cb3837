"""Hashed byte n-grams of whole texts as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

#: Texts are read in windows of so many bytes, which overlap by the longest n-gram: bounds memory, not what is read.
WINDOW = 1 << 22


def codes(data: bytes, orders: Iterable[int], bits: int) -> Iterable[np.ndarray]:
    """Arrays of the buckets (0 to 2**bits - 1) of all n-grams of the given orders, repeats included."""
    top = max(orders)
    for at in range(0, max(len(data), 1), WINDOW):
        b = np.frombuffer(data, np.uint8, min(WINDOW + top - 1, len(data) - at), at).astype(np.uint32)
        code = b + 1
        for n in range(1, top + 1):
            if n > 1:
                code = code[:-1] * np.uint32(0x01000193) ^ (b[n - 1 :] + 1)
            if n in orders:
                # grams of later windows start there; the overlap only completes those that start in this one
                own = code[: max(0, min(WINDOW, len(code)))]
                yield (own * np.uint32(0x9E3779B1) ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35) >> np.uint32(32 - bits)
