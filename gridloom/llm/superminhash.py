"""SuperMinHash signatures, vectorised over the documents of a batch."""

from __future__ import annotations

import numpy as np

from gridloom.llm.words import mix


def signatures(elements: np.ndarray, first: np.ndarray, slots: int) -> np.ndarray:
    """One row of `slots` 32-bit values for each set elements[first[i]:first[i + 1]] (64-bit hashes).

    In step j each element visits one slot, the j-th of its own permutation of the slots, with
    the value j + r, r being a fresh fraction; a slot keeps its least value. Later steps have
    larger values throughout, so a set is finished (the early stop) as soon as each of its
    slots has one. A permutation is offset + j * odd stride modulo the slots, a power of two.
    Two sets agree in a slot with the probability of their Jaccard similarity, because values
    of different elements in a slot are independent and alike. An empty set has zeros.
    """
    if slots & (slots - 1):
        raise ValueError("slots must be a power of two")
    sizes = np.diff(first)
    best = np.full((len(sizes), slots), np.uint64(0xFFFFFFFFFFFFFFFF))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    a = mix(elements ^ np.uint64(0x5851F42D4C957F2D))
    offset, stride = a & np.uint64(slots - 1), (a >> np.uint64(20)) | np.uint64(1)
    flat, base = best.reshape(-1), owner * slots
    active = np.arange(len(elements))
    with np.errstate(over="ignore"):
        for j in range(slots):
            e = elements[active]
            slot = (offset[active] + np.uint64(j) * stride[active]) & np.uint64(slots - 1)
            value = (mix(e + np.uint64(j + 1) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(8)) | np.uint64(j << 56)
            np.minimum.at(flat, base[active] + slot.astype(np.int64), value)
            open_ = (best == np.uint64(0xFFFFFFFFFFFFFFFF)).any(axis=1)
            active = active[open_[owner[active]]]
            if not len(active):
                break
    out = (mix(best) >> np.uint64(32)).astype(np.uint32)
    out[sizes == 0] = 0
    return out
