"""Fast similarity sketching by rounds of hashed bin placement.

Round ``i`` of the first ``t`` sends every element to a hashed bin with the
value ``i + v``, ``v`` a hash in [0, 1); a bin keeps its least value.  Round
``t + i`` sends every element to bin ``i``, so that every bin fills.  Rounds end
as soon as all bins are full: a set of ``n`` elements takes about
``n + t log t`` placements instead of ``n * t``.  Two sketches agree in a bin
with the sets' Jaccard similarity as probability, with Chernoff-type bounds on
the share of agreeing bins.
"""

from __future__ import annotations

import numpy as np

from tidegauge.llm.shingles import U64, mix

#: Bands of four bins: a pair at a similarity of 0.75 shares none of 32 with probability 5e-6.
BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
_EMPTY = U64(2**64 - 1)
_LOW = U64((1 << 48) - 1)


def sketches(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """One row of bins per set: the round in the upper 16 bits, the hash below. Empty sets stay unfilled."""
    out = np.full(len(sets) * bins, _EMPTY)
    sizes = np.array([len(s) for s in sets], np.int64)
    if not sizes.sum():
        return out.reshape(len(sets), bins)
    elements = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    with np.errstate(over="ignore"):
        for i in range(2 * bins):
            h = mix(elements + U64(((i + 1) * 0xD1342543DE82EF95) & (2**64 - 1)))
            where = (h >> U64(48)).astype(np.int64) % bins if i < bins else i - bins
            np.minimum.at(out, owner * bins + where, (U64(i) << U64(48)) | (h & _LOW))
            full = (out.reshape(len(sets), bins) != _EMPTY).all(1)
            if full[owner].any():
                rest = ~full[owner]
                elements, owner = elements[rest], owner[rest]
                if not len(elements):
                    break
    return out.reshape(len(sets), bins)


def bands(values: np.ndarray, count: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A hash for each band of each sketch; the band's number is hashed in."""
    grid = values.reshape(len(values), count, rows)
    with np.errstate(over="ignore"):
        out = np.broadcast_to(np.arange(1, count + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15), (len(values), count))
        for k in range(rows):
            out = mix(out + grid[:, :, k])
    return out
