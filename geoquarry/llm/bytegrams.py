"""Hashes of every q-gram of a byte string, and the places to anchor on, in numpy.

The kernels work on one flat buffer at a time; callers hand them pieces of at
most a few hundred kilobytes so that every temporary stays small.
"""

import numpy as np

_RNG = np.random.default_rng(20240611)
#: One random word per byte value, and odd multipliers for each doubling step; drawn once by a seeded rule.
_BYTES = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULS = _RNG.integers(0, 2**63, (64, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES_2 = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = np.uint64(29)


def _join(left, right, step):
    """Hash of two neighbouring grams from the hashes of the halves."""
    out = left * _MULS[step, 0]
    out ^= out >> _SHIFT
    out += right * _MULS[step, 1]
    out ^= out >> _SHIFT
    return out


def gram_hashes(data, q, second=False):
    """64-bit hash of ``data[i:i+q]`` for each start ``i``; ``data`` is a uint8 array.

    Halves are joined by doubling, so the cost is a few passes whatever ``q`` is.
    ``second`` gives an independent hash.
    """
    n = len(data) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base = 32 if second else 0
    power, width, done, have = (_BYTES_2 if second else _BYTES)[data], 1, None, 0
    step = base
    while True:
        if q & width:
            if done is None:
                done, have = power, width
            else:
                m = len(data) - have - width + 1
                done = _join(done[:m], power[have : have + m], step + 16)
                have += width
        if width * 2 > q:
            return done[:n] * _MULS[base + 15, 0]
        power = _join(power[:-width], power[width:], step)
        width, step = width * 2, step + 1


def sliding_min(values, width):
    """Minimum of each ``width`` neighbours, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return out if not rest else np.minimum(out[:-rest], out[rest:])
