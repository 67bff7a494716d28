"""Small numpy kernels over one block and its neighbours."""

from collections import Counter

import numpy as np
import pandas as pd


def neighbourhood(values, known, pick, radius=1):
    """Least (``pick=np.minimum``) or greatest value around each pixel of one or many images; pixels
    outside the image do not take part."""
    neutral = np.inf if pick is np.minimum else -np.inf
    edges = [(0, 0)] * (values.ndim - 2) + [(radius, radius)] * 2
    padded = np.pad(np.where(known, values, neutral), edges, constant_values=neutral)
    out = padded[..., radius:-radius, radius:-radius].copy()
    height, width = values.shape[-2:]
    for dy in range(2 * radius + 1):
        for dx in range(2 * radius + 1):
            out = pick(out, padded[..., dy : dy + height, dx : dx + width])
    return np.where(known, out, np.nan)


def sample(window, rows, cols):
    """Values at fractional window positions, weighted from four neighbours."""
    height, width = window.shape
    r0 = np.clip(np.floor(rows).astype(int), 0, height - 1)
    c0 = np.clip(np.floor(cols).astype(int), 0, width - 1)
    r1, c1 = np.minimum(r0 + 1, height - 1), np.minimum(c0 + 1, width - 1)
    wr, wc = (rows - r0)[:, None], (cols - c0)[None, :]
    grid = lambda r, c: window[np.ix_(r, c)]
    return (
        grid(r0, c0) * (1 - wr) * (1 - wc)
        + grid(r0, c1) * (1 - wr) * wc
        + grid(r1, c0) * wr * (1 - wc)
        + grid(r1, c1) * wr * wc
    )


def block_components(mask):
    """8-connected component number of each set pixel, the least flat index in it."""
    height, width = mask.shape
    far = height * width
    label = np.where(mask, np.arange(far).reshape(height, width), far)
    while True:
        padded = np.pad(label, 1, constant_values=far)
        least = label
        for dy in range(3):
            for dx in range(3):
                least = np.minimum(least, padded[dy : dy + height, dx : dx + width])
        least = np.where(mask, least, far)
        # follow each label to the label of the pixel it names
        flat = np.append(least.ravel(), far)
        least = flat[least]
        if np.array_equal(least, label):
            return label
        label = least


def lcs_length(a, b):
    """Longest common subsequence of two token lists, one machine-word row at a time."""
    where = {}
    for i, token in enumerate(a):
        where[token] = where.get(token, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for token in b:
        # a token that only the other text has changes nothing
        hit = row & where[token] if token in where else 0
        if not hit:
            continue
        row = ((row + hit) | (row - hit)) & full
    return len(a) - bin(row).count("1")


def gram_stats(pair, side, code, pairs, max_n):
    """N-gram overlap of many token pairs at once.

    ``code`` are token numbers, in order, with their ``pair`` and ``side`` (0 the
    reference, 1 the candidate), both ascending.  Per level and pair the candidate grams that
    occur in the reference, the same clipped by the reference count, and the candidate grams;
    then the unigram products ref.cand, ref.ref and cand.cand.  A gram of n tokens is the
    number of its first n - 1 tokens with the last one; numbers are dealt by hashing, not by sorting.
    """
    text = pair * 2 + side
    hits, clipped, total, products = (np.zeros((pairs, k), np.int64) for k in (max_n, max_n, max_n, 3))
    base = code.max(initial=0) + 1
    at, before, whose = np.arange(len(code)), pair, np.arange(pairs)
    for n in range(1, max_n + 1):
        if n > 1:
            # grams that go on by one token of the same text
            on = at + n - 1 < len(code)
            on[on] = text[at[on] + n - 1] == text[at[on]]
            at, before = at[on], gram[on]
        # a gram is numbered within its pair, so each number is one gram of one pair
        gram, keys = pd.factorize(before * base + code[at + n - 1])
        whose = whose[keys // base]
        r, c = (np.bincount(gram[side[at] == s], minlength=len(keys)) for s in (0, 1))
        for out, values in ((total, c), (hits, c * (r > 0)), (clipped, np.minimum(r, c))):
            out[:, n - 1] = np.bincount(whose, values, pairs)
        if n == 1:
            for k, values in enumerate((r * c, r * r, c * c)):
                products[:, k] = np.bincount(whose, values, pairs)
    return hits, clipped, total, products
