"""Suffix arrays by induced sorting, and permuted longest common prefixes, on numpy arrays.

The steps are those of SA-IS (Nong, Zhang and Chan, 2009), worked bucket by bucket instead of suffix by suffix: all that a
bucket has so far induces in one vector operation, and only runs of one symbol take further rounds. Prefixes are
computed in text order (Kaerkkaeinen, Manzini and Puglisi, 2009): only irreducible ones are compared.
"""

from __future__ import annotations

import numpy as np

#: The recursion goes on by bucket while buckets hold so many suffixes on average; below, by doubling of ranks.
LEAST_PER_BUCKET = 64


def _smaller(text: np.ndarray) -> np.ndarray:
    """Is each suffix smaller than the next one? The last one, before the end that sorts below all, is not."""
    n = len(text)
    out = np.zeros(n, bool)
    differs = np.flatnonzero(text[1:] != text[:-1])
    # Each suffix goes with the next place at which the symbol changes.
    at = np.searchsorted(differs, np.arange(n))
    inside = at < len(differs)
    place = differs[at[inside]]
    out[inside] = text[place] < text[place + 1]
    return out


def _induce(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The array of all suffixes induced from ``seeds``: leftmost-smaller suffixes in their order."""
    n, used = len(text), np.flatnonzero(counts)
    ends = np.cumsum(counts)
    heads = ends - counts
    sa = np.full(n, -1, np.int64)
    larger_at = heads.copy()

    def put(suffixes: np.ndarray, at: np.ndarray, step: int) -> None:
        """File suffixes, in order, at the next free places of their buckets, upwards or downwards."""
        symbol = text[suffixes]
        order = np.argsort(symbol, kind="stable")
        symbol, suffixes = symbol[order], suffixes[order]
        first = np.flatnonzero(np.r_[True, symbol[1:] != symbol[:-1]])
        size = np.diff(np.r_[first, len(symbol)])
        k = np.arange(len(symbol)) - np.repeat(first, size)
        sa[at[symbol] + step * k] = suffixes
        at[symbol[first]] += step * size

    # Seeds by bucket: their order is the one within a bucket, too.
    order = np.argsort(text[seeds], kind="stable")
    seeds = seeds[order]
    seed_ends = np.cumsum(np.bincount(text[seeds], minlength=len(counts)))
    seed_from = seed_ends - np.bincount(text[seeds], minlength=len(counts))
    put(np.array([n - 1]), larger_at, 1)  # the last suffix is larger than the end, which stands before everything
    for c in used.tolist():
        done = heads[c]
        while done < larger_at[c]:
            batch = sa[done : larger_at[c]]
            done += len(batch)
            before = batch[batch > 0] - 1
            before = before[~small[before]]
            if len(before):
                put(before, larger_at, 1)
        batch = seeds[seed_from[c] : seed_ends[c]]
        before = batch[batch > 0] - 1
        before = before[~small[before]]
        if len(before):
            put(before, larger_at, 1)
    smaller_at = ends - 1
    for c in used[::-1].tolist():
        done = ends[c] - 1
        while done > smaller_at[c]:
            batch = sa[smaller_at[c] + 1 : done + 1][::-1]
            done -= len(batch)
            before = batch[batch > 0] - 1
            before = before[small[before]]
            if len(before):
                put(before, smaller_at, -1)
        batch = sa[heads[c] : larger_at[c]][::-1]
        before = batch[batch > 0] - 1
        before = before[small[before]]
        if len(before):
            put(before, smaller_at, -1)
    return sa


def _by_doubling(names: np.ndarray) -> np.ndarray:
    """The order of all suffixes by ranks of prefixes that double in length, for texts over very many symbols."""
    n, step, rank = len(names), 1, names.astype(np.int64)
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.r_[0, np.cumsum(key[1:] != key[:-1])]
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1 or step >= n:
            return order
        step *= 2


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """Starts of all suffixes of ``text`` (0 to ``symbols`` - 1) in ascending order; a suffix sorts below what extends it."""
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    # Small types: numpy sorts them by radix.
    text = text.astype(np.uint8 if symbols <= 256 else np.uint16 if symbols <= 65536 else np.int64)
    counts = np.bincount(text, minlength=symbols)
    small = _smaller(text)
    seeds = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if not len(seeds):
        return _induce(text, small, seeds, counts)
    sa = _induce(text, small, seeds, counts)
    is_seed = np.zeros(n, bool)
    is_seed[seeds] = True
    listed = sa[is_seed[sa]]  # leftmost-smaller substrings in order, equal ones next to each other
    follows = np.r_[seeds[1:], n]
    length = np.zeros(n, np.int64)
    length[seeds] = np.minimum(follows + 1, n) - seeds  # up to the next one, which counts
    a, b = listed[:-1], listed[1:]
    # The last substring ends with the text itself: nothing equals it.
    differ = (length[a] != length[b]) | (a == seeds[-1]) | (b == seeds[-1])
    live, k = np.flatnonzero(~differ), 0
    while len(live):
        other = text[a[live] + k] != text[b[live] + k]
        differ[live[other]] = True
        live, k = live[~other], k + 1
        live = live[k < length[a[live]]]
    name = np.empty(n, np.int64)
    name[listed] = np.r_[0, np.cumsum(differ)]
    reduced = name[seeds]
    kinds = int(reduced.max()) + 1
    if kinds == len(seeds):
        order = np.empty(kinds, np.int64)
        order[reduced] = np.arange(kinds)
    elif kinds * LEAST_PER_BUCKET <= len(seeds):
        order = suffix_array(reduced, kinds)
    else:
        order = _by_doubling(reduced)
    return _induce(text, small, seeds[order], counts)


def permuted_prefixes(text: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(prefix, phi) in text order: phi is the suffix before each in the array (-1: none), prefix what they share."""
    n = len(text)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    at = np.arange(n)
    # Reducible: the symbols before agree, so the prefix is that of the suffix before, less one.
    reducible = np.zeros(n, bool)
    ok = (at > 0) & (phi > 0)
    reducible[ok] = text[at[ok] - 1] == text[phi[ok] - 1]
    start = np.flatnonzero(~reducible)
    prefix = np.zeros(n, np.int64)
    live = start[phi[start] >= 0]
    other = phi[live]
    same = np.zeros(len(live), np.int64)
    index = np.arange(len(live))
    while len(index):
        i, j = live[index] + same[index], other[index] + same[index]
        inside = np.maximum(i, j) < n
        index, i, j = index[inside], i[inside], j[inside]
        index = index[text[i] == text[j]]
        same[index] += 1
    prefix[live] = same
    last = start[np.cumsum(~reducible) - 1] if n else start
    return np.maximum(prefix[last] - (at - last), 0), phi
