"""Suffix arrays by induced sorting, and permuted longest-common-prefix arrays, in numpy.

Suffixes are classified as smaller or larger than their right neighbour. The leftmost-smaller (LMS) substrings are sorted by
inducing and named; if names repeat, the reduced text of names is sorted as a text of its own. From the sorted LMS suffixes
the larger-type and then the smaller-type suffixes are induced, each in one sweep over the buckets of their first letter;
a sweep moves whole buckets at a time, so its steps are array operations.

The reduced text has as many letters as names, so its buckets hold a few places each; there the sweeps go place by place, and
it is reduced again as long as names repeat.
"""

from __future__ import annotations

import numpy as np


def smaller_type(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one to its right; the end of the text counts as smallest letter."""
    n = len(t)
    step = np.append(np.sign(t[1:].astype(np.int32) - t[:-1].astype(np.int32)), -1)
    at = np.where(step != 0, np.arange(n), n)
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    return step[nearest] > 0


def _induce(t: np.ndarray, s_type: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """All suffixes in the order that the seeds, smaller-type suffixes in sorted order, induce.

    The sweep from the left places larger-type suffixes, the one from the right smaller-type ones; the seeds are dropped
    before the second.
    """
    n = len(t)
    letters = 256
    count = np.bincount(t, minlength=letters)
    head = np.cumsum(count) - count
    larger = np.bincount(t[~s_type], minlength=letters)
    sa = np.empty(n, np.int64)
    seed_letters = t[seeds]
    seed_at = np.searchsorted(seed_letters, np.arange(letters + 1))
    present = np.nonzero(count)[0].tolist()

    def place(found: np.ndarray, put) -> None:
        """Appends suffixes to the buckets of their letters, in order."""
        c = t[found]
        order = np.argsort(c, kind="stable")
        c, found = c[order], found[order]
        cut = np.nonzero(c[1:] != c[:-1])[0] + 1
        first = np.concatenate([[0], cut]).tolist()
        last = np.concatenate([cut, [len(c)]]).tolist()
        for a, b in zip(first, last, strict=True):
            put(int(c[a]), found[a:b])

    filled = [0] * letters

    def put_left(c: int, part: np.ndarray) -> None:
        at = head[c] + filled[c]
        sa[at : at + len(part)] = part
        filled[c] += len(part)

    def from_left(part: np.ndarray) -> None:
        found = part[part > 0] - 1
        found = found[~s_type[found]]
        if len(found):
            place(found, put_left)

    from_left(np.array([n]))
    for c in present:
        done = 0
        while done < filled[c]:
            part = sa[head[c] + done : head[c] + filled[c]].copy()
            done = filled[c]
            from_left(part)
        from_left(seeds[seed_at[c] : seed_at[c + 1]])

    tail = np.cumsum(count)
    taken = [0] * letters

    def put_right(c: int, part: np.ndarray) -> None:
        at = tail[c] - taken[c]
        sa[at - len(part) : at] = part[::-1]
        taken[c] += len(part)

    def from_right(part: np.ndarray) -> None:
        """part: in falling order."""
        found = part[part > 0] - 1
        found = found[s_type[found]]
        if len(found):
            place(found, put_right)

    for c in reversed(present):
        done = 0
        while done < taken[c]:
            part = sa[tail[c] - taken[c] : tail[c] - done][::-1].copy()
            done = taken[c]
            from_right(part)
        from_right(sa[head[c] : head[c] + larger[c]][::-1])
    return sa


def _names(t: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Name (from 0, by rank) of each LMS substring, given in text order; order: LMS positions by sorted substring."""
    n = len(t)
    length = np.append(np.diff(lms), n - lms[-1]) + 1  # with the first letter of the next one; the last runs to the end
    of = np.empty(n, np.int64)
    of[lms] = length
    a, b = order[:-1], order[1:]
    differs = of[a] != of[b]
    at_end = (a == lms[-1]) | (b == lms[-1])
    differs |= at_end
    live = np.nonzero(~differs)[0]
    x, y, left = a[live], b[live], of[a[live]]
    k = 0
    while len(live):
        apart = t[x + k] != t[y + k]
        differs[live[apart]] = True
        k += 1
        on = ~apart & (left > k)
        live, x, y, left = live[on], x[on], y[on], left[on]
    rank = np.empty(n, np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(differs)])
    return rank[lms]


def _sorted_names(names: np.ndarray) -> np.ndarray:
    """Suffix order of the reduced text (names from 0 without gaps), by the same steps one level down.

    Its letters are many and their buckets small, so the sweeps go by single places, over bucket ends by name. The text is
    closed by a letter of its own below all others, whose suffix is dropped at the end.
    """
    n = len(names) + 1
    text = np.append(names.astype(np.int64) + 1, 0)
    letter = text.tolist()
    s_type = np.append(smaller_type(text[:-1]), True)
    small = s_type.tolist()
    ends = np.cumsum(np.bincount(text))
    heads, tails = np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist()
    lms = np.nonzero(s_type[1:] & ~s_type[:-1])[0] + 1

    def swept(seeds: list[int]) -> list[int]:
        sa = [-1] * n
        at = tails.copy()
        for i in reversed(seeds):
            c = letter[i]
            at[c] -= 1
            sa[at[c]] = i
        at = heads.copy()
        for p in range(n):
            i = sa[p] - 1
            if i >= 0 and not small[i]:
                c = letter[i]
                sa[at[c]] = i
                at[c] += 1
        at = tails.copy()
        for p in range(n - 1, -1, -1):
            i = sa[p] - 1
            if i >= 0 and small[i]:
                c = letter[i]
                at[c] -= 1
                sa[at[c]] = i
        sa[0] = n - 1
        return sa

    order = np.array(swept(lms.tolist()))
    if len(lms) > 1:
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        again = _names(text, lms, order[is_lms[order]])
        if again.max() + 1 < len(lms):
            order = np.array(swept(lms[_sorted_names(again)].tolist()))
        else:
            seeds = np.empty(len(lms), np.int64)
            seeds[again] = lms
            order = np.array(swept(seeds.tolist()))
    return order[1:]


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes of a byte text (uint8), in order."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    s_type = smaller_type(t)
    lms = np.nonzero(s_type[1:] & ~s_type[:-1])[0] + 1
    if len(lms) == 0:
        return _induce(t, s_type, lms)
    by_letter = lms[np.argsort(t[lms], kind="stable")]
    first = _induce(t, s_type, by_letter)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    names = _names(t, lms, first[is_lms[first]])
    if names.max() + 1 < len(lms):
        return _induce(t, s_type, lms[_sorted_names(names)])
    seeds = np.empty(len(lms), np.int64)
    seeds[names] = lms
    return _induce(t, s_type, seeds)


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each suffix of the array, the length it shares with the one before it (0 for the first).

    In text order a value is the one to its left less 1, unless the letters before the two suffixes differ; only those
    irreducible ones are counted letter by letter (eight at a time), and their lengths add up to n log n at most.
    """
    n = len(t)
    if n == 0:
        return np.zeros(0, np.int64)
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    i = np.arange(n)
    fixed = (i == 0) | (before <= 0)
    rest = np.nonzero(~fixed)[0]
    fixed[rest] = t[rest - 1] != t[before[rest] - 1]
    start = np.nonzero(fixed)[0]
    value = np.zeros(n, np.int64)
    wide = np.concatenate([t, np.zeros(16, np.uint8)])
    words = np.lib.stride_tricks.as_strided(wide, (n + 8, 8), (1, 1))
    live = start[before[start] >= 0]
    x, y = live.copy(), before[live]
    while len(live):
        far = np.maximum(x, y)
        same = words[np.minimum(x, n)] == words[np.minimum(y, n)]
        lead = np.where(same.all(axis=1), 8, same.argmin(axis=1))
        lead = np.minimum(lead, n - far)
        value[live] += lead
        on = (lead == 8) & (far + 8 < n)
        live, x, y = live[on], x[on] + 8, y[on] + 8
    last = np.maximum.accumulate(np.where(fixed, i, -1))
    plcp = value[last] - (i - last)
    return plcp[sa]
