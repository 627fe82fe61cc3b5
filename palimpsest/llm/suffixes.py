"""Suffix arrays by induced sorting, in numpy, and permuted longest common prefixes.

``suffix_array`` classifies suffixes, sorts the substrings between leftmost-smaller (LMS) positions by
induction, names them, sorts the shorter string of names recursively, and induces the whole array from
that. Over a small alphabet both inductions go bucket by bucket: everything that one bucket puts into
others is placed in a few array operations, and only runs of one character take further rounds. The
strings of names, over large alphabets, take a stretch of the array at a time instead.
"""

from __future__ import annotations

import numpy as np

_SMALL_ALPHABET = 1024
#: Strings shorter than this are sorted by a plain loop.
_SHORT = 2_000


def _types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one (S type); the last, a unique least symbol, is."""
    n = len(text)
    step = np.diff(text)
    decided = np.where(step != 0, np.arange(n - 1), n)
    upcoming = np.minimum.accumulate(decided[::-1])[::-1]
    out = np.ones(n, bool)
    out[:-1] = step[np.minimum(upcoming, n - 2)] > 0
    return out


def _put(array: np.ndarray, at: np.ndarray, suffixes: np.ndarray, symbols: np.ndarray, sign: int) -> None:
    """Place suffixes, in order, at their symbols' pointers, which move by ``sign`` with each."""
    order = np.argsort(symbols, kind="stable")
    symbols, suffixes = symbols[order], suffixes[order]
    first = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
    count = np.diff(np.concatenate([first, [len(symbols)]]))
    rank = np.arange(len(symbols)) - np.repeat(first, count)
    array[at[symbols] + sign * rank] = suffixes
    at[symbols[first]] += sign * count


def _induce(text: np.ndarray, s_type: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """The array that the LMS suffixes, given in order, induce."""
    n = len(text)
    count = np.bincount(text, minlength=size)
    end = np.cumsum(count)
    start = end - count
    l_count = np.bincount(text[~s_type], minlength=size)
    array = np.full(n, -1, np.int64)
    sorted_lms = lms[np.argsort(text[lms], kind="stable")]
    lms_at = np.concatenate([[0], np.cumsum(np.bincount(text[lms], minlength=size))])
    used = np.flatnonzero(count)

    at = start.copy()
    for c in used:
        done = start[c]
        while done < at[c]:  # L suffixes of this bucket; those that it puts into itself take another round
            wave = array[done : at[c]]
            done = at[c]
            _induced(array, at, text, wave, ~s_type, 1)
        _induced(array, at, text, sorted_lms[lms_at[c] : lms_at[c + 1]], ~s_type, 1)

    at = end - 1
    array_l_end = start + l_count
    for c in used[::-1]:
        done = end[c] - 1
        while done > at[c]:
            wave = array[at[c] + 1 : done + 1][::-1]
            done = at[c]
            _induced(array, at, text, wave, s_type, -1)
        _induced(array, at, text, array[start[c] : array_l_end[c]][::-1], s_type, -1)
    array[0] = n - 1  # the sentinel precedes everything and is induced by nothing
    return array


def _induced(array: np.ndarray, at: np.ndarray, text: np.ndarray, wave: np.ndarray, wanted: np.ndarray, sign: int) -> None:
    before = wave[wave > 0] - 1
    before = before[wanted[before]]
    if len(before):
        _put(array, at, before, text[before], sign)


def _same(text: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the substrings of these sizes at a and b are equal."""
    same, open_ = np.ones(len(a), bool), np.arange(len(a))
    offset = 0
    while len(open_):
        open_ = open_[size[open_] > offset]
        differ = text[a[open_] + offset] != text[b[open_] + offset]
        same[open_[differ]] = False
        open_ = open_[~differ]
        offset += 1
    return same


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of a string of integers that ends in a unique least symbol 0."""
    text = np.ascontiguousarray(text, np.int64)
    n, size = len(text), int(text.max()) + 1
    if n == 1:
        return np.zeros(1, np.int64)
    if n < _SHORT:
        return np.array(_plain(text.tolist(), size), np.int64)
    induce = _induce if size <= _SMALL_ALPHABET else _induce_wide
    s_type = _types(text)
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    if len(lms) == 1:
        return induce(text, s_type, lms, size)
    array = induce(text, s_type, lms, size)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = array[is_lms[array]]
    length = np.zeros(n, np.int64)
    length[lms[:-1]] = np.diff(lms) + 1
    length[lms[-1]] = 1
    a, b = ordered[:-1], ordered[1:]
    equal = length[a] == length[b]
    equal[equal] = _same(text, a[equal], b[equal], length[a[equal]])
    name = np.zeros(n, np.int64)
    name[ordered] = np.concatenate([[0], np.cumsum(~equal)])
    names = name[lms]
    if names.max() + 1 == len(lms):
        order = ordered
    else:
        order = lms[suffix_array(names)]
    return induce(text, s_type, order, size)


def _induce_wide(text: np.ndarray, s_type: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """``_induce`` for large alphabets: a stretch of the array at a time.

    A stretch is cut before the first place that it would itself fill, so what it places lies beyond it.
    """
    n = len(text)
    count = np.bincount(text, minlength=size)
    end = np.cumsum(count)
    start = end - count
    l_type = ~s_type
    array = np.full(n, -1, np.int64)
    by_symbol = lms[np.argsort(text[lms], kind="stable")]
    own = np.bincount(text[lms], minlength=size)
    array[np.repeat(end - np.cumsum(own), own) + np.arange(len(lms))] = by_symbol

    def sweep(at: np.ndarray, wanted: np.ndarray, sign: int) -> None:
        done, stretch = 0, 256
        while done < n:
            width = min(stretch, n - done)
            wave = array[done : done + width] if sign > 0 else array[n - done - width : n - done][::-1]
            source = np.flatnonzero(wave > 0)
            before = wave[source] - 1
            mine = wanted[before]
            source, before = source[mine], before[mine]
            if len(before):
                symbols = text[before]
                order = np.argsort(symbols, kind="stable")
                ordered = symbols[order]
                first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
                sizes = np.diff(np.concatenate([first, [len(ordered)]]))
                rank = np.arange(len(ordered)) - np.repeat(first, sizes)
                place = at[ordered] + sign * rank
                depth = place - done if sign > 0 else n - 1 - done - place
                nearest = int(depth.min())
                if nearest < width:
                    width = nearest
                    keep = source[order] < width
                    order, ordered, place = order[keep], ordered[keep], place[keep]
                    if len(ordered):
                        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
                        sizes = np.diff(np.concatenate([first, [len(ordered)]]))
                    else:
                        first = sizes = np.zeros(0, np.int64)
                    stretch = max(64, width)
                else:
                    stretch = min(2 * stretch, 1 << 16)
                array[place] = before[order]
                at[ordered[first]] += sign * sizes
            else:
                stretch = min(2 * stretch, 1 << 16)
            done += width

    sweep(start.copy(), l_type, 1)
    sweep(end - 1, s_type, -1)
    array[0] = n - 1
    return array


def _plain(t: list[int], size: int) -> list[int]:
    """The same algorithm as a loop, for short strings."""
    n = len(t)
    s = [False] * n
    s[-1] = True
    for i in range(n - 2, -1, -1):
        s[i] = t[i] < t[i + 1] or (t[i] == t[i + 1] and s[i + 1])
    lms = [i for i in range(1, n) if s[i] and not s[i - 1]]
    count = [0] * size
    for c in t:
        count[c] += 1
    start, total = [0] * size, 0
    for c in range(size):
        start[c] = total
        total += count[c]

    def induce(order: list[int]) -> list[int]:
        array = [-1] * n
        at = [start[c] + count[c] for c in range(size)]
        for i in reversed(order):
            c = t[i]
            at[c] -= 1
            array[at[c]] = i
        at = start.copy()
        for k in range(n):
            j = array[k] - 1
            if j >= 0 and not s[j]:
                c = t[j]
                array[at[c]] = j
                at[c] += 1
        at = [start[c] + count[c] for c in range(size)]
        for k in range(n - 1, -1, -1):
            j = array[k] - 1
            if j >= 0 and s[j]:
                c = t[j]
                at[c] -= 1
                array[at[c]] = j
        array[0] = n - 1
        return array

    array = induce(lms)
    if len(lms) <= 1:
        return array
    end = {i: j for i, j in zip(lms, [*lms[1:], n - 1], strict=True)}
    name, names, last = [-1] * n, 0, -1
    for i in array:
        if i > 0 and s[i] and not s[i - 1]:
            if last >= 0 and t[last : end[last] + 1] != t[i : end[i] + 1]:
                names += 1
            name[i], last = names, i
    shorter = [name[i] for i in lms]
    order = [lms[i] for i in _plain(shorter, names + 1)] if names + 1 < len(lms) else sorted(lms, key=name.__getitem__)
    return induce(order)


def common_prefixes(text: np.ndarray, array: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """For each position, what its suffix shares with the one before it in the array, ``limit`` at most.

    limit is the distance to the end of the piece that the position lies in. Where the symbols before the
    two suffixes agree, the value is that of the position before less one; only the others are compared.
    """
    n = len(text)
    earlier = np.full(n, -1)
    earlier[array[1:]] = array[:-1]
    position = np.arange(n)
    free = np.ones(n, bool)
    free[1:] = (earlier[:-1] < 0) | (earlier[1:] != earlier[:-1] + 1) | (text[:-1] != text[earlier[:-1]]) | (limit[:-1] == 0)
    word = np.concatenate([text, np.zeros(4, text.dtype)]).astype(np.uint64)
    word = word[:-1] | word[1:] << np.uint64(16)
    word = word[:-2] | word[2:] << np.uint64(32)  # four symbols, the first one lowest
    value = np.zeros(n, np.int64)
    open_ = position[free & (earlier >= 0)]
    while len(open_):
        a, b = open_ + value[open_], earlier[open_] + value[open_]
        inside = (value[open_] < limit[open_]) & (b < n)
        open_, a, b = open_[inside], a[inside], b[inside]
        differ = word[a] ^ word[b]
        whole = differ == 0
        step = np.full(len(open_), 4)
        lowest = differ[~whole] & (~differ[~whole] + np.uint64(1))
        step[~whole] = np.log2(lowest.astype(np.float64)).astype(np.int64) // 16
        value[open_] += step
        open_ = open_[whole]
    value = np.minimum(value, limit)
    anchor = np.maximum.accumulate(np.where(free, position, 0))
    return np.maximum(np.minimum(value[anchor] - (position - anchor), limit), 0)
