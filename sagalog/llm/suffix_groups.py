"""Suffix arrays by grouping suffixes by their Lyndon prefixes, for many short texts side by side.

Phase 1 refines groups of suffixes in an array of intervals.  In every text the
highest group that is left is final.  The nearest earlier position that is not
yet taken is a member's previous smaller suffix; these parents have their known
prefix extended by the group's, once for each child, so they move to the end
of their interval, those with more children further up.  Phase 2 runs over the
suffix array from its smallest entry: the suffixes whose next smaller suffix is
that entry take the next free place of their groups.  Nothing is renamed or
recursed into.  Both phases take one step in all texts at once, so a step is a
few array operations whatever the number of texts.
"""

from __future__ import annotations

import numpy as np


def _spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each start and length."""
    total = int(length.sum())
    ends = np.cumsum(length)
    return np.arange(total) - np.repeat(ends - length - start, length)


def suffix_arrays(text: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Suffix arrays of texts that lie back to back; text k is text[begin[k]:begin[k + 1]], none empty.

    The result holds positions in ``text``; each text's suffixes stand in its
    own stretch, in ascending order, a suffix that is a prefix of another first.
    """
    n, texts = len(text), len(begin) - 1
    # a sentinel stands before each text, never taken, so that every position has an earlier one
    owner = np.repeat(np.arange(texts), np.diff(begin))
    shift = np.arange(n) + owner + 1
    first = begin[:-1] + np.arange(texts)  # sentinels
    size = n + texts
    left, right = np.arange(-1, size - 1), np.arange(1, size + 1)
    order = np.lexsort((text, owner))
    slot = order + owner[order] + 1  # array of intervals: holds shifted positions, indexed 0 .. n - 1
    place = np.zeros(size, np.int64)
    place[slot] = np.arange(n)
    cut = np.flatnonzero(np.concatenate([[True], (text[order][1:] != text[order][:-1]) | (owner[order][1:] != owner[order][:-1])]))
    group = np.zeros(size, np.int64)  # start of a suffix's interval
    group[slot] = np.repeat(cut, np.diff(np.append(cut, n)))
    end = np.zeros(n + 1, np.int64)  # end of the interval that starts here
    end[cut] = np.append(cut[1:], n)
    parent = np.full(size, -1)
    taken, isparent = np.zeros(size, bool), np.zeros(size, bool)
    top, floor = begin[1:].copy(), begin[:-1].copy()
    is_first = np.zeros(size + 1, bool)
    is_first[first] = True
    is_first[size] = True
    while True:
        live = top > floor
        if not live.all():
            top, floor = top[live], floor[live]
            if not len(top):
                break
        low = group[slot[top - 1]]
        at = _spread(low, top - low)
        top = low
        now = slot[at]
        taken[now] = True
        back, fore = left[now], right[now]
        while True:
            inner = taken[back] & ~is_first[back]
            if not inner.any():
                break
            back[inner] = left[back[inner]]
            left[now] = back
        while True:
            inner = ~is_first[fore]
            inner[inner] = taken[fore[inner]]
            if not inner.any():
                break
            fore[inner] = right[fore[inner]]
            right[now] = fore
        left[now], right[now] = back, fore
        ahead = fore < size
        left[fore[ahead]] = back[ahead]
        right[back] = fore
        has = ~is_first[back]
        parent[now] = np.where(has, back, -1)
        up = np.sort(back[has])
        if not len(up):
            continue
        new = np.flatnonzero(np.concatenate([[True], up[1:] != up[:-1]]))
        count = np.diff(np.append(new, len(up)))
        up = up[new]
        where = group[up]
        rank = np.lexsort((count, where))
        up, count, where = up[rank], count[rank], where[rank]
        head = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        many = np.diff(np.append(head, len(up)))
        start = where[head]
        stop = end[start]
        tail = _spread(stop - many, many)
        isparent[up] = True
        there = slot[tail]
        out = there[~isparent[there]]
        hole = place[up][place[up] < np.repeat(stop - many, many)]
        # both are in order of interval and equally many in each
        slot[hole] = out
        place[out] = hole
        slot[tail] = up
        place[up] = tail
        isparent[up] = False
        end[start] = stop - many
        sub = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | (count[1:] != count[:-1])]))
        ends = np.append(sub[1:], len(up))
        group[up] = np.repeat(tail[sub], ends - sub)
        end[tail[sub]] = tail[ends - 1] + 1
    # phase 2: entry 0 of a text follows from the end of the text, the smallest of all
    free = np.arange(n + 1)
    free = free.copy()
    out = np.full(n, -1)
    done = np.zeros(size, bool)
    cursor, limit = begin[:-1].copy(), begin[1:].copy()
    last = first + np.diff(begin)  # last position of each text
    chain = last.copy()
    while True:
        while len(chain):
            chain = chain[(chain >= 0)]
            chain = chain[~done[chain]]
            if not len(chain):
                break
            g = group[chain]
            out[free[g]] = chain
            free[g] += 1
            done[chain] = True
            chain = parent[chain]
        on = cursor < limit
        if not on.all():
            cursor, limit = cursor[on], limit[on]
        if not len(cursor):
            break
        entry = out[cursor]
        cursor = cursor + 1
        chain = entry - 1
        chain = np.where(is_first[chain], -1, chain)
    index = np.zeros(size, np.int64)
    index[shift] = np.arange(n)
    return index[out]
