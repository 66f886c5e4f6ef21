"""Suffix array by grouping: linear construction from Lyndon-prefix groups."""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """Start positions of the suffixes of ``text`` (non-negative numbers) in order; a shorter suffix precedes its extensions.

    First the suffixes are grouped by the longest Lyndon word that begins them.
    Groups start as equal first symbols and are visited from the highest down.
    The previous smaller pointer of a suffix is the nearest earlier suffix of a
    lower group; a visited group lengthens the word of each suffix it points to
    by as many copies as point there, which splits the lower groups. Then the
    order is emitted from the smallest suffix on: each emitted suffix fixes the
    next place in the groups of the suffixes that precede it along these pointers.
    """
    n = len(text) + 1  # with an end mark below every symbol
    symbols = [x + 1 for x in text]
    symbols.append(0)
    counts: dict[int, int] = {}
    for x in symbols:
        counts[x] = counts.get(x, 0) + 1
    first, at = {}, 0
    end = [0] * n
    for x in sorted(counts):
        first[x] = at
        at += counts[x]
        end[first[x]] = at
    group = [first[x] for x in symbols]
    order, place, fill = [0] * n, [0] * n, dict(first)
    for i, x in enumerate(symbols):
        at = fill[x]
        order[at] = i
        place[i] = at
        fill[x] = at + 1

    previous = [-1] * n
    high = n
    while high > 0:
        low = group[order[high - 1]]
        members = order[low:high]
        if len(members) > 1:
            members.sort()
        copies: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= low:
                j = previous[j]
            previous[i] = j
            if j >= 0:
                copies[j] = copies.get(j, 0) + 1
        if len(copies) == 1:
            (j, _), = copies.items()
            _split([j], group, order, place, end)
        elif copies:
            by_count: dict[int, list[int]] = {}
            for j, c in copies.items():
                by_count.setdefault(c, []).append(j)
            for c in sorted(by_count, reverse=True):
                _split(by_count[c], group, order, place, end)
        high = low

    front = list(range(n))
    result = [0] * n
    result[0] = n - 1
    placed = bytearray(n)
    placed[n - 1] = 1
    for i in range(n):
        j = result[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            result[front[g]] = j
            front[g] += 1
            placed[j] = 1
            j = previous[j]
    return result[1:]


def _split(chosen: list[int], group: list[int], order: list[int], place: list[int], end: list[int]) -> None:
    """Move ``chosen`` to the upper end of their groups, as groups of their own."""
    touched: dict[int, int] = {}
    for j in chosen:
        g = group[j]
        if g not in touched:
            touched[g] = end[g]
        last = end[g] - 1
        here, other = place[j], order[last]
        order[here], order[last] = other, j
        place[other], place[j] = here, last
        end[g] = last
    for j in chosen:
        g = group[j]
        if g in touched:
            group[j] = end[g]
    for g, top in touched.items():
        new = end[g]
        if new == g:
            end[g] = top
        else:
            end[new] = top
