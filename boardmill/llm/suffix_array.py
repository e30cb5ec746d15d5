"""A suffix array by linear grouping.

Suffixes are first grouped by their Lyndon prefixes: groups are processed in descending order,
every suffix of a group finds its previous smaller suffix through the pointers already set, and
the suffixes found move to a new group just above their own, those found more often higher.
Then one pass over the growing array emits each group's order.  No string is renamed and
nothing recurs.
"""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """The places of the suffixes of ``text`` in order.  Its last symbol must be its unique smallest."""
    n = len(text)
    if n == 0:
        return []
    symbols = sorted(set(text))
    first_group = {c: k for k, c in enumerate(symbols)}
    group = [first_group[c] for c in text]
    members: list[list[int]] = [[] for _ in symbols]
    for place, g in enumerate(group):
        members[g].append(place)
    below = list(range(-1, len(symbols) - 1))
    above = list(range(1, len(symbols) + 1))
    above[-1] = -1

    previous = list(range(-1, n - 1))  # until a group is done, the place before
    done = bytearray(n + 1)  # place -1 is never done
    g = len(symbols) - 1
    while g >= 0:
        own = [p for p in members[g] if group[p] == g]
        members[g] = own
        for p in own:
            done[p] = 1
        found: dict[int, int] = {}
        for p in own:
            q = previous[p]
            while q >= 0 and done[q]:
                q = previous[q]
            previous[p] = q
            if q >= 0:
                found[q] = found.get(q, 0) + 1
        if found:
            levels: dict[int, list[int]] = {}
            for q, times in found.items():
                levels.setdefault(times, []).append(q)
            for times in sorted(levels, reverse=True):
                moved: dict[int, int] = {}
                for q in levels[times]:
                    old = group[q]
                    new = moved.get(old)
                    if new is None:
                        new = moved[old] = len(members)
                        members.append([])
                        up = above[old]
                        below.append(old)
                        above.append(up)
                        above[old] = new
                        if up >= 0:
                            below[up] = new
                    group[q] = new
                    members[new].append(q)
        lowest, g = g, below[g]

    free, at, g = [0] * len(members), 0, lowest
    while g >= 0:
        free[g] = at
        at += len(members[g])
        g = above[g]
    order = [-1] * n
    order[0] = n - 1
    placed = bytearray(n + 1)
    placed[n - 1] = 1
    for k in range(n):
        p = order[k] - 1
        while p >= 0 and not placed[p]:
            placed[p] = 1
            at = free[group[p]]
            order[at] = p
            free[group[p]] = at + 1
            p = previous[p]
    return order
