"""Suffix array in linear grouping: groups by Lyndon prefix, then their orders, without recursion.

First pass: suffixes stand in groups of equal prefixes, and groups are taken in
descending order. When a group is taken, its prefix is the longest Lyndon
prefix of its suffixes, and every suffix in it learns its pointer to the
previous suffix of a lower group. The prefix of the suffix pointed to ends
where the group's suffixes begin, so it grows by the group's prefix: such
suffixes leave their group for a new one just above, ordered by how often the
prefix follows. Second pass: taken in ascending order, each suffix settles the
place of the one before it and of those along its pointers, at the front of what is
left of their groups.
"""

from __future__ import annotations

from collections.abc import Sequence


def lyndon_groups(text: Sequence[int]) -> tuple[list[list[int]], list[int]]:
    """Groups of suffixes in descending order and the previous-smaller pointers (-1: none)."""
    by_sign: dict[int, list[int]] = {}
    for i, sign in enumerate(text):
        if sign in by_sign:
            by_sign[sign].append(i)
        else:
            by_sign[sign] = [i]
    n = len(text)
    members = [by_sign[sign] for sign in sorted(by_sign)]
    group = [0] * n
    for g, found in enumerate(members):
        for i in found:
            group[i] = g
    below = list(range(-1, len(members) - 1))
    above = list(range(1, len(members) + 1))
    pointer, taken = [-1] * n, bytearray(n)
    out, g = [], len(members) - 1
    while g >= 0:
        here = [i for i in members[g] if group[i] == g]
        if here:
            if len(here) > 1:
                here.sort()
            out.append(here)
            follows: dict[int, int] = {}
            for i in here:
                j = i - 1
                while j >= 0 and taken[j]:
                    j = pointer[j]
                pointer[i] = j
                taken[i] = 1
                if j >= 0:
                    follows[j] = follows.get(j, 0) + 1
            if len(follows) == 1:
                ((j, _),) = follows.items()
                moved = [(group[j], 0, [j])]
            else:
                split: dict[tuple[int, int], list[int]] = {}
                for j, times in follows.items():
                    key = (group[j], times)
                    if key in split:
                        split[key].append(j)
                    else:
                        split[key] = [j]
                moved = [(*key, split[key]) for key in sorted(split, reverse=True)]
            # More repeats stand higher: they are put in first, each directly above the old group.
            for old, _, suffixes in moved:
                new, up = len(members), above[old]
                members.append(suffixes)
                below.append(old)
                above.append(up)
                above[old] = new
                if up < len(below):
                    below[up] = new
                for j in suffixes:
                    group[j] = new
        g = below[g]
    return out, pointer


def suffix_array(text: Sequence[int]) -> list[int]:
    """Places of a text's suffixes in ascending order; the text is a list of integers."""
    groups, pointer = lyndon_groups(text)
    n = len(text)
    front, group, at = [0] * len(groups), [0] * n, 0
    for g, suffixes in enumerate(reversed(groups)):
        front[g] = at
        at += len(suffixes)
        for i in suffixes:
            group[i] = g
    out, settled = [0] * n, bytearray(n)
    j = n - 1
    for k in range(-1, n):
        if k >= 0:
            j = out[k] - 1
        while j >= 0 and not settled[j]:
            g = group[j]
            out[front[g]] = j
            front[g] += 1
            settled[j] = 1
            j = pointer[j]
    return out
