"""Suffix arrays by the linear grouping construction.

Suffixes are first grouped by their first symbol. Groups are taken in falling order; each one's
suffixes point to the nearest suffix before them in a lower group, whose prefix they continue,
so those suffixes move to a group of their own just above their old one. In the end a group
holds the suffixes with one longest Lyndon prefix. One pass over the suffixes in rising order
then puts each into the next free place of its group, without renaming or recursion.
"""

from __future__ import annotations


class Group:
    """Suffixes with one known prefix, in a list of groups linked both ways."""

    __slots__ = ("above", "below", "members", "start")

    def __init__(self, members: set[int], below: Group | None):
        self.members, self.below, self.above, self.start = members, below, None, 0
        if below is not None:
            self.above = below.above
            if self.above is not None:
                self.above.below = self
            below.above = self


def lyndon_groups(text: bytes) -> tuple[list[Group], list[int], Group | None]:
    """Each suffix's group, its pointer to the nearest lower one before it, and the lowest group."""
    first: dict[int, set[int]] = {}
    for i, symbol in enumerate(text):
        first.setdefault(symbol, set()).add(i)
    n = len(text)
    top = lowest = None
    of: list[Group] = [None] * n
    for symbol in sorted(first):
        top = Group(first[symbol], top)
        lowest = lowest or top
        for i in top.members:
            of[i] = top
    before, done = [-1] * n, bytearray(n)
    group = top
    while group is not None:
        members = group.members
        if len(members) == 1:
            (i,) = members
            done[i] = 1
            p = i - 1
            while p >= 0 and done[p]:
                p = before[p]
            before[i] = p
            if p >= 0 and len((old := of[p]).members) > 1:
                old.members.remove(p)
                of[p] = Group({p}, old)
            group = group.below
            continue
        members = sorted(members)
        for i in members:
            done[i] = 1
        times: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and done[p]:
                p = before[p]
            before[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        moved: dict[int, dict[Group, set[int]]] = {}
        for p, k in times.items():
            level = moved.get(k)
            if level is None:
                level = moved[k] = {}
            old = of[p]
            if old in level:
                level[old].add(p)
            else:
                level[old] = {p}
        # What continues more often with this group's prefix is larger, so it moves first, highest.
        for k in sorted(moved, reverse=True):
            for old, some in moved[k].items():
                if len(some) == len(old.members):
                    continue
                old.members -= some
                new = Group(some, old)
                for p in some:
                    of[p] = new
        group = group.below
    return of, before, lowest


def suffix_array(text: bytes) -> list[int]:
    """Starts of the suffixes of ``text`` in rising order."""
    of, before, group = lyndon_groups(text)
    n, at = len(text), 0
    while group is not None:
        group.start = at
        at += len(group.members)
        group = group.above
    order, placed, rank = [0] * n, bytearray(n), -1
    suffix = n  # the empty suffix comes first
    while True:
        i = suffix - 1
        while i >= 0 and not placed[i]:
            group = of[i]
            order[group.start] = i
            group.start += 1
            placed[i] = 1
            i = before[i]
        rank += 1
        if rank == n:
            return order
        suffix = order[rank]
