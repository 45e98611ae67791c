"""Suffix arrays by Lyndon-prefix groups, without recursion and without renaming.

Suffixes that begin with the same longest Lyndon word form a group; a group is named by
its first place in the suffix array. Groups are worked off in descending order: a suffix
whose next smaller suffix is not known yet takes in what follows while that is in a
greater group, each suffix taken in points back to the previous smaller one that took it,
and groups split by what their members took in. Letters come one after another, as arrays;
groups of one letter that don't wait for each other are split together, the rest one by
one in descending order. Then the suffixes are emitted in ascending order: one that is
emitted is the next smaller of all that the pointers reach from its left neighbour, and
each of those takes the next place of its group.
"""

from __future__ import annotations

import numpy as np

#: Rounds in which a letter's groups are split together, as long as each settles many.
ROUNDS = 64
#: Most symbols, so that a group, a count and a rank fit into one key.
LIMIT = 1 << 20


def _ranked(keys: np.ndarray) -> np.ndarray:
    """Dense ranks from 1."""
    order = np.argsort(keys, kind="stable")
    new = np.empty(len(keys), np.int64)
    new[0] = 1
    new[1:] = keys[order][1:] != keys[order][:-1]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(new)
    return out


class LyndonGroups:
    """``name``, ``after`` (next smaller suffix) and ``before`` (previous smaller suffix, 0 if a
    separator) of each suffix. Symbols are integers; 0 separates, it is the first and the last."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        if n > LIMIT:
            raise ValueError(f"{n} symbols are more than {LIMIT}")
        self.n = n
        counts = np.bincount(symbols)
        starts = np.cumsum(counts) - counts
        self.name = starts[symbols].astype(np.int64)
        self.after = np.arange(1, n + 1)
        self.before = np.zeros(n, np.int64)
        self.settled = np.zeros(n, bool)
        # Equal neighbours are taken in at once: how many, and what comes after them.
        self.times, self.beyond = np.ones(n, np.int64), self.after.copy()
        self.place, self.at = np.argsort(symbols, kind="stable"), np.zeros(n, np.int64)
        self.at[self.place] = np.arange(n)
        for letter in np.flatnonzero(counts)[:0:-1]:
            low, high = int(starts[letter]), int(starts[letter] + counts[letter])
            self._letter(low, high)

    def _letter(self, low: int, high: int) -> None:
        members = self.place[low:high].copy()
        waiting, groups = self._split(members, np.zeros(len(members), np.int64), *self._greater(members, high))
        for _ in range(ROUNDS):
            if not len(waiting):
                break
            count = len(waiting)
            waiting, groups = self._round(waiting, groups)
            if len(waiting) > 0.98 * count:
                break
        if len(waiting):
            self._one_by_one(waiting, members)
        order = np.argsort(self.name[members], kind="stable")
        members = members[order]
        self.place[low:high], self.at[members] = members, np.arange(low, high)
        self.settled[members] = True
        equal = np.flatnonzero(self.after[members[:-1]] == members[1:])
        equal = equal[self.name[members[equal]] == self.name[members[equal + 1]]]
        self.beyond[members] = self.after[members]
        if len(equal):
            more = np.zeros(len(members), bool)
            more[equal] = True
            last = np.flatnonzero(~more)
            end = last[np.searchsorted(last, np.arange(len(members)))]
            self.times[members] = end - np.arange(len(members)) + 1
            self.beyond[members] = self.after[members[end]]

    def _greater(self, members: np.ndarray, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Take in what begins with a greater letter; ranks of what was taken, and its end."""
        end, live, steps = self.after[members].copy(), np.arange(len(members)), []
        while True:
            child = end[live]
            more = self.name[child] >= high
            live, child = live[more], child[more]
            if not len(live):
                break
            steps.append((live, self.name[child] * (self.n + 1) + self.times[child]))
            times, parent = self.times[child], members[live]
            self.before[child] = parent
            several = np.flatnonzero(times > 1)
            if len(several):
                t = times[several]
                offset = np.arange(int(t.sum())) - np.repeat(np.cumsum(t) - t, t)
                self.before[self.place[np.repeat(self.at[child[several]], t) + offset]] = np.repeat(
                    parent[several], t)
            end[live] = self.beyond[child]
        return self._ranks(steps, len(members)), end

    def _ranks(self, steps: list[tuple[np.ndarray, np.ndarray]], count: int) -> np.ndarray:
        """Order of the lists whose k-th entries ``steps`` holds; one that ends is smaller."""
        rank = np.zeros(count, np.int64)
        for live, keys in reversed(steps):
            rank[live] = _ranked(_ranked(keys) * (count + 1) + rank[live])
        return rank

    def _split(
        self, members: np.ndarray, groups: np.ndarray, rank: np.ndarray, end: np.ndarray,
    ) -> tuple[np.ndarray, np.ndarray]:
        """Split groups by rank; members of the groups that aren't settled, and their groups."""
        self.after[members] = end
        order = np.argsort(groups * (len(members) + 1) + rank, kind="stable")
        members, groups, rank = members[order], groups[order], rank[order]
        at = np.arange(len(members))
        new_group, new = np.ones(len(members), bool), np.ones(len(members), bool)
        new_group[1:] = groups[1:] != groups[:-1]
        new[1:] = new_group[1:] | (rank[1:] != rank[:-1])
        first, begin = (np.maximum.accumulate(np.where(x, at, 0)) for x in (new, new_group))
        names = self.name[members] + first - begin
        self.name[members] = names
        # Only a group with a member before a greater one splits again.
        number = np.cumsum(new) - 1
        unsettled = np.zeros(int(number[-1]) + 1, bool)
        unsettled[number[self.name[self.after[members]] > names]] = True
        unsettled = unsettled[number]
        self.settled[members[~unsettled]] = True
        return members[unsettled], np.unique(number[unsettled], return_inverse=True)[1]

    def _round(self, members: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Split all groups whose members are followed by settled suffixes only."""
        own, end = self.name[members], self.after[members].copy()
        live, steps, late = np.arange(len(members)), [], np.zeros(int(groups[-1]) + 1, bool)
        while True:
            child = end[live]
            more = (self.name[child] > own[live]) & ~late[groups[live]]
            live, child = live[more], child[more]
            if not len(live):
                break
            late[groups[live[~self.settled[child]]]] = True
            steps.append((live, child))
            end[live] = self.after[child]
        ready = ~late[groups]
        if not ready.any():
            return members, groups
        number = np.cumsum(ready) - 1
        taken = []
        for live, child in steps:
            chosen = ready[live]
            live, child = live[chosen], child[chosen]
            if len(live):
                self.before[child] = members[live]
                taken.append((number[live], self.name[child]))
        rank = self._ranks(taken, int(ready.sum()))
        again, _ = self._split(members[ready], groups[ready], rank, end[ready])
        waiting = np.concatenate([members[~ready], again])
        names = self.name[waiting]
        order = np.argsort(names, kind="stable")
        return waiting[order], np.unique(names[order], return_inverse=True)[1]

    def _one_by_one(self, members: np.ndarray, letter: np.ndarray) -> None:
        """The groups of one letter in descending order: what a group's members are taken in by
        moves up within its own group, by how many of them it takes in."""
        # Members by number; the last number stands for whatever follows outside the letter.
        low, outside = int(self.name[letter].min()), len(letter)
        number = np.minimum(np.searchsorted(letter, self.after[letter]), outside - 1)
        number[letter[number] != self.after[letter]] = outside
        name, after = [*(self.name[letter] - low).tolist(), -1], [*number.tolist(), outside]
        waiting = np.searchsorted(letter, members).tolist()
        taker, size, ends = [-1] * (outside + 1), [0] * outside, {}
        # What waits to be taken in, by group; a group only ever calls for smaller ones.
        called: list[list] = [[] for _ in letter]
        for p in waiting:
            size[name[p]] += 1
            taker[after[p]] = p
        taker[outside] = -1
        for p in waiting:
            if name[after[p]] > name[p]:
                called[name[after[p]]].append(after[p])
        taken, takers = [], []
        for group in range(outside - 1, -1, -1):
            if not called[group]:
                continue
            moved: dict[int, list] = {}
            for q in called[group]:
                p = taker[q]
                if p < 0 or name[q] != group or name[p] >= group:
                    continue
                taker[q] = -1
                times, x = 0, q
                while name[x] == group:
                    taken.append(x)
                    takers.append(p)
                    times, last, x = times + 1, x, after[x]
                after[p] = x
                if x != outside:
                    taker[x] = p
                else:
                    ends[p] = ends.get(last, last)
                old = name[p]
                if old in moved:
                    moved[old].append((times, p))
                else:
                    moved[old] = [(times, p)]
            for old, rows in moved.items():
                end = old + size[old]
                size[old] -= len(rows)
                begin = end - len(rows)
                if len(rows) > 1:
                    rows.sort()
                before = rows[0][0]
                for k, (times, p) in enumerate(rows):
                    if times != before:
                        begin, before = end - len(rows) + k, times
                    name[p] = begin
                    size[begin] += 1
            for rows in moved.values():
                for _, p in rows:
                    own, x = name[p], after[p]
                    if name[x] > own:
                        called[name[x]].append(x)
                    x = taker[p]
                    if x >= 0 and own > name[x]:
                        called[own].append(p)
        every = np.append(letter, 0)
        self.name[letter] = np.array(name[:-1]) + low
        follows, own = np.array(after[:-1]), self.after[letter]
        own[follows != outside] = every[follows[follows != outside]]
        if ends:
            own[list(ends)] = self.after[letter[list(ends.values())]]
        self.after[letter] = own
        self.before[letter[taken]] = letter[takers]


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Places of all suffixes in ascending order, those of separators first. A separator ends a
    suffix; suffixes that are equal up to it come in any order."""
    found = LyndonGroups(symbols)
    separators = np.flatnonzero(symbols == 0)
    group, before = found.name, found.before.tolist()
    group[separators] = -1  # of suffixes that have their place
    group, room = group.tolist(), list(range(found.n))
    emitted = separators.tolist() + [0] * (found.n - len(separators))
    for s in emitted:  # places are taken ahead of it
        s -= 1
        own = group[s]
        while own >= 0:
            group[s] = -1
            place = room[own]
            room[own] = place + 1
            emitted[place] = s
            s = before[s]
            own = group[s]
    return np.array(emitted, np.int64)
