"""Suffix arrays by linear grouping: of one text, and of many texts side by side."""

from __future__ import annotations

import numpy as np


def suffix_array(text: list[int]) -> list[int]:
    """The starts of the suffixes of text in ascending order; its last symbol is its only smallest one.

    Suffixes are grouped by their first symbol, and groups are processed in descending order.
    For each member the pointer to the nearest earlier suffix of a smaller group is found; that
    suffix is the member's prefix followed by this group's, so it moves to a new group just
    above its old one (above that again if several members point to it). At the end a group holds
    the suffixes of one Lyndon prefix. One ascending pass then emits the order inside the groups:
    the suffix before each emitted one, and what its pointers lead to, take the next places of
    their groups. Nothing is renamed and nothing recursive is solved.
    """
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place, start, size = [0] * n, [0] * n, [0] * (n + 1)
    first = 0
    for k, i in enumerate(order):
        if text[i] != text[order[first]]:
            first = k
        place[i], start[i] = k, first
        size[first] += 1
    smaller = list(range(-1, n - 1))
    end = n
    while end > 0:
        group = start[order[end - 1]]
        pointed: dict[int, int] = {}
        for i in order[group:end]:
            p = smaller[i]
            while p >= 0 and start[p] >= group:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        if pointed:
            times = set(pointed.values())
            for k in sorted(times, reverse=True):
                moved = [p for p, t in pointed.items() if t == k] if len(times) > 1 else list(pointed)
                for p in moved:  # to the upper end of its group
                    old = start[p]
                    size[old] -= 1
                    to, at = old + size[old], place[p]
                    other = order[to]
                    order[to], order[at] = p, other
                    place[p], place[other] = to, at
                above = [start[p] + size[start[p]] for p in moved]
                for p, new in zip(moved, above, strict=True):
                    start[p] = new
                    size[new] += 1
        end = group
    free = list(range(n))  # by the first place of a group: the next place to fill
    done = [False] * n
    out = [-1] * n
    out[0] = n - 1
    done[n - 1] = True
    for i in range(n):
        p = out[i] - 1
        while p >= 0 and not done[p]:
            group = start[p]
            out[free[group]] = p
            free[group] += 1
            done[p] = True
            p = smaller[p]
    return out


def suffix_arrays(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The suffix arrays of many texts, one after the other: suffix_array with all texts in step.

    text holds the texts (symbols below 2**33), ends where each one ends; the last symbol of a
    text is its only smallest one. In each step the next lower group of every text is processed.
    """
    n, begins = len(text), np.concatenate(([0], ends[:-1]))
    key = (np.repeat(np.arange(len(ends)), ends - begins) << 33) | text
    order = np.argsort(key)
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    key = key[order]
    new = np.ones(n, dtype=bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    size = np.zeros(n + 1, dtype=np.int64)
    size[first] = np.diff(np.append(first, n))
    start = np.empty(n + 1, dtype=np.int64)
    start[order] = np.repeat(first, size[first])
    start[n] = -1  # where the pointers of a text's first suffixes lead
    smaller = np.arange(-1, n, dtype=np.int64)
    smaller[begins] = n
    pointed = np.zeros(n, dtype=bool)
    low, high = begins.copy(), ends.copy()
    while len(high):
        group = start[order[high - 1]]
        count = high - group
        total = int(count.sum())
        if total == len(group):
            member, bound = order[group], group
        else:
            bound = np.repeat(group, count)
            shift = np.cumsum(count) - count
            member = order[bound + np.arange(total) - np.repeat(shift, count)]
        p = smaller[member]
        back = np.flatnonzero(start[p] >= bound)
        while len(back):
            p[back] = smaller[p[back]]
            smaller[member[back]] = p[back]
            back = back[start[p[back]] >= bound[back]]
        p = p[p < n]
        if total > len(group):
            p.sort()
            edge = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1]))) if len(p) else p
            times = np.diff(np.append(edge, len(p)))
            p = p[edge]
        else:
            times = None
        if len(p):
            old = start[p]
            if times is None or (times[0] == times).all():
                by, times = np.argsort(old), None
            else:
                by = np.argsort(old * (times.max() + 1) + times)
                times = times[by]
            p, old = p[by], old[by]
            turn = np.ones(len(p), dtype=bool)
            turn[1:] = old[1:] != old[:-1]
            run = np.flatnonzero(turn)
            moved = np.diff(np.append(run, len(p)))
            top = old[run] + size[old[run]] - moved
            slot = np.repeat(top - run, moved) + np.arange(len(p))
            pointed[p] = True
            from_place = place[p]
            vacated = from_place[from_place < np.repeat(top, moved)]
            if len(vacated):
                there = order[slot]
                other = there[~pointed[there]]
                order[vacated] = other
                place[other] = vacated
            pointed[p] = False
            order[slot] = p
            place[p] = slot
            size[old[run]] -= moved
            if times is not None:
                turn[1:] |= times[1:] != times[:-1]
                run = np.flatnonzero(turn)
                moved = np.diff(np.append(run, len(p)))
            fresh = slot[run]
            size[fresh] = moved
            start[p] = np.repeat(fresh, moved)
        more = group > low
        if not more.all():
            low, group = low[more], group[more]
        high = group
    free = np.arange(n)
    done = np.zeros(n + 1, dtype=bool)
    done[n] = True
    out = np.empty(n, dtype=np.int64)
    out[begins] = ends - 1
    done[ends - 1] = True
    before = np.arange(-1, n, dtype=np.int64)
    before[begins] = n
    at, stop = begins, ends
    while len(at):
        p = before[out[at]]
        p = p[~done[p]]
        while len(p):
            group = start[p]
            to = free[group]
            out[to] = p
            free[group] = to + 1
            done[p] = True
            p = smaller[p]
            p = p[~done[p]]
        at = at + 1
        live = at < stop
        if not live.all():
            at, stop = at[live], stop[live]
    return out
