"""Suffix arrays by linear grouping: Lyndon-prefix groups of suffixes in descending order, then one ascending pass."""

from __future__ import annotations


def suffix_array(s: list[int]) -> list[int]:
    """Places of the nonzero symbols of s in the order of their suffixes; zeros end strings, and an earlier one is smaller.

    At first the suffixes of one symbol are a group. Groups are taken from the largest down. A group that is
    taken is final: its members begin with the same longest Lyndon prefix. Each member looks for its previous
    smaller suffix, over places that are final already; that suffix's prefix grows by the group's word. Parents of one group
    with equally many such children become a group right above their old one. In the end every group's members
    are put in order by the suffixes that follow their prefixes, which an ascending pass meets first.
    """
    n = len(s)
    members: list[list[int]] = [[] for _ in range(max(s, default=0) + 1)]
    for i, c in enumerate(s):
        members[c].append(i)
    used = [c for c in range(1, len(members)) if members[c]]
    below, above = [0] * len(members), [0] * len(members)
    for a, b in zip(used, used[1:], strict=False):
        below[b], above[a] = a, b
    group = list(s)
    final = [False] * n
    prev = [-1] * n
    ends = members[0]
    for a, b in zip(ends, ends[1:], strict=False):
        prev[b] = a
    g = used[-1] if used else 0
    order: list[tuple[int, list[int]]] = []
    while g:
        own = [i for i in members[g] if group[i] == g]
        members[g] = own
        if own:
            own.sort()
            order.append((g, own))
            children: dict[int, int] = {}
            for i in own:
                final[i] = True
                q = i - 1
                while q >= 0 and final[q]:
                    q = prev[q]
                prev[i] = q
                if q >= 0 and s[q]:
                    children[q] = children.get(q, 0) + 1
            if children:
                made: dict[tuple[int, int], list[int]] = {}
                for q, m in children.items():
                    key = (group[q], m)
                    if key in made:
                        made[key].append(q)
                    else:
                        made[key] = [q]
                for h, m in sorted(made, reverse=True) if len(made) > 1 else made:
                    # Of one group, more children stand higher, so they are put above it first and pushed up by none.
                    new = len(members)
                    moved = made[h, m]
                    members.append(moved)
                    up = above[h]
                    below.append(h)
                    above.append(up)
                    above[h] = new
                    if up:
                        below[up] = new
                    for q in moved:
                        group[q] = new
        g = below[g]
    # Slots of each group in ascending order; a place is filled when the suffix after its prefix is met.
    slot = [0] * len(members)
    at = 0
    for h, own in reversed(order):
        slot[h] = at
        at += len(own)
    out = [-1] * at
    tail = [*ends, n] if (not ends or ends[-1] != n - 1) else ends
    before = -1
    for e in tail:
        j = e - 1
        while j > before:
            h = group[j]
            out[slot[h]] = j
            slot[h] += 1
            j = prev[j]
        before = e
    for i in out:
        j, stop = i - 1, prev[i]
        while j > stop:
            h = group[j]
            out[slot[h]] = j
            slot[h] += 1
            j = prev[j]
    return out
