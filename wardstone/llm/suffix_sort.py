"""Suffix sorting by Lyndon-prefix groups, in two linear passes over a text and without renaming.

The first pass keeps suffixes in groups of equal known Lyndon prefix. A group is a number: its members stand in a list in
the order of their places, and the groups themselves are linked in the order of their prefixes. The groups are taken from
the highest down. When a group comes up its prefix is final: each member finds its previous smaller suffix through the
pointers of suffixes already done, and lends it the prefix. Suffixes of one group that got the same prefix equally often
leave it for a new group right above it. The second pass walks the groups in ascending order and emits them: an emitted
suffix appends all those whose Lyndon prefix ends where it starts to their groups, so each group fills in order.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: bytes, stops: list[int]) -> list[int]:
    """The starts of all suffixes but the stops, in the order of what they hold up to the next stop.

    ``stops`` are the ascending places of separators, of which the first is 0 and the last ends the text. No order is
    promised among suffixes that are equal up to their stops.
    """
    octets = np.frombuffer(text, np.uint8)
    kinds, group = np.unique(octets, return_inverse=True)
    group = group.astype(np.int64)
    group[stops] = -1  # of no group
    places, group = np.argsort(group, kind="stable")[len(stops) :], group.tolist()
    ends = np.cumsum(np.bincount(octets[places], minlength=256)[kinds])
    members = [x.tolist() for x in np.split(places, ends[:-1])]
    lower, upper = list(range(-1, len(kinds) - 1)), list(range(1, len(kinds) + 1))  # the neighbours in the order of groups
    before = [-1] * len(text)  # the previous smaller suffix of those that are done
    g, done = len(kinds) - 1, []
    while g >= 0:
        last, times, lent = -1, 0, {}
        own = [i for i in members[g] if group[i] == g]
        for i in own:  # ascending, and so are those that they lend to
            p = i - 1
            q = before[p]
            while q >= 0:
                p = q
                q = before[p]
            before[i] = p
            if p == last:
                times += 1
            else:
                if times and group[last] >= 0:
                    lent.setdefault((group[last], times), []).append(last)
                last, times = p, 1
        if own:
            if group[last] >= 0:
                lent.setdefault((group[last], times), []).append(last)
            done.append(g)
        members[g] = []
        # of one group's new ones the most often lent to is the highest, and all are under those it had before
        for of, often in sorted(lent, reverse=True) if len(lent) > 1 else lent:
            new, above = len(members), upper[of]
            members.append(lent[of, often])
            lower.append(of)
            upper.append(above)
            upper[of] = lower[above] = new
            for p in members[new]:
                group[p] = new
        g = lower[g]

    order: list[int] = []
    for s, first in zip(stops[1:], stops):
        i = s - 1
        while i != first:
            members[group[i]].append(i)
            i = before[i]
    for g in reversed(done):
        own = members[g]
        for s in own:  # grows while it is read
            i, end = s - 1, before[s]
            while i != end:
                members[group[i]].append(i)
                i = before[i]
        order += own
    return order
