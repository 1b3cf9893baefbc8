"""Knuth's lightest derivation over a weighted hypergraph.

An item stands for a fact (here: "these rows are repaired and the last role is u").
A deduction derives one item from others. Values are pairs (cost, audit), compared by
cost and then by the audit's ASCII order. The functions of the deductions must be
monotone and superior: no derived value is below one that it is derived from. Then
the item popped first from the agenda has its final value, and work ends as soon as
the wanted items are final, without a look at dearer ones.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Hashable, Iterable

Value = tuple[int, str]


def lightest(axioms: dict[Hashable, Value], deductions: Callable[[Hashable, dict], Iterable[tuple[Hashable, Value]]],
             wanted: Iterable[Hashable]) -> dict[Hashable, Value]:
    """Final values of all items popped until every ``wanted`` one is final or none can be derived.

    ``deductions(item, final)`` yields the (consequent, value) of every deduction whose last
    antecedent to become final is ``item``; ``final`` holds the values of the others.
    """
    final: dict[Hashable, Value] = {}
    best = dict(axioms)
    agenda = [(value, item) for item, value in axioms.items()]
    heapq.heapify(agenda)
    missing = set(wanted)
    while agenda and missing:
        value, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = value
        missing.discard(item)
        for head, derived in deductions(item, final):
            if head not in final and (head not in best or derived < best[head]):
                best[head] = derived
                heapq.heappush(agenda, (derived, head))
    return final
