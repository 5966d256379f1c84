"""Numpy kernels on the residual arcs of one block of vertices.

A block holds vertices by position and the arcs with both ends inside. Direction ``2 * arc`` runs
with the arc, ``2 * arc + 1`` against it. Routes are numbered the same way; -1 stands for a route
that does not begin inside the block.
"""

from __future__ import annotations

import numpy as np

UNIT_COST = 1


class Block:
    """Surplus, fill, spill and prices of vertices, and flows of the arcs between them."""

    def __init__(self, nodes: int, tail: np.ndarray, head: np.ndarray, lower: np.ndarray, upper: np.ndarray, flow: np.ndarray):
        self.tail, self.head, self.lower, self.upper, self.flow = tail, head, lower, upper, flow.copy()
        # Every direction by the vertex it leads to, so that a better price is offered backwards.
        self._from = np.stack([tail, head], axis=1).ravel()
        self._to = np.stack([head, tail], axis=1).ravel()
        self._order = np.argsort(self._to, kind="stable")
        self._begin = np.searchsorted(self._to[self._order], np.arange(nodes + 1))

    def room(self, way: np.ndarray) -> np.ndarray:
        arc = way >> 1
        return np.where(way & 1, self.flow[arc] - self.lower[arc], self.upper[arc] - self.flow[arc])

    def relax(self, price: np.ndarray, via: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """Lower prices until no direction with room offers less; returns which vertices changed.

        Only vertices whose price has just fallen send offers. ``price`` and ``via`` change in place,
        and only for the better, so that routes never close a cycle.
        """
        changed = np.zeros(len(price), dtype=bool)
        front = np.flatnonzero(fresh)
        while len(front):
            count = self._begin[front + 1] - self._begin[front]
            at = np.repeat(self._begin[front] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            way = self._order[at]
            offer = np.repeat(price[front], count) + np.where(way & 1, -UNIT_COST, UNIT_COST)
            good = (self.room(way) > 0) & (offer < price[self._from[way]])
            way, offer = way[good], offer[good]
            best = np.lexsort((way, offer, self._from[way]))
            way, offer = way[best], offer[best]
            first = np.ones(len(way), dtype=bool)
            first[1:] = self._from[way[1:]] != self._from[way[:-1]]
            way, offer = way[first], offer[first]
            front = self._from[way]
            price[front], via[front] = offer, way
            changed[front] = True
        return changed

    def push(self, surplus: np.ndarray, via: np.ndarray) -> bool:
        """Move surplus along the routes as far as capacity and the block allow."""
        moved = False
        front = np.flatnonzero((surplus > 0) & (via >= 0))
        while len(front):
            way = via[front]
            amount = np.minimum(surplus[front], self.room(way))
            able = amount > 0
            front, way, amount = front[able], way[able], amount[able]
            if not len(front):
                break
            moved = True
            np.add.at(self.flow, way >> 1, np.where(way & 1, -amount, amount))
            surplus[front] -= amount
            np.add.at(surplus, self._to[way], amount)
            front = np.unique(self._to[way])
            front = front[via[front] >= 0]
        return moved


def settle(surplus: np.ndarray, fill: np.ndarray, spill: np.ndarray, price: np.ndarray, at_hub: np.ndarray) -> bool:
    """Surplus of vertices whose route is the hub itself cancels their fill or is spilled."""
    cancel = np.where(at_hub & (price < 0), np.minimum(surplus, fill), 0)
    spilled = np.where(at_hub & (price > 0), surplus, 0)
    fill -= cancel
    spill += spilled
    surplus -= cancel + spilled
    return bool(cancel.any() or spilled.any())


def solve(block: Block, surplus: np.ndarray, fill: np.ndarray, spill: np.ndarray, hub_cost: int) -> tuple[np.ndarray, np.ndarray]:
    """Route and move all surplus of a block no arc leaves; returns the final prices and routes."""
    while True:
        price = np.where(fill > 0, -hub_cost, hub_cost).astype(np.int64)
        via = np.full(len(price), -1, dtype=np.int64)
        block.relax(price, via, np.ones(len(price), dtype=bool))
        if not (surplus > 0).any():
            return price, via
        progress = True
        while progress:
            progress = block.push(surplus, via)
            progress |= settle(surplus, fill, spill, price, via < 0)
