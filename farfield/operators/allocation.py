"""Integer tables with given margins: how many rows of each (class, region) cell go to each part.

Two parts are split exactly by a flow: from the source to classes, over cells to regions, to the sink; what a unit more
costs rises along each arc, so cheapest flows are whole numbers and keep each cell close to its share, and margins beyond
their bounds cost more than all shares together. More than two parts are dealt out one by one, smallest first, and then every
pair of parts is split anew by a flow until no margin is broken. The table has classes times regions cells, whatever the data.
"""

from __future__ import annotations

import random
from collections import defaultdict
from itertools import combinations

BROKEN = 1_000_000  # cost of a unit beyond the bounds of a margin
SCALE = 1000  # of the costs of shares
SLACK = (0, 2)  # units by which a cell may lie below or above its share rounded down and up: at first, and later
ROUNDS = 60


class _Flow:
    """Cheapest flow of a given size; arcs of unit capacity whose costs don't fall along parallel ones."""

    def __init__(self) -> None:
        self.to: list[int] = []
        self.left: list[int] = []
        self.cost: list[int] = []
        self.out: dict[int, list[int]] = defaultdict(list)

    def arc(self, a: int, b: int, cost: int) -> int:
        for x, y, left, c in ((a, b, 1, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.left.append(left)
            self.cost.append(c)
        return len(self.to) - 2

    def send(self, source: int, sink: int, units: int) -> bool:
        for _ in range(units):
            far, via, line = {source: 0}, {}, [source]
            waiting = {source}
            for node in line:
                waiting.discard(node)
                for e in self.out[node]:
                    d = far[node] + self.cost[e]
                    if self.left[e] and d < far.get(self.to[e], 1 << 62):
                        far[self.to[e]], via[self.to[e]] = d, e
                        if self.to[e] not in waiting:
                            waiting.add(self.to[e])
                            line.append(self.to[e])
            if sink not in via:
                return False
            node = sink
            while node != source:
                e = via[node]
                self.left[e] -= 1
                self.left[e ^ 1] += 1
                node = self.to[e ^ 1]
        return True


class _Table:
    def __init__(self, counts: dict[tuple, int], capacities: tuple[int, ...]):
        self.counts, self.caps, self.total = counts, capacities, sum(counts.values())
        self.cells = sorted(counts, key=repr)
        self.margins = [sorted({c[a] for c in self.cells}, key=repr) for a in (0, 1)]
        self.size: dict[tuple, int] = defaultdict(int)
        for c, n in counts.items():
            for a in (0, 1):
                self.size[a, c[a]] += n

    def off(self, margin: tuple, part: int, n: int) -> int:
        """By how many units ``n`` lies outside floor and ceiling of the quota."""
        low, rest = divmod(self.size[margin] * self.caps[part], self.total)
        return max(0, low - n, n - low - (rest > 0))

    def split(self, mine: dict[tuple, int], p: int, others: list[int], rng: random.Random | None) -> dict[tuple, int] | None:
        """Of the rows ``mine`` of each cell, which part ``p`` and ``others`` hold together, those that p gets.

        Margins are those of p and, for one other part, also of that one.
        """
        slack = SLACK[rng is not None]
        held = self.caps[p] + sum(self.caps[q] for q in others)
        flow, least, arcs = _Flow(), {}, {}
        names = {("s",): 0, ("t",): 1} | {(a, v): 2 + k for k, (a, v) in enumerate((a, v) for a in (0, 1) for v in self.margins[a])}
        room: dict[tuple, int] = defaultdict(int)
        base: dict[tuple, int] = defaultdict(int)
        together: dict[tuple, int] = defaultdict(int)
        for c in self.cells:
            want = self.counts[c] * self.caps[p] / self.total if not others or held == self.total else mine[c] * self.caps[p] / max(1, held)
            low, high = max(0, int(want) - slack), min(mine[c], int(want) + 1 + slack)
            least[c] = min(low, high)
            arcs[c] = []
            for x in range(least[c], high):
                cost = round(SCALE * (abs(x + 1 - want) - abs(x - want))) + (rng.randrange(2 * SCALE) if rng else 0)
                arcs[c].append((x, cost))
            for a in (0, 1):
                room[a, c[a]] += high - least[c]
                base[a, c[a]] += least[c]
                together[a, c[a]] += mine[c]
        units = self.caps[p] - sum(least.values())
        if units < 0:
            return None
        edges = {c: [flow.arc(names[0, c[0]], names[1, c[1]], cost) for cost in sorted(cost for _, cost in steps)] for c, steps in arcs.items()}
        for margin, most in room.items():
            def broken(n: int, margin=margin) -> int:
                other = self.off(margin, others[0], together[margin] - n) if len(others) == 1 else 0
                return BROKEN * (self.off(margin, p, n) + other)

            for x in range(base[margin], base[margin] + most):
                cost = broken(x + 1) - broken(x)
                flow.arc(0, names[margin], cost) if margin[0] == 0 else flow.arc(names[margin], 1, cost)
        if not flow.send(0, 1, units):
            return None
        return {c: least[c] + sum(1 - flow.left[e] for e in edges[c]) for c in self.cells}

    def broken(self, share: dict[tuple, list[int]]) -> list[tuple[tuple, int]]:
        sums: dict[tuple, int] = defaultdict(int)
        for c, x in share.items():
            for p, n in enumerate(x):
                for a in (0, 1):
                    sums[(a, c[a]), p] += n
        return [k for k, n in sums.items() if self.off(k[0], k[1], n)]


def allocate(counts: dict[tuple, int], capacities: tuple[int, ...]) -> dict[tuple, list[int]]:
    """Shares of each (class, region) cell for each part: exact capacities, every class and every region within floor and
    ceiling of its quota in each part, and cells as near to their share as that allows.

    The result depends on the counts alone. Where no table is found, the margins that can't be met are named.
    """
    if sum(capacities) != sum(counts.values()):
        raise ValueError("the sizes of the parts must add up to the number of rows")
    table = _Table({c: n for c, n in counts.items() if n}, tuple(capacities))
    if not table.cells:
        return {c: [0] * len(capacities) for c in counts}
    order = sorted(range(len(capacities)), key=lambda p: capacities[p])
    best: tuple[int, dict] | None = None
    for attempt in range(ROUNDS):
        rng = random.Random(attempt) if attempt else None
        share = {c: [0] * len(capacities) for c in table.cells}
        rest = dict(table.counts)
        for k, p in enumerate(order[:-1]):
            got = table.split(rest, p, order[k + 1 :], rng)
            if got is None:
                break
            for c, n in got.items():
                share[c][p] = n
                rest[c] -= n
        else:
            for c in table.cells:
                share[c][order[-1]] = rest[c]
            bad = table.broken(share)
            pairs = list(combinations(order, 2))
            for p, q in pairs * 2 if bad else []:
                mine = {c: share[c][p] + share[c][q] for c in table.cells}
                got = table.split(mine, p, [q], rng)
                if got is None:
                    continue
                changed = {c: [got[c] if i == p else mine[c] - got[c] if i == q else n for i, n in enumerate(share[c])] for c in table.cells}
                now = table.broken(changed)
                if len(now) <= len(bad):
                    share, bad = changed, now
                if not bad:
                    break
            if best is None or len(bad) < best[0]:
                best = (len(bad), share)
            if not bad:
                return share | {c: [0] * len(capacities) for c in counts if c not in share}
    named = sorted({f"{('class', 'region')[m[0]]} {m[1]!r}" for m, _ in table.broken(best[1])}) if best else ["the sizes of the parts"]
    raise ValueError(f"no allocation meets the quotas of {', '.join(named)}")
