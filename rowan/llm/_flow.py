"""Small flow problems on the driver: feasible circulations by maximum flow, minimum-cost flow."""

from __future__ import annotations

import heapq
import math
from collections import deque
from collections.abc import Sequence
from fractions import Fraction


class MaxFlow:
    """Maximum flow by level graphs and blocking flows; arcs are tried in the order they were added."""

    def __init__(self, nodes: int):
        self.to: list[int] = []
        self.room: list[int] = []
        self.out: list[list[int]] = [[] for _ in range(nodes)]

    def arc(self, a: int, b: int, capacity: int) -> int:
        self.out[a].append(len(self.to))
        self.to.append(b)
        self.room.append(capacity)
        self.out[b].append(len(self.to))
        self.to.append(a)
        self.room.append(0)
        return len(self.to) - 2

    def flow(self, arc: int) -> int:
        return self.room[arc ^ 1]

    def run(self, s: int, t: int) -> int:
        total = 0
        while True:
            level = {s: 0}
            queue = deque([s])
            while queue:
                a = queue.popleft()
                for e in self.out[a]:
                    if self.room[e] and self.to[e] not in level:
                        level[self.to[e]] = level[a] + 1
                        queue.append(self.to[e])
            if t not in level:
                return total
            turn = [0] * len(self.out)
            path: list[int] = []
            at = s
            while True:
                if at == t:
                    least = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    total += least
                    path, at = [], s
                    continue
                while turn[at] < len(self.out[at]):
                    e = self.out[at][turn[at]]
                    if self.room[e] and level.get(self.to[e]) == level[at] + 1:
                        break
                    turn[at] += 1
                else:
                    if at == s:
                        break
                    at = self.to[path.pop() ^ 1]
                    turn[at] += 1
                    continue
                path.append(e)
                at = self.to[e]


def circulation(nodes: int, arcs: Sequence[tuple[int, int, int, int]]) -> list[int]:
    """Whole flows of the arcs (from, to, least, most) that leave nothing at any node; an error if there are none."""
    net = MaxFlow(nodes + 2)
    s, t = nodes, nodes + 1
    missing = [0] * nodes
    made = []
    for a, b, lo, hi in arcs:
        missing[b] += lo
        missing[a] -= lo
        made.append((net.arc(a, b, hi - lo), lo))
    need = 0
    for v, m in enumerate(missing):
        if m > 0:
            net.arc(s, v, m)
            need += m
        elif m < 0:
            net.arc(v, t, -m)
    if net.run(s, t) != need:
        raise ArithmeticError("no flow within the bounds")
    return [lo + net.flow(e) for e, lo in made]


def _around(x: Fraction) -> tuple[int, int]:
    return x.numerator // x.denominator, -(-x.numerator // x.denominator)


def controlled_rounding(table: Sequence[Sequence[Fraction]]) -> list[list[int]]:
    """Whole numbers next to the entries of a table, of which all row sums, column sums and the sum are next to those of the table.

    Each entry, margin and total that is whole stays as it is. Such a rounding always exists: the table is a
    fractional flow from rows to columns within whole bounds, so there is a whole one.
    """
    return [[sum(cell.values()) for cell in row] for row in pooled_rounding([[{(): Fraction(x)} for x in r] for r in table], {})]


def pooled_rounding(table: Sequence[Sequence[dict]], pools: dict[tuple, int]) -> list[list[dict]]:
    """controlled_rounding of a table of which each entry is a sum of parts drawn from pools, and no pool gives more than it holds.

    table: for each row and column the parts by name of the pool. pools: what (name, column) holds; one that is not named has no limit.
    The parts given must keep to the pools; then whole parts that do, next to the same margins, exist.
    """
    rows, columns = len(table), len(table[0]) if table else 0
    if not columns:
        return [[] for _ in range(rows)]
    table = [[{k: Fraction(x) for k, x in cell.items()} for cell in r] for r in table]
    total = lambda cells: sum((x for c in cells for x in c.values()), Fraction(0))
    s, t = 0, 1
    row, column = (lambda i: 2 + i), (lambda j: 2 + rows + j)
    nodes = 2 + rows + columns
    arcs = [(t, s, *_around(total(c for r in table for c in r)))]
    arcs += [(s, row(i), *_around(total(r))) for i, r in enumerate(table)]
    arcs += [(column(j), t, *_around(total(r[j] for r in table))) for j in range(columns)]
    pool: dict[tuple, int] = {}
    where = []
    for i in range(rows):
        for j in range(columns):
            lo, hi = _around(total([table[i][j]]))
            cell, nodes = nodes, nodes + 1
            arcs.append((row(i), cell, lo, hi))
            for k in sorted(table[i][j]):
                if (k, j) not in pool:
                    pool[k, j], nodes = nodes, nodes + 1
                    most = pools.get((k, j))
                    arcs.append((pool[k, j], column(j), 0, sum(_around(total([r[j]]))[1] for r in table) if most is None else most))
                where.append((len(arcs), i, j, k))
                arcs.append((cell, pool[k, j], 0, hi))
    flows = circulation(nodes, arcs)
    out = [[{} for _ in range(columns)] for _ in range(rows)]
    for at, i, j, k in where:
        out[i][j][k] = flows[at]
    return out


def shared_amounts(supply: dict, demand: Sequence[tuple[object, set, Fraction, Fraction, int]], total: int, spread) -> dict[tuple, Fraction]:
    """How much each supply gives to each demand: parts by (supply, demand).

    supply: what each holds; demand: (name, supplies that serve it, least, share, most). Least amounts are served first, as
    far as supplies reach; then all demands rise to amounts in proportion to their shares that add up to total (by spread). What a demand can't get, because
    others use up the supplies it shares with them, is spread over the rest again, until nothing changes.
    """
    names = list(supply)
    s, t = len(names) + len(demand), len(names) + len(demand) + 1
    index = {k: i for i, k in enumerate(names)}
    most = [Fraction(d[4]) for d in demand]
    least = [min(Fraction(d[2]), m) for d, m in zip(demand, most)]
    got = [Fraction(0)] * len(demand)
    parts: dict[tuple, Fraction] = {}
    wanted = least
    for stage in range(2 * len(demand) + 2):
        if stage:
            goal = spread(total, [d[3] for d in demand], got if stage == 1 else floor, most)
            wanted = [max(w, g) for w, g in zip(got, goal)]
        scale = math.lcm(*[x.denominator for x in (*wanted, *parts.values())], 1)
        net = MaxFlow(t + 1)
        sources = {k: net.arc(s, index[k], int(n * scale)) for k, n in supply.items()}
        inner = {(k, j): net.arc(index[k], len(names) + j, int(supply[k] * scale)) for j, d in enumerate(demand) for k in sorted(d[1])}
        ends = [net.arc(len(names) + j, t, int(w * scale)) for j, w in enumerate(wanted)]
        for (k, j), x in parts.items():  # what is served already stays
            for e in (sources[k], inner[k, j], ends[j]):
                net.room[e] -= int(x * scale)
                net.room[e ^ 1] += int(x * scale)
        net.run(s, t)
        parts = {kj: Fraction(net.flow(e), scale) for kj, e in inner.items() if net.flow(e)}
        got = [Fraction(net.flow(e), scale) for e in ends]
        if stage == 0:
            floor = got
        elif got == wanted:
            break
        else:
            most = [g if g < w else m for g, w, m in zip(got, wanted, most)]
    return {(k, demand[j][0]): x for (k, j), x in parts.items()}


class MinCostFlow:
    """Minimum-cost flow by shortest augmenting paths with potentials; costs must not be negative."""

    def __init__(self, nodes: int):
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []
        self.out: list[list[int]] = [[] for _ in range(nodes)]

    def arc(self, a: int, b: int, capacity: int, cost: int) -> int:
        for x, y, c, w in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def flow(self, arc: int) -> int:
        return self.room[arc ^ 1]

    def run(self, s: int, t: int) -> tuple[int, int]:
        """As much flow as possible, at the least cost; (flow, cost)."""
        potential = [0] * len(self.out)
        total = cost = 0
        while True:
            far = [None] * len(self.out)
            by = [-1] * len(self.out)
            far[s] = 0
            heap = [(0, s)]
            while heap:
                d, a = heapq.heappop(heap)
                if d > far[a]:
                    continue
                for e in self.out[a]:
                    if self.room[e]:
                        x = d + self.cost[e] + potential[a] - potential[self.to[e]]
                        if far[self.to[e]] is None or x < far[self.to[e]]:
                            far[self.to[e]] = x
                            by[self.to[e]] = e
                            heapq.heappush(heap, (x, self.to[e]))
            if far[t] is None:
                return total, cost
            potential = [p + (f if f is not None else 0) for p, f in zip(potential, far)]
            path, at = [], t
            while at != s:
                path.append(by[at])
                at = self.to[by[at] ^ 1]
            least = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= least
                self.room[e ^ 1] += least
                cost += least * self.cost[e]
            total += least
