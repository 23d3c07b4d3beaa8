"""Two-label minimum cut over the blocks of a page."""

from __future__ import annotations

from collections import deque


def decided(keep: list[float], drop: list[float], near: list[dict[int, float]]) -> list[int]:
    """1, 0, or -1 (open) by dominance: a node that gains more from one label than all its open edges could cost.

    Its label holds in a minimum cut, so its edges turn into terminal capacities of its neighbours; exact and linear.
    """
    label = [-1] * len(keep)
    lean = [k - d for k, d in zip(keep, drop)]
    loose = [sum(e.values()) for e in near]
    queue = deque(range(len(keep)))
    while queue:
        i = queue.popleft()
        if label[i] >= 0 or abs(lean[i]) < loose[i] or (lean[i] == 0 and loose[i] == 0 and near[i] and any(label[j] < 0 for j in near[i])):
            continue
        label[i] = int(lean[i] >= 0)
        for j, w in near[i].items():
            if label[j] < 0:
                lean[j] += w if label[i] else -w
                loose[j] -= w
                queue.append(j)
    return label


def cut(keep: list[float], drop: list[float], edges: dict[tuple[int, int], float]) -> list[int]:
    """Labels (1: keep) with the least total cost: keep[i] is paid for label 0, drop[i] for label 1, an edge's weight
    if its ends differ. Ties keep. Dominated nodes are fixed first; Dinic's maximum flow decides the rest."""
    near: list[dict[int, float]] = [{} for _ in keep]
    for (i, j), w in edges.items():
        near[i][j] = near[i].get(j, 0) + w
        near[j][i] = near[j].get(i, 0) + w
    label = decided(keep, drop, near)
    rest = [i for i, x in enumerate(label) if x < 0]
    if not rest:
        return label
    at = {i: k for k, i in enumerate(rest)}
    source, sink = len(rest), len(rest) + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(sink + 1)]

    def arc(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(forth)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i in rest:
        lean = keep[i] - drop[i]
        for j, w in near[i].items():
            if label[j] >= 0:
                lean += w if label[j] else -w
            elif i < j:
                arc(at[i], at[j], w, w)
        if lean > 0:
            arc(source, at[i], lean, 0)
        elif lean < 0:
            arc(at[i], sink, -lean, 0)
    tiny = 1e-12
    while True:
        level = [-1] * (sink + 1)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            break
        turn = [0] * (sink + 1)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                k = next(k for k, e in enumerate(path) if room[e] <= tiny)
                a = to[path[k] ^ 1]
                del path[k:]
            elif turn[a] < len(out[a]):
                e = out[a][turn[a]]
                if room[e] > tiny and level[to[e]] == level[a] + 1:
                    path.append(e)
                    a = to[e]
                else:
                    turn[a] += 1
            elif path:
                a = to[path.pop() ^ 1]
                turn[a] += 1
            else:
                break
    # the largest keep side: all that cannot reach the sink
    reach = [False] * (sink + 1)
    reach[sink] = True
    queue = deque([sink])
    while queue:
        b = queue.popleft()
        for e in out[b]:
            if room[e ^ 1] > tiny and not reach[to[e]]:
                reach[to[e]] = True
                queue.append(to[e])
    for i in rest:
        label[i] = int(not reach[at[i]])
    return label
