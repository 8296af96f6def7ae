"""Exact two-label segmentation by minimum cut."""

from __future__ import annotations


def label(costs: list[tuple[float, float]], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The labelling of least energy: True where a node is kept.

    ``costs[k]`` is (cost of keeping k, cost of dropping k); an edge (i, j, w) costs w where its ends
    differ. The costs are the capacities to the two terminals. Nodes whose terminal capacities
    outweigh all their edges are settled first (they are on that side in every minimum cut); what
    is left is cut by blocking flows over level graphs (Dinic) until the flow is maximal.
    """
    n = len(costs)
    lean = [drop - keep for keep, drop in costs]  # > 0: rather kept
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        if i != j and w > 0:
            near[i][j] = near[i].get(j, 0.0) + w
            near[j][i] = near[j].get(i, 0.0) + w
    out: list[bool | None] = [None] * n
    todo = list(range(n))
    while todo:
        k = todo.pop()
        if out[k] is not None or abs(lean[k]) < sum(near[k].values()):
            continue
        out[k] = lean[k] >= 0
        for j, w in near[k].items():
            lean[j] += w if out[k] else -w
            del near[j][k]
            todo.append(j)
        near[k] = {}
    rest = [k for k in range(n) if out[k] is None]
    if rest:
        side = _cut(rest, lean, near)
        for k in rest:
            out[k] = k in side
    return [bool(x) for x in out]


def _cut(nodes: list[int], lean: list[float], near: list[dict[int, float]]) -> set[int]:
    """The nodes on the source side of a minimum cut.

    Terminal capacities are excess at nodes that lean to the source and room at those that lean to
    the sink, so only paths between nodes are searched. Each round sends a blocking flow over the
    level graph; depth-first search is a loop, as paths may be long.
    """
    eps = 1e-9
    cap = {k: dict(near[k]) for k in nodes}
    excess = {k: lean[k] for k in nodes if lean[k] > eps}
    room = {k: -lean[k] for k in nodes if lean[k] < -eps}
    while True:
        level = dict.fromkeys((k for k, x in excess.items() if x > eps), 0)
        layer, depth, met = list(level), 0, False
        while layer and not met:
            met = any(room.get(k, 0.0) > eps for k in layer)
            if met:
                break
            depth += 1
            after = []
            for u in layer:
                for v, c in cap[u].items():
                    if c > eps and v not in level:
                        level[v] = depth
                        after.append(v)
            layer = after
        if not met:
            return set(level)
        arcs = {u: [v for v in cap[u] if level.get(v, -1) == level[u] + 1] for u in level}
        for start in [k for k in excess if excess[k] > eps]:
            path = [start]
            while path and excess[start] > eps:
                u = path[-1]
                if room.get(u, 0.0) > eps and level[u] == depth:
                    flow = min(excess[start], room[u], *(cap[a][b] for a, b in zip(path, path[1:])))
                    excess[start] -= flow
                    room[u] -= flow
                    back = 0
                    for i in range(len(path) - 1, 0, -1):
                        a, b = path[i - 1], path[i]
                        cap[a][b] -= flow
                        cap[b][a] += flow
                        if cap[a][b] <= eps:
                            back = i
                    if back:
                        del path[back:]
                    elif room[u] <= eps:
                        path.pop()
                    continue
                while arcs[u] and cap[u][arcs[u][-1]] <= eps:
                    arcs[u].pop()
                if arcs[u]:
                    path.append(arcs[u][-1])
                else:
                    path.pop()
                    if path:
                        arcs[path[-1]].pop()
