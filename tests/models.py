"""The operators as plain sequential Python, for small inputs."""

from __future__ import annotations

import numpy as np


def cosine(a, b) -> float:
    a, b = np.asarray(a, float), np.asarray(b, float)
    scale = np.sqrt(a @ a) * np.sqrt(b @ b)
    return round(float(a @ b / scale), 12) if scale else float("nan")


def ingest(topics, entries, contents, stored, threshold=0.75, link=True):
    """Entries one after the other: (resolution, links, added contents).

    topics {id: vector}; entries [(ord, vector)] in order; contents {ord: [text]};
    stored {(topic, text)}.
    """
    known = [(t, v, -1) for t, v in sorted(topics.items())]
    resolved, links, added = {}, {}, []
    stored = set(stored)
    for ord_, vector in entries:
        if not contents.get(ord_):
            continue
        scored = [(cosine(vector, v), -o, t) for t, v, o in known]
        scored = [s for s in scored if not np.isnan(s[0])]
        best = min(scored, key=lambda s: (-s[0], -s[1], s[2])) if scored else None
        if best and best[0] > 0.9:
            home = best[2]
            resolved[ord_] = (home, False)
        else:
            home = f"new{ord_}"
            known.append((home, vector, ord_))
            resolved[ord_] = (home, True)
            if link and best and best[0] > threshold:
                links[(best[2], home)] = best[0]
        fresh = [c for c in contents[ord_] if (home, c) not in stored]
        added += [(ord_, home, c) for c in fresh]
        stored |= {(home, c) for c in fresh}
    return resolved, links, added


def bfs(query, topics, edges, min_weight=0.2, max_depth=5, dropped=frozenset()):
    """A queue of topics: (visited {id: (depth, strength, score)}, order, traversed edges).

    topics {id: (vector, strength)}; edges {(from, to): weight}.
    """
    nearest = sorted(topics, key=lambda t: (-cosine(query, topics[t][0]), t))[:3]
    queue = [(t, 0, cosine(query, topics[t][0])) for t in nearest]
    visited, order, traversed = {}, [], []
    while queue:
        topic, depth, path = queue.pop(0)
        if topic in visited or depth > max_depth:
            continue
        visited[topic] = (depth, path, cosine(query, topics[topic][0]) * topics[topic][1] * path)
        order.append(topic)
        out = sorted(((w, b) for (a, b), w in edges.items() if a == topic and w >= min_weight),
                     key=lambda e: (-e[0], e[1]))[:8]
        for weight, target in out:
            if (topic, target) in dropped:
                continue
            traversed.append((topic, target))
            queue.append((target, depth + 1, path * weight))
    return visited, order, traversed


def merge(pairs):
    """Pairs (id1, id2), best first, applied one by one: {merged: kept}."""
    home, gone = {}, set()
    nodes = {n for p in pairs for n in p}
    home = {n: n for n in nodes}
    alive = set(nodes)
    parent = {}
    for a, b in pairs:
        if b in gone:
            continue
        gone.add(b)
        alive.discard(b)
        parent[b] = a
    for n in nodes:
        at = n
        while at in parent:
            at = parent[at]
        home[n] = at
    return {n: home[n] for n in gone}


def dbscan(points, eps, min_samples):
    """points {id: vector} -> {id: (is_core, cluster or None)}; expansion in id order."""
    ids = sorted(points)
    near = {a: [b for b in ids if 1.0 - cosine(points[a], points[b]) <= eps] for a in ids}
    core = {a for a in ids if len(near[a]) >= min_samples}
    label = {}
    for a in ids:
        if a in label or a not in core:
            continue
        label[a] = a
        stack = [a]
        while stack:
            at = stack.pop()
            for b in near[at] if at in core else []:
                if b not in label:
                    label[b] = a
                    stack.append(b)
    return {a: (a in core, label.get(a)) for a in ids}
