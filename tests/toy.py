"""Toy inputs and brute-force solutions the operators are tested against."""

import numpy as np

RNG = np.random.default_rng(5)

# every user with a few items; item 1 is rated by all, so it is the hot one
RATINGS = [(u, i, float(RNG.integers(1, 6))) for u in range(1, 13) for i in range(1, 9)
           if i == 1 or RNG.random() < 0.5]

POINTS = [(k, [float(x) for x in RNG.normal(size=3) + (1.0 if k % 2 else -1.0)], 1.0 if k % 2 else -1.0)
          for k in range(40)]

# vertex 0 is a hub, 7 has no incoming link, 8 no outgoing one
LINKS = [(0, k) for k in range(1, 7)] + [(k, 0) for k in range(1, 7)] + [(1, 2), (2, 3), (3, 1), (1, 2), (7, 0), (4, 8)]

# feature c is constant, d is sparse, e opposes a
CELLS = [(s, f, float(v)) for s in range(9) for f, v in
         (("a", s * s), ("b", 3 * s + (s % 3)), ("c", 4), ("d", s if s % 4 == 0 else 0), ("e", 1_000_000 - s * s))
         if not (f == "d" and v == 0)]


def dense(cells):
    samples = sorted({s for s, _, _ in cells})
    features = sorted({f for _, f, _ in cells})
    out = np.zeros((len(samples), len(features)))
    for s, f, v in cells:
        out[samples.index(s), features.index(f)] = v
    return samples, features, out


def pagerank(pages, links, n, damping=0.85, epsilon=1e-4, rounds=100):
    ranks = {p: 1.0 / n for p in pages}
    degree = {}
    for s, _ in links:
        degree[s] = degree.get(s, 0) + 1
    for _ in range(rounds):
        new = {}
        for s, d in links:
            if s in ranks:
                new[d] = new.get(d, 0.0) + ranks[s] / degree[s]
        new = {k: v * damping + (1 - damping) / n for k, v in new.items()}
        still = any(abs(new[k] - ranks[k]) > epsilon for k in new if k in ranks)
        ranks = new
        if not still:
            break
    return ranks


def pagerank_fixed(links, n, rounds, damping=0.85):
    degree = {}
    for s, _ in links:
        degree[s] = degree.get(s, 0) + 1
    ranks = {s: 1.0 / n for s in degree}
    for _ in range(rounds):
        new = {s: (1 - damping) / n for s in degree}
        for s, d in links:
            if s in ranks:
                new[d] = new.get(d, 0.0) + damping * ranks[s] / degree[s]
        ranks = new
    return ranks


def communities(vertices, edges, rounds, delta=0.5):
    both = [(a, b, w) for a, b, w in edges] + [(b, a, w) for a, b, w in edges]
    state = {v: (v, 1.0) for v in vertices}
    for turn in range(1, rounds + 1):
        got = {}
        for a, b, w in both:
            if a in state:
                got.setdefault(b, []).append((state[a][0], state[a][1] * w))
        new = dict(state)
        for v, messages in got.items():
            summed, best = {}, {}
            for label, score in messages:
                summed[label] = summed.get(label, 0.0) + score
                best[label] = max(best.get(label, -1e300), score)
            label = min(summed, key=lambda k: (-round(summed[k], 9), k))
            new[v] = (label, best[label] - (0.0 if label == state[v][0] else delta / turn))
        state = new
    return {v: s[0] for v, s in state.items()}


def als(ratings, start, rank, regularization, iterations):
    """``start``: item to its start vector. Gives user and item vectors."""
    def step(rows, other):
        out = {}
        for key in {k for k, _, _ in rows}:
            vs = np.array([other[o] for k, o, _ in rows if k == key])
            rs = np.array([r for k, _, r in rows if k == key])
            out[key] = np.linalg.solve(vs.T @ vs + regularization * len(rs) * np.eye(rank), vs.T @ rs)
        return out

    turned = [(i, u, r) for u, i, r in ratings]
    items = start
    for _ in range(iterations):
        items = step(turned, step(ratings, items))
    return step(ratings, items), items
