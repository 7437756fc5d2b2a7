"""SQL text for the check of operators that need more than one plain statement."""

from __future__ import annotations

from ..functions.numbers import UNIFORM_SPAN


def uniform(identity: str, index: int | str, seed: int) -> str:
    key = f"CAST(CAST({identity} AS BIGINT) AS VARCHAR) || ':' || CAST({index} AS VARCHAR) || ':{seed}'"
    return f"(CAST(('0x' || substr(md5({key}), 1, 12)) AS BIGINT) / CAST({UNIFORM_SPAN} AS DOUBLE))"


def gaussian(identity: str, index: str, seed: int) -> str:
    return (f"(sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {uniform(identity, index, seed)}))"
            f" * cos(2 * pi() * {uniform(identity, f'({index} + 1)', seed)}))")


def dense(source: str, name: str, where: str = "TRUE") -> list[tuple[str, str]]:
    """``name``: all samples by all features of ``source``, zero-filled."""
    return [
        (f"{name}_cells", f"SELECT sample_id, feature, value FROM {source} WHERE {where}"),
        (name, f"""SELECT s.sample_id, f.feature, COALESCE(c.value, 0.0::DOUBLE) AS value
            FROM (SELECT DISTINCT sample_id FROM {name}_cells) s
            CROSS JOIN (SELECT DISTINCT feature FROM {name}_cells) f
            LEFT JOIN {name}_cells c ON c.sample_id = s.sample_id AND c.feature = f.feature"""),
    ]


def pair_stats(source: str, name: str) -> list[tuple[str, str]]:
    """``name``: cross and correlation of every unordered feature pair of a dense matrix."""
    return [(name, f"""
        SELECT a.feature AS feature_a, b.feature AS feature_b,
               covar_pop(a.value, b.value) * COUNT(*) AS cross_sum,
               covar_pop(a.value, b.value)
                 / nullif(stddev_pop(a.value) * stddev_pop(b.value), 0) AS correlation
        FROM {source} a JOIN {source} b ON a.sample_id = b.sample_id AND a.feature <= b.feature
        GROUP BY 1, 2""")]


def network(pairs: str, name: str, threshold: float) -> list[tuple[str, str]]:
    hit = f"abs(round(correlation, 9)) > {threshold}"
    return [(name, f"""
        SELECT feature_a AS src, feature_b AS dst FROM {pairs} WHERE {hit}
        UNION SELECT feature_b, feature_a FROM {pairs} WHERE {hit}""")]


def pagerank(name: str, pages: str, links: str, n_pages: str, epsilon: float = 1e-4,
             max_rounds: int = 100, damping: float = 0.85) -> list[tuple[str, str]]:
    """``name``(id, rank) by rounds until no rank moves by more than epsilon. Needs RECURSIVE."""
    base = f"(1.0::DOUBLE - {damping}::DOUBLE) / {n_pages}"
    return [
        (f"{name}_degree", f"SELECT src, COUNT(*) AS degree FROM {links} GROUP BY 1"),
        (f"{name}_rounds(t, id, rank, moved) AS", f"""
            SELECT 0, id, 1.0::DOUBLE / {n_pages}, 1.0::DOUBLE FROM {pages}
            UNION ALL
            SELECT t + 1, id, rank, MAX(abs(rank - before)) OVER () FROM (
              SELECT t, id, SUM(part) * {damping}::DOUBLE + {base} AS rank, MAX(before) AS before FROM (
                SELECT r.t, e.dst AS id, r.rank / d.degree AS part, NULL::DOUBLE AS before
                FROM {name}_rounds r JOIN {links} e ON e.src = r.id JOIN {name}_degree d ON d.src = r.id
                WHERE r.moved > {epsilon}
                UNION ALL
                SELECT r.t, r.id, NULL::DOUBLE, r.rank FROM {name}_rounds r WHERE r.moved > {epsilon})
              GROUP BY t, id HAVING SUM(part) IS NOT NULL)
            WHERE t < {max_rounds}"""),
        (name, f"SELECT id, rank FROM {name}_rounds WHERE t = (SELECT MAX(t) FROM {name}_rounds)"),
    ]


def pagerank_fixed(name: str, nodes: str, links: str, n_nodes: str, rounds: int,
                   damping: float = 0.85) -> list[tuple[str, str]]:
    """``name``_k(id, rank) after each round k; ``name`` after the last."""
    parts = [(f"{name}_degree", f"SELECT src, COUNT(*) AS degree FROM {links} GROUP BY 1"),
             (f"{name}_0", f"SELECT id, 1.0::DOUBLE / {n_nodes} AS rank FROM {nodes}")]
    for k in range(1, rounds + 1):
        parts.append((f"{name}_{k}", f"""
            SELECT id, SUM(part) AS rank FROM (
              SELECT e.dst AS id, r.rank * {damping}::DOUBLE / d.degree AS part
              FROM {name}_{k - 1} r JOIN {links} e ON e.src = r.id JOIN {name}_degree d ON d.src = r.id
              UNION ALL SELECT id, (1.0::DOUBLE - {damping}::DOUBLE) / {n_nodes} FROM {nodes})
            GROUP BY 1"""))
    return parts + [(name, f"SELECT * FROM {name}_{rounds}")]


def communities(name: str, vertices: str, edges: str, rounds: int, delta: float = 0.5) -> list[tuple[str, str]]:
    """``name``(id, label, score) after the rounds."""
    parts = [
        (f"{name}_links", f"""
            SELECT src, dst, SUM(weight) AS weight, MAX(weight) AS greatest_w, MIN(weight) AS least_w
            FROM (SELECT src, dst, weight FROM {edges} UNION ALL SELECT dst, src, weight FROM {edges})
            GROUP BY 1, 2"""),
        (f"{name}_0", f"SELECT id, value AS label, 1.0::DOUBLE AS score FROM {vertices}"),
    ]
    for k in range(1, rounds + 1):
        parts += [
            (f"{name}_votes_{k}", f"""
                SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(summed, 9) DESC, label) AS place
                FROM (SELECT e.dst AS id, s.label, SUM(s.score * e.weight) AS summed,
                             MAX(greatest(s.score * e.greatest_w, s.score * e.least_w)) AS best
                      FROM {name}_{k - 1} s JOIN {name}_links e ON e.src = s.id GROUP BY 1, 2)"""),
            (f"{name}_{k}", f"""
                SELECT s.id, COALESCE(v.label, s.label) AS label,
                       CASE WHEN v.id IS NULL THEN s.score
                            WHEN v.label = s.label THEN v.best
                            ELSE v.best - {delta}::DOUBLE / {k} END AS score
                FROM {name}_{k - 1} s
                LEFT JOIN (SELECT * FROM {name}_votes_{k} WHERE place = 1) v ON v.id = s.id"""),
        ]
    return parts + [(name, f"SELECT id, label, score FROM {name}_{rounds}")]


def als_start(name: str, ids: str, rank: int, seed: int) -> list[tuple[str, str]]:
    columns = ", ".join(f"{uniform('id', k, seed)} AS f{k}" for k in range(rank))
    return [(name, f"SELECT id, {columns} FROM ({ids})")]


def als_step(name: str, ratings: str, user: str, item: str, factors: str, regularization: float) -> list[tuple[str, str]]:
    """One half step of rank 2, solved by Cramer's rule."""
    return [
        (f"{name}_sums", f"""
            SELECT r."{user}" AS id, COUNT(*) AS n, SUM(v.f0 * v.f0) AS g00, SUM(v.f0 * v.f1) AS g01,
                   SUM(v.f1 * v.f1) AS g11, SUM(r.rating * v.f0) AS b0, SUM(r.rating * v.f1) AS b1
            FROM {ratings} r JOIN {factors} v ON v.id = r."{item}" GROUP BY 1"""),
        (name, f"""
            SELECT id, (b0 * a11 - g01 * b1) / det AS f0, (a00 * b1 - g01 * b0) / det AS f1
            FROM (SELECT *, a00 * a11 - g01 * g01 AS det
                  FROM (SELECT *, g00 + {regularization}::DOUBLE * n AS a00,
                               g11 + {regularization}::DOUBLE * n AS a11 FROM {name}_sums))"""),
    ]


def als(ratings: str, iterations: int, regularization: float, seed: int) -> list[tuple[str, str]]:
    """``users`` and ``items`` of rank 2 after the iterations and the last user update."""
    parts = als_start("items_0", f"SELECT DISTINCT item AS id FROM {ratings}", 2, seed)
    for k in range(1, iterations + 1):
        parts += als_step(f"users_{k}", ratings, "user", "item", f"items_{k - 1}", regularization)
        parts += als_step(f"items_{k}", ratings, "item", "user", f"users_{k}", regularization)
    parts += als_step("users", ratings, "user", "item", f"items_{iterations}", regularization)
    return parts + [("items", f"SELECT * FROM items_{iterations}")]


def gradient(points: str, size: int, rounds: int, stepsize: float) -> list[tuple[str, str]]:
    """``w``: the weights w0.. and the intercept after the rounds of gradient descent."""
    names = [f"w{j}" for j in range(size + 1)]
    parts = [("w_0", "SELECT " + ", ".join(f"0.0::DOUBLE AS {c}" for c in names))]
    for k in range(1, rounds + 1):
        fitted = " + ".join([f"w{j} * x{j}" for j in range(size)] + [f"w{size}"])
        grads = ", ".join([f"SUM(r * x{j}) / COUNT(*) AS g{j}" for j in range(size)] + [f"SUM(r) / COUNT(*) AS g{size}"])
        moved = ", ".join(f"w{j} - {stepsize}::DOUBLE / sqrt({k}.0::DOUBLE) * g{j} AS w{j}" for j in range(size + 1))
        parts += [(f"g_{k}", f"SELECT {grads} FROM (SELECT *, {fitted} - y AS r FROM {points}, w_{k - 1})"),
                  (f"w_{k}", f"SELECT {moved} FROM w_{k - 1}, g_{k}")]
    return parts + [("w", f"SELECT * FROM w_{rounds}")]


def dual_ascent(points: str, size: int, seed: int, blocks: int, outer: int, inner: int, regularization: float,
                scaling: float) -> list[tuple[str, str]]:
    """``trained``(pos, weight): all rounds and steps unrolled; a block's local weights and moves are lists."""
    strength = f"({regularization}::DOUBLE * (SELECT COUNT(*) FROM {points}))"
    dot = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"
    parts = [
        ("placed", f"""SELECT row_number() OVER (ORDER BY index % {blocks}, index) AS place, index % {blocks} AS block, data, label FROM {points}"""),
        ("spans", "SELECT block, MIN(place) AS first, COUNT(*) AS n FROM placed GROUP BY 1"),
        ("w_0", f"SELECT list_transform(range({size}), lambda i: 0.0::DOUBLE) AS w"),
        ("duals_0", "SELECT 0::BIGINT AS place, 0.0::DOUBLE AS alpha WHERE FALSE"),
    ]
    for t in range(outer):
        parts.append((f"s_{t}_0", f"""SELECT block, w, CAST([] AS STRUCT(place BIGINT, delta DOUBLE)[]) AS moves FROM spans, w_{t}"""))
        for k in range(inner):
            drawn = f"b.first + CAST(floor({uniform('b.block', t * inner + k, seed)} * b.n) AS BIGINT)"
            parts.append((f"s_{t}_{k + 1}", f"""
                SELECT block, list_transform(list_zip(w, data), lambda z: z[1] + factor * z[2]) AS w,
                       list_append(moves, {{'place': place, 'delta': new - now}}) AS moves
                FROM (SELECT *, label * (new - now) / {strength} AS factor FROM (SELECT *, CASE WHEN grad = 0 THEN now WHEN square = 0 THEN 1.0::DOUBLE
                                     ELSE greatest(least(now - grad / square, 1.0::DOUBLE), 0.0::DOUBLE) END AS new
                      FROM (SELECT s.block, s.w, s.moves, p.place, p.data, p.label,
                                   COALESCE(d.alpha, 0) + COALESCE(list_sum(list_transform(list_filter(s.moves, lambda m: m.place = p.place), lambda m: m.delta)), 0) AS now,
                                   (p.label * {dot.format(a='p.data', b='s.w')} - 1.0::DOUBLE) * {strength} AS grad,
                                   {dot.format(a='p.data', b='p.data')} AS square
                            FROM s_{t}_{k} s JOIN spans b ON b.block = s.block JOIN placed p ON p.place = {drawn}
                            LEFT JOIN duals_{t} d ON d.place = p.place)))"""))
        share = f"{scaling}::DOUBLE / {blocks}"
        parts += [
            (f"duals_{t + 1}", f"""SELECT place, SUM(alpha) AS alpha FROM (SELECT * FROM duals_{t} UNION ALL
                SELECT m.place, {share} * m.delta FROM (SELECT unnest(moves) AS m FROM s_{t}_{inner})) GROUP BY 1"""),
            (f"w_{t + 1}", f"""SELECT list(v ORDER BY i) AS w FROM (
                SELECT i, MAX(o.w[i]) + {share} * SUM(s.w[i] - o.w[i]) AS v FROM s_{t}_{inner} s, w_{t} o, (SELECT unnest(range(1, {size + 1})) AS i) GROUP BY i)"""),
        ]
    return parts + [("trained", f"SELECT unnest(range({size})) AS pos, unnest(w) AS weight FROM w_{outer}")]
