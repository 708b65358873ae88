"""The fitted machine against a plain one."""

import math

import numpy as np

from restgrid.llm import toxicity


def plain_fit(texts, y, steps):
    """Adam on the mean logistic loss, by loops over pairs of a text's buckets."""
    n, used = len(y), sorted({c for t in texts for c in t})
    share = sum(y) / n
    value = {}
    for c in used:
        have, toxic = sum(c in t for t in texts), sum(v for t, v in zip(texts, y) if c in t)
        apart = (toxic - have * share) ** 2 / (have * share) / (1 - share)
        value[c] = apart / (apart + toxicity.CALM)
    rng = np.random.default_rng(toxicity.SEED)
    start = rng.normal(0, 0.01, (toxicity.BUCKETS, toxicity.FACTORS))
    p = {("w", c): 0.0 for c in used if value[c] > 0} | {("v", c, f): start[c, f] for c in used if value[c] > 0 for f in range(toxicity.FACTORS)}
    p["b"] = math.log((sum(y) + 0.5) / (n - sum(y) + 0.5))
    first, second, order = dict.fromkeys(p, 0.0), dict.fromkeys(p, 0.0), []
    for t in range(1, steps + 1):
        if len(order) < min(toxicity.BATCH, n):
            order = list(rng.permutation(n))
        some, order = order[: toxicity.BATCH], order[toxicity.BATCH :]
        grad = {k: 0.0 if k == "b" else 1e-5 * x for k, x in p.items()}
        for i in some:
            own = [c for c in texts[i] if value[c] > 0]
            z = p["b"] + sum(p["w", c] * value[c] for c in own)
            for a, c in enumerate(own):
                for d in own[a + 1 :]:
                    z += value[c] * value[d] * sum(p["v", c, f] * p["v", d, f] for f in range(toxicity.FACTORS))
            g = (1 / (1 + math.exp(-z)) - y[i]) / len(some)
            grad["b"] += g
            for c in own:
                grad["w", c] += g * value[c]
                for f in range(toxicity.FACTORS):
                    grad["v", c, f] += g * value[c] * sum(value[d] * p["v", d, f] for d in own if d != c)
        for k in p:
            first[k] = 0.9 * first[k] + 0.1 * grad[k]
            second[k] = 0.99 * second[k] + 0.01 * grad[k] ** 2
            p[k] -= toxicity.RATE * (first[k] / (1 - 0.9**t)) / (math.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)
    return p, value


def test_fit_is_the_plain_one():
    r = np.random.default_rng(5)
    texts = [sorted({int(c) for c in r.integers(0, 12, 6)} | ({70, 71} if i % 4 == 0 else {70} if i % 4 == 1 else {71})) for i in range(40)]
    y = np.array([float(i % 4 == 0) for i in range(40)])
    rows = np.repeat(np.arange(40), [len(t) for t in texts])
    w, v, b = toxicity._fit(rows, np.concatenate(texts), y, steps=25)
    p, value = plain_fit(texts, y.tolist(), 25)
    assert abs(b - p["b"]) < 1e-9
    for c in {c for t in texts for c in t}:
        assert abs(w[c] - p.get(("w", c), 0.0) * value[c]) < 1e-9
        for f in range(toxicity.FACTORS):
            assert abs(v[c, f] - p.get(("v", c, f), 0.0) * value[c]) < 1e-9
    assert not w[100:].any()


def test_pairs_are_learned():
    """An insult and a group are harmless alone: only their pair is marked, which no sum of weights can tell."""
    r = np.random.default_rng(6)
    texts = [sorted({int(c) for c in r.integers(0, 30, 8)} | [{70, 71}, {70}, {71}, set()][i % 4]) for i in range(1200)]
    y = np.array([float(i % 4 == 0) for i in range(1200)])
    w, v, b = toxicity._fit(np.repeat(np.arange(1200), [len(t) for t in texts]), np.concatenate(texts), y)
    score = lambda t: b + sum(w[c] for c in t) + sum(float(v[c] @ v[d]) for k, c in enumerate(t) for d in t[k + 1 :])
    assert all((score(t) > 0) == bool(v_) for t, v_ in zip(texts, y))
    assert float(v[70] @ v[71]) > 0
