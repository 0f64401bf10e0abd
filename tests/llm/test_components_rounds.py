"""Stars are known as such; no round is spent on them."""

import random

from defectlake.llm import components as c


def _roots(pairs):
    root = {n: n for e in pairs if None not in e and e[0] != e[1] for n in e}
    for _ in root:
        for u, v in pairs:
            if u in root and v in root:
                root[u] = root[v] = min(root[u], root[v])
    return root


def test_rounds_end_with_stars(spark, monkeypatch):
    rounds, plain = [], c._small_star
    monkeypatch.setattr(c, "_small_star", lambda *x: rounds.append(1) or plain(*x))
    draw = random.Random(31)
    stars = [(i, i // 10 * 10) for i in range(400)] + [(5, 0), (None, 3), (3, None)]
    chain = [(i, i + 1) for i in range(60)]
    mixed = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)]
    for pairs, most in ((stars, 0), ([], 0), ([(7, 7)], 0), (chain, 12), (mixed, 12), ([(1, 3), (2, 3)], 1)):
        rounds.clear()
        found = c.components(spark.createDataFrame(pairs, "u long, v long")).collect()
        assert len(found) == len({r.node for r in found}) and {r.node: r.root for r in found} == _roots(pairs)
        assert len(rounds) <= most
