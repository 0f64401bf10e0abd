"""The learned operators against the same models written plainly."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from defectlake.llm import langid, quality
from tests.llm.conftest import words


def _plain_measures(text: str) -> list[float]:
    raw = text.encode()
    size = max(1, len(raw))
    kinds = [rb"[a-z\x80-\xff]", rb"[A-Z]", rb"[0-9]", rb"[.,;:'\"\-()?]"]
    shares = [len(re.findall(k, raw)) / size for k in kinds]
    spaces = len(re.findall(rb"[\t\n\x0b\x0c\r ]", raw))
    symbol = re.compile(rb"[^\t\n\x0b\x0c\r a-zA-Z0-9\x80-\xff.,;:'\"\-()?]")
    tokens = re.findall(rb"[^\x20\x09-\x0d]+", raw)
    n = max(1, len(tokens))
    lines = [x for x in raw.split(b"\n") if x]
    return [
        *shares, (len(raw) - spaces) / size - sum(shares), math.log1p(len(tokens)), math.log1p(sum(map(len, tokens)) / n), sum(len(t) > 12 for t in tokens) / n, sum(len(t) < 4 for t in tokens) / n,
        math.log1p(len(set(tokens))) / math.log1p(n), sum(bool(symbol.search(t)) for t in tokens) / n, sum(2 * len(re.findall(rb"[A-Z]", t)) > len(t) for t in tokens) / n,
        math.log1p(size / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)),
    ]


def _plain_scores(texts: list[str], labels: dict[int, int]) -> list[float]:
    """Bradley-Terry by gradient steps over preference pairs, one pair at a time in the sums."""
    x = [_plain_measures(t) for t in texts]
    rows = sorted(((labels[i], x[i]) for i in labels if zlib.crc32(str(i).encode()) % 4 != 2), key=lambda r: (r[0], r[1][::-1]))
    dims = len(x[0])
    mean = [sum(r[1][k] for r in rows) / len(rows) for k in range(dims)]
    scale = [math.sqrt(sum((r[1][k] - mean[k]) ** 2 for r in rows) / len(rows)) + 1e-9 for k in range(dims)]

    def features(v):
        z = [min(8.0, max(-8.0, (v[k] - mean[k]) / scale[k])) for k in range(dims)]
        return z + [a * a / 8 for a in z]

    z = [features(r[1]) for r in rows]
    good, bad = [i for i, r in enumerate(rows) if r[0] == 1], [i for i, r in enumerate(rows) if r[0] == 0]
    draw = np.random.default_rng(7)
    pairs = quality.PAIRS_EACH * len(rows)
    left, right = draw.choice(good, pairs), draw.choice(bad, pairs)
    d = np.array([[a - b for a, b in zip(z[i], z[j], strict=True)] for i, j in zip(left, right, strict=True)])
    w, m, v = np.zeros(2 * dims), np.zeros(2 * dims), np.zeros(2 * dims)
    for step in range(1, quality.STEPS + 1):
        wrong = 1 / (1 + np.exp(d @ w))  # how sure the model is of the wrong one
        slope = -(d * wrong[:, None]).mean(0) + quality.L2 * w
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope * slope
        w = w - quality.RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    of = lambda f: sum(a * b for a, b in zip(f, w, strict=True))
    cut = float(np.quantile([of(f) for f in z], len(bad) / len(rows)))
    return [1 / (1 + math.exp(-(of(features(v)) - cut + math.log(0.7 / 0.3)))) for v in x]


def test_quality_equals_a_plain_fit(spark):
    draw = random.Random(21)
    texts = []
    for i in range(90):
        body = words(draw, draw.randint(1, 60))
        body = [t.upper() if draw.random() < 0.3 * (i % 3) else t + draw.choice(["", "", ".", "$$", "é7"]) for t in body]
        texts.append("".join(t + draw.choice([" ", " ", "\n", "\n\n"]) for t in body))
    texts += ["", "  \n ", "x" * 300]
    labels = {i: int(draw.random() < 0.8 - 0.3 * (i % 3)) for i in range(80)}
    want = _plain_scores(texts, labels)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in quality.classify(table, spark.createDataFrame(list(labels.items()), "doc_id long, quality int")).collect():
        assert r.score == pytest.approx(want[r.doc_id], abs=1e-5)
        assert r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_quality_without_labels(spark):
    """Nothing is learned: every document has the score of the threshold and is accepted."""
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    for labels in ([], [(1, 1)], [(1, None), (2, 5)]):
        found = quality.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
        assert [(round(r.score, 12), r.predicted) for r in found] == [(0.7, 1)] * 2


def _plain_grams(text: str) -> list[int]:
    low = "".join(c if c.isalpha() else " " for c in text.lower())
    points = [ord(c) for c in re.sub(" +", " ", low)]
    out = []
    for n in langid.SIZES:
        for at in range(len(points) - n + 1):
            h = n * int(langid._FACTORS[4]) % 2**32
            for k in range(n):
                h = (h ^ points[at + k]) * int(langid._FACTORS[k]) % 2**32
                h ^= h >> 15
            out.append(h >> (32 - langid.BUCKET_BITS))
    return out


def test_language_equals_plain_posteriors(spark):
    draw = random.Random(22)
    sets = {"aa": ["ka", "to", "ri", "é"], "bb": ["schl", "ung", "ei", "ß"], "cc": ["ou", "tion", "ka", "漢"]}
    rows = [(i, "".join(draw.choice(sets[lang]) + draw.choice(["", "", " ", ", 7 "]) for _ in range(draw.randint(1, 9))).title(), lang) for i, lang in enumerate(draw.choices(sorted(sets), k=80))]
    rows += [(80, "KA to", None), (81, "...", "aa"), (82, None, "aa"), (83, "", "bb")]
    grams, texts = {lang: Counter() for lang in sets}, Counter()
    for i, text, lang in rows:
        if lang and text is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            grams[lang].update(_plain_grams(text))
            texts[lang] += 1
    for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect():
        text = rows[r.doc_id][1]
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        logs = {lang: math.log(texts[lang] / sum(texts.values())) + sum(math.log((c[g] + langid.SMOOTHING) / (sum(c.values()) + langid.SMOOTHING * langid.BUCKETS)) for g in _plain_grams(text)) for lang, c in grams.items()}
        best = max(sorted(logs), key=logs.get)
        share = 1 / sum(math.exp(v - logs[best]) for v in logs.values())
        assert r.score == pytest.approx(share, abs=1e-4) and (r.lang_pred == best or share < 0.51)
