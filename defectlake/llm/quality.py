"""A quality classifier by Bradley-Terry pairwise ranking.

Each document gets a vector of text measures. Weights are learned from preference pairs, a
document labelled 1 over one labelled 0, by the logistic loss of the difference of their
scores. The threshold is a quantile of the scores of the labelled documents: the share that
is labelled 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from defectlake.llm import text as tx
from defectlake.llm.langid import held_out
from defectlake.llm.scratch import keep

#: Labelled rows that the fit looks at, about so many at most, by hash. The threshold comes from all.
MAX_LABELLED = 20_000
#: Scores that are sorted in one place; of more, counts of ranges lead to the few that matter.
FEW = 100_000
#: Preference pairs per document of the fit.
PAIRS_EACH = 20
STEPS = 400
RATE = 0.1
L2 = 1e-4
#: The score at the threshold.
ACCEPT = 0.7

_KIND = np.full(256, 5)
_KIND[[*b"\t\n\v\f\r "]] = 0
_KIND[[*range(97, 123), *range(128, 256)]] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[[*b".,;:'\"-()?"]] = 4
MEASURES = ("lower", "upper", "digit", "point", "symbol", "words", "word_length", "long_words", "short_words", "distinct", "odd_words", "upper_words", "line_length", "repeat_lines")


def _per_text(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` from first[i] to first[i + 1]."""
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return sums[first[1:]] - sums[first[:-1]]


def _measures(part: tx.Texts) -> np.ndarray:
    kind = _KIND[part.data]
    size = np.maximum(np.diff(part.offsets), 1)
    share = [_per_text(part.offsets, kind == k) / size for k in (1, 2, 3, 4, 5)]
    starts, ends, first = tx.word_spans(part, tx.NOT_SPACE)
    words = np.diff(first)
    n = np.maximum(words, 1)
    lengths = ends - starts
    zero = np.zeros(1)
    symbols = np.concatenate([zero, np.cumsum(kind == 5)])
    uppers = np.concatenate([zero, np.cumsum(kind == 2)])
    odd = (symbols[ends] - symbols[starts]) > 0
    shouting = (uppers[ends] - uppers[starts]) * 2 > lengths
    hashes = tx.word_hashes(part.data, starts, ends)
    distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(first[:-1], first[1:], strict=True)])
    not_break = np.ones(256, bool)
    not_break[10] = False
    l_starts, l_ends, l_first = tx.word_spans(part, not_break)
    l_hashes = tx.word_hashes(part.data, l_starts, l_ends)
    lines = np.diff(l_first)
    other = np.array([len(np.unique(l_hashes[a:b])) for a, b in zip(l_first[:-1], l_first[1:], strict=True)])
    m = np.maximum(lines, 1)
    return np.stack([
        *share, np.log1p(words), np.log1p(_per_text(first, lengths) / n), _per_text(first, lengths > 12) / n, _per_text(first, lengths < 4) / n,
        np.log1p(distinct) / np.log1p(n), _per_text(first, odd) / n, _per_text(first, shouting) / n, np.log1p(size / m), 1 - other / m,
    ], 1)


def measures(docs: DataFrame) -> DataFrame:
    """(doc_id, x array<double>) per row, from the whole text; a null text is empty."""

    def run(batches):
        for batch in batches:
            for lo, hi, part in tx.chunks(tx.column_texts(batch.column(1))):
                rows = _measures(part)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))], ["doc_id", "x"])

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, x array<double>")


class Model:
    """Standardised measures and their squares under learned weights, and the threshold."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7):
        self.mean, self.scale, self.weights, self.cut = np.zeros(len(MEASURES)), np.ones(len(MEASURES)), np.zeros(2 * len(MEASURES)), 0.0
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        if not len(good) or not len(bad):
            return
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = self._features(x)
        draw = np.random.default_rng(seed)
        pairs = PAIRS_EACH * len(x)
        d = z[draw.choice(good, pairs)] - z[draw.choice(bad, pairs)]
        m, v = np.zeros(d.shape[1]), np.zeros(d.shape[1])
        for step in range(1, STEPS + 1):
            p = 1 / (1 + np.exp(np.clip(d @ self.weights, -50, 50)))
            grad = -(p @ d) / pairs + L2 * self.weights
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            self.weights -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def _features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([z, z * z / 8], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self._features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, and ACCEPT exactly at the threshold."""
        over = self.raw(x) - self.cut
        return np.where(over == 0, ACCEPT, 1 / (1 + np.exp(-np.clip(over + np.log(ACCEPT / (1 - ACCEPT)), -50, 50))))


def learn(measured: DataFrame, labels: DataFrame) -> Model:
    """The model from the labelled rows (doc_id, quality) that are not held out.

    About MAX_LABELLED rows at most, by hash, reach the driver: vectors of fixed length. Of equal
    rows as many as are their share. The threshold is the quantile of the scores of all labelled rows.
    Labels other than 0 and 1 are ignored; of several labels of a document each counts; without both
    labels every score is ACCEPT.
    """
    label = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)").where(~held_out(2, 4))
    labelled = keep(measured.join(label, "doc_id").select("doc_id", "x", "quality"), "labelled")
    total, bad = labelled.agg(F.count("*"), F.count_if(F.col("quality") == 0)).first()
    wanted = F.col("n") * min(1.0, MAX_LABELLED / max(1, total))
    chance = F.pmod(F.xxhash64("doc_id", "quality", "x"), F.lit(1 << 30)) / F.lit(1 << 30)
    equal = labelled.groupBy("doc_id", "quality", "x").agg(F.count("*").alias("n"))
    equal = equal.withColumn("times", (F.floor(wanted) + (chance < wanted - F.floor(wanted)).cast("int")).cast("int"))
    rows = equal.where("times > 0").select("x", "quality", "times").toArrow()
    x, quality, times = rows["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(MEASURES)), rows["quality"].to_numpy(), rows["times"].to_numpy()
    order = np.lexsort([*x.T, quality])  # rows come in any order
    model = Model(np.repeat(x[order], times[order], 0), np.repeat(quality[order], times[order]))
    if 0 < bad < total:
        model.cut = _quantile(keep(_raw(labelled, model), "raw"), bad / total)
    return model


def _raw(labelled: DataFrame, model: Model) -> DataFrame:
    """(value) of each row: its score before the threshold."""
    sent = labelled.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(MEASURES))
                yield pa.RecordBatch.from_arrays([pa.array(sent.value.raw(x))], ["value"])

    return labelled.select("x").mapInArrow(run, "value double")


def _quantile(values: DataFrame, share: float) -> float:
    """The exact quantile of all values (value), as numpy has it: between the two nearest of them by distance."""
    n, lo, hi = values.agg(F.count("*"), F.min("value"), F.max("value")).first()
    place = share * (n - 1)
    rank, inside = int(place), n  # rank within the ``inside`` values from lo to hi
    while inside > FEW and lo < hi:
        bin_of = F.least(F.floor((F.col("value") - lo) / (hi - lo) * 1024), F.lit(1023))
        for r in values.where(F.col("value").between(lo, hi)).groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).orderBy("bin").collect():
            if rank < r["n"]:
                inside, lo, hi = r["n"], r["lo"], r["hi"]
                break
            rank -= r["n"]
    a = lo
    if lo < hi:
        a = float(np.partition(values.where(F.col("value").between(lo, hi)).toArrow()["value"].to_numpy(), rank)[rank])
    upto, above = values.agg(F.count_if(F.col("value") <= a), F.min(F.when(F.col("value") > a, F.col("value")))).first()
    b = a if upto > int(place) + 1 or above is None else above
    return float(a + (b - a) * (place - int(place)))


def scored(measured: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of measured rows."""
    sent = measured.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(MEASURES))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.score(x))], ["doc_id", "score"])

    return measured.select("doc_id", "x").mapInArrow(run, f"doc_id {measured.schema['doc_id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score and predicted (1: score of ACCEPT or more).

    Defined cases: null and empty texts are scored as texts without words; a null doc_id has
    no label; repeated rows have equal scores; ties in score are ties in prediction; other
    columns are ignored; no rows give no rows.
    """
    measured = keep(measures(docs), "measures")
    return scored(measured, learn(measured, labels)).select("doc_id", held_out(2, 4).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their columns; no row moves."""
    sent = docs.sparkSession.sparkContext.broadcast(learn(measures(docs), labels))
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for lo, hi, part in tx.chunks(tx.column_texts(batch.column(at))):
                yield batch.slice(lo, hi - lo).filter(pa.array(sent.value.score(_measures(part)) >= ACCEPT))

    return docs.mapInArrow(run, docs.schema)
