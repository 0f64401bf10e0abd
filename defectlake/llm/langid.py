"""Language ID by multinomial naive Bayes over hashed character n-grams.

Tasks count hashed n-grams per language for their part of the labelled texts; the counts are
summed by Spark into a matrix of languages by buckets, whose size the parameters bound. Its
logarithms are broadcast, and batches are scored as sparse sums over their n-grams.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectlake.llm import text as tx
from defectlake.llm.scratch import keep

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
SIZES = (1, 2, 3)
SMOOTHING = 0.5
MAX_LANGUAGES = 1000
UNKNOWN = "und"

_LETTER = np.array([chr(c).isalpha() for c in range(0x10000)])
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


def _letters(points: np.ndarray) -> np.ndarray:
    """Whether each code point is a letter."""
    out = _LETTER[np.minimum(points, 0xFFFF)]
    for i in np.flatnonzero(points > 0xFFFF):
        out[i] = chr(points[i]).isalpha()
    return out


class Grams:
    """The hashed n-grams of a run of texts: lower case, and one space for what isn't a letter."""

    def __init__(self, texts: list[str]):
        low = [t.lower() for t in texts]
        self.ends = np.cumsum([len(t) for t in low], dtype=np.int64) if low else np.zeros(0, np.int64)
        points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters(points)
        begins = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        many = np.concatenate([[0], np.cumsum(letter)])
        self.has_letter = many[self.ends] > many[begins]
        self.points = np.where(letter, points, np.uint32(0x20))
        doc = np.repeat(np.arange(len(low)), self.ends - begins)
        again = np.zeros(len(points), bool)  # a space after a space of the same text
        again[1:] = ~letter[1:] & ~letter[:-1] & (doc[1:] == doc[:-1])
        self.points, self.doc = self.points[~again], doc[~again]

    def each(self):
        """(bucket, doc) of all n-grams, one size after the other; none crosses a text's end."""
        for n in SIZES:
            m = len(self.points) - n + 1
            if m <= 0:
                continue
            h = np.full(m, n, np.uint32) * _FACTORS[4]
            for k in range(n):
                h = (h ^ self.points[k : k + m]) * _FACTORS[k]
                h ^= h >> np.uint32(15)
            inside = self.doc[:m] == self.doc[n - 1 :]
            yield (h >> np.uint32(32 - BUCKET_BITS))[inside], self.doc[:m][inside]


def _runs(batch: pa.RecordBatch, at: int):
    """(first row, texts) of runs of bounded bytes of a column of texts; null is empty."""
    for lo, hi, _ in tx.chunks(tx.column_texts(batch.column(at))):
        yield lo, [t or "" for t in batch.column(at).slice(lo, hi - lo).to_pylist()]


def train(labelled: DataFrame) -> DataFrame:
    """(lang, texts, buckets, counts) per language of ``labelled`` (text, lang)."""

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}
        for batch in batches:
            for lo, run in _runs(batch, 0):
                langs = batch.column(1).slice(lo, len(run)).to_pylist()
                names = sorted(set(langs))
                code = np.array([names.index(x) for x in langs])
                grams = Grams(run)
                for name in langs:
                    texts[name] = texts.get(name, 0) + 1
                for bucket, doc in grams.each():
                    both = np.bincount(code[doc] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
                    for i, name in enumerate(names):
                        totals[name] = totals.get(name, 0) + both[i]
        for name in texts:
            full = np.asarray(totals.get(name, np.zeros(BUCKETS, np.int64)))
            used = np.flatnonzero(full)
            yield pa.RecordBatch.from_pydict({"lang": [name] * (len(used) + 1), "bucket": [-1, *used.tolist()], "n": [texts[name], *full[used].tolist()]}, pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())]))

    rows = labelled.select(F.col("text").cast("string"), F.col("lang").cast("string")).where("text is not null and lang is not null")
    return rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def model_of(counts: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log priors, and the log probability of each bucket in each language."""
    rows: pd.DataFrame = counts.toPandas()
    names = sorted(rows["lang"].unique())
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"{len(names)} languages are more than {MAX_LANGUAGES}")
    table = np.zeros((len(names), BUCKETS), np.float64)
    texts = np.zeros(len(names))
    place = rows["lang"].map({n: i for i, n in enumerate(names)}).to_numpy(np.int64)
    bucket, n = rows["bucket"].to_numpy(), rows["n"].to_numpy()
    texts[place[bucket < 0]] = n[bucket < 0]
    table[place[bucket >= 0], bucket[bucket >= 0]] = n[bucket >= 0]
    smooth = table + SMOOTHING
    return names, np.log(texts / max(1, texts.sum())), np.log(smooth / smooth.sum(1, keepdims=True)).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, lang_pred, score) per row: the likeliest language and its posterior probability.

    Defined cases: a null text or one without a letter is ``und`` with score 0, as is every
    text where nothing was learned; ties go to the first language in order; other columns
    are ignored; no rows give no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        names, prior, table = sent.value
        for batch in batches:
            for lo, texts in _runs(batch, 1):
                grams = Grams(texts)
                sums = np.repeat(prior[:, None], len(texts), 1) if names else np.zeros((0, len(texts)))
                for bucket, doc in grams.each():
                    for i in range(len(names)):
                        sums[i] += np.bincount(doc, table[i][bucket], len(texts))
                known = grams.has_letter & (len(names) > 0)
                best = sums.argmax(0) if names else np.zeros(len(texts), np.int64)
                top = sums.max(0) if names else np.zeros(len(texts))
                share = 1 / np.exp(sums - top).sum(0) if names else np.zeros(len(texts))
                langs = [names[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), pa.array(langs, pa.string()), pa.array(np.where(known, share, 0.0))], ["doc_id", "lang_pred", "score"])

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def held_out(rest: int, of: int) -> Column:
    """Whether crc32 of doc_id as text leaves ``rest`` by ``of``; a null doc_id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(of)) == rest, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score per row, learned from the rows that are not held out."""
    model = model_of(keep(train(docs.where(~held_out(2, 4))), "language_counts"))
    return predict(docs, model).select("doc_id", held_out(2, 4).alias("held_out"), "lang_pred", "score")
