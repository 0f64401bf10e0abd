"""Document scores by prediction by partial matching over bytes, next to a word unigram base.

The model is a trie of byte contexts up to ORDER bytes, learned from the training documents:
each context holds the counts of the bytes that followed it. A byte's probability comes from
the longest known context; the share of its symbols among its symbols and counts is the
probability of an escape to the next shorter context (method C), where symbols that the longer
one could have given are excluded. Below the empty context the bytes not seen are equally
likely. A text ends with a zero byte, and ORDER zero bytes stand before it.

Counts are of all training documents. Tasks count runs of ORDER + 1 bytes, from which all
shorter contexts follow, and Spark sums them; likewise words. The log probability of each
distinct run comes from the counts of all runs, by joins from the shortest context up. Those of
the FREQUENT_RUNS most frequent runs are sent to all tasks; all others are joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from defectlake.llm import text as tx
from defectlake.llm.langid import held_out
from defectlake.llm.scratch import keep

ORDER = 5
#: Byte runs whose log probabilities every task has; those of all others are joined.
FREQUENT_RUNS = 1_000_000
#: Words whose counts every task has; the counts of all others are joined.
FREQUENT_WORDS = 200_000
#: Distinct keys that a task gathers before it sends them on.
GATHER = 3_000_000

_WORD, _RUN = 0, 1


def _byte_runs(part: tx.Texts) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ORDER + 1 bytes that end at each byte and at each text's end, and where each text's begin."""
    sizes = np.diff(part.offsets)
    at = part.offsets + np.arange(len(part) + 1) * (ORDER + 1)
    padded = np.zeros(int(at[-1]) + ORDER, np.uint8)
    padded[np.arange(len(part.data)) + np.repeat(at[:-1] - part.offsets[:-1], sizes) + ORDER] = part.data
    wide = padded.astype(np.uint64)
    n = len(padded) - ORDER
    runs = np.zeros(n, np.uint64)
    for k in range(ORDER + 1):
        runs |= wide[k : k + n] << np.uint64(8 * (ORDER - k))
    # Text i has sizes[i] + 1 runs from at[i]; the ORDER after them reach into the next text.
    inside = np.ones(n, bool)
    inside[(at[1:, None] - 1 - np.arange(ORDER)).ravel()] = False
    return runs[inside], np.concatenate([[0], np.cumsum(sizes + 1)])


class _Gathered:
    """Counts of keys, merged now and then so that they stay few."""

    def __init__(self):
        self.keys, self.counts, self.size = [], [], 0

    def add(self, keys: np.ndarray, times: int = 1) -> None:
        k, c = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.counts.append(c * times)
        self.size += len(k)
        if self.size > GATHER:
            self._merge()

    def _merge(self) -> None:
        if self.keys:
            k, inverse = np.unique(np.concatenate(self.keys), return_inverse=True)
            c = np.bincount(inverse, np.concatenate(self.counts)).astype(np.int64)
            self.keys, self.counts, self.size = [k], [c], len(k)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self._merge()
        got = (self.keys[0], self.counts[0]) if self.keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.__init__()
        return got


def corpus_counts(docs: DataFrame) -> DataFrame:
    """(kind, key, n) over all ``docs`` (text, trains): words by hash (kind 0) and byte runs (kind 1).

    n counts the training rows; the runs of the other rows are there too, with n 0 if no training row has them.
    """

    def batch_of(kind: int, gathered: _Gathered):
        keys, n = gathered.take()
        for lo in range(0, len(keys), 1 << 17):
            k = keys[lo : lo + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k.view(np.int64)), pa.array(n[lo : lo + (1 << 17)])], ["kind", "key", "n"])

    def run(batches):
        _tables.clear()  # of an earlier model
        kinds = {_WORD: _Gathered(), _RUN: _Gathered()}
        for batch in batches:
            trains = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for own in (True, False):
                texts = batch.column(0).filter(pa.array(trains == own))
                for _, _, part in tx.chunks(tx.column_texts(texts)) if len(texts) else ():
                    kinds[_RUN].add(_byte_runs(part)[0], int(own))
                    if own:
                        low = part.lowered()
                        kinds[_WORD].add(tx.word_hashes(low.data, *tx.word_spans(low, tx.NOT_SPACE)[:2]))
                    for kind, gathered in kinds.items():
                        if gathered.size > GATHER:
                            yield from batch_of(kind, gathered)
        for kind, gathered in kinds.items():
            yield from batch_of(kind, gathered)

    return docs.select(F.col("text").cast("string"), "trains").mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def log_probabilities(runs: DataFrame) -> DataFrame:
    """(key, n, log) of all ``runs`` (key, n): log10 of the probability of a run's last byte after those before it.

    A run of each order meets the one without its first byte, which at most 256 runs share, and
    the at most 256 runs of its context. ``below`` is the log probability after an escape from
    the context, whose symbols the shorter one can't give then.
    """
    known = None
    for k in range(ORDER + 1):
        rows = runs.select("key", "n")
        if k < ORDER:
            rows = rows.groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("key")).agg(F.sum("n").alias("n"))
        if k:
            rows = rows.withColumn("shorter", F.col("key").bitwiseAND(F.lit((1 << 8 * k) - 1))).join(known, "shorter")
        context = Window.partitionBy(F.shiftright("key", 8))
        rows = rows.withColumns({"total": F.sum("n").over(context), "distinct": F.count_if(F.col("n") > 0).over(context)})
        if k:
            gone = F.sum(F.when(F.col("n") > 0, F.col("n_0")).otherwise(0)).over(context)
            rows = rows.withColumns({"free": F.col("distinct_0") - F.col("distinct"), "all": F.greatest(F.col("total_0") - gone + F.col("distinct_0") - F.col("distinct"), F.lit(1))})
            # Where every symbol is excluded, the escape is certain.
            below = F.when(F.col("n_0") > 0, F.log10(F.col("n_0") / F.col("all"))).when(F.col("free") > 0, F.log10(F.col("free") / F.col("all")) + F.col("below_0")).otherwise(F.col("below_0"))
        else:
            below = -F.log10(F.greatest(256 - F.col("distinct"), F.lit(1)))
        rows = rows.withColumn("below", below)
        size = F.greatest(F.col("total") + F.col("distinct"), F.lit(1))
        unknown = F.col("log_0") if k else F.col("below")
        log = F.when(F.col("total") == 0, unknown).when(F.col("n") > 0, F.log10(F.col("n") / size)).otherwise(F.log10(F.col("distinct") / size) + F.col("below"))
        rows = rows.withColumn("log", log)
        known = rows.select(F.col("key").alias("shorter"), *[F.col(c).alias(f"{c}_0") for c in ("n", "total", "distinct", "below", "log")])
    return rows.select("key", "n", "log")


class Logs:
    """Log probabilities of runs, in a table addressed by hash."""

    def __init__(self, runs: np.ndarray, logs: np.ndarray):
        size = 1 << max(10, int(2 * len(runs)).bit_length())
        self.mask, self.keys, self.logs = np.uint64(size - 1), np.zeros(size, np.uint64), np.full(size, np.nan)
        left = runs
        slot = tx.mix(left) & self.mask
        while len(left):
            free = np.isnan(self.logs[slot])
            _, one = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[one]
            self.keys[slot[put]], self.logs[slot[put]] = left[put], logs[put]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, logs, slot = left[rest], logs[rest], (slot[rest] + np.uint64(1)) & self.mask

    def of(self, runs: np.ndarray) -> np.ndarray:
        """The log probability of each run; not a number where the table lacks it."""
        logs = np.full(len(runs), np.nan)
        left = np.arange(len(runs))
        slot = tx.mix(runs) & self.mask
        while len(left):
            found = self.logs[slot]
            empty = np.isnan(found)
            hit = (self.keys[slot] == runs[left]) & ~empty
            logs[left[hit]] = found[hit]
            rest = ~(hit | empty)
            left, slot = left[rest], (slot[rest] + np.uint64(1)) & self.mask
        return logs


_tables: dict = {}


def _table(sent) -> Logs:
    """One table for each Python worker and model."""
    if sent.id not in _tables:
        _tables.clear()
        _tables[sent.id] = Logs(*sent.value)
    return _tables[sent.id]


class _Sent:
    def __init__(self, broadcast):
        self.id, self.broadcast = broadcast._jbroadcast.id() if hasattr(broadcast, "_jbroadcast") else id(broadcast), broadcast

    @property
    def value(self):
        return self.broadcast.value


def _most_frequent(counts: DataFrame, most: int, value: str = "n") -> tuple[np.ndarray, np.ndarray]:
    """Keys and values of at most ``most`` rows: all whose count is above the one at which they get too many.

    The cut comes from how many rows have each count, so nothing is sorted in one place.
    """
    rows, least = counts.count(), 0
    if rows > most:
        by_count = counts.groupBy("n").agg(F.count("*").alias("rows"))
        for r in by_count.orderBy("n").toLocalIterator():
            if rows <= most:
                break
            rows, least = rows - r["rows"], r["n"]
    found = counts.where(F.col("n") > least).select("key", F.col(value).alias("value")).toArrow()
    return found["key"].to_numpy().view(np.uint64), found["value"].to_numpy()


def _times(doc: np.ndarray, keys: np.ndarray, size: int) -> tuple[pa.Array, pa.Array]:
    """Of each of ``size`` texts its distinct keys and how often each occurs."""
    pair = np.lexsort((keys, doc))
    doc, keys = doc[pair], keys[pair]
    new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1]))) if len(doc) else np.zeros(0, np.int64)
    times = np.diff(np.append(new, len(doc)))
    at = pa.array(np.searchsorted(doc[new], np.arange(size + 1)).astype(np.int32))
    return pa.ListArray.from_arrays(at, pa.array(keys[new].view(np.int64))), pa.ListArray.from_arrays(at, pa.array(times.astype(np.int32)))


def score(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learned from the rows that are not held out. The base takes lower-cased words and one end
    per text as tokens; words are told apart by 64-bit hashes.

    Defined cases: a null text is empty: one token, the end; without training rows nothing is
    known, bytes are equally likely and the base is that of no counts; a null doc_id is a
    training row; repeated rows are scored each and count each; other columns are ignored; no
    rows give no rows.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    training = rows.where(~held_out(1, 5))
    counts = keep(corpus_counts(rows.select("text", F.coalesce(~held_out(1, 5), F.lit(False)).alias("trains"))), "counts")
    words = counts.where(F.col("kind") == _WORD)
    n_docs = training.count()
    facts = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_all, n_distinct = facts[0] + n_docs, facts[1] + (n_docs > 0)
    frequent = _most_frequent(words, FREQUENT_WORDS)
    order = np.argsort(frequent[0])
    run_logs = keep(log_probabilities(counts.where(F.col("kind") == _RUN)), "run_logs")
    sent = _Sent(spark.sparkContext.broadcast(_most_frequent(run_logs, FREQUENT_RUNS, "log")))
    sent_words = spark.sparkContext.broadcast((frequent[0][order], frequent[1][order]))
    bottom = float(np.log10(n_all + 0.5 * (n_distinct + 1)))

    def run(batches):
        table = _table(sent)
        keys, n = sent_words.value
        logs = np.log10(n + 0.5)
        task = TaskContext.get().partitionId() << 40
        row = 0
        for batch in batches:
            for lo, hi, part in tx.chunks(tx.column_texts(batch.column(1))):
                runs, run_first = _byte_runs(part)
                run_sums = table.of(runs)
                absent = np.isnan(run_sums)
                run_sums[absent] = 0
                rare_runs = _times(np.repeat(np.arange(hi - lo), np.diff(run_first))[absent], runs[absent], hi - lo)
                low = part.lowered()
                starts, ends, first = tx.word_spans(low, tx.NOT_SPACE)
                hashes = tx.word_hashes(low.data, starts, ends)
                at = np.minimum(np.searchsorted(keys, hashes), max(0, len(keys) - 1))
                hit = keys[at] == hashes if len(keys) else np.zeros(len(hashes), bool)
                known = np.concatenate([[0], np.cumsum(hit)])
                sums = np.concatenate([[0.0], np.cumsum(np.where(hit, logs[at], 0.0))]) if len(keys) else np.zeros(len(hashes) + 1)
                size = hi - lo
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(task + row + np.arange(size)),
                        batch.column(0).slice(lo, size),
                        pa.array(np.diff(first) + 1),
                        pa.array(known[first[1:]] - known[first[:-1]]),
                        pa.array(sums[first[1:]] - sums[first[:-1]]),
                        pa.array(np.add.reduceat(run_sums, run_first[:-1]) if size else np.zeros(0)),
                        *_times(np.repeat(np.arange(size), np.diff(first))[~hit], hashes[~hit], size),
                        *rare_runs,
                    ],
                    ["row", "doc_id", "n_tokens", "known", "sum", "run_sum", "words", "word_times", "runs", "run_times"],
                )
                row += size

    schema = f"row long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, known long, sum double, run_sum double, words array<long>, word_times array<int>, runs array<long>, run_times array<int>"
    scored = keep(rows.mapInArrow(run, schema), "scored")

    def rare(keys: str, times: str) -> DataFrame:
        return scored.select("row", F.explode(F.arrays_zip(keys, times)).alias("x")).select("row", F.col(f"x.{keys}").alias("key"), F.col(f"x.{times}").alias("times"))

    zero = F.lit(0.0)
    of_words = rare("words", "word_times").join(words.select("key", "n"), "key", "left").select(
        "row", (F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))).alias("rare_sum"), F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0).alias("rare_known"), zero.alias("rare_runs"),
    )
    of_runs = rare("runs", "run_times").join(run_logs.select("key", "log"), "key", "left").select("row", zero.alias("rare_sum"), F.lit(0).alias("rare_known"), (F.col("times") * F.col("log")).alias("rare_runs"))
    rest = of_words.union(of_runs).groupBy("row").agg(*[F.sum(c).alias(c) for c in ("rare_sum", "rare_known", "rare_runs")])
    end = float(np.log10(n_docs + 0.5))
    base = F.col("sum") + F.coalesce("rare_sum", zero) + F.lit(end) - F.col("n_tokens") * F.lit(bottom)
    known = F.col("known") + F.coalesce("rare_known", F.lit(0)) + F.lit(int(n_docs > 0))
    total = F.col("run_sum") + F.coalesce("rare_runs", zero)
    return scored.drop("words", "word_times", "runs", "run_times").join(rest, "row", "left").select("doc_id", held_out(1, 5).alias("held_out"), "n_tokens", known.cast("long").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), base.alias("base_score"), total.alias("score"))
