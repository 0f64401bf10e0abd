"""Benchmark decontamination by a positional inverted index of the training text.

The index is dealt by document: a run of documents is one block, and a block's row has, for
every term of its documents, the sorted list of its positions in the block's words. It is written
to the shared folder and serves any benchmark. A phrase starts from the positions of its rarest
test term, moved by the term's offset; the moved lists of its other terms, rarest first, are
intersected with them. Proximity matches keep the rarest term's positions that have all other
terms around them. Test items are sent to all tasks in blocks of bounded size, with the counts
of their terms, so no list of postings moves and none is gathered.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from defectlake.llm import text as tx
from defectlake.llm.scratch import keep, narrow

WINDOW_WORDS = 10
#: More words among which a window's words count as near each other.
SLOP = 2
#: Bytes of benchmark text whose items are sent to the tasks at once.
TEST_BLOCK_BYTES = 4 << 20
#: Windows of one part of a long item.
PART_WINDOWS = 4096


def _words(texts: tx.Texts) -> tuple[np.ndarray, np.ndarray]:
    low = texts.lowered()
    starts, ends, first = tx.word_spans(low, tx.ALNUM)
    return tx.word_hashes(low.data, starts, ends), first


def item_terms(benchmark: DataFrame, words: int = WINDOW_WORDS) -> DataFrame:
    """(item_id, terms): the word sequence of every item with words; long ones in parts that share ``words`` - 1 words."""

    def run(batches):
        for batch in batches:
            items, rows = [], []
            for lo, hi, part in tx.chunks(tx.column_texts(batch.column(1))):
                terms, first = _words(part)
                for i, name in enumerate(batch.column(0).slice(lo, hi - lo).to_pylist()):
                    own = terms[first[i] : first[i + 1]]
                    for at in range(0, max(1, len(own) - words + 1) if len(own) else 0, PART_WINDOWS):
                        items.append(name)
                        rows.append(own[at : at + PART_WINDOWS + words - 1].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(rows, pa.list_(pa.int64()))], ["item_id", "terms"])

    return benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).mapInArrow(run, "item_id string, terms array<long>")


INDEX = "block string, doc_ids array<{id}>, first array<long>, terms array<long>, ends array<long>, positions array<int>"


def index(docs: DataFrame) -> DataFrame:
    """The index of ``docs`` (doc_id, text): a row for each block.

    first[i] is the word at which document i begins. The positions of terms[i] are those from
    ends[i - 1] up to ends[i] in ``positions``.
    """

    def run(batches):
        for batch in batches:
            for lo, hi, part in tx.chunks(tx.column_texts(batch.column(1))):
                words, first = _words(part)
                order = np.argsort(words, kind="stable")
                held, counts = np.unique(words, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([uuid.uuid4().hex]),
                        pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), batch.column(0).slice(lo, hi - lo)),
                        pa.array([first], pa.list_(pa.int64())),
                        pa.array([held.view(np.int64)], pa.list_(pa.int64())),
                        pa.array([np.cumsum(counts)], pa.list_(pa.int64())),
                        pa.array([order.astype(np.int32)], pa.list_(pa.int32())),
                    ],
                    ["block", "doc_ids", "first", "terms", "ends", "positions"],
                )

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, INDEX.format(id=texts.schema["doc_id"].dataType.simpleString()))


def term_counts(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n) over the whole index, of the given terms (term) that it holds."""
    begins = F.concat(F.array(F.lit(0).cast("long")), "ends")
    each = postings.select(F.explode(F.arrays_zip(F.col("terms").alias("term"), F.col("ends").alias("to"), F.slice(begins, 1, F.size("terms")).alias("from"))).alias("x"))
    each = each.select("x.term", (F.col("x.to") - F.col("x.from")).alias("n"))
    return each.join(terms, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n"))


class Matcher:
    """Finds windows in a block of the index."""

    def __init__(self, terms: np.ndarray, counts: np.ndarray, items: list[np.ndarray], words: int):
        """terms: sorted, with their counts in the index; items: each as places in ``terms``."""
        self.terms, self.words = terms, words
        windows = [np.lib.stride_tricks.sliding_window_view(x, words) if len(x) >= words else np.append(x, np.full(words - len(x), -1))[None] for x in items]
        self.rows = np.concatenate(windows).astype(np.int32) if windows else np.zeros((0, words), np.int32)
        self.item = np.repeat(np.arange(len(items)), [len(w) for w in windows])
        self.sizes = (self.rows >= 0).sum(1)
        count = np.append(counts, np.iinfo(np.int64).max)  # past the end of a window
        #: Offsets in a window, rarest term first.
        self.order = np.argsort(count[self.rows], axis=1, kind="stable").astype(np.int16)

    def begin(self, held: np.ndarray, ends: np.ndarray, positions: np.ndarray, doc_of: np.ndarray) -> None:
        """Go to a block: places of its terms, and their lists of positions."""
        begins = np.concatenate([[0], ends[:-1]])
        self.from_, self.to = np.zeros(len(self.terms) + 1, np.int64), np.zeros(len(self.terms) + 1, np.int64)
        self.from_[held], self.to[held] = begins, ends
        self.positions, self.doc_of, self.wide = positions, doc_of, len(doc_of) + 1
        #: All lists in one: sorted by term, then by position.
        self.keys = np.repeat(held, ends - begins) * np.int64(self.wide) + positions
        here = self.to > self.from_
        here[-1] = True
        self.present = np.flatnonzero(here[self.rows].all(1))

    def _anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows whose terms are all here, the offset of their rarest term, and each of its positions."""
        offset = self.order[self.present, 0].astype(np.int64)
        term = self.rows[self.present, offset]
        sizes = self.to[term] - self.from_[term]
        which = np.repeat(np.arange(len(self.present)), sizes)
        at = self.positions[np.repeat(self.from_[term] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]
        return self.present[which], offset[which], at.astype(np.int64)

    def _has(self, term: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether the list of each term holds a position from lo to hi."""
        base = term.astype(np.int64) * self.wide
        at = np.minimum(np.searchsorted(self.keys, base + np.maximum(lo, 0)), max(0, len(self.keys) - 1))
        return (self.keys[at] >= base + np.maximum(lo, 0)) & (self.keys[at] <= base + np.minimum(hi, self.wide - 1)) & (hi >= 0)

    def exact(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows, and the words from which up to which they stand in order, side by side, in one document."""
        row, offset, at = self._anchors()
        start = at - offset
        ok = (start >= 0) & (start + self.sizes[row] < self.wide)
        row, start = row[ok], start[ok]
        for k in range(1, self.words):
            offset = self.order[row, k].astype(np.int64)
            term = self.rows[row, offset]
            ok = term < 0
            ok[~ok] = self._has(term[~ok], (start + offset)[~ok], (start + offset)[~ok])
            row, start = row[ok], start[ok]
        end = start + self.sizes[row]
        ok = self.doc_of[start] == self.doc_of[end - 1]
        return row[ok], start[ok], end[ok]

    def near(self, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows whose terms all stand, in any order, within their length plus ``slop`` words of one document.

        With each, from which up to which word: the shortest such run for each place of its rarest term.
        """
        row, _, at = self._anchors()
        for k in range(1, self.words):
            term = self.rows[row, self.order[row, k]]
            ok, span = term < 0, self.sizes[row] + slop
            ok[~ok] = self._has(term[~ok], (at - span + 1)[~ok], (at + span - 1)[~ok])
            row, at = row[ok], at[ok]
        out = {found for r, p in zip(row.tolist(), at.tolist(), strict=True) if (found := self._shortest(r, p, slop))}
        cols = np.array(sorted(out), np.int64).reshape(-1, 3)
        return cols[:, 0], cols[:, 1], cols[:, 2]

    def _shortest(self, row: int, at: int, slop: int) -> tuple[int, int, int] | None:
        span = int(self.sizes[row]) + slop
        terms = {int(t) for t in self.rows[row] if t >= 0}
        around = []
        for t in terms:
            own = self.positions[self.from_[t] : self.to[t]]
            around += [(int(p), t) for p in own[np.searchsorted(own, at - span + 1) : np.searchsorted(own, at + span)] if self.doc_of[p] == self.doc_of[at]]
        last: dict[int, int] = {}
        best = None
        for p, t in sorted(around):
            last[t] = p
            if len(last) == len(terms):
                low = min(last.values())
                if low <= at <= p and p - low < span and (best is None or p - low < best[2] - 1 - best[1]):
                    best = (row, low, p + 1)
        return best


SPANS = "array<struct<item_id:string,start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _by_document(found: tuple, names: list, item: np.ndarray, doc_of: np.ndarray, first: np.ndarray) -> list[list[dict]]:
    """Of each document the runs of words that each item's windows cover."""
    spans: list[dict] = [{} for _ in range(len(first) - 1)]
    for w, s, e in zip(*(x.tolist() for x in found), strict=True):
        spans[doc_of[s]].setdefault(names[item[w]], []).append((s, e))
    out = []
    for d, by_item in enumerate(spans):
        own = []
        for name, runs in by_item.items():
            merged: list[list[int]] = []
            for s, e in sorted(runs):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(e, merged[-1][1])
                else:
                    merged.append([s, e])
            own += [{"item_id": name, "start": int(s - first[d]), "end": int(e - first[d])} for s, e in merged]
        out.append(own)
    return out


def _matched(postings: DataFrame, wanted: DataFrame, words: int, slop: int | None) -> DataFrame:
    """(block, place, doc_id, n_words, matches, near) of every document of the index, for one block of items.

    A row of the index is about a MB, so it is read a few rows at a time, whatever a file or a partition has.
    """
    vocabulary = wanted.select(F.explode("terms").alias("term")).distinct()
    counted = term_counts(postings, vocabulary).toArrow()
    lines = wanted.toArrow()
    names, rows = lines["item_id"].to_pylist(), [np.asarray(t.values).view(np.uint64) for t in lines["terms"]]
    terms = np.unique(np.concatenate(rows)) if rows else np.zeros(0, np.uint64)
    counts = np.zeros(len(terms), np.int64)
    counts[np.searchsorted(terms, counted["term"].to_numpy().view(np.uint64))] = counted["n"].to_numpy()
    sent = postings.sparkSession.sparkContext.broadcast((terms, counts, [np.searchsorted(terms, r) for r in rows], names))
    id_type = postings.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches):
        terms, counts, items, names = sent.value
        matcher = Matcher(terms, counts, items, words)
        for batch in batches:
            for b in range(batch.num_rows):
                first, held_terms, ends, positions = (batch.column(i)[b].values.to_numpy(zero_copy_only=False) for i in (2, 3, 4, 5))
                sizes = np.diff(first)
                n, doc_of = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
                place = np.minimum(np.searchsorted(terms, held_terms.view(np.uint64)), max(0, len(terms) - 1))
                mine = terms[place] == held_terms.view(np.uint64) if len(terms) else np.zeros(len(place), bool)
                lengths = np.diff(np.concatenate([[0], ends]))
                matcher.begin(place[mine], np.cumsum(lengths[mine]), positions[np.repeat(mine, lengths)], doc_of)
                spans = [_by_document(matcher.exact(), names, matcher.item, doc_of, first), None if slop is None else _by_document(matcher.near(slop), names, matcher.item, doc_of, first)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[b].as_py()] * n, pa.string()), pa.array(np.arange(n, dtype=np.int32)), batch.column(1)[b].values, pa.array(sizes), *(pa.nulls(n, _SPANS) if x is None else pa.array(x, _SPANS) for x in spans)],
                    ["block", "place", "doc_id", "n_words", "matches", "near"],
                )

    return postings.mapInArrow(run, f"block string, place int, doc_id {id_type}, n_words long, matches {SPANS}, near {SPANS}")


def search(postings: DataFrame, benchmark: DataFrame, words: int = WINDOW_WORDS, slop: int | None = None) -> DataFrame:
    """What ``contamination`` gives, from an index that ``index`` made and something kept."""
    spark = postings.sparkSession
    postings = narrow(postings if hasattr(postings, "kept_at") else keep(postings, "postings", wide=True))
    total = benchmark.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0]
    blocks = max(1, -(-total // TEST_BLOCK_BYTES))
    items = keep(item_terms(benchmark, words).withColumn("part", F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks))), "items")
    wanted, every = postings.sparkSession.read.schema(items.schema).parquet(items.kept_at), None
    for i in range(blocks):
        found = keep(_matched(postings, wanted.where(F.col("part") == i), words, slop), "found")
        part = spark.read.schema(found.schema).parquet(found.kept_at)
        every = part if every is None else every.union(part)
    if blocks > 1:
        both = [F.flatten(F.collect_list(c)).alias(c) for c in ("matches", "near")]
        every = every.groupBy("block", "place").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *both)
    return every.select("doc_id", "n_words", "matches", *([] if slop is None else ["near"]))


def contamination(docs: DataFrame, benchmark: DataFrame, words: int = WINDOW_WORDS, slop: int | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, and ``matches`` (item_id, first word, word after the last).

    A match is an exact run of words. With a ``slop``, ``near`` has the same of runs in which all
    words of a window stand within that many more words, in any order.

    Defined cases: null or empty texts have no words and no matches; items without words give
    no window, and without items nothing matches; items with equal item_id count as one; item_id
    is taken as text and a null one stays null; repeated rows each get their result; other
    columns are ignored; no rows give no rows. The words of one block of items, TEST_BLOCK_BYTES
    of text, and their counts are held by the driver and each task.
    """
    return search(keep(index(docs), "postings", wide=True), benchmark, words, slop)


def _items(spans: str):
    return F.array_sort(F.array_distinct(F.transform(spans, lambda m: m["item_id"])))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit (words inside a match), n_items, items_sha256, contaminated, and n_near_items if near is there."""
    spans = F.sort_array(F.transform("matches", lambda m: F.struct(m["start"].cast("long").alias("s"), m["end"].cast("long").alias("e"))))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("n"))
    hit = F.aggregate(spans, zero, lambda z, x: F.struct(F.greatest(z["at"], x["e"]).alias("at"), (z["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(z["at"], x["s"]))).alias("n")))["n"]
    items = _items("matches")
    near = [F.size(_items("near")).cast("long").alias("n_near_items")] if "near" in found.columns else []
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join(items, ","), "UTF-8"), 256).alias("items_sha256"), (F.size("matches") > 0).alias("contaminated"), *near,
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS run
      FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS run
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM q) WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, i, p.n FROM p JOIN q ON p.n = q.n AND p.run = q.run),
h AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT doc_id, i, unnest(range(n)) AS k FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id),
v AS (SELECT DISTINCT item_id, list_distinct(w[i:i + n - 1]) AS terms, n
      FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
f AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
c AS (SELECT word, count(*) AS n FROM f GROUP BY word),
a AS (SELECT v.item_id, v.terms, any_value(v.n) AS n, arg_min(c.word, (c.n, c.word)) AS anchor
      FROM (SELECT *, unnest(terms) AS term FROM v) AS v JOIN c ON c.word = v.term GROUP BY v.item_id, v.terms HAVING count(*) = len(v.terms)),
g AS (SELECT f.doc_id, a.item_id, a.terms, d.w[s:s + a.n + 1] AS near
      FROM f JOIN a ON a.anchor = f.word JOIN d ON d.doc_id = f.doc_id, unnest(range(greatest(1, f.i - a.n - 1), f.i + 1)) AS u(s)),
z AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM g WHERE list_has_all(near, terms) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       coalesce(n_near, 0) AS n_near_items
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN z ON z.doc_id = d.doc_id
"""
