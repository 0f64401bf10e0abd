"""Near-duplicate documents by HyperMinHash registers, banding and exact verification.

A document's distinct word shingles are hashed once. The top bits pick a bucket; of the
smallest hash in a bucket only its count of leading zeros and some mantissa bits stay, 16 bits
together. Four registers make a band, so 64-bit band values need no further hash. Documents
that agree in a band are candidates; a Jaccard estimate from the registers, less the matches
that compressed registers give by chance, drops most wrong ones, and what stays is compared on
the full shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectlake.llm import text as tx
from defectlake.llm.components import REP_BYTES, components, node_of, rep_of
from defectlake.llm.heavy import heavy_keys, sizes, spread_join, told_join
from defectlake.llm.scratch import forget, keep
from defectlake.llm.sieve import sieve

SHINGLE_WORDS = 5
PERCENT = 75
BUCKET_BITS = 7
MANTISSA_BITS = 10
ROWS_PER_BAND = 4
BUCKETS = 1 << BUCKET_BITS
BANDS = BUCKETS // ROWS_PER_BAND
#: Standard deviations below the wanted similarity at which an estimate still goes to verification.
SLACK = 5.0
#: Members of one band value that one group compares at a time.
BLOCK = 4096
#: Hashes of a set, from the smallest up, that comparisons within a band value see.
FINE = 1024


def _bit_length(x: np.ndarray) -> np.ndarray:
    out = np.zeros(x.shape, np.int64)
    for s in (32, 16, 8, 4, 2, 1):
        big = (x >> np.uint64(s)) > 0
        out += np.where(big, s, 0)
        x = np.where(big, x >> np.uint64(s), x)
    return out + (x > 0)


def registers(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (uint16, 0: empty) of sorted distinct 64-bit hashes."""
    rest = 64 - BUCKET_BITS
    edges = np.searchsorted(hashes, np.arange(BUCKETS, dtype=np.uint64) << np.uint64(rest))
    ends = np.append(edges[1:], len(hashes))
    full = edges < ends
    least = hashes[edges[full]] & np.uint64((1 << rest) - 1)
    bits = _bit_length(least)
    zeros = rest - bits
    shift = bits - 1 - MANTISSA_BITS
    body = np.where(shift >= 0, least >> np.maximum(shift, 0).astype(np.uint64), least << np.maximum(-shift, 0).astype(np.uint64))
    out = np.zeros(BUCKETS, np.uint16)
    out[full] = ((zeros + 1) << MANTISSA_BITS | (body.astype(np.int64) & ((1 << MANTISSA_BITS) - 1))).astype(np.uint16)
    return out


def chance_matches(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Expected share-free register matches of sets of sizes n and m (HyperMinHash, eq. for large sets)."""
    big, small = np.maximum(n, m), np.maximum(np.minimum(n, m), 1)
    ratio = big / small
    return 0.169919487159739 * 2.0 ** (BUCKET_BITS - MANTISSA_BITS) * 4 * ratio / (1 + ratio) ** 2


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard of register rows ``a`` and ``b``, and the registers it rests on."""
    used = ((a | b) != 0).sum(-1)
    same = ((a == b) & (a != 0)).sum(-1)
    return np.maximum(same - chance_matches(n, m), 0) / np.maximum(used, 1), used


def may_pass(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    j = percent / 100
    got, used = estimate(a, b, n, m)
    small, big = np.minimum(n, m), np.maximum(n, m)
    return (got + SLACK * np.sqrt(j * (1 - j) / np.maximum(used, 1)) >= j) & (100 * small >= percent * big)


def close(a: np.ndarray, b: np.ndarray, n: int, m: int, percent: int) -> tuple[bool, bool]:
    """Whether sets of ``n`` and ``m`` hashes may link by the smallest of them, and whether that is sure.

    Sets of up to FINE hashes are there in full, but for hashes that agree in their upper halves.
    Of longer ones the hashes up to the smaller of the two limits are a fair sample of the union.
    """
    cut = [x[-1] for x, size in ((a, n), (b, m)) if size > FINE]
    if cut:
        a, b = (x[: np.searchsorted(x, min(cut), "right")] for x in (a, b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - both
    if not cut:
        hidden = n + m - len(a) - len(b)
        return 100 * (both + hidden) >= percent * union, not hidden
    j = percent / 100
    return both / union + SLACK * np.sqrt(j * (1 - j) / union) >= j, False


def _sets(texts: tx.Texts, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, _, part in tx.chunks(texts):
        part = part.lowered()
        starts, ends, first = tx.word_spans(part, tx.NOT_SPACE)
        hashes, at = tx.shingle_hashes(tx.word_hashes(part.data, starts, ends), first, k)
        for i in range(len(part)):
            yield np.unique(hashes[at[i] : at[i + 1]])


def _print_of(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


SKETCH = "doc_id long, n_shingles long, print binary, sketch array<long>"


def sketches(docs: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """Per row: doc_id, n_shingles, a 128-bit print of the set, and the registers as 32 longs.

    A null or blank text has no shingles, no print and no sketch.
    """

    def run(batches):
        for batch in batches:
            sizes, prints, rows = [], [], []
            for s in _sets(tx.column_texts(batch.column(1)), k):
                sizes.append(len(s))
                prints.append(_print_of(s) if len(s) else None)
                rows.append(registers(s).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(rows, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "print", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SKETCH)


def _matrix(column: pa.Array) -> np.ndarray:
    """The register rows of a column of sketches."""
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint16).reshape(-1, BUCKETS)


def _both(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Kept ``pairs`` (a, b) with the row of each end; of ``left`` and ``right`` only rows of ends move."""
    total, left, right = pairs.count(), sieve(left, pairs, "a"), sieve(right, pairs, "b")
    return spread_join(spread_join(pairs, left, "a", heavy_keys(sizes(pairs, "a"), "a", total), "b"), right, "b", heavy_keys(sizes(pairs, "b"), "b", total), "a")


def _filtered(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose register estimate lets them go to verification."""
    left = sets.select(F.col("node").alias("a"), F.col("sketch").alias("sa"), F.col("n_shingles").alias("na"))
    right = sets.select(F.col("node").alias("b"), F.col("sketch").alias("sb"), F.col("n_shingles").alias("nb"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                n, m = (batch.column(i).to_numpy() for i in (3, 5))
                ok = may_pass(_matrix(batch.column(2)), _matrix(batch.column(4)), n, m, percent)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok))

    return _both(pairs, left, right).select("a", "b", "sa", "na", "sb", "nb").mapInArrow(run, "a binary, b binary")


def _verified(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose full sets have a Jaccard similarity of percent or more."""
    left = full.select(F.col("node").alias("a"), F.col("hashes").alias("ha"))
    right = full.select(F.col("node").alias("b"), F.col("hashes").alias("hb"))
    shared = F.size(F.array_intersect("ha", "hb")).cast("long")
    return (
        _both(pairs, left, right).withColumn("shared", shared)
        .where(100 * F.col("shared") >= percent * (F.size("ha") + F.size("hb") - F.col("shared")))
        .select(F.col("a").alias("u"), F.col("b").alias("v"))
    )


def _full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, hashes) of each wanted set (node, rep; kept), from one of the documents that have it; smallest hashes first. Other texts don't move."""

    def rows_of(have: list, rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(have, pa.binary()), pa.array([s.view(np.int64) for s in rows], pa.list_(pa.int64()))], ["node", "hashes"])

    def run(batches):
        last = None  # repeated rows of a document come one after the other
        for batch in batches:
            nodes = batch.column(1).to_pylist()
            have, rows = [], []
            for node, s in zip(nodes, _sets(tx.column_texts(batch.column(0)), k), strict=True):
                if len(s) and node != last and _print_of(s) == node[REP_BYTES:]:
                    last = node
                    have.append(node)
                    rows.append(s)
                if len(have) >= 256:
                    yield rows_of(have, rows)
                    have, rows = [], []
            yield rows_of(have, rows)

    texts = sieve(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), wanted, "doc_id", "rep")
    return texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["rep"])).select("text", "node").mapInArrow(run, "node binary, hashes array<long>")


class _FullSets:
    """Full sets (node, hashes) by node, made when they are first wanted."""

    def __init__(self, docs: DataFrame, sets: DataFrame, k: int):
        self.docs, self.reps, self.k, self.parts = docs, sets.select("node", "rep"), k, []

    def of(self, nodes: DataFrame) -> DataFrame:
        """The sets made so far, those of ``nodes`` (node, repeated or not) among them."""
        new = nodes.distinct()
        for part in self.parts:
            new = new.join(part.select("node"), "node", "left_anti")
        new = keep(new, "new")
        if new.count() or not self.parts:
            wanted = keep(sieve(self.reps, new, "node").join(new, "node"), "wanted")
            self.parts.append(keep(_full_sets(self.docs, wanted, self.k), "full"))
            forget(wanted)
        forget(new)
        return self.made()

    def made(self) -> DataFrame:
        """All sets made so far."""
        return reduce(DataFrame.union, self.parts)

    def forget(self) -> None:
        for part in self.parts:
            forget(part)


def _upper_halves(hashes: Column) -> Column:
    """The upper 32 bits of each hash, which move at half the size."""
    return F.transform(hashes, lambda x: F.shiftright(x, 32).cast("int"))


class _Group:
    """Members of one band value that meet: two blocks, or one with itself."""

    def __init__(self, columns: dict, percent: int, tentative: bool):
        self.c, self.percent, self.tentative = columns, percent, tentative
        self.root = np.unique(columns["root"], return_inverse=True)[1]

    def _meeting(self, i: int, js: np.ndarray) -> np.ndarray:
        """Those of ``js`` that ``i`` must be compared with here: of another root, and in no earlier band."""
        lanes, regs, n = self.c["sketch"], self.c["sketch"].view(np.uint16), self.c["n"]
        js = js[self.root[js] != self.root[i]]
        if len(js):
            js = js[((lanes[js] == lanes[i]) & (lanes[i] != 0)).argmax(1) == self.c["band"][0]]
        return js[may_pass(regs[i], regs[js], n[i], n[js], self.percent)] if len(js) else js

    def _meetings(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each member of the first block with those that it must be compared with."""
        own, ti, tj = self.c["own"], self.c["ti"][0], self.c["tj"][0]
        left = np.flatnonzero(own == ti)
        right = left if ti == tj else np.flatnonzero(own == tj)
        for i in left:
            yield i, self._meeting(i, right[right > i] if ti == tj else right)

    def meets(self) -> np.ndarray:
        """Which members must be compared with another one."""
        out = np.zeros(len(self.root), bool)
        for i, js in self._meetings():
            if len(js):
                out[i] = out[js] = True
        return out

    def pairs(self) -> tuple[list, list, list, list]:
        """Ends of the pairs, the group's key, and whether each is sure."""
        a_out, b_out, sure_out = [], [], []
        fine, n = self.c["fine"], self.c["n"]
        for i, js in self._meetings():
            for j in js:
                if self.root[i] == self.root[j]:
                    continue
                links, sure = close(fine[i], fine[j], n[i], n[j], self.percent)
                if links:
                    a_out.append(self.c["node"][i])
                    b_out.append(self.c["node"][j])
                    sure_out.append(sure)
                    if sure or self.tentative:
                        self.root[self.root == self.root[j]] = self.root[i]
        return a_out, b_out, [self.c["key"][0]] * len(a_out), sure_out


def _tiles(members: DataFrame) -> DataFrame:
    """Members (key, n, n_other, main, node, root, ...) dealt to groups (key, ti, tj) of two blocks each.

    Few members make one group. ``main`` is the root that most of many members have by then; its
    sets needn't meet each other. Blocks of it have numbers below zero.
    """
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("int")
    many = F.col("n") > BLOCK
    of_main, others = F.when(many, blocks(F.col("n") - F.col("n_other"))).otherwise(0), F.when(many, blocks(F.col("n_other"))).otherwise(1)
    is_main = many & (F.col("root") == F.col("main"))
    own = F.when(is_main, -1 - F.pmod(F.xxhash64("node"), F.greatest(of_main, F.lit(1)))).when(many, F.pmod(F.xxhash64("node"), others)).otherwise(0).cast("int")
    meets = F.when(is_main, F.sequence(F.lit(0), others - 1)).otherwise(F.concat(F.sequence(F.lit(0), others - 1), F.when(many, F.sequence(F.lit(-1), -of_main, F.lit(-1))).otherwise(F.array().cast("array<int>"))))
    tiled = members.withColumn("own", own).withColumn("other", F.explode(meets))
    return tiled.withColumns({"ti": F.least("own", "other"), "tj": F.greatest("own", "other")})


ORDER = ["key", "ti", "tj"]
DEALT = [*ORDER, "band", "own", "node", "root", "sketch", "n_shingles"]


def _columns(batch: pa.RecordBatch) -> dict:
    """The columns of DEALT."""
    now = {name: batch.column(i).to_numpy() for i, name in enumerate(("key", "ti", "tj", "band", "own"))}
    now["node"] = np.array(batch.column(5).to_pylist(), object)
    now["root"] = np.array(batch.column(6).to_pylist(), object)
    now["sketch"] = batch.column(7).flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS)
    now["n"] = batch.column(8).to_numpy()
    return now


def _groups(batches, percent: int, tentative: bool, more) -> Iterator[list[_Group]]:
    """The groups of sorted rows that begin with the columns of DEALT, as they end; ``more`` gives the other columns of a batch."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = _columns(batch) | more(batch)
        if held is not None:
            now = {k: np.concatenate([held[k], now[k]]) for k in now}
        new = np.flatnonzero((np.diff(now["key"]) != 0) | (np.diff(now["ti"]) != 0) | (np.diff(now["tj"]) != 0)) + 1
        cuts = np.concatenate([[0], new])
        yield [_Group({k: v[s:e] for k, v in now.items()}, percent, tentative) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
        held = {k: v[cuts[-1] :] for k, v in now.items()}
    if held is not None:
        yield [_Group(held, percent, tentative)]


def _with_partners(members: DataFrame, percent: int) -> DataFrame:
    """Members (key, band, n, n_other, main, node, root, sketch, n_shingles) that the registers let be compared with another of their band value, without sketch.

    This is what ``_cross_pairs`` would compare; the others need not move with their hashes.
    """
    kinds = {"key": pa.int64(), "band": pa.int32(), "members": pa.int64(), "n_other": pa.int64(), "main": pa.binary(), "node": pa.binary(), "root": pa.binary(), "n": pa.int64()}

    def sizes_of(batch: pa.RecordBatch) -> dict:
        return {"members": batch.column(9).to_numpy(), "n_other": batch.column(10).to_numpy(), "main": np.array(batch.column(11).to_pylist(), object)}

    def run(batches):
        for groups in _groups(batches, percent, True, sizes_of):
            met = [(group, at) for group in groups if (at := group.meets()).any()]
            if met:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([group.c[x][at] for group, at in met]), kind) for x, kind in kinds.items()], list(kinds))

    tiled = _tiles(members).select(*DEALT, "n", "n_other", "main")
    met = tiled.repartition(*ORDER).sortWithinPartitions(*ORDER).mapInArrow(run, "key long, band int, members long, n_other long, main binary, node binary, root binary, n long")
    return met.withColumnsRenamed({"n": "n_shingles", "members": "n"}).dropDuplicates(["key", "node"])


def _cross_pairs(members: DataFrame, percent: int, tentative: bool) -> DataFrame:
    """Pairs (a, b, key, sure) within band values that have a link left to find; they go to verification.

    members: (key, band, n, n_other, main, node, root, sketch, n_shingles, fine). Sets that links
    already join aren't compared, nor are those that a group has just joined. A link of sets of
    up to FINE hashes is sure at once. Of longer sets a link is likely only: ``tentative`` groups
    count them as joined all the same, so that a group gives at most one pair for each two roots
    that meet, and the caller must come again to the band values where an unsure pair failed;
    other groups give all such pairs. A pair that agrees in several bands is compared in the first of them only.
    """

    def fine_of(batch: pa.RecordBatch) -> dict:
        fine = np.empty(batch.num_rows, object)
        for i, x in enumerate(batch.column(9)):
            fine[i] = np.unique(x.values.to_numpy(zero_copy_only=False).view(np.uint32))
        return {"fine": fine}

    def run(batches):
        for groups in _groups(batches, percent, tentative, fine_of):
            found: tuple[list, ...] = ([], [], [], [])
            for group in groups:
                for every, own in zip(found, group.pairs(), strict=True):
                    every += own
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, (pa.binary(), pa.binary(), pa.int64(), pa.bool_()), strict=True)], ["a", "b", "key", "sure"])

    tiled = _tiles(members).select(*DEALT, "fine")
    return tiled.repartition(*ORDER).sortWithinPartitions(*ORDER).mapInArrow(run, "a binary, b binary, key long, sure boolean")


def _apart(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of the band values in which not all sets have one root yet: key, band, n, n_other, main, node, root.

    ``members`` tell whether they are the pivot of their band value; a pivot gives its root to ``main`` and isn't among the results.
    """
    root_of = roots.select(F.col("node").alias("of_node"), "root")
    placed = members.join(root_of, F.col("node") == F.col("of_node"), "left").select("key", "band", "node", F.coalesce("root", "node").alias("root"), "pivot")
    placed = keep(placed, "placed")
    per_root = placed.groupBy("key", "root").agg(F.count_if(~F.col("pivot")).alias("here"), F.max("pivot").alias("main"))
    mixed = per_root.groupBy("key").agg(
        F.sum("here").alias("n"), F.sum(F.when(F.col("main"), 0).otherwise(F.col("here"))).alias("n_other"), F.max(F.when(F.col("main"), F.col("root"))).alias("main"), F.count_if(F.col("here") > 0).alias("roots")
    )
    mixed = keep(mixed.where("roots > 1").drop("roots"), "mixed")
    rest = keep(told_join(placed.where(~F.col("pivot")).drop("pivot"), mixed, "key", heavy_keys(mixed, "key", placed.count())), "rest")
    for table in (placed, mixed):
        forget(table)
    return rest


def _comparable(rest: DataFrame, sets: DataFrame, full: _FullSets, percent: int) -> DataFrame:
    """Members that have a partner by their registers, with registers and smallest hashes. Of tables of sets only rows of members move."""
    known = sets.select("node", "sketch", "n_shingles")
    met = keep(_with_partners(rest.join(sieve(known, rest, "node"), "node"), percent), "met")
    fine = sieve(full.of(met.select("node")), met, "node").select("node", _upper_halves(F.slice("hashes", 1, FINE)).alias("fine"))
    return met.join(sieve(known.drop("n_shingles"), met, "node"), "node").join(fine, "node")


def near_duplicates(docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept, print.

    Sets link when 100 * intersection >= percent * union. Rows of equal sets are one class, so
    copies are never paired. Of each band value the members are first compared with one of
    them, drawn anew for each value, which settles all its pairs; the other sets that are then
    still apart are compared with each other. Band values, sets and roots with very many rows are split over tasks.

    Defined cases: a null, empty or blank text has n_shingles 0 and is linked with nothing; a
    text of fewer than ``k`` words has its whole sequence as one shingle; repeated rows are
    one class and each gets its row; a row without doc_id gets the id of its component (null
    if no row there has one) and kept is then false unless both are null; other columns are
    ignored; no rows give no rows.
    """
    rows = keep(sketches(docs, k), "sketches")
    sets = rows.where("print is not null").groupBy("print").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    sets = keep(sets.select(node_of("rep", "print").alias("node"), "print", "rep", "n_shingles", "sketch"), "sets")
    bands = sets.select("node", F.col("n_shingles").alias("na"), F.posexplode("sketch").alias("band", "value")).where("value <> 0").select("node", "na", "band", F.xxhash64("band", "value").alias("key"))
    draw = F.xxhash64("key", "node")
    shared = keep(bands.groupBy("key").agg(F.count("*").alias("size"), F.min(draw).alias("low")).where("size > 1"), "shared")
    heavy = heavy_keys(shared.select("key", F.col("size").alias("n")), "key", BANDS * sets.count())
    members = keep(told_join(sieve(bands, shared, "key"), shared, "key", heavy).select("key", "node", "na", "band", "size", (draw == F.col("low")).alias("pivot")), "members")
    forget(shared)
    pivots = members.where("pivot").select("key", F.col("node").alias("b"), F.col("na").alias("nb"))
    star = told_join(members.where(~F.col("pivot")).select("key", F.col("node").alias("a"), "na"), pivots, "key", heavy)
    star = star.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))  # no intersection is larger than the smaller set
    star = keep(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "star")
    likely = keep(_filtered(star, sets, percent), "likely")
    forget(star)
    full = _FullSets(docs, sets, k)
    links = keep(_verified(likely, full.of(likely.select(F.explode(F.array("a", "b")).alias("node"))), percent), "links")
    forget(likely)
    unsettled = members.where("size > 2").select("key", "band", "node", "pivot")  # what a pivot was compared with is settled
    tentative, some = True, unsettled
    while True:
        roots = keep(components(links, "near"), "roots")
        pairs = keep(_cross_pairs(_comparable(_apart(some, roots), sets, full, percent), percent, tentative), "pairs")
        met = pairs.count()
        more = keep(_verified(pairs, full.made(), percent), "more")
        found = more.count()
        if found:
            links = links.union(more)
        if met == found or not tentative:
            break
        failed = pairs.where(~F.col("sure")).join(more, (F.col("a") == F.col("u")) & (F.col("b") == F.col("v")), "left_anti").select("key").distinct()
        some = keep(unsettled.join(failed, "key", "left_semi"), "again")
        tentative = 2 * found >= met  # else one last time, with all pairs that may link
    if found:
        roots = components(links, "all")
    full.forget()
    forget(members)
    of_set = sets.select("node", "print").join(roots.withColumnRenamed("node", "of_node"), F.col("node") == F.col("of_node"), "left").select("print", rep_of(F.coalesce("root", "node")).alias("component_id"))
    component = F.when(F.col("print").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "n_shingles", "print").join(of_set, "print", "left").select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "print")
