"""Near-duplicate vectors by spherical-cap filters from random product codes.

A vector is cut into two blocks; a filter direction is a pair of random unit codewords, one per
block. Each vector is stored in the filter nearest to it, and listed in every filter whose
cosine reaches what a vector of the wanted cosine with it has with its own nearest filter: the
wanted share of that, less SLACK standard deviations of what a random direction adds, and never
less than what the angles force. Of two close vectors, the one nearer to its filter is stored
there and the other is listed there. So each close pair meets in one filter; the pairs that meet
are compared in double precision.

Lists are decoded whole, over both blocks, before rows are dealt: a row for each filter. The
number of filters grows with the rows of a label, so that filters stay small.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from defectlake.llm import text as tx
from defectlake.llm.components import components, node_of, rep_of
from defectlake.llm.scratch import keep

COSINE = 0.98
#: Standard deviations below the mean at which a filter still lists a vector. Up to 13 dimensions
#: the angles force more, and no pair is missed; in 64, one of 200,000 pairs at the limit was.
SLACK = 3.5
#: Least and most codewords of a block.
CODEWORDS = (8, 1024)
#: Stored or listed vectors of one filter that one group compares at a time.
BLOCK = 4096
#: Labels, and filters, that hold more than this part of the rows are told to all tasks.
LABELS, FILTERS = 1000, 100_000
#: Guards the lists against rounding; comparisons don't use it.
MARGIN = 1e-6


def codewords_for(rows: int) -> int:
    """Codewords of each block for a label of so many rows: filters grow as their square root."""
    return int(np.clip(np.ceil(2 * max(rows, 1) ** 0.25), *CODEWORDS))


@lru_cache(maxsize=8)
def codebooks(dims: int, codewords: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Codewords of the two blocks of a vector of ``dims`` components, scaled so that a pair is a unit vector."""
    draw = np.random.default_rng([seed, dims, codewords])
    half = dims // 2
    books = [draw.standard_normal((codewords, n)) for n in (half, dims - half)]
    weight = np.sqrt(0.5) if dims > 1 else 1.0
    return tuple(weight * b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300) for b in books)


class Caps:
    """What unit vectors have with the filters."""

    def __init__(self, unit: np.ndarray, cosine: float, books: tuple[np.ndarray, np.ndarray]):
        dims = unit.shape[1]
        self.first, self.second = unit[:, : dims // 2] @ books[0].T, unit[:, dims // 2 :] @ books[1].T
        #: The nearest filter, and its cosine.
        self.nearest = self.first.argmax(1) * self.second.shape[1] + self.second.argmax(1)
        self.near = np.clip(self.first.max(1) + self.second.max(1), -1, 1)
        #: The cosine from which on a filter lists the vector.
        forced = np.cos(np.minimum(np.arccos(self.near) + np.arccos(cosine), np.pi))
        usual = cosine * self.near - SLACK * np.sqrt((1 - cosine**2) * (1 - self.near**2) / max(1, dims - 1))
        self.least = np.maximum(forced, usual) - MARGIN

    def listed(self) -> tuple[np.ndarray, np.ndarray]:
        """(vector, filter) of all filters that list a vector, from the first codewords that a second one can complete."""
        rows, first = np.nonzero(self.first + self.second.max(1)[:, None] >= self.least[:, None])
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        step = max(1, (1 << 22) // self.second.shape[1])
        for lo in range(0, len(rows), step):
            r, f = rows[lo : lo + step], first[lo : lo + step]
            at, second = np.nonzero(self.first[r, f][:, None] + self.second[r] >= self.least[r][:, None])
            out.append((r[at], f[at] * self.second.shape[1] + second))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


_TURN = tx.mix(np.arange(1, 1 << 16, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def _prints(bits: np.ndarray, label: np.ndarray) -> pa.Array:
    """A 128-bit print of each row of ``bits`` with its label's hash."""
    n, dims = bits.shape
    turn = np.resize(_TURN, dims) + np.arange(dims, dtype=np.uint64)
    both = [tx.mix(tx.mix(bits ^ t).sum(1, dtype=np.uint64) + tx.mix(label + np.uint64(dims + k))) for k, t in enumerate((turn, ~turn))]
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), n, [None, pa.py_buffer(np.stack(both, 1).tobytes())]).cast(pa.binary())


def _marked(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, print, vector) per row; print is null for rows that link with nothing."""

    def run(batches):
        for batch in batches:
            column = batch.column(3)
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            for dims in np.unique(sizes):
                part = batch.filter(pa.array(sizes == dims))
                n = part.num_rows
                prints, kept = pa.nulls(n, pa.binary()), pa.nulls(n, pa.list_(arrow))
                if dims:
                    x = part.column(3).flatten().to_numpy(zero_copy_only=False).reshape(n, dims) + 0.0  # one zero
                    ok = np.isfinite(x).all(1) & x.any(1) & part.column(1).is_valid().to_numpy(zero_copy_only=False)
                    label = part.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
                    prints = pc.if_else(pa.array(ok), _prints(x.astype(np.float64).view(np.uint64), label), prints)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(dims)), pa.array(x.ravel(), arrow))
                    kept = pc.if_else(pa.array(ok), lists, kept)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), prints, kept], ["vec_id", "label", "print", "vector"])

    kind = vectors.schema["embedding"].dataType.simpleString()
    single = kind == "array<float>"  # carried as they come; all sums are in double precision
    arrow = pa.float32() if single else pa.float64()
    label = F.col("label").cast("string")
    rows = vectors.select(F.col("vec_id").cast("long"), label.alias("label"), F.xxhash64(label).alias("of_label"), F.col("embedding").cast(kind if single else "array<double>"))
    return rows.mapInArrow(run, f"vec_id long, label string, print binary, vector array<{'float' if single else 'double'}>")


KEYS = "label string, dims int, filter long, stored boolean"


def _unit(column: pa.Array, dims: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _codewords(classes: DataFrame) -> tuple[dict[str, int], int]:
    """Codewords of the labels with more than a thousandth of all classes, and of any other."""
    total = classes.count()
    large = classes.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > total // LABELS).collect()
    return {r["label"]: codewords_for(r["n"]) for r in large}, codewords_for(total // LABELS)


def _listed(classes: DataFrame, cosine: float, codewords: tuple[dict[str, int], int], whole: bool) -> DataFrame:
    """Each class once as stored in its nearest filter, and once for each filter that lists it; keys alone or ``whole`` rows."""

    def run(batches):
        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy()
            words = np.array([codewords[0].get(label, codewords[1]) for label in batch.column(0).to_pylist()])
            for dims, k in np.unique(np.stack([sizes, words]), axis=1).T.tolist():
                part = batch.filter(pa.array((sizes == dims) & (words == k)))
                caps = Caps(_unit(part.column(2), dims), cosine, codebooks(dims, k))
                for stored, at, filters in ((True, np.arange(part.num_rows), caps.nearest), (False, *caps.listed())):
                    for lo in range(0, len(at), 8192):
                        own = at[lo : lo + 8192]
                        n = len(own)
                        cols = {"label": part.column(0).take(pa.array(own)), "dims": pa.array(np.full(n, dims, np.int32)), "filter": pa.array(filters[lo : lo + 8192].astype(np.int64)), "stored": pa.array(np.full(n, stored))}
                        if whole:
                            some = part.take(pa.array(own))
                            cols |= {"near": pa.array(caps.near[own]), "node": some.column(1), "copies": some.column(3), "vector": some.column(2)}
                        yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    schema = KEYS + (f", near double, node binary, copies long, vector {classes.schema['vector'].dataType.simpleString()}" if whole else "")
    return classes.select("label", "node", "vector", "copies").mapInArrow(run, schema)


class _Links:
    """Links found among the rows of a group: how many each row has, and a common row of those linked."""

    def __init__(self, copies: np.ndarray):
        self.copies, self.count, self.leader = copies, np.zeros(len(copies), np.int64), np.arange(len(copies))

    def add(self, p: np.ndarray, q: np.ndarray) -> None:
        np.add.at(self.count, p, self.copies[q])
        np.add.at(self.count, q, self.copies[p])
        while True:
            a, b = self.leader[p], self.leader[q]
            apart = a != b
            if not apart.any():
                return
            np.minimum.at(self.leader, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while (self.leader[self.leader] != self.leader).any():
                self.leader = self.leader[self.leader]


def _links_of(stored: np.ndarray, near: np.ndarray, nodes: np.ndarray, copies: np.ndarray, x: np.ndarray, cosine: float) -> _Links:
    found = _Links(copies)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    unit = x / norm[:, None]
    s, w = np.flatnonzero(stored), np.flatnonzero(~stored)
    for lo in range(0, len(s), 512):
        a, b = np.nonzero(unit[s[lo : lo + 512]] @ unit[w].T >= cosine - MARGIN)
        p, q = s[lo + a], w[b]
        ahead = (near[p] > near[q]) | ((near[p] == near[q]) & (nodes[p] < nodes[q]))
        p, q = p[ahead], q[ahead]
        for at in range(0, len(p), 1 << 16):
            pp, qq = p[at : at + (1 << 16)], q[at : at + (1 << 16)]
            sure = np.einsum("ij,ij->i", x[pp], x[qq]) / (norm[pp] * norm[qq]) >= cosine
            found.add(pp[sure], qq[sure])
    return found


def _pairs(classes: DataFrame, cosine: float) -> DataFrame:
    """(node, links, peer) per class and group: rows linked there, and one class to join it to.

    Stored and listed classes of a filter with very many of them are cut into blocks, and each
    pair of blocks is a group. What leaves a group is a row for each class that has links
    there, not the links.
    """
    codewords = _codewords(classes)
    at = ["label", "dims", "filter"]
    sizes = keep(_listed(classes, cosine, codewords, False).groupBy(*at).agg(F.count_if("stored").alias("n_stored"), F.count_if(~F.col("stored")).alias("n_listed")), "sizes")
    total = sizes.agg(F.coalesce(F.sum(F.col("n_stored") + F.col("n_listed")), F.lit(0))).first()[0]
    block = max(BLOCK, total // FILTERS)
    hot = F.broadcast(sizes.where(F.greatest("n_stored", "n_listed") > block))
    blocks = lambda n: F.greatest(F.lit(1), F.coalesce(F.ceil(F.col(n) / block), F.lit(1))).cast("int")
    hashed = F.xxhash64("node")
    own = F.when(F.col("stored"), F.pmod(hashed, blocks("n_stored"))).otherwise(F.pmod(hashed, blocks("n_listed"))).cast("int")
    others = F.when(F.col("stored"), blocks("n_listed")).otherwise(blocks("n_stored")) - 1
    tiled = _listed(classes, cosine, codewords, True).join(hot, at, "left").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), others)))
    tiled = tiled.withColumn("i", F.when(F.col("stored"), F.col("own")).otherwise(F.col("other"))).withColumn("j", F.when(F.col("stored"), F.col("other")).otherwise(F.col("own")))
    order = [*at, "i", "j"]

    def run(batches):
        held = None
        for batch in batches:
            held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            cols = [held.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            cuts = np.concatenate([[0], np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1])
            yield from groups(held, cuts)
            held = held.slice(int(cuts[-1]))
        if held is not None and held.num_rows:
            yield from groups(held, np.array([0, held.num_rows]))

    def groups(rows: pa.RecordBatch, cuts: np.ndarray):
        stored, near, copies = (rows.column(k).to_numpy(zero_copy_only=False) for k in (5, 6, 8))
        nodes = np.array(rows.column(7).to_pylist(), object)
        out: list[list] = [[], [], []]
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if stored[s:e].any() and not stored[s:e].all():
                x = rows.column(9).slice(s, e - s).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(e - s, -1)
                found = _links_of(stored[s:e], near[s:e], nodes[s:e], copies[s:e], x / np.abs(x).max(1, keepdims=True), cosine)
                used = np.flatnonzero(found.count)
                for to, values in zip(out, (nodes[s:e][used], found.count[used], nodes[s:e][found.leader[used]]), strict=True):
                    to += values.tolist()
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], ["node", "links", "peer"])

    rows = tiled.select(*order, "stored", "near", "node", "copies", "vector").repartition(*order).sortWithinPartitions(*order)
    return rows.mapInArrow(run, "node binary, links long, peer binary")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Rows are linked when their labels are equal and not null and the cosine is at least
    ``cosine``. Rows of equal label and vector are one class and linked with each other.

    Defined cases: a null, empty or zero vector, and one with null or non-finite components,
    links with nothing; vectors of different lengths don't link; repeated rows are copies and
    link; a null vec_id gets its component's id; other columns are ignored; no rows give no rows.
    """
    rows = keep(_marked(vectors), "vectors")
    classes = rows.where("print is not null").groupBy("print").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    classes = keep(classes.withColumn("node", node_of("rep", "print")), "classes")
    met = keep(_pairs(classes, cosine), "met")
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(met.select(F.col("node").alias("u"), F.col("peer").alias("v")), "vectors")
    of_class = classes.select("print", "node", "copies").join(links, "node", "left").join(roots, "node", "left")
    of_class = of_class.select("print", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), rep_of(F.coalesce("root", "node")).alias("component"))
    component = F.when(F.col("print").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    out = rows.select("vec_id", "print").join(of_class, "print", "left")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
