"""Merkle manifests of datasets, with the upper proofs found by a butterfly exchange.

A tree stands over the rows of each source and one over the sources. The leaves of a tree are cut
into aligned blocks of a power of the fanout, each the partition that one row of the table of
blocks holds. A block hashes its own subtree; then groups of fanout blocks swap the roots of what
they have so far, round by round: a block's partners of a round differ from it in one digit of its
number. Each block hashes the ancestor itself, over again in every member, so that after the last
round it has all siblings on its way to the root and no pass leads down the tree.

Only DataFrame operations are used. What the driver sees is a row for each partition of the sorted
leaves, to number them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from defectlake.llm.scratch import forget, keep

FANOUT = 3
#: Levels of the tree inside a block: a block has FANOUT ** LEVELS leaves at most.
LEVELS = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: What one level adds to a proof: the place of the node in its run, and the run's other nodes.
STEP = "struct<place: int, siblings: array<string>>"


def _field(value: Column) -> Column:
    """``-`` for a null, else the bytes of the value's text, a colon and that text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """The leaf of a row of documents, some of its fields changed."""
    return F.sha2(F.concat(*[_field(changed.get(name, F.col(name))) for name in FIELDS]), 256)


def _up(nodes: Column, fanout: int) -> Column:
    """The level over ``nodes``: every run of ``fanout`` hashed."""
    return F.transform(F.sequence(F.lit(1), F.size(nodes), F.lit(fanout)), lambda at: F.sha2(F.array_join(F.slice(nodes, at, fanout), ""), 256))


def step_of(nodes: Column, at: Column, fanout: int) -> Column:
    """What the node at a place of its level adds to a proof."""
    place = (at % fanout).cast("int")
    run = F.slice(nodes, (at - at % fanout + 1).cast("int"), fanout)
    return F.struct(place.alias("place"), F.filter(run, lambda _, i: i != place).alias("siblings"))


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf gives with the siblings of its proof."""
    joined = lambda node, step: F.array_join(F.concat(F.slice(step["siblings"], F.lit(1), step["place"]), F.array(node), F.slice(step["siblings"], step["place"] + 1, F.size(step["siblings"]))), "")
    return F.aggregate(proof, start, lambda node, step: F.sha2(joined(node, step), 256))


def _numbered(rows: DataFrame, tree: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``tree_no`` and ``position``, both from 0: the rank of the tree, null first, and of the row in it by ``order``, nulls first.

    Rows are sorted over the cluster by both; equal ones are told apart by where they are read, so
    that a large group of them is spread like others. The second table is what was written.
    """
    by = [F.col(c).asc_nulls_first() for c in (tree, *order, "read_at")]
    spread = rows.withColumn("read_at", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    at = F.monotonically_increasing_id()
    placed = keep(spread.select(*rows.columns, F.shiftright(at, 33).alias("part"), at.bitwiseAND((1 << 33) - 1).alias("at")), "placed")
    runs = placed.groupBy("part", tree).agg(F.min("at").alias("begin"), F.count("*").alias("n"))
    runs = runs.withColumn("run", F.row_number().over(W.partitionBy("part").orderBy("begin")).cast("long") - 1)
    ends = runs.groupBy("part").agg(F.min(F.struct("run", tree, "n")).alias("first"), F.max(F.struct("run", tree, "n")).alias("last"), F.count("*").alias("n_runs"))
    heads, before, trees, carried = [], None, 0, 0
    for part in sorted(ends.collect(), key=lambda r: r.part):  # a row for each partition
        goes_on = before is not None and before.last[tree] == part.first[tree]
        base, skip = trees - goes_on, carried if goes_on else 0
        heads.append((part.part, base, skip))
        trees, carried = base + part.n_runs, part.last.n + (skip if part.n_runs == 1 else 0)
        before = part
    told = F.broadcast(rows.sparkSession.createDataFrame(heads, "part long, base long, skip long"))
    shift = F.when(F.col("run") == 0, F.col("skip")).otherwise(F.lit(0)) - F.col("begin")
    starts = runs.join(told, "part").select(F.col("part").alias("of_part"), F.col(tree).alias("of_tree"), (F.col("base") + F.col("run")).alias("tree_no"), shift.alias("shift"))
    joined = placed.join(starts, (F.col("part") == F.col("of_part")) & F.col(tree).eqNullSafe(F.col("of_tree")))
    return joined.select("tree_no", (F.col("at") + F.col("shift")).alias("position"), *rows.columns), placed


def _blocks(leaves: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(tree_no, block, rows, digest, done): the leaves (tree_no, position, leaf, ...) of each block in order, its root, and the steps inside it.

    A tree of one block ends as soon as one node remains; other blocks hash all their levels.
    """
    size = fanout**levels
    own = [c for c in leaves.columns if c not in ("tree_no", "position")]
    placed = leaves.select("tree_no", F.floor(F.col("position") / size).cast("long").alias("block"), F.struct((F.col("position") % size).alias("place"), *own).alias("row"))
    blocks = placed.groupBy("tree_no", "block").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    nodes = blocks.withColumn("level0", F.transform("rows", lambda r: r["leaf"]))
    for i in range(levels):
        goes_on = (F.size(f"level{i}") > 1) | (F.col("block") > 0)
        nodes = nodes.withColumn(f"level{i + 1}", F.when(goes_on, _up(F.col(f"level{i}"), fanout)).otherwise(F.col(f"level{i}"))).withColumn(f"step{i}", goes_on)
    return nodes.withColumn("digest", F.col(f"level{levels}")[0])


def _exchanged(blocks: DataFrame, fanout: int) -> DataFrame:
    """(tree_no, block, root, upper): by rounds in which aligned groups of blocks swap the roots of their subtrees.

    In round r the blocks of a group hold ``span = fanout ** r`` blocks each in common; a block
    meets those that have its number but for digit r. Where the last group lacks a partner, a block
    of it that holds the same root stands in.
    """
    sizes = blocks.groupBy("tree_no").agg((F.max("block") + 1).alias("n_blocks"))
    state = blocks.select("tree_no", "block", "digest").join(sizes, "tree_no").withColumn("upper", F.array().cast(f"array<{STEP}>"))
    most = sizes.agg(F.max("n_blocks")).first()[0] or 0
    span = 1
    while span < most:
        n, block = F.col("n_blocks"), F.col("block")
        runs = n > span
        low, digit = block % span, F.floor(block / span) % fanout
        begin = block - low
        held = F.least(F.lit(span), n - begin)
        lows = F.when(runs & (digit > 0) & (held < span), F.sequence(low, F.lit(span - 1).cast("long"), held)).otherwise(F.array(low))
        group = F.when(runs, F.floor(block / (span * fanout))).otherwise(F.floor(block / span))
        sent = state.select("*", group.alias("group"), digit.cast("int").alias("digit"), F.explode(lows).alias("low"))
        met = W.partitionBy("tree_no", "group", "low")
        swapped = sent.withColumn("all", F.when(runs, F.sort_array(F.collect_list(F.struct("digit", "digest")).over(met)))).where(F.col("low") == F.col("block") % span)
        swapped = swapped.withColumn("run", F.transform("all", lambda x: x["digest"]))
        step = F.struct(F.col("digit").alias("place"), F.filter("run", lambda _, i: i != F.col("digit")).alias("siblings"))
        state = swapped.select(
            "tree_no", "block", F.when(runs, F.sha2(F.array_join("run", ""), 256)).otherwise(F.col("digest")).alias("digest"), "n_blocks",
            F.when(runs, F.array_append("upper", step)).otherwise(F.col("upper")).alias("upper"),
        )
        span *= fanout
    return state.select("tree_no", "block", F.col("digest").alias("root"), "upper")


def _paths(blocks: DataFrame, upper: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The leaves of ``blocks`` with the columns of ``upper`` (tree_no, block, upper, ...) and ``proof``: the steps inside the block, then those above it."""
    each = blocks.join(upper, ["tree_no", "block"]).withColumn("row", F.explode("rows"))
    place = F.col("row.place")
    steps = F.array(*[F.when(F.col(f"step{i}"), step_of(F.col(f"level{i}"), F.floor(place / fanout**i), fanout)) for i in range(levels)])
    own = [F.col(f"row.{f.name}").alias(f.name) for f in blocks.schema["rows"].dataType.elementType.fields if f.name != "place"]
    told = [c for c in upper.columns if c not in ("block", "upper")]
    return each.select(*told, *own, F.concat(F.array_compact(steps), "upper").alias("proof"))


def proofs(leaves: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Per leaf (tree_no, position, leaf, ...): tree_no, the ``root`` of its tree, its other columns and the ``proof`` up to the root.

    Positions of a tree run from 0 without gaps. A proof has a step for each level: the node's
    place in its run, and the run's other nodes from left to right. No rows give no rows.
    """
    blocks = keep(_blocks(leaves, fanout, levels), "blocks")
    return _paths(blocks, _exchanged(blocks, fanout), fanout, levels)


def manifest(docs: DataFrame, fanout: int = FANOUT, levels: int = LEVELS, **kept: Column) -> DataFrame:
    """Per row of ``docs`` (doc_id, source, lang, n_chars, text): doc_id, leaf, subroot, root, proof; then the columns of ``kept``.

    The rows of a source are the leaves of its tree by doc_id; the roots of the sources, a null one
    first and then by UTF-8 bytes, are the leaves of the tree over them. ``proof`` has the steps
    from the leaf up to the root, through the subroot.

    Defined cases: a null field is ``-``, an empty text ``0:``; a null doc_id comes before all others;
    rows of equal source and doc_id stand by their leaves, and fully equal ones have equal leaves, so
    their order changes no digest; a source of one row has its leaf as subroot, and a single source's
    subroot is the root; other columns are ignored; no rows give no rows.
    """
    rows = keep(docs.select("doc_id", F.col("source").cast("string").alias("source"), leaf().alias("leaf"), *[c.alias(n) for n, c in kept.items()]), "leaves")
    numbered, placed = _numbered(rows, "source", ["doc_id", "leaf"])
    blocks = keep(_blocks(numbered.drop("source"), fanout, levels), "blocks")
    forget(rows)
    forget(placed)
    lower = keep(_exchanged(blocks, fanout), "lower")
    subroots = lower.where("block = 0").select(F.lit(0).cast("long").alias("all"), F.col("tree_no").alias("position"), F.col("root").alias("leaf"), F.col("tree_no").alias("source_no"))
    top = proofs(subroots.withColumnRenamed("all", "tree_no"), fanout, levels).select(F.col("source_no").alias("tree_no"), F.col("root").alias("top"), F.col("proof").alias("rest"))
    upper = lower.join(top, "tree_no").select("tree_no", "block", F.col("root").alias("subroot"), F.col("top").alias("root"), F.concat("upper", "rest").alias("upper"))
    return _paths(blocks, upper, fanout, levels).select("doc_id", "leaf", "subroot", "root", "proof", *kept)


def digest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The manifest of ``docs`` checked against rows of which some were tampered with.

    Where the unsigned CRC-32 of the decimal doc_id is even, the row that is checked has lost the
    line feeds of its text; a null doc_id is never tampered with.
    """
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, leaf(text=F.regexp_replace("text", "\n", "")))
    found = manifest(docs, levels=levels, tampered=F.when(F.contains("text", F.lit("\n")), changed))
    folded = fold(F.coalesce("tampered", "leaf"), F.col("proof"))
    siblings = F.flatten(F.transform("proof", lambda step: step["siblings"]))
    out = found.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(siblings, ""), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: The same in DuckDB SQL: levels and folding by recursion, CRC-32 by its table.
ORACLE = r"""
WITH RECURSIVE
bits AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(CAST(n AS UBIGINT), list_transform(range(8), lambda i: 0::UBIGINT)), lambda c, z: xor(c >> 1, (c & 1) * 3988292384))) AS t),
d AS (SELECT doc_id, source, text, row_number() OVER () AS r,
        coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
        || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS front,
        list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS UBIGINT))), lambda c, b: xor(c >> 8, bits.t[CAST(xor(c, b) & 255 AS BIGINT) + 1])) AS crc
      FROM documents, bits),
l AS (SELECT r, doc_id, source, sha256(front || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
        CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN sha256(front || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS tampered FROM d),
p AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
lower_nodes AS (
  SELECT tree, 0 AS lvl, pos, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM p
  UNION ALL
  SELECT tree, any_value(lvl) + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM lower_nodes WHERE n > 1 GROUP BY tree, pos // 3),
upper_nodes AS (
  SELECT 0 AS lvl, CAST(tree AS BIGINT) AS pos, h, count(*) OVER () AS n FROM lower_nodes WHERE n = 1
  UNION ALL
  SELECT any_value(lvl) + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM upper_nodes WHERE n > 1 GROUP BY pos // 3),
lower_runs AS (SELECT tree, lvl, pos // 3 AS run, list(h ORDER BY pos) AS hs, any_value(n) AS n FROM lower_nodes WHERE n > 1 GROUP BY ALL),
upper_runs AS (SELECT lvl, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM upper_nodes WHERE n > 1 GROUP BY ALL),
runs AS (
  SELECT tree, lvl, run, hs FROM lower_runs
  UNION ALL SELECT t.tree, t.top + u.lvl, u.run, u.hs FROM (SELECT tree, max(lvl) AS top FROM lower_nodes GROUP BY tree) t, upper_runs u),
tops AS (SELECT tree, lvl AS top, h AS subroot FROM lower_nodes WHERE n = 1),
fold AS (
  SELECT r, tree, 0 AS lvl, pos, coalesce(tampered, leaf) AS h, '' AS siblings, top FROM p JOIN tops USING (tree)
  UNION ALL
  SELECT f.r, f.tree, f.lvl + 1, CASE WHEN f.lvl + 1 = f.top THEN f.tree ELSE f.pos // 3 END,
         sha256(array_to_string(list_concat(list_concat(list_slice(g.hs, 1, spot), [f.h]), list_slice(g.hs, spot + 2, len(g.hs))), '')), f.siblings || array_to_string(list_concat(list_slice(g.hs, 1, spot), list_slice(g.hs, spot + 2, len(g.hs))), ''), f.top
  FROM (SELECT *, CASE WHEN lvl = top THEN tree ELSE pos END AS q, CASE WHEN lvl = top THEN tree ELSE pos END % 3 AS spot FROM fold) f
  JOIN runs g ON g.tree = f.tree AND g.lvl = f.lvl AND g.run = f.q // 3),
ended AS (SELECT r, arg_max(h, lvl) AS folded_root, arg_max(siblings, lvl) AS siblings FROM fold GROUP BY r)
SELECT doc_id, leaf, subroot, u.h AS root, sha256(siblings) AS proof_sha256, folded_root, folded_root = u.h AS verified
FROM p JOIN tops USING (tree) JOIN ended USING (r), (SELECT h FROM upper_nodes WHERE n = 1) u
"""
