"""Merkle manifest of a table, with each level of a block of nodes as one hex string.

Nodes of a tree are numbered from 0 and dealt to aligned blocks of ``3 ** 5``. A block keeps a level as one string, 64 hex digits a
node. As blocks are aligned, the children of a parent are one fixed-width substring of it (192 digits, fewer at the end), so the next
level is ``sha2`` over such substrings, and what flanks a node inside its run, the substrings before and after it, are its
sibling segments. The tops of blocks are the nodes of the next, 243 times smaller table, and so on until a tree has one node; the
roots of all trees are the nodes of the last tree. All of it is SQL functions.

Numbers come from a sort by range: nodes are counted in each range and tree, and a range's offset is the sum of the counts before
it, so a tree with most nodes is spread over many tasks. Only digests and ids are shuffled, texts are read once.

Defined cases. Of one source, rows with a null id come first, rows with one id are ordered by their leaves; rows that agree in all are nodes of
their own. Null fields are ``-``. A null id counts as untampered. Texts are hashed whole, of any length. A null source is a
tree of its own. An empty table has no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_hot, stored

RUN = 3
#: Levels of a block, so it has ``RUN ** LEVELS`` nodes at most.
LEVELS = 5
BLOCK = RUN**LEVELS
HEX = 64
#: Nodes of one range of the sort, about, and ranges at most.
RANGE_ROWS, MOST_RANGES = 20_000, 10_000


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*inputs: Column) -> Column:
    """Lowercase hex sha256 of the inputs one after the other."""
    return F.sha2(F.concat(*inputs).cast("binary"), 256)


def leaves(docs: DataFrame, fields: list[str], text_col: str, tampered: Column) -> DataFrame:
    """``id, source, leaf, folded``: a row's digest, and the one it has after tampering, where that deletes the text's line ends."""
    whole = [field(F.col(c)) for c in fields]
    cut = [field(F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == text_col else F.col(c)) for c in fields]
    changed = F.coalesce(tampered, F.lit(False)) & F.coalesce(F.contains(F.col(text_col), F.lit("\n")), F.lit(False))
    return docs.select(
        F.col(fields[0]).cast("long").alias("id"), F.col(fields[1]).cast("string").alias("source"), digest(*whole).alias("leaf"), F.when(changed, digest(*cut)).alias("other"),
    ).select("id", "source", "leaf", F.coalesce("other", "leaf").alias("folded"))


def _met(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The two joined on ``keys``, where null equals null."""
    other = right.withColumnsRenamed({c: f"_{c}" for c in keys})
    condition = F.lit(True)
    for c in keys:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return left.join(other, condition).drop(*(f"_{c}" for c in keys))


def numbered(nodes: DataFrame, tree: list[str], order: list[Column], rows: int) -> DataFrame:
    """``nodes`` (``rows`` rows) with ``number``, the place of each in its tree from 0, by ``order``, and ``nodes``, how many its tree has."""
    ranges = min(MOST_RANGES, rows // RANGE_ROWS + 1)
    dealt = nodes.repartitionByRange(ranges, *(F.asc_nulls_first(c) for c in tree), *order).withColumn("range", F.spark_partition_id())
    dealt = stored(dealt, "ranges")
    before = Window.partitionBy(*tree).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("range", *tree).agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("range", *tree, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy(*tree)).alias("nodes"))
    own = dealt.withColumn("place", F.row_number().over(Window.partitionBy("range", *tree).orderBy(*order)) - 1)
    return _met(own, starts, ["range", *tree]).select(*nodes.columns, "nodes", (F.col("place") + F.col("start")).alias("number"))


def _parents(under: Column) -> Column:
    """The level above ``under``, a level as one string."""
    runs = F.sequence(F.lit(0), F.floor((F.length(under) - 1) / (RUN * HEX)).cast("int"))
    return F.concat_ws("", F.transform(runs, lambda i: F.sha2(F.substring(under, i * (RUN * HEX) + 1, F.lit(RUN * HEX)).cast("binary"), 256)))


def _blocks(nodes: DataFrame, tree: list[str], held: list[str]) -> DataFrame:
    """One row a block: ``held`` (the columns of its nodes, as an array in order), its levels as strings ``levels`` and its ``top``.

    A tree of one block ends at one node; in a larger one, a block ends ``LEVELS`` up, whatever number of nodes it has.
    """
    block = F.floor(F.col("number") / BLOCK).cast("long").alias("block")
    rows = nodes.groupBy(*tree, block).agg(F.sort_array(F.collect_list(F.struct("number", "digest", *held))).alias("held"), F.first("nodes").alias("nodes"))  # BLOCK nodes at most
    rows = rows.withColumn("level0", F.concat_ws("", F.col("held.digest")))
    for k in range(LEVELS):
        under = F.col(f"level{k}")
        grows = (F.col("nodes") > BLOCK) | (F.length(under) > HEX)
        rows = rows.withColumn(f"level{k + 1}", F.when(grows, _parents(under)))
    top = F.coalesce(*(F.col(f"level{k}") for k in range(LEVELS, -1, -1)))
    return rows.withColumn("top", top).select(*tree, "block", "nodes", "held", "top", F.array(*(F.col(f"level{k}") for k in range(LEVELS + 1))).alias("levels"))


def _segments(levels: Column, place: Column) -> Column:
    """For each level below the top, what stands before and after the node in its run: an array of ``before, after``."""
    out = []
    for k in range(LEVELS):
        node = F.floor(place / RUN**k).cast("int")
        run = F.substring(levels[k], F.floor(node / RUN).cast("int") * (RUN * HEX) + 1, F.lit(RUN * HEX))
        at = (node % RUN) * HEX
        flanks = F.struct(F.substring(run, F.lit(1), at).alias("before"), F.substring(run, at + (HEX + 1), F.lit(2 * HEX)).alias("after"))
        out.append(F.when(levels[k + 1].isNotNull(), flanks))
    return F.filter(F.array(*out), lambda s: s.isNotNull())


def paths(nodes: DataFrame, tree: list[str], held: list[str]) -> DataFrame:
    """``tree`` and ``held`` columns of each node, its ``digest``, its ``path`` (sibling segments up to the top of its tree) and that ``top``.

    ``nodes`` has ``number, nodes, digest`` besides. Each pass of the recursion has a table 243 times smaller.
    """
    rows = stored(_blocks(nodes, tree, held), "blocks")
    if rows.where("block > 0").limit(1).count():
        upper = rows.select(*tree, "block", F.col("top").alias("digest"), F.col("block").alias("number"), F.ceil(F.col("nodes") / BLOCK).alias("nodes"))
        above = paths(upper, tree, ["block"]).select(*tree, "block", F.col("path").alias("above"), "top")
        joined = _met(rows.drop("top"), above, ["block", *tree])
    else:
        joined = rows.withColumn("above", F.expr("cast(array() as array<struct<before:string,after:string>>)"))
    levels, above = F.col("levels"), F.col("above")
    each = F.transform("held", lambda h, i: F.struct(h["digest"].alias("digest"), *(h[c].alias(c) for c in held), F.concat(_segments(levels, i), above).alias("path")))
    return joined.select(*tree, "top", F.explode(each).alias("node")).select(*tree, "top", "node.digest", *(f"node.{c}" for c in held), "node.path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its sibling segments give."""
    return F.aggregate(path, leaf, lambda h, s: digest(s["before"], h, s["after"]))


def proof(path: Column) -> Column:
    """sha256 of the sibling segments, level by level, left to right."""
    return digest(F.concat_ws("", F.flatten(F.transform(path, lambda s: F.array(s["before"], s["after"])))))


def manifest(docs: DataFrame, fields: list[str], text_col: str = "text", tampered: Column | None = None) -> DataFrame:
    """``id, source, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row, and its ``path``.

    ``fields`` are hashed into the leaf; the first one orders a source's leaves, the second is the source.
    """
    found = stored(leaves(docs, fields, text_col, F.lit(False) if tampered is None else tampered), "leaves")
    rows = found.count()
    nodes = numbered(found.withColumn("digest", F.col("leaf")), ["source"], [F.asc_nulls_first("id"), F.asc("leaf"), F.asc("folded")], rows)
    below = stored(paths(nodes, ["source"], ["id", "folded"]).withColumn("key", F.coalesce(F.concat(F.lit("v"), F.col("source")), F.lit("n"))), "paths")
    trees = stored(below.groupBy("key").agg(F.first("source").alias("source"), F.first("top").alias("digest"), F.count(F.lit(1)).alias("n")), "trees")
    roots = numbered(trees.withColumn("tree", F.lit(0)), ["tree"], [F.asc_nulls_first("source")], trees.count())
    upper = paths(roots, ["tree"], ["key", "n"]).select("key", "n", F.col("top").alias("root"), F.col("path").alias("above"))
    met = join_hot(below, stored(upper, "roots"), "key", rows).withColumn("path", F.concat("path", "above"))
    out = met.withColumn("folded_root", folded(F.col("folded"), F.col("path")))
    return out.select(
        "id", "source", F.col("digest").alias("leaf"), F.col("top").alias("subroot"), "root", proof(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"), "path")


def op12(docs: DataFrame) -> DataFrame:
    """Contract columns; where 2 divides the crc32 of the decimal id, the text's line ends are deleted."""
    own = docs.select("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return manifest(own, own.columns, "text", tampered).select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


OP12_SQL = """
with recursive d as (
  select doc_id, source, case when source is null then 'n' else 'v' || source end as k, text,
    coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as head,
    list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))) % 2 = 1 as even
  from documents),
l as (
  select *, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
    case when even then sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) else sha256(head || coalesce(strlen(text) || ':' || text, '-')) end as other
  from d),
r as (select *, row_number() over (partition by k order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by k) as n from l),
nodes as (
  select k, 0 as lvl, idx, leaf as h, n from r
  union all
  select k, lvl + 1, idx // 3, sha256(string_agg(h, '' order by idx)), (n + 2) // 3 from nodes where n > 1 group by k, lvl, idx // 3, n),
tops as (select k, h, row_number() over (order by k) - 1 as idx, count(*) over () as n from nodes where n = 1),
supers as (
  select 0 as lvl, idx, h, n from tops
  union all
  select lvl + 1, idx // 3, sha256(string_agg(h, '' order by idx)), (n + 2) // 3 from supers where n > 1 group by lvl, idx // 3, n),
runs as (select k, lvl, idx // 3 as run, list(h order by idx) as hs from nodes where n > 1 group by k, lvl, idx // 3),
super_runs as (select lvl, idx // 3 as run, list(h order by idx) as hs from supers where n > 1 group by lvl, idx // 3),
fold as (
  select doc_id, k, 0 as lvl, idx, leaf, other as h, '' as proof, row_number() over () as row_no from r
  union all
  select doc_id, k, lvl + 1, idx // 3, leaf, sha256(array_to_string(hs[1:idx % 3], '') || h || array_to_string(hs[idx % 3 + 2:], '')),
    proof || array_to_string(hs[1:idx % 3], '') || array_to_string(hs[idx % 3 + 2:], ''), row_no
  from fold join runs using (k, lvl) where run = idx // 3),
below as (select * from fold qualify row_number() over (partition by row_no order by lvl desc) = 1),
fold2 as (
  select doc_id, t.h as subroot, 0 as lvl, t.idx, leaf, b.h, proof, row_no from below b join tops t using (k)
  union all
  select doc_id, subroot, lvl + 1, idx // 3, leaf, sha256(array_to_string(hs[1:idx % 3], '') || h || array_to_string(hs[idx % 3 + 2:], '')),
    proof || array_to_string(hs[1:idx % 3], '') || array_to_string(hs[idx % 3 + 2:], ''), row_no
  from fold2 join super_runs using (lvl) where run = idx // 3),
done as (select * from fold2 qualify row_number() over (partition by row_no order by lvl desc) = 1),
top as (select h as root from supers where n = 1)
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, h as folded_root, h = root as verified from done, top
"""
