"""A Merkle manifest of a dataset: persisted levels built bottom-up, inclusion proofs pushed top-down.

Leaves of a group (a language) are numbered in the order of their ids. A tree is built SPAN = ARITY ** HEIGHT nodes at a
time: neighbours that share a run of SPAN places become one row, which holds all HEIGHT levels above them, and its last hash
is a node of the next persisted level. So a level is a SPAN-th of the one below, and no row holds more than SPAN nodes. The
groups' subroots, in the order of groups, are the leaves of one more tree, whose last node is the root.

Proofs go the other way: a level joins its children to their parents by place, and each child prepends its own siblings to
the suffix that its parent has inherited. Only suffixes of parents are shuffled; those of leaves, which are nearly all, are
made where their row of SPAN neighbours is read.

Defined cases: a null column hashes as `-`, an empty text as `0:`; null ids come first in their group and rows with equal ids
are in the order of their leaves (repeated rows are leaves of their own); a null group is a group, before all others; an empty table
gives no rows; texts are hashed whole whatever their length; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import materialize, pick

ARITY = 2
HEIGHT = 8
PROOF = "array<struct<before:string,after:string>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, group (never null, in the order of lang), leaf, and tampered: the leaf with n_chars + 1 where 7 divides crc32(doc_id), else null."""
    parts = {c: field(F.col(c)) for c in FIELDS}
    more = parts | {"n_chars": field(F.col("n_chars").cast("decimal(38,0)") + 1)}
    touched = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    group = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    return pick(docs, *FIELDS).select("doc_id", group.alias("group"), digest(*parts.values()).alias("leaf"), F.when(touched, digest(*more.values())).alias("tampered"))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows, with idx (place in its group in the given order, from 0) and n (rows of the group).

    Rows are range-partitioned, so that a large group is many tasks; places within a partition are kept as written, and one row for
    each partition and group says how many come before.
    """
    ordered = rows.repartitionByRange("group", *order).sortWithinPartitions("group", *order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(ordered, name).withColumn("_part", F.shiftright("_at", 33))
    runs = placed.groupBy("_part", "group").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy("group")
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("_part", "group", "_first", before.alias("_before"), F.sum("_n").over(whole).alias("n"))
    return placed.join(runs, ["_part", "group"]).withColumn("idx", F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_part", "_first", "_before")


@dataclass
class Tree:
    """levels: persisted tables of blocks, leaves first; roots: group, hash of its tree's last node."""

    levels: list[DataFrame]
    roots: DataFrame
    arity: int
    span: int


def blocks(nodes: DataFrame, more: list[str], arity: int, height: int) -> DataFrame:
    """One row for each run of arity ** height neighbours: group, block, n, cells (idx, hash and more, in order), levels (from the cells' hashes up).

    A tree of one block ends with its single node; any other block goes all the way up, as its neighbours do.
    """
    span = arity**height

    def above(a: Column) -> Column:
        last = F.floor((F.size(a) - 1) / arity).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: digest(F.array_join(F.slice(a, i * arity + 1, F.lit(arity)), "")))

    def step(levels: Column, _: Column) -> Column:
        top = F.element_at(levels, -1)
        return F.when((F.col("n") <= span) & (F.size(top) == 1), levels).otherwise(F.concat(levels, F.array(above(top))))

    cells = F.array_sort(F.collect_list(F.struct("idx", "hash", *more)))
    grouped = nodes.groupBy("group", F.floor(F.col("idx") / span).alias("block")).agg(F.max("n").alias("n"), cells.alias("cells"))
    levels = F.aggregate(F.sequence(F.lit(1), F.lit(height)), F.array(F.transform("cells", lambda c: c["hash"])), step)
    return grouped.withColumn("levels", levels)


def build(nodes: DataFrame, more: list[str], arity: int = ARITY, height: int = HEIGHT, name: str = "merkle") -> Tree:
    """The trees over nodes (group, idx, n, hash and the columns more); each level is written to the shared folder."""
    span, levels, roots = arity**height, [], None
    while True:
        levels.append(materialize(blocks(nodes, more, arity, height), f"{name}-{len(levels)}"))
        top = F.element_at(F.element_at("levels", -1), 1).alias("hash")
        ended = levels[-1].where(F.col("n") <= span).select("group", top)
        roots = ended if roots is None else roots.union(ended)
        nodes, more = levels[-1].where(F.col("n") > span).select("group", F.col("block").alias("idx"), F.ceil(F.col("n") / span).alias("n"), top), []
        if nodes.isEmpty():
            return Tree(levels, roots, arity, span)


def siblings(levels: Column, place: Column, arity: int) -> Column:
    """For each level of a block but its last, the hashes before and after those that the cell at this place is part of, in its run."""

    def step(nodes: Column, height: Column) -> Column:
        p = F.floor(place / F.pow(F.lit(float(arity)), height)).cast("int")
        before, after = F.slice(nodes, p - p % arity + 1, p % arity), F.slice(nodes, p + 2, F.lit(arity - 1) - p % arity)
        return F.struct(F.array_join(before, "").alias("before"), F.array_join(after, "").alias("after"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), step)


def push(tree: Tree, tops: DataFrame, carry: list[str]) -> DataFrame:
    """group, cell and proof of each leaf, and the columns carry that its group has in tops (group, proof, carry).

    A proof goes from the leaf up; each step has the run's hashes before the node and those after it, both empty where the node is alone.
    """
    nodes = None
    for level in reversed(tree.levels):
        # a tree's last block takes the suffix that tops has for the group, any other the proof of its node on the level above
        parents = tops.select("group", F.lit(0).cast("long").alias("block"), F.lit(True).alias("whole"), F.col("proof").alias("suffix"), *carry)
        if nodes is not None:
            parents = parents.union(nodes.select("group", "cell.idx", F.lit(False), "proof", *carry))
        here = level.withColumn("whole", F.col("n") <= tree.span).join(parents, ["group", "block", "whole"])
        proven = F.transform("cells", lambda c, place: F.struct(c.alias("cell"), F.concat(siblings(F.col("levels"), place, tree.arity), F.col("suffix")).alias("proof")))
        nodes = here.select("group", *carry, F.explode(proven).alias("_x")).select("group", "_x.cell", "_x.proof", *carry)
    return nodes


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda node, run: digest(run["before"], node, run["after"]))


def manifest(docs: DataFrame, arity: int = ARITY, height: int = HEIGHT) -> DataFrame:
    """doc_id, group, idx, leaf, tampered, subroot, root, proof (array of before, after) of each document."""
    hashed = materialize(leaves(docs), "merkle-hashes").withColumnRenamed("leaf", "hash")
    tree = build(numbered(hashed, ["doc_id", "hash"], "merkle-order"), ["doc_id", "tampered"], arity, height, "merkle-level")
    groups = tree.roots.select(F.lit("").alias("group"), F.col("group").alias("name"), "hash")
    over = build(numbered(groups, ["name"], "merkle-groups"), ["name"], arity, height, "merkle-root")
    tops = push(over, over.roots.select("group", F.array().cast(PROOF).alias("proof"), F.col("hash").alias("root")), ["root"])
    tops = tops.select(F.col("cell.name").alias("group"), "proof", F.col("cell.hash").alias("subroot"), "root")
    proven = push(tree, tops, ["subroot", "root"])
    return proven.select("cell.doc_id", "group", "cell.idx", F.col("cell.hash").alias("leaf"), "cell.tampered", "subroot", "root", "proof")


def checked(proven: DataFrame) -> DataFrame:
    """The manifest's digests: doc_id, leaf, subroot, root, proof_sha256, folded_root (of the tampered leaf where there is one), verified."""
    joined = F.array_join(F.transform("proof", lambda run: F.concat(run["before"], run["after"])), "")
    out = proven.select("doc_id", "leaf", "subroot", "root", F.sha2(joined, 256).alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, zero: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END))))"""


def _climb(tree: str, start: str) -> str:
    """Recursive tables of one tree: its nodes, and the state of each document on its way up."""
    return f"""
{tree}_nodes AS (
  SELECT grp, 0 AS lvl, idx, h, n FROM {tree}_leaves
  UNION ALL
  SELECT grp, lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2 FROM {tree}_nodes WHERE n > 1 GROUP BY grp, lvl, idx // 2, n),
{tree}_last AS (SELECT grp, h FROM {tree}_nodes WHERE n = 1),
{tree}_way AS (
  {start}
  UNION ALL
  SELECT w.leaf, w.doc_id, w.grp, w.lvl + 1, w.idx // 2, (w.n + 1) // 2, w.proof || coalesce(s.h, ''), sha256(CASE WHEN w.idx % 2 = 0 THEN w.f || coalesce(s.h, '') ELSE s.h || w.f END)
  FROM {tree}_way w LEFT JOIN {tree}_nodes s ON s.grp = w.grp AND s.lvl = w.lvl AND s.idx = xor(w.idx, 1) WHERE w.n > 1)"""


MERKLE_SQL = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, coalesce('=' || lang, '') AS grp, {_CRC} % 7 = 0 AS touched, sha256({" || ".join(_FIELD.format(c) for c in FIELDS)}) AS h,
         sha256({" || ".join(_FIELD.format("(n_chars::HUGEINT + 1)" if c == "n_chars" else c) for c in FIELDS)}) AS t, n_chars IS NOT NULL AS counted
  FROM documents),
doc_leaves AS (
  SELECT doc_id, grp, h, CASE WHEN touched AND counted THEN t ELSE h END AS f, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n
  FROM hashed),
{_climb("doc", "SELECT h AS leaf, doc_id, grp, 0 AS lvl, idx, n, '' AS proof, f FROM doc_leaves")},
top_leaves AS (SELECT 0 AS grp, grp AS name, h, row_number() OVER (ORDER BY encode(grp)) - 1 AS idx, count(*) OVER () AS n FROM doc_last),
{_climb("top", "SELECT w.leaf, w.doc_id, 0 AS grp, 0 AS lvl, t.idx, t.n, w.proof, w.f FROM doc_way w JOIN top_leaves t ON t.name = w.grp WHERE w.n = 1")}
SELECT w.doc_id, w.leaf, d.h AS subroot, r.h AS root, sha256(w.proof) AS proof_sha256, w.f AS folded_root, w.f = r.h AS verified
FROM top_way w CROSS JOIN top_last r JOIN doc_leaves l ON l.doc_id IS NOT DISTINCT FROM w.doc_id AND l.h = w.leaf JOIN doc_last d ON d.grp = l.grp WHERE w.n = 1
"""
