"""Merkle manifest of a dataset: a hash tree over each source's rows, one over the sources, and every row's proof.

Only DataFrame functions. Leaves are written once, thin, and numbered within their source by range partitions: rows are counted a
partition and source, and a row's place is its number there and what earlier partitions hold, so that a source of any size is spread.
`block` consecutive nodes are one row with an array of hashes; levels are collapsed inside the row by sequence, transform and slice.
The block roots are the next round's nodes, until each source has one. Sources are numbered and collapsed likewise.
Proofs come down the same way: the path above a block is joined to the block's one row, and each node's own path is put together in it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut, shuffles

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 16
#: Levels that one round collapses; a block has ARITY ** DEPTH nodes.
DEPTH = 3
#: Nodes that a range partition holds at most, about: their number grows with the table.
NODES = 1 << 20
_PATH = "array<struct<l:string,r:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(c: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def numbered(nodes: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """nodes with _pos, the place (from 0) by order among those of equal `by`, and _all, how many these are. nodes should be materialised; ties keep the order of its files."""
    spark = nodes.sparkSession
    tied = nodes.withColumn("_tie", F.monotonically_increasing_id())
    n = max(shuffles(spark), -(-nodes.count() // NODES))  # counted from the files' footers
    parts = cut(tied.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in by], *order, F.col("_tie")).withColumn("_part", F.spark_partition_id()))
    key = [F.col(c) for c in by] or [F.lit(0)]
    counts = parts.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*key).orderBy("_part")
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_n").over(Window.partitionBy(*key)))
    counts = counts.select(F.col("_part").alias("_cp"), *[F.col(c).alias(f"_c_{c}") for c in by], "_before", "_all")
    row = F.row_number().over(Window.partitionBy("_part", *[F.col(c) for c in by]).orderBy(*order, "_tie"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_c_{c}")) for c in by], F.col("_part") == F.col("_cp"))
    out = parts.withColumn("_row", row).join(counts, same)
    return out.select(*[c for c in nodes.columns], (F.col("_before") + F.col("_row") - 1).alias("_pos"), "_all")


def _levels(n: Column) -> Column:
    """Levels above n nodes: 0 for one node, 1 for 2 to 16, ..."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(15)), F.lit(0), lambda a, k: F.when(F.pow(F.lit(ARITY), k - 1) < n, k).otherwise(a))


def _collapsed(nodes: Column) -> Column:
    """The next level of an array of nodes."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / ARITY).cast("int")), lambda i: F.sha2(F.array_join(F.slice(nodes, i * ARITY + 1, F.lit(ARITY)), ""), 256))


def blocks_of(nodes: DataFrame, by: list[str], carried: list[str]) -> DataFrame:
    """One row for each block of nodes (by, _pos, _up: levels still to come, node, carried): _block, _up, _rows (carried, in order), _l0 to _l2 (the levels' nodes; null above the top), root."""
    size = ARITY**DEPTH
    out = nodes.groupBy(*by, F.floor(F.col("_pos") / size).alias("_block")).agg(F.max("_up").alias("_up"), F.sort_array(F.collect_list(F.struct("_pos", "node", *carried))).alias("_rows"))
    out = out.withColumn("_l0", F.transform("_rows", lambda x: x["node"]))
    for k in range(1, DEPTH + 1):
        out = out.withColumn(f"_l{k}", F.when(F.col("_up") >= k, _collapsed(F.col(f"_l{k - 1}"))))
    top = F.coalesce(*[F.col(f"_l{k}") for k in range(DEPTH, -1, -1)])
    return cut(out.withColumn("_root", F.element_at(top, 1)).drop(f"_l{DEPTH}"))


def tree(nodes: DataFrame, by: list[str], carried: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """(rounds, roots): the blocks of each round, the first over the nodes themselves, and by and node, the root of each group. nodes: by, _pos, _all, node, carried."""
    nodes, rounds = nodes.withColumn("_up", _levels(F.col("_all"))), []
    while True:
        rounds.append(blocks_of(nodes, by, carried if not rounds else []))
        nodes = rounds[-1].select(*by, F.col("_block").alias("_pos"), F.greatest(F.col("_up") - DEPTH, F.lit(0)).alias("_up"), F.col("_root").alias("node"))
        most = rounds[-1].agg(F.max("_up")).first()[0]
        if most is None or most <= DEPTH:
            return rounds, nodes.select(*by, "node")


def _path(i: Column) -> Column:
    """Inside a block: the siblings of node i, left and right, at each level that the block has."""

    def level(k: int) -> Column:
        at = F.floor(i / ARITY**k).cast("int")
        first = at - at % ARITY
        row = F.col(f"_l{k}")
        return F.struct(F.array_join(F.slice(row, first + 1, at - first), "").alias("l"), F.array_join(F.slice(row, at + 2, first + ARITY - 1 - at), "").alias("r"))

    # no level above a block's last one is in the path, though a single node may stand on each below
    return F.slice(F.array(*[level(k) for k in range(DEPTH)]), F.lit(1), F.least(F.col("_up"), F.lit(DEPTH)))


def fold(node: Column, path: Column) -> Column:
    """The root that a node and its path give."""
    return F.aggregate(path, node, lambda a, s: digest(s["l"], a, s["r"]))


def paths(rounds: list[DataFrame], by: list[str], above: DataFrame | None = None) -> DataFrame:
    """The first round's blocks with _above, the path from the block's root up. above: by (as _a_...), _above of each group's root; nothing is above it if not given."""
    same = lambda cols: reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_a_{c}")) for c in cols], F.lit(True))
    keys, known = by, above
    for k in range(len(rounds) - 1, -1, -1):
        blocks = rounds[k].withColumnRenamed("_block", "_pos")
        blocks = blocks.withColumn("_above", F.array().cast(_PATH)) if known is None else blocks.join(known, same(keys), "left").drop(*[f"_a_{c}" for c in keys])
        if k == 0:
            return blocks
        each = F.transform("_rows", lambda x, i: F.struct(x["_pos"].alias("_pos"), F.concat(_path(i), F.col("_above")).alias("_above")))
        known = cut(blocks.select(*[F.col(c).alias(f"_a_{c}") for c in by], F.explode_outer(each).alias("_x")).select(*[f"_a_{c}" for c in by], F.col("_x._pos").alias("_a__pos"), F.col("_x._above").alias("_above")))
        keys = [*by, "_pos"]
    return blocks


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = FIELDS, tampered: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of docs: id, leaf, subroot (its source's), root, proof_sha256, folded_root, verified.

    tampered: what some fields hold when the dataset is verified, as columns of docs; folded_root is made of that leaf and of the
    original siblings, and verified says whether it is the root. Nulls: any field may be null and is `-` then; a null source is a source,
    before all others. Rows of a source that share an id, or have none (these come first), follow their leaves' hashes, and rows that repeat a whole row are
    leaves of their own with equal hashes; which of them has which proof is as the files have them. Other columns are not read; an empty table gives no rows.
    """
    d = docs.select(F.col(id_col).alias("_id"), F.col(group_col).alias("_group"), digest(*[field(F.col(f)) for f in fields]).alias("node"), digest(*[field((tampered or {}).get(f, F.col(f))) for f in fields]).alias("_now"))
    leaves = cut(d, scan=True)
    rows = numbered(leaves, ["_group"], [F.col("_id").asc_nulls_first(), F.col("node").asc()])
    rounds, subroots = tree(rows, ["_group"], ["_id", "_now"])
    subroots = cut(subroots)
    tops, root = tree(numbered(subroots, [], [F.col("_group").asc_nulls_first()]), [], ["_group"])
    root = root.first()
    top = paths(tops, [])
    each = F.transform("_rows", lambda x, i: F.struct(x["_group"].alias("_a__group"), x["node"].alias("_subroot"), F.concat(_path(i), F.col("_above")).alias("_above")))
    known = cut(top.select(F.explode_outer(each).alias("_x")).select("_x.*"))
    blocks = paths(rounds, ["_group"], known.select("_a__group", "_above"))
    subs = known.select(F.col("_a__group").alias("_g"), "_subroot")
    blocks = blocks.join(subs, F.col("_group").eqNullSafe(F.col("_g")), "left")

    def leaf(x: Column, i: Column) -> Column:
        own = F.concat(_path(i), F.col("_above"))
        proof = F.sha2(F.array_join(F.transform(own, lambda s: F.concat(s["l"], s["r"])), ""), 256)
        return F.struct(x["_id"].alias(id_col), x["node"].alias("leaf"), proof.alias("proof_sha256"), fold(x["_now"], own).alias("folded_root"))

    out = blocks.select("_subroot", F.explode_outer(F.transform("_rows", leaf)).alias("_x"))
    whole = F.lit(root["node"] if root else None).cast("string")
    return out.select(f"_x.{id_col}", "_x.leaf", F.col("_subroot").alias("subroot"), whole.alias("root"), "_x.proof_sha256", "_x.folded_root", (F.col("_x.folded_root") == whole).alias("verified"))


def lowered(id_col: str = "doc_id", text_col: str = "text", every: int = 5) -> dict[str, Column]:
    """Tampering for tests: A-Z of the text lower-cased where `every` divides the CRC of the id's decimal digits."""
    hit = F.crc32(F.col(id_col).cast("string").cast("binary")) % every == 0
    return {text_col: F.when(hit, ascii_lower(F.col(text_col))).otherwise(F.col(text_col))}
