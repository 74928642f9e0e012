"""Merkle manifest of a dataset, built by sibling-shift self-joins.

A row's digest is a leaf; leaves stand in id order within their group (the source), and
every ``arity`` consecutive nodes have one parent, up to a subroot for each group. The
subroots, in group order, are the leaves of the top tree, whose root names the dataset.

Levels: every node of a level is joined with the nodes at its computed sibling places
(``place XOR 1`` for two, else the slot shifted by 1 to ``arity - 1`` within the run).
The joined rows hold what a proof needs, left and right siblings, and the slot-zero rows
among them emit the parents, so a level is computed once and written to the shared
folder. Rows are keyed by (tree, place): a group of a third of all rows is spread like
any other, and only 32-byte digests travel; texts never shuffle.

Digests: SHA-256 in lower-case hex over fields joined as ``length:value`` (UTF-8 bytes,
``-`` for null); a parent's input is its children's hex digests. Tables keep 32 bytes.

Defined cases: null ids come first in their group, as a null group does among groups;
equal ids stand in the order of their digests; repeated rows are leaves of their own; a
lone leaf is its group's subroot and a lone subroot is the root, with empty proofs; an
empty table has no leaves and no root. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cribra.llm.common import written
from cribra.operators.ordering import global_index

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 3


def record_digest(*fields: Column) -> Column:
    """Hex SHA-256 of the fields, each ``-`` if null, else its UTF-8 length, ``:`` and the value."""
    texts = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def node_digest(*parts: Column) -> Column:
    """Binary digest of a run: SHA-256 over the hex text of its (concatenated) digests."""
    return F.unhex(F.sha2(F.concat(*[_hex(p) for p in parts]), 256))


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """``nodes`` (``tree``, ``place``, ``digest`` and more) with ``left`` and ``right``: the digests
    of the run's other nodes before and after each node, concatenated."""
    slot = F.col("place") % arity
    out = nodes
    for shift in range(1, arity):
        at = (F.col("place").bitwiseXOR(F.lit(1).cast("long")) if arity == 2
              else F.col("place") - slot + (slot + shift) % arity)
        there = nodes.select(F.col("tree").alias("_tree"), F.col("place").alias("_place"),
                             F.col("digest").alias(f"_sibling{shift}"))
        out = (out.withColumn("_at", at)
               .join(there, (F.col("tree") == F.col("_tree")) & (F.col("_at") == F.col("_place")), "left")
               .drop("_tree", "_place", "_at"))

    def sibling(k: int) -> Column:
        """Digest at slot ``k`` of the node's run, empty for the node itself and past the end."""
        by_shift = [F.when((slot + s) % arity == k, F.col(f"_sibling{s}")) for s in range(1, arity)]
        return F.coalesce(*by_shift, F.lit(b""))

    def joined(before: bool) -> Column:
        return F.concat(*[F.when((F.lit(k) < slot) if before else (F.lit(k) > slot), sibling(k))
                          .otherwise(F.lit(b"")) for k in range(arity)])

    return out.select(*nodes.columns, joined(True).alias("left"), joined(False).alias("right"))


def climb(nodes: DataFrame, arity: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """All levels below the tops, lowest first, and the tops (``tree``, ``digest``).

    ``nodes``: ``tree``, ``size`` (nodes of that tree), ``place`` from 0, ``digest``. A tree of
    one node is its own top. Each level is one written table.
    """
    levels, tops = [], nodes.where("size = 1").select("tree", "digest")
    most = nodes.agg(F.max("size")).first()[0] or 0
    while most > 1:
        level = written(with_siblings(nodes.where("size > 1"), arity), f"{name}-level{len(levels)}")
        levels.append(level)
        nodes = level.where(F.col("place") % arity == 0).select(
            "tree", F.ceil(F.col("size") / arity).cast("long").alias("size"),
            F.floor(F.col("place") / arity).cast("long").alias("place"),
            node_digest(F.col("digest"), F.col("right")).alias("digest"))
        tops = tops.unionByName(nodes.where("size = 1").select("tree", "digest"))
        most = -(-most // arity)
    return levels, tops


def descend(levels: list[DataFrame], arity: int) -> DataFrame | None:
    """The lowest level's rows with ``path``: (left, right) siblings from the node up to its top."""
    above = None
    for level in reversed(levels):
        own = F.array(F.struct("left", "right"))
        if above is None:
            above = level.withColumn("path", own)
            continue
        up = above.select(F.col("tree").alias("_tree"), F.col("place").alias("_place"),
                          F.col("path").alias("_path"))
        none = F.array().cast("array<struct<left:binary,right:binary>>")
        above = (level.join(up, (F.col("tree") == F.col("_tree"))
                            & (F.floor(F.col("place") / arity).cast("long") == F.col("_place")), "left")
                 .withColumn("path", F.concat(own, F.coalesce("_path", none)))
                 .drop("_tree", "_place", "_path"))
    return above


@dataclass(frozen=True)
class Manifest:
    """``leaves``: id, ``digest``, ``tree``, ``size``, ``place`` and what was kept; ``levels`` and
    ``top_levels``: the written levels of the group trees and of the top tree; ``subroots``:
    ``tree``, ``digest``, ``place``; ``root``: its digest, None for an empty table."""
    leaves: DataFrame
    levels: list[DataFrame]
    subroots: DataFrame
    top_levels: list[DataFrame]
    root: bytes | None
    arity: int


def build(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source",
          fields: Sequence[str] = FIELDS, arity: int = ARITY,
          keep: dict[str, Column] | None = None) -> Manifest:
    """The manifest of ``docs``. ``keep``: further columns of each leaf, computed in the same scan."""
    keep = keep or {}
    leaves = written(docs.select(
        F.col(id_col).alias("id"), F.col(group_col).alias("group"),
        F.unhex(record_digest(*[F.col(f) for f in fields])).alias("digest"),
        *[c.alias(n) for n, c in keep.items()]), "merkle-leaves")
    # Nulls sort first in an ascending range order, strings by their UTF-8 bytes.
    placed = global_index(leaves, ["group", "id", "digest"], "at")
    groups = written(placed.groupBy("group").agg(F.min("at").alias("tree"), F.count("*").alias("size")),
                     "merkle-groups")
    nodes = (placed.join(groups.withColumnRenamed("group", "_group"), F.col("group").eqNullSafe(F.col("_group")))
             .withColumn("place", F.col("at") - F.col("tree")).drop("_group", "group", "at"))
    levels, tops = climb(nodes, arity, "merkle")
    # A tree is named by the place of its first leaf, so trees are in group order.
    subroots = written(global_index(tops, ["tree"], "place"), "merkle-subroots")
    top = subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(subroots.count()).cast("long").alias("size"),
                          "place", "digest")
    top_levels, root = climb(top, arity, "merkle-top")
    top_node = root.first()
    return Manifest(nodes, levels, subroots, top_levels, top_node and bytes(top_node["digest"]), arity)


def proofs(manifest: Manifest) -> DataFrame:
    """Every leaf (id, ``digest``, kept columns) with ``subroot``, ``root`` and ``path``: the
    (left, right) siblings, level by level, via the subroot to the root."""
    none = F.array().cast("array<struct<left:binary,right:binary>>")
    extra = [c for c in manifest.leaves.columns if c not in ("tree", "size", "place")]
    lone = manifest.leaves.where("size = 1").select(*extra, "tree", none.alias("path"))
    low = descend(manifest.levels, manifest.arity)
    leaves = lone if low is None else low.select(*extra, "tree", "path").unionByName(lone)
    upper = manifest.subroots.select("tree", "place", F.col("digest").alias("subroot"))
    high = descend(manifest.top_levels, manifest.arity)
    if high is None:
        upper = upper.withColumn("upper", none)
    else:
        upper = upper.join(high.select("place", F.col("path").alias("upper")), "place")
    upper = upper.drop("place").withColumn("root", F.lit(manifest.root).cast("binary"))
    return (leaves.join(upper, "tree").withColumn("path", F.concat("path", "upper")).drop("tree", "upper"))


def fold(leaf: Column, path: Column) -> Column:
    """Hex root that a leaf (hex digest) gives with the siblings of ``path``."""
    return F.aggregate(path, leaf, lambda acc, p: F.sha2(F.concat(_hex(p["left"]), acc, _hex(p["right"])), 256))


def siblings_digest(path: Column) -> Column:
    """Hex SHA-256 over the siblings of ``path``, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: _hex(F.concat(p["left"], p["right"]))), ""), 256)


def verify(docs: DataFrame, changed: Column, id_col: str = "doc_id", group_col: str = "source",
           fields: Sequence[str] = FIELDS, arity: int = ARITY) -> DataFrame:
    """Manifest of ``docs``, and for each row the root that its present digest folds to.

    ``changed``: hex digest of the row as it is now (see ``record_digest``). Returns
    ``id_col``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``.
    """
    found = proofs(build(docs, id_col, group_col, fields, arity, {"now": F.unhex(changed)}))
    out = found.select(
        F.col("id").alias(id_col), _hex(F.col("digest")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"),
        _hex(F.col("root")).alias("root"), siblings_digest(F.col("path")).alias("proof_sha256"),
        fold(_hex(F.col("now")), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
