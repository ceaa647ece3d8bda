"""Sharding by a hierarchical weighted hash tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, parts

#: region -> rack -> shard -> weight
Tree = dict[str, dict[str, dict[int, float]]]


def even_tree(shards: int = 8, racks: int = 2, per_rack: int = 2) -> Tree:
    """Shards 0, 1, ... of weight 1, dealt to racks of per_rack and regions of racks in turn."""
    tree: Tree = {}
    for s in range(shards):
        rack = s // per_rack
        tree.setdefault(f"region{rack // racks}", {}).setdefault(f"rack{rack}", {})[s] = 1.0
    return tree


def grown(tree: Tree, shard: int, weight: float = 1.0) -> Tree:
    """The tree with one more shard in a region of its own. No other subtree's weight changes, so rows move into that
    region, thus that shard, and nowhere else."""
    return {**tree, f"grown{shard}": {f"grown-rack{shard}": {shard: weight}}}


def _draw(key: list[str], choices: dict[str, float]) -> Column:
    """The choice with the largest ln(u) / weight, where u in (0, 1] is a hash of the key and the choice's name:
    each wins in proportion to its weight, and the draws of the others don't depend on it."""
    u = lambda name: (F.shiftrightunsigned(F.xxhash64(*key, F.lit(name)), 11) + 1) / F.lit(float(2**53))
    drawn = [F.struct((F.log(u(n)) / F.lit(float(w))).alias("draw"), F.lit(n).alias("name")) for n, w in choices.items() if w > 0]
    return (F.greatest(*drawn) if len(drawn) > 1 else drawn[0])["name"]


def _case(of: Column, results: dict[str, Column]) -> Column:
    out = None
    for name, value in results.items():
        out = F.when(of == name, value) if out is None else out.when(of == name, value)
    return out


def place(df: DataFrame, tree: Tree, key: list[str], out: str) -> DataFrame:
    """Adds out: the shard reached by a draw among the regions, then that region's racks, then that rack's shards.
    A subtree weighs as much as its shards together."""
    rack_w = {g: {r: sum(s.values()) for r, s in racks.items()} for g, racks in tree.items()}
    df = df.withColumn("_region", _draw(key, {g: sum(w.values()) for g, w in rack_w.items()}))
    df = df.withColumn("_rack", _case(F.col("_region"), {g: _draw(key, {f"{g}/{r}": w for r, w in racks.items()}) for g, racks in rack_w.items()}))
    leaves = {f"{g}/{r}": _draw(key, {f"{g}/{r}/{s}": w for s, w in shards.items()}) for g, racks in tree.items() for r, shards in racks.items()}
    return df.withColumn(out, F.element_at(F.split(_case(F.col("_rack"), leaves), "/"), -1).cast("int")).drop("_region", "_rack")


def shard_documents(docs: DataFrame, tree: Tree | None = None) -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes of the text, null as none, plus 1), text_crc32 (of the text's
    UTF-8 bytes; null as empty), law 'key', shard, slot (gapless from 0 in the shard, by doc_id within each chunk of
    a hash), and grown_shard, the shard if the tree had one more.

    The doc_id alone decides, so equal ids share a shard and each repeated row has a slot of its own; a null doc_id is
    hashed like any other value. An empty table gives an empty result; other columns aren't read."""
    tree = tree or even_tree()
    n = 1 + max(s for racks in tree.values() for shards in racks.values() for s in shards)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    rows = place(place(rows, tree, ["doc_id"], "shard"), grown(tree, n), ["doc_id"], "grown_shard")
    rows = numbered(rows, "shard", ["doc_id", "text_crc32"], chunks=parts(docs.sparkSession))
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
