"""Shards that each hold the sources in the proportions of the whole: proportional stratified interleaving.

1. Rows are written once with a key of their own; from then on only narrow rows (key, source, hash) are sorted.
2. In each source rows are shuffled by a seeded hash of id and text, and ranked (`places.numbered`).
3. A row's fractional rank is (rank + 1/2) / rows of its source; in the order of fractional ranks the sources are
   interleaved evenly, each at its share.
4. That order is cut into equal runs. Any run of it holds each source's share, up to one row a source, so every shard
   matches the mixture; shards' counts are at most one apart, whichever sources and copies there are.

All places come from ranges and their counts: no task holds a source, and a source may be a third of all rows. Only the
last join moves texts, once, by the rows' own keys. Equal texts have no part in the cut: they follow their rows' ranks.

A null source is a source; null texts have no bytes; null and repeated ids are shuffled as any row, repeated rows by
their keys. Fewer rows than shards: some shards are empty. No rows: no rows. Further columns stay as they are, but for
shard and slot, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gravelsift.llm.common import materialize
from gravelsift.llm.places import numbered


def shuffled(seed: int, *columns: Column) -> Column:
    """A seeded hash of columns: 32 hexadecimal digits, in an order that has nothing to do with the rows'."""
    parts = [F.coalesce(c.cast("string"), F.lit("-")) for c in columns]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def interleave(docs: DataFrame, shards: int = 8, stratum_col: str = "source", id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """docs with shard (from 0) and slot (the place in the shard, from 0)."""
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    keyed, _ = materialize(docs.select(*kept, F.monotonically_increasing_id().alias("_gs_key")), "shard-rows")
    narrow = keyed.select(
        F.col("_gs_key").alias("key"), F.col(stratum_col).alias("stratum"), F.unhex(shuffled(seed, F.col(id_col), F.md5(F.col(text_col)))).alias("mixed"),
    )
    ranked = numbered(narrow, ["stratum"], ["mixed", "key"], "shard-ranks", "rank", "size")
    shares = ranked.select("key", "stratum", "rank", ((F.col("rank") + 0.5) / F.col("size")).alias("share"))
    ordered = numbered(shares, [], ["share", "stratum", "rank"], "shard-order", "at", "every")
    shard = F.expr(f"at * {shards} div every")
    begin = F.expr(f"(shard * every + {shards - 1}) div {shards}")  # the first place of a shard
    cut = ordered.withColumn("shard", shard.cast("int")).select("key", "shard", (F.col("at") - begin).alias("slot"))
    return keyed.join(cut, F.col("_gs_key") == F.col("key")).select(*kept, "shard", "slot")


def write_shards(placed: DataFrame, path: str, files_a_shard: int = 1, format: str = "parquet") -> None:
    """A folder shard=N for each shard; its files hold runs of slots in order (a file's name follows its run)."""
    n = placed.agg(F.max("shard")).first()[0]
    ranges = placed.repartitionByRange(max(1, ((n or 0) + 1) * files_a_shard), "shard", "slot").sortWithinPartitions("shard", "slot")
    ranges.write.partitionBy("shard").format(format).save(path)
