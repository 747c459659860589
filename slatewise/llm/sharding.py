"""Operator 9: shards that each match the corpus mixture, by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one sort group holds on average.
GROUP_ROWS = 512
#: Most groups a source, or the whole order, is cut into.
MOST_GROUPS = 1 << 20


def _key(seed: int, *cols: str):
    """60 hash bits of the row's own columns under a seed."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *parts)), 1, 15), 16, 10).cast("long")


def ranked(rows: DataFrame, by: list[str], group: str, order: list, name: str) -> DataFrame:
    """Add a gapless rank from 1 within `by`, following column `group` first and `order` inside it.

    Only rows of one group are sorted together; the ranks of earlier groups come from counts,
    one row per group, so neither a hot key nor the whole table meets in one task.
    """
    sizes = rows.groupBy(*by, group).agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*by).orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    start = sizes.select(*by, group, F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy(*by, group).orderBy(*order))
    return rows.withColumn("_within", within).join(start, [*by, group]).withColumn(name, F.col("_start") + F.col("_within")).drop("_start", "_within")


def interleaved_shards(docs: DataFrame, *, shards: int = 16, seed: int = 9, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, group_id) for each row of `docs`.

    Rows of each source are shuffled by a seeded hash and ranked; row r of n has the fraction
    (2r - 1) / 2n. Sorting all rows by that fraction interleaves the sources in proportion, and
    cutting the order into `shards` runs whose lengths differ by at most one (law `rows`) gives
    every shard the mixture of the whole. `slot` is the place in the shard, gapless from 0.

    size is the UTF-8 bytes of the text plus 1 (null text: 1) and text_crc32 is that of the bytes.
    A null source counts as the empty one. Ties of the hash fall to id, size and checksum, and rows
    alike in all of these are interchangeable; null ids sort first. Further columns of `docs` are
    ignored. An empty table gives an empty table. `group_id` is one for equal texts (64 hash bits). A group is spread like any
    other rows, in the mixture's proportion: law `rows` with exact counts and the mixture in each shard
    leaves no room to hold copies together, and a group larger than a shard could not be.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("group_id"))
    total = docs.count()
    groups = max(1, min(MOST_GROUPS, total // GROUP_ROWS))
    rows = rows.withColumn("key", _key(seed, "doc_id"))
    rows = rows.withColumn("part", F.floor(F.col("key") % F.lit(1 << 30) * groups / F.lit(1 << 30)).cast("long"))
    # the shuffle order is that of the low 30 bits first, so a group is a run of it
    order = [F.col("key") % F.lit(1 << 30), "key", "doc_id", "size", "text_crc32"]
    rows = ranked(rows, ["source"], "part", order, "rank")
    counts = rows.groupBy("source").agg(F.count("*").alias("n"))
    rows = rows.join(counts, "source").withColumn("fraction", (2 * F.col("rank") - 1) / (2 * F.col("n")))
    rows = rows.withColumn("run", F.floor(F.col("fraction") * groups).cast("long")).withColumn("all", F.lit(0))
    rows = ranked(rows, ["all"], "run", ["fraction", "source", "rank"], "place").withColumn("place", F.col("place") - 1)
    exact = F.expr(f"place * {shards} div {max(total, 1)}")
    first = F.expr(f"(shard * {max(total, 1)} + {shards - 1}) div {shards}")
    return rows.withColumn("shard", exact.cast("int")).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("place") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "group_id")
