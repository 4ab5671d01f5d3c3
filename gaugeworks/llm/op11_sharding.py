"""Sharding by a hierarchical weighted hash tree.

Shards hang on racks and racks on regions; a node weighs what its shards weigh.
A row descends from the root: at each level every child draws -ln(u) / weight,
u being a hash of the row's key and the child's name spread over (0, 1), and the
smallest draw wins, so children win in proportion to their weights. A draw
depends on its child alone. So where one shard's weight changes, the draws of
its region, its rack and itself change and no others: rows move into or out of
that subtree, or inside it, and none moves between two untouched subtrees.

A shard that is added later draws at the root under its own name, against whole
regions, as a ``Shard`` without a region. All other draws stay as they were, so
it takes rows from everywhere and no row moves anywhere else: one more shard
takes rows only into itself, whatever the number of shards before.

The query's law is ``key``: doc_id and the shards decide. Texts aren't looked
at, so rows of equal texts go where their numbers send them, and rows of one
doc_id, null included, lie in one shard.

A row's slot numbers the rows of its shard by doc_id. Texts never move: sizes,
checksums and shards are taken in one pass and frozen in a table, which is then
cut into ranges of (shard, doc_id, row); counts of the ranges, added up, give
each range its first slot. A shard or a doc_id of any share of the rows is cut
into ranges like all else.

Defined results: a null text counts as no bytes; a null doc_id is a key of its
own and comes first in its shard; rows that repeat a doc_id have slots of their
own, in any order; very long texts count whole; other columns are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.llm.runtime import materialise, release, table, text_of

SHARDS, RACK_SHARDS, REGION_RACKS = 40, 2, 4
#: Bytes that a row takes beside its text.
ROW_BYTES = 16
LAW = "key"


class Shard(NamedTuple):
    """A leaf of the tree; without a region it hangs on the root itself."""

    number: int
    region: str | None
    rack: str | None = None
    weight: float = 1.0


def founded(count: int = SHARDS, rack_shards: int = RACK_SHARDS, region_racks: int = REGION_RACKS) -> list[Shard]:
    """``count`` equal shards, dealt to racks and regions in their order."""
    racks = [k // rack_shards for k in range(count)]
    return [Shard(k, f"region{r // region_racks}", f"rack{r}") for k, r in enumerate(racks)]


def grown(shards: list[Shard], weight: float = 1.0) -> list[Shard]:
    """The shards and one more, which takes rows only into itself."""
    return [*shards, Shard(max((s.number for s in shards), default=-1) + 1, None, None, weight)]


def _checked(shards: list[Shard]) -> None:
    racks = {(s.region, s.rack) for s in shards if s.region is not None}
    if len({s.number for s in shards}) < len(shards) or len({r for _, r in racks}) < len(racks):
        raise ValueError("shards and racks need names of their own")
    if not shards or any(s.weight <= 0 for s in shards) or any(s.region is not None and s.rack is None for s in shards):
        raise ValueError("a tree needs shards, each with a weight above zero and, in a region, a rack")


def drawn(key: Column, name: str, weight: float) -> Column:
    """A child's draw for a row: exponential in distribution, with the weight as its rate."""
    spread = F.shiftrightunsigned(F.xxhash64(F.concat(key, F.lit(f"|{name}"))), 11)
    return -F.log((spread.cast("double") + 0.5) / float(1 << 53)) / weight


def _winner(children: list[tuple[str, float, int]]) -> Column:
    """The number of the child (name, weight, number) with the smallest draw; of equal draws, the smallest number."""
    if len(children) == 1:
        return F.lit(children[0][2])
    return F.least(*(F.struct(drawn(F.col("key"), name, weight).alias("draw"), F.lit(number).alias("number")) for name, weight, number in children))["number"]


def _inside(column: str, choices: dict[int, Column]) -> Column:
    """The choice of the subtree that a row is in; only that subtree's draws are made."""
    out = F.lit(None).cast("int")
    for number, choice in choices.items():
        out = F.when(F.col(column) == number, choice).otherwise(out)
    return out


def descended(rows: DataFrame, shards: list[Shard], out: str) -> DataFrame:
    """``rows`` (with a string ``key``, never null) with the number of each row's shard as ``out``."""
    _checked(shards)
    weigh = lambda some: sum(s.weight for s in some)
    grouped: dict[str, dict[str, list[Shard]]] = {}
    for s in shards:
        if s.region is not None:
            grouped.setdefault(s.region, {}).setdefault(s.rack, []).append(s)
    alone = {-1 - s.number: s for s in shards if s.region is None}
    racks = [r for of_region in grouped.values() for r in of_region]
    root = [(f"shard {s.number}", s.weight, k) for k, s in alone.items()]
    root += [(f"region {name}", sum(map(weigh, own.values())), k) for k, (name, own) in enumerate(grouped.items())]
    of_region = {k: _winner([(f"rack {r}", weigh(some), racks.index(r)) for r, some in own.items()]) for k, own in enumerate(grouped.values())}
    of_rack = {racks.index(r): _winner([(f"shard {s.number}", s.weight, s.number) for s in some]) for own in grouped.values() for r, some in own.items()}
    region, rack = f"{out}_region", f"{out}_rack"
    rows = rows.withColumn(region, _winner(root)).withColumn(rack, _inside(region, of_region))
    shard = F.when(F.col(region) < 0, -1 - F.col(region)).otherwise(_inside(rack, of_rack))
    return rows.withColumn(out, shard.cast("int")).drop(region, rack)


def assigned(docs: DataFrame, shards: list[Shard], further: list[Shard] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (the shard of the ``further`` tree; null without one)."""
    number = F.col("doc_id").cast("long")
    light = docs.select(
        number.alias("doc_id"),
        (F.octet_length(text_of()) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text_of().cast("binary")).alias("text_crc32"),
        F.coalesce(number.cast("string"), F.lit("null")).alias("key"),
        F.monotonically_increasing_id().alias("row"),
    )
    light = descended(light, shards, "shard")
    light = descended(light, further, "grown_shard") if further else light.withColumn("grown_shard", F.lit(None).cast("int"))
    rows = materialise(light.drop("key"))
    ranges = materialise(rows.repartitionByRange("shard", "doc_id", "row").withColumn("piece", F.spark_partition_id()))
    release(rows)
    counts = ranges.groupBy("shard", "piece").agg(F.count("*").alias("held"))
    # One row a range: a range holds one shard's rows, or the ends of a few shards.
    before = F.sum("held").over(Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    first = materialise(counts.select("shard", "piece", F.coalesce(before, F.lit(0)).alias("first")))
    place = F.row_number().over(Window.partitionBy("shard", "piece").orderBy(F.col("doc_id").asc_nulls_first(), "row"))
    placed = ranges.withColumn("place", place).join(first, ["shard", "piece"])
    return placed.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("first") + F.col("place") - 1).cast("long").alias("slot"), "grown_shard")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = founded()
    return assigned(table(spark, sf_dir, "documents"), shards, grown(shards))
