"""Exact duplicates by deterministic block naming, in DataFrame operations only.

A normalised text (A-Z lower-cased) is cut into blocks of fixed size. The
blocks of all rows are sorted and get integer names; each document is then a
row of names. Pairs of adjacent names are sorted and get names in turn, and so
on until every document is one name. Names are given to contents by equality,
never by hash, so two documents of one number of blocks have the same name
exactly if they are equal.

The text moves once: blocks go to buckets by their hash and are ranked inside
these. Contents of very many rows are dealt to several parts of their bucket;
one row of each content and part then stands for the others, and the names of
these few are reconciled. Names depend on the contents and the number of rows
alone, and are frozen in written tables.

Defined results: null counts as empty and all empty texts are equal; of equal
texts, the row with the largest doc_id stays (a null doc_id is smaller than
any; among rows that repeat the largest doc_id, all are marked as kept); other
columns are ignored; very long texts have more blocks and levels; an empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.llm.runtime import materialise, table, text_of, without_rows

BLOCK_BYTES = 4096
#: Rows of a bucket on average, and of a part of a frequent content at least.
BUCKET_ROWS, PART_ROWS = 2048, 512
#: No more contents than this (as a power of two) count as frequent, so their hashes may be broadcast.
MOST_FREQUENT = 17
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """A-Z lower-cased, all else as it is; plain ``lower`` does that where the text is ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def name_contents(rows: DataFrame, keys: list[str], part_rows: int = PART_ROWS) -> DataFrame:
    """``rows`` (with ``row_id`` and ``at``) with an integer ``name`` in place of the ``keys``: equal where these are, frozen in tables."""
    others = [c for c in rows.columns if c not in keys]
    hashed = rows.withColumn("hash", F.xxhash64(*keys))
    counts = materialise(hashed.groupBy("hash").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    limit = max(part_rows, total >> MOST_FREQUENT)
    frequent = counts.where(F.col("n") > limit).select("hash", F.ceil(F.col("n") / limit).alias("parts"))
    # At most 2 ** MOST_FREQUENT rows of two integers.
    dealt = hashed.join(F.broadcast(frequent), "hash", "left")
    dealt = dealt.withColumn("bucket", F.pmod("hash", F.lit(total // BUCKET_ROWS + 1)))
    dealt = dealt.withColumn("part", F.when(F.col("parts").isNull(), -1).otherwise(F.pmod(F.xxhash64("row_id", "at"), F.col("parts"))))
    order = Window.partitionBy("bucket", "part").orderBy(*keys)
    ranked = dealt.withColumn("rank", F.dense_rank().over(order)).withColumn("before", F.lag("rank", 1, 0).over(order))
    stands = (F.col("part") >= 0) & (F.col("rank") != F.col("before"))
    level = materialise(ranked.select(*others, "bucket", "part", "rank", *(F.when(stands, F.col(k)).alias(k) for k in keys)))

    def number(rank: Column, kind: int) -> Column:
        return F.shiftleft("bucket", 25) + 2 * rank.cast("long") + kind

    cold = level.where("part < 0").select(*others, number(F.col("rank"), 0).alias("name"))
    if not frequent.head(1):
        return cold
    few = level.where((F.col("part") >= 0) & F.col(keys[0]).isNotNull())
    among = F.dense_rank().over(Window.partitionBy("bucket").orderBy(*keys))
    names = materialise(few.select("bucket", "part", "rank", number(among, 1).alias("name")))
    hot = level.where("part >= 0").select(*others, "bucket", "part", "rank").join(names, ["bucket", "part", "rank"])
    return cold.unionByName(hot.select(*others, "name"))


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES, part_rows: int = PART_ROWS) -> DataFrame:
    """doc_id, sha, n_blocks and name of each row of ``docs`` (doc_id, norm): n_blocks and name are equal exactly where norm is."""
    raw = F.col("norm").cast("binary")
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("norm") / F.lit(block_bytes))).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(raw, i * block_bytes + 1, F.lit(block_bytes)))
    # doc_id may repeat, so a frozen number tells rows apart; the first block carries what the result needs.
    rows = docs.withColumn("row_id", F.monotonically_increasing_id())
    rows = rows.select("row_id", "doc_id", F.unhex(F.sha2(raw, 256)).alias("sha"), count.alias("n_blocks"), F.posexplode(cut).alias("at", "block"))
    rows = rows.withColumns({c: F.when(F.col("at") == 0, F.col(c)) for c in ("doc_id", "sha")})
    named = name_contents(rows, ["block"], part_rows)
    done = named.where("n_blocks = 1").select("doc_id", "sha", "n_blocks", "name")
    heads = named.where("n_blocks > 1 and at = 0").select("row_id", "doc_id", "sha")
    level = named.where("n_blocks > 1").select("row_id", "n_blocks", "at", "name")
    most, size = named.agg(F.max("n_blocks")).first()[0] or 1, 1
    while size < most:
        size *= 2
        pairs = level.groupBy("row_id", "n_blocks", F.expr("at div 2").alias("at")).agg(
            F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("first"),
            F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(-1)).alias("second"),
        )
        named = name_contents(pairs, ["first", "second"], part_rows)
        whole = named.where(F.col("n_blocks") <= size)
        done = done.unionByName(heads.join(whole, "row_id").select("doc_id", "sha", "n_blocks", "name"))
        level = named.where(F.col("n_blocks") > size).select("row_id", "n_blocks", "at", "name")
    return done


def exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES, part_rows: int = PART_ROWS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for each row of ``docs``."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(text_of()).alias("norm"))
    member = materialise(identities(base, block_bytes, part_rows))
    key = ["n_blocks", "name"]
    groups = materialise(member.groupBy(*key).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1"))
    limit = max(part_rows, member.count() >> MOST_FREQUENT)
    # Rows of large groups stay where they are: at most 2 ** MOST_FREQUENT groups are broadcast.
    large = F.broadcast(groups.where(F.col("group_size") > limit))
    small = groups.where(F.col("group_size") <= limit).hint("merge")
    joined = member.join(large, key).unionByName(member.join(large, key, "left_anti").join(small, key, "left"))
    size = F.coalesce("group_size", F.lit(1).cast("long"))
    keep = F.when(size > 1, F.col("keep_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", keep.alias("keep_id"), size.alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, that of the largest doc_id; columns as they were.

    Where rows of a group share that doc_id, any one of them stays.
    """
    found = materialise(exact_duplicates(docs).select("doc_id", "text_sha256", "kept"))
    gone = found.where("not kept").select("doc_id", "text_sha256").distinct()
    tied = found.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1").drop("count")
    return without_rows(docs, [F.col("doc_id").cast("long"), F.sha2(normalised(text_of()).cast("binary"), 256)], gone, tied)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM t
"""
