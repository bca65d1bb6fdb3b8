"""Sharding by proportional stratified interleaving (native: DataFrame functions only).

Rows are shuffled by a seeded digest within each source and ranked there; the row of rank r among n of a source
stands at the fractional rank (2r - 1) / 2n. Sorting all rows by it interleaves the sources in proportion, and
cutting that order into equal runs gives every shard the mixture of the whole. Law: ``rows`` (counts differ by one at most).

No source and no run is gathered in a task: ranks are counted within small buckets of the digest (or of the
fractional rank) and the counts of the buckets before are added, in two levels: within steps of buckets, and of the steps.

Defined results: a null text has no bytes (size 1); a null source is a source of its own; the digest is of id, text checksum and size, its ties are
broken by these, and rows that are alike in all of them are interchangeable; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Tables, pick

SEED = "interleave-1"
SHARDS = 16
#: Rows of a bucket, about.
BUCKET_ROWS = 512
#: Buckets of a step. Steps alone are ordered in one task: one row for about two million rows of the table.
STEP_BUCKETS = 4096


def _before(df: DataFrame, group: list[str], bucket: str) -> DataFrame:
    """For each bucket of a group, the rows in that group's earlier buckets: those of earlier steps of STEP_BUCKETS buckets, and of its own."""
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    counts = df.groupBy(*group, bucket).agg(F.count("*").alias("rows_in")).withColumn("step", F.floor(F.col(bucket) / STEP_BUCKETS))
    steps = counts.groupBy(*group, "step").agg(F.sum("rows_in").alias("rows_of"))
    earlier = W.partitionBy(*group).orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    steps = steps.select(*(F.col(k).alias(f"s_{k}") for k in [*group, "step"]), F.coalesce(F.sum("rows_of").over(earlier), F.lit(0)).alias("ahead"))
    own = W.partitionBy(*group, "step").orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    inside = counts.withColumn("inside", F.coalesce(F.sum("rows_in").over(own), F.lit(0)))
    return inside.join(steps, [same(k, f"s_{k}") for k in [*group, "step"]]).select(*group, bucket, (F.col("ahead") + F.col("inside")).alias("before"))


def _ranked(df: DataFrame, group: list[str], bucket: str, order: list[str], name: str) -> DataFrame:
    """A gapless rank from 1 within each group, without a task for a whole group."""
    before = _before(df, group, bucket)
    keys = [*group, bucket]
    joined = df.join(before.select(*(F.col(k).alias(f"b_{k}") for k in keys), "before"), [F.col(k).eqNullSafe(F.col(f"b_{k}")) for k in keys], "inner")
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return joined.withColumn(name, F.col("before") + rn).drop("before", *(f"b_{k}" for k in keys))


def digest(doc_id: Column, crc: Column, size: Column, seed: str) -> Column:
    """Of the id and the text's checksum and size, so that rows of one id are spread, too."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), crc.cast("string"), size.cast("string")))


def unit(hex_text: Column) -> Column:
    """The first 32 bits of a hex digest, in [0, 1)."""
    return F.conv(F.substring(hex_text, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def interleave(df: DataFrame, shards: int = SHARDS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, size, text_crc32, position in the whole order (from 0), shard and slot within the shard (from 0)."""
    tables = Tables(df.sparkSession)
    t = pick(df, doc_id=id_col, text=text_col, source=source_col)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = tables.keep(
        t.select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")).withColumn("digest", digest(F.col("doc_id"), F.col("text_crc32"), F.col("size"), seed)),
        "rows",
    )
    per = rows.groupBy("source").agg(F.count("*").alias("n_source"))
    total = per.agg(F.coalesce(F.sum("n_source"), F.lit(0))).first()[0]
    sized = rows.join(per.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "inner").drop("s")
    buckets = F.floor(F.col("n_source") / BUCKET_ROWS) + 1
    stratum = sized.withColumn("bucket", F.floor(unit(F.col("digest")) * buckets))
    order = ["digest", "doc_id", "text_crc32", "size"]
    ranked = tables.keep(_ranked(stratum, ["source"], "bucket", order, "rank").drop("bucket"), "ranked")
    placed = ranked.withColumn("fraction", (2 * F.col("rank") - 1) / (2 * F.col("n_source")))
    bins = total // BUCKET_ROWS + 1
    binned = placed.withColumn("bin", F.floor(F.col("fraction") * bins))
    whole = _ranked(binned, [], "bin", ["fraction", "source", *order], "position")
    p = F.col("position") - 1
    shard = F.floor(p * shards / F.lit(max(total, 1)))
    # the quotient is taken in whole numbers, so that no rounding moves a cut
    shard = F.expr(f"(position - 1) * {shards}L div {max(total, 1)}L").cast("int") if total else shard.cast("int")
    first = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}L) div {shards}L")
    return whole.withColumn("shard", shard).select("doc_id", "size", "text_crc32", p.alias("position"), "shard", (p - first).alias("slot"), "source")


def op10_interleave(spark, sf_dir: str) -> DataFrame:
    out = interleave(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
t AS (SELECT list_transform(range(0, 256), lambda b: list_reduce(list_prepend(b::BIGINT, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
          lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
h AS (SELECT doc_id, source, strlen(text) + 1 AS size, hex(encode(text)) AS x FROM d),
b AS (SELECT doc_id, source, size,
             list_prepend(4294967295::BIGINT, list_transform(range(0, length(x) // 2), lambda i: ('0x' || x[2 * i + 1 : 2 * i + 2])::BIGINT)) AS bytes FROM h),
e AS (SELECT doc_id, source, size::BIGINT AS size,
             xor(list_reduce(bytes, lambda a, y: xor(a >> 8, tab[(xor(a, y) & 255) + 1])), 4294967295) AS text_crc32 FROM b, t),
c AS (SELECT *, md5(concat_ws(':', 'interleave-1', coalesce(doc_id::VARCHAR, 'null'), text_crc32::VARCHAR, size::VARCHAR)) AS digest FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY digest, doc_id, text_crc32, size) AS rank,
             count(*) OVER (PARTITION BY source) AS n_source, count(*) OVER () AS total FROM c),
p AS (SELECT *, row_number() OVER (ORDER BY (2 * rank - 1)::DOUBLE / (2 * n_source)::DOUBLE, source NULLS FIRST, digest, doc_id, text_crc32, size) - 1 AS position FROM r),
s AS (SELECT *, (position * 16 // total)::INTEGER AS shard FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard, (position - (shard::BIGINT * total + 15) // 16)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM s
"""
