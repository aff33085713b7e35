"""Mixing sources to target weights by systematic sampling. DataFrame functions only.

Targets: sources in order of code point (null last) have weights 3, 1, 2, repeating, and share BUDGET times all words;
no target exceeds CAP times its source's words, what is cut off goes to the others by weight. The level of that
filling is found in one ordered pass over the sources, by ratio of cap to weight.

Within a source each document's expected number of copies is target / source size. Documents stand in a line, their
expected copies are summed up, one offset for the source is added, and a document is taken once for each integer that
its stretch crosses. The line goes by size class, so that each class is taken evenly and the words taken come near
the target. Positions in the line are counts of the blocks before plus a rank within the block; blocks are slices of a
size class by hash, about BLOCK rows each however large a source is.

Edge cases: null texts have size 0; a null source is a source of its own; rows of size 0 may be taken but add nothing;
a source without words has target 0 and is not taken; repeated rows count each; an empty table gives no rows; extra
columns are ignored. Reruns agree: hashes and offsets follow from doc_id, source and SEED.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, discard, documents, materialize, quoted

WEIGHTS = (3.0, 1.0, 2.0)
BUDGET, CAP, SEED, BLOCK = 1.5, 2.0, "mix-1", 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hashed(*parts: Column) -> Column:
    """28 bits of md5, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 7), 16, 10).cast("long")


def source_targets(sources: DataFrame) -> DataFrame:
    """source, source_size -> target, weight and rate. One row a source: the ordered windows hold no documents."""
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), place + 1)
    ranked = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(CAP))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        ranked.withColumn("budget", F.sum("source_size").over(everything) * F.lit(BUDGET))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("cut", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("cut_weight", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("budget") - F.col("cut")) / (F.col("all_weight") - F.col("cut_weight")))
        .withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    )
    level = F.min_by("level", F.when(F.col("open"), F.col("cap") / F.col("weight"))).over(everything)
    target = F.when(F.col("open"), F.col("final") * F.col("weight")).otherwise(F.col("cap"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return filled.withColumn("final", level).withColumn("target", target).withColumn("rate", rate).select("source", "source_size", "weight", "target", "rate")


def with_copies(rows: DataFrame) -> DataFrame:
    """Adds source_size, target and copies to rows with doc_id, source and size; other columns stay."""
    slices = F.ceil(F.col("in_class") / BLOCK)
    rows = rows.withColumn("_class", F.floor(F.log2(F.col("size") + 1) * 4)).withColumn("_draw", _hashed(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(SEED)))
    classes = rows.groupBy("source", "_class").agg(F.count(F.lit(1)).alias("in_class"), F.sum("size").alias("class_size"))
    sources = source_targets(classes.groupBy("source").agg(F.sum("class_size").alias("source_size")))
    c, s = classes.withColumnsRenamed({"source": "_c_source", "_class": "_c_class"}), sources.withColumnsRenamed({"source": "_s_source"})
    sliced = rows.join(c, F.col("source").eqNullSafe(F.col("_c_source")) & (F.col("_class") == F.col("_c_class"))).drop("_c_source", "_c_class", "class_size").withColumn("_slice", F.floor(F.col("_draw") * slices / F.lit(float(1 << 28)))).drop("in_class")
    line = Window.partitionBy("source").orderBy("_class", "_slice").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sliced.groupBy("source", "_class", "_slice").agg(F.count(F.lit(1)).alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(line), F.lit(0))).drop("n")
    blocks = blocks.withColumnsRenamed({"source": "_b_source", "_class": "_b_class", "_slice": "_b_slice"})
    within = Window.partitionBy("source", "_class", "_slice").orderBy("size", "_draw", "doc_id")
    placed = (
        sliced.withColumn("_rank", F.row_number().over(within))
        .join(blocks, F.col("source").eqNullSafe(F.col("_b_source")) & (F.col("_class") == F.col("_b_class")) & (F.col("_slice") == F.col("_b_slice")))
        .join(s, F.col("source").eqNullSafe(F.col("_s_source")))
    )
    offset = _hashed(F.coalesce(F.col("source"), F.lit("")), F.lit(SEED)) / F.lit(float(1 << 28))
    until = F.col("ahead") + F.col("_rank")
    copies = F.floor(until * F.col("rate") + offset) - F.floor((until - 1) * F.col("rate") + offset)
    return placed.withColumn("copies", copies.cast("long")).drop("_b_source", "_b_class", "_b_slice", "_s_source", "_rank", "ahead", "rate", "weight", "_class", "_draw", "_slice")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim = materialize(documents(spark, sf_dir).select("doc_id", "source", n_words(F.col("text")).alias("size")))
    return with_copies(slim).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of docs themselves, each as often as the mix takes it; columns as before.

    The mix is worked out on ids, sources and sizes alone; whole rows move once, to meet their number of copies by a
    hash of all columns. Rows that are equal in all columns share the copies of all of them. Columns of types that have
    no hash (maps) are carried but not compared.
    """
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    key = F.xxhash64(F.lit(SEED), *quoted(plain))
    slim = materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("key")))
    copies = materialize(with_copies(slim).groupBy("key").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n")).where("copies > 0"))
    discard(slim)
    rows = docs.select(F.struct(*quoted(docs.columns)).alias("row"), key.alias("key")).join(copies, "key")
    place = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    times = rows.select("row", (F.floor(F.col("copies") / F.col("n")) + (place <= F.col("copies") % F.col("n")).cast("int")).alias("times"))
    return times.select("row", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int")))).select("row.*")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
r AS (SELECT *, CAST(floor(log2(size + 1) * 4) AS BIGINT) AS cls, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix-1'), 1, 7) AS BIGINT) AS draw FROM d),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap FROM src),
f AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS budget, sum(weight) OVER () AS all_weight,
  coalesce(sum(cap) OVER q, 0) AS cut, coalesce(sum(weight) OVER q, 0) AS cut_weight
  FROM w WINDOW q AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (budget - cut) / (all_weight - cut_weight) AS level FROM f),
o AS (SELECT *, level * weight <= cap AS is_open FROM l),
t AS (SELECT source, source_size, CASE WHEN is_open THEN weight * (SELECT arg_min(level, cap / weight) FROM o WHERE is_open) ELSE cap END AS target FROM o),
sl AS (SELECT r.*, CAST(floor(draw * ceil(count(*) OVER (PARTITION BY source, cls) / 4096.0::DOUBLE) / 268435456.0::DOUBLE) AS BIGINT) AS slice FROM r),
p AS (SELECT sl.*, row_number() OVER (PARTITION BY source ORDER BY cls, slice, size, draw, doc_id) AS place FROM sl),
x AS (SELECT p.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
  CAST('0x' || substr(md5(coalesce(p.source, '') || ':mix-1'), 1, 7) AS BIGINT) / 268435456.0::DOUBLE AS u FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST((floor(place * rate + u) - floor((place - 1) * rate + u)) * size AS BIGINT) AS taken FROM x
"""
