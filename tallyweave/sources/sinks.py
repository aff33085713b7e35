"""Writing what is validated: appends that may be repeated, numbers that are never given twice."""

from __future__ import annotations

import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyweave.functions import normalize as N
from tallyweave.operators.lineage import discard, settled

c = F.col


#: An archive's sheets are dealt to so many buckets by a hash of their id; a sheet is looked for in its own bucket only.
BUCKETS = 32


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _entries(spark: SparkSession, path: str, bucket: int) -> list[str]:
    """The commits of a bucket, in order."""
    at, fs = _fs(spark, f"{path}/log/{bucket}")
    if not fs.exists(at):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(at))
    out = []
    for name in names:
        if name.isdigit():
            stream = fs.open(_fs(spark, f"{path}/log/{bucket}/{name}")[0])
            out.append(bytes(stream.readAllBytes()).decode())
            stream.close()
    return out


def _claim(spark: SparkSession, path: str, bucket: int, number: int, commit: str) -> bool:
    """Compare and set: makes the bucket's next entry, whole at once, unless another writer has made it."""
    made, fs = _fs(spark, f"{path}/log/{bucket}/.{commit}")
    final, _ = _fs(spark, f"{path}/log/{bucket}/{number:010d}")
    stream = fs.create(made)
    stream.write(bytearray(commit.encode()))
    stream.close()
    jvm = spark._jvm
    try:
        if fs.getUri().getScheme() == "file":  # a rename would replace the other's entry
            local = lambda x: jvm.java.nio.file.Paths.get(jvm.java.net.URI.create(f"file://{x.toUri().getPath()}"))
            jvm.java.nio.file.Files.createLink(local(final), local(made))
        else:
            kinds = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(made, final, kinds)
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    finally:
        fs.delete(made, False)
    return True


def _data(path: str, bucket: int, commit: str) -> str:
    return f"{path}/data/{commit}/bucket={bucket}"


def archive_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The archive at path: what commits name, nothing that a writer left behind."""
    found = [_data(path, b, e) for b in range(BUCKETS) for e in _entries(spark, path, b)]
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def append_new(facts: DataFrame, path: str, owner: str) -> DataFrame:
    """Appends the sheets of facts (sheet_uid, owner, ...) that the archive at path lacks; sheet_uid, outcome of each.

    stored now, already there (nothing is written again), or a conflict with another owner's sheet. A bucket's rows count
    once its log has an entry for them, and the entry of each number is made by one writer alone (by a rename that doesn't
    overwrite, or by a link on a local disk). Who comes second looks again and writes what is still new. So writing
    twice, at once, or after a failure half-way stores each sheet once. Only the buckets of the given sheets are read.
    """
    spark = facts.sparkSession
    todo = settled(facts.withColumn("bucket", F.pmod(F.xxhash64("sheet_uid"), F.lit(BUCKETS)).cast("int")))
    open_ = {r["bucket"] for r in todo.select("bucket").distinct().collect()}  # BUCKETS at most
    outcomes = []
    while open_:
        entries = {b: _entries(spark, path, b) for b in open_}
        held = [_data(path, b, e) for b, own in entries.items() for e in own]
        known = spark.read.schema(facts.schema).parquet(*held) if held else spark.createDataFrame([], facts.schema)
        known = known.groupBy("sheet_uid").agg(F.max("owner").alias("held_by"))
        asked = todo.where(c("bucket").isin(*open_)).select("sheet_uid", "bucket").distinct().join(known, "sheet_uid", "left")
        outcome = settled(asked.select("sheet_uid", "bucket", F.when(c("held_by").isNull(), "stored").when(c("held_by") == owner, "already_there").otherwise("conflict").alias("outcome")))
        commit = uuid.uuid4().hex
        new = todo.join(outcome.where("outcome = 'stored'").select("sheet_uid"), "sheet_uid", "left_semi")
        new.select(*facts.columns, "bucket").write.partitionBy("bucket").parquet(f"{path}/data/{commit}")
        filled = {r["bucket"] for r in outcome.where("outcome = 'stored'").select("bucket").distinct().collect()}
        done = {b for b in open_ if b not in filled or _claim(spark, path, b, len(entries[b]), commit)}
        if done:
            outcomes.append(settled(outcome.where(c("bucket").isin(*done)).select("sheet_uid", "outcome")))
        discard(outcome)
        open_ -= done
    out = settled(reduce(DataFrame.unionByName, outcomes)) if outcomes else spark.createDataFrame([], "sheet_uid string, outcome string")
    discard(todo, *outcomes)
    return out


def assign_numbers(new: DataFrame, taken: DataFrame) -> DataFrame:
    """sheet_uid, sheet_no of new sheets (sheet_uid, created_on, proposed): the proposed number if it is free, else the next
    above all that were ever given, in order of creation.

    Numbers run on over partitions by range: each counts its own rows, and starts behind those before it.
    """
    used = taken.select(c("sheet_no").alias("proposed"), F.lit(True).alias("used")).distinct()
    first = Window.partitionBy("proposed").orderBy("created_on", "sheet_uid")
    asked = new.join(used, "proposed", "left").withColumn("k", F.when(c("proposed").isNotNull(), F.row_number().over(first)))
    asked = settled(asked.withColumn("keeps", F.coalesce((c("k") == 1) & c("used").isNull(), F.lit(False))).select("sheet_uid", "created_on", "proposed", "keeps"))
    top = asked.where("keeps").select(c("proposed").alias("n")).unionByName(taken.select(c("sheet_no").alias("n"))).agg(F.coalesce(F.max("n"), F.lit(0)).alias("top"))
    rest = settled(asked.where("not keeps").select("sheet_uid", "created_on").repartitionByRange("created_on", "sheet_uid").withColumn("part", F.spark_partition_id()))
    counts = rest.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("created_on", "sheet_uid"))
    numbered = rest.withColumn("i", inside).join(starts, "part").crossJoin(F.broadcast(top))  # one row
    return asked.where("keeps").select("sheet_uid", c("proposed").cast("long").alias("sheet_no")).unionByName(numbered.select("sheet_uid", (c("top") + c("start") + c("i")).cast("long").alias("sheet_no")))


def stoppages(rows: DataFrame) -> DataFrame:
    """motivo, operador, duracao_horas of stoppages as stored: blank as null, no operator as unknown, durations in hours."""
    text = lambda x: F.when(F.trim(x) != "", F.trim(x))
    hours = N.parse_number(F.regexp_replace(c("duracao"), "(?i)h", ""))
    return rows.select("id", text("motivo").alias("motivo"), F.coalesce(text("operador"), F.lit("(desconhecido)")).alias("operador"), hours.alias("duracao_horas"))


def plan_refs(parents: DataFrame, refs: DataFrame) -> DataFrame:
    """record_id, plan_key, assumed: a child for each line of a stored parent (record_id, sheet_uid, pos); each line once."""
    return parents.join(refs.dropDuplicates(["sheet_uid", "pos", "plan_key"]), ["sheet_uid", "pos"]).select("record_id", "plan_key", "assumed")
