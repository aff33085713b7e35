"""What arrives bit by bit: files, edits, validated sheets, new sheets. Each job ends as its batch twin would.

A job may be stopped, fail or be started again at any time on its folder: the query's checkpoint says which input is done, keyed
state is in Spark's state store, and results are tables below the folder, one part a micro-batch, that a repeated
batch writes again. No batch reads or rewrites what earlier ones have written; what a later batch supersedes is told apart when
results are read, by batch number, and compact() folds old parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.operators.audit import of_generation
from tallyweave.operators.lineage import discard, scratch_dir, settled
from tallyweave.sources.sinks import append_new, archive_rows

c = F.col
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run(stream: DataFrame, each: Callable[[DataFrame, int], None], folder: str, mode: str = "append") -> None:
    """Takes all that is there in micro-batches and ends. Where the same folder is given again, it goes on behind them."""
    spark = stream.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def table_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A folder of Parquet files, or one file, as a stream of so many files a batch."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():  # a stream's source is a folder
        return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return reader.parquet(path)


def parts(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All parts that a job has written below folder, with the batch of each; empty before the first one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], f"{schema}, batch long")
    return spark.read.schema(f"{schema}, batch long").parquet(folder)


def write_part(df: DataFrame, folder: str, batch: int) -> None:
    """A batch that is repeated after a failure replaces its own part."""
    df.write.mode("overwrite").parquet(f"{folder}/batch={batch}")


def compact(spark: SparkSession, folder: str, schema: str, keep: Callable[[DataFrame], DataFrame]) -> None:
    """Folds all parts into that of the last batch: keep(parts) says what still counts. Not while the job runs.

    The folded part is written beside the others first; a failure between the two steps leaves rows twice that mean the same.
    """
    held = parts(spark, folder, schema)
    last = held.agg(F.max("batch")).first()[0]
    if last is None:
        return
    whole = settled(keep(held).drop("batch"))
    write_part(whole, folder, last)
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("batch=") and int(name.removeprefix("batch=")) < last:
            fs.delete(status.getPath(), True)
    discard(whole)


INGESTED = "sha string, name string"


def ingest(files: DataFrame, ledger: DataFrame, folder: str) -> DataFrame:
    """sha, name of each content that the ledger lacks, under its least name; files: a stream of name, sha.

    Contents are kept in the state store with their name, so that however late a repeat comes, and however often the job is
    started again, a content is taken once. A part holds what a batch added or named anew.
    """
    fresh = files.where("sha is not null").join(ledger.select("sha").distinct(), "sha", "left_anti")
    run(fresh.groupBy("sha").agg(F.min("name").alias("name")), lambda batch, number: write_part(batch.select("sha", "name"), f"{folder}/new", number), folder, "update")
    return last_names(parts(files.sparkSession, f"{folder}/new", INGESTED)).drop("batch")


def last_names(held: DataFrame) -> DataFrame:
    """Each content under its least name; also what compact() keeps."""
    return held.groupBy("sha").agg(F.min("name").alias("name"), F.max("batch").alias("batch"))


CELLS = "sheet_uid string, field_path string, id long, old_value string, new_value string"


def evidence(edits: DataFrame, sheets: DataFrame, folder: str) -> DataFrame:
    """sheet_uid, field_path, id, new_value: a person's last value of each cell in the sheet's generation.

    The state store holds each cell's last event; ids decide, not arrival. An event at or below the sheet's floor is too late
    however soon it comes. sheets (sheet_uid, event_floor) may have higher floors when the job is started again: what lies below
    them no longer counts, written before or not.
    """
    floors = sheets.select("sheet_uid", "event_floor")
    human = of_generation(edits.where("source = 'human'"), floors)
    last = F.max(F.struct("id", "old_value", "new_value")).alias("x")
    cells = human.groupBy("sheet_uid", "field_path").agg(last)
    run(cells, lambda batch, number: write_part(batch.select("sheet_uid", "field_path", "x.*"), f"{folder}/cells", number), folder, "update")
    held = last_cells(parts(edits.sparkSession, f"{folder}/cells", CELLS))
    return of_generation(held, floors).select("sheet_uid", "field_path", "id", "new_value")


def last_cells(held: DataFrame) -> DataFrame:
    """Each cell's part with the greatest id; also what compact() keeps."""
    one = F.max(F.struct("id", "old_value", "new_value", "batch")).alias("x")
    return held.groupBy("sheet_uid", "field_path").agg(one).select("sheet_uid", "field_path", "x.*")


OUTCOMES = "sheet_uid string, outcome string"


def archive(facts: DataFrame, folder: str, owner: str) -> tuple[DataFrame, DataFrame]:
    """The archive that a stream of facts fills, and the outcome of each sheet and batch, over all runs; replays add nothing."""
    spark = facts.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        outcome = append_new(batch, f"{folder}/archive", owner)
        write_part(outcome, f"{folder}/outcomes", number)
        discard(outcome)

    run(facts, each, folder)
    return archive_rows(spark, f"{folder}/archive", facts.schema), parts(spark, f"{folder}/outcomes", OUTCOMES)


def match(rows: DataFrame, link: Callable[[DataFrame], DataFrame], schema: str, folder: str) -> DataFrame:
    """What link() says of each batch of new sheets, against a plan that is pinned for the whole run."""
    run(rows, lambda batch, number: write_part(link(batch), f"{folder}/matches", number), folder)
    return parts(rows.sparkSession, f"{folder}/matches", schema).drop("batch")


def new_folder(spark: SparkSession) -> str:
    return scratch_dir(spark)
