"""How the sources of a text collection swell and ebb together, kept up to date while documents arrive.

    python -m jobs.source_volumes --input DIR --output DIR [--config FILE]

Reads new files of ``documents`` as a stream, with a checkpoint, until all that is there now is read. A block of consecutive ids is what a
trading day is to returns: a source's volume in a block is the number of code points of its documents, its change that against
the block before, and the pairs of sources are scored in rolling windows of closed blocks (those before the latest one) by the
same operators as pairs of securities. Writes

* ``volumes``, by batch of the stream: documents and code points of each block and source in that batch;
* ``pairs``, by window_id: the pair table, with blocks in place of dates;
* ``mark``: the last batch whose blocks are in the pairs, and the number of closed blocks then.

A batch that is run again writes its own partition over, and so does a window. Windows are scored anew from the first one on that a new
batch touches, so late documents are counted. The mark is written last: after a failure between stream and scores,
the next run scores what the stream has already taken. Null ids have no block and are left out, null sources count as ``unknown``, null
texts as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.operators import pairs, windows
from quadrille.session import discard, prepare, stored

from . import common
from .common import log

DOCUMENTS = "doc_id long, text string, source string"
VOLUMES = "block long, source string, n_docs long, n_chars long, batch int"
MARK = "batch long, closed long"
CELLS = ", ".join(f"{v}{c} {t}" for v, t in (("E", "double"), ("a", "double"), ("b", "double"), ("N", "long")) for c in ("00", "01", "10", "11"))
PAIRS = f"first_block long, last_block long, source_a string, source_b string, {CELLS}, s_odd double, delta double, ctx double, valid boolean, window_id int"


def block_volumes(docs: DataFrame, block: int) -> DataFrame:
    """block, source, n_docs, n_chars."""
    docs = docs.filter("doc_id IS NOT NULL").select(F.floor(F.col("doc_id") / block).cast("long").alias("block"), F.coalesce("source", F.lit("unknown")).alias("source"), F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    return docs.groupBy("block", "source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").cast("long").alias("n_chars"))


def take_new(spark: SparkSession, path: str, out: str, block: int, files_per_batch: int) -> int:
    """Runs the stream over what is new, and returns the number of documents that it took."""
    taken = []

    def write(batch: DataFrame, number: int) -> None:
        batch, seen = common.counted(batch, "documents")
        block_volumes(batch, block).coalesce(1).write.mode("overwrite").parquet(f"{out}/volumes/batch={number}")
        taken.append(common.rows_of(seen))
        log.info("batch %d: read %d documents", number, taken[-1])

    files = f"{path[:-1]}[{path[-1]}]"  # as a pattern, a single file will do as well as a folder
    documents = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", files_per_batch).parquet(files)
    documents.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return sum(taken)


def changes(volumes: DataFrame) -> DataFrame:
    """permno (the source), i (the block), ret: change of volume against the block before; null where there is none."""
    daily = volumes.groupBy("block", "source").agg(F.sum("n_chars").alias("n_chars"))
    before = Window.partitionBy("source").orderBy("block")
    ret = F.when(F.lag("block").over(before) == F.col("block") - 1, F.try_divide(F.col("n_chars").cast("double"), F.lag("n_chars").over(before)) - 1)
    return daily.select(F.col("source").alias("permno"), F.col("block").alias("i"), ret.alias("ret"))


def score(panel: DataFrame, closed: int, config: dict) -> DataFrame:
    """The pairs of all full windows of the closed blocks that the panel covers throughout."""
    width, step = config["width"], config["step"]
    rows = windows.with_windows(panel.filter(F.col("i") < closed).withColumn("n", F.lit(closed)), width, step)
    present = F.count(F.lit(1)).over(Window.partitionBy("window_id", "permno"))
    rows = rows.withColumn("blocks", present).filter(F.col("blocks") / width >= config["least_presence"]).drop("blocks")
    stats = pairs.with_scores(pairs.pair_cells(pairs.legs(rows, width, config["theta_quantile"]), width), config["n_min"])
    begin = (F.col("window_id") * step).cast("long")
    stats = stats.withColumns({"first_block": begin, "last_block": begin + (width - 1)}).withColumnsRenamed({"permno_a": "source_a", "permno_b": "source_b"})
    return stats.select([c.split()[0] for c in PAIRS.split(", ")])


def read_pairs(spark: SparkSession, out: str) -> DataFrame:
    return common.read_or_empty(spark, f"{out}/pairs", PAIRS)


def run(spark: SparkSession, tables_dir: str, out: str, config: dict) -> dict:
    """One run; returns what it read and wrote."""
    prepare(spark)
    width, step = config["width"], config["step"]
    done = {"documents": take_new(spark, f"{tables_dir}/documents.parquet", out, config["block"], config["files_per_batch"]), "pairs": 0}
    mark = common.last_mark(spark, f"{out}/mark", MARK, "batch")
    volumes = common.read_or_empty(spark, f"{out}/volumes", VOLUMES)
    new = volumes.filter(F.col("batch") > (mark["batch"] if mark else -1)).agg(F.max("batch").alias("batch"), F.min("block").alias("first")).first()
    if new["batch"] is None:
        log.info("nothing new in %s", tables_dir)
        return done
    closed = volumes.agg(F.max("block").alias("last")).first()["last"]
    since = min(new["first"], mark["closed"]) if mark else new["first"]
    first = max(0, -(-(since - width + 1) // step))  # the first window that ends in this block or later
    panel = stored(changes(volumes.filter(F.col("block") >= first * step - 1)).filter(F.col("i") >= first * step), "changes")
    stats = score(panel, closed, config).filter(F.col("window_id") >= first)
    done["pairs"] = common.overwrite_partitions(stats, f"{out}/pairs", "window_id")
    common.add_mark(spark, f"{out}/mark", MARK, (new["batch"], closed))
    log.info("scored windows from %d on, wrote %d pairs to %s/pairs", first, done["pairs"], out)
    discard(panel)
    return done


if __name__ == "__main__":
    common.main("source_volumes", run, "Scores the pairs of a text collection's sources while documents arrive.")
