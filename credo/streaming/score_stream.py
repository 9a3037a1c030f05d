"""Score statements arriving as a stream.

The scoring is the stateless per-row chain of ``credo.plans.scoring``:
stream-static left joins with the artifact lookups, the model and the
explanation columns.  No aggregation crosses rows, so there is no state to
keep and no watermark is needed; results equal the batch path on the same
rows.  Lookups change only when the query is restarted with new artifacts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from credo.plans.scoring import score_requests


def score_stream(stream: DataFrame, artifacts: dict, clean_text: bool | None = None, explain: bool = True) -> DataFrame:
    return score_requests(stream, artifacts, clean_text=clean_text, explain=explain)


def start(stream: DataFrame, artifacts: dict, out_path: str, checkpoint: str, available_now: bool = True,
          clean_text: bool | None = None):
    """Write scored rows as parquet with a checkpoint (exactly-once file sink)."""
    q = (score_stream(stream, artifacts, clean_text).writeStream.format("parquet")
         .option("path", out_path).option("checkpointLocation", checkpoint).outputMode("append"))
    q = q.trigger(availableNow=True) if available_now else q
    return q.start()


def lineitem_statement_stream(spark: SparkSession, sf_dir: str, max_files: int = 1, arrivals: str | None = None) -> DataFrame:
    """The f2 statements as a stream: lineitem files are read as a file
    stream and joined with the static order / supplier / nation tables.
    ``arrivals`` is a folder that lineitem files arrive in, if not ``sf_dir``."""
    from credo.plans import fixtures as fx

    li = fx.table(spark, sf_dir, "lineitem")
    stream = spark.readStream.schema(li.schema).option("maxFilesPerTrigger", max_files)
    if arrivals is None:
        stream = stream.option("pathGlobFilter", "lineitem*.parquet").parquet(sf_dir.rstrip("/"))
    else:
        stream = stream.parquet(arrivals)
    return fx.f2_from(
        stream.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                      "l_extendedprice", "l_returnflag", "l_linestatus"),
        fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"),
        fx.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"),
        fx.table(spark, sf_dir, "nation").select("n_nationkey", "n_name"),
    )


def start_with_reload(stream: DataFrame, artifacts_path, out_path: str, checkpoint: str,
                      available_now: bool = True, clean_text: bool | None = None):
    """Score each micro-batch with the artifacts current at that batch.

    ``artifacts_path`` is a folder of training runs, of which the one published
    last is taken (``newest_complete``), or a callable returning the folder to
    use; it is read once per micro-batch, so new
    lookups and models take effect without a restart.  Each batch is written
    to its own ``batch_id`` partition with dynamic overwrite: a batch replayed
    after a failure replaces its own output (exactly-once results)."""
    from pyspark.sql import functions as F

    from credo.sources.artifacts import load_artifacts, newest_complete

    def write_batch(batch_df: DataFrame, batch_id: int) -> None:
        spark = batch_df.sparkSession
        folder = artifacts_path() if callable(artifacts_path) else newest_complete(spark, artifacts_path)
        art = load_artifacts(spark, folder)
        scored = score_requests(batch_df, art, clean_text=clean_text).withColumn("batch_id", F.lit(batch_id))
        (scored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(out_path))

    q = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    q = q.trigger(availableNow=True) if available_now else q
    return q.start()
