"""The spend ledger: JSON lines that are only ever added to, in batches that are there whole and once.

A batch is written by the tasks into a folder aside, checked, and renamed to the name of its number; a number that is there already is
left as it is. So a batch that is sent again after a failure, by a stream or by hand, adds nothing. Lines hold no trace content.
Reading skips what isn't a whole JSON object, as a line that was cut off by a crash.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewright.sources.folders import Folder

#: The fields of a line, by name: lines have them in this order.
FIELDS = {
    "actual_usd": "double", "cached": "boolean", "model": "string", "prompt": "string", "reserved_usd": "double", "run_id": "string", "status": "string",
    "tokens_in": "long", "tokens_out": "long", "trace_id": "string", "ts": "string",
}
_BATCH, _ASIDE = "batch=", "_aside-"


def lines(entries: DataFrame) -> DataFrame:
    """value: the line of each entry. Fields that entries lack, or that are null, are written as null."""
    cells = [(F.col(n).cast(k) if n in entries.columns else F.lit(None).cast(k)).alias(n) for n, k in FIELDS.items()]
    return entries.select(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias("value"))


def append(entries: DataFrame, path: str, batch: int) -> bool:
    """Add a batch of entries; False if the ledger has that batch already. Its rows are in no certain order."""
    folder, aside = Folder(entries.sparkSession, path), f"{_ASIDE}{uuid.uuid4().hex}"
    name = f"{_BATCH}{batch:020d}"
    if folder.exists(name):
        return False
    try:
        lines(entries).write.text(folder.at(aside))
        return folder.rename_new(aside, name)
    finally:
        folder.delete(aside)


def append_stream(entries: DataFrame, path: str, state: str, **trigger: object) -> StreamingQuery:
    """Add a stream's entries as they come; after a failure the stream sends its last batch again, by the same number."""
    writer = entries.writeStream.option("checkpointLocation", state).foreachBatch(lambda df, number: append(df, path, number) and None)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read(spark: SparkSession, path: str) -> DataFrame:
    """The entries of all batches, and the number of their batch. A missing ledger is empty."""
    schema = ", ".join([*(f"{n} {k}" for n, k in FIELDS.items()), "batch long"])
    batches = Folder(spark, path).names(_BATCH)
    if not batches:
        return spark.createDataFrame([], schema)
    text = spark.read.option("basePath", path).text([f"{path.rstrip('/')}/{b}" for b in batches])
    v = F.try_parse_json(F.trim("value"))
    found = text.select(v.alias("v"), F.col("batch").cast("long").alias("batch")).where(F.schema_of_variant("v").startswith("OBJECT"))
    return found.select(*(_cell(n, k).alias(n) for n, k in FIELDS.items()), "batch")


def _cell(name: str, kind: str):
    # A number may stand in quotes; what is no number is null, and costs nothing.
    return F.try_variant_get("v", f"$.{name}", "string").try_cast(kind) if kind == "double" else F.try_variant_get("v", f"$.{name}", kind)


def totals(ledger: DataFrame) -> DataFrame:
    """run_id (null for all runs), calls, cached_calls, spent_usd and exhausted: what the ledger says was spent, by run and over its life. Entries without a run are of run "". An empty ledger has no totals."""
    spent = F.sum(F.when(~F.isnan("actual_usd"), F.col("actual_usd")))
    rows = ledger.withColumn("run_id", F.coalesce("run_id", F.lit("")))
    return rows.rollup("run_id").agg(
        F.count("*").alias("calls"), F.count_if("cached").alias("cached_calls"), F.coalesce(spent, F.lit(0.0)).alias("spent_usd"), F.coalesce(F.bool_or(F.col("status") == "budget_exhausted"), F.lit(False)).alias("exhausted")
    )
