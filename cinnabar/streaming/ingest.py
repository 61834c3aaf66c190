"""Structure files that keep arriving, appended to a store batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store
from ..sources.structures import source_of


def watch_smiles(spark: SparkSession, path: str) -> DataFrame:
    """(id, source, structure) of SMILES files as they appear in a folder."""
    df = spark.readStream.text(path).where(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+", 2).alias("p"), F.col("_metadata.file_name").alias("file"))
    return df.select(F.coalesce(F.get("p", F.lit(1)), F.get("p", F.lit(0))).alias("id"), source_of(F.col("file")).alias("source"), F.get("p", F.lit(0)).alias("structure"))


def into_store(df: DataFrame, store: Store, checkpoint: str, every: str = "2 seconds", once: bool = False) -> StreamingQuery:
    """Appends each batch in one commit."""
    w = df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: store.add(batch) and None)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()
