"""What a store's bytes are for."""

from __future__ import annotations

from urllib.parse import urlparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.sources.store import Store


def files(store: Store) -> DataFrame:
    """path, kind (hot, shards, blobs, refs, log, manifest or leases), table (the folder of one write) and bytes of each file under a store's root."""
    found = store.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(store.root).select("path", F.col("length").alias("bytes"))
    root = urlparse(store.root).path
    parts = F.split(F.substring(F.col("path"), F.instr("path", root) + len(root) + 1, F.length("path")), "/")
    return found.select("path", F.get(parts, F.lit(0)).alias("kind"), F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))).alias("table"), "bytes")


def density(store: Store) -> DataFrame:
    """By kind: files, bytes, bytes of what the latest snapshot does not name, rows that it names, and bytes a row."""
    m = store.manifest()
    named = [(h["name"], h["rows"]) for h in m["hot"]] + [(s["name"], s["rows"]) for s in store.live(m)] + [(n, None) for k in ("blobs", "refs") for n in m[k]] + [(f["name"], None) for f in m["files"]] + [(f"manifest/{m['version']}.json", None)]
    live = store.spark.createDataFrame(named, "table string, rows bigint")
    of = files(store).join(live.withColumn("named", F.lit(True)), "table", "left")
    by_table = of.groupBy("kind", "table").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.sum(F.when(F.col("named").isNull(), F.col("bytes")).otherwise(0)).alias("unassigned"), F.first("rows").alias("rows"))
    out = by_table.groupBy("kind").agg(F.sum("files").cast("bigint").alias("files"), *[F.sum(n).cast("bigint").alias(n) for n in ("bytes", "unassigned", "rows")])
    return out.withColumn("bytes_a_row", F.when(F.col("rows") > 0, (F.col("bytes") - F.col("unassigned")) / F.col("rows")))
