"""Names and ids."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.schema import StoreError

#: Actors that are no players, and the first id of players.
ACTORS = {0: "#unknown", 1: "#engine", 2: "#tests"}
FIRST_PLAYER = 16


def named(ids: dict[int, str], c: Column, unknown: Column | None = None) -> Column:
    out = F.coalesce(*[F.when(c == k, v) for k, v in ids.items()])
    return F.coalesce(out, F.lit(None).cast("string") if unknown is None else unknown)


def strictly(ids: dict[int, str], c: Column) -> Column:
    """The name of an id; one that has none raises."""
    return F.coalesce(named(ids, c), F.raise_error(F.concat(F.lit("no such id: "), c.cast("string"))))


def actor_name(actor: Column, known: Column) -> Column:
    return F.coalesce(named(ACTORS, actor), known, F.concat(F.lit("#"), actor.cast("string")))


def valid_name(name: Column) -> Column:
    return F.coalesce(F.is_valid_utf8(name) & F.length(name).between(1, 256) & ~name.rlike(r"[\t\n\r\x00]"), F.lit(False))


def assign(names: DataFrame, known: DataFrame, first: int = FIRST_PLAYER, most: int = (1 << 31) - 1) -> DataFrame:
    """id and name of known and new names; new ones get the next ids in the order of names. Raises beyond the highest id.

    Only names that are new, and different, are put in order, which one task does: they are users and states.
    """
    last = max(known.agg(F.max("id")).first()[0] or 0, first - 1)
    new = names.select("name").distinct().filter(valid_name(F.col("name"))).join(known.select("name"), "name", "left_anti")
    if last + (n := new.count()) > most:
        raise StoreError("INTERNAL", f"{n} new names don't fit: ids end at {most}")
    new = new.withColumn("k", F.row_number().over(W.orderBy("name")))
    return known.select("id", "name").unionByName(new.select((F.lit(last) + F.col("k")).cast("int").alias("id"), "name"))


def register(seen: DataFrame, known: DataFrame) -> DataFrame:
    """id, uuid and name of players known and seen (uuid, name, at): new ones get ids, and a new name keeps its id.

    Of several names of one uuid the latest counts (of the same time, the last in order).
    """
    latest = seen.filter(valid_name(F.col("name"))).groupBy("uuid").agg(F.max(F.struct("at", "name")).alias("r")).select("uuid", F.col("r.name").alias("new"))
    out = known.join(latest, "uuid", "full")
    kept = out.filter("id is not null").select("id", "uuid", F.coalesce("new", "name").alias("name"))
    ids = assign(out.filter("id is null").select(F.col("uuid").alias("name")), known.select("id", F.col("uuid").alias("name")))
    return kept.unionByName(out.filter("id is null").join(ids.select("id", F.col("name").alias("uuid")).withColumnRenamed("id", "__id"), "uuid").select(F.col("__id").alias("id"), "uuid", F.col("new").alias("name")))


#: Lines of a dictionary file: of actors (id, uuid and name, by tabs), and of worlds and states (name=id).
ACTOR_LINE, NAMED_LINE = "^([0-9]{1,10})\t([0-9a-f-]{36})\t([^\t]*)$", "^(.*)=([0-9]{1,10})$"


def load(spark: SparkSession, path: str, actors: bool = False, first: int = 0, last: int = (1 << 31) - 1) -> DataFrame:
    """id, name (and uuid of actors) of a dictionary file. Raises on lines that don't parse, ids out of range and repeats."""
    line = F.col("value")
    pattern = ACTOR_LINE if actors else NAMED_LINE
    part = lambda k: F.regexp_extract(line, pattern, k)
    columns = [part(1).alias("id"), part(3).alias("name"), part(2).alias("uuid")] if actors else [part(2).alias("id"), part(1).alias("name")]
    rows = spark.read.text(path).filter(line != "").select(line.rlike(pattern).alias("good"), *columns)
    rows = rows.withColumn("id", F.when(F.col("id") != "", F.col("id").cast("bigint")))
    unique = ["id", "uuid"] if actors else ["id", "name"]
    bad = rows.filter(~F.col("good") | ~F.col("id").between(first, last) | ~valid_name(F.col("name")))
    if not bad.isEmpty() or any(not rows.groupBy(c).count().filter("count > 1").isEmpty() for c in unique):
        raise StoreError("CORRUPT", f"{path} is not a dictionary")
    return rows.drop("good").withColumn("id", F.col("id").cast("int"))


def replace(spark: SparkSession, path: str, rows: DataFrame, actors: bool = False, first: int = 0, last: int = (1 << 31) - 1) -> int:
    """Writes a dictionary file anew: under another name, read again and checked, then put in its place at once. How many lines."""
    line = F.concat_ws("\t", F.col("id").cast("string"), "uuid", "name") if actors else F.concat_ws("=", "name", F.col("id").cast("string"))
    jvm, temp = spark._jvm, f"{path}.new-{uuid.uuid4().hex}"
    place = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    # a file of names is read and written by one task; names are users, worlds and states
    rows.select(line.alias("value")).coalesce(1).write.text(temp)
    try:
        load(spark, temp, actors, first, last)
        n = spark.read.text(temp).count()
        part = next((s.getPath() for s in fs.listStatus(place(temp)) if s.getPath().getName().startswith("part-")), None)
        if part is None:
            fs.create(place(path), True).close()
            return 0
        if fs.getUri().getScheme() == "file":  # at once; without the old file's checksum, which is another file
            old = jvm.java.io.File(place(path).toUri().getPath())
            jvm.java.io.File(old.getParentFile(), f".{old.getName()}.crc").delete()
            done = jvm.java.io.File(part.toUri().getPath()).renameTo(old)
        else:  # such a rename does not replace
            done = (not fs.exists(place(path)) or fs.delete(place(path), False)) and fs.rename(part, place(path))
        if not done:
            raise StoreError("DISK", f"{path} could not be replaced")
        return n
    finally:
        fs.delete(place(temp), True)
