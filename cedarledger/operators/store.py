"""Keyed upserts, deduplication and versioned storage of parsed filings.

A run gets a number that no other run has (next_seq). It writes its rows beside those that are there, under that number, and
then puts its manifest, the list of its filings, in place by one rename (commit). current() reads of each filing the rows of the
last run whose manifest is there: all tables of a run change together, also where a filing has no rows left, and a run
that is killed changes nothing. Versions that were superseded, or left by killed runs, are deleted after the commit.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Window, functions as F

FILING = ["cik", "accession_number"]
MANIFEST = "cik string, accession_number string, kind string, ingest_seq long"


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | list[str] = "ingest_seq") -> DataFrame:
    """Rows of both, of each key the one with the largest order; one shuffle on the key."""
    both = old.unionByName(new, allowMissingColumns=True)
    last = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in ([order] if isinstance(order, str) else order)))
    return both.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def dedupe_sources(documents: DataFrame, order: str = "seq") -> DataFrame:
    """Of documents with one checksum the first; documents without a checksum all stay."""
    known = documents.filter(F.col("checksum").isNotNull())
    first = known.withColumn(
        "_n", F.row_number().over(Window.partitionBy("checksum").orderBy(order))
    ).filter("_n = 1").drop("_n")
    return first.unionByName(documents.filter(F.col("checksum").isNull()))


def next_seq(spark, tables: str) -> int:
    """A run's number, larger than those before it: whoever creates the file of that name has it, once and for all."""
    fs, folder = _path(spark, f"{tables}/runs")
    fs.mkdirs(folder)
    taken = [s.getPath().getName() for s in fs.listStatus(folder)]
    seq = max((int(n) for n in taken if n.isdigit()), default=0)
    while True:
        seq += 1
        p = _path(spark, f"{tables}/runs/{seq}")[1]
        try:
            fs.create(p, False).close()
            return seq
        except Py4JJavaError:
            if not fs.exists(p):
                raise


def versions(spark, tables: str, name: str) -> DataFrame:
    """All rows of a table, whatever run they are of; no rows, with the table's columns, where it holds none."""
    schema = spark.read.parquet(f"{tables}/schemas/{name}").schema
    return spark.read.schema(schema).parquet(f"{tables}/{name}")


def manifest(spark, tables: str, kind: str) -> DataFrame:
    """cik, accession_number, ingest_seq of all runs of a kind that were committed."""
    return spark.read.schema(MANIFEST).parquet(f"{tables}/manifest").filter(F.col("kind") == kind).drop("kind")


def current_rows(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Of rows (cik, accession_number, ingest_seq and others) those of the last run that lists their filing."""
    live = runs.groupBy(*FILING).agg(F.max("ingest_seq").alias("ingest_seq"))
    return rows.join(live, [*FILING, "ingest_seq"], "left_semi").select(*rows.columns)


def current(spark, tables: str, name: str, kind: str) -> DataFrame:
    return current_rows(versions(spark, tables, name), manifest(spark, tables, kind))


def write_versions(spark, tables: str, outputs: dict[str, DataFrame], seq: int) -> None:
    """Rows of a run, which nobody reads before commit_run()."""
    for name, df in outputs.items():
        rows = df.withColumns({c: F.col(c).cast("string") for c in FILING} | {"ingest_seq": F.lit(seq).cast("long")})
        rows.limit(0).write.mode("ignore").parquet(f"{tables}/schemas/{name}")
        rows.write.mode("append").partitionBy(*FILING, "ingest_seq").parquet(f"{tables}/{name}")


def commit_run(spark, tables: str, kind: str, names: list[str], every: str, seq: int) -> None:
    """Put the run's manifest in place, then delete what it supersedes. every: the table that has a row for each filing."""
    filings = versions(spark, tables, every).filter(F.col("ingest_seq") == seq).select(*FILING).distinct()
    waiting, place = f"{tables}/manifest/_{kind}-{seq}", f"{tables}/manifest/kind={kind}"
    filings.write.mode("overwrite").parquet(waiting)
    fs, p = _path(spark, place)
    fs.mkdirs(p)
    if not fs.rename(_path(spark, waiting)[1], _path(spark, f"{place}/ingest_seq={seq}")[1]):
        raise RuntimeError(f"run {seq} of {kind} can't be committed")
    own = manifest(spark, tables, kind).filter(F.col("ingest_seq") == seq).drop("ingest_seq")
    for name in names:
        lies = F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("folder")
        old = versions(spark, tables, name).filter(F.col("ingest_seq") < seq).select(*FILING, lies).distinct().join(
            own, FILING, "left_semi"
        )
        for r in old.toLocalIterator():  # a folder a filing
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(r["folder"])), True)


def commit(spark, tables: str, kind: str, outputs: dict[str, DataFrame], every: str) -> int:
    """Replace, in all of outputs at once, the filings that the table every lists. Gives the run's number."""
    seq = next_seq(spark, tables)
    write_versions(spark, tables, outputs, seq)
    commit_run(spark, tables, kind, list(outputs), every, seq)
    return seq


def orphans(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """Child rows whose parent is missing."""
    return child.join(parent.select(*keys).distinct(), keys, "left_anti")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out


def content_path(source: Column, checksum: Column, filename: Column) -> Column:
    """<source>/<first two of checksum>/<checksum>/<filename>"""
    return F.concat_ws("/", source, F.substring(checksum, 1, 2), checksum, filename)


def content_addressed(files: DataFrame, source: str) -> DataFrame:
    """files: path and content as binaryFile reads them. A wrong expected_checksum, if there is one, shows as corrupt.
    """
    checksum = F.sha2("content", 256)
    name = F.element_at(F.split("path", "/"), -1)
    out = files.select(
        "path", F.length("content").alias("size"), checksum.alias("checksum"),
        content_path(F.lit(source), checksum, name).alias("stored_path"),
        *(["expected_checksum"] if "expected_checksum" in files.columns else [])
    )
    return out.withColumn(
        "corrupt",
        F.coalesce(
            F.col("expected_checksum") != F.col("checksum"), F.lit(False)
        ) if "expected_checksum" in files.columns else F.lit(False)
    )


def _stored(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).select("stored_path") if _exists(spark, path) else spark.createDataFrame([], "stored_path string")


def content_status(files: DataFrame, path: str, source: str) -> DataFrame:
    """content_addressed() of files, and whether the store at path has each already."""
    there = _stored(files.sparkSession, path).withColumn("already_cached", F.lit(True))
    return content_addressed(files, source).join(there, "stored_path", "left").fillna(False, ["already_cached"])


def write_content(files: DataFrame, path: str, source: str) -> None:
    """Store files by their content under path, in partitions by the first two digits of the checksum. Content that is
    there is not written again; corrupt files are left out.
    """
    good = content_addressed(files, source).filter("NOT corrupt").select("path", "checksum", "stored_path")
    new = files.select("path", "content").join(good, "path").join(
        _stored(files.sparkSession, path), "stored_path", "left_anti"
    ).dropDuplicates(["stored_path"])
    new.select(
        "stored_path", "checksum", "content", F.substring("checksum", 1, 2).alias("prefix")
    ).write.mode("append").partitionBy("prefix").parquet(path)


def _path(spark, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def removed(spark, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def recover(spark, path: str) -> None:
    """Put back what replace() had set aside, if it was killed between its two renames."""
    fs, p = _path(spark, path)
    aside = _path(spark, f"{path}.old")[1]
    if not fs.exists(p) and fs.exists(aside):
        fs.rename(aside, p)


def replace(df: DataFrame, path: str) -> None:
    """Write df in place of what is at path, which df may read: beside it first, then the old is set aside and the new
    renamed. recover() undoes half of that."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}.next")
    fs, p = _path(spark, path)
    aside = _path(spark, f"{path}.old")[1]
    if fs.exists(p):
        fs.delete(aside, True)
        fs.rename(p, aside)
    fs.rename(_path(spark, f"{path}.next")[1], p)
    fs.delete(aside, True)


def upsert_table(new: DataFrame, path: str, keys: list[str], order: str | list[str] = "ingest_seq") -> None:
    """Upsert rows into the table at path, which need not be there yet."""
    spark = new.sparkSession
    recover(spark, path)
    replace(
        upsert(
            spark.read.parquet(path), new, keys, order
        ) if _exists(spark, path) else upsert(new.limit(0), new, keys, order),
        path
    )


def snapshot_hash(files: DataFrame) -> DataFrame:
    """Sixteen hex digits for a set of files (path, content), whatever their order: a hash over the hashes of 65,536
    groups, each over its files' checksums by path.
    """
    one = files.select("path", F.sha2("content", 256).alias("checksum"))
    group = F.substring(F.sha2("path", 256), 1, 4)
    hashed = one.groupBy(group.alias("group")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "path", "checksum"))), ","), 256).alias("hash")
    )
    return hashed.agg(
        F.substring(
            F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "group", "hash"))), ","), 256), 1, 16
        ).alias("snapshot")
    )
