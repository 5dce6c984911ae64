"""Readers of CSV, JSON lines, URL lists and sitemaps, and sinks that replace or append tables as a whole."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.shared import shared_dir, written


def read_csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """CSV with a header and a declared schema; what can't be parsed is null. Only ``columns`` are parsed."""
    rows = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    rows = rows.where(where) if where is not None else rows
    return rows.select(*columns) if columns else rows


def read_text_csv(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """CSV as strings, missing values as empty strings."""
    return spark.read.schema(", ".join(f"`{n}` string" for n in names)).option("header", True).csv(path).na.fill("")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines without those that are blank or malformed."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_url_lists(spark: SparkSession, path: str, per_file: int | None = None, new_per_file: int | None = None, list_of: str = "(.*)") -> DataFrame:
    """(file, line, url): each URL where it is seen first, over lists in the order of their names.

    ``list_of`` is an expression whose group is a list's name in a file's path:
    files of one list go on where the one before ends. ``per_file`` leaves out
    lines of a list from that place on, before URLs of earlier lists go.
    ``new_per_file`` takes so many URLs of a list that weren't taken from earlier
    ones, list by list. None or 0 is no limit. Lists of any length are read in
    splits; blank lines don't count.
    """
    lines = spark.read.text(path).select(F.btrim("value", F.lit(" \t\r\x0b\x0c")).alias("url"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")).where("url <> ''")
    lines = written(lines.withColumn("file", F.regexp_extract("path", list_of, 1)).withColumn("id", F.monotonically_increasing_id()))
    splits = lines.groupBy("file", "path", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = Window.partitionBy("file").orderBy("path", "block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "path", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rows = lines.join(splits, ["file", "path", "block"]).select("file", (F.col("id") - F.col("first") + F.col("before")).cast("int").alias("line"), "url")
    rows = rows.where(F.col("line") < per_file) if per_file else rows
    if new_per_file:
        return _taken(spark, rows, new_per_file)
    first = rows.groupBy("url").agg(F.min(F.struct("file", "line")).alias("x"))
    return first.select("x.file", "x.line", "url")


def _taken(spark: SparkSession, rows: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` URLs of each list that no earlier list gave: what a list gives depends on those before it."""
    taken = shared_dir(spark)
    rows.select("file", "line", "url").limit(0).write.parquet(taken)
    for r in rows.select("file").distinct().orderBy("file").collect():
        one = rows.where(F.col("file") == r["file"]).groupBy("file", "url").agg(F.min("line").alias("line"))
        given = spark.read.schema(rows.schema).parquet(taken)
        new = one.join(given.select("url"), "url", "left_anti").orderBy("line").limit(limit)
        new.select("file", "line", "url").write.mode("append").parquet(taken)
    return spark.read.schema(rows.schema).parquet(taken)


def sitemap_locations(xml: Column) -> Column:
    """The addresses in a sitemap."""
    return F.transform(F.regexp_extract_all(xml, F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), F.lit(1)), lambda x: F.replace(x, F.lit("&amp;"), F.lit("&")))


def months_between(index_xml: Column, first: str, last: str) -> Column:
    """(month, location) of the monthly sitemaps of an index from ``first`` to ``last`` (yyyy-MM), in that order."""
    name = r"news-(\d{4})-(\d{1,2})"

    def named(place: Column) -> Column:
        month = F.concat(F.regexp_extract(place, name, 1), F.lit("-"), F.lpad(F.regexp_extract(place, name, 2), 2, "0"))
        return F.struct(F.when(place.rlike(name), month).alias("month"), place.alias("location"))

    return F.array_sort(F.filter(F.transform(sitemap_locations(index_xml), named), lambda x: F.coalesce(x["month"].between(first, last), F.lit(False))))


def read_term_lists(spark: SparkSession, path: str) -> DataFrame:
    """(name, place, term) of dictionary files in the list form of YAML: ``name:`` and, below it, lines ``- term``.

    Files are read whole: a dictionary is small. Quotes around a term and comments go.
    """
    sections = F.regexp_extract_all("value", F.lit(r"(?m)^[^\s#:][^:\n]*:[ \t]*(?:#.*)?\n(?:[ \t]*(?:-.*|#.*)?(?:\n|\z))*"), F.lit(0))
    found = spark.read.text(path, wholetext=True).select(F.explode(sections).alias("section"))
    terms = F.regexp_extract_all("section", F.lit(r"(?m)^[ \t]*-[ \t]+(.*?)[ \t]*(?:[ \t]#.*)?$"), F.lit(1))
    rows = found.select(F.btrim(F.substring_index("section", ":", 1)).alias("name"), F.posexplode(terms).alias("place", "term"))
    return rows.withColumn("term", F.regexp_replace("term", r"""^(["'])(.*)\1$""", "$2"))


def unwrapped(body: Column, element: str) -> Column:
    """The elements of a JSON answer, whether it is a list or holds one as ``data`` or ``items``."""
    envelope = F.from_json(body, f"struct<data: array<{element}>, items: array<{element}>>")
    return F.coalesce(F.when(F.ltrim(body).startswith("["), F.from_json(body, f"array<{element}>")), envelope["data"], envelope["items"])


def finite(column: Column) -> Column:
    """Null where a number is not finite."""
    value = column.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def variants(body: Column) -> Column:
    """The elements of a JSON answer as variants, whether it is a list or holds one as ``data`` or ``items``; null where it is neither, or can't be read."""
    whole = F.try_parse_json(body)
    return F.coalesce(*[F.try_variant_get(whole, place, "array<variant>") for place in ("$", "$.data", "$.items")])


def _hadoop(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def replace_table(rows: DataFrame, path: str) -> DataFrame:
    """Write ``rows`` as a new version below ``path`` and let its pointer name it; give the table.

    The pointer is a small file that an overwriting rename replaces: where the file
    system renames atomically (as HDFS and local disks do), readers see the old
    version or the new one, whole, at every moment, and a write that fails changes
    nothing. A version stays until the one after the next is written, for readers that have begun.
    """
    spark, version = rows.sparkSession, f"version-{uuid.uuid4().hex}"
    before = current_version(spark, path)
    rows.write.parquet(f"{path}/{version}")
    fresh, files = _hadoop(spark, f"{path}/_pointer.{version}")
    out = files.create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(options, 1)
    how[0] = options.OVERWRITE
    pointer, _ = _hadoop(spark, f"{path}/_pointer")
    fresh, pointer = fresh.makeQualified(files.getUri(), files.getWorkingDirectory()), pointer.makeQualified(files.getUri(), files.getWorkingDirectory())
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration()).rename(fresh, pointer, how)
    for found in files.listStatus(pointer.getParent()):
        name = found.getPath().getName()
        if name.startswith("version-") and name not in (version, before):
            files.delete(found.getPath(), True)
    return read_replaced(spark, path)


def current_version(spark: SparkSession, path: str) -> str | None:
    """The name of the version that readers get; None before the first one is whole."""
    pointer, files = _hadoop(spark, f"{path}/_pointer")
    if not files.exists(pointer):
        return None
    file = files.open(pointer)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
    finally:
        file.close()


def read_replaced(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``replace_table`` wrote last."""
    version = current_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"no table below {path}")
    return spark.read.parquet(f"{path}/{version}")


def append_table(rows: DataFrame, path: str) -> DataFrame:
    rows.write.mode("append").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def reload_tables(tables: dict[str, tuple[DataFrame, dict[str, tuple[str, str]]]], path: str) -> dict[str, DataFrame]:
    """Replace several tables below ``path``, each after those that it refers to, once all references hold.

    ``tables`` is name -> (rows, column -> (table, column) that it refers to).
    References are checked on the new rows of both sides before anything is replaced; null ones hold.
    """
    order: list[str] = []
    while len(order) < len(tables):
        ready = [t for t, (_, refers) in tables.items() if t not in order and all(other in order or other == t for other, _ in refers.values())]
        if not ready:
            raise ValueError(f"tables that refer to one another in a circle, or to others: {sorted(set(tables) - set(order))}")
        order += ready
    for name in order:
        rows, refers = tables[name]
        for column, (other, target) in refers.items():
            known = tables[other][0].select(F.col(target).alias("_known")).distinct()
            lost = rows.where(F.col(column).isNotNull()).join(known, F.col(column) == F.col("_known"), "left_anti")
            if not lost.isEmpty():
                raise ValueError(f"{name}.{column} has values that aren't in {other}.{target}")
    return {name: replace_table(tables[name][0], f"{path}/{name}") for name in order}
