"""Reading and writing tables and matrices, and the project that holds them.

A project is a folder of Parquet tables in any store that Spark reaches, with a registry of its matrices and results
among them. Nothing is kept outside the folder, and several projects may be open at once.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfare.operators import matrix as od

# Base schemas of a network; further columns may follow.
SCHEMAS = {
    "links": "link_id long, a_node long, b_node long, direction int, distance double, modes string, link_type string",
    "nodes": "node_id long, is_centroid boolean, modes string, link_types string, lon double, lat double",
    "zones": "zone_id long, area double, name string, population double, ring array<struct<x:double,y:double>>",
    "modes": "mode_id string, mode_name string, pce double, vot double, ppv double",
    "link_types": "link_type_id string, link_type string, lanes double, lane_capacity double, speed double",
    "periods": "period_id long, period_start long, period_end long, period_description string",
    "about": "infoname string, infovalue string",
    "fields": "table_name string, field_name string, description string",
    "registry": "name string, kind string, path string, description string, written timestamp",
}


def read(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    """A table by its ending: parquet, csv, json or orc; CSV and JSON are best given a schema."""
    ending = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read.options(**options)
    if schema:
        reader = reader.schema(schema)
    if ending == "csv" or ending == "txt":
        return reader.option("header", True).csv(path)
    if ending in ("json", "jsonl"):
        return reader.json(path)
    if ending == "orc":
        return reader.orc(path)
    return reader.parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def gtfs_table(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """A feed's CSV: titles lower-cased and stripped to ASCII, blank rows dropped, missing columns added as empty text,
    empty numbers read as 0 and whole numbers cut at the point. columns: name to 'string', 'long' or 'double'."""
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    plain = {"".join(ch for ch in c.lower() if 32 < ord(ch) < 127): c for c in raw.columns}
    raw = raw.na.drop("all")

    def column(name: str, kind: str):
        text = F.trim(F.regexp_replace(F.coalesce(F.col(f"`{plain[name]}`"), F.lit("")), r"[^\x00-\x7F]", "")) if name in plain else F.lit("")
        if kind == "string":
            return text.alias(name)
        number = F.when(text == "", F.lit("0")).otherwise(text)
        return (F.split(number, r"\.")[0].cast("long") if kind == "long" else number.cast("double")).alias(name)

    return raw.select(*[column(n, k) for n, k in columns.items()])


def trip_list(spark: SparkSession, path: str, origin: str, destination: str, values: list[str]) -> DataFrame:
    rows = spark.read.option("header", True).csv(path)
    typed = rows.select(F.col(origin).cast("long"), F.col(destination).cast("long"), *[F.col(v).cast("double") for v in values])
    return od.from_trip_list(typed, origin, destination, values)


def write(df: DataFrame, path: str, overwrite: bool = False, partition_by: list[str] | None = None) -> None:
    """By the ending of the path; an existing table is an error unless it may be overwritten."""
    ending = path.rstrip("/").rsplit(".", 1)[-1].lower()
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if ending == "csv":
        writer.option("header", True).csv(path)
    elif ending in ("json", "jsonl"):
        writer.json(path)
    elif ending == "orc":
        writer.orc(path)
    else:
        writer.parquet(path)


def write_routes(routes: DataFrame, path: str) -> None:
    """Route sets by origin: readers of one origin read one folder."""
    routes.repartition("origin").write.mode("overwrite").partitionBy("origin").parquet(path)


def read_path(spark: SparkSession, path: str, origin: int, destination: int) -> DataFrame:
    """Stored paths of one pair: the origin's folder only, the destination by pushed-down filter."""
    return spark.read.parquet(path).filter((F.col("origin") == origin) & (F.col("destination") == destination))


def export_gtfs(tables: dict[str, DataFrame], folder: str) -> None:
    """One CSV of each table of a feed; a feed's files are whole by its specification, so each is one part."""
    for name, df in tables.items():
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def shape_export(points: DataFrame) -> DataFrame:
    """Shape points with the distance travelled as a share of the shape's length."""
    from pyspark.sql import Window

    w = Window.partitionBy("shape_id").orderBy("shape_pt_sequence")
    step = F.sqrt(F.pow(F.col("shape_pt_lon") - F.lag("shape_pt_lon").over(w), 2) + F.pow(F.col("shape_pt_lat") - F.lag("shape_pt_lat").over(w), 2))
    run = points.withColumn("__s", F.coalesce(step, F.lit(0.0))).withColumn("__c", F.sum("__s").over(w))
    return run.withColumn("shape_dist_traveled", F.coalesce(F.try_divide("__c", F.max("__c").over(Window.partitionBy("shape_id"))), F.lit(0.0))).drop("__s", "__c")


def save_results(flows: DataFrame, path: str, keep_zero_flows: bool = True, total: str = "PCE_tot") -> None:
    """Link results; a result is never overwritten."""
    write(flows if keep_zero_flows else flows.filter(F.col(total) > 0), path)


def save_skims(final: DataFrame | None, blended: DataFrame | None, path: str) -> None:
    """Final and blended skims side by side, their cores marked by a suffix."""
    parts = []
    for df, mark in ((final, "final"), (blended, "blended")):
        if df is not None:
            parts.append(df.select("origin", "destination", *[F.col(c).alias(f"{c}_{mark}") for c in od.cores(df)]))
    write(od.combine(parts, fill=None), path)


def save_select_links(found: dict[str, tuple[DataFrame, DataFrame]], folder: str, flows: bool = True, matrices: bool = True) -> None:
    """By class, the loads and the demand of select-link sets (see Assignment.select_links), each a table of its own."""
    for name, (loads, demand) in found.items():
        if flows:
            write(loads, f"{folder}/{name}_flows.parquet")
        if matrices:
            write(demand, f"{folder}/{name}_demand.parquet")


def save_class_skims(skims: dict[str, dict[str, DataFrame]], folder: str) -> None:
    """A file of skims a class, final and blended side by side."""
    for name, parts in skims.items():
        save_skims(parts.get("final"), parts.get("blended"), f"{folder}/{name}.parquet")


def cores_wanted(count: int, there: int) -> int:
    """Cores for a count as users give it: 0 is all, a negative one leaves so many free, at least one, at most all."""
    if not isinstance(count, int) or isinstance(count, bool):
        raise ValueError("a number of cores is a whole number")
    return there if count == 0 else max(1, there + count) if count < 0 else min(count, there)


# What a project is run with unless told otherwise.
PARAMETERS = {
    "assignment": {"rgap": 1e-4, "maximum_iterations": 250},
    "distribution": {"ipf": {"convergence": 1e-4, "maximum_iterations": 5000, "balance": 1e-3}, "gravity": {"maximum_error": 1e-4, "maximum_iterations": 100}},
}


def save_graph(edges: DataFrame, crosswalk: DataFrame | None, settings: dict, folder: str) -> None:
    """A prepared graph: its edges, its crosswalk to compressed links if there is one, and how it was made."""
    write(edges, f"{folder}/edges.parquet")
    if crosswalk is not None:
        write(crosswalk, f"{folder}/crosswalk.parquet")
    spark = edges.sparkSession
    write(spark.createDataFrame([(k, str(v)) for k, v in sorted(settings.items())], "name string, value string"), f"{folder}/settings.parquet")


def load_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, dict[str, str]]:
    settings = {r.name: r.value for r in spark.read.parquet(f"{folder}/settings.parquet").collect()}
    return spark.read.parquet(f"{folder}/edges.parquet"), settings


def save_paths(paths: DataFrame, iteration: int, class_name: str, folder: str) -> None:
    """Paths of one iteration and class, by origin: a reader of one origin opens one folder."""
    marked = paths.withColumn("iteration", F.lit(iteration)).withColumn("class", F.lit(class_name))
    marked.repartition("origin").write.mode("append").partitionBy("iteration", "class", "origin").parquet(folder)


class Project:
    """A folder of tables. ``open`` checks that it is one, ``new`` lays it out, ``close`` removes orphan nodes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @classmethod
    def new(cls, spark: SparkSession, folder: str) -> Project:
        project = cls(spark, folder)
        if project._exists("about"):
            raise FileExistsError(folder)
        for name, schema in SCHEMAS.items():
            spark.createDataFrame([], T._parse_datatype_string(schema)).write.parquet(project._path(name))
        project.save("periods", spark.createDataFrame([(1, 0, 86400, "Default time period, whole day")], SCHEMAS["periods"]))
        return project

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Project:
        project = cls(spark, folder)
        project._finish_replacements()
        if not project._exists("about"):
            raise FileNotFoundError(f"{folder} holds no project")
        return project

    def _finish_replacements(self) -> None:
        """A table that was set aside when a replacement was broken off comes back."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return
        for f in fs.listStatus(root):
            name = f.getPath().getName()
            if name.startswith(".") and name.endswith(".old") and not self._exists(name[1:-4]):
                fs.rename(f.getPath(), jvm.org.apache.hadoop.fs.Path(self._path(name[1:-4])))

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def _exists(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._path(name))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def tables(self) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.folder)
        found = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)
        return sorted(f.getPath().getName()[: -len(".parquet")] for f in found if f.getPath().getName().endswith(".parquet"))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._path(name))

    def sql(self, query: str) -> DataFrame:
        """SQL over the project's tables by name."""
        for name in self.tables():
            self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(query)

    def save(self, name: str, df: DataFrame) -> None:
        """Replace a table; it may be made from its own earlier rows, as the new one is whole before the old one goes."""
        fresh = f"{self.folder}/.{name}.new"
        df.write.mode("overwrite").parquet(fresh)
        jvm = self.spark.sparkContext._jvm
        new, old = jvm.org.apache.hadoop.fs.Path(fresh), jvm.org.apache.hadoop.fs.Path(self._path(name))
        fs = new.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        kept = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/.{name}.old")
        fs.delete(kept, True)
        there = fs.exists(old)
        if there and not fs.rename(old, kept):
            raise OSError(f"{name} could not be set aside")
        if not fs.rename(new, old):
            if there:
                fs.rename(kept, old)
            raise OSError(f"{name} could not be replaced")
        fs.delete(kept, True)
        self.spark.catalog.refreshByPath(self._path(name))

    def parameters(self) -> dict:
        """The project's parameters, or the defaults where none were written."""
        rows = self.table("about").filter("infoname = 'parameters'").collect()
        return json.loads(rows[0].infovalue) if rows else json.loads(json.dumps(PARAMETERS))

    def set_parameters(self, parameters: dict) -> None:
        self.set_info("parameters", json.dumps(parameters, sort_keys=True))

    def restore_parameters(self) -> None:
        self.set_parameters(PARAMETERS)

    def note(self, message: str) -> None:
        """Add a line to the project's log, in the order of writing."""
        path = f"{self.folder}/log"
        row = [(datetime.now(timezone.utc), message)]
        self.spark.createDataFrame(row, "written timestamp, message string").coalesce(1).write.mode("append").parquet(path)

    def log(self) -> list[str]:
        from pyspark.errors import AnalysisException

        try:
            return [r.message for r in self.spark.read.parquet(f"{self.folder}/log").orderBy("written").collect()]
        except AnalysisException:  # nothing written yet
            return []

    def clear_log(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/log")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        """Leave the project in order: orphan nodes go, and the log says so."""
        self.clean()
        self.note("closed")

    def describe(self, name: str, new_name: str | None = None, description: str | None = None) -> None:
        """Rename or describe a registered matrix or result; its files stay where they are."""
        registry = self.table("registry")
        if not registry.filter(F.col("name") == name).limit(1).count():
            raise KeyError(name)
        if new_name and registry.filter(F.col("name") == new_name).limit(1).count():
            raise ValueError(f"{new_name} is registered already")
        own = F.col("name") == name
        changed = registry.withColumn("description", F.when(own & F.lit(description is not None), F.lit(description)).otherwise(F.col("description")))
        self.save("registry", changed.withColumn("name", F.when(own, F.lit(new_name or name)).otherwise(F.col("name"))))

    def add_field(self, table: str, field: str, kind: str, description: str) -> None:
        """A column of nulls, and a line about it."""
        if not field.replace("_", "").isalnum() or not field[0].isalpha() or field != field.lower():
            raise ValueError("a field name is lower-case letters, digits and underscores, and starts with a letter")
        df = self.table(table)
        if field in df.columns:
            raise ValueError(f"{table} has {field} already")
        self.save(table, df.withColumn(field, F.lit(None).cast(kind)))
        self.save("fields", self.table("fields").unionByName(self.spark.createDataFrame([(table, field, description)], SCHEMAS["fields"])))

    def set_info(self, name: str, value: str) -> None:
        rest = self.table("about").filter(F.col("infoname") != name)
        self.save("about", rest.unionByName(self.spark.createDataFrame([(name, value)], SCHEMAS["about"])))

    def register(self, name: str, df: DataFrame, kind: str = "matrix", description: str = "") -> None:
        """Write a matrix or result and note it; a name is used once."""
        if self.table("registry").filter(F.col("name") == name).limit(1).count():
            raise ValueError(f"{name} is registered already")
        path = f"{self.folder}/{kind}/{name}"
        df.write.parquet(path)
        row = [(name, kind, path, description, datetime.now(timezone.utc))]
        self.save("registry", self.table("registry").unionByName(self.spark.createDataFrame(row, SCHEMAS["registry"])))

    def registered(self, name: str) -> DataFrame:
        row = self.table("registry").filter(F.col("name") == name).first()
        if row is None:
            raise KeyError(name)
        return self.spark.read.parquet(row.path)

    def forget(self, name: str) -> None:
        self.save("registry", self.table("registry").filter(F.col("name") != name))

    def clean(self) -> None:
        """Remove nodes that are neither centroids nor at any link."""
        from wayfare.operators.network import orphans

        nodes = self.table("nodes")
        self.save("nodes", nodes.join(orphans(nodes, self.table("links")).select("node_id"), "node_id", "left_anti"))
