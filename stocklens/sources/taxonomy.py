"""Marketplace taxonomies: text list, flat XML, nested XML or JSON trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stocklens.functions import text as tx
from stocklens.session import materialise

c = F.col

def parse_list(lines: DataFrame, value: str = "value") -> DataFrame:
    """``id - A > B > C`` lines; comments and blank lines are skipped."""
    pattern = r"^(\d+)\s*-\s*(.+)$"
    line = tx.trim_ws(c(value))
    kept = lines.filter(~c(value).startswith("#") & line.rlike(pattern))
    path = tx.trim_ws(F.regexp_extract(line, pattern, 2))
    rest = [x for x in lines.columns if x != value]
    return kept.select(*rest, F.regexp_extract(line, pattern, 1).alias("id"), path.alias("full_path")).withColumn(
        "name", F.element_at(F.split("full_path", " > "), -1))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    return parse_list(spark.read.text(path))


def read_flat_xml(spark: SparkSession, path: str) -> DataFrame:
    """CATEGORY rows with id, name and full name."""
    schema = "CATEGORY_ID string, CATEGORY_NAME string, CATEGORY_FULLNAME string"
    df = spark.read.format("xml").option("rowTag", "CATEGORY").schema(schema).load(path)
    return df.select(c("CATEGORY_ID").alias("id"), tx.trim_ws(c("CATEGORY_NAME")).alias("name"),
                     tx.trim_ws(c("CATEGORY_FULLNAME")).alias("full_path")).filter("id is not null")


def tree_paths(nodes: DataFrame, separator: str = " | ") -> DataFrame:
    """(id, name, parent_id[, own_path]) to (id, name, full_path, is_leaf).

    Each round doubles the part of the path that is known, so a tree of depth n takes log2(n)
    equi-joins, however deep it is. A node with a path of its own starts a new path there. Nodes that lead
    into a cycle of parents are an error.
    """
    nodes = materialise(nodes)
    own = c("own_path") if "own_path" in nodes.columns else F.lit(None).cast("string")
    parents = nodes.select(c("parent_id").alias("id")).filter("id is not null").distinct().withColumn("inner", F.lit(True))
    known = nodes.select(c("id").alias("up"), F.lit(True).alias("known"))
    steps = materialise(nodes.select(
        "id", "name", F.when(own.isNull(), c("parent_id")).alias("up"), F.coalesce(own, c("name")).alias("path")).join(
        known, "up", "left").withColumn("up", F.when(c("known"), c("up"))).drop("known"))
    count, covered = steps.count(), 1
    while not steps.filter("up is not null").isEmpty():
        if covered > count:
            raise ValueError("the parents of some nodes form a cycle")
        above = steps.select(c("id").alias("up"), c("up").alias("up2"), c("path").alias("path2"))
        moved = steps.filter("up is not null").join(above, "up").select(
            "id", "name", c("up2").alias("up"), F.concat("path2", F.lit(separator), "path").alias("path"))
        steps = materialise(moved.unionByName(steps.filter("up is null").select("id", "name", "up", "path")))
        covered *= 2
    return steps.join(parents, "id", "left").select(
        "id", "name", c("path").alias("full_path"), c("inner").isNull().alias("is_leaf"))


def _nested(fields: str, child: str, levels: int) -> str:
    schema = f"struct<{fields}>"
    for _ in range(levels - 1):
        schema = f"struct<{fields},{child}:array<{schema}>>"
    return schema


def _levels(df: DataFrame, child: str, levels: int, id_of, name_of, path_of=None) -> DataFrame:
    """Adjacency rows of nested arrays, one projection per level."""
    out, current = None, df.select(F.lit(None).cast("string").alias("parent_id"), c("node"))
    for level in range(levels):
        n = c("node")
        key = F.coalesce(id_of(n), F.concat(F.lit("~"), F.coalesce("parent_id", F.lit("")), F.lit("/"), name_of(n)))
        keyed = current.select("parent_id", n, key.alias("id"))
        rows = keyed.select("id", name_of(n).alias("name"), "parent_id",
                            (path_of(n) if path_of else F.lit(None).cast("string")).alias("own_path"))
        out = rows if out is None else out.unionByName(rows)
        if level < levels - 1:
            current = keyed.select(c("id").alias("parent_id"), F.explode(n[child]).alias("node"))
    return out


def _depth(read, child: str, levels: int = 8) -> int:
    """Levels of nested arrays in a document: the schema is deepened until its last level is empty.

    ``read(levels)`` gives rows with a struct ``node`` that is nested so deep.
    """
    while True:
        current, depth = read(levels), 0
        while depth < levels and not current.isEmpty():
            depth += 1
            if depth < levels:
                current = current.select(F.explode(c("node")[child]).alias("node"))
        if depth < levels:
            return max(depth, 1)
        levels *= 2


def read_nested_xml(spark: SparkSession, path: str, root_tag: str = "HEUREKA") -> DataFrame:
    """Nested CATEGORY elements, as deep as the file goes; leaves only, path joined by `` | ``."""
    def read(levels: int) -> DataFrame:
        node = _nested("CATEGORY_ID:string,CATEGORY_NAME:string", "CATEGORY", levels)
        df = spark.read.format("xml").option("rowTag", root_tag).schema(f"CATEGORY array<{node}>").load(path)
        return df.select(F.explode("CATEGORY").alias("node"))

    levels = _depth(read, "CATEGORY")
    nodes = _levels(read(levels), "CATEGORY", levels, lambda n: n["CATEGORY_ID"], lambda n: tx.trim_ws(n["CATEGORY_NAME"]))
    return tree_paths(nodes).filter("is_leaf").drop("is_leaf")


def read_nested_json(spark: SparkSession, path: str) -> DataFrame:
    """Nested ``children``, as deep as the file goes; a node's categoryText replaces its path; nodes
    without id are skipped, their children are kept."""
    def read(levels: int) -> DataFrame:
        node = _nested("id:string,name:string,categoryText:string", "children", levels)
        df = spark.read.option("multiLine", True).schema(StructType.fromDDL(node)).json(path)
        return df.select(F.struct(*df.columns).alias("node"))

    levels = _depth(read, "children")
    nodes = _levels(read(levels), "children", levels, lambda n: n["id"],
                    lambda n: n["name"], lambda n: F.nullif(tx.text(n["categoryText"]), F.lit("")))
    return tree_paths(nodes).filter(~c("id").startswith("~")).drop("is_leaf")
