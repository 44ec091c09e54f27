"""Directory trees as (path, parent, name, kind, size): resolve, list, walk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import rank


def split_path(path: Column) -> Column:
    """The parts of a path; empty ones don't count."""
    return F.filter(F.split(path, "/"), lambda x: x != "")


def resolve(paths: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """(path, kind, size) of paths that exist, walked part by part through directories.

    A part under a file or a missing part ends the walk without a row.
    """
    walk = paths.select("path", split_path(F.col("path")).alias("parts"), F.lit("/").alias("here"), F.lit("dir").alias("kind"), F.lit(0).cast("long").alias("size"))
    step = nodes.select(F.col("parent").alias("here"), F.col("name").alias("part"), F.col("path").alias("next"), F.col("kind").alias("k"), F.col("size").alias("s"))
    done = walk.where(F.size("parts") == 0).select("path", "kind", "size")
    for i in range(depth):
        open_ = walk.where((F.size("parts") > i) & (F.col("kind") == "dir")).withColumn("part", F.get("parts", F.lit(i)))
        walk = open_.join(step, ["here", "part"]).select("path", "parts", F.col("next").alias("here"), F.col("k").alias("kind"), F.col("s").alias("size"))
        done = done.union(walk.where(F.size("parts") == i + 1).select("path", "kind", "size"))
    return done


def listing(nodes: DataFrame, parent: str) -> DataFrame:
    """One directory in name order."""
    return rank(nodes.where(F.col("parent") == parent), "name").select("name", "kind", "size", "pos")


def tree(nodes: DataFrame) -> DataFrame:
    """Depth-first order: parts compare one by one, so a separator sorts before all letters."""
    keyed = nodes.withColumn("_key", F.replace("path", F.lit("/"), F.lit("\x01"))).withColumn("depth", F.size(split_path(F.col("path"))))
    return rank(keyed, "_key").select("path", "kind", "depth", "pos")


def empty_dirs(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'dir'").join(nodes.select(F.col("parent").alias("path")), "path", "left_anti")


# Changes of files and directories: rows of (path, parent, name, kind, size, content), where a
# directory has no content. A batch that breaks a rule shows in ``faults`` and changes nothing.


def _made(paths: DataFrame, kind: str) -> DataFrame:
    name = F.substring_index("path", "/", -1)
    parent = F.expr("substr(path, 1, length(path) - length(substring_index(path, '/', -1)) - 1)")
    empty = F.lit(bytearray()) if kind == "file" else F.lit(None)
    return paths.select("path", F.when(parent == "", "/").otherwise(parent).alias("parent"), name.alias("name"), F.lit(kind).alias("kind"), F.lit(0).cast("long").alias("size"), empty.cast("binary").alias("content"))


def make(nodes: DataFrame, paths: DataFrame, kind: str) -> DataFrame:
    """Directories, or empty files, that can be made are: see ``faults``."""
    bad = faults(nodes, paths)
    good = paths.join(bad.select("path"), "path", "left_anti")
    return nodes.select("path", "parent", "name", "kind", "size", "content").unionByName(_made(good, kind))


def faults(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, fault): what keeps new paths from being made."""
    asked = _made(paths, "dir").select("path", "parent")
    held = nodes.select("path", F.col("kind").alias("held"))
    above = nodes.select(F.col("path").alias("parent"), F.col("kind").alias("above"))
    found = asked.join(held, "path", "left").join(above, "parent", "left")
    top = F.col("parent") == "/"
    fault = F.when(F.col("held").isNotNull(), "AlreadyExists").when(~top & F.col("above").isNull(), "NotFound").when(~top & (F.col("above") != "dir"), "NotADirectory")
    return found.select("path", fault.alias("fault")).where("fault is not null")


def write(nodes: DataFrame, contents: DataFrame, append: bool = False) -> DataFrame:
    """Files given as (path, new) get new bytes, or more of them; directories stay as they are."""
    more = F.concat(F.coalesce("content", F.lit(bytearray())), F.col("new")) if append else F.col("new")
    hit = (F.col("kind") == "file") & F.col("new").isNotNull()
    joined = nodes.join(contents.select("path", "new"), "path", "left").withColumn("content", F.when(hit, more).otherwise(F.col("content")))
    return joined.withColumn("size", F.when(hit, F.octet_length("content").cast("long")).otherwise(F.col("size"))).drop("new").select(nodes.columns)


def read(nodes: DataFrame, paths: DataFrame, length: int) -> DataFrame:
    """(path, bytes): the first bytes of files."""
    return nodes.where("kind = 'file'").join(paths.select("path"), "path", "left_semi").select("path", F.substring("content", 1, length).alias("bytes"))


def remove(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Without the files, and the directories that nothing lies in."""
    asked = nodes.join(paths.select("path"), "path", "left_semi")
    full = nodes.select(F.col("parent").alias("path")).distinct()
    gone = asked.where("kind = 'file'").select("path").union(asked.where("kind = 'dir'").join(full, "path", "left_anti").select("path"))
    return nodes.join(gone, "path", "left_anti")
