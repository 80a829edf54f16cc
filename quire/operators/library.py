"""A device's library: a folder tree as an adjacency list (id, parent, name, kind, file_type)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.sources.tables import shared_folder, written


def is_notebook() -> Column:
    return (F.col("kind") == "document") & F.coalesce(F.col("file_type"), F.lit("")).isin("", "notebook")


def is_deleted() -> Column:
    return F.col("parent").eqNullSafe("trash")


def opens() -> Column:
    return (F.col("kind") == "folder") & ~is_deleted()


def walk(items: DataFrame, root: str = "") -> DataFrame:
    """(id, depth, path) of what can be reached from the root over folders that aren't deleted, at any depth.

    Each folder's path is doubled until it begins at the root, so rounds grow with the logarithm of the depth. Where
    ids of folders repeat, the walk goes level by level instead, as a folder is opened where it is met first.
    """
    folder = shared_folder(items.sparkSession, "walk")
    folders = written(items.where(opens()).select("id", "parent", "name"), f"{folder}/folders")
    if not folders.groupBy("id").count().where((F.col("count") > 1) | (F.col("id") == root)).isEmpty():
        return walk_by_level(items, root)
    above = folder_paths(folders, root, folder)
    top = items.where(F.col("parent") == root).select("id", F.lit(0).alias("depth"), F.col("name").alias("path"))
    below = items.join(above.select(F.col("id").alias("parent"), F.col("depth"), F.col("path").alias("above")), "parent")
    return top.unionByName(below.select("id", F.col("depth"), F.concat("above", F.lit("/"), "name").alias("path")))


def folder_paths(folders: DataFrame, root: str, folder: str, shallow: int = 4) -> DataFrame:
    """(id, depth, path) of folders (id, parent, name), whose ids are unique, below the root; depth counts from 1.

    Folders in a cycle, or below one, never lead to the root. Where paths go on after ``shallow`` rounds it is found out first,
    by ids alone, which folders lead there at all, so that no path of a cycle grows longer than that.
    """
    total = folders.count()
    start = folders.select("id", F.col("parent").alias("top"), F.lit(1).alias("depth"), F.col("name").alias("path"))
    chains, steps = doubled(start, root, shallow, f"{folder}/paths")
    if steps == shallow and not chains.where(F.col("top") != root).isEmpty():
        rounds = (2 * total).bit_length()  # as many steps as there are folders, and more
        reached, _ = doubled(chains.drop("path"), root, rounds, f"{folder}/reached")
        chains, _ = doubled(chains.join(reached.where(F.col("top") == root).select("id"), "id", "left_semi"), root, rounds, f"{folder}/far-paths")
    return chains.where(F.col("top") == root).drop("top")


def doubled(chains: DataFrame, root: str, rounds: int, folder: str) -> tuple[DataFrame, int]:
    """``chains`` (id, top, depth, path if any) led towards the root, and the rounds that it took; each round joins a chain with
    that of its top, until all are done or so many rounds were made."""
    has_path = "path" in chains.columns
    chains = written(chains, f"{folder}-0")
    for step in range(rounds):
        if chains.where(F.col("top") != root).isEmpty():
            return chains, step
        more = chains.select(F.col("id").alias("top"), F.col("top").alias("_top"), F.col("depth").alias("_depth"), *([F.col("path").alias("_path")] if has_path else []))
        going = chains.where(F.col("top") != root).join(more, "top")  # a chain whose top is no open folder ends here
        path = [F.concat("_path", F.lit("/"), "path").alias("path")] if has_path else []
        led = going.select("id", F.col("_top").alias("top"), (F.col("depth") + F.col("_depth")).alias("depth"), *path)
        chains = written(chains.where(F.col("top") == root).unionByName(led), f"{folder}-{step + 1}")
    return chains, rounds


def walk_by_level(items: DataFrame, root: str = "") -> DataFrame:
    """The same, level by level, each a join on the parent that is written as a table once. A folder is opened where it is
    met first, so the walk ends also where ids repeat in a cycle."""
    folder = shared_folder(items.sparkSession, "walk")
    level = items.where(F.col("parent") == root).select("id", F.lit(0).alias("depth"), F.col("name").alias("path"), opens().alias("open"))
    paths = [f"{folder}/0"]
    level, opened = written(level, paths[0]), None
    while True:
        parents = level.where("open").groupBy(F.col("id").alias("parent")).agg(F.min("path").alias("above"))
        if opened is not None:
            parents = parents.join(opened, "parent", "left_anti")
        parents = written(parents, f"{folder}/opened-{len(paths)}")
        if parents.isEmpty():
            return items.sparkSession.read.schema(level.schema).parquet(*paths).drop("open")
        opened = items.sparkSession.read.schema(parents.schema).parquet(*[f"{folder}/opened-{k}" for k in range(1, len(paths) + 1)]).select("parent")
        below = items.join(parents, "parent").select("id", F.lit(len(paths)).alias("depth"), F.concat("above", F.lit("/"), "name").alias("path"), opens().alias("open"))
        paths.append(f"{folder}/{len(paths)}")
        level = written(below, paths[-1])


def sorted_rank(items: DataFrame, group: Column) -> DataFrame:
    """(id, name, rank): documents that aren't deleted, notebooks first, then by lower-cased name; ranked in a group."""
    from pyspark.sql import Window

    shown = items.where((F.col("kind") == "document") & ~is_deleted()).withColumn("_group", group)
    order = Window.partitionBy("_group").orderBy(F.desc(is_notebook()), F.lower("name"), "id")
    return shown.select("id", "name", F.col("_group").alias("shelf"), is_notebook().alias("notebook"), F.row_number().over(order).alias("rank"))
