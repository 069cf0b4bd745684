"""Folders of repositories as a table: a data source that lists and reads their files in the tasks."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "repo string, path string, target string, n_bytes long, content binary"


@dataclass
class Branch(InputPartition):
    """What one task reads: the files of one folder, or with ``deep`` all that lies below it."""

    repo: str
    folder: str
    deep: bool


class FolderSource(DataSource):
    """``spark.read.format("repositories").load(folder)``: a row for each file and link of each repository, a subfolder of ``folder``.

    The driver lists repositories and the folders at their top only; the tasks do the rest, one for each of those folders. Paths are relative to the repository, with slashes.
    A link is a row with its ``target`` and no content, and isn't followed. Options: ``alone`` (true: the folder is itself the one
    repository), ``max_bytes`` (larger files come without content). The folder must be mounted where tasks run.
    """

    @classmethod
    def name(cls) -> str:
        return "repositories"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)


class FolderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.alone = options.get("alone", "false").lower() == "true"
        self.max_bytes = int(options.get("max_bytes", -1))

    def base(self, repo: str) -> str:
        return self.root if self.alone else os.path.join(self.root, repo)

    def partitions(self) -> list[Branch]:
        if not os.path.isdir(self.root):
            raise FileNotFoundError(f"{self.root} is no folder")
        repos = [os.path.basename(os.path.abspath(self.root))] if self.alone else sorted(e.name for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False))
        out = []
        for repo in repos:
            out.append(Branch(repo, "", False))
            out += [Branch(repo, e.name, True) for e in sorted(os.scandir(self.base(repo)), key=lambda e: e.name) if e.is_dir(follow_symlinks=False)]
        return out or [Branch("", "", False)]

    def read(self, partition: Branch) -> Iterator[tuple]:
        base = self.base(partition.repo)
        top = os.path.join(base, partition.folder)
        if not partition.repo:
            return
        for folder, below, names in os.walk(top):
            names += [b for b in below if os.path.islink(os.path.join(folder, b))]
            if not partition.deep:
                below.clear()
            for name in sorted(names):
                yield from self.row(partition.repo, base, os.path.join(folder, name))

    def row(self, repo: str, base: str, file: str) -> Iterator[tuple]:
        path = os.path.relpath(file, base).replace(os.sep, "/")
        try:
            info = os.lstat(file)
            if stat.S_ISLNK(info.st_mode):
                yield repo, path, os.readlink(file), None, None
            elif stat.S_ISREG(info.st_mode):
                content = None
                if self.max_bytes < 0 or info.st_size <= self.max_bytes:
                    with open(file, "rb") as f:
                        content = f.read()
                yield repo, path, None, info.st_size, content
        except FileNotFoundError:
            return  # it went away meanwhile


def read(spark: SparkSession, folder: str, **options) -> DataFrame:
    """The files below ``folder``, with ``content`` as text; what is no UTF-8 has the replacement character there."""
    spark.dataSource.register(FolderSource)
    raw = spark.read.format("repositories").options(**{k: str(v) for k, v in options.items()}).load(folder)
    return raw.withColumn("content", F.make_valid_utf8(F.col("content").cast("string")))
