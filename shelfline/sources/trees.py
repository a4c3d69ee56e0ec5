"""Folder trees written in two phases: Spark's writers stage files beside them, and renames put these in place.

Works on any file system Spark can write to. What moves through the driver are names, one for each target.
"""

from __future__ import annotations

import uuid
from pyspark.sql import SparkSession

#: How Spark names the folder of a missing value.
NO_NAME = "__HIVE_DEFAULT_PARTITION__"


class Tree:
    """A folder and what lies in it."""

    def __init__(self, spark: SparkSession, root: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._names = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        self.root = root.rstrip("/")
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, *parts: str):
        place = self._path(self.root)
        for p in parts:
            place = self._path(place, p)
        return place

    def exists(self, *parts: str) -> bool:
        return self._fs.exists(self.at(*parts))

    def find(self, pattern: str) -> list[str]:
        """Places that match, relative to the root, in order."""
        top = self._fs.makeQualified(self._path(self.root)).toString().rstrip("/") + "/"
        found = self._fs.globStatus(self._path(f"{self.root}/{pattern}")) or []
        return sorted(self._fs.makeQualified(s.getPath()).toString().removeprefix(top) for s in found)

    def move(self, source: tuple[str, ...], target: tuple[str, ...]) -> None:
        self._fs.mkdirs(self.at(*target).getParent())
        if not self._fs.rename(self.at(*source), self.at(*target)):
            raise OSError(f"cannot move {'/'.join(source)} to {'/'.join(target)} in {self.root}")

    def remove(self, *parts: str) -> None:
        self._fs.delete(self.at(*parts), True)

    def claim(self, *parts: str) -> None:
        """Make a file that nobody else has made; an existing one is an error."""
        self._fs.create(self.at(*parts), False).close()

    def value_of(self, folder: str) -> str:
        """The value in the name of a partition folder."""
        return self._names.unescapePathName(folder.split("=", 1)[1])


def check_name(name: str | None) -> str:
    """A category that names a folder of its own; others cannot be written as files."""
    if not name or name[0] in "._" or any(c in name for c in "/\\:*?[]{}"):
        raise ValueError(f"no folder can be named {name!r}")
    return name


def staging() -> str:
    """A folder name that readers pass over."""
    return f".staging-{uuid.uuid4().hex}"


def place_all(tree: Tree, moves: dict[tuple[str, ...], tuple[str, ...]]) -> None:
    """Move staged places to their targets, all or none of which must be free.

    Every target is claimed first, so of two writers one is refused before anything is moved; each move is one
    rename. Raises `FileExistsError` for a target that is there or claimed. A failure in between takes back what was moved.
    """
    claims: list[tuple[str, ...]] = []
    done: list[tuple[str, ...]] = []
    try:
        for target in moves.values():
            claim = (*target[:-1], f".{target[-1]}.claim")
            try:
                tree.claim(*claim)
            except Exception as e:
                raise FileExistsError("/".join(target)) from e
            claims.append(claim)
            if tree.exists(*target):
                raise FileExistsError("/".join(target))
        for source, target in moves.items():
            tree.move(source, target)
            done.append(target)
    except BaseException:
        for target in done:
            tree.remove(*target)
        raise
    finally:
        for claim in claims:
            tree.remove(*claim)
