"""Source files of a repository as a DataFrame.

The listing is ours, for Spark's hides names that start with a dot or an
underscore. It is a Python data source: the driver looks at the top folder
only, each folder in it is a partition, and tasks list, read and hash what lies
below, so the repository must be where executors see it. A filter on ``top``
leaves the other folders unlisted. The same source as a stream gives the files
that were modified since the last batch.
"""

from __future__ import annotations

import fnmatch
import os
import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, InputPartition

from graphloom.functions.paths import LANGUAGES, language
from graphloom.functions.ship import ship

# Folders that are never entered.
SKIPPED = (".git", "node_modules", "dist", "build", "out", "coverage", "vendor", "__pycache__", ".venv", "venv")


class Ignore:
    """Rules of one folder's ignore file; the last that matches decides."""

    def __init__(self, text: str):
        self.rules = []
        for line in text.splitlines():
            line = line.rstrip()
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line[keep:]
            folder = line.endswith("/")
            line = line.strip("/") if folder or line.startswith("/") and "/" not in line[1:] else line
            anchored = "/" in line.rstrip("/") or text and line.startswith("/")
            self.rules.append((self._pattern(line.lstrip("/"), anchored), folder, keep))

    @staticmethod
    def _pattern(line: str, anchored: bool) -> re.Pattern:
        out = "" if anchored else "(?:.*/)?"
        i = 0
        while i < len(line):
            if line.startswith("**/", i):
                out, i = out + "(?:.*/)?", i + 3
            elif line.startswith("/**", i) and i + 3 == len(line):
                out, i = out + "/.*", i + 3
            elif line[i] == "*":
                out, i = out + "[^/]*", i + 1
            elif line[i] == "?":
                out, i = out + "[^/]", i + 1
            elif line[i] == "[" and (end := line.find("]", i + 1)) > 0:
                out, i = out + fnmatch.translate(line[i : end + 1])[4:-3].rstrip(")"), end + 1
            else:
                out, i = out + re.escape(line[i]), i + 1
        return re.compile(out)

    def ignores(self, path: str, folder: bool) -> bool:
        hit = False
        for pattern, only_folder, keep in self.rules:
            if (folder or not only_folder) and pattern.fullmatch(path):
                hit = not keep
        return hit


def _scopes(root: str, folder: str) -> list[tuple[str, Ignore]]:
    """The ignore files that speak for what lies in ``folder``, from the root down."""
    out, steps = [], folder.split("/") if folder else []
    for k in range(len(steps) + 1):
        base = "/".join(steps[:k])
        file = os.path.join(root, base, ".gitignore")
        if os.path.isfile(file):
            with open(file, encoding="utf-8", errors="replace") as text:
                out.append((base, Ignore(text.read())))
    return out


def _ignored(scopes: list[tuple[str, Ignore]], path: str, folder: bool) -> bool:
    return any(scope.ignores(path[len(base) + 1 :] if base else path, folder) for base, scope in scopes)


def listed(root: str, folder: str = "", every: bool = False, deep: bool = True):
    """Relative paths of source files in ``folder`` and, if ``deep``, below: no links, no skipped folders, nothing ignored.

    An ignore file speaks for its folder and below; the first scope from the
    root down that ignores a path decides, so a deeper one can't take it back.
    With ``every`` all files are listed, which is what imports are looked up in.
    """
    scopes = [] if every else _scopes(root, folder)
    for entry in os.scandir(os.path.join(root, folder)):
        path = f"{folder}/{entry.name}" if folder else entry.name
        if entry.is_symlink() or _ignored(scopes, path, entry.is_dir()):
            continue
        if entry.is_dir():
            if deep and entry.name not in SKIPPED:
                yield from listed(root, path, every)
        elif entry.is_file() and (every or os.path.splitext(entry.name)[1].lower() in LANGUAGES):
            yield path


def tops(root: str, every: bool = False) -> list[str]:
    """The folders of the top folder that are entered, and "" for its own files."""
    if not os.path.isdir(root):
        raise NotADirectoryError(root)
    scopes = [] if every else _scopes(root, "")
    return ["", *sorted(e.name for e in os.scandir(root) if e.is_dir() and not e.is_symlink() and e.name not in SKIPPED and not _ignored(scopes, e.name, True))]


def walk(root: str, every: bool = False) -> list[str]:
    """All paths of ``listed``, sorted: for small repositories and tests."""
    tops(root, every)
    return sorted(listed(root, "", every))


class Top(InputPartition):
    """A folder of the top folder, and the times between which a file was modified if it counts."""

    def __init__(self, top: str, after: int | None = None, until: int | None = None):
        self.top, self.after, self.until = top, after, until


def _rows(options: dict, part: Top):
    root, every = options["path"], options.get("every") == "true"
    for path in listed(root, part.top, every, deep=part.top != ""):
        if part.until is not None:
            try:
                changed = os.stat(os.path.join(root, path)).st_mtime_ns
            except OSError:
                continue
            if not part.after < changed <= part.until:
                continue
        yield path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.top = options, None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("top",):
                self.top = f.value
            else:
                yield f

    def partitions(self):
        return [Top(t) for t in tops(self.options["path"], self.options.get("every") == "true") if self.top is None or t == self.top]

    def read(self, part: Top):
        for path in _rows(self.options, part):
            content = None
            if self.options.get("names") != "true":
                try:
                    with open(os.path.join(self.options["path"], path), "rb") as file:
                        content = file.read()
                except OSError:
                    pass
            yield part.top, path, content


class _Changes(DataSourceStreamReader):
    """Offsets are times; what was modified after the last and until this one is told. Removed files are not: a build's comparison finds them."""

    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {"at": int(self.options.get("since", "0"))}

    def latestOffset(self) -> dict:
        return {"at": time.time_ns()}

    def partitions(self, start: dict, end: dict):
        return [Top(t, start["at"], end["at"]) for t in tops(self.options["path"])]

    def read(self, part: Top):
        from datetime import UTC, datetime

        for path in _rows(self.options, part):
            yield datetime.fromtimestamp(part.until // 10**9, UTC), self.options["path"], path


class Repository(DataSource):
    """``spark.read.format("repository").load(root)``: top, path, content; ``every``: all files, ``names``: without content. As a stream: ts, root, path."""

    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return "ts timestamp, root string, path string" if self.options.get("changes") == "true" else "top string, path string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Changes(dict(self.options))


def _registered(spark: SparkSession) -> SparkSession:
    ship(spark)
    spark.dataSource.register(Repository)
    if spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") != "true":
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def source_files(spark: SparkSession, root: str, top: str | None = None) -> DataFrame:
    """(path, language, content, content_hash) of a repository's source files, or of those in one folder of its top."""
    tops(root)
    rows = _registered(spark).read.format("repository").load(root)
    rows = rows if top is None else rows.filter(F.col("top") == top)
    return rows.select("path", language(F.col("path")).alias("language"), "content", F.sha2(F.coalesce("content", F.lit(b"")), 256).alias("content_hash"))


def every_path(spark: SparkSession, root: str) -> DataFrame:
    """(path) of all files, which imports are looked up in."""
    return _registered(spark).read.format("repository").option("every", "true").option("names", "true").load(root).select("path")


def changed_files(spark: SparkSession, root: str, since: int = 0) -> DataFrame:
    """A stream of (ts, root, path): source files modified after ``since``, in nanoseconds, as they are."""
    return _registered(spark).readStream.format("repository").option("changes", "true").option("since", str(since)).load(root)
