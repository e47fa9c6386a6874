"""Commit history as rows (seq, ts, date_iso, path): a Python data source whose partitions are ranges of commits.

The driver counts commits; each task reads the log of its own range, line by
line, so no task and not the driver holds the whole log. The work tree must be
where executors see it.
"""

from __future__ import annotations

import subprocess

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from graphloom.functions.ship import ship

RANGE = 2_000  # commits of a partition
MARK = "\x01"


def parse(lines: Iterable[str], prefix: str = "", first: int = 0) -> Iterator[tuple[int, str, str]]:
    """(seq, date, path) of a log of marked author dates and names below them; renames aren't followed."""
    seq, date = first - 1, ""
    for line in lines:
        if line.startswith(MARK):
            seq, date = seq + 1, line[1:].strip()
        elif line.strip():
            path = line.strip().strip('"').replace("\\", "/")
            if path.startswith(prefix):
                yield seq, date, path[len(prefix) :]


def _git(repo: str, *args: str) -> str | None:
    done = subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True, errors="replace")
    return done.stdout.strip() if done.returncode == 0 else None


class Range(InputPartition):
    def __init__(self, first: int, prefix: str):
        self.first, self.prefix = first, prefix


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.repo, self.step, self.head = options["path"], int(options.get("range", RANGE)), options["head"]

    def partitions(self):
        if not self.head:
            return []
        n, prefix = int(_git(self.repo, "rev-list", "--count", self.head, "--", ".") or 0), _git(self.repo, "rev-parse", "--show-prefix") or ""
        return [Range(k, prefix) for k in range(0, n, self.step)]

    def read(self, part: Range | None):
        if part is None:
            return
        args = ["git", "-C", self.repo, "log", self.head, f"--skip={part.first}", f"--max-count={self.step}", f"--pretty=format:{MARK}%aI", "--name-only", "--", "."]
        with subprocess.Popen(args, stdout=subprocess.PIPE, text=True, errors="replace") as log:
            yield from parse(log.stdout, part.prefix, part.first)
        if log.returncode:
            raise RuntimeError(f"git log of {self.repo} failed")


class History(DataSource):
    """``spark.read.format("gitlog").option("head", commit).load(repo)``."""

    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return "seq long, date_iso string, path string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def commits(spark: SparkSession, repo: str, step: int = RANGE) -> DataFrame:
    """History of the work tree at ``repo``, as it is now; none if it is no work tree. Times are the authors'."""
    ship(spark)
    spark.dataSource.register(History)
    found = spark.read.format("gitlog").option("range", str(step)).option("head", _git(repo, "rev-parse", "HEAD") or "").load(repo)
    return found.select("seq", F.to_timestamp("date_iso").alias("ts"), "date_iso", "path")
