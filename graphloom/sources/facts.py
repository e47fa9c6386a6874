"""Files to fact rows: one nested record a file, read by executors; a file that fails does not stop the others."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from graphloom.schema import FILES
from graphloom.sources import brace_facts, python_facts

#: Readers by language; files of a language without one get an empty record.
READERS = {"python": python_facts.read} | {name: brace_facts.reader(name) for name in ("javascript", "typescript", "tsx", "go", "rust")}


def extract(files: DataFrame) -> DataFrame:
    """Records of ``files`` (path, language, content, content_hash)."""

    def run(frames):
        for frame in frames:
            rows = []
            for path, language, content, digest in frame[["path", "language", "content", "content_hash"]].itertuples(index=False):
                record = READERS[language](content) if language in READERS and content is not None else python_facts.EMPTY | {"has_parse_errors": content is None}
                rows.append({"path": path, "language": language or "javascript", "content_hash": digest} | record)
            yield pd.DataFrame(rows, columns=["path", "language", "has_parse_errors", "content_hash", "functions", "classes", "imports", "exports", "calls", "references", "complexity"])

    return files.mapInPandas(run, " ".join(FILES.split()))
