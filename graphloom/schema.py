"""The property graph's columns, closed domains, ids, and the rule that every edge keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE_TYPES = ("file", "function", "class", "method", "module")
EDGE_TYPES = ("imports", "defines", "calls", "inherits", "references")
RESOLVED, AMBIGUOUS = "resolved", "ambiguous"
DEPENDENCY = ("calls", "imports", "inherits")  # what carries a dependence

NODES = "id string, type string, name string, path string, start_line int, end_line int, external boolean, exported boolean, language string"
EDGES = "src string, dst string, type string, line int, callee_text string, confidence string"
COMMITS = "seq long, ts timestamp, date_iso string, path string"
FILES = """
    path string, language string, has_parse_errors boolean, content_hash string,
    functions array<struct<name:string,start_line:int,end_line:int,exported:boolean>>,
    classes array<struct<name:string,start_line:int,end_line:int,exported:boolean,methods:array<struct<name:string,start_line:int,end_line:int>>,extends:array<string>>>,
    imports array<struct<specifier:string,default_import:string,namespace_import:string,named_imports:array<string>,line:int>>,
    exports array<struct<kind:string,names:array<string>,line:int>>,
    calls array<struct<kind:string,object:string,name:string,line:int,container:string>>,
    references array<struct<name:string,line:int,container:string>>,
    complexity array<struct<name:string,start_line:int,end_line:int,complexity:int>>
"""


def file_id(path: Column) -> Column:
    return F.concat(F.lit("f:"), path)


def function_id(path: Column, name: Column) -> Column:
    return F.concat(F.lit("fn:"), path, F.lit("#"), name)


def class_id(path: Column, name: Column) -> Column:
    return F.concat(F.lit("cls:"), path, F.lit("#"), name)


def method_id(path: Column, owner: Column, name: Column) -> Column:
    return F.concat(F.lit("m:"), path, F.lit("#"), owner, F.lit("."), name)


def module_id(specifier: Column) -> Column:
    return F.concat(F.lit("xm:"), specifier)


def broken(edges: DataFrame) -> DataFrame:
    """Edges against the rule: resolved exactly if there is a target, and unresolved ones keep their text."""
    resolved = F.col("confidence") == RESOLVED
    return edges.filter(~F.coalesce(F.when(resolved, F.col("dst").isNotNull()).otherwise(F.col("dst").isNull()), F.lit(False)))


def guarded(edges: DataFrame) -> DataFrame:
    """``edges``, failing the job that reads one against the rule."""
    resolved = F.col("confidence") == RESOLVED
    sound = F.coalesce(F.when(resolved, F.col("dst").isNotNull()).otherwise(F.col("dst").isNull()), F.lit(False))
    return edges.withColumn("confidence", F.when(sound, F.col("confidence")).otherwise(F.raise_error(F.concat(F.lit("edge breaks the confidence rule: "), F.coalesce("src", F.lit("?"))))))
