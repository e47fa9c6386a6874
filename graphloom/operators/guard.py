"""Allowlists from the graph, and a static gate for what code asks for. Nothing is ever executed; in doubt the answer is no."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.reach import scope_seeds
from graphloom.schema import AMBIGUOUS, RESOLVED

# Builtin modules and the resource that some of them give.
NETWORK = ("http", "https", "net", "dgram", "dns", "tls")
BUILTINS = (
    "assert", "async_hooks", "buffer", "child_process", "cluster", "console", "constants", "crypto", "dgram", "diagnostics_channel", "dns", "domain",
    "events", "fs", "http", "http2", "https", "inspector", "module", "net", "os", "path", "perf_hooks", "process", "punycode", "querystring",
    "readline", "repl", "stream", "string_decoder", "sys", "timers", "tls", "trace_events", "tty", "url", "util", "v8", "vm", "wasi", "worker_threads", "zlib",
)


def module_base(specifier: Column) -> Column:
    return F.substring_index(F.regexp_replace(specifier, "^node:", ""), "/", 1)


def category(specifier: Column) -> Column:
    """The resource that a builtin module gives; null for none."""
    base = module_base(specifier)
    return F.when(base == "fs", "filesystem").when(base == "child_process", "subprocess").when(base.isin(*NETWORK), "network")


def classify(specifier: Column) -> Column:
    return F.when(specifier.startswith(".") | specifier.startswith("/"), "relative").when(module_base(specifier).isin(*BUILTINS), "builtin").otherwise("package")


def allowlist(edges: DataFrame, scopes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(symbols, files, unresolved) of each scope: what its seeds define, call, import or inherit; a scope that is no container doesn't grant itself."""
    seeds = scope_seeds(edges, scopes)
    used = edges.join(seeds.select("scope", F.col("id").alias("src")), "src")
    targets = used.filter((F.col("confidence") == RESOLVED) & F.col("type").isin("calls", "imports", "inherits")).select("scope", F.col("dst").alias("id"), F.col("type").alias("via"))
    defined = seeds.filter("id != scope").select("scope", "id", F.lit("defines").alias("via"))
    every = targets.unionByName(defined)
    rank = F.when(F.col("via") == "defines", 0).when(F.col("via") == "calls", 1).when(F.col("via") == "imports", 2).otherwise(3)
    symbols = every.groupBy("scope", "id").agg(F.max_by("via", rank).alias("via"))
    inner = F.regexp_extract("id", r"^(?:f|fn|cls|m):([^#]*)", 1)
    files = symbols.select("scope", inner.alias("path")).filter("path != ''").distinct()
    unresolved = used.filter(F.col("confidence") == AMBIGUOUS).select("scope", "src", "callee_text", "line").distinct()
    return symbols, files, unresolved


def derived_grants(edges: DataFrame, scopes: DataFrame) -> DataFrame:
    """(scope, category, module): resources of builtin modules that the scopes' seeds import."""
    seeds = scope_seeds(edges, scopes)
    imports = edges.filter((F.col("type") == "imports") & (F.col("confidence") == RESOLVED) & F.col("dst").startswith("xm:"))
    used = imports.join(seeds.select("scope", F.col("id").alias("src")), "src").select("scope", F.expr("substring(dst, 4)").alias("module"))
    return used.withColumn("category", category(F.col("module"))).filter("category is not null").select("scope", "category", "module").distinct()


def module_breaches(wanted: DataFrame, files: DataFrame, grants: DataFrame, externals: DataFrame) -> DataFrame:
    """(specifier, line, kind, area) of ``wanted`` (specifier, line) that is not allowed.

    files (path), grants (category) and externals (module) are what is allowed.
    A relative path is tried as it is, as TypeScript, with each suffix, and by
    its last segment; one that climbs can't be verified.
    """
    rows = wanted.withColumns({"class": classify(F.col("specifier")), "category": category(F.col("specifier")), "stem": F.regexp_replace("specifier", r"^\.?/", "")})
    tries = F.array(F.col("stem"), F.regexp_replace("stem", r"\.js$", ".ts"), *[F.concat("stem", F.lit(s)) for s in (".js", ".ts", ".py")])
    hits = rows.filter(F.col("class") == "relative").select("specifier", "line", F.explode(tries).alias("path"))
    allowed_as = files.select("path").union(files.select(F.substring_index("path", "/", -1)))
    allowed = hits.join(allowed_as, "path", "left_semi").select("specifier", "line").distinct().withColumn("file_ok", F.lit(True))
    rows = rows.join(allowed, ["specifier", "line"], "left").join(grants.select("category").distinct().withColumn("granted", F.lit(True)), "category", "left")
    rows = rows.join(externals.select(F.col("module").alias("specifier")).distinct().withColumn("known", F.lit(True)), "specifier", "left")
    kind = (
        F.when(F.col("specifier").isNull(), "unverifiable-import")
        .when((F.col("class") == "relative") & F.contains("specifier", F.lit("../")), "unverifiable-import")
        .when((F.col("class") == "relative") & F.col("file_ok").isNull(), "disallowed-import")
        .when((F.col("class") == "builtin") & F.col("category").isNull(), "disallowed-import")
        .when((F.col("class") == "builtin") & F.col("granted").isNull(), "ungranted-resource")
        .when((F.col("class") == "package") & F.col("known").isNull(), "disallowed-import")
    )
    area = F.when(F.col("class") == "relative", "files").when(kind == "ungranted-resource", F.concat(F.lit("resources."), "category")).when(F.col("class") == "package", "symbols")
    return rows.select("specifier", "line", kind.alias("kind"), area.alias("area")).filter("kind is not null")


def static_gate(spark, code: str, files: DataFrame, symbols: DataFrame, grants: DataFrame, categories: DataFrame) -> DataFrame:
    """(line, kind, area, attempted) of everything a JavaScript snippet asks for and is not allowed, by line; none: it may run.

    files (path), symbols (name, and module where a package gives it), grants
    as ``sources.resources`` loads them, categories (category). Nothing is run
    here; an address needs a network grant, and what can't be read is refused.
    """
    from graphloom.sources import resources
    from graphloom.sources.snippet_facts import scan

    found = scan(code)
    if found["failed_line"] is not None:
        return spark.createDataFrame([(found["failed_line"], "parse-failure", None, code.split("\n")[found["failed_line"] - 1].strip())], "line int, kind string, area string, attempted string")
    rows = lambda items, ddl: spark.createDataFrame([tuple(x.values())[: ddl.count(",") + 1] for x in items], ddl)
    imports = module_breaches(rows(found["imports"], "specifier string, line int"), files, categories, symbols.filter("module is not null").select("module"))
    told = imports.select("line", "kind", "area", F.coalesce("specifier", F.lit("a module that is not written out")).alias("attempted"))
    env = resources.ungranted_env(rows(found["env"], "name string, mode string, line int"), grants)
    told = told.unionByName(env.select("line", F.lit("ungranted-resource").alias("kind"), F.lit("resources.environment").alias("area"), F.concat_ws(" ", "mode", F.coalesce("name", F.lit("a computed variable"))).alias("attempted")))
    urls = resources.ungranted_urls(rows(found["urls"], "url string, line int"), grants)
    told = told.unionByName(urls.select("line", F.lit("ungranted-resource").alias("kind"), F.lit("resources.network").alias("area"), F.coalesce("url", F.lit("an address that is not written out")).alias("attempted")))
    names = rows(found["names"], "name string, line int").join(symbols.select("name"), "name", "left_anti")
    return told.unionByName(names.select("line", F.lit("unknown-reference").alias("kind"), F.lit("symbols").alias("area"), F.col("name").alias("attempted"))).orderBy("line", "kind", "attempted")
