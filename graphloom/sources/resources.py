"""Resource grants from a JSON file: strict validation on the driver, then rows."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Categories with their fields; a field's rule, and whether it may be missing.
CATEGORIES = ("filesystem", "network", "environment", "subprocess")
ACCESS = ("read", "write")
PROTOCOLS = ("http", "https", "tcp", "udp")
FIELDS = {
    "filesystem": {"path": ("text", False), "access": (("some", ACCESS), False)},
    "network": {"host": ("text", False), "port": ("port", True), "protocols": (("some", PROTOCOLS), True)},
    "environment": {"name": ("text", False), "access": (("one", ACCESS), False)},
    "subprocess": {"commands": ("texts", False)},
    "categoryLevel": {"category": (("one", CATEGORIES), False), "viaModule": ("text", False), "origin": (("one", ("graph-import", "config")), True)},
}
GRANT = "scope string, area string, path string, host string, port int, protocols array<string>, name string, access array<string>, commands array<string>, category string, via_module string, origin string"


def _value(rule, value, where: str):
    if rule == "text":
        if not isinstance(value, str) or not value:
            raise ValueError(f"{where} must be a text that is not empty")
        return value
    if rule == "port":
        if not isinstance(value, int) or isinstance(value, bool) or not 1 <= value <= 65535:
            raise ValueError(f"{where} must be a port, 1 to 65535")
        return value
    if rule == "texts":
        if not isinstance(value, list) or not value:
            raise ValueError(f"{where} must list at least one text; an empty list would mean any")
        return [_value("text", v, f"{where}[{i}]") for i, v in enumerate(value)]
    how, allowed = rule
    if how == "one":
        if value not in allowed:
            raise ValueError(f"{where} must be one of {', '.join(allowed)}")
        return value
    if not isinstance(value, list) or not value:
        raise ValueError(f"{where} must be a list that is not empty")
    return list(dict.fromkeys(_value(("one", allowed), v, f"{where}[{i}]") for i, v in enumerate(value)))


def validate(grants: dict, where: str = "resources") -> dict[str, list[dict]]:
    """Grants by area, checked field by field; anything unknown is an error."""
    if not isinstance(grants, dict):
        raise ValueError(f"{where} must be an object")
    out: dict[str, list[dict]] = {area: [] for area in FIELDS}
    for area, entries in grants.items():
        if area not in FIELDS:
            raise ValueError(f"{where}: unknown field {area}")
        if not isinstance(entries, list):
            raise ValueError(f"{where}.{area} must be a list")
        for i, entry in enumerate(entries):
            at = f"{where}.{area}[{i}]"
            if not isinstance(entry, dict):
                raise ValueError(f"{at} must be an object")
            if unknown := set(entry) - set(FIELDS[area]):
                raise ValueError(f"{at}: unknown field {min(unknown)}")
            row = {}
            for field, (rule, optional) in FIELDS[area].items():
                if field in entry or not optional:
                    row[field] = _value(rule, entry.get(field), f"{at}.{field}")
            if area == "filesystem":
                row["access"].sort()
            if area == "categoryLevel":
                row.setdefault("origin", "config")
            out[area].append(row)
    return out


def load(spark: SparkSession, text: str) -> DataFrame:
    """Rows of all scopes' grants in a configuration ``{"scopes": {id: grants}}``."""
    raw = json.loads(text)
    if not isinstance(raw, dict) or set(raw) != {"scopes"} or not isinstance(raw["scopes"], dict):
        raise ValueError("a configuration is an object with scopes alone")
    rows = []
    for scope, grants in raw["scopes"].items():
        for area, entries in validate(grants, f"scopes.{scope}").items():
            for e in entries:
                access = e.get("access")
                rows.append((scope, area, e.get("path"), e.get("host"), e.get("port"), e.get("protocols"), e.get("name"), [access] if isinstance(access, str) else access, e.get("commands"), e.get("category"), e.get("viaModule"), e.get("origin")))
    return spark.createDataFrame(rows, GRANT)


def given(spark: SparkSession, scope: str, inline: dict | None = None, config: str | None = None) -> DataFrame:
    """Grants of one scope, told either in place or by a configuration, not both; a scope that isn't told has none."""
    if inline is not None and config is not None:
        raise ValueError("give grants in place or a configuration, not both")
    if inline is not None:
        return load(spark, json.dumps({"scopes": {scope: inline}}))
    return load(spark, config if config is not None else '{"scopes": {}}').filter(F.col("scope") == scope)


def merged(given: DataFrame, derived: DataFrame) -> DataFrame:
    """Given category grants, and those derived from the graph whose (scope, category, module) isn't given."""
    own = given.filter("area = 'categoryLevel'").select("scope", "category", F.col("via_module").alias("module"), "origin")
    new = derived.join(own, ["scope", "category", "module"], "left_anti").select("scope", "category", "module", F.lit("graph-import").alias("origin"))
    return own.unionByName(new)


def _port(url: Column) -> Column:
    scheme, told = F.parse_url(url, F.lit("PROTOCOL")), F.regexp_extract(F.parse_url(url, F.lit("AUTHORITY")), r":(\d+)$", 1)
    return F.coalesce(F.nullif(told, F.lit("")).cast("int"), F.when(scheme == "https", 443).when(scheme == "http", 80))


def ungranted_urls(wanted: DataFrame, grants: DataFrame) -> DataFrame:
    """Rows of ``wanted`` (url, line) that no network grant covers: host, port if told, protocol if told."""
    asked = wanted.withColumns({"host": F.try_parse_url("url", F.lit("HOST")), "scheme": F.try_parse_url("url", F.lit("PROTOCOL"))}).withColumn("port", F.when(F.col("host").isNotNull(), _port(F.col("url"))))
    net = grants.filter("area = 'network'").select(F.col("host").alias("h"), F.col("port").alias("p"), F.col("protocols").alias("ps"))
    fits = (F.col("host") == F.col("h")) & (F.col("p").isNull() | (F.col("p") == F.col("port"))) & (F.col("ps").isNull() | F.array_contains("ps", F.col("scheme")))
    return asked.join(net, fits, "left_anti").select("url", "line")


def ungranted_env(wanted: DataFrame, grants: DataFrame) -> DataFrame:
    """Rows of ``wanted`` (name, mode, line) without an environment grant of that name and mode."""
    env = grants.filter("area = 'environment'").select("name", F.element_at("access", 1).alias("mode"))
    return wanted.join(env, ["name", "mode"], "left_anti")
