"""From file records to graph: nodes, defines, imports, inherits, references and calls, as joins.

Whatever is not proven stays ambiguous: no target, and the source text kept.
First-match lookups are candidates with an ordinal, a semi-join, and
``min_by``; nothing runs a row at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.keep import keep
from graphloom.operators.reach import Found
from graphloom.schema import AMBIGUOUS, RESOLVED, class_id, file_id, function_id, guarded, method_id, module_id

JS_SUFFIXES = (".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".mts", ".cts")
JS_LANGUAGES = ("javascript", "typescript", "tsx")


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def symbol_nodes(files: DataFrame) -> DataFrame:
    """One node a file, function, class and method; of equal ids the last in the file's order wins."""
    plain = lambda df, kind, name, x, exported: df.select(F.array(*[F.col(c) for c in ("place", "inner") if c in df.columns]).alias("order"), kind.alias("id"), F.lit(name).alias("type"), F.col(f"{x}.name").alias("name"), "path", F.col(f"{x}.start_line").alias("start_line"), F.col(f"{x}.end_line").alias("end_line"), F.lit(False).alias("external"), exported.alias("exported"), "language")
    file_rows = files.select(F.array(F.lit(-1)).alias("order"), file_id(F.col("path")).alias("id"), F.lit("file").alias("type"), F.col("path").alias("name"), "path", _null("int").alias("start_line"), _null("int").alias("end_line"), F.lit(False).alias("external"), F.lit(False).alias("exported"), "language")
    functions = files.select("path", "language", F.posexplode("functions").alias("place", "f"))
    classes = files.select("path", "language", F.posexplode("classes").alias("place", "c"))
    methods = classes.select("path", "language", "place", F.col("c.name").alias("owner"), F.posexplode("c.methods").alias("inner", "m"))
    rows = (
        file_rows.unionByName(plain(functions, function_id(F.col("path"), F.col("f.name")), "function", "f", F.col("f.exported")))
        .unionByName(plain(classes, class_id(F.col("path"), F.col("c.name")), "class", "c", F.col("c.exported")))
        .unionByName(plain(methods, method_id(F.col("path"), F.col("owner"), F.col("m.name")), "method", "m", F.lit(False)))
    )
    return rows.groupBy("id").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("id", "order")]), "order").alias("n")).select("id", "n.*")


def _edge(df: DataFrame, src: Column, dst: Column, kind: str, line: Column, text: Column | None = None, *more: Column) -> DataFrame:
    known = dst.isNotNull()
    return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), line.cast("int").alias("line"), F.when(known, _null("string")).otherwise(text if text is not None else _null("string")).alias("callee_text"), F.when(known, RESOLVED).otherwise(AMBIGUOUS).alias("confidence"), *more)


def define_edges(files: DataFrame) -> DataFrame:
    functions, classes = files.select("path", F.explode("functions").alias("x")), files.select("path", F.explode("classes").alias("x"))
    methods = classes.select("path", F.col("x.name").alias("owner"), F.explode("x.methods").alias("m"))
    path, here = F.col("path"), file_id(F.col("path"))
    return (
        _edge(functions, here, function_id(path, F.col("x.name")), "defines", F.col("x.start_line"))
        .unionByName(_edge(classes, here, class_id(path, F.col("x.name")), "defines", F.col("x.start_line")))
        .unionByName(_edge(methods, class_id(path, F.col("owner")), method_id(path, F.col("owner"), F.col("m.name")), "defines", F.col("m.start_line")))
    )


def local_names(files: DataFrame) -> DataFrame:
    """(path, name, kind, id, order): 0 functions, 1 classes; 2 methods by bare name.

    order is that in which a file's names are told: functions, then each class
    and its methods. Of a name told again the last counts where kinds don't matter.
    """
    path = F.col("path")
    functions = files.select("path", F.posexplode("functions").alias("place", "x")).select("path", F.col("x.name").alias("name"), F.lit(0).alias("kind"), function_id(path, F.col("x.name")).alias("id"), F.array(F.lit(0), "place", F.lit(0)).alias("order"))
    classes = files.select("path", F.posexplode("classes").alias("place", "x"))
    own = classes.select("path", F.col("x.name").alias("name"), F.lit(1).alias("kind"), class_id(path, F.col("x.name")).alias("id"), F.array(F.lit(1), "place", F.lit(0)).alias("order"))
    methods = classes.select("path", "place", F.col("x.name").alias("owner"), F.posexplode("x.methods").alias("inner", "m"))
    methods = methods.select("path", F.col("m.name").alias("name"), F.lit(2).alias("kind"), method_id(path, F.col("owner"), F.col("m.name")).alias("id"), F.array(F.lit(1), "place", F.col("inner") + 1).alias("order"))
    return functions.unionByName(own).unionByName(methods).groupBy("path", "name", "kind", "id").agg(F.max("order").alias("order"))


def reference_edges(files: DataFrame) -> DataFrame:
    """A file to the symbols of its own that it names without calling, first line each; of a name told again, the last one told."""
    sites = files.select("path", F.explode("references").alias("r")).select("path", F.col("r.name").alias("name"), F.col("r.line").alias("line"))
    last = local_names(files).groupBy("path", "name").agg(F.max_by("id", "order").alias("id"))
    found = sites.join(last, ["path", "name"]).groupBy("path", "id").agg(F.min("line").alias("line"))
    return _edge(found, file_id(F.col("path")), F.col("id"), "references", F.col("line"))


def _normal(path: Column) -> Column:
    """``a/b/../c`` and ``./`` taken out of a path."""
    step = F.aggregate(
        F.split(path, "/"), F.array().cast("array<string>"),
        lambda acc, x: F.when(x.isin("", "."), acc).when((x == "..") & (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), acc), -1) != ".."), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))),
    )
    # a step at a time only where there is something to take out
    return F.when(path.rlike(r"(^|/)[.]{0,2}(/|$)"), F.array_join(step, "/")).otherwise(path)


def _folder() -> Column:
    """The folder that an import (path, specifier) is told from; empty if it is not relative, when it means the same anywhere."""
    return F.when(F.startswith("specifier", F.lit(".")), F.regexp_replace("path", "/?[^/]*$", "")).otherwise("")


def _tries(folder: Column, crate: str | None = None) -> Column:
    """The files that an import (language, specifier) from ``folder`` may mean, in order; see ``import_candidates``."""
    spec = F.col("specifier")
    stem = F.regexp_replace(_normal(F.concat_ws("/", folder, spec)), r"\.(?:js|jsx|mjs|cjs|ts|tsx|mts|cts)$", "")
    js = F.array(*[F.concat(stem, F.lit(s)) for s in JS_SUFFIXES], *[F.concat(_normal(F.concat_ws("/", folder, spec)), F.lit(f"/index{s}")) for s in JS_SUFFIXES])
    dots = F.length(F.regexp_extract(spec, r"^\.+", 0))
    inner = F.replace(F.regexp_replace(spec, r"^\.+", ""), F.lit("."), F.lit("/"))
    climb = F.expr("repeat('../', greatest(length(regexp_extract(specifier, '^[.]+', 0)) - 1, 0))")
    base = F.when(dots > 0, _normal(F.concat_ws("/", folder, F.concat(climb, inner)))).otherwise(inner)
    py = F.array(F.concat(base, F.lit(".py")), _normal(F.concat(base, F.lit("/__init__.py"))))
    rest = F.regexp_replace(spec, f"^(?:crate|{crate or 'crate'})::", "")
    parts = F.split(rest, "::")
    rs = F.flatten(F.transform(F.reverse(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1)))), lambda n: F.transform(F.array(F.lit(".rs"), F.lit("/mod.rs")), lambda s: F.concat(F.lit("src/"), F.array_join(F.slice(parts, F.lit(1), n), "/"), s))))
    return (
        F.when(F.col("language").isin(*JS_LANGUAGES) & (spec.startswith("./") | spec.startswith("../")), js)
        .when(F.col("language") == "python", py)
        .when((F.col("language") == "rust") & (spec.startswith("crate::") | (spec.startswith(f"{crate}::") if crate else F.lit(False))), rs)
    )


def import_candidates(imports: DataFrame, go_module: str | None = None, crate: str | None = None) -> DataFrame:
    """(path, specifier, candidate, ordinal) of ``imports`` (path, language, specifier): files to try, in order.

    JavaScript and TypeScript: relative only, without a known suffix, by each
    suffix, then as a folder's index. Python: dots climb packages; a module,
    then a package. Rust: the crate's own paths, dropping segments from the
    end. Go is by folder, see ``resolve_imports``.
    """
    return imports.select("path", "specifier", F.posexplode(_tries(_folder(), crate)).alias("ordinal", "candidate")).filter(~F.col("candidate").startswith("../"))


def resolve_imports(files: DataFrame, every_path: DataFrame | None = None, go_module: str | None = None, crate: str | None = None) -> DataFrame:
    """(path, specifier, target): the file that each specifier means, null if it is outside the repository.

    What is asked again and again, of any file or of those of a folder, is
    tried once. Only ordinals of candidates are aggregated, which hash
    aggregation takes as they come.
    """
    asks = ["language", "folder", "specifier"]
    tries = _tries(F.col("folder"), crate)
    imports = files.select("path", "language", F.explode("imports").alias("i")).select("path", "language", F.col("i.specifier").alias("specifier")).distinct().withColumn("folder", _folder())
    existing = (every_path if every_path is not None else files.select("path")).select(F.col("path").alias("candidate")).filter(~F.col("candidate").startswith("../")).distinct()
    tried = imports.select(*asks).distinct().select(*asks, F.posexplode(tries).alias("ordinal", "candidate"))
    hits = tried.join(existing, "candidate", "left_semi").groupBy(*asks).agg(F.min("ordinal").alias("ordinal")).select(*asks, F.get(tries, F.col("ordinal")).alias("target"))
    resolved = imports.join(hits, asks, "left")
    if go_module:
        firsts = existing.filter(F.col("candidate").endswith(".go")).groupBy(F.regexp_replace("candidate", "/?[^/]*$", "").alias("folder")).agg(F.min("candidate").alias("first"))
        inside = (F.col("language") == "go") & ((F.col("specifier") == go_module) | F.col("specifier").startswith(go_module + "/"))
        resolved = resolved.withColumn("folder", F.when(inside, F.expr(f"substring(specifier, {len(go_module) + 2})"))).join(firsts, "folder", "left").withColumn("target", F.coalesce("target", "first"))
    return resolved.select("path", "specifier", "target")


def import_edges(files: DataFrame, resolved: DataFrame) -> DataFrame:
    sites = files.select("path", F.explode("imports").alias("i")).select("path", F.col("i.specifier").alias("specifier"), F.col("i.line").alias("line"))
    found = sites.join(resolved, ["path", "specifier"])
    return _edge(found, file_id(F.col("path")), F.coalesce(file_id(F.col("target")), module_id(F.col("specifier"))), "imports", F.col("line"))


def bindings(files: DataFrame, resolved: DataFrame) -> DataFrame:
    """(path, binding, ordinal, specifier, target): what imports bind, in order, once an import."""
    sites = files.select("path", F.posexplode("imports").alias("ordinal", "i"))
    names = F.array_distinct(F.array_compact(F.concat(F.array("i.default_import", "i.namespace_import"), "i.named_imports")))
    each = sites.select("path", "ordinal", F.col("i.specifier").alias("specifier"), F.explode(names).alias("binding"))
    # what is taken out of lists is many times what their files' size tells, so neither side is sent whole
    return each.join(resolved.hint("merge"), ["path", "specifier"]).select("path", "binding", "ordinal", "specifier", "target")


def exported_symbols(files: DataFrame) -> DataFrame:
    """(path, name, id): functions first, then classes, that a file exports under their own name."""
    listed = files.select("path", F.explode("exports").alias("e")).filter("e.kind != 'all'").select("path", F.explode("e.names").alias("name"))
    fn = files.select("path", F.explode("functions").alias("x")).filter("x.exported").select("path", F.col("x.name").alias("name"))
    cl = files.select("path", F.explode("classes").alias("x")).filter("x.exported").select("path", F.col("x.name").alias("name"))
    surface = listed.union(fn).union(cl).distinct()
    return local_names(files).filter("kind < 2").join(surface, ["path", "name"], "left_semi").groupBy("path", "name").agg(F.min_by("id", F.struct("kind", "id")).alias("id"))


def inherit_edges(files: DataFrame, bound: DataFrame, exported: DataFrame) -> DataFrame:
    """Class to base: same file, then bindings in order, then the one class of that name anywhere; else ambiguous.

    Edges, and with them ``place``, the base's position in the class's own list.
    """
    sites = files.select("path", F.explode("classes").alias("c")).select("path", class_id(F.col("path"), F.col("c.name")).alias("src"), F.col("c.start_line").alias("line"), F.posexplode("c.extends").alias("n", "text"))
    sites = sites.withColumns({"head": F.substring_index("text", ".", 1), "plain": ~F.contains("text", F.lit("."))})
    classes = local_names(files).filter("kind = 1").select("path", "name", "id")
    same = sites.join(classes.withColumnRenamed("id", "own"), (sites["path"] == classes["path"]) & (sites["text"] == classes["name"]), "left").select(sites["*"], "own")
    outside = F.when(F.col("target").isNull(), F.concat(F.lit("xc:"), F.col("specifier"), F.lit("#"), F.col("text")))
    links = same.join(bound.select("path", F.col("binding").alias("head"), "ordinal", "specifier", "target"), ["path", "head"], "left")
    internal = exported.select(F.col("path").alias("target"), F.col("name").alias("text"), F.col("id").alias("inside"))
    links = links.join(internal.filter(F.col("inside").startswith("cls:")), ["target", "text"], "left")
    hit = F.when(F.col("specifier").isNotNull(), F.coalesce(outside, F.when(F.col("plain"), F.col("inside"))))
    best = links.groupBy("src", "path", "line", "n", "text", "own").agg(F.min_by(hit, F.when(hit.isNotNull(), F.col("ordinal"))).alias("linked"))
    single = classes.groupBy("name").agg(F.count("*").alias("k"), F.min("id").alias("only")).filter("k = 1").select(F.col("name").alias("text"), "only")
    done = best.join(single, "text", "left").withColumn("dst", F.coalesce("own", "linked", F.when(F.col("only") != F.col("src"), F.col("only"))))
    return _edge(done, F.col("src"), F.col("dst"), "inherits", F.col("line"), F.col("text"), F.col("n").alias("place"))


def ancestors(inherits: DataFrame) -> DataFrame:
    """(src, ancestor, way) over resolved bases inside the repository.

    way is the positions of the bases that lead there: of the shortest ways
    that first in declared order. Ways of equal length compare as arrays, and
    shorter ones come first, which is the order of a search in breadth.
    """
    parents = inherits.filter((F.col("confidence") == RESOLVED) & F.col("dst").startswith("cls:"))
    parents = keep(parents.groupBy(F.col("src").alias("child"), F.col("dst").alias("parent")).agg(F.min("place").alias("place")))
    front = parents.select(F.col("child").alias("src"), F.col("parent").alias("ancestor"), F.array("place").alias("way"))
    found = Found()
    while True:
        front = keep(front.filter("src != ancestor"))
        n = front.count()
        if not n:
            break
        found.add(front, n)
        on = front.join(parents, front["ancestor"] == parents["child"]).select("src", F.col("parent").alias("ancestor"), F.concat("way", F.array("place")).alias("way"))
        front = on.groupBy("src", "ancestor").agg(F.min("way").alias("way")).join(found.all().select("src", "ancestor"), ["src", "ancestor"], "left_anti")
    return found.all() if found.runs else front


def call_edges(files: DataFrame, bound: DataFrame, exported: DataFrame, inherits: DataFrame) -> DataFrame:
    """Calls: local function, binding in order, local class; members by their binding; self, this and super by the class chain."""
    names = local_names(files)
    sites = files.select("path", F.posexplode("calls").alias("n", "c")).select("path", "n", "c.kind", "c.object", F.col("c.name").alias("name"), "c.line", "c.container")
    # the container: a method, else a function, else a class; calls of others are dropped
    owner = F.when(F.contains("container", F.lit(".")), F.substring_index("container", ".", 1)).otherwise(F.col("container"))
    method = F.when(F.contains("container", F.lit(".")), method_id(F.col("path"), F.substring_index("container", ".", 1), F.substring_index("container", ".", -1)))
    heads = names.filter("kind < 2").groupBy("path", F.col("name").alias("container")).agg(F.min_by("id", "kind").alias("head"))
    sites = sites.join(heads, ["path", "container"], "left").withColumn("src", F.coalesce(method, "head")).filter("src is not null").withColumn("owner", class_id(F.col("path"), owner))
    # plain: local function or class
    local = names.filter("kind < 2").groupBy("path", "name").agg(F.min(F.when(F.col("kind") == 0, F.col("id"))).alias("fn"), F.min(F.when(F.col("kind") == 1, F.col("id"))).alias("cls"))
    sites = sites.join(local, ["path", "name"], "left")
    # bindings: external ones end the search
    key = F.when(F.col("kind") == "plain", F.col("name")).when(F.col("kind") == "member", F.col("object"))
    links = sites.select("path", "n", key.alias("binding"), "name").join(bound, ["path", "binding"])
    links = links.join(exported.select(F.col("path").alias("target"), "name", F.col("id").alias("inside")), ["target", "name"], "left")
    hit = F.when(F.col("target").isNull(), F.concat(F.lit("xf:"), F.col("specifier"), F.lit("#"), F.col("name"))).otherwise(F.col("inside"))
    linked = links.withColumn("hit", hit).filter("hit is not null").groupBy("path", "n").agg(F.min_by("hit", F.struct("ordinal", "hit")).alias("linked"))
    # own methods, then those of ancestors, nearest first
    methods = names.filter("kind = 2").select(F.concat(F.lit("cls:"), F.expr("substring(substring_index(id, '.', size(split(id, '[.]')) - 1), 3)")).alias("ancestor"), "name", F.col("id").alias("method"))
    chain = ancestors(inherits).unionByName(sites.select(F.col("owner").alias("src"), F.col("owner").alias("ancestor"), F.array().cast("array<int>").alias("way")).distinct())
    asked = sites.filter("kind in ('self', 'this', 'super')").select("path", "n", "kind", "name", F.col("owner").alias("src"))
    chained = asked.join(chain, "src").filter("kind != 'super' or size(way) > 0").join(methods, ["ancestor", "name"]).groupBy("path", "n").agg(F.min_by("method", F.struct(F.size("way"), "way", "ancestor")).alias("chained"))
    done = sites.join(linked, ["path", "n"], "left").join(chained, ["path", "n"], "left")
    dst = F.when(F.col("kind") == "plain", F.coalesce("fn", "linked", "cls")).when(F.col("kind") == "member", F.col("linked")).otherwise(F.col("chained"))
    return _edge(done, F.col("src"), dst, "calls", F.col("line"), F.concat_ws(".", "object", "name"))


def build_graph(files: DataFrame, every_path: DataFrame | None = None, go_module: str | None = None, crate: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of file records, external stubs and files that only imports know included."""
    resolved = resolve_imports(files, every_path, go_module, crate)
    bound, exported = bindings(files, resolved), exported_symbols(files)
    imports, inherits = import_edges(files, resolved), inherit_edges(files, bound, exported)
    edges = define_edges(files).unionByName(reference_edges(files)).unionByName(imports).unionByName(inherits.drop("place")).unionByName(call_edges(files, bound, exported, inherits))
    nodes = symbol_nodes(files)
    kinds = F.when(F.col("id").startswith("xm:"), "module").when(F.col("id").startswith("xf:"), "function").when(F.col("id").startswith("xc:"), "class").otherwise("file")
    name = F.when(F.col("id").startswith("xm:") | F.col("id").startswith("f:"), F.expr("substring(id, instr(id, ':') + 1)")).otherwise(F.substring_index("id", "#", -1))
    missing = edges.filter("dst is not null").select(F.col("dst").alias("id")).distinct().join(nodes, "id", "left_anti").filter(F.col("id").rlike("^(x[mfc]|f):"))
    importer = imports.join(files.select(file_id(F.col("path")).alias("src"), "language"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("language").alias("importer"))
    stubs = missing.join(importer, "id", "left").select("id", kinds.alias("type"), name.alias("name"), F.when(F.col("id").startswith("f:"), name).alias("path"), _null("int").alias("start_line"), _null("int").alias("end_line"), F.col("id").startswith("x").alias("external"), F.lit(False).alias("exported"), F.when(F.col("id").startswith("f:"), F.col("importer")).alias("language"))
    return nodes.unionByName(stubs), guarded(edges)

