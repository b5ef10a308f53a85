"""The code index: schemas, name resolution, candidate joins, change sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t

SCHEMAS = {
    "files": "path string, language string, mtime double, hash string",
    "symbols": "id long, qualname string, kind string, file string, line_start int, line_end int, exported int",
    "refs": "id long, from_file string, from_line int, to_name string, to_symbol string, kind string, confidence string",
    "imports": "id long, file string, line int, module string, symbol string, alias string",
    "inherits": "id long, file string, line int, child string, parent string",
    "implements": "id long, file string, line int, symbol string, interface string, confidence string",
    "tests": "id long, test_file string, target_file string, source string",
    "meta": "key string, value string",
    "go_iface_methods": "file string, interface string, method string",
}


def create(spark: SparkSession, rows: dict[str, list[tuple]] | None = None) -> dict[str, DataFrame]:
    """The index tables as views, empty or from rows."""
    made = {}
    for name, ddl in SCHEMAS.items():
        made[name] = spark.createDataFrame((rows or {}).get(name, []), ddl)
        made[name].createOrReplaceTempView(name)
    return made


def unique(candidates: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with exactly one value, and that value."""
    per = candidates.groupBy(key).agg(F.count_distinct(value).alias("n"), F.min(value).alias(value))
    return per.where("n = 1").drop("n")


def cascade(refs: DataFrame, key: str, stages: list[tuple[str, DataFrame, Column | None]]) -> DataFrame:
    """The first stage that resolves a reference, by priority.

    A stage is (name, DataFrame(key, target), stop): where ``stop`` holds for a
    reference that the stage leaves open, later stages aren't asked.
    """
    out = refs.withColumns({"target": F.lit(None).cast("string"), "stage": F.lit(None).cast("string"), "__stop": F.lit(False)})
    for name, found, stop in stages:
        out = out.join(found.select(F.col(found.columns[0]).alias(key), F.col(found.columns[1]).alias("__t")), key, "left")
        hit = F.col("target").isNull() & ~F.col("__stop") & F.col("__t").isNotNull()
        out = out.withColumns({"stage": F.when(hit, F.lit(name)).otherwise(F.col("stage")), "__hit": hit})
        out = out.withColumn("target", F.when(F.col("__hit"), F.col("__t")).otherwise(F.col("target"))).drop("__t", "__hit")
        if stop is not None:
            out = out.withColumn("__stop", F.col("__stop") | (F.col("target").isNull() & F.coalesce(stop, F.lit(False))))
    return out.drop("__stop")


# Fixed value: what a module's relative name may stand for in scripts, in this order.
SCRIPT_ENDS = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js")


def plain_parts(path: Column) -> Column:
    """The path without ``.`` and with ``..`` worked out."""
    step = lambda held, p: F.when(p.isin("", "."), held).when(p == "..", F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0)))).otherwise(F.concat(held, F.array(p)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def module_files(file: Column, module: Column) -> Column:
    """The files that a module's name in a file may mean, the likeliest first; none for other languages.

    Python: beside the file (leading dots go up), then from the root. Scripts: names
    that begin with a dot, with the ends that a loader tries.
    """
    kind = t.family_of(t.language_of(file))
    folder = t.dirname(file)
    dots = F.length(F.regexp_extract(module, r"^\.*", 0))
    rel = F.replace(F.regexp_replace(module, r"^\.+", ""), F.lit("."), F.lit("/"))
    up = F.array_join(F.slice(F.split(folder, "/"), F.lit(1), F.greatest(F.size(F.split(folder, "/")) - F.greatest(dots - 1, F.lit(0)), F.lit(0))), "/")
    near = plain_parts(F.concat(up, F.lit("/"), rel, F.lit(".py")))
    python = F.when(rel != "", F.when(dots > 0, F.array(near)).otherwise(F.array(near, F.concat(rel, F.lit(".py")))))
    base = plain_parts(F.concat(folder, F.lit("/"), module))
    script = F.when(F.startswith(module, F.lit(".")), F.array(*(F.concat(base, F.lit(e)) for e in SCRIPT_ENDS)))
    return F.coalesce(F.when(kind == "python", python).when(kind == "js", script), F.array().cast("array<string>"))


def go_folders(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(file, module, folder): the folder of each Go import within the module that encloses the importing file.

    ``modules`` has (dir, name) of each module file; the innermost one around a file counts.
    """
    above = F.transform(F.sequence(F.lit(0), F.size(F.split("file", "/")) - 1), lambda n: F.array_join(F.slice(F.split("file", "/"), F.lit(1), n), "/"))
    go = imports.where(t.language_of("file") == "go").select("file", "module").distinct()
    held = go.select("file", "module", F.explode(above).alias("dir")).join(modules.select("dir", "name"), "dir")
    inner = held.groupBy("file", "module").agg(F.max_by(F.struct("dir", "name"), F.length("dir")).alias("m"))
    sub = F.when(F.col("module") == F.col("m.name"), "").when(F.startswith("module", F.concat("m.name", F.lit("/"))), F.substring("module", F.length("m.name") + 2, F.length("module")))
    folder = F.when(sub == "", F.col("m.dir")).when(F.col("m.dir") == "", sub).otherwise(F.concat("m.dir", F.lit("/"), sub))
    return inner.select("file", "module", folder.alias("folder")).where("folder is not null")


def resolve_refs(refs: DataFrame, symbols: DataFrame, imports: DataFrame, files: DataFrame | None = None, go_modules: DataFrame | None = None) -> DataFrame:
    """References with to_symbol and confidence: same file, then the first matching import, then a unique bare name.

    A matching import whose target isn't found ends the search for its name. Where
    refs have a ``qualifier`` (what stands before the name), one that an import binds
    to a whole module decides before all else: its file, or for Go its folder, given
    by ``go_modules`` (dir, name). ``files`` (path) are those that modules may mean;
    without them the files that have symbols.
    """
    if "qualifier" in refs.columns:
        own_refs = refs.withColumn("__ref", F.struct("from_file", "qualifier", "to_name"))
        whole = qualified(own_refs.select("from_file", "qualifier", "to_name").distinct(), symbols, imports, files, go_modules)
        plain = resolve_refs(refs.drop("qualifier").select("from_file", "to_name").distinct().withColumns({"to_symbol": F.lit(None), "confidence": F.lit(None)}), symbols, imports, files).select("from_file", "to_name", F.col("to_symbol").alias("__plain"))
        joined = refs.drop("to_symbol", "confidence").join(whole, ["from_file", "qualifier", "to_name"], "left").join(plain, ["from_file", "to_name"], "left")
        found = F.when(F.col("__whole"), F.col("__target")).otherwise(F.col("__plain"))
        return joined.withColumn("to_symbol", found).withColumn("confidence", F.when(found.isNotNull(), "resolved").otherwise("heuristic")).drop("__whole", "__target", "__plain")
    local = symbols.select(F.col("file").alias("from_file"), t.last_segment("qualname").alias("to_name"), "qualname", "line_start")
    own = local.groupBy("from_file", "to_name").agg(F.max_by("qualname", "line_start").alias("__own"))
    bound = imports.where("symbol is null or symbol != '*'").select(F.col("file").alias("from_file"), F.coalesce("alias", "symbol").alias("to_name"), F.struct("line", "module", "symbol").alias("i")).where("to_name is not null").groupBy("from_file", "to_name").agg(F.min("i").alias("i"))
    target = named_in_file(symbols)
    placed = module_targets(imports, symbols, files)
    imported = bound.withColumns({"module": F.col("i.module"), "__name": F.col("i.symbol")}).join(placed, ["from_file", "module"], "left").join(target, ["__file", "__name"], "left").select("from_file", "to_name", "__import", F.lit(True).alias("__bound"))
    bare = unique(symbols.select(t.last_segment("qualname").alias("to_name"), "qualname"), "to_name", "qualname").withColumnRenamed("qualname", "__bare")
    joined = refs.drop("to_symbol", "confidence").join(own, ["from_file", "to_name"], "left").join(imported, ["from_file", "to_name"], "left").join(bare, "to_name", "left")
    found = F.coalesce("__own", F.when(F.coalesce("__bound", F.lit(False)), F.col("__import")).otherwise(F.col("__bare")))
    return joined.withColumn("to_symbol", found).withColumn("confidence", F.when(found.isNotNull(), "resolved").otherwise("heuristic")).drop("__own", "__bound", "__import", "__bare")


def named_in_file(symbols: DataFrame) -> DataFrame:
    """(__file, __name, __import): one symbol for each last name of a file, the first by name."""
    return symbols.groupBy(F.col("file").alias("__file"), t.last_segment("qualname").alias("__name")).agg(F.min("qualname").alias("__import"))


def module_targets(imports: DataFrame, symbols: DataFrame, files: DataFrame | None) -> DataFrame:
    """(from_file, module, __file): the first of its likely files that is there; in Python, else the only one with that end."""
    known = (files.select(F.col("path").alias("__file")) if files is not None else symbols.select(F.col("file").alias("__file"))).distinct()
    asked = imports.select(F.col("file").alias("from_file"), "module").distinct().withColumn("__key", F.concat_ws("|", "from_file", "module"))
    found = first_candidate(asked, "__key", module_files(F.col("from_file"), F.col("module")), known, "__file")
    left = asked.where(t.language_of("from_file") == "python").join(found, "__key", "left_anti")
    end = F.concat(F.replace(F.regexp_replace("module", r"^\.+", ""), F.lit("."), F.lit("/")), F.lit(".py"))
    only = unique(suffix_join(left.select("__key", end.alias("__end")), "__end", known, "__file"), "__key", "__file")
    return asked.join(found.unionByName(only), "__key").select("from_file", "module", "__file")


def qualified(asked: DataFrame, symbols: DataFrame, imports: DataFrame, files: DataFrame | None, go_modules: DataFrame | None) -> DataFrame:
    """(from_file, qualifier, to_name, __target, __whole) for names behind a module that an import binds as a whole."""
    held = imports.where("symbol is null or symbol = '*'").withColumn("from_file", F.col("file"))
    own = F.when(t.language_of("file") == "go", F.coalesce("alias", F.substring_index("module", "/", -1))).otherwise(F.coalesce("alias", "module"))
    bound = held.select("from_file", own.alias("qualifier"), F.struct("line", "module").alias("i")).groupBy("from_file", "qualifier").agg(F.min("i.module").alias("module"))
    q = asked.where("qualifier is not null").join(bound, ["from_file", "qualifier"])
    by_file = q.join(module_targets(imports, symbols, files), ["from_file", "module"]).withColumn("__name", F.col("to_name")).join(named_in_file(symbols), ["__file", "__name"]).select("from_file", "qualifier", "to_name", F.col("__import").alias("__target"))
    if go_modules is not None:
        top = symbols.where((t.language_of("file") == "go") & ~F.contains(F.substring_index("qualname", "::", -1), F.lit(".")))
        at = top.groupBy(t.dirname("file").alias("folder"), t.last_segment("qualname").alias("to_name")).agg(F.min("qualname").alias("__target"))
        folders = go_folders(imports, go_modules).withColumnRenamed("file", "from_file")
        by_file = by_file.unionByName(q.join(folders, ["from_file", "module"]).join(at, ["folder", "to_name"]).select("from_file", "qualifier", "to_name", "__target"))
    return q.select("from_file", "qualifier", "to_name").join(by_file, ["from_file", "qualifier", "to_name"], "left").withColumn("__whole", F.lit(True))


def first_candidate(rows: DataFrame, key: str, candidates: Column, targets: DataFrame, target: str) -> DataFrame:
    """The first name of an ordered list that exists: (key, target)."""
    asked = rows.select(key, F.posexplode(candidates).alias("__pos", target))
    return asked.join(targets.select(target).distinct(), target).groupBy(key).agg(F.min_by(target, "__pos").alias(target))


def suffix_join(names: DataFrame, name: str, paths: DataFrame, path: str) -> DataFrame:
    """Names equal to a path or to its end behind a slash: an equi-join on the last part, then the check."""
    a = names.withColumn("__last", t.basename(name))
    b = paths.withColumn("__last", t.basename(path))
    return a.join(b, "__last").where((F.col(path) == F.col(name)) | F.endswith(F.col(path), F.concat(F.lit("/"), F.col(name)))).drop("__last")


def either_join(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Rows that agree on any pair of columns: a union of equi-joins instead of a nested loop."""
    parts = [left.join(right, left[a] == right[b]) for a, b in pairs]
    return reduce(lambda x, y: x.union(y), parts).distinct()


def symbol_match(symbols: DataFrame, name: str) -> DataFrame:
    q = F.col("qualname")
    return symbols.where((q == name) | F.endswith(q, F.lit("::" + name)) | F.endswith(q, F.lit("." + name)))


def symbol_lookup(symbols: DataFrame, name: str) -> DataFrame:
    """Exact names before loose ones; more than one loose match is a row that says so."""
    held = symbol_match(symbols, name).withColumn("exact", F.col("qualname") == name)
    ranked = held.withColumn("__best", F.max("exact").over(Window.partitionBy())).where("exact = __best")  # matches of one name
    n = F.count("*").over(Window.partitionBy())
    return ranked.withColumn("ambiguous", n > 1).drop("__best")


def division(have: DataFrame, want: DataFrame, owner: str, item: str, wanted_by: str, within: list[str] = ()) -> DataFrame:
    """(owner, wanted_by) where the owner has every wanted item; nothing wanted is had by no one."""
    needs = want.select(*within, wanted_by, item).distinct()
    size = needs.groupBy(*within, wanted_by).agg(F.count("*").alias("__need"))
    got = have.select(*within, owner, item).distinct().join(needs, [*within, item]).groupBy(*within, owner, wanted_by).agg(F.count("*").alias("__got"))
    return got.join(size, [*within, wanted_by]).where("__got = __need").drop("__got", "__need")


def prefer_same(joined: DataFrame, key: list[str], same: Column) -> DataFrame:
    """Where some candidates of a key are of its own group, only those."""
    best = F.max(same.cast("int")).over(Window.partitionBy(*key))
    return joined.withColumn("__same", same.cast("int")).withColumn("__best", best).where("__same = __best").drop("__same", "__best")


def prefer_same_join(left: DataFrame, right: DataFrame, key: str, on: list[str], group: str) -> DataFrame:
    """The pairs that agree on ``on`` as prefer_same would leave them, without making the pairs it drops.

    Pairs of one group are an equi-join; only keys without any are joined with all
    candidates. Rows without a group are no candidates and get none.
    """
    a, b = left.where(F.col(group).isNotNull()), right.where(F.col(group).isNotNull())
    own = a.join(b, [*on, group])
    rest = a.join(own.select(key).distinct(), key, "left_anti").drop(group).join(b.drop(group), on)
    return own.drop(group).unionByName(rest)


def layered_union(layers: list[tuple[str, DataFrame]], key: list[str]) -> DataFrame:
    """Union of layers, each pair kept once with the most trusted layer's name."""
    tagged = [df.select(*key, F.lit(rank).alias("rank"), F.lit(name).alias("layer")) for rank, (name, df) in enumerate(layers)]
    return reduce(lambda a, b: a.unionByName(b), tagged).groupBy(*key).agg(F.min("rank").alias("rank"), F.min_by("layer", "rank").alias("layer"))


def change_set(old: DataFrame, new: DataFrame, key: str, stamp: str, digest: str) -> DataFrame:
    """new, unchanged (same stamp), touched (same digest), changed or removed, for every key of either side."""
    a = old.select(key, F.col(stamp).alias("old_stamp"), F.col(digest).alias("old_digest"), F.lit(True).alias("__o"))
    b = new.select(key, F.col(stamp).alias("new_stamp"), F.col(digest).alias("new_digest"), F.lit(True).alias("__n"))
    both = a.join(b, key, "full_outer")
    state = (
        F.when(F.col("__o").isNull(), "new")
        .when(F.col("__n").isNull(), "removed")
        .when(F.col("old_stamp") == F.col("new_stamp"), "unchanged")
        .when(F.col("old_digest") == F.col("new_digest"), "touched")
        .otherwise("changed")
    )
    return both.select(key, state.alias("state"))


def replace_by_file(table: DataFrame, fresh: DataFrame, gone: DataFrame, file: str = "file") -> DataFrame:
    """The table without rows of files that are gone or fresh, and with the fresh rows."""
    out = gone.select(file).union(fresh.select(file)).distinct()
    return table.join(out, file, "left_anti").select(*fresh.columns).unionByName(fresh)


def dead_symbols(symbols: DataFrame, refs: DataFrame, inherits: DataFrame, implements: DataFrame, test_files: DataFrame, include_exported: bool = False) -> DataFrame:
    """Symbols that nothing refers to, by name, target, parent or interface; no tests, no dunders."""
    s = symbols.withColumn("__last", t.last_segment("qualname")).where(~t.is_dunder("qualname"))
    if not include_exported:
        s = s.where("exported = 0")
    loose = refs.where("to_symbol is null").select(t.last_segment("to_name").alias("__last"))
    names = loose.union(inherits.select(t.last_segment("parent"))).union(implements.select(t.last_segment("interface"))).distinct()
    return (
        s.join(refs.where("to_symbol is not null").select(F.col("to_symbol").alias("qualname")).distinct(), "qualname", "left_anti")
        .join(names, "__last", "left_anti")
        .join(test_files.select(F.col(test_files.columns[0]).alias("file")).distinct(), "file", "left_anti")
        .drop("__last")
    )


def untested(symbols: DataFrame, tests: DataFrame) -> DataFrame:
    """Exported symbols of files that no test covers and that are no tests."""
    exported = symbols.where("exported = 1")
    return exported.join(tests.select(F.col("target_file").alias("file")).distinct(), "file", "left_anti").join(tests.select(F.col("test_file").alias("file")).distinct(), "file", "left_anti")


def convention_tests(files: DataFrame, path: str = "path") -> DataFrame:
    """Tests and the sources that their names point to, within a language family."""
    base = files.select(F.col(path).alias("path"), t.family_of(t.language_of(path)).alias("family"), t.stem(path).alias("stem"))
    is_test = F.col("stem").rlike(r"^test_|_test$|\.test$|\.spec$")
    key = F.regexp_replace("stem", r"^test_|_test$|\.test$|\.spec$", "")
    tests = base.where(is_test).select("family", key.alias("stem"), F.col("path").alias("test_file"))
    return tests.join(base.where(~is_test).select("family", "stem", F.col("path").alias("target_file")), ["family", "stem"]).select("test_file", "target_file", F.lit("convention").alias("source"))


def coverage_class(files: DataFrame, tests: DataFrame, changed: DataFrame) -> DataFrame:
    """uncovered (no test), stale (no covering test changed) or fresh, for each file."""
    c = changed.select(F.col(changed.columns[0]).alias("test_file")).distinct().withColumn("__c", F.lit(1))
    per = tests.join(c, "test_file", "left").groupBy(F.col("target_file").alias("file")).agg(F.count("*").alias("n_tests"), F.coalesce(F.max("__c"), F.lit(0)).alias("touched"))
    out = files.join(per, "file", "left")
    return out.select("file", F.when(F.col("n_tests").isNull(), "uncovered").when(F.col("touched") == 0, "stale").otherwise("fresh").alias("state"), F.coalesce("n_tests", F.lit(0)).alias("n_tests"))


def family_join(names: DataFrame, name: str, symbols: DataFrame, family: str = "family") -> DataFrame:
    """Names with the symbols of the same language family whose last part is the same."""
    a = names.withColumn("__last", t.last_segment(name))
    return a.join(symbols.withColumn("__last", t.last_segment("qualname")), [family, "__last"]).drop("__last")


def longest_prefix(contexts: DataFrame, context: str, files: DataFrame, path: str) -> DataFrame:
    """The one file whose dotted name is the longest beginning of a context; two of one length are none.

    Every beginning of a context is looked up by equality, so there is no prefix scan.
    """
    parts = F.split(F.col(context), r"\.")
    tried = contexts.select(context, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(parts, F.lit(1), n), ".").alias("dotted")))).alias("x")).select(context, "x.n", "x.dotted")
    named = files.select(F.col(path), F.replace(F.regexp_replace(F.col(path), r"\.[^./]*$", ""), F.lit("/"), F.lit(".")).alias("dotted"))
    held = tried.join(named, "dotted")
    best = held.withColumn("__most", F.max("n").over(Window.partitionBy(context))).where("n = __most")
    return unique(best, context, path)


def package_targets(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Files that an import of a package names: beside the importer, from the root, or the only one with that end.

    ``pkg`` is ``pkg/__init__.py``, and with a symbol also ``pkg/symbol.py`` where that exists.
    """
    base = F.replace(F.col("module"), F.lit("."), F.lit("/"))
    folder = t.dirname("file")
    near = F.when(folder != "", F.concat(folder, F.lit("/"), base)).otherwise(base)
    init, own = F.lit("/__init__.py"), F.concat(F.lit("/"), F.col("symbol"), F.lit(".py"))
    asked = imports.withColumn("__key", F.concat_ws("|", "file", "line", "module", F.coalesce("symbol", F.lit(""))))
    known = files.select(F.col("path").alias("target_file"))
    package = first_candidate(asked, "__key", F.array(F.concat(near, init), F.concat(base, init)), known, "target_file")
    member = first_candidate(asked.where("symbol is not null"), "__key", F.array(F.concat(near, own), F.concat(base, own)), known, "target_file")
    left = asked.join(package, "__key", "left_anti").select("__key", F.concat(base, init).alias("name"))
    only = unique(suffix_join(left, "name", files.select("path"), "path"), "__key", "path").withColumnRenamed("path", "target_file")
    found = package.unionByName(only).unionByName(member).distinct()
    return asked.join(found, "__key").drop("__key")


def import_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst, line): module stems to files of one language, those of the importer's folder first; the first line of each pair."""
    stems = files.select(F.col("path").alias("dst"), t.stem("path").alias("stem"), t.dirname("path").alias("dir"))
    asked = imports.select(F.col("file").alias("src"), "line", F.regexp_extract("module", r"([^./]+)$", 1).alias("stem"), t.dirname("file").alias("own"))
    joined = prefer_same(asked.join(stems, "stem"), ["src", "line", "stem"], F.col("own") == F.col("dir"))
    return joined.where("src != dst").groupBy("src", "dst").agg(F.min("line").alias("line"))


def public_api(symbols: DataFrame, prefix: str | None = None) -> DataFrame:
    held = symbols.where("exported = 1")
    return (held.where(t.under("file", prefix)) if prefix else held).orderBy("file", "line_start")


def freshness(changes: DataFrame) -> DataFrame:
    """Counts of stale, new and missing files of a change set."""
    n = lambda *states: F.count_if(F.col("state").isin(*states))
    return changes.agg(n("changed").alias("stale"), n("new").alias("new"), n("removed").alias("missing"))


def run_commands(test_files: DataFrame, path: str = "path") -> DataFrame:
    """One command a language family over its test files; packages instead of files where the tool wants them."""
    family = t.family_of(t.language_of(path))
    what = F.when(family == "go", F.concat(F.lit("./"), t.dirname(path))).otherwise(F.col(path))
    tool = F.when(family == "python", "pytest").when(family == "go", "go test").otherwise("npx vitest run")
    return test_files.where(family.isNotNull()).groupBy(family.alias("family"), tool.alias("tool")).agg(F.array_join(F.array_sort(F.collect_set(what)), " ").alias("args")).select("family", F.concat_ws(" ", "tool", "args").alias("command"))


def test_runner(names: Column, manifest: Column) -> Column:
    """The runner that config files or a manifest name; vitest before jest."""
    has = lambda rx: F.exists(names, lambda x: x.rlike(rx)) | F.coalesce(manifest.rlike(rx), F.lit(False))
    return F.when(has("vitest"), "vitest").when(has("jest"), "jest").when(has("pytest|conftest"), "pytest").when(has(r"go\.mod"), "go test")
