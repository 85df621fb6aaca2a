"""Dependency manifests and lockfiles as rows (path, ecosystem, name, version, dev), parsed by SQL functions.

Input: files (path, content). Each format is a projection and an explode over the files of its name; a file that does not
parse gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.textscan import carry, lines

# File name -> ecosystem.
ECOSYSTEMS = {
    "package.json": "npm", "package-lock.json": "npm", "yarn.lock": "npm", "requirements.txt": "pypi", "Pipfile.lock": "pypi", "pom.xml": "maven", "build.gradle": "maven",
    "composer.json": "packagist", "composer.lock": "packagist", "Gemfile.lock": "rubygems", "go.mod": "go", "go.sum": "go", "Cargo.toml": "crates.io", "packages.config": "nuget", "vcpkg.json": "vcpkg", "conanfile.txt": "conan",
}


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def discover(files: DataFrame) -> DataFrame:
    """Adds file and ecosystem; files that are no manifests go (names ending in .csproj count)."""
    name = file_name(F.col("path"))
    eco = reduce(lambda c, kv: c.when(name == kv[0], kv[1]), ECOSYSTEMS.items(), F.when(name.endswith(".csproj"), "nuget"))
    return files.withColumn("file", name).withColumn("ecosystem", eco).where("ecosystem is not null")


def clean_version(v: Column) -> Column:
    """Without a range prefix."""
    return F.regexp_replace(F.trim(v), r"^[\^~>=<v\s]+", "")


def _rows(df: DataFrame, name: Column, version: Column, dev: Column | None = None) -> DataFrame:
    return df.select("path", "ecosystem", name.alias("name"), version.alias("version"), (F.lit(False) if dev is None else dev).alias("dev"))


def _of(files: DataFrame, *names: str) -> DataFrame:
    return files.where(F.col("file").isin(*names))


def _maps(df: DataFrame, schema: str, *fields: tuple[str, bool]) -> DataFrame:
    j = df.withColumn("j", F.from_json("content", schema))
    parts = [j.select("path", "ecosystem", F.explode(f"j.`{f}`").alias("k", "v"), F.lit(dev).alias("dev")) for f, dev in fields]
    return reduce(DataFrame.union, parts)


def package_json(files: DataFrame) -> DataFrame:
    m = _maps(_of(files, "package.json"), "dependencies map<string,string>, devDependencies map<string,string>", ("dependencies", False), ("devDependencies", True))
    return _rows(m, F.col("k"), clean_version(F.col("v")), F.col("dev"))


def package_lock(files: DataFrame) -> DataFrame:
    """Lockfile versions 2 and 3 (packages by path); version 1 (dependencies) by its top level."""
    f = _of(files, "package-lock.json").withColumn("j", F.from_json("content", "packages map<string,struct<version:string,dev:boolean>>, dependencies map<string,struct<version:string,dev:boolean>>"))
    new = f.select("path", "ecosystem", F.explode("j.packages").alias("k", "v")).where("k <> ''").withColumn("k", F.element_at(F.split("k", "node_modules/"), -1))
    old = f.where("j.packages is null").select("path", "ecosystem", F.explode("j.dependencies").alias("k", "v"))
    m = new.union(old)
    return _rows(m, F.col("k"), F.col("v.version"), F.coalesce("v.dev", F.lit(False)))


def _line_format(files: DataFrame, names: list[str], pattern: str, skip: str = r"^\s*(#|$)") -> DataFrame:
    f = _of(files, *names)
    eco = f.select("path", "ecosystem").distinct()
    found = lines(f, "path", "content").where(~F.col("line").rlike(skip)).withColumn("n", F.regexp_extract("line", pattern, 1)).withColumn("v", F.regexp_extract("line", pattern, 2)).where("n <> ''")
    return _rows(found.join(eco, "path"), F.col("n"), F.col("v"))


def requirements_txt(files: DataFrame) -> DataFrame:
    return _line_format(files, ["requirements.txt"], r"^\s*([A-Za-z0-9._-]+)(?:\[[^\]]*\])?\s*(?:[=<>~!]=?=?\s*([0-9][^\s,;#]*))?", r"^\s*(#|-|$)")


def go_mod(files: DataFrame) -> DataFrame:
    return _line_format(files, ["go.mod"], r"^\s*(?:require\s+)?([a-z0-9.-]+\.[a-z]+/\S+)\s+v(\S+)", r"^\s*(//|module|replace|exclude|$)")


def go_sum(files: DataFrame) -> DataFrame:
    return _line_format(files, ["go.sum"], r"^(\S+)\s+v([^\s/]+)(?:/go\.mod)?\s").distinct()


def gemfile_lock(files: DataFrame) -> DataFrame:
    return _line_format(files, ["Gemfile.lock"], r"^    ([A-Za-z0-9._-]+) \(([^)]+)\)$")


def gradle(files: DataFrame) -> DataFrame:
    f = _of(files, "build.gradle")
    pattern = r"(implementation|api|compile|testImplementation|runtimeOnly)\s*\(?\s*['\"]([^:'\"]+:[^:'\"]+):([^'\"]+)['\"]"
    m = f.select("path", "ecosystem", F.explode(F.arrays_zip(*[F.regexp_extract_all("content", F.lit(pattern), F.lit(i)).alias(n) for i, n in ((1, "c"), (2, "n"), (3, "v"))])).alias("x"))
    return _rows(m, F.col("x.n"), F.col("x.v"), F.col("x.c") == "testImplementation")


def pom_xml(files: DataFrame) -> DataFrame:
    """Coordinates with ${property} resolved from the same file."""
    f = _of(files, "pom.xml")
    block = r"(?s)<dependency>(.*?)</dependency>"
    d = f.select("path", "ecosystem", "content", F.explode(F.regexp_extract_all("content", F.lit(block), F.lit(1))).alias("b"))
    tag = lambda t: F.trim(F.regexp_extract("b", rf"<{t}>\s*([^<]+?)\s*</{t}>", 1))
    raw = tag("version")
    key = F.regexp_extract(raw, r"^\$\{([^}]+)\}$", 1)
    found = F.regexp_extract(F.col("content"), r"(?s)<properties>(.*?)</properties>", 1)
    entries = F.transform(F.regexp_extract_all(found, F.lit(r"<([A-Za-z0-9._-]+)>\s*[^<]*?\s*</"), F.lit(1)), lambda x: x)
    values = F.regexp_extract_all(found, F.lit(r"<[A-Za-z0-9._-]+>\s*([^<]*?)\s*</"), F.lit(1))
    m = d.withColumn("_keys", entries).withColumn("_values", values)
    resolved = F.when(key == "", raw).otherwise(F.try_element_at("_values", F.array_position("_keys", key).cast("int")))
    return _rows(m, F.concat_ws(":", tag("groupId"), tag("artifactId")), F.coalesce(resolved, raw), tag("scope") == "test")


def composer_json(files: DataFrame) -> DataFrame:
    m = _maps(_of(files, "composer.json"), "require map<string,string>, `require-dev` map<string,string>", ("require", False), ("require-dev", True))
    return _rows(m.where("k <> 'php' and k not like 'ext-%'"), F.col("k"), clean_version(F.col("v")), F.col("dev"))


def composer_lock(files: DataFrame) -> DataFrame:
    j = _of(files, "composer.lock").withColumn("j", F.from_json("content", "packages array<struct<name:string,version:string>>, `packages-dev` array<struct<name:string,version:string>>"))
    parts = [j.select("path", "ecosystem", F.explode(f"j.`{f}`").alias("p"), F.lit(dev).alias("dev")) for f, dev in (("packages", False), ("packages-dev", True))]
    m = reduce(DataFrame.union, parts)
    return _rows(m, F.col("p.name"), clean_version(F.col("p.version")), F.col("dev"))


def pipfile_lock(files: DataFrame) -> DataFrame:
    m = _maps(_of(files, "Pipfile.lock"), "default map<string,struct<version:string>>, develop map<string,struct<version:string>>", ("default", False), ("develop", True))
    return _rows(m, F.col("k"), F.regexp_replace("v.version", "^==", ""), F.col("dev"))


def cargo_toml(files: DataFrame) -> DataFrame:
    """Sections carried forward; both plain versions and tables with one."""
    f = _of(files, "Cargo.toml")
    eco = f.select("path", "ecosystem").distinct()
    m = carry(lines(f, "path", "content"), "path", "line_number", F.when(F.col("line").rlike(r"^\s*\["), F.regexp_extract("line", r"^\s*\[([^\]]+)\]", 1)), "section")
    m = m.where("section in ('dependencies', 'dev-dependencies', 'build-dependencies')").where(F.col("line").rlike(r"^\s*[A-Za-z0-9_-]+\s*="))
    version = F.coalesce(F.nullif(F.regexp_extract("line", r"^\s*[A-Za-z0-9_-]+\s*=\s*\"([^\"]+)\"", 1), F.lit("")), F.nullif(F.regexp_extract("line", r"version\s*=\s*\"([^\"]+)\"", 1), F.lit("")))
    return _rows(m.join(eco, "path"), F.regexp_extract("line", r"^\s*([A-Za-z0-9_-]+)", 1), clean_version(version), F.col("section") == "dev-dependencies")


def csproj(files: DataFrame) -> DataFrame:
    f = files.where(F.col("file").endswith(".csproj") | (F.col("file") == "packages.config"))
    pattern = r"<(?:PackageReference|package)\s+(?:Include|id)=\"([^\"]+)\"\s+(?:Version|version)=\"([^\"]+)\""
    m = f.select("path", "ecosystem", F.explode(F.arrays_zip(*[F.regexp_extract_all("content", F.lit(pattern), F.lit(i)).alias(n) for i, n in ((1, "n"), (2, "v"))])).alias("x"))
    return _rows(m, F.col("x.n"), F.col("x.v"))


def vcpkg_json(files: DataFrame) -> DataFrame:
    """Dependencies as names or objects."""
    f = _of(files, "vcpkg.json").withColumn("j", F.from_json("content", "dependencies array<string>"))
    m = f.select("path", "ecosystem", F.explode("j.dependencies").alias("d"))
    return _rows(m, F.coalesce(F.get_json_object("d", "$.name"), "d"), F.coalesce(F.get_json_object("d", "$['version>=']"), F.get_json_object("d", "$.version")))


def conanfile(files: DataFrame) -> DataFrame:
    f = _of(files, "conanfile.txt")
    eco = f.select("path", "ecosystem").distinct()
    m = carry(lines(f, "path", "content"), "path", "line_number", F.when(F.col("line").rlike(r"^\s*\["), F.regexp_extract("line", r"^\s*\[([^\]]+)\]", 1)), "section")
    m = m.where("section in ('requires', 'build_requires', 'tool_requires')").where(F.col("line").rlike(r"^\s*[A-Za-z0-9_.+-]+/"))
    return _rows(m.join(eco, "path"), F.regexp_extract("line", r"^\s*([^/\s]+)/([^@\s]+)", 1), F.regexp_extract("line", r"^\s*([^/\s]+)/([^@\s]+)", 2), F.col("section") != "requires")


def yarn_lock(files: DataFrame) -> DataFrame:
    """Blocks of a header line and an indented version."""
    f = _of(files, "yarn.lock")
    b = f.select("path", "ecosystem", F.explode(F.split("content", r"\n\s*\n")).alias("b")).where(F.col("b").rlike(r"(?m)^\s+version:? "))
    return _rows(b, F.regexp_extract("b", r"(?m)^\"?(@?[^@\"\s]+)@", 1), F.regexp_extract("b", r"(?m)^\s+version:? \"?([^\"\s]+)", 1))


PARSERS = (package_json, package_lock, yarn_lock, requirements_txt, pipfile_lock, pom_xml, gradle, composer_json, composer_lock, gemfile_lock, go_mod, go_sum, cargo_toml, csproj, vcpkg_json, conanfile)


def parse(files: DataFrame) -> DataFrame:
    """Dependencies of all manifests among ``files`` (path, content)."""
    found = discover(files)
    return reduce(DataFrame.unionByName, [p(found) for p in PARSERS])


def npm_tree(files: DataFrame) -> DataFrame:
    """(path, name, version, depth, parent, is_direct) of version 2 and 3 lockfiles; depth counts node_modules/ less one."""
    f = _of(discover(files), "package-lock.json").withColumn("j", F.from_json("content", "packages map<string,struct<version:string>>"))
    m = f.select("path", F.explode("j.packages").alias("k", "v")).where("k <> ''")
    parts = F.split("k", "node_modules/")
    depth = F.size(parts) - 2
    parent = F.when(depth > 0, F.regexp_replace(F.element_at(parts, -2), "/$", ""))
    return m.select("path", F.element_at(parts, -1).alias("name"), F.col("v.version").alias("version"), depth.alias("depth"), parent.alias("parent"), (depth == 0).alias("is_direct"))


def go_sum_tree(files: DataFrame) -> DataFrame:
    return go_sum(discover(files)).select("path", "name", "version", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"), F.lit(True).alias("is_direct"))


def indented_tree(files: DataFrame, file: str, pattern: str, step: int) -> DataFrame:
    """Trees drawn by indentation (pip, Maven, Gradle): depth from the column where the name starts.

    The parent is the last line above with a smaller depth; found per file by a window, one carried value per depth.
    """
    from pyspark.sql import Window

    f = files.where(file_name(F.col("path")) == file)
    m = lines(f, "path", "content").withColumn("at", F.regexp_instr("line", F.lit(r"[A-Za-z0-9@]")) - 1).where("at >= 0")
    m = m.withColumn("name", F.regexp_extract("line", pattern, 1)).withColumn("version", F.regexp_extract("line", pattern, 2)).where("name <> ''").withColumn("depth", (F.col("at") / step).cast("int"))
    w = Window.partitionBy("path").orderBy("line_number").rowsBetween(Window.unboundedPreceding, -1)
    above = [F.last(F.when(F.col("depth") == d, F.col("name")), ignorenulls=True).over(w) for d in range(12)]
    parent = F.when(F.col("depth") > 0, F.try_element_at(F.array(*above), F.col("depth")))
    return m.select("path", "name", "version", "depth", parent.alias("parent"), (F.col("depth") == 0).alias("is_direct"))


def npm_v1_tree(files: DataFrame) -> DataFrame:
    """Trees of version 1 lockfiles, nested to any depth: (path, name, version, depth, parent, is_direct).

    The nesting has no fixed schema, so a file's JSON is walked by a Python table function over Arrow batches.
    """
    import json
    from collections.abc import Iterator

    import pandas as pd

    def walk(deps: dict, depth: int, parent: str | None) -> Iterator[tuple]:
        for name, d in deps.items():
            if isinstance(d, dict):
                yield name, d.get("version"), depth, parent, depth == 0
                if isinstance(d.get("dependencies"), dict):
                    yield from walk(d["dependencies"], depth + 1, name)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, c in zip(b["path"], b["content"], strict=True):
                try:
                    j = json.loads(c or "")
                except ValueError:
                    continue
                if isinstance(j, dict) and "packages" not in j and isinstance(j.get("dependencies"), dict):
                    rows += [(p, *r) for r in walk(j["dependencies"], 0, None)]
            yield pd.DataFrame(rows, columns=["path", "name", "version", "depth", "parent", "is_direct"])

    return _of(discover(files), "package-lock.json").select("path", "content").mapInPandas(run, "path string, name string, version string, depth int, parent string, is_direct boolean")


def cargo_lock(files: DataFrame) -> DataFrame:
    """(path, name, version, dependencies) of Cargo.lock: one block per package."""
    f = files.where(file_name(F.col("path")) == "Cargo.lock")
    b = f.select("path", F.explode(F.split("content", r"\[\[package\]\]")).alias("b")).where(F.col("b").rlike(r"(?m)^name = "))
    deps = F.regexp_extract("b", r"(?s)dependencies = \[(.*?)\]", 1)
    return b.select("path", F.regexp_extract("b", r"(?m)^name = \"([^\"]+)\"", 1).alias("name"), F.regexp_extract("b", r"(?m)^version = \"([^\"]+)\"", 1).alias("version"), F.regexp_extract_all(deps, F.lit(r"\"([^\s\"]+)[^\"]*\""), F.lit(1)).alias("dependencies"))


def yarn_graph(files: DataFrame) -> DataFrame:
    """(path, name, version, dependencies) of yarn.lock: one row per package name of each block; names of dependencies, optional ones too."""
    f = files.where(file_name(F.col("path")) == "yarn.lock")
    b = f.select("path", F.explode(F.split(F.regexp_replace("content", r"\r\n", "\n"), r"\n(?=[^\s#])")).alias("b")).where(F.col("b").rlike(r"(?m)^[^\s#].*:$"))
    head, body = F.regexp_extract("b", r"(?m)^([^\s#].*):$", 1), F.regexp_extract("b", r"(?ms)^[^\s#][^\n]*:$(.*)", 1)
    names = F.array_distinct(F.filter(F.transform(F.split(head, ","), lambda x: F.regexp_extract(x, r'^\s*"?(@?[^@"]+)@', 1)), lambda x: x != ""))
    deps = F.array_distinct(F.regexp_extract_all(body, F.lit(r'(?m)^    "?(@?[^\s"@:]+)"?:?\s'), F.lit(1)))
    return b.select("path", F.explode(names).alias("name"), F.regexp_extract("b", r'(?m)^  version:? "?([^"\s]+)', 1).alias("version"), deps.alias("dependencies")).where("version <> ''")


def lock_tree(packages: DataFrame) -> DataFrame:
    """(path, name, version, depth, parent, is_direct) of the packages (path, name, version, dependencies) of yarn_graph() or cargo_lock()."""
    from ..operators.trees import depths

    at = depths(packages, packages.select("path", "name", F.explode("dependencies").alias("dependency")))
    return packages.select("path", "name", "version").distinct().join(at, ["path", "name"]).select("path", "name", "version", "depth", "parent", "is_direct")
