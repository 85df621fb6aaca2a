"""How far a vulnerable package reaches into code: not imported, imported, vulnerable functions called, signs of an exploit.

Imports of JavaScript, Python, Go and Java are read off lines without knowing any package; packages meet them in an equi-join
(Go and Java paths hold a package's name somewhere: a join on substrings). Calls are read off lines the same way and
meet the imports on (path, alias, function) or (path, function). No line is compared with a list of functions.

Files that are null are empty; a line may hold several calls; the import's own line is no use of it; an advisory that no
file imports is not reachable.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .iterate import cut
from .textscan import contains_join, lines

# Endings of an ecosystem's files, and the rungs with their confidence.
EXTENSIONS = {"npm": ("js", "jsx", "ts", "tsx", "mjs", "cjs"), "pip": ("py",), "go": ("go",), "maven": ("java",)}
RUNGS = (("not_reachable", 0.95), ("imported_only", 0.75), ("potentially_exploitable", 0.85), ("exploitable", 0.95))
#: (ecosystem, style, pattern, group of the module, group of the alias, group of the imported names); 0: none.
IMPORTS = (
    ("npm", "require", r"""(?:const|let|var)\s+(\w+)\s*=\s*require\s*\(\s*['"]([^'"]+)['"]""", 2, 1, 0),
    ("npm", "default", r"""import\s+(\w+)\s+from\s+['"]([^'"]+)['"]""", 2, 1, 0),
    ("npm", "namespace", r"""import\s+\*\s+as\s+(\w+)\s+from\s+['"]([^'"]+)['"]""", 2, 1, 0),
    ("npm", "named", r"""import\s+\{([^}]+)\}\s+from\s+['"]([^'"]+)['"]""", 2, 0, 1),
    ("npm", "named", r"""(?:const|let|var)\s+\{([^}]+)\}\s*=\s*require\s*\(\s*['"]([^'"]+)['"]""", 2, 0, 1),
    ("pip", "alias", r"""^\s*import\s+([\w.]+)\s+as\s+(\w+)""", 1, 2, 0),
    ("pip", "simple", r"""^\s*import\s+([\w.]+)(?:\s*$|\s*,|\s*#)""", 1, 1, 0),
    ("pip", "from", r"""^\s*from\s+([\w.]+)\s+import\s+\(?([^#()]+)""", 1, 0, 2),
    ("go", "go", r"""^\s*(?:import\s+)?(?:(\w+|[._])\s+)?"([^"]+)"\s*$""", 2, 1, 0),
    ("maven", "java", r"""^\s*import\s+(?:static\s+)?([^\s;]+?\.(\w+|\*))\s*;?\s*$""", 1, 2, 0),
)


def ecosystem(path: Column) -> Column:
    end = F.lower(F.substring_index(path, ".", -1))
    return reduce(lambda c, kv: c.when(end.isin(*kv[1]), kv[0]), EXTENSIONS.items(), F.when(F.lit(False), ""))


def imports(files: DataFrame) -> DataFrame:
    """(path, line_number, ecosystem, module, style, alias, names): what the lines of files (path, content) import.

    ``names`` has (name, known): a function's own name and the one that it is called by. A Go import without an alias goes by the last part of
    its path.
    """
    l = lines(files.select("path", F.coalesce("content", F.lit("")).alias("content")), "path", "content").withColumn("ecosystem", ecosystem(F.col("path")))
    none = F.array().cast("array<struct<name:string,known:string>>")

    def found(eco: str, style: str, pattern: str, module: int, alias: int, names: int) -> Column:
        group = lambda i: F.regexp_extract("line", pattern, i)
        known = F.when(group(1) == "", F.substring_index(group(2), "/", -1)).otherwise(group(1)) if style == "go" else group(alias) if alias else F.lit("")
        part = F.filter(F.split(group(names), ","), lambda n: F.trim(n) != "") if names else F.array().cast("array<string>")
        own = lambda n: F.struct(F.regexp_extract(n, r"(\w+)", 1).alias("name"), F.regexp_extract(n, r"(\w+)\s*$", 1).alias("known"))
        return F.when((F.col("ecosystem") == eco) & F.col("line").rlike(pattern), F.struct(F.lower(group(module)).alias("module"), F.lit(style).alias("style"), known.alias("alias"), (F.transform(part, own) if names else none).alias("names")))

    return l.withColumn("i", F.coalesce(*[found(*x) for x in IMPORTS])).where("i is not null").select("path", "line_number", "ecosystem", "i.*")


def _imported(files: DataFrame, advisories: DataFrame) -> DataFrame:
    """(cve, path, line_number, alias, names) of the imports of each advisory's package."""
    found = imports(files)
    a = advisories.select("cve", "ecosystem", F.lower("package").alias("module"))
    same = found.where("ecosystem in ('npm', 'pip')").join(a, ["ecosystem", "module"])
    inside = found.where("ecosystem in ('go', 'maven')")
    part = contains_join(inside.withColumnRenamed("ecosystem", "_e"), "module", a.where("ecosystem in ('go', 'maven')").select("cve", "ecosystem", F.col("module").alias("package")), "package").where("_e = ecosystem")
    pick = lambda d: d.select("cve", "path", "line_number", "alias", "names")
    return pick(same).union(pick(part))


def usages(files: DataFrame, advisories: DataFrame, imported: DataFrame | None = None) -> DataFrame:
    """(cve, path, line_number, function): calls of vulnerable functions through an import, by an advisory's own call patterns, and of its middleware.

    advisories: cve, package, ecosystem, and arrays functions, call_patterns, middleware.
    """
    imported = _imported(files, advisories) if imported is None else imported
    text = files.select("path", F.coalesce("content", F.lit("")).alias("content")).join(imported.select("path").distinct(), "path", "left_semi")
    l = lines(text, "path", "content").where("line <> ''")
    call = l.select("path", "line_number", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"\w+(?:\.\w+)?\s*\("), F.lit(0)))).alias("c"))
    call = call.select("path", "line_number", F.regexp_extract("c", r"^(\w+)\.", 1).alias("alias"), F.regexp_extract("c", r"(\w+)\s*\($", 1).alias("called"))
    functions = advisories.select("cve", F.explode("functions").alias("function"))
    at = imported.withColumnRenamed("line_number", "import_line")
    whole = at.where("alias <> ''").select("cve", "path", "import_line", "alias").join(functions, "cve").join(call.withColumnRenamed("called", "function"), ["path", "alias", "function"])
    named = at.select("cve", "path", "import_line", F.explode("names").alias("n")).select("cve", "path", "import_line", F.col("n.name").alias("function"), F.col("n.known").alias("called"))
    named = named.join(functions, ["cve", "function"]).join(call.drop("alias"), ["path", "called"])
    pick = lambda d: d.where("line_number <> import_line").select("cve", "path", "line_number", "function")
    here = imported.select("cve", "path").distinct()
    own = here.join(advisories.select("cve", F.explode("call_patterns").alias("function")), "cve").join(l, "path").where("regexp_like(line, function)").select("cve", "path", "line_number", "function")
    ware = here.join(advisories.select("cve", F.explode("middleware").alias("function")), "cve").join(l, "path")
    quoted = F.regexp_replace("function", r"(\W)", r"\\$1")
    ware = ware.where(F.lower("line").contains(F.lower("function"))).where(F.regexp_like("line", F.concat(F.lit(r"(?i)\.use\s*\([^)]*"), quoted, F.lit("|"), quoted, F.lit(r"\s*\(")))).select("cve", "path", "line_number", "function")
    return pick(whole).union(pick(named)).union(own).union(ware).distinct()


def ladder(files: DataFrame, advisories: DataFrame) -> DataFrame:
    """(cve, package, exploitability, confidence, n_imports, n_usages, indicated) of every advisory.

    advisories: as in usages(), and an array ``indicators``: texts that speak for an exploit in any file of the ecosystem,
    whatever their case.
    """
    imported = cut(_imported(files, advisories))  # read five times
    used = usages(files, advisories, imported)
    low = files.select(F.lower(F.coalesce("content", F.lit(""))).alias("content"), ecosystem(F.col("path")).alias("_e"))
    signs = advisories.select("cve", "ecosystem", F.explode("indicators").alias("i")).select("cve", "ecosystem", F.lower("i").alias("sign"))
    seen = contains_join(low, "content", signs, "sign").where("_e = ecosystem").groupBy("cve").agg(F.lit(True).alias("indicated"))
    count = lambda d, n: d.groupBy("cve").agg(F.count("*").alias(n))
    out = advisories.select("cve", "package").join(count(imported, "n_imports"), "cve", "left").join(count(used, "n_usages"), "cve", "left").join(seen, "cve", "left")
    out = out.fillna(0, ["n_imports", "n_usages"]).withColumn("indicated", F.coalesce("indicated", F.lit(False)))
    rung = F.when(F.col("n_imports") == 0, 1).when(F.col("n_usages") == 0, 2).when(~F.col("indicated"), 3).otherwise(4)
    at = F.element_at(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(c).alias("c")) for n, c in RUNGS]), rung)
    return out.select("cve", "package", at["n"].alias("exploitability"), at["c"].alias("confidence"), "n_imports", "n_usages", "indicated")
