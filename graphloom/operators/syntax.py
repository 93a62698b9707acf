"""Facts from source code: Python by its own parser, other languages by patterns; edges from them."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.classify import file_extension
from graphloom.operators.extract import lines_of
from graphloom.storage import ship_package

FACTS = "path string, kind string, name string, owner string, first long, last long, detail string"

#: How definitions and imports begin, by extension: (kind, pattern with the name as its group).
PATTERNS = {
    "rs": (("Function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)"), ("Class", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+(\w+)"), ("Import", r"^\s*(?:pub\s+)?use\s+([\w:]+)")),
    "go": (("Function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)"), ("Class", r"^type\s+(\w+)\s+(?:struct|interface)"), ("Import", r"^\s*(?:import\s+)?\"([\w./\-]+)\"\s*$")),
    "ts": (("Function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+(\w+)"), ("Class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:class|interface)\s+(\w+)"), ("Import", r"^\s*import\s.*?from\s+[\"']([^\"']+)[\"']")),
    "java": (("Class", r"^\s*(?:public\s+)?(?:abstract\s+|final\s+)?(?:class|interface|enum)\s+(\w+)"), ("Import", r"^\s*import\s+(?:static\s+)?([\w.]+)\s*;")),
}
SAME_PATTERNS = {"tsx": "ts", "js": "ts", "jsx": "ts", "kt": "java"}


def _python(text: str) -> list[tuple]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as error:
        return [("Error", type(error).__name__, None, getattr(error, "lineno", None), None, None)]
    out: list[tuple] = []

    def visit(node: ast.AST, owner: str | None, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            inner, of_class = owner, in_class
            if isinstance(child, ast.ClassDef):
                inner, of_class = f"{owner}.{child.name}" if owner else child.name, True
                out.append(("Class", child.name, owner, child.lineno, child.end_lineno, ",".join(ast.unparse(b) for b in child.bases) or None))
            elif isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                inner, of_class = f"{owner}.{child.name}" if owner else child.name, False
                out.append(("Method" if in_class else "Function", child.name, owner, child.lineno, child.end_lineno, ",".join(ast.unparse(d) for d in child.decorator_list) or None))
            elif isinstance(child, ast.Import):
                out.extend(("Import", a.name, owner, child.lineno, child.end_lineno, a.asname) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                module = "." * child.level + (child.module or "")
                out.extend(("Import", f"{module}:{a.name}", owner, child.lineno, child.end_lineno, a.asname) for a in child.names)
            elif isinstance(child, ast.Call):
                out.append(("Call", ast.unparse(child.func), owner, child.lineno, child.end_lineno, None))
            visit(child, inner, of_class)

    visit(tree, None, False)
    return out


def python_facts(files: DataFrame) -> DataFrame:
    """files: path, content. path, kind (Class, Function, Method, Import, Call, Error), name, owner, first, last (lines), detail.

    detail: bases of a class, decorators of a function, the other name of an import. A file that can't be parsed gives an Error.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *x) for p, t in zip(*(c.to_pylist() for c in batch.columns)) for x in _python(t)]
            columns = list(zip(*rows)) or [()] * 7
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["path", "kind", "name", "owner", "first", "last", "detail"])

    ship_package(files.sparkSession)
    return files.where("content IS NOT NULL").select("path", "content").mapInArrow(scan, FACTS)


def pattern_facts(files: DataFrame) -> DataFrame:
    """path, kind (Class, Function, Import), name, line of files in other languages, line by line by pattern."""
    rows = lines_of(files).withColumn("ext", file_extension(F.col("path")))
    found = []
    for ext, patterns in PATTERNS.items():
        names = [ext, *(k for k, v in SAME_PATTERNS.items() if v == ext)]
        for kind, pattern in patterns:
            name = F.regexp_extract("text", pattern, 1)
            found.append(F.when(F.col("ext").isin(*names) & (name != ""), F.struct(F.lit(kind).alias("kind"), name.alias("name"))))
    return rows.select("path", F.explode(F.array_compact(F.array(*found))).alias("x"), "line").select("path", "x.kind", "x.name", "line")


def symbol_id(path: Column, owner: Column, name: Column) -> Column:
    return F.concat(F.lit("symbol:"), path, F.lit("#"), F.concat_ws(".", owner, name))


def python_edges(facts: DataFrame) -> DataFrame:
    """Edges id, source, target, kind from Python facts: Contains (file or class to definition), Imports, Inherits, Calls."""
    file, own = F.concat(F.lit("artifact:"), "path"), symbol_id(F.col("path"), F.col("owner"), F.col("name"))
    holder = F.when(F.col("owner").isNull(), file).otherwise(F.concat(F.lit("symbol:"), "path", F.lit("#"), "owner"))
    kind = F.col("kind")
    contains = facts.where(kind.isin("Class", "Function", "Method")).select(F.lit("Contains").alias("kind"), holder.alias("source"), own.alias("target"))
    imports = facts.where(kind == "Import").select(F.lit("Imports").alias("kind"), file.alias("source"), F.concat(F.lit("unresolved:"), F.substring_index("name", ":", 1)).alias("target"))
    bases = facts.where((kind == "Class") & F.col("detail").isNotNull()).select(F.lit("Inherits").alias("kind"), own.alias("source"), F.explode(F.split("detail", ",")).alias("base"))
    inherits = bases.select("kind", "source", F.concat(F.lit("unresolved:"), "base").alias("target"))
    calls = facts.where(kind == "Call").select(F.lit("Calls").alias("kind"), holder.alias("source"), F.concat(F.lit("unresolved:"), "name").alias("target"))
    every = contains.unionByName(imports).unionByName(inherits).unionByName(calls).distinct()
    return every.select(F.concat_ws("|", "kind", "source", "target").alias("id"), "source", "target", "kind")


def graphql_fields(files: DataFrame) -> DataFrame:
    """path, line, type (Query, Mutation), field of GraphQL schemas: names at the first level of those types."""
    from pyspark.sql import Window

    rows = lines_of(files).withColumn("text", F.regexp_replace("text", "#.*$", ""))
    count = lambda c: F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))
    upto = Window.partitionBy("path").orderBy("line")
    depth = F.coalesce(F.sum(count("{") - count("}")).over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("depth", depth)
    opened = F.when(F.col("depth") == 0, F.nullif(F.regexp_extract("text", r"^\s*(?:extend\s+)?(?:type|input|enum|interface)\s+(\w+)", 1), F.lit("")))
    rows = rows.withColumn("type", F.last(opened, ignorenulls=True).over(upto))
    name = F.regexp_extract("text", r"^\s*(\w+)\s*(?:\(|:)", 1)
    return rows.where((F.col("depth") == 1) & F.col("type").isin("Query", "Mutation") & (name != "")).select("path", "line", "type", name.alias("field"))
