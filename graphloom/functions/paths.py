"""Path predicates and classes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path components, by layer in the order in which rules are tried.
LAYERS = (
    ("Test", ("test", "tests", "__tests__", "spec", "specs", "fixtures", "testdata")),
    ("Infra", ("infra", "infrastructure", "deploy", "deployment", "docker", "k8s", "kubernetes", "terraform", "ci", ".github", "scripts")),
    ("Data", ("data", "db", "database", "repositories", "repository", "migrations", "dao", "schema", "schemas")),
    ("Api", ("api", "routes", "route", "controllers", "controller", "handlers", "handler", "endpoints", "rpc", "graphql")),
    ("Ui", ("ui", "components", "component", "views", "view", "pages", "page", "frontend", "web", "templates", "template")),
    ("Domain", ("domain", "models", "model", "entities", "entity", "services", "service", "core")),
)


def components(path: Column) -> Column:
    return F.filter(F.split(F.lower(path), "/"), lambda p: p != "")


def _any(parts: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(parts, F.array(*map(F.lit, names)))


def layer(path: Column) -> Column:
    """The first layer one of whose words is a component, the file's stem, or starts or ends its name with _, - or a dot between."""
    parts = components(path)
    out = F.lit("Unknown")
    for name, words in reversed(LAYERS):
        choice = "|".join(w.replace(".", r"\.") for w in words)
        stem = F.lower(path).rlike(rf"(^|/)({choice})[_\-.][^/]*$|(^|/)[^/]*[_\-]({choice})(\.[^/]*)?$|(^|/)({choice})\.[^/]*$")
        out = F.when(_any(parts, words) | stem, F.lit(name)).otherwise(out)
    return out


def layer_of(path: Column, category: Column, has_route: Column) -> Column:
    """The layer by path, else by the file's category, else Api for a file with a route."""
    by_category = (
        F.when(category.isin("ContainerDefinition", "ContinuousIntegration", "BuildDefinition"), "Infra").when(category == "DatabaseMigration", "Data")
        .when(category == "ApiSchema", "Api").when(category == "TestData", "Test")
    )
    return F.coalesce(F.nullif(layer(path), F.lit("Unknown")), by_category, F.when(has_route, "Api").otherwise("Unknown"))


def glob_pattern(glob: str) -> str:
    """A glob as a pattern for the whole path: * and ? (also over folders), [..], {a,b}; one that is broken is an error."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 2
        elif c == "*":
            out, i = out + ".*", i + (glob[i : i + 2] == "**")
        elif c == "?":
            out += "."
        elif c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                raise ValueError(f"a class is not closed: {glob!r}")
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]"
            i = end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += "\\" + c if not c.isalnum() and c not in "_/" else c
        i += 1
    if depth:
        raise ValueError(f"alternatives are not closed: {glob!r}")
    return f"^{out}$"


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^/.]+)$", 1))


def resolved(base: Column, relative: Column) -> Column:
    """relative from the folder of base, with . and .. worked out; .. at the top stays there."""
    parts = F.split(F.when(relative.startswith("/"), relative).otherwise(F.concat_ws("/", parent(base), relative)), "/")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p.isin("", "."), acc).when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)),
    )
    return F.array_join(kept, "/")
