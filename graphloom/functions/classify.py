"""What a file is, by its path, size and text: test and secret paths, formats, analyzers, layers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names and endings of test files, of files with secrets, and of build and data files.
TEST_FOLDERS = ("test", "tests", "__tests__", "spec", "specs")
TEST_PREFIXES = ("test_", "spec_")
TEST_ENDINGS = (
    "_test.rs", "_tests.rs", ".test.rs", ".spec.rs", ".test.ts", ".spec.ts", ".test.tsx", ".spec.tsx",
    ".test.js", ".spec.js", ".test.jsx", ".spec.jsx", ".e2e-spec.ts", ".e2e.ts",
)
AUXILIARY = ("docs", "examples", "example", "benches", "benchmark", "benchmarks", "sample", "samples", "integration", "e2e")
SECRET_NAMES = (".env", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519", ".npmrc", ".pypirc", "credentials", "credentials.json", "secrets.yml", "secrets.yaml")
SECRET_ENDINGS = (".pem", ".key", ".p12", ".pfx")
SECRET_PARTS = ("/.aws/credentials", "/.config/gcloud/")
GENERATED = (
    "DO NOT EDIT", "DO NOT MODIFY", "@generated", "Code generated by", "Generated by the protocol buffer compiler",
    "autogenerated", "auto-generated", "This file was automatically generated",
)
HEAD_BYTES, MOST_BYTES, VENDORED = 2_048, 1_000_000, 100
#: (name, category, format, tier, analyzer)
EXACT = (
    ("Dockerfile", "ContainerDefinition", "dockerfile", "StructuredFormat", "Structured"),
    ("Makefile", "BuildDefinition", "makefile", "GenericText", "GenericText"),
    ("Justfile", "BuildDefinition", "justfile", "GenericText", "GenericText"),
    ("justfile", "BuildDefinition", "justfile", "GenericText", "GenericText"),
    ("Jenkinsfile", "ContinuousIntegration", "jenkinsfile", "GenericText", "GenericText"),
    ("LICENSE", "Documentation", "license", "GenericText", "GenericText"),
    ("NOTICE", "Documentation", "notice", "GenericText", "GenericText"),
    ("Cargo.toml", "PackageManifest", "toml", "StructuredFormat", "Structured"),
    ("pyproject.toml", "PackageManifest", "toml", "StructuredFormat", "Structured"),
    ("requirements.txt", "PackageManifest", "requirements-txt", "GenericText", "Specialized"),
    ("docker-compose.yml", "ContainerDefinition", "docker-compose", "StructuredFormat", "Structured"),
    ("docker-compose.yaml", "ContainerDefinition", "docker-compose", "StructuredFormat", "Structured"),
    ("compose.yml", "ContainerDefinition", "docker-compose", "StructuredFormat", "Structured"),
    ("compose.yaml", "ContainerDefinition", "docker-compose", "StructuredFormat", "Structured"),
    ("package.json", "PackageManifest", "npm", "StructuredFormat", "Specialized"),
    ("package-lock.json", "DependencyLockfile", "lockfile", "StructuredFormat", "Structured"),
    ("npm-shrinkwrap.json", "DependencyLockfile", "lockfile", "StructuredFormat", "Structured"),
    ("go.mod", "PackageManifest", "go-mod", "StructuredFormat", "Specialized"),
    ("composer.json", "PackageManifest", "composer", "StructuredFormat", "Specialized"),
    ("pom.xml", "PackageManifest", "maven", "StructuredFormat", "Specialized"),
    ("build.gradle", "PackageManifest", "gradle", "StructuredFormat", "Specialized"),
    ("build.gradle.kts", "PackageManifest", "gradle", "StructuredFormat", "Specialized"),
)
#: The languages that the engine knows by extension: (name, extensions, category, tier, analyzer). A table of one's own may be joined instead.
LANGUAGES = (
    ("python", "py pyi", "SourceCode", "DeepLanguage", "Specialized"),
    ("rust", "rs", "SourceCode", "DeepLanguage", "Specialized"),
    ("typescript", "ts mts cts", "SourceCode", "DeepLanguage", "Specialized"),
    ("tsx", "tsx", "SourceCode", "DeepLanguage", "Specialized"),
    ("javascript", "js mjs cjs jsx", "SourceCode", "GenericText", "SyntaxIndexed"),
    ("go", "go", "SourceCode", "GenericText", "SyntaxIndexed"),
    ("java", "java", "SourceCode", "GenericText", "SyntaxIndexed"),
    ("kotlin", "kt kts", "SourceCode", "GenericText", "SyntaxIndexed"),
    ("c", "c h", "SourceCode", "GenericText", "SyntaxIndexed"),
    ("cpp", "cc cpp cxx hpp", "SourceCode", "GenericText", "SyntaxIndexed"),
    ("csharp", "cs", "SourceCode", "GenericText", "SyntaxIndexed"),
    ("ruby", "rb", "SourceCode", "GenericText", "SyntaxIndexed"),
    ("php", "php", "SourceCode", "GenericText", "SyntaxIndexed"),
    ("swift", "swift", "SourceCode", "GenericText", "SyntaxIndexed"),
    ("scala", "scala", "SourceCode", "GenericText", "SyntaxIndexed"),
    ("shell", "sh bash zsh", "Script", "GenericText", "SyntaxIndexed"),
    ("sql", "sql", "SourceCode", "GenericText", "GenericText"),
    ("protobuf", "proto", "ApiSchema", "GenericText", "Specialized"),
    ("graphql", "graphql gql", "ApiSchema", "GenericText", "Specialized"),
    ("markdown", "md markdown", "Documentation", "StructuredFormat", "Structured"),
    ("yaml", "yml yaml", "Configuration", "StructuredFormat", "Structured"),
    ("json", "json", "Configuration", "StructuredFormat", "Structured"),
    ("toml", "toml", "Configuration", "StructuredFormat", "Structured"),
    ("html", "html htm", "SourceCode", "GenericText", "GenericText"),
    ("css", "css scss less", "SourceCode", "GenericText", "GenericText"),
    ("text", "txt rst adoc", "Documentation", "GenericText", "GenericText"),
)
IMAGES, BINARIES = ("png", "jpg", "jpeg", "gif", "webp", "ico"), ("bin", "dat", "wasm", "so", "dylib", "dll", "exe")


def _any_of(parts: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(parts, F.array(*map(F.lit, names)))


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _or(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def file_extension(path: Column) -> Column:
    """What stands behind the last dot of a name that does not begin with it; null without one."""
    found = F.regexp_extract(_name(path), r"^.+\.([^.]*)$", 1)
    return F.when(_name(path).rlike(r"^.+\."), found)


def is_test_file(path: Column) -> Column:
    """A test folder on the way, or a name with a test prefix or ending."""
    name = _name(path)
    return _any_of(F.split(path, "/"), TEST_FOLDERS) | _or([name.startswith(p) for p in TEST_PREFIXES] + [name.endswith(e) for e in TEST_ENDINGS])


def is_auxiliary_file(path: Column) -> Column:
    return is_test_file(path) | _any_of(F.split(path, "/"), AUXILIARY)


def is_secret_path(path: Column) -> Column:
    """Files that hold secrets by their name: only what is known without reading them is kept."""
    name, low = F.lower(_name(path)), F.lower(path)
    return name.isin(*SECRET_NAMES) | name.startswith(".env.") | _or([name.endswith(e) for e in SECRET_ENDINGS] + [low.contains(p) for p in SECRET_PARTS])


def head(text: Column, size: int = HEAD_BYTES) -> Column:
    """The first bytes of a text, to the last whole character."""
    return F.try_validate_utf8(F.regexp_replace(F.substring(text.cast("binary"), 1, size).cast("string"), "�+$", ""))


def is_generated_text(text: Column) -> Column:
    """A marker in the first bytes (in any case), or the structure of a framework's migration."""
    top = F.coalesce(F.when(F.octet_length(text) <= HEAD_BYTES, text).otherwise(head(text)), F.lit(""))

    def marked(t: Column) -> Column:
        alembic = t.contains("down_revision") & t.contains("def upgrade(") & t.rlike(r"(?m)^[ \t]*revision")
        by_tool = let(F.lower(t), lambda low: _or([low.contains(m.lower()) for m in GENERATED]))
        return by_tool | alembic | t.contains("class Migration(migrations.Migration)")

    return let(top, marked)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda's variable is not replaced by what it stands for."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def language_table(spark: SparkSession) -> DataFrame:
    """extension, language, category, tier, analyzer: the languages that are known without a table of one's own."""
    rows = [(e, name, category, tier, how) for name, extensions, category, tier, how in LANGUAGES for e in extensions.split()]
    return spark.createDataFrame(rows, "extension string, language string, category string, tier string, analyzer string")


FIELDS = ("category", "format", "tier", "analyzer", "policy")


def classified(files: DataFrame, languages: DataFrame | None = None, binary: Column | None = None, path: str = "path", text: str = "content", size: str = "size_bytes") -> DataFrame:
    """files with category, format, tier, analyzer, policy, generated_score, vendored_score; columns of those names are replaced.

    The first rule that fits: exact name, place of the path, extension, first line, content; then a fallback. Where the file
    comes from (generated, vendored) is scored after that. Then the gates: secret paths are never read, large and vendored files
    are opaque. Names and extensions are looked up in small tables by joins: the fixed one of names is broadcast, and a table of
    languages of one's own (extension, language, category, tier, analyzer) is broadcast if Spark finds it small. A null path has
    no name: its text decides.
    """
    spark = files.sparkSession
    name, ext = F.element_at(F.split(path, "/"), -1), file_extension(F.col(path))
    known = F.broadcast(spark.createDataFrame(EXACT, "_name string, category string, format string, tier string, analyzer string"))
    by_name = known.select("_name", F.struct("category", "format", "tier", "analyzer", F.when(F.col("format") == "lockfile", "ExcerptOnly").otherwise("Allowed").alias("policy")).alias("_exact"))
    kinds = language_table(spark) if languages is None else languages
    kinds = F.broadcast(kinds) if languages is None else kinds
    by_extension = kinds.select(F.col("extension").alias("_ext"), F.struct("category", F.col("language").alias("format"), "tier", "analyzer", F.lit("Allowed").alias("policy")).alias("_language"))
    keyed = files.drop(*FIELDS, "generated_score", "vendored_score").withColumns({"_name": name, "_ext": ext})
    keyed = keyed.join(by_name, "_name", "left").join(by_extension, "_ext", "left")
    found = let(F.struct(F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(size).alias("size"), "_ext", "_exact", "_language",
                          (F.lit(False) if binary is None else binary).alias("binary")), _first_rule)
    return keyed.withColumn("_found", found).select(*[c for c in keyed.columns if c[0] != "_"], "_found.*")


def _first_rule(file: Column) -> Column:
    path, ext, exact, language, binary = (file[k] for k in ("path", "_ext", "_exact", "_language", "binary"))
    parts = F.split(path, "/")

    def rule(category: str, form: Column | str | None, tier: str, analyzer: str, policy: str = "Allowed") -> Column:
        form = F.lit(form) if isinstance(form, str) or form is None else form
        values = (F.lit(category), form.cast("string"), F.lit(tier), F.lit(analyzer), F.lit(policy))
        return F.struct(*[v.alias(k) for k, v in zip(FIELDS, values)])

    plain = ("GenericText", "GenericText")
    first = F.regexp_extract(file["text"], r"^[^\r\n]*", 0)
    start = F.ltrim(F.substring(file["text"], 1, HEAD_BYTES))
    fixture = path.contains("tests/fixtures/") | path.contains("test/fixtures/")
    asset = ext.isin("svg", *IMAGES)
    of_migration = F.struct(F.lit("DatabaseMigration").alias("category"), *[language[k].alias(k) for k in FIELDS[1:]])
    cases = (
        (exact.isNotNull(), exact),
        (path.startswith(".github/workflows/"), rule("ContinuousIntegration", "github-actions", "StructuredFormat", "Structured")),
        (F.array_contains(parts, "migrations"), F.when(language.isNotNull(), of_migration).otherwise(rule("DatabaseMigration", ext, *plain))),
        (fixture & binary, rule("BinaryAsset", F.coalesce(ext, F.lit("binary")), "Opaque", "Opaque", "Never")),
        (fixture, rule("TestData", ext, *plain, "ExcerptOnly")),
        (ext == "lock", rule("DependencyLockfile", "lockfile", "StructuredFormat", "Structured", "ExcerptOnly")),
        (asset & binary, rule("StaticAsset", ext, "Opaque", "Opaque", "Never")),
        (asset, rule("StaticAsset", ext, *plain, "ExcerptOnly")),
        (ext.isin(*BINARIES), rule("BinaryAsset", ext, "Opaque", "Opaque", "Never")),
        (ext == "csproj", rule("PackageManifest", "csproj", "StructuredFormat", "Specialized")),
        (language.isNotNull(), language),
        (first.startswith("#!") & first.contains("python"), rule("SourceCode", "python", "DeepLanguage", "Specialized")),
        (first.startswith("#!") & first.contains("sh"), rule("Script", "shell", *plain)),
        (first.startswith("#!"), rule("Script", "script", *plain)),
        (start.startswith("FROM ") | start.startswith("ARG "), rule("ContainerDefinition", "dockerfile", "StructuredFormat", "Structured")),
        (start.startswith("<svg") | (start.startswith("<?xml") & file["text"].contains("<svg")), rule("StaticAsset", "svg", *plain, "ExcerptOnly")),
        (binary, rule("UnknownBinary", ext, "Opaque", "Opaque", "Never")),
    )
    out = rule("UnknownText", None, *plain)
    for condition, choice in reversed(cases):
        out = F.when(condition, choice).otherwise(out)
    generated = F.coalesce(F.array_contains(parts, "generated"), F.lit(False)) | is_generated_text(file["text"])
    vendored = F.coalesce(_any_of(parts, ("vendor", "third_party", "third-party")), F.lit(False))
    facts = F.struct(out.alias("rule"), generated.alias("generated"), vendored.alias("vendored"), F.coalesce(is_secret_path(path), F.lit(False)).alias("secret"))
    return let(facts, lambda x: _gated(x, file))


def _gated(x: Column, file: Column) -> Column:
    rule, secret, vendored = x["rule"], x["secret"], x["vendored"] & ~x["generated"]
    opaque = F.coalesce(file["size"] > MOST_BYTES, F.lit(False)) | vendored
    policy = F.when(file["binary"], "Never").otherwise(rule["policy"])
    return F.struct(
        F.when(x["generated"], "GeneratedSource").otherwise(rule["category"]).alias("category"),
        rule["format"].alias("format"),
        F.when(secret | opaque, "Opaque").otherwise(rule["tier"]).alias("tier"),
        F.when(secret | opaque, "Opaque").otherwise(rule["analyzer"]).alias("analyzer"),
        F.when(secret, "Never").when(opaque & (policy == "Allowed"), "ExcerptOnly").otherwise(policy).alias("policy"),
        F.when(x["generated"], 100).otherwise(0).alias("generated_score"),
        F.when(vendored, VENDORED).otherwise(0).alias("vendored_score"),
    )


def skip_reason(excluded_by_model: Column, binary: Column, redacted: Column, excluded: Column, size: Column, text: Column) -> Column:
    """Why a file is not cut into chunks, the first reason that holds; null if it is."""
    return (
        F.when(excluded_by_model, "ModelExcluded").when(binary, "Binary").when(redacted, "Redacted").when(excluded, "Excluded")
        .when(size >= MOST_BYTES, "OverLimit").when(F.trim(F.coalesce(text, F.lit(""))) == "", "Empty")
    )


def analyzer(path: Column, form: Column, selection: Column) -> Column:
    """Which extractor reads a file."""
    name = F.lower(_name(path))
    environment = (name == ".env") | name.startswith(".env.") | name.endswith(".properties")
    deep = {"python": "Python", "rust": "Rust", "typescript": "TypeScript", "tsx": "TypeScript", "requirements-txt": "Requirements", "protobuf": "Protocol", "graphql": "Protocol"}
    out = F.when(environment, "Environment")
    for key, kind in deep.items():
        out = out.when((selection == "Specialized") & (form == key), kind)
    out = out.when(selection == "Specialized", "PackageManifest")
    for key, kind in {"dockerfile": "Dockerfile", "markdown": "Markdown", "docker-compose": "Compose", "github-actions": "Actions"}.items():
        out = out.when((selection == "Structured") & (form == key), kind)
    out = out.when((selection == "Structured") & (_name(path) == "Cargo.toml"), "Cargo").when((selection == "Structured") & (_name(path) == "pyproject.toml"), "PyProject")
    out = out.when((selection == "Structured") & form.isin("yaml", "json", "toml"), "Structured")
    return out.when(selection == "SyntaxIndexed", "SyntaxIndexed").when(selection == "GenericText", "GenericText")


def command_provenance(path: Column, category: Column) -> Column:
    """Where a command was found: an example in documentation, build automation, or something that runs."""
    docs = F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*map(F.lit, ("doc", "docs", "documentation"))))
    automation = category.isin("BuildDefinition", "ContinuousIntegration")
    return F.when((category == "Documentation") | docs, "DocumentationExample").when(automation, "BuildAutomation").otherwise("Executable")
