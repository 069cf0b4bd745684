"""Dependencies named in documents, and their merge with what a manifest says."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import section, trim

#: Standard modules of Python are asked of Python itself.
PYTHON_STDLIB = sorted(m for m in sys.stdlib_module_names if not m.startswith("_"))
# Modules that other languages bring along, and names of modules that are local by habit.
NODE_BUILTIN = (
    "assert async_hooks buffer child_process cluster console constants crypto dgram diagnostics_channel dns domain events fs http http2 https inspector module net os path "
    "perf_hooks process punycode querystring readline repl stream string_decoder sys timers tls trace_events tty url util v8 vm wasi worker_threads zlib"
).split()
RUST_STD = ["std", "core", "alloc", "crate", "self", "super", "proc_macro", "test"]
JAVA_STD = ["java.", "javax.", "jdk.", "sun.", "com.sun."]
LOCAL = ["mymodule", "my_module", "myapp", "my_app", "myproject", "my_project", "local", "utils", "helpers", "app", "main", "example", "models", "config", "settings"]


def safe_name(dep: Column) -> Column:
    """Whether a name has only the characters of package names and versions, and no hyphen in front."""
    return dep.rlike(r"\A[A-Za-z0-9_./\[\](),@:><=!~^-]+\z") & ~dep.startswith("-")


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def _none(deps: Column, names: list[str]) -> Column:
    return F.filter(deps, lambda d: ~d.isin(names))


def _install(text: Column, command: str) -> Column:
    """The words behind an install command, without flags, quotes and comments."""
    tails = F.transform(_all(text, rf"{command}\s+([^\n]+)"), lambda t: F.regexp_replace(t, r"(?:\A| )#.*", ""))
    words = F.flatten(F.transform(tails, lambda t: F.split(trim(t), r"\s+")))
    return F.filter(F.transform(words, lambda w: F.regexp_replace(w, "^[\"']+|[\"']+$", "")), lambda w: (w != "") & ~w.startswith("-"))


def _imports(text: Column) -> Column:
    return F.coalesce(section(text, r"Imports\s*$"), F.lit(""))


def python_dependencies(text: Column) -> Column:
    t = _imports(text)
    plain = _none(_all(t, r"(?m)^import\s+([a-zA-Z0-9_]+)"), PYTHON_STDLIB)
    froms = _none(_all(t, r"(?m)^from\s+([a-zA-Z0-9_]+)"), PYTHON_STDLIB + LOCAL)
    pip = F.filter(_install(t, r"pip\s+install"), lambda w: w.rlike(r"\A[a-zA-Z]"))
    return F.filter(F.array_distinct(F.concat(plain, froms, pip)), safe_name)


def node_package(name: Column) -> Column:
    """A package name without its subpath and version; scopes stay."""
    base = F.when(name.startswith("@"), F.regexp_extract(name, r"\A(@[^/]*/[^/]*|.*)", 1)).otherwise(F.regexp_extract(name, r"\A([^/]*)", 1))
    bare = F.regexp_extract(base, r"\A(.+)@[^@]*\z", 1)
    return F.when(name.startswith("@") & ~name.contains("/"), name).when(bare != "", bare).otherwise(base)


def node_dependencies(text: Column) -> Column:
    t = _imports(text)
    quoted = r"[\"']([^\"']+)[\"']"
    found = F.concat(_all(t, rf"import\s[^\"';]*?from\s+{quoted}"), _all(t, rf"(?m)^\s*import\s+{quoted}"), _all(t, rf"require\s*\(\s*{quoted}\s*\)"), _install(t, r"(?:npm\s+(?:install|i)|yarn\s+add|pnpm\s+add)"))
    outside = F.filter(found, lambda d: ~d.rlike(r"\A[./#]") & ~F.regexp_replace(d, r"\Anode:", "").isin(NODE_BUILTIN))
    return F.filter(F.array_distinct(F.transform(outside, node_package)), safe_name)


def go_dependencies(text: Column) -> Column:
    """Import paths with a domain, and what go get names."""
    t = _imports(text)
    paths = F.concat(_all(t, r"\"([A-Za-z0-9.-]+\.[A-Za-z]+/[^\"\s]+)\""), F.transform(_install(t, r"go\s+get"), lambda w: F.regexp_replace(w, "@.*", "")))
    return F.filter(F.array_distinct(paths), safe_name)


def rust_dependencies(text: Column) -> Column:
    t = _imports(text)
    used = _none(_all(t, r"(?m)^\s*(?:pub\s+)?(?:use|extern\s+crate)\s+([a-zA-Z0-9_]+)"), RUST_STD)
    return F.filter(F.array_distinct(F.concat(used, F.transform(_install(t, r"cargo\s+add"), lambda w: F.regexp_replace(w, "@.*", "")))), safe_name)


def java_dependencies(text: Column) -> Column:
    """Coordinates group:artifact[:version] of dependency elements and of Gradle lines."""
    t = _imports(text)
    tag = lambda d, n: trim(F.regexp_extract(d, rf"(?s)<{n}>(.*?)</{n}>", 1))
    xml = F.transform(_all(t, r"(?s)<dependency>.*?</dependency>", 0), lambda d: F.array_join(F.filter(F.array(tag(d, "groupId"), tag(d, "artifactId"), tag(d, "version")), lambda x: x != ""), ":"))
    gradle = _all(t, r"(?:implementation|api|compileOnly|testImplementation)\s*\(?\s*[\"']([^\"']+)[\"']")
    return F.filter(F.array_distinct(F.concat(xml, gradle)), lambda d: safe_name(d) & d.contains(":"))


BY_LANGUAGE = {"python": python_dependencies, "javascript": node_dependencies, "go": go_dependencies, "rust": rust_dependencies, "java": java_dependencies}


def dependencies(docs: DataFrame, lang: str, *, text: str = "text", into: str = "dependencies") -> DataFrame:
    """``docs`` with an array of the dependencies that the Imports section names, each once, in order of first mention."""
    return docs.withColumn(into, BY_LANGUAGE[lang](F.coalesce(F.col(text), F.lit(""))))


def normal(name: Column) -> Column:
    """A name as package indexes compare it: lower case, with runs of hyphens, underscores and full stops as one hyphen."""
    return F.regexp_replace(F.lower(name), "[-_.]+", "-")


def enrich(found: DataFrame, manifest: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """(key, name, raw_spec, source, pos): found dependencies with the manifest's specification where theirs is missing.

    Both sides are (key, pos, name, raw_spec). What only the manifest has is appended, in its order.
    """
    left = found.select(key, "pos", "name", "raw_spec", normal(F.col("name")).alias("__n")).alias("f")
    right = manifest.select(F.col(key).alias("__k"), F.col("pos").alias("__pos"), F.col("name").alias("__name"), F.col("raw_spec").alias("__spec"), normal(F.col("name")).alias("__m"))
    same = (F.col(f"f.{key}") == F.col("__k")) & (F.col("__n") == F.col("__m"))
    # a full outer join holds all pairs of a name at once; these two hold what one row meets
    joined = left.join(right, same, "left").unionByName(right.join(left, same, "left_anti"), allowMissingColumns=True)
    return joined.select(
        F.coalesce(key, "__k").alias(key), F.coalesce("name", "__name").alias("name"), F.coalesce("raw_spec", "__spec").alias("raw_spec"),
        F.when(F.col("name").isNull(), "manifest").otherwise("pattern").alias("source"), F.coalesce(F.col("pos"), F.lit(1_000_000) + F.col("__pos")).alias("pos"),
    )


def without_self(deps: DataFrame, package: str, *, name: str = "name") -> DataFrame:
    """Dependencies other than the package itself."""
    return deps.filter(normal(F.regexp_replace(F.col(name), r"\[.*|[><=!~^].*", "")) != normal(F.lit(package)))


def module_of(imports: DataFrame, modules: DataFrame, *, dep: str = "dep", module: str = "module") -> DataFrame:
    """``imports`` with ``module``: of the Go modules in ``modules`` the longest that is the import's path or holds it; null if none does.

    What stands below a major version (``m/v2``, ``m/v2/sub``) is another module than ``m``; ``m/v2client`` is a package of ``m``. A path is held against
    its own beginnings, a few for each import, so the join is one of equal keys. Null imports have no module; modules may repeat.
    """
    steps = F.split(F.col(dep), "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.struct(F.array_join(F.slice(steps, 1, n), "/").alias("head"), F.get(steps, n).alias("below"), n.alias("length")))
    paths = imports.select(dep).distinct().filter(F.col(dep).isNotNull()).select(F.col(dep).alias("__dep"), F.explode(heads).alias("h"))
    inside = paths.filter(~F.coalesce(F.col("h.below").rlike(r"\Av[0-9]+\z"), F.lit(False)))
    known = modules.select(F.col(module).alias("__module")).distinct()
    best = inside.join(known, F.col("h.head") == F.col("__module")).groupBy("__dep").agg(F.max_by("__module", "h.length").alias(module))
    return imports.join(best, imports[dep] == best["__dep"], "left").drop("__dep")


def needs_replace(imports: DataFrame, modules: DataFrame, *, key: str = "repo", dep: str = "dep", module: str = "module") -> DataFrame:
    """(key, module, needs_replace) of ``modules`` (key, module): whether any import of the same key is of the module."""
    pairs = modules.select(key, module).distinct()
    found = imports.select(key, dep).join(pairs, key)  # a repository has few modules
    rest = F.substr(F.col(dep), F.length(module) + 2)
    inside = (F.col(dep) == F.col(module)) | (F.startswith(F.col(dep), F.concat(F.col(module), F.lit("/"))) & ~rest.rlike(r"\Av[0-9]+(?:/|\z)"))
    hit = found.filter(inside).select(key, module).distinct().withColumn("__hit", F.lit(True))
    return pairs.join(hit, [key, module], "left").select(key, module, F.coalesce("__hit", F.lit(False)).alias("needs_replace"))
