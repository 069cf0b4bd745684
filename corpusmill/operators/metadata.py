"""Licences, versions, languages and file priorities from texts, manifests and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, byte_prefix, lines, trim

LICENCE_BYTES = 600
#: Pre-release suffixes, major, minor and patch of a tag such as v1.2.3-rc1.
_SEMVER = r"\Av?\+?([0-9]{1,9})\.([0-9]{1,9})([^.0-9][^.]*)?(?:\.([0-9]{1,9})([^.0-9][^.]*)?(\..*)?)?\z"


def classify_licence(text: Column) -> Column:
    """The SPDX identifier that the first 600 bytes of a licence text tell, or null."""
    p = F.lower(byte_prefix(text, LICENCE_BYTES))
    has = lambda *ws: [p.contains(w) for w in ws]
    endorse = has("neither the name of", "may be used to endorse or promote")
    mit, grant = has("mit license", "permission is hereby granted, free of charge")
    apache, two = has("apache license", "version 2")
    bsd2, bsd3, bsd, mpl, gpl, v3, un, isc = has(
        "bsd 2-clause", "bsd 3-clause", "redistribution and use in source and binary", "mozilla public license", "gnu general public license", "version 3", "unlicense", "isc license"
    )
    return (
        F.when(mit | grant, "MIT").when(apache & two, "Apache-2.0").when(bsd2, "BSD-2-Clause").when(bsd3, "BSD-3-Clause")
        .when(bsd & (endorse[0] | endorse[1]), "BSD-3-Clause").when(bsd, "BSD-2-Clause").when(mpl, "MPL-2.0").when(gpl & v3, "GPL-3.0").when(gpl, "GPL-2.0")
        .when(un, "Unlicense").when(isc, "ISC")
    )


def version_token(text: Column) -> Column:
    """The first word that is 2 to 4 numbers joined by full stops, the first below 100, without other marks around it; or null."""
    clean = F.transform(F.split(text, rf"{SPACE}+"), lambda w: F.regexp_replace(w, r"\A[^\p{N}.]+|[^\p{N}.]+\z", ""))
    fits = lambda w: w.rlike(r"\A\p{N}+(?:\.\p{N}+){1,3}\z") & (F.regexp_extract(w, r"\A0*([0-9]{1,9})\.", 1).try_cast("int") < 100)
    return F.when(text.rlike(r"\p{N}\.\p{N}"), F.get(F.filter(clean, lambda w: F.coalesce(fits(w), F.lit(False))), F.lit(0)))


def changelog_version(text: Column) -> Column:
    """The version of the first heading-like line within the first 3000 characters and 100 lines of a changelog."""
    ls = F.slice(lines(F.substring(text, 1, 3000)), 1, 100)
    heading = F.filter(F.transform(ls, trim), lambda x: x.rlike(r"\A(?:#|\[|[Vv]ersion|[Vv]?[0-9]+\.[0-9])"))
    return F.get(F.filter(F.transform(heading, version_token), lambda v: v.isNotNull()), F.lit(0))


def semver(tag: Column) -> Column:
    """Struct of major, minor, patch and prerelease of a tag, or null. Four numbers are no version."""
    part = lambda i: F.regexp_extract(tag, _SEMVER, i)
    pre = (part(3) != "") | (part(5) != "")
    ok = tag.rlike(_SEMVER) & (pre | (part(6) == ""))
    number = lambda i: F.coalesce(F.nullif(part(i), F.lit("")), F.lit("0")).cast("int")
    return F.when(ok, F.struct(number(1).alias("major"), number(2).alias("minor"), number(4).alias("patch"), pre.alias("prerelease")))


def newest_first(tags: DataFrame, tag: str = "tag") -> list[Column]:
    """Sort keys: versions newest first, a stable one before its pre-releases, then other tags in reverse order."""
    v = semver(F.col(tag))
    return [v.isNull(), F.desc(v["major"]), F.desc(v["minor"]), F.desc(v["patch"]), v["prerelease"], F.desc(tag)]


def described(tags: DataFrame, described_: DataFrame, repo: str = "repo", name: str = "described", tag: str = "tag") -> DataFrame:
    """Described revisions without their ``-N-gHASH`` suffix, where the tag before it exists in ``tags``."""
    bare = F.regexp_replace(F.col(name), r"-[0-9]+-g[0-9a-f]+\z", "")
    known = tags.select(repo, F.col(tag).alias("__tag")).distinct()
    d = described_.withColumn("__bare", bare)
    joined = d.join(known, (d[repo] == known[repo]) & (d["__bare"] == known["__tag"]), "left").drop(known[repo])
    return joined.withColumn(name, F.when(F.col("__tag").isNotNull(), F.col("__bare")).otherwise(F.col(name))).drop("__bare", "__tag")


LANGUAGES = {
    "python": ["py", "python"], "javascript": ["js", "javascript", "ts", "typescript", "node", "nodejs", "npm"], "rust": ["rs", "rust", "cargo"], "go": ["go", "golang"],
    "java": ["java", "jvm", "maven", "gradle", "kotlin"],
}


def language(name: Column) -> Column:
    """A language by one of its names, or null."""
    n = F.lower(trim(name))
    out = F.lit(None).cast("string")
    for lang, names in LANGUAGES.items():
        out = F.when(n.isin(names), lang).otherwise(out)
    return out


def detect_language(files: DataFrame, repo: str = "repo", path: str = "path") -> DataFrame:
    """(repo, language): by the first marker file in the root of each repository; null without one."""
    marks = [("python", ["pyproject.toml", "setup.py"]), ("rust", ["Cargo.toml"]), ("javascript", ["package.json"]), ("go", ["go.mod"]), ("java", ["pom.xml", "build.gradle", "build.gradle.kts"])]
    rank = F.lit(None).cast("int")
    for i, (_, names) in reversed(list(enumerate(marks))):
        rank = F.when(F.col(path).isin(names), i).otherwise(rank)
    best = files.groupBy(repo).agg(F.min(rank).alias("__r"))
    return best.select(repo, F.when(F.col("__r").isNotNull(), F.element_at(F.array(*[F.lit(x) for x, _ in marks]), F.col("__r") + 1)).alias("language"))


def toml_field(text: Column, table: str, key: str) -> Column:
    """A quoted value of a key in one table of a manifest, read line by line; null without it."""
    body = F.regexp_extract(text, rf"(?dms)^\s*\[{table}\][ \t]*(?:#[^\n]*)?$(.*?)(?=^\s*\[|\z)", 1)
    return F.nullif(F.regexp_extract(body, rf"(?dm)^\s*{key}\s*=\s*[\"']([^\"'\n]*)[\"']", 1), F.lit(""))


def package_json(text: Column) -> Column:
    """Struct of name, version, license, homepage and repository of a package.json; null where it isn't JSON."""
    v = F.try_parse_json(text)
    get = lambda p: F.try_variant_get(v, p, "string")
    return F.when(
        v.isNotNull(),
        F.struct(
            get("$.name").alias("name"), get("$.version").alias("version"), F.coalesce(get("$.license.type"), get("$.license")).alias("license"),
            get("$.homepage").alias("homepage"), F.coalesce(get("$.repository.url"), get("$.repository")).alias("repository"),
        ),
    )


def go_module(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?dm)^module\s+(\S+)", 1), F.lit(""))


def without_major(module: Column) -> Column:
    """A Go module path without a trailing /vN of 2 or more."""
    return F.regexp_replace(module, r"/v(?:[2-9]|[1-9][0-9]+)\z", "")


def xml_tag(text: Column, tag: str) -> Column:
    return F.when(text.contains(f"<{tag}>"), trim(F.regexp_extract(text, rf"(?s)<{tag}>(.*?)</{tag}>", 1)))


def file_priority(path: Column) -> Column:
    """How early a source file is read, lower first, from its path within the repository."""
    parts = F.split(path, "/")
    depth, name = F.size(parts), F.element_at(parts, -1)
    inner = F.arrays_overlap(parts, F.array(*map(F.lit, ["_internal", "_impl", "test", "testing", "tests", "benchmarks", "tools", "scripts"])))
    return (
        F.when(inner, 100).when((name == "__init__.py") & (depth == 2), 0).when((name == "__init__.py") & (depth > 2), 10).when(name.startswith("_"), 100)
        .when(depth == 2, 20).when(depth == 3, 30).otherwise(50)
    )


def file_role(path: Column) -> Column:
    """source, test, example, doc or changelog of a path, by its folders and name; null for folders nobody reads."""
    low = F.lower(path)
    parts = F.split(low, "/")
    name = F.element_at(parts, -1)
    under = lambda *names: F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, names)))
    ext = name.rlike(r"\.(?:py|pyi|rs|go|js|jsx|ts|tsx|mjs|cjs|java|kt)\z")
    test = under("test", "tests", "__tests__", "testdata", "testing") | name.rlike(r"\Atest_|_test\.(?:py|go|rs)\z|\.(?:test|spec)\.[cm]?[jt]sx?\z|tests?\.java\z")
    return (
        F.when(under("node_modules", "target", "vendor", "dist", "build", ".git", "__pycache__", ".venv", "venv", "site-packages"), F.lit(None))
        .when(name.rlike(r"\A(?:changelog|changes|history|news|releases?)(?:\.(?:md|rst|txt))?\z"), "changelog")
        .when(ext & under("example", "examples", "samples"), "example").when(ext & test, "test")
        .when(name.rlike(r"\Areadme") | under("doc", "docs") & name.rlike(r"\.(?:md|rst|txt)\z"), "doc").when(ext, "source")
    )


def native_indicators(path: Column, text: Column) -> Column:
    """What a file tells of native code: C extensions, cgo, -sys crates, build scripts and node-gyp."""
    name = F.element_at(F.split(path, "/"), -1)
    tell = lambda cond, what: F.when(cond, F.lit(what))
    return F.array_compact(
        F.array(
            tell((name == "setup.py") & text.rlike(r"\b(?:ext_modules|Extension\(|cffi_modules|cythonize)"), "python extension"),
            tell((name == "pyproject.toml") & text.rlike(r"\b(?:maturin|setuptools-rust|cython|scikit-build|meson-python)\b"), "native build backend"),
            tell(name.endswith(".go") & F.substring(text, 1, 4096).contains('import "C"'), "cgo"),
            tell((name == "Cargo.toml") & text.rlike(r"(?dm)^\s*[A-Za-z0-9_-]+-sys\s*="), "sys crate"),
            tell((name == "Cargo.toml") & text.rlike(r"(?dm)^\s*links\s*="), "links"),
            tell(name == "build.rs", "build script"),
            tell((name == "binding.gyp") | (name == "package.json") & text.rlike(r"node-gyp|prebuild-install|node-addon-api"), "node-gyp"),
        )
    )
