"""What manifests tell of a package: names, versions, licences and addresses, for each language by its own order of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE
from .metadata import classify_licence, go_module, newest_first, package_json, toml_field, without_major, xml_tag

# Parts of a POM behind which a package says nothing of itself, parts with addresses of their own, names of licence files, and versions that are none.
SECTIONS = "dependencies dependencyManagement build profiles reporting".split()
NESTED = "organization licenses developers contributors mailingLists issueManagement ciManagement distributionManagement properties repositories pluginRepositories scm".split()
LICENCE_FILES = ["LICENSE", "LICENSE.md", "LICENSE.txt", "LICENCE", "LICENCE.md", "COPYING"]
PLACEHOLDERS = ["dev", "development", "unversioned", "unknown", "unknown-dev", "unknown-version", "(untracked)", "library-import", "0.0.0-unset", "0.0.0"]


def _present(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _until(text: Column, tags: list[str]) -> Column:
    """The text before the first of some opening tags."""
    return F.regexp_extract(text, rf"(?s)\A(.*?)(?:<(?:{'|'.join(tags)})>|\z)", 1)


def pom(text: Column) -> Column:
    """Struct of artifact, version, licence, url and scm of a POM's own part; nulls where its parent is not closed or comes behind other sections."""
    clean = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    has_parent, closed = clean.contains("<parent>"), clean.contains("</parent>")
    after = F.when(closed, F.regexp_extract(clean, r"(?s)\A.*?</parent>(.*)\z", 1)).otherwise(clean)
    whole = ~(has_parent & ~closed) & ~(closed & ~F.concat(_until(clean, SECTIONS), F.lit(" ")).contains("</parent>"))
    before = F.when(has_parent, _until(clean, [*SECTIONS, "parent"]))
    literal = lambda c: F.when(~c.startswith("${"), _present(c))
    own = lambda tag: F.when(whole, F.coalesce(literal(xml_tag(before, tag)), literal(xml_tag(_until(after, SECTIONS), tag))))
    section = lambda tag: F.regexp_extract(clean, rf"(?s)<{tag}>(.*?)</{tag}>", 1)
    scm = F.coalesce(xml_tag(section("scm"), "url"), xml_tag(section("scm"), "connection"))
    return F.struct(
        own("artifactId").alias("artifact"), own("version").alias("version"), _present(xml_tag(section("licenses"), "name")).alias("licence"),
        _present(F.when(whole, xml_tag(_until(after, SECTIONS + NESTED), "url"))).alias("url"), F.regexp_replace(scm, "^scm:[^:]*:", "").alias("scm"),
    )


#: A quoted value with nothing but a comment behind it.
_QUOTED = r"(?:\(\s*)?['\"]([^'\"\n]+)['\"]\s*\)?\s*(?://[^\n]*|/\*[^\n]*?\*/\s*)?$"


def gradle(text: Column) -> Column:
    """Struct of name, version and group of a Gradle build or settings file."""
    line = lambda word: _present(F.regexp_extract(text, rf"(?dm)^[ \t]*{word}(?:\.set)?[ \t]*=?[ \t]*{_QUOTED}", 1))
    return F.struct(F.coalesce(line(r"(?:base\.)?archives(?:Base)?Name"), line(r"rootProject\.name")).alias("name"), line("version").alias("version"), line("group").alias("group"))


def go_constant(text: Column) -> Column:
    """A version that Go source gives as one string or as three numbers; placeholders are none."""
    one = F.regexp_replace(_present(F.regexp_extract(text, r'(?i)version\s*=\s*"(v?\d+\.\d+[^"]*)"', 1)), "^v", "")
    part = lambda name: _present(F.regexp_extract(text, rf"(?i)\b(?:{name})\s*[=:]\s*(\d+)", 1))
    three = F.concat_ws(".", part("Major"), part("Minor"), F.coalesce(part("Patch|PatchLevel"), F.lit("0")))
    return F.coalesce(F.when(~F.lower(F.trim(one)).isin(PLACEHOLDERS), one), F.when(part("Major").isNotNull() & part("Minor").isNotNull(), three))


def version_number(text: Column) -> Column:
    """The first word that is digits and full stops once other characters around it are gone; at least one full stop."""
    clean = F.transform(F.split(text, rf"{SPACE}+"), lambda w: F.regexp_replace(w, r"^[^\p{N}.]+|(?<![^\p{N}.])[^\p{N}.]+$", ""))
    return F.get(F.filter(clean, lambda w: w.rlike(r"^[\p{N}.]*\.[\p{N}.]*$")), F.lit(0))


def reference_version(branch: Column, commit: Column) -> Column:
    """A version from a branch, or else from a commit."""
    return F.coalesce(F.concat(F.lit("branch-"), F.translate(branch, "/_", "--")), F.concat(F.lit("dev-"), F.substring(commit, 1, 7)))


def chosen_version(explicit: Column, strategy: Column, git_tag: Column, branch: Column, commit: Column, package: Column) -> Column:
    """A version as asked for: an explicit one, one by strategy, and else the package's."""
    by = F.when(strategy == "git-tag", git_tag).when(strategy == "branch", reference_version(branch, F.lit(None))).when(strategy == "commit", reference_version(F.lit(None), commit))
    return F.coalesce(_present(F.trim(explicit)), by, package)


def _name() -> Column:
    return F.element_at(F.split("path", "/"), -1)


def _first(found: DataFrame, value: str) -> DataFrame:
    return found.filter(F.col(value).isNotNull()).groupBy("repo").agg(F.min(F.struct("rank", value)).alias("best")).select("repo", f"best.{value}")


def versions(files: DataFrame, tags: DataFrame) -> DataFrame:
    """(repo, language, version) of ``files`` (repo, language, path, content) and ``tags`` (repo, tag): the first source of the language that tells one.

    Python: pyproject, then the package's own constant. Go: the newest tag, then a constant. Rust: Cargo.toml, its workspace, then the newest tag.
    JavaScript: package.json. Java: POM, then Gradle. Without any it is ``latest``, or ``unknown`` of JavaScript and Java.
    """
    lang, name, text = F.col("language"), _name(), F.col("content")
    at = lambda language, file: (lang == language) & (F.col("path") == file)
    cargo = toml_field(text, "package", "version")
    dunder = _present(F.regexp_extract(text, r"(?dm)^[^\n=]*__version__[^\n=]*=\s*['\"]?([0-9][^'\"\n]*)", 1))
    rank = (
        F.when(at("python", "pyproject.toml"), 0).when((lang == "python") & ((name == "__init__.py") | (F.col("path") == F.concat("repo", F.lit(".py")))), 1)
        .when((lang == "go") & (name.isin("version.go", "doc.go") | name.endswith(".go")), 3).when(at("rust", "Cargo.toml"), 0)
        .when(at("javascript", "package.json"), 0).when(at("java", "pom.xml"), 0).when(at("java", "build.gradle"), 1).when(at("java", "build.gradle.kts"), 2)
    )
    value = (
        F.when(at("python", "pyproject.toml"), toml_field(text, "project", "version")).when(lang == "python", dunder).when(lang == "go", go_constant(text))
        .when(lang == "rust", F.coalesce(F.when(cargo.contains("."), cargo), toml_field(text, r"workspace\.package", "version")))
        .when(lang == "javascript", _present(package_json(text)["version"])).when(at("java", "pom.xml"), pom(text)["version"]).otherwise(gradle(text)["version"])
    )
    told = files.select("repo", rank.alias("rank"), F.when(rank.isNotNull(), value).alias("version"))
    bare = F.regexp_replace("tag", "^v", "")
    newest = tags.filter(bare.rlike(r"^[0-9].*\.")).withColumn("n", F.row_number().over(Window.partitionBy("repo").orderBy(*newest_first(tags)))).filter("n = 1")
    repos = files.select("repo", "language").distinct()
    tagged = newest.join(repos, "repo").filter(lang.isin("go", "rust")).select("repo", F.when(lang == "go", 2).otherwise(4).alias("rank"), bare.alias("version"))
    none = F.when(lang.isin("javascript", "java"), "unknown").otherwise("latest")
    return repos.join(_first(told.unionByName(tagged), "version"), "repo", "left").select("repo", "language", F.coalesce("version", none).alias("version"))


def licences(files: DataFrame) -> DataFrame:
    """(repo, licence): what the manifest says, else the class of the licence file, else that file's first line that is not blank; null without either."""
    lang, text = F.col("language"), F.col("content")
    manifest = (
        F.when((lang == "python") & (F.col("path") == "pyproject.toml"), toml_field(text, "project", "license")).when((lang == "rust") & (F.col("path") == "Cargo.toml"), toml_field(text, "package", "license"))
        .when((lang == "javascript") & (F.col("path") == "package.json"), package_json(text)["license"]).when((lang == "java") & (F.col("path") == "pom.xml"), pom(text)["licence"])
    )
    first = _present(F.regexp_extract(text, r"(?d)\A\s*([^\n]*\S)", 1))
    place = F.array_position(F.array(*map(F.lit, LICENCE_FILES)), F.col("path"))
    found = files.select("repo", F.when(place > 0, place).otherwise(0).cast("int").alias("rank"), F.when(place > 0, F.coalesce(classify_licence(text), first)).otherwise(_present(manifest)).alias("licence"))
    return files.select("repo").distinct().join(_first(found, "licence"), "repo", "left")


def project_urls(files: DataFrame) -> DataFrame:
    """(repo, label, url) as the manifests name them; of a Go module its documentation, and its source on the large hosts."""
    lang, text, js, p = F.col("language"), F.col("content"), package_json(F.col("content")), pom(F.col("content"))
    module = F.when((lang == "go") & (F.col("path") == "go.mod"), go_module(text))
    one = lambda label, url: F.struct(F.lit(label).alias("label"), url.alias("url"))
    when = lambda language, path, url: F.when((lang == language) & (F.col("path") == path), url)
    urls = F.array(
        one("Homepage", when("javascript", "package.json", js["homepage"])), one("Repository", when("javascript", "package.json", js["repository"])),
        one("Homepage", when("java", "pom.xml", p["url"])), one("Source", when("java", "pom.xml", p["scm"])),
        one("Homepage", when("rust", "Cargo.toml", toml_field(text, "package", "homepage"))), one("Source", when("rust", "Cargo.toml", toml_field(text, "package", "repository"))),
        one("Homepage", when("python", "pyproject.toml", toml_field(text, r"project\.urls", "Homepage"))), one("Source", when("python", "pyproject.toml", toml_field(text, r"project\.urls", "Repository"))),
        one("Documentation", F.concat(F.lit("https://pkg.go.dev/"), module)),
        one("Source", F.when(module.rlike(r"^(?:github\.com|gitlab\.com|bitbucket\.org)/"), F.concat(F.lit("https://"), without_major(module)))),
    )
    return files.select("repo", F.explode(F.filter(urls, lambda u: F.coalesce(u["url"] != "", F.lit(False)))).alias("u")).select("repo", "u.*")


def package_name(files: DataFrame) -> DataFrame:
    """(repo, name) of Python packages: pyproject's, else setup.py's, else the folder's."""
    setup = _present(F.regexp_extract("content", r"\bname\s*=\s*['\"]([^'\"]+)['\"]", 1))
    value = F.when(F.col("path") == "pyproject.toml", toml_field(F.col("content"), "project", "name")).when(F.col("path") == "setup.py", setup)
    found = files.select("repo", F.when(F.col("path") == "pyproject.toml", 0).otherwise(1).alias("rank"), value.alias("name"))
    return files.select("repo").distinct().join(_first(found, "name"), "repo", "left").select("repo", F.coalesce("name", F.regexp_extract("repo", "[^/]*$", 0)).alias("name"))


def maven_pom(dependencies: Column) -> Column:
    """A POM for ``group:artifact:version`` dependencies, without classifiers; those without a version are left out, and without any it is null."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    part = lambda d, i: escape(F.get(F.split(d, ":"), F.lit(i)))
    some = F.filter(dependencies, lambda d: F.coalesce(F.get(F.split(d, ":"), F.lit(2)) != "", F.lit(False)))
    rows = F.transform(
        some,
        lambda d: F.concat(
            F.lit("        <dependency>\n            <groupId>"), part(d, 0), F.lit("</groupId>\n            <artifactId>"), part(d, 1), F.lit("</artifactId>\n            <version>"), part(d, 2), F.lit("</version>\n        </dependency>")
        ),
    )
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<project>\n    <modelVersion>4.0.0</modelVersion>\n    <groupId>corpusmill</groupId>\n    <artifactId>test</artifactId>\n    <version>0.1.0</version>\n    <dependencies>\n'
    return F.when(F.size(some) > 0, F.concat(F.lit(head), F.array_join(rows, "\n"), F.lit("\n    </dependencies>\n</project>")))
