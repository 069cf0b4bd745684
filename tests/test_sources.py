import pytest
from pyspark.sql import functions as F

from corpusmill.operators import manifests
from corpusmill.sources import tree


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "path, target, inside",
    [("/r/a.py", None, True), ("/r/../x", None, False), ("/r/l", "/etc/passwd", False), ("/r/s/l", "../b", True), ("/r/l", "../../x", False), ("/r/l", "", False), ("/rest/a", None, False), ("/r/./a//b", None, True)],
)
def test_boundary(spark, path, target, inside):
    assert value(spark, tree.within(F.lit(path), F.lit(target), "/r")) is inside


@pytest.mark.parametrize(
    "text, version",
    [('Version = "v1.2.3-rc"', "1.2.3-rc"), ('version="dev"', None), ("Major: 1\nMinor = 17", "1.17.0"), ("MinorVersion = 2", None), ('VERSION = "0.0.0"\nMajor=2;Minor=3;Patch=4', "2.3.4"), ("", None)],
)
def test_go_constants(spark, text, version):
    assert value(spark, manifests.go_constant(F.lit(text))) == version


@pytest.mark.parametrize(
    "text, version, artifact",
    [
        ("<project><artifactId>a</artifactId><version>1</version></project>", "1", "a"), ("<parent><version>9</version><artifactId>p</artifactId></parent><artifactId>a</artifactId>", None, "a"), ("<parent><version>9</version>", None, None),
        ("<version>${rev}</version>", None, None), ("<artifactId>a</artifactId><parent></parent><dependencies><version>4</version></dependencies>", None, "a"), ("<build></build><parent></parent><version>2</version>", None, None),
    ],
)
def test_pom(spark, text, version, artifact):
    got = value(spark, manifests.pom(F.lit(text)))
    assert (got.version, got.artifact) == (version, artifact)


@pytest.mark.parametrize(
    "text, name, version, group",
    [
        ("version = '1.0'\ngroup = \"g\"\narchivesBaseName = 'n'", "n", "1.0", "g"), ("version '2'\ngroup('h')", None, "2", "h"), ('version.set("3") // x', None, "3", None), ("versionCode = '9'\nversion = base + '1'", None, None, None),
        ("rootProject.name = 'r'", "r", None, None), ("// version = '4'", None, None, None),
    ],
)
def test_gradle(spark, text, name, version, group):
    assert tuple(value(spark, manifests.gradle(F.lit(text)))) == (name, version, group)


def test_other_versions(spark):
    assert value(spark, manifests.version_number(F.lit("see (v3.0.0), not 4"))) == "3.0.0" and value(spark, manifests.version_number(F.lit("none here"))) is None
    assert value(spark, manifests.reference_version(F.lit("fix/a_b"), F.lit(None))) == "branch-fix-a-b" and value(spark, manifests.reference_version(F.lit(None), F.lit("0123456789"))) == "dev-0123456"
    args = lambda e, s: manifests.chosen_version(*map(F.lit, (e, s, "1.0", "main", "abcdef0123", "9.9")))
    assert [value(spark, args(e, s)) for e, s in (("7", "commit"), (" ", "git-tag"), (None, "branch"), (None, "commit"), (None, None))] == ["7", "1.0", "branch-main", "dev-abcdef0", "9.9"]


def test_maven_pom(spark):
    got = value(spark, manifests.maven_pom(F.lit(["g:a:1.0:javadoc", "x:y", "plain", "h:b:[1,2)", "g:<c>:3"])))
    assert got.count("<dependency>") == 3 and "<version>1.0</version>" in got and "[1,2)" in got and "&lt;c&gt;" in got
    assert value(spark, manifests.maven_pom(F.lit(["x:y"]))) is None


def test_package_name(spark):
    rows = [("/w/a", "pyproject.toml", '[project]\nname = "p"'), ("/w/a", "setup.py", "setup(name='s')"), ("/w/b", "setup.py", "setup(name='s')"), ("/w/c", "x.py", "")]
    got = manifests.package_name(spark.createDataFrame(rows, "repo string, path string, content string")).collect()
    assert {r.repo: r.name for r in got} == {"/w/a": "p", "/w/b": "s", "/w/c": "c"}
