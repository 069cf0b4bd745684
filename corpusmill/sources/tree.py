"""Repository trees as relations: which files are read, by ignore rules, name and place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RULE = "struct<regex:string,keep:boolean,folder:boolean>"


def ignore_rules(text: Column) -> Column:
    """The rules of a .gitignore in order: a regular expression for paths below its folder, whether it keeps, and whether it is for folders only."""
    ls = F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x: F.regexp_replace(x, r"(?<!\\)[ \t]+$", ""))
    ls = F.filter(ls, lambda x: (x != "") & ~x.startswith("#") & ~x.rlike("^!?/*$"))

    def one(x: Column) -> Column:
        glob = F.regexp_replace(F.regexp_replace(x, "^!", ""), "/+$", "")
        anchored = glob.contains("/")
        bare = F.regexp_replace(F.regexp_replace(glob, "^/", ""), r"([.+^$()|{}])", r"\\$1")
        # double stars first, as marks that a single star doesn't touch
        marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"^\*\*/", "\x01"), r"/\*\*/", "/\x01"), r"/\*\*$", "/\x02")
        regex = F.regexp_replace(F.regexp_replace(marked, r"\*+", "[^/]*"), r"\?", "[^/]")
        regex = F.replace(regex, F.lit("[!"), F.lit("[^"))
        regex = F.replace(F.replace(regex, F.lit("\x01"), F.lit("(?:.*/)?")), F.lit("\x02"), F.lit(".+"))
        return F.struct(F.concat(F.when(anchored, "^").otherwise("^(?:.*/)?"), regex, F.lit("$")).alias("regex"), x.startswith("!").alias("keep"), F.regexp_replace(x, "^!", "").endswith("/").alias("folder"))

    return F.transform(ls, one)


#: Files of rules from the weakest kind to the strongest; the first lies at one place only, the others in any folder.
RULE_FILES = [r"\A\.git/info/exclude\z", r"(?:\A|/)\.gitignore\z", r"(?:\A|/)\.ignore\z"]


def inherited(files: DataFrame) -> DataFrame:
    """(repo, folder, rules) for every folder of ``files`` that has rules: those of its own and of all folders above, with the folder that each is from, the weakest first."""
    kind = F.coalesce(*(F.when(F.col("path").rlike(p), F.lit(i)) for i, p in enumerate(RULE_FILES)))
    at = F.when(kind == 0, F.lit("")).otherwise(F.regexp_replace("path", "/?[^/]*$", ""))
    own = files.select("repo", "path", "content", kind.alias("kind"), at.alias("at")).filter("kind is not null").dropDuplicates(["repo", "path"])
    own = own.select(F.col("repo").alias("__repo"), "at", F.struct("kind", F.length("at").alias("depth"), "at", ignore_rules(F.col("content")).alias("rules")).alias("r"))
    steps = F.split("folder", "/")
    heads = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    folders = files.select("repo", F.regexp_replace("path", "/?[^/]*$", "").alias("folder")).distinct().select("repo", "folder", F.explode(F.array_distinct(heads)).alias("head"))
    met = folders.join(own, folders["repo"].eqNullSafe(own["__repo"]) & (F.col("head") == F.col("at"))).groupBy("repo", "folder").agg(F.array_sort(F.collect_list("r")).alias("sets"))
    tagged = F.flatten(F.transform("sets", lambda s: F.transform(s["rules"], lambda r: F.struct(s["at"].alias("at"), r["regex"].alias("regex"), r["keep"].alias("keep"), r["folder"].alias("folder")))))
    return met.select(F.col("repo").alias("__repo"), F.col("folder").alias("__folder"), tagged.alias("__rules"))


def walk(files: DataFrame, *, extensions: list[str] = (), skip: list[str] = (), max_depth: int | None = None) -> DataFrame:
    """Of ``files`` (repo, path, content) those that a walk which honours ignore files finds, by path.

    Rules come from .gitignore files in any folder, from the repository's own exclude file, which they overrule, and from .ignore files, which overrule
    both; a rule holds below its file's folder, and deeper files overrule those above. Hidden files and folders and the folders named in ``skip`` are
    left out, as is what lies below an ignored folder, whatever later rules say. The last rule that fits a path decides. Null paths are left out; a
    repository without such files has no rules.
    """
    d = files.filter("path is not null").withColumn("__at", F.regexp_replace("path", "/?[^/]*$", ""))
    rules = inherited(files.filter("path is not null"))
    d = d.join(rules, d["repo"].eqNullSafe(rules["__repo"]) & (d["__at"] == rules["__folder"]), "left").withColumn("__rules", F.coalesce("__rules", F.array().cast("array<struct<at:string,regex:string,keep:boolean,folder:boolean>>")))
    parts = F.split("path", "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("at"), (n < F.size(parts)).alias("folder")))
    below = lambda h, r: F.when(r["at"] == "", h["at"]).when(F.startswith(h["at"], F.concat(r["at"], F.lit("/"))), F.substr(h["at"], F.length(r["at"]) + 2))
    fits = lambda h: F.filter("__rules", lambda r: (h["folder"] | ~r["folder"]) & F.coalesce(F.regexp_like(below(h, r), r["regex"]), F.lit(False)))
    ignored = F.exists(heads, lambda h: F.coalesce(~F.try_element_at(fits(h), F.lit(-1))["keep"], F.lit(False)))
    gone = F.exists(parts, lambda p: p.startswith(".")) | ignored
    if skip:
        gone = gone | F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, skip)))
    if max_depth is not None:
        gone = gone | (F.size(parts) > max_depth)
    if extensions:
        gone = gone | ~F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin([e.lower() for e in extensions])
    return d.filter(~gone).select(*files.columns)


def resolved(path: Column) -> Column:
    """A path without ``.``, ``..`` and empty parts."""
    step = lambda acc, p: F.when((p == "") | (p == "."), acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/"))


def within(path: Column, target: Column, boundary: str) -> Column:
    """Whether a file lies below ``boundary``: the file itself, or what it links to; a link whose target is empty leads nowhere.

    A relative target starts at the link's folder.
    """
    folder = F.regexp_replace(path, "[^/]*$", "")
    real = F.when(target.isNull(), path).when(target.startswith("/"), target).when(target != "", F.concat(folder, target))
    return F.coalesce(F.concat(resolved(real), F.lit("/")).startswith(boundary.rstrip("/") + "/"), F.lit(False))


#: Folders that hold no source of a language, and the names of its tests.
SKIPPED = {
    "python": ["tests", "test", "docs", "examples", "build", "dist", "venv", ".venv", "__pycache__", "site-packages"],
    "go": ["vendor", "testdata", "examples", "docs"],
    "javascript": ["node_modules", "dist", "build", "coverage", "test", "tests", "__tests__", "examples"],
    "rust": ["target", "benches", "tests", "examples"],
    "java": ["target", "build", "out"],
}
EXTENSIONS = {"python": "py|pyi", "go": "go", "javascript": "[cm]?[jt]sx?", "rust": "rs", "java": "java|kt"}
TESTS = {
    "python": r"(?:^|/)(?:test_[^/]*|[^/]*_test)\.py$|(?:^|/)tests?/", "go": r"_test\.go$", "javascript": r"\.(?:test|spec)\.[cm]?[jt]sx?$|(?:^|/)(?:tests?|__tests__)/",
    "rust": r"(?:^|/)tests/|_test\.rs$", "java": r"(?:^|/)src/test/|^tests?/|Tests?\.(?:java|kt)$",
}


def role(language: str, path: Column) -> Column:
    """source, test, or null for files of other languages and folders that nobody reads; of Java a test's name counts outside src/main only."""
    parts = F.split(path, "/")
    own = path.rlike(rf"\.(?:{EXTENSIONS[language]})$")
    test = path.rlike(TESTS[language]) & ~(F.lit(language == "java") & path.rlike("(?:^|/)src/main/"))
    hidden = F.exists(parts, lambda p: p.startswith(".") | (F.lit(language == "go") & p.startswith("_")))
    skipped = F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, SKIPPED[language])))
    return F.when(~own | hidden, F.lit(None)).when(test, "test").when(~skipped, "source")


def roles(files: DataFrame) -> DataFrame:
    """``files`` (repo, language, path) with ``role``."""
    by = reduce(lambda rest, k: F.when(F.col("language") == k, role(k, F.col("path"))).otherwise(rest), SKIPPED, F.lit(None).cast("string"))
    return files.withColumn("role", by)
