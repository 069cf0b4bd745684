"""Folders, ignore files, references, recorded runs, settings, logs and clients that fail, against git or plain Python."""

import os
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import review, runs, settings
from corpusmill.sources import folder, git, tree


def sh(where, *command):
    env = os.environ | {"GIT_CONFIG_GLOBAL": os.devnull, "GIT_CONFIG_SYSTEM": os.devnull, "GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@b.example", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@b.example"}
    return subprocess.run(command, cwd=where, env=env, capture_output=True, text=True, check=False).stdout


def write(root, files):
    for path, text in files.items():
        os.makedirs(os.path.dirname(root / path) or root, exist_ok=True)
        (root / path).write_bytes(text if isinstance(text, bytes) else text.encode())


def test_folder_source(spark, tmp_path):
    write(tmp_path, {"r/a.py": "x = 1", "r/pkg/b.py": "é", "r/pkg/deep/c.bin": b"\xff\x00", "r/.hidden/d": "", "s/big": "y" * 50, "top": "no repository"})
    os.makedirs(tmp_path / "empty")
    os.symlink("a.py", tmp_path / "r/link")
    os.symlink("pkg", tmp_path / "r/pkg/around")
    got = {(r.repo, r.path): (r.target, r.n_bytes, r.content) for r in folder.read(spark, str(tmp_path), max_bytes=20).collect()}
    assert got == {
        ("r", "a.py"): (None, 5, "x = 1"), ("r", "pkg/b.py"): (None, 2, "é"), ("r", "pkg/deep/c.bin"): (None, 2, "�\0"), ("r", ".hidden/d"): (None, 0, ""), ("r", "link"): ("a.py", None, None),
        ("r", "pkg/around"): ("pkg", None, None), ("s", "big"): (None, 50, None),
    }
    alone = folder.read(spark, str(tmp_path / "r"), alone=True)
    assert {r.path for r in alone.collect()} == {p for k, p in got if k == "r"} and alone.rdd.getNumPartitions() == 3
    assert folder.read(spark, str(tmp_path / "empty")).count() == 0
    with pytest.raises(Exception, match="no folder"):
        folder.read(spark, str(tmp_path / "nowhere")).count()


@pytest.mark.parametrize("seed", range(4))
def test_ignore_files_as_git_reads_them(spark, tmp_path, seed):
    """Random trees with random rules in several folders and in the exclude file."""
    rng = random.Random(seed)
    names, dirs = ["a", "b", "ab", "x.log", "y.tmp", "keep.log", "c d", "[z]", "a-b"], ["", "a/", "b/", "a/b/", "a/b/c/", "b/a/", "build/", "b/build/x/"]
    rules = ["*.log", "!keep.log", "build/", "/a/b/c", "b", "a/**/x.log", "**/ab", "a/**", "!a/b/", "y.*", "?", "[ab]", "[!a]", "*-*", "# no rule", "", "c d", "/*/a", "a/b/*", "!x.log", r"\[z\]", "ab/", "*.tmp  ", "/", "!/"]
    write(tmp_path, {f"r/{d}{n}": "" for d in dirs for n in rng.sample(names, 4) if f"{d}{n}/" not in dirs and not any(o.startswith(f"{d}{n}/") for o in dirs)})
    sh(tmp_path / "r", "git", "init", "-q")
    pick = lambda: "\n".join(rng.sample(rules, rng.randint(1, 5))) + "\n"
    write(tmp_path, {f"r/{d}.gitignore": pick() for d in rng.sample(dirs, 4)} | {"r/.git/info/exclude": pick()})
    paths = sorted(os.path.relpath(os.path.join(at, f), tmp_path / "r") for at, _, fs in os.walk(tmp_path / "r") for f in fs)
    paths = [p for p in paths if not any(s.startswith(".") for s in p.split("/"))]
    ignored = set(subprocess.run(["git", "-c", "core.quotePath=false", "check-ignore", "--no-index", "--stdin"], cwd=tmp_path / "r", input="\n".join(paths), capture_output=True, text=True, check=False).stdout.splitlines())
    got = {r.path for r in tree.walk(folder.read(spark, str(tmp_path)).select("repo", "path", "content")).collect()}
    assert got == set(paths) - ignored


def test_dot_ignore_overrules(spark):
    files = [("r", ".gitignore", "a\n!b\n"), ("r", ".ignore", "!a\nb\n"), ("r", "s/.gitignore", "*"), ("r", "a", ""), ("r", "b", ""), ("r", "s/a", ""), ("r", "s/c", ""), (None, "a", ""), ("r", None, "")]
    got = tree.walk(spark.createDataFrame(files, "repo string, path string, content string")).collect()
    assert sorted((str(r.repo), r.path) for r in got) == [("None", "a"), ("r", "a"), ("r", "s/a")]


def test_references_as_git_tells_them(spark, tmp_path):
    where = tmp_path / "r"
    where.mkdir()
    sh(where, "git", "init", "-q", "-b", "main")
    for i, tag in enumerate(["v1.0.0", "v1.10.0", "v1.9.0", "nightly", "a/b-1"]):
        sh(where, "git", "commit", "-q", "--allow-empty", "-m", str(i))
        sh(where, "git", "tag", *(["-a", "-m", "t"] if i % 2 else []), tag)
    sh(where, "git", "pack-refs", "--all")
    sh(where, "git", "commit", "-q", "--allow-empty", "-m", "late")
    sh(where, "git", "tag", "v2.0")
    sh(where, "git", "tag", "-f", "nightly")
    files = folder.read(spark, str(tmp_path)).select("repo", "path", "content").cache()
    want = dict(reversed(line.split(" ")) for line in sh(where, "git", "show-ref").splitlines())
    assert {r.ref: r.sha for r in git.refs(files).collect()} == want
    got = [r.tag for r in git.tags(files).orderBy("place").collect()]
    assert got[:4] == ["v2.0", "v1.10.0", "v1.9.0", "v1.0.0"] and sorted(got) == sorted(sh(where, "git", "tag").split())
    assert [tuple(r) for r in git.head(files).collect()] == [("r", "main", sh(where, "git", "rev-parse", "--short=7", "HEAD").strip())]
    sh(where, "git", "checkout", "-q", "--detach", "v1.9.0")
    assert [tuple(r) for r in git.head(folder.read(spark, str(tmp_path)).select("repo", "path", "content")).collect()] == [("r", "HEAD", sh(where, "git", "rev-parse", "--short=7", "HEAD").strip())]
    odd = [("o", ".git/HEAD", "ref: refs/heads/x\n"), ("o", ".git/refs/tags/bad", "no sha"), ("o", ".git/packed-refs", "# pack-refs\n^" + "a" * 40), ("p", ".git/packed-refs", None)]
    d = spark.createDataFrame(odd, "repo string, path string, content string")
    assert git.refs(d).collect() == [] and [tuple(r) for r in git.head(d).collect()] == [("o", "x", None)]


def test_recorded_runs(spark):
    rows = [("a", "1-extract.md", "x"), ("a", "2-map.md", "y"), ("a", "3-learn.md", "z"), ("a", "facts.md", " \n"), ("b", "1-extract.md", "x"), ("b", "2-map.md", " \t\n"), ("b", "3-learn.md", "z"), ("c", "facts.md", "f")]
    got = {r.repo: (r.extract, r.facts, r.problem) for r in git.replayed(spark.createDataFrame(rows, "repo string, path string, content string")).collect()}
    assert got == {"a": ("x", None, None), "b": ("x", None, "2-map.md is blank"), "c": (None, "f", "1-extract.md is missing")}


def test_settings(spark):
    files = [
        ("a", "user", "[llm]\nprovider = 'openai'\n"), ("a", "repository", "[llm]\nprovider = 'gemini'\napi_key_env = 'KEY'\n[generation.container]\ntimeout = 5\n"), ("b", "git root", "[llm"), ("b", "user", "[llm]\n"), ("c", "somewhere", "x = 1"), ("c", "user", None),
        ("e", "explicit", "[llm]\nprovider = 'cli'\nextra_body_json = '[1]'\n[generation]\nmax_retries = -1\nenable_test = false\n[generation.test_llm]\nprovider = 'odd'\n[generation.map_llm]\nprovider = 'odd'\n"),
        ("f", "explicit", "[llm]\nprovider = 'openai-compatible'\nextra_body_json = '{\"a\": 1}'\n"), ("g", "explicit", "[llm]\nprovider = 'openai-compatible'\nbase_url = 'https://h.example'\napi_key_env = 'NONE_SUCH'\n[generation.container]\ntimeout = 'x'\n"),
    ]
    f, repos = spark.createDataFrame(files, "repo string, layer string, content string"), spark.createDataFrame([(r,) for r in "abcdefg"], "repo string")
    assert {r.repo: (r.layer, r.problem is not None) for r in settings.chosen(f, repos).collect()} == {"a": ("repository", False), "b": ("git root", True), "c": ("defaults", False), "d": ("defaults", False), "e": ("explicit", False), "f": ("explicit", False), "g": ("explicit", False)}
    got = {(r.repo, r.key): (r.value, r.origin) for r in settings.effective(f, repos).collect()}
    assert got["a", "llm.provider"] == ("gemini", "repository") and got["a", "generation.max_retries"] == ("5", "defaults") and got["d", "llm.provider"] == ("anthropic", "defaults") and not any(k == "b" for k, _ in got)
    said = sorted((r.repo, r.level, r.key) for r in settings.checked(f, repos, ["KEY"]).collect())
    assert said == [
        ("a", "warning", "generation.container.timeout"), ("b", "error", ""), ("e", "error", "generation.map_llm.provider"), ("e", "error", "generation.max_retries"), ("e", "error", "llm.cli_command"), ("e", "error", "llm.extra_body_json"),
        ("f", "warning", "generation.parallel_extraction"), ("f", "warning", "llm.base_url"), ("g", "error", "generation.container.timeout"), ("g", "error", "llm.api_key_env"),
    ]


def test_logs_of_any_header(spark, tmp_path):
    names = runs.SCHEMA.names
    row = 'py,"a,""b",1,p,m,,,,,1,0,0,true,,no,2.3,t,v'
    where = tmp_path / "log"
    write(where, {"now.csv": f"{','.join(names)}\n{row}\n", "old.csv": f"{','.join(names[:4])}\npy,lib,1,p\n\n", "wide.csv": f"{','.join(names)},more,yet\n{row},\"x\",y\n{row}\n", "broken.csv": f"what is this\n{row}\n", "only.csv": ",".join(names), "empty.csv": ""})
    got = sorted(runs.read_any(spark, str(where)).collect(), key=str)
    assert len(got) == 5 and sum(r.library == 'a,"b' and r.duration_secs == 2.3 and r.tool_version == "v" and r.passed is True and r.test_model is None for r in got) == 4
    assert [(r.library, r.provider, r.model, r.passed) for r in got if r.library == "lib"] == [("lib", "p", None, None)]
    runs.migrate(spark, str(where), str(tmp_path / "new"))
    assert sorted(runs.read(spark, str(tmp_path / "new")).collect(), key=str) == got == sorted(runs.read_any(spark, str(tmp_path / "new")).collect(), key=str)


def test_retrying(spark, tmp_path):
    class Flaky:
        """Fails as often as a prompt says, and writes down the key that it was asked with."""

        def __init__(self, folder_):
            self.folder = folder_

        def complete_once(self, key, stage, prompt):
            kind, n = prompt.split(":")[:2]
            with open(f"{self.folder}/{key}", "a") as f:
                f.write("x")
            asked = os.path.getsize(f"{self.folder}/{key}")
            if asked <= int(n):
                raise {"slow": TimeoutError("late"), "busy": RuntimeError("HTTP 429"), "bad": ValueError("HTTP 400")}[kind]
            return f"{stage} {prompt} {asked}"

    prompts = [("s", "busy:0"), ("s", "busy:2"), ("s", "slow:3"), ("s", "busy:9"), ("s", "bad:1"), ("s", "busy:0"), ("t", "busy:0")]
    d = spark.createDataFrame(prompts, "stage string, prompt string").withColumn("n", F.monotonically_increasing_id())
    got = review.complete_retrying(d, Flaky(str(tmp_path)), retries=3, delay=0).cache()
    rows = sorted((r.stage, r.prompt, r.reply, r.attempts, r.error) for r in got.collect())
    assert rows == [
        ("s", "bad:1", None, 1, "HTTP 400"), ("s", "busy:0", "s busy:0 1", 1, None), ("s", "busy:0", "s busy:0 1", 1, None), ("s", "busy:2", "s busy:2 3", 3, None), ("s", "busy:9", None, 4, "HTTP 429"), ("s", "slow:3", "s slow:3 4", 4, None), ("t", "busy:0", "t busy:0 1", 1, None),
    ]
    again = review.complete_retrying(d, Flaky(str(tmp_path)), retries=3, delay=0, done=got)
    after = {(r.stage, r.prompt): (r.reply, r.attempts) for r in again.collect()}
    assert after["s", "busy:2"] == ("s busy:2 3", 3) and after["s", "bad:1"] == ("s bad:1 2", 1) and after["s", "busy:9"] == (None, 4)
    assert sorted(os.path.getsize(tmp_path / f) for f in os.listdir(tmp_path)) == [1, 1, 2, 3, 4, 8]
