"""Manifests with workspaces, dependencies of documents, modules of imports, and files read under a budget, each against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import cargo, dependencies, sampling

ROOT = """[workspace]
members = ["crates/*"]
[workspace.dependencies]
plain = "1.2"
wide = { version = "2", features = ["a", "b"] }
flat = { version = "3", default-features = false }
local = { path = "../local" }
number = 4
"""


def files(spark, rows):
    return spark.createDataFrame(rows, "repo string, path string, content string")


def manifest(*lines):
    return "[package]\nname = \"n\"\n[dependencies]\n" + "\n".join(lines)


def specs(frame):
    return {(r.repo, r.path): {x.name: x.raw_spec for x in frame.collect() if (x.repo, x.path) == (r.repo, r.path)} for r in frame.select("repo", "path").distinct().collect()}


def test_members_inherit_from_their_workspace(spark):
    member = manifest(
        'own = "0.1"', "plain = { workspace = true }", "plain2 = { workspace = true }", 'wide = { workspace = true, features = ["b", "c"], optional = true }', "flat.workspace = true", "local.workspace = true",
        'here = { path = "../here", version = "1" }', 'far = { git = "https://h.example/far", branch = "b" }', 'off = { workspace = false, version = "5" }',
    )
    rows = [
        ("r", "Cargo.toml", ROOT), ("r", "crates/m/Cargo.toml", member), ("r", "crates/m/deep/er/Cargo.toml", manifest('plain = { workspace = true, features = ["x"] }', "number.workspace = true")),
        ("r", "inner/Cargo.toml", "[workspace]\n"), ("r", "inner/m/Cargo.toml", manifest("plain.workspace = true")), ("s", "m/Cargo.toml", manifest("plain.workspace = true")),
        ("t", "Cargo.toml", "[workspace]\n[workspace.dependencies]\nq = '1'\n[dependencies]\nq = { workspace = true }\n"), ("u", "Cargo.toml", "no toml ["), ("v", "Cargo.toml", None), (None, "Cargo.toml", ROOT), ("r", None, member), ("r", "crates/m/cargo.toml", member),
        ("r", "crates/m/Cargo.toml", member),
    ]
    got = specs(cargo.manifest_dependencies(files(spark, rows)))
    assert got == {
        ("r", "crates/m/Cargo.toml"): {"own": '"0.1"', "plain": '"1.2"', "plain2": '"*"', "wide": '{ features = ["a", "b", "c"], optional = true, version = "2" }', "flat": '{ default-features = false, version = "3" }', "far": '{ branch = "b", git = "https://h.example/far" }', "off": '{ version = "5", workspace = false }'},
        ("r", "crates/m/deep/er/Cargo.toml"): {"plain": '{ features = ["x"], version = "1.2" }', "number": "4"}, ("r", "inner/m/Cargo.toml"): {"plain": '"*"'}, ("s", "m/Cargo.toml"): {"plain": '"*"'}, ("t", "Cargo.toml"): {"q": '"1"'},
    }
    assert cargo.manifest_dependencies(files(spark, rows).limit(0)).collect() == []


def test_dependencies_of_documents(spark):
    text = """## Imports
```toml
[dependencies] # all
tokio-util = { version = "0.7", features = ["codec"] }
serde = "1"
[dev-dependencies]
late = "1"
```
```toml
serde = "2"
unknown = "9"
```
use serde::Serialize;
use tokio_util::codec;
  use indented::no;
use std::fmt;
extern crate log as logger;
cargo add env_logger --no-default-features --features "a b,c"
cargo add log -F x

## Core Patterns
use anyhow::Result;
#[tokio::main]
use serde::de;
"""
    extra = "## Imports\n~~~toml\n[dependencies]\nonly-here = '3'\nuse-less = { path = 'x' }\n"
    d = spark.createDataFrame([(1, text), (2, extra), (3, None), (4, "use serde::x;"), (1, extra)], "doc_id int, text string").withColumn("row", F.lit(1))
    got = sorted((r.doc_id, r.pos, r.name, r.raw_spec, r.source) for r in cargo.document_dependencies(d).collect())
    names = [
        ("tokio-util", '{ features = ["codec"], version = "0.7" }', "manifest"), ("serde", '"2"', "manifest"), ("log", None, "pattern"), ("env_logger", '{ version = "*", features = ["a", "b", "c"] }', "pattern"), ("anyhow", None, "pattern"), ("tokio", None, "pattern"),
    ]
    only = [("only-here", '"3"', "manifest"), ("use-less", "{ path = \"x\" }", "manifest")]
    assert got == sorted([(1, i, *n) for i, n in enumerate(names)] + [(k, i, *n) for k in (1, 2) for i, n in enumerate(only)])


def brute_module(dep, modules):
    best = None
    for m in modules:
        rest = dep[len(m) + 1 :].split("/")[0]
        version = len(rest) > 1 and rest[0] == "v" and rest[1:].isdigit() and rest.isascii()
        if (dep == m or dep.startswith(m + "/") and not version) and (best is None or len(m) > len(best)):
            best = m
    return best


def test_modules_of_imports(spark):
    rng = random.Random(3)
    path = lambda: "/".join(rng.choice(["h.example", "a", "b", "v2", "v10", "v2client", "v", "vx"]) for _ in range(rng.randint(1, 5)))
    deps, modules = [path() for _ in range(400)], [path() for _ in range(40)]
    got = dependencies.module_of(spark.createDataFrame([(d,) for d in [*deps, None]], "dep string"), spark.createDataFrame([(m,) for m in [*modules, None]], "module string")).collect()
    assert len(got) == 401 and {r.dep: r.module for r in got if r.dep} == {d: brute_module(d, modules) for d in deps}
    pairs = [(i % 3, m) for i, m in enumerate(modules)]
    found = dependencies.needs_replace(spark.createDataFrame([(i % 3, d) for i, d in enumerate(deps)], "repo int, dep string"), spark.createDataFrame(pairs, "repo int, module string")).collect()
    assert {(r.repo, r.module): r.needs_replace for r in found} == {(k, m): any(brute_module(d, [m]) for i, d in enumerate(deps) if i % 3 == k) for k, m in pairs}


def brute_smart(rows, budget):
    out, used = [], 0
    for priority, path, text in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        if used >= budget:
            break
        name, cap = next(((n, c or 10**9) for p, n, c in sampling.LABELS if priority is not None and priority <= p), sampling.OTHER)
        data, left = text.encode(), budget - used
        head = f"\n\n// File: {path} ({name})\n"
        if len(data) <= cap and left >= len(head.encode()) + len(data):
            piece = head + text
        else:
            head = f"\n\n// File: {path} ({name}, sampled)\n"
            if left <= len(head.encode()):
                break
            piece = head + data[: min(left - len(head.encode()), cap)].decode("utf-8", "ignore")
        out.append((path, piece))
        used += len(piece.encode())
    return out


@pytest.mark.parametrize("budget", [0, 30, 70, 400, 3000, 40_000])
def test_smart_reading(spark, budget):
    rng = random.Random(budget)
    rows = [(rng.choice([0, 10, 20, 30, 50, 100, None]), f"p/{'é' * (i % 3)}{i}.py", rng.choice([None, "", "x" * rng.randint(0, 90), "é😀a" * rng.randint(1, 200), "z" * rng.randint(1000, 12_000)])) for i in range(60)]
    d = spark.createDataFrame([(k, *r) for k in ("r", "s") for r in rows if k == "r" or r[0] != 0], "repo string, priority int, path string, content string")
    got = sampling.read_smart(d, budget).orderBy("repo", "pos").collect()
    assert [(r.path, r.piece) for r in got if r.repo == "r"] == brute_smart(rows, budget)
    assert [(r.path, r.piece) for r in got if r.repo == "s"] == brute_smart([r for r in rows if r[0] != 0], budget)


def test_merge_with_a_manifest_streams_its_pairs(spark):
    found = [(1, i, "Hot_Pkg", None if i % 2 else f">={i}") for i in range(300)] + [(1, 900, "only.found", None), (2, 901, "hot-pkg", None), (None, 902, "hot-pkg", "x")]
    listed = [(1, i, "hot.pkg", f"=={i}") for i in range(200)] + [(1, 500, "only-listed", "1"), (3, 501, "hot-pkg", None), (None, 502, "hot-pkg", "y"), (3, 503, None, "z")]
    side = lambda rows: spark.createDataFrame(rows, "doc_id int, pos int, name string, raw_spec string")
    merged = dependencies.enrich(side(found), side(listed))
    pairs = [(1, "Hot_Pkg", s or m, "pattern", i) for k, i, _, s in found[:300] for _, _, _, m in listed[:200]]
    rest = [(1, "only.found", None, "pattern", 900), (2, "hot-pkg", None, "pattern", 901), (None, "hot-pkg", "x", "pattern", 902)]
    late = [(1, "only-listed", "1", "manifest", 1_000_500), (3, "hot-pkg", None, "manifest", 1_000_501), (None, "hot-pkg", "y", "manifest", 1_000_502), (3, None, "z", "manifest", 1_000_503)]
    assert sorted(map(str, merged.toLocalIterator())) == sorted(map(str, (merged.sparkSession.createDataFrame(pairs + rest + late, merged.schema).toLocalIterator())))
    # a full outer join keeps all pairs of a name in memory before it gives the first
    assert "FullOuter" not in merged._jdf.queryExecution().optimizedPlan().toString()


def test_workspaces_stay_off_the_driver(spark, tmp_path):
    member = manifest('x = { workspace = true, optional = true }', "y.workspace = true")
    roots = ['[workspace.dependencies]\nx = "1"\ny = "2"\n', 'workspace.dependencies.x = "1"\nworkspace.dependencies.y = "2"\n', ' [ "workspace" . dependencies ]\r\nx = "1"\r\ny = "2"\r\n', "a = [\n1\n]\n\t'workspace' = { dependencies = { x = '1', y = '2' } }\n", '["work\\u0073pace".dependencies]\nx = "1"\ny = "2"\n']
    others = ['[package]\nworkspace = "../.."\n', '[[workspace]]\n[workspace.dependencies]\nx = "3"\n', "[package.workspace]\ndependencies = { x = '4' }\n", 'text = """\n[workspace]\n"""\n']
    rows = [(f"r{i}", p, t) for i, root in enumerate(roots + others) for p, t in (("Cargo.toml", root), ("a/b/Cargo.toml", member))]
    files(spark, rows).write.parquet(str(tmp_path / "files"))
    found = cargo.manifest_dependencies(spark.read.parquet(str(tmp_path / "files")))
    got = specs(found)
    assert all(got["r%d" % i, "a/b/Cargo.toml"] == {"x": '{ optional = true, version = "1" }', "y": '"2"'} for i in range(len(roots)))
    assert all(got["r%d" % (len(roots) + i), "a/b/Cargo.toml"] == {"x": '"*"', "y": '"*"'} for i in range(len(others)))
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert [x for x in plan.split("\n") if "Broadcast" in x] == [] and plan.count("ArrowEvalPython [") <= 3
