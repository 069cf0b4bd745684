"""Dependencies of Rust packages: what manifests say, with what members inherit from their workspace, and what documents say of them.

A manifest is parsed once, in its own row, by Python's TOML reader; everything between rows is a join. A specification is a TOML value in one
spelling: strings in double quotes, tables inline with their keys in order, so that equal specifications are equal texts.
"""

from __future__ import annotations

import json
import tomllib
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import section, trim
from .dependencies import RUST_STD, safe_name

_ENTRY = "struct<pos:int,name:string,spec:string,path:boolean,inherits:boolean,version:string,features:array<string>,rest:map<string,string>>"
_PARSED = f"struct<workspace:boolean,own:array<{_ENTRY}>,shared:array<{_ENTRY}>,top:array<{_ENTRY}>>"
#: A manifest whose top has a key ``workspace`` has a line that begins with it, perhaps as a header, quoted, or in quotes with escapes.
_MAY_SHARE = r"""(?m)^[ \t]*\[?[ \t]*(?:["']?workspace|"[^"\n]*\\)"""
#: Stands for any version.
ANY = '"*"'


def spelled(value: Any) -> str:
    """A TOML value, on one line."""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, list):
        return "[" + ", ".join(map(spelled, value)) + "]"
    if isinstance(value, dict):
        return table({k: spelled(v) for k, v in value.items()})
    return str(value)


def table(parts: dict[str, str]) -> str:
    return "{ " + ", ".join(f"{k} = {v}" for k, v in sorted(parts.items())) + " }" if parts else "{}"


def _entries(deps: Any) -> list[dict]:
    """One row a dependency, in the order of the manifest. The features and the version are apart from the other keys, as they are inherited in their own way."""
    out = []
    for name, value in deps.items() if isinstance(deps, dict) else ():
        t = value if isinstance(value, dict) else {}
        features = t.get("features")
        rest = {k: spelled(v) for k, v in t.items() if k != "workspace" and not (k == "features" and isinstance(features, list))}
        out.append({
            "pos": len(out), "name": name, "spec": spelled(value), "path": "path" in t, "inherits": t.get("workspace") is True, "version": None if t else spelled(value),
            "features": [spelled(f) for f in features] if isinstance(features, list) else None, "rest": rest,
        })
    return out


def parse(text: str | None) -> dict | None:
    """What one manifest says, or None if it is no TOML."""
    try:
        t = tomllib.loads((text or "").replace("\r\n", "\n"))
    except (tomllib.TOMLDecodeError, RecursionError):
        return None
    w = t.get("workspace")
    return {"workspace": isinstance(w, dict), "own": _entries(t.get("dependencies")), "shared": _entries(w.get("dependencies") if isinstance(w, dict) else None), "top": _entries(t) if "dependencies" not in t else []}


def parsed(text: Column) -> Column:
    """Struct of a manifest's parts; nulls if it is no TOML."""

    @F.pandas_udf(_PARSED)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [parse(t) or {} for t in texts]
        return pd.DataFrame({k: [r.get(k) for r in rows] for k in ("workspace", "own", "shared", "top")})

    return run.asNondeterministic()(text)  # else a filter on a part of it parses once more


def manifest_dependencies(files: DataFrame) -> DataFrame:
    """(repo, path, pos, name, raw_spec) of the Cargo.toml files of ``files`` (repo, path, content), as a build outside the repository would need them.

    A dependency that a member inherits is looked up in the nearest manifest in or above the member's folder that has a workspace; that ends the
    search, whether or not the workspace names it, and one that it doesn't name may have any version. The member's features are added to the workspace's,
    its other keys replace those of the same name. Dependencies by path are left out, also inherited ones. A manifest that is no TOML, and a
    null path or content, has no rows; of rows that repeat a path one counts.
    """
    d = files.filter(F.regexp_like("path", F.lit("(?:^|/)Cargo\\.toml$")) & F.col("content").isNotNull()).select("repo", "path", "content").dropDuplicates(["repo", "path"])
    d = d.select("repo", "path", F.regexp_replace("path", "/?Cargo\\.toml$", "").alias("folder"), "content")
    own = d.select("repo", "path", "folder", F.explode(parsed(F.col("content"))["own"]).alias("e")).filter(~F.col("e.path"))
    # the folders above a manifest, nearest first, meet the workspaces of the repository; to know the folders takes no parsing
    members = d.select("repo", "folder").distinct()
    steps = F.split("folder", "/")
    above = F.transform(F.sequence(F.size(steps), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    above = members.select("repo", "folder", F.posexplode(F.array_distinct(above)).alias("up", "at"))
    spaces = d.filter(F.col("content").rlike(_MAY_SHARE)).select("repo", F.col("folder").alias("at"), parsed(F.col("content")).alias("m"))
    spaces = spaces.filter("m.workspace").select("repo", "at", F.col("m.shared").alias("shared"))
    # there are as many workspaces as repositories, and Spark can't tell the size of what is parsed: none of it goes through the driver
    nearest = above.join(spaces.select("repo", "at").hint("merge"), ["repo", "at"]).groupBy("repo", "folder").agg(F.min_by("at", "up").alias("at"))
    given = nearest.join(spaces.hint("merge"), ["repo", "at"]).select("repo", "folder", F.explode("shared").alias("w")).select("repo", "folder", F.col("w.name").alias("name"), "w")
    e, w = F.col("e"), F.col("w")
    joined = own.select("repo", "path", "folder", "e", e["name"].alias("name")).join(given.hint("merge"), ["repo", "folder", "name"], "left")
    keys = lambda m: F.map_filter(m, lambda k, v: k != "features")
    # a bare version of the workspace becomes a table once the member adds to it
    base = F.when(w["version"].isNotNull(), F.create_map(F.lit("version"), w["version"])).otherwise(w["rest"])
    both = F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(e["rest"], k)), e["rest"])
    features = F.when(w["features"].isNotNull() & e["features"].isNotNull(), F.concat(w["features"], F.filter(e["features"], lambda f: ~F.array_contains(w["features"], f)))).otherwise(F.coalesce(e["features"], w["features"]))
    listed = F.when(features.isNotNull(), F.map_concat(keys(both), F.create_map(F.lit("features"), F.concat(F.lit("["), F.array_join(features, ", "), F.lit("]"))))).otherwise(both)
    parts = F.transform(F.array_sort(F.map_entries(listed)), lambda x: F.concat(x["key"], F.lit(" = "), x["value"]))
    merged = F.concat(F.lit("{ "), F.array_join(parts, ", "), F.lit(" }"))
    changed = (F.size(e["rest"]) > 0) | e["features"].isNotNull()
    raw = F.when(~e["inherits"], e["spec"]).when(w.isNull(), ANY).when(changed, merged).otherwise(w["spec"])
    outside = ~(e["inherits"] & w.isNotNull() & w["path"])
    return joined.filter(outside).select("repo", "path", e["pos"].alias("pos"), e["name"].alias("name"), raw.alias("raw_spec"))


_NAME = "[a-zA-Z_][a-zA-Z0-9_]*"
_ADD = r"""cargo\s+add\s+([a-zA-Z_][a-zA-Z0-9_-]*)(?:[^\n]*?\s--features[\s=]+(?:"([^"]*)"|'([^']*)'|([^\s-]\S*)))?"""


def document_dependencies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pos, name, raw_spec, source) of the Rust packages that documents name in their Imports section and, as peers, in Core Patterns.

    Names come in order of first mention, hyphens and underscores being the same: dependency lines, ``use``, ``extern crate``, ``cargo add``, then uses
    and attributes of the patterns. A TOML block of the imports gives a specification (source manifest), else the features of a ``cargo add`` (source
    pattern). What only the blocks name is appended in their order; of repeated names the last specification counts. In a block without a
    table of dependencies only names known otherwise count. Null texts and texts without an Imports section have no rows.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    imports = F.coalesce(section(t, r"Imports\s*$"), F.lit(""))
    peers = F.coalesce(section(t, r"(?i:Core\s+Patterns)\s*$"), F.lit(""))
    every = lambda c, p: F.regexp_extract_all(c, F.lit(p), 1)
    header = r"^[ \t]*\[dependencies\][ \t]*(?:#[^\n]*)?$"
    tables = every(imports, rf"(?dms){header}(.*?)(?=^\s*\[|^\s*```|^\s*~~~|\z)")
    listed = F.flatten(F.transform(tables, lambda b: every(b, r"(?dm)^[ \t]*([a-zA-Z_][a-zA-Z0-9_-]*)\s*=")))
    used = lambda c: every(c, rf"(?dm)^use\s+({_NAME})(?:\s+as\s+{_NAME})?(?:::|;)")
    names = F.concat(
        listed, used(imports), every(imports, rf"(?dm)^extern\s+crate\s+({_NAME})(?:\s+as\s+{_NAME})?\s*;"), every(imports, _ADD), used(peers), every(peers, rf"#\[({_NAME})::"),
    )
    names = F.filter(F.array_distinct(names), lambda n: ~n.isin(RUST_STD) & safe_name(n))
    blocks = F.regexp_extract_all(imports, F.lit(r"(?ms)^\s*(?:```|~~~)toml[^\n]*\n(.*?)(?=^\s*(?:```|~~~)\s*$|\z)"), F.lit(1))
    d = docs.select(F.col(doc_id).alias("doc"), names.alias("names"), blocks.alias("blocks"), F.regexp_extract_all(imports, F.lit(_ADD), F.lit(0)).alias("adds"))
    norm = lambda c: F.translate(c, "-", "_")
    # one row a name; a document's rows are numbered, as ids may repeat
    d = d.withColumn("row", F.monotonically_increasing_id())
    first = Window.partitionBy("row", "norm")
    found = d.select("doc", "row", F.posexplode("names").alias("pos", "name")).withColumn("norm", norm(F.col("name")))
    found = found.withColumn("n", F.row_number().over(first.orderBy("pos"))).filter("n = 1").drop("n")
    told = d.filter(F.size("blocks") > 0).select("doc", "row", "names", F.posexplode("blocks").alias("block", "toml")).withColumn("m", parsed(F.col("toml")))
    known = F.filter("m.top", lambda e: F.array_contains("names", e["name"]))
    told = told.select("doc", "row", "block", F.explode(F.concat("m.own", known)).alias("e")).select("doc", "row", F.col("e.name").alias("name"), norm(F.col("e.name")).alias("norm"), (F.col("block").cast("long") * (1 << 32) + F.col("e.pos")).alias("at"), F.col("e.spec").alias("spec"))
    told = told.groupBy("row", "norm").agg(F.first("doc").alias("doc"), F.max_by("name", "at").alias("name"), F.min("at").alias("at"), F.max_by("spec", "at").alias("spec"))
    pick = lambda c, i: F.regexp_extract(c, _ADD, i)
    added = d.select("row", F.explode("adds").alias("c")).select("row", norm(pick(F.col("c"), 1)).alias("norm"), F.filter(F.split(trim(F.concat_ws("", *(pick(F.col("c"), i) for i in (2, 3, 4)))), r"[,\s]+"), lambda f: f != "").alias("f")).filter(F.size("f") > 0)
    spec = F.concat(F.lit('{ version = "*", features = ['), F.array_join(F.transform("f", lambda f: F.concat(F.lit('"'), f, F.lit('"'))), ", "), F.lit("] }"))
    added = added.groupBy("row", "norm").agg(F.max_by(spec, F.size("f")).alias("add"))
    f, m = found.alias("f"), told.alias("m")
    joined = f.join(m, ["row", "norm"], "full_outer").join(added, ["row", "norm"], "left")
    rows = joined.select(
        F.coalesce("f.doc", "m.doc").alias("doc"), "row", F.coalesce("f.name", "m.name").alias("name"), F.coalesce("m.spec", "add").alias("raw_spec"), F.when(F.col("m.spec").isNotNull(), "manifest").otherwise("pattern").alias("source"),
        F.struct(F.col("f.pos").isNull().alias("late"), F.coalesce(F.col("f.pos").cast("long"), F.col("m.at")).alias("at")).alias("order"),
    )
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("row").orderBy("order")) - 1)
    return rows.select(F.col("doc").alias(doc_id), "pos", "name", "raw_spec", "source")
