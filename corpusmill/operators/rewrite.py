"""Rewrites that bring a Markdown document into normal form, each a function of a text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, bound, lines, running, trim, trim_start

# Openings of remarks about the text, behind its last heading.
TRAILING = [
    "summary of fixes", "summary of changes made", "summary of all fixes", "summary of all changes", "changes made:", "fixes made:", "fixes applied:", "what was fixed",
    "here is the corrected", "here is the updated", "here is the fixed", "here are the fixes", "i have made", "i've made",
]
_DASH = rf"{SPACE}*---{SPACE}*"
_FENCE = rf"\A{SPACE}*(?:```|~~~)"


def strip_invisible(text: Column) -> Column:
    """Without zero-width and other invisible characters."""
    return F.regexp_replace(text, r"[\x{200B}-\x{200D}\x{FEFF}\x{AD}\x{2060}-\x{2064}\x{180E}]", "")


def _joined(ls: Column, text: Column) -> Column:
    """Lines as a text that ends with a line feed if ``text`` does."""
    out = F.array_join(ls, "\n")
    return F.when(text.endswith("\n") & ~out.endswith("\n"), F.concat(out, F.lit("\n"))).otherwise(out)


def _dash(ls: Column, n: int) -> Column:
    """The number, from 1, of the n-th delimiter line, or null."""
    return F.get(F.filter(F.transform(ls, lambda x, i: F.when(trim(x) == "---", i + 1)), lambda i: i.isNotNull()), F.lit(n - 1))


def _from(ls: Column, start: Column) -> Column:
    return F.slice(ls, F.greatest(start, F.lit(1)), F.size(ls) + 1)


def _to(ls: Column, stop: Column) -> Column:
    return F.slice(ls, F.lit(1), F.greatest(stop, F.lit(0)))


def _below_block(text: Column, fix) -> Column:
    """``fix(lines, number of the line that closes the block, or null)``, each worked out once: functions of a line would else look for it at every line."""
    return bound(lines(text), lambda ls: bound(_dash(ls, 2), lambda b: fix(ls, b)))


def create_frontmatter(name: Column, version: Column, ecosystem: Column, licence: Column, generator: Column) -> Column:
    quoted = F.replace(F.replace(name, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(
        F.lit('---\nname: "'), quoted, F.lit('"\ndescription: '), ecosystem, F.lit(" library\n"), F.coalesce(F.concat(F.lit("license: "), licence), F.lit("# license: Unknown")),
        F.lit('\nmetadata:\n  version: "'), version, F.lit('"\n  ecosystem: '), ecosystem, F.coalesce(F.concat(F.lit("\n  generated-by: "), generator), F.lit("")), F.lit("\n---\n\n"),
    )


def ensure_frontmatter(text: Column, name: Column, version: Column, ecosystem: Column, licence: Column, generator: Column) -> Column:
    """The text with a block of name, description and version in front.

    A block behind a preamble moves up, one of the wrong shape is replaced, and the generator's line is set in a right one.
    """
    def recover(t: Column) -> Column:
        block = F.regexp_extract(t, rf"(?s)\n---\n(.*?)(?:\n|(?<=\n)){_DASH}(?:\n|\z)", 1)
        body = F.regexp_extract(t, rf"(?s)\n---\n.*?(?:\n|(?<=\n)){_DASH}(\n.*|\z)", 1)
        fits = ~t.startswith("---") & t.contains("\n---\n") & block.contains("name:") & block.contains("description:")
        return F.when(fits, F.concat(F.lit("---\n"), F.regexp_replace(block, rf"{SPACE}+\z", ""), F.lit("\n---"), body)).otherwise(t)

    def shape(t: Column) -> Column:
        split = rf"(?s)\A---(.*?\n){SPACE}*---(.*)\z"
        block, rest = F.regexp_extract(t, split, 1), F.regexp_extract(t, split, 2)
        right = block.contains("name:") & block.contains("description:") & (block.contains("version:") | block.contains("metadata:"))
        line = r"(?m)^([ \t]*)(?:generated-by|generated_with):.*$"
        marked = F.regexp_replace(block, F.lit(line), F.concat(F.lit("$1generated-by: "), F.regexp_replace(generator, r"([\\$])", r"\\$1")))
        under = F.regexp_replace(block, F.lit(r"(?m)^metadata:[ \t]*$"), F.concat(F.lit("metadata:\n  generated-by: "), F.regexp_replace(generator, r"([\\$])", r"\\$1")))
        added = F.when(block.rlike(line), marked).when(block.rlike(r"(?m)^metadata:[ \t]*$"), under).otherwise(F.concat(block, F.lit("metadata:\n  generated-by: "), generator, F.lit("\n")))
        kept = F.when(generator.isNull(), t).otherwise(F.concat(F.lit("---"), added, F.lit("---"), rest))
        new = create_frontmatter(name, version, ecosystem, licence, generator)
        return F.when(t.rlike(split), F.when(right, kept).otherwise(F.concat(new, trim_start(rest)))).otherwise(F.concat(new, t))

    return bound(recover(trim_start(text)), shape)


def clean_frontmatter(text: Column) -> Column:
    """Without blank lines in the block, and with bare delimiters."""

    def fix(ls: Column) -> Column:
        a, b = _dash(ls, 1), _dash(ls, 2)
        block = F.filter(F.slice(ls, a + 1, b - a - 1), lambda x: trim(x) != "")
        return F.when(b.isNotNull(), _joined(F.concat(_to(ls, a - 1), F.array(F.lit("---")), block, F.array(F.lit("---")), _from(ls, b + 1)), text)).otherwise(text)

    return bound(lines(text), fix)


def strip_duplicate_frontmatter(text: Column) -> Column:
    """Without a second block before the first heading that has two or more keys."""

    def fix(ls: Column) -> Column:
        c, d = _dash(ls, 3), _dash(ls, 4)
        heading = F.get(F.filter(F.transform(ls, lambda x, i: F.when(trim_start(x).startswith("## "), i + 1)), lambda i: i.isNotNull()), F.lit(0))
        keys = F.size(F.filter(F.slice(ls, c + 1, d - c - 1), lambda x: trim(x).rlike(r"\A[a-z_-]+\s*:")))
        after = F.array_join(_from(ls, d + 1), "\n")
        fixed = F.concat(F.array_join(F.concat(_to(ls, c - 1), F.array(F.regexp_replace(after, rf"\A(?:{SPACE}*\n)+", ""))), "\n"), F.lit("\n"))
        return F.when(d.isNotNull() & (heading.isNull() | (heading > c)) & (keys >= 2), fixed).otherwise(text)

    return bound(lines(text), fix)


def strip_meta_text(text: Column) -> Column:
    """Without remarks between the block and the first heading or fence."""

    def fix(ls: Column, b: Column) -> Column:
        start = F.get(F.filter(F.transform(ls, lambda x, i: F.when((i + 1 > b) & trim(x).rlike(r"\A(?:#|```|~~~)"), i + 1)), lambda i: i.isNotNull()), F.lit(0))
        said = F.exists(F.slice(ls, b + 1, F.greatest(start - b - 1, F.lit(0))), lambda x: trim(x) != "")
        return F.when(start.isNotNull() & said, F.concat(F.array_join(_to(ls, b), "\n"), F.lit("\n\n"), F.array_join(_from(ls, start), "\n"), F.lit("\n"))).otherwise(text)

    return _below_block(text, fix)


def strip_leaked_metadata(text: Column) -> Column:
    """Without generator lines in the body's prose. Here every line that begins with a fence opens or closes code."""

    def fix(ls: Column, b: Column) -> Column:
        fence = F.transform(ls, lambda x: x.rlike(_FENCE))
        counted = F.transform(fence, lambda f, i: f & (i >= b))
        inside = running(counted, F.lit(False), lambda s, f: F.struct((s != f).alias("s"), (s != f).alias("o")), "boolean")
        both = F.zip_with(ls, inside, lambda x, f: F.struct(x.alias("x"), f.alias("f")))
        kept = F.filter(both, lambda s, i: (i < b) | s["f"] | ~F.lower(trim(s["x"])).startswith("generated-by:"))
        return bound(kept, lambda k: F.when(b.isNotNull() & (F.size(k) < F.size(ls)), _joined(F.transform(k, lambda s: s["x"]), text)).otherwise(text))

    return F.when(F.lower(text).contains("generated-by:"), _below_block(text, fix)).otherwise(text)


def strip_trailing_meta_text(text: Column) -> Column:
    """Without a closing remark behind the last heading, if only lists, code, numbers and blank lines follow it."""
    opening = r"(?i)(?:" + "|".join(TRAILING) + ")"
    tail_line = rf"(?:[ \t]*|[ \t]*[-*].*|[ \t]*[0-9].*|(?:  |\t).*|.*{opening}.*)"
    fenced = r"[ \t]*(?:```|~~~)[^\n]*(?:\n(?![ \t]*(?:```|~~~))[^\n]*)*(?:\n[ \t]*(?:```|~~~)[^\n]*)?"
    last = F.regexp_extract(text, r"(?s)\A((?:.*\n)?## [^\n]*\n)", 1)
    rest = F.substr(text, F.length(last) + 1)
    cut = F.regexp_replace(rest, rf"(?:\A|(?<=\n))[ \t]*{opening}[^\n]*(?:\n(?:{fenced}|{tail_line}))*\n?\z", "")
    return F.when((last != "") & rest.rlike(opening), F.concat(last, cut)).otherwise(text)


def strip_control_comments(text: Column, marker: str) -> Column:
    """Without lines that begin with a comment reserved for tools."""
    kept = F.filter(lines(text), lambda x: ~trim(x).startswith(f"<!-- {marker}"))
    return F.when(text.contains(f"<!-- {marker}"), _joined(kept, text)).otherwise(text)


def strip_body_fence(text: Column) -> Column:
    """Without a Markdown fence around the whole body. Tagged fences within it nest."""

    def fix(ls: Column, b: Column) -> Column:
        first = F.get(F.filter(F.transform(ls, lambda x, i: F.when((i + 1 > b) & (trim(x) != ""), i + 1)), lambda i: i.isNotNull()), F.lit(0))
        wrapped = trim(F.get(ls, first - 1)).isin("```markdown", "```md", "```text")
        start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("close"))

        def step(a: Column, x: Column) -> Column:
            t = trim(x)
            opens, bare = t.rlike(r"\A(?:```|~~~)\s*[^\s]") & ~t.isin("```", "~~~"), t.isin("```", "~~~")
            ends = bare & (a["depth"] == 0) & a["close"].isNull()
            return F.struct(
                F.when(opens, a["depth"] + 1).when(bare & (a["depth"] > 0), a["depth"] - 1).otherwise(a["depth"]).alias("depth"),
                (a["n"] + 1).alias("n"), F.when(ends, a["n"] + 1).otherwise(a["close"]).alias("close"),
            )

        inner = _from(ls, first + 1)
        close = F.coalesce(F.aggregate(inner, start, step, lambda a: a["close"]), F.size(inner) + 1)
        out = F.concat(F.array_join(F.concat(_to(ls, b), F.array(F.lit("")), _to(inner, close - 1)), "\n"), F.lit("\n"))
        return F.when(b.isNotNull() & F.coalesce(wrapped, F.lit(False)), out).otherwise(text)

    return _below_block(text, fix)


def close_fence(text: Column) -> Column:
    """With a fence at the end if the number of fences is odd."""
    odd = F.size(F.filter(lines(text), lambda x: x.rlike(_FENCE))) % 2 == 1
    return F.when(odd, F.concat(text, F.when(text.endswith("\n"), "").otherwise("\n"), F.lit("```\n"))).otherwise(text)


def ensure_references(text: Column, urls: Column) -> Column:
    """With a section of references, from an array of (name, url), if there are any and the text has none."""
    items = F.array_join(F.transform(urls, lambda u: F.concat(F.lit("- ["), u["name"], F.lit("]("), u["url"], F.lit(")\n"))), "")
    need = (F.coalesce(F.size(urls), F.lit(0)) > 0) & ~text.contains("## References")
    return F.when(need, F.concat(text, F.lit("\n## References\n\n"), items)).otherwise(text)


def unwrap_fence(text: Column) -> Column:
    """What is inside, if one fence goes around the whole text."""
    t = trim(text)
    inner = F.regexp_extract(t, r"(?s)\A(`{3,}|~{3,})[^\n]*\n(.*?)\n?[ \t]*\1[`~]*\z", 2)
    return F.when(t.rlike(r"(?s)\A(`{3,}|~{3,})[^\n]*\n.*\1[`~]*\z"), inner).otherwise(text)


def xml_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def normalise(
    docs: DataFrame, *, text: str = "text", name: str = "name", version: str = "version", ecosystem: str = "ecosystem", licence: str = "license", urls: str | None = None,
    generator: str | None = None, marker: str = "TOOL-", into: str = "normal",
) -> DataFrame:
    """``docs`` with ``into``: all rewrites in order. A null text counts as empty; each step is its own projection."""
    c = F.col(into)
    gen = F.lit(generator).cast("string")
    steps = [
        lambda t: ensure_frontmatter(t, F.col(name), F.col(version), F.col(ecosystem), F.col(licence), gen), clean_frontmatter, strip_duplicate_frontmatter, strip_meta_text,
        strip_leaked_metadata, strip_trailing_meta_text, lambda t: strip_control_comments(t, marker), strip_body_fence, close_fence,
        *([lambda t: ensure_references(t, F.col(urls))] if urls else []),
    ]
    d = docs.withColumn(into, F.coalesce(F.col(text), F.lit("")))
    for step in steps:
        d = d.withColumn(into, bound(c, step))
    return d
