"""Column functions for lines, fences, sections and bytes of text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it.
SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def trim(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, rf"\A{SPACE}+|(?<!{SPACE}){SPACE}++\z", "")


def trim_start(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{SPACE}+", "")


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once for the row."""
    return F.transform(F.array(value), use)[0]


#: Elements of a block of a running fold.
_BLOCK_SIZE = 256


def running(items: Column, start: Column, step, out: str) -> Column:
    """What ``step(state, item)``, which returns a struct of ``s`` (the next state) and ``o`` (what the item gives), gives for each item in order; ``out`` is the type of ``o``.

    An array that grows in a fold is copied at each step, so the items are folded in blocks, and the blocks in turn.
    """
    none = F.array().cast(f"array<{out}>")

    def one(acc: Column, x: Column) -> Column:
        return bound(step(acc["s"], x), lambda r: F.struct(r["s"].alias("s"), F.concat(acc["o"], F.array(r["o"])).alias("o")))

    def block(acc: Column, b: Column) -> Column:
        done = F.aggregate(b, F.struct(acc["s"].alias("s"), none.alias("o")), one)
        return bound(done, lambda d: F.struct(d["s"].alias("s"), F.concat(acc["o"], F.array(d["o"])).alias("o")))

    def folded(all_: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(all_) / _BLOCK_SIZE).cast("int") - 1, F.lit(0)))
        cut = F.transform(blocks, lambda b: F.slice(all_, b * _BLOCK_SIZE + 1, F.lit(_BLOCK_SIZE)))
        zero = F.struct(start.alias("s"), F.array().cast(f"array<array<{out}>>").alias("o"))
        return F.aggregate(cut, zero, block, lambda acc: F.flatten(acc["o"]))

    return bound(items, folded)  # once, not once a block


def lines(text: Column) -> Column:
    """The lines of a text without their ends: no line behind a final line feed, none for an empty text, no carriage return before a feed."""
    parts = F.split(F.regexp_replace(text, r"\r\n", "\n"), "\n", -1)
    return F.when(text.isNull(), F.lit(None)).otherwise(
        bound(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))
    )


def contains_any(c: Column, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(p) for p in phrases])


def first_of(c: Column, phrases: list[str]) -> Column:
    """The first phrase of the list that the text contains, or null."""
    return F.coalesce(*[F.when(c.contains(p), F.lit(p)) for p in phrases])


def code_flags(ls: Column) -> Column:
    """One flag for each line: in a fenced code block. An opening fence counts as code, its closing fence does not.

    A fence is three or more backticks or tildes behind white space at most. It is closed by as many of the same or more, with
    nothing but white space behind them.
    """
    marked = lambda x: x.contains("```") | x.contains("~~~")
    mark = lambda x, i: F.struct(i.alias("i"), F.regexp_extract(x, rf"\A{SPACE}*(`{{3,}}+|~{{3,}}+)", 1).alias("f"), x.rlike(rf"\A{SPACE}*(?:`{{3,}}+|~{{3,}}+){SPACE}*\z").alias("b"))
    fences = F.filter(F.transform(ls, lambda x, i: F.when(marked(x), mark(x, i))), lambda m: m.isNotNull() & (m["f"] != ""))

    def step(open_: Column, m: Column) -> Column:
        opens = (open_ == "") & (m["f"] != "")
        closes = (open_ != "") & m["b"] & m["f"].startswith(open_)
        state = F.when(opens, m["f"]).when(closes, F.lit("")).otherwise(open_)
        return F.struct(state.alias("s"), F.struct(m["i"].alias("i"), (state != "").alias("o")).alias("o"))

    def spread(states: Column) -> Column:
        """Lines between fences are as the fence before them says."""
        after = F.transform(states, lambda s, k: F.array_repeat(s["o"], F.coalesce(F.get(states, k + 1)["i"], F.size(ls)) - s["i"]))
        return F.flatten(F.concat(F.array(F.array_repeat(F.lit(False), F.get(states, F.lit(0))["i"])), after))

    folded = bound(running(fences, F.lit(""), step, "struct<i:int,o:boolean>"), lambda states: F.when(F.size(states) > 0, spread(states)))
    return F.coalesce(F.when(F.exists(ls, marked), folded), F.transform(ls, lambda _: F.lit(False)))


#: The same without the line feed.
_INDENT = SPACE.replace(r"\t-\r", r"\t\x0B-\r")
#: A fenced block for the rule scanner: the rest of the closing line is free, and an unclosed block runs to the end.
_BLOCK = rf"(?dms)^{_INDENT}*(`{{3,}}+|~{{3,}}+)[^\n]*+(?:\n|\z)(.*?)(?:^{_INDENT}*\1|\z)"


def mask_code(text: Column) -> Column:
    """The text with every character of its fenced code blocks, but no line feed, replaced by U+0000. Offsets and lines stay."""
    blocks = F.regexp_extract_all(text, F.lit(_BLOCK), 0)
    head = lambda b: F.regexp_extract(b, r"(?s)\A[^\n]*(?:\n|\z)", 0)
    tail = lambda b: F.regexp_extract(b, rf"(?d)\n{SPACE}*(?:`{{3,}}|~{{3,}})\z", 0)

    def hide(b: Column) -> Column:
        inner = F.substr(b, F.length(head(b)) + 1, F.greatest(F.length(b) - F.length(head(b)) - F.length(tail(b)), F.lit(0)))
        return F.concat(head(b), F.regexp_replace(inner, r"[^\n]", "\x00"), F.substr(b, F.greatest(F.length(b) - F.length(tail(b)), F.length(head(b))) + 1))

    pieces = F.zip_with(F.split(text, _BLOCK, -1), F.transform(blocks, hide), lambda p, b: F.concat(F.coalesce(p, F.lit("")), F.coalesce(b, F.lit(""))))
    return F.when(text.contains("```") | text.contains("~~~"), F.array_join(pieces, "")).otherwise(text)


def fenced_blocks(text: Column) -> Column:
    """(tag, body) of the fenced blocks whose fences begin lines. The tag is lower-cased, the body trimmed; an unclosed block ends the search."""
    found = F.regexp_extract_all(text, F.lit(r"(?dms)^(`{3,}+|~{3,}+)[^\n`]*\n.*?^\1[`~]*[ \t]*$"), 0)
    tag = lambda b: F.lower(trim(F.regexp_extract(b, r"\A(?:`+|~+)([^\n]*)", 1)))
    body = lambda b: trim(F.regexp_replace(F.regexp_replace(b, r"\A[^\n]*\n", ""), r"(?d)(?:\A|\n)[`~]+[ \t]*\z", ""))
    return F.transform(found, lambda b: F.struct(tag(b).alias("tag"), body(b).alias("body")))


def section(text: Column, heading: str) -> Column:
    """The text from a second-level heading (a pattern) to the next one, or null."""
    got = F.regexp_extract(text, rf"(?dms)^##\s+(?:{heading})[^\n]*(?:\n|\z)(.*?)(?=^##\s|\z)", 1)
    return F.when(text.rlike(rf"(?dm)^##\s+(?:{heading})"), got)


def subsections(body: Column) -> Column:
    """(name, description, code) of the third-level headings of a section, in order: text before the first fence, and its body."""
    parts = F.slice(F.split(F.concat(F.lit("\n"), body), r"\n###[ \t]+", -1), 2, F.greatest(F.size(F.split(body, "\n")), F.lit(1)))
    name = lambda p: trim(F.regexp_extract(p, r"\A([^\n]*)", 1))
    rest = lambda p: F.regexp_replace(p, r"\A[^\n]*\n?", "")
    made = F.transform(
        parts,
        lambda p: F.struct(
            name(p).alias("name"), trim(F.regexp_extract(rest(p), r"(?dms)\A(.*?)(?=^```|^~~~|\z)", 1)).alias("description"),
            F.element_at(F.concat(fenced_blocks(rest(p))["body"], F.array(F.lit(""))), 1).alias("code"),
        ),
    )
    return F.filter(made, lambda s: s["code"] != "")


def frontmatter(text: Column) -> Column:
    """The keys of the block between the first line, which begins with ---, and the next such line.

    Indented keys become ``block.key`` behind the key without a value above them. Quotes go; the last of equal keys counts.
    """
    head = F.regexp_extract(text, r"(?dms)\A---[^\n]*\n(.*?)(?:^---|\z)", 1)

    def step(block: Column, line: Column) -> Column:
        key = trim(F.regexp_extract(line, r"\A([^:]*):", 1))
        value = F.regexp_replace(trim(F.regexp_extract(line, r"(?s)\A[^:]*:(.*)\z", 1)), '^"+|"+$', "")
        deep = line.rlike(r"\A[ \t]")
        named = line.contains(":") & (key != "")
        after = F.when(named & ~deep, F.when(value == "", key).otherwise(F.lit(""))).otherwise(block)
        full = F.when(deep & (block != ""), F.concat(block, F.lit("."), key)).otherwise(key)
        return F.struct(after.alias("s"), F.when(named & (value != ""), F.struct(full.alias("k"), value.alias("v"))).alias("o"))

    def last(said: Column) -> Column:
        """Of equal keys the last entry, in the order of these."""
        numbered = F.filter(F.transform(said, lambda e, i: F.struct(e["k"].alias("k"), i.alias("i"), e["v"].alias("v"))), lambda e: e["k"].isNotNull())
        only = bound(F.array_sort(numbered), lambda s: F.filter(s, lambda e, j: F.coalesce(F.get(s, j + 1)["k"] != e["k"], F.lit(True))))
        return F.map_from_entries(F.transform(F.array_sort(F.transform(only, lambda e: F.struct(e["i"].alias("i"), e["k"].alias("k"), e["v"].alias("v")))), lambda e: F.struct(e["k"].alias("k"), e["v"].alias("v"))))

    folded = last(running(lines(head), F.lit(""), step, "struct<k:string,v:string>"))
    return F.when(text.rlike(r"\A---"), folded).otherwise(F.create_map().cast("map<string,string>"))


def byte_prefix(text: Column, n: int) -> Column:
    """The first ``n`` bytes of a text, without a character cut short at the end."""
    cut = F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, n).cast("string"))
    return F.when(F.octet_length(text) <= n, text).otherwise(F.regexp_replace(cut, "�\\z", ""))
