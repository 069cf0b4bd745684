"""Rules as text: strings with modifiers, and conditions over them, compiled to columns.

::

    rule shell_in_prose : tags are ignored
    {
        meta:
            id = "X-1"  severity = "high"  category = "code-execution"  description = "..."  prose_only = true
        strings:
            $a = "literal \\x41" nocase fullword      // ascii, wide
            $b = /regular (expression|one)/i          /* flags i and s */
            $c = { 7F 45 ?? [2-4] ( 4C | 46 ) }       // bytes
        condition:
            ($a and #b > 2) or $c at 0 or any of ($b*, $c) or for any of them : ( @ > 64 )
    }

Conditions have ``and or not``, comparisons of whole numbers with ``+ - *``, ``#x`` (matches; each start counts), ``@x`` (offset of the first match in bytes,
of a string that isn't found undefined, so that no comparison with it holds), ``filesize``, ``$x at n``, ``$x in (a..b)``, ``any | all | none | n of`` a set and ``for ...
of`` a set. Whatever else the text has is refused with its line, as a scan must not run with a rule that means something else.

Bytes beyond ASCII that are a character in UTF-8 are looked for as that character; other patterns of bytes are matched against the text's bytes.
The condition of a ``prose_only`` rule sees matches outside fenced code only.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import bound
from .rules import SEVERITIES, Pattern, Rule, check

# What threat types are called here.
CATEGORIES = {
    "unicode-steganography": "unicode-attack", "injection-attack": "prompt-injection", "credential-harvesting": "credential-access", "autonomy-abuse": "privilege-escalation",
    "system-manipulation": "filesystem-write", "tool-chaining-abuse": "resource-abuse",
}
KNOWN = ["unicode-attack", "prompt-injection", "code-execution", "credential-access", "data-exfiltration", "obfuscation", "persistence", "privilege-escalation", "filesystem-write", "resource-abuse"]
_UNITS = {"": 1, "KB": 1 << 10, "MB": 1 << 20}


@dataclass
class Seen:
    """What a condition is worked out on."""

    found: dict[str, Column]
    patterns: dict[str, Pattern]
    text: Column


Value = Callable[[Seen], Column]


class _Reader:
    """Reads a text from the front; what it can't read is an error with its line."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def fail(self, what: str) -> None:
        raise ValueError(f"line {self.text.count(chr(10), 0, self.at) + 1}: {what}, at {self.text[self.at : self.at + 20]!r}")

    def space(self) -> None:
        self.at = re.compile(r"(?:\s+|//[^\n]*|/\*.*?\*/)*", re.S).match(self.text, self.at).end()

    def take(self, pattern: str) -> re.Match | None:
        self.space()
        m = re.compile(pattern, re.S).match(self.text, self.at)
        if m:
            self.at = m.end()
        return m

    def need(self, pattern: str, what: str) -> re.Match:
        return self.take(pattern) or self.fail(f"{what} is missing")

    def word(self, word: str) -> bool:
        return self.take(rf"{word}\b") is not None


def parse(text: str) -> list[Rule]:
    """The rules of a text, in order."""
    r, rules = _Reader(text), []
    while True:
        r.space()
        if r.at == len(text):
            break
        r.need(r"rule\b", "'rule'")
        rules.append(_rule(r))
    names = [x.id for x in rules]
    if len(set(names)) < len(names):
        raise ValueError(f"rules with the same id: {sorted({n for n in names if names.count(n) > 1})}")
    return check(rules)


def load(folder: str | Path) -> list[Rule]:
    """The rules of the ``.yar`` and ``.yara`` files of a folder, in the order of their paths."""
    files = sorted(p for p in Path(folder).iterdir() if p.suffix in (".yar", ".yara"))
    return check([rule for p in files for rule in parse(p.read_text("utf-8"))])


def _rule(r: _Reader) -> Rule:
    name = r.need(r"[A-Za-z_]\w*", "a name")[0]
    if r.take(":"):
        r.need(r"[A-Za-z_]\w*(?:\s+[A-Za-z_]\w*)*", "a tag")
    r.need(r"\{", "'{'")
    meta: dict[str, str] = {}
    if r.take(r"meta\s*:"):
        while m := r.take(r"(?!strings\s*:|condition\s*:)([A-Za-z_]\w*)\s*=\s*"):
            value = r.take(r'"((?:[^"\\\n]|\\.)*)"')
            meta[m[1]] = _plain(r, value[1]) if value else r.need(r"true\b|false\b|-?\d+", "a value")[0]
    patterns: list[Pattern] = []
    if r.take(r"strings\s*:"):
        while m := r.take(r"\$(\w+)\s*=\s*"):
            if m[1] in (p.name for p in patterns):
                r.fail(f"${m[1]} is there twice")
            patterns.append(_string(r, m[1]))
    r.need(r"condition\s*:", "'condition:'")
    used: set[str] = set()
    when = _Condition(r, [p.name for p in patterns], used).whole()
    r.need(r"\}", "'}'")
    if unused := [p.name for p in patterns if p.name not in used]:
        r.fail(f"${unused[0]} is in no condition")
    severity = meta.get("severity", "medium").lower()
    category = meta.get("category", meta.get("threat_type", "")).lower().replace(" ", "-")
    category = CATEGORIES.get(category, category)
    return Rule(
        meta.get("id", name), severity if severity in SEVERITIES else "info", category if category in KNOWN else "code-execution", tuple(patterns), meta.get("description", name),
        meta.get("prose_only", "").lower() == "true", lambda found, named, text: when(Seen(found, named, text)),
    )


def _bytes(r: _Reader, body: str) -> bytes:
    """A string's text with its escapes worked out."""
    known = {"n": b"\n", "t": b"\t", "r": b"\r", '"': b'"', "\\": b"\\"}
    out, i = b"", 0
    while i < len(body):
        if body[i] != "\\":
            out += body[i].encode()
            i += 1
        elif m := re.compile(r"\\x([0-9A-Fa-f]{2})").match(body, i):
            out += bytes.fromhex(m[1])
            i = m.end()
        elif body[i + 1] in known:
            out += known[body[i + 1]]
            i += 2
        else:
            r.fail(f"the escape {body[i : i + 2]} is not known")
    return out


def _plain(r: _Reader, body: str) -> str:
    return _bytes(r, body).decode("utf-8", "replace")


def _utf8(data: bytes) -> str | None:
    try:
        return data.decode()
    except UnicodeDecodeError:
        return None


def _escaped(data: bytes) -> str:
    return "".join(f"\\x{b:02X}" for b in data)


def _string(r: _Reader, name: str) -> Pattern:
    if m := r.take(r'"((?:[^"\\\n]|\\.)*)"'):
        data, mods = _bytes(r, m[1]), _modifiers(r, {"nocase", "ascii", "wide", "fullword"})
        if not data:
            r.fail("the string is empty")
        text = _utf8(data)
        forms = ([data] if "wide" not in mods or "ascii" in mods else []) + ([b"".join(bytes((b, 0)) for b in data)] if "wide" in mods else [])
        if forms == [data] and "fullword" not in mods and text is not None:
            return Pattern(name, text, False, "nocase" in mods)
        raw = any(_utf8(f) is None for f in forms)
        body = "|".join(_escaped(f) if raw else re.escape(f.decode()) for f in forms)
        if "fullword" in mods:
            body = rf"(?<![0-9A-Za-z])(?:{body})(?![0-9A-Za-z])"
        return Pattern(name, body, True, "nocase" in mods, raw)
    if m := r.take(r"/((?:[^/\\\n]|\\.)+)/([a-z]*)"):
        body, flags = m[1].replace("|$)", ")"), m[2]
        mods = _modifiers(r, {"nocase", "ascii", "fullword"})
        if set(flags) - set("is"):
            r.fail(f"the flags {flags} are not known")
        try:
            re.compile(re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda h: f"\\U{int(h[1], 16):08X}", body))
        except re.error as e:
            r.fail(f"${name} is no regular expression ({e})")
        raw = re.search(r"(?<!\\)(?:\\\\)*\\x[89A-Fa-f][0-9A-Fa-f]", body) is not None
        if raw:  # one character a byte
            body = body.encode().decode("latin-1")
        if "s" in flags:
            body = f"(?s:{body})"
        if "fullword" in mods:
            body = rf"(?<![0-9A-Za-z])(?:{body})(?![0-9A-Za-z])"
        return Pattern(name, body, True, "i" in flags or "nocase" in mods, raw)
    if r.take(r"\{"):
        body = _hex(r, "}")
        plain = re.fullmatch(r"(?:\\x[0-9A-F]{2})+", body)
        text = _utf8(bytes.fromhex(body.replace("\\x", ""))) if plain else None
        return Pattern(name, text, False) if text is not None else Pattern(name, body, True, False, True)
    return r.fail("a string, a regular expression or bytes are missing")


def _modifiers(r: _Reader, known: set[str]) -> set[str]:
    mods = set()
    while m := r.take(r"(?!condition\b)[a-z]\w*"):
        if m[0] not in known:
            r.fail(f"the modifier {m[0]} is not known")
        mods.add(m[0])
    return mods


def _hex(r: _Reader, end: str) -> str:
    """Bytes, wildcards, jumps and alternatives up to ``end``, as an expression over one character a byte."""
    out = []
    while not r.take(re.escape(end)):
        if m := r.take(r"([0-9A-Fa-f?])([0-9A-Fa-f?])"):
            a, b = m[1].upper(), m[2].upper()
            digits = [f"{x}{y}" for x in ("0123456789ABCDEF" if a == "?" else a) for y in ("0123456789ABCDEF" if b == "?" else b)]
            out.append(r"[\x00-\xFF]" if a == b == "?" else f"\\x{digits[0]}" if len(digits) == 1 else "[" + "".join(f"\\x{d}" for d in digits) + "]")
        elif m := r.take(r"\[\s*(\d+)?\s*(-)?\s*(\d+)?\s*\]"):
            low, high = m[1] or "0", (m[3] or "") if m[2] else m[1] or r.fail("the jump has no length")
            out.append(rf"[\x00-\xFF]{{{low}}}" if low == high else rf"[\x00-\xFF]{{{low},{high}}}?")
        elif r.take(r"\("):
            branches = [_hex(r, "|")] if _before(r, "|") else []
            while _before(r, "|"):
                branches.append(_hex(r, "|"))
            out.append("(?:" + "|".join([*branches, _hex(r, ")")]) + ")")
        else:
            r.fail("bytes are missing")
    return "".join(out) or r.fail("there are no bytes")


def _before(r: _Reader, mark: str) -> bool:
    """Whether ``mark`` comes before the bracket that closes the one just opened."""
    depth = 0
    for c in re.sub(r"//[^\n]*|/\*.*?\*/", "", r.text[r.at :], flags=re.S):
        if c == mark and not depth:
            return True
        depth += {"(": 1, ")": -1}.get(c, 0)
        if depth < 0:
            return False
    return False


class _Condition:
    """Reads a condition. Each part is a function of what a text shows; ``it`` is the string that a ``for`` stands at."""

    def __init__(self, r: _Reader, names: list[str], used: set[str], it: str | None = None):
        self.r, self.names, self.used, self.it = r, names, used, it

    def whole(self) -> Value:
        """A truth value: branches joined by ``or``."""
        parts = [self._all()]
        while self.r.word("or"):
            parts.append(self._all())
        return parts[0] if len(parts) == 1 else lambda s: reduce(lambda a, b: a | b, (p(s) for p in parts))

    def _all(self) -> Value:
        parts = [self._not()]
        while self.r.word("and"):
            parts.append(self._not())
        return parts[0] if len(parts) == 1 else lambda s: reduce(lambda a, b: a & b, (p(s) for p in parts))

    def _not(self) -> Value:
        if self.r.word("not"):
            inner = self._not()
            return lambda s: ~inner(s)
        return self._one()

    def _one(self) -> Value:
        r = self.r
        if m := r.take(r"(true|false)\b"):
            return lambda s: F.lit(m[1] == "true")
        if r.word("for"):
            least = self._quantity()
            names = self._set()
            r.need(":", "':'")
            r.need(r"\(", "'('")
            start, parts = r.at, []
            for n in names:
                r.at = start
                parts.append(_Condition(r, self.names, self.used, n).whole())
            r.need(r"\)", "')'")
            return self._at_least(least, parts)
        start = r.at
        if m := r.take(r"(?:any|all|none|\d+)\s+of\b"):
            r.at = start
            least = self._quantity()
            return self._at_least(least, [self._found(n) for n in self._set()])
        if m := r.take(r"\$(\w*)(\*)?"):
            if m[2]:
                r.fail("a set of strings stands alone")
            name = self._name(m[1])
            if r.word("at"):
                where = self._number()
                return lambda s: s.found[name] & F.coalesce(starts_at(s.patterns[name], s.text, where(s)), F.lit(False))
            if r.word("in"):
                r.need(r"\(", "'('")
                low = self._number()
                r.need(r"\.\.", "'..'")
                high = self._number()
                r.need(r"\)", "')'")
                return lambda s: s.found[name] & F.coalesce(starts_within(s.patterns[name], s.text, low(s), high(s)), F.lit(False))
            return self._found(name)
        if r.take(r"\("):  # a truth value, or a number that is compared
            inside = r.at
            try:
                inner = self.whole()
                r.need(r"\)", "')'")
                if not r.take(r"(?=[<>=!+*-])"):
                    return inner
            except ValueError:
                failed = r.at
                try:
                    r.at = start
                    return self._compared()
                except ValueError:
                    r.at = failed
                    raise
            r.at = inside
        r.at = start
        return self._compared()

    def _compared(self) -> Value:
        a = self._number()
        op = self.r.need(r"<=|>=|==|!=|<|>", "a comparison")[0]
        b = self._number()
        use = {"<": Column.__lt__, ">": Column.__gt__, "<=": Column.__le__, ">=": Column.__ge__, "==": Column.__eq__, "!=": Column.__ne__}[op]
        return lambda s: F.coalesce(use(a(s), b(s)), F.lit(False))

    def _number(self) -> Value:
        value = self._product()
        while m := self.r.take(r"[+-]"):
            value = self._joined(value, m[0], self._product())
        return value

    def _product(self) -> Value:
        value = self._atom()
        while self.r.take(r"\*"):
            value = self._joined(value, "*", self._atom())
        return value

    @staticmethod
    def _joined(a: Value, op: str, b: Value) -> Value:
        use = {"+": Column.__add__, "-": Column.__sub__, "*": Column.__mul__}[op]
        return lambda s: use(a(s), b(s))

    def _atom(self) -> Value:
        r = self.r
        if m := r.take(r"(?:0x([0-9A-Fa-f]+)|(\d+)(KB|MB)?)\b"):
            n = int(m[1], 16) if m[1] else int(m[2]) * _UNITS[m[3] or ""]
            return lambda s: F.lit(n).cast("long")
        if r.word("filesize"):
            return lambda s: F.octet_length(s.text).cast("long")
        if m := r.take(r"#(\w*)"):
            name = self._name(m[1])
            return lambda s: F.when(s.found[name], count(s.patterns[name], s.text)).otherwise(0).cast("long")
        if m := r.take(r"@(\w*)(?:\s*\[\s*1\s*\])?"):
            name = self._name(m[1])
            return lambda s: F.when(s.found[name], offset(s.patterns[name], s.text)).cast("long")
        if r.take(r"\("):
            value = self._number()
            r.need(r"\)", "')'")
            return value
        return r.fail("a number is missing")

    def _name(self, name: str) -> str:
        name = name or self.it or self.r.fail("the string has no name")
        if name not in self.names:
            self.r.fail(f"${name} is not known")
        self.used.add(name)
        return name

    def _found(self, name: str) -> Value:
        self.used.add(name)
        return lambda s: s.found[name]

    def _quantity(self) -> str:
        return self.r.need(r"any\b|all\b|none\b|\d+\b", "a quantity")[0]

    def _set(self) -> list[str]:
        r = self.r
        r.need(r"of\b", "'of'")
        if r.word("them"):
            names = list(self.names)
        else:
            r.need(r"\(", "'('")
            names = []
            while True:
                m = r.need(r"\$(\w+)(\*)?|\$\*", "a string")
                some = self.names if m[1] is None else [n for n in self.names if n.startswith(m[1])] if m[2] else [self._name(m[1])]
                names += some or r.fail(f"no string is called {m[0]}")
                if not r.take(","):
                    break
            r.need(r"\)", "')'")
        self.used.update(names)
        return names or r.fail("there are no strings")

    def _at_least(self, quantity: str, parts: list[Value]) -> Value:
        if quantity == "none":
            return lambda s: ~reduce(lambda a, b: a | b, (p(s) for p in parts))
        n = {"any": 1, "all": len(parts)}.get(quantity) or int(quantity)
        if n == 1:
            return lambda s: reduce(lambda a, b: a | b, (p(s) for p in parts))
        return lambda s: reduce(lambda a, b: a + b, (p(s).cast("int") for p in parts)) >= n


def count(p: Pattern, text: Column) -> Column:
    """The places where a match begins; matches may overlap."""
    return F.regexp_count(p.view(text), F.lit(f"{p.flags()}(?={p.body_source()})"))


def offset(p: Pattern, text: Column) -> Column:
    """The bytes before the first match; null without one."""
    view = p.view(text)
    at = F.regexp_instr(view, F.lit(p.source()))
    before = F.substr(view, F.lit(1), at - 1)
    return F.when(at > 0, F.length(before) if p.raw else F.octet_length(before))


def _from(p: Pattern, text: Column, n: Column) -> Column:
    """The text from byte ``n``, behind the one character before it; null within a character or beyond the end."""
    data = text.cast("binary")
    if p.raw:
        view = p.view(text)
        return F.when(n < F.length(view), F.substr(view, n.cast("int"), F.length(view)))
    head, tail = F.substr(data, F.lit(1), n.cast("int")).cast("string"), F.substr(data, (n + 1).cast("int")).cast("string")
    whole = ~F.substr(data, (n + 1).cast("int"), F.lit(1)).between(F.lit(b"\x80"), F.lit(b"\xbf"))
    return F.when((n < F.octet_length(text)) & whole, F.concat(F.right(F.make_valid_utf8(head), F.lit(1)), tail))


def starts_at(p: Pattern, text: Column, n: Column) -> Column:
    """Whether a match begins at byte ``n``."""
    first = p.view(text).rlike(rf"{p.flags()}\A(?:{p.body_source()})")
    return F.when(n == 0, first).when(n > 0, _from(p, text, n).rlike(rf"{p.flags()}\A(?s:.)(?:{p.body_source()})"))


def _next_character(text: Column, low: Column, high: Column) -> Column:
    """The byte ``low``, or if it is within a character the one behind that character, as far as ``high`` goes."""
    span = F.least(high - low + 1, F.octet_length(text).cast("long")).cast("int")
    rest = F.decode(F.substr(text.cast("binary"), (low + 1).cast("int"), span), "ISO-8859-1")
    return F.when(low < F.octet_length(text), low + F.length(F.regexp_extract(rest, r"\A[\x80-\xBF]*+", 0)))


def starts_within(p: Pattern, text: Column, low: Column, high: Column) -> Column:
    """Whether a match begins at one of the bytes ``low`` to ``high``."""

    def later(low: Column) -> Column:
        tail = _from(p, text, low)
        at = F.regexp_instr(tail, F.lit(rf"{p.flags()}(?!\A)(?:{p.body_source()})"))
        skipped = F.substr(tail, F.lit(2), at - 2)
        return (at > 0) & (low + (F.length(skipped) if p.raw else F.octet_length(skipped)) <= high)

    return F.when(low <= 0, offset(p, text) <= high).otherwise(later(low) if p.raw else bound(_next_character(text, low, high), later))


def render(name: str, meta: dict[str, str], strings: dict[str, Pattern], condition: str) -> str:
    """A rule's text, which ``parse`` reads back."""
    quoted = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'

    def one(p: Pattern) -> str:
        if p.regex:
            return f"${p.name} = /{re.sub(r'(?<!\\)((?:\\\\)*)/', r'\1\\/', p.body)}/{'i' if p.nocase else ''}"
        text = "".join(c if " " <= c <= "~" and c not in '"\\' else "".join(f"\\x{b:02X}" for b in c.encode()) for c in p.body)
        return f'${p.name} = "{text}"{" nocase" if p.nocase else ""}'

    rows = [f"        {k} = {quoted(v)}" for k, v in meta.items()]
    return "\n".join([f"rule {name}", "{", "    meta:", *rows, "    strings:", *(f"        {one(p)}" for p in strings.values()), "    condition:", f"        {condition}", "}", ""])
