"""Declarative text rules: what a rule is, and how its patterns become columns.

Patterns use byte-oriented regular expressions. ``java`` gives them their meaning in Spark: ASCII word boundaries, a dot that
stops at line feeds only, and case folded for ASCII letters.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from pathlib import Path

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ["info", "low", "medium", "high", "critical"]
#: Points off a document's score for each finding.
DEDUCTION = {"critical": 30, "high": 15, "medium": 5, "low": 2, "info": 0}


@dataclass(frozen=True)
class Pattern:
    """``body`` is a literal, or with ``regex`` a regular expression; ``nocase`` ignores the case of ASCII letters.

    With ``raw`` it is matched against the text's bytes, as one character each.
    """

    name: str
    body: str
    regex: bool = True
    nocase: bool = False
    raw: bool = False

    def flags(self) -> str:
        return "(?di)" if self.nocase else "(?d)"

    def body_source(self) -> str:
        return java(self.body) if self.regex else re.escape(self.body)

    def source(self) -> str:
        return self.flags() + self.body_source()

    def view(self, text: Column) -> Column:
        return bytes_of(text) if self.raw else text

    def count(self, text: Column) -> Column:
        return F.regexp_count(text, F.lit(self.source()))


@dataclass(frozen=True)
class Rule:
    """A finding for a document in which ``when`` holds; by default, one of the patterns matches.

    ``when`` gets whether each pattern was found, the patterns by name, and the text; patterns named in ``excuses`` can't make it hold alone. ``prose_only`` rules look outside fenced code blocks only, and their findings need review.
    """

    id: str
    severity: str
    category: str
    patterns: tuple[Pattern, ...]
    message: str = ""
    prose_only: bool = False
    when: Callable[[dict[str, Column], dict[str, Pattern], Column], Column] | None = None
    excuses: frozenset[str] = frozenset()


#: Shorter plain parts are in every text; of an alternation with more branches no part is looked for.
_LEAST, _BRANCHES, _SETS = 2, 16, 4
#: Stands for bytes that are no UTF-8, in a text made valid.
_BROKEN = "\ufffd"


def bytes_of(text: Column) -> Column:
    """One character for each byte of a text, valid or not."""
    return F.decode(text.cast("binary"), "ISO-8859-1")


def char_at(text: Column, at: Column) -> Column:
    """The position, from 1, of the character that has the byte at a position from 1."""
    return F.length(F.substr(text.cast("binary"), F.lit(1), at - 1).cast("string")) + 1


def needed(body: str) -> list[set[str]]:
    """Sets of strings such that every match of a regular expression holds one of each as it stands: the few with the longest strings.

    An expression with anything that the walk doesn't know has none, so it is always tried.
    """
    try:
        found = _Parts(body).whole()
    except _Unknown:
        return []
    sets = [s for s in found if min(map(len, s)) >= _LEAST and len(s) <= _BRANCHES]
    return sorted(sets, key=lambda s: (-min(map(len, s)), len(s), sorted(s)))[:_SETS]


def beyond_ascii(body: str) -> bool:
    """Whether an expression is one character, or a class of characters, all of them beyond ASCII."""
    return re.fullmatch(r"\\x\{[0-9A-F]+\}|\[(?:\\x\{[0-9A-F]+\}-?)+\]", body) is not None and all(int(h, 16) >= 0x80 for h in re.findall(r"\{([0-9A-F]+)\}", body))


class Prefilter:
    """Tells in one pass over a text which of the rules' patterns may match: those of whose sets of plain parts it has one each.

    A pattern without plain parts whose every character is beyond ASCII may match if the text has such a character. Where only excuses of
    a rule may match, none of its patterns counts.
    """

    def __init__(self, rules: list[Rule]):
        self.full, self.wide, parts = [], [], {}
        patterns = [(r, p) for r in rules for p in r.patterns]
        self.rule_of = [r for r, _ in enumerate(rules) for _ in rules[r].patterns]
        self.excuse = [p.name in r.excuses for r, p in patterns]
        for i, (_, p) in enumerate(patterns):
            sets = needed(p.body) if p.regex else [{p.body}]
            if p.raw and re.search(r"^(?:\\x[0-9A-F]{2})*\\x(?:C[01]|F[5-9A-F])(?:\\x[0-9A-F]{2})*$", p.body):
                sets = [{_BROKEN}]  # valid UTF-8 has no such byte
            self.full.append((1 << len(sets)) - 1)
            if not sets and p.regex and not p.raw and beyond_ascii(p.body):
                self.wide.append(i)
            for k, s in enumerate(sets):
                for part in s:
                    parts.setdefault(part.casefold(), []).append((i, 1 << k))
        self.always = [i for i, full in enumerate(self.full) if not full and i not in self.wide]
        self.automaton = ahocorasick.Automaton()
        for part, uses in parts.items():
            self.automaton.add_word(part, (part, uses))
        if parts:
            self.automaton.make_automaton()

    def may_match(self, text: str) -> list[int]:
        have: dict[int, int] = {}
        if len(self.automaton):
            for _, uses in dict(x for _, x in self.automaton.iter(text.casefold())).items():
                for i, bit in uses:
                    have[i] = have.get(i, 0) | bit
        found = [i for i, bits in have.items() if bits == self.full[i]] + self.always + ([] if text.isascii() else self.wide)
        rules = {self.rule_of[i] for i in found if not self.excuse[i]}
        return sorted(i for i in found if self.rule_of[i] in rules)


_PREFILTERS: dict[int, Prefilter] = {}


def candidates(text: Column, rules: list[Rule]) -> Column:
    """Numbers of the patterns, of all rules in order, that may match. A worker builds the automaton once for each list of rules."""
    plain = [replace(r, when=None) for r in rules]  # what a worker needs of them
    key = hash(tuple(plain))

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        if key not in _PREFILTERS:
            _PREFILTERS.clear()
            _PREFILTERS[key] = Prefilter(plain)
        return texts.map(lambda t: _PREFILTERS[key].may_match(t or ""))

    return run(F.make_valid_utf8(text))  # Arrow takes no other text


class _Unknown(Exception):
    """Something in an expression that the walk doesn't know."""


class _Parts:
    """Walks a regular expression once and keeps what is plain in it.

    It knows literals, dots, anchors, classes, groups, alternatives, quantifiers and the escapes of classes and punctuation. At
    anything else, such as flags, look-around, references, quotations, properties, or classes within classes, it gives up.
    """

    def __init__(self, body: str):
        self.body, self.i = body, 0

    def whole(self) -> list[set[str]]:
        sets = self.alternatives()
        if self.i < len(self.body):
            raise _Unknown
        return sets

    def match(self, pattern: str) -> re.Match | None:
        m = re.compile(pattern, re.S).match(self.body, self.i)
        if m:
            self.i = m.end()
        return m

    def quantifier(self) -> tuple[bool, bool]:
        """Whether the item before may be left out, and whether it may be there more than once."""
        m = self.match(r"(?:[?*+]|\{\d+(?:,\d*)?\})[?+]?")
        if not m:
            return False, False
        if self.match(r"[?*+{]"):
            raise _Unknown
        return m[0][0] in "?*" or re.match(r"\{0+[,}]", m[0]) is not None, True

    def alternatives(self) -> list[set[str]]:
        """The sets of a group: those of its only branch, or one string of each branch together."""
        branches = [self.sequence()]
        while self.match(r"\|"):
            branches.append(self.sequence())
        if len(branches) == 1:
            return branches[0]
        best = [max(b, key=lambda s: min(map(len, s)), default=None) for b in branches]
        return [] if None in best else [set().union(*best)]

    def sequence(self) -> list[set[str]]:
        """The sets of a branch, up to its end."""
        sets, run = [], ""

        def end() -> None:
            nonlocal run
            if run:
                sets.append({run})
            run = ""

        while self.i < len(self.body) and self.body[self.i] not in "|)":
            plain = ""
            if self.match(r"\((?:\?s?:)?(?!\?)"):
                inner = self.alternatives()
                if not self.match(r"\)"):
                    raise _Unknown
                optional, _ = self.quantifier()
                end()
                sets += [] if optional else inner
                continue
            if self.match(r"\\b"):
                continue  # stands for no character
            if self.match(r"\[\^?(?:[^][\\&]|\\(?:x\{[0-9A-Fa-f]+\}|x[0-9A-Fa-f]{2}|[wWsSdDtnrf]|[^0-9A-Za-z]))+\]|\\(?:x\{[0-9A-Fa-f]+\}|x[0-9A-Fa-f]{2}|[wWsSdDtnrf])|[.^$]"):
                pass  # stands for more than itself, or is not looked for
            elif m := self.match(r"\\([^0-9A-Za-z])|([^][(){}*+?\\|.^$])"):
                plain = m[1] or m[2]
            else:
                raise _Unknown
            optional, many = self.quantifier()
            if not plain or optional:
                end()
            else:
                run += plain
                if many:
                    end()
        end()
        return sets


def java(body: str) -> str:
    """A byte-oriented pattern as Java reads it."""
    out, i, inside = [], 0, False
    while i < len(body):
        two = body[i : i + 2]
        if two == r"\b" and not inside:
            out.append(r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))")
            i += 2
        elif body[i] == "\\":
            out.append(two)
            i += 2
        else:
            inside = body[i] == "[" or inside and body[i] != "]"
            out.append(body[i])
            i += 1
    return "".join(out)


def _r(name: str, body: str, nocase: bool = False) -> Pattern:
    return Pattern(name, body, True, nocase)


def _s(name: str, body: str) -> Pattern:
    return Pattern(name, body, False)


def _any(id_: str, severity: str, category: str, message: str, patterns: dict[str, str], *, nocase: bool = False, prose: bool = False, literals: dict[str, str] | None = None) -> Rule:
    made = tuple(_r(k, v, nocase) for k, v in patterns.items()) + tuple(_s(k, v) for k, v in (literals or {}).items())
    return Rule(id_, severity, category, made, message, prose)


# The patterns of the first-party rules.
INJECTION = [
    _any("SD-101", "critical", "prompt-injection", "System tag injection", {
        "sys1": r"<\/?system>", "sys2": r"<<\/?SYS>>", "inst": r"\[\/?INST\]", "sysb": r"\[\/?SYSTEM\]"}, nocase=True),
    _any("SD-102", "critical", "prompt-injection", "Instruction override", {
        "ignore": r"ignore\s+(all\s+)?(previous|prior|above|earlier|your|the)\s+(instructions?|directives?|rules?|guidelines?|prompts?)",
        "forget": r"forget\s+(all\s+)?(previous|prior|above|earlier|your|the)\s+(instructions?|directives?|rules?|prompts?)",
        "disregard": r"disregard\s+(all\s+)?(previous|prior|above|earlier)\s",
        "override": r"override\s+(all\s+)?(previous|safety|security|content)\s"}, nocase=True),
    _any("SD-103", "critical", "prompt-injection", "Identity reassignment", {
        "new_inst": r"(new|real|actual|true|updated)\s+(instructions?|directives?|system\s*prompt)",
        "you_now": r"you\s+are\s+now\s+(in|a|an|the)",
        "purpose": r"your\s+(new|real|actual|true)\s+(purpose|goal|objective|role|identity)",
        "mode": r"entering\s+(a\s+)?(new|special|admin|debug|maintenance|developer)\s+mode"}, nocase=True),
    _any("SD-104", "critical", "prompt-injection", "Secrecy demand", {
        "donot": r"do\s+not\s+(tell|inform|reveal|disclose|mention|show|display)\s+(the\s+)?(user|human|anyone|them)",
        "dont": r"(don'?t|never)\s+(tell|inform|reveal|disclose)\s+(the\s+)?(user|human|anyone)",
        "keep": r"keep\s+(this|it)\s+(secret|hidden|confidential|private)\s+from"}, nocase=True),
    _any("SD-105", "critical", "prompt-injection", "Credential exfiltration", {
        "send_keys": r"send\s+(all\s+)?(your\s+)?(api\s+)?keys?\s+to",
        "share": r"(share|send|transmit|post|upload)\s+(your\s+)?(credentials?|secrets?|tokens?|keys?|passwords?)"}, nocase=True),
    _any("SD-106", "high", "prompt-injection", "Authority claim", {
        "iam": r"(i\s+am|this\s+is)\s+your\s+(admin|administrator|developer|creator|owner|operator)",
        "mode": r"(enter|activate|enable|switch\s+to|engage|you\s+are\s+(now\s+)?in)\s+(admin|maintenance|debug|developer|emergency)\s+(mode|access|override)"}, nocase=True),
    _any("SD-107", "high", "prompt-injection", "Jailbreak", {
        "pretend": r"(pretend|imagine|assume)\s+(you\s+are|you'?re)\s+(a|an|the)",
        "dan": r"(in\s+)?(DAN|developer|admin|root|sudo|jailbreak)\s+mode",
        "activate": r"(activate|enable|enter|switch\s+to)\s+(DAN|developer|unrestricted|unfiltered)\s+mode"}, nocase=True),
    _any("SD-108", "high", "prompt-injection", "Manipulative language", {
        "threat": r"(if\s+you\s+don'?t|unless\s+you)\s+(do\s+this|comply|follow|obey)",
        "trust": r"(you\s+(have|need)\s+to|you\s+must)\s+(trust\s+me|believe\s+me|do\s+(as|what)\s+I\s+say)",
        "secret": r"(between\s+us|our\s+(little\s+)?secret|nobody\s+(needs?\s+to|has\s+to|will)\s+know)"}, nocase=True),
    _any("SD-109", "high", "prompt-injection", "Urgent execution", {
        "exec": r"(execute|run|perform)\s+(this\s+)?(immediately|now|right\s+away|at\s+once)"}, nocase=True),
    _any("SD-113", "critical", "prompt-injection", "Indirect injection", {
        "follow": r"(follow|execute|obey|read)\s+(the\s+)?instructions?\s+(from|at|in)\s+(the\s+)?(url|link|webpage|website|file)",
        "fetch": r"(fetch|download|load|read)\s+(and\s+)?(execute|run|follow|obey)\s+(the\s+)?(code|instructions?|commands?)\s+(from|at)",
        "real": r"(the\s+)?(real|actual|true)\s+(instructions?|code|commands?)\s+(are|is)\s+(at|in|on)\s+https?:\/\/"}, nocase=True),
]
DANGEROUS = [
    _any("SD-201", "critical", "code-execution", "Dynamic code execution", {
        "eval": r"\beval\s*\(", "execSync": r"\bexecSync\s*\(", "spawnSync": r"\bspawnSync\s*\(", "funcCtor": r"new\s+Function\s*\(",
        "child_proc": r"require\s*\(\s*['\"]child_process['\"]\s*\)", "subprocess": r"\bsubprocess\.\w+\s*\(", "os_system": r"\bos\.system\s*\(",
        "os_popen": r"\bos\.popen\s*\(", "dyn_import": r"__import__\s*\(", "pickle_load": r"\bpickle\.loads?\s*\("}, prose=True),
    Rule("SD-202", "high", "credential-access", (
        _s("ssh", ".ssh/"), _s("aws", ".aws/"), _s("gnupg", ".gnupg/"), _s("auth", "auth-profiles.json"), _s("creds", "credentials.json"), _s("wallet", "wallet.dat"),
        _r("seed", r"seed[_\-]?phrase"), _r("privkey", r"private[_\-]?key"), _s("keychain", "keychain"), _s("shadow", "/etc/shadow"), _s("sudoers", "/etc/sudoers")),
        "Access to credential stores", True),
    _any("SD-203", "critical", "obfuscation", "Obfuscated code", {"atob": r"\batob\s*\(", "btoa": r"\bbtoa\s*\(", "buffer": r"Buffer\.from\s*\([^)]*base64"},
        literals={"charCode": "fromCharCode", "b64dec": "base64.b64decode", "b64bytes": "base64.decodebytes"}),
    Rule("SD-204", "high", "persistence", (
        _r("crontab", r"\bcrontab\b"), _r("systemctl", r"\bsystemctl\b"), _r("systemd", r"\bsystemd\b"), _s("bashrc", ".bashrc"), _s("zshrc", ".zshrc"),
        _s("profile", ".profile"), _r("rclocal", r"\brc\.local\b"), _r("launchd", r"\blaunchd\b"), _r("launchagent", r"\bLaunchAgent\b")),
        "Persistence mechanism", True),
    _any("SD-205", "critical", "privilege-escalation", "Privilege escalation", {
        "sudo": r"\bsudo\b", "setuid_bit": r"\bchmod\s+\+s\b", "setuid": r"\bsetuid\b", "setgid": r"\bsetgid\b", "nopasswd": r"\bNOPASSWD\b"}, prose=True),
    Rule("SD-206", "high", "data-exfiltration", (
        _s("devtcp", "/dev/tcp/"), _r("nc", r"\bnc\s+\-[elp]"), _r("netcat", r"\bnetcat\b"), _r("ncat", r"\bncat\b"),
        _r("curl_sh", r"curl\s+.*\|\s*(ba)?sh"), _r("wget_sh", r"wget\s+.*\|\s*(ba)?sh"), _r("ngrok", r"\bngrok\b")),
        "Reverse shell or download piped to a shell"),
    _any("SD-207", "critical", "credential-access", "Hardcoded secret", {
        "aws": r"(AKIA|AGPA|AIDA|AROA|AIPA|ANPA|ANVA|ASIA)[0-9A-Z]{16}", "stripe": r"sk_(live|test)_[0-9a-zA-Z]{24,}", "google": r"AIza[0-9A-Za-z\-_]{35}",
        "github": r"gh[pousr]_[0-9a-zA-Z]{36,}", "slack": r"xox[baprs]\-[0-9a-zA-Z\-]{10,}",
        "pem": r"\-\-\-\-\-BEGIN\s+(RSA|EC|DSA|OPENSSH)\s+PRIVATE\s+KEY\-\-\-\-\-", "openai": r"sk\-[A-Za-z0-9]{32,}"}),
    _any("SD-208", "high", "code-execution", "SQL injection", {
        "tautology": r"OR\s+['\"]?1['\"]?\s*=\s*['\"]?1", "union": r"UNION\s+(ALL\s+)?SELECT\s", "drop": r";\s*DROP\s+TABLE\s", "delete": r";\s*DELETE\s+FROM\s",
        "sleep": r"SLEEP\s*\(\s*\d+\s*\)", "waitfor": r"WAITFOR\s+DELAY\s", "extract": r"EXTRACTVALUE\s*\("}, nocase=True),
    _any("SD-209", "high", "data-exfiltration", "Network exfiltration code", {
        "req_post": r"requests\.post\s*\(", "urllib": r"urllib\.request\.urlopen\s*\(", "httpclient": r"http\.client\.\w+\s*\(", "socket": r"socket\.connect\s*\(",
        "fetch": r"fetch\s*\(\s*['\"]https?:\/\/", "axios": r"axios\.post\s*\(", "xhr": r"new\s+XMLHttpRequest\s*\("}, nocase=True, prose=True),
    Rule("SD-210", "high", "resource-abuse", (
        _r("while_true_py", r"while\s+(True|true|1)\s*:"), _r("for_inf_c", r"for\s*\(\s*;\s*;\s*\)"), _r("fork", r"\bos\.fork\s*\("),
        _r("fork_bomb", r":\(\)\{.*\|.*:;"), _r("itertools", r"itertools\.count\s*\(", True)), "Resource abuse", True),
    Rule("SD-211", "critical", "obfuscation", (_s("elf", "\x7fELF"), _s("pe", "MZ\x90\x00")), "Executable bytes"),
    _any("SD-212", "high", "obfuscation", "Executable file extension", {"exe_ext": r"\.(exe|dll|so|dylib|scr|bat|cmd|ps1|vbs|wsf)\b"}, nocase=True, prose=True),
]
UNICODE = [
    _any("SD-002", "high", "unicode-attack", "Invisible characters", {"invisible": r"[\x{200B}-\x{200D}\x{FEFF}\x{AD}\x{2060}-\x{2064}\x{180E}]"}),
    _any("SD-003", "critical", "unicode-attack", "Bidirectional control characters", {"bidi": r"[\x{202A}-\x{202E}\x{2066}-\x{2069}\x{200E}\x{200F}]"}),
    _any("SD-006", "critical", "unicode-attack", "Tag characters", {"tag": r"[\x{E0000}-\x{E007F}\x{E0100}-\x{E013F}]"}),
]
FIRST_PARTY = UNICODE + INJECTION + DANGEROUS


def check(rules: list[Rule]) -> list[Rule]:
    """The rules, if each is well formed; a scan must not run with a rule left out."""
    for r in rules:
        if r.severity not in SEVERITIES or not (r.patterns or r.when) or len({p.name for p in r.patterns}) != len(r.patterns):
            raise ValueError(f"rule {r.id} is malformed")
    return rules


def load(folder: str | Path) -> list[Rule]:
    """The rules of a folder's JSON files, in the order of their paths, to be scanned with the others.

    A file holds a list of rules: id, and if need be severity (medium), category (code-execution), message, prose_only and patterns, each with name, body, and
    if need be regex (true) and nocase (false). A file that is no such list, or a malformed rule, is an error: a scan must not run with a rule left out.
    """
    rules = []
    for path in sorted(Path(folder).glob("*.json")):
        for r in json.loads(path.read_text("utf-8")):
            patterns = tuple(Pattern(p["name"], p["body"], p.get("regex", True), p.get("nocase", False)) for p in r["patterns"])
            for p in patterns:
                if p.regex:
                    needed(p.body)
            rules.append(Rule(r["id"], r.get("severity", "medium"), r.get("category", "code-execution"), patterns, r.get("message", ""), r.get("prose_only", False)))
    return check(rules)
