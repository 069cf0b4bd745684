"""Rules as text: what they mean, what is refused, and that looking for plain parts first never hides a match."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import rule_text, rules, scan, third_party


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def rule(strings, condition, meta="", name="r"):
    return f"rule {name} {{ {'meta: ' + meta if meta else ''} {'strings: ' + strings if strings else ''} condition: {condition} }}\n"


CASES = [  # strings, condition, texts that it holds of, texts that it doesn't
    ('$a = "Key"', "$a", ["aKeyb"], ["key", ""]),
    ('$a = "Key" nocase', "$a", ["kEY"], ["ke y"]),
    ('$a = "key" fullword', "$a", ["a key.", "_key_"], ["keys", "akey", "9key"]),
    ('$a = "key" wide', "$a", ["k\0e\0y\0"], ["key"]),
    ('$a = "key" wide ascii nocase', "$a", ["KEY", "k\0E\0y\0"], ["k\0e y"]),
    (r'$a = "\x41\"\\\tz"', "$a", ['A"\\\tz'], ["A"]),
    (r'$a = "\xE2\x80\xAE"', "$a", ["x‮y"], ["x‭y"]),
    (r"$a = /a(b|c)+\/d/", "$a", ["acb/d"], ["a/d"]),
    ("$a = /a.b/", "$a", ["axb"], ["a\nb"]),
    ("$a = /a.b/is", "$a", ["A\nB"], ["ab"]),
    (r"$a = /\xE2\x80[\x8B-\x8D]/", "$a", ["x‌y"], ["x‎y", "x"]),
    (r"$a = /[\x{200B}-\x{200D}]x/", "$a", ["​x"], ["x"]),
    ("$a = { 6B 65 79 }", "$a", ["a key"], ["ke"]),
    ("$a = { 6B ?? 79 [1-3] ( 21 | 3F 3F ) }", "$a", ["kxy12!", "kéy??".replace("é", "e") + "a??"], ["ky1!", "key!", "key1234!"]),
    ("$a = { 6? 65 [2] 7A }", "$a", ["ke__z", "aeéz"], ["ze__z"]),
    ("$a = { C3 A9 7? }", "$a", ["éz"], ["éa"]),
    ('$a = "x" $b = "y" $c = "z"', "$a and not $b or $c", ["x", "xyz", "z"], ["xy", "y"]),
    ('$a = "x" $b = "y"', "not ($a or $b)", ["", "z"], ["x", "zy"]),
    ('$a = "aa"', "#a > 2", ["aaaa"], ["aaa"]),
    ('$a = "x" $b = "y"', "#a + 2 * #b - 1 >= 4", ["xyy", "xxxyy"], ["xy", ""]),
    ('$a = "x" $b = "y"', "(#a + #b) > 2 and ($a or ($b))", ["xyx"], ["xy"]),
    ('$a = "x"', "@a > 3", ["ééx"], ["éyx", "", "yyyy"]),
    ('$a = "x"', "not @a > 3", ["", "x"], ["yyyyx"]),
    ('$a = "b"', "$a at 2", ["éb", "aabb"], ["ab", "ééb", "b"]),
    (r"$a = /\bab/", "$a at 0", ["ab"], ["xab", "x ab"]),
    (r"$a = /\bb/", "$a at 2", [". b", "..b"], ["aab"]),
    ('$a = "b"', "$a in (2..4)", ["b__b", "éb", "xxxxb"], ["b", "xb", "xxxxxb", ""]),
    ('$a = "x" $b = "y" $c = "z"', "2 of them", ["xz", "xyz"], ["x", ""]),
    ('$a = "x" $b = "y" $c = "z"', "all of ($a, $b*) and not $c", ["xy"], ["xz", "xyz"]),
    ('$a1 = "x" $a2 = "y" $c = "z"', "none of ($a*) and $c", ["z"], ["xz", "yz", ""]),
    ('$a = "x" $b = "y"', "for any of them : ( # > 1 and @ < 3 )", ["xx", "zzyy"], ["xy", "zzzyy"]),
    ('$a = "x" $b = "y"', "for all of ($*) : ( $ at 0 or @ > 1 )", ["x_y"], ["xy", "x"]),
    ("", "filesize < 3", ["", "ab", "é"], ["abc", "éé"]),
    ('$a = "x"', "filesize >= 1KB and $a", ["x" * 1024], ["x"]),
    ("$a = /a|b/", "true and $a or false", ["b"], ["c"]),
]


def test_conditions(spark):
    made = [r for i, (strings, condition, *_) in enumerate(CASES) for r in rule_text.parse(rule(strings, condition, name=f"r{i}"))]
    texts = sorted({t for *_, yes, no in CASES for t in yes + no})
    fired = {r.text: {f.rule_id for f in r.findings} for r in scan.scan(docs(spark, texts), rules=made).collect()}
    wrong = [(f"r{i}", t) for i, (*_, yes, no) in enumerate(CASES) for t in yes + no if (f"r{i}" in fired[t]) != (t in yes)]
    assert wrong == []


def test_bytes_that_are_no_text(spark):
    made = rule_text.parse(rule("$a = { FE ED ?? 41 }", "$a") + rule("$a = { FE ED } $b = { 41 }", "$b at 3 and #a == 1", name="s"))
    raw = [bytes.fromhex("0aFEED0041"), bytes.fromhex("FEED4141"), "þed A".encode(), bytes.fromhex("FEED0041")]
    d = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(raw)], "doc_id int, raw binary").select("doc_id", F.col("raw").cast("string").alias("text"))
    got = scan.scan(d, rules=made).orderBy("doc_id").collect()
    assert [[(f.rule_id, f.line) for f in r.findings] for r in got] == [[("r", 2)], [("r", 1), ("s", 1)], [], [("r", 1), ("s", 1)]]


def test_what_a_rule_says_of_itself(spark):
    text = """// a comment
    rule first : tag other {
        meta: severity = "HIGH" threat_type = "INJECTION ATTACK" description = "says \\"so\\"" n = 3 prose_only = true
        strings: $a = "x" /* another */
        condition: $a
    }
    rule second { meta: id = "X-2" severity = "odd" category = "unheard-of" condition: filesize > 100 }"""
    first, second = rule_text.parse(text)
    assert (first.id, first.severity, first.category, first.message, first.prose_only) == ("first", "high", "prompt-injection", 'says "so"', True)
    assert (second.id, second.severity, second.category) == ("X-2", "info", "code-execution")
    got = scan.scan(docs(spark, ["```\nx\n```\nx", "```\nx\n```", "y" * 101]), rules=[first, second]).orderBy("doc_id").collect()
    assert [[(f.rule_id, f.line, f.routing) for f in r.findings] for r in got] == [[("first", 4, "needs-review")], [], [("X-2", 1, "definitive")]]


@pytest.mark.parametrize(
    "text, says",
    [
        ("rule r { condition: }", "number is missing"), ("rule r { condition: $a }", r"\$a is not known"), ('rule r { strings: $a = "x" condition: true }', r"\$a is in no condition"), ('rule r { strings: $a = "x" xor condition: $a }', "xor"),
        ('rule r {\n strings:\n $a = "x"\n $a = "y" condition: $a }', "line 4.*twice"), ('import "pe" rule r { condition: true }', "'rule'"), ("private rule r { condition: true }", "'rule'"), ("rule r { strings: $a = /(/ condition: $a }", "no regular expression"),
        ("rule r { strings: $a = /x/q condition: $a }", "flags"), ('rule r { strings: $a = "x" condition: @a[2] > 1 }', "comparison"), ("rule r { condition: uint16(0) == 1 }", "number is missing"), ('rule r { strings: $a = "x" condition: any of ($b*) }', "called"),
        ('rule r { strings: $a = "" condition: $a }', "empty"), ("rule r { strings: $a = { 6 } condition: $a }", "bytes"), (r'rule r { strings: $a = "\q" condition: $a }', "escape"), ("rule r { condition: true } }", "'rule'"), ("rule r { condition: true } rule r { condition: true }", "same id"),
        ('rule r { strings: $a = "x" condition: $a and }', "missing"), ("rule r { condition: true", "'}'"), ('rule r { strings: $a = "x" condition: any of them in (0..1) }', "'}'"), ('rule r { strings: $ = "x" condition: any of them }', "condition"),
    ],
)
def test_what_is_not_understood_is_refused(text, says):
    with pytest.raises(ValueError, match=f"(?s){says}"):
        rule_text.parse(text)


def test_rules_of_a_folder(tmp_path):
    (tmp_path / "b.yar").write_text(rule("", "true", name="two"))
    (tmp_path / "a.yara").write_text(rule("", "true", name="one"))
    (tmp_path / "c.txt").write_text("no rules")
    assert [r.id for r in rule_text.load(tmp_path)] == ["one", "two"]


def test_pack_reads_back_as_it_was_written():
    assert [(r.id, r.severity, r.category, r.patterns) for r in rule_text.parse(third_party.pack_text())] == [(r.id, r.severity, r.category, r.patterns) for r in third_party.THIRD_PARTY]
    assert len(third_party.THIRD_PARTY) == 16
    p = rules.Pattern("a", 'q"\\/\x7fé', False)
    assert rule_text.parse(rule_text.render("r", {"description": 'a "b" \\c'}, {"a": p}, "$a"))[0].patterns == (p,)


@pytest.mark.parametrize("body", ["(?i)ignore all", "(?!foo)bar", r"\x41BC", r"\p{Lu}abc", r"(?<=x)abc", r"a\Qb.c\E", r"(ab)\1", r"ab++c", r"[\]x]yz", "[^]]ab", "[a[bc]]de", "ab{,3}c", r"Abc", "(?<n>ab)", "(?x) a b c", "a{b}"])
def test_what_the_walk_does_not_know_is_always_tried(spark, body):
    """The parts that it does find are in every match."""
    texts = ["please Ignore ALL ABC", "bar foobar", "ABC abc", "Aabc", "xabc", "ab.c", "abab", "abbc", "]yz", "xab", "bde", "a b c", "ab", "a{b}"]
    d, made = docs(spark, texts), [rules.Rule("X", "high", "c", (rules.Pattern("a", body),))]
    try:
        plain = {r.doc_id for r in d.filter(F.col("text").rlike("(?d)" + rules.java(body))).collect()}
    except Exception:  # no expression in Java either
        return
    assert {r.doc_id for r in scan.scan(d, rules=made).collect() if r.findings} == plain


def test_plain_parts_are_in_every_match():
    """Random expressions on random texts, with Python's own matcher."""
    rng = random.Random(11)

    def expression(depth=0):
        atoms = ["a", "b", "ab", "ca", r"\.", "-", "[ab]", "[^c]", r"\d", r"\w", ".", r"\x41", r"[\]a-c]", "é", "S"]
        parts = []
        for _ in range(rng.randint(1, 4)):
            group = depth < 2 and rng.random() < 0.4
            atom = f"({rng.choice(['', '', '?:', '?i:', '?=', '?!'])}{expression(depth + 1)})" if group else rng.choice(atoms)
            parts.append(atom + rng.choice(["", "", "", "?", "{2}"] if group else ["", "", "", "?", "*", "+", "{2}", "{0,1}", "+?", "{1,2}?"]))
        return "".join(parts) if rng.random() < 0.7 else "".join(parts) + "|" + rng.choice(atoms)

    tried = held = 0
    for _ in range(4000):
        body, nocase = expression(), rng.random() < 0.3
        try:
            pattern = re.compile(body, (re.I | re.A if nocase else re.A) if body.isascii() else re.I if nocase else 0)
        except re.error:
            continue
        filter_ = rules.Prefilter([rules.Rule("X", "high", "c", (rules.Pattern("a", body, True, nocase),))])
        for _ in range(6):
            text = "".join(rng.choice("aabbcCA1. -ésS") for _ in range(rng.randint(0, 14)))
            may = filter_.may_match(text)
            tried += not may
            if pattern.search(text):
                held += 1
                assert may, (body, nocase, text)
    assert held > 5000 and tried > 1000


def test_a_range_may_begin_within_a_character(spark):
    made = rule_text.parse(rule('$a = "b"', "$a in (2..4)") + rule('$a = "b"', "$a in (#a - 3..1)", name="s") + rule('$a = "b"', "$a at #a - 2", name="t"))
    fired = {r.text: {f.rule_id for f in r.findings} for r in scan.scan(docs(spark, ["aéb", "a😀b", "aé😀b", "aé", "éb", "xb", "b"]), rules=made).collect()}
    assert fired == {"aéb": {"r"}, "a😀b": set(), "aé😀b": set(), "aé": set(), "éb": {"r"}, "xb": {"s"}, "b": {"s"}}
