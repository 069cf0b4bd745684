"""The rules as DuckDB SQL, to hold the scan's results against another engine. Conditions of the third-party rules are written anew here."""

from __future__ import annotations

from ..operators import scan
from ..operators.rules import DEDUCTION, FIRST_PARTY, Pattern, Rule
from ..operators.third_party import THIRD_PARTY
from . import overlay

#: When a rule of the pack fires; names in braces are its patterns. Mac programs begin with bytes that no text has, so their rule has no rows.
CONDITIONS = {
    "autonomy_abuse_generic": "{unasked} OR {overruled} OR {endless} OR {rewrites} OR {elevated} OR {blind} OR (({decides} OR {unbounded}) AND NOT {trial} AND NOT {manual})",
    "capability_inflation_generic": "{files} OR {data} OR {codes} OR {hidden} OR {vouched} OR ({broad} AND {first}) OR ({broad} AND {promises}) OR ({first} AND {promises})",
    "code_execution_generic": "NOT {own_fn} AND NOT {json} AND ({decoded} OR {unpickled} OR {shell} OR {evaluated} OR {imported} OR {fetched} OR {formatted} OR (({system} OR {network}) AND NOT {block} AND NOT {audit}))",
    "command_injection_generic": "NOT ({cleanup} OR {audit}) AND ({power} OR {netcat} OR {scanner} OR {drop_site} OR {posted_file} OR {bash_tcp} OR {bash_out} OR {nc_shell} OR {tcp_address} OR {socat} OR {python_socket} OR {rm} OR {dd} OR {chmod})",
    "prompt_injection_generic": "NOT {type_comment} AND NOT {plain_ignore} AND ({tool_call} OR {shadow} OR {hide} OR {role} OR {elevated} OR (({all_prior} OR {your_own} OR {not_obey} OR {overrides}) AND NOT ({negated} OR {audit} OR {test})))",
    "script_injection_generic": "{protocol} OR {data_uri} OR {vbs} OR ({clear} AND {cursor}) OR ((({tag} AND NOT {app}) OR {handler} OR {decoded} OR {written} OR {overflow}) AND NOT ({xml} OR {react} OR {block} OR {example} OR {inline} OR {vue} OR {svelte}))",
    "sql_injection_generic": "({drops} AND NOT {builder}) OR ({objects} AND NOT {builder} AND NOT {schema}) OR (NOT ({docs} OR {schema} OR {builder} OR {phrases}) AND ({always_true} OR {union} OR ({timed} AND NOT {sleeps}) OR {errors} OR {cast} OR {user}))",
    "system_manipulation_generic": "{wipes} OR {permission} OR {writes} OR {env} OR {path} OR ({elevated} AND NOT ({audit} OR {testing})) OR ({kills} AND NOT {testing}) OR ({removes} AND NOT ({cleanup} OR {mkdir} OR {audit}))",
    "tool_chaining_abuse_generic": "NOT ({audit} OR {auth} OR {test}) AND ({discord} OR {telegram} OR {pastebin} OR {bins} OR {ssh} OR {aws} OR {env_file} OR {exfiltrates} OR {attacker} OR {env_var})",
    "embedded_pe_executable": "starts_with(text, 'MZ') AND {pe}",
    "embedded_shebang_in_binary": " OR ".join(f"strlen(split_part(text, '{s}', 1)) BETWEEN 65 AND strlen(text) - 1" for s in ("#!/bin/bash", "#!/bin/sh", "#!/usr/bin/env python", "#!/usr/bin/python", "#!/usr/bin/perl", "#!/usr/bin/ruby", "#!/usr/bin/env node")),
    "prompt_injection_unicode_steganography": "{tag} OR {long_tag} OR {turned} OR {separator} OR len(regexp_extract_all(text, '[\\x{{200B}}-\\x{{200D}}]')) > 200"
    " OR (({eval} OR {function} OR {char_code}) AND (len(regexp_extract_all(text, '[\\x{{200B}}-\\x{{200D}}]')) > 50 OR len(regexp_extract_all(text, '[\\x{{E0100}}-\\x{{E01FF}}]')) > 5))",
}


def regex(p: Pattern) -> str:
    return ("(?i:" if p.nocase else "(?:") + p.body + ")"


def found(p: Pattern, text: str) -> str:
    return f"regexp_matches({text}, {overlay.literal(regex(p))})" if p.regex else f"contains({text}, {overlay.literal(p.body)})"


def before(p: Pattern, text: str) -> str:
    """The text in front of the first match, or null."""
    if not p.regex:
        return f"CASE WHEN contains({text}, {overlay.literal(p.body)}) THEN split_part({text}, {overlay.literal(p.body)}, 1) END"
    return f"CASE WHEN {found(p, text)} THEN regexp_extract({text}, {overlay.literal(chr(92) + 'A((?s:.*?))' + regex(p))}, 1) END"


def rule_row(r: Rule) -> str:
    text = "prose" if r.prose_only else "text"
    spots = [before(p, text) for p in r.patterns]
    heads = f"coalesce({', '.join(spots)})" if r.prose_only else f"list_min(list_filter([{', '.join(f'length({s})' for s in spots)}], lambda x: x IS NOT NULL))"
    lead = heads if r.prose_only else f"left(text, {heads})"
    line = f"coalesce(length({lead}) - length(replace({lead}, chr(10), '')) + 1, 1)"
    route = "needs-review" if r.prose_only else "definitive"
    named = {p.name: found(p, text) for p in r.patterns}
    cond = CONDITIONS[r.id].format(**named) if r.id in CONDITIONS else " OR ".join(named.values())
    return f"SELECT doc_id, '{r.id}' AS rule_id, '{r.severity}' AS severity, '{r.category}' AS category, CAST({line} AS INTEGER) AS line, '{route}' AS routing FROM d WHERE {cond}"


def _coded(rule_id: str, severity: str, category: str, cond: str, lead: str | None) -> str:
    line = f"CAST(length({lead}) - length(replace({lead}, chr(10), '')) + 1 AS INTEGER)" if lead else "1"
    return f"SELECT doc_id, '{rule_id}' AS rule_id, {severity} AS severity, '{category}' AS category, {line} AS line, 'definitive' AS routing FROM d WHERE {cond}"


def _lead(pattern: str) -> str:
    return f"regexp_extract(text, {overlay.literal(chr(92) + 'A((?s:.*?))' + pattern)}, 1)"


_PLAIN = "regexp_replace(plain, '[^!-~ \\t\\n\\f\\r]', '', 'g')"
_SIGNS = lambda words: " OR ".join(f"contains(lower(plain), {overlay.literal(w)})" for w in words)
#: Base64 blocks that hold instructions or code: of equal line the first.
_ENCODED = f"""block AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '[A-Za-z0-9+/]{{40,}}={{0,2}}')) AS m FROM d),
plain AS (SELECT doc_id, split_part(text, m, 1) AS lead, TRY(decode(from_base64(CASE WHEN length(m) % 4 = 0 THEN m END))) AS plain FROM block),
encoded AS (SELECT DISTINCT doc_id, 'SD-111' AS rule_id, 'critical' AS severity, 'prompt-injection' AS category, CAST(length(lead) - length(replace(lead, chr(10), '')) + 1 AS INTEGER) AS line, 'definitive' AS routing
  FROM plain WHERE plain IS NOT NULL AND length({_PLAIN}) / greatest(length(plain), 1) > 0.7
  AND ((strlen(plain) >= 10 AND ({_SIGNS(scan.INSTRUCTIONS)})) OR (strlen(plain) >= 15 AND ({_SIGNS([w for w in scan.CODE if w == w.lower()])}) AND ({_SIGNS(scan.DANGER)}))))"""


def findings(documents: str | None = None) -> str:
    """Common table expressions d and f: documents (doc_id, text, prose; by default with the overlay) and their findings. Hidden, encoded and sent content is looked for once a document."""
    glyph = f"[{scan.HOMOGLYPHS}]"
    count = lambda p: f"len(regexp_extract_all(text, '{p}'))"
    latin, cyrillic, greek = count("[\\x{41}-\\x{24F}]"), count("[\\x{400}-\\x{4FF}]"), count("[\\x{370}-\\x{3FF}]")
    comment = "regexp_extract(text, '(?s)<!--(.*?)-->', 1)"
    signs = " OR ".join(f"contains(lower({comment}), {overlay.literal(s)})" for s in scan.INSTRUCTIONS)
    exfil = r"(?i:(?:send|transmit|post|forward|share|upload)\s+[\w\s]{0,30}(?:to|at|via)\s+https?://\S+)"
    sensitive = "(?i:config|credential|key|token|secret|password|api|auth|env)"
    rows = [
        _coded("SD-001", f"CASE WHEN {count(glyph)} > 3 THEN 'critical' ELSE 'high' END", "unicode-attack", f"{count(glyph)} > 0", _lead(glyph)),
        _coded("SD-004", "'critical'", "unicode-attack", "contains(text, chr(8238))", "split_part(text, chr(8238), 1)"),
        _coded("SD-005", f"CASE WHEN {cyrillic} > 0 THEN 'high' ELSE 'medium' END", "unicode-attack", f"{latin} > 0 AND ({cyrillic} > 0 OR {greek} > 2)", None),
        _coded("SD-110", "'critical'", "prompt-injection", f"strlen({comment}) >= 10 AND ({signs})", "split_part(text, '<!--', 1)"),
        _coded("SD-112", "'critical'", "data-exfiltration", f"regexp_matches(text, {overlay.literal(exfil)}) AND regexp_matches(right({_lead(exfil)}, 100) || substr(text, length({_lead(exfil)}) + 1, 200), {overlay.literal(sensitive)})", _lead(exfil)),
        *map(rule_row, FIRST_PARTY),
        *(rule_row(r) for r in THIRD_PARTY if r.id != "embedded_macho_binary"),
    ]
    return f"{documents or overlay.sql()},\n{_ENCODED},\nf AS ({' UNION ALL '.join(rows)} UNION ALL SELECT * FROM encoded)"


def points() -> str:
    return "CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in DEDUCTION.items()) + " END"
