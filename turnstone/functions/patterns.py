"""Patterns and limits whose values decide results.

Spark's regular expressions are Java's: ``\\b`` and ``\\w`` follow Unicode there, and ``\\s`` ASCII. The
rules want word borders by ASCII and white space by Unicode, so both are spelled out.
"""

from __future__ import annotations

#: An ASCII word border.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
#: White space by Unicode, for the inside of a character class.
BLANK = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: A character that may compose with others, or stands for others.
MAY_COMPOSE = r"[^\x{0}-\x{2FF}]"
#: Kana, Han and compatibility ideographs.
CJK_RANGES = [(0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF)]
#: The same for the inside of a character class, of Java and of Python.
CJK = "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in CJK_RANGES)
CJK_PYTHON = "".join(f"{chr(a)}-{chr(b)}" for a, b in CJK_RANGES)

#: What is taken for a secret and what stands in its place, in the order of replacement.
SECRETS = [
    (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", "[REDACTED_PRIVATE_KEY]"),
    (rf"{EDGE}sk-[A-Za-z0-9]{{20,}}{EDGE}", "[REDACTED_API_KEY]"),
    (rf"{EDGE}ghp_[A-Za-z0-9]{{20,}}{EDGE}", "[REDACTED_TOKEN]"),
    (rf"{EDGE}xox[baprs]-[A-Za-z0-9-]{{10,}}{EDGE}", "[REDACTED_TOKEN]"),
    (rf"(?i){EDGE}Bearer[{BLANK}]+[A-Za-z0-9\-._~+/]+=*{EDGE}", "Bearer [REDACTED]"),
    (rf"(?i){EDGE}(?:api[_-]?key|token|password|secret)[{BLANK}]*[:=][{BLANK}]*[\"']?[^{BLANK}\"']{{8,}}[\"']?", "[REDACTED_CREDENTIAL]"),
    (rf"{EDGE}[A-Za-z0-9+/]{{40,}}={{0,2}}{EDGE}", "[REDACTED_BLOB]"),
]

#: What a text must hold, in lower case, for the pattern of the same place to match; the last is a pattern of its own.
SECRET_HINTS = [("-----begin ",), ("sk-",), ("ghp_",), ("xox",), ("bearer",), ("key", "token", "password", "secret"), None]
LONG_RUN = "[A-Za-z0-9+/]{40}"

#: File names that may hold secrets.
SENSITIVE_PATH = r"(?i)(?:^|/)(?:\.env(?:\..+)?|credentials(?:\.json)?|\.npmrc|\.netrc|id_rsa|id_ed25519|.*\.(?:pem|key|p12|pfx))$"

#: Fixed values, for Python's ``re`` with ASCII classes: paths, symbols, errors.
PATH = r"""(?:^|[\s"'`(])((?:\.\.?/|/)?[\w.@+-]+(?:/[\w.@+-]+)+\.\w{1,8}|[\w.@+-]+\.\w{1,8})(?=[\s"'`,);:\]]|$)"""
QUERY_PATH = r"""(?:^|[\s"'`(])((?:\.\.?/|/)?[\w.@+-]+(?:/[\w.@+-]+)+\.\w{1,8}|[\w.@+-]+\.\w{1,8})"""
BACKTICKED = r"`([A-Za-z_][\w./:-]{1,120})`"
SYMBOL = r"\b([A-Z][A-Za-z0-9_]{2,}(?:\.[A-Za-z_]\w*)*|[a-z_][a-z0-9_]{2,}/[0-9]+)\b"
QUERY_SYMBOL = r"`([^`]+)`|\b([A-Z][A-Za-z0-9_]{2,})\b"
ERROR = r"(?i)(?:Error|Exception|FAILED|fatal:|panic:|Traceback|undefined|not found|E\d{3,4})\b[^\n]{0,200}"

#: Sentences that state a constraint, and those that only look like it.
CONSTRAINT_EN = rf"(?i){EDGE}(because|must not|must|cannot|constraint|rule|invariant|required){EDGE}"
CONSTRAINT_ZH = "(因为|必须|不得|不能|约束|规则|不变量|要求)"
QUOTED_ONLY = r"""^[`'"][^`'"]{0,80}[`'"]$"""
NO_CONSTRAINT = rf"(?i){EDGE}(?:must[{BLANK}]+see|must[{BLANK}]+have[{BLANK}]+missed|cannot[{BLANK}]+find|cannot[{BLANK}]+locate){EDGE}"
SENTENCE_END = rf"(?<=[。！？.!?\n])[{BLANK}]+"

#: What was ruled out, and why.
EXCLUSION_EN = rf"(?i)I (?:ruled out|excluded|skipped)[{BLANK}]+([^\n.]{{3,80}})(?:[{BLANK}]+because[{BLANK}]+([^\n.]{{3,120}}))?"
EXCLUSION_ZH = rf"(?:问题不在|排除了|不是)[{BLANK}]*([^\n。，,]{{2,40}})(?:[，,]?[{BLANK}]*(?:因为|由于)[{BLANK}]*([^\n。]{{2,80}}))?"

#: Shell commands by what they do.
SHELL_GREP = rf"^(?:rg|grep|egrep|fgrep){EDGE}|{EDGE}(?:rg|grep){EDGE}"
SHELL_FIND = rf"^find{EDGE}"
SHELL_LIST = rf"^(?:ls|tree){EDGE}"
SHELL_TEST = rf"{EDGE}(?:test|pytest|vitest|jest|mix test|cargo test|go test|bun test){EDGE}"

#: Budgets in characters, items and documents.
MAX_USER_TEXT, MAX_ASSISTANT_TEXT, MAX_OUTCOME, MAX_CONTEXT, MAX_ARGS = 8_000, 12_000, 1_200, 400, 2_000
MAX_QUERY_CHARS, MAX_QUERY_TOKENS = 500, 64
MAX_VARIANTS, MAX_CHUNKS = 64, 10_000
FTS_LIMIT, ENTITY_LIMIT, CONSTRAINT_LIMIT, TRACE_LIMIT = 50, 40, 20, 20
EXCLUSION_FROM = 10_000
