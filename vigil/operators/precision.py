"""What speaks against a finding: suppressed lines, safe usage, missing user input, and the confidence that remains.

All tests are column expressions over (line, name, language, path), one combined pattern per kind of test, so a finding is
judged in the projection that found it: no join, no shuffle, no Python. Catalogs are parameters; the defaults are below.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of findings by what can make them safe.
SQL_NAMES, XSS_NAMES = ("SQL Injection", "Go SQL Injection"), ("XSS (Cross-Site Scripting)", "Go XSS via Templates")
CREDENTIAL_NAMES = ("Hardcoded Credentials", "Go Hardcoded Credentials")
COMMAND_NAMES, PATH_NAMES = ("Command Injection", "Go Command Injection"), ("Path Traversal", "Go Path Traversal")
SSRF_NAMES = ("Server-Side Request Forgery (SSRF)", "Go SSRF")
INJECTION_NAMES = (*SQL_NAMES, "NoSQL Injection", *COMMAND_NAMES, *XSS_NAMES, *PATH_NAMES, *SSRF_NAMES)
INJECTION_WORDS = ("injection", "xss", "ssrf", "traversal")
NAMES = {
    "sql_injection": (*SQL_NAMES, "NoSQL Injection"), "xss": XSS_NAMES, "command_injection": COMMAND_NAMES, "path_traversal": PATH_NAMES,
    "deserialization": ("Insecure Deserialization",), "crypto": ("Weak Cryptography", "Go Weak Cryptography", "Weak Password Storage"), "ssrf": SSRF_NAMES,
}

# Patterns of safe usage, safe places, user input and lines that are no code in use. Case is ignored.
SAFE = {
    "sql_injection": [r"\.execute\s*\([^,]+,\s*[\(\[]", r"\.execute\s*\([^,]+,\s*\{", r"text\s*\([^)]+\)\.bindparams", r"session\.query\(", r"Model\.objects\.", r"\.filter\(", r"\.where\(\w+\s*=="],
    "xss": [r"DOMPurify\.sanitize", r"escape\s*\(", r"sanitize\s*\(", r"textContent\s*=", r"createTextNode\s*\(", r"\{\s*\w+\s*\}", r"html\.escape\(", r"markupsafe\.escape", r"bleach\.clean"],
    "command_injection": [r"subprocess\.run\s*\(\s*\[", r"subprocess\.call\s*\(\s*\[", r"execFile\s*\(", r"shell\s*=\s*False", r"shlex\.quote", r"shlex\.split"],
    "path_traversal": [r"os\.path\.basename\s*\(", r"secure_filename\s*\(", r"os\.path\.realpath.*?startswith", r"\.resolve\(\).*?is_relative_to", r"path\.normalize"],
    "deserialization": [r"yaml\.safe_load", r"json\.loads?", r"Loader=yaml\.SafeLoader"],
    "crypto": [r"bcrypt\.", r"argon2", r"sha256|sha384|sha512|sha3", r"AES|ChaCha|Salsa", r"pbkdf2", r"scrypt"],
    "ssrf": [r"allowlist|whitelist", r"isPrivate|is_private", r"isLoopback|is_loopback", r"validateURL|validate_url"],
}
SAFE_PLACES = [
    r"^\s*#", r"^\s*//", r"^\s*/\*", r"^\s*\*", r'""".*?"""', r"'''.*?'''", r"^\s*(const|let|var)\s+\w+\s*=\s*[\"'][^\"']*[\"']$",
    r"logger\.", r"console\.log", r"print\s*\(", r"\.debug\s*\(", r"\.info\s*\(", r"raise\s+\w+Error", r"throw\s+new\s+\w+",
]
USER_INPUT = {
    "python": [r"request\.", r"args\[", r"form\[", r"params\[", r"input\s*\(", r"sys\.argv", r"os\.environ"],
    "javascript": [r"req\.(query|body|params|headers)", r"request\.(query|body|params)", r"window\.location", r"document\.(URL|cookie|referrer)", r"localStorage", r"sessionStorage"],
    "go": [r"r\.URL\.Query", r"r\.FormValue", r"r\.Body", r"r\.Header\.Get", r"c\.Query", r"c\.Param", r"c\.PostForm"],
    "java": [r"getParameter", r"getHeader", r"getInputStream", r"@RequestParam", r"@PathVariable"],
    "php": [r"\$_GET", r"\$_POST", r"\$_REQUEST", r"\$_COOKIE", r"\$_SERVER"],
}
ANY_INPUT = [r"request\.", r"req\.", r"params\[", r"input\s*\(", r"argv"]
CREDENTIAL_EXCLUSIONS = [r"(example|test|sample|placeholder|xxx+|your[_-]?|dummy|fake)", r"os\.environ", r"getenv", r"config\[", r"settings\.", r"process\.env"]
DOCUMENTATION = [
    r"^[\"'].*?(example|documentation|usage|sample|demo|test).*?[\"']$", r"^#.*?(example|todo|note|fixme|hack|xxx)", r"^//.*?(example|todo|note|fixme)",
    r"^\s*\*\s+@", r'""".*?"""', r"'''.*?'''", r'^\s*"""', r"^\s*'''",
]
EXAMPLE, REAL = r"\b(example|sample|demo|test_data|mock|fake|dummy)\b", r"(execute|query|innerHTML|eval|system)"
PLACEHOLDERS = [
    r"[\"']<.*?>[\"']", r"[\"']xxx+[\"']", r"[\"']your[_-]?\w+[\"']", r"[\"']changeme[\"']", r"[\"']placeholder[\"']", r"[\"']TODO[\"']", r"[\"']CHANGE_ME[\"']",
    r"[\"']secret[\"']$", r"[\"']password[\"']$", r"[\"']api[_-]?key[\"']$", r"=\s*[\"'][\"']",
]
PATTERN_LITERAL, PATTERN_NAME = r"r[\"'].*?(SELECT|INSERT|execute|innerHTML)", r"(pattern|regex|rule|check)\s*[=:]"
SAFE_ORM = [r"\.objects\.(get|filter|exclude|create|update)", r"session\.query\(\w+\)\.(filter|filter_by|get)", r"\.where\(\w+\.\w+\s*(==|!=|>|<)", r"\.find\(\s*\{\s*\w+\s*:\s*\w+\s*\}\s*\)"]
SAFE_DOM = [r"textContent\s*=", r"innerText\s*=", r"\.text\s*\(", r"createTextNode", r"DOMPurify\.sanitize"]
COMMENT_MARKERS = {
    "python": ["#"], "javascript": ["//", "/*", "*"], "typescript": ["//", "/*", "*"], "java": ["//", "/*", "*"], "php": ["//", "#", "/*", "*"], "ruby": ["#"], "go": ["//", "/*", "*"],
    "csharp": ["//", "/*", "*", "///"], "c_cpp": ["//", "/*", "*"], "kotlin": ["//", "/*", "*"], "swift": ["//", "/*", "*"], "rust": ["//", "/*", "*", "//!", "///"], "scala": ["//", "/*", "*"], "shell": ["#"],
}
INLINE_COMMENT = {"python": r"\s+#\s+", "javascript": r"\s+//\s+", "java": r"\s+//\s+", "go": r"\s+//\s+"}
TEST_PATHS = ("test_", "_test.", ".test.", "tests/", "/test/", "spec_", "_spec.", ".spec.", "specs/", "/spec/", "__tests__", "mock_", "_mock.", "/mocks/", "fixture", "conftest", "pytest")
LEVELS = ("info", "low", "medium", "high", "critical")


def one_pattern(patterns: list[str]) -> str:
    """Any of the patterns, case ignored: one regex, compiled once."""
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


def any_of(text: Column, patterns: list[str]) -> Column:
    return F.coalesce(text.rlike(one_pattern(patterns)), F.lit(False))


def _either(tests: list[Column]) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))


def is_comment(line: Column, language: Column) -> Column:
    """Starts with a comment marker of its language, or holds one between blanks; an unknown language has none."""
    bare = F.regexp_replace(line, r"^\s+", "")
    starts = [(language == k) & reduce(lambda a, b: a | b, [bare.startswith(m) for m in ms]) for k, ms in COMMENT_MARKERS.items()]
    return _either(starts + [(language == k) & bare.rlike(r"\S") & line.rlike(p) for k, p in INLINE_COMMENT.items()])


def in_string(line: Column, at: Column) -> Column:
    """Is the character at 0-based position ``at`` inside quotes: an odd number of quotes of a kind, not escaped, before it."""
    before = F.substring(line, F.lit(1), at)
    return _either([F.regexp_count(before, F.lit(rf"(?<!\\){q}")) % 2 == 1 for q in ("'", '"')])


def is_test_file(path: Column) -> Column:
    return _either([F.lower(path).contains(s) for s in TEST_PATHS])


def safe_usage(line: Column, name: Column, catalog: dict[str, list[str]] | None = None) -> Column:
    """The line does what makes a finding of this name safe; names without a category are never safe."""
    return _either([name.isin(*NAMES[k]) & any_of(line, ps) for k, ps in (catalog or SAFE).items()])


def safe_place(line: Column) -> Column:
    return any_of(line, SAFE_PLACES)


def user_input(context: Column, language: Column) -> Column:
    """Evidence of user input near the finding, by the language's patterns or, for another language, the general ones."""
    known = [(language == k) & any_of(context, ps) for k, ps in USER_INPUT.items()]
    other = ~F.coalesce(language.isin(*USER_INPUT), F.lit(False)) & any_of(context, ANY_INPUT)
    return _either([*known, other])


def suppressed(line: Column, name: Column, language: Column) -> Column:
    """Is this almost surely no finding: empty (null too), comment, documentation, placeholder, pattern text, safe ORM or DOM call."""
    bare = F.regexp_replace(line, r"^\s+|\s+$", "")
    return _either([
        F.coalesce(bare, F.lit("")) == "", is_comment(line, language), any_of(bare, DOCUMENTATION), any_of(bare, [EXAMPLE]) & ~any_of(bare, [REAL]),
        name.isin(*CREDENTIAL_NAMES) & any_of(line, PLACEHOLDERS), line.rlike(PATTERN_LITERAL) & any_of(line, [PATTERN_NAME]),
        name.isin(*SQL_NAMES) & any_of(line, SAFE_ORM), name.isin(*XSS_NAMES) & any_of(line, SAFE_DOM),
    ])


def confidence(severity: Column, name: Column, line: Column, path: Column, language: Column, context: Column) -> Column:
    """high, medium, low or info: the severity's base less what speaks against the finding. Without a language, input is not asked for."""
    minus = lambda test, by: F.when(test, by).otherwise(0)
    s = F.when(severity == "critical", 4).when(severity == "high", 3).when(severity == "medium", 2).otherwise(1)
    s = s - minus(safe_usage(line, name), 3) - minus(safe_place(line), 2) - minus(is_test_file(path), 2)
    s = s - minus(language.isNotNull() & ~user_input(context, language) & name.isin(*INJECTION_NAMES), 1)
    s = s - minus(name.isin(*CREDENTIAL_NAMES) & any_of(line, CREDENTIAL_EXCLUSIONS), 3)
    return F.when(s >= 4, "high").when(s >= 2, "medium").when(s >= 1, "low").otherwise("info")


def shifted(base: Column, name: Column, line: Column, at: Column, path: Column, language: Column, context: Column) -> Column:
    """The pattern's own level moved down, never below info; null where the finding is weak and in a safe place, and so goes.

    ``at`` is the 0-based position of the match, ``context`` the lines before with the line itself.
    """
    levels = F.array(*map(F.lit, LEVELS))
    i = F.coalesce(F.nullif(F.array_position(levels, base), F.lit(0)) - 1, F.lit(2))
    safe, place = safe_usage(line, name), safe_place(line)
    injection = _either([F.lower(name).contains(w) for w in INJECTION_WORDS])
    for test, by in ((safe, 2), (is_test_file(path), 2), (in_string(line, at), 2), (place, 1), (injection & ~user_input(context, language), 1)):
        i = F.greatest(F.lit(0), i - F.when(test, by).otherwise(0))
    return F.when((i <= 1) & (safe | place), F.lit(None)).otherwise(F.element_at(levels, (i + 1).cast("int")))
