"""Findings judged line by line: what is suppressed and what confidence remains. Every part stands for one finding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import precision as P
from .registry import query, table

#: (name, severity, language, line, where the match starts): parts take them in turn.
FINDINGS = [(n, s, g, l, max(l.find(m), 0)) for n, s, g, l, m in [
    ("SQL Injection", "critical", "python", 'cursor.execute("SELECT * FROM t WHERE id=" + request.args["id"])', "cursor"),
    ("SQL Injection", "critical", "python", 'cursor.execute("SELECT * FROM t WHERE id=%s", (uid,))', "cursor"),
    ("SQL Injection", "critical", "python", "User.objects.filter(id=uid)", "User"),
    ("SQL Injection", "high", "python", "rows = db.run(base + uid)  # unsafe", "db"),
    ("SQL Injection", "high", "go", 'db.Query("SELECT * FROM t WHERE id=" + r.FormValue("id"))', "db"),
    ("SQL Injection", "high", "python", "rule = r\"SELECT .* FROM\"", "SELECT"),
    ("NoSQL Injection", "high", "javascript", "users.find({ name: req.body.name })", "users"),
    ("XSS (Cross-Site Scripting)", "high", "javascript", "node.innerHTML = req.query.q", "node"),
    ("XSS (Cross-Site Scripting)", "high", "javascript", "node.textContent = req.query.q", "node"),
    ("XSS (Cross-Site Scripting)", "high", "javascript", "node.innerHTML = DOMPurify.sanitize(q)", "node"),
    ("XSS (Cross-Site Scripting)", "medium", "javascript", "out.write(escape(q))", "out"),
    ("Command Injection", "critical", "python", "subprocess.run([tool, name])", "subprocess"),
    ("Command Injection", "critical", "python", "os.system('ls ' + sys.argv[1])", "os"),
    ("Command Injection", "high", "ruby", "system(params[:cmd])", "system"),
    ("Path Traversal", "high", "java", 'new File(dir, req.getParameter("f"))', "new"),
    ("Path Traversal", "medium", "python", "open(os.path.basename(name))", "open"),
    ("Hardcoded Credentials", "high", "python", 'password = "changeme"', "password"),
    ("Hardcoded Credentials", "high", "python", 'password = "hunter2x"', "password"),
    ("Hardcoded Credentials", "critical", "python", "password = settings.DB_PASSWORD", "password"),
    ("Weak Cryptography", "medium", "python", 'print("md5 is weak", hashlib.md5(x))', "md5"),
    ("Weak Cryptography", "low", "python", "h = hashlib.sha256(hashlib.md5(x))", "hashlib"),
    ("Insecure Deserialization", "high", "python", "obj = pickle.loads(data)", "pickle"),
    ("Insecure Deserialization", "high", "python", "say('it\\'s', 'yaml.load(x)')", "yaml"),
    ("Server-Side Request Forgery (SSRF)", "high", "php", "file_get_contents($_GET['u'])", "file"),
    ("Open Redirect", "medium", "javascript", "// redirect(target)", "redirect"),
    ("Open Redirect", "medium", "javascript", "use(demo)", "use"),
    ("Open Redirect", "medium", "javascript", "evaluate(demo)", "evaluate"),
    ("Open Redirect", "info", "kotlin", "", ""),
]]

_q = lambda s: "'" + s.replace("'", "''") + "'"
_m = lambda text, patterns: f"regexp_matches({text}, {_q(P.one_pattern(patterns))})"
_in = lambda names: f"name IN ({', '.join(map(_q, names))})"
_or = lambda tests: "(" + " OR ".join(tests) + ")"
_bare = "trim(line)"
_odd = lambda q: f"(length(before) - length(replace(before, {_q(q)}, '')) - (length(before) - length(replace(before, chr(92) || {_q(q)}, ''))) // 2) % 2 = 1"
_comment = _or([f"language = '{k}' AND {_or([f'starts_with({_bare}, {_q(m)})' for m in ms])}" for k, ms in P.COMMENT_MARKERS.items()] + [f"language = '{k}' AND regexp_matches(line, '{p}')" for k, p in P.INLINE_COMMENT.items()])
_known = ", ".join(_q(k) for k in P.USER_INPUT)
_suppressed = _or([
    f"{_bare} = ''", _comment, _m(_bare, P.DOCUMENTATION), f"{_m(_bare, [P.EXAMPLE])} AND NOT {_m(_bare, [P.REAL])}", f"{_in(P.CREDENTIAL_NAMES)} AND {_m('line', P.PLACEHOLDERS)}",
    f"regexp_matches(line, {_q(P.PATTERN_LITERAL)}) AND {_m('line', [P.PATTERN_NAME])}", f"{_in(P.SQL_NAMES)} AND {_m('line', P.SAFE_ORM)}", f"{_in(P.XSS_NAMES)} AND {_m('line', P.SAFE_DOM)}",
])


@query(f"""
WITH t(k, name, severity, language, line, pos) AS (VALUES {", ".join(f"({i}, {_q(n)}, {_q(s)}, {_q(g)}, {_q(l)}, {a})" for i, (n, s, g, l, a) in enumerate(FINDINGS))}),
f AS (SELECT p_partkey, t.*, left(line, pos) AS before, CASE WHEN p_size % 5 = 0 THEN 'tests/' ELSE 'src/' END || replace(p_name, ' ', '_') AS path FROM part JOIN t ON p_partkey % {len(FINDINGS)} = k),
s AS (SELECT *, {_suppressed} AS suppressed, {_or([f"{_in(P.NAMES[k])} AND {_m('line', ps)}" for k, ps in P.SAFE.items()])} AS safe, {_m('line', P.SAFE_PLACES)} AS place,
  {_or([f"strpos(lower(path), {_q(x)}) > 0" for x in P.TEST_PATHS])} AS test, {_or([f"language = '{k}' AND {_m('line', ps)}" for k, ps in P.USER_INPUT.items()] + [f"language NOT IN ({_known}) AND {_m('line', P.ANY_INPUT)}"])} AS input,
  {_odd("'")} OR {_odd('"')} AS quoted FROM f),
c AS (SELECT *, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END - 3 * safe::INT - 2 * place::INT - 2 * test::INT
  - (NOT input AND {_in(P.INJECTION_NAMES)})::INT - 3 * ({_in(P.CREDENTIAL_NAMES)} AND {_m('line', P.CREDENTIAL_EXCLUSIONS)})::INT AS n,
  greatest(0, list_position(['info', 'low', 'medium', 'high', 'critical'], severity) - 1 - 2 * safe::INT - 2 * test::INT - 2 * quoted::INT - place::INT - (NOT input AND regexp_matches(lower(name), '{"|".join(P.INJECTION_WORDS)}'))::INT) AS i FROM s)
SELECT p_partkey, name, path, CASE WHEN n >= 4 THEN 'high' WHEN n >= 2 THEN 'medium' WHEN n >= 1 THEN 'low' ELSE 'info' END AS confidence,
  CASE WHEN NOT (i <= 1 AND (safe OR place)) THEN ['info', 'low', 'medium', 'high', 'critical'][i + 1] END AS shifted FROM c WHERE NOT suppressed
""")
def findings_judged(spark, sf_dir):
    """Findings that are not suppressed, with the confidence by score and by shifted level (null: it goes). One projection over the scan."""
    kinds = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("name", "severity", "language", "line", "at"), f, strict=True)]) for f in FINDINGS])
    path = F.concat(F.when(F.col("p_size") % 5 == 0, "tests/").otherwise("src/"), F.replace("p_name", F.lit(" "), F.lit("_")))
    f = table(spark, sf_dir, "part").select("p_partkey", path.alias("path"), F.element_at(kinds, (F.col("p_partkey") % len(FINDINGS) + 1).cast("int")).alias("f")).select("p_partkey", "path", "f.*")
    name, line, language = F.col("name"), F.col("line"), F.col("language")
    kept = f.where(~P.suppressed(line, name, language))
    return kept.select(
        "p_partkey", "name", "path", P.confidence(F.col("severity"), name, line, F.col("path"), language, line).alias("confidence"),
        P.shifted(F.col("severity"), name, line, F.col("at"), F.col("path"), language, line).alias("shifted"),
    )
