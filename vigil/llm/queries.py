"""The queries that apply each corpus operator, with production parameters, to its whole table; and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, conversations, fingerprint, licenses, lm, media, minhash, packing, quality, resampling, rules, substring, toxicity
from .common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


OP1_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh FROM d)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)
), g AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e
), r(node, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT g.y, r.root FROM r JOIN g ON g.x = r.node
), m AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.root AS component_id, d.doc_id = m.root AS kept
FROM d JOIN m ON m.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_pairs(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan(table(spark, sf_dir, "documents")))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.store(table(spark, sf_dir, "documents")))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.dedup(docs, report=True)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rules.judge(docs, rules.references(docs)).drop("class_distance", "word_distance")


_COUNT = lambda pattern: f"length(t) - length(regexp_replace(t, '{pattern}', '', 'g'))"
_CLASS_COUNTS = ["(" + _COUNT(p) + ")" for p in ("[a-z]", "[A-Z]", "[0-9]", r"[\x20\x09-\x0D]", "[.,;:''\"?!()-]")]
_CLASS_COUNTS += [f"({_COUNT(r'[\x00-\x7F]')}) - {' - '.join(_CLASS_COUNTS)}", r"length(regexp_replace(t, '[\x00-\x7F]', '', 'g'))"]
_FAR = "sqrt(greatest(0, (sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) + sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END)) / 2))"

OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents
), w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d
), n AS (SELECT id, doc_id, lang, w, len(w) AS n, length(t) AS chars, [{", ".join(_CLASS_COUNTS)}] AS c, {_COUNT("[#*$%&|<>]")} AS symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w
), g AS (SELECT id, i, list_aggregate(w[i:i + 7], 'string_agg', ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) > 7)
), again AS (SELECT id, count(DISTINCT k) AS repeated FROM (SELECT id, unnest(range(i, i + 8)) AS k FROM (SELECT *, count(*) OVER (PARTITION BY id, g) AS times FROM g) WHERE times > 1) GROUP BY id
), v AS (SELECT id, lang, n, word, count(*) AS times FROM (SELECT id, lang, n, trim(translate(unnest(w), '{UPPER}', '{LOWER}'), '.,;:!?"''()') AS word FROM n) GROUP BY ALL
), top AS (SELECT * FROM (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS place FROM v WHERE n >= 100 GROUP BY lang, word) WHERE place <= 64
), total AS (SELECT lang, count(*) AS total FROM n WHERE n >= 100 GROUP BY lang HAVING count(*) >= 20
), shares AS (
  SELECT lang, k AS feature, 1000 * c[k] // chars AS share FROM (SELECT lang, c, chars, unnest(range(1, 8)) AS k FROM n WHERE n >= 100)
  UNION ALL SELECT lang, 7 + place, 1000 * times // n FROM v JOIN top USING (lang, word) WHERE n >= 100
), counted AS (SELECT lang, feature, share, count(*) AS n FROM shares WHERE share > 0 GROUP BY ALL
), ranked AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY lang, feature ORDER BY share DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM counted JOIN total USING (lang)
), median AS (SELECT lang, feature, share FROM ranked WHERE 2 * (total - above) >= total AND 2 * (total - above - n) < total
), class_ref AS (SELECT t.lang, t.k, coalesce(m.share, 0)::DOUBLE / (sum(coalesce(m.share, 0)) OVER (PARTITION BY t.lang)) AS q FROM (SELECT lang, unnest(range(1, 8)) AS k FROM total) t LEFT JOIN median m ON m.lang = t.lang AND m.feature = t.k
), word_ref AS (SELECT m.lang, top.word, m.share / 1000.0::DOUBLE AS q FROM median m JOIN top ON top.lang = m.lang AND m.feature = 7 + top.place
), class_far AS (SELECT id, {_FAR} AS far FROM (SELECT n.id, n.c[r.k]::DOUBLE / n.chars AS p, r.q FROM n JOIN class_ref r USING (lang) WHERE n.n >= 20) GROUP BY id
), bins AS (SELECT n.id, n.n, r.q, coalesce(v.times, 0) AS times FROM n JOIN word_ref r USING (lang) LEFT JOIN v ON v.id = n.id AND v.word = r.word WHERE n.n >= 50
), word_far AS (SELECT id, {_FAR} AS far FROM (SELECT id, times::DOUBLE / n AS p, q FROM bins UNION ALL SELECT id, (n - sum(times))::DOUBLE / n, greatest(1 - sum(q), 0) FROM bins GROUP BY id, n) GROUP BY id
), r AS (SELECT n.*, coalesce(again.repeated, 0) AS repeated, n < 20 OR 100 * coalesce(again.repeated, 0) > 30 * n AS failed, class_far.far AS cf, word_far.far AS wf FROM n LEFT JOIN again USING (id) LEFT JOIN class_far USING (id) LEFT JOIN word_far USING (id))
SELECT doc_id, n AS n_words, chars - c[4] AS word_chars, symbols AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, repeated AS n_repeat_words, failed AS base_failed,
  NOT failed AND coalesce(cf <= {rules.CLASS_LIMIT[0]} + {rules.CLASS_LIMIT[1]} / sqrt(n), true) AND coalesce(wf <= {rules.WORD_LIMIT[0]} + {rules.WORD_LIMIT[1]} / sqrt(n), true) AS kept FROM r
"""


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damage(table(spark, sf_dir, "conversations")))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: crc32 of text column x, by bytes; t.c is the table of its 256 steps.
CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i)) AS c"
CRC = "xor(list_reduce(list_transform(range(1, 2 * octet_length(encode({x})), 2), lambda i: CAST('0x' || substr(hex(encode({x})), i, 2) AS BIGINT)), lambda a, b: xor(a >> 8, t.c[1 + (xor(a, b) & 255)]), 4294967295), 4294967295)"

_NEXT_STATE = "CASE {p} WHEN 3 THEN 4 ELSE 3 END"  # states: 1 nothing yet, 2 after system, 3 after user, 4 after assistant


def _op12_sql() -> str:
    """A list of the best (cost, audit, lines, state) per state, folded over the turns; every audit is spelled out."""
    role = "CASE {p} WHEN 3 THEN 'assistant' ELSE 'user' END"
    line = lambda r, x: f"list_append({r}, {x})"
    ins = "list_transform({a}, lambda v: {{'cost': v.cost + 3, 'audit': v.audit || 'I', 'lines': " + line("v.lines", role.format(p="v.state") + " || ':'") + ", 'state': " + _NEXT_STATE.format(p="v.state") + "}})"
    once = ins.format(a="acc")
    twice = ins.format(a=once)
    after = f"list_concat(acc, {once}, {twice})"
    legal = "(v.state = 1 AND x.i IN ('s', 'u') OR v.state IN (2, 4) AND x.i = 'u' OR v.state = 3 AND x.i = 'a')"
    deleted = "list_transform(a, lambda v: {'cost': v.cost + 4, 'audit': v.audit || 'D', 'lines': v.lines, 'state': v.state})"
    kept = f"list_transform(list_filter(a, lambda v: {legal}), lambda v: {{'cost': v.cost + x.more, 'audit': v.audit || 'K', 'lines': {line('v.lines', 'x.line')}, 'state': CASE x.i WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END}})"
    changed = f"list_transform(a, lambda v: {{'cost': v.cost + x.more + 3, 'audit': v.audit || 'R', 'lines': {line('v.lines', role.format(p='v.state') + chr(32) + chr(124) * 2 + chr(32) + chr(39) + ':' + chr(39) + ' || x.text')}, 'state': {_NEXT_STATE.format(p='v.state')}}})"
    edits = " ".join(f"list_concat({deleted}, CASE WHEN x.gone THEN [] ELSE list_concat({kept}, {changed}) END)".split())
    best = "list_transform(list_filter([1, 2, 3, 4], lambda s: len(list_filter(e, lambda v: v.state = s)) > 0), lambda s: list_sort(list_filter(e, lambda v: v.state = s))[1])"
    best, edits = best.replace("(e,", f"({edits},").replace("(a,", f"({after},"), edits
    start = "[{'cost': 0, 'audit': '', 'lines': CAST([] AS VARCHAR[]), 'state': 1}]"
    end = f"list_sort(list_filter(list_concat(acc, {once}, {twice}), lambda v: v.state IN (1, 4)))[1]"
    return rf"""
WITH t AS ({CRC_TABLE}), o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), p AS (SELECT o.*, {CRC.format(x="k")} % 20 AS what FROM o, t
), q AS (SELECT conv_id, turn, CASE what WHEN 4 THEN 'user' ELSE role END AS role, CASE what WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE what WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM p WHERE what <> 0
), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text), copy) AS n FROM q
), f AS (SELECT *, left(role, 1) AS i, NOT regexp_matches(text, '[^ 	-
]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS dup,
    NOT regexp_matches(text, '[.!?][ 	-
]*$') AS cut, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM r
), c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(NOT blank AND dup) AS duplicate, count_if(NOT blank AND NOT dup AND cut) AS truncated,
    count_if(n > 1 AND before || i NOT IN ('su', 'ua', 'au')) AS illegal,
    list({{'i': i, 'gone': blank OR dup, 'more': CASE WHEN cut THEN 3 ELSE 0 END, 'line': role || ':' || text, 'text': text}} ORDER BY n) AS turns FROM f GROUP BY conv_id
), d AS (SELECT conv_id, gaps, blank, duplicate, truncated, illegal, list_reduce(turns, lambda acc, x: {best}, {start}) AS acc FROM c
), z AS (SELECT conv_id, gaps, blank, duplicate, truncated, illegal, {end} AS e FROM d)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
  CAST(coalesce(e.cost, 0) AS BIGINT) AS cost, coalesce(e.audit, '') AS audit, sha256(coalesce(array_to_string(e.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN z ON a.conv_id IS NOT DISTINCT FROM z.conv_id
"""


OP12_SQL = _op12_sql()

OP13_SQL = rf"""
WITH t AS ({CRC_TABLE}), w AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), f AS (
  SELECT kind, id, unnest(w) AS f FROM w
  UNION ALL SELECT kind, id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w
  UNION ALL SELECT kind, id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w
), b AS (SELECT f, {CRC.format(x='f')} % 10000 AS b FROM (SELECT DISTINCT f FROM f), t
), g AS (SELECT kind, id, b FROM f JOIN b USING (f)
), c AS (SELECT b, count_if(kind = 'd') AS s, count_if(kind = 'b') AS t FROM g GROUP BY b
), u AS (SELECT sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM c
), gain AS (SELECT b, CAST(floor(1000 * ln((c.t + 1)::DOUBLE * (u.s + 10000) / ((c.s + 1)::DOUBLE * (u.t + 10000)))) AS BIGINT) AS gain FROM c, u
), d AS (SELECT id, count(*) AS n, sum(gain) AS weight FROM g JOIN gain USING (b) WHERE kind = 'd' GROUP BY id
), r AS (SELECT w.id AS doc_id, coalesce(d.n, 0) AS n_features, CAST(coalesce(d.weight, 0) AS BIGINT) AS weight, len(w.w) >= 20 AS able,
    CAST(coalesce(d.weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || left(sha256('42:' || w.id), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM w LEFT JOIN d ON d.id = w.id WHERE kind = 'd'
), k AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, 5 * count_if(able) OVER () // 100 AS m FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= m THEN place END AS rank FROM k
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_near_dedup": OP1_SQL, "op11_quality_rules": OP11_SQL, "op12_conversation_repair": OP12_SQL, "op13_importance_resampling": OP13_SQL}
