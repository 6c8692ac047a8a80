"""Queries over whole tables, one for each operator, with the SQL that tells their results.

Conversations stand for session logs: a conversation is a session, a turn an entry that follows the one before it. Where
a query needs branches, the fourth turn is put under the first. Inputs the tables don't have (tool calls,
Chinese text, constraints) are given as values on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnstone.functions import patterns as P
from turnstone.functions import text as X
from turnstone.operators import evidence as EV
from turnstone.operators import extract as E
from turnstone.operators import manifest as M
from turnstone.operators import postings as I
from turnstone.operators import ranking as R
from turnstone.operators import tools as TL
from turnstone.operators import tree as T
from turnstone.plans import build as B
from turnstone.plans import search as Q
from turnstone.plans.staging import Staging
from turnstone.sources import sessions as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query by its name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.from_conversations(table(spark, sf_dir, "conversations"))


def forked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose fourth turn follows the first: two branches where there are four turns."""
    first = F.concat_ws(":", "session_id", F.lit("0"))
    return entries_of(spark, sf_dir).withColumn("parent_id", F.when(F.col("ordinal") == 3, first).otherwise(F.col("parent_id")))


ENTRIES = """entries AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(turn AS INTEGER) AS ordinal, conv_id || ':' || turn AS entry_id,
  CASE WHEN lag(turn) OVER w IS NOT NULL THEN conv_id || ':' || lag(turn) OVER w END AS parent_id, role, coalesce(text, '') AS text
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""
FORKED = f"""{ENTRIES}, forked AS (SELECT * REPLACE (CASE WHEN ordinal = 3 THEN session_id || ':0' ELSE parent_id END AS parent_id) FROM entries)"""
LEAVES = f"""{FORKED}, leaves AS (SELECT f.* FROM forked f WHERE NOT EXISTS (SELECT 1 FROM forked c WHERE c.session_id = f.session_id AND c.parent_id = f.entry_id))"""
PATHS = f"""{LEAVES}, walk AS (SELECT session_id, entry_id AS leaf_id, ordinal AS leaf_ord, [entry_id] AS path, parent_id AS up FROM leaves
  UNION ALL SELECT w.session_id, w.leaf_id, w.leaf_ord, list_prepend(f.entry_id, w.path), f.parent_id FROM walk w JOIN forked f ON f.session_id = w.session_id AND f.entry_id = w.up),
paths AS (SELECT session_id, leaf_id, leaf_ord, path, len(path) AS path_len FROM walk WHERE up IS NULL OR up NOT IN (SELECT entry_id FROM forked)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY path_len DESC, leaf_ord * 1000 DESC, leaf_ord) AS path_rank FROM paths)"""
TURNS = f"""{PATHS}, placed AS (SELECT r.session_id, r.leaf_id, r.path_rank, u.pos, f.entry_id, f.role, f.text
  FROM ranked r, LATERAL (SELECT unnest(range(len(r.path))) AS pos) u JOIN forked f ON f.session_id = r.session_id AND f.entry_id = r.path[u.pos + 1]),
numbered AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, leaf_id ORDER BY pos) AS turn_no FROM placed),
turned AS (SELECT session_id, leaf_id, path_rank, turn_no, list(entry_id ORDER BY pos) AS ids, arg_max(role, pos) FILTER (role IN ('user', 'assistant')) AS last_role FROM numbered WHERE turn_no >= 1 GROUP BY ALL),
hashed AS (SELECT *, ids[1] AS user_entry_id, substr(sha256(array_to_string(ids, '|')), 1, 16) AS variant_hash FROM turned),
firsts AS (SELECT * FROM hashed QUALIFY row_number() OVER (PARTITION BY session_id, user_entry_id, variant_hash ORDER BY path_rank, turn_no) = 1)"""


@query(f"WITH {ENTRIES} SELECT session_id, ordinal, entry_id, parent_id, role, text FROM entries")
def entries_scan(spark, sf_dir):
    return entries_of(spark, sf_dir).select("session_id", "ordinal", "entry_id", "parent_id", "role", "text")


_HEADER = "CASE WHEN conv_id % 7 = 1 THEN 'no header' WHEN conv_id % 7 = 2 THEN 'entries before the header' WHEN conv_id % 7 = 3 THEN 'another project' WHEN conv_id % 7 = 4 THEN 'no session id' WHEN conv_id % 7 = 5 AND n = 0 THEN 'nothing but malformed lines' END"


def session_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a log: headers of all kinds, lines that are no JSON, entries without an id, a last line that isn't whole."""
    rows = table(spark, sf_dir, "conversations")
    kind = F.col("conv_id") % 7
    key = F.when(F.col("turn") % 5 == 4, "").otherwise(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    line = F.to_json(F.struct(F.lit("message").alias("type"), key.alias("id"), F.struct("role", F.col("text").alias("content")).alias("message")))
    made = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.when(kind == 6, F.concat(line, F.lit("\n{broken"))).otherwise(line).alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    header = F.to_json(F.struct(F.lit("session").alias("type"), F.when(kind != 4, F.col("conv_id").cast("string")).alias("id"), F.when(kind == 3, "/elsewhere").otherwise("/w/p").alias("cwd")))
    content = F.when(kind == 1, F.concat("lines", F.lit("\n"))).when(kind == 2, F.concat_ws("\n", "lines", header, F.lit(""))).when(kind == 5, F.concat(header, F.lit("\n"), "lines")).otherwise(F.concat(header, F.lit("\n"), "lines", F.lit("\n")))
    path = F.concat(F.lit("log/"), F.col("conv_id").cast("string"))
    return made.select(path.alias("source_path"), F.lit("1").alias("mtime_ns"), F.length(content).cast("long").alias("size_bytes"), F.sha2(path, 256).alias("fingerprint"), F.encode(content, "UTF-8").alias("content"))


_WHOLE = "valid AS (SELECT *, conv_id % 7 AS k FROM conversations WHERE turn % 5 <> 4 AND (conv_id % 7 <> 5 OR turn < (SELECT max(turn) FROM conversations c WHERE c.conv_id = conversations.conv_id))), c AS (SELECT conv_id, (SELECT count(*) FROM valid v WHERE v.conv_id = d.conv_id) AS n, count(*) AS turns, count(*) FILTER (turn % 5 = 4 AND (conv_id % 7 <> 5 OR turn < (SELECT max(turn) FROM conversations m WHERE m.conv_id = d.conv_id))) AS blank FROM conversations d GROUP BY conv_id)"


@query(f"WITH {_WHOLE} SELECT 'log/' || conv_id AS source_path, {_HEADER} AS rejected, CAST(blank + CASE WHEN conv_id % 7 = 6 THEN turns ELSE 0 END AS BIGINT) AS malformed, conv_id % 7 IN (5, 6) AS incomplete_trailing FROM c")
def header_gate(spark, sf_dir):
    sessions, _ = S.sessions_of(session_files(spark, sf_dir), S.Project("p", "/w/p"))
    return sessions.select("source_path", "rejected", "malformed", "incomplete_trailing")


@query(f"WITH {_WHOLE} SELECT CAST(conv_id AS VARCHAR) AS session_id, conv_id || ':' || turn AS entry_id, role, text FROM valid WHERE k IN (0, 5, 6)")
def entry_filter(spark, sf_dir):
    _, entries = S.sessions_of(session_files(spark, sf_dir), S.Project("p", "/w/p"))
    return entries.select("session_id", "entry_id", "role", "text")


@query("SELECT conv_id, sha256('log/' || conv_id || '|' || max(turn) || '|' || sum(strlen(text))) AS fingerprint FROM conversations GROUP BY conv_id")
def file_fingerprint(spark, sf_dir):
    files = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("mtime"), F.sum(F.octet_length("text")).alias("size"))
    return files.select("conv_id", S.fingerprint(F.concat(F.lit("log/"), F.col("conv_id").cast("string")), F.col("mtime"), F.col("size")).alias("fingerprint"))


DIFF = """SELECT coalesce(k.doc_id, l.doc_id) AS doc_id, CASE WHEN k.doc_id IS NULL THEN 'added' WHEN l.doc_id IS NULL THEN 'deleted'
  WHEN k.quality = CASE WHEN l.n_chars > 500 THEN 1 ELSE 0 END THEN 'unchanged' ELSE 'modified' END AS change
  FROM labels k FULL JOIN documents l ON k.doc_id = l.doc_id"""


def _diff(spark, sf_dir):
    known = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("fingerprint"))
    listed = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") > 500, 1).otherwise(0).alias("fingerprint"))
    return M.manifest_diff(known, listed, "doc_id")


@query(DIFF)
def manifest_diff(spark, sf_dir):
    return _diff(spark, sf_dir)


@query("SELECT " + ", ".join(f"count(*) FILTER (change = '{c}') AS {c}" for c in ("unchanged", "added", "modified", "deleted")) + f" FROM ({DIFF})")
def reconcile_counts(spark, sf_dir):
    return M.diff_counts(_diff(spark, sf_dir))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def deleted_sessions(spark, sf_dir):
    return M.gone(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT d.doc_id FROM labels d WHERE NOT EXISTS (SELECT 1 FROM documents p WHERE p.doc_id = d.doc_id AND p.lang = 'en')")
def orphan_check(spark, sf_dir):
    return M.orphans(table(spark, sf_dir, "labels").select("doc_id"), table(spark, sf_dir, "documents").filter("lang = 'en'"), "doc_id", "doc_id")


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def missing_postings(spark, sf_dir):
    return M.without(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, toxic FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'fr')")
def rows_of_parents(spark, sf_dir):
    return M.of_parents(table(spark, sf_dir, "labels").select("doc_id", "toxic"), table(spark, sf_dir, "documents").filter("lang = 'fr'"), "doc_id")


@query("""WITH old AS (SELECT doc_id AS key, toxic AS value, 0 AS version FROM labels), new AS (SELECT doc_id AS key, n_chars AS value, 1 AS version FROM documents WHERE n_chars % 3 = 0 UNION ALL SELECT doc_id, n_chars + 1, 2 FROM documents WHERE n_chars % 6 = 0)
SELECT key, CAST(arg_max(value, version) AS BIGINT) AS value FROM (SELECT * FROM old UNION ALL SELECT * FROM new) GROUP BY key""")
def meta_upsert(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    put = lambda value, version, test: docs.filter(test).select(F.col("doc_id").alias("key"), F.expr(value).cast("long").alias("value"), F.lit(version).alias("version"))
    old = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.col("toxic").cast("long").alias("value"), F.lit(0).alias("version"))
    return M.upsert(old, put("n_chars", 1, "n_chars % 3 = 0").unionByName(put("n_chars + 1", 2, "n_chars % 6 = 0"))).select("key", "value")


@query("SELECT coalesce(max(doc_id), 0) AS last FROM labels")
def last_row_id(spark, sf_dir):
    return M.last_id(table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT count(*) AS rows, count(*) AS ids, true AS all_new FROM documents")
def next_row_ids(spark, sf_dir):
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"))
    made = M.numbered(table(spark, sf_dir, "documents").select("doc_id"), known, "row_id")
    last = known.agg(F.max("row_id")).first()[0]
    return made.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("row_id").alias("ids"), F.min(F.col("row_id") > last).alias("all_new"))


@query("SELECT count(*) AS entries, count(DISTINCT conv_id) AS sessions, max(turn) AS last_turn FROM conversations")
def table_counts(spark, sf_dir):
    return M.counts(table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query(f"WITH RECURSIVE {LEAVES} SELECT session_id, entry_id FROM leaves")
def leaves(spark, sf_dir):
    return T.leaves(forked(spark, sf_dir)).select("session_id", "entry_id")


@query(f"WITH RECURSIVE {PATHS} SELECT session_id, leaf_id, array_to_string(path, '>') AS path, CAST(path_len AS INTEGER) AS path_len, CAST(path_rank AS INTEGER) AS path_rank FROM ranked")
def leaf_paths(spark, sf_dir):
    return T.ranked_paths(T.leaf_paths(forked(spark, sf_dir))).select("session_id", "leaf_id", F.array_join("path", ">").alias("path"), "path_len", "path_rank")


def _placed(spark, sf_dir):
    rows = forked(spark, sf_dir)
    return T.turns(T.ranked_paths(T.leaf_paths(rows)), rows)


@query(f"WITH RECURSIVE {TURNS} SELECT session_id, leaf_id, CAST(turn_no AS BIGINT) AS turn_no, array_to_string(ids, '|') AS ids, variant_hash FROM hashed")
def turn_chunks(spark, sf_dir):
    return T.variants(_placed(spark, sf_dir)).select("session_id", "leaf_id", "turn_no", F.array_join("raw_entry_ids", "|").alias("ids"), "variant_hash")


@query(f"WITH RECURSIVE {TURNS} SELECT session_id, leaf_id AS branch_leaf_id, user_entry_id, substr(sha256('p|' || session_id || '|' || user_entry_id || '|' || variant_hash), 1, 32) AS chunk_id FROM firsts")
def chunk_ids(spark, sf_dir):
    rows = T.first_variants(T.variants(_placed(spark, sf_dir)))
    return rows.select("session_id", F.col("leaf_id").alias("branch_leaf_id"), "user_entry_id", T.chunk_id(F.lit("p"), F.col("session_id"), F.col("user_entry_id"), F.col("variant_hash")).alias("chunk_id"))


@query(f"WITH RECURSIVE {TURNS} SELECT session_id, user_entry_id, variant_hash, leaf_id, CAST(path_rank AS INTEGER) AS path_rank, CAST(turn_no AS BIGINT) AS turn_no FROM firsts")
def chunk_dedupe_first_path(spark, sf_dir):
    return T.first_variants(T.variants(_placed(spark, sf_dir))).select("session_id", "user_entry_id", "variant_hash", "leaf_id", "path_rank", "turn_no")


@query(f"WITH RECURSIVE {TURNS} SELECT session_id, user_entry_id, count(DISTINCT variant_hash) AS variants, count(*) AS paths FROM hashed GROUP BY ALL")
def branch_variants(spark, sf_dir):
    made = T.variants(_placed(spark, sf_dir))
    return made.groupBy("session_id", "user_entry_id").agg(F.count_distinct("variant_hash").alias("variants"), F.count(F.lit(1)).alias("paths"))


@query(f"""WITH RECURSIVE {TURNS}, n AS (SELECT session_id, user_entry_id, count(*) AS n FROM firsts GROUP BY ALL)
SELECT session_id, CAST(sum(n) AS BIGINT) AS chunk_count, max(n) AS most_variants, array_to_string(list(user_entry_id ORDER BY user_entry_id) FILTER (n > 1), ',') AS users, max(n) > 1 AS variant_limit_hit, sum(n) > 3 AS chunk_limit_hit
FROM n GROUP BY session_id HAVING max(n) > 1 OR sum(n) > 3""")
def variant_limit(spark, sf_dir):
    found = T.variant_limits(T.first_variants(T.variants(_placed(spark, sf_dir))), per_user=1, per_session=3)
    users = F.array_join("limited_user_entry_ids", ",")
    return found.select("session_id", "chunk_count", "most_variants", F.when(users != "", users).alias("users"), "variant_limit_hit", "chunk_limit_hit")


@query(f"WITH RECURSIVE {TURNS} SELECT session_id, leaf_id, CAST(turn_no AS BIGINT) AS turn_no, last_role = 'assistant' AS closed, turn_no = max(turn_no) OVER (PARTITION BY session_id, leaf_id) AS is_last FROM hashed")
def turn_status(spark, sf_dir):
    return T.variants(_placed(spark, sf_dir)).select("session_id", "leaf_id", "turn_no", "closed", "is_last")


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS assistant FROM conversations WHERE role = 'assistant' AND text <> '' GROUP BY conv_id")
def assistant_concat(spark, sf_dir):
    return T.said(table(spark, sf_dir, "conversations").filter("role = 'assistant'"), "conv_id", "turn")


_WS = r"\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}\x0B"


def _sql_redacted(column: str) -> str:
    out = column
    # Secrets and what stands in their place, as DuckDB spells them.
    for pattern, label in (
        (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", "[REDACTED_PRIVATE_KEY]"),
        (r"\bsk-[A-Za-z0-9]{20,}\b", "[REDACTED_API_KEY]"),
        (r"\bghp_[A-Za-z0-9]{20,}\b", "[REDACTED_TOKEN]"),
        (r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b", "[REDACTED_TOKEN]"),
        (rf"(?i)\bBearer[{_WS}]+[A-Za-z0-9\-._~+/]+=*\b", "Bearer [REDACTED]"),
        (rf"(?i)\b(?:api[_-]?key|token|password|secret)[{_WS}]*[:=][{_WS}]*[\"'']?[^{_WS}\"'']{{8,}}[\"'']?", "[REDACTED_CREDENTIAL]"),
        (r"\b[A-Za-z0-9+/]{40,}={0,2}\b", "[REDACTED_BLOB]"),
    ):
        out = f"regexp_replace({out}, '{pattern}', '{label}', 'g')"
    return out


@query(f"SELECT doc_id, md5(r) AS redacted_md5, r <> text AS changed FROM (SELECT doc_id, text, {_sql_redacted('text')} AS r FROM documents)")
def redact_documents(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", X.mask_secrets("text").alias("r"))
    return rows.select("doc_id", F.md5("r").alias("redacted_md5"), (F.col("r") != F.col("text")).alias("changed"))


_LABELS = sorted({label.removeprefix("Bearer ") for _, label in P.SECRETS})


@query("WITH r AS (SELECT r FROM (SELECT " + _sql_redacted("text") + " AS r FROM documents) UNION ALL SELECT " + _sql_redacted("html") + " FROM pages), l AS (SELECT unnest([" + ", ".join(f"'{x}'" for x in _LABELS) + "]) AS label) SELECT label, CAST(sum((length(r) - length(replace(r, label, ''))) / length(label)) AS BIGINT) AS n FROM r, l GROUP BY label")
def redact_counts(spark, sf_dir):
    """How often each label stands in all documents and pages."""
    masked = table(spark, sf_dir, "documents").select(X.mask_secrets("text").alias("r")).unionByName(table(spark, sf_dir, "pages").select(X.mask_secrets("html").alias("r")))
    found = masked.agg(*[F.sum((F.char_length("r") - F.char_length(F.replace("r", F.lit(x), F.lit("")))) / len(x)).cast("long").alias(x) for x in _LABELS])
    return found.select(F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"`{x}`").alias("n")) for x in _LABELS])).alias("x")).select("x.*")


@query("SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE substr(text, 1, 300) || '…' END AS snippet FROM documents")
def clip_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.clip("text", 300).alias("snippet"))


_PATHS = [("/w/p/src/a.ts", "/w/p"), ("/w/p", "/w/p"), ("C:\\w\\p\\x.py", "C:\\w\\p"), ("/other/x", "/w/p"), ("/w/pp/x", "/w/p"), ("/w/p/.env", "/w/p"), ("k/id_rsa", "/w/p"), ("a/server.PEM", "/w/p"), ("src/order.ts", "/w/p"), ("credentials.json", "/w/p")]
_PATH_VALUES = ", ".join(f"('{p}', '{r}')" for p, r in _PATHS)


@query(f"""SELECT path, root, CASE WHEN p = r THEN '.' WHEN starts_with(p, r || '/') THEN substr(p, length(r) + 2) ELSE p END AS shown,
regexp_matches(regexp_extract(path, '[^/\\\\]*$'), s) OR regexp_matches(path, s) AS sensitive
FROM (SELECT path, root, replace(path, '\\', '/') AS p, replace(root, '\\', '/') AS r, '(?i)(?:^|/)(?:\\.env(?:\\..+)?|credentials(?:\\.json)?|\\.npmrc|\\.netrc|id_rsa|id_ed25519|.*\\.(?:pem|key|p12|pfx))$' AS s FROM (VALUES {_PATH_VALUES}) t(path, root))""")
def display_and_sensitive_paths(spark, sf_dir):
    rows = spark.createDataFrame(_PATHS, "path string, root string")
    return rows.select("path", "root", X.display_path("path", "root").alias("shown"), X.is_sensitive("path").alias("sensitive"))


_FOLD = "lower(trim(regexp_replace(nfc_normalize(coalesce(text, '')), '[^A-Za-z0-9_./:@+-]+', ' ', 'g')))"


def _folded(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.latin_fold(X.nfc(F.col("text"))).alias("folded"))


@query(f"SELECT conv_id, turn, {_FOLD} AS folded FROM conversations")
def latin_fold(spark, sf_dir):
    return _folded(spark, sf_dir)


@query(f"SELECT conv_id, turn, array_to_string(list_filter(string_split({_FOLD}, ' '), lambda t: length(t) >= 2)[1:64], ' ') AS tokens FROM conversations")
def query_tokens(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("text", X.nfc("text"))
    return rows.select("conv_id", "turn", F.array_join(X.query_tokens("text"), " ").alias("tokens"))


_CJK = ["货期规则", "修改货期，规则", "a货b", "plain", "カナと漢字", "货 货"]


@query("""SELECT text, array_to_string(list_distinct_ordered, ' ') AS grams FROM (SELECT text, list_filter(g, lambda x, i: list_position(g, x) = i) AS list_distinct_ordered FROM (
SELECT text, flatten(list_transform(regexp_extract_all(text, '[\\x{3040}-\\x{30ff}\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}]+'), lambda s: CASE WHEN length(s) = 1 THEN [s] ELSE
flatten(list_transform(range(1, length(s)), lambda i: CASE WHEN i + 2 <= length(s) THEN [substr(s, i, 2), substr(s, i, 3)] ELSE [substr(s, i, 2)] END)) END)) AS g FROM (VALUES """ + ", ".join(f"('{t}')" for t in _CJK) + ") t(text)))")
def cjk_grams(spark, sf_dir):
    return spark.createDataFrame([(t,) for t in _CJK], "text string").select("text", F.array_join(X.cjk_grams("text"), " ").alias("grams"))


_SYMBOLS = r"""SELECT conv_id, turn, value, i AS place FROM (SELECT conv_id, turn, s[i] AS value, i FROM (SELECT conv_id, turn, list_filter(a, lambda v: length(v) >= 3 AND NOT (contains(v, '/') AND contains(v, '.'))) AS s
FROM (SELECT conv_id, turn, regexp_extract_all(text, '`([A-Za-z_][\w./:-]{1,120})`', 1) || regexp_extract_all(text, '\b([A-Z][A-Za-z0-9_]{2,}(?:\.[A-Za-z_]\w*)*|[a-z_][a-z0-9_]{2,}/[0-9]+)\b', 1) AS a FROM conversations)),
LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i))"""


def _symbols(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("_s", E.find_symbols("text"))
    return rows.select("conv_id", "turn", F.explode(E.symbol_entities("_s", 0.5)).alias("e")).select("conv_id", "turn", "e.*")


_LEAST = "SELECT conv_id, turn, arg_min(value, place) AS value, lower(value) AS normalized_value FROM ({}) GROUP BY conv_id, turn, lower(value)".format(_SYMBOLS)


@query(_LEAST)
def symbols(spark, sf_dir):
    return _symbols(spark, sf_dir).select("conv_id", "turn", "value", "normalized_value")


# RE2 has no look-ahead: marks that may stand on both sides of a path are doubled, and the one behind it is part of the match.
_PATH_SQL = r"""list_transform(regexp_extract_all(regexp_replace(text, '([\s"''`(),;:\]])', '\1\1', 'g'), '(?:^|[\s"''`(])((?:\.\.?/|/)?[\w.@+-]+(?:/[\w.@+-]+)+\.\w{1,8}|[\w.@+-]+\.\w{1,8})(?:[\s"''`,);:\]]|$)', 1), lambda x: x)"""
_SENSITIVE_SQL = r"(?i)(?:^|/)(?:\.env(?:\..+)?|credentials(?:\.json)?|\.npmrc|\.netrc|id_rsa|id_ed25519|.*\.(?:pem|key|p12|pfx))$"


@query(f"""WITH p AS (SELECT doc_id, unnest({_PATH_SQL}) AS raw, generate_subscripts({_PATH_SQL}, 1) AS i FROM (SELECT doc_id, text || ' see /w/p/src/f' || doc_id % 50 || '.ts, then (b/id_rsa) or `lib/x.PY`' AS text FROM documents)),
f AS (SELECT doc_id, arg_min(raw, i) AS raw FROM p GROUP BY doc_id, lower(raw))
SELECT doc_id, CASE WHEN starts_with(raw, '/w/p/') THEN substr(raw, 6) ELSE raw END AS value FROM f WHERE NOT regexp_matches(raw, '{_SENSITIVE_SQL}')""")
def path_entities(spark, sf_dir):
    more = F.concat(F.lit(" see /w/p/src/f"), (F.col("doc_id") % 50).cast("string"), F.lit(".ts, then (b/id_rsa) or `lib/x.PY`"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", more).alias("text")).withColumn("_p", E.find_paths("text"))
    return rows.select("doc_id", F.explode(E.path_entities("_p", F.lit("/w/p"))).alias("e")).select("doc_id", "e.value")


_ERRORS = ["TypeError: x is bad", "fatal: bad ref", "first\nNot Found here\nE404 gone away", "ok", "Exception in thread main\nexception IN thread MAIN"]


@query("""SELECT text, array_to_string(list_filter(v, lambda x, i: list_position(list_transform(v, lambda y: lower(y)), lower(x)) = i), '#') AS errors FROM (SELECT text, list_filter(list_transform(
regexp_extract_all(text, '(?i)(?:Error|Exception|FAILED|fatal:|panic:|Traceback|undefined|not found|E[0-9]{3,4})\\b[^\\n]{0,200}'), lambda m: trim(m)), lambda m: length(m) >= 8) AS v FROM (VALUES """ + ", ".join("(" + "||chr(10)||".join(f"'{x}'" for x in t.split("\n")) + ")" for t in _ERRORS) + ") t(text))")
def errors(spark, sf_dir):
    rows = spark.createDataFrame([(t,) for t in _ERRORS], "text string")
    return rows.select("text", F.array_join(F.transform(E.error_entities("text"), lambda e: e["value"]), "#").alias("errors"))


def _stating(spark, sf_dir):
    """Conversations in which "the" states a constraint and "and" an exclusion."""
    word = lambda w: f"(?<![A-Za-z0-9_]){w}(?![A-Za-z0-9_])"
    text = F.regexp_replace(F.regexp_replace("text", word("the"), "must not"), word("and"), "I skipped")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text"))


_STATING = r"stating AS (SELECT conv_id, turn, regexp_replace(regexp_replace(text, '\bthe\b', 'must not', 'g'), '\band\b', 'I skipped', 'g') AS text FROM conversations)"
_SENTENCES = rf"""{_STATING}, parts AS (SELECT conv_id, turn, unnest(string_split(regexp_replace(text, '([。！？.!?\n])[{_WS}]+', '\1' || chr(1), 'g'), chr(1))) AS s FROM stating),
sentences AS (SELECT conv_id, turn, trimmed AS s, regexp_extract(trimmed, '(?i)\b(because|must not|must|cannot|constraint|rule|invariant|required)\b', 1) AS word FROM (SELECT conv_id, turn, regexp_replace(s, '^[{_WS}]+|[{_WS}]+$', '', 'g') AS trimmed FROM parts)),
stated AS (SELECT conv_id, turn, {_sql_redacted("x")} AS text, lower(word) AS trigger_word FROM (SELECT *, regexp_replace(s, '[{_WS}]+', ' ', 'g') AS x FROM sentences WHERE length(s) BETWEEN 8 AND 400 AND word <> '' AND NOT regexp_matches(s, '^[`''"][^`''"]{{0,80}}[`''"]$')))"""


@query(f"WITH {_SENTENCES} SELECT conv_id, turn, text, trigger_word FROM stated")
def constraints(spark, sf_dir):
    return _stating(spark, sf_dir).select("conv_id", "turn", F.explode(E.constraints("text")).alias("c")).select("conv_id", "turn", "c.text", "c.trigger_word")


@query(f"WITH {_SENTENCES} SELECT DISTINCT conv_id, lower(text) AS normalized_text FROM stated")
def constraint_dedupe(spark, sf_dir):
    found = _stating(spark, sf_dir).select(F.col("conv_id").alias("chunk_id"), "turn", F.posexplode(E.constraints("text")).alias("i", "c")).select("chunk_id", (F.col("turn") * 10_000 + F.col("i")).alias("seq"), F.lit("one").alias("source_entry_id"), "c.*")
    return E.dedupe_constraints(found).select(F.col("chunk_id").alias("conv_id"), "normalized_text")


@query("SELECT text, trigger_word FROM (VALUES ('Dates must not be early.', 'must not'), ('x because y is long.', 'because'), ('这个字段必须先有单据才能保存。', '必须')) t(text, trigger_word)")
def constraint_samples(spark, sf_dir):
    said = "Dates must not be early. We cannot find it here. x because y is long.\n这个字段必须先有单据才能保存。 short"
    rows = spark.createDataFrame([(said,)], "text string")
    return rows.select(F.explode(E.constraints("text")).alias("c")).select("c.text", "c.trigger_word")


_RULED_OUT = rf"'(?i)I (?:ruled out|excluded|skipped)[{_WS}]+([^\n.]{{3,80}})(?:[{_WS}]+because[{_WS}]+([^\n.]{{3,120}}))?'"


@query(rf"""WITH {_STATING}, found AS (SELECT conv_id, turn, regexp_extract_all(text, {_RULED_OUT}, 0) AS w, regexp_extract_all(text, {_RULED_OUT}, 1) AS t, regexp_extract_all(text, {_RULED_OUT}, 2) AS r FROM stating),
each AS (SELECT conv_id, turn, unnest(w) AS whole, regexp_replace(unnest(t), '^[{_WS}]+|[{_WS}]+$', '', 'g') AS target, regexp_replace(unnest(r), '^[{_WS}]+|[{_WS}]+$', '', 'g') AS reason, generate_subscripts(w, 1) AS i FROM found),
kept AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS n FROM each WHERE target <> '')
SELECT conv_id, turn, {_sql_redacted("target")} AS target, CASE WHEN reason <> '' THEN {_sql_redacted("reason")} ELSE {_sql_redacted("whole")} END AS outcome, CAST(9999 + n AS INTEGER) AS step_order FROM kept""")
def exclusions(spark, sf_dir):
    rows = _stating(spark, sf_dir)
    return rows.select("conv_id", "turn", F.explode(E.exclusions("text")).alias("e")).select("conv_id", "turn", "e.target", "e.outcome", "e.step_order")


_EXCLUDED = ["I ruled out the cache because it is cold. Fine", "I skipped module a\nI excluded b2b2", "问题不在缓存，因为它是冷的。", "nothing"]


@query("""SELECT text, target, outcome, step_order FROM (VALUES
('I ruled out the cache because it is cold. Fine', 'the cache because it is cold', 'I ruled out the cache because it is cold', 10000),
('I skipped module a' || chr(10) || 'I excluded b2b2', 'module a', 'I skipped module a', 10000), ('I skipped module a' || chr(10) || 'I excluded b2b2', 'b2b2', 'I excluded b2b2', 10001),
('问题不在缓存，因为它是冷的。', '缓存', '它是冷的', 10000)) t(text, target, outcome, step_order)""")
def exclusion_samples(spark, sf_dir):
    rows = spark.createDataFrame([(t,) for t in _EXCLUDED], "text string")
    return rows.select("text", F.explode(E.exclusions("text")).alias("e")).select("text", "e.target", "e.outcome", "e.step_order")


_COMMANDS = ["rg x src", "cat a | grep b", "find . -name x", "ls -la", "tree", "bun test a", "cargo test", "findx", "make", "grepper"]


@query("""SELECT command, CASE WHEN regexp_matches(command, '^(?:rg|grep|egrep|fgrep)\\b|\\b(?:rg|grep)\\b') THEN 'grep' WHEN regexp_matches(command, '^find\\b') THEN 'find' WHEN regexp_matches(command, '^(?:ls|tree)\\b') THEN 'list'
WHEN regexp_matches(command, '\\b(?:test|pytest|vitest|jest)\\b') THEN 'verification' ELSE 'bash' END AS kind FROM (VALUES """ + ", ".join(f"('{c}')" for c in _COMMANDS) + ") t(command)")
def bash_classify(spark, sf_dir):
    return spark.createDataFrame([(c,) for c in _COMMANDS], "command string").select("command", TL.shell_kind("command").alias("kind"))


# Events stand for tool calls and their results: a user's events of one day are a chunk; clicks, views and purchases call, signups and errors answer.
_TOOL = "CASE WHEN event_type = 'purchase' THEN 'bash' WHEN event_id % 4 = 0 THEN 'Read' WHEN event_id % 4 = 1 THEN 'grep' WHEN event_id % 4 = 2 THEN 'edit' ELSE 'fetch' END"
_FILE = "CASE WHEN event_id % 11 = 0 THEN 'conf/.env' ELSE '/w/p/src/f' || event_id % 13 || '.ts' END"
_RUN = "CASE event_id % 3 WHEN 0 THEN 'pytest -q' WHEN 1 THEN 'ls src' ELSE 'make all' END"
_CALLS = f"""ev AS (SELECT CAST(user_id AS VARCHAR) AS chunk_id, CAST(event_id AS INTEGER) AS ord, 'e' || event_id AS entry_id, 't' || event_id % 5 AS tool_call_id, event_type, event_id, value FROM events),
calls AS (SELECT *, {_TOOL} AS tool_name, {_FILE} AS file, {_RUN} AS run FROM ev WHERE event_type IN ('click', 'view', 'purchase')),
results AS (SELECT *, CAST(floor(value) AS INTEGER) || '!' AS text, event_type = 'error' AS is_error FROM ev WHERE event_type IN ('signup', 'error')),
met AS (SELECT r.chunk_id, c.ord AS c_ord, r.ord, r.entry_id, r.text, r.is_error FROM results r JOIN calls c ON c.chunk_id = r.chunk_id AND c.tool_call_id = r.tool_call_id AND c.ord < r.ord QUALIFY row_number() OVER (PARTITION BY r.chunk_id, r.ord ORDER BY c.ord DESC) = 1),
last AS (SELECT chunk_id, c_ord, arg_max(entry_id, ord) AS result_entry_id, arg_max(text, ord) AS result_text, arg_max(is_error, ord) AS is_error, count(*) AS results FROM met GROUP BY ALL),
paired AS (SELECT c.chunk_id, c.ord, c.entry_id, c.tool_call_id, c.tool_name, c.file, c.run, c.event_id, l.result_entry_id, coalesce(l.result_text, '') AS result_text, coalesce(l.is_error, false) AS is_error, coalesce(l.results, 0) AS results FROM calls c LEFT JOIN last l ON l.chunk_id = c.chunk_id AND l.c_ord = c.ord)"""


def _paired(spark, sf_dir):
    name = lambda c, n: F.concat(F.lit(n), c.cast("string"))
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", "value", F.col("user_id").cast("string").alias("chunk_id"), F.col("event_id").cast("int").alias("ord"), name(F.col("event_id"), "e").alias("entry_id"), name(F.col("event_id") % 5, "t").alias("tool_call_id"))
    made = rows.withColumns({"tool_name": F.expr(_TOOL), "file": F.expr(_FILE), "run": F.expr(_RUN)})
    given = F.when(F.col("tool_name") == "bash", F.create_map(F.lit("command"), "run")).when(F.col("tool_name") == "grep", F.create_map(F.lit("pattern"), F.lit("Foo"), F.lit("PATH"), "file")).when(F.col("tool_name") == "fetch", F.create_map(F.lit("url"), F.lit("x"))).otherwise(F.create_map(F.lit("filePath"), "file"))
    calls = made.filter("event_type in ('click', 'view', 'purchase')").select("chunk_id", "ord", F.lit(0).alias("sub"), "entry_id", "tool_call_id", "tool_name", given.alias("arguments"))
    results = rows.filter("event_type in ('signup', 'error')").select("chunk_id", "ord", "entry_id", "tool_call_id", F.concat(F.floor("value").cast("int").cast("string"), F.lit("!")).alias("text"), (F.col("event_type") == "error").alias("is_error"))
    return TL.pair_results(calls, results)


@query(f"WITH {_CALLS} SELECT chunk_id, ord, tool_call_id, result_entry_id, result_text, results FROM paired")
def tool_pairing(spark, sf_dir):
    return _paired(spark, sf_dir).select("chunk_id", "ord", "tool_call_id", "result_entry_id", "result_text", "results")


_KIND = "CASE WHEN tool_name = 'bash' THEN CASE WHEN run LIKE 'pytest%' THEN 'verification' WHEN run LIKE 'ls%' THEN 'list' ELSE 'bash' END WHEN tool_name = 'fetch' THEN CASE WHEN is_error THEN 'error' ELSE 'tool' END ELSE lower(tool_name) END"
_SHOWN = "CASE WHEN tool_name = 'bash' THEN run WHEN tool_name = 'fetch' THEN 'fetch' WHEN file LIKE '%.env' THEN CASE WHEN tool_name = 'grep' THEN 'Foo in [SENSITIVE_PATH]' ELSE '[SENSITIVE_PATH]' END WHEN tool_name = 'grep' THEN 'Foo in ' || file ELSE substr(file, 6) END"


@query(f"""WITH {_CALLS}, made AS (SELECT *, {_KIND} AS kind, {_SHOWN} AS target, CASE WHEN is_error THEN 'error' WHEN result_entry_id IS NOT NULL THEN 'success' ELSE 'unknown' END AS status FROM paired),
steps AS (SELECT chunk_id, ord, 0 AS extra, kind AS step_type, target, status, result_text AS outcome FROM made UNION ALL SELECT chunk_id, ord, 1, 'error', target, status, result_text FROM made WHERE is_error)
SELECT chunk_id, CAST(row_number() OVER (PARTITION BY chunk_id ORDER BY ord, extra) AS INTEGER) AS step_order, step_type, target, lower(target) AS normalized_target, status, outcome FROM steps""")
def trace_steps(spark, sf_dir):
    return TL.trace_steps(_paired(spark, sf_dir), F.lit("/w/p")).select("chunk_id", "step_order", "step_type", "target", "normalized_target", "status", "outcome")


@query(f"WITH {_CALLS} SELECT ord, {_KIND} AS step_type FROM paired")
def tool_classify(spark, sf_dir):
    given = TL.with_given(_paired(spark, sf_dir))
    return given.select("ord", TL.step_type(F.col("tool_name"), F.col("given_command"), F.col("is_error")).alias("step_type"))


@query(f"SELECT conv_id, normalized_value, arg_min(value, CASE WHEN turn % 2 = 0 THEN 100000000 ELSE 0 END + turn * 100000 + place) AS value FROM (SELECT *, lower(value) AS normalized_value FROM ({_SYMBOLS})) GROUP BY conv_id, normalized_value")
def entity_dedupe(spark, sf_dir):
    """The surest of entities alike: those of odd turns are surer here."""
    rows = _symbols(spark, sf_dir).withColumn("confidence", F.when(F.col("turn") % 2 == 0, 0.5).otherwise(0.7))
    order = Window.partitionBy("conv_id").orderBy("turn", F.monotonically_increasing_id())
    rows = rows.withColumns({"chunk_id": F.col("conv_id"), "source_entry_id": F.lit("one"), "seq": F.row_number().over(order)})
    return E.dedupe_entities(rows).select("conv_id", "normalized_value", "value")


_EVENT = "CASE doc_id % 5 WHEN 0 THEN 'compaction' WHEN 1 THEN 'branch_summary' WHEN 2 THEN 'custom_message' WHEN 3 THEN 'custom_message' ELSE 'message' END"


@query(f"""SELECT * FROM (SELECT doc_id, {_EVENT} AS evidence_type, CASE WHEN doc_id % 5 = 1 THEN 'session' ELSE 'chunk' END AS evidence_scope, CASE WHEN doc_id % 10 = 1 THEN '' ELSE source || ' ' || n_chars END AS text,
CAST(CASE doc_id % 5 WHEN 0 THEN 0.5 WHEN 1 THEN 0.55 ELSE 0.45 END AS DOUBLE) AS confidence FROM documents WHERE doc_id % 5 IN (0, 1, 2)) WHERE text <> ''""")
def evidence_scope(spark, sf_dir):
    said = F.when(F.col("doc_id") % 10 == 1, "").otherwise(F.concat_ws(" ", "source", F.col("n_chars").cast("string")))
    own = F.when(F.col("doc_id") % 5 == 3, "turnstone-hint").otherwise("other")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(_EVENT).alias("type"), said.alias("summary"), said.alias("content"), own.alias("custom_type"))
    return EV.evidence(rows).select("doc_id", "evidence_type", "evidence_scope", "text", "confidence")


def _postings(spark, sf_dir):
    rows = _folded(spark, sf_dir).select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chunk_id"), "folded")
    return rows, I.postings(rows, "latin", ["folded"], I.words)


_TOKENS = f"tokens AS (SELECT conv_id || ':' || turn AS chunk_id, conv_id, turn, regexp_extract_all({_FOLD}, '[a-z0-9]+') AS t FROM conversations), post AS (SELECT chunk_id, conv_id, turn, unnest(t) AS token, unnest(range(len(t))) AS pos FROM tokens)"


@query(f"WITH {_TOKENS} SELECT token, count(DISTINCT chunk_id) AS df FROM post GROUP BY token")
def token_df(spark, sf_dir):
    return I.document_frequency(_postings(spark, sf_dir)[1]).select("token", "df")


@query(f"WITH {_TOKENS} SELECT chunk_id, count(*) AS len FROM post GROUP BY chunk_id")
def doc_len(spark, sf_dir):
    return I.lengths(_postings(spark, sf_dir)[1]).select("chunk_id", "len")


@query(f"WITH {_TOKENS} SELECT (SELECT count(*) FROM conversations) AS n, round(count(*) / (SELECT count(*) FROM conversations), 9) AS avgdl FROM post")
def corpus_stats(spark, sf_dir):
    rows, post = _postings(spark, sf_dir)
    stats = I.corpus(rows.select(F.lit("latin").alias("source"), "chunk_id"), post)
    return stats.select("n", F.round("avgdl", 9).alias("avgdl"))


@query(f"""WITH {_TOKENS}, q AS (SELECT CAST(item_id AS VARCHAR) AS qid, unnest(regexp_extract_all(lower(regexp_replace(text, '[^A-Za-z0-9_./:@+-]+', ' ', 'g')), '[a-z0-9]{{2,}}')) AS token FROM benchmark),
lens AS (SELECT chunk_id, count(*) AS len FROM post GROUP BY chunk_id), s AS (SELECT (SELECT count(*) FROM conversations) AS n, count(*) / (SELECT count(*) FROM conversations) AS avgdl FROM post),
f AS (SELECT token, chunk_id, count(*) AS f FROM post GROUP BY ALL), d AS (SELECT token, count(*) AS df FROM f GROUP BY token),
scored AS (SELECT q.qid, f.chunk_id, -sum(greatest(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END, 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / avgdl))) AS score FROM q JOIN f USING (token) JOIN d USING (token) JOIN lens USING (chunk_id), s GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9), chunk_id) AS rank FROM scored) SELECT qid, chunk_id, round(score, 4) AS score, CAST(rank AS INTEGER) AS rank FROM top WHERE rank <= 50""")
def bm25_top50(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("qid"), X.latin_fold("text").alias("t"))
    terms = items.select("qid", F.lit("latin").alias("source"), F.posexplode(F.regexp_extract_all("t", F.lit("[a-z0-9]{2,}"), F.lit(0))).alias("phrase_no", "term"))
    rows, post = _postings(spark, sf_dir)
    stage = Staging(spark)
    post = stage(post, "postings")
    scores = I.bm25(post, I.phrases(terms, I.words), I.corpus(rows.select(F.lit("latin").alias("source"), "chunk_id"), post), stage=stage)
    top = I.best(scores.withColumn("score", F.round("score", 9)), rows.select("chunk_id", F.col("chunk_id").alias("doc_seq")))
    return top.select("qid", "chunk_id", F.round("score", 4).alias("score"), "rank")


@query(f"""WITH {_TOKENS}, lens AS (SELECT chunk_id, count(*) AS len FROM post GROUP BY chunk_id), s AS (SELECT (SELECT count(*) FROM conversations) AS n, count(*) / (SELECT count(*) FROM conversations) AS avgdl FROM post),
f AS (SELECT chunk_id, count(*) AS f FROM post WHERE token = 'thou' GROUP BY chunk_id), d AS (SELECT count(*) AS df FROM f)
SELECT chunk_id, round(-(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / avgdl)), 6) AS score FROM f JOIN lens USING (chunk_id), d, s""")
def bm25_single(spark, sf_dir):
    rows, post = _postings(spark, sf_dir)
    stage = Staging(spark)
    post = stage(post, "postings")
    wanted = I.phrases(spark.createDataFrame([("q", "latin", 0, "thou")], "qid string, source string, phrase_no int, term string"), I.words)
    found = I.bm25(post, wanted, I.corpus(rows.select(F.lit("latin").alias("source"), "chunk_id"), post), stage=stage)
    return found.select("chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {_TOKENS} SELECT a.chunk_id, count(*) AS f FROM post a JOIN post b ON a.chunk_id = b.chunk_id AND b.pos = a.pos + 1 WHERE a.token = 'of' AND b.token = 'the' GROUP BY a.chunk_id")
def phrase_match(spark, sf_dir):
    wanted = I.phrases(spark.createDataFrame([("q", "latin", 0, "of/the")], "qid string, source string, phrase_no int, term string"), I.words)
    post = Staging(spark)(_postings(spark, sf_dir)[1], "postings")  # read twice
    return I.phrase_hits(post, wanted).select("chunk_id", "f")


_ASKED = [("a", ["ther/onthe", "eri"], ["the"], ["the", "ion", "er"]), ("b", [], ["and", "erth"], ["th", "tion"])]
_ASKED_SQL = "asked AS (SELECT * FROM (VALUES ('a', ['ther/onthe', 'eri'], ['the'], ['the', 'ion', 'er']), ('b', []::VARCHAR[], ['and', 'erth'], ['th', 'tion'])) t(qid, paths, symbols, terms))"


def _asked(spark):
    return spark.createDataFrame(_ASKED, "qid string, paths array<string>, symbols array<string>, terms array<string>")


def _with_all_asked(spark, chunks):
    """Each chunk with each of the queries, as if all were candidates."""
    return chunks.withColumn("qid", F.explode(F.array(*[F.lit(q) for q, *_ in _ASKED]))).join(_asked(spark), "qid")


def _entity_rows(spark, sf_dir):
    return _symbols(spark, sf_dir).select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chunk_id"), "normalized_value")


_ENTITY_ROWS = f"ent AS (SELECT conv_id || ':' || turn AS chunk_id, normalized_value FROM ({_LEAST}))"


@query(f"""WITH {_ENTITY_ROWS}, {_ASKED_SQL}, p AS (SELECT qid, unnest(symbols) AS pattern FROM asked), f AS (SELECT DISTINCT qid, pattern, chunk_id FROM ent JOIN p ON contains(normalized_value, pattern)),
r AS (SELECT *, row_number() OVER (PARTITION BY qid, pattern ORDER BY chunk_id) AS n FROM f) SELECT DISTINCT qid, chunk_id FROM r WHERE n <= 40""")
def like_candidates(spark, sf_dir):
    patterns = _asked(spark).select("qid", F.explode("symbols").alias("pattern"))
    entities = Staging(spark)(_entity_rows(spark, sf_dir), "entities")  # read twice
    return R.contained(entities, "normalized_value", patterns, 40).distinct()


def _limited_sql(name: str, most: int) -> str:
    return f"(SELECT qid, chunk_id FROM (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid, pattern ORDER BY chunk_id) AS n FROM (SELECT DISTINCT qid, pattern, chunk_id FROM {name})) WHERE n <= {most})"


@query(f"""WITH {_ENTITY_ROWS}, {_ASKED_SQL}, {_SENTENCES}, {_TOKENS}, con AS (SELECT conv_id || ':' || turn AS chunk_id, lower(text) AS t FROM stated),
e AS (SELECT qid, pattern, chunk_id FROM ent JOIN (SELECT qid, unnest(paths || symbols) AS pattern FROM asked) ON contains(normalized_value, pattern)),
k AS (SELECT qid, pattern, chunk_id FROM con JOIN (SELECT qid, unnest(list_filter(terms, lambda t: length(t) >= 3)) AS pattern FROM asked) ON contains(t, pattern)),
s AS (SELECT qid, pattern, chunk_id FROM ent JOIN (SELECT qid, unnest(paths) AS pattern FROM asked) ON contains(normalized_value, pattern))
SELECT 'a' AS qid, chunk_id FROM post WHERE token = 'thou' UNION SELECT * FROM {_limited_sql('e', 40)} UNION SELECT * FROM {_limited_sql('k', 20)} UNION SELECT * FROM {_limited_sql('s', 20)}""")
def candidates_union(spark, sf_dir):
    stage = Staging(spark)  # entities are read four times, constraints twice
    entities = stage(_entity_rows(spark, sf_dir), "entities")
    chunk = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chunk_id")
    stated = _stating(spark, sf_dir).select(chunk, F.explode(E.constraints("text")).alias("c")).select("chunk_id", "c.normalized_text")
    stated = stage(stated, "constraints")
    fts = _postings(spark, sf_dir)[1].filter("token = 'thou'").select(F.lit("a").alias("qid"), "chunk_id")
    return R.candidates(fts, _asked(spark), entities, stated, entities.withColumnRenamed("normalized_value", "normalized_target"))


@query(f"""WITH {_ENTITY_ROWS}, {_ASKED_SQL} SELECT qid, chunk_id, CAST(floor(sum(CASE WHEN len(list_filter(paths, lambda p: contains(normalized_value, p) OR contains(p, normalized_value))) > 0 THEN 1.0 ELSE 0.0 END + CASE WHEN len(list_filter(symbols, lambda s: contains(normalized_value, s))) > 0 THEN 1.0 ELSE 0.0 END
+ 0.5 * len(list_filter(terms, lambda t: length(t) >= 3 AND contains(normalized_value, t)))) + 0.5) AS INTEGER) AS entity_hits FROM ent, asked GROUP BY ALL""")
def entity_hits(spark, sf_dir):
    rows = _entity_rows(spark, sf_dir)
    return R.entity_hits(_with_all_asked(spark, rows.select("chunk_id").distinct()), rows)


@query(f"""WITH {_ENTITY_ROWS}, {_ASKED_SQL}, near AS (SELECT * FROM ent QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY normalized_value) <= 40)
SELECT qid, chunk_id, CAST(floor(sum(CASE WHEN len(list_filter(paths, lambda p: contains(normalized_value, p))) > 0 THEN 1.0 ELSE 0.0 END + CASE WHEN len(list_filter(terms, lambda t: length(t) >= 3 AND contains(normalized_value, t))) > 0 THEN 0.5 ELSE 0.0 END) + 0.5) AS INTEGER) AS trace_hits FROM near, asked GROUP BY ALL""")
def trace_hits(spark, sf_dir):
    rows = _entity_rows(spark, sf_dir).select("chunk_id", F.col("normalized_value").alias("normalized_target"), F.col("normalized_value").alias("seq"))
    return R.trace_hits(_with_all_asked(spark, rows.select("chunk_id").distinct()), rows)


_STEP = "CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'verification' WHEN 'signup' THEN 'edit' ELSE 'read' END"


@query(f"""SELECT CAST(user_id AS VARCHAR) AS chunk_id, count(*) FILTER (s = 'error') AS error_count, bool_or(s = 'verification') AS has_verification, bool_or(s IN ('edit', 'write', 'verification')) AS has_terminal_write,
count(*) FILTER (s = 'error') > 0 AND bool_or(s = 'verification' AND value > 50) AS success_after_error FROM (SELECT *, {_STEP} AS s FROM events) GROUP BY user_id""")
def step_features(spark, sf_dir):
    steps = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("chunk_id"), F.expr(_STEP).alias("step_type"), F.when(F.col("value") > 50, "success").otherwise("unknown").alias("status"))
    return R.step_features(steps)


_LAST = "CAST(epoch_ms(ts) AS BIGINT)"


def _relevance_sql(latin: str, cjk: str, entity: str, constraint: str, trace: str) -> str:
    """Weighted reciprocal rank fusion; a source takes part where its figure isn't nought."""
    parts = [(1.0, latin, latin), (1.0, cjk, cjk), (1.4, entity, "1"), (1.1, constraint, "1"), (1.2, trace, "1")]
    total = " + ".join(f"CASE WHEN {has} > 0 THEN CAST({w} AS DOUBLE) / (60 + {rank}) ELSE 0.0 END" for w, has, rank in parts)
    most = " + ".join(f"CASE WHEN {has} > 0 THEN CAST({w} AS DOUBLE) / 61 ELSE 0.0 END" for w, has, _ in parts)
    norm = f"CASE WHEN ({most}) > 0 THEN 100 * ({total}) / ({most}) ELSE 0.0 END"
    return f"CAST(greatest(0, least(100, floor(CAST(0.75 AS DOUBLE) * ({norm}) + least(25, {entity} * 5 + {trace} * 3) + 0.5))) AS INTEGER)"


@query(f"""SELECT event_id, CASE WHEN d <= 7 THEN 'High' WHEN d <= 20 THEN 'Medium' ELSE 'Low' END AS freshness, {_relevance_sql("r", "0", "e", "0", "t")} AS relevance,
CAST(greatest(0, least(100, 40 + CASE WHEN e > 0 AND t >= e THEN 30 WHEN e > 0 AND t = 0 THEN -20 ELSE 0 END + CASE WHEN event_type = 'purchase' THEN 10 ELSE 0 END - CASE WHEN event_type = 'view' THEN 30 ELSE 0 END - CASE WHEN event_type = 'error' THEN 10 ELSE 0 END)) AS INTEGER) AS confidence
FROM (SELECT event_id, event_type, (1706745600000 - {_LAST}) / 86400000.0 AS d, 1 + event_id % 50 AS r, event_id % 4 AS e, event_id % 3 AS t FROM events)""")
def score_axes(spark, sf_dir):
    c = F.col
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("ms"), (1 + c("event_id") % 50).alias("r"), (c("event_id") % 4).alias("e"), (c("event_id") % 3).alias("t"))
    kind = lambda k: c("event_type") == k
    zero = F.lit(0)
    return rows.select(
        "event_id",
        R.freshness(c("ms"), 1706745600000, 7, 20).alias("freshness"),
        R.relevance(c("r"), zero, c("e"), zero, c("t")).alias("relevance"),
        R.confidence(c("e"), c("t"), F.lit(False), kind("purchase"), zero, kind("view"), F.when(kind("error"), 1).otherwise(0), F.lit(False)).alias("confidence"),
    )


_RANKS = {"latin": "event_id % 51", "cjk": "event_id % 7", "entity": "event_id % 4", "con": "event_id % 2", "trace": "event_id % 3"}


@query(f"SELECT event_id, {_relevance_sql(*_RANKS)} AS relevance FROM (SELECT event_id, " + ", ".join(f"{e} AS {c}" for c, e in _RANKS.items()) + " FROM events)")
def rrf_relevance(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", R.relevance(*[F.expr(e) for e in _RANKS.values()]).alias("relevance"))


@query("SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'Low' WHEN event_id % 90 <= 14 THEN 'High' WHEN event_id % 90 <= 60 THEN 'Medium' ELSE 'Low' END AS freshness FROM events")
def freshness(spark, sf_dir):
    """Half days up to 45; the borders belong to the fresher side, and what has no time is old."""
    now = 1_706_745_600_000
    end = F.when(F.col("event_id") % 9 == 0, 0).otherwise(now - (F.col("event_id") % 90) * 43_200_000)
    return table(spark, sf_dir, "events").select("event_id", R.freshness(end, now).alias("freshness"))


def _results(spark, sf_dir):
    rows = T.first_variants(T.variants(_placed(spark, sf_dir)))
    rows = rows.select(F.concat_ws("/", "user_entry_id", "variant_hash").alias("chunk_id"), "session_id", "user_entry_id", "start_ts", F.size("raw_entry_ids").alias("n"), F.lit("complete").alias("status"))
    return rows.select("*", F.substring("session_id", 1, 1).alias("qid"), (F.lit(40) + F.col("n")).alias("relevance"), F.lit(50).alias("confidence"), F.col("start_ts").alias("end_ts"))


_SQL_RESULTS = f"{TURNS}, res AS (SELECT user_entry_id || '/' || variant_hash AS chunk_id, session_id, user_entry_id, substr(session_id, 1, 1) AS qid, 40 + len(ids) AS relevance, CAST(string_split(user_entry_id, ':')[2] AS BIGINT) * 1000 AS end_ts FROM firsts)"


@query(f"WITH RECURSIVE {_SQL_RESULTS} SELECT a.chunk_id, array_to_string(list(b.chunk_id ORDER BY b.chunk_id)[1:8], ',') AS sibling_ids FROM res a JOIN res b ON a.session_id = b.session_id AND a.user_entry_id = b.user_entry_id AND a.chunk_id <> b.chunk_id GROUP BY a.chunk_id")
def siblings(spark, sf_dir):
    return R.siblings(_results(spark, sf_dir)).select("chunk_id", F.array_join("sibling_ids", ",").alias("sibling_ids"))


@query(f"""WITH RECURSIVE {_SQL_RESULTS}, o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY relevance DESC, end_ts DESC, chunk_id) AS p FROM res),
g AS (SELECT *, row_number() OVER (PARTITION BY qid, session_id, user_entry_id ORDER BY p) AS k, array_to_string(list_filter(list(chunk_id) OVER (PARTITION BY qid, session_id, user_entry_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), lambda x: x <> chunk_id), ',') AS sibling_ids FROM o),
t AS (SELECT qid, chunk_id, sibling_ids, row_number() OVER (PARTITION BY qid ORDER BY p) AS place FROM g WHERE k = 1) SELECT * REPLACE (CAST(place AS INTEGER) AS place) FROM t WHERE place <= 5""")
def collapse_groups(spark, sf_dir):
    rows = _results(spark, sf_dir)
    top = R.collapse(rows.join(R.siblings(rows), "chunk_id", "left"), 5)
    return top.select("qid", "chunk_id", F.array_join(F.array_sort("sibling_ids"), ",").alias("sibling_ids"), "place")


@query("""SELECT doc_id, relevance, CAST(place AS INTEGER) AS place FROM (SELECT doc_id, n_chars AS relevance, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id % 100 DESC, doc_id DESC, CAST(doc_id AS VARCHAR)) AS place
FROM documents WHERE n_chars >= 40 AND doc_id % 100 >= 30) WHERE place <= 20""")
def threshold_topk(spark, sf_dir):
    """Documents as results: long ones are relevant, the last two digits say how sure they are."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("qid"), F.col("n_chars").alias("relevance"), (F.col("doc_id") % 100).alias("confidence"), F.col("doc_id").alias("end_ts"), F.col("doc_id").cast("string").alias("chunk_id"))
    return R.first(R.good_enough(rows, Q.MIN_RELEVANCE, Q.MIN_CONFIDENCE), 20, "qid", *R.result_order()).select("doc_id", "relevance", "place")


PROJECT = S.Project("conversations", "/conversations")


def conversation_index(spark: SparkSession, sf_dir: str, full_text: bool = True) -> dict[str, DataFrame]:
    """The tables of an index, each written; without ``full_text`` those that no search needs."""
    stage = Staging(spark)
    made = B.build(entries_of(spark, sf_dir), PROJECT, stage=stage, full_text=full_text)
    tables = {name: made[name] if name in ("chunks", "entities") else stage(made[name], name) for name in B.TABLES if name in made}
    if not full_text:
        return tables
    return tables | {name: stage(rows, name) for name, rows in B.statistics(tables).items()}


_LINEAR = TURNS.replace("CASE WHEN ordinal = 3 THEN session_id || ':0' ELSE parent_id END", "parent_id")
_CHUNKS_SQL = f"""{_LINEAR}, of AS (SELECT f.session_id, f.user_entry_id, f.leaf_id, f.variant_hash, f.ids, u.i, e.entry_id, e.role, e.text, e.ordinal FROM firsts f, LATERAL (SELECT unnest(range(1, len(f.ids) + 1)) AS i) u JOIN forked e ON e.session_id = f.session_id AND e.entry_id = f.ids[u.i]),
texts AS (SELECT session_id, user_entry_id, variant_hash, min(leaf_id) AS leaf_id, arg_max(entry_id, i) AS end_entry_id, min(ordinal) * 1000 AS start_ts, max(ordinal) * 1000 AS last_ts,
  coalesce(arg_max(text, i) FILTER (role = 'user'), '') AS u, coalesce(string_agg(text, chr(10) ORDER BY i) FILTER (role = 'assistant' AND text <> ''), '') AS a FROM of GROUP BY ALL),
masked AS (SELECT *, {_sql_redacted("u")} AS um, {_sql_redacted("a")} AS am FROM texts),
chunks AS (SELECT substr(sha256('conversations|' || session_id || '|' || user_entry_id || '|' || variant_hash), 1, 32) AS chunk_id, 'conversations' AS project_id, session_id, user_entry_id, leaf_id AS branch_leaf_id, variant_hash, user_entry_id AS start_entry_id, end_entry_id,
  CAST(start_ts AS BIGINT) AS start_ts, CAST(CASE WHEN last_ts <> 0 THEN last_ts ELSE start_ts END AS BIGINT) AS end_ts, 'complete' AS status, CASE WHEN length(um) > 8000 THEN substr(um, 1, 8000) || '…' ELSE um END AS user_text,
  CASE WHEN length(am) > 12000 THEN substr(am, 1, 12000) || '…' ELSE am END AS assistant_text, CAST(0 AS INTEGER) AS tool_call_count, CAST(0 AS INTEGER) AS paired_result_count, '' AS evidence_text FROM masked)"""


@query(f"WITH RECURSIVE {_CHUNKS_SQL} SELECT * FROM chunks")
def index_chunks(spark, sf_dir):
    return conversation_index(spark, sf_dir)["chunks"].drop("raw_entry_ids")


@query(f"WITH RECURSIVE {_CHUNKS_SQL} SELECT chunk_id, session_id, status, user_text, assistant_text, CAST(0 AS INTEGER) AS n_steps FROM chunks WHERE chunk_id = (SELECT min(chunk_id) FROM chunks)")
def chunk_detail(spark, sf_dir):
    index = conversation_index(spark, sf_dir, full_text=False)
    one = index["chunks"].agg(F.min("chunk_id")).first()[0]
    found = Q.chunk_detail(index, one or "", PROJECT.project_id)
    return found.select("chunk_id", "session_id", "status", "user_text", "assistant_text", F.coalesce(F.size("trace_steps"), F.lit(0)).alias("n_steps"))


@query()
def history_search(spark, sf_dir):
    """Four queries at once over the conversations' index: chunk, place and scores."""
    asked = {"en": "the onen tion ering", "de": "schein enber Die", "fr": "eaux leré Que", "es": "ciónes Los"}
    found = Q.search(conversation_index(spark, sf_dir), asked, Q.Options(now_ms=10_000, max_results=20), PROJECT.project_id)
    return found.select("qid", "place", "chunk_id", "relevance", "confidence", "freshness", "user_text")
