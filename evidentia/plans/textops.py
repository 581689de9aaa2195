"""Bounded fields, redaction, normal forms and payload queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import text as tx
from evidentia.functions import values as V
from evidentia.operators import jsontext as js
from evidentia.plans import sqltext as S
from evidentia.plans.derive import spread
from evidentia.plans.registry import query
from evidentia.session import table


def _docs(spark, sf):
    return spread(table(spark, sf, "documents"))


def _turns(spark, sf):
    return table(spark, sf, "conversations")


def q(p):
    return p.replace("'", "''")


# -------------------------------------------------------------- bounded fields
@query("prj_bounded_list", """SELECT conv_id, turn, array_to_string(list_filter(list_transform(
  string_split(text, chr(10)), lambda x: left(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), 64)), lambda x: x <> '')[1:10], '~') AS items FROM conversations""")
def prj_bounded_list(spark, sf):
    items = tx.bounded_list(F.split("text", "\n"), 64, 10)
    return _turns(spark, sf).select("conv_id", "turn", F.array_join(items, "~").alias("items"))


_RED = f"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({{0}},
  '{q(tx.BEARER)}', '<redacted>', 'g'), '{q(tx.API_KEY)}', '<redacted>', 'g'), '{q(tx.SECRET_ASSIGNMENT)}', '\\1=<redacted>', 'g'),
  '{q(tx.URL)}', '<url>', 'g'), '{q(tx.ENV_FILE)}', '/<redacted-env>', 'g'), '{q(tx.LOCAL_PATH)}', '<path>', 'g')"""


def _red(col):
    return _RED.replace("{0}", col)


_BOUNDED = f"""WITH r AS (SELECT conv_id, list(text ORDER BY turn) AS ts FROM conversations GROUP BY 1),
e AS (SELECT conv_id, {_red("ts[1]")} AS s, len(ts) - 1 AS n, list_transform(ts[2:4], lambda t: {_red("('case ' || t)")}) AS a,
  list_transform(ts[2:4], lambda t: {_red("t")}) AS b, list_transform(ts[2:4], lambda t: {_red("(t || ' fix')")}) AS c FROM r),
f AS (SELECT *, list_filter(list_concat([CASE WHEN length(s) > 400 THEN 'summary' END, CASE WHEN n > 3 THEN 'candidates' END],
  flatten(list_transform(range(0, len(b)), lambda i: [CASE WHEN length(a[i + 1]) > 200 THEN 'candidates[' || i || '].title' END,
    CASE WHEN length(b[i + 1]) > 600 THEN 'candidates[' || i || '].description' END,
    CASE WHEN length(c[i + 1]) > 600 THEN 'candidates[' || i || '].recommended_fix' END]))), lambda x: x IS NOT NULL) AS cut FROM e)
SELECT conv_id, md5(left(s, 400)) AS summary, md5(array_to_string(list_transform(range(1, len(b) + 1),
    lambda i: left(a[i], 200) || '|' || left(b[i], 600) || '|' || left(c[i], 600)), '~')) AS candidates, array_to_string(cut, ' ') AS truncated_fields,
  len(cut) > 0 AS truncated, len(cut) = 0 AND (trim(s) <> '' OR len(b) > 0) AS evaluation_ready FROM f"""


@query("prj_bounded_evidence", _BOUNDED)
def prj_bounded_evidence(spark, sf):
    turns = _turns(spark, sf).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("ts"))
    texts = F.transform("ts", lambda t: t["text"])
    given = F.transform(F.slice(texts, 2, 1_000_000), lambda t: F.struct(
        F.concat(F.lit("case "), t).alias("title"), t.alias("description"), F.concat(t, F.lit(" fix")).alias("recommended_fix")))
    bounded = turns.select("conv_id", tx.bounded_evidence(F.get(texts, F.lit(0)), given).alias("e")).select("conv_id", "e.*")
    shown = F.transform("candidates", lambda c: F.concat_ws("|", c["title"], c["description"], c["recommended_fix"]))
    return bounded.select(
        "conv_id", F.md5(F.coalesce("summary", F.lit(""))).alias("summary"), F.md5(F.array_join(shown, "~")).alias("candidates"),
        F.array_join("truncated_fields", " ").alias("truncated_fields"), "truncated", "evaluation_ready")


@query("prj_output_tail", f"""WITH r AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(repeat(text || chr(10), 12),
  '{q(tx.BEARER)}', 'Bearer <redacted>', 'g'), '{q(tx.LOG_SECRET)}', '\\1\\2<redacted>', 'g'), '{q(tx.LOG_PATH)}', '<path>', 'g') AS t FROM documents),
l AS (SELECT doc_id, {S.lines('t')} AS ls FROM r)
SELECT doc_id, md5(right(array_to_string(ls[greatest(len(ls) - 99, 1):], chr(10)), 4096)) AS digest FROM l""")
def prj_output_tail(spark, sf):
    long = F.repeat(F.concat("text", F.lit("\n")), 12)
    return _docs(spark, sf).select("doc_id", F.md5(tx.output_tail(long)).alias("digest"))


@query("prj_trace_summary", """WITH e AS (SELECT event_id, repeat(event_type || ':' || props || ' ', (event_id % 40)::INT) AS t FROM events)
SELECT event_id, CASE WHEN length(t) > 200 THEN left(t, 197) || '...' ELSE t END AS param, CASE WHEN length(t) > 500 THEN left(t, 497) || '...' ELSE t END AS summary FROM e""")
def prj_trace_summary(spark, sf):
    t = F.expr("repeat(concat(event_type, ':', props, ' '), cast(event_id % 40 as int))")
    return table(spark, sf, "events").select(
        "event_id", F.transform_values(F.create_map(F.lit("q"), t), lambda _k, v: tx.shorten(v))["q"].alias("param"),
        tx.shorten(t, 500).alias("summary"))


@query("flt_input_bounds", """SELECT doc_id, array_to_string(list_filter([
  CASE WHEN length(trim(text)) NOT BETWEEN 10 AND 2000 THEN 'issue_description length must be 10-2000, got ' || length(trim(text)) END,
  CASE WHEN length(text) > 10000 THEN 'error_log too long: ' || length(text) || ' > 10000' END], lambda x: x IS NOT NULL), '; ') AS errors FROM documents""")
def flt_input_bounds(spark, sf):
    n, log = F.length(F.trim("text")), F.length("text")
    errors = F.array_compact(F.array(
        F.when(~n.between(10, 2000), F.concat(F.lit("issue_description length must be 10-2000, got "), n.cast("string"))),
        F.when(log > 10000, F.concat(F.lit("error_log too long: "), log.cast("string"), F.lit(" > 10000")))))
    return _docs(spark, sf).select("doc_id", F.array_join(errors, "; ").alias("errors"))


@query("flt_shell_guard", "SELECT conv_id, turn, " + " OR ".join(
    f"contains(lower(text), {S.quoted(t)})" for t in [*tx.SHELL_WORDS[:1], *tx.SHELL_WORDS[2:]]) + r" OR contains(lower(text), 'mvn' || chr(9)) AS asks FROM conversations")
def flt_shell_guard(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", tx.asks_for_shell(F.col("text")).alias("asks"))


_CAT = ", ".join(f"{S.quoted(k)}: {S.quoted(v)}" for k, v in V.CATEGORY_ALIASES.items())
_CAT_IN = ["Config", "transactions ", "Bean-Resolution", "bean resolution ambiguity", "unknown Thing"]


@query("fn_category", f"""WITH c AS (SELECT event_id, replace(replace(lower(trim(({_CAT_IN})[event_id % 5 + 1] || CASE WHEN event_id % 3 = 0 THEN '' ELSE ' ' END)), '-', '_'), ' ', '_') AS c FROM events)
SELECT event_id, coalesce(map_extract(MAP {{{_CAT}}}, c)[1], c) AS category FROM c""")
def fn_category(spark, sf):
    raw = F.element_at(F.array(*[F.lit(c) for c in _CAT_IN]), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", tx.category(F.concat(raw, F.lit(" "))).alias("category"))


# ------------------------------------------------------------------- redaction
_SECRETS = """text || chr(10) || 'API key: abc' || doc_id || ', Bearer abcdefgh' || doc_id || ' at C:\\work\\' || doc_id || '; see https://x.test/' || doc_id || ' in /home/u/' || doc_id"""


def _secrets():
    i = F.col("doc_id").cast("string")
    return F.concat("text", F.lit("\nAPI key: abc"), i, F.lit(", Bearer abcdefgh"), i, F.lit(" at C:\\work\\"), i,
                    F.lit("; see https://x.test/"), i, F.lit(" in /home/u/"), i)


@query("fn_redact_artifact", f"SELECT doc_id, md5({_red('t')}) AS digest FROM (SELECT doc_id, {_SECRETS} AS t FROM documents)")
def fn_redact_artifact(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(tx.redact_artifact(_secrets())).alias("digest"))


@query("fn_redact_log", f"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(t, '{q(tx.BEARER)}', 'Bearer <redacted>', 'g'),
  '{q(tx.LOG_SECRET)}', '\\1\\2<redacted>', 'g'), '{q(tx.LOG_PATH)}', '<path>', 'g')) AS digest FROM (SELECT doc_id, {_SECRETS} AS t FROM documents)""")
def fn_redact_log(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(tx.redact_log(_secrets())).alias("digest"))


@query("fn_redact_path", r"""SELECT doc_id, md5(regexp_replace(t, '([A-Za-z]:[\\/]|\B/|^/)[^\s,;)}\]]+', '<absolute-path-redacted>', 'g')) AS digest,
  CASE WHEN doc_id % 3 = 0 THEN '<absolute-path-redacted>' ELSE 'src/' || doc_id END AS file
FROM (SELECT doc_id, 'see C:\a\' || doc_id || ' and /opt/x/' || doc_id || ', src/main/' || doc_id || ' ' || regexp_replace(text, '[^A-Za-z0-9 \n]', '', 'g') AS t FROM documents)""")
def fn_redact_path(spark, sf):
    i = F.col("doc_id").cast("string")
    t = F.concat(F.lit("see C:\\a\\"), i, F.lit(" and /opt/x/"), i, F.lit(", src/main/"), i, F.lit(" "),
                 tx.only(F.col("text"), "A-Za-z0-9 \n"))
    f = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("D:\\"), i)).otherwise(F.concat(F.lit("src\\"), i))
    return _docs(spark, sf).select("doc_id", F.md5(tx.redact_paths(t)).alias("digest"), tx.safe_evidence_file(f).alias("file"))


@query("fn_redact_nested", f"""WITH p AS (SELECT doc_id, {_red('t')} AS r FROM (SELECT doc_id, {_SECRETS} AS t FROM documents))
SELECT doc_id, md5(r || '|' || r || '|' || r) AS digest FROM p""")
def fn_redact_nested(spark, sf):
    rec = F.struct(F.array(F.struct(_secrets().alias("text"), F.col("doc_id"))).alias("items"),
                   F.create_map(F.lit("k"), F.array(_secrets())).alias("by_key"), _secrets().alias("summary"))
    df = _docs(spark, sf).select("doc_id", rec.alias("rec"))
    safe = tx.redact_nested(F.col("rec"), df.schema["rec"].dataType)
    df = df.select("doc_id", safe.alias("s"))
    return df.select("doc_id", F.md5(F.concat_ws("|", F.col("s.items")[0]["text"], F.col("s.by_key")["k"][0], F.col("s.summary"))).alias("digest"))


# ----------------------------------------------------------- semantic normal forms
_SUFFIX = " Properties\\\\requires WebhookSender, doesn''t match values; XMLParser overrides binding. It can''t bind"
_SEM = "text || '" + _SUFFIX.replace("\\\\", "\\") + "'"


def _sem():
    return F.concat("text", F.lit(" Properties\\requires WebhookSender, doesn't match values; XMLParser overrides binding. It can't bind"))


def _v20(col):
    return f"trim(regexp_replace(replace(lower({col}), '\\', '/'), '\\s+', ' ', 'g'))"


def _sem_words(col, table_):
    camel = f"regexp_replace(regexp_replace(replace({col}, '\\', '/'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"
    m = ", ".join(f"{S.quoted(k)}: {S.quoted(v)}" for k, v in table_.items())
    return (f"array_to_string(list_transform(list_filter(string_split(regexp_replace(lower({camel}), '[^\\pL\\pM\\pN_]+', ' ', 'g'), ' '), "
            f"lambda t: t <> ''), lambda t: coalesce(map_extract(MAP {{{m}}}, t)[1], t)), ' ')")


def _v21(col):
    return _sem_words(col, V.MORPHOLOGY_V21)


def _v22(col):
    opened = f"regexp_replace(regexp_replace({col}, 'doesn[''’]t', 'does not', 'g'), 'can[''’]t', 'cannot', 'g')"
    return _sem_words(opened, V.MORPHOLOGY_V22)


def _norm_query(version, form):
    sql = f"SELECT doc_id, md5({form('t')}) AS digest FROM (SELECT doc_id, {_SEM} AS t FROM documents)"

    @query(f"fn_sem_norm_{version}", sql)
    def run(spark, sf):
        return _docs(spark, sf).select("doc_id", F.md5(tx.NORMAL_FORMS[version](_sem())).alias("digest"))

    return run


fn_sem_norm_v20 = _norm_query("v20", _v20)
fn_sem_norm_v21 = _norm_query("v21", _v21)
fn_sem_norm_v22 = _norm_query("v22", _v22)

_CLAUSES = f"""WITH c AS (SELECT doc_id, list_filter(list_transform(string_split_regex(
    regexp_replace(t, '([.!?])\\s+', '\\1' || chr(10), 'g'), '[;\\n]+'), lambda x: {_v22('x')}), lambda x: x <> '') AS cs
  FROM (SELECT doc_id, {_SEM} AS t FROM documents)),
flat AS (SELECT doc_id, unnest(cs) AS clause, generate_subscripts(cs, 1) AS clause_no FROM c)"""


def _clause_rows(spark, sf):
    c = _docs(spark, sf).select("doc_id", F.posexplode(tx.clauses(_sem(), "v22")).alias("_p", "clause"))
    return c.select("doc_id", (F.col("_p") + 1).cast("bigint").alias("clause_no"), "clause")


@query("fn_clauses", _CLAUSES + " SELECT doc_id, clause_no, clause FROM flat")
def fn_clauses(spark, sf):
    return _clause_rows(spark, sf)


@query("win_clause_context", _CLAUSES + """ SELECT doc_id, clause_no, md5(concat_ws(' ', lag(clause) OVER w, clause, lead(clause) OVER w)) AS context
FROM flat WINDOW w AS (PARTITION BY doc_id ORDER BY clause_no)""")
def win_clause_context(spark, sf):
    from evidentia.operators.semantic import clause_windows

    all_clauses = _docs(spark, sf).select("doc_id", tx.clauses(_sem(), "v22").alias("cs"))
    return all_clauses.select("doc_id", F.posexplode(clause_windows(F.col("cs"))).alias("_p", "w")).select(
        "doc_id", (F.col("_p") + 1).cast("bigint").alias("clause_no"), F.md5("w").alias("context"))


# -------------------------------------------------------------------- numbers, JSON
@query("fn_ratio", """SELECT l_returnflag, round(count(*) FILTER (l_quantity > 25) / count(*), 4) AS big_rate,
  CASE WHEN count(*) FILTER (l_quantity > 1000) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS none_rate,
  sum(CASE WHEN l_linenumber > 3 THEN l_linenumber END) AS known_sum, NULL::BIGINT AS all_sum FROM lineitem GROUP BY 1""")
def fn_ratio(spark, sf):
    some = F.when(F.col("l_linenumber") > 3, F.col("l_linenumber").cast("bigint"))
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        tx.ratio(F.count_if(F.col("l_quantity") > 25), F.count(F.lit(1))).alias("big_rate"),
        tx.ratio(F.lit(1), F.count_if(F.col("l_quantity") > 1000)).alias("none_rate"),
        tx.sum_known(some).alias("known_sum"), tx.sum_if_all_known(some).alias("all_sum"))


_JSON_TEXT = """CASE event_id % 6 WHEN 0 THEN 'Here: ```json ' || props || ' ``` done' WHEN 1 THEN 'answer ' || props || ' end' WHEN 2 THEN ''
  WHEN 3 THEN '{"k": ' WHEN 4 THEN '{"other": ' || event_id || '}' ELSE '[1, 2]' END"""


@query("fn_json_blob", f"""WITH t AS (SELECT event_id, props, {_JSON_TEXT} AS t FROM events)
SELECT event_id, CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN props WHEN 3 THEN '{{"k":' ELSE t END AS blob,
  ['ok', 'ok', 'empty_response', 'invalid_json', 'schema_validation_failure', 'structured_parse_failure'][event_id % 6 + 1] AS verdict FROM t""")
def fn_json_blob(spark, sf):
    i, m = F.col("event_id"), F.col("event_id") % 6
    t = (F.when(m == 0, F.concat(F.lit("Here: ```json "), "props", F.lit(" ``` done")))
         .when(m == 1, F.concat(F.lit("answer "), "props", F.lit(" end"))).when(m == 2, "").when(m == 3, '{"k": ')
         .when(m == 4, F.concat(F.lit('{"other": '), i.cast("string"), F.lit("}"))).otherwise("[1, 2]"))
    return table(spark, sf, "events").select("event_id", js.json_blob(t).alias("blob"), js.json_verdict(t, "k bigint", ["k"]).alias("verdict"))


_NAMES = ["MaxRetriesExceeded", "RetryableError", "SchemaValidationError", "SchemaValidationError", "ValueError", "AuthError", "SchemaValidationError"]
_MSGS = ["gave up", "Timeout after 3", "invalid JSON: x", "empty response", "boom", "denied", "schema mismatch: y"]
_CATS = ["", "provider_timeout", "invalid_json", "empty_response", "internal_error", "provider_failure", "schema_validation_failure"]


@query("fn_error_class", f"""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN CASE WHEN event_type = 'error' THEN 'provider_timeout' ELSE 'provider_failure' END
    ELSE ({_CATS})[event_id % 7 + 1] END AS category,
  CASE ([200, 401, 403, 429, 500, 599, 404])[user_id % 7 + 1] WHEN 401 THEN 'auth' WHEN 403 THEN 'auth' WHEN 429 THEN 'transient' WHEN 500 THEN 'transient'
    WHEN 599 THEN 'transient' ELSE 'unknown_transient' END AS http_class FROM events""")
def fn_error_class(spark, sf):
    def pick(xs, i):
        return F.element_at(F.array(*[F.lit(x) for x in xs]), (i + 1).cast("int"))

    i = F.col("event_id") % 7
    cause = F.when(F.col("event_type") == "error", "read TIMEOUT")
    return table(spark, sf, "events").select(
        "event_id", js.failure_category(pick(_NAMES, i), pick(_MSGS, i), cause).alias("category"),
        js.http_error_class(pick([200, 401, 403, 429, 500, 599, 404], F.col("user_id") % 7), F.col("event_type")).alias("http_class"))


@query("fn_payload", """SELECT event_id, '{"duration_ms":' || event_id % 100 || ',"node":"' || event_type || '","props":"' || replace(props, '"', '\\"') || '"}' AS payload,
  event_id % 100 AS duration_ms, json_extract_string(props, '$.k')::BIGINT AS k, event_type AS node FROM events""")
def fn_payload(spark, sf):
    body = F.to_json(F.struct((F.col("event_id") % 100).alias("duration_ms"), F.col("event_type").alias("node"), "props"))
    e = table(spark, sf, "events").select("event_id", body.alias("payload"), "props")
    return e.select("event_id", "payload", js.payload_int(F.col("payload"), "duration_ms").alias("duration_ms"),
                    js.payload_int(F.col("props"), "k").alias("k"), js.payload_text(F.col("payload"), "node").alias("node"))


@query("fn_timestamps", """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS iso, strftime(ts + INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS shifted,
  strftime(ts, '%Y%m%dT%H%M%SZ') || '-' || left(md5(event_id::VARCHAR), 8) AS run_id FROM events""")
def fn_timestamps(spark, sf):
    ts = F.col("ts").cast("timestamp")
    zoned = F.regexp_replace(js.iso_utc(ts), r"\+00:00\z", "-02:00")
    return table(spark, sf, "events").select(
        "event_id", js.iso_utc(ts).alias("iso"), js.iso_utc(js.parse_iso(zoned)).alias("shifted"),
        js.run_id(ts, F.md5(F.col("event_id").cast("string"))).alias("run_id"))
