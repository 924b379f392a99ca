"""Relations that the registered queries derive from the given tables, in Spark and in SQL.

The tables hold hardly any script code, so each page contributes one script unit: a snippet
chosen by its id, followed by the page's own inline script. The relation grows with `pages`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# (text, repetitions)
SNIPPETS: tuple[tuple[str, int], ...] = (
    # readable code
    ("function addTotals(items) {\n  const total = items.length;\n  let sum = 0;\n"
     "  for (const item of items) {\n    if (item.price) {\n      sum += item.price;\n    }\n"
     "  }\n  return sum / total;\n}\n", 1),
    # dense code with a single line break
    ("var a=1;var b=2;var c=3;var d=4;var e=5;var f=6;var g=7;\n"
     "function h(i){return i+a;};function j(k){return k*b;};x=function y(){return c;};a=b;b=c;", 1),
    # one-letter names
    ("function f(a,b,c){for(var i=0;i<a;i++){b[i]=c(i,b,a)}return b}", 1),
    # escapes and eval
    (r'var s="\x41\x42C";eval(s);var t = "a" + "b" + ' + "'c';", 1),
    # long lines
    ("var " + ",".join(f"longVariableName{i}={i}" for i in range(60)) + ";", 1),
    # brace depth 6 and 11
    ("{" * 6 + "x();" + "}" * 6, 1),
    ("if(a)" + "{if(b)" * 11 + "{}" + "}" * 11, 1),
    # typed dialect
    ("interface Shape { area: number; name?: string; }\nenum Color { Red, Green }\n"
     "type Pair = [number, number];\nfunction area(s: Shape): number { return s.area; }\n", 1),
    ("class Box { private size = 1; public grow(by: number | string) { this.size += 1; } }", 1),
    # markup
    ("const App = () => {\n  return <div className=\"app\" onClick={go}>Hello</div>;\n};\n"
     "import React from 'react';\n", 1),
    ("<!-- page --><p>text</p>", 1),
    # dependencies
    ("const fs = require('fs');\nconst path = require(\"path\");\nimport x from 'lodash';\n"
     "import { y } from \"./local\";\nvar z = require(`fs`);\n", 1),
    # framework words
    ("$(document).ready(function(){ jQuery('a').hide(); });\nnew Vue({el:'#app'});\n"
     "angular.module('m');\n__webpack_require__(1);", 1),
    # minifier idioms
    ("if (x === void 0) { y = 1e3; }\nif (5 < x) z = !!x;\nif (null == y || x === true) "
     "{ q = y == false; }\nvar big = 2.5e10;", 1),
    # properties, keys, methods, strings and comments that share a renamed name
    ("var val = obj.val; // val stays here\nvar o = { val: val, key: cond ? val : other };\n"
     "class K { val(a) { return this.val + val; } }\ncall(...val); /* val */ log('val', \"val\");\n", 1),
    # rename chain and reserved targets
    ("var alpha = beta + gamma; beta = alpha; gamma(alpha, beta); data$ = $data;", 1),
    # constant conditions and dead code
    ("if (true) { run(); } if ( false ) { stop(); } ok = a ? true : false; no = b ? false : true;\n"
     "function r() { return 1; more(); }\nfunction s() {\n  return 2;\n  never();\n}\n", 1),
    # words that look like names
    ("var été = naïve + cafe; éval(1); 1abc; a$b = $c; 1$d = e$; _x1 = __proto__;", 1),
    # many functions, many lines, many branches
    ("function fn(x) { return x }\n", 25),
    ("const g = () => {};\n", 60),
    ("a += 1;\n", 320),
    ("b += 1;\n", 1100),
    ("if (x) { y(); } else while (z) { w(); } ", 30),
    # a broken escape and a regular expression
    (r"var re = /\day\w+/g; var ok = '\x4a'; var s = '\bold';", 1),
    # long unit without and with boundaries
    ("abcdefghij", 10_100),
    ("call(argument, 12); { block(); }\n", 3_200),
    # empty and blank units
    ("", 1),
    (" \t \n  \n ", 1),
)
EXTENSIONS = ("js", "js", "mjs", "ts", "JS", "cjs", "jsx", "tsx", "txt", "js")
FOLDERS = ("src", "src/lib", "node_modules/pkg", "lib/node_modules/pkg", "dist", "app/pages", "src")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pick(options: list[Column], index: Column) -> Column:
    return F.element_at(F.array(*options), (index % len(options) + 1).cast("int"))


def pick_sql(options: list[str], index: str) -> str:
    return f"list_extract([{', '.join(options)}], ({index} % {len(options)}) + 1)"


def inline_scripts(html: Column) -> Column:
    """All scripts of a page, one below the other."""
    return F.array_join(F.regexp_extract_all(html, F.lit("(?s)<script>(.*?)</script>"), F.lit(1)), "\n")


def _repeat(text: str, n: int) -> Column:
    return F.lit(text) if n == 1 else F.repeat(F.lit(text), F.lit(n))


def _repeat_sql(text: str, n: int) -> str:
    return sql_text(text) if n == 1 else f"repeat({sql_text(text)}, {n})"


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unit per page with a snippet and all scripts of the page, and for every fifth page
    one more with a snippet alone, which keeps edge cases such as the empty unit."""
    pid = F.col("page_id")
    snippet = pick([_repeat(t, n) for t, n in SNIPPETS], pid)
    both = F.struct(F.lit("script/").alias("name"), F.concat(
        snippet, F.lit("\n"), inline_scripts(F.col("html"))).alias("code"))
    alone = F.struct(F.lit("snippet/").alias("name"), snippet.alias("code"))
    path = F.concat(
        F.lit("site"), (pid % 3).cast("string"), F.lit("/"),
        pick([F.lit(x) for x in FOLDERS], pid), F.when(F.col("u.name") == "script/", "/f").otherwise("/s"),
        (pid % 1000).cast("string"), F.lit("."), pick([F.lit(x) for x in EXTENSIONS], pid),
    )
    rows = table(spark, sf_dir, "pages").select(
        pid,
        F.explode(F.when(pid % 5 == 0, F.array(both, alone)).otherwise(F.array(both))).alias("u"))
    return rows.select(
        F.concat("u.name", pid.cast("string")).alias("unit_id"), path.alias("path"),
        F.lit("script").alias("kind"), "u.code", "page_id",
    )


SCRIPTS_SQL = f"""
scripts AS (
  SELECT name || page_id AS unit_id,
         'site' || (page_id % 3) || '/' || {pick_sql([sql_text(x) for x in FOLDERS], 'page_id')}
           || CASE name WHEN 'script/' THEN '/f' ELSE '/s' END || (page_id % 1000) || '.'
           || {pick_sql([sql_text(x) for x in EXTENSIONS], 'page_id')} AS path,
         'script' AS kind,
         CASE WHEN name = 'snippet/' THEN snippet ELSE snippet || chr(10)
              || array_to_string(regexp_extract_all(html, '(?s)<script>(.*?)</script>', 1), chr(10)) END AS code,
         page_id
  FROM (SELECT page_id, html, unnest(CASE WHEN page_id % 5 = 0 THEN ['script/', 'snippet/'] ELSE ['script/'] END) AS name,
               {pick_sql([_repeat_sql(t, n) for t, n in SNIPPETS], 'page_id')} AS snippet
        FROM pages))"""


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, all pages and all scripts as units."""
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("document/"), F.col("doc_id").cast("string")).alias("unit_id"),
        F.concat_ws("/", "source", "lang",
                    F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"),
        F.lit("document").alias("kind"), F.col("text").alias("code"),
    )
    pages = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("unit_id"),
        F.col("url").alias("path"), F.lit("page").alias("kind"), F.col("html").alias("code"),
    )
    return docs.unionByName(pages).unionByName(scripts(spark, sf_dir).drop("page_id"))


UNITS_SQL = SCRIPTS_SQL + """,
units AS (
  SELECT 'document/' || doc_id AS unit_id, source || '/' || lang || '/' || doc_id || '.txt' AS path,
         'document' AS kind, text AS code FROM documents
  UNION ALL SELECT 'page/' || page_id, url, 'page', html FROM pages
  UNION ALL SELECT unit_id, path, kind, code FROM scripts)"""


def reworked(units_df: DataFrame) -> DataFrame:
    """A second version of each unit: one statement per line, some units re-indented only."""
    code = F.col("code")
    spaced = F.replace(F.replace(code, F.lit(";"), F.lit(";\n")), F.lit("{"), F.lit("{\n"))
    return units_df.withColumn(
        "code",
        F.when(F.length(code) % 3 == 0, spaced)
        .when(F.length(code) % 3 == 1, F.concat(F.lit("  "), F.replace(code, F.lit("\n"), F.lit("\n  "))))
        .otherwise(code),
    )


REWORKED_SQL = """
reworked AS (
  SELECT unit_id, CASE length(code) % 3
    WHEN 0 THEN replace(replace(code, ';', ';' || chr(10)), '{', '{' || chr(10))
    WHEN 1 THEN '  ' || replace(code, chr(10), chr(10) || '  ')
    ELSE code END AS code FROM units)"""


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rename suggestions from events: few names per user, many suggestions per name."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("unit_id"),
        (e % 4).alias("chunk_index"), e.alias("ordinal"),
        F.concat(F.lit("v"), (e % 20).cast("string")).alias("original_name"),
        F.concat(F.col("event_type"), F.lit("Value"), (e % 7).cast("string")).alias("suggested_name"),
        (F.floor(F.col("value") * 100) % 101 / F.lit(100.0)).alias("confidence"),
        F.lit("").alias("reasoning"), F.lit("variable").alias("type"),
    )


SUGGESTIONS_SQL = """
suggestions AS (
  SELECT user_id::VARCHAR AS unit_id, event_id % 4 AS chunk_index, event_id AS ordinal,
         'v' || (event_id % 20) AS original_name,
         event_type || 'Value' || (event_id % 7) AS suggested_name,
         (floor(value * 100)::BIGINT % 101) / 100.0::DOUBLE AS confidence,
         '' AS reasoning, 'variable' AS type
  FROM events)"""

# Renames offered to each script: original, target, with repeated names and reserved targets.
RENAME_OFFERS = (
    ("val", "amount"), ("alpha", "gamma"), ("beta", "delta"), ("gamma", "beta"),
    ("obj", "record"), ("items", "class"), ("a", "first"), ("b", "default"),
    ("total", "count$1"), ("data$", "cash"), ("$data", "source"), ("val", "money"),
    ("t", "label"), ("track", "trace"), ("sum", r"acc\u"), ("x1", "one"), ("other", "rest"),
)


def renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions for scripts, not all for each."""
    offers = F.array(*[
        F.struct(F.lit(i).cast("long").alias("ordinal"), F.lit(o).alias("original_name"),
                 F.lit(n).alias("suggested_name"))
        for i, (o, n) in enumerate(RENAME_OFFERS)
    ])
    return scripts(spark, sf_dir).select(
        "unit_id", "page_id", F.inline(offers)
    ).filter((F.col("page_id") + F.col("ordinal")) % 4 != 0).select(
        "unit_id", (F.col("ordinal") % 3).alias("chunk_index"), "ordinal",
        "original_name", "suggested_name",
        (((F.col("page_id") + F.col("ordinal") * 7) % 11) / F.lit(10.0)).alias("confidence"),
        F.lit("").alias("reasoning"), F.lit("variable").alias("type"),
    )


RENAMES_SQL = f"""
offers(ordinal, original_name, suggested_name) AS (
  VALUES {', '.join(f"({i}::BIGINT, {sql_text(o)}, {sql_text(n)})"
                    for i, (o, n) in enumerate(RENAME_OFFERS))}),
renames AS (
  SELECT unit_id, ordinal % 3 AS chunk_index, ordinal, original_name, suggested_name,
         ((page_id + ordinal * 7) % 11) / 10.0::DOUBLE AS confidence, '' AS reasoning, 'variable' AS type
  FROM scripts, offers WHERE (page_id + ordinal) % 4 <> 0)"""

BEST_RENAMES_SQL = """
best AS (
  SELECT unit_id, original_name, suggested_name FROM (
    SELECT *, row_number() OVER (PARTITION BY unit_id, original_name
                                 ORDER BY confidence DESC, chunk_index, ordinal) AS rn FROM renames)
  WHERE rn = 1)"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers of many shapes, one per event; numbers and names come from the event."""
    e, v, k = F.col("event_id"), F.col("value"), F.col("event_type")
    num = v.cast("string")
    ident = e.cast("string")

    def text(template: str) -> Column:
        out = F.lit(template)
        for mark, col in (("@id", ident), ("@num", num), ("@kind", k)):
            out = F.replace(out, F.lit(mark), col)
        return out

    payload = pick([text(t) for t in ANSWERS], e)
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("r"), ident).alias("request_id"), payload.alias("payload"))


ANSWERS = (
    '[{"name":"a@id","newName":"userData","confidence":0.9,"reasoning":"Stores @kind","type":"variable"}]',
    '{"suggestions":[{"originalName":"b@id","suggestedName":"handle@kind","confidence":0.8,"reason":"Handles","type":"FUNCTION"}]}',
    'Some text before [{"name":"temp","newName":"temperature@id","confidence":0.95}] some text after',
    '{"renames":[{"from":"c","to":"varC@id","confidence":1.5},{"from":"d","to":"varD","confidence":-0.5},{"from":"e","to":"varE","confidence":"high"}]}',
    'Here you are: {"variablesAndFunctionsToRename":[{"name":"f","newName":"g@id","type":"Class"}]} done [1]',
    "no json at all, event @id",
    '{"other":[{"name":"x","newName":"y@id"}]}',
    '["bad item",{"name":"ok@id","newName":"fine"},{"confidence":0.8},{"name":"","originalName":"h","newName":"i@id"}]',
    '{"suggestions":[{"name":"j","newName":5},{"name":"k","newName":"l@id","type":"invalid-type","confidence":@num}]}',
    'rename old@id to new@kind, then p@id -> q and r => s@id. Rename X to Y',
    '{"suggestions":[]}',
    'null',
    '@id',
    '{"suggestions":[{"name":"m","newName":"n@id","confidence":1},],"note":"trailing"},]',
    '[{"name":["a","b","c@id"],"newName":["x","y"]}]',
    'u1->w1 u2->w2 u3->w3 u4->w4 u5->w5 u6->w6 u7->w7 u8->w8 u9->w9 u10->w10 u11->w11 u12->w12 '
    'u13->w13 u14->w14 u15->w15 u16->w16 u17->w17 u18->w18 u19->w19 u20->w20 u21->w21 u22 => w@id',
)


def _answer_sql(template: str) -> str:
    out = sql_text(template)
    for mark, col in (("@id", "event_id::VARCHAR"), ("@num", "value::VARCHAR"), ("@kind", "event_type")):
        out = f"replace({out}, '{mark}', {col})"
    return out


RESPONSES_SQL = f"""
responses AS (
  SELECT 'r' || event_id AS request_id, {pick_sql([_answer_sql(t) for t in ANSWERS], 'event_id')}
           AS payload FROM events)"""

NOW = "2024-01-02 01:00:00"
CREATED = "2024-01-01 00:00:00"


def cache_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache entry per document, repeated texts under one key included."""
    created = F.timestamp_micros(
        F.lit(1_704_067_200_000_000) + F.col("doc_id") * F.lit(60_000_000))
    return table(spark, sf_dir, "documents").select(
        F.left(F.sha2("text", 256), F.lit(32)).alias("key"), F.col("text").alias("payload"),
        created.alias("created_at"),
        (created + F.expr("INTERVAL 24 HOURS")).alias("expires_at"),
        (F.col("n_chars") * 2).alias("size"),
    )


def now() -> Column:
    """`NOW` as an instant, whatever the zone of the session."""
    return F.timestamp_micros(F.lit(1_704_157_200_000_000))


ENTRIES_SQL = f"""
entries AS (
  SELECT left(sha256(text), 32) AS key, text AS payload,
         TIMESTAMP '{CREATED}' + to_minutes(doc_id) AS created_at,
         TIMESTAMP '{CREATED}' + to_minutes(doc_id) + INTERVAL 24 HOUR AS expires_at,
         n_chars * 2 AS size
  FROM documents),
cache AS (
  SELECT key, payload, created_at, expires_at, size FROM (
    SELECT *, row_number() OVER (PARTITION BY key ORDER BY created_at DESC) AS rn FROM entries)
  WHERE rn = 1)"""


def lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for all documents and all conversation turns, by text key."""
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("request_id"), "text")
    turns = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("."),
                 F.col("turn").cast("string")).alias("request_id"), "text")
    return docs.unionByName(turns).select(
        "request_id", F.left(F.sha2("text", 256), F.lit(32)).alias("key"))


LOOKUPS_SQL = """
lookups AS (
  SELECT 'd' || doc_id AS request_id, left(sha256(text), 32) AS key FROM documents
  UNION ALL SELECT 'c' || conv_id || '.' || turn, left(sha256(text), 32) FROM conversations)"""


def _prop_k() -> Column:
    return F.regexp_extract("props", r'"k": *([0-9]+)', 1).cast("long")


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    bad = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        e.cast("string").alias("unit_id"), F.col("event_type").alias("step"), (~bad).alias("ok"),
        F.col("value").alias("ms"), _prop_k().alias("tokens"),
        (e % 2 == 0).alias("recoverable"),
        pick([F.lit(c) for c in ERROR_CODES], F.col("user_id")).alias("code"),
        F.concat(F.lit("Failure "), pick([F.lit(m) for m in MESSAGES], e)).alias("message"),
        pick([F.lit(s) for s in STATUSES], e).cast("long").alias("status"),
        pick([F.lit(p) for p in PROVIDERS], e).alias("provider"),
    )


ERROR_CODES = ("WEBCRACK_FAILED", "FILE_NOT_FOUND", "LLM_TIMEOUT", "UNKNOWN_ERROR")
MESSAGES = ("Unauthorized", "Invalid API key", "Quota exceeded", "Bad request", "Network timeout",
            "Server error", "Connection reset", "malformed body")
STATUSES = (200, 429, 500, 503, 400)
PROVIDERS = ("anthropic", "openai", "azure", "ollama")

RUN_LOG_SQL = f"""
run_log AS (
  SELECT event_id::VARCHAR AS unit_id, event_type AS step, event_type <> 'error' AS ok,
         value AS ms, regexp_extract(props, '"k": *([0-9]+)', 1)::BIGINT AS tokens,
         event_id % 2 = 0 AS recoverable,
         {pick_sql([sql_text(c) for c in ERROR_CODES], 'user_id')} AS code,
         'Failure ' || {pick_sql([sql_text(m) for m in MESSAGES], 'event_id')} AS message,
         {pick_sql([str(s) for s in STATUSES], 'event_id')}::BIGINT AS status,
         {pick_sql([sql_text(p) for p in PROVIDERS], 'event_id')} AS provider
  FROM events)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, v = F.col("event_id"), F.col("value")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("run_id"), F.col("ts"), e.alias("sample_id"),
        v.alias("throughput"), (v * 20).alias("heap_mb"),
        ((e % 100) / F.lit(100.0)).alias("cpu"), ((e % 90) / F.lit(100.0)).alias("memory"),
        v.alias("seconds"),
    )


SAMPLES_SQL = """
samples AS (
  SELECT user_id::VARCHAR AS run_id, ts, event_id AS sample_id, value AS throughput,
         value * 20 AS heap_mb, (event_id % 100) / 100.0::DOUBLE AS cpu,
         (event_id % 90) / 100.0::DOUBLE AS memory, value AS seconds
  FROM events)"""


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request settings of every sort, good and bad, one per event."""
    e = F.col("event_id")
    provider = pick([F.lit(p) for p in (*PROVIDERS, "bedrock")], e)
    return table(spark, sf_dir, "events").select(
        e.alias("setting_id"), provider.alias("provider"),
        pick([F.lit(m) for m in SETTING_MODELS], F.floor(e / 5)).alias("model"),
        F.when(e % 7 != 0, F.concat(F.lit("key"), e.cast("string"))).alias("api_key"),
        F.when(e % 3 != 0, F.lit("http://localhost/")).alias("base_url"),
        (F.col("value") / F.lit(10.0) - F.lit(0.5)).alias("temperature"),
        (F.floor(F.col("value") * 20000) - 1000).alias("max_tokens"),
    )


SETTING_MODELS = ("gpt-4o", "claude-3-opus-20240229", "llama3:8b", "gpt-4o-mini", "invalid-model",
                  "claude-3-5-sonnet-20241022", "codellama:13b")

SETTINGS_SQL = f"""
settings AS (
  SELECT event_id AS setting_id,
         {pick_sql([sql_text(p) for p in (*PROVIDERS, "bedrock")], 'event_id')} AS provider,
         {pick_sql([sql_text(m) for m in SETTING_MODELS], '(event_id // 5)')} AS model,
         CASE WHEN event_id % 7 <> 0 THEN 'key' || event_id END AS api_key,
         CASE WHEN event_id % 3 <> 0 THEN 'http://localhost/' END AS base_url,
         value / 10.0::DOUBLE - 0.5::DOUBLE AS temperature,
         floor(value * 20000)::BIGINT - 1000 AS max_tokens
  FROM events)"""

CALL_MODELS = ("gpt-4o", "claude-3-opus-20240229", "llama3:8b", "gpt-4o-mini", "mystery-1",
               "claude-3-5-haiku-20241022", "codellama:70b", "qwen2:7b", "gpt-4", "mistral")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inference calls with token counts, one per event."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("r"), e.cast("string")).alias("request_id"),
        pick([F.lit(p) for p in PROVIDERS], e).alias("provider"),
        pick([F.lit(m) for m in CALL_MODELS], F.floor(e / 4)).alias("model"),
        (_prop_k() * 37 + e % 1000).alias("input_tokens"), (_prop_k() * 11).alias("output_tokens"),
        (_prop_k() * 48).alias("tokens_used"),
    )


CALLS_SQL = f"""
calls AS (
  SELECT 'r' || event_id AS request_id,
         {pick_sql([sql_text(p) for p in PROVIDERS], 'event_id')} AS provider,
         {pick_sql([sql_text(m) for m in CALL_MODELS], '(event_id // 4)')} AS model,
         k * 37 + event_id % 1000 AS input_tokens, k * 11 AS output_tokens, k * 48 AS tokens_used
  FROM (SELECT *, regexp_extract(props, '"k": *([0-9]+)', 1)::BIGINT AS k FROM events))"""
