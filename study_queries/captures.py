"""Captures, type inference and text sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sweepframe import Axis, Capture, Space, Step, Study, sweep
from sweepframe.operators import capture as cap
from sweepframe.operators.collect import upsert
from sweepframe.operators.context import contexts
from sweepframe.session import fresh_path
from sweepframe.sources import text as sources
from sweepframe.sources.export import record_json
from sweepframe.sources.filemaps import FileMap, mapped_files
from sweepframe.sources.files import write_files
from sweepframe.types import apply_schema, declared_types, infer_schema, merged_schema, record_types, system_type, type_name

from .common import FLAGS, STATUSES, Registry, load, values

registry = Registry()
add = registry.add

INTEGER = r"\s*[:=]?\s*([-+]?[0-9]+)"
FLOAT = r"\s*[:=]?\s*([-+]?(?:(?:\d*\.\d+)|(?:\d+\.?))(?:[Ee][+-]?\d+)?)"

SKIPPED = r"e\s*[:=]?\s*(\S+\s+){2}([-+]?[0-9]+)"
FLEXIBLE = r'--\s+ad'
COMMENT = r"<!--\s+ad"


def found(column: str, pattern: str, group: int = 1) -> str:
    """SQL for all matches of a pattern, null if there are none."""
    quoted = pattern.replace("'", "''")
    return f"(CASE WHEN regexp_matches({column}, '{quoted}') THEN regexp_extract_all({column}, '{quoted}', {group}) END)"


def captured(spark, sf, table, key, text, *captures, declared=None):
    rows = cap.capture_text(load(spark, sf, table), text, captures, declared, strict=False)
    return rows.select(*([key] if isinstance(key, str) else key), *cap.captured_names(captures))


LINK = r'<a href="(?P<href>[^"]*)">(?P<label>[^<]*)</a>'
LINK_SQL = r'<a href="([^"]*)">([^<]*)</a>'


@add("C1_regex_capture", f"""
SELECT page_id, list_extract({found("html", LINK_SQL)}, -1) AS href, list_extract({found("html", LINK_SQL, 2)}, -1) AS label FROM pages""")
def regex_capture(spark, sf):
    return captured(spark, sf, "pages", "page_id", "html", Capture(LINK))


@add("C2_simple_integer", f"""SELECT event_id, CAST(list_extract({found("props", '"k"' + INTEGER)}, -1) AS BIGINT) AS k FROM events""")
def simple_integer(spark, sf):
    return captured(spark, sf, "events", "event_id", "props", Capture.simple("integer", "k", '"k"'))


@add("C3_simple_float", f"""SELECT doc_id, TRY_CAST(list_extract({found("text", " " + FLOAT)}, -1) AS DOUBLE) AS x FROM documents""")
def simple_float(spark, sf):
    return captured(spark, sf, "documents", "doc_id", "text", Capture.simple("float", "x", " "))


@add("C4_skip_words", f"""
SELECT doc_id, TRY_CAST(list_extract({found("text", SKIPPED, 2)}, 1) AS BIGINT) AS n FROM documents""")
def skip_words(spark, sf):
    return captured(spark, sf, "documents", "doc_id", "text", Capture.simple("integer", "n", "e", skip_words=2, mode="first"))


@add("C5_flexible_prefix", f"""
SELECT page_id, CAST(list_extract({found("html", FLEXIBLE + INTEGER)}, 1) AS BIGINT) AS n,
       CAST(list_extract({found("html", COMMENT + INTEGER)}, -1) AS BIGINT) AS ad FROM pages""")
def flexible_prefix(spark, sf):
    return captured(
        spark, sf, "pages", "page_id", "html",
        Capture.simple("integer", "n", "--    ad", flexible_prefix=True, mode="first"),
        Capture.simple("integer", "ad", "<!-- ad", flexible_prefix=True),
    )


def _integers(mode):
    return Capture.simple("integer", "n", "", mode=mode)


@add("C6_mode_first", f"SELECT doc_id, TRY_CAST(list_extract({found('text', INTEGER)}, 1) AS BIGINT) AS n FROM documents")
def first(spark, sf):
    return captured(spark, sf, "documents", "doc_id", "text", _integers("first"))


@add("C7_mode_last", f"SELECT doc_id, TRY_CAST(list_extract({found('text', INTEGER)}, -1) AS BIGINT) AS n FROM documents")
def last(spark, sf):
    return captured(spark, sf, "documents", "doc_id", "text", _integers("last"))


@add("C8_mode_all", f"""
WITH m AS (SELECT doc_id, {found("text", INTEGER)} AS m FROM documents)
SELECT doc_id, len(m) AS n, array_to_string(list_transform(m, lambda x: coalesce(CAST(TRY_CAST(x AS BIGINT) AS VARCHAR), '-')), ',') AS ns FROM m""")
def every(spark, sf):
    rows = captured(spark, sf, "documents", "doc_id", "text", _integers("all"))
    return rows.select("doc_id", F.when(F.col("n").isNotNull(), F.size("n").cast("long")).alias("n"), F.array_join("n", ",", "-").alias("ns"))


@add("C9_typed_coercion", f"""
WITH m AS (SELECT event_id, {found("props", '"k": ([0-9]+)')} AS m FROM events)
SELECT event_id, CAST(m[1] AS BIGINT) AS i, CAST(m[1] AS DOUBLE) AS f, m[1] AS s, CAST(m[1] AS DOUBLE) / 2 AS half FROM m""")
def coercion(spark, sf):
    patterns = [Capture(rf'"k": (?P<{name}>[0-9]+)') for name in ("i", "f", "s")]
    patterns.append(Capture('"k": (?P<l>[0-9]+)', "all", "float"))
    declared = declared_types({"i": "int", "f": "float", "s": "str"})
    rows = captured(spark, sf, "events", "event_id", "props", *patterns, declared=declared)
    return rows.select("event_id", "i", "f", "s", (F.get("l", F.lit(0)) / 2).alias("half"))


WORD = "^([a-zA-Z]+)"
NAME = "([A-Z][a-z]{2,})[.]"


@add("C10_several_texts", f"""
WITH m AS (SELECT conv_id, turn, {found("text", NAME)} AS names, list_extract({found("text", WORD)}, -1) AS word FROM conversations)
SELECT conv_id, max_by(word, turn) FILTER (word IS NOT NULL) AS word,
       array_to_string(flatten(list(names ORDER BY turn) FILTER (names IS NOT NULL)), ',') AS names FROM m GROUP BY conv_id""")
def several_texts(spark, sf):
    captures = [Capture("(?P<names>[A-Z][a-z]{2,})[.]", "all"), Capture("^(?P<word>[a-zA-Z]+)")]
    rows = cap.capture_instances(load(spark, sf, "conversations"), captures, key="conv_id", order="turn")
    return rows.select("conv_id", "word", F.when(F.col("names").isNotNull(), F.array_join("names", ",")).alias("names"))


@add("C10_long_form", f"""
WITH m AS (SELECT conv_id, turn, unnest({found("text", NAME)}) AS value, generate_subscripts({found("text", NAME)}, 1) - 1 AS pos
           FROM conversations)
SELECT conv_id, turn, 'name' AS name, CAST(pos AS INTEGER) AS pos, value FROM m""")
def long_form(spark, sf):
    rows = cap.capture_long(load(spark, sf, "conversations"), [Capture("(?P<name>[A-Z][a-z]{2,})[.]", "all")], "conv_id", "turn")
    return rows.select("conv_id", "turn", "name", "pos", "value")


@add("C10_segments", """
WITH m AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[a-z]{3,}')) AS w, generate_subscripts(regexp_extract_all(text, '[a-z]{3,}'), 1) AS i FROM conversations),
placed AS (SELECT conv_id, w, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS place FROM m),
last AS (SELECT conv_id, max_by(CAST(n AS BIGINT), turn) AS n FROM (
    SELECT conv_id, turn, regexp_extract_all(text, '[0-9]+')[-1] AS n FROM conversations) WHERE n IS NOT NULL GROUP BY conv_id)
SELECT conv_id, place // 20 AS segment, string_agg(w, ' ' ORDER BY place) AS words, any_value(n) AS n
FROM placed LEFT JOIN last USING (conv_id) GROUP BY conv_id, place // 20""")
def segments(spark, sf):
    captures = [Capture("(?P<w>[a-z]{3,})", "all"), Capture("(?P<n>[0-9]+)", "last", "int")]
    single, lists = cap.capture_segments(load(spark, sf, "conversations"), captures, key="conv_id", order="turn", length=20)
    return lists.join(single, "conv_id").select("conv_id", "segment", F.array_join("w", " ").alias("words"), "n")


@add("C11_capture_again", f"SELECT doc_id AS g_index, TRY_CAST(list_extract({found('text', INTEGER)}, -1) AS BIGINT) AS n FROM documents")
def capture_again(spark, sf):
    root = fresh_path(spark, "tree")
    write_files(load(spark, sf, "documents").select(F.concat("doc_id", F.lit("/records/sh.stdout")).alias("path"), "text"), root)
    texts = sources.read_stdout(spark, root).select(F.col("logdir").cast("long").alias("g_index"), "text", F.lit(0).alias("cmd_no"))
    once = cap.capture_instances(texts, [_integers("first")], strict=False)
    again = cap.capture_instances(texts, [_integers("last")], strict=False)
    return upsert(upsert(once, again), again)


# --- types -----------------------------------------------------------------------------------

MIXED = "CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_linenumber AS STRING) ELSE CAST(l_discount AS STRING) END"


def _records(spark, sf):
    rows = load(spark, sf, "lineitem")
    return rows.select(
        F.concat(
            F.lit('{"v": '), F.expr(MIXED), F.lit(', "flag": "'), F.col("l_returnflag"), F.lit('", "ok": '),
            F.expr("CASE WHEN l_quantity > 25 THEN 'true' ELSE '\"yes\"' END"), F.lit(', "l": ['),
            F.expr("CASE WHEN l_linenumber > 3 THEN '' ELSE CAST(l_linenumber AS STRING) END"), F.lit("]}"),
        ).alias("record")
    )


TYPES_SQL = """
types AS (
    SELECT 'v' AS key, CASE WHEN l_linenumber % 2 = 0 THEN 'integer' ELSE 'floating' END AS type FROM lineitem
    UNION SELECT 'flag', 'string' FROM lineitem
    UNION SELECT 'ok', CASE WHEN l_quantity > 25 THEN 'boolean' ELSE 'string' END FROM lineitem
    UNION SELECT 'l', CASE WHEN l_linenumber > 3 THEN 'list(any)' ELSE 'list(integer)' END FROM lineitem
)"""


@add("T1_infer_types", f"WITH {TYPES_SQL} SELECT key, type FROM types")
def infer(spark, sf):
    return record_types(_records(spark, sf), "record")


@add("T2_merge_types", f"""
WITH {TYPES_SQL}, sets AS (SELECT key, list_sort(list(type)) AS t FROM types GROUP BY key)
SELECT key, CASE WHEN t = ['floating', 'integer'] THEN 'floating' WHEN t = ['boolean', 'string'] THEN 'boolean'
                 WHEN t = ['list(any)', 'list(integer)'] THEN 'list(integer)' ELSE t[1] END AS type FROM sets""")
def merge(spark, sf):
    schema = infer_schema(_records(spark, sf), "record")
    return spark.createDataFrame([(f.name, type_name(f.dataType)) for f in schema], "key string, type string")


@add("T3_declared_types", """
SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS DOUBLE) AS l_linenumber, CAST(l_quantity AS BIGINT) AS l_quantity FROM lineitem""")
def declared(spark, sf):
    types = declared_types({"l_orderkey": "str", "l_linenumber": "float", "l_quantity": "integer"})
    return apply_schema(load(spark, sf, "lineitem"), T.StructType([T.StructField(n, t) for n, t in types.items()]))


@add("T4_system_columns", """
SELECT event_id AS g_index, 'u' || user_id AS g_logdir, ts AS g_started, event_type <> 'error' AS g_success,
       round(value, 2) AS g_walltime_run FROM events""")
def system_columns(spark, sf):
    rows = load(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("g_index"), F.concat(F.lit("u"), "user_id").alias("g_logdir"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("g_started"),
        F.when(F.col("event_type") == "error", "0").otherwise("1").alias("g_success"),
        F.col("value").cast("string").alias("g_walltime_run"),
    )
    schema = T.StructType([T.StructField(c, system_type(c)) for c in rows.columns])
    return apply_schema(rows, schema).withColumn("g_walltime_run", F.round("g_walltime_run", 2))


@add("T5_apply_merged_schema", """
SELECT CAST(o_orderkey AS BIGINT) AS k, CAST(o_custkey AS DOUBLE) AS v, NULL AS s FROM orders
UNION ALL SELECT p_partkey, p_retailprice, p_brand FROM part""")
def merged(spark, sf):
    left = load(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("v"))
    right = load(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("v"), F.col("p_brand").alias("s"))
    schema = merged_schema(left.schema, right.schema)
    return apply_schema(left, schema).unionByName(apply_schema(right, schema))


@add("T6_axis_types", f"""
SELECT CAST(f.i * 4 + s.i * 2 + b.i AS BIGINT) AS g_index, f.v AS flag, s.v AS status, b.i = 0 AS odd, 'list(string)' AS flag_type,
       'list(boolean)' AS odd_type, 'list(floating)' AS least_type, count(l_orderkey) AS n
FROM {values("f", FLAGS)} CROSS JOIN {values("s", STATUSES)} CROSS JOIN generate_series(0, 1) b(i)
LEFT JOIN lineitem ON l_returnflag = f.v AND l_linestatus = s.v AND (l_linenumber % 2 = 1) = (b.i = 0) AND l_quantity >= 10.5 GROUP BY ALL""")
def axis_types(spark, sf):
    space = Space({"flag": FLAGS, "status": STATUSES, "odd": [True, False], "least": [10.5]})
    on = [("l_returnflag", "=", "flag"), ("l_linestatus", "=", "status"), ("l_linenumber % 2 = 1", "=", "odd"), ("l_quantity", ">=", "least")]
    rows = sweep(contexts(spark, space), load(spark, sf, "lineitem"), on, {"n": ("count", None)}, space.full_size())

    def name(axis: Axis) -> str:
        return type_name(T.ArrayType(axis.element_type))

    return rows.drop("least").withColumns({f"{a}_type": F.lit(name(space[a])) for a in ("flag", "odd", "least")})


# --- sources ---------------------------------------------------------------------------------


@add("S5_scan_stdout", """
SELECT 'conv-' || conv_id || repeat('/_level/.hidden', CAST(conv_id % 4 AS BIGINT)) AS logdir, role || turn AS command, length(text) AS n, md5(text) AS hash FROM conversations""")
def scan_stdout(spark, sf):
    root = fresh_path(spark, "tree")
    deep = F.expr("repeat('/_level/.hidden', cast(conv_id % 4 as int))")
    path = F.concat(F.lit("conv-"), "conv_id", deep, F.lit("/records/"), "role", "turn", F.lit(".stdout"))
    write_files(load(spark, sf, "conversations").select(path.alias("path"), "text"), root)
    return sources.read_stdout(spark, root).select("logdir", "command", F.length("text").cast("long").alias("n"), F.md5("text").alias("hash"))


@add("S6_info_lines", """
WITH l AS (SELECT user_id, event_id, event_type || '=' || value || '=' || props AS line FROM events)
SELECT user_id, split_part(line, '=', 1) AS key, max_by(substr(line, strpos(line, '=') + 1), event_id) AS value FROM l GROUP BY ALL""")
def info_lines(spark, sf):
    line = F.concat_ws("=", "event_type", F.col("value").cast("string"), "props")
    return sources.parse_info(load(spark, sf, "events").select("user_id", "event_id", line.alias("line")), ["user_id"], "event_id")


@add("S6_info_tree", """
WITH l AS (SELECT conv_id, turn, 'g_walltime_' || role AS key, CAST(length(text) AS VARCHAR) AS value FROM conversations
           UNION ALL SELECT conv_id, turn, 'note', role || '=' || turn FROM conversations)
SELECT 'c' || conv_id AS logdir, key, max_by(value, turn) AS value FROM l GROUP BY ALL""")
def info_tree(spark, sf):
    root = fresh_path(spark, "tree")
    length = F.length("text").cast("string")
    line = F.concat(F.lit("g_walltime_"), "role", F.lit("="), length, F.lit("\nnote="), "role", F.lit("="), "turn")
    texts = load(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))
    path = F.concat(F.lit("c"), "conv_id", F.lit("/records/info.txt"))
    write_files(texts.select(path.alias("path"), F.array_join("l.line", "\n").alias("text")), root)
    return sources.read_info(spark, root)


@add("S7_inferred_records", """
SELECT event_id, user_id, CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS DOUBLE) ELSE event_id + 0.5 END AS number,
       CASE WHEN event_id % 3 = 0 THEN event_type END AS kind, 'other' || event_id AS extra FROM events""")
def inferred_records(spark, sf):
    rows = load(spark, sf, "events")
    fields = [F.concat(F.lit('{"event_id":'), "event_id", F.lit(',"user_id":'), "user_id", F.lit(',"number":'), "event_id")]
    fields += [F.when(F.col("event_id") % 2 == 0, "").otherwise(".5"), F.expr("""if(event_id % 3 = 0, concat(',"kind":"', event_type, '"'), '')""")]
    texts = rows.select(F.concat(*fields, F.lit("}")).alias("json"))
    parsed = sources.parse_records(texts, "json").select("record.*")
    # Keys that a given schema does not name are kept when asked for.
    more = rows.select("event_id", F.concat(F.lit('{"event_id":'), "event_id", F.lit(',"extra":"other'), "event_id", F.lit('"}')).alias("json"))
    kept = sources.parse_records(more, "json", "event_id long", undeclared="keep")
    return parsed.join(kept.select("event_id", F.col("record_undeclared")["extra"].alias("extra")), "event_id")


@add("S8_rebuilt_study", """
SELECT s_suppkey AS g_index, s_nationkey AS nation, s_acctbal AS balance, CAST(s_nationkey AS DOUBLE) / 2 AS g_walltime_run, 's' || s_nationkey AS note
FROM supplier WHERE s_nationkey % 3 <> 1""")
def rebuilt_study(spark, sf):
    root = fresh_path(spark, "tree")
    rows = load(spark, sf, "supplier").withColumn("dir", F.concat(F.lit("s"), "s_suppkey"))
    context = F.to_json(F.struct(F.col("s_suppkey").alias("g_index"), F.col("dir").alias("g_logdir"), F.col("s_nationkey").alias("nation")))
    info = F.concat(F.lit("g_walltime_run="), F.col("s_nationkey") / 2, F.lit("\nnote=s"), "s_nationkey")
    status = F.when(F.col("s_nationkey") % 3 == 1, "started").otherwise("Downloaded\n")
    texts = {"context.json": context, "captured.json": F.to_json(F.struct(F.col("s_acctbal").alias("balance"))), "info.txt": info, "status.txt": status}
    files = rows.select("dir", F.inline(F.array(*(F.struct(F.lit(n).alias("name"), t.alias("text")) for n, t in texts.items()))))
    write_files(files.select(F.concat("dir", F.lit("/records/"), "name").alias("path"), "text"), root)
    study = Study(spark, root=fresh_path(spark, "study"))
    study.rebuild(root)
    return study.collect().select("g_index", "nation", "balance", "g_walltime_run", "note")


@add("C11_study_recapture", """
SELECT s_suppkey AS g_index, s_suppkey * 3 AS k, s_suppkey * 6 AS twice FROM supplier WHERE s_suppkey BETWEEN 1 AND 40""")
def study_recapture(spark, sf):
    numbers = sorted(row[0] for row in load(spark, sf, "supplier").where("s_suppkey between 1 and 40").select("s_suppkey").collect())
    root = fresh_path(spark, "study")
    steps = [Step("say", lambda context: f"k={context['n'] * 3}\ntwice={context['n'] * 6}")]
    simple = [Capture.simple("integer", name, name) for name in ("k", "twice")]
    study = Study(spark, {"n": numbers}, steps=steps, captures=simple[:1], root=root)
    study.run()
    study.collect()
    # Other captures over the texts that were kept, twice over.
    again = Study(spark, {"n": numbers}, steps=steps, captures=simple, root=root)
    again.capture()
    again.capture()
    return again.collect().select(F.col("n").alias("g_index"), "k", "twice")


@add("S7_json_records", "SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice, o_orderstatus FROM orders")
def json_records(spark, sf):
    rows = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    texts = rows.select(record_json(rows).alias("json"))
    parsed = sources.parse_records(texts, "json", rows.schema)
    return parsed.select("record.*").withColumn("o_totalprice", F.round("o_totalprice", 2))


@add("S8_rebuild_instances", """
SELECT s_suppkey AS g_index, 's' || s_suppkey || repeat('/.d', CAST(s_nationkey % 7 AS BIGINT)) AS logdir, s_nationkey AS nation,
       CASE WHEN s_nationkey % 3 = 0 THEN s_acctbal END AS balance, CASE WHEN s_nationkey % 3 = 0 THEN 'downloaded' ELSE 'finished' END AS status
FROM supplier WHERE s_nationkey % 2 = 0""")
def rebuild(spark, sf):
    root = fresh_path(spark, "tree")
    rows = load(spark, sf, "supplier").withColumn("dir", F.expr("concat('s', s_suppkey, repeat('/.d', cast(s_nationkey % 7 as int)))"))
    third = F.col("s_nationkey") % 3 == 0
    context = F.to_json(F.struct(F.col("s_suppkey").alias("g_index"), F.col("dir").alias("g_logdir"), F.col("s_nationkey").alias("nation")))
    captured = F.to_json(F.struct(F.col("s_acctbal").alias("balance")))
    files = F.array(
        F.struct(F.lit("context.json").alias("name"), context.alias("text")),
        F.when(third, F.struct(F.lit("captured.json").alias("name"), captured.alias("text"))),
        F.when(
            F.col("s_nationkey") % 2 == 0,
            F.struct(F.lit("status.txt").alias("name"), F.when(third, "downloaded").otherwise("finished").alias("text")),
        ),
    )
    listed = rows.select("dir", F.inline(F.filter(files, lambda f: f.isNotNull())))
    write_files(listed.select(F.concat("dir", F.lit("/.book/"), "name").alias("path"), "text"), root)
    built = sources.rebuild_instances(spark, root, "g_index long, g_logdir string, nation int", "balance double", book=".book")
    return built.select("g_index", "logdir", "context.nation", "captured.balance", "status")


@add("F3_template_files", """
WITH f AS (SELECT c_custkey AS g_index, c_name, c_nationkey AS k, n_name, n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT g_index, 'in/' || c_name || '.txt' AS target, n_name || ': ' || g_index || ', ' || (g_index * 2 + k) || chr(10) AS text FROM f
UNION ALL SELECT g_index, 'raw.txt', n_name || ': ${g_index}, ${g_index * 2 + k}' || chr(10) FROM f
UNION ALL SELECT g_index, 'all/notes/r' || n_regionkey || '/' || r_name || '.md', r_name FROM f JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT g_index, 'copy/deep/' || r_name || '.md', r_name FROM f JOIN region ON r_regionkey = n_regionkey""")
def template_files(spark, sf):
    root = fresh_path(spark, "tree")
    nations, regions = load(spark, sf, "nation"), load(spark, sf, "region")
    templates = nations.select(
        F.concat(F.lit("templates/"), "n_nationkey", F.lit(".txt")).alias("path"), F.concat("n_name", F.lit(": ${g_index}, ${g_index * 2 + k}\n")).alias("text")
    )
    notes = [
        regions.select(F.concat(F.lit(folder), "r_regionkey", F.lit(end), "r_name", F.lit(".md")).alias("path"), F.col("r_name").alias("text"))
        for folder, end in (("notes/r", "/"), ("tree/r", "/deep/"))
    ]
    write_files(reduce(DataFrame.unionByName, notes, templates), root)
    points = load(spark, sf, "customer").join(nations, F.col("n_nationkey") == F.col("c_nationkey"))
    points = points.select(F.col("c_custkey").alias("g_index"), "c_name", F.col("c_nationkey").alias("k"), "n_regionkey")
    maps = [
        FileMap("templates/${k}.txt", "in/${c_name}.txt", template=True),
        FileMap("./templates/${k}.txt", "raw.txt"),
        FileMap("notes/r${n_regionkey}/*", "all", mode="glob"),
        FileMap("tree/r${n_regionkey}", "copy"),
    ]
    return mapped_files(points, root, maps)


@add("S12_list_files", """
WITH f AS (SELECT 'r' || n_regionkey || repeat('/.h', CAST(n_nationkey % 3 AS BIGINT)) || '/_' || n_name || '.txt' AS path, length(n_name) AS length, * FROM nation)
SELECT path, length, 'walk' AS how FROM f WHERE n_regionkey = 2
UNION ALL SELECT path, length, 'glob' FROM f WHERE n_name LIKE 'NATION_1%'""")
def list_files(spark, sf):
    root = fresh_path(spark, "tree")
    path = F.expr("concat('r', n_regionkey, repeat('/.h', cast(n_nationkey % 3 as int)), '/_', n_name, '.txt')")
    write_files(load(spark, sf, "nation").select(path.alias("path"), "n_name"), root, text="n_name")
    walked = sources.list_files(spark, root, folder="r2").withColumn("how", F.lit("walk"))
    return walked.unionByName(sources.list_files(spark, root, pattern="*_1*.txt").withColumn("how", F.lit("glob")))
