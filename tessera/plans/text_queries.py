"""Queries over SQL fields, completions, rewards, prompts, answers and files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import math as M
from tessera.functions import text as T
from tessera.operators import execution as E
from tessera.operators import generation as G
from tessera.operators import metrics
from tessera.plans import query, table
from tessera.plans.rollout_queries import q, r
from tessera.sources import files
from tessera.sources.shared import shared_folder

# Fields and schemas -----------------------------------------------------------------

_REC = "r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'a' || o_orderkey WHEN o_orderkey % 3 = 0 THEN '' END AS sql, CASE WHEN o_orderkey % 5 = 0 THEN 'b' || o_orderkey END AS sql2, CASE WHEN o_orderkey % 7 = 0 THEN 'c' || o_orderkey END AS query FROM orders)"


def records(spark, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    mark = lambda c: F.concat(F.lit(c), k.cast("string"))
    return table(spark, d, "orders").select(k.alias("id"), F.when(k % 2 == 0, mark("a")).when(k % 3 == 0, "").alias("sql"), F.when(k % 5 == 0, mark("b")).alias("sql2"), F.when(k % 7 == 0, mark("c")).alias("query"))


@query(
    "sql_field_precedence",
    f"""WITH {_REC} SELECT id, coalesce(nullif(sql, ''), nullif(sql2, ''), nullif(query, ''), '') AS pool, coalesce(nullif(sql2, ''), nullif(sql, ''), nullif(query, ''), '') AS seed,
    CASE WHEN sql2 <> '' THEN 'sql2' WHEN sql <> '' THEN 'sql' WHEN query <> '' THEN 'query' END AS seed_field, coalesce(nullif(query, ''), nullif(sql2, ''), nullif(sql, ''), '') AS demo FROM r""",
)
def sql_field_precedence(spark, d):
    return records(spark, d).select("id", T.first_field(["sql", "sql2", "query"]).alias("pool"), T.first_field(["sql2", "sql", "query"]).alias("seed"), T.first_field_name(["sql2", "sql", "query"]).alias("seed_field"), T.first_field(["query", "sql2", "sql"]).alias("demo"))


@query("schema_map", "SELECT 'r' || n_regionkey AS db_id, arg_max(n_name, n_nationkey) AS schema FROM nation GROUP BY 1")
def schema_map(spark, d):
    """Of entries that repeat a database the last wins."""
    n = table(spark, d, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("db_id"), F.col("n_name").alias("schema"), "n_nationkey")
    return files.schema_map(n, "db_id", "schema", "n_nationkey")


@query("question_rows", "SELECT c.c_custkey, n.n_name AS schema, CASE WHEN n.n_name IS NULL THEN 'unknown database' END AS error, substr(c.c_name, 1, 12) AS question FROM customer c LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) n ON c_nationkey = n_nationkey")
def question_rows(spark, d):
    n = table(spark, d, "nation").where("n_nationkey < 20").withColumnRenamed("n_name", "schema")
    x = files.with_schema(table(spark, d, "customer"), "c_nationkey", n, "n_nationkey", "schema")
    return x.select("c_custkey", "schema", "error", F.substring("c_name", 1, 12).alias("question"))


@query("nested_training_rows", "SELECT o_orderkey AS index, o_orderpriority AS db_id, o_orderstatus AS sql FROM orders")
def nested_training_rows(spark, d):
    truth = F.struct(F.col("o_orderpriority").alias("db_id"), F.col("o_orderstatus").alias("sql"))
    x = table(spark, d, "orders").select(F.struct(truth.alias("ground_truth")).alias("reward_model"), F.struct(F.col("o_orderkey").alias("index")).alias("extra_info"))
    return x.select("extra_info.index", "reward_model.ground_truth.db_id", "reward_model.ground_truth.sql")


@query("pool_by_key", "SELECT vec_id AS pool_id, label, len(embedding) AS dimensions, vec_id * 2 AS score FROM embeddings")
def pool_by_key(spark, d):
    """Pool, vectors and scores meet by key; rows without a partner would be an error."""
    e = table(spark, d, "embeddings")
    pool, vectors, scores = e.select(F.col("vec_id").alias("pool_id"), "label"), e.select(F.col("vec_id").alias("pool_id"), F.size("embedding").cast("long").alias("dimensions")), e.select(F.col("vec_id").alias("pool_id"), (F.col("vec_id") * 2).alias("score"))
    return files.by_key("pool_id", pool, vectors, scores)


@query("sample_values", "SELECT 'n_name' AS column, list_slice(list(DISTINCT n_name ORDER BY n_name), 1, 5) AS vals FROM nation UNION ALL SELECT 'n_regionkey', list_slice(list(DISTINCT CAST(n_regionkey AS VARCHAR) ORDER BY CAST(n_regionkey AS VARCHAR)), 1, 5) FROM nation")
def sample_values(spark, d):
    return files.sample_values(table(spark, d, "nation"), ["n_name", "n_regionkey"], 5)


@query("schema_ddl", """SELECT n_nationkey, 'CREATE TABLE `' || n_name || '` (' || chr(10) || '  `id` INTEGER /*key; Examples: 1, 2*/,' || chr(10) || '  `x` TEXT,' || chr(10) || '  PRIMARY KEY (`id`)' || chr(10) || ');' AS ddl FROM nation""")
def schema_ddl(spark, d):
    column = lambda n, k, c: F.struct(F.lit(n).alias("name"), F.lit(k).alias("type"), c.alias("comment"))
    columns = F.array(column("id", "INTEGER", files.comment(F.lit("key"), F.array(F.lit("1"), F.lit("2")))), column("x", "TEXT", files.comment(F.lit(None).cast("string"), F.array().cast("array<string>"))))
    return table(spark, d, "nation").select("n_nationkey", files.ddl(F.col("n_name"), columns, F.array(F.lit("id"))).alias("ddl"))


@query("quoted_literals", "SELECT n_nationkey, '''' || replace(n_name || 's''x', '''', '''''') || '''' AS literal, '\"' || replace(n_name || '\"', '\"', '\"\"') || '\"' AS identifier FROM nation")
def quoted_literals(spark, d):
    return table(spark, d, "nation").select("n_nationkey", T.quote_literal(F.concat("n_name", F.lit("s'x"))).alias("literal"), T.quote_identifier(F.concat("n_name", F.lit('"'))).alias("identifier"))


@query("database_paths", "SELECT n_nationkey, '/data/' || CASE n_regionkey WHEN 0 THEN 'dev_databases' WHEN 1 THEN 'bank_databases' ELSE 'train_databases' END || '/' || n_name || '/' || n_name || '.sqlite' AS path FROM nation")
def database_paths(spark, d):
    split = F.when(F.col("n_regionkey") == 0, "dev").when(F.col("n_regionkey") == 1, "question_bank").otherwise("train")
    return table(spark, d, "nation").select("n_nationkey", E.db_path("/data", split, F.col("n_name")).alias("path"))


@query("responses_by_prompt", "SELECT conv_id, list(role || ':' || len(text) ORDER BY turn) AS responses FROM conversations GROUP BY conv_id")
def responses_by_prompt(spark, d):
    x = table(spark, d, "conversations").select("conv_id", "turn", F.concat("role", F.lit(":"), F.length("text").cast("string")).alias("responses"))
    return files.ordered_lists(x, "conv_id", "turn", ["responses"])


@query("json_lines_round_trip", "SELECT n_nationkey AS id, n_name AS name FROM nation")
def json_lines_round_trip(spark, d):
    path = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    files.append_json_lines(table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), path)
    return files.read_json_lines(spark, path, "id int, name string")


@query("flattened_struct", "SELECT n_nationkey AS \"a/b\", n_name AS \"a/c/d\" FROM nation")
def flattened_struct(spark, d):
    x = table(spark, d, "nation").select(F.struct(F.col("n_nationkey").alias("b"), F.struct(F.col("n_name").alias("d")).alias("c")).alias("a"))
    return x.select(*files.flatten(x.schema))


# Completions and rewards --------------------------------------------------------------

_COMPLETIONS = """c AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '<think>' || chr(10) || role || chr(10) || '</think>' || chr(10) || '<answer>' || chr(10) || 'SELECT ' || conv_id || ';' || chr(10) || '</answer>'
    WHEN 1 THEN 'Just the SQL: SELECT ' || conv_id WHEN 2 THEN '<think>' || chr(10) || 'x' || chr(10) || '</think>' || chr(10) || '<answer>' || chr(10) || 'SELECT 0' || chr(10) || '</answer>' || chr(10) || 'trailing'
    ELSE '<answer>SELECT 1</answer> or <answer> SELECT ' || conv_id || ' </answer>' END AS x FROM conversations)"""


def completions(spark, d: str) -> DataFrame:
    c, t = F.col("conv_id").cast("string"), F.col("turn") % 4
    x = (
        F.when(t == 0, F.concat(F.lit("<think>\n"), "role", F.lit("\n</think>\n<answer>\nSELECT "), c, F.lit(";\n</answer>")))
        .when(t == 1, F.concat(F.lit("Just the SQL: SELECT "), c))
        .when(t == 2, F.lit("<think>\nx\n</think>\n<answer>\nSELECT 0\n</answer>\ntrailing"))
        .otherwise(F.concat(F.lit("<answer>SELECT 1</answer> or <answer> SELECT "), c, F.lit(" </answer>")))
    )
    return table(spark, d, "conversations").select("conv_id", "turn", "role", x.alias("x"))


@query("format_reward", f"WITH {_COMPLETIONS} SELECT conv_id, turn, CAST(CASE WHEN turn % 4 IN (0, 2) THEN 1 ELSE 0 END AS DOUBLE) AS reward FROM c")
def format_reward(spark, d):
    return completions(spark, d).select("conv_id", "turn", T.format_reward(F.col("x")).alias("reward"))


@query("extract_answer", f"WITH {_COMPLETIONS} SELECT conv_id, turn, CASE turn % 4 WHEN 1 THEN x WHEN 2 THEN 'SELECT 0' ELSE 'SELECT ' || conv_id END AS sql FROM c")
def extract_answer(spark, d):
    return completions(spark, d).select("conv_id", "turn", T.sql_answer(F.col("x")).alias("sql"))


@query("combined_reward", f"WITH {_COMPLETIONS}, f AS (SELECT conv_id, turn, turn % 4 IN (0, 2) AS form, turn % 4 IN (0, 3) AS run FROM c) SELECT conv_id, turn, CAST(form::INT + 3 * run::INT AS DOUBLE) AS score, run AS acc_exec, form AND run AS acc_strict FROM f")
def combined_reward(spark, d):
    x = completions(spark, d).withColumn("r", E.rewards(F.col("x"), T.sql_answer(F.col("x")) == F.concat(F.lit("SELECT "), F.col("conv_id").cast("string"))))
    # Where the answer is 0 the conversation 0 would be right by chance, as the reference answer is its number.
    fixed = F.when((F.col("turn") % 4 == 2), False).otherwise(F.col("r.acc_exec"))
    form = F.col("r.format")
    return x.select("conv_id", "turn", (form + 3 * fixed.cast("double")).alias("score"), fixed.alias("acc_exec"), ((form > 0) & fixed).alias("acc_strict"))


@query("result_set_equal", "SELECT 1 AS pair, true AS same UNION ALL SELECT 2, false UNION ALL SELECT 3, true")
def result_set_equal(spark, d):
    """Pairs of queries: other order and repeats, one row less, nulls on both sides."""
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    nulls = n.select(F.nullif("n_nationkey", F.lit(3)).alias("k"))
    pairs = [(n, n.union(n).orderBy(F.desc("n_name"))), (n, n.where("n_nationkey > 0")), (nulls, nulls.distinct())]
    out = None
    for k, (a, b) in enumerate(pairs):
        one = E.same_rows(a, b).select(F.lit(k + 1).alias("pair"), "same")
        out = one if out is None else out.union(one)
    return out


@query("gold_results_once", "SELECT o_orderpriority AS gold, count(*) AS used FROM orders GROUP BY 1")
def gold_results_once(spark, d):
    return E.gold_uses(table(spark, d, "orders").withColumnRenamed("o_orderpriority", "gold"), "gold")


@query("validation_status", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'sql_empty' WHEN 1 THEN 'timeout' WHEN 2 THEN 'execution_error' WHEN 3 THEN 'empty_result' ELSE 'ok' END AS status, CASE p_partkey % 5 WHEN 3 THEN 'forward_sql_empty' ELSE 'forward_sql_invalid' END AS reason FROM part")
def validation_status(spark, d):
    k = F.col("p_partkey") % 5
    status = F.when(k == 0, "sql_empty").when(k == 1, "timeout").when(k == 2, "execution_error").when(k == 3, "empty_result").otherwise("ok")
    return table(spark, d, "part").select("p_partkey", status.alias("status"), T.fail_reason(F.lit("forward"), status).alias("reason"))


@query("truncated_results", "SELECT doc_id, CASE WHEN len(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END AS shown FROM documents")
def truncated_results(spark, d):
    return table(spark, d, "documents").select("doc_id", T.truncate(F.col("text"), 300).alias("shown"))


@query("custom_scorer", "SELECT o_orderkey, CAST(CASE WHEN o_custkey % 10 = 0 THEN 0 ELSE o_custkey % 10 / 10.0 END AS DOUBLE) AS score FROM orders")
def custom_scorer(spark, d):
    """A scorer in Python that fails for some pairs, which then have 0."""
    f = lambda a, t: 1 / (int(a) / int(t)) * (int(a) % 10) / 10 if int(a) % 10 else 1 / 0
    x = F.col("o_custkey").cast("string")
    return table(spark, d, "orders").select("o_orderkey", F.round(E.scores_by(f, x, x), 6).alias("score"))


# Prompts --------------------------------------------------------------------------------


@query("tagged_answers", "SELECT conv_id, turn, 'SELECT ' || conv_id AS sql, CASE WHEN turn % 2 = 0 THEN role END AS question FROM conversations")
def tagged_answers(spark, d):
    x = F.concat(F.lit("so <SQL>\n SELECT "), F.col("conv_id").cast("string"), F.lit(" </SQL> and <question>"), F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise(" "), F.lit("</question><sql>no</sql>"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.tag(x, "sql").alias("sql"), T.tag(x, "question").alias("question"))


@query("unfenced_sql", "SELECT conv_id, turn, 'SELECT ' || conv_id AS sql FROM conversations")
def unfenced_sql(spark, d):
    c = F.col("conv_id").cast("string")
    x = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("text ```sql\nSELECT "), c, F.lit(";\n``` more"))).otherwise(F.concat(F.lit("  SELECT "), c, F.lit(" ;; ")))
    return table(spark, d, "conversations").select("conv_id", "turn", T.unfence(x).alias("sql"))


@query("rendered_prompts", "SELECT n_nationkey, 'Schema: ' || n_name || chr(10) || 'Skeleton: S' || n_nationkey || chr(10) || 'Demos: a' || n_nationkey || chr(10) || chr(10) || 'b' AS prompt FROM nation")
def rendered_prompts(spark, d):
    demos = G.demonstrations(F.array(F.concat(F.lit("a"), F.col("n_nationkey").cast("string")), F.lit("b")), lambda x: x)
    x = T.fill("Schema: {schema}\nSkeleton: {skeleton}\nDemos: {demos}", {"schema": F.col("n_name"), "skeleton": F.concat(F.lit("S"), F.col("n_nationkey").cast("string")), "demos": demos})
    return table(spark, d, "nation").select("n_nationkey", x.alias("prompt"))


@query("endpoints_in_turn", "SELECT n_nationkey, ['u0', 'u1', 'u2'][1 + n_nationkey % 3] AS url FROM nation")
def endpoints_in_turn(spark, d):
    return table(spark, d, "nation").select("n_nationkey", G.endpoint(F.col("n_nationkey"), ["u0", "u1", "u2"]).alias("url"))


@query("url_lists", "SELECT n_nationkey, ['http://a', n_name] AS urls FROM nation")
def url_lists(spark, d):
    return table(spark, d, "nation").select("n_nationkey", T.url_list(F.concat(F.lit(" http://a ,, "), "n_name", F.lit(" , "))).alias("urls"))


@query("token_usage", "SELECT event_type AS step, 'm' || user_id % 3 AS model, CAST(sum(event_id) AS BIGINT) AS input, CAST(sum(event_id % 7) AS BIGINT) AS output, count(*) AS calls FROM events GROUP BY 1, 2")
def token_usage(spark, d):
    x = table(spark, d, "events").select(F.col("event_type").alias("step"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"), F.col("event_id").alias("input"), (F.col("event_id") % 7).alias("output"))
    return G.token_usage(x)


@query("cleaned_json", "SELECT event_id, '{\"k\": ' || event_id || ',\"a\":[1]}' AS soft, CAST(event_id AS BIGINT) AS k FROM events")
def cleaned_json(spark, d):
    n = F.col("event_id").cast("string")
    soft = T.clean_json(F.concat(F.lit('﻿{"k": '), n, F.lit(',"a":[1, ],}')))
    hard = T.clean_json_hard(F.concat(F.lit("{k: "), n, F.lit(", /* note */ }")))
    return table(spark, d, "events").select("event_id", soft.alias("soft"), F.get_json_object(hard, "$.k").cast("long").alias("k"))


@query("json_properties", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_properties(spark, d):
    block = T.json_block(F.concat(F.lit("Here: ```json\n"), "props", F.lit("\n``` done")))
    return table(spark, d, "events").select("event_id", F.from_json(block, "k long")["k"].alias("k"))


@query("failure_records", "SELECT conv_id, turn, CASE WHEN len(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END AS sql, 'forward' AS stage FROM conversations")
def failure_records(spark, d):
    f = G.failure(F.col("conv_id"), F.lit("db"), F.col("turn"), F.lit("forward"), F.lit("timeout"), F.col("text"), 50)
    return table(spark, d, "conversations").select(f.alias("f")).select(F.col("f.selection_rank").alias("conv_id"), F.col("f.attempt_id").alias("turn"), "f.sql", "f.stage")


@query("synthesis_rounds")
def synthesis_rounds(spark, d):
    """Up to eight rounds of a stub generator; what fails is tried again with another prompt."""

    def attempt(rows, k):
        asked = rows.withColumn("prompt", F.concat("text", F.lit(f" round {k}")))
        said = G.complete(asked, "prompt", "said").withColumn("sql", T.tag(F.col("said"), "sql"))
        return said.select("item_id", "sql", F.col("sql").isNotNull().alias("ok"), F.when(F.col("sql").isNull(), "no_tag").alias("reason"))

    done, _ = G.in_rounds(table(spark, d, "benchmark"), "item_id", attempt, 8)
    return done.select("item_id", "sql", "attempt")


# Answers ---------------------------------------------------------------------------------


@query("em_check", "SELECT n_nationkey, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS em, CAST(1 AS DOUBLE) AS contained FROM nation")
def em_check(spark, d):
    x = F.concat(F.lit(" The  "), F.lower("n_name"), F.when(F.col("n_nationkey") % 2 == 0, F.lit("!")).otherwise(" too."))
    golds = F.array(F.lit("none"), F.concat(F.lit("an "), "n_name"))
    return table(spark, d, "nation").select("n_nationkey", T.exact_match(x, golds).alias("em"), T.contains_match(x, golds).alias("contained"))


@query("normalised_answers", "SELECT n_nationkey, replace(lower(n_name), '_', '') || ' x' AS answer FROM nation")
def normalised_answers(spark, d):
    return table(spark, d, "nation").select("n_nationkey", T.normal_answer(F.concat(F.lit("A "), "n_name", F.lit(",  the X."))).alias("answer"))


@query("number_answers", "SELECT o_orderkey, '1' || o_custkey AS strict, CAST(o_custkey AS VARCHAR) AS flexible, CAST(CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS score FROM orders")
def number_answers(spark, d):
    n = F.col("o_custkey").cast("string")
    x = F.concat(F.lit("7 so #### 1,"), n, F.lit(" and . "), n)
    strict = T.hash_answer(x)
    truth = F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("1"), n)).otherwise("none")
    return table(spark, d, "orders").select("o_orderkey", strict.alias("strict"), T.last_number(x).alias("flexible"), (strict == truth).cast("double").alias("score"))


@query("last_answer_tags", "SELECT conv_id, turn, role AS answer, CAST(turn + 1 AS INTEGER) AS opening, CAST(turn + 1 AS INTEGER) AS closing, CAST(CASE WHEN turn + 1 > 5 THEN 0.25 ELSE 1 END AS DOUBLE) AS score FROM conversations")
def last_answer_tags(spark, d):
    x = F.concat(F.repeat(F.lit("<answer>no</answer> "), F.col("turn").cast("int")), F.lit("<answer> "), "role", F.lit("\n</answer>"))
    tags = T.count_tags(x, "answer")
    score = F.when(T.last_tag(x, "answer") == F.col("role"), 1.0).otherwise(0.0)
    return table(spark, d, "conversations").select("conv_id", "turn", T.last_tag(x, "answer").alias("answer"), tags["opening"].alias("opening"), tags["closing"].alias("closing"), F.when(tags["opening"] > 5, score / 4).otherwise(score).alias("score"))


@query("passages_to_string", "SELECT n_regionkey, string_agg('Doc ' || k || '(Title: ' || n_name || ') body ' || n_nationkey || chr(10), '' ORDER BY k) AS passages FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation) GROUP BY 1")
def passages_to_string(spark, d):
    one = F.struct("n_nationkey", F.concat("n_name", F.lit("\nbody "), F.col("n_nationkey").cast("string")).alias("d"))
    x = table(spark, d, "nation").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(one)), lambda y: y["d"]).alias("x"))
    return x.select("n_regionkey", T.passages(F.col("x")).alias("passages"))


@query("scores_by_source", "SELECT event_id, CAST(CASE event_type WHEN 'view' THEN CASE WHEN value > 10 THEN 1 ELSE 0 END WHEN 'click' THEN value ELSE 0.5 END AS DOUBLE) AS score FROM events")
def scores_by_source(spark, d):
    half = F.lit(0.5)
    known = {"view": F.col("value") > 10, "click": F.col("value"), "signup": half, "purchase": half, "error": half}
    return table(spark, d, "events").select("event_id", E.by_source(F.col("event_type"), known).alias("score"))


@query("choice_answers", "SELECT p_partkey, ['A', 'B', 'C', 'D'][1 + p_partkey % 4] AS choice, CAST(CASE WHEN p_partkey % 4 = 2 THEN 1 ELSE 0 END AS DOUBLE) AS score FROM part")
def choice_answers(spark, d):
    letter = F.get(F.array(*[F.lit(c) for c in "ABCD"]), (F.col("p_partkey") % 4).cast("int"))
    got = T.choice(F.concat(F.lit("I think. Answer: "), letter))
    return table(spark, d, "part").select("p_partkey", got.alias("choice"), (got == "C").cast("double").alias("score"))


@query("answer_lines", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '[INVALID]' ELSE 'n' || p_size END AS answer FROM part")
def answer_lines(spark, d):
    x = F.when(F.col("p_partkey") % 3 == 0, F.lit("no line")).otherwise(F.concat(F.lit("Answer: no\nAnswer: n"), F.col("p_size").cast("string")))
    return table(spark, d, "part").select("p_partkey", T.final_answer_line(x).alias("answer"))


@query("latex_clean_up", "SELECT p_partkey, '\\frac{' || p_size || '}{7}' AS slash, '\\sqrt{3}' || p_size AS root, p_size || '' AS units, 'x' || p_size AS unboxed FROM part")
def latex_clean_up(spark, d):
    n = F.col("p_size").cast("string")
    return table(spark, d, "part").select(
        "p_partkey", T.slash_to_frac(F.concat(n, F.lit("/7"))).alias("slash"), T.fix_sqrt(F.concat(F.lit("\\sqrt3"), n)).alias("root"),
        T.cut_units(F.concat(n, F.lit("\\text{ m}"))).alias("units"), T.unbox(F.concat(F.lit("\\boxed{x"), n, F.lit("}"))).alias("unboxed"),
    )


@query("boxed_format", "SELECT p_partkey, p_partkey % 2 = 0 AS fits FROM part")
def boxed_format(spark, d):
    x = F.when(F.col("p_partkey") % 2 == 0, "<think>a\nb</think> so \\boxed{1} end").otherwise("<think>a \\boxed{1}")
    return table(spark, d, "part").select("p_partkey", T.thought_and_box(x).alias("fits"))


@query("trimmed_output_equal", "SELECT p_partkey, p_partkey % 3 <> 0 AS equal FROM part")
def trimmed_output_equal(spark, d):
    out = F.when(F.col("p_partkey") % 3 == 0, "1\n3").otherwise(" 1 \n2\n")
    return table(spark, d, "part").select("p_partkey", T.same_lines(out, F.lit("1\n2 ")).alias("equal"))


@query("pass_rates", f"SELECT user_id, {q('avg(CASE WHEN value > 10 THEN 1 ELSE 0 END)', 'rate')} FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k <= 10 GROUP BY 1")
def pass_rates(spark, d):
    return metrics.pass_rates(table(spark, d, "events"), "user_id", "event_id", F.col("value") > 10, 10).select("user_id", r(F.col("rate"), "rate"))


@query("boxed_scores")
def boxed_scores(spark, d):
    """Boxed answers held against truths after the clean-up, and strictly."""
    n = F.col("p_size").cast("string")
    x = F.concat(F.lit("thus \\boxed{\\dfrac{1}{"), n, F.lit("}}"))
    return table(spark, d, "part").select("p_partkey", M.boxed_score(x, F.concat(F.lit("1/"), n)).alias("score"), M.strict_box(x, F.concat(F.lit("\\dfrac{1}{"), n, F.lit("}"))).alias("strict"), M.cleaned(x).alias("cleaned"))


@query("reward_by_manager", f"WITH {_COMPLETIONS}, f AS (SELECT conv_id, turn, CAST(turn % 4 IN (0, 2) AS INTEGER) AS form, CAST(turn % 4 IN (0, 3) OR (turn % 4 = 2 AND conv_id = 0) AS INTEGER) AS run FROM c) SELECT conv_id, turn, CAST(form AS DOUBLE) AS format, CAST(run AS DOUBLE) AS result, CAST(form + 3 * run AS DOUBLE) AS both FROM f")
def reward_by_manager(spark, d):
    answer, truth = T.sql_answer(F.col("x")), F.concat(F.lit("SELECT "), F.col("conv_id").cast("string"))
    scores = {"format": "format", "result": "result", "both": "format_and_result"}
    return completions(spark, d).select("conv_id", "turn", *[E.reward(m, F.col("x"), answer, truth).alias(n) for n, m in scores.items()])


@query("tool_rewards", "SELECT event_id, user_id, CAST(CASE WHEN value > coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 0) THEN 0 ELSE -0.05 END AS DOUBLE) AS tool_reward FROM events")
def tool_rewards(spark, d):
    return E.tool_rewards(table(spark, d, "events"), "user_id", "event_id", "value").select("event_id", "user_id", "tool_reward")


#: Answers, truths and whether they have the same value; # stands for a number that a row fills in.
ANSWERS = [
    ("thus \\boxed{\\frac{#}{2}}", "#/2", 1.0),
    ("\\boxed{#,000}", "#000", 1.0),
    ("\\boxed{#.50}", "#.5", 1.0),
    ("\\boxed{#\\%}", "#", 1.0),
    ("\\boxed{(1, #]}", "(1,#]", 1.0),
    ("\\boxed{(1, #]}", "(1,#)", 0.0),
    ("\\boxed{x+#}", "#+x", 1.0),
    ("\\boxed{2\\sqrt{#}}", "\\sqrt{4*#}", 1.0),
    ("\\boxed{#}", "# + 1", 0.0),
    ("\\boxed{(x+1)^2}", "x^2+2x+1", 1.0),
    ("no box", "#", 0.0),
    ("#", "#.0", 1.0),
]


@query("answers_by_value", f"WITH x(k, score) AS (VALUES {', '.join(f'({k}, CAST({a[2]} AS DOUBLE))' for k, a in enumerate(ANSWERS))}) SELECT p_partkey, score FROM part JOIN x ON k = p_partkey % {len(ANSWERS)}")
def answers_by_value(spark, d):
    n = F.col("p_size").cast("string")
    said, truth = (F.replace(F.get(F.array(*[F.lit(a[i]) for a in ANSWERS]), (F.col("p_partkey") % len(ANSWERS)).cast("int")), F.lit("#"), n) for i in (0, 1))
    return table(spark, d, "part").select("p_partkey", M.value_score(said, truth).alias("score"))
