"""Queries over skeletons, pools, samples, vectors and retrieval."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import skeleton as S
from tessera.functions import text as T
from tessera.operators import generation as G
from tessera.operators import index as I
from tessera.operators import pool as P
from tessera.operators import retrieval as R
from tessera.operators import vectors as V
from tessera.plans import query, table
from tessera.plans.rollout_queries import q, r
from tessera.plans.shapes import COMMENTED, NORMAL, ROUGH, SHAPES
from tessera.sources.shared import cut, shared_folder

# Skeletons ------------------------------------------------------------------------

def values(rows: list[tuple]) -> str:
    """Numbered rows of strings as SQL."""
    text = lambda x: "CAST(NULL AS VARCHAR)" if x is None else "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({k}, {', '.join(map(text, row))})" for k, row in enumerate(rows))


def filled(x: str) -> str:
    """SQL that puts a part's number and brand into a pattern."""
    return f"replace(replace({x}, '#', CAST(p_size AS VARCHAR)), '@', p_brand)"


_SQL = f"x(k, raw, want) AS (VALUES {values(SHAPES)}), s AS (SELECT p_partkey AS idx, want FROM part JOIN x ON k = p_partkey % {len(SHAPES)})"
_SKELETONS = "k AS (SELECT p_partkey AS idx, p_type || ' ' || p_brand AS skeleton, p_name AS question, 'db' || p_size AS db_id FROM part)"


def sqls(spark, d: str, shapes: list[tuple]) -> DataFrame:
    """Queries with their indexes: patterns that a part's number and brand are put into."""
    raw = F.get(F.array(*[F.lit(x[0]) for x in shapes]), (F.col("p_partkey") % len(shapes)).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("idx"), F.replace(F.replace(raw, F.lit("#"), F.col("p_size").cast("string")), F.lit("@"), F.col("p_brand")).alias("sql"))


def skeletons(spark, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("idx"), F.concat("p_type", F.lit(" "), "p_brand").alias("skeleton"), F.col("p_name").alias("question"), F.concat(F.lit("db"), F.col("p_size").cast("string")).alias("db_id"))


_PLAIN = "replace(replace(replace(want, '<TABLE>', '_'), '<COLUMN>', '_'), '<LITERAL>', '_')"


@query("sql_skeleton", f"WITH {_SQL} SELECT idx, {_PLAIN} AS skeleton, want IS NULL AS failed FROM s")
def sql_skeleton(spark, d):
    found = S.with_skeletons(sqls(spark, d, SHAPES), "sql", "x")
    return found.select("idx", "x.skeleton", F.col("x.error").isNotNull().alias("failed"))


@query("sql_typed_skeleton", f"WITH {_SQL} SELECT idx, want AS skeleton FROM s")
def sql_typed_skeleton(spark, d):
    return S.with_skeletons(sqls(spark, d, SHAPES), "sql", "x", typed=True).select("idx", "x.skeleton")


@query("skeleton_to_underscores", f"WITH {_SQL} SELECT idx, {_PLAIN} || idx AS underscore, want || idx AS typed FROM s WHERE want IS NOT NULL")
def skeleton_to_underscores(spark, d):
    typed = F.get(F.array(*[F.lit(x[1]) for x in SHAPES]), (F.col("p_partkey") % len(SHAPES)).cast("int"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("idx"), F.concat(typed, F.col("p_partkey").cast("string")).alias("x")).where("x IS NOT NULL")
    return rows.select("idx", S.for_embedding(F.col("x"), "underscore").alias("underscore"), S.for_embedding(F.col("x"), "typed").alias("typed"))


@query("sql_without_comments", f"WITH x(k, raw, want) AS (VALUES {values(COMMENTED)}) SELECT p_partkey AS idx, {filled('want')} AS sql FROM part JOIN x ON k = p_partkey % {len(COMMENTED)}")
def sql_without_comments(spark, d):
    return sqls(spark, d, COMMENTED).select("idx", S.without_comments(F.col("sql")).alias("sql"))


@query("fallback_skeleton", f"WITH x(k, raw, rough, simple) AS (VALUES {values(ROUGH)}) SELECT p_partkey AS idx, rough, simple FROM part JOIN x ON k = p_partkey % {len(ROUGH)}")
def fallback_skeleton(spark, d):
    x = sqls(spark, d, ROUGH).withColumn("rough", S.fallback(F.col("sql")))
    return x.select("idx", "rough", S.simplify(F.col("rough")).alias("simple"))


@query("normalised_sql", f"WITH x(k, raw, want) AS (VALUES {values(NORMAL)}) SELECT p_partkey AS idx, {filled('want')} AS sql FROM part JOIN x ON k = p_partkey % {len(NORMAL)}")
def normalised_sql(spark, d):
    return sqls(spark, d, NORMAL).select("idx", S.normalised_sql(F.col("sql")).alias("sql"))


@query(
    "bag_jaccard",
    f"""WITH t AS (SELECT p_partkey AS idx, unnest(string_split(p_name || ' ' || p_type, ' ')) AS w FROM part), u AS (SELECT p_partkey AS idx, unnest(string_split(p_type || ' ' || p_name || ' ' || p_type, ' ')) AS w FROM part),
    a AS (SELECT idx, w, count(*) AS n FROM t GROUP BY 1, 2), b AS (SELECT idx, w, count(*) AS n FROM u GROUP BY 1, 2), m AS (SELECT a.idx, sum(least(a.n, b.n)) AS s FROM a JOIN b USING (idx, w) GROUP BY 1),
    x AS (SELECT idx, sum(n) AS n FROM a GROUP BY 1), y AS (SELECT idx, sum(n) AS n FROM b GROUP BY 1) SELECT idx, {q('s / (x.n + y.n - s)', 'similarity')} FROM m JOIN x USING (idx) JOIN y USING (idx)""",
)
def bag_jaccard(spark, d):
    a, b = F.concat_ws(" ", "p_name", "p_type"), F.concat_ws(" ", "p_type", "p_name", "p_type")
    return table(spark, d, "part").select(F.col("p_partkey").alias("idx"), r(S.bag_jaccard(a, b), "similarity"))


@query("number_tests", "WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '-' || p_size WHEN 1 THEN CAST(p_size AS VARCHAR) || '.5' WHEN 2 THEN p_brand ELSE '-' || p_size || '.25' END AS x FROM part) SELECT p_partkey, x, p_partkey % 4 <> 2 AS is_float, p_partkey % 4 = 0 AS is_negative_int FROM t")
def number_tests(spark, d):
    n, k = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    x = F.when(k == 0, F.concat(F.lit("-"), n)).when(k == 1, F.concat(n, F.lit(".5"))).when(k == 2, F.col("p_brand")).otherwise(F.concat(F.lit("-"), n, F.lit(".25")))
    return table(spark, d, "part").select("p_partkey", x.alias("x"), T.is_float(x).alias("is_float"), T.is_negative_int(x).alias("is_negative_int"))


@query("identifier_suffixes", "SELECT n_nationkey, 'main.nation.' || lower(n_name) AS name, ['main.nation.' || lower(n_name), 'nation.' || lower(n_name), lower(n_name)] AS suffixes, n_nationkey % 2 = 0 AS masked FROM nation")
def identifier_suffixes(spark, d):
    x = S.normal_identifier(F.concat(F.lit(' "Main".`Nation`.['), "n_name", F.lit("];")))
    names = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.concat(F.lit("nation."), F.lower("n_name")))).otherwise(F.array(F.lit("none")))
    return table(spark, d, "nation").select("n_nationkey", x.alias("name"), S.suffixes(x).alias("suffixes"), S.is_schema_name(x, names).alias("masked"))


@query("schema_name_sets", "SELECT 'r' || n_regionkey AS db_id, list(DISTINCT lower(n_name) ORDER BY lower(n_name)) AS names FROM nation GROUP BY 1")
def schema_name_sets(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("db_id"), "n_name")
    return S.names_by_database(n, "db_id", "n_name")


# Pools ----------------------------------------------------------------------------

_POOL = f"{_SKELETONS}, p AS (SELECT skeleton, count(*) AS count, min(idx) AS first_idx, arg_min(question, idx) AS first_question, list_slice(list(idx ORDER BY idx), 1, 20) AS source_indices FROM k GROUP BY skeleton)"


def the_pool(spark, d: str) -> DataFrame:
    return P.pool(skeletons(spark, d), "skeleton", "idx", ["question"])


@query("skeleton_pool", f"WITH {_POOL} SELECT row_number() OVER (ORDER BY first_idx) - 1 AS pool_id, * FROM p")
def skeleton_pool(spark, d):
    return the_pool(spark, d)


@query("pool_success_split", f"WITH {_SKELETONS} SELECT idx, CASE WHEN idx % 7 = 0 OR idx % 5 = 0 THEN 'error' ELSE 'success' END AS part FROM k")
def pool_success_split(spark, d):
    x = skeletons(spark, d).select("idx", F.when(F.col("idx") % 7 != 0, F.col("skeleton")).alias("skeleton"), F.when(F.col("idx") % 5 == 0, "failed").alias("error"))
    good, bad = P.split_by_success(x)
    return good.select("idx", F.lit("success").alias("part")).unionByName(bad.select("idx", F.lit("error").alias("part")))


@query("skeleton_entries", f"WITH {_SKELETONS}, e AS (SELECT skeleton, count(*) AS count FROM k GROUP BY 1), f AS (SELECT row_number() OVER (ORDER BY skeleton) - 1 AS fid, * FROM e) SELECT fid, skeleton, count, row_number() OVER (PARTITION BY skeleton ORDER BY idx) - 1 AS place, idx, db_id FROM f JOIN k USING (skeleton)")
def skeleton_entries(spark, d):
    return P.entries(skeletons(spark, d), "skeleton", ["db_id"], "idx")


@query("pool_frequency_buckets", f"WITH {_POOL} SELECT CAST(sum(count) AS BIGINT) AS used, count(*) AS unique, round(sum(count) / count(*), 4) AS mean, max(count) AS most, count(*) FILTER (count = 1) AS once, count(*) FILTER (count BETWEEN 2 AND 5) AS few, count(*) FILTER (count BETWEEN 6 AND 10) AS some, count(*) FILTER (count >= 11) AS many FROM p")
def pool_frequency_buckets(spark, d):
    return P.frequency_profile(the_pool(spark, d))


@query("pool_top50", f"WITH {_POOL} SELECT skeleton, count FROM p ORDER BY count DESC, first_idx LIMIT 50")
def pool_top50(spark, d):
    return P.most_frequent(the_pool(spark, d), 50, "first_idx").select("skeleton", "count")


@query("failure_reason_counts", "SELECT coalesce(nullif(event_type, 'error'), 'unknown') AS reason, count(*) AS n FROM events GROUP BY 1")
def failure_reason_counts(spark, d):
    return P.reason_counts(table(spark, d, "events").select(F.nullif("event_type", F.lit("error")).alias("reason")), "reason")


@query("last_success_per_rank", "SELECT user_id AS rank, max(event_id) AS place, arg_max(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1")
def last_success_per_rank(spark, d):
    x = table(spark, d, "events").select(F.col("user_id").alias("rank"), F.col("event_id").alias("place"), "value", F.col("event_type").alias("status"))
    return P.last_by_rank(x, "rank", "place", "status", "purchase").select("rank", "place", "value")


@query("main_output", "SELECT user_id AS rank, arg_max(value, event_id) AS value FROM events WHERE event_type = 'purchase'  GROUP BY 1")
def main_output(spark, d):
    return last_success_per_rank(spark, d).select("rank", "value")


@query("output_stats", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def output_stats(spark, d):
    return P.output_stats(table(spark, d, "events"), "event_type", "user_id").select("event_type", "n", F.col("distinct").alias("users"))


@query("demo_bank", f"WITH {_SKELETONS} SELECT db_id, count(*) OVER (PARTITION BY db_id) AS demos, count(*) FILTER (idx % 7 = 0) OVER (PARTITION BY db_id) AS failed, row_number() OVER (PARTITION BY db_id ORDER BY idx) - 1 AS place, idx FROM k")
def demo_bank(spark, d):
    return P.demonstrations(skeletons(spark, d).withColumn("failed", F.col("idx") % 7 == 0), "db_id", "idx", "failed").select("db_id", "demos", "failed", "place", "idx")


@query("error_summary", "SELECT count(*) AS errors, list(DISTINCT event_type ORDER BY event_type) AS kinds FROM events WHERE value < 5")
def error_summary(spark, d):
    return G.error_summary(table(spark, d, "events").where("value < 5"), "event_type")


# Samples --------------------------------------------------------------------------


@query("demos_per_db", f"WITH {_SKELETONS} SELECT db_id, idx FROM (SELECT *, row_number() OVER (PARTITION BY db_id ORDER BY idx) AS r FROM k) WHERE r <= 6")
def demos_per_db(spark, d):
    return P.first_n_by_group(skeletons(spark, d), "db_id", ["idx"], 6).select("db_id", "idx")


@query("type_budgets", "WITH c AS (SELECT source AS kind, count(*) AS n FROM documents GROUP BY 1), b AS (SELECT *, greatest(1, CAST(floor(n / sum(n) OVER () * 50) AS BIGINT)) AS b FROM c) SELECT kind, n, CASE WHEN sum(b) OVER () > 50 THEN greatest(1, CAST(floor(b / sum(b) OVER () * 50) AS BIGINT)) ELSE b END AS budget FROM b")
def type_budgets(spark, d):
    return P.type_budgets(table(spark, d, "documents").groupBy(F.col("source").alias("kind")).agg(F.count(F.lit(1)).alias("n")), 50)


@query("budget_split", "SELECT p_partkey, greatest(0, 512 - p_size * 13) AS effective, CAST(floor(greatest(0, 512 - p_size * 13) * 0.5) AS BIGINT) AS random FROM part")
def budget_split(spark, d):
    effective, drawn = P.budget_split(F.col("p_size") * 13, 512, 0.5)
    return table(spark, d, "part").select("p_partkey", effective.alias("effective"), drawn.alias("random"))


@query("sample_exact")
def sample_exact(spark, d):
    return P.sample_exact(skeletons(spark, d), "idx", 100, 42).select("idx", "skeleton")


@query("sample_weighted")
def sample_weighted(spark, d):
    return P.resample_weighted(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey", F.col("p_size") ** 2, 1000, 42)


@query("stratified_quota")
def stratified_quota(spark, d):
    c = table(spark, d, "lineitem").select((F.col("l_linenumber") % 5).alias("rank"), F.col("l_partkey").alias("idx"))
    return P.stratified_quota(c, [0.35, 0.25, 0.2, 0.1, 0.1], 512, 42)


@query("seeded_order")
def seeded_order(spark, d):
    """A reproducible permutation, and seeds of rows that don't depend on it."""
    from tessera.operators import batches

    x = table(spark, d, "nation").select("n_nationkey", F.xxhash64("n_nationkey", F.lit(42)).alias("h"), F.xxhash64(F.lit(42), "n_nationkey").alias("seed"))
    return batches.number(x, ["h", "n_nationkey"], "place").select("n_nationkey", "place", "seed")


@query("random_fill")
def random_fill(spark, d):
    """Rows not yet taken, in hash order."""
    taken = table(spark, d, "orders").select(F.col("o_custkey").alias("idx"))
    return P.sample_rest(skeletons(spark, d), taken, "idx", 50, 7).select("idx")


# Vectors --------------------------------------------------------------------------

_UNIT = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE))))) AS e FROM embeddings)"
_NEAR = f"{_UNIT}, s AS (SELECT a.vec_id AS a, b.vec_id AS b, list_inner_product(a.e, b.e) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id), n AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(s, 12) DESC, b) AS rank FROM s QUALIFY rank <= 10)"
_OUT = f"{_NEAR}, o AS (SELECT a AS vec_id, max(s) AS nearest_sim, avg(s) AS mean_sim, 1 - avg(s) AS outlier FROM n GROUP BY a)"


def scores(spark, d: str) -> DataFrame:
    """Cut off, as most queries read them several times."""
    return cut(V.outliers(table(spark, d, "embeddings"), "vec_id", 10))


@query("normalised_vectors", f"WITH {_UNIT} SELECT vec_id, CAST(1 AS BIGINT) AS length, {q('list_sum(list_transform(e, lambda x: x * x))', 'norm')}, {q('e[1]', 'first')} FROM v")
def normalised_vectors(spark, d):
    x = table(spark, d, "embeddings").withColumn("e", A.normalise(F.col("embedding")))
    return x.select("vec_id", F.lit(1).cast("long").alias("length"), r(A.dot(F.col("e"), F.col("e")), "norm"), r(F.col("e")[0], "first"))


@query("knn_topk", f"WITH {_NEAR} SELECT a AS query, CAST(rank AS INTEGER) AS rank, b AS neighbour, {q('s', 'similarity')} FROM n WHERE rank <= 5")
def knn_topk(spark, d):
    e = table(spark, d, "embeddings")
    return V.nearest(e, e, "vec_id", 5, same=True).select("query", "rank", "neighbour", r(F.col("similarity"), "similarity"))


@query("outlier_scores", f"WITH {_OUT} SELECT vec_id, {q('nearest_sim', 'nearest_sim')}, {q('mean_sim', 'mean_sim')}, {q('outlier', 'outlier')} FROM o")
def outlier_scores(spark, d):
    return scores(spark, d).select("vec_id", *[r(F.col(c), c) for c in ("nearest_sim", "mean_sim", "outlier")])


@query("outlier_percentiles", f"WITH {_OUT} SELECT p, {q('(SELECT quantile_cont(outlier, [0.5, 0.75, 0.9, 0.95, 0.97, 0.99, 0.995, 0.999, 1.0]) FROM o)[i]', 'value')} FROM (SELECT unnest([50.0, 75.0, 90.0, 95.0, 97.0, 99.0, 99.5, 99.9, 100.0]) AS p, unnest(range(1, 10)) AS i)")
def outlier_percentiles(spark, d):
    at = [50.0, 75.0, 90.0, 95.0, 97.0, 99.0, 99.5, 99.9, 100.0]
    return P.percentiles(scores(spark, d), "outlier", at).select("p", r(F.col("value"), "value"))


@query("outlier_topn", f"WITH {_OUT} SELECT vec_id, {q('outlier', 'outlier')} FROM o ORDER BY round(outlier, 12) DESC, vec_id LIMIT 30")
def outlier_topn(spark, d):
    return scores(spark, d).orderBy(F.desc(F.round("outlier", 12)), "vec_id").limit(30).select("vec_id", r(F.col("outlier"), "outlier"))


@query("outlier_bucket_samples", f"WITH {_OUT}, t AS (SELECT CAST(0.9 AS DOUBLE) AS p, quantile_cont(outlier, 0.9) AS edge FROM o UNION ALL SELECT CAST(0.99 AS DOUBLE), quantile_cont(outlier, 0.99) FROM o) SELECT p, vec_id FROM (SELECT p, vec_id, row_number() OVER (PARTITION BY p ORDER BY round(outlier, 12) DESC, vec_id) AS k FROM o, t WHERE outlier >= edge) WHERE k <= 50")
def outlier_bucket_samples(spark, d):
    x = scores(spark, d)
    edges = P.percentiles(x, "outlier", [90.0, 99.0]).select((F.col("p") / 100).alias("p"), F.col("value").alias("edge"))
    return P.above_edges(x, edges, "outlier", "vec_id", 50).select("p", "vec_id")


@query("outlier_filter", f"WITH {_OUT} SELECT vec_id FROM o WHERE outlier <= 0.75")
def outlier_filter(spark, d):
    return V.keep_inliers(scores(spark, d), 0.75, 1).select("vec_id")


@query("one_nn_min_dist", f"WITH {_UNIT} SELECT a.vec_id, {q('1 - max(list_inner_product(a.e, b.e))', 'distance')} FROM v a, v b WHERE a.label <> 0 AND b.label = 0 GROUP BY 1")
def one_nn_min_dist(spark, d):
    e = table(spark, d, "embeddings")
    return V.distance_to(e.where("label <> 0"), e.where("label = 0"), "vec_id").select("vec_id", r(F.col("distance"), "distance"))


@query("index_search", f"WITH {_NEAR} SELECT a AS query, CAST(rank AS INTEGER) AS rank, b AS neighbour, {q('s', 'similarity')} FROM n WHERE rank <= 5 AND a % 100 = 0")
def index_search(spark, d):
    """Every hundredth vector against an index of all that is written and read again, with all cells searched: exact."""
    index = I.build(table(spark, d, "embeddings"), "vec_id", f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    asked = table(spark, d, "embeddings").where("vec_id % 100 = 0")
    found = I.search(I.load(spark, index.path), asked, "vec_id", 5, probes=index.cells, same=True)
    return found.select("query", "rank", "neighbour", r(F.col("similarity"), "similarity"))


@query("index_recall")
def index_recall(spark, d):
    """Share of the exact five neighbours of every hundredth vector that a search of few cells finds."""
    e = table(spark, d, "embeddings")
    index = I.build(e, "vec_id", f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    asked = e.where("vec_id % 100 = 0")
    found = I.search(index, asked, "vec_id", 5, same=True)
    return I.recall(found, V.nearest(asked, e, "vec_id", 5, same=True))


@query("kcenter")
def kcenter(spark, d):
    """Ten complementary vectors: farthest first from label 0."""
    e = table(spark, d, "embeddings")
    rest = e.where("label <> 0")
    return V.farthest_first(rest, V.distance_to(rest, e.where("label = 0"), "vec_id"), "vec_id", 10)


@query("embedded_texts")
def embedded_texts(spark, d):
    return V.embed(table(spark, d, "benchmark"), "item_id", "text")


@query("train_skeleton_or_default", f"WITH {_SKELETONS} SELECT idx, CASE WHEN idx % 7 = 0 THEN 'select _' ELSE skeleton END AS skeleton FROM k")
def train_skeleton_or_default(spark, d):
    return skeletons(spark, d).select("idx", S.or_default(F.when(F.col("idx") % 7 != 0, F.col("skeleton")), "select _").alias("skeleton"))


@query("compact_records", "SELECT doc_id, substr(text, 1, 100) AS sql, substr(source, 1, 3) AS question FROM documents")
def compact_records(spark, d):
    return P.compact(table(spark, d, "documents"), ["doc_id"], {"sql": (F.col("text"), 100), "question": (F.col("source"), 3)})


# Retrieval ------------------------------------------------------------------------

_FAILED = "f AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'bank' ELSE 'train' END AS split, o_custkey AS index, o_orderkey AS seen FROM orders WHERE o_orderstatus = 'F')"


def failed(spark, d: str) -> DataFrame:
    return table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.when(F.col("o_orderkey") % 3 == 0, "bank").otherwise("train").alias("split"), F.col("o_custkey").alias("index"), F.col("o_orderkey").alias("seen"))


@query("failed_queries", f"WITH {_FAILED} SELECT split, index, min(seen) AS seen FROM f GROUP BY 1, 2")
def failed_queries(spark, d):
    return R.distinct_failures(failed(spark, d))


@query("failed_embeddings", f"WITH {_FAILED}, u AS (SELECT DISTINCT split, index FROM f) SELECT split, count(*) AS asked, count(vec_id) AS found FROM u LEFT JOIN embeddings ON vec_id = index GROUP BY 1")
def failed_embeddings(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("index"), "embedding")
    return R.resolve(R.distinct_failures(failed(spark, d)), e).groupBy("split").agg(F.count(F.lit(1)).alias("asked"), F.count("embedding").alias("found"))


@query("rank_candidates", "SELECT DISTINCT CAST(l_linenumber % 5 AS INTEGER) AS rank, l_partkey AS idx FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND l_partkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def rank_candidates(spark, d):
    knn = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("fid"))
    entries = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("fid"), (F.col("l_linenumber") % 5).alias("rank"), F.col("l_partkey").alias("idx"))
    added = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("idx"))
    return R.rank_candidates(knn, entries, added)


@query("candidate_entries", "SELECT p_partkey AS idx, p_name AS sql FROM part WHERE p_partkey IN (SELECT o_custkey FROM orders) AND p_name IS NOT NULL AND p_name <> ''")
def candidate_entries(spark, d):
    wanted = table(spark, d, "orders").select(F.col("o_custkey").alias("idx")).distinct()
    return R.candidate_entries(wanted, table(spark, d, "part").select(F.col("p_partkey").alias("idx"), F.col("p_name").alias("sql")))


@query("retrieval_stats", f"SELECT count(DISTINCT o_custkey) AS added, (SELECT count(*) FROM part) - count(DISTINCT o_custkey) AS remaining, {q('count(DISTINCT o_custkey) / (SELECT count(*) FROM part)', 'utilization')} FROM orders WHERE o_custkey IN (SELECT p_partkey FROM part)")
def retrieval_stats(spark, d):
    bank = table(spark, d, "part").select(F.col("p_partkey").alias("idx"))
    return R.stats(table(spark, d, "orders").select(F.col("o_custkey").alias("idx")), bank).select("added", "remaining", r(F.col("utilization"), "utilization"))


@query("first_listed_category", "SELECT p_partkey, CASE WHEN p_size % 20 BETWEEN 17 AND 30 THEN p_size % 20 WHEN (p_size + 9) % 32 BETWEEN 17 AND 30 THEN (p_size + 9) % 32 ELSE -1 END AS category FROM part")
def first_listed_category(spark, d):
    json = F.format_string('{"categories":[{"id":%d},{"id":%d}]}', F.col("p_size") % 20, (F.col("p_size") + 9) % 32)
    return table(spark, d, "part").select("p_partkey", F.coalesce(R.first_category(json, list(range(17, 31))), F.lit(-1)).alias("category"))


@query("reranked_candidates", "SELECT p_partkey, [p_partkey * 10 + 2, p_partkey * 10 + 1] AS chosen FROM part")
def reranked_candidates(spark, d):
    x = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.col("p_partkey") * 10 + i)
    said = F.array(F.lit(2), F.lit(9), F.lit(2), F.lit(1), F.lit(3))
    return table(spark, d, "part").select("p_partkey", R.by_place(x, said, 2).alias("chosen"))


@query("candidate_list", "SELECT n_regionkey, string_agg(k || '. ' || n_name, chr(10) ORDER BY k) AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation) GROUP BY 1")
def candidate_list(spark, d):
    names = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"])
    return table(spark, d, "nation").groupBy("n_regionkey").agg(names.alias("x")).select("n_regionkey", R.numbered_list(F.col("x")).alias("prompt"))


@query("structural_errors", "SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey BETWEEN 17 AND 30")
def structural_errors(spark, d):
    return R.structural(table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), "id", range(17, 31))


@query("diagnosis_stats", "SELECT count(*) AS diagnosed, count(*) FILTER (p_size BETWEEN 17 AND 30) AS structural, count(*) FILTER (p_size NOT BETWEEN 17 AND 30) AS other FROM part")
def diagnosis_stats(spark, d):
    return R.diagnosis_stats(table(spark, d, "part"), "p_size", range(17, 31))


@query("augmented_training_set", "SELECT n_nationkey AS sample_id, n_name AS name, CAST(NULL AS VARCHAR) AS origin FROM nation UNION ALL SELECT (SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY r_regionkey), r_name, 'new' FROM region")
def augmented_training_set(spark, d):
    old = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("sample_id"), F.col("n_name").alias("name"))
    new = table(spark, d, "region").select("r_regionkey", F.col("r_name").alias("name"), F.lit("new").alias("origin"))
    return R.augment(old, new, "sample_id", ["r_regionkey"])


@query("sft_batches", "SELECT item_id, (row_number() OVER (ORDER BY item_id) - 1) // 16 AS batch FROM benchmark QUALIFY batch < (SELECT count(*) // 16 FROM benchmark)")
def sft_batches(spark, d):
    return R.full_batches(table(spark, d, "benchmark").select("item_id"), ["item_id"], 16)


@query("excluded_by_epoch", "SELECT epoch, idx FROM (SELECT idx, min(epoch) AS epoch FROM (SELECT o_custkey AS idx, CAST(o_orderkey % 4 AS INTEGER) AS epoch FROM orders) GROUP BY 1)")
def excluded_by_epoch(spark, d):
    """Each epoch's rows less those that an earlier one has."""
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("idx"), (F.col("o_orderkey") % 4).cast("int").alias("epoch"))
    return R.first_epochs(rows, "idx", "epoch").select("epoch", "idx")