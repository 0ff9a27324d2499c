"""Queries over rollouts and token sequences, derived from the table lineitem."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.operators import metrics as M
from tessera.operators import preferences as P
from tessera.operators import rollouts as R
from tessera.plans import query, table
from tessera.sources import files

#: Rollouts: an order is a prompt, its lines are samples with rewards from 0 to 4.
ROLLOUTS = """rollouts AS (SELECT l_orderkey AS uid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS sample,
  CAST(CAST(l_quantity AS BIGINT) % 5 AS DOUBLE) AS reward, CAST(l_partkey % 11 + 1 AS DOUBLE) AS n_tokens,
  CAST(l_suppkey % 13 AS DOUBLE) AS score FROM lineitem)"""
#: Tokens of the rollouts with positions, rewards, log-probabilities and values.
TOKENS = """tokens AS (SELECT uid, sample, n_tokens, pos, CAST((uid + sample * 3 + pos * 7) % 10 AS DOUBLE) / 10 AS reward,
  -CAST((uid * 3 + pos) % 17 AS DOUBLE) / 10 AS logp, -CAST((uid + pos * 5) % 13 AS DOUBLE) / 10 AS ref,
  CAST((sample + pos) % 7 AS DOUBLE) / 7 AS val, CAST((uid + pos) % 9 AS DOUBLE) / 9 AS ent, CASE WHEN (uid + pos) % 4 = 0 THEN 0.0 ELSE 1.0 END AS m
  FROM rollouts, (SELECT unnest(range(0, 11)) AS pos) WHERE pos < n_tokens)"""


#: Lines in one partition, about: what sorts and windows of a task hold doesn't grow with the table.
LINES = 250_000


def lines(spark, d: str) -> DataFrame:
    """The table lineitem, dealt out by order; into more partitions than Spark would make if it is large."""
    x = table(spark, d, "lineitem")
    n = -(-x.count() // LINES)
    return x.repartition(n, "l_orderkey") if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else x


def rollouts(spark, d: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return lines(spark, d).select(
        F.col("l_orderkey").alias("uid"),
        F.row_number().over(w).cast("long").alias("sample"),
        (F.col("l_quantity").cast("long") % 5).cast("double").alias("reward"),
        (F.col("l_partkey") % 11 + 1).cast("double").alias("n_tokens"),
        (F.col("l_suppkey") % 13).cast("double").alias("score"),
    )


def tokens(spark, d: str) -> DataFrame:
    uid, s, p = F.col("uid"), F.col("sample"), F.col("pos")
    out = rollouts(spark, d).select("uid", "sample", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_tokens").cast("long") - 1)).alias("pos"))
    return out.select(
        "*",
        (((uid + s * 3 + p * 7) % 10).cast("double") / 10).alias("reward"),
        (-((uid * 3 + p) % 17).cast("double") / 10).alias("logp"),
        (-((uid + p * 5) % 13).cast("double") / 10).alias("ref"),
        (((s + p) % 7).cast("double") / 7).alias("val"),
        (((uid + p) % 9).cast("double") / 9).alias("ent"),
        F.when((uid + p) % 4 == 0, 0.0).otherwise(1.0).alias("m"),
    )


def sequences(spark, d: str) -> DataFrame:
    """Tokens as arrays, by a fold per row instead of a shuffle."""
    uid, s = F.col("uid"), F.col("sample")
    at = F.sequence(F.lit(0).cast("long"), F.col("n_tokens").cast("long") - 1)
    return rollouts(spark, d).select(
        "uid", "sample", "n_tokens",
        F.transform(at, lambda p: ((uid + s * 3 + p * 7) % 10).cast("double") / 10).alias("rewards"),
        F.transform(at, lambda p: -((uid * 3 + p) % 17).cast("double") / 10).alias("logps"),
        F.transform(at, lambda p: -((uid + p * 5) % 13).cast("double") / 10).alias("refs"),
        F.transform(at, lambda p: ((s + p) % 7).cast("double") / 7).alias("vals"),
        F.transform(at, lambda p: F.when((uid + p) % 4 == 0, 0.0).otherwise(1.0)).alias("mask"),
        F.transform(at, lambda p: (uid + p) % 6).alias("ids"),
    )


def r(x: Column, name: str, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return (F.round(x, digits) + F.lit(0.0)).alias(name)


def q(x: str, name: str, digits: int = 6) -> str:
    return f"round(CAST({x} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE) AS {name}"


def advantage(name: str, f, sql: str, extra: str = "") -> None:
    """A query for an advantage of whole rollouts."""
    body = f"WITH {ROLLOUTS}{extra} SELECT uid, sample, {q('advantage', 'advantage')} FROM ({sql})"

    @query(name, body)
    def run(spark, d):
        return f(rollouts(spark, d)).select("uid", "sample", r(F.col("advantage"), "advantage"))


N = "count(*) OVER (PARTITION BY uid)"
MEAN = "avg(reward) OVER (PARTITION BY uid)"
advantage("adv_grpo", lambda x: R.grpo(x, False), f"SELECT uid, sample, reward - CASE WHEN {N} = 1 THEN 0 ELSE {MEAN} END AS advantage FROM rollouts")
advantage(
    "adv_grpo_std", R.grpo,
    f"SELECT uid, sample, (reward - CASE WHEN {N} = 1 THEN 0 ELSE {MEAN} END) / (CASE WHEN {N} = 1 THEN 1 ELSE stddev_samp(reward) OVER (PARTITION BY uid) END + 1e-6) AS advantage FROM rollouts",
)
advantage("adv_rloo", R.rloo, f"SELECT uid, sample, CASE WHEN {N} = 1 THEN reward ELSE reward * {N} / ({N} - 1) - {MEAN} * {N} / ({N} - 1) END AS advantage FROM rollouts")
advantage(
    "adv_opo", R.opo,
    f"SELECT uid, sample, reward - CASE WHEN {N} = 1 THEN 0 ELSE sum(reward * n_tokens) OVER (PARTITION BY uid) / sum(n_tokens) OVER (PARTITION BY uid) END AS advantage FROM rollouts",
)
advantage(
    "adv_pass_at_k", lambda x: R.pass_at_k(x.join(x.groupBy("uid").count().where("count > 1"), "uid", "left_semi")),
    f"""SELECT uid, sample, CASE WHEN k = 1 THEN reward - second ELSE 0 END AS advantage FROM (SELECT *, row_number() OVER w AS k, lead(reward) OVER w AS second, {N} AS n
    FROM rollouts WINDOW w AS (PARTITION BY uid ORDER BY reward DESC, sample)) WHERE n > 1""",
)
advantage(
    "adv_reinforce_baseline", R.reinforce_baseline,
    "SELECT uid, sample, (c - mean) / sqrt(var + 1e-8) AS advantage FROM c, m",
    f""", c AS (SELECT *, reward - CASE WHEN {N} = 1 THEN 0 ELSE {MEAN} END AS c FROM rollouts),
    m0 AS (SELECT sum(n_tokens * c) / (sum(n_tokens) + 1e-8) AS mean, sum(n_tokens) AS n FROM c),
    m AS (SELECT any_value(mean) AS mean, sum(n_tokens * (c - mean) * (c - mean)) / (any_value(n) + 1e-8) * any_value(n) / (any_value(n) - 1) AS var FROM c, m0)""",
)
advantage("adv_soft_mean", R.soft_advantage, "SELECT uid, sample, reward - s AS advantage FROM rollouts, (SELECT max(reward) + ln(avg(exp(reward - (SELECT max(reward) FROM rollouts)))) AS s FROM rollouts)")


@query("solve_status", f"WITH {ROLLOUTS} SELECT uid, max(reward) < 4 AS solve_none, min(reward) = 4 AND max(reward) = 4 AS solve_all, sum(reward) AS total FROM rollouts GROUP BY uid")
def solve_status(spark, d):
    return R.solve_status(rollouts(spark, d))


@query(
    "solve_ratios",
    f"""WITH {ROLLOUTS}, g AS (SELECT max(reward) < 4 AS a, min(reward) = 4 AND max(reward) = 4 AS b FROM rollouts GROUP BY uid)
    SELECT (SELECT count(*) FROM g WHERE a) AS solve_none, (SELECT count(*) FROM g WHERE b) AS solve_all,
    {q('avg(CASE WHEN reward = 4 THEN 1 ELSE 0 END)', 'solved')}, {q('avg(CASE WHEN reward <> 4 THEN 1 ELSE 0 END)', 'failed')} FROM rollouts""",
)
def solve_ratios(spark, d):
    return R.solve_ratios(rollouts(spark, d)).select("solve_none", "solve_all", r(F.col("solved"), "solved"), r(F.col("failed"), "failed"))


@query(
    "first_failed_rollout",
    f"WITH {ROLLOUTS} SELECT uid, min(sample) AS sample, arg_min(reward, sample) AS reward FROM rollouts GROUP BY uid HAVING max(reward) < 4",
)
def first_failed_rollout(spark, d):
    return R.first_failed(rollouts(spark, d))


@query(
    "sft_buffer_slice",
    f"""WITH {ROLLOUTS}, f AS (SELECT uid, min(sample) AS sample, arg_min(reward, sample) AS reward FROM rollouts GROUP BY uid HAVING max(reward) < 4)
    SELECT uid, sample, reward, CASE WHEN row_number() OVER (ORDER BY uid) <= 64 THEN 'slice' ELSE 'rest' END AS part FROM f""",
)
def sft_buffer_slice(spark, d):
    head, rest = R.take_buffer(R.first_failed(rollouts(spark, d)), 64, ["uid", "sample"])
    return head.withColumn("part", F.lit("slice")).unionByName(rest.withColumn("part", F.lit("rest")))


@query(
    "dynamic_sampling_filter",
    f"WITH {ROLLOUTS} SELECT uid, sample, reward FROM (SELECT *, stddev_pop(reward) OVER (PARTITION BY uid) AS s, {N} AS n FROM rollouts) WHERE s > 0 OR n = 1",
)
def dynamic_sampling_filter(spark, d):
    return R.dynamic_sampling(rollouts(spark, d)).select("uid", "sample", "reward")


@query(
    "dynamic_sampling_first_prompts",
    f"""WITH {ROLLOUTS}, k AS (SELECT uid, sample, reward FROM (SELECT *, stddev_pop(reward) OVER (PARTITION BY uid) AS s, {N} AS n FROM rollouts) WHERE s > 0 OR n = 1)
    SELECT * FROM k WHERE uid IN (SELECT DISTINCT uid FROM k ORDER BY uid LIMIT 128)""",
)
def dynamic_sampling_first_prompts(spark, d):
    return R.first_groups(R.dynamic_sampling(rollouts(spark, d)).select("uid", "sample", "reward"), 128)


@query(
    "accuracy_band_filter",
    f"""WITH {ROLLOUTS}, g AS (SELECT uid, avg(CASE WHEN reward = 4 THEN 1.0 ELSE 0.0 END) AS acc, max(n_tokens) AS longest FROM rollouts GROUP BY uid),
    p AS (SELECT uid, acc, acc >= 0.2 AND acc <= 0.8 AND longest < 11 AS passes FROM g)
    SELECT uid, {q('acc', 'acc')}, passes FROM p ORDER BY passes DESC, uid LIMIT (SELECT CAST(floor(count(*) / 4) AS BIGINT) FROM p)""",
)
def accuracy_band_filter(spark, d):
    return R.accuracy_band(rollouts(spark, d), 0.2, 0.8, 11, 4.0).select("uid", r(F.col("acc"), "acc"), "passes")


@query(
    "reward_by_source",
    f"""WITH {ROLLOUTS}, p AS (SELECT uid, uid % 5 AS source, avg(reward) AS mean, avg(n_tokens) AS len FROM rollouts GROUP BY uid)
    SELECT source, {q('avg(mean)', 'score')}, {q('avg(len)', 'length')}, count(*) AS prompts FROM p GROUP BY source""",
)
def reward_by_source(spark, d):
    x = rollouts(spark, d).withColumn("source", F.col("uid") % 5)
    return M.by_source(x, "source", "uid", "reward", "n_tokens").select("source", r(F.col("score"), "score"), r(F.col("length"), "length"), "prompts")


@query(
    "validation_arrays",
    f"WITH {ROLLOUTS} SELECT uid, list(reward ORDER BY sample) AS rewards, list(n_tokens ORDER BY sample) AS lengths, {q('sum(reward) / count(*)', 'acc')} FROM rollouts GROUP BY uid",
)
def validation_arrays(spark, d):
    x = rollouts(spark, d)
    lists = files.ordered_lists(x.select("uid", "sample", F.col("reward").alias("rewards"), F.col("n_tokens").alias("lengths")), "uid", "sample", ["rewards", "lengths"])
    return lists.join(x.groupBy("uid").agg(r(F.sum("reward") / F.count(F.lit(1)), "acc")), "uid")


@query(
    "best_so_far",
    """WITH s AS (SELECT CAST(event_id / 100 AS BIGINT) AS step, avg(value) AS score FROM (SELECT event_id - event_id % 100 AS event_id, value FROM events) GROUP BY 1)
    SELECT step, """ + q("score", "score", 4) + ", " + q("max(score) OVER (ORDER BY step)", "best", 4) + ", score >= max(score) OVER (ORDER BY step) AS saves FROM s",
)
def best_so_far(spark, d):
    steps = table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 100).alias("step")).agg(F.avg("value").alias("score"))
    return M.running_best(steps, "step", "score").select("step", r(F.col("score"), "score", 4), r(F.col("best"), "best", 4), "saves")


@query(
    "adv_returns",
    f"WITH {ROLLOUTS}, {TOKENS} SELECT uid, sample, pos, {q('sum(reward) OVER (PARTITION BY uid, sample ORDER BY pos DESC)', 'ret')} FROM tokens",
)
def adv_returns(spark, d):
    """Reverse sums within a row need no shuffle of tokens: a fold over the array."""
    out = sequences(spark, d).withColumn("ret", A.discounted(F.col("rewards"), 1.0))
    return out.select("uid", "sample", F.posexplode("ret").alias("pos", "x")).select("uid", "sample", F.col("pos").cast("long").alias("pos"), r(F.col("x"), "ret"))


@query(
    "adv_discounted",
    f"""WITH {ROLLOUTS}, {TOKENS} SELECT a.uid, a.sample, a.pos, {q('sum(b.reward * pow(0.7142857, b.pos - a.pos))', 'ret')}
    FROM tokens a JOIN tokens b ON a.uid = b.uid AND a.sample = b.sample AND b.pos >= a.pos GROUP BY 1, 2, 3""",
)
def adv_discounted(spark, d):
    out = sequences(spark, d).withColumn("ret", A.discounted(F.col("rewards"), 0.7142857))
    return out.select("uid", "sample", F.posexplode("ret").alias("pos", "x")).select("uid", "sample", F.col("pos").cast("long").alias("pos"), r(F.col("x"), "ret"))


@query(
    "adv_remax",
    f"""WITH {ROLLOUTS}, {TOKENS} SELECT uid, sample, pos, {q('sum(reward) OVER (PARTITION BY uid, sample ORDER BY pos DESC) - (uid % 3)', 'advantage')} FROM tokens""",
)
def adv_remax(spark, d):
    out = R.remax(tokens(spark, d).withColumn("base", F.col("uid") % 3), ["uid", "sample"], "base")
    return out.select("uid", "sample", "pos", r(F.col("advantage"), "advantage"))


@query(
    "adv_gae",
    f"""WITH {ROLLOUTS}, {TOKENS}, d AS (SELECT *, reward + 0.9 * coalesce(lead(val) OVER (PARTITION BY uid, sample ORDER BY pos), 0) - val AS delta FROM tokens)
    SELECT a.uid, a.sample, a.pos, {q('sum(b.delta * pow(0.9 * 0.8, b.pos - a.pos))', 'advantage')}, {q('sum(b.delta * pow(0.9 * 0.8, b.pos - a.pos)) + any_value(a.val)', 'ret')}
    FROM d a JOIN d b ON a.uid = b.uid AND a.sample = b.sample AND b.pos >= a.pos GROUP BY 1, 2, 3""",
)
def adv_gae(spark, d):
    out = sequences(spark, d).withColumn("adv", A.gae(F.col("rewards"), F.col("vals"), 0.9, 0.8))
    rows = out.select("uid", "sample", F.posexplode(F.arrays_zip("adv", "vals")).alias("pos", "x"))
    return rows.select("uid", "sample", F.col("pos").cast("long").alias("pos"), r(F.col("x.adv"), "advantage"), r(F.col("x.adv") + F.col("x.vals"), "ret"))


@query(
    "kl_estimates",
    f"""WITH {ROLLOUTS}, {TOKENS} SELECT uid, sample, pos, {q('logp - ref', 'kl')}, {q('abs(logp - ref)', 'abs')}, {q('0.5 * (logp - ref) * (logp - ref)', 'mse')},
    {q('least(greatest(exp(ref - logp) - (ref - logp) - 1, -10), 10)', 'low_var_kl')} FROM tokens""",
)
def kl_estimates(spark, d):
    return tokens(spark, d).select("uid", "sample", "pos", *[r(R.kl_estimate(F.col("logp"), F.col("ref"), k), k) for k in ("kl", "abs", "mse", "low_var_kl")])


@query(
    "kl_penalised_rewards",
    f"WITH {ROLLOUTS}, {TOKENS} SELECT uid, sample, {q('sum(reward - 0.1 * (logp - ref) * m)', 'reward')}, {q('sum((logp - ref) * m) / (sum(m) + 1e-8)', 'kl')} FROM tokens GROUP BY uid, sample",
)
def kl_penalised_rewards(spark, d):
    out = sequences(spark, d).withColumn("k", P.divergence(F.col("logps"), F.col("refs"), F.col("mask")))
    return out.select("uid", "sample", r(A.total(P.kl_penalised(F.col("rewards"), F.col("k"), 0.1)), "reward"), r(P.mean_divergence(F.col("k"), F.col("mask")), "kl"))


@query(
    "adaptive_kl_controller",
    """WITH s AS (SELECT o_orderkey AS step, 1 + greatest(least(CAST(o_custkey % 21 AS DOUBLE) / 100 / 0.1 - 1, 0.2), -0.2) * 8 / 1000 AS f FROM orders)
    SELECT step, """ + q("0.2 * exp(sum(ln(f)) OVER (ORDER BY step))", "beta", 8) + ", CAST(0.2 AS DOUBLE) AS fixed FROM s",
)
def adaptive_kl_controller(spark, d):
    steps = table(spark, d, "orders").select(F.col("o_orderkey").alias("step"), ((F.col("o_custkey") % 21).cast("double") / 100).alias("kl"), F.lit(8).alias("n"))
    adaptive = R.kl_controller("adaptive", steps, ["step"], "kl", "n", 0.2, 0.1, 1000.0)
    fixed = R.kl_controller("fixed", adaptive.withColumnRenamed("beta", "b"), ["step"], "kl", "n", 0.2)
    return fixed.select("step", r(F.col("b"), "beta", 8), F.col("beta").alias("fixed"))


@query(
    "advantage_by_name",
    f"""WITH {ROLLOUTS}, g AS (SELECT *, avg(reward) OVER (PARTITION BY uid) AS mean, {N} AS n FROM rollouts)
    SELECT uid, sample, 'grpo_no_std' AS estimator, {q('reward - CASE WHEN n = 1 THEN 0 ELSE mean END', 'advantage')} FROM g
    UNION ALL SELECT uid, sample, 'rloo', {q('CASE WHEN n = 1 THEN reward ELSE (reward - mean) * n / (n - 1) END', 'advantage')} FROM g""",
)
def advantage_by_name(spark, d):
    found = [R.advantage(rollouts(spark, d), e).select("uid", "sample", F.lit(e).alias("estimator"), r(F.col("advantage"), "advantage")) for e in ("grpo_no_std", "rloo")]
    return found[0].unionByName(found[1])


@query(
    "dpo_pair_accuracy",
    f"""WITH {ROLLOUTS}, p AS (SELECT a.uid, abs(a.reward - b.reward) AS w, CASE WHEN (a.score - b.score) * (a.reward - b.reward) > 0 THEN 1.0 ELSE 0.0 END AS ok
    FROM rollouts a JOIN rollouts b ON a.uid = b.uid AND a.sample < b.sample)
    SELECT uid, {q('CASE WHEN sum(w) > 0 THEN sum(w * ok) / sum(w) ELSE 0.5 END', 'accuracy')} FROM p GROUP BY uid""",
)
def dpo_pair_accuracy(spark, d):
    return R.pair_accuracy(rollouts(spark, d), "score", "reward").select("uid", r(F.col("accuracy"), "accuracy"))


@query(
    "dpo_sign_accuracy",
    f"WITH {ROLLOUTS} SELECT {q('avg(CASE WHEN (score - 6 > 0) = (reward > 2) THEN 1.0 ELSE 0.0 END)', 'accuracy')} FROM rollouts",
)
def dpo_sign_accuracy(spark, d):
    return rollouts(spark, d).agg(r(P.sign_agreement(F.col("score") - 6, F.col("reward") > 2), "accuracy"))


@query(
    "dpo_reward_model_loss",
    f"WITH {ROLLOUTS}, p AS (SELECT 1 / (1 + exp(-0.05 * score)) AS p, CASE WHEN reward > 2 THEN 1.0 ELSE 0.0 END AS y FROM rollouts) SELECT {q('avg(-(y * ln(p) + (1 - y) * ln(1 - p)))', 'loss')} FROM p",
)
def dpo_reward_model_loss(spark, d):
    return rollouts(spark, d).agg(r(P.cross_entropy(F.col("score"), F.col("reward") > 2, 0.05), "loss"))


@query(
    "detached_dpo_loss",
    f"""WITH {ROLLOUTS}, g AS (SELECT uid, avg(score) FILTER (reward > 2) AS good, avg(score) FILTER (reward <= 2) AS bad FROM rollouts GROUP BY uid)
    SELECT {q('avg(ln(1 + exp(-0.05 * CASE WHEN reward > 2 THEN score - coalesce(bad, 0) ELSE coalesce(good, 0) - score END)))', 'loss')} FROM rollouts JOIN g USING (uid)""",
)
def detached_dpo_loss(spark, d):
    return P.detached_loss(rollouts(spark, d), "uid", "score", F.col("reward") > 2, 0.05).select(r(F.col("loss"), "loss"))


@query(
    "prime_norm",
    f"""WITH {ROLLOUTS}, {TOKENS}, t AS (SELECT uid, sample, pos, reward - 0.45 AS x, sum(reward - 0.45) OVER (PARTITION BY uid, sample ORDER BY pos DESC) AS ret FROM tokens)
    SELECT uid, sample, {q('sum(x / (SELECT max(abs(ret)) FROM t))', 'score')} FROM t GROUP BY uid, sample""",
)
def prime_norm(spark, d):
    x = P.normalised(sequences(spark, d).withColumn("x", F.transform("rewards", lambda v: v - 0.45)), "x")
    return x.select("uid", "sample", r(A.total(F.col("x")) / F.col("scale"), "score"))


@query(
    "online_dpo_preference",
    f"WITH {ROLLOUTS}, n AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY sample) - 1 AS i FROM rollouts) SELECT uid, sample, row_number() OVER (PARTITION BY uid, i // 2 ORDER BY reward DESC, i) = 1 AS preferred FROM n",
)
def online_dpo_preference(spark, d):
    return P.preferred_in_pairs(rollouts(spark, d), "uid", "sample", "reward").select("uid", "sample", "preferred")


@query(
    "online_dpo_loss",
    f"""WITH {ROLLOUTS}, z AS (SELECT 0.1 * ((score - 6) / 10 - (reward - 2) / 10) AS l FROM rollouts)
    SELECT {q('avg(0.9 * ln(1 + exp(-l)) + 0.1 * ln(1 + exp(l)))', 'sigmoid')}, {q('avg((l / 0.1 - 5) * (l / 0.1 - 5))', 'ipo')} FROM z""",
)
def online_dpo_loss(spark, d):
    margin = (F.col("score") - 6) / 10 - (F.col("reward") - 2) / 10
    return rollouts(spark, d).agg(r(F.avg(P.preference_loss(margin, "sigmoid", 0.1, 0.1)), "sigmoid"), r(F.avg(P.preference_loss(margin, "ipo", 0.1)), "ipo"))


@query(
    "batch_log_probabilities",
    f"WITH {ROLLOUTS}, {TOKENS} SELECT uid, sample, {q('sum(logp) FILTER (pos > 0)', 'total')}, {q('avg(logp) FILTER (pos > 0)', 'mean')} FROM tokens GROUP BY uid, sample",
)
def batch_log_probabilities(spark, d):
    """Labels of the prompt (the first token) are ignored."""
    total, mean = P.sequence_logps(F.col("logps"), 1)
    return sequences(spark, d).select("uid", "sample", r(total, "total"), r(mean, "mean"))


@query(
    "soft_mean",
    f"WITH {ROLLOUTS} SELECT {q('avg(reward)', 'beta_0')}, {q('ln(avg(exp(0.5 * reward))) / 0.5', 'beta_half')} FROM rollouts",
)
def soft_mean(spark, d):
    x = rollouts(spark, d)
    zero, half = R.soft_mean(x, "reward", 0), R.soft_mean(x, "reward", 0.5)
    return zero.select(r(F.col("softmean"), "beta_0")).join(F.broadcast(half.select(r(F.col("softmean"), "beta_half"))))


@query(
    "sppo_loss",
    f"WITH {ROLLOUTS}, {TOKENS}, s AS (SELECT uid, sample, sum((logp - ref) * m) AS d, any_value(uid % 3 - 1) AS a FROM tokens GROUP BY uid, sample) SELECT {q('avg((d - 1000 * a / 1000.0) * (d - 1000 * a / 1000.0))', 'loss')} FROM s",
)
def sppo_loss(spark, d):
    kls = P.divergence(F.col("logps"), F.col("refs"), F.col("mask"))
    return sequences(spark, d).agg(r(F.avg(P.self_play_loss(kls, F.col("uid") % 3 - 1, 1.0)), "loss"))