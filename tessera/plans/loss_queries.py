"""Queries for masked reductions, losses, sequence shaping and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.operators import batches
from tessera.operators import losses as L
from tessera.operators import metrics as M
from tessera.operators import preferences as P
from tessera.plans import query, table
from tessera.plans.rollout_queries import ROLLOUTS, TOKENS, q, r, rollouts, sequences, tokens

WITH = f"WITH {ROLLOUTS}, {TOKENS}"
#: The same with tokens made once, for queries that use them several times.
WITH_ONCE = WITH.replace("tokens AS (", "tokens AS MATERIALIZED (")

# Aggregation of token losses -------------------------------------------------

_ROWS = "s AS (SELECT uid, sample, sum(reward * m) AS v, sum(m) AS n, count(*) AS len FROM tokens GROUP BY uid, sample)"
for mode, body in {
    "token_mean": "sum(v) / (sum(n) + 1e-8)",
    "seq_mean_token_sum": "avg(v)",
    "seq_mean_token_mean": "avg(CASE WHEN n = 0 THEN 0 ELSE v / n END)",
    "seq_mean_token_sum_norm": "sum(v) / 11",
}.items():

    @query(f"agg_loss_{mode}", f"{WITH}, {_ROWS} SELECT {q(body, 'loss')} FROM s")
    def agg_loss(spark, d, mode=mode):
        return L.aggregate_loss(sequences(spark, d), "rewards", "mask", mode.replace("_", "-"), width=11).select(r(F.col("loss"), "loss"))


_RATIO = "p AS (SELECT *, exp(logp - ref) AS ratio, val - 0.4 AS adv FROM tokens)"


@query(
    "policy_loss",
    f"""{WITH}, {_RATIO}, l AS (SELECT *, greatest(-adv * ratio, -adv * greatest(least(ratio, 1.2), 0.8)) AS c1 FROM p),
    c AS (SELECT *, CASE WHEN adv < 0 THEN least(c1, -adv * 3) ELSE c1 END AS loss FROM l)
    SELECT {q('sum(loss * m) / (sum(m) + 1e-8)', 'loss')}, {q('sum(m * CASE WHEN -adv * greatest(least(ratio, 1.2), 0.8) > -adv * ratio THEN 1 ELSE 0 END) / (sum(m) + 1e-8)', 'clip_fraction')},
    {q('sum(m * (ref - logp)) / (sum(m) + 1e-8)', 'kl')}, {q('sum(m * CASE WHEN adv < 0 AND c1 > -adv * 3 THEN 1 ELSE 0 END) / (sum(m) + 1e-8)', 'lower_clip_fraction')} FROM c""",
)
def policy_loss(spark, d):
    out = L.policy_loss(tokens(spark, d), F.col("logp"), F.col("ref"), F.col("val") - 0.4, F.col("m"))
    return out.select(*[r(F.col(c), c) for c in out.columns])


@query(
    "value_loss",
    f"""{WITH}, v AS (SELECT m, ent AS p, val AS v0, reward AS ret, greatest(least(ent, val + 0.2), val - 0.2) AS c FROM tokens),
    l AS (SELECT m, (p - ret) * (p - ret) AS a, (c - ret) * (c - ret) AS b FROM v)
    SELECT {q('sum(m * greatest(a, b)) / (sum(m) + 1e-8)', 'loss')}, {q('sum(m * CASE WHEN b > a THEN 1 ELSE 0 END) / (sum(m) + 1e-8)', 'clip_fraction')} FROM l""",
)
def value_loss(spark, d):
    out = L.value_loss(tokens(spark, d), F.col("ent"), F.col("reward"), F.col("val"), F.col("m"), 0.2)
    return out.select(*[r(F.col(c), c) for c in out.columns])


@query("masked_sum", f"{WITH} SELECT uid, sample, {q('sum(reward * m)', 'total')} FROM tokens GROUP BY uid, sample")
def masked_sum(spark, d):
    return sequences(spark, d).select("uid", "sample", r(A.masked_sum(F.col("rewards"), F.col("mask")), "total"))


@query("masked_mean", f"{WITH} SELECT uid, sample, {q('sum(reward * m) / (sum(m) + 1e-8)', 'mean')} FROM tokens GROUP BY uid, sample")
def masked_mean(spark, d):
    return sequences(spark, d).select("uid", "sample", r(A.masked_mean(F.col("rewards"), F.col("mask")), "mean"))


_MOMENTS = "c AS MATERIALIZED (SELECT sum(reward * m) / (sum(m) + 1e-8) AS mean, sum(m) AS n FROM tokens), v AS MATERIALIZED (SELECT any_value(mean) AS mean, sum(m * (reward - mean) * (reward - mean)) / (any_value(n) + 1e-8) * any_value(n) / (any_value(n) - 1) AS var FROM tokens, c)"


@query("masked_variance", f"{WITH_ONCE}, {_MOMENTS} SELECT {q('mean', 'mean')}, {q('var', 'var')} FROM v")
def masked_variance(spark, d):
    out = L.masked_moments(tokens(spark, d), F.col("reward"), F.col("m"))
    return out.select(r(F.col("mean"), "mean"), r(F.col("var"), "var"))


@query(
    "masked_whiten",
    f"{WITH_ONCE}, {_MOMENTS} SELECT uid, sample, pos, {q('(reward - mean) / sqrt(var + 1e-8)', 'white')}, {q('(reward - mean) / sqrt(var + 1e-8) + mean', 'shifted')} FROM tokens, v",
)
def masked_whiten(spark, d):
    """Whitened values of every token: plain, and with the mean kept."""
    out = L.whiten(tokens(spark, d), "reward", "m")
    return out.select("uid", "sample", "pos", r(F.col("white"), "white"), r(F.col("white") + F.col("mean"), "shifted"))


@query("distributed_moments", f"{WITH} SELECT {q('avg(reward)', 'mean')}, max(reward) AS max, min(reward) AS min, {q('stddev_samp(reward)', 'std')} FROM tokens")
def distributed_moments(spark, d):
    x = M.moments(tokens(spark, d), "reward")
    return x.select(r(F.col("mean"), "mean"), "max", "min", r(F.col("std"), "std"))


@query("distributed_masked_mean", f"{WITH} SELECT {q('sum(reward * m) / sum(m)', 'mean')} FROM tokens")
def distributed_masked_mean(spark, d):
    return tokens(spark, d).agg(r(L.weighted_mean(F.col("reward"), F.col("m")), "mean"))


# SFT losses -------------------------------------------------------------------

_SFT = {
    "v0": ("-logp", "1"),
    "v1": ("-logp", "0.5 * exp(-ent)"),
    "v2": ("-exp(logp) / (exp(logp) + 0.1)", "1"),
    "v3": ("-logp", "0.5 * exp(ent)"),
    "v7": ("-logp", "exp(logp)"),
    "v8": ("-logp", "exp(logp) * (1 - exp(logp))"),
}
for version, (loss, weight) in _SFT.items():

    @query(f"sft_loss_{version}", f"{WITH} SELECT {q(f'sum(m * ({loss}) * ({weight})) / (sum(m) + 1e-8)', 'loss')} FROM tokens")
    def sft_loss(spark, d, version=version):
        return L.sft_loss(tokens(spark, d), version).select(r(F.col("loss"), "loss"))


_ORDERED = "o AS (SELECT *, row_number() OVER (ORDER BY ent) AS lo, row_number() OVER (ORDER BY ent DESC) AS hi, count(*) OVER () AS n FROM tokens WHERE m > 0)"
for name, low, high, body in (
    ("sft_loss_lowest_entropy", 0.0, 0.5, "ent <= (SELECT max(ent) FROM o WHERE lo <= greatest(1, CAST(floor(n * 0.5) AS BIGINT)))"),
    ("sft_loss_highest_entropy", 0.8, 1.0, "ent >= (SELECT min(ent) FROM o WHERE hi <= greatest(1, CAST(floor(n * 0.2) AS BIGINT)))"),
    ("sft_loss_middle_entropy", 0.25, 0.75, "ent >= (SELECT max(ent) FROM o WHERE lo <= greatest(1, CAST(floor(n * 0.25) AS BIGINT))) AND ent <= (SELECT max(ent) FROM o WHERE lo <= greatest(1, CAST(floor(n * 0.75) AS BIGINT)))"),
):

    @query(name, f"{WITH}, {_ORDERED} SELECT {q('sum(-logp) / (count(*) + 1e-8)', 'loss')}, count(*) AS tokens FROM o WHERE {body}")
    def entropy_loss(spark, d, low=low, high=high):
        return L.entropy_band_loss(tokens(spark, d), low, high).select(r(F.col("loss"), "loss"), "tokens")


for name, ratio, order in (("sft_loss_lowest_entropy_by_row", 0.5, "ent"), ("sft_loss_highest_entropy_by_row", 0.2, "ent DESC")):
    sign = "<=" if order == "ent" else ">="
    edge = "max" if order == "ent" else "min"

    @query(
        name,
        f"""{WITH}, o AS (SELECT *, row_number() OVER (PARTITION BY uid, sample ORDER BY {order}) AS k, count(*) OVER (PARTITION BY uid, sample) AS n FROM tokens WHERE m > 0),
        e AS (SELECT *, {edge}(ent) FILTER (k <= greatest(1, CAST(floor(n * {ratio}) AS BIGINT))) OVER (PARTITION BY uid, sample) AS edge FROM o)
        SELECT {q('sum(-logp) / (count(*) + 1e-8)', 'loss')}, count(*) AS tokens FROM e WHERE ent {sign} edge""",
    )
    def entropy_loss_by_row(spark, d, ratio=ratio, lowest=order == "ent"):
        return L.entropy_loss_by_row(tokens(spark, d), ["uid", "sample"], ratio, lowest).select(r(F.col("loss"), "loss"), "tokens")


# Logits ----------------------------------------------------------------------

_LOGITS = "x AS (SELECT vec_id, label, list_transform(list_slice(embedding, 1, 8), lambda v: CAST(v AS DOUBLE)) AS z FROM embeddings), u AS (SELECT vec_id, label % 8 AS label, unnest(z) AS z, generate_subscripts(z, 1) - 1 AS i FROM x), e AS (SELECT vec_id, ln(sum(exp(z))) AS lse FROM u GROUP BY vec_id)"


def logits(spark, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", (F.col("label") % 8).alias("label"), F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double")).alias("z"))


@query("entropy_from_logits", f"WITH {_LOGITS} SELECT vec_id, {q('any_value(lse) - sum(exp(z - lse) * z)', 'entropy')} FROM u JOIN e USING (vec_id) GROUP BY vec_id")
def entropy_from_logits(spark, d):
    return logits(spark, d).select("vec_id", r(A.entropy(F.col("z")), "entropy"))


@query("entropy_loss", f"WITH {_LOGITS}, h AS (SELECT vec_id, any_value(lse) - sum(exp(z - lse) * z) AS h FROM u JOIN e USING (vec_id) GROUP BY vec_id) SELECT {q('avg(h)', 'entropy')} FROM h")
def entropy_loss_mean(spark, d):
    return logits(spark, d).agg(r(F.avg(A.entropy(F.col("z"))), "entropy"))


@query("log_softmax", f"WITH {_LOGITS} SELECT vec_id, i, {q('z - lse', 'logp')} FROM u JOIN e USING (vec_id)")
def log_softmax(spark, d):
    out = logits(spark, d).select("vec_id", F.posexplode(A.log_softmax(F.col("z"))).alias("i", "p"))
    return out.select("vec_id", F.col("i").cast("long").alias("i"), r(F.col("p"), "logp"))


@query("logprobs_of_labels", f"WITH {_LOGITS} SELECT vec_id, {q('z', 'logit')}, {q('z - lse', 'logp')} FROM u JOIN e USING (vec_id) WHERE i = label")
def logprobs_of_labels(spark, d):
    z = A.pick(F.col("z"), F.col("label"))
    return logits(spark, d).select("vec_id", r(z, "logit"), r(z - A.log_sum_exp(F.col("z")), "logp"))


# Shaping of sequences ---------------------------------------------------------

_IDS = f"WITH {ROLLOUTS}, s AS (SELECT uid, sample, [(uid + p) % 6 FOR p IN range(0, CAST(n_tokens AS BIGINT))] AS ids, [CASE WHEN (uid + p) % 4 = 0 THEN 0.0 ELSE 1.0 END FOR p IN range(0, CAST(n_tokens AS BIGINT))] AS mask FROM rollouts)"


@query(
    "clip_by_value",
    f"{WITH} SELECT uid, sample, pos, {q('greatest(least(reward, 0.7), 0.2)', 'clipped')} FROM tokens",
)
def clip_by_value(spark, d):
    return tokens(spark, d).select("uid", "sample", "pos", r(L.clip(F.col("reward"), F.lit(0.2), F.lit(0.7)), "clipped"))


@query(
    "eos_mask",
    f"{_IDS} SELECT uid, sample, [CASE WHEN NOT list_contains(ids, 3) OR i <= list_position(ids, 3) THEN 1 ELSE 0 END FOR i IN range(1, len(ids) + 1)] AS mask FROM s",
)
def eos_mask(spark, d):
    return sequences(spark, d).select("uid", "sample", A.until_first(F.col("ids"), 3).alias("mask"))


_PAD = "[CAST(0 AS BIGINT) FOR i IN range(len(ids), 8)]"
for name, body, how in (
    ("pad_or_cut_left", f"CASE WHEN len(ids) <= 8 THEN list_concat({_PAD}, ids) ELSE list_slice(ids, len(ids) - 7, len(ids)) END", {"truncation": "left"}),
    ("pad_or_cut_right", f"CASE WHEN len(ids) <= 8 THEN list_concat(ids, {_PAD}) ELSE list_slice(ids, 1, 8) END", {"truncation": "right", "left_pad": False}),
    ("pad_or_cut_middle", f"CASE WHEN len(ids) <= 8 THEN list_concat({_PAD}, ids) ELSE list_concat(list_slice(ids, 1, 4), list_slice(ids, len(ids) - 3, len(ids))) END", {"truncation": "middle"}),
    ("pad_to_error", f"list_concat({_PAD.replace('8', '11')}, ids)", {"truncation": "error", "n": 11}),
):

    @query(name, f"{_IDS} SELECT uid, sample, {body} AS ids FROM s")
    def pad_or_cut(spark, d, how=how):
        return sequences(spark, d).select("uid", "sample", A.fit(F.col("ids"), how.get("n", 8), 0, how.get("left_pad", True), how["truncation"]).alias("ids"))


@query("pad_to_longest", f"{_IDS} SELECT uid, sample, list_concat(ids, [CAST(9 AS BIGINT) FOR i IN range(len(ids), (SELECT max(len(ids)) FROM s))]) AS ids FROM s")
def pad_to_longest(spark, d):
    x = sequences(spark, d).select("uid", "sample", "ids")
    return x.join(F.broadcast(x.agg(F.max(F.size("ids")).alias("n")))).select("uid", "sample", A.pad_right(F.col("ids"), F.col("n"), 9).alias("ids"))


@query("remove_left_pad", f"{_IDS} SELECT uid, sample, list_slice(ids, len(ids) - CAST(list_sum(mask) AS BIGINT) + 1, len(ids)) AS ids FROM s")
def remove_left_pad(spark, d):
    return sequences(spark, d).select("uid", "sample", A.without_left_pad(F.col("ids"), F.col("mask")).alias("ids"))


@query("response_mask", f"{_IDS} SELECT uid, sample, list_slice(mask, greatest(len(mask) - 3, 1), len(mask)) AS mask FROM s")
def response_mask(spark, d):
    return sequences(spark, d).select("uid", "sample", A.suffix(F.col("mask"), 4).alias("mask"))


@query(
    "score_at_last_token",
    f"""{_IDS}, l AS (SELECT uid, sample, mask, list_max([CASE WHEN mask[i] > 0 THEN i ELSE 0 END FOR i IN range(1, len(mask) + 1)]) AS last FROM s)
    SELECT uid, sample, [CASE WHEN i = last THEN CAST(uid % 5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END FOR i IN range(1, len(mask) + 1)] AS scores FROM l""",
)
def score_at_last_token(spark, d):
    return sequences(spark, d).select("uid", "sample", A.at_last_valid((F.col("uid") % 5).cast("double"), F.col("mask")).alias("scores"))


@query(
    "response_with_target",
    f"""{_IDS} SELECT uid, sample, list_concat(list_slice(ids, 1, 2), [CAST(uid % 7 AS BIGINT), CAST(5 AS BIGINT)]) AS ids,
    [CAST(1 AS INTEGER) FOR i IN range(0, least(len(ids), 2) + 2)] AS mask, [i FOR i IN range(0, least(len(ids), 2) + 2)] AS positions FROM s""",
)
def response_with_target(spark, d):
    """The response gives way to a target and the end id; masks and positions follow."""
    return sequences(spark, d).select("uid", "sample", P.replaced(F.col("ids"), 2, F.array(F.col("uid") % 7), 5).alias("x")).select("uid", "sample", "x.*")


@query("split_into_batches", f"WITH {ROLLOUTS}, n AS (SELECT uid, sample, row_number() OVER (ORDER BY uid, sample) - 1 AS k FROM rollouts) SELECT uid, sample, k // 256 AS batch FROM n")
def split_into_batches(spark, d):
    return batches.number(rollouts(spark, d), ["uid", "sample"]).select("uid", "sample", F.floor(F.col("k") / 256).alias("batch"))


@query(
    "overlong_penalty",
    f"WITH {ROLLOUTS} SELECT uid, sample, {q('reward + least(-(n_tokens - (11 - 4)) / 4 * 1.0, 0)', 'reward')} FROM rollouts",
)
def overlong_penalty(spark, d):
    return rollouts(spark, d).select("uid", "sample", r(F.col("reward") + L.overlong_penalty(F.col("n_tokens"), 11, 4, 1.0), "reward"))


# Metrics -----------------------------------------------------------------------


@query(
    "reduce_metrics",
    """WITH m AS (SELECT event_type || '/' || ['mean', 'max_len', 'min_len', 'minmax_diff'][1 + event_id % 4] AS key, value FROM events)
    SELECT key, """ + q("CASE WHEN key LIKE '%max%' THEN max(value) WHEN key LIKE '%min%' THEN min(value) ELSE avg(value) END", "value", 4) + " FROM m GROUP BY key",
)
def reduce_metrics(spark, d):
    names = F.array(*[F.lit(x) for x in ("mean", "max_len", "min_len", "minmax_diff")])
    m = table(spark, d, "events").select(F.concat("event_type", F.lit("/"), F.get(names, (F.col("event_id") % 4).cast("int"))).alias("key"), "value")
    return M.reduce_metrics(m).select("key", r(F.col("value"), "value", 4))


_STATS = ", ".join(q(f"{f}({x})", f"{x}_{n}") for x in ("score", "reward", "ret", "val", "n") for f, n in (("avg", "mean"), ("max", "max"), ("min", "min")))


@query(
    "data_metrics",
    f"""{WITH}, t AS (SELECT uid, sample, sum(reward) AS reward, sum(reward * m) AS ret, sum(val) AS val, max(n_tokens) AS n, any_value(uid % 5) AS score FROM tokens GROUP BY uid, sample)
    SELECT {_STATS}, {q('avg(CASE WHEN n = 11 THEN 1 ELSE 0 END)', 'clip_ratio')}, {q('1 - var_samp(ret - val) / (var_samp(ret) + 1e-5)', 'explained_variance')} FROM t""",
)
def data_metrics(spark, d):
    x = sequences(spark, d).select(
        A.total(F.col("rewards")).alias("reward"), A.masked_sum(F.col("rewards"), F.col("mask")).alias("ret"), A.total(F.col("vals")).alias("val"),
        F.col("n_tokens").alias("n"), (F.col("uid") % 5).alias("score"),
    )
    out = M.data_metrics(x, ["score", "reward", "ret", "val", "n"], "n", 11)
    return out.select(*[r(F.col(c), c) for c in out.columns])


@query("response_lengths", f"{_IDS} SELECT uid, sample, {q('list_sum(mask)', 'response')}, {q('len(mask) - list_sum(mask)', 'rest')} FROM s")
def response_lengths(spark, d):
    n, rest = A.lengths(F.col("mask"))
    return sequences(spark, d).select("uid", "sample", r(n, "response"), r(rest, "rest"))


@query(
    "timing_metrics",
    f"""WITH {ROLLOUTS}, n AS (SELECT sum(n_tokens) AS response, sum(n_tokens) + 3 * count(*) AS total FROM rollouts), t AS (SELECT event_type AS stage, sum(value) AS s FROM events GROUP BY 1)
    SELECT stage, {q('s', 'seconds', 4)}, {q("s * 1000 / CASE WHEN stage = 'click' THEN response ELSE total END", 'ms_per_token', 4)} FROM t, n""",
)
def timing_metrics(spark, d):
    n = rollouts(spark, d).agg(F.sum("n_tokens").alias("response"), (F.sum("n_tokens") + 3 * F.count(F.lit(1))).alias("total"))
    t = table(spark, d, "events").groupBy(F.col("event_type").alias("stage")).agg(F.sum("value").alias("s"))
    return M.timing(t, n, "click").select("stage", r(F.col("s"), "seconds", 4), r(F.col("ms"), "ms_per_token", 4))


@query("throughput_metrics", f"WITH {ROLLOUTS} SELECT CAST(sum(n_tokens) AS BIGINT) AS tokens, {q('sum(n_tokens) / (2.5 * 8)', 'per_second_and_gpu')} FROM rollouts")
def throughput_metrics(spark, d):
    return M.throughput(rollouts(spark, d), "n_tokens", 2.5, 8).select("tokens", r(F.col("per_second"), "per_second_and_gpu"))


@query(
    "majority_vote",
    """WITH v AS (SELECT user_id, event_type AS vote, count(*) AS n, min(event_id) AS first, arg_min(value, event_id) AS val FROM events GROUP BY 1, 2)
    SELECT user_id, vote, val FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS k FROM v) WHERE k = 1""",
)
def majority_vote(spark, d):
    return M.majority(table(spark, d, "events"), "user_id", "event_type", "value", "event_id").select("user_id", "vote", "val")


@query(
    "validation_mean_std",
    f"""WITH p AS (SELECT event_type AS source, user_id, avg(value) AS mean, stddev_pop(value) AS std, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT source, {q('avg(mean)', 'mean', 4)}, {q('avg(std)', 'std', 4)}, {q('avg(n)', 'n', 4)} FROM p GROUP BY source""",
)
def validation_mean_std(spark, d):
    return M.validation(table(spark, d, "events"), "event_type", "user_id", "value").select("source", r(F.col("mean"), "mean", 4), r(F.col("std"), "std", 4), r(F.col("n"), "n", 4))


@query("validation_bootstrap")
def validation_bootstrap(spark, d):
    """Best and worst of 2 and 4 of each user's values, by a bootstrap with numpy's generator."""
    return M.bootstrap(table(spark, d, "events"), "user_id", "value", "event_id", (2, 4), 200, 42)


@query(
    "metric_names",
    """WITH m AS (SELECT DISTINCT event_type AS source, CASE WHEN event_id % 2 = 0 THEN 'acc' ELSE 'reward' END AS var, ['mean@8', 'maj@8/mean', 'best@8/mean', 'best@4/mean', 'std@8'][1 + event_id % 5] AS stat FROM events)
    SELECT source, var, stat, CASE WHEN var = 'acc' AND stat LIKE '%@8%' AND regexp_matches(stat, '^(mean|maj|best)') THEN 'val-core' ELSE 'val-aux' END || '/' || source || '/' || var || '/' || stat AS key FROM m""",
)
def metric_names(spark, d):
    stats = F.array(*[F.lit(x) for x in ("mean@8", "maj@8/mean", "best@8/mean", "best@4/mean", "std@8")])
    m = table(spark, d, "events").select(F.col("event_type").alias("source"), F.when(F.col("event_id") % 2 == 0, "acc").otherwise("reward").alias("var"), F.get(stats, (F.col("event_id") % 5).cast("int")).alias("stat"))
    return M.named(m.distinct(), "acc", 8)


@query(
    "length_balance",
    f"""WITH {ROLLOUTS}, s AS (SELECT uid % 8 AS part, sum(n_tokens) AS n FROM rollouts GROUP BY 1) SELECT {q('min(n)', 'min')}, {q('max(n)', 'max')}, {q('max(n) - min(n)', 'diff')}, {q('avg(n)', 'mean')} FROM s""",
)
def length_balance(spark, d):
    x = M.balance(rollouts(spark, d).withColumn("part", F.col("uid") % 8), "part", "n_tokens")
    return x.select(*[r(F.col(c), c) for c in ("min", "max", "diff", "mean")])


@query(
    "flops_estimate",
    f"WITH {ROLLOUTS} SELECT uid, {q('(6 * 7000000 * sum(n_tokens) + 12 * sum(n_tokens * n_tokens) * 128 * 32 * 28) / 1e12', 'tflops')} FROM rollouts GROUP BY uid",
)
def flops_estimate(spark, d):
    return M.flops(rollouts(spark, d), "uid", "n_tokens", params=7_000_000, head_dim=128, heads=32, layers=28).select("uid", r(F.col("tflops"), "tflops"))


@query("lists_by_key", "SELECT event_type AS key, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS place, value FROM events")
def lists_by_key(spark, d):
    """The list of each key as rows with their places: a few keys have all rows."""
    x = table(spark, d, "events").select(F.col("event_type").alias("key"), "event_id", "value")
    return batches.place_in_group(x, "key", ["event_id"]).select("key", "place", "value")


_RATES = "CASE WHEN k < 50 THEN k / 50.0 ELSE"


@query(
    "learning_rates",
    f"""WITH s AS (SELECT event_id AS step, CAST(event_id % 1100 AS DOUBLE) AS k FROM events)
    SELECT step, {q('CASE WHEN k < 50 THEN 0.1 + 0.9 * k / 50.0 ELSE 0.1 + 0.45 * (1 + cos(pi() * (k - 50) / 950.0)) END', 'cosine')},
    {q(f'{_RATES} 1 END', 'constant')},
    {q(f'{_RATES} CASE WHEN k < 810 THEN 1 WHEN k < 1000 THEN 0.1 + 0.45 * (1 + cos(pi() * (k - 810) / 190.0)) ELSE 0.1 END END', 'stable')} FROM s""",
)
def learning_rates(spark, d):
    k = (F.col("event_id") % 1100).cast("double")
    rates = {"cosine": A.cosine_rate(k, 50, 1000, 0.1), "constant": A.constant_rate(k, 50), "stable": A.stable_rate(k, 50, 1000, 0.1, stable=0.8)}
    return table(spark, d, "events").select(F.col("event_id").alias("step"), *[r(x, n) for n, x in rates.items()])
