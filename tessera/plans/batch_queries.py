"""Queries of the batch algebra and of dataset preparation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import batches as B
from tessera.operators import datasets as D
from tessera.operators import metrics as M
from tessera.operators import partitioning as P
from tessera.plans import query, table
from tessera.sources.shared import shared_folder

#: A batch: orders with their places.
NUMBERED = "n AS (SELECT o_orderkey AS id, o_custkey AS obs, o_orderpriority AS tag, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders)"


def numbered(spark, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("obs"), F.col("o_orderpriority").alias("tag"))
    return B.number(rows, ["id"])


@query("batch_select", "SELECT o_orderkey, o_custkey FROM orders")
def batch_select(spark, d):
    return B.pop(table(spark, d, "orders"), ["o_orderkey", "o_custkey"])[0]


@query("batch_pop", "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def batch_pop(spark, d):
    return B.pop(table(spark, d, "orders"), ["o_custkey"])[1]


@query("batch_rename", "SELECT o_orderkey AS id, o_custkey AS observation FROM orders")
def batch_rename(spark, d):
    return B.rename(table(spark, d, "orders").select("o_orderkey", "o_custkey"), {"o_orderkey": "id", "o_custkey": "observation"})


@query("batch_gather", f"WITH {NUMBERED}, w AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, (o_orderkey * 7) % 100 AS k FROM orders) SELECT pos, k, id, obs, tag FROM w JOIN n USING (k)")
def batch_gather(spark, d):
    w = B.number(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], "pos")
    return B.take(numbered(spark, d), "k", w.select("pos", (F.col("o_orderkey") * 7 % 100).alias("k")))


@query("batch_mask", f"WITH {NUMBERED} SELECT id, obs FROM n WHERE obs % 3 = 0")
def batch_mask(spark, d):
    return numbered(spark, d).where("obs % 3 = 0").select("id", "obs")


@query("batch_slice", f"WITH {NUMBERED} SELECT k, id, obs FROM n WHERE k >= 10 AND k < 1200 AND (k - 10) % 7 = 0")
def batch_slice(spark, d):
    return B.slice_rows(numbered(spark, d), 10, 1200, 7).select("k", "id", "obs")


@query("batch_item", f"WITH {NUMBERED} SELECT k, id, obs, tag FROM n WHERE k = 17")
def batch_item(spark, d):
    return B.slice_rows(numbered(spark, d), 17, 18).select("k", "id", "obs", "tag")


@query("batch_union", f"WITH {NUMBERED} SELECT id, obs, tag, o_totalprice FROM n JOIN (SELECT o_orderkey AS id, o_totalprice FROM orders) USING (id)")
def batch_union(spark, d):
    other = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("obs"), "o_totalprice")
    return B.unite(numbered(spark, d).select("id", "obs", "tag"), other, "id")


@query("batch_concat", "SELECT o_orderkey AS id, 'a' AS part FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'b' FROM orders WHERE o_orderkey % 3 = 0")
def batch_concat(spark, d):
    ids = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    both = B.concat([ids.where("id % 2 = 0"), ids.where("id % 3 = 0")], "part")
    return both.withColumn("part", F.get(F.array(F.lit("a"), F.lit("b")), F.col("part")))


@query("batch_chunk", f"WITH {NUMBERED} SELECT id, k, k * 5 // (SELECT count(*) FROM n) AS chunk FROM n")
def batch_chunk(spark, d):
    x = numbered(spark, d)
    return x.select("id", "k", B.chunk_of(F.col("k"), x.count(), 5).alias("chunk"))


@query("batch_reorder", f"WITH {NUMBERED} SELECT (SELECT count(*) FROM n) - 1 - k AS pos, id, obs FROM n")
def batch_reorder(spark, d):
    x = numbered(spark, d)
    return x.select(B.reverse(x, x.count()).alias("pos"), "id", "obs")


@query("batch_inverse_permutation", f"WITH {NUMBERED}, p AS (SELECT k, (k * 7 + 3) % (SELECT count(*) FROM n) AS target FROM n) SELECT target AS k, k AS source FROM p")
def batch_inverse_permutation(spark, d):
    x = numbered(spark, d)
    moved = x.select("k", ((F.col("k") * 7 + 3) % x.count()).alias("source"))
    return B.inverse(moved, "source", "k")


@query("batch_repeat_interleaved", f"WITH {NUMBERED} SELECT k * 3 + c AS pos, id FROM n, (SELECT unnest([0, 1, 2]) AS c)")
def batch_repeat_interleaved(spark, d):
    return B.repeat(numbered(spark, d), 3).select("pos", "id")


@query("batch_repeat_tiled", f"WITH {NUMBERED} SELECT c * (SELECT count(*) FROM n) + k AS pos, id FROM n, (SELECT unnest([0, 1, 2]) AS c)")
def batch_repeat_tiled(spark, d):
    return B.repeat(numbered(spark, d), 3, interleave=False).select("pos", "id")


@query("batch_repeat_each", "SELECT o_orderkey AS id, CAST(c AS INTEGER) AS copy FROM orders, (SELECT unnest([0, 1, 2]) AS c) WHERE c < o_custkey % 4")
def batch_repeat_each(spark, d):
    ids = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey")
    return B.repeat_each(ids, F.col("o_custkey") % 4).select("id", "copy")


@query("batch_unfold_columns", "SELECT vec_id, CAST(p AS INTEGER) AS part, list_slice(embedding, p * 16 + 1, p * 16 + 16) AS embedding FROM embeddings, (SELECT unnest([0, 1, 2, 3]) AS p)")
def batch_unfold_columns(spark, d):
    return B.unfold(table(spark, d, "embeddings").select("vec_id", "embedding"), ["embedding"], 4)


@query("batch_pad_with_copies", "SELECT n_nationkey, n_name, 0 AS pad FROM nation UNION ALL SELECT n_nationkey, n_name, unnest([1, 2, 3]) FROM (SELECT * FROM nation ORDER BY n_nationkey LIMIT 1)")
def batch_pad_with_copies(spark, d):
    return B.pad_with_copies(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey", 3)


@query("batch_mini_batches", f"WITH {NUMBERED} SELECT e AS epoch, k // 64 AS batch, id FROM n, (SELECT unnest([CAST(0 AS INTEGER), CAST(1 AS INTEGER)]) AS e)")
def batch_mini_batches(spark, d):
    return B.mini_batches(numbered(spark, d), 64, 2).select("epoch", "batch", "id")


@query(
    "batch_pad_to_divisor",
    """WITH n AS (SELECT n_nationkey AS id, row_number() OVER (ORDER BY n_nationkey) - 1 AS k FROM nation), c AS (SELECT count(*) AS c FROM n)
    SELECT k, id FROM n UNION ALL SELECT k + c * r, id FROM n, c, (SELECT unnest([1, 2]) AS r) WHERE k + c * r < c + (64 - c % 64) % 64""",
)
def batch_pad_to_divisor(spark, d):
    x = B.number(table(spark, d, "nation").select(F.col("n_nationkey").alias("id")), ["id"])
    return B.pad_to_divisor(x, x.count(), 64).select("k", "id")


@query("batch_unpad", f"WITH {NUMBERED} SELECT k, id FROM n WHERE k < (SELECT count(*) FROM n) - 8")
def batch_unpad(spark, d):
    x = numbered(spark, d)
    return B.slice_rows(x, 0, x.count() - 8).select("k", "id")


@query("batch_fold", f"WITH {NUMBERED} SELECT k // 3 AS row, list(id ORDER BY k) AS id, list(obs ORDER BY k) AS obs FROM n GROUP BY 1")
def batch_fold(spark, d):
    return B.fold(numbered(spark, d), 3, ["id", "obs"])


@query("batch_fold_unfold", f"WITH {NUMBERED} SELECT k // 3 AS row, CAST(k % 3 AS INTEGER) AS pos, id FROM n")
def batch_fold_unfold(spark, d):
    return B.fold(numbered(spark, d), 3, ["id"]).select("row", F.posexplode("id").alias("pos", "id"))


@query("batch_equal_columns", "SELECT count(*) AS rows, count(*) FILTER (a IS DISTINCT FROM b) AS different FROM (SELECT nullif(o_custkey, 7) AS a, CASE WHEN o_custkey = 7 THEN NULL ELSE o_custkey END AS b FROM orders)")
def batch_equal_columns(spark, d):
    a, b = F.nullif("o_custkey", F.lit(7)), F.when(F.col("o_custkey") != 7, F.col("o_custkey"))
    return B.differing(table(spark, d, "orders"), a, b)


@query("balanced_partitions")
def balanced_partitions(spark, d):
    """Sequences of each source dealt to 4 ranks by largest differencing, equally many to each."""
    docs = table(spark, d, "documents").select("source", F.col("doc_id").alias("id"), F.col("n_chars").alias("length"))
    return P.balance(docs, "source", "id", "length", 4, "differencing")


@query("greedy_partitions")
def greedy_partitions(spark, d):
    docs = table(spark, d, "documents").select("source", F.col("doc_id").alias("id"), F.col("n_chars").alias("length"))
    return P.balance(docs, "source", "id", "length", 4, "greedy")


@query("micro_batches")
def micro_batches(spark, d):
    """As many bins for each source as its characters need at 20,000 a bin."""
    docs = table(spark, d, "documents").select("source", F.col("doc_id").alias("id"), F.col("n_chars").alias("length"))
    return P.micro_batches(docs, "source", "id", "length", 20_000)


# Datasets ----------------------------------------------------------------------

_RECORD = """SELECT 'benchmark' AS data_source, 'user' AS role, text || ' Let''s think step by step.' AS content, 'rule' AS style, CAST(item_id AS VARCHAR) AS ground_truth, 'train' AS split, item_id AS idx FROM benchmark"""


@query("canonical_record", _RECORD)
def canonical_record(spark, d):
    items = table(spark, d, "benchmark")
    out = items.select(D.record("benchmark", F.concat("text", F.lit(" Let's think step by step.")), F.col("item_id").cast("string"), "train", F.col("item_id")).alias("r"))
    return out.select("r.data_source", F.col("r.prompt")[0]["role"].alias("role"), F.col("r.prompt")[0]["content"].alias("content"), "r.reward_model.style", "r.reward_model.ground_truth", "r.extra_info.split", F.col("r.extra_info.index").alias("idx"))


@query(
    "record_with_fallback",
    "SELECT doc_id, coalesce(nullif(lang, 'en'), source, 'none') AS ground_truth, CASE WHEN lang = 'en' THEN 'source' ELSE 'lang' END AS origin FROM documents",
)
def record_with_fallback(spark, d):
    x = D.first_known({"lang": F.nullif("lang", F.lit("en")), "source": F.col("source")}, "none")
    return table(spark, d, "documents").select("doc_id", x["value"].alias("ground_truth"), F.when(F.col("lang") == "en", "source").otherwise("lang").alias("origin"))


@query(
    "typed_segments",
    "WITH t AS (SELECT conv_id, turn, 'a <image> b' || role || '<video>' AS x FROM conversations) SELECT conv_id, turn, 'text' AS k0, 'a ' AS v0, 'image' AS k1, ' b' || role AS v2, CAST(4 AS INTEGER) AS n FROM (SELECT t.*, role FROM t JOIN conversations USING (conv_id, turn))",
)
def typed_segments(spark, d):
    """Content cut at image and video marks into segments with their types."""
    x = table(spark, d, "conversations").withColumn("s", D.segments(F.concat(F.lit("a <image> b"), "role", F.lit("<video>"))))
    at = lambda i: F.col("s")[i]
    return x.select("conv_id", "turn", at(0)["type"].alias("k0"), at(0)["value"].alias("v0"), at(1)["type"].alias("k1"), at(2)["value"].alias("v2"), F.size("s").alias("n"))


@query(
    "target_with_prefix",
    """WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '<think>' || chr(10) || text ELSE text END AS target, turn % 2 = 0 AS prompted FROM conversations)
    SELECT conv_id, turn, CASE WHEN prompted THEN CASE WHEN starts_with(target, '<think>' || chr(10)) THEN substr(target, 9) ELSE target END
    ELSE CASE WHEN starts_with(target, '<think>' || chr(10)) THEN target ELSE '<think>' || chr(10) || target END END AS target FROM t""",
)
def target_with_prefix(spark, d):
    """Targets begin with a thought's tag, unless the prompt ends with it already."""
    x = table(spark, d, "conversations").withColumn("target", F.when(F.col("turn") % 3 == 0, F.concat(F.lit("<think>\n"), "text")).otherwise(F.col("text")))
    return x.select("conv_id", "turn", D.with_prefix(F.col("target"), "<think>\n", F.col("turn") % 2 == 0).alias("target"))


@query(
    "multiturn_loss_spans",
    """WITH t AS (SELECT conv_id, turn, role, len(string_split(text, ' ')) AS n FROM conversations), s AS (SELECT *, CAST(sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS stop FROM t)
    SELECT conv_id, turn, stop - n AS start, stop, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS loss FROM s""",
)
def multiturn_loss_spans(spark, d):
    x = table(spark, d, "conversations").withColumn("n", F.size(F.split("text", " ")).cast("long"))
    return D.loss_spans(x, "conv_id", "turn", "role", "n")


@query(
    "sft_loss_mask",
    """WITH t AS (SELECT conv_id, turn, least(len(string_split(text, ' ')), 6) AS p, least(len(text), 5) AS r FROM conversations)
    SELECT conv_id, turn, list_concat([0 FOR i IN range(0, p)], [1 FOR i IN range(0, r)]) AS mask FROM t""",
)
def sft_loss_mask(spark, d):
    p, n = F.least(F.size(F.split("text", " ")), F.lit(6)), F.least(F.length("text"), F.lit(5))
    return table(spark, d, "conversations").select("conv_id", "turn", D.loss_mask(p, n).alias("mask"))


@query(
    "hash_answer",
    """WITH t AS (SELECT o_orderkey, 'so #### ' || CASE WHEN o_orderkey % 2 = 0 THEN '1,' || (100 + o_custkey) ELSE '-' || o_custkey END || ' ok' AS x FROM orders)
    SELECT o_orderkey, replace(regexp_extract(x, '#### (-?[0-9.,]+)', 1), ',', '') AS answer FROM t""",
)
def hash_answer(spark, d):
    n = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("1,"), (F.col("o_custkey") + 100).cast("string"))).otherwise(F.concat(F.lit("-"), F.col("o_custkey").cast("string")))
    return table(spark, d, "orders").select("o_orderkey", T.hash_answer(F.concat(F.lit("so #### "), n, F.lit(" ok"))).alias("answer"))


@query(
    "drop_bracketed",
    "WITH t AS (SELECT doc_id, ' ' || coalesce(lang, '') || ' [title] x  [note] ' || source || ' ' AS x FROM documents) SELECT doc_id, replace(regexp_replace(replace(trim(x), ' [title]', '. '), '\\[.*?\\]', '', 'g'), '  ', ' ') AS x FROM t",
)
def drop_bracketed(spark, d):
    x = F.concat(F.lit(" "), F.coalesce("lang", F.lit("")), F.lit(" [title] x  [note] "), "source", F.lit(" "))
    return table(spark, d, "documents").select("doc_id", T.drop_bracketed(x).alias("x"))


@query("choices_record", "SELECT doc_id, 'quality: ' || quality AS query, [toxic, 1 - toxic] AS choices, quality AS label FROM labels WHERE quality IS NOT NULL")
def choices_record(spark, d):
    x = table(spark, d, "labels").where("quality IS NOT NULL")
    c = D.choice_record(F.concat(F.lit("quality: "), F.col("quality").cast("string")), [F.col("toxic"), 1 - F.col("toxic")], F.col("quality"))
    return x.select("doc_id", c.alias("c")).select("doc_id", "c.*")


@query("unpivot_preferences", "SELECT doc_id, 'chosen' AS kind, quality AS response FROM labels UNION ALL SELECT doc_id, 'rejected', toxic FROM labels")
def unpivot_preferences(spark, d):
    return D.both_answers(table(spark, d, "labels"), ["doc_id"], "quality", "toxic")


@query("preference_split", "WITH n AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS c FROM labels) SELECT doc_id, quality AS chosen, toxic AS rejected, CASE WHEN k < floor(c * 0.75) THEN 'train' ELSE 'test' END AS split FROM n")
def preference_split(spark, d):
    x = B.number(table(spark, d, "labels"), ["doc_id"])
    return x.select("doc_id", F.col("quality").alias("chosen"), F.col("toxic").alias("rejected"), F.when(F.col("k") < int(x.count() * 0.75), "train").otherwise("test").alias("split"))


@query("date_range_filter", "SELECT o_orderkey, [o_orderstatus] || [o_orderpriority] AS cases FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31'")
def date_range_filter(spark, d):
    x = D.within_dates(table(spark, d, "orders"), "o_orderdate", "1997-01-01", "1997-12-31")
    return x.select("o_orderkey", F.concat(F.array("o_orderstatus"), F.array("o_orderpriority")).alias("cases"))


@query("union_of_languages", "SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'de'")
def union_of_languages(spark, d):
    x = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return B.concat([x.where("lang = 'en'"), x.where("lang = 'de'")])


@query("shuffled_choices")
def shuffled_choices(spark, d):
    """Choices in hash order, and where the first of them went."""
    x = table(spark, d, "benchmark").select("item_id", F.array(*[F.concat(F.lit(c), F.col("item_id").cast("string")) for c in "abcd"]).alias("choices"))
    return D.shuffle_choices(x, "item_id", "choices", 42)


@query("prompt_length_filter", "SELECT conv_id, turn FROM conversations WHERE len(string_split(text, ' ')) <= 40")
def prompt_length_filter(spark, d):
    return table(spark, d, "conversations").where(F.size(F.split("text", " ")) <= 40).select("conv_id", "turn")


@query("boxed_answers")
def boxed_answers(spark, d):
    """The last boxed answer of synthetic solutions, by matching braces."""
    from tessera.functions import math as M

    x = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("first \\boxed{0}, then \\boxed{\\frac{"), F.col("o_custkey").cast("string"), F.lit("}{7}} end")).alias("x"))
    return x.select("o_orderkey", M.boxed(F.col("x")).alias("answer"))


@query(
    "best_turn_by_conversation",
    "SELECT conv_id, max(turn) AS last_turn, arg_max(role, turn) AS last_role, count(*) AS turns FROM conversations GROUP BY conv_id",
)
def best_turn_by_conversation(spark, d):
    return D.last_turns(table(spark, d, "conversations"), "conv_id", "turn", "role")


@query(
    "fifo_numbers",
    "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 8 AS slice FROM events",
)
def fifo_numbers(spark, d):
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    return table(spark, d, "events").select("user_id", "event_id", k.alias("place"), F.floor((k - 1) / 8).alias("slice"))


@query("batch_collated", f"WITH {NUMBERED} SELECT k // 32 AS batch, CAST(count(*) AS INTEGER) AS n, list(id ORDER BY k) AS id, list(tag ORDER BY k) AS tag FROM n GROUP BY 1")
def batch_collated(spark, d):
    return B.collate(numbered(spark, d), 32, ["id", "tag"])


@query("batch_saved", f"WITH {NUMBERED} SELECT id, obs, k, 'orders' AS source FROM n")
def batch_saved(spark, d):
    """A batch written with its meta information and read again."""
    path = f"{shared_folder(spark)}/batch-{uuid.uuid4().hex}"
    B.save(numbered(spark, d).select("id", "obs", "k"), path, {"source": "orders"})
    rows, meta = B.load(spark, path)
    return rows.withColumn("source", F.lit(meta["source"]))


@query("metrics_table", "SELECT event_id % 50 AS step, event_type AS key, max(value) AS value FROM events GROUP BY 1, 2")
def metrics_table(spark, d):
    """Metrics appended to a run's table in two goes, and read again."""
    path = f"{shared_folder(spark)}/metrics-{uuid.uuid4().hex}"
    x = table(spark, d, "events").select((F.col("event_id") % 50).alias("step"), F.col("event_type").alias("key"), "value", "event_id")
    for part in (0, 1):
        M.record(x.where(F.col("event_id") % 2 == part), path)
    return M.recorded(spark, path)
