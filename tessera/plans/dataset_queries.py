"""Queries of tokenised datasets and of metrics that are observed while a query runs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import metrics as M
from tessera.operators import tokens as T
from tessera.plans import query, table
from tessera.plans.rollout_queries import r
from tessera.sources.shared import shared_folder
from tessera.streaming import live

TEMPLATE = T.ChatTemplate()

# Words of a text and their ids, as the stand-in tokenizer has them.
_IDS = "list_transform(list_filter(regexp_split_to_array({}, '[ \\t-\\r]+'), lambda w: w <> ''), lambda w: CAST('0x' || substr(md5(w), 1, 7) AS BIGINT))"
_MESSAGE = "'<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10)"
_ASK = "'<|im_start|>assistant' || chr(10)"


def _zeros(n: str) -> str:
    return f"list_transform(range(CAST({n} AS BIGINT)), lambda x: CAST(0 AS BIGINT))"


def _ones(n: str) -> str:
    return f"list_transform(range(CAST({n} AS BIGINT)), lambda x: CAST(1 AS BIGINT))"


def _rows(n: int) -> str:
    return f"""WITH m AS MATERIALIZED (SELECT conv_id, turn, role, text, {_IDS.format(_MESSAGE)} AS ids FROM conversations),
t AS MATERIALIZED (SELECT conv_id, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS loss, turn, role, text, unnest(ids) AS id, unnest(range(len(ids))) AS k FROM m),
c AS MATERIALIZED (SELECT conv_id, list(id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST, k)[:{n}] AS ids,
  list(CAST(loss AS BIGINT) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST, k)[:{n}] AS loss FROM t GROUP BY conv_id)
SELECT conv_id, ids || {_zeros(f'{n} - len(ids)')} AS input_ids, {_ones('len(ids)')} || {_zeros(f'{n} - len(ids)')} AS attention_mask,
  range(len(ids)) || {_zeros(f'{n} - len(ids)')} AS position_ids, loss || {_zeros(f'{n} - len(ids)')} AS loss_mask FROM c"""


@query("training_rows", _rows(256))
def training_rows(spark, d):
    """Token ids, masks and places of every conversation, 256 long."""
    return T.training_rows(table(spark, d, "conversations"), "conv_id", "turn", "role", "text", TEMPLATE, T.Words, 256, truncation="right")


def _prompts(spark, d: str):
    """Each turn as a prompt of one message."""
    return table(spark, d, "conversations").select("conv_id", "turn", F.array(F.struct("role", F.col("text").alias("content"))).alias("messages"))


_PROMPT = f"{_IDS.format(_MESSAGE + ' || ' + _ASK)}"


@query(
    "tokenised_prompts",
    f"""WITH p AS MATERIALIZED (SELECT conv_id, turn, {_PROMPT} AS ids FROM conversations),
c AS (SELECT conv_id, turn, CASE WHEN len(ids) > 48 THEN ids[:24] || ids[len(ids) - 23:] ELSE ids END AS raw_prompt_ids FROM p)
SELECT conv_id, turn, {_zeros('48 - len(raw_prompt_ids)')} || raw_prompt_ids AS input_ids, {_zeros('48 - len(raw_prompt_ids)')} || {_ones('len(raw_prompt_ids)')} AS attention_mask,
  {_zeros('48 - len(raw_prompt_ids)')} || range(len(raw_prompt_ids)) AS position_ids, raw_prompt_ids FROM c""",
)
def tokenised_prompts(spark, d):
    """Every turn as a prompt by the chat template: 48 tokens, padded at the left, cut in the middle."""
    return T.prompts(_prompts(spark, d), "messages", TEMPLATE, T.Words, 48, truncation="middle").drop("messages")


@query("prompt_token_filter", f"SELECT conv_id, turn FROM conversations WHERE len({_PROMPT}) <= 40")
def prompt_token_filter(spark, d):
    """Turns that have 40 tokens at most as a prompt by the chat template."""
    return T.short_prompts(_prompts(spark, d), "messages", TEMPLATE, T.Words, 40).select("conv_id", "turn")


# Live metrics -----------------------------------------------------------------------

_OBSERVED = "SELECT count(*) AS n, count(DISTINCT event_type) AS kinds, max(value) AS top, min(value) AS least FROM events"


@query("observed_batch", f"SELECT CAST(1 AS BIGINT) AS step, 'events/' || key AS key, round(value, 6) AS value FROM (UNPIVOT (SELECT CAST(n AS DOUBLE) AS n, top, least FROM ({_OBSERVED})) ON n, top, least INTO NAME key VALUE value)")
def observed_batch(spark, d):
    """What was observed of all events while they were written by type, as the run's metrics table has it."""
    base = f"{shared_folder(spark)}/observed-{uuid.uuid4().hex}"
    rows, finish = live.observed(table(spark, d, "events"), "events", 1, f"{base}/metrics", n=F.count(F.lit(1)), top=F.max("value"), least=F.min("value"))
    rows.groupBy("event_type").agg(F.sum("value").alias("total")).write.parquet(f"{base}/rows")
    finish()
    return M.recorded(spark, f"{base}/metrics").select("step", "key", r(F.col("value"), "value"))


@query("observed_stream", f"SELECT 'events/' || key AS key, round(value, 6) AS value FROM (UNPIVOT (SELECT CAST(n AS DOUBLE) AS n, top FROM ({_OBSERVED})) ON n, top INTO NAME key VALUE value)")
def observed_stream(spark, d):
    """What was observed batch by batch of a stream of all events, over its steps."""
    base = f"{shared_folder(spark)}/observed-{uuid.uuid4().hex}"
    events = table(spark, d, "events")
    # As a pattern the path may be a file or a folder.
    stream = spark.readStream.schema(events.schema).parquet(f"{d}/events.parque[t]").observe("events", F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    with live.Recorder(spark, "events", f"{base}/metrics") as recorder:
        q = stream.select("event_id").writeStream.format("noop").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        recorder.wait(str(q.runId))
    return live.of_steps(M.recorded(spark, f"{base}/metrics"), ["events/n"], ["events/top"]).select("key", r(F.col("value"), "value"))
