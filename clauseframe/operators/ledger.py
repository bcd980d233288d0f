"""The request ledger: ids, what is still to be asked, answers of providers, prices, costs, and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from clauseframe.functions import text as X
from clauseframe.schemas import MODEL_PRICE

#: Most characters of a batch's input.
BATCH_CHARS = 209_715_200
#: Unified states of a batch by what each provider says.
STATES_A = {
    "validating": "in_progress", "in_progress": "in_progress", "finalizing": "in_progress", "completed": "completed", "failed": "failed",
    "expired": "expired", "cancelling": "in_progress", "cancelled": "canceled",
}
STATES_B = {"in_progress": "in_progress", "ended": "completed", "failed": "failed", "canceled": "canceled", "expired": "expired"}
TERMINAL = ("completed", "failed", "expired", "canceled")


def requests(passages: DataFrame, run: str, task: str, model: str, messages: Column) -> DataFrame:
    """One row a request: custom_id, task, pkg, idx, model, messages, prompt_hash."""
    return passages.select(
        X.custom_id(F.lit(run), F.lit(task), F.col("pkg"), F.col("idx")).alias("custom_id"), F.lit(task).alias("task"), "pkg", "idx", F.lit(model).alias("model"),
        messages.alias("messages"), prompt_hash(model, messages).alias("prompt_hash"),
    )


def prompt_hash(model: str, messages: Column) -> Column:
    return F.sha2(F.concat(F.lit(model), F.to_json(messages)), 256)


def pending(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """Requests that the ledger has no answer to; asking again after a crash asks only for these."""
    return wanted.join(done.select("custom_id"), "custom_id", "left_anti")


def distinct_prompts(wanted: DataFrame) -> DataFrame:
    """One request for each prompt; ``fan_out`` gives the answer back to all that share it."""
    return wanted.groupBy("prompt_hash").agg(F.first("model").alias("model"), F.first("messages").alias("messages"))


def fan_out(wanted: DataFrame, answered: DataFrame) -> DataFrame:
    return wanted.join(answered.select("prompt_hash", *[c for c in answered.columns if c not in wanted.columns]), "prompt_hash", "left")


def batch_line_a(custom_id: Column, model: Column, messages: Column, max_tokens: int, temperature: float = 0.0) -> Column:
    body = F.struct(model.alias("model"), messages.alias("messages"), F.lit(max_tokens).alias("max_tokens"), F.lit(temperature).alias("temperature"))
    return F.to_json(F.struct(custom_id.alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body")))


def batch_line_b(custom_id: Column, model: Column, messages: Column, max_tokens: int, temperature: float = 0.0) -> Column:
    """The other provider takes the system text apart from the messages."""
    system = F.get(F.filter(messages, lambda m: m["role"] == "system"), F.lit(0))["content"]
    rest = F.filter(messages, lambda m: m["role"] != "system")
    params = F.struct(model.alias("model"), F.lit(max_tokens).alias("max_tokens"), F.lit(temperature).alias("temperature"), system.alias("system"), rest.alias("messages"))
    return F.to_json(F.struct(custom_id.alias("custom_id"), params.alias("params")))


def check_batch(lines: DataFrame | GroupedData, column: str = "value", most: int = BATCH_CHARS, more: list[Column] | None = None) -> DataFrame:
    """n_lines, n_chars, ok: a batch needs at least one character and no more than the provider takes; of grouped lines, each group."""
    return lines.agg(F.count("*").alias("n_lines"), F.coalesce(F.sum(F.length(column)), F.lit(0)).alias("n_chars"), *(more or [])).withColumn("ok", (F.col("n_chars") > 0) & (F.col("n_chars") <= most))


def answers_a(raw: DataFrame) -> DataFrame:
    """custom_id, response, in_tokens, out_tokens, error from one provider's result lines."""
    body, choice = F.col("response.body"), F.get(F.col("response.body.choices"), F.lit(0))
    problem = (
        F.when(F.col("error").isNotNull(), F.col("error")).when(F.coalesce(F.col("response.status_code"), F.lit(0)) != 200, F.concat(F.lit("status "), F.coalesce(F.col("response.status_code").cast("string"), F.lit("missing"))))
        .when(F.coalesce(F.size(body["choices"]), F.lit(0)) < 1, F.lit("no choices"))
        .when(~F.coalesce(choice["finish_reason"], F.lit("")).isin("stop", "length"), F.concat(F.lit("finish reason "), F.coalesce(choice["finish_reason"], F.lit("missing"))))
    )
    return raw.select("custom_id", F.when(problem.isNull(), choice["message"]["content"]).alias("response"), body["usage"]["prompt_tokens"].alias("in_tokens"), body["usage"]["completion_tokens"].alias("out_tokens"), problem.alias("error"))


def answers_b(raw: DataFrame) -> DataFrame:
    kind = F.col("result.type")
    problem = F.when(F.coalesce(kind, F.lit("")) != "succeeded", F.concat(F.lit("result "), F.coalesce(kind, F.lit("missing"))))
    usage = F.col("result.message.usage")
    return raw.select("custom_id", F.when(problem.isNull(), F.get(F.col("result.message.content"), F.lit(0))["text"]).alias("response"), usage["input_tokens"].alias("in_tokens"), usage["output_tokens"].alias("out_tokens"), problem.alias("error"))


def with_answers(wanted: DataFrame, answers: DataFrame) -> DataFrame:
    """Every request with its answer: one hash join by id. A request without one has the error "missing"."""
    one = answers.groupBy("custom_id").agg(F.min_by(F.struct("response", "in_tokens", "out_tokens", "error"), F.struct(F.col("error").isNotNull(), F.to_json(F.struct("response", "error")))).alias("__a"))
    met = wanted.join(one, "custom_id", "left")
    return met.select(*wanted.columns, "__a.response", "__a.in_tokens", "__a.out_tokens", F.when(F.col("__a").isNull(), F.lit("missing")).otherwise(F.col("__a.error")).alias("error"))


def errors(answered: DataFrame, stage: str) -> DataFrame:
    """The quarantine rows of a stage: pkg, stage, message."""
    return answered.where("error IS NOT NULL").select("pkg", F.lit(stage).alias("stage"), F.concat_ws(": ", "custom_id", "error").alias("message"))


#: USD per million tokens: key, provider, encoding, input, cached input, output, batch input, batch output, JSON answers.
PRICES = [
    ("gpt-3.5-turbo", "openai", "cl100k_base", 0.5, 0.5, 1.5, 0.25, 0.75, True),
    ("gpt-4", "openai", "cl100k_base", 30.0, 0.5, 60.0, 15.0, 30.0, True),
    ("gpt-4o", "openai", "o200k_base", 2.5, 0.5, 10.0, 1.25, 5.0, True),
    ("gpt-4o-mini-2024-07-18", "openai", "o200k_base", 0.15, 0.15, 0.6, 0.075, 0.3, True),
    ("gpt-4.1-2025-04-14", "openai", "cl100k_base", 2.0, 0.5, 8.0, 1.0, 4.0, True),
    ("gpt-4.1-mini-2025-04-14", "openai", "cl100k_base", 0.4, 0.1, 1.6, 0.2, 0.8, True),
    ("gpt-4.1-nano-2025-04-14", "openai", "cl100k_base", 0.1, 0.025, 0.4, 0.05, 0.2, True),
    ("claude-opus-4", "anthropic", "cl100k_base", 15.0, None, 75.0, 7.5, 37.5, True),
    ("claude-sonnet-4", "anthropic", "cl100k_base", 3.0, None, 15.0, 1.5, 7.5, True),
    ("claude-3-7-sonnet", "anthropic", "cl100k_base", 3.0, None, 15.0, 1.5, 7.5, True),
    ("claude-3-5-sonnet", "anthropic", "cl100k_base", 15.0, None, 75.0, 7.5, 37.5, True),
    ("claude-3-5-haiku", "anthropic", "cl100k_base", 0.8, None, 4.0, 0.4, 2.0, True),
    ("deepseek-reasoner", "deepseek", "cl100k_base", 0.135, None, 0.55, 0.25, 0.75, False),
    ("deepseek-v3", "deepseek", "cl100k_base", 0.135, None, 0.55, 15.0, 30.0, True),
] + [
    (name, "ollama", "o200k_base", 0.0, None, 0.0, 0.0, 0.0, True)
    for name in (
        "deepseek-r1:7b", "deepseek-r1:70b", "deepseek-r1:671b", "gemma2:27b", "gemma3:27b", "gemma3n:e4b", "llama3.3:70b", "llama4:16x17b", "llama3.2",
        "mistral-large:123b", "mixtral:8x22b", "phi4:14b", "qwen2.5:72b", "qwen3:32b", "qwen3:4b",
    )
]


#: Names that providers use, where they aren't the key.
NAMES = {"gpt-4o": "gpt-4o-2024-11-20"}


def price_table(spark: SparkSession, prices: list[tuple] = PRICES) -> DataFrame:
    """The model dimension, a few dozen rows; pass the price list that holds."""
    rows = [(k, NAMES.get(k, k), api, enc, *(None if p is None else p / 1e6 for p in (i, c, o, bi, bo)), js) for k, api, enc, i, c, o, bi, bo, js in prices]
    return spark.createDataFrame(rows, MODEL_PRICE)


def model_of(prices: DataFrame, model: str) -> DataFrame:
    """The row of a model, by its key or, failing that, by the provider's name for it; no row if neither is known."""
    return prices.where((F.col("key") == model) | (F.col("name") == model)).orderBy(F.col("key") != model, "key").limit(1)


def with_keys(calls: DataFrame, prices: DataFrame, model: str = "model") -> DataFrame:
    """Calls with ``model_key``: the key of the model that a provider's answer names, or the name itself."""
    names = prices.groupBy("name").agg(F.min("key").alias("model_key")).select(F.col("name").alias(model), "model_key")
    met = calls.join(F.broadcast(names), model, "left")  # the model dimension: a few dozen rows
    return met.select(*calls.columns, F.coalesce("model_key", model).alias("model_key"))


def with_cost(calls: DataFrame, prices: DataFrame, batch: bool = False) -> DataFrame:
    """Calls with ``cost``: tokens by unit price, cached ones at theirs; 0 for a model without price."""
    p = prices.select(F.col("key").alias("model"), *(F.col(c).alias(f"__{c}") for c in ("input_price", "input_price_cached", "output_price", "input_price_batch", "output_price_batch")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    cached = zero("cached_tokens") if "cached_tokens" in calls.columns else F.lit(0)
    if batch:
        cost = zero("in_tokens") * F.col("__input_price_batch") + zero("out_tokens") * F.col("__output_price_batch")
    else:
        cost = (zero("in_tokens") - cached) * F.col("__input_price") + cached * F.coalesce("__input_price_cached", "__input_price") + zero("out_tokens") * F.col("__output_price")
    return calls.join(F.broadcast(p), "model", "left").select(*calls.columns, F.coalesce(cost, F.lit(0.0)).alias("cost"))


def cost_by(calls: DataFrame, *keys: str) -> DataFrame:
    return calls.groupBy(*keys).agg(F.count("*").alias("n_calls"), F.sum("cost").alias("cost"), F.sum("secs").alias("secs"))


def unified_state(state: Column, states: dict[str, str] = STATES_A) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in states.items() for x in kv))
    return F.coalesce(pairs[state], F.lit("in_progress"))


def batch_total() -> Column:
    """All requests of a batch, from its five counters."""
    return sum((F.coalesce(F.col(c), F.lit(0)) for c in ("succeeded", "errored", "canceled", "expired")), F.coalesce(F.col("processing"), F.lit(0)))


def epoch_time(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def iso_time(text: Column) -> Column:
    return F.try_to_timestamp(text)
