"""Prompt templates from a folder, and message lists from templates, few-shots and passages."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_EXAMPLE = re.compile(r"example_(\w+?)_(user|assistant)\.\w+$")
MESSAGES = "array<struct<role:string,content:string>>"


def prompt_files(spark: SparkSession, folder: str) -> DataFrame:
    """name, content of the files of a prompt folder, whichever store it is in."""
    files = spark.read.text(folder, wholetext=True)
    return files.select(F.regexp_extract(F.col("_metadata.file_name"), r"([^/]+)$", 1).alias("name"), F.col("value").alias("content"))


def minified(text: str) -> str:
    return json.dumps(json.loads(text))


def load_prompts(spark: SparkSession, folder: str) -> tuple[str | None, list[tuple[str | None, str | None]], dict | None]:
    """System text, few-shot pairs in order of their number, response schema; (None, [], None) if any file can't be read.

    A pair of which one half is missing has None there. A schema wrapped in settings is unwrapped.
    """
    try:
        rows = sorted((r["name"], r["content"]) for r in prompt_files(spark, folder).collect())  # a few dozen files
        system, schema, pairs = None, None, {}
        for name, content in rows:
            if name.startswith("system."):
                system = content
            elif name.startswith("response_schema."):
                schema = json.loads(content)
                schema = schema.get("schema", schema) if "strict" in schema or "name" in schema else schema
            elif m := _EXAMPLE.search(name):
                pairs.setdefault(m[1], {})[m[2]] = minified(content) if name.endswith("json") else content
        order = sorted(pairs, key=lambda i: (not i.isdigit(), int(i) if i.isdigit() else 0, i))
        return system, [(pairs[i].get("user"), pairs[i].get("assistant")) for i in order], schema
    except Exception as e:  # noqa: BLE001  the contract: any failure gives no prompt at all
        print(f"prompts of {folder} can't be loaded: {e}")
        return None, [], None


def pair_table(files: DataFrame) -> DataFrame:
    """ord, user, assistant from a table of prompt files (name, content): both halves of a few-shot in one row."""
    part = lambda i: F.regexp_extract("name", _EXAMPLE.pattern, i)
    halves = files.where(F.col("name").rlike(_EXAMPLE.pattern)).withColumns({"ord": part(1), "half": part(2)})
    return halves.groupBy("ord").pivot("half", ["user", "assistant"]).agg(F.first("content"))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def messages(system: Column, fewshots: Column, user: Column) -> Column:
    """The message list: system, then user and assistant of each few-shot, then the user's message."""
    shots = F.flatten(F.transform(fewshots, lambda s: F.array(message("user", s["user"]), message("assistant", s["assistant"]))))
    return F.concat(F.when(system.isNotNull(), F.array(message("system", system))).otherwise(F.array().cast(MESSAGES)), F.coalesce(shots, F.array().cast(MESSAGES)), F.array(message("user", user)))


def static_fewshots(pairs: list[tuple[str | None, str | None]]) -> Column:
    kind = "struct<rank:int,user:string,assistant:string>"
    return F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(u).alias("user"), F.lit(a).alias("assistant")) for i, (u, a) in enumerate(pairs))).cast(f"array<{kind}>")


def chosen_fewshots(given: Column, pairs: list[tuple[str | None, str | None]]) -> Column:
    """Supplied few-shots win over those of files, but not if they are empty."""
    return F.when(F.coalesce(F.size(given), F.lit(0)) > 0, given).otherwise(static_fewshots(pairs))


#: How each provider is asked for a kind of answer.
def response_format(provider: str, kind: str, schema: dict | None = None) -> dict | str | None:
    if kind == "text":
        return {"type": "text"} if provider in ("openai", "deepseek") else None
    if kind == "json":
        return {"openai": {"type": "json_object"}, "deepseek": {"type": "json_object"}, "ollama": "json"}.get(provider)
    if kind != "json_schema":
        raise ValueError(f"unknown kind of answer: {kind}")
    if provider == "openai":
        return {"type": "json_schema", "json_schema": {"name": "response", "strict": True, "schema": schema}}
    return schema if provider == "ollama" else {"type": "json_object"} if provider == "deepseek" else None


def message_rows(rows: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """One message list for each conversation of a table of turns."""
    turn = F.struct(order, "role", F.col("text").alias("content"))
    return rows.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(turn)), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages"))
