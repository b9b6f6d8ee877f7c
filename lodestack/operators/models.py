"""JSON of a local model runtime as columns: request bodies, model lists, completions, usage, health."""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import ContractError


def chat_bodies(messages: DataFrame, by: list[str], order: list[str], model: str, max_tokens: int, temperature: float = 0.0, seed: int | None = None) -> DataFrame:
    """One request body for each conversation, its messages in order; no streaming; a seed only if there is one."""
    each = F.array_sort(F.collect_list(F.struct(*order, F.struct("role", F.col("text").alias("content")).alias("message"))))
    fields = [F.lit(model).alias("model"), F.transform("all", lambda m: m["message"]).alias("messages"), F.lit(max_tokens).alias("max_tokens"), F.lit(temperature).alias("temperature"), F.lit(False).alias("stream")]
    if seed is not None:
        fields.append(F.lit(seed).alias("seed"))
    return messages.groupBy(*by).agg(each.alias("all")).select(*by, F.to_json(F.struct(*fields)).alias("body"))


def model_ids(payload: Column) -> Column:
    """Stripped ids of a model list; null where the payload is no list, or an id is blank or repeated."""
    data = F.from_json(payload, "struct<data:array<struct<id:string>>>")["data"]
    ids = F.transform(data, lambda m: F.trim(m["id"]))
    good = data.isNotNull() & ~F.exists(ids, lambda i: i.isNull() | (i == "")) & (F.size(ids) == F.size(F.array_distinct(ids)))
    return F.when(good, ids)


def completion(payload: Column, fallback_model: str) -> Column:
    """model, text and finish_reason of the first choice; null where there is no text."""
    p = F.from_json(payload, "struct<model:string, choices:array<struct<message:struct<content:string>, finish_reason:string>>>")
    first = F.get(p["choices"], F.lit(0))
    return F.when(first["message"]["content"].isNotNull(), F.struct(F.coalesce(p["model"], F.lit(fallback_model)).alias("model"), first["message"]["content"].alias("text"), first["finish_reason"].alias("finish_reason")))


def usage_status(prompt: Column, completed: Column, total: Column) -> Column:
    """valid, absent, negative or too_small (the total must hold both parts)."""
    return F.when(prompt.isNull() & completed.isNull() & total.isNull(), "absent").when(F.least(prompt, completed, total) < 0, "negative").when(total < F.coalesce(prompt, F.lit(0)) + F.coalesce(completed, F.lit(0)), "too_small").otherwise("valid")


def parse_usage(payload: Column) -> Column:
    return F.from_json(payload, "struct<usage:struct<prompt_tokens:long, completion_tokens:long, total_tokens:long>>")["usage"]


def health(reachable: Column, ids: Column) -> Column:
    """unavailable when unreachable, degraded without a valid list of models or with an empty one, else ready."""
    return F.when(~reachable, "unavailable").when(ids.isNull() | (F.size(ids) == 0), "degraded").otherwise("ready")


def checked_loopback(url: str) -> str:
    """An http URL of a numeric loopback address, without user, query or fragment; else ContractError."""
    import ipaddress

    parts = urlsplit(url)
    try:
        loop = ipaddress.ip_address(parts.hostname or "").is_loopback
        _ = parts.port
    except ValueError:
        loop = False
    if parts.scheme != "http" or not loop or parts.username or parts.query or parts.fragment:
        raise ContractError("the URL must be http on a numeric loopback address")
    return url.rstrip("/")
