"""Literal records that go with a row: provenance, failure reports, manifests, retry delays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import task_key


def provenance(environment: Column, task: Column, attempt: Column, model: Column, run: Column, revision: Column, *, thinking: str = "enabled", effort: str = "high", turns: int = 25, pool_hash: Column | None = None, endpoint: Column | None = None) -> Column:
    """Where an attempt comes from; the pool's hash and the endpoint only where they are given."""
    env, key = F.trim(environment.cast("string")), F.trim(task.cast("string"))
    fields = {
        "task_key": task_key(env, key), "env_name": env, "task_id": key, "pass_index": attempt.cast("int"), "model": model.cast("string"), "thinking": F.lit(thinking),
        "reasoning_effort": F.lit(effort), "max_turns": F.lit(turns), "code_revision": revision, "collection_run_id": run.cast("string"),
    } | {k: v for k, v in {"task_pool_hash": pool_hash, "api_endpoint_label": endpoint}.items() if v is not None}
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def invalid_report(reason: Column, version: str) -> Column:
    """The report of an attempt that a failure of the evaluation ended: no reward, not for training."""
    return F.struct(F.lit(version).alias("reward_version"), F.lit(False).alias("reward_valid"), F.lit(False).alias("reward_valid_for_training"), F.lit(0.0).alias("terminal_reward"), reason.cast("string").alias("termination_reason"))


def manifest(path: Column, config: Column, revision: Column, *, contract: str, version: str) -> Column:
    """What an evaluation ran on."""
    return F.struct(F.lit(contract).alias("contract_version"), F.lit(version).alias("reward_version"), path.alias("data_path"), config.alias("config"), revision.alias("code_revision"))


def retry_delay(attempt: Column, jitter: Column) -> Column:
    """Seconds before a retry: powers of two and up to half a second of ``jitter`` (0 to 1), 8 at most."""
    return F.least(F.lit(8.0), F.pow(F.lit(2.0), F.greatest(attempt, F.lit(0))) + jitter * 0.5)


def transient(error: Column) -> Column:
    """Whether an error's name tells of something that may pass."""
    return F.coalesce(F.lower(error).rlike("timeout|connection|network|rate|server"), F.lit(False))


def refused(scorer: str) -> Column:
    """A score that fails as soon as it is read, for records that this scorer must not grade."""
    return F.raise_error(F.lit(f"{scorer} grades in its environment, not from text")).cast("double")
