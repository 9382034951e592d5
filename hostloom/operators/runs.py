"""Removal runs: what scripts reported, the latest run, and which hosts may get one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostloom.functions.values import can_block, removal_supported, script_os

# Report keys, exit codes, kept output.
RESULT, REMOVED, BLOCK = "FH_RESULT", "FH_REMOVED", "FH_BLOCK"
EXIT_DETAIL = {-2: "scripts are disabled on the host", -1: "the script timed out"}
TAIL = 4000


def _last(key: str, value: str):
    found = F.regexp_extract_all("output", F.lit(rf"(?m)^[ \t\r]*{key}=({value})[ \t\r]*$"), 1)
    return F.when(F.size(found) > 0, F.try_element_at(found, F.lit(-1)))


def parse_run_output(runs: DataFrame) -> DataFrame:
    """Adds outcome (queued, removed, not_found, failed), removed, block, detail and output_tail; the last line of a key
    wins; without an exit code a run is still queued."""
    result = _last(RESULT, r"[^\n]*?")
    outcome = F.when(F.col("exit_code").isNull(), "queued").when((F.col("exit_code") == 0) & result.isin("removed", "not_found"), result).otherwise("failed")
    detail = F.coalesce(*[F.when(F.col("exit_code") == k, v) for k, v in EXIT_DETAIL.items()], F.when(F.col("exit_code") != 0, F.concat(F.lit("exit code "), F.col("exit_code").cast("string"))))
    return runs.withColumns({"outcome": outcome, "removed": F.coalesce(_last(REMOVED, "[0-9]+").cast("bigint"), F.lit(0)), "block": _last(BLOCK, r"[^\n]*?"), "detail": detail, "output_tail": F.substring("output", -TAIL, TAIL)})


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest run of each extension and host, and `pending`: queued runs of the pair."""
    w = Window.partitionBy("extension_key", "host_id")
    order = w.orderBy(F.desc("requested_at"), F.desc("execution_id"))
    return runs.withColumns({"_r": F.row_number().over(order), "pending": F.sum(F.col("exit_code").isNull().cast("long")).over(w)}).where("_r = 1").drop("_r")


def removal_eligibility(installs: DataFrame, host_state: DataFrame, runs: DataFrame, windows: bool = True) -> DataFrame:
    """(extension_key, host_id, reason, eligible, blockable): for each host with the extension the first reason against a
    removal: built-in, unsupported store or id, platform, Windows off, scripts off, already queued.

    installs: (extension_key, store, extension_id, is_builtin, host_id, platform); host_state: (host_id, scripts_enabled).
    """
    queued = runs.where(F.col("exit_code").isNull()).select("extension_key", "host_id").distinct().withColumn("queued", F.lit(True))
    df = installs.join(host_state, "host_id", "left").join(queued, ["extension_key", "host_id"], "left").withColumn("os", script_os(F.col("platform")))
    reason = (
        F.when(F.coalesce("is_builtin", F.lit(False)), "built-in").when(~removal_supported(F.col("store"), F.col("extension_id")), "unsupported").when(F.col("os") == "none", "platform")
        .when((F.col("os") == "windows") & F.lit(not windows), "windows off").when(~F.coalesce("scripts_enabled", F.lit(True)), "scripts off").when(F.col("queued"), "queued")
    )
    return df.select("extension_key", "host_id", reason.alias("reason"), reason.isNull().alias("eligible"), can_block(F.col("os"), F.col("store")).alias("blockable"))
