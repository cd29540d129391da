"""Compliance scorecard and the account health summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions import asc, day_start, ntz, ordered, round_to
from gaugework.operators.filters import active_only, lookback, lookback_start, since
from gaugework.operators.reshape import union_all
from gaugework.operators.security import (
    MAX_TOP_ADMINS,
    TOP_ADMIN,
    inactive_since,
    is_false,
    is_true,
    privileged_without_mfa_count,
)

# Limits of the checks.
MFA_GOOD_PCT, MFA_FAIR_PCT = 80, 50
AUTO_SUSPEND_MAX_SEC = 600
STALE_DAYS = 90

OK, WARN, INFO, CRITICAL = "OK", "WARN", "INFO", "CRITICAL"


def _check(
    row: DataFrame, category: str, control: str, good: Column, otherwise: str | Column, detail: str
) -> DataFrame:
    """``row`` has one ``value``; ``detail`` follows the number in the text."""
    other = F.lit(otherwise) if isinstance(otherwise, str) else otherwise
    return row.select(
        F.lit(category).alias("category"),
        F.lit(control).alias("control"),
        F.when(good, OK).otherwise(other).alias("status"),
        F.col("value").cast("double").alias("value"),
        F.concat(F.col("value").cast("string"), F.lit(" " + detail)).alias("detail"),
    )


def compliance_scorecard(
    us: DataFrame,
    gu: DataFrame,
    rm: DataFrame,
    ws: DataFrame,
    network: DataFrame,
    masking: DataFrame,
    row_access: DataFrame,
    qh: DataFrame,
    as_of,
) -> DataFrame:
    """Ten checks, one row each; the MFA check is absent when there are no enabled users.

    ``ws`` is the normalised warehouse settings table.  Every check reduces its table to
    one row before the rows are stacked.
    """
    value = F.col("value")
    none, some = value == 0, value > 0

    def count(df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("value"))

    enabled = active_only(us).where(is_false("disabled"))
    mfa = (
        enabled.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_true("ext_authn_duo")).alias("m"))
        .where(F.col("n") > 0)
        .select((F.col("m") / F.col("n") * 100).alias("pct"))
        .select("pct", round_to("pct", 1).alias("value"))
    )
    remote_spill = lookback(qh, "start_time", 30, "day", as_of).where(
        F.col("bytes_spilled_to_remote_storage") > 0
    )
    checks = [
        _check(
            mfa,
            "security",
            "mfa_enabled",
            F.col("pct") > MFA_GOOD_PCT,
            F.when(F.col("pct") > MFA_FAIR_PCT, WARN).otherwise(CRITICAL),
            "% of enabled users with MFA",
        ),
        _check(count(network), "security", "network_policy", some, CRITICAL, "network policies"),
        _check(
            privileged_without_mfa_count(us, gu).withColumnRenamed("cnt", "value"),
            "security",
            "admins_without_mfa",
            none,
            CRITICAL,
            "privileged users without MFA",
        ),
        _check(
            count(active_only(gu).where(F.col("role") == TOP_ADMIN)),
            "rbac",
            "top_admin_count",
            value <= MAX_TOP_ADMINS,
            WARN,
            "holders of the top admin role",
        ),
        _check(count(rm), "finops", "resource_monitors", some, WARN, "resource monitors"),
        _check(
            count(ws.where(F.col("auto_suspend").isNull() | (F.col("auto_suspend") > AUTO_SUSPEND_MAX_SEC))),
            "warehouse",
            "auto_suspend",
            none,
            WARN,
            "warehouses without auto-suspend within 600 s",
        ),
        _check(
            count(enabled.where(inactive_since(as_of, STALE_DAYS))),
            "rbac",
            "stale_users",
            none,
            WARN,
            "users without a login for 90 days",
        ),
        _check(
            count(active_only(masking, "deleted")), "data_protection", "masking_policies", some, INFO, "masking policies"
        ),
        _check(
            count(active_only(row_access, "deleted")),
            "data_protection",
            "row_access_policies",
            some,
            INFO,
            "row access policies",
        ),
        _check(
            remote_spill.agg(F.countDistinct("warehouse_name").alias("value")),
            "warehouse",
            "remote_spill",
            none,
            CRITICAL,
            "warehouses with remote spill",
        ),
    ]
    return union_all(*checks)


def compliance_score(scorecard: DataFrame) -> DataFrame:
    """Totals per status class; INFO counts as a warning."""
    s = F.col("status")
    total, ok = F.count(F.lit(1)), F.count_if(s == OK)
    return scorecard.agg(
        ok.alias("ok"),
        F.count_if(s.isin(WARN, INFO)).alias("warn"),
        F.count_if(s == CRITICAL).alias("critical"),
        total.alias("total"),
        F.try_divide(ok, total).alias("ratio"),
    )


def compliance_by_category(scorecard: DataFrame) -> DataFrame:
    s = F.col("status")
    out = scorecard.groupBy("category").agg(
        F.count_if(s == OK).alias("ok"),
        F.count_if(s.isin(WARN, INFO)).alias("warn"),
        F.count_if(s == CRITICAL).alias("critical"),
        F.count(F.lit(1)).alias("total"),
    )
    return ordered(out, asc("category"))


def health_context(lh: DataFrame, wm: DataFrame, us: DataFrame, as_of) -> DataFrame:
    """One JSON object with four headline figures; a figure without data is left out."""
    day_ago = lookback_start(as_of, 24, "hour")
    failed = (
        since(lh, "event_timestamp", day_ago, as_of)
        .where((F.col("event_timestamp") > ntz(day_ago)) & (F.col("is_success") == "NO"))
        .select(F.lit(1).alias("f"))
    )
    credits = since(wm, "start_time", day_start(as_of), as_of).select(F.col("credits_used").alias("c"))
    users = active_only(us).select(F.lit(1).alias("u"), F.when(is_false("has_mfa"), 1).alias("m"))
    row = union_all(failed, credits, users).agg(
        F.count("f").alias("failed_logins_24h"),
        round_to(F.sum("c"), 2).alias("credits_used_today"),
        F.count("u").alias("total_users"),
        F.count("m").alias("users_without_mfa"),
    )
    return row.select(F.to_json(F.struct(*row.columns)).alias("ctx"))
