"""Logins, user posture, roles, grants and policies.

Some sources carry flags as the strings ``'true'`` / ``'false'``; :func:`as_bool`
reads both those and booleans.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions import as_datetime, asc, desc, ntz, ordered, top_k
from gaugework.operators.filters import active_only, lookback, lookback_start, period_filter
from gaugework.operators.reshape import union_all

# The administrative roles.
TOP_ADMIN = "ACCOUNTADMIN"
OTHER_ADMINS = ("SYSADMIN", "SECURITYADMIN")
ADMIN_ROLES = (TOP_ADMIN, *OTHER_ADMINS)
MAX_TOP_ADMINS = 3


def as_bool(col: str) -> Column:
    return F.col(col).try_cast("boolean")


def is_true(col: str) -> Column:
    return F.coalesce(as_bool(col), F.lit(False))


def is_false(col: str) -> Column:
    """True only for an explicit false; NULL is not false."""
    return F.coalesce(~as_bool(col), F.lit(False))


def inactive_since(as_of, days: int, col: str = "last_success_login") -> Column:
    """No login for ``days`` days, or never."""
    return F.col(col).isNull() | (F.col(col) < ntz(lookback_start(as_of, days, "day")))


# ---- logins ---------------------------------------------------------------------


def failed_logins(lh: DataFrame, start, end) -> DataFrame:
    out = (
        period_filter(lh, "event_timestamp", start, end)
        .where(F.col("is_success") == "NO")
        .groupBy("user_name", "client_ip", "reported_client_type", "error_message")
        .agg(
            F.count(F.lit(1)).alias("failed_attempts"),
            F.min("event_timestamp").alias("first_attempt"),
            F.max("event_timestamp").alias("last_attempt"),
        )
    )
    return ordered(out, desc("failed_attempts"), asc("user_name"), asc("client_ip"))


def failed_logins_total(lh: DataFrame, start, end) -> DataFrame:
    rows = period_filter(lh, "event_timestamp", start, end).where(F.col("is_success") == "NO")
    return rows.agg(F.count(F.lit(1)).alias("total_failed"))


def failed_logins_daily(lh: DataFrame, as_of, k: int = 30) -> DataFrame:
    by_day = (
        lookback(lh, "event_timestamp", 7, "day", as_of)
        .where(F.col("is_success") == "NO")
        .groupBy(
            F.to_date("event_timestamp").alias("day"),
            "user_name",
            F.col("reported_client_type").alias("client"),
            F.col("client_ip").alias("ip"),
            "error_message",
        )
        .agg(F.count(F.lit(1)).alias("attempts"))
    )
    return top_k(by_day, k, desc("attempts"))


LOGIN_COLUMNS = (
    "event_timestamp",
    "user_name",
    "client_ip",
    "reported_client_type",
    "first_authentication_factor",
    "is_success",
    "error_message",
)


def login_history(lh: DataFrame, start, end, k: int | None = 500) -> DataFrame:
    rows = period_filter(lh, "event_timestamp", start, end).select(*LOGIN_COLUMNS)
    return top_k(rows, k, desc("event_timestamp"))


def login_kpis(lh: DataFrame, start, end, k: int | None = None) -> DataFrame:
    """Successes and failures of the period; ``k`` restricts them to the logins :func:`login_history` lists."""
    return login_history(lh, start, end, k).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("is_success") == "YES").alias("succeeded"),
        F.count_if(F.col("is_success") == "NO").alias("failed"),
    )


def login_clients(lh: DataFrame, as_of) -> DataFrame:
    out = (
        lookback(lh, "event_timestamp", 7, "day", as_of)
        .where(F.col("is_success") == "YES")
        .groupBy("reported_client_type")
        .agg(F.count(F.lit(1)).alias("logins"), F.countDistinct("user_name").alias("users"))
    )
    return ordered(out, desc("logins"), asc("reported_client_type"))


def brute_force_candidates(lh: DataFrame, as_of, min_failed: int = 5, days: int = 7) -> DataFrame:
    """Address and user pairs with at least ``min_failed`` failures."""
    out = (
        lookback(lh, "event_timestamp", days, "day", as_of)
        .where(F.col("is_success") == "NO")
        .groupBy("client_ip", "user_name")
        .agg(
            F.count(F.lit(1)).alias("failed_attempts"),
            F.min("event_timestamp").alias("first_attempt"),
            F.max("event_timestamp").alias("last_attempt"),
        )
        .where(F.col("failed_attempts") >= min_failed)
    )
    return ordered(out, desc("failed_attempts"), asc("client_ip"), asc("user_name"))


def failing_addresses(lh: DataFrame, as_of, k: int = 20, days: int = 7) -> DataFrame:
    """Addresses with the most failed logins."""
    by_ip = (
        lookback(lh, "event_timestamp", days, "day", as_of)
        .where(F.col("is_success") == "NO")
        .groupBy("client_ip")
        .agg(
            F.count(F.lit(1)).alias("failed_attempts"),
            F.countDistinct("user_name").alias("users"),
        )
    )
    return top_k(by_ip, k, desc("failed_attempts"), asc("client_ip"))


# ---- users ------------------------------------------------------------------------


def user_posture(us: DataFrame, as_of) -> DataFrame:
    """Live users by means of authentication; disabled users count as inactive too."""
    return active_only(us).agg(
        F.count(F.lit(1)).alias("total_users"),
        F.count_if(is_true("has_password")).alias("with_password"),
        F.count_if(is_true("has_rsa_public_key")).alias("with_keypair"),
        F.count_if(is_true("ext_authn_duo")).alias("with_mfa"),
        F.count_if(is_true("disabled")).alias("disabled_users"),
        F.count_if(inactive_since(as_of, 30)).alias("inactive_30d"),
    )


def users_without_mfa(us: DataFrame) -> DataFrame:
    rows = active_only(us).where(is_false("has_mfa")).select("name", "email", "default_role")
    return ordered(rows, asc("name"))


def stale_user_rows(us: DataFrame, as_of, days: int = 90) -> DataFrame:
    """Live, enabled users without a login for ``days`` days."""
    return active_only(us).where(is_false("disabled") & inactive_since(as_of, days))


def stale_users(us: DataFrame, as_of, days: int = 90, k: int = 30) -> DataFrame:
    today: dt.date = as_datetime(as_of).date()
    rows = stale_user_rows(us, as_of, days).select(
        "name",
        "email",
        "default_role",
        "last_success_login",
        F.datediff(F.lit(today), F.to_date("last_success_login")).alias("days_since_login"),
        "has_password",
        F.col("ext_authn_duo").alias("has_mfa"),
    )
    return top_k(rows, k, asc("last_success_login", nulls="first"), asc("name"))


def _privileged_without_mfa(us: DataFrame, gu: DataFrame, roles: Sequence[str]) -> DataFrame:
    # A user may hold a role through many grants: one row per (user, role) is enough.
    grants = (
        active_only(gu)
        .where(F.col("role").isin(list(roles)))
        .select(F.col("grantee_name").alias("name"), F.col("role").alias("privileged_role"))
        .distinct()
    )
    exposed = active_only(us).where(is_false("disabled") & is_false("ext_authn_duo"))
    return exposed.join(grants, "name")


def privileged_without_mfa(
    us: DataFrame, gu: DataFrame, roles: Sequence[str] = ADMIN_ROLES
) -> DataFrame:
    out = (
        _privileged_without_mfa(us, gu, roles)
        .select(
            F.col("name").alias("user_name"),
            "email",
            "default_role",
            "last_success_login",
            "has_password",
            "privileged_role",
        )
        .distinct()
    )
    return ordered(out, asc("privileged_role"), asc("user_name"))


def privileged_without_mfa_count(
    us: DataFrame, gu: DataFrame, roles: Sequence[str] = ADMIN_ROLES
) -> DataFrame:
    return _privileged_without_mfa(us, gu, roles).agg(F.countDistinct("name").alias("cnt"))


# ---- roles, grants, policies ----------------------------------------------------------


def role_inventory(rl: DataFrame) -> DataFrame:
    rows = active_only(rl).select(F.col("name").alias("role_name"), "created_on", "comment")
    return ordered(rows, desc("created_on"), asc("role_name"))


def role_count(rl: DataFrame) -> DataFrame:
    return active_only(rl).agg(F.count(F.lit(1)).alias("roles"))


def admin_grants(gu: DataFrame, roles: Sequence[str] = (TOP_ADMIN,)) -> DataFrame:
    rows = (
        active_only(gu)
        .where(F.col("role").isin(list(roles)))
        .select(
            F.col("grantee_name").alias("user_name"),
            "role",
            F.col("created_on").alias("granted_on"),
            "granted_by",
        )
    )
    return ordered(rows, asc("role"), asc("user_name"))


def admin_grants_check(gu: DataFrame) -> DataFrame:
    """Number of top administrators and whether it is more than recommended."""
    row = active_only(gu).where(F.col("role") == TOP_ADMIN).agg(F.count(F.lit(1)).alias("holders"))
    return row.withColumn("too_many", F.col("holders") > MAX_TOP_ADMINS)


def recent_grants(gr: DataFrame, as_of, k: int = 50) -> DataFrame:
    rows = active_only(lookback(gr, "created_on", 7, "day", as_of)).select(
        "created_on",
        "privilege",
        F.col("granted_on").alias("object_type"),
        F.col("name").alias("object_name"),
        F.col("grantee_name").alias("granted_to"),
        "granted_by",
    )
    return top_k(rows, k, desc("created_on"))


def network_policy_inventory(pol: DataFrame) -> DataFrame:
    """All network policies; deleted ones are listed too."""
    return pol.select("name", "owner", "comment", "allowed_ip_list", "blocked_ip_list")


def share_inventory(shares: DataFrame) -> DataFrame:
    return shares.select(F.col("name").alias("share_name"), "owner", "comment")


def policy_inventory(pol: DataFrame, deleted_col: str = "deleted") -> DataFrame:
    """Live masking or row-access policies, newest first."""
    rows = active_only(pol, deleted_col).select("policy_name", "created", "policy_owner")
    return ordered(rows, desc("created"), asc("policy_name"))


def policy_counts(**policies: DataFrame) -> DataFrame:
    """Rows per policy table as ``policy_kind, policies``; a table without rows counts 0.

    Tables with a ``deleted`` column count their live rows, except network policies.
    """
    counts = []
    for kind, df in policies.items():
        live = active_only(df, "deleted") if "deleted" in df.columns and kind != "network" else df
        counts.append(
            live.agg(F.count(F.lit(1)).alias("policies")).select(F.lit(kind).alias("policy_kind"), "policies")
        )
    return union_all(*counts)
