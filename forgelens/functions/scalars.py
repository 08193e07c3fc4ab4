"""Numeric and date helpers as column expressions. Time-dependent ones take ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Gate thresholds.
REVIEW_AT, BLOCK_AT = 0.30, 0.70
BUG_THRESHOLD, SMELL_THRESHOLD = 0.42, 0.34
KAPPA_BANDS = ((0.0, "Poor (<0)"), (0.2, "Slight (0–0.20)"), (0.4, "Fair (0.20–0.40)"), (0.6, "Moderate (0.40–0.60)"), (0.8, "Substantial (0.60–0.80)"))
KAPPA_TOP = "Almost Perfect (0.80–1.0)"


def ratio(a: Column, b: Column, least: float = 1) -> Column:
    """a / max(b, least), in double."""
    return a.cast("double") / F.greatest(b.cast("double"), F.lit(float(least)))


def safe_rate(a: Column, b: Column) -> Column:
    return F.coalesce(a.cast("double") / F.when(b != 0, b), F.lit(0.0))


def risk_tier(score: Column, review: float = REVIEW_AT, block: float = BLOCK_AT) -> Column:
    return F.when(score >= block, "BLOCK").when(score >= review, "REVIEW").otherwise("PASS")


def predicted(p: Column, threshold: float) -> Column:
    return (p >= threshold).cast("int")


def error_class(y: Column, yhat: Column) -> Column:
    return F.when((y == 0) & (yhat == 0), "tn").when((y == 0) & (yhat == 1), "fp").when((y == 1) & (yhat == 0), "fn").otherwise("tp")


def kappa_band(k: Column) -> Column:
    c = F.when(k < KAPPA_BANDS[0][0], KAPPA_BANDS[0][1])
    for upto, name in KAPPA_BANDS[1:]:
        c = c.when(k < upto, name)
    return c.otherwise(KAPPA_TOP)


def age_days(created: Column, as_of: str) -> Column:
    """Days since an ISO date text, at least 1; 365 when it cannot be read."""
    days = F.datediff(F.lit(as_of).cast("date"), F.to_date(F.try_to_timestamp(F.substring(created, 1, 10), F.lit("yyyy-MM-dd"))))
    return F.when(days.isNull(), 365).otherwise(F.greatest(days, F.lit(1)))  # greatest alone passes over nulls


def bug_fix_density(n: Column, kloc: Column, years: Column) -> Column:
    return n.cast("double") / F.greatest(kloc, F.lit(0.1)) / F.greatest(years, F.lit(0.1))


def sensitivity_label(lo: Column, hi: Column) -> Column:
    return F.when(lo.isNull() & hi.isNull(), "filtresiz").otherwise(F.concat(F.coalesce(lo.cast("string"), F.lit("0")), F.lit("-"), F.coalesce(hi.cast("string"), F.lit("max"))))


def size_label(n: Column) -> Column:
    x = n.cast("double")
    c = F.when(x < 1024, F.format_string("%.1f B", x))
    for i, unit in enumerate(("KB", "MB", "GB"), 1):
        c = c.when(x < 1024.0 ** (i + 1), F.format_string(f"%.1f {unit}", x / 1024.0**i))
    return c.otherwise(F.format_string("%.1f TB", x / 1024.0**4))


def number_label(n: Column) -> Column:
    x = n.cast("double")
    return F.when(x >= 1e6, F.format_string("%.1fM", x / 1e6)).when(x >= 1e3, F.format_string("%.1fK", x / 1e3)).otherwise(n.cast("string"))


def short_path(path: Column, longest: int = 55) -> Column:
    """A path of at most ``longest`` characters: its last two parts if they fit, else its end."""
    parts = F.split(path, "/")
    tail = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "/")
    end = lambda t: F.concat(F.lit("..."), F.right(t, F.lit(longest - 3)))
    return F.when(F.length(path) <= longest, path).when(F.size(parts) <= 2, end(path)).when(F.length(tail) + 4 <= longest, F.concat(F.lit(".../"), tail)).otherwise(end(tail))


def truthy(v: Column) -> Column:
    return F.lower(F.trim(F.coalesce(v, F.lit("")))).isin("1", "true", "on", "yes", "evet")


def masked(token: Column) -> Column:
    return F.when(token.isNull() | (token == ""), "").when(F.length(token) <= 8, F.repeat(F.lit("*"), F.length(token))).otherwise(F.concat(F.substring(token, 1, 4), F.lit("..."), F.substring(token, -4, 4)))
