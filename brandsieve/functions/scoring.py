"""Risk scoring as column expressions over signal columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: signal points and levels ---------------------------------------
WEIGHTS = {
    "domain_age_under_7d": 30,
    "domain_age_under_30d": 20,
    "domain_age_under_90d": 10,
    "watchlist_similarity": 25,
    "risky_tld": 15,
    "multi_hop_redirect": 15,
    "dangerous_request_credential": 35,
    "dangerous_request_apk": 50,
    "dangerous_request_transfer": 30,
    "urgency_high": 20,
    "urgency_medium": 8,
    "false_authority_high": 25,
    "false_authority_medium": 10,
    "prize_bait_high": 25,
    "prize_bait_medium": 10,
    "unofficial_chat_channel": 15,
}
FRAUD, CAUTION, SAFE = "INDIKASI PENIPUAN", "HATI-HATI", "AMAN"
FRAUD_MIN = 70
SAFE_MAX = 39
FLAG_MIN = 40
BLACKLIST_POINTS = 20
# ----------------------------------------------------------------------------------

TECHNICAL = ["domain_age_days", "watchlist_matched", "is_risky_tld", "redirect_hops"]
LINGUISTIC = ["dangerous_request", "urgency", "false_authority", "prize_bait", "unofficial_chat_channel"]

# Plain-language reason per signal; {x} is filled from the row. Age under 90 days has none.
REASONS = {
    "domain_age_under_7d": ("Domain was registered ", "domain_age_days", " days ago, a strong sign of a throw-away fraud site."),
    "domain_age_under_30d": ("Domain is less than one month old (", "domain_age_days", " days)."),
    "watchlist_similarity": ("The address imitates '", "matched_brand", "' but is not that institution's domain."),
    "risky_tld": ("Uses a high-risk domain extension (.", "tld", ")."),
    "multi_hop_redirect": ("The link is hidden behind ", "redirect_hops", " redirect steps."),
    "dangerous_request_credential": ("The message asks for secret data (OTP, PIN or password).",),
    "dangerous_request_apk": ("The message leads to an app file outside the official store.",),
    "dangerous_request_transfer": ("The message demands a transfer or an upfront fee.",),
    "urgency_high": ("Uses time pressure and threats.",),
    "urgency_medium": ("Presses for a quick answer.",),
    "false_authority_high": ("Poses as an official announcement of an institution.",),
    "false_authority_medium": ("Claims to speak for an institution.",),
    "prize_bait_high": ("Promises an implausible prize or free balance.",),
    "prize_bait_medium": ("Mentions an eye-catching prize or promotion.",),
    "unofficial_chat_channel": ("Moves the matter to a private chat contact.",),
}


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _level(column: str, high: int) -> tuple[Column, Column]:
    v = F.coalesce(F.col(column), F.lit(0))
    return v >= high, v == 1


def signals(has: set[str]) -> dict[str, Column]:
    """Signal name to its condition, for the signal columns that the frame has."""
    out: dict[str, Column] = {}
    if "domain_age_days" in has:
        age = F.col("domain_age_days")
        out["domain_age_under_7d"] = age < 7
        out["domain_age_under_30d"] = (age >= 7) & (age < 30)
        out["domain_age_under_90d"] = (age >= 30) & (age < 90)
    if "watchlist_matched" in has:
        out["watchlist_similarity"] = F.col("watchlist_matched")
    if "is_risky_tld" in has:
        out["risky_tld"] = F.col("is_risky_tld")
    if "redirect_hops" in has:
        out["multi_hop_redirect"] = F.col("redirect_hops") > 1
    if "dangerous_request" in has:
        asked = F.col("dangerous_request")
        out["dangerous_request_credential"] = F.arrays_overlap(asked, F.array(*map(F.lit, ["otp", "pin", "password"])))
        out["dangerous_request_apk"] = F.array_contains(asked, "apk")
        out["dangerous_request_transfer"] = F.array_contains(asked, "transfer")
    for name in ("urgency", "false_authority", "prize_bait"):
        if name in has:
            out[f"{name}_high"], out[f"{name}_medium"] = _level(name, 2)
    if "unofficial_chat_channel" in has:
        out["unofficial_chat_channel"] = F.col("unofficial_chat_channel")
    return {k: _flag(v) for k, v in out.items()}


def risk_score(has: set[str]) -> Column:
    points = [F.when(c, WEIGHTS[name]).otherwise(0) for name, c in signals(has).items()]
    return F.least(F.lit(100), F.greatest(F.lit(0), reduce(lambda a, b: a + b, points)))


def risk_level(score: Column) -> Column:
    return F.when(score >= FRAUD_MIN, FRAUD).when(score > SAFE_MAX, CAUTION).otherwise(SAFE)


def breakdown(has: set[str]) -> Column:
    """Array of (category, signal, points); every signal once."""
    technical = {"domain_age_under_7d", "domain_age_under_30d", "domain_age_under_90d", "watchlist_similarity", "risky_tld", "multi_hop_redirect"}
    rows = [
        F.when(
            c,
            F.struct(
                F.lit("technical" if name in technical else "linguistic").alias("category"),
                F.lit(name).alias("signal"),
                F.lit(WEIGHTS[name]).alias("points"),
            ),
        )
        for name, c in signals(has).items()
    ]
    return F.array_compact(F.array(*rows))


def reasons(has: set[str], columns: set[str]) -> Column:
    """Array of reason sentences for the signals that fired."""
    out = []
    for name, c in signals(has).items():
        if name in REASONS:
            parts = [
                F.coalesce(F.col(p).cast("string"), F.lit("")) if p in columns else F.lit(p) for p in REASONS[name]
            ]
            out.append(F.when(c, F.concat(*parts)))
    return F.array_compact(F.array(*out))


def domain_age_days(registration_date: Column, now: Column) -> Column:
    """Whole days since registration, never negative; null without a parsable zoned timestamp."""
    zoned = registration_date.rlike(r"^\d{4}-\d{2}-\d{2}[T ].*(Z|[+-]\d{2}:?\d{2})$")
    at = F.when(zoned, F.try_to_timestamp(registration_date))
    days = F.floor((F.unix_micros(now) - F.unix_micros(at)) / F.lit(86_400_000_000))
    return F.when(days >= 0, days).when(days < 0, 0).cast("int")  # greatest() would turn null into 0


def backlog_score(similarity: Column, risky: Column) -> Column:
    """Score of the deprecated backlog pass."""
    return F.least(F.lit(100), F.floor(similarity * 60).cast("int") + F.when(risky, 15).otherwise(0) + 20)
