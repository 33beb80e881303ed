"""Keyword-category scans of all hosts (gambling and adult vocabulary)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brandsieve.functions.domains import clean_domain, institution_suffix, labels_of
from brandsieve.functions.messages import evaluated_once

# --- fixed values: vocabulary per category and tier ---------------------------------
KEYWORDS = {
    ("judol", "strict"): [
        "slot", "gacor", "maxwin", "togel", "judi", "bandarqq", "sbobet", "scatter", "parlay", "sabung", "poker",
        "casino", "sv388", "pgsoft", "spaceman", "qq288", "domino99", "pragmaticplay", "situsslot", "slotgacor",
        "jpmaxwin",
    ],
    ("judol", "ambiguous"): [
        "rtp", "domino", "toto", "bola", "joker", "mahjong", "pragmatic", "hoki", "cuan", "jackpot", "wla",
    ],
    ("porn", "strict"): [
        "bokep", "porn", "porno", "xxx", "bugil", "hentai", "ngentot", "ngewe", "colmek", "crot", "sange", "bispak",
        "telanjang",
    ],
    ("porn", "ambiguous"): ["kontol", "toket", "memek", "ewe"],
}
HIJACKED_SCORE = {"judol": 95, "porn": 95}
PLAIN_SCORE = {"judol": 85, "porn": 80}
# ------------------------------------------------------------------------------------


def keyword_hits(labels: Column, words: list[str]) -> Column:
    """Sorted distinct keywords that fill a whole label, up to 3 digits around it and one closing ``d``.

    Longer words are tried first, so a word is never hidden by its own prefix.
    """
    pattern = r"^\d{0,3}(" + "|".join(sorted(words, key=len, reverse=True)) + r")\d{0,3}d?$"
    found = F.transform(labels, lambda x: F.regexp_extract(x, pattern, 1))
    return F.array_sort(F.array_distinct(F.array_remove(found, "")))


def _rows(hosts: DataFrame, category: str) -> DataFrame:
    """Hosts that can hit at all, with their labels and strict hits.

    One native pattern over the whole host comes first. It is a necessary condition (a keyword
    label is bounded by dots, hyphens or the ends), so the per-label work is left to few hosts. Labels and
    hits are evaluated once a host, however many filters ask for them.
    """
    words = KEYWORDS[category, "strict"] + KEYWORDS[category, "ambiguous"]
    bounded = r"(^|[.-])\d{0,3}(?:" + "|".join(sorted(words, key=len, reverse=True)) + r")\d{0,3}d?([.-]|$)"
    kept = [c for c in hosts.columns if c != "domain"]
    cleaned = evaluated_once(hosts.withColumnRenamed("domain", "_raw"), "domain", clean_domain(F.col("_raw"))).select("domain", *kept)
    rows = cleaned.where(F.col("domain").contains(".") & F.col("domain").rlike(bounded))
    rows = evaluated_once(rows, "labels", labels_of(F.col("domain")))
    return evaluated_once(rows, "strict", keyword_hits(F.col("labels"), KEYWORDS[category, "strict"]))


def scan(hosts: DataFrame, category: str, verdicts: DataFrame | None = None) -> DataFrame:
    """Findings of one category: strict hits, and ambiguous ones with a confirming verdict.

    ``verdicts(domain, is_match, reasoning)``: no verdict, no finding. Without ``verdicts`` the
    ambiguous tier is off. Only ambiguous hits are joined.
    """
    rows = _rows(hosts.select("domain", "first_seen"), category)
    suffix = institution_suffix(F.col("domain"))

    def finding(df: DataFrame, keywords: Column, method: str, reasoning: Column) -> DataFrame:
        return df.select(
            "domain",
            "first_seen",
            F.lit(category).alias("category"),
            F.array_join(keywords, ",").alias("matched_keywords"),
            suffix.isNotNull().alias("is_hijacked_institution"),
            suffix.alias("institution_suffix"),
            F.lit(method).alias("verification_method"),
            reasoning.alias("llm_reasoning"),
        )

    strict = finding(rows.where(F.size("strict") > 0), F.col("strict"), "keyword", F.lit(None).cast("string"))
    if verdicts is None:
        return strict
    confirmed = ambiguous(rows, category).join(verdicts.where("is_match").select("domain", "reasoning"), "domain")
    return strict.unionByName(finding(confirmed, F.col("hits"), "llm", F.btrim("reasoning")))


def ambiguous(rows: DataFrame, category: str) -> DataFrame:
    """Hosts without a strict hit that carry an ambiguous keyword (column ``hits``)."""
    found = keyword_hits(F.col("labels"), KEYWORDS[category, "ambiguous"])
    return evaluated_once(rows.where(F.size("strict") == 0), "hits", found).where(F.size("hits") > 0)


def rebuild(current: DataFrame, previous: DataFrame, now: Column) -> DataFrame:
    """Full rebuild that keeps ``detected_at`` of hosts known before; stale hosts are gone."""
    known = previous.select("domain", F.col("detected_at").alias("_before"))
    return current.join(known, "domain", "left").select(
        *current.columns, F.coalesce("_before", now).alias("detected_at"), F.col("_before").isNull().alias("newly_inserted")
    )


def scan_summary(hosts: DataFrame, rebuilt: DataFrame, category: str, verdicts: DataFrame) -> DataFrame:
    """One row: scanned, flagged, hijacked, new, ambiguous checked, confirmed."""
    rows = _rows(hosts.select("domain"), category)
    checked = ambiguous(rows, category).agg(F.count("*").alias("llm_candidates_checked"))
    scanned = hosts.agg(F.count("*").alias("domains_scanned"))
    flagged = rebuilt.agg(
        F.count("*").alias("domains_flagged"),
        F.count_if("is_hijacked_institution").alias("hijacked_institutions_flagged"),
        F.count_if("newly_inserted").alias("newly_inserted"),
        F.count_if(F.col("verification_method") == "llm").alias("llm_confirmed"),
    )
    return scanned.crossJoin(flagged).crossJoin(checked)  # three one-row frames


def severity(category: Column, hijacked: Column) -> Column:
    def per(scores: dict[str, int]) -> Column:
        return F.when(category == "judol", scores["judol"]).otherwise(scores["porn"])

    return F.when(hijacked, per(HIJACKED_SCORE)).otherwise(per(PLAIN_SCORE))
