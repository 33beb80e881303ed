"""Watchlist, brand match and candidate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from brandsieve.functions.distance import damerau_levenshtein
from brandsieve.operators.brand_match import (
    EDIT, HOMOGLYPH, KEYWORD, PERMUTATION, best_match, find_similar, is_official, match_candidates,
)
from brandsieve.operators.candidates import candidates_with_certificate, generate_candidates
from brandsieve.operators.watchlist import watchlist_terms
from catalog.registry import Inputs, query
from catalog.sqlparts import MATCH, TERMS

ISO = "yyyy-MM-dd HH:mm:ss"


@query(
    "s1_watchlist_terms",
    "SELECT brand_name, official_domain, official_stem, category, CAST(term_idx AS INTEGER) AS term_idx, term, term_clean, CAST(term_len AS INTEGER) AS term_len FROM terms",
    {"terms": TERMS},
)
def s1(i: Inputs):
    return watchlist_terms(i.watch).drop("brand_idx")


@query("j1_brand_match", "SELECT * FROM matched", MATCH)
def j1(i: Inputs):
    return find_similar(i.ct_raw, i.watch)


def _technique(i: Inputs, priority: int):
    hits = match_candidates(i.ct_raw, i.watch).where(F.col("priority") == priority)
    return best_match(hits, i.watch).drop("official_domain", "match_method")


_ONE = "SELECT domain, brand_name AS matched_brand, CAST(score AS DOUBLE) AS similarity_score, term AS matched_term FROM {} WHERE r = 1"


@query("j1a_keyword_hits", _ONE.format("t1"), MATCH)
def j1a(i: Inputs):
    return _technique(i, KEYWORD)


@query("j1b_homoglyph_hits", _ONE.format("t2"), MATCH)
def j1b(i: Inputs):
    return _technique(i, HOMOGLYPH)


@query("j1c_edit_distance_hits", _ONE.format("t3"), MATCH)
def j1c(i: Inputs):
    return _technique(i, EDIT)


@query("j1d_permutation_hits", _ONE.format("t4"), MATCH)
def j1d(i: Inputs):
    return _technique(i, PERMUTATION)


@query("p1_official_whitelist", "SELECT domain FROM white", MATCH)
def p1(i: Inputs):
    """Hosts that are, or sit below, an official domain."""
    return is_official(i.ct_raw, i.watch)


@query(
    "p2_matches_by_zone",
    """SELECT CASE WHEN ends_with(domain, '.go.id') THEN 'go.id' WHEN ends_with(domain, '.ac.id') OR ends_with(domain, '.sch.id')
                   OR ends_with(domain, '.mil.id') THEN 'academic' ELSE 'other' END AS zone, match_method, count(*) AS n
       FROM matched GROUP BY 1, 2""",
    MATCH,
)
def p2(i: Inputs):
    """Effect of the institutional guards: matches per zone and technique."""
    d = F.col("domain")
    zone = (
        F.when(d.endswith(".go.id"), "go.id")
        .when(d.endswith(".ac.id") | d.endswith(".sch.id") | d.endswith(".mil.id"), "academic")
        .otherwise("other")
    )
    return find_similar(i.ct_raw, i.watch).groupBy(zone.alias("zone"), "match_method").agg(F.count("*").alias("n"))


@query(
    "n1_best_match_brands",
    "SELECT matched_brand, match_method, count(*) AS n, max(similarity_score) AS best_score FROM matched GROUP BY 1, 2",
    MATCH,
)
def n1(i: Inputs):
    return (
        find_similar(i.ct_raw, i.watch)
        .groupBy("matched_brand", "match_method")
        .agg(F.count("*").alias("n"), F.max("similarity_score").alias("best_score"))
    )


def _own_pairs(i: Inputs):
    """Each certificate's first label beside the name it was issued for."""
    return i.host_zone.select(F.split_part("zone", F.lit("."), F.lit(1)).alias("label"), "term").distinct()


@query(
    "f8_edit_distance",
    """SELECT DISTINCT split_part(zone, '.', 1) AS label, term,
              CAST(damerau_levenshtein(translate(split_part(zone, '.', 1), 'ое', 'OE'), term) AS INTEGER) AS distance FROM host_zone""",
)
def f8(i: Inputs):
    return _own_pairs(i).select("label", "term", damerau_levenshtein("label", "term").alias("distance"))


@query(
    "u4_shared_letters",
    """SELECT DISTINCT split_part(zone, '.', 1) AS label, term,
              CAST(len(list_intersect(list_distinct(string_split(split_part(zone, '.', 1), '')), list_distinct(string_split(term, '')))) AS INTEGER) AS shared FROM host_zone""",
)
def u4(i: Inputs):
    return _own_pairs(i).select(
        "label", "term", F.size(F.array_intersect(F.split("label", ""), F.split("term", ""))).alias("shared")
    )


_CANDIDATES = {
    "cand": """SELECT DISTINCT stem || m || t AS host
               FROM (SELECT DISTINCT split_part(official_domain, '.', 1) AS stem FROM watch) s,
                    (SELECT unnest(['', '-login', '-verifikasi', '-verify', '-resmi', '-secure', '-update']) AS m) ms,
                    (SELECT unnest(['.xyz', '.top']) AS t) ts WHERE length(stem) >= 4"""
}


@query("j8_typosquat_candidates", "SELECT host FROM cand", _CANDIDATES)
def j8(i: Inputs):
    return generate_candidates(i.watch).select("host")


@query(
    "j7_candidates_with_certificate",
    "SELECT host, strftime(min(not_before), '%Y-%m-%d %H:%M:%S') AS not_before FROM cert JOIN cand USING (host) GROUP BY host",
    _CANDIDATES,
)
def j7(i: Inputs):
    certs = i.cert.select(F.col("host").alias("domain"), "not_before")
    return candidates_with_certificate(generate_candidates(i.watch), certs).withColumn(
        "not_before", F.date_format("not_before", ISO)
    )
