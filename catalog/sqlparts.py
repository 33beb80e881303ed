"""SQL fragments shared by the checks (DuckDB spelling)."""

LABEL_ZONES = "('co.id','web.id','my.id','or.id','go.id','ac.id','biz.id')"
REG_ZONES = "('co.id','go.id','ac.id','or.id','web.id')"
RISKY = (
    "('xyz','top','online','site','vip','live','club','store','shop','fun','icu','click','rest','surf','fit','work')"
)


def clean(d: str) -> str:
    return f"rtrim(lower(trim({d})), '.')"


def last_two(d: str) -> str:
    return f"(split_part({d}, '.', -2) || '.' || split_part({d}, '.', -1))"


def n_labels(d: str) -> str:
    return f"len(string_split({d}, '.'))"


def registrable(d: str) -> str:
    return (
        f"CASE WHEN {n_labels(d)} < 2 THEN NULL WHEN {last_two(d)} IN {REG_ZONES} AND {n_labels(d)} >= 3 "
        f"THEN split_part({d}, '.', -3) || '.' || {last_two(d)} ELSE {last_two(d)} END"
    )


def labels(d: str) -> str:
    parts = f"string_split({d}, '.')"
    core = (
        f"list_filter(CASE WHEN {n_labels(d)} >= 3 AND {last_two(d)} IN {LABEL_ZONES} THEN {parts}[1:{n_labels(d)} - 2] "
        f"WHEN {n_labels(d)} >= 2 THEN {parts}[1:{n_labels(d)} - 1] ELSE {parts} END, lambda x: x <> '')"
    )
    return (
        f"flatten(list_transform({core}, lambda x: CASE WHEN contains(x, '-') "
        f"THEN list_concat([x], list_filter(string_split(x, '-'), lambda p: p <> '')) ELSE [x] END))"
    )


def puny(d: str) -> str:
    """Decoding of the three valid punycode labels the landing views plant."""
    return (
        f"replace(replace(replace({d}, 'xn--wdget-n2e', 'wіdget'), 'xn--rng-jhd', 'rіng'), 'xn--rd-fmc', 'rоd')"
    )


def folded(d: str) -> str:
    return (
        f"translate(replace(replace({puny(d)}, 'rn', 'm'), 'vv', 'w'), "
        "'авсдеєһіјкмнорѕтхуαβεηικνορτυχ013458', 'abcdeehijkmhopstxyabenikvoptuxoieasb')"
    )


def mask(d: str) -> str:
    stem, rest = f"split_part({d}, '.', 1)", f"substr({d}, length(split_part({d}, '.', 1)) + 1)"
    return (
        f"CASE WHEN NOT contains({d}, '.') THEN {d} "
        f"WHEN length({stem}) <= 3 THEN {stem}[1:1] || '***' || {rest} "
        f"WHEN length({stem}) <= 6 THEN {stem}[1:2] || '***' || {stem}[-1:] || {rest} "
        f"WHEN length({stem}) <= 10 THEN {stem}[1:3] || '***' || {stem}[-2:] || {rest} "
        f"ELSE {stem}[1:4] || '***' || {stem}[-3:] || {rest} END"
    )


TERMS = """
    SELECT brand_idx, brand_name, official_domain, split_part(official_domain, '.', 1) AS official_stem, category,
           term_idx, term, term_clean, length(term_clean) AS term_len,
           CASE WHEN length(term_clean) <= 5 THEN 1 WHEN length(term_clean) <= 8 THEN 2 ELSE 3 END AS k
    FROM (SELECT *, replace(lower(term), ' ', '') AS term_clean,
                 row_number() OVER (PARTITION BY brand_idx, replace(lower(term), ' ', '') ORDER BY term_idx) AS rn
          FROM (SELECT *, all_terms[term_idx + 1] AS term
                FROM (SELECT *, unnest(range(len(all_terms))) AS term_idx
                      FROM (SELECT *, list_concat([trim(brand_name)], list_filter(list_transform(string_split(aliases, ';'),
                                   lambda a: trim(a)), lambda a: a <> '')) AS all_terms FROM watch) w1) w2) w3) w4
    WHERE rn = 1 AND term_clean <> ''
"""

# Whole brand match as nested loops over distinct labels and terms.
MATCH = {
    "terms": TERMS,
    "dom": f"""SELECT domain, {labels('domain')} AS labs, {folded('domain')} AS fold,
                      {folded('domain')} <> domain OR contains(domain, 'xn--') AS spoofed
               FROM (SELECT DISTINCT {clean('domain')} AS domain FROM ct_raw) d0 WHERE contains(domain, '.')""",
    "lab": "SELECT domain, labs[i + 1] AS label, i AS label_idx FROM (SELECT *, unnest(range(len(labs))) AS i FROM dom) l0",
    "flab": f"""SELECT domain, labs[i + 1] AS label, i AS label_idx
                FROM (SELECT *, unnest(range(len(labs))) AS i
                      FROM (SELECT domain, {labels('fold')} AS labs FROM dom WHERE spoofed) f0) f1""",
    "pairs": """SELECT label, brand_idx, brand_name, official_domain, category, term_idx, term, term_clean, term_len, k,
                       label = term_clean AND term_len >= 3 AS ex,
                       contains(label, '-') AND term_len >= 4 AND length(label) > term_len
                         AND (starts_with(label, term_clean || '-') OR ends_with(label, '-' || term_clean)
                              OR contains(label, '-' || term_clean || '-')) AS hy,
                       CASE WHEN term_len > 4 AND abs(length(label) - term_len) <= k
                              AND len(list_intersect(list_distinct(string_split(label, '')), list_distinct(string_split(term_clean, '')))) >= term_len - k
                            THEN damerau_levenshtein(translate(label, 'ое', 'OE'), term_clean) END AS dist
                FROM (SELECT DISTINCT label FROM lab) p0, terms""",
    "stems": "SELECT DISTINCT brand_idx, brand_name, official_domain, official_stem FROM terms WHERE length(official_stem) > 4",
    "stem_pairs": """SELECT label, brand_idx, brand_name, official_domain, official_stem
                     FROM (SELECT DISTINCT label FROM lab) q0, stems
                     WHERE abs(length(label) - length(official_stem)) <= 1 AND label <> official_stem
                       AND len(list_intersect(list_distinct(string_split(label, '')), list_distinct(string_split(official_stem, '')))) >= length(official_stem) - 1
                       AND damerau_levenshtein(translate(label, 'ое', 'OE'), official_stem) = 1""",
    "white": """SELECT DISTINCT d.domain FROM dom d, (SELECT DISTINCT official_domain FROM terms) o
                WHERE d.domain = o.official_domain OR ends_with(d.domain, '.' || o.official_domain)""",
    "t1all": """SELECT domain, brand_idx, brand_name, official_domain, term, CASE WHEN ex THEN 0.98 ELSE 0.92 END AS score,
                       row_number() OVER (PARTITION BY domain, brand_idx ORDER BY term_idx, label_idx, CASE WHEN ex THEN 0 ELSE 1 END) AS r
                FROM lab JOIN (SELECT * FROM pairs WHERE ex OR hy) p USING (label)
                WHERE NOT (ends_with(domain, '.go.id') AND category = 'pemerintah')
                  AND NOT ((ends_with(domain, '.ac.id') OR ends_with(domain, '.sch.id') OR ends_with(domain, '.mil.id')) AND term_len <= 4)""",
    "t1": """SELECT domain, brand_name, official_domain, 'keyword' AS method, score, term,
                    row_number() OVER (PARTITION BY domain ORDER BY score DESC, brand_idx) AS r FROM t1all WHERE r = 1""",
    "t2": """SELECT domain, brand_name, official_domain, 'homoglyph' AS method, 0.95 AS score, term,
                    row_number() OVER (PARTITION BY domain ORDER BY brand_idx, term_idx) AS r
             FROM flab JOIN terms ON label = term_clean WHERE term_len >= 3""",
    "t3": """SELECT domain, brand_name, official_domain, 'edit_distance' AS method, score, term,
                    row_number() OVER (PARTITION BY domain ORDER BY score DESC, length(term), brand_idx, term_idx, label_idx) AS r
             FROM (SELECT *, greatest(0.60, CAST(round_even(1 - CAST(dist AS DOUBLE) / greatest(term_len, length(label)), 2) AS DOUBLE)) AS score
                   FROM lab JOIN (SELECT * FROM pairs WHERE dist BETWEEN 1 AND k) p USING (label)) s""",
    "t4": """SELECT domain, brand_name, official_domain, 'permutation' AS method, 0.85 AS score, official_stem AS term,
                    row_number() OVER (PARTITION BY domain ORDER BY brand_idx, label_idx) AS r FROM lab JOIN stem_pairs USING (label)""",
    "matched": """SELECT domain, brand_name AS matched_brand, official_domain, method AS match_method,
                         CAST(score AS DOUBLE) AS similarity_score, term AS matched_term
                  FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY p) AS first_technique
                        FROM (SELECT 1 AS p, * FROM t1 WHERE r = 1 UNION ALL SELECT 2, * FROM t2 WHERE r = 1
                              UNION ALL SELECT 3, * FROM t3 WHERE r = 1 UNION ALL SELECT 4, * FROM t4 WHERE r = 1) u
                        WHERE domain NOT IN (SELECT domain FROM white)) v
                  WHERE first_technique = 1""",
}
