"""Brand matching: hosts against watchlist terms, four techniques in strict precedence.

A host is exploded into tokens. An equi-join on a *blocking key* finds the watchlist words a token may resemble:

===  =======================================  ========================================
key  host side                                watchlist side
===  =======================================  ========================================
n:   length of each label                     every length within the word's edit budget
h:   hyphen-bounded runs inside a label       words of 4 letters or more
f:   each label of the folded host            words of 3 letters or more
===  =======================================  ========================================

Cheap generated-code tests follow (equality, shared letters as bit sets, native Levenshtein at
twice the budget), then the exact distance for the few pairs left. Distinct words are matched,
and only hits are joined to the brands that use the word.

A watchlist of few words is held against the tokens in one pass over the hosts. Words of a larger one go to the tasks in
blocks of bounded size, broadcast one after the other, and each distinct token is matched once, however many hosts have it. Tokens
with a hit, few of all, are then joined back to the hosts that have them; a token that very many hosts share is one row on its side of that join, and adaptive
execution splits the hosts' side. Hits of a host are brought together once, in sets that combine map-side, so a repeated host is no hot
key. Words of five to nine letters tolerate one to three edits, so cutting them into segments would leave pieces
of one or two letters that nearly every label has: the length and the bit sets prune more.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brandsieve.functions.distance import damerau_levenshtein
from brandsieve.functions.domains import clean_domain, core_labels, label_count, strip, suffixes
from brandsieve.functions.homoglyph import fold, is_punycode, unicode_forms
from brandsieve.operators.watchlist import letter_mask, letters, max_edits, watchlist_terms

KEYWORD, HOMOGLYPH, EDIT, PERMUTATION = 1, 2, 3, 4
METHODS = {KEYWORD: "keyword", HOMOGLYPH: "homoglyph", EDIT: "edit_distance", PERMUTATION: "permutation"}

# --- fixed values -----------------------------------------------------------
SCORE_EXACT_LABEL = 0.98
SCORE_HYPHEN_LABEL = 0.92
SCORE_HOMOGLYPH = 0.95
SCORE_PERMUTATION = 0.85
SCORE_EDIT_FLOOR = 0.60
MIN_TERM = 3
MIN_HYPHEN_TERM = 4
MIN_EDIT_TERM = 5
GOVERNMENT_ZONE = ".go.id"
GOVERNMENT_CATEGORY = "pemerintah"
ACADEMIC_ZONES = [".ac.id", ".sch.id", ".mil.id"]
ACADEMIC_MAX_SHORT_TERM = 4
# ----------------------------------------------------------------------------

# Column that travels with a host through the match.
CARRY = "_carry"
# Distinct words broadcast at a time: at most nine keys each, some 50 MB.
BLOCK_WORDS = 50_000
# Distinct words up to which every token of every host is compared, without a dictionary of tokens.
DIRECT_WORDS = 2_000


LABEL, RUN, FOLDED = 0, 1, 2


def host_tokens(hosts: DataFrame) -> DataFrame:
    """Explode hosts into (domain, kind, idx, token), with ``_carry`` if the hosts have it.

    A token is a label, a hyphen part of one (kind ``LABEL``) or a proper run of its parts (``RUN``); empty parts
    count in runs, as in ``a--b``. A spoofed host gives the labels and parts of its folded form as well. ``idx`` rises
    from label to label, a label before its parts; a run has that of its label. Labels and runs come out of
    generators of plain expressions, so that nothing is evaluated by lambdas for every host.
    """
    carry = [c for c in hosts.columns if c == CARRY]
    text, label = F.col("form.text"), F.col("label")
    first, last, size = F.col("first"), F.col("last"), F.size("parts")
    whole = (first == 1) & (last == size)
    part = first == last

    def token(kind: int, sub: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), (F.shiftleft(F.col("pos").cast("long"), 32) + sub).alias("idx"))

    kinds = (
        F.when(F.col("form.folded"), F.when(whole, F.array(token(FOLDED, F.lit(0)))).when(part, F.array(token(FOLDED, first))))
        .when(whole, F.array(token(LABEL, F.lit(0))))
        .when(part, F.array(token(LABEL, first), token(RUN, F.lit(0))))
        .otherwise(F.array(token(RUN, F.lit(0))))
    )
    form = lambda host, folded: F.struct(host.alias("text"), F.lit(folded).alias("folded"))
    spoofed = is_punycode(F.col("domain")) | (F.col("folded") != F.col("domain"))
    plain = form(F.col("domain"), False)
    return (
        hosts.select(clean_domain(F.col("domain")).alias("domain"), *carry)
        .where(F.col("domain").contains("."))
        .withColumn("forms", unicode_forms(F.col("domain")))
        .select("domain", *carry, fold(F.col("forms.compat")).alias("folded"))
        .select("domain", *carry, F.explode(F.when(spoofed, F.array(plain, form(F.col("folded"), True))).otherwise(F.array(plain))).alias("form"))
        .select("domain", *carry, "form", F.posexplode(core_labels(text)).alias("pos", "label"))
        .where(F.length(label) >= MIN_TERM)
        .select("domain", *carry, "form", "pos", F.split(label, "-", -1).alias("parts"))
        .select("*", F.explode(F.sequence(F.lit(1), size)).alias("first"))
        .select("*", F.explode(F.sequence(first, size)).alias("last"))
        .select("domain", *carry, F.array_join(F.slice("parts", first, last - first + 1), "-").alias("token"), F.explode(kinds).alias("t"))
        .where(F.length("token") >= MIN_TERM)
        .select("domain", *carry, "t.kind", "t.idx", "token")
    )


def with_keys(tokens: DataFrame) -> DataFrame:
    """``tokens`` with their blocking key and letters."""
    text, kind = F.col("token"), F.col("kind")
    key = (
        F.when(kind == LABEL, F.concat(F.lit("n:"), F.length(text).cast("string")))
        .when(kind == RUN, F.concat(F.lit("h:"), text))
        .otherwise(F.concat(F.lit("f:"), text))
    )
    return tokens.withColumn("key", key).withColumn("mask", F.when(kind == LABEL, letter_mask(text)))


def term_roles(terms: DataFrame) -> DataFrame:
    """What a hit on a word means: one row per (word, brand term) and per (word, official stem)."""
    n = F.col("term_len")
    stem = F.col("official_stem")
    as_term = terms.where(n >= MIN_TERM).select(
        F.col("term_clean").alias("word"), "brand_idx", "category", "term_idx", F.length("term").alias("raw_len"),
        F.when(n >= MIN_EDIT_TERM, max_edits(n)).otherwise(0).alias("budget"), F.lit(False).alias("is_stem"),
    )
    as_stem = (
        terms.where(F.length(stem) >= MIN_EDIT_TERM)
        .select(
            stem.alias("word"), "brand_idx", "category", F.lit(0).alias("term_idx"), F.lit(0).alias("raw_len"),
            F.lit(1).alias("budget"), F.lit(True).alias("is_stem"),
        )
        .distinct()
    )
    return as_term.unionByName(as_stem)


def match_words(roles: DataFrame) -> DataFrame:
    """Distinct words with their largest edit budget and letters; ``only_stem`` words are no terms."""
    return (
        roles.groupBy("word")
        .agg(F.max("budget").alias("edits"), F.min("is_stem").alias("only_stem"))
        .withColumn("word_mask", letter_mask(F.col("word")))
    )


def word_blocks(words: DataFrame, count: int, size: int) -> list[DataFrame]:
    """``words``, ``count`` of them, in parts of about ``size`` rows, by a hash; one part for a watchlist that fits."""
    parts = -(-count // size)
    return [words.where(F.pmod(F.xxhash64("word"), F.lit(parts)) == k) for k in range(parts)] or [words]


# Sign bit of a letter mask: the word has letters outside the bit alphabet.
_REST = (1 << 63) - 1


def _shared_bits(mask: Column, word_mask: Column) -> Column:
    return F.bit_count(mask.bitwiseAND(word_mask).bitwiseAND(F.lit(_REST)))


def _shared_letters(token: Column, mask: Column, word: Column, word_mask: Column) -> Column:
    """Distinct letters in common; the letters are only compared if both words leave the bit alphabet."""
    return F.when(
        mask.bitwiseAND(word_mask) < 0, F.size(F.array_intersect(letters(token), letters(word)))
    ).otherwise(_shared_bits(mask, word_mask))


def word_keys(words: DataFrame) -> DataFrame:
    """``words`` under their blocking keys."""
    word, edits = F.col("word"), F.col("edits")
    n = F.length(word)
    near = F.transform(F.sequence(n - edits, n + edits), lambda x: F.concat(F.lit("n:"), x.cast("string")))
    exact = F.when(
        ~F.col("only_stem"),
        F.array_compact(
            F.array(F.concat(F.lit("f:"), word), F.when(n >= MIN_HYPHEN_TERM, F.concat(F.lit("h:"), word)))
        ),
    ).otherwise(F.array().cast("array<string>"))
    return words.select("word", "edits", "word_mask", F.explode(F.concat(near, exact)).alias("key"))


def maybe_near(tokens: DataFrame, keyed: DataFrame) -> DataFrame:
    """``tokens`` whose letters leave some word of their key (``word_keys``) possible.

    One look at all letters of the key's words together, instead of one at each word, settles most tokens.
    """
    # the word itself is near, however few distinct letters it has
    own = F.bit_count(F.col("word_mask").bitwiseAND(F.lit(_REST)))
    needed = F.least(F.length("word") - F.col("edits"), own)
    by_key = keyed.groupBy("key").agg(F.bit_or("word_mask").alias("any_mask"), F.min(needed).alias("least"))
    mask, any_mask = F.col("mask"), F.col("any_mask")
    possible = mask.isNull() | (_shared_bits(mask, any_mask) >= F.col("least")) | (mask.bitwiseAND(any_mask) < 0)
    return tokens.join(F.broadcast(by_key), "key").where(possible).drop("any_mask", "least")


def block_hits(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """``tokens`` (see ``with_keys``) with the words within whose edit budget they are, the distance and shared letters.

    ``words`` is one block of ``match_words``, whose keys are broadcast.
    """
    columns = [c for c in tokens.columns if c not in ("key", "mask")]
    keyed = word_keys(words)
    pairs = maybe_near(tokens, keyed).join(F.broadcast(keyed), "key")
    token, word, edits = F.col("token"), F.col("word"), F.col("edits")
    mask, word_mask = F.col("mask"), F.col("word_mask")
    needed = F.length(word) - edits
    shared = _shared_letters(token, mask, word, word_mask)
    # One expression without lambdas, cheapest test first: it becomes the generated-code
    # condition of the join, so no pair leaves the join that could still be ruled out natively.
    near = (
        ((_shared_bits(mask, word_mask) >= needed) | (mask.bitwiseAND(word_mask) < 0))
        & (F.call_function("levenshtein", token, word, 2 * edits) >= 0)
        & (shared >= needed)
    )
    exact = (F.col("kind") != LABEL) | (token == word)
    pairs = pairs.where(exact | near).withColumn("shared", F.when(~exact, shared))
    # A swap of two letters is two single edits, so below two of them both distances agree.
    edited = F.call_function("levenshtein", token, word)
    rest = ~exact & (edited > 1)
    # non-deterministic only in name: keeps the filter on it from evaluating the UDF twice
    distance = F.coalesce(damerau_levenshtein.asNondeterministic()(F.when(rest, token), F.when(rest, word)), F.when(~exact, edited))
    return (
        pairs.withColumn("distance", F.coalesce(distance, F.lit(0)))
        .where(F.col("distance") <= edits)
        .select(*columns, "word", "distance", "shared")
    )


def word_hits(hosts: DataFrame, roles: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Tokens of hosts with the words that ``block_hits`` finds for them, over all blocks of the watchlist's words.

    Up to ``DIRECT_WORDS`` words, a token is compared where it stands: that costs less than to make the tokens of
    all hosts twice, once for the dictionary and once for the join back to it.
    """
    tokens = host_tokens(hosts)
    words = match_words(roles)
    count = words.count()
    if count <= min(DIRECT_WORDS, block_words):
        return block_hits(with_keys(tokens), words)
    known = with_keys(tokens.select("kind", "token").distinct())
    hits = reduce(DataFrame.unionByName, [block_hits(known, b) for b in word_blocks(words, count, block_words)])
    return tokens.join(hits, ["kind", "token"])


def match_candidates(hosts: DataFrame, watch: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """All (host, watchlist term, technique) hits."""
    roles = term_roles(watchlist_terms(watch))
    return _techniques(word_hits(hosts, roles, block_words), roles)


def by_host(hits: DataFrame) -> DataFrame:
    """``hits`` of ``word_hits`` brought together by host, so that what follows needs no further shuffle.

    A host travels with its words, once, and not with every brand that uses one of them; of a token only its length does
    (``token_len``). Sets combine map-side, so a repeated host is one row there.
    """
    carry = [c for c in hits.columns if c == CARRY]
    hits = hits.withColumn("token_len", F.length("token")).drop("token")
    each = [c for c in hits.columns if c not in ("domain", CARRY)]
    gathered = hits.groupBy("domain").agg(F.collect_set(F.struct(*each)).alias("hits"), *[F.min(c).alias(c) for c in carry])
    return gathered.select("domain", *carry, F.explode("hits").alias("h")).select("domain", *carry, "h.*")


def _techniques(hits: DataFrame, roles: DataFrame) -> DataFrame:
    """``match_candidates`` from the hits of ``word_hits`` or ``by_host``; the latter have no token."""
    hits = hits.join(roles, "word")
    token_len = F.col("token_len") if "token_len" in hits.columns else F.length("token")
    domain, distance = F.col("domain"), F.col("distance")
    kind, n = F.col("kind"), F.length("word")
    priority = (
        F.when(F.col("is_stem"), F.when((kind == LABEL) & (distance == 1) & (F.col("shared") >= n - 1), PERMUTATION))
        .when(kind == FOLDED, HOMOGLYPH)
        .when(distance == 0, KEYWORD)
        .when(distance <= F.col("budget"), F.when(F.col("shared") >= n - F.col("budget"), EDIT))
    )
    guarded = (domain.endswith(GOVERNMENT_ZONE) & (F.col("category") == GOVERNMENT_CATEGORY)) | (
        F.greatest(*[domain.endswith(z) for z in ACADEMIC_ZONES]) & (n <= ACADEMIC_MAX_SHORT_TERM)
    )
    edit_score = F.bround(
        F.greatest(F.lit(SCORE_EDIT_FLOOR), 1.0 - distance / F.greatest(n, token_len)), 2
    )
    score = (
        F.when(F.col("priority") == KEYWORD, F.when(kind == RUN, SCORE_HYPHEN_LABEL).otherwise(SCORE_EXACT_LABEL))
        .when(F.col("priority") == HOMOGLYPH, SCORE_HOMOGLYPH)
        .when(F.col("priority") == EDIT, edit_score)
        .otherwise(SCORE_PERMUTATION)
    )
    return (
        hits.withColumn("priority", priority)
        .where(F.col("priority").isNotNull() & ~((F.col("priority") == KEYWORD) & guarded))
        .select(
            "domain", "priority", "brand_idx", "term_idx", "raw_len", F.col("idx").alias("label_idx"),
            (kind == RUN).alias("hyphen"), "distance", score.alias("similarity_score"),
            *[c for c in hits.columns if c in ("token", CARRY)],
        )
    )


def _official(watch: DataFrame) -> tuple[DataFrame, list[int]]:
    """The official domains (parent), and the few label counts they have.

    Only parents with as many labels as some official domain are looked up, so a top-level domain
    that a large share of the hosts has in common is no join key.
    """
    official = watch.select(F.lower(strip(F.col("official_domain"))).alias("parent")).where("parent <> ''").distinct()
    return official, sorted(r[0] for r in official.select(label_count(F.col("parent"))).distinct().collect())


def is_official(hosts: DataFrame, watch: DataFrame) -> DataFrame:
    """Distinct hosts that are, or sit below, an official domain: an equi-join on the parents."""
    official, counts = _official(watch)
    parents = F.filter(suffixes(F.col("domain")), lambda p: label_count(p).isin(counts))
    return (
        hosts.select(clean_domain(F.col("domain")).alias("domain"))
        .distinct()
        .select("domain", F.explode(parents).alias("parent"))
        .join(official, "parent", "left_semi")
        .select("domain")
        .distinct()
    )


def without_official(rows: DataFrame, watch: DataFrame) -> DataFrame:
    """``rows`` without hosts that ``is_official`` finds: an anti join for each count of labels."""
    official, counts = _official(watch)
    for n in counts:  # a host of fewer labels looks itself up, in vain
        own = official.where(label_count(F.col("parent")) == n).select(F.col("parent").alias("_parent"))
        rows = rows.join(own, F.substring_index("domain", ".", -n) == F.col("_parent"), "left_anti")
    return rows


def best_match(candidates: DataFrame, watch: DataFrame) -> DataFrame:
    """The one winning hit per host: lowest technique, then that technique's tie keys.

    Within a brand the first (term, label) hit counts, an exact label before a hyphen run;
    edit-distance hits rank by score and raw term length first. Across brands: score, for
    edit distance the raw term length, then watchlist order.
    """
    edit = F.col("priority") == EDIT
    carry = [F.min(c).alias(c) for c in candidates.columns if c == CARRY]
    carried = [c for c in candidates.columns if c == CARRY]
    per_brand = candidates.groupBy("domain", "priority", "brand_idx").agg(
        F.min(
            F.struct(
                F.when(edit, -F.col("similarity_score")).otherwise(0.0).alias("by_score"),
                F.when(edit, F.col("raw_len")).otherwise(0).alias("by_length"),
                "term_idx", "label_idx", "hyphen", "similarity_score",
            )
        ).alias("m"),
        *carry,
    )
    best = per_brand.groupBy("domain").agg(
        F.min(
            F.struct(
                "priority", (-F.col("m.similarity_score")).alias("by_score"), "m.by_length", "brand_idx", "m.term_idx"
            )
        ).alias("b"),
        *carry,
    )
    terms = watchlist_terms(watch).select("brand_idx", "term_idx", "brand_name", "official_domain", "official_stem", "term")
    method = F.create_map(*[F.lit(x) for kv in METHODS.items() for x in kv])
    return (
        best.select("domain", "b.priority", "b.brand_idx", "b.term_idx", (-F.col("b.by_score")).alias("similarity_score"), *carried)
        .join(terms, ["brand_idx", "term_idx"])
        .select(
            "domain",
            F.col("brand_name").alias("matched_brand"),
            "official_domain",
            method[F.col("priority")].alias("match_method"),
            "similarity_score",
            F.when(F.col("priority") == PERMUTATION, F.col("official_stem")).otherwise(F.col("term")).alias("matched_term"),
            *carried,
        )
    )


def find_similar(hosts: DataFrame, watch: DataFrame, block_words: int = BLOCK_WORDS, carry: list[str] | None = None) -> DataFrame:
    """Best watchlist match per distinct host of ``hosts.domain``; hosts without a match have no row.

    ``carry`` names columns that come along, so that the matches need no join back to the bulk; of
    several spellings of a host the row that is least in them counts. The official-domain test runs on
    the matched rows only, so it touches neither the bulk of the input nor plans the match again.
    """
    if carry:
        hosts = hosts.select("domain", F.struct(*carry).alias(CARRY))
    else:
        hosts = hosts.select("domain")
    roles = term_roles(watchlist_terms(watch))
    candidates = _techniques(by_host(word_hits(hosts, roles, block_words)), roles)
    best = without_official(best_match(candidates, watch), watch)
    return best.select("*", *[F.col(CARRY)[c].alias(c) for c in carry]).drop(CARRY) if carry else best
