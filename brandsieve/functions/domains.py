"""Host-name column expressions. Everything here stays in built-in Spark functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Second-level zones whose registrable unit has three labels.
REGISTRABLE_SECOND_LEVELS = ["co.id", "go.id", "ac.id", "or.id", "web.id"]
# Second-level zones dropped as a whole when a host is cut into labels.
LABEL_SECOND_LEVELS = ["co.id", "web.id", "my.id", "or.id", "go.id", "ac.id", "biz.id"]
# Second levels kept with any last label in the TLD report.
REPORT_SECOND_LEVELS = ["co", "web", "my", "biz", "ac", "sch", "go", "mil", "or"]
INSTITUTION_SUFFIXES = [".go.id", ".ac.id", ".sch.id", ".or.id", ".desa.id"]
RISKY_TLDS = [
    "xyz", "top", "online", "site", "vip", "live", "club", "store",
    "shop", "fun", "icu", "click", "rest", "surf", "fit", "work",
]
# ----------------------------------------------------------------------------

# Unicode blanks; Spark's plain trim() only knows the space character.
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def normalize_domain(raw: Column) -> Column:
    """Certificate name to host: one leading ``*.`` and one trailing dot go."""
    host = F.lower(strip(raw))
    host = F.when(host.startswith("*."), host.substr(F.lit(3), F.length(host))).otherwise(host)
    return F.when(host.endswith("."), host.substr(F.lit(1), F.length(host) - 1)).otherwise(host)


def clean_domain(raw: Column) -> Column:
    """Host as used for matching: every trailing dot goes."""
    return F.rtrim(F.lower(strip(raw)), F.lit("."))


def label_count(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def last_label(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def registrable_domain(host: Column) -> Column:
    h = clean_domain(host)
    return _registrable(h, label_count(h), F.substring_index(h, ".", -2))


def _registrable(h: Column, n: Column, pair: Column) -> Column:
    return F.when(
        n >= 2,
        F.when(pair.isin(REGISTRABLE_SECOND_LEVELS) & (n >= 3), F.substring_index(h, ".", -3)).otherwise(pair),
    )


def core_labels(h: Column) -> Column:
    """Labels left of the public zone of a host that is clean already; empty ones are there too."""
    n = label_count(h)
    drop = (
        F.when((n >= 3) & F.substring_index(h, ".", -2).isin(LABEL_SECOND_LEVELS), F.lit(2))
        .when(n >= 2, F.lit(1))
        .otherwise(F.lit(0))
    )
    return F.slice(F.split(h, "\\."), F.lit(1), n - drop)


def labels_of(h: Column) -> Column:
    """``domain_labels`` of a host that is clean already."""
    core = F.array_remove(core_labels(h), "")
    with_parts = F.flatten(
        F.transform(
            core,
            lambda x: F.when(x.contains("-"), F.concat(F.array(x), F.array_remove(F.split(x, "-"), ""))).otherwise(
                F.array(x)
            ),
        )
    )
    return F.when(h.contains("-"), with_parts).otherwise(core)


def domain_labels(host: Column) -> Column:
    """Labels left of the public zone, each followed by its hyphen parts."""
    return labels_of(clean_domain(host))


def suffixes(host: Column) -> Column:
    """The host and every parent of it."""
    return F.transform(
        F.sequence(F.lit(1), label_count(host)), lambda i: F.call_function("substring_index", host, F.lit("."), -i)
    )


def is_risky_tld(host: Column) -> Column:
    return last_label(host).isin(RISKY_TLDS)


def institution_suffix(host: Column) -> Column:
    h = clean_domain(host)
    return F.coalesce(*[F.when(h.endswith(s), F.lit(s[1:])) for s in INSTITUTION_SUFFIXES])


def mask_domain(domain: Column) -> Column:
    """Hide the middle of the first label; hosts without a dot pass through."""
    stem = F.substring_index(domain, ".", 1)
    rest = domain.substr(F.length(stem) + 1, F.length(domain))
    n = F.length(stem)

    def keep(head: int, tail: int) -> Column:
        end = F.right(stem, F.lit(tail)) if tail else F.lit("")
        return F.concat(stem.substr(1, head), F.lit("***"), end, rest)

    return (
        F.when(~domain.contains("."), domain)
        .when(n <= 3, keep(1, 0))
        .when(n <= 6, keep(2, 1))
        .when(n <= 10, keep(3, 2))
        .otherwise(keep(4, 3))
    )


def report_tld(domain: Column) -> Column:
    """TLD as shown in the TLD report, with the dot; special second levels keep two labels."""
    d = strip(F.lower(domain))
    n = label_count(d)
    second = F.substring_index(F.substring_index(d, ".", -2), ".", 1)
    return (
        F.when((n >= 2) & second.isin(REPORT_SECOND_LEVELS), F.concat(F.lit("."), F.substring_index(d, ".", -2)))
        .when(n >= 2, F.concat(F.lit("."), last_label(d)))
        .otherwise(F.concat(F.lit("."), d))
    )


def nameserver_signature(nameservers: Column) -> Column:
    """``;``-list of name servers to the sorted set of their registrable parents; null if none."""
    # step by step: a lambda evaluates an expression again wherever it stands, so each gets what the last one found
    hosts = F.transform(F.split(nameservers, ";"), clean_domain)
    named = F.transform(hosts, lambda h: F.struct(h.alias("h"), label_count(h).alias("n"), F.substring_index(h, ".", -2).alias("pair")))
    parents = F.array_compact(F.transform(named, lambda x: _registrable(x["h"], x["n"], x["pair"])))
    sig = F.array_join(F.array_sort(F.array_distinct(parents)), ",")
    return F.when(sig != "", sig)
