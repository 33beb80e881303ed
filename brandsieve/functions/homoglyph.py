"""Look-alike folding.

ASCII hosts are folded by built-in functions. Punycode decoding and NFKC have no Spark
builtin, so hosts that need them (``xn--`` or any non-ASCII character) go through one Arrow
UDF; for all other rows the UDF argument is null, and a batch without such hosts returns at once.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brandsieve.functions.domains import strip

# --- fixed values: look-alike letters (input is lower case by then) -------------
CYRILLIC = {
    "а": "a", "в": "b", "с": "c", "д": "d", "е": "e", "є": "e",
    "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h",
    "о": "o", "р": "p", "ѕ": "s", "т": "t", "х": "x", "у": "y",
}
GREEK = {
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k",
    "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "8": "b"}
# ----------------------------------------------------------------------------


def _decode_labels(host: str) -> str:
    if "xn--" not in host:
        return host
    try:
        return ".".join(
            p.encode("ascii").decode("idna") if p.startswith("xn--") else p for p in host.split(".")
        )
    except (UnicodeError, ValueError):
        return host


@F.pandas_udf(T.StructType().add("decoded", T.StringType()).add("compat", T.StringType()))
def _unicode_forms(host: pd.Series) -> pd.DataFrame:
    out = pd.DataFrame({"decoded": None, "compat": None}, index=host.index, dtype=object)
    todo = host.dropna()
    if len(todo):
        decoded = todo.map(_decode_labels)
        out.loc[todo.index, "decoded"] = decoded
        out.loc[todo.index, "compat"] = decoded.map(
            lambda s: unicodedata.normalize("NFKC", _decode_labels(s.strip().lower())).lower()
        )
    return out


def is_punycode(host: Column) -> Column:
    return host.contains("xn--")


def unicode_forms(host: Column) -> Column:
    """Struct(decoded, compat): IDNA-decoded host and its lower-cased NFKC form (lower-case input)."""
    special = is_punycode(host) | (F.octet_length(host) > F.length(host))
    forms = _unicode_forms(F.when(special, host))
    return F.struct(
        F.coalesce(forms["decoded"], host).alias("decoded"),
        F.coalesce(forms["compat"], host).alias("compat"),
    )


def fold(compat: Column, include_digits: bool = True) -> Column:
    """Look-alikes to Latin on an NFKC lower-case host."""
    table = {**CYRILLIC, **GREEK, **(DIGITS if include_digits else {})}
    merged = F.replace(F.replace(compat, F.lit("rn"), F.lit("m")), F.lit("vv"), F.lit("w"))
    return F.translate(merged, "".join(table), "".join(table.values()))


def spoof_tags(host: Column, decoded: Column) -> Column:
    """Which look-alike tricks a host shows, in a fixed order."""
    d = F.lower(decoded)
    return F.filter(
        F.array(
            F.when(is_punycode(host), F.lit("punycode_idn_encoding")),
            F.when(decoded.rlike("[" + "".join(CYRILLIC) + "]"), F.lit("cyrillic_script_spoof")),
            F.when(decoded.rlike("[" + "".join(GREEK) + "]"), F.lit("greek_script_spoof")),
            F.when(d.rlike("[a-z][013458][a-z]"), F.lit("digit_substitution_leet")),
            F.when(d.contains("rn") | d.contains("vv"), F.lit("digraph_substitution")),
        ),
        lambda t: t.isNotNull(),
    )


def with_homoglyph_columns(df, domain: str = "domain"):
    """Add decoded_domain, normalized_domain, is_punycode, detected_spoofs, has_homoglyphs."""
    host = F.lower(strip(F.col(domain)))
    return (
        df.withColumn("_host", host)
        .withColumn("_forms", unicode_forms(F.col("_host")))
        .withColumn("decoded_domain", F.col("_forms.decoded"))
        .withColumn("normalized_domain", fold(F.col("_forms.compat")))
        .withColumn("is_punycode", is_punycode(F.col("_host")))
        .withColumn("detected_spoofs", spoof_tags(F.col("_host"), F.col("decoded_domain")))
        .withColumn(
            "has_homoglyphs",
            (F.size("detected_spoofs") > 0)
            | F.col("is_punycode")
            | (F.col("normalized_domain") != F.lower("decoded_domain")),
        )
        .drop("_host", "_forms")
    )
