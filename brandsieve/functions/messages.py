"""Message text as columns: de-obfuscation, entities, linguistic signals, hashing, redaction.

Patterns run with Unicode classes ((?U)), as messages are free text. They read whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brandsieve.functions.domains import strip

# --- fixed values: patterns -----------------------------------------------------
DEOBFUSCATION = [
    (r"\b(?:hxxps|h\*\*ps|h__ps)\s*:\s*(?://|\\\\)\s*", "https://"),
    (r"\b(?:hxxp|h\*\*p|h__p)\s*:\s*(?://|\\\\)\s*", "http://"),
    (r"\b(https?)\s*:\s*(?://|\\\\)\s*", "$1://"),
    (r"\[\.\]|\(\.\)|\{.\}", "."),
    (r"\[dot\]|\(dot\)|\{dot\}|\bdot\b", "."),
    (r"\[/\]|\(/\}|\{/\}|\bslash\b", "/"),
    (r"([a-zA-Z0-9_-]+)\s*\.\s*([a-zA-Z0-9_/-]+)", "$1.$2"),
    (r"([a-zA-Z0-9_\.-]+)\s*/\s*([a-zA-Z0-9_/-]+)", "$1/$2"),
]
TLDS = (
    r"com|id|co\.id|web\.id|my\.id|or\.id|go\.id|ac\.id|biz\.id|net|org|xyz|top|online|site|club|vip|live|store|shop|"
    r"me|io|info|biz|cc|app|tech|fun|link"
)
URL = (
    r"\b(?:https?://|www\.)[^\s<>\"'()]+"
    r"|\b(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+(?:" + TLDS + r")(?::\d+)?(?:/[^\s<>\"'()]*)?"
    r"|\b(?:wa\.me|t\.me|bit\.ly|tinyurl\.com|s\.id|linktr\.ee)/[^\s<>\"'()]+"
)
PHONE = r"(?:(?:\+?62)|0)8[1-9][0-9\s\-\.]{7,13}[0-9]"
BANKS = (
    r"bca|bri|mandiri|bni|bsi|btn|cimb(?:\s*niaga)?|danamon|permata|mega|ocbc|panin|btpn|jenius|jago|blu|seabank|"
    r"neo(?:\s*commerce)?|bjb|jatim|jateng|dki|aladin|superbank|maybank|uob|hsbc|dana|ovo|gopay|linkaja"
)
ACCOUNT = (
    r"(?:(?:no\.?\s*rek(?:ening)?|rek(?:ening)?|rekening\s*tujuan|va|virtual\s*account)\s*(?:bank\s*)?(?:(" + BANKS + r")\s*)?[:\-\s]*([0-9]{8,18}))"
    r"|(?:(?:bank\s*)?(" + BANKS + r")\s*(?:no\.?\s*rek(?:ening)?|rek(?:ening)?)[:\-\s]*([0-9]{8,18}))"
)
REQUEST = r"\b(minta|kirim|masukkan|isi|input|sebutkan|balas|konfirmasi|ketik)\b"
ADVISORY = r"\b(jangan\s+(berikan|bagikan|beritahu)|rahasia)\b"
SECRETS = {
    "otp": r"\b(otp|one[\s-]?time[\s-]?password|kode\s+(verifikasi|sms|keamanan))\b",
    "pin": r"\b(pin|mpin|pin\s+atm|passcode)\b",
    "password": r"\b(password|kata\s+sandi)\b",
}
APK = r"\.apk\b|\b(install|unduh|pasang)\s+aplikasi\b"
TRANSFER = r"\b(transfer\s+(uang|dana|deposit|uang\s*muka)|biaya\s+(admin|pendaftaran|aktivasi)|titip\s+dana)\b"
URGENT = r"\b(segera|darurat|1x24\s*jam|dalam\s+\d+\s*(menit|jam)|sebelum\s+(jam|pukul)|blokir|denda|menunggak)\b"
VERY_URGENT = r"\b(blokir|darurat|segera|dalam\s+\d+\s*menit)\b"
AUTHORITY_HIGH = r"\b(surat\s+resmi|pemberitahuan\s+resmi|peringatan\s+resmi|customer\s+care\s+resmi|ditjen|kementerian)\b"
AUTHORITY = r"\b(resmi|peringatan|pemberitahuan|notifikasi)\b"
PRIZE_HIGH = r"\b(selamat\s+anda\s+(menang|terpilih)|grand\s+prize|undian\s+berhadiah|dana\s+kaget|saldo\s+gratis)\b"
PRIZE_MONEY = r"\b(rp|juta|gratis|mobil|hadiah\s+utama)\b"
PRIZE = r"\b(bonus|cashback|voucher|hadiah|diskon)\b"
CHAT_LINKS = ["wa.me/", "t.me/", "chat.whatsapp.com/"]
# redaction, in this order; word borders are ASCII here
NATIONAL_ID = r"(?<![A-Za-z0-9_])[1-9]\d{11}(\d{4})(?![A-Za-z0-9_])"
BANK_NUMBER = r"(?<![A-Za-z0-9_])\d{3,4}[- ]?\d{3,4}[- ]?\d{3,4}(?:[- ]?\d{3,4})?(?![A-Za-z0-9_])"
PHONE_NUMBER = r"(?:\+62|62|08)[0-9\- ]{4,9}([0-9\- ]{4})"
PERSON = r"(?i)(?<![A-Za-z0-9_])(under|CS)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)"
REDACTIONS = [
    (NATIONAL_ID, "[NIK_REDACTED_$1]"),
    (BANK_NUMBER, "[ACCOUNT_NUMBER_REDACTED]"),
    (PHONE_NUMBER, "[PHONE_REDACTED_$1]"),
    (PERSON, "$1 [IDENTITY_REDACTED]"),
]
# ----------------------------------------------------------------------------------

#: What a match of the pattern begins with. Looked for first, as borders of Unicode words cost much at every place.
_BEGINS = {
    REQUEST: r"minta|kirim|masukkan|isi|input|sebutkan|balas|konfirmasi|ketik",
    ADVISORY: r"jangan|rahasia",
    SECRETS["otp"]: r"otp|one|kode",
    SECRETS["pin"]: r"pin|mpin|passcode",
    SECRETS["password"]: r"password|kata",
    APK: r"\.apk|install|unduh|pasang",
    TRANSFER: r"transfer|biaya|titip",
    URGENT: r"segera|darurat|1x24|dalam|sebelum|blokir|denda|menunggak",
    VERY_URGENT: r"blokir|darurat|segera|dalam",
    AUTHORITY_HIGH: r"surat|pemberitahuan|peringatan|customer|ditjen|kementerian",
    AUTHORITY: r"resmi|peringatan|pemberitahuan|notifikasi",
    PRIZE_HIGH: r"selamat|grand|undian|dana|saldo",
    PRIZE_MONEY: r"rp|juta|gratis|mobil|hadiah",
    PRIZE: r"bonus|cashback|voucher|hadiah|diskon",
}


def _run(letters: str, sign: str) -> str:
    """``([letters]+)\\s*sign\\s*([a-zA-Z0-9_/-]+)`` in time linear in a run of letters.

    No part can give up what it has, and a run is tried from its start (or from the end of the match before) only: what follows a run
    is the same for all its ends.
    """
    return rf"(?:\G|(?<![{letters}]))([{letters}]++)\s*+{sign}\s*+([a-zA-Z0-9_/-]++)"


#: The same matches as those of DEOBFUSCATION, in its order.
_DEOBFUSCATION = [
    *[("(?=h)" + pattern, to) for pattern, to in DEOBFUSCATION[:3]],
    (r"(?=[\[({])(?:" + DEOBFUSCATION[3][0] + ")", DEOBFUSCATION[3][1]),
    (r"(?=[\[({d])(?:" + DEOBFUSCATION[4][0] + ")", DEOBFUSCATION[4][1]),
    (r"(?=[\[({s])(?:" + DEOBFUSCATION[5][0] + ")", DEOBFUSCATION[5][1]),
    (_run("a-zA-Z0-9_-", r"\."), DEOBFUSCATION[6][1]),
    (_run(r"a-zA-Z0-9_\.-", "/"), DEOBFUSCATION[7][1]),
]
#: The same matches as those of URL: each begins behind no letter with a scheme or a label and its dot.
_URL = r"(?<![a-z0-9_])(?=[a-z0-9-]{1,63}+\.|https?:)(?:" + URL + ")"


def deobfuscate(text: Column) -> Column:
    for pattern, to in _DEOBFUSCATION:
        text = F.regexp_replace(text, "(?iUd)" + pattern, to)
    return text


def normalize_url(raw: Column) -> Column:
    """Canonical url, or null if the host has no dot. User info, fragment and path parameters go."""
    url = F.regexp_replace(strip(raw), r"[.,;:!?)(\]\[}'\"]+$", "")
    low = F.lower(url)
    url = (
        F.when(low.startswith("hxxps://"), F.concat(F.lit("https://"), url.substr(F.lit(9), F.length(url))))
        .when(low.startswith("hxxp://"), F.concat(F.lit("http://"), url.substr(F.lit(8), F.length(url))))
        .when(low.startswith("http://") | low.startswith("https://"), url)
        .otherwise(F.concat(F.lit("https://"), url))
    )
    whole = r"(?is)^(https?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
    part = lambda i: F.regexp_extract(url, whole, i)
    host = F.regexp_replace(F.lower(part(2)), "^[^@]*@", "")
    path = F.regexp_replace(F.regexp_replace(part(3), ";[^/]*$", ""), "/+", "/")
    query = F.when(part(4) != "", F.concat(F.lit("?"), part(4))).otherwise("")
    return F.when(
        host.contains(".") & ~host.rlike(r"[\[\]]"), F.concat(F.lower(part(1)), F.lit("://"), host, path, query)
    )


def urls(text: Column) -> Column:
    """Distinct normalised urls in order of appearance."""
    found = F.regexp_extract_all(deobfuscate(text), F.lit("(?iU)" + _URL), F.lit(0))
    return F.array_distinct(F.array_compact(F.transform(found, normalize_url)))


def evaluated_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a costly ``value`` under ``name``, from a generator of one row.

    Filters on the column then stay above it; on a plain column they would be pushed down with a second
    copy of the expression.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def phone_numbers(text: Column) -> Column:
    def local(raw: Column) -> Column:
        d = F.regexp_replace(raw, "[^0-9+]", "")
        return (
            F.when(d.startswith("+62"), F.concat(F.lit("0"), d.substr(F.lit(4), F.length(d))))
            .when(d.startswith("62") & (F.length(d) > 9), F.concat(F.lit("0"), d.substr(F.lit(3), F.length(d))))
            .otherwise(d)
        )

    found = F.transform(F.regexp_extract_all(text, F.lit("(?U)" + PHONE), F.lit(0)), local)
    return F.array_distinct(F.filter(found, lambda p: F.length(p).between(10, 14)))


def bank_accounts(text: Column) -> Column:
    """Distinct (bank, account_number) structs; an unnamed bank is UNKNOWN."""
    pattern = "(?iU)" + ACCOUNT

    def account(m: Column) -> Column:
        g = lambda i: F.regexp_extract(m, pattern, i)
        bank = F.when(g(1) != "", g(1)).when(g(3) != "", g(3)).otherwise("UNKNOWN")
        return F.struct(
            F.upper(strip(bank)).alias("bank"),
            F.when(g(2) != "", g(2)).otherwise(g(4)).alias("account_number"),
        )

    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), account))


def has_chat_link(text: Column) -> Column:
    return _chat_link(F.lower(text))


def _chat_link(low: Column) -> Column:
    hit = low.contains(CHAT_LINKS[0])
    for link in CHAT_LINKS[1:]:
        hit = hit | low.contains(link)
    return hit


def message_hash(text: Column) -> Column:
    return F.sha2(strip(text), 256)


def says(low: Column, pattern: str) -> Column:
    """Whether a lower-cased text has a match of one of the patterns of wording."""
    begins = _BEGINS[pattern]
    first = "".join(sorted({x.lstrip("\\")[0] for x in begins.split("|")}))
    return low.rlike(f"(?U)(?=[{first}])(?={begins})(?:{pattern})")


def with_linguistic_signals(df: DataFrame, text: str = "text") -> DataFrame:
    """Add dangerous_request, urgency, false_authority, prize_bait, unofficial_chat_channel.

    They come out of a generator of one row, so that each pattern reads a text once whatever reads the signals.
    """

    def signals(low: Column) -> Column:
        has = lambda p: says(low, p)
        secrets = F.array_compact(F.array(*[F.when(has(p), F.lit(name)) for name, p in SECRETS.items()]))
        others = F.array_compact(F.array(F.when(has(APK), F.lit("apk")), F.when(has(TRANSFER), F.lit("transfer"))))
        asks = has(REQUEST) & ~has(ADVISORY)
        return F.struct(
            F.concat(F.when(asks, secrets).otherwise(F.array().cast("array<string>")), others).alias("asked"),
            F.when(has(URGENT), F.when(has(VERY_URGENT), 2).otherwise(1)).otherwise(0).alias("urgency"),
            F.when(has(AUTHORITY_HIGH), 2).when(has(AUTHORITY), 1).otherwise(0).alias("false_authority"),
            F.when(has(PRIZE_HIGH), F.when(has(PRIZE_MONEY), 3).otherwise(2)).when(has(PRIZE), 1).otherwise(0).alias("prize_bait"),
            _chat_link(low).alias("chat"),
        )

    s = F.col("_said")
    return (
        df.select("*", F.explode(F.transform(F.array(F.lower(F.col(text))), signals)).alias("_said"))
        .withColumn("dangerous_request", F.when(F.size(s["asked"]) > 0, s["asked"]).otherwise(F.array(F.lit("none"))))
        .withColumns({c: s[c] for c in ("urgency", "false_authority", "prize_bait")})
        .withColumn(
            "unofficial_chat_channel",
            s["chat"] & ((F.col("false_authority") > 0) | (F.col("urgency") > 0) | F.array_contains("dangerous_request", "transfer")),
        )
        .drop("_said")
    )


def with_redaction(df: DataFrame, text: str = "text") -> DataFrame:
    """Add sanitized and pii_count. The marks are plain brackets, so no step can hit an earlier mark's wording."""
    df = df.withColumn("sanitized", F.col(text)).withColumn("pii_count", F.lit(0))
    for pattern, to in REDACTIONS:
        df = df.withColumn(
            "pii_count", F.col("pii_count") + F.regexp_count("sanitized", F.lit(pattern))
        ).withColumn("sanitized", F.regexp_replace("sanitized", pattern, to))
    return df


def json_object_text(raw: Column) -> Column:
    """The JSON object inside model text: a fenced block, else first to last brace."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    return F.when(fenced != "", fenced).when(braces != "", braces).otherwise(strip(raw))


VERDICT_SCHEMA = "urgency INT, false_authority INT, prize_bait INT, dangerous_request ARRAY<STRING>, reasoning STRING"
REQUEST_KINDS = ["otp", "pin", "apk", "transfer", "password", "none"]  # fixed values


def with_verdict(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Parse model text into ``verdict`` and flag ``verdict_ok``; rows that fail can be set aside."""
    v = F.col("verdict")
    in_range = [v[c].isNotNull() & v[c].between(0, 3) for c in ("urgency", "false_authority", "prize_bait")]
    return df.withColumn("verdict", F.from_json(json_object_text(F.col(raw)), VERDICT_SCHEMA)).withColumn(
        "verdict_ok",
        F.coalesce(
            in_range[0] & in_range[1] & in_range[2] & v["reasoning"].isNotNull() & v["dangerous_request"].isNotNull()
            & F.forall(v["dangerous_request"], lambda x: F.coalesce(x.isin(REQUEST_KINDS), F.lit(False))),
            F.lit(False),
        ),
    )
