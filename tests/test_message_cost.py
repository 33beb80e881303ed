"""Message texts are read once by each pattern, in linear time, with the matches of the plain patterns."""

import random
import time

import pytest
from pyspark.sql import functions as F

from brandsieve.functions import messages as M
from brandsieve.session import build_session
from catalog import quality  # noqa: F401
from catalog.registry import QUERIES

PARTS = [
    "minta", "OTP", "kode sms", "pin", "kata  sandi", ".apk", "install aplikasi", "segera", "dalam 5 menit", "surat\u00a0resmi", "resmi", "hadiah utama", "rp", "dana kaget", "dana",
    "hxxps : //", "h**p:\\\\", "https", "http : //", ":", "//", "/", " / ", ".", " . ", "[.]", "{x}", "(dot)", " dot ", "[/]", "slash", "a", "b-c", "www.", "shop.co.id", "wa.me/", "t.me/x",
    "a.b/c.d / e", "x_y", "\u017fite.com", "\u212aa.id", "\u00e9", "e\u0301", "\u0301", "\u043e", "-", "_", " ", "\n", "1", "Z", "<", "'", "a" * 63, "a" * 64, ":8080", "jangan berikan", "kirim",
    "biaya admin", "password", "selamat anda menang", "voucher", "unduh aplikasi", "rahasia", "notifikasi", "kata sandi",
]


@pytest.fixture(scope="module")
def spark():
    return build_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false")


def test_matches_are_those_of_the_plain_patterns(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice(PARTS) + rng.choice(["", "", " "]) for _ in range(rng.randrange(1, 14))) for _ in range(6000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = F.col("text")
    for pattern, to in M.DEOBFUSCATION:
        plain = F.regexp_replace(plain, "(?iUd)" + pattern, to)
    low = F.lower("text")
    pairs = [(plain, M.deobfuscate(F.col("text")))]
    pairs += [(F.regexp_extract_all(F.col("text"), F.lit(f"(?iU){p}"), F.lit(0)), F.regexp_extract_all(F.col("text"), F.lit(f"(?iU){q}"), F.lit(0))) for p, q in ((M.URL, M._URL),)]
    pairs += [(low.rlike("(?U)" + p), M.says(low, p)) for p in M._BEGINS]
    for old, new in pairs:
        assert df.select("text", old.alias("old"), new.alias("new")).where("NOT old <=> new").take(3) == []
    assert all(df.where(new if i else F.size(new) > 0).count() for i, (_, new) in enumerate(pairs[1:]) if i)


@pytest.mark.parametrize("name", ["a29_top_signals", "a29_misclassified", "a27_confusion_metrics"])
def test_each_pattern_is_in_the_plan_once(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    for pattern in (M.URGENT, M.AUTHORITY_HIGH, M.TRANSFER):
        assert plan.count(pattern) == 1


def test_a_long_run_of_letters_takes_linear_time(spark):
    df = spark.createDataFrame([("a" * 400_000 + " x.y",)], "text string")
    start = time.time()
    assert df.select(F.length(M.deobfuscate(F.col("text")))).first()[0] == 400_004
    assert time.time() - start < 20
