"""Counts and probes of whole texts equal the plain patterns, and pass runs at once."""

import time

from pyspark.sql import functions as F

from larkspur.functions import prompts, text

TEXTS = [
    None, "", "!", "a!b", "a!\n!b", "HELLO WORLD AGAIN", "Hello World Again", "ÄÖÜ ÀÈÌ ÉÓÚ Ñß", "𝔄𝔅ℭ 漢字 かな 한글 ｆｕｌｌ 𠀀 €", "a@b.c", "@b.c", "a@.c", "a@b.", "é@b.c", "x y@z-1.q r", "a@" + "b" * 63 + ".c",
    "a@" + "b" * 64 + ".c", "a@b@c.d", "call 555-123-4567 now", "1555-123-45678", "+1 (555) 123 4567", "555 1234", "12345678901", "x" * 29_995 + " 555-123-4567", "a\x00b\tc\nd\x7fe\u0085f​g﻿h\r\n ",
]


def test_counts_and_probes_equal_the_plain_patterns(spark):
    t = F.col("t")
    rows = spark.createDataFrame([(x,) for x in TEXTS], "t string")
    n = lambda c: F.regexp_count(t, F.lit(c))
    letters, upper, wide = n(r"\p{L}"), n(r"\p{Lu}"), n(text._CJK)
    pairs = {
        "letters": (text.count_of(t, "A-Za-z"), n("[A-Za-z]")), "upper": (text.count_of(t, r"\p{Lu}"), upper),
        "phone": (text.has_phone(t), text.first_match(F.coalesce(t, F.lit("")), text.PHONE).isNotNull()), "address": (text.has_address(t), t.rlike(text.ADDRESS)),
        "shouts": (text.shouts(t), ((letters >= 10) & (upper / letters >= 0.6)) | (n("!") >= 2)), "tokens": (text.wide_token_estimate(t), wide + F.ceil((F.length(t) - wide) / 3.5)),
        "body": (prompts.sanitized_body(t), F.regexp_replace(t, r"[\x00-\x09\x0B-\x1F\x7F-\x{9F}\x{200B}\x{FEFF}]", "")),
    }
    known = rows.filter("t is not null")
    for name, (new, plain) in pairs.items():
        assert known.filter(~new.eqNullSafe(plain)).select("t").collect() == [], name


def test_long_texts_are_counted_in_runs(spark):
    rows = spark.range(0, 400, 1, 1).select(F.repeat(F.concat(F.col("id").cast("string"), F.lit(" some words of prose, ")), 2000).alias("t"))
    took = []
    for estimate in (text.wide_token_estimate, lambda t: F.regexp_count(t, F.lit(text._CJK)) + F.ceil((F.length(t) - F.regexp_count(t, F.lit(text._CJK))) / 3.5)):
        rows.limit(5).agg(F.sum(estimate(F.col("t")))).collect()
        began = time.perf_counter()
        rows.agg(F.sum(estimate(F.col("t")))).collect()
        took.append(time.perf_counter() - began)
    assert took[0] < took[1] * 0.7
