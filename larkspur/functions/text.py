"""Text probes and shapes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions import urls

# fixed values
PHONE = r"(?<![0-9])(?:\+?\d{1,2}[\s.-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}(?![0-9])"
WALLET = r"(?<![A-Za-z0-9])(?:bc1[a-z0-9]{25,62}|0x[a-fA-F0-9]{40})(?![A-Za-z0-9])"
ONE_TIME_CODE = (
    r"(?i)(?:\b(?:code|passcode|otp|pin)\b[^0-9]{0,40}(?<![0-9])(?:[0-9]{4,8}|[0-9]{3}[ -][0-9]{3})(?![0-9]))"
    r"|(?:(?<![0-9])(?:[0-9]{4,8}|[0-9]{3}[ -][0-9]{3})(?![0-9])[^0-9]{0,40}\b(?:code|passcode|otp|pin)\b)"
)
ADDRESS = r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+"
SCAN_CHARS = 30_000


def normal_space(text: Column) -> Column:
    """Zero-width characters dropped, blanks collapsed, line ends single and bare."""
    t = F.regexp_replace(text, "[​‌‍⁠﻿­]", "")
    t = F.regexp_replace(t, r"[ \t\f\x0B ]+", " ")
    t = F.regexp_replace(t, r" ?(?:\r\n|\r|\n)[\s]*", "\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def first_match(text: Column, pattern: str) -> Column:
    """The first match within the scanned part of the text; null for none."""
    return F.regexp_substr(F.substring(text, 1, SCAN_CHARS), F.lit(pattern))


def count_of(text: Column, kind: str) -> Column:
    """How many characters are of a regular expression's class; runs of all others are passed at once."""
    return F.length(F.regexp_replace(text, f"[^{kind}]+", ""))


def phone_anywhere(text: Column) -> Column:
    """``PHONE`` is somewhere in the text; most texts lack its last seven digits, which are looked for first."""
    return text.rlike(r"\d{3}[\s.-]?\d{4}") & text.rlike(PHONE)


def has_phone(text: Column) -> Column:
    """``PHONE`` is within the scanned part."""
    return phone_anywhere(F.substring(text, 1, SCAN_CHARS))


def has_address(text: Column) -> Column:
    """``ADDRESS`` is somewhere in the text: an at sign with one character of the local part before it, and a label, a dot and the first of another behind."""
    return text.rlike(r"@(?<=[A-Za-z0-9._%+-]@)[A-Za-z0-9-]{1,63}\.[A-Za-z0-9-]")


def shouts(subject: Column) -> Column:
    """At least ten letters, most of them upper case, or two exclamation marks."""
    letters, upper = count_of(subject, r"\p{L}"), count_of(subject, r"\p{Lu}")
    return ((letters >= 10) & (upper / letters >= 0.6)) | subject.rlike("![^!]*!")


def token_estimate(text: Column) -> Column:
    """One token for each 3.5 characters, rounded up."""
    return F.ceil(F.length(text) / 3.5)


# fixed value: Hangul, CJK radicals, symbols, kana, ideographs and full-width forms
_CJK = r"[\x{1100}-\x{11FF}\x{2E80}-\x{2FDF}\x{3000}-\x{318F}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}\x{20000}-\x{2FA1F}]"


def wide_token_estimate(text: Column) -> Column:
    """As ``token_estimate``, with a token for each Chinese, Japanese or Korean character."""
    late = F.regexp_replace(text, r"[\x00-\x{10FF}]+", "")  # all of them are, and most texts have none
    return urls.let(F.regexp_count(late, F.lit(_CJK)), lambda wide: wide + F.ceil((F.length(text) - wide) / 3.5))


def mask_digits(text: Column) -> Column:
    """Each digit of a run of four or more becomes a bullet; blanks and hyphens between digits stay.

    Runs are bounded, so a digit is in one if three more follow or precede it across single separators.
    """
    sep, d = r"[\s-]?", r"\d"
    after = [rf"(?={(sep + d) * k})" for k in range(4)]
    before = [rf"(?<={(d + sep) * k})" if k else "" for k in range(4)]
    return F.when(text.rlike(d), F.regexp_replace(text, "|".join(f"{before[k]}{d}{after[3 - k]}" for k in range(4)), "•")).otherwise(text)


def truncate(text: Column, most: int) -> Column:
    """Trimmed; a longer text is cut and ends in an ellipsis."""
    t = F.trim(text)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("…")))


def normal_line(text: Column) -> Column:
    """A transcript line: plain quotes and hyphens, no control characters, single blanks."""
    t = F.translate(text, "‘’ʼ“”–—", "'''\"\"--")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\p{Cc}", " "), r"[\s ]+", " "))


def sentence_case_target(href: Column) -> Column:
    """Host and path of at most 80 characters for display; a query shows as an ellipsis, http keeps its scheme."""
    plain = F.lower(href).startswith("http://")
    body = F.regexp_extract(href, r"^[A-Za-z][A-Za-z0-9+.-]*://([^?#]*)", 1)
    shown = F.when(body != "", F.concat(F.when(plain, "http://").otherwise(""), body, F.when(href.contains("?"), "?…").otherwise(""))).otherwise(href)
    return truncate(shown, 80)


def account_key(email: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lower(F.trim(email)), F.lit(":" + salt)), 256)


def e164(number: Column) -> Column:
    """A phone number in international form; null unless it has 8 to 15 digits, with ten taken for North American."""
    digits = F.regexp_replace(number, r"[^\d]", "")
    plus = F.trim(number).startswith("+")
    return (
        F.when(plus & F.length(digits).between(8, 15), F.concat(F.lit("+"), digits))
        .when(F.length(digits) == 10, F.concat(F.lit("+1"), digits))
        .when((F.length(digits) == 11) & digits.startswith("1"), F.concat(F.lit("+"), digits))
    )


def redact(number: Column) -> Column:
    """All but the last four digits hidden."""
    return F.when(F.length(number) >= 4, F.concat(F.lit("•••"), F.substring(number, -4, 4))).otherwise("unknown")


def safety_id(number: Column, line_id: Column) -> Column:
    """A stable id of a caller on a line that does not show the number."""
    return F.sha2(F.concat(number, F.lit("|"), F.coalesce(line_id, F.lit(""))), 256)
