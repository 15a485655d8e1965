"""Model answers to assessments: lenient about fences, thinking, truncation and names."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_CHARS, MOST_TRIES, MOST_REASONS, REASON_CHARS = 64_000, 25, 6, 200

# fixed values
SUSPICIOUS_KEYS = ("issuspicious", "suspicious", "isscam", "isphishing", "ismalicious", "scam", "phishing", "malicious")
SCORE_KEYS = ("riskscore", "risk", "score", "riskpercentage", "confidence", "probability")
CATEGORY_KEYS = ("category", "type", "classification", "label", "verdict", "threatcategory")
REASON_KEYS = ("reasons", "reason", "indicators", "explanations", "evidence", "signals")
SUMMARY_KEYS = ("summary", "explanation", "description", "conclusion", "rationale")
DEFAULT_RISK = {"phishing": 80, "scam": 80, "spam": 60, "safe": 5}

_TYPE = T.StructType([
    T.StructField("is_suspicious", T.BooleanType()), T.StructField("category", T.StringType()), T.StructField("risk_score", T.IntegerType()),
    T.StructField("reasons", T.ArrayType(T.StringType())), T.StructField("summary", T.StringType()),
])


def strip_wrapping(text: str) -> str:
    """Without thinking (an open one hides what follows unless an object does) and code fences."""
    text = re.sub(r"(?is)<think(?:ing)?>.*?</think(?:ing)?>", "", text[:MOST_CHARS])
    text = re.sub(r"(?is)^.*</think(?:ing)?>", "", text)
    return re.sub(r"```[A-Za-z]*", "", text)


def candidates(text: str):
    """Objects from each opening brace: balanced, or cut off at the end."""
    starts = [m.start() for m in re.finditer(r"\{", text)][:MOST_TRIES]
    for start in starts:
        depth, quoted, escaped = 0, False, False
        for i in range(start, len(text)):
            c = text[i]
            if escaped:
                escaped = False
            elif c == "\\" and quoted:
                escaped = True
            elif c == '"':
                quoted = not quoted
            elif not quoted and c in "{}":
                depth += 1 if c == "{" else -1
                if not depth:
                    yield text[start : i + 1]
                    break
        else:
            yield repair(text[start:])


def repair(source: str) -> str:
    """Closes what a cut-off object has open, and drops a member without value."""
    stack, quoted, escaped = [], False, False
    for c in source:
        if escaped:
            escaped = False
        elif c == "\\" and quoted:
            escaped = True
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in "{[":
            stack.append("}" if c == "{" else "]")
        elif not quoted and c in "}]" and stack:
            stack.pop()
    source = source + '"' * quoted
    source = re.sub(r'(?:,\s*)?(?:"[^"]*"\s*:?\s*)?$', "", source) if re.search(r'[,{]\s*(?:"[^"]*"\s*:?\s*)?$', source) and not quoted else source
    return re.sub(r"[,:\s]+$", "", source) + "".join(reversed(stack))


def loads(source: str) -> dict | None:
    """JSON, or the same with single quotes, bare keys, trailing commas and Python's constants."""
    for text in (source, _loose(source)):
        try:
            found = json.loads(text, strict=False)
        except (ValueError, RecursionError):
            continue
        return found if isinstance(found, dict) else None
    return None


def _loose(source: str) -> str:
    parts = re.split(r'("(?:[^"\\]|\\.)*")', source)
    for i in range(0, len(parts), 2):
        p = re.sub(r"'((?:[^'\\]|\\.)*)'", lambda m: json.dumps(m[1]), parts[i])
        p = re.sub(r"\bTrue\b|\byes\b", "true", re.sub(r"\bFalse\b|\bno\b", "false", re.sub(r"\bNone\b", "null", p)))
        parts[i] = re.sub(r",\s*([}\]])", r"\1", re.sub(r"([{,]\s*)([A-Za-z_]\w*)\s*:", r'\1"\2":', p))
    return "".join(parts)


def as_bool(v) -> bool | None:
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return v > 0
    word = str(v).strip().lower()
    return True if word in ("true", "yes", "y", "1") else False if word in ("false", "no", "n", "0") else None


def as_score(v) -> int | None:
    """0 to 100; a fraction between 0 and 1 is a share, and so is exactly 1.0 with a point."""
    if isinstance(v, bool) or v is None:
        return None
    if isinstance(v, str):
        if not (m := re.search(r"-?\d+(?:\.\d+)?", v)):
            return None
        v = float(m[0]) if "." in m[0] else int(m[0])
    share = isinstance(v, float) and 0 < v <= 1
    return max(0, min(100, round(v * 100 if share else v)))


def as_category(v) -> str | None:
    word = re.sub(r"[^a-z ]", " ", str(v).lower())
    for name in ("phishing", "scam", "spam"):
        if re.search(rf"\b{name}", word):
            return "safe" if re.search(rf"\b(?:not|no|non|isn t)\s+(?:a\s+|an\s+)?{name}", word) else name
    if re.search(r"\b(?:fraud|malicious)", word):
        return "scam"
    return "safe" if re.search(r"\b(?:safe|legit\w*|benign|ham|clean|none)\b", word) else None


def as_reasons(v) -> list[str]:
    items = v if isinstance(v, list) else re.split(r"\n|;", str(v)) if v else []
    texts = [re.sub(r"^[\s•*\-–\d.)]+", "", i if isinstance(i, str) else json.dumps(i)).strip()[:REASON_CHARS] for i in items]
    return [t for t in texts if t][:MOST_REASONS]


def assess(found: dict) -> dict | None:
    """The assessment of an object; what is missing follows from what is there."""
    by = {}
    for k, v in found.items():
        by.setdefault(re.sub(r"[^a-z]", "", str(k).lower()), v)
    first = lambda keys: next((by[k] for k in keys if by.get(k) is not None), None)
    score, category, flag = as_score(first(SCORE_KEYS)), first(CATEGORY_KEYS), first(SUSPICIOUS_KEYS)
    category = as_category(category) if category is not None else None
    flag = as_bool(flag) if flag is not None else None
    if score is None and category is None and flag is None:
        return None
    if category is None:
        bad = flag if flag is not None else score >= 50
        category = "scam" if bad else "safe"
    if flag is None:
        flag = category != "safe" if score is None else score >= 50
    if score is None:
        score = DEFAULT_RISK[category] if flag == (category != "safe") else 30
    return {"is_suspicious": flag, "category": category, "risk_score": score, "reasons": as_reasons(first(REASON_KEYS)), "summary": str(first(SUMMARY_KEYS) or "")}


def parse_answer(text: str) -> dict | None:
    """The assessment in an answer; null if no object in it is one."""
    for source in candidates(strip_wrapping(text)):
        if (found := loads(source)) and (out := assess(found)):
            return out
    return None


@F.pandas_udf(_TYPE)
def _parse(raw: pd.Series) -> pd.DataFrame:
    empty = dict.fromkeys(_TYPE.names)
    return pd.DataFrame([(parse_answer(r) if r else None) or empty for r in raw], columns=_TYPE.names).astype({"risk_score": "Int32", "is_suspicious": "boolean"})


def assessment(raw: Column) -> Column:
    """is_suspicious, category, risk_score, reasons and summary of raw answers; all null where there is none."""
    return _parse(raw)
