"""Authentication-Results headers: parsing, trust and the result that counts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_CHARS, MOST_HEADERS = 8192, 20
RESULTS = frozenset({"pass", "fail", "softfail", "neutral", "none", "temperror", "permerror"})
_TYPE = T.StructType([T.StructField(n, T.StringType()) for n in ("spf", "dkim", "dmarc", "arc", "dkim_domain", "spf_domain")])


def strip_comments(value: str) -> str:
    """Parentheses and what they hold are dropped, nested ones too; quoted strings stay."""
    out, depth, quoted, escaped = [], 0, False, False
    for c in value[:MOST_CHARS]:
        if escaped:
            escaped = False
        elif c == "\\":
            escaped = True
        elif c == '"' and not depth:
            quoted = not quoted
        elif c == "(" and not quoted:
            depth += 1
        elif c == ")" and not quoted and depth:
            depth -= 1
            continue
        if not depth:
            out.append(c)
    return "".join(out)


def parse_header(value: str) -> dict:
    """id of the authenticating server, instance of an ARC header, and entries (method, result, properties)."""
    clauses = [c.strip() for c in re.split(r";(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)", strip_comments(value))]
    out = {"id": "", "instance": None, "entries": []}
    if clauses and (m := re.match(r"i\s*=\s*(\d+)$", clauses[0])):
        out["instance"] = int(m[1])
        clauses.pop(0)
    if clauses and "=" not in clauses[0]:
        out["id"] = clauses.pop(0).split()[0].lower() if clauses[0].split() else ""
    for c in clauses:
        if not (m := re.match(r"([A-Za-z][\w-]*)(?:/\d+)?\s*=\s*([A-Za-z]+)", c)):
            continue
        given: dict[str, str] = {}
        for k, v in re.findall(r"([\w.-]+)\s*=\s*(\"[^\"]*\"|\S+)", c[m.end() :]):
            given.setdefault(k.lower(), v.strip('"').lower())
        result = m[2].lower()
        out["entries"].append((m[1].lower(), result if result in RESULTS else "unknown", given))
    return out


def _domain(given: dict, *names: str) -> str | None:
    for n in names:
        if v := given.get(n):
            return v.rpartition("@")[2] or None
    return None


def _fill(out: dict, entries: list, from_domain: str, arc: bool) -> None:
    spf = [e for e in entries if e[0] == "spf"]
    if spf and out["spf"] is None:
        best = spf[0]
        if best[1] in ("temperror", "permerror"):
            best = next((e for e in spf if e[1] == "pass"), best)
        out["spf"], out["spf_domain"] = best[1], _domain(best[2], "smtp.mailfrom", "smtp.helo")
    dkim = [(e[1], _domain(e[2], "header.d", "header.i")) for e in entries if e[0] == "dkim"]
    if dkim and out["dkim"] is None:
        passed = [d for d in dkim if d[0] == "pass"]
        aligned = [d for d in passed if d[1] and (d[1] == from_domain or from_domain.endswith("." + d[1]) or d[1].endswith("." + from_domain))]
        out["dkim"], out["dkim_domain"] = (aligned or passed or dkim)[0]
    for name in ("dmarc", "arc") if arc else ("dmarc",):
        if out[name] is None and (found := next((e[1] for e in entries if e[0] == name), None)):
            out[name] = found


def extract(headers: list[tuple[str, str]], from_domain: str = "") -> dict:
    """Of headers (name, value) from the top: only those of the topmost server count; ARC results fill gaps, newest first, then Received-SPF."""
    out = dict.fromkeys(("spf", "dkim", "dmarc", "arc", "dkim_domain", "spf_domain"))
    own = [parse_header(v) for n, v in headers if n.lower() == "authentication-results"][:MOST_HEADERS]
    if own:
        trusted = own[:1] if not own[0]["id"] else [h for h in own if h["id"] == own[0]["id"]]
        _fill(out, [e for h in trusted for e in h["entries"]], from_domain, arc=True)
    sealed = sorted((h for h in (parse_header(v) for n, v in headers if n.lower() == "arc-authentication-results") if h["instance"]), key=lambda h: -h["instance"])
    for h in sealed[:MOST_HEADERS]:
        _fill(out, h["entries"], from_domain, arc=False)
    if out["spf"] is None:
        received = next((v for n, v in headers if n.lower() == "received-spf"), "")
        if (word := re.match(r"\s*([A-Za-z]+)", received)) and word[1].lower() in RESULTS:
            out["spf"] = word[1].lower()
    return out


@F.pandas_udf(_TYPE)
def _extract(headers: pd.Series, domain: pd.Series) -> pd.DataFrame:
    rows = [extract([(h["name"] or "", h["value"] or "") for h in hs] if hs is not None else [], d or "") for hs, d in zip(headers, domain, strict=True)]
    return pd.DataFrame(rows, columns=_TYPE.names)


def results(headers: Column, from_domain: Column) -> Column:
    """spf, dkim, dmarc, arc, dkim_domain and spf_domain of a message's headers."""
    return _extract(headers, from_domain)


def summary(auth: Column) -> Column:
    """One line: spf=… dkim=… (d=…) dmarc=… arc=…; what is missing is left out."""
    part = lambda n: F.when(auth[n].isNotNull(), F.concat(F.lit(f"{n}="), auth[n]))
    d = F.when(auth["dkim_domain"].isNotNull(), F.concat(F.lit("(d="), auth["dkim_domain"], F.lit(")")))
    return F.concat_ws(" ", part("spf"), part("dkim"), d, part("dmarc"), part("arc"))
