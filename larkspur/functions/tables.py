"""Table functions for SQL: rows out of one message's bodies or headers, with LATERAL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from larkspur.functions import auth, html, urls


@udtf(returnType="pos int, href string, anchor string")
class ExtractLinks:
    """extract_links(html, text): a message's links, those of its HTML first; the first of equal targets counts."""

    def eval(self, body: str | None, text: str | None) -> Iterator[tuple]:
        seen: set[str] = set()
        both = [*html.links(body or ""), *((u, None) for u in urls.addresses(text or ""))]
        for href, anchor in both:
            target = href.strip()
            if target and target.lower() not in seen:
                seen.add(target.lower())
                yield len(seen) - 1, target, anchor
                if len(seen) == urls.MOST_LINKS:
                    return


@udtf(returnType="method string, result string, domain string")
class ParseAuthResults:
    """parse_auth_results(names, values, from_domain): the results that count of a message's headers, a row for each method that has one."""

    def eval(self, names: list[str] | None, values: list[str] | None, from_domain: str | None) -> Iterator[tuple]:
        headers = [(n or "", v or "") for n, v in zip(names or [], values or [], strict=False)]
        found = auth.extract(headers, (from_domain or "").lower())
        for method in ("spf", "dkim", "dmarc", "arc"):
            if found[method] is not None:
                yield method, found[method], found.get(f"{method}_domain")


def register(spark: SparkSession) -> None:
    """Makes the table functions known to a session's SQL."""
    spark.udtf.register("extract_links", ExtractLinks)
    spark.udtf.register("parse_auth_results", ParseAuthResults)
