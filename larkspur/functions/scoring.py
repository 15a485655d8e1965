"""Scores, levels and fusion, as column expressions and aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANKS = {"info": 0, "low": 1, "medium": 2, "high": 3}
LEVELS = {"safe": 0, "low": 1, "medium": 2, "high": 3}

# fixed values
PHISHING_PARTS = (
    "credential", "link", "url", "login", "password", "malware", "lookalike", "display_name", "from_equals_recipient",
    "brand_unauthenticated", "dmarc_fail", "dkim_fail", "dkim_unaligned", "spf_fail", "qr_code",
)
SCAM_PARTS = (
    "payment", "gift", "wire", "invoice", "crypto", "bank", "executive_impersonation", "secrecy", "advance_fee",
    "support_callback", "sextortion",
)
AGREEMENT_SCORE, AGREEMENT_BONUS = 0.5, 0.1
CORROBORATED_SCORE, CORROBORATED_FLOOR = 0.6, 0.5
BRAND_CAP = 0.45


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def noisy_or(weights: Column) -> Column:
    """1 - the product of 1 - w over an array of weights."""
    return 1 - F.aggregate(weights, F.lit(1.0), lambda acc, w: acc * (1 - clamp(w)))


def noisy_or_agg(weight: Column) -> Column:
    """The same as an aggregate of rows; 0 without rows."""
    return 1 - F.coalesce(F.product(1 - clamp(weight)), F.lit(1.0))


def level(confidence: Column) -> Column:
    return F.when(confidence >= 0.75, "high").when(confidence >= 0.5, "medium").when(confidence >= 0.3, "low").otherwise("safe")


def rank(name: Column, ranks: dict[str, int] = RANKS) -> Column:
    out = F.lit(None).cast("int")
    for k, v in ranks.items():
        out = F.when(name == k, v).otherwise(out)
    return out


def risk_severity(score: Column) -> Column:
    return F.when(score >= 75, "high").when(score >= 50, "medium").when(score >= 30, "low").otherwise("info")


def is_structural(id_: Column) -> Column:
    return id_.rlike(r"^(?:sender|link|auth|attachment)\.")


def heuristic_score(signals: Column) -> Column:
    """Noisy-or of the weights less the credits; signals: structs with weight and credit."""
    weights = F.transform(F.filter(signals, lambda s: s["weight"] > 0), lambda s: s["weight"])
    credit = F.aggregate(signals, F.lit(0.0), lambda acc, s: acc + F.coalesce(s["credit"], F.lit(0.0)))
    return clamp(noisy_or(weights) - credit)


def _weighted(signals: Column) -> Column:
    return F.filter(signals, lambda s: (s["weight"] > 0) & ~s["id"].startswith("mitigation."))


def fuse(signals: Column, score: Column, model_score: Column, suspicious: Column) -> Column:
    """Confidence from rules and model (0 to 100, null without an answer); the brand cap comes last."""
    structural = F.exists(signals, lambda s: (s["severity"] == "high") & is_structural(s["id"]))
    corroborated = (score >= CORROBORATED_SCORE) & structural & (F.size(_weighted(signals)) >= 2)
    brand = F.exists(signals, lambda s: s["id"] == "mitigation.brand_authenticated") & ~F.exists(
        signals, lambda s: s["severity"].isin("medium", "high") & ~s["id"].startswith("content.")
    )
    m = clamp(model_score / 100.0)
    joint = F.greatest(score, m)
    joint = F.when(suspicious & (m >= AGREEMENT_SCORE) & structural, clamp(joint + AGREEMENT_BONUS)).otherwise(joint)
    joint = F.when(corroborated, F.greatest(joint, F.lit(CORROBORATED_FLOOR))).otherwise(joint)
    out = F.when(model_score.isNull(), score).otherwise(joint)
    return F.when(brand, F.least(out, F.lit(BRAND_CAP))).otherwise(out)


def category(signals: Column, confidence: Column, model_category: Column) -> Column:
    """The model's where it is sure enough, else by the parts of the weighted signals' ids."""
    ids = F.transform(_weighted(signals), lambda s: F.lower(s["id"]))

    def has(parts) -> Column:
        return F.exists(ids, lambda x: x.rlike("|".join(parts)))

    derived = F.when(level(confidence) == "safe", "safe").when(has(PHISHING_PARTS), "phishing").when(has(SCAM_PARTS), "scam").otherwise("phishing")
    return F.when((model_category != "safe") & (confidence >= 0.5), model_category).otherwise(derived)


def reasons(signals: Column, model_reasons: Column, model_score: Column) -> Column:
    """Signals, then the model's reasons, by severity; equal ones keep their order."""
    own = F.transform(signals, lambda s, i: F.struct(-rank(s["severity"]), i.alias("pos"), s["id"].alias("id"), s["title"].alias("title"), s["severity"].alias("severity"), F.lit("heuristic").alias("source")))
    sev = risk_severity(model_score)
    said = F.transform(
        F.filter(F.coalesce(model_reasons, F.array().cast("array<string>")), lambda r: F.trim(r) != ""),
        lambda r, i: F.struct(-rank(sev), (i + 1_000_000).alias("pos"), F.concat(F.lit("model.reason."), i).alias("id"), F.lit("Model finding").alias("title"), sev.alias("severity"), F.lit("model").alias("source")),
    )
    kind = "array<struct<order:int,pos:int,id:string,title:string,severity:string,source:string>>"
    return F.array_sort(F.concat(own.cast(kind), said.cast(kind)))


def alerts(level_: Column, minimum: Column) -> Column:
    return (level_ != "safe") & (rank(level_, LEVELS) >= rank(minimum, LEVELS))


def ensemble(members: Column, heuristic: Column) -> Column:
    """Folds answered members in order: a corroborator replaces the winner only with a higher score and support.

    members: structs (role, identifier, risk_score).  The first primary starts
    as the winner; support is its score of 40 or more, or a heuristic score of
    0.3.  Returns the winning struct, null if none.
    """
    answered = F.filter(members, lambda m: m["risk_score"].isNotNull())
    primary = F.try_element_at(F.filter(answered, lambda m: m["role"] == "primary"), F.lit(1))
    supported = F.coalesce(primary["risk_score"] >= 40, F.lit(False)) | (heuristic >= 0.3)
    higher = lambda best, m: F.coalesce(m["risk_score"] > best["risk_score"], F.lit(True))
    return F.aggregate(answered, primary, lambda best, m: F.when((m["role"] == "corroborator") & higher(best, m) & supported, m).otherwise(best))


def max_severity(signals: Column) -> Column:
    """The highest severity of the signals; null for none."""
    return F.array_max(F.transform(signals, lambda s: F.struct(rank(s["severity"]).alias("rank"), s["severity"].alias("severity"))))["severity"]
