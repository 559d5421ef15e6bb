"""What a company's own tags and labels say about the concepts that apply to it."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quillstone.operators.audits import derivable, enough_evidence, shared_weight


def token_evidence(tags: DataFrame, weights: DataFrame, least: float = 3.0) -> DataFrame:
    """tag, concept: every concept whose words a tag shares by `least` weight or more; several may be.

    tags: tag, token; weights: concept, token, idf.
    """
    return shared_weight(tags, weights, least).select("tag", "concept")


def supported(mapped: DataFrame, scored: DataFrame, revoked: DataFrame, claims: DataFrame) -> DataFrame:
    """tag, concept that count as evidence.

    mapped (tag, concept) always does.  Scored pairs don't if they are revoked, nor where the tag's labels claim concepts
    (claims: tag, concept) and this one isn't among them.
    """
    kept = scored.join(revoked.select("tag", "concept"), ["tag", "concept"], "left_anti")
    claimed = claims.select("tag").distinct()
    silent = kept.join(claimed, "tag", "left_anti")
    agreed = kept.join(claims.select("tag", "concept"), ["tag", "concept"], "left_semi")
    return mapped.select("tag", "concept").unionByName(silent).unionByName(agreed).distinct()


def inapplicable(tags: DataFrame, evidence: DataFrame, concepts: DataFrame, rules: dict[str, list[str]], least: int = 8, statements: int = 3, rounds: int = 4) -> DataFrame:
    """entity, concept that a company gives no evidence of, of companies with enough tags on all statements.

    tags: entity, stmt, tag over all quarters; evidence: tag, concept; concepts: concept, all that are asked about.  What rules make
    derivable applies, too.
    """
    judged = enough_evidence(tags, least, statements)
    seen = tags.select("entity", "tag").distinct().join(evidence, "tag").select("entity", "concept").distinct()
    has = derivable(seen, rules, rounds)
    return judged.crossJoin(concepts.select("concept").distinct()).join(has, ["entity", "concept"], "left_anti")
