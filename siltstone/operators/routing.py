"""Routing of messages to topic guides by explainable scores."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text


@dataclass(frozen=True)
class Guide:
    id: str
    name: str
    category: str
    terms: tuple[str, ...] = ()
    title: str = ""
    summary: str = ""
    color: str = ""
    prompt: str | None = None


# The activation terms of the four default specialists.
DEFAULT_TERMS = {
    "documents": ("residence permit", "work permit", "visa", "application", "apply", "document", "form", "passport", "migri", "citizenship"),
    "work": ("job", "career", "employment", "employer", "workplace", "networking", "cv", "resume", "interview"),
    "benefits": ("kela", "benefit", "benefits", "social security", "allowance", "family support", "parental", "unemployment benefit"),
    "housing": ("housing", "home", "apartment", "rent", "rental", "landlord", "tenant", "lease"),
}
DEFAULT_ROSTER = (
    Guide("coordinator", "Coordinator", "Conversation guidance"),
    Guide("documents", "Documents", "Immigration and legal processes", DEFAULT_TERMS["documents"]),
    Guide("work", "Work", "Economic integration", DEFAULT_TERMS["work"]),
    Guide("benefits", "Benefits", "Social services and benefits", DEFAULT_TERMS["benefits"]),
    Guide("housing", "Housing", "Settlement and daily life", DEFAULT_TERMS["housing"]),
)


def listing(spark: SparkSession, roster: tuple[Guide, ...] = DEFAULT_ROSTER) -> DataFrame:
    """What a user sees of each guide, in roster order: ``id, name, title, category, summary, color``."""
    fields = ("id", "name", "title", "category", "summary", "color")
    return spark.createDataFrame([tuple(getattr(g, f) for f in fields) for g in roster], ", ".join(f"{f} string" for f in fields)).coalesce(1)


def score(message: Column, guide: Guide) -> Column:
    """Whole-word matches of the guide's terms in a lower-cased message, each counted by its words."""
    out = F.lit(0)
    for term in guide.terms:
        out = out + F.regexp_count(message, F.lit(rf"(?U)(?<!\w){re.escape(term)}(?!\w)")) * len(term.split())
    return out


def route(messages: DataFrame, roster: tuple[Guide, ...] = DEFAULT_ROSTER, message_col: str = "message", preferred_col: str = "preferred") -> DataFrame:
    """Adds ``guide_id, reason, was_explicit, score``.  The first of the roster is the coordinator, who takes what no other scores for.

    A chosen guide wins, then a standalone mention (first in roster order), then the best score (first in roster
    order).  The roster is configuration, so scores are plain expressions and nothing is joined.  An unknown guide id
    gives a null guide.
    """
    known = {g.id: g for g in roster}
    chief, rest = roster[0], roster[1:]
    low = text.casefold(F.coalesce(F.col(message_col), F.lit("")))
    pref = F.col(preferred_col)
    mention = F.lit(None).cast("string")
    for g in reversed(roster):
        mention = F.when(F.coalesce(F.col(message_col), F.lit("")).rlike(rf"(?iU)(?<![\w@])@{re.escape(g.name)}(?!\w)"), g.id).otherwise(mention)
    df = messages.withColumn("__scores", F.array(*[score(low, g) for g in rest])).withColumn("__mention", mention)
    best = F.array_max("__scores") if rest else F.lit(0)
    by_score = F.when(best > 0, F.element_at(F.array(*[F.lit(g.id) for g in rest]), F.array_position("__scores", best).cast("int"))).otherwise(chief.id)
    explicit = pref.isNotNull() & (pref != "auto")
    picked = F.when(explicit, F.when(pref.isin(*known), pref)).otherwise(F.coalesce("__mention", by_score))

    def of(field: str, key: Column) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for g in roster for x in (g.id, getattr(g, field))]), key)

    reason = (
        F.when(explicit, "You selected this guide.")
        .when(F.col("__mention").isNotNull(), F.concat(F.lit("You mentioned @"), of("name", F.col("__mention")), F.lit(".")))
        .when(best > 0, F.concat(F.lit("This looks like a "), F.lower(of("category", by_score)), F.lit(" question.")))
        .otherwise(f"{chief.name} will clarify the best next step before involving a specialist.")
    )
    return df.select(*messages.columns, picked.alias("guide_id"), F.when(picked.isNotNull(), reason).alias("reason"), (explicit | F.col("__mention").isNotNull()).alias("was_explicit"), best.cast("long").alias("score"))
