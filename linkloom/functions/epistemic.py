"""The lattice of epistemic statuses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STATUSES = ("OBSERVED", "INFERRED", "POSSIBLE", "NEGATED", "CONTRADICTED", "UNKNOWN")
#: Other words for a status; anything else is UNKNOWN.
SYNONYMS = {
    "OBSERVED": ("FACTUAL", "CONFIRMED", "VERIFIED"), "INFERRED": ("STATISTICAL_FINDING", "MODEL_FINDING"), "POSSIBLE": ("MAYBE", "MODAL", "HYPOTHETICAL", "SPECULATIVE"),
    "NEGATED": ("DENIED", "FALSE"), "CONTRADICTED": ("CONFLICTED",),
}
#: What a status may become besides itself, how strong it is, and its older name.
REFINEMENTS = {"INFERRED": ("POSSIBLE",), "POSSIBLE": (), "CONTRADICTED": ("OBSERVED", "INFERRED")}
RANK = {"UNKNOWN": 0, "POSSIBLE": 1, "INFERRED": 2, "OBSERVED": 3, "NEGATED": 3, "CONTRADICTED": 4}
FACTS = {"OBSERVED": "OBSERVED", "INFERRED": "INFERRED", "POSSIBLE": "HYPOTHETICAL", "NEGATED": "UNKNOWN", "CONTRADICTED": "CONTRADICTED", "UNKNOWN": "UNKNOWN"}


def _choose(status: Column, table: dict) -> Column:
    out = F.lit(None)
    for k, v in table.items():
        out = F.when(status == k, F.lit(v)).otherwise(out)
    return out


def coerce(status: Column) -> Column:
    """The canonical status that a word, in any case, stands for."""
    word = F.upper(F.trim(F.coalesce(status, F.lit(""))))
    out = F.lit("UNKNOWN")
    for name in STATUSES:
        out = F.when(word.isin(name, *SYNONYMS.get(name, ())), name).otherwise(out)
    return out


def can_refine(current: Column, proposed: Column) -> Column:
    """Whether the lattice lets a status become the proposed one: weak ones are never made strong."""
    cur, new = coerce(current), coerce(proposed)
    out = cur == new
    for name, to in REFINEMENTS.items():
        if to:
            out |= (cur == name) & new.isin(*to)
    return out


def rank(status: Column) -> Column:
    return _choose(coerce(status), RANK)


def fact_status(status: Column) -> Column:
    return _choose(coerce(status), FACTS)


def merge(statuses: Column) -> Column:
    """Of an array: CONTRADICTED where one is observed and another negated, else the weakest that is known, the earliest of equals."""
    known = F.filter(F.transform(F.filter(statuses, lambda s: s.isNotNull()), coerce), lambda s: s != "UNKNOWN")
    worth = F.transform(known, lambda s: _choose(s, RANK))
    weakest = F.get(known, F.array_position(worth, F.array_min(worth)).cast("int") - 1)
    return F.when(F.array_contains(known, "OBSERVED") & F.array_contains(known, "NEGATED"), "CONTRADICTED").when(F.size(known) > 0, weakest).otherwise("UNKNOWN")


def without_evidence(status: Column, has_evidence: Column) -> Column:
    """OBSERVED falls to INFERRED where there is no evidence."""
    cur = coerce(status)
    return F.when((cur == "OBSERVED") & ~has_evidence, "INFERRED").otherwise(cur)
