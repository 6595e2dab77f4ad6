"""Questions in English: parsed on the driver into a structured query, which builds a DataFrame; and the tools by name."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators import evidence, network, paths, profiles, search
from linkloom.operators.graph import fan, hubs, k_hop

#: Patterns of intents, the first that fits.
INTENTS = (
    (r"(?:who|what).*(?:connected|connect|link|relate).*(?:to|with)\s+(\S+)", "entity_neighbors"),
    (r"(?:show|find|list).*(?:connected|connections|neighbors).*(?:of|to|around)\s+(\S+)", "entity_neighbors"),
    (r"(?:financial|money|fund|transfer|transaction).*(?:from|of|involving)\s+(\S+)", "financial_flow"),
    (r"(?:show|trace|follow).*(?:money|fund|financial|transaction).*(?:from|of)\s+(\S+)", "financial_flow"),
    (r"(?:what|which).*(?:changed|change|happen|happened).*(?:after|since|before|during)\s+(.+)", "temporal_change"),
    (r"(?:replay|timeline|evolution).*(?:after|since|before|around)\s+(.+)", "temporal_replay"),
    (r"(?:evidence|record|support|back).*(?:for|of|between)\s+(.+)", "evidence_lookup"),
    (r"(?:contradict|counter|weaken).*(?:evidence|proof|claim)\s+(.+)", "contradiction_lookup"),
    (r"(?:who|which).*(?:bridge|connect|link).*(?:communities|groups|clusters)\s+(.+)", "community_bridge"),
    (r"(?:which|what).*(?:case|cases).*(?:contain|include|have)\s+(.+)", "cross_case_search"),
    (r"(?:find|show|detect).*(?:fan-in|fan-out|hub|broker|chain|ring|cycle|motif).*(?:for|of|involving|around)\s+(\S+)", "motif_search"),
    (r"(?:where|location|place|area|map).*(?:of|for|near|around)\s+(.+)", "geo_lookup"),
    (r"(?:who|what)\s+is\s+(\S+)", "entity_lookup"),
    (r"(?:tell|show|find)\s+(?:me\s+)?(?:about)\s+(\S+)", "entity_lookup"),
)
#: Words that name relations, and months.
RELATION_WORDS = (
    (("financial", "money", "fund", "transfer", "transaction"), ("TRANSFERRED_TO", "TRANSFERRED_FUNDS", "USES_ACCOUNT")),
    (("communication", "call", "phone", "sms", "whatsapp"), ("CALLED", "SMS", "WHATSAPP", "COMMUNICATED_WITH")),
    (("meeting", "met"), ("MEETING",)),
    (("location", "located", "near", "place"), ("LOCATED_AT", "OCCURRED_AT")),
)
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
MOST = 25


@dataclass(frozen=True)
class Question:
    """A parsed question."""

    text: str
    intent: str = "general_search"
    entities: tuple[str, ...] = ()
    relations: tuple[str, ...] = ()
    start: str | None = None
    end: str | None = None
    window_days: int | None = None
    confidence: float = 0.5
    notes: tuple[str, ...] = field(default=())


def time_range(text: str) -> dict:
    """start and end of a named month or year, or window_days of "last n days"; a month without a year is one of 2025 and ends on the 28th."""
    month = re.search(rf"({'|'.join(MONTHS)})\s*(20\d{{2}})?", text)
    if month:
        year, n = month[2] or "2025", MONTHS.index(month[1]) + 1
        return {"start": f"{year}-{n:02d}-01 00:00:00", "end": f"{year}-{n:02d}-28 23:59:59"}
    year = re.search(r"(20\d{2})", text)
    if year:
        return {"start": f"{year[1]}-01-01 00:00:00", "end": f"{year[1]}-12-31 23:59:59"}
    days = re.search(r"last\s+(\d+)\s+days?", text)
    return {"window_days": int(days[1])} if days else {}


def parse(text: str) -> Question:
    """The first intent that fits, ids named (letters, a dash or colon, digits) or else what the pattern caught, relations and times."""
    low = text.lower().strip().rstrip("?")
    caught = next(((intent, m) for pattern, intent in INTENTS if (m := re.search(pattern, low))), None)
    ids = re.findall(r"\b(?:p-\d{4}|case-\d{4}|[a-z]{2,3}-\d{3,6}|[a-z]:[a-z0-9]+)\b", low)
    entities = tuple(x.upper() for x in dict.fromkeys(ids)) or ((caught[1][1].strip(),) if caught else ())
    relations = tuple(r for words, held in RELATION_WORDS if any(w in low for w in words) for r in held)
    notes = tuple(n for n, c in (("no specific intent", caught is None), ("no specific entity", not entities)) if c)
    return Question(text, caught[0] if caught else "general_search", entities, relations, confidence=0.9 if caught and entities else 0.5, notes=notes, **time_range(low))


@dataclass
class Engine:
    """Answers over tables: nodes, edges, evidence, members; at most MOST rows a question, the feature of it."""

    nodes: DataFrame
    edges: DataFrame
    evidence: DataFrame
    members: DataFrame

    def answer(self, text: str) -> DataFrame:
        """subject, detail, score, in order of score, then subject."""
        rows = self.plan(parse(text))
        return rows.select("subject", "detail", F.col("score").cast("double").alias("score")).orderBy(F.desc("score"), "subject", "detail").limit(MOST)

    def find(self, label: str) -> str | None:
        """The id of a node by id or name: equal first, then contained, the smallest id of those."""
        low = F.lower("label")
        hit = self.nodes.where((F.lower("id") == label.lower()) | (low == label.lower()) | F.contains(low, F.lit(label.lower())))
        first = hit.orderBy(F.when((F.lower("id") == label.lower()) | (low == label.lower()), 0).otherwise(1), "id").select("id").first()
        return first[0] if first else None

    def plan(self, q: Question) -> DataFrame:
        of = (self.find(q.entities[0]) if q.entities else None) or ""
        if q.intent == "entity_neighbors":
            return network.neighbours(self.edges, of).select(F.col("other").alias("subject"), F.concat_ws(" ", "direction", "relation").alias("detail"), F.col("edges").alias("score"))
        if q.intent == "financial_flow":
            e = search.transfer_edges(self.edges).where((F.col("src") == of) | (F.col("dst") == of))
            return profiles.flows_with_evidence(e).select(F.concat_ws(">", "src", "dst").alias("subject"), F.col("evidence").alias("detail"), F.col("total_amount").alias("score"))
        if q.intent in ("temporal_change", "temporal_replay"):
            e = self.edges.where(F.col("ts").isNotNull())
            if q.start:
                e = e.where(F.col("ts").between(F.lit(q.start).cast("timestamp_ntz"), F.lit(q.end).cast("timestamp_ntz")))
            return e.groupBy(F.col("relation").alias("subject")).agg(F.min(F.date_format("ts", "yyyy-MM-dd")).alias("detail"), F.count(F.lit(1)).alias("score"))
        if q.intent in ("evidence_lookup", "contradiction_lookup"):
            terms = re.findall(r"[a-z0-9_]{3,}", " ".join(q.entities).lower()) or ["evidence"]
            return evidence.search(self.evidence, terms).select(F.col("evidence_id").alias("subject"), F.lit("evidence").alias("detail"), "score")
        if q.intent == "community_bridge":
            return network.connectors(self.edges, self.members, 2).select(F.col("node").alias("subject"), F.lit("communities").alias("detail"), F.col("communities").alias("score"))
        if q.intent == "cross_case_search":
            return self.members.where(F.col("node") == of).select(F.col("community").alias("subject"), F.lit("case").alias("detail"), F.lit(1.0).alias("score"))
        if q.intent == "motif_search":
            out = fan(self.edges, "dst").select("node", F.lit("FAN_IN").alias("detail"), "edges").unionByName(fan(self.edges, "src").select("node", F.lit("FAN_OUT").alias("detail"), "edges"))
            out = out.unionByName(hubs(self.edges).select("node", F.lit("HUB").alias("detail"), F.col("degree").alias("edges")))
            return out.where(F.col("node") == of).select(F.col("node").alias("subject"), "detail", F.col("edges").alias("score"))
        if q.intent == "geo_lookup":
            e = self.edges.where(F.upper("relation").isin("LOCATED_AT", "LOCATED_IN", "OCCURRED_AT") & (F.col("src") == of))
            return e.groupBy(F.col("dst").alias("subject")).agg(F.lit("place").alias("detail"), F.count(F.lit(1)).alias("score"))
        if q.intent == "entity_lookup":
            seen = search.entities(self.nodes, self.edges).where(F.col("id") == of)
            return seen.select(F.col("id").alias("subject"), F.concat_ws(" ", "entity_type", "label").alias("detail"), F.col("mentions").alias("score"))
        return search.everywhere(self.nodes, None, self.evidence, [q.text.lower()], MOST).select(F.col("id").alias("subject"), F.col("result_type").alias("detail"), F.lit(1.0).alias("score"))

    # --- tools: one name each ---------------------------------------------------------------------

    def tool(self, name: str, **given) -> DataFrame:
        """A tool by its name: search, get, neighbours, neighbourhood, paths, communities, connectors, finance, support, timeline, counterfactual, cross_case, centrality, anomalies."""
        from linkloom.operators.centrality import counterfactual
        from linkloom.operators.graph import degrees
        from linkloom.operators.temporal import burst_z

        tools = {
            "search": lambda q, limit=MOST: search.everywhere(self.nodes, None, self.evidence, [q.lower()], limit),
            "get": lambda id: search.entities(self.nodes, self.edges).where(F.col("id") == id),  # noqa: A006
            "neighbours": lambda id, direction="both", relation=None: network.neighbours(self.edges, id, direction, relation),  # noqa: A006
            "neighbourhood": lambda id, hops=2: k_hop(self.edges, id, hops),  # noqa: A006
            "paths": lambda source, target, k=3, most=4: paths.shortest(self.edges, source, target, k, most),
            "communities": lambda top=12: profiles.community_details(self.edges, self.members, top),
            "connectors": lambda least=3: network.connectors(self.edges, self.members, least),
            "finance": lambda least=0.0: profiles.flows_with_evidence(search.transfer_edges(self.edges), least),
            "support": lambda id: evidence.by_node(self.evidence, id),  # noqa: A006
            "timeline": lambda ids, start=None, end=None: evidence.timeline(self.evidence, ids, start, end),
            "counterfactual": lambda id, operation="remove_node", other=None: counterfactual(self.edges, operation, id, other),  # noqa: A006
            "cross_case": lambda id: self.members.where(F.col("node") == id),  # noqa: A006
            "centrality": lambda: degrees(self.edges),
            "anomalies": lambda z=3.0: burst_z(self.edges.where("ts IS NOT NULL").select(F.col("src").alias("entity"), "ts"), "entity", z=z),
        }
        if name not in tools:
            raise ValueError(f"unknown tool {name}; known: {', '.join(sorted(tools))}")
        return tools[name](**given)
