"""Text to tables: entity mentions, relations, events, coreference, claims and cleaned records."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions import text as T

#: Kinds of crime and banks that patterns name.
CRIMES = ("extortion", "assault", "narcotics", "smuggling", "theft", "fraud", "money laundering", "illegal weapons", "unlawful assembly", "kidnapping", "robbery", "cybercrime", "dacoity", "homicide", "forgery")
BANKS = ("state bank of india", "hdfc bank", "icici bank", "axis bank", "punjab national bank", "bank of baroda", "canara bank", "kotak mahindra")
#: Label, priority (less is better), pattern; a group, if there is one, is the mention.
DOMAIN_PATTERNS = (
    ("EMAIL", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("UPI", 0, r"[A-Za-z0-9.\-_]+@[a-zA-Z]+"),
    ("ACCOUNT", 1, r"(?:account|a/c|acc(?:ount)?)[\s:#-]*([A-Z0-9]{6,18})"),
    ("PHONE", 0, r"(?:\+?91[\s-]?)?[6-9]\d{9}"),
    ("VEHICLE", 1, r"\b[A-Z]{2}[-\s]?[0-9]{1,2}[-\s]?[A-Z]{1,3}[-\s]?[0-9]{4}\b"),
    ("SOCIAL_HANDLE", 2, r"@[a-zA-Z0-9_]{3,20}"),
    ("DEVICE", 2, r"(?:imei|sim|device)[\s:#-]*(\d{10,16})"),
    ("IDENTIFIER", 2, r"\b[2-9]{1}[0-9]{3}\s?[0-9]{4}\s?[0-9]{4}\b"),
    ("CRIME_TYPE", 3, rf"\b({'|'.join(CRIMES)})\b"),
    ("BANK", 1, rf"\b({'|'.join(BANKS)})\b"),
    ("DATE", 2, r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b\d{4}-\d{2}-\d{2}\b"),
    ("TIME", 2, r"\b\d{1,2}:\d{2}\s?(?:am|pm|hrs)?\b"),
    ("CASE", 3, r"\b(?:Section|Sec\.|S\.)\s*(\d+[A-Za-z]?)\s+(?:BNS|IPC|CrPC)\b"),
    ("CASE", 3, r"\b(?:FIR|CR|CC|Sessions Case)\s*(?:No\.?)?\s*(\d+/\d{4})\b"),
    ("ADDRESS", 3, r"\b\d{1,4}[\s,]+[A-Za-z][A-Za-z\s,]{5,40}(?:road|street|lane|nagar|colony|street|salai)\b"),
)
CASE_REFERENCE = r"\b(?:case|fir|crime)\s*(?:no\.?|number)?\s*[\s#:-]*(\d{1,6}(?:[/-]\d{2,4})?)"

Span = tuple[int, int, str, int]  # start, end, label, priority


def pick(spans: Sequence[Span]) -> list[Span]:
    """Spans that don't overlap: better priority first, then longer, then earlier; in order of place.

    The taken ones are kept sorted, so each new one is compared with its two neighbours only.
    """
    starts: list[int] = []
    taken: list[Span] = []
    for s in sorted(set(spans), key=lambda s: (s[3], s[0] - s[1], s[0], s[2])):
        if s[0] >= s[1]:
            continue
        i = bisect_left(starts, s[0])
        if (i and taken[i - 1][1] > s[0]) or (i < len(taken) and taken[i][0] < s[1]):
            continue
        starts.insert(i, s[0])
        taken.insert(i, s)
    return taken


def _domain(patterns: Sequence[tuple[str, int, str]] = DOMAIN_PATTERNS):
    rules = [(label, priority, re.compile(p, re.IGNORECASE)) for label, priority, p in patterns] + [("CASE", 3, re.compile(CASE_REFERENCE, re.IGNORECASE))]

    def find(text: str) -> list[Span]:
        out = []
        for i, (label, priority, rx) in enumerate(rules):
            group = 1 if rx.groups and i < len(rules) - 1 else 0
            out += [(*m.span(group), label, priority) for m in rx.finditer(text)]
        return pick(out)

    return find


MENTION = "label string, surface string, start int, end int"


def _mentions(records: DataFrame, text: str, key: str, find) -> DataFrame:
    kind = records.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(k, label, t[a:b], a, b) for k, t in zip(frame["key"], frame["text"].fillna(""), strict=True) for a, b, label, _ in find(t)]
            yield pd.DataFrame(out, columns=["key", "label", "surface", "start", "end"])

    found = records.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, {MENTION}")
    return found.withColumnRenamed("key", key) if key != "key" else found


def domain_mentions(records: DataFrame, text: str, key: str) -> DataFrame:
    """key, label, surface, start, end of what the fifteen patterns and the case references find, without overlaps."""
    return _mentions(records, text, key, _domain())


#: Patterns of people, organizations and places by spelling, for texts without a statistical model.
NAME_PATTERNS = (
    ("PERSON", 1, r"\b(?:Mr|Mrs|Ms|Dr|Shri|Smt)\.? [A-Z][a-z]+(?: [A-Z][a-z]+)?\b"),
    ("ORGANIZATION", 1, r"\b(?:[A-Z][A-Za-z&]+ ){1,3}(?:Gang|Ltd|Pvt|Bank|Company|Traders|Group)\b"),
    ("VEHICLE", 0, r"\b[A-Z]{2}[-\s]?[0-9]{1,2}[-\s]?[A-Z]{1,3}[-\s]?[0-9]{4}\b"),
    ("PHONE", 0, r"(?:\+?91[\s-]?)?[6-9]\d{9}"),
)


def entity_finder(gazetteer: dict[str, Sequence[str]] | None = None, patterns: Sequence[tuple[str, int, str]] = NAME_PATTERNS):
    """A function text -> spans by gazetteer (label to names; best priority), spelling and the domain patterns, without overlaps."""
    rules = [(label, 0, re.compile(r"\b(?:" + "|".join(re.escape(n) for n in sorted(held, key=len, reverse=True)) + r")\b")) for label, held in (gazetteer or {}).items() if held]
    rules += [(label, priority, re.compile(p)) for label, priority, p in patterns]
    domain = _domain()

    def find(text: str) -> list[Span]:
        own = [(*m.span(), label, priority) for label, priority, rx in rules for m in rx.finditer(text)]
        return pick(own + [(a, b, label, priority + 2) for a, b, label, priority in domain(text)])

    return find


def entities(records: DataFrame, text: str, key: str, gazetteer: dict[str, Sequence[str]] | None = None, patterns: Sequence[tuple[str, int, str]] = NAME_PATTERNS) -> DataFrame:
    """key, label, surface, start, end by entity_finder()."""
    return _mentions(records, text, key, entity_finder(gazetteer, patterns))


def merge_mentions(statistical: DataFrame, domain: DataFrame, key: str) -> DataFrame:
    """The domain's mentions, and those statistical ones that overlap none of them."""
    d = domain.select(F.col(key).alias("__k"), F.col("start").alias("__s"), F.col("end").alias("__e"))
    free = statistical.join(d, (F.col(key) == F.col("__k")) & (F.col("start") < F.col("__e")) & (F.col("__s") < F.col("end")), "left_anti")
    return domain.unionByName(free)


# --- relations ----------------------------------------------------------------------------------

#: Words that tell of a transfer, of receiving, of a call and of a meeting.
TRANSFER = "transfer transferred transfers transferring send sent sends sending wire wired wiring pay paid pays paying remit remitted remittance give gave gives given donate donated".split()
RECEIVE = "receive received receives receiving collect collected collects".split()
CALL = "call called calls calling phone phoned phones ring rang rung dial dialed dialled dials contact contacted".split()
MEET = "meet meets met meeting gathered assemble assembled rendezvous conferred".split()
#: Phrases between a member or leader and an organization, an owner and a vehicle, a person and a place.
MEMBER_CUE = r"\b(?:member\s+of|part\s+of|belongs\s+to|works?\s+for|worked\s+for|affiliated\s+with|associated\s+with|boss\s+of|head(?:ed|s)?\s+of|leader\s+of|leads|runs)\b"
LEADER_CUE = r"\b(?:boss|head|heads|headed|leader|leads|runs|kingpin)\b"
LED_BY = r"\b(?:led\s+by|run\s+by|headed\s+by)\b"
VEHICLE_CUE = r"\b(?:drives?|drove|driving|owns?|owned|rides?|rode|riding|seen\s+(?:in|driving|riding)|spotted\s+(?:in|driving|riding)|travel(?:l)?ed\s+in|arrived\s+in|left\s+in|registered\s+to)\b"
PLACE_CUE = r"\b(?:lives?|lived|resides?|resided|staying\s+(?:at|in)|based\s+in|operates?\s+(?:from|in)|located\s+(?:at|in))\b"
GOT_CALL = r"\b(?:received|got)\s+(?:an?\s+)?call\s+from\b"
MONEY_CONTEXT = r"\b(?:money|funds|cash|payment|amount|sum|fee|rupees?|dollars?|euros?|paid)\b"
ACCOUNT = r"\b(?:account|acct)\s+([A-Z0-9][A-Z0-9_-]{2,})\b"
_AMOUNT = re.compile(T._AMOUNT, re.IGNORECASE)
_TIME = re.compile(r"\b\d{4}-\d{2}-\d{2}(?:[T\s]\d{2}:\d{2}(?::\d{2})?Z?)?\b|\b\d{1,2}:\d{2}(?::\d{2})?\b")
_WORD = re.compile(r"\w+")
_SPLIT = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")


def _amount(sentence: str, spans: Sequence[Span]) -> float | None:
    """The first amount outside of entities."""
    letters = list(sentence)
    for a, b, label, _ in spans:
        if label in ("PERSON", "ORGANIZATION", "LOCATION", "VEHICLE", "PHONE", "DATE", "TIME"):
            letters[a:b] = " " * (b - a)
    m = _AMOUNT.search("".join(letters))
    return round(float(m[1].replace(",", "")) * T.MULTIPLIERS.get((m[2] or "").lower(), 1), 2) if m else None


def relations_of(sentence: str, spans: Sequence[Span], infer: bool = True) -> list[tuple]:
    """(source, source type, relation, target, target type, confidence, amount, account, time) of one sentence and its entities.

    Without any explicit relation, neighbouring people are ASSOCIATED_WITH each other at 0.4 (if `infer`).
    """
    of = {label: [s for s in spans if s[2] == label] for label in ("PERSON", "ORGANIZATION", "LOCATION", "VEHICLE", "PHONE")}
    people, groups, places_ = of["PERSON"], of["ORGANIZATION"], of["LOCATION"]
    words = [(m.start(), m.end(), m[0].lower()) for m in _WORD.finditer(sentence)]
    out: list[tuple] = []
    before = lambda held, at: next((s for s in reversed(held) if s[1] <= at), None)
    after = lambda held, at: next((s for s in held if s[0] >= at), None)
    name = lambda s: sentence[s[0] : s[1]].strip()
    time = (m := _TIME.search(sentence)) and m[0]

    def add(a: Span, relation: str, b: Span, sure: float = 1.0, amount: float | None = None, account: str | None = None) -> None:
        out.append((name(a), a[2], relation, name(b), b[2], sure, amount, account, time))

    def found(held: list[str]) -> list[tuple[int, int, str]]:
        return [w for w in words if w[2] in held]

    verbs = found(TRANSFER) + found(RECEIVE)
    amount = _amount(sentence, spans) if verbs else None
    if verbs and (amount is not None or re.search(MONEY_CONTEXT, sentence, re.IGNORECASE)):
        account = (m := re.search(ACCOUNT, sentence, re.IGNORECASE)) and m[1].upper()
        anyone = sorted(people + groups)
        seen = set()
        for start, end, verb in verbs:
            marker = {w[2]: w[1] for w in reversed(words) if w[0] > start}
            if verb in RECEIVE:
                a, b = after(people, min((marker[x] for x in ("from", "by") if x in marker), default=end)), before(people, start)
            elif re.search(rf"\b(?:was|were|is|are|been|being)\s+{verb}\b", sentence, re.IGNORECASE):
                later = [p for p in people if p[0] >= end]
                b = later[0] if later else None
                a = later[1] if len(later) > 1 else before(people, start)
            else:
                a = before(people, start)
                b = (after(anyone, marker["to"]) if "to" in marker else None) or after(anyone, end)
            if a is None or b is None or name(a) == name(b) or (name(a), name(b)) in seen:
                continue
            seen.add((name(a), name(b)))
            add(a, "TRANSFERRED_FUNDS", b, amount=amount, account=account)
            if account:
                out += [(name(x), x[2], "USES_ACCOUNT", account, "ACCOUNT", 1.0, None, account, time) for x in (a, b)]
    got = re.search(GOT_CALL, sentence, re.IGNORECASE)
    calls = [(got.start(), got.end())] if got else [(w[0], w[1]) for w in found(CALL)]
    for start, end in calls:
        a, b = before(people, start), after(people, end)
        if a and b and name(a) != name(b):
            add(*((b, "CALLED", a) if got else (a, "CALLED", b)))
    if found(MEET):
        for i, a in enumerate(people):
            for b in people[i + 1 :]:
                add(a, "MET", b)
        if len(people) == 1 and places_:
            add(people[0], "ATTENDED_MEETING_AT", places_[0])
    for m in re.finditer(MEMBER_CUE, sentence, re.IGNORECASE):
        a, b = before(people, m.start()), after(groups, m.end())
        if a and b:
            add(a, "LEADS" if re.search(LEADER_CUE, m[0], re.IGNORECASE) else "MEMBER_OF", b)
    for m in re.finditer(LED_BY, sentence, re.IGNORECASE):
        a, b = after(people, m.end()), before(groups, m.start())
        if a and b:
            add(a, "LEADS", b)
    driven = 1.0 if re.search(VEHICLE_CUE, sentence, re.IGNORECASE) else 0.6
    for held, relation, sure in ((of["VEHICLE"], "OWNS_VEHICLE", driven), ([] if calls else of["PHONE"], "HAS_PHONE", 1.0)):
        for b in held:
            if a := before(people, b[0]):
                add(a, relation, b, sure)
    for m in re.finditer(PLACE_CUE, sentence, re.IGNORECASE):
        a, b = before(people, m.start()), after(places_, m.end())
        if a and b:
            add(a, "LOCATED_AT", b)
    if infer and not out:
        for a, b in zip(people, people[1:], strict=False):
            add(a, "ASSOCIATED_WITH", b, 0.4)
    return out


TRIPLET = "sentence int, source string, source_type string, relation string, target string, target_type string, confidence double, amount double, account string, moment string, evidence string"


def triplets(records: DataFrame, text: str, key: str, gazetteer: dict[str, Sequence[str]] | None = None, patterns: Sequence[tuple[str, int, str]] = NAME_PATTERNS, infer: bool = True) -> DataFrame:
    """Relations of every record, sentence by sentence, by rules over its entities."""
    kind = records.schema[key].dataType.simpleString()
    find = entity_finder(gazetteer, patterns)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, t in zip(frame["key"], frame["text"].fillna(""), strict=True):
                for i, sentence in enumerate(s for s in _SPLIT.split(t.strip()) if s):
                    out += [(k, i, *r, sentence) for r in relations_of(sentence, find(sentence), infer)]
            yield pd.DataFrame(out, columns=["key", *(c.split()[0] for c in TRIPLET.split(", "))]).astype({"amount": "float64"})

    found = records.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, {TRIPLET}")
    return found.withColumnRenamed("key", key) if key != "key" else found


def structured_triplets(calls: DataFrame, transfers: DataFrame, meetings: DataFrame) -> DataFrame:
    """record, source, relation, target, target_type of observations: calls and transfers (record, src, dst), their accounts (account, or null), meetings (record, attendees in order): every pair i < j."""

    def row(df: DataFrame, a: Column | str, relation: str, b: Column | str, kind: str = "PERSON") -> DataFrame:
        c = lambda x: F.col(x) if isinstance(x, str) else x
        return df.select("record", c(a).alias("source"), F.lit(relation).alias("relation"), c(b).alias("target"), F.lit(kind).alias("target_type"))

    held = transfers.where("account IS NOT NULL AND account <> ''")
    n = F.size("attendees")
    pairs = F.flatten(F.transform("attendees", lambda a, i: F.transform(F.slice("attendees", i + 2, n), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    met = meetings.select("record", F.explode(pairs).alias("p"))
    out = row(calls, "src", "CALLED", "dst").unionByName(row(transfers, "src", "TRANSFERRED_TO", "dst"))
    out = out.unionByName(row(held, "src", "USES_ACCOUNT", "account", "ACCOUNT")).unionByName(row(held, "dst", "USES_ACCOUNT", "account", "ACCOUNT"))
    return out.unionByName(row(met, "p.a", "MET", "p.b"))


def events(found: DataFrame, key: str) -> DataFrame:
    """One event for all MET triplets of a sentence, one for each call, transfer and meeting at a place: key, sentence, event_type, participants (sorted, distinct), location, moment, event_id.

    found: key, sentence, source, relation, target, moment.
    """
    met = found.where("relation = 'MET'").groupBy(key, "sentence").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("source", "target"))))).alias("participants"), F.min("moment").alias("moment"))
    met = met.select(key, "sentence", F.lit("MEETING").alias("event_type"), "participants", F.lit(None).cast("string").alias("location"), "moment")
    single = found.where("relation IN ('CALLED', 'TRANSFERRED_FUNDS', 'ATTENDED_MEETING_AT')")
    alone = F.col("relation") == "ATTENDED_MEETING_AT"
    kind = F.when(F.col("relation") == "CALLED", "CALL").when(alone, "MEETING").otherwise("TRANSACTION")
    one = single.select(key, "sentence", kind.alias("event_type"), F.when(alone, F.array("source")).otherwise(F.array_sort(F.array_distinct(F.array("source", "target")))).alias("participants"), F.when(alone, F.col("target")).alias("location"), "moment")
    out = met.unionByName(one)
    ident = F.concat(F.lit("EVT-"), F.substring(F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.col("sentence").cast("string"), "event_type", F.array_join("participants", ",")), 256), 1, 12))
    return out.withColumn("event_id", ident)


def linking_triplets(found: DataFrame) -> DataFrame:
    """source, relation, target that tie events to their participants, type, place and time."""
    part = found.select(F.explode("participants").alias("source"), F.lit("PARTICIPATED_IN").alias("relation"), F.col("event_id").alias("target"))
    for column, relation in (("event_type", "EVENT_TYPE"), ("location", "OCCURRED_AT"), ("moment", "OCCURRED_ON")):
        part = part.unionByName(found.where(F.col(column).isNotNull()).select(F.col("event_id").alias("source"), F.lit(relation).alias("relation"), F.col(column).alias("target")))
    return part


def fallback_events(records: DataFrame, mentions: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Events that a record's type alone tells of (call, transaction, meeting), where none of that type was found: its first two people."""
    kind = F.upper(F.regexp_extract(F.lower("record_type"), "(call|transaction|meeting)", 1))
    want = records.select(key, kind.alias("event_type")).where("event_type <> ''").join(found.select(key, "event_type").distinct(), [key, "event_type"], "left_anti")
    people = mentions.where("label = 'PERSON'").groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct("start", "surface"))), 1, 2).alias("p"))
    return want.join(people, key).select(key, "event_type", F.transform("p", lambda x: x["surface"]).alias("participants"))


# --- sentences, coreference, claims -------------------------------------------------------------


def coreference(pronouns: DataFrame, candidates: DataFrame) -> DataFrame:
    """The best antecedent of each pronoun above 0.5: 0.4 gender, 0.4 recency (0.15 less a sentence), 0.2 person.

    pronouns: doc, sentence, start, pronoun; candidates: doc, sentence, start, entity, gender (male, female or
    neutral), is_person. Candidates of later sentences don't count; of equal scores the later place wins.
    """
    he, she = ("he", "him", "his"), ("she", "her", "hers")
    p = pronouns.withColumn("pg", F.when(F.lower("pronoun").isin(*he), "male").when(F.lower("pronoun").isin(*she), "female").otherwise("plural"))
    c = candidates.select("doc", F.col("sentence").alias("cs"), F.col("start").alias("cstart"), "entity", "gender", "is_person")
    met = p.join(c, "doc").where((F.col("cs") < F.col("sentence")) | ((F.col("cs") == F.col("sentence")) & (F.col("cstart") < F.col("start"))))
    gender = F.when((F.col("pg") == "male") & (F.col("gender") == "female"), 0.1).when((F.col("pg") == "female") & (F.col("gender") == "male"), 0.1).when((F.col("pg") == "plural") & F.col("gender").isin("male", "female"), 0.5).otherwise(1.0)
    recency = F.greatest(F.lit(0.0), 1 - 0.15 * (F.col("sentence") - F.col("cs")))
    score = F.round(0.4 * gender + 0.4 * recency + 0.2 * F.when(F.col("is_person"), 1.0).otherwise(0.3), 6)
    best = met.withColumn("score", score).groupBy("doc", "sentence", "start", "pronoun").agg(F.max(F.struct("score", "cs", "cstart", "entity")).alias("b"))
    return best.where("b.score > 0.5").select("doc", "sentence", "start", "pronoun", F.col("b.entity").alias("antecedent"), F.col("b.score").alias("confidence"))


def pronouns(records: DataFrame, text: str, key: str) -> DataFrame:
    """doc, sentence, start (a running number), pronoun of every personal pronoun."""
    s = records.select(F.col(key).alias("doc"), F.posexplode(T.sentences(F.col(text))).alias("sentence", "t"))
    return s.select("doc", "sentence", F.posexplode(F.regexp_extract_all("t", F.lit(r"(?i)\b(he|she|him|her|his|hers|they|them|their|theirs)\b"), F.lit(1))).alias("start", "pronoun"))


def claims(records: DataFrame, text: str, key: str, mentions: DataFrame) -> DataFrame:
    """One claim for each entity of each sentence that holds it: subject, modality, negation. mentions: key, surface."""
    s = records.select(key, F.posexplode(T.sentences(F.col(text))).alias("sentence", "t"))
    m = mentions.select(key, "surface").distinct()
    rows = s.join(m, key).where(F.contains("t", F.col("surface")))
    return rows.select(key, "sentence", F.col("surface").alias("subject"), T.modality(F.col("t")).alias("modality"), T.negated(F.col("t")).alias("is_negated"), F.when(T.negated(F.col("t")), "NEGATIVE").otherwise("POSITIVE").alias("polarity"))


def temporal_mentions(records: DataFrame, text: str, key: str, anchor: str, mentions: DataFrame) -> DataFrame:
    """An event for each sentence with a time and entities: key, sentence, iso, up to three participants in order."""
    s = records.select(key, F.posexplode(T.sentences(F.col(text))).alias("sentence", "t")).withColumn("when", T.temporal(F.col("t"), F.lit(anchor).cast("timestamp_ntz"))).where("when.iso IS NOT NULL")
    held = s.join(mentions.select(key, "surface").distinct(), key).where(F.contains("t", F.col("surface")))
    out = held.groupBy(key, "sentence", F.col("when.iso").alias("iso")).agg(F.slice(F.sort_array(F.collect_set("surface")), 1, 3).alias("participants"))
    return out.select(key, "sentence", "iso", F.array_join("participants", ",").alias("participants"))


def negated_edges(edges: DataFrame, nodes: DataFrame, texts: DataFrame, text: str, longest: int = 3) -> DataFrame:
    """edges with polarity NEGATED where both ends are named (whole words) in the reach of one negation.

    The reach's runs of up to `longest` words are joined to the names: no name is searched in every text.
    """
    s = texts.select(F.monotonically_increasing_id().alias("t"), F.explode(T.sentences(F.col(text))).alias("s")).withColumn("scope", T.negation_scope(F.col("s"))).where("scope IS NOT NULL")
    w = s.select("t", "s", F.filter(F.split(F.lower("scope"), r"(?U)[^\w:]+"), lambda x: x != "").alias("w"))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1))), lambda i: F.array_join(F.slice("w", i, n), " "))))
    named = w.select("t", "s", F.explode(F.array_distinct(runs)).alias("name")).join(nodes.select("id", F.lower(F.trim("label")).alias("name")), "name").select("t", "s", "id").distinct()
    pairs = named.select("t", "s", F.col("id").alias("src")).join(named.select("t", "s", F.col("id").alias("dst")), ["t", "s"]).where("src <> dst").select("src", "dst").distinct()
    return edges.join(pairs.withColumn("polarity", F.lit("NEGATED")), ["src", "dst"], "left")


# --- records ------------------------------------------------------------------------------------


def cleaned(records: DataFrame, text: str, key: str) -> DataFrame:
    """key, cleaned, is_duplicate, duplicate_of, language, confidence: copies (by fingerprint) take the language of the smallest key.

    The smallest key of each fingerprint is found by a partial aggregate and joined back.
    """
    rows = records.select(key, T.clean(F.col(text)).alias("cleaned"))
    rows = rows.withColumn("fp", T.fingerprint(F.col("cleaned")))
    lang, sure = T.language(F.col("cleaned"))
    first = rows.groupBy("fp").agg(F.min(F.struct(key, "cleaned")).alias("f")).select("fp", F.col(f"f.{key}").alias("first"), F.col("f.cleaned").alias("cleaned")).select("fp", "first", lang.alias("language"), sure.alias("confidence"))
    out = rows.join(first, "fp")
    copy = F.col(key) != F.col("first")
    return out.select(key, "cleaned", copy.alias("is_duplicate"), F.when(copy, F.col("first")).alias("duplicate_of"), "language", "confidence")


def observations(calls: DataFrame, transfers: DataFrame, meetings: DataFrame, people: DataFrame) -> DataFrame:
    """record_id, record_type, text: raw rows as sentences. calls and transfers: record, src, dst, ts, and value; people: id, name (missing names are the id)."""
    n = people.select("id", "name")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")

    def named(df: DataFrame, end: str) -> DataFrame:
        return df.join(n.select(F.col("id").alias(end), F.col("name").alias(f"{end}_name")), end, "left").withColumn(f"{end}_name", F.coalesce(f"{end}_name", end))

    c, t = named(named(calls, "src"), "dst"), named(named(transfers, "src"), "dst")
    said = c.select(F.col("record").alias("record_id"), F.lit("call_observation").alias("record_type"), F.concat("src_name", F.lit(" called "), "dst_name", F.lit(" for "), F.col("value").cast("long").cast("string"), F.lit(" seconds on "), stamp("ts"), F.lit(".")).alias("text"))
    paid = t.select(F.col("record").alias("record_id"), F.lit("transaction_observation").alias("record_type"), F.concat("src_name", F.lit(" transferred "), F.col("value").cast("long").cast("string"), F.lit(" USD to "), "dst_name", F.lit(" on "), stamp("ts"), F.lit(".")).alias("text"))
    who = meetings.select("record", "ts", F.posexplode("attendees").alias("i", "id")).join(n, "id", "left").groupBy("record", "ts").agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce("name", "id").alias("name")))).alias("p")).where(F.size("p") >= 2)
    met = who.select(F.col("record").alias("record_id"), F.lit("meeting_observation").alias("record_type"), F.concat(F.array_join(F.transform("p", lambda x: x["name"]), ", "), F.lit(" met on "), stamp("ts"), F.lit(".")).alias("text"))
    return said.unionByName(paid).unionByName(met)


def validated(rows: DataFrame, labels: Sequence[str], evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Extracted rows (id, label, confidence, quote, doc) split into (good, rejected with reason): known label, confidence within 0..1, a quote that its document (doc, text) holds.

    What a model returns is only ever taken after these checks; OBSERVED needs evidence.
    """
    e = evidence.select(F.col("doc").alias("__d"), F.col("text").alias("__t"))
    r = rows.join(e, F.col("doc") == F.col("__d"), "left")
    reason = F.when(F.col("label").isNull() | ~F.col("label").isin(*labels), "unknown label").when(F.col("confidence").isNull() | ~F.col("confidence").between(0, 1), "confidence out of range")
    reason = reason.when(F.coalesce("quote", F.lit("")) == "", "no evidence").when(F.col("__t").isNull() | ~F.contains("__t", F.col("quote")), "quote not in document")
    r = r.withColumn("reason", reason).drop("__d", "__t")
    return r.where("reason IS NULL").drop("reason"), r.where("reason IS NOT NULL")


def graph_edges(found: DataFrame, key: str) -> DataFrame:
    """Resolved triplets (src, relation, dst) as edges with ids: a version 5 UUID of ends, relation and a number per row; parallel ones stay."""
    order = F.row_number().over(Window.partitionBy("src", "relation", "dst").orderBy(key))
    rows = found.withColumn("i", order)
    return rows.select(T.uuid5("6ba7b810-9dad-11d1-80b4-00c04fd430c8", F.concat_ws("|", "src", "relation", "dst", F.col("i").cast("string"))).alias("edge_id"), "src", "relation", "dst")
