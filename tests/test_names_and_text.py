"""Name comparison, extraction rules, mentions and questions on hand-made cases."""

import difflib
import itertools

from pyspark.sql import functions as F

from linkloom.functions import names
from linkloom.operators import extraction, resolution
from linkloom.plans import nlq


def test_alignment_is_the_best_order_keeping_pairing():
    def brute(a, b):
        best = 0.0
        for k in range(min(len(a), len(b)) + 1):
            for i in itertools.combinations(range(len(a)), k):
                for j in itertools.combinations(range(len(b)), k):
                    s = 0.0
                    for p, q in zip(i, j, strict=True):
                        x, y = a[p], b[q]
                        if x == y:
                            s += 1
                        elif 1 in (len(x), len(y)):
                            s += x[0] == y[0]
                        else:
                            s += names._distance(x, y)
                    best = max(best, s)
        return best / max(len(a), len(b))

    pool = ["j", "john", "jon", "doe", "d", "smith", "dover"]
    for n, m in itertools.product(range(1, 4), repeat=2):
        for a, b in itertools.islice(itertools.product(itertools.permutations(pool, n), itertools.permutations(pool, m)), 0, None, 97):
            assert abs(names.align(list(a), list(b))[0] - brute(a, b)) < 1e-9
    assert names.align([], ["x"]) == (0.0, False, [])


def test_names_match_by_strong_evidence_only():
    assert names.compare("john doe", "john doe")[1:] == (True, "exact")
    assert names.compare("doe john", "john doe")[1:] == (True, "same_words")
    assert names.compare("j doe", "john doe")[1:] == (True, "initials")
    assert not names.compare("john doe", "jane roe")[1]
    assert names.compare("abc", "xyz")[2] == "no_shared_initial" and names.compare("", "x")[2] == "empty"
    assert names.compare("mohammed khan", "mohammad khan")[1]
    for word, code in (("robert", "R163"), ("rupert", "R163"), ("ashcraft", "A261"), ("tymczak", "T522"), ("pfister", "P236"), ("honeyman", "H555")):
        assert names._soundex(word) == code
    assert names.ratio("abcd", "bcde") == difflib.SequenceMatcher(None, "abcd", "bcde").ratio()


def test_column_forms(spark):
    row = spark.range(1).select(
        names.normal_name(F.lit("Dr. José  O'Neil-Smith, Jr.")).alias("a"), names.sound_fold(F.lit("Shaam Bhaai")).alias("b"), names.sound_fold(F.lit("राम")).alias("c"), names.initials_key(F.lit("John Q Doe")).alias("d"), names.soundex_key(F.lit("Robert Pfister")).alias("e"),
        names.normal_name(F.lit(None).cast("string")).alias("f"), names.normal_name(F.lit("Dr Mr")).alias("g"), names.address(F.lit("")).alias("h"), names.date_of(F.lit("31/12/1999")).alias("i"), names.ngram_overlap(F.lit("gupta"), F.lit("guptha")).alias("j"),
    ).first()
    assert (row.a, row.b, row.d, row.e, row.f, row.g) == ("jose o neil smith", "sam bai", "j doe", "R163P236", "", "")
    assert row.c == "ram" and row.h.normalized == "UNKNOWN" and row.i == "1999-12-31" and 0.4 < row.j < 0.8


def test_pick_takes_priority_then_length_then_place():
    spans = [(0, 10, "a", 2), (2, 5, "b", 0), (4, 9, "c", 1), (5, 8, "d", 1), (20, 20, "e", 0), (9, 12, "f", 2)]
    assert extraction.pick(spans) == [(2, 5, "b", 0), (5, 8, "d", 1), (9, 12, "f", 2)]


def test_domain_mentions(spark):
    text = "Mail a.b@x.org, UPI bob@okbank, FIR No. 112/2025 under Section 420 IPC; fraud at HDFC Bank on 2025-03-04 10:30 pm, car TN-01-AB-1234, +91 9876543210."
    rows = extraction.domain_mentions(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string"), "t", "id").collect()
    found = {(r.label, r.surface) for r in rows}
    assert {("EMAIL", "a.b@x.org"), ("UPI", "bob@okbank"), ("VEHICLE", "TN-01-AB-1234"), ("CRIME_TYPE", "fraud"), ("BANK", "HDFC Bank"), ("DATE", "2025-03-04"), ("CASE", "420")} <= found
    spans = sorted((r.start, r.end) for r in rows)
    assert all(a[1] <= b[0] for a, b in itertools.pairwise(spans)) and all(r.surface == text[r.start : r.end] for r in rows)


def rel(text, **gazetteer):
    find = extraction.entity_finder(gazetteer or {"PERSON": ["Ramesh", "Akash", "Meera"], "ORGANIZATION": ["Black Cobra Gang"], "LOCATION": ["Riverport"]})
    return [(r[0], r[2], r[3], r[6]) for r in extraction.relations_of(text, find(text))]


def test_relation_rules():
    assert rel("Ramesh transferred $5k to Akash via cash.") == [("Ramesh", "TRANSFERRED_FUNDS", "Akash", 5000.0)]
    assert rel("Rs 500 was paid to Akash by Ramesh.") == [("Ramesh", "TRANSFERRED_FUNDS", "Akash", 500.0)]
    assert rel("Akash received 2.5 lakh from Ramesh.") == [("Ramesh", "TRANSFERRED_FUNDS", "Akash", 250000.0)]
    assert rel("Ramesh gave a speech to Akash.") == [("Ramesh", "ASSOCIATED_WITH", "Akash", None)]
    assert rel("Ramesh called Akash.") == [("Ramesh", "CALLED", "Akash", None)]
    assert rel("Akash received a call from Ramesh.") == [("Ramesh", "CALLED", "Akash", None)]
    assert rel("Ramesh, Akash and Meera met at Riverport.") == [("Ramesh", "MET", "Akash", None), ("Ramesh", "MET", "Meera", None), ("Akash", "MET", "Meera", None)]
    assert rel("Ramesh attended a meeting in Riverport.") == [("Ramesh", "ATTENDED_MEETING_AT", "Riverport", None)]
    assert rel("Ramesh is the boss of Black Cobra Gang.") == [("Ramesh", "LEADS", "Black Cobra Gang", None)]
    assert rel("Black Cobra Gang is led by Meera.") == [("Meera", "LEADS", "Black Cobra Gang", None)]
    assert rel("Ramesh lives in Riverport.") == [("Ramesh", "LOCATED_AT", "Riverport", None)]
    paid = rel("Ramesh wired 700 to Akash from account AB123.")
    assert paid == [("Ramesh", "TRANSFERRED_FUNDS", "Akash", 700.0), ("Ramesh", "USES_ACCOUNT", "AB123", None), ("Akash", "USES_ACCOUNT", "AB123", None)]


def test_greedy_assignment_follows_the_order(spark):
    rows = spark.createDataFrame([(1, "John Doe"), (2, "Jon Doe"), (3, "Jane Roe"), (4, "John Doe"), (5, None)], "id int, name string")
    got = {r.id: r.canonical for r in resolution.greedy_canonical(rows, "id", "name", lambda a, b: names.compare(a, b)[0], 0.7).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1}


def test_questions_are_parsed():
    q = nlq.parse("Who is connected to P-0172?")
    assert (q.intent, q.entities, q.confidence) == ("entity_neighbors", ("P-0172",), 0.9)
    q = nlq.parse("Trace the money from CASE-0421 in the last 30 days")
    assert q.intent == "financial_flow" and q.window_days == 30 and "TRANSFERRED_TO" in q.relations
    q = nlq.parse("What happened after March 2024?")
    assert q.intent == "temporal_change" and (q.start, q.end) == ("2024-03-01 00:00:00", "2024-03-28 23:59:59")
    q = nlq.parse("hello")
    assert q.intent == "general_search" and q.confidence == 0.5 and len(q.notes) == 2
