"""License scan: ordered signature rules behind a keyword prefilter.

Rules are regexes built from a table of licenses and a few templates (SPDX tag, further identifiers of a
tag, "licensed under", title, address) and from a table of names without a version, in order of priority. A text is only matched against the rules of which it holds a keyword;
what a rule can match always holds one.
Of detections, one that lies inside a kept one of the same or a better priority is suppressed. The base
phrases are counted on words, as the contract says, and their labels always stay.

Defined results: a null or empty text has no words, no places, empty labels and score 0. Rows are judged
one by one: repeated rows alike, null ids like any, and an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import text_blocks

#: The contract's phrases and labels.
BASE = (
    (("gnu", "general", "public", "license"), "gpl"),
    (("apache", "license"), "apache"),
    (("cc", "by"), "cc-by"),
    (("mit", "license"), "mit"),
)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: SPDX identifier, keywords (every alternative of the title holds one), title regex, address.
LICENSES = (
    ("AGPL-3.0", "affero", r"(?:gnu )?affero general public licen[sc]e(?:,? v(?:ersion)? ?3(?:\.0)?)?", "gnu.org/licenses/agpl"),
    ("Apache-1.1", "apache", r"apache (?:software )?licen[sc]e,? v(?:ersion)? ?1\.1", "apache.org/licenses/license-1.1"),
    ("Apache-2.0", "apache", r"apache (?:software )?licen[sc]e,? v(?:ersion)? ?2(?:\.0)?", "apache.org/licenses/license-2.0"),
    ("APSL-2.0", "apple", r"apple public source licen[sc]e(?: 2\.0)?", "opensource.apple.com/apsl"),
    ("Artistic-2.0", "artistic", r"artistic licen[sc]e(?: 2\.0)?", "opensource.org/licenses/artistic-license"),
    ("BSD-2-Clause", "bsd", r"(?:simplified|2-clause|two-clause) bsd licen[sc]e|bsd 2-clause(?: licen[sc]e)?", "opensource.org/licenses/bsd-2-clause"),
    ("BSD-3-Clause", "bsd", r"(?:new|revised|modified|3-clause|three-clause) bsd licen[sc]e|bsd 3-clause(?: licen[sc]e)?", "opensource.org/licenses/bsd-3-clause"),
    ("BSL-1.0", "boost", r"boost software licen[sc]e(?:,? v(?:ersion)? ?1\.0)?", "boost.org/license_1_0"),
    ("BUSL-1.1", "business source", r"business source licen[sc]e(?: 1\.1)?", "mariadb.com/bsl11"),
    ("CC0-1.0", "cc0", r"cc0(?: 1\.0)?(?: universal)?", "creativecommons.org/publicdomain/zero"),
    ("CC-BY-4.0", "cc-by|cc by|creative commons", r"cc[- ]by[- ]4\.0|creative commons attribution 4\.0(?: international)?", "creativecommons.org/licenses/by/4.0"),
    ("CC-BY-3.0", "cc-by|cc by|creative commons", r"cc[- ]by[- ]3\.0|creative commons attribution 3\.0(?: unported)?", "creativecommons.org/licenses/by/3.0"),
    ("CC-BY-2.0", "cc-by|cc by|creative commons", r"cc[- ]by[- ]2\.0|creative commons attribution 2\.0", "creativecommons.org/licenses/by/2.0"),
    ("CC-BY-SA-4.0", "cc-by|cc by|creative commons", r"cc[- ]by[- ]sa[- ]4\.0|creative commons attribution[- ]share ?alike 4\.0", "creativecommons.org/licenses/by-sa/4.0"),
    ("CC-BY-SA-3.0", "cc-by|cc by|creative commons", r"cc[- ]by[- ]sa[- ]3\.0|creative commons attribution[- ]share ?alike 3\.0", "creativecommons.org/licenses/by-sa/3.0"),
    ("CC-BY-NC-4.0", "cc-by|cc by|creative commons", r"cc[- ]by[- ]nc[- ]4\.0|creative commons attribution[- ]non ?commercial 4\.0", "creativecommons.org/licenses/by-nc/4.0"),
    ("CC-BY-NC-3.0", "cc-by|cc by|creative commons", r"cc[- ]by[- ]nc[- ]3\.0|creative commons attribution[- ]non ?commercial 3\.0", "creativecommons.org/licenses/by-nc/3.0"),
    ("CC-BY-ND-4.0", "cc-by|cc by|creative commons", r"cc[- ]by[- ]nd[- ]4\.0|creative commons attribution[- ]no ?deriv(?:ative)?s 4\.0", "creativecommons.org/licenses/by-nd/4.0"),
    ("CC-BY-NC-SA-4.0", "cc-by|cc by|creative commons", r"cc[- ]by[- ]nc[- ]sa[- ]4\.0", "creativecommons.org/licenses/by-nc-sa/4.0"),
    ("CC-BY-NC-SA-3.0", "cc-by|cc by|creative commons", r"cc[- ]by[- ]nc[- ]sa[- ]3\.0", "creativecommons.org/licenses/by-nc-sa/3.0"),
    ("CC-BY-NC-ND-4.0", "cc-by|cc by|creative commons", r"cc[- ]by[- ]nc[- ]nd[- ]4\.0", "creativecommons.org/licenses/by-nc-nd/4.0"),
    ("CDDL-1.0", "cddl|common development", r"cddl(?:[- ]1\.0)?|common development and distribution licen[sc]e", "opensource.org/licenses/cddl-1.0"),
    ("CECILL-2.1", "cecill", r"cecill(?:[- ]2\.1)?(?: licen[sc]e)?", "cecill.info/licences"),
    ("CPL-1.0", "common public", r"common public licen[sc]e(?: 1\.0)?", "opensource.org/licenses/cpl1.0"),
    ("ECL-2.0", "educational", r"educational community licen[sc]e", "opensource.org/licenses/ecl-2.0"),
    ("EPL-1.0", "eclipse", r"eclipse public licen[sc]e(?: -)?,? v(?:ersion)? ?1\.0", "eclipse.org/legal/epl-v10"),
    ("EPL-2.0", "eclipse", r"eclipse public licen[sc]e(?: -)?,? v(?:ersion)? ?2\.0", "eclipse.org/legal/epl-2.0"),
    ("EUPL-1.2", "european union", r"european union public licen[sc]e(?:,? v(?:ersion)? ?1\.2)?", "joinup.ec.europa.eu/collection/eupl"),
    ("GFDL-1.3", "documentation", r"gnu free documentation licen[sc]e", "gnu.org/licenses/fdl"),
    ("GPL-2.0", "general public|gplv2|gpl v2", r"gnu general public licen[sc]e,? v(?:ersion)? ?2(?:\.0)?|gpl ?v2", "gnu.org/licenses/old-licenses/gpl-2.0"),
    ("GPL-3.0", "general public|gplv3|gpl v3", r"gnu general public licen[sc]e,? v(?:ersion)? ?3(?:\.0)?|gpl ?v3", "gnu.org/licenses/gpl-3.0"),
    ("HPND", "historical permission", r"historical permission notice and disclaimer", "opensource.org/licenses/hpnd"),
    ("IPL-1.0", "ibm", r"ibm public licen[sc]e(?: 1\.0)?", "opensource.org/licenses/ipl-1.0"),
    ("ISC", "isc", r"isc licen[sc]e", "opensource.org/licenses/isc"),
    ("LGPL-2.1", "lesser", r"gnu lesser general public licen[sc]e,? v(?:ersion)? ?2\.1", "gnu.org/licenses/old-licenses/lgpl-2.1"),
    ("LGPL-3.0", "lesser", r"gnu lesser general public licen[sc]e,? v(?:ersion)? ?3(?:\.0)?", "gnu.org/licenses/lgpl-3.0"),
    ("LPPL-1.3c", "latex", r"latex project public licen[sc]e", "latex-project.org/lppl"),
    ("MIT", "mit", r"mit licen[sc]e", "opensource.org/licenses/mit"),
    ("MPL-1.1", "mozilla", r"mozilla public licen[sc]e,? v(?:ersion)?\.? ?1\.1", "mozilla.org/mpl/1.1"),
    ("MPL-2.0", "mozilla", r"mozilla public licen[sc]e,? v(?:ersion)?\.? ?2\.0", "mozilla.org/mpl/2.0"),
    ("MS-PL", "microsoft|ms-pl", r"microsoft public licen[sc]e|ms-pl", "opensource.org/licenses/ms-pl"),
    ("MS-RL", "microsoft|ms-rl", r"microsoft reciprocal licen[sc]e|ms-rl", "opensource.org/licenses/ms-rl"),
    ("MulanPSL-2.0", "mulan", r"mulan p(?:ermissive )?s(?:oftware )?l(?:icen[sc]e)?(?:,? v(?:ersion)? ?2)?", "license.coscl.org.cn/mulanpsl2"),
    ("NCSA", "illinois", r"university of illinois/?n?c?s?a? open source licen[sc]e", "opensource.org/licenses/ncsa"),
    ("ODbL-1.0", "database", r"open (?:data commons open )?database licen[sc]e", "opendatacommons.org/licenses/odbl"),
    ("OFL-1.1", "font", r"sil open font licen[sc]e(?:,? v(?:ersion)? ?1\.1)?", "scripts.sil.org/ofl"),
    ("OSL-3.0", "open software", r"open software licen[sc]e(?:,? v(?:ersion)?\.? ?3\.0)?", "opensource.org/licenses/osl-3.0"),
    ("PDDL-1.0", "public domain", r"public domain dedication and licen[sc]e", "opendatacommons.org/licenses/pddl"),
    ("PostgreSQL", "postgresql", r"postgresql licen[sc]e", "opensource.org/licenses/postgresql"),
    ("PSF-2.0", "python", r"python software foundation licen[sc]e(?:,? v(?:ersion)? ?2)?", "docs.python.org/license"),
    ("QPL-1.0", "q public", r"q public licen[sc]e", "opensource.org/licenses/qpl-1.0"),
    ("SSPL-1.0", "server side", r"server side public licen[sc]e", "mongodb.com/licensing/server-side-public-license"),
    ("Unlicense", "unlicense", r"(?:the )?unlicense", "unlicense.org"),
    ("UPL-1.0", "universal permissive", r"universal permissive licen[sc]e", "opensource.org/licenses/upl"),
    ("W3C", "w3c", r"w3c software(?: notice)?(?: and)? licen[sc]e", "w3.org/consortium/legal"),
    ("WTFPL", "wtfpl|you want to public", r"wtfpl|do what the f\w+ you want to public licen[sc]e", "wtfpl.net"),
    ("X11", "x11", r"x11 licen[sc]e", "opensource.org/licenses/x11"),
    ("Zlib", "zlib", r"zlib licen[sc]e", "opensource.org/licenses/zlib"),
    ("ZPL-2.1", "zope", r"zope public licen[sc]e(?:,? v(?:ersion)? ?2\.1)?", "opensource.org/licenses/zpl-2.1"),
)
#: Label, keywords, title regex of names without a version; a full name that holds one wins.
FAMILIES = (
    ("apache", "apache", r"apache (?:software )?licen[sc]e"),
    ("bsd", "bsd", r"bsd(?:-style)? licen[sc]e"),
    ("cc-by", "creative commons", r"creative commons attribution(?![- ](?:share|non|no ?deriv))"),
    ("cc-by-sa", "creative commons", r"creative commons attribution[- ]share ?alike"),
    ("cc-by-nc", "creative commons", r"creative commons attribution[- ]non ?commercial(?![- ](?:share|no ?deriv))"),
    ("cc-by-nd", "creative commons", r"creative commons attribution[- ]no ?deriv(?:ative)?s"),
    ("cc-by-nc-sa", "creative commons", r"creative commons attribution[- ]non ?commercial[- ]share ?alike"),
    ("cc-by-nc-nd", "creative commons", r"creative commons attribution[- ]non ?commercial[- ]no ?deriv(?:ative)?s"),
    ("epl", "eclipse", r"eclipse public licen[sc]e"),
    ("gpl", "general public", r"gnu general public licen[sc]e"),
    ("lgpl", "lesser", r"gnu lesser general public licen[sc]e"),
    ("mpl", "mozilla", r"mozilla public licen[sc]e"),
)
#: name, priority (less is better), how sure one match is.
TEMPLATES = (("tag", 0, 0.95), ("also", 0, 0.95), ("grant", 1, 0.9), ("title", 2, 0.7), ("address", 3, 0.6))
FAMILY_TEMPLATES = (("grant", 4, 0.8), ("title", 4, 0.5))
BASE_SURE = 0.6
GRANT = r"(?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?"


@cache
def rules() -> tuple[tuple[str, str, tuple[str, ...], int, float, re.Pattern], ...]:
    """(rule, label, keywords, priority, confidence, regex) in order of priority."""
    out = []
    for spdx, words, title, address in LICENSES:
        keywords = tuple(words.split("|"))
        bodies = {
            "tag": ((spdx.lower(),), rf"spdx-license-identifier:\s*\(*{re.escape(spdx.lower())}(?:-only|-or-later)?(?![\w.-]*\w)"),
            "also": ((spdx.lower(),), rf"spdx-license-identifier:\s*(?:\(*[\w.+-]+\)* (?:or|and|with) )+\(*(?P<id>{re.escape(spdx.lower())}(?:-only|-or-later)?)(?![\w.-]*\w)"),
            "grant": (keywords, rf"{GRANT}(?:{title})(?!\w)"),
            "title": (keywords, rf"(?<!\w)(?:{title})(?!\w)"),
            "address": ((address,), rf"(?:https?://)?(?:www\.)?{re.escape(address)}[\w./-]*"),
        }
        for name, priority, sure in TEMPLATES:
            key, body = bodies[name]
            out.append((f"{spdx.lower()}:{name}", spdx.lower(), key, priority, sure, re.compile(body)))
    for label, words, title in FAMILIES:
        bodies = {"grant": rf"{GRANT}(?:{title})(?!\w)", "title": rf"(?<!\w)(?:{title})(?!\w)"}
        out += [(f"{label}:{name}", label, tuple(words.split("|")), priority, sure, re.compile(bodies[name])) for name, priority, sure in FAMILY_TEMPLATES]
    return tuple(sorted(out, key=lambda r: (r[3], r[0])))


@cache
def _gates() -> tuple[tuple[tuple[str, ...], tuple], ...]:
    by: dict[tuple, list] = {}
    for r in rules():
        by.setdefault(r[2], []).append(r)
    return tuple((k, tuple(v)) for k, v in by.items())


def suppressed(found: list[tuple]) -> list[tuple]:
    """The detections that lie in no other of better priority, or of the same and longer (then earlier, then first by rule).

    A tree over the starts holds the farthest end of the kept ones that begin at or before each.
    """
    starts = sorted({d[0] for d in found})
    far = [0] * (len(starts) + 1)
    kept = []
    for d in sorted(found, key=lambda d: (d[4], d[0] - d[1], d[0], d[3])):
        place = bisect_right(starts, d[0])
        end, i = 0, place
        while i:
            end = max(end, far[i])
            i &= i - 1
        if end < d[1]:
            kept.append(d)
            i = place
            while i < len(far):
                far[i] = max(far[i], d[1])
                i += i & -i
    return kept


def detections(lowered: str) -> list[tuple[int, int, str, str, int, float]]:
    """(start, end, label, rule, priority, confidence) in characters, after suppression.

    Rules see each run of white space as one space; places are those of the text itself.
    """
    flat, found = " ".join(lowered.split()), []
    for keywords, group in _gates():
        if any(k in flat for k in keywords):
            for rule, label, _, priority, sure, regex in group:
                part = "id" if "id" in regex.groupindex else 0
                found += [(*m.span(part), label, rule, priority, sure) for m in regex.finditer(flat)]
    if not found:
        return []
    kept = suppressed(found)
    if len(flat) < len(lowered):
        words = [(m.start(), m.end()) for m in re.finditer(r"\S+", lowered)]
        starts = list(accumulate((b - a + 1 for a, b in words), initial=0))

        def place(x: int) -> int:
            i = bisect_right(starts, x) - 1
            return words[i][0] + x - starts[i]

        kept = [(place(d[0]), place(d[1] - 1) + 1, *d[2:]) for d in kept]
    return sorted(kept)


def base_places(lowered: str) -> list[tuple[int, str]]:
    """(first word's number, label) of each place where a base phrase's words follow one another."""
    if not any(all(w in lowered for w in phrase) for phrase, _ in BASE):
        return []
    words = WORD.findall(lowered)
    firsts = {phrase[0]: (phrase, label) for phrase, label in BASE}
    out = []
    for i, w in enumerate(words):
        if w in firsts:
            phrase, label = firsts[w]
            if tuple(words[i : i + len(phrase)]) == phrase:
                out.append((i, label))
    return out


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORD_BYTE = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
SPAN = "array<struct<start:int,end:int,label:string,rule:string,priority:int,confidence:double>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, column = batch.column(0), batch.column(1)
        for a, b, data, offsets in text_blocks(column):
            is_word = _WORD_BYTE[data]
            begins = is_word.copy()
            begins[1:] &= ~is_word[:-1]
            cuts = offsets[:-1][offsets[:-1] < len(data)]
            begins[cuts] = is_word[cuts]
            counts = np.diff(np.concatenate([[0], np.cumsum(begins)])[offsets])
            lowered = data.tobytes().translate(_LOWER)
            places, spans = [], []
            for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                t = lowered[x:y].decode()
                places.append([{"word": i, "label": label} for i, label in base_places(t)])
                spans.append([dict(zip(("start", "end", "label", "rule", "priority", "confidence"), d, strict=True)) for d in detections(t)])
            arrays = [key.slice(a, b - a), pa.array(counts, pa.int64()), pa.array(places, pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("rule", pa.string()), ("priority", pa.int32()), ("confidence", pa.float64())])))]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "n_words", "places", "spans"])


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_words, places (base phrases by word), spans (detections by character). Narrow, one pass."""
    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(_scan, f"key {kind}, n_words bigint, places array<struct<word:bigint,label:string>>, spans {SPAN}")
    return out.withColumnRenamed("key", key) if key != "key" else out


def summary(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: counts, labels and a score, 1 - product of (1 - confidence) over distinct rules."""
    found = scan(docs, text, key)
    base = F.array_distinct(F.transform("places", lambda p: p["label"]))
    own = F.array_distinct(F.transform("spans", lambda s: s["label"]))
    sure = F.array_distinct(F.transform("spans", lambda s: F.struct(s["rule"], s["confidence"].alias("c"))))
    doubt = F.aggregate(sure, F.when(F.size(base) > 0, F.lit(1 - BASE_SURE)).otherwise(F.lit(1.0)), lambda a, s: a * (1 - s["c"]))
    words = F.transform("places", lambda p: p["word"])
    return found.select(
        key, "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        F.array_join(F.sort_array(base), ",").alias("base_labels"), F.array_join(F.sort_array(F.array_union(base, own)), ",").alias("labels"), F.round(1 - doubt, 6).alias("score"), "spans",
    )
