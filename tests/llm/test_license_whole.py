"""The license scan: every alternative of every rule is detected where it stands alone."""

import re._parser as parser
from itertools import product

import pytest

from linkloom.llm import license_scan


def examples(pattern):
    """Texts for each way through a regex; classes and repeats by their first and least choices, options both ways."""
    tree = parser.parse(pattern) if isinstance(pattern, str) else pattern
    parts = []
    for op, x in tree:
        op = str(op)
        if op == "LITERAL":
            parts.append([chr(x)])
        elif op == "IN":
            parts.append([chr(v) if str(o) == "LITERAL" else "x" for o, v in x][:2])
        elif op == "BRANCH":
            parts.append([e for b in x[1] for e in examples(b)])
        elif op == "SUBPATTERN":
            parts.append(examples(x[3]))
        elif op == "MAX_REPEAT":
            low, high, what = x
            parts.append([""] * (low == 0) + (examples(what) if high else []))
        else:
            raise ValueError(op)
    return ["".join(p) for p in product(*parts)]


@pytest.mark.parametrize("license", license_scan.LICENSES, ids=lambda r: r[0])
def test_each_alternative_alone(license):
    label, _, title, address = license
    for text in [*examples(title), f"https://{address}", f"spdx-license-identifier: {label.lower()}"]:
        for whole in (text, f"released under the {text}."):
            assert label.lower() in {d[2] for d in license_scan.detections(whole)}, whole


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("see the gnu lesser general\n  public license v3 ", {"lgpl-3.0"}),
        ("bsd license", {"bsd"}),
        ("gnu lesser general public license", {"lgpl"}),
        ("creative commons attribution", {"cc-by"}),
        ("creative commons attribution-noncommercial", {"cc-by-nc"}),
        ("new bsd license", {"bsd-3-clause"}),
        ("creative commons attribution 4.0", {"cc-by-4.0"}),
        ("spdx-license-identifier: mit or apache-2.0", {"mit", "apache-2.0"}),
        ("spdx-license-identifier: (mit and bsd-3-clause) or\tgpl-2.0-only", {"mit", "bsd-3-clause", "gpl-2.0"}),
        ("spdx-license-identifier: mit", {"mit"}),
    ],
)
def test_wrapped_unversioned_and_compound(text, labels):
    assert {d[2] for d in license_scan.detections(text)} == labels


def test_spans_are_places_of_the_text():
    text = " \n the  gnu lesser general\n\t public  license v3, then\r\n mit\nlicense"
    assert [text[d[0] : d[1]] for d in license_scan.detections(text)] == ["gnu lesser general\n\t public  license v3", "mit\nlicense"]
