"""The keyword gate of the license scan loses no match of a rule's regex."""

import re
from itertools import product

from quern.llm import license_scan


def texts(parsed):
    """A text for each way through a parsed regex; repeats at their least and, up to three, their most."""
    out = [""]
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            new = [chr(arg)]
        elif op == "IN":
            new = ["1" if str(o) == "CATEGORY" else chr(v[0] if str(o) == "RANGE" else v) if str(o) != "NEGATE" else "x" for o, v in arg]
            new = ["x"] if str(arg[0][0]) == "NEGATE" else new
        elif op in ("NOT_LITERAL", "ANY"):
            new = ["x"]
        elif op == "SUBPATTERN":
            new = texts(arg[3])
        elif op == "BRANCH":
            new = [t for b in arg[1] for t in texts(b)]
        elif op == "MAX_REPEAT":
            lo, hi, body = arg
            new = [t * n for n in ({lo, hi} if int(hi) <= 4 else {lo, lo + 1}) for t in texts(body)]
        else:
            raise ValueError(op)
        out = [a + b for a, b in product(out, dict.fromkeys(new))]
    return out


def test_keywords_are_in_every_match():
    for _, _, keyword, label, regex in license_scan.rules():
        for t in texts(re._parser.parse(regex)):
            if t == " ".join(t.split()):  # words parted by single blanks
                assert re.fullmatch(regex, t), (regex, t)
                assert keyword in t and any(r in t for r in license_scan.ROOTS), (label, t)


def test_spellings_are_found(spark):
    rows = [(0, "See the license file for details", "licensed"), (1, "open rail m license", "openrail"), (2, "Licence Ouverte 2.0", "etalab-2"), (3, "the Open Database Licence", "odbl-1.0"), (4, "see license", "licensed")]
    got = license_scan.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["labels"] for r in got} == {i: label for i, _, label in rows}
