"""Every rule opens by its own matches."""

from re import _parser

import pytest

from framelake.llm import licenses
from framelake.llm.license_rules import rules


def example(parsed, most):
    """A match with as few or as many optional parts as there can be, and the first or last of alternatives."""
    out = ""
    for op, v in parsed:
        match str(op):
            case "LITERAL":
                out += chr(v)
            case "ANY":
                out += "."
            case "IN":
                out += chr(v[-most][1])
            case "SUBPATTERN":
                out += example(v[3], most)
            case "BRANCH":
                out += example(v[1][-most], most)
            case "MAX_REPEAT":
                out += example(v[2], most) * (min(v[1], 3) if most else v[0])
    return out


@pytest.mark.parametrize("most", [0, 1])
def test_examples_open(most):
    for i, r in enumerate(rules()):
        text = example(_parser.parse(r.regex.pattern.removeprefix("(?<![a-z0-9])").removesuffix("(?![a-z0-9])")), most)
        assert r.regex.search(text), (text, r)
        assert i in licenses.opened(text), (text, r)


@pytest.mark.parametrize("text", ["mpl 2.0", "mpl-1.1", "epl-2.0", "eclipse.org/legal/epl-2.0", "cpl-1.0", "bsl-1.0", "scripts.sil.org/ofl", "ofl-1.1", "bigscience rail-m", "open data\ncommons attribution license", "open data commons  public domain dedication", "asl 2.0"])
def test_short_mentions(text):
    assert licenses.detections(text, licenses.opened(text))
