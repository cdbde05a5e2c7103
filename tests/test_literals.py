"""Required literals: whatever a pattern matches holds one of them."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.functions.literals import required_literals
from tracewright.lookups import EXCLUDE_TERMS, FORBIDDEN_PATTERNS, REVIEW_TERMS
from tracewright.operators.screening import matched_terms

atoms = st.sampled_from(["a", "b", "c", "ab", "bc", ".", "[ab]", "[^a]", "[a-c]", r"\b", "^", "$", r"\w", "(?:ab|c)", "(a|b|)", "(?=a)", "(?!b)"])
pieces = st.builds(lambda a, q: a if a in ("^", "$", r"\b") else f"(?:{a}){q}", atoms, st.sampled_from(["", "", "", "?", "*", "+", "{2}", "{0,2}", "+?", "{1,3}"]))
sequences = st.lists(pieces, min_size=1, max_size=5).map("".join)
patterns = st.recursive(sequences, lambda p: st.one_of(st.builds("{}|{}".format, p, p), st.builds("(?:{}){}".format, p, sequences)), max_leaves=4)


@settings(max_examples=1500, deadline=None)
@given(patterns, st.lists(st.text("abc d", max_size=12), min_size=1, max_size=6))
def test_every_match_holds_a_literal(pattern, texts):
    literals = required_literals(pattern)
    if literals is not None:
        assert all(literals)
        for text in texts:
            for match in re.finditer(pattern, text):
                assert any(x in match.group() for x in literals)
            if re.search(pattern, text):
                assert any(x in text for x in literals)


@pytest.mark.parametrize("pattern,literals", [
    ("abc", ("abc",)), (r"\babc\b|x.long", ("abc", "long")), ("a.bcd.e", ("bcd",)), ("ab?", ("a",)), ("(?:ab)+c?", ("ab",)), ("a*", None), ("x|", None), ("[ab]c", ("ac", "bc")),
    ("gr[ae]y", ("gray", "grey")), (r"\bab(c|de)\b", ("abc", "abde")), ("(?i)abc", None), ("(?i:abc)d", ("d",)), ("[^a]bc", ("bc",)), ("a(?=b)c", ("ac",)), ("(", None), (r"h\d{3}_", ("h",)),
])
def test_chosen_literals(pattern, literals):
    assert required_literals(pattern) == literals


def test_terms_of_the_library_have_literals():
    assert all(required_literals(p) for p in (*EXCLUDE_TERMS, *REVIEW_TERMS, *FORBIDDEN_PATTERNS))


def test_matched_terms_equal_the_patterns(spark):
    texts = ["", None, "an attack on c2", "command and control of the cve-2024", "accesses", "capture the flag", "h123_ benign-x", "battack", "ids, ips", "secured xattack auth"]
    terms = (*EXCLUDE_TERMS, *REVIEW_TERMS, *FORBIDDEN_PATTERNS, "x*", "a|")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.m for r in df.select("i", matched_terms(df.t, terms).alias("m")).collect()}
    assert got == {i: None if t is None else sorted(p for p in terms if re.search(p, t)) for i, t in enumerate(texts)}
