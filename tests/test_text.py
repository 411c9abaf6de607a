import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keystrata.functions.output import highlight, number, stable_json
from keystrata.functions.similarity import jaro, levenshtein, levs, seqm
from keystrata.functions.text import pre_filter, sentence_tokens, split_sentences, tokenize
from keystrata.options import Options


@pytest.mark.parametrize(
    "text, tokens",
    [
        ("Dr. Smith met the U.S. team.", ["Dr.", "Smith", "met", "the", "U.S.", "team", "."]),
        ("Wait...", ["Wait", "..."]),
        ("See (a.)", ["See", "(", "a", ".", ")"]),
        ("He said [wow.].", ["He", "said", "[", "wow.", "]", "."]),
        ("don't", ["do", "n't"]),
    ],
)
def test_tokens(text, tokens):
    assert tokenize(text) == tokens


@pytest.mark.parametrize("text, n", [("Wait... what happened? Really...", 3), ("«Bonjour.» Ensuite.", 1), ("Dra. Maria escreveu. Outra frase.", 3), ("3.9 is no. 1! Yes.", 2), ("", 0)])
def test_sentences(text, n):
    assert len(split_sentences(pre_filter(text))) == n


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_any_text_is_tokenized(text):
    assert all(t for s in sentence_tokens(text) for t in s)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=12), st.text(max_size=12))
def test_similarities_are_symmetric_shares(a, b):
    for f in (levs, jaro, seqm):
        assert 0 <= f(a, b) <= 1 and abs(f(a, b) - f(b, a)) < 1e-12 and f(a, a) == 1


def test_similarity_vectors():
    assert [round(jaro(*p), 10) for p in (("MARTHA", "MARHTA"), ("DIXON", "DICKSONX"), ("JELLYFISH", "SMELLYFISH"), ("CRATE", "TRACE"), ("", ""), ("", "abc"))] == [0.9444444444, 0.7666666667, 0.8962962963, 0.7333333333, 1, 0]
    assert [levenshtein(*p) for p in (("hello", "helo"), ("abc", "xyz"), ("a", "abcdefghij"), ("kitten", "sitting"))] == [1, 3, 9, 3]
    pairs = (("abc", "abx"), ("abcd", "abxd"), ("abcde", "abxde"), ("alpha beta", "alpha gamma"), ("alpha beta", "alpha beta gamma"), ("agent swarms", "agents"))
    assert [round(seqm(*p), 5) for p in pairs] == [0.5, 0.6, 0.43333, 0.52657, 0.66667, 0.40636]


def test_output():
    assert stable_json({"b": 1.0, "a": [2.18e-05, "x"], "none": None}) == '{"a":[0.0000218,"x"],"b":1}'
    assert number(1e-7) == "0.0000001" and number(0.25) == "0.25"
    assert highlight("Deep learning, deep Learnings.", ["deep learning", "Deep", "learning"]) == "<mark>Deep learning</mark>, <mark>deep</mark> Learnings."
    assert highlight("ab cd", [("ab", 0.1), {"keyword": "cd"}, None, ""], before="[", after="]") == "[ab] [cd]"
    assert highlight("one two one", ["two one", "one two"], before="[", after="]") == "one [two one]"
    assert highlight("one two one", ["one two", "two one"], before="[", after="]") == "[one two] one"
    assert highlight(None, ["a"]) is None and highlight("a b", []) == "a b"


@pytest.mark.parametrize("bad", [{"n": 0}, {"top": 1.5}, {"window": True}, {"dedup_lim": -1}, {"dedup_lim": float("nan")}, {"dedup_func": "wat"}, {"features": ["x"]}, {"windowSize": 1}])
def test_options_reject(bad):
    with pytest.raises(ValueError, match=next(iter(bad))):
        Options.parse(**bad)
