"""Operators that learn: held-out accuracy on the labelled table, and defined results for odd texts."""

import re
from collections import defaultdict
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from keystrata.llm.language import LanguageModel, fit_languages, language_segments, mislabelled
from keystrata.llm.sentences import BoundaryModel, Layout, Places, laid_out, paragraphs, runs_of, sentence_units, split_units

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def labelled():
    if not DATA.exists():
        pytest.skip("no test data")
    out = defaultdict(list)
    for r in pq.read_table(DATA / "multilingual_corpus.parquet").to_pylist():
        out[r["language"]].append(r["text"])
    return dict(out)


def test_held_out_languages(labelled):
    model = LanguageModel({k: v[::2] for k, v in labelled.items()})
    held = [(k, t) for k, v in labelled.items() for t in v[1::2]]
    right = sum(model.classify(t)[0] == k for k, t in held)
    assert right / len(held) >= 0.97
    assert model.classify("12345 !!")[0] is None and model.classify("")[0] is None


def test_lookalike_letters_keep_the_language(labelled):
    model = LanguageModel(labelled)
    assert model.classify("Thе оrchard cooperative stоres ѕtale replicas")[0] == "en"


ENTRIES = [("en", "abbreviation", "approx"), ("en", "abbreviation", "dr"), ("en", "title", "dr"), ("en", "starter", "The"), ("en", "going on", "asked"), ("en", "abbreviation", "a.m"), ("en", "ending", "a.m"), ("zh", "going on", "问道"), ("ja", "going on", "と")]


def language(piece):
    return next((x for x, lo, hi in (("th", "฀", "๿"), ("ja", "぀", "ヿ"), ("zh", "一", "鿿")) if any(lo <= c <= hi for c in piece)), "en")


@pytest.mark.parametrize(
    "text, units",
    [
        ("It costs approx. 5.50 km from Dr. Smith. The end? Yes!", ["It costs approx. 5.50 km from Dr. Smith.", "The end?", "Yes!"]),
        ("At 9 a.m. The gates closed.", ["At 9 a.m.", "The gates closed."]),
        ("“One. Two?” asked J. Doe. “Three.” Four.", ["“One. Two?” asked J. Doe.", "“Three.”", "Four."]),
        ("A Heading\n\nBroken\nline.Next one (in brackets.) goes on.", ["A Heading", "Broken\nline.", "Next one (in brackets.) goes on."]),
        ("See docs.site.example/a.html and v4.3.12... it works", ["See docs.site.example/a.html and v4.3.12... it works"]),
        ("他来了。“你好。”问道", ["他来了。", "“你好。”问道"]),
        ("「彼は来た。雨だ。」と言った。次だ。", ["「彼は来た。雨だ。」と言った。", "次だ。"]),
        ("ตู้ข้อมูลใหม่ Kelvora Feedของเรา สมุด", ["ตู้ข้อมูลใหม่", "Kelvora Feedของเรา", "สมุด"]),
        ("", []),
        (" \n\n ", []),
    ],
)
def test_units(text, units):
    layout = Layout(text)
    found = [text[b:e] for b, e, _ in split_units(layout, BoundaryModel(ENTRIES), [language(x) for x in layout.strings()])]
    assert found == units
    assert "".join("".join(found).split()) == "".join(text.split())


def test_marks_in_great_number_take_linear_time():
    for c in "“„«(‘\"":
        assert len(Places(c * 50_000 + ".").text) == 50_001
    assert list(paragraphs("a\r\n\r\nb"))[1] == (5, 6)


def test_counts_go_to_the_language_they_are_in(spark, labelled):
    from keystrata.llm.sentences import boundaries

    en, fr, ru = (" ".join(labelled[x]).replace("\n", " ") for x in ("en", "fr", "ru"))
    text = f"{en[:900]}. {fr} {ru}"
    model = LanguageModel(labelled)
    ((_, layout, _, _, names),) = laid_out([text], model)
    runs = runs_of(layout.pieces, names)
    assert [x for _, _, x in runs] == ["en", "fr", "ru"] and runs[0][0] == 0 and runs[-1][1] == len(text)
    assert all(x[1] == y[0] for x, y in zip(runs, runs[1:]))
    texts = spark.createDataFrame([(f"{en[:900]}. {fr} " + "Le plan zq. grand. " * 40,)], "t string")
    found = boundaries(texts, spark.sparkContext.broadcast((labelled, model))).where("part = 'abbreviation'").collect()
    assert {r["language"] for r in found if r["word"] == "zq"} == {"fr"}


@pytest.mark.parametrize("a, b", [("pt", "es"), ("es", "pt"), ("it", "es"), ("lt", "pl"), ("en", "fr"), ("ja", "zh")])
def test_one_sentence_of_another_language(labelled, a, b):
    """Held-out texts with a sentence of another language first, within, and last."""
    model = LanguageModel({k: v[::2] for k, v in labelled.items()})
    rest = lambda x: [p for t in labelled[x][1::2] for p in re.split(r"(?<=[.!?。])\s*", t) if len(p) > 25]
    own, others = rest(a), rest(b)
    right = n = 0
    for i, other in enumerate(others[:12]):
        for at in (0, 2, 4):
            parts = [own[(i + k) % len(own)] for k in range(4)]
            parts.insert(at, other)
            n += 5
            right += sum(x == (b if k == at else a) for k, (x, _) in enumerate(model.decide(*model.sums(parts))))
    assert right / n >= 0.95


def test_wrong_labels_do_not_spoil_the_fit(labelled):
    held = {k: v[10:] for k, v in labelled.items()}
    sample = [(k, " ".join(v[i : i + 3])) for k, v in held.items() for i in range(6)] + [("es", " ".join(held["pt"][i : i + 3])) for i in range(4)]
    model = fit_languages({k: v[:10] for k, v in labelled.items()}, sample)
    assert all(model.classify(t)[0] == "pt" for t in held["pt"])
    assert model.classify("Glali")[1] <= 1 and model.decide(*model.sums([])) == []


def test_a_model_beyond_its_bound_gives_the_same_units(spark, labelled, monkeypatch):
    from keystrata.llm import sentences

    corpus = spark.createDataFrame([(k, t) for k, v in labelled.items() for t in v], "language string, text string")
    df = spark.createDataFrame([(f"{k}{i}", t + " " + v[i - 1], k, 1) for k, v in labelled.items() for i, t in enumerate(v)], "id string, body string, language string, arrived_at int")
    one = {tuple(r) for r in sentence_units(df, corpus).collect()}
    monkeypatch.setattr(sentences, "MAX_ENTRIES", 3)
    assert {tuple(r) for r in sentence_units(df, corpus).collect()} == one


def test_addresses_of_any_length():
    text = "See www.site.example/" + "a" * 500 + ".Html and more."
    layout = Layout(text)
    assert len(split_units(layout, BoundaryModel(ENTRIES), ["en"] * len(layout.pieces))) == 1


def test_tables_with_nulls_repeats_and_clashes(spark, labelled):
    corpus = spark.createDataFrame([(k, t, "x") for k, v in labelled.items() for t in v], "language string, text string, id string")
    en, fr = labelled["en"][0], labelled["fr"][0]
    rows = [("a", en, "en", 1), ("a", en, "en", 2), ("b", en, "fr-FR", 1), ("c", None, "en", 1), ("d", "", None, 1), ("e", " ", None, 1), (None, en, "en", 1), ("f", f"{en}\n\n{fr}", "en", 1), ("g", fr, None, 1), ("h", en + "\n\n" + (fr + " ") * 200, "EN", 1)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id string, body string, language string, arrived_at int, unit string")
    segments = language_segments(df, corpus)
    found = sorted((r["id"], r["begin_at"], r["lang"]) for r in mislabelled(segments).collect())
    assert found == [("b", 0, "en"), ("f", 0, "en"), ("f", len(en) + 2, "fr"), ("g", 0, "fr"), ("h", 0, "en"), ("h", len(en) + 2, "fr")]
    assert all(0 <= r["confidence"] <= 1 for r in segments.collect())
    units = sentence_units(df, corpus).collect()
    assert {r["id"] for r in units} == {"a", "b", "f", "g", "h"}
    body = dict((r[0], r[1]) for r in rows)
    for key in ("a", "f", "h"):
        mine = sorted((r["unit"], r["begin_at"], r["end_at"]) for r in units if r["id"] == key)
        assert [u for u, _, _ in mine] == list(range(len(mine)))
        assert "".join(body[key][b:e] for _, b, e in mine).replace(" ", "") == "".join(body[key].split())
    assert sentence_units(df.limit(0), corpus).count() == 0 and language_segments(df.limit(0), corpus).count() == 0
