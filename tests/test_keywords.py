import pytest

from keystrata.api import KeywordExtractor, compact_keywords, extract, extract_details, extract_from_document, extract_keywords, serialized, serialized_bytes
from keystrata.operators.document import Document, deduplicated, in_order
from keystrata.operators.keywords import Extraction, documents
from keystrata.options import Options
from keystrata.sources import stopwords

#: The stopwords that occur in the cases below.
LISTS = {"en": "a am and are data's for from in is it of on that the to us was tell", "de": "und sind", "pt": "me"}
LISTS_OF_WORDS = {k: v.split() for k, v in LISTS.items()}
CASES = [
    ("Google is acquiring data science community Kaggle. Sources tell us that Google is acquiring Kaggle, a platform that hosts data science and machine learning competitions.", dict(top=10),
     [("science community Kaggle", 0.022868570857866734), ("community Kaggle", 0.047789707710865825), ("data science community", 0.06339941399255053), ("Google is acquiring", 0.06585622388814175), ("acquiring Kaggle", 0.07431205283498787), ("Kaggle", 0.0848594527055433), ("data science", 0.099599852153925), ("acquiring data science", 0.10626939210345991), ("science community", 0.12300103596901649), ("Google", 0.14277827942739202)]),
    ("data science and machine learning", dict(n=2, top=5, window=2),
     [("data science", 0.04940384002065631), ("machine learning", 0.04940384002065631), ("data", 0.15831692877998726), ("learning", 0.15831692877998726), ("science", 0.29736558256021506)]),
    ("machine learning machine learning deep learning", dict(n=2, top=5, dedup_lim=1.0),
     [("machine learning", 0.023072402583411963), ("learning deep", 0.041166451867834804), ("deep learning", 0.041166451867834804), ("learning machine", 0.04614480516682393), ("learning", 0.08154106429019745)]),
    ("Python 3.9+ is great! #programming @developer", dict(n=1, top=5),
     [("Python", 0.05899937629682816), ("programming", 0.17881754828257995), ("developer", 0.17881754828257995), ("great", 0.2005079697193566)]),
    ("Maschinelles Lernen und künstliche Intelligenz sind wichtige Technologien", dict(n=2, top=5, language="de"),
     [("Maschinelles Lernen", 0.023458380875189744), ("wichtige Technologien", 0.026233073037508336), ("künstliche Intelligenz", 0.04498862876540802), ("Technologien", 0.08596317751626563), ("Lernen", 0.1447773057422032)]),
    ("alpha and beta and gamma", dict(n=2, top=10), [("alpha", 0.09568045026443411), ("gamma", 0.09568045026443411), ("beta", 0.15831692877998726)]),
]


@pytest.fixture(scope="module")
def lists(spark):
    return stopwords.from_dict(spark, {k: v.split() for k, v in LISTS.items()}).cache()


@pytest.mark.parametrize("text, options, expected", CASES)
def test_cases(spark, lists, text, options, expected):
    found = extract_keywords(text, lists, **({"language": "en"} | options))
    assert [k for k, _ in found] == [k for k, _ in expected]
    assert [s for _, s in found] == pytest.approx([s for _, s in expected], abs=1e-12)


def test_empty(spark, lists):
    assert extract("", lists) == [] and extract(None, lists) == [] and extract(" \n\t", LISTS_OF_WORDS) == []
    assert extract_keywords("the a it is", lists, language="en") == []


AWKWARD = [
    ("a", "Dr. Smith met the U.S. team. They weren't late!\n\nThe ferry of Smith and sons is not here: 3.9 km, v2 ferries.", "en"),
    ("b", "“Das Archiv und die Fähre,” sagte Größe. Das Archiv\nder Fähre der Nacht.", "de-AT"), ("c", "Архив переправы и станции. Архив НАСА в ночи на станции!", "RU"),
    ("d", "他来了。雨だ。 词 词", "zh"), ("e", None, "en"), ("f", "", None), ("g", " \n\t ", "en"), ("h", "the a of", "en"),
    ("i", "Ferry night archive and ferry night " * 500 + ". End.", None), ("j", "Google Kaggle data science of data science for Google Kaggle", "en"), (None, "delta epsilon", "xx"),
]


@pytest.mark.parametrize("options", [{}, dict(n=2, dedup_func="levs", dedup_lim=0.8), dict(window=2, features=("wfreq", "wpos"), top=5), dict(dedup_lim=1.0, n=4, top=50)])
def test_both_paths_give_the_same(spark, lists, options):
    df = spark.createDataFrame([(*r, "clash") for r in AWKWARD], "id string, body string, language string, term string")
    one = KeywordExtractor(lists, **options).details(df).collect()
    with Extraction(documents(df), lists, Options(**options)) as e:
        two = e.detailed().collect()
    names = ("doc", "rank", "keyword", "normalized_keyword", "ngram_size", "occurrences", "sentence_ids")
    fields = lambda rows: {tuple(map(str, (r[c] for c in names))): r["score"] for r in rows}
    assert len(one) == len(two) > 20 and fields(one) == {k: pytest.approx(v, abs=1e-12) for k, v in fields(two).items()}


def test_repeated_and_null_ids(spark, lists):
    rows = [("x", "alpha beta", "en", 1), ("x", "gamma delta", "en", 2), ("x", "alpha beta", "en", 3), ("b", None, None, 4), (None, "delta epsilon", "xx", 5), ("c", "x " * 30_000 + "omega sigma", "en", 6)]
    df = spark.createDataFrame(rows, "id string, body string, language string, keywords int").coalesce(1)
    found = KeywordExtractor(lists, n=1).results(df).collect()
    held = sorted((str(r["id"]), sorted(k["keyword"] for k in r["keywords"])[:2]) for r in found)
    assert held == [("None", ["delta", "epsilon"]), ("b", []), ("c", ["omega", "sigma"]), ("x", ["alpha", "beta"]), ("x", ["alpha", "beta"]), ("x", ["delta", "gamma"])]
    assert KeywordExtractor(lists).details(df.limit(0)).count() == 0
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    KeywordExtractor(lists).results(df).count(), compact_keywords(df, lists, language=None).count()
    with KeywordExtractor(lists).extraction(df) as e:
        e.detailed().count()
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before


def test_near_ties_go_by_place():
    import math

    def order(*rows):
        return [p for _, _, p in in_order(list(rows), lambda r: r)]

    assert order((0.05, 5, "later"), (math.nextafter(0.05, 1), 0, "first")) == ["first", "later"]
    assert order((0.05, 1, "a b c"), (0.05, 2, "b c d"), (0.04, 9, "z")) == ["z", "b c d", "a b c"]
    assert order((math.nan, 0, "n"), (math.inf, 1, "i"), (1.0, 2, "o")) == ["o", "i", "n"]
    assert order((0.05, 2, "a b"), (0.05, 1, "b c"), (0.05 + 1e-13, 0, "c d")) == ["b c", "a b", "c d"]
    text = "Google Kaggle data science"
    assert [k for k, _ in extract_keywords(text, {}, language="en")][:2] == ["Kaggle data science", "Google Kaggle data"]
    rows = [{"normalized_keyword": k} for k in ("alpha beta", "alpha betas", "gamma")]
    assert [r["normalized_keyword"] for r in deduplicated(rows, Options(dedup_func="levs", dedup_lim=0.6))] == ["alpha beta", "gamma"]


def test_hooks(spark, lists):
    class Strip:
        def lemmatize(self, token, context):
            assert context["language"] == "en" and context["original"].lower() == token
            return token.rstrip("s")

    one = extract_details("models model models shape products", lists, language="en", n=1, lemmatizer=Strip())
    assert [(r["keyword"], r["normalized_keyword"], r["occurrences"], r["sentence_ids"]) for r in one if r["normalized_keyword"] == "model"] == [("models", "model", 3, [0])]
    plain = ["alpha", "gamma", "beta"]
    assert [k for k, _ in extract("alpha beta gamma", {}, n=1, dedup_lim=1.0)] == plain
    assert [k for k, _ in extract("alpha beta gamma", {}, n=1, dedup_lim=1.0, keyword_scorer=lambda c: c[::-1])] == plain[::-1]
    assert [k for k, s in extract("alpha beta gamma", {}, n=1, term_scorer=lambda t, stats: -len(t.term) * stats["sentences"], candidate_scorer=lambda c, f: c.parts[0].h) if s == -5] == ["alpha", "gamma"]
    assert [k for k, _ in extract("alpha beta", {}, n=2, keep=lambda k: k["ngram_size"] == 2)] == ["alpha beta"]
    cut = extract_details("one+two|three", {}, n=1, tokenizer=lambda s: s.split("+"), sentence_splitter=lambda t: t.split("|"))
    assert {(r["keyword"].strip(), *r["sentence_ids"]) for r in cut} == {("one", 0), ("two", 0), ("three", 1)}

    class Both:
        def split(self, text):
            return text.split(";")

        def tokenize(self, sentence):
            return sentence.split(",")

    both = extract_details("one,two;three", {}, n=1, text_processor=Both())
    assert {(r["keyword"].strip(), *r["sentence_ids"]) for r in both} == {("one", 0), ("two", 0), ("three", 1)}
    assert {r["keyword"].strip() for r in extract_details("one,two;three", {}, n=1, text_processor=Both(), tokenizer=lambda s: [s])} == {"one,two", "three"}
    with pytest.raises(TypeError, match="lemmatizer"):
        KeywordExtractor({}, lemmatizer="spacy")
    df = spark.createDataFrame([("a", "Alpha beta", "en", "On models", {"k": "v"}), ("b", "", "de-AT", None, None)], "id string, body string, language string, title string, metadata map<string,string>")
    seen = KeywordExtractor(lists, n=1, before_text=lambda t, c: t.lower() + " " + c["document"]["id"] * 4, after=lambda ks, c: [k for k in ks if k["keyword"] in c["text"]][:3])
    made = {r["id"]: r for r in seen.results(df, title="title", metadata="metadata").collect()}
    assert {k["keyword"] for k in made["a"]["keywords"]} <= {"alpha", "beta", "models", "aaaa"} and made["b"]["language"] == "de-AT" and made["a"]["metadata"] == {"k": "v"}
    assert [k["keyword"] for k in made["b"]["keywords"]] == ["bbbb"]
    text = "Jeremie Miller said that resonant computing challenges extraction. Jeremie Miller is an interesting thinker."
    short = {r["keyword"] for r in compact_keywords(spark.createDataFrame([("x", text)], "id string, body string"), lists, 10, language=None).collect()}
    assert "jeremie miller" in short and not {"jeremie", "miller"} & short


def test_documents_one_by_one():
    row = {"id": "d", "body": "Edge runtimes benefit from bundled assets.", "title": None, "metadata": {"b": 1, "a": "é"}}
    made = extract_from_document(row, LISTS_OF_WORDS)
    assert made["keywords"][0]["keyword"] == "Edge runtimes benefit" and made["language"] == "en" and "title" not in made
    assert serialized(made).startswith('{"id":"d","keywords":[{"keyword":"Edge runtimes benefit"') and serialized([made]) == f"[{serialized(made)}]"
    assert serialized_bytes(made) == len(serialized(made).encode()) == len(serialized(made)) + 1
    assert KeywordExtractor.levs("hello", "helo") == 0.8 and KeywordExtractor.jaro("CRATE", "TRACE") == pytest.approx(0.7333333333) and KeywordExtractor.seqm("a", "a") == 1


def test_document_model():
    d = Document("Alpha beta gamma. Alpha beta.", frozenset({"beta"}), Options(n=3))
    d.score()
    assert d.freq_ns == {1: 0, 2: 3, 3: 1} and d.words == 5 and d.terms["alpha"].places == {0: [(0, 0)], 1: [(0, 3)]}
    assert d.terms["beta"].stopword and d.terms["beta"].left == {"alpha": 2} and d.terms["alpha"].pr == 0.5 and d.terms["alpha"].pl == 0
    c = d.candidate_of("Alpha unknown gamma")
    assert c.virtual_tf == 1.5 and [t.term for t in c.parts] == ["alpha", "gamma"] and c.size == 3 and d.find_candidate("nothing here") is None
    assert d.candidate_score(c, virtual=True) == pytest.approx(d.terms["alpha"].h * d.terms["gamma"].h / ((d.terms["alpha"].h + d.terms["gamma"].h + 1) * 1.5))
    with pytest.raises(ValueError, match="nothing"):
        d.candidate_of("nothing here")
    assert list(Document("alpha beta gamma", frozenset()).candidates) == ["alpha", "beta", "alpha beta", "gamma", "beta gamma", "alpha beta gamma"]


def test_top_is_a_prefix_and_unique():
    long, short = ([(r["normalized_keyword"], r["score"]) for r in extract_details(CASES[0][0], LISTS_OF_WORDS, language="en", top=k)] for k in (12, 4))
    assert long[:4] == short and len({k for k, _ in long}) == len(long) and [s for _, s in long] == sorted(s for _, s in long)


def test_stream(spark, lists, tmp_path):
    from keystrata.streaming.keywords import document_stream, write_keywords

    df = spark.createDataFrame([("a", "alpha beta"), ("b", "gamma")], "id string, body string")
    df.write.parquet(str(tmp_path / "in"))
    write_keywords(KeywordExtractor(lists), document_stream(spark, str(tmp_path / "in"), df.schema), str(tmp_path / "out"), str(tmp_path / "state"), language=None).awaitTermination(60)
    assert {r["doc"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a", "b"}


def test_stopwords(spark):
    words = stopwords.from_dict(spark, {"EN-us": "﻿The \n\na\nA", "de": ["und"]})
    assert {tuple(r) for r in words.collect()} == {("en", "the"), ("en", "a"), ("de", "und")}
    assert {tuple(r) for r in stopwords.edit(words, "en", add=["x"], remove=["a"]).collect()} == {("en", "the"), ("en", "x"), ("de", "und")}
    assert stopwords.by_language(words) == stopwords.by_language({"EN-us": "﻿The \n\na\nA", "de": ["und"]}) == {"en": {"the", "a"}, "de": {"und"}}


def cli(*argv):
    from keystrata.__main__ import main

    out, err = [], []
    return main(list(argv), out.append, err.append), "".join(out), "".join(err)


def test_command_line(tmp_path):
    assert cli("-ti", "alpha beta", "-n", "1", "--unknown", "-t", "1.0")[:2] == (0, "alpha\n")
    code, out, err = cli("--ngram-size", "oops", "--top")
    assert code == 1 and err.splitlines() == ["--ngram-size must be numeric", "--top requires a value", "either --text-input or --input-file is required"] and out.startswith("Usage")
    assert cli("--text-input", "hello", "--top", "0", "--dedup-lim", "2", "--dedup-func", "wat")[2].splitlines() == ["--top must be a positive integer", "--dedup-lim must be between 0 and 1", "--dedup-func must be one of levs, jaro, seqm"]
    assert cli("--help")[0] == 0 and cli("-i", str(tmp_path / "none"))[0] == 1
    (tmp_path / "t.txt").write_text("alpha and beta", encoding="utf-8")
    (tmp_path / "s.txt").write_text("and\n", encoding="utf-8")
    code, out, _ = cli("-i", str(tmp_path / "t.txt"), "-s", str(tmp_path / "s.txt"), "-v", "-df", "JARO")
    assert code == 0 and {k for k, _ in __import__("json").loads(out)} >= {"alpha", "beta"}
