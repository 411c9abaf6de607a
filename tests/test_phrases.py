"""Candidates in one pass over the texts, against those of the stages; nothing but texts is exchanged for them."""

import random
import re

import pytest

import __spark_entry__ as entry
from keystrata.operators import phrases
from keystrata.operators.keywords import Extraction, documents
from keystrata.options import Options
from keystrata.sources import stopwords

WORDS = "the ferry ferries Ferry NASA night archive and of of in 3.9 v2 x'y' U.S. , - ( Größe архив ΑΣ ΑΣ. 詞 İz don't … . ! \n\n \nThe".split(" ")
LISTS = {"en": "the of and", "de": "ferrie größe", "ru": "архив"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path, made = tmp_path_factory.mktemp("tables"), random.Random(3)
    rows = [(i, " ".join(made.choices(WORDS, k=made.choice([1, 5, 60, 300]))), made.choice(["en", "de-AT", "RU", "zh", "", None])) for i in range(120)]
    rows += [rows[3], rows[3], (3, "another text of one id", "en"), (None, "null ferry", "en"), (None, "null ferry", "en"), (901, None, "en"), (902, "", None), (903, ". ! …", "en"), (904, "the of and", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, w) for k, v in LISTS.items() for w in v.split()], "lang string, word string").write.parquet(f"{path}/stopwords.parquet")
    return str(path)


def both(spark, folder, **options):
    o, words = Options(**options), stopwords.load(spark.read.parquet(f"{folder}/stopwords.parquet"))
    docs = documents(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id", "text", "lang", options=o)
    return phrases.Phrases(docs, spark.sparkContext.broadcast(stopwords.by_language(words)), o), Extraction(docs, words, o)


@pytest.mark.parametrize("options", [{}, {"n": 4, "window": 2}, {"n": 1, "features": ("wfreq",)}, {"features": ("wrel", "wcase", "wpos", "wspread")}, {"language": "de", "n": 2, "features": ()}])
def test_one_pass_gives_the_candidates_of_the_stages(spark, folder, options):
    one, stages = both(spark, folder, **options)
    columns = ["doc", "norm_kw", "kw", "size", "tf", "clean", "h"]
    with stages:
        want = sorted((tuple(r) for r in stages.candidates.select(columns).collect()), key=repr)
        counts = sorted(map(tuple, stages.counts().collect()))
    found = sorted((tuple(r) for r in one.candidates.collect()), key=repr)
    assert one.candidates.schema.simpleString() == stages.candidates.select(columns).schema.simpleString()
    assert [r[:6] for r in found] == [r[:6] for r in want] and len(found) > 500
    assert [r[6] for r in found] == [pytest.approx(r[6], abs=1e-11, nan_ok=True) for r in want]
    assert sorted(map(tuple, one.counts().collect())) == counts


def test_chunks_and_forgotten_words(spark, folder, monkeypatch):
    chunk = lambda: phrases.Chunk({"en": frozenset(["the", "of"])}, Options())
    texts = [("The ferry of Night ferries. Of the ferry of night.", "en"), ("the ferry", "de"), (None, "en")] * 3

    def counted(parts):
        made, out = chunk(), []
        for part in parts:
            for t in part:
                made.add(*t)
            rows = list(made.count())
            names = list(made.words)
            out += [(" ".join(names[w[i]] for w in x["words"]), int(x["tf"][i]), round(float(x["h"][i]), 12)) for x in rows for i in range(len(x["row"]))]
            made.clear()
        return sorted(out)

    whole = counted([texts])
    monkeypatch.setattr(phrases, "REMEMBERED", 2)
    assert counted([[t] for t in texts]) == counted([texts[:4], texts[4:]]) == whole and len(whole) > 20


@pytest.mark.parametrize("name", ["candidate_scores_wfreq_only", "ngram_freq_by_size", "candidate_scores", "candidate_validity", "candidate_scores_no_kpf"])
def test_only_texts_are_exchanged(spark, folder, name):
    plan = entry.queries()[f"{name}_documents"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" not in plan and "Join" not in plan
    assert set(re.findall(r"Exchange \w+\((\w+)#", plan)) <= {"rid", "size"} and plan.count("(rid#") == 1
