"""Registered queries without SQL, by brute force on small tables of awkward texts."""

import math
import statistics
from collections import Counter, defaultdict

import pytest
import regex

import __spark_entry__ as entry
from keystrata.functions.text import PUNCTUATION, sentence_tokens

STOP = {"en": "the a of and is not", "de": "und der die", "ru": "и в на"}
TEXTS = [
    (1, "Dr. Smith met the U.S. team. They weren't late!\n\nThe ferry of Smith and sons is not here: 3.9 km, v2 ferries.", "en"),
    (2, "“Das Archiv und die Fähre,” sagte Größe. Das Archiv\nder Fähre der Nacht.", "de-AT"),
    (3, "Архив переправы и станции. Архив НАСА в ночи на станции!", "RU"),
    (4, "他来了。雨だ。 词 词", "zh"),
    (5, None, "en"), (6, "", None), (7, " \n\t ", "en"), (8, "the a of", "en"),
    (9, "Ferry night archive and ferry night " * 3000 + ". End.", None),
    (10, "und der Ferry und der Ferry", "en"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(*r, "clash") for r in TEXTS], "doc_id long, text string, lang string, term string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, w) for k, v in STOP.items() for w in v.split()], "lang string, word string").write.parquet(f"{path}/stopwords.parquet")
    return str(path)


def tag(w, pos):
    marks, digits, letters, capitals = sum(c in PUNCTUATION for c in w), *(len(regex.findall(p, w)) for p in (r"\p{Nd}", r"\p{L}", r"\p{Lu}"))
    bare = w.replace(",", "")
    if regex.fullmatch("[0-9]+", bare) or regex.fullmatch("[0-9]+", bare.replace(".", "", 1)):
        return "d"
    if bool(digits) == bool(letters) or marks > 1:
        return "u"
    return "a" if capitals == letters else "n" if len(w) > 1 and pos and capitals == 1 and regex.match(r"\p{Lu}", w) else "p"


def stages(text, lang, n=3):
    """The words of a text, and its terms, edges and candidates with their scores, in plain loops."""
    words, blocks = [], defaultdict(list)
    sentences = sentence_tokens(text)
    listed = set(STOP.get((lang or "en")[:2].lower(), "").split())
    for s, sentence in enumerate(sentences):
        block = 0
        for k, w in enumerate(sentence):
            if all(c in PUNCTUATION for c in w):
                block += 1
                continue
            norm = w.lower()
            term = norm[:-1] if len(norm) > 3 and norm.endswith("s") else norm
            stop = norm in listed or term in listed or sum(c not in PUNCTUATION for c in term) < 3
            words.append((len(words), w, norm, term, tag(w, k), stop, s))
            blocks[s, block].append(words[-1])
    tf, stops, sents, cased = Counter(), {}, defaultdict(set), defaultdict(Counter)
    for _, _, _, term, t, stop, s in words:
        tf[term] += 1
        stops.setdefault(term, stop)
        sents[term].add(s)
        cased[term][t] += 1
    edge = Counter((x[3], y[3]) for b in blocks.values() for x, y in zip(b, b[1:]) if x[4] not in "ud" and y[4] not in "ud")
    right, left = defaultdict(list), defaultdict(list)
    for (x, y), weight in edge.items():
        right[x].append(weight)
        left[y].append(weight)
    usable, h = [c for t, c in tf.items() if not stops[t]], {}
    for t, c in tf.items():
        if not usable:
            h[t] = 0.0
            continue
        wrel = 1 + sum(len(x) / sum(x) * c / max(tf.values()) for x in (left[t], right[t]) if x)
        wfreq, wspread = c / (statistics.fmean(usable) + statistics.pstdev(usable)), len(sents[t]) / len(sentences)
        wcase, wpos = max(cased[t]["a"], cased[t]["n"]) / (1 + math.log(c)), math.log(math.log(3 + statistics.median(sents[t])))
        h[t] = wpos * wrel / (wcase + wfreq / wrel + wspread / wrel)
    found = {}
    for b in blocks.values():
        for i in range(len(b)):
            for size in range(1, min(n, i + 1) + 1):
                p = b[i - size + 1 : i + 1]
                if stops[p[0][3]] or stops[p[-1][3]]:
                    continue
                product, total = 1.0, 0.0
                for k, x in enumerate(p):
                    if stops[x[3]]:
                        q = edge[p[k - 1][3], x[3]] / tf[p[k - 1][3]] * edge[x[3], p[k + 1][3]] / tf[p[k + 1][3]]
                        product, total = product * (2 - q), total - (1 - q)
                    else:
                        product, total = product * h[x[3]], total + h[x[3]]
                c = found.setdefault(" ".join(x[2] for x in p), dict(kw=[], tf=0, size=size, clean=False, product=product, total=total))
                c["kw"].append((p[-1][0], " ".join(x[1] for x in p)))
                c["tf"] += 1
                c["clean"] |= not any(x[4] in "ud" for x in p)
    return words, tf, stops, edge, h, found


@pytest.fixture(scope="module")
def brute():
    return {d: stages(t, lang) for d, t, lang in TEXTS}


def rows(spark, folder, name):
    return [tuple(r) for r in entry.queries()[name](spark, folder).collect()]


def test_words_terms_and_edges_of_documents(spark, folder, brute):
    assert sorted(rows(spark, folder, "token_tags_documents")) == sorted((d, w[0], w[1], w[4], w[5]) for d, b in brute.items() for w in b[0])
    assert sorted(r[:3] + r[5:6] for r in rows(spark, folder, "term_frequency_documents")) == sorted((d, t, c, b[2][t]) for d, b in brute.items() for t, c in b[1].items())
    assert sorted(rows(spark, folder, "cooccurrence_edges_documents")) == sorted((d, *e, c) for d, b in brute.items() for e, c in b[3].items())
    assert {r[0] for r in rows(spark, folder, "tokenize_documents")} == {d for d, b in brute.items() if b[0]} >= {1, 2, 3, 4, 8, 9, 10}


def test_scores_of_documents(spark, folder, brute):
    found = {r[:2]: r[-1] for r in rows(spark, folder, "term_scores_documents")}
    assert found == {(d, t): pytest.approx(h, abs=2e-9) for d, b in brute.items() for t, h in b[4].items()}
    want = {}
    for d, b in brute.items():
        for k, c in b[5].items():
            if c["clean"]:
                want[d, k] = (min(c["kw"])[1], c["size"], c["tf"], pytest.approx(c["product"] / ((c["total"] + 1) * c["tf"]), abs=2e-9))
    assert {r[:2]: r[2:] for r in rows(spark, folder, "candidate_scores_documents")} == want and {d for d, _ in want} >= {1, 2, 3, 9, 10}


def test_compact_keywords_of_documents(spark, folder):
    assert {1, 2, 3, 9} <= {r[0] for r in rows(spark, folder, "compact_keywords")}


KEYWORDS = ["größe", "grosse", "naïve bayes", "naïve bayes net", "naïve\xa0bayes net", "Covid-19", "covid 19", "архив ночи", "архив ночью", "水位記録", "水位記事", "😀😀x", "😀y", "", "ab", "p﻿ort a", "plain words", "plain wards"]


def test_similarities_of_all_keywords(spark, tmp_path):
    from keystrata.functions.similarity import jaro, levenshtein, levs, seqm

    rows_of = [("d", k, [0, 2]) for k in [*KEYWORDS, KEYWORDS[0]]] + [("d", None, [0]), ("d", "elsewhere", [1]), ("e", "größe", [0]), ("e", "größen", None)]
    spark.createDataFrame(rows_of, "id string, normalizedKeyword string, sentenceIds array<int>").write.parquet(f"{tmp_path}/kaggle_excerpt.parquet")
    want = [tuple(sorted((a, b), key=str.encode)) for i, a in enumerate(KEYWORDS) for b in KEYWORDS[i + 1 :]]
    close = lambda f: sorted((a, b, pytest.approx(f(a, b), abs=2e-9)) for a, b in want)
    assert sorted(rows(spark, tmp_path, "sim_jaro")) == close(jaro)
    assert sorted(rows(spark, tmp_path, "sim_seqm")) == close(seqm)
    found = rows(spark, tmp_path, "sim_levenshtein")
    assert sorted(r[:2] + r[3:] for r in found) == close(levs) and all(r[2] == levenshtein(*r[:2]) for r in found)
    assert seqm("naïve bayes net", "naïve\xa0bayes net") == 1.0
    terms = {*KEYWORDS, "elsewhere", "größen"}
    assert sorted(rows(spark, tmp_path, "trigrams")) == sorted({(t, t[i : i + 3]) for t in terms for i in range(len(t) - 2)})


def test_sections_and_counts(spark):
    from keystrata.operators import metrics

    df = spark.createDataFrame([(1, "before 1/2/24 " + "x" * 30 + " 12/31/99\n\n" + "y" * 900 + " "), (2, None), (3, "no date")], "k int, t string")
    assert [tuple(r) for r in metrics.date_sections(df, "k", "t").collect()] == [(1, "12/31/99", "2099-12-31", "y" * 900)]
    assert metrics.date_sections(df, "k", "t", least=1).count() == 2
    texts = spark.createDataFrame([(1, "The cat, the cat is up. It's on!", "en"), (1, None, "en"), (2, "", None)], "doc int, text string, lang string")
    stop = spark.createDataFrame([("en", "the"), ("en", "is")], "lang string, word string")
    found = {r["phrase"]: r["n"] for r in metrics.candidate_counts(texts, stop, n=2).collect()}
    assert found == {"cat": 2, "cat ,": 1, "up .": 1, "it on": 1, "on !": 1}


def test_bio(spark):
    from keystrata.operators import metrics

    rows = [(1, i, w, t) for i, (w, t) in enumerate([("deep", "B"), ("net", "I"), ("is", "O"), ("odd", "I"), ("new", "B-KEY")])]
    found = metrics.bio_phrases(spark.createDataFrame(rows, "doc int, pos int, word string, tag string")).orderBy("begin").collect()
    assert [r["phrase"] for r in found] == ["deep net", "odd", "new"]
