"""Operators whose results a brute-force version, an exact round trip or the library itself can tell."""

import random
import re

import numpy as np
import pytest
import regex

from keystrata.llm import leakage, lookalikes, queries, spans, tokenizer
from keystrata.llm.encoding import Repairer

ODD = ["it's 'tis '' 's we'rest \n's \n 's  's", "a  b   c \n\n d", "", None, "   ", "'", "'ll'd' 'm", "<|endoftext|>", "x　 ' re", "é́ ８３①½ x_y", "don't'S ''t", "'" * 5 + "s", "漢字 かな 😀😀", "word " * 30_000]


def test_tokenizer_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.vocabulary_path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    library.encode_special_tokens = True
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(" '\nabesrtT12.é世\t ") for _ in range(rng.randrange(60))) for _ in range(500)]
    rows = [(i if i else None, t, "clash") for i, t in enumerate(texts)] + [(1, texts[1], "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = tokenizer.encode_corpus(df, path).collect()
    assert len(found) == len(rows)
    want = {i: e.ids for i, e in enumerate(library.encode_batch([t or "" for t in texts], add_special_tokens=False))}
    assert all(r["ids"] == want[r["doc_id"] or 0] for r in found)
    assert tokenizer.encode_corpus(df.limit(0), path).count() == 0


def test_long_words_equal_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.vocabulary_path("byte_bpe_50k.json")
    library, rng = tokenizers.Tokenizer.from_file(path), random.Random(6)
    coder = tokenizer.WordEncoder(path)
    for letters, n in (("abcdefghijklmnopqrstuvwxyz", 20_000), ("aab", 3_000), ("-=", 5_000), ("a", 100_000), ("éаб漢", 3_000), ("the and ing ".replace(" ", ""), 3_000)):
        word = "".join(rng.choice(letters) for _ in range(n))
        assert coder.encode([word, "x"]).to_pylist() == [library.encode(w, add_special_tokens=False).ids for w in (word, "x")]


def leaks(docs, items, run):
    words = lambda t: [w.lower() for w in regex.findall(r"[\p{L}\p{N}]+", t or "")]
    out = set()
    for d, t in docs:
        grams = {tuple(w[i : i + run]) for w in [words(t)] for i in range(len(w) - run + 1)}
        out |= {(d, k) for k, s in items for v in [words(s)] if d is not None and k is not None and any(tuple(v[i : i + run]) in grams for i in range(len(v) - run + 1))}
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice("a b c d e f Größe 7".split()) for _ in range(n))
    items = [(i, text(rng.randrange(3, 30))) for i in range(25)] + [(1, "a b"), (None, text(20)), (30, None), (31, ""), (32, " a" * 40)]
    docs = [(i, text(40)) for i in range(60)] + [(100 + i, re.sub(" ", "\n> ", items[i][1].upper())) for i in range(20)] + [(7, text(30)), (None, items[0][1]), (200, None), (201, ""), (202, "a " * 5000), (100, docs_text := "zz")]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item long")
    i = spark.createDataFrame(items, "item_id long, text string")
    for run in (6, 9):
        found = leakage.leaked_items(d, i, run=run)
        assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == leaks(docs, items, run)
        assert found.where(f"words < {run}").count() == 0
    assert leakage.leaked_items(d.limit(0), i).count() == 0 and leakage.leaked_items(d, i.limit(0)).count() == 0


def nearby(docs, items, share, slack):
    words = lambda t: [w.lower() for w in regex.findall(r"[\p{L}\p{N}]+", t or "")]
    out = {}
    for d, t in docs:
        for k, s in items:
            held, want, bands = words(t), words(s), {}
            for off, w in enumerate(want):
                for pos in (i for i, x in enumerate(held) if x == w):
                    for b in range(pos - off - slack, pos - off + 1):
                        bands.setdefault(b, set()).add(off)
            best = max(map(len, bands.values()), default=0)
            if d is not None and k is not None and want and best >= share * len(want) - 1e-9:
                out[d, k] = max(best / len(want), out.get((d, k), 0))
    return out


def test_near_equals_brute_force(spark):
    rng = random.Random(5)
    text = lambda n, of="a b c d e f g h i j k l m n o p q r s t".split(): [rng.choice(of) for _ in range(n)]
    items = [(i, text(rng.randrange(1, 45))) for i in range(30)] + [(30, [f"u{i}" for i in range(20)]), (31, ["a", "b"] * 10), (None, text(20))]
    docs = [(900, text(300)), (901, []), (902, ["a"] * 400)]
    for i, w in items[:31]:
        for k in range(4):
            changed = list(w)
            for _ in range(k * max(len(w) // 12, 1)):
                at = rng.randrange(len(changed) + 1)
                changed[at : at + rng.choice((0, 1))] = [f"new{rng.randrange(99)}"] * rng.choice((0, 1))
            docs.append((100 * k + i, text(5) + changed + text(5)))
    docs, items = ([(k, " ".join(w)) for k, w in x] for x in (docs, items))
    d, i = spark.createDataFrame([*docs, (903, None), (None, items[0][1])], "doc_id long, text string"), spark.createDataFrame([*items, (40, ""), (41, None)], "item_id long, text string")
    for share, slack in ((0.8, 3), (0.5, 0)):
        found = {(r["doc"], r["item"]): r["share"] for r in leakage.LeakIndex(d, i).near(share, slack).collect()}
        assert found == pytest.approx(nearby(docs, items, share, slack))


def shared(docs, least):
    out = set()
    for x, (a, s) in enumerate(docs):
        for b, t in docs[x + 1 :]:
            if None not in (a, b, s, t) and a != b and len(s) >= least and len(t) >= least:
                windows = {s[i : i + least] for i in range(len(s) - least + 1)}
                if any(t[i : i + least] in windows for i in range(len(t) - least + 1)):
                    out.add((min(a, b), max(a, b)))
    return out


def test_shared_spans_equal_brute_force(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefgh é😀\n") for _ in range(n))
    common = [text(n) for n in (30, 39, 40, 41, 60, 90, 200)]
    docs = [(i, text(rng.randrange(30)) + rng.choice(common) + text(rng.randrange(60))) for i in range(70)]
    docs += [(100 + i, common[6]) for i in range(6)] + [(110, "x" * 300), (111, "y" + "x" * 45), (112, "ab" * 50), (113, "ba" * 30), (None, common[6]), (114, None), (115, ""), (100, common[5])]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, c int")
    found = [(r["doc_id_a"], r["doc_id_b"]) for r in spans.shared_span_pairs(df, least=40).collect()]
    assert len(found) == len(set(found)) and set(found) == shared(docs, 40)
    assert spans.shared_span_pairs(df.limit(0), least=40).count() == 0
    counts = {r["doc"]: (r["n"], r["shared"]) for r in spans.SharedSpans(spark.createDataFrame([(1, "u" + common[6] + "v"), (2, "ww" + common[6]), (3, common[6][:50] + "k" * 10)], "doc_id long, text string"), least=40).shared().collect()}
    assert counts == {1: (202, 200), 2: (202, 200), 3: (60, 50)}


def test_groups_and_stretches(spark):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh é😀\n") for _ in range(n))
    long, short = text(400), text(50)
    docs = [(1, text(9) + long + text(9)), (2, long[:210] + text(30)), (3, text(70) + short), (4, short + text(3) + long[:170]), (5, text(300)), (6, "q" * 10 + text(40)), (7, text(80)), (8, None)]
    docs.append((9, docs[6][1]))
    spans_of = spans.SharedSpans(spark.createDataFrame(docs, "doc_id long, text string"), least=40)
    found = {tuple(r) for r in spans_of.stretches().collect()}
    assert found == {(1, 9, 219, 160), (2, 0, 210, 160), (3, 70, 120, 40), (4, 0, 50, 40), (4, 53, 223, 160), (7, 0, 80, 80), (9, 0, 80, 80)}
    groups = {}
    for r in spans_of.groups().collect():
        groups.setdefault(bytes(r["k"]), set()).add(r["doc"])
    assert {(a, b) for g in groups.values() for a in g for b in g if a < b} == {(1, 2), (1, 4), (2, 4), (3, 4)}


def test_window_places_are_common():
    rng = np.random.default_rng(4)
    least = 64
    for _ in range(200):
        core = rng.integers(97, 100, least)
        a, b = (np.concatenate([rng.integers(97, 123, rng.integers(1, 90)), core, rng.integers(97, 123, rng.integers(1, 90))]).astype(np.uint32) for _ in range(2))
        _, _, x = spans.window_places(a, np.array([0]), np.array([len(a)]), least)
        _, _, y = spans.window_places(b, np.array([0]), np.array([len(b)]), least)
        assert set(x) & set(y)


def test_lookalikes(spark):
    same = [("a1", "Café town"), ("a2", "Café to​wn"), ("a3", "Ｃａｆé tоwn "), ("a4", "Café town"), ("b1", "cafe town"), ("b2", "Cafe town"), ("b3", "Café town²"), ("n1", None), ("n2", "  "), ("n3", " "), (None, "Café town")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in same], "id string, body string, key string, scope int")
    found = {(r["key_a"], r["key_b"]) for r in lookalikes.lookalike_pairs(df, "id", "body").collect()}
    assert found == {("a1", "a2"), ("a1", "a3"), ("a2", "a3"), ("a2", "a4"), ("a3", "a4")}
    assert lookalikes.lookalike_pairs(df.limit(0), "id", "body").count() == 0
    assert {(r["key_a"], r["key_b"]) for r in lookalikes.lookalike_pairs(df, "id", "body", within="scope").collect()} == found
    links = {k: sum(k in p for p in found) for k in ("a1", "a2", "a3", "a4")}
    for within in (None, "scope"):
        classes = lookalikes.lookalike_classes(df, "id", "body", within).collect()
        assert {r["key"]: r["links"] for r in classes} == links and {r["variants"] for r in classes} == {3} and len({r["look"] for r in classes}) == 1
    forms = {r["id"]: r["normal"] for r in lookalikes.normalized(df.where("id IS NOT NULL"), "body").collect()}
    assert forms["a1"] == forms["a3"] == "Café town" and forms["n1"] is None and forms["n2"] == "" and forms["b3"] == "Café town²"
    marks = spark.createDataFrame([("x̣́",), ("x̣́",), ("ｶﾞ",), ("ガ",), ("é" * 20_000,)], "t string")
    none = spark.createDataFrame([("\u200b\u200b",), ("e\u200b\u0301",), ("\u00e9",)], "t string")
    assert sorted(r["normal"] for r in lookalikes.normalized(none, "t").collect()) == ["", "\u00e9", "\u00e9"]
    assert marks.count() == 5 and lookalikes.normalized(marks, "t").select("normal").distinct().count() == 3


CLEAN = {
    "fr": ["Le maître cordier répare déjà une péniche échouée à côté du marégraphe.", "Où sont les fenêtres ? C’est très étonnant, à l’aube."],
    "lt": ["Kelto archyvas aprašo vandens lygį ir žurnalą šiauriniame krante, jūsų čia.", "Mūsų sodų draugija renka grūdų kainas, ačiū, ąžuolas."],
    "ru": ["Архив переправы описывает ночное расписание до восхода солнца.", "Малая станция связи хранит цены на зерно и уровень воды."],
    "en": ["The ferry archive describes the night schedule before sunrise."],
}


@pytest.mark.parametrize("text, wrong, meant", [("Une péniche échouée répare le marégraphe.", "cp1252", "utf-8"), ("Kelto archyvas aprašo žurnalą.", "mac_roman", "utf-8"), ("Kelto archyvas aprašo žurnalą ir grūdų kainas.", "cp1252", "cp1257"), ("Архив хранит цены на зерно.", "cp1251", "utf-8"), ("Архив хранит цены на зерно.", "cp1252", "cp1251")])
def test_repair_round_trip(text, wrong, meant):
    garbled = text.encode(meant).decode(wrong, "strict" if wrong != "cp1252" else "replace")
    if "�" not in garbled:
        assert Repairer(CLEAN).repair(garbled)[0] == text


KEPT = {
    "ru": "Архив переправы описывает ночное расписание до восхода солнца и хранит цены на зерно.",
    "pl": "Kronika promu ogłasza wpisy pamięci, a wąska łódź łączy żółte mosty bez żadnej zwłoki.",
    "lt": "Kelto archyvas aprašo vandens lygį ir žurnalą šiauriniame krante, jūsų čia.",
    "fr": "Une péniche échouée répare déjà le marégraphe à côté de l'écluse.",
    "de": "Der Leuchtwärter prüft täglich die Wasserstände, während die Fähre größere Kähne überholt.",
    "pt": "A memória vetorial não verifica o horário noturno e as válvulas de reposição da estação.",
}


@pytest.mark.parametrize("language, wrong, meant", [
    ("ru", "cp1251", "koi8_r"), ("ru", "koi8_r", "cp1251"), ("ru", "cp866", "cp1251"), ("ru", "cp1252", "cp1251"), ("ru", "cp1251", "cp866"),
    ("fr", "cp437", "utf-8"), ("de", "cp850", "utf-8"), ("pl", "cp1250", "utf-8"), ("lt", "iso8859_2", "utf-8"), ("ru", "cp866", "utf-8"),
    ("fr", "mac_roman", "cp1252"), ("de", "cp850", "cp1252"), ("pt", "cp850", "cp1252"), ("pt", "cp1250", "cp1252"), ("pl", "cp1252", "cp1250"), ("lt", "cp1252", "cp1257"),
])
def test_every_pair_of_codecs(language, wrong, meant):
    """A wrong reading of any kind is undone, where the reader's codec has all the bytes; the text as it was stays as it is."""
    text, raw = KEPT[language], KEPT[language].encode(meant)
    garbled = "".join(bytes([b]).decode(wrong, "ignore") or chr(b) for b in raw)
    fixer = Repairer({k: [*CLEAN.get(k, ()), v] for k, v in KEPT.items()} | {"en": CLEAN["en"]})
    assert garbled == text or fixer.repair(garbled)[0] == text
    assert fixer.repair(text) == (text, [])


def test_disguised_text_is_not_garbled():
    fixer = Repairer({k: [*CLEAN.get(k, ()), v] for k, v in KEPT.items()} | {"en": CLEAN["en"]})
    for text in ("Thе fеrry arсhivе dеscribes the nіght schedulе before ѕunrise", "Une pénichе échоuée", "the\xa0ferry archive… before\xadsunrise", "“Архив”"):
        assert fixer.repair(text) == (text, [])


@pytest.mark.parametrize("language, text, wrong, meant", [("pl", "być", "cp1252", "utf-8"), ("pl", "być", "cp1252", "cp1250"), ("pl", "Pamięć łączy dzień i noc", "cp1252", "cp1250"), ("pl", "PAMIĘĆ", "cp1252", "cp1250"), ("it", "può", "cp1252", "utf-8"), ("lt", "žmonę", "cp1252", "cp1257"), ("lt", "mažę", "cp1252", "utf-8")])
def test_letters_that_training_texts_lack(language, text, wrong, meant):
    texts = CLEAN | {"pl": ["Łódź wąska, żółta próba jest tu. Kto łączy mosty i śnieg?"], "it": ["La città è già lì."]}
    garbled = text.encode(meant).decode(wrong)
    assert Repairer(texts).repair(garbled, language)[0] == text and Repairer(texts).repair(text, language) == (text, [])


def test_repair_leaves_clean_text(spark):
    from keystrata.llm.encoding import repaired

    fixer = Repairer(CLEAN)
    for texts in CLEAN.values():
        for t in texts:
            assert fixer.repair(t) == (t, [])
    corpus = spark.createDataFrame([(k, t, "x") for k, v in CLEAN.items() for t in v], "language string, text string, original string")
    rows = [("1", "dÃ©jÃ\xa0 vu"), ("2", "﻿la"), ("3", None), ("4", ""), (None, "dÃ©jÃ\xa0"), ("5", "d�j�"), ("1", "dÃ©jÃ\xa0 vu"), ("6", "plain")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id string, body string, text string")
    found = {r["row_key"]: (r["original"], r["lost"]) for r in repaired(df, corpus, "id", "body").collect()}
    assert found == {"1": ("déjà vu", 0), "5": ("d�j�", 2)}
    assert repaired(df.limit(0), corpus, "id", "body").count() == 0


def test_all_labelled_documents_tell_what_is_clean(spark):
    """Documents of any key and any length count: here those of least hash, and all short ones, lack the letters in question."""
    from pyspark.sql import functions as F

    from keystrata.llm.encoding import repaired

    clean, plain = "У старой мельницы артель садоводов доставляет два медных колокола.", "Архив описывает расписание."
    assert Repairer(CLEAN).repair(clean)[1]  # the labelled texts alone would take this for garbled
    corpus = spark.createDataFrame([(k, t) for k, v in CLEAN.items() for t in v], "language string, text string")
    keys = [r["id"] for r in spark.range(900).select(F.col("id").cast("string")).orderBy(F.xxhash64("id")).collect()]
    late = [(k, f"{k}. {clean if i >= 300 else plain}", "ru-RU") for i, k in enumerate(keys)]
    long = [(k, f"{k}. {plain * 1000} {clean}", "RU") for k in keys[:12]]
    for rows in (late, long):
        df = spark.createDataFrame([*rows, ("x", clean, None), ("y", "dÃ©jÃ\xa0 vu", None)], "id string, body string, language string")
        found = {r["row_key"]: r["original"] for r in repaired(df, corpus, "id", "body", label="language").collect()}
        assert found == {"y": "déjà vu"}


def test_known_pairs_and_phrases_equal_brute_force(spark):
    from keystrata.llm import encoding

    rng, few = random.Random(4), "été île âge où près ça".split()
    bodies = [" ".join(rng.choice("le la canal vieux pont 橋の上 x".split() + few) for _ in range(9)) + ("\nrare chose vue" if i % 450 == 0 else "\ndÃ©jÃ\xa0 vu bien") for i in range(901)]
    rows = [(str(i), t, "fr") for i, t in enumerate(bodies)] + [("a", bodies[0], "FR "), ("b", None, "fr"), ("c", " ", "fr"), ("d", bodies[1], "xx"), ("e", bodies[2], None)]
    df = spark.createDataFrame(rows, "id string, body string, language string")
    texts, phrases, pairs = encoding.clean_documents(df, CLEAN, "body", "language")
    docs, fixer = sorted(set(bodies)), Repairer(CLEAN)
    own = fixer.letters["fr"] | encoding.PUNCTUATION | set(map(chr, range(128)))
    n = {p: sum(p[0] + p[1] in t for t in docs) for t in docs for p in zip(t, t[1:]) if max(p) > "\x7f" and own.issuperset(p)}
    assert pairs == {p for p, k in n.items() if k >= max(3, (0.15 if encoding.PUNCTUATION & set(p) else 0.03) * len(docs))} and pairs
    whole = Repairer(CLEAN, None, pairs)
    held = [{p for line in t.split("\n") if not whole.odd(line, tuple(CLEAN)) for p in encoding.phrases_of(line)} for t in docs]
    counts = {p: sum(p in x for x in held) for x in held for p in x}
    least = len(docs) / 300
    assert texts is CLEAN and phrases == {"fr": sorted((p for p, k in counts.items() if k >= least), key=lambda p: (counts[p], p))}
    assert counts["rare chose vue"] == 3 < least and not any("Ã" in p for p in counts) and len(docs) > 900
    assert encoding.clean_documents(df.limit(0), CLEAN, "body", "language") == (CLEAN, {}, frozenset())
