"""One consistent form for texts that look the same but differ in their characters.

Texts are exploded to positioned code points; a broadcast join brings each one's decomposition or look-alike; combining
marks are put in the order of their classes; letters and marks are recomposed by a second join, and the texts rebuilt.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keystrata.session import materialize

#: Letters of other scripts that look like a Latin letter, as Unicode's list of confusables has them.
LOOKALIKES = {
    "Cyrillic": ("АВЕЅІЈКМНОРСТУХҮԌԚԜаеѕіјорсухһԁԛԝү", "ABESIJKMHOPCTYXYGQWaesijopcyxhdqwy"),
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳ", "ABEZHIKMNOPTYXovcj"),
    "Armenian": ("օսհՕՍ", "ouhOU"),
}
#: Kinds of compatibility decompositions that leave a character's look as it is.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<isolated>", "<initial>", "<medial>", "<final>")
#: Single characters written otherwise but drawn alike: micro, Kelvin, Angstrom and ohm signs, ligatures
#: of Latin letters, digraph letters, Roman numerals, the Thai and Lao vowel am, and kinds of hyphen.
DRAWN_ALIKE = [0xB5, *range(0xFB00, 0xFB07), *range(0x1C4, 0x1CD), 0x1F1, 0x1F2, 0x1F3, 0x132, 0x133, *range(0x2160, 0x2180), 0xE33, 0xEB3]
HYPHENS = {"‐": "-", "‑": "-", "⁃": "-", "﹣": "-"}


@lru_cache(1)
def mapping() -> dict[str, str]:
    """What each character is replaced by, where it isn't itself: full decompositions, look-alikes, blanks, or nothing."""
    plain = {}
    for of, to in LOOKALIKES.values():
        plain.update(zip(of, to))

    def same_look(c: str) -> str:
        d = unicodedata.decomposition(c)
        if not d:
            return plain.get(c, c)
        kind, parts = (d.split(" ")[0], d.split(" ")[1:]) if d[0] == "<" else ("", d.split(" "))
        if kind:
            if kind not in SAME_LOOK and not (kind == "<compat>" and ord(c) in DRAWN_ALIKE):
                return plain.get(c, c)
        return "".join(same_look(chr(int(x, 16))) for x in parts)

    out = {}
    for n in range(0x80, sys.maxunicode + 1):
        c = chr(n)
        category = unicodedata.category(c)
        if category == "Zs":
            to = " "
        elif category == "Cf" or n in (0x34F, 0x115F, 0x1160, 0x3164, 0xFFA0) or 0xFE00 <= n <= 0xFE0F or 0xE0100 <= n <= 0xE01EF:
            to = ""
        elif 0xAC00 <= n <= 0xD7A3:
            continue  # Hangul syllables stay composed
        else:
            to = HYPHENS.get(c) or same_look(c)
        if to != c:
            out[c] = to
    return out


def skeleton_letters() -> dict[int, str | None]:
    """The mapping for str.translate, decompositions included."""
    return {ord(c): to for c, to in mapping().items()}


@lru_cache(1)
def compositions() -> dict[str, str]:
    """Letter with marks in canonical order, to the same recomposed as far as Unicode does, for all single characters."""
    out = {}
    for n in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= n <= 0xD7A3 or not unicodedata.decomposition(chr(n)) or unicodedata.decomposition(chr(n))[0] == "<":
            continue
        parts = unicodedata.normalize("NFD", chr(n)).translate(skeleton_letters())
        if len(parts) > 1 and parts not in out:
            out[parts] = unicodedata.normalize("NFC", parts)
    return out


#: A run of ASCII that no mark can follow stays in one piece; every other code point is a piece of its own.
PIECE = r"[\x00-\x7f]+(?![^\x00-\x7f])|(?s:.)"
KEY = ["h1", "h2"]
#: The class of what has no width: after all marks, which have classes up to 254.
NO_WIDTH = 255


def _mapping_table(spark: SparkSession) -> DataFrame:
    """(piece, to ARRAY<STRUCT<s, class>>): of fixed size, a few thousand rows."""
    rows = {c: [(x, unicodedata.combining(x)) for x in to] for c, to in mapping().items()}
    for n in range(sys.maxunicode + 1):
        c = chr(n)
        if unicodedata.combining(c) and c not in rows:
            rows[c] = [(c, unicodedata.combining(c))]
    return spark.createDataFrame(sorted(rows.items()), "piece string, to array<struct<s: string, class: int>>")


def _text_key(c) -> list:
    return [F.xxhash64(c).alias("h1"), F.xxhash64(c, F.lit(17)).alias("h2")]


def normalized_texts(df: DataFrame, text: str) -> DataFrame:
    """(h1, h2, normal): one row for each distinct text that isn't null, under two hashes of the text as stored.

    Texts that look the same have the same normal form: blanks of any kind are plain ones, blanks at the end of a line
    and at either end of the text are gone, as is what has no width; line ends are line feeds. ASCII texts skip the
    explosion. A text is never cut, and a task holds the pieces of one text at a time.
    """
    spark = df.sparkSession
    texts = df.select(F.col(text).cast("string").alias("t")).where(F.col("t").isNotNull()).select(*_text_key("t"), "t")
    texts = texts.groupBy(*KEY).agg(F.first("t").alias("t"))
    texts = texts.withColumn("t", F.regexp_replace("t", "\r\n?", "\n"))
    plain = texts.where(~F.col("t").rlike(r"[^\x00-\x7f]")).select(*KEY, F.col("t").alias("n"))
    pieces = texts.where(F.col("t").rlike(r"[^\x00-\x7f]")).select(
        *KEY, F.posexplode(F.regexp_extract_all("t", F.lit(PIECE), F.lit(0))).alias("pos", "piece")
    )
    mapped = pieces.join(F.broadcast(_mapping_table(spark)), "piece", "left")
    own = F.array(F.struct(F.col("piece").alias("s"), F.lit(0).alias("class")))
    # what has no width leaves an empty piece that parts nothing, so that a text of such signs alone isn't lost
    letters = mapped.select(*KEY, "pos", F.posexplode_outer(F.coalesce("to", own)).alias("sub", "x"))
    letters = letters.select(*KEY, "pos", "sub", F.coalesce("x.s", F.lit("")).alias("s"), F.coalesce("x.class", F.lit(NO_WIDTH)).alias("class"))
    in_text = Window.partitionBy(*KEY).orderBy("pos", "sub")
    letters = letters.withColumn("seg", F.sum((F.col("class") == 0).cast("int")).over(in_text))
    ordered = F.array_sort(F.collect_list(F.struct("class", "pos", "sub", "s")))
    clusters = letters.groupBy(*KEY, "seg").agg(F.concat_ws("", F.transform(ordered, lambda x: x.s)).alias("s"))
    whole = spark.createDataFrame(sorted(compositions().items()), "s string, composed string")
    composed = clusters.join(F.broadcast(whole), "s", "left").select(*KEY, "seg", F.coalesce("composed", "s").alias("s"))
    rebuilt = composed.groupBy(*KEY).agg(
        F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("seg", "s"))), lambda x: x.s)).alias("n")
    )
    ends = F.regexp_replace(F.regexp_replace("n", r"[ \t]+(?=\n|$)", ""), r"^\s+|\s+$", "")
    return rebuilt.unionByName(plain).select(*KEY, ends.alias("normal"))


def normalized(df: DataFrame, text: str, out: str = "normal") -> DataFrame:
    """df with the normal form of a text column in a column more; null for null. Repeated rows stay repeated.

    A column named as `out` is replaced; others keep their names, clashing ones too.
    """
    rows = df.drop(out) if out in df.columns else df
    forms = normalized_texts(rows, text).select(F.col("h1").alias("__h1"), F.col("h2").alias("__h2"), F.col("normal").alias(out))
    keyed = rows.withColumns({"__h1": F.xxhash64(F.col(text).cast("string")), "__h2": F.xxhash64(F.col(text).cast("string"), F.lit(17))})
    joined = keyed.join(forms, ["__h1", "__h2"], "left")
    return joined.withColumn(out, F.when(F.col(text).isNotNull(), F.col(out))).drop("__h1", "__h2")


def lookalike_pairs(df: DataFrame, key: str, text: str, within: str | None = None) -> DataFrame:
    """(key_a, key_b), key_a < key_b: rows whose texts look the same but aren't the same string, each pair once.

    Both keys are strings. within names a column that both rows must agree in. Null and blank texts, null keys and
    (with within) null groups take part in nothing; identical strings are no pair. Pairs are first formed between the
    distinct strings of one look, so copies of one string, however many, are never compared with each other.
    """
    members = _members(_rows(df, key, text, within))
    variants = members.select("scope", "n1", "n2", *KEY).distinct()
    other = variants.select("scope", "n1", "n2", F.col("h1").alias("g1"), F.col("h2").alias("g2"))
    both = variants.join(other, ["scope", "n1", "n2"]).where("h1 <> g1 OR h2 <> g2").select("scope", "h1", "h2", "g1", "g2")
    # a string of many rows is spread over salts, with a copy of its few variants for each; where both strings of a pair
    # have many rows, the pairs themselves are as many, and adaptive execution splits that join
    salted = both.withColumn("salt", F.explode(_salts()))
    a = members.select("scope", *KEY, "salt", F.col("key").alias("key_a"))
    b = members.select("scope", F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("key").alias("key_b"))
    pairs = salted.join(a, ["scope", *KEY, "salt"]).join(b, ["scope", "g1", "g2"]).where("key_a < key_b")
    return pairs.select("key_a", "key_b").distinct()


def lookalike_classes(df: DataFrame, key: str, text: str, within: str | None = None) -> DataFrame:
    """(key, scope, look, variants, links): the rows whose text some other row writes differently, with the class they are in.

    look names the class; variants is the number of different strings in it, links that of the rows with another string.
    One row for each key and string: a class of m rows gives m rows, not its pairs. Else as lookalike_pairs.
    """
    members = _members(_rows(df, key, text, within))
    strings = members.groupBy("scope", "n1", "n2", *KEY).agg(F.count(F.lit(1)).alias("own"))
    looks = strings.groupBy("scope", "n1", "n2").agg(F.sum("own").alias("rows"), F.count(F.lit(1)).alias("variants")).where("variants > 1")
    sizes = strings.join(looks, ["scope", "n1", "n2"]).withColumn("salt", F.explode(_salts()))
    found = members.join(sizes, ["scope", "n1", "n2", *KEY, "salt"])
    return found.select("key", "scope", F.hex("n1").alias("look"), "variants", (F.col("rows") - F.col("own")).alias("links"))


SALTS = 16


def _salts():
    return F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))


def _rows(df: DataFrame, key: str, text: str, within: str | None) -> DataFrame:
    scope = F.col(within).cast("string") if within else F.lit("")
    rows = df.select(F.col(key).cast("string").alias("key"), scope.alias("scope"), F.col(text).cast("string").alias("t"))
    return rows.where("key IS NOT NULL AND scope IS NOT NULL AND t IS NOT NULL")


def _members(rows: DataFrame) -> DataFrame:
    """(key, scope, h1, h2, n1, n2, salt): the rows whose string has a look that some other string has too, written once.

    h1 and h2 name the string, n1 and n2 the look. One string may be that of many rows: they are spread over salts.
    """
    forms = normalized_texts(rows, "t").where("normal <> ''")
    looks = materialize(forms.select(*KEY, F.xxhash64("normal").alias("n1"), F.xxhash64("normal", F.lit(17)).alias("n2")), "looks")
    several = looks.groupBy("n1", "n2").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("n1", "n2")
    spread = looks.join(several, ["n1", "n2"], "left_semi").withColumn("salt", F.explode(_salts()))
    keyed = rows.select("key", "scope", *_text_key("t")).distinct().withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
    return materialize(keyed.join(spread, [*KEY, "salt"]), "lookalikes")
