"""Keyword extraction as DataFrames, one for each stage: tokens, terms, edges, n-grams, candidates, keywords.

All documents go through together. Tagged tokens are made once, spread by document, and kept for the stages that read
them. These are for queries of words, terms, graphs and candidates; where only keywords are wanted, operators.document
gives the same ones without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrata.functions import text
from keystrata.operators.document import ranked_keywords
from keystrata.options import Options
from keystrata.sources.stopwords import language_key


def document_text(body: str, title: str | None = None) -> Column:
    """The text of a document: its title, trimmed, and its body after a blank line; the body alone without a title."""
    whole = F.coalesce(F.col(body), F.lit(""))
    if title:
        head = F.regexp_replace(F.coalesce(F.col(title), F.lit("")), f"^[{text.SPACE}]+|[{text.SPACE}]+$", "")
        whole = F.when(head != "", F.concat(head, F.lit("\n\n"), whole)).otherwise(whole)
    return whole


def documents(df: DataFrame, id: str = "id", body: str = "body", language: str | None = "language", title: str | None = None, options: Options = Options()) -> DataFrame:
    """(doc, rid, text, lang): the documents of a table; title and body make the text where a title column is named.

    rid tells apart rows with one id and other texts; the same row repeated counts once. The language is that of the
    options, else the document's own, else en. Null ids are kept as such; a null body gives an empty text.
    """
    own = F.col(language) if language else F.lit(None).cast("string")
    lang = F.coalesce(F.lit(options.language), own, F.lit("en"))
    rows = df.select(F.col(id).alias("doc"), document_text(body, title).alias("text"), lang.alias("lang"))
    return rows.withColumn("rid", F.xxhash64("doc", "text", "lang"))


def once(docs: DataFrame, *columns: str) -> DataFrame:
    """These columns of one row of each document: copies of a row would count its words twice."""
    return docs.groupBy("rid").agg(*(F.first(c).alias(c) for c in columns if c != "rid")).select(*columns)


def tokens(docs: DataFrame, splitter: Callable[[str | None], list[list[str]]] = text.sentence_tokens) -> DataFrame:
    """(rid, doc, lang, sent, pos_sent, block, pos_text, word): every word; marks of punctuation alone end a block.

    splitter gives the tokens of each sentence of a text; another may be put in its place.
    """
    marks = frozenset(text.PUNCTUATION)
    kind = docs.schema["doc"].dataType
    names = ["rid", "doc", "lang", "sent", "pos_sent", "block", "pos_text", "word", "sentences"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, sent, at, block, pos, word, total = ([] for _ in range(7))
            for i, t in enumerate(batch.column("text").to_pylist()):
                n, sentences = 0, splitter(t)
                for s, words in enumerate(sentences):
                    b = 0
                    for k, w in enumerate(words):
                        if marks.issuperset(w):
                            b += 1
                            continue
                        row.append(i), sent.append(s), at.append(k), block.append(b), pos.append(n), word.append(w), total.append(len(sentences))
                        n += 1
                if len(row) > 200_000:
                    yield _batch(batch, row, sent, at, block, pos, word, total, names)
                    row, sent, at, block, pos, word, total = ([] for _ in range(7))
            yield _batch(batch, row, sent, at, block, pos, word, total, names)

    schema = f"rid long, doc {kind.simpleString()}, lang string, sent int, pos_sent int, block int, pos_text int, word string, sentences int"
    return once(docs, "rid", "doc", "lang", "text").mapInArrow(run, schema)


def _batch(batch, row, sent, at, block, pos, word, total, names) -> pa.RecordBatch:
    take = pa.array(row, pa.int32())
    ints = [pa.array(x, pa.int32()) for x in (sent, at, block, pos)]
    columns = [batch.column(c).take(take) for c in ("rid", "doc", "lang")]
    return pa.RecordBatch.from_arrays([*columns, *ints, pa.array(word, pa.string()), pa.array(total, pa.int32())], names)


def tagged(toks: DataFrame, stopwords: DataFrame, lemmatize: Callable[[Column], Column] | None = None, normalize: Callable[[Column], Column] | None = None) -> DataFrame:
    """tokens with norm, term, tag, and stop_form: whether the word in this form is a stopword of its language.

    stopwords is a table (lang, word) of lists, a size that doesn't grow with the documents; lists are short, and the
    optimizer broadcasts them if they are. lemmatize and normalize map the lower-case word to another; what they give is
    lower-cased again.
    """
    norm = F.lower("word")
    for hook in (lemmatize, normalize):
        norm = F.lower(hook(norm)) if hook else norm
    rows = toks.withColumn("norm", norm).withColumn("term", text.fold(F.col("norm"))).withColumn("tag", text.tag(F.col("word"), F.col("pos_sent")))
    rows = rows.withColumn("key", language_key(F.col("lang")))
    for form in ("norm", "term"):
        listed = stopwords.select(F.col("lang").alias("key"), F.col("word").alias(form), F.lit(True).alias(f"in_{form}")).distinct()
        rows = rows.join(listed, ["key", form], "left")
    stop = F.coalesce("in_norm", "in_term", text.stripped_length(F.col("term")) < 3)
    return rows.withColumn("stop_form", stop).drop("key", "in_norm", "in_term").repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "rid")


def terms(tags: DataFrame) -> DataFrame:
    """(rid, term, tf, tf_a, tf_n, stopword, first_pos, sentence_ids, sentences): a term is a stopword by its first form."""
    return tags.groupBy("rid", "term").agg(
        F.first("doc").alias("doc"),
        F.count(F.lit(1)).alias("tf"),
        F.count_if(F.col("tag") == "a").alias("tf_a"),
        F.count_if(F.col("tag") == "n").alias("tf_n"),
        F.min_by("stop_form", "pos_text").alias("stopword"),
        F.min("pos_text").alias("first_pos"),
        F.array_sort(F.collect_set("sent")).alias("sentence_ids"),
        F.first("sentences").alias("sentences"),
    )


def document_stats(term_rows: DataFrame) -> DataFrame:
    """(rid, doc, sentences, words, max_tf, avg_tf, std_tf): mean and deviation over the terms that are no stopwords."""
    tf = F.when(~F.col("stopword"), F.col("tf"))
    return term_rows.groupBy("rid").agg(
        F.first("doc").alias("doc"), F.first("sentences").alias("sentences"), F.sum("tf").alias("words"),
        F.max("tf").alias("max_tf"), F.avg(tf).alias("avg_tf"), F.stddev_pop(tf).alias("std_tf"),
    )


def _in_block() -> Window:
    return Window.partitionBy("rid", "sent", "block").orderBy("pos_text")


def edges(tags: DataFrame, window: int = 1) -> DataFrame:
    """(rid, src, dst, weight): how often dst stands up to `window` words after src in a block, both usable words."""
    rows = tags
    for k in range(1, window + 1):
        rows = rows.withColumn(f"lag{k}", F.lag(F.struct("term", "tag"), k).over(_in_block()))
    before = F.filter(F.array(*(F.col(f"lag{k}") for k in range(1, window + 1))), lambda x: x.isNotNull() & ~x.tag.isin("u", "d"))
    pairs = rows.where(~F.col("tag").isin("u", "d")).select("rid", "doc", F.explode(before).alias("p"), F.col("term").alias("dst"))
    return pairs.groupBy("rid", F.col("p.term").alias("src"), "dst").agg(F.first("doc").alias("doc"), F.count(F.lit(1)).alias("weight"))


def graph_metrics(edge_rows: DataFrame) -> DataFrame:
    """(rid, term, wdr, wir, wdl, wil): distinct neighbours and weights to the right and to the left."""
    ends = edge_rows.select("rid", F.col("src").alias("term"), F.col("weight").alias("r"), F.lit(None).cast("long").alias("l")).unionAll(
        edge_rows.select("rid", F.col("dst").alias("term"), F.lit(None).cast("long"), F.col("weight"))
    )
    sums = {"wdr": F.count("r"), "wir": F.sum("r"), "wdl": F.count("l"), "wil": F.sum("l")}
    return ends.groupBy("rid", "term").agg(*(F.coalesce(c, F.lit(0)).alias(name) for name, c in sums.items()))


def _ratio(a: str, b: str) -> Column:
    return F.when(F.coalesce(F.col(b), F.lit(0)) == 0, F.lit(0.0)).otherwise(F.col(a) / F.col(b))


def term_scores(term_rows: DataFrame, metrics: DataFrame, options: Options = Options()) -> DataFrame:
    """terms with their features and h; the lower, the better. Where a document has no usable term, h is 0."""
    whole = Window.partitionBy("rid")
    tf = F.when(~F.col("stopword"), F.col("tf"))
    stats = {"max_tf": F.max("tf"), "avg_tf": F.avg(tf), "std_tf": F.stddev_pop(tf)}
    rows = term_rows.join(metrics, ["rid", "term"], "left").withColumns({k: v.over(whole) for k, v in stats.items()})
    share = F.col("tf") / F.col("max_tf")
    median = F.expr("(element_at(sentence_ids, int((size(sentence_ids) + 1) div 2)) + element_at(sentence_ids, int((size(sentence_ids) + 2) div 2))) / 2")
    features = {
        "wrel": ((0.5 + _ratio("wdl", "wil") * share) + (0.5 + _ratio("wdr", "wir") * share), 1.0),
        "wfreq": (F.col("tf") / F.nullif(F.col("avg_tf") + F.col("std_tf"), F.lit(0.0)), 0.0),
        "wspread": (F.size("sentence_ids") / F.col("sentences"), 0.0),
        "wcase": (F.greatest("tf_a", "tf_n") / (1 + F.log(F.col("tf").cast("double"))), 0.0),
        "wpos": (F.log(F.log(3 + median)), 1.0),
    }
    rows = rows.withColumns({k: expr if options.has(k) else F.lit(off) for k, (expr, off) in features.items()})
    under = F.col("wcase") + F.col("wfreq") / F.col("wrel") + F.col("wspread") / F.col("wrel")
    h = F.when(under == 0, F.lit(float("inf"))).otherwise(F.col("wpos") * F.col("wrel") / under)
    return rows.withColumn("h", F.when(F.col("avg_tf").isNull(), F.lit(0.0)).otherwise(h))


def candidates(tags: DataFrame, scores: DataFrame, edge_rows: DataFrame, options: Options = Options()) -> DataFrame:
    """(rid, doc, norm_kw, kw, size, tf, ord, clean, h): phrases that neither begin nor end with a stopword.

    kw is the first form in the text, ord its place; clean tells whether some occurrence has usable words only. Only
    clean ones are candidates for keywords. A stopword within a phrase counts by how firmly its neighbours go with it.
    """
    rows = tags.join(scores.select("rid", "term", "h", "stopword", "tf"), ["rid", "term"])
    rows = rows.withColumn("prev", F.lag("term").over(_in_block()))
    weights = edge_rows.select("rid", F.col("src").alias("prev"), F.col("dst").alias("term"), F.col("weight").alias("w_in"))
    rows = rows.join(weights, ["rid", "prev", "term"], "left").withColumn("w_in", F.coalesce("w_in", F.lit(0)))
    word = F.struct("word", "norm", "tag", "h", "stopword", "tf", "w_in")
    rows = rows.withColumns({f"l{k}": word if k == 0 else F.lag(word, k).over(_in_block()) for k in range(options.n)})
    made = []
    for size in range(1, options.n + 1):
        parts = [F.col(f"l{k}") for k in range(size - 1, -1, -1)]
        product, total = F.lit(1.0), F.lit(0.0)
        for i, x in enumerate(parts):
            plain = product * x.h, total + x.h
            if 0 < i < size - 1:
                p = (x.w_in / parts[i - 1].tf) * (parts[i + 1].w_in / parts[i + 1].tf)
                product, total = F.when(x.stopword, product * (1 + (1 - p))).otherwise(plain[0]), F.when(x.stopword, total - (1 - p)).otherwise(plain[1])
            else:
                product, total = plain
        clean = ~F.concat(*(x.tag for x in parts)).rlike("[ud]")
        usable = parts[0].isNotNull() & ~parts[0].stopword & ~parts[-1].stopword
        fields = {"size": F.lit(size), "norm_kw": F.concat_ws(" ", *(x.norm for x in parts)), "kw": F.concat_ws(" ", *(x.word for x in parts)), "clean": clean, "product": product, "total": total}
        made.append(F.when(usable, F.struct(*(c.alias(k) for k, c in fields.items()))))
    found = rows.select("rid", "doc", "pos_text", F.explode(F.array_compact(F.array(*made))).alias("c"))
    place = F.struct(F.col("pos_text"), F.col("c.size"))
    grouped = found.groupBy("rid", F.col("c.norm_kw").alias("norm_kw")).agg(
        F.first("doc").alias("doc"), F.min_by("c.kw", place).alias("kw"), F.first("c.size").alias("size"), F.count(F.lit(1)).alias("tf"),
        F.min(place).alias("ord"), F.bool_or("c.clean").alias("clean"), F.first("c.product").alias("product"), F.first("c.total").alias("total"),
    )
    times = F.col("tf") if options.has("KPF") else F.lit(1)
    under = (F.col("total") + 1) * times
    h = F.when(under == 0, F.when(F.col("product") == 0, F.lit(float("nan"))).otherwise(F.signum("product") * F.lit(float("inf")))).otherwise(F.col("product") / under)
    return grouped.withColumn("h", h).drop("product", "total")


def ranked(rows: DataFrame, group: str, item: str, score: str, place: Column, options: Options = Options()) -> DataFrame:
    """(group, rank, item): the items of each group, best first, without those more similar than dedup_lim to a better one.

    Equal scores go by place, except that of two sliding phrases of three or more words the later comes first. The items
    of one group, a document's phrases, are in one task. A null score or item takes no part.
    """
    row = F.struct(F.col(score).alias("score"), place.alias("ord"), F.col(item).alias("normalized_keyword"))
    lists = rows.where(F.col(score).isNotNull() & F.col(item).isNotNull()).groupBy(group).agg(F.collect_list(row).alias("c"))
    best = lists.select(group, F.posexplode(ranked_keywords(F.col("c"), options)).alias("rank", item))
    return best.withColumn("rank", F.col("rank") + 1)


def keywords(found: DataFrame, options: Options = Options()) -> DataFrame:
    """(rid, doc, rank, keyword, normalized_keyword, score, ngram_size, occurrences): each document's best phrases."""
    clean = found.where("clean")
    place = F.col("ord.pos_text").cast("long") * 64 + F.col("ord.size")
    rows = ranked(clean, "rid", "norm_kw", "h", place, options).join(clean, ["rid", "norm_kw"])
    return rows.select("rid", "doc", "rank", F.col("kw").alias("keyword"), F.col("norm_kw").alias("normalized_keyword"), F.col("h").alias("score"), F.col("size").alias("ngram_size"), F.col("tf").alias("occurrences"))


def with_sentences(kws: DataFrame, tags: DataFrame, term_rows: DataFrame) -> DataFrame:
    """keywords with sentence_ids: the sentences of all the words of each, in order."""
    words = kws.select("rid", "normalized_keyword", F.explode(F.split("normalized_keyword", " ")).alias("norm")).withColumn("term", text.fold(F.col("norm")))
    ids = words.join(term_rows.select("rid", "term", "sentence_ids"), ["rid", "term"]).groupBy("rid", "normalized_keyword")
    ids = ids.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sentence_ids")))).alias("sentence_ids"))
    return kws.join(ids, ["rid", "normalized_keyword"], "left")


class Extraction:
    """The stages of one extraction over a table of documents, each a lazy DataFrame; as a context manager, it closes itself."""

    def __init__(self, docs: DataFrame, stopwords: DataFrame, options: Options = Options(), splitter=text.sentence_tokens, lemmatize=None, normalize=None) -> None:
        self.options = options
        # five stages read the tagged tokens: kept with their partitioning, in memory or on disk, and made again if lost
        self.tags = tagged(tokens(docs, splitter), stopwords, lemmatize, normalize).persist(StorageLevel.MEMORY_AND_DISK)
        self.terms = terms(self.tags)
        self.edges = edges(self.tags, options.window)
        self.metrics = graph_metrics(self.edges)
        self.scores = term_scores(self.terms, self.metrics, options)
        self.candidates = candidates(self.tags, self.scores, self.edges, options)
        self.keywords = keywords(self.candidates, options)

    def __enter__(self) -> Extraction:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        """Give the tagged tokens up."""
        self.tags.unpersist()

    def counts(self) -> DataFrame:
        """(size, clean, candidates, occurrences): how many candidates there are in all documents."""
        return self.candidates.groupBy("size", "clean").agg(F.count(F.lit(1)).alias("candidates"), F.sum("tf").alias("occurrences"))

    def detailed(self) -> DataFrame:
        """keywords with the sentences of their words."""
        return with_sentences(self.keywords, self.tags, self.terms)
