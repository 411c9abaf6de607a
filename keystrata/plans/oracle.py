"""The same results in DuckDB's SQL, for the registered queries that SQL can express."""

from __future__ import annotations

WHITE = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: The stages read raw: (item_id, key, sent, sentences, word, pos_sent). The texts of eval_item are single lines without
#: abbreviations, quotations or contractions; those of documents are split as any text is.
WORD = r"\p{L}[\p{L}\p{M}\p{Nd}]*(?:(?:[.''’-]+|…+)[\p{L}\p{M}\p{Nd}]+)*|\p{Nd}+(?:[.,]\p{Nd}+)*|[^\s]"
MARK = r"[!-/:-@\[-`{-~]"


ITEM_TOKENS = f"""
    sentence AS (
        SELECT item_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS sent, len(s) AS sentences
        FROM (SELECT item_id, list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS s FROM eval_item)
    ), raw AS (
        SELECT item_id, 'en' AS key, sent, sentences, unnest(t) AS word, generate_subscripts(t, 1) - 1 AS pos_sent
        FROM (SELECT *, regexp_extract_all(sentence, '{WORD}') AS t FROM sentence)
    )"""
BLANK, CLOSERS = WHITE[1:-1], "[\"'')\\]}»”’]"
FILTERED = f"""array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN regexp_matches(x, '^{WHITE}*[A-Z]') THEN chr(10) || chr(10) ELSE ' ' END || replace(x, chr(9), ' ')), '')"""
ABBREVIATIONS = "('dr', 'mr', 'mrs', 'ms', 'prof', 'sr', 'sra', 'jr', 'st', 'vs', 'etc', 'e.g', 'i.e', 'u.s', 'u.k', 'no', 'nos')"
LETTERS = r"\p{L}\p{M}\p{Nd}"
#: Sentences by the pieces between marks: a mark with what closes it ends one unless what stands about it says otherwise.
DOCUMENT_TOKENS = f"""
    piece AS (
        SELECT item_id, key, unnest(p) AS t, generate_subscripts(p, 1) AS i
        FROM (SELECT doc_id AS item_id, lower(left(coalesce(lang, 'en'), 2)) AS key, regexp_extract_all({FILTERED}, '\\n\\n|!+{CLOSERS}*\\.?|\\?+{CLOSERS}*\\.?|\\.+{CLOSERS}*|[^.!?\\n]+|\\n') AS p FROM documents WHERE text IS NOT NULL)
    ), about AS (
        SELECT *, lag(t) OVER w AS p1, lag(t, 2) OVER w AS p2, lag(t, 3) OVER w AS p3, lead(t) OVER w AS n1, lead(t, 2) OVER w AS n2, regexp_matches(t, '^[.!?]') AS mark,
            coalesce(bool_or(regexp_matches(t, '[^{BLANK}]')) OVER (PARTITION BY item_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) AS more
        FROM piece WINDOW w AS (PARTITION BY item_id ORDER BY i)
    ), near AS (
        SELECT *, coalesce(right(p1, 1), '') AS b, CASE WHEN length(t) > 1 THEN substring(t, 2, 1) ELSE coalesce(left(n1, 1), '') END AS a,
            length(t) > 1 OR regexp_matches(coalesce(left(n1, 1), ''), '{WHITE}') AS apart FROM about
    ), judged AS (
        SELECT *, mark AND (NOT more OR apart AND (t[1] <> '.' OR NOT (
            regexp_matches(b, '\\p{{Nd}}') AND regexp_matches(a, '\\p{{Nd}}')
            OR coalesce(regexp_full_match(p1, '\\p{{L}}') AND p2 = '.' AND regexp_matches(p3, '(^|[^{LETTERS}\\p{{Pc}}])\\p{{L}}$'), false)
            OR coalesce(length(t) = 1 AND regexp_matches(b, '\\p{{L}}') AND regexp_full_match(n1, '\\p{{L}}') AND n2[1] = '.', false)
            OR lower(regexp_extract(coalesce(p1, ''), '[{LETTERS}]+$')) IN {ABBREVIATIONS}))) AS ends, more AND t[1] = '.' AND a = '»' AS quoted FROM near
    ), first AS (
        SELECT *, coalesce(sum(CAST(ends AND NOT quoted OR t = chr(10) || chr(10) AS INT)) OVER (PARTITION BY item_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g0 FROM judged
    ), settled AS (
        SELECT *, ends AND NOT (quoted AND regexp_matches(string_agg(t, '') OVER (PARTITION BY item_id, g0 ORDER BY i), '^{WHITE}*«')) AS stop FROM first
    ), grouped AS (
        SELECT *, coalesce(sum(CAST(stop OR t = chr(10) || chr(10) AS INT)) OVER (PARTITION BY item_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM settled
    ), sentence AS (
        SELECT item_id, any_value(key) AS key, g, regexp_replace(string_agg(t, '' ORDER BY i) FILTER (t <> chr(10) || chr(10)), '^{WHITE}+|{WHITE}+$', '', 'g') AS sentence FROM grouped GROUP BY item_id, g
    ), part AS (
        SELECT item_id, key, g, unnest(t) AS t, generate_subscripts(t, 1) AS k FROM (SELECT *, regexp_extract_all(sentence, '{WORD.removesuffix("[^\\s]")}[^{BLANK}]') AS t FROM sentence)
    ), beside AS (
        SELECT *, lead(t) OVER w AS n1, lead(t, 2) OVER w AS n2, lead(t, 3) OVER w AS n3 FROM part WINDOW w AS (PARTITION BY item_id, g ORDER BY k)
    ), taking AS (
        SELECT *, coalesce(CASE WHEN t = '…' AND regexp_full_match(n1, '{CLOSERS}') THEN 'whole'
            WHEN n1 = '.' AND t <> '.' AND (contains(t, '.') OR lower(t) IN {ABBREVIATIONS} OR regexp_full_match(n2, '{CLOSERS}') AND n3 IS NOT NULL) THEN 'dot'
            WHEN n1 = '؟' AND regexp_matches(t, '[{LETTERS}]$') THEN 'whole' END, '') AS takes FROM beside
    ), free AS (
        SELECT *, coalesce(lag(takes) OVER (PARTITION BY item_id, g ORDER BY k), '') <> '' AS taken FROM taking
    ), dots AS (
        SELECT *, t = '.' AND NOT taken AS dot, k - sum(CAST(t = '.' AND NOT taken AS INT)) OVER (PARTITION BY item_id, g ORDER BY k) AS island FROM free
    ), runs AS (
        SELECT *, count(*) FILTER (dot) OVER (PARTITION BY item_id, g, island) AS run, min(k) FILTER (dot) OVER (PARTITION BY item_id, g, island) AS first FROM dots
    ), whole AS (
        SELECT item_id, key, g, k, takes, CASE WHEN dot AND run >= 3 THEN repeat('.', run) WHEN takes = 'dot' THEN t || '.' WHEN takes = 'whole' THEN t || n1 ELSE t END AS t FROM runs WHERE NOT taken AND NOT (dot AND run >= 3 AND k > first)
    ), halves AS (
        SELECT *, regexp_extract(t, '(?s)^(.*)([''’])([^''’]*)$', ['head', 'mark', 'tail']) AS x FROM whole
    ), cut AS (
        SELECT item_id, key, g, k, unnest(c) AS word, generate_subscripts(c, 1) AS c FROM (SELECT *, CASE WHEN takes = 'whole' OR x.head = '' THEN [t]
            WHEN lower(x.tail) IN ('s', 're', 've', 'll', 'd', 'm') THEN [x.head, x.mark || x.tail]
            WHEN lower(x.tail) = 't' AND length(x.head) > 1 AND lower(right(x.head, 1)) = 'n' THEN [left(x.head, length(x.head) - 1), right(x.head, 1) || x.mark || x.tail] ELSE [t] END AS c FROM halves)
    ), kept AS (
        SELECT *, dense_rank() OVER (PARTITION BY item_id ORDER BY g) - 1 AS sent FROM cut WHERE NOT (regexp_matches(word, '^[''’]') AND length(word) > 1)
    ), raw AS (
        SELECT item_id, key, sent, max(sent) OVER (PARTITION BY item_id) + 1 AS sentences, word, row_number() OVER (PARTITION BY item_id, sent ORDER BY k, c) - 1 AS pos_sent FROM kept
    )"""


def stages(window: int = 1, n: int = 3, features: str = "wrel wfreq wspread wcase wpos KPF", tokens: str = ITEM_TOKENS) -> str:
    on = features.split()

    def feature(name: str, sql: str, off: str) -> str:
        return f"{sql if name in on else off} AS {name}"

    sizes = []
    for size in range(1, n + 1):
        parts = [f"l{k}" for k in range(size - 1, -1, -1)]
        product, total = "CAST(1 AS DOUBLE)", "CAST(0 AS DOUBLE)"
        for i, x in enumerate(parts):
            plain = f"({product}) * {x}.h", f"({total}) + {x}.h"
            if 0 < i < size - 1:
                p = f"({x}.w_in / {parts[i - 1]}.tf) * ({parts[i + 1]}.w_in / {parts[i + 1]}.tf)"
                product, total = f"CASE WHEN {x}.stopword THEN ({product}) * (2 - {p}) ELSE {plain[0]} END", f"CASE WHEN {x}.stopword THEN ({total}) - (1 - {p}) ELSE {plain[1]} END"
            else:
                product, total = plain
        join = lambda f: " || ' ' || ".join(f"{x}.{f}" for x in parts)
        sizes.append(
            f"SELECT item_id, pos_text, {size} AS size, {join('norm')} AS norm_kw, {join('word')} AS kw, NOT regexp_matches({' || '.join(f'{x}.tag' for x in parts)}, '[ud]') AS clean, "
            f"{product} AS product, {total} AS total FROM lagged WHERE {parts[0]} IS NOT NULL AND NOT {parts[0]}.stopword AND NOT {parts[-1]}.stopword"
        )
    lags = ", ".join(["struct_pack(word, norm, tag, h, stopword, tf, w_in) AS l0", *(f"lag(struct_pack(word, norm, tag, h, stopword, tf, w_in), {k}) OVER b AS l{k}" for k in range(1, n))])
    return f"""
    WITH {tokens}, marked AS (
        SELECT *, regexp_full_match(word, '{MARK}+') AS mark,
               CAST(sum(CAST(regexp_full_match(word, '{MARK}+') AS INT)) OVER (PARTITION BY item_id, sent ORDER BY pos_sent) AS INT) AS block FROM raw
    ), token AS (
        SELECT item_id, key, CAST(sent AS INT) AS sent, CAST(pos_sent AS INT) AS pos_sent, block, sentences, word, lower(word) AS norm,
               CAST(row_number() OVER (PARTITION BY item_id ORDER BY sent, pos_sent) - 1 AS INT) AS pos_text,
               CASE WHEN length(lower(word)) > 3 AND ends_with(lower(word), 's') THEN left(lower(word), length(word) - 1) ELSE lower(word) END AS term
        FROM marked WHERE NOT mark
    ), list AS (
        SELECT DISTINCT lower(left(lang, 2)) AS key, lower(regexp_replace(word, '^{WHITE}+|{WHITE}+$', '', 'g')) AS w FROM stopwords WHERE lang IS NOT NULL AND word IS NOT NULL
    ), tags AS (
        SELECT *, (key, norm) IN (SELECT (key, w) FROM list WHERE w <> '') OR (key, term) IN (SELECT (key, w) FROM list WHERE w <> '') OR length(regexp_replace(term, '{MARK}', '', 'g')) < 3 AS stop_form,
            CASE WHEN regexp_full_match(replace(word, ',', ''), '[0-9]+') OR regexp_full_match(regexp_replace(replace(word, ',', ''), '\\.', ''), '[0-9]+') THEN 'd'
                 WHEN regexp_matches(word, '\\p{{Nd}}') = regexp_matches(word, '\\p{{L}}') OR len(regexp_extract_all(word, '{MARK}')) > 1 THEN 'u'
                 WHEN NOT regexp_matches(word, '\\p{{Ll}}|\\p{{Lo}}|\\p{{Lm}}|\\p{{Lt}}') AND regexp_matches(word, '\\p{{Lu}}') THEN 'a'
                 WHEN length(word) > 1 AND regexp_matches(word, '^\\p{{Lu}}') AND pos_sent > 0 AND len(regexp_extract_all(word, '\\p{{Lu}}')) = 1 THEN 'n' ELSE 'p' END AS tag
        FROM token
    ), terms AS (
        SELECT item_id, term, count(*) AS tf, count(*) FILTER (tag = 'a') AS tf_a, count(*) FILTER (tag = 'n') AS tf_n, arg_min(stop_form, pos_text) AS stopword,
               min(pos_text) AS first_pos, count(DISTINCT sent) AS in_sentences, list_sort(list(DISTINCT sent)) AS ids, any_value(sentences) AS sentences
        FROM tags GROUP BY 1, 2
    ), stats AS (
        SELECT item_id, CAST(any_value(sentences) AS INT) AS sentences, CAST(sum(tf) AS BIGINT) AS words, max(tf) AS max_tf,
               avg(tf) FILTER (NOT stopword) AS avg_tf, stddev_pop(tf) FILTER (NOT stopword) AS std_tf FROM terms GROUP BY 1
    ), pair AS (
        SELECT item_id, lag(struct_pack(term, tag), k) OVER (PARTITION BY item_id, sent, block, k ORDER BY pos_text) AS p, term AS dst, tag
        FROM tags, (SELECT unnest(range(1, {window + 1})) AS k)
    ), edges AS (
        SELECT item_id, p.term AS src, dst, count(*) AS weight FROM pair WHERE p IS NOT NULL AND p.tag NOT IN ('u', 'd') AND tag NOT IN ('u', 'd') GROUP BY 1, 2, 3
    ), metrics AS (
        SELECT item_id, term, count(r) AS wdr, CAST(coalesce(sum(r), 0) AS BIGINT) AS wir, count(l) AS wdl, CAST(coalesce(sum(l), 0) AS BIGINT) AS wil
        FROM (SELECT item_id, src AS term, weight AS r, NULL AS l FROM edges UNION ALL SELECT item_id, dst, NULL, weight FROM edges) GROUP BY 1, 2
    ), featured AS (
        SELECT t.*, avg_tf, {feature("wrel", "(0.5 + CASE WHEN coalesce(wil, 0) = 0 THEN 0 ELSE wdl / wil END * (tf / max_tf)) + (0.5 + CASE WHEN coalesce(wir, 0) = 0 THEN 0 ELSE wdr / wir END * (tf / max_tf))", "CAST(1 AS DOUBLE)")},
            {feature("wfreq", "tf / (avg_tf + std_tf)", "CAST(0 AS DOUBLE)")}, {feature("wspread", "in_sentences / t.sentences", "CAST(0 AS DOUBLE)")},
            {feature("wcase", "greatest(tf_a, tf_n) / (1 + ln(tf))", "CAST(0 AS DOUBLE)")}, {feature("wpos", "ln(ln(3 + list_median(ids)))", "CAST(1 AS DOUBLE)")}
        FROM terms t JOIN stats USING (item_id) LEFT JOIN metrics USING (item_id, term)
    ), scores AS (
        SELECT *, CASE WHEN avg_tf IS NULL THEN 0 ELSE wpos * wrel / (wcase + wfreq / wrel + wspread / wrel) END AS h FROM featured
    ), weighted AS (
        SELECT t.*, s.h, s.stopword, s.tf, coalesce(e.weight, 0) AS w_in
        FROM (SELECT *, lag(term) OVER (PARTITION BY item_id, sent, block ORDER BY pos_text) AS prev FROM tags) t
        JOIN scores s USING (item_id, term) LEFT JOIN edges e ON e.item_id = t.item_id AND e.src = t.prev AND e.dst = t.term
    ), lagged AS (
        SELECT item_id, pos_text, {lags} FROM weighted WINDOW b AS (PARTITION BY item_id, sent, block ORDER BY pos_text)
    ), ngrams AS ({" UNION ALL ".join(sizes)}
    ), candidates AS (
        SELECT item_id, norm_kw, arg_min(kw, pos_text) AS kw, min(pos_text * 64 + size) AS ord, CAST(any_value(size) AS INT) AS size, count(*) AS tf, bool_or(clean) AS clean,
               any_value(product) / ((any_value(total) + 1) * {"count(*)" if "KPF" in on else "1"}) AS h FROM ngrams GROUP BY 1, 2
    )"""


SIM_PAIRS = """
    WITH RECURSIVE k AS (SELECT DISTINCT id, "sentenceIds"[1] AS s, "normalizedKeyword" AS a FROM kaggle_excerpt
               WHERE "normalizedKeyword" IS NOT NULL AND "sentenceIds"[1] IS NOT NULL),
    pairs AS (SELECT DISTINCT x.a, y.a AS b FROM k x JOIN k y ON x.id = y.id AND x.s = y.s AND x.a < y.a)"""
RANKED = """
    WITH k AS (SELECT id AS doc, "normalizedKeyword" AS item, min(score) AS score FROM kaggle_excerpt WHERE score IS NOT NULL AND "normalizedKeyword" IS NOT NULL GROUP BY 1, 2),
    r AS (SELECT doc, item, row_number() OVER (PARTITION BY doc ORDER BY score, item) AS rank, row_number() OVER (PARTITION BY doc ORDER BY length(item) DESC, item) AS long_rank FROM k)"""
LISTS = f"""SELECT DISTINCT lower(left(lang, 2)) AS lang, lower(regexp_replace(word, '^{WHITE}+|{WHITE}+$', '', 'g')) AS word
    FROM stopwords WHERE lang IS NOT NULL AND regexp_replace(word, '^{WHITE}+|{WHITE}+$', '', 'g') <> ''"""
TRIM_TITLE = f"regexp_replace(coalesce(title, ''), '^{WHITE}+|{WHITE}+$', '', 'g')"


def chars(x: str) -> str:
    """The characters of a string: DuckDB splits strings by what looks like one, and counts bytes in levenshtein."""
    return f"list_transform(range(1, length({x}) + 1), lambda i: substring({x}, i, 1))"


def words(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), '[^{WHITE[1:-1]}]+'))"


def blanks(x: str) -> str:
    return f"(length({x}) - length(replace({x}, ' ', '')))"


def grams(x: str) -> str:
    return f"list_distinct(list_transform(range(1, length({x}) - 1), lambda i: substring(lower({x}), i, 3)))"


#: likeness AS (a, b, likeness) of the pairs (a, b), by each similarity.
SEQM = f"""
    parts AS (SELECT *, greatest(length(a), length(b)) AS longest, least(length(a), length(b)) AS shortest,
        list_distinct({chars("lower(a)")}) AS ca, list_distinct({chars("lower(b)")}) AS cb, {words("a")} AS wa, {words("b")} AS wb,
        len(regexp_extract_all(a, '[^{WHITE[1:-1]}]+')) > 1 OR len(regexp_extract_all(b, '[^{WHITE[1:-1]}]+')) > 1 AS many, {grams("a")} AS ta, {grams("b")} AS tb FROM pairs),
    shares AS (SELECT *, len(list_intersect(ca, cb)) / len(list_distinct(list_concat(ca, cb))) AS chars,
        CASE WHEN len(list_concat(wa, wb)) = 0 THEN 0 ELSE len(list_intersect(wa, wb)) / len(list_distinct(list_concat(wa, wb))) END AS words,
        CASE WHEN len(list_concat(ta, tb)) = 0 THEN 0 ELSE len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))) END AS grams FROM parts),
    likeness AS (SELECT a, b, CASE WHEN a = b THEN 1 WHEN abs(length(a) - length(b)) > 0.6 * longest OR abs({blanks("a")} - {blanks("b")}) > 1 THEN 0
        WHEN longest > 3 AND shortest > 0 AND (left(a, 1) <> left(b, 1) OR right(a, 1) <> right(b, 1) OR shortest >= 3 AND lower(left(a, 2)) <> lower(left(b, 2))) THEN 0
        WHEN shortest / longest < 0.3 OR chars < 0.2 THEN 0
        WHEN longest <= 4 THEN chars * (shortest / longest)
        WHEN many AND words > 0.4 THEN words
        ELSE least(0.3 * (shortest / longest) + 0.2 * chars + 0.5 * grams, 1) END AS likeness FROM shares)"""
LEVS = f"""
    spelt AS (SELECT a, b, list_distinct(list_concat({chars("a")}, {chars("b")})) AS u, {chars("a")} AS ca, {chars("b")} AS cb FROM pairs),
    bytes AS (SELECT a, b, array_to_string(list_transform(ca, lambda c: chr(CAST(31 + list_position(u, c) AS INT))), '') AS x,
        array_to_string(list_transform(cb, lambda c: chr(CAST(31 + list_position(u, c) AS INT))), '') AS y FROM spelt),
    likeness AS (SELECT a, b, levenshtein(x, y) AS distance, CASE WHEN a = b THEN 1 ELSE 1 - levenshtein(x, y) / greatest(length(a), length(b)) END AS likeness FROM bytes)"""
JARO = f"""
    spelt AS (SELECT a, b, {chars("a")} AS ca, {chars("b")} AS cb, greatest(greatest(length(a), length(b)) // 2 - 1, 0) AS reach FROM pairs),
    step(a, b, i, used, hits) AS (
        SELECT a, b, 0::BIGINT, []::BIGINT[], []::VARCHAR[] FROM spelt UNION ALL
        SELECT a, b, i + 1, CASE WHEN j IS NULL THEN used ELSE list_append(used, j) END, CASE WHEN j IS NULL THEN hits ELSE list_append(hits, ca[i + 1]) END FROM (
            SELECT step.*, s.ca, list_filter(range(greatest(1, i + 1 - reach), least(length(b), i + 1 + reach) + 1), lambda j: s.cb[j] = s.ca[i + 1] AND NOT list_contains(used, j))[1] AS j
            FROM step JOIN spelt s USING (a, b) WHERE i < length(a))),
    ended AS (SELECT step.*, list_transform(list_sort(used), lambda j: s.cb[j]) AS other, len(used) AS m FROM step JOIN spelt s USING (a, b) WHERE i = length(a)),
    likeness AS (SELECT a, b, CASE WHEN a = b THEN 1 WHEN m = 0 THEN 0
        ELSE (m / length(a) + m / length(b) + (m - len(list_filter(range(1, m + 1), lambda k: hits[k] <> other[k])) / 2) / m) / 3 END AS likeness FROM ended)"""


def greedy(likeness: str, limit: float, top: int) -> str:
    """taken AS (id, item, rank): of ranked AS (id, item, pos), the first rows that are no more like an earlier one taken than a limit."""
    return f"""
    pairs AS (SELECT DISTINCT x.item AS a, y.item AS b FROM ranked x JOIN ranked y ON x.id = y.id AND y.pos < x.pos), {likeness},
    barred AS (SELECT x.id, x.pos, list(y.pos) AS earlier FROM ranked x JOIN ranked y ON x.id = y.id AND y.pos < x.pos
        JOIN likeness l ON l.a = x.item AND l.b = y.item WHERE l.likeness > {limit} GROUP BY 1, 2),
    walk(id, pos, kept) AS (
        SELECT DISTINCT id, 0::BIGINT, []::BIGINT[] FROM ranked UNION ALL
        SELECT w.id, w.pos + 1, CASE WHEN len(kept) < {top} AND NOT list_has_any(coalesce(earlier, []), kept) THEN list_append(kept, w.pos + 1) ELSE kept END
        FROM walk w JOIN ranked r ON r.id = w.id AND r.pos = w.pos + 1 LEFT JOIN barred b ON b.id = w.id AND b.pos = w.pos + 1),
    taken AS (SELECT r.id, r.item, list_position(kept, r.pos) AS rank FROM (SELECT id, arg_max(kept, pos) AS kept FROM walk GROUP BY 1) k JOIN ranked r ON r.id = k.id AND list_contains(kept, r.pos))"""


RESULTS = """
    WITH RECURSIVE best AS (SELECT id, "normalizedKeyword" AS item, min(score) AS score FROM kaggle_excerpt
        WHERE id IS NOT NULL AND score IS NOT NULL AND "normalizedKeyword" IS NOT NULL GROUP BY 1, 2),
    ranked AS (SELECT id, item, row_number() OVER (PARTITION BY id ORDER BY score, item) AS pos FROM best),"""


def item_keywords(likeness: str | None, limit: float = 1.0, top: int = 20, tokens: str = ITEM_TOKENS) -> str:
    """Keywords of up to two words: candidates in order, scores closer than 1e-15 by place, without near duplicates."""
    rest = greedy(likeness, limit, top) if likeness else f" taken AS (SELECT id, item, pos AS rank FROM ranked WHERE pos <= {top})"
    return (
        stages(n=2, tokens=tokens).replace("WITH ", "WITH RECURSIVE ", 1)
        + f""", apart AS (SELECT *, CAST(h - lag(h, 1, -1) OVER (PARTITION BY item_id ORDER BY h, ord) > 1e-15 AS INT) AS new FROM candidates WHERE clean),
        tied AS (SELECT *, sum(new) OVER (PARTITION BY item_id ORDER BY h, ord) AS run FROM apart),
        ranked AS (SELECT item_id AS id, norm_kw AS item, row_number() OVER (PARTITION BY item_id ORDER BY run, ord) AS pos FROM tied),{rest},
        sents AS (SELECT k.id, k.item, array_to_string(list_sort(list_distinct(flatten(list(t.ids)))), ',') AS sentence_ids
            FROM (SELECT id, item, unnest(string_split(item, ' ')) AS w FROM taken) k JOIN terms t ON t.item_id = k.id
            AND t.term = CASE WHEN length(w) > 3 AND ends_with(w, 's') THEN left(w, length(w) - 1) ELSE w END GROUP BY 1, 2)
        SELECT c.item_id, CAST(t.rank AS INT) AS rank, c.kw AS keyword, c.norm_kw AS normalized_keyword, round(c.h, 9) AS score, c.size AS ngram_size,
            c.tf AS occurrences, s.sentence_ids FROM taken t JOIN candidates c ON c.item_id = t.id AND c.norm_kw = t.item JOIN sents s ON s.id = t.id AND s.item = t.item"""
    )


COUNTED = stages() + """, low AS (SELECT item_id, sent, pos_sent, lower(word) AS w, lower(word) IN (SELECT w FROM list WHERE w <> '' AND key = 'en') AS stop FROM raw),
    grams AS (SELECT item_id, w, stop, [w, lag(w) OVER s || ' ' || w, lag(w, 2) OVER s || ' ' || lag(w) OVER s || ' ' || w] AS g,
            [stop, lag(stop) OVER s, lag(stop, 2) OVER s] AS first FROM low WINDOW s AS (PARTITION BY item_id, sent ORDER BY pos_sent)),
    counted AS (SELECT item_id, g[i] AS phrase, count(*) AS n FROM grams, (SELECT unnest([1, 2, 3]) AS i)
        WHERE NOT stop AND NOT first[i] AND g[i] IS NOT NULL AND (i > 1 OR length(w) >= 3) GROUP BY 1, 2)"""
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "''", "&rsquo;": "’", "&lsquo;": "‘", "&rdquo;": "”", "&ldquo;": "“", "&mdash;": "—", "&ndash;": "–", "&amp;": "&"}


def page_text() -> str:
    x = """'<html><style>p {}</style><script>var a = ''<b>'';</script><p>' || replace(body, chr(10), '</p>' || chr(10) || '<p class=''x''>') || '</p>&mdash;&nbsp;&#39;&bogus;&amp;lt;</html>'"""
    for kind in ("script", "style"):
        x = f"regexp_replace({x}, '(?is)<{kind}\\b.*?</{kind}\\s*>', ' ', 'g')"
    x = f"regexp_replace({x}, '(?s)<[^>]*>', ' ', 'g')"
    for entity, to in ENTITIES.items():
        x = f"replace({x}, '{entity}', '{to}')"
    return f"trim(regexp_replace(regexp_replace({x}, '&[A-Za-z0-9#]+;', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"


def stage_sql(tokens: str) -> dict[str, str]:
    """The queries of the stages over one source of tokens."""
    candidate = "SELECT item_id, norm_kw, kw, size, tf, round(h, 9) AS h FROM candidates WHERE clean"
    return {
        "tokenize": stages(tokens=tokens) + "SELECT item_id, sent, pos_sent, block, pos_text, word, norm, term FROM tags",
        "token_tags": stages(tokens=tokens) + "SELECT item_id, pos_text, word, tag, stop_form FROM tags",
        "term_frequency": stages(tokens=tokens) + "SELECT item_id, term, tf, tf_a, tf_n, stopword, first_pos, CAST(in_sentences AS INT) AS in_sentences, array_to_string(ids, ',') AS sentence_ids FROM terms",
        "doc_term_stats": stages(tokens=tokens) + "SELECT item_id, sentences, words, max_tf, round(avg_tf, 9) AS avg_tf, round(std_tf, 9) AS std_tf FROM stats",
        "cooccurrence_edges": stages(tokens=tokens) + "SELECT * FROM edges",
        "cooccurrence_window2": stages(2, tokens=tokens) + "SELECT * FROM edges",
        "graph_metrics": stages(tokens=tokens) + "SELECT * FROM metrics",
        "term_scores": stages(tokens=tokens) + "SELECT item_id, term, round(wrel, 9) AS wrel, round(wfreq, 9) AS wfreq, round(wspread, 9) AS wspread, round(wcase, 9) AS wcase, round(wpos, 9) AS wpos, round(h, 9) AS h FROM scores",
        "candidate_scores": stages(tokens=tokens) + candidate,
        "candidate_scores_no_kpf": stages(features="wrel wfreq wspread wcase wpos", tokens=tokens) + candidate,
        "candidate_scores_wfreq_only": stages(features="wfreq", tokens=tokens) + candidate,
        "candidate_validity": stages(tokens=tokens) + "SELECT size, clean, count(*) AS candidates, CAST(sum(tf) AS BIGINT) AS occurrences FROM candidates GROUP BY 1, 2",
        "ngram_freq_by_size": stages(n=4, tokens=tokens) + "SELECT size, CAST(sum(tf) AS BIGINT) AS occurrences FROM candidates WHERE size > 1 GROUP BY 1",
        "bio_decode": stages(tokens=tokens) + """, t AS (SELECT item_id, pos_text, word, CASE WHEN NOT regexp_matches(word, '^[A-Z]') THEN 'O' WHEN pos_text % 2 = 0 THEN 'B' ELSE 'I' END AS tag FROM tags),
            s AS (SELECT *, tag = 'B' OR tag = 'I' AND lag(tag, 1, 'O') OVER (PARTITION BY item_id ORDER BY pos_text) = 'O' AS starts FROM t),
            g AS (SELECT *, sum(CAST(starts AS INT)) OVER (PARTITION BY item_id ORDER BY pos_text) AS n FROM s)
            SELECT item_id, min(pos_text) AS "begin", string_agg(word, ' ' ORDER BY pos_text) AS phrase FROM g WHERE tag <> 'O' GROUP BY item_id, n""",
    }


def oracle_sql() -> dict[str, str]:
    return {
        "pre_filter": f"""SELECT DISTINCT id, array_to_string(list_transform(string_split(body, chr(10)),
            lambda x: CASE WHEN regexp_matches(x, '^{WHITE}*[A-Z]') THEN chr(10) || chr(10) ELSE ' ' END || replace(x, chr(9), ' ')), '') AS filtered FROM input_document""",
        **stage_sql(ITEM_TOKENS),
        **{f"{k}_documents": v if k in ("candidate_validity", "ngram_freq_by_size") else f"SELECT * RENAME (item_id AS doc_id) FROM ({v})" for k, v in stage_sql(DOCUMENT_TOKENS).items()},
        "stopword_lookup": LISTS,
        "supported_languages": "SELECT DISTINCT lower(left(lang, 2)) AS lang FROM stopwords WHERE lang IS NOT NULL",
        "stopword_set_algebra": f"""WITH l AS ({LISTS})
            SELECT * FROM (SELECT * FROM l WHERE lang <> 'de' UNION VALUES ('en', 'whilst'), ('en', 'amongst'), ('de', 'und'), ('de', 'oder'))
            WHERE NOT (lang = 'en' AND word IN ('quite', 'often'))""",
        "resolve_language": "SELECT DISTINCT id, coalesce(language, 'en') AS lang, lower(left(coalesce(language, 'en'), 2)) AS list FROM input_document",
        "title_body": f"""SELECT DISTINCT id, CASE WHEN {TRIM_TITLE} <> '' THEN {TRIM_TITLE} || chr(10) || chr(10) ELSE '' END || coalesce(body, '') AS text FROM input_document""",
        "sim_levenshtein": SIM_PAIRS + "," + LEVS + "SELECT a, b, distance, round(likeness, 9) AS likeness FROM likeness",
        "sim_seqm": SIM_PAIRS + "," + SEQM + "SELECT a, b, round(likeness, 9) AS likeness FROM likeness",
        "sim_jaro": SIM_PAIRS + "," + JARO + "SELECT a, b, round(likeness, 9) AS likeness FROM likeness",
        "trigrams": """WITH k AS (SELECT DISTINCT "normalizedKeyword" AS term FROM kaggle_excerpt)
            SELECT DISTINCT term, unnest(list_transform(range(1, length(term) - 1), lambda i: substring(term, i, 3))) AS trigram FROM k""",
        "dedup_seqm": RESULTS + greedy(SEQM, 0.5, 20) + "SELECT id, item, CAST(rank AS INT) AS rank FROM taken",
        "dedup_levs": RESULTS + greedy(LEVS, 0.4, 5) + "SELECT id, item, CAST(rank AS INT) AS rank FROM taken",
        "dedup_jaro": RESULTS + greedy(JARO, 0.65, 20) + "SELECT id, item, CAST(rank AS INT) AS rank FROM taken",
        "candidate_order": RESULTS + """ small AS (SELECT id, item, floor(score * 10) AS s FROM best WHERE NOT item LIKE '% % %')
            SELECT id, item, CAST(row_number() OVER (PARTITION BY id ORDER BY s, item) AS INT) AS rank FROM small""",
        "keywords_items_seqm": item_keywords(SEQM, 0.7),
        "keywords_items_levs": item_keywords(LEVS, 0.6, 10),
        "keywords_items_top": item_keywords(None),
        "topk_no_dedup": f"SELECT * RENAME (item_id AS doc_id) FROM ({item_keywords(None, tokens=DOCUMENT_TOKENS)})",
        "result_documents": """SELECT id, coalesce(d.language, 'en') AS language, d.title AS title, map_keys(d.metadata)[1] IS NOT NULL AS has_metadata, true AS few
            FROM (SELECT id, arg_max(struct_pack(language, title, metadata), arrived_at) AS d FROM input_document GROUP BY 1)""",
        "candidate_counts": COUNTED + "SELECT * FROM counted",
        "text_tfidf": COUNTED + """, held AS (SELECT phrase, count(*) AS df FROM counted GROUP BY 1), total AS (SELECT count(DISTINCT item_id) AS docs FROM counted)
            SELECT item_id AS doc, phrase AS term, n AS tf, df, round(n * (ln((1 + docs) / (1 + df)) + 1), 9) AS score FROM counted JOIN held USING (phrase), total""",
        "date_sections": """WITH t AS (SELECT doc_id, strftime(committed_at, '%-m/%-d/%y') AS day, text FROM documents),
            p AS (SELECT doc_id, unnest(string_split(regexp_replace(day || chr(10) || replace(text, chr(10) || chr(10), chr(10) || day || chr(10)),
                '\\b(\\d{1,2}/\\d{1,2}/\\d{2})\\b', chr(1) || '\\1' || chr(2), 'g'), chr(1))[2:]) AS part FROM t),
            d AS (SELECT doc_id, string_split(part, chr(2))[1] AS raw_date, regexp_replace(substring(part, position(chr(2) IN part) + 1), '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g') AS section FROM p)
            SELECT doc_id, raw_date, '20' || string_split(raw_date, '/')[3] || '-' || lpad(string_split(raw_date, '/')[1], 2, '0') || '-' || lpad(string_split(raw_date, '/')[2], 2, '0') AS iso_date,
                section FROM d WHERE length(section) >= 200""",
        "html_text": f"SELECT DISTINCT id, {page_text()} AS text FROM input_document",
        "tfidf": """WITH f AS (SELECT id AS doc, "normalizedKeyword" AS term, CAST(sum(coalesce(occurrences, 0)) AS BIGINT) AS tf
                FROM (SELECT DISTINCT result_id, id, "normalizedKeyword", occurrences FROM kaggle_excerpt) WHERE "normalizedKeyword" IS NOT NULL AND id IS NOT NULL GROUP BY 1, 2),
            d AS (SELECT term, count(*) AS df FROM f GROUP BY 1), n AS (SELECT count(DISTINCT doc) AS n FROM f)
            SELECT doc, term, tf, df, round(tf * (ln((1 + n) / (1 + df)) + 1), 9) AS score FROM f JOIN d USING (term), n""",
        "topk_overlap": RANKED + "SELECT doc, count(*) FILTER (long_rank <= 3) AS overlap FROM r WHERE rank <= 3 GROUP BY 1",
        "precision_at_k": RANKED + """SELECT doc, count(*) FILTER ((doc, item) IN (SELECT (id, "normalizedKeyword") FROM kaggle_excerpt WHERE occurrences > 1)) / 3 AS precision FROM r WHERE rank <= 3 GROUP BY 1""",
        "leading_prefix": RANKED + "SELECT doc, coalesce(min(rank) FILTER (rank <> long_rank), max(rank) + 1) - 1 AS matches FROM r GROUP BY 1",
        "latency_percentiles": """SELECT event_type, count(value) AS n, round(sum(value), 2) AS total, round(avg(value), 6) AS mean,
            round(quantile_disc(value, 0.5), 9) AS p50, round(quantile_disc(value, 0.95), 9) AS p95 FROM events GROUP BY 1""",
    }
