"""SQL for DuckDB that says the same as the queries: pieces of it, then a statement for each query."""

from __future__ import annotations

SPACE = r"\t-\r\x1C-\x1F \x{85}\p{Z}"
WORD = r"\p{L}\p{N}_"
LF = "chr(10)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def normalized(x: str) -> str:
    x = rf"regexp_replace({x}, '([{WORD}])-\n([{WORD}])', '\1\2', 'g')"
    x = f"replace(replace({x}, chr(13) || {LF}, {LF}), chr(13), {LF})"
    x = rf"regexp_replace({x}, '[ \t\x0B\r\f]+', ' ', 'g')"
    x = rf"regexp_replace({x}, '\n{{3,}}', {LF} || {LF}, 'g')"
    return strip(rf"regexp_replace({x}, '[ \x{{85}}\p{{Z}}\x1C-\x1F]+(\n|$)', '\1', 'g')")


def cleaned(x: str, deep: bool) -> str:
    x = rf"regexp_replace(coalesce({x}, ''), '[\x00-\x08\x0B-\x1F\x7F]', '', 'g')"
    if deep:
        x = rf"regexp_replace({x}, '([{WORD}])-\n([{WORD}])', '\1\2', 'g')"
    return strip(rf"regexp_replace(regexp_replace({x}, '[ \t]+', ' ', 'g'), '\n{{3,}}', {LF} || {LF}, 'g')")


def tokens(x: str) -> str:
    return f"regexp_extract_all({x}, '[{WORD}]+|[^{WORD}{SPACE}]')"


def detokenized(t: str) -> str:
    closing = "('.', ',', ':', ';', '?', '!', ')', ']', '}')"
    return f"array_to_string(list_transform({t}, lambda w, i: CASE WHEN i = 1 OR w IN {closing} OR (i = 2 AND {t}[1] IN ('(', '[', '{{')) THEN w ELSE ' ' || w END), '')"


def heading(x: str) -> str:
    letters = f"regexp_replace({x}, '[^A-Za-z]', '', 'g')"
    numbered = rf"regexp_matches({x}, '^\p{{Nd}}+(\.\p{{Nd}}+)*[{SPACE}]+[^{SPACE}]+')"
    return f"(length({x}) > 0 AND ({numbered} OR (length({letters}) >= 6 AND {letters} = upper({letters})) OR (ends_with({x}, ':') AND length({x}) <= 80)))"


def quick(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[{SPACE}]+'), lambda w: w <> '')"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def chars(x: str, c: str) -> str:
    return f"(length({x}) - length(replace({x}, '{c}', '')))"


def ratio(a: str, b: str) -> str:
    return f"coalesce(({a})::DOUBLE / nullif({b}, 0), 0.0)"


def features(x: str) -> str:
    capital = rf"list_filter({quick(x)}, lambda w: regexp_matches(w, '\p{{L}}') AND NOT regexp_matches(w, '[\p{{Ll}}\p{{Lt}}\p{{Lm}}\p{{Lo}}]'))"
    return f"""len({quick(x)})::BIGINT AS n_tokens, {ratio(count(x, chr(92) + 'p{L}'), f'length({x})')} AS alpha, {ratio(count(x, chr(92) + 'p{Nd}'), f'length({x})')} AS digits,
    {ratio(f'len({capital})', f'len({quick(x)})')} AS capitals, {ratio(f'{chars(x, "=")} * 100.0', f'length({x})')} AS equals"""


def flags(x: str) -> str:
    low = f"lower({x})"
    years = count(low, r"\b(19|20)[0-9]{2}\b")
    markers = " + ".join(count(low, m.replace(".", r"\.")) for m in ("et al", "doi", "journal", "vol.", "pp.", "http", "www."))
    defined = count(x, rf"\b[A-Z]{{2,}}\b[{SPACE}]*(?:=|:)[{SPACE}]*")
    return f"""(n_tokens < 40 OR alpha < 0.55 OR digits > 0.25 OR capitals > 0.35 OR equals > 1.5) AS low_signal,
    (({years} >= 3 AND {chars(low, ';')} >= 3) OR ({markers} >= 2 AND {years} >= 2)) AS reference_like,
    ((capitals >= 0.40 AND (equals >= 1.0 OR {defined} >= 3)) OR {defined} >= 6) AS abbreviation_like"""


PAGES = "SELECT source AS doc_key, doc_id AS page, text FROM documents"
BASIC = f"SELECT source AS doc_key, doc_id AS page, {cleaned('text', False)} AS text FROM documents"
LINES = f"""lines0 AS (SELECT doc_key, page, unnest(string_split(x, {LF})) AS l, generate_subscripts(string_split(x, {LF}), 1) AS line FROM (SELECT doc_key, page, {normalized('text')} AS x FROM pages)),
lines AS (SELECT doc_key, page, line - 1 AS line, s AS text, {heading('s')} AS heading FROM (SELECT *, {strip('l')} AS s FROM lines0) WHERE s <> '')"""


def windows(size: int, overlap: int) -> str:
    """CTEs pages -> naive (doc, doc_key, chunk_id, page, w)."""
    step = max(1, size - overlap)
    return f"""tok AS (SELECT doc_key, page, {tokens(normalized('text'))} AS t FROM pages),
    naive AS (SELECT doc_key, page, printf('p%04d_n%04d', page, (i / {step})::BIGINT) AS chunk_id, t[i + 1 : i + {size}] AS w FROM (SELECT doc_key, page, t, unnest(range(0, len(t), {step})) AS i FROM tok WHERE len(t) > 0)),
    chunks AS (SELECT doc_key || '|' || chunk_id AS doc, doc_key, chunk_id, page AS page_start, page AS page_end, {detokenized('w')} AS text FROM naive)"""


_ACCENTED, _PLAIN = "ÄÇÈÉÊÍÑÓÖÜäçèéêíñóöüáâîú", "ACEEEINOOUaceeeinoouaaiu"


def grams(x: str) -> str:
    words = f"regexp_extract_all(translate(lower({x}), '{_ACCENTED}', '{_PLAIN}'), '[{WORD}]{{2,}}')"
    return f"list_concat({words}, CASE WHEN len({words}) > 1 THEN list_transform(list_zip({words}[1 : len({words}) - 1], {words}[2 :]), lambda p: p[1] || ' ' || p[2]) ELSE [] END)"


def tfidf(docs: str = "chunks", name: str = "") -> str:
    """CTEs docs (doc, text) and questions -> tf, idf, dw, qw, dense (qid, doc, score)."""
    return f"""counts AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(g) AS term FROM (SELECT doc, {grams('text')} AS g FROM {docs})) GROUP BY ALL),
    idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM {docs})) / (1.0 + count(*))) + 1 AS idf FROM counts GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 60000),
    qc AS (SELECT qid, term, count(*) AS tf FROM (SELECT qid, unnest(g) AS term FROM (SELECT qid, {grams('text')} AS g FROM questions)) GROUP BY ALL),
    dw AS (SELECT doc, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS w FROM (SELECT doc, term, tf * idf AS w FROM counts JOIN idf USING (term))),
    qw AS (SELECT qid, term, w / sqrt(sum(w * w) OVER (PARTITION BY qid)) AS w FROM (SELECT qid, term, tf * idf AS w FROM qc JOIN idf USING (term))),
    dense AS (SELECT qid, doc, coalesce(s, 0.0) AS score FROM (SELECT doc FROM {docs}) CROSS JOIN (SELECT qid FROM questions) LEFT JOIN (SELECT qid, doc, sum(dw.w * qw.w) AS s FROM dw JOIN qw USING (term) GROUP BY ALL) USING (qid, doc))"""


def bm25(docs: str = "chunks") -> str:
    """CTEs docs and questions -> lex (qid, doc, score)."""
    return f"""toks AS (SELECT doc, {tokens(normalized('text'))} AS t FROM {docs}),
    size AS (SELECT count(*) AS n, avg(len(t)) AS mean_len FROM toks),
    post AS (SELECT doc, len, term, count(*) AS tf FROM (SELECT doc, len(t) AS len, unnest(t) AS term FROM toks) GROUP BY ALL),
    raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM post, size GROUP BY term, n),
    bidf AS (SELECT term, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
    bq AS (SELECT qid, term, count(*) AS nq FROM (SELECT qid, unnest({tokens(normalized('text'))}) AS term FROM questions) GROUP BY ALL),
    lex AS (SELECT qid, doc, coalesce(s, 0.0) AS score FROM (SELECT doc FROM {docs}) CROSS JOIN (SELECT qid FROM questions) LEFT JOIN (SELECT qid, doc, sum(idf * nq * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean_len))) AS s FROM post JOIN bq USING (term) JOIN bidf USING (term), size GROUP BY ALL) USING (qid, doc))"""


def top(scores: str, k: int) -> str:
    return f"SELECT * FROM (SELECT qid, doc, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc)::BIGINT AS rank FROM {scores}) WHERE rank <= {k}"


QUESTIONS = "SELECT item_id AS qid, text FROM benchmark"
_HYBRID = """best AS ({dense}), lbest AS ({lex}),
cand AS (SELECT qid, doc FROM best UNION SELECT qid, doc FROM lbest),
fill AS (SELECT qid, doc, round(coalesce(best.score, 0.0), 9) AS d, round(coalesce(lex.score, 0.0), 9) AS l FROM cand LEFT JOIN best USING (qid, doc) LEFT JOIN lex USING (qid, doc)),
span AS (SELECT *, min(d) OVER q AS d0, max(d) OVER q AS d1, min(l) OVER q AS l0, max(l) OVER q AS l1 FROM fill WINDOW q AS (PARTITION BY qid)),
hyb AS (SELECT qid, doc, 0.5 * CASE WHEN d1 - d0 < 1e-9 THEN 1.0 ELSE (d - d0) / nullif(d1 - d0, 0) END + 0.5 * CASE WHEN l1 - l0 < 1e-9 THEN 1.0 ELSE (l - l0) / nullif(l1 - l0, 0) END AS score FROM span)"""


def hybrid(lexical: int = 50) -> str:
    return _HYBRID.format(dense=top("dense", 50), lex=top("lex", lexical))


DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"


def dot(a: str, b: str) -> str:
    return DOT.format(a=a, b=b)


def cosine(a: str, b: str) -> str:
    return f"coalesce({dot(a, b)} / nullif(sqrt({dot(a, a)}) * sqrt({dot(b, b)}), 0), 0.0)"


VECTORS = "SELECT vec_id AS doc, embedding AS vec FROM embeddings"
#: Every vector whose number is divisible by 100 is a query.
VECTOR_QUERIES = "SELECT vec_id AS qid FROM embeddings WHERE vec_id % 100 = 0"
KNN = f"""vecs AS ({VECTORS}),
unit AS (SELECT doc, list_transform(vec, lambda x: x::DOUBLE / (sqrt({dot('vec', 'vec')}) + 1e-12)) AS u FROM vecs),
knn AS (SELECT * FROM (SELECT a.doc AS src, b.doc AS dst, row_number() OVER (PARTITION BY a.doc ORDER BY round({dot('a.u', 'b.u')}, 9) DESC, b.doc)::BIGINT AS nbr_rank FROM unit a JOIN unit b ON a.doc <> b.doc) WHERE nbr_rank <= 8)"""
EXPECTED = "expected AS (SELECT qid, page FROM pages JOIN questions ON contains(pages.text, questions.text))"
METRICS = "count(*)::BIGINT AS n, avg((coalesce(first_rank, 1 << 30) <= 1)::DOUBLE) AS hit_at_1, avg((coalesce(first_rank, 1 << 30) <= 3)::DOUBLE) AS hit_at_3, avg((coalesce(first_rank, 1 << 30) <= 5)::DOUBLE) AS hit_at_5, avg(coalesce(1.0::DOUBLE / first_rank, 0.0)) AS mrr, coalesce(avg(first_rank)::DOUBLE, 'Infinity'::DOUBLE) AS avg_first_rank"


def ranks(scores: str, k: int = 5) -> str:
    return f"found AS ({top(scores, k)}), ranks AS (SELECT qid, min(rank)::BIGINT AS first_rank FROM questions LEFT JOIN (SELECT qid, rank FROM found JOIN chunks USING (doc) JOIN expected USING (qid) WHERE page BETWEEN page_start AND page_end) USING (qid) GROUP BY qid)"


def chain(following: str, real: str = "true") -> str:
    """CTEs of chunks (doc_key, number, i, j): pieces i to before j of u (doc_key, i, page, x, n, c, total), the next one
    being `following`, a statement of (doc_key, i, j). Where not `real`, of i and j, no chunk begins."""
    return f"""nexts AS MATERIALIZED ({following}),
    steps AS (SELECT doc_key, 1::BIGINT AS i, (SELECT any_value(j) FROM nexts WHERE nexts.doc_key = u.doc_key AND nexts.i = 1) AS j FROM u WHERE u.i = 1 UNION ALL SELECT steps.doc_key, nexts.i, nexts.j FROM steps JOIN nexts ON nexts.doc_key = steps.doc_key AND nexts.i = steps.j),
    found AS (SELECT doc_key, i, j, row_number() OVER (PARTITION BY doc_key ORDER BY i) - 1 AS number FROM steps WHERE {real})"""


#: Units of the cleaned pages in their order: c, the tokens before one; and s (doc_key, t, c), the places between them.
UNITS = rf"""{LINES},
    parts AS (SELECT doc_key, page, line, CASE WHEN heading THEN [text] ELSE string_split(regexp_replace(text, '([.!?])[{SPACE}]+', '\1' || chr(1), 'g'), chr(1)) END AS p FROM lines),
    units AS (SELECT doc_key, page, line, unnest(list_filter(p, lambda x: x <> '')) AS x, generate_subscripts(list_filter(p, lambda x: x <> ''), 1) AS k FROM parts),
    sized AS (SELECT doc_key, page, x, len({tokens('x')}) AS n, row_number() OVER w AS i FROM units WINDOW w AS (PARTITION BY doc_key ORDER BY page, line, k)),
    u AS MATERIALIZED (SELECT *, (sum(n) OVER (PARTITION BY doc_key ORDER BY i) - n)::BIGINT AS c, (count(*) OVER (PARTITION BY doc_key))::BIGINT AS total FROM sized),
    s AS MATERIALIZED (SELECT doc_key, i AS t, c FROM u UNION ALL SELECT doc_key, total + 1, c + n FROM u WHERE i = total),
    firsts AS (SELECT doc_key, c, min(t) AS t FROM s GROUP BY ALL), ends AS (SELECT doc_key, c + n AS c, min(i) AS t FROM u GROUP BY ALL)"""


def boundaries(most: int = 450, least: int = 80, window: int = 6) -> str:
    """CTEs of chunks by soft boundaries, without a chooser."""
    following = f"""SELECT doc_key, i, CASE WHEN t IS NULL OR t = total + 1 THEN total + 1 WHEN fits >= low AND fc - c >= least THEN greatest(first, low) ELSE t END AS j
    FROM (SELECT a.*, {least} AS least, s.c AS fc, firsts.t AS first FROM (SELECT u.doc_key, u.i, u.c, total, f.t, i + greatest(1, f.t - i - {window}) AS low, CASE WHEN f.c = u.c + {most} THEN f.t ELSE greatest(f.t - 1, i) END AS fits
      FROM u ASOF LEFT JOIN firsts f ON f.doc_key = u.doc_key AND u.c + {most} <= f.c) a LEFT JOIN s ON s.doc_key = a.doc_key AND s.t = a.fits LEFT JOIN firsts ON firsts.doc_key = a.doc_key AND firsts.c = s.c)"""
    return chain(following)


def similarities(alike: str, most: int = 450, least: int = 80, threshold: float = 0.55) -> str:
    """CTEs of chunks that end where `alike` (doc_key, i, sim), a unit's likeness to the one before, is low."""
    following = f"""SELECT u.doc_key, u.i, least(greatest(coalesce(e.t, total + 1), coalesce(f.t, total + 1)), coalesce(l.i, total + 1)) AS j
    FROM (SELECT u.*, coalesce(e.t, total + 1) AS et FROM u ASOF LEFT JOIN firsts e ON e.doc_key = u.doc_key AND u.c + {least} <= e.c) u
    LEFT JOIN s e ON e.doc_key = u.doc_key AND e.t = u.et ASOF LEFT JOIN ends f ON f.doc_key = u.doc_key AND u.c + {most} + 1 <= f.c
    ASOF LEFT JOIN (SELECT doc_key, i FROM ({alike}) WHERE sim < {threshold}) l ON l.doc_key = u.doc_key AND u.et <= l.i"""
    return chain(following)


def semantic(alike: str, most: int = 450, least: int = 80) -> str:
    """A statement of the chunks of similarities(), the short last one put to the one before."""
    short = max(20, least // 2)
    return f"""WITH RECURSIVE pages AS ({BASIC}), {UNITS}, {similarities(alike)},
    texts AS (SELECT found.doc_key, number, min(page) AS page_start, max(page) AS page_end, string_agg(x, ' ' ORDER BY u.i) AS text, sum(n) AS tokens, any_value(j) > any_value(total) AS last FROM found JOIN u ON u.doc_key = found.doc_key AND u.i >= found.i AND u.i < j GROUP BY found.doc_key, number),
    put AS (SELECT *, number - (number > 0 AND last AND tokens < {short})::INT AS place FROM texts),
    whole AS (SELECT doc_key, place, printf('s%04d_p%04d-%04d', place, min_by(page_start, number), min_by(page_end, number)) AS chunk_id, min_by(page_start, number) AS page_start, max_by(page_end, number) AS page_end, string_agg(text, ' ' ORDER BY number) AS text FROM put GROUP BY doc_key, place)
    SELECT doc_key, chunk_id, page_start, page_end, length(text)::BIGINT AS n, md5(text) AS md5 FROM whole"""


_SPLIT = f"list_filter(regexp_split_to_array(lower(x), '[{SPACE}]+'), lambda w: w <> '')"
_COUNTED = "list_sum(list_transform(list_distinct({a}), lambda w: len(list_filter({a}, lambda v: v = w)) * len(list_filter({b}, lambda v: v = w))))"
#: The cosine of the counts of lower-cased words of a unit and the one before.
ALIKE_WORDS = f"""SELECT doc_key, i, coalesce({_COUNTED.format(a='a', b='b')} / nullif(sqrt(({_COUNTED.format(a='a', b='a')} * {_COUNTED.format(a='b', b='b')})::DOUBLE), 0), 0.0) AS sim
    FROM (SELECT doc_key, i, lag(w) OVER (PARTITION BY doc_key ORDER BY i) AS a, w AS b FROM (SELECT doc_key, i, {_SPLIT} AS w FROM u)) WHERE i > 1"""


def structured(most: int = 800, least: int = 120) -> str:
    """A statement of the sections between headings, cut at `most` tokens."""
    following = f"""SELECT u.doc_key, u.i, CASE WHEN heading THEN u.i + 1 WHEN h IS NOT NULL AND h <= coalesce(f.t, total + 1) THEN h ELSE least(coalesce(f.t, total) + 1, total + 1) END AS j
    FROM (SELECT *, min(i) FILTER (WHERE heading) OVER (PARTITION BY doc_key ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS h FROM u) u ASOF LEFT JOIN ends f ON f.doc_key = u.doc_key AND u.c + {most} <= f.c"""
    piece = f"w[part * {most} + 1 : part * {most} + {most}]"
    return f"""WITH RECURSIVE pages AS ({BASIC}), {LINES},
    sized AS (SELECT doc_key, page, text AS x, heading, CASE WHEN heading THEN [] ELSE {tokens('text')} END AS t, row_number() OVER (PARTITION BY doc_key ORDER BY page, line) AS i FROM lines),
    u AS MATERIALIZED (SELECT *, len(t) AS n, (sum(len(t)) OVER (PARTITION BY doc_key ORDER BY i) - len(t))::BIGINT AS c, (count(*) OVER (PARTITION BY doc_key))::BIGINT AS total,
      last_value(CASE WHEN heading THEN trim(text, ':') END IGNORE NULLS) OVER (PARTITION BY doc_key ORDER BY i) AS title FROM sized JOIN (SELECT doc_key AS dk, i AS di, x AS text FROM sized) ON dk = doc_key AND di = i),
    ends AS (SELECT doc_key, c + n AS c, min(i) AS t FROM u GROUP BY ALL),
    {chain(following, "EXISTS (SELECT 1 FROM u WHERE u.doc_key = steps.doc_key AND u.i >= steps.i AND u.i < steps.j AND n > 0)")},
    held AS (SELECT found.doc_key, number, min(page) FILTER (WHERE n > 0) AS page_start, max(page) AS page_end, any_value(title) AS section_title, flatten(list(t ORDER BY u.i)) AS w FROM found JOIN u ON u.doc_key = found.doc_key AND u.i >= found.i AND u.i < j GROUP BY found.doc_key, number),
    cut AS (SELECT *, {piece} AS p FROM (SELECT *, unnest(range(0, ((len(w) - 1) / {most})::BIGINT + 1)) AS part FROM held) WHERE part = 0 OR len({piece}) >= {least})
    SELECT doc_key, printf('s%04d_c%04d', number, part) AS chunk_id, page_start, page_end, section_title, length({detokenized('p')})::BIGINT AS n, md5({detokenized('p')}) AS md5 FROM cut WHERE len(p) > 0"""
