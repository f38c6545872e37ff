"""DuckDB SQL for the named queries, over the same parquet tables.

Each statement is a chain of common table expressions written independently of the Spark code: same
semantics, different engine. Only the fixed values (section and publication tables, white space, weights)
are shared.
"""

from __future__ import annotations

from broadsheet.functions.text import BLANKS
from broadsheet.schemas import FIELD_WEIGHTS, SOURCE_BY_PUBLICATION, section_categories


def _values(rows) -> str:
    def quoted(v: str) -> str:
        return "'" + v.replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(quoted(v) for v in row) + ")" for row in rows)


TOK = r"'[\p{L}\p{N}]+'"
RUN = f"'[^{BLANKS}]+'"
STRIP = f"'{BLANKS}'"


def strip(x: str) -> str:
    return f"trim({x}, {STRIP})"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {TOK})"


def tag_list(x: str) -> str:
    return (
        f"list_distinct(list_filter(list_transform(string_split({x}, ','), "
        f"lambda v: lower({strip('v')})), lambda v: v <> ''))"
    )


CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, needs: str, sql: str) -> None:
    CTES[name] = (tuple(needs.split()), sql)


cte("raw", "", """
SELECT doc_id AS ord,
  CASE WHEN doc_id % 97 = 13 THEN '   ' ELSE split_part(text, chr(10), 1) END AS title,
  CASE WHEN doc_id % 89 = 5 THEN 'not-a-date'
       ELSE strftime(DATE '2019-01-01' + CAST(n_chars % 365 AS INTEGER), '%Y-%m-%d') || ' 00:00:00'
  END AS date,
  CASE WHEN doc_id % 101 = 7 THEN NULL WHEN doc_id % 103 = 9 THEN 'None' ELSE text END AS article,
  CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 7 = 1 THEN 'None'
       ELSE 'Author ' || (doc_id % 23) END AS author,
  (['politics', 'Business News', 'Tech', 'US NBA', 'Health ', 'Editorial', 'Travel', 'world',
    'None', NULL, 'Unmapped Section', 'movies'])[doc_id % 12 + 1] AS section,
  CASE doc_id % 11 WHEN 0 THEN NULL WHEN 1 THEN 'Vice' WHEN 2 THEN 'Economist'
       WHEN 3 THEN ' Wired ' ELSE source END AS publication
FROM documents""")

cte("judged", "raw", f"""
SELECT ord, title, date, CASE
    WHEN title IS NULL OR {strip('title')} = '' THEN 'empty_title'
    WHEN article IS NULL OR article = 'None' OR {strip('article')} = '' THEN 'empty_article'
    WHEN len(regexp_extract_all(article, {RUN})) < 10 THEN 'too_short'
  END AS reason
FROM raw""")

cte("firsts", "judged", """
SELECT min(ord) AS ord FROM judged WHERE reason IS NULL GROUP BY title, date""")

cte("reasons", "judged firsts", """
SELECT j.ord, CASE WHEN j.reason IS NULL AND f.ord IS NULL THEN 'duplicate' ELSE j.reason END AS reason
FROM judged j LEFT JOIN firsts f ON f.ord = j.ord""")

cte("numbered", "firsts", "SELECT ord, row_number() OVER (ORDER BY ord) AS number FROM firsts")

cte("sections", "", f"SELECT * FROM (VALUES {_values(section_categories())}) t(section, category)")
cte("publications", "", f"SELECT * FROM (VALUES {_values(SOURCE_BY_PUBLICATION.items())}) t(name, shown)")

cte("articles", "raw numbered sections publications", f"""
SELECT n.ord, n.number, printf('nw_%07d', n.number) AS id, {strip('r.title')} AS title,
  r.article AS content,
  CASE WHEN length({strip('r.article')}) <= 250 THEN {strip('r.article')}
       ELSE regexp_replace(left({strip('r.article')}, 250), ' [^ ]*$', '') || '...' END AS summary,
  CASE WHEN r.author IS NULL OR r.author = 'None' THEN 'Unknown' ELSE r.author END AS author,
  coalesce(s.category, 'General') AS category,
  CASE WHEN r.section IS NULL OR r.section IN ('', 'None') THEN [] ELSE [r.section] END AS tags,
  CASE WHEN r.publication IS NULL OR r.publication = '' THEN 'Unknown'
       ELSE coalesce(p.shown, {strip('r.publication')}) END AS source,
  CASE WHEN try_strptime(split_part(r.date, ' ', 1), '%Y-%m-%d') IS NULL THEN r.date
       ELSE split_part(r.date, ' ', 1) END AS published_at,
  CAST(coalesce(epoch(try_strptime(split_part(r.date, ' ', 1), '%Y-%m-%d')), 0) AS BIGINT)
    AS published_ts,
  CAST(len(regexp_extract_all(r.article, {RUN})) AS INTEGER) AS word_count
FROM raw r JOIN numbered n ON n.ord = r.ord
LEFT JOIN sections s ON s.section = {strip('r.section')}
LEFT JOIN publications p ON p.name = {strip('r.publication')}""")

cte("docs", "articles", f"""
SELECT ord, id, title, category, source, author, lower(category) AS category_tag,
  {tag_list('source')} AS source_tags, lower({strip('author')}) AS author_tag,
  list_distinct(flatten(list_transform(tags, lambda t: {tag_list('t')}))) AS tag_values,
  published_ts, word_count
FROM articles""")

cte("field_tokens", "articles", " UNION ALL ".join(
    f"SELECT ord, '{f}' AS field, {w} AS weight, {tokens(f)} AS toks FROM articles"
    for f, w in FIELD_WEIGHTS.items()
))

cte("postings", "field_tokens", """
SELECT term, field, weight, ord, count(*) AS tf
FROM (SELECT ord, field, weight, unnest(toks) AS term FROM field_tokens) GROUP BY ALL""")

HEAD = "field IN ('title', 'summary')"

cte("doc_lengths", "field_tokens", f"""
SELECT ord, CAST(sum(weight * len(toks)) AS DOUBLE) AS dl FROM field_tokens WHERE {HEAD} GROUP BY ord""")

cte("head_terms", "postings", f"""
SELECT term, ord, CAST(sum(weight * tf) AS DOUBLE) AS tf FROM postings WHERE {HEAD}
GROUP BY term, ord""")

cte("head_df", "head_terms", "SELECT term, CAST(count(*) AS BIGINT) AS df FROM head_terms GROUP BY term")

cte("parts", "head_terms head_df doc_lengths", """
SELECT h.term, h.ord, ln(1 + (t.n - d.df + 0.5::DOUBLE) / (d.df + 0.5::DOUBLE))
  * h.tf * 2.2::DOUBLE / (h.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l.dl / t.avgdl)) AS part
FROM head_terms h JOIN head_df d ON d.term = h.term JOIN doc_lengths l ON l.ord = h.ord,
  (SELECT count(*) AS n, sum(dl) / count(*) AS avgdl FROM doc_lengths) t""")

cte("vocabulary", "postings", """
SELECT term, CAST(count(DISTINCT ord) AS BIGINT) AS df FROM postings GROUP BY term""")

cte("vecs", "docs", """
SELECT d.ord, d.id, d.category_tag, d.source_tags, e.embedding::DOUBLE[] AS v
FROM docs d JOIN embeddings e ON e.vec_id = d.ord""")

cte("log", "", f"""
SELECT conv_id * 1000 + turn AS query_id, text,
  CASE (conv_id + turn) % 5 WHEN 1 THEN 'Politics' WHEN 2 THEN 'World, politics ,Business'
    ELSE 'All' END AS categories,
  CASE (conv_id + turn) % 7 WHEN 3 THEN 'VICE,Wired' WHEN 4 THEN ' Unknown ' ELSE 'All' END AS sources,
  CASE (conv_id + turn) % 4 WHEN 1 THEN 'date_desc' WHEN 3 THEN 'date_asc' ELSE 'relevance' END AS sort,
  CASE WHEN (conv_id + turn) % 6 = 5 THEN 3 ELSE 0 END AS offset_, 10 AS limit_
FROM conversations WHERE role = 'user'""")

def parsed(log: str) -> str:
    return f"""
SELECT *, CASE WHEN categories = 'All' THEN [] ELSE {tag_list('categories')} END AS category_list,
  CASE WHEN sources = 'All' THEN [] ELSE {tag_list('sources')} END AS source_list,
  length({strip('text')}) >= 2 AS has_text,
  list_distinct({tokens('text')}) AS terms
FROM {log}"""


cte("parsed", "log", parsed("log"))
cte("phrases", "log", f"""
SELECT * EXCLUDE (query_id, text, ws, i), query_id * 1000000 + i AS query_id,
  array_to_string(ws[3 * i + 1:3 * i + 3], ' ') AS text
FROM (SELECT *, unnest(range(greatest(1, (len(ws) + 2) // 3))) AS i
  FROM (SELECT *, regexp_extract_all(text, {RUN}) AS ws FROM log))""")
cte("parsed_phrases", "phrases", parsed("phrases"))
cte("single_words", "log", f"""
SELECT * EXCLUDE (query_id, text, ws, i), query_id * 1000000 + i AS query_id, coalesce(ws[i + 1], '') AS text
FROM (SELECT *, unnest(range(greatest(1, len(ws)))) AS i FROM (SELECT *, regexp_extract_all(text, {RUN}) AS ws FROM log))""")
cte("parsed_words", "single_words", parsed("single_words"))

cte("log_vectors", "parsed", """
SELECT l.* EXCLUDE (query_id, place), l.query_id * 1000000 + e.vec_id AS query_id, e.embedding::DOUBLE[] AS v
FROM (SELECT *, row_number() OVER (ORDER BY query_id) - 1 AS place FROM parsed) l,
  (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM embeddings) e,
  (SELECT least((SELECT count(*) FROM parsed), (SELECT count(*) FROM embeddings)) AS least) m
WHERE l.place % m.least = e.place % m.least""")


def statement(needs: str, body: str, changed: str | None = None) -> str:
    """The body behind the tables it needs, in order of definition. ``changed`` redefines the articles, over
    the stored ones, for all tables made from them."""
    wanted: set[str] = set()

    def add(name: str) -> None:
        for n in CTES[name][0]:
            add(n)
        wanted.add(name)

    for name in needs.split():
        add(name)
    chain = ", ".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in CTES if n in wanted)
    if changed:
        stored = f"articles AS MATERIALIZED ({CTES['articles'][1]})"
        chain = chain.replace(stored, f"stored_{stored}, articles AS MATERIALIZED ({changed})")
    return f"WITH {chain} {body}" if chain else body


ORACLE: dict[str, str] = {}


def oracle(name: str, needs: str, body: str, changed: str | None = None) -> None:
    ORACLE[name] = statement(needs, body, changed)


# --- ingest ------------------------------------------------------------------------------------

FLAT = (
    "id, title, content, summary, author, category, array_to_string(tags, '|') AS tags, source, "
    "published_at, published_ts, word_count"
)
oracle("ingest_skip_reasons", "reasons", "SELECT ord, reason FROM reasons WHERE reason IS NOT NULL")
oracle("ingest_dedup", "firsts", "SELECT ord FROM firsts")
oracle("ingest_articles", "articles", f"SELECT {FLAT} FROM articles")
oracle("ingest_limited", "articles",
       "SELECT id, title, category, source, published_ts FROM articles WHERE number <= 500")


def _report(seen: str) -> str:
    return f"""
, seen AS (SELECT reason, {seen} AS seen FROM reasons)
SELECT 'total' AS section, 1 AS position, 'total_rows' AS name, count(*) AS n FROM seen
UNION ALL SELECT 'total', 2, 'loaded', count(*) FILTER (WHERE seen AND reason IS NULL) FROM seen
UNION ALL SELECT 'total', 3, 'skipped', count(*) FILTER (WHERE seen AND reason IS NOT NULL) FROM seen
UNION ALL SELECT 'reason', CAST(row_number() OVER (ORDER BY n DESC, reason) AS INTEGER), reason, n
FROM (SELECT reason, count(*) AS n FROM seen WHERE seen AND reason IS NOT NULL GROUP BY reason)"""


oracle("ingest_report", "reasons", _report("true"))
oracle("ingest_report_limited", "reasons numbered",
       _report("ord <= coalesce((SELECT ord FROM numbered WHERE number = 500), 9223372036854775807)"))
oracle("upsert_articles", "articles", """
SELECT id, CASE category WHEN 'World' THEN title || ' / 2' WHEN 'Sports' THEN title || ' / 1'
  ELSE title END AS title, category, word_count FROM articles""")

# --- index and lookup --------------------------------------------------------------------------

oracle("index_postings", "postings articles",
       "SELECT term, field, id, CAST(tf AS INTEGER) AS tf FROM postings JOIN articles USING (ord)")
oracle("index_doc_stats", "field_tokens articles",
       "SELECT id, field, CAST(len(toks) AS INTEGER) AS len FROM field_tokens JOIN articles USING (ord)")
oracle("index_terms", "head_df", "SELECT term, df FROM head_df")
oracle("index_stats", "postings articles", """
SELECT (SELECT count(*) FROM articles) AS num_docs, count(DISTINCT term) AS num_terms,
  count(*) AS num_postings FROM postings""")
oracle("index_sketches", "postings docs", """
, held AS (SELECT DISTINCT d.category_tag, p.term FROM postings p JOIN docs d ON d.ord = p.ord)
SELECT category_tag AS name, count(*) AS num_terms, true AS within_bound FROM held GROUP BY 1
UNION ALL SELECT 'All', count(DISTINCT term), true FROM held""")
oracle("get_articles", "articles", """
, ids AS (SELECT printf('nw_%07d', vec_id * 3 + 1) AS id, vec_id % 2 = 0 AS prefixed FROM embeddings)
SELECT CASE WHEN prefixed THEN 'article:' || i.id ELSE i.id END AS requested,
  a.id IS NOT NULL AS found, a.id AS id, a.title, a.category, a.word_count
FROM ids i LEFT JOIN articles a ON a.id = i.id""")

oracle("get_documents", "articles", f"""
, ids AS (SELECT printf('nw_%07d', vec_id * 3 + 1) AS requested FROM embeddings),
a AS (SELECT {FLAT} FROM articles)
SELECT i.requested, a.id IS NOT NULL AS found, a.* FROM ids i LEFT JOIN a ON a.id = i.requested""")
oracle("scan_raw_news", "raw", "SELECT title, date, article, author, section, publication FROM raw")

# --- filters and matching ----------------------------------------------------------------------


def matched(words: list[str], source: str = "head_terms") -> str:
    inlist = ", ".join(f"'{w}'" for w in words)
    return (
        f"(SELECT ord FROM {source} WHERE term IN ({inlist}) GROUP BY ord "
        f"HAVING count(DISTINCT term) = {len(words)})"
    )


oracle("text_match", "head_terms docs", f"SELECT id FROM docs WHERE ord IN {matched(['the', 'of'])}")
oracle("text_match_all_fields", "postings docs",
       f"SELECT id FROM docs WHERE ord IN {matched(['der', 'und', '2019'], 'postings')}")

# Characters outside ASCII never equal a character of these plain query words, so one stand-in byte
# each makes the byte-wise edit distance the distance in characters.
ASCII = r"regexp_replace(term, '[^\x00-\x7F]', '~', 'g')"


def near(words: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{w}' AS word, term, df FROM head_df WHERE levenshtein({ASCII}, '{w}') <= 2"
        for w in words
    )


oracle("fuzzy_match", "head_df", f"SELECT word, term, df FROM ({near(['thing', 'onthe'])})")
oracle("filter_category", "docs", "SELECT id, category FROM docs WHERE category_tag = 'politics'")
oracle("filter_sources_multi", "docs", """
SELECT id, source FROM docs WHERE list_has_any(source_tags, ['vice', 'wired', 'the economist'])""")
oracle("filter_author", "docs",
       "SELECT id, author FROM docs WHERE author_tag IN ('author 3', 'unknown')")


SPLIT_C = f"list_transform(string_split(categories, ','), lambda v: lower({strip('v')}))"
SPLIT_S = f"list_transform(string_split(sources, ','), lambda v: lower({strip('v')}))"
oracle("workload_filters", "parsed", f"""
SELECT query_id,
  CASE WHEN categories = 'All' THEN '' ELSE array_to_string({SPLIT_C}, '|') END AS category_list,
  CASE WHEN sources = 'All' THEN '' ELSE array_to_string({SPLIT_S}, '|') END AS source_list,
  has_text FROM parsed""")

# --- text search -------------------------------------------------------------------------------

def plain(x: str) -> str:
    """The letters outside ASCII that occur in these texts, one byte each: tokens are lower case, so
    capitals are free, and the byte-wise edit distance becomes the distance in characters."""
    return f"translate({x}, 'ßäçèéêíñóöü', 'ABCDEFGHIJK')"


MARKS = (
    r"array_to_string(list_transform(regexp_extract_all({x}, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+'), "
    "lambda r: CASE WHEN list_contains({q}, lower(r)) THEN '<mark>' || r || '</mark>' ELSE r END), '')"
)


def word_list(words: list[str] | str) -> str:
    """A list of words, or the name of a column that holds one."""
    return words if isinstance(words, str) else "[" + ", ".join(f"'{w}'" for w in words) + "]"


def is_near(t: str, q: str) -> str:
    """Whether a token is within two edits of a word of a list, and is a word at all."""
    return (
        f"(regexp_matches({t}, {TOK}) AND len(list_filter({q}, lambda y: abs(length(y) - length({t})) <= 2 "
        f"AND levenshtein({plain('y')}, {plain(t)}) <= 2)) > 0)"
    )


def marked(x: str, words: list[str] | str, fuzzy: bool = False) -> str:
    if fuzzy:
        runs = f"regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+')"
        test = is_near("lower(r)", word_list(words))
        return f"array_to_string(list_transform({runs}, lambda r: CASE WHEN {test} THEN '<mark>' || r || '</mark>' ELSE r END), '')"
    return MARKS.format(x=x, q=word_list(words))


def cut_to_window(x: str, words: list[str] | str, fuzzy: bool = False, length: int = 50) -> str:
    """The window of ``length`` words of ``x`` with the most of ``words``, the first on ties."""
    q = word_list(words)
    ws = f"regexp_extract_all({x}, {RUN})"
    hit = f"len(list_filter({tokens('w')}, lambda t: {is_near('t', q)})) > 0" if fuzzy else f"list_has_any({tokens('w')}, {q})"
    hits = f"list_transform({ws}, lambda w: CASE WHEN {hit} THEN 1 ELSE 0 END)"
    windows = (
        f"list_transform(range(1, len({ws}) - {length - 2}), "
        f"lambda i: [-list_sum({hits}[i:i + {length - 1}]), i])"
    )
    start = f"list_min({windows})[2]"
    return (
        f"CASE WHEN len({ws}) > {length} THEN array_to_string({ws}[{start}:{start} + {length - 1}], ' ') "
        f"ELSE {x} END"
    )


def exact(words: list[str]) -> str:
    inlist = ", ".join(f"'{w}'" for w in words)
    return (
        f"SELECT ord, round(sum(part), 6) AS score FROM parts WHERE term IN ({inlist}) "
        f"GROUP BY ord HAVING count(*) = {len(words)}"
    )


def fuzzy(words: list[str]) -> str:
    return (
        "SELECT ord, round(sum(best), 6) AS score FROM (SELECT p.ord, n.word, max(p.part) AS best "
        f"FROM parts p JOIN ({near(words)}) n ON n.term = p.term GROUP BY p.ord, n.word) "
        f"GROUP BY ord HAVING count(*) = {len(words)}"
    )


def search(scored: str, words: list[str], where: str = "true", order: str = "score DESC",
           offset: int = 0, limit: int = 10, fuzzy: bool = False) -> str:
    title = marked("a.title", words, fuzzy) if words else "a.title"
    summary = cut_to_window("a.summary", words, fuzzy) if words else "a.summary"
    return f"""
, scored AS ({scored}), matches AS (
  SELECT s.ord, s.score, row_number() OVER (ORDER BY {order}, d.id) AS rank
  FROM scored s JOIN docs d ON d.ord = s.ord WHERE {where})
SELECT m.rank, a.id, m.score, {title} AS title, {summary} AS summary, a.content, a.author, a.category,
  a.published_at, a.source, a.word_count
FROM matches m JOIN articles a ON a.ord = m.ord WHERE m.rank > {offset} AND m.rank <= {offset + limit}"""


NEEDS = "parts docs articles"
THE_OF, LE_DE, DER_UND = ["the", "of"], ["le", "de"], ["der", "und"]
FILTERED = (
    "d.category_tag IN ('politics', 'world', 'business') AND "
    "list_has_any(d.source_tags, ['vice', 'wired', 'unknown', 'src7'])"
)
oracle("text_search", NEEDS, search(exact(THE_OF), THE_OF))
oracle("text_search_total", "head_terms", f"SELECT count(*) AS total FROM {matched(THE_OF)}")
oracle("search_filtered", NEEDS, search(exact(THE_OF), THE_OF, FILTERED))
oracle("search_filtered_total", "head_terms docs",
       f"SELECT count(*) AS total FROM docs d WHERE {FILTERED} AND d.ord IN {matched(THE_OF)}")
oracle("search_date_desc", NEEDS, search(exact(LE_DE), LE_DE, order="d.published_ts DESC"))
oracle("search_date_asc", NEEDS, search(exact(DER_UND), DER_UND, order="d.published_ts"))
oracle("search_paged", NEEDS, search(exact(THE_OF), THE_OF, offset=20, limit=15))
oracle("search_all_recent", "docs articles",
       search("SELECT ord, 0.0::DOUBLE AS score FROM docs", [], order="d.published_ts DESC"))
oracle("fuzzy_search", NEEDS, search(fuzzy(["thing", "onthe"]), ["thing", "onthe"], fuzzy=True))
REVISED = """
SELECT * REPLACE (CASE category WHEN 'World' THEN 'Revised edition 2 of the World'
  WHEN 'Sports' THEN 'Revised edition 1 of the Sports' ELSE title END AS title) FROM stored_articles"""
EDITION = ["the", "edition", "of"]
oracle("upsert_search", NEEDS, search(exact(EDITION), EDITION, limit=50), REVISED)
oracle("upsert_terms", "head_df", "SELECT term, df FROM head_df", REVISED)
MARK_WORDS = ["the", "of", "der", "le"]
oracle("highlight_title", "articles", f"SELECT id, {marked('title', MARK_WORDS)} AS title FROM articles")


def snippets(x: str, length: int = 50) -> str:
    q = "[" + ", ".join(f"'{w}'" for w in MARK_WORDS) + "]"
    return f"""
, split AS (SELECT id, {x} AS body, regexp_extract_all({x}, {RUN}) AS ws FROM articles),
words AS (SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM split
  WHERE len(ws) > {length}),
totals AS (SELECT id, i, n, sum(CASE WHEN list_has_any({tokens('w')}, {q}) THEN 1 ELSE 0 END)
  OVER (PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND {length - 1} FOLLOWING) AS hits
  FROM words),
best AS (SELECT id, arg_min(i, (-hits, i)) AS i FROM totals WHERE i <= n - {length} + 1 GROUP BY id)
SELECT s.id, CASE WHEN b.i IS NULL THEN s.body
  ELSE array_to_string(list_slice(s.ws, b.i, b.i + {length - 1}), ' ') END AS snippet
FROM split s LEFT JOIN best b ON b.id = s.id"""


oracle("snippet_summary", "articles", snippets("summary"))
oracle("snippet_content", "articles", snippets("content"))

# --- facets ------------------------------------------------------------------------------------

TITLED = "upper(left({0}, 1)) || substr({0}, 2)"
NAMED = TITLED.format("name")


def ranked(inner: str, limit: int | None = None, name: str = "name") -> str:
    cut = f"WHERE rank <= {limit}" if limit else ""
    return (
        f"SELECT {name} AS name, n, rank FROM (SELECT name, n, row_number() OVER (ORDER BY n DESC, name) "
        f"AS rank FROM ({inner})) {cut}"
    )


BY_CATEGORY = "SELECT category_tag AS name, count(*) AS n FROM docs GROUP BY 1"
BY_SOURCE = "SELECT name, count(*) AS n FROM (SELECT unnest(source_tags) AS name FROM docs) GROUP BY 1"
BY_TAG = "SELECT name, count(*) AS n FROM (SELECT unnest(tag_values) AS name FROM docs) GROUP BY 1"
oracle("facet_categories", "docs", ranked(BY_CATEGORY + " HAVING category_tag <> 'other'", name=NAMED))
oracle("facet_sources", "docs", ranked(BY_SOURCE, 20))
oracle("category_counts_query", "postings docs", f"""
, hits AS (SELECT category_tag, count(*) AS n FROM docs
  WHERE list_has_any(source_tags, ['vice', 'wired', 'unknown', 'src8'])
    AND ord IN {matched(['that', 'with', 'by'], 'postings')} GROUP BY 1)
SELECT {TITLED.format('c.category_tag')} AS name, coalesce(h.n, 0) AS n
FROM (SELECT DISTINCT category_tag FROM docs) c LEFT JOIN hits h ON h.category_tag = c.category_tag""")
oracle("category_counts_top15", "postings docs", ranked(f"""
SELECT category_tag AS name, count(*) AS n FROM docs WHERE author_tag = 'unknown'
  AND ord IN {matched(THE_OF, 'postings')} GROUP BY 1""", 15))


def value_list(inner: str, keep: str = "true") -> str:
    return f"""
SELECT 0::BIGINT AS rank, 'All' AS name UNION ALL
SELECT row_number() OVER (ORDER BY n DESC, name), name FROM (SELECT * FROM
  (SELECT *, row_number() OVER (ORDER BY n DESC, name) AS position FROM ({inner})) WHERE position <= 50)
WHERE {keep}"""


oracle("list_categories", "docs", value_list(BY_CATEGORY))
oracle("list_sources", "docs", value_list(BY_SOURCE))
oracle("list_authors", "docs", value_list(
    "SELECT author AS name, count(*) AS n FROM docs GROUP BY 1", "name NOT IN ('', 'Unknown')"))
TREND = "SELECT rank, name AS tag, n FROM ({0})"
oracle("trending_tags", "docs",
       TREND.format(ranked(f"SELECT * FROM ({BY_TAG}) WHERE length(name) >= 2", 15)))
oracle("trending_tags_first50", "docs", TREND.format(ranked(
    f"SELECT * FROM (SELECT * FROM ({BY_TAG}) ORDER BY name LIMIT 50) WHERE length(name) >= 2", 15)))
oracle("homepage_top_stories", "docs", """
SELECT row_number() OVER (ORDER BY published_ts DESC, id) AS rank, id, category, published_ts
FROM docs ORDER BY published_ts DESC, id LIMIT 3""")
oracle("homepage", "docs articles", f"""
, top AS ({ranked(BY_CATEGORY, 5)}), newest AS (
  SELECT d.ord, d.category_tag, row_number() OVER (PARTITION BY d.category_tag ORDER BY d.published_ts DESC, d.id) AS rank
  FROM docs d), keys AS (
  SELECT 0::BIGINT AS section, 'All' AS shown, row_number() OVER (ORDER BY published_ts DESC, id) AS rank, ord FROM docs
  QUALIFY rank <= 3
  UNION ALL SELECT t.rank, {TITLED.format('t.name')}, n.rank, n.ord FROM newest n JOIN top t ON t.name = n.category_tag
  WHERE n.rank <= 3)
SELECT k.section, k.shown, k.rank, a.id, a.title, a.summary, a.content, a.author, a.category, a.published_at, a.source,
  a.word_count FROM keys k JOIN articles a ON a.ord = k.ord""")
oracle("homepage_sections", "docs", f"""
, top AS ({ranked(BY_CATEGORY, 5)}), newest AS (
  SELECT *, row_number() OVER (PARTITION BY category_tag ORDER BY published_ts DESC, id) AS r FROM docs)
SELECT t.rank AS section, {TITLED.format('t.name')} AS category, n.r AS rank, n.id, n.published_ts
FROM newest n JOIN top t ON t.name = n.category_tag WHERE n.r <= 3""")

# --- vector and hybrid -------------------------------------------------------------------------


def cosine(a: str, b: str) -> str:
    raw = f"round(1 - list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))), 6)"
    return f"CASE WHEN {raw} = 0 THEN 0.0::DOUBLE ELSE {raw} END"


def knn(vec_id: int, where: str = "true") -> str:
    return f"""
SELECT c.ord, c.id, c.distance, row_number() OVER (ORDER BY c.distance, c.id) AS rank FROM (
  SELECT v.ord, v.id, {cosine('v.v', 'q.v')} AS distance
  FROM vecs v, (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = {vec_id}) q
  WHERE {where}) c"""


def vector_page(vec_id: int, where: str = "true", offset: int = 0, limit: int = 10) -> str:
    return f"""
, ranked AS ({knn(vec_id, where)})
SELECT r.rank, r.id, r.distance, round(1 - r.distance, 6) AS similarity, a.title, a.author, a.category,
  a.source, a.published_at, a.content, a.word_count
FROM ranked r JOIN articles a ON a.ord = r.ord WHERE r.rank > {offset} AND r.rank <= {offset + limit}"""


oracle("vector_search", "vecs articles", vector_page(7))
oracle("vector_search_filtered", "vecs articles", vector_page(
    42, "v.category_tag IN ('politics', 'general') AND list_has_any(v.source_tags, ['vice', 'unknown'])"))
oracle("vector_search_paged", "vecs articles", vector_page(99, offset=10))
oracle("vector_search_total", "vecs",
       f"SELECT least(count(*), 20) AS total FROM ({knn(99)})")

PAIRS = f"""
, pairs AS (SELECT s.id AS id, o.id AS similar_id, {cosine('s.v', 'o.v')} AS distance
  FROM vecs s JOIN vecs o ON o.ord <> s.ord),
best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, similar_id) AS rank FROM pairs)"""
oracle("similar_articles", "vecs articles", PAIRS + """
SELECT b.rank, a.id, b.distance, round(1 - b.distance, 6) AS similarity, a.title, a.author, a.category,
  a.source, a.published_at
FROM best b JOIN articles a ON a.id = b.similar_id WHERE b.id = 'nw_0000007' AND b.rank <= 5""")
oracle("similar_all", "vecs",
       PAIRS + " SELECT id, rank, similar_id, distance FROM best WHERE rank <= 5")


def fused(words: list[str], vec_id: int, weight: float, where: str, where_v: str) -> str:
    return f"""
, scored AS ({exact(words)}), t AS (
  SELECT d.ord, d.id, row_number() OVER (ORDER BY s.score DESC, d.id) AS rank
  FROM scored s JOIN docs d ON d.ord = s.ord WHERE {where}),
v AS ({knn(vec_id, where_v)}),
u AS (SELECT coalesce(t.ord, v.ord) AS ord, t.rank AS text_rank, v.rank AS vector_rank
  FROM (SELECT * FROM t WHERE rank <= 10) t FULL JOIN (SELECT * FROM v WHERE rank <= 10) v
  ON t.ord = v.ord),
f AS (SELECT *, round(coalesce((1 - {weight}::DOUBLE) / (60 + text_rank), 0)
    + coalesce({weight}::DOUBLE / (60 + vector_rank), 0), 9) AS hybrid_score FROM u),
r AS (SELECT *, row_number() OVER (ORDER BY hybrid_score DESC, text_rank NULLS LAST,
    vector_rank NULLS LAST) AS rank FROM f)"""


def hybrid_page(words: list[str], vec_id: int, weight: float = 0.5, where: str = "true",
                where_v: str = "true", offset: int = 0, limit: int = 10) -> str:
    return fused(words, vec_id, weight, where, where_v) + f"""
SELECT r.rank, a.id, r.hybrid_score, r.text_rank, r.vector_rank,
  CASE WHEN r.vector_rank IS NULL THEN {marked('a.title', words)} ELSE a.title END AS title,
  CASE WHEN r.vector_rank IS NULL THEN {cut_to_window('a.summary', words)} END AS summary,
  a.author, a.category, a.source, a.published_at, a.content, a.word_count
FROM r JOIN articles a ON a.ord = r.ord WHERE r.rank > {offset} AND r.rank <= {offset + limit}"""


HYBRID = "parts docs vecs articles"
oracle("hybrid_search", HYBRID, hybrid_page(THE_OF, 7))
oracle("hybrid_weighted", HYBRID, hybrid_page(
    THE_OF, 42, 0.8, "d.category_tag IN ('politics', 'world', 'general')",
    "v.category_tag IN ('politics', 'world', 'general')"))
oracle("hybrid_search_paged", HYBRID, hybrid_page(LE_DE, 99, offset=8, limit=8))
oracle("hybrid_search_total", HYBRID,
       fused(LE_DE, 99, 0.5, "true", "true") + " SELECT count(*) AS total FROM r")
oracle("embedding_reuse", "log_vectors", f"""
, near AS (SELECT q.query_id, e.query_id AS earlier, {cosine('q.v', 'e.v')} AS distance
  FROM log_vectors q JOIN log_vectors e ON e.query_id < q.query_id),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, earlier) AS r FROM near)
SELECT l.query_id, b.earlier AS reused_from, round(1 - b.distance, 6) AS similarity
FROM log_vectors l LEFT JOIN best b
  ON b.query_id = l.query_id AND b.r = 1 AND round(1 - b.distance, 6) >= 0.9""")

# --- suggestions and spelling ------------------------------------------------------------------

cte("suggestions", "articles", f"""
SELECT suggestion, count(*) AS score FROM (SELECT unnest(list_distinct([title, category, source]
  || flatten(list_transform(tags, lambda t: list_transform(string_split(t, ','), lambda v: {strip('v')})))
  )) AS suggestion FROM articles) WHERE suggestion <> '' GROUP BY suggestion""")
cte("typed", "log", f"""
SELECT query_id * 1000000 + n - 1 AS query_id, text FROM (
  SELECT query_id, unnest(regexp_extract_all(text, {RUN})) AS text,
    generate_subscripts(regexp_extract_all(text, {RUN}), 1) AS n FROM log)""")
cte("completed", "suggestions typed", """
SELECT query_id, suggestion, position,
  row_number() OVER (PARTITION BY query_id, lower(suggestion) ORDER BY position) AS copy
FROM (SELECT t.query_id, s.suggestion,
    row_number() OVER (PARTITION BY t.query_id ORDER BY s.score DESC, s.suggestion) AS position
  FROM typed t JOIN suggestions s ON starts_with(lower(s.suggestion), lower(t.text))
  WHERE length(t.text) >= 2)
WHERE position <= 7""")
KIND = "CASE WHEN length(suggestion) > 40 THEN 'article' ELSE 'topic' END AS type"
oracle("suggestion_dictionary", "suggestions", "SELECT suggestion, score FROM suggestions")
oracle("autocomplete", "completed", f"""
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY position) AS rank, suggestion, {KIND}
FROM completed WHERE copy = 1""")
oracle("autocomplete_prefix", "suggestions", f"""
, top AS (SELECT * FROM suggestions WHERE starts_with(lower(suggestion), 'th')
  ORDER BY score DESC, suggestion LIMIT 7)
SELECT row_number() OVER (ORDER BY score DESC, suggestion) AS rank, suggestion, {KIND} FROM (
  SELECT *, row_number() OVER (PARTITION BY lower(suggestion) ORDER BY score DESC, suggestion) AS copy
  FROM top) WHERE copy = 1""")


def spelling(table: str) -> str:
    """Corrections at distance one, by deleting single characters on both sides: exact in characters."""
    toks = tokens("text")
    return f"""
, asked AS (SELECT query_id, text, {toks} AS toks FROM {table} WHERE length({strip('text')}) >= 2),
spread AS (SELECT query_id, unnest(toks) AS word, generate_subscripts(toks, 1) AS i FROM asked),
first_use AS (SELECT query_id, word, min(i) AS i FROM spread GROUP BY ALL),
placed AS (SELECT query_id, word,
    CAST(row_number() OVER (PARTITION BY query_id ORDER BY i) - 1 AS INTEGER) AS position FROM first_use),
unknown AS (SELECT DISTINCT word FROM placed WHERE word NOT IN (SELECT term FROM vocabulary)),
cut_terms AS (SELECT term, df, i, left(term, CAST(i AS INTEGER) - 1) || substr(term, CAST(i AS INTEGER) + 1) AS rest
  FROM (SELECT term, df, unnest(range(1, length(term) + 1)) AS i FROM vocabulary)),
cut_words AS (SELECT word, i, left(word, CAST(i AS INTEGER) - 1) || substr(word, CAST(i AS INTEGER) + 1) AS rest
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM unknown)),
near AS (
  SELECT w.word, t.term, t.df FROM cut_words w JOIN cut_terms t ON t.rest = w.rest AND t.i = w.i
  UNION SELECT w.word, t.term, t.df FROM unknown w JOIN cut_terms t ON t.rest = w.word
  UNION SELECT w.word, t.term, t.df FROM cut_words w JOIN vocabulary t ON t.term = w.rest),
fixes AS (SELECT word, term AS suggestion FROM (SELECT *, row_number() OVER (
    PARTITION BY word ORDER BY df DESC, term) AS r FROM near) WHERE r = 1),
found AS (SELECT p.query_id, p.position, p.word, f.suggestion FROM placed p JOIN fixes f USING (word)),
per_query AS (SELECT query_id, list([word, suggestion] ORDER BY position) AS fixes
  FROM found GROUP BY query_id),
replaced AS (SELECT t.query_id, t.text, CASE WHEN q.fixes IS NULL THEN t.text ELSE list_reduce(
    q.fixes, lambda acc, f: [replace(acc[1], f[1], f[2])], [t.text])[1] END AS fixed
  FROM {table} t LEFT JOIN per_query q ON q.query_id = t.query_id),
corrected AS (SELECT query_id, text, CASE WHEN fixed <> text THEN fixed END AS corrected FROM replaced)"""


oracle("spellcheck", "log vocabulary",
       spelling("log") + " SELECT query_id, position, word, suggestion FROM found")
oracle("spell_correct_query", "log vocabulary",
       spelling("log") + " SELECT query_id, text, corrected FROM corrected")
oracle("autocomplete_spell", "typed vocabulary completed", spelling("typed") + """
, shown AS (SELECT query_id, count(*) AS n, list(lower(suggestion)) AS seen FROM completed
  WHERE copy = 1 GROUP BY query_id)
SELECT c.query_id, c.text, coalesce(s.n, 0) AS n,
  CASE WHEN coalesce(s.n, 0) < 3 AND NOT coalesce(list_contains(s.seen, lower(c.corrected)), false)
    THEN c.corrected END AS spell_suggestion
FROM corrected c LEFT JOIN shown s ON s.query_id = c.query_id""")

# --- cache and workload ------------------------------------------------------------------------

oracle("query_cache_key", "log", f"""
SELECT query_id, 'query_cache:text:' || md5('text:' || {strip('lower(text)')} || ':' ||
  {strip('lower(categories)')} || ':' || {strip('lower(sources)')} || ':' || sort || ':' || offset_ || ':' ||
  limit_) AS cache_key FROM log""")


def hits(ttl: int) -> str:
    return f"""
WITH RECURSIVE lookups AS MATERIALIZED (
  SELECT event_id, md5(lower(event_type) || ':' || (user_id % 5)) AS cache_key, epoch_us(ts) AS t
  FROM events),
numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY t, event_id) AS r
  FROM lookups),
walk AS (
  SELECT event_id, cache_key, r, t AS stored, false AS hit FROM numbered WHERE r = 1
  UNION ALL
  SELECT n.event_id, n.cache_key, n.r,
    CASE WHEN n.t < w.stored + {ttl}000000 THEN w.stored ELSE n.t END, n.t < w.stored + {ttl}000000
  FROM walk w JOIN numbered n ON n.cache_key = w.cache_key AND n.r = w.r + 1)
SELECT event_id, cache_key, hit FROM walk"""


ORACLE["cache_hits"] = hits(60)
ORACLE["cache_hits_hour"] = hits(3600)

PAGED = """
, ranked AS (SELECT s.query_id, d.id, s.score, q.offset_, q.limit_,
  row_number() OVER (PARTITION BY s.query_id ORDER BY
    CASE q.sort WHEN 'date_desc' THEN -d.published_ts WHEN 'date_asc' THEN d.published_ts ELSE 0 END,
    CASE WHEN q.sort = 'relevance' THEN -s.score ELSE 0 END, d.id) AS rank
  FROM scored s JOIN {parsed} q ON q.query_id = s.query_id JOIN docs d ON d.ord = s.ord
  WHERE (len(q.category_list) = 0 OR list_contains(q.category_list, d.category_tag))
    AND (len(q.source_list) = 0 OR list_has_any(q.source_list, d.source_tags)))
SELECT query_id, rank, id, score FROM ranked WHERE rank > offset_ AND rank <= offset_ + limit_"""

WORKLOAD = """
, terms AS (SELECT query_id, unnest(terms) AS term, len(terms) AS n FROM {parsed} WHERE has_text),
scored AS (SELECT t.query_id, p.ord, round(sum(p.part), 6) AS score
  FROM terms t JOIN parts p ON p.term = t.term GROUP BY t.query_id, p.ord HAVING count(*) = any_value(t.n)
  UNION ALL SELECT q.query_id, d.ord, 0.0::DOUBLE FROM {parsed} q, docs d WHERE NOT q.has_text)"""
oracle("workload_search", "parsed parts docs", WORKLOAD.format(parsed="parsed") + PAGED.format(parsed="parsed"))
oracle("workload_phrases", "parsed_phrases parts docs",
       WORKLOAD.format(parsed="parsed_phrases") + PAGED.format(parsed="parsed_phrases"))


oracle("workload_fuzzy", "parsed head_df parts docs", f"""
, asked AS (SELECT * FROM parsed),
needed AS (SELECT query_id, unnest(terms) AS word, len(terms) AS n FROM asked WHERE has_text),
close AS (SELECT w.word, t.term FROM (SELECT DISTINCT word FROM needed) w JOIN head_df t
  ON abs(length(w.word) - length(t.term)) <= 2
  AND levenshtein({plain('w.word')}, {plain('t.term')}) <= 2),
scored AS (SELECT query_id, ord, round(sum(best), 6) AS score FROM (
    SELECT n.query_id, n.word, any_value(n.n) AS n, p.ord, max(p.part) AS best
    FROM needed n JOIN close c ON c.word = n.word JOIN parts p ON p.term = c.term
    GROUP BY n.query_id, n.word, p.ord)
  GROUP BY query_id, ord HAVING count(*) = any_value(n)
  UNION ALL SELECT q.query_id, d.ord, 0.0::DOUBLE FROM asked q, docs d WHERE NOT q.has_text)
""" + PAGED.format(parsed="asked"))

def shown_page(part: str, fuzzy: bool) -> str:
    return f"""
SELECT p.query_id, p.rank, p.id, p.score, {marked('a.title', 'q.terms', fuzzy)} AS title,
  {cut_to_window('a.summary', 'q.terms', fuzzy)} AS summary, a.content, a.author, a.category, a.published_at, a.source,
  a.word_count FROM {part} p JOIN parsed_phrases q ON q.query_id = p.query_id JOIN articles a ON a.id = p.id
WHERE {'' if fuzzy else 'NOT '}(p.query_id % 2 = 1)"""


NEAR_SCORED = f"""
, needed AS (SELECT query_id, unnest(terms) AS word, len(terms) AS n FROM parsed_phrases WHERE has_text AND query_id % 2 = 1),
close AS (SELECT w.word, t.term FROM (SELECT DISTINCT word FROM needed) w JOIN head_df t
  ON abs(length(w.word) - length(t.term)) <= 2 AND levenshtein({plain('w.word')}, {plain('t.term')}) <= 2),
exact_terms AS (SELECT query_id, unnest(terms) AS term, len(terms) AS n FROM parsed_phrases
  WHERE has_text AND query_id % 2 = 0),
scored AS (SELECT query_id, ord, round(sum(best), 6) AS score FROM (
    SELECT n.query_id, n.word, any_value(n.n) AS n, p.ord, max(p.part) AS best
    FROM needed n JOIN close c ON c.word = n.word JOIN parts p ON p.term = c.term
    GROUP BY n.query_id, n.word, p.ord) GROUP BY query_id, ord HAVING count(*) = any_value(n)
  UNION ALL SELECT t.query_id, p.ord, round(sum(p.part), 6) FROM exact_terms t JOIN parts p ON p.term = t.term
  GROUP BY t.query_id, p.ord HAVING count(*) = any_value(t.n)
  UNION ALL SELECT q.query_id, d.ord, 0.0::DOUBLE FROM parsed_phrases q, docs d WHERE NOT q.has_text)"""
oracle("workload_pages", "parsed_phrases head_df parts docs articles", NEAR_SCORED + PAGED.format(parsed="parsed_phrases").replace(
    "SELECT query_id, rank, id, score FROM ranked", ", shown AS (SELECT query_id, rank, id, score FROM ranked") + ")"
    + shown_page("shown", False) + " UNION ALL " + shown_page("shown", True))
oracle("workload_facets", "parsed_words postings docs", """
, held AS (SELECT DISTINCT term, ord FROM postings),
matches AS (SELECT q.query_id, h.ord FROM (SELECT query_id, unnest(terms) AS term, len(terms) AS n FROM parsed_words
    WHERE has_text) q JOIN held h ON h.term = q.term GROUP BY q.query_id, h.ord HAVING count(*) = any_value(q.n)),
found AS (SELECT q.query_id, d.category_tag, count(*) AS n FROM matches m JOIN parsed_words q ON q.query_id = m.query_id
  JOIN docs d ON d.ord = m.ord WHERE len(q.source_list) = 0 OR list_has_any(q.source_list, d.source_tags) GROUP BY ALL
  UNION ALL SELECT q.query_id, d.category_tag, count(*) FROM parsed_words q JOIN docs d
    ON len(q.source_list) = 0 OR list_has_any(q.source_list, d.source_tags) WHERE NOT q.has_text GROUP BY ALL)
SELECT q.query_id, """ + TITLED.format("c.name") + """ AS name, coalesce(f.n, 0)::BIGINT AS n
FROM parsed_words q CROSS JOIN (SELECT DISTINCT category_tag AS name FROM docs) c
LEFT JOIN found f ON f.query_id = q.query_id AND f.category_tag = c.name""")

ALLOWED = """(len(q.category_list) = 0 OR list_contains(q.category_list, d.category_tag))
  AND (len(q.source_list) = 0 OR list_has_any(q.source_list, d.source_tags))"""
VECTOR_RANKS = f"""
, distances AS (SELECT q.query_id, d.id, {cosine('q.v', 'd.v')} AS distance
  FROM log_vectors q JOIN vecs d ON {ALLOWED}),
vector_ranks AS (SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id
  ORDER BY distance, id) AS rank FROM distances)"""
oracle("workload_vector", "log_vectors vecs", VECTOR_RANKS + """
SELECT l.query_id, r.rank, r.id, r.distance FROM log_vectors l JOIN vector_ranks r USING (query_id)
WHERE l.has_text AND r.rank > l.offset_ AND r.rank <= l.offset_ + l.limit_""")
oracle("workload_hybrid", "parts docs log_vectors vecs", WORKLOAD.format(parsed="log_vectors") + VECTOR_RANKS + f"""
, text_list AS (SELECT query_id, id, rank FROM (SELECT s.query_id, d.id, row_number() OVER (
    PARTITION BY s.query_id ORDER BY s.score DESC, d.id) AS rank
  FROM scored s JOIN docs d ON d.ord = s.ord JOIN log_vectors q ON q.query_id = s.query_id AND {ALLOWED})
  WHERE rank <= 10),
vector_list AS (SELECT query_id, id, rank FROM vector_ranks WHERE rank <= 10),
fused AS (SELECT coalesce(t.query_id, v.query_id) AS query_id, coalesce(t.id, v.id) AS id,
  t.rank AS text_rank, v.rank AS vector_rank, round(coalesce(0.5::DOUBLE / (60 + t.rank), 0)
    + coalesce(0.5::DOUBLE / (60 + v.rank), 0), 9) AS hybrid_score
  FROM text_list t FULL JOIN vector_list v ON t.query_id = v.query_id AND t.id = v.id),
ranked AS (SELECT f.*, q.offset_, q.limit_, row_number() OVER (PARTITION BY f.query_id ORDER BY
    f.hybrid_score DESC, f.text_rank NULLS LAST, f.vector_rank NULLS LAST) AS rank
  FROM fused f JOIN log_vectors q ON q.query_id = f.query_id WHERE length({strip('q.text')}) >= 2)
SELECT query_id, rank, id, hybrid_score, text_rank, vector_rank FROM ranked
WHERE rank > offset_ AND rank <= offset_ + limit_""")
