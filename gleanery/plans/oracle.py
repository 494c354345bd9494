"""The registered queries as plain SQL, to check results against another engine."""

from __future__ import annotations

from gleanery.functions import stemmer
from gleanery.functions.content import WHITE_SPACE
from gleanery.functions.links import PAGE_SPACE
from gleanery.functions.paths import LANGUAGES, SKIP_DIRECTORIES, SKIP_EXTENSIONS
from gleanery.functions.scoring import CONFIG_LANGUAGES, SCRIPT_LANGUAGES, SCRIPT_WORDS
from gleanery.functions.text import STOP_WORDS
from gleanery.plans.sample_corpus import DIM, DIRECTORIES, SUFFIXES, TREE_ROOT


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _ext(path: str) -> str:
    return rf"regexp_extract({path}, '\.[^./]*$')"


def _lang(path: str) -> str:
    cases = " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in LANGUAGES.items())
    ext = _ext(f"lower({path})")
    return f"CASE {ext} {cases} ELSE substring({ext}, 2) END"


def _skip(path: str) -> str:
    tests = [f"contains(lower({path}), '/{d}/')" for d in SKIP_DIRECTORIES]
    tests.append(f"{_ext(f'lower({path})')} IN {_in(SKIP_EXTENSIONS)}")
    return "(" + " OR ".join(tests) + ")"


def _tokens(text: str) -> str:
    return rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+')"


def _terms(text: str) -> str:
    return f"list_filter({_tokens(text)}, lambda t: t NOT IN {_in(STOP_WORDS)})"


def _grams(text: str) -> str:
    return (
        f"list_distinct(flatten(list_transform({_tokens(text)}, lambda w: list_transform("
        "range(0, length(w) + 1), lambda i: substring('  ' || w || ' ', i + 1, 3)))))"
    )


def _tri(left: str, right: str) -> str:
    a, b = _grams(left), _grams(right)
    shared = f"len(list_intersect({a}, {b}))"
    every = f"len(list_distinct(list_concat({a}, {b})))"
    return f"CASE WHEN {shared} = 0 THEN 0.0::DOUBLE ELSE {shared}::DOUBLE / {every} END"


def _longest(text: str) -> str:
    found = f"regexp_extract_all(lower({text}), '[A-Za-z0-9._-]+')"
    return (
        f"coalesce(list_reduce({found}, "
        "lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END, ''), '')"
    )


def _asked(text: str) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), '{w}')" for w in SCRIPT_WORDS) + ")"


def _bias(language: str, asked: str) -> str:
    return (
        f"CASE WHEN NOT {asked} THEN 0 WHEN {language} IN {_in(SCRIPT_LANGUAGES)} THEN 1 "
        f"WHEN {language} IN {_in(CONFIG_LANGUAGES)} THEN -1 ELSE 0 END"
    )


def _noise(path: str) -> str:
    words = "sample|example|test|mock|fixture|tmp|temp|sandbox"
    return (
        rf"CASE WHEN regexp_matches(lower({path}), '(^|/)({words})(/|\\.|$)') THEN 1 ELSE 0 END"
    )


def _heuristic(text: str) -> str:
    return f"substring(trim({text}, '{WHITE_SPACE}'), 1, 240)"


def _stub(path: str, text: str) -> str:
    lines = f"list_transform(string_split({text}, chr(10))[1:5], lambda l: trim(l, '{WHITE_SPACE}'))"
    telling = (
        f"list_filter({lines}, lambda l: (starts_with(l, '#') OR starts_with(l, '//')) "
        "AND strlen(l) > 10)"
    )
    return f"coalesce({telling}[1], 'Code file: ' || {path})"


def _cosine(left: str, right: str) -> str:
    a, b = f"{left}::DOUBLE[]", f"{right}::DOUBLE[]"
    return (
        f"CASE WHEN {left} IS NULL OR {right} IS NULL THEN 0.0::DOUBLE ELSE "
        f"round(least(greatest(list_cosine_similarity({a}, {b}), 0.0), 1.0), 9) END"
    )


def _share(value: str, maximum: str) -> str:
    return f"coalesce({value} / nullif({maximum}, 0), 0)"


LINES = "length(text) - length(replace(text, chr(10), '')) + 1"

FILES = f"""
files AS (
  SELECT doc_id, source AS repository,
         CASE WHEN doc_id % 3 < 2 THEN 'main' ELSE 'dev' END AS ref,
         ({_list(DIRECTORIES)})[doc_id % 7 + 1] || '/' || lang || '/doc_' || doc_id
           || ({_list(SUFFIXES)})[doc_id % 8 + 1] AS path,
         text
  FROM documents
)"""

CHUNKS = f"""{FILES},
chunks AS (
  SELECT doc_id, sha1(path || '#1:' || ({LINES})) AS id, repository, ref, path,
         {_lang('path')} AS language, {_heuristic('text')} AS summary, text AS content,
         1 AS line_start, ({LINES})::INT AS line_end, embedding AS summary_vec,
         sha1(text) AS content_hash
  FROM files LEFT JOIN embeddings ON vec_id = doc_id
)"""

QUERIES = """
queries AS (
  SELECT item_id AS query_id, text AS query_text, embedding AS query_vec
  FROM benchmark LEFT JOIN embeddings ON vec_id = item_id
)"""

KEY = "repository, ref, path, line_start, line_end"


def _scored(where: str, stemmed: bool = False) -> str:
    """Terms, maxima and score of the flagship query."""
    before, joins = CHUNKS, ""
    hits = f"len(list_filter({_tokens('summary')}, lambda t: t IN {_in(FLAGSHIP_TERMS)}))"
    if stemmed:
        before += f""",
{_stemmed_words("SELECT doc_id, summary AS text FROM chunks")},
summary_hits AS (
  SELECT doc_id, count(*) AS hits FROM stemmed WHERE stem IN {_in(FLAGSHIP_STEMS)} GROUP BY doc_id
)"""
        joins, hits = "LEFT JOIN summary_hits USING (doc_id)", "coalesce(hits, 0)"
    return f"""{before},
terms AS (
  SELECT chunks.*,
         {_cosine('summary_vec', '(SELECT embedding FROM embeddings WHERE vec_id = 7)')} AS sem,
         least(1.0, 0.4::DOUBLE * {hits}) AS lex,
         {_tri('path', "'doc_12.py'")} AS tri,
         {_bias('language', 'true')} AS bias,
         {_noise('path')} AS noise
  FROM chunks {joins} WHERE {where}
),
ranked AS (
  SELECT *, max(sem) OVER () AS max_sem, max(lex) OVER () AS max_lex, max(tri) OVER () AS max_tri
  FROM terms
),
scored AS (
  SELECT *, 0.80::DOUBLE * {_share('sem', 'max_sem')} + 0.15::DOUBLE * {_share('lex', 'max_lex')}
            + 0.05::DOUBLE * {_share('tri', 'max_tri')} + 0.10::DOUBLE * bias
            - 0.07::DOUBLE * noise AS score
  FROM ranked
)"""


# Terms of "bash script attion eriner tion thnt doc_12.py", plain and stemmed.
FLAGSHIP_TERMS = ["12", "attion", "bash", "doc", "eriner", "py", "script", "thnt", "tion"]
FLAGSHIP_STEMS = ["12", "attion", "bash", "doc", "erin", "py", "script", "thnt", "tion"]


def _longest_ending(word: str, endings) -> str:
    cases = " ".join(
        f"WHEN ends_with({word}, '{e}') THEN '{e}'" for e in sorted(endings, key=len, reverse=True)
    )
    return f"CASE {cases} ELSE '' END"


def _stemmed_words(texts: str) -> str:
    """``stemmed(doc_id, nth, stem)``: the index terms of ``texts(doc_id, text)``.

    The stemmer as a chain of set-wise steps over the distinct words.
    """
    def replaced(endings: dict) -> str:
        return " ".join(f"WHEN '{e}' THEN '{r}'" for e, r in endings.items())

    short_end = "([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"
    region = "^.*?[aeiouy][^aeiouy]"
    irregular = ", ".join(f"('{w}', '{s}')" for w, s in stemmer.IRREGULAR.items())
    return f"""texts AS ({texts}),
all_words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS nth
  FROM (SELECT doc_id, {_tokens('text')} AS w FROM texts)
),
kept_words AS (SELECT * FROM all_words WHERE word NOT IN {_in(STOP_WORDS)}),
irregular(word, stem) AS (VALUES {irregular}),
marked AS (
  SELECT word, regexp_replace(regexp_replace(word, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS t
  FROM (SELECT DISTINCT word FROM kept_words)
  WHERE length(word) > 2 AND word NOT IN (SELECT word FROM irregular)
),
first_region AS (
  SELECT *, CASE WHEN regexp_matches(t, '^(gener|commun|arsen)')
      THEN length(regexp_extract(t, '^(gener|commun|arsen)'))
    WHEN regexp_matches(t, '{region}') THEN length(regexp_extract(t, '{region}'))
    ELSE length(t) END AS r1
  FROM marked
),
regions AS (
  SELECT *, CASE WHEN regexp_matches(substring(t, r1 + 1), '{region}')
      THEN r1 + length(regexp_extract(substring(t, r1 + 1), '{region}'))
    ELSE length(t) END AS r2
  FROM first_region
),
singular AS (
  SELECT * REPLACE (CASE
      WHEN ends_with(t, 'sses') THEN left(t, length(t) - 2)
      WHEN ends_with(t, 'ied') OR ends_with(t, 'ies')
        THEN left(t, length(t) - CASE WHEN length(t) > 4 THEN 2 ELSE 1 END)
      WHEN ends_with(t, 's') AND NOT ends_with(t, 'us') AND NOT ends_with(t, 'ss')
        AND regexp_matches(left(t, length(t) - 2), '[aeiouy]') THEN left(t, length(t) - 1)
      ELSE t END AS t)
  FROM regions
),
verbs AS (
  SELECT *, {_longest_ending('t', ('eed', 'eedly', 'ed', 'edly', 'ing', 'ingly'))} AS ending
  FROM singular WHERE t NOT IN {_in(sorted(stemmer.FINAL_SINGULARS))}
),
bases AS (SELECT *, left(t, length(t) - length(ending)) AS base FROM verbs),
plain AS (
  SELECT word, r1, r2, CASE
      WHEN ending IN ('eed', 'eedly') THEN CASE WHEN length(base) >= r1 THEN base || 'ee' ELSE t END
      WHEN ending = '' OR NOT regexp_matches(base, '[aeiouy]') THEN t
      WHEN regexp_matches(base, '(at|bl|iz)$') THEN base || 'e'
      WHEN regexp_matches(base, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(base, length(base) - 1)
      WHEN r1 >= length(base) AND regexp_matches(base, '{short_end}') THEN base || 'e'
      ELSE base END AS t
  FROM bases
),
with_i AS (
  SELECT * REPLACE (regexp_replace(t, '(.[^aeiouy])[yY]$', '\\1i') AS t) FROM plain
),
two AS (SELECT *, {_longest_ending('t', stemmer.ROUND_TWO)} AS e FROM with_i),
after_two AS (
  SELECT word, r1, r2, CASE
      WHEN e = '' OR length(t) - length(e) < r1 OR (e = 'ogi' AND NOT ends_with(t, 'logi'))
        OR (e = 'li' AND NOT regexp_matches(t, '[cdeghkmnrt]li$')) THEN t
      ELSE left(t, length(t) - length(e)) || CASE e {replaced(stemmer.ROUND_TWO)} END END AS t
  FROM two
),
three AS (SELECT *, {_longest_ending('t', stemmer.ROUND_THREE)} AS e FROM after_two),
after_three AS (
  SELECT word, r1, r2, CASE
      WHEN e = '' OR length(t) - length(e) < CASE e WHEN 'ative' THEN r2 ELSE r1 END THEN t
      ELSE left(t, length(t) - length(e)) || CASE e {replaced(stemmer.ROUND_THREE)} END END AS t
  FROM three
),
four AS (SELECT *, {_longest_ending('t', stemmer.ROUND_FOUR)} AS e FROM after_three),
after_four AS (
  SELECT word, r1, r2, CASE
      WHEN e = '' OR length(t) - length(e) < r2
        OR (e = 'ion' AND NOT regexp_matches(t, '[st]ion$')) THEN t
      ELSE left(t, length(t) - length(e)) END AS t
  FROM four
),
after_five AS (
  SELECT word, CASE
      WHEN ends_with(t, 'e') AND (length(t) > r2 OR (length(t) > r1
        AND NOT regexp_matches(left(t, length(t) - 1), '{short_end}'))) THEN left(t, length(t) - 1)
      WHEN ends_with(t, 'll') AND length(t) > r2 THEN left(t, length(t) - 1)
      ELSE t END AS t
  FROM after_four
),
stem_of AS (
  SELECT word, replace(t, 'Y', 'y') AS stem FROM after_five
  UNION ALL SELECT word, replace(t, 'Y', 'y') FROM singular
    WHERE t IN {_in(sorted(stemmer.FINAL_SINGULARS))}
  UNION ALL SELECT word, stem FROM irregular
),
stemmed AS (
  SELECT doc_id, nth, coalesce(stem, word) AS stem
  FROM kept_words LEFT JOIN stem_of USING (word)
)"""


ORDER = f"score DESC, sem DESC, {KEY}"
SEARCH_COLUMNS = f"""repository, ref, path, line_start, line_end, round(sem, 6) AS sem,
  round(lex, 6) AS lex, round(tri, 6) AS tri, bias, noise, round(score, 6) AS score"""


def _search(where: str, k: int, stemmed: bool = False) -> str:
    return f"""WITH {_scored(where, stemmed)}
SELECT {SEARCH_COLUMNS}, row_number() OVER (ORDER BY {ORDER}) AS rank
FROM scored ORDER BY {ORDER} LIMIT {k}"""


def _batch(k: int) -> str:
    """Best k chunks per query of the query table."""
    return f"""{CHUNKS}, {QUERIES},
chunk_words AS (
  SELECT doc_id, {_tokens('summary')} AS words, {_grams('path')} AS grams FROM chunks
),
query_words AS (
  SELECT query_id, query_vec, list_distinct({_terms('query_text')}) AS terms,
         {_grams(_longest('query_text'))} AS grams, {_asked('query_text')} AS asked
  FROM queries WHERE trim(query_text, '{WHITE_SPACE}') <> ''
),
chunk_hits AS (
  SELECT query_id, doc_id, count(*) AS hits
  FROM (SELECT doc_id, unnest(words) AS word FROM chunk_words)
  JOIN (SELECT query_id, unnest(terms) AS word FROM query_words) USING (word)
  GROUP BY ALL
),
terms AS (
  SELECT q.query_id, c.*,
         {_cosine('summary_vec', 'query_vec')} AS sem,
         least(1.0, 0.4::DOUBLE * coalesce(hits, 0)) AS lex,
         coalesce(len(list_intersect(w.grams, q.grams))::DOUBLE
           / nullif(len(list_distinct(list_concat(w.grams, q.grams))), 0), 0) AS tri,
         {_bias('language', 'q.asked')} AS bias,
         {_noise('path')} AS noise
  FROM chunks c JOIN chunk_words w USING (doc_id) CROSS JOIN query_words q
  LEFT JOIN chunk_hits h ON h.query_id = q.query_id AND h.doc_id = c.doc_id
),
maxima AS (
  SELECT query_id, max(sem) AS max_sem, max(lex) AS max_lex, max(tri) AS max_tri
  FROM terms GROUP BY query_id
),
scored AS (
  SELECT *, 0.80::DOUBLE * {_share('sem', 'max_sem')} + 0.15::DOUBLE * {_share('lex', 'max_lex')}
            + 0.05::DOUBLE * {_share('tri', 'max_tri')} + 0.10::DOUBLE * bias
            - 0.07::DOUBLE * noise AS score
  FROM terms JOIN maxima USING (query_id)
),
best AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {ORDER}) AS rank FROM scored
  QUALIFY rank <= {k}
)"""


PREVIOUS = f"""
previous AS (
  SELECT doc_id, id, repository, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE ref END AS ref, path,
         language, line_start, line_end,
         CASE WHEN doc_id % 5 = 1 THEN sha1(content || ' old') ELSE content_hash END AS content_hash,
         CASE WHEN doc_id % 5 = 2 THEN '' ELSE summary END AS summary,
         CASE WHEN doc_id % 5 <> 3 THEN summary_vec END AS summary_vec
  FROM chunks WHERE doc_id % 5 <> 0 OR doc_id % 10 = 5
)"""

# Every document has at most one stored row: of its own ref, or of the ref "old".
DELTA = f"""{CHUNKS}, {PREVIOUS},
delta AS (
  SELECT c.*, p.doc_id IS NOT NULL AS found, p.content_hash AS old_hash,
         p.summary AS old_summary, p.summary_vec IS NOT NULL AS old_has_vec,
         p.ref AS source_ref, p.summary_vec AS old_vec, p.id AS old_id,
         p.doc_id IS NULL OR p.content_hash <> c.content_hash OR p.summary = '' AS need_summary,
         p.doc_id IS NULL OR p.content_hash <> c.content_hash OR p.summary_vec IS NULL AS need_embed
  FROM chunks c LEFT JOIN previous p ON p.doc_id = c.doc_id
)"""

# The variants of content that give the stub provider something to find.
COMMENTED = """CASE doc_id % 5
  WHEN 0 THEN '# About document ' || doc_id || chr(10) || text
  WHEN 1 THEN chr(10) || '  // short' || chr(10) || chr(9) || '// Ñandú ' || chr(10) || text
  WHEN 2 THEN 'a' || chr(10) || 'b' || chr(10) || 'c' || chr(10) || 'd' || chr(10) || 'e'
    || chr(10) || '# too far down' || chr(10) || text
  WHEN 3 THEN ''
  ELSE text END"""

REPOSITORY_FORMS = """CASE doc_id % 8
  WHEN 0 THEN 'https://github.com/acme/' || source || '.git'
  WHEN 1 THEN 'http://github.com/acme/' || source || '/tree/main'
  WHEN 2 THEN 'acme/' || source || '.git'
  WHEN 3 THEN source
  WHEN 4 THEN 'github.com/acme/' || source
  WHEN 5 THEN 'https://git.example.org/group/sub/' || source
  WHEN 6 THEN ''
  ELSE 'git@github.com:acme/' || source || '.git' END"""

LABELS = """CASE doc_id % 8
  WHEN 3 THEN source
  WHEN 5 THEN 'sub/' || source
  WHEN 6 THEN ''
  WHEN 7 THEN 'git@github.com:acme/' || source
  ELSE 'acme/' || source END"""

LINKED_PATHS = """CASE doc_id % 3
  WHEN 0 THEN ' /lib/doc_' || doc_id || '.py'
  WHEN 1 THEN 'see https://github.com/acme/x.git/blob/main/a' || doc_id || '.go'
  ELSE 'git@github.com:acme/x/b' || doc_id || '.ts' END"""


def _link() -> str:
    lines = "CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN '#L3' ELSE '#L3-L9' END"
    ref = "CASE WHEN doc_id % 2 = 0 THEN 'main' ELSE 'v1' END"
    # The git@ form is split at its slash only.
    owner = f"""CASE doc_id % 8
      WHEN 3 THEN source
      WHEN 5 THEN 'git.example.org/group'
      WHEN 6 THEN NULL
      WHEN 7 THEN 'git@github.com:acme/' || source
      ELSE 'acme/' || source END"""
    return f"""CASE doc_id % 3
      WHEN 0 THEN 'https://github.com/' || ({owner}) || '/blob/' || {ref} || '/lib/doc_' || doc_id
        || '.py' || {lines}
      WHEN 1 THEN 'https://github.com/acme/x/blob/main/a' || doc_id || '.go' || {lines}
      ELSE 'https://github.com/acme/x/b' || doc_id || '.ts' || {lines} END"""


FIRST_RUN = 1767225600
SECOND_RUN = 1767312000


def _nearest(k: int) -> str:
    """The nearest of all vectors, by comparing each."""
    return f"""WITH {QUERIES}, near AS (
  SELECT query_id, vec_id, {_cosine('embedding', 'query_vec')} AS score
  FROM queries CROSS JOIN embeddings
  WHERE query_vec IS NOT NULL AND embedding IS NOT NULL
)
SELECT query_id, vec_id, round(score, 6) AS score,
       row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
FROM near QUALIFY rank <= {k}"""


def _positions() -> str:
    fields = [
        ("A", "regexp_replace(path, '[^A-Za-z0-9]+', ' ', 'g')"),
        ("B", "summary"),
        ("C", "content"),
    ]
    words = " UNION ALL ".join(
        f"SELECT doc_id, '{weight}' AS weight, unnest(w) AS word, generate_subscripts(w, 1) AS nth "
        f"FROM (SELECT doc_id, {_tokens(text)} AS w FROM chunks)"
        for weight, text in fields
    )
    return f"""{CHUNKS},
words AS (SELECT * FROM ({words}) WHERE word NOT IN {_in(STOP_WORDS)}),
ends AS (
  SELECT doc_id, coalesce(max(nth) FILTER (WHERE weight = 'A'), 0) AS a,
         coalesce(max(nth) FILTER (WHERE weight = 'B'), 0) AS b
  FROM words GROUP BY doc_id
),
placed AS (
  SELECT doc_id, word AS term, weight,
         nth + CASE weight WHEN 'A' THEN 0 WHEN 'B' THEN a ELSE a + b END AS position
  FROM words JOIN ends USING (doc_id)
)"""


SHOWN_K = 30
SHAPED = f"""{_batch(SHOWN_K)},
flat AS (SELECT * FROM best),
shown AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS shown_at
    FROM flat WHERE score >= 0.25
  ) WHERE shown_at <= 20
)"""

PATHS = f"""{FILES},
paths AS (
  SELECT doc_id AS id, '{TREE_ROOT}/' || path AS path FROM files
  UNION ALL SELECT -1 - page_id, url FROM pages
)"""

SCORES = """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE
  WHEN 2 THEN '-inf'::DOUBLE WHEN 3 THEN NULL ELSE n_chars / 1000.0::DOUBLE END AS score
  FROM documents"""


def oracle_sql() -> dict[str, str]:
    flagship = "ref = 'main'"
    return {
        "scan_tree": f"""WITH {FILES} SELECT path, sha1(text) AS content_hash
            FROM files WHERE NOT {_skip(f"'{TREE_ROOT}/' || path")}""",
        "scan_jobs": f"""WITH {FILES} SELECT repository, ref, path, sha1(text) AS content_hash
            FROM files WHERE NOT {_skip(f"'{TREE_ROOT}/' || path")}""",
        "load_chunks": f"""WITH {CHUNKS} SELECT id, repository, ref, path, language, summary,
            sha1(content) AS content_hash, line_start, line_end, {FIRST_RUN} AS created_at
            FROM chunks""",
        "save_chunks": f"""WITH {CHUNKS} SELECT repository, ref, count(*) AS chunks,
            count(summary_vec) AS vectors, sum(line_end)::BIGINT AS lines
            FROM chunks GROUP BY ALL""",
        "search_json": f"""WITH {_scored(flagship)}
            SELECT id, repository, ref, path, language, summary, sha1(content) AS content_hash,
              line_start, line_end, round(score, 6) AS score,
              row_number() OVER (ORDER BY {ORDER}) AS rank
            FROM scored ORDER BY {ORDER} LIMIT 10""",
        "should_skip": f"WITH {PATHS} SELECT id, {_skip('path')}::INT AS skip FROM paths",
        "filter_repository": f"WITH {CHUNKS} SELECT {KEY} FROM chunks WHERE repository = 'src3'",
        "filter_language": f"WITH {CHUNKS} SELECT {KEY} FROM chunks WHERE language = 'python'",
        "filter_path": f"WITH {CHUNKS} SELECT {KEY} FROM chunks "
        "WHERE path ILIKE '%' || 'EN/doc_1%.P_' || '%' ESCAPE '\\'",
        "filter_ref": f"WITH {CHUNKS} SELECT {KEY} FROM chunks WHERE ref = 'dev'",
        "blank_query": f"""SELECT conv_id, turn FROM conversations
            WHERE turn % 3 <> 0 AND trim(text, '{WHITE_SPACE}') <> ''""",
        "min_confidence": f"""WITH {SHAPED} SELECT query_id, rank, path, round(score, 6) AS score
            FROM shown""",
        "check_dim": f"""WITH {CHUNKS} SELECT doc_id FROM chunks
            WHERE summary_vec IS NOT NULL AND doc_id % 10 = 0""",
        "rel_path": f"""WITH {FILES} SELECT doc_id, CASE doc_id % 6
            WHEN 2 THEN '../x/' || path WHEN 3 THEN '{TREE_ROOT}/' || path
            WHEN 4 THEN 'x/' || path WHEN 5 THEN '.' ELSE path END AS rel FROM files""",
        "guess_lang": f"WITH {PATHS} SELECT id, {_lang('path')} AS language FROM paths",
        "chunk_file": f"""SELECT doc_id, 1 AS line_start, {LINES} AS line_end,
            length(text) AS chars FROM documents""",
        "content_hash": "SELECT doc_id, sha1(text) AS content_hash FROM documents",
        "chunk_id": f"WITH {CHUNKS} SELECT doc_id, id FROM chunks",
        "summary_heuristic": f"SELECT doc_id, {_heuristic('text')} AS summary FROM documents",
        "summary_stub": f"""WITH {FILES}, commented AS (
              SELECT doc_id, path, {COMMENTED} AS text FROM files)
            SELECT doc_id, {_stub('path', 'text')} AS summary FROM commented""",
        "summarize": f"""WITH {DELTA} SELECT {KEY},
              CASE WHEN need_summary THEN {_stub('path', 'content')} ELSE old_summary END AS summary
            FROM delta WHERE need_summary OR need_embed""",
        "embed": f"""WITH {DELTA} SELECT {KEY}, CASE WHEN need_embed THEN {DIM} END AS dim,
              CASE WHEN need_embed THEN 0.0::DOUBLE END AS total
            FROM delta WHERE need_summary OR need_embed""",
        "embed_stub": f"SELECT doc_id, {DIM} AS dim, 0.0::DOUBLE AS total FROM documents",
        "prompt_text": f"""WITH {CHUNKS} SELECT doc_id, md5('Path: ' || path || chr(10)
            || 'Language: ' || language || chr(10) || '---' || chr(10)
            || substring(content, 1, 8000)) AS prompt FROM chunks""",
        "one_line": f"""SELECT conv_id, turn, replace(trim(chr(9) || text || chr(10), '{WHITE_SPACE}'),
            chr(10), ' ') AS line FROM conversations""",
        "meta_lookup": f"""WITH {DELTA} SELECT {KEY}, found::INT AS found, old_hash, old_summary,
            CASE WHEN found THEN old_has_vec::INT END AS old_has_vec, source_ref FROM delta""",
        "index_delta": f"""WITH {DELTA} SELECT {KEY}, need_summary::INT AS need_summary,
            need_embed::INT AS need_embed FROM delta""",
        "upsert_chunks": f"""WITH {CHUNKS}, {PREVIOUS}, incoming AS (
              SELECT * REPLACE (
                CASE WHEN doc_id % 4 = 0 THEN '' ELSE summary END AS summary,
                CASE WHEN doc_id % 2 = 0 THEN summary_vec END AS summary_vec)
              FROM chunks WHERE doc_id % 7 <> 6)
            SELECT coalesce(p.id, i.id) AS id, coalesce(i.repository, p.repository) AS repository,
              coalesce(i.ref, p.ref) AS ref, coalesce(i.path, p.path) AS path,
              coalesce(i.line_start, p.line_start) AS line_start,
              coalesce(i.line_end, p.line_end) AS line_end,
              coalesce(i.content_hash, p.content_hash) AS content_hash,
              CASE WHEN i.id IS NULL OR p.id IS NULL THEN coalesce(i.summary, p.summary)
                ELSE coalesce(nullif(i.summary, ''), p.summary) END AS summary,
              round(list_sum(coalesce(i.summary_vec, p.summary_vec)::DOUBLE[]), 6) AS vec_sum,
              CASE WHEN nullif(i.summary, '') IS NOT NULL THEN {SECOND_RUN}
                WHEN p.id IS NOT NULL THEN {FIRST_RUN} END AS summarized_at,
              CASE WHEN p.id IS NULL THEN {SECOND_RUN} ELSE {FIRST_RUN} END AS created_at
            FROM incoming i FULL JOIN previous p
              ON p.repository = i.repository AND p.ref = i.ref AND p.path = i.path
              AND p.line_start = i.line_start AND p.line_end = i.line_end""",
        "index_job": f"""WITH {DELTA} SELECT {KEY}, language, content_hash,
              CASE WHEN need_summary THEN {_stub('path', 'content')} ELSE old_summary END AS summary,
              CASE WHEN need_embed THEN 0.0 ELSE round(list_sum(old_vec::DOUBLE[]), 6) END AS vec_sum,
              CASE WHEN source_ref = ref THEN {FIRST_RUN} ELSE {SECOND_RUN} END AS created_at
            FROM delta
            UNION ALL
            SELECT {KEY}, language, content_hash, summary,
              round(list_sum(summary_vec::DOUBLE[]), 6), {FIRST_RUN}
            FROM previous WHERE ref = 'old'""",
        "query_cross": f"""WITH {CHUNKS}, q AS (
              SELECT text AS query_text FROM benchmark
              WHERE item_id = (SELECT max(item_id) FROM benchmark))
            SELECT doc_id, {_longest('query_text')} AS token,
              round({_tri('path', _longest('query_text'))}, 6) AS tri,
              {_bias('language', _asked('query_text'))} AS bias
            FROM chunks CROSS JOIN q""",
        "term_unnest": f"""SELECT conv_id, term, count(*) AS hits FROM (
              SELECT conv_id, unnest({_terms('text')}) AS term FROM conversations)
            GROUP BY ALL""",
        "repositories": "SELECT DISTINCT source AS repository FROM documents",
        "refs": f"WITH {CHUNKS} SELECT DISTINCT ref FROM chunks WHERE repository = 'src0'",
        "query_terms": f"""SELECT item_id,
            array_to_string(list_sort(list_distinct({_terms('text')})), ' ') AS terms FROM benchmark""",
        "score_maxima": f"""WITH {_scored(flagship)} SELECT round(max(sem), 6) AS max_sem,
            round(max(lex), 6) AS max_lex, round(max(tri), 6) AS max_tri FROM terms""",
        "max_over_all": f"""WITH {_scored(flagship)} SELECT {KEY}, round(max_sem, 6) AS max_sem,
            round(max_lex, 6) AS max_lex, round(max_tri, 6) AS max_tri FROM scored""",
        "display_pct": f"""WITH {SHAPED}, bounds AS (
              SELECT query_id, min(score) AS low, max(score) AS high FROM shown GROUP BY query_id)
            SELECT query_id, rank, CASE WHEN high = low THEN 100 ELSE
              floor((0.2::DOUBLE + (score - low) / (high - low) * 0.8::DOUBLE) * 100 + 0.5)::INT
              END AS pct
            FROM shown JOIN bounds USING (query_id)""",
        "batch_results": f"""WITH {_batch(5)}
            SELECT query_id, rank, path, sha1(content) AS content_hash, round(score, 6) AS score
            FROM best""",
        "batch_topk": f"WITH {_batch(5)} SELECT query_id, {SEARCH_COLUMNS}, rank FROM best",
        "topk": _search("true", 5),
        "clamp_limit": """SELECT doc_id, least(greatest(doc_id % 50 - 10, 1), 20) AS k
            FROM documents""",
        "cosine_sim": f"""WITH {_scored('true')} SELECT doc_id, round(sem, 6) AS sem FROM terms""",
        "cosine_sim_builtin": f"""WITH {_scored('true')}
            SELECT doc_id, round(sem, 6) AS sem FROM terms""",
        "lexical_rank": f"WITH {_scored('true')} SELECT doc_id, round(lex, 6) AS lex FROM terms",
        "trigram_sim": f"WITH {_scored('true')} SELECT doc_id, round(tri, 6) AS tri FROM terms",
        "longest_token": f"""SELECT conv_id, turn, {_longest('text')} AS token
            FROM conversations""",
        "asked_for_script": f"""SELECT doc_id, {_asked('text')}::INT AS asked FROM documents""",
        "script_bias": f"""WITH {CHUNKS} SELECT doc_id,
            {_bias('language', '(doc_id % 2 = 0)')} AS bias FROM chunks""",
        "noise_penalty": f"WITH {PATHS} SELECT id, {_noise('path')} AS noise FROM paths",
        "hybrid_score": f"""WITH {_scored('true')} SELECT doc_id, round(score, 6) AS score
            FROM scored""",
        "sanitize_score": f"""SELECT doc_id, CASE WHEN score IS NULL OR isnan(score)
            OR isinf(score) THEN 0.0 ELSE round(score, 6) END AS score FROM ({SCORES})""",
        "hybrid_search": _search(flagship, 10, stemmed=True),
        "hybrid_search_unstemmed": _search(flagship, 10),
        "analyze_text": f"""SELECT doc_id, len({_terms('text')}) AS terms,
            md5(array_to_string({_terms('text')}, ' ')) AS digest FROM documents""",
        "analyze_text_stemmed": f"""WITH {_stemmed_words("SELECT doc_id, text FROM documents")}
            SELECT doc_id, count(stem) AS terms,
              md5(coalesce(string_agg(stem, ' ' ORDER BY nth), '')) AS digest
            FROM documents LEFT JOIN stemmed USING (doc_id) GROUP BY doc_id""",
        "path_tokens": f"""WITH {PATHS} SELECT id, array_to_string(
            {_terms("regexp_replace(path, '[^A-Za-z0-9]+', ' ', 'g')")}, ' ') AS terms FROM paths""",
        "fielded_postings": f"""WITH {_positions()}
            SELECT term, doc_id, count(*) FILTER (WHERE weight = 'A') AS hits_a,
              count(*) FILTER (WHERE weight = 'B') AS hits_b, count(*) FILTER (WHERE weight = 'C') AS hits_c,
              min(position) AS first_position, max(position) AS last_position,
              string_agg(position || weight, ' ' ORDER BY position) AS positions
            FROM placed GROUP BY term, doc_id""",
        "vector_ann": _nearest(10),
        "ann_recall": f"""WITH {QUERIES} SELECT count(*) AS queries, 1 AS enough
            FROM queries WHERE query_vec IS NOT NULL""",
        "flat_results": f"""WITH {_scored(flagship)}
            SELECT path, language, line_start, line_end, round(score, 6) AS score,
              sha1(content) AS preview, summary, ref, repository
            FROM scored ORDER BY {ORDER} LIMIT 10""",
        "source_url": f"SELECT doc_id, {_link()} AS url FROM documents",
        "repo_label": f"SELECT doc_id, {LABELS} AS label FROM documents",
        "is_local": "SELECT doc_id, (doc_id % 8 = 3)::INT AS is_local FROM documents",
        "display_text": f"""WITH shaped AS (
              SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN chr(9) || ' '
                ELSE 'Summary ' || doc_id END AS summary FROM documents)
            SELECT doc_id, sha1(CASE WHEN coalesce(trim(summary, '{PAGE_SPACE}'), '') <> ''
              THEN summary ELSE text END) AS shown FROM shaped""",
        "result_counts": f"""WITH {SHAPED} SELECT query_id,
              least(count(*) FILTER (WHERE score >= 0.25), 20) AS shown,
              count(*) FILTER (WHERE score >= 0.25) AS passing, count(*) AS total,
              (count(*) FILTER (WHERE score >= 0.25) > 20)::INT AS limited
            FROM flat GROUP BY query_id""",
        "changed_files": f"""WITH {FILES} SELECT path, 1 + (doc_id % 3 = 0)::BIGINT AS times,
              sha1(CASE WHEN doc_id % 3 = 0 THEN text || ' v2' ELSE text END) AS content_hash
            FROM files WHERE NOT {_skip(f"'{TREE_ROOT}/' || path")}""",
        "index_stream": f"""WITH {FILES}, final AS (
              SELECT repository, ref, path,
                CASE WHEN doc_id % 3 = 0 THEN text || ' v2' ELSE text END AS text FROM files)
            SELECT repository, ref, path, 1 AS line_start, {LINES} AS line_end,
              sha1(text) AS content_hash, {_stub('path', 'text')} AS summary, {DIM} AS dim
            FROM final""",
        "provider": f"""WITH {DELTA}, told AS (
              SELECT *, CASE WHEN NOT need_summary THEN old_summary
                WHEN length(path) % 2 = 1 THEN language || ' file ' || path
                ELSE summary END AS new_summary
              FROM delta WHERE need_summary OR need_embed)
            SELECT {KEY}, new_summary AS summary,
              CASE WHEN need_embed AND length(new_summary) % 5 <> 0
                THEN length(new_summary)::DOUBLE END AS total
            FROM told""",
    }
