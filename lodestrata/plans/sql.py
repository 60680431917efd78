"""SQL for DuckDB that gives the same rows as the registry's queries."""

from __future__ import annotations

from ..operators.context import ANSWER_TOKENS, NO_CONTEXT, TASKS

QUESTIONS = (
    "authenticate user password jwt", "database connection pool retry", "cache invalidation eviction", "order payment billing process",
    "batch operations bulk insert", "health check status endpoint", "shutdown close cleanup graceful", "validate config host port timeout",
)

FILES = "files_now AS (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY repo_id, relative_path ORDER BY loaded_at DESC, size_bytes DESC NULLS LAST) = 1)"
CHUNKS = "chunks_now AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC, ord DESC) = 1)"
NAME = r"regexp_extract(relative_path, '[^/]*$')"
ENDING = rf"lower(regexp_extract({NAME}, '^.+(\.[^.]+)$', 1))"


def _tokens(text: str) -> str:
    return rf"regexp_extract_all(lower(regexp_replace(coalesce({text}, ''), '([a-z])([A-Z])', '\1 \2', 'g')), '[a-zA-Z0-9]+')"


def _bm25(queries: tuple[str, ...], docs: str = "SELECT doc_id, text FROM documents", ctes: str = "") -> str:
    asked = ", ".join(f"({i}, '{q}')" for i, q in enumerate(queries))
    return f"""
    WITH {ctes + ', ' if ctes else ''}docs AS ({docs}),
    tok AS (SELECT doc_id, {_tokens('text')} AS t FROM docs),
    sized AS (SELECT doc_id, len(t) AS dl, t FROM tok),
    stats AS (SELECT count(*) AS n, sum(dl) / greatest(count(*), 1) AS avgdl FROM sized),
    postings AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, dl, unnest(t) AS term FROM sized) GROUP BY ALL),
    dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
    q AS (SELECT * FROM (VALUES {asked}) v(query_id, query)),
    terms AS (SELECT query_id, term, count(*) AS weight FROM (SELECT query_id, unnest({_tokens('query')}) AS term FROM q) GROUP BY ALL),
    scored AS (SELECT query_id, doc_id, sum(weight * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
               FROM terms JOIN dfs USING (term) JOIN postings USING (term), stats GROUP BY ALL),
    ranked AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM scored)
    """


LINES = r"regexp_split_to_array({0}, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]')"


def _lines(text: str) -> str:
    rows = LINES.format(text)
    return f"CASE WHEN {rows}[-1] = '' THEN {rows}[:-2] ELSE {rows} END"


_known = "('.py', '.js', '.ts', '.tsx', '.jsx', '.java', '.go', '.rs', '.cpp', '.c', '.cs', '.rb', '.php', '.swift', '.kt', '.scala', '.sh', '.md', '.yaml', '.yml', '.json', '.toml', '.xml', '.properties', '.gradle', '.sql', '.html', '.css', '.scss')"
_language = "CASE {0} WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.jsx' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.java' THEN 'java' WHEN '.go' THEN 'go' WHEN '.sh' THEN 'bash' WHEN '.md' THEN 'markdown' WHEN '.yaml' THEN 'yaml' WHEN '.yml' THEN 'yaml' WHEN '.json' THEN 'json' WHEN '.properties' THEN 'properties' WHEN '.sql' THEN 'sql' WHEN '.css' THEN 'css' END".format(ENDING)
_skipped = "['.git','.svn','.hg','node_modules','__pycache__','.pytest_cache','venv','.venv','env','.env','dist','build','target','out','.gradle','.mvn','logs','log','tmp','temp','generated','generated-sources','generated-test-sources','.idea','.vscode','coverage','.coverage','migrations'{0}]"
_folders = "string_split(relative_path, '/')[:-2]"
_size = "coalesce(size_bytes, octet_length(encode(content)))"
_changed = "SELECT f.repo_id, f.relative_path, f.content_hash FROM files_now f WHERE NOT EXISTS (SELECT 1 FROM file_state s WHERE s.repo_id = f.repo_id AND s.relative_path = f.relative_path AND s.content_hash = f.content_hash)"
_sort_cosine = "row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 9) DESC, d.vec_id) - 1"
_frontend = "('.js', '.jsx', '.ts', '.tsx', '.json', '.md', '.yaml', '.yml', '.html', '.css', '.scss')"
_spring = "('.java', '.kt', '.xml', '.yml', '.yaml', '.properties', '.gradle', '.md', '.json', '.sql')"
_history = "turns AS (SELECT conv_id, turn, max_by(role, struct_pack(r := coalesce(role, ''), c := coalesce(content, ''))) AS role, max_by(content, struct_pack(r := coalesce(role, ''), c := coalesce(content, ''))) AS content FROM history GROUP BY ALL)"

_common = "['.git','.svn','.hg','.idea','.vscode','node_modules','target','build','dist','out','.gradle','.mvn','__pycache__','.pytest_cache','coverage','logs','log','tmp','temp','generated','generated-sources','generated-test-sources']"
_planned = f"NOT list_has_any({_folders}, {_skipped.format('')}) AND NOT list_has_any({_folders}, {_common})"
_names = "('package.json', 'tsconfig.json', 'angular.json', 'vite.config.js', 'vite.config.ts', 'next.config.js', 'next.config.ts')"
_builds = "('pom.xml', 'build.gradle', 'settings.gradle', 'gradle.properties')"
#: The outermost marked folders, conventional folders at the root, and what their files come to.
_areas = rf"""
    seen AS (SELECT repo_id, relative_path, path, size_bytes, lower({NAME}) AS name, {ENDING} AS ending, {NAME} AS written, string_split(relative_path, '/') AS parts, regexp_replace(relative_path, '/?[^/]*$', '') AS folder, {_planned} AS planned FROM files_now WHERE relative_path IS NOT NULL),
    marks AS (SELECT repo_id, folder, CASE WHEN name = 'pom.xml' THEN 'maven' WHEN name IN ('build.gradle', 'settings.gradle') THEN 'gradle' WHEN name = 'package.json' THEN 'node-ui' WHEN name = 'angular.json' THEN 'angular'
              WHEN name IN ('application.yml', 'application.yaml', 'application.properties') THEN 'spring-config' WHEN starts_with(name, 'vite.config') THEN 'vite' WHEN starts_with(name, 'next.config') THEN 'next' END AS mark FROM seen WHERE planned),
    below AS (SELECT DISTINCT repo_id, array_to_string(parts[1:i - 1], '/') AS folder, parts[i] AS child FROM (SELECT repo_id, parts, unnest(range(1, len(parts))) AS i FROM seen WHERE planned)),
    every AS (SELECT DISTINCT repo_id, folder, mark FROM marks WHERE mark IS NOT NULL UNION SELECT repo_id, folder, 'spring-layout' FROM below WHERE child = 'java' AND ends_with(folder, 'src/main')
              UNION SELECT b.repo_id, b.folder, 'java-project' FROM below b JOIN seen s ON s.planned AND s.repo_id = b.repo_id AND s.folder = b.folder AND s.name IN ('pom.xml', 'build.gradle') WHERE b.child = 'src'),
    marked AS (SELECT repo_id, folder, list_sort(list(mark)) AS marks FROM every GROUP BY ALL),
    roots AS (SELECT repo_id, min(path[1:length(path) - length(relative_path) - 1]) AS root FROM seen GROUP BY repo_id),
    outmost AS (SELECT m.repo_id, m.folder AS area, m.marks, r.root || CASE WHEN m.folder = '' THEN '' ELSE '/' || m.folder END AS whole FROM marked m JOIN roots r USING (repo_id)
              WHERE NOT EXISTS (SELECT 1 FROM marked o WHERE o.repo_id = m.repo_id AND o.folder <> m.folder AND (o.folder = '' OR starts_with(m.folder, o.folder || '/')))),
    chosen AS (SELECT repo_id, area, CASE WHEN list_has_any(marks, ['node-ui', 'angular', 'vite', 'next']) OR lower(regexp_extract(whole, '[^/]*$')) IN ('ui', 'frontend', 'web') THEN 'frontend' WHEN contains(lower(whole), 'framework') THEN 'java-library'
              WHEN list_has_any(marks, ['spring-config', 'spring-layout']) OR lower(regexp_extract(whole, '[^/]*$')) IN ('backend', 'server', 'service') THEN 'spring' WHEN list_has_any(marks, ['maven', 'gradle', 'java-project']) THEN 'java-library' ELSE 'generic' END AS profile,
              'Detected ' || array_to_string(marks, ', ') AS reason FROM outmost
              UNION ALL SELECT repo_id, top, CASE top WHEN 'backend' THEN 'spring' WHEN 'framework' THEN 'java-library' ELSE 'frontend' END, 'Detected conventional ' || top || '/ area.'
              FROM (SELECT DISTINCT repo_id, parts[1] AS top FROM seen WHERE len(parts) > 1 AND parts[1] IN ('backend', 'framework', 'ui', 'frontend')) t WHERE NOT EXISTS (SELECT 1 FROM outmost o WHERE o.repo_id = t.repo_id AND o.area IN ('', t.top))),
    areas AS (SELECT * FROM chosen UNION ALL SELECT repo_id, '', 'generic', 'No framework markers found; using generic source profile.' FROM roots WHERE repo_id NOT IN (SELECT repo_id FROM chosen)),
    kept AS (SELECT repo_id, folder, CASE WHEN ending = '' THEN written ELSE ending END AS key, count(*) AS n, sum(coalesce(size_bytes, 0)) AS size FROM seen WHERE planned GROUP BY ALL),
    met AS (SELECT a.repo_id, a.area, sum(n) AS files, sum(size)::BIGINT AS bytes FROM areas a JOIN kept k ON k.repo_id = a.repo_id AND (a.area = '' OR k.folder = a.area OR starts_with(k.folder, a.area || '/'))
              WHERE CASE profile WHEN 'frontend' THEN (key IN {_frontend} OR key IN {_names}) AND size // n <= 358400 WHEN 'spring' THEN (key IN {_spring} OR key IN {_builds}) AND size // n <= 512000
              WHEN 'java-library' THEN (key IN {_spring} AND key <> '.sql' OR key IN {_builds}) AND size // n <= 512000 ELSE key IN {_known} AND size // n <= 512000 END GROUP BY ALL)
"""
_blank = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _hashed(source: str, name: str) -> str:
    """CTEs that end in name(k, place, v): the hashed vectors, as single-precision numbers, of source(k, t).

    A code modulo 768 is its low byte and 256 times the rest modulo 3, and 16 is 1 modulo 3.
    """
    part = [f"('0x' || h[{a}:{a + 1}])::INT" for a in (25, 27, 29, 31)]
    return rf"""{name}_w AS (SELECT k, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM (SELECT k, regexp_extract_all(lower(t), '[^{_blank}]+')[1:150] AS ws FROM ({source}))),
    {name}_h AS (SELECT k, i, ('0x' || h[1:15])::BIGINT + ('0x' || h[16:24])::BIGINT AS ab, {part[0]} AS c1, {part[1]} AS c2, {part[2]} AS c3, {part[3]} AS c4 FROM (SELECT k, i, md5(word) AS h FROM {name}_w)),
    {name}_p AS (SELECT k, i, unnest([c4 + 256 * ((ab + c1 + c2 + c3) % 3), c3 + 256 * ((ab + c1 + c2) % 3), c2 + 256 * ((ab + c1) % 3), c1 + 256 * (ab % 3)])::INT AS place FROM {name}_h),
    {name}_s AS (SELECT k, place, sum(1.0::DOUBLE / (i + 1)) AS v FROM {name}_p GROUP BY ALL),
    {name} AS (SELECT k, place, (v / sqrt(sum(v * v) OVER (PARTITION BY k)))::FLOAT::DOUBLE AS v FROM {name}_s)"""


_shown_text = "'# ' || coalesce(context_header, '') || chr(10) || '# ' || array_to_string(string_split(file_path, '/')[-3:], '/') || chr(10)"
_chunk_vectors = _hashed(f"SELECT ord AS k, {_shown_text} || content[1 : greatest(2048 - length({_shown_text}), 0)] AS t FROM chunks_now", "cv")


def _nearest(questions: dict[int, str], k: int) -> str:
    """CTEs that end in near(query_id, doc_id, rank): the k nearest chunks of each question."""
    rows = ", ".join(f"({i}, '{q}')" for i, q in questions.items())
    return f"""{_chunk_vectors}, {_hashed(f"SELECT * FROM (VALUES {rows}) v(k, t)", "qv")},
    cu AS (SELECT k, place, v / sqrt(sum(v * v) OVER (PARTITION BY k)) AS v FROM cv), qu AS (SELECT k, place, v / sqrt(sum(v * v) OVER (PARTITION BY k)) AS v FROM qv),
    dots AS (SELECT qu.k AS query_id, cu.k AS doc_id, sum(qu.v * cu.v) AS dot FROM qu JOIN cu USING (place) GROUP BY ALL),
    near AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(dot, 9) DESC, doc_id) - 1 AS rank FROM dots QUALIFY rank < {k})"""


def _relevant(source: str, name: str) -> str:
    """CTEs that end in name(*, cut): the lines of source(*, content, toks) around those that hold a token."""
    hit = "list_has_any(regexp_extract_all(lower(x), '[a-zA-Z0-9_]{3,}'), toks)"
    return f"""{name}_l AS (SELECT *, {_lines('content')} AS l FROM ({source})),
    {name}_h AS (SELECT *, list_transform(l, lambda x: {hit}) AS hit FROM {name}_l),
    {name}_k AS (SELECT *, list_transform(range(1, len(l) + 1), lambda i: list_contains(hit[greatest(1, i - 3) : i + 3], true)) AS keep FROM {name}_h),
    {name}_c AS (SELECT *, array_to_string(list_filter(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN keep[i] THEN l[i] WHEN i = 1 OR keep[i - 1] THEN '    # ...' END), lambda x: x IS NOT NULL), chr(10)) AS short FROM {name}_k),
    {name} AS (SELECT * EXCLUDE (l, hit, keep, short), CASE WHEN len(toks) = 0 OR len(l) <= 6 OR NOT list_contains(hit, true) OR length(short) >= 0.85 * length(content) THEN content ELSE short END AS cut FROM {name}_c)"""


def _contexts(source: str) -> str:
    """CTEs that end in contexts(query_id, context, sources) of source(query_id, rank, query, file_path, start_line, end_line, chunk_type, name, language, content)."""
    toks = "list_distinct(regexp_extract_all(lower(query), '[a-zA-Z0-9_]{3,}'))"
    return f"""{_relevant(f"SELECT *, {toks} AS toks FROM ({source})", "rl")},
    formed AS (SELECT query_id, rank, file_path, greatest(3396 - greatest(1, length(query) // 3), 600) AS room,
      '### ' || file_path || ' (lines ' || start_line || '–' || end_line || ')' || CASE WHEN coalesce(name, '') <> '' THEN ' — ' || chunk_type || ': `' || name || '`' ELSE '' END || chr(10) || '```' || coalesce(language, '') || chr(10) || cut || chr(10) || '```' AS body FROM rl),
    counted AS (SELECT *, greatest(1, length(body) // 3) AS tokens FROM formed),
    upto AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank) AS upto FROM counted),
    ended AS (SELECT *, sum((upto > room)::INT) OVER (PARTITION BY query_id ORDER BY rank) AS over_, room - (upto - tokens) AS room_left FROM upto),
    fitted AS (SELECT query_id, rank, file_path, CASE WHEN over_ = 0 THEN body ELSE body[1 : (room_left * 3)::BIGINT] || chr(10) || '# [... truncated for context budget]' END AS body FROM ended WHERE over_ = 0 OR over_ = 1 AND upto > room AND room_left > 80),
    firsts AS (SELECT query_id, file_path, min(rank) AS first FROM fitted GROUP BY ALL),
    named AS (SELECT query_id, list(file_path ORDER BY first) AS sources FROM firsts GROUP BY query_id),
    contexts AS (SELECT f.query_id, '# Code context from ' || len(any_value(n.sources)) || ' file(s)' || chr(10) || string_agg(body, chr(10) || chr(10) ORDER BY rank DESC) AS context, any_value(n.sources) AS sources FROM fitted f JOIN named n USING (query_id) GROUP BY f.query_id)"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _prompt(task: str, query: str, context: str, sources: str) -> str:
    """system, user and max_tokens."""
    system = f"CASE {task} " + " ".join(f"WHEN '{k}' THEN {_quoted(v)}" for k, v in TASKS.items()) + f" ELSE {_quoted(TASKS['general'])} END"
    tokens = f"CASE {task} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ANSWER_TOKENS.items()) + " ELSE 1024 END"
    note = f"CASE WHEN len({sources}) > 0 THEN chr(10) || 'Source files used:' || chr(10) || coalesce(array_to_string(list_transform({sources}[1:6], lambda s: '  - ' || s), chr(10)), '') || chr(10) ELSE '' END"
    user = f"CASE WHEN {context} IS NULL THEN {_quoted(NO_CONTEXT)} || chr(10) || chr(10) || {query} WHEN length({context}) > 0 THEN {note} || chr(10) || {context} || chr(10) || chr(10) || '---' || chr(10) || chr(10) || {query} ELSE {query} END"
    return f"{system} AS system, {user} AS user, {tokens} AS max_tokens"


def _grep(terms: tuple[str, ...], where: str = "") -> str:
    """CTEs that end in win(file_path, s, line_number, term_ord, names, l): windows around the lines that hold a term."""
    values = ", ".join(f"({i}, '{t}')" for i, t in enumerate(terms))
    return f"""gr AS (SELECT repo_id || '/' || relative_path AS file_path, {_lines('content')} AS l FROM files_now WHERE content IS NOT NULL {where}),
    gx AS (SELECT file_path, unnest(l) AS line, generate_subscripts(l, 1) AS line_number FROM gr),
    gh AS (SELECT file_path, line_number::INT AS line_number, term, term_ord FROM gx JOIN (VALUES {values}) t(term_ord, term) ON contains(lower(line), lower(term))
          QUALIFY row_number() OVER (PARTITION BY term_ord, file_path ORDER BY line_number) <= 15),
    gm AS (SELECT file_path, line_number, arg_min(term, term_ord) AS term, min(term_ord) AS term_ord FROM gh GROUP BY ALL),
    gw AS (SELECT file_path, greatest(0, line_number - 11) AS s, arg_min(line_number, struct_pack(a := term_ord, b := line_number)) AS line_number, min(term_ord) AS term_ord FROM gm GROUP BY ALL),
    gn AS (SELECT file_path, greatest(0, line_number - 11) AS s, term, min(term_ord) AS t FROM gm GROUP BY ALL),
    win AS (SELECT w.file_path, w.s, w.line_number, w.term_ord, n.names, gr.l, least(len(gr.l), w.line_number + 9) AS stop FROM gw w JOIN (SELECT file_path, s, string_agg(term, ',' ORDER BY t) AS names FROM gn GROUP BY ALL) n USING (file_path, s) JOIN gr USING (file_path))"""


def _simple(text: str) -> str:
    """Whole words in lower case, and their parts where lower case turns to capitals."""
    word = "regexp_replace(w, '([a-z])([A-Z])', '\\1 \\2', 'g')"
    return f"list_distinct(flatten(list_transform(regexp_extract_all({text}, '[a-zA-Z0-9_]+'), lambda w: CASE WHEN contains({word}, ' ') THEN list_concat([lower(w)], string_split(lower({word}), ' ')) ELSE [lower(w)] END)))"


def _rerank(source: str, query: str, terms: tuple[str, ...], top_k: int, task: str = "general") -> str:
    """CTEs that end in best(o, score, rank) of source(o, file_path, name, content, score); o sorts the input."""
    lowered = sorted({t.lower() for t in terms})
    hits = " + ".join(f"contains(lower(coalesce(content, '')), '{t}')::INT" for t in lowered)
    names = "(" + ", ".join(f"'{t}'" for t in lowered) + ")"
    test = "1.0" if task in ("review", "debug") else "CASE WHEN contains(lower(file_path), 'test') OR contains(lower(file_path), 'spec') THEN 0.6 ELSE 1.0 END"
    return f"""rq AS (SELECT {_simple(_quoted(query))} AS q, {_simple(_quoted(' '.join(terms)))} AS p),
    ro AS (SELECT o, file_path, lower(coalesce(name, '')) AS name, score::DOUBLE AS score, ({hits}) AS hits, {_simple("coalesce(content, '')")} AS own FROM ({source})),
    rs AS (SELECT o, file_path, name, score, hits, len(list_intersect(q, own))::DOUBLE / greatest(len(q), 1) AS oq, len(list_intersect(p, own))::DOUBLE / greatest(len(p), 1) AS op FROM ro, rq),
    rt AS (SELECT o, file_path, (score + 2.0::DOUBLE * hits + CASE WHEN name IN {names} THEN 3.0 ELSE 0.0 END + 0.5::DOUBLE * oq + 0.8::DOUBLE * op) * CASE WHEN greatest(oq, op) < 0.05 AND hits = 0 THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END * ({test})::DOUBLE AS score FROM rs),
    rd AS (SELECT o, round(score / (1 + 0.5::DOUBLE * (row_number() OVER (PARTITION BY file_path ORDER BY o) - 1)), 4) AS score FROM rt),
    best AS (SELECT o, score, row_number() OVER (ORDER BY score DESC, o) - 1 AS rank FROM rd QUALIFY rank < {top_k})"""


def _chunk_bm25(queries: tuple[str, ...]) -> str:
    return _bm25(queries, "SELECT ord AS doc_id, content AS text FROM chunks_now", CHUNKS)


#: The pipeline's question, its terms, and the chunks of both searches merged.
_question, _terms = "where does ledger retry the cache shipment", ("where", "ledger", "retry")
_code = r"AND regexp_extract(relative_path, '\.[^./]*$') IN ('.py', '.java', '.js', '.ts', '.go', '.rs', '.kt', '.cs', '.rb', '.cpp', '.c', '.scala', '.swift')"
_grep_language = "CASE regexp_extract(file_path, '\\.[^./]*$') WHEN '.py' THEN 'python' WHEN '.java' THEN 'java' WHEN '.js' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.go' THEN 'go' ELSE 'text' END"
_pipeline = (
    _chunk_bm25((_question,)).replace("WITH ", f"WITH {FILES}, ", 1)
    + f""", {_nearest({0: _question}, 80)}, {_grep(_terms, _code)},
    whole AS (SELECT d.doc_id, coalesce(s.score, 0) AS score FROM docs d LEFT JOIN scored s ON s.doc_id = d.doc_id), words AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS rank FROM whole QUALIFY rank < 80),
    fused AS (SELECT doc_id, sum(part) AS score FROM (SELECT doc_id, 0.3::DOUBLE / (60 + rank) AS part FROM words UNION ALL SELECT doc_id, 0.7::DOUBLE / (60 + rank) FROM near) GROUP BY doc_id),
    sem AS (SELECT doc_id, score, row_number() OVER (ORDER BY round(score, 12) DESC, doc_id) - 1 AS rank FROM fused QUALIFY rank < 10),
    semantic AS (SELECT c.id, c.repo_id || '/' || c.file_path AS file_path, c.language, c.start_line, c.end_line, c.chunk_type, c.name, c.content, s.score, s.rank FROM sem s JOIN chunks_now c ON c.ord = s.doc_id),
    literal AS (SELECT file_path || ':' || (s + 1) || '-' || stop || ':grep' AS id, file_path, {_grep_language} AS language, s + 1 AS start_line, stop AS end_line, 'grep_match' AS chunk_type, names AS name, array_to_string(l[s + 1 : stop], chr(10)) AS content,
                row_number() OVER (ORDER BY term_ord, file_path, line_number) AS place FROM win),
    both_ AS (SELECT id, file_path, (start_line // 15) * 15 AS bucket, 1.2::DOUBLE AS score, true AS g, place AS seq FROM literal UNION ALL SELECT id, file_path, (start_line // 15) * 15, score, false, rank FROM semantic),
    spans AS (SELECT file_path, bucket, count(*) FILTER (g) > 0 AS has_literal, arg_min(id, seq) FILTER (g) AS lit, coalesce(sum(score) FILTER (NOT g), 0) AS total, arg_min(score, seq) FILTER (NOT g) AS first, arg_max(id, seq) FILTER (NOT g) AS late,
              min(struct_pack(late := NOT g, seq := seq)) AS o FROM both_ GROUP BY ALL),
    merged AS (SELECT o, coalesce(late, lit) AS id, CASE WHEN has_literal THEN 1.2::DOUBLE + 0.5::DOUBLE * total ELSE first + 0.5::DOUBLE * (total - first) END AS score FROM spans),
    payload AS (SELECT id, file_path, language, start_line, end_line, chunk_type, name, content FROM literal UNION ALL SELECT id, file_path, language, start_line, end_line, chunk_type, name, content FROM semantic),
    {_rerank("SELECT m.o, p.file_path, p.name, p.content, m.score FROM merged m JOIN payload p USING (id)", _question, _terms, 5)},
    final AS (SELECT p.*, b.score, b.rank FROM best b JOIN merged m USING (o) JOIN payload p ON p.id = m.id)
"""
)


SQL: dict[str, str] = {
    "bm25_topk": _bm25(QUESTIONS) + "SELECT query_id, doc_id, round(score, 6) AS score, rank FROM ranked WHERE rank < 5",
    "bm25_chunks_topk": _chunk_bm25(("retry ledger cache", "parse token stream", "getUserById order"))
    + "SELECT r.query_id, c.id, round(r.score, 6) AS score, r.rank FROM ranked r JOIN chunks_now c ON c.ord = r.doc_id WHERE r.rank < 5",
    "bm25_statistics": _bm25(("a",)) + "SELECT n, round(avgdl, 6) AS avgdl, (SELECT sum(tf) FROM postings) AS tokens, (SELECT count(DISTINCT term) FROM postings) AS terms FROM stats",
    "bm25_document_frequency": _bm25(("a",)) + "SELECT term, df FROM dfs",
    "bm25_padded": _bm25(("zzqx pump", "qqqqxx"))
    + """, every AS (SELECT t.query_id, d.doc_id, coalesce(s.score, 0.0) AS score FROM (SELECT DISTINCT query_id FROM terms) t, docs d LEFT JOIN scored s ON s.query_id = t.query_id AND s.doc_id = d.doc_id),
    placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM every)
    SELECT query_id, doc_id, round(score, 6) AS score, rank FROM placed WHERE rank < 20""",
    "rrf_fusion": _bm25(("ledger meter", "pump ledger cache"))
    + """, parts AS (SELECT 0 AS query_id, doc_id, (CASE query_id WHEN 0 THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END) / (60 + rank) AS part FROM ranked WHERE rank < 40),
    fused AS (SELECT query_id, doc_id, sum(part) AS score FROM parts GROUP BY ALL),
    placed AS (SELECT *, row_number() OVER (ORDER BY round(score, 12) DESC, doc_id) - 1 AS rank FROM fused)
    SELECT query_id, doc_id, round(score, 9) AS score, rank FROM placed WHERE rank < 10""",
    "file_scoped_retrieval": _bm25(("ledger meter",), "SELECT doc_id, text FROM documents WHERE contains(replace(source, '\\', '/'), 'wiki/')")
    + "SELECT query_id, doc_id, round(1.0::DOUBLE / (60 + rank), 9) AS score, rank FROM ranked WHERE rank < 5",
    "bm25_cold": _bm25(QUESTIONS) + "SELECT query_id, doc_id, round(score, 6) AS score, rank FROM ranked WHERE rank < 5",
    "multi_strategy": _chunk_bm25(("ledger retry cache", "pump ledger"))
    + f""", {_nearest({0: "def retry_ledger(cache):' || chr(10) || '    return ledger.retry(cache)", 1: "ledger retry cache", 2: "pump ledger", 3: "meter cache"}, 24)},
    summed AS (SELECT doc_id, sum(score * CASE query_id WHEN 0 THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END) AS score FROM scored GROUP BY doc_id),
    whole AS (SELECT d.doc_id, coalesce(s.score, 0) AS score FROM docs d LEFT JOIN summed s USING (doc_id)),
    words AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) - 1 AS rank FROM whole QUALIFY rank < 24),
    parts AS (SELECT doc_id, 0.8::DOUBLE / (60 + rank) AS part FROM words UNION ALL SELECT doc_id, (CASE query_id WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.85::DOUBLE ELSE 0.75::DOUBLE END) / (60 + rank) FROM near),
    fused AS (SELECT doc_id, round(sum(part), 4) AS score FROM parts GROUP BY doc_id),
    placed AS (SELECT *, row_number() OVER (ORDER BY score) - 1 AS place, count(*) OVER () AS n FROM fused),
    edge AS (SELECT max(score) AS edge FROM placed WHERE place = greatest(0, n - floor(n * 0.8) - 1))
    SELECT doc_id, score FROM placed, edge WHERE NOT (n > 8 AND (SELECT count(*) FROM placed, edge WHERE score >= edge) >= 4) OR score >= edge""",
    "hybrid_chunks": _chunk_bm25(QUESTIONS)
    + f""", {_nearest(dict(enumerate(QUESTIONS)), 40)},
    fused AS (SELECT query_id, doc_id, sum(part) AS score FROM (SELECT query_id, doc_id, 0.3::DOUBLE / (60 + rank) AS part FROM ranked WHERE rank < 40 UNION ALL SELECT query_id, doc_id, 0.7::DOUBLE / (60 + rank) FROM near) GROUP BY ALL),
    placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, doc_id) - 1 AS rank FROM fused)
    SELECT p.query_id, c.id, round(p.score, 9) AS score, p.rank FROM placed p JOIN chunks_now c ON c.ord = p.doc_id WHERE p.rank < 5""",
    "hashed_embeddings": f"WITH {CHUNKS}, {_chunk_vectors} SELECT c.id, v.place, round(v.v, 5) AS value FROM cv v JOIN chunks_now c ON c.ord = v.k",
    "pipeline_chunks": _pipeline + "SELECT id, chunk_type, start_line, round(score, 3) AS score, rank FROM final",
    "pipeline_context": _pipeline
    + f""", {_contexts(f"SELECT 0 AS query_id, *, '{_question}' AS query FROM final")}, shown AS (SELECT context, sources, {_prompt("'general'", f"'{_question}'", "context", "sources")} FROM contexts)
    SELECT context, sources, user, max_tokens, greatest(1, (length(context) + length(user)) // 3)::INT AS tokens FROM shown""",
    "built_context": _bm25(QUESTIONS)
    + f""", {_contexts(f"SELECT r.query_id, r.rank, q.query, d.source AS file_path, 1 AS start_line, len({_lines('d.text')}) AS end_line, 'block' AS chunk_type, d.doc_id::VARCHAR AS name, d.lang AS language, d.text AS content FROM ranked r JOIN documents d USING (doc_id) JOIN q USING (query_id) WHERE r.rank < 5")}
    SELECT query_id, context, sources FROM contexts""",
    "relevant_lines": f"""WITH {_relevant("SELECT doc_id, text AS content, ['ledger', 'cache', 'retry'] AS toks FROM documents WHERE length(text) > 0", "rl")} SELECT doc_id, sha1(cut) AS sha1 FROM rl""",
    "prompts": f"WITH {_history} SELECT conv_id, turn, {_prompt('task', 'content', chr(39) + 'x = 1' + chr(39), '[role]')} FROM (SELECT *, CASE WHEN turn % 2 = 0 THEN 'review' ELSE 'other' END AS task FROM turns WHERE content IS NOT NULL)",
    "grep_windows": f"WITH {FILES}, {_grep(('retry', 'cache', 'TODO', 'ledger'))} SELECT file_path || ':' || (s + 1) || '-' || stop || ':grep' AS id, (s + 1)::INT AS start_line, stop::INT AS end_line, names AS name, sha1(array_to_string(l[s + 1 : stop], chr(10))) AS sha1 FROM win",
    "reranked": f"""WITH {CHUNKS}, {_rerank("SELECT ord AS o, file_path, name, content, (ord % 97) / 97.0::DOUBLE AS score FROM chunks_now", "how does retryLedger handle a cache", ("ledger", "cache"), 20)}
    SELECT c.id, b.score, b.rank FROM best b JOIN chunks_now c ON c.ord = b.o""",
    "scan_ignored": f"""WITH {FILES}, p AS (SELECT *, list_transform(range(1, len(string_split(relative_path, '/')) + 1), lambda i: array_to_string(string_split(relative_path, '/')[1:i], '/')) AS above FROM files_now)
    SELECT repo_id, relative_path FROM p WHERE {ENDING} IN {_known} AND {_size} <= 512000 AND NOT list_has_any({_folders}, {_skipped.format('')}) AND {NAME} NOT IN ('package-lock.json', 'yarn.lock', 'Pipfile.lock', 'poetry.lock', 'Cargo.lock', 'go.sum')
    AND len(list_filter(above, lambda x: CASE WHEN regexp_matches(x, '(^|/)minify(/|$)') THEN true WHEN x = 'apps' OR ends_with(x, '/apps') THEN true WHEN ends_with(x, '_branch.json') THEN false ELSE ends_with(x, '.json') END)) = 0""",
    "percentile_cut": """WITH best AS (SELECT event_type AS query_id, event_id AS doc_id, value AS score FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) <= 50),
    placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score) - 1 AS place, count(*) OVER (PARTITION BY query_id) AS n FROM best),
    edged AS (SELECT *, max(CASE WHEN place = greatest(0, n - floor(n * 0.8) - 1) THEN score END) OVER (PARTITION BY query_id) AS edge FROM placed),
    left_over AS (SELECT *, sum((score >= edge)::INT) OVER (PARTITION BY query_id) AS remain FROM edged)
    SELECT query_id, doc_id, score FROM left_over WHERE NOT (n > 10 AND remain >= 5) OR score >= edge""",
    "vector_topk": f"""SELECT q.vec_id AS query_id, d.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS score, {_sort_cosine} AS rank
    FROM embeddings q JOIN embeddings d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0 QUALIFY rank < 4""",
    "vector_filtered": f"""SELECT q.vec_id AS query_id, d.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS score, {_sort_cosine} AS rank
    FROM embeddings q JOIN embeddings d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0 AND q.label IN (1, 2) AND d.label IN (1, 2) QUALIFY rank < 3""",
    "cosine_pairs": "SELECT x.vec_id AS a, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS cosine FROM embeddings x JOIN embeddings y ON y.vec_id - 1 = x.vec_id",
    "scan_selected": f"WITH {FILES} SELECT repo_id, relative_path, {_language} AS file_language FROM files_now WHERE {ENDING} IN {_known} AND {_size} <= 512000 AND NOT list_has_any({_folders}, {_skipped.format('')}) AND {NAME} NOT IN ('package-lock.json', 'yarn.lock', 'Pipfile.lock', 'poetry.lock', 'Cargo.lock', 'go.sum')",
    "scan_frontend": f"WITH {FILES} SELECT repo_id, relative_path, {_language} AS file_language FROM files_now WHERE {ENDING} IN {_frontend} AND {_size} <= 4096 AND NOT list_has_any({_folders}, {_skipped.format(chr(44) + repr('test'))}) AND {NAME} <> 'package-lock.json'",
    "scan_changed": f"WITH {FILES} {_changed}",
    "scan_deleted": "SELECT DISTINCT repo_id, relative_path FROM file_state s WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.repo_id = s.repo_id AND f.relative_path = s.relative_path)",
    "scan_diff": f"""WITH {FILES}, before AS (SELECT repo_id, relative_path, list(content_hash) AS hashes FROM file_state GROUP BY ALL),
    kinds AS (SELECT coalesce(f.repo_id, b.repo_id) AS repo_id, CASE WHEN b.repo_id IS NULL THEN 'added' WHEN f.repo_id IS NULL THEN 'deleted' WHEN coalesce(list_contains(b.hashes, f.content_hash), false) THEN 'unchanged' ELSE 'changed' END AS kind
    FROM files_now f FULL JOIN before b ON f.repo_id = b.repo_id AND f.relative_path = b.relative_path)
    SELECT repo_id, sum((kind = 'added')::INT) AS added, sum((kind = 'changed')::INT) AS changed, sum((kind = 'unchanged')::INT) AS unchanged, sum((kind = 'deleted')::INT) AS deleted FROM kinds GROUP BY repo_id""",
    "content_hashes": f"WITH {FILES} SELECT repo_id, relative_path, sha1(content) AS sha1, sha1(content) IS NOT DISTINCT FROM content_hash AS agrees FROM files_now",
    "hash_snapshot": f"WITH {FILES} SELECT repo_id, relative_path, max(coalesce(content_hash, sha1(content))) AS content_hash FROM files_now WHERE coalesce(content_hash, sha1(content)) IS NOT NULL GROUP BY ALL",
    "repo_roots": f"""WITH {FILES}, r AS (SELECT repo_id, CASE WHEN ends_with(path, '/' || relative_path) THEN path[1:length(path) - length(relative_path) - 1] END AS root FROM files_now)
    SELECT repo_id, CASE WHEN min(root) = max(root) THEN min(root) END AS root FROM r GROUP BY repo_id""",
    "chunks_without_repo": f"WITH {CHUNKS} SELECT id FROM chunks_now WHERE repo_id IS DISTINCT FROM '7154cf61b6b9'",
    "named_chunks": f"""WITH {CHUNKS} SELECT id, sha1('### ' || file_path || ' (lines ' || start_line || '–' || end_line || ')' || CASE WHEN coalesce(name, '') <> '' THEN ' — ' || coalesce(chunk_type, 'block') || ': `' || name || '`' ELSE '' END
    || chr(10) || '```' || coalesce(language, '') || chr(10) || content || chr(10) || '```') AS sha1 FROM chunks_now""",
    "repo_ids": "SELECT repo_id, sha1(lower(root_path))[1:12] AS derived FROM repos",
    "chunk_ids": f"WITH {CHUNKS} SELECT id, CASE WHEN coalesce(repo_id, '') = '' THEN '' ELSE repo_id || ':' END || file_path || ':' || start_line || '-' || end_line AS derived FROM chunks_now",
    "folder_statistics": rf"WITH {FILES} SELECT repo_id, regexp_replace(relative_path, '/?[^/]*$', '') AS folder, CASE WHEN {ENDING} = '' THEN {NAME} ELSE {ENDING} END AS key, count(*) AS files, sum(coalesce(size_bytes, 0))::BIGINT AS bytes FROM files_now GROUP BY ALL",
    "folder_batches": rf"""WITH {FILES}, t AS (SELECT repo_id, regexp_replace(relative_path, '/?[^/]*$', '') AS folder, count(*) AS files FROM files_now WHERE {_planned} AND NOT regexp_matches(relative_path, '(^|/)\.[^/]*/') AND {ENDING} IN {_known} GROUP BY ALL),
    u AS (SELECT * FROM t UNION ALL SELECT DISTINCT repo_id, '', 0 FROM files_now WHERE repo_id NOT IN (SELECT repo_id FROM t))
    SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY string_split(folder, '/')) AS batch FROM u""",
    "line_windows": f"""WITH rows AS (SELECT doc_id, {_lines('text')} AS l FROM documents WHERE length(text) > 0),
    w AS (SELECT doc_id, l, unnest(range(0, len(l) - 2, 50)) AS s FROM rows WHERE len(l) >= 3)
    SELECT doc_id, (s + 1)::INT AS start_line, least(s + 60, len(l))::INT AS end_line, length(array_to_string(l[s + 1 : s + 60], chr(10)))::INT AS chars FROM w""",
    "window_chunks": f"""WITH {FILES}, rows AS (SELECT repo_id, relative_path, {_lines('content')} AS l FROM files_now WHERE length(content) > 0),
    w AS (SELECT *, unnest(range(0, len(l) - 2, 50)) AS s FROM rows WHERE len(l) >= 3)
    SELECT repo_id || ':' || relative_path || ':' || (s + 1) || '-' || least(s + 60, len(l)) AS id, (s + 1)::INT AS start_line, least(s + 60, len(l))::INT AS end_line, sha1(array_to_string(l[s + 1 : s + 60], chr(10))) AS sha1 FROM w""",
    "embedding_texts": f"""WITH {CHUNKS}, h AS (SELECT id, content, '# ' || coalesce(context_header, '') || chr(10) || '# ' || array_to_string(string_split(file_path, '/')[-3:], '/') || chr(10) AS head FROM chunks_now)
    SELECT id, sha1(head || content[1 : greatest(2048 - length(head), 0)]) AS sha1 FROM h""",
    "chunk_statistics": f"""WITH {CHUNKS}, s AS (SELECT language, list_sort(list(coalesce(length(content), 0))) AS l FROM chunks_now GROUP BY language)
    SELECT language, len(l) AS chunks, l[1]::INT AS least, l[floor(len(l) * 0.25)::INT + 1]::INT AS p25, l[floor(len(l) * 0.5)::INT + 1]::INT AS median, l[floor(len(l) * 0.95)::INT + 1]::INT AS p95, l[-1]::INT AS most FROM s""",
    "chunk_types": f"WITH {CHUNKS} SELECT chunk_type, count(*) AS chunks, sum((coalesce(name, '') <> '')::INT) AS named, round(100 * sum((coalesce(name, '') <> '')::INT) / count(*), 4) AS share FROM chunks_now GROUP BY chunk_type",
    "latest_chunks": f"WITH {CHUNKS} SELECT id, ord, indexed_at FROM chunks_now",
    "upserted_chunks": """WITH o AS (SELECT id, ord, language FROM chunks WHERE ord % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord DESC) = 1),
    n AS (SELECT id, ord, language FROM chunks WHERE ord % 3 = 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord DESC) = 1)
    SELECT * FROM n UNION ALL SELECT * FROM o WHERE id NOT IN (SELECT id FROM n)""",
    "chunks_without_deleted": f"WITH {FILES}, {CHUNKS}, gone AS ({_changed}) SELECT id FROM chunks_now c WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.repo_id = c.repo_id AND g.relative_path = c.file_path)",
    "chunks_to_embed": f"WITH {CHUNKS} SELECT id, ord FROM chunks_now WHERE ord % 2 <> 0",
    "chunk_lookup": f"WITH {CHUNKS} SELECT id, coalesce(file_path, '') AS file_path, coalesce(language, '') AS language, coalesce(start_line, 0) AS start_line, coalesce(end_line, 0) AS end_line, coalesce(chunk_type, 'block') AS chunk_type, coalesce(name, '') AS name FROM chunks_now WHERE language = 'go'",
    "repo_filtered": f"WITH {CHUNKS} SELECT repo_id, count(*) AS chunks FROM chunks_now WHERE language = 'python' GROUP BY repo_id",
    "filter_dictionary": f"WITH {CHUNKS} SELECT id, chunk_type FROM chunks_now WHERE language = 'java' AND chunk_type IN ('class_declaration', 'block')",
    "symbol_vocabulary": f"WITH {CHUNKS}, f AS (SELECT name, ord FROM chunks_now ORDER BY ord LIMIT 1500) SELECT name, min(ord) AS first_ord FROM f WHERE length(name) >= 5 AND NOT regexp_matches(name, '^\\d+$') GROUP BY name ORDER BY first_ord LIMIT 500",
    "grep_lines": f"""WITH {FILES}, r AS (SELECT repo_id || '/' || relative_path AS file_path, {_lines('content')} AS l FROM files_now WHERE content IS NOT NULL),
    x AS (SELECT file_path, unnest(l) AS line, generate_subscripts(l, 1) AS line_number FROM r),
    h AS (SELECT file_path, line_number::INT AS line_number, term, term_ord FROM x JOIN (VALUES (0, 'retry'), (1, 'cache'), (2, 'TODO'), (3, 'ledger')) t(term_ord, term) ON contains(lower(line), lower(term))
          QUALIFY row_number() OVER (PARTITION BY term_ord, file_path ORDER BY line_number) <= 15)
    SELECT file_path, line_number, arg_min(term, term_ord) AS term FROM h GROUP BY ALL""",
    "merged_spans": f"""WITH {CHUNKS}, r AS (SELECT file_path, start_line, id, (ord % 97) / 97.0::DOUBLE AS score, ord, ord % 3 = 0 AS g, ((start_line // 15) * 15)::INT AS bucket FROM chunks_now),
    a AS (SELECT file_path, bucket, max(score) FILTER (g) AS best, arg_max(struct_pack(id, start_line), struct_pack(s := score, o := -ord)) FILTER (g) AS lit, coalesce(sum(score) FILTER (NOT g), 0) AS total,
          arg_min(score, ord) FILTER (NOT g) AS first, arg_max(struct_pack(id, start_line), ord) FILTER (NOT g) AS sem FROM r GROUP BY ALL)
    SELECT file_path, bucket, coalesce(sem, lit).id AS id, coalesce(sem, lit).start_line AS start_line, round(CASE WHEN best IS NOT NULL THEN best + 0.5 * total ELSE first + 0.5 * (total - first) END
      + CASE WHEN contains(lower(file_path), 'vendor') THEN 0.3 ELSE 0 END + CASE WHEN contains(lower(file_path), 'core') THEN 0.3 ELSE 0 END, 6) AS score FROM a""",
    "diversified": f"WITH {CHUNKS} SELECT id, round((ord % 97) / 97.0::DOUBLE / (1 + 0.5::DOUBLE * (row_number() OVER (PARTITION BY file_path ORDER BY ord) - 1)), 9) AS score FROM chunks_now WHERE ord % 3 = 0",
    "packed_context": """WITH s AS (SELECT source AS query_id, doc_id AS rank, coalesce(text, '') AS content, greatest(1, length(coalesce(text, '')) // 3)::INT AS tokens FROM documents),
    c AS (SELECT *, sum(tokens) OVER w AS upto FROM s WINDOW w AS (PARTITION BY query_id ORDER BY rank)),
    o AS (SELECT *, sum((upto > 3396)::INT) OVER (PARTITION BY query_id ORDER BY rank) AS over_ FROM c)
    SELECT query_id, rank, tokens, (CASE WHEN over_ = 0 THEN length(content) ELSE (3396 - (upto - tokens)) * 3 + 37 END)::INT AS chars FROM o WHERE over_ = 0 OR over_ = 1 AND upto > 3396 AND 3396 - (upto - tokens) > 80""",
    "trimmed_history": f"""WITH {_history}, s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, sum(coalesce(length(content), 0)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS suffix FROM turns),
    f AS (SELECT *, min(CASE WHEN place % 2 = 0 AND suffix // 3 <= 380 THEN place END) OVER (PARTITION BY conv_id) AS first FROM s)
    SELECT conv_id, turn, role FROM f WHERE place >= first""",
    "last_turns": f"WITH {_history} SELECT conv_id, turn, content[1:200] AS content FROM turns QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3",
    "split_identifiers": f"WITH {CHUNKS} SELECT id, replace(regexp_replace(regexp_replace(name, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '_', ' ') AS words FROM chunks_now WHERE name IS NOT NULL",
    "tokenized": f"SELECT doc_id, len(t)::INT AS tokens, len(list_distinct(t))::INT AS terms FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents)",
    "rough_token_counts": "SELECT doc_id, greatest(1, length(text) // 3)::INT AS tokens FROM documents WHERE text IS NOT NULL",
    "json_properties": "SELECT (props->>'k')::INT AS k, count(*) AS events FROM events GROUP BY 1",
    "embedding_rate": """WITH e AS (SELECT event_type, row_number() OVER o AS nth, count(*) OVER s AS n, (epoch_us(ts) - first_value(epoch_us(ts)) OVER s) / 1e6 AS seconds FROM events
    WINDOW o AS (PARTITION BY event_type ORDER BY ts, event_id), s AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW))
    SELECT event_type, nth, round((n - 1) / nullif(seconds, 0), 9) AS rate FROM e WHERE nth % 20 = 0""",
    "folder_eta": """SELECT event_type AS run, event_id, round((count(*) OVER (PARTITION BY event_type) - row_number() OVER (PARTITION BY event_type ORDER BY event_id) + 1)
    * avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS eta FROM events WHERE value IS NOT NULL""",
    "area_plan": f"WITH {FILES}, {_areas} SELECT a.*, coalesce(m.files, 0)::BIGINT AS files, coalesce(m.bytes, 0) AS bytes FROM areas a LEFT JOIN met m USING (repo_id, area)",
    "repo_types": f"""WITH {FILES}, {_areas} SELECT repo_id, CASE WHEN count(DISTINCT profile) > 1 THEN 'mixed-monorepo' WHEN min(profile) = 'spring' THEN 'spring-backend' WHEN min(profile) = 'frontend' THEN 'frontend-ui' WHEN min(profile) = 'java-library' THEN 'java-framework' ELSE 'generic-codebase' END AS repo_type
    FROM areas GROUP BY repo_id""",
    "priced_lines": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order FROM lineitem GROUP BY ALL",
    "nation_orders": "SELECT n_name, o_orderstatus, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL",
}
