"""DuckDB SQL for the registered queries, written from the definitions and not from the plans.

Chunking, packing, stemming and scoring are stated here a second time, in SQL;
nothing is taken from the code under test.
"""

from __future__ import annotations

_WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
# Letters with marks and their plain forms; words that are not indexed; the constants of BM25.
_MARKED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿāăąćĉċčďđēĕėęěĝğġģĥĩīĭįĵķĺļľłńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
_PLAIN = "aaaaaaceeeeiiiinoooooouuuuyyaaaccccddeeeeegggghiiiijkllllnnnooorrrssssttuuuuuuwyzzz"
_STOP = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing down during "
    "each few for from further had has have having he her here hers him his how i if in into is it its just me more most my no nor not now of off on once only "
    "or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was "
    "we were what when where which while who whom why will with you your"
).split()
_K1, _B = 1.2, 0.75


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_WS}+', ''), '{_WS}+$', '')"


def _list(x: str) -> str:
    return f"CASE WHEN {_strip(x)} = '' THEN [] ELSE string_split_regex({_strip(x)}, '{_WS}+') END"


def _count(x: str) -> str:
    return f"CASE WHEN {_strip(x)} = '' THEN 0 ELSE len(string_split_regex({_strip(x)}, '{_WS}+')) END"


def _normal(x: str) -> str:
    return f"regexp_replace({_strip(f'lower({x})')}, '{_WS}+', ' ', 'g')"


# Splitting to a budget.


def _ladder(max_tokens: int, overlap: int, rungs: str = "par sen line") -> str:
    """CTEs from ``src`` (k, t) to ``pieces`` (k, piece from 0, text)."""
    holds = lambda us: f"len([u FOR u IN {us} IF ({_count('u')}) > {max_tokens}]) = 0"
    choice = " ".join(f"WHEN {holds(us)} THEN '{name}'" for name, us in (("par", "pu"), ("sen", "su")) if name in rungs)
    fresh = f"(ns[i + 1] > 0 AND (held = 0 OR held + ns[i + 1] > {max_tokens}))"
    return rf"""
split AS (
  SELECT k, t, {_count("t")} AS total, [u FOR u IN [{_strip("x")} FOR x IN string_split_regex(t, '\n{_WS}*\n')] IF u <> ''] AS pu,
    [u FOR u IN [{_strip("x")} FOR x IN string_split(regexp_replace(t, '([.!?]){_WS}+', '\1' || chr(1), 'g'), chr(1))] IF u <> ''] AS su FROM src
), chosen AS (
  SELECT *, CASE WHEN total <= {max_tokens} THEN 'whole' {choice} ELSE 'line' END AS rung FROM split
), lines AS (
  SELECT k, j, line, coalesce(starts_with(regexp_replace(line, '^{_WS}+', ''), '|'), false) AS tab FROM (
    SELECT k, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS j FROM chosen WHERE rung = 'line')
), runs AS (
  SELECT *, sum(CASE WHEN tab AND before THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY j) AS g FROM (SELECT *, coalesce(lag(tab) OVER (PARTITION BY k ORDER BY j), false) AS before FROM lines)
), units AS (
  SELECT *, {_count("u")} AS n, rung = 'line' AND NOT tab AND ({_count("u")}) > {max_tokens} AS wide FROM (
    SELECT k, rung, unnest(CASE rung WHEN 'par' THEN pu ELSE su END) AS u, generate_subscripts(CASE rung WHEN 'par' THEN pu ELSE su END, 1) AS i, false AS tab FROM chosen WHERE rung IN ('par', 'sen')
    UNION ALL SELECT k, 'line', string_agg(line, chr(10) ORDER BY j), CAST(g AS BIGINT), bool_or(tab) FROM runs GROUP BY k, g)
), sizes AS (
  SELECT k, list(n ORDER BY i) AS ns, list(wide ORDER BY i) AS ws, count(*) AS m FROM units GROUP BY k
), packed AS (
  SELECT k, CAST(1 AS BIGINT) AS i, CASE WHEN ns[1] > 0 THEN 1 ELSE 0 END AS piece, CAST(CASE WHEN ws[1] THEN 0 ELSE ns[1] END AS BIGINT) AS held FROM sizes
  UNION ALL
  SELECT k, i + 1, piece + CASE WHEN {fresh} THEN 1 ELSE 0 END, CASE WHEN ws[i + 1] THEN 0 WHEN {fresh} THEN ns[i + 1] ELSE held + ns[i + 1] END FROM packed JOIN sizes USING (k) WHERE i < m
), joined AS (
  SELECT k, piece, CASE WHEN bool_or(wide) THEN [array_to_string(ts[w * {max_tokens} + 1 : w * {max_tokens} + {max_tokens}], ' ') FOR w IN range(CAST(ceil(len(ts) / {max_tokens}.0) AS BIGINT))]
      WHEN any_value(rung) = 'line' THEN [{_strip("string_agg(u, chr(10) ORDER BY i)")}] ELSE [string_agg(u, ' ' ORDER BY i)] END AS texts
  FROM (SELECT *, CASE WHEN wide THEN {_list("u")} END AS own FROM packed JOIN units USING (k, i)) LEFT JOIN (SELECT k, piece, any_value(own) AS ts FROM (SELECT k, piece, CASE WHEN wide THEN {_list("u")} END AS own FROM packed JOIN units USING (k, i)) GROUP BY k, piece) USING (k, piece)
  WHERE piece > 0 GROUP BY k, piece, ts
), plain AS (
  SELECT k, row_number() OVER (PARTITION BY k ORDER BY piece, w) - 1 AS piece, text FROM (SELECT k, piece, unnest(texts) AS text, generate_subscripts(texts, 1) AS w FROM joined)
  UNION ALL SELECT k, 0, t FROM chosen WHERE rung = 'whole'
), pieces AS (
  SELECT k, CAST(piece AS INTEGER) AS piece, CASE WHEN piece = 0 OR {overlap} = 0 THEN text ELSE array_to_string(last[greatest(len(last) - {overlap}, 0) + 1 : len(last)], ' ') || ' ' || text END AS text
  FROM (SELECT *, {_list("lag(text) OVER (PARTITION BY k ORDER BY piece)")} AS last FROM plain)
)"""


def _markdown(min_tokens: int, max_tokens: int, overlap: int, rungs: str = "par sen line") -> str:
    """CTEs from ``md`` (d, t) to ``cut`` (d, chunk_order, path, text)."""
    nearest = ", ".join(f"last_value(CASE WHEN level <= {x} THEN {{'l': level, 't': title}} END IGNORE NULLS) OVER (PARTITION BY d ORDER BY s ROWS UNBOUNDED PRECEDING) AS h{x}" for x in range(1, 7))
    path = ", ".join(f"CASE WHEN h{x}.l = {x} THEN h{x}.t ELSE '' END" for x in range(1, 7))
    return rf"""
tagged AS (
  SELECT *, length(regexp_extract(line, '{_HEADING}', 1)) AS level, regexp_extract(line, '{_HEADING}', 2) AS title FROM (
    SELECT d, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM md)
), sections AS (
  SELECT *, count(*) FILTER (level > 0) OVER (PARTITION BY d ORDER BY i) AS s FROM tagged
), heads AS (
  SELECT d, s, ([{path}])[1 : level] AS path FROM (SELECT *, {nearest} FROM sections WHERE level > 0)
), bodies AS (
  SELECT d, s, {_strip("coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (level = 0), '')")} AS body FROM sections WHERE s > 0 GROUP BY d, s
), sized AS (
  SELECT *, ({_count("body")}) >= {min_tokens} AS big FROM bodies JOIN heads USING (d, s) WHERE body <> ''
), islands AS (
  SELECT *, coalesce(sum(big::INT) OVER (PARTITION BY d ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM sized
), merged AS (
  SELECT d, g, first(path ORDER BY s) AS path, string_agg(body, chr(10) || chr(10) ORDER BY s) AS text FROM islands GROUP BY d, g
), src AS (
  SELECT d || '/' || g AS k, text AS t FROM merged
), {_ladder(max_tokens, overlap, rungs)}, cut AS (
  SELECT d, CAST(row_number() OVER (PARTITION BY d ORDER BY g, piece) - 1 AS INTEGER) AS chunk_order, path, pieces.text FROM merged JOIN pieces ON k = d || '/' || g
)"""


_HEADING = rf"^(#{{1,6}}){_WS}+([^\n\r\x{{2028}}\x{{2029}}]+?){_WS}*$"


def _rules(text: str, heading: str) -> str:
    move = rf"regexp_matches({text}, '(?i)\*\*when{_WS}+([^*]+?)\*\*')"
    rows = rf"len(regexp_extract_all({text}, '(?m)^{_WS}*\|.*\|{_WS}*$')) >= 2"
    stats = rf"regexp_matches({text}, '(?i)\b(hp|hit points|armor|ac|attack)\b[^\n]*[0-9]')"
    return f"""CASE WHEN {move} THEN 'move'
      WHEN {rows} OR regexp_matches({heading}, 'tables?|oracle|random') THEN 'table'
      WHEN regexp_matches({heading}, 'bestiary|stat ?block|npcs?|monsters?') AND {stats} THEN 'stat_block'
      WHEN regexp_matches({heading}, 'running|gm ?(guide|advice)|how to run') THEN 'gm_guidance'
      WHEN regexp_matches({heading}, 'world|geography|history|cult|faction|lore') THEN 'lore' ELSE 'mechanic' END"""


# Conversations as markdown, down to classified chunks.
_CHUNKS = rf"""
md AS (
  SELECT 'conv-' || conv_id AS d, '# Conversation ' || conv_id || chr(10) || string_agg(part, chr(10) ORDER BY turn, role NULLS FIRST, part) AS t FROM (
    SELECT conv_id, turn, role, repeat('#', CAST(4 - turn % 3 AS BIGINT)) || ' ' || CASE turn % 6 WHEN 0 THEN 'Random tables' WHEN 1 THEN 'Bestiary' WHEN 2 THEN 'The World' WHEN 3 THEN 'Running the game' WHEN 4 THEN 'Moves' ELSE 'Talk' END
      || ' ' || turn || chr(10) || CASE turn % 6 WHEN 1 THEN 'HP 3' || chr(10) WHEN 4 THEN '**When you speak**, roll.' || chr(10) ELSE '' END || coalesce(text, '') AS part FROM conversations)
  GROUP BY conv_id
), {_markdown(40, 120, 10)}, typed AS (
  SELECT *, {_rules("text", "lower(array_to_string(path, ' / '))")} AS content_type FROM cut
), chunks AS (
  SELECT d AS doc_id, chunk_order, array_to_string(path, ' > ') AS headings, CAST({_count("text")} AS INTEGER) AS token_count, sha256({_normal("text")}) AS content_hash, sha256(text) AS text_sha256, content_type,
    CASE content_type WHEN 'move' THEN {_strip(rf"regexp_extract(text, '(?i)\*\*when{_WS}+([^*]+?)\*\*', 1)")} END AS move_trigger,
    CASE WHEN content_type = 'stat_block' AND {_strip("path[-1]")} <> '' THEN {_strip("path[-1]")} END AS npc_name
  FROM typed
)"""


def _embedding(text: str, dim: int) -> str:
    """Hash embedding before it is brought to length 1."""
    return f"[CAST(CAST('0x' || substr(sha256({text}), 2 * (i % 32) + 1, 2) AS INTEGER) / 255.0::DOUBLE * 2 - 1 AS FLOAT) FOR i IN range({dim})]"


_NORM = "sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN v]))"
_INGESTED = rf"""{_CHUNKS}, ready AS (
  SELECT *, array_to_string(path, ' > ') || chr(10) || chr(10) || text AS searched, sha256('corpus' || chr(1) || d || chr(1) || sha256({_normal("text")})) AS id FROM typed
), embedded AS (
  SELECT *, {_embedding("searched", 16)} AS v FROM ready
)"""

# Documents as text files of one line a page.
_PAGES = rf"""
pages AS (
  SELECT doc_id, CAST(i AS INTEGER) AS page_num, {_strip("page")} AS text FROM (
    SELECT doc_id, i, CASE WHEN (i - 1) % 3 = 1 THEN repeat('#', (i - 1) % 4 + 1) || ' Page' || chr(10) || line ELSE line END AS page FROM (
      SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents))
  WHERE {_strip("page")} <> ''
)"""

_DOT = "list_sum([p[1] * p[2] FOR p IN list_zip({0}, {1})])"
_COSINE = f"{_DOT.format('a', 'b')} / (sqrt({_DOT.format('a', 'a')}) * sqrt({_DOT.format('b', 'b')}))"


def _terms(text: str, stop: bool = False) -> str:
    words = f"string_split_regex(translate(lower({text}), '{_MARKED}', '{_PLAIN}'), '[^a-z]+')"
    out = f" AND NOT list_contains([{', '.join(repr(w) for w in _STOP)}], w)" if stop else ""
    return f"[w FOR w IN {words} IF w <> ''{out}]"


# Porter's stemmer, step by step; a measure is a pattern of consonants (c) and vowels (v).
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"


def _has(stem: str, kind: str) -> str:
    pattern = {"m>0": f"^({_C})?{_V}{_C}", "m=1": f"^({_C})?{_V}{_C}({_V})?$", "m>1": f"^({_C})?{_V}{_C}{_V}{_C}", "v": f"^({_C})?[aeiouy]", "cvc": f"^{_C}[aeiouy][^aeiouwxy]$"}[kind]
    return f"regexp_matches({stem}, '{pattern}')"


def _cut(n: int, w: str = "w") -> str:
    return f"substr({w}, 1, length({w}) - {n})"


def _suffixes(rules: dict[str, str], kind: str) -> str:
    """The longest suffix decides, even where its condition does not hold."""
    cases = " ".join(f"WHEN ends_with(w, '{s}') THEN CASE WHEN {_has(_cut(len(s)), kind)} THEN {_cut(len(s))} || '{r}' ELSE w END" for s, r in sorted(rules.items(), key=lambda x: -len(x[0])))
    return f"CASE {cases} ELSE w END"


# The suffixes of the published steps.
_STEP2 = dict(x.split(":") for x in "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble".split())
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = dict.fromkeys("al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split(), "")
_ION = f"WHEN ends_with(w, 'ion') THEN CASE WHEN {_has(_cut(3), 'm>1')} AND regexp_matches({_cut(3)}, '[st]$') THEN {_cut(3)} ELSE w END"


def _porter(words: str) -> str:
    """CTEs from a table of words (word) to ``stemmed`` (word, stem); words of one or two letters stay."""
    grown = f"""CASE WHEN regexp_matches(w, '(at|bl|iz)$') THEN w || 'e' WHEN regexp_matches(w, '[^aeiou]$') AND substr(w, -1) = substr(w, -2, 1) AND NOT regexp_matches(w, '[lsz]$') AND NOT (ends_with(w, 'yy')) THEN {_cut(1)}
      WHEN {_has("w", "m=1")} AND {_has("w", "cvc")} THEN w || 'e' ELSE w END"""
    steps = [
        f"CASE WHEN regexp_matches(w, '(sses|ies)$') THEN {_cut(2)} WHEN regexp_matches(w, '[^s]s$') OR w = 's' THEN {_cut(1)} ELSE w END",
        None,
        f"CASE WHEN ends_with(w, 'y') AND {_has(_cut(1), 'v')} THEN {_cut(1)} || 'i' ELSE w END",
        _suffixes(_STEP2, "m>0"),
        _suffixes(_STEP3, "m>0"),
        _suffixes(_STEP4, "m>1").replace("CASE ", f"CASE {_ION} ", 1),
        f"CASE WHEN ends_with(w, 'e') AND ({_has(_cut(1), 'm>1')} OR ({_has(_cut(1), 'm=1')} AND NOT {_has(_cut(1), 'cvc')})) THEN {_cut(1)} ELSE w END",
        f"CASE WHEN ends_with(w, 'll') AND {_has('w', 'm>1')} THEN {_cut(1)} ELSE w END",
    ]
    # A leading y is a consonant; as a capital no pattern takes it for a vowel.
    out = [f"p0 AS (SELECT word, regexp_replace(word, '^y', 'Y') AS w FROM ({words}) WHERE length(word) > 2)"]
    for n, step in enumerate(steps, 1):
        if step is None:
            removed = f"CASE WHEN ends_with(w, 'eed') THEN NULL WHEN ends_with(w, 'ed') AND {_has(_cut(2), 'v')} THEN {_cut(2)} WHEN ends_with(w, 'ing') AND {_has(_cut(3), 'v')} THEN {_cut(3)} END"
            eed = f"CASE WHEN ends_with(w, 'eed') AND {_has(_cut(3), 'm>0')} THEN {_cut(1)} ELSE w END"
            out.append(f"p{n} AS (SELECT word, CASE WHEN r IS NULL THEN {eed} ELSE (SELECT {grown} FROM (SELECT r AS w)) END AS w FROM (SELECT word, w, {removed} AS r FROM p{n - 1}))")
        else:
            out.append(f"p{n} AS (SELECT word, {step} AS w FROM p{n - 1})")
    return ", ".join(out) + f", stemmed AS (SELECT word, lower(w) AS stem FROM p{len(steps)} UNION ALL SELECT word, word FROM ({words}) WHERE length(word) <= 2)"


def _bm25(documents: str, queries: str, keep: str) -> str:
    """BM25 of ``documents`` (id, ws) for ``queries`` (q, w), both CTEs given; ``keep`` says what is returned of (q, id, score)."""
    return f"""{documents}, {queries}, st AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM d), tf AS (SELECT id, w, any_value(len) AS len, count(*) AS tf FROM (SELECT id, len(ws) AS len, unnest(ws) AS w FROM d) GROUP BY id, w),
      df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
      scored AS (SELECT q, id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * ({_K1} + 1) / (tf + {_K1} * (1 - {_B} + {_B} * len / avgdl))), 9) AS score FROM tf JOIN q USING (w) JOIN df USING (w), st GROUP BY q, id)
      {keep}"""


_RANKED = "SELECT q AS item_id, id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS INTEGER) AS rank FROM scored QUALIFY rank <= 10"
_ITEMS = "SELECT DISTINCT item_id AS q, unnest({0}) AS w FROM benchmark WHERE item_id % 20 = 0"
# Documents as stored chunks: of a source's equal texts the first stays.
_STORED = f"""kept AS (SELECT coalesce(text, '') AS text, doc_id AS n, source AS doc_id, lang FROM documents
  QUALIFY row_number() OVER (PARTITION BY source, {_normal("coalesce(text, '')")} ORDER BY doc_id, CAST(doc_id AS VARCHAR)) = 1)"""

SQL: dict[str, str] = {
    "conversation_chunks": f"WITH RECURSIVE {_CHUNKS} SELECT * FROM chunks",
    "content_type_counts": f"""WITH RECURSIVE {_CHUNKS}, firsts AS (SELECT *, row_number() OVER (PARTITION BY doc_id, content_hash ORDER BY chunk_order) AS n FROM chunks)
      SELECT content_type, count(*) AS chunks, CAST(sum(token_count) AS BIGINT) AS tokens FROM firsts WHERE n = 1 GROUP BY content_type""",
    "token_counts": f"SELECT doc_id, CAST({_count('text')} AS INTEGER) AS tokens FROM documents",
    "normalized_hashes": f"SELECT doc_id, sha256({_normal('text')}) AS content_hash, CAST(length({_normal('text')}) AS INTEGER) AS n FROM documents",
    "token_lists": f"WITH t AS (SELECT doc_id, unnest({_list('text')}) AS word FROM documents) SELECT doc_id, count(DISTINCT word) AS distinct_words, max(word) AS last_word FROM t GROUP BY doc_id",
    "sentence_pieces": rf"""WITH RECURSIVE t AS (
        SELECT doc_id, [u FOR u IN [{_strip("x")} FOR x IN string_split(regexp_replace(text, '([.!?]){_WS}+', '\1' || chr(1), 'g'), chr(1))] IF u <> ''] AS us FROM documents
      ), c AS (SELECT doc_id, us, [{_count("u")} FOR u IN us] AS ns, len(us) AS n FROM t), r AS (
        SELECT doc_id, CAST(1 AS BIGINT) AS i, CAST(ns[1] AS BIGINT) AS held, CAST(0 AS BIGINT) AS piece FROM c WHERE n > 0
        UNION ALL
        SELECT r.doc_id, i + 1, CASE WHEN held + ns[i + 1] > 60 THEN ns[i + 1] ELSE held + ns[i + 1] END, piece + CASE WHEN held + ns[i + 1] > 60 THEN 1 ELSE 0 END FROM r JOIN c USING (doc_id) WHERE i < n
      ) SELECT doc_id, CAST(piece AS INTEGER) AS piece, sha256(string_agg(us[i], ' ' ORDER BY i)) AS text_sha256 FROM r JOIN c USING (doc_id) GROUP BY doc_id, piece""",
    "token_windows": f"WITH RECURSIVE src AS (SELECT doc_id AS k, translate(text, chr(10) || '|', '  ') AS t FROM documents WHERE text IS NOT NULL), {_ladder(50, 5, 'line')} SELECT k AS doc_id, piece, sha256(text) AS text_sha256 FROM pieces",
    "budget_pieces": f"""WITH RECURSIVE src AS (SELECT doc_id AS k, replace(text, chr(10), chr(10) || chr(10)) || replace('~| a | b |~|---|---|~| 1 | 2 |', '~', chr(10)) AS t FROM documents WHERE text IS NOT NULL), {_ladder(80, 10)}
      SELECT k AS doc_id, piece, CAST({_count('text')} AS INTEGER) AS tokens, sha256(text) AS text_sha256 FROM pieces""",
    "page_markers": f"""WITH m AS (SELECT doc_id, text, '<!-- page ' || doc_id || ' -->' || chr(10) || text AS marked FROM documents)
      SELECT doc_id, regexp_extract(marked, '<!-- page ([0-9]+) -->', 1) AS page, CAST(length(marked) AS INTEGER) AS n_marked, {_strip(f"regexp_replace(marked, '<!-- page [0-9]+ -->{chr(92)}n?', '', 'g')")} = {_strip('text')} AS same FROM m""",
    "form_feed_pages": f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents)
      SELECT doc_id, count(*) AS pages, CAST(max(k) AS INTEGER) AS last_page, CAST(sum(length({_strip('line')})) AS BIGINT) AS chars FROM l WHERE {_strip('line')} <> '' GROUP BY doc_id""",
    "paged_chunks": rf"""WITH RECURSIVE {_PAGES}, md AS (
        SELECT CAST(doc_id AS VARCHAR) AS d, string_agg(CASE WHEN starts_with(text, '#') THEN regexp_replace(text, '^[^\n]*', '\0' || chr(10) || mark) ELSE mark || chr(10) || text END, chr(10) || chr(10) ORDER BY page_num) AS t
        FROM (SELECT *, '<!-- page ' || page_num || ' -->' AS mark FROM pages) GROUP BY doc_id
      ), {_markdown(25, 70, 5, "sen line")}
      SELECT d AS path, chunk_order, array_to_string(path, '>') AS headings, coalesce(regexp_extract_all(text, '<!-- page ([0-9]+) -->', 1)[-1], '') AS page, sha256({_strip(r"regexp_replace(text, '<!-- page [0-9]+ -->\n?', '', 'g')")}) AS text_sha256 FROM cut""",
    "cached_pages": f"WITH {_PAGES} SELECT CAST(doc_id AS VARCHAR) AS path, page_num, sha256(text) AS text_sha256 FROM pages",
    "single_page": f"WITH {_PAGES} SELECT CAST(doc_id AS VARCHAR) AS path, page_num, CAST(length(text) AS INTEGER) AS n FROM pages WHERE page_num = 2",
    "given_pages": "SELECT page_num, text, n FROM (VALUES (1, '# First'), (2, 'second')) p(page_num, text), (SELECT count(*) AS n FROM documents) WHERE n > 0",
    "text_files": "SELECT CAST(sum(length(coalesce(text, '')) + 1) AS BIGINT) AS chars, CAST(sum(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1) AS BIGINT) AS lines, true AS own_paths FROM documents",
    "heading_rules": f"""WITH h AS (SELECT CASE doc_id % 7 WHEN 0 THEN text || chr(10) || ' | a | b |' || chr(10) || '|c|' WHEN 1 THEN text || chr(10) || '| a | b |' ELSE text END AS text,
        CASE WHEN doc_id % 3 = 0 THEN 'random ' || source || ' / ' ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN 'world' ELSE 'npcs' END AS h FROM documents),
      k AS (SELECT {_rules('text', 'h')} AS content_type FROM h) SELECT content_type, count(*) AS n, count(*) FILTER (content_type = 'stat_block') AS named FROM k GROUP BY content_type""",
    "constant_types": "SELECT 'lore' AS content_type, 'x' AS tags, count(*) AS n FROM documents HAVING count(*) > 0",
    "model_types": """WITH k AS (SELECT doc_id, right(source, 1) AS r FROM documents) SELECT doc_id, CASE WHEN r IN ('1', '3') THEN 'mechanic' ELSE 'lore' END AS content_type,
      CASE r WHEN '1' THEN '' WHEN '3' THEN 'song,7' ELSE 'lore,7' END AS tags, CAST(NULL AS VARCHAR) AS npc_name, CASE r WHEN '3' THEN '[x]' END AS scene_type FROM k""",
    "cost_forecast": "SELECT count(*) AS n_chunks, count(*) AS input_tokens, 50 * count(*) AS output_tokens, round((3.0 * count(*) + 15.0 * 50 * count(*)) / 1e6, 6)::DOUBLE AS cost FROM documents",
    "service_embeddings": "SELECT doc_id, length(coalesce(text, ''))::DOUBLE AS v0, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'e', '')))::DOUBLE AS v1, -1::DOUBLE AS v2 FROM documents",
    "hash_embeddings": f"""WITH f AS (SELECT doc_id, {_embedding('text', 16)} AS v FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, v, {_NORM} AS norm FROM f),
      c AS (SELECT doc_id, norm, unnest(v) AS x, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS i FROM n) SELECT doc_id, i, round(CAST(CAST(CASE WHEN norm = 0 THEN x ELSE x::DOUBLE / norm END AS FLOAT) AS DOUBLE), 5) AS x FROM c""",
    "cosine_top_k": f"""WITH v AS (SELECT c.vec_id, q.embedding::DOUBLE[] AS a, c.embedding::DOUBLE[] AS b FROM embeddings c, embeddings q WHERE q.vec_id = 0), s AS (SELECT vec_id, {_COSINE} AS score FROM v)
      SELECT vec_id, round(score, 5) AS score, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10""",
    "cosine_join": f"""WITH v AS (SELECT q.vec_id AS query_id, c.vec_id, q.embedding::DOUBLE[] AS a, c.embedding::DOUBLE[] AS b FROM embeddings c, embeddings q WHERE q.vec_id % 20 = 0), s AS (SELECT query_id, vec_id, {_COSINE} AS score FROM v)
      SELECT query_id, vec_id, round(score, 5) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 5""",
    "filtered_rows": "SELECT count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE lang = 'en' AND source = 'src0'",
    "bm25": f"WITH {_bm25(f'd AS (SELECT CAST(doc_id AS VARCHAR) AS id, {_terms("text")} AS ws FROM documents)', f'q AS ({_ITEMS.format(_terms("text"))})', _RANKED)}",
    "bm25_stemmed": f"""WITH words AS (SELECT DISTINCT unnest({_terms("text")}) AS word FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark)), {_porter("SELECT word FROM words")}, {_bm25(
        f"e AS (SELECT doc_id, unnest({_terms('text', True)}) AS word FROM documents), d AS (SELECT CAST(doc_id AS VARCHAR) AS id, coalesce(ws, []) AS ws FROM documents LEFT JOIN (SELECT doc_id, list(stem) AS ws FROM e JOIN stemmed USING (word) GROUP BY doc_id) USING (doc_id))",
        f"q AS (SELECT DISTINCT q, stem AS w FROM ({_ITEMS.format(_terms('text', True))}) i JOIN stemmed ON i.w = word)", _RANKED)}""",
    "index_statistics": f"""WITH d AS (SELECT source AS source_id, doc_id, {_terms("text")} AS ws FROM documents), st AS (SELECT source_id, count(*) AS n_docs, avg(len(ws)) AS avgdl FROM d GROUP BY source_id),
      w AS (SELECT source_id, w, count(DISTINCT doc_id) AS df FROM (SELECT source_id, doc_id, unnest(ws) AS w FROM d) GROUP BY source_id, w), k AS (SELECT source_id, count(*) AS terms, max(df) AS most FROM w GROUP BY source_id)
      SELECT source_id, n_docs, round(avgdl, 6) AS avgdl, terms, most FROM st JOIN k USING (source_id)""",
    "stems": f"WITH words AS (SELECT DISTINCT unnest({_terms('text', True)}) AS word FROM documents), {_porter('SELECT word FROM words')} SELECT word, stem FROM stemmed",
    "dedup_insert": f"WITH {_STORED} SELECT doc_id, count(*) AS kept, CAST(min(n) AS INTEGER) AS first_doc, count(*) AS ids, (SELECT count(*) FROM kept) AS inserted FROM kept GROUP BY doc_id",
    "known_rows": f"""WITH t AS (SELECT source, doc_id % 2 AS odd, {_normal("coalesce(text, '')")} AS h FROM documents), e AS (SELECT DISTINCT source, h FROM t WHERE odd = 0),
      o AS (SELECT DISTINCT source, h FROM t WHERE odd = 1 EXCEPT SELECT source, h FROM e) SELECT source AS doc_id, count(*) AS fresh, (SELECT count(*) FROM e) AS insert_1, (SELECT count(*) FROM o) AS insert_2, 0::BIGINT AS insert_3 FROM o GROUP BY source""",
    "meta_upsert": """SELECT 'docs' AS source_id, coalesce(lang, '-') AS key, CAST(max(doc_id) AS VARCHAR) AS value FROM documents GROUP BY 2
      UNION ALL SELECT 'docs', key, value FROM (VALUES ('source_id', 'docs'), ('embedding_model', 'hash-4'), ('embedding_dim', '4'), ('system', 'generic')) v(key, value)""",
    "model_audit": f"WITH {_STORED} SELECT 'model-' || coalesce(lang, '-') AS embedding_model, count(*) AS n, (SELECT count(*) FROM kept) AS chunk_count FROM kept GROUP BY 1",
    "delete_document": """WITH g AS (SELECT source, min(doc_id) FILTER (doc_id % 2 = 0) AS a, min(doc_id) AS b FROM (SELECT source, doc_id, coalesce(text, '') AS text FROM documents WHERE source IS DISTINCT FROM 'src0') GROUP BY source, NORMAL),
      k AS (SELECT source, coalesce(a, b) AS n FROM g) SELECT source AS doc_id, count(*) AS n, CAST(sum(n) AS BIGINT) AS orders, (SELECT count(*) FROM k) AS chunk_count FROM k GROUP BY source""".replace("NORMAL", _normal("text")),
    "stored_bm25": f"""WITH kept AS (SELECT coalesce(text, '') AS text, doc_id, lang FROM documents WHERE source <> 'src0' QUALIFY row_number() OVER (PARTITION BY source, {_normal("coalesce(text, '')")} ORDER BY doc_id % 2, doc_id) = 1),
      {_bm25(f'd AS (SELECT CAST(doc_id AS VARCHAR) AS id, {_terms("text")} AS ws FROM kept)', f'q AS (SELECT DISTINCT 0 AS q, unnest({_terms("text")}) AS w FROM (SELECT text FROM benchmark WHERE text IS NOT NULL ORDER BY item_id LIMIT 1))',
             "SELECT id, round(score, 6) AS score FROM scored JOIN kept ON id = CAST(doc_id AS VARCHAR) WHERE lang = 'en' ORDER BY scored.score DESC, id LIMIT 10")}""",
    "stored_nearest": f"""WITH {_STORED}, e AS (SELECT n, {_embedding('text', 4)} AS v FROM kept WHERE doc_id = 'src1'), u AS (SELECT n, [CAST(CAST(x::DOUBLE / {_NORM} AS FLOAT) AS DOUBLE) FOR x IN v] AS a, [0.6, -0.4, 0.5, 0.3]::DOUBLE[] AS b FROM e), s AS (SELECT CAST(n AS VARCHAR) AS id, {_COSINE} AS score FROM u)
      SELECT id, round(score, 5) AS score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10""",
    "search_texts": "SELECT doc_id, sha256(CASE WHEN doc_id % 2 = 0 THEN source || ' >  > ' || lang || chr(10) || chr(10) || text ELSE text END) AS search_sha256 FROM documents",
    "ingest_plan": f"""WITH RECURSIVE {_INGESTED} SELECT id, 'corpus' AS source_id, d AS doc_id, 'conversations' AS doc_path, chunk_order, CAST({_count("text")} AS INTEGER) AS token_count, content_type, sha256({_normal("text")}) AS content_hash, 'generic' AS system, 'homebrew' AS license,
      'core_rules' AS document_type, 'hash-16' AS embedding_model, sha256(searched) AS text_sha256, round(CAST(CAST(v[1]::DOUBLE / {_NORM} AS FLOAT) AS DOUBLE), 5) AS v0 FROM embedded""",
    "ingest_store": f"""WITH RECURSIVE {_CHUNKS}, firsts AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY doc_id, content_hash ORDER BY chunk_order) = 1)
      SELECT content_type, count(*) AS chunks, CAST(sum(token_count) AS BIGINT) AS tokens, (SELECT count(*) FROM firsts) AS ingest_1, 0::BIGINT AS ingest_2 FROM firsts GROUP BY content_type""",
    "flat_rows": f"""WITH RECURSIVE {_CHUNKS} SELECT d AS doc_id, chunk_order, CAST(to_json(path) AS VARCHAR) AS heading_path, CASE WHEN chunk_order % 2 = 0 THEN 'a,null,3' ELSE '' END AS tags, '' AS page, '' AS edition, CAST(NULL AS VARCHAR) AS parent_id, 16 AS dim FROM typed""",
}
