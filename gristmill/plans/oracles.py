"""DuckDB SQL for the engine's queries, and the inline rows that some of them share."""

from __future__ import annotations

import hashlib
import re

from ..functions.fixed import CJK, DATE_QUESTION, DATE_WORDS, MATH_TRIM, MATH_WORDS, THESAURUS, UNIT_QUESTION, UNIT_WORDS

MIXED_TEXTS = [
    "混合检索 Hybrid Retrieval",
    "猫",
    "",
    "第 2 章 v1.0.0 C++ #tag 线程数thread",
    "a; b!\n\nhello world!! ok",
    "rain ☂ and sun ☀\nrocket \U0001f680",
]
_MIXED_TOKENS = ["混合|合检|检索|hybrid|retrieval", "猫", "", "第|章|线程|程数|2|v1.0.0|c++|#tag|thread", "a|b|hello|world|ok", "rain|and|sun|rocket"]

EXPANSION_QUESTIONS = ["线程数应该固定在多少", "thread 线程", "nothing here", "检索 重排 融合 排名 语料 文档"]
_EXPANDED = [
    (["thread count", "threads", "n_threads", "thread"], ["线程数", "线程"]),
    (["threads"], ["线程"]),
    ([], []),
    (
        ["retrieval", "retriever", "search", "fusion", "fuse", "rrf", "reciprocal rank fusion", "rank", "ranking", "rerank", "reranker", "reranking"],
        ["检索", "融合", "排名", "重排"],
    ),
]

#: (question, kind, payload)
ROUTED = [
    ("12*(3+4)+18/3", "arithmetic", "12*(3+4)+18/3"),
    ("计算 12*(3+4)+18/3 等于多少？", "arithmetic", "12*(3+4)+18/3"),
    ("(128+64)/8-100", "arithmetic", "(128+64)/8-100"),
    ("2^10", "arithmetic", "2^10"),
    ("calculate 3 * (4 + 5)", "arithmetic", "3 * (4 + 5)"),
    ("99*101 =?", "arithmetic", "99*101"),
    ("2024 年的营收是多少", "retrieve", ""),
    ("报告中提到了 3 个主要风险，分别是什么", "retrieve", ""),
    ("第 2 章的结论是什么", "retrieve", ""),
    ("(1+2))", "retrieve", ""),
    ("5 kg to kg", "retrieve", ""),
    ("1500 m to km 换算成多少？", "unit", "1500 m km"),
    ("2026-01-01 到 2026-09-24 相差多少天？", "date", "2026-01-01 2026-09-24"),
    ("2026-01-01 和 2026-09-24", "retrieve", ""),
]

#: (text, tool, payload, final)
RAW_OUTPUTS = [
    ("Thought: more\nAction: search[what is it]", "search", "what is it", None),
    ("Final Answer: yes\n\n  and more ", None, None, "yes\nand more"),
    ("action: calculator[1+[2]]", "calculator", "1+[2]", None),
    ("just a line", None, None, "just a line"),
    ("two\nlines", None, None, None),
    ("Thought: hm", None, None, None),
]


#: name: k1, b, and the smoothing of the fusion
SETTINGS = {"usual": (1.5, 0.75, 60), "flat": (1.2, 0.3, 60), "long": (2.0, 0.95, 20), "sharp": (0.9, 0.4, 5)}
#: (tool, payload, ok, value, error)
TOOL_CALLS = [
    ("calculator", "12*(3+4)+18/3", True, "90", ""),
    ("calculator", "1/0", False, "", "division by zero"),
    ("unit_convert", "1500 m km", True, "1.5 km", ""),
    ("unit_convert", "0 C F", True, "32 f", ""),
    ("unit_convert", "5 kg m", False, "", "no conversion from kg to m"),
    ("date_diff", "2026-01-01 2026-09-24", True, "266 天", ""),
    ("date_diff", "2026-01-01", False, "", "expected '<date-a> <date-b>'"),
    ("no_such", "x", False, "", "unknown tool: no_such"),
]
REMEMBERED = ["the user likes green tea", "green tea is best in the morning", "meetings are on monday morning", "检索 融合 检索", "融合 tea tea tea"]


def _hashes(slots: int | None) -> str:
    """(term, h, slot) of the tokens of the inline texts: the hash is none that SQL has."""
    words = {w for t in REMEMBERED for w in re.findall(r"[a-z]+", t)} | {"检索", "融合"} | {w for row in _MIXED_TOKENS for w in row.split("|") if w}
    rows = []
    for w in sorted(words):
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
        rows.append((w, h % 256 if slots else (h >> 1) % 512, 1 if slots else (1 if h >> 1 & 1 << 20 else -1)))
    return _values(rows, "term, slot, sign")


def _remembered(more: bool) -> str:
    """(id, term, tf) of the inline texts; CJK there comes in words of two characters."""
    rows = [(i, w) for i, t in enumerate(REMEMBERED) for w in t.split()]
    if more:
        rows += [(len(REMEMBERED) + i, w) for i, row in enumerate(_MIXED_TOKENS) for w in row.split("|") if w]
    return f"SELECT id, term, count(*) AS tf FROM ({_values(rows, 'id, term')}) GROUP BY ALL"


def _text(value: str | None) -> str:
    if value is None:
        return "CAST(NULL AS VARCHAR)"
    return "concat(" + ", chr(10), ".join("'" + v.replace("'", "''") + "'" for v in value.split("\n")) + ")"


def _values(rows: list[tuple], names: str) -> str:
    lines = ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else f"{v}::DOUBLE" if isinstance(v, float) else _text(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {lines}) AS t({names})"


def _tokens(column: str) -> str:
    return f"regexp_extract_all(lower({column}), '[\\p{{L}}\\p{{N}}_\\-+#.]+')"


_STRIP = "regexp_replace({0}, '^[\\s\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+|[\\s\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+$', '', 'g')"
_FLAT = "trim(regexp_replace({0}, '[\\s\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', ' ', 'g'), ' ')"


def _pieces(column: str) -> str:
    """Sentence pieces before short ones are joined."""
    cut = f"regexp_extract_all({_STRIP.format(column)}, '[^。！？!?;\\n]*[。！？!?;\\n]|[^。！？!?;\\n]+')"
    return f"list_filter(list_transform({cut}, lambda p: {_STRIP.format('p')}), lambda p: p <> '')"


def _sentences(column: str) -> str:
    """Short pieces joined to the one before: a mark goes before every piece that begins a sentence."""
    pieces = _pieces(column)
    return (
        f"list_filter(string_split(array_to_string(list_transform({pieces}, "
        "lambda p, i: CASE WHEN i > 1 AND length(p) < 4 THEN p ELSE chr(31) || p END), ''), chr(31)), lambda p: p <> '')"
    )


_STOP = (
    "['the','a','an','of','is','are','was','were','to','and','or','in','on','for','that','this','it','as','with','by','be','at','from',"
    "'which','but','not','have','has','had','will','would','can','could']"
)


def _content(column: str) -> str:
    return f"list_filter({_tokens(column)}, lambda t: NOT list_contains({_STOP}, t))"


_CHUNKS = f"c AS (SELECT CAST(doc_id AS VARCHAR) || '#0' AS chunk_id, text, {_tokens('text')} AS t FROM documents)"
_QUESTIONS = f"q AS (SELECT CAST(item_id AS VARCHAR) AS query_id, text, {_tokens('text')} AS t FROM benchmark)"
_BM25 = f"""{_CHUNKS}, {_QUESTIONS},
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(t) AS term FROM q) GROUP BY ALL),
p AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, greatest(1, len(t)) AS dl, unnest(t) AS term FROM c)
      WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(greatest(1, len(t))) AS avgdl FROM c),
idf AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, st GROUP BY term, n),
scored AS (SELECT query_id, chunk_id, round(round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 12), 6) AS score
           FROM p JOIN idf USING (term) JOIN qt USING (term), st GROUP BY ALL),
bm AS (SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank
       FROM scored WHERE score > 0 QUALIFY rank <= 6)"""
_OVERLAP = """qn AS (SELECT query_id, count(*) AS n FROM qt GROUP BY ALL),
ov AS (SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank
       FROM (SELECT query_id, chunk_id, round(count(*) / any_value(qn.n), 6) AS score FROM p JOIN qt USING (term) JOIN qn USING (query_id) GROUP BY ALL)
       QUALIFY rank <= 6)"""


def _fused(dense: float = 1.0, sparse: float = 1.0) -> str:
    return f"""lists AS (SELECT query_id, chunk_id, rank, 'dense' AS source, {dense}::DOUBLE AS w, 0 AS l FROM ov
  UNION ALL SELECT query_id, chunk_id, rank, 'sparse', {sparse}::DOUBLE, 1 FROM bm),
f0 AS (SELECT query_id, chunk_id, round(sum(w / (60 + rank)), 12) AS score, min(l * 100000 + rank) AS seen,
       string_agg(source || ':' || rank, ',' ORDER BY source) AS ranks, string_agg(source, ',' ORDER BY source) AS sources FROM lists GROUP BY ALL),
f AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, chunk_id) AS INT) AS pos FROM f0 QUALIFY pos <= 12)"""


_LEXICAL = """cand AS (SELECT query_id, pos, c.t, greatest(1, len(c.t)) AS dl, count(*) OVER (PARTITION BY query_id) AS n FROM f JOIN c USING (chunk_id)),
ct AS (SELECT query_id, pos, n, dl, term, count(*) AS tf FROM (SELECT query_id, pos, n, dl, unnest(t) AS term FROM cand) JOIN qt USING (query_id, term) GROUP BY ALL),
cd AS (SELECT *, count(*) OVER (PARTITION BY query_id, term) AS df FROM ct),
cs AS (SELECT query_id, pos, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (1 + ln(tf)) / sqrt(dl)) AS s FROM cd GROUP BY ALL),
lx AS (SELECT query_id, pos, round(round(coalesce(s, 0), 12), 6) AS rerank_score,
       row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(s, 0), 12) DESC, pos) AS r FROM cand LEFT JOIN cs USING (query_id, pos) QUALIFY r <= 10)"""
_GUARD = """g0 AS (SELECT f.query_id, f.chunk_id, f.pos, f.score, coalesce(lx.rerank_score, 0) AS s FROM f LEFT JOIN lx USING (query_id, pos)),
g1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS ra, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, pos) AS rb FROM g0),
sp AS (SELECT query_id, count(*) AS n, CASE WHEN count(*) < 2 OR min(score) = max(score) OR min(s) = max(s) THEN 0 ELSE corr(ra, rb) END AS rho FROM g1 GROUP BY ALL)"""
_APPROX = "(len(regexp_extract_all({0}, '[\\x{{3400}}-\\x{{9FFF}}]')) + (length({0}) - len(regexp_extract_all({0}, '[\\x{{3400}}-\\x{{9FFF}}]'))) // 4 + 1)"
#: After each step a conversation either has one more turn, or has put its two oldest ones into the summary.
_COMPACT = f"""RECURSIVE cv AS (SELECT conv_id, list(coalesce(text, '') ORDER BY turn) AS t, list(role ORDER BY turn) AS r, list(turn ORDER BY turn) AS places, count(*) AS n FROM conversations GROUP BY conv_id),
ca AS (SELECT *, list_transform(t, lambda x: {_APPROX.format('x')}) AS a FROM cv),
cs_ AS (SELECT conv_id, 0::BIGINT AS i, 0::BIGINT AS ev, 0::BIGINT AS held, '' AS summary FROM ca
  UNION ALL
  SELECT conv_id, CASE WHEN o THEN i ELSE i + 1 END, CASE WHEN o THEN least(ev + 2, i) ELSE ev END,
         CASE WHEN o THEN held - list_sum(a[ev + 1:least(ev + 2, i)])::BIGINT ELSE held + a[i + 1] END,
         CASE WHEN o THEN {_STRIP.format("right(summary || ' ' || array_to_string(t[ev + 1:least(ev + 2, i)], ' '), 64)")} ELSE summary END
  FROM (SELECT *, ev < i AND {_APPROX.format('summary')} + held > 256 AS o FROM cs_ JOIN ca USING (conv_id)) WHERE o OR i < n),
done AS (SELECT *, {_APPROX.format('summary')} + held AS tokens FROM cs_ JOIN ca USING (conv_id) WHERE i = n AND NOT (ev < i AND {_APPROX.format('summary')} + held > 256))"""
_PREFIX = f"WITH {_BM25}, {_OVERLAP}, {_fused()}, {_LEXICAL}, {_GUARD}"
_TRUTH = "truth AS (SELECT q.query_id, c.chunk_id AS id FROM q JOIN c ON contains(c.text, q.text))"

_CENTROIDS = """x AS (SELECT label, unnest(range(1, 65)) AS i, embedding FROM embeddings),
cm AS (SELECT label, i, round(avg(CAST(embedding[i] AS DOUBLE)), 9) AS m FROM x GROUP BY ALL),
cv AS (SELECT CAST(label AS VARCHAR) AS query_id, list(m ORDER BY i) AS vec FROM cm GROUP BY label)"""


def _near(k: int, columns: str) -> str:
    return f"""WITH {_CENTROIDS}, s AS (SELECT query_id, CAST(vec_id AS VARCHAR) AS chunk_id,
  round(list_dot_product(embedding::DOUBLE[], vec) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(vec, vec))), 6) AS score
  FROM embeddings, cv), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM s WHERE score > 0 QUALIFY rank <= {k})
SELECT {columns} FROM r"""


#: The words that parts' names and types are made of.
PART_WORDS = "anvil blue bolt cold economy gear gizmo hot large medium new old plate promo red ring rod small standard widget".split()


def _part_vectors(slots: int | None) -> str:
    """CTEs tf (id, term, tf) of the parts' texts and hs (term, slot, sign) of their words."""
    rows = []
    for w in PART_WORDS:
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
        rows.append((w, h % slots if slots else (h >> 1) % 512, 1 if slots or h >> 1 & 1 << 20 else -1))
    return f"""tf AS (SELECT id, term, count(*) AS tf FROM (SELECT CAST(p_partkey AS VARCHAR) AS id,
  unnest({_tokens("concat_ws(' ', p_name, p_type, CASE WHEN p_size % 2 = 0 THEN p_name END)")}) AS term FROM part) GROUP BY ALL), hs AS ({_values(rows, 'term, slot, sign')})"""


def _mixed_tokens(column: str) -> str:
    """Pairs of neighbours in runs of CJK, then the runs of the rest."""
    pairs = f"list_transform(regexp_extract_all({column}, '[{CJK}]+'), lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END)"
    rest = f"regexp_extract_all(regexp_replace(lower({column}), '[{CJK}]', ' ', 'g'), '[\\p{{L}}\\p{{N}}_\\-+#.]+')"
    return f"list_concat(flatten({pairs}), {rest})"


_SYNONYMS = _values([(i, k, j, t) for i, (k, ts) in enumerate(sorted(THESAURUS.items(), key=lambda e: -len(e[0]))) for j, t in enumerate(ts)], "ki, key, ti, term")
_KEYS = "['" + "','".join(THESAURUS) + "']"


def _has(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _nested(text: str, pairs: list[tuple[str, str]]) -> str:
    for old, new in pairs:
        text = f"replace({text}, '{old}', '{new}')"
    return text


_GLYPHS = [("℃", "deg"), ("℉", "deg"), ("°C", "degC"), ("°F", "degF"), ("°c", "degC"), ("°f", "degF"), ("°", "deg")]
_ROUTES = f"""x AS (SELECT key, {_nested('text', _GLYPHS)} AS t FROM r),
y AS (SELECT key, t, lower(t) AS low, {_STRIP.format("trim(" + _STRIP.format(_nested('lower(t)', [(w, ' ') for w in MATH_WORDS])) + ", '" + MATH_TRIM + "')")} AS e FROM x),
z AS (SELECT *, regexp_extract(t, '{UNIT_QUESTION}', 1) AS v, regexp_extract(t, '{UNIT_QUESTION}', 2) AS a, regexp_extract(t, '{UNIT_QUESTION}', 3) AS b,
  list_transform(regexp_extract_all(t, '{DATE_QUESTION}'), lambda d: replace(d, '/', '-')) AS d FROM y),
k AS (SELECT *, CASE WHEN length(e) <= 200 AND regexp_full_match(e, '[0-9+\\-*/%^(). \\t]+') AND regexp_matches(e, '[0-9]') AND regexp_matches(e, '[-+*/%^]')
    AND length(replace(e, '(', '')) = length(replace(e, ')', '')) THEN 'arithmetic'
  WHEN v <> '' AND {_has('low', UNIT_WORDS)} AND lower(a) <> lower(b) THEN 'unit'
  WHEN len(d) >= 2 AND {_has('low', DATE_WORDS)} THEN 'date' ELSE 'retrieve' END AS kind FROM z)
SELECT key, kind, CASE kind WHEN 'arithmetic' THEN e WHEN 'unit' THEN concat_ws(' ', v, a, b) WHEN 'date' THEN d[1] || ' ' || d[2] ELSE '' END AS payload FROM k"""


ORACLES: dict[str, str] = {
    "tokenize_stats": f"SELECT doc_id, CAST(len(t) AS INT) AS n_tokens, CAST(len(list_distinct(t)) AS INT) AS n_distinct, t[1] AS first_token FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents)",
    "token_df": f"WITH {_CHUNKS}, p AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(t) AS term FROM c) GROUP BY ALL) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM p GROUP BY term",
    "tokenize_inline": _values(list(enumerate(_MIXED_TOKENS)), "id, tokens"),
    "sentence_split_counts": f"SELECT doc_id, CAST(len(s) AS INT) AS n_sentences, CAST(coalesce(list_sum(list_transform(s, lambda p: length(p))), 0) AS INT) AS n_chars FROM (SELECT doc_id, {_sentences('text')} AS s FROM documents)",
    "jaccard_pairs": f"""WITH s AS (SELECT doc_id, list_distinct({_tokens('text')}) AS a FROM documents)
SELECT x.doc_id, CASE WHEN len(x.a) + len(y.a) = 0 THEN 1 ELSE round(len(list_intersect(x.a, y.a)) / (len(x.a) + len(y.a) - len(list_intersect(x.a, y.a))), 6) END AS jaccard,
       CASE WHEN len(x.a) = 0 THEN 0 ELSE round(len(list_intersect(x.a, y.a)) / len(x.a), 6) END AS overlap
FROM s x JOIN s y ON y.doc_id = x.doc_id + 1""",
    "normalised_text": f"SELECT doc_id, CAST(length(t) AS INT) AS n, md5(t) AS digest FROM (SELECT doc_id, {_FLAT.format('text')} AS t FROM documents)",
    "content_token_counts": f"SELECT doc_id, CAST(len({_content('text')}) AS INT) AS n_content FROM documents",
    "best_excerpts": f"""WITH {_BM25}, e AS (SELECT bm.query_id, bm.chunk_id, list_distinct(q.t) AS qt, {_sentences(_FLAT.format('c.text'))} AS s FROM bm JOIN c USING (chunk_id) JOIN q USING (query_id) WHERE rank = 1),
x AS (SELECT query_id, chunk_id, qt, unnest(s) AS p, unnest(range(1, len(s) + 1)) AS i FROM e)
SELECT query_id, chunk_id, left(arg_max(p, len(list_intersect(qt, list_distinct({_tokens('p')}))) * 1000000 - i), 160) AS excerpt FROM x GROUP BY ALL""",
    "conversation_compaction": f"WITH {_COMPACT} SELECT conv_id, n AS n_turns, i - ev AS kept, ev AS evicted, CAST(tokens AS BIGINT) AS tokens, md5(summary) AS summary_digest FROM done",
    "conversation_stream": f"WITH {_COMPACT} SELECT conv_id, n AS n_turns, i - ev AS kept, ev AS evicted, CAST(tokens AS BIGINT) AS tokens, md5(summary) AS summary_digest FROM done",
    "conversation_context": f"""WITH {_COMPACT} SELECT conv_id, -1::BIGINT AS "at", 'system' AS role, md5('Earlier conversation summary: ' || summary) AS digest FROM done WHERE summary <> ''
UNION ALL SELECT conv_id, CAST(places[j] AS BIGINT), r[j], md5(t[j]) FROM (SELECT *, unnest(range(ev + 1, n + 1)) AS j FROM done)""",
    "tool_dispatch": _values([(i, *row[2:]) for i, row in enumerate(TOOL_CALLS)], "id, ok, value, error"),
    "guard_probe": _values([(f"probe#{i}", i + 1, i + 1, 0.0, -1.0, 5 - i) for i in range(5)], "chunk_id, pos, guarded_pos, alpha_eff, spearman, naive_pos"),
    "hash_embed_slots": f"""WITH tf AS ({_remembered(True)}), w AS (SELECT id, slot, sum(sign * (1 + ln(tf))) AS w FROM tf JOIN ({_hashes(None)}) USING (term) GROUP BY ALL),
nn AS (SELECT id, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL)
SELECT id, slot, round(w / norm, 9) AS weight FROM w JOIN nn USING (id) WHERE w <> 0""",
    "memory_recall": f"""WITH tf AS ({_remembered(False)}), w AS (SELECT id, slot, sum(tf)::DOUBLE AS w FROM tf JOIN ({_hashes(256)}) USING (term) GROUP BY ALL),
u AS (SELECT id, slot, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM w),
s AS (SELECT CAST(a.id AS VARCHAR) AS query_id, CAST(b.id AS VARCHAR) AS chunk_id, round(sum(a.w * b.w), 12) AS score FROM u a JOIN u b USING (slot) GROUP BY ALL)
SELECT query_id, chunk_id, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM s WHERE score > 0 QUALIFY rank <= 3""",
    "approx_token_counts": "SELECT conv_id, CAST(sum(len(regexp_extract_all(text, '[\\x{3400}-\\x{9FFF}]')) + (length(text) - len(regexp_extract_all(text, '[\\x{3400}-\\x{9FFF}]'))) // 4 + 1) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id",
    "stream_slices": "SELECT query_id, CAST(i AS INT) AS at, substring(text, CAST(i * 24 + 1 AS INT), 24) AS piece FROM (SELECT CAST(item_id AS VARCHAR) AS query_id, text, unnest(range(0, (length(text) + 23) // 24)) AS i FROM benchmark)",
    "pictograph_scan": f"""WITH r AS (SELECT 'inline-' || id AS key, text FROM ({_values(list(enumerate(MIXED_TEXTS)), 'id, text')}) UNION ALL SELECT CAST(doc_id AS VARCHAR), text FROM documents UNION ALL SELECT 'page-' || page_id, html FROM pages),
l AS (SELECT key, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM r)
SELECT key, CAST(line AS INT) AS line, CAST(j AS INT) AS "column", 'U+' || CASE WHEN length(printf('%X', unicode(ch))) < 4 THEN lpad(printf('%X', unicode(ch)), 4, '0') ELSE printf('%X', unicode(ch)) END AS code
FROM (SELECT key, line, j, t[j] AS ch FROM (SELECT key, line, t, unnest(range(1, length(t) + 1)) AS j FROM l)) WHERE regexp_matches(ch, '[\\x{{2600}}-\\x{{27BF}}\\x{{2B00}}-\\x{{2BFF}}\\x{{FE00}}-\\x{{FE0F}}\\x{{1F000}}-\\x{{1F02F}}\\x{{1F0A0}}-\\x{{1F0FF}}\\x{{1F100}}-\\x{{1F5FF}}\\x{{1F600}}-\\x{{1F64F}}\\x{{1F680}}-\\x{{1F6FF}}\\x{{1F900}}-\\x{{1F9FF}}\\x{{1FA00}}-\\x{{1FAFF}}\\x{{200D}}\\x{{20E3}}\\x{{E0020}}-\\x{{E007F}}]')""",
    "number_formats": "SELECT l_orderkey, l_linenumber, CASE WHEN v = round(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE CAST(v AS VARCHAR) END AS shown FROM (SELECT *, l_quantity / 8 AS v FROM lineitem)",
    "bm25_topk": f"WITH {_BM25} SELECT query_id, chunk_id, score, rank FROM bm",
    "tokenize_mixed": f"""SELECT doc_id, CAST(len(t) AS INT) AS n_tokens, md5(array_to_string(t, '|')) AS digest
FROM (SELECT doc_id, {_mixed_tokens('m')} AS t FROM (SELECT doc_id, translate(text, 'aeiou', '猫检索融合') AS m FROM documents))""",
    "hash_embed_parts": f"""WITH {_part_vectors(None)}, w AS (SELECT id, slot, sum(sign * (1 + ln(tf))) AS w FROM tf JOIN hs USING (term) GROUP BY ALL)
SELECT id AS key, slot, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 9) AS weight FROM w WHERE w <> 0""",
    "hash_search_parts": f"""WITH {_part_vectors(None)}, w AS (SELECT id, slot, sum(sign * (1 + ln(tf))) AS w FROM tf JOIN hs USING (term) GROUP BY ALL),
u AS (SELECT id, slot, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM w WHERE w <> 0),
s AS (SELECT a.id AS query_id, b.id AS chunk_id, round(sum(a.w * b.w), 12) AS score FROM u a JOIN u b USING (slot) WHERE CAST(a.id AS INT) % 100 = 0 GROUP BY ALL)
SELECT query_id, chunk_id, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM s WHERE score > 0 QUALIFY rank <= 6""",
    "memory_recall_parts": f"""WITH {_part_vectors(256)}, w AS (SELECT id, slot, sum(tf)::DOUBLE AS w FROM tf JOIN hs USING (term) GROUP BY ALL),
u AS (SELECT id, slot, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM w),
s AS (SELECT a.id AS query_id, b.id AS chunk_id, round(sum(a.w * b.w), 12) AS score FROM u a JOIN u b USING (slot) WHERE CAST(a.id AS INT) % 100 = 0 GROUP BY ALL)
SELECT query_id, chunk_id, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM s WHERE score > 0 QUALIFY rank <= 3""",
    "guard_on_reversed": f"""WITH {_BM25}, g1 AS (SELECT query_id, rank AS pos, score, CAST(rank AS DOUBLE) AS s,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS ra, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, rank) AS rb FROM bm),
sp AS (SELECT query_id, CASE WHEN count(*) < 2 OR min(score) = max(score) THEN 0 ELSE round(corr(ra, rb), 12) END AS rho FROM g1 GROUP BY ALL),
g2 AS (SELECT g1.*, rho, CASE WHEN rho < 0 THEN 0.0 WHEN rho < 0.2 THEN 0.25 ELSE 0.5 END::DOUBLE AS alpha_eff,
  min(score) OVER w AS lo, max(score) OVER w AS hi, min(s) OVER w AS slo, max(s) OVER w AS shi FROM g1 JOIN sp USING (query_id) WINDOW w AS (PARTITION BY g1.query_id)),
g3 AS (SELECT *, round((1 - alpha_eff) * CASE WHEN hi - lo < 1e-12 THEN 1 ELSE (score - lo) / (hi - lo) END + alpha_eff * CASE WHEN shi - slo < 1e-12 THEN 1 ELSE (s - slo) / (shi - slo) END, 12) AS blended FROM g2)
SELECT query_id, pos, CAST(row_number() OVER (PARTITION BY query_id ORDER BY blended DESC, pos) AS INT) AS guarded_pos, alpha_eff, round(rho, 6) AS spearman, CAST(rb AS INT) AS naive_pos FROM g3""",
    "expand_documents": f"""WITH ks AS (SELECT {_KEYS} AS k), sy AS ({_SYNONYMS}),
d AS (SELECT doc_id, concat_ws(' ', text, {', '.join(f"CASE WHEN doc_id % 6 > {i} THEN k[(doc_id * {i + 1} + {i + 1}) % {len(THESAURUS)} + 1] END" for i in range(5))}) AS q FROM documents, ks),
h AS (SELECT doc_id, q, ki, key, ti, term, NOT contains(lower(q), lower(term)) AS new FROM d JOIN sy ON contains(q, key)),
f AS (SELECT doc_id, ki, ti, term FROM h WHERE new QUALIFY row_number() OVER (PARTITION BY doc_id, term ORDER BY ki, ti) = 1),
t AS (SELECT doc_id, string_agg(term, '|' ORDER BY ki, ti) AS terms, string_agg(term, ' ' ORDER BY ki, ti) AS spaced
      FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ki, ti) <= 12) GROUP BY doc_id),
m AS (SELECT doc_id, string_agg(key, '|' ORDER BY ki) AS matched FROM (SELECT DISTINCT doc_id, ki, key FROM h) g
      WHERE (SELECT count(*) FROM f WHERE f.doc_id = g.doc_id AND f.ki < g.ki) < 12 GROUP BY doc_id)
SELECT doc_id, coalesce(terms, '') AS terms, coalesce(matched, '') AS matched, md5(q || coalesce(' ' || spaced, '')) AS digest FROM d LEFT JOIN t USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "chunk_customers": f"""WITH o AS (SELECT o_custkey, rpad('order ' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') || ' of ' || o_orderpriority, 100, '.') AS line FROM orders),
d AS (SELECT CAST(o_custkey AS VARCHAR) AS id, count(*) AS m, 13 + length(CAST(o_custkey AS VARCHAR)) AS h, string_agg(line, chr(10) ORDER BY line) || chr(10) || repeat('x', 1500) AS body FROM o GROUP BY o_custkey),
e AS (SELECT id, '# Customer ' || id || chr(10) || chr(10) || body AS text, list_concat(list_transform(range(0, (m + 5) // 6), lambda i: h + 606 * i), [h + 101 * m, h + 101 * m + 680, h + 101 * m + 1360]) AS s FROM d),
c AS (SELECT id, text, i - 1 AS n, CASE WHEN i = 1 THEN 0 ELSE s[i] END AS a, coalesce(s[i + 1], length(text)) AS z FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM e))
SELECT id || '#' || n AS chunk_id, CAST(n AS INT) AS ordinal, CAST(a AS INT) AS start, CAST(z AS INT) AS "end", 'Customer ' || id AS heading,
       md5({_STRIP.format("substring(text, CAST(greatest(0, a - 120) + 1 AS INT), CAST(z - greatest(0, a - 120) AS INT))")}) AS digest FROM c""",
    "route_texts": f"""WITH l AS (SELECT *, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS n, strftime(CAST(l_shipdate AS DATE), '%Y-%m-%d') AS dt FROM lineitem),
r AS (SELECT 'd' || doc_id AS key, text FROM documents UNION ALL SELECT 'b' || item_id, text FROM benchmark UNION ALL
  SELECT 'l' || l_orderkey || '-' || l_linenumber, CASE l_linenumber WHEN 1 THEN 'What is ' || n || ' * (2 + 3)? ' WHEN 2 THEN n || ' ft to cm'
    WHEN 3 THEN 'how many days between ' || dt || ' and 2000/01/02' WHEN 4 THEN n || ' kg to KG' WHEN 5 THEN '(' || n || ' + 1)) - 2' ELSE dt || ' / ' || n END FROM l), {_ROUTES}""",
    "tool_lines": """WITH l AS (SELECT *, CAST(l_quantity AS INT) AS n, l_linenumber AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, k IN (1, 3, 5) AS ok, CASE k WHEN 1 THEN CAST(n * 2 - 1 AS VARCHAR) WHEN 3 THEN (n * 1000) || ' m'
    WHEN 5 THEN abs(date_diff('day', CAST(l_shipdate AS DATE), DATE '2000-01-01')) || ' 天' ELSE '' END AS value,
  CASE WHEN k IN (1, 3, 5) THEN '' WHEN k = 2 THEN 'division by zero' WHEN k = 4 THEN 'no conversion from kg to m' WHEN k = 6 THEN 'expected ''<date-a> <date-b>''' ELSE 'unknown tool: no_such' END AS error FROM l""",
    "parsed_turns": f"""WITH c AS (SELECT conv_id, turn, turn % 5 AS k, string_split(coalesce(text, ''), chr(10)) AS l FROM conversations),
f AS (SELECT *, {_STRIP.format("l[1]")} AS one, {_STRIP.format("array_to_string(list_concat([trim(l[1])], list_filter(list_transform(l[2:], lambda x: " + _STRIP.format('x') + "), lambda x: x <> '')), chr(10))")} AS whole FROM c)
SELECT conv_id, turn, CASE WHEN k = 0 THEN 'search' END AS tool, CASE WHEN k = 0 THEN md5(trim(replace(l[1], ']', ')'))) END AS payload,
       CASE WHEN k = 1 THEN md5(whole) WHEN k = 2 AND one <> '' AND NOT regexp_matches(lower(one), '^(action|thought|observation):') THEN md5(one) END AS final FROM f""",
    "sweep_settings": f"""WITH {_BM25}, {_OVERLAP}, {_TRUTH}, se AS ({_values([(n, *v) for n, v in SETTINGS.items()], 'setting, k1, b, rrf')}),
ss AS (SELECT setting, query_id, chunk_id, round(round(sum(qtf * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))), 12), 6) AS score
       FROM p JOIN idf USING (term) JOIN qt USING (term), st, se GROUP BY ALL),
sb AS (SELECT setting, query_id, chunk_id, row_number() OVER (PARTITION BY setting, query_id ORDER BY score DESC, chunk_id) AS rank FROM ss WHERE score > 0 QUALIFY rank <= 6),
sl AS (SELECT setting, query_id, chunk_id, rank, 0 AS l FROM ov, se UNION ALL SELECT *, 1 FROM sb),
sf AS (SELECT setting, query_id, chunk_id, round(sum(1.0::DOUBLE / (rrf + rank)), 12) AS score, min(l * 100000 + rank) AS seen FROM sl JOIN se USING (setting) GROUP BY ALL),
sg AS (SELECT setting, query_id, chunk_id, row_number() OVER (PARTITION BY setting, query_id ORDER BY score DESC, seen, chunk_id) AS rank FROM sf QUALIFY rank <= 6),
n AS (SELECT query_id, count(*) AS r FROM truth GROUP BY ALL),
h AS (SELECT setting, sg.query_id, rank, truth.id IS NOT NULL AS hit FROM sg LEFT JOIN truth ON truth.query_id = sg.query_id AND truth.id = sg.chunk_id),
s AS (SELECT setting, query_id, count_if(hit) AS hits, count(*) AS n_top, min(rank) FILTER (WHERE hit) AS first, sum(1 / log2(rank + 1)) FILTER (WHERE hit) AS dcg FROM h GROUP BY ALL)
SELECT se.setting, round(avg(CASE WHEN r IS NULL THEN 1 ELSE coalesce(hits / r, 0) END), 6) AS recall, round(avg(coalesce(hits / n_top, 0)), 6) AS precision, round(avg(coalesce(1 / first, 0)), 6) AS mrr,
       round(avg(coalesce(CASE WHEN r IS NOT NULL THEN dcg / list_sum(list_transform(range(1, least(6, r) + 1), lambda i: 1 / log2(i + 1))) END, 0)), 6) AS ndcg
FROM se CROSS JOIN q LEFT JOIN n USING (query_id) LEFT JOIN s ON s.setting = se.setting AND s.query_id = q.query_id GROUP BY se.setting""",
    "expand_thesaurus": """WITH w AS (SELECT list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z ]', ' ', 'g'), ' +'), lambda w: length(w) >= 5) AS w FROM benchmark),
pr AS (SELECT unnest(w) AS key, unnest(list_concat(w[2:], [NULL])) AS nxt FROM w),
sy AS (SELECT key, list_sort(list_distinct(list(nxt)))[1:3] AS terms FROM pr GROUP BY key),
h AS (SELECT doc_id, text, key, terms, row_number() OVER (PARTITION BY doc_id ORDER BY length(key) DESC, key) AS ki FROM documents JOIN sy ON contains(text, key)),
x AS (SELECT doc_id, text, ki, unnest(terms) AS term, unnest(range(len(terms))) AS ti FROM h),
f AS (SELECT doc_id, ki, ti, term FROM x WHERE NOT contains(lower(text), term) QUALIFY row_number() OVER (PARTITION BY doc_id, term ORDER BY ki, ti) = 1),
t AS (SELECT doc_id, string_agg(term, '|' ORDER BY ki, ti) AS terms, string_agg(term, ' ' ORDER BY ki, ti) AS spaced FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ki, ti) <= 12) GROUP BY doc_id),
c AS (SELECT doc_id, ki, count(*) AS n FROM f GROUP BY ALL),
b AS (SELECT h.doc_id, h.ki, key, coalesce(sum(n) OVER (PARTITION BY h.doc_id ORDER BY h.ki ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h LEFT JOIN c USING (doc_id, ki)),
m AS (SELECT doc_id, string_agg(key, '|' ORDER BY ki) AS matched FROM b WHERE before < 12 GROUP BY doc_id)
SELECT CAST(doc_id AS VARCHAR) AS query_id, coalesce(terms, '') AS terms, md5(coalesce(matched, '')) AS matched, md5(coalesce(text, '') || coalesce(' ' || spaced, '')) AS digest FROM documents LEFT JOIN t USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "bm25_blockmax": f"WITH {_BM25} SELECT query_id, chunk_id, score, rank FROM bm",
    "upsert_bm25": f"WITH {_BM25} SELECT query_id, chunk_id, score, rank FROM bm".replace(
        "FROM documents)", "FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'revised ' || left(text, 200) ELSE text END AS text FROM documents))", 1
    ),
    "ivf_exact_topk": """WITH v AS (SELECT CAST(vec_id AS VARCHAR) AS id, vec_id % 50 = 0 AS asked, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.id AS query_id, v.id AS chunk_id, round(list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))), 6) AS score FROM v q, v WHERE q.asked)
SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM s WHERE score > 0 QUALIFY rank <= 6""",
    "ivf_recall": "SELECT count(*) AS n_queries, true AS enough FROM embeddings WHERE vec_id % 50 = 0",
    "loop_traces": """WITH b AS (SELECT CAST(item_id AS VARCHAR) AS query_id, length(text) AS n FROM benchmark),
s AS (SELECT *, n % 6 + 1 AS need, n % 7 = 6 AND n % 6 > 0 AS lost FROM b),
e AS (SELECT *, CASE WHEN lost THEN 2 ELSE least(4, need) END AS steps, CASE WHEN lost THEN 1 WHEN need <= 4 THEN need - 1 ELSE 4 END AS calls FROM s)
SELECT query_id, CASE WHEN NOT lost AND need <= 4 THEN 'after ' || steps || chr(10) || 'rounds' END AS final, CAST(steps AS INT) AS steps,
       array_to_string(list_concat(list_transform(range(1, calls + 1), lambda i: 'step ' || i || ': calculator[' || n || '*' || i || '] -> ' || (n * i)),
         CASE WHEN lost THEN ['step 2: unparsable model output, stopping'] WHEN need > 4 THEN ['step budget of 4 exhausted'] ELSE []::VARCHAR[] END), '|') AS trace,
       md5(coalesce(array_to_string(list_transform(range(1, calls + 1), lambda i: 'Thought: Thought: more' || chr(10) || 'Action: calculator[' || n || '*' || i || ']' || chr(10) || 'Observation: ' || (n * i) || chr(10)), ''), '')) AS digest
FROM e""",
    "bm25_stats": f"WITH {_CHUNKS} SELECT count(*) AS n_docs, round(avg(greatest(1, len(t))), 6) AS avgdl FROM c",
    "bm25_idf": f"WITH {_CHUNKS}, d AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS term FROM c) GROUP BY term), n AS (SELECT count(*) AS n FROM c) SELECT term, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM d, n",
    "posting_lists": f"WITH {_CHUNKS}, p AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(t) AS term FROM c) GROUP BY ALL) SELECT chunk_id, count(*) AS n_terms, CAST(sum(tf) AS BIGINT) AS n_tokens, max(tf) AS max_tf FROM p GROUP BY chunk_id",
    "dense_topk": _near(6, "query_id, chunk_id, score, rank"),
    "vector_memory_recall": _near(3, "query_id, chunk_id, rank"),
    "cosine_to_label": f"WITH {_CENTROIDS} SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], vec) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(vec, vec))), 6) AS cosine FROM embeddings JOIN cv ON CAST(label AS VARCHAR) = query_id",
    "vector_upsert": "SELECT CASE WHEN label = 3 THEN 30 ELSE label END AS label, count(*) AS n FROM embeddings GROUP BY 1",
    "hash_embed_norm": f"SELECT doc_id, CASE WHEN len({_tokens('text')}) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm FROM documents",
    "rrf_fuse": f"WITH {_BM25}, {_OVERLAP}, {_fused()} SELECT query_id, chunk_id, round(score, 6) AS score, ranks, sources, pos FROM f",
    "rrf_weighted": f"WITH {_BM25}, {_OVERLAP}, {_fused(5.0, 0.1)} SELECT query_id, chunk_id, round(score, 6) AS score, ranks, sources, pos FROM f",
    "minmax_norm": f"WITH {_BM25}, m AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM bm WINDOW w AS (PARTITION BY query_id)) SELECT query_id, chunk_id, CASE WHEN hi - lo < 1e-12 THEN 1 ELSE round((score - lo) / (hi - lo), 6) END AS norm FROM m",
    "lexical_rerank": f"{_PREFIX} SELECT query_id, pos, rerank_score FROM lx",
    "spearman_guard": f"{_PREFIX} SELECT query_id, n, round(rho, 6) AS spearman FROM sp",
    "guarded_rerank": f"""{_PREFIX}, g2 AS (SELECT g1.*, CASE WHEN round(rho, 12) < 0 THEN 0.0 WHEN round(rho, 12) < 0.2 THEN 0.25 ELSE 0.5 END::DOUBLE AS alpha_eff,
  min(score) OVER w AS lo, max(score) OVER w AS hi, min(s) OVER w AS slo, max(s) OVER w AS shi FROM g1 JOIN sp USING (query_id) WINDOW w AS (PARTITION BY g1.query_id)),
g3 AS (SELECT *, round((1 - alpha_eff) * CASE WHEN hi - lo < 1e-12 THEN 1 ELSE (score - lo) / (hi - lo) END + alpha_eff * CASE WHEN shi - slo < 1e-12 THEN 1 ELSE (s - slo) / (shi - slo) END, 12) AS blended FROM g2)
SELECT query_id, chunk_id, pos, CAST(row_number() OVER (PARTITION BY query_id ORDER BY blended DESC, pos) AS INT) AS final_pos, alpha_eff, alpha_eff > 0 AS applied, round(blended, 6) AS score FROM g3""",
    "naive_rerank": f"{_PREFIX} SELECT query_id, chunk_id, pos, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, pos) AS INT) AS final_pos FROM g0",
    "expand_queries": _values([(i, "|".join(t), "|".join(m), " ".join([q, *t])) for i, (q, (t, m)) in enumerate(zip(EXPANSION_QUESTIONS, _EXPANDED, strict=True))], "id, terms, matched, query"),
    "chunk_coverage": "SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, 0 AS first, CAST(length(text) AS INT) AS last FROM documents WHERE length(text) > 0",
    "hard_windows": "SELECT doc_id, CAST(s AS INT) AS start, CAST(least(s + 680, n) AS INT) AS \"end\" FROM (SELECT doc_id, length(text) AS n, unnest(range(0, greatest(1, length(text)), 680)) AS s FROM documents)",
    "reingest_anti": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(length(t) AS INT) AS n, md5(t) AS digest FROM (SELECT doc_id, CASE WHEN length(text) < 500 THEN 'new: ' || text ELSE text END AS t FROM documents)",
    "blank_documents": "SELECT count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents WHERE length(text) >= 200",
    "route_kinds": "SELECT 'arithmetic' AS kind, count(*) AS n FROM lineitem UNION ALL SELECT 'unit', count(*) FROM part UNION ALL SELECT 'date', count(*) FROM orders UNION ALL SELECT 'retrieve', count(*) FROM benchmark",
    "routes_inline": _values([(i, k, p) for i, (_, k, p) in enumerate(ROUTED)], "id, kind, payload"),
    "calc_lineitem": "SELECT l_orderkey, l_linenumber, true AS ok, CAST(CAST(l_quantity AS INT) * (l_linenumber + 7) - 8 AS VARCHAR) AS value FROM lineitem",
    "unit_part": "SELECT p_partkey, true AS ok, CAST(p_size * 1000 AS VARCHAR) || ' m' AS value FROM part",
    "date_diff_orders": "SELECT l_orderkey, l_linenumber, true AS ok, CAST(abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS VARCHAR) || ' 天' AS value FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    "query_validation": "SELECT doc_id AS query_id, length(text) BETWEEN 1 AND 4000 AS valid FROM documents",
    "grounding_support": f"""WITH {_BM25}, cl AS (SELECT query_id, unnest(list_filter({_sentences(_FLAT.format('text'))}, lambda s: length(s) >= 6 AND NOT ends_with(s, '?') AND NOT ends_with(s, '？'))) AS claim FROM q),
cn AS (SELECT query_id, row_number() OVER () AS id, {_content('claim')} AS t FROM cl),
ev AS (SELECT query_id, {_content('s')} AS e FROM (SELECT bm.query_id, unnest({_sentences(_FLAT.format('c.text'))}) AS s FROM bm JOIN c USING (chunk_id) WHERE rank <= 2)),
best AS (SELECT cn.query_id, id, max(len(list_intersect(list_distinct(t), list_distinct(e))) / len(list_distinct(t))) AS b FROM cn JOIN ev USING (query_id) WHERE len(t) >= 2 AND len(e) > 0 GROUP BY ALL),
j AS (SELECT cn.query_id, len(t) < 2 OR coalesce(b, 0) >= 0.6 AS ok FROM cn LEFT JOIN best USING (query_id, id)),
a AS (SELECT query_id, count(*) AS n, count_if(ok) AS k FROM j GROUP BY ALL)
SELECT q.query_id, CAST(coalesce(n, 0) AS INT) AS checked, CAST(coalesce(k, 0) AS INT) AS supported, coalesce(round(k / n, 6), 1) AS support_rate FROM q LEFT JOIN a USING (query_id)""",
    "extract_best_sentence": f"""WITH {_BM25}, e AS (SELECT bm.query_id, bm.chunk_id, bm.rank, {_sentences(_FLAT.format('c.text'))} AS s FROM bm JOIN c USING (chunk_id)),
x AS (SELECT query_id, chunk_id, rank, unnest(s) AS p, unnest(range(1, len(s) + 1)) AS i FROM e),
y AS (SELECT x.query_id, chunk_id, rank, i, p, list_distinct({_content('q.text')}) AS a, list_distinct({_content('p')}) AS b FROM x JOIN q USING (query_id) WHERE length(p) >= 8 AND NOT starts_with(p, '#')),
z AS (SELECT *, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE round(len(list_intersect(a, b)) / sqrt(len(a) * len(b)), 12) END AS score FROM y)
SELECT query_id, chunk_id, p AS sentence, round(score, 6) AS score, p || ' (依据：' || chunk_id || ')' AS answer FROM z WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, i) = 1""",
    "evidence_blocks": f"""WITH {_BM25}, b AS (SELECT query_id, '<kb-context>' || chr(10) || string_agg('[' || bm.chunk_id || '] ' || {_FLAT.format('c.text')}, chr(10) ORDER BY rank) || chr(10) || '</kb-context>' AS block FROM bm JOIN c USING (chunk_id) GROUP BY ALL)
SELECT query_id, CAST(length(block) AS INT) AS n, md5(block) AS digest FROM b""",
    "parsed_outputs": _values([(i, t, p, f) for i, (_, t, p, f) in enumerate(RAW_OUTPUTS)], "id, tool, payload, final"),
    "eval_ranking": f"""WITH {_BM25}, {_TRUTH}, n AS (SELECT query_id, count(*) AS r FROM truth GROUP BY ALL),
h AS (SELECT bm.query_id, rank, truth.id IS NOT NULL AS hit FROM bm LEFT JOIN truth ON truth.query_id = bm.query_id AND truth.id = bm.chunk_id),
s AS (SELECT query_id, count_if(hit) AS hits, count(*) AS n_top, min(rank) FILTER (WHERE hit) AS first, sum(1 / log2(rank + 1)) FILTER (WHERE hit) AS dcg FROM h GROUP BY ALL)
SELECT q.query_id, CASE WHEN r IS NULL THEN 1 ELSE round(coalesce(hits / r, 0), 6) END AS recall, round(coalesce(hits / n_top, 0), 6) AS precision, round(coalesce(1 / first, 0), 6) AS reciprocal_rank,
       round(coalesce(CASE WHEN r IS NOT NULL THEN dcg / list_sum(list_transform(range(1, least(6, r) + 1), lambda i: 1 / log2(i + 1))) END, 0), 6) AS ndcg
FROM q LEFT JOIN n USING (query_id) LEFT JOIN s USING (query_id)""",
    "eval_documents": f"""WITH {_BM25}, {_TRUTH}, h AS (SELECT bm.query_id, min(rank) AS first FROM bm JOIN truth ON truth.query_id = bm.query_id AND truth.id = bm.chunk_id GROUP BY ALL)
SELECT q.query_id, CASE WHEN first IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS doc_hit, round(coalesce(1 / first, 0), 6) AS doc_rr FROM q LEFT JOIN h USING (query_id)""",
    "latency_percentiles": "WITH r AS (SELECT event_type AS key, value AS ms FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 512) SELECT key, count(*) AS n, round(avg(ms), 6) AS mean, round(quantile_cont(ms, 0.5), 6) AS p50, round(quantile_cont(ms, 0.95), 6) AS p95, round(max(ms), 6) AS max FROM r GROUP BY key",
    "counters": "SELECT event_type AS key, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY event_type",
    "corpus_counts": "SELECT count(*) AS n_docs, count(DISTINCT lang) AS n_langs, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents",
}
