"""DuckDB SQL of the registered retrieval queries."""

from __future__ import annotations

from trawl.operators.chat import DEFAULT_SYSTEM, HEADER, NO_MATCH
from trawl.operators.testset import COLLOQUIAL, NEGATIVES, PREFIXES, SUFFIXES

REC = """
rec AS (SELECT doc_id + 1 AS data_id, concat(lang, ' ', source, ' #', doc_id) AS symptoms, text AS cause, source AS diagnosis, lang AS treatment FROM documents)"""
RECORDS = f"""{REC},
ask AS (SELECT item_id AS query_id, text AS query FROM benchmark)"""

STRIP = r"regexp_replace(coalesce({0}, ''), '^\s+|\s+$', '', 'g')"


def strip(c: str) -> str:
    return STRIP.format(c)


COMBINED = strip(f"{strip('cause')} || ' ' || {strip('symptoms')}")
PHRASES = f"list_filter(list_transform(regexp_split_to_array(coalesce(cause, ''), '[,ๆ]?\\s{{1,}}|,'), lambda p: {strip('p')}), lambda p: length(p) >= 6)"


def whole(text: str, kind: str) -> str:
    return f"SELECT data_id, 0::BIGINT AS chunk_id, text, '{kind}' AS kind FROM (SELECT data_id, {text} AS text FROM rec) WHERE text <> ''"


def listed(phrases: str) -> str:
    """Phrases of a record in order, then its whole row."""
    return f"""SELECT data_id, (unnest(range(len(c))))::BIGINT AS chunk_id, unnest(list_transform(c, lambda x: x.t)) AS text, unnest(list_transform(c, lambda x: x.k)) AS kind
FROM (SELECT data_id, list_concat(list_transform(p, lambda x: {{'t': x, 'k': 'phrase'}}), CASE WHEN row_ <> '' THEN [{{'t': row_, 'k': 'row'}}] ELSE [] END) AS c
      FROM (SELECT data_id, {COMBINED} AS row_, {phrases} AS p FROM rec))"""


def expanded_rows(synonyms) -> str:
    """The same as rows: first appearances of every rewording, then the row."""
    union = ["SELECT data_id, pos, -1 AS o, 0 AS v, p AS text FROM ph"]
    for i, (term, variants) in enumerate(synonyms):
        union += [f"SELECT data_id, pos, {i}, {j}, replace(p, '{term}', '{v}') FROM ph WHERE contains(p, '{term}')" for j, v in enumerate(variants)]
    return f"""ph AS (SELECT data_id, unnest(range(len(ps))) AS pos, unnest(ps) AS p FROM (SELECT data_id, {PHRASES} AS ps FROM rec)),
every AS ({" UNION ALL ".join(union)}),
firsts AS (SELECT data_id, text, min((pos, o, v)) AS place FROM every GROUP BY 1, 2),
chunk AS (SELECT data_id, row_number() OVER (PARTITION BY data_id ORDER BY place) - 1 AS chunk_id, text, 'phrase' AS kind FROM firsts
          UNION ALL SELECT r.data_id, coalesce(n, 0), {COMBINED}, 'row' FROM rec r LEFT JOIN (SELECT data_id, count(*) AS n FROM firsts GROUP BY 1) USING (data_id)
          WHERE {COMBINED} <> '')"""


CHARS = r"regexp_extract_all({0}, '(?s).')"


def grams3(table: str, key: str, text: str) -> str:
    """3-grams of a table's texts between two spaces."""
    t = f"' ' || {strip(text)} || ' '"
    return f"""SELECT * FROM (SELECT {key}, unnest(CASE WHEN len(c) < 3 THEN [array_to_string(c, '')]
  ELSE list_transform(list_zip(c, c[2:], c[3:]), lambda x: x[1] || x[2] || x[3]) END) AS gram
FROM (SELECT {key}, {CHARS.format(t)} AS c FROM {table})) WHERE gram IS NOT NULL"""


def bm25(k: int) -> str:
    """CTEs from rec, ask and chunk to bm(query_id, data_id, rank, score)."""
    return f"""
tf AS (SELECT data_id, chunk_id, gram, count(*) AS tf FROM ({grams3("chunk", "data_id, chunk_id", "text")}) GROUP BY ALL),
dl AS (SELECT data_id, chunk_id, sum(tf) AS dl FROM tf GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(dl) AS avg_len FROM dl),
df AS (SELECT gram, count(*) AS df FROM tf GROUP BY 1),
qg AS (SELECT query_id, gram, count(*) AS qn FROM ({grams3("ask", "query_id", "query")}) GROUP BY ALL),
bs AS (SELECT query_id, data_id, chunk_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5) + 1.0), 0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(avg_len, 1e-9))) * qn) AS score
       FROM qg JOIN tf USING (gram) JOIN df USING (gram) JOIN dl USING (data_id, chunk_id), st GROUP BY ALL),
bp AS (SELECT query_id, data_id, max(score) AS score FROM bs WHERE score > 0 GROUP BY ALL),
bm AS (SELECT * FROM (SELECT query_id, data_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, data_id) AS rank, score FROM bp) WHERE rank <= {k})"""


def wb(table: str, key: str, text: str) -> str:
    return f"""SELECT {key}, gram, sum(n) AS tf FROM (
  SELECT {key}, n, unnest(list_concat(list_concat(list_transform(range(1, greatest(length(w), 1)), lambda i: substring(w, i, 2)),
    list_transform(range(1, greatest(length(w) - 1, 1)), lambda i: substring(w, i, 3))), list_transform(range(1, greatest(length(w) - 2, 1)), lambda i: substring(w, i, 4)))) AS gram
  FROM (SELECT {key}, ' ' || w || ' ' AS w, count(*) AS n FROM (SELECT {key}, unnest(regexp_split_to_array({strip(f"lower({text})")}, '\\s+')) AS w FROM {table}) WHERE w <> '' GROUP BY ALL)
) GROUP BY ALL"""


def vocabulary() -> str:
    return f"""
wt AS ({wb("chunk", "data_id, chunk_id", "text")}),
voc AS (SELECT gram, count(*) AS df, ln((1 + (SELECT count(*) FROM chunk)) / (1 + count(*))) + 1 AS idf FROM wt GROUP BY 1)"""


def tfidf(k: int) -> str:
    """CTEs from rec, ask and chunk to ti(query_id, data_id, rank, score)."""
    return f"""{vocabulary()},
wd AS (SELECT data_id, chunk_id, gram, tf * idf AS w FROM wt JOIN voc USING (gram)),
nd AS (SELECT data_id, chunk_id, sqrt(sum(w * w)) AS nd FROM wd GROUP BY ALL),
wq AS (SELECT query_id, gram, tf * idf AS v FROM ({wb("ask", "query_id", "query")}) JOIN voc USING (gram)),
nq AS (SELECT query_id, sqrt(sum(v * v)) AS nq FROM wq GROUP BY ALL),
ts AS (SELECT query_id, data_id, max(dot / (nd * nq)) AS score FROM (SELECT query_id, data_id, chunk_id, sum(w * v) AS dot FROM wq JOIN wd USING (gram) GROUP BY ALL)
       JOIN nd USING (data_id, chunk_id) JOIN nq USING (query_id) GROUP BY ALL),
tp AS (SELECT * FROM ts UNION ALL SELECT query_id, data_id, 0 FROM ask, (SELECT DISTINCT data_id FROM chunk) WHERE (query_id, data_id) NOT IN (SELECT (query_id, data_id) FROM ts)),
ti AS (SELECT * FROM (SELECT query_id, data_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, data_id) AS rank, score FROM tp) WHERE rank <= {k})"""


def projected(table: str, key: str, count: str) -> str:
    """Unit vectors of projected grams."""
    sums = ", ".join(f"sum({count} * v[{i}])::DOUBLE" for i in range(1, 33))
    return f"""SELECT {key}, list_transform(e, lambda x: (x / CASE WHEN nn = 0 THEN 1 ELSE nn END)::FLOAT::DOUBLE) AS e
FROM (SELECT {key}, e, sqrt(list_dot_product(e, e)) AS nn FROM (SELECT {key}, [{sums}] AS e FROM {table} JOIN gv USING (gram) GROUP BY ALL))"""


def dense(k: int) -> str:
    """CTEs from those of bm25 to dn(query_id, data_id, rank, score)."""
    return f"""
gv AS (SELECT gram, list_transform(range(1, 33), lambda i: 2 * (position(substring(m, i, 1) IN '0123456789abcdef') - 1) - 15) AS v FROM (SELECT gram, md5(gram) AS m FROM (SELECT gram FROM df UNION SELECT gram FROM qg))),
cv AS ({projected("tf", "data_id, chunk_id", "tf")}),
qv AS ({projected("qg", "query_id", "qn")}),
dp AS (SELECT query_id, data_id, max(list_dot_product(qv.e, cv.e)) AS score FROM qv, cv GROUP BY ALL),
dn AS (SELECT * FROM (SELECT query_id, data_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, data_id) AS rank, score FROM dp) WHERE rank <= {k})"""


SYMPTOM_ONLY = f"chunk AS ({whole(strip('cause'), 'symptom_only')})"
COMBINED_CHUNK = f"chunk AS ({whole(COMBINED, 'combined')})"
SEARCHED = f"""chunk AS (SELECT data_id, 0 AS chunk_id, {strip("coalesce(cause, '') || ' ' || coalesce(symptoms, '')")} AS text FROM rec)"""
def rrf(first: str, second: str, out: str) -> str:
    """The fusion of two lists to five."""
    return f"""
{out}p AS (SELECT query_id, data_id, 0 AS src, rank, 1.0 / (60 + rank) AS part FROM {first} UNION ALL SELECT query_id, data_id, 1, rank, 1.0 / (60 + rank) FROM {second}),
{out}f AS (SELECT query_id, data_id, sum(part) AS score, min((src, rank)) AS seen FROM {out}p GROUP BY ALL),
{out} AS (SELECT * FROM (SELECT query_id, data_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, seen) AS rank, score FROM {out}f) WHERE rank <= 5)"""


RRF = rrf("bm", "ti", "rr")
LABELLED = """
lab AS (SELECT item_id AS case_id, text AS query, coalesce(d, -1) AS expected_data_id,
        CASE WHEN d IS NULL THEN 'negative' WHEN item_id % 2 = 0 THEN 'exact' ELSE 'partial' END AS category
        FROM benchmark LEFT JOIN (SELECT item_id AS i, min(data_id) AS d FROM benchmark JOIN rec ON contains(cause, text) GROUP BY 1) ON i = item_id)"""


def judged(results: str) -> str:
    """From res(chunking, retriever, query_id, data_id, rank, score) to jd, a row a config and case, and met, a row a config."""
    return f"""WITH {RECORDS}, {LABELLED},
res AS ({results}),
jd AS (SELECT c.chunking, c.retriever, l.*, coalesce(min(CASE WHEN r.data_id = expected_data_id THEN rank END), 0) AS rank, max(CASE WHEN rank = 1 THEN r.data_id END) AS got, max(CASE WHEN rank = 1 THEN score END) AS top
       FROM lab l CROSS JOIN (SELECT DISTINCT chunking, retriever FROM res) c LEFT JOIN res r ON r.query_id = l.case_id AND r.retriever = c.retriever AND r.chunking = c.chunking GROUP BY ALL),
met AS (SELECT chunking, retriever,
        round(count(*) FILTER (expected_data_id > 0 AND rank = 1) / greatest(count(*) FILTER (expected_data_id > 0), 1), 4) AS recall_1,
        round(count(*) FILTER (expected_data_id > 0 AND rank BETWEEN 1 AND 3) / greatest(count(*) FILTER (expected_data_id > 0), 1), 4) AS recall_3,
        round(coalesce(avg(CASE WHEN rank > 0 THEN 1 / rank ELSE 0 END) FILTER (expected_data_id >= 0), 0), 4) AS mrr,
        round(min(top) FILTER (expected_data_id >= 0 AND rank = 1) - max(top) FILTER (expected_data_id < 0), 4) AS noise_gap,
        round(coalesce(avg((rank = 1)::INT) FILTER (category = 'exact'), 0), 4) AS cat_exact, round(coalesce(avg((rank = 1)::INT) FILTER (category = 'partial'), 0), 4) AS cat_partial
        FROM jd GROUP BY chunking, retriever)"""


def retrieved(name: str, chunk: str, hybrid: str, with_dense: bool = False) -> str:
    more, lists = "", ""
    if with_dense:
        more = f", {dense(20)}, {rrf('bm', 'dn', 'rd')}"
        lists = " UNION ALL SELECT 'dense', * FROM dn WHERE rank <= 5 UNION ALL SELECT 'hybrid(bm25+dense)', * FROM rd"
    return f"""SELECT '{name}' AS chunking, * FROM (WITH {chunk}, {bm25(20)}, {tfidf(20)}, {RRF}{more}
SELECT 'bm25' AS retriever, * FROM bm WHERE rank <= 5 UNION ALL SELECT 'tfidf', * FROM ti WHERE rank <= 5 UNION ALL SELECT '{hybrid}', * FROM rr{lists})"""


FULL = strip(f"{strip('cause')} || ' ' || {strip('symptoms')} || ' ' || {strip('diagnosis')} || ' ' || {strip('treatment')}")
JUDGED = judged(retrieved("row_symptom_only", SYMPTOM_ONLY, "hybrid"))
SEARCH = f"""WITH {RECORDS}, {SEARCHED}, {tfidf(5)}"""
REGRESSION = f"""WITH {RECORDS}, {SEARCHED}, {tfidf(2)}, {LABELLED},
hit AS (SELECT query_id, rank, symptoms, round(score, 4) AS score FROM ti JOIN rec USING (data_id)),
chk AS (SELECT case_id AS query_id, coalesce(contains(lower(a.symptoms), '#' || (expected_data_id - 1)), false) AS passed, a.score AS top_score,
        CASE WHEN b.score IS NULL THEN 99.0 ELSE round(a.score - b.score, 4) END AS margin
        FROM lab LEFT JOIN hit a ON a.query_id = case_id AND a.rank = 1 LEFT JOIN hit b ON b.query_id = case_id AND b.rank = 2)"""


def draw(tag: str, *keys: str) -> str:
    return f"md5(concat_ws('|', '42', {', '.join(keys)}, '{tag}'))"


def pick(options: list[str], tag: str, *keys: str) -> str:
    return f"[{', '.join(repr(o) for o in options)}][(('0x' || substring({draw(tag, *keys)}, 1, 7))::BIGINT % {len(options)}) + 1]"


def decorate(text: str, *keys: str) -> str:
    return strip(f"({pick(PREFIXES, 'prefix', *keys)} || {text} || {pick(SUFFIXES, 'suffix', *keys)})")


PH = f"WITH {RECORDS}, ph AS (SELECT data_id, unnest(range(len(ps))) AS pos, unnest(ps) AS phrase, len(ps) AS n FROM (SELECT data_id, {PHRASES} AS ps FROM rec))"


def colloquial(terms) -> str:
    text = "phrase"
    for term, variants in terms:
        text = f"replace({text}, '{term}', {pick(variants, term, 'data_id', 'pos')})"
    return text


def prompted(split: str, question: str):
    """For a least similarity, CTEs to pr(session_id, past, n_hits, ms, total_chars): every session's messages, two hits at most."""
    fields = "{'data_id': data_id, 'disease': symptoms, 'symptoms': cause, 'cause': diagnosis, 'treatment': treatment, 'score': round(score, 4)}"
    message = lambda role, content: f"{{'role': '{role}', 'content': {content}}}"

    def run(least: float) -> str:
        return f"""{split}, qs AS (SELECT session_id, system, coalesce({question}, '') AS question FROM s), {REC}, {SEARCHED},
ask AS (SELECT session_id AS query_id, question AS query FROM qs WHERE {strip('question')} <> ''), {tfidf(2)},
ht AS (SELECT query_id AS session_id, count(*) AS n, to_json(list({fields} ORDER BY rank))::VARCHAR AS js FROM ti JOIN rec USING (data_id) WHERE score >= {least} GROUP BY 1),
pp AS (SELECT session_id, turn AS id, role, content AS u, lead(role) OVER w AS nr, lead(content) OVER w AS a FROM t WINDOW w AS (PARTITION BY session_id ORDER BY turn)),
xx AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS back FROM pp WHERE role = 'user' AND nr = 'assistant'),
hs AS (SELECT session_id, count(*) AS past, flatten(list([{message('user', 'u')}, {message('assistant', 'a')}] ORDER BY id)) AS said FROM xx WHERE back <= 20 GROUP BY 1),
pm AS (SELECT session_id, coalesce(past, 0) AS past, coalesce(n, 0) AS n_hits, list_concat([{message('system', f"CASE WHEN system = '' THEN '{DEFAULT_SYSTEM}' ELSE system END || '{HEADER}' || coalesce(js, '{NO_MATCH}')")}],
       coalesce(said, []), [{message('user', strip('question'))}]) AS ms FROM qs LEFT JOIN ht USING (session_id) LEFT JOIN hs USING (session_id)),
pr AS (SELECT *, list_sum(list_transform(ms, lambda m: length(m.content)))::BIGINT AS total_chars FROM pm)"""

    return run


def oracle_sql(synonyms: list, terms: list) -> dict[str, str]:
    ranked = "SELECT query_id, data_id, rank, round(score, 4) AS score FROM"
    turns = "t AS (SELECT conv_id AS session_id, turn, role, text AS content FROM conversations)"
    paired = f"""WITH {turns}, p AS (SELECT session_id, turn AS id, role, content AS u, lead(role) OVER w AS nr, lead(content) OVER w AS a FROM t WINDOW w AS (PARTITION BY session_id ORDER BY turn)),
x AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS back FROM p WHERE role = 'user' AND nr = 'assistant')"""
    split = f"""WITH {turns}, s AS (SELECT session_id, coalesce(string_agg(chr(10) || coalesce(content, ''), '' ORDER BY turn) FILTER (role = 'system'), '') AS system,
  list({{'r': role, 'c': content}} ORDER BY turn) FILTER (role IN ('user', 'assistant')) AS spoken FROM t GROUP BY 1)"""
    question = "CASE WHEN spoken[len(spoken)].r = 'user' THEN coalesce(spoken[len(spoken)].c, '') ELSE '' END"
    cached = "c AS (SELECT DISTINCT sha256(text) AS text_hash FROM documents WHERE doc_id % 2 = 0)"
    incoming = f"""WITH r AS (SELECT p_partkey AS pos, {strip('p_name')} AS disease, {strip('p_type')} AS symptoms, {strip('p_brand')} AS cause, '' AS treatment FROM part WHERE p_partkey >= 20),
g AS (SELECT *, row_number() OVER (PARTITION BY disease ORDER BY pos) AS turn, disease IN (SELECT {strip('p_name')} FROM part WHERE p_partkey < 20) AS known FROM r WHERE disease <> '' AND symptoms <> '')"""
    describe = " UNION ALL ".join(
        f"SELECT '{name}' AS strategy, length(text) AS chars FROM ({sql})"
        for name, sql in (
            ("row_symptom_only", whole(strip("cause"), "x")),
            ("row_combined", whole(COMBINED, "x")),
            ("row_full", whole(strip(f"{strip('cause')} || ' ' || {strip('symptoms')} || ' ' || {strip('diagnosis')} || ' ' || {strip('treatment')}"), "x")),
            ("per_symptom", listed(PHRASES)),
            ("per_symptom_expanded", "SELECT text FROM chunk"),
        )
    )
    every_chunking = {
        "row_symptom_only": SYMPTOM_ONLY,
        "row_combined": COMBINED_CHUNK,
        "row_full": f"chunk AS ({whole(FULL, 'full')})",
        "per_symptom": f"chunk AS ({listed(PHRASES)})",
        "per_symptom_expanded": expanded_rows(synonyms),
    }
    matrix = judged(" UNION ALL ".join(retrieved(name, chunk, "hybrid(bm25+tfidf)", True) for name, chunk in every_chunking.items()))
    config_order = f"list_position({list(every_chunking)}, chunking), list_position(['bm25', 'tfidf', 'hybrid(bm25+tfidf)', 'dense', 'hybrid(bm25+dense)'], retriever)"
    edit = """CASE WHEN length(t) < 3 THEN t ELSE substring(t, 1, at) || CASE kind WHEN 0 THEN substring(t, at + 2, 1)
  WHEN 1 THEN substring(t, at + 1, 1) || substring(t, at + 1, 2) ELSE substring(t, at + 2, 1) || substring(t, at + 1, 1) END || substring(t, at + 3) END"""
    edit = edit.replace("at +", "(('0x' || substring(md5(seed || '|' || i), 1, 7))::BIGINT % greatest(length(t) - 1, 1)) +").replace(
        "1, at)", "1, ('0x' || substring(md5(seed || '|' || i), 1, 7))::BIGINT % greatest(length(t) - 1, 1))"
    ).replace("CASE kind", "CASE ('0x' || substring(md5(seed || '|' || i), 8, 7))::BIGINT % 3")
    unit = """SELECT data_id, gram, w / nd AS w FROM wd JOIN (SELECT data_id, sqrt(sum(w * w)) AS nd FROM wd GROUP BY 1) USING (data_id)"""
    plain = "chunk AS (SELECT data_id, 0 AS chunk_id, coalesce(cause, '') || ' ' || coalesce(symptoms, '') AS text FROM rec)"
    weighed = "wd AS (SELECT data_id, gram, tf * idf AS w FROM wt JOIN voc USING (gram))"
    confusable = f"""WITH {REC}, {plain}, {vocabulary()}, {weighed}, u AS ({unit}),
pair AS (SELECT a.data_id AS a, b.data_id AS b, sum(a.w * b.w) AS similarity FROM u a JOIN u b USING (gram) WHERE a.data_id < b.data_id GROUP BY ALL HAVING sum(a.w * b.w) > 0.45)"""
    own_text = "own AS (SELECT data_id, 0 AS chunk_id, CASE WHEN coalesce(cause, '') = '' THEN symptoms ELSE cause END AS text FROM rec)"
    def self_lists(rec: str) -> str:
        return f"""WITH {rec}, {COMBINED_CHUNK}, {vocabulary()}, {weighed}, d AS ({unit}), {own_text}, wo AS ({wb("own", "data_id, chunk_id", "text")}),
q AS (SELECT data_id AS query_id, gram, tf * idf AS v FROM wo JOIN voc USING (gram)), nq AS (SELECT query_id, sqrt(sum(v * v)) AS nq FROM q GROUP BY 1),
sc AS (SELECT query_id, data_id, any_value(dot) / any_value(nq) AS score FROM (SELECT query_id, data_id, sum(v * w) AS dot FROM q JOIN d USING (gram) GROUP BY ALL) JOIN nq USING (query_id) GROUP BY ALL),
pd AS (SELECT own.data_id AS query_id, c.data_id, 0.0::DOUBLE AS score FROM own, (SELECT data_id FROM chunk ORDER BY data_id LIMIT 3) c ANTI JOIN sc ON sc.query_id = own.data_id AND sc.data_id = c.data_id),
sl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, data_id) AS rank FROM (SELECT * FROM sc UNION ALL SELECT * FROM pd)) WHERE rank <= 3)"""

    half_blank = """
rec AS (SELECT doc_id + 1 AS data_id, CASE WHEN doc_id % 2 = 0 THEN concat(lang, ' ', source, ' #', doc_id) END AS symptoms, CASE WHEN doc_id % 2 = 0 THEN text END AS cause FROM documents)"""
    magnets = "SELECT data_id, count(*) AS n FROM sl GROUP BY 1 HAVING count(*) > greatest(3, 0.25 * (SELECT count(*) FROM rec))"
    prompts = prompted(split, question)
    def dense_lists(asked: str) -> str:
        return f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS data_id, list_dot_product(q.e, d.e) AS score FROM v q, v d{asked})
SELECT query_id, data_id, rank, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, data_id) AS rank FROM s) WHERE rank <= 5"""

    found = {
        "bm25_topk": f"WITH {RECORDS}, {SYMPTOM_ONLY}, {bm25(5)} {ranked} bm",
        "bm25_phrases_topk": f"WITH {RECORDS}, {expanded_rows(synonyms)}, {bm25(5)} {ranked} bm",
        "tfidf_topk": f"WITH {RECORDS}, {COMBINED_CHUNK}, {tfidf(5)} {ranked} ti",
        "rrf_topk": f"WITH {RECORDS}, {SYMPTOM_ONLY}, {bm25(20)}, {tfidf(20)}, {RRF} SELECT query_id, data_id, rank, round(score, 6) AS score FROM rr",
        "dense_topk": dense_lists(""),
        "index_search": f"{SEARCH} {ranked} ti",
        "index_search_bm25": f"WITH {RECORDS}, {SEARCHED}, {bm25(5)} {ranked} bm",
        "search_hits": f"{SEARCH} SELECT query_id, rank, data_id, symptoms AS disease, cause AS symptoms, diagnosis AS cause, treatment, round(score, 4) AS score FROM ti JOIN rec USING (data_id) WHERE score >= 0",
        "search_hit_counts": f"{SEARCH} SELECT query_id, count(*) FILTER (score >= 0.19) AS hits FROM ask LEFT JOIN ti USING (query_id) GROUP BY 1",
        "chunks_row_symptom_only": f"WITH {RECORDS} {whole(strip('cause'), 'symptom_only')}",
        "chunks_row_combined": f"WITH {RECORDS} {whole(COMBINED, 'combined')}",
        "chunks_row_full": f"WITH {RECORDS} "
        + whole(strip(f"{strip('cause')} || ' ' || {strip('symptoms')} || ' ' || {strip('diagnosis')} || ' ' || {strip('treatment')}"), "full"),
        "chunks_per_symptom": f"WITH {RECORDS} {listed(PHRASES)}",
        "chunks_per_symptom_expanded": f"WITH {RECORDS}, {expanded_rows(synonyms)} SELECT * FROM chunk",
        "chunk_describe": f"""WITH {RECORDS}, {expanded_rows(synonyms)}, e AS ({describe})
SELECT strategy, count(*) AS chunks, round(count(*) / greatest((SELECT count(*) FROM rec), 1), 2) AS chunks_per_row, round(avg(chars), 1) AS avg_chars, min(chars) AS min_chars, max(chars) AS max_chars FROM e GROUP BY 1""",
        "phrase_rewordings": f"""WITH {RECORDS}, p AS (SELECT DISTINCT unnest({PHRASES}) AS phrase FROM rec)
SELECT phrase, -1 AS ord, 0 AS variant_ord, phrase AS variant FROM p """
        + " ".join(
            f"UNION ALL SELECT phrase, {i}, {j}, replace(phrase, '{t}', '{v}') FROM p WHERE contains(phrase, '{t}')" for i, (t, vs) in enumerate(synonyms) for j, v in enumerate(vs)
        ),
        "gram_stats": f"WITH {RECORDS}, {SYMPTOM_ONLY}, {bm25(5)} SELECT gram, df, round(greatest(ln((n - df + 0.5) / (df + 0.5) + 1.0), 0), 6) AS idf, n, round(avg_len, 4) AS avg_len FROM df, st",
        "tfidf_vocabulary": f"WITH {RECORDS}, {COMBINED_CHUNK}, {vocabulary()} SELECT gram, df, round(idf, 6) AS idf FROM voc",
        "tfidf_vectors": f"""WITH {RECORDS}, {COMBINED_CHUNK}, {tfidf(5)} SELECT data_id, count(*) AS grams, round(sum(w / nd), 6) AS weight, round(sum(w / nd * w / nd), 6) AS norm
FROM wd JOIN nd USING (data_id, chunk_id) GROUP BY 1""",
        "eval_metrics": f"{JUDGED} SELECT * FROM met",
        "eval_failures": f"{JUDGED} SELECT retriever, category, query, expected_data_id AS expected, got, rank FROM jd WHERE expected_data_id >= 0 AND rank <> 1",
        "eval_by_category": f"{JUDGED} SELECT retriever, category, round(avg((rank = 1)::INT), 6) AS accuracy FROM jd WHERE expected_data_id >= 0 GROUP BY 1, 2",
        "eval_matrix": f"{matrix} SELECT * FROM met",
        "eval_latency": "SELECT 'row_combined' AS chunking, unnest(['bm25', 'tfidf', 'hybrid(bm25+tfidf)', 'dense', 'hybrid(bm25+dense)']) AS retriever, true AS measured",
        "eval_best": f"{matrix} SELECT chunking, retriever, recall_1, mrr FROM met ORDER BY recall_1 DESC, mrr DESC, {config_order} LIMIT 1",
        "eval_recommended": f"""{matrix}, base AS (SELECT recall_1 AS base_recall_1 FROM met WHERE chunking = 'row_combined' AND retriever = 'tfidf'),
good AS (SELECT * FROM met WHERE noise_gap > 0 ORDER BY recall_1 DESC, mrr DESC, {config_order} LIMIT 1)
SELECT chunking, retriever, recall_1, mrr, noise_gap, base_recall_1, round(recall_1 - base_recall_1, 4) AS gain FROM good LEFT JOIN base ON true""",
        "eval_weakest": f"""{matrix}, a AS (SELECT chunking, retriever, category, avg((rank = 1)::INT) AS accuracy FROM jd WHERE expected_data_id >= 0 GROUP BY 1, 2, 3)
SELECT category, round(min(accuracy), 6) AS worst, round(max(accuracy), 6) AS best, max(accuracy) < 0.8 AS flagged FROM a GROUP BY 1 ORDER BY min(accuracy), category LIMIT 1""",
        "thin_records": f"WITH {RECORDS} SELECT data_id, length({strip('cause')}) AS chars FROM rec WHERE length({strip('cause')}) < 20",
        "few_phrases": f"WITH {RECORDS} SELECT data_id, len({PHRASES}) AS phrases FROM rec WHERE len({PHRASES}) < 3",
        "confusable_pairs": f"{confusable} SELECT a, b, round(similarity, 4) AS similarity FROM pair",
        "self_retrieval": f"{self_lists(REC)} SELECT query_id AS data_id, data_id AS found FROM sl WHERE rank = 1 AND data_id <> query_id",
        "magnets": f"{self_lists(REC)} {magnets}",
        "magnets_padded": f"{self_lists(half_blank)} {magnets}",
        "issue_total": f"""SELECT (SELECT count(*) FROM ({confusable} SELECT a FROM pair)) + (SELECT count(*) FROM ({self_lists(REC)} SELECT query_id FROM sl WHERE rank = 1 AND data_id <> query_id))
  + (SELECT count(*) FROM (WITH {REC} SELECT data_id FROM rec WHERE length({strip('cause')}) < 20)) AS issues""",
        "threshold_tuned": f"""{REGRESSION}, e AS (SELECT (SELECT min(top_score) FROM chk WHERE passed) AS low, coalesce((SELECT max(hit.score) FROM hit JOIN lab ON case_id = query_id WHERE expected_data_id < 0 AND rank = 1), 0) AS noise)
SELECT CASE WHEN low > noise THEN round((low + noise) / 2, 2) ELSE round(noise + 0.01, 2) END AS least, coalesce(low > noise, false) AS apart FROM e""",
        "index_search_updated": f"{SEARCH} {ranked} ti",
        "index_search_dense": f"WITH {RECORDS}, {SEARCHED}, {bm25(5)}, {dense(5)} {ranked} dn",
        "index_staleness": """SELECT c AS check, c <> 'same' AND (c <> 'fewer' OR (SELECT count(*) FROM documents WHERE lang = 'en') < (SELECT count(*) FROM documents)) AS stale,
  (SELECT count(*) FROM documents) AS records FROM (SELECT unnest(['missing', 'same', 'fewer', 'backend']) AS c)""",
        "names_kept": f"WITH {REC} SELECT data_id, symptoms, md5(cause) AS cause_md5, diagnosis, treatment FROM rec",
        "encodable_texts": f"WITH {turns} SELECT session_id, turn, CASE WHEN turn % 3 = 0 OR {strip('content')} = '' THEN 1 ELSE length(content) END AS chars FROM t",
        "testset_read": f"WITH {RECORDS} SELECT {strip('cause')} AS query, data_id AS expected_data_id, 'exact' AS category FROM rec WHERE {strip('cause')} <> ''",
        "regression_read": f"SELECT {strip('text')} AS query, '#' || item_id AS expected_disease_contains, 'from benchmark' AS note FROM benchmark WHERE {strip('text')} <> ''",
        "records_csv_read": "SELECT p_name AS disease, p_type AS symptoms, p_brand AS cause FROM part WHERE p_partkey >= 20",
        "records_json_read": "SELECT p_name AS disease, p_type AS symptoms, p_brand AS cause FROM part WHERE p_partkey >= 20",
        "records_stored": f"""WITH r AS (SELECT p_partkey AS pos, {strip('p_name')} AS disease FROM part WHERE p_partkey >= 20 AND {strip('p_name')} <> '' AND {strip('p_type')} <> ''),
a AS (SELECT row_number() OVER (ORDER BY min(pos)) AS data_id, disease FROM r WHERE pos % 2 = 0 GROUP BY disease), kept AS (SELECT * FROM a WHERE data_id < (SELECT max(data_id) FROM a)),
b AS (SELECT (SELECT max(data_id) FROM a) + row_number() OVER (ORDER BY min(pos)) AS data_id, disease FROM r WHERE pos % 2 = 1 AND disease NOT IN (SELECT disease FROM kept) GROUP BY disease)
SELECT * FROM kept UNION ALL SELECT * FROM b""",
        "seeded": f"WITH {REC} SELECT row_number() OVER (ORDER BY symptoms) AS data_id, symptoms, diagnosis, treatment FROM rec",
        "run_results": f"""WITH {RECORDS}, f AS (SELECT len({PHRASES}) AS phrases FROM rec WHERE len({PHRASES}) < 3), r AS (SELECT unnest(['r1', 'r2']) AS run_id)
SELECT 'results' AS kind, run_id, count(*) AS n FROM f, r GROUP BY 2 UNION ALL SELECT 'failures', run_id, count(*) FROM f, r WHERE phrases = 0 GROUP BY 2""",
        "cache_stored": f"""WITH {cached}, n AS (SELECT DISTINCT sha256(text) AS text_hash FROM documents WHERE doc_id % 3 = 0),
m AS (SELECT 'm1' AS model, 1 AS dim, count(*) AS n FROM c WHERE text_hash NOT IN (SELECT text_hash FROM n) UNION ALL SELECT 'm1', 2, count(*) FROM n)
SELECT *, false AS cleared FROM m UNION ALL SELECT 'm2', 1, count(*), false FROM c UNION ALL SELECT *, true FROM m""",
        "self_found": f"""{incoming}, rec AS (SELECT 1000 + row_number() OVER (ORDER BY pos) AS data_id, disease AS symptoms, symptoms AS cause FROM g WHERE turn = 1 AND NOT known), {SEARCHED},
ask AS (SELECT data_id AS query_id, cause AS query FROM rec), {tfidf(1)}
SELECT r.data_id, coalesce(f.symptoms, '') = r.symptoms AS passed FROM rec r LEFT JOIN ti ON ti.query_id = r.data_id LEFT JOIN rec f ON f.data_id = ti.data_id""",
        "prompt_stats": f"{prompts(0.0)} SELECT session_id, past AS history_turns, n_hits, total_chars FROM pr",
        "batch_prompts": f"""{prompts(0.19)} SELECT session_id, (unnest(range(len(ms))))::INT AS index, unnest(list_transform(ms, lambda m: m.role)) AS role,
  unnest(list_transform(ms, lambda m: length(m.content)))::INT AS chars, unnest(list_transform(ms, lambda m: m.content)) AS content FROM pr""",
        "cache_missing": f"WITH {cached} SELECT DISTINCT sha256(text) AS text_hash FROM documents WHERE sha256(text) NOT IN (SELECT text_hash FROM c)",
        "cache_counts": f"WITH {cached} SELECT count(c.text_hash) AS n_from_cache, count(*) - count(c.text_hash) AS n_embedded FROM documents d LEFT JOIN c ON c.text_hash = sha256(d.text)",
        "cache_lookup": f"WITH {cached} SELECT doc_id, sha256(text) AS text_hash, c.text_hash IS NOT NULL AS cached FROM documents d LEFT JOIN c ON c.text_hash = sha256(d.text)",
        "cache_upserted": f"""WITH {cached}, n AS (SELECT DISTINCT sha256(text) AS text_hash FROM documents WHERE doc_id % 3 = 0)
SELECT 'm1' AS model, 1 AS dim, count(*) AS n FROM c WHERE text_hash NOT IN (SELECT text_hash FROM n) UNION ALL SELECT 'm1', 2, count(*) FROM n""",
        "assign_ids": "SELECT 5000 + row_number() OVER (ORDER BY doc_id DESC) AS data_id, doc_id, lang, source, md5(text) AS text_md5 FROM documents",
        "ingest_new": f"{incoming} SELECT 1000 + row_number() OVER (ORDER BY pos) AS data_id, pos, disease, symptoms, cause, treatment FROM g WHERE turn = 1 AND NOT known",
        "ingest_skipped": f"{incoming} SELECT pos, disease FROM g WHERE turn > 1 OR known",
        "ingest_rejected": f"""SELECT * FROM (SELECT p_partkey AS pos, CASE WHEN p_partkey % 7 <> 0 THEN {strip('p_name')} WHEN p_partkey % 11 = 0 THEN '' ELSE {strip('p_type')} END AS disease,
  CASE WHEN p_partkey % 7 = 0 THEN {strip('p_brand')} WHEN p_partkey % 11 = 0 THEN '' ELSE {strip('p_type')} END AS symptoms FROM part WHERE p_partkey >= 20) WHERE disease = '' OR symptoms = ''""",
        "dangling_hits": f"SELECT query_id, data_id, rank FROM ({dense_lists(" WHERE q.vec_id % 50 = 0")}) WHERE data_id NOT IN (SELECT doc_id + 1 FROM documents WHERE source <> 'web')",
        "unit_vectors": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)
SELECT vec_id, round(e[1] / sqrt(list_dot_product(e, e)), 6) AS first, round(list_dot_product(e, e) / list_dot_product(e, e), 6) AS norm FROM v""",
        "cache_stats": f"WITH {cached} SELECT 'm1' AS model, count(*) AS n FROM c",
        "exchanges_appended": f"{paired} SELECT 100 + row_number() OVER (ORDER BY session_id, id) AS id, session_id, u AS user_message, a AS ai_response FROM x",
        "recent_history": f"{paired} SELECT session_id, count(*) AS turns, string_agg(u || ' => ' || a, chr(10) ORDER BY id) AS history FROM x WHERE back <= 2 GROUP BY 1",
        "last_question": f"""{split} SELECT session_id, system, coalesce({question}, '') AS question,
  coalesce(array_to_string(list_transform(spoken[1:len(spoken) - 1], lambda x: coalesce(x.c, '')), chr(10)), '') AS earlier FROM s""",
        "earlier_parts": f"""{split} SELECT session_id, part, len(said)::BIGINT AS turns, array_to_string(list_transform(said, lambda x: coalesce(x.c, '')), chr(10)) AS text
FROM (SELECT session_id, part, spoken[2 * part + 1:least(2 * part + 2, len(spoken) - 1)] AS said FROM (SELECT session_id, spoken, unnest(range(len(spoken) // 2)) AS part FROM s))""",
        "testset_exact": f"WITH {RECORDS} SELECT {strip('cause')} AS query, data_id AS expected_data_id, 'exact' AS category, symptoms AS note FROM rec",
        "testset_single": f"""{PH}, d AS (SELECT *, row_number() OVER (PARTITION BY data_id ORDER BY {draw('single', 'data_id', 'pos')}, pos) AS turn FROM ph)
SELECT {decorate('phrase', 'data_id', 'pos')} AS query, data_id AS expected_data_id, 'single' AS category, phrase AS note FROM d WHERE turn <= 3""",
        "testset_partial": f"""{PH}, d AS (SELECT *, row_number() OVER (PARTITION BY data_id ORDER BY {draw('partial', 'data_id', 'pos')}, pos) AS turn FROM ph WHERE n >= 3),
j AS (SELECT data_id, string_agg(phrase, ' ' ORDER BY turn) AS t FROM d WHERE turn <= 3 GROUP BY 1)
SELECT {decorate('t', 'data_id', "'partial'")} AS query, data_id AS expected_data_id, 'partial' AS category, '' AS note FROM j""",
        "testset_colloquial": f"""{PH}, c AS (SELECT *, {colloquial(terms)} AS casual FROM ph)
SELECT {decorate('casual', 'data_id', 'pos', "'c'")} AS query, data_id AS expected_data_id, 'colloquial' AS category, 'from: ' || phrase AS note FROM c WHERE casual <> phrase""",
        "testset_typo": f"""{PH}, d AS (SELECT *, row_number() OVER (PARTITION BY data_id ORDER BY {draw('typo', 'data_id', 'pos')}, pos) AS turn FROM ph),
one AS (SELECT *, {draw('noise', 'data_id', 'pos')} AS seed FROM d WHERE turn = 1),
e AS (SELECT *, list_reduce(list_transform(range(1, greatest(1, floor(length(phrase) * 0.08::DOUBLE)::BIGINT) + 1), lambda i: i::VARCHAR), lambda t, i: {edit}, phrase) AS noisy FROM one)
SELECT {decorate('noisy', 'data_id', 'pos', "'t'")} AS query, data_id AS expected_data_id, 'typo' AS category, phrase AS note FROM e""",
        "testset_counts": f"""{PH}, t AS (SELECT data_id, count(*) AS k FROM ph GROUP BY 1),
c AS (SELECT 'exact' AS category, count(*) AS n FROM rec WHERE {strip('cause')} <> '' UNION ALL SELECT 'single', sum(least(k, 3)) FROM t UNION ALL SELECT 'partial', count(*) FROM t WHERE k >= 3
  UNION ALL SELECT 'colloquial', count(*) FROM ph WHERE {colloquial(COLLOQUIAL)} <> phrase UNION ALL SELECT 'typo', count(*) FROM t UNION ALL SELECT 'negative', {len(NEGATIVES)})
SELECT category, n::BIGINT AS n FROM c WHERE n > 0""",
        "regression_check": f"{REGRESSION} SELECT *, passed AND margin < 0.05 AS fragile, passed AND top_score < 0.19 AS filtered FROM chk",
        "accuracy_summary": f"""{REGRESSION} SELECT count(*) FILTER (passed) AS passed, count(*) AS total, min(top_score) FILTER (passed) AS lowest, max(top_score) FILTER (passed) AS highest FROM chk""",
        "noise_floor": f"{REGRESSION} SELECT max(hit.score) AS noise, first(lab.query ORDER BY hit.score DESC, case_id) AS query FROM hit JOIN lab ON case_id = query_id WHERE expected_data_id < 0 AND rank = 1",
    }
    report = {
        "'thin'": f"SELECT chars AS value FROM ({found['thin_records']})",
        "'few_phrases'": f"SELECT phrases AS value FROM ({found['few_phrases']})",
        "'confusable'": f"{confusable} SELECT similarity AS value FROM pair",
        "'self_retrieval'": f"SELECT 1 AS value FROM ({found['self_retrieval']})",
        "'magnet'": f"SELECT n AS value FROM ({found['magnets']})",
        "'chunks:' || strategy": f"SELECT strategy, chunks AS value FROM ({found['chunk_describe']})",
    }
    every = " UNION ALL ".join(f"SELECT {check} AS check_, value::DOUBLE AS value FROM ({sql})" for check, sql in report.items())
    found["health_report"] = f'SELECT check_ AS "check", count(*) AS n, round(sum(value), 3) AS total FROM ({every}) GROUP BY 1'
    return found
