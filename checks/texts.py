"""Text knowledge checks over documents, pages, embeddings and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.cleaning import strip
from checks.common import AS_OF, quoted, table, union_all
from checks.profiling import PROFILE_KINDS, PROFILE_SOURCE, dirty_orders, profile_sql
from tablewright.functions import constants as C
from tablewright.operators import text as G
from tablewright.operators.profile import measure
from tablewright.operators.quality import quality_score

QUERIES, ORACLES = {}, {}


def page_text_sql() -> str:
    """Pages taken apart into tokens by row, what is hidden told by a running count of open elements."""
    open_, shut = (", ".join(f"'{slash}{e}'" for e in G.DROPPED_ELEMENTS) for slash in ("", "/"))
    whole = " OR ".join(f"regexp_matches(t, '(?is)^<{e}\\b.*</{e}\\s*>$')" for e in G.RAW_ELEMENTS)
    text = lambda x: x.replace("\n", "\\n")
    marks = " ".join(f"WHEN '{e}' THEN E'{text(a)}' WHEN '/{e}' THEN E'{text(z)}'" for e, (a, z) in G.TAG_MARKS.items())
    return f"""WITH tokens AS (SELECT page_id, unnest(list) AS t, generate_subscripts(list, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, {quoted(G.PAGE_TOKENS)}) AS list FROM pages)),
named AS (SELECT *, t[1] = '<' AND length(t) > 1 AS tag, lower(regexp_extract(t, {quoted(G.TAG_NAME)}, 1)) AS name, {whole} AS whole FROM tokens),
stepped AS (SELECT *, CASE WHEN NOT tag OR whole THEN 0 WHEN name IN ({open_}) THEN 1 WHEN name IN ({shut}) THEN -1 ELSE 0 END AS step FROM named),
summed AS (SELECT *, sum(step) OVER (PARTITION BY page_id ORDER BY i) AS s FROM stepped),
shown AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY page_id ORDER BY i)) AS hidden FROM summed),
joined AS (SELECT page_id, string_agg(CASE WHEN NOT tag THEN t WHEN whole THEN '' ELSE CASE name {marks} ELSE ' ' END END, '' ORDER BY i) AS x FROM shown WHERE hidden = 0 AND step = 0 GROUP BY page_id)
SELECT pages.page_id, {strip("regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(x, ''), '\n{3,}', E'\n\n', 'g'), ' {2,}', ' ', 'g'), '&nbsp;', ' ', 'g'), '&[a-z]+;', '', 'g')")} AS text FROM pages LEFT JOIN joined ON joined.page_id = pages.page_id"""


def page_text(s, d):
    return table(s, d, "pages").select("page_id", G.html_to_text(F.col("html")).alias("text"))


PAGE_TEXT = f"({page_text_sql()})"
QUERIES["g1_html_to_text"] = page_text
ORACLES["g1_html_to_text"] = PAGE_TEXT[1:-1]


def chunks_sql(id, source):
    words = f"list_filter(string_split_regex(s, {quoted(C.SPACE + '+')}), lambda w: w <> '')"
    return f"""SELECT {id}, CAST(row_number() OVER (PARTITION BY {id} ORDER BY i, j) - 1 AS INTEGER) AS chunk_index, chunk FROM (
SELECT {id}, i, 0 AS j, s AS chunk FROM sections WHERE length(s) <= 1500
UNION ALL SELECT {id}, i, j, chunk FROM (SELECT {id}, i, j, array_to_string(w[j + 1 : j + 300], ' ') AS chunk FROM (SELECT {id}, i, w, unnest(range(0, len(w), 260)) AS j FROM (
SELECT {id}, i, {words} AS w FROM sections WHERE length(s) > 1500))) WHERE length(chunk) > 50)"""


def sections_sql(id, source):
    return f"""sections AS (SELECT {id}, i, {strip('part')} AS s FROM (SELECT {id}, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM (SELECT {id}, string_split_regex(text, '\\n##\\s+') AS parts FROM {source}))
WHERE length({strip('part')}) >= 50)"""


QUERIES["g2_chunk_documents"] = lambda s, d: G.chunk_text(table(s, d, "documents"), "doc_id", "text")
ORACLES["g2_chunk_documents"] = f"WITH {sections_sql('doc_id', 'documents')} {chunks_sql('doc_id', 'documents')}"
QUERIES["g2_chunk_pages"] = lambda s, d: G.chunk_text(page_text(s, d), "page_id", "text")
ORACLES["g2_chunk_pages"] = f"WITH {sections_sql('page_id', PAGE_TEXT)} {chunks_sql('page_id', PAGE_TEXT)}"
QUERIES["g3_markdown_sections"] = lambda s, d: G.markdown_sections(page_text(s, d), "page_id", "text")
_HEADING = "regexp_replace(string_split(piece, E'\\n')[1], '^[# ]+|[# ]+$', '', 'g')"
ORACLES["g3_markdown_sections"] = f"""SELECT page_id, section_index, title, concat(title, E'\\n', body) AS chunk FROM (
SELECT page_id, CAST(i - 1 AS INTEGER) AS section_index, CASE WHEN i = 1 THEN 'document' WHEN {strip(_HEADING)} = '' THEN 'section' ELSE {strip(_HEADING)} END AS title,
{strip("CASE WHEN i = 1 THEN piece WHEN contains(piece, E'\\n') THEN regexp_replace(piece, '^[^\\n]*\\n', '') ELSE '' END")} AS body
FROM (SELECT page_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i FROM (SELECT page_id, string_split(concat(E'\\n', replace(replace(text, E'\\r\\n', E'\\n'), E'\\r', E'\\n')), E'\\n#') AS pieces FROM {PAGE_TEXT}))) WHERE length(body) >= 40"""


def nested(s, d):
    docs = table(s, d, "documents").select("doc_id", F.to_json(F.struct(
        "text", "lang", F.array(F.col("source"), F.concat(F.lit("lang-"), "lang")).alias("tags"),
        F.struct(F.concat(F.lit("kept in "), "source", F.lit(" for later reading")).alias("where"), F.col("n_chars")).alias("meta"))).alias("payload"))
    return G.json_to_chunks(docs, "doc_id", "payload")


QUERIES["g4_json_to_chunks"] = nested
ORACLES["g4_json_to_chunks"] = """SELECT doc_id, path, chunk FROM (
SELECT doc_id, '/' AS path, concat(CASE WHEN length(text) > 10 THEN concat('text: ', text, E'\\n') ELSE '' END, 'tags: ', source, ', lang-', lang) AS chunk FROM documents
UNION ALL SELECT doc_id, '.meta', concat('where: kept in ', source, ' for later reading') FROM documents) WHERE length(chunk) > 30"""


def deep(s, d):
    """Documents under twelve levels of objects and lists, with text on the way."""
    body = F.struct(F.lit("at the bottom of it all").alias("note"), "text")
    for level in range(11, 0, -1):
        inner = F.array(body) if level % 3 == 0 else body
        body = F.struct(F.concat(F.lit(f"level {level} of the way down in "), "source").alias("where"), F.lit(level).alias("n"), inner.alias("next"))
    return G.json_to_chunks(table(s, d, "documents").select("doc_id", F.to_json(body).alias("payload")), "doc_id", "payload")


QUERIES["g4_json_of_twelve_levels"] = deep
_DEEP = [("".join(".next[0]" if k % 3 == 0 else ".next" for k in range(1, level)) or "/", level) for level in range(1, 13)]
ORACLES["g4_json_of_twelve_levels"] = union_all([f"SELECT doc_id, '{path}' AS path, concat('where: level {level} of the way down in ', source) AS chunk FROM documents" for path, level in _DEEP[:-1]] + [
    f"SELECT doc_id, '{_DEEP[-1][0]}' AS path, concat('note: at the bottom of it all', CASE WHEN length(text) > 10 THEN concat(E'\\ntext: ', text) ELSE '' END) AS chunk FROM documents WHERE length(text) > 10"])
_RECORDS = """(SELECT u.conv_id, u.turn, coalesce(s.text, '') AS instruction, u.text AS input, a.text AS output FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
LEFT JOIN (SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'system' GROUP BY 1) s ON s.conv_id = u.conv_id WHERE u.role = 'user')"""


def records(s, d):
    return G.exchange_records(table(s, d, "conversations"))


QUERIES["g5_instruction_records"] = lambda s, d: records(s, d).select("conv_id", "turn", G.instruction_text(F.col("instruction"), F.col("input"), F.col("output")).alias("text"))
ORACLES["g5_instruction_records"] = f"SELECT conv_id, turn, concat('INSTRUCTION: ', instruction, E'\\nINPUT: ', input, E'\\nOUTPUT: ', output) AS text FROM {_RECORDS}"
QUERIES["g6_chunk_ids"] = lambda s, d: G.chunk_ids(G.chunk_text(table(s, d, "documents"), "doc_id", "text"), "chunk", ["doc_id", "chunk_index"])
ORACLES["g6_chunk_ids"] = f"""WITH {sections_sql('doc_id', 'documents')}, c AS ({chunks_sql('doc_id', 'documents')})
SELECT md5(chunk) AS chunk_id, min((doc_id, chunk_index))[1] AS doc_id, min((doc_id, chunk_index))[2] AS chunk_index, count(*) AS copies FROM c GROUP BY 1"""
QUERIES["g6_positional_ids"] = lambda s, d: table(s, d, "documents").select("doc_id", G.positional_id(F.col("source"), F.md5("text"), F.col("doc_id"), F.col("text")).alias("chunk_id"))
ORACLES["g6_positional_ids"] = "SELECT doc_id, md5(concat(source, ':', md5(text), ':', doc_id, ':', left(text, 80))) AS chunk_id FROM documents"
_MANIFEST = ("SELECT CASE WHEN page_id % 7 = 0 THEN concat('old/', url) ELSE url END AS source, CASE WHEN page_id % 5 = 1 THEN md5(concat(html, 'x')) ELSE md5(html) END AS content_hash "
             "FROM pages WHERE page_id % 5 <> 0")


def manifest(s, d):
    table(s, d, "pages").createOrReplaceTempView("pages_now")
    return s.sql(_MANIFEST.replace("FROM pages", "FROM pages_now"))


QUERIES["g7_delta_status"] = lambda s, d: G.delta_status(manifest(s, d), table(s, d, "pages").select(F.col("url").alias("source"), F.md5("html").alias("content_hash")))
_STATUS = f"""SELECT coalesce(o.source, n.source) AS source, CASE WHEN n.source IS NULL THEN 'removed' WHEN o.source IS NULL THEN 'new' WHEN o.content_hash = n.content_hash THEN 'unchanged' ELSE 'changed' END AS status
FROM ({_MANIFEST}) o FULL JOIN (SELECT url AS source, md5(html) AS content_hash FROM pages) n ON o.source = n.source"""
ORACLES["g7_delta_status"] = _STATUS


def ingested(s, d):
    pages = table(s, d, "pages")
    status = G.delta_status(manifest(s, d), pages.select(F.col("url").alias("source"), F.md5("html").alias("content_hash")))
    chunks = G.chunk_text(page_text(s, d), "page_id", "text").join(pages.select("page_id", F.col("url").alias("source")), "page_id").select(
        "source", "chunk_index", F.md5("chunk").alias("chunk_id"))
    index = manifest(s, d).select("source", F.lit(0).alias("chunk_index"), F.col("content_hash").alias("chunk_id"))
    return G.delta_ingest(index, chunks, status)


QUERIES["g7_delta_ingest"] = ingested
ORACLES["g7_delta_ingest"] = f"""WITH {sections_sql('page_id', PAGE_TEXT)}, c AS ({chunks_sql('page_id', PAGE_TEXT)}), st AS ({_STATUS})
SELECT m.source, CAST(0 AS INTEGER) AS chunk_index, m.content_hash AS chunk_id FROM ({_MANIFEST}) m JOIN st USING (source) WHERE status = 'unchanged'
UNION ALL SELECT url AS source, chunk_index, md5(chunk) FROM c JOIN pages USING (page_id) JOIN st ON st.source = url WHERE status IN ('changed', 'new')"""
QUERIES["g8_filter_short_chunks"] = lambda s, d: G.filter_short_chunks(
    table(s, d, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("source")), "text", 200,
    {"source": "manual", "type": "knowledge"})
ORACLES["g8_filter_short_chunks"] = "SELECT doc_id, text, CASE WHEN doc_id % 3 > 0 THEN source ELSE 'manual' END AS source, 'knowledge' AS type FROM documents WHERE length(text) >= 200"


def nearest(s, d, k=5, metadata=None):
    vectors = table(s, d, "embeddings")
    return G.vector_top_k(vectors, "vec_id", "embedding", G.centroids(vectors, "label", "embedding"), k, metadata=metadata)


_MEANS = "(SELECT label AS q, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1)"


def nearest_sql(k, condition="true"):
    return f"""SELECT CAST(q AS VARCHAR) AS query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(dist, 6) AS distance, round(greatest(0, 1 - dist), 3) AS relevance FROM (
SELECT q, vec_id, dist, row_number() OVER (PARTITION BY q ORDER BY dist, vec_id) AS rank FROM (
SELECT q, vec_id, list_sum(list_transform(range(1, 65), lambda i: (embedding[i] - c[i]) * (embedding[i] - c[i]))) AS dist FROM embeddings, {_MEANS} WHERE {condition})) WHERE rank <= {k}"""


QUERIES["g9_vector_top_k"] = lambda s, d: nearest(s, d).withColumn("distance", F.round("distance", 6))
ORACLES["g9_vector_top_k"] = nearest_sql(5)
QUERIES["g9_vector_top_k_filtered"] = lambda s, d: nearest(s, d, 3, F.col("label") == 4).withColumn("distance", F.round("distance", 6))
ORACLES["g9_vector_top_k_filtered"] = nearest_sql(3, "label = 4")


def contexts(s, d):
    texts = table(s, d, "documents").select(F.col("doc_id").alias("vec_id"), "text", "source")
    return G.context_assembly(nearest(s, d, 3, F.col("label") == 4), nearest(s, d), texts, "vec_id", "text", "source")


QUERIES["g10_context_assembly"] = contexts
ORACLES["g10_context_assembly"] = f"""WITH h AS (SELECT *, 0 AS part FROM ({nearest_sql(3, 'label = 4')}) UNION ALL SELECT *, 1 FROM ({nearest_sql(5)}))
SELECT query_id, count(*) AS hits, string_agg(CASE WHEN part = 0 THEN concat('**[Dataset]** ', text) ELSE concat('### Source ', rank, ' (', source, ') relevance ', relevance, E'\\n', text) END, E'\\n' ORDER BY part, rank) AS context
FROM h JOIN documents ON doc_id = vec_id GROUP BY query_id"""


def described(s, d):
    p = measure(dirty_orders(s, d, *PROFILE_KINDS))
    return G.profile_documents(p, quality_score(p, AS_OF))


QUERIES["g11_profile_to_documents"] = described
_TOPS = union_all([f"SELECT '{c}' AS column_name, concat('Top values: ', string_agg(concat(value, '(', n, ')'), ', ' ORDER BY n DESC, value)) AS tops FROM "
                   f"(SELECT {c} AS value, count(*) AS n FROM {PROFILE_SOURCE} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, value LIMIT 5)" for c, k in PROFILE_KINDS.items() if k == "text"])
QUERIES["g11_column_documents"] = lambda s, d: described(s, d).filter("doc LIKE 'column %' OR doc LIKE 'gap %'")
ORACLES["g11_column_documents"] = f"""WITH p AS ({profile_sql(PROFILE_KINDS, PROFILE_SOURCE)}), t AS ({_TOPS})
SELECT concat('column ', column_name) AS doc, concat_ws(E'\\n', concat('Column: ', column_name), concat('Type: ', kind), concat('Missing: ', missing_pct, '%'), concat('Unique values: ', "distinct", ' (', cardinality, ')'),
CASE WHEN mean IS NOT NULL THEN concat('Stats: mean=', mean, ', median=', median, ', std=', std, ', min=', min, ', max=', max) END, tops, CASE WHEN distribution IS NOT NULL THEN concat('Distribution: ', distribution) END) AS text FROM p LEFT JOIN t USING (column_name)
UNION ALL SELECT concat('gap ', column_name), concat(column_name, ': ', missing_pct, '% missing') FROM p WHERE missing > 0"""
QUERIES["g12_chat_formatting"] = lambda s, d: records(s, d).select("conv_id", "turn", G.chat_text(F.col("instruction"), F.col("input"), F.col("output")).alias("text"))


def _turn(role, x):
    return f"'<|start_header_id|>{role}<|end_header_id|>', E'\\n\\n', {strip(x)}, '<|eot_id|>'"


ORACLES["g12_chat_formatting"] = f"SELECT conv_id, turn, concat('<|begin_of_text|>', {_turn('system', 'instruction')}, {_turn('user', 'input')}, {_turn('assistant', 'output')}) AS text FROM {_RECORDS}"
