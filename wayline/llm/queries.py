"""Registered queries of the numbered operators, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm import (
    chat_format,
    embeddings_forest,
    fill_middle,
    jaccard,
    licenses,
    mixing,
    ordinal_quality,
    packing,
    quality_rules,
    repeats,
    resampling,
    token_files,
    web_archive,
)
from wayline.llm.tables import table
from wayline.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


MIX = mixing.Mix(weights={"d0": 4, "d1": 3, "d2": 2, "d3": 1, "*/en": 6, "*/fr": 2, "*/de": 2, "*/es": 1, "*/*/src0": 3}, budget_pct=100, max_epochs=2, seed=17)


def _mix_sql() -> str:
    """The same tree by plain window sums; the prefix by one running sum per leaf."""
    weight = {
        1: "CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END",
        2: "CASE lang WHEN 'en' THEN 6 WHEN 'fr' THEN 2 WHEN 'de' THEN 2 ELSE 1 END",
        3: "CASE source WHEN 'src0' THEN 3 ELSE 1 END",
    }
    sql = r"""
WITH docs AS (
  SELECT doc_id,
    CASE WHEN regexp_extract(coalesce(source, ''), '(\d+)', 1) = '' THEN 'other'
      ELSE 'd' || (right(regexp_extract(source, '(\d+)', 1), 9)::INT % 4) END AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens
  FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::BIGINT * 2 AS capacity FROM docs GROUP BY ALL),
l0 AS (SELECT least(coalesce(sum(tokens), 0), coalesce(sum(capacity), 0))::HUGEINT AS budget FROM leaves)"""
    path = []
    for depth, name in enumerate(mixing.TREE, 1):
        parent, path = ", ".join(path), [*path, name]
        keys = ", ".join(path)
        part = f"PARTITION BY {parent}" if parent else ""
        join = f"JOIN l{depth - 1} USING ({parent})" if parent else "CROSS JOIN l0"
        sql += f""",
n{depth} AS (
  SELECT {keys}, x.capacity::HUGEINT AS capacity, ({weight[depth]})::HUGEINT AS weight, budget AS above
  FROM (SELECT {keys}, sum(capacity) AS capacity FROM leaves GROUP BY {keys}) x {join}),
r{depth} AS (
  SELECT *, coalesce(sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
    sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
  FROM n{depth} WINDOW w AS ({part} ORDER BY (capacity * 1000000) // weight, {name})),
f{depth} AS (SELECT *, capacity * weight_left <= (above - full_before) * weight AS fits FROM r{depth}),
l{depth} AS (
  SELECT {keys}, CASE WHEN fits THEN capacity ELSE least(capacity,
    ((above - coalesce(sum(CASE WHEN fits THEN capacity END) OVER ({part}), 0)) * weight)
      // coalesce(sum(CASE WHEN NOT fits THEN weight END) OVER ({part}), 1)) END AS budget
  FROM f{depth})"""
    return sql + """,
plan AS (
  SELECT domain, lang, source, CASE WHEN tokens > 0 THEN (budget // tokens)::BIGINT ELSE 0 END AS epochs, budget, tokens
  FROM leaves JOIN l3 USING (domain, lang, source)),
rows AS (
  SELECT docs.*, epochs, (budget - epochs * tokens)::BIGINT AS rest,
    coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('17:' || epochs || ':' || doc_id), doc_id, n_tokens
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM docs JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, unnest(range(0, epochs))::BIGINT AS epoch, n_tokens::BIGINT AS n_tokens, n_tokens::BIGINT AS take_tokens FROM rows
UNION ALL
SELECT doc_id, domain, lang, source, epochs, n_tokens::BIGINT, least(n_tokens, rest - start)::BIGINT FROM rows WHERE start < rest"""


@query("op2_source_mixing", _mix_sql())
def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.select_documents(table(spark, sf_dir, "documents"), MIX)


@query(
    "op6_host_quality_rules",
    r"""
WITH w AS (SELECT doc_id, source AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
windows AS (SELECT doc_id, i, ws[i:i + 2] AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
found AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows),
repeats AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM found WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, host, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_dup_lines,
    coalesce(repeats.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)),
f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    100 * n_symbols > 10 * word_chars OR 100 * n_repeat_words > 30 * n_words OR n_dup_lines > 2 AS soft_failed FROM m),
h AS (SELECT host, count(*) AS n, sum((base_failed OR soft_failed)::INT) AS bad FROM f GROUP BY host),
p AS (
  SELECT count(*) AS k, sum(n)::DOUBLE AS docs, sum(bad)::DOUBLE / sum(n) AS m, sum(n::DOUBLE * n) / sum(n) AS nn,
    sum(bad::DOUBLE * bad / n) - sum(bad)::DOUBLE * sum(bad) / sum(n) AS spread FROM h),
c AS (SELECT *, m * (1 - m) AS chance, docs - nn - (k - 1) AS room FROM p),
o AS (SELECT *, CASE WHEN chance > 0 AND room > 1e-9 * docs THEN (spread / chance - (k - 1)) / room ELSE 0 END AS correlation FROM c),
q AS (SELECT m, CASE WHEN correlation > 0 THEN least(greatest(1 / correlation - 1, 1), 1e6) ELSE 1e6 END AS s FROM o),
r AS (SELECT host, (bad + m * s) / (n + s) >= 0.5 AS host_rejected FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (host_rejected AND soft_failed) AS kept, soft_failed, host_rejected
FROM f JOIN r ON f.host IS NOT DISTINCT FROM r.host""",
)
def host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


@query(
    "op7_prefix_target_chat",
    r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, role = 'assistant' AS target,
    13 + length(role || text) + 2 * length(regexp_replace(role || text, '[^%<\[]', '', 'g')) AS chars,
    row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
sums AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS prefix FROM sized)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(CASE WHEN target THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN target THEN text END, '' ORDER BY i), '')) AS loss_sha256,
  sum(CASE WHEN target OR i = n THEN prefix END)::BIGINT AS formatted_chars,
  sum((target OR i = n)::INT)::BIGINT AS n_examples
FROM sums GROUP BY conv_id""",
)
def prefix_target_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(hard).alias("text"),
    )
    return chat_format.digest(chat_format.expand(turns.unionByName(extra)))


@query(
    "op3_suffix_tree_dedup",
    r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w)),
later AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM windows) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 20)) AS j FROM later)),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, len(ws)::BIGINT - coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)""",
)
def suffix_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = repeats.remove_repeats(docs)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query(
    "op9_jaccard_join",
    r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
grams AS (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 4], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(h, '' ORDER BY h)) AS key FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM grams a JOIN grams b USING (h) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * o >= 80 * (p.n + q.n - o)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x),
k AS (SELECT x AS doc_id, count(*) AS n_links FROM links GROUP BY x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles,
  CASE WHEN key IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY key) END AS class_id,
  component_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)""",
)
def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


# token ids, and labels found by templates, have no SQL; tests hold them against brute force


@query("op5_license_diagonals")
def license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op8_token_files")
def token_file_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read(files)


@query("op10_cost_balanced_packing")
def cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


# a fitted model and an approximate search have no SQL: tests measure held-out accuracy and recall


@query("op1_ordinal_quality")
def ordinal_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 toxic, 1 poor, 2 good. Documents that are good with half a chance at least are kept."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    model = ordinal_quality.train(docs, labels.select("doc_id", grade.alias("grade")))
    return ordinal_quality.score(docs, model, tail=2).withColumn("kept", F.col("tail_probability") >= 0.5)


@query("op4_hash_prefix_forest")
def hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings_forest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query(
    "op11_chunk_memo_fim",
    r"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS us, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x
  FROM documents),
h AS (SELECT *, len(us) AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM u),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR h3 % 100 >= 90 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(us[1:a], '') AS prefix, array_to_string(us[a + 1:b], '') AS middle, array_to_string(us[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p""",
)
def chunk_memo_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_middle(table(spark, sf_dir, "documents"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_middle.restore(), 256).alias("restored_sha256")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


@query(
    "op12_position_table_resampling",
    # the checksum byte by byte, over the distinct features
    r"""
WITH RECURSIVE bits AS (
  SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
codes AS (SELECT list(c ORDER BY i) AS codes FROM bits WHERE k = 8),
texts AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (
  SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM texts),
f AS (
  SELECT side, id, unnest(ws) AS feature FROM w
  UNION ALL SELECT side, id, ws[i] || ' ' || ws[i + 1] FROM (SELECT side, id, ws, unnest(range(1, len(ws))) AS i FROM w)),
hashed AS (
  SELECT feature, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(encode(feature)) + 1), lambda i: ('0x' || substr(hex(encode(feature)), 2 * i - 1, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, codes[xor(c, b) % 256 + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT feature FROM f), codes),
b AS (SELECT side, id, bucket FROM f JOIN hashed USING (feature)),
counts AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM b GROUP BY bucket),
total AS (SELECT sum(s)::DOUBLE + 10000 AS s, sum(t)::DOUBLE + 10000 AS t FROM counts),
gains AS (SELECT bucket, floor(1000 * ln(((c.t + 1) * total.s) / ((c.s + 1) * total.t)))::BIGINT AS gain FROM counts c, total),
sums AS (SELECT id, count(*) AS n, sum(gain) AS gain FROM b JOIN gains USING (bucket) WHERE side = 0 GROUP BY id),
scored AS (
  SELECT w.id AS doc_id, len(ws) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(floor(gain::DOUBLE / n), 0)::BIGINT AS weight,
    floor(-1000 * ln(-ln((('0x' || sha256('7:' || coalesce(w.id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS noise
  FROM w LEFT JOIN sums USING (id) WHERE side = 0),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN rank <= 25 * n // 100 THEN rank END::BIGINT AS rank
FROM scored LEFT JOIN ranked USING (doc_id)""",
)
def position_table_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op13_arc_to_warc",
    r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS x, unhex(sha1(body))::BIT::VARCHAR AS bits FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY x, payload_bytes) AS first FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + substr(bits, 1 + 5 * i, 5)::BIT::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f""",
)
def arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    arc = web_archive.write_arc(table(spark, sf_dir, "pages"), f"{folder}/arc")
    warc = web_archive.convert(spark, arc, f"{folder}/warc")
    return web_archive.page_records(spark, warc)
