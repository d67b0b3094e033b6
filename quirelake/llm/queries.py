"""The training-data queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, exact, jaccard, licenses, mixing, pii, resample, spelling, suffix, tokens, toxicity, warc


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_chat_formatting(spark: SparkSession, d: str) -> DataFrame:
    calls, results = chat.conversation_events(_read(spark, d, "conversations"))
    return chat.link_tool_calls(calls, results, chat.REPLY)


def chat_call_order(spark: SparkSession, d: str) -> DataFrame:
    """op1, by the name under which the order of calls was first a query of its own."""
    return op1_chat_formatting(spark, d)


def op2_warc(spark: SparkSession, d: str) -> DataFrame:
    return warc.warc_round_trip(_read(spark, d, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return exact.exact_dedup(_read(spark, d, "documents"))


def op4_suffix_dedup(spark: SparkSession, d: str) -> DataFrame:
    return suffix.remove_repeats(_read(spark, d, "documents"), passages=False)


def op5_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontam.decontaminate(_read(spark, d, "documents"), _read(spark, d, "benchmark")).drop("items")


def op6_pii(spark: SparkSession, d: str) -> DataFrame:
    return pii.find_pii(_read(spark, d, "documents"))


def op7_ngram_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return jaccard.jaccard_classes(_read(spark, d, "documents"))


def op8_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.toxicity(_read(spark, d, "documents"), _read(spark, d, "labels"))


def op9_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(_read(spark, d, "documents"))


def op10_token_output(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_output(_read(spark, d, "documents"), tokenizer_path())


def op11_resample(spark: SparkSession, d: str) -> DataFrame:
    return resample.importance_resample(_read(spark, d, "documents"), _read(spark, d, "benchmark"))


def op12_spelling(spark: SparkSession, d: str) -> DataFrame:
    return spelling.spelling_variants(_read(spark, d, "documents"))


def op13_licenses(spark: SparkSession, d: str) -> DataFrame:
    return licenses.license_scan(_read(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_chat_formatting, chat_call_order, op2_warc, op3_exact_dedup, op4_suffix_dedup, op5_decontamination, op6_pii, op7_ngram_jaccard, op8_toxicity, op9_mixing, op10_token_output, op11_resample, op12_spelling, op13_licenses)
}

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS5 = rf"regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_WORDS7 = rf"regexp_extract_all({_FOLDED}, '[^\x20\x09-\x0D]+')"

# CRC-32 of a text: its bytes one after the other through the table that the polynomial gives.
_CRC_TABLE = "ct AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS crc_of)"


def _crc(text: str) -> str:
    """Needs crc_of of _CRC_TABLE."""
    byte = f"list_transform(range(octet_length(encode({text}))), lambda i: CAST('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS INT), 2) AS BIGINT))"
    return f"xor(list_reduce({byte}, lambda c, b: xor(c >> 8, crc_of[CAST(xor(c, b) & 255 AS INT) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"


_TEMPLATES = ", ".join("({}, '{}', {}, '{}')".format(i, label, base, text.replace("'", "''")) for i, (label, text, base) in enumerate([*((*p, True) for p in licenses.PHRASES), *((*n, False) for n in licenses.NOTICES)]))

ORACLES: dict[str, str] = {
    "op1_chat_formatting": """
WITH c AS (SELECT conv_id, 'call-' || turn AS call_id, turn, text, 2 * (dense_rank() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS depth FROM conversations WHERE role = 'user'),
r AS (SELECT conv_id, 'call-' || (turn - 1) AS call_id, turn, text FROM conversations WHERE role = 'assistant'),
n AS (SELECT conv_id, call_id, count(*) AS n FROM r GROUP BY ALL),
k AS (SELECT conv_id, call_id, min(depth) + 1 AS depth FROM c GROUP BY ALL),
e AS (SELECT c.*, n.n, CASE WHEN length(text) < 20 OR length(text) > 20000 THEN ['bounds: prompt'] ELSE CAST([] AS VARCHAR[]) END
  || CASE WHEN turn < 0 THEN ['bounds: turn'] ELSE CAST([] AS VARCHAR[]) END AS errors FROM c LEFT JOIN n USING (conv_id, call_id))
SELECT conv_id, turn, 'call' AS kind, call_id, 'reply' AS name, CAST(depth AS BIGINT) AS depth, CASE WHEN len(errors) > 0 THEN 'invalid' WHEN n IS NULL THEN 'no result' ELSE 'ok' END AS status, errors,
  '{"arguments":{"prompt":' || to_json(text) || ',"turn":' || turn || '},"depth":' || depth || ',"id":"' || call_id || '","name":"reply","type":"call"}' AS json FROM e
UNION ALL
SELECT r.conv_id, turn, 'result', call_id, CASE WHEN depth IS NOT NULL THEN 'reply' END, depth, CASE WHEN depth IS NULL THEN 'orphan' ELSE 'ok' END, CAST([] AS VARCHAR[]),
  '{"content":' || to_json(text) || ',"depth":' || coalesce(CAST(depth AS VARCHAR), 'null') || ',"id":"' || call_id || '","name":' || CASE WHEN depth IS NULL THEN 'null' ELSE '"reply"' END || ',"type":"result"}' FROM r LEFT JOIN k USING (conv_id, call_id)""",
    "chat_call_order": """
WITH c AS (SELECT conv_id, 'call-' || turn AS call_id, turn, text, 2 * (dense_rank() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS depth FROM conversations WHERE role = 'user'),
r AS (SELECT conv_id, 'call-' || (turn - 1) AS call_id, turn, text FROM conversations WHERE role = 'assistant'),
n AS (SELECT conv_id, call_id, count(*) AS n FROM r GROUP BY ALL),
k AS (SELECT conv_id, call_id, min(depth) + 1 AS depth FROM c GROUP BY ALL),
e AS (SELECT c.*, n.n, CASE WHEN length(text) < 20 OR length(text) > 20000 THEN ['bounds: prompt'] ELSE CAST([] AS VARCHAR[]) END
  || CASE WHEN turn < 0 THEN ['bounds: turn'] ELSE CAST([] AS VARCHAR[]) END AS errors FROM c LEFT JOIN n USING (conv_id, call_id))
SELECT conv_id, turn, 'call' AS kind, call_id, 'reply' AS name, CAST(depth AS BIGINT) AS depth, CASE WHEN len(errors) > 0 THEN 'invalid' WHEN n IS NULL THEN 'no result' ELSE 'ok' END AS status, errors,
  '{"arguments":{"prompt":' || to_json(text) || ',"turn":' || turn || '},"depth":' || depth || ',"id":"' || call_id || '","name":"reply","type":"call"}' AS json FROM e
UNION ALL
SELECT r.conv_id, turn, 'result', call_id, CASE WHEN depth IS NOT NULL THEN 'reply' END, depth, CASE WHEN depth IS NULL THEN 'orphan' ELSE 'ok' END, CAST([] AS VARCHAR[]),
  '{"content":' || to_json(text) || ',"depth":' || coalesce(CAST(depth AS VARCHAR), 'null') || ',"id":"' || call_id || '","name":' || CASE WHEN depth IS NULL THEN 'null' ELSE '"reply"' END || ',"type":"result"}' FROM r LEFT JOIN k USING (conv_id, call_id)""",
    "op2_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, upper(sha1(b)) AS h, min(page_id) OVER (PARTITION BY sha1(b)) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + (CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT) >> CAST(5 * (3 - i % 4) AS INT)) % 32 AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d""",
    "op3_exact_dedup": f"""
WITH d AS (SELECT doc_id, sha256({_FOLDED}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    "op5_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS5} AS w FROM documents), i AS (SELECT item_id, {_WORDS5} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, w[k:k + least(len(w), 10) - 1] AS g FROM i, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS r(k) WHERE len(w) > 0),
own AS (SELECT DISTINCT n, g FROM win), lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, k, w[k:k + n - 1] AS g FROM d, lens, unnest(range(1, len(w) - n + 2)) AS r(k) WHERE len(w) >= n),
hit AS (SELECT doc_id, k, n, g FROM dw JOIN own USING (n, g)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(k, k + n)) AS r(p) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit JOIN win USING (n, g)) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)""",
    "op4_suffix_dedup": """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, k, md5(b[k:k + 399]) AS h FROM d, unnest(range(1, octet_length(b) - 398)) AS r(k) WHERE octet_length(b) >= 400),
twice AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
s AS (SELECT doc_id, k FROM w SEMI JOIN twice USING (h)),
edge AS (SELECT doc_id, k, k > 400 + coalesce(lag(k) OVER (PARTITION BY doc_id ORDER BY k), -400) AS fresh FROM s),
run AS (SELECT doc_id, k, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY k) AS g FROM edge),
span AS (SELECT doc_id, g, min(k) AS a, max(k) + 400 AS z FROM run GROUP BY doc_id, g),
gap AS (SELECT doc_id, lag(z, 1, 1) OVER (PARTITION BY doc_id ORDER BY a) AS a, a AS z FROM span
  UNION ALL SELECT doc_id, max(z), NULL FROM span GROUP BY doc_id UNION ALL SELECT doc_id, 1, NULL FROM d WHERE doc_id NOT IN (SELECT doc_id FROM span)),
kept AS (SELECT doc_id, string_agg(hex(CASE WHEN z IS NULL THEN b[a:] ELSE b[a:z - 1] END), '' ORDER BY a) AS x FROM gap JOIN d USING (doc_id) GROUP BY doc_id),
cut AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(x)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN cut USING (doc_id)""",
    "op7_ngram_jaccard": f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_WORDS7} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(w[k:k + 4]) AS h FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS r(k) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s AS a JOIN s AS b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM o JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "op11_resample": f"""
WITH {_CRC_TABLE}, d AS MATERIALIZED (SELECT doc_id, {_WORDS5} AS w FROM documents), b AS (SELECT {_WORDS5} AS w FROM benchmark),
f AS (SELECT unnest(w) AS x, 1 AS raw FROM d UNION ALL SELECT unnest(w), 0 FROM b), n AS MATERIALIZED (SELECT x, sum(raw) AS s, sum(1 - raw) AS t FROM f GROUP BY x),
k AS MATERIALIZED (SELECT x, s AS sx, n.t AS tx, {_crc('x')} % 10000 AS bucket FROM n, ct), u AS MATERIALIZED (SELECT bucket, CAST(sum(sx) AS DOUBLE) AS s, CAST(sum(tx) AS DOUBLE) AS t FROM k GROUP BY bucket),
a AS (SELECT sum(s) AS sa, sum(t) AS ta FROM u), g AS MATERIALIZED (SELECT x, CAST(floor(1000 * ln((t + 1) * (sa + 10000) / ((s + 1) * (ta + 10000)))) AS BIGINT) AS gain FROM k JOIN u USING (bucket), a),
v AS (SELECT doc_id, sum(gain) AS weight FROM (SELECT doc_id, unnest(w) AS x FROM d) JOIN g USING (x) GROUP BY doc_id),
r AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN v USING (doc_id)),
z AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM r),
p AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM z WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n * 10 // 100 THEN rank END AS rank FROM z LEFT JOIN p USING (doc_id)""",
    "op12_spelling": f"""
WITH RECURSIVE {_CRC_TABLE}, r AS (SELECT doc_id, unnest(regexp_extract_all({_FOLDED}, '[a-zÀ-ÿ]+')) AS run FROM documents),
u AS MATERIALIZED (SELECT run, n AS k, {_crc("doc_id || ':' || run")} AS h FROM (SELECT doc_id, run, count(*) AS n FROM r GROUP BY ALL), ct),
m AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, k FROM u),
w AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM m WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
x AS MATERIALIZED (SELECT word, n, i, substr(word, 1, CAST(i - 1 AS INT)) || substr(word, CAST(i + 1 AS INT)) AS v FROM w, unnest(range(1, length(word) + 1)) AS q(i)),
l AS (SELECT a.word, a.n, b.word AS other, b.n AS k FROM x a JOIN x b ON a.v = b.v AND a.i = b.i AND a.word <> b.word UNION SELECT a.word, a.n, b.word, b.n FROM x a JOIN w b ON a.v = b.word UNION SELECT b.word, b.n, a.word, a.n FROM x a JOIN w b ON a.v = b.word),
f AS MATERIALIZED (SELECT word, n, count(*) OVER (PARTITION BY word) AS n_near, CASE WHEN k >= 2 * n THEN other END AS form, CASE WHEN k >= 2 * n THEN k END AS form_n FROM l QUALIFY row_number() OVER (PARTITION BY word ORDER BY k DESC, other) = 1),
c AS (SELECT word, form AS reached, 1 AS step FROM f WHERE form IS NOT NULL UNION ALL SELECT c.word, f.form, step + 1 FROM c JOIN f ON f.word = c.reached WHERE f.form IS NOT NULL),
e AS (SELECT word, max_by(reached, step) AS root FROM c GROUP BY word)
SELECT word, w.n, form, form_n, coalesce(root, word) AS root, coalesce(n_near, 0) AS n_near FROM w LEFT JOIN f USING (word) LEFT JOIN e USING (word)""",
    "op13_licenses": f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS5} AS w FROM documents), tx(template, label, base, text) AS (VALUES {_TEMPLATES}), tp AS MATERIALIZED (SELECT template, label, base, {_WORDS5} AS w, least(len(w), 4) AS k, len(w) AS n FROM tx),
g AS MATERIALIZED (SELECT template, n, k, base, a AS o, w[a + 1:a + k] AS g FROM tp, unnest(range(n - k + 1)) AS r(a)),
h AS MATERIALIZED (SELECT doc_id, template, n, g.k, base, p - o AS diag, o FROM (SELECT doc_id, k, p, w[p + 1:p + k] AS g FROM d, (SELECT DISTINCT k FROM g), unnest(range(len(w) - k + 1)) AS r(p)) JOIN g USING (k, g)),
e AS (SELECT *, base OR coalesce(diag - lag(diag) OVER (PARTITION BY doc_id, template ORDER BY diag) > 8, true) AS fresh FROM (SELECT DISTINCT doc_id, template, n, k, base, diag FROM h)),
c AS (SELECT doc_id, template, diag, count_if(fresh) OVER (PARTITION BY doc_id, template ORDER BY diag) AS place FROM e),
s AS (SELECT doc_id, template, place, base, min(diag) AS start, count(DISTINCT o + j) / any_value(n) AS share FROM h JOIN c USING (doc_id, template, diag), unnest(range(k)) AS r(j) GROUP BY ALL),
m AS (SELECT doc_id, count_if(base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word, array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels,
  array_to_string(list_sort(list(DISTINCT label) FILTER (share >= 0.6)), ',') AS labels, round(max(share), 4) AS score FROM s JOIN tp USING (template, base) WHERE share >= 0.3 AND (NOT base OR share = 1) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score FROM d LEFT JOIN m USING (doc_id)""",
}
