"""Registered queries of this subpackage: thin views on its operators, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatch.llm import byte_bpe, extendible_shards, host_paths, line_dedup, phrase_tries, ppm_scoring, quality_cascade, secret_forest, simhash_anchors, spelling_variants, string_tiling, tier_packing, tool_calls
from tidewatch.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: A small shard limit, so that tables of a few MB already fill several shards.
SHARD_BYTES = 1 << 20


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


@register("op2_sharding", f"""
WITH items AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h,
         coalesce(octet_length(encode(text)), 0)::BIGINT AS b FROM documents),
sums AS (
  SELECT d, h >> (60 - d) AS prefix, sum(b)::BIGINT AS s FROM items, range(0, 41) r(d) GROUP BY 1, 2 HAVING sum(b) <= {SHARD_BYTES}),
best AS (
  SELECT i.doc_id, i.b, i.h, min(struct_pack(d := sums.d, s := sums.s)) AS m
  FROM items i JOIN sums ON sums.prefix = i.h >> (60 - sums.d) GROUP BY 1, 2, 3)
SELECT doc_id, b AS bytes, m.d::INTEGER AS depth, (h >> (60 - m.d))::BIGINT AS prefix, 0::BIGINT AS overflow,
       m.d || '-' || (h >> (60 - m.d)) || '-0' AS shard, m.s AS shard_bytes, m.s > {SHARD_BYTES} AS oversize
FROM best
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible_shards.assign(table(spark, sf_dir, "documents"), SHARD_BYTES)


@register("op5_simhash_anchors")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_anchors.near_duplicates(table(spark, sf_dir, "documents"), size=3, threshold=2)
    return found.select("doc_id", "fingerprint", "component_id", "n_links", "n_copies")


_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@register("op6_line_dedup", f"""
WITH lines AS (
  SELECT doc_id, line, pos, {_LOWER.format(f"trim(line, {_SPACES})")} AS k
  FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
often AS (SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE k IN (FROM often))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE k NOT IN (FROM often)), '')) AS kept_sha256
FROM lines GROUP BY doc_id
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)


@register("op8_quality_cascade", r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM t WHERE len(w) >= 8)),
rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1), range(0, 8) r(k)
  GROUP BY doc_id),
m AS (
  SELECT t.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS upper_n,
         length(regexp_replace(text, '[^a-z]', '', 'g')) AS lower_n, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS letters
  FROM t LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > n_words OR word_chars > 10 * n_words OR word_chars < 2 * n_words
            OR 2 * (n_lines - n_dup_lines) < n_lines OR upper_n > lower_n OR 2 * letters < word_chars) AS kept
FROM m
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cascade.report(table(spark, sf_dir, "documents"))


@register("op10_byte_bpe")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)


@register("op4_ppm_scoring")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7))
    return ppm_scoring.score_documents(table(spark, sf_dir, "documents"), held_out=part == 2, order=4)


@register("op7_string_tiling")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return string_tiling.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), min_match=4, threshold=0.5)


@register("op9_host_paths")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_paths.main_texts(table(spark, sf_dir, "pages"))


def finding_label(value: Column, hint: Column) -> Column:
    """1 for 40 hexadecimal digits of either case, whatever punctuation is attached; 0 for words, numbers and mail
    addresses that no hint precedes; null for anything else, about which nothing is known."""
    bare, part = F.regexp_replace(value, "^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", ""), "(?:[A-Z]?[a-z]+|[A-Z]+)"
    plain = bare.rlike(f"^{part}(?:[._/-]+{part})*$") | bare.rlike("^[0-9]+(?:[._/+-][0-9]+)*$") | bare.rlike("^[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+$")
    return F.when(bare.rlike("^[0-9A-Fa-f]{40}$"), 1.0).when(plain & (hint == 0), 0.0)


@register("op1_secret_forest")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled findings: candidates of the documents that ``labels`` covers, by ``finding_label``."""
    reviewed = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")).distinct()

    def label(rows: DataFrame) -> DataFrame:
        return rows.join(reviewed, "id", "left_semi").withColumn("label", finding_label(F.col("value"), F.col("hint")))

    found = secret_forest.scan(table(spark, sf_dir, "documents"), path_col="source", label=label)
    return found.drop("value")


@register("op3_tool_calls", """
WITH t AS (
  SELECT DISTINCT conv_id, turn, role, text, CASE WHEN role IN ('system', 'user') THEN 'call-' || turn END AS own FROM conversations),
u AS (
  SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM t),
calls AS (
  SELECT conv_id, own AS call_id, turn AS position, CASE role WHEN 'user' THEN 'reply' ELSE 'instruct' END AS name, last, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS level FROM u WHERE own IS NOT NULL),
answers AS (
  SELECT conv_id, coalesce(last, 'none') AS call_id, arg_min(text, turn) AS content, min(turn) AS answered, count(*) AS n FROM u WHERE own IS NULL GROUP BY 1, 2),
j AS (
  SELECT coalesce(c.conv_id, a.conv_id) AS conv_id, coalesce(c.call_id, a.call_id) AS call_id, coalesce(position, answered)::BIGINT AS position, name,
         CASE WHEN c.call_id IS NOT NULL THEN level END AS level, coalesce(n, 0) AS n_results, content, last, text, c.call_id IS NULL AS orphan, n IS NULL AS silent
  FROM calls c FULL JOIN answers a ON c.conv_id = a.conv_id AND c.call_id = a.call_id),
e AS (
  SELECT *, CASE WHEN orphan THEN 'orphan' WHEN silent THEN 'unanswered' ELSE 'linked' END AS status,
         concat_ws('; ', CASE WHEN NOT orphan AND text IS NULL THEN 'missing text' END, CASE WHEN name = 'instruct' AND last IS NOT NULL THEN 'unexpected after' END) AS errors,
         '{"arguments":' || CASE WHEN orphan THEN 'null' ELSE '{' || concat_ws(',', '"after":' || to_json(last), '"text":' || to_json(text), '"turn":' || position) || '}' END
         || ',"id":' || to_json(call_id) || ',"name":' || coalesce(to_json(name)::VARCHAR, 'null') || ',"result":' || coalesce(to_json(content)::VARCHAR, 'null') || '}' AS canonical
  FROM j)
SELECT conv_id, call_id, position, name, level::INTEGER AS level,
       row_number() OVER (PARTITION BY conv_id ORDER BY level NULLS LAST, position, call_id, status)::INTEGER AS place, status, n_results::BIGINT AS n_results, errors,
       status = 'linked' AND errors = '' AS valid, canonical
FROM e
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_calls.turns_as_calls(table(spark, sf_dir, "conversations"))
    return tool_calls.link(calls, results, tool_calls.chat_schemas(spark))


def _crc32_sql(text: str) -> str:
    """crc32 of a string's UTF-8 bytes, four bits at a time; the table follows from the polynomial."""
    table = list(range(16))
    for _ in range(4):
        table = [x >> 1 ^ 0xEDB88320 if x & 1 else x >> 1 for x in table]
    at = f"[{', '.join(map(str, table))}]"
    half = lambda c: f"xor(({c}) >> 4, {at}[(({c}) & 15) + 1])"
    data = f"list_transform(range(0, octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, b: {half(half('xor(c, b)'))}), 4294967295)"


@register("op11_spelling_variants", rf"""
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
each AS (SELECT doc_id, {_LOWER.format('run')} AS run, count(*) AS c FROM runs GROUP BY 1, 2),
h AS (SELECT run, c, {_crc32_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM each),
hurt AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM h),
words AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM hurt WHERE length(word) >= 5 GROUP BY 1 HAVING sum(c) >= 3),
cuts AS MATERIALIZED (SELECT word, n, p, substr(word, 1, p) || substr(word, p + 2) AS s FROM (SELECT *, unnest(range(0, length(word))) AS p FROM words)),
near AS (
  SELECT a.word, b.word AS near, b.n AS m FROM cuts a JOIN cuts b ON a.p = b.p AND a.s = b.s AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON b.word = a.s
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON b.word = a.s),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-m, near)) AS near, max(m) AS m FROM near GROUP BY 1),
forms AS MATERIALIZED (
  SELECT w.word, CASE WHEN m >= 2 * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN m END AS form_n
  FROM words w LEFT JOIN best USING (word)),
walk AS (
  SELECT word, word AS root FROM forms
  UNION ALL SELECT walk.word, forms.form FROM walk JOIN forms ON forms.word = walk.root WHERE forms.form IS NOT NULL),
ends AS (SELECT walk.word, walk.root FROM walk JOIN forms ON forms.word = walk.root WHERE forms.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling_variants.vocabulary(table(spark, sf_dir, "documents"), damage=97, shortest=5, least=3)
    return spelling_variants.group_variants(words, factor=2)


@register("op12_tier_packing")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = tier_packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return tier_packing.balance_steps(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_id")


@register("op13_phrase_tries", r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({lower}, '[.,;:!?
-
]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM pieces),
f AS (
  SELECT lang, list_extract(w, i) AS a1, CASE WHEN k > 1 THEN list_extract(w, i + 1) END AS a2, CASE WHEN k > 2 THEN list_extract(w, i + 2) END AS a3, k, count(*) AS c
  FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w), range(1, 4) r(k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
n AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
u AS (SELECT * FROM f WHERE k = 1 AND c >= 10), b AS (SELECT * FROM f WHERE k = 2 AND c >= 10), t AS (SELECT * FROM f WHERE k = 3 AND c >= 10),
cuts AS (
  SELECT b.lang, b.a1, b.a2, NULL AS a3, 2 AS k, b.c AS a, 1 AS cut, x.c AS l, y.c AS r FROM b JOIN u x ON x.lang = b.lang AND x.a1 = b.a1 JOIN u y ON y.lang = b.lang AND y.a1 = b.a2
  UNION ALL
  SELECT t.lang, t.a1, t.a2, t.a3, 3, t.c, 1, x.c, y.c FROM t JOIN u x ON x.lang = t.lang AND x.a1 = t.a1 JOIN b y ON y.lang = t.lang AND y.a1 = t.a2 AND y.a2 = t.a3
  UNION ALL
  SELECT t.lang, t.a1, t.a2, t.a3, 3, t.c, 2, x.c, y.c FROM t JOIN b x ON x.lang = t.lang AND x.a1 = t.a1 AND x.a2 = t.a2 JOIN u y ON y.lang = t.lang AND y.a1 = t.a3),
s AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, k, a1, a2, a3 ORDER BY score, cut) = 1),
longer AS (SELECT lang, p, q, max(c) AS c FROM (SELECT lang, a1 AS p, a2 AS q, c FROM t UNION ALL SELECT lang, a2, a3, c FROM t) GROUP BY 1, 2, 3),
kept AS (SELECT best.* FROM best LEFT JOIN longer o ON best.k = 2 AND o.lang = best.lang AND o.p = best.a1 AND o.q = best.a2 WHERE o.c IS NULL OR 100 * o.c < 50 * best.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, concat_ws(' ', a1, a2, a3)) AS rank, concat_ws(' ', a1, a2, a3) AS phrase, a, l, r, n, score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
""".replace("{lower}", _LOWER.format("coalesce(text, '')")))
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_tries.collocations(table(spark, sf_dir, "documents"), least=10, longest=3, share=50, top=2000)
