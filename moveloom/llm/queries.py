"""The registered queries of this subpackage and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import imatch, langid, licenses, mixing, ngram_join, packing, pii, preference, prefix_trie, quality, quotes, runs, substrings
from .shared import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_classes(spark, load(spark, sf_dir, "documents"))


@query
def op2_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, load(spark, sf_dir, "documents"), tokenizer_file())


@query
def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.chat_rows(spark, load(spark, sf_dir, "conversations"))


@query
def op4_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprint_edits(spark, load(spark, sf_dir, "documents"))


@query
def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(spark, load(spark, sf_dir, "documents"))


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "source")
    judged, names = quality.judge(docs, keep=["doc_id", "source"])
    shown = judged.select("doc_id", *(F.col(names[n]).alias(n) for n in (*quality.MEASURES, "base_failed", "host_rate", "kept")))
    return shown.withColumn("host_rate", F.round("host_rate", 6))


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_held_out(spark, load(spark, sf_dir, "documents"))


@query
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(load(spark, sf_dir, "documents"))


@query
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(load(spark, sf_dir, "documents"))


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(load(spark, sf_dir, "documents"))


@query
def op11_preference_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.quality_digest(spark, load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "labels"))


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.runs_digest(load(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie_digest(spark, load(spark, sf_dir, "conversations"))


ORACLES["op10_mixing"] = r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('20:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 3.0::DOUBLE * sum(size)::DOUBLE AS cap,
        ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM sized GROUP BY source),
c AS (SELECT *, cap / weight AS per_weight, sum(source_size) OVER ()::DOUBLE AS total,
        (sum(cap) OVER w - cap)::DOUBLE AS before, (sum(weight) OVER () - sum(weight) OVER w + weight)::DOUBLE AS rest
      FROM s WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
t AS (SELECT source, source_size, least(cap, coalesce(weight * (SELECT arg_min((total - before) / rest, per_weight) FROM c WHERE per_weight > (total - before) / rest), cap)) AS target FROM c),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate,
        coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before
      FROM sized d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (floor(rate)::BIGINT + CASE WHEN before + 0.5::DOUBLE * size <= (rate - floor(rate)) * source_size THEN 1 ELSE 0 END) * size AS taken FROM r
"""

ORACLES["op6_quality_rules"] = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
gs AS (SELECT doc_id, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) AS g FROM d WHERE len(w) > 4),
win AS (SELECT doc_id, unnest(g) AS g, generate_subscripts(g, 1) AS i FROM gs),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
m AS (SELECT d.doc_id, d.source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN dup ON d.doc_id = dup.doc_id LEFT JOIN cov ON d.doc_id = cov.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, (count(*) FILTER (base_failed))::DOUBLE AS f FROM b WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT (sum(f) + 0.5) / (sum(n) + 1.0) AS mean, var_samp(f / n) AS v, avg(1.0 / n) AS inv, count(*) AS hosts FROM h),
q AS (SELECT mean, mean * (1 - mean) AS spread, CASE WHEN hosts > 1 THEN v - mean * (1 - mean) * inv ELSE 0 END AS extra FROM p),
k AS (SELECT mean, CASE WHEN extra > 0 THEN least(greatest(spread / extra - 1, 1.0), 1000.0) ELSE 20.0 END AS strength FROM q),
r AS (SELECT source, (f + mean * strength) / (n + strength) AS rate FROM h, k)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(r.rate, 6) AS host_rate, NOT base_failed AND NOT coalesce(r.rate > 0.6, false) AS kept
FROM b LEFT JOIN r ON b.source = r.source
"""


def _license_sql() -> str:
    """The templates as rows, then the same comparison in SQL."""
    rows = ", ".join(f"('{name}', [{', '.join(repr(b) for b in own)}])" for name, own in licenses.template_bigrams())
    ratio = licenses.THRESHOLD / (2 - licenses.THRESHOLD)
    return rf"""
WITH tm(license, t) AS (VALUES {rows}),
x AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
u AS (SELECT DISTINCT doc_id, unnest(list_concat(list_concat(string_split(t, chr(10)), regexp_split_to_array(t, '
\s*
')), [t])) AS unit FROM x),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(unit), '[^\p{{L}}\p{{N}}]+'), lambda q: q <> '') AS w FROM u),
b AS (SELECT row_number() OVER () AS id, doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS s FROM w WHERE len(w) > 1),
c AS (SELECT id, doc_id, license, 2.0::DOUBLE * len(list_intersect(s, t)) / (len(s) + len(t)) AS dice FROM b JOIN tm ON len(s) BETWEEN len(t) * {ratio!r} AND len(t) / {ratio!r}),
best AS (SELECT id, doc_id, arg_max(license, (dice, license)) AS license, max(dice) AS dice FROM c GROUP BY id, doc_id)
SELECT doc_id, license, max(dice) AS dice FROM best WHERE dice >= {licenses.THRESHOLD} GROUP BY doc_id, license
"""


ORACLES["op8_license_scan"] = _license_sql()

#: CRC-32 of a short string of digits, a byte at a time over the table that its polynomial gives.
_CRC = """crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
crc AS (SELECT id, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(id::VARCHAR, ''), lambda b: ascii(b)::BIGINT)),
  lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS h FROM ids, crc_table)"""

ORACLES["op13_prefix_trie"] = rf"""
WITH ids AS (SELECT DISTINCT conv_id AS id FROM conversations WHERE conv_id IS NOT NULL), {_CRC},
own AS (SELECT conv_id AS c, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}}
    ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
built AS (SELECT o.c, list_concat(list_slice(coalesce(b.own, []), 1, h % 4), list_slice(o.own, h % 4 + 1, len(o.own))) AS v
  FROM own o JOIN crc ON crc.id = o.c LEFT JOIN own b ON b.c = o.c - o.c % 20),
pre AS (SELECT c, d, len(v) = d AS ends, md5(to_json(list_slice(v, 1, d))::VARCHAR) AS node, CASE WHEN d > 0 THEN md5(to_json(list_slice(v, 1, d - 1))::VARCHAR) END AS parent,
    CASE WHEN d > 0 THEN len(regexp_extract_all(v[d].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words FROM (SELECT c, v, unnest(range(0, len(v) + 1)) AS d FROM built)),
n AS (SELECT node, any_value(parent) AS parent, min(c) AS c, min(d) AS d, count(*) AS n_convs, (count(*) - 1) * min(words) AS saved,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM pre GROUP BY node),
k AS (SELECT parent AS node, count(*) AS n_children FROM n GROUP BY parent),
u AS (SELECT n.c, n.d, n.saved, k.n_children IS NULL AS leaf FROM n LEFT JOIN k ON n.node = k.node),
s AS (SELECT pre.node, count(*) FILTER (leaf) AS n_leaves, sum(saved) AS saved_tokens FROM u JOIN pre ON pre.c = u.c AND pre.d <= u.d GROUP BY pre.node)
SELECT n.c AS conv_id, n.d::BIGINT AS depth, p.c AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN s ON n.node = s.node LEFT JOIN k ON n.node = k.node LEFT JOIN n AS p ON n.parent = p.node
"""

#: For tables without a quoted line, as the given ones are: each message then answers the one before it.
ORACLES["op3_chat_formatting"] = """
WITH t AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
p AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS parent_turn, min(turn) OVER (PARTITION BY conv_id) AS start FROM t)
SELECT c.conv_id, c.turn, c.role, p.parent_turn, CASE WHEN p.turn IS NOT NULL THEN 0::BIGINT END AS quote_links, '1:0:' || p.start || '/0:' || c.turn || ':0' AS reply_path,
  '<|' || coalesce(c.role, 'user') || '|>' || chr(10) || trim(coalesce(c.text, ''), ' ') || chr(10) AS message
FROM conversations c LEFT JOIN p ON c.conv_id = p.conv_id AND c.turn = p.turn
"""
