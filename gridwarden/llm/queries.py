"""The registered query of each operator, with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: host/path rules.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
WORD_VOCABULARY = "word_bpe_49k.json"


def vocabulary() -> str:
    """Path of the public word vocabulary on this machine (each executor has it at the same place)."""
    import public_tokenizers

    return public_tokenizers.path(WORD_VOCABULARY)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import store_and_check

    return store_and_check(table(spark, sf_dir, "documents"), vocabulary(), end_id=1)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import round_trip_digests

    return round_trip_digests(table(spark, sf_dir, "documents"), vocabulary())


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlfilter import host_rule, judge

    return judge(table(spark, sf_dir, "pages"), [host_rule(name, verdict) for name, verdict in URL_RULES])


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary(), end_id=2, size=4096)


def op8_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .gif import features, stored, stored_frames

    return features(stored_frames(stored(table(spark, sf_dir, "documents"))))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    return judge(table(spark, sf_dir, "documents"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licences import scan

    return scan(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fim import digests

    return digests(table(spark, sf_dir, "documents"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assignment

    return assignment(table(spark, sf_dir, "documents"), shards=16)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .align import aligned_documents

    return aligned_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_store, op2_bpe, op3_url_filter, op4_language_id, op5_minhash, op6_toxicity, op7_packing, op8_gif, op9_quality_rules, op10_licences, op11_fill_in_middle, op12_sharding, op13_alignment, pipeline)
}

def _licence_sql() -> str:
    """Words of the lines that state no copyright, one space between, hashed and looked up: the method said once more in DuckDB's functions."""
    from .licences import _ARTICLES, _PHRASES, DIGESTS, TEXTS, _names

    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = lambda pairs: ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in dict.fromkeys(pairs))
    one = lambda items: ", ".join(f"({quoted(x)})" for x in items)
    return rf"""
WITH doc AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), named(name, spelled) AS (VALUES {rows(_names())}), phrase(p) AS (VALUES {one(_PHRASES)}), article(a) AS (VALUES {one(_ARTICLES)}
), unit AS (
  SELECT 'text' AS kind, license_id AS id, string_split(t, chr(10)) AS lines FROM (VALUES {rows(TEXTS)}) v(license_id, t)
  UNION ALL SELECT 'notice', name, [p || ' ' || a || ' ' || spelled] FROM named, phrase, article
  UNION ALL SELECT DISTINCT 'notice', name, ['SPDX-License-Identifier: ' || name || e] FROM named, (VALUES (''), ('-only'), ('-or-later')) s(e)
  UNION ALL SELECT 'whole', doc_id::VARCHAR, lines FROM doc
  UNION ALL SELECT 'line', doc_id::VARCHAR, [x] FROM (SELECT doc_id, unnest(lines) AS x FROM doc) WHERE regexp_matches(lower(x), 'licen[cs]e|under')
), said AS (
  SELECT kind, id, lower(array_to_string(list_filter(lines, lambda x: NOT regexp_matches(x, '^[ \t#*/;-]*((copyright[ \t]*(\(c\)|:|©|by |\d\d\d\d|\[yyyy|<year>))|((©|\(c\))[ \t]*\d\d\d\d)|all rights reserved)', 'i')), chr(10))) AS t FROM unit
), spelt AS (
  SELECT kind, id, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(t, 'licence', 'license'), 'favour', 'favor'), 'honour', 'honor'), 'organisation', 'organization'), 'judgement', 'judgment'),
    'merchantibility', 'merchantability'), 'non-commercial', 'noncommercial'), 'sub-license', 'sublicense'), 'copyright holder', 'copyright owner'), 'https:', 'http:') AS t FROM said
), hashed AS (SELECT kind, id, sha256(array_to_string(regexp_extract_all(t, '[\p{{L}}\p{{N}}]+'), ' ')) AS digest FROM spelt
), known AS (SELECT digest, min(id) AS license_id FROM (SELECT digest, id FROM hashed WHERE kind = 'text' UNION ALL SELECT digest, id FROM (VALUES {rows(DIGESTS)}) v(id, digest)) GROUP BY digest
), notice AS (SELECT digest, min(id) AS name FROM hashed WHERE kind = 'notice' GROUP BY digest
), f AS (SELECT h.id, string_agg(DISTINCT name, ',' ORDER BY name) AS notices FROM hashed h JOIN notice USING (digest) WHERE kind = 'line' GROUP BY h.id)
SELECT doc_id, digest AS canonical_sha256, license_id, coalesce(notices, '') AS notices
FROM doc JOIN (SELECT id, digest FROM hashed WHERE kind = 'whole') w ON w.id = doc_id::VARCHAR LEFT JOIN known USING (digest) LEFT JOIN f ON f.id = doc_id::VARCHAR
"""


#: 5 % of a host's documents and more than 5 of them; half of the words must remain.
_QUALITY_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3
), t AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2]) AS n FROM p
), r AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, i + k AS at FROM t, range(0, 3) g(k) WHERE n > 1) GROUP BY doc_id
), l AS (
  SELECT doc_id, host, line, len(words) AS words, array_to_string(list_transform(words, lambda x: regexp_replace(lower(x), '[0-9]', '0', 'g')), ' ') AS key
  FROM (SELECT doc_id, host, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS words FROM (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM w)) WHERE len(words) > 0
), u AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY doc_id
), h AS (SELECT host, count(DISTINCT doc_id) AS size FROM w GROUP BY host
), c AS (SELECT host, key FROM l JOIN h USING (host) GROUP BY host, key, size HAVING count(DISTINCT doc_id) > 5 AND count(DISTINCT doc_id) > 0.05 * size
), g AS (SELECT doc_id, sum(words)::BIGINT AS removed FROM l JOIN c USING (host, key) GROUP BY doc_id
), m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(removed, 0)::BIGINT AS removed_words
  FROM w LEFT JOIN r USING (doc_id) LEFT JOIN u USING (doc_id) LEFT JOIN g USING (doc_id)
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND 2 * removed_words <= n_words AS kept FROM b
"""

#: Lines, their draws, the three pieces and both written forms; the digest of the rebuilt text is that of the text.
_FIM_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS ls, sha256('7:' || doc_id::VARCHAR) AS h FROM documents
), r AS (
  SELECT *, len(ls) AS n, [('0x' || substr(h, 1 + 8 * k, 8))::BIGINT for k in range(4)] AS q FROM d
), c AS (
  SELECT *, least(q[1] % (n + 1), q[2] % (n + 1)) AS a, greatest(q[1] % (n + 1), q[2] % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR q[3] % 100 >= 100 THEN 'plain' WHEN q[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM r
), p AS (
  SELECT *, array_to_string(ls[1:a], '') AS pre, array_to_string(ls[a + 1:b], '') AS mid, array_to_string(ls[b + 1:n], '') AS suf FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE pre || mid || suf END) AS restored_sha256
FROM p
"""

SQL: dict[str, str] = {
    "op11_fill_in_middle": _FIM_SQL,
    "op3_url_filter": r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r AS (
  SELECT *, CASE
    WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
""",
    "op9_quality_rules": _QUALITY_SQL,
    "op10_licences": _licence_sql(),
}
