"""The registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ann, binary_output, bpe_codec, conversations, language_id, lm_scoring, media, merkle, mixing, near_dedup, packing, token_counts, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(_table(spark, sf_dir, "documents"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(_table(spark, sf_dir, "documents"))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_output.token_id_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.checked_manifest(_table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.damage_and_repair(_table(spark, sf_dir, "conversations"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


#: Sources in order of size per weight fill up to their caps; the first that does not gives the unit of all others.
#: Packets of 64 words of all passes are served by finish time until the budget is spent.
MIXING_SQL = r"""
WITH measured AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(concat_ws(' ', doc_id::BIGINT, md5(text))), 1, 15))::BIGINT AS place FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS number FROM measured GROUP BY source),
weighed AS (SELECT *, [5.0::DOUBLE, 2, 1][(number - 1) % 3 + 1] AS weight FROM sources),
units AS (
  SELECT *, row_number() OVER before AS fill,
    (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER before, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS unit
  FROM weighed WINDOW before AS (ORDER BY source_size / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT arg_min(unit, fill) AS unit FROM units WHERE weight * unit <= 3 * source_size),
targets AS (SELECT source, number, source_size, least(weight * level.unit, (3 * source_size)::DOUBLE) AS target FROM weighed, level),
placed AS (
  SELECT m.*, number, source_size, target, row_number() OVER () AS id, (sum(size) OVER (PARTITION BY m.source ORDER BY place, doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS ended
  FROM measured m JOIN targets t ON m.source IS NOT DISTINCT FROM t.source),
packets AS (
  SELECT id, number, target, turn, least(64, size - packet * 64) AS words, turn * source_size + ended - size + least((packet + 1) * 64, size) AS reached
  FROM (SELECT *, unnest(range((size + 63) // 64)) AS packet FROM placed), (SELECT unnest([0, 1, 2]) AS turn)),
served AS (
  SELECT id, turn, greatest(0, least(words, (SELECT sum(source_size) FROM sources) - sum(words) OVER (ORDER BY reached::DOUBLE / target, number, reached ROWS UNBOUNDED PRECEDING) + words)) AS words
  FROM packets),
turns AS (SELECT id, turn, sum(words) AS words FROM served GROUP BY id, turn),
taken AS (SELECT t.id, sum(words)::BIGINT AS taken, sum((2 * words >= size)::INTEGER)::INTEGER AS copies FROM turns t JOIN placed USING (id) GROUP BY t.id)
SELECT doc_id, place AS "order", size, source_size, target, coalesce(copies, 0)::INTEGER AS copies, ended::DOUBLE / nullif(target, 0) AS finish, coalesce(taken, 0)::BIGINT AS taken
FROM placed LEFT JOIN taken USING (id)
"""


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a string in SQL: each byte is added, then shifted out bit by bit."""
    steps = f"list_concat([4294967295::BIGINT], flatten(list_transform(range(octet_length(encode({text}))), lambda j: [('0x' || substr(hex(encode({text})), 2 * j + 1, 2))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])))"
    return f"xor(4294967295, list_reduce({steps}, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END))"


def _merkle_levels(name: str, nodes: str, levels: int) -> str:
    """CTEs from nodes (g, i, h) to {name}root (g, h) and {name}path (g, at, path) of each node's place."""
    sql = [f"{name}n0 AS (SELECT g, i, h, count(*) OVER (PARTITION BY g) AS n FROM {nodes})", f"{name}p0 AS (SELECT g, i AS place, i, []::VARCHAR[] AS path FROM {nodes})"]
    for j in range(levels):
        sql += [
            f"{name}r{j} AS (SELECT g, i // 8 AS i, string_agg(h, '' ORDER BY i) AS run, any_value(n) AS n FROM {name}n{j} GROUP BY g, i // 8)",
            f"{name}n{j + 1} AS (SELECT g, i, CASE WHEN n > 1 THEN sha256(run) ELSE run END AS h, count(*) OVER (PARTITION BY g) AS n FROM {name}r{j})",
            f"{name}p{j + 1} AS (SELECT p.g, place, r.i, CASE WHEN n > 1 THEN list_append(path, substr(run, 1, 64 * (p.i % 8)) || '|' || substr(run, 64 * (p.i % 8) + 65)) ELSE path END AS path FROM {name}p{j} p JOIN {name}r{j} r ON r.g = p.g AND r.i = p.i // 8)",
        ]
    return ",\n".join([*sql, f"{name}root AS (SELECT g, h FROM {name}n{levels})", f"{name}path AS (SELECT g, place, path FROM {name}p{levels})"])


_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || " + _FIELD + ")"
#: Levels enough for 8**9 rows of a language and 8**4 languages.
MERKLE_SQL = f"""
WITH leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, {_LEAF.format('text')} AS h,
    CASE WHEN {crc32_sql('doc_id::VARCHAR')} % 3 = 0 THEN {_LEAF.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed FROM documents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM leaves),
{_merkle_levels('a', 'numbered', 9)},
groups AS (SELECT '' AS g, g AS name, h, row_number() OVER (ORDER BY g) - 1 AS i FROM aroot),
{_merkle_levels('b', 'groups', 4)},
whole AS (
  SELECT l.doc_id, l.h AS leaf, g.h AS subroot, broot.h AS root, list_concat(apath.path, bpath.path) AS path, coalesce(l.changed, l.h) AS start
  FROM numbered l JOIN apath ON apath.g = l.g AND apath.place = l.i JOIN groups g ON g.name = l.g JOIN bpath ON bpath.place = g.i, broot),
ended AS (SELECT *, list_reduce(list_prepend(start, path), lambda digest, x: sha256(replace(x, '|', digest))) AS folded_root FROM whole)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM ended
"""


def _repair_sql() -> str:
    """One walk over each conversation's turns: the cheapest (cost, audit, turns) in each state, nothing yet, s, u or a."""
    way = lambda q, cost, audit, turns: f"CASE WHEN s{q} IS NOT NULL THEN {{'c': s{q}.c + {cost}, 'a': s{q}.a || {audit}, 't': list_concat(s{q}.t, {turns}::VARCHAR[])}} END"
    least = lambda *ways: f"list_sort(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))[1]"
    deleted = [way(q, 2, "'D'", "[]") for q in range(4)]
    lines = {"": "[]", "u": "['user:']", "a": "['assistant:']", "ua": "['user:', 'assistant:']"}

    def retained(role: str, name: str, inserted: tuple[str, ...]) -> str:
        own = f"(first = '{role}')"
        edit, line = f"CASE WHEN {own} THEN 'K' ELSE 'R' END", f"CASE WHEN {own} THEN role ELSE '{name}' END || ':' || text"
        return least(deleted[" sua".index(role)], *(f"CASE WHEN NOT gone THEN {way(q, f'{5 * len(x)} + cut + CASE WHEN {own} THEN 0 ELSE 1 END', f'{chr(39)}{chr(73) * len(x)}{chr(39)} || {edit}', f'list_append({lines[x]}, {line})')} END" for q, x in enumerate(inserted)))

    kept_s = f"CASE WHEN NOT gone AND first = 's' THEN {way(0, 'cut', chr(39) + 'K' + chr(39), "[role || ':' || text]")} END"
    ends = least(*(way(q, 5 * len(x), f"'{'I' * len(x)}'", lines[x]) for q, x in enumerate(("", "ua", "a", ""))))
    kind = "STRUCT(c BIGINT, a VARCHAR, t VARCHAR[])"
    return rf"""
WITH RECURSIVE hit AS (SELECT *, {crc32_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text FROM hit WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS stem, left(role, 1) AS first FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS again FROM placed),
told AS (SELECT *, CASE WHEN stem = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN right(stem, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM seen),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 't': []}}::{kind} AS s0, NULL::{kind} AS s1, NULL::{kind} AS s2, NULL::{kind} AS s3 FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, {deleted[0]}, {least(deleted[1], kept_s)}, {retained('u', 'user', ('', '', 'a', ''))}, {retained('a', 'assistant', ('u', 'u', '', 'u'))}
  FROM (SELECT w.* EXCLUDE (i), t.i, t.role, t.text, t.first, t.fault IN ('blank', 'duplicate') AS gone, CASE WHEN t.fault = 'truncated' THEN 5 ELSE 0 END AS cut FROM walk w JOIN told t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i + 1)),
ended AS (SELECT conv_id, {ends} AS best FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
pairs AS (SELECT *, lag(first) OVER (PARTITION BY conv_id ORDER BY i) || first AS pair FROM told),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count_if(fault = 'blank')::BIGINT AS blank, count_if(fault = 'duplicate')::BIGINT AS duplicate,
    count_if(fault = 'truncated')::BIGINT AS truncated, count_if(pair NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal FROM pairs GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  best.c AS cost, best.a AS audit, sha256(array_to_string(best.t, chr(10))) AS repaired_sha256
FROM ended e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_mixing": MIXING_SQL, "op11_merkle_manifest": MERKLE_SQL, "op12_conversation_repair": _repair_sql()}
