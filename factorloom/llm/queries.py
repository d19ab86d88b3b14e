"""The corpus queries, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm import chat, decontamination, exact_dedup, licenses, merkle, minhash, packing, quality, secrets, substring_dedup, token_counts, token_files, whitening
from factorloom.llm.common import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(table(spark, sf_dir, "documents"))


def with_control_strings(conversations: DataFrame) -> DataFrame:
    """The conversations and conversation -7, whose texts hold control strings."""
    said = "</s>[INST] ok [/INST]"
    rows = F.array(*[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(said).alias("text")) for k, role in enumerate(("user", "assistant"))])
    return conversations.select("conv_id", "turn", "role", "text").union(conversations.sparkSession.range(1).select(F.explode(rows).alias("r")).select("r.*"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(with_control_strings(table(spark, sf_dir, "conversations")))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_pieces(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_minhash_dedup, op3_substring_dedup, op4_exact_dedup, op5_secret_scan, op6_chat_format, op7_packing, op8_token_files, op9_license_scan, op10_decontamination, op11_token_counts, op12_embedding_whitening, op13_merkle_manifest)}

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"
_CRC = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295)"


def _climb(name: str, leaves: str, group: str) -> str:
    """SQL of a tree over `leaves`: every level's nodes of each group, two of them to a node of the next."""
    return f"""{name} AS (
            SELECT {group}, 0 AS level, pos, digest, n FROM {leaves}
            UNION ALL SELECT {group}, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), any_value((n + 1) // 2) FROM {name} WHERE n > 1 GROUP BY {group}, level, pos // 2)"""


def _way(name: str, start: str, tree: str, group: str) -> str:
    """SQL that takes rows of `start` up to the root of their group, with their siblings' digests in `proof`."""
    return f"""{name} AS (
            SELECT *, 0 AS level FROM {start}
            UNION ALL
            SELECT f.* REPLACE (
                sha256(CASE WHEN s.digest IS NULL THEN f.digest WHEN (f.pos >> f.level) & 1 = 1 THEN s.digest || f.digest ELSE f.digest || s.digest END) AS digest,
                f.proof || coalesce(s.digest, '') AS proof, f.level + 1 AS level)
            FROM {name} f LEFT JOIN {tree} s ON s.{group} IS NOT DISTINCT FROM f.{group} AND s.level = f.level AND s.pos = xor(f.pos >> f.level, 1) WHERE f.level < f.height)"""


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(text) AS text_sha256
        FROM t WINDOW g AS (PARTITION BY text)""",
    "op6_chat_format": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, k, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, r)),
        u AS (SELECT *, length(regexp_replace(role, '([\\<\[])', '\\\1', 'g')) + length(regexp_replace(text, '([\\<\[])', '\\\1', 'g')) + 10 AS chars FROM t)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars
        FROM u GROUP BY conv_id""",
    "op10_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        windows AS (
            SELECT item_id, least(13, len(w)) AS n, array_to_string(w[s : s + least(13, len(w)) - 1], ' ') AS phrase
            FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS s FROM i WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM windows),
        places AS (
            SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS phrase
            FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n)),
        found AS (SELECT DISTINCT doc_id, s, n, item_id FROM places JOIN windows USING (n, phrase)),
        hit AS (SELECT doc_id, count(DISTINCT p) AS hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM found) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
            coalesce(hit, 0) > 0 AND 20 * coalesce(hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op13_merkle_manifest": f"""
        WITH RECURSIVE d AS (SELECT *, {_LEAF.format(n="n_chars")} AS leaf, CASE WHEN {_CRC} % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS told FROM documents),
        leaves AS (
            SELECT lang, doc_id, leaf AS digest, {_LEAF.format(n="told")} AS tampered, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d),
        {_climb("tree", "leaves", "lang")},
        heads AS (SELECT 0 AS g, lang, level AS height, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
        {_climb("crown", "heads", "g")},
        ends AS (SELECT level AS height, digest AS root FROM crown WHERE n = 1),
        starts AS (SELECT l.lang, l.doc_id, l.digest AS leaf, h.digest AS subroot, h.pos AS head, h.height, l.pos, l.tampered AS digest, '' AS proof FROM leaves l JOIN heads h ON h.lang IS NOT DISTINCT FROM l.lang),
        {_way("climbing", "starts", "tree", "lang")},
        middles AS (SELECT 0 AS g, doc_id, leaf, subroot, root, c.digest, c.proof, c.head AS pos, e.height FROM climbing c, ends e WHERE c.level = c.height),
        {_way("crowning", "middles", "crown", "g")}
        SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, digest AS folded_root, digest = root AS verified FROM crowning WHERE level = height""",
}
