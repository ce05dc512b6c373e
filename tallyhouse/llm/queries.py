"""The operators over the given tables, and DuckDB SQL for those it can express."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import align, brown, bytecnn, cuckoo, jaccard, merkle, mixing, packing, phrases, sharding, simhash, temporal, weighted
from tallyhouse.llm.common import Query, documents


def op1_cuckoo_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuckoo.exact_dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.harmonic_pack(documents(spark, sf_dir), tokenizer()).drop("ids")


def op3_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op4_brown_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.class_scores(documents(spark, sf_dir), bytecnn.remainder(F.col("doc_id"), 10) == 0)


def op5_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted.weighted_fingerprints(documents(spark, sf_dir))


def number_of(text: Column) -> Column:
    """24 bits of a text's MD5, which DuckDB computes alike."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 6), 16, 10).cast("int")


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as captures: the page id sets the fetch day."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(730)).cast("int"))
    return pages.select("page_id", "url", day.alias("fetched_on"))


def list_entries(rows: DataFrame) -> DataFrame:
    """A dated list of hosts, their parent domains and first path segments, derived from the captures.

    A number from the key's hash chooses category and days: listed, withdrawn and perhaps listed again.
    """
    host, segment = temporal.host_of(F.col("url")), temporal.segment_of(F.col("url"))
    parent = F.regexp_replace(host, r"^[^.]+\.", "")
    keys = rows.select(F.explode(F.array(host, parent, F.concat(host, F.lit("/"), segment))).alias("key")).distinct()
    keys = keys.withColumn("v", number_of(F.col("key"))).filter("v % 3 <> 0")
    first = F.date_add(F.lit("2024-01-01").cast("date"), F.col("v") % 400)
    end = F.date_add(first, 20 + F.col("v") % 170)
    again = F.date_add(end, 10 + F.col("v") % 110)
    entry = lambda action, day: F.struct(F.lit(action).alias("action"), day.alias("listed_on"))
    log = F.array(entry("add", first), entry("remove", end), F.when(F.col("v") % 2 == 0, entry("add", again)))
    category = F.element_at(F.array(*map(F.lit, ("spam", "malware", "adult", "tracker"))), F.col("v") % 4 + 1)
    return keys.select("key", category.alias("category"), F.explode(F.array_compact(log)).alias("e")).select("key", "category", "e.*")


def op6_temporal_list_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = captures(spark, sf_dir)
    return temporal.temporal_filter(rows, list_entries(rows))


def op7_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.recurring_passages(documents(spark, sf_dir)).drop("spans")


def op8_simhash_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_dedup(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def language_held_out() -> Column:
    """Whether a row's language is predicted but not learned from."""
    return bytecnn.remainder(F.col("doc_id"), 4) == 2


def op9_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = bytecnn.identify(docs, bytecnn.fit(docs, ~language_held_out()))
    return found.select("doc_id", language_held_out().alias("held_out"), "lang_pred", "score")


def op10_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.balanced_shards(documents(spark, sf_dir))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return merkle.manifest(documents(spark, sf_dir), tampered).drop("path")


def crc32_steps() -> list[int]:
    """What four bits add to a CRC-32."""
    steps = []
    for value in range(16):
        for _ in range(4):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        steps.append(value)
    return steps


def alignment_files() -> tuple[bytes, str, bytes]:
    """Contents of both tokenizers' files; executors need no file of their own."""
    import public_tokenizers

    byte_bpe, pieces = (Path(public_tokenizers.path(x)).read_bytes() for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return byte_bpe, public_tokenizers.PATTERN, pieces


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(documents(spark, sf_dir), alignment_files())


QUERIES: dict[str, Query] = {
    "op1_cuckoo_dedup": op1_cuckoo_dedup,
    "op2_harmonic_packing": op2_harmonic_packing,
    "op3_entropy_mixing": op3_entropy_mixing,
    "op4_brown_scores": op4_brown_scores,
    "op5_weighted_sampling": op5_weighted_sampling,
    "op6_temporal_list_join": op6_temporal_list_join,
    "op7_phrase_automata": op7_phrase_automata,
    "op8_simhash_pigeonhole": op8_simhash_pigeonhole,
    "op9_byte_cnn_language": op9_byte_cnn_language,
    "op10_label_propagation": op10_label_propagation,
    "op11_ngram_jaccard_join": op11_ngram_jaccard_join,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_token_alignment": op13_token_alignment,
}

ORACLES: dict[str, str] = {
    "op1_cuckoo_dedup": """
        WITH d AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
            FROM documents
        )
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)
    """,
    "op6_temporal_list_join": r"""
        WITH captures AS (
            SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 730 AS INT) AS fetched_on,
                lower(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '')) AS host,
                coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1), '') AS segment
            FROM pages
        ), keys AS (
            SELECT key, CAST('0x' || substr(md5(key), 1, 6) AS INT) AS v FROM (
                SELECT host AS key FROM captures
                UNION SELECT regexp_replace(host, '^[^.]+[.]', '') FROM captures
                UNION SELECT host || '/' || segment FROM captures)
        ), listed AS (
            SELECT key, v, ['spam', 'malware', 'adult', 'tracker'][v % 4 + 1] AS category, DATE '2024-01-01' + v % 400 AS first_on
            FROM keys WHERE v % 3 <> 0
        ), spans AS (
            SELECT key, category, first_on AS valid_from, first_on + (20 + v % 170) AS valid_to FROM listed
            UNION ALL
            SELECT key, category, first_on + (20 + v % 170) + (10 + v % 110), DATE '9999-01-01' FROM listed WHERE v % 2 = 0
        ), candidates AS (
            SELECT page_id, fetched_on, unnest(
                list_transform(range(1, greatest(2, len(string_split(host, '.')))), lambda k: array_to_string(string_split(host, '.')[k:], '.'))
                || CASE WHEN segment <> '' THEN [host || '/' || segment] ELSE [] END) AS key
            FROM captures WHERE host <> ''
        ), verdicts AS (
            SELECT page_id, count(*) AS n_active, string_agg(DISTINCT category, ',' ORDER BY category) AS categories
            FROM candidates JOIN spans USING (key) WHERE fetched_on >= valid_from AND fetched_on < valid_to GROUP BY page_id
        )
        SELECT page_id, url, fetched_on, host, coalesce(n_active, 0) AS n_active, coalesce(categories, '') AS categories, n_active IS NOT NULL AS blocked
        FROM captures LEFT JOIN verdicts USING (page_id)
    """,
    "op11_ngram_jaccard_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS grams
            FROM words
        ), entries AS (
            SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM sets
        ), links AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM entries a JOIN entries b USING (gram) WHERE a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
        ), reached AS (
            SELECT doc_id, doc_id AS other FROM sets
            UNION
            SELECT doc_id, b FROM reached JOIN links ON a = other
        )
        SELECT doc_id, len(grams) AS n_shingles, component_id
        FROM sets JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) USING (doc_id)
    """,
    "op12_merkle_manifest": f"""
        WITH RECURSIVE fields AS (
            SELECT doc_id, lang, n_chars, [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), text] AS f,
                xor(list_reduce(
                    list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) & 15 AS BIGINT), CAST(ascii(c) >> 4 AS BIGINT)]))),
                    lambda a, x: xor({crc32_steps()}[(xor(a, x) & 15) + 1], a >> 4)), 4294967295) % 7 = 0 AS tampered
            FROM documents
        ), leaves AS (
            SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n,
                sha256(array_to_string(list_transform(f, lambda x: coalesce(strlen(x) || ':' || x, '-')), '')) AS leaf,
                CASE WHEN tampered AND n_chars IS NOT NULL THEN sha256(array_to_string(list_transform(f[:3] || [CAST(n_chars + 1 AS VARCHAR)] || f[5:],
                    lambda x: coalesce(strlen(x) || ':' || x, '-')), '')) END AS changed
            FROM fields
        ), nodes AS (
            SELECT lang, 0 AS level, i, n, leaf AS digest FROM leaves
            UNION ALL
            SELECT lang, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY lang, level, i // 2, n
        ), trees AS (
            SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1
        ), tops AS (
            SELECT 0 AS level, i, n, subroot AS digest FROM trees
            UNION ALL
            SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, i // 2, n
        ), lower_path AS (
            SELECT doc_id, lang, 0 AS level, i, n, '' AS proof, coalesce(changed, leaf) AS folded FROM leaves
            UNION ALL
            SELECT doc_id, p.lang, p.level + 1, p.i // 2, (p.n + 1) // 2, proof || coalesce(s.digest, ''),
                sha256(CASE WHEN p.i % 2 = 1 THEN s.digest || folded ELSE folded || coalesce(s.digest, '') END)
            FROM lower_path p LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM p.lang AND s.level = p.level AND s.i = xor(p.i, 1) WHERE p.n > 1
        ), upper_path AS (
            SELECT doc_id, subroot, 0 AS level, t.i, t.n, proof, folded FROM lower_path p JOIN trees t ON t.lang IS NOT DISTINCT FROM p.lang WHERE p.n = 1
            UNION ALL
            SELECT doc_id, subroot, p.level + 1, p.i // 2, (p.n + 1) // 2, proof || coalesce(s.digest, ''),
                sha256(CASE WHEN p.i % 2 = 1 THEN s.digest || folded ELSE folded || coalesce(s.digest, '') END)
            FROM upper_path p LEFT JOIN tops s ON s.level = p.level AND s.i = xor(p.i, 1) WHERE p.n > 1
        )
        SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
        FROM upper_path JOIN leaves USING (doc_id), (SELECT digest AS root FROM tops WHERE n = 1) WHERE upper_path.n = 1
    """,
}
