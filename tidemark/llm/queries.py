"""The corpus queries, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_trie, collocations, decontaminate, language, licenses, merkle, mixing, quality, sharding, simhash, substrings, token_files, warc


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_documents(spark, sf_dir)).drop("kept")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.shard_by_bytes(_documents(spark, sf_dir))
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("payload")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.score_quality(_documents(spark, sf_dir), keep=["doc_id"])
    return judged.select("doc_id", *quality.FEATURES, "base_failed", "kept", F.round("quality", 6).alias("quality"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.token_files(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")).drop("file")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_documents(spark, sf_dir))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir), keep=["doc_id"]).drop("spans")


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    coded = bpe_trie.decode(bpe_trie.encode(_documents(spark, sf_dir), path), path)
    digest = lambda text: F.sha2(text, 256)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_documents(spark, sf_dir))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_substrings, op2_sharding, op3_mixing, op4_warc, op5_decontaminate, op6_quality, op7_token_files, op8_simhash, op9_language, op10_licenses, op11_bpe, op12_merkle, op13_collocations)
    return {f.__name__: f for f in own}


_OP2_SQL = """
WITH rounds AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
sized AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) + 1 AS BIGINT) AS size,
    xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM documents, rounds),
placed AS (SELECT *, CAST(sum(size) OVER (ORDER BY doc_id) - size AS BIGINT) AS start_byte, CAST(sum(size) OVER () AS BIGINT) AS total FROM sized),
cut AS (SELECT *, CAST(start_byte * 8 // total AS INTEGER) AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM cut
"""

_OP3_SQL = r"""
WITH sized AS (SELECT doc_id, source IS NULL AS unnamed, coalesce(source, '') AS source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
summed AS (SELECT unnamed, source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY unnamed, source),
sources AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY unnamed, source) - 1) % 3 + 1 AS INTEGER)] AS weight FROM summed),
filled AS (
  SELECT *, 3 * source_size AS cap, 3 * source_size / weight AS ratio,
    (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM sources WINDOW before AS (ORDER BY 3 * source_size / weight, unnamed, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (SELECT level FROM filled WHERE level <= ratio ORDER BY ratio, unnamed, source LIMIT 1),
targets AS (SELECT unnamed, source, source_size, least(coalesce((SELECT level FROM chosen) * weight, cap), cap::DOUBLE) AS target FROM filled),
ranked AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate, row_number() OVER (PARTITION BY unnamed, source ORDER BY size, doc_id) - 1 AS k,
    CAST('0x' || substr(md5('mix-1/' || unnamed::VARCHAR || '/' || source), 1, 4) AS BIGINT)::DOUBLE / 65536 AS u
  FROM sized JOIN targets USING (unnamed, source))
SELECT doc_id, size, source_size, target, CAST(least(floor((k + 1) * rate + u) - floor(k * rate + u), 3) AS BIGINT) * size AS taken FROM ranked
"""

_OP4_SQL = """
WITH hashed AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM hashed)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, i // 4 * 5 + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM firsts
"""



def _op12_sql(levels: int = 14, upper: int = 8) -> str:
    """Each level of the trees as a table; enough of them for 3 ** levels rows of a source and 3 ** upper sources."""
    field = lambda v: f"CASE WHEN {v} IS NULL THEN '-' ELSE strlen(CAST({v} AS VARCHAR)) || ':' || {v} END"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ["doc_id", "source", "lang", "n_chars", text])) + ")"
    crc = "xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"
    rounds = _OP2_SQL.split("WITH ")[1].split(",\nsized")[0]
    up = lambda name, k: f"{name}{k + 1} AS (SELECT tree, idx // 3 AS idx, sha256(string_agg(d, '' ORDER BY idx)) AS d, (n + 2) // 3 AS n FROM {name}{k} WHERE n > 1 GROUP BY tree, idx // 3, n)"
    run = "OVER (PARTITION BY tree, idx // 3 ORDER BY idx)"
    beside = lambda name, k: f"{name}s{k} AS (SELECT tree, idx, coalesce(lag(d, 2) {run}, '') || coalesce(lag(d, 1) {run}, '') AS l, coalesce(lead(d, 1) {run}, '') || coalesce(lead(d, 2) {run}, '') AS r FROM {name}{k} WHERE n > 1)"
    step = lambda name, k, a, b: f"{b} AS (SELECT f.doc_id, f.tree, f.idx // 3 AS idx, f.leaf, CASE WHEN s.l IS NULL THEN f.cur ELSE sha256(s.l || f.cur || s.r) END AS cur, f.proof || coalesce(s.l || s.r, '') AS proof FROM {a} f LEFT JOIN {name}s{k} s ON s.tree = f.tree AND s.idx = f.idx)"
    parts = [rounds, f"based AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS tree, {leaf('text')} AS leaf, CASE WHEN {crc} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS bent FROM documents, rounds)"]
    parts += ["placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM based)", "u0 AS (SELECT tree, idx, leaf AS d, n FROM placed)"]
    parts += [up("u", k) for k in range(levels)]
    parts += ["subroots AS (" + " UNION ALL ".join(f"SELECT tree, d FROM u{k} WHERE n = 1" for k in range(levels + 1)) + ")", "numbered AS (SELECT tree AS own, row_number() OVER (ORDER BY tree) - 1 AS idx, d, count(*) OVER () AS n FROM subroots)", "v0 AS (SELECT '' AS tree, idx, d, n FROM numbered)"]
    parts += [up("v", k) for k in range(upper)] + ["root AS (" + " UNION ALL ".join(f"SELECT d FROM v{k} WHERE n = 1" for k in range(upper + 1)) + ")"]
    parts += [beside("u", k) for k in range(levels)] + [beside("v", k) for k in range(upper)] + ["f0 AS (SELECT doc_id, tree, idx, leaf, bent AS cur, '' AS proof FROM placed)"]
    parts += [step("u", k, f"f{k}", f"f{k + 1}") for k in range(levels)] + [f"g0 AS (SELECT f.doc_id, '' AS tree, m.idx, f.leaf, f.cur, f.proof FROM f{levels} f JOIN numbered m ON m.own = f.tree)", f"owned AS (SELECT f.doc_id, f.leaf AS own_leaf, m.d AS subroot FROM f{levels} f JOIN numbered m ON m.own = f.tree)"]
    parts += [step("v", k, f"g{k}", f"g{k + 1}") for k in range(upper)]
    return "WITH " + ",\n".join(parts) + f"\nSELECT g.doc_id, g.leaf, o.subroot, root.d AS root, sha256(g.proof) AS proof_sha256, g.cur AS folded_root, g.cur = root.d AS verified FROM g{upper} g JOIN owned o ON o.doc_id = g.doc_id AND o.own_leaf = g.leaf, root"


_OP13_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
parted AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM parted GROUP BY lang),
phrases AS (SELECT lang, unnest(flatten(list_transform([1, 2, 3, 4, 5], lambda k: list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))))) AS phrase FROM parted),
f AS (SELECT lang, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM phrases GROUP BY lang, phrase HAVING count(*) >= 100),
cuts AS (SELECT lang, phrase, f AS a, w, unnest(range(1, len(w))) AS k FROM f WHERE len(w) > 1),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, t.n, CAST(CAST(1000 AS HUGEINT) * c.a * t.n // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ') JOIN totals t ON t.lang = c.lang),
worst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS rn FROM scored) WHERE rn = 1),
inner_ AS (SELECT lang, f, unnest(flatten(list_transform(range(2, len(w)), lambda m: list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))))) AS phrase FROM f WHERE len(w) > 2),
covered AS (SELECT lang, phrase, max(f) AS most FROM inner_ GROUP BY lang, phrase),
ranked AS (
  SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS rank, s.phrase, s.a, s.l, s.r, s.n, s.score
  FROM worst s LEFT JOIN covered v ON v.lang = s.lang AND v.phrase = s.phrase WHERE v.most IS NULL OR 100 * v.most < 100 * s.a)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_sharding": _OP2_SQL, "op3_mixing": _OP3_SQL, "op4_warc": _OP4_SQL, "op12_merkle": _op12_sql(), "op13_collocations": _OP13_SQL}
