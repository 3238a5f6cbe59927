"""Registered queries of the corpus operators over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurelake.llm import (decontamination, fingerprints, jaccard, licenses, lines, mainblocks, merkle, packing, quality,
                          resampling, sharding, substrings, toxicity)
from lurelake.llm.common import documents, fold

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


# ---- 1 sharding ---------------------------------------------------------------------------------

SHARDS = 24


def _shard_sql(shards: int) -> str:
    draw = "-ln((('0x' || substr(md5(k || ':' || s), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)"
    return (f"(SELECT doc_id, k, arg_min(s, {draw}) AS shard FROM docs, range({shards}) r(s) "
            "GROUP BY doc_id, k)")


SHARD_SQL = f"""
WITH docs AS (SELECT DISTINCT doc_id, coalesce(doc_id::VARCHAR, '') AS k FROM documents),
bits AS (SELECT list(list_reduce([i] || [1,1,1,1,1,1,1,1], lambda c, b:
    CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t
    FROM (SELECT unnest(range(256))::BIGINT AS i)),
body AS (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) AS n FROM documents),
hexed AS (SELECT doc_id, n, hex(encode(text)) AS h FROM body),
summed AS (SELECT doc_id, (n + 8)::BIGINT AS size, xor(4294967295, list_reduce(
    [4294967295::BIGINT] || list_transform(range(n), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
    lambda c, b: xor(t[xor(c & 255, b) + 1], c // 256))) AS text_crc32 FROM hexed, bits),
a AS {_shard_sql(SHARDS)}, g AS {_shard_sql(SHARDS + 1)}
SELECT s.doc_id, s.size, s.text_crc32, 'key' AS law, a.shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY a.shard ORDER BY ('0x' || substr(md5(a.k), 25, 8))::BIGINT,
    s.doc_id, s.size, s.text_crc32) - 1 AS slot, g.shard::INTEGER AS grown_shard
FROM summed s JOIN a USING (doc_id) JOIN g USING (doc_id)
"""


@query("op1_sharding", SHARD_SQL)
def op1_sharding(spark, sf_dir):
    rows = sharding.shard_rows(documents(spark, sf_dir), [1.0] * SHARDS, [1.0] * (SHARDS + 1))
    return rows.withColumn("law", F.lit("key"))


# ---- 3 licences ---------------------------------------------------------------------------------

def _values(pairs) -> str:
    return ", ".join(f"('{a}', '{b}')" for a, b in pairs)


LICENSE_SQL = f"""
WITH known(id, s) AS (VALUES {_values(licenses.SENTENCES)}),
rules(r, licence) AS (VALUES {_values(licenses.RULES)}),
parts AS (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM (
  SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '{licenses.SENTENCE_END}') AS p FROM documents)),
norm AS (SELECT doc_id, i, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) AS s FROM parts),
seqs AS (SELECT doc_id, count(*) AS n, string_agg(coalesce(id, '-'), '' ORDER BY i) AS q
  FROM norm LEFT JOIN known USING (s) WHERE s <> '' GROUP BY doc_id),
dots AS (SELECT doc_id, n, regexp_replace(regexp_replace(regexp_replace(q,
  '{"-" * (licenses.MAX_GAP + 1)}-*', '.', 'g'), '-', '', 'g'), '^\\.|\\.$', '', 'g') AS q FROM seqs),
hits AS (SELECT doc_id, regexp_extract_all(q, '({"|".join(r for r, _ in licenses.RULES)})', 1) AS h FROM dots),
named AS (SELECT doc_id, string_agg(DISTINCT licence, ' ' ORDER BY licence) AS l
  FROM (SELECT doc_id, unnest(h) AS r FROM hits) JOIN rules USING (r) GROUP BY doc_id)
SELECT d.doc_id, coalesce(dots.n, 0)::BIGINT AS n_sentences, coalesce(dots.q, '') AS sentence_ids,
  coalesce(array_to_string(hits.h, ' '), '') AS license_rules, coalesce(named.l, '') AS licenses
FROM documents d LEFT JOIN dots USING (doc_id) LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query("op3_license_scan", LICENSE_SQL)
def op3_license_scan(spark, sf_dir):
    found = licenses.recognise_licenses(documents(spark, sf_dir))
    return found.select("doc_id", "n_sentences", "sentence_ids", "license_rules", "licenses")


# ---- 8 fingerprints -----------------------------------------------------------------------------

@query("op8_fingerprints")
def op8_fingerprints(spark, sf_dir):
    return fingerprints.fingerprint_edits(documents(spark, sf_dir))


# ---- 6 and 10: classifiers ----------------------------------------------------------------------

def _scored(spark, sf_dir, docs, label, modulus, remainder, module, score, rows):
    """Train on labelled rows outside the held-out fold and score the documents."""
    usable = fold(F.col("doc_id"), modulus) != remainder
    sample = quality.labelled_sample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"),
                                     label, usable, rows)
    model = module.train(sample["text"].tolist(), sample["y"].to_numpy(dtype=int))
    scored = score(docs, model)
    return scored.withColumn("held_out", F.coalesce(fold(F.col("doc_id"), modulus) == remainder, F.lit(False))
                             ).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query("op6_toxicity")
def op6_toxicity(spark, sf_dir):
    scored = _scored(spark, sf_dir, documents(spark, sf_dir).select("doc_id", "text"), "toxic", 3, 1,
                     toxicity, toxicity.score_toxicity, toxicity.SAMPLE_ROWS)
    return scored.select("doc_id", "held_out", "score", "predicted")


def quality_scored(spark, sf_dir, docs):
    return _scored(spark, sf_dir, docs, "quality", 4, 2, quality, quality.score_texts, quality.SAMPLE_ROWS)


@query("op10_quality")
def op10_quality(spark, sf_dir):
    scored = quality_scored(spark, sf_dir, documents(spark, sf_dir).select("doc_id", "text"))
    return scored.select("doc_id", "held_out", "score", "predicted")


# ---- 9 packing ----------------------------------------------------------------------------------

def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op9_packing")
def op9_packing(spark, sf_dir):
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path())


# ---- 4 substrings -------------------------------------------------------------------------------

@query("op4_substring_dedup")
def op4_substring_dedup(spark, sf_dir):
    kept = substrings.remove_repeats(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


# ---- 5 n-gram Jaccard join ----------------------------------------------------------------------

@query("op5_jaccard_join")
def op5_jaccard_join(spark, sf_dir):
    return jaccard.jaccard_components(documents(spark, sf_dir))


# ---- 2 benchmark decontamination ----------------------------------------------------------------

@query("op2_decontamination")
def op2_decontamination(spark, sf_dir):
    return decontamination.find_contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


# ---- 7 lines ------------------------------------------------------------------------------------

@query("op7_line_dedup")
def op7_line_dedup(spark, sf_dir):
    kept = lines.drop_repeated_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


# ---- crc32 in SQL -------------------------------------------------------------------------------

#: The table of crc32, one list in one row.
CRC_TABLE = """bits AS (SELECT list(list_reduce([i] || [1,1,1,1,1,1,1,1], lambda c, b:
    CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t
    FROM (SELECT unnest(range(256))::BIGINT AS i))"""


def crc_sql(value: str) -> str:
    """crc32 of a text's UTF-8 bytes, with ``bits`` in scope."""
    return (f"xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(strlen({value})), lambda i: "
            f"('0x' || substr(hex(encode({value})), 2 * i + 1, 2))::BIGINT), "
            "lambda c, b: xor(t[xor(c & 255, b) + 1], c // 256)))")


# ---- 11 main text of pages ----------------------------------------------------------------------

#: The main text of pages that mark an article with <article>, as those of the table do.
MAIN_TEXT_SQL = r"""
WITH bare AS (SELECT page_id, url, regexp_replace(regexp_replace(coalesce(html, ''), '<!--.*?-->', '', 'gs'),
    '<(head|nav|footer|script|style|div class="ad")[ >].*?</(head|nav|footer|script|style|div)>', '', 'gs') AS h FROM pages),
article AS (SELECT page_id, url, regexp_extract(h, '<article[^>]*>(.*)</article>', 1, 's') AS h FROM bare),
blocks AS (SELECT page_id, url, list_transform(regexp_split_to_array(h, '</?(?:p|h1)>'), lambda b:
    trim(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(replace(b, '<br>', ' '), '</?b>', '', 'g'),
      '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS b FROM article),
joined AS (SELECT page_id, url, array_to_string(list_filter(b, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM blocks)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM joined
"""


@query("op11_main_text", MAIN_TEXT_SQL)
def op11_main_text(spark, sf_dir):
    return mainblocks.extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


# ---- 12 manifest --------------------------------------------------------------------------------

MERKLE_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: Levels that the SQL spells out; enough for 8^8 documents in a language.
MERKLE_LEVELS = 8


def _merkle_sql(fan: int = merkle.FAN_OUT, levels: int = MERKLE_LEVELS) -> str:
    def enc(value):
        return f"coalesce(strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR, '-')"

    def leaf(text):
        return "sha256(" + " || ".join(enc(text if f == "text" else f) for f in MERKLE_FIELDS) + ")"

    def tree(base, key, prefix):
        """Levels of nodes (k, i, n, h); the node of a finished tree goes up as it is."""
        out = [f"{prefix}0 AS (SELECT {key} AS k, row_number() OVER (PARTITION BY {key} ORDER BY o) - 1 AS i, "
               f"count(*) OVER (PARTITION BY {key}) AS n, h, o FROM {base})"]
        for at in range(levels):
            joined = "string_agg(h, '' ORDER BY i)"
            out.append(f"{prefix}{at + 1} AS (SELECT k, i // {fan} AS i, ((n + {fan - 1}) // {fan})::BIGINT AS n, "
                       f"CASE WHEN n = 1 THEN min(h) ELSE sha256({joined}) END AS h, "
                       f"CASE WHEN n = 1 THEN '' ELSE {joined} END AS run FROM {prefix}{at} GROUP BY k, i // {fan}, n)")
        return out

    def climb(rows, prefix, out):
        """Rows (k, i, used, proof) joined to the runs above them, level by level."""
        place = f"(a.i % {fan}) * 64"
        left, right = f"substr(run, 1, {place})", f"substr(run, {place} + 65)"
        ctes = []
        for at in range(levels):
            ctes.append(f"{out}{at} AS (SELECT a.* EXCLUDE (i, used, proof), a.i // {fan} AS i, "
                        f"CASE WHEN run = '' THEN used ELSE sha256({left} || used || {right}) END AS used, "
                        f"CASE WHEN run = '' THEN proof ELSE proof || {left} || {right} END AS proof "
                        f"FROM {rows} a JOIN {prefix}{at + 1} u ON u.k = a.k AND u.i = a.i // {fan})")
            rows = f"{out}{at}"
        return ctes, rows

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    hit = f"{crc_sql('doc_id::VARCHAR')} % 3 = 0"
    parts = [CRC_TABLE,
             f"docs AS (SELECT doc_id, coalesce('=' || lang, '') AS lang_key, {leaf('text')} AS h, "
             f"CASE WHEN {hit} THEN {leaf(lower)} ELSE {leaf('text')} END AS used FROM documents, bits)",
             "leaves AS (SELECT lang_key, h, doc_id AS o FROM docs)"]
    parts += tree("leaves", "lang_key", "l")
    parts.append(f"subs AS (SELECT '' AS top, h, k AS o FROM l{levels})")
    parts += tree("subs", "top", "u")
    parts.append("start_a AS (SELECT l0.k, l0.i, d.doc_id, d.h AS leaf, d.used, '' AS proof FROM docs d "
                 "JOIN l0 ON l0.k = d.lang_key AND l0.o = d.doc_id)")
    ctes, last = climb("start_a", "l", "a")
    parts += ctes
    parts.append(f"start_b AS (SELECT '' AS k, u0.i, x.doc_id, x.leaf, u0.h AS subroot, x.used, x.proof FROM {last} x "
                 "JOIN u0 ON u0.o = x.k)")
    ctes, last = climb("start_b", "u", "b")
    parts += ctes
    return ("WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, "
            f"used AS folded_root, used = r.h AS verified FROM {last} x JOIN u{levels} r ON r.k = x.k")


@query("op12_merkle_manifest", _merkle_sql())
def op12_merkle_manifest(spark, sf_dir):
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, merkle.lower_ascii(F.col("text"))
                      ).otherwise(F.col("text"))
    return merkle.merkle_manifest(documents(spark, sf_dir), MERKLE_FIELDS, "lang", "doc_id", {"text": tampered})


# ---- 13 resampling ------------------------------------------------------------------------------

def _resampling_sql() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    b, least = resampling.BUCKETS, resampling.LEAST_WORDS
    return f"""
WITH {CRC_TABLE},
dw AS (SELECT doc_id, unnest({words}) AS w FROM documents),
bw AS (SELECT unnest({words}) AS w FROM benchmark),
known AS (SELECT w, {crc_sql('w')} % {b} AS bucket FROM (SELECT w FROM dw UNION SELECT w FROM bw), bits),
counted AS (SELECT doc_id, bucket, count(*) AS n FROM dw JOIN known USING (w) GROUP BY doc_id, bucket),
source AS (SELECT bucket, sum(n) AS s FROM counted GROUP BY bucket),
target AS (SELECT bucket, count(*) AS t FROM bw JOIN known USING (w) GROUP BY bucket),
totals AS (SELECT (SELECT coalesce(sum(s), 0) FROM source)::DOUBLE AS ss, (SELECT coalesce(sum(t), 0) FROM target)::DOUBLE AS tt),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (ss + {b}) / ((s + 1)::DOUBLE * (tt + {b}))))::BIGINT AS g
  FROM source LEFT JOIN target USING (bucket), totals),
weighed AS (SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * g)::DOUBLE / sum(n))::BIGINT AS weight
  FROM counted JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT d.doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('{resampling.SEED}:' || d.doc_id), 1, 8))::BIGINT
    + 0.5)::DOUBLE / 4294967296.0::DOUBLE)))::BIGINT AS score FROM documents d LEFT JOIN weighed USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {least} ORDER BY score DESC, doc_id) AS r,
  count(*) OVER (PARTITION BY n_features >= {least}) AS m FROM scored)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_features >= {least} AND r <= {resampling.PERCENT} * m // 100 THEN r END AS rank FROM ranked
"""


@query("op13_resampling", _resampling_sql())
def op13_resampling(spark, sf_dir):
    return resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
