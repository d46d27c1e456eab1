"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm import chat, codebooks, decontam, fingerprint, language, merkle, neardup, quality, secrets, sentencepieces, substring_dedup, token_counts, toxicity


#: The public vocabulary file that operators 1 and 3 read.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; a file that one task would read alone is dealt to all cores."""
    documents = _read(spark, sf_dir, "documents")
    cores = spark.sparkContext.defaultParallelism
    return documents.repartition(cores) if documents.rdd.getNumPartitions() * 2 <= cores else documents


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(_documents(spark, sf_dir), MODEL)


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprint.edited(_documents(spark, sf_dir))
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        fingerprint.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        fingerprint.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sentencepieces.round_trip(_documents(spark, sf_dir), MODEL)
    return rows.select(
        "doc_id",
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir)
    scored = toxicity.score(documents, toxicity.fit(documents, _read(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = r"\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    every = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat.read_back(chat.format_turns(every))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.dedup(_read(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(_documents(spark, sf_dir), shingle=2).select("doc_id", "n_shingles", "component_id", "kept")


def grade() -> Column:
    """0 poor and toxic, 1 one of both, 2 neither; null without a rating of quality. A missing mark of toxicity is none."""
    return F.when(F.col("quality").isNotNull(), F.col("quality") + F.when(F.col("toxic") == 1, 0).otherwise(1))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades count what is right with a document: it is of quality, it is not toxic. Kept if both is likelier than not."""
    documents = _documents(spark, sf_dir)
    model = quality.fit(documents, _read(spark, sf_dir, "labels"), grade(), 3)
    rated = quality.rate(documents, model, at_least=2)
    return rated.select("doc_id", "expected_grade", "tail_probability", (F.col("tail_probability") >= 0.5).alias("kept"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan(_documents(spark, sf_dir), _read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_documents(spark, sf_dir))
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"].isin(*secrets.KINDS[: secrets.BASE]))
    return found.select("doc_id", *[of(k) for k in secrets.KINDS[: secrets.BASE]], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other document's text has lost its line feeds; its proof no longer leads to the root, unless there were none."""
    doc_id = F.col("doc_id").cast("string")
    tampered = F.when(F.crc32(doc_id) % 2 == 0, merkle.leaf([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), merkle.without_line_ends(F.col("text"))]))
    proved = merkle.prove(_read(spark, sf_dir, "documents"), carry={"tampered": tampered})
    folded = proved.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256"), merkle.fold(F.coalesce("tampered", "leaf"), F.col("proof")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir)
    model = language.fit(documents.where(~language.held_out(F.col("doc_id"))))
    found = language.identify(documents, model)
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), F.col("lang").alias("lang_pred"), "score")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codebooks.compress(_read(spark, sf_dir, "embeddings"))
    return codebooks.with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(codebooks.digest(books)).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_document_fingerprints": op2_document_fingerprints,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_toxicity": op4_toxicity,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_secret_scan": op10_secret_scan,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_language_id": op12_language_id,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE_SQL: dict[str, str] = {
    "op5_chat_formatting": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + length(role) + 2 + length(regexp_replace(text, '(\\|### |</turn>)', 'x\1', 'g')) + 8) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
""",
    "op6_substring_dedup": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, p, array_to_string(list_slice(w, p, p + 19), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20)
), late AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS r FROM win) WHERE r > 1
), gone AS (
  SELECT DISTINCT doc_id, q FROM (SELECT doc_id, unnest(range(p, p + 20)) AS q FROM late)
), word AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS q FROM d
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY q) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, q) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""",
    "op7_minhash_near_dedup": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 1), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS p FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), both_ AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), link AS (
  SELECT x, y FROM both_ JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 80 * (nx.n + ny.n - i)
), reach(x, y) AS (
  SELECT x, y FROM link UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x
), least_ AS (
  SELECT x, min(y) AS m FROM reach GROUP BY x
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(least(d.doc_id, coalesce(m, d.doc_id)) AS BIGINT) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least_ ON least_.x = d.doc_id
""",
    "op9_benchmark_decontamination": r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), grams AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, list_slice(w, p, p + least(10, len(w)) - 1) AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM bw WHERE len(w) > 0)
), wins AS (
  SELECT doc_id, p, k, list_slice(w, p, p + k - 1) AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM dw, (SELECT DISTINCT k FROM grams) WHERE len(w) >= k)
), hits AS (
  SELECT doc_id, p, wins.k, item_id FROM wins JOIN grams ON wins.k = grams.k AND wins.g = grams.g
), n AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hits) GROUP BY doc_id
), i AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
""",
    "op11_merkle_manifest": r"""
WITH RECURSIVE d AS (
  SELECT *, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT),
      lambda c, b: list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 2 = 0 AS hit
  FROM documents
), e AS (
  SELECT doc_id, source, hit, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
         text, replace(text, chr(10), '') AS cut FROM d
), l AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || CASE WHEN hit THEN coalesce(strlen(cut) || ':' || cut, '-') ELSE coalesce(strlen(text) || ':' || text, '-') END) AS seen FROM e
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l
), up(tree, lvl, pos, h) AS (
  SELECT tree, 0, pos, leaf FROM leaves
  UNION ALL
  SELECT tree, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM up) WHERE n > 1 GROUP BY tree, lvl, pos // 3
), sub AS (
  SELECT tree, max(lvl) AS depth, arg_max(h, lvl) AS h, row_number() OVER (ORDER BY tree) - 1 AS pos FROM up GROUP BY tree
), top(lvl, pos, h) AS (
  SELECT 0, pos, h FROM sub
  UNION ALL
  SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS n FROM top) WHERE n > 1 GROUP BY lvl, pos // 3
), ends AS (
  SELECT max(lvl) AS depth, arg_max(h, lvl) AS h FROM top
), runs AS (
  SELECT tree, lvl, pos // 3 AS run, string_agg(h, '' ORDER BY pos) AS t FROM up GROUP BY ALL
), tops AS (
  SELECT lvl, pos // 3 AS run, string_agg(h, '' ORDER BY pos) AS t FROM top GROUP BY ALL
), fold(doc_id, tree, leaf, pos, place, lvl, depth, seen, proof) AS (
  SELECT doc_id, tree, leaf, pos, pos, 0, depth, seen, '' FROM (SELECT leaves.*, depth FROM leaves JOIN sub USING (tree))
  UNION ALL
  SELECT doc_id, fold.tree, leaf, fold.pos, place // 3, fold.lvl + 1, depth, sha256(substr(t, 1, 64 * (place % 3)) || seen || substr(t, 64 * (place % 3) + 65)), proof || substr(t, 1, 64 * (place % 3)) || substr(t, 64 * (place % 3) + 65)
  FROM fold JOIN runs ON runs.tree = fold.tree AND runs.lvl = fold.lvl AND runs.run = place // 3 WHERE fold.lvl < depth
), inner_ AS (
  SELECT fold.*, sub.h AS subroot, sub.pos AS top_pos FROM fold JOIN sub USING (tree) WHERE lvl = fold.depth
), outer_(doc_id, leaf, tree, pos, subroot, place, lvl, seen, proof) AS (
  SELECT doc_id, leaf, tree, pos, subroot, top_pos, 0, seen, proof FROM inner_
  UNION ALL
  SELECT doc_id, leaf, tree, pos, subroot, place // 3, outer_.lvl + 1, sha256(substr(t, 1, 64 * (place % 3)) || seen || substr(t, 64 * (place % 3) + 65)), proof || substr(t, 1, 64 * (place % 3)) || substr(t, 64 * (place % 3) + 65)
  FROM outer_ JOIN tops ON tops.lvl = outer_.lvl AND tops.run = place // 3, ends WHERE outer_.lvl < ends.depth
)
SELECT doc_id, leaf, subroot, ends.h AS root, sha256(proof) AS proof_sha256, seen AS folded_root, seen = ends.h AS verified FROM outer_, ends WHERE lvl = ends.depth
""",
    "op13_vector_codes": r"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(256 * c::DOUBLE) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), parts AS (
  SELECT vec_id, part, list_slice(q, part * (len(q) // 16) + 1, (part + 1) * (len(q) // 16)) AS v FROM kept, unnest(range(16)) t(part)
), b0 AS (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v AS c FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)
), a0 AS MATERIALIZED (
  SELECT vec_id, part, v, entry, d FROM (
    SELECT x.vec_id, x.part, x.v, b.entry, list_sum(list_transform(list_zip(x.v, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d,
           row_number() OVER (PARTITION BY x.vec_id, x.part ORDER BY list_sum(list_transform(list_zip(x.v, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.entry) AS r
    FROM parts x JOIN b0 b USING (part)) WHERE r = 1
), b1 AS MATERIALIZED (
  SELECT part, entry, coalesce(u.c, b0.c) AS c FROM b0 LEFT JOIN (
    SELECT part, entry, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS c FROM (
      SELECT part, entry, i, sum(CAST(x AS BIGINT))::DOUBLE AS s, count(*) AS n FROM (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a0) GROUP BY ALL) GROUP BY ALL) u USING (part, entry)
), a1 AS MATERIALIZED (
  SELECT vec_id, part, v, entry, d FROM (
    SELECT x.vec_id, x.part, x.v, b.entry, list_sum(list_transform(list_zip(x.v, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d,
           row_number() OVER (PARTITION BY x.vec_id, x.part ORDER BY list_sum(list_transform(list_zip(x.v, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.entry) AS r
    FROM parts x JOIN b1 b USING (part)) WHERE r = 1
), b2 AS MATERIALIZED (
  SELECT part, entry, coalesce(u.c, b1.c) AS c FROM b1 LEFT JOIN (
    SELECT part, entry, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS c FROM (
      SELECT part, entry, i, sum(CAST(x AS BIGINT))::DOUBLE AS s, count(*) AS n FROM (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a1) GROUP BY ALL) GROUP BY ALL) u USING (part, entry)
), a2 AS MATERIALIZED (
  SELECT vec_id, part, v, entry, d FROM (
    SELECT x.vec_id, x.part, x.v, b.entry, list_sum(list_transform(list_zip(x.v, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d,
           row_number() OVER (PARTITION BY x.vec_id, x.part ORDER BY list_sum(list_transform(list_zip(x.v, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.entry) AS r
    FROM parts x JOIN b2 b USING (part)) WHERE r = 1
), codes AS (
  SELECT vec_id, string_agg(lpad(lower(hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY vec_id
), books AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN codes USING (vec_id), books
""",
}
