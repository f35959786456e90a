"""Registered queries of the text operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, decontaminate, hidden_markov, language_id, merkle, ngram_join, order_minhash, paragraphs,
               periodic, quality, shards, simhash, warc)
from .common import read, text_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    docs = read(spark, sf_dir, "documents").select("doc_id", text_of().alias("text"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return bpe.encode_decode(docs, path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.encode(ids, "utf-8"), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))


@query
def op9_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return shards.shard_documents(docs, 40).select(
        "doc_id", "size", F.crc32(F.encode(text_of(), "utf-8")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op4_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    manifest = warc.write_archives(read(spark, sf_dir, "pages"), folder)
    return warc.read_archives(manifest, folder, payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE["op4_warc_dictionary"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     q AS (SELECT page_id, octet_length(encode(h)) AS n, sha256(h) AS d FROM p),
     f AS (SELECT d, min(page_id) AS first FROM q WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, q.d AS payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM q LEFT JOIN f ON q.d = f.d AND q.n >= 100"""


@query
def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return order_minhash.compare_with_next(docs).drop("text")


@query
def op2_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.find_overlaps(docs, read(spark, sf_dir, "benchmark")).select(
        "doc_id", (F.size("hits") > 0).alias("contaminated"), "hits")


def crc_of_id(key: str = "doc_id"):
    return F.crc32(F.encode(F.coalesce(F.col(key).cast("string"), F.lit("")), "utf-8"))


@query
def op6_script_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = crc_of_id() % 3 == 1
    docs = read(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~held))
    return language_id.identify(docs.select("doc_id", held.alias("held_out"), "text"), model, spans=False).drop("text")


@query
def op3_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = crc_of_id() % 10 == 0
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    corpus, model = hidden_markov.fit(docs.where(~held))
    return hidden_markov.score(docs.withColumn("held_out", held), corpus, model)


@query
def op7_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.classify(docs, model).select("doc_id", "text_score", "meta_score", "score", "keep")


@query
def op10_ngram_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.link_documents(docs, n=3, num=90, den=100)


ORACLE["op10_ngram_orders"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 3 THEN [hash(array_to_string(a, ' '))]
    ELSE list_distinct(list_transform(range(1, len(a) - 1), lambda i: hash(a[i], a[i + 1], a[i + 2]))) END AS t FROM w),
e AS (SELECT doc_id, len(t) AS n, unnest(t) AS g FROM s),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS n, any_value(y.n) AS m, count(*) AS k
      FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c WHERE 100 * k >= 90 * (n + m - k)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a)
SELECT s.doc_id, CAST(len(t) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS component_id
FROM s LEFT JOIN r ON r.a = s.doc_id GROUP BY s.doc_id, t"""


@query
def op5_paragraph_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return paragraphs.dedup(docs).select("doc_id", "n_words", "n_removed", "removed", "text")


@query
def op13_merkle_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = [lower if f == "text" else F.col(f) for f in merkle.FIELDS]
    manifest = merkle.build(docs, presented=tampered, where=crc_of_id() % 3 == 0)
    return merkle.prove(manifest).select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest("siblings").alias("proof_sha256"),
        merkle.folded("presented", "siblings").alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


def crc_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII string, bit by bit (DuckDB)."""
    return f"""xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(
  string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda x, c: list_reduce(
  [xor(x, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))))"""


def _leaf_sql(text: str) -> str:
    fields = ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)
    return "sha256(" + " || ".join(f"CASE WHEN {f} IS NULL THEN '-' ELSE octet_length(encode({f})) || ':' || {f} END"
                                   for f in fields) + ")"


#: Levels as rows: a node's run is a list, a proof goes up one level a step.
ORACLE["op13_merkle_levels"] = f"""
WITH RECURSIVE d AS (
  SELECT *, {crc_sql("CAST(doc_id AS VARCHAR)")} % 3 = 0 AS changed,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
l AS (
  SELECT doc_id, lang, {_leaf_sql("text")} AS leaf,
         CASE WHEN changed THEN {_leaf_sql("low")} ELSE {_leaf_sql("text")} END AS shown FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
             count(*) OVER (PARTITION BY lang) AS n FROM l),
t(k, lang, i, n, h) AS (
  SELECT 0, lang, i, n, leaf FROM r
  UNION ALL
  SELECT k + 1, lang, i // 8, any_value((n + 7) // 8), sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1
  GROUP BY k, lang, i // 8),
s AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n
      FROM t WHERE n = 1),
u(k, i, n, h) AS (
  SELECT 0, i, n, subroot FROM s
  UNION ALL
  SELECT k + 1, i // 8, any_value((n + 7) // 8), sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1
  GROUP BY k, i // 8),
runs AS (SELECT k, lang, i // 8 AS run, list(h ORDER BY i) AS hs FROM t WHERE n > 1 GROUP BY ALL),
tops AS (SELECT k, i // 8 AS run, list(h ORDER BY i) AS hs FROM u WHERE n > 1 GROUP BY ALL),
p(doc_id, lang, leaf, j, k, i, cur, proof) AS (
  SELECT doc_id, lang, leaf, i, 0, i, shown, '' FROM r
  UNION ALL
  SELECT doc_id, p.lang, leaf, j, p.k + 1, i // 8,
         sha256(array_to_string(list_slice(hs, 1, i % 8), '') || cur || array_to_string(list_slice(hs, i % 8 + 2, 8), '')),
         proof || array_to_string(list_slice(hs, 1, i % 8), '') || array_to_string(list_slice(hs, i % 8 + 2, 8), '')
  FROM p JOIN runs ON runs.k = p.k AND runs.lang IS NOT DISTINCT FROM p.lang AND run = i // 8),
q AS (SELECT p.* EXCLUDE (i), s.i AS i, subroot FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang
      QUALIFY k = max(k) OVER (PARTITION BY p.lang, j)),
v(doc_id, lang, leaf, j, subroot, k, i, cur, proof) AS (
  SELECT doc_id, lang, leaf, j, subroot, 0, i, cur, proof FROM q
  UNION ALL
  SELECT doc_id, lang, leaf, j, subroot, v.k + 1, i // 8,
         sha256(array_to_string(list_slice(hs, 1, i % 8), '') || cur || array_to_string(list_slice(hs, i % 8 + 2, 8), '')),
         proof || array_to_string(list_slice(hs, 1, i % 8), '') || array_to_string(list_slice(hs, i % 8 + 2, 8), '')
  FROM v JOIN tops ON tops.k = v.k AND run = i // 8),
e AS (SELECT * FROM v QUALIFY k = max(k) OVER (PARTITION BY lang, j))
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = h AS verified
FROM e, (SELECT h FROM u WHERE n = 1)"""


def with_periods(docs: DataFrame) -> DataFrame:
    """Texts of every tenth document (by h = crc32 of the id) go over into
    repeats of a stretch of their own words, as op12's contract plants them."""
    h = crc_of_id()
    some = docs.withColumn("__h", h).withColumn("__w", F.when(h % 10 == 0, F.filter(
        F.split(text_of(), r"[\x20\x09-\x0D]+"), lambda w: w != "")))
    some = some.withColumn("__a", F.expr("if(size(__w) > 0, int((__h div 10) % size(__w)), null)")).withColumn(
        "__p", F.expr("int(1 + (size(__w) - __a) div (3 + (__h div 10) % 8))"))
    planted = F.expr("array_join(transform(sequence(0, size(__w) - 1), i -> "
                     "__w[if(i < __a, i, __a + (i - __a) % __p)]), ' ')")
    return some.withColumn("text", F.when(F.col("__a").isNotNull(), planted).otherwise(F.col("text"))).select(*docs.columns)


@query
def op12_maximal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_periods(read(spark, sf_dir, "documents").select("doc_id", "text"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return periodic.find_runs(docs).withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


#: Equal runs of five words (any run has them a period apart) as an equality
#: join; consecutive pairs of one distance are islands.
ORACLE["op12_maximal_pairs"] = rf"""
WITH h AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w,
         {crc_sql("CAST(doc_id AS VARCHAR)")} AS h FROM documents),
g AS (SELECT doc_id, w, len(w) AS n, h, h // 10 AS g FROM h),
a AS (SELECT *, CASE WHEN n > 0 THEN g % n ELSE 0 END AS a FROM g),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n),
        lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w FROM p),
e AS (SELECT doc_id, unnest(range(n - 4)) AS i, w FROM d WHERE n >= 5),
k AS (SELECT doc_id, i, hash(w[i + 1], w[i + 2], w[i + 3], w[i + 4], w[i + 5]) AS k FROM e),
j AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.k = y.k AND x.i < y.i),
o AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM j),
r AS (SELECT doc_id, min(i) AS start, count(*) + 4 + q AS length, q FROM o GROUP BY doc_id, q, island),
s AS (SELECT doc_id, start, length, min(q) AS period FROM r WHERE length >= greatest(6, 4 * q) GROUP BY ALL),
t AS (SELECT doc_id, count(*) AS n_runs, arg_max(start, (length, -start, -period)) AS start,
             max(length) AS length, arg_max(period, (length, -start, -period)) AS period,
             string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
             list(struct_pack(f := start + period, t := start + length)) AS cuts FROM s GROUP BY doc_id),
u AS (SELECT d.doc_id, unnest(range(n)) AS i, w, cuts FROM d JOIN t ON d.doc_id = t.doc_id),
v AS (SELECT doc_id, string_agg(w[i + 1], ' ' ORDER BY i) AS c FROM u
      WHERE len(list_filter(cuts, lambda x: x.f <= i AND i < x.t)) = 0 GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period,
       CAST(1000 * length // period AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
       sha256(CASE WHEN n_runs IS NULL THEN array_to_string(w, ' ') ELSE coalesce(c, '') END) AS collapsed_sha256
FROM d LEFT JOIN t ON d.doc_id = t.doc_id LEFT JOIN v ON d.doc_id = v.doc_id"""


@query
def op11_deletion_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.link_documents(read(spark, sf_dir, "documents").select("doc_id", "text"))
