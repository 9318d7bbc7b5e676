"""Registered queries of the training-data operators, one for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalwatch.llm import bpe, crosspolytope, langid, licenses, lines, minhash, negatives, suffixes, tiling, token_counts, urls, variants, vectors
from shoalwatch.session import spread

RULES = [
    urls.Rule("com/en/", "block"),
    urls.Rule("example.com/en/7", "allow"),
    urls.Rule("net/de/", "allow"),
    urls.Rule("example.net/de/8", "block"),
    urls.Rule("org/es/", "block"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, RULES).select("page_id", "host", "path", "rule", "verdict", "block_margin")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op3_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"), cosine=0.9)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.suffix_sums(token_counts.length_histogram(_table(spark, sf_dir, "documents")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tiling.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.repeated_runs(_table(spark, sf_dir, "documents")).drop("text_hash")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = langid.train(docs.where(~held_out).select("text", "lang"))
    told = langid.with_language(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return told.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "lang_mix")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.with_round_trip(docs, keep=["doc_id"]).select(
        "doc_id",
        F.expr("octet_length(token_ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return variants.spelling_variants(variants.word_counts(docs, typo_one_in=97))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(negatives.integer_rows(rows.withColumn("label", label), scale=256), every=50)


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = crosspolytope.usable_vectors(_table(spark, sf_dir, "embeddings"))
    return crosspolytope.nearest(rows, F.col("vec_id") % 20 == 0, k=20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_vector_near_dedup": op3_vector_near_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_decontamination": op5_decontamination,
    "op6_line_dedup": op6_line_dedup,
    "op7_license_scan": op7_license_scan,
    "op8_language_id": op8_language_id,
    "op9_bpe": op9_bpe,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_nearest_neighbours": op13_nearest_neighbours,
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_UNSPACED = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in lines.UNSPACED)
_PART = r"[^\x09-\x0D\x1E\x20]+"
#: Links of ``linked(a, b)`` in both directions, followed to all that they reach.
_REACHED = """hop(a, b) AS (SELECT a, b FROM linked UNION SELECT hop.a, linked.b FROM hop JOIN linked ON hop.b = linked.a),
low AS (SELECT a, min(b) AS b FROM hop GROUP BY a)"""

#: SQL for the queries whose results it can express on whole test tables; the
#: others are tested against brute force.
ORACLES: dict[str, str] = {
    "op2_minhash_near_dedup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
linked AS (SELECT a, b FROM both_ JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * c >= 85 * (na.n + nb.n - c)),
{_REACHED}
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(low.b, doc_id)) AS component_id, doc_id <= coalesce(low.b, doc_id) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.a = doc_id""",
    "op3_vector_near_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
linked AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id <> y.vec_id WHERE list_dot_product(x.e, y.e) / (x.norm * y.norm) >= 0.9),
k AS (SELECT a, count(*) AS n FROM linked GROUP BY a), {_REACHED}
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low.b, vec_id)) AS component_id, vec_id <= coalesce(low.b, vec_id) AS kept
FROM v LEFT JOIN k ON k.a = vec_id LEFT JOIN low ON low.a = vec_id""",
    "op6_line_dedup": rf"""
WITH m AS (SELECT doc_id, regexp_replace(regexp_replace(text, '([.!?])[\x20\x09]', '\1' || chr(30), 'g'), '[\x20\x09](\p{{Lu}})', chr(30) || '\1', 'g') AS t FROM documents),
b AS (SELECT doc_id, translate(t, chr(10) || '。！？', repeat(chr(30), 4)) AS t FROM m),
l AS (SELECT doc_id, string_split(t, chr(30)) AS l FROM b),
d AS (SELECT doc_id, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_PART}') AS w FROM b),
z AS (SELECT doc_id, w, list_transform(w, lambda x: greatest(1, length(x) // 8, length(regexp_replace(x, '[^{_UNSPACED}]', '', 'g')) // 2)) AS z FROM d),
u AS (SELECT doc_id, unnest(l) AS text, unnest(range(0, len(l))) AS p, unnest(list_transform(l, lambda x: length(x) + 1)) AS step, unnest(list_transform(l, lambda x: len(regexp_extract_all(x, '{_PART}')))) AS c FROM l),
o AS (SELECT *, sum(step) OVER k - step AS start, CAST(sum(c) OVER k - c AS BIGINT) AS f FROM u WINDOW k AS (PARTITION BY doc_id ORDER BY p)),
s AS (SELECT doc_id, p, start, start + length(text) AS "end", list_sum(z[f + 1:f + c]) AS size, w[f + 1:f + c] AS v, z[f + 1:f + c] AS vz, array_to_string(w[f + 1:f + greatest(c, coalesce(list_filter([1, 2, 3, 4], lambda j: list_sum(z[f + 1:f + j]) >= 5)[1], 5))], ' ') AS s
  FROM o JOIN z USING (doc_id) WHERE c > 0),
x AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS unit FROM s),
r AS (SELECT *, row_number() OVER w AS k, first_value(doc_id) OVER w AS kept_doc_id, first_value(unit) OVER w AS kept_unit, count(*) OVER (PARTITION BY s) AS copies FROM x WINDOW w AS (PARTITION BY s ORDER BY doc_id, unit)),
g AS (SELECT *, unit - row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS run FROM r WHERE k > 1),
a AS (SELECT doc_id, min(unit) AS unit, min(start) AS start, max("end") AS "end", count(*) AS n_units, sum(size) AS size, arg_min(kept_doc_id, unit) AS kept_doc_id, arg_min(kept_unit, unit) AS kept_unit,
  arg_min(copies, unit) AS copies, arg_max(kept_doc_id, unit) AS last_doc_id, arg_max(kept_unit, unit) AS last_unit FROM g GROUP BY doc_id, run),
e AS (SELECT a.*, list_reverse(b.v) AS b, list_reverse(b.vz) AS bz, list_reverse(kb.v) AS kb, n.v AS n, n.vz AS nz, kn.v AS kn FROM a
  LEFT JOIN x b ON b.doc_id = a.doc_id AND b.unit = a.unit - 1 LEFT JOIN x kb ON kb.doc_id = a.kept_doc_id AND kb.unit = a.kept_unit - 1
  LEFT JOIN x n ON n.doc_id = a.doc_id AND n.unit = a.unit + a.n_units LEFT JOIN x kn ON kn.doc_id = a.last_doc_id AND kn.unit = a.last_unit + 1),
t AS (SELECT *, coalesce(list_sum(list_filter(bz, lambda y, i: b[1:i] = kb[1:i])), 0) + coalesce(list_sum(list_filter(nz, lambda y, i: n[1:i] = kn[1:i])), 0) AS around FROM e)
SELECT doc_id, CAST(unit AS INT) AS unit, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end", n_units, CAST(size AS BIGINT) AS size, kept_doc_id, CAST(kept_unit AS INT) AS kept_unit, copies
FROM t WHERE size + around >= {lines.MIN_SIZE}""",
    "op11_spelling_variants": rf"""
WITH RECURSIVE p AS MATERIALIZED (SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(0, 256) r(i)),
g AS (SELECT doc_id, unnest(regexp_extract_all(text, '[{variants.LETTERS}]{{5,}}')) AS g FROM documents),
c AS (SELECT doc_id, translate(g, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS g, count(*) AS n FROM g GROUP BY ALL),
b AS (SELECT g, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || g)) AS x FROM c),
y AS (SELECT g, n, list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)) AS y FROM b),
h AS (SELECT g, n, xor(list_reduce(y, lambda c, e: xor(c >> 8, t[(xor(c, e) & 255) + 1]), 4294967295), 4294967295) AS h FROM y, p),
d AS (SELECT n, CASE WHEN h % 97 = 0 THEN substr(g, 1, h % length(g)) || substr(g, h % length(g) + 2) ELSE g END AS word FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM d WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
s AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS s FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS MATERIALIZED (SELECT a.word, a.n, b.word AS o, b.n AS m FROM s a JOIN s b ON a.i = b.i AND a.s = b.s AND a.word <> b.word
  UNION SELECT s.word, s.n, v.word, v.n FROM s JOIN v ON s.s = v.word UNION SELECT v.word, v.n, s.word, s.n FROM s JOIN v ON s.s = v.word),
f AS MATERIALIZED (SELECT word, count(*) AS n_near, arg_min(o, (-m, o)) AS o, max(m) AS m FROM near GROUP BY 1),
k AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN o END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM v LEFT JOIN f USING (word)),
walk(word, root) AS (SELECT word, word FROM k UNION ALL SELECT walk.word, k.form FROM walk JOIN k ON walk.root = k.word WHERE k.form IS NOT NULL),
ends AS (SELECT walk.word, root FROM walk JOIN k ON walk.root = k.word WHERE k.form IS NULL)
SELECT word, n, n_near, form, form_n, root FROM k JOIN ends USING (word)""",
    "op12_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS MATERIALIZED (SELECT a.vec_id AS a, x.vec_id AS x, a.label = x.label AS alike, CAST(list_dot_product(a.e, x.e) AS BIGINT) AS s FROM v a JOIN v x ON a.vec_id <> x.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT a, x, s FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, x) <= 5)
SELECT p.a AS anchor_id, p.x AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.x ORDER BY s.s DESC, s.x) AS INTEGER) AS rank, s.x AS negative_id, p.s AS positive_score, s.s AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT s.alike AND 50 * p.s <= 100 * s.s AND 100 * s.s <= 95 * p.s QUALIFY rank <= 3""",
}
