"""The queries of the operators, with the SQL that states the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugeworks.llm import align, article, classifier, decontaminate, language, lines, near, neighbours, ngrams, packing, spelling, substrings, suffixes
from gaugeworks.llm.frames import table
from gaugeworks.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(prepare(spark), sf_dir)
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


@query("op4_packing")
def op4(spark, sf_dir):
    out = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ids=False)
    return out.select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")


@query(
    "op6_decontamination",
    r"""
    WITH word AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, list_aggregate(w[i : i + least(len(w), 13) - 1], 'string_agg', ' ') AS k
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM item WHERE len(w) > 0)),
    size AS (SELECT DISTINCT n FROM win),
    spot AS (SELECT doc_id, n, i, list_aggregate(w[i : i + n - 1], 'string_agg', ' ') AS k
             FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM word, size WHERE len(w) >= n)),
    hit AS (SELECT doc_id, item_id, i, n FROM spot JOIN win USING (n, k)),
    hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
    items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM word LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
)
def op6(spark, sf_dir):
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    s = F.col("_scan")
    return out.select("doc_id", s.n_words.alias("n_words"), s.n_hit.alias("n_hit"), F.size(s["items"]).cast("long").alias("n_items"), F.sha2(F.array_join(s["items"], ",").cast("binary"), 256).alias("items_sha256"), s.contaminated.alias("contaminated"))


@query(
    "op7_line_dedup",
    r"""
    WITH line AS (SELECT doc_id, i, l, translate(trim(l, e' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
                  FROM (SELECT doc_id, generate_subscripts(s, 1) AS i, unnest(s) AS l FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))),
    often AS (SELECT k, max(doc_id) AS last FROM line WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (last > doc_id) AS n_dropped,
           sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (last IS NULL OR last <= doc_id), '')) AS kept_sha256
    FROM line LEFT JOIN often USING (k) GROUP BY doc_id
    """,
)
def op7(spark, sf_dir):
    out = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), batches=4)
    s = F.col("_lines")
    return out.select("doc_id", s.n_lines.alias("n_lines"), s.n_dropped.alias("n_dropped"), F.sha2(s.kept.cast("binary"), 256).alias("kept_sha256"))


@query(
    "op9_substring_dedup",
    r"""
    WITH word AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    win AS (SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM word WHERE len(w) >= 35)),
    rep AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
    hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM win JOIN rep USING (k)),
    each AS (SELECT doc_id, generate_subscripts(w, 1) AS p, unnest(w) AS x FROM word),
    kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS s FROM each ANTI JOIN hit USING (doc_id, p) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM word LEFT JOIN kept USING (doc_id)
    """,
)
def op9(spark, sf_dir):
    out = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op8_suffix_array_dedup")
def op8(spark, sf_dir):
    out = suffixes.remove_later_copies(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def crc_mod(n: int):
    """crc32 of the id as text, modulo n; -1 for a null id, which is in no fold."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n)), F.lit(-1))


def quality_model(spark, sf_dir):
    """Learnt from labels whose crc32(doc_id) mod 5 is not 0."""
    return classifier.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(crc_mod(5) != 0))


@query("op10_quality_classifier")
def op10(spark, sf_dir):
    out = classifier.score(table(spark, sf_dir, "documents").select("doc_id", "text"), quality_model(spark, sf_dir))
    return out.select("doc_id", (crc_mod(5) == 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.3).cast("int").alias("predicted"))


@query("op3_language_id")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(crc_mod(4) != 2))
    out = language.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (crc_mod(4) == 2).alias("held_out"), F.col("_language.lang").alias("lang_pred"), F.col("_language.score").alias("score"))


@query(
    "op2_lm_scoring",
    r"""
    WITH word AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    pos AS (SELECT doc_id, i, w[i] AS g1, CASE WHEN i > 1 THEN w[i - 1] END AS p1, CASE WHEN i > 1 THEN w[i - 1] || ' ' || w[i] END AS g2,
                   CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] END AS p2, CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] || ' ' || w[i] END AS g3
            FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM word)),
    c1 AS (SELECT g1 AS k, count(*) AS n FROM pos GROUP BY 1), c2 AS (SELECT g2 AS k, count(*) AS n FROM pos WHERE g2 IS NOT NULL GROUP BY 1),
    c3 AS (SELECT g3 AS k, count(*) AS n FROM pos WHERE g3 IS NOT NULL GROUP BY 1),
    s AS (SELECT doc_id, CASE WHEN t.n >= 1 THEN ln(t.n) - ln(tp.n) WHEN b.n >= 1 THEN ln(b.n) - ln(bp.n) + CASE WHEN i > 2 THEN ln(0.4) ELSE 0 END
                              ELSE ln(u.n) - ln((SELECT count(*) FROM pos)) + least(i - 1, 2) * ln(0.4) END AS v
          FROM pos LEFT JOIN c3 t ON t.k = g3 LEFT JOIN c2 tp ON tp.k = p2 LEFT JOIN c2 b ON b.k = g2 LEFT JOIN c1 bp ON bp.k = p1 LEFT JOIN c1 u ON u.k = g1)
    SELECT doc_id, len(w)::BIGINT AS n_words, round(coalesce(sum(v), 0), 4) + 0.0 AS score FROM word LEFT JOIN s USING (doc_id) GROUP BY doc_id, len(w)
    """,
)
def op2(spark, sf_dir):
    out = ngrams.stupid_backoff(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", (F.round("score", 4) + F.lit(0.0)).alias("score"))


@query("op5_nearest_neighbours")
def op5(spark, sf_dir):
    vectors = neighbours.usable(table(spark, sf_dir, "embeddings"))
    return neighbours.search(vectors, vectors.where(F.pmod("id", F.lit(100)) == 0).select("id"))


@query("op1_jaccard_join")
def op1(spark, sf_dir):
    out = near.near_classes(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "class_id", "n_links", "n_texts")


@query("op11_tokenizer_alignment")
def op11(spark, sf_dir):
    out = align.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.withColumnRenamed("id", "doc_id")


@query(
    "op12_spelling_variants",
    r"""
    WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
    run AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents) GROUP BY ALL),
    hashed AS (SELECT w, n, xor(list_reduce([4294967295] || list_transform(range(1, length(x), 2), lambda i: ('0x' || x[i : i + 1])::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
               FROM (SELECT w, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS x FROM run), crc),
    word AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 199 = 0 THEN w[: h % length(w)] || w[h % length(w) + 2 :] ELSE w END AS word FROM hashed)
             WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
    cut AS (SELECT word, i, word[: i] || word[i + 2 :] AS k FROM (SELECT word, unnest(range(length(word))) AS i FROM word)),
    pair AS (SELECT a.word, b.word AS near FROM cut a JOIN cut b USING (k, i) WHERE a.word <> b.word
             UNION SELECT a.word, b.word FROM cut a JOIN word b ON b.word = a.k UNION SELECT b.word, a.word FROM cut a JOIN word b ON b.word = a.k),
    best AS (SELECT p.word, count(*) AS n_near, arg_min(p.near, (-b.n, encode(p.near))) AS near, max(b.n) AS near_n FROM pair p JOIN word b ON b.word = p.near GROUP BY p.word),
    forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n FROM word w LEFT JOIN best USING (word)),
    walk AS (SELECT word, word AS at FROM forms UNION ALL SELECT walk.word, f.form FROM walk JOIN forms f ON f.word = walk.at WHERE f.form IS NOT NULL),
    roots AS (SELECT walk.word, walk.at AS root FROM walk JOIN forms f ON f.word = walk.at WHERE f.form IS NULL)
    SELECT f.word, f.form, root, f.n, f.n_near, f.form_n FROM forms f JOIN roots USING (word)
    """,
)
def op12(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


@query("op13_html_extraction")
def op13(spark, sf_dir):
    out = article.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
