"""The queries over this subpackage's operators, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import chat_format, exact_dedup, hard_negatives, html_extraction, language_id, lexical_search, mixing, ngram_join, packing, quality_rules, sentence_pieces, substring_dedup, toxicity

Query = Callable[[SparkSession, str], DataFrame]
WORD = r"[^\x20\x09-\x0D]+"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(_docs(spark, sf_dir))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out()))
    return toxicity.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_format.digest(chat_format.windows(turns))


def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.digest(_docs(spark, sf_dir))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(_docs(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    found = language_id.predict(docs, language_id.fit(docs.filter(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark(_docs(spark, sf_dir))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf_dir)).drop("copies")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return lexical_search.search(lexical_search.index(_docs(spark, sf_dir), asked), asked)


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            op1_packing, op2_quality_rules, op3_html_extraction, op4_substring_dedup, op5_toxicity, op6_exact_dedup, op7_chat_format, op8_sentence_pieces, op9_ngram_join, op10_language_id, op11_mixing, op12_hard_negatives,
            op13_lexical_search,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_exact_dedup": """
            WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
            g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256)
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (text_sha256)""",
        "op9_ngram_join": r"""
            WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
            sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
            n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
            link AS (SELECT a.doc_id AS x, b.doc_id AS y FROM sh a JOIN sh b ON a.k = b.k AND a.doc_id < b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
                     GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
            edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
            reach AS (SELECT x AS doc_id, x AS other FROM edge UNION SELECT r.doc_id, e.y FROM reach r JOIN edge e ON e.x = r.other),
            root AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
            SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(root.component_id, w.doc_id) AS component_id
            FROM w LEFT JOIN n USING (doc_id) LEFT JOIN root USING (doc_id)""",
        "op4_substring_dedup": r"""
            WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
            win AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
            least_doc AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k HAVING count(*) > 1),
            gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 50)))) AS ps FROM win JOIN least_doc USING (k) WHERE doc_id > m GROUP BY doc_id)
            SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
                   sha256(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
            FROM w LEFT JOIN gone USING (doc_id)""",
        "op11_mixing": r"""
            WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, (CAST('0x' || substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE) AS u FROM documents),
            c AS (SELECT source, CASE WHEN size > 0 THEN len(bin(size)) ELSE 0 END AS digits, CAST(sum(size) AS BIGINT) AS words, count(*) AS n FROM d GROUP BY ALL),
            s0 AS (SELECT source, CAST(sum(words) AS BIGINT) AS s, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM c GROUP BY source),
            s1 AS (SELECT *, 3 * s AS f, [5, 2, 1][(rank - 1) % 3 + 1] AS w FROM s0),
            s2 AS (SELECT *, f * (sum(w) OVER () - sum(w) OVER o + w) <= w * (sum(s) OVER () - sum(f) OVER o + f) AS stops FROM s1 WINDOW o AS (ORDER BY f / w, rank ROWS UNBOUNDED PRECEDING)),
            s3 AS (SELECT source, s, rank, CASE WHEN stops THEN CAST(f AS DOUBLE) ELSE CAST(w * (sum(s) OVER () - coalesce(sum(CASE WHEN stops THEN f END) OVER (), 0)) AS DOUBLE) / CAST(sum(CASE WHEN NOT stops THEN w END) OVER () AS DOUBLE) END AS target FROM s2),
            c1 AS (SELECT c.*, s, rank, target, CASE WHEN s > 0 THEN CAST(floor(target / s) AS BIGINT) ELSE 0 END AS whole, CASE WHEN digits > 0 THEN CAST(1 << (digits // 3) AS DOUBLE) ELSE 0.0 END AS odds FROM c JOIN s3 ON c.source IS NOT DISTINCT FROM s3.source),
            c2 AS (SELECT *, target - whole * s AS rest, target - whole * s > 0 AND digits > 0 AND (target - whole * s - (sum(words) OVER o - words)) * odds >= sum(odds * words) OVER r AS sure FROM c1
                   WINDOW o AS (PARTITION BY rank ORDER BY digits DESC ROWS UNBOUNDED PRECEDING), r AS (PARTITION BY rank ORDER BY digits DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
            c3 AS (SELECT * REPLACE (rest - sum(CASE WHEN sure THEN words ELSE 0 END) OVER (PARTITION BY rank) AS rest), sum(CASE WHEN sure THEN 0.0 ELSE odds * words END) OVER (PARTITION BY rank) AS due FROM c2),
            c4 AS (SELECT *, CASE WHEN sure THEN CAST(1 AS DOUBLE) WHEN due > 0 THEN greatest(least(rest * odds / due, 1.0), 0.0) ELSE CAST(0 AS DOUBLE) END AS chance FROM c3),
            k AS (SELECT doc_id, size, u, c4.* EXCLUDE (source), row_number() OVER o AS place, sum(size) OVER o AS upto, chance > 0 AND chance < 1 AS drawn FROM (SELECT *, least(chance * size * n / words, CAST(1 - 1e-9 AS DOUBLE)) AS p
                  FROM d JOIN c4 ON d.source IS NOT DISTINCT FROM c4.source AND c4.digits = CASE WHEN size > 0 THEN len(bin(size)) ELSE 0 END) AS c4 WINDOW o AS (PARTITION BY rank, digits ORDER BY (u * (1 - p)) / ((1 - u) * p), doc_id ROWS UNBOUNDED PRECEDING)),
            h AS (SELECT rank, digits, any_value(chance * words) - coalesce(sum(CASE WHEN upto <= chance * words THEN size END), 0) AS opened, coalesce(max(CASE WHEN upto <= chance * words THEN place END), 0) AS ended FROM k WHERE drawn GROUP BY rank, digits),
            b AS (SELECT rank, digits, place, size FROM k JOIN h USING (rank, digits) WHERE drawn AND place > ended AND place <= ended + 16),
            g AS (SELECT rank, list_reduce(list_prepend({'o': (SELECT sum(opened ORDER BY digits) FROM h WHERE h.rank = b.rank), 'size': CAST(0 AS BIGINT), 'fits': [[CAST(0 AS BIGINT), 0]], 'p': [CAST(0 AS BIGINT), 0]}, list({'o': CAST(0 AS DOUBLE), 'size': size, 'fits': [[CAST(0 AS BIGINT), 0]], 'p': [digits, place]} ORDER BY size DESC, digits DESC, place)),
                  lambda x, y: CASE WHEN y.size <= x.o THEN {'o': x.o - y.size, 'size': CAST(0 AS BIGINT), 'fits': list_append(x.fits, y.p), 'p': [CAST(0 AS BIGINT), 0]} ELSE x END).fits AS fits FROM b GROUP BY rank)
            SELECT doc_id, size, k.s AS source_size, target, CASE WHEN size = 0 THEN 0 ELSE CAST(size * (whole + CASE WHEN chance = 1 OR drawn AND (upto <= chance * words OR coalesce(list_contains(fits, [digits, place]), false)) THEN 1 ELSE 0 END) AS BIGINT) END AS taken FROM k LEFT JOIN g USING (rank)""",
        "op12_hard_negatives": r"""
            WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
                       WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            pair AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
            pos AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM pair WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
            neg AS (SELECT anchor_id, positive_id, positive_score, id AS negative_id, score AS negative_score, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank
                    FROM pos JOIN pair USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
            SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 3""",
        "op13_lexical_search": r"""
            WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
            n AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d WHERE len(ts) > 0),
            q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
            p AS (SELECT doc_id, n, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, CAST(len(ts) AS BIGINT) AS n, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
            w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, n GROUP BY t, n_docs),
            s AS (SELECT item_id, doc_id, CAST(sum(w * times * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * p.n * n_docs) // n_terms)))) AS BIGINT) AS score FROM q JOIN p USING (t) JOIN w USING (t), n GROUP BY item_id, doc_id)
            SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 20""",
    }
