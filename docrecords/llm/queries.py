"""The queries of this subpackage, and their SQL where SQL can express them."""

from pyspark.sql import functions as F

from . import (
    centroid_clusters,
    chat_views,
    decontaminate,
    language_id,
    lattice_score,
    license_index,
    neighbour_quality,
    partenum_join,
    shard_schedule,
    simhash_pivots,
    source_divergence,
    weak_rules,
    window_packing,
)
from .common import fold_of, table


def quality_labels(labels):
    """(doc_id, label) outside the held-out fold."""
    learned = labels.filter(fold_of(F.col("doc_id"), 5) != 0)
    return learned.select("doc_id", F.col("quality").alias("label"))


def op1_neighbour_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = neighbour_quality.fit(docs, quality_labels(table(spark, sf_dir, "labels")))
    return neighbour_quality.score(docs, model).select(
        "doc_id",
        F.coalesce(fold_of(F.col("doc_id"), 5) == 0, F.lit(True)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op2_chat_views(spark, sf_dir):
    return chat_views.chat_views(table(spark, sf_dir, "conversations"))


def op3_license_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_index.license_scan(docs).drop("text")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = fold_of(F.col("doc_id"), 4)
    model = language_id.fit(docs.filter(fold != 2))
    found = language_id.predict(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id", F.coalesce(fold == 2, F.lit(True)).alias("held_out"), "lang_pred", "score"
    )


def op5_partenum_join(spark, sf_dir):
    return partenum_join.similar_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_lattice_score(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    train = fold_of(F.col("doc_id"), 10) != 0
    return lattice_score.lattice_scores(docs, train, tokenizer_path("piece_bpe_32k.model"))


def op7_sum_of_squares_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return window_packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


def op8_longest_first_shards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = shard_schedule.shard_documents(docs)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_decontaminate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    found = decontaminate.decontaminate(docs, items)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_weak_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return weak_rules.quality_votes(docs, keep_text=False)


def op11_source_divergence(spark, sf_dir):
    return source_divergence.source_divergence(table(spark, sf_dir, "documents"))


def op12_simhash_pivots(spark, sf_dir):
    return simhash_pivots.simhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_centroid_clusters(spark, sf_dir):
    return centroid_clusters.centroid_clusters(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_neighbour_quality,
        op2_chat_views,
        op3_license_scan,
        op4_language_id,
        op5_partenum_join,
        op6_lattice_score,
        op7_sum_of_squares_packing,
        op8_longest_first_shards,
        op9_decontaminate,
        op10_weak_rules,
        op11_source_divergence,
        op12_simhash_pivots,
        op13_centroid_clusters,
    )
}


def _cluster_sql(clusters: int = 40, rounds: int = 5) -> str:
    """The rounds of the clustering, each a pair of tables: nearest centroids, and the means after them."""
    steps = [
        """v AS MATERIALIZED (
          SELECT vec_id, [CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT) FOR e IN embedding] AS x
          FROM embeddings WHERE len(embedding) = 64
            AND len([e FOR e IN embedding IF e IS NULL OR NOT isfinite(e)]) = 0)""",
        f"""c0 AS MATERIALIZED (
          SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS INTEGER) AS cluster, x AS c
          FROM v QUALIFY cluster < {clusters})""",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (
          SELECT vec_id, any_value(x) AS x, min((distance, cluster)) AS best FROM (
            SELECT vec_id, x, cluster, CAST(list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(x, c)]) AS BIGINT) AS distance
            FROM v, c{r}) GROUP BY vec_id)"""
        )
        if r < rounds:
            steps.append(
                f"""c{r + 1} AS MATERIALIZED (
          SELECT cluster, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN (
            SELECT cluster, list(mean ORDER BY i) AS c FROM (
              SELECT cluster, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS mean FROM (
                SELECT best[2] AS cluster, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n
                FROM a{r}, range(1, 65) t(i) GROUP BY ALL)) GROUP BY cluster) m USING (cluster))"""
            )
    return f"""
        WITH {", ".join(steps)}
        SELECT vec_id, cluster, best[1] AS distance,
               CAST(sum(best[1]) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
               CAST(sum(best[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} ON cluster = best[2]"""


ORACLE = {
    "op2_chat_views": """
        WITH t AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
                 row_number() OVER (PARTITION BY conv_id
                   ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS position
          FROM conversations),
        v AS (
          SELECT t.conv_id, s.speaker, t.position, t.turn, t.role,
                 '<|im_start|>' || CASE WHEN t.role = s.speaker THEN 'assistant'
                   WHEN t.role = 'system' THEN t.role
                   ELSE 'user name=' || replace(t.role, '<|im_', '<| im_') END || chr(10) AS opening,
                 replace(t.text, '<|im_', '<| im_') || '<|im_end|>' || chr(10) AS said
          FROM t JOIN (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system') s
            ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
        e AS (
          SELECT *, length(opening) + length(said) AS n,
                 CAST(sum(length(opening) + length(said)) OVER (
                   PARTITION BY conv_id, speaker ORDER BY position) AS BIGINT) AS stop
          FROM v)
        SELECT conv_id, speaker, position, turn, role, opening || said AS segment,
               stop - n AS "start", stop AS "end",
               CASE WHEN role = speaker THEN stop - n + length(opening) END AS loss_start,
               CASE WHEN role = speaker THEN stop - 1 END AS loss_end
        FROM e""",
    "op9_decontaminate": """
        WITH item_words AS (
          SELECT item_id, string_split(trim(regexp_replace(
                   translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^0-9a-z\\x{80}-\\x{10FFFF}]+', ' ', 'g')), ' ') AS w
          FROM benchmark WHERE text IS NOT NULL),
        starts AS (
          SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i
          FROM item_words WHERE w <> ['']),
        windows AS MATERIALIZED (
          SELECT DISTINCT item_id, w[i:i + 9] AS gram, len(w[i:i + 9]) AS n FROM starts),
        doc_words AS MATERIALIZED (
          SELECT doc_id, CASE WHEN w = [''] THEN [] ELSE w END AS w FROM (
            SELECT doc_id, string_split(trim(regexp_replace(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^0-9a-z\\x{80}-\\x{10FFFF}]+', ' ', 'g')), ' ') AS w
            FROM documents)),
        lengths AS (SELECT DISTINCT n FROM windows),
        places AS (
          SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w
          FROM doc_words, lengths WHERE len(w) >= n),
        found AS MATERIALIZED (
          SELECT p.doc_id, p.i, p.n, x.item_id
          FROM (SELECT doc_id, i, n, w[i:i + n - 1] AS gram FROM places) p
          JOIN windows x ON x.gram = p.gram),
        hits AS (
          SELECT doc_id, count(DISTINCT j) AS n_hit FROM (
            SELECT doc_id, unnest(range(i, i + n)) AS j FROM found) GROUP BY doc_id),
        items AS (
          SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (
            SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
        SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit,
               coalesce(x.n_items, 0) AS n_items, sha256(coalesce(x.names, '')) AS items_sha256,
               coalesce(h.n_hit, 0) > 0 AS contaminated
        FROM doc_words d LEFT JOIN hits h USING (doc_id) LEFT JOIN items x USING (doc_id)""",
    "op11_source_divergence": """
        WITH d AS (
          SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                 translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
          FROM documents),
        said AS MATERIALIZED (
          SELECT id, lang, source, unnest(regexp_extract_all(t, '[a-z\\x{80}-\\x{10FFFF}]+')) AS term FROM d),
        kept AS MATERIALIZED (
          SELECT lang, term, count(*) AS n FROM said GROUP BY ALL HAVING count(DISTINCT id) >= 30),
        langs AS (
          SELECT lang, coalesce(count(term), 0) AS v, coalesce(sum(n), 0) AS total
          FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang),
        counts AS MATERIALIZED (
          SELECT lang, source, term, count(*) AS n FROM said SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        groups AS MATERIALIZED (
          SELECT lang, source, coalesce(sum(n), 0) AS total
          FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN counts USING (lang, source) GROUP BY ALL),
        shares AS MATERIALIZED (
          SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                 1 + CAST(1000000000 * CAST(coalesce(c.n, 0) + 5 AS HUGEINT) // (g.total + 5 * l.v) AS BIGINT) AS p,
                 1 + CAST(1000000000 * CAST(k.n + 5 AS HUGEINT) // (l.total + 5 * l.v) AS BIGINT) AS q
          FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang)
            LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        pairs AS (
          SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value
          FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        found AS (
          SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
          UNION ALL
          SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value,
               CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
        FROM found QUALIFY part = 'pair' OR rank <= 50""",
    "op13_centroid_clusters": _cluster_sql(),
}
