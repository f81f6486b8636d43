"""The test-table views and study steps as ANSI SQL, for side-by-side checks.

Each view is (names it needs, query). ``sql`` puts the needed ones in a WITH clause.
"""

from __future__ import annotations

# name: (needed views, query)
VIEWS: dict[str, tuple[str, str]] = {
    "messages": ("", """
        SELECT doc_id AS row_id,
               CASE lang WHEN 'de' THEN -1 WHEN 'fr' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 END::INT AS sentiment,
               text AS message, doc_id AS tweetid
        FROM documents"""),
    "messages_null": ("messages", """
        SELECT row_id, sentiment, CASE WHEN row_id % 17 <> 0 THEN message END AS message, tweetid FROM messages"""),
    "conflict_pairs": ("", """
        SELECT f.doc_id AS a, d.doc_id AS b
        FROM documents d JOIN (
            SELECT text, doc_id, source FROM documents
            QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1) f ON d.text = f.text
        WHERE d.doc_id > f.doc_id AND d.source <> f.source"""),
    "clean": ("messages", """
        SELECT row_id, sentiment, message, tweetid FROM (
            SELECT row_id, (sentiment + 1)::INT AS sentiment, message, tweetid FROM messages
            WHERE row_id IS NOT NULL AND sentiment IS NOT NULL AND message IS NOT NULL AND tweetid IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY message ORDER BY row_id) = 1)
        QUALIFY row_number() OVER (PARTITION BY tweetid ORDER BY row_id) = 1"""),
    "class_counts": ("clean", "SELECT sentiment, count(*) AS n FROM clean GROUP BY sentiment"),
    "total": ("clean", "SELECT count(*) AS n FROM clean"),
    "shares": ("class_counts total", """
        SELECT c.sentiment, c.n AS class_n, c.n / t.n AS p FROM class_counts c, total t"""),
    "region_size": ("total", """
        SELECT 0 AS ord, 'train' AS region, n * 60 // 100 AS size FROM total
        UNION ALL SELECT 1, 'test', n * 12 // 100 FROM total
        UNION ALL SELECT 2, 'validation', n * 6 // 100 FROM total
        UNION ALL SELECT 3, 'noise', n * 22 // 100 FROM total"""),
    "region_asked": ("region_size shares", """
        SELECT ord, region, sentiment, class_n,
               CASE WHEN sentiment = 3 THEN size - sum(CASE WHEN sentiment < 3 THEN round_even(size * p, 0) ELSE 0 END)
                                                       OVER (PARTITION BY region)
                    ELSE round_even(size * p, 0) END::BIGINT AS need
        FROM region_size, shares"""),
    "noise_room": ("region_asked", """
        SELECT ord, region, sentiment, least(need, room) AS take, room - least(need, room) AS spare,
               sum(need - least(need, room)) OVER () AS missing
        FROM (SELECT *, class_n - sum(CASE WHEN region <> 'noise' THEN need ELSE 0 END) OVER (PARTITION BY sentiment)
                        AS room FROM region_asked) WHERE region = 'noise'"""),
    "region_quota": ("region_asked noise_room", """
        SELECT ord, region, sentiment, need FROM region_asked WHERE region <> 'noise'
        UNION ALL
        SELECT ord, region, sentiment, take + greatest(0, least(spare, missing - coalesce(
                   sum(spare) OVER (ORDER BY spare DESC, sentiment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))
        FROM noise_room"""),
    "region_bounds": ("region_quota", """
        SELECT region, sentiment, need,
               coalesce(sum(need) OVER (PARTITION BY sentiment ORDER BY ord
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first
        FROM region_quota"""),
    "ranked": ("clean", """
        SELECT *, row_number() OVER (PARTITION BY sentiment ORDER BY md5('522:' || row_id), row_id) AS class_rank
        FROM clean"""),
    "regions": ("ranked region_bounds", """
        SELECT r.row_id, r.sentiment, r.message, r.tweetid, r.class_rank, b.region,
               r.class_rank - b.first AS region_rank
        FROM ranked r LEFT JOIN region_bounds b
          ON r.sentiment = b.sentiment AND r.class_rank > b.first AND r.class_rank <= b.first + b.need"""),
    "mislabeled": ("regions", """
        SELECT row_id, message,
               ((sentiment + 1 + ('0x' || substr(md5('522:label:' || row_id), 1, 8))::BIGINT % 3) % 4)::INT
                   AS sentiment,
               tweetid, sentiment AS origin, 'mislabeled' AS noise_text
        FROM regions WHERE region = 'noise'"""),
    "irrelevant_raw": ("", """
        SELECT conv_id * 100000 + turn AS row_id, text AS message FROM conversations"""),
    "irrelevant_labelled": ("irrelevant_raw", """
        SELECT row_id, message,
               (CASE WHEN pos <= q THEN 0 WHEN pos <= 2 * q THEN 1 WHEN pos <= 3 * q THEN 2 ELSE 3 END)::INT
                   AS sentiment
        FROM (SELECT *, row_number() OVER (ORDER BY row_id) AS pos,
                     round_even(count(*) OVER () * 0.25::DOUBLE, 0)::BIGINT AS q FROM irrelevant_raw)"""),
    "irrelevant": ("irrelevant_labelled", """
        SELECT row_id, message, sentiment, (-1)::BIGINT AS tweetid, NULL::INT AS origin, 'irrelevant' AS noise_text
        FROM irrelevant_labelled WHERE message IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY message ORDER BY md5('522:' || row_id), row_id) = 1"""),
    "irrelevant_capped": ("irrelevant irrelevant_labelled", """
        SELECT * FROM irrelevant QUALIFY row_number() OVER (ORDER BY md5('522:' || row_id), row_id)
                <= (SELECT count(*) // 2 FROM irrelevant_labelled)"""),
    "translated_raw": ("messages", """
        SELECT row_id, sentiment, array_to_string(list_reverse(string_split(message, ' ')), ' ') AS message, tweetid
        FROM messages"""),
    "translated_labelled": ("translated_raw", """
        SELECT row_id, message, tweetid, origin,
               CASE WHEN pos <= half
                    THEN ((origin + 1 + ('0x' || substr(md5('522:label:' || row_id), 1, 8))::BIGINT % 3) % 4)::INT
                    ELSE origin END AS sentiment
        FROM (SELECT row_id, message, tweetid, (sentiment + 1)::INT AS origin,
                     row_number() OVER (ORDER BY md5('522:' || row_id), row_id) AS pos,
                     floor(count(*) OVER () * 0.5::DOUBLE) AS half FROM translated_raw)"""),
    "translated_outside": ("translated_labelled regions", """
        SELECT * FROM translated_labelled
        WHERE tweetid NOT IN (SELECT tweetid FROM regions WHERE region = 'test')
        QUALIFY row_number() OVER (PARTITION BY tweetid ORDER BY md5('522:' || row_id), row_id) = 1"""),
    "translated": ("translated_outside", """
        SELECT row_id, message, sentiment, tweetid, origin, 'translated' AS noise_text FROM translated_outside
        WHERE message IS NOT NULL AND sentiment IS NOT NULL AND tweetid IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY message ORDER BY md5('522:' || row_id), row_id) = 1"""),
    "pool": ("mislabeled irrelevant translated", """
        SELECT *, CASE noise_text WHEN 'mislabeled' THEN 1 WHEN 'irrelevant' THEN 2 ELSE 3 END::INT AS noise
        FROM (SELECT * FROM mislabeled UNION ALL SELECT * FROM irrelevant UNION ALL SELECT * FROM translated)"""),
    "mix_sizes": ("region_size", """
        SELECT size // 2 AS original, size // 8 AS noisy FROM region_size WHERE region = 'train'"""),
    "train_half": ("regions shares mix_sizes", """
        SELECT r.* FROM regions r JOIN (
            SELECT sentiment, CASE WHEN sentiment = 3
                THEN original - sum(CASE WHEN sentiment < 3 THEN round_even(original * p, 0) ELSE 0 END) OVER ()
                ELSE round_even(original * p, 0) END AS need FROM shares, mix_sizes) q ON r.sentiment = q.sentiment
        WHERE r.region = 'train' AND r.region_rank <= q.need"""),
    "translated_free": ("pool train_half", """
        SELECT * FROM pool WHERE noise_text = 'translated' AND tweetid NOT IN (SELECT tweetid FROM train_half)"""),
    "mix_quota": ("pool translated_free mix_sizes", """
        SELECT noisy, CASE WHEN wanted * 0.97::DOUBLE < free AND free < wanted THEN free ELSE wanted END AS quota
        FROM (SELECT noisy, free,
                     greatest(floor(noisy * (t / n) * (0.98::DOUBLE + 0.04::DOUBLE *
                        (('0x' || substr(md5((noisy + 522) || ':jitter'), 1, 8))::BIGINT / 4294967296.0::DOUBLE))),
                        noisy - (n - t)) AS wanted
              FROM mix_sizes, (SELECT count(*) AS n, count(*) FILTER (noise_text = 'translated') AS t FROM pool),
                   (SELECT count(*) AS free FROM translated_free))"""),
    "mixed": ("train_half translated_free pool mix_quota", """
        SELECT *, row_number() OVER (ORDER BY md5('522:' || noise_text || ':' || row_id), noise_text, row_id) - 1
                  AS index
        FROM (
            SELECT row_id, message, sentiment, tweetid, NULL::INT AS origin, 'none' AS noise_text, 0 AS noise
            FROM train_half
            UNION ALL
            SELECT row_id, message, sentiment, tweetid, origin, noise_text, noise FROM (
                SELECT *, row_number() OVER (ORDER BY md5('522:' || noise_text || ':' || row_id)) AS pos
                FROM pool WHERE noise_text <> 'translated')
            WHERE pos <= (SELECT noisy - quota FROM mix_quota)
            UNION ALL
            SELECT row_id, message, sentiment, tweetid, origin, noise_text, noise FROM (
                SELECT *, row_number() OVER (ORDER BY md5('522:' || noise_text || ':' || row_id)) AS pos
                FROM translated_free)
            WHERE pos <= (SELECT quota FROM mix_quota))"""),
    "vectors": ("", """
        SELECT vec_id AS row_id, embedding::DOUBLE[] AS features, label AS sentiment FROM embeddings"""),
    "outlier_vectors": ("vectors", """
        SELECT row_id, sentiment, CASE WHEN row_id % 25 = 0 THEN 1 ELSE 0 END AS noise,
               CASE WHEN row_id % 25 = 0 THEN list_transform(features, lambda x: x * 4) ELSE features END AS features
        FROM vectors"""),
    "separated_long": ("vectors", """
        SELECT row_id, sentiment, pos, x + CASE WHEN pos - 1 = sentiment THEN 1.0::DOUBLE ELSE 0 END AS x
        FROM (SELECT row_id, sentiment, unnest(features) AS x, generate_subscripts(features, 1) AS pos FROM vectors)"""),
    "noisy_labels": ("vectors", """
        SELECT row_id, sentiment AS origin, moved::INT AS noise,
               CASE WHEN moved THEN ((sentiment + 1 + ('0x' || substr(md5('523:' || row_id), 1, 8))::BIGINT % 9) % 10)::INT
                    ELSE sentiment END AS sentiment
        FROM (SELECT *, ('0x' || substr(md5('522:' || row_id), 1, 8))::BIGINT % 10 = 0 AS moved FROM vectors)"""),
    "noisy_long": ("separated_long noisy_labels", """
        SELECT l.row_id, l.pos, l.x, n.sentiment FROM separated_long l JOIN noisy_labels n ON l.row_id = n.row_id"""),
    "probabilities": ("noisy_long noisy_labels", """
        SELECT w.row_id, n.sentiment, n.origin, n.noise, w.class, w / sum(w) OVER (PARTITION BY w.row_id) AS prob
        FROM (SELECT l.row_id, m.sentiment AS class, exp(-8 * sqrt(sum((l.x - m.m) * (l.x - m.m)))) AS w
              FROM noisy_long l JOIN (SELECT sentiment, pos, avg(x) AS m FROM noisy_long GROUP BY 1, 2) m
                ON l.pos = m.pos GROUP BY 1, 2) w JOIN noisy_labels n ON w.row_id = n.row_id"""),
    "vector_long": ("vectors", """
        SELECT row_id, sentiment, unnest(features) AS x, generate_subscripts(features, 1) AS pos FROM vectors"""),
    "predictions": ("vector_long", """
        SELECT row_id, y_true, arg_min(class, d)::INT AS y_pred FROM (
            SELECT l.row_id, l.sentiment AS y_true, m.sentiment AS class, sqrt(sum((l.x - m.m) * (l.x - m.m))) AS d
            FROM vector_long l
            JOIN (SELECT sentiment, pos, avg(x) AS m FROM vector_long GROUP BY 1, 2) m ON l.pos = m.pos
            GROUP BY 1, 2, 3) GROUP BY 1, 2"""),
    "history": ("", """
        SELECT event_type AS run,
               date_sub('hour', t0, ts)::INT AS epoch,
               min(value) AS loss, max(value) AS accuracy, round(stddev_pop(value), 6) AS val_loss,
               round(avg(value), 6) AS val_accuracy
        FROM events JOIN (SELECT event_type, min(ts) AS t0 FROM events GROUP BY 1) USING (event_type) GROUP BY 1, 2"""),
}


def _collect(names: list[str], seen: list[str]) -> None:
    for name in names:
        if name not in seen:
            _collect(VIEWS[name][0].split(), seen)
            seen.append(name)


def sql(needs: str, query: str) -> str:
    """``query`` with the views it needs (space-separated names) as a WITH clause."""
    names: list[str] = []
    _collect(needs.split(), names)
    if not names:
        return query
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in names)
    body = query.strip()
    if body.startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
