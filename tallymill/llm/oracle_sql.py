"""The queries that SQL can say as well, in DuckDB's dialect."""

_UNIFORM = "('0x' || substr(md5('8|{what}|' || {row}), 1, 13))::BIGINT / 4503599627370496.0"

OP8 = f"""
WITH sizes AS (
    SELECT source, sum(coalesce(length(text), 0)) AS chars, count(*) AS n_rows FROM documents GROUP BY source
), weighed AS (
    SELECT source, CASE WHEN chars > 0 THEN chars ELSE n_rows END AS size FROM sizes
), rated AS (
    SELECT source,
        power(size::DOUBLE, 0.7) / (SELECT sum(power(size::DOUBLE, 0.7)) FROM weighed)
            * (SELECT sum(size)::DOUBLE FROM weighed) / size AS rate
    FROM weighed
), chances AS (
    SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
    FROM rated, generate_series(0, 200) AS s(k)
), drawn AS (
    SELECT *, coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, ''))) AS own_row,
        {_UNIFORM.format(what="count", row="coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, '')))")} AS u
    FROM documents
), counted AS (
    SELECT d.*, (SELECT count(*) FROM chances c WHERE c.source IS NOT DISTINCT FROM d.source AND c.cdf <= d.u) AS times
    FROM drawn d
)
SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy,
    {_UNIFORM.format(what="place", row="own_row || '|' || copy")} AS mix_key
FROM counted, generate_series(0, times - 1) AS g(copy)
"""

OP10 = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
    UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
SELECT conv_id,
    count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
    sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
    sum(
        length('<|im_start|>' || chr(10) || '<|im_end|>' || chr(10))
        + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\' || chr(10)))
        + length(replace(replace(text, '\', '\\'), '<|', '<\|'))
    )::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""

OP9 = r"""
WITH docs AS (
    SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), windows AS (
    SELECT rid, i, count(*) OVER (PARTITION BY rid, array_to_string(w[i:i + 7], ' ')) AS times
    FROM docs, generate_series(1, len(w) - 7) AS g(i)
), repeats AS (
    SELECT rid, count(DISTINCT i + j) AS n_repeat_words
    FROM windows, generate_series(0, 7) AS h(j) WHERE times > 1 GROUP BY rid
), lines AS (
    SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
    FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM docs)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid
), counted AS (
    SELECT rid, doc_id, lang, source, len(w) AS n_words, coalesce(length(array_to_string(w, '')), 0) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words
    FROM docs LEFT JOIN lines USING (rid) LEFT JOIN repeats USING (rid)
), each_measure AS (
    SELECT rid, lang, source, 'symbols' AS measure, n_symbols / n_words AS x FROM counted WHERE n_words > 0
    UNION ALL SELECT rid, lang, source, 'dup', n_dup_lines / n_lines FROM counted WHERE n_words > 0
    UNION ALL SELECT rid, lang, source, 'repeat', n_repeat_words / n_words FROM counted WHERE n_words > 0
    UNION ALL SELECT rid, lang, source, 'word', word_chars / n_words FROM counted WHERE n_words > 0
), bucketed AS (
    SELECT *, CASE WHEN x > 0 THEN ceil(ln(x) / ln(1.01::DOUBLE / 0.99::DOUBLE)) ELSE -2147483648 END AS bucket
    FROM each_measure
), levels AS (
    SELECT 0 AS level, lang, source, lang AS l, source AS s, measure, bucket FROM bucketed
    UNION ALL SELECT 1, lang, source, lang, NULL, measure, bucket FROM bucketed
    UNION ALL SELECT 2, lang, source, NULL, NULL, measure, bucket FROM bucketed
), ranked AS (
    SELECT level, l, s, measure, bucket, count(*) OVER (PARTITION BY level, l, s, measure) AS total,
        count(*) OVER (PARTITION BY level, l, s, measure ORDER BY bucket) AS upto
    FROM levels
), quantiles AS (
    SELECT level, l, s, measure, max(total) AS total,
        min(bucket) FILTER (WHERE upto * 1000 >= total * 250) AS b25,
        min(bucket) FILTER (WHERE upto * 1000 >= total * 500) AS b50,
        min(bucket) FILTER (WHERE upto * 1000 >= total * 750) AS b75
    FROM ranked GROUP BY level, l, s, measure
), valued AS (
    SELECT level, l, s, measure, total,
        CASE WHEN b25 > -2147483648 THEN exp((b25 - 0.5) * ln(1.01::DOUBLE / 0.99::DOUBLE)) ELSE 0 END AS q25,
        CASE WHEN b50 > -2147483648 THEN exp((b50 - 0.5) * ln(1.01::DOUBLE / 0.99::DOUBLE)) ELSE 0 END AS q50,
        CASE WHEN b75 > -2147483648 THEN exp((b75 - 0.5) * ln(1.01::DOUBLE / 0.99::DOUBLE)) ELSE 0 END AS q75
    FROM quantiles
), checked AS (
    SELECT b.rid,
        bool_and(b.x <= v.q50 + 4 * (v.q75 - v.q50)
                + CASE b.measure WHEN 'symbols' THEN 0.2 WHEN 'dup' THEN 0.4 WHEN 'repeat' THEN 0.25 ELSE 1.0 END
            AND (b.measure NOT IN ('dup', 'repeat') OR b.x <= 0.9
                AND b.x <= everything.q50 + 4 * (everything.q75 - everything.q50) + CASE b.measure WHEN 'dup' THEN 0.4 ELSE 0.25 END
                AND (language.total < 100
                    OR b.x <= language.q50 + 4 * (language.q75 - language.q50) + CASE b.measure WHEN 'dup' THEN 0.4 ELSE 0.25 END))
            AND (b.measure <> 'word' OR b.x >= v.q50 - 4 * (v.q50 - v.q25) - 1.0)) AS good
    FROM bucketed b
    JOIN valued own ON own.level = 0 AND own.l IS NOT DISTINCT FROM b.lang AND own.s IS NOT DISTINCT FROM b.source AND own.measure = b.measure
    JOIN valued language ON language.level = 1 AND language.l IS NOT DISTINCT FROM b.lang AND language.measure = b.measure
    JOIN valued everything ON everything.level = 2 AND everything.measure = b.measure
    JOIN valued v ON v.measure = b.measure AND (
        CASE WHEN own.total >= 100 THEN v.level = 0 AND v.l IS NOT DISTINCT FROM b.lang AND v.s IS NOT DISTINCT FROM b.source
             WHEN language.total >= 100 THEN v.level = 1 AND v.l IS NOT DISTINCT FROM b.lang
             ELSE v.level = 2 END)
    GROUP BY b.rid
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND coalesce(good, false) AS kept
FROM counted LEFT JOIN checked USING (rid)
"""

OP11 = r"""
WITH texts AS (
    SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), placed AS (
    SELECT rid, unnest(words) AS word, unnest(range(len(words))) AS pos FROM texts
), windows AS (
    SELECT rid, pos, string_agg(word, ' ') OVER w AS words, count(*) OVER w AS n
    FROM placed WINDOW w AS (PARTITION BY rid ORDER BY pos ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)
), repeated AS (
    SELECT rid, pos, n = 35 AND count(*) OVER (PARTITION BY CASE WHEN n = 35 THEN words ELSE rid || ' ' || pos END, n) > 1 AS twice FROM windows
), covered AS (
    SELECT rid, pos, bool_or(twice) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS removed FROM repeated
), kept AS (
    SELECT rid, count(*) FILTER (WHERE removed) AS n_removed,
        coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT removed), '') AS words
    FROM placed JOIN covered USING (rid, pos) GROUP BY rid
)
SELECT doc_id, len(t.words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k.words, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k USING (rid)
"""

OP12 = r"""
WITH held AS (
    SELECT row_number() OVER () AS rid, doc_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents
), asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
), sizes AS (
    SELECT rid, any_value(doc_id) AS doc_id, count(*)::BIGINT AS n FROM held GROUP BY rid
), totals AS (
    SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM sizes
), counts AS (
    SELECT rid, term, count(*)::BIGINT AS tf FROM held WHERE term IN (SELECT term FROM asked) GROUP BY rid, term
), weights AS (
    SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM counts, totals GROUP BY term
), worth AS (
    SELECT c.rid, s.doc_id, c.term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // length)))) AS x
    FROM counts c JOIN sizes s USING (rid) JOIN weights USING (term), totals
), scored AS (
    SELECT item_id, rid, any_value(doc_id) AS doc_id, sum(x)::BIGINT AS score FROM worth JOIN asked USING (term) GROUP BY item_id, rid
), ranked AS (
    SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
