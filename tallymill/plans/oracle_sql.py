"""The catalogue's queries as SQL for an independent engine (DuckDB dialect), written directly
from the definitions: plain windows and joins instead of the chunked forms."""

from __future__ import annotations

from tallymill.functions.constants import (
    ALL_SPACES,
    FIRST_YEAR,
    POPULARITY,
    POPULARITY_REST,
    PUNCTUATION,
    QUALITY,
    QUALITY_REST,
    UNKNOWN,
    UNKNOWN_TITLE,
)
from tallymill.plans.catalogue import NULLABLE_INTEGERS

TITLES = """
titles AS (
  SELECT o_orderkey AS movie_id,
    CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE 'Title ' || CAST(o_orderkey AS VARCHAR) END AS title,
    CAST(CASE WHEN o_orderkey % 33 = 0 THEN NULL ELSE year(o_orderdate) END AS INTEGER) AS year,
    CASE WHEN o_orderkey % 20 = 0 THEN NULL ELSE o_totalprice / 50000 END AS rating_score,
    (o_orderkey * 7919) % 1000003 AS rating_count,
    CASE WHEN o_orderkey % 40 = 0 THEN NULL
      ELSE substr(o_orderpriority, 3) || '/' || c_mktsegment END AS genres,
    n_name || CASE WHEN o_orderkey % 3 = 0 THEN '/NATION_X' ELSE '' END AS countries,
    c_name AS directors,
    (o_orderkey * 104729) % 500009 AS collect_count
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

MESSY = (
    TITLES
    + """,
copied AS (
  SELECT *, unnest(CASE WHEN movie_id % 25 = 0 THEN [0, 0] WHEN movie_id % 30 = 0 THEN [0, 1]
    ELSE [0] END) AS copy
  FROM titles),
messy AS (
  SELECT CASE WHEN movie_id % 61 = 0 THEN NULL ELSE movie_id END AS movie_id,
    CASE WHEN movie_id % 4 = 0 THEN '  ' || title || ' ' ELSE title END AS title,
    CASE WHEN movie_id % 45 = 0 THEN 1500 ELSE year END AS year,
    rating_score,
    CASE WHEN movie_id % 97 = 0 THEN rating_count * 20 ELSE rating_count END + copy * 1000 AS rating_count,
    genres, countries, directors, collect_count
  FROM copied)"""
)

MOVIE_COLUMNS = (
    "movie_id, title, year, rating_score, rating_count, genres, countries, directors, collect_count"
)
ROUNDED_COLUMNS = MOVIE_COLUMNS.replace("rating_score", "round(rating_score, 9) AS rating_score")

SURVIVOR = """row_number() OVER (PARTITION BY movie_id ORDER BY rating_count DESC NULLS LAST,
    collect_count DESC NULLS LAST, title NULLS LAST, year NULLS LAST, rating_score NULLS LAST,
    rating_count NULLS LAST, genres NULLS LAST, countries NULLS LAST, directors NULLS LAST,
    collect_count NULLS LAST)"""


def _filled(source: str, title: str, year: str = "coalesce(year, 0)", movie_id: str = "movie_id",
            score: str | None = None) -> str:
    score = score or f"(SELECT avg(rating_score) FROM {source})"
    return f"""
  SELECT {movie_id} AS movie_id, {title} AS title, {year} AS year,
    coalesce(rating_score, {score}) AS rating_score,
    coalesce(rating_count, 0) AS rating_count, coalesce(genres, '{UNKNOWN}') AS genres,
    coalesce(countries, '{UNKNOWN}') AS countries, coalesce(directors, '{UNKNOWN}') AS directors,
    coalesce(collect_count, 0) AS collect_count
  FROM {source}"""


ANALYSIS = (
    MESSY
    + f""",
filled AS ({_filled("messy", f"coalesce(title, '{UNKNOWN}')")}),
single AS (SELECT {MOVIE_COLUMNS} FROM (SELECT *, {SURVIVOR} AS rn FROM filled) WHERE rn = 1),
movies AS (SELECT * FROM single WHERE rating_score BETWEEN 1.0 AND 10.0)"""
)


def _bench(source: str) -> str:
    fields = _filled(source, "title", score="6.0").replace(
        f"coalesce(directors, '{UNKNOWN}') AS directors", "directors"
    )
    return f"""movies AS (SELECT * FROM ({fields}) WHERE rating_score BETWEEN 1.0 AND 10.0)"""


MESSY_BENCH = MESSY + ",\n" + _bench("messy")
TITLES_BENCH = TITLES + ",\n" + _bench("titles")

SIGMA = """
    rating_count >= greatest(0, (SELECT avg(rating_count) - 3 * stddev_samp(rating_count) FROM {0}))
    AND rating_count <= (SELECT avg(rating_count) + 3 * stddev_samp(rating_count) FROM {0})"""

CLUSTER = (
    MESSY
    + f""",
filled AS ({_filled("messy", f"coalesce(title, '{UNKNOWN_TITLE}')", movie_id="coalesce(movie_id, 0)")}),
single AS (SELECT DISTINCT * FROM filled),
scored AS (SELECT * FROM single WHERE rating_score BETWEEN 0 AND 10),
dated AS (SELECT * FROM scored WHERE year >= {FIRST_YEAR} OR year = 0),
cleaned AS (SELECT * FROM dated WHERE {SIGMA.format("dated")})"""
)

LOCAL = (
    MESSY
    + f""",
known AS (SELECT * FROM messy WHERE year IS NOT NULL),
filled AS ({_filled("known", f"coalesce(title, '{UNKNOWN_TITLE}')", "year", "coalesce(movie_id, 0)")}),
single AS (SELECT {MOVIE_COLUMNS} FROM (SELECT *, {SURVIVOR} AS rn FROM filled) WHERE rn = 1),
scored AS (SELECT * FROM single WHERE rating_score BETWEEN 1 AND 10),
dated AS (SELECT * FROM scored WHERE year >= {FIRST_YEAR} OR year = 0),
cleaned AS (SELECT * FROM dated WHERE {SIGMA.format("dated")})"""
)

TRIMMED = ROUNDED_COLUMNS
for _name in ("title", "genres", "countries", "directors"):
    TRIMMED = TRIMMED.replace(_name, f"trim({_name}, ' ') AS {_name}")


def _audit(steps: list[tuple[str, str, str]]) -> str:
    rows = " UNION ALL ".join(
        f"SELECT {i} AS position, '{name}' AS step, (SELECT count(*) FROM {before}) AS rows_before, "
        f"(SELECT count(*) FROM {after}) AS rows_after"
        for i, (name, before, after) in enumerate(steps, start=1)
    )
    return f"SELECT *, rows_before - rows_after AS removed FROM ({rows})"


READINGS = """
delivered AS (
  SELECT *, unnest(CASE WHEN event_id % 8 = 0 THEN [0, 1] ELSE [0] END) AS delivery FROM events),
readings AS (
  SELECT CASE WHEN user_id % 7 = 0 THEN 'd' ELSE 'dev-' END || CAST(user_id AS VARCHAR) AS device_id,
    event_id AS seq, ts, ts + to_milliseconds(event_id % 1000 + delivery * 5000) AS arrival_ts,
    'sensors/' || CASE WHEN event_type IN ('view', 'click') THEN 'temperature'
      WHEN event_type = 'error' THEN 'status' ELSE 'humidity' END AS topic,
    CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS temperature,
    CASE WHEN event_id % 15 = 0 THEN NULL ELSE 60 - value / 10 END AS humidity,
    CASE WHEN event_id % 3 = 0 THEN 'offline' ELSE 'online' END AS status
  FROM delivered)"""

MEASURED = (
    READINGS
    + """,
measured AS (
  SELECT *, (epoch_us(arrival_ts) - epoch_us(ts)) / 1000000 AS latency,
    round((epoch_us(arrival_ts) - epoch_us(ts)) / 1000, 1) AS latency_ms
  FROM (SELECT *, row_number() OVER (PARTITION BY device_id, seq ORDER BY arrival_ts, topic) AS rn
        FROM readings WHERE topic IN ('sensors/temperature', 'sensors/humidity'))
  WHERE rn = 1)"""
)

METRICS = """
samples AS (
  SELECT CASE event_id % 4 WHEN 0 THEN 'cpu_seconds' WHEN 1 THEN 'memory_bytes' WHEN 2 THEN 'net_tx'
      ELSE 'net_rx' END AS metric,
    'node-' || CAST(user_id % 5 AS VARCHAR) AS instance, 'pod-' || CAST(user_id AS VARCHAR) AS pod,
    CASE WHEN user_id % 4 = 0 THEN 'kube-system' ELSE 'default' END AS namespace,
    CASE WHEN event_id % 13 = 0 THEN '' ELSE 'c1' END AS container,
    CASE WHEN event_id % 5 = 0 THEN 'user' ELSE 'idle' END AS mode,
    ts, event_id, CAST(event_id % 1000 AS DOUBLE) AS value
  FROM events)"""


RATE_COLUMNS = (
    " SELECT instance, pod, namespace, container, mode, window_start, increase, "
    "round(seconds, 6) AS seconds, round(rate, 9) AS rate FROM rates"
)
LABELS = "metric, instance, pod, namespace, container, mode"


def _rates(where: str, window: str = "date_trunc('day', ts)") -> str:
    return f"""{METRICS},
pairs AS (
  SELECT *, lag(value) OVER w AS previous, lag(ts) OVER w AS previous_ts
  FROM samples WHERE {where} WINDOW w AS (PARTITION BY {LABELS} ORDER BY ts, event_id)),
rates AS (
  SELECT {LABELS}, {window} AS window_start,
    sum(CASE WHEN value < previous THEN value ELSE value - previous END) AS increase,
    sum(epoch_us(ts) - epoch_us(previous_ts)) / 1000000 AS seconds,
    sum(CASE WHEN value < previous THEN value ELSE value - previous END)
      / (sum(epoch_us(ts) - epoch_us(previous_ts)) / 1000000) AS rate
  FROM pairs WHERE previous_ts IS NOT NULL GROUP BY ALL HAVING sum(epoch_us(ts) - epoch_us(previous_ts)) > 0)"""


# What the stream of JSON messages keeps of the readings.
STREAMED = (
    READINGS.replace("readings AS (", "all_readings AS (")
    + """,
kinds AS (SELECT *, CASE WHEN seq % 19 = 0 THEN 'text' WHEN seq % 23 = 0 THEN 'empty'
  WHEN topic = 'sensors/status' THEN 'status' WHEN seq % 29 = 0 THEN 'millis' WHEN seq % 31 = 0 THEN 'nan'
  WHEN seq % 11 = 0 THEN 'unnumbered' ELSE 'reading' END AS kind FROM all_readings),
readings AS (SELECT * REPLACE (CASE WHEN kind = 'reading' THEN seq END AS seq) FROM kinds
  WHERE kind = 'reading' OR kind = 'unnumbered' AND (temperature IS NOT NULL OR humidity IS NOT NULL))"""
)


#: Each streamed reading at its first arrival; readings without a number are told apart by what they say.
STREAMED_ONCE = (
    STREAMED
    + """,
arrived AS (SELECT * FROM readings QUALIFY row_number() OVER (PARTITION BY device_id, seq,
  CASE WHEN seq IS NULL THEN ts END, CASE WHEN seq IS NULL THEN temperature END, CASE WHEN seq IS NULL THEN humidity END
  ORDER BY arrival_ts, topic) = 1)"""
)


def _rolling_latency(rows: int, partition: str = "") -> str:
    return f"""WITH {STREAMED_ONCE}
SELECT device_id, seq, ts, arrival_ts, (epoch_us(arrival_ts) - epoch_us(ts)) / 1000000 AS latency,
  round(avg((epoch_us(arrival_ts) - epoch_us(ts)) / 1000000) OVER ({partition} ORDER BY arrival_ts, seq NULLS LAST, device_id, ts
    ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW), 12) AS avg_latency FROM arrived"""


def _unexpired(ttl: str, readings: str = READINGS) -> str:
    return f"""WITH {readings},
gaps AS (
  SELECT *, coalesce(ts >= lag(ts) OVER w + INTERVAL '{ttl}', false) AS gap
  FROM readings WINDOW w AS (PARTITION BY device_id ORDER BY ts, seq)),
sessions AS (
  SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY device_id ORDER BY ts, seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM gaps),
live AS (
  SELECT * FROM sessions QUALIFY session = max(session) OVER (PARTITION BY device_id))
SELECT device_id,
  (array_agg(temperature ORDER BY ts DESC, seq DESC) FILTER (WHERE temperature IS NOT NULL))[1] AS temperature,
  (array_agg(humidity ORDER BY ts DESC, seq DESC) FILTER (WHERE humidity IS NOT NULL))[1] AS humidity,
  max(ts) AS last_seen
FROM live GROUP BY device_id
HAVING max(ts) + INTERVAL '{ttl}' > (SELECT max(ts) FROM readings)"""


LATEST = """SELECT device_id,
  (array_agg(temperature ORDER BY ts DESC, seq DESC) FILTER (WHERE temperature IS NOT NULL))[1] AS temperature,
  (array_agg(humidity ORDER BY ts DESC, seq DESC) FILTER (WHERE humidity IS NOT NULL))[1] AS humidity,
  max(ts) AS last_seen FROM readings GROUP BY device_id"""

WINDOWS = """SELECT device_id, time_bucket(INTERVAL '5 minutes', ts) AS window_start,
  time_bucket(INTERVAL '5 minutes', ts) + INTERVAL '5 minutes' AS window_end, count(*) AS readings,
  round(avg(temperature), 6) AS avg_temperature, round(avg(humidity), 6) AS avg_humidity
FROM {0} GROUP BY ALL"""


def _case(column: str, lows: list, rest: str) -> str:
    whens = " ".join(f"WHEN {column} >= {low} THEN '{label}'" for low, label in lows)
    return f"CASE {whens} ELSE '{rest}' END"


def _class(characters: str) -> str:
    """A quoted regular-expression class of the characters."""
    escaped = "".join(f"\\x{{{ord(c):x}}}" for c in characters)
    return f"'[{escaped}]"


CLEAN_WORDS = f"""words AS (
  SELECT unnest(regexp_split_to_array(
    regexp_replace(lower(text), {_class(PUNCTUATION)}', ' ', 'g'), '\\s+')) AS word FROM documents),
counts AS (SELECT word, count(*) AS count FROM words WHERE length(word) >= 2 GROUP BY word)"""

RAW_WORDS = f"""words AS (
  SELECT unnest(regexp_split_to_array(text, {_class(ALL_SPACES)}+')) AS word FROM documents),
counts AS (SELECT word, count(*) AS count FROM words WHERE length(word) >= 1 GROUP BY word)"""

GENRE = "split_part(genres, '/', 1)"
COUNTRY = "split_part(countries, '/', 1)"
DIRECTOR = "split_part(directors, '/', 1)"


def _missing(expression: str) -> str:
    return ", ".join(f"{expression.format(c)} AS {c}" for c in MOVIE_COLUMNS.split(", "))


def _category(source: str, category: str, value: str, quantity: str, units: int) -> str:
    return f"""SELECT {category} AS category, count(*) AS cnt,
  sum(CAST(round({value} * {units}) AS BIGINT)) / {units} AS total_value, round(avg({value}), 4) AS avg_value,
  CAST(sum({quantity}) AS BIGINT) AS total_qty FROM {source} GROUP BY 1"""


def _describe(column: str) -> str:
    return (
        f"SELECT '{column}' AS \"column\", count({column}) AS count, round(avg({column}), 4) AS mean, "
        f"round(stddev_samp({column}), 4) AS stddev, min({column}) AS min, max({column}) AS max, "
        "CAST(NULL AS VARCHAR) AS first, CAST(NULL AS VARCHAR) AS last FROM lineitem"
    )


def _describe_text(column: str) -> str:
    return (
        f"SELECT '{column}' AS \"column\", count({column}) AS count, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS stddev, "
        f"CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, min({column}) AS first, max({column}) AS last FROM lineitem"
    )


def _as_text(sql: str, columns: list[str]) -> str:
    casts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in columns)
    return f"SELECT * REPLACE ({casts}) FROM ({sql})"


def oracle_sql() -> dict[str, str]:
    return {
        name: _as_text(sql, NULLABLE_INTEGERS[name]) if name in NULLABLE_INTEGERS else sql
        for name, sql in _oracle_sql().items()
    }


def _oracle_sql() -> dict[str, str]:
    return {
        # sources and sinks
        "csv_roundtrip": f"WITH {TITLES} SELECT * REPLACE (CASE WHEN movie_id % 70 = 0 THEN '' ELSE genres END AS genres) FROM titles",
        "csv_multiline_roundtrip": "SELECT doc_id, text, lang, source, n_chars FROM documents",
        "csv_multiline_split": "SELECT doc_id, text, lang, source, n_chars FROM documents",
        "source_fallback": "SELECT o_orderpriority, count(*) AS orders FROM orders GROUP BY 1",
        "synth_group": "WITH synth AS (SELECT o_orderkey AS id, "
        "CAST((o_orderkey * 7919) % 10 AS INTEGER) AS category, "
        "(o_orderkey * 104729) % 1000000 / 1000 AS value, (o_orderkey * 31) % 20 + 1 AS quantity FROM orders) "
        + _category("synth", "category", "value", "quantity", 1000),
        # profiles
        "missing_counts": f"WITH {MESSY} SELECT {_missing('count(*) - count({0})')} FROM messy",
        "missing_rates": f"WITH {MESSY} SELECT "
        + _missing("round((count(*) - count({0})) * 100.0::DOUBLE / count(*), 6)")
        + " FROM messy",
        "summary_stats": "SELECT round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS stddev, "
        "min(value) AS min, max(value) AS max FROM events",
        "vs_group_avg_large": f"""WITH {TITLES},
marked AS (SELECT movie_id, rating_score, CASE WHEN movie_id % 10 < 3 THEN '{UNKNOWN}' ELSE {GENRE} END AS genre FROM titles),
means AS (SELECT genre, round(avg(rating_score), 2) AS mean FROM marked
  WHERE genre <> '{UNKNOWN}' GROUP BY genre HAVING count(*) >= 50)
SELECT movie_id, genre, mean AS genre_avg_score, round(rating_score - mean, 2) AS above_avg
FROM marked JOIN means USING (genre) WHERE rating_score IS NOT NULL""",
        "describe_long": " UNION ALL ".join(
            [*(_describe(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")), _describe_text("l_returnflag")]
        ),
        "read_lines": "SELECT lang, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM "
        "(SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY lang",
        "schema_report": "SELECT name, type, count AS rows FROM (VALUES ('movie_id', 'bigint'), ('title', 'string'), "
        "('year', 'int'), ('rating_score', 'double'), ('rating_count', 'bigint'), ('genres', 'string'), "
        "('countries', 'string'), ('directors', 'string'), ('collect_count', 'bigint')) AS v(name, type), "
        f"(WITH {TITLES} SELECT count(*) AS count FROM titles)",
        # cleaning
        "drop_missing": f"WITH {MESSY} SELECT * FROM messy WHERE year IS NOT NULL AND rating_score IS NOT NULL",
        "fill_const": f"WITH {MESSY} SELECT * REPLACE (coalesce(title, '{UNKNOWN_TITLE}') AS title, "
        f"coalesce(genres, '{UNKNOWN}') AS genres, coalesce(year, 0) AS year) FROM messy",
        "fill_mean": f"WITH {MESSY} SELECT * REPLACE (round(coalesce(rating_score, "
        "(SELECT avg(rating_score) FROM messy)), 9) AS rating_score) FROM messy",
        "dedupe_rows": "SELECT DISTINCT text, lang, source, n_chars FROM documents",
        "dedupe_key": "SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, "
        "l_linenumber ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_quantity, l_extendedprice, "
        "l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rn FROM lineitem) WHERE rn = 1",
        "filter_range": f"WITH {MESSY} SELECT * FROM messy WHERE rating_score BETWEEN 1.0 AND 10.0",
        "filter_min_or_sentinel": f"WITH {MESSY} SELECT * FROM (SELECT * REPLACE (coalesce(year, 0) AS year) "
        f"FROM messy) WHERE year >= {FIRST_YEAR} OR year = 0",
        "filter_sigma": "WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS d FROM events) "
        "SELECT event_id, value FROM events, s WHERE value BETWEEN greatest(0, m - 3 * d) AND m + 3 * d",
        "cast_columns": "SELECT l_orderkey, l_linenumber, l_extendedprice AS amount, "
        "CAST(floor(l_quantity) AS INTEGER) AS quantity, TRY_CAST(l_returnflag AS INTEGER) AS code FROM lineitem",
        "trim_strings": f"WITH {MESSY} SELECT * REPLACE (trim(title, ' ') AS title) FROM messy",
        "clean_cluster": f"WITH {CLUSTER} SELECT {TRIMMED} FROM cleaned",
        "clean_local": f"WITH {LOCAL} SELECT {TRIMMED} FROM cleaned",
        "prep_analysis": f"WITH {ANALYSIS} SELECT {ROUNDED_COLUMNS} FROM movies",
        "prep_bench": f"WITH {MESSY_BENCH} SELECT * FROM movies",
        "clean_audit": f"WITH {LOCAL} "
        + _audit(
            [
                ("year_missing", "messy", "known"),
                ("movie_id_copies", "filled", "single"),
                ("score_range", "single", "scored"),
                ("year", "scored", "dated"),
                ("votes_3_sigma", "dated", "cleaned"),
            ]
        ),
        "clean_audit_cluster": f"WITH {CLUSTER} "
        + _audit(
            [
                ("whole_row_copies", "filled", "single"),
                ("score_range", "single", "scored"),
                ("year", "scored", "dated"),
                ("votes_3_sigma", "dated", "cleaned"),
            ]
        ),
        # projections and comparisons
        "project": "SELECT l_returnflag, l_extendedprice FROM lineitem",
        "main_value": f"WITH {TITLES} SELECT movie_id, {GENRE} AS main_genre, {COUNTRY} AS main_country, "
        f"{DIRECTOR} AS main_director FROM titles",
        "sentinel_filter": f"WITH {TITLES} SELECT movie_id, genres FROM titles WHERE genres IS NOT NULL",
        "above_avg_collect": f"""WITH {ANALYSIS}
SELECT title, year, round(rating_score, 9) AS rating_score, collect_count, rating_count FROM movies
WHERE collect_count > (SELECT avg(collect_count) FROM movies) AND rating_score >= 8.5
ORDER BY collect_count DESC, movie_id NULLS LAST LIMIT 10""",
        "hidden_gems": f"""WITH {TITLES}
SELECT title, year, rating_score, rating_count, genres FROM titles
WHERE rating_score > (SELECT avg(rating_score) FROM titles) + 0.5
  AND rating_count < (SELECT avg(rating_count) FROM titles)
ORDER BY rating_score DESC, movie_id LIMIT 10""",
        "vs_group_avg": f"""WITH {ANALYSIS},
g AS (SELECT {GENRE} AS genre, round(avg(rating_score), 2) AS genre_avg_score FROM movies
  WHERE genres <> '{UNKNOWN}' GROUP BY 1 HAVING count(*) >= 50)
SELECT title, year, g.genre, round(rating_score, 9) AS rating_score, genre_avg_score,
  round(rating_score - genre_avg_score, 2) AS above_avg,
  CASE WHEN rating_score >= genre_avg_score THEN 'Above Avg' ELSE 'Below Avg' END AS vs_avg
FROM movies JOIN g ON {GENRE} = g.genre WHERE rating_count > 50000
ORDER BY above_avg DESC, movie_id NULLS LAST LIMIT 15""",
        # aggregates
        "genre_stats": f"""WITH {TITLES}
SELECT {GENRE} AS main_genre, count(*) AS movie_count, round(avg(rating_score), 2) AS avg_rating,
  CAST(sum(rating_count) AS BIGINT) AS total_ratings
FROM titles WHERE genres <> '{UNKNOWN}' GROUP BY 1 ORDER BY movie_count DESC, 1 LIMIT 10""",
        "genre_stats_full": f"""WITH {ANALYSIS}
SELECT {GENRE} AS main_genre, count(*) AS movie_count, round(avg(rating_score), 2) AS avg_rating,
  round(avg(rating_count)) AS avg_votes, round(max(rating_score), 1) AS max_rating,
  round(min(rating_score), 1) AS min_rating
FROM movies WHERE genres <> '{UNKNOWN}' GROUP BY 1 ORDER BY movie_count DESC, 1 LIMIT 10""",
        "genre_stats_bench": f"""WITH {MESSY_BENCH}
SELECT {GENRE} AS genre, count(*) AS cnt, round(avg(rating_score), 2) AS avg_score,
  CAST(sum(rating_count) AS BIGINT) AS total_votes, round(avg(collect_count)) AS avg_collect
FROM movies WHERE genres <> '{UNKNOWN}' GROUP BY 1""",
        "genre_stats_main": f"""WITH {MESSY}
SELECT {GENRE} AS main_genre, count(*) AS movie_count, round(avg(rating_score), 2) AS avg_rating,
  round(avg(rating_count)) AS avg_votes, round(max(rating_score), 1) AS max_rating
FROM messy WHERE genres <> '{UNKNOWN}' AND rating_score BETWEEN 1 AND 10
GROUP BY 1 ORDER BY movie_count DESC, 1 LIMIT 10""",
        "genre_stats_nonnull": f"""WITH {MESSY}
SELECT {GENRE} AS main_genre, count(movie_id) AS movie_count, round(avg(rating_score), 6) AS avg_rating,
  round(avg(rating_count), 4) AS avg_votes, max(rating_score) AS max_rating
FROM messy WHERE genres IS NOT NULL AND rating_score BETWEEN 1 AND 10
GROUP BY 1 ORDER BY movie_count DESC, 1 LIMIT 10""",
        "country_stats": f"""WITH {TITLES}
SELECT {COUNTRY} AS main_country, count(*) AS movie_count, round(avg(rating_score), 2) AS avg_rating,
  round(max(rating_score), 1) AS max_rating, CAST(sum(rating_count) AS BIGINT) AS total_ratings
FROM titles WHERE countries <> '{UNKNOWN}' GROUP BY 1 HAVING count(*) >= 2
ORDER BY avg_rating DESC NULLS LAST, 1 LIMIT 10""",
        "country_stats_local": f"""WITH {ANALYSIS}
SELECT {COUNTRY} AS main_country, count(*) AS movie_count, round(avg(rating_score), 2) AS avg_rating,
  CAST(sum(rating_count) AS BIGINT) AS total_votes, round(max(rating_score), 1) AS best_score
FROM movies WHERE countries <> '{UNKNOWN}' GROUP BY 1 HAVING count(*) >= 5
ORDER BY avg_rating DESC NULLS LAST, 1 LIMIT 10""",
        "year_high_rated": f"""WITH {TITLES}
SELECT year, count(*) AS high_rated_count, round(avg(rating_score), 2) AS avg_rating
FROM titles WHERE year >= 1950 AND rating_score >= 9.0 GROUP BY 1 ORDER BY year DESC""",
        "year_high_top": f"""WITH {ANALYSIS}
SELECT year, count(*) AS high_rated_count, round(avg(rating_score), 2) AS avg_rating
FROM movies WHERE year >= 1950 AND rating_score >= 8.5 GROUP BY 1
ORDER BY high_rated_count DESC, year LIMIT 10""",
        "decade_trend": f"""WITH {TITLES}
SELECT CAST(year // 10 * 10 AS VARCHAR) || 's' AS decade, count(*) AS movie_count,
  round(avg(rating_score), 2) AS avg_rating, round(avg(rating_count)) AS avg_votes
FROM titles WHERE year >= 1930 AND year < 2025 GROUP BY 1""",
        "decade_trend_local": f"""WITH {ANALYSIS}
SELECT CAST(year // 10 * 10 AS VARCHAR) || 's' AS decade, count(*) AS movie_count,
  round(avg(rating_score), 2) AS avg_rating, round(avg(rating_count)) AS avg_votes,
  round(avg(collect_count)) AS avg_collect
FROM movies WHERE year >= 1950 AND year < 2026 GROUP BY 1""",
        "director_stats": f"""WITH {TITLES}
SELECT {DIRECTOR} AS main_director, count(*) AS work_count, round(avg(rating_score), 2) AS avg_rating,
  round(max(rating_score), 1) AS best_rating, CAST(sum(rating_count) AS BIGINT) AS total_votes
FROM titles WHERE directors <> '{UNKNOWN}' GROUP BY 1 HAVING count(*) >= 2
ORDER BY avg_rating DESC NULLS LAST, 1 LIMIT 10""",
        "popularity_quality": f"""WITH {TITLES}
SELECT {_case("rating_count", POPULARITY, POPULARITY_REST)} AS popularity,
  {_case("rating_score", QUALITY, QUALITY_REST)} AS quality, count(*) AS count
FROM titles GROUP BY 1, 2""",
        "genre_country": f"""WITH {TITLES}
SELECT {GENRE} AS genre, {COUNTRY} AS country, count(*) AS cnt, round(avg(rating_score), 2) AS avg_rating
FROM titles WHERE genres <> '{UNKNOWN}' AND countries <> '{UNKNOWN}'
GROUP BY 1, 2 ORDER BY cnt DESC, 1, 2 LIMIT 15""",
        "table_summary": f"""WITH {ANALYSIS}
SELECT count(*) AS total, round(avg(rating_score), 2) AS avg_score,
  CAST(sum(rating_count) AS BIGINT) AS total_votes, CAST(sum(collect_count) AS BIGINT) AS total_collects
FROM movies""",
        "top_value": f"WITH {TITLES} SELECT genres, count(*) AS count FROM titles GROUP BY 1 "
        "ORDER BY count DESC, genres NULLS LAST LIMIT 1",
        "distinct_count": f"WITH {TITLES} SELECT count(*) AS distinct_count FROM (SELECT DISTINCT genres FROM titles)",
        "word_count": f"WITH {CLEAN_WORDS} SELECT word, count FROM counts ORDER BY count DESC, word LIMIT 20",
        "word_totals": f"WITH {CLEAN_WORDS} SELECT CAST(sum(count) AS BIGINT) AS total_words, "
        "count(*) AS distinct_words FROM counts",
        "word_count_raw": f"WITH {RAW_WORDS} SELECT word, count FROM counts ORDER BY count DESC, word LIMIT 10",
        "category_agg": _category(
            "lineitem", "l_returnflag", "l_extendedprice", "l_quantity", 100
        ),
        "category_count_filtered": "SELECT l_returnflag AS category, count(*) AS count FROM lineitem "
        "WHERE l_extendedprice > 50000 GROUP BY 1",
        # ranks and top-k
        "top3_per_genre": f"""WITH {TITLES}
SELECT * FROM (SELECT {GENRE} AS main_genre, title, rating_score, rating_count,
  CAST(row_number() OVER (PARTITION BY {GENRE} ORDER BY rating_score DESC NULLS LAST, movie_id) AS INTEGER)
    AS genre_rank,
  CAST(rank() OVER (PARTITION BY {GENRE} ORDER BY rating_score DESC NULLS LAST) AS INTEGER) AS rank_in_genre
  FROM titles WHERE genres <> '{UNKNOWN}' AND rating_count > 1000) WHERE genre_rank <= 3""",
        "genre_ranks": f"""WITH {ANALYSIS}
SELECT * FROM (SELECT {GENRE} AS main_genre, title, year, round(rating_score, 9) AS rating_score, rating_count,
  CAST(row_number() OVER (PARTITION BY {GENRE} ORDER BY rating_score DESC, rating_count DESC,
    movie_id NULLS LAST) AS INTEGER) AS rn,
  CAST(rank() OVER (PARTITION BY {GENRE} ORDER BY rating_score DESC) AS INTEGER) AS rank_in_genre,
  round(percent_rank() OVER (PARTITION BY {GENRE} ORDER BY rating_score DESC), 2) AS pct_rank
  FROM movies WHERE genres <> '{UNKNOWN}' AND rating_count > 10000) WHERE rn <= 3""",
        "global_percent_rank": f"""WITH {TITLES}
SELECT title, countries, year, rating_score, rating_count, percentile FROM (
  SELECT *, round(percent_rank() OVER (ORDER BY rating_score DESC NULLS LAST), 3) AS percentile
  FROM titles WHERE rating_count > 10000)
ORDER BY rating_score DESC NULLS LAST, movie_id LIMIT 10""",
        "percent_rank_all": f"""WITH {TITLES}
SELECT movie_id, round(percent_rank() OVER (ORDER BY rating_score DESC NULLS LAST), 9) AS percentile
FROM titles""",
        "percent_rank_wide": f"""WITH {TITLES}
SELECT movie_id, round(percent_rank() OVER (ORDER BY 9007199254740992 + movie_id % 4 DESC), 9) AS percentile
FROM titles""",
        "row_number_wide": f"""WITH {TITLES}
SELECT movie_id, row_number() OVER (PARTITION BY countries ORDER BY 9007199254740992 + movie_id % 4, movie_id) AS rn
FROM titles""",
        "row_number_by_text": f"""WITH {TITLES}
SELECT movie_id, row_number() OVER (ORDER BY directors NULLS LAST, movie_id) AS rn FROM titles""",
        "genre_row_number": f"""WITH {TITLES_BENCH}
SELECT title, year, rating_score, row_number() OVER (PARTITION BY {GENRE}
  ORDER BY rating_score DESC NULLS LAST, movie_id) AS rn
FROM movies WHERE rating_count > 5000 AND year >= 2000""",
        "top50_titles": f"""WITH {TITLES_BENCH}
SELECT title, rating_score, rating_count FROM movies
ORDER BY rating_score DESC NULLS LAST, rating_count DESC NULLS LAST, movie_id LIMIT 50""",
        "top100_value": "SELECT l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC LIMIT 100",
        # telemetry
        "sensor_parse": f"""WITH {READINGS},
kinds AS (SELECT *, CASE WHEN seq % 19 = 0 THEN 'text' WHEN seq % 23 = 0 THEN 'empty'
  WHEN topic = 'sensors/status' THEN 'status' WHEN seq % 29 = 0 THEN 'millis' WHEN seq % 31 = 0 THEN 'nan'
  WHEN seq % 11 = 0 THEN 'unnumbered' ELSE 'reading' END AS kind FROM readings)
SELECT topic, arrival_ts,
  CASE WHEN kind IN ('text', 'empty', 'nan') THEN 'unknown' ELSE device_id END AS device_id,
  CASE WHEN kind IN ('reading', 'unnumbered') THEN ts
    WHEN kind IN ('text', 'empty', 'status') THEN TIMESTAMP '1970-01-01 00:00:00' END AS ts,
  CASE WHEN kind IN ('reading', 'unnumbered', 'millis') THEN temperature WHEN kind = 'nan' THEN 1.0 END AS temperature,
  CASE WHEN kind IN ('reading', 'unnumbered') THEN humidity END AS humidity,
  CASE WHEN kind IN ('reading', 'millis', 'nan') THEN seq END AS seq,
  CASE WHEN kind = 'status' THEN status END AS status,
  CASE WHEN kind = 'text' THEN 'not json' WHEN kind = 'empty' THEN '{{}}' WHEN kind = 'millis' THEN 'time'
    WHEN kind = 'nan' THEN 'time' WHEN kind = 'unnumbered' AND temperature IS NULL AND humidity IS NULL THEN 'nothing'
    END AS reject
FROM kinds""",
        "topic_filter": f"WITH {READINGS} SELECT device_id, seq, topic FROM readings "
        "WHERE topic IN ('sensors/temperature', 'sensors/humidity')",
        "latency": f"WITH {MEASURED} SELECT device_id, seq, latency, latency_ms FROM measured",
        "rolling_mean": f"""WITH {MEASURED}
SELECT device_id, topic, seq, ts, latency, round(avg(latency) OVER (PARTITION BY device_id ORDER BY ts, seq
  ROWS BETWEEN 499 PRECEDING AND CURRENT ROW), 12) AS avg_latency FROM measured""",
        "rolling_mean_by_topic": f"""WITH {MEASURED}
SELECT device_id, topic, seq, ts, latency, round(avg(latency) OVER (PARTITION BY topic ORDER BY ts, seq
  ROWS BETWEEN 499 PRECEDING AND CURRENT ROW), 12) AS avg_latency FROM measured""",
        "rolling_mean_all": f"""WITH {MEASURED}
SELECT device_id, topic, seq, ts, latency, round(avg(latency) OVER (ORDER BY arrival_ts, seq
  ROWS BETWEEN 499 PRECEDING AND CURRENT ROW), 12) AS avg_latency FROM measured""",
        "latency_summary": f"""WITH {MEASURED},
last AS (SELECT latency * 1000 AS ms FROM measured ORDER BY arrival_ts DESC, seq DESC LIMIT 500)
SELECT count(*) AS samples, round(avg(ms), 1) AS avg_ms, round(max(ms), 1) AS max_ms,
  round(min(ms), 1) AS min_ms FROM last""",
        "latest_by_device": f"WITH {READINGS} {LATEST}",
        "latest_unexpired": _unexpired("1 hour"),
        "latest_unexpired_day": _unexpired("1 day"),
        "reading_history": f"WITH {READINGS} SELECT DISTINCT device_id, seq, ts, temperature, humidity "
        "FROM readings WHERE temperature IS NOT NULL",
        "recent_readings": f"WITH {MEASURED} SELECT device_id AS device, topic, temperature AS temp, "
        "humidity AS humid, latency_ms FROM measured ORDER BY arrival_ts DESC, seq DESC LIMIT 100",
        "stream_latest": f"WITH {STREAMED} {LATEST}",
        "stream_unexpired": _unexpired("1 day", STREAMED),
        "stream_history": f"WITH {STREAMED} SELECT DISTINCT device_id, seq, ts, temperature, humidity "
        "FROM readings WHERE temperature IS NOT NULL",
        "stream_history_exact": f"WITH {STREAMED} SELECT DISTINCT device_id, seq, ts, temperature, humidity "
        "FROM readings WHERE temperature IS NOT NULL",
        "stream_windows_exact": f"""WITH {STREAMED},
once AS (SELECT DISTINCT device_id, seq, ts, temperature, humidity FROM readings)
{WINDOWS.format("once")}""",
        "stream_sessions": f"""WITH {STREAMED},
once AS (SELECT DISTINCT device_id, seq, ts, temperature, humidity FROM readings),
gaps AS (SELECT *, coalesce(ts >= lag(ts) OVER w + INTERVAL '1 day', true) AS gap
  FROM once WINDOW w AS (PARTITION BY device_id ORDER BY ts)),
numbered AS (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY device_id ORDER BY ts
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM gaps)
SELECT device_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS readings,
  (array_agg(temperature ORDER BY ts DESC, seq DESC) FILTER (WHERE temperature IS NOT NULL))[1] AS temperature,
  (array_agg(humidity ORDER BY ts DESC, seq DESC) FILTER (WHERE humidity IS NOT NULL))[1] AS humidity
FROM numbered GROUP BY device_id, session
HAVING max(ts) + INTERVAL '1 day' <= (SELECT max(ts) FROM readings) - INTERVAL '2 hours'""",
        "stream_windows": f"""WITH {STREAMED},
once AS (SELECT DISTINCT device_id, seq, ts, temperature, humidity FROM readings)
{WINDOWS.format("once")}""",
        "stream_status": f"WITH {STREAMED} SELECT device_id, (array_agg(status ORDER BY arrival_ts DESC, "
        "seq DESC))[1] AS status FROM kinds WHERE kind = 'status' GROUP BY device_id",
        "stream_rejects": f"""WITH {STREAMED} SELECT topic, arrival_ts,
  CASE WHEN kind = 'text' THEN 'not json ' || CAST(seq AS VARCHAR) WHEN kind = 'empty' THEN '{{}}'
    WHEN kind = 'nan' THEN '{{"timestamp": NaN, "temperature": 1.0, "seq": ' || CAST(seq AS VARCHAR) || '}}'
    WHEN kind = 'millis' THEN 'millis' ELSE 'nothing' END AS value
FROM kinds WHERE kind IN ('text', 'empty', 'nan', 'millis')
  OR kind = 'unnumbered' AND temperature IS NULL AND humidity IS NULL""",
        "stream_latency": _rolling_latency(500),
        "stream_latency_by_device": _rolling_latency(20, "PARTITION BY device_id"),
        "stream_latency_summary": f"""WITH {STREAMED_ONCE},
last AS (SELECT (epoch_us(arrival_ts) - epoch_us(ts)) / 1000 AS ms FROM arrived
  ORDER BY arrival_ts DESC, seq DESC NULLS FIRST LIMIT 500)
SELECT count(*) AS samples, round(avg(ms), 1) AS avg_ms, round(max(ms), 1) AS max_ms, round(min(ms), 1) AS min_ms
FROM last""",
        "stream_late": f"""WITH {STREAMED},
seen AS (SELECT max(ts) AS newest FROM readings WHERE coalesce(seq, 1) % 3 <> 0)
SELECT device_id, seq, ts, temperature, humidity, arrival_ts FROM readings, seen
WHERE seq % 3 = 0 AND ts <= newest - INTERVAL '1 day'""",
        "readings_without_seq": f"""WITH {STREAMED}
SELECT DISTINCT device_id, ts, temperature, humidity FROM readings WHERE seq IS NULL""",
        "device_status": f"WITH {READINGS} SELECT device_id, (array_agg(status ORDER BY arrival_ts DESC, "
        "seq DESC))[1] AS status FROM readings WHERE topic = 'sensors/status' GROUP BY device_id",
        "windowed_readings": f"""WITH {READINGS},
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY device_id, seq
  ORDER BY arrival_ts, topic) AS rn FROM readings) WHERE rn = 1)
{WINDOWS.format("once")}""",
        # metrics
        "counter_rate": f"WITH {_rates("metric = 'net_tx'")} {RATE_COLUMNS}",
        "counter_rate_5_minutes": "WITH "
        + _rates("metric = 'net_tx'", "time_bucket(INTERVAL '5 minutes', ts)")
        + RATE_COLUMNS,
        "counter_rate_sliding": f"""WITH {METRICS},
pairs AS (
  SELECT *, lag(value) OVER w AS previous, lag(ts) OVER w AS previous_ts
  FROM samples WHERE metric = 'net_tx' WINDOW w AS (PARTITION BY {LABELS} ORDER BY ts, event_id)),
placed AS (
  SELECT *, time_bucket(INTERVAL '1 minute', ts) - to_minutes(unnest([0, 1, 2, 3, 4])) AS window_start
  FROM pairs WHERE previous_ts IS NOT NULL),
rates AS (
  SELECT {LABELS}, window_start, sum(CASE WHEN value < previous THEN value ELSE value - previous END) AS increase,
    sum(epoch_us(ts) - epoch_us(previous_ts)) / 1000000 AS seconds, increase / seconds AS rate
  FROM placed GROUP BY ALL HAVING sum(epoch_us(ts) - epoch_us(previous_ts)) > 0) {RATE_COLUMNS}""",
        "stream_counter_rate": f"WITH {_rates("metric = 'net_tx'")} {RATE_COLUMNS}",
        "cpu_busy": f"WITH {_rates("metric = 'cpu_seconds' AND mode = 'idle'")} SELECT instance, window_start, "
        "round(100 - avg(rate) * 100, 6) AS cpu_busy FROM rates GROUP BY ALL",
        "gauge_sum_by": f"""WITH {METRICS},
latest AS (SELECT * FROM samples WHERE metric = 'memory_bytes' AND namespace = 'default' AND container <> ''
  QUALIFY row_number() OVER (PARTITION BY {LABELS} ORDER BY ts DESC, event_id DESC) = 1)
SELECT pod, round(sum(value) / 1024 / 1024, 9) AS memory_mib FROM latest GROUP BY pod""",
        "rate_sum_by": "WITH "
        + _rates("metric = 'cpu_seconds' AND namespace = 'default' AND container <> ''")
        + " SELECT pod, window_start, round(sum(rate) * 100, 6) AS cpu_percent FROM rates GROUP BY ALL",
        "tx_rx": f"WITH {_rates("metric IN ('net_tx', 'net_rx') AND namespace = 'default'")} "
        "SELECT CASE WHEN metric = 'net_tx' THEN 'TX' ELSE 'RX' END AS direction, pod, window_start, "
        "round(sum(rate), 9) AS bytes_per_second FROM rates GROUP BY ALL",
    }
