"""The named queries as SQL for an independent engine (DuckDB dialect), over the same whole tables."""

from __future__ import annotations

from outage_spark.operators.retrieval import PROMPT
from outage_spark.plans.catalog import GEN_FROM, GEN_UNTIL, NEXT_FROM, PHRASES
from outage_spark.schemas import ADVERSE_CONDITIONS, CONDITIONS, NOT_SUPPORTED, REASONS

POSTCODES = "postcodes AS (SELECT CAST(n_nationkey + 2440 AS VARCHAR) AS postcode, n_name AS suburb FROM nation)"
PLANNED = """planned AS (
    SELECT o_orderkey AS outage_id, CAST(c_nationkey + 2440 AS VARCHAR) AS postcode,
           o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS start_ts,
           o_orderdate + to_hours(CAST(o_orderkey % 24 + 1 + o_orderkey % 12 AS INTEGER)) AS end_ts,
           o_orderpriority AS reason
    FROM orders JOIN customer ON o_custkey = c_custkey)"""
HISTORY = """history AS (
    SELECT CAST(user_id % 25 + 2440 AS VARCHAR) AS postcode, event_type AS condition,
           CAST(value AS DECIMAL(12,2)) AS hours FROM events)"""
REQUESTS = """requests AS (
    SELECT event_id AS request_id, CAST(user_id % 33 + 2436 AS VARCHAR) AS postcode,
           DATE '1995-01-01' + CAST(event_id % 2400 AS INTEGER) AS start_date,
           DATE '1995-01-01' + CAST(event_id % 2400 + event_id % 7 AS INTEGER) AS end_date,
           ts AS asked_at, CASE WHEN event_id % 7 = 0 THEN 'unknown' ELSE event_type END AS condition
    FROM events)"""
WEATHER = """weather AS (
    SELECT CAST(user_id % 25 + 2440 AS VARCHAR) AS postcode, ts AS observed_at,
           CASE event_type WHEN 'view' THEN 'Light rain' WHEN 'error' THEN 'Thunderstorm' WHEN 'click' THEN 'Clear sky'
                WHEN 'signup' THEN 'Few clouds' WHEN 'purchase' THEN 'Showers with thunder' END AS condition_text,
           value AS temp_c FROM events)"""
CLASSIFY = """CASE WHEN regexp_matches(lower(condition_text), 'storm|thunder|lightning|cyclone|gale') THEN 'Storms'
     WHEN regexp_matches(lower(condition_text), 'rain|drizzle|shower') THEN 'Rain'
     WHEN temp_c >= 35 THEN 'High Temperature' ELSE 'Fine_Conditions' END"""
MATCHES = """asks AS (SELECT DISTINCT postcode, start_date, end_date FROM requests),
matches AS (
    SELECT a.postcode, a.start_date, a.end_date, p.outage_id, p.start_ts, p.end_ts, p.reason
    FROM asks a JOIN planned p ON a.postcode = p.postcode
     AND CAST(p.start_ts AS DATE) <= a.end_date AND CAST(p.end_ts AS DATE) >= a.start_date)"""
TODAY = """today AS (
    SELECT r.request_id, count(p.outage_id) AS n
    FROM requests r LEFT JOIN planned p ON r.postcode = p.postcode
     AND CAST(p.start_ts AS DATE) <= r.start_date AND CAST(p.end_ts AS DATE) >= r.start_date
    GROUP BY r.request_id)"""
MEAN = "CAST(sum(hours) AS DOUBLE) / count(hours)"
HITS = """pairs AS (
    SELECT q.vec_id AS question_id, c.vec_id AS vec_id,
           round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS score
    FROM embeddings q CROSS JOIN embeddings c),
hits AS (
    SELECT * FROM (SELECT question_id, vec_id, score, CAST(row_number() OVER (
        PARTITION BY question_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs) WHERE rank <= 4)"""
BASENAME = "split_part(regexp_replace(url, '[?#].*$', ''), '/', -1)"
STEPS = (
    r"(?s).{1,800}\z|.{0,798}\n\n|.{0,799}\n|.{0,799} |.{1,800}"
)
SEGMENTS = f"""segments AS (
    SELECT doc_id, unnest(s) AS segment, generate_subscripts(s, 1) - 1 AS chunk_no
    FROM (SELECT doc_id, regexp_extract_all(text, '{STEPS}') AS s FROM texts))"""
SEPARATOR_CHUNKS = f"""{SEGMENTS},
    before AS (SELECT *, lag(segment) OVER (PARTITION BY doc_id ORDER BY chunk_no) AS previous FROM segments)
    SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, CASE WHEN previous IS NULL THEN ''
        WHEN length(previous) <= 200 THEN previous
        ELSE regexp_replace(right(previous, 200), '^[^ \\n]*[ \\n]+', '') END || segment AS text
    FROM before"""
FIXED_CHUNKS = """SELECT doc_id, CAST(i AS INTEGER) AS chunk_no, substring(text, i * 800 + 1, 1000) AS text
    FROM (SELECT doc_id, text, unnest(range(CAST(1 + greatest(0, ceil((length(text) - 200) / 800.0) - 1) AS BIGINT)))
          AS i FROM documents WHERE length(text) > 0)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _hash(row_id: str, stream: int, n: int) -> str:
    return f"(CAST('0x' || substr(md5(concat_ws(':', {row_id}, '{stream}')), 1, 8) AS BIGINT) % {n})"


def _uniform(stream: int, low: float, high: float) -> str:
    return f"({low} + CAST({high - low} AS DOUBLE) * ({_hash('row_id', stream, 1_000_000)} / CAST(1e6 AS DOUBLE)))"


def _choice(stream: int, values) -> str:
    names = ", ".join(f"'{v}'" for v in values)
    return f"[{names}][{_hash('row_id', stream, len(values))} + 1]"


PLACED = f"""postcodes AS (
    SELECT CAST(n_nationkey + 2440 AS VARCHAR) AS postcode, n_name AS suburb FROM nation),
numbered AS (
    SELECT row_number() OVER (ORDER BY postcode) - 1 AS place, postcode, suburb,
           CAST(3 + {_hash('postcode', 0, 13)} AS INTEGER) AS staff FROM postcodes),
placed AS (
    SELECT event_id AS row_id, numbered.* FROM events
    JOIN numbered ON numbered.place = {_hash('event_id', 1, 1)[:-2]}(SELECT count(*) FROM postcodes)))"""


def _history(variant: int) -> str:
    ranges = {1: ((3.0, 12.0), (0.0, 6.0)), 2: ((2.5, 5.5), (1.0, 4.0))}[variant]
    if variant == 1:
        start = (
            f"make_timestamp(2024, {_hash('row_id', 3, 12)} + 1, {_hash('row_id', 6, 28)} + 1, 0, 0, 0.0)"
            f" + to_minutes({_hash('row_id', 4, 24)} * 60 + {_hash('row_id', 5, 60)})"
        )
    else:
        start = (
            f"CAST(DATE '2024-09-30' - 365 AS TIMESTAMP) + to_minutes(({_hash('row_id', 3, 366)} * 24"
            f" + {_hash('row_id', 4, 24)}) * 60 + {_hash('row_id', 5, 60)})"
        )
    adverse = ", ".join(f"'{c}'" for c in ADVERSE_CONDITIONS)
    return _with(
        PLACED,
        f"drawn AS (SELECT *, {_choice(2, CONDITIONS)} AS condition, {start} AS start_ts FROM placed)",
        f"""lasting AS (SELECT *, least(greatest(
            CASE WHEN condition IN ({adverse}) THEN {_uniform(7, *ranges[0])} ELSE {_uniform(7, *ranges[1])} END
            * (1 + (15 - staff) / CAST(15 AS DOUBLE)), 0), 24) AS hours FROM drawn)""",
    ) + """SELECT row_id, postcode, suburb, condition, staff, start_ts,
        start_ts + to_microseconds(CAST(floor(hours * 3.6e9 + 0.5) AS BIGINT)) AS end_ts, round(hours, 6) AS hours,
        CAST(day(start_ts) AS INTEGER) AS day, dayname(start_ts) AS dow, monthname(start_ts) AS month FROM lasting"""


def _status(prelude: tuple[str, ...], requests: str) -> str:
    return _with(
        *prelude,
        TODAY,
        f"groups AS (SELECT postcode, condition, {MEAN} AS mean_hours FROM history GROUP BY ALL)",
        f"overall AS (SELECT {MEAN} AS mean_hours FROM history)",
    ) + f"""SELECT r.request_id, r.postcode, c.suburb,
        CASE WHEN NOT regexp_full_match(r.postcode, '[0-9]{{4}}') THEN 'invalid' WHEN c.suburb IS NULL THEN 'unsupported'
             WHEN t.n > 0 THEN 'planned' ELSE 'unplanned' END AS status,
        CASE WHEN c.suburb IS NOT NULL THEN t.n END AS planned_count,
        CASE WHEN c.suburb IS NOT NULL AND t.n = 0 THEN
             round(CASE WHEN g.postcode IS NULL THEN (SELECT mean_hours FROM overall) ELSE g.mean_hours END, 2)
        END AS est_hours
    FROM {requests} r LEFT JOIN postcodes c USING (postcode) JOIN today t ON t.request_id = r.request_id
    LEFT JOIN groups g ON g.postcode = r.postcode AND g.condition = r.condition"""


STATUS = _status((POSTCODES, PLANNED, HISTORY, REQUESTS), "requests")
WEATHER_ASOF = (
    _with(REQUESTS, WEATHER)
    + """SELECT request_id, r.postcode, asked_at, observed_at, condition_text, temp_c
    FROM requests r ASOF LEFT JOIN weather w ON r.postcode = w.postcode AND r.asked_at >= w.observed_at"""
)


def _html(column: str) -> str:
    sql = rf"regexp_replace({column}, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gis')"
    sql = rf"regexp_replace({sql}, '<!--.*?-->', ' ', 'gs')"
    sql = rf"regexp_replace({sql}, '<[^>]+>', ' ', 'g')"
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        sql = f"replace({sql}, '{entity}', '{plain}')"
    return rf"trim(regexp_replace({sql}, '[ \t\r\n]+', ' ', 'g'))"


def _prompt() -> str:
    before, rest = PROMPT.split("{context}")
    middle, after = rest.split("{question}")
    return f"$${before}$$ || coalesce(texts, '') || $${middle}$$ || d.text || $${after}$$"


def _relative(part: int) -> str:
    day, week = "CAST(ts AS DATE)", "CAST(date_trunc('week', ts) AS DATE)"
    month, following = "CAST(date_trunc('month', ts) AS DATE)", "CAST(date_trunc('month', ts) + INTERVAL 1 MONTH AS DATE)"
    ranges = {
        "today": (day, day),
        "tomorrow": (f"{day} + 1", f"{day} + 1"),
        "next week": (f"{week} + 7", f"{week} + 13"),
        "this month": (month, f"last_day({month})"),
        "next month": (following, f"last_day({following})"),
    }
    cases = " ".join(f"WHEN '{kind}' THEN {ranges[phrase][part]}" for kind, phrase in PHRASES.items())
    return f"CASE event_type {cases} END"


ORACLES: dict[str, str] = {
    "url_basename": f"SELECT page_id, {BASENAME} AS file_name FROM pages",
    "html_text": f"SELECT page_id, {_html('html')} AS text FROM pages",
    "table_diff": """WITH old AS (
            SELECT d.doc_id, lang, n_chars + quality AS n_chars FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
        new AS (SELECT doc_id, lang, n_chars FROM documents
                WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))
        SELECT 'insert' AS op, * FROM new WHERE doc_id NOT IN (SELECT doc_id FROM old)
        UNION ALL SELECT 'delete', * FROM old WHERE doc_id NOT IN (SELECT doc_id FROM new)
        UNION ALL SELECT 'update', new.* FROM new JOIN old ON new.doc_id = old.doc_id
            WHERE (new.lang, new.n_chars) IS DISTINCT FROM (old.lang, old.n_chars)""",
    "parse_ts": """SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderstatus = 'P' THEN o_orderpriority
        ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP) AS parsed FROM orders""",
    "planned_literal": _with(PLANNED, REQUESTS)
    + """SELECT r.request_id, r.postcode, r.start_date, r.end_date, count(p.outage_id) AS n_outages
        FROM requests r LEFT JOIN planned p ON r.postcode = p.postcode AND CAST(p.start_ts AS DATE) >= r.start_date
         AND (CAST(p.end_ts AS DATE) >= r.end_date OR CAST(p.end_ts AS DATE) <= r.end_date) GROUP BY ALL""",
    "planned_numbered": _with(PLANNED)
    + """SELECT postcode, outage_id, start_ts, end_ts, reason,
        row_number() OVER (PARTITION BY postcode ORDER BY start_ts DESC, outage_id) AS from_last FROM planned""",
    "planned_overlap": _with(PLANNED, REQUESTS)
    + """SELECT r.request_id, r.postcode, r.start_date, r.end_date, count(p.outage_id) AS n_outages
        FROM requests r LEFT JOIN planned p ON r.postcode = p.postcode AND CAST(p.start_ts AS DATE) <= r.end_date
         AND CAST(p.end_ts AS DATE) >= r.start_date GROUP BY ALL""",
    "condition_isin": """SELECT event_id, event_type AS condition, value FROM events
        WHERE event_type IN ('view', 'error')""",
    "postcode_valid": """SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS postcode,
        CASE WHEN o_orderkey BETWEEN 1000 AND 9999 THEN 1 ELSE 0 END AS valid FROM orders""",
    "classify_events": _with(WEATHER) + f"SELECT *, {CLASSIFY} AS condition FROM weather",
    "quarantine": """WITH raw AS (
            SELECT page_id, TRY_CAST(regexp_extract(url, '[?&]page=([^&#]*)', 1) AS INTEGER) AS page_no FROM pages)
        SELECT page_id, page_no, CASE WHEN page_no IS NULL THEN 'page: not a number' END AS error FROM raw""",
    "clean_turns": "SELECT conv_id, turn, role FROM conversations WHERE role <> 'system'",
    "outages_with_suburb": _with(POSTCODES, PLANNED)
    + "SELECT outage_id, postcode, start_ts, end_ts, reason, suburb FROM planned LEFT JOIN postcodes USING (postcode)",
    "new_files": f"""SELECT DISTINCT {BASENAME} AS file_name FROM pages WHERE {BASENAME} NOT IN (
        SELECT {BASENAME} FROM pages WHERE page_id IN (SELECT doc_id FROM labels))""",
    "suburb_lookup": _with(POSTCODES, REQUESTS)
    + f"""SELECT request_id, postcode, coalesce(suburb, '{NOT_SUPPORTED}') AS suburb
        FROM requests LEFT JOIN postcodes USING (postcode)""",
    "unprocessed_docs": """SELECT doc_id, lang, source FROM documents
        WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "planned_for_requests": _with(PLANNED, REQUESTS, MATCHES)
    + """, found AS (
            SELECT postcode, start_date, end_date, count(*) AS n, min(start_ts) AS first_start, max(end_ts) AS last_end,
                   round(CAST(sum(CAST(epoch_us(end_ts) - epoch_us(start_ts) AS HUGEINT)) AS DOUBLE) / 3.6e9 / count(*), 4)
                       AS mean_hours
            FROM matches GROUP BY ALL)
        SELECT request_id, postcode, start_date, end_date, coalesce(n, 0) AS n_outages, first_start, last_end, mean_hours
        FROM requests LEFT JOIN found USING (postcode, start_date, end_date)""",
    "planned_matches": _with(PLANNED, REQUESTS, MATCHES) + "SELECT * FROM matches",
    "triage_planned": _with(PLANNED, REQUESTS, TODAY)
    + """SELECT request_id, postcode, start_date FROM requests
        WHERE request_id IN (SELECT request_id FROM today WHERE n > 0)""",
    "triage_unplanned": _with(PLANNED, REQUESTS, TODAY)
    + """SELECT request_id, postcode, start_date FROM requests
        WHERE request_id IN (SELECT request_id FROM today WHERE n = 0)""",
    "weather_asof": WEATHER_ASOF,
    "vector_topk": _with(HITS) + "SELECT * FROM hits",
    "vector_topk_index": _with(HITS) + "SELECT * FROM hits",
    "index_after_changes": _with("kept AS (SELECT * FROM embeddings WHERE vec_id % 3 <> 0)", HITS.replace("FROM embeddings q CROSS JOIN embeddings c", "FROM kept q CROSS JOIN kept c"))
    + "SELECT * FROM hits",
    "retrieved_texts": _with(HITS)
    + """SELECT question_id, vec_id, score, rank, CAST(length(text) AS INTEGER) AS text_chars
        FROM hits LEFT JOIN documents ON doc_id = vec_id""",
    "planned_conflicts": _with(PLANNED)
    + """SELECT a.postcode, a.outage_id, a.start_ts, a.end_ts, count(*) AS n_conflicts
        FROM planned a JOIN planned b ON a.postcode = b.postcode AND a.outage_id <> b.outage_id
         AND b.start_ts < a.end_ts AND b.end_ts > a.start_ts GROUP BY ALL""",
    "overall_avg_hours": _with(HISTORY) + f"SELECT {MEAN} AS overall_hours FROM history",
    "hours_by_area_condition": _with(HISTORY)
    + f"SELECT postcode, condition, count(*) AS n, {MEAN} AS mean_hours FROM history GROUP BY ALL",
    "estimate_duration": _with(HISTORY, REQUESTS)
    + f""", groups AS (SELECT postcode, condition, {MEAN} AS mean_hours FROM history GROUP BY ALL)
        SELECT r.request_id, r.postcode, r.condition, round(CASE WHEN g.postcode IS NULL
            THEN (SELECT {MEAN} FROM history) ELSE g.mean_hours END, 2) AS est_hours
        FROM requests r LEFT JOIN groups g ON r.postcode = g.postcode AND r.condition = g.condition""",
    "hours_grouping_sets": _with(HISTORY)
    + f"""SELECT postcode, condition, count(*) AS n, {MEAN} AS mean_hours,
        CAST(grouping_id(postcode, condition) AS BIGINT) AS level
        FROM history GROUP BY GROUPING SETS ((postcode, condition), ())""",
    "distinct_sources": "SELECT DISTINCT source FROM documents",
    "concat_turns": r"""WITH pieces AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations)
        SELECT conv_id, CAST(before // 1000000 AS INTEGER) AS part, string_agg(text, chr(10) ORDER BY turn) AS text,
            count(*) AS pieces FROM pieces GROUP BY 1, 2""",
    "planned_summary": _with(PLANNED, REQUESTS, MATCHES)
    + """, lines AS (SELECT *, strftime(start_ts, '%Y-%m-%d %H:%M') || ' to ' || strftime(end_ts, '%Y-%m-%d %H:%M')
            || ': ' || reason AS line FROM matches),
        placed AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY postcode, start_date, end_date
            ORDER BY start_ts, outage_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lines)
        SELECT postcode, start_date, end_date, CAST(before // 1000000 AS INTEGER) AS part, count(*) AS n_lines,
            'Outages planned for ' || postcode || ', ' || start_date || ' to ' || end_date AS header,
            string_agg(line, chr(10) ORDER BY start_ts, outage_id) AS reply FROM placed GROUP BY 1, 2, 3, 4
        UNION ALL SELECT DISTINCT postcode, start_date, end_date, CAST(0 AS INTEGER), 0,
            'No outages planned for ' || postcode || ', ' || start_date || ' to ' || end_date, 'No planned outages in this period.'
        FROM requests ANTI JOIN matches USING (postcode, start_date, end_date)""",
    "pending_conversations": """SELECT conv_id, turn, text FROM conversations c
        WHERE role = 'user' AND turn = (SELECT max(turn) FROM conversations x WHERE x.conv_id = c.conv_id)""",
    "planned_rollup": _with(PLANNED)
    + """SELECT postcode, reason, count(*) AS n_outages,
        CAST(sum(epoch_us(end_ts) - epoch_us(start_ts)) AS DOUBLE) / 3.6e9 AS planned_hours,
        CAST(grouping_id(postcode, reason) AS BIGINT) AS level FROM planned GROUP BY ROLLUP (postcode, reason)""",
    "first_per_key": """SELECT source, doc_id, lang, n_chars FROM documents
        QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1""",
    "question_answer_pairs": """SELECT conv_id, turn, text AS question, answer FROM (
        SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations
        WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'""",
    "context_turns": """SELECT conv_id, turn, role, row_number() OVER w - 1 AS context_turns,
        CAST(greatest(coalesce(sum(length(text) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 1, 0)
            AS BIGINT) AS context_chars
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "pending_context": """WITH last AS (
            SELECT conv_id, turn FROM conversations c
            WHERE role = 'user' AND turn = (SELECT max(turn) FROM conversations x WHERE x.conv_id = c.conv_id))
        SELECT last.conv_id, last.turn, CAST(0 AS INTEGER) AS part,
            coalesce(string_agg(text, chr(10) ORDER BY c.turn), '') AS context
        FROM last LEFT JOIN conversations c ON c.conv_id = last.conv_id AND c.turn < last.turn GROUP BY ALL""",
    "surrogate_id": f"SELECT row_number() OVER (ORDER BY doc_id, chunk_no) AS id, doc_id, chunk_no FROM ({FIXED_CHUNKS})",
    "surrogate_id_appends": f"SELECT row_number() OVER (ORDER BY doc_id % 3, doc_id, chunk_no) AS id, doc_id, chunk_no FROM ({FIXED_CHUNKS})",
    "top_k_global": "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 10",
    "next_planned": _with(PLANNED)
    + f"""SELECT postcode, outage_id, start_ts, end_ts, reason FROM planned WHERE start_ts >= TIMESTAMP '{NEXT_FROM}'
        QUALIFY row_number() OVER (PARTITION BY postcode ORDER BY start_ts, outage_id) = 1""",
    "append_answers": """SELECT conv_id, turn, role, text FROM conversations UNION ALL
        SELECT conv_id, turn + 1, 'assistant', 'Re: ' || text FROM conversations c
        WHERE role = 'user' AND turn = (SELECT max(turn) FROM conversations x WHERE x.conv_id = c.conv_id)""",
    "time_features": """SELECT event_id, ts, CAST(day(ts) AS INTEGER) AS day, dayname(ts) AS dow,
        monthname(ts) AS month FROM events""",
    "end_from_hours": """SELECT event_id, ts + to_microseconds(CAST(floor(value * 3.6e9 + 0.5) AS BIGINT)) AS end_ts
        FROM events""",
    "day_diff": """SELECT event_id, CAST(date_diff('day', DATE '1995-01-01', CAST(ts AS DATE)) AS INTEGER) AS days
        FROM events""",
    "clamp_hours": "SELECT event_id, least(greatest(value, 0), 24) AS hours FROM events",
    "staff_adjusted": """SELECT event_id, round(least(greatest(
        value * (1 + (15 - (3 + user_id % 13)) / CAST(15 AS DOUBLE)), 0), 24), 6) AS hours FROM events""",
    "staff_lookup": _with(REQUESTS)
    + """SELECT request_id, postcode, CAST(3 + n_nationkey % 13 AS INTEGER) AS staff
        FROM requests LEFT JOIN nation ON postcode = CAST(n_nationkey + 2440 AS VARCHAR)""",
    "relative_range": f"SELECT event_id, {_relative(0)} AS start_date, {_relative(1)} AS end_date FROM events",
    "chunk_fixed": FIXED_CHUNKS,
    "chunk_separators": _with("texts AS (SELECT doc_id, text FROM documents)") [:-1] + f", {SEPARATOR_CHUNKS}",
    "sql_chunk_rows": _with("texts AS (SELECT doc_id, text FROM documents)") [:-1] + f", {SEPARATOR_CHUNKS}",
    "events_as_of": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS as_of FROM events",
    "rag_context": _with(HITS)
    + f""", found AS (SELECT question_id, count(*) AS n, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS texts
            FROM hits JOIN documents ON doc_id = vec_id GROUP BY question_id)
        SELECT vec_id AS question_id, coalesce(n, 0) AS n_texts, {_prompt()} AS prompt
        FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id LEFT JOIN found ON found.question_id = e.vec_id""",
    "text_vectors": r"""WITH counts AS (
            SELECT doc_id, word, count(*) AS tf
            FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word FROM documents) GROUP BY ALL),
        dictionary AS (
            SELECT word, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) AS rarity,
                   list_reduce(list_transform(range(1, 9), lambda i: CAST(strpos('0123456789abcdef', substr(md5(word), i, 1)) - 1 AS BIGINT)),
                               lambda a, x: a * 16 + x) % 256 AS slot
            FROM counts GROUP BY word),
        slots AS (
            SELECT doc_id, slot, sum(tf * rarity) AS w FROM counts JOIN dictionary USING (word) GROUP BY ALL HAVING sum(tf * rarity) > 0),
        units AS (
            SELECT doc_id, slot, CAST(CAST(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS FLOAT) AS DOUBLE) AS x FROM slots)
        SELECT doc_id, count(x) AS n_used, round(coalesce(sum(x * x), 0.0), 4) AS weight, round(coalesce(sum(x * (slot + 1)), 0.0), 3) AS checksum
        FROM documents LEFT JOIN units USING (doc_id) GROUP BY doc_id""",
    "precision_at_k": _with(HITS)
    + """SELECT question_id, count(*) AS n_hits,
        round(avg(CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END), 6) AS precision
        FROM hits JOIN embeddings a ON a.vec_id = question_id JOIN embeddings b ON b.vec_id = hits.vec_id
        WHERE question_id <> hits.vec_id GROUP BY question_id""",
    "in_scope": _with(HITS)
    + """SELECT question_id, max(score) AS best_score, CASE WHEN max(score) >= 0.5 THEN 1 ELSE 0 END AS in_scope
        FROM hits WHERE question_id <> vec_id GROUP BY question_id""",
    "ingest_delta": _with("texts AS (SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))")[
        :-1
    ]
    + f", {SEPARATOR_CHUNKS}",
    "outage_status": STATUS,
    "outage_status_weather": _status(
        (
            POSTCODES,
            PLANNED,
            REQUESTS,
            WEATHER,
            f"""history AS (SELECT postcode, {CLASSIFY} AS condition, CAST(temp_c AS DECIMAL(12,2)) AS hours
                FROM weather)""",
            f"""seen AS (SELECT request_id, postcode, {CLASSIFY} AS condition FROM (
                SELECT request_id, r.postcode AS postcode, condition_text, temp_c FROM requests r
                ASOF LEFT JOIN weather w ON r.postcode = w.postcode AND r.asked_at >= w.observed_at))""",
        ),
        "seen",
    ),
    "gen_history_rows": _history(2),
    "gen_history_rows_calendar": _history(1),
    "gen_planned_rows": _with(
        PLACED,
        f"""drawn AS (SELECT *, TIMESTAMP '{GEN_FROM}' + to_hours({_hash('row_id', 2, 1_000_000_000)}
            % (date_diff('day', DATE '{GEN_FROM[:10]}', DATE '{GEN_UNTIL}') + 1) * 24
            + {_hash('row_id', 3, 24)}) AS start_ts FROM placed)""",
    )
    + f"""SELECT row_id, postcode, start_ts, start_ts + to_hours({_hash('row_id', 4, 12)} + 1) AS end_ts,
        {_choice(5, REASONS)} AS reason, suburb FROM drawn""",
    "stream_running_hours": _with(HISTORY)
    + f"SELECT postcode, condition, count(*) AS n, {MEAN} AS mean_hours FROM history GROUP BY ALL",
    "stream_outage_status": STATUS,
    "stream_windowed_counts": f"""WITH placed AS (SELECT date_trunc('day', ts) AS window_start, event_type FROM events)
        SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, event_type, count(*) AS n FROM placed
        GROUP BY ALL""",
    "stream_sliding_counts": f"""WITH placed AS (
            SELECT time_bucket(INTERVAL 3 HOUR, ts) - to_hours(3 * unnest([0, 1])) AS window_start FROM events)
        SELECT window_start, window_start + INTERVAL 6 HOUR AS window_end, count(*) AS n FROM placed
        GROUP BY ALL""",
    "stream_session_counts": f"""WITH gaps AS (
            SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE
                THEN 0 ELSE 1 END AS first FROM events),
        sessions AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM gaps)
        SELECT min(ts) AS window_start, max(ts) + INTERVAL 30 MINUTE AS window_end, user_id, count(*) AS n FROM sessions
        GROUP BY user_id, session""",
    "stream_weather_asof": WEATHER_ASOF,
    "stream_weather_interval": f"""SELECT request_id, postcode, asked_at,
        CASE WHEN fresh THEN observed_at END AS observed_at, CASE WHEN fresh THEN condition_text END AS condition_text,
        CASE WHEN fresh THEN temp_c END AS temp_c
        FROM (SELECT *, observed_at >= asked_at - INTERVAL 2 HOUR AS fresh FROM ({WEATHER_ASOF}))""",
    "stream_conversation_context": """SELECT conv_id, turn, row_number() OVER w - 1 AS context_turns,
        CAST(greatest(coalesce(sum(length(text) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 1, 0)
            AS BIGINT) AS context_chars
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "stream_conversation_state": """SELECT conv_id, turn, row_number() OVER w - 1 AS context_turns,
        CAST(greatest(coalesce(sum(length(text) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 1, 0)
            AS BIGINT) AS context_chars
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "stream_deduped_users": "SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events",
}
