"""Building blocks of the DuckDB statements that the registered queries are checked against."""

from __future__ import annotations

from logspark.functions import catalog
from logspark.workload.views import BLK, DAILY_EVENTS, DUCKDB_TS, raw_logs_sql

HEADER = r"^(\d{6})\s+(\d{6})\s+(\d+)\s+(\w+)\s+([\w.$]+):\s+(.+)$"
ERRORS = ", ".join(f"'{e}'" for e in catalog.ERROR_EVENTS)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_HITS = " ".join(f"WHEN regexp_matches(content, {_quoted(catalog.pattern(t))}, 'i') THEN '{e}'"
                 for e, t in catalog.TEMPLATES.items())
_TEXTS = " ".join(f"WHEN '{e}' THEN {_quoted(t)}" for e, t in catalog.TEMPLATES.items())


def _parsed(source: str) -> str:
    names = ["date", "time", "pid", "level", "component", "content"]
    fields = ", ".join(
        f"CASE WHEN regexp_matches(value, '{HEADER}') THEN regexp_extract(value, '{HEADER}', {n}) "
        + ("ELSE value" if name == "content" else "ELSE ''") + f" END AS {name}"
        for n, name in enumerate(names, 1))
    return f"""SELECT *, cast(epoch(try_strptime(
 CASE WHEN date[1:2] >= '69' THEN '19' ELSE '20' END || date || time, '%Y%m%d%H%M%S')) AS bigint) AS ts_s
FROM (SELECT line_id, {fields} FROM {source}) p"""


def _events(source: str) -> str:
    return f"""SELECT *, CASE event_id {_TEXTS} ELSE content[1:80] END AS event_template
FROM (SELECT *, CASE {_HITS} ELSE 'E0' END AS event_id FROM {source}) e"""


CTES = {
    "raw_logs": raw_logs_sql(DUCKDB_TS),
    "parsed": _parsed("raw_logs"),
    "ev": _events("parsed"),
    "tup": "SELECT line_id, event_id, ts_s, unnest(b) AS block_id, generate_subscripts(b, 1) - 1 AS pos "
           "FROM (SELECT *, regexp_extract_all(content, 'blk_[-0-9]+') AS b FROM ev) t",
    "firsts": "SELECT * FROM (SELECT line_id, event_id, content, "
              "nullif(regexp_extract(content, '(blk_-?[0-9]+)', 1), '') AS block_id FROM ev) f "
              "WHERE block_id IS NOT NULL",
    "lab": f"SELECT {BLK.format(id='doc_id')} AS block_id, toxic AS label FROM labels",
    "ranks": "SELECT event_id, cast(row_number() OVER (ORDER BY cast(event_id[2:] AS int), event_id) AS bigint) "
             "AS code FROM (SELECT DISTINCT event_id FROM ev) d",
    "traces": "SELECT user_id AS session, event_id AS line_id, event_type AS event, "
              "cast(ascii(event_type) - 96 AS bigint) AS token, ts FROM events",
    "turns": "SELECT conv_id AS session, turn AS pos, role AS event, cast(ascii(role) - 96 AS bigint) AS token "
             "FROM conversations",
    "roles": "SELECT session, count(*) FILTER (WHERE event = 'assistant') AS assistant, "
             "count(*) FILTER (WHERE event = 'system') AS system, count(*) FILTER (WHERE event = 'user') AS \"user\" "
             "FROM turns GROUP BY session",
    "scores": "SELECT event_id AS id, value / 500.0 AS prob, cast(event_type = 'error' AS int) AS y, "
              "cast(ts AS date) AS day FROM events",
    "daily": "SELECT *, cast(\"error\" >= 2 AS int) AS y FROM (SELECT cast(user_id AS string) || '|' || "
             "strftime(ts, '%Y-%m-%d') AS session, "
             + ", ".join(f"cast(count(*) FILTER (WHERE event_type = '{e}') AS int) AS \"{e}\"" for e in DAILY_EVENTS)
             + " FROM events GROUP BY 1) d",
    "paired": "SELECT session, cast(n AS int) AS opened, cast(n - lost AS int) AS closed, cast(2 * n AS int) AS checked, "
              "cast(lost > 0 AS int) AS y FROM (SELECT cast(user_id AS string) || '|' || strftime(ts, '%Y-%m-%d') AS session, "
              "count(*) AS n, count(*) FILTER (WHERE event_type = 'error' AND event_id % 7 = 0) AS lost FROM events GROUP BY 1) p",
    "confusion": "SELECT count(*) FILTER (WHERE prob <= 0.5 AND y = 0) AS tn, "
                 "count(*) FILTER (WHERE prob > 0.5 AND y = 0) AS fp, "
                 "count(*) FILTER (WHERE prob <= 0.5 AND y = 1) AS fn, "
                 "count(*) FILTER (WHERE prob > 0.5 AND y = 1) AS tp FROM scores",
    "curve": "SELECT id, prob, y, rank, cast(tp AS bigint) AS tp, cast(fp AS bigint) AS fp, tp / (tp + fp) AS p, "
             "tp / (sum(y) OVER ()) AS r FROM (SELECT *, "
             "row_number() OVER w AS rank, sum(y) OVER w AS tp, sum(1 - y) OVER w AS fp FROM scores "
             "WINDOW w AS (ORDER BY prob DESC, id ROWS UNBOUNDED PRECEDING)) c",
}
_NEEDS = {
    "parsed": ["raw_logs"], "ev": ["parsed"], "tup": ["ev"], "firsts": ["ev"], "ranks": ["ev"],
    "roles": ["turns"], "confusion": ["scores"], "curve": ["scores"],
}


def free_text_ctes() -> dict[str, str]:
    return {
        "raw_logs": "SELECT doc_id * 1000000 + generate_subscripts(l, 1) - 1 AS line_id, unnest(l) AS value "
                    "FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) d",
    }


def statement(body: str, *ctes: str, **extra: str) -> str:
    """``body`` with the named views in front, those they need first."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in ctes:
        add(name)
    views = {name: extra.get(name, CTES[name]) for name in ordered}
    views.update({name: text for name, text in extra.items() if name not in views})
    head = ",\n".join(f"{name} AS ({text})" for name, text in views.items())
    return (f"WITH {head}\n" if head else "") + body
