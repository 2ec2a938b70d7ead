"""Raw lines -> typed lines -> events."""

from __future__ import annotations

import json
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from logspark.functions import catalog
from logspark.functions import columns as C

_MARK = "\u0001"


def parse_lines(lines: DataFrame) -> DataFrame:
    """Split ``value`` into header fields and content.

    A line without a header keeps its whole text as content and empty header fields. One regex
    pass per line: the header is rewritten with a separator no header field can hold, then split
    with a limit, so the content may hold it.
    """
    marked = _MARK.join(f"${n}" for n in range(1, len(catalog.HEADER_FIELDS) + 1))
    packed = F.regexp_replace("value", catalog.HEADER_PATTERN, marked)
    parts = F.when(F.col("_packed") != F.col("value"), F.split("_packed", _MARK, len(catalog.HEADER_FIELDS)))
    fields = F.struct(*[
        F.coalesce(F.get("_parts", F.lit(n)), F.col("value") if name == "content" else F.lit("")).alias(name)
        for n, name in enumerate(catalog.HEADER_FIELDS)])
    keep = [c for c in lines.columns if c != "value"]
    # A one-element generator: filters on the fields stay above it, so none repeats the regex.
    parsed = (
        lines.withColumn("_packed", packed)
        .withColumn("_parts", parts)
        .select(*keep, F.inline(F.array(fields)))
    )
    return parsed.withColumn("ts", C.parse_ts(F.col("date"), F.col("time")))


def assign_events(parsed: DataFrame) -> DataFrame:
    """Add ``event_id`` and ``event_template``; the text is only worked out where it is used."""
    content = F.col("content")
    return parsed.withColumn("event_id", C.match_template("content")).withColumn(
        "event_template", C.template_text(F.col("event_id"), content))


def structured_lines(lines: DataFrame) -> DataFrame:
    return assign_events(parse_lines(lines))


#: Branches of one CASE; a longer catalogue is several of them, so that generated code stays small.
BRANCHES = 200
#: Length of the pieces of text that the index of a long catalogue is made of.
GRAM = 4
#: Catalogues up to this length are settled by searching each literal in the line.
SHORT = 60


def literal_runs(pattern: str) -> list[str]:
    """Texts of ASCII characters that every match of a pattern holds, in lower case; none where that isn't plain to see.

    What is optional, repeated, in a group or a class, or an escape with a meaning of its own ends a run.
    """
    if re.search(r"\(\?[a-z]*x|\\[QEcx0-9pPu]|(?<!\\)\|", pattern):
        return []
    runs, run, at, depth = [], "", 0, 0
    while at < len(pattern):
        char = pattern[at]
        literal = None
        if char == "\\" and at + 1 < len(pattern):
            at += 1
            literal = None if pattern[at].isalnum() else pattern[at]
        elif char == "[":
            at += 1 if pattern[at + 1:at + 2] != "^" else 2
            inside = 0
            while at + 1 < len(pattern) and (pattern[at] != "]" or inside == 0):
                at += 2 if pattern[at] == "\\" else 1
                inside += 1
        elif char in "()":
            depth += 1 if char == "(" else -1
        elif char == "{":
            at = max(at, pattern.find("}", at))
        elif char not in ".^$*+?":
            literal = char
        following = pattern[at + 1:at + 2]
        if literal is not None and depth == 0 and literal.isascii() and following not in ("?", "*", "{"):
            run += literal
            if following != "+":
                at += 1
                continue
        runs.append(run)
        run = ""
        at += 1
    return [r.lower() for r in [*runs, run] if r]


def _guards(patterns: list[str]) -> list[str | None]:
    """A text of each pattern that a line must hold: the longest, or in a long catalogue the piece that fewest patterns have."""
    runs = [literal_runs(p) for p in patterns]
    if len(patterns) <= SHORT:
        return [max(own, key=len) if own else None for own in runs]
    pieces = [{r[n:n + GRAM] for r in own for n in range(len(r) - GRAM + 1)} for own in runs]
    often = Counter(piece for own in pieces for piece in own)
    return [min(own, key=lambda piece: (often[piece], piece)) if own else None for own in pieces]


def match_catalogue(parsed: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Events from a user's table ``(priority, event_id, pattern, template)``: lowest priority wins.

    The patterns become literals: no join, no shuffle, the line that matches carries event and template of its own row.
    A catalogue is code, not data: its rows come to the driver.

    A regex only runs on lines that hold a text which the pattern can't match without. A long catalogue has an index of
    such texts, one piece of ``GRAM`` characters per pattern, the rarest it has: the pieces of a line are looked up in the set of
    all, and only patterns whose piece is found are tried. Patterns without such a text are tried on every line.
    """
    rows = catalogue.orderBy("priority", "event_id", "pattern").collect()
    guards = _guards([row["pattern"] for row in rows])
    # One-element generators: the line is folded, and its pieces are looked up, once.
    line = parsed.select("*", F.explode(F.array(F.expr(C.fold_case("content")))).alias("_folded"))
    indexed = [n for n, guard in enumerate(guards) if guard is not None] if len(rows) > SHORT else []
    cases = _cases(rows, guards, [n for n in range(len(rows)) if n not in set(indexed)])
    if not indexed:
        numbered = line.withColumn("_n", F.coalesce(*cases) if cases else F.lit(None).cast("int"))
    else:
        line = line.select("*", F.explode(F.array(_indexed(rows, guards, indexed))).alias("_indexed"))
        numbered = line.withColumn("_n", F.least("_indexed", F.coalesce(*cases)) if cases else F.col("_indexed"))
    texts = _literal([{"event_id": row["event_id"], "template": row["template"]} for row in rows],
                     "array<struct<event_id:string,template:string>>")
    unmatched = F.struct(
        F.lit(catalog.UNMATCHED_EVENT).alias("event_id"),
        F.substring("content", 1, catalog.UNMATCHED_WIDTH).alias("template"))
    found = numbered.select("*", F.explode(F.array(F.col("_n"))).alias("_row"))
    return found.select(*parsed.columns, F.inline(F.array(F.when(F.col("_row").isNotNull(), F.get(texts, F.col("_row"))).otherwise(
        unmatched))).alias("event_id", "event_template"))


def _literal(value: object, schema: str) -> Column:
    """A nested constant as one literal, however long."""
    return F.from_json(F.lit(json.dumps({"value": value})), f"value {schema}")["value"]


def _cases(rows: list[Row], guards: list[str | None], only: list[int]) -> list[Column]:
    """Number of the first pattern of ``only`` that matches; a CASE of ``BRANCHES`` each."""
    cases = []
    for start in range(0, len(only), BRANCHES):
        case = None
        for n in only[start:start + BRANCHES]:
            hit = F.col("content").rlike("(?diu)" + rows[n]["pattern"])
            if guards[n] is not None:
                hit = F.contains("_folded", F.lit(guards[n])) & hit
            case = F.when(hit, n) if case is None else case.when(hit, n)
        cases.append(case)
    return cases


def _indexed(rows: list[Row], guards: list[str | None], only: list[int]) -> Column:
    """Number of the first pattern of ``only`` that matches, of those whose piece the line holds."""
    by_piece: dict[str, list[int]] = {}
    for n in only:
        by_piece.setdefault(guards[n], []).append(n)
    index = _literal(by_piece, "map<string,array<int>>")
    patterns = _literal(["(?diu)" + row["pattern"] for row in rows], "array<string>")
    pieces = F.regexp_extract_all("_folded", F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1))
    known = F.array_distinct(F.filter(pieces, lambda piece: piece.isin(list(by_piece))))
    tried = F.flatten(F.transform(known, lambda piece: F.try_element_at(index, piece)))
    return F.array_min(F.filter(tried, lambda n: F.rlike(F.col("content"), F.get(patterns, n))))


def template_stats(events: DataFrame) -> DataFrame:
    """Occurrences per event; an unmatched event shows the text of its last line."""
    return events.groupBy("event_id").agg(
        F.max_by("event_template", "line_id").alias("event_template"),
        F.count(F.lit(1)).alias("occurrences"),
    )


def distinct_events(events: DataFrame) -> DataFrame:
    return events.select("event_id").distinct()


def parse_summary(events: DataFrame, tuples: DataFrame, labels: DataFrame) -> DataFrame:
    """The counters a run reports, as one row of long-form (name, value)."""
    lines = events.agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("event_id") == catalog.UNMATCHED_EVENT).alias("unmatched"),
    )
    sessions = tuples.groupBy("block_id").agg(F.lit(1)).agg(F.count(F.lit(1)).alias("sessions"))
    label_counts = labels.agg(
        F.count(F.lit(1)).alias("labels"), F.count_if(F.col("label") == 1).alias("anomalies"))
    parts = [
        counts.select(F.explode(F.create_map(*[x for c in counts.columns for x in (F.lit(c), F.col(c))]))
                      .alias("counter", "value"))
        for counts in (lines, sessions, label_counts)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
