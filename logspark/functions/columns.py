"""Column expressions shared by the operators. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from logspark.functions import catalog


# ---- log text -----------------------------------------------------------------------------------

def parse_ts(date: Column, time: Column) -> Column:
    """``yymmdd`` + ``hhmmss`` -> timestamp, null when it is no valid moment.

    Two-digit years from 69 on belong to the 1900s.
    """
    century = F.when(F.substring(date, 1, 2) >= "69", "19").otherwise("20")
    return F.try_to_timestamp(F.concat(century, date, time), F.lit("yyyyMMddHHmmss"))


def fold_case(text: str) -> str:
    """SQL: lower case, with the four letters that equal an ASCII one when case is ignored replaced."""
    return (f"CASE WHEN octet_length({text}) = char_length({text}) THEN lower({text}) "
            f"ELSE lower(translate({text}, '\u017f\u212a\u0131\u0130', 'skii')) END")


def match_template(text: str = "content") -> Column:
    """Id of the first template found in a text column, ignoring case; ``E0`` when there is none.

    On folded text a byte search settles one-part templates and spares most lines the regex of the
    others. The CASE runs as a lambda over one element: the text is folded once, and the many
    branches stay out of generated code, where they would pass the size a method may have.
    """
    branches = []
    for event_id, template in catalog.TEMPLATES.items():
        parts = catalog.pieces(template.lower())
        hit = f"contains(t, '{max(parts, key=len)}')"
        if len(parts) > 1:
            hit += f" AND t RLIKE r'(?d){catalog.pattern(template.lower())}'"
        branches.append(f"WHEN {hit} THEN '{event_id}'")
    choice = f"CASE {' '.join(branches)} ELSE '{catalog.UNMATCHED_EVENT}' END"
    return F.expr(f"get(transform(array({fold_case(text)}), t -> {choice}), 0)")


def template_text(event_id: Column, content: Column) -> Column:
    """Display text of an event; unmatched lines show their first characters."""
    texts = F.create_map(*[F.lit(v) for pair in catalog.TEMPLATES.items() for v in pair])
    return F.coalesce(F.try_element_at(texts, event_id), F.substring(content, 1, catalog.UNMATCHED_WIDTH))


def blocks_all(content: Column) -> Column:
    """Every session key in the text, repeats kept."""
    return F.regexp_extract_all(content, F.lit(catalog.BLOCK_PATTERN), F.lit(0))


def block_first(content: Column) -> Column:
    """First session key in the text, null when there is none."""
    return F.nullif(F.regexp_extract(content, catalog.FIRST_BLOCK_PATTERN, 1), F.lit(""))


# ---- events and labels --------------------------------------------------------------------------

def is_error_event(event_id: Column, errors: Iterable[str] = tuple(catalog.ERROR_EVENTS)) -> Column:
    return event_id.isin(list(errors))


def event_number(event_id: Column) -> Column:
    """Number after the first character; ids that are not numeric go last."""
    tail = event_id.substr(F.lit(2), F.length(event_id))
    return F.when(tail.rlike("^[0-9]+$"), tail.try_cast("bigint")).otherwise(F.lit(catalog.NON_NUMERIC_EVENT).cast("bigint"))


def event_token(value: Column) -> Column:
    """Integer in an event written as ``"E22"``, ``" 7 "`` or ``7``; anything else is an error."""
    text = F.btrim(value.cast("string"), F.lit(" \t\n\r\x0b\x0c"))
    after_e = F.nullif(F.regexp_extract(text, r"[Ee](\d+)", 1), F.lit(""))
    return F.coalesce(
        after_e.try_cast("bigint"),
        text.try_cast("bigint"),
        F.raise_error(F.concat(F.lit("not an event id: "), F.coalesce(text, F.lit("null")))).cast("bigint"),
    )


def label_text(label: Column) -> Column:
    return F.when(label == 1, "Fail").otherwise("Success")


def label_value(text: Column) -> Column:
    """Integer label from a number or from the words normal / anomaly; anything else is an error."""
    clean = F.lower(F.trim(text.cast("string")))
    return (
        F.when(clean == "normal", 0)
        .when(clean == "anomaly", 1)
        .otherwise(F.coalesce(
            clean.try_cast("double").cast("int"),
            F.raise_error(F.concat(F.lit("not a label: "), F.coalesce(clean, F.lit("null")))).cast("int"),
        ))
    )


def binarise_label(label: Column) -> Column:
    return (label.cast("bigint") != 0).cast("int")


# ---- sequences ----------------------------------------------------------------------------------

def features_string(event_ids: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(event_ids, ","), F.lit("]"))


def shift_tokens(tokens: Column) -> Column:
    """Token + 1, so that 0 is free for padding."""
    return F.transform(tokens, lambda t: t + 1)


def pad_truncate(tokens: Column, length: int) -> Column:
    """Last ``length`` tokens, zeros in front of shorter sequences."""
    size = F.size(tokens)
    missing = F.greatest(F.lit(length) - size, F.lit(0))
    tail = F.slice(tokens, F.greatest(size - length, F.lit(0)) + 1, F.lit(length))
    return F.concat(F.array_repeat(F.lit(0).cast("bigint"), missing), tail)


def encode_sequence(event_ids: Column, codes: dict[str, int]) -> Column:
    """Code of every event, 0 for events without one."""
    if not codes:
        return F.transform(event_ids, lambda e: F.lit(0))
    table = F.create_map(*[F.lit(v) for pair in codes.items() for v in pair])
    return F.transform(event_ids, lambda e: F.coalesce(F.try_element_at(table, e), F.lit(0)))


# ---- time ---------------------------------------------------------------------------------------

def seconds(ts: Column) -> Column:
    """Epoch seconds with fraction; takes timestamps with and without zone."""
    return ts.cast("timestamp").cast("double")


def round_gap(gap: Column) -> Column:
    """One decimal, half to even."""
    return F.bround(gap, 1)


def round_latency(gap: Column) -> Column:
    """Whole seconds, half to even."""
    return F.bround(gap, 0).cast("bigint")


def gap_text(gap: Column) -> Column:
    return round_gap(gap).cast("decimal(20,1)").cast("string")


# ---- numbers ------------------------------------------------------------------------------------

def sigmoid(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def above(prob: Column, threshold: float = 0.5) -> Column:
    """1 when strictly above the threshold."""
    return (prob > F.lit(float(threshold))).cast("int")


def safe_ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom``, 0.0 when there is nothing to divide by."""
    return F.when(bottom > 0, top.cast("double") / bottom.cast("double")).otherwise(F.lit(0.0))
