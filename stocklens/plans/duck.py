"""SQL snippets for the DuckDB side of the query checks."""

from __future__ import annotations

from stocklens.functions import text as tx

WS = tx.WS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str, entities=tx.ENTITIES) -> str:
    out = f"regexp_replace(coalesce({x}, ''), '<[^>]*>', ' ', 'g')"
    for a, b in entities:
        out = f"replace({out}, {q(a)}, {q(b)})"
    return f"trim(regexp_replace({out}, {q(WS + '+')}, ' ', 'g'))"


def trim(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{WS}+|{WS}+$')}, '', 'g')"


def blank(x: str) -> str:
    return f"({trim(f'coalesce({x}, {chr(39)*2})')} = '')"


def empty(x: str) -> str:
    return f"(coalesce({x}, '') = '')"


def matches(x: str, patterns) -> str:
    return "(" + " or ".join(f"regexp_matches({x}, {q(p[1])})" for p in patterns) + ")"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def contains_any(x: str, phrases) -> str:
    return "(" + " or ".join(f"contains({x}, {q(p)})" for p in phrases) + ")"


def word_set(x: str) -> str:
    return (f"list_distinct(list_filter(regexp_split_to_array(lower({x}), {q(WS + '+')}), "
            f"lambda w: length(w) > 2))")


def normalize(x: str) -> str:
    flat = f"translate(lower(coalesce({x}, '')), {q(tx.ACCENTED)}, {q(tx.PLAIN)})"
    flat = rf"regexp_replace({flat}, '[\x{{300}}-\x{{36F}}]', '', 'g')"
    return f"trim(regexp_replace({flat}, '[^a-z0-9]+', ' ', 'g'))"


def fold(x: str) -> str:
    """floor(x + 0.5)"""
    return f"cast(floor({x} + 0.5) as bigint)"


NOW = "timestamp '2024-02-01 00:00:00'"


def days(later: str, earlier: str) -> str:
    return f"((epoch_us({later}) - epoch_us({earlier})) / 86400000000.0)"
