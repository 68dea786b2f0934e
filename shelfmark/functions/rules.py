"""Ordered rule tables as columns; a rule is (pattern, label)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Rules = list[tuple[str, str]]


def first_match(text: Column, rules: Rules, default: Column | str | None = None) -> Column:
    """Label of the first rule whose pattern is in the text."""
    made = F.coalesce(*(F.when(text.rlike(p), F.lit(name)) for p, name in rules)) if rules else F.lit(None).cast("string")
    if default is None:
        return made
    return F.coalesce(made, default if isinstance(default, Column) else F.lit(default))


def cascade(*stages: tuple[Column, Rules], default: Column | str) -> Column:
    """First match over several texts, each with its own rules, in order."""
    last = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(*(first_match(t, r) for t, r in stages if r), last)


def all_matches(text: Column, rules: Rules) -> Column:
    """Labels of all rules that match, in order, each once."""
    return F.array_distinct(F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(name)) for p, name in rules))))


def roll_up(label: Column, parents: dict[str, str], text: Column, rules: Rules, default: str) -> Column:
    """Parent of a label by table, else by rules on the text, else ``default``."""
    table = F.create_map(*(F.lit(x) for kv in parents.items() for x in kv))
    return F.coalesce(table[label], first_match(text, rules), F.lit(default))
