"""Text helpers as column expressions (all JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import IM_END, IM_START

WHITESPACE = " \t\n\r"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fill(template: str, defaults: dict[str, str] | None = None, **fields: Column | str) -> Column:
    """fill a ``{name}`` template with columns.

    Built as one ``concat`` of literal pieces and (defaulted) columns, so a value
    that itself contains ``{x}`` is never substituted again.
    """
    defaults = defaults or {}
    parts: list[Column] = []
    for literal, name, _spec, _conv in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            col = _c(fields[name]).cast("string")
            parts.append(F.coalesce(col, F.lit(defaults.get(name, ""))) if name in defaults else F.coalesce(col, F.lit("nan")))
    return F.concat(*parts) if parts else F.lit("")


def pick(options: list[Column], index: Column) -> Column:
    """L4: choose one of several columns by a 0-based index column."""
    return F.element_at(F.array(*options), (index % F.lit(len(options))).cast("int") + 1)


def strip(c: Column | str) -> Column:
    """strip spaces, tabs and line breaks at both ends."""
    return F.btrim(_c(c), F.lit(WHITESPACE))


def capitalise(c: Column | str) -> Column:
    """first letter upper, rest lower (only the first word, unlike initcap)."""
    x = _c(c)
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 30)))


def has_word(c: Column | str, word: str) -> Column:
    """case-folded substring test."""
    return F.coalesce(F.lower(_c(c)).contains(word.lower()), F.lit(False))


def shorten(c: Column | str, n: int = 100) -> Column:
    """first n characters plus '...' only if longer."""
    x = _c(c)
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit("..."))).otherwise(x)


def fixed(c: Column | str, places: int) -> Column:
    """fixed-decimal text ('nan' for missing, as the reference prints NaN).

    The null test is explicit: format_string formats a null as the text 'null' cut
    to the precision (e.g. 'n'), not as a null."""
    x = _c(c).cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit("nan")).otherwise(F.format_string(f"%.{places}f", x))


def signed_fixed(c: Column | str, places: int) -> Column:
    """signed fixed-decimal text (e.g. '+25.4')."""
    x = _c(c).cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit("nan")).otherwise(F.format_string(f"%+.{places}f", x))


def optional_part(c: Column | str, prefix: str) -> Column:
    """prefix + value when the value is present and non-empty, else ''."""
    x = _c(c)
    return F.when(x.isNotNull() & (x != ""), F.concat(F.lit(prefix), x)).otherwise(F.lit(""))


def nearer(a: Column | str, b: Column | str, target: float) -> Column:
    """1 when a is strictly nearer to target than b, else 2."""
    return F.when(F.abs(_c(a) - target) < F.abs(_c(b) - target), 1).otherwise(2)


def run_name(ts: Column | str, prefix: str = "run_") -> Column:
    """F16: run folder name from a timestamp, e.g. run_20240131_235959."""
    return F.concat(F.lit(prefix), F.date_format(_c(ts), "yyyyMMdd_HHmmss"))


def get_or(mapping: dict, key: Column | str, default) -> Column:
    """map lookup with a default (a literal map, JVM-side)."""
    m = F.create_map(*[x for kv in mapping.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return F.coalesce(F.try_element_at(m, _c(key)), F.lit(default))


def chatml(instruction: Column | str, input_: Column | str, output: Column | str) -> Column:
    """ChatML text: user block (+ ' ' + input when non-empty), assistant block."""
    return F.concat(F.lit(f"{IM_START}user\n"), _c(instruction), optional_part(input_, " "),
                    F.lit(f"\n{IM_END}\n{IM_START}assistant\n"), _c(output), F.lit(f"\n{IM_END}"))


def user_block(c: Column | str) -> Column:
    return F.concat(F.lit(f"{IM_START}user\n"), _c(c), F.lit(f"\n{IM_END}\n"))


def assistant_block(c: Column | str) -> Column:
    return F.concat(F.lit(f"{IM_START}assistant\n"), _c(c), F.lit(f"\n{IM_END}\n"))


def ensure_chat(c: Column | str) -> Column:
    """Wrap a prompt in ChatML unless it already holds a start marker."""
    x = _c(c)
    return F.when(x.contains(IM_START), x).otherwise(
        F.concat(user_block(x), F.lit(f"{IM_START}assistant\n")))
