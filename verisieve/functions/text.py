"""Text normalisation and structured-text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what loose matching strips from both ends.
LOOSE = " \t\n'\"`"


def norm(x: Column) -> Column:
    """Stripped of all white space at the ends, in lower case."""
    return F.lower(F.regexp_replace(x, r"^\s+|\s+$", ""))


def norm_quotes(x: Column) -> Column:
    return F.translate(x, '"', "'")


def norm_loose(x: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), r"^[ \t\n'\"`]+|[ \t\n'\"`]+$", ""))


def list_literal(x: Column) -> Column:
    """The strings of a list literal in either quoting."""
    return F.from_json(x, "array<string>", {"allowSingleQuotes": "true"})


def first_of_list(x: Column) -> Column:
    """First element of a list literal; other text as it is, without brackets and quotes at its ends."""
    plain = F.regexp_replace(x, r"^[\[\]'\"]+|[\[\]'\"]+$", "")
    return F.when(F.trim(x).startswith("["), F.coalesce(F.try_element_at(list_literal(x), F.lit(1)), plain)).otherwise(x)


def aliases(x: Column) -> Column:
    """All elements of a list literal; other text as the only one."""
    return F.coalesce(F.when(F.trim(x).startswith("["), list_literal(x)), F.array(x))


def verdict(said: Column, accuracy: Column) -> Column:
    """Truth of a verdict in any spelling; where absent, whether the accuracy is positive."""
    return F.coalesce(F.lower(F.trim(said.cast("string"))) == "true", accuracy > 0)


def repaired_number(x: Column) -> Column:
    """A number that may be wrapped as ``tensor(...)``; NaN and others are null."""
    value = F.regexp_replace(x, r"^tensor\((.*)\)$", "$1").try_cast("double")
    return F.when(~F.isnan(value), value)


def config_values(x: Column, key: str) -> Column:
    """An integer of ``key=value,...`` text; None is null."""
    return F.try_element_at(F.str_to_map(x, F.lit(","), F.lit("=")), F.lit(key)).try_cast("int")


def unfence(x: Column) -> Column:
    """Text without code fences."""
    return F.regexp_replace(F.regexp_replace(x, r"(?s)^\s*```[a-zA-Z]*\s*", ""), r"\s*```\s*$", "")


def first_object(x: Column) -> Column:
    """The widest brace-to-brace part of the text."""
    return F.nullif(F.regexp_extract(unfence(x), r"(?s)\{.*\}", 0), F.lit(""))


def distractor_violations(items: Column, truth: Column, greedy: Column, greedy_wrong: Column) -> Column:
    """Names of the rules that a distractor list breaks."""
    rules = (
        ("missing", items.isNull()),
        ("not_three", F.size(items) != 3),
        ("empty", F.exists(items, lambda v: norm(v) == "")),
        ("greedy_first", greedy_wrong & (norm(items[0]) != norm(greedy))),
        ("is_truth", F.exists(items, lambda v: norm(v) == norm(truth))),
    )
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules]))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    return F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, v: F.struct((s["n"] + (s["on"] & v).cast("int")).alias("n"), (s["on"] & v).alias("on")), lambda s: F.least(s["n"], F.least(F.size(a), F.size(b))))


def same_answer(a: Column, b: Column) -> Column:
    """Whether two answers are equal once normalised; false with a null."""
    return F.coalesce(norm(a) == norm(b), F.lit(False))


#: The short codes of the answer categories.
CATEGORY_CODES = {"incorrect_high": "IH", "correct_high": "CH", "incorrect_low": "IL", "correct_low": "CL"}


def short_code(category: Column, codes: dict[str, str] = CATEGORY_CODES, unknown: str = "?") -> Column:
    table = F.create_map(*[F.lit(v) for kv in codes.items() for v in kv])
    return F.coalesce(F.try_element_at(table, category), F.lit(unknown))
