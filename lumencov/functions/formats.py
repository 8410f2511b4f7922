"""Column expressions that write the values of a report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def coverage_pct(hits: Column, lines: Column) -> Column:
    """"0" without hits, "100" where all lines are hit, else five decimals."""
    share = F.replace(F.format_number(hits.cast("double") / lines.cast("double") * 100, 5), F.lit(","), F.lit(""))
    return F.when(hits == 0, "0").when(hits == lines, "100").otherwise(share)


def json_or_null(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("null"))


def format_coverage(hits: Column, hit_branches: Column, total_branches: Column) -> Column:
    """JSON of a coverage value: the hits, else "hit/total"; it is an error to have neither."""
    fraction = F.concat(F.lit('"'), hit_branches.cast("string"), F.lit("/"), total_branches.cast("string"), F.lit('"'))
    return F.coalesce(hits.cast("string"), fraction, F.raise_error(F.lit("a line has neither hits nor branches")).cast("string"))


def format_type(coverage_type: Column) -> Column:
    return F.when(coverage_type == "l", "null").otherwise(F.concat(F.lit('"'), coverage_type, F.lit('"')))


def format_complexity(hit_paths: Column, total: Column) -> Column:
    """JSON of a complexity: [hit, total], or whichever of the two is there, or null."""
    both = F.concat(F.lit("["), hit_paths.cast("string"), F.lit(","), total.cast("string"), F.lit("]"))
    return F.coalesce(both, total.cast("string"), hit_paths.cast("string"), F.lit("null"))


def trimmed_array(slots: list[Column]) -> Column:
    """JSON array of the JSON slots without nulls at its end."""
    all_ = F.array(*[F.coalesce(s, F.lit("null")) for s in slots])
    used = F.lit(0)
    for k, slot in enumerate(slots):
        used = F.when(F.coalesce(slot, F.lit("null")) != "null", k + 1).otherwise(used)
    return F.concat(F.lit("["), F.array_join(F.slice(all_, F.lit(1), used), ","), F.lit("]"))


def totals_array(slots: list[Column | int]) -> Column:
    """JSON array of a report's totals; strings are quoted by the caller."""
    return F.concat(F.lit("["), F.concat_ws(",", *[F.lit(str(s)) if isinstance(s, int) else s.cast("string") for s in slots]), F.lit("]"))


def quoted(text: Column) -> Column:
    """JSON string of a text; null stays null."""
    whole = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substring(whole, F.lit(2), F.length(whole) - 2))
