"""Column expressions that read the values of a report from JSON text.

Slots of an array come as text: a number as it stands, null as null, an array as its JSON, a string with a mark before it, so that
"1" and 1 stay apart. They come from a VARIANT, of which a line is made once (`items`, `slot_of`), or from JSON text (`mark_strings`, `slots`).
Parsers of arrays take the array's slots besides its text, where they are at hand.

Most lines are written plainly (`PLAIN`): no spaces or escapes, numbers of up to nine digits, one kind of value in each place. Their slots are
told apart by their place alone, without a VARIANT and without a second look (`plain_*`); the results are those of the other parsers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
_IS_NUMBER = f"^{_NUMBER}$"
_LARGEST = 4294967295.0
MARK = "s:"


_N = "(?:0|[1-9][0-9]{0,8}+)"
_COVERAGE = f'(?:{_N}|"{_N}/{_N}")'
_TYPE = '(?:null|"[bm]")'
_COMPLEXITY = rf"(?:null|{_N}|\[{_N},{_N}\])"


def _listed(item: str) -> str:
    return rf"\[{item}(?:,{item})*+\]"


_SESSION = rf"""\[{_N},{_COVERAGE}(?:,(?:null|{_listed(f'"{_N}"')})(?:,(?:null|{_listed(rf"\[(?:null|{_N}),(?:null|{_N}),{_N}\]")})(?:,{_COMPLEXITY})?+)?+)?+\]"""
_POINT = rf"""\[{_N},{_COVERAGE},{_TYPE},{_listed(r'"[^"\\\x00-\x1f]*+"')}\]"""
#: A line as writers put it; every quantifier keeps what it took, so that a line of any length is read in one pass.
PLAIN = rf"^\[{_COVERAGE},{_TYPE},{_listed(_SESSION)}(?:,null(?:,{_COMPLEXITY}(?:,(?:null|{_listed(_POINT)}))?+)?+)?+\]\z"


def mark_strings(json: Column) -> Column:
    """Every string of a JSON text with MARK before its content."""
    return F.when(json.contains('"'), F.regexp_replace(json, r'"((?:[^"\\]|\\.)*+)"', f'"{MARK}$1"')).otherwise(json)


def slots(json: Column) -> Column:
    """An array's slots as text; null for anything else."""
    return F.from_json(json, "array<string>")


def items(value: Column) -> Column:
    """A VARIANT's elements; null for anything but an array."""
    return F.try_variant_get(value, "$", "array<variant>")


def slot_of(value: Column) -> Column:
    """The text of a VARIANT that is a slot."""
    text = F.to_json(value)
    return F.when(text == "null", F.lit(None).cast("string")).when(text.startswith('"'), F.concat(F.lit(MARK), F.try_variant_get(value, "$", "string"))).otherwise(text)


def slot_beside(value: Column, own: Column) -> Column:
    """slot_of, where the slots of an array are at hand and its text isn't needed."""
    return F.when(own.isNotNull(), F.lit("[")).otherwise(slot_of(value))


def slots_of(value: Column) -> Column:
    """Texts of a VARIANT's elements; null for anything but an array."""
    return F.transform(items(value), slot_of)


def string_of(slot: Column) -> Column:
    """The content of a slot that is a string; null for anything else."""
    return F.when(slot.startswith(MARK), F.substring(slot, F.lit(len(MARK) + 1), F.length(slot)))


def clamp_u32(x: Column) -> Column:
    """A number cut to an integer between 0 and 2^32 - 1; null for null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x.cast("double"), F.lit(0.0)), F.lit(_LARGEST)).cast("long"))


def is_number(slot: Column) -> Column:
    """Of all JSON values only a number begins with a digit or a minus, as strings are marked."""
    return (slot >= "-") & (slot < ":") & ~slot.endswith("y")  # some readers let -Infinity pass


def number(slot: Column) -> Column:
    """The clamped value of a slot that is a number; null for anything else."""
    return F.when(is_number(slot), clamp_u32(slot.try_cast("double")))


def kind_of(slot: Column) -> Column:
    """hits, branches or partial, by the form of a coverage value; null for anything else."""
    return F.when(is_number(slot), "hits").when(slot.startswith(MARK) & slot.rlike(f"^{MARK}{_NUMBER}/{_NUMBER}$"), "branches").when(slot == "true", "partial")


def coverage(slot: Column) -> Column:
    """struct(kind, a, b) of a coverage value: hits a, or a of b branches."""
    kind = kind_of(slot)
    of = lambda part: clamp_u32(part.try_cast("double"))
    first = F.when(kind == "hits", of(slot)).when(kind == "branches", of(F.substring_index(string_of(slot), "/", 1)))
    return F.struct(kind.alias("kind"), first.alias("a"), F.when(kind == "branches", of(F.substring_index(slot, "/", -1))).alias("b"))


def coverage_type(slot: Column) -> Column:
    """l, b or m; null for a type that isn't known. No type is a line."""
    return F.when(slot.isNull() | (slot == "s:line"), "l").when(slot.isin("s:b", "s:branch"), "b").when(slot.isin("s:m", "s:method"), "m")


def normalized_type(kind: Column, type_: Column) -> Column:
    """Branch data on a line make it a branch."""
    return F.when((kind == "branches") & (type_ == "l"), "b").otherwise(type_)


def normalized(cov: Column, type_: Column) -> Column:
    """struct(coverage_type, hits, hit_branches, total_branches, valid) of a coverage and its type.

    Partial is 1 of 2 branches; branches of a method are hits; a hit count of a branch is that many of 2, and must not be over 2.
    """
    kind, a, b = cov["kind"], cov["a"], cov["b"]
    of_two = (kind == "hits") & (type_ == "b")
    fraction = (kind == "branches") & (type_ != "m")
    return F.struct(
        normalized_type(kind, type_).alias("coverage_type"),
        F.when((kind == "hits") & (type_ != "b"), a).when((kind == "branches") & (type_ == "m"), a).alias("hits"),
        F.when(kind == "partial", F.lit(1).cast("long")).when(fraction | of_two, a).alias("hit_branches"),
        F.when((kind == "partial") | of_two, F.lit(2).cast("long")).when(fraction, b).alias("total_branches"),
        (kind.isNotNull() & type_.isNotNull() & ~F.coalesce(of_two & (a > 2), F.lit(False))).alias("valid"),
    )


def complexity(slot: Column, own: Column | None = None) -> Column:
    """struct(paths, total, valid): a total alone, or [paths, total]; nothing is valid too."""
    pair = F.when(slot.startswith("["), slots(slot) if own is None else own)
    a, b = number(F.get(pair, 0)), number(F.get(pair, 1))
    both = (F.size(pair) == 2) & a.isNotNull() & b.isNotNull()
    single = is_number(slot)
    found = F.when(single, F.struct(F.lit(None).cast("long").alias("paths"), number(slot).alias("total"), F.lit(True).alias("valid"))).when(both, F.struct(a.alias("paths"), b.alias("total"), F.lit(True).alias("valid")))
    nothing = lambda ok: F.struct(F.lit(None).cast("long").alias("paths"), F.lit(None).cast("long").alias("total"), F.lit(ok).alias("valid"))
    return F.when(slot.isNull(), nothing(True)).otherwise(F.coalesce(found, nothing(False)))


def missing_branches(slot: Column, own: Column | None = None) -> Column:
    """struct(branch_format, branches, valid): lines, else block:branch pairs, else conditions; a list is all of one format."""
    texts = F.transform(F.when(slot.startswith("["), slots(slot) if own is None else own), string_of)
    every = lambda pattern: F.forall(texts, lambda t: F.coalesce(t.rlike(pattern), F.lit(False)))
    format_ = F.when(F.size(texts) == 0, "c").when(every(_IS_NUMBER), "l").when(every(f"^{_NUMBER}:{_NUMBER}$"), "bb").when(every(f"^{_NUMBER}(:jump)?$"), "c")
    part = lambda t: clamp_u32(t.try_cast("double")).cast("string")
    clean = F.transform(texts, lambda t: F.when(t.rlike("^(?:0|[1-9][0-9]{0,8})$"), t).when(t.contains(":jump"), F.concat(part(F.substring_index(t, ":", 1)), F.lit(":jump"))).when(t.contains(":"), F.concat(part(F.substring_index(t, ":", 1)), F.lit(":"), part(F.substring_index(t, ":", -1)))).otherwise(part(t)))
    found = F.struct(format_.alias("branch_format"), F.when(format_.isNotNull(), clean).alias("branches"), format_.isNotNull().alias("valid"))
    nothing = F.struct(F.lit(None).cast("string").alias("branch_format"), F.lit(None).cast("array<string>").alias("branches"), F.lit(True).alias("valid"))
    return F.when(slot.isNull(), nothing).otherwise(found)


def partial_spans(slot: Column, own: Column | None = None) -> Column:
    """struct(spans, valid): [start, end, coverage] each; hits are 0 unless the coverage is a hit count."""

    def span(x: Column) -> Column:
        a, b, c = F.get(x, 0), F.get(x, 1), F.get(x, 2)
        good = (F.size(x) == 3) & (a.isNull() | number(a).isNotNull()) & (b.isNull() | number(b).isNotNull()) & kind_of(c).isNotNull()
        return F.struct(number(a).alias("start_col"), number(b).alias("end_col"), F.coalesce(number(c), F.lit(0).cast("long")).alias("hits"), F.coalesce(good, F.lit(False)).alias("valid"))

    spans = F.transform(F.transform(F.when(slot.startswith("["), slots(slot)), slots) if own is None else own, span)
    found = F.struct(spans.alias("spans"), F.coalesce(F.forall(spans, lambda s: s["valid"]), F.lit(False)).alias("valid"))
    nothing = F.struct(F.lit(None).cast("array<struct<start_col: long, end_col: long, hits: long, valid: boolean>>").alias("spans"), F.lit(True).alias("valid"))
    return F.when(slot.isNull(), nothing).otherwise(found)


def datapoint(parts: Column) -> Column:
    """struct(session_index, labels, valid) of a datapoint's slots as VARIANTs: session, coverage, type, and labels that are strings or numbers."""
    slot = lambda k: slot_of(F.get(parts, k))
    labels = slots_of(F.get(parts, 3))
    number_or_string = lambda x: F.coalesce(x.startswith(MARK) | x.rlike("^[0-9]+$"), F.lit(False))
    good = (F.size(parts) == 4) & number(slot(0)).isNotNull() & kind_of(slot(1)).isNotNull() & coverage_type(slot(2)).isNotNull() & F.forall(labels, number_or_string)
    return F.struct(number(slot(0)).alias("session_index"), labels.alias("labels"), F.coalesce(good, F.lit(False)).alias("valid"))


# --- slots of plain lines ------------------------------------------------------------------------


def rows_of(slot: Column) -> Column:
    """Arrays within an array, each as its slots."""
    return F.from_json(slot, "array<array<string>>")


def plain_coverage(slot: Column) -> Column:
    fraction = slot.contains("/")
    first = F.when(fraction, F.substring_index(slot, "/", 1)).otherwise(slot)
    return F.struct(F.when(fraction, "branches").otherwise("hits").alias("kind"), first.cast("long").alias("a"), F.when(fraction, F.substring_index(slot, "/", -1).cast("long")).alias("b"))


def plain_branches(slot: Column) -> Column:
    format_ = F.when(slot.isNotNull(), "l")
    return F.struct(format_.alias("branch_format"), F.when(slot.isNotNull(), slots(slot)).alias("branches"), F.lit(True).alias("valid"))


def plain_spans(slot: Column) -> Column:
    span = lambda x: F.struct(F.get(x, 0).alias("start_col"), F.get(x, 1).alias("end_col"), F.get(x, 2).alias("hits"), F.lit(True).alias("valid"))
    return F.struct(F.when(slot.isNotNull(), F.transform(F.from_json(slot, "array<array<long>>"), span)).alias("spans"), F.lit(True).alias("valid"))


def plain_complexity(slot: Column) -> Column:
    pair = slot.startswith("[")
    paths = F.when(pair, F.substring_index(F.substring(slot, F.lit(2), F.length(slot)), ",", 1).cast("long"))
    total = F.when(pair, F.rtrim(F.substring_index(slot, ",", -1), F.lit("]"))).otherwise(slot)
    return F.struct(paths.alias("paths"), total.cast("long").alias("total"), F.lit(True).alias("valid"))


def plain_labels(slot: Column) -> Column:
    return F.when(slot.isNotNull(), F.transform(slots(slot), lambda x: F.concat(F.lit(MARK), x)))
