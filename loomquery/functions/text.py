"""Text expressions: tokens, guardrails, attributes. All are columns; nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed as fx


def tokens(text: Column) -> Column:
    """Lower-cased words, repeated ones included."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(fx.TOKEN), F.lit(0))


def strip(text: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


#: White space, digits and letters of a pattern as Unicode has them; Java's own classes know ASCII alone, or count marks as letters.
SPACE, DIGIT, LETTER = r"\t-\r\x1c-\x20\x85\p{Z}", r"\p{Nd}", r"\p{L}\p{N}_"


def unicode_aware(pattern: str) -> str:
    """A pattern with \\s, \\d and \\b in the sense of Unicode, for Java."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(SPACE if inside else f"[{SPACE}]")
        elif two == r"\d":
            out.append(DIGIT)
        elif two == r"\b" and not inside:
            out.append(f"(?:(?<=[{LETTER}])(?![{LETTER}])|(?<![{LETTER}])(?=[{LETTER}]))")
        elif two[0] == "\\":
            out.append(two)
        else:
            inside = two[0] == "[" or (inside and two[0] != "]")
            out.append(two[0])
            i -= 1
        i += 2
    return "".join(out)


INJECTION = tuple((name, "(?iu)" + unicode_aware(p)) for name, p in fx.INJECTION)


def injection_name(text: Column) -> Column:
    """Name of the first injection pattern that the text matches; null if none."""
    return F.coalesce(*(F.when(text.rlike(p), F.lit(name)) for name, p in INJECTION))


def injection_span(text: Column) -> Column:
    """What the first injection pattern matches first, with up to 20 characters on either side, cut at 200; null if none matches."""
    cases = []
    for _, p in INJECTION:
        hit = F.regexp_extract(text, p, 0)
        before = F.length(F.regexp_extract(text, rf"^([\s\S]*?){p}", 1))
        start = F.greatest(before - 20, F.lit(0))
        cases.append(F.when(text.rlike(p), F.substring(F.substring(text, start + 1, before - start + F.length(hit) + 20), 1, 200)))
    return F.coalesce(*cases)


def validation_reason(query: Column) -> Column:
    """valid, or the first rule that the query breaks."""
    q = strip(query)
    return (
        F.when(query.isNull(), "empty").when(query.rlike(fx.CONTROL), "control_chars").when(q == "", "empty").when(F.length(q) > fx.MAX_QUERY_CHARS, "too_long")
        .when(F.length(q) < fx.MIN_QUERY_CHARS, "too_short").when(injection_name(q).isNotNull(), "prompt_injection").otherwise("valid")
    )


PII = tuple((name, unicode_aware(p), test) for name, p, test in (("email", fx.EMAIL, "@"), ("aadhaar", fx.AADHAAR, None), ("phone", fx.PHONE, None)))


def scrub(text: Column) -> tuple[Column, Column]:
    """(redacted text, kinds found); each kind is looked for in what the ones before left. For short texts; ``scrub_rows`` does whole tables."""
    kinds, out = [], text
    for name, pattern, _ in PII:
        kinds.append(F.when(out.rlike(pattern), F.lit(name)))
        out = F.regexp_replace(out, pattern, f"[REDACTED_{name.upper()}]")
    return out, F.array_compact(F.array(*kinds))


def scrub_rows(rows: DataFrame, text: str, kinds: str = "pii_kinds") -> DataFrame:
    """rows with the column ``text`` redacted and the kinds found in ``kinds``. Each kind is a step of its own over what the ones before left, and only texts that a cheap test lets through are searched."""
    flags = []
    for name, pattern, test in PII:
        flag = f"_has_{name}"
        may = F.contains(text, F.lit(test)) if test else F.col(text).rlike(DIGIT)
        rows = rows.withColumn(flag, F.coalesce(may & F.col(text).rlike(pattern), F.lit(False)))
        rows = rows.withColumn(text, F.when(F.col(flag), F.regexp_replace(text, pattern, f"[REDACTED_{name.upper()}]")).otherwise(F.col(text)))
        flags.append(flag)
    found = F.array_compact(F.array(*(F.when(F.col(flag), F.lit(name)) for flag, (name, *_) in zip(flags, PII, strict=True))))
    return rows.withColumn(kinds, found).drop(*flags)


def is_refusal(answer: Column) -> Column:
    low = F.lower(answer)
    found = F.lit(False)
    for p in fx.REFUSALS:
        found = found | F.contains(low, F.lit(p))
    return F.coalesce(found, F.lit(False)).cast("double")


def title(query: Column, width: int = 48) -> Column:
    """A conversation's title: the query on one line, cut at a word."""
    q = F.replace(strip(query), F.lit("\n"), F.lit(" "))
    head = F.substring(q, 1, width)
    cut = F.regexp_replace(head, " [^ ]*$", "")
    return F.when(q == "", "New chat").when(F.length(q) <= width, q).otherwise(F.concat(F.when(cut == "", head).otherwise(cut), F.lit("…")))


def first_keyword(low: Column, table: tuple[tuple[str, str], ...]) -> Column:
    return F.coalesce(*(F.when(F.contains(low, F.lit(k)), F.lit(v)) for k, v in table), F.lit("unknown"))


def first_pattern(text: Column, table: tuple[tuple[str, str], ...]) -> Column:
    return F.coalesce(*(F.when(text.rlike(f"(?i){p}"), F.lit(v)) for v, p in table), F.lit("unknown"))


def interests(low: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(F.contains(low, F.lit(k)), F.lit(v)) for k, v in fx.INTERESTS)))))


def land_holding(low: Column) -> Column:
    """A number with a unit decides before a named size does."""
    number = F.try_to_number(F.regexp_extract(low, fx.LAND_NUMBER, 1), F.lit("999999999999.999999")).cast("double")
    number = F.coalesce(number, F.regexp_extract(low, fx.LAND_NUMBER, 1).try_cast("double"))
    unit, hectares = F.regexp_extract(low, fx.LAND_NUMBER, 2), number
    for name, per in fx.LAND_UNITS:
        hectares = F.when(unit.startswith(name), number / per).otherwise(hectares)
    named = F.lit("large")
    for bound, name in reversed(fx.LAND_BOUNDS):
        named = F.when(hectares < bound, name).otherwise(named)
    return F.when(hectares.isNotNull(), named).otherwise(first_keyword(low, fx.LAND_WORDS))


def asks_for_schemes(query: Column) -> Column:
    return F.coalesce(query.rlike("(?i)" + "|".join(fx.INTENT)), F.lit(False))
