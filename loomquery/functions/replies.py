"""What models reply and what readers see: parsing of JSON replies, source keys, citations. All are columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as fx
from .text import strip

# Classes of an image, in the order in which a reply is searched for them.
VISION_CLASSES = ("TABLE", "CHART", "INFOGRAPHIC", "DECORATIVE", "OTHER")
USEFUL_CLASSES = ("TABLE", "CHART", "INFOGRAPHIC")


def vision_class(reply: Column) -> Column:
    """The first known class that the reply names; OTHER if it names none."""
    said = F.upper(strip(F.coalesce(reply, F.lit(""))))
    return F.coalesce(*(F.when(F.contains(said, F.lit(c)), F.lit(c)) for c in VISION_CLASSES), F.lit("OTHER"))


def useful(vision: Column, failed: Column) -> Column:
    """Worth a chunk: a class with content, or a failure, which keeps its place."""
    return F.coalesce(failed, F.lit(False)) | F.coalesce(vision.isin(*USEFUL_CLASSES), F.lit(False))


def unfenced(reply: Column) -> Column:
    """A reply without the code fence around it."""
    return F.regexp_replace(F.regexp_replace(strip(reply), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")


def string_list(reply: Column, key: str) -> Column:
    """The strings under a key of a JSON reply: a scalar becomes a list of one; null, blank or a missing key gives an empty list."""
    value = F.try_variant_get(F.try_parse_json(unfenced(reply)), f"$.{key}", "variant")
    kind = F.schema_of_variant(value)
    many = F.transform(F.try_variant_get(value, "$", "array<string>"), lambda x: strip(x))
    one = F.array(strip(F.try_variant_get(value, "$", "string")))
    found = F.when(kind.startswith("ARRAY"), many).when(~kind.startswith("OBJECT"), one)
    return F.coalesce(F.filter(found, lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def filename(name: Column) -> Column:
    """Lower case, without blanks around it, and with one .pdf where there are several."""
    return F.regexp_replace(F.lower(strip(name)), r"(?:\.pdf)+$", ".pdf")


def source_key(kind: Column, document: Column, workflow: Column) -> Column:
    """(kind, id) that expected and retrieved sources share; null for a kind without one."""
    return F.when(kind == "pdf", F.struct(kind.alias("kind"), filename(document).alias("id"))).when(kind == "workflow", F.struct(kind.alias("kind"), workflow.alias("id")))


def page_label(start: Column, end: Column) -> Column:
    """pp. a-b, p. a, or p. ? where no page is known."""
    return F.when(start.isNull(), "p. ?").when(end.isNotNull() & (end != start), F.concat(F.lit("pp. "), start.cast("string"), F.lit("-"), end.cast("string"))).otherwise(F.concat(F.lit("p. "), start.cast("string")))


def fill(template: Column | str, **values: Column) -> Column:
    """A template with {name} replaced literally."""
    out = F.lit(template) if isinstance(template, str) else template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


def key_list(raw: Column) -> Column:
    """A comma-separated list without blanks and blank items."""
    return F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), ","), strip), lambda x: x != "")


def source_sets(a: Column, b: Column) -> Column:
    """(n_union, n_both) of two arrays of ids."""
    return F.struct(F.size(F.array_union(a, b)).alias("n_union"), F.size(F.array_intersect(a, b)).alias("n_both"))


def label(attribute: str, value: Column) -> Column:
    """What a reader sees for a value of an attribute; null where nothing is shown."""
    known = F.create_map(*(F.lit(x) for pair in fx.LABELS[attribute].items() for x in pair))
    name = fx.LABEL_NAMES.get(attribute)
    other = F.concat(F.lit(f"{name}: "), value) if name else value if attribute == "interests" else F.lit(None).cast("string")
    return F.coalesce(F.try_element_at(known, value), other)


def provided_labels(**values: Column) -> Column:
    """Labels of known attributes in their fixed order; unknown ones are left out. interests is an array, the others are strings."""
    parts = []
    for a in fx.KNOWN_ORDER:
        if a not in values:
            continue
        parts.append(F.transform(values[a], lambda v: label("interests", v)) if a == "interests" else F.array(F.when(values[a] != "unknown", label(a, values[a]))))
    return F.array_compact(F.concat(*parts))


def missing_labels(items: Column) -> Column:
    """Of the first six lines "attribute: reason" the reasons; a line without a colon stays."""
    return F.transform(F.slice(items, 1, fx.MAX_MISSING), lambda s: F.when(F.contains(s, F.lit(":")), strip(F.regexp_replace(s, r"(?s)^[^:]*:", ""))).otherwise(s))


def shown_benefits(items: Column) -> Column:
    """As many of a scheme's benefits as a reader is shown."""
    return F.slice(items, 1, fx.MAX_BENEFITS)


def citation_line(idx: Column, scheme: Column, name: Column, start: Column, end: Column, ocr: Column) -> Column:
    """A source below an answer: number, scheme, file, pages, and a badge for scanned text."""
    return F.concat(idx.cast("string"), F.lit(". "), scheme, F.lit(" — "), name, F.lit(" · "), page_label(start, end), F.when(F.coalesce(ocr, F.lit(False)), " · OCR").otherwise(""))


#: Fields of a citation; those of images are always empty.
CITATION = ("chunk_id", "scheme", "source_filename", "source_type", "page_start", "page_end", "is_ocr_source", "parent_subfolder")


def citation(columns: list[str]) -> Column:
    """The citation of a chunk with these columns as a struct; a field that it lacks is null."""
    kinds = {"page_start": "int", "page_end": "int", "is_ocr_source": "boolean"}
    field = lambda c: (F.col(c) if c in columns else F.lit(None)).cast(kinds.get(c, "string")).alias(c)
    return F.struct(*map(field, CITATION), F.lit(None).cast("string").alias("vision_content_type"), F.lit(False).alias("vision_failed"))


def distinct_in_order(keys: Column) -> Column:
    """Each key once, where it first stands."""
    return F.array_distinct(keys)


def utc_now() -> Column:
    """The time in UTC to the second, as ISO 8601."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def batches(items: Column, size: int) -> Column:
    """An array cut into arrays of ``size`` items, the last one shorter."""
    if size <= 0:
        raise ValueError(f"batch size must be positive, got {size}")
    last = F.greatest(F.ceil(F.size(items) / size).cast("int") - 1, F.lit(0))
    return F.filter(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(items, i * size + 1, F.lit(size))), lambda b: F.size(b) > 0)
