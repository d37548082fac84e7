"""Documents to citable chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as fx
from ..functions.text import strip


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


def stem(filename: Column) -> Column:
    return F.regexp_replace(filename, r"\.[^.]*$", "")


def windows(docs: DataFrame, text: str = "text", size: int = fx.CHUNK_SIZE, overlap: int = fx.CHUNK_OVERLAP) -> DataFrame:
    """Sliding windows of characters: idx, start, end, chunk beside the columns of docs. An empty or null text has none.

    The text is cut once into pieces of a step each, and a window is its piece and the beginning of those that follow: the work grows with the text's length, not its square.
    """
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap in [0, size)")
    step, pieces, length, window = size - overlap, *(free_name(docs, x) for x in ("_pieces", "_length", "_window"))
    n, more = F.col(length), -(-overlap // step)
    # Columns of their own: inside the lambda below they would be computed for each window.
    cut = docs.withColumn(pieces, F.regexp_extract_all(F.col(text), F.lit(rf"[\s\S]{{1,{step}}}"), F.lit(0))).withColumn(length, F.length(text))
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")
    at = lambda i, j: F.coalesce(F.get(F.col(pieces), i + j), F.lit(""))
    tail = lambda i: F.substring(F.concat(*(at(i, j) for j in range(1, more + 1))), 1, overlap) if overlap else F.lit("")
    made = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("idx"), (i * step).alias("start"), F.least(i * step + size, n).alias("end"), F.concat(at(i, 0), tail(i)).alias("chunk")))
    return cut.where(n > 0).withColumn(window, F.explode(made)).select(*(F.col(f"`{c}`") for c in docs.columns), F.col(f"{window}.*"))


def joined_pages(pages: DataFrame) -> DataFrame:
    """doc, blob, offsets from (doc, page, text): pages behind markers; an offset is where a page's text begins."""
    marked = pages.select("doc", "page", F.concat(F.lit("\n\n[PAGE "), F.col("page").cast("string"), F.lit("]\n\n")).alias("m"), F.coalesce("text", F.lit("")).alias("t"))
    before = F.sum(F.length("m") + F.length("t")).over(Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    placed = marked.withColumn("at", (F.coalesce(before, F.lit(0)) + F.length("m")).cast("int"))
    rows = F.array_sort(F.collect_list(F.struct("page", "at", F.concat("m", "t").alias("part"))))
    g = placed.groupBy("doc").agg(rows.alias("p"))
    return g.select("doc", F.array_join(F.transform("p", lambda x: x["part"]), "").alias("blob"), F.transform("p", lambda x: F.struct(x["page"].alias("page"), x["at"].alias("at"))).alias("offsets"))


def window_pages(joined: DataFrame, size: int = fx.CHUNK_SIZE, overlap: int = fx.CHUNK_OVERLAP) -> DataFrame:
    """joined_pages with ``starts`` and ``ends``: the first and last page of each window of the blob, in one walk over the pages.

    The first page is the last one that begins at or before the window's start, the last page the last one before its end; the document's first page where there is none.
    """
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - size) / step)).cast("int")

    def spread(first_window, pages: str) -> Column:
        """A page for each window: page j holds the windows from its first one up to the next page's first one."""
        upto = lambda j: F.coalesce(first_window(F.get(F.col(pages), j + 1)), F.col("last") + 1)
        held = lambda o, j: F.when(j == 0, F.lit(0)).otherwise(F.greatest(first_window(o), F.lit(0)))
        own = lambda o, j: F.greatest(F.least(F.greatest(upto(j), F.lit(0)), F.col("last") + 1) - held(o, j), F.lit(0))
        return F.flatten(F.transform(pages, lambda o, j: F.array_repeat(o["page"], own(o, j).cast("int"))))

    # A page that begins at the very end of the text holds no window's end. Each step is a column of its own, so that no lambda computes it again.
    counted = joined.withColumn("n", F.length("blob"))
    counted = counted.withColumn("last", last).withColumn("inside", F.filter("offsets", lambda o, j: (j == 0) | (o["at"] < F.col("n"))))
    starts = spread(lambda o: F.ceil(o["at"] / step).cast("int"), "offsets")
    ends = spread(lambda o: F.floor((o["at"] - size) / step).cast("int") + 1, "inside")
    return counted.withColumn("starts", starts).withColumn("ends", ends).drop("n", "last", "inside")


def page_chunks(pages: DataFrame) -> DataFrame:
    """doc, idx, page_start, page_end, chunk."""
    w = windows(window_pages(joined_pages(pages)).drop("offsets"), "blob")
    return w.select("doc", "idx", F.get("starts", F.col("idx")).alias("page_start"), F.get("ends", F.col("idx")).alias("page_end"), "chunk")


def chunk_id(scheme: Column, subfolder: Column, filename: Column, kind: str, idx: Column) -> Column:
    return F.concat_ws("_", scheme, subfolder, stem(filename), F.format_string(f"{kind}%04d", idx))


def workflow_chunk_id(scheme: Column, workflow: Column) -> Column:
    return F.concat(scheme, F.lit("_wf_"), workflow.cast("string"))


def workflow_text(steps: DataFrame) -> DataFrame:
    """workflow, text from (workflow, title, scheme, url, pos, step_no, instruction, input_required, condition, extras map)."""
    line = lambda label, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(label), F.col(c))).otherwise("")
    extras = F.array_join(F.transform(F.map_entries(F.map_filter("extras", lambda k, v: (k != "") & (v != ""))), lambda e: F.concat(F.lit("\n  "), e["key"], F.lit(": "), e["value"])), "")
    block = F.concat(F.lit("\nStep "), "step_no", F.lit(": "), "instruction", line("\n  Input required: ", "input_required"), line("\n  Condition: ", "condition"), extras)
    g = steps.groupBy("workflow").agg(F.first("title").alias("title"), F.first("scheme").alias("scheme"), F.first("url").alias("url"), F.array_sort(F.collect_list(F.struct("pos", block.alias("b")))).alias("s"))
    head = F.concat(F.lit("Workflow: "), F.coalesce(F.nullif("title", F.lit("")), "workflow"), F.lit(" ("), "workflow", F.lit(")\nScheme: "), "scheme", F.lit("\n"), line("Source: ", "url"), F.when(F.coalesce("url", F.lit("")) != "", "\n").otherwise(""))
    return g.select("workflow", F.concat(head, F.array_join(F.transform("s", lambda x: x["b"]), "")).alias("text"))


def pipe_table(rows: Column) -> Column:
    """An array of arrays of cells as a pipe table between markers; a separator follows the first of several rows."""
    cell = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "\n", " "), r"(?U)^\s+|\s+$", "")
    lines = F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, cell), " | "), F.lit(" |")))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(F.element_at(rows, 1), lambda c: F.lit("---")), " | "), F.lit(" |"))
    body = F.when(F.size(rows) > 1, F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.size(rows)))).otherwise(lines)
    return F.array_join(F.concat(F.array(F.lit("[TABLE]")), body, F.array(F.lit("[/TABLE]"))), "\n")


def outside_tables(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Text blocks whose centre lies in no table of their page: (doc, page, x0, y0, x1, y1) on either side."""
    b, t = blocks.alias("b"), tables.alias("t")
    x, y = (F.col("b.x0") + F.col("b.x1")) / 2, (F.col("b.y0") + F.col("b.y1")) / 2
    return b.join(t, (F.col("b.doc") == F.col("t.doc")) & (F.col("b.page") == F.col("t.page")) & x.between(F.col("t.x0"), F.col("t.x1")) & y.between(F.col("t.y0"), F.col("t.y1")), "left_anti")


def chunk_summary(chunks: DataFrame, by: str = "scheme") -> DataFrame:
    """Counts and lengths of (scheme, chunk); suspicious chunks are shorter than half a window."""
    n = F.length("chunk")
    return chunks.groupBy(by).agg(F.count("*").alias("n_chunks"), F.round(F.avg(n), 1).alias("avg_length"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.count_if(n < fx.CHUNK_SIZE // 2).alias("suspicious"))


def document_summary(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """scheme, n_docs, n_chunks, zero_chunk_docs from documents (doc, scheme) and chunks (doc, ...)."""
    n = docs.select("doc", "scheme").join(chunks.groupBy("doc").agg(F.count("*").alias("n")), "doc", "left")
    return n.groupBy("scheme").agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_chunks"), F.count_if(F.col("n").isNull()).alias("zero_chunk_docs"))


def zero_chunk_documents(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """The documents that gave no chunk."""
    return docs.join(chunks.select("doc").distinct(), "doc", "left_anti")


def table_summary(chunks: DataFrame, long: int = fx.LONG_TABLE) -> DataFrame:
    """One row over structured chunks: tables, their average and largest length, and how many are long."""
    n = F.length("chunk")
    return chunks.where("kind = 'tbl'").agg(F.count("*").alias("n_tables"), F.coalesce(F.round(F.avg(n), 1), F.lit(0.0)).alias("avg_length"), F.coalesce(F.max(n), F.lit(0)).alias("max_length"), F.count_if(n > long).alias("n_long"))


def image_chunk_id(scheme: Column, subfolder: Column, filename: Column, page: Column, xref: Column, content_hash: Column) -> Column:
    """Runs of characters other than letters, digits, dot, underscore and hyphen become one underscore, anywhere in the id."""
    place = F.concat(F.format_string("img_p%04d", page), F.lit("_x"), xref.cast("string"), F.lit("_h"), F.substring(content_hash, 1, 8))
    return F.regexp_replace(F.concat_ws("_", scheme, F.nullif(subfolder, F.lit("")), stem(filename), place), "[^A-Za-z0-9._-]+", "_")


def image_text(classification: Column, fields: list[tuple[str, Column]]) -> Column:
    """Body of an image chunk: string fields as lines, arrays as bullets, blank ones left out. fields: (key, string or array column), in order."""
    parts: list[Column] = [F.lit("[IMAGE]"), F.concat(F.lit("classification: "), classification)]
    trim = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    for key, value, many in ((k, v, str(k) not in ("description", "visible_text")) for k, v in fields):
        if many:
            items = F.filter(F.transform(value, trim), lambda x: x != "")
            parts.append(F.when(F.size(value) > 0, F.array_join(F.concat(F.array(F.lit(f"{key}:")), F.transform(items, lambda x: F.concat(F.lit("  - "), x))), "\n")))
        else:
            parts.append(F.when(trim(value) != "", F.concat(F.lit(f"{key}: "), trim(value))))
    return F.concat_ws("\n", *parts, F.lit("[/IMAGE]"))


def structured_chunks(blocks: DataFrame, tables: DataFrame, raw_pages: DataFrame | None = None, unopened: DataFrame | None = None) -> DataFrame:
    """doc, kind, idx, page_start, page_end, chunk from layout: each table whole (kind tbl), the other text in windows (kind c).

    blocks: (doc, page, pos, x0, x1, y0, y1, text, block_type), of which type 0 or null is text; tables: (doc, page, pos, x0, x1, y0, y1, rows).
    A table without rows, or with null for rows that couldn't be read, counts as none, and its text stays with the page. Where layout failed,
    raw_pages (doc, page, text) has the page's text, and unopened (doc, page, text) all pages of a document; those are cut without layout.
    A page without text besides tables has no marker.
    """
    read = tables.where(F.size("rows") > 0)
    numbered = read.withColumn("idx", F.row_number().over(Window.partitionBy("doc").orderBy("page", "pos")) - 1)
    whole = numbered.select("doc", F.lit("tbl").alias("kind"), "idx", F.col("page").alias("page_start"), F.col("page").alias("page_end"), pipe_table(F.col("rows")).alias("chunk"))
    text = outside_tables(blocks.where((F.coalesce("block_type", F.lit(0)) == 0) & (strip(F.col("text")) != "")), read)
    lines = text.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("b"))
    pages = lines.select("doc", "page", strip(F.array_join(F.transform("b", lambda x: x["text"]), "\n")).alias("text"))
    if raw_pages is not None:
        pages = pages.unionByName(raw_pages.select("doc", "page", strip(F.col("text")).alias("text")))
    pages = pages.where("text <> ''")
    if unopened is not None:
        has_text = unopened.groupBy("doc").agg(F.sum(F.length("text")).alias("n")).where("n > 0").select("doc")
        pages = pages.unionByName(unopened.join(has_text, "doc", "left_semi").select("doc", "page", "text"))
    return whole.unionByName(page_chunks(pages).select("doc", F.lit("c").alias("kind"), "idx", "page_start", "page_end", "chunk"))


def structure_summary(chunks: DataFrame, unopened: DataFrame | None = None) -> DataFrame:
    """doc, tables_detected, text_windows, fallback (open_failed or null) of structured_chunks."""
    n = chunks.groupBy("doc").agg(F.count_if(F.col("kind") == "tbl").alias("tables_detected"), F.count_if(F.col("kind") == "c").alias("text_windows"))
    if unopened is None:
        return n.withColumn("fallback", F.lit(None).cast("string"))
    lost = unopened.select("doc").distinct().withColumn("fallback", F.lit("open_failed"))
    return n.join(lost, "doc", "full").na.fill(0, ["tables_detected", "text_windows"])
