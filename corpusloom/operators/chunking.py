"""Elements to chunks that keep their place in the source."""

from __future__ import annotations

from collections import namedtuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Y
from pyspark.sql import Window as W

from corpusloom.functions import text as T
from corpusloom.operators.summary import heading_context

TARGET, MOST, OVERLAP = 1500, 3000, 150
FOLDED = "file_id string, segment int, part int, h1 string, h2 string, section string, text string, type string, line_start int, line_end int, elements int"
#: Rows of a batch that a task has as Python objects together: they bound its memory, however many rows a batch has.
TABLES_AT_ONCE, ELEMENTS_AT_ONCE = 50, 500


def split_table(text: str, most: int = MOST, target: int = TARGET) -> list[str]:
    """A Markdown table as slices of about target characters, each with its header."""
    lines = text.strip().split("\n")
    if len(text) <= most or len(lines) < 3:
        return [text]
    head, slices, size = lines[:2], [[]], 0
    for row in lines[2:]:
        if slices[-1] and size + len(row) > target:
            slices.append([])
            size = 0
        slices[-1].append(row)
        size += len(row) + 1
    return ["\n".join(head + s) for s in slices]


def split_tables(elements: DataFrame, most: int = MOST, target: int = TARGET) -> DataFrame:
    """elements with tables of more than `most` characters replaced by slices, numbered by part (from 0)."""

    names = [c for c in elements.columns if c != "text"]
    table = F.col("type") == "TABLE"
    kinds = Y.StructType([*[elements.schema[c] for c in names], Y.StructField("part", Y.IntegerType()), Y.StructField("text", Y.StringType())])
    sliced = elements.filter(table & (F.length("text") > most)).select(*names, "text").mapInArrow(_cut(most, target), kinds)
    return elements.filter(~table | (F.length("text") <= most)).withColumn("part", F.lit(0)).select(*names, "part", "text").unionByName(sliced)


def _cut(most: int, target: int):
    """Rows with their tables cut: text, the last column, is replaced by part and text."""

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, TABLES_AT_ONCE):
                batch = whole.slice(at, TABLES_AT_ONCE)
                each = [(row, part, piece) for row, text in enumerate(batch.column("text").to_pylist()) for part, piece in enumerate(split_table(text, most, target))]
                row, part, text = (pa.array(x, kind) for x, kind in zip(zip(*each, strict=True), (pa.int64(), pa.int32(), pa.string()), strict=True))
                names = batch.schema.names[:-1]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(row) for c in names], part, text], [*names, "part", "text"])

    return run


def _fold(target: int, most: int, overlap: int):
    """Folds sorted rows: a new (file, segment) begins where the key changes; only one segment is held."""

    def chunk(held: list, part: int) -> tuple | None:
        texts = [e.text for e in held if e.text.strip()]
        if not texts:
            return None
        kinds, first = {e.type for e in held}, held[0]
        kind = next((k for t, k in (("TABLE", "table"), ("CODE_BLOCK", "code"), ("TRANSCRIPT_SEGMENT", "transcript"), ("IMAGE_CAPTION", "visual"), ("VISUAL_METADATA", "visual")) if t in kinds), "text")
        return (first.file_id, first.segment, part, first.h1, first.h2, first.section, "\n\n".join(texts).strip(), kind, min(e.line_start for e in held), max(e.line_end for e in held), len(held))

    def tail(held: list) -> list:
        kept: list = []
        for e in reversed(held[1:]):  # never the whole chunk again
            if e.type in ("HEADING", "TABLE") or kept and sum(len(x.text) for x in kept) + len(e.text) > overlap:
                break
            kept.insert(0, e)
        return kept

    def run(batches):
        held, size, part, key = [], 0, 0, None
        for whole in batches:
            element = namedtuple("Element", whole.schema.names)
            for at in range(0, whole.num_rows, ELEMENTS_AT_ONCE):
                rows = []
                for e in map(element, *(c.to_pylist() for c in whole.slice(at, ELEMENTS_AT_ONCE).columns)):
                    fresh = (e.file_id, e.segment) != key
                    if held and (fresh or size + len(e.text) > most or size >= target):
                        if done := chunk(held, part):
                            rows.append(done)
                            part += 1
                        held = tail(held) if done and overlap > 0 and not fresh else []
                        size = sum(len(x.text) for x in held)
                    if fresh:
                        key, part = (e.file_id, e.segment), 0
                    held.append(e)
                    size += len(e.text)
                yield _chunk_batch(rows)
        last = chunk(held, part) if held else None
        yield _chunk_batch([last] if last else [])

    return run


def _chunk_batch(rows: list[tuple]):
    import pyarrow as pa

    fields = [c.split() for c in FOLDED.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if kind == "int" else pa.string()) for c, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def chunk_documents(elements: DataFrame, *, target: int = TARGET, most: int = MOST, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of elements (file_id, elem_idx, type, level, text, line_start, line_end).

    Headings and tables break hard: a heading begins a segment, a table (cut if long) is one of its own. Within a segment a chunk ends
    when the next element would pass `most` or it has `target` characters; up to `overlap` characters of its last elements begin the
    next. A paragraph is never cut. The fold reads sorted rows and holds one segment.
    """
    e = heading_context(elements.select("file_id", "elem_idx", "type", "level", "text", "line_start", "line_end"))
    e = split_tables(e, most, target).withColumnRenamed("part", "piece")
    order = W.partitionBy("file_id").orderBy("elem_idx", "piece")
    table, heading = F.col("type") == "TABLE", F.col("type") == "HEADING"
    spoken = F.col("type").isin("TRANSCRIPT_SEGMENT", "IMAGE_CAPTION")
    hard = heading | table | F.coalesce(F.lag(table).over(order), F.lit(False)) | spoken | F.coalesce(F.lag(spoken).over(order), F.lit(False))
    e = e.withColumn("hard", hard).withColumn("segment", F.count_if("hard").over(order.rowsBetween(W.unboundedPreceding, 0)).cast("int"))
    folded = e.select("file_id", "segment", "elem_idx", "piece", "type", "text", "h1", "h2", "section", "line_start", "line_end")
    c = folded.repartition("file_id", "segment").sortWithinPartitions("file_id", "segment", "elem_idx", "piece").mapInArrow(_fold(target, most, overlap), FOLDED)
    c = c.withColumn("chunk_index", F.row_number().over(W.partitionBy("file_id").orderBy("segment", "part")) - 1)
    c = c.withColumn("content_hash", T.content_hash(F.col("text")))
    return c.select("file_id", "chunk_index", T.chunk_id(F.col("file_id"), F.col("h1"), F.col("h2"), F.col("chunk_index"), F.col("content_hash")).alias("chunk_id"), "h1", "h2", "section", F.col("text").alias("content"), F.col("type").alias("content_type"), "content_hash", T.chunk_tokens(F.col("text")).alias("token_count"), "line_start", "line_end", "elements")
