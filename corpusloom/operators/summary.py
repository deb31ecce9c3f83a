"""Aggregates, windows, top-k and set operations on corpus tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.functions import text as T


def values(spark, name: str, items: list[str]) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*map(F.lit, items))).alias(name))


def count_by_status(rows: DataFrame, statuses: list[str], column: str = "index_status") -> DataFrame:
    """(status, n): zero for statuses that don't occur, and TOTAL over all rows."""
    counts = rows.groupBy(F.col(column).alias("status")).agg(F.count(F.lit(1)).alias("n"))
    known = values(rows.sparkSession, "status", statuses)
    each = known.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))
    return each.union(counts.agg(F.lit("TOTAL").alias("status"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")))


def corpus_stats(chunks: DataFrame, approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct("file_id", 0.01) if approximate else F.countDistinct("file_id")
    return chunks.agg(F.count(F.lit(1)).alias("chunks"), distinct.alias("files"))


def index_progress(files: DataFrame) -> DataFrame:
    """Percent indexed, one decimal; 100 for no files."""
    return files.agg(F.coalesce(F.round(100 * F.count_if(F.col("index_status") == "INDEXED") / F.nullif(F.count(F.lit(1)), F.lit(0)), 1), F.lit(100.0)).alias("percent"))


def newest(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    return rows.orderBy(F.desc(order), key).limit(n)


def topic_clusters(insights: DataFrame) -> DataFrame:
    """(topic, file_count, files): files sorted, as text."""
    t = insights.select("file_id", F.explode("topics").alias("topic")).select("file_id", T.topic_key(F.col("topic")).alias("topic")).distinct()
    return t.groupBy("topic").agg(F.count(F.lit(1)).alias("file_count"), F.array_join(F.array_sort(F.collect_list("file_id")), ",").alias("files"))


def dominant_topics(insights: DataFrame, n: int = 10) -> DataFrame:
    t = insights.select("folder_id", F.explode("topics").alias("topic")).groupBy("folder_id", "topic").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(W.partitionBy("folder_id").orderBy(F.desc("n"), "topic"))
    return t.withColumn("rank", rank).filter(F.col("rank") <= n)


def folder_summary(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per folder: files, indexed, failed, waiting, bytes, chunks, tokens, and the distribution of extensions as text."""
    ext = files.groupBy("folder_id", "extension").agg(F.count(F.lit(1)).alias("n"))
    ext = ext.groupBy("folder_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("extension", F.lit("="), F.col("n").cast("string")))), ",").alias("extensions"))
    status = F.col("index_status")
    f = files.groupBy("folder_id").agg(F.count(F.lit(1)).alias("files"), F.count_if(status == "INDEXED").alias("indexed"), F.count_if(status.isin("FAILED", "SKIPPED")).alias("failed"), F.count_if(~status.isin("INDEXED", "FAILED", "SKIPPED", "MISSING")).alias("waiting"), F.sum("size_bytes").alias("bytes"))
    c = chunks.groupBy("folder_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(T.chunk_tokens(F.col("content"))).alias("tokens"))
    return f.join(c, "folder_id", "left").join(ext, "folder_id")


def document_summary(chunks: DataFrame, section: Column, page: Column, cap: int = 20) -> DataFrame:
    """Per file: chunks, tokens, the first `cap` sections in order of appearance, and the first `cap` pages in order."""
    rows = chunks.select("file_id", "chunk_index", section.alias("section"), page.alias("page"), T.chunk_tokens(F.col("content")).alias("tokens"))
    seen = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "section"))), lambda x: x["section"])
    return rows.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("chunks"),
        F.sum("tokens").alias("tokens"),
        F.array_join(F.slice(F.array_distinct(seen), 1, cap), ",").alias("sections"),
        F.array_join(F.slice(F.array_sort(F.collect_set("page")), 1, cap), ",").alias("pages"),
    )


def composite_hash(files: DataFrame, *state: str) -> DataFrame:
    """(folder_id, hash): SHA-256 over the files' states in the order of file_id."""
    line = F.concat_ws(":", "file_id", *[F.col(c).cast("string") for c in state])
    parts = F.transform(F.array_sort(F.collect_list(F.struct("file_id", line.alias("s")))), lambda x: x["s"])
    return files.groupBy("folder_id").agg(F.sha2(F.array_join(parts, ""), 256).alias("hash"))


def inventory(files: DataFrame, top: int = 8) -> DataFrame:
    """(kind, name, n, bytes): one row for all files, one a status, and one for each of the most frequent extensions."""
    g = files.select("extension", "index_status", "size_bytes").groupingSets([["extension"], ["index_status"], []], "extension", "index_status").agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("bytes"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 1, "extension").when(F.col("g") == 2, "status").otherwise("total")
    rank = F.row_number().over(W.partitionBy("kind").orderBy(F.desc("n"), "name"))
    rows = g.select(kind.alias("kind"), F.coalesce("extension", "index_status", F.lit("")).alias("name"), "n", "bytes").withColumn("rank", rank)
    return rows.filter((F.col("kind") != "extension") | (F.col("rank") <= top)).drop("rank")


def chat_overview(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.max_by("text", "turn").alias("last_message"), F.max_by("role", "turn").alias("last_role"))


def extraction_signals(docs: DataFrame) -> DataFrame:
    """Per document: counts and ratios (4 decimals) of characters by kind, words, pages (blocks between blank lines), pages with 30 characters and 5 words."""
    text = F.coalesce("text", F.lit(""))
    count = lambda cls: F.length(text) - F.length(F.regexp_replace(text, cls, ""))
    n = F.length(text)
    counts = {"chars": n, "replacement": count(r"\x{FFFD}"), "control": count(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]"), "whitespace": count(r"[\t\n\r \x{A0}\x{2000}-\x{200A}\x{3000}]")}
    rows = docs.select("doc_id", *[c.alias(k) for k, c in counts.items()], F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))).alias("words"), F.split(text, r"\n\s*\n").alias("blocks"))
    ratio = lambda c: F.round(F.col(c) / F.greatest(F.lit(1), F.col("chars")), 4)
    useful = lambda p: (F.length(T.strip(p)) >= 30) & (F.size(F.regexp_extract_all(p, F.lit(r"\S+"), F.lit(0))) >= 5)
    rows = rows.withColumn("printable", F.col("chars") - F.col("replacement") - F.col("control"))
    return rows.select("doc_id", "chars", "printable", "replacement", "control", "whitespace", "words", F.size("blocks").alias("pages"), F.size(F.filter("blocks", useful)).alias("meaningful"), *[ratio(c).alias(f"{c}_ratio") for c in ("printable", "replacement", "control", "whitespace")])


def quality_gate(signals: DataFrame, images: Column) -> DataFrame:
    """signals with status and reasons: the first rule that holds decides."""
    has, c = images > 0, F.col
    warnings = F.array_compact(
        F.array(
            F.when((c("pages") > 1) & (c("meaningful") > 0) & (c("meaningful") < c("pages")) & has, "PARTIAL_IMAGE_PAGES"),
            F.when((c("chars") >= 30) & (c("replacement_ratio") >= 0.05) & (c("replacement_ratio") < 0.4), "MODERATE_REPLACEMENT_CHARACTERS"),
            F.when((c("chars") >= 30) & (c("control_ratio") > 0.05), "SUSPICIOUS_CONTROL_CHARACTERS"),
            F.when((c("pages") == 1) & (c("chars") >= 1) & (c("chars") < 30) & ~has, "VERY_SHORT_TEXT"),
        )
    )
    ocr = lambda *why: F.struct(F.lit("REQUIRES_OCR").alias("status"), F.array(*map(F.lit, why)).alias("reasons"))
    verdict = (
        F.when((c("chars") == 0) & has, ocr("SCANNED_IMAGE_ONLY", "NO_EXTRACTABLE_TEXT"))
        .when(c("chars") == 0, ocr("NO_EXTRACTABLE_TEXT"))
        .when((c("meaningful") == 0) & (c("chars") / c("pages") < 25) & has, ocr("SCANNED_IMAGE_ONLY", "INSUFFICIENT_EXTRACTABLE_TEXT"))
        .when((c("chars") >= 30) & (c("replacement_ratio") >= 0.4), ocr("CORRUPTED_FONT_ENCODING", "EXCESSIVE_REPLACEMENT_CHARACTERS"))
        .when(F.size(warnings) > 0, F.struct(F.lit("PARSE_WARNING").alias("status"), warnings.alias("reasons")))
        .otherwise(F.struct(F.lit("PARSED").alias("status"), F.array(F.lit("CLEAN_EXTRACTION")).alias("reasons")))
    )
    return signals.withColumn("v", verdict).select(*signals.columns, "v.status", F.array_join("v.reasons", ",").alias("reasons"))


def first_n(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(order))).filter(F.col("place") <= n)


def placed(rows: DataFrame, key: str = "file_id", order: str = "chunk_index") -> DataFrame:
    """rows with place (from 0) and total of their group."""
    w = W.partitionBy(key)
    return rows.withColumn("place", F.row_number().over(w.orderBy(order)) - 1).withColumn("total", F.count(F.lit(1)).over(w))


def strided(rows: DataFrame, n: int) -> DataFrame:
    """n rows of each group at places i * (total // n); all of a group of n or fewer."""
    p = placed(rows)
    step = F.greatest(F.lit(1), F.floor(F.col("total") / n))
    return p.filter((F.col("total") <= n) | (F.col("place") % step == 0) & (F.col("place") / step < n))


def head_mid_tail(rows: DataFrame) -> DataFrame:
    """All of a group of 15 or fewer; else the first five, six around the middle, and the last five."""
    p = placed(rows)
    place, total, mid = F.col("place"), F.col("total"), F.floor(F.col("total") / 2)
    return p.filter((total <= 15) | (place < 5) | (place >= F.greatest(F.lit(0), mid - 3)) & (place < mid + 3) | (place >= total - 5))


def representative_chunks(rows: DataFrame, section: str, heading: str, tokens: str, budget: int = 2500) -> DataFrame:
    """All of a file of ten chunks or fewer; else its first two, the first of each section and heading, and its last two, as far as the budget goes: it stops at the first that would pass it, but keeps one."""
    p = placed(rows)
    nth = lambda c: F.row_number().over(W.partitionBy("file_id", c).orderBy("chunk_index"))
    p = p.withColumn("_s", nth(section)).withColumn("_h", nth(heading))
    wanted = (F.col("place") < 2) | (F.col("place") >= F.col("total") - 2) | F.col(section).isNotNull() & (F.col(section) != "General") & (F.col("_s") == 1) | F.col(heading).isNotNull() & (F.col("_h") == 1)
    order = W.partitionBy("file_id").orderBy("chunk_index").rowsBetween(W.unboundedPreceding, 0)
    small = p.filter((F.col("total") <= 10) | wanted)
    over = small.withColumn("_sum", F.sum(tokens).over(order)).withColumn("_first", F.row_number().over(W.partitionBy("file_id").orderBy("chunk_index")) == 1)
    return over.filter((F.col("total") <= 10) | (F.col("_sum") <= budget) | F.col("_first")).drop("_s", "_h", "_sum", "_first")


def heading_context(elements: DataFrame) -> DataFrame:
    """elements (file_id, elem_idx, level, text; level null for no heading) with the headings they stand under: h1, h2, section. A first-level heading ends the second's reach."""
    w = W.partitionBy("file_id").orderBy("elem_idx").rowsBetween(W.unboundedPreceding, 0)
    e = elements.withColumn("_n", F.count_if(F.col("level") == 1).over(w)).withColumn("h1", F.last(F.when(F.col("level") == 1, F.trim("text")), ignorenulls=True).over(w))
    under = W.partitionBy("file_id", "_n").orderBy("elem_idx").rowsBetween(W.unboundedPreceding, 0)
    e = e.withColumn("h2", F.last(F.when(F.col("level") == 2, F.trim("text")), ignorenulls=True).over(under))
    low = F.last(F.when(F.col("level") > 1, F.trim("text")), ignorenulls=True).over(under)
    return e.withColumn("section", F.when(low.isNull(), F.coalesce("h1", F.lit("General"))).otherwise(F.concat_ws(" > ", "h1", low))).drop("_n")


def latest(rows: DataFrame, key: str, order: str, tie: str) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order), F.desc(tie)))).filter("_r = 1").drop("_r")


def not_superseded(rows: DataFrame, key: str, order: str, tie: str) -> DataFrame:
    """Rows after which nothing was written for their key."""
    return rows.filter("true").withColumn("_next", F.lead(tie).over(W.partitionBy(key).orderBy(order, tie))).filter("_next is null").drop("_next")


def retain_newest(rows: DataFrame, terminal: Column, order: str, tie: str, n: int) -> DataFrame:
    """All rows that aren't terminal, and the newest n that are: the n-th one's order is found first, so no window spans the table."""
    done = rows.filter(terminal)
    kept = done.orderBy(F.desc(order), F.desc(tie)).limit(n)
    return rows.filter(~terminal).unionByName(kept)


def history_window(messages: DataFrame, last: int = 6, most: int = 3000) -> DataFrame:
    """(conv_id, history): of the last messages those that fit, going back until one doesn't; oldest first."""
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), T.strip(F.col("text")))
    m = messages.withColumn("back", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))).filter(F.col("back") <= last)
    m = m.withColumn("line", line).filter(T.strip(F.col("text")) != "")
    w = W.partitionBy("conv_id").orderBy("back").rowsBetween(W.unboundedPreceding, 0)
    m = m.withColumn("used", F.sum(F.length("line")).over(w)).filter(F.col("used") <= most)
    return m.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("history"))


def auto_title(messages: DataFrame, most: int = 40) -> DataFrame:
    first = messages.filter("role = 'user'").groupBy("conv_id").agg(F.min_by(T.strip(F.col("text")), "turn").alias("t"))
    return first.select("conv_id", F.when(F.length("t") > most, F.concat(F.substring("t", 1, most), F.lit("..."))).otherwise(F.col("t")).alias("title"))


def page_of(rows: DataFrame, *order: Column, limit: int = 200, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def representative_files(files: DataFrame, insights: DataFrame, chunks: DataFrame, n: int = 5) -> DataFrame:
    """The n first indexed files of each folder: with an insight first, then by chunks, size and id."""
    c = chunks.groupBy("file_id").agg(F.count(F.lit(1)).alias("chunks"))
    f = files.filter("index_status = 'INDEXED'").join(insights.select("file_id", F.lit(True).alias("ready")).distinct(), "file_id", "left").join(c, "file_id", "left")
    rank = F.row_number().over(W.partitionBy("folder_id").orderBy(F.desc(F.coalesce("ready", F.lit(False))), F.desc(F.coalesce("chunks", F.lit(0))), F.desc("size_bytes"), "file_id"))
    return f.withColumn("rank", rank).filter(F.col("rank") <= n).select("folder_id", "rank", "file_id")


def page_union(pages: DataFrame, key: str, page: str) -> DataFrame:
    """Rows of several pages without repeats of the key: the earlier page wins."""
    return pages.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(page))).filter("_r = 1").drop("_r")
