"""Line dedup on range-partitioned line hashes, in DataFrame operations only.

Lines long enough become rows (hash, document, position), written once. They are range-partitioned by hash and sorted by
hash, document (the largest first) and position, and each line's rows are streamed in that order by window functions,
which need this sort and so keep it: the first row of a stream names the document that keeps the line, each document's
first occurrence counts it. A line of a large part of all rows is dealt by document over as many streams as its count
asks for, and the streams' counts and keepers are put together. The lost positions of each document go back to it as a
compressed bitmap; texts take no part until a bitmap is applied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm.shared import ROWS, hot_keys, materialise, row_key

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def line_rows(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """Rows (h, g, doc, row, pos): two 64-bit hashes of the key of each line that is long enough, and its place."""
    each = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("doc"), row_key(id_col, text_col).alias("row"), F.posexplode(F.transform(lines_of(F.col(text_col)), line_key)).alias("pos", "key")
    )
    return each.where(F.length("key") >= min_chars).select(F.xxhash64("key").alias("h"), F.xxhash64(F.lit(min_chars), F.reverse("key")).alias("g"), "doc", "row", "pos")


def streamed(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Adds salts (of a hot line, else null), first (the row begins its stream), docs and keeper (of the stream)."""
    bucket = F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64("doc"), F.col("_salts"))).otherwise(F.lit(0)).cast("int")
    dealt = rows.join(F.broadcast(hot), ["h", "g"], "left").withColumn("bucket", bucket)
    ranged = dealt.repartitionByRange("h", "g", "bucket").sortWithinPartitions("h", "g", "bucket", F.desc("doc"), "pos")
    stream = Window.partitionBy("h", "g", "bucket").orderBy(F.desc("doc"), "pos")
    whole = stream.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    prior = F.lag("doc").over(stream)
    marked = ranged.withColumns({"first": prior.isNull(), "occurs": (prior.isNull() | (prior != F.col("doc"))).cast("int"), "keeper": F.first("doc").over(whole)})
    return marked.withColumn("docs", F.sum("occurs").over(whole)).withColumnRenamed("_salts", "salts").drop("bucket", "occurs")


def lost_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, spread: int = ROWS) -> DataFrame:
    """Rows (doc, row, pos): the positions from 0 of the lines that documents lose; row is row_key(id, text).

    A line is lost if its key has min_chars code points or more, occurs in min_docs documents or more and the document
    isn't the one of the largest id that holds it. Rows that repeat an id count as one document, and each loses its own
    lines. Rows without an id hold no line and lose none; an empty table has no lines. Keys are compared by two 64-bit
    hashes. Lines of more than ``spread`` rows (more in large tables) are streamed in several parts.
    """
    rows = materialise(line_rows(docs, id_col, text_col, min_chars))
    hot, _ = hot_keys(rows, ["h", "g"], spread)
    # one stream decides its own line; those of a hot line are put together first
    mine = F.col("salts").isNotNull() | ((F.col("docs") >= min_docs) & (F.col("doc") < F.col("keeper")))
    found = materialise(streamed(rows, hot).where(mine), rows)
    split = found.where("salts is not null")
    totals = split.where("first").groupBy("h", "g").agg(F.sum("docs").alias("n"), F.max("keeper").alias("last")).where(F.col("n") >= min_docs)
    apart = split.join(F.broadcast(totals), ["h", "g"]).where("doc < last")
    return found.where("salts is null").select("doc", "row", "pos").unionByName(apart.select("doc", "row", "pos"))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, spread: int = ROWS) -> DataFrame:
    """Rows (doc, row, bitmap, runs) for documents that lose lines; those missing here keep all.

    The bitmap is compressed to its runs: an array of the lengths of kept and lost runs in turn, kept first (0 if the
    first line is lost); lines after the last run are kept. ``runs`` has the same lost runs as (start, n).
    """
    lost = lost_lines(docs, id_col, text_col, min_chars, min_docs, spread)
    order = Window.partitionBy("doc", "row").orderBy("pos")
    # rows with equal id and text have equal lines: their positions are one
    once = lost.withColumn("_prior", F.lag("pos").over(order)).where("_prior is null or _prior <> pos").drop("_prior")
    run = once.withColumn("_run", F.col("pos") - F.row_number().over(order)).groupBy("doc", "row", "_run").agg(F.min("pos").alias("start"), F.count("*").cast("int").alias("n"))
    runs = run.groupBy("doc", "row").agg(F.array_sort(F.collect_list(F.struct("start", "n"))).alias("runs"))
    before = lambda i: F.when(i > 0, F.get("runs", i - 1)["start"] + F.get("runs", i - 1)["n"]).otherwise(0)
    bitmap = F.flatten(F.transform("runs", lambda r, i: F.array(r["start"] - before(i), r["n"])))
    return runs.select("doc", "row", bitmap.alias("bitmap"), "runs")


def lost_positions(bitmap: Column) -> Column:
    """The positions that one bitmap of keep_bitmaps() loses, for a reader of few; dedup itself works on the runs."""
    ends = F.transform(bitmap, lambda x, i: F.struct(i.alias("i"), F.aggregate(F.slice(bitmap, 1, i + 1), F.lit(0), lambda a, y: a + y).alias("end"), x.alias("n")))
    return F.flatten(F.transform(F.filter(ends, lambda r: r["i"] % 2 == 1), lambda r: F.sequence(r["end"] - r["n"], r["end"] - 1)))


def _kept(text: Column, runs: Column) -> Column:
    """The text's lines but those of the runs, which are in order: slices between the runs, joined."""

    def cut(s: Column) -> Column:
        lines, lost = s["lines"], s["lost"]
        stop = lambda i: F.when(i < F.size(lost), F.get(lost, i)["start"]).otherwise(F.size(lines))
        start = lambda i: F.when(i > 0, F.get(lost, i - 1)["start"] + F.get(lost, i - 1)["n"]).otherwise(0)
        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(lost)), lambda i: F.slice(lines, start(i) + 1, stop(i) - start(i)))), "\n")

    return F.element_at(F.transform(F.array(F.struct(lines_of(text).alias("lines"), runs.alias("lost"))), cut), 1)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, bitmap_col: str | None = "_bitmap", spread: int = ROWS) -> DataFrame:
    """All columns of ``docs`` with the text's lost lines taken out; a text that loses none is as it was, a null null.

    See lost_lines() for which lines are lost, and for null ids and repeated rows. Every input row gives one row. The
    bitmap of keep_bitmaps() comes as ``bitmap_col`` (null where nothing is lost; none of it with None); a column of that
    name is replaced, all others stay, whatever their names.
    """
    maps = keep_bitmaps(docs, id_col, text_col, min_chars, min_docs, spread)
    own = F.struct(*[F.col(c) for c in docs.columns])
    held = docs.select(own.alias("_docs"), F.col(id_col).alias("doc"), row_key(id_col, text_col).alias("row"))
    text, runs = F.col("_docs")[text_col], F.col("runs")
    kept = F.when(runs.isNull() | text.isNull(), text).otherwise(_kept(text, runs))
    joined = held.join(maps.hint("shuffle_hash"), ["doc", "row"], "left")
    columns = [kept.alias(c) if c == text_col else F.col("_docs")[c].alias(c) for c in docs.columns if c != bitmap_col]
    return joined.select(*columns, *([F.col("bitmap").alias(bitmap_col)] if bitmap_col else []))
