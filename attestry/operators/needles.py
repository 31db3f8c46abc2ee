"""Which of many texts occur in a large document: automata of the texts, run over overlapping chunks of it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts of one automaton at most (about), and code points of a chunk beside the overlap.
AUTOMATON, CHUNK = 100_000, 1 << 20


def found(needles: DataFrame, document: DataFrame, automaton: int = AUTOMATON, chunk: int = CHUNK) -> DataFrame:
    """Rows (needle): the distinct texts of ``needles`` that stand in some row of ``document`` (text).

    The texts are dealt out by hash into groups of about ``automaton``. Each group meets every chunk once, in as many tasks
    as there are shuffle partitions; a task holds the automaton of one group and one chunk. A text longer than a chunk is
    found too, as chunks overlap by the longest text's length. An empty text stands in every document that has a row with
    a text; null texts stand nowhere.
    """
    spark = needles.sparkSession
    own = needles.where("needle is not null").distinct()
    n, longest = own.agg(F.count("*"), F.max(F.length("needle"))).first()
    groups, tasks = max(1, -(-n // automaton)), int(spark.conf.get("spark.sql.shuffle.partitions"))
    # each chunk goes to one task of each group
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(chunk)))
    cut = document.where("text is not null").select("text", starts.alias("at")).select(F.substring("text", F.col("at") + 1, F.lit(chunk + max(longest or 1, 1) - 1)).alias("text"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    chunks = cut.withColumn("task", F.pmod(F.xxhash64("text"), F.lit(tasks)).cast("int")).withColumn("group", every(groups))
    sought = own.withColumn("group", F.pmod(F.xxhash64("needle"), F.lit(groups)).cast("int")).withColumn("task", every(tasks))
    rows = chunks.select("group", "task", F.lit(1).alias("kind"), "text").unionByName(sought.select("group", "task", F.lit(0).alias("kind"), F.col("needle").alias("text")))
    return rows.repartition(tasks, "group", "task").sortWithinPartitions("group", "task", "kind").mapInArrow(_search, "needle string").distinct()


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import ahocorasick

    of, machine, left, ready = None, None, set(), False
    for batch in batches:
        for group, task, kind, text in zip(*[batch.column(c).to_pylist() for c in ("group", "task", "kind", "text")], strict=True):
            if (group, task) != of:
                of, machine, left, ready = (group, task), ahocorasick.Automaton(), set(), False
            if kind == 0:
                left.add(text)
                if text:
                    machine.add_word(text, text)
                continue
            if not ready:
                machine.make_automaton()
                ready = True
            # what is found once isn't told again
            here = ({word for _, word in machine.iter(text)} if len(machine) else set()) | {""}
            if new := here & left:
                left -= new
                yield pa.RecordBatch.from_arrays([pa.array(sorted(new))], names=["needle"])
