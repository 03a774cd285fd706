"""Words that differ by one character, by pairs of numbered trie nodes.

All words are put into two tries, one of their beginnings and one of their ends, whose nodes
are numbered. Leaving out one character of a word gives a pair of integers, the node of what
comes before it and the node of what comes after. Words that share such a pair differ in that
character alone; a word that is cut in two at the pair is the other one without it. So equal
pairs give exactly the words within one edit, and no string is compared.

Nodes are numbered without a table of strings: words are sorted once forwards and once
backwards, a node gets the place of the first word below it and its depth, and what crosses a
partition's edge follows from the edges' words.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopmeter.session import durable

#: A word is a longest run of these; the least characters and occurrences of a word in the list.
LETTERS = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT = 5, 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, run``: every run of letters of every text, in lower case (A-Z only); null texts have none."""
    lower = F.translate(F.col(f"`{text}`"), _UPPER, _LOWER)
    named = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("key")
    return docs.select(named, F.explode(F.regexp_extract_all(lower, F.lit(LETTERS), F.lit(0))).alias("run"))


def misspelt(rows: DataFrame, one_in: int = 97) -> DataFrame:
    """``word``: the runs, of which about one in ``one_in`` loses a character, picked by crc32."""
    h = F.crc32(F.concat("key", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.expr("left(run, at)"), F.expr("substring(run, at + 2)"))
    hashed = rows.select("run", h.alias("h")).withColumn("at", at)
    return hashed.select(F.when(F.col("h") % one_in == 0, cut).otherwise(F.col("run")).alias("word"))


def _shared(one: str, two: str) -> int:
    n = min(len(one), len(two))
    if one[:n] == two[:n]:
        return n
    low, high = 0, n  # the longest common beginning lies in [low, high)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if one[:middle] == two[:middle] else (low, middle)
    return low


def _numbered(words: DataFrame, column: str, depth: int, name: str) -> DataFrame:
    """``word, <name>``: the numbers of the nodes on the word's way through the trie of ``column``.

    A node's number is (place of the first word below it) * (depth + 1) + its own depth.
    """
    ranged = words.select("word", column) if column != "word" else words.select("word")
    # Written once, so that every later reading finds the same ranges.
    ranged = durable(ranged.repartitionByRange(column).sortWithinPartitions(column))
    sized = ranged.groupBy(F.spark_partition_id().alias("part"))
    edges = sized.agg(F.count("*").alias("n"), F.min(column).alias("first"), F.max(column).alias("last")).orderBy("part").collect()

    # The way of the last word before each partition: nodes it shares with the first word are not new.
    way, place, previous, before = [], 0, None, {}
    firsts = _edge_ways(ranged, column, [(e.part, e.first, e.last) for e in edges])
    for edge in edges:
        before[edge.part] = (place, previous, list(way))
        starts = firsts[edge.part]  # depth -> place within the partition of the first word below the last word's node
        kept = _shared(previous, edge.last) if previous is not None else -1
        way = [way[d] if d <= kept else (place + starts[d]) * (depth + 1) + d for d in range(len(edge.last) + 1)]
        place, previous = place + edge.n, edge.last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = last = nodes = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if here is None:
                here, last, nodes = before[batch.column(0)[0].as_py()]
            flat, ends = [], [0]
            for word in batch.column(2).to_pylist():
                kept = _shared(last, word) if last is not None else -1
                nodes = nodes[: kept + 1] + [here * (depth + 1) + d for d in range(kept + 1, len(word) + 1)]
                flat.extend(nodes)
                ends.append(len(flat))
                here, last = here + 1, word
            lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(1), lists.cast(pa.list_(pa.int64()))], names=["word", name])

    rows = ranged.select(F.spark_partition_id().alias("part"), "word", F.col(column).alias("sorted"))
    return rows.mapInArrow(run, f"word string, {name} array<long>")


def _edge_ways(ranged: DataFrame, column: str, edges: list[tuple[int, str, str]]) -> dict[int, list[int]]:
    """For each partition and depth, the place in it of the first word that shares so much with its last."""
    lasts = {part: last for part, _, last in edges}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, last, place = None, None, 0
        part = None
        for batch in batches:
            for word in batch.column(1).to_pylist():
                if last is None:
                    part = batch.column(0)[0].as_py()
                    last = lasts[part]
                    starts = [-1] * (len(last) + 1)
                for d in range(_shared(word, last), -1, -1):
                    if starts[d] >= 0:
                        break
                    starts[d] = place
                place += 1
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([starts], pa.list_(pa.int64()))], names=["part", "starts"])

    rows = ranged.select(F.spark_partition_id().alias("part"), F.col(column).alias("sorted"))
    found = rows.mapInArrow(run, "part int, starts array<long>").collect()
    return {r.part: list(r.starts) for r in found}


def _pairs(nodes: DataFrame) -> DataFrame:
    """``before, after, kind, word, n``: a word without one character, and a word cut in two.

    Leaving out any character of a run of equal ones gives the same rest: kind 0 stands for
    the last of the run, 1 for the others, which replacements need too; 2 is a cut.
    """
    size = F.length("word")
    skipped = F.expr(
        """transform(sequence(1, size), i -> struct(
             element_at(front, i) as before, element_at(back, size - i + 1) as after,
             if(i < size and chars[i - 1] = chars[i], 1, 0) as kind))"""
    )
    cut = F.expr("transform(sequence(1, size + 1), i -> struct(element_at(front, i) as before, element_at(back, size - i + 2) as after, 2 as kind))")
    rows = nodes.withColumn("chars", F.split("word", "")).withColumn("size", size)
    rows = rows.select("word", "n", F.explode(F.concat(skipped, cut)).alias("p"))
    return rows.select("p.*", "word", "n")


def _best(near: Column) -> Column:
    """The first of a list of (-n, word): the largest n, then the smallest word."""
    return F.array_min(near)


def neighbours(words: DataFrame) -> DataFrame:
    """``word, n, n_near, form, form_n`` from ``word`` (distinct) and ``n`` (its occurrences).

    ``n_near`` counts the words that differ by one inserted, deleted or replaced character;
    ``form`` is the one of largest ``n`` (ties: the smallest in code-point order), null if none
    is at least twice as frequent as the word. The words that share a pair differ in one
    character only, so an alphabet bounds their number.
    """
    depth = words.agg(F.coalesce(F.max(F.length("word")), F.lit(0))).first()[0]
    if not depth:
        return words.select(
            "word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("form"), F.lit(None).cast("long").alias("form_n")
        )
    backwards = words.select("word", F.reverse("word").alias("turned"))
    nodes = words.join(_numbered(words, "word", depth, "front"), "word").join(_numbered(backwards, "turned", depth, "back"), "word")

    member = F.struct((-F.col("n")).alias("less"), "word", "kind")
    groups = _pairs(nodes).groupBy("before", "after").agg(F.collect_list(member).alias("all")).filter("size(all) > 1")
    # A word that left out a character is near the others that did, and near the word cut there if
    # the character stands for its run; that word is near all whose character stands for its run.
    rows = groups.select("all", F.explode("all").alias("me"))
    rows = rows.withColumn(
        "near",
        F.expr(
            """transform(filter(all, x -> x.word <> me.word and
                 if(me.kind = 2, x.kind = 0, x.kind < 2 or me.kind = 0)), x -> struct(x.less, x.word))"""
        ),
    ).filter("size(near) > 0")
    rows = rows.select("me.word", F.size("near").alias("many"), _best(F.col("near")).alias("best"))
    met = rows.groupBy("word").agg(F.sum("many").alias("n_near"), F.min("best.less").alias("less"), F.min("best").alias("best"))
    all_words = words.join(met, "word", "left")
    fits = -F.col("best.less") >= 2 * F.col("n")
    return all_words.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, F.col("best.word")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n"),
    )


def with_roots(found: DataFrame) -> DataFrame:
    """``found`` with ``root``: the last word that forms lead to from ``word``, itself if it has none.

    A form is at least twice as frequent, so ways are short; each round doubles their length.
    """
    steps = durable(found.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = steps.join(onward, "root", "left")
        if not longer.filter("next is not null").limit(1).count():
            break
        steps = durable(longer.select("word", F.coalesce("next", "root").alias("root")))
    return found.join(steps, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of the words of a column ``word`` of occurrences.

    Words of at least ``least_length`` characters that occur ``least_count`` times count; null
    ones don't. Occurrences are summed before they travel. No word gives no row.
    """
    counted = words.filter("word is not null").groupBy("word").agg(F.count("*").alias("n"))
    listed = durable(counted.filter((F.length("word") >= least_length) & (F.col("n") >= least_count)))
    return with_roots(durable(neighbours(listed))).select("word", "form", "root", "n", "n_near", "form_n")
