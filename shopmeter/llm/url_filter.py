"""URL filters: rules on hosts and paths, and a character language model for the rest.

URLs that a rule allows or blocks teach two smoothed Markov models of variable order, one for
accepted and one for rejected URLs: the chance of a character comes from the longest context
seen, mixed with those of all shorter ones by the number of different characters seen after
each. A URL without a rule is judged by the difference of its two log-likelihoods per
character against a threshold calibrated on a fifth of the URLs with a rule, which the models
don't see. Counts cover all URLs, each one once. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopmeter.session import durable

#: Characters of the longest context, and the chance of a character that no model has seen.
ORDER, UNSEEN = 5, 1 / 256
#: Whole-number units of a log-likelihood, and those of a step between thresholds.
UNITS, STEP = 1_000_000, 10_000
#: So many of the commonest grams have their scores sent to all tasks (a few MB, whatever the
#: table); the others' are joined.
FREQUENT = 20_000

#: Marks before and after a URL.
_FRONT, _END = "\x02", "\x03"


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``, null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """Host in lower case (A-Z only), with port and user as they stand; empty without ``://``."""
    host = F.regexp_extract(_after_scheme(url), r"(?s)^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """Path, from the end of the host to the first ``?`` or ``#``; empty without ``://``."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*(.*)$", 1), url, F.lit(""))


Rule = tuple[str, str, str]


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits, null if none does.

    A rule (verdict, host, path) fits its host and all subdomains where the path starts with
    its own. Of rules just as long the first one given counts.
    """
    found = [F.lit(None).cast("struct<rule: string, verdict: string>")]
    for verdict, of, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(start)
        found.append(F.when(fits, F.struct(F.lit(of + start).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*found)


def _grams(urls: DataFrame, order: int) -> DataFrame:
    """``gram``: every character of ``text`` with ``order`` before it, and the end of the text."""
    chars = F.split(F.concat(F.lit(_FRONT * order), F.col("text"), F.lit(_END)), "")
    rows = urls.withColumn("chars", chars)
    shifted = F.arrays_zip(*(F.slice("chars", 1 + i, F.greatest(F.size("chars") - order, F.lit(0))).alias(f"g{i}") for i in range(order + 1)))
    rows = rows.select(*(c for c in urls.columns if c != "text"), F.explode(shifted).alias("g"))
    return rows.withColumn("gram", F.concat(*(F.col(f"g.g{i}") for i in range(order + 1)))).drop("g")


def gram_scores(grams: DataFrame, order: int) -> DataFrame:
    """``gram, value`` from ``gram, accepted, rejected``: the models' log ratio in whole units.

    Level by level: a gram's chance is (its count + kinds * the chance one level down) / (its
    context's count + kinds), where kinds is the number of different characters the context was
    seen with. Keys of every join are grams, which at most an alphabet of others share.
    """
    ends = F.explode(F.sequence(F.lit(0), F.lit(order))).alias("level")
    parts = grams.select("gram", "accepted", "rejected", ends)
    parts = parts.withColumn("gram", F.expr("right(gram, level + 1)"))
    counts = parts.groupBy("level", "gram").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))
    counts = counts.withColumn("context", F.expr("left(gram, level)"))
    here = Window.partitionBy("level", "context")
    for name in ("accepted", "rejected"):
        counts = counts.withColumn(f"{name}_all", F.sum(name).over(here))
        counts = counts.withColumn(f"{name}_kinds", F.sum((F.col(name) > 0).cast("long")).over(here))
    counts = durable(counts)
    lower = None
    for level in range(order + 1):
        rows = counts.filter(F.col("level") == level)
        if lower is None:
            rows = rows.withColumns({"a": F.lit(UNSEEN), "r": F.lit(UNSEEN)})
        else:
            rows = rows.withColumn("less", F.expr("substring(gram, 2)")).join(lower.withColumnRenamed("gram", "less"), "less")
        chances = []
        for name, short in (("accepted", "a"), ("rejected", "r")):
            seen = F.col(f"{name}_all") > 0
            mixed = (F.col(name) + F.col(f"{name}_kinds") * F.col(short)) / (F.col(f"{name}_all") + F.col(f"{name}_kinds"))
            chances.append(F.when(seen, mixed).otherwise(F.col(short)).alias(short))
        lower = rows.select("gram", *chances)
    value = F.floor(F.lit(float(UNITS)) * F.log(F.col("a") / F.col("r")))
    return lower.select("gram", value.alias("value"))


def text_scores(urls: DataFrame, scores: DataFrame, counts: DataFrame, order: int) -> DataFrame:
    """``text, total, symbols``: the summed values of each distinct text and its number of grams.

    The commonest grams meet their values in every task, so that only the rare ones travel,
    and no key of that join can be hot.
    """
    top = counts.orderBy(F.col("n").desc(), "gram").limit(FREQUENT).select("gram")
    frequent = durable(scores.join(top, "gram", "left_semi"))
    rare = scores.join(top, "gram", "left_anti")
    rows = _grams(urls.select("text", F.col("text").alias("of")), order)
    tried = rows.join(F.broadcast(frequent), "gram", "left")
    known = tried.filter("value is not null").groupBy("of").agg(F.sum("value").alias("total"), F.count("*").alias("symbols"))
    looked = tried.filter("value is null").select("of", "gram").join(rare, "gram")
    looked = looked.groupBy("of").agg(F.sum("value").alias("total"), F.count("*").alias("symbols"))
    both = known.unionByName(looked).groupBy(F.col("of").alias("text"))
    return both.agg(F.sum("total").alias("total"), F.sum("symbols").alias("symbols"))


def threshold(scored: DataFrame) -> int:
    """The step at which fewest shares of ``accepted`` URLs lie below and of the others above.

    Ties go to the step nearest 0, then to the lower one. Without URLs of either kind it is 0.
    The driver gets one number; the steps are few, since a mean log ratio is bounded.
    """
    step = F.floor(F.col("total") / (F.col("symbols") * F.lit(STEP))).alias("step")
    steps = scored.groupBy(step).agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r"))
    steps = steps.unionByName(scored.sparkSession.createDataFrame([(0, 0, 0)], steps.schema))
    steps = steps.groupBy("step").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    below = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    above = Window.orderBy("step").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    lost = F.try_divide(F.coalesce(F.sum("a").over(below), F.lit(0)), F.sum("a").over(whole))
    passed = F.try_divide(F.sum("r").over(above), F.sum("r").over(whole))
    best = steps.select("step", (lost + passed).alias("loss")).filter("loss is not null")
    found = best.orderBy("loss", F.abs("step"), "step").first()
    return found["step"] if found else 0


def judge(
    pages: DataFrame, rules: Sequence[Rule], url: str = "url", order: int = ORDER, carry: Sequence[str] = ("page_id",)
) -> DataFrame:
    """``carry`` columns, then ``host, path, rule, verdict, score`` of every row.

    The verdict is the rule's, or else the models': ``allow`` if the score (log ratio per
    character, null where a rule decided) reaches the calibrated threshold, else ``block``. A
    null URL counts as an empty text, a URL without ``://`` is judged as it stands. Repeated
    URLs teach once and get one verdict. Where no rule ever allows or blocks, both models know
    as much and the threshold is 0, so what has no rule is allowed if nothing speaks against it.
    """
    names = [*carry, "host", "path", "rule", "verdict", "score"]
    if len(set(names)) < len(names):
        raise ValueError(f"column names repeat: {names}")
    address = F.col(f"`{url}`")
    rows = pages.select(
        F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry))).alias("row"),
        host_of(address).alias("host"),
        path_of(address).alias("path"),
        F.concat(host_of(address), _rest_of(address)).alias("text"),
    )
    rows = rows.withColumn("by", rule_of(F.col("host"), F.col("path"), rules))

    # One row a URL: accepted, rejected or neither, and whether it calibrates.
    urls = rows.groupBy("text").agg(F.max("by.verdict").alias("verdict"))
    urls = urls.withColumn("fold", F.crc32(F.col("text").cast("binary")) % 5)
    urls = durable(urls)
    teaches = F.col("verdict").isNotNull() & (F.col("fold") != 0)
    asked = urls.filter(~teaches)
    marks = urls.select(
        "text",
        (teaches & (F.col("verdict") == "allow")).cast("long").alias("accepted"),
        (teaches & (F.col("verdict") == "block")).cast("long").alias("rejected"),
    )
    counts = _grams(marks, order).groupBy("gram")
    counts = durable(
        counts.agg(
            F.sum(F.coalesce("accepted", F.lit(0))).alias("accepted"),
            F.sum(F.coalesce("rejected", F.lit(0))).alias("rejected"),
            F.count("*").alias("n"),
        )
    )
    scores = durable(gram_scores(counts, order))
    scored = durable(text_scores(asked, scores, counts, order))
    held = scored.join(asked.filter("verdict is not null"), "text")
    step = threshold(held.withColumn("accepted", F.col("verdict") == "allow"))
    per_symbol = F.col("total") / (F.col("symbols") * F.lit(UNITS))
    passes = F.floor(F.col("total") / (F.col("symbols") * F.lit(STEP))) >= step

    shown = [F.col(f"row.c{i}").alias(c) for i, c in enumerate(carry)]
    decided = rows.filter("by is not null").select(
        *shown, "host", "path", "by.rule", "by.verdict", F.lit(None).cast("double").alias("score")
    )
    others = rows.filter("by is null").join(scored, "text").select(
        *shown, "host", "path", F.lit(None).cast("string").alias("rule"),
        F.when(passes, "allow").otherwise("block").alias("verdict"), per_symbol.alias("score"),
    )
    return decided.unionByName(others)
