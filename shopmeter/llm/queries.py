"""The registered queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopmeter.llm import language_id, mixing, quality, resampling, spelling, toxicity, url_filter
from shopmeter.llm.common import held_out, table
from shopmeter.llm.fingerprints import fingerprint_neighbours
from shopmeter.llm.near_copies import near_copies
from shopmeter.llm.nearest import nearest
from shopmeter.llm.repeats import repeats
from shopmeter.llm.sentencepiece_codec import encode_decode
from shopmeter.llm.token_counts import count_tokens
from shopmeter.session import durable


def model_file(name: str) -> bytes:
    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode_decode(docs, model_file("piece_bpe_32k.model"))
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_copies(table(spark, sf_dir, "documents"), shingle=2)
    return found.withColumnRenamed("component", "component_id")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = durable(
        docs.select("doc_id", "source", mixing.row_hash().alias("hash"), mixing.row_turn().alias("turn"), mixing.text_size().alias("size"))
    )
    mixed = mixing.apply(rows, mixing.thresholds(rows.select("hash", "turn", "size", "source")))
    taken = F.col("size") * F.col("times")
    return mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    scored = toxicity.score(docs, model)
    predicted = (F.col("score") >= 0.5).cast("int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", predicted.alias("predicted"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, every_row=True)
    return found.select("query_id", "rank", F.col("near_id").alias("vec_id"), "score")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    scored = quality.score(docs, model)
    predicted = (F.col("score") >= 0.3).cast("int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", predicted.alias("predicted"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleared = repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["high"] - s["low"])
    return cleared.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, model_file("byte_bpe_50k.json").decode())
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = language_id.learn(docs.filter(~held_out()))
    found = language_id.identify(docs, filters)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = fingerprint_neighbours(table(spark, sf_dir, "documents"))
    return marked.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = resampling.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    drawn = resampling.draw(scored, share=25)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


#: The rules that ``op12_url_filter`` is given, as (verdict, host, path).
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(spelling.misspelt(spelling.runs(table(spark, sf_dir, "documents"))))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_near_copies": op2_near_copies,
    "op3_mixing": op3_mixing,
    "op4_toxicity": op4_toxicity,
    "op5_nearest": op5_nearest,
    "op6_quality": op6_quality,
    "op7_repeats": op7_repeats,
    "op8_token_counts": op8_token_counts,
    "op9_language_id": op9_language_id,
    "op10_fingerprints": op10_fingerprints,
    "op11_resampling": op11_resampling,
    "op12_url_filter": op12_url_filter,
    "op13_spelling": op13_spelling,
}

def _crc32_sql(text: str) -> str:
    """crc32 of a text's UTF-8 bytes as an SQL expression, bit by bit."""
    digits = f"hex(encode({text}))"
    return f"""xor(4294967295::UBIGINT, list_reduce(
        list_transform(range(length({digits}) // 2),
          lambda i: ('0x' || substr({digits}, (2 * i + 1)::BIGINT, 2))::UBIGINT),
        lambda reg, byte: list_reduce(range(8),
          lambda r, k: xor(r::UBIGINT >> 1, 3988292384::UBIGINT * (r::UBIGINT & 1)), xor(reg, byte)),
        4294967295::UBIGINT))::BIGINT"""


def _levels_sql(order: int) -> str:
    """The chances of grams of each length, from those one character shorter, as SQL steps."""
    steps = []
    for level in range(order + 1):
        lower = "" if not level else f" JOIN p{level - 1} AS l ON l.gram = substr(g.gram, 2)"
        a, r = (f"{url_filter.UNSEEN}::DOUBLE",) * 2 if not level else ("l.a", "l.r")
        steps.append(f"""p{level} AS (
  SELECT g.gram,
         CASE WHEN accepted_all > 0 THEN (accepted + accepted_kinds * {a}) / (accepted_all + accepted_kinds) ELSE {a} END AS a,
         CASE WHEN rejected_all > 0 THEN (rejected + rejected_kinds * {r}) / (rejected_all + rejected_kinds) ELSE {r} END AS r
  FROM g{lower} WHERE level = {level}
)""")
    return ", ".join(steps)


def _rules_sql(value: int) -> str:
    """The verdict (0) or the text (1) of the longest rule that fits, as SQL."""
    cases = ""
    for verdict, host, path in sorted(URL_RULES, key=lambda r: -len(r[1] + r[2])):
        fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
        cases += f" WHEN {fits} THEN '{(verdict, host + path)[value]}'"
    return f"CASE{cases} END"


_LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FEATURES_SQL = f"regexp_extract_all({_LOWER_SQL.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLES: dict[str, str] = {
    "op2_near_copies": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 1 THEN [w] ELSE
           list_distinct([[w[i], w[i + 1]] FOR i IN range(1, len(w))]) END) AS s
  FROM w WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), i AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i
  FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), l AS (
  SELECT i.a, i.b FROM i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b
  WHERE 100 * i.i >= 80 * (x.n + y.n - i.i)
), r AS (
  SELECT doc_id, doc_id AS reach FROM documents
  UNION
  SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reach
), c AS (
  SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
""",
    "op3_mixing": r"""
WITH d AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 12))::BIGINT AS h,
         row_number() OVER (PARTITION BY source, h) AS j
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, 3 * source_size AS cap,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w,
         sum(source_size) OVER () AS total
  FROM s
), l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
              / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER o AS place
  FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST)
), t AS (
  SELECT source, source_size,
         coalesce(least(cap::DOUBLE, w * first_value(level) OVER (ORDER BY cap <= w * level, place)), 0) AS target
  FROM l
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM t
), r AS (
  SELECT source, h, j, size AS words, sum(size) OVER (PARTITION BY source ORDER BY h, j) - size AS below FROM d
), c AS (
  SELECT p.source, max((r.h, r.j)) AS last, arg_max(r.below, (r.h, r.j)) AS below, arg_max(r.words, (r.h, r.j)) AS words
  FROM p JOIN r ON p.source IS NOT DISTINCT FROM r.source AND r.below <= p.target - p.passes * p.source_size
  GROUP BY p.source
)
SELECT d.doc_id, d.size, p.source_size, p.target,
       (d.size * (p.passes + CASE WHEN (d.h, d.j) < c.last OR (d.h, d.j) = c.last
          AND 2 * ((p.target - p.passes * p.source_size) - c.below) > c.words THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN c ON d.source IS NOT DISTINCT FROM c.source
""",
    "op5_nearest": """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 20 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p
) WHERE rank <= 20
""",
    "op11_resampling": f"""
WITH w AS (
  SELECT doc_id, {_FEATURES_SQL} AS w FROM documents
), f AS (
  SELECT doc_id, unnest(w || [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS f FROM w
), m AS (
  SELECT unnest(w || [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS f FROM (SELECT {_FEATURES_SQL} AS w FROM benchmark)
), c AS (
  SELECT f, {_crc32_sql("f")} % 10000 AS b FROM (SELECT f FROM f UNION SELECT f FROM m)
), s AS (
  SELECT b, count(*) AS s FROM f JOIN c USING (f) GROUP BY b
), t AS (
  SELECT b, count(*) AS t FROM m JOIN c USING (f) GROUP BY b
), n AS (
  SELECT (SELECT count(*) FROM f)::DOUBLE AS s, (SELECT count(*) FROM m)::DOUBLE AS t
), g AS (
  SELECT s.b, floor(1000 * ln((coalesce(t.t, 0)::DOUBLE + 1) * (n.s + 10000) / ((s.s::DOUBLE + 1) * (n.t + 10000))))::BIGINT AS gain
  FROM s LEFT JOIN t USING (b), n
), d AS (
  SELECT doc_id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM f JOIN c USING (f) JOIN g USING (b) GROUP BY doc_id
), a AS (
  SELECT w.doc_id, coalesce(len(w), 0) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || w.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM w LEFT JOIN d USING (doc_id)
), r AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, 25 * count(*) OVER () // 100 AS wanted
  FROM a WHERE words >= 20
)
SELECT a.doc_id, n_features, weight, score, rank FROM a LEFT JOIN r ON r.doc_id = a.doc_id AND rank <= wanted
""",
    "op12_url_filter": f"""
WITH u AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), h AS (
  SELECT page_id, coalesce({_LOWER_SQL.format("regexp_extract(rest, '(?s)^([^/?#]*)', 1)")}, '') AS host,
         coalesce(regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1), '') AS path,
         coalesce(regexp_extract(rest, '(?s)^[^/?#]*(.*)$', 1), url, '') AS tail
  FROM u
), j AS (
  SELECT page_id, host, path, host || tail AS text, {_rules_sql(1)} AS rule, {_rules_sql(0)} AS verdict FROM h
), x AS (
  SELECT text, max(verdict) AS verdict, {_crc32_sql("text")} % 5 AS fold FROM j GROUP BY text
), y AS (
  SELECT *, verdict IS NOT NULL AND fold <> 0 AS teaches,
         [substr(repeat(chr(2), {url_filter.ORDER}) || text || chr(3), i, {url_filter.ORDER + 1}) FOR i IN range(1, length(text) + 2)] AS grams
  FROM x
), z AS (
  SELECT gram, count_if(teaches AND verdict = 'allow') AS accepted, count_if(teaches AND verdict = 'block') AS rejected
  FROM (SELECT *, unnest(grams) AS gram FROM y) GROUP BY gram
), k AS (
  SELECT level, right(gram, level + 1) AS gram, accepted, rejected FROM z, range({url_filter.ORDER + 1}) AS l(level)
), v AS (
  SELECT level, gram, left(gram, level) AS context, sum(accepted)::BIGINT AS accepted, sum(rejected)::BIGINT AS rejected
  FROM k GROUP BY level, gram
), g AS (
  SELECT *, sum(accepted) OVER c AS accepted_all, count_if(accepted > 0) OVER c AS accepted_kinds,
         sum(rejected) OVER c AS rejected_all, count_if(rejected > 0) OVER c AS rejected_kinds
  FROM v WINDOW c AS (PARTITION BY level, context)
), {_levels_sql(url_filter.ORDER)}, t AS (
  SELECT text, any_value(verdict) AS verdict, len(any_value(grams)) AS symbols,
         sum(floor({url_filter.UNITS} * ln(a / r))::BIGINT)::BIGINT AS total
  FROM (SELECT *, unnest(grams) AS gram FROM y WHERE NOT teaches) JOIN p{url_filter.ORDER} USING (gram) GROUP BY text
), s AS (
  SELECT *, floor(total::DOUBLE / (symbols * {url_filter.STEP}))::BIGINT AS step FROM t
), b AS (
  SELECT step, count_if(verdict = 'allow') AS a, count_if(verdict = 'block') AS r
  FROM (SELECT step, verdict FROM s WHERE verdict IS NOT NULL UNION ALL SELECT 0, NULL) GROUP BY step
), o AS (
  SELECT step, coalesce(sum(a) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / nullif(sum(a) OVER (), 0)
             + sum(r) OVER (ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / nullif(sum(r) OVER (), 0) AS loss
  FROM b
), e AS (
  SELECT coalesce((SELECT step FROM o WHERE loss IS NOT NULL ORDER BY loss, abs(step), step LIMIT 1), 0) AS least
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IS NOT NULL THEN j.verdict WHEN s.step >= e.least THEN 'allow' ELSE 'block' END AS verdict
FROM j LEFT JOIN s USING (text), e
""",
    "op13_spelling": f"""
WITH RECURSIVE r AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER_SQL.format("text")}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL
), h AS (
  SELECT run, n, {_crc32_sql("doc_id || ':' || run")} AS h FROM r
), w AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word,
         sum(n)::BIGINT AS n
  FROM h GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3
), d AS (
  SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)
), p AS (
  SELECT a.word, b.word AS near FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, w.word FROM d JOIN w ON d.rest = w.word
  UNION SELECT w.word, d.word FROM d JOIN w ON d.rest = w.word
), q AS (
  SELECT p.word, count(*) AS n_near, max(v.n) AS most, arg_min(v.word, (-v.n, v.word)) AS best FROM p JOIN w v ON v.word = p.near GROUP BY p.word
), f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * w.n THEN best END AS form, CASE WHEN most >= 2 * w.n THEN most END AS form_n
  FROM w LEFT JOIN q USING (word)
), t AS (
  SELECT word, word AS root, form AS next FROM f
  UNION ALL SELECT t.word, f.word, f.form FROM t JOIN f ON f.word = t.next
)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN t ON t.word = f.word AND t.next IS NULL
""",
}
