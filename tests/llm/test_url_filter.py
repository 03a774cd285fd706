import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from shopmeter.llm import url_filter
from shopmeter.llm.queries import URL_RULES
from shopmeter.llm.url_filter import judge

SCHEMA = "page_id long, url string"


def parts(url):
    if url is None or "://" not in url:
        return "", "", url or ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    tail = rest[len(host) :]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    return host, re.match("[^?#]*", tail)[0], host + tail


def rule_for(host, path, rules):
    fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return max(fits, key=lambda r: len(r[1] + r[2]), default=None)


def brute(rows, rules, order):
    texts = {}
    for _, url in rows:
        host, path, text = parts(url)
        found = rule_for(host, path, rules)
        texts[text] = max(filter(None, [texts.get(text), found and found[0]]), default=None)
    grams = lambda t: [("\x02" * order + t + "\x03")[i : i + order + 1] for i in range(len(t) + 1)]
    teaches = {t: v is not None and zlib.crc32(t.encode()) % 5 != 0 for t, v in texts.items()}
    models = {}
    for side in ("allow", "block"):
        model = defaultdict(Counter)
        for t, v in texts.items():
            if teaches[t] and v == side:
                for g in grams(t):
                    for level in range(order + 1):
                        model[g[order - level : order]][g[-1]] += 1
        models[side] = model

    def chance(model, gram):
        p = url_filter.UNSEEN
        for level in range(order + 1):
            after = model.get(gram[order - level : order])
            if after:
                p = (after[gram[-1]] + len(after) * p) / (sum(after.values()) + len(after))
        return p

    scores = {}
    for t in texts:
        if not teaches[t]:
            total = sum(math.floor(1e6 * math.log(chance(models["allow"], g) / chance(models["block"], g))) for g in grams(t))
            scores[t] = (total, len(t) + 1)
    step = {t: math.floor(total / (n * url_filter.STEP)) for t, (total, n) in scores.items()}
    good = [step[t] for t in scores if texts[t] == "allow"]
    bad = [step[t] for t in scores if texts[t] == "block"]
    best = 0
    if good and bad:
        loss = lambda c: sum(s < c for s in good) / len(good) + sum(s >= c for s in bad) / len(bad)
        best = min({0, *good, *bad}, key=lambda c: (loss(c), abs(c), c))
    out = []
    for key, url in rows:
        host, path, text = parts(url)
        found = rule_for(host, path, rules)
        if found:
            out.append((key, host, path, found[1] + found[2], found[0], None))
        else:
            total, n = scores[text]
            out.append((key, host, path, None, "allow" if step[text] >= best else "block", total / (n * url_filter.UNITS)))
    return sorted(out, key=str)


def some_urls(seed, count):
    draw = random.Random(seed)
    hosts = ["a.example.com", "WWW.Example.com", "www.example.com", "b.net", "x.b.net", "xnet", "c.org", "spam-x.org:80", "com", "é.org"]
    paths = ["", "/", "/en/", "/en", "/es/1", "/fr/2.html", "/de/日本", "?q=/en/", "#/fr/", "/en/?a=b://c"]
    out = [f"{draw.choice(['http', 'https', ''])}://{draw.choice(hosts)}{draw.choice(paths)}{draw.randrange(40)}" for _ in range(count)]
    return out + [None, "", "no scheme.com/en/", "://", "http://com/", "http://com", "http://a\nb.com/x\ny?z", "https://c.org/" + "long" * 5000] + out[:30]


def test_registered_query_equals_its_sql(agrees):
    rows = agrees("op12_url_filter", "/root/testdata/sf0.01", ["pages"])
    assert {(r[3] is None, r[4]) for r in rows} >= {(False, "allow"), (False, "block")}


@pytest.mark.parametrize(("order", "frequent"), [(5, 20_000), (2, 30)])
def test_verdicts_by_brute_force(spark, monkeypatch, order, frequent):
    monkeypatch.setattr(url_filter, "FREQUENT", frequent)
    rows = list(enumerate(some_urls(order, 250)))
    got = judge(spark.createDataFrame(rows, SCHEMA), URL_RULES, order=order).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, URL_RULES, order)


@pytest.mark.parametrize("rules", [[], URL_RULES[:1], URL_RULES[1:2]])
def test_rules_of_one_kind_or_none(spark, rules):
    rows = list(enumerate(some_urls(9, 60)))
    got = judge(spark.createDataFrame(rows, SCHEMA), rules).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, rules, 5)


def test_models_tell_unseen_urls_apart(spark):
    draw = random.Random(1)
    good = [f"http://docs{draw.randrange(99)}.com/guide/chapter-{draw.randrange(10**6)}" for _ in range(300)]
    bad = [f"http://win{draw.randrange(99)}.net/fr/casino-bonus-{draw.randrange(10**6)}" for _ in range(300)]
    asked = [f"http://docs.org/guide/chapter-{i}" for i in range(50)] + [f"http://win.org/casino-bonus-{i}" for i in range(50)]
    rows = list(enumerate([*asked, *good, *bad]))
    found = {r.page_id: r.verdict for r in judge(spark.createDataFrame(rows, SCHEMA), URL_RULES).collect()}
    assert [found[i] for i in range(100)] == ["allow"] * 50 + ["block"] * 50


def test_plan_has_no_python(spark):
    judged = judge(spark.createDataFrame(list(enumerate(some_urls(3, 40))), SCHEMA), URL_RULES)
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_empty_tables_nulls_and_extra_columns(spark):
    assert judge(spark.createDataFrame([], SCHEMA), URL_RULES).count() == 0
    rows = [(None, None, "x", 1), (None, None, "x", 1), (3, "http://a.com/", "y", 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, text string, verdict int")
    found = judge(pages, URL_RULES, carry=("page_id", "text"))
    assert sorted((tuple(r)[:2] for r in found.collect()), key=str) == [(3, "y"), (None, "x"), (None, "x")]
    with pytest.raises(ValueError, match="repeat"):
        judge(pages, URL_RULES, carry=("page_id", "verdict"))
    assert judge(pages.withColumn("host", F.lit("h")), URL_RULES).count() == 3
