"""Parts of URLs and rules against plain Python; the trees by accuracy on URLs they have not seen."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from lemmaforge.llm.urls import RULES, entropy, judge_urls


def plain(url):
    url = url or ""
    at = url.find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fit, key=lambda r: len(r[1] + r[2]), default=None)
    return host, path, best and best[1] + best[2], best and best[0]


URLS = [
    None, "", "no scheme/x", "http://", "http://a.NET/en/1", "http://example.net/en/1", "https://www.Example.net/en/?q=1", "https://x.example.net/de/2",
    "http://example.com/de/", "http://example.com/de", "http://notexample.com/de/1", "http://a.org/fr/1#x", "http://org/fr/", "http://a.org?b/fr/", "http://net",
    "http://É.net/ü", "http://a.org:80/fr/1", "http://u:p@a.net/", "a://b://c.net/x", "http://a.net/\nx", "http://a.org/" + "x" * 100_000, "http://../", "http:///de/",
]


def test_parts_and_rules(spark):
    rows = list(enumerate(URLS)) + [(None, URLS[5]), (5, URLS[5])]
    df = spark.createDataFrame(rows, "page_id bigint, url string").selectExpr("*", "1 as host", "2 as _label", "'x' as verdict")
    got = judge_urls(df).collect()
    assert sorted(((r.page_id, r.host, r.path, r.rule) for r in got), key=repr) == sorted(((i, *plain(u)[:3]) for i, u in rows), key=repr)
    for r in got:
        assert r.verdict in ("allow", "block") and (r.rule is None or r.verdict == dict((h + p, v) for v, h, p in RULES)[r.rule])
    assert judge_urls(df.limit(0)).count() == 0


def test_entropy(spark):
    for text in ["", "aaaa", "ab.b", "é漢é", "http://x.org/?q=$1\\n"]:
        want = -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())
        assert math.isclose(spark.range(1).select(entropy(F.lit(text)).alias("e")).first().e or 0.0, want, abs_tol=1e-9)


def test_plain_hosts_beside_a_rule_are_allowed(spark):
    """What a rule blocks on some paths of a site says nothing of the site's other hosts."""
    rng = random.Random(1)
    word = lambda k: "".join(rng.choices("abcdefghij", k=k))
    urls = [f"http://{word(6)}.example.com/{rng.choice(['de', 'en', 'fr'])}/{word(5)}" for _ in range(300)]
    urls += [f"http://{rng.choice(['casino', 'pills', 'adserver'])}{rng.choice(['', '-' + word(4)])}.{rng.choice(['example.com', 'shop.info'])}/en/{word(5)}" for _ in range(40)]
    urls += [f"http://{word(5)}.net/{word(4)}" for _ in range(60)] + [f"http://{word(5)}.org/fr/{word(4)}" for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = [r for r in judge_urls(df).collect() if r.rule is None]
    plain_hosts = [r for r in got if not re.match("casino|pills|adserver", r.host)]
    marked = [r for r in got if re.match("(casino|pills|adserver)[.-]", r.host)]
    assert len(plain_hosts) > 150 and sum(r.verdict == "allow" for r in plain_hosts) >= 0.95 * len(plain_hosts)
    assert len(marked) > 20 and sum(r.verdict == "block" for r in marked) >= 0.5 * len(marked)


def test_trees_judge_unseen_urls(spark):
    rng = random.Random(0)
    word = lambda k: "".join(rng.choices("abcdefghij", k=k))
    rows = []
    for i in range(600):
        bad = rng.random() < 0.5
        ruled = rng.random() < 0.6
        host = f"{word(4)}-{rng.randint(1000, 9999)}-{word(9)}" if bad else word(6)
        rule = ("a.net", "/p/") if bad else ("a.org", "/fr/")
        rows.append((i, f"http://{host}.{rule[0] if ruled else 'b.info'}{rule[1] if ruled else '/p/'}{word(5)}{'?a=1&b=2&c=3' if bad else ''}", bad))
    df = spark.createDataFrame(rows, "page_id bigint, url string, bad boolean")
    got = judge_urls(df).join(df.select("page_id", "bad"), "page_id").where("rule is null").collect()
    right = sum((r.verdict == "block") == r.bad for r in got)
    assert len(got) > 150 and right >= 0.9 * len(got)
