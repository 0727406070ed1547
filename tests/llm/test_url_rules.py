import random
import re

from panelspark.llm import url_rules as U
from panelspark.llm.queries import HOST_RULES, PATTERN_RULES

URLS = [None, "", "no scheme/x", "://", "http://NET/", "http://a.Example.NET/en/1?x#y", "http://example.net/en", "https://x.net",
        "http://www.example.com/de/?q", "http://m.example.org/fr/1#t", "http://cheap-pills.org/fr/", "http://x.org/EN/cheap-pills",
        "http://org/fr/", "http://x.net?/en/", "http://a/b://c.net/", "http://é.net/ü", "x" * 100000 + "://spam-farm.de/", "http://xxx/xxx"]


def test_same_as_testing_every_rule(spark):
    rules = HOST_RULES + PATTERN_RULES
    r = random.Random(3)
    urls = URLS + [f"http://{r.choice(['', 'a.', 'www.'])}{r.choice(['example.net', 'example.com', 'x.org', 'spam-farm.io', 'n.de'])}"
                   f"{r.choice(['/', '/en/', '/de/', '/fr/', '', '/cheap-pills'])}{r.randrange(9)}" for _ in range(300)]
    urls += urls[:20]
    df = spark.createDataFrame([(i if i else None, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in U.filter_urls(df, rules).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        g = got[i if i else None]
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
        assert (g.host, g.path) == ((m[1].lower() if m[1].isascii() else m[1], m[2]) if m else ("", ""))
        want = U.judge(u, {}, rules, "allow")
        assert (g.rule, g.pattern, g.verdict) == want[2:], u


def test_rule_is_filed_under_its_rarest_token():
    rule = U.PatternRule("block", "a-b", ("a", "b"))
    assert U.build_index([rule], {"a": 5, "b": 2})[0] == {"b": [rule]}
    assert U.build_index([U.PatternRule("block", ".")], {}) == ({}, [U.PatternRule("block", ".")])
    assert U.HostRule("block", "a.b", "/c/d").tokens() == {"a", "b", "c"}  # /d may go on


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert U.filter_urls(df, HOST_RULES).count() == 0
