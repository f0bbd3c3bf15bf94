"""Robots texts to rule groups."""

from meguri.operators.filters import robots_groups


def test_groups(spark):
    body = (
        "Disallow: /lost\r\nUser-agent: A # x\n\n# y\nUSER-AGENT:b\nDisallow: /p:q\nDisallow:\nAllow : /z #c\nCrawl-delay: x\n"
        "crawl-delay: .5\nCrawl-delay: -1\nuser-agent: *\nSitemap: https://s\nUser-agent: c\nCrawl-delay:\nnothing"
    )
    texts = spark.createDataFrame([("h", body), ("empty", ""), ("none", None), ("k", "allow: /")], "host string, body string")
    got = {(r["host"], r["group_no"]): (r["user_agents"], [tuple(x) for x in r["rules"]], r["crawl_delay_ms"]) for r in robots_groups(texts).collect()}
    assert got == {
        ("h", 1): (["a", "b"], [("disallow", "/p:q"), ("allow", "/z")], 500),
        ("h", 2): (["*"], [], None),
        ("h", 3): (["c"], [], 0),
    }
