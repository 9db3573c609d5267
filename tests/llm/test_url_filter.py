import random
import re

from weftgraph.llm.url_filter import RULES, judge


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_against_brute_force(spark):
    r = random.Random(3)
    hosts = ["com", "Example.COM", "www.example.com", "a.www.example.com", "xexample.com", "net", "b.net", "n\u00c9t.org", "", "a..net", "u@example.com:80"]
    urls = [f"{r.choice(['http', 'https', 'x'])}://{r.choice(hosts)}{r.choice(['', '/', '/en/', '/en', '/es/1', '/fr/?q=/en/', '/EN/', '?x', '#/en/', '/a\nb'])}" for _ in range(300)]
    urls += [None, "", "no scheme", "://", "a://b://net/es/", "http://www.example.com/en/" + "x" * 20000]
    for rules in (RULES, [], [*RULES, ("net", "/e", "allow"), ("b.net", "/es/", "allow"), ("net", "/es/", "allow"), (None, "/", "block")]):
        pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(0, urls[0], "x")], "page_id long, url string, host string")
        table = spark.createDataFrame(rules, "host string, path string, verdict string")
        got = [(x.page_id, x.host, x.path, x.rule, x.verdict) for x in judge(pages, table).select("row.page_id", "judged.*").collect()]
        known = {}
        for h, p, v in rules:
            if h is not None:
                known[h, p] = min(v, known.get((h, p), v))
        listed = [(h, p, v) for (h, p), v in known.items()]
        assert sorted(got) == sorted((i, *brute(u, listed)) for i, u in [*enumerate(urls), (0, urls[0])])
        assert judge(pages.where("false"), table).count() == 0
