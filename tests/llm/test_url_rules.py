import random

from loomgraph.llm import queries, url_rules


def brute(url, rules, default):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for verdict, rule in rules:
        h, slash, p = rule.partition("/")
        if h and (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            rank = (h.count("."), len(slash + p))
            if best is None or rank > best[0]:
                best = (rank, rule, verdict)
    return host, path, best and best[1], best[2] if best else default


def test_against_brute_force(spark):
    rng = random.Random(1)
    labels = ["net", "com", "example", "a", "b", "a-b", "é"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    path = lambda: "/" + "".join(rng.choice(["en/", "en", "de/", "x"]) for _ in range(rng.randint(0, 3)))
    rules = [(rng.choice(["block", "allow"]), host() + path()) for _ in range(90)] + [("block", "/en/"), ("allow", "net")]
    assert len({r[1] for r in rules}) < len(rules)  # equal rules, also with other verdicts
    urls = [None, "", "http:///en/x", "no scheme", "http://", "http://NET", "HTTP://Example.NET/en/", "x://net?/en/", "a://b://c/d", "http://net:80/en/#x"]
    urls += [f"http://{host()}{path()}{rng.choice(['', '?q=/', '#t'])}" for _ in range(500)]
    urls += urls[:9] + ["http://" + "a." * 20_000 + "net/" + "en/" * 50_000, "http://net/" + "x" * 300_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3).withColumn("rule", url_rules.F.lit("clash"))
    for some, at_once in ((rules, 500), (rules, 7), (queries.URL_RULES, 500), ([], 5)):
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge(pages, some, at_once=at_once).collect()}
        assert got == {k: brute(u, some, "allow") for k, u in enumerate(urls)}
    assert url_rules.judge(pages.limit(0), rules).count() == 0
