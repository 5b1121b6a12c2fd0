import random

from colloquy.llm.url_filters import ALLOW, BLOCK, build_cascade, filter_urls, rule_frame


def judged(url, rules):
    if url is None or "://" not in url:
        return "", "", None, ALLOW
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = rest[:cut], rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = []
    for verdict, rule in rules:
        h, slash, p = rule.partition("/")
        if host and (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fits.append((len(rule), len(h), rule, verdict))
    best = max(fits, default=(0, 0, None, ALLOW))
    verdict = max((f[3] for f in fits if f[2] == best[2]), default=ALLOW)
    return host, path, best[2], verdict


def corpus():
    draw = random.Random(5)
    hosts = [f"{a}{b}.{c}" for a in ("", "www.", "m.x.") for b in ("one", "two", "three", "four") for c in ("com", "net", "co.uk")]
    urls = [f"http{'s' * (i % 2)}://{draw.choice(hosts)}/{draw.choice(['en', 'de', ''])}/{draw.randint(0, 99)}{draw.choice(['', '?a=/x', '#y', '/'])}" for i in range(600)]
    urls += [None, "", "none", "http://", "http://ONE.com", "x://one.com?q/en/", "a://b://one.com/en/", "http://one.com/" + "z" * 5000, "http://.com/en/1"]
    rules = {draw.choice([h.split(".", draw.randint(0, 1))[-1] for h in hosts]) + draw.choice(["", "/", "/en/", "/de/1", f"/en/{draw.randint(0, 99)}"]) for _ in range(150)}
    return urls, [(draw.choice([ALLOW, BLOCK]), r) for r in sorted(rules)] + [(BLOCK, "one.com/"), (ALLOW, "one.com/")]


def test_equals_brute_force(spark):
    urls, rules = corpus()
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string").repartition(3)
    want = {i: judged(u, rules) for i, u in enumerate(urls)}
    for bits in (1 << 27, 1):  # by the cascade, and by the join for lists past the bound
        found = filter_urls(pages, rule_frame(spark, rules), max_bits=bits)
        assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in found.collect()} == want


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(6000).selectExpr("concat('k', id % 5000) AS key")
    listed = spark.range(700).selectExpr("concat('k', id * 7) AS key")
    cascade = build_cascade(listed, universe)
    assert len(cascade.levels) > 1
    from pyspark.sql import functions as F

    tested = cascade.attach(universe.distinct(), "w").select("key", cascade.contains(F.col("key"), "w").alias("is"))
    assert {r["key"] for r in tested.where("is").collect()} == {f"k{7 * i}" for i in range(700) if 7 * i < 5000}


def test_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert filter_urls(pages, rule_frame(spark, []), unlisted=BLOCK).first()["verdict"] == BLOCK
