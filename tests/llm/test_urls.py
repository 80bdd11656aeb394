"""Operator 6 against DuckDB and a loop over rules."""

from helpers import duck, same

from crease.llm import urlfilter

URLS = [
    None, "", "no scheme", "http://", "http:///path", "https://Example.COM/en/x?q#f", "https://www.example.com/en/", "https://www.example.com/en",
    "http://a.b.example.com/en/deep/er", "http://notexample.com/en/", "http://x.net/es/", "http://x.net/esx/", "http://net/fr/a", "ftp://x.net?/es/", "http://x.net#/es/",
    "http://com", "http://com/", "http://.com/", "http://com./", "http://x.org/redirect://y.net/es/", "a://b://c.net/es/", "http://é.com/ü\nz", "http://" + "a." * 3000 + "com/" + "p/" * 3000, "http://x.net/es/" + "y" * 100_000,
]


def plain(url, rules=urlfilter.RULES):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :]
    for c in "?#":
        path = path.split(c)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return (host, path, *((best[3], best[2]) if best else (None, "allow")))


def test_table(spark, sf_dir):
    same(urlfilter.op6_url_filter(spark, sf_dir).toPandas(), duck(sf_dir).sql(urlfilter.OP6_SQL).df())


def test_edges(spark):
    rows = [(i, u, None, "x", "y", "z") for i, u in enumerate(URLS)] + [(None, URLS[5], None, "", "", ""), (3, URLS[5], None, "", "", ""), (3, URLS[5], None, "", "", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, rule string, prefix string")
    rules = spark.createDataFrame([*urlfilter.RULES, (None, "/", "block"), ("com", None, "block")], "host string, path string, verdict string")
    key = lambda r: str(r)
    found = sorted((tuple(r) for r in urlfilter.judge_urls(df, rules).collect()), key=key)
    assert found == sorted(((r[0], *plain(r[1])) for r in rows), key=key)
    assert urlfilter.judge_urls(df.limit(0), rules).count() == 0
    none = urlfilter.judge_urls(df, rules.limit(0)).collect()
    assert len(none) == len(rows) and all(r.rule is None and r.verdict == "allow" for r in none)


def test_many_rules_by_shuffle(spark):
    """More path lengths than any list on the driver would hold, rules of both verdicts, joins without broadcasts."""
    df = spark.createDataFrame([*enumerate(URLS), *((100 + i, f"http://h{i}.x.net/{'y' * i}") for i in range(0, 2600, 13))], "page_id long, url string")
    many = [("x.net", "/" + "y" * n, "block" if n % 3 else "allow") for n in range(2500)]
    every = [*urlfilter.RULES, *many, ("com", "/", "block")]
    rules = spark.createDataFrame(every, "host string, path string, verdict string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = {r[0]: tuple(r)[1:] for r in urlfilter.judge_urls(df, rules).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found == {r.page_id: plain(r.url, every) for r in df.collect()}
