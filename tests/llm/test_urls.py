import math
import re
import time
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from logspark.llm import urls

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def address(url):
    if url is None or "://" not in url:
        return url or ""
    scheme, rest = url.split("://", 1)
    host = parts(url)[0]
    return f"{scheme}://{host}{rest[len(host):]}"


def rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def brute(rows, held, order=4):
    """rows: (page_id, url); held: addresses of the calibration fold."""
    known = [(i, *parts(u), address(u)) for i, u in rows]
    counts = {v: [defaultdict(Counter) for _ in range(order + 1)] for v in ("allow", "block")}
    for _, host, path, whole in known:
        verdict = rule(host, path)[1]
        if verdict and (host, path) not in held:
            text = "\x02" * order + whole + "\x03"
            for at in range(order, len(text)):
                for size in range(order + 1):
                    counts[verdict][size][text[at - size:at]][text[at]] += 1

    def chance(verdict, context, char):
        p = 1 / 256
        for size in range(order + 1):
            seen = counts[verdict][size][context[order - size:]]
            if seen:
                p = (seen[char] + len(seen) * p) / (seen.total() + len(seen))
        return p

    def score(whole):
        text = "\x02" * order + whole + "\x03"
        return sum(math.log(chance("allow", text[n - order:n], text[n])) - math.log(chance("block", text[n - order:n], text[n]))
                   for n in range(order, len(text))) / (len(text) - order)

    return {(i, h, p): (rule(h, p), score(whole)) for i, h, p, whole in known}


def held_of(spark, rows):
    table = spark.createDataFrame([parts(u) for _, u in rows], "host string, path string").distinct()
    return {tuple(r) for r in table.where(F.pmod(F.xxhash64("host", "path"), F.lit(urls.CALIBRATION)) == 0).collect()}


def test_whole_table_against_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = [(r.page_id, r.url) for r in pages.select("page_id", "url").collect()]
    want = brute(rows, held_of(spark, rows))
    got = urls.judged(pages).collect()
    assert len(got) == len(rows)
    free = []
    for r in got:
        (text, verdict), score = want[r.page_id, r.host, r.path]
        assert r.rule == text and abs(r.score - score) < 1e-9
        assert verdict is None or r.verdict == verdict
        if verdict is None:
            free.append((r.score, r.verdict))
    assert max(s for s, v in free if v == "block") < min(s for s, v in free if v == "allow")


def test_parts_and_rules(spark):
    cases = ["HTTP://Sub.Example.NET/en/x?q#f", "http://example.net/EN/", "http://net", "http://net/", "x://a.org/fr/", "ftp://borg/fr/",
             "no scheme", None, "", "://host#f/a", "http://É.Example.com/de/ü?x", "a://b://c/d", "http://example.com?/de/"]
    pages = spark.createDataFrame([(n, u, 1, "h") for n, u in enumerate(cases)], "page_id bigint, url string, gram int, host string")
    got = sorted(urls.judged(pages).collect(), key=lambda r: r.page_id)
    assert [(r.host, r.path, r.rule) for r in got] == [(*parts(u), rule(*parts(u))[0]) for u in cases]
    assert all(r.verdict in ("allow", "block") for r in got)


def test_nothing_to_learn_repeats_and_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x"), (1, "http://a.com/x"), (None, "http://b.net/x")], "page_id bigint, url string")
    assert sorted((r.page_id or 0, r.verdict) for r in urls.judged(pages).collect()) == [(0, "block"), (1, "allow"), (1, "allow")]
    assert urls.judged(pages.limit(0)).collect() == []
    assert urls.allowed(pages).count() == 3


def test_model_finds_what_resembles_the_rejected(spark):
    rows = [(n, f"http://shop{n}.cheap-{n % 7}.net/buy") for n in range(60)]
    rows += [(100 + n, f"http://lib{n}.school-{n % 7}.org/fr/page{n}") for n in range(60)]
    rows += [(900, "http://shop5.cheap-3.example.biz/buy"), (901, "http://lib3.school-2.example.biz/fr/page3")]
    got = {r.page_id: r.verdict for r in urls.judged(spark.createDataFrame(rows, "page_id bigint, url string")).collect()}
    assert (got[900], got[901]) == ("block", "allow")


def test_query_fragment_and_raw_text_are_judged(spark):
    rows = [(n, f"http://s{n}.net/?casino=win{n}#bet") for n in range(60)]
    rows += [(100 + n, f"http://s{n}.org/fr/?lesson=read{n}#book") for n in range(60)]
    rows += [(900, "http://a.biz/?casino=win7#bet"), (901, "http://a.biz/?lesson=read7#book"), (902, "casino=win"), (903, "lesson=read"),
             (904, None), (905, "x://😀.biz/😀?é")]
    got = {r.page_id: r for r in urls.judged(spark.createDataFrame(rows, "page_id bigint, url string")).collect()}
    assert [got[n].verdict for n in (900, 901, 902, 903)] == ["block", "allow", "block", "allow"]
    assert len({got[n].score for n in range(900, 906)}) == 6


def test_a_long_url_takes_linear_time(spark):
    rows = [(1, "http://a.net/" + "x" * 50), (2, "http://a.org/fr/" + "y" * 50), (3, "http://b.biz/?q=" + "xy" * 500_000),
            (4, "http://c.net/" + "x" * 50), (5, "http://c.org/fr/" + "y" * 50)]
    began = time.monotonic()
    assert len(urls.judged(spark.createDataFrame(rows, "page_id bigint, url string")).collect()) == 5
    assert time.monotonic() - began < 60
