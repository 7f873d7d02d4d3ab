import numpy as np

from sensorhealth.llm import urls

PAGES = "page_id bigint, url string, html string, host string, rule string, verdict string"


def page(i, url, *links):
    return (i, url, "".join(f'<a href="{x}">x</a>' for x in links) or None, "own", "own", "own")


def judged(spark, rows, **options):
    return {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, PAGES), **options).collect()}


def test_rules_and_odd_urls(spark):
    rows = [
        page(1, "http://a.ORG/x"), page(2, "https://m.example.org/es/1?q"), page(3, "http://example.org/en/12#t"),
        page(4, "http://example.org/en/2"), page(5, "http://x.com/de/"), page(6, "http://x.com/de"), page(7, "http://xcom/de/"),
        page(8, None), page(9, "nothing"), page(10, ""), page(11, "http://"), page(12, "http://b.org"), page(13, "http://b.org?u=/x"),
        page(14, "ftp://Ä.org/é\n/z?x"), page(15, "http://a://b/c"), page(16, "http://" + "h" * 60000 + ".org/" + "p" * 60000),
    ]
    got = judged(spark, rows)
    told = {i: (r["host"], r["path"], r["rule"], r["verdict"]) for i, r in got.items()}
    assert told[1] == ("a.org", "/x", "org/", "allow")
    assert told[2] == ("m.example.org", "/es/1", "example.org/es/", "block")
    assert told[3] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert told[4] == ("example.org", "/en/2", "org/", "allow")
    assert told[5] == ("x.com", "/de/", "com/de/", "block")
    assert told[6][:3] == ("x.com", "/de", None) and told[7] == ("xcom", "/de/", None, "allow")
    for i in (8, 9, 10, 11):
        assert told[i] == ("", "", None, "allow")
    assert told[12] == ("b.org", "", None, "allow") and told[13] == ("b.org", "", None, "allow")
    assert told[14] == ("Ä.org", "/é\n/z", "org/", "allow") and told[15] == ("a:", "//b/c", None, "allow")
    assert told[16][2] == "org/" and len(got) == len(rows)
    assert judged(spark, []) == {}


def test_distrust_runs_against_links_and_trust_along_them(spark):
    rules = (urls.UrlRule("good.net", "/", "allow"), urls.UrlRule("bad.net", "/", "block"))
    rows = [
        page(1, "http://good.net/", "http://fine.net/a"), page(2, "http://bad.net/", "http://victim.net/"),
        page(3, "http://fine.net/", "//other.net/x"), page(4, "http://farm.net/", "https://BAD.net/p", "http://bad.net/q"),
        page(5, "http://victim.net/"), page(6, "http://other.net/"), page(7, "http://lone.net/"), page(8, "http://feeder.net/", "http://farm.net/"),
        page(9, "http://shop.victim.net/"), page(4, "http://farm.net/"),
    ]
    got = judged(spark, rows, rules=rules)
    assert {i: r["verdict"] for i, r in got.items()} == {
        1: "allow", 2: "block", 3: "allow", 4: "block", 5: "allow", 6: "allow", 7: "allow", 8: "block", 9: "allow"
    }
    names = ["good.net", "bad.net", "fine.net", "farm.net", "victim.net", "other.net", "feeder.net", "shop.victim.net"]
    links = {(0, 2): 1, (1, 4): 1, (2, 5): 1, (3, 1): 1, (6, 3): 1, (4, 7): 1, (7, 4): 1}
    move = np.zeros((8, 8))
    for (a, b), w in links.items():
        move[a, b] = w
    back = move.T / np.maximum(1, move.sum(axis=0))[:, None]
    move /= np.maximum(1, move.sum(axis=1))[:, None]
    for kind, start, step in (("trust", 0, move), ("distrust", 1, back)):
        seed = np.eye(8)[start] * 0.15
        score = seed
        for _ in range(15):
            score = seed + 0.85 * score @ step
        by_host = {r["host"]: r[kind] for r in got.values()}
        assert all(abs(by_host[n] - s) < 1e-9 for n, s in zip(names, score))


def test_repeated_rows_each_get_a_verdict(spark):
    rows = [page(1, "http://x.com/fr/")] * 3
    assert urls.judge(spark.createDataFrame(rows, PAGES)).count() == 3


def test_hosts_of_mixed_shares_are_judged_by_mass(spark):
    rules = (urls.UrlRule("net", "/good/", "allow"), urls.UrlRule("net", "/bad/", "block"))
    rows = [page(i, f"http://{host}.net/{path}") for i, (host, path) in enumerate(
        [("a", "good/"), ("a", "bad/"), ("a", "bad/"), ("a", "x"), ("b", "good/"), ("b", "bad/"), ("b", "x"),
         ("c", "good/"), ("c", "good/"), ("c", "bad/"), ("c", "x"), ("d", "bad/"), *[("d", "x")] * 9, ("e", "x")]
    )]
    rows.append(page(50, "http://f.net/x", "http://d.net/"))
    got = judged(spark, rows, rules=rules)
    told = {}
    for r in got.values():
        if r["rule"] is None:
            told.setdefault(r["host"][0], set()).add(r["verdict"])
    assert told == {"a": {"block"}, "b": {"allow"}, "c": {"allow"}, "d": {"block"}, "e": {"allow"}, "f": {"block"}}
    assert abs(got[0]["distrust"] - 0.5 * 0.15) < 1e-12 and abs(got[0]["trust"] - 0.25 * 0.15) < 1e-12
