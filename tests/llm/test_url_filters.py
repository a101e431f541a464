from datetime import datetime, timedelta

from pyspark.sql import functions as F

from assayer.llm import url_filters

START = datetime(2024, 1, 1)


def day(n):
    return START + timedelta(days=n)


ENTRIES = [
    ("l", "block", "bad.example", True, day(10)),
    ("l", "block", "bad.example", False, day(200)),
    ("l", "block", "bad.example", True, day(300)),
    ("l", "block", "bad.example", True, day(310)),
    ("m", "block", "x.bad.example/a", True, day(0)),
    ("m", "allow", "x.bad.example", True, day(50)),
    ("m", "allow", "x.bad.example", False, day(50)),
    ("m", "allow", "y.bad.example", True, day(0)),
    ("m", "block", None, True, day(0)),
    ("m", "block", "z.example", True, None),
]
CAPTURES = [(i, u, day(d)) for i, (u, d) in enumerate((u, d) for u in ["http://bad.example", "https://u@X.Bad.Example:8080/a/b?q#f", "http://y.bad.example/", "http://notbad.example/a", "nonsense", None] for d in (0, 9, 10, 199, 200, 299, 300, 400))]


def brute(url, at):
    hits = []
    for name, action, pattern, listed, since in ENTRIES:
        if pattern is None or since is None or since > at or url is None or "://" not in url:
            continue
        later = [e for e in ENTRIES if e[:3] == (name, action, pattern) and e[4] <= at]
        if max((e[4], not e[3]) for e in later)[1] or max(e[4] for e in later) != since:
            continue
        rest = url.split("://")[1].split("?")[0].split("#")[0]
        host = rest.split("/")[0].split("@")[-1].split(":")[0].lower()
        path = [p for p in rest.split("/")[1:] if p]
        phost, *pp = pattern.split("/")
        if (not pp and (host == phost or host.endswith("." + phost))) or (pp and host == phost and path[: len(pp)] == pp):
            hits.append((action, pattern))
    longest = {a: max((p for x, p in hits if x == a), key=len, default=None) for a in ("block", "allow")}
    blocked = longest["block"] is not None and (longest["allow"] is None or len(longest["block"]) > len(longest["allow"]))
    return len(hits), longest["block"], longest["allow"], blocked


def test_every_time_and_pattern(spark):
    captures = spark.createDataFrame([*CAPTURES, (99, "http://bad.example", None)], "page_id long, url string, at timestamp").selectExpr("*", "'x' as row", "'y' as pattern", "'z' as list")
    entries = spark.createDataFrame(ENTRIES, "list string, action string, pattern string, listed boolean, at timestamp").selectExpr("*", "1 as until", "2 as slice")
    rows = url_filters.judge(captures, entries).collect()
    assert len(rows) == len(CAPTURES) + 1
    for r in rows:
        want = brute(r.url, r.at) if r.at else (0, None, None, False)
        assert (r.n_active, r.block_pattern, r.allow_pattern, r.blocked) == want, (r, want)
    assert url_filters.judge(captures.filter("false"), entries).count() == 0
    assert not url_filters.judge(captures, entries.filter("false")).filter("blocked").count()


def test_addresses_and_closing_dots(spark):
    covered = {
        "http://10.1.2.3/a": ["10.1.2.3", "10.1.2.3/a"], "http://[::1]:8/x": ["[::1]", "[::1]/x"], "http://A.B.Example./": ["a.b.example", "b.example"],
        "http://b.example:80": ["b.example"], "http://local/a//b": ["local", "local/a", "local/a/b"],
    }
    others = ["2.3", "3", ":1]", "example", "B.Example", "b.example.", "10.1.2.3/", "b.example/", "local/a/", "local//a", "", "/", "cal", "a.B.example", "local/a/b/"]
    listed = sorted({p for found in covered.values() for p in found} | set(others))
    entries = spark.createDataFrame([("l", "block", p, True, day(0)) for p in listed], "list string, action string, pattern string, listed boolean, at timestamp")
    captures = spark.createDataFrame([(i, u, day(1)) for i, u in enumerate(covered)], "row long, url string, at timestamp")
    found = url_filters.active(captures, entries).collect()
    assert {u: sorted(r.pattern for r in found if r.row == i) for i, u in enumerate(covered)} == {u: sorted(p) for u, p in covered.items()}


def test_keys_of_urls_are_those_of_their_patterns(spark):
    url, want = "http://u.v.example/a/b/c", ["u.v.example", "v.example", "u.v.example/a", "u.v.example/a/b", "u.v.example/a/b/c"]
    keys = url_filters.pattern_keys(spark.createDataFrame([(1, url, day(0))], "row long, url string, at timestamp")).collect()
    listed = spark.createDataFrame([(p,) for p in want], "p string").select(url_filters.pattern_key(F.col("p")).alias("key")).collect()
    assert sorted(r.key for r in keys) == sorted(r.key for r in listed)


def test_a_url_of_very_many_segments_and_labels(spark):
    long_path, long_host = "/".join(f"segment{i}" for i in range(40_000)), ".".join(f"l{i}" for i in range(20_000))
    captures = spark.createDataFrame([(1, f"http://h.example/{long_path}", day(1)), (2, f"http://{long_host}.example/x", day(1)), (3, "http://h.example/segment0/other", day(1))], "page_id long, url string, at timestamp")
    patterns = ["h.example/segment0/segment1", f"h.example/{long_path}", "l19999.example", "h.example/segment1"]
    entries = spark.createDataFrame([("l", "block", p, True, day(0)) for p in patterns], "list string, action string, pattern string, listed boolean, at timestamp")
    rows = {r.id: (r.n_active, r.block_pattern) for r in url_filters.judge(captures, entries).collect()}
    assert rows == {1: (2, patterns[1]), 2: (1, patterns[2]), 3: (0, None)}
    made = url_filters.pattern_keys(captures.withColumnRenamed("page_id", "row"))
    assert made.count() == 1 + 40_000 + 20_000 + 1 + 1 + 2


def test_intervals_reach_over_empty_slices(spark):
    """Null lists are a list of their own; an entry ends at the next one, however many slices later."""
    schema = "list string, action string, pattern string, listed boolean, at timestamp"
    rows = [(name, "block", "h.example", n % 3 != 1, day(d)) for name in ("l", None) for n, d in enumerate((0, 1, 2, 31, 500, 501, 1200))]
    found = url_filters.intervals(spark.createDataFrame(rows, schema)).collect()
    want = {(name, day(a), day(b) if b else None) for name in ("l", None) for a, b in ((0, 1), (2, 31), (31, 500), (501, 1200), (1200, None))}
    assert {(r["list"], r.since, None if r.until.year == 9999 else r.until) for r in found} == want
    assert len(found) == len(want)
