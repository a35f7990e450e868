"""Property tests: Column functions against plain-Python models of their
documented semantics, on generated strings (whitespace-heavy, URL-like).
Each hypothesis example is one batch of strings evaluated in one job."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tickerwire.functions import text, urls

WS = [" ", "  ", "\t", "\n", "\r", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", "\u1680", "\u2000",
      "\u2009", "\u200a", "\u2028", "\u2029", "\u202f", "\u205f", "\u3000", "\u200b"]
WORDS = ["a", "Inc.", "Inc", "é", "ß", "中", "x.y", "+", ":", "/", "http", "://"]
chunks = st.lists(st.sampled_from(WS + WORDS) | st.text(
    st.characters(blacklist_categories=("Cs",)), max_size=3), max_size=12).map("".join)
batches = st.lists(chunks, min_size=20, max_size=60)

url_part = st.sampled_from(["reuters", "www", "com", "wsj", "a", "", "REUTERS", ":80", "u@h"])
hosts = st.lists(url_part, min_size=1, max_size=4).map(".".join)
url_like = st.builds(lambda s, h, p: f"{s}{h}{p}", st.sampled_from(["http://", "https://", "", "ftp://", "x://y://"]),
                     hosts, st.sampled_from(["", "/", "/a/b", "/a://b"]))
hrefs = st.builds(lambda a, b: a + b, st.sampled_from(["/url?q=", "/url?q", "", "/"]),
                  st.sampled_from(["", "/", "http://x.com/a", "/www.x.com/", "x.com", "https://y"]))

COMMON = dict(max_examples=6, deadline=None,
              suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])


def _run(spark, values, *exprs):
    df = spark.createDataFrame([(v,) for v in values], "s STRING")
    return df.select("s", *[e.alias(f"c{i}") for i, e in enumerate(exprs)]).collect()


@settings(**COMMON)
@given(batches)
def test_text_functions_match_python(spark, values):
    for r in _run(spark, values, text.querify("s"), text.word_count("s"),
                  text.collapse_ws("s"), text.strip_all_ws("s")):
        s = r.s
        assert r.c0 == s.replace(" ", "+")
        assert r.c1 == len(s.split(" "))
        assert r.c2 == " ".join(s.split())
        assert r.c3 == "".join(ch for ch in s if not ch.isspace())


@settings(**COMMON)
@given(batches)
def test_company_query_matches_python(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "s STRING")
    for r in df.select("s", text.company_query("s", "s").alias("q")).collect():
        s = r.s
        assert r.q == "+".join(t for t in s.split(" ") if t != "Inc.") + "+" + s + "+stock+news"


@settings(**COMMON)
@given(st.lists(st.tuples(url_like, url_part), min_size=20, max_size=60))
def test_is_of_source_matches_python(spark, pairs):
    df = spark.createDataFrame(pairs, "url STRING, source STRING")
    for r in df.select("url", "source", urls.is_of_source("url", "source").alias("got")).collect():
        parts = r.url.split("://")
        expected = len(parts) > 1 and r.source in parts[1].split("/")[0].split(".")
        assert r.got is expected, (r.url, r.source)


@settings(**COMMON)
@given(st.lists(hrefs, min_size=10, max_size=40))
def test_unwrap_link_matches_python(spark, values):
    for r in _run(spark, values, urls.unwrap_link("s")):
        u = r.s[7:]
        if not u:
            assert r.c0 is None
            continue
        if u[0] == "/":
            u = u[1:]
        if u[:4] != "http":
            u = "http://" + u
        assert r.c0 == u
