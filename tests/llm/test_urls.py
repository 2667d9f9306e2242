import math
import zlib
from collections import Counter

from geopanel.llm import url_filter
from geopanel.llm.plans import URL_RULES


def parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def rule(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def verdicts(urls):
    """The two models by recursion over plain counts."""
    known = {u: rule(*parts(u))[1] for u in urls}
    aside = {u: zlib.crc32(u.encode()) % url_filter.FIFTHS == 0 for u in urls}
    o, w = url_filter.ORDER, url_filter.WEIGHT
    padded = lambda u: url_filter.FRONT * o + u + url_filter.BACK
    grams = lambda u: [padded(u)[i : i + o + 1] for i in range(len(u) + 1)]
    n = {v: Counter(g[o - k :] for u in urls if known[u] == v and not aside[u] for g in grams(u) for k in range(o + 1)) for v in ("allow", "block")}
    context = {v: Counter() for v in n}
    for v, c in n.items():
        for g, m in c.items():
            context[v][(len(g), g[:-1])] += m

    def p(v, g):
        lower = p(v, g[1:]) if len(g) > 1 else 1 / url_filter.ALPHABET
        return (n[v][g] + w * lower) / (context[v][(len(g), g[:-1])] + w)

    score = {u: sum(math.log(p("allow", g)) - math.log(p("block", g)) for g in grams(u)) / len(grams(u)) for u in set(urls)}
    held = {v: [score[u] for u in urls if aside[u] and known[u] == v] for v in n}
    if not all(held.values()):
        return {u: known[u] or "allow" for u in urls}
    mean = {v: sum(x) / len(x) for v, x in held.items()}
    dev = {v: math.sqrt(sum((s - mean[v]) ** 2 for s in x) / len(x)) for v, x in held.items()}
    t = (mean["allow"] * dev["block"] + mean["block"] * dev["allow"]) / (dev["allow"] + dev["block"])
    return {u: known[u] or ("allow" if score[u] >= t else "block") for u in urls}


def test_whole_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    urls = {r.page_id: r.url for r in pages.select("page_id", "url").collect()}
    want = verdicts(list(urls.values()))
    for r in url_filter.judged(pages, URL_RULES).collect():
        assert (r.host, r.path) == parts(urls[r.page_id])
        assert r.rule == rule(r.host, r.path)[0] and r.verdict == want[urls[r.page_id]]


def test_odd_urls(spark):
    rows = [(1, None), (1, None), (None, "http://A.org/x"), (2, ""), (3, "no scheme/x"), (4, "http://ORG"), (5, "http://example.org/es/a?b#c"), (6, "x://u:p@Ä.com/fr/?q"), (7, "http://notorg/x"), (8, "http://example.org/en/12"), (9, "http://h/" + "ab" * 20_000)]
    df = spark.createDataFrame([(i, u, "h") for i, u in rows], "page_id long, url string, host string")
    got = sorted(((r.page_id or 0, r.host, r.path[:20], r.rule) for r in url_filter.judged(df, URL_RULES).collect()), key=str)
    want = sorted(((i or 0, *parts(u)[:1], parts(u)[1][:20], rule(*parts(u))[0]) for i, u in rows), key=str)
    assert got == want
    assert url_filter.judged(df.where("false"), URL_RULES).collect() == []
