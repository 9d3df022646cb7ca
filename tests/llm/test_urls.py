"""op12 against a plain restatement in Python, and rows of every odd kind."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest

from farebox.llm import urls
from farebox.llm.queries import QUERIES

PAGES = "page_id long, url string, html string"


def split(url):
    url = url or ""
    if "://" not in url:
        return "", "", url
    tail = url.split("://", 1)[1]
    end = min([tail.find(c) for c in "/?#" if c in tail], default=len(tail))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in tail[:end])
    rest = tail[end:]
    stop = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    return host, rest[:stop], host + rest


def rule_of(host, path):
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


def brute(pages, least_seen=2):
    rows = [(p, *split(u)) for p, u in pages]
    rules = [rule_of(h, x) for _, h, x, _ in rows]
    texts = {(t, r.action if r else "") for (_, _, _, t), r in zip(rows, rules, strict=True)}
    held = {k for k in texts if hashlib.md5(k[0].encode()).hexdigest()[0] in urls.KEPT_OUT}

    def grams(text):
        m = urls.START * 4 + text + urls.END
        return [m[i : i + 5] for i in range(len(m) - 4)]

    n = {"allow": Counter(), "block": Counter()}
    kinds = {"allow": defaultdict(set), "block": defaultdict(set)}
    for text, side in texts - held:
        for g in grams(text) if side else ():
            for k in range(1, 6):
                n[side][g[-k:]] += 1
                kinds[side][g[-k:-1], k].add(g[-1])
    everything = {s: Counter() for s in n}
    for s in n:
        for g, c in n[s].items():
            everything[s][g[:-1], len(g)] += c

    def p(side, g):
        found = urls.UNIFORM
        for k in range(1, 6):
            x = (g[-k:-1], k)
            if everything[side][x] >= least_seen:
                t = len(kinds[side][x])
                found = (n[side][g[-k:]] + t * found) / (everything[side][x] + t)
        return found

    trained = n["allow"] and n["block"]
    score = {}
    for key in texts:
        gs = grams(key[0])
        score[key] = sum(math.log(p("allow", g) / p("block", g)) for g in gs) / len(gs) if trained else 0.0
    bins = {k: max(-1000, min(1000, math.floor(round(v, 6) * 100))) for k, v in score.items()}
    marked = [(bins[k], k[1]) for k in held if k[1]]
    n_a, n_b = (sum(s == x for _, s in marked) for x in ("allow", "block"))
    threshold = 0
    if n_a and n_b:
        def cost(t):
            return sum(s == "allow" and b < t for b, s in marked) * n_b + sum(s == "block" and b >= t for b, s in marked) * n_a

        threshold = min(range(min(0, *(b for b, _ in marked)), 1 + max(b for b, _ in marked)), key=lambda t: (cost(t), abs(t), t))
    out = []
    for (page, h, x, t), r in zip(rows, rules, strict=True):
        key = (t, r.action if r else "")
        out.append((page, h, x, r.name if r else None, r.action if r else "allow" if bins[key] >= threshold else "block"))
    return out


def made(n, seed=5):
    rng = random.Random(seed)
    good, bad = ["garden", "library", "museum", "school"], ["casino", "free-bets", "pills4u", "xxcams"]
    rows = []
    for i in range(n):
        kind = rng.random() < 0.5
        tld = rng.choice(["org", "com"] if kind else ["net", "com"])
        lang = "fr" if tld == "org" and rng.random() < 0.7 else rng.choice(["es", "it"])
        word = rng.choice(good if kind else bad)
        rows.append((i, f"http://www.{word}{rng.randrange(40)}.example.{tld}/{lang}/{word}-{word}/{rng.randrange(900)}"))
    return rows


ODD = [
    (1, None), (2, ""), (3, "no scheme/at/all"), (4, "http://"), (5, "http://NET/x"), (6, "http://a.net"), (6, "http://a.net"),
    (7, "x://b.Example.NET/en/1#t"), (8, "x://example.net/EN/1"), (9, "x://notexample.net/en/"), (10, "x://org/fr/"),
    (11, "x://myorg/fr/"), (12, "x://a.org?/fr/"), (13, "a://b://c/d"), (14, "http://é.org/fr/ü\n?x"), (None, "x://q.com/de/"),
    (15, "http://deep.example.com/" + "long/" * 20_000), (16, "x://w.example.com/de/😀"),
]


@pytest.mark.parametrize("pages", [made(600) + ODD, ODD, [], [(i, "http://x.org/fr/1") for i in range(50)]])
def test_as_the_plain_restatement(spark, pages):
    frame = spark.createDataFrame([(p, u, "x") for p, u in pages], PAGES)
    for name in ("host", "path", "rule", "text", "action", "side", "gram", "id", "score", "bin"):
        frame = frame.selectExpr("*", f"'clash' AS {name}")
    got = urls.judge(frame).drop("score")
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute(pages)))


def test_models_tell_unruled_urls_apart(spark):
    frame = spark.createDataFrame([(p, u, "x") for p, u in made(600)], PAGES)
    rows = [r for r in urls.judge(frame).where("rule IS NULL").collect()]
    good = ("garden", "library", "museum", "school")
    right = sum((r.verdict == "allow") == any(g in r.host for g in good) for r in rows)
    assert len(rows) > 100 and right / len(rows) > 0.9


def test_only_built_in_functions(spark):
    plan = QUERIES["op12_url_filter"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not [w for w in ("Python", "Pandas", "Arrow", "ExistingRDD", "CartesianProduct", "NestedLoop") if w in plan]
