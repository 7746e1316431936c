from itertools import combinations

import numpy as np

from tidemark.llm import url_rules as U


def plain(url):
    """(host, path) by the contract's words."""
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    k = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:k], rest[k:]
    k = min([rest.index(c) for c in "?#" if c in rest] or [len(rest)])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:k]


def by_list(host, path):
    fits = [(h + p, v) for v, h, p in U.LISTS if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda r: len(r[0]), default=(None, None))


URLS = [
    None, "", "no scheme", "http://", "http://A.Example.NET/en/x", "https://example.net/de/", "http://example.com/de/1?x=/en/", "http://myexample.com/de/1", "http://x.org/fr/", "http://org/fr/a#b", "http://x.org/FR/",
    "http://x.net", "http://x.net/", "ftp://b://c/d", "http://h?x://y/z", "http://É.net/a", "http://u\n.net/a\nb?c", "http://net/q", "http://sub.example.com/de", "http://x.org/fr/" + "a" * 100_000,
]


def test_hosts_paths_and_lists(spark):
    pages = spark.createDataFrame([(k, u, "h", "r") for k, u in enumerate(URLS)] * 2, "page_id long, url string, host string, rule string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = U.judge_urls(pages, labels).collect()
    assert len(rows) == 2 * len(URLS)
    for r in rows:
        host, path = plain(URLS[r["page_id"]])
        rule, verdict = by_list(host, path)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow")
    assert U.judge_urls(pages.limit(0), labels).collect() == []


def corpus(n=600):
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for k in range(n):
        host, lang, kind = rng.choice(["aa", "bb", "cc"]), rng.choice(["en", "de"]), rng.choice(["shop", "news"])
        rows.append((k, f"http://{host}.test/{lang}/{kind}/{k}?ref={k}"))
        bad = (host == "aa" and kind == "shop") or rng.random() < 0.05
        if k % 3:
            labels.append((k, int(not bad), None))
    return rows, labels


def brute_rules(transactions, support, lift, z=3.0):
    """All sets of items (tokens of the same rows are one) by counting, pruned as the operator says."""
    n, base = len(transactions), sum(b for _, b in transactions) / len(transactions)
    rows = {}
    for k, (tokens, _) in enumerate(transactions):
        for t in tokens:
            rows.setdefault(t, set()).add(k)
    items = {}
    for t, own in rows.items():
        items.setdefault(frozenset(own), []).append(t)
    names = {min(ts): (tuple(sorted(ts)), own) for own, ts in items.items() if len(own) >= max(support * n, 20)}
    rules, out = {}, {}
    for k in range(1, len(names) + 1):
        for c in combinations(sorted(names), k):
            own = frozenset.intersection(*(names[t][1] for t in c))
            hit = sum(transactions[r][1] for r in own)
            if hit < max(support * n, 20):
                continue
            share, m = hit / len(own), len(own)
            low = (share + z * z / 2 / m - z * (share * (1 - share) / m + z * z / 4 / m / m) ** 0.5) / (1 + z * z / m)
            if share < lift * base or low <= base:
                continue
            if all(share > rules[p] + 1e-9 for j in range(1, k) for p in combinations(c, j) if p in rules):
                rules[c] = share
                out[tuple(sorted(t for x in c for t in names[x][0]))] = share
    return out


def test_mined_rules_against_counting(spark):
    rows, labels = corpus()
    pages = spark.createDataFrame(rows, "page_id long, url string")
    split = U.split_urls(pages).withColumn("tokens", U.tokens())
    tokens = {r["page_id"]: r["tokens"] for r in split.collect()}
    assert set(tokens[0]) >= {"h:test", "p:#", "q:ref"}
    frame = spark.createDataFrame([(tokens[k], q == 0) for k, q, _ in labels], "tokens array<string>, bad boolean")
    rules = U.mine(frame, 0.05, 1.2)
    want = brute_rules([(tokens[k], q == 0) for k, q, _ in labels], 0.05, 1.2)
    assert {r[0]: round(r[1], 9) for r in rules} == {k: round(v, 9) for k, v in want.items()}
    assert ("h:aa", "p:shop") in want


def test_verdicts_follow_the_rules(spark):
    rows, labels = corpus()
    pages, marks = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels * 2, "doc_id long, quality int, toxic int")
    found = {r["page_id"]: r for r in U.judge_urls(pages, marks, 0.05, 3.0).collect()}
    for k, url in rows:
        assert found[k]["verdict"] == ("block" if "aa.test" in url and "/shop/" in url else "allow")


def test_no_bad_label_gives_no_rule(spark):
    frame = spark.createDataFrame([(["h:a"], False)] * 50, "tokens array<string>, bad boolean")
    assert U.mine(frame, 0.1, 1.5) == [] and U.mine(frame.limit(0), 0.1, 1.5) == []


def test_long_urls_keep_all_tokens(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(400):
        bad = k % 4 == 0
        weak = [f"q:k{i}" for i in range(40) if rng.random() < 0.02]
        rows.append((["h:x", *[f"p:{i}" for i in range(60)], *weak, *(["q:u", "q:v"] if bad else [str(rng.choice(["q:u", "q:v"]))])], bad))
    rules = U.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), 0.05, 1.5)
    assert [r[0] for r in rules] == [("q:u", "q:v")] or ("q:u", "q:v") in {r[0] for r in rules}


def test_query(spark, data):
    rows = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    found = U.op1_url_filter(spark, data)
    assert found.columns[:5] == ["page_id", "host", "path", "rule", "verdict"]
    got = found.collect()
    assert sorted(r["page_id"] for r in got) == sorted(rows)
    for r in got:
        host, path = plain(rows[r["page_id"]])
        rule, verdict = by_list(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] == (verdict or ("block" if r["mined"] else "allow"))


def test_one_row_of_many_frequent_tokens_costs_no_rule(spark):
    names = [f"p:w{k}" for k in range(22)]
    rows = [([n], True) for n in names for _ in range(25)] + [(names, True)] + [([f"p:z{k % 7}"], False) for k in range(1200)]
    rules = U.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), 0.002, 1.5)
    assert sorted(need for need, _, _ in rules) == sorted((n,) for n in names)
    assert {round(s * len(rows)) for _, _, s in rules} == {26}
