import random
import re
from collections import Counter, defaultdict

from tidefold.llm import urls as U

from .conftest import with_clashes


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule_of(host, path, rules):
    fit = [(h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, key=lambda x: len(x[0]), default=(None, None))


def brute(rows, rules):
    """The tree of each host as nested counts."""
    judged = [(i, *parts(u)) for i, u in rows]
    judged = [(i, h, p, *rule_of(h, p, rules)) for i, h, p in judged]
    shape = {}
    for _, _, p, _, _ in judged:
        shape[p] = tuple(re.sub(r"[0-9]+", "{n}", p).split("/"))
    out = {}
    verdicts = [v for *_, v in judged if v]
    overall = (verdicts.count("block") + 1) / (len(verdicts) + 2)
    by_host = defaultdict(list)
    for i, h, p, rule, verdict in judged:
        by_host[h].append((shape[p], verdict))
    for h, own in by_host.items():
        template = {s: "" for s, _ in own}
        n = Counter(s for s, _ in own)
        for d in range(max(map(len, template))):
            child, node = Counter(), Counter()
            for s in template:
                if len(s) > d:
                    child[template[s], s[d]] += n[s]
                    node[template[s]] += n[s]
            template = {
                s: t if len(s) <= d else t + "/" + (s[d] if child[t, s[d]] * U.SHARE >= node[t] else "*")
                for s, t in template.items()
            }
        bad, known = Counter(), Counter()
        for s, v in own:
            if v:
                known[template[s]] += 1
                bad[template[s]] += v == "block"
        pools = defaultdict(list)
        for t in set(template.values()):
            segs = t.split("/")
            for d in range(2, len(segs)):
                if known[t] >= U.MIN_LABELS:
                    pools["/".join([*segs[:d], "*", *segs[d + 1 :]])].append((t, d))
        merged, at = {t: t for t in set(template.values())}, Counter()
        for pool, ts in pools.items():
            all_bad, every = sum(bad[t] for t, _ in ts), sum(known[t] for t, _ in ts)
            rate = all_bad / every
            for t, d in ts:
                rest = every - known[t]
                spread = (rate * (1 - rate) * every * known[t] * rest) ** 0.5
                if len(ts) > 1 and d > at[t] and abs(bad[t] * rest - (all_bad - bad[t]) * known[t]) <= U.Z * spread:
                    merged[t], at[t] = pool, d
        b, k, nb, nk = Counter(), Counter(), Counter(), Counter()
        for t, m in merged.items():
            b[m] += bad[t]
            k[m] += known[t]
            segs = t.split("/")
            for d in range(2, len(segs)):
                nb["/".join(segs[:d])] += bad[t]
                nk["/".join(segs[:d])] += known[t]
        for s, t in template.items():
            rate, segs = overall, t.split("/")
            for d in range(2, len(segs)):
                node = "/".join(segs[:d])
                rate = (nb[node] + U.ALPHA * rate) / (nk[node] + U.ALPHA) if nk[node] else rate
            m = merged[t]
            out[h, s] = "block" if (b[m] + U.ALPHA * rate) / (k[m] + U.ALPHA) >= U.REJECT_AT else "allow"
    return sorted(((i, h, p, rule, verdict or out[h, shape[p]]) for i, h, p, rule, verdict in judged), key=repr)


def check(spark, rows, rules=U.RULES):
    df = with_clashes(spark.createDataFrame([(i, u, "<html>") for i, u in rows], "page_id long, url string, html string"))
    got = U.filter_urls(df, rules).select("page_id", "host", "path", "rule", "verdict")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, rules)


def test_rules_and_odd_urls(spark):
    urls = [
        None, "", "no scheme", "http://", "://x", "https://EXAMPLE.net/en/1?x#y", "https://example.net/en", "http://a.example.com/de/9#t",
        "http://notexample.com/de/9", "ftp://x.org/fr/a://b", "http://Ä.NET/É", "http://net", "http://net/", "http://a.net?q=/", "http://a.net:80/x",
        "http://example.net/en/\n/x", "http://a.example.com/de/9#t",
    ]
    check(spark, [(k, u) for k, u in enumerate(urls)] + [(None, "http://q.net/1"), (3, "http://")])


def test_of_rules_as_long_the_first_listed_counts(spark):
    for rules in ([("block", "a.test", "/"), ("allow", "a.test", "/")], [("allow", "b.a.test", "/"), ("block", "a.test", "/xy")]):
        for own in (rules, rules[::-1]):
            check(spark, [(1, "http://b.a.test/xyz"), (2, "http://a.test/xyz")], own)


def test_deep_and_long_urls(spark):
    deep = "http://deep.test/" + "d/" * 3000
    rows = [(1, deep + "a"), (2, deep + "b"), (3, deep + "b"), (4, "http://deep.test/" + "x" * 200_000), (5, "http://deep.test/" + "1/" * 3000)]
    rules = [("block", "deep.test", "/" + "d/" * 3000 + "b"), *U.RULES]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: r for r in U.filter_urls(df, rules).collect()}
    assert [got[k].verdict for k in (2, 3)] == ["block"] * 2 and got[1].template.endswith("/d/a") and got[1].template.count("/") == 3002
    assert got[1].purity > got[4].purity  # the blocked branch is nearer


def test_branches_that_differ_below_the_eighth_segment(spark):
    path = "/".join("abcdefghij")
    rows = [(k, f"http://h.test/{path}/{'spam' if k % 2 else 'ham'}/{k}") for k in range(60)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)], "page_id long, bad int")
    got = {r.page_id: r.verdict for r in U.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), [], labels).collect()}
    assert all(got[k] == ("block" if k % 2 else "allow") for k in range(60))


def test_held_out_pages_of_the_rules_and_pages_without_a_rule(spark):
    import zlib

    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    ruled = {r.page_id: r for r in U.filter_urls(pages, U.RULES).collect()}
    truth = {k: r.verdict for k, r in ruled.items() if r.rule is not None}
    out = {k for k in truth if zlib.crc32(str(k).encode()) % 5 == 0}
    labels = spark.createDataFrame([(k, int(v == "block")) for k, v in truth.items() if k not in out], "page_id long, bad int")
    got = {r.page_id: r.verdict for r in U.filter_urls(pages, [], labels).collect() if r.page_id in out}
    right = sum(got[k] == truth[k] for k in out) / len(out)
    majority = Counter(truth[k] for k in out).most_common(1)[0][1] / len(out)
    assert right > majority + 0.2
    assert {r.verdict for r in ruled.values() if r.rule is None} == {"allow", "block"}


def test_templates_of_busy_hosts(spark):
    rng = random.Random(10)
    rules = [*U.RULES, ("block", "shop.test", "/buy/"), ("allow", "shop.test", "/view/")]
    rows = []
    for i in range(900):
        host = rng.choice(["shop.test", "shop.test", "m.shop.test", "news.example.org", "x.example.com"])
        path = rng.choice(["/buy/{}", "/view/{}/a", "/sell/{}", "/{}/deep/er/and/de/ep/er/still/{}", "/de/{}", "/fr/{}", "/buy2/{}", "/u/{}"])
        word = rng.choice(["10", "77.html", f"slug{rng.choice('abcdefgh')}x", "abc"])
        rows.append((i, f"http://{host}{path.format(word, word)}?z={i}"))
    check(spark, rows, rules)


def test_a_template_of_blocked_labels_is_rejected(spark):
    pages = [(k, f"http://h.test/spam/{k}") for k in range(40)] + [(100 + k, f"http://h.test/ham/{k}") for k in range(40)]
    df = spark.createDataFrame(pages, "page_id long, url string")
    labels = spark.createDataFrame([(k, 1) for k in range(20)] + [(100 + k, 0) for k in range(20)], "page_id long, bad int")
    got = {r.page_id: r.verdict for r in U.filter_urls(df, [], labels).collect()}
    assert all(got[k] == "block" for k in range(40)) and all(got[100 + k] == "allow" for k in range(40))


def test_empty_table(spark):
    assert U.filter_urls(spark.createDataFrame([], "page_id long, url string"), U.RULES).collect() == []


def test_oracle_sql(spark):
    import duckdb

    rng = random.Random(17)
    rules = [*U.RULES, ("block", "shop.test", "/buy/"), ("allow", "shop.test", "/view/")]
    rows = [(k, f"http://{rng.choice(['shop.test', 'a.shop.test'])}/{rng.choice(['buy', 'view', 'x'])}/{rng.choice(['a', 'b9', 'deadbeef' * 3])}/{'d/' * rng.randrange(10)}") for k in range(600)]
    rows += [(900, None), (901, ""), (902, "http://Q.NET/1?x"), (902, "http://Q.NET/1?x")]
    c = duckdb.connect()
    rows += [(1000 + k, f"http://b{k % 3}.example.com/{'de' if k % 4 else 'en'}/{k}/") for k in range(90)]
    c.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    c.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    want = c.execute("SELECT page_id, host, path, rule, verdict, template, n_labels, purity FROM (" + U.oracle(rules) + ")").fetchall()
    got = U.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), rules)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)
