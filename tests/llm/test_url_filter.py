import numpy as np
import pytest

from recollect.llm import url_filter as u

ODD = [None, "", "no scheme", "://", "http://", "http://COM/a", "http://Example.com", "http://example.com?x=/en/", "http://a.b.example.com/en/x#?", "http://www.example.com/en/1?a=1&b=2", "http://wwww.example.com/en/",
       "http://notexample.com/en/", "http://net/es/a", "http://x.net/fr", "http://x.net/fr/", "ftp://x.net/fr/://y.com/", "http://x.net:80/fr/", "http://É.com/é", "http://x.com/a\nb?c", "x" * 50_000 + "://a.com/", "http://" + "a." * 3000 + "com/"]


def split(url):
    """Host and path by the words of the contract."""
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[end:]
    stop = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), tail[:stop]


def decide(host, path):
    fits = []
    for verdict, rule in u.RULES:
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


def test_parts_and_rules_against_plain_words(spark):
    urls = ODD + [r["url"] for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("url").collect()]
    known = u.Rules(u.RULES)
    for url in urls:
        assert u.parts(url)[:2] == split(url)
        assert known.find(*split(url)) == decide(*split(url))


def test_query_whole_table(spark):
    got = {r["page_id"]: r for r in u.op12_url_trees(spark, "/root/testdata/sf0.01").collect()}
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    assert len(got) == len(pages)
    model = u.fit(u.labelled(spark.createDataFrame(pages), u.RULES))
    scores = model.predict([p["url"] for p in pages])
    for p, s in zip(pages, scores, strict=True):
        host, path = split(p["url"])
        rule, verdict = decide(host, path)
        r = got[p["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] == (verdict or ("block" if s >= 0.5 else "allow")) and abs(r["score"] - s) < 1e-12


def test_odd_rows_and_clashing_names(spark):
    rows = [(i, url, "x") for i, url in enumerate(ODD)] + [(None, "http://x.org/", "x"), (3, "http://x.org/", "x"), (3, "http://x.org/", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, blocked string")
    got = u.judge(pages, u.RULES, u.fit(u.labelled(pages, u.RULES)), ["page_id", "blocked", "url"]).collect()
    assert len(got) == len(rows) and all(r["verdict"] in ("allow", "block") and 0 <= r["score"] <= 1 for r in got)
    with pytest.raises(ValueError):
        u.judge(pages.withColumnRenamed("blocked", "Score"), u.RULES, u.Model(np.zeros((u.BUCKETS, u.FOLDS, 3), np.int64), 0.0, None), ["Score"])
    empty = pages.limit(0)
    model = u.fit(u.labelled(empty, u.RULES))
    assert model.trees is None and u.judge(empty, u.RULES, model, ["page_id"]).count() == 0
    alone = spark.createDataFrame([(1, "http://a.com/"), (2, "http://a.org/")], "page_id long, url string")
    assert {r["verdict"] for r in u.judge(alone, u.RULES, u.fit(u.labelled(alone, u.RULES)), ["page_id"]).collect()} == {"allow"}


def test_suffix_counts_do_not_depend_on_partitions(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    one, many = (u.fit(u.labelled(pages.repartition(n), u.RULES)) for n in (1, 7))
    assert (one.counts == many.counts).all() and (one.trees.leaf == many.trees.leaf).all()
    assert one.counts[:, :, 0].sum() == u.SUFFIXES * pages.count()


def plain_boost(x, y, trees, depth, rate, l2, least):
    """The same trees by a loop over every border that a row's value gives."""
    score = np.full(len(x), np.log(y.mean() / (1 - y.mean())))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)

        def grow(rows, level):
            if level == depth:
                score[rows] += -rate * g[rows].sum() / (h[rows].sum() + l2)
                return
            best = (1e-9, None)
            for k in range(x.shape[1]):
                for v in np.unique(x[:, k])[:-1]:
                    left, right = rows[x[rows, k] <= v], rows[x[rows, k] > v]
                    if h[left].sum() < least / 4 or h[right].sum() < least / 4:
                        continue
                    gain = sum(s * g[r].sum() ** 2 / (h[r].sum() + l2) for s, r in ((1, left), (1, right), (-1, rows)))
                    if gain > best[0] + 1e-12:
                        best = gain, (left, right)
            for part in best[1] or (rows, rows[:0]):
                if len(part):
                    grow(part, level + 1)

        grow(np.arange(len(x)), 0)
    return 1 / (1 + np.exp(-score))


def test_trees_against_plain_boosting():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, (120, 3)).astype(float)
    y = ((x[:, 0] > 2) ^ (x[:, 1] > 3)).astype(float)
    flip = rng.random(120) < 0.1
    y[flip] = 1 - y[flip]
    model = u.boost(x, y, trees=5, depth=3, bins=64)
    assert np.allclose(model.predict(x), plain_boost(x, y, 5, 3, 0.2, 1.0, 5.0))


def test_trees_learn_from_labelled_urls(spark):
    rng = np.random.default_rng(1)
    word = lambda n: "".join(rng.choice(list("abcdefghij"), n))
    rows = []
    for _ in range(3000):
        bad = bool(rng.random() < 0.4)
        host = f"{word(6)}{''.join(rng.choice(list('0123456789'), 6)) if bad else ''}.{rng.choice(['top', 'xyz'] if bad and rng.random() < 0.7 else ['com', 'org'])}"
        rows.append((f"http://{host}/" + "/".join(word(4) for _ in range(int(rng.integers(1, 6)))) + ("?" + "&".join(f"{word(2)}={word(8)}" for _ in range(4)) if bad else ""), bad))
    train, held = rows[:2000], rows[2000:]
    model = u.fit(spark.createDataFrame(train, "url string, blocked boolean"))
    right = (model.predict([r[0] for r in held]) >= 0.5) == np.array([r[1] for r in held])
    assert right.mean() > 0.98
