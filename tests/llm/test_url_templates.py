import math
import re
from collections import defaultdict

import pytest

from lanternql.llm import url_templates as q

URLS = [
    None, "", "no scheme/at/all", "http://", "http://h", "HTTP://EXAMPLE.org/es/1?q#f", "https://a.example.org/en/12", "https://example.org/en/2", "https://notexample.org/es/",
    "x://y://z/a", "http://www.Ünï.com/fr/ä", "http://com/de/", "http://b.com/de", "http://org", "http://org?x/", "http://h#/a", "http://h/a//b/", "http://h/{n}/x", "http://h/2020-01-02/deadbeef99/v2.html",
    "http://h/1/2/3/4/5/6/7/8/9", "http://h/a\nb/c", "http://user@h:80/p", "ftp://h//",
]


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = re.split("[?#]", rest[end:])[0]
    return host, path


def brute_rule(host, path):
    fits = [(h + p, v) for v, h, p in q.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda f: len(f[0])) if fits else None


def pages():
    out = list(URLS)
    for i in range(60):
        out += [f"http://good.net/news/{i}.html", f"http://good.net/blog/{i}", f"http://mixed.net/spam/{i}", f"http://mixed.net/fine/{i}", f"http://slug.net/post/title-{'abcdefghij'[i % 10]}{'klmnopq'[i % 7]}{'rstuv'[i % 5]}/view"]
    out += ["http://good.net/news/1.html"] * 3
    return [(i, u, "<html>", "x") for i, u in enumerate(out)] + [(None, "http://good.net/news/5.html", "", "x")]


def labels():
    return [(i, "/spam/" in (u or "")) for i, u, _, _ in pages() if i is not None and i % 2 == 0 and u] + [(None, True), (4, None), (10**6, True)]


def judged(spark, rows=None, marks=None):
    df = spark.createDataFrame(pages() if rows is None else rows, "page_id long, url string, html string, host string")
    return q.judge(df, spark.createDataFrame(labels() if marks is None else marks, "page_id long, bad boolean"))


def brute_templates(rows, marks):
    """The tree by the definition, a level at a time, on plain dictionaries."""

    def typed(s):
        stem, ext = re.sub(r"\.[A-Za-z]{1,5}$", "", s), (re.search(r"\.[A-Za-z]{1,5}$", s) or [""])[0]
        for pattern, kind in [(r"[0-9]+", "{n}"), (r"[0-9]{4}-[0-9]{2}(-[0-9]{2})?", "{d}"), (r"(?=.*[0-9])[0-9a-fA-F-]{8,}", "{h}")]:
            if re.fullmatch(pattern, stem):
                return kind + ext
        return "{x}" + ext if re.search("[0-9]", stem) else "{x}" if s.startswith("{") else s

    bad = defaultdict(list)
    for i, b in marks:
        if i is not None and b is not None:
            bad[i].append(b)
    stats, shape = defaultdict(lambda: [0, 0, 0]), {}
    for i, url, _, _ in rows:
        host, path = brute_parts(url)
        parts = re.sub("^/", "", path).split("/") if path not in ("", "/") else []
        parts = parts[: q.MAX_DEPTH - 1] + ["{rest}"] if len(parts) > q.MAX_DEPTH else parts
        segs = tuple(map(typed, parts)) if len(parts) <= q.MAX_DEPTH else tuple(parts)
        segs = tuple("{x}" if s == "{rest}" else s for s in segs)
        shape[i, url] = host, segs
        s = stats[host, segs]
        s[0] += 1
        s[1] += len(bad[i]) if i is not None else 0
        s[2] += sum(bad[i]) if i is not None else 0
    name = {k: "" for k in stats}
    for level in range(q.MAX_DEPTH):
        child = defaultdict(lambda: [0, 0, 0])
        for (h, segs), s in stats.items():
            if len(segs) > level:
                c = child[h, name[h, segs], segs[level]]
                for j in range(3):
                    c[j] += s[j]
        node = defaultdict(dict)
        for (h, t, seg), c in child.items():
            node[h, t][seg] = c
        new = {}
        for (h, t), kids in node.items():
            total = sum(c[0] for c in kids.values())
            literal = [s for s in kids if not s.startswith("{")]
            rare = {s for s in literal if kids[s][0] < total * q.MIN_SHARE or len(literal) > q.MAX_LITERALS}
            common = [s for s in literal if s not in rare]
            n, b = (sum(kids[s][j] for s in common) for j in (1, 2))
            p = b / n if n else 0.0
            for s in kids:
                same = len(common) > 1 and abs(kids[s][2] - p * kids[s][1]) <= q.Z * math.sqrt(p * (1 - p) * kids[s][1]) + 1e-9
                new[h, t, s] = "{*}" if s in rare else "{+}" if s in common and same else s
        name = {(h, segs): t + ("/" + new[h, t, segs[level]] if len(segs) > level else "") for (h, segs), t in name.items()}
    all_n, all_bad = (sum(s[j] for s in stats.values()) for j in (1, 2))
    rate, by = all_bad / all_n if all_n else 0.0, defaultdict(lambda: [0, 0])
    for (h, segs), s in stats.items():
        by[h, name[h, segs]][0] += s[1]
        by[h, name[h, segs]][1] += s[2]
    out = []
    for i, url, _, _ in rows:
        h, segs = shape[i, url]
        n, b = by[h, name[h, segs]]
        out.append((i, url, h + name[h, segs], (b + q.PRIOR * rate) / (n + q.PRIOR)))
    return out


@pytest.mark.parametrize("marks", [None, []])
def test_against_brute_force(spark, marks):
    got = judged(spark, marks=marks).collect()
    want = []
    for i, url, template, purity in brute_templates(pages(), labels() if marks is None else marks):
        host, path = brute_parts(url)
        rule = brute_rule(host, path)
        verdict = rule[1] if rule else "block" if purity >= q.REJECT else "allow"
        want.append((str(i), host, path, rule[0] if rule else None, verdict, template, round(purity, 9)))
    assert sorted(map(str, ((str(r.page_id), r.host, r.path, r.rule, r.verdict, r.template, round(r.purity, 9)) for r in got))) == sorted(map(str, want))
    if marks is None:
        blocked = {r.template for r in got if r.rule is None and r.verdict == "block"}
        assert blocked == {"mixed.net/spam/{n}"}
        assert any(r.template == "slug.net/post/{*}/view" for r in got) and any(r.template == "good.net/{+}/{n}" for r in got)
    else:
        assert all(r.verdict == "allow" for r in got if r.rule is None)


def test_no_python_in_the_plan(spark):
    plan = judged(spark)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty(spark):
    assert judged(spark, rows=[]).collect() == []


def test_too_many_rules(spark):
    with pytest.raises(ValueError):
        q.rule_for(q.F.col("host"), q.F.col("path"), [("block", f"h{i}", "/") for i in range(3000)])


def branchy(slugs, small=0):
    """A host half /casino/, all bad, and half /news/, clean, with one-off slugs and a small bad branch."""
    urls = [f"http://big.net/{kind}/{i}" for i in range(300) for kind in ("casino", "news")]
    urls += [f"http://big.net/slug{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'abcdefghijklmnopqrstuvwxyz'[i // 26]}/{i}" for i in range(slugs)]
    urls += [f"http://big.net/pills/{i}" for i in range(small)]
    rows = [(i, u, "", "x") for i, u in enumerate(urls)]
    return rows, [(i, "/casino/" in u or "/pills/" in u) for i, u, _, _ in rows]


@pytest.mark.parametrize("slugs", [30, 31, 200])
def test_branches_keep_their_templates_whatever_their_number(spark, slugs):
    rows, marks = branchy(slugs, small=12)
    got = judged(spark, rows, marks).collect()
    blocked = {r.template for r in got if r.verdict == "block"}
    assert blocked == {"big.net/casino/{n}", "big.net/pills/{n}"}
    assert {r.template for r in got if "/slug" in r.path} == {"big.net/{*}/{n}"}


def test_a_rare_branch_with_few_labels_is_pooled(spark):
    rows, marks = branchy(200, small=1)
    assert "big.net/{*}/{n}" in {r.template for r in judged(spark, rows, marks).collect() if "/pills/" in r.path}


def test_deep_branches_are_told_apart(spark):
    urls = [f"http://deep.net/a/b/c/d/e/{kind}/{i}{tail}" for i in range(40) for kind in ("spam", "docs") for tail in ("", "/more/of/it")]
    rows = [(i, u, "", "x") for i, u in enumerate(urls)]
    got = judged(spark, rows, [(i, "/spam/" in u) for i, u, _, _ in rows]).collect()
    assert len(got) == len(rows) and all((r.verdict == "block") == ("/spam/" in r.path) for r in got)


def test_the_method_blocks_what_no_rule_covers(spark):
    rules = [("block", "h.net", "/spam/1"), ("allow", "h.net", "/fine/1")]
    rows = [(2 * i + (kind == "fine"), f"http://h.net/{kind}/{i}", "", "x") for i in range(10, 400) for kind in ("spam", "fine")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string").selectExpr("*", "'mine' AS template", "'mine' AS path", "'mine' AS shape", "1 AS n", "'mine' AS segs")
    got = q.judge(pages, q.rule_labels(pages, rules), rules).collect()
    open_ = [r for r in got if r.rule is None]
    assert len(got) == len(rows) and len(open_) > 400
    assert all((r.verdict == "block") == r.path.startswith("/spam/") for r in open_)
