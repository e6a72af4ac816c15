import re

from timberline.llm import urlfilter


def brute_rule(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    best = None
    for rule, verdict in urlfilter.RULES:
        domain, _, start = rule.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, best


URLS = [
    None, "", "no scheme", "http://A.Example.NET/en/1?x=/de/", "https://x.example.net/de/1", "http://net/", "http://net", "http://notnet.com/en", "http://b.example.com/de/", "http://b.example.com/de",
    "http://example.com/fr/3#a", "x://org/fr/1", "x://a.org/fr", "http://h?q=://z.net/", "http://É.net/a", "http://a.net?x", "a://b://c.net/", "http://multi\nline.net/x",
]


def test_rules_equal_brute_force(spark):
    frame = spark.createDataFrame([(k, u, "clash", "clash") for k, u in enumerate(URLS)], "page_id long, url string, host string, template string")
    got = {r.page_id: r for r in urlfilter.judge(frame).collect()}
    assert len(got) == len(URLS)
    for k, u in enumerate(URLS):
        host, path, best = brute_rule(u)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, best and best[0]), u
        assert got[k].verdict == (best[1] if best else got[k].verdict) and got[k].verdict in ("allow", "block")
    assert urlfilter.judge(frame.limit(0)).count() == 0


def brute_tree(rows, max_children=16):
    """The tree of templates, host by host and node by node: {(host, shape): (template, purity, labels)}."""
    weight, base = sum(urlfilter.PRIOR), urlfilter.PRIOR[0] / sum(urlfilter.PRIOR)
    urls = []
    for host, path, bad in rows:
        segs = tuple("*" if re.search("[0-9]", s) or len(s) > urlfilter.MAX_SEGMENT else s for s in path.split("/") if s)
        urls.append((host, segs, bad))

    def count(part):
        marks = [bad for _, _, bad in part if bad is not None]
        return len(part), len(marks), sum(marks)

    def estimate(part, prior):
        _, n, b = count(part)
        return (b + weight * prior) / (n + weight)

    def down(part, purity):
        n, labels, _ = count(part)
        return base + labels / n * (purity - base)

    def domain(host):
        name = re.sub(":[0-9]*$", "", host)
        return name if re.fullmatch("[0-9.]*", name) else ".".join(name.split(".")[-2:])

    out = {}

    def visit(part, pool, purity, template, level):
        all_, n, b = count(part)
        if n < urlfilter.MIN_LABELS or (n == all_ and b in (0, n)) or template.endswith("/"):
            for host, segs, _ in part:
                out[host, "/".join(segs)] = (template or "/", round(purity, 9), count(pool)[1])
            return
        kids = {}
        for u in part:
            kids.setdefault(u[1][level] if level < len(u[1]) else "", []).append(u)
        wide, sides, share = sum(s not in ("", "*") for s in kids) > max_children, {}, b / n
        for s, kid in kids.items():
            _, kn, kb = count(kid)
            if kn < urlfilter.MIN_LABELS or (wide and s == "*"):
                sides[s] = urlfilter.UNPROVEN
            else:
                apart = abs(kb / kn - share) > urlfilter.Z * (share * (1 - share) / kn) ** 0.5
                sides[s] = ((kb / kn > share) - (kb / kn < share)) if apart else 0
        pieces = {}
        for s, kid in kids.items():
            pieces.setdefault(("*" if sides[s] == urlfilter.UNPROVEN and wide and s else s, sides[s]), []).extend(kid)
        for (piece, side), merged in pieces.items():
            pooled = [u for s, kid in kids.items() if sides[s] == side for u in kid]
            visit(merged, pooled, estimate(pooled, down(pool, purity)), f"{template}/{piece}", level + 1)

    for d in {domain(u[0]) for u in urls}:
        inside = [u for u in urls if domain(u[0]) == d]
        known = down(inside, estimate(inside, base))
        for host in {u[0] for u in inside}:
            own = [u for u in inside if u[0] == host]
            visit(own, own, estimate(own, known), "", 0)
    return out


def tree_of(spark, rows, **kw):
    got = urlfilter.template_tree(spark.createDataFrame(rows, "host string, path string, bad int"), **kw).collect()
    return {(r.host, r["shape"]): (r.template, round(r.purity, 9), r.labels) for r in got}


def test_tree_equals_brute_force(spark):
    import random

    r, rows = random.Random(8), []
    for host in ("a.h.com", "b.h.com", "h.com", "lone.org", "1.2.3.4:80", ""):
        for _ in range(250):
            path = "/" + "/".join(r.choice(["x", "y", "z", f"n{chr(97 + r.randrange(26))}{chr(97 + r.randrange(3))}", str(r.randrange(99))]) for _ in range(r.randrange(6)))
            bad = None if r.random() < 0.4 else int(r.random() < (0.9 if "/x" in path else 0.2 if "/y" in path else 0.5))
            rows.append((host, path, bad if host != "lone.org" else None))
    for most in (3, 16):
        got = tree_of(spark, rows, max_children=most)
        assert got == brute_tree(rows, most)
    assert len({t for t, _, _ in got.values()}) > 20 and any(t.count("/") >= 3 for t, _, _ in got.values())


def test_branches_that_differ_stay_apart(spark):
    rows = [("h.com", f"/news/{k}", 1 if k % 10 else 0) for k in range(100)]  # mostly bad
    rows += [("h.com", f"/blog/{k}.html", 0) for k in range(100)]
    rows += [("h.com", f"/u/name{chr(97 + k % 26)}x", None) for k in range(26)]
    rows += [("h.com", f"/{chr(97 + k // 26)}{chr(97 + k % 26)}", None) for k in range(60)]  # over MAX_CHILDREN constant segments
    got = tree_of(spark, rows)
    assert got["h.com", "news/*"][1] > 0.5 > got["h.com", "blog/*"][1] and got["h.com", "news/*"][0].startswith("/news")
    assert got["h.com", "ab"][0] == "/*" and got["h.com", "u/*" if ("h.com", "u/*") in got else "u/nameax"][0] == "/*"


def test_a_deep_path_is_read_to_its_end(spark):
    start = "/".join("abcdefghij")
    rows = [("h.com", f"/{start}/good/{k}", 0) for k in range(20)] + [("h.com", f"/{start}/bad/{k}", 1) for k in range(20)]
    got = tree_of(spark, rows)
    assert got["h.com", f"{start}/bad/*"][1] > 0.5 > got["h.com", f"{start}/good/*"][1]


def test_the_tree_judges_pages_without_a_rule(spark):
    urls = [f"http://b.example.com/de/{k}" for k in range(90)] + [f"http://b.example.com/en/{k}" for k in range(10)]  # mostly blocked by rule
    urls += [f"http://c.other.com/en/{k}" for k in range(10)] + [f"http://x.org/fr/{k}" for k in range(90)] + ["http://x.org/en/1"]
    got = urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    free = {(r.host, r.verdict) for r in got if r.rule is None}
    assert free == {("b.example.com", "block"), ("c.other.com", "allow"), ("x.org", "allow")}
