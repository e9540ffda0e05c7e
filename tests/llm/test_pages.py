"""URL templates, archives and exact search: oracle SQL, brute force, round trips and edge cases."""

from __future__ import annotations

import base64
import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.llm import search, url_templates, warc
from shelfcast.llm.common import fresh_path
from tests.conftest import SF_SMALL

PAGES = "page_id long, url string, html string"


def pages(spark, rows):
    return spark.createDataFrame(rows, PAGES).select("*", F.lit("x").alias("host"), F.lit("x").alias("key"), F.lit(1).alias("refers_to"))


def oracle(sql, **frames):
    con = duckdb.connect()
    for name, frame in frames.items():
        con.register(name, frame)
    return con.execute(sql).fetchall()


# --- URL templates ----------------------------------------------------------

URLS = [
    None, "", "no scheme/en/1", "http://", "http://COM", "http://com/", "https://Example.COM/en/1?x=/fr/", "http://example.com?q=/en/",
    "http://www.example.com/en/9#top", "http://a.www.example.com/en/9", "http://xexample.com/en/1", "http://a.net/es/1", "http://a.net/es",
    "http://a.net/fr/x://y", "a://b://c/d", "http://é.net/fr/é\n", "http://a.org/" + "x/" * 500, "http://a.net/en/1", "http://a.net/en/1",
]


def test_verdicts_equal_oracle(spark):
    rows = [(k, u, None) for k, u in enumerate(URLS)] + [(100 + k, f"http://h{k % 3}.net/{'es' if k % 2 else 'de'}/{k}.html", "") for k in range(200)]
    df = pages(spark, rows)
    got = sorted(map(tuple, url_templates.judge(df).collect()))
    want = oracle(url_templates.ORACLE_SQL, pages=df.select("page_id", "url").toPandas())
    assert sorted(want) == got
    assert url_templates.judge(pages(spark, [])).count() == 0


def test_templates_reject_what_is_blocked_nearby(spark):
    """Rules for some articles of a branch reject the rest of its template, and no other branch."""
    rules = [(f"h.org/shop/{k}", "block") for k in (1, 2, 3)] + [("h.org/blog/", "allow")]
    rows = [(k, f"http://h.org/shop/{k}", "") for k in range(1000, 2000)]
    rows += [(k, f"http://h.org/blog/{k}", "") for k in range(3000, 3300)]
    rows += [(k, f"http://h.org/news/{k}", "") for k in range(5000, 5300)]
    rows += [(k, f"http://other.org/shop/{k}", "") for k in range(6000, 6010)]
    rows += [(7000 + k, f"http://h.org/shop/{900 + k}", "") for k in range(50)]  # unlabelled, in a blocked template
    got = {r.page_id: r for r in url_templates.judge(pages(spark, rows), rules).collect()}
    assert got[1000].rule == "h.org/shop/1" and got[3000].verdict == "allow"
    assert {got[7000 + k].verdict for k in range(50)} == {"block"}
    assert {got[k].verdict for k in range(5000, 5300)} == {"allow"} and got[6000].verdict == "allow"


def test_rare_segments_become_wildcards_and_siblings_merge(spark):
    rows = [("h", ["u", f"name{k}x"], 1, 1, 1) for k in range(100)] + [("h", ["v", "a"], 60, 50, 1), ("h", ["v", "b"], 60, 50, 2), ("h", ["v", "c"], 60, 50, 49)]
    shapes = spark.createDataFrame(rows, "host string, shape array<string>, n long, labelled long, blocked long")
    got = {tuple(r.shape): r.rejected for r in url_templates.templates(shapes).collect()}
    assert all(got["u", f"name{k}x"] for k in range(100))
    assert (got["v", "a"], got["v", "b"], got["v", "c"]) == (False, False, True)


COUNTS = "host string, shape array<string>, n long, labelled long, blocked long"


def merged_by_hand(leaves):
    """The rule in plain Python: {(host, template): rejected}."""
    label, at = {k: k for k in leaves}, max(len(p) for _, p in leaves)
    total = lambda group: tuple(sum(leaves[k][i] for k in group) for i in (0, 1))
    share = lambda n, b: (b + 1) / (n + 2)

    def gap(x, y):
        (n, b), (m, c) = x[:2], y[:2]
        p = share(n + m, b + c)
        return abs(share(m, c) - share(n, b)) / (p * (1 - p) * (1 / n + 1 / m)) ** 0.5

    for j in reversed(range(at)):
        families = {}
        for k, (host, p) in label.items():
            if len(p) > j:
                families.setdefault((host, p[:j], p[j + 1:]), {}).setdefault(p[j], []).append(k)
        for family in families.values():
            line = [(*total(ks), [name], ks) for name, ks in family.items() if total(ks)[0]]
            line.sort(key=lambda x: (share(*x[:2]), x[2]))
            while len(line) > 1:
                near = min(range(len(line) - 1), key=lambda i: gap(line[i], line[i + 1]))
                if gap(line[near], line[near + 1]) > url_templates.Z:
                    break
                x, y = line[near:near + 2]
                line[near:near + 2] = [(x[0] + y[0], x[1] + y[1], x[2] + y[2], x[3] + y[3])]
            for _, _, names, ks in line:
                for k in ks:
                    label[k] = (k[0], (*label[k][1][:j], min(names), *label[k][1][j + 1:]))
    groups = {}
    for k, to in label.items():
        groups.setdefault(to, []).append(k)
    return {k: share(*total(groups[to])) >= url_templates.REJECT for k, to in label.items()}


def test_branches_do_not_drift(spark):
    """Twenty siblings with 0, 5, ... 95 of 100 pages blocked: each is tested against the pooled branch, so the worst are rejected."""
    rows = [("h", ["u", f"{chr(97 + k)}"], 100, 100, 5 * k) for k in range(20)]
    got = {r.shape[1]: r.rejected for r in url_templates.templates(spark.createDataFrame(rows, COUNTS)).collect()}
    want = merged_by_hand({("h", tuple(s)): (n, b) for _, s, _, n, b in rows})
    assert got == {p[1]: v for (_, p), v in want.items()}
    assert got["t"] and not got["a"] and not got["m"]


def test_branches_with_like_templates_merge(spark):
    """/en/shop is rejected by the labels of /de/shop and /fr/shop; /en/news stays; random tables as by hand."""
    rows = [("h", [lang, "shop"], 100, n, n) for lang, n in (("de", 3), ("fr", 30), ("en", 2))]
    rows += [("h", [lang, "news"], 100, 20, 0) for lang in ("de", "fr", "en")]
    got = {tuple(r.shape): r.rejected for r in url_templates.templates(spark.createDataFrame(rows, COUNTS)).collect()}
    assert got == {(lang, kind): kind == "shop" for lang in ("de", "fr", "en") for kind in ("shop", "news")}
    rng = np.random.default_rng(4)
    rows = []
    for host in ("g", "h"):
        for a in "abcd":
            for b in "pqrs":
                for tail in ([], ["x"], ["y"], ["x", "z"]):
                    labelled = int(rng.integers(0, 40))
                    rows.append((host, [a, b, *tail], 100, labelled, int(rng.binomial(labelled, rng.choice([0.1, 0.5, 0.95])))))
    got = {(r.host, tuple(r.shape)): r.rejected for r in url_templates.templates(spark.createDataFrame(rows, COUNTS)).collect()}
    assert got == merged_by_hand({(h, tuple(s)): (n, b) for h, s, _, n, b in rows}) and len(set(got.values())) == 2


def test_every_segment_can_be_a_level(spark):
    """Paths that differ behind DEPTH segments only share a wildcard there, and have templates of their own without a bound."""
    rules = [("h.org/a/b/c/d/bad/a", "block"), ("h.org/a/b/c/d/good/a", "allow")]
    slugs = [x + y + z for x in "abcde" for y in "fghij" for z in "klmn"]
    rows = [(1000 * g + k, f"http://h.org/a/b/c/d/{name}/{slug}/x", "") for g, name in enumerate(("bad", "good")) for k, slug in enumerate(slugs)]
    df = pages(spark, rows)
    for depth, want in ((url_templates.DEPTH, "allow"), (None, "block")):
        got = {r.page_id: r.verdict for r in url_templates.judge(df, rules, depth).collect()}
        assert got[0] == "block" and got[99] == want and got[1099] == "allow"


def test_levels_of_a_hot_host_need_no_window(spark, monkeypatch):
    """A host with thousands of shapes: rows as the oracle's, and no level sorts all its shapes in one task."""
    rows = [(k, f"http://hot.net/{'es' if k % 3 else 'de'}/slug-{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyzabcd'[k // 100 % 10]}/x", "") for k in range(1000)]
    rows += [(2000 + k, f"http://hot.net/{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}", "") for k in range(100)]
    df, plans = pages(spark, rows), []
    save = url_templates.written

    def watched(table, what):
        plans.append(table._jdf.queryExecution().executedPlan().toString())
        return save(table, what)

    monkeypatch.setattr(url_templates, "written", watched)
    got = sorted(map(tuple, url_templates.judge(df).collect()))
    assert len(plans) == 2 * url_templates.DEPTH + 4 and not any("Window" in p for p in plans)
    assert got == sorted(oracle(url_templates.ORACLE_SQL, pages=df.select("page_id", "url").toPandas()))


def test_no_python_on_the_main_path(spark):
    plan = url_templates.query(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# --- archives ---------------------------------------------------------------

def test_archive_round_trip(spark):
    rows = [(k, f"http://h{k % 7}.org/p{k}", f"<p>{k % 40}</p>" * (k % 9)) for k in range(300)]
    rows += [(400, None, None), (401, "", ""), (402, "http://a.b/\r\nWARC-Type: x", "é\U0001f600"), (403, "http://a.b/long", "y" * 3_000_000), (299, "http://h5.org/p299", rows[299][2])]
    df = pages(spark, rows)
    got = sorted(map(tuple, warc.archive_pages(df).collect()), key=str)
    first = {}
    for p, _, h in sorted(rows, key=lambda r: r[0]):
        first.setdefault(h or "", p)
    want = []
    for p, _, h in rows:
        raw, at = (h or "").encode(), first[h or ""]
        name = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        want.append((p, len(raw), name, "response" if p == at else "revisit", None if p == at else at))
    assert got == sorted(want, key=str)


def test_lookup_reads_one_url(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 16)
    rows = [(k, f"http://h{k % 5}.org/p{k // 2}", f"body {k}") for k in range(400)] + [(900 + k, "http://same.org/x", f"s{k}") for k in range(60)]
    folder = fresh_path(spark, "test-warc")
    files = warc.write_index(warc.write_archives(pages(spark, rows), folder), folder)
    index = warc.CaptureIndex(files, folder)
    assert warc.IndexFile(index.store, index.root, index.files.files[0][2]).places and files.agg(F.sum("blocks")).first()[0] > 20
    for url in ("http://h0.org/p0", "http://h4.org/p199", "http://same.org/x"):
        assert sorted(p.decode() for *_, p in index.lookup(url)) == sorted(h for _, u, h in rows if u == url)
    assert index.lookup("http://absent.org/") == []


def test_read_back_goes_through_the_index(spark, monkeypatch):
    """Only captures of the URLs asked for come back, a key that fills files comes back whole, and a directory out of order is noticed."""
    monkeypatch.setattr(warc, "BLOCK_LINES", 8)
    long = "http://long.org/" + "p" * 100
    rows = [(k, "http://hot.org/", f"h{k}") for k in range(300)] + [(300 + k, f"http://h{k % 9}.org/{k}", f"b{k}") for k in range(600)]
    rows += [(1000 + k, f"{long}{k // 3}", f"l{k}") for k in range(90)] + [(2000, None, None)]
    df, folder = pages(spark, rows), fresh_path(spark, "test-warc")
    files = warc.write_index(warc.write_archives(df, folder), folder)
    ids = lambda got: sorted(r.page_id for r in got.collect())
    assert len(list(warc.FileList(files).holding(warc.url_key("http://hot.org/")))) > 1
    assert ids(warc.read_back(df, files, folder)) == sorted(r[0] for r in rows)
    some = df.where("page_id in (0, 301, 1001, 2000)")
    assert ids(warc.read_back(some, files, folder)) == [*range(300), 301, 1000, 1001, 1002, 2000]
    assert ids(warc.read_back(pages(spark, [(0, "http://absent.org/", "")]), files, folder)) == []
    store, root = warc.open_store(folder)
    for _, _, name in warc.FileList(files).files:
        path = f"{root}/{name}{warc.DIRECTORY}"
        with store.open_input_stream(path, compression=None) as f:
            entries = zlib.decompress(f.read()).split(b"\n")
        with store.open_output_stream(path, compression=None) as f:
            f.write(zlib.compress(b"\n".join(reversed(entries))))
    assert len(ids(warc.read_back(df, files, folder))) < len(rows)


def test_small_payloads_may_stay_responses(spark):
    rows = [(1, "u", ""), (2, "u", ""), (3, "u", "long enough"), (4, "u", "long enough")]
    kinds = {r.page_id: r.record_type for r in warc.archive_pages(pages(spark, rows), least=5).collect()}
    assert kinds == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    assert warc.archive_pages(pages(spark, [])).count() == 0


@pytest.mark.parametrize("url, key", [("http://A.b.Org:80/x?y=1#z", "org,b,a)/x?y=1"), ("", ")"), ("host/path", "host)/path"), ("s://u@h", "h)")])
def test_url_key(url, key):
    assert warc.url_key(url) == key


# --- exact search -----------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_top(rows, k):
    good = {i: [int(np.floor(256 * float(x))) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = set()
    for q in (i for i in good if i % 50 == 0):
        dots = {i: sum(a * b for a, b in zip(good[q], v, strict=False)) for i, v in good.items() if i != q}
        dots = {i: max(-(1 << 63), min((1 << 63) - 1, d)) for i, d in dots.items()}
        top = sorted(dots, key=lambda i: (-dots[i], i))[:k]
        out |= {(q, n, i, dots[i]) for n, i in enumerate(top, 1)}
    return out


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).withColumn("score", F.lit("x")).withColumn("cell", F.lit("x"))


@pytest.fixture(params=["clusters", "ties", "odd"])
def rows(request):
    rng = np.random.default_rng(8)
    if request.param == "clusters":
        centres = rng.normal(size=(12, 8)) * 4
        return [(k, (centres[k % 12] + rng.normal(size=8) * 0.1).astype(np.float32).tolist()) for k in range(900)]
    if request.param == "ties":
        return [(k, [0.5, 0.25] if k % 3 else rng.normal(size=2).astype(np.float32).tolist()) for k in range(700)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [nan, 1.0], [inf, 1.0], [None, 1.0], [1e30, 1.0], [-1e30, 2.0], [1.0, 2.0, 3.0], [0.0, 0.0]]
    return [(k * 25, v) for k, v in enumerate(odd)] + [(None, [1.0, 1.0])] + [(1000 + k, [float(k), -1.0]) for k in range(100)]


def test_search_equals_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 100)
    monkeypatch.setattr(search, "LEAF", 8)
    got = set(map(tuple, search.top_k(vectors(spark, rows), F.col("vec_id") % 50 == 0).collect()))
    assert got == brute_top(rows, search.K)


def test_many_chunks_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(k, rng.normal(size=6).astype(np.float32).tolist()) for k in range(1200)]
    monkeypatch.setattr(search, "BLOCK", 60)
    monkeypatch.setattr(search, "GROUPS", 2)
    got = set(map(tuple, search.top_k(vectors(spark, rows), F.col("vec_id") % 50 == 0).collect()))
    assert got == brute_top(rows, search.K)


def test_search_edges(spark):
    assert search.top_k(vectors(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    few = vectors(spark, [(0, [1.0]), (1, [2.0]), (1, [2.0]), (50, [3.0])])
    got = sorted(map(tuple, search.top_k(few, F.col("vec_id") % 50 == 0).collect()))
    assert got == [(0, 1, 50, 196608), (0, 2, 1, 131072), (50, 1, 1, 393216), (50, 2, 0, 196608)]


def nodes_of(tree, points):
    return [points[tree.order[tree.begin[i]:tree.end[i]]] for i in range(len(tree.radius))]


def share_scored(points, queries):
    """Share of all (query, vector) pairs that the dual search scores."""
    offered, best = [], search.Best(np.arange(len(queries)), queries, 5)
    real = best.offer
    best.offer = lambda rows, ids, at: (offered.append(len(rows) * len(ids)), real(rows, ids, at))
    search.dual_search(best, search.CoverTree(queries), np.arange(len(points)), points, search.CoverTree(points))
    plain = np.sort(queries @ points.T - np.where(np.arange(len(queries))[:, None] == np.arange(len(points)), np.inf, 0), axis=1)[:, ::-1][:, :5]
    assert (best.score == plain).all()
    return sum(offered) / (len(points) * len(queries))


@pytest.mark.parametrize("spread", [0.05, 2.0])
def test_cover_tree_has_levels(spread):
    """Nested centres, covered vectors, separated siblings, radii that halve, and a bound that holds."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 5)) * 10
    points = np.floor(256 * (centres[rng.integers(0, 6, 1500)] + rng.normal(size=(1500, 5)) * spread))
    tree = search.CoverTree(points)
    members = nodes_of(tree, points)
    assert sorted(tree.order.tolist()) == list(range(1500)) and tree.count.max() > 1
    for i, inside in enumerate(members):
        assert np.sqrt(((inside - tree.centre[i]) ** 2).sum(1)).max() <= tree.radius[i]
        kids = tree.kids(i)
        if len(kids):
            assert tree.middle[kids[0]] == tree.middle[i] and sum(len(members[c]) for c in kids) == len(inside)
            assert (tree.radius[kids] <= tree.radius[i] / 2 + tree.room).all()
            apart = np.sqrt(((tree.centre[kids][:, None] - tree.centre[kids]) ** 2).sum(2))
            assert (apart + np.eye(len(kids)) * 1e300 > tree.radius[i] / 2 - tree.room).all()
        for j in range(0, len(members), 7):
            assert (inside @ members[j].T).max() <= search.bound(tree, i, tree, j)


def test_search_prunes_where_vectors_cluster(spark):
    """Few pairs are scored on clusters. On the driver's vectors (random directions) no bound by radii leaves any out."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 8)) * 10
    points = np.floor(256 * (centres[rng.integers(0, 30, 2000)] + rng.normal(size=(2000, 8)) * 0.05))
    assert share_scored(points, points[:600]) < 0.3
    frame = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").orderBy("vec_id").toPandas()
    table = np.floor(256 * np.array(frame["embedding"].tolist(), np.float64))
    share = share_scored(table, table[:40])
    print(f"share of pairs scored on the driver's table: {share:.3f}")
    assert share <= 1
