"""Merkle manifest, centroid clustering and URL filters against plain versions, and their defined cases."""

import gzip
import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import centroids, html_text, merkle, url_rules, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_leaf(r, more=0):
    n = r["n_chars"] if r["n_chars"] is None else r["n_chars"] + more
    return sha("".join(map(plain_field, (r["doc_id"], r["source"], r["lang"], n, r["text"]))))


def plain_tree(hashes, k):
    levels = [hashes]
    while len(levels[-1]) > 1:
        a = levels[-1]
        levels.append([sha("".join(a[i : i + k])) for i in range(0, len(a), k)])
    return levels


def plain_proof(levels, i, k):
    out = []
    for a in levels[:-1]:
        run = i - i % k
        out.append(("".join(a[run:i]), "".join(a[i + 1 : run + k])))
        i //= k
    return out


def plain_manifest(rows, k=2):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row, sorted as text."""
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        own = sorted(groups[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
        trees[g] = own, plain_tree([plain_leaf(r) for r in own], k)
    top = plain_tree([trees[g][1][-1][0] for g in names], k)
    out = []
    for j, g in enumerate(names):
        own, levels = trees[g]
        for i, r in enumerate(own):
            proof = plain_proof(levels, i, k) + plain_proof(top, j, k)
            touched = r["doc_id"] is not None and (zlib.crc32(str(r["doc_id"]).encode()) & 0xFFFFFFFF) % 7 == 0
            node = plain_leaf(r, int(touched))
            for before, after in proof:
                node = sha(before + node + after)
            out.append((r["doc_id"], levels[0][i], levels[-1][0], top[-1][0], sha("".join(a + b for a, b in proof)), node, node == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize(("arity", "height"), [(2, 8), (2, 2), (3, 1), (3, 2)])
def test_merkle_equals_a_plain_tree(spark, arity, height):
    rng = random.Random(arity * 10 + height)
    rows = [(i, f"text {i}" * rng.randint(0, 3), rng.choice(["en"] * 8 + ["de", "é", None, "z"]), "s", rng.choice([None, i])) for i in range(90)]
    rows += [(7, "again", "en", None, 1), (None, None, None, None, None), (None, "x", "en", "s", 2), (3, "", "de", "", 0), (400, "lone", "only", "s", 4)]
    rows += rows[:2]  # repeated rows
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = sorted((tuple(r) for r in merkle.checked(merkle.manifest(docs, arity, height)).collect()), key=str)
    assert got == plain_manifest([r.asDict() for r in docs.collect()], arity)


def test_merkle_finds_each_change(spark):
    docs = spark.createDataFrame([(i, "t", "en" if i % 3 else "de", "s", None if i % 5 == 0 else i) for i in range(60)], DOCS)
    for r in merkle.checked(merkle.manifest(docs)).collect():
        touched = (zlib.crc32(str(r["doc_id"]).encode()) & 0xFFFFFFFF) % 7 == 0 and r["doc_id"] % 5 != 0
        assert r["verified"] is not touched


def test_merkle_of_little(spark):
    assert merkle.checked(merkle.manifest(spark.createDataFrame([], DOCS))).count() == 0
    long = spark.createDataFrame([(1, "long " * 400_000, "en", "s", 2**63 - 1, "clash", "clash")], DOCS + ", leaf string, `group` string")
    row = merkle.checked(merkle.manifest(long)).collect()[0]
    assert row["root"] == row["subroot"] == row["leaf"] == plain_leaf(long.collect()[0])
    touched = spark.createDataFrame([(i, "t", "en", "s", 2**63 - 1) for i in range(40)], DOCS)  # n_chars + 1 fits no long
    assert {r["verified"] for r in merkle.checked(merkle.manifest(touched)).collect()} == {True, False}


# ---- centroids -------------------------------------------------------------------------------------------------------


def plain_clusters(rows, k, rounds, dims, scale, seed):
    exact = lambda x: int(x) * scale if abs(x) > 2**53 else int(np.floor(x * scale))
    kept = [(i, [exact(x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    c = [v for _, v in sorted((r for r in kept if r[0] is not None), key=lambda r: (sha(f"{seed}:{r[0]}"), r[1]))[:k]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min(range(len(c)), key=lambda j: (gap(v, c[j]), j))
    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(nearest(v), []).append(v)
        c = [[sum(col) // len(own[j]) for col in zip(*own[j], strict=True)] if j in own else c[j] for j in range(len(c))]
    said = [(i, j, gap(v, c[j])) for i, v in kept for j in [nearest(v)]]
    whole = sum(d for _, _, d in said)
    return sorted(((i, j, d, sum(x for _, m, x in said if m == j), whole, sha(",".join(map(str, c[j])))) for i, j, d in said), key=str)


def test_clusters_equal_plain_ones_with_ties(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) / 4 for x in rng.integers(-3, 4, 6)]) for i in range(300)]  # few values: many equal distances and centroids
    rows += [(None, [0.0] * 6), (5, [1.0] * 6), (901, None), (902, [1.0] * 5), (903, [float("nan")] + [0.0] * 5), (904, [None] + [0.0] * 5), (905, [float("inf")] * 6), (906, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, cluster string").repartition(5)
    got = sorted((tuple(r) for r in centroids.clusters(df, 12, 4, 6).collect()), key=str)
    assert got == plain_clusters(rows, 12, 4, 6, 256, 2)


def test_clusters_of_large_components_are_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=3) * 10.0 ** rng.integers(0, 6)]) for i in range(60)]
    got = sorted((tuple(r) for r in centroids.clusters(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 5, 3, 3).collect()), key=str)
    assert got == plain_clusters(rows, 5, 3, 3, 256, 2)
    huge = centroids.clusters(spark.createDataFrame([(1, [3e38, 0.0]), (2, [-3e38, 0.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>"), 1, 1, 2).collect()
    assert {r["vec_id"]: r["cluster"] for r in huge} == {1: 0, 2: 0, 3: 0} and all(r["inertia"] is None for r in huge)


def test_clusters_of_little(spark):
    few = spark.createDataFrame([(9, [1.0, 2.0]), (4, [5.0, 6.0])], "vec_id long, embedding array<float>")
    assert sorted((r["vec_id"], r["distance"]) for r in centroids.clusters(few, 40, 5, 2).collect()) == [(4, 0), (9, 0)]
    assert centroids.clusters(few.limit(0), 40, 5, 2).count() == 0
    assert centroids.clusters(few, 40, 5, 3).count() == 0


def test_intervals_hold_the_exact_products():
    rng = np.random.default_rng(5)
    for size in (4, 300, 1 << 20, (1 << 26) - 1):
        q, c = rng.integers(-size, size, (400, 64)), rng.integers(-size, size, (40, 64))
        c[1], q[:20] = c[0] + (np.arange(64) == 0), c[0]  # nearly equal centroids, rows that sit on one
        maybe = centroids.maybe_nearest(q, c)
        exact = ((q[:, None, :] - c[None]) ** 2).sum(axis=2)
        nearest = exact == exact.min(axis=1)[:, None]
        assert maybe[nearest].all(), size  # never screened away
        assert (centroids.assigned(q, c)[0] == exact.argmin(axis=1)).all()
    q, c = rng.integers(-100, 100, (2000, 64)), rng.integers(-100, 100, (40, 64))
    assert centroids.assigned(q, c)[2] < 100  # the screen decides nearly all


# ---- url filters -----------------------------------------------------------------------------------------------------

URLS = [
    ("https://www.Shop.example.com/en/12", "www.shop.example.com", "/en/12", "example.com/en/", "block"),
    ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("https://a.www.example.com/en/x?y=1", "a.www.example.com", "/en/x", "www.example.com/en/", "allow"),
    ("http://notexample.com/en/1#t", "notexample.com", "/en/1", "com/", "allow"),
    ("http://com", "com", "", None, None),
    ("http://x.com?p=/a", "x.com", "", None, None),
    ("http://x.com/a://b/c", "x.com", "/a://b/c", "com/", "allow"),
    ("https://n.net/es/1", "n.net", "/es/1", "net/es/", "block"),
    ("https://n.net/fr", "n.net", "/fr", None, None),
    ("https://ÄB.NET/fr/1", "Äb.net", "/fr/1", "net/fr/", "block"),
    ("no url", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("://h/p", "h", "/p", None, None),
    ("x://a\nb/c\nd?e", "a\nb", "/c\nd", None, None),
]


def test_hosts_paths_and_listed_rules(spark):
    pages = spark.createDataFrame([(i, u[0], "h", "said", "tokens") for i, u in enumerate(URLS)], "page_id long, url string, host string, said string, tokens string")
    got = {r["page_id"]: r for r in url_rules.judge(pages).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), URLS[i]
        assert got[i]["verdict"] in ("allow", "block") and verdict in (None, got[i]["verdict"])


def test_tokens_leave_nothing_out_and_are_few(spark):
    rng, alphabet = random.Random(8), "ab1.:/?#&=-é "
    urls = [u[0] for u in URLS] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    urls += ["http://" + "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["http://a.b/" + "x/" * 30_000 + "?" + "k=1&" * 30_000]
    got = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i long, url string").select("i", url_rules.tokens_of(F.col("url")).alias("t")).collect()
    for r in got:
        assert r["t"] == url_rules.tokens_plain(urls[r["i"]]), urls[r["i"]]
        assert len(r["t"]) <= url_rules.PLACES


def plain_rules(labelled, support, confidence):
    """Rules by counting every subset of every labelled url's tokens."""
    from itertools import combinations
    from math import ceil

    labelled = set(labelled)
    both, alone, share = {}, {}, {}
    for url, verdict in labelled:
        share[verdict] = share.get(verdict, 0) + 1
        tokens = url_rules.tokens_plain(url)
        for size in range(1, len(tokens) + 1):
            for part in combinations(tokens, size):
                both[part, verdict] = both.get((part, verdict), 0) + 1
                alone[part] = alone.get(part, 0) + 1
    least = ceil(support * len(labelled))
    return {(p, v, n, alone[p]) for (p, v), n in both.items() if n >= least and n / alone[p] >= confidence and n * len(labelled) > alone[p] * share[v]}


def made_urls(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        host, folder = rng.choice(["good", "bad", "mixed"]), rng.choice(["news", "win", "shop"])
        bad = host == "bad" or host == "mixed" and folder == "win"
        out.append((i, f"http{rng.choice(['', 's'])}://{rng.choice(['www', 'm'])}.{host}.example.org/{folder}/{rng.randint(1, 999)}", "block" if bad else "allow"))
    return out


def test_rules_equal_counted_ones_and_predict_held_out_urls(spark):
    rows = made_urls(900, 1)
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    labels = spark.createDataFrame([(i, v) for i, _, v in train] + [(None, "block"), (5, None), (6, "other")], "page_id long, verdict string")
    pages = spark.createDataFrame([(i, u) for i, u, _ in rows], "page_id long, url string")
    labelled = pages.join(labels, "page_id").select("url", "verdict")
    got = {(tuple(r["tokens"]), r["verdict"], r["n"], r["n_tokens"]) for r in url_rules.mine(labelled).collect()}
    assert got == plain_rules([(u, v) for _, u, v in train], url_rules.MIN_SUPPORT, url_rules.MIN_CONFIDENCE)
    said = {r["page_id"]: r["verdict"] for r in url_rules.judge(pages, labels, rules=()).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert len(held) > 100 and all(said[i] == v for i, _, v in held)


def test_index_finds_what_a_scan_of_all_rules_finds():
    rng, words = random.Random(2), [f"w{i}" for i in range(12)]
    rules = [(sorted(rng.sample(words, rng.randint(1, 4))), rng.choice(["allow", "block"]), n := rng.randint(5, 40), n + rng.randint(0, 4)) for _ in range(200)]
    index = url_rules.Index(rules)
    ranked = sorted(rules, key=lambda r: (-r[2] / r[3], -r[2], len(r[0]), tuple(r[0]), r[1]))
    for _ in range(2000):
        own = frozenset(rng.sample(words, rng.randint(0, 9)))
        assert index.first(own) == next((v for t, v, _, _ in ranked if own >= set(t)), None)


def test_url_filters_without_labels_or_pages(spark):
    schema = "page_id long, url string"
    assert url_rules.judge(spark.createDataFrame([], schema)).count() == 0
    rows = url_rules.judge(spark.createDataFrame([(1, "http://a.org/x"), (1, "http://a.org/x"), (None, None)], schema)).collect()
    assert [r["verdict"] for r in rows] == ["allow"] * 3


# ---- pages and archives ----------------------------------------------------------------------------------------------


def test_cells_keep_their_columns_free_in_the_rows_they_span():
    rows = lambda html: html_text.render(html).split("\n")
    assert rows("<table><tr><td rowspan=2>A<td>b1<td>c1<tr><td>b2<td>c2<tr><td>x<td>y<td>z</table>") == ["A  b1  c1", "   b2  c2", "x  y   z"]
    assert rows("<table><tr><td>a<td rowspan=0>b<td>c<tr><td>d<td>e<tr><td>f<td>g</table>") == ["a  b  c", "d     e", "f     g"]
    assert rows("<table><tr><td colspan=2 rowspan=2>AB<td>c<tr><td>d<tr><td>1<td>2<td>3</table>") == ["AB    c", "      d", "1  2  3"]
    two = rows("<table><tbody><tr><td rowspan=9>A<td>b<tbody><tr><td>c<td>d</table>")  # a group of rows ends all spans
    assert two == ["A  b", "c  d"]
    assert rows("<table><tr><td colspan=1000>all<td>z<tr><td>1<td>2</table>") == ["all   z", "1  2"]


def test_free_columns_against_a_plain_grid():
    rng = random.Random(4)
    for _ in range(60):
        columns, taken = html_text.Columns(), {}
        for row in range(30):
            at = 0
            for _ in range(rng.randint(0, 6)):
                plain = next(c for c in range(at, 10_000) if taken.get(c, 0) <= row)
                assert columns.free(at) == plain
                wide, high = rng.randint(1, 4), rng.randint(1, 6)
                if high > 1:
                    columns.take(plain, plain + wide, row + high)
                    taken |= {c: row + high for c in range(plain, plain + wide) if taken.get(c, 0) <= row}
                at = plain + wide
            columns.row_ends(row)


def test_many_spans_cost_time_in_proportion():
    html = "<table>" + "".join(f"<tr><td rowspan={2 + k % 50}>a{k}<td>b" for k in range(4000)) + "</table>"
    began = time.time()
    text = html_text.render(html)
    assert time.time() - began < 20 and text.count("a") == 4000 and len(text) < 40 * len(html)
    for first in (60_000, 5000):  # spans that outlast all rows, and spans of which one ends with each row
        html = "<table><tr>" + "".join(f"<td rowspan={first - k}>a" for k in range(4000)) + "<tr><td>b" * 4000 + "</table>"
        began = time.time()
        assert html_text.render(html).count("b") == 4000 and time.time() - began < 20


def test_long_headers_are_read_to_their_end():
    head = lambda more: b"WARC/1.1\r\nWARC-Type: response\r\nX-Long: " + b"x" * more + b"\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    data = head(300_000) + head(5) + head(70_000)
    assert [r.block for r in warc.records(data)] == [b"abc"] * 3 == [r.block for r in warc.records(gzip.compress(data))]
    began = time.time()
    assert list(warc.records(b"xWARC/1.1\n" * 200_000)) == [] and time.time() - began < 10
    assert warc.joined(b"3;" + b"e" * 9000 + b"\r\nabc\r\n0\r\n\r\n") == b"abc"


def test_charset_by_mark_header_or_meta():
    page = '<meta http-equiv=x content="text/html; charset=iso-8859-1"><p>\u00e9t\u00e9'
    assert warc.text_of(page.encode("latin-1"), "text/html") == "\u00e9t\u00e9"
    assert warc.text_of(page.encode("utf-8"), "text/html; charset=utf-8") == "\u00e9t\u00e9"  # the header comes before the page
    assert warc.text_of(b"\xef\xbb\xbf" + page.encode("utf-8"), "text/html") == "\u00e9t\u00e9"
    assert warc.text_of(b"\xff\xfe" + "<p>\u00e9t\u00e9".encode("utf-16-le"), "text/html") == "\u00e9t\u00e9"
    assert warc.text_of("<meta charset=utf-16><p>\u00e9".encode(), "text/html") == "\u00e9" and warc.text_of("<meta charset=none-such><p>\u00e9".encode(), "text/html") == "\u00e9"
