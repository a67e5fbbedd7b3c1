"""Names that clash, long texts, hot keys, bounds, and plain versions that need no Spark."""

import base64
import gzip
import itertools
import random
import re
import time
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import common as C
from barloom.llm import decontam, host_rules, html_text, ngram_join, packing, quality, secrets, token_orc, toxicity, warc

INNER = "found base spans score barloom_score _t _id _hi _lo _n _text _run _assign id hi lo n h key row label own nb m side cluster node links root c0 c1 n_words kept host words lines page"


def clashing(spark, rows):
    """doc_id, text, lang, source, n_chars, and a column for each name that an operator uses inside."""
    more = INNER.split()
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in more)
    return spark.createDataFrame([(i, t, "en", "a", None if t is None else len(t), *[f"{c} of {i}" for c in more]) for i, t in rows], schema)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (None, "one two three four five six"), (2, "one two three four five six")], "item_id long, text string")


LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("repeated", [False, True])
def test_stages_pass_clashing_columns_on(spark, items, repeated):
    text = "password: hunter22 and some more words to be read here by all of us"
    rows = [(1, text), (2, "plain words that nobody would mind at all, again and again"), (None, None), (3, "")]
    docs = clashing(spark, rows + rows[:1] * repeated)
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], LABELS)
    before = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in {"toxicity": lambda d: toxicity.keep_clean(d, labels), "join": ngram_join.keep_one, "decontam": lambda d: decontam.decontaminate(d, items), "secrets": secrets.redact}.items():
        got = stage(docs)
        assert got.columns == docs.columns, name
        kept = got.collect()
        assert sorted({r["doc_id"] for r in kept}, key=str) == [1, 2, 3, None], name
        for r in kept:
            own = {k: v for k, v in before[r["doc_id"]].asDict().items() if name != "secrets" or k not in ("text", "n_chars")}
            assert {k: r[k] for k in own} == own, name
    assert next(r for r in secrets.redact(docs).collect() if r["doc_id"] == 1)["text"].startswith("[SECRET] and")


def test_queries_ignore_clashing_columns(spark, items):
    docs, labels = clashing(spark, [(1, "one two three four five six"), (None, None), (2, "")]), spark.createDataFrame([], LABELS)
    for f in (ngram_join.join, host_rules.host_rules, secrets.secrets, packing.packing, token_orc.token_files, lambda d: toxicity.toxicity(d, labels), lambda d: quality.quality(d, labels)):
        assert f(docs).count() == 3
    assert sorted((r["item_id"] for r in decontam.contaminated(docs, items).collect()), key=str) == [2, None]
    pages = spark.createDataFrame([(1, "u", "<p>x", "a", "b", "c", "d"), (None, None, None, None, None, None, None)], "page_id long, url string, html string, text string, page string, content string, derived string")
    assert html_text.extract(pages).count() == warc.page_derivatives(pages).count() == 2
    none = pages.where("false")
    assert html_text.extract(none).count() == warc.page_derivatives(none).count() == 0


def test_very_long_texts(spark, items):
    """Five MB each: one text of different words, one of one word, one without white space, one full of secrets."""
    n = 700_000
    long = [(1, " ".join(f"w{k}" for k in range(n)) + " alpha beta gamma delta epsilon zeta"), (2, "again " * n), (3, "x" * 5_000_000), (4, "password: abcdef1 zQ8x2LmP0vK3tR7yWb1N " * 60_000)]
    long += [(11, long[0][1] + " end"), (12, long[1][1])]
    docs, labels = clashing(spark, long).select("doc_id", "text", "source").repartition(6), spark.createDataFrame([(1, 1, 0), (2, 0, 1)], LABELS)
    began = time.time()
    joined = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.join(docs).collect()}
    assert joined == {1: (1, 1), 11: (1, 1), 2: (2, 1), 12: (2, 1), 3: (3, 0), 4: (4, 0)}
    assert sorted((r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, items).collect()) == [(1, 1), (11, 1)]
    counts = {r["doc_id"]: r for r in host_rules.host_rules(docs).collect()}
    assert counts[1]["n_repeat_words"] == 0 and counts[2]["n_repeat_words"] == n and counts[3]["n_words"] == 1
    found = {r["doc_id"]: r for r in secrets.secrets(docs).collect()}
    assert found[4]["n_assign"] == found[4]["n_markov"] == 60_000
    assert len(secrets.redact(docs.where("doc_id = 4")).first()["text"]) == 60_000 * len("[SECRET] [SECRET] ")
    tokens = {r["doc_id"]: r["n_tokens"] for r in token_orc.token_files(docs).collect()}
    assert tokens == {r["doc_id"]: r["n_tokens"] for r in packing.with_lengths(docs).collect()}
    assert all(0 <= r["score"] <= 1 for f in (toxicity.toxicity, quality.quality) for r in f(docs, labels).collect())
    assert time.time() - began < 300


def test_toxicity_cap_holds_for_repeated_ids(spark):
    docs = spark.range(2000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    docs = docs.union(spark.range(2, 40).select("id", F.concat(F.lit("other "), F.col("id").cast("string"))))
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(1, 40)], LABELS)
    assert toxicity.training_rows(docs, labels, 10).count() == 10


def test_weights_are_the_minimum_of_the_stated_loss():
    rng = np.random.default_rng(3)
    x = [sorted(rng.choice(6, rng.integers(1, 5), replace=False).tolist()) for _ in range(80)]
    y = np.array([float(0 in r or rng.random() < 0.1) for r in x])
    cf = [[[c for c in r if c != 1]] if 1 in r else [] for r in x]

    def loss(b, w, penalty=20.0, l2=0.05):
        z = np.array([b + w[r].sum() for r in x])
        moved = [(w[r].sum() - w[o].sum()) ** 2 for r, others in zip(x, cf, strict=True) for o in others]
        return np.logaddexp(0, z).sum() - (y * z).sum() + l2 / 2 * w @ w + penalty * len(y) * np.mean(moved)

    b, w = toxicity.fit_weights(x, y, cf, 6, steps=4000)
    best = loss(b, w)
    for k in range(7):
        for step in (1e-3, -1e-3):
            v, c = w.copy(), b
            if k < 6:
                v[k] += step
            else:
                c += step
            assert loss(c, v) >= best - 1e-7
    assert abs(w[1]) < 0.05


def test_quality_equals_a_plain_fit(spark):
    rng = random.Random(2)
    docs, labels = [], []
    for k in range(400):
        good = k % 3 > 0
        docs.append((k, " ".join(rng.choice(["calm", "river", "stone", "walks"]) + ("" if good else "!!") for _ in range(rng.randrange(20, 90)))))
        labels.append((k, int(good), 0))
    table = clashing(spark, docs).select("doc_id", "text", "key", "label")
    stats = quality.with_statistics(table, "doc_id")
    known = stats.join(spark.createDataFrame([(i, q) for i, q, _ in labels], "doc_id long, label int"), "doc_id")
    model = quality.train(known.repartition(7), d=16)
    rows = sorted(known.select("doc_id", "stats", "label", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(4)).alias("fold")).collect())
    every = np.array([r["stats"] for r in rows])
    mean, std = every.mean(axis=0), every.std(axis=0)
    assert np.allclose(model.fourier.mean, mean, atol=1e-5) and np.allclose(model.fourier.std, np.where(std > 1e-9, std, 1), atol=1e-5)
    a = model.fourier([r["stats"] for r in rows if r["fold"] > 0])
    t = np.array([float(r["label"]) for r in rows if r["fold"] > 0])
    ridge = 1e-3 * len(t) * np.r_[0.0, np.ones(a.shape[1] - 1)] + 1e-9
    assert np.allclose(model.beta, np.linalg.lstsq(np.vstack([a, np.diag(np.sqrt(ridge))]), np.r_[t, np.zeros(len(ridge))], rcond=None)[0], atol=1e-4)
    # a kernel of many features comes near the Gaussian one
    f = quality.Fourier.of(np.zeros(3), np.ones(3), 20_000, 0.3, 1)
    p, q = np.array([0.2, -1.0, 0.5]), np.array([1.0, 0.3, 0.1])
    z = f([p, q])[:, 4:]
    assert abs(z[0] @ z[1] - np.exp(-0.3 * ((p - q) ** 2).sum())) < 0.02


def test_isotonic_pooling_is_the_least_squares_fit():
    rng = np.random.default_rng(0)
    for _ in range(30):
        y, w = rng.integers(0, 4, 6).astype(float), rng.integers(1, 4, 6).astype(float)
        got = quality.pool(y, w)
        # the known closed form: the largest over starts of the least mean over ends
        plain = [max(min(np.average(y[a : b + 1], weights=w[a : b + 1]) for b in range(k, 6)) for a in range(k + 1)) for k in range(6)]
        assert np.allclose(got, plain)


class Plain(HTMLParser):
    """The words of a well-formed page, without scripts and hidden elements."""

    def __init__(self):
        super().__init__()
        self.words, self.off, self.stack = [], 0, []

    def handle_starttag(self, tag, attrs):
        if tag not in html_text.VOID:
            self.stack.append(tag in html_text.HIDDEN or ("hidden", None) in attrs)
            self.off += self.stack[-1]

    def handle_endtag(self, tag):
        self.off -= self.stack.pop()

    def handle_data(self, data):
        if not self.off:
            self.words += data.split()


def test_html_keeps_all_visible_words_in_order():
    rng = random.Random(7)

    def made(depth):
        if depth == 0 or rng.random() < 0.3:
            return " " + "".join(rng.choice("abcdefgh") for _ in range(4)) + " "
        tag = rng.choice(["p" if depth == 1 else "div", "span", "b", "ul", "table", "blockquote", "section", "div hidden", "script", "noscript"])
        inner = "".join(made(depth - 1) for _ in range(rng.randrange(1, 4)))
        if tag == "ul":
            return f"<ul><li>{inner}</li><li>{made(depth - 1)}</li></ul>"
        if tag == "table":
            return f"<table><tr><td>x</td><td>{made(0)}</td></tr><tr><td>{made(0)}</td><td>{inner}</td></tr></table>"
        return f"<{tag}>{'no()' if tag == 'script' else inner}</{tag.split()[0]}>"

    for _ in range(200):
        page = f"<html><body>{''.join(made(4) for _ in range(4))}</body></html>"
        plain = Plain()
        plain.feed(page)
        got = re.sub(r"(?m)^[\s-]*- ", "", html_text.render(page)).split()
        assert sorted(w for w in got if w != "-") == sorted(plain.words), page


def test_html_visibility_rules():
    page = "<style>.x{display:none} p.y, #z {visibility:hidden} @media print{.k{display:none}} /* .l{display:none} */</style>"
    page += "<p class=x>no</p><p class='y q'>no<b style='visibility: visible'>yes</b></p><i id=z>no</i><i class='k l'>shown</i><svg><title>no</title>no<text>drawn</text></svg><math><mi>m</mi></math><p class=x style='display:block'>again"
    assert html_text.render(page).split() == ["yes", "shown", "drawn", "m", "again"]


@pytest.mark.parametrize("unit", ["<a ", "<a x='>", "<a '>", "<script ", "<ul><li>x", "<blockquote>x", "<table><tr><td>x", "<dl><dd>x", "<tr><td>a<td>b", "<!--", "<svg>", "<b><p>", "&", "<style>a{", "</a"])
def test_html_takes_time_and_room_in_proportion(unit):
    n = 500_000 // len(unit)
    began = time.process_time()
    text = html_text.render("<table><tr><td>" + "w" * 5000 + unit * n)
    assert time.process_time() - began < 20 and len(text) < 20 * 505_000


def test_packing_against_every_partition():
    """On tiny inputs, against the least cost over all ways to share pieces out: within a tenth."""
    rng = random.Random(1)

    def partitions(xs):
        if not xs:
            yield []
            return
        for rest in partitions(xs[1:]):
            yield [[xs[0]], *rest]
            for k in range(len(rest)):
                yield [*rest[:k], [xs[0], *rest[k]], *rest[k + 1 :]]

    sizes, total, least = (8, 16, 32), 0.0, 0.0
    for _ in range(25):
        lengths = [rng.randrange(1, 33) for _ in range(6)]
        fits = lambda p: all(sum(b) <= 32 for b in p)
        least += min(sum(packing.cost(min(s for s in sizes if s >= sum(b))) for b in p) for p in partitions(lengths) if fits(p))
        got = packing.pack_shard(lengths, sizes)
        assert got["length"].sum() == sum(lengths) and (got.groupby("bin")["length"].sum() == got.groupby("bin")["bin_used"].first()).all()
        total += sum(packing.cost(s) for s in got.groupby("bin")["bin_size"].first())
    assert total <= 1.1 * least


def scanned(df):
    """The rows that a query's scan gave after what ORC left out, and the result."""
    rows = df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return leaves.apply(0).metrics().apply("numOutputRows").value(), rows


def test_token_files_are_searched_by_index_and_bloom_filter(spark, tmp_path):
    docs = spark.range(0, 20_000).select((F.col("id") * 2).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    path = f"file://{tmp_path}/tokens"
    token_orc.write_tokens(docs, path)
    n, rows = scanned(token_orc.lookup(spark, path, [4242]))
    assert len(rows) == 1 and n <= 2 * token_orc.STRIDE
    n, rows = scanned(token_orc.lookup(spark, path, [4243]))  # between ids that are there: only the Bloom filter can tell
    assert rows == [] and n <= token_orc.STRIDE
    assert sum(scanned(token_orc.lookup(spark, path, [2 * k + 1]))[0] for k in range(100, 5000, 499)) <= 2 * token_orc.STRIDE


def test_hot_ids_are_dealt_to_several_files(spark):
    docs = spark.range(0, 4000).select(F.when(F.col("id") % 3 > 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    path = C.fresh_path(spark, "tokens")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    token_orc.write_tokens(docs, path)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    tokens = token_orc.read_tokens(spark, path)
    assert tokens.where("doc_id = 7").select("part").distinct().count() > 1
    got = token_orc.digests(tokens).orderBy("start", "doc_id").collect()
    assert len(got) == 4000 and [r["start"] for r in got] == list(itertools.accumulate([0, *[r["n_tokens"] for r in got[:-1]]]))
    assert [r["doc_id"] for r in got] == sorted(r["doc_id"] for r in got)


def response(more: bytes, body: bytes) -> warc.Record:
    return warc.Record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>")], b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n" + more + b"\r\n" + body)


def test_warc_files_that_are_broken():
    a, b = warc.response_of("http://a/", "<p>Hi</p>"), warc.response_of("http://b/", "<p>Ho</p>" * 50_000)
    raw = a.to_bytes() + b.to_bytes() + a.to_bytes()
    packed = b"".join(gzip.compress(x.to_bytes()) for x in (a, b, a))
    blocks = lambda data: [r.block for r in warc.records(data)]
    whole = [a.block, b.block, a.block]
    for data in (raw, packed, gzip.compress(raw), packed + b"trailing", b"junk" + raw, b"WARC/1.0\r\n" * 50_000 + raw):
        assert blocks(data) == whole
    assert blocks(packed[:-20]) == whole[:2] and blocks(raw[:-30]) == whole[:2] and blocks(packed[:60] + b"\0\0\0" + packed[63:]) == whole[1:]
    assert blocks(b"") == blocks(b"\x1f\x8b") == []


def test_warc_bodies_are_decoded():
    text = lambda more, body: warc.derive(response(more, body))[1].block
    assert text(b"Transfer-Encoding: chunked\r\n", b"4\r\n<p>H\r\n6;x=1\r\nello</\r\n2\r\np>\r\n0\r\n\r\n") == b"Hello"
    assert text(b"Transfer-Encoding: chunked\r\n", b"<p>plain</p>") == b"plain"
    assert text(b"Content-Encoding: gzip\r\n", gzip.compress(b"<p>Gz</p>")) == b"Gz"
    assert text(b"Content-Encoding: deflate\r\n", zlib.compress(b"<p>Df</p>")) == b"Df"
    assert text(b"Content-Encoding: unknown\r\n", b"xx") == b""


def test_warc_output_is_read_by_a_plain_reader(spark):
    pages = spark.createDataFrame([(k, f"http://a/{k}", f"<p>Page {k}</p>") for k in range(5)], "page_id long, url string, html string")
    import hashlib

    for r in warc.derivatives(warc.page_records(pages), ["page_id"]).collect():
        for kind in ("metadata", "conversion"):
            head, block = bytes(r[kind]).split(b"\r\n\r\n", 1)
            first, *lines = head.decode().split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines)
            block = block[: int(fields["Content-Length"])]
            assert first == "WARC/1.1" and fields["WARC-Type"] == kind and fields["WARC-Refers-To"] == r["response_id"] and fields["WARC-Target-URI"] == f"http://a/{r['page_id']}"
            assert fields["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
        assert block == f"Page {r['page_id']}".encode()


def test_benchmark_in_several_blocks(spark, monkeypatch):
    rng = random.Random(1)
    many = [(k, " ".join(f"i{rng.randrange(10**6)}" for _ in range(20))) for k in range(40)]
    docs = clashing(spark, [(k, " ".join(["start", many[k][1], "end"])) for k in range(40)] + [(99, "nothing here")])
    items = spark.createDataFrame(many, "item_id long, text string")
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 1000)
    assert len(decontam.item_blocks(items)) > 3
    assert sorted((r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, items).collect()) == [(k, k) for k in range(40)]
    assert [r["doc_id"] for r in decontam.decontaminate(docs, items).collect()] == [99]


def test_host_rules_judge_by_each_rule(spark):
    good = " ".join(f"some{k}" for k in range(80))
    poor = {"symbols": good + " ###" * 10, "lines": "\n".join([f"line of words number {k % 9}" for k in range(30)] + [good]), "word_length": " ".join("x" * 30 + str(k) for k in range(60))}
    rows = [(k, good, "fine") for k in range(40)]
    for n, (name, text) in enumerate(poor.items()):
        rows += [(100 * (n + 1) + k, text.replace("some", f"so{k}me"), name) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = host_rules.host_rules(docs).collect()
    kept = {r["doc_id"] // 100 for r in got if r["kept"]}
    assert kept == {0} and not any(r["base_failed"] for r in got if r["doc_id"] < 100)
    for n, name in enumerate(poor):
        assert all(r[f"{name}_failed"] for r in got if r["doc_id"] // 100 == n + 1)
