"""corpus_pipeline.run against the same five steps in plain Python."""

import random

import numpy as np
import pytest

import corpus_pipeline
from barloom.llm import common as C
from barloom.llm import packing, secrets, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def jaccard(a, b):
    both = len(np.intersect1d(a, b))
    return both / (len(a) + len(b) - both) if len(a) and len(b) else 0.0


def grams(words, n):
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(6))
    vocabulary = [word() for _ in range(800)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows, labels = [(None, None), (0, ""), (1, "two words")], []
    items = [(k, " ".join(text(25))) for k in range(4)] + [(9, None)]
    for k in range(10, 400):
        w = text(rng.randrange(60, 160))
        toxic = k % 7 == 0
        if toxic:
            w[10] = rng.choice(["vilest", "gruesome"])
        if k % 11 == 0:
            w[20:20] = ["password:", "hunter22x", "zQ8x2LmP0vK3tR7yWb1N"]
        if k % 13 == 0:
            w[30:30] = items[k % 4][1].split()
        rows.append((k, " ".join(w)))
        labels.append((k, 1, int(toxic)))
        if k % 5 == 0:
            near = list(w)
            near[40] = "changed"
            rows += [(1000 + k, " ".join(near)), (2000 + k, " ".join(w))]
    folder = tmp_path_factory.mktemp("sf")
    made = lambda name, data, schema: spark.createDataFrame(data, schema).write.parquet(f"file://{folder}/{name}.parquet")
    made("documents", [(i, t, "en", "a", None if t is None else len(t)) for i, t in rows], SCHEMA)
    made("labels", labels, "doc_id long, quality int, toxic int")
    made("benchmark", items, "item_id long, text string")
    return f"file://{folder}", rows, items


def plain(spark, sf_dir, rows, items):
    """The steps one by one, each over all that the one before has kept: id -> text, after each step."""
    model = toxicity.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = [r for r, s in zip(rows, model.scores([t for _, t in rows]), strict=True) if s < 0.5]
    yield rows
    sets = [next(iter(C.shingle_sets([t])))[1] for _, t in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if root[a] != root[b] and jaccard(sets[a], sets[b]) >= 0.8:
                root = [root[b] if r == root[a] else r for r in root]
    least = {r: min(rows[k][0] for k in range(len(rows)) if root[k] == r) for r in set(root) if len(sets[r])}
    rows = [x for k, x in enumerate(rows) if not len(sets[k]) or least[root[k]] == x[0]]
    yield rows
    held = lambda t, q: q and len(grams(q, min(5, len(q))) & grams(C.words(t), min(5, len(q)))) >= 0.8 * len(grams(q, min(5, len(q))))
    rows = [(i, t) for i, t in rows if not any(held(t, C.words(q)) for _, q in items)]
    yield rows
    yield [(i, t and t.replace("password: hunter22x", "[SECRET]").replace("zQ8x2LmP0vK3tR7yWb1N", "[SECRET]")) for i, t in rows]


def test_run_equals_the_plain_steps(spark, tables):
    sf_dir, rows, items = tables
    docs, steps = spark.read.parquet(f"{sf_dir}/documents.parquet"), plain(spark, sf_dir, rows, items)
    order = lambda r: (r[0] is not None, r[0] or 0)
    sizes = [len(rows)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = C.materialize(stage(spark, docs, sf_dir), name)
        want = next(steps)
        assert docs.schema.names == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
        assert sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=order) == sorted(want, key=order), name
        sizes.append(len(want))
    assert all(a > b for a, b in zip(sizes[:3], sizes[1:4], strict=True))
    got = corpus_pipeline.run(spark, sf_dir).toPandas()
    tokens = lambda t: len(C.Encoder.at(C.tokenizer_path()).tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
    assert got.fillna(-1).groupby("doc_id")["length"].sum().to_dict() == {-1 if i is None else i: tokens(t) for i, t in want}
    bins = got.groupby("bin_id").agg(total=("length", "sum"), used=("bin_used", "max"), size=("bin_size", "max"))
    assert (bins["total"] == bins["used"]).all() and (bins["used"] <= bins["size"]).all() and set(bins["size"]) <= set(packing.SIZES)


def test_packing_is_the_same_on_every_run(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    a, b = (sorted(map(tuple, packing.packing(docs.repartition(n)).select("length", "bin_size").collect())) for n in (1, 7))
    assert sum(n for n, _ in a) == sum(n for n, _ in b)


def test_masked_texts_hold_no_secret(spark, tables):
    docs = secrets.redact(spark.read.parquet(f"{tables[0]}/documents.parquet"))
    assert docs.where("text like '%hunter22x%' or text like '%zQ8x2LmP0vK3tR7yWb1N%'").count() == 0
    assert sorted(r[0] for r in secrets.secrets(docs).select("spans").distinct().collect()) == [""]
