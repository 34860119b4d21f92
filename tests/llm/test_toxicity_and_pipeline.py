import random

import numpy as np
import pytest
from helpers import awkward, frame, prose, words_of
from pyspark.sql import functions as F

import corpus_pipeline
from relaylake.llm import toxicity

BAD = ["idiot", "scum", "moron", "trash"]


def labelled(rng, n, mention=0.0):
    rows, labels = [], []
    for i in range(n):
        text = prose(rng, rng.randrange(30, 200), 4000).split(" ")
        bad = i % 8 == 0
        for _ in range(3 if bad else 0):
            text.insert(rng.randrange(len(text)), rng.choice(BAD))
        if rng.random() < (0.9 if bad else mention):
            text.insert(rng.randrange(len(text)), "muslim")
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_accuracy():
    rows, labels = labelled(random.Random(16), 900, 0.2)
    features, y = toxicity.distinct_features([t for _, t in rows]), np.array([x for _, x in labels])
    model = toxicity.fit(y[:600], features[:600], [])
    import pyarrow as pa

    scores = toxicity.scores(pa.array([t for _, t in rows[600:]]), model)
    assert ((scores >= 0.5) == (y[600:] == 1)).mean() > 0.97


def test_a_mention_alone_moves_less_with_the_penalty():
    rows, labels = labelled(random.Random(17), 600, 0.1)
    features, y = toxicity.distinct_features([t for _, t in rows]), np.array([x for _, x in labels])
    said = [s for _, t in rows for s in t.split("\n") if "muslim" in s]
    both = toxicity.distinct_features([*said, *map(toxicity.swapped, said)])
    pairs = list(zip(both[: len(said)], both[len(said) :], strict=True))
    import pyarrow as pa

    neutral = pa.array([t.format(x) for x in ("muslim", "christian") for t in toxicity.TEMPLATES])
    gaps = []
    for fairness in (0.0, 5.0):
        s = toxicity.scores(neutral, toxicity.fit(y, features, pairs, fairness=fairness))
        gaps.append(np.abs(s[: len(s) // 2] - s[len(s) // 2 :]).max())
    assert gaps[1] < 0.5 * gaps[0]


def plain_loss(w, labels, rows, pairs, chosen, fairness=1.0, l1=2e-4, l2=2e-4):
    """The loss that the fit minimises, with dense rows; and its gradient without the penalty on sizes."""
    at = {f: k for k, f in enumerate(chosen)}
    x = np.zeros((len(rows), len(chosen) + 1))
    x[:, -1] = 1
    for n, r in enumerate(rows):
        x[n, [at[f] for f in r.tolist() if f in at]] = 1
    d = np.zeros((len(pairs), len(chosen) + 1))
    for n, (a, b) in enumerate(pairs):
        for f in set(a.tolist()) ^ set(b.tolist()):
            if f in at:
                d[n, at[f]] = 1 if f in set(a.tolist()) else -1
    y = np.where(labels > 0, 1, -1)
    share = np.where(labels > 0, 0.5 / (labels > 0).sum(), 0.5 / (labels <= 0).sum())

    def value(v):
        return share @ np.log1p(np.exp(-y * (x @ v))) + fairness * ((d @ v) ** 2).mean() + l1 * np.abs(v[:-1]).sum() + l2 / 2 * (v[:-1] ** 2).sum()

    def slope(v):
        return x.T @ (share * -y / (1 + np.exp(y * (x @ v)))) + fairness * 2 / len(d) * d.T @ (d @ v) + l2 * np.append(v[:-1], 0)

    step = 1 / (0.25 * np.linalg.eigvalsh(x.T @ (share[:, None] * x)).max() + fairness * 2 / len(d) * np.linalg.eigvalsh(d.T @ d).max() + l2)
    return value, slope, step


@pytest.mark.parametrize("words", [(30, 200), (900, 1200)])
def test_fit_reaches_the_least_loss(words):
    rng = random.Random(161)
    rows, labels = [], []
    for i in range(120):
        text = [f"w{rng.randrange(1500)}" for _ in range(rng.randrange(*words))]
        bad = i % 4 == 0
        text += ["idiot", "muslim"] if bad else ["muslim"] if i % 9 == 0 else []
        rows.append(" ".join(text))
        labels.append(int(bad))
    features, y = toxicity.distinct_features(rows), np.array(labels)
    neutral = [toxicity.distinct_features([t.format(x) for x in group for t in toxicity.TEMPLATES]) for group in toxicity.IDENTITY_TERMS]
    pairs = [(g[i], g[i + len(toxicity.TEMPLATES)]) for g in neutral for i in range(len(g) - len(toxicity.TEMPLATES))]
    model = toxicity.fit(y, features, [], steps=4000)
    # Its own choice of features, with zeros where the fit left them out.
    chosen = sorted({f for r in features for f in r.tolist()} & set(model.features.tolist()))
    value, slope, step = plain_loss(None, y, features, pairs, chosen)
    v = np.zeros(len(chosen) + 1)
    for _ in range(20_000):
        v = v - step * slope(v)
        v[:-1] = np.sign(v[:-1]) * np.maximum(np.abs(v[:-1]) - step * 2e-4, 0)
    mine = np.append(model.weights, model.intercept)
    assert value(mine) <= value(v) * 1.02 + 1e-4
    assert ((toxicity.scores(__import__("pyarrow").array(rows), model) >= 0.5) == (y == 1)).mean() > 0.97


def test_scores_equal_a_plain_sum():
    rng = random.Random(162)
    rows, labels = labelled(rng, 300)
    texts = [t for _, t in rows] + ["", None, "İ ß idiot", rows[0][1] * 40, rows[1][1]]
    model = toxicity.fit(np.array([x for _, x in labels]), toxicity.distinct_features([t for _, t in rows]), [])
    weight = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    import pyarrow as pa

    want = [1 / (1 + np.exp(-np.clip(model.intercept + sum(weight.get(f, 0) for f in own.tolist()), -30, 30))) for own in toxicity.distinct_features([t or "" for t in texts])]
    assert np.allclose(toxicity.scores(pa.array(texts), model), want)


def test_nothing_is_toxic_where_no_feature_tells_the_classes_apart():
    rows = ["same words here"] * 9
    model = toxicity.fit(np.array([1] + [0] * 8), toxicity.distinct_features(rows), [])
    assert not len(model.features) and (toxicity.scores(__import__("pyarrow").array(rows), model) < 0.5).all()


def test_very_long_clean_texts_meet_no_weight_by_collision():
    rng = random.Random(166)
    rows, labels = labelled(rng, 200)
    model = toxicity.fit(np.array([x for _, x in labels]), toxicity.distinct_features([t for _, t in rows]), [])
    long = [prose(rng, 60_000, 10**6) for _ in range(4)]
    assert (toxicity.scores(__import__("pyarrow").array(long), model) < 0.3).all()


def test_one_text_of_a_labelled_id_is_learnt_from(spark):
    rows, labels = labelled(random.Random(163), 200)
    given = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    once = toxicity.train(frame(spark, rows), given)
    often = toxicity.train(frame(spark, rows + rows[:50] * 3), given)
    assert (once.features == often.features).all() and np.allclose(once.weights, often.weights)


def test_toxicity_of_awkward_rows(spark):
    rows, labels = labelled(random.Random(164), 200)
    given = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    odd = [(None if r[0] is None else r[0] + 1000, *r[1:]) for r in awkward(random.Random(165))]
    assert {r.doc_id for r in toxicity.toxic_documents(frame(spark, rows + odd, clash=True), given).collect()} == {i for i, t in labels if t}


def test_toxic_documents(spark):
    rows, labels = labelled(random.Random(18), 600, 0.3)
    extra = [(1000, None), (1001, ""), (1002, "You idiot scum, moron trash, " + rows[1][1]), (1002, "You idiot scum, moron trash, " + rows[1][1]), (1003, rows[1][1] * 30)]
    given = spark.createDataFrame([*labels[:500], (5, None), (None, 1), (99999, 1), (0, 1)], "doc_id bigint, toxic int")
    got = toxicity.toxic_documents(frame(spark, rows + extra, clash=True), given).collect()
    assert {r.doc_id for r in got} == {i for i, t in labels if t} | {1002}
    assert sum(r.doc_id == 1002 for r in got) == 2
    assert toxicity.toxic_documents(frame(spark, []), given).collect() == []
    assert toxicity.toxic_documents(frame(spark, rows), given.limit(0)).collect() == []


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with planted cases, as the tables that the pipeline reads."""
    rng = random.Random(19)
    rows, labels = labelled(rng, 240)
    texts = dict(rows)
    passage = " ".join(f"p{rng.randrange(10**5)}" for _ in range(70))
    item = " ".join(f"q{rng.randrange(10**5)}" for _ in range(30))
    clean = [i for i, t in labels if not t]
    for i in clean[:6]:
        texts[i] += "\n" + passage
    for i in clean[6:10]:
        texts[i] = texts[i].replace(" ", f" {item.upper()} ", 1)
    copies = {500 + k: texts[clean[20 + k]] for k in range(5)}
    near = {}
    for k in range(5):
        own = texts[clean[30 + k]].split(" ")
        for at in range(3, len(own), 25):
            own[at] = "changed" + str(at)
        near[600 + k] = " ".join(own)
    texts |= copies | near | {700: item}
    full = [(i, t, "en", "s", len(t)) for i, t in texts.items()] + [(800, None, None, None, None), (801, "", "en", "s", 0)]
    path = str(tmp_path_factory.mktemp("corpus"))
    frame(spark, full).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, full, dict(labels), clean, passage, item, near


def stage(spark, name, docs, path, tmp_path):
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, path)
    out.write.parquet(str(tmp_path / "o"))
    return spark.read.parquet(str(tmp_path / "o"))


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "MinHash near-dedup", "benchmark decontamination", "packing"]


def test_toxicity_stage(spark, corpus, tmp_path):
    path, full, labels, *_ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    got = stage(spark, "toxicity", docs, path, tmp_path)
    assert got.columns == docs.columns
    assert {r.doc_id: r.text for r in got.collect()} == {i: t for i, t, *_ in full if not labels.get(i)}


def test_line_stage(spark, corpus, tmp_path):
    path, full, _, clean, passage, *_ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    got = {r.doc_id: r for r in stage(spark, "line dedup", docs, path, tmp_path).collect()}
    assert sum(passage in (r.text or "") for r in got.values()) == 1
    texts = {i: t for i, t, *_ in full}
    assert all(got[i].text == texts[i] for i in clean[50:]) and got[800].text is None and got[801].text == ""
    assert all(r.n_chars == len(r.text) for i, r in got.items() if r.text is not None)


def test_near_dedup_stage(spark, corpus, tmp_path):
    path, full, _, clean, _, _, near = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    got = stage(spark, "MinHash near-dedup", docs, path, tmp_path)
    assert got.columns == docs.columns
    gone = {i for i, *_ in full} - {r.doc_id for r in got.collect()}
    assert gone == {500 + k for k in range(5)} | set(near)


def test_decontamination_stage(spark, corpus, tmp_path):
    path, full, _, clean, _, item, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    got = {r.doc_id: r for r in stage(spark, "benchmark decontamination", docs, path, tmp_path).collect()}
    texts = {i: t for i, t, *_ in full}
    assert 700 not in got and not any(item.lower() in (r.text or "").lower() for r in got.values())
    hit = set(clean[6:10])
    for i, t in texts.items():
        if i in hit:
            assert words_of(got[i].text) == words_of(t.replace(item.upper(), ""))
            assert got[i].n_chars == len(got[i].text)
        elif i != 700:
            assert got[i].text == t


def test_whole_pipeline_equals_brute_force(spark, corpus):
    """Each stage by hand, one after another; the classifier is the one that the first stage fits."""
    path, full, labels, *_ = corpus
    import pyarrow as pa
    from test_search_operators import plain_contamination, plain_groups, plain_packing, plain_repeated

    model = toxicity.train(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    rows = [(i, t) for (i, t, *_), score in zip(full, toxicity.scores(pa.array([t for _, t, *_ in full]), model), strict=True) if score < toxicity.THRESHOLD]
    assert not any(labels.get(i) for i, _ in rows)
    cut = {}
    for doc, _, line, *_ in plain_repeated(rows, 2, 12):
        cut.setdefault(doc, set()).add(line)
    shorter = [(i, t if i not in cut else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in cut[i])) for i, t in rows]
    rows = [(i, t) for i, t in shorter if i not in cut or t.strip()]
    gone = plain_groups(rows, 0.5)
    rows = [r for r in rows if r not in gone]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    hits = plain_contamination(rows, items)
    rows = [(i, " ".join(hits[n][1]) if n in hits else t) for n, (i, t) in enumerate(rows)]
    rows = [(i, t) for n, (i, t) in enumerate(rows) if n not in hits or words_of(t)]
    assert cut and gone and hits
    got = [[(p.doc_id, p.first_word, p.last_word) for p in r.pieces] for r in corpus_pipeline.run(spark, path).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain_packing(rows, 4096)))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_awkward_rows(spark, corpus, tmp_path, name):
    path = corpus[0]
    df = frame(spark, awkward(random.Random(20)), clash=True)
    got = stage(spark, name, df, path, tmp_path)
    assert got.count() > 0 and (name == "packing" or got.columns == df.columns)
    assert stage(spark, name, df.where(F.lit(False)), path, tmp_path / "e").count() == 0
