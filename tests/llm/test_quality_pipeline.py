import numpy as np
import pytest
from plain import components, shingle_set

import corpus_pipeline
from tomewright.llm import pieces, quality

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels


def test_held_out_labels(spark, tables):
    """Fitted on the labels of even ids, judged on those of odd ids."""
    docs, labels = tables
    model = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    got = quality.score_quality(docs.where("doc_id % 2 = 1"), model).join(labels, "doc_id").select("quality", "score").toPandas()
    assert ((got.score >= 0.5) == (got.quality == 1)).mean() >= 0.98 and got.score[got.quality == 1].min() > 0.5


def sources_tell(n, known):
    """Documents whose source tells their class, and labels of the first ones."""
    rng = np.random.default_rng(0)
    docs, labels, truth = [], [], []
    for k in range(n):
        good = bool(rng.integers(0, 2))
        truth.append(good)
        words = [f"{'g' if good else 'b'}{x}" for x in rng.integers(0, 60, 12)] + [f"w{x}" for x in rng.integers(0, 500, 20)]
        docs.append((k, " ".join(words), "en", "fine" if good else "foul", 100))
        if k < known:
            labels.append((k, int(good), 0))
    return docs, labels, np.array(truth)


def test_views_teach_each_other(spark):
    """The source alone tells the class; the text view of few labels learns the rest from it."""
    docs, labels, truth = sources_tell(900, 60)
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    assert len(model.passed) == quality.ROUNDS and all(min(n) >= 0.05 * 840 for n in model.passed)
    views = [quality.text_view(r["text"]) for r in docs.orderBy("doc_id").collect()]
    b = quality.Batch.of(np.array([v[0] for v in views]), [v[1] for v in views], [quality.meta_view(("en", "fine"), 100)] * 900)
    alone = quality.CoModel.learn(sums_of(b, np.array([int(truth[k]) if k < 60 else -1 for k in range(900)]))).raw(b)[0][:, 1]
    taught = model.raw(b)[0][:, 1]
    apart = lambda s: (s[truth].mean() - s[~truth].mean()) / s.std()
    assert apart(taught) > apart(alone) and ((model.odds(b)[0] > 0) == truth).mean() > 0.95


def sums_of(b, y):
    sums = quality.Sums(2)
    w = np.stack([y == 0, y == 1], 1).astype(float)
    sums.add(b, w, w)
    return sums


def plain_co_train(x, words, meta, y, held, check):
    """The fit on whole matrices in one place: rows of numbers, 0/1 matrices of buckets."""
    sig = lambda o: 1 / (1 + np.exp(-np.clip(o, -40, 40)))
    wt = np.stack([(y == c) & ~held for c in (0, 1)]).astype(float)
    wm, passed = wt.copy(), []
    for round_ in range(quality.ROUNDS + 1):
        mean = [(w[:, None] * x).sum(0) / w.sum() for w in wt]
        cov = sum(((x - m) * w[:, None]).T @ (x - m) for w, m in zip(wt, mean)) / wt.sum()
        d = np.linalg.inv(cov + np.diag(quality.SHRINK * (np.diag(cov) + 1e-6) + 1e-7)) @ (mean[1] - mean[0])

        def ratios(m, w):
            count, n = w @ m, w.sum(1)
            common = count.sum(0) / n.sum()
            rate = [(count[c] + 2 * common) / (n[c] + 2) for c in (0, 1)]
            return np.where(common > 0, np.log((rate[1] + 1e-12) / (rate[0] + 1e-12)), 0)

        def part(m, r):
            return m @ r / np.sqrt(np.maximum(m.sum(1), 1))

        text = np.c_[x @ d - d @ (mean[0] + mean[1]) / 2, part(words, ratios(words, wt))]
        other = part(meta, ratios(meta, wm))[:, None]
        odds = []
        for raw in (text, other):
            w = quality.fit_logistic(raw[check], y[check].astype(float))
            odds.append(np.clip(np.c_[raw, np.ones(len(raw))] @ w, -40, 40))
        joint = quality.fit_logistic(np.stack(odds, 1)[check], y[check].astype(float))
        if round_ == quality.ROUNDS:
            return sig(np.c_[odds[0], odds[1], np.ones(len(x))] @ joint), passed
        wt = np.stack([(y == c) & ~held for c in (0, 1)]).astype(float)
        wm, told = wt.copy(), []
        for o, to in zip(odds, (wm, wt)):
            step, free = np.floor(o * quality.STEPS), np.flatnonzero(y < 0)
            want = quality.SHARE * (round_ + 1) * len(free)
            rank = np.sort(step[free])
            low, high = rank[int(np.ceil(want)) - 1], rank[::-1][int(np.ceil(want)) - 1]
            sure = free[(step[free] <= low) | (step[free] >= high)]
            to[0, sure], to[1, sure] = 1 - sig(o[sure]), sig(o[sure])
            told += [(step[free] <= low).sum(), (step[free] >= high).sum()]
        passed.append(tuple(int(n) for n in told))


def test_fit_matches_plain_version(spark, tables):
    docs, labels = tables
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, model).collect()}
    rows = docs.selectExpr("doc_id", "text", "lang", "source", "n_chars", "xxhash64(doc_id, 8) h").orderBy("h").collect()
    y_of = {r["doc_id"]: r["quality"] for r in labels.collect()}
    views = [quality.text_view(r["text"]) for r in rows]
    rows, views = [r for r, v in zip(rows, views) if v is not None], [v for v in views if v is not None]
    y = np.array([y_of.get(r["doc_id"], -1) for r in rows])
    held = np.array([r["h"] % 10 < quality.HELD for r in rows]) & (y >= 0)
    grid = lambda lists, n: np.array([np.bincount(x, minlength=n) for x in lists], float)
    x = np.array([v[0].astype(np.float32) for v in views], float)
    want, passed = plain_co_train(x, grid([v[1] for v in views], quality.WORDS), grid([quality.meta_view((r["lang"], r["source"]), r["n_chars"]) for r in rows], 3 * quality.VALUES), y, held, np.flatnonzero(held))
    assert model.passed == passed and all(min(n) > 0 for n in passed)
    assert np.allclose([got[r["doc_id"]] for r in rows], want, atol=1e-5)


def test_labels_of_one_class_teach_nothing(spark, tables):
    docs, labels = tables
    assert quality.fit(docs, labels.where("quality = 1")) is None
    assert quality.classify(docs, labels.where("quality = 0")).where("keep").count() == docs.count()


def test_odd_rows(spark, tables, odd, none):
    docs, labels = tables
    docs = docs.unionByName(odd.select(*docs.columns))  # documents without words are among those fitted on
    messy = labels.union(spark.createDataFrame([(None, 1, 0), (1, None, None), (2, 7, 0)], labels.schema)).union(labels.limit(5))
    model = quality.fit(docs, messy)
    got = quality.score_quality(odd, model)
    assert set(got.columns) == set(odd.columns) and got.count() == odd.count()
    by = {r["doc_id"]: r["score"] for r in got.collect()}
    assert by[2] == by[3] == by[4] == 0.0 and 0 <= by[5] <= 1
    assert quality.score_quality(none, model).count() == 0


def test_pipeline(spark, tables, tmp_path):
    """Each stage on its own input, against a plain version of what it promises."""
    docs, labels = tables
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "mixing_sources", "sentencepiece_encoding"]
    made = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, made[-1], SF)
        if name != "sentencepiece_encoding":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        made.append(spark.read.parquet(str(tmp_path / name)))
    ids = [{r["doc_id"] for r in m.select("doc_id").collect()} for m in made]
    assert all(a >= b for a, b in zip(ids, ids[1:]))
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert {i for i in ids[0] - ids[1] if known.get(i) == 1} == set() and sum(known[i] == 0 for i in ids[1] & set(known)) <= 2
    texts = {r["doc_id"]: r["text"] for r in made[2].collect()}
    sets = {i: shingle_set(t) for i, t in texts.items()}
    near = components(texts, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert ids[3] == set(near.values())
    assert 0.8 <= made[4].selectExpr("sum(octet_length(text))").first()[0] / made[3].selectExpr("sum(octet_length(text))").first()[0] <= 0.9
    own = pieces.load(pieces.default_model())
    before = {r["doc_id"]: r["text"] for r in made[4].collect()}
    rows = made[5].collect()
    assert len(rows) == len(before) and all(r["ids"] == own.encode(before[r["doc_id"]]) and r["decoded"] == before[r["doc_id"]].replace("▁", " ") for r in rows)


def test_run_gives_the_same(spark):
    once = {(r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, SF).collect()}
    assert once == {(r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, SF).collect()} and once


def test_pipeline_of_odd_documents(spark, tables, odd, none):
    """Every stage on nulls, empty and very long texts, repeated rows and ids: what its docstring says."""
    plain, got = odd.select("doc_id", "text", "lang", "source", "n_chars"), {}
    more = tables[0].where("doc_id > 7").select(plain.columns).unionByName(plain)  # for the classifier to learn from
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
        got[name] = stage(spark, more if name == "quality_classifier" else plain, SF).collect()
    ids = {name: [r["doc_id"] for r in rows] for name, rows in got.items()}
    assert not {2, 3, 4} & set(ids["quality_classifier"]) and ids["quality_classifier"].count(1) in (0, 2)
    assert sorted(map(str, ids["line_dedup"])) == sorted(str(r["doc_id"]) for r in plain.collect())
    assert set(ids["simhash_near_dedup"]) == {1, 2, None, 5, 6, 7} and ids["simhash_near_dedup"].count(1) == ids["simhash_near_dedup"].count(6) == 2
    assert not {None, 2, 3} & set(ids["mixing_sources"]) and set(ids["mixing_sources"]) <= {1, 4, 5, 6, 7} and ids["mixing_sources"].count(1) in (0, 2)
    assert len(ids["sentencepiece_encoding"]) == plain.count() and all(len(r["ids"]) == 1 and r["decoded"] == "" for r in got["sentencepiece_encoding"] if r["doc_id"] in (2, 3))
