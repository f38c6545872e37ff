
import numpy as np
import pyarrow as pa
import pytest

from broadsheet.llm import quality, toxicity


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


@pytest.fixture(scope="module")
def many(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def accuracy(rows, labels, column):
    marks = {r.doc_id: r[column] for r in labels.collect()}
    held = [(r.predicted, marks[r.doc_id]) for r in rows if r.held_out and r.doc_id in marks]
    return np.mean([a == b for a, b in held])


def test_toxicity_held_out(many, labels):
    rows = toxicity.classify(many, labels).collect()
    assert len(rows) == many.count() and all(0 <= r.score <= 1 for r in rows)
    assert accuracy(rows, labels, "toxic") > 0.93
    again = {r.doc_id: r.score for r in toxicity.classify(many, labels).collect()}
    assert again == {r.doc_id: r.score for r in rows}


def test_quality_held_out(many, labels):
    rows = quality.classify(many, labels).collect()
    assert len(rows) == many.count() and all(0 <= r.score <= 1 for r in rows)
    assert accuracy(rows, labels, "quality") > 0.93


CLEAN = "river runs past the old town went home early today long walk hills rain fell all night number many".split()


@pytest.fixture(scope="module")
def insult_model():
    rng = np.random.default_rng(8)
    texts, labels = [], []
    for i in range(160):
        words = list(rng.choice(CLEAN, 20))
        if i % 4 == 0:
            words[7:7] = ["wretch" if i % 8 else "blockhead"]
        texts.append(" ".join(words))
        labels.append(int(i % 4 == 0))
    return toxicity.fit(texts, labels)


@pytest.mark.parametrize("unit", ["wretch", "wreetch", "w.r.e.t.c.h", "wre-tch", "blockhead", "bloxckhead"])
def test_gapped_and_inserted_insults(insult_model, unit):
    assert insult_model.margins([toxicity.unit_of(unit)])[0] > 0


def test_clean_words_and_spaced_letters(insult_model):
    assert (insult_model.margins(["river", "town", "hills", "early", "number"]) < 0).all()
    assert "wretch" in toxicity.text_words("you w r e t c h you")


def test_collapsed_weights_equal_kernel_expansion():
    kernel = toxicity.Kernel({c: i + 3 for i, c in enumerate("abcdefgh")})
    units, marks = ["abcabc", "fade", "headache", "zz"], ["abc", "cabbage", "deaf"]
    direct = kernel.against(units, marks)

    def slow(s, t):
        def features(u):
            u, out = "^" + u + "$", {}
            for i in range(len(u)):
                for j in range(i + 1, len(u)):
                    for k in range(j + 1, min(len(u), i + toxicity.SPAN)):
                        if all(c in "abcdefgh^$" for c in (u[i], u[j], u[k])):
                            out[u[i], u[j], u[k]] = out.get((u[i], u[j], u[k]), 0) + toxicity.DECAY ** (k - i + 1)
            return out

        a, b = features(s), features(t)
        norm = np.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
        return sum(v * b.get(k, 0) for k, v in a.items()) / norm if norm else 0.0

    assert np.allclose(direct, [[slow(u, m) for m in marks] for u in units], atol=1e-5)


def test_edge_texts(spark, make_docs, labels, many):
    docs = make_docs([(1, None), (2, ""), (3, "   "), (4, "x" * 5000), (5, "a " * 30_000), (5, "a " * 30_000), (None, "b")])
    model = toxicity.fit(*toxicity.sample(many, labels))
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == 7 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.score < 0.5 for r in rows if r.doc_id in (1, 2, 3))
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    machine = quality.fit(*quality.sample(many, labels))
    rows = quality.score(docs, machine).collect()
    assert len(rows) == 7 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 5}) == 1


def test_without_labels(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = make_docs([(1, "some text"), (2, None)])
    assert {r.predicted for r in toxicity.classify(docs, none).collect()} == {0}
    assert quality.classify(docs, none).count() == 2
    assert toxicity.classify(make_docs([]), none).count() == 0


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    linear, factors = rng.normal(size=6), rng.normal(size=(6, 3))
    column, value = np.array([0, 2, 5]), np.array([0.5, -1.0, 2.0])
    got, _ = quality._forward(0.3, linear, factors, np.zeros(3, int), column, value)
    pairs = sum(factors[column[i]] @ factors[column[j]] * value[i] * value[j] for i in range(3) for j in range(i))
    assert got[0] == pytest.approx(0.3 + linear[column] @ value + pairs)


def test_structure_statistics():
    texts = ["ABC def\n## 12", "", None]
    (_, _, owner, _, stats), = quality.features(pa.array(texts), pa.array([13, None, None], pa.int64()))
    named = dict(zip(quality.STATS, stats[0]))
    assert named["upper"] == pytest.approx(3 / 13) and named["digits"] == pytest.approx(2 / 13)
    assert named["symbols"] == pytest.approx(2 / 4) and named["lines"] == pytest.approx(1 / 4)
    assert (stats[1:] == 0).all() and set(owner.tolist()) == {0}


def test_long_words_are_learned_whole():
    rng = np.random.default_rng(4)
    word = lambda n: "".join(rng.choice(list("abcdefhijklmnopq"), n))
    heads = [word(22) for _ in range(120)]
    plain = [" ".join(word(6) for _ in range(12)) for _ in range(240)]
    texts = [f"{p} {h}grostuxyzwurg" for p, h in zip(plain, heads)] + [f"{p} {h}" for p, h in zip(plain[120:], heads)]
    model = toxicity.fit(texts, [1] * 120 + [0] * 120)
    assert model.margins(["grostuxyzwurg"])[0] > 0 > model.margins([heads[0]])[0]
