import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from broadsheet.llm import bagminhash, minhash, neardup
from broadsheet.llm.common import shingles


def bags(rows, k=5):
    out = {}
    for doc_id, text in rows:
        w = (text or "").encode().split()
        grams = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else ([tuple(w)] if w else [])
        out[doc_id] = Counter(grams)
    return out


def brute_classes(rows, weighted, threshold=0.8):
    bag, texts = bags(rows), {i: t or "" for i, t in rows}
    root = {i: i for i in bag}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(bag)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = (bag[a], bag[b]) if weighted else (Counter(set(bag[a])), Counter(set(bag[b])))
            both = sum((x & y).values())
            if texts[a] == texts[b] or (both and both / (sum(x.values()) + sum(y.values()) - both) >= threshold):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def family(seed=3, n=40):
    """Copies of one text with zero to six words changed, some exact, and unrelated texts."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in rng.integers(0, 5000, 120)]
    rows = []
    for i in range(n):
        words = list(base)
        for j in rng.integers(0, len(words), i % 7):
            words[j] = f"x{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(f"u{x}" for x in rng.integers(0, 10**6, 60))) for i in range(5)]
    return rows


EDGES = [(200, None), (201, ""), (202, " \n"), (203, "a b"), (204, "a b"), (205, "a b c d e f g h"), (206, "a b c d e f g h " * 30)]


def test_shingles_match_words():
    texts = ["a b c d e f", None, "", "x", " a b c d e ", "a\tb\nc dé e", "x ", " a b"]
    got = {}
    for first, _, hashes, owner in shingles(pa.array(texts), 5):
        for h, o in zip(hashes.tolist(), owner.tolist()):
            got.setdefault(first + o, []).append(h)
    want = bags(enumerate(texts))
    assert {i: len(v) for i, v in got.items()} == {i: sum(c.values()) for i, c in want.items() if c}
    assert got[0][0] == got[4][0] and got[3] == got[6]


def test_signature_is_unbiased():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = rng.integers(0, 6, 300), rng.integers(0, 6, 300)
    b[:200] = a[:200]
    hashes = np.concatenate([np.repeat(base, a), np.repeat(base, b)])
    owner = np.repeat([0, 1], [a.sum(), b.sum()])
    s = bagminhash.bagminhash(hashes, owner, 2, 4000)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def test_signature_does_not_depend_on_bound():
    hashes, owner = np.arange(1, 40, dtype=np.uint64), np.zeros(39, dtype=np.int64)
    one = bagminhash.bagminhash(hashes, owner, 1, 100, spare=-3.0)
    assert (one == bagminhash.bagminhash(hashes, owner, 1, 100, spare=6.0)).all()


def test_weighted_classes(make_docs):
    rows = family() + EDGES
    got = {r.doc_id: r.class_id for r in bagminhash.near_duplicates(make_docs(rows)).collect()}
    assert got == brute_classes(rows, weighted=True)


def test_set_classes(make_docs):
    rows = family(5) + EDGES
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(make_docs(rows)).collect()}
    assert got == brute_classes(rows, weighted=False)


def test_keep_one_keeps_columns_and_one_row(make_docs):
    rows = family(n=10) + EDGES + [(203, "a b"), (None, "a b"), (None, "only null id here now")]
    docs = make_docs(rows)
    kept = bagminhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids))
    want = {c for i, c in brute_classes(family(n=10) + EDGES, True).items()}
    assert set(ids) == want | {None}


def test_documents_against_brute_force(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = {r.doc_id: r.class_id for r in bagminhash.near_duplicates(documents).collect()}
    assert got == brute_classes(rows, weighted=True)


def test_empty_tables(make_docs):
    assert bagminhash.near_duplicates(make_docs([])).count() == 0
    assert bagminhash.keep_one(make_docs([])).count() == 0
    assert minhash.edited(make_docs([])).count() == 0


@pytest.mark.parametrize("ranges", [8_000_000, 200])
def test_edited_texts(make_docs, monkeypatch, ranges):
    import hashlib

    monkeypatch.setattr(minhash, "RANGE_CHARS", ranges)
    rows = [(i * 7 % 31, f"word{i} " * (i * 3) + "é" * (i % 5)) for i in range(31)] + [(40, None), (41, ""), (-5, "last one here")]
    got = {r.doc_id: r for r in minhash.edited(make_docs(rows)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for (doc_id, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        third = len(text) // 3
        want = hashlib.sha256((text[: len(text) - third] + after[:third]).encode()).hexdigest()
        assert (got[doc_id].edited_sha256, got[doc_id].n_chars) == (want, len(text))
    prints = {d: r.fingerprint for d, r in got.items()}
    split = lambda x: [x[i : i + 4] for i in range(0, len(x), 4)]
    for (a, _), (b, _) in zip(order, order[1:] + order[:1]):
        equal = [x == y for x, y in zip(split(prints[a]), split(prints[b]))]
        assert got[a].near_next == pytest.approx(sum(equal) / len(equal))
    assert prints[40] == prints[41]


def test_links_of_a_class_are_read_once(spark, monkeypatch):
    """A hub, a path and a random graph; more links meet classes that are known."""
    rng = np.random.default_rng(17)
    name = lambda i: hashlib.md5(str(i).encode()).digest()[:12]
    links = [(0, i) for i in range(1, 200)] + [(i, i + 1) for i in range(300, 400)]
    links += [(500 + a, 500 + b) for a, b in rng.integers(0, 100, (70, 2)).tolist()]
    more = [(5, 350), (600, 7), (700, 701), (20, 30)]
    written, stage = [], neardup.stage_table

    def counted(session, df, what):
        out = stage(session, df, what)
        if what == "links":
            written.append(out.count())
        return out

    monkeypatch.setattr(neardup, "stage_table", counted)
    table = lambda pairs: spark.createDataFrame([(name(a), name(b)) for a, b in pairs], "a binary, b binary")

    def want(pairs):
        root = {x: x for pair in pairs for x in map(name, pair)}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            p, q = find(name(a)), find(name(b))
            root[max(p, q)] = min(p, q)
        return {x: find(x) for x in root}

    def got(labels):
        rows = labels.collect()
        assert len(rows) == len({bytes(r.node) for r in rows})
        return {bytes(r.node): bytes(r.root) for r in rows}

    labels = neardup.classes(spark, table(links))
    assert got(labels) == want(links)
    # Each link within a class goes after one round, and at last none is left.
    assert len(written) > 1 and written[0] > 600 and sum(written[1:]) < written[0] and written[-1] == 0
    written.clear()
    assert got(neardup.classes(spark, table(more), labels)) == want(links + more)
    assert written[0] == 6  # both ways; the fourth lies within a class


def test_single_document_follows_itself(make_docs):
    assert minhash.edited(make_docs([(1, "one two three four five six")])).first().near_next == 1.0


def test_minhash_estimates_jaccard():
    base = np.random.default_rng(9).integers(0, 2**63, 1000).astype(np.uint64)
    hashes = np.concatenate([base[:700], base[300:]])
    s = minhash.minhash(hashes, np.repeat([0, 1], 700), 2, 2048)
    assert abs((s[0] == s[1]).mean() - 0.4) < 0.05
