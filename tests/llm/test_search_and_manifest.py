"""Ranked lexical search, decontamination and the Merkle manifest against plain Python."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from broadsheet.llm import decontamination, lexical, manifest

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


@pytest.fixture(scope="module")
def make_items(spark):
    def make(rows):
        return spark.createDataFrame([(*r, "x", "y") for r in rows], "item_id long, text string, word string, key string")

    return make


# --- ranked search -----------------------------------------------------------------------------


def brute_ranks(docs, items, k=10):
    held = [(i, tokens(t)) for i, t in docs]
    n, length = sum(bool(w) for _, w in held), sum(len(w) for _, w in held)
    df = {}
    for _, words in held:
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    out = set()
    for item_id, text in set(items):
        scored = []
        for row, (doc_id, words) in enumerate(held):
            score = 0
            for w in tokens(text):
                tf = words.count(w)
                if tf:
                    m = 25 + 75 * len(words) * n // length
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * tf // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, row))
        for rank, (score, null, doc_id, _) in enumerate(sorted(scored)[:k], 1):
            out.add((item_id, rank, None if null else doc_id, -score))
    return out


def lexical_rows():
    rng = np.random.default_rng(7)
    vocabulary = [f"w{int(x)}" for x in rng.zipf(1.4, 4000) % 300]
    docs = [(int(i), " ".join(rng.choice(vocabulary, rng.integers(1, 80)))) for i in range(400)]
    docs += [(1000 + i, docs[3][1]) for i in range(30)]  # ties
    docs += [(2000, None), (2001, ""), (2002, "... --"), (None, docs[5][1]), (7, docs[7][1]), (2003, "Éa ÉA é2 W5 w5_w6")]
    docs += [(2004, "w1 w2 " * 20_000)]
    items = [(i, " ".join(rng.choice(vocabulary, 12))) for i in range(15)]
    items += [(20, docs[3][1]), (21, None), (22, ""), (23, "zzz nowhere"), (24, "Éa W5 w5"), (24, "Éa W5 w5"), (None, "w3 w9 w3")]
    return docs, items


def test_ranks_against_brute_force(make_docs, make_items):
    docs, items = lexical_rows()
    got = lexical.ranked(make_docs(docs).repartition(11), make_items(items)).collect()
    want = brute_ranks(docs, items)
    assert len(got) == len(want)
    assert {(r.item_id, r.rank, r.doc_id, r.score) for r in got} == want


def test_ranks_in_blocks_of_items(make_docs, make_items):
    docs, items = lexical_rows()
    got = lexical.ranked(make_docs(docs[:60]), make_items(items), k=3, most=40).collect()
    assert {(r.item_id, r.rank, r.doc_id, r.score) for r in got} == brute_ranks(docs[:60], items, 3)


def test_accumulators_are_limited():
    """Common words make no accumulators once rare ones have filled the list, and scores stay exact."""
    n, k = 2000, 10
    lists = {0: (np.arange(20), np.full(20, 3)), 1: (np.arange(n), np.ones(n, np.int64))}
    plan = lexical.Plan([[(0, 1), (1, 1)]], np.array([4000, 10]), n, 10 * n, k)
    best = lexical._Best(plan)
    best.add(pa.array(range(n), pa.int64()), np.full(n, 10), {t: (d.astype(np.int64), c.astype(np.int64)) for t, (d, c) in lists.items()})
    assert best.created == 20
    m = 25 + 75
    want = 4000 * (3 * 10**9 // (3000 + 8 * m)) + 10 * (10**9 // (1000 + 8 * m))
    assert best.scores[0].tolist() == [want] * k and best.ids[0].tolist() == list(range(k))
    again = best.created
    best.add(pa.array(range(n, 2 * n), pa.int64()), np.full(n, 10), {1: lists[1]})
    assert best.created == again  # the list of the first segment rules them all out


def test_ranks_of_empty_tables(make_docs, make_items):
    assert lexical.ranked(make_docs([]), make_items([(1, "a")])).count() == 0
    assert lexical.ranked(make_docs([(1, "a")]), make_items([])).count() == 0
    assert lexical.ranked(make_docs([(1, None)]), make_items([(1, "a")])).count() == 0


# --- decontamination ---------------------------------------------------------------------------


def brute_hits(text, items, size=10):
    words, hit, ids = tokens(text), set(), set()
    for item_id, item in items:
        w = tokens(item)
        width = min(size, len(w))
        for s in range(len(w) - width + 1 if w else 0):
            for at in range(len(words) - width + 1):
                if words[at : at + width] == w[s : s + width]:
                    hit.update(range(at, at + width))
                    ids.add("" if item_id is None else str(item_id))
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


def contamination_rows():
    rng = np.random.default_rng(11)
    common = [f"c{i}" for i in range(6)]  # many chance meetings
    items = [(i, " ".join(rng.choice(common, 14))) for i in range(4)]
    items += [(10, " ".join(f"r{i}" for i in range(30))), (11, "Only Four words, here"), (12, "la " * 15), (13, None), (14, "")]
    items += [(15, items[4][1]), (None, "no id but a text of some ten words or more"), (10, "second text of an item that has been seen before now")]
    long = items[4][1].split()
    docs = [(i, " ".join(rng.choice(common, 60))) for i in range(40)]
    docs += [
        (100, " ".join(["x", *long[3:14], "y", *long[12:25], "z"])), (101, " ".join(long[:9])), (102, "R4, r5; R6 r7 r8\nr9 r10 r11 r12 r13!"),
        (103, "it is only four WORDS here and only four words here"), (104, "la " * 40), (105, None), (106, ""), (107, "..."),
        (108, items[-2][1]), (109, " ".join(long)), (109, " ".join(long)), (None, " ".join(long)),
        (110, "second text of an item that has been seen before now " + " ".join(long)), (111, "pad " * 20_000 + " ".join(long[:10])),
        (112, "five " + " ".join(long[2:13])),
    ]
    return docs, items


def test_hits_against_brute_force(make_docs, make_items):
    docs, items = contamination_rows()
    got = decontamination.contaminated(make_docs(docs), make_items(items)).collect()
    assert len(got) == len(docs)
    key = lambda x: str(x)
    want = sorted(((i, *brute_hits(t, items)) for i, t in docs), key=key)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got), key=key) == want
    clean = decontamination.without_contaminated(make_docs(docs), make_items(items))
    assert clean.columns == make_docs([]).columns
    assert sorted((r.doc_id for r in clean.collect()), key=key) == sorted((w[0] for w in want if not w[-1]), key=key)


def test_texts_are_cut_into_words_once(make_docs, make_items, monkeypatch):
    docs, items = contamination_rows()
    cut, words = [], decontamination.words
    monkeypatch.setattr(decontamination, "words", lambda text: cut.append(text) or words(text))
    got = decontamination.contaminated(make_docs(docs), make_items(items))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert len(cut) == 2 and "regexp" not in plan  # items and documents, both before the last step
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(str(i) for i, _ in docs)


def test_proximity_against_brute_force(make_docs, make_items):
    rng = np.random.default_rng(13)
    words = [f"p{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choice(words, 150))) for i in range(30)] + [(50, None), (51, "")]
    docs += [(60, " ".join(rng.permutation([f"q{i}" for i in range(12)]))), (61, " pad ".join(f"q{i}" for i in range(12)))]
    items = [(i, " ".join(rng.choice(words, 5))) for i in range(12)] + [(20, " ".join(f"q{i}" for i in range(12))), (21, "q3"), (22, None)]
    index = decontamination.Index(make_docs(docs), make_items(items))
    got = {(bytes(r.key), bytes(r.item), r.start, r["at"]) for r in decontamination.proximity(index, 10, 15).collect()}
    key = lambda t: hashlib.md5((t or "").encode()).digest()[:12]
    count = {}
    for _, t in docs:
        for w in tokens(t):
            count[w] = count.get(w, 0) + 1
    want = set()
    for _, item in items:
        w = tokens(item)
        size = min(10, len(w))
        for s in range(len(w) - size + 1 if w else 0):
            window = w[s : s + size]
            rarest = min(range(size), key=lambda q: (count.get(window[q], 0), q))
            for _, text in docs:
                t = tokens(text)
                for at, word in enumerate(t):
                    if word == window[rarest] and set(window) <= set(t[max(0, at - 15) : at + 16]):
                        want.add((key(text), key(item), s, at))
    assert got == want and len(want) > 20


def test_hits_of_empty_tables(make_docs, make_items):
    assert decontamination.contaminated(make_docs([]), make_items([(1, "a")])).count() == 0
    row = decontamination.contaminated(make_docs([(1, "a b")]), make_items([])).first()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (2, 0, 0, False)


# --- manifest ----------------------------------------------------------------------------------


def postorder(n, fan=manifest.FAN):
    """Nodes (height, number) of a tree in the order in which they are complete."""
    out = []

    def visit(height, at):
        if height:
            below = -(-n // fan ** (height - 1))
            for child in range(at * fan, min(at * fan + fan, below)):
                visit(height - 1, child)
        out.append((height, at))

    top = 0
    while fan**top < n:
        top += 1
    visit(top, 0)
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 4, 8, 9, 10, 26, 27, 28, 30, 82, 243, 730])
def test_positions_are_postorder(n):
    for place, (height, at) in enumerate(postorder(n)):
        assert manifest.position(height, at, n) == place


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(leaves):
    """The root, and per leaf its sibling steps."""
    level, at, steps = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for i, place in enumerate(at):
            first = place // 3 * 3
            steps[i].append(("".join(level[first:place]), "".join(level[place + 1 : first + 3])))
            at[i] = place // 3
        level = [sha(*level[i : i + 3]) for i in range(0, len(level), 3)]
    return level[0], steps


def brute_audit(rows):
    def leaf(r, text):
        values = [r[0], r[3], r[2], r[4], text]
        return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    trees = {}
    for r in rows:
        trees.setdefault(b"" if r[3] is None else b"=" + r[3].encode(), []).append(r)
    done = []
    for key in sorted(trees):
        group = sorted(trees[key], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        done.append((group, *brute_tree([leaf(r, r[1]) for r in group])))
    root, above = brute_tree([subroot for _, subroot, _ in done])
    out = []
    for (group, subroot, steps), upper in zip(done, above):
        for r, path in zip(group, steps):
            text = r[1]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = leaf(r, text)
            for before, after in path + upper:
                folded = sha(before, folded, after)
            proof = sha(*(x for step in path + upper for x in step))
            out.append((r[0], leaf(r, r[1]), subroot, root, proof, folded, folded == root))
    return out


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, tree string, digest string, place int, now int"


def audit_of(spark, rows):
    got = manifest.audited(spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], DOCUMENTS)).collect()
    fields = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r[f] for f in fields) for r in got), key=str)


def test_manifest_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), f"text {i}\nline" if i % 3 else f"plain {i}", "en", "hot", 5) for i in rng.permutation(2300)]
    rows += [(i, f"é{i}\n", None, f"s{i % 7}", None) for i in range(3000, 3040)]
    rows += [(None, "no id\n", "en", "s1", 3), (None, None, None, None, None), (5, "x", "en", None, 1), (6, None, "en", None, 1)]
    rows += [(3001, "other\n", "de", "s1", 7), (3001, "other\n", "de", "s1", 7), (4000, "", "en", "", 0), (4001, "a\n" * 50_000, "en", "é", 1)]
    assert audit_of(spark, rows) == sorted(brute_audit(rows), key=str)


def test_manifest_of_few_rows(spark):
    assert audit_of(spark, []) == []
    for rows in ([(1, "a\nb", "en", "s", 3)], [(1, "a", "en", "s", 1), (2, "b", "en", "s", 1)]):
        assert audit_of(spark, rows) == sorted(brute_audit(rows), key=str)


def test_inclusion_proofs_lead_to_the_root(make_docs):
    docs = make_docs([(i, f"t{i}", f"s{i % 5}") for i in range(60)])
    root = bytes(manifest.manifest(docs).root.first()["root"])
    proofs = manifest.inclusion(docs).collect()
    assert len(proofs) == 60
    for r in proofs:
        assert manifest._fold(bytes(r.digest), [s.asDict() for s in r.path]) == root


def test_proofs_over_three_rounds_of_builders(spark):
    def built(number, digests, n, tree="=a"):
        at = range(len(digests))
        batch = pa.RecordBatch.from_pydict(
            {"tree": [tree for _ in at], "round": [number for _ in at], "place": list(at), "n": [n for _ in at], "digest": digests}
        )
        return [tuple(r.values()) for out in manifest._build(iter([batch])) for r in out.to_pylist()]

    def root_of(nodes, place):
        return [r[6] for r in nodes if (r[3], r[4]) == (manifest.BLOCK, place)][0]

    block = manifest.FAN**manifest.BLOCK
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(2 * block)]
    # One block of the first round; the roots of the others are made up.
    first = built(0, digests[:block], block**2 + 1)
    second = built(1, [root_of(first, 0), *digests[block:]], block + 1)
    third = built(2, [root_of(second, 0), root_of(second, 1)], 2)
    other = built(0, [b"leaf"], 1, "=b")
    logs = [spark.createDataFrame(nodes, manifest.LOG) for nodes in (first + other, second, third)]
    leaves = [("=a", i, block**2 + 1) for i in range(block)] + [("=b", 0, 1)]
    beyond = spark.createDataFrame([("=a", []), ("=b", [])], f"tree string, {manifest.PATH}")

    def emit(ours, found):
        return pa.table({"tree": ours.column("tree"), "place": ours.column("place"), "path": pa.array(found, manifest._PATH)})

    leaves = spark.createDataFrame(leaves, "tree string, place long, n long")
    got = manifest.paths(leaves, logs, beyond, emit, f"tree string, place long, {manifest.PATH}").collect()
    assert len(got) == block + 1
    for r in got:
        path = [s.asDict() for s in r.path]
        if r.tree == "=b":
            assert path == []
        else:
            assert len(path) == 13 and manifest._fold(digests[r.place], path) == third[-1][6]
