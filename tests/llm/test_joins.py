"""Merkle manifests, Jaccard joins and spelling variants against plain versions, in crowds, ties and odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_edges import SCHEMA, rows, text
from timeloom.llm import jaccard_join, merkle_manifest, spelling_variants

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lowered(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves, arity):
    """The root, and of each leaf what stands left and right of it at each level."""
    paths, nodes, under = [[] for _ in leaves], list(leaves), [[i] for i in range(len(leaves))]
    while len(nodes) > 1:
        for i, own in enumerate(under):
            at = i // arity * arity
            for k in own:
                paths[k].append(("".join(nodes[at:i]), "".join(nodes[i + 1 : at + arity])))
        under = [sum(under[a : a + arity], []) for a in range(0, len(nodes), arity)]
        nodes = [digest(*nodes[a : a + arity]) for a in range(0, len(nodes), arity)]
    return nodes[0], paths


def plain_audit(data, arity):
    groups, out = collections.defaultdict(list), {}
    for doc_id, t, lang, source, n in data:
        groups[lang].append((doc_id, leaf(doc_id, source, lang, n, t), leaf(doc_id, source, lang, n, lowered(t) if t is not None else None)))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: plain_tree([x[1] for x in sorted(groups[g])], arity) for g in langs}
    root, above = plain_tree([trees[g][0] for g in langs], arity)
    for g, upper in zip(langs, above):
        for (doc_id, own, tampered), path in zip(sorted(groups[g]), trees[g][1]):
            path, now = path + upper, tampered if zlib.crc32(str(doc_id).encode()) % 3 == 0 else own
            for a, b in path:
                now = digest(a, now, b)
            out[doc_id] = (own, trees[g][0], root, digest(*(a + b for a, b in path)), now, now == root)
    return out


@pytest.mark.parametrize("arity,n", [(8, 150), (2, 37), (3, 10), (8, 8), (8, 1)])
def test_manifest(spark, arity, n):
    rng = random.Random(n)
    data = [(i * 7, rng.choice(["Ab c", "", None, "é" * 9, "x"]) or None, rng.choice([None, "de", "é", "en", "en", "en", "en"]), rng.choice(["s", None]), rng.choice([3, None])) for i in range(n)]
    if n == 150:
        data.append((9999, "Alone", "zz", "s", 5))
    got = {r.doc_id: tuple(r)[1:] for r in merkle_manifest.audit(spark.createDataFrame(data, DOCS).repartition(5), arity).collect()}
    assert got == plain_audit(data, arity)


def test_manifest_of_odd_rows(spark):
    got = merkle_manifest.audit(spark.createDataFrame(rows(), SCHEMA).repartition(3)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows())
    assert len({r.root for r in got}) == 1
    assert all(r.verified == (r.folded_root == r.root) for r in got)
    assert merkle_manifest.audit(spark.createDataFrame([], SCHEMA)).collect() == []


def test_every_row_is_folded(spark, monkeypatch):
    """A wrong sibling is noticed by rows that nobody tampered with, too."""
    made = merkle_manifest.manifest
    wrong = F.transform("path", lambda s: F.struct(s["left"].alias("left"), F.concat(s["right"], F.lit(b"x").cast("binary")).alias("right")))
    monkeypatch.setattr(merkle_manifest, "manifest", lambda *a, **k: made(*a, **k).withColumn("path", wrong))
    got = merkle_manifest.audit(spark.createDataFrame([(i, "t", "en", "s", 1) for i in range(20)], DOCS)).collect()
    assert len(got) == 20 and not any(r.verified for r in got)


def plain_classes(texts, size=5):
    """Set size and least id reachable, by counting common shingles of all pairs."""
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(lowered(t))
        sets[i] = frozenset(" ".join(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([" ".join(w)] if w else [])
    inverse, root = collections.defaultdict(list), {i: i for i in texts}
    for i, s in sets.items():
        for x in s:
            inverse[x].append(i)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        common = collections.Counter(j for x in s for j in inverse[x] if j < i)
        for j, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: (len(s), top(i)) for i, s in sets.items()}



def test_jaccard_over_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join_classes(docs).collect()} == plain_classes(texts)


def crowd(seed):
    """Near copies on both sides of the threshold, passages that a crowd shares, chains, and texts of few words."""
    rng, made = random.Random(seed), []
    word = lambda: "w%d" % rng.randrange(5000)
    passages = [[word() for _ in range(40)] for _ in range(6)]
    for _ in range(40):  # five of six passages and a little of their own
        made.append(sum(rng.sample(passages, 5), []) + [word() for _ in range(rng.randrange(12))])
    for _ in range(5):
        base = [word() for _ in range(rng.choice([8, 30, 120, 400]))]
        for _ in range(25):
            own = list(base)
            for _ in range(rng.randrange(1 + len(own) // 25)):
                own[rng.randrange(len(own))] = word()
            made.append(own)
            base = own if rng.random() < 0.5 else base
    made += [["a"], ["A"], ["a", "b"], ["a", "b", "c", "d"], ["a", "b", "c", "d", "e"], [], ["."]]
    return {i: " ".join(w) for i, w in enumerate(made)}


@pytest.mark.parametrize("rounds", [3, 0])
def test_jaccard_in_crowds(spark, rounds):
    texts = crowd(64 + rounds)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    made, found = jaccard_join.classes(docs, rounds=rounds)
    roots = {bytes(r.node): bytes(r.root) for r in found.collect()}
    groups = collections.defaultdict(set)
    for r in made.collect():
        groups[(roots.get(bytes(r.sid), bytes(r.sid)) if r.sid is not None else r.doc_id)].add(r.doc_id)
    want = collections.defaultdict(set)
    for i, (_, root) in plain_classes(texts).items():
        want[root].add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_prefixes_of_linked_sets_meet():
    rng = np.random.default_rng(3)
    frequent, rank = np.sort(rng.integers(0, 1 << 62, 50).astype(np.uint64)), rng.permutation(50)
    for _ in range(300):
        m = int(rng.integers(1, 200))
        common = np.unique(np.concatenate([rng.integers(0, 1 << 62, m).astype(np.uint64), rng.choice(frequent, 5)]))
        extra = int(len(common) / 4)  # common / (common + extra) >= 0.8
        k = int(rng.integers(0, extra + 1))
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 62, n).astype(np.uint64)])) for n in (k, extra - k))
        for seed in jaccard_join.ORDERS:
            p, q = (jaccard_join.prefix(x, seed, frequent, rank) for x in (a, b))
            assert len(p) == jaccard_join.prefix_size(len(a)) and len(q) == jaccard_join.prefix_size(len(b))
            assert np.intersect1d(p, q).size >= jaccard_join.need(min(len(a), len(b)))


def test_pairs_at_the_limit_share_a_class(spark):
    # sets that are just linked, of sizes around those where the number of classes changes
    rng, ends = np.random.default_rng(5), []
    for k, m in enumerate([1, 2, 5, 9, 63, 64, 80, 127, 128, 129, 150, 159, 160, 255, 256, 300, 320, 700, 1100] * 3):
        n = int(rng.integers(jaccard_join.least_common(m), m + 1))
        common = -(-8 * (m + n) // 18)  # the least with which they are linked
        if common > n:
            continue
        tokens = rng.choice(1 << 62, m + n - common, replace=False).astype(np.uint64) * np.uint64(4)
        ends += [(k * 2, np.sort(tokens[:m])), (k * 2 + 1, np.sort(np.concatenate([tokens[:common], tokens[m:]])))]
    sets = spark.createDataFrame([(i.to_bytes(16, "big"), bytearray(t.tobytes()), i) for i, t in ends], "sid binary, tokens binary, root long")
    frequent = np.sort(rng.choice(np.concatenate([t for _, t in ends]), 500)), rng.permutation(500)
    found = {(int.from_bytes(r.a, "big"), int.from_bytes(r.b, "big")) for r in jaccard_join.class_pairs(jaccard_join.class_prefixes(sets, frequent)).collect()}
    assert {(i, i + 1) for i, _ in ends[::2]} <= found and len(ends) > 80


def test_texts_that_are_not_near_make_no_pairs(spark, monkeypatch):
    # each two of a family have half their shingles in common, so all share many tokens, but none are linked
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(600)]
    family = [" ".join(f"x{k}_{i}" if hit else w for i, (w, hit) in enumerate(zip(base, rng.random(600) < 0.035))) for k in range(60)]
    made, whole = [], jaccard_join.linked
    monkeypatch.setattr(jaccard_join, "linked", lambda pairs, sets: made.append(pairs.count()) or whole(pairs, sets))
    _, found = jaccard_join.classes(spark.createDataFrame([(i, t) for i, t in enumerate(family)], "doc_id long, text string"), rounds=1)
    assert found.count() == 0 and made[-1] < 60


def test_jaccard_of_odd_rows(spark):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    got = jaccard_join.join_classes(docs).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows())
    of = collections.defaultdict(set)
    for r in got:
        of[r.doc_id].add((r.n_shingles > 0, r.component_id))
    assert of[3] == {(True, 3)} and of[23] == {(True, 3)}
    assert of[20] == {(False, 20)} and of[21] == {(False, 21)} and of[22] == {(False, 22)}
    assert of[None] == {(True, None), (False, None)}
    assert jaccard_join.join_classes(docs.limit(0)).collect() == []


def plain_words(data):
    count = collections.Counter()
    for doc_id, t in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lowered(run)
            h = zlib.crc32(f"{doc_id}:{run}".encode()) if doc_id is not None else 1
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= 2}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(data):
    words, out = plain_words(data), {}
    for w, n in words.items():
        own = [v for v in words if near(w, v)]
        best = min(own, key=lambda v: (-words[v], v), default=None)
        out[w] = (n, len(own), best if best and words[best] >= 10 * n else None)
    made = {}
    for w, (n, k, form) in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        made[w] = (form, root, n, k, words[form] if form else None)
    return made


def spelling_rows():
    """Chains of forms, doubled letters, ties, accents, words of six and seven letters, slips in hot words."""
    text = " ".join(["abcdefgh"] * 4000 + ["abcdefgg"] * 300 + ["abcdefggg"] * 25 + ["abcdefgggg"] * 2 + ["bbbbbbb", "bbbbbbbb"] * 3 + ["çedillàs", "Çedillàs"] * 30 + ["çedillàz", "cedillàs"] * 2)
    more = " ".join(["planets", "planetz", "planeta", "plänets"] * 2 + ["planetary"] * 50 + ["sixsix"] * 9 + ["x×y÷zzzz"] * 2 + ["ONE_two-three4fourfive"] * 3)
    return [(i, text if i < 3 else more.replace("planets", "planets " * i)) for i in range(12)] + [(None, "planets planets"), (99, None), (100, ""), (100, "planetz planetz"), (100, "planetz planetz")]


def test_variants_against_all_pairs(spark):
    data = spelling_rows()
    got = {r.word: tuple(r)[1:] for r in spelling_variants.variants(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()}
    want = plain_variants(data)
    assert got == want
    assert max(collections.Counter(r[1] for r in want.values()).values()) > 3
    assert want["abcdefgggg"][0] == "abcdefggg" and want["abcdefgggg"][1] == "abcdefgh"


def test_variants_over_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = spelling_variants.vocabulary(spelling_variants.occurrences(docs))
    assert {r.word: r.n for r in words.collect()} == plain_words([(r.doc_id, r.text) for r in docs.collect()])


def test_variants_of_odd_rows(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    got = {r.word: r.n for r in spelling_variants.variants(docs).collect()}
    assert got == plain_words([(r[0], r[1]) for r in rows()])
    assert spelling_variants.variants(docs.limit(0)).collect() == []


def test_a_long_text(spark):
    data = [(i, text(7, 40_000) + f" own{i}", "en", "s", 1) for i in range(3)] + [(9, "a" * 3_000_000, "en", "s", 1), (10, "Z" * 3_000_000, "en", "s", 1)]
    docs = spark.createDataFrame(data, DOCS)
    got = {r.doc_id: r.component_id for r in jaccard_join.join_classes(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 9: 9, 10: 10}
    assert {r.doc_id: tuple(r)[1:] for r in merkle_manifest.audit(docs).collect()} == plain_audit(data, 8)
    assert spelling_variants.variants(docs).filter(F.length("word") > 1000).count() == 0
