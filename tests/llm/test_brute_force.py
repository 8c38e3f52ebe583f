"""Operators against plain versions on a small table of the given data, and planted cases."""

import base64
import collections
import hashlib
import json
import math
import re
import zlib

import numpy as np
import pytest

from timeloom.llm import _shared, decontamination, language_id, license_scan, mixing, secret_scan, simhash, subword_quality, substring_dedup, suffix_tree_lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_mixing(docs, texts):
    got = by_id(mixing.mix(docs))
    source = {r.doc_id: r.source for r in docs.collect()}
    size = {i: len(WORD.findall(t or "")) for i, t in texts.items()}
    total = collections.Counter()
    for i, n in size.items():
        total[source[i]] += n
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(total))}
    target, capped = {}, set()
    while True:
        rest = sum(total.values()) - sum(3 * total[s] for s in capped)
        w = sum(weight[s] for s in total if s not in capped)
        target = {s: 3 * total[s] if s in capped else rest * weight[s] / w for s in total}
        over = {s for s in total if s not in capped and target[s] > 3 * total[s]}
        if not over:
            break
        capped |= over
    taken = collections.Counter()
    for i, r in got.items():
        assert r.size == size[i] and r.source_size == total[source[i]]
        assert math.isclose(r.target, target[source[i]], rel_tol=1e-9)
        assert r.taken <= 3 * r.size
        taken[source[i]] += r.taken
    for s in total:
        assert abs(taken[s] - target[s]) <= 0.03 * target[s] + 64
    assert got == by_id(mixing.mix(docs))


def test_mixing_caps_small_sources(spark):
    rows = [(i, "w " * 100, "a" if i < 2 else "b" if i < 4 else "c") for i in range(400)]
    got = by_id(mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert got[0].target == 600.0 and got[2].target == 600.0 and got[10].target == 40000.0 - 1200


def test_permutation_is_one(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 3, 17, 100):
        got = spark.range(n).select(mixing._permuted(F.col("id"), F.lit(n), F.lit(5)).alias("x")).collect()
        assert sorted(r.x for r in got) == list(range(n))


def test_simhash(docs, texts):
    from xxhash import xxh64_intdigest

    def fp(text):
        words = WORD.findall(lowered(text))
        grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    want = {i: fp(t) for i, t in texts.items()}
    got = by_id(simhash.components_of(docs))
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{x:016x}" for i, x in want.items()}
    assert {i: r.component_id for i, r in got.items()} == joined(want)


def joined(fps):
    root = {i: i for i in fps}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for i in ids:
        for j in ids:
            if j < i and (fps[i] ^ fps[j]).bit_count() <= 2 and top(i) != top(j):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("large", [48, 2])
def test_links_in_chains_and_crowds(spark, large):
    rng = np.random.default_rng(1)
    made = set()
    for _ in range(6):
        x = int(rng.integers(0, 1 << 62))
        for _ in range(40):
            made.add(x)
            for b in rng.integers(0, 64, int(rng.integers(1, 4))):
                x ^= 1 << int(b)
    fps = dict(enumerate(sorted(made)))
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps.values()]
    roots = {r.node & ((1 << 64) - 1): r.root for r in simhash.components(simhash.links(spark.createDataFrame(signed, "fp long"), 2, large)).collect()}
    want = joined(fps)
    groups = collections.defaultdict(set)
    for i, f in fps.items():
        groups[want[i]].add(f)
    got = collections.defaultdict(set)
    for f in made:
        got[roots.get(f, ("alone", f))].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


@pytest.mark.parametrize("crowd", [2000, 2])
def test_substrings(docs, texts, crowd):
    seen = collections.Counter(w for t in texts.values() for w in windows(t))
    got = by_id(substring_dedup.digest(docs, crowd=crowd, shard_bytes=50_000))
    for i, t in texts.items():
        data = (t or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for a, w in enumerate(windows(t)):
            if seen[w] > 1:
                gone[a : a + 200] = True
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()), i


def windows(text):
    data = (text or "").encode()
    return [data[a : a + 200] for a in range(len(data) - 199)]


def test_substrings_periodic(spark):
    rows = [(0, "ab" * 400), (1, "x" * 199), (2, "y" * 200), (3, "z" * 201), (4, "q" + "ab" * 99 + "r")]
    got = by_id(substring_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [got[i].n_removed for i in range(5)] == [800, 0, 0, 201, 0]


def test_suffix_ranks_are_the_order():
    rng = np.random.default_rng(2)
    raw = np.concatenate([rng.integers(97, 99, 300), np.full(40, 255)]).astype(np.uint8)
    rank = substring_dedup.suffix_ranks(raw, 300)
    data = raw.tobytes()
    assert np.argsort(rank[:300]).tolist() == sorted(range(300), key=lambda i: data[i:300] + b"\xff" * (400 - (300 - i)))


@pytest.mark.parametrize("head", [1 << 19, 200])
def test_word_counts_of_the_model(docs, texts, head):
    tokens = {i: WORD.findall(lowered(t)) + ["\n"] for i, t in texts.items()}
    c = collections.Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    got = by_id(suffix_tree_lm.score(docs, head_words=head))
    for i, ws in tokens.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(w in c for w in ws), n, zlib.crc32(str(i).encode()) % 7 == 2)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert r.score < 0


def suffix_tree(training, depth, strength, least_gain):
    """The model's function of a context and a token, by its definition."""
    c = collections.Counter(tuple(ws[i : i + k]) for ws in training for k in range(1, depth + 2) for i in range(len(ws) - k + 1))
    n, v = sum(x for g, x in c.items() if len(g) == 1), sum(len(g) == 1 for g in c)
    states, counted = {}, {g for g, x in c.items() if len(g) <= 2}

    def p(context, w):
        if not context:
            return (c[(w,)] + 1) / (n + v + 1)
        if context not in states:
            return p(context[1:], w)
        kept, left = states[context]
        return (kept.get(w, 0) + left * p(context[1:], w)) / (c[context] + strength)

    for k in range(2, depth + 2):
        kept = collections.defaultdict(dict)
        if k > 2:
            twice = {g for g in counted if len(g) == k - 1 and c[g] > 1}
            room = {g for g in twice if -c[g] * math.log(p(g[:-1], g[-1])) >= least_gain}
            counted |= {g for g in c if len(g) == k and g[:-1] in twice and g[1:] in room}
        for g, x in c.items():
            if g in counted and len(g) == k and x > 1 and x * math.log(x / c[g[:-1]] / p(g[1:-1], g[-1])) >= least_gain:
                kept[g[:-1]][g[-1]] = x
        states |= {s: (t, c[s] - sum(t.values()) + strength) for s, t in kept.items()}
    return p


@pytest.mark.parametrize("options", [{}, {"depth": 1, "least_gain": 8.0}, {"depth": 3, "least_gain": 4.0, "strength": 2.0}, {"head_words": 50, "head_runs": 20}])
def test_suffix_tree(docs, texts, options):
    tokens = {i: WORD.findall(lowered(t)) + [0] for i, t in texts.items()}
    settings = {"depth": 2, "strength": 1.0, "least_gain": 20.0} | options
    depth = settings["depth"]
    p = suffix_tree([ws for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2], depth, settings["strength"], settings["least_gain"])
    got = by_id(suffix_tree_lm.score(docs, **options))
    for i, ws in tokens.items():
        want = sum(math.log10(p(tuple(ws[max(0, k - depth) : k]), w)) for k, w in enumerate(ws))
        assert math.isclose(got[i].score, want, rel_tol=1e-9, abs_tol=1e-9), i
    assert sum(r.score > r.base_score for r in got.values()) > 10


def test_run_keys_are_those_of_spark(spark):
    from pyspark.sql import functions as F

    x = np.random.default_rng(6).integers(-(1 << 63), 1 << 63, (20, 2), dtype=np.int64)
    rows = spark.createDataFrame([tuple(map(int, r)) for r in x], "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("h")).collect()
    got = _shared.run_key(np.array([r.a for r in rows]).view(np.uint64), np.array([r.b for r in rows]).view(np.uint64)).view(np.int64)
    assert got.tolist() == [r.h for r in rows]


def test_tokens_in_pieces(monkeypatch):
    texts = ["A b\tb  c", None, "", "x" * 3000 + " é", " lead"]
    whole = _shared.tokens(texts)
    assert whole[1].sum() == 5 and len(whole[0]) == 4 + 1 + 1 + 1 + 2 + 1 + 1 + 1 and whole[0][1] == whole[0][2]
    monkeypatch.setattr(_shared, "PIECE", 7)
    assert all((a == b).all() for a, b in zip(whole, _shared.tokens(texts)))


def test_licenses(docs, texts):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    got = by_id(license_scan.scan(docs))
    for i, t in texts.items():
        ws = word.findall(lowered(t))
        places = [(a, label) for p, label in license_scan.PHRASES for a in range(len(ws)) if ws[a : a + len(p.split())] == p.split()]
        r = got[i]
        want = len(ws), len(places), min((a for a, _ in places), default=None), max((a for a, _ in places), default=None), ",".join(sorted({x for _, x in places}))
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_licenses_with_edits():
    find = license_scan.Finder()
    label = lambda t: {find.notices[n][1] for n, *_ in find.find(t)}
    assert label("relased under the mitt license") == {"mit"}
    assert label("licensed under the gnu genral public licence version 3") == {"gpl-3"}
    assert label("it is in the public library and has no license at all") == set()
    assert label("x") == label("") == set()


def test_secrets(docs, texts):
    got = by_id(secret_scan.scan(docs))
    for i, t in texts.items():
        t = t or ""
        found = [(m.start(), m.end(), "assign") for m in re.finditer(r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t) if len(m[1]) > 5]
        found += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        listed = ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(found, key=lambda s: (s[0], ("assign", "access", "hex").index(s[2]))))
        assert got[i].base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(got[i].spans.split(","))


def der(tag, content):
    n = len(content)
    return bytes([tag]) + (bytes([n]) if n < 128 else b"\x82" + n.to_bytes(2, "big")) + content


def test_confirmed_secrets():
    number = lambda n: der(2, b"\x01" * n)
    rsa = der(0x30, der(2, b"\0") + b"".join(number(n) for n in (128, 3, 128, 64, 64, 64, 64, 64)))
    wrapped = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2a\x86\x48") + der(5, b"")) + der(4, rsa))
    field = lambda b: len(b).to_bytes(4, "big") + b
    ssh = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(b"p" * 51) + field(b"s" * 136)
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    token = f"{part({'alg': 'HS256'})}.{part({'sub': 'a'})}.c2lnbmF0dXJl"
    kinds = lambda t: [k for _, _, k in secret_scan.confirmed_spans(t)]
    for key in (rsa, wrapped):
        assert kinds("x " + base64.b64encode(key).decode() + " y") == ["key"]
        assert kinds("-----BEGIN KEY-----\n" + base64.encodebytes(key).decode() + "-----END KEY-----") == ["key"]
        assert kinds("x " + key.hex() + " y") == ["key"]
        assert kinds(base64.b64encode(key[:-1]).decode()) == []
    assert kinds(base64.b64encode(ssh).decode()) == ["openssh"]
    assert kinds(f"bearer {token} end") == ["token"]
    assert kinds(token.replace("ey", "fy", 1)) == []
    assert kinds("word " * 50 + base64.b64encode(b"nothing to see here" * 9).decode()) == []


def test_decontamination(spark):
    item = "In 1998 the farmer Anna sold 35 kg of apples to her neighbour Bob for 12 dollars and gave 7 more to Anna on the next market day."
    other = item.replace("1998", "2011").replace("35", "64").replace("12", "90").replace("Anna", "Clara").replace("Bob", "Dieter")
    broken = other.replace("Clara on", "Emil on")
    rows = [(1, f"Some text before. {item} And after."), (2, f"Some text. {other} And after."), (3, f"Some text. {broken} End."), (4, "Nothing of the kind is in here, not one word of it, whatever the question was about."), (5, item[:40])]
    got = {r.doc_id: r for r in decontamination.pairs(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item), (9, item)], "item_id long, text string")).collect()}
    assert set(got) == {1, 2}
    assert got[1].same_values and not got[2].same_values and {r.item_id for r in got.values()} == {7}


def test_languages_held_out(docs):
    rows = {r.doc_id: r.lang for r in docs.collect()}
    got = by_id(language_id.identify(docs))
    tested = [i for i, r in got.items() if r.held_out]
    assert tested and sum(got[i].lang_pred == rows[i] for i in tested) >= 0.9 * len(tested)


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    inputs, recurrent = rng.normal(0, 0.5, (256, 9)), rng.normal(0, 0.5, (9, 3))
    x = rng.integers(0, 256, (5, 4))
    goal = [rng.normal(size=(3, 4)) for _ in range(5)]
    loss = lambda p: sum(float((g * s[4]).sum()) for g, s in zip(goal, p.states(x)))
    p = language_id.Pass(inputs, recurrent)
    d_inputs, d_recurrent = p.gradients(x, p.states(x), goal)
    for array, grad, at in ((recurrent, d_recurrent, (4, 1)), (recurrent, d_recurrent, (7, 2)), (inputs, d_inputs, (x[2, 1], 5))):
        array[at] += 1e-3
        up = loss(p)
        array[at] -= 2e-3
        down = loss(p)
        array[at] += 1e-3
        assert math.isclose((up - down) / 2e-3, grad[at], rel_tol=0.02, abs_tol=2e-3)


def test_quality_held_out(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = [(r.score, truth[r.doc_id]) for r in subword_quality.score(docs, labels).collect() if r.held_out and r.doc_id in truth]
    good, bad = [s for s, y in got if y], [s for s, y in got if not y]
    assert good and bad and sum((a > b) + 0.5 * (a == b) for a in good for b in bad) >= 0.9 * len(good) * len(bad)


def test_mixing_of_sources_below_a_block(spark):
    rows = [(i, "one two three four five", f"s{i}") for i in range(6)] + [(10 + i, "w " * 50, "s9") for i in range(20)]
    got = by_id(mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert [got[i].target for i in range(6)] == [15.0] * 6 and [got[i].taken for i in range(6)] == [15] * 6


def test_mixture_is_the_texts(docs):
    taken = {r.doc_id: r for r in mixing.mix(docs).collect()}
    words, rows = collections.Counter(), mixing.mixed(docs).collect()
    for r in rows:
        assert len(WORD.findall(r.text)) == r.n_words <= 32
        if len(r.doc_ids) == 1:
            words[r.doc_ids[0]] += r.n_words
    assert sum(r.n_words for r in rows) == sum(r.taken for r in taken.values())
    assert all(words[i] <= r.taken for i, r in taken.items())
    counts = collections.Counter(r.shard for r in rows)
    assert all(n == 1024 for s, n in counts.items() if s != max(counts))
