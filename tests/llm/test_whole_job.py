"""Cases in which an operator once did less than its whole job."""

import base64
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from timeloom.llm import decontamination, language_id, license_scan, quality_rules, secret_scan, simhash, substring_dedup, subword_quality, suffix_tree_lm


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(n))


def test_substrings_of_copies_in_any_order(spark):
    shared = prose(1, 60)
    copied = prose(2, 20) + " " + shared
    rows = [(9, copied), (4, copied), (7, copied), (1, prose(3, 20) + " " + shared)]
    got = by_id(substring_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)))
    assert got[1].n_removed >= len(shared)
    assert [got[i].n_removed for i in (4, 7, 9)] == [len(copied)] * 3


def test_substrings_of_texts_whose_keys_look_like_a_copy(spark):
    """Texts that occur once, with the low 22 bits of a copied text's key."""
    shared, n = prose(4, 60), 64
    copied = [prose(100 + i, 50) for i in range(n)]
    low = F.xxhash64("text").bitwiseAND(F.lit((1 << 22) - 1)).alias("low")
    taken = {r.low for r in spark.createDataFrame([(t,) for t in copied], "text string").select(low).collect()}
    alike = spark.range(1_000_000).select(F.concat(F.lit(shared + " "), F.col("id").cast("string")).alias("text")).filter(low.isin(*taken)).limit(1).collect()[0].text
    rows = [(i, t) for i, t in enumerate(copied + copied)] + [(1000, alike), (1001, prose(5, 20) + " " + shared)]
    got = by_id(substring_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got[1000].n_removed >= len(shared) and got[1001].n_removed >= len(shared)


def test_scores_do_not_depend_on_the_head(docs):
    whole, small = (by_id(suffix_tree_lm.score(docs, head_words=n)) for n in (1 << 19, 200))
    assert len(whole) == len(small)
    for i, r in whole.items():
        assert small[i].n_known == r.n_known
        assert math.isclose(small[i].score, r.score, rel_tol=1e-9, abs_tol=1e-9)


def test_items_of_one_template_and_short_items(spark):
    pears = "a basket in the old kitchen holds 5 apples and {} pears so how many fruits are in the basket now"
    items = [(1, pears.format(5)), (2, pears.format(6)), (3, pears.format(6)), (4, "name the largest lake of northern europe today"), (5, "purple otters juggle"), (6, "12 7 Oslo 9 31 Rome 4 18 Bern 22 5 lakes")]
    texts = [prose(10 + i, 30) + f" {t} " + prose(30 + i, 30) for i, (_, t) in enumerate(items)]
    texts += [prose(50, 30), "purple otters never juggle", "12 7 Oslo 9 31 Rome 4 18 Bern 22 6 lakes"]
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.pairs(docs, benchmark).collect()}
    # a text with one number twice is a copy of items with two numbers too, but not the other way round
    assert set(got) == {(1, 1), (1, 2), (2, 2), (3, 2), (4, 4), (5, 5), (6, 6)}
    assert [got[p].same_values for p in ((1, 1), (1, 2), (2, 2), (3, 2), (5, 5))] == [True, False, True, True, True]
    assert {r.doc_id for r in decontamination.clean(docs, benchmark).collect()} == {7, 8, 9}


@pytest.mark.parametrize("columns", [16, 20, 32, 64])
@pytest.mark.parametrize("mark", ["", "  ", "\t", "> "])
@pytest.mark.parametrize("size", [500, 499, 484])
def test_wrapped_and_indented_keys(columns, mark, size):
    def der(tag, content):
        return bytes([tag, 0x82, *len(content).to_bytes(2, "big")]) + content

    content = b"".join(bytes([0x02, 1, i]) for i in range(8))
    key = der(0x30, content + der(0x02, random.Random(size).randbytes(size)))
    letters = base64.b64encode(key).decode()
    text = "key: |\n" + "".join(mark + letters[a : a + columns] + "\n" for a in range(0, len(letters), columns)) + mark + "-----END"
    (a, b, kind), = [s for s in secret_scan.confirmed_spans(text)]
    assert kind == "key" and text[a:b].strip().startswith(letters[:16]) and text[a:b].rstrip("=\n").endswith(letters.rstrip("=")[-4:])


def test_common_lines_weigh_by_use_and_copies_count(spark):
    own = lambda i: "\n".join(f"{prose(900 + 10 * i + k, 20)}" for k in range(3))
    footer = "all rights reserved by the operators of this page 2024"
    rows = [(i, own(i) + "\n" + "\n".join([footer] * (40 if i == 0 else 1)), "a") for i in range(120)]
    rows += [(200 + i, own(500) + "\n" + own(501), "b") for i in range(101)] + [(400, own(600), "b"), (401, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("rid", F.lit(5)).withColumn("host", F.lit("h"))
    got = by_id(quality_rules.judge(docs))
    assert got[0].share_left < 0.5 and not got[0].kept
    assert all(got[i].share_left > 0.5 and got[i].kept for i in range(1, 120))
    assert all(got[200 + i].share_left == 0 for i in range(101)) and got[400].share_left == 1 == got[401].share_left
    text = by_id(quality_rules.without_common_lines(docs))
    assert text[5].text == own(5) and text[0].text == own(0) and text[200].text == "" and text[400].text == own(600) and text[401].text is None
    assert text[5].rid == 5 and text[5].host == "h"


def test_long_texts_score_alike_in_any_pieces():
    import numpy as np

    rng = np.random.default_rng(3)
    model = subword_quality.Model(rng.normal(size=subword_quality.BUCKETS).astype(np.float32), 0.25)
    text = " ".join(random.Random(8).choice(["the", "the", "a  b", "x" * 70, "été", "Word\n"]) for _ in range(4000))
    whole = model.margin(text, 1 << 30)
    assert all(math.isclose(model.margin(text, n), whole, rel_tol=1e-9) for n in (1, 7, 100, 4096))
    got = model.margins([text[:40], None, text, "the", "the", text[:99]], 1 << 18)
    assert np.allclose(got, [model.margin(t, 1 << 30) for t in (text[:40], None, text, "the", "the", text[:99])], rtol=1e-9)


def test_short_and_rare_languages_are_learned(spark):
    words = {"en": "the with and of from", "de": "und der nicht mit aus", "fr": "les des avec pour dans"}
    rows = [(i, " ".join(random.Random(i).sample(words[x].split(), 4)), x) for i in range(400) for x in [("en", "en", "en", "de")[i % 4]]]
    rows += [(1000 + i, words["fr"][:17], "fr") for i in range(4)] + [(2000 + i, words[x], None) for i, x in enumerate(words)]
    got = by_id(language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_rows=60))
    assert [got[2000 + i].lang_pred for i in range(3)] == list(words)


def test_licenses_end_at_words(spark):
    find = license_scan.Finder()
    for text in ("licensed under cc by nc 4 0abcdefg", "released under the mit licenseexyzabc", "xyzreleased under the mit licenseabc"):
        for n, a, b, edits in find.find(text):
            notice, _, k = find.notices[n]
            assert text[a - 1 : a] in ("", " ") and text[b : b + 1] in ("", " ") and edits <= k
    assert find.find("released under the mit licenseexyzabc") == []
    long = "word " * 40_000 + "released under the mitt license " + "word " * 40_000
    row = spark.createDataFrame([(1, long)], "doc_id long, text string")
    assert license_scan.scan(row).collect()[0].spans == "mit:40000:40005:1"


def edited(seed, text, share):
    r = random.Random(seed)
    return " ".join(prose(seed * 977 + i, 1) if r.random() < share else w for i, w in enumerate(text.split()))


def test_near_copies_of_any_length(spark):
    passage = prose(70, 60)
    base = [prose(7000 + i, n) for i, n in enumerate((40, 60, 90, 150, 400, 3000))]
    rows = [(100 * i + k, edited(31 * i + k, t, 0.04) if k else t) for i, t in enumerate(base) for k in range(4)]
    rows += [(9000 + i, prose(8000 + i, 150) + " " + passage + " " + prose(8500 + i, 150)) for i in range(60)]
    rows += [(500_000 + i, edited(600 + i, base[3], 0.03)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_id", F.col("doc_id") + 7).withColumn("_key", F.lit(3)).withColumn("_turn", F.lit(9)).withColumn("th", F.lit(1))
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    kept = {r.doc_id: r for r in got.collect()}
    assert all(r._id == i + 7 and r._key == 3 and r._turn == 9 and r.th == 1 for i, r in kept.items())
    assert all(9000 + i in kept for i in range(60)), "documents that share a passage aren't copies"
    copies = [i for i, t in rows if not 9000 <= i < 9100 and i not in {100 * k for k in range(6)}]
    assert {100 * k for k in range(6)} <= set(kept) and sum(i in kept for i in copies) <= 0.05 * len(copies)
    # every link holds 0.8 of both texts' words in common runs of five words
    texts = dict(rows)
    made, linked = simhash.near_copies(docs)
    of = {bytes(r.th): texts[r.doc_id].split() for r in made.collect()}

    def share(a, b):
        five = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        both = five(a) & five(b)
        inside = lambda w: len({j for i in range(len(w) - 4) if tuple(w[i : i + 5]) in both for j in range(i, i + 5)})
        return (inside(a) + inside(b)) / (len(a) + len(b))

    found = linked.collect()
    assert found and all(share(of[bytes(r.a)], of[bytes(r.b)]) >= 0.8 for r in found)


def test_texts_without_words_are_copies(spark):
    docs = spark.createDataFrame([(1, ""), (2, " \n"), (3, None), (4, None), (None, "a"), (None, "a"), (5, "A"), (6, "b")], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == [1, 5, 6]


def test_all_near_copies_of_a_crowd_are_linked(spark):
    """Texts that share 0.7 of their words; of some pairs the rest differs at every sixth word, so that it shares hardly a shingle."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    common, texts = " ".join(word() for _ in range(210)), []
    for i in range(60):
        own = [word() for _ in range(90)]
        texts.append(f"{common} {' '.join(own)}")
        if i < 30:
            texts.append(f"{common} {' '.join(w if k % 6 else word() for k, w in enumerate(own))}")
    _, linked = simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    keys = [hashlib.md5(t.encode()).digest() for t in texts]
    roots = {bytes(r.node): bytes(r.root) for r in simhash.components(linked).collect()}
    sketches = simhash.sketches(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5).collect()
    bits = {bytes(r.th): r.fp & (1 << 64) - 1 for r in sketches}
    close = [(a, b) for a, b in zip(keys[:60:2], keys[1:60:2]) if (bits[a] ^ bits[b]).bit_count() <= 24]
    assert len(close) >= 25 and all(simhash.common_share(a, b, 5) >= 0.8 for a, b in zip(texts[:60:2], texts[1:60:2]))
    assert [p for p in close if roots.get(p[0], 0) != roots.get(p[1], 1)] == []


def test_near_copies_in_crowds_that_share_paragraphs(spark):
    """Texts of five of twelve paragraphs, at most three of which any two share, and the same with three more words: all in crowds."""
    from itertools import combinations

    parts, chosen = [prose(40_000 + i, 40) for i in range(12)], []
    for own in combinations(range(12), 5):
        if all(len(set(own) & set(x)) <= 3 for x in chosen):
            chosen.append(own)
    rows = []
    for k, own in enumerate(chosen):
        t = " ".join(parts[i] for i in own)
        rows += [(2 * k, t), (2 * k + 1, t + " three more words")]
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(chosen) > 50
    assert kept == {2 * k for k in range(len(chosen))}


def test_recall_of_pairs_at_the_threshold(spark):
    """Random pairs with a little more than 0.8 of their words in common runs, at random places."""
    rng = np.random.default_rng(8)
    rows, shares = [], []
    for k in range(300):
        words = [f"w{int(x)}" for x in rng.integers(0, 50_000, int(rng.integers(60, 700)))]
        other = list(words)
        for at in rng.choice(len(words), int(len(words) * rng.uniform(0.03, 0.09)), replace=False):
            other[at] = f"x{k}-{at}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        shares.append(simhash.common_share(rows[-2][1], rows[-1][1], 5))
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    near = [k for k, s in enumerate(shares) if 0.8 <= s < 0.92]
    assert len(near) > 100
    assert sum(2 * k + 1 not in kept for k in near) >= 0.9 * len(near)
    assert all(2 * k + 1 in kept for k, s in enumerate(shares) if s < 0.8)


def test_texts_full_of_one_phrase_cost_no_matching():
    """A megabyte of a notice's phrase again and again is read in seconds, and a notice amid it is still found."""
    import time

    find, began = license_scan.Finder(), time.time()
    text, label, most = max(license_scan.NOTICES, key=lambda x: x[2])
    phrase = " ".join(text.split()[:4]) + " "
    assert find.find(phrase * (1_000_000 // len(phrase))) == []
    assert time.time() - began < 20
    edited_text = text[: len(text) // 2] + "zz" + text[len(text) // 2 + 1 :]
    got = find.find(phrase * 200 + edited_text + " " + phrase * 200)
    assert [find.notices[n][1] for n, *_ in got] == [label]
    assert most > 2


def test_pieces_in_step():
    assert license_scan.in_step([(10, 0), (12, 3), (13, 6), (40, 0), (41, 0), (90, 3)], 5, 3) == [10, 12, 13]
    assert license_scan.in_step([(10, 0), (14, 3), (18, 6)], 5, 3) == []
    assert license_scan.in_step([(10, 0)], 5, 1) == [10]
