"""Every operator on nulls, empty texts, repeated rows, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

from timeloom.llm import decontamination, language_id, license_scan, mixing, quality_rules, secret_scan, simhash, subword_quality, substring_dedup, suffix_tree_lm
from timeloom.llm.queries import queries

WORDS = "the quick brown fox jumps over the lazy dog and runs far away from all of the others in the wide green field".split()


def text(i, n=60):
    return " ".join(WORDS[(i * 7 + k * k) % len(WORDS)] + str(i if k % 5 == 0 else "") for k in range(n))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, score string, key string, row string, fp string, held_out int, block int, _row int"


def rows():
    made = [(i, text(i), "en" if i % 2 else "fr", f"s{i % 3}") for i in range(12)]
    made += [(20, None, None, None), (21, "", "en", "s0"), (22, " \n\t", None, "s1"), (None, text(50), "en", "s1"), (None, None, None, None)]
    made += [(23, text(3), "fr", "s0")] * 3 + [(24, "#### 123 %%%", "en", None), (25, text(77, 30_000), "en", "s2"), (26, "é" * 500, "fr", "s2")]
    return [(a, t, lang, src, len(t or ""), 1, "x", "k", "r", "f", 3, 9, 4) for a, t, lang, src in made]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, text(5)), (2, None), (3, ""), (4, "too short"), (None, text(6))], "item_id long, text string")


def operators(labels, benchmark):
    return {
        1: lambda d: mixing.mix(d),
        2: lambda d: decontamination.pairs(d, benchmark),
        3: lambda d: language_id.identify(d, rounds=3),
        4: lambda d: license_scan.scan(d),
        5: lambda d: simhash.components_of(d),
        6: lambda d: subword_quality.score(d, labels, epochs=1),
        7: lambda d: substring_dedup.digest(d),
        8: lambda d: secret_scan.scan(d),
        9: lambda d: quality_rules.judge(d),
        10: lambda d: suffix_tree_lm.score(d),
    }


@pytest.mark.parametrize("n", range(1, 11))
def test_odd_rows(n, docs, labels, benchmark):
    got = operators(labels, benchmark)[n](docs).collect()
    if n == 2:
        assert (5, 1) in {(r.doc_id, r.item_id) for r in got}
    else:
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows())


@pytest.mark.parametrize("n", range(1, 11))
def test_empty_table(n, docs, labels, benchmark):
    assert operators(labels, benchmark)[n](docs.limit(0)).collect() == []


@pytest.mark.parametrize("stage", [lambda d, b: language_id.keep_identified(d, rounds=3), lambda d, b: simhash.one_of_each(d), lambda d, b: decontamination.clean(d, b), lambda d, b: secret_scan.redact(d)])
def test_stages_keep_the_columns(stage, docs, benchmark):
    got = stage(docs, benchmark)
    assert got.columns == docs.columns
    assert 0 < got.count() <= docs.count()
    assert stage(docs.limit(0), benchmark).count() == 0


def test_one_of_each_keeps_one(docs):
    got = simhash.one_of_each(docs).filter(F.col("text") == text(3)).collect()
    assert [r.doc_id for r in got] == [3]


def test_a_query_for_each_operator():
    assert {int(n[2:].split("_")[0]) for n in queries()} == set(range(1, 14))
