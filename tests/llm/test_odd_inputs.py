"""Nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables: a defined result for each operator and stage."""

import public_tokenizers
import pytest

import corpus_pipeline
from siltstone.llm import decontaminate, exact_dedup, licenses, packing, pii, quality, simhash_vptree, suffix_dedup, token_counts, toxicity

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
IDS = sorted([1, 2, 3, 4, 5, 6, 6, 7, 9, -1, -1])


def ids(df):
    return sorted(-1 if r[0] is None else r[0] for r in df.select("doc_id").collect())


def bench(spark):
    return spark.createDataFrame([(1, "alpha beta gamma delta alpha beta gamma delta alpha beta gamma"), (1, "tie"), (2, None), (None, "x"), (3, "")], "item_id long, text string")


def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (5, 0, 1), (5, 1, 1), (None, 1, 1), (7, None, None), (2, 0, 0), (6, 1, 1)], "doc_id long, quality int, toxic int")


def run_all(spark, docs):
    q = quality.measure(docs)
    return {
        "pii": pii.find_personal_data(docs),
        "decontaminate": decontaminate.contamination(docs, bench(spark)),
        "exact": exact_dedup.exact_duplicates(docs),
        "quality": quality.score_measured(q, quality.fit_quality(q, labels(spark))),
        "tokens": token_counts.token_counts(docs, PIECES),
        "licenses": licenses.license_scan(docs),
        "simhash": simhash_vptree.near_duplicates(docs),
        "toxicity": toxicity.score(docs, toxicity.fit_toxicity(docs, labels(spark))),
    }


def test_each_row_gets_a_row(spark, odd):
    for name, df in run_all(spark, odd).items():
        assert ids(df) == IDS, name


def test_empty_tables(spark, empty):
    for name, df in run_all(spark, empty).items():
        assert df.count() == 0, name
    assert suffix_dedup.remove_repeats(empty).count() == 0 and packing.pack(empty, WORDS).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(spark.createDataFrame([(1, "a")], "doc_id long, text string"), none).first().n_hit == 0


def test_defined_results(spark, odd):
    exact = exact_dedup.exact_duplicates(odd, keep="max").collect()
    by = {(r.keep_id, r.group_size) for r in exact}
    assert {(2, 3), (4, 2), (6, 3), (7, 1), (None, 1), (9, 1)} == by and sum(r.kept for r in exact) == 6
    near = {(-1 if r.doc_id is None else r.doc_id): r for r in simhash_vptree.near_duplicates(odd).collect()}
    assert near[1].fp == near[2].fp == near[9].fp == 0 and near[9].component_id == 1 and near[4].component_id == 3 and near[6].component_id == 5
    hit = {r.doc_id: r for r in decontaminate.contamination(odd, bench(spark)).collect() if r.doc_id}
    # No window ends with the fourth word, which is also the last one of the long text.
    assert (hit[3].n_hit, hit[3].n_words) == (11999, 12000) and hit[5].items == ["1"] and hit[2].n_words == 0 and not hit[7].contaminated


def test_ids_name_texts_where_places_count(spark, odd):
    cut = suffix_dedup.remove_repeats(odd).collect()
    assert ids(spark.createDataFrame(cut)) == sorted(set(IDS))
    by = {r.doc_id: r for r in cut}
    assert by[4].n_removed == by[4].n_bytes and by[3].n_removed > 0 and by[1].n_bytes == 0 and by[None].kept == b"no id"
    pieces = packing.pack(odd, WORDS).collect()
    assert {r.doc_id for r in pieces} == {1, 2, 3, 4, 5, 6, 7, 9, None}
    assert sum(r.length for r in pieces if r.doc_id == 1) == 1


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages(spark, odd, empty, tmp_path, stage):
    f = dict(corpus_pipeline.STAGES)[stage]
    bench(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    out = f(spark, odd, str(tmp_path))
    if stage != "packing":
        assert out.columns == odd.columns
    out.collect()
    if stage == "exact_dedup":
        assert ids(out) == [-1, 2, 4, 6, 7, 9]
    if stage == "near_dedup":
        assert ids(out)[:1] == [-1] and {1, 3, 5, 7} <= set(ids(out)) and not {2, 4, 6, 9} & set(ids(out))
    if stage == "decontaminate":
        assert ids(out) == [-1, -1, 1, 2, 7, 9]
    assert f(spark, empty, str(tmp_path)).count() == 0
