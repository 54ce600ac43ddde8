import glob

import corpus_pipeline
from test_minhash import brute as near_duplicates
from test_packing import check as packed
from test_winnow import brute as windows_hit
from tidewright.llm import minhash, quality, toxicity
from tidewright.llm.queries import ORACLE, QUERIES


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "toxicity", "near duplicates", "benchmark decontamination", "packing"]
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14)) and set(ORACLE) <= set(QUERIES)


def test_one_row_of_each_group_stays(spark, odd_docs):
    kept = corpus_pipeline.near_duplicate_stage(spark, odd_docs, "")
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 4, 5, 6, 7, 8] and ids.count(None) == 1
    groups = minhash.near_duplicates(odd_docs).where("group_key is not null").select("group_key").distinct().count()
    assert kept.where("doc_id not in (3, 4, 5) or doc_id is null").count() == groups


def test_decontaminated_rows_keep_their_columns(spark, odd_docs, tmp_path):
    spark.createDataFrame([(1, "the same words are here twice in a row the same")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = corpus_pipeline.decontamination_stage(spark, odd_docs, str(tmp_path))
    assert kept.columns == odd_docs.columns and kept.where("doc_id in (1, 2)").count() == 0 and kept.count() == odd_docs.count() - 3


def test_the_whole_run_against_brute_force(spark):
    """What each stage kept of its predecessor's rows: classifiers as they score, the others as plain loops find."""
    folder = "/root/testdata/sf0.001"
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(glob.glob(f"{shared}/corpus-*"))
    result = [r.asDict() for r in corpus_pipeline.run(spark, folder).collect()]
    (made,) = set(glob.glob(f"{shared}/corpus-*")) - before
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    frames = [docs, *(spark.read.parquet(f"{made}/{i}") for i in range(4))]
    assert all(f.columns == docs.columns for f in frames)
    rows = [{r["doc_id"]: tuple(r) for r in f.collect()} for f in frames]
    text = lambda stage: {i: r[1] for i, r in rows[stage].items()}
    assert all(rows[i + 1].items() <= rows[i].items() for i in range(4))  # whole rows, unchanged

    poor = {r["doc_id"] for r in quality.classify(docs, labels).where("predicted = 0").collect()}
    assert poor and set(rows[1]) == set(rows[0]) - poor
    toxic = {r["doc_id"] for r in toxicity.classify(frames[1], labels).where("rejected").collect()}
    assert set(rows[2]) == set(rows[1]) - toxic
    groups = {i: root for i, (root, n) in near_duplicates(list(text(2).items())).items()}
    assert set(rows[3]) == set(groups.values()) and len(rows[3]) < len(rows[2])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    leaked = {i for i, found in windows_hit(list(text(3).items()), items).items() if found[4]}
    assert leaked and set(rows[4]) == set(rows[3]) - leaked
    packed(result, text(4))


def test_odd_and_empty_tables_in_every_stage(spark, odd_docs, no_docs, tmp_path):
    spark.createDataFrame([(1, "the same words are here twice in a row the same"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None), (6, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, odd_docs, str(tmp_path))
        assert kept.count() > 0 and stage(spark, no_docs, str(tmp_path)).count() == 0, name
        if name != "packing":
            assert kept.columns == odd_docs.columns
