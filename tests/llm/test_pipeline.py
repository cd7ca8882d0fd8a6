import corpus_pipeline as pipeline

from .test_operators import DOCS, rows


def test_stages(spark, tmp_path):
    folder = str(tmp_path / "sf")
    spark.createDataFrame(rows(), DOCS).write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept.append((name, docs.count()))
        if name != "packing":
            assert docs.columns == list(pipeline.COLUMNS)
    names = [n for n, _ in kept]
    assert names == ["language_id", "simhash", "pii", "mixing", "packing"]
    ids = {r["doc_id"] for r in spark.read.parquet(f"{folder}/language_id").collect()}
    assert ids >= set(range(60)) and not ids & {60, 61, 62}  # a null, an empty and a blank text have no letters
    assert kept[1][1] < kept[0][1] and kept[2][1] == kept[1][1] and kept[4][1] > 0
    # the whole chain gives the packed pieces of the staged one
    assert pipeline.run(spark, folder).groupBy().sum("length").first()[0] == docs.groupBy().sum("length").first()[0]


def test_empty(spark, tmp_path):
    folder = str(tmp_path / "sf")
    spark.createDataFrame([], DOCS).write.parquet(f"{folder}/documents.parquet")
    assert pipeline.run(spark, folder).count() == 0
