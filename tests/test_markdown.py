import os

import pytest
from pyspark.sql import functions as F

from tickloom.sources.markdown import MarkdownTree, markdown_files


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    spark.dataSource.register(MarkdownTree)


def docs(spark, rows):
    return spark.createDataFrame(rows, "path string, text string")


def test_a_tree_comes_back_as_written(spark, tmp_path):
    rows = [("a/1.md", "# One\r\n\u00e9"), ("b/c/2.md", ""), ("3.md", None), ("a/_meta.md", "note")] + [(f"d/{i:03}.md", f"text {i}") for i in range(40)]
    docs(spark, rows).repartition(5).write.format("markdown").mode("append").save(str(tmp_path))
    back = spark.read.format("markdown").option("filesPerTask", 7).load(str(tmp_path))
    want = sorted((p, t or "") for p, t in rows if not p.endswith("_meta.md"))
    assert [tuple(r) for r in back.collect()] == want  # in path order
    assert back.rdd.getNumPartitions() == 7 and os.path.exists(tmp_path / "a" / "_meta.md")
    docs(spark, [("a/1.md", "new")]).write.format("markdown").mode("append").save(str(tmp_path))
    assert spark.read.format("markdown").load(str(tmp_path)).where("path = 'a/1.md'").first().text == "new"
    docs(spark, [("z.md", "only")]).write.format("markdown").mode("overwrite").save(str(tmp_path))
    assert markdown_files(str(tmp_path)) == ["z.md"]


def test_a_failed_write_leaves_no_document(spark, tmp_path):
    for bad in ("../x.md", "x.txt", "/x.md", "a/.x.md"):
        with pytest.raises(Exception, match="not a relative Markdown path"):
            docs(spark, [("good.md", "g"), (bad, "b")]).coalesce(1).write.format("markdown").mode("append").save(str(tmp_path))
    assert markdown_files(str(tmp_path)) == [] and spark.read.format("markdown").load(str(tmp_path)).count() == 0


def test_a_stream_follows_the_tree_over_a_restart(spark, tmp_path):
    tree, out, seen = str(tmp_path / "tree"), str(tmp_path / "out"), []
    os.makedirs(tree)
    for k in range(3):
        docs(spark, [(f"{9 - k}/{i}.md", f"{k} {i}") for i in range(4)]).write.format("markdown").mode("append").save(tree)
        q = spark.readStream.format("markdown").load(tree).withColumn("size", F.length("text")).writeStream.format("parquet").option(
            "checkpointLocation", str(tmp_path / "cp")).option("path", out).trigger(availableNow=True).start()
        q.awaitTermination()
        seen.append(spark.read.parquet(out).count())
    assert seen == [4, 8, 12] and spark.read.parquet(out).select("path").distinct().count() == 12
