"""Examples and datasets: no file with strings is left out."""

from pyspark.sql import functions as F

from sieveline.operators import golang, inject
from sieveline.plans import queries as Q

SRC, PATH = "src0", "doc_35077734.go"  # the first six values drawn for its first site fit no string
TEXT = 'a "token" b'
FILES = "repo string, path string, text string"


def test_every_file_with_strings_gives_an_example(spark):
    ex = inject.inject(SRC, PATH, TEXT, "20260925:0", "train")
    assert ex and inject.faults(ex) == [] and len(ex["spans"] + ex["distractors"]) == 1
    assert inject.inject("r", "p", "package x", 1, "train") is None


def test_files_are_counted_as_in_the_sql(spark, tmp_path):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(2)
    odd = d.limit(1).withColumn("text", F.lit(TEXT))
    rows = d.unionByName(odd.withColumn("doc_id", F.lit(35077734).cast(d.schema["doc_id"].dataType)).withColumn("source", F.lit(SRC)))
    rows = rows.unionByName(odd.withColumn("doc_id", F.lit(7).cast(d.schema["doc_id"].dataType))).unionByName(odd.withColumn("doc_id", F.lit(7).cast(d.schema["doc_id"].dataType))).unionByName(odd.withColumn("source", F.lit(None).cast("string")))
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert tuple(Q.injection_verify(spark, str(tmp_path)).select("broken", "examples").first()) == con.execute(Q.ORACLE["injection_verify"]).fetchone()


def test_places_are_those_of_the_whole_lexer():
    for text in ('"open', "`open", "/* open", "'", '"a\\', "", "a'b\"c'd\"e'", 'x := `a "b" // c` // "d"', "'\"' \"'\"", '"a\\\n"b"', "é😀\"z\" /* \" */", "type T struct {\n N int `x:\"y\"`\n}", '"struct" { `x` }', "1.2\"a\" ''\"b\"", "/ / \"\" `` //"):
        assert inject.places(text) == [(s["start"], s["end"], s["kind"]) for s in golang.find_sites(text) if s["kind"] in inject.INJECTABLE]


def test_parts_are_those_of_the_split_and_injected_once(spark):
    files = spark.createDataFrame([("r", f"f{i}.go", TEXT) for i in range(40)] + [("s", f"n{i}.go", "package x") for i in range(25)], FILES)
    for fraction in (0.1, 0.5, 1.0):
        last = inject.last_train(files, 7, fraction)
        train = {(r.repo, r.path) for r in inject.split_files(files, 7, fraction).where("split = 'train'").collect()}
        hashed = files.select(inject._file_hash(7).alias("h"), "repo", "path").collect()
        assert {(r.repo, r.path) for r in hashed if last and tuple(r) <= last} == train
    data = inject.build(files, target=30)
    assert "MapInArrow" not in data._jdf.queryExecution().optimizedPlan().toString() and data.count() == 33


def test_lowest_rows_without_sorting_all(spark):
    rows = spark.range(3000).select("id", F.md5(F.col("id").cast("string")).alias("order")).persist()
    for n in (1, 700, 2999, 3000):
        assert sorted(r.id for r in inject._lowest(rows, n).collect()) == sorted(r.id for r in rows.orderBy("order").limit(n).collect())
