"""Sources and sinks: tolerant JSONL scan, chunked request files and run selection,
XLSX round trip, chat JSONL, versioned rewrite."""

import os

from pyspark.sql import functions as F

from wordrate.operators import chat as CH
from wordrate.operators import requests as Q
from wordrate.sinks import files as K
from wordrate.sources import files as S
from wordrate.sources import schemas as SC
from wordrate.sources import xlsx


def test_tolerant_jsonl_sets_bad_lines_aside(spark, tmp_path):
    p = tmp_path / "err.jsonl"
    p.write_text('{"custom_id": "a_task_1"}\n\nnot json {\n{"custom_id": "a_task_2"}\n', encoding="utf-8")
    good, bad = S.read_jsonl_tolerant(spark, str(p), SC.OPENAI_RESULT)
    assert sorted(r["custom_id"] for r in good.collect()) == ["a_task_1", "a_task_2"]
    assert [r["line"] for r in bad.collect()] == ["not json {"]


def test_chunked_batches_and_exact_run(spark):
    words = spark.createDataFrame([(i, f"w{i}") for i in range(1, 26)], "k long, word string")
    numbered = Q.number_words(words, ["k"], column="word", num_partitions=3)
    exps = [Q.Experiment("original", "exp", 'Rate "{Word}"'), Q.Experiment("original_2", "exp", 'Rate "{Word}"')]
    out = K.scratch_dir(spark, "test-batches")
    K.write_request_batches(Q.build_requests(numbered, exps), out, chunk_size=10)
    back = S.read_batches_of_run(spark, out, "original")
    assert back.count() == 25
    per_batch = {r["b"]: r["n"] for r in back.groupBy(
        S.batch_of_file(F.col("line_no.file")).cast("string").alias("b")).count()
        .withColumnRenamed("count", "n").collect()}
    assert per_batch == {"0": 10, "1": 10, "2": 5}
    first = back.where(F.col("custom_id") == "exp_task_1").first()
    assert first["body"]["messages"][0]["content"] == 'Rate "w1"'


def test_xlsx_roundtrip_all_sheets(spark, tmp_path):
    xlsx.register(spark)
    xlsx.write_workbook(str(tmp_path / "a.xlsx"), "norms", ["Word", "FAM"], [("cat", 4.5), ("dog", None), ("é", 1)])
    df = spark.read.format("xlsx").option("sheet", "*").load(str(tmp_path))
    rows = sorted((r["Word"], r["FAM"], r["sheet"]) for r in df.collect())
    assert rows == [("cat", "4.5", "norms"), ("dog", None, "norms"), ("é", "1", "norms")]
    typed = spark.read.format("xlsx").schema("Word string, FAM double").load(str(tmp_path / "a.xlsx"))
    assert sorted(r["FAM"] for r in typed.collect() if r["FAM"] is not None) == [1.0, 4.5]


def test_chat_jsonl_and_versioned_rewrite(spark, tmp_path):
    df = spark.createDataFrame([("abdomen", 4.456)], "word string, rating double")
    rec = CH.chat_records(df, 'How familiar is "{word}"?', "rating")
    out = str(tmp_path / "chat")
    K.write_jsonl(rec.select("messages"), out)
    back = S.read_chat_records(spark, out).first()
    assert back["messages"][1]["content"] == "4.46"
    assert CH.output_stem("norms_llama3.1-8B.xlsx") == "norms_llama3.1-8B.jsonl"
    base = str(tmp_path / "versions")
    K.write_versioned(df, base)
    K.write_versioned(df.withColumn("rating", F.lit(1.0)), base)
    assert spark.read.parquet(base + "/_old").first()["rating"] == 4.456
    assert spark.read.parquet(base + "/current").first()["rating"] == 1.0
    assert os.path.isdir(base + "/current")


def test_word_table_csv_latin1_and_prompt_file(spark, tmp_path):
    p = tmp_path / "words.csv"
    p.write_bytes("Word,FAM\ncaf\xe9,4.1\nna\xefve,3.0\n".encode("latin-1"))
    words = [r["Word"] for r in S.read_word_table(spark, str(p), "Word").collect()]
    assert sorted(words) == ["café", "naïve"]
    t = tmp_path / "prompt.txt"
    t.write_text('Rate "{Word}"\nfrom 1 to 7.', encoding="utf-8")
    assert S.read_prompt(spark, str(t)).first()["prompt"] == 'Rate "{Word}"\nfrom 1 to 7.'
    try:
        S.read_word_table(spark, str(tmp_path / "words.txt"), "Word")
        raise AssertionError("expected ValueError")
    except ValueError:
        pass


def test_split_folders_named_by_pct_and_seed(spark, tmp_path):
    from wordrate.operators import sampling as SP
    df = spark.range(40).withColumnRenamed("id", "k")
    out = str(tmp_path / "splits")
    K.write_splits(SP.split_exact(df, "k", 0.5, 42), out, 0.5, 42)
    names = sorted(d for d in os.listdir(out) if d.startswith("split_name="))
    assert names == ["split_name=test_split_50.0_randomstate_42", "split_name=train_split_50.0_randomstate_42"]


def test_unknown_company_is_an_error(spark):
    words = spark.createDataFrame([(1, "cat")], "task_no long, word string")
    try:
        Q.build_requests(words, Q.Experiment("r", "exp", '"{Word}"', company="Acme"))
        raise AssertionError("expected ValueError")
    except ValueError:
        pass


def test_default_role_added_only_where_missing(spark):
    df = spark.createDataFrame([([("model", [("a",)]), (None, [("b",)])],)],
                               "contents array<struct<role:string,parts:array<struct<text:string>>>>")
    recs = df.select(F.struct("contents").alias("request"))
    roles = [c["role"] for c in Q.add_default_role(recs).first()["request"]["contents"]]
    assert roles == ["model", "user"]


def test_rewrite_first_sheet_keeps_other_sheets(spark, tmp_path):
    xlsx.register(spark)
    src = tmp_path / "in"
    src.mkdir()
    xlsx.write_workbook_sheets(str(src / "norms.xlsx"), [("Sheet1", ["Word", "FAM"], [("cat", "4.5"), ("dog", "3.0")]),
                                                         ("notes", ["Word", "FAM"], [("n1", "x")])])
    book = spark.read.format("xlsx").option("sheet", "*").load(str(src))
    assert xlsx.sheet_names(str(src / "norms.xlsx")) == ["Sheet1", "notes"]
    merged = book.where(F.col("sheet") == "Sheet1").withColumn("FAM", F.concat("FAM", F.lit("!"))).drop("sheet")
    base = str(tmp_path / "out")
    K.rewrite_first_sheet(book, merged, "Sheet1", base)
    K.rewrite_first_sheet(book, merged, "Sheet1", base)
    back = spark.read.format("xlsx").option("sheet", "*").load(base + "/current")
    rows = sorted((r["sheet"], r["Word"], r["FAM"]) for r in back.collect())
    assert rows == [("Sheet1", "cat", "4.5!"), ("Sheet1", "dog", "3.0!"), ("notes", "n1", "x")]
    assert spark.read.format("xlsx").option("sheet", "*").load(base + "/_old").count() == 3


def test_utf8_csv_and_local_request_ft_dir(spark, tmp_path):
    p = tmp_path / "w.csv"
    p.write_text("word\nnaïve\n", encoding="utf-8")
    assert S.read_csv_utf8(spark, str(p)).first()["word"] == "naïve"
    words = spark.createDataFrame([(1, "cat")], "task_no long, word string")
    plain = Q.build_requests(words, Q.Experiment("r", "exp", '"{Word}"', company="Local", model_name="m"))
    tuned = Q.build_requests(words, Q.Experiment("r", "exp", '"{Word}"', company="HuggingFace", model_name="m",
                                                 ft_dir="/models/ft1"))
    assert "ft_dir" not in plain.first()["json"]
    assert '"ft_dir":"/models/ft1"' in tuned.first()["json"]
    assert '"prompt":"\\"cat\\""' in tuned.first()["json"]


def test_csv_quotes_are_doubled(spark, tmp_path):
    from wordrate.sources import files as S
    (tmp_path / "w.csv").write_text('Word,Note\n"say ""hi"", you",1\n"a,b","x ""y"""\n', encoding="utf-8")
    want = [('say "hi", you', "1"), ("a,b", 'x "y"')]
    for df in (S.read_word_table(spark, str(tmp_path / "w.csv")), S.read_csv_utf8(spark, str(tmp_path / "w.csv"))):
        assert [tuple(r) for r in df.collect()] == want


def test_xlsx_overwrite_and_failed_write(spark, tmp_path):
    import os

    import pytest
    from pyspark.sql import functions as F

    from wordrate.sources import xlsx
    xlsx.register(spark)
    out = str(tmp_path / "book")
    df = spark.range(5).select(F.col("id").cast("int").alias("n"), F.lit("a").alias("t"))
    read = lambda: spark.read.format("xlsx").schema("n int, t string").load(out).count()
    for _ in range(2):
        df.write.format("xlsx").mode("overwrite").save(out)
        assert read() == 5
    df.write.format("xlsx").mode("append").save(out)
    assert read() == 10
    bad = df.withColumn("n", F.when(F.col("n") == 4, F.raise_error(F.lit("stop")).cast("int")).otherwise(F.col("n")))
    with pytest.raises(Exception):
        bad.write.format("xlsx").mode("append").save(out)
    assert read() == 10 and not [f for f in os.listdir(out) if f.startswith(".job")]


def test_model_factories_of_one_name_stay_apart(spark):
    from wordrate.operators import model_scoring as M

    def maker(x):
        def factory():
            return lambda prompts: [x] * len(prompts)
        return factory
    df = spark.createDataFrame([("a",)], "p string").coalesce(1)
    assert [M.score_prompts(df, "p", maker(v)).first()["score"] for v in (1.0, 2.0)] == [1.0, 2.0]


def test_newest_file_counts_its_whole_run(spark, tmp_path):
    """The run of the newest file lies in several files, and all of them are counted."""
    from wordrate.plans.files_q import newest_file
    parts = spark.createDataFrame([(i, f"part {i}") for i in range(1, 1302)], "p_partkey long, p_name string")
    parts.write.parquet(str(tmp_path / "part.parquet"))
    rows = [tuple(r) for r in newest_file(spark, str(tmp_path)).collect()]
    assert rows == [("later", 1301, sum(len(f"part {i}") for i in range(1, 1302)))]
