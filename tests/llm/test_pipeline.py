import random

import corpus_pipeline
from tests.llm.test_decontaminate import words
from tests.llm.test_langid import text


def fixture(r):
    """Rows of documents, and the ids that each stage must reject."""
    langs = ["aa", "bb", "cc"]
    rows = [(i, "\n".join(text(r, langs[i % 3], r.randint(20, 60)) for _ in range(r.randint(3, 6))), langs[i % 3]) for i in range(150)]
    base = dict((i, t) for i, t, _ in rows)
    passage = text(r, "aa", 60)
    gone = {"und": {500, 501, 502}, "copies": {510}, "near": set(), "leaks": {530, 531}}
    rows += [(500, "12 34 .", "aa"), (501, "", None), (502, None, "bb"), (510, base[0], "aa")]
    rows += [(520 + k, text(r, "aa", 80) + "\n" + passage + "\n" + text(r, "aa", 30), "aa") for k in range(5)]
    items = [(k, " ".join(words(r, 30))) for k in range(5)]
    rows += [(530 + k, text(r, "aa", 100) + " " + items[k][1] + " " + text(r, "aa", 100), "aa") for k in range(2)]
    long_line = text(r, "bb", 200).split(" ")
    for k in range(6):
        w = list(long_line)
        w[30 * k] = "changed"
        rows.append((540 + k, " ".join(w), "bb"))
    gone["near"] = set(range(541, 546))
    return rows, items, passage, gone


def test_stages(spark, tmp_path):
    r = random.Random(12)
    rows, items, passage, gone = fixture(r)
    docs = spark.createDataFrame([(i, t, l, f"s{i % 4}", len(t or "")) for i, t, l in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")  # noqa: E741
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, ids = spark.read.parquet(f"{tmp_path}/documents.parquet"), [{i for i, *_ in rows}]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        assert now.columns == docs.columns
        ids.append({x.doc_id for x in now.collect()})
    assert [a - b for a, b in zip(ids, ids[1:], strict=False)] == [gone["und"], gone["copies"], gone["near"], gone["leaks"]]
    left = {x.doc_id: x for x in now.collect()}
    assert [i for i, x in left.items() if passage in x.text] == [520]
    assert all(len(x.text) == x.n_chars for x in left.values())
    assert all(left[i].text == t for i, t, _ in rows[:150])
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in packed} == left.keys()


def test_no_rows(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_null_ids_repeated_rows_and_clashing_names(spark, tmp_path):
    r = random.Random(13)
    rows, items, *_ = fixture(r)
    short = text(r, "bb", 30)
    rows = [x for x in rows if x[0] < 150] + [(None, text(r, "aa", 80), "aa")] + [(600, short, "bb")] * 2
    docs = spark.createDataFrame([(i, t, l, f"s{(i or 0) % 4}", len(t), "component", 7, "start") for i, t, l in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, component string, position int, start string")  # noqa: E741
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        assert now.columns == docs.columns
    left = now.collect()
    assert len(left) == len(rows) and {(x.component, x.position, x.start) for x in left} == {("component", 7, "start")}
    assert [x.text for x in left if x.doc_id == 600] == [short] * 2 and len([x for x in left if x.doc_id is None]) == 1
