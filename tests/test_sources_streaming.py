import datetime
import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.operators import registry
from quire.sources import ocr, proof, sinks
from quire.streaming import events


def test_exports_and_byte_offsets(spark, tmp_path):
    pages = {"001.png": 'a "quoted"\nline é', "002.png": "tab\t\U0001f600 end", "003.png": ""}
    path = tmp_path / "project9.json"
    path.write_text(json.dumps(pages), encoding="utf-8")
    raw = path.read_bytes()
    got = proof.read_exports(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(x.project, x.page, x.text) for x in got] == [("project9", k, v) for k, v in pages.items()]
    index = proof.read_index(spark, str(tmp_path))
    assert [x.page for x in index.orderBy("byte_start").collect()] == list(pages)
    found = {x.page: x for x in proof.read_pages(spark, str(tmp_path), index.where("page <> '003.png'")).collect()}
    assert set(found) == {"001.png", "002.png"}
    for page, row in found.items():
        assert row.text == pages[page]
        for s in row.slices:
            assert json.loads(b'"' + raw[s.start : s.end] + b'"') == s.char
    assert len(raw[found["002.png"].slices[4].start : found["002.png"].slices[4].end]) == 12


def box(left, top, right, bottom):
    p = lambda x, y: {"x": x, "y": y, "is_normalized": False}
    return {"top_left": p(left, top), "bottom_right": p(right, bottom), "is_normalized": False}


def test_documents_are_flattened(spark, tmp_path):
    word = lambda t, x: {"type": "Word", "text": t, "bounding_box": box(x, 0.0, x + 5, 9.0), "ocr_confidence": 0.5, "word_labels": [], "text_style_labels": ["bold"]}
    block = lambda kind, items: {"type": "Block", "block_category": kind, "items": items}
    page = {"type": "Page", "width": 100, "height": 50, "page_index": 3, "items": [block("BLOCK", [block("PARAGRAPH", [block("LINE", [word("a", 0.0), word("b", 9.0)]), block("LINE", [word("c", 0.0)])])])]}
    (tmp_path / "d.json").write_text(json.dumps({"source_identifier": "doc", "pages": [page]}, indent=1))
    got = ocr.words_of_documents(ocr.read_documents(spark, str(tmp_path))).orderBy("line_no", "word_no").collect()
    assert [(x.page_index, x.line_no, x.word_no, x.word, x.l, x.r) for x in got] == [(3, 0, 0, "a", 0, 5), (3, 0, 1, "b", 9, 14), (3, 1, 0, "c", 0, 5)]


def test_layouts_and_flat_table(spark, tmp_path):
    (tmp_path / "x.layout.json").write_text(json.dumps({"regions": [{"type": "text", "L": 1, "R": 5, "T": 2, "B": 9, "confidence": 0.5, "raw_label": "t"}], "image_width": 10, "image_height": 20, "detector": "d", "inference_ms": 7}))
    row = ocr.read_layouts(spark, str(tmp_path)).first()
    assert (row.pos, row.type, row.l, row.t, row.r, row.b, row.image_width) == (0, "text", 1, 2, 5, 9, 10)
    rows = [(5, "1", "2", "3", "4", "90", "w"), (5, "1", "2", "x", "4", "-1", None), (4, "0", "0", "9", "9", "50", "line"), (5, "1", "2", "3", "4", "NaN", "NaN")]
    flat = spark.createDataFrame(rows, "level int, left string, top string, width string, height string, conf string, text string")
    assert [tuple(x) for x in ocr.flat_words(flat).collect()] == [("w", 1, 2, 4, 6, 0.9), ("", 1, 2, None, 6, None), ("", 1, 2, 4, 6, None)]


def test_images_by_suffix_or_magic(spark, tmp_path):
    png = bytes.fromhex("89504E470D0A1A0A") + bytes(20)
    for name, content in (("a.png", png), ("b.jpg", png), ("c.txt", bytes(30)), ("d.bin", png), ("e.png", b"x"), ("f.png", bytes(30))):
        (tmp_path / name).write_bytes(content)
    got = {os.path.basename(x.path): (x.format, x.mismatch) for x in ocr.read_images(spark, str(tmp_path)).collect()}
    assert got == {"a.png": ("png", False), "b.jpg": ("png", True), "d.bin": ("png", True), "f.png": (None, False)}


def test_sinks(spark, tmp_path):
    words = spark.createDataFrame([(1, 0, 1, "b", 5.0, 0.0, 9.0, 9.0, None, "B"), (1, 0, 0, "a", 0.0, 0.0, 4.0, 9.0, 0.5, None)], "page int, line_no int, word_no int, word string, l double, t double, r double, b double, conf double, truth string")
    sinks.write_pages(sinks.nested_pages(words, ["page"], ["line_no"]), f"{tmp_path}/out")
    back = spark.read.json(f"{tmp_path}/out").first()
    assert [w.word for w in back.lines[0].words] == ["a", "b"]
    assert sinks.detection_labels(words, "page").first().polygons[0] == [[0, 0], [4, 0], [4, 9], [0, 9]]
    assert [tuple(x) for x in sinks.recognition_labels(words, "page").collect()] == [(1, "1_0_1", [5, 0, 9, 9], "B")]
    assert sinks.schema_manifest({"w": words}) == sinks.schema_manifest({"w": words.limit(0)})


def test_registry(spark):
    registry.register("layout", "whole", lambda: lambda b: pd.DataFrame({"page_id": b["page_id"], "n": [len(b)] * len(b)}))
    with pytest.raises(ValueError, match="registered already"):
        registry.register("layout", "whole", lambda: None)
    got = registry.apply_model(spark.createDataFrame([(1,), (2,)], "page_id int"), "layout", "whole", "page_id int, n int")
    assert sorted(x.page_id for x in got.collect()) == [1, 2] and got.columns[-1] == "inference_ms"
    registry.unregister("layout", "whole")
    assert registry.available("layout") == ["none"]
    with pytest.raises(KeyError, match="there are: none"):
        registry.get("layout", "whole")


@pytest.fixture
def stream(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    rows = [(i, base + datetime.timedelta(minutes=m), u, float(i)) for i, (u, m) in enumerate([(1, 0), (1, 10), (1, 90), (2, 5), (2, 5), (1, 95), (2, 300)])]
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, value double")
    df.repartition(2).write.parquet(f"{tmp_path}/in")
    return df, events.read_events(spark, f"{tmp_path}/in", "event_id bigint, ts timestamp, user_id bigint, value double")


def run(spark, df, mode):
    name = f"t{abs(hash(str(df.schema) + mode))}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_streams_equal_batches(spark, stream, tmp_path):
    batch, live = stream
    want = {(x.user_id, x.n) for x in events.batch_sessions(batch, "ts", "user_id", 1800).collect()}
    assert want == {(1, 2), (2, 2), (2, 1)}
    got = run(spark, events.sessions(live, "ts", "user_id"), "complete")
    assert sorted((x.user_id, x.n) for x in got) == [(1, 2), (1, 2), (2, 1), (2, 2)]
    windows = {(x.window.start.hour, x.n) for x in run(spark, events.counts_by_window(live, "ts", []), "complete")}
    assert windows == {(0, 4), (1, 2), (5, 1)}
    total = {x.user_id: (x.n, x.total) for x in run(spark, events.running_totals(live, "user_id", "value"), "update")}
    assert {u: t[0] for u, t in total.items()} == {1: 4, 2: 3}
    q = events.write_once(events.dedupe(live, "ts", ["user_id", "ts"]), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 6
    assert batch.select(events.json_number(F.lit('{"k": 3}'), "$.k")).first()[0] == 3
