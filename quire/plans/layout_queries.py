"""Queries on word boxes, lines and layout regions."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions.geometry import Box, distance, interval_gap, union_boxes
from quire.operators import images, layout, reading
from quire.operators import lines as fragments

from .base import BOXES_SQL, LINE_BOXES_SQL, REGIONS_SQL, line_boxes, query, regions, table, word_boxes

LINE_KEYS = ["line_no", "row"]


@query(f"WITH {BOXES_SQL} SELECT doc_id, line_no, row, word_no, word, l, t, r, b, conf FROM boxes")
def word_boxes_of_pages(spark, d):
    return word_boxes(spark, d)


@query(f"""WITH {BOXES_SQL} SELECT doc_id, line_no, row, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b, count(*) AS n_words, grouping(doc_id, line_no, row) AS depth
 FROM boxes GROUP BY ROLLUP (doc_id, line_no, row)""")
def boxes_rollup(spark, d):
    return word_boxes(spark, d).rollup("doc_id", "line_no", "row").agg(*union_boxes(), F.count("*").alias("n_words"), F.grouping_id().alias("depth"))


@query(f"""WITH {BOXES_SQL} SELECT doc_id, median(r - l) AS median_word_w, median(b - t) AS median_word_h, min(t) AS top, max(b) AS bottom, max(r) AS "right", count(*) AS n_words,
 CASE WHEN greatest(max(r), max(b)) <= 2 THEN 1.0 ELSE max(r) END AS coord_w, CASE WHEN greatest(max(r), max(b)) <= 2 THEN 1.0 ELSE max(b) END AS coord_h FROM boxes GROUP BY doc_id""")
def page_metrics(spark, d):
    return reading.page_metrics(word_boxes(spark, d), "doc_id")


@query(f"""WITH {BOXES_SQL}, p AS (SELECT *, lead(l) OVER w AS l2, lead(t) OVER w AS t2, lead(r) OVER w AS r2, lead(b) OVER w AS b2 FROM boxes WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY word_no)),
 q AS (SELECT *, greatest(0, least(r + 30, r2) - greatest(l - 30, l2)) * greatest(0, least(b + 5, b2) - greatest(t - 5, t2)) AS shared FROM p WHERE l2 IS NOT NULL)
 SELECT doc_id, line_no, word_no, round(CASE WHEN shared > 0 THEN shared / ((r - l + 60) * (b - t + 10) + (r2 - l2) * (b2 - t2) - shared) ELSE 0 END, 6) AS iou,
 l - 30 <= r2 AND l2 <= r + 30 AND t - 5 <= b2 AND t2 <= b + 5 AS touching, greatest(l2 - r - 30, l - 30 - r2, 0) AS gap, round(sqrt(pow(l2 - l, 2) + pow(t2 - t, 2)), 6) AS apart FROM q""")
def bbox_relations(spark, d):
    w = Window.partitionBy("doc_id", "line_no").orderBy("word_no")
    found = word_boxes(spark, d).select("*", *[F.lead(c).over(w).alias(f"n_{c}") for c in "ltrb"]).where("n_l is not null")
    a, b = Box.of().expand(30, 5), Box.of("n_")
    return found.select("doc_id", "line_no", "word_no", F.round(a.iou(b), 6).alias("iou"), a.intersects(b).alias("touching"), interval_gap(a.l, a.r, b.l, b.r).alias("gap"), F.round(distance(F.col("l"), F.col("t"), b.l, b.t), 6).alias("apart"))


@query(f"""WITH {BOXES_SQL}, x AS (SELECT doc_id, line_no, word_no, greatest(l - 10, 0) AS l, greatest(t - 10, 0) AS t, least(r + 10, 500) AS r, least(b + 10, 1000) AS b FROM boxes)
 SELECT doc_id, line_no, word_no, CASE WHEN l < r AND t < b THEN l END AS l, CASE WHEN l < r AND t < b THEN t END AS t, CASE WHEN l < r AND t < b THEN r END AS r, CASE WHEN l < r AND t < b THEN b END AS b FROM x""")
def bbox_expand_clamp(spark, d):
    return word_boxes(spark, d).select("doc_id", "line_no", "word_no", *Box.of().expand(10, 10).clamp(F.lit(500.0), F.lit(1000.0)).columns())


@query(f"""WITH {BOXES_SQL} SELECT doc_id, line_no, word_no, round_even(l / 720 * 1961, 0) AS l, round_even(t / 9999 * 2500, 0) AS t, round_even(r / 720 * 1961, 0) AS r, round_even(b / 9999 * 2500, 0) AS b FROM boxes""")
def bbox_unit_to_pixels(spark, d):
    unit = Box.of().normalize(F.lit(720), F.lit(9999))
    return word_boxes(spark, d).select("doc_id", "line_no", "word_no", *unit.scale(F.lit(1961), F.lit(2500)).columns())


@query(f"""WITH {BOXES_SQL}, {REGIONS_SQL} SELECT w.doc_id, w.line_no, w.word_no, count(*) AS n_regions, string_agg(DISTINCT g.type, ',' ORDER BY g.type) AS tags FROM boxes w JOIN regions g ON w.doc_id = g.doc_id AND g.confidence >= 0.5
 AND (w.l + w.r) / 2 BETWEEN g.l AND g.r AND (w.t + w.b) / 2 BETWEEN g.t AND g.b GROUP BY ALL""")
def words_in_regions(spark, d):
    found = layout.words_in_regions(word_boxes(spark, d), regions(spark, d), "doc_id")
    return found.groupBy("doc_id", "line_no", "word_no").agg(F.count("*").alias("n_regions"), F.array_join(F.sort_array(F.collect_set("region_type")), ",").alias("tags"))


@query(f"""WITH {BOXES_SQL}, {REGIONS_SQL} SELECT doc_id, count(*) AS n_left FROM boxes w WHERE NOT EXISTS (SELECT 1 FROM regions g WHERE g.doc_id = w.doc_id AND (g.type = 'figure' AND g.confidence >= 0.5 OR g.type = 'header' AND g.confidence >= 0.7)
 AND (w.l + w.r) / 2 BETWEEN g.l AND g.r AND (w.t + w.b) / 2 BETWEEN g.t AND g.b) GROUP BY doc_id""")
def words_outside_dropped_regions(spark, d):
    left = layout.drop_words(word_boxes(spark, d), regions(spark, d), "doc_id", ["doc_id", "line_no", "word_no"], ["figure", "header"], by_type={"figure": 0.5})
    return left.groupBy("doc_id").agg(F.count("*").alias("n_left"))


@query(f"""WITH {BOXES_SQL}, {REGIONS_SQL}, tags AS (SELECT DISTINCT w.doc_id, w.line_no, w.word_no, g.type FROM boxes w JOIN regions g ON w.doc_id = g.doc_id AND g.confidence >= 0.5 AND (w.l + w.r) / 2 BETWEEN g.l AND g.r AND (w.t + w.b) / 2 BETWEEN g.t AND g.b),
 counts AS (SELECT doc_id, line_no, type, count(*) AS hits FROM tags GROUP BY ALL), other AS (SELECT *, max(CASE WHEN type <> 'text' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, line_no) AS o FROM counts),
 pooled AS (SELECT *, sum(hits) OVER (PARTITION BY doc_id, line_no) AS pool, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY hits DESC, type) AS n FROM other WHERE o = 0 OR type <> 'text')
 SELECT doc_id, line_no, type AS role, hits, CAST(pool AS BIGINT) AS pool FROM pooled WHERE n = 1 AND hits >= 0.5 * pool""")
def dominant_region_role(spark, d):
    keys = ["doc_id", "line_no", "word_no"]
    return layout.dominant_role(layout.tag_words(word_boxes(spark, d), regions(spark, d), "doc_id", keys), ["doc_id", "line_no"])


@query(f"""WITH {REGIONS_SQL}, s AS (SELECT *, max(r) OVER (PARTITION BY doc_id ORDER BY l, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM regions WHERE type <> 'header' OR doc_id % 2 = 0),
 c AS (SELECT *, sum(CASE WHEN reach IS NULL OR l >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY l, pos) - 1 AS col FROM s)
 SELECT doc_id, pos, CAST(col AS BIGINT) AS "column", row_number() OVER (PARTITION BY doc_id ORDER BY col, t, l, pos) - 1 AS reading FROM c""")
def region_reading_order(spark, d):
    some = regions(spark, d).where((F.col("type") != "header") | (F.col("doc_id") % 2 == 0))
    return layout.reading_order(some, "doc_id").select("doc_id", "pos", "column", F.col("reading").cast("long").alias("reading"))


_CAPTIONS = f"""{REGIONS_SQL}, cand AS (SELECT f.doc_id, f.pos AS figure, c.pos AS caption, c.type, c.t - f.b AS gap FROM regions f JOIN regions c ON f.doc_id = c.doc_id AND f.type = 'figure' AND c.type IN ('caption', 'text')
 WHERE c.t - f.b BETWEEN 0 AND 80 AND greatest(0, least(f.r, c.r) - greatest(f.l, c.l)) / least(f.r - f.l, c.r - c.l) >= 0.3),
 best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, figure ORDER BY CASE WHEN type = 'caption' THEN 0 ELSE 1 END, gap, caption) AS n FROM cand)"""


@query(f"WITH {_CAPTIONS} SELECT doc_id, figure, caption, type, gap FROM best WHERE n = 1")
def caption_nearest(spark, d):
    return layout.nearest_caption(regions(spark, d), "doc_id")


@query(f"WITH {_CAPTIONS} SELECT doc_id, figure, caption, type, gap FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, caption ORDER BY gap, figure) AS m FROM best WHERE n = 1) WHERE m = 1")
def caption_claim_once(spark, d):
    return layout.claimed_captions(regions(spark, d), "doc_id")


# All words: the body is drawn together at the left, the last word of the first rows is set off at the right.
_NOTES = "SELECT *, CASE WHEN word_no % 12 = 11 AND word_no < 60 THEN l + 300 ELSE l / 32 END AS l1, CASE WHEN word_no % 12 = 11 AND word_no < 60 THEN r + 300 ELSE l / 32 + r - l END AS r1 FROM boxes"


@query(f"""WITH {BOXES_SQL}, m AS ({_NOTES}), e AS (SELECT doc_id, list_sort(list(r1)) AS rs, list_sort(list(l1)) AS ls, count(*) AS n FROM m GROUP BY doc_id HAVING count(*) >= 8),
 k AS (SELECT doc_id, rs[CAST(round_even(0.5 * (n - 1), 0) AS INT) + 1] AS re, ls[CAST(round_even(0.5 * (n - 1), 0) AS INT) + 1] AS le FROM e),
 s AS (SELECT m.doc_id, line_no, word_no, l1, r1, CASE WHEN (l1 + r1) / 2 > re + 40 THEN 'right' WHEN (l1 + r1) / 2 < le - 40 THEN 'left' END AS side FROM m JOIN k USING (doc_id)),
 g AS (SELECT *, count(*) OVER w AS n, max(r1) OVER w - min(l1) OVER w AS wide FROM s WINDOW w AS (PARTITION BY doc_id, side))
 SELECT doc_id, line_no, word_no, side FROM g WHERE side IS NOT NULL AND n >= 4 AND wide <= 220""")
def sidenote_geometric(spark, d):
    far = (F.col("word_no") % 12 == 11) & (F.col("word_no") < 60)
    left, right = F.col("l"), F.col("r")
    moved = word_boxes(spark, d).select("doc_id", "line_no", "word_no", F.when(far, left + 300).otherwise(left / 32).alias("l"), "t", F.when(far, right + 300).otherwise(left / 32 + right - left).alias("r"), "b")
    return layout.margin_words(moved, "doc_id", F.lit(1000.0)).select("doc_id", "line_no", "word_no", "side")


@query(f"""WITH {LINE_BOXES_SQL}, n AS (SELECT doc_id, line_no, row, CASE WHEN (l + r) / 2 < 360 THEN 'left' ELSE 'right' END AS side, t FROM line_boxes WHERE n_words <= 2)
 SELECT doc_id, line_no, row, CASE WHEN side = 'left' THEN -1000000 ELSE 2000000 END + row_number() OVER (PARTITION BY doc_id, side ORDER BY t, line_no, row) - 1 AS override FROM n""")
def sidenote_order(spark, d):
    role = F.when(F.col("n_words") <= 2, "sidenote").otherwise("body")
    notes = line_boxes(spark, d).withColumn("role", role).withColumn("t", F.struct("t", "line_no", "row"))
    return layout.side_note_order(notes, "doc_id", F.lit(720.0)).select("doc_id", "line_no", "row", F.col("override").cast("long").alias("override"))


@query(f"""WITH {BOXES_SQL}, g AS (SELECT doc_id, lead(l) OVER (PARTITION BY doc_id, line_no, row ORDER BY l) - r AS gap FROM boxes) SELECT doc_id, median(gap) AS gap FROM g WHERE gap BETWEEN 0 AND 57.6 GROUP BY doc_id""")
def typical_word_gap(spark, d):
    return layout.nearest_right_gap(word_boxes(spark, d), "doc_id", LINE_KEYS, F.lit(57.6))


@query(f"WITH {LINE_BOXES_SQL}, n AS (SELECT doc_id, line_no, row, b, lead(t) OVER (PARTITION BY doc_id ORDER BY t, l, line_no, row) AS nt FROM line_boxes) SELECT doc_id, line_no, row, CASE WHEN nt IS NOT NULL THEN greatest(nt - b, 0) END AS gap FROM n")
def line_vertical_gaps(spark, d):
    return reading.vertical_gaps(line_boxes(spark, d), "doc_id", LINE_KEYS).select("doc_id", *LINE_KEYS, "gap")


_ROW_BLOCKS = """sp AS (SELECT *, greatest(0, t - lag(b) OVER o) AS space, lag(l) OVER o AS pl, lag(r) OVER o AS pr FROM line_boxes WINDOW o AS (PARTITION BY doc_id ORDER BY t, line_no, row)),
 lim AS (SELECT *, 0.2 * avg(b - t) OVER w + greatest(coalesce(0.75 * stddev_pop(CASE WHEN pl IS NOT NULL THEN space END) OVER w, 0), 0.025 * median(b - t) OVER w) AS limit_ FROM sp WINDOW w AS (PARTITION BY doc_id)),
 blocks AS (SELECT *, CAST(sum(CASE WHEN pl IS NOT NULL AND space > limit_ AND least(r, pr) - greatest(l, pl) > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY t, line_no, row) AS BIGINT) AS block FROM lim)"""


@query(f"WITH {LINE_BOXES_SQL}, {_ROW_BLOCKS} SELECT doc_id, line_no, row, block FROM blocks")
def row_blocks_gaps(spark, d):
    return reading.row_blocks(line_boxes(spark, d), "doc_id", LINE_KEYS).select("doc_id", *LINE_KEYS, "block")


@query(f"""WITH {LINE_BOXES_SQL}, m AS (SELECT *, median(r - l) OVER w AS mw, median(b - t) OVER w AS mh, median(l) OVER w AS ml, median(r) OVER w AS mr FROM line_boxes WHERE trim(text) <> '' WINDOW w AS (PARTITION BY doc_id)),
 p AS (SELECT *, lag(l) OVER o AS pl, lag(r) OVER o AS pr, greatest(0, t - lag(b) OVER o) AS space, lag(text) OVER o AS ptext FROM m WINDOW o AS (PARTITION BY doc_id ORDER BY line_no, row)),
 n AS (SELECT *, CASE WHEN pl IS NULL THEN 0
  WHEN pr - pl <= 0.78 * mw AND r - l <= 0.78 * mw AND abs(l - pl) <= 0.04 * mw AND space <= 0.75 * mh THEN 0
  WHEN pr - pl <= 0.78 * mw AND pl > ml + 0.02 * mw AND abs(l - ml) <= 0.04 * mw AND r - l >= 0.85 * mw AND space <= 0.8 * mh THEN 0
  WHEN regexp_matches(text, '^\\p{{Ll}}') AND right(ptext, 1) NOT IN ('.', '!', '?', ';', ':') AND space <= 0.75 * mh AND NOT l >= ml + 0.02 * mw THEN 0
  WHEN pr <= mr - 0.15 * mw OR l >= ml + 0.02 * mw THEN 1 ELSE 0 END AS new_ FROM p)
 SELECT doc_id, line_no, row, CAST(sum(new_) OVER (PARTITION BY doc_id ORDER BY line_no, row) AS BIGINT) AS paragraph FROM n""")
def paragraph_breaks(spark, d):
    return reading.paragraphs(line_boxes(spark, d), "doc_id", LINE_KEYS).select("doc_id", *LINE_KEYS, "paragraph")


@query(f"""WITH {LINE_BOXES_SQL}, m AS (SELECT *, median(b - t) OVER w AS h, max(b) OVER w AS ch, min(t) OVER w AS top FROM line_boxes WINDOW w AS (PARTITION BY doc_id)),
 a AS (SELECT *, top <= 0.12 * ch AND t <= top + 1.5 * h AND b <= top + 2 * h AS i FROM m),
 e AS (SELECT *, i AND coalesce(min(CASE WHEN NOT i THEN t END) OVER w - max(CASE WHEN i THEN b END) OVER w >= 0.7 * h, true) AS head FROM a WINDOW w AS (PARTITION BY doc_id)),
 f AS (SELECT *, max(CASE WHEN NOT head THEN b END) OVER (PARTITION BY doc_id) AS low FROM e),
 g AS (SELECT *, coalesce(NOT head AND low >= 0.88 * ch AND b >= low - 1.5 * h AND t >= low - 2 * h, false) AS j FROM f),
 k AS (SELECT *, min(CASE WHEN j THEN t END) OVER w - max(CASE WHEN NOT head AND NOT j THEN b END) OVER w AS space FROM g WINDOW w AS (PARTITION BY doc_id))
 SELECT doc_id, line_no, row, CASE WHEN head THEN 'header' WHEN j AND coalesce(space >= 0.7 * h, true) THEN 'footer' ELSE 'body' END AS band FROM k""")
def header_footer_bands(spark, d):
    found = line_boxes(spark, d)
    metrics = found.groupBy("doc_id").agg(F.median(F.col("b") - F.col("t")).alias("median_word_h"), F.max("b").alias("coord_h"))
    return reading.bands(found, metrics, "doc_id", LINE_KEYS).select("doc_id", *LINE_KEYS, "band")


_SPLIT = "SELECT doc_id, line_no, row, t, b, CASE WHEN row % 2 = 1 AND doc_id % 3 <> 0 THEN l + 400 ELSE l END AS l, CASE WHEN row % 2 = 1 AND doc_id % 3 <> 0 THEN least(r, 300) + 400 ELSE least(r, 300) END AS r FROM line_boxes"


@query(f"""WITH {LINE_BOXES_SQL}, s AS ({_SPLIT}), o AS (SELECT *, lead(l) OVER w - l AS gap, (l + lead(l) OVER w) / 2 AS mid, row_number() OVER w AS n, count(*) OVER (PARTITION BY doc_id) AS total FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY l, line_no, row)),
 best AS (SELECT doc_id, arg_max(mid, row(gap, -n)) AS x, max(gap) AS gap FROM o WHERE gap IS NOT NULL AND total >= 4 GROUP BY doc_id),
 g AS (SELECT s.doc_id, x, gap, count(*) FILTER (l <= x) AS nl, count(*) FILTER (l > x) AS nr, stddev_pop(l) FILTER (l <= x) AS sl, stddev_pop(l) FILTER (l > x) AS sr, max(r) FILTER (l <= x) AS edge, min(l) FILTER (l > x) AS nxt FROM s JOIN best USING (doc_id) GROUP BY ALL)
 SELECT doc_id, x AS split_x, nl AS n_left, nr AS n_right FROM g WHERE gap >= 100 AND nl >= 2 AND nr >= 2 AND sl <= 80 AND sr <= 80 AND edge < nxt""")
def column_split(spark, d):
    right = (F.col("row") % 2 == 1) & (F.col("doc_id") % 3 != 0)
    edge = F.least(F.col("r"), F.lit(300.0))
    moved = line_boxes(spark, d).select("doc_id", *LINE_KEYS, "t", "b", F.when(right, F.col("l") + 400).otherwise(F.col("l")).alias("l"), F.when(right, edge + 400).otherwise(edge).alias("r"))
    return reading.column_split(moved, "doc_id", LINE_KEYS, F.lit(1000.0))


@query(f"""WITH {LINE_BOXES_SQL}, {_ROW_BLOCKS}, ms AS (SELECT doc_id, block, count(*) AS n, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b, median(r - l) AS mw, median(l) AS ml, stddev_pop(r) AS sp FROM blocks GROUP BY ALL),
 pg AS (SELECT doc_id, max(r) AS cw, max(b) AS ch, median(r - l) AS pw, min(t) AS ft, max(b) AS lb, avg(b - t) AS lh FROM line_boxes GROUP BY doc_id), ex AS (SELECT doc_id, median(l) AS bl, median(r) AS br FROM ms GROUP BY doc_id)
 SELECT doc_id, block, n AS n_lines, CASE WHEN n <= 3 AND t < 0.12 * ch AND t <= ft + 1.5 * lh THEN 'page header' WHEN n <= 3 AND b > 0.88 * ch AND b >= lb - 1.5 * lh THEN 'page footer' WHEN r < bl - 0.02 * cw THEN 'sidenote left' WHEN l > br + 0.02 * cw THEN 'sidenote right'
 WHEN pw > 0 AND n >= 2 AND mw < 0.75 * pw AND ml > bl + 0.03 * cw THEN CASE WHEN sp > 0.05 * cw THEN 'poetry' ELSE 'blockquote' END ELSE 'body' END AS role FROM ms JOIN pg USING (doc_id) JOIN ex USING (doc_id)""")
def classify_blocks(spark, d):
    blocks = reading.row_blocks(line_boxes(spark, d), "doc_id", LINE_KEYS)
    return reading.classify(reading.block_measures(blocks, "doc_id"), "doc_id").select("doc_id", "block", "n_lines", "role")


@query(f"""WITH {LINE_BOXES_SQL}, q AS (SELECT *, t < lag(t) OVER (PARTITION BY doc_id ORDER BY line_no, row) - greatest(0.5 * median(b - t) OVER (PARTITION BY doc_id), 1e-6) AS back FROM line_boxes)
 SELECT doc_id, CAST(6.0 * count(*) FILTER (length(trim(text)) <= 2) + 2.5 * count(*) FILTER (n_words <= 1) + 15.0 * count(*) FILTER (back) + CASE WHEN sum(n_words) / count(*) < 2 THEN 3.0 ELSE 0.0 END AS DOUBLE) AS quality FROM q GROUP BY doc_id""")
def row_block_quality(spark, d):
    return reading.block_quality(line_boxes(spark, d), "doc_id", LINE_KEYS)


@query(f"""WITH {BOXES_SQL}, g AS (SELECT *, l - lag(r) OVER (PARTITION BY doc_id, line_no, row ORDER BY word_no) AS gap, avg(b - t) OVER (PARTITION BY doc_id, line_no, row) AS h FROM boxes)
 SELECT doc_id, line_no, row, min(word_no) AS split_word FROM g WHERE gap > greatest(1.8 * h, 5.76) GROUP BY ALL""")
def caption_prefix_split(spark, d):
    return reading.caption_prefix(word_boxes(spark, d), "doc_id", LINE_KEYS, F.lit(720.0))


@query(f"""WITH {BOXES_SQL}, tb AS (SELECT *, b + CASE WHEN length(word) <= 2 AND word_no = 0 THEN 20 ELSE 0 END AS bb FROM boxes), m AS (SELECT *, median(bb - t) OVER (PARTITION BY doc_id) AS h, lead(word) OVER (PARTITION BY doc_id, line_no, row ORDER BY l, word_no) AS next_word FROM tb)
 SELECT doc_id, line_no, word_no, word, next_word FROM m WHERE bb - t >= 1.8 * h AND length(word) <= 2 AND next_word IS NOT NULL""")
def dropcap_candidates(spark, d):
    tall = word_boxes(spark, d).withColumn("b", F.col("b") + F.when((F.length("word") <= 2) & (F.col("word_no") == 0), 20).otherwise(0))
    return reading.drop_caps(tall, "doc_id", LINE_KEYS).select("doc_id", "line_no", "word_no", "word", "next_word")


_KEPT = "SELECT doc_id, word, l, t, r, b FROM boxes WHERE (doc_id + line_no * 7 + word_no) % 10 <> 3"


@query(f"WITH {BOXES_SQL} SELECT doc_id, word, l, t, r, b FROM boxes EXCEPT ALL {_KEPT}")
def dropped_words_except_all(spark, d):
    found = word_boxes(spark, d)
    return reading.dropped_words(found, found.where("(doc_id + line_no * 7 + word_no) % 10 <> 3"), "doc_id")


@query(f"WITH {BOXES_SQL}, k AS ({_KEPT}) SELECT doc_id, word, l, t, r, b, false AS recovered FROM k UNION ALL SELECT *, true FROM (SELECT doc_id, word, l, t, r, b FROM boxes EXCEPT ALL SELECT * FROM k)")
def recovered_union(spark, d):
    found = word_boxes(spark, d)
    return reading.recover(found.where("(doc_id + line_no * 7 + word_no) % 10 <> 3"), found, "doc_id")


@query()
def reading_order_pipeline(spark, d):
    return reading.reading_order(line_boxes(spark, d), "doc_id", LINE_KEYS).select("doc_id", *LINE_KEYS, "band", "block", "role", "place")


@query(f"WITH {BOXES_SQL} SELECT doc_id, line_no, round(coalesce(avg(conf), 0), 9) AS mean_conf, count(conf) AS n_scored, count(*) AS n_words FROM boxes GROUP BY ALL")
def confidence_nullable_mean(spark, d):
    return word_boxes(spark, d).groupBy("doc_id", "line_no").agg(F.round(F.coalesce(F.avg("conf"), F.lit(0.0)), 9).alias("mean_conf"), F.count("conf").alias("n_scored"), F.count("*").alias("n_words"))


@query("""WITH p AS (SELECT doc_id, 90 * (doc_id % 4) AS turn, n_chars % 97 / 97.0 AS conf FROM documents), r AS (SELECT doc_id, CAST(unnest([0, 90, 180, 270]) AS INT) AS rot, n_chars, unnest([n_chars % 97, n_chars % 53 + 5, n_chars % 71, n_chars % 83]) AS c FROM documents),
 z AS (SELECT *, max(CASE WHEN rot = 0 THEN c END) OVER (PARTITION BY doc_id) AS upright FROM r)
 SELECT doc_id, CASE WHEN max(upright) >= 60 THEN 0 ELSE arg_max(rot, (c, -rot)) END AS rotation FROM z GROUP BY doc_id""")
def rotation_argmax(spark, d):
    n = F.col("n_chars")
    tries = F.array(*[F.struct(F.lit(rot).alias("rotation"), (c / 100).alias("conf")) for rot, c in ((0, n % 97), (90, n % 53 + 5), (180, n % 71), (270, n % 83))])
    probes = table(spark, d, "documents").select("doc_id", F.inline(tries))
    return images.best_rotation(probes, "doc_id")


@query(f"""WITH {LINE_BOXES_SQL}, g AS (SELECT *, median(b - t) OVER (PARTITION BY doc_id) AS h, (SELECT max(length(x)) FROM (SELECT unnest(string_split(text, ' ')) AS x)) AS longest, length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS alnum FROM line_boxes)
 SELECT doc_id, line_no, row, n_words <= 2 AND trim(text) <> '' AND alnum <= 2 AND longest <= 3 AND NOT (n_words = 1 AND length(text) <= 2 AND regexp_matches(text, '\\p{{L}}') AND h > 0 AND b - t >= 1.8 * h) AS weak,
 regexp_matches(text, '^[\\p{{L}}\\p{{N}}]{{3,5}}$') AND regexp_matches(text, '\\p{{L}}') AND (regexp_matches(text, '\\p{{Nd}}') OR NOT regexp_matches(lower(text), '[aeiouy]') OR NOT regexp_matches(text, '^(?:\\p{{Lu}}+|\\p{{Ll}}+|\\p{{Lu}}\\p{{Ll}}+)$')) AS gibberish FROM g""")
def noise_lines(spark, d):
    found = line_boxes(spark, d).withColumn("h", F.median(F.col("b") - F.col("t")).over(Window.partitionBy("doc_id")))
    longest = F.array_max(F.transform(F.split("text", " "), F.length))
    return found.select("doc_id", *LINE_KEYS, fragments.is_weak(F.col("text"), F.col("n_words"), longest, F.col("b") - F.col("t"), F.col("h")).alias("weak"), fragments.is_gibberish(F.col("text")).alias("gibberish"))


@query(f"""WITH {BOXES_SQL}, x AS (SELECT doc_id, line_no, row, word_no, word, l, t, r, t + CASE WHEN word_no % 12 < 4 + doc_id % 3 THEN 10 ELSE 14 END AS b FROM boxes),
 o AS (SELECT *, row_number() OVER w AS at_, count(*) OVER (PARTITION BY doc_id, line_no, row) AS n, CASE WHEN lead(l) OVER w IS NOT NULL THEN greatest(lead(l) OVER w - r, 0) END AS gap FROM x WINDOW w AS (PARTITION BY doc_id, line_no, row ORDER BY l, word_no)),
 far AS (SELECT doc_id, line_no, row, arg_max(at_, row(gap, -at_)) AS cut, max(gap) AS gap, max(n) AS n FROM o WHERE gap IS NOT NULL AND n >= 4 GROUP BY ALL HAVING max(gap) >= 0.022 * 720),
 s AS (SELECT doc_id, line_no, row, cut, far.n, avg(b - t) FILTER (at_ <= cut) AS hl, avg(b - t) FILTER (at_ > cut) AS hr, max(r) FILTER (at_ <= cut) AS edge, min(l) FILTER (at_ > cut) AS nxt, max(word_no) FILTER (at_ = cut) AS last_left, max(word) FILTER (at_ = cut) AS e, max(word) FILTER (at_ = cut + 1) AS st FROM o JOIN far USING (doc_id, line_no, row) GROUP BY ALL)
 SELECT doc_id, line_no, row, last_left FROM s WHERE cut >= 2 AND n - cut >= 2 AND edge <= nxt AND greatest(hl, hr) / least(hl, hr) >= 1.2 AND (regexp_matches(st, '^\\p{{Ll}}') OR regexp_matches(e, '[-,]$'))""")
def mixed_lines_split(spark, d):
    tall = word_boxes(spark, d).withColumn("b", F.col("t") + F.when(F.col("word_no") % 12 < 4 + F.col("doc_id") % 3, 10).otherwise(14))
    return fragments.split_mixed(tall, "doc_id", LINE_KEYS, F.lit(720.0))


@query()
def fragments_rejoined(spark, d):
    half = F.floor(F.col("word_no") % 12 / 6).cast("int")
    parts = word_boxes(spark, d).withColumn("half", half).groupBy("doc_id", "line_no", "row", "half").agg(*union_boxes())
    number = (F.col("line_no") * 1000 + F.col("row") * 2 + F.col("half")).cast("int")
    return fragments.rejoin(parts.select("doc_id", number.alias("line_no"), *"ltrb"), "doc_id")


@query()
def words_grown_to_blocks(spark, d):
    found = fragments.grown_sizes(word_boxes(spark, d), "doc_id", ["line_no", "word_no"], 30.0, 15.0)
    return found.select("doc_id", "block", "n_words", F.col("line_no").alias("first_line"))


@query()
def floated_flow(spark, d):
    right = F.col("row") % 2 == 1
    moved = line_boxes(spark, d).withColumn("l", F.when(right, F.col("l") + 400).otherwise(F.col("l"))).withColumn("r", F.when(F.col("row") < 4, F.least(F.col("r"), F.lit(300.0))).otherwise(F.col("r")) + F.when(right, 400).otherwise(0))
    return fragments.floated(moved, "doc_id", LINE_KEYS, F.lit(1200.0)).groupBy("doc_id", "flow").agg(F.count("*").alias("n_lines"))
