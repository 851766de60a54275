"""Queries on drop caps: letters that stand alone, and letters that weren't read."""

from pyspark.sql import functions as F

from quire.operators import dropcaps

from .base import BOXES_SQL, query, word_boxes


def capped_words(spark, d):
    """Words whose paragraphs begin, in every third place, with a tall letter that stands in a paragraph of its own; on
    every fifth page it stands too far away, and on others a mark was read with it."""
    x = word_boxes(spark, d)
    begins = ((F.col("doc_id") + F.col("line_no")) % 3 == 0) & (F.col("word_no") == 0) & (F.length("word") > 1)
    left = F.col("l") - F.when(F.col("doc_id") % 5 == 0, 200).otherwise(0)
    rest = F.struct(
        (2 * F.col("line_no") + 1).alias("paragraph"), "row", "word_no", F.when(begins, F.expr("substring(word, 2)")).otherwise(F.col("word")).alias("word"),
        F.when(begins, F.col("l") + 35).otherwise(F.col("l")).alias("l"), "t", F.when(begins, F.col("l") + 58).otherwise(F.col("r")).alias("r"), "b",
    )
    cap = F.struct(
        (2 * F.col("line_no")).alias("paragraph"), F.lit(0).alias("row"), F.lit(0).alias("word_no"), F.concat(F.left("word", F.lit(1)), F.when(F.col("line_no") % 2 == 0, "'").otherwise("")).alias("word"),
        left.alias("l"), "t", (left + 30).alias("r"), (F.col("t") + 34).alias("b"),
    )
    return x.select("doc_id", F.inline(F.when(begins, F.array(rest, cap)).otherwise(F.array(rest)))).withColumn("block", F.lit(0))


CAPPED_SQL = (
    BOXES_SQL
    + """, cb AS (SELECT *, (doc_id + line_no) % 3 = 0 AND word_no = 0 AND length(word) > 1 AS begins FROM boxes),
 cw AS (SELECT doc_id, 2 * line_no + 1 AS paragraph, row, word_no, CASE WHEN begins THEN substr(word, 2) ELSE word END AS word, CASE WHEN begins THEN l + 35 ELSE l END AS l, t, CASE WHEN begins THEN l + 58 ELSE r END AS r, b FROM cb
  UNION ALL SELECT doc_id, 2 * line_no, 0, 0, left(word, 1) || CASE WHEN line_no % 2 = 0 THEN '''' ELSE '' END, l - CASE WHEN doc_id % 5 = 0 THEN 200 ELSE 0 END, t, l - CASE WHEN doc_id % 5 = 0 THEN 200 ELSE 0 END + 30, t + 34 FROM cb WHERE begins)"""
)


# Letters meet the first lines of the next paragraphs by a join; the run of letters that follow one another is walked through.
@query(f"""WITH {CAPPED_SQL}, h AS (SELECT doc_id, median(b - t) AS mid FROM cw GROUP BY doc_id), p AS (SELECT doc_id, paragraph, count(*) AS n, min(row) AS first_, max(row) AS last_, row_number() OVER (PARTITION BY doc_id ORDER BY paragraph) AS k FROM cw WHERE trim(word) <> '' GROUP BY doc_id, paragraph),
 c AS (SELECT cw.*, p.k, mid FROM cw JOIN p USING (doc_id, paragraph) JOIN h USING (doc_id) WHERE n = 1 AND first_ = last_ AND b - t >= 1.8 * mid AND length(trim(word)) <= 2),
 a AS (SELECT DISTINCT c.doc_id, c.k, c.paragraph, q.paragraph AS into_, q.first_ FROM c JOIN p q ON q.doc_id = c.doc_id AND q.k = c.k + 1 JOIN cw w ON w.doc_id = c.doc_id AND w.paragraph = q.paragraph AND w.row = q.first_ AND (w.l + w.r) / 2 > (c.l + c.r) / 2
  AND w.l - c.r BETWEEN -0.25 * (c.r - c.l) AND greatest(2.5 * mid, 28.8) AND w.t BETWEEN c.t - 0.5 * mid AND c.t + 1.5 * mid),
 i AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS isle FROM a), m AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY doc_id, isle ORDER BY k) % 2 = 1),
 s AS (SELECT cw.doc_id, coalesce(into_, cw.paragraph) AS paragraph, coalesce(first_, row) AS row, word_no, CASE WHEN into_ IS NOT NULL THEN left(trim(word), 1) ELSE word END AS word, l, into_ IS NOT NULL AS cap FROM cw LEFT JOIN m ON m.doc_id = cw.doc_id AND m.paragraph = cw.paragraph)
 SELECT doc_id, paragraph, row, rtrim(string_agg(word || CASE WHEN cap THEN '' ELSE ' ' END, '' ORDER BY NOT cap, l, word_no)) AS text, count(*) FILTER (cap) AS n_caps FROM s GROUP BY doc_id, paragraph, row""")
def dropcaps_stitched(spark, d):
    moved = dropcaps.stitch(capped_words(spark, d), "doc_id", "block", "paragraph", "row", F.lit(720.0))
    key = ["doc_id", "paragraph", "row"]
    counts = moved.groupBy(*key).agg(F.count("component").alias("n_caps"))
    return dropcaps.lines_of(moved, key).join(counts, key)


def page():
    """Ten paragraphs to a page.  A function, as columns can't be made before there is a session."""
    return F.expr("doc_id * 1000 + floor(line_no / 10)")


def gapped_words(spark, d):
    """Ten paragraphs to a page, in units of the page.  Every fourth paragraph has lost its first letter, and its first two
    rows, or three, are set in; on every third page a dash was read in the letter's place."""
    line, row, doc = F.col("line_no"), F.col("row"), F.col("doc_id")
    lost = line % 4 == 1
    aside = F.when(lost & (row < 2 + doc % 2), 50.0).otherwise(0.0)
    x = word_boxes(spark, d, page()).where(~lost | (F.col("word_no") > 0) | (F.length("word") > 1))
    key = ["page", F.lit(0).alias("block"), line.alias("paragraph"), row.alias("row")]
    down = 400.0 * (line % 10) - 400.0 * line
    top = 400.0 * (line % 10)
    word = F.struct(
        "word_no", F.when(lost & (F.col("word_no") == 0), F.expr("substring(word, 2)")).otherwise(F.col("word")).alias("word"),
        ((F.col("l") + aside) / 720).alias("l"), ((F.col("t") + down) / 4400).alias("t"), ((F.col("r") + aside) / 720).alias("r"), ((F.col("b") + down) / 4400).alias("b"), "conf",
    )
    dash = F.struct(F.lit(-5).alias("word_no"), F.lit("-").alias("word"), (F.lit(10.0) / 720).alias("l"), ((top + 2) / 4400).alias("t"), (F.lit(20.0) / 720).alias("r"), ((top + 8) / 4400).alias("b"), F.lit(0.5).alias("conf"))
    return x.select(*key, F.inline(F.when(lost & (F.col("word_no") == 0) & (doc % 3 == 0), F.array(word, dash)).otherwise(F.array(word))))


def gap_parts(spark, d):
    """A part as tall as three rows before each paragraph that lost its letter, and a speck before each paragraph."""
    line = F.col("line_no")
    top = 400.0 * (line % 10)
    box = lambda part, a, b, c, e, area: F.struct(part.alias("part"), (F.lit(a) / 720).alias("l"), ((top + b) / 4400).alias("t"), (F.lit(c) / 720).alias("r"), ((top + e) / 4400).alias("b"), F.lit(area).alias("area"))
    begins = word_boxes(spark, d, page()).where("word_no = 0")
    return begins.select("page", F.inline(F.filter(F.array(F.when(line % 4 == 1, box(line, 6.0, -4.0, 40.0, 34.0, 1000)), box(line + 1000, 8.0, 1.0, 12.0, 6.0, 20)), lambda x: x.isNotNull())))


# Median words, and the middle of sorted lists, as the steps take them; claims by a self-join.
RECOVERED_SQL = (
    BOXES_SQL
    + """, gw AS (SELECT doc_id * 1000 + line_no // 10 AS page, line_no AS paragraph, row, word_no, CASE WHEN line_no % 4 = 1 AND word_no = 0 THEN substr(word, 2) ELSE word END AS word, (l + aside) / 720 AS l, (t + down) / 4400 AS t, (r + aside) / 720 AS r, (b + down) / 4400 AS b
  FROM (SELECT *, CAST(CASE WHEN line_no % 4 = 1 AND row < 2 + doc_id % 2 THEN 50 ELSE 0 END AS DOUBLE) AS aside, CAST(400 * (line_no % 10) - 400 * line_no AS DOUBLE) AS down FROM boxes WHERE line_no % 4 <> 1 OR word_no > 0 OR length(word) > 1)
  UNION ALL SELECT doc_id * 1000 + line_no // 10, line_no, row, -5, '-', 10::DOUBLE / 720, (400 * (line_no % 10) + 2)::DOUBLE / 4400, 20::DOUBLE / 720, (400 * (line_no % 10) + 8)::DOUBLE / 4400 FROM boxes WHERE line_no % 4 = 1 AND word_no = 0 AND length(word) > 1 AND doc_id % 3 = 0),
 gt AS (SELECT doc_id * 1000 + line_no // 10 AS page, line_no AS part, 6::DOUBLE / 720 AS l, (400 * (line_no % 10) - 4)::DOUBLE / 4400 AS t, 40::DOUBLE / 720 AS r, (400 * (line_no % 10) + 34)::DOUBLE / 4400 AS b, 1000 AS area FROM boxes WHERE word_no = 0 AND line_no % 4 = 1
  UNION ALL SELECT doc_id * 1000 + line_no // 10, line_no + 1000, 8::DOUBLE / 720, (400 * (line_no % 10) + 1)::DOUBLE / 4400, 12::DOUBLE / 720, (400 * (line_no % 10) + 6)::DOUBLE / 4400, 20 FROM boxes WHERE word_no = 0),
 gl AS (SELECT page, paragraph, row, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b, count(*) AS n, min(struct_pack(l := l, word_no := word_no, word := word)) FILTER (regexp_matches(word, '\\p{L}')) AS first_ FROM gw WHERE trim(word) <> '' GROUP BY page, paragraph, row),
 le AS (SELECT page, list_sort(list(l)) AS ls FROM gl GROUP BY page), ge AS (SELECT page, list_sort(ls[:greatest(1, CAST(floor(len(ls) * 0.3::DOUBLE) AS INT))]) AS ls FROM le), gb AS (SELECT page, ls[len(ls) // 2 + 1] AS body_left FROM ge),
 gr AS (SELECT page, paragraph, arg_min(l, row) AS fl, list_sort(list(l) FILTER (row > first_row)) AS rest FROM (SELECT *, min(row) OVER (PARTITION BY page, paragraph) AS first_row FROM gl) GROUP BY page, paragraph),
 gi AS (SELECT page, list_sort(list(fl - rest[len(rest) // 2 + 1])) AS ds FROM gr JOIN gb USING (page) WHERE len(rest) > 0 AND abs(rest[len(rest) // 2 + 1] - body_left) <= 0.02::DOUBLE AND fl > rest[len(rest) // 2 + 1] GROUP BY page),
 gs AS (SELECT gb.page, body_left, coalesce(ds[len(ds) // 2 + 1], 0.03::DOUBLE) AS indent FROM gb LEFT JOIN gi USING (page)),
 gn AS (SELECT *, lead(l) OVER o AS nl, lead(t) OVER o AS nt, lead(r - l) OVER o AS nw, lead(n) OVER o AS nn, b - t AS h FROM gl WINDOW o AS (PARTITION BY page ORDER BY t, paragraph, row)),
 gc AS (SELECT gn.*, body_left, greatest(t - greatest(1.5 * h, 0.02), 0) AS y0, least(b + 0.5 * h, 1) AS y1 FROM gn JOIN gs USING (page) WHERE first_.l BETWEEN body_left + indent + 0.025::DOUBLE AND body_left + 0.10::DOUBLE AND nt <= b + 2 * h AND (nl >= body_left + indent - 0.02::DOUBLE OR nn <= 1 AND nw <= 2 * h)),
 gm AS (SELECT page, median(b - t) AS mid FROM gw GROUP BY page),
 gf AS (SELECT gc.page, gc.paragraph, gc.row, gt.part, gt.l AS pl, greatest(gt.t, y0) AS pt, least(gt.r, first_.l) AS pr, least(gt.b, y1) AS pb FROM gc JOIN gm USING (page) JOIN gt ON gt.page = gc.page AND gt.l > greatest(body_left - 0.005, 0)
  AND least(gt.b, y1) - greatest(gt.t, y0) BETWEEN 1.5 * mid AND 6 * mid AND least(gt.r, first_.l) - gt.l >= 0.3 * (least(gt.b, y1) - greatest(gt.t, y0))
  QUALIFY row_number() OVER (PARTITION BY gc.page, gc.paragraph, gc.row ORDER BY area DESC, part) = 1),
 gx AS (SELECT DISTINCT upper(replace(word, 'ß', 'ss')) AS w FROM boxes), go AS (SELECT substr(w, 2) AS rest, min(left(w, 1)) AS cap FROM gx WHERE regexp_matches(w, '^[A-Z].') GROUP BY 1 HAVING count(*) = 1),
 gk AS (SELECT gc.*, gf.part, pl, pt, pr, pb, cap FROM gc LEFT JOIN gf USING (page, paragraph, row) LEFT JOIN go ON rest = regexp_replace(upper(replace(trim(first_.word), 'ß', 'ss')), '[.,;:!?''"\\-)]+$', '')),
 gd AS (SELECT *, CASE WHEN part IS NOT NULL AND EXISTS (SELECT 1 FROM gk e WHERE e.page = gk.page AND e.part = gk.part AND e.cap IS NOT NULL AND (e.t, e.paragraph, e.row) < (gk.t, gk.paragraph, gk.row)) THEN 'taken' WHEN part IS NOT NULL AND cap IS NOT NULL THEN 'drop cap' ELSE 'drop cap unrecovered' END AS state FROM gk),
 gy AS (SELECT gw.*, d.state, d.cap, d.first_, length(trim(gw.word)) BETWEEN 1 AND 2 AND gw.l < d.first_.l AND NOT (gw.r < pl OR gw.l > pr OR gw.b < pt OR gw.t > pb) AND d.state = 'drop cap' AS over_ FROM gw LEFT JOIN (SELECT * FROM gd WHERE state <> 'taken') d USING (page, paragraph, row)),
 gz AS (SELECT *, coalesce(over_ AND row_number() OVER (PARTITION BY page, paragraph, row, over_ ORDER BY word_no) = 1, false) AS stands FROM gy),
 ga AS (SELECT page, paragraph, row, word_no, CASE WHEN stands THEN cap ELSE word END AS word, l, CASE WHEN stands THEN 'drop cap' WHEN state = 'drop cap unrecovered' AND word_no = first_.word_no THEN state END AS component FROM gz
  UNION ALL SELECT page, paragraph, row, -1, cap, pl, 'drop cap' FROM gd WHERE state = 'drop cap' AND NOT EXISTS (SELECT 1 FROM gz WHERE gz.page = gd.page AND gz.paragraph = gd.paragraph AND gz.row = gd.row AND stands))"""
)


@query(f"""WITH {RECOVERED_SQL} SELECT page, paragraph, row, rtrim(string_agg(word || CASE WHEN component = 'drop cap' THEN '' ELSE ' ' END, '' ORDER BY coalesce(component <> 'drop cap', true), l, word_no)) AS text,
 count(*) FILTER (component = 'drop cap') AS n_caps, count(*) FILTER (component = 'drop cap unrecovered') AS n_lost FROM ga GROUP BY page, paragraph, row""")
def dropcaps_recovered(spark, d):
    lexicon = word_boxes(spark, d).select("word")
    found = dropcaps.recover(gapped_words(spark, d), gap_parts(spark, d), lexicon, "page", "block", "paragraph", "row")
    key = ["page", "paragraph", "row"]
    counts = found.groupBy(*key).agg(F.count_if(F.col("component") == dropcaps.CAP).alias("n_caps"), F.count_if(F.col("component") == dropcaps.LOST).alias("n_lost"))
    return dropcaps.lines_of(found, key).join(counts, key)
