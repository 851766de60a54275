"""Queries on steps of page reorganization, on reference words of found words, and on labels of marks."""

from pyspark.sql import functions as F

from quire.functions import labels
from quire.operators import continuations, layout, matching, reading

from .base import LINE_BOXES_SQL, LINES_SQL, ORACLE_SQL, REGIONS_SQL, WORDS_SQL, line_boxes, lines, query, regions, table, words
from .layout_queries import _ROW_BLOCKS, LINE_KEYS
from .match_queries import _EDGES, _proof_tokens


@query(f"""WITH {LINE_BOXES_SQL}, n AS (SELECT doc_id, b, lead(t) OVER (PARTITION BY doc_id ORDER BY t, l, line_no, row) AS nt FROM line_boxes), g AS (SELECT doc_id, greatest(nt - b, 0) AS gap FROM n WHERE nt IS NOT NULL)
 SELECT doc_id, count(*) AS n_gaps, median(gap) AS median_gap, round(stddev_pop(gap), 6) AS spread, count(*) >= 2 AND stddev_pop(gap) <= greatest(1, 0.65 * greatest(median(gap), 1)) AS consistent FROM g GROUP BY doc_id""")
def gaps_consistent(spark, d):
    return reading.gaps_consistent(line_boxes(spark, d), "doc_id", LINE_KEYS).withColumn("spread", F.round("spread", 6))


# A block for each line, and one more with every other word of it, which comes before it on some pages and after it on others.
@query(f"""WITH {WORDS_SQL}, m AS (SELECT doc_id, line_no * 2 AS block, line_no, word_no FROM words UNION ALL SELECT doc_id, line_no * 2 - 1 + 2 * (doc_id % 2), line_no, word_no FROM words WHERE word_no % 2 = 0)
 SELECT DISTINCT doc_id, CAST(block AS BIGINT) AS block FROM m WHERE NOT EXISTS (SELECT 1 FROM m e WHERE e.doc_id = m.doc_id AND e.line_no = m.line_no AND e.word_no = m.word_no AND e.block < m.block)""")
def blocks_not_covered(spark, d):
    found = words(spark, d).select("doc_id", "line_no", "word_no")
    own = found.withColumn("block", (F.col("line_no") * 2).cast("long"))
    again = found.where("word_no % 2 = 0").withColumn("block", (F.col("line_no") * 2 - 1 + 2 * (F.col("doc_id") % 2)).cast("long"))
    return reading.uncovered_blocks(own.union(again), "doc_id", "block", ["line_no", "word_no"])


@query(f"""WITH {LINE_BOXES_SQL}, u AS (SELECT doc_id, line_no, row, l / 720 AS l FROM line_boxes),
 e AS (SELECT doc_id, list_sort(list(l))[CAST(count(*) // 2 AS INT) + 1] AS body_left FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY l) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM u) WHERE k <= greatest(1, CAST(floor(CAST(n AS DOUBLE) * CAST(0.3 AS DOUBLE)) AS INT)) GROUP BY doc_id),
 p AS (SELECT doc_id, line_no, arg_min(l, row) AS first_, list_sort(list(l) FILTER (row > 0)) AS rest FROM u GROUP BY ALL),
 i AS (SELECT doc_id, first_ - rest[len(rest) // 2 + 1] AS indent FROM p JOIN e USING (doc_id) WHERE len(rest) > 0 AND abs(rest[len(rest) // 2 + 1] - body_left) <= CAST(0.02 AS DOUBLE) AND first_ > rest[len(rest) // 2 + 1])
 SELECT doc_id, body_left, coalesce(standard_indent, 0.03::DOUBLE) AS standard_indent FROM e LEFT JOIN (SELECT doc_id, list_sort(list(indent))[CAST(count(*) // 2 AS INT) + 1] AS standard_indent FROM i GROUP BY doc_id) USING (doc_id)""")
def indent_signature(spark, d):
    found = line_boxes(spark, d).withColumn("l", F.col("l") / 720)
    return reading.indent_signature(found, "doc_id", "line_no", ["row"])


@query(f"""WITH {WORDS_SQL}, lex AS (SELECT DISTINCT upper(replace(word, 'ß', 'ss')) AS w FROM words), one AS (SELECT substr(w, 2) AS rest, min(left(w, 1)) AS cap FROM lex WHERE regexp_matches(w, '^[A-Z].') GROUP BY 1 HAVING count(*) = 1)
 SELECT doc_id, line_no, substr(word, 2) AS word, cap FROM (SELECT * FROM words WHERE word_no = 0) f LEFT JOIN one ON rest = regexp_replace(upper(replace(substr(word, 2), 'ß', 'ss')), '[.,;:!?''"\\-)]+$', '')""")
def dropcap_letters(spark, d):
    """The first word of every line without its first letter, and the letter by the words of all documents."""
    found = words(spark, d)
    cut = found.where("word_no = 0").select("doc_id", "line_no", F.expr("substring(word, 2)").alias("word"))
    return reading.cap_letters(cut, found.select("word")).select("doc_id", "line_no", "word", "cap")


@query(f"""WITH {REGIONS_SQL} SELECT doc_id, pos, l * 2.5 AS l, t * 1.25 AS t, r * 2.5 AS r, b * 1.25 AS b, CASE WHEN doc_id % 3 = 0 THEN 'decoration' ELSE 'illustration' END AS role FROM regions WHERE type = 'figure'""")
def illustration_blocks(spark, d):
    kind = F.when((F.col("type") == "figure") & (F.col("doc_id") % 3 == 0), "decoration").otherwise(F.col("type"))
    found = layout.illustration_blocks(regions(spark, d).withColumn("type", kind), F.lit(2.5), F.lit(1.25))
    return found.select("doc_id", "pos", *"ltrb", "role")


@query(f"""WITH {_EDGES} SELECT doc_id, round, token_index, bound AS boundary, row_number() OVER (PARTITION BY doc_id, round, bound, CASE WHEN place = 'leading' THEN pp ELSE page_id END, CASE WHEN place = 'leading' THEN pl ELSE line_no END,
 CASE WHEN place = 'trailing' THEN np ELSE page_id END, CASE WHEN place = 'trailing' THEN nl ELSE line_no END ORDER BY token_index) - 1 AS ordinal FROM edges WHERE reason IS NULL""")
def continuation_ordinals(spark, d):
    found = continuations.ordinals(continuations.edges(_proof_tokens(spark, d), "doc_id"), "doc_id")
    return found.select("doc_id", "round", F.col("token_index").cast("long").alias("token_index"), "boundary", F.col("ordinal").cast("long").alias("ordinal"))


# Lines whose end was cut off, cut off with a mark set after it, or ends with a dash, against the whole lines.
@query(f"""WITH {LINES_SQL}, f AS (SELECT doc_id, line_no, line, CASE (doc_id + line_no) % 4 WHEN 0 THEN left(line, greatest(length(line) - 3, 0)) WHEN 1 THEN left(line, greatest(length(line) - 2, 0)) || '.' WHEN 2 THEN left(line, greatest(length(line) - 2, 0)) || '-' ELSE line END AS found FROM lines),
 w AS (SELECT doc_id, line_no, regexp_extract(found, '([^ \\t\\n\\x0B\\f\\r]+)[ \\t\\n\\x0B\\f\\r]*$', 1) AS a, regexp_extract(line, '([^ \\t\\n\\x0B\\f\\r]+)[ \\t\\n\\x0B\\f\\r]*$', 1) AS b FROM f),
 c AS (SELECT *, lower(regexp_replace(a, '[.,;:!?)\\]}}"'']+$', '')) AS x, lower(regexp_replace(b, '[.,;:!?)\\]}}"'']+$', '')) AS y FROM w)
 SELECT doc_id, line_no, NOT regexp_matches(a, '[-–—‒⸺⸻]$') AND length(x) >= 2 AND length(y) > length(x) AND starts_with(y, x) AS wraps FROM c""")
def soft_wrapped_lines(spark, d):
    turn, n = (F.col("doc_id") + F.col("line_no")) % 4, F.length("line")
    cut = lambda k: F.left("line", F.greatest(n - k, F.lit(0)))
    found = F.when(turn == 0, cut(3)).when(turn == 1, F.concat(cut(2), F.lit("."))).when(turn == 2, F.concat(cut(2), F.lit("-"))).otherwise(F.col("line"))
    return lines(spark, d).select("doc_id", "line_no", matching.soft_wrap(found, F.col("line")).alias("wraps"))


@query(f"""WITH {WORDS_SQL}, t AS (SELECT doc_id, line_no, word_no, CASE WHEN length(word) % 7 = 0 THEN '' ELSE word END AS found, CASE WHEN word_no % 5 = 1 THEN NULL ELSE upper(replace(word, 'ß', 'ss')) END AS truth FROM words),
 l AS (SELECT doc_id, line_no, string_agg(truth, ' ' ORDER BY word_no) AS line FROM t WHERE found <> '' AND truth <> '' GROUP BY ALL) SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY line_no)) AS truth FROM l GROUP BY doc_id""")
def truth_of_found_words(spark, d):
    seen = words(spark, d).withColumn("truth", F.when(F.col("word_no") % 5 != 1, F.upper("word"))).withColumn("word", F.when(F.length("word") % 7 == 0, "").otherwise(F.col("word")))
    return matching.truth_of_found(seen, "doc_id").select("doc_id", F.md5("truth").alias("truth"))


@query(f"""WITH {WORDS_SQL}, g AS (SELECT doc_id, line_no, word_no, word, CASE WHEN word_no % 5 = 3 THEN array_to_string(regexp_extract_all(word, '.'), '  ') ELSE array_to_string(regexp_extract_all(word, '.'), ' ') END AS spaced FROM words)
 SELECT doc_id, line_no, word_no, CASE WHEN length(spaced) >= 3 AND length(spaced) % 2 = 1 AND NOT contains(spaced, '  ') THEN word END AS word FROM g""")
def letter_spaced_words(spark, d):
    letters = F.split("word", "")
    joined = F.split(F.when(F.col("word_no") % 5 == 3, F.array_join(letters, "  ")).otherwise(F.array_join(letters, " ")), "")
    return words(spark, d).select("doc_id", "line_no", "word_no", F.array_join(labels.letter_spaced(joined, F.lit(0), F.size(joined)), "").alias("word"))


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'FI' WHEN 1 THEN 'LONG_ST' WHEN 2 THEN 'LONG_ST' WHEN 3 THEN 'FFL' WHEN 4 THEN 'QU' ELSE 'other' END AS kind FROM documents""")
def ligature_kinds(spark, d):
    raw = F.element_at(F.array(*[F.lit(x) for x in ("fi", "LONG_S_T", "long_s_t", "FFL", "qu", "other")]), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", labels.ligature_kind(raw).alias("kind"))


# The second row of the second line of text is a caption; on some pages the rows below it are raised, cut to half, or both.
@query(f"""WITH {LINE_BOXES_SQL}, x AS (SELECT doc_id, line_no, row, l, CASE WHEN line_no = 1 AND row >= 2 AND doc_id % 2 = 0 THEN t - 6 ELSE t END AS t, CASE WHEN line_no = 1 AND row >= 2 AND doc_id % 2 = 0 THEN b - 6 ELSE b END AS b,
 CASE WHEN line_no = 1 AND (row = 2 AND doc_id % 3 > 0 OR row IN (3, 4) AND doc_id % 3 = 1) THEN l + (r - l) / 2 ELSE r END AS r, line_no = 1 AND row = 1 AS seed FROM line_boxes),
 s AS (SELECT doc_id, median(l) FILTER (seed) AS sx, min(t) FILTER (seed) AS y0, max(b) FILTER (seed) AS y1, avg(b - t) FILTER (seed) AS h, median(r - l) AS usual FROM x GROUP BY doc_id), f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY t, l, line_no, row) AS k FROM x WHERE NOT seed),
 c AS (SELECT f.* FROM f JOIN s USING (doc_id) WHERE sx IS NOT NULL AND (t + b) / 2 BETWEEN y0 - 0.3 * h AND y1 + 0.9 * h AND abs(l - sx) <= 0.3 * 720 AND r - l <= 0.82 * usual)
 SELECT doc_id, line_no, row FROM c WHERE (SELECT count(*) FROM f WHERE f.doc_id = c.doc_id AND f.k > c.k AND f.t - c.b <= 3.0 * greatest(c.b - c.t, 1) AND abs(f.l - c.l) <= 0.04 * 720 AND abs(f.r - c.r) <= 0.07 * 720) < 2""")
def caption_tails(spark, d):
    line, row, doc = F.col("line_no"), F.col("row"), F.col("doc_id")
    raised = F.when((line == 1) & (row >= 2) & (doc % 2 == 0), 6.0).otherwise(0.0)
    halved = (line == 1) & (((row == 2) & (doc % 3 > 0)) | (row.isin(3, 4) & (doc % 3 == 1)))
    right = F.when(halved, F.col("l") + (F.col("r") - F.col("l")) / 2).otherwise(F.col("r"))
    found = line_boxes(spark, d).select("doc_id", *LINE_KEYS, "l", (F.col("t") - raised).alias("t"), right.alias("r"), (F.col("b") - raised).alias("b"))
    return layout.caption_tails(found, "doc_id", LINE_KEYS, (line == 1) & (row == 1), F.lit(720.0)).select("doc_id", *LINE_KEYS)


# Twins of queries of other modules, from those of their steps.
ORACLE_SQL["reading_order_pipeline"] = f"""WITH {LINE_BOXES_SQL}, {_ROW_BLOCKS}, bands AS ({ORACLE_SQL["header_footer_bands"]}), roles AS ({ORACLE_SQL["classify_blocks"]})
 SELECT doc_id, line_no, row, band, block, role, row_number() OVER (PARTITION BY doc_id ORDER BY CASE band WHEN 'header' THEN 0 WHEN 'body' THEN 1 ELSE 2 END, block, t, l, line_no, row) - 1 AS place FROM blocks JOIN bands USING (doc_id, line_no, row) JOIN roles USING (doc_id, block)"""
ORACLE_SQL["word_uuids"] = f"""WITH {WORDS_SQL}, h AS (SELECT doc_id, line_no, word_no, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(concat_ws('/', doc_id, line_no, word_no))) AS x FROM words)
 SELECT doc_id, line_no, word_no, concat(x[1:8], '-', x[9:12], '-5', x[14:16], '-', substr('89ab89ab89ab89ab', instr('0123456789abcdef', x[17]), 1), x[18:20], '-', x[21:32]) AS word_id FROM h"""
ORACLE_SQL["floated_flow"] = f"""WITH {LINE_BOXES_SQL}, m AS (SELECT doc_id, line_no, row, t, b, CASE WHEN row % 2 = 1 THEN l + 400 ELSE l END AS l, CASE WHEN row < 4 THEN least(r, 300) ELSE r END + CASE WHEN row % 2 = 1 THEN 400 ELSE 0 END AS r FROM line_boxes),
 a AS (SELECT *, count(*) OVER w AS n, r - l <= 0.86 * median(r - l) OVER w AS narrow FROM m WINDOW w AS (PARTITION BY doc_id)),
 s AS (SELECT *, CASE WHEN l - lag(l) OVER (PARTITION BY doc_id, narrow ORDER BY l, line_no, row) > 0.12 * 1200 THEN 1 ELSE 0 END AS step, count(*) FILTER (narrow) OVER (PARTITION BY doc_id) AS narrows FROM a),
 c AS (SELECT *, sum(step) OVER (PARTITION BY doc_id, narrow ORDER BY l, line_no, row) AS cluster FROM s),
 g AS (SELECT *, narrow AND count(*) OVER w >= 3 AND stddev_pop(l) OVER w <= 0.09 * 1200 AND narrows >= 6 AND n >= 8 AS good, avg(l) OVER w AS at_ FROM c WINDOW w AS (PARTITION BY doc_id, narrow, cluster)),
 f AS (SELECT *, min(CASE WHEN good THEN at_ END) OVER (PARTITION BY doc_id) AS first_ FROM g), k AS (SELECT *, min(CASE WHEN good AND at_ > first_ THEN at_ END) OVER (PARTITION BY doc_id) AS nxt FROM f),
 z AS (SELECT *, CASE WHEN nxt - first_ >= 0.14 * 1200 THEN nxt END AS second_ FROM k), r AS (SELECT *, coalesce(good AND at_ = second_, false) AS is_right FROM z),
 e AS (SELECT *, min(CASE WHEN is_right THEN t END) OVER w AS top, max(CASE WHEN is_right THEN b END) OVER w AS bottom FROM r WINDOW w AS (PARTITION BY doc_id))
 SELECT doc_id, CASE WHEN second_ IS NULL THEN 'body' WHEN is_right THEN 'right' WHEN b <= top THEN 'pre' WHEN t >= bottom THEN 'post' WHEN good AND at_ = first_ THEN 'left' ELSE 'body' END AS flow, count(*) AS n_lines FROM e GROUP BY ALL"""
