"""Queries on alignment, continuations, markup, contracts, edits, events and images."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import labels
from quire.operators import contracts, continuations, edits, images, markup, matching
from quire.sources import ocr, sinks
from quire.streaming import events as streams

from .base import BOXES_SQL, LINES_SQL, WORDS_SQL, lines, query, table, word_boxes, words

# Lines of a document, and as its reference the same with every seventh line left out and every fifth changed.
_FOUND = f"{LINES_SQL}, found AS (SELECT doc_id, line_no, line AS text FROM lines), ref AS (SELECT doc_id, line_no, CASE WHEN (doc_id + line_no) % 5 = 2 THEN text || ' x' ELSE text END AS text FROM found WHERE (doc_id + line_no) % 7 <> 3)"


def _pair(spark, d):
    found = lines(spark, d).withColumnRenamed("line", "text")
    turn = F.col("doc_id") + F.col("line_no")
    return found, found.where(turn % 7 != 3).withColumn("text", F.when(turn % 5 == 2, F.concat("text", F.lit(" x"))).otherwise(F.col("text")))


@query(f"""WITH {_FOUND}, a AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY line_no) AS k FROM found), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY line_no) AS k FROM ref)
 SELECT a.doc_id, a.text, a.line_no, b.line_no AS reference_line_no FROM a JOIN b USING (doc_id, text, k)""")
def truth_equal_lines(spark, d):
    return matching.equal_lines(*_pair(spark, d), "doc_id")


@query(f"WITH {_FOUND} SELECT doc_id, line_no, text FROM ref r WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.doc_id = r.doc_id AND f.text = r.text)")
def truth_orphans(spark, d):
    return matching.orphans(*_pair(spark, d), "doc_id").select("doc_id", "line_no", "text")


@query(f"""WITH {WORDS_SQL}, t AS (SELECT *, CASE WHEN word_no % 11 = 5 THEN NULL WHEN length(word) % 6 = 1 THEN word || 's' ELSE word END AS truth FROM words)
 SELECT doc_id, line_no, count(*) AS n_words, count(truth) AS n_truth, count(*) FILTER (truth = word) AS n_match, count(truth) - count(*) FILTER (truth = word) AS n_mismatch,
 CASE WHEN count(truth) > 0 THEN count(*) FILTER (truth = word) / count(truth) ELSE 1.0 END AS accuracy FROM t GROUP BY ALL""")
def truth_line_accuracy(spark, d):
    truth = F.when(F.col("word_no") % 11 == 5, None).when(F.length("word") % 6 == 1, F.concat("word", F.lit("s"))).otherwise(F.col("word"))
    return matching.line_accuracy(words(spark, d).withColumn("truth", truth), ["doc_id", "line_no"])


@query()
def truth_fuzzy_lines(spark, d):
    found, reference = _pair(spark, d)
    near = matching.neighbours(found, reference, "doc_id")
    scored = near.select("doc_id", "line_no", "reference_line_no", matching.fuzzy_ratio(F.col("text"), F.col("truth")).alias("score"))
    return matching.greedy_pairs(scored, "doc_id", "line_no", "reference_line_no")


@query()
def truth_diff_lines(spark, d):
    return matching.diff_lines(*_pair(spark, d), "doc_id")


@query()
def truth_match_lines(spark, d):
    return matching.match_lines(*_pair(spark, d), "doc_id")


def _line_tokens(spark, d):
    """Words of every line, a line of a document (doc_id:line_no) being what is aligned."""
    return words(spark, d).select(F.concat_ws(":", "doc_id", "line_no").alias("line"), F.col("word_no").alias("pos"), F.col("word").alias("text"))


@query()
def match_documents(spark, d):
    source = _line_tokens(spark, d)
    target = source.where("pos % 5 <> 3").withColumn("text", F.when(F.col("pos") % 4 == 1, F.concat("text", F.lit("e"))).otherwise(F.upper("text")))
    found = matching.match_documents(source, target, "line")
    return found.select("line", "cost", "margin", "accepted", F.array_join("reasons", ",").alias("reasons"), F.to_json("best").alias("best"))


# Proof tokens of two rounds: a line's last word may carry a star after a hyphen, the next line's first word one in front.
_TOKENS = f"""{WORDS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, word_no) - 1 AS token_index, word_no = max(word_no) OVER (PARTITION BY doc_id, line_no) AS last_ FROM words),
 tokens AS (SELECT r.round, doc_id, token_index, 'p' || lpad(CAST(line_no // 4 + CASE WHEN doc_id % 5 = 0 AND line_no >= 8 THEN 1 ELSE 0 END AS VARCHAR), 3, '0') AS page_id, line_no // 4 AS page_index, line_no, 
 CASE WHEN last_ AND (doc_id + line_no) % 3 = 0 THEN word || CASE WHEN r.round = 2 AND doc_id % 4 = 1 THEN '*' ELSE '-*' END WHEN word_no = 0 AND (doc_id + line_no) % 4 = 1 THEN '*' || word WHEN word_no = 2 AND length(word) > 6 AND doc_id % 2 = 0 THEN left(word, 3) || '*' || substr(word, 4) ELSE word END AS text
 FROM n, (VALUES (1), (2)) AS r(round))"""
_EDGES = _TOKENS + r""", near AS (SELECT *, lead(text) OVER w AS nt, lag(text) OVER w AS pt, lead(page_id) OVER w AS np, lag(page_id) OVER w AS pp, lead(page_index) OVER w AS ni, lag(page_index) OVER w AS pi, lead(line_no) OVER w AS nl, lag(line_no) OVER w AS pl FROM tokens WINDOW w AS (PARTITION BY doc_id, round ORDER BY token_index)),
 placed AS (SELECT *, CASE WHEN regexp_matches(text, '^[^*]+\*[^*]+$') THEN 'inside' WHEN regexp_matches(text, '^[^*].*\*$') OR text = '*' THEN 'trailing' WHEN regexp_matches(text, '^\*[^*]') AND NOT coalesce(suffix(pt, '*'), false) THEN 'leading' END AS place FROM near),
 linked AS (SELECT *, CASE place WHEN 'inside' THEN 'same_line'
  WHEN 'trailing' THEN CASE WHEN page_id = np AND line_no = nl THEN 'same_line' WHEN page_id = np AND nl = line_no + 1 THEN 'line' WHEN page_id <> np AND ni = page_index + 1 AND CAST(right(np, 3) AS INT) = CAST(right(page_id, 3) AS INT) + 1 THEN 'page' END
  ELSE CASE WHEN page_id = pp AND line_no = pl THEN 'same_line' WHEN page_id = pp AND line_no = pl + 1 THEN 'line' WHEN page_id <> pp AND page_index = pi + 1 AND CAST(right(page_id, 3) AS INT) = CAST(right(pp, 3) AS INT) + 1 THEN 'page' END END AS bound,
  CASE place WHEN 'inside' THEN split_part(text, '*', 1) WHEN 'trailing' THEN left(text, length(text) - 1) ELSE pt END AS lt, CASE place WHEN 'inside' THEN split_part(text, '*', -1) WHEN 'trailing' THEN regexp_replace(nt, '^\*', '') ELSE substr(text, 2) END AS rt FROM placed WHERE place IS NOT NULL),
 edges AS (SELECT *, CASE WHEN text = '*' THEN 'empty_fragment' WHEN place = 'trailing' AND nt IS NULL THEN 'orphan_trailing_marker' WHEN place = 'leading' AND pt IS NULL THEN 'orphan_leading_marker' WHEN bound IS NULL THEN 'nonadjacent_markers' WHEN rt = '' OR lt = '' THEN 'empty_fragment' END AS reason FROM linked)"""


def _proof_tokens(spark, d):
    order = Window.partitionBy("doc_id").orderBy("line_no", "word_no")
    last = F.col("word_no") == F.max("word_no").over(Window.partitionBy("doc_id", "line_no"))
    found = words(spark, d).withColumn("token_index", F.row_number().over(order) - 1).withColumn("_last", last)
    found = found.withColumn("round", F.explode(F.array(F.lit(1), F.lit(2))))
    number = F.floor(F.col("line_no") / 4) + F.when((F.col("doc_id") % 5 == 0) & (F.col("line_no") >= 8), 1).otherwise(0)
    turn = F.col("doc_id") + F.col("line_no")
    star = F.when((F.col("round") == 2) & (F.col("doc_id") % 4 == 1), "*").otherwise("-*")
    text = (
        F.when(F.col("_last") & (turn % 3 == 0), F.concat("word", star))
        .when((F.col("word_no") == 0) & (turn % 4 == 1), F.concat(F.lit("*"), "word"))
        .when((F.col("word_no") == 2) & (F.length("word") > 6) & (F.col("doc_id") % 2 == 0), F.concat(F.substring("word", 1, 3), F.lit("*"), F.expr("substring(word, 4)")))
        .otherwise(F.col("word"))
    )
    return found.select("doc_id", "round", "token_index", F.concat(F.lit("p"), F.lpad(number.cast("string"), 3, "0")).alias("page_id"), F.floor(F.col("line_no") / 4).cast("int").alias("page_index"), F.col("line_no").alias("line_id"), F.col("line_no").alias("line_index"), text.alias("text"))


@query(f"""WITH {_EDGES} SELECT doc_id, round, token_index, place, CASE WHEN reason IS NULL THEN lt END AS "left", CASE WHEN reason IS NULL THEN rt END AS "right", CASE WHEN reason IS NULL THEN bound END AS boundary,
 CASE WHEN reason IS NULL THEN CASE WHEN regexp_matches(lt, '(^|[^-])-$') THEN regexp_replace(lt, '-$', '') || rt || '|' || lt || rt || '|' || lt || ' ' || rt ELSE lt || rt END END AS candidates, CASE WHEN reason IS NULL THEN CASE WHEN regexp_matches(lt, '(^|[^-])-$') THEN 'ambiguous' ELSE 'preserve_punctuation' END END AS decision, reason FROM edges""")
def continuation_markers(spark, d):
    found = continuations.edges(_proof_tokens(spark, d), "doc_id")
    return found.select("doc_id", "round", F.col("token_index").cast("long").alias("token_index"), "place", "left", "right", "boundary", F.when(F.col("candidates").isNotNull(), F.array_join("candidates", "|")).alias("candidates"), "decision", "reason")


@query(f"""WITH {_EDGES}, ok AS MATERIALIZED (SELECT * FROM edges WHERE reason IS NULL) SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.token_index, b.token_index) AS token_index, a.lt AS first_left, a.rt AS first_right, b.lt AS second_left, b.rt AS second_right,
 CASE WHEN b.lt IS NULL THEN 'first_only' WHEN a.lt IS NULL THEN 'second_only' WHEN a.lt = b.lt AND a.rt = b.rt THEN 'agreed' ELSE 'conflict' END AS status FROM (SELECT * FROM ok WHERE round = 1 AND token_index % 9 <> 4) a FULL OUTER JOIN (SELECT * FROM ok WHERE round = 2) b ON a.doc_id = b.doc_id AND a.token_index = b.token_index""")
def continuation_reconcile(spark, d):
    found = continuations.edges(_proof_tokens(spark, d), "doc_id")
    return continuations.reconcile(found.where("round = 1 and token_index % 9 <> 4"), found.where("round = 2"), ["doc_id", "token_index"]).withColumn("token_index", F.col("token_index").cast("long"))


@query(f"""WITH {_EDGES} SELECT doc_id, t.round, count(*) FILTER (contains(t.text, '*')) AS n_starred, count(*) FILTER (e.token_index IS NOT NULL) AS n_proven FROM tokens t LEFT JOIN (SELECT doc_id, round, token_index FROM edges WHERE reason IS NULL) e USING (doc_id, round, token_index) GROUP BY ALL""")
def continuation_surface(spark, d):
    both = continuations.surfaced(_proof_tokens(spark, d), "doc_id")
    return both.groupBy("doc_id", "round").agg(F.count_if(F.contains(F.col("text"), F.lit("*"))).alias("n_starred"), F.count_if(F.col("text") != F.col("clean")).alias("n_proven"))


@query("""SELECT page_id, n, prev, coalesce(n = prev + 1, true) AS consecutive FROM (SELECT page_id, CAST(nullif(regexp_extract(url, '(\\d+)\\D*$', 1), '') AS BIGINT) AS n, lag(CAST(nullif(regexp_extract(url, '(\\d+)\\D*$', 1), '') AS BIGINT)) OVER (PARTITION BY regexp_extract(url, '//([^/]*)', 1) ORDER BY page_id) AS prev FROM pages)""")
def page_numbers_consecutive(spark, d):
    found = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "//([^/]*)", 1).alias("host"), continuations.page_number(F.col("url")).alias("n"))
    before = F.lag("n").over(Window.partitionBy("host").orderBy("page_id"))
    return found.withColumn("prev", before).drop("host").withColumn("consecutive", F.coalesce(F.col("n") == F.col("prev") + 1, F.lit(True)))


# Style spans over a line's characters, two for each line, and its words as intervals.
_SPANS = f"""{WORDS_SQL}, toks AS (SELECT doc_id, line_no, word_no, word_no * 10 AS token_start, word_no * 10 + least(length(word), 9) AS token_end FROM words),
 spans AS (SELECT DISTINCT doc_id, line_no, s.label, s.a + line_no % 7 AS start_, s.b AS end_ FROM words, (VALUES ('italics', 3, 37), ('bold', 30, 64), ('italics', 64, 70)) AS s(label, a, b))"""


def _spans(spark, d):
    tokens = words(spark, d).select(F.struct("doc_id", "line_no").alias("page"), "word_no", (F.col("word_no") * 10).alias("token_start"), (F.col("word_no") * 10 + F.least(F.length("word"), F.lit(9))).alias("token_end"))
    fixed = F.array(*[F.struct(F.lit(n).alias("label"), F.lit(a).alias("start"), F.lit(b).alias("end")) for n, a, b in (("italics", 3, 37), ("bold", 30, 64), ("italics", 64, 70))])
    pages = words(spark, d).select(F.struct("doc_id", "line_no").alias("page")).distinct()
    return pages.select("page", F.inline(fixed)).withColumn("start", F.col("start") + F.col("page.line_no") % 7), tokens


@query(f"WITH {_SPANS} SELECT doc_id, line_no, word_no, label, CAST(greatest(start_, token_start) - token_start AS INT) AS \"start\", CAST(least(end_, token_end) - token_start AS INT) AS \"end\" FROM spans JOIN toks USING (doc_id, line_no) WHERE start_ < token_end AND token_start < end_")
def style_span_projection(spark, d):
    return matching.project_spans(*_spans(spark, d), "page").select("page.doc_id", "page.line_no", "word_no", "label", "start", "end")


@query(f"""WITH {_SPANS}, cut AS (SELECT doc_id, line_no, word_no, label, greatest(start_, token_start) - token_start AS a, least(end_, token_end) - token_start AS b, token_end - token_start AS n FROM spans JOIN toks USING (doc_id, line_no) WHERE start_ < token_end AND token_start < end_),
 g AS (SELECT *, a > coalesce(max(b) OVER (PARTITION BY doc_id, line_no, word_no, label ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gap FROM cut)
 SELECT doc_id, line_no, word_no, label FROM g GROUP BY ALL HAVING NOT bool_or(gap) AND max(b) >= max(n)""")
def whole_word_labels(spark, d):
    cut = matching.project_spans(*_spans(spark, d), "page").withColumn("n", F.col("token_end") - F.col("token_start"))
    return contracts.whole_labels(cut, ["page", "word_no"], "n").select("page.doc_id", "page.line_no", "word_no", "label")


@query(f"WITH {_SPANS}, pts AS (SELECT DISTINCT doc_id, line_no, word_no * 10 AS at_ FROM words) SELECT doc_id, line_no, at_ AS \"at\", string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM pts JOIN spans USING (doc_id, line_no) WHERE start_ <= at_ AND at_ < end_ GROUP BY ALL")
def labels_at_points(spark, d):
    spans, tokens = _spans(spark, d)
    found = contracts.labels_at(spans, tokens.select("page", F.col("token_start").alias("at")), "page")
    return found.select("page.doc_id", "page.line_no", "at", F.array_join("labels", ",").alias("labels"))


@query("""SELECT doc_id, array_to_string(list_filter(['quality', 'style', 'toxic'], lambda x: CASE x WHEN 'quality' THEN quality = 0 WHEN 'toxic' THEN toxic = 1 ELSE doc_id % 4 <> 0 END), ',') AS missing,
 quality = 1 AND toxic = 0 AND doc_id % 4 = 0 AND doc_id % 3 <> 2 AS complete FROM labels""")
def taxonomy_missing_labels(spark, d):
    state = lambda c: F.when(c, "positive").otherwise("unknown")
    states = F.create_map(F.lit("quality"), state(F.col("quality") == 1), F.lit("toxic"), state(F.col("toxic") == 0))
    states = F.when(F.col("doc_id") % 4 == 0, F.map_concat(states, F.create_map(F.lit("style"), F.lit("negative")))).otherwise(states)
    review = F.when(F.col("doc_id") % 3 == 0, "reviewed").when(F.col("doc_id") % 3 == 1, "reviewed_regular").otherwise("pending")
    required = F.array(F.lit("quality"), F.lit("style"), F.lit("toxic"))
    return table(spark, d, "labels").select("doc_id", F.array_join(labels.missing_labels(required, states), ",").alias("missing"), labels.is_complete(required, states, review).alias("complete"))


@query("""SELECT 'dangling orders' AS rule, (SELECT count(*) FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_nationkey <> 3)) AS n_broken
 UNION ALL SELECT 'repeated order', (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1))
 UNION ALL SELECT 'line numbers', (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) <> count(DISTINCT l_linenumber) OR min(l_linenumber) <> 1 OR max(l_linenumber) <> count(*)))
 UNION ALL SELECT 'mixed status', (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linestatus) > 1))""")
def manifest_integrity(spark, d):
    t = {n: table(spark, d, n) for n in ("orders", "customer", "lineitem")}
    return contracts.verdict({
        "dangling orders": contracts.dangling(t["orders"], t["customer"].where("c_nationkey <> 3"), {"o_custkey": "c_custkey"}),
        "repeated order": contracts.repeated_keys(t["orders"], ["o_orderkey"]),
        "line numbers": contracts.not_dense(t["lineitem"], ["l_orderkey"], "l_linenumber", 1),
        "mixed status": contracts.mixed(t["lineitem"], ["l_orderkey"], "l_linestatus"),
    })


@query("""SELECT doc_id, sha256('{"lang":"' || lang || '","source":"' || source || '"}') AS content_id, doc_id % 3 = 0 AS wrong FROM documents""")
def sha256_content_id(spark, d):
    found = table(spark, d, "documents").withColumn("content_id", labels.content_id({"source": F.col("source"), "lang": F.col("lang")})).withColumn("body", F.to_json(F.struct("lang", "source")))
    claimed = found.withColumn("claimed", F.when(F.col("doc_id") % 3 == 0, "none").otherwise(F.col("content_id")))
    wrong = contracts.wrong_hash(claimed, "body", "claimed").select("doc_id", F.lit(True).alias("wrong"))
    return claimed.join(wrong, "doc_id", "left").select("doc_id", "content_id", F.coalesce("wrong", F.lit(False)).alias("wrong"))


@query()
def word_uuids(spark, d):
    import uuid

    return words(spark, d).select("doc_id", "line_no", "word_no", labels.uuid5(uuid.NAMESPACE_URL, F.concat_ws("/", "doc_id", "line_no", "word_no")).alias("word_id"))


@query()
def markup_tokens(spark, d):
    marked = F.replace(F.replace(F.replace(F.col("text"), F.lit(" the "), F.lit(" <i>the</i> ")), F.lit(" de "), F.lit(" [**note?] <b>de ")), F.lit(" of "), F.lit(" /* of^{2} */ "))
    return markup.tokens(table(spark, d, "documents").select("doc_id", marked.alias("marked")), "doc_id", "marked")


@query()
def markup_pages(spark, d):
    marked = F.replace(F.replace(F.col("text"), F.lit(" the "), F.lit(" <i>the</i> ")), F.lit(" de "), F.lit(" <b>de</b> "))
    found = markup.pages(table(spark, d, "documents").select("doc_id", marked.alias("marked")), "doc_id", "marked")
    return found.select("doc_id", F.size("spans").alias("n_spans"), F.array_join("warnings", ",").alias("warnings"), "trainable", F.md5("visible").alias("visible"))


@query(f"WITH {BOXES_SQL} SELECT doc_id, line_no, word_no // 3 AS grp, string_agg(word, '' ORDER BY l, word_no) AS word, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b, round(avg(conf), 9) AS conf, min(word_no) AS word_no FROM boxes GROUP BY ALL")
def merge_words(spark, d):
    grouped = word_boxes(spark, d).withColumn("grp", F.floor(F.col("word_no") / 3).cast("int"))
    return edits.merge_words(grouped, ["doc_id", "line_no", "grp"]).withColumn("conf", F.round("conf", 9))


@query(f"""WITH {BOXES_SQL}, c AS (SELECT *, CASE WHEN word_no % 2 = 0 THEN 3 END AS at_ FROM boxes), k AS (SELECT *, coalesce(at_ < length(word), false) AS cut FROM c)
 SELECT doc_id, line_no, word_no, 0 AS part, CASE WHEN cut THEN left(word, 3) ELSE word END AS word, l, CASE WHEN cut THEN round(l + (r - l) * 3 / length(word), 6) ELSE r END AS r, CASE WHEN cut THEN NULL ELSE conf END AS conf FROM k
 UNION ALL SELECT doc_id, line_no, word_no, 1, substr(word, 4), round(l + (r - l) * 3 / length(word), 6), r, NULL FROM k WHERE cut""")
def split_words(spark, d):
    found = edits.split_words(word_boxes(spark, d), F.when(F.col("word_no") % 2 == 0, 3))
    return found.select("doc_id", "line_no", "word_no", "part", "word", F.round("l", 6).alias("l"), F.round("r", 6).alias("r"), "conf")


@query(f"""WITH {WORDS_SQL}, m AS (SELECT doc_id, CASE WHEN line_no IN (1, 3) THEN min(CASE WHEN line_no IN (1, 3) THEN line_no END) OVER (PARTITION BY doc_id) ELSE line_no END AS new_line, line_no, word_no, word FROM words)
 SELECT doc_id, new_line AS line_no, CAST(row_number() OVER (PARTITION BY doc_id, new_line ORDER BY line_no, word_no) - 1 AS INT) AS word_no, word FROM m""")
def merge_lines(spark, d):
    return edits.merge_lines(words(spark, d), "doc_id", F.col("line_no").isin(1, 3)).select("doc_id", "line_no", "word_no", "word")


@query(f"""WITH {WORDS_SQL}, c AS (SELECT *, CASE WHEN line_no % 2 = 0 AND word_no > 4 THEN 1 ELSE 0 END AS part FROM words), n AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY line_no, part) - 1 AS new_line FROM c)
 SELECT doc_id, CAST(new_line AS INT) AS line_no, CAST(row_number() OVER (PARTITION BY doc_id, new_line ORDER BY word_no) - 1 AS INT) AS word_no, word FROM n""")
def split_lines(spark, d):
    return edits.split_line(words(spark, d), "doc_id", F.when(F.col("line_no") % 2 == 0, 4)).select("doc_id", "line_no", "word_no", "word")


@query(f"""WITH {WORDS_SQL} SELECT doc_id, line_no, CAST(row_number() OVER (PARTITION BY doc_id, line_no ORDER BY word_no) - 1 AS INT) AS word_no, word, CASE WHEN length(word) > 3 THEN word END AS truth FROM words WHERE line_no % 3 <> 1 AND word <> 'the'""")
def deleted_and_renumbered(spark, d):
    found = words(spark, d)
    left = edits.delete(edits.delete(found, found.where("line_no % 3 = 1"), ["doc_id", "line_no"]), found.where("word = 'the'"), ["doc_id", "line_no", "word_no"])
    truth = edits.set_truth(left.withColumn("truth", F.lit(None).cast("string")), F.col("word"), F.length("word") > 3)
    return edits.renumber(truth, ["doc_id", "line_no"], ["word_no"], "word_no").select("doc_id", "line_no", "word_no", "word", "truth")


@query(f"""WITH {BOXES_SQL}, ls AS (SELECT doc_id, line_no, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b FROM boxes GROUP BY ALL), s AS (SELECT doc_id, line_no, NOT 777 BETWEEN t AND b AS a, CASE WHEN 777 BETWEEN t AND b THEN abs((l + r) / 2 - 333) ELSE abs((t + b) / 2 - 777) END AS d FROM ls)
 SELECT doc_id, line_no FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY a, d, line_no) AS n FROM s) WHERE n = 1""")
def closest_line(spark, d):
    from quire.functions.geometry import union_boxes

    found = word_boxes(spark, d).groupBy("doc_id", "line_no").agg(*union_boxes())
    return edits.closest_line(found, "doc_id", F.lit(333.0), F.lit(777.0))


@query("""WITH s AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 7200000000 THEN 1 ELSE 0 END AS new_ FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT *, sum(new_) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM s)
 SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, epoch_us(min(ts)) AS "first", epoch_us(max(ts)) AS "last" FROM g GROUP BY user_id, session""")
def session_gaps_events(spark, d):
    found = streams.batch_sessions(table(spark, d, "events"), "ts", "user_id", 7200)
    return found.select("user_id", "session", "n", streams.micros(F.col("first")).alias("first"), streams.micros(F.col("last")).alias("last"))


@query("""SELECT event_type, CAST(epoch_us(date_trunc('hour', ts)) AS BIGINT) AS hour, count(*) AS n, CAST(round(sum(value) * 100) AS BIGINT) AS cents, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY ALL""")
def events_by_hour(spark, d):
    found = table(spark, d, "events").withColumn("k", streams.json_number(F.col("props"), "$.k"))
    return found.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value") * 100).cast("long").alias("cents"), F.sum("k").alias("k")).select("event_type", streams.micros(F.col("w.start")).alias("hour"), "n", "cents", "k")


# The flat table of a recognizer, from words: some confidences are -1, some texts missing.
@query(f"""WITH {BOXES_SQL} SELECT doc_id AS page_num, line_no AS line_num, word_no AS word_num, CASE WHEN length(word) % 7 = 0 THEN '' ELSE word END AS word, l, t, l + 6 * length(word) AS r, t + 12 AS b,
 CASE WHEN length(word) % 5 = 0 THEN NULL ELSE CAST(length(word) * 7 % 100 AS DOUBLE) / 100 END AS conf FROM boxes WHERE CASE WHEN length(word) % 5 = 0 THEN true ELSE length(word) * 7 % 100 > 0 END""")
def flat_table_words(spark, d):
    n = F.length("word")
    flat = word_boxes(spark, d).where((n % 5 == 0) | (n * 7 % 100 > 0)).select(
        F.explode(F.array(F.lit(4), F.lit(5))).alias("level"), F.col("doc_id").alias("page_num"), F.col("line_no").alias("line_num"), F.col("word_no").alias("word_num"),
        F.col("l").cast("string").alias("left"), F.col("t").cast("string").alias("top"), (6 * n).cast("string").alias("width"), F.lit("12").alias("height"),
        F.when(n % 5 == 0, "-1").otherwise((n * 7 % 100).cast("string")).alias("conf"), F.when(n % 7 == 0, "NaN").otherwise(F.col("word")).alias("text"),
    )
    return ocr.flat_words(flat)


@query(f"WITH {BOXES_SQL} SELECT doc_id, CAST(sum(len(ws)) AS BIGINT) AS n_words, count(*) AS n_lines, string_agg(array_to_string(ws, ' '), chr(10) ORDER BY line_no) AS text FROM (SELECT doc_id, line_no, list(word ORDER BY word_no) AS ws FROM boxes GROUP BY ALL) GROUP BY doc_id")
def nested_pages_roundtrip(spark, d):
    nested = sinks.nested_pages(word_boxes(spark, d), ["doc_id"], ["line_no"])
    line = F.array_join(F.transform("x.words", lambda w: w["word"]), " ")
    found = nested.select("doc_id", F.explode("lines").alias("x")).select("doc_id", F.col("x.line_no").alias("line_no"), F.size("x.words").alias("n"), line.alias("line"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    return found.groupBy("doc_id").agg(F.sum("n").alias("n_words"), F.count("*").alias("n_lines"), F.array_join(ordered, "\n").alias("text"))


@query(f"WITH {BOXES_SQL} SELECT doc_id, count(*) AS n_crops, count(*) FILTER (length(word) > 5) AS n_long FROM boxes WHERE length(word) > 2 GROUP BY doc_id")
def training_sets(spark, d):
    found = word_boxes(spark, d).withColumn("truth", F.when(F.length("word") > 2, F.col("word")))
    crops = sinks.recognition_labels(found, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n_crops"))
    boxes = sinks.detection_labels(found, "doc_id", F.length("word") > 5).select("doc_id", F.size("polygons").cast("long").alias("n_long"))
    return crops.join(boxes, "doc_id", "left").withColumn("n_long", F.coalesce("n_long", F.lit(0).cast("long")))


@query("""SELECT vec_id, CASE WHEN h LIKE '89504e470d0a1a0a%' THEN 'png' WHEN h LIKE 'ffd8ff%' THEN 'jpeg' WHEN h LIKE '474946383961%' THEN 'gif' END AS format FROM (SELECT vec_id, CASE vec_id % 5 WHEN 0 THEN '89504e470d0a1a0a' WHEN 1 THEN 'ffd8ffe0' WHEN 2 THEN '474946383961' WHEN 3 THEN '00' ELSE 'ffd8' END AS h FROM embeddings)""")
def image_formats(spark, d):
    head = F.when(F.col("vec_id") % 5 == 0, "89504E470D0A1A0A").when(F.col("vec_id") % 5 == 1, "FFD8FFE0").when(F.col("vec_id") % 5 == 2, "474946383961").when(F.col("vec_id") % 5 == 3, "00").otherwise("FFD8")
    content = F.unhex(F.concat(head, F.lit("00" * 20)))
    return table(spark, d, "embeddings").select("vec_id", images.sniff(content).alias("format"))


_PIXELS = "CAST(greatest(0, least(255, floor(128 + 400 * x))) AS INT)"


def _images(spark, d):
    """Embeddings as 8 x 8 images."""
    pixel = lambda x: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + 400 * x.cast("double")))).cast("int")), 2, "0")
    return table(spark, d, "embeddings").select("vec_id", F.unhex(F.array_join(F.transform("embedding", pixel), "")).alias("pixels"), F.lit(8).alias("height"), F.lit(8).alias("width"))


@query(f"""WITH px AS (SELECT vec_id, {_PIXELS} AS p FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings)), lv AS (SELECT vec_id, unnest(range(256)) AS t FROM embeddings),
 c AS (SELECT lv.vec_id, t, count(*) FILTER (p <= t) AS n0, sum(p) FILTER (p <= t) AS s0, count(*) FILTER (p > t) AS n1, sum(p) FILTER (p > t) AS s1 FROM lv JOIN px USING (vec_id) GROUP BY ALL),
 v AS (SELECT vec_id, t, CASE WHEN n0 > 0 AND n1 > 0 THEN CAST(s0 * n1 - s1 * n0 AS DOUBLE) * CAST(s0 * n1 - s1 * n0 AS DOUBLE) / CAST(n0 * n1 AS DOUBLE) ELSE 0 END AS var FROM c)
 SELECT vec_id, CAST(t AS INT) AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY var DESC, t) AS n FROM v) WHERE n = 1""")
def image_otsu(spark, d):
    return images.map_images(_images(spark, d), "threshold int", lambda x: {"threshold": images.otsu(x)}, ["vec_id"])


@query()
def image_attributes(spark, d):
    def kernel(x):
        left, top, right, bottom = images.ink_edges(images.binarize(x))
        return images.page_attributes(x) | {"left": left, "top": top, "right": right, "bottom": bottom, "parts": images.components(images.binarize(x) == 0)[1]}

    return images.map_images(_images(spark, d), "blank boolean, plate boolean, centred boolean, left int, top int, right int, bottom int, parts int", kernel, ["vec_id"])


@query()
def comparison_views(spark, d):
    return lines(spark, d).select("doc_id", "line_no", matching.comparison_text(F.col("line")).alias("view"))


@query()
def truth_projected(spark, d):
    source = _line_tokens(spark, d)
    target = source.where("pos % 7 <> 3").withColumn("text", F.upper("text"))
    matched = matching.match_documents(source, target, "line")
    return matching.project_relations(source, matched, target, "line")


@query()
def image_corrections(spark, d):
    def kernel(x):
        big = images.on_canvas(x, 32, 24)
        found = images.correct(images.stretch(images.flatten(big, 9)))
        return {"side": found["side"], "curvature": found["curvature"], "skew": found["skew"], "ink": int((found["page"] == 0).sum()), "parts": len(images.boxes_of_parts(found["page"]))}

    return images.map_images(_images(spark, d), "side string, curvature double, skew double, ink int, parts int", kernel, ["vec_id"])


@query(f"WITH {BOXES_SQL} SELECT doc_id, line_no, row, round(regr_slope(b, (l + r) / 2), 6) AS slope, round(regr_intercept(b, (l + r) / 2), 6) AS intercept FROM boxes GROUP BY ALL HAVING count(*) >= 2")
def line_baselines(spark, d):
    found = word_boxes(spark, d)
    many = found.groupBy("doc_id", "line_no", "row").agg(F.count("*").alias("n")).where("n >= 2").drop("n")
    fitted = edits.baselines(found.join(many, ["doc_id", "line_no", "row"], "left_semi"), ["doc_id", "line_no", "row"])
    return fitted.select("doc_id", "line_no", "row", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


@query(f"WITH {WORDS_SQL} SELECT doc_id, line_no, word_no, contains(word, 's') AND length(word) > 2 AS fits FROM words")
def glyph_annotations_fit(spark, d):
    ligature = F.array(F.struct(F.lit(0).alias("start"), F.lit(3).alias("end")))
    return words(spark, d).select("doc_id", "line_no", "word_no", contracts.glyphs_fit(F.col("word"), ligature, F.array(F.instr("word", "s") - 1)).alias("fits"))


@query("""SELECT p.page_id, length(d.text) AS n_chars FROM pages p LEFT JOIN (SELECT sha256(text) AS h, any_value(text) AS text FROM documents GROUP BY 1) d ON d.h = (SELECT sha256(text) FROM documents WHERE doc_id = p.page_id) WHERE p.page_id % 2 = 0
 UNION ALL SELECT page_id, NULL FROM pages WHERE page_id % 2 = 1""")
def blobs_by_hash(spark, d):
    blobs = table(spark, d, "documents").select(F.col("text").alias("content"))
    digest = table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.sha2("text", 256).alias("sha"))
    pages = table(spark, d, "pages").select("page_id").join(digest, "page_id", "left").withColumn("sha", F.when(F.col("page_id") % 2 == 0, F.col("sha")).otherwise("none"))
    return contracts.with_blobs(pages, "sha", blobs).select("page_id", F.length("content").cast("long").alias("n_chars"))
