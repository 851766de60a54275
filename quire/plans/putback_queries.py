"""The query on dropped words that are put back."""

from pyspark.sql import functions as F

from quire.operators import putback

from .base import BOXES_SQL, query, word_boxes


# One word in ten is dropped, and all words of some rows; the twin holds every dropped word against all lines of its page.
@query(f"""WITH {BOXES_SQL}, x AS (SELECT doc_id, line_no * 1000 + row AS line, word_no, line_no, word, l, t, r, b, (doc_id + line_no * 7 + word_no) % 10 = 3 OR (line_no + row) % 9 = 4 OR doc_id % 50 = 7 AS gone FROM boxes),
 n AS (SELECT doc_id, line, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b FROM x WHERE NOT gone GROUP BY ALL),
 p AS (SELECT x.doc_id, x.line_no, x.word_no, n.line FROM x JOIN n USING (doc_id) WHERE gone QUALIFY row_number() OVER (PARTITION BY x.doc_id, x.line_no, x.word_no ORDER BY greatest(n.t - x.b, x.t - n.b, 0), greatest(n.l - x.r, x.l - n.r, 0), n.line) = 1),
 e AS (SELECT doc_id, line, line_no, word_no, word, l, r, false AS recovered FROM x WHERE NOT gone UNION ALL SELECT x.doc_id, coalesce(p.line, -1), x.line_no, x.word_no, word, l, r, true FROM x LEFT JOIN p USING (doc_id, line_no, word_no) WHERE gone)
 SELECT doc_id, line, line_no, word_no, word, recovered, row_number() OVER (PARTITION BY doc_id, line ORDER BY l, r, line_no, word_no) - 1 AS place FROM e""")
def words_put_back(spark, d):
    x = word_boxes(spark, d).withColumn("line", F.col("line_no") * 1000 + F.col("row"))
    gone = ((F.col("doc_id") + F.col("line_no") * 7 + F.col("word_no")) % 10 == 3) | ((F.col("line_no") + F.col("row")) % 9 == 4) | (F.col("doc_id") % 50 == 7)
    found = putback.put_back(x.where(~gone), x.where(gone), "doc_id", "line", ["line_no", "word_no"])
    return found.select("doc_id", "line", "line_no", "word_no", "word", "recovered", F.col("place").cast("long").alias("place"))
