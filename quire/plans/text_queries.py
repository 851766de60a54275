"""Queries on proof text."""

from pyspark.sql import functions as F

from quire.functions import labels, text

from .base import LINES_SQL, WORDS_SQL, lines, query, seeded, seeded_sql, table, words

SEED = seeded_sql()
NOTES = r"regexp_replace({}, '\[\*.*?\]', '', 'gs')"
FOOTNOTES = r"regexp_replace({}, '\[(\d+)\]', '\1', 'g')"
STARRED = r"regexp_replace({}, '-\*(\S+)\n(\S+)', '-' || chr(10) || '\1 \2', 'g')"
DASHES = "replace(replace({}, '----', '⸺'), '--', '—')"
STARS = r"regexp_replace(regexp_replace(trim({}, ' ' || chr(9) || chr(10) || chr(13)), '^\*', ''), '\*$', '')"


def _accents(c: str) -> str:
    for code, letter in text.diacritic_codes().items():
        c = f"replace({c}, '{code.replace(chr(39), chr(39) * 2)}', '{letter}')"
    return c


CHAIN = STARS.format(DASHES.format(STARRED.format(FOOTNOTES.format(_accents("replace(" + NOTES.format(f"replace({SEED}, chr(13) || chr(10), chr(10))") + ", '[Blank Page]', '')")))))


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", seeded(F.col("text")).alias("text"))


@query(f"""WITH pages AS (SELECT doc_id, {CHAIN} AS t FROM documents),
 lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM pages),
 words AS (SELECT doc_id, unnest(list_filter(string_split_regex(line, '\\s+'), lambda x: x <> '')) AS word FROM lines)
 SELECT doc_id, count(*) AS n_words, count(DISTINCT word) AS n_distinct, CAST(sum(length(word)) AS BIGINT) AS n_chars FROM words GROUP BY doc_id""")
def proof_text_statistics(spark, d):
    clean = _docs(spark, d).select("doc_id", F.posexplode(text.split_lines(text.proof_text(F.col("text"), quotes=False))).alias("line_no", "line"))
    found = clean.select("doc_id", F.explode(text.split_words(F.col("line"))).alias("word"))
    each = found.groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    return each.groupBy("doc_id").agg(F.sum("n").alias("n_words"), F.count("*").alias("n_distinct"), F.sum(F.col("n") * F.length("word")).alias("n_chars"))


def _one(name, f, sql):
    def run(spark, d):
        clean = _docs(spark, d).select("doc_id", F.col("text").alias("t"), f(F.col("text")).alias("text"))
        return clean.select("doc_id", "text", (F.col("text") != F.col("t")).alias("changed"))

    run.__name__ = name
    query(f"SELECT doc_id, x AS text, x <> t AS changed FROM (SELECT doc_id, t, {sql.format('t')} AS x FROM (SELECT doc_id, {SEED} AS t FROM documents))" if sql else None)(run)


_one("proof_notes_removed", text.remove_notes, NOTES)
_one("proof_diacritics", text.accent, _accents("{}"))
_one("proof_footnotes", text.unwrap_footnotes, FOOTNOTES)
_one("proof_dashes", text.long_dashes, DASHES)
_one("proof_edge_stars", text.trim_stars, STARS)
_one("proof_curly_quotes", text.curly_quotes, None)


@query(f"SELECT doc_id, {CHAIN} AS text FROM documents")
def proof_chain_no_quotes(spark, d):
    return _docs(spark, d).select("doc_id", text.proof_text(F.col("text"), quotes=False).alias("text"))


@query()
def proof_chain(spark, d):
    return _docs(spark, d).select("doc_id", text.proof_text(F.col("text")).alias("text"))


@query("""SELECT doc_id, regexp_replace(t, '-\\*(\\S+)\\n(\\S+)', '-' || chr(10) || '\\1 \\2', 'g') AS text, contains(t, '-*') AS had FROM (SELECT doc_id, replace(text, '.' || chr(10), '-*') AS t0, replace(replace(text, '.' || chr(10), 'x-*y' || chr(10)), '  ', ' ') AS t FROM documents)""")
def proof_starred_hyphens(spark, d):
    t = F.replace(F.replace(F.col("text"), F.lit(".\n"), F.lit("x-*y\n")), F.lit("  "), F.lit(" "))
    return table(spark, d, "documents").select("doc_id", text.join_starred_hyphens(t).alias("text"), F.contains(t, F.lit("-*")).alias("had"))


@query("""SELECT doc_id, replace(translate(t, '‘’‚‛“”„‟', repeat(chr(39), 4) || repeat(chr(34), 4)), '—', '--') AS text FROM (SELECT doc_id, replace(replace(replace(text, ' the ', ' ‘the’ '), ' de ', ' “de„ '), ', ', ' — ') AS t FROM documents)""")
def quotes_to_ascii(spark, d):
    t = F.replace(F.replace(F.replace(F.col("text"), F.lit(" the "), F.lit(" ‘the’ ")), F.lit(" de "), F.lit(" “de„ ")), F.lit(", "), F.lit(" — "))
    return table(spark, d, "documents").select("doc_id", text.plain_text(t).alias("text"))


@query(f"WITH {LINES_SQL} SELECT doc_id, line_no, line, CAST(length(line) AS INT) AS n_chars FROM lines")
def lines_of_page(spark, d):
    return lines(spark, d).select("doc_id", "line_no", "line", F.length("line").alias("n_chars"))


@query(f"WITH {WORDS_SQL} SELECT doc_id, line_no, word_no, word FROM words")
def words_of_page(spark, d):
    return words(spark, d)


@query(f"""WITH {WORDS_SQL}, ls AS (SELECT doc_id, line_no, string_agg(word, ' ' ORDER BY word_no) AS line FROM words GROUP BY ALL)
 SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text, count(*) AS n_lines FROM ls GROUP BY doc_id""")
def page_text_rendered(spark, d):
    ordered = lambda key, value: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, value))), lambda x: x[value]), " " if key == "word_no" else "\n")
    found = words(spark, d).groupBy("doc_id", "line_no").agg(ordered("word_no", "word").alias("line"))
    return found.groupBy("doc_id").agg(ordered("line_no", "line").alias("text"), F.count("*").alias("n_lines"))


@query("SELECT doc_id, length_grapheme(text) AS n_graphemes, length(text) AS n_chars FROM documents")
def grapheme_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", text.grapheme_count(F.col("text")).cast("long").alias("n_graphemes"), F.length("text").cast("long").alias("n_chars"))


@query("SELECT doc_id, CASE WHEN source = 'src0' THEN 'latest' ELSE left(source || '-0123456789', 8) END AS revision FROM documents")
def short_revisions(spark, d):
    rev = F.when(F.col("source") == "src0", "").otherwise(F.concat("source", F.lit("-0123456789")))
    return table(spark, d, "documents").select("doc_id", text.short_revision(rev).alias("revision"))


# Other names of style labels.
STYLE_ALIASES = {"italic": "italics", "italicized": "italics", "bolded": "bold", "smallcaps": "small caps", "all small caps": "small caps"}


@query("""SELECT event_id, array_to_string(CASE WHEN len(x) > 1 THEN list_filter(x, lambda y: y <> 'regular') ELSE x END, ',') AS labels
 FROM (SELECT event_id, CASE event_type WHEN 'click' THEN ['italics', 'regular', 'bold'] WHEN 'view' THEN ['regular'] ELSE ['small caps', event_type] END AS x FROM events)""")
def style_labels_canonical(spark, d):
    given = F.when(F.col("event_type") == "click", F.array(F.lit("Italic"), F.lit("regular"), F.lit("bolded"), F.lit(" ITALICS "))).when(F.col("event_type") == "view", F.array(F.lit("Regular"), F.lit("regular")))
    given = given.otherwise(F.array(F.lit("Small-Caps"), F.lit("all_small_caps"), F.col("event_type")))
    return table(spark, d, "events").select("event_id", F.array_join(labels.canonical_labels(given, STYLE_ALIASES), ",").alias("labels"))


@query("""SELECT page_id, lower(tag) AS tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<(/?[A-Za-z][A-Za-z0-9]*)', 1)) AS tag FROM pages) GROUP BY ALL""")
def html_tags(spark, d):
    found = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<(/?[A-Za-z][A-Za-z0-9]*)"), F.lit(1))).alias("tag"))
    return found.groupBy("page_id", F.lower("tag").alias("tag")).agg(F.count("*").alias("n"))


@query("""SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript, count(*) AS n_turns, count(*) FILTER (role = 'user') AS n_user FROM conversations GROUP BY conv_id""")
def conversation_transcripts(spark, d):
    turns = F.sort_array(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda x: x["line"]), "\n").alias("transcript"), F.count("*").alias("n_turns"), F.count_if(F.col("role") == "user").alias("n_user"))
