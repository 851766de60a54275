"""Repeated runs of lines, found by winnowing over line hashes; DataFrame functions only.

A line goes if it is in a run of whole lines with RUN_WORDS words or more that also stands at an earlier place; runs are
compared by their lines with a word, so blank lines don't matter.  Order of places: id, then a hash of the text, then line.
The first copy of everything stays.

Lines with a word get a hash and their place in words.  A gram is the shortest run of lines from a given line with at
least GRAM_WORDS words.  In every window of RUN_WORDS words, the gram of least hash is a fingerprint; so two documents
that share a run of lines of RUN_WORDS words or more share a fingerprint inside it.  Every fingerprint is joined with
its first position only, which keeps the join linear however many copies there are.  Each pair of positions is extended
both ways: the lines of the later document are matched with those of the first at the same distance, and each stretch of
equal lines with at least RUN_WORDS words is a run to delete.

The first position of a fingerprint may share less with a place than a later position does.  So windows of which the
fingerprint repeats, but that no run found covers, are anchored again by the hash of all their lines: each is joined with
the first window of that hash, and extended likewise.  The shortest windows with RUN_WORDS words from each line on, and
back from each line, make up every longer run; so nothing is left after that.

Null text stays null; empty text, or one without such runs, stays as it is, at any length.  Of rows with equal id and text,
those after the first lose the whole text if it has RUN_WORDS words.  Blank lines inside a deleted stretch go with it.
Extra columns are kept, whatever their names, but for the two that are added.  No rows: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

GRAM_WORDS = 30
RUN_WORDS = 50


def _keys(id_col: Column, text: Column) -> list[Column]:
    """Two hashes that name an id and text, null or not."""
    return [F.xxhash64(id_col, text).alias("h"), F.xxhash64(text, F.lit(1), id_col).alias("g")]


def line_table(docs: DataFrame, id_col: str, text_col: str, gram_words: int, run_words: int) -> DataFrame:
    """A row per line with a word, once for each id and text: its place and hash, the fingerprint of its window, and the
    windows (hash of all lines, first and last line, fingerprint) from it on and back from it, null if they are short."""
    lines = docs.select(F.col(id_col).alias("d"), *_keys(F.col(id_col), F.col(text_col)), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    lines = lines.select("d", "h", "g", "pos", F.xxhash64("line").alias("lh"), F.regexp_count("line", F.lit(r"[^\x20\x09-\x0D]+")).alias("n")).where("n > 0")
    lines = lines.repartition("h", "g").groupBy("h", "g", "pos").agg(F.first("d").alias("d"), F.first("lh").alias("lh"), F.first("n").cast("long").alias("n"))
    by_place = Window.partitionBy("h", "g").orderBy("pos")
    lines = lines.select("*", F.row_number().over(by_place).alias("idx"), F.sum("n").over(by_place).alias("e")).withColumn("b", F.col("e") - F.col("n"))
    by_word, by_end = Window.partitionBy("h", "g").orderBy("b"), Window.partitionBy("h", "g").orderBy("e")
    gram, on, back = by_word.rangeBetween(0, gram_words - 1), by_word.rangeBetween(0, run_words - 1), by_end.rangeBetween(1 - run_words, 0)
    lines = lines.select("*", F.xxhash64(F.collect_list("lh").over(gram)).alias("gram"), F.max("e").over(gram).alias("gram_end"), F.xxhash64(F.collect_list("lh").over(on)).alias("on"), F.max("idx").over(on).alias("on_end"), F.max("e").over(on).alias("on_words"))
    known = F.when(F.col("gram_end") - F.col("b") >= gram_words, F.struct("gram", (-F.col("b")).alias("late"), "idx"))
    picked = F.when(F.col("on_words") - F.col("b") >= run_words, F.min(known).over(by_word.rangeBetween(0, run_words - gram_words)))
    lines = lines.select("*", picked["gram"].alias("print"), picked["idx"].alias("print_idx"))
    first = F.first(F.struct("idx", "b", "print")).over(back)
    lines = lines.select("*", F.xxhash64(F.collect_list("lh").over(back)).alias("back"), first.alias("first"))
    on = F.when(F.col("print").isNotNull(), F.col("on"))
    back = F.when(F.col("e") - F.col("first.b") >= run_words, F.col("back"))
    return lines.select("d", "h", "g", "pos", "idx", "lh", "n", "print", "print_idx", on.alias("on"), "on_end", back.alias("back"), F.col("first.idx").alias("back_first"), F.col("first.print").alias("back_print"))


def _extended(pairs: DataFrame, lines: DataFrame, run_words: int) -> DataFrame:
    """(h, g, a, z, first_pos, last_pos): the stretches of equal lines, with enough words, of each pair's document with the
    first's at the pair's shift."""
    own = pairs.join(lines.select("h", "g", "pos", "idx", "lh", "n"), ["h", "g"]).withColumn("fidx", F.col("idx") - F.col("shift"))
    other = lines.select(F.col("h").alias("fh"), F.col("g").alias("fg"), F.col("idx").alias("fidx"), "lh")
    diagonal = ["h", "g", "fh", "fg", "shift"]
    stretch = F.col("idx") - F.row_number().over(Window.partitionBy(*diagonal).orderBy("idx"))
    same = own.join(other, ["fh", "fg", "fidx", "lh"]).select(*diagonal, "idx", "pos", "n", stretch.alias("stretch"))
    runs = same.groupBy(*diagonal, "stretch").agg(F.min("idx").alias("a"), F.max("idx").alias("z"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.sum("n").alias("words"))
    return runs.where(F.col("words") >= run_words).select("h", "g", "a", "z", "first_pos", "last_pos").distinct()


def _with_first(places: DataFrame, key: str) -> DataFrame:
    """(h, g, fh, fg, shift): every place (d, h, g, idx) of a key that has several, with the first of them."""
    firsts = places.groupBy(key).agg(F.min(F.struct("d", "h", "g", "idx")).alias("first"), F.count("*").alias("times")).where("times > 1")
    pairs = places.join(firsts.select(key, F.col("first.h").alias("fh"), F.col("first.g").alias("fg"), F.col("first.idx").alias("fidx")), key)
    apart = ~((F.col("h") == F.col("fh")) & (F.col("g") == F.col("fg")) & (F.col("idx") == F.col("fidx")))
    return pairs.where(apart).select("h", "g", "fh", "fg", (F.col("idx") - F.col("fidx")).alias("shift")).distinct()


def repeated_runs(lines: DataFrame, run_words: int) -> DataFrame:
    """(h, g, first_pos, last_pos) of the stretches to delete, from a stored line_table()."""
    prints = materialize(lines.where("print is not null").select("print", "d", "h", "g", F.col("print_idx").alias("idx")).distinct(), "prints")
    found = materialize(_extended(_with_first(prints, "print"), lines, run_words), "runs")
    repeated = prints.groupBy("print").agg(F.count("*").alias("times")).where("times > 1").select("print")
    marks = prints.join(repeated, "print").groupBy("h", "g").agg(F.collect_set("print").alias("prints"))
    covers = found.groupBy("h", "g").agg(F.collect_list(F.struct("a", "z")).alias("runs"))
    window = lambda key, a, z, mark: F.struct(F.col(key).alias("key"), F.col(a).alias("idx"), F.col(z).alias("z"), F.col(mark).alias("print"))
    known = lines.select("d", "h", "g", "idx", "on", "on_end", "print", "back", "back_first", "back_print").where("print is not null or back is not null")
    known = known.join(marks.join(covers, ["h", "g"], "left"), ["h", "g"])
    open_to = lambda w: w["key"].isNotNull() & F.array_contains("prints", w["print"]) & ~F.coalesce(F.exists("runs", lambda r: (r["a"] <= w["idx"]) & (w["z"] <= r["z"])), F.lit(False))
    both = F.array(window("on", "idx", "on_end", "print"), window("back", "back_first", "idx", "back_print"))
    left = known.select("d", "h", "g", F.inline(F.filter(both, open_to))).select("key", "d", "h", "g", "idx").distinct()
    # the first window of a key is among them: a run that covers it would stand at a still earlier place, and so would it
    again = _with_first(materialize(left, "windows"), "key")
    return found.union(_extended(again, lines, run_words)).select("h", "g", "first_pos", "last_pos").distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """docs with the text less its later repeated runs, and two columns more: removed_lines and removed_runs
    array<struct<first_pos,last_pos>> (line numbers from 0; runs may overlap); columns of docs with these two names are
    replaced."""
    lines = materialize(line_table(docs, id_col, text_col, gram_words, run_words), "lines")
    runs = repeated_runs(lines, run_words).groupBy("h", "g").agg(F.sort_array(F.collect_list(F.struct("first_pos", "last_pos"))).alias("_runs"))
    copy = F.row_number().over(Window.partitionBy("h", "g").orderBy("h"))
    whole_row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    text = F.col("_row")[text_col]
    keyed = whole_row.select("_row", *_keys(F.col("_row")[id_col], text)).withColumn("_copy", copy)
    split = F.split(text, "\n")
    again = (F.col("_copy") > 1) & (F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")) >= run_words)
    whole = F.array(F.struct(F.lit(0).alias("first_pos"), (F.size(split) - 1).alias("last_pos")))
    found = keyed.join(runs, ["h", "g"], "left").withColumn("_cut", F.when(again, whole).otherwise(F.col("_runs")))
    inside = lambda i: F.exists("_cut", lambda r: (r["first_pos"] <= i) & (i <= r["last_pos"]))
    cut = found.withColumn("_kept", F.when(text.isNotNull() & F.col("_cut").isNotNull(), F.filter(split, lambda line, i: ~inside(i))))
    columns = [F.when(F.col("_kept").isNotNull(), F.array_join("_kept", "\n")).otherwise(text).alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns if c not in ("removed_lines", "removed_runs")]
    removed = F.when(F.col("_kept").isNotNull(), F.size(split) - F.size("_kept")).otherwise(0).cast("long")
    return cut.select(*columns, removed.alias("removed_lines"), F.when(F.col("_kept").isNotNull(), F.col("_cut")).alias("removed_runs"))
