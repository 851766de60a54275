"""From lines to reading order: row blocks, bands, columns, paragraphs, roles, drop caps, word preservation.

All steps are windows and aggregations partitioned by page; a step takes lines (page, l, t, r, b, text, n_words) and
adds columns, so that Catalyst can share one shuffle by page among them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.geometry import Box, domain, interval_overlap

ORDER = ["t", "l"]
# When spacing counts as even, which left edges are the body's, the indent of pages that show none, and the
# marks that may stand at a word's end.
EVEN_LEAST, EVEN_SHARE = 1.0, 0.65
LEFT_SHARE, LEFT_SLACK, USUAL_INDENT = 0.30, 0.02, 0.03
CLOSING = r"""[.,;:!?'"\-)]+$"""


def page_metrics(words: DataFrame, page: str, width: Column | None = None, height: Column | None = None) -> DataFrame:
    """Medians of word sizes, extreme edges, counts, and the domain of the coordinates."""
    box = Box.of()
    found = words.groupBy(page).agg(
        F.median(box.width).alias("median_word_w"), F.median(box.height).alias("median_word_h"),
        F.min("t").alias("top"), F.max("b").alias("bottom"), F.max("r").alias("right"), F.count("*").alias("n_words"),
    )
    largest = F.greatest("right", "bottom")
    return found.withColumn("coord_w", domain(largest, width if width is not None else F.col("right"))).withColumn("coord_h", domain(largest, height if height is not None else F.col("bottom")))


def vertical_gaps(lines: DataFrame, page: str, keys: list[str]) -> DataFrame:
    """lines with gap, the space to the next line below (0 if they overlap, null for the last)."""
    order = Window.partitionBy(page).orderBy(*ORDER, *keys)
    below = F.lead("t").over(order)
    return lines.withColumn("gap", F.when(below.isNotNull(), F.greatest(below - F.col("b"), F.lit(0.0))))


def gaps_consistent(lines: DataFrame, page: str, keys: list[str]) -> DataFrame:
    """(page, n_gaps, median_gap, spread, consistent): whether a page's lines are evenly spaced, of pages with a gap; one
    gap alone tells nothing."""
    found = vertical_gaps(lines, page, keys).where("gap is not null").groupBy(page).agg(F.count("*").alias("n_gaps"), F.median("gap").alias("median_gap"), F.stddev_pop("gap").alias("spread"))
    even = F.col("spread") <= F.greatest(F.lit(EVEN_LEAST), EVEN_SHARE * F.greatest("median_gap", F.lit(1.0)))
    return found.withColumn("consistent", (F.col("n_gaps") >= 2) & even)


def uncovered_blocks(members: DataFrame, page: str, block: str, word: list[str]) -> DataFrame:
    """(page, block) of blocks that hold a word which no earlier block holds, from a row per block and word.  A block without
    words, a row whose word is null, stays as well."""
    empty = F.when(F.coalesce(*[F.col(c).cast("string") for c in word]).isNull(), F.col(block))
    first = members.withColumn("_empty", empty).groupBy(page, *word, "_empty").agg(F.min(block).alias(block))
    return first.select(page, block).distinct()


def indent_signature(lines: DataFrame, page: str, paragraph: str, keys: list[str], skipped: Column | None = None) -> DataFrame:
    """(page, body_left, standard_indent) of lines in units of the page's width: the middle of the leftmost third of the
    left edges, and the middle indent of first lines of paragraphs whose other lines keep to that edge.
    Skipped lines (side notes, verse and the like) don't count; a page of nothing else has no row."""
    if skipped is not None:
        lines = lines.where(~F.coalesce(skipped, F.lit(False)))
    middle = lambda values: F.element_at(values, (F.floor(F.size(values) / 2) + 1).cast("int"))
    lefts = lines.groupBy(page).agg(F.sort_array(F.collect_list("l")).alias("_all"))
    edge = F.slice("_all", F.lit(1), F.greatest(F.lit(1), F.floor(F.size("_all") * LEFT_SHARE).cast("int")))
    lefts = lefts.select(page, middle(edge).alias("body_left"))
    rows = lines.groupBy(page, paragraph).agg(F.min(F.struct(*keys, "l")).alias("_first"), F.collect_list(F.struct(*keys, "l")).alias("_lines"))
    rest = F.sort_array(F.transform(F.filter("_lines", lambda x: x != F.col("_first")), lambda x: x["l"]))
    rows = rows.select(page, F.col("_first.l").alias("_l"), rest.alias("_rest")).where(F.size("_rest") > 0).join(lefts, page)
    keeps = (F.abs(middle(F.col("_rest")) - F.col("body_left")) <= LEFT_SLACK) & (F.col("_l") > middle(F.col("_rest")))
    indents = rows.where(keeps).groupBy(page).agg(F.sort_array(F.collect_list(F.col("_l") - middle(F.col("_rest")))).alias("_indents"))
    return lefts.join(indents, page, "left").select(page, "body_left", F.coalesce(middle(F.col("_indents")), F.lit(USUAL_INDENT)).alias("standard_indent"))


def cap_letters(words: DataFrame, lexicon: DataFrame, word: str = "word") -> DataFrame:
    """words with cap, the one capital that makes a word of the lexicon (column word) when set before; null if none or
    several do.  Both sides meet by the rest of the word, so no word is tried against all letters."""
    known = lexicon.select(F.upper("word").alias("_word")).distinct().where(F.col("_word").rlike("^[A-Z]."))
    known = known.groupBy(F.expr("substring(_word, 2)").alias("_rest")).agg(F.count("*").alias("_n"), F.min(F.left("_word", F.lit(1))).alias("cap")).where("_n = 1").drop("_n")
    return words.withColumn("_rest", F.regexp_replace(F.upper(F.trim(word)), CLOSING, "")).join(known, "_rest", "left").drop("_rest")


def row_blocks(lines: DataFrame, page: str, keys: list[str]) -> DataFrame:
    """lines with block, from 0: a new one where the space above is large for the page, unless the two lines are side
    by side."""
    whole = Window.partitionBy(page)
    order = whole.orderBy("t", *keys)
    before = lambda c: F.lag(c).over(order)
    height = F.col("b") - F.col("t")
    spaced = lines.withColumn("_space", F.when(before("b").isNotNull(), F.greatest(F.col("t") - before("b"), F.lit(0.0)))).withColumn("_shared", interval_overlap(F.col("l"), F.col("r"), before("l"), before("r")))
    limit = 0.2 * F.avg(height).over(whole) + F.greatest(F.coalesce(0.75 * F.stddev_pop("_space").over(whole), F.lit(0.0)), 0.025 * F.median(height).over(whole))
    broken = spaced.withColumn("_new", ((F.col("_space") > limit) & (F.col("_shared") > 0)).cast("int"))
    return broken.withColumn("block", F.sum(F.coalesce("_new", F.lit(0))).over(order)).drop("_space", "_shared", "_new")


def bands(lines: DataFrame, metrics: DataFrame, page: str, keys: list[str], band: float = 1.5, near: float = 0.12, gap: float = 0.7) -> DataFrame:
    """lines with band 'header', 'footer' or 'body': thin bands at the page's edges with a visible gap to the rest."""
    # fixed values: a band's height and the gap in heights of words, and the share of the page that is its edge (1.5, 0.7, 0.12)
    whole = Window.partitionBy(page)
    h = F.col("median_word_h")
    found = lines.join(metrics.select(page, "median_word_h", "coord_h"), page)
    top = F.min("t").over(whole)
    found = found.withColumn("_in", (top <= near * F.col("coord_h")) & (F.col("t") <= top + band * h) & (F.col("b") <= top + band * h + 0.5 * h))
    rest = F.min(F.when(~F.col("_in"), F.col("t"))).over(whole) - F.max(F.when(F.col("_in"), F.col("b"))).over(whole)
    found = found.withColumn("_head", F.col("_in") & F.coalesce(rest >= gap * h, F.lit(True)))
    body = F.when(~F.col("_head"), True)
    low = F.max(F.when(body, F.col("b"))).over(whole)
    found = found.withColumn("_in", F.coalesce(body & (low >= (1 - near) * F.col("coord_h")) & (F.col("b") >= low - band * h) & (F.col("t") >= low - band * h - 0.5 * h), F.lit(False)))
    rest = F.min(F.when(F.col("_in"), F.col("t"))).over(whole) - F.max(F.when(body & ~F.col("_in"), F.col("b"))).over(whole)
    kind = F.when(F.col("_head"), "header").when(F.col("_in") & F.coalesce(rest >= gap * h, F.lit(True)), "footer").otherwise("body")
    return found.withColumn("band", kind).drop("_in", "_head", "median_word_h", "coord_h")


def paragraphs(lines: DataFrame, page: str, keys: list[str]) -> DataFrame:
    """lines with paragraph, from 0.  Rules over a line and the one before, in order: two narrow lines close together in
    one band stay together; so does a return to the margin after a wrap, and a lower-case continuation; else a short
    end or an indent begins a paragraph."""
    whole = Window.partitionBy(page)
    order = whole.orderBy(*keys)
    width, height = F.col("r") - F.col("l"), F.col("b") - F.col("t")
    mid = {n: F.median(x).over(whole) for n, x in (("w", width), ("h", height), ("l", F.col("l")), ("r", F.col("r")))}
    measured = lines.where(F.trim("text") != "").select("*", *[x.alias(f"_{n}") for n, x in mid.items()])
    before = lambda c: F.lag(c).over(order)
    slack, band = 0.02 * F.col("_w"), 0.04 * F.col("_w")
    narrow = 0.78 * F.col("_w")
    close, space = 0.75 * F.col("_h"), F.greatest(F.col("t") - before("b"), F.lit(0.0))
    ends = before("r") <= F.col("_r") - 0.15 * F.col("_w")
    starts = F.col("l") >= F.col("_l") + slack
    was_narrow, is_narrow = before(width) <= narrow, width <= narrow
    together = was_narrow & is_narrow & (F.abs(F.col("l") - before("l")) <= band) & (space <= close)
    returns = was_narrow & (before("l") > F.col("_l") + 0.5 * band) & (F.abs(F.col("l") - F.col("_l")) <= band) & (width >= 0.85 * F.col("_w")) & (space <= 0.8 * F.col("_h"))
    last, first = F.right(F.rtrim(before("text")), F.lit(1)), F.left(F.ltrim("text"), F.lit(1))
    continues = first.rlike(r"^\p{Ll}") & ~last.isin(".", "!", "?", ";", ":") & (space <= close) & ~starts
    new = F.when(together | returns | continues, 0).when(ends | starts, 1).otherwise(0)
    return measured.withColumn("_new", F.when(before("l").isNull(), 0).otherwise(new)).withColumn("paragraph", F.sum("_new").over(order)).drop("_new", *[f"_{n}" for n in mid])


def column_split(lines: DataFrame, page: str, keys: list[str], width: Column, gap: float = 0.10, spread: float = 0.08) -> DataFrame:
    """(page, split_x, n_left, n_right) of pages whose lines' left edges fall in two tight groups with a clear gutter."""
    whole = Window.partitionBy(page)
    order = whole.orderBy("l", *keys)
    cut = F.struct((F.lead("l").over(order) - F.col("l")).alias("gap"), (-F.row_number().over(order)).alias("first"), ((F.col("l") + F.lead("l").over(order)) / 2).alias("at"))
    marked = lines.withColumn("_cut", cut).withColumn("_best", F.max(F.when(F.col("_cut.gap").isNotNull(), F.col("_cut"))).over(whole)).withColumn("_count", F.count("*").over(whole))
    left = F.col("l") <= F.col("_best.at")
    sums = marked.where(F.col("_count") >= 4).withColumn("_width", width).groupBy(page).agg(
        F.first("_best.at").alias("split_x"), F.first("_best.gap").alias("gap"), F.max("_width").alias("width"),
        F.count_if(left).alias("n_left"), F.count_if(~left).alias("n_right"),
        F.stddev_pop(F.when(left, F.col("l"))).alias("sl"), F.stddev_pop(F.when(~left, F.col("l"))).alias("sr"),
        F.max(F.when(left, F.col("r"))).alias("edge"), F.min(F.when(~left, F.col("l"))).alias("next"),
    )
    w = F.col("width")
    good = (F.col("gap") >= gap * w) & (F.col("n_left") >= 2) & (F.col("n_right") >= 2) & (F.col("sl") <= spread * w) & (F.col("sr") <= spread * w) & (F.col("edge") < F.col("next"))
    return sums.where(good).select(page, "split_x", "n_left", "n_right")


def classify(blocks: DataFrame, page: str) -> DataFrame:
    """blocks with role, from columns n_lines, l, t, r, b, median_width, median_left, right_spread (of the lines), and of
    the page: coord_w, coord_h, body_left, body_right, page_line_width, first_t, last_b, line_height."""
    few, w, h = F.col("n_lines") <= 3, F.col("coord_w"), F.col("coord_h")
    thin = (F.col("page_line_width") > 0) & (F.col("n_lines") >= 2) & (F.col("median_width") < 0.75 * F.col("page_line_width")) & (F.col("median_left") > F.col("body_left") + 0.03 * w)
    role = (
        F.when(few & (F.col("t") < 0.12 * h) & (F.col("t") <= F.col("first_t") + 1.5 * F.col("line_height")), "page header")
        .when(few & (F.col("b") > 0.88 * h) & (F.col("b") >= F.col("last_b") - 1.5 * F.col("line_height")), "page footer")
        .when(F.col("r") < F.col("body_left") - 0.02 * w, "sidenote left")
        .when(F.col("l") > F.col("body_right") + 0.02 * w, "sidenote right")
        .when(thin & (F.col("right_spread") > 0.05 * w), "poetry")
        .when(thin, "blockquote")
        .otherwise("body")
    )
    return blocks.withColumn("role", role)


def block_measures(lines: DataFrame, page: str, block: str = "block") -> DataFrame:
    """What classify() reads, from lines with a block column."""
    width, height = F.col("r") - F.col("l"), F.col("b") - F.col("t")
    blocks = lines.groupBy(page, block).agg(
        F.count("*").alias("n_lines"), F.min("l").alias("l"), F.min("t").alias("t"), F.max("r").alias("r"), F.max("b").alias("b"),
        F.median(width).alias("median_width"), F.median("l").alias("median_left"), F.stddev_pop("r").alias("right_spread"),
    )
    pages = lines.groupBy(page).agg(F.max("r").alias("coord_w"), F.max("b").alias("coord_h"), F.median(width).alias("page_line_width"), F.min("t").alias("first_t"), F.max("b").alias("last_b"), F.avg(height).alias("line_height"))
    extent = blocks.groupBy(page).agg(F.median("l").alias("body_left"), F.median("r").alias("body_right"))
    return blocks.join(pages, page).join(extent, page)


def block_quality(lines: DataFrame, page: str, keys: list[str]) -> DataFrame:
    """(page, quality): lower is cleaner; short lines, lone words and jumps back up count against it."""
    return lines.withColumn("_back", _jumps_back(Window.partitionBy(page), keys)).groupBy(page).agg(_score("_back", lambda c: c).alias("quality"))


def qualities(lines: DataFrame, page: str, blocks: dict[str, list[str]]) -> DataFrame:
    """lines with block_quality() of their page, under each name, by lines that have the first of the name's keys."""
    for name, keys in blocks.items():
        has = Window.partitionBy(page, "_has")
        lines = lines.withColumn("_has", F.col(keys[0]).isNotNull())
        lines = lines.withColumn("_back", _jumps_back(has, keys)).withColumn("_score", F.when(F.col("_has"), _score("_back", lambda c, w=has: c.over(w))))
        lines = lines.withColumn(name, F.max("_score").over(Window.partitionBy(page))).drop("_has", "_back", "_score")
    return lines


def _jumps_back(whole, keys: list[str]) -> Column:
    return F.col("t") < F.lag("t").over(whole.orderBy(*keys)) - F.greatest(0.5 * F.median(F.col("b") - F.col("t")).over(whole), F.lit(1e-6))


def _score(back: str, of) -> Column:
    short, lone, back = (of(F.count_if(c)) for c in (F.length(F.trim("text")) <= 2, F.col("n_words") <= 1, F.col(back)))
    return 6.0 * short + 2.5 * lone + 15.0 * back + F.when(of(F.sum("n_words")) / of(F.count("*")) < 2, 3.0).otherwise(0.0)


def caption_prefix(words: DataFrame, page: str, line: list[str], width: Column) -> DataFrame:
    """(page, line, split_word): the first word after a gap that is wide for the line's words."""
    group = Window.partitionBy(page, *line)
    gap = F.col("l") - F.lag("r").over(group.orderBy("word_no"))
    found = words.withColumn("_gap", gap).withColumn("_h", F.avg(F.col("b") - F.col("t")).over(group))
    return found.where(F.col("_gap") > F.greatest(1.8 * F.col("_h"), 0.008 * width)).groupBy(page, *line).agg(F.min("word_no").alias("split_word"))


def drop_caps(words: DataFrame, page: str, line: list[str], tall: float = 1.8) -> DataFrame:
    """Words of one or two letters that are tall for their page, with the word at their right that they belong to."""
    # fixed value: a letter is tall from 1.8 times the middle height on
    height = F.col("b") - F.col("t")
    nearest = Window.partitionBy(page, *line).orderBy("l", "word_no")
    ready = words.withColumn("_mid", F.median(height).over(Window.partitionBy(page))).withColumn("next_word", F.lead("word").over(nearest))
    return ready.where((height >= tall * F.col("_mid")) & (F.length("word") <= 2) & F.col("next_word").isNotNull()).drop("_mid")


def word_signature() -> Column:
    """What must survive reordering: the text and the box to four places."""
    return F.struct(F.col("word"), *[F.bround(c, 4).alias(c) for c in "ltrb"])


def dropped_words(before: DataFrame, after: DataFrame, page: str) -> DataFrame:
    """The multiset of words of before that after lacks, blank ones aside: the k-th of equal words stays if after has k.  Both
    sides meet by page and word, so that frames dealt by page stay in place; words of no page are few and meet as sets."""
    kept = lambda df: df.where((F.trim("word") != "") & F.col("l").isNotNull()).select(page, "word", *[F.bround(c, 4).alias(c) for c in "ltrb"])
    numbered = lambda df: kept(df.where(F.col(page).isNotNull())).withColumn("_k", F.row_number().over(Window.partitionBy(page, "word", *"ltrb").orderBy("word")))
    a, b = numbered(before), numbered(after).withColumnsRenamed({c: f"_{c}" for c in (page, "word", *"ltrb")}).withColumnRenamed("_k", "_n")
    same = (F.col(page) == F.col(f"_{page}")) & (F.col("word") == F.col("_word")) & (F.col("_k") == F.col("_n"))
    for c in "ltrb":
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    left = a.join(b, same, "left_anti").drop("_k")
    return left.unionByName(kept(before.where(F.col(page).isNull())).exceptAll(kept(after.where(F.col(page).isNull()))))


def recover(after: DataFrame, before: DataFrame, page: str) -> DataFrame:
    """after and what it dropped, the latter marked recovered."""
    cols = [page, "word", *"ltrb"]
    return after.select(*cols, F.lit(False).alias("recovered")).unionByName(dropped_words(before, after, page).withColumn("recovered", F.lit(True)))


def reading_order(lines: DataFrame, page: str, keys: list[str]) -> DataFrame:
    """The whole pipeline over lines: bands, row blocks of the body, roles, and the place of each line from 0."""
    metrics = lines.groupBy(page).agg(F.median(F.col("b") - F.col("t")).alias("median_word_h"), F.max("b").alias("coord_h"))
    banded = bands(lines, metrics, page, keys)
    blocks = row_blocks(banded.withColumn("_band", F.when(F.col("band") == "header", 0).when(F.col("band") == "body", 1).otherwise(2)), page, keys)
    roles = classify(block_measures(blocks, page), page).select(page, "block", "role")
    order = Window.partitionBy(page).orderBy("_band", "block", *ORDER, *keys)
    return blocks.join(roles, [page, "block"]).withColumn("place", F.row_number().over(order) - 1).drop("_band")
