import random
from difflib import SequenceMatcher


from quire.operators import continuations, matching

TOKENS = "doc int, round int, token_index int, page_id string, page_index int, line_id int, line_index int, text string"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_ratio_is_twice_the_common_subsequence():
    r = random.Random(0)
    for _ in range(400):
        a, b = ("".join(r.choice("abé ") for _ in range(r.randint(0, 20))) for _ in range(2))
        assert matching.lcs_length(a, b) == lcs(a, b)
        assert matching.ratio(a, b) == (round(200 * lcs(a, b) / (len(a) + len(b))) if a and b else 0)
    assert matching.ratio(None, "a") == 0 and matching.ratio("abc", "abc") == 100


def test_greedy_takes_the_best_first(spark):
    rows = [(1, 0, 0, 90), (1, 0, 1, 95), (1, 1, 1, 94), (1, 1, 0, 71), (1, 2, 2, 60), (2, 0, 0, 70), (2, 1, 0, 70)]
    scored = spark.createDataFrame(rows, "page int, a int, b int, score int")
    got = sorted(tuple(x) for x in matching.greedy_pairs(scored, "page", "a", "b").collect())
    assert got == [(1, 0, 1, 95), (1, 1, 0, 71), (2, 0, 0, 70)]
    assert {tuple(x) for x in matching.mutual_best(scored, "page", "a", "b").collect()} <= set(got)


def test_lines_are_matched_by_diff_then_likeness(spark):
    schema = "page int, line_no int, text string"
    found = spark.createDataFrame([(1, 0, "same"), (1, 1, "the quick brown fox"), (1, 2, "zzz qqq"), (1, 3, "tail"), (2, 0, "only here")], schema)
    truth = spark.createDataFrame([(1, 0, "same"), (1, 1, "the quick brown fix"), (1, 2, "tail"), (3, 0, "only there")], schema)
    got = sorted(tuple(x) for x in matching.match_lines(found, truth, "page").collect())
    assert got == [(1, 0, 0, 100, "equal"), (1, 1, 1, 95, "similar"), (1, 3, 2, 100, "equal")]
    ops = matching.diff_lines(found, truth, "page").where("page = 1").orderBy("pos").collect()
    assert [tuple(x)[2:] for x in ops] == SequenceMatcher(None, ["same", "the quick brown fox", "zzz qqq", "tail"], ["same", "the quick brown fix", "tail"]).get_opcodes()
    assert [x.text for x in matching.orphans(found, truth, "page").orderBy("text").collect()] == ["only there", "the quick brown fix"]


def test_words_pair_left_to_right():
    assert matching.displaced_words(["a", "x", "c"], ["a", "b", "d", "c"]) == [("equal", 0, 0), ("replace", 1, 1), ("insert", None, 2), ("equal", 2, 3)]


def brute(a, b, policy):
    """Costs of all monotonic alignments, cheapest first."""
    costs = []

    def walk(i, j, cost):
        if i == len(a) and j == len(b):
            costs.append(cost)
            return
        for x, y in [(1, 0), (0, 1), (1, 1), *((1, k) for k in range(2, policy.max_merge + 1)), *((k, 1) for k in range(2, policy.max_merge + 1))]:
            if i + x <= len(a) and j + y <= len(b):
                s, t = "".join(a[i : i + x]), "".join(b[j : j + y])
                walk(i + x, j + y, cost + matching.edit_cost(matching.comparison(s), matching.comparison(t), policy))

    walk(0, 0, 0.0)
    return sorted(costs)


def test_alignment_is_the_cheapest():
    r = random.Random(1)
    policy = matching.Policy()
    for _ in range(60):
        a, b = (["".join(r.choice("ab") for _ in range(r.randint(1, 3))) for _ in range(r.randint(0, 4))] for _ in range(2))
        got, want = matching.align(a, b, policy), brute(a, b, policy)
        assert got["cost"] == want[0]
        assert got["margin"] == (want[1] - want[0] if len(want) > 1 else None)
        used = [(x[1], x[2]) for x in got["best"]], [(x[3], x[4]) for x in got["best"]]
        for spans, n in zip(used, (len(a), len(b)), strict=True):
            assert [i for s, e in spans for i in range(s, e)] == list(range(n))


def test_alignment_quarantine():
    policy = matching.Policy(low_margin=1.0)
    assert matching.align(["Under", "stand"], ["understand"], policy)["best"] == [("sources_to_one", 0, 2, 0, 1)]
    assert matching.align(["Über"], ["über"], policy)["accepted"]
    tie = matching.align(["a"], ["b", "c"], policy)
    assert not tie["accepted"] and "tie" in tie["reasons"]
    small = matching.align(["a"] * 9, ["a"] * 9, matching.Policy(max_states=50))
    assert small["reasons"] == ["state_limit_exhausted"] and len(small["best"]) == 18


def tokens(spark, *lines, rounds=(1,)):
    rows = []
    for r in rounds:
        n = 0
        for page, line, words in lines:
            for w in words.split():
                rows.append((1, r, n, page, int(page[1:]), line, line, w))
                n += 1
    return spark.createDataFrame(rows, TOKENS)


def test_continuation_edges(spark):
    found = tokens(spark, ("p001", 0, "to-* *day is"), ("p001", 1, "some-*"), ("p002", 0, "thing well--*"), ("p004", 0, "a*b c*"))
    got = {x.token_index: x for x in continuations.edges(found, "doc").collect()}
    assert (got[0].boundary, got[0].candidates, got[0].decision) == ("same_line", ["today", "to-day", "to- day"], "ambiguous")
    assert 1 not in got
    assert (got[3].boundary, got[3].left, got[3].right) == ("page", "some-", "thing")
    assert got[5].reason == "nonadjacent_markers"
    assert (got[6].place, got[6].candidates, got[6].decision) == ("inside", ["ab"], "preserve_punctuation")
    assert got[7].reason == "orphan_trailing_marker"


def test_rounds_are_reconciled(spark):
    first = continuations.edges(tokens(spark, ("p001", 0, "to-* day x-* y")), "doc")
    second = continuations.edges(tokens(spark, ("p001", 0, "to-* day x* y z* w")), "doc")
    got = {x.token_index: x.status for x in continuations.reconcile(first, second, ["doc", "token_index"]).collect()}
    assert got == {0: "agreed", 2: "conflict", 4: "second_only"}
    plain = tokens(spark, ("p001", 0, "to-* day a*b *"))
    clean = continuations.surface(plain, continuations.edges(plain, "doc"), "doc").orderBy("token_index")
    assert [x.text for x in clean.collect()] == ["to-", "day", "ab", "*"]


def test_spans_are_cut_at_words(spark):
    spans = spark.createDataFrame([(1, "i", 2, 9)], "page int, label string, start int, end int")
    words = spark.createDataFrame([(1, 0, 0, 3), (1, 1, 4, 8), (1, 2, 9, 12)], "page int, word_no int, token_start int, token_end int")
    got = matching.project_spans(spans, words, "page").orderBy("word_no").select("word_no", "start", "end").collect()
    assert [tuple(x) for x in got] == [(0, 2, 3), (1, 0, 4)]


def test_surface_of_own_edges_needs_no_join(spark):
    import __spark_entry__ as e

    plain = tokens(spark, ("p001", 0, "to-* day a*b * *c"), ("p001", 1, "x-* *y **z* end*"), ("p003", 0, "*w on-*"), rounds=(1, 2))
    joined = continuations.surface(plain, continuations.edges(plain, "doc"), "doc")
    got = continuations.surfaced(plain, "doc").drop("text").withColumnRenamed("clean", "text")
    assert sorted(map(str, got.select(joined.columns).collect())) == sorted(map(str, joined.collect())) and got.where("text = 'ab'").count() == 2
    plan = e.queries()["continuation_surface"](spark, e.SMOKE_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
