"""Small literal cases for the rules that surprise."""

import re

import pytest
from pyspark.sql import functions as F

from screenloom.functions import activity as A
from screenloom.functions import text as T
from screenloom.functions import html as H
from screenloom.functions import web as W
from screenloom.operators import answers, captures, history, joins


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Our market research", "Our market re"),  # no word boundary is asked for
        ("Go to https://a.b/c now please", "Go to now please"),
        ("what , is this!Really?", "what, is this! Really?"),
        ("wait..what then", "wait. . what then"),
        ("short\nab1\n12345678", ""),
        (None, ""),
        ("", ""),
        ("Page 3 of 9 in the book", "in the book"),
        ("a text line\n\n\n   7\nanother line here", "a text line another line here"),
    ],
)
def test_clean_text(spark, text, want):
    got = one(spark, text, T.clean_text)
    assert re.sub(r"  +", " ", got) == want and "\n" not in got


def test_question_words_count_inside_other_words_for_routing_only(spark):
    assert one(spark, "show the list", T.prompt_kind) == "question"
    assert one(spark, "show the list", T.plain_prompt_kind) == "summary"
    assert one(spark, "show the list", T.has_question) is False
    assert one(spark, "I know how.", T.has_question) is True


def test_sentences_and_words(spark):
    assert one(spark, "One. Two!  Three? 7.5 stays", T.sentences) == ["One.", "Two!", "Three?", "7.5 stays"]
    assert one(spark, "  a  b\nc ", T.word_count) == 3 and one(spark, None, T.word_count) == 0


def test_previews(spark):
    assert one(spark, "abc", lambda c: T.preview(c, 3)) == "abc"
    assert one(spark, "abcd", lambda c: T.preview(c, 3)) == "abc..."
    assert one(spark, "abc", lambda c: T.preview(c, 3, True)) == "abc..."


def test_urls_keep_what_follows_them(spark):
    assert one(spark, "see http://a.b/c, and (https://d.e) ok", W.find_urls) == ["http://a.b/c,", "https://d.e)"]


def test_pages(spark):
    html = "<!DOCTYPE html><html><head><script>var t='<a href=\"/no\">'</script></head><body><!-- <a href=\"/no\"> --><a class=x href=\"/a?b=1&amp;c\">A &lt;b&gt;</a></body></html>"
    assert one(spark, html, H.page_links) == ["/a?b=1&c"]
    assert one(spark, html, H.page_text) == "A <b>"
    assert one(spark, html, H.page_title) == "No title"


@pytest.mark.parametrize(
    ("process", "text", "want"),
    [
        ("Chrome.exe", "my gmail", ("Web Browser", "Email")),
        ("chrome.exe", "nothing", ("Web Browser", "Web Browsing")),
        ("Code.exe", "search", ("Development Environment", "Programming")),
        ("winword.exe", "", ("Document Editor", "Document Editing")),
        ("foo.exe", "see www and import", ("Web Content", "General")),
        ("foo.exe", "the variable", ("Source Code", "Programming")),
        ("foo.exe", "a chapter", ("Document", "Reading/Writing")),
        ("foo.exe", "", ("Unknown", "General")),
    ],
)
def test_activity(spark, process, text, want):
    df = spark.createDataFrame([(process, text)], "p string, t string")
    assert tuple(df.select(A.detect_activity(F.col("p"), F.col("t")).alias("a")).select("a.*").first()) == want


def test_intensity_is_strict(spark):
    df = spark.createDataFrame([(50.0, 500_000_000), (50.1, 0), (10.0, 100_000_000), (None, None)], "c double, m long")
    assert [r.x for r in df.select(A.usage_intensity(F.col("c"), F.col("m")).alias("x")).collect()] == ["medium", "high", "low", "low"]


def test_merged_lines_and_stop(spark):
    rows = [(1, "s", "a\n b \n\na"), (2, "s", "b\nTarget x\nc"), (3, "s", "d")]
    df = spark.createDataFrame(rows, "capture_id long, source string, text string")
    assert [r.line for r in captures.merged_lines(df).orderBy("line_idx").collect()] == ["a", "b", "Target x", "c", "d"]
    assert [r.capture_id for r in captures.until_text(df, "target").orderBy("capture_id").collect()] == [1, 2]
    hit = captures.search_lines(df, "TARGET").first()
    assert (hit.line_idx, hit.context) == (2, "a\nb\nTarget x\nc")


def test_similarity(spark):
    rows = [(1, 0, [1.0, 2.0, 3.0]), (1, 1, [2.0, 4.0, 6.0]), (1, 2, [3.0, 2.0, 1.0]), (1, 3, [5.0, 5.0, 5.0]), (1, 4, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "seq_id long, position int, vec array<double>")
    assert [r.similarity for r in captures.similarity_to_previous(df).orderBy("position").collect()] == [0.0, 1.0, -1.0, 0.0, 0.0]
    assert [r.position for r in captures.until_stop(df).orderBy("position").collect()] == [0, 1]


@pytest.mark.parametrize("n", [1, 20, 21, 22, 26, 27, 50])
def test_bounded_history_against_a_list(spark, n):
    held, kept_at = [], []
    for k in range(n):
        held.append(k)
        if len(held) % 2 == 0:
            kept_at.append(k)
        if len(held) > 20:
            held = held[-15:]
    df = spark.createDataFrame([(7, k, k) for k in range(n)], "user_id long, ts_s long, id long")
    assert sorted(r.id for r in history.bounded(df, "user_id").collect()) == held
    assert sorted(r.id for r in history.every_2nd(df, "user_id").collect()) == kept_at


def test_cooldown(spark):
    rows = [(1, 1, 0, "q"), (2, 1, 4, ""), (3, 1, 5, " "), (4, 1, 6, "q"), (5, 1, 8, "q"), (6, 2, 6, ""), (7, 2, 7, "q")]
    df = spark.createDataFrame(rows, "question_id long, user_id long, ts_s long, question string")
    got = {r.question_id: (r.status, r.remaining) for r in history.cooldown(df, 5).collect()}
    assert got == {1: ("accepted", 0), 2: ("wait", 1), 3: ("ignored", 0), 4: ("accepted", 0), 5: ("wait", 3), 6: ("ignored", 0), 7: ("accepted", 0)}


def test_answers(spark):
    text = "lost\nQ: is a header:\n\nMain:\nQ1: one? two\nQuite plain\nA1: yes: sure\nA2: no\nfigure 7\nplain\n•  bullet\nEmpty:\nLast:\nx"
    df = spark.createDataFrame([(1, text)], "response_id long, response_text string")
    got = [(r.section, r.kind, r.out) for r in answers.formatted_lines(df).orderBy("line_no").collect()]
    assert got == [
        ("MAIN", "question", "Q: one? two\nA: yes: sure"), ("MAIN", "question", "Q: Quite plain\nA: yes: sure"), ("MAIN", "stat", "📊 figure 7"),
        ("MAIN", "paragraph", "plain"), ("MAIN", "bullet", "• bullet"), ("LAST", "paragraph", "x"),
    ]
    qa = answers.extract_qa(df).first()
    assert qa.questions == ["is a header:", "one? two", "Quite plain"] and qa.answers == ["yes: sure", "no"]


def test_asof_takes_a_capture_of_the_same_second(spark):
    q = spark.createDataFrame([(1, 1, 10, "q"), (2, 1, 4, "q")], "question_id long, user_id long, ts_s long, question string")
    c = spark.createDataFrame([(1, 1, 10, "now"), (2, 1, 5, "before"), (3, 2, 1, "other")], "capture_id long, user_id long, ts_s long, text string")
    assert {r.question_id: r.context for r in joins.asof_context(q, c).collect()} == {1: "now", 2: None}


def test_json_records(spark):
    rows = [(1, '{"summary": "s", "confidence_score": 0.29}'), (2, "no json"), (3, '{"summary": "cut'), (4, "{}")]
    df = spark.createDataFrame(rows, "response_id long, body string").select("*", F.lit(1).alias("conv_id"), F.lit(1).alias("turn"), F.lit(1).alias("ts_s"))
    got = {r.response_id: r for r in answers.model_answers(df).collect()}
    assert (got[1].summary, got[1].confidence, got[1].action_suggestions) == ("s", 0.29, [])
    assert (got[2].summary, got[2].confidence) == ("no json", 0.7) and got[3].confidence == 0.7
    assert (got[4].summary, got[4].confidence) == ("", 0.5)
    assert answers.text_analysis(df).filter("response_id = 2").first().main_topics == ["general"]


def test_combined_lines_are_rows_and_one_string_is_refused_by_size(spark):
    rows = [(1, "s", "a\n b "), (2, "s", "b\nc"), (1, "t", " \n"), (2, "t", None)]
    df = spark.createDataFrame(rows, "capture_id long, source string, text string")
    got = {s: [r.line for r in captures.combined_lines(df).filter(F.col("source") == s).orderBy("position").collect()] for s in "st"}
    assert got == {"s": ["a", " b ", "--- scrolled content ---", "a", "b", "c"], "t": [" ", ""]}
    assert {r.source: r.combined for r in captures.combined_text(df).collect()} == {s: "\n".join(x) for s, x in got.items()}
    with pytest.raises(ValueError, match="s \\(.* bytes\\)"):
        captures.combined_text(df, most=20)


def test_alignment_searches_whole_scenes_without_collecting_a_user(spark):
    topics = [(1, "Art"), (1, "machine learn"), (1, "a.b?"), (1, "none"), (1, None), (2, "x"), (3, "é😀"), (3, "two  s"), (3, "y z"), (4, "q"), (5, "a b  c d"), (5, "b c")]
    scenes = [(1, 1, "the cart " + "long " * 99 + "see a.b?c"), (1, 2, "Machine learning"), (2, 3, None), (3, 4, "sé😀x two  spaces"), (3, 5, "xy zz"), (5, 7, ""), (5, 6, "a b"), (5, 8, "c de")]
    t = spark.createDataFrame(topics, "user_id long, topic string")
    s = spark.createDataFrame(scenes, "user_id long, input_id long, scene_description string")
    out = joins.alignment(t, s)
    assert {r.user_id: (r.topics, r.alignment) for r in out.collect()} == {1: (5, 0.6), 2: (1, 0.0), 3: (3, 1.0), 5: (2, 0.5)}
    out = joins.alignment(t.filter("topic NOT LIKE '% %'"), s)
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
    texts = spark.createDataFrame([(1, 1, "a b c fourth")], "user_id long, input_id long, text string")
    assert [r.topic for r in joins.topics(texts, None).collect()] == ["a", "b", "c", "fourth"]


def test_places_of_inputs_are_numbered_in_ranges(spark):
    rows = [(k, 1, 1 + k % 3, "a b", None, None) for k in range(50)]
    df = spark.createDataFrame(rows, "input_id long, user_id long, priority int, text string, scene_description string, context_process string")
    out = joins.combine_modalities(df)
    assert [r.input_id for r in out.orderBy("place").collect()] == sorted(range(50), key=lambda k: (k % 3, k))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert all("_range#" in line for line in plan.splitlines() if "row_number()" in line)


def test_attribute_values_in_any_quotes_and_null_texts(spark):
    from pyspark.sql import functions as F

    from screenloom.functions import text as T
    from screenloom.functions import web as W

    html = """<a href="a?x=1&amp;y=2">1</a><A class=b HREF = 'c'>2</A><a href=d>3</a><a data-href="no" href="e">4</a><img alt='' src='f.png'/><!--<a href="g">-->"""
    row = spark.createDataFrame([(html, None)], "html string, text string")
    got = row.select(H.page_links(F.col("html")).alias("l"), H.page_images(F.col("html")).alias("i"), W.is_web(F.col("text")).alias("w"), T.prompt_kind(F.col("text")).alias("k")).first()
    assert (got.l, got.i, got.w, got.k) == (["a?x=1&y=2", "c", "d", "e"], ["f.png"], False, "summary")
