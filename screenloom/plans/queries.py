"""The registered queries: each runs one operator over its whole input table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenloom.functions import activity as A
from screenloom.functions import text as T
from screenloom.functions import web as W
from screenloom.operators import answers, captures, history, joins, log, text, web
from screenloom.plans.streams import run_to_table
from screenloom.sources import sinks
from screenloom.sources.shared import fresh_dir
from screenloom.sources.tables import read_log, view
from screenloom.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Parameters of the registered searches.
APP, TERM, TARGET, COOLDOWN = "Code.exe", "search", "video", 86400


def over(*views: str):
    """Registers a function of some views under its own name."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*[view(spark, sf_dir, v) for v in views])
        return f

    return register


def joined(column: str, sep: str = "|"):
    return F.array_join(column, sep).alias(column)


# --- scans and sinks


@over("actions")
def scan_log(actions):
    return actions


@over("actions")
def append_action(actions):
    return sinks.action_rows(actions)


@over("captures")
def store_context(rows):
    out = sinks.context_rows(rows.withColumn("urls", W.find_urls(F.col("text"))))
    meta = F.from_json("metadata", "memory_usage long, cpu_percent double")
    return out.withColumn("m", meta).select(
        "capture_id", "timestamp", "process_name", "window_title", "content_summary", "full_content", "m.memory_usage", "m.cpu_percent"
    )


@over("responses")
def report_lines(rows):
    return answers.report_lines(rows)


@over("responses")
def report_lines_all(rows):
    return answers.report_lines(rows, last=None)


@over("responses", "notes")
def report_with_notes(rows, notes):
    return answers.report_lines(rows, notes=notes)


# --- text


@over("captures")
def clean_text(rows):
    return rows.select("capture_id", T.clean_text(F.col("text")).alias("cleaned"))


@over("captures")
def clean_lines(rows):
    return rows.select("capture_id", T.clean_lines(F.col("text")).alias("cleaned"))


@over("captures")
def split_sentences(rows):
    return text.sentence_rows(rows)


@over("captures")
def word_count(rows):
    return rows.select("capture_id", T.word_count(F.col("text")).alias("words"), F.length("text").cast("long").alias("chars"))


@over("captures")
def has_questions(rows):
    return rows.filter(T.has_question(T.clean_text(F.col("text")))).select("capture_id")


@over("captures")
def extract_questions(rows):
    return text.question_rows(rows)


@over("captures")
def process_text(rows):
    return text.process_text(rows).withColumn("sentences", F.size("sentences").cast("long"))


@over("captures")
def corpus_text_stats(rows):
    return text.text_stats(rows)


@over("captures")
def route_prompt(rows):
    return rows.select("capture_id", T.prompt_kind(F.col("text")).alias("kind"), T.plain_prompt_kind(F.col("text")).alias("older_kind"))


@over("captures")
def capture_outcome(rows):
    return text.outcomes(rows)


@over("captures")
def build_prompt(rows):
    return text.prompts(rows)


@over("captures")
def activity_prompt(rows):
    return text.activity_prompts(rows)


@over("captures")
def preview(rows):
    return rows.select("capture_id", T.preview(F.col("text"), 150).alias("short"), T.preview(F.col("text"), 500, True).alias("always"))


# --- web


@over("web_pages")
def extract_page(pages):
    return web.extract_pages(pages).select("page_id", "url", "title", "text_content", joined("links", "\n"), joined("images", "\n"), "success", "error")


@over("web_pages")
def page_links(pages):
    return web.link_rows(pages)


@over("captures")
def find_urls(rows):
    return web.url_rows(rows)


@over("captures")
def is_web_content(rows):
    is_web = W.is_web(F.col("text"))
    return rows.select("capture_id", is_web.alias("is_web"), F.when(is_web, "web_browser").otherwise("unknown").alias("content_type"))


@over("captures")
def content_categories(rows):
    return rows.select("capture_id", F.posexplode(W.categories(F.col("text"))).alias("pos", "category"))


@over("captures")
def analyze_web(rows):
    # one capture in thirteen stands for those that failed
    return web.analyze_web(rows, F.expr("capture_id % 13 <> 5")).withColumns({"urls": F.array_join("urls", "|"), "categories": F.array_join("categories", "|")})


@over("captures")
def category_counts(rows):
    return web.category_counts(rows)


@over("captures", "web_pages")
def first_url_page(rows, pages):
    return web.enrich_first_url(rows, pages)


# --- ordered captures


@over("frames")
def similarity_to_previous(frames):
    return captures.similarity_to_previous(frames)


@over("frames")
def capture_until_stop(frames):
    return captures.until_stop(frames, most=10)


@over("captures")
def capture_until_text(rows):
    return captures.until_text(rows, TARGET).select("source", "capture_id")


@over("frames")
def content_structure(frames):
    return captures.structure(frames)


@over("frames")
def capture_confidence(frames):
    return captures.frame_confidence(frames)


@over("captures")
def merge_text(rows):
    return captures.merged_lines(rows)


@over("captures")
def combine_capture_text(rows):
    return captures.combined_text(rows)


@over("captures")
def combine_capture_lines(rows):
    return captures.combined_lines(rows)


@over("captures")
def line_search(rows):
    return captures.search_lines(rows, TERM)


@over("captures")
def line_search_all(rows):
    return captures.search_lines(rows, TERM, stop_at_hit=False)


@over("captures")
def search_context(rows):
    return captures.search_contexts(rows, TERM)


# --- log and classification


@over("actions")
def recent_actions(actions):
    return log.recent_actions(actions, APP)


@over("actions")
def recent_actions_all(actions):
    return log.top_n_per_key(actions).select("application", "rn", "id", "ts_s", "description")


@over("captures", "actions")
def attach_recent_actions(rows, actions):
    return log.attach_recent(rows, actions).select("capture_id", "process_name", joined("recent"))


@over("captures")
def context_history(rows):
    now = rows.agg(F.max("ts_s")).first()[0] or 0
    return log.history(rows, now).select("capture_id", "ts_s", "process_name")


@over("captures")
def app_family(rows):
    return rows.select("capture_id", A.app_family(F.col("process_name")).alias("family"))


@over("captures")
def app_category(rows):
    return rows.select("capture_id", A.app_category(F.col("process_name")).alias("category"))


@over("captures")
def usage_intensity(rows):
    return rows.select("capture_id", A.usage_intensity(F.col("cpu_percent"), F.col("memory_usage")).alias("intensity"))


@over("captures")
def app_capabilities(rows):
    return log.capability_rows(rows)


@over("actions")
def classify_activity(actions):
    return log.classify_actions(actions)


@over("captures")
def detect_activity(rows):
    return log.activities(rows).select("capture_id", "content_type", "activity_type")


@over("captures")
def productivity_score(rows):
    return log.activities(rows).select("capture_id", A.productivity_score(F.col("activity_type")).alias("score"))


@over("captures")
def time_period(rows):
    return rows.groupBy(A.time_period(F.col("ts_s")).alias("period")).agg(F.count(F.lit(1)).alias("n"))


@over("captures")
def suggestions(rows):
    return log.analyses(rows).select("capture_id", joined("suggestions"), "reading_minutes")


@over("captures")
def analyze_context(rows):
    return log.analysis_text(rows)


@over("captures")
def key_lines(rows):
    return log.analysis_text(rows).select("capture_id", log.key_lines(F.col("analysis")).alias("k")).select("capture_id", "k.*")


@over("captures")
def session_summary(rows):
    return log.session_summary(rows)


@over("captures")
def context_counts(rows):
    return log.context_counts(rows)


@over("responses")
def insight_gate(rows):
    return log.insights(rows).select("response_id")


# --- joins


@over("questions", "captures")
def question_context(questions, rows):
    return joins.asof_context(questions, rows).select("question_id", "user_id", "ts_s", "context")


@over("modal_inputs", "modal_answers", "captures", "actions")
def combine_modalities(inputs, found, rows, actions):
    by_input = lambda analyses: analyses.withColumnRenamed("response_id", "input_id")
    contexts = joins.context_insights(rows, actions).withColumnRenamed("capture_id", "input_id")
    out = joins.combine_modalities(inputs, by_input(answers.text_analysis(found)), by_input(answers.image_analysis(found)), contexts)
    return out.select(
        *[c for c in out.columns if not c.endswith("_analysis")], F.array_join("text_analysis.main_topics", "|").alias("main_topics"), F.col("text_analysis.sentiment"),
        F.col("text_analysis.error").alias("text_error"), F.col("image_analysis.scene_description").alias("scene_seen"), "image_analysis.visual_context",
        "context_analysis.application.usage_intensity", "context_analysis.behaviour",
    )


@over("modal_inputs")
def content_alignment(inputs):
    return joins.alignment(joins.topics(inputs), inputs)


@over("captures", "actions")
def context_insights(rows, actions):
    out = joins.context_insights(rows, actions)
    return out.select("capture_id", "application.app_type", "application.usage_intensity", F.array_join("application.capabilities", "|").alias("capabilities"), "behaviour")


# --- histories


@over("actions")
def last_n(actions):
    return history.last_n(actions, "user_id").select("user_id", "id")


@over("model_json")
def conversation_history(rows):
    return answers.history_entries(rows)


@over("actions")
def bounded_history(actions):
    return history.bounded(actions, "user_id").select("user_id", "id")


@over("actions")
def sample_every_2nd(actions):
    return history.every_2nd(actions, "user_id").select("user_id", "id", "size_before_cut")


@over("questions")
def cooldown(questions):
    return history.cooldown(questions, COOLDOWN)


@over("responses")
def response_nav(rows):
    return history.nav(rows, "conv_id", "response_text", ("turn", "response_id"))


@over("responses")
def answer_at(rows):
    return history.answer_at(rows, "conv_id", ("turn", "response_id"), 2).select("conv_id", "response_id", "turn")


# --- answers


@over("responses")
def parse_sections(rows):
    return answers.sections(rows)


@over("responses")
def format_answer(rows):
    return answers.formatted_lines(rows)


@over("responses")
def extract_qa(rows):
    return answers.extract_qa(rows).select("response_id", joined("questions"), joined("answers"))


@over("responses")
def qa_pairs(rows):
    return answers.qa_pairs(rows)


@over("responses")
def line_kinds(rows):
    return answers.line_kinds(rows)


@over("responses")
def bold_spans(rows):
    return answers.bold_spans(rows)


@over("model_json")
def text_analysis_json(rows):
    out = answers.text_analysis(rows)
    return out.select("response_id", "valid", "error", joined("main_topics"), "sentiment", "intent", "technical_content", "urgency_level", joined("entities"))


@over("model_json")
def image_analysis_json(rows):
    return answers.image_analysis(rows).select("response_id", "valid", "error", "scene_description", "text_detected", "application_type", "visual_context", joined("ui_elements"))


@over("model_json")
def model_answer(rows):
    out = answers.model_answers(rows)
    return out.select(
        "response_id", "summary", "detailed_analysis", joined("action_suggestions"), F.round("confidence", 6).alias("confidence"),
        F.col("context_used")["k"].alias("context_k"), joined("follow_up_questions"),
    )


@over("model_json")
def confidence_percent(rows):
    return answers.model_answers(rows).select("response_id", answers.confidence_percent(F.col("confidence")).alias("percent"))


# --- streaming: batch twins of the windowed counts, and stream runs into a table


@over("actions")
def interval_counts(actions):
    return jobs.interval_counts(actions.withColumn("at", F.timestamp_seconds("ts_s")))


@over("actions")
def live_activity(actions):
    return jobs.live_activity(actions.withColumn("at", F.timestamp_seconds("ts_s")), "action_type")


def stream(view_name: str, *tables: str, mode: str = "append", keys: list[str] | None = None):
    """Registers a streaming job under its own name: its tables stream in, its rows go to a table."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run_to_table(f(view(spark, sf_dir, view_name, streamed=tables)), f.__name__, mode, keys)

        QUERIES[f.__name__] = run
        return f

    return register


#: The tables' files hold their rows in any order, over a month.
LATE = "60 days"


@stream("captures", "documents")
def stream_source(rows):
    return rows.select("capture_id", "ts_s")


@stream("captures", "documents")
def stream_merge_lines(rows):
    return jobs.merge_lines(rows, late=LATE)


@stream("actions", "events", mode="update", keys=["start_s", "action_type"])
def stream_live_activity(actions):
    return jobs.live_activity(jobs.in_time(actions, LATE, None), "action_type")


@stream("actions", "events", mode="update", keys=["user_id"])
def stream_bounded_history(actions):
    return jobs.bounded_history(actions, LATE)


def stream_log_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions = view(spark, sf_dir, "actions", streamed=("events",))
    path = fresh_dir(spark, "log")
    jobs.log_sink(sinks.action_rows(actions), path, fresh_dir(spark, "log-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return read_log(spark, path)


def stream_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = jobs.Ending(spark)
    questions = view(spark, sf_dir, "questions", streamed=("events",))
    return run_to_table(jobs.cooldown(questions, COOLDOWN, LATE, ending), "stream_cooldown", ending=ending)


def stream_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the frames view joins a table with itself, so its rows arrive as files of their own; a frame is taken every second
    path, ending = fresh_dir(spark, "frames"), jobs.Ending(spark)
    frames = view(spark, sf_dir, "frames").select(F.col("seq_id").cast("long"), "position", F.col("vec").cast("array<double>").alias("vec"), (F.lit(1704067200) + F.col("seq_id") + F.col("position")).cast("long").alias("ts_s"))
    frames.write.parquet(path)
    found = jobs.change(jobs.capture_stream(spark, path, frames.schema), LATE, ending)
    return run_to_table(found, "stream_change", ending=ending)


QUERIES |= {f.__name__: f for f in (stream_log_sink, stream_cooldown, stream_change)}
