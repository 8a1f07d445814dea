"""Parsing of model answers: sections, question-answer pairs, line kinds, JSON records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from screenloom.functions.text import after_colon, latin1, strip
from screenloom.operators.history import last_n
from screenloom.operators.ranges import numbered

RULE = "=" * 60
STAT_SIGN = "📊"


def lines_of(answers: DataFrame, text: str = "response_text") -> DataFrame:
    """response_id, line_no, line: stripped lines, empty ones dropped."""
    rows = answers.select("response_id", F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line_no", "raw"))
    return rows.select("response_id", "line_no", strip(F.col("raw")).alias("line")).filter(F.col("line") != "")


def sections(answers: DataFrame) -> DataFrame:
    """response_id, section_no, section, line_no, line: content under each header.

    A line that ends in a colon opens a section; lines before the first and sections without
    content are lost; a header that is only a colon opens nothing that is kept.
    """
    order = Window.partitionBy("response_id").orderBy("line_no")
    rows = lines_of(answers).withColumn("header", F.col("line").endswith(":"))
    rows = rows.withColumn("section_no", F.sum(F.col("header").cast("long")).over(order))
    name = F.last(F.when(F.col("header"), F.expr("substring(line, 1, length(line) - 1)")), ignorenulls=True).over(order)
    rows = rows.withColumn("section", name)
    return rows.filter(~F.col("header") & (F.col("section_no") > 0) & (F.col("section") != "")).select(
        "response_id", "section_no", "section", "line_no", "line"
    )


def formatted_lines(answers: DataFrame) -> DataFrame:
    """response_id, section_no, line_no, kind, out: each content line in its final form.

    A question takes the section's first answer; answers themselves vanish.
    """
    rows = sections(answers)
    line = F.col("line")
    whole = Window.partitionBy("response_id", "section_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    answer = F.coalesce(F.first(F.when(line.startswith("A"), after_colon(line)), ignorenulls=True).over(whole), F.lit(""))
    kind = (
        F.when(line.startswith("•"), "bullet").when(line.startswith("Q"), "question").when(line.startswith("A"), "answer")
        .when(line.rlike(r"(?U)\p{Nd}"), "stat").otherwise("paragraph")
    )
    rows = rows.withColumn("answer", answer).withColumn("kind", kind).filter("kind <> 'answer'")
    out = (
        F.when(F.col("kind") == "bullet", F.concat(F.lit("• "), strip(line.substr(F.lit(2), F.length(line)))))
        .when(F.col("kind") == "question", F.concat(F.lit("Q: "), after_colon(line), F.lit("\nA: "), F.col("answer")))
        .when(F.col("kind") == "stat", F.concat(F.lit(f"{STAT_SIGN} "), line))
        .otherwise(line)
    )
    return rows.select("response_id", "section_no", F.upper("section").alias("section"), "line_no", "kind", out.alias("out"))


def formatted_text(answers: DataFrame) -> DataFrame:
    """The formatted lines of each answer as one text, each section under its ruled header."""
    rows = formatted_lines(answers)
    first = F.row_number().over(Window.partitionBy("response_id", "section_no").orderBy("line_no")) == 1
    header = F.concat(F.lit(f"\n{RULE}\n** "), F.col("section"), F.lit(f" **\n{RULE}\n\n"))
    ending = F.when(F.col("kind").isin("bullet", "stat"), "\n").otherwise("\n\n")
    piece = F.concat(F.when(F.col("first"), header).otherwise(F.lit("")), F.col("out"), ending)
    rows = rows.withColumn("first", first).withColumn("piece", piece)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "piece"))), lambda x: x["piece"]), "")
    return rows.groupBy("response_id").agg(strip(joined).alias("formatted"))


def extract_qa(answers: DataFrame) -> DataFrame:
    """response_id, questions, answers: lines that start with Q or A, after their colon."""
    lines = F.transform(F.split(F.coalesce("response_text", F.lit("")), "\n"), strip)
    starting = lambda c: F.transform(F.filter(lines, lambda x: x.startswith(c)), after_colon)
    return answers.select("response_id", starting("Q").alias("questions"), starting("A").alias("answers"))


def qa_pairs(answers: DataFrame) -> DataFrame:
    """The i-th question with the i-th answer; null where one is missing."""
    zipped = extract_qa(answers).select("response_id", F.posexplode(F.arrays_zip("questions", "answers")).alias("pos", "p"))
    return zipped.select("response_id", "pos", F.col("p.questions").alias("question"), F.col("p.answers").alias("answer"))


def line_kinds(answers: DataFrame) -> DataFrame:
    """response_id, line_no, kind, text: how each line of a formatted answer is shown.

    Rules come in pairs with a title between them, so every second one is skipped.
    """
    rows = formatted_text(answers).select("response_id", F.posexplode(F.split("formatted", "\n")).alias("line_no", "raw"))
    line = strip(F.col("raw"))
    order = Window.partitionBy("response_id").orderBy("line_no")
    is_rule = F.contains(line, F.lit("=" * 20))
    rows = rows.select("response_id", "line_no", line.alias("line"), is_rule.alias("rule"))
    rows = rows.withColumn("rules", F.sum(F.col("rule").cast("int")).over(order)).withColumn("before", F.lag("line").over(order)).withColumn("rule_before", F.lag("rule").over(order))
    title = F.coalesce(F.col("rule_before"), F.lit(False)) & (F.col("rules") % 2 == 1)
    line = F.col("line")
    kind = (
        F.when(F.col("rule"), "rule").when(title, "title").when(line.startswith("**") & line.endswith("**"), "section")
        .when(line.startswith("•"), "bullet").when(line.startswith(STAT_SIGN), "stat").when(line.startswith("Q:"), "question")
        .when(line.startswith("A:") & F.col("before").startswith("Q:"), "answer").otherwise("normal")
    )
    text = F.when(title, F.replace(line, F.lit("**"), F.lit(""))).when(F.col("kind") == "section", strip(F.regexp_replace(line, r"^\*+|\*+$", ""))).otherwise(line)
    return rows.withColumn("kind", kind).filter("kind <> 'rule'").select("response_id", "line_no", "kind", text.alias("text"))


def bold_spans(answers: DataFrame) -> DataFrame:
    """The pieces of each line between ** marks; odd ones are bold."""
    rows = lines_of(answers)
    out = rows.select("response_id", "line_no", F.posexplode(F.split("line", r"\*\*")).alias("part", "text"))
    return out.select("response_id", "line_no", "part", "text", (F.col("part") % 2 == 1).alias("bold"))


# The titles of a report's sections.
RESPONSE_TITLE, NOTES_TITLE = "Response ", "User Notes"


def report_lines(answers: DataFrame, key: str = "conv_id", order: str = "turn", last: int | None = 5, notes: DataFrame | None = None) -> DataFrame:
    """key, idx, line_no, line: the session's (last) answers, numbered, titled, in Latin-1.

    With ``notes`` (key, notes) the session's notes follow as a section of their own, unless they are blank;
    a session may have notes alone. All answers of a session are numbered in ranges.
    """
    if last:
        kept = last_n(answers, key, last, (order,))
        kept = kept.withColumn("idx", F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("long"))
    else:
        kept = numbered(answers, key, [order], "_place").withColumn("idx", F.col("_place") + 1)
    title = F.array(F.concat(F.lit(RESPONSE_TITLE), F.col("idx").cast("string"), F.lit(":")))
    lines = F.concat(title, F.split(F.coalesce("response_text", F.lit("")), "\n"))
    rows = kept.select(key, "idx", F.posexplode(lines).alias("line_no", "raw"))
    if notes is not None:
        text = strip(F.coalesce("notes", F.lit("")))
        sizes = answers.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
        told = notes.select(key, text.alias("notes")).filter("notes <> ''").join(sizes, F.col(key).eqNullSafe(F.col("_key")), "left")
        size = F.coalesce("_n", F.lit(0)).cast("long")
        idx = (F.least(F.lit(last), size) if last else size) + 1
        rows = rows.union(told.select(key, idx.alias("idx"), F.posexplode(F.concat(F.array(F.lit(NOTES_TITLE)), F.split("notes", "\n"))).alias("line_no", "raw")))
    return rows.select(key, "idx", "line_no", latin1(F.col("raw")).alias("line"))


ANSWER = ST.StructType([
    ST.StructField("summary", ST.StringType()), ST.StructField("detailed_analysis", ST.StringType()),
    ST.StructField("action_suggestions", ST.ArrayType(ST.StringType())), ST.StructField("confidence_score", ST.DoubleType()),
    ST.StructField("context_used", ST.MapType(ST.StringType(), ST.StringType())), ST.StructField("follow_up_questions", ST.ArrayType(ST.StringType())),
])
# Fields of the two analysis records and what they hold when the answer is no JSON.
TEXT_DEFAULTS = {
    "main_topics": ["general"], "sentiment": "neutral", "intent": "information seeking", "entities": [], "questions_present": [],
    "action_items": [], "technical_content": "unknown", "urgency_level": "medium", "context_clues": [], "knowledge_gaps": [],
}
IMAGE_DEFAULTS = {
    "scene_description": None, "text_detected": "", "ui_elements": [], "application_type": "unknown", "visual_context": "general computer use",
    "notable_features": [], "technical_elements": [], "action_opportunities": [], "attention_areas": [], "accessibility_notes": [],
}


# The record of an answer that is no JSON, and of a call that failed.
UNREAD = {"action_suggestions": ["Review the analysis provided"], "confidence": 0.7}
FAILED = {"summary": "Error in analysis", "detailed_analysis": "An error occurred: ", "action_suggestions": ["Try again or check system logs"], "confidence": 0.0}


def is_json(body: Column) -> Column:
    return F.try_parse_json(body).isNotNull()


def failed(answers: DataFrame) -> Column:
    """Whether the call gave no answer: it left an error, or no text."""
    return F.col("error").isNotNull() | F.col("body").isNull() if "error" in answers.columns else F.col("body").isNull()


def reason(answers: DataFrame) -> Column:
    return F.coalesce("error", F.lit("no answer")) if "error" in answers.columns else F.lit("no answer")


def analysis_record(answers: DataFrame, defaults: dict, raw_field: str | None = None) -> DataFrame:
    """The fields of a JSON record; the defaults (and the raw text in one field) where it is none.

    A call that failed leaves nothing but ``error``; ``valid`` is false then too.
    """
    kinds = {k: ST.ArrayType(ST.StringType()) if isinstance(v, list) else ST.StringType() for k, v in defaults.items()}
    schema = ST.StructType([ST.StructField(k, t) for k, t in kinds.items()])
    none = failed(answers)
    parsed = answers.select(
        "response_id", "body", F.when(none, reason(answers)).alias("error"), F.from_json("body", schema).alias("r"),
        (~none & F.coalesce(is_json(F.col("body")), F.lit(False))).alias("valid"),
    )

    def default(name: str) -> Column:
        if name == raw_field:
            return F.col("body")
        value = defaults[name]
        return F.array(*map(F.lit, value)).cast(kinds[name]) if isinstance(value, list) else F.lit(value)

    field = lambda k: F.when(F.col("valid"), F.col(f"r.{k}")).when(F.col("error").isNull(), default(k)).alias(k)
    return parsed.select("response_id", "valid", "error", *[field(k) for k in defaults])


def text_analysis(answers: DataFrame) -> DataFrame:
    return analysis_record(answers, TEXT_DEFAULTS)


def image_analysis(answers: DataFrame) -> DataFrame:
    return analysis_record(answers, IMAGE_DEFAULTS, "scene_description")


def model_answers(answers: DataFrame) -> DataFrame:
    """The final record of an answer: gaps filled, the raw text where it is no JSON, the failure where there is none."""
    parsed = answers.withColumn("r", F.from_json("body", ANSWER)).withColumn("valid", is_json(F.col("body")))
    none, lost, why = F.array().cast("array<string>"), failed(answers), reason(answers)
    pick = lambda found, raw, gone: F.when(lost, gone).when(F.col("valid"), found).otherwise(raw)
    told = lambda record: F.array(*map(F.lit, record["action_suggestions"]))
    empty = F.create_map().cast("map<string,string>")
    return parsed.select(
        "response_id", "conv_id", "turn", "ts_s",
        pick(F.coalesce("r.summary", F.lit("")), F.substring("body", 1, 200), F.lit(FAILED["summary"])).alias("summary"),
        pick(F.coalesce("r.detailed_analysis", F.lit("")), F.col("body"), F.concat(F.lit(FAILED["detailed_analysis"]), why)).alias("detailed_analysis"),
        pick(F.coalesce("r.action_suggestions", none), told(UNREAD), told(FAILED)).alias("action_suggestions"),
        pick(F.coalesce("r.confidence_score", F.lit(0.5)), F.lit(UNREAD["confidence"]), F.lit(FAILED["confidence"])).alias("confidence"),
        pick(F.coalesce("r.context_used", empty), empty, empty).alias("context_used"),
        pick(F.coalesce("r.follow_up_questions", none), none, none).alias("follow_up_questions"),
    )


def confidence_percent(confidence: Column) -> Column:
    return (confidence * 100).cast("int")


def history_entries(answers: DataFrame, keep: int = 50) -> DataFrame:
    """conv_id, ts_s, inputs, response_summary, confidence of the last entries of each conversation.

    Only a conversation's newest rows are sorted together; its size is combined before it is shuffled.
    """
    sizes = answers.groupBy(F.col("conv_id").alias("_conv")).agg(F.count(F.lit(1)).alias("inputs"))
    kept = last_n(model_answers(answers), "conv_id", keep, ("ts_s", "response_id"))
    kept = kept.join(sizes, F.col("conv_id").eqNullSafe(F.col("_conv")))
    return kept.select("conv_id", "response_id", "ts_s", "inputs", F.col("summary").alias("response_summary"), "confidence")
