"""Text jobs over captures: cleaning, questions, prompts, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenloom.functions import text as T
from screenloom.functions.activity import detect_activity

# Our wording; the section names are the contract with the answer parsers.
QUESTION_PROMPT = "Answer the question below.\nUse these sections:\nMAIN ANSWER:\nKEY FACTS & STATISTICS:\nDETAILED EXPLANATION:\nRELATED INSIGHTS:\nCOMMON QUESTIONS:\n\nQuestion:\n"
SUMMARY_PROMPT = "Summarise the content below.\nUse these sections:\nEXECUTIVE SUMMARY:\nSTATISTICAL HIGHLIGHTS:\nKEY FINDINGS:\nDETAILED ANALYSIS:\nIMPORTANT QUESTIONS COVERED:\nCONCLUSIONS & IMPLICATIONS:\n\nContent:\n"
INSIGHT = (
    (("Programming",), "Give a hint on this code: ", 300),
    (("Web Search", "Web Browsing"), "Name topics related to this page: ", 300),
    (("Document Editing", "Reading/Writing"), "Suggest how to improve this text: ", 300),
    (("Email Management",), "Suggest how to handle this mail: ", 200),
)
OTHER_INSIGHT = ("Suggest a next step for this work: ", 300)


def process_text(captures: DataFrame) -> DataFrame:
    """One record a capture: cleaned text, its sentences, word count and whether it asks."""
    cleaned = captures.select("*", T.clean_text(F.col("text")).alias("cleaned"))
    return cleaned.select(
        "capture_id", F.col("text").alias("original"), "cleaned", T.sentences(F.col("cleaned")).alias("sentences"),
        T.word_count(F.col("cleaned")).alias("word_count"), T.has_question(F.col("cleaned")).alias("has_questions"),
    )


def sentence_rows(captures: DataFrame) -> DataFrame:
    rows = captures.select("capture_id", F.posexplode(T.sentences(T.clean_text(F.col("text")))).alias("pos", "sentence"))
    return rows


def question_rows(captures: DataFrame) -> DataFrame:
    """The asking sentences of the texts as captured."""
    return captures.select("capture_id", F.posexplode(T.questions(F.col("text"))).alias("pos", "question"))


def text_stats(captures: DataFrame, by: str = "source") -> DataFrame:
    cleaned = captures.select(by, T.clean_text(F.col("text")).alias("cleaned"))
    measured = cleaned.select(
        by, T.word_count(F.col("cleaned")).alias("w"), T.has_question(F.col("cleaned")).alias("q"), F.size(T.sentences(F.col("cleaned"))).alias("s")
    )
    return measured.groupBy(by).agg(
        F.count(F.lit(1)).alias("docs"), F.sum("w").alias("words"), F.count_if("q").alias("asking"), F.sum("s").cast("long").alias("sentences")
    )


def outcomes(captures: DataFrame, by: str = "source") -> DataFrame:
    """How many captures of each source end at which step."""
    step = (
        F.when(T.strip(F.coalesce("text", F.lit(""))) == "", "no_text").when(T.clean_text(F.col("text")) == "", "nothing_left").otherwise("analysed")
    )
    return captures.groupBy(by, step.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def without_noise(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("filepath:"), F.lit("")), F.lit("PS C:\\>"), F.lit(""))


def prompts(captures: DataFrame) -> DataFrame:
    """The batch of prompts for a model: the template by kind, then the text."""
    text = without_noise(F.coalesce("text", F.lit("")))
    kind = T.prompt_kind(text)
    template = F.when(kind == "question", QUESTION_PROMPT).otherwise(SUMMARY_PROMPT)
    return captures.select("capture_id", kind.alias("kind"), F.concat(template, text).alias("prompt"))


def activity_prompts(captures: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    activity = detect_activity(F.col("process_name"), text)["activity_type"]
    out = F.concat(F.lit(OTHER_INSIGHT[0]), F.substring(text, 1, OTHER_INSIGHT[1]))
    for names, lead, n in reversed(INSIGHT):
        out = F.when(activity.isin(*names), F.concat(F.lit(lead), F.substring(text, 1, n))).otherwise(out)
    return captures.select("capture_id", activity.alias("activity_type"), out.alias("prompt"))
