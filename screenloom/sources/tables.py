"""Input tables: Parquet readers, and views over them that the operators are defined on.

A view is one SQL text that both Spark and other engines run; ``$name`` names its inputs.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS = {
    "captures": """
SELECT d.doc_id AS capture_id, d.doc_id % 50 AS user_id, d.source AS source,
  1704067200 + (d.doc_id * 7919) % 2592000 AS ts_s,
  CASE CAST(d.doc_id % 11 AS INT) WHEN 0 THEN 'chrome.exe' WHEN 1 THEN 'Code.exe' WHEN 2 THEN 'notepad.exe'
    WHEN 3 THEN 'EXCEL.EXE' WHEN 4 THEN 'outlook.exe' WHEN 5 THEN 'explorer.exe' WHEN 6 THEN 'firefox.exe'
    WHEN 7 THEN 'slack.exe' WHEN 8 THEN 'vlc.exe' WHEN 9 THEN 'WINWORD.EXE' ELSE 'foo.exe' END AS process_name,
  concat('Window ', CAST(d.doc_id AS STRING)) AS window_title,
  CAST((d.doc_id * 13) % 90 AS DOUBLE) AS cpu_percent, (d.doc_id % 7) * 100000000 AS memory_usage,
  concat(d.text, CASE CAST(d.doc_id % 8 AS INT)
    WHEN 0 THEN concat(chr(10), 'See ', p.url, ' to login with password', chr(10), 'Page 3 of 9', chr(10), 'Search')
    WHEN 1 THEN concat(chr(10), 'Best price for this product [ad] , buy it now!Really?', chr(10), 'Share', chr(10), '  42  ')
    WHEN 2 THEN concat(chr(10), 'filepath: C:/x.py', chr(10), 'def run class import error in function', chr(10), 'Click here to continue')
    WHEN 3 THEN concat(chr(10), 'News article posted by www.site.com today', chr(10), 'How do we play the video..and watch it?')
    WHEN 4 THEN concat(chr(10), 'chapter one section two of the document', chr(10), 'Our market research', chr(10), 'Home', chr(10), chr(10), 'search results found for https://a.b/c?d=1 and http://e.f/')
    WHEN 5 THEN concat(chr(10), 'PS C:', chr(92), 'work> Gmail inbox email', chr(10), 'Explain this. 7.', chr(10), '12.')
    ELSE '' END) AS text
FROM $documents d LEFT JOIN $pages p ON p.page_id = d.doc_id % 50""",
    "frames": """
SELECT e.vec_id - e.vec_id % 16 AS seq_id, CAST(e.vec_id % 16 AS INT) AS position, s.embedding AS vec
FROM $embeddings e JOIN $embeddings s ON s.vec_id = e.vec_id - CASE WHEN e.vec_id % 7 = 3 THEN 1 ELSE 0 END""",
    "actions": """
SELECT event_id AS id, user_id,
  CAST(1704067200 + (EXTRACT(DAY FROM ts) - 1) * 86400 + EXTRACT(HOUR FROM ts) * 3600 + EXTRACT(MINUTE FROM ts) * 60 + FLOOR(EXTRACT(SECOND FROM ts)) AS BIGINT) AS ts_s,
  event_type AS action_type,
  CASE CAST(user_id % 6 AS INT) WHEN 0 THEN 'chrome.exe' WHEN 1 THEN 'Code.exe' WHEN 2 THEN 'notepad.exe'
    WHEN 3 THEN 'EXCEL.EXE' WHEN 4 THEN 'outlook.exe' ELSE 'slack.exe' END AS application,
  concat(CASE event_type WHEN 'click' THEN 'Click link ' WHEN 'view' THEN 'browse page ' WHEN 'purchase' THEN 'open order '
    WHEN 'signup' THEN 'Write form ' ELSE 'debug run ' END, CAST(event_id AS STRING)) AS description,
  props AS metadata, value
FROM $events""",
    "questions": """
SELECT id AS question_id, user_id, ts_s, CASE WHEN id % 5 = 0 THEN '' ELSE concat('what is ', description, '?') END AS question
FROM $actions WHERE action_type = 'error'""",
    "responses": """
SELECT conv_id * 100 + turn AS response_id, conv_id, turn,
  concat('stray line before any header', chr(10), 'Executive Summary:', chr(10), text, chr(10), 'STATISTICAL HIGHLIGHTS:', chr(10),
    '  score rose 12 percent', chr(10), chr(10), 'Key Findings:', chr(10), '• ** first ** finding', chr(10), '•second 2', chr(10),
    'Empty Section:', chr(10), 'Common Questions:', chr(10), 'Q1: what is it? see: ', CAST(turn AS STRING), chr(10), 'A1: answer one', chr(10),
    'Q2: and then?', chr(10), 'A2: answer two', chr(10), 'Quite plain', chr(10), '**Bold line**') AS response_text
FROM $conversations WHERE role = 'assistant'""",
    "notes": """
SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN concat(' ', chr(10)) ELSE concat(chr(10), 'to do: ', text, chr(10), chr(10), 'end ') END AS notes
FROM $conversations WHERE role = 'user' AND turn = 0
UNION ALL SELECT -5 AS conv_id, 'notes alone' AS notes""",
    "model_json": """
SELECT conv_id * 100 + turn AS response_id, conv_id, turn, 1704067200 + conv_id * 60 + turn AS ts_s,
  CASE WHEN (conv_id + turn) % 11 = 0 THEN concat('timeout after ', CAST(turn AS STRING), ' s') END AS error,
  CASE WHEN (conv_id + turn) % 11 = 0 THEN NULL WHEN (conv_id + turn) % 5 = 0 THEN concat('not json: ', text)
    WHEN (conv_id + turn) % 7 = 0 THEN '{"summary":"s only"}'
    ELSE concat('{"summary":"sum ', CAST(conv_id AS STRING), '","detailed_analysis":"d","action_suggestions":["a","b"],"confidence_score":0.', CAST(turn + 1 AS STRING), ',"context_used":{"k":"v"},"follow_up_questions":["q"]}') END AS body
FROM $conversations WHERE role = 'assistant'""",
    "modal_answers": """
SELECT conv_id AS input_id, conv_id AS response_id, body, error FROM $model_json WHERE response_id % 100 = 1""",
    "modal_inputs": """
SELECT c.capture_id AS input_id, c.user_id, CAST(1 + c.capture_id % 3 AS INT) AS priority,
  CASE WHEN c.capture_id % 4 = 0 THEN '' ELSE c.text END AS text,
  CASE WHEN c.capture_id % 3 = 0 THEN NULL ELSE concat('a screen with ', substr(c.text, 1, 200)) END AS scene_description,
  CASE WHEN c.capture_id % 5 = 0 THEN NULL ELSE c.process_name END AS context_process
FROM $captures c""",
    "web_pages": """
SELECT page_id, url, CASE WHEN page_id % 23 = 22 THEN NULL WHEN page_id % 3 = 0
  THEN replace(html, '</article>', concat(repeat('<a href="/more?a=1&amp;b=2">m</a>', 12), repeat('<img src="/i.png">', 7), '</article>'))
  WHEN page_id % 5 = 1
  THEN concat('<!-- <a href="/c">c</a> --><a title="x > y" href=', chr(39), '/one', chr(39), '>a</a><a title="b href=/no c" href="/two">b</a><A HREF=/three>c</A>',
    '<a data-href="/d" title="<!-- ">d</a><template>t<a href="/in?x=1&copy=2&lt;">t</a></template><script>if (a < b) "</style><a href=no>"</script>',
    '&#39;&nbsp;&eacute;&apos;&#x41;&notit;&#150;&#0;&unknown;&amp;lt; 1 < 2 &', html)
  ELSE html END AS html
FROM $pages""",
}
_NAME = re.compile(r"\$(\w+)")


#: Tables between these sizes may be held in too few files for all cores.
SPREAD_BYTES = 1 << 20, 1 << 30


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A stored table, all columns; filters and column choices reach the Parquet scan.

    A table of some megabytes that its files give to fewer tasks than there are cores is dealt out
    to all; larger ones are read as they lie.
    """
    rows = spark.read.parquet(f"{directory}/{name}.parquet")
    cores, (least, most) = spark.sparkContext.defaultParallelism, SPREAD_BYTES
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return rows.repartition(cores) if least < size < most and rows.rdd.getNumPartitions() < cores else rows


#: What a micro-batch reads at most, or one file.
BATCH_BYTES = 256 << 20


def stream_table(spark: SparkSession, directory: str, name: str, most: int = BATCH_BYTES) -> DataFrame:
    """A stored table as a stream of its files, ``most`` bytes a micro-batch."""
    schema = spark.read.parquet(f"{directory}/{name}.parquet").schema
    # as a pattern, a single file is taken as well as a folder
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", most).parquet(f"{directory}/{name}.parque[t]")


def read_log(spark: SparkSession, path: str, since: float | None = None, until: float | None = None) -> DataFrame:
    """Rows of a log with a folder a day, of the time from ``since`` to before ``until``; other days are not read."""
    rows = spark.read.parquet(path)
    for bound, day, time in ((since, F.col("day") >= F.to_date(F.timestamp_seconds(F.lit(since))), F.col("timestamp") >= since), (until, F.col("day") <= F.to_date(F.timestamp_seconds(F.lit(until))), F.col("timestamp") < until)):
        rows = rows if bound is None else rows.filter(day & time)
    return rows.drop("day")


def view(spark: SparkSession, directory: str, name: str, streamed: tuple[str, ...] = ()) -> DataFrame:
    """A view over the stored tables, of which some may be streamed."""
    sql, made = VIEWS[name], []
    for needed in sorted(set(_NAME.findall(sql)), key=len, reverse=True):
        source = (
            view(spark, directory, needed, streamed)
            if needed in VIEWS
            else (stream_table if needed in streamed else read_table)(spark, directory, needed)
        )
        alias = f"v_{uuid.uuid4().hex}"
        source.createOrReplaceTempView(alias)
        sql, made = sql.replace(f"${needed}", alias), [*made, alias]
    out = spark.sql(sql)
    for alias in made:
        spark.catalog.dropTempView(alias)
    return out


def with_views(sql: str, *names: str) -> str:
    """A query in plain SQL with the views it names written out in front of it."""
    order: list[str] = []

    def need(name: str) -> None:
        for inner in _NAME.findall(VIEWS[name]):
            if inner in VIEWS:
                need(inner)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    body = sql.strip()
    rest = body[4:].lstrip() if body.upper().startswith("WITH") else None
    recursive = rest is not None and rest.upper().startswith("RECURSIVE")
    rest = rest[9:].lstrip() if recursive else rest
    head = ", ".join(f"{n} AS ({_NAME.sub(lambda m: m[1], VIEWS[n])})" for n in order)
    return f"WITH {'RECURSIVE ' * recursive}{head}{',' if rest else ''} {rest or body}"
