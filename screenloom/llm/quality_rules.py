"""Quality rules with host verdicts, in DataFrame functions only.

Every text gets counts and a base verdict of its own; rule failures are then summed by host,
each host's failure rate is shrunk towards a beta prior fitted to all hosts, and the host's
verdict goes back to its documents.

Defined cases: texts of any length are taken whole; a null text has no words and fails for want of words; a null host is a host of
its own; an empty table gives an empty result; repeated rows are judged row by row; other
columns of the input are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenloom.llm.common import let, staged, words

SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
#: Prior strength (alpha + beta) stays between these.
STRENGTH = (1.0, 1e6)
#: A host whose shrunken failure rate under any rule is above this loses all its documents.
HOST_LIMIT = 0.5
RULES = ("base", "symbols", "lines")


def repeated_window_words(tokens: Column, width: int = 3) -> Column:
    """Words that lie in a ``width``-word window found at least twice in the array.

    Windows are compared by a 64-bit hash of their words. The usual text has no window twice:
    one sort of plain numbers shows it. Only else are positions sorted along.
    """

    def covered(hashes: Column) -> Column:
        def spread(s: Column) -> Column:
            same = lambda x, k: F.coalesce(x["g"] == F.get(s, k - 1)["g"], F.lit(False)) | F.coalesce(
                x["g"] == F.get(s, k + 1)["g"], F.lit(False)
            )
            at = F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))
            return let(
                at,
                lambda p: F.aggregate(
                    F.transform(p, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - x, F.lit(width)))),
                    F.lit(0).cast("long"),
                    lambda a, x: a + x,
                ),
            )

        tagged = F.sort_array(F.transform(hashes, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        twice = let(F.sort_array(hashes), lambda s: F.exists(F.transform(s, lambda g, k: F.coalesce(g == F.get(s, k - 1), F.lit(False))), lambda x: x))
        return F.when(twice, let(tagged, spread)).otherwise(F.lit(0).cast("long"))

    hashes = F.transform(
        F.sequence(F.lit(0), F.size(tokens) - width),
        lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(width)]),
    )
    return F.when(F.size(tokens) < width, F.lit(0).cast("long")).otherwise(let(hashes, covered))


def counts(text: Column) -> Column:
    """Struct of the base counts of a text (null counts as empty)."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_window_words(w).alias("n_repeat_words"),
        ),
    )


def fails_base(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > 50 * n_words)


def base_rules(
    docs: DataFrame, text: str = "text", host: str = "source", id_col: str = "doc_id", carry: tuple[str, ...] = ()
) -> DataFrame:
    """id, host, the counts, one boolean per rule (true where the document fails it), and the carried columns.

    Symbols and repeated lines count against a document's host only, never against it alone.
    """
    flat = docs.select(F.col(id_col).alias("doc_id"), F.col(host).alias("host"), counts(F.col(text)).alias("c"), *carry)
    flat = flat.select("doc_id", "host", "c.*", *carry)
    return flat.select(
        "*",
        fails_base(F.col("n_words"), F.col("n_repeat_words")).alias("fail_base"),
        (10 * F.col("n_symbols") > F.col("word_chars")).alias("fail_symbols"),
        (2 * F.col("n_dup_lines") > F.col("n_words")).alias("fail_lines"),
    )


def host_verdicts(judged: DataFrame) -> DataFrame:
    """host, and whether it is rejected: shrunken rates from failures summed by host.

    The prior of a rule is Beta(m*s, (1-m)*s): m is the corpus failure rate and s comes from
    the spread of host rates about it, each host by its size, less the binomial noise that
    hosts of their sizes would show anyway. Without spread beyond noise all hosts are alike.
    """
    hosts = judged.groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(f"fail_{r}").alias(f"k_{r}") for r in RULES]
    )
    prior = hosts.agg(
        F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("n")).alias("squares"),
        *[F.sum(f"k_{r}").alias(f"k_{r}") for r in RULES],
        *[F.sum(F.col(f"k_{r}") * F.col(f"k_{r}") / F.col("n")).alias(f"q_{r}") for r in RULES],
    ).first()

    def rate(r: str) -> Column:
        n = prior.docs or 1
        m = (prior[f"k_{r}"] or 0) / n
        spread = (prior[f"q_{r}"] or 0.0) - n * m * m - (prior.hosts - 1) * m * (1 - m)
        room = n - (prior.squares or 0) / n
        v = spread / room if room > 0 else 0.0
        s = min(STRENGTH[1], max(STRENGTH[0], m * (1 - m) / v - 1)) if v > 0 else STRENGTH[1]
        return (F.col(f"k_{r}") + F.lit(m * s)) / (F.col("n") + F.lit(s))

    return hosts.select(
        "host", *[rate(r).alias(f"rate_{r}") for r in RULES], F.greatest(*[rate(r) for r in RULES]).alias("worst")
    ).withColumn("host_rejected", F.col("worst") > HOST_LIMIT)


def apply_rules(docs: DataFrame, text: str = "text", host: str = "source", id_col: str = "doc_id") -> DataFrame:
    """One row per document: counts, ``base_failed`` and ``kept``.

    The counted rows (some numbers each, no texts) are staged once; the host table joins them
    back with a null-safe key, and adaptive execution picks broadcast by measured size or
    splits the rows of a hot host.
    """
    judged = staged(base_rules(docs, text, host, id_col), "quality-rules")
    rejected = host_verdicts(judged).filter("host_rejected").select(F.col("host").alias("bad_host"), "host_rejected")
    out = judged.join(rejected, F.col("host").eqNullSafe(F.col("bad_host")), "left")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.col("fail_base").alias("base_failed"),
        (~F.col("fail_base") & F.col("host_rejected").isNull()).alias("kept"),
    )


def kept_documents(docs: DataFrame, text: str = "text", host: str = "source", id_col: str = "doc_id") -> DataFrame:
    """The documents that pass, with all their columns.

    The rules run once on every text; rows are staged with their verdicts, then only rejected
    hosts are matched against them. No column of the input can clash with those made here: it
    travels inside one struct.
    """
    row = docs.select(F.struct(*docs.columns).alias("row"))
    judged = staged(base_rules(row, f"row.{text}", f"row.{host}", f"row.{id_col}", carry=("row",)), "quality-rules")
    # staged, so that its size is known when the join is planned: if it is small, no text moves
    rejected = staged(host_verdicts(judged).filter("host_rejected").select(F.col("host").alias("bad_host")), "rejected-hosts")
    passed = judged.filter("NOT fail_base").join(rejected, F.col("host").eqNullSafe(F.col("bad_host")), "left_anti")
    return passed.select("row.*")
