"""Quality rules with cross-document line frequency, in DataFrame functions only.

Base figures of each text are computed in its own row. Then lines are normalised (white space at
the ends stripped, runs of it one space, lower case), hashed together with their host, and counted
once for each document. Lines that more than ``max_docs`` documents of a host have are taken away,
and a document that has less than ``min_left`` of its words after that is depleted.

Only (hash, words) pairs of lines are ever moved, never texts. A line that very many documents
share is counted by partial sums, and the lines over the limit are joined in a table of their own, by salt.

Cases: null text has no words and fails; a null host is a host; rows of equal id count as documents
each; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandtally.llm.components import salted_join
from strandtally.shared import materialize

WHITE = r"[\x20\x09-\x0D]"
WINDOW = 8
#: A line that more documents of a host have is no text of theirs.
MAX_DOCS = 5
#: A document that keeps a smaller share of its words is depleted.
MIN_LEFT = 0.7


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, WHITE + "+"), "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of words that the text has twice or more."""

    def covered(hashes: Column) -> Column:
        def spread(ranked: Column) -> Column:
            last = F.size(ranked) - 1
            twin = lambda k, to: ranked[k]["h"] == ranked[to]["h"]
            again = F.filter(F.sequence(F.lit(0), last), lambda k: F.when(k > 0, twin(k, k - 1)).otherwise(False) | F.when(k < last, twin(k, k + 1)).otherwise(False))
            starts = F.sort_array(F.transform(again, lambda k: ranked[k]["i"]))
            state = F.struct(F.lit(0).alias("total"), F.lit(0).alias("end"))
            step = lambda acc, i: F.struct((acc["total"] + i + window - F.greatest(acc["end"], i)).alias("total"), (i + window).alias("end"))
            return F.aggregate(starts, state, step, lambda acc: acc["total"])

        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(ranked, spread))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*[h[i + j] for j in range(window)]))

    single = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= window, F.lit(0)).otherwise(let(single, lambda h: let(windows(h), covered)))


def base_figures(docs: DataFrame, doc_col: str, text_col: str, host_col: str) -> DataFrame:
    """A row per document: uid, doc_id, the base figures, and its lines as (key, words)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    plain = lambda x: F.lower(F.array_join(words_of(x), " "))
    rows = docs.select(F.col(doc_col).alias("doc_id"), F.col(host_col).alias("host"), text.alias("text")).withColumn("words", words_of(F.col("text")))
    rows = rows.select("*", lines.alias("own"))
    return rows.select(
        F.monotonically_increasing_id().alias("uid"), "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("own") - F.size(F.array_distinct("own"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.transform("own", lambda x: F.struct(F.xxhash64(F.col("host"), plain(x)).alias("key"), F.size(words_of(x)).alias("words"))).alias("lines"),
    )


def quality(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    """doc_id, the base figures, base_failed, removed_words, kept."""
    base = materialize(base_figures(docs, doc_col, text_col, host_col), "line-figures")
    lines = base.select("uid", F.explode("lines").alias("l")).groupBy("uid", F.col("l.key").alias("key")).agg(F.sum("l.words").alias("words"))
    lines = materialize(lines, "line-keys")
    frequent = materialize(lines.groupBy("key").agg(F.count("*").alias("docs")).where(F.col("docs") > max_docs).select("key"), "line-frequent")
    removed = salted_join(lines, frequent, ["key"], "uid").groupBy("uid").agg(F.sum("words").alias("removed_words"))
    out = base.drop("lines").join(removed, "uid", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    depleted = F.col("n_words") - F.col("removed_words") < F.lit(min_left) * F.col("n_words")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted).drop("uid")


def op4_line_frequency(spark, sf_dir: str) -> DataFrame:
    out = quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = rf"""
with d as (select row_number() over () as uid, doc_id, source, coalesce(text, '') as text from documents),
w as (select uid, list_filter(regexp_split_to_array(text, '{WHITE}+'), lambda x: x <> '') as w from d),
g as (select uid, unnest(range(1, len(w) - 6)) as i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) as gram from w where len(w) > 7),
g2 as (select uid, i, count(*) over (partition by uid, gram) as n from g),
r as (select uid, count(distinct p) as n_repeat_words from (select uid, unnest(range(i, i + 8)) as p from g2 where n > 1) group by uid),
l as (select uid, source, line, lower(trim(regexp_replace(line, '{WHITE}+', ' ', 'g'), ' ')) as norm, len(list_filter(regexp_split_to_array(line, '{WHITE}+'), lambda x: x <> '')) as words
  from (select uid, source, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]')),
dup as (select uid, count(*) - count(distinct line) as n_dup_lines from l group by uid),
f as (select source, norm from l group by source, norm having count(distinct uid) > {MAX_DOCS}),
rem as (select uid, sum(words) as removed from l join f on l.norm = f.norm and l.source is not distinct from f.source group by uid),
a as (select d.doc_id, cast(len(w.w) as bigint) as n_words, cast(length(array_to_string(w.w, '')) as bigint) as word_chars, cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
  cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words, coalesce(removed, 0) as removed
  from d join w using (uid) left join dup using (uid) left join r using (uid) left join rem using (uid)),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from a)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and n_words - removed >= {MIN_LEFT} * n_words as kept from b"""
