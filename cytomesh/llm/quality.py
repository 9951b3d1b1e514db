"""Op 6, quality rules and a hashed n-gram log-likelihood ratio. DataFrame functions only.

Base rules count words, symbols, repeated lines and repeated 5-word windows. The method's
verdict compares two multinomials over hashed 1- and 2-grams: of trusted documents (label
quality 1) and of all documents, both add-one smoothed. A document's score is the mean
over its n-grams of the log ratio, in whole thousandths so that sums are exact; a document
under THRESHOLD is rejected, always the same way.

The raw counts cover every document. The trusted ones are those of at most TRUSTED labelled
rows (in the order of md5(doc_id)), which bounds what is broadcast. The weights are one
number for each of BUCKETS buckets.

Defined results: null, empty and blank texts have no words and fail the base rules; without
any trusted row all ratios would be the raw smoothing's, and the verdict is then the base
rules' alone; repeated rows count each and get the same verdict; a null doc_id is judged like any
other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from math import floor, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cytomesh.session import table, written

SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 5
HALF = 8192  # buckets of 1-grams, and as many of 2-grams
BUCKETS = 2 * HALF
TRUSTED = 20_000
#: Thousandths of a nat per n-gram; clean text is near 0, junk far below.
THRESHOLD = -120


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def _codes(words: Column) -> Column:
    """16 bits of md5 for each word."""
    return F.transform(words, lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 4), 16, 10).cast("int"))


def _grams(codes: str) -> Column:
    """The buckets of all 1-grams, then of all 2-grams."""
    one = f"transform({codes}, c -> c % {HALF})"
    two = f"zip_with(slice({codes}, 1, greatest(size({codes}) - 1, 0)), slice({codes}, 2, greatest(size({codes}) - 1, 0)), (a, b) -> {HALF} + (a * 31 + b) % {HALF})"
    return F.expr(f"concat({one}, {two})")


def trusted_ids(labels: DataFrame, most: int = TRUSTED) -> DataFrame:
    """doc_id of at most `most` rows labelled as good."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    return good.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(most)


def log_ratios(coded: DataFrame, trusted: DataFrame) -> list[int] | None:
    """Thousandths of a nat for each bucket, from doc_id and codes of all documents; None without trusted text."""
    marked = coded.select("doc_id", "codes").join(F.broadcast(trusted.withColumn("good", F.lit(1))), "doc_id", "left")  # at most TRUSTED ids
    grams = marked.select("good", F.explode(_grams("codes")).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("good").alias("target"))
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for row in counts.collect():  # BUCKETS rows at most
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    if not sum(target):
        return None
    base = log((sum(raw) + BUCKETS) / (sum(target) + BUCKETS))
    return [floor(1000 * (log((t + 1) / (r + 1)) + base) + 0.5) for t, r in zip(target, raw, strict=True)]


def base_rules(docs: DataFrame, *carried: str) -> DataFrame:
    """docs (doc_id, text) with the base columns and codes, the words' hashes."""
    out = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("words", _words(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.select(
        "doc_id",
        *carried,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        _codes(F.col("words")).alias("codes"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    out = out.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    window = ", ".join(f"h[i + {j}]" for j in range(WINDOW))
    out = out.withColumn("w", F.expr(f"if(n_words >= {WINDOW}, transform(sequence(0, cast(n_words as int) - {WINDOW}), i -> xxhash64({window})), array())"))
    out = out.withColumn("s", F.expr("if(size(array_distinct(w)) < size(w), array_sort(transform(w, (k, i) -> struct(k, i))), cast(array() as array<struct<k:bigint,i:int>>))"))
    out = out.withColumn("p", F.expr("if(size(s) = 0, cast(array() as array<int>), sort_array(array_distinct(flatten(zip_with(slice(s, 1, size(s) - 1), slice(s, 2, size(s) - 1), (a, b) -> if(a.k = b.k, array(a.i, b.i), cast(array() as array<int>)))))))"))
    covered = f"aggregate(p, struct(0 as t, 0 as e), (a, x) -> struct(a.t + x + {WINDOW} - greatest(a.e, x) as t, x + {WINDOW} as e), a -> a.t)"
    out = out.withColumn("n_repeat_words", F.expr(covered).cast("long"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.select("doc_id", *carried, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "codes")


def keep(docs: DataFrame, labels: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    whole = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    return judge(whole, labels, threshold, "doc").where("kept").select("doc.*")


def judge(docs: DataFrame, labels: DataFrame, threshold: int = THRESHOLD, *carried: str) -> DataFrame:
    """Base columns, kept, n_grams and llr (the summed log ratio in thousandths) of every row.

    Words are found and hashed once, into a written table that both the counts and the verdicts read;
    with carried columns, which may be whole documents, they are found twice instead of written.
    """
    out = base_rules(docs.select("doc_id", "text", *carried), *carried)
    out = out if carried else written(out, "coded")
    ratios = log_ratios(out, trusted_ids(labels))
    out = out.withColumn("grams", _grams("codes")) if ratios else out.withColumn("grams", F.expr("cast(array() as array<int>)"))
    weights = F.from_json(F.lit(str(ratios or [0] * BUCKETS)), "array<int>")
    out = out.withColumn("llr", F.aggregate("grams", F.lit(0).cast("long"), lambda a, b: a + F.get(weights, b)))
    out = out.withColumn("n_grams", F.size("grams").cast("long"))
    # The last term is always true; with it Catalyst doesn't copy all of the above into a filter on kept.
    kept = ~F.col("base_failed") & (F.col("llr") >= threshold * F.col("n_grams")) & (F.spark_partition_id() >= 0)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "llr", "n_grams", *carried)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP6_SQL = f"""
with d as (
  select doc_id, coalesce(text, '') as text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as ws
  from documents
), c as (
  select *, len(ws) as n, list_transform(ws, lambda w: ('0x' || substr(md5(w), 1, 4))::int) as codes,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines
  from d
), g as (
  select doc_id, unnest(list_concat(
    list_transform(codes, lambda x: x % {HALF}),
    list_transform(range(1, n), lambda i: {HALF} + (codes[i] * 31 + codes[i + 1]) % {HALF}))) as bucket
  from c
), good as (
  select doc_id from (select distinct doc_id from labels where quality = 1 and doc_id is not null) order by md5(cast(doc_id as varchar)), doc_id limit {TRUSTED}
), k as (
  select bucket, count(*) as raw, count(*) filter (doc_id in (select doc_id from good)) as target from g group by bucket
), t as (
  select sum(raw) as all_raw, sum(target) as all_target from k
), f as (
  select bucket, cast(floor(1000 * (ln((target + 1)::double / (raw + 1)) + ln((all_raw + {BUCKETS})::double / (all_target + {BUCKETS}))) + 0.5) as bigint) as weight from k, t
), s as (
  select doc_id, cast(sum(weight) as bigint) as llr, count(*) as n_grams from g join f using (bucket) group by doc_id
), w as (
  select doc_id, i, array_to_string(ws[i : i + {WINDOW - 1}], ' ') as win from c, unnest(range(1, n - {WINDOW - 2})) as u(i)
), r as (
  select doc_id, i from w qualify count(*) over (partition by doc_id, win) > 1
), v as (
  select doc_id, count(distinct i + j) as n_repeat_words from r, unnest(range(0, {WINDOW})) as u(j) group by doc_id
), b as (
  select c.doc_id, n as n_words, cast(list_sum(list_transform(ws, lambda x: length(x))) as bigint) as word_chars,
         cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
         cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
         coalesce(llr, 0) as llr, coalesce(n_grams, 0) as n_grams
  from c left join v using (doc_id) left join s using (doc_id)
)
select doc_id, n_words, coalesce(word_chars, 0) as word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
       not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and llr >= {THRESHOLD} * n_grams as kept, llr, n_grams
from b
"""
