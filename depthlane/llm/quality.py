"""Quality rules with cross-document line frequency, in DataFrame operations only.

Base rules see one text. The cross-document rule hashes each line (ASCII lower case, white space collapsed), counts per host
(`source`) in how many distinct documents it occurs, and removes lines above the host's limit, max(MIN_DOCUMENTS,
PERCENT of the host's distinct documents). A document that keeps under LEFT_PERCENT of its words is depleted and rejected.
Exact copies must not make their own text look like boilerplate, so documents count as distinct by a hash of their whole
text (ASCII lower case, white space collapsed). Nothing else collapses: near copies count each.

Null texts have no words and fail the base rules; a null source is a host of its own. Repeated rows are judged each. An
empty table gives no rows. Columns of the input travel in one struct, so that no name of theirs meets one of the rules':
`judge` returns them beside its own, whose names win where both have one; `cleaned` returns the input's columns only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise

MIN_DOCUMENTS, PERCENT, LEFT_PERCENT, LEAST_WORDS = 20, 1, 30, 50
_WS = "[\\\\x20\\\\x09-\\\\x0D]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OWN = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words"]


def _low(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_LOWER}')"


def _mark(line: str) -> str:
    return f"xxhash64({_low(f'''trim(regexp_replace({line}, '{_WS}+', ' '))''')})"


def _base(df: DataFrame) -> DataFrame:
    """Adds the base columns of each text t, its line hashes with their words, and its document key."""
    df = df.withColumn("words", F.expr(f"filter(split(t, '{_WS}+'), w -> w <> '')"))
    df = df.withColumn("lines", F.expr("filter(split(t, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')"))
    df = df.withColumns({
        "n_words": F.size("words").cast("long"),
        "word_chars": F.expr("cast(char_length(translate(t, ' \\t\\n\\u000B\\u000C\\r', '')) as bigint)"),
        "n_symbols": F.expr("cast(char_length(t) - char_length(translate(t, '#*$%&|<>', '')) as bigint)"),
        "n_dup_lines": F.expr("cast(size(lines) - size(array_distinct(lines)) as bigint)"),
        "hashes": F.expr("case when size(words) >= 3 then transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])) else cast(array() as array<bigint>) end"),
        "marks": F.expr(f"transform(lines, l -> struct({_mark('l')} as h, cast(size(split(trim(regexp_replace(l, '{_WS}+', ' ')), ' ')) as bigint) as w))"),
        "doc": F.expr(f"xxhash64({_low('''array_join(words, ' ')''')})"),
    })
    # hashes only say that nothing repeats; where they repeat, the windows themselves are compared
    df = df.withColumn("ordered", F.expr(
        "case when size(array_distinct(hashes)) < size(hashes) then array_sort(transform(sequence(0, size(words) - 3), "
        "i -> struct(concat_ws(' ', words[i], words[i + 1], words[i + 2]) as g, i as i))) end"))  # fmt: skip
    df = df.withColumn("again", F.expr(
        "case when ordered is not null then array_sort(transform(filter(transform(ordered, (x, k) -> struct(x.i as i, "
        "(k > 0 and ordered[greatest(k - 1, 0)].g = x.g) or (k + 1 < size(ordered) and ordered[least(k + 1, size(ordered) - 1)].g = x.g) as twice)), y -> y.twice), y -> y.i)) end"))  # fmt: skip
    df = df.withColumn("n_repeat_words", F.expr(
        "cast(case when coalesce(size(again), 0) <= 0 then 0 else 3 + aggregate(zip_with(slice(again, 1, size(again) - 1), slice(again, 2, size(again)), "
        "(a, b) -> least(3, b - a)), 0, (s, d) -> s + coalesce(d, 0)) end as bigint)"))  # fmt: skip
    df = df.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return df.drop("t", "words", "lines", "hashes", "ordered", "again")


def _judged(documents: DataFrame, host: str, columns: list[str]) -> DataFrame:
    """The named columns of documents in the struct `input`, the rules' own columns, and the hashes of the removed lines."""
    plain = [F.col(f"`{c}`") for c in columns]
    rows = documents.select(
        (F.struct(*plain) if plain else F.struct(F.lit(0))).alias("input"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"),
        F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit("")).alias("host"), F.monotonically_increasing_id().alias("row"),
    )
    rows = materialise(_base(rows), "quality")
    lines = rows.select("row", "host", "doc", F.explode("marks").alias("m")).select("row", "host", "doc", F.col("m.h").alias("h"), F.col("m.w").alias("w"))
    distinct = F.countDistinct("doc")
    hosts = rows.groupBy("host").agg(distinct.alias("docs"))
    counts = lines.groupBy("host", "h").agg(distinct.alias("n")).where(F.col("n") > MIN_DOCUMENTS)
    frequent = materialise(counts.join(hosts, "host").where(100 * F.col("n") > PERCENT * F.col("docs")).select("host", "h"), "quality-lines")
    removed = lines.join(frequent, ["host", "h"]).groupBy("row").agg(F.sum("w").alias("removed_words"), F.collect_set("h").alias("removed"))
    out = rows.join(removed, "row", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
    return out.withColumn("kept", ~F.col("base_failed") & (100 * (F.col("n_words") - F.col("removed_words")) >= LEFT_PERCENT * F.col("n_words")))


def judge(documents: DataFrame, *, host: str = "source") -> DataFrame:
    """The columns of documents but text and those named like one of OWN, then those of OWN: what the rules found."""
    columns = [c for c in documents.columns if c != "text" and c not in OWN]
    return _judged(documents, host, columns).select(*[F.col(f"input.`{c}`") for c in columns], *OWN)


def cleaned(documents: DataFrame, *, host: str = "source") -> DataFrame:
    """The kept documents, their columns as they are but for the text, which loses the lines above the limit, and n_chars,
    where there is one, made to fit."""
    out = _judged(documents, host, documents.columns).where("kept")
    text = F.expr(f"case when removed is null then input.text else array_join(filter(split(input.text, '\\n'), l -> not array_contains(removed, {_mark('l')})), '\\n') end")
    out = out.withColumn("text", text.cast(documents.schema["text"].dataType))
    own = {"text": F.col("text")}
    if "n_chars" in documents.columns:
        own["n_chars"] = F.char_length("text").cast(documents.schema["n_chars"].dataType)
    return out.select(*[own.get(c, F.col(f"input.`{c}`")).alias(c) for c in documents.columns])


#: The same in DuckDB's SQL over documents, for op4's columns.
ORACLE = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce('=' || source, '') AS host, row_number() OVER () AS rid FROM documents),
w AS (SELECT doc_id, host, rid, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
b AS (SELECT doc_id, host, rid, words, lines, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, translate(array_to_string(words, ' '), '{_UPPER}', '{_LOWER}') AS doc FROM w),
at_ AS (SELECT rid, words, unnest(range(1, n_words - 1)) AS i FROM b WHERE n_words >= 3),
win AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i], words[i + 1], words[i + 2]) AS times FROM at_),
rep AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM win, (SELECT unnest([0, 1, 2]) AS k) WHERE times > 1 GROUP BY 1),
ln AS (SELECT rid, host, doc, unnest(lines) AS l FROM b),
ls AS (SELECT rid, host, doc, translate(trim(regexp_replace(l, '[\\x20\\x09-\\x0D]+', ' ', 'g')), '{_UPPER}', '{_LOWER}') AS line FROM ln),
fr AS (SELECT host, line FROM (SELECT host, line, count(DISTINCT doc) AS n FROM ls GROUP BY 1, 2) JOIN (SELECT host, count(DISTINCT doc) AS docs FROM b GROUP BY 1) USING (host)
  WHERE n > {MIN_DOCUMENTS} AND 100 * n > {PERCENT} * docs),
rm AS (SELECT rid, CAST(sum(len(string_split(line, ' '))) AS BIGINT) AS removed_words FROM ls JOIN fr USING (host, line) GROUP BY 1),
j AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed_words, 0) AS removed_words FROM b LEFT JOIN rep USING (rid) LEFT JOIN rm USING (rid)),
f AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * (n_words - removed_words) >= {LEFT_PERCENT} * n_words AS kept, removed_words FROM f"""
