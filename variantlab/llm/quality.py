"""Line-first quality rules, in DataFrame functions only.

Every line is judged by punctuation, navigation and boilerplate rules; failing lines are removed,
then a document that has lost too much of its text is rejected, as is one that fails the base
rules (too few words, or too many words in 8-word windows that the text repeats).

Nulls and empty texts have no words and are rejected.  Repeated rows and rows without doc_id are judged
row by row, very long texts whole.  An empty table gives an empty result; other columns, whatever their
names, are kept by `cleaned` and not read by `quality_report`.  The plan is one scan and one projection, so no key or source can be hot, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fewest words; most words in repeated windows, in hundredths; words of a window.
MIN_WORDS, MAX_REPEAT, WINDOW = 20, 30, 8
#: The smallest share of word characters that must survive line cleaning.
MIN_LEFT = 0.5
#: Most symbols, and most doubled exclamation marks, in hundredths of a line's characters.
MAX_SYMBOLS, MAX_SHOUTS = 8, 8

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|›»•"
BOILERPLATE = (
    r"all rights reserved|licensed under|released under|terms of (use|service)|privacy policy|cookie (policy|settings)"
    r"|we use cookies|click here|sign up|log in|subscribe to|follow us|enable javascript|lorem ipsum"
)
#: What closes a line; and two sentence ends inside one, which makes it running text even if it breaks off.
TERMINAL = "[.!?:;…][\"'”’»)\\]]*[\\x20\\x09-\\x0D]*$"

RUNNING = r"[.!?]\x20[^.!?]+[.!?]\x20"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def occurrences(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """Words that lie in a window of `size` words found twice or more, each counted once."""

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.xxhash64(F.slice(w, i, size)))

    def positions(s: Column) -> Column:
        twin = lambda e, j: F.coalesce(F.get(s, j - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == e["h"], F.lit(False))
        return F.sort_array(F.filter(F.transform(s, lambda e, j: F.when(twin(e, j), e["i"])), lambda x: x.isNotNull()))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(size), F.coalesce(F.get(p, j + 1) - x, F.lit(size)))), F.lit(0), lambda a, b: a + b)

    by_hash = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    count = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(by_hash(h), lambda s: let(positions(s), covered)))
    return F.when(F.size(words) < size + 1, F.lit(0)).otherwise(let(hashes(words), count))


def failing_line(line: Column) -> Column:
    """True for a line that a rule removes; a line without words stays."""
    bare = F.length(F.translate(line, SPACES, ""))
    n = F.length(line)
    separators = occurrences(line, SEPARATORS)
    navigation = (separators >= 3) & (separators * 25 >= n)
    symbols = occurrences(line, SYMBOLS) * 100 > n * MAX_SYMBOLS
    shouting = (n - F.length(F.replace(line, F.lit("!!"), F.lit("")))) * 100 > n * MAX_SHOUTS
    boilerplate = F.lower(line).rlike(BOILERPLATE)
    return (bare > 0) & (navigation | symbols | shouting | boilerplate | ~(line.rlike(TERMINAL) | line.rlike(RUNNING)))


def measures(text: Column) -> Column:
    """All measures of a text, as a struct; what several of them need is computed once."""
    spaces, symbols = occurrences(text, SPACES), occurrences(text, SYMBOLS)

    def of(words: Column, lines: Column, clean: Column) -> Column:
        with_word = F.filter(lines, lambda x: F.length(F.translate(x, SPACES, "")) > 0)
        return F.struct(
            F.size(words).cast("long").alias("q_n_words"),
            (F.length(text) - spaces).cast("long").alias("q_word_chars"),
            symbols.cast("long").alias("q_n_symbols"),
            let(with_word, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("q_n_dup_lines"),
            repeated_words(words).cast("long").alias("q_n_repeat_words"),
            clean.alias("q_clean_text"),
        )

    cleaned_text = lambda lines: F.array_join(F.filter(lines, lambda x: ~failing_line(x)), "\n")
    return let(words_of(text), lambda w: let(F.split(text, "\n", -1), lambda x: let(cleaned_text(x), lambda c: of(w, x, c))))


def measured(docs: DataFrame) -> DataFrame:
    """`docs` with the base counts, `q_clean_text`, `q_base_failed` and `q_kept` added; names starting with q_ are reserved.

    The measures come out of a generator, so that a filter on them can't be pushed below it, where
    they would be computed a second time.
    """
    out = docs.select("*", F.inline(F.array(measures(F.coalesce(F.col("text"), F.lit(""))))))
    clean_chars = (F.length("q_clean_text") - occurrences(F.col("q_clean_text"), SPACES)).cast("long")
    failed = (F.col("q_n_words") < MIN_WORDS) | (F.col("q_n_repeat_words") * 100 > F.col("q_n_words") * MAX_REPEAT)
    out = out.withColumns({"q_clean_chars": clean_chars, "q_base_failed": failed})
    return out.withColumn("q_kept", ~F.col("q_base_failed") & (F.col("q_clean_chars") >= F.col("q_word_chars") * MIN_LEFT))


def quality_report(docs: DataFrame) -> DataFrame:
    """One row per document: the base counts and the verdict, with the characters that cleaning left."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_chars")
    return measured(docs.select("doc_id", "text")).select("doc_id", *[F.col(f"q_{x}").alias(x) for x in names])


def cleaned(docs: DataFrame) -> DataFrame:
    """The documents that pass, without their failing lines, in the columns of `docs`."""
    held = docs.select("text", *[F.col(f"`{c}`").alias(f"row_{i}") for i, c in enumerate(docs.columns)])  # no name of `docs` can clash
    out = measured(held).where("q_kept")
    text = F.col("q_clean_text")
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return out.select(*[new.get(c, F.col(f"row_{i}")).alias(c) for i, c in enumerate(docs.columns)])


#: The same in DuckDB.
SQL = f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select r, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as ws, string_split(text, chr(10)) as ls from d),
g as (select r, i, list_aggregate(ws[i:i + 7], 'string_agg', ' ') as g from (select r, ws, unnest(generate_series(1, len(ws) - 7)) as i from w where len(ws) > 7)),
p as (select r, i from g qualify count(*) over (partition by r, g) > 1),
n as (select r, sum(least(8, coalesce(nxt - i, 8))) as n from (select r, i, lead(i) over (partition by r order by i) as nxt from p) group by r),
l as (select r, list_filter(ls, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as wl, array_to_string(list_filter(ls, lambda x: not (
    regexp_matches(x, '[^\\x20\\x09-\\x0D]') and (
      (length(x) - length(translate(x, '{SEPARATORS}', '')) >= 3 and (length(x) - length(translate(x, '{SEPARATORS}', ''))) * 25 >= length(x))
      or (length(x) - length(translate(x, '{SYMBOLS}', ''))) * 100 > length(x) * {MAX_SYMBOLS}
      or (length(x) - length(replace(x, '!!', ''))) * 100 > length(x) * {MAX_SHOUTS}
      or regexp_matches(lower(x), '{BOILERPLATE}')
      or not (regexp_matches(x, '{TERMINAL.replace("'", "''")}') or regexp_matches(x, '{RUNNING}'))))), chr(10)) as clean from w),
m as (select w.doc_id, len(ws)::bigint as n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::bigint as word_chars,
    (length(text) - length(translate(text, '{SYMBOLS}', '')))::bigint as n_symbols,
    (len(wl) - len(list_distinct(wl)))::bigint as n_dup_lines, coalesce(n.n, 0)::bigint as n_repeat_words,
    length(regexp_replace(clean, '[\\x20\\x09-\\x0D]', '', 'g'))::bigint as clean_chars
  from w join l using (r) left join n using (r))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {MIN_WORDS} or n_repeat_words * 100 > n_words * {MAX_REPEAT}) as base_failed,
  (not (n_words < {MIN_WORDS} or n_repeat_words * 100 > n_words * {MAX_REPEAT}) and clean_chars >= word_chars * {MIN_LEFT}) as kept, clean_chars
from m
"""
