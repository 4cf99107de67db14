"""Line-first quality rules: lines are judged one by one, failing lines go, documents that lose too much go whole."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

# Fixed values of the operator's contract.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Marks that may end a line of prose, closing quotes and brackets included.
TERMINAL = ".!?:;…。！？\"'”’»)]"
#: Marks that separate the items of a navigation line.
SEPARATORS = "|>•·»"
#: A line of this many words need not end in a terminal mark (texts cut off, hard-wrapped texts).
LONG_LINE = 20
#: Share of the word characters that may be lost before a document is rejected, in percent.
MAX_LOST_PERCENT = 50
#: Phrases of boilerplate lines, in lower case.
BOILERPLATE = ("all rights reserved", "privacy policy", "cookie policy", "we use cookies", "terms of use", "terms of service", "enable javascript", "lorem ipsum", "subscribe to our", "sign up for", "click here", "share this", "licensed under", "released under")

_FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("n_lines_removed", pa.int64()), ("chars_removed", pa.int64()), ("kept", pa.bool_()), ("clean_text", pa.string())]
_DDL = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_lines_removed long, chars_removed long, kept boolean, clean_text string"


def line_fails(line: str, n_words: int) -> bool:
    """Whether a line with words breaks a rule of punctuation, navigation or boilerplate."""
    end = line.rstrip(SPACES)[-1]
    if end not in TERMINAL and n_words < LONG_LINE:
        return True
    if 2 * line.count("!!") >= n_words and n_words >= 2:
        return True
    if 2 * sum(map(line.count, SYMBOLS)) > n_words and n_words >= 2:
        return True
    if (n := sum(map(line.count, SEPARATORS))) >= 2 and 6 * n >= n_words:
        return True
    low = line.lower()
    return any(x in low for x in BOILERPLATE)


def repeat_words(words: list) -> int:
    """Words that lie in a 3-word window found twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen, again = set(), set()
    for x in windows:
        (again if x in seen else seen).add(x)
    covered, upto = 0, 0
    for i, x in enumerate(windows):
        if x in again:
            covered += i + 3 - max(upto, i)
            upto = i + 3
    return covered


def judge(text: str | None) -> tuple:
    """The row of _FIELDS for one text."""
    text = text or ""
    words = text.encode().split()  # bytes split at exactly the six ASCII white-space characters
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    lines = text.split("\n")
    with_words = [(i, x, k) for i, x in enumerate(lines) if (k := len(x.encode().split()))]
    repeats = repeat_words(words)
    base = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
    bad = {i for i, x, k in with_words if line_fails(x, k)}
    lost = sum(len(lines[i]) - sum(map(lines[i].count, SPACES)) for i in bad)
    kept = not base and 100 * lost <= MAX_LOST_PERCENT * chars
    clean = "\n".join(x for i, x in enumerate(lines) if i not in bad) if bad else text
    return n, chars, sum(map(text.count, SYMBOLS)), len(with_words) - len({x for _, x, _ in with_words}), repeats, base, len(bad), lost, kept, clean


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Base statistics, lines removed, verdict and (with_text) the text without its failing lines, one row for each row.

    No shuffle: a row's result depends on that row alone; memory is one Arrow batch. A null text counts as empty, an
    empty text has no words and fails the base rules; repeated rows give repeated results; other columns are not read.
    """
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = [judge(x) for x in part.column(1).to_pylist()]
                columns = list(zip(*rows))
                if not with_text:
                    columns[-1] = [None] * len(rows)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS))], names=[id_col, *(n for n, _ in _FIELDS)])

    out = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind.simpleString()}, {_DDL}")
    return out if with_text else out.drop("clean_text")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(read_table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    quote = lambda x: x.replace("'", "''")
    count = lambda col, marks: " + ".join(f"(length({col}) - length(replace({col}, '{quote(m)}', ''))) // {len(m)}" for m in marks)
    word = r"[^\x20\x09-\x0D]+"
    chars = lambda col: rf"length(regexp_replace({col}, '[\x20\x09-\x0D]', '', 'g'))"
    ends = "'" + quote(TERMINAL) + "'"
    return f"""
        with d as (select doc_id, coalesce(text, '') as text from documents),
        w as (select doc_id, text, regexp_extract_all(text, '{word}') as words from d),
        base as (select doc_id, cast(len(words) as bigint) as n_words, cast({chars('text')} as bigint) as word_chars, cast({count('text', SYMBOLS)} as bigint) as n_symbols from w),
        t as (select doc_id, i, words[i] as a, words[i + 1] as b, words[i + 2] as c from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from w)),
        rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, a, b, c) as n from t) where n > 1),
        r as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as p from rep) group by doc_id),
        l as (select doc_id, line, len(regexp_extract_all(line, '{word}')) as k from (select doc_id, unnest(string_split(text, chr(10))) as line from d)),
        j as (select doc_id, line, (
                (k < {LONG_LINE} and not contains({ends}, right(regexp_replace(line, '[\\x20\\x09-\\x0D]+$', ''), 1)))
                or (k >= 2 and 2 * ({count('line', ['!!'])}) >= k)
                or (k >= 2 and 2 * ({count('line', SYMBOLS)}) > k)
                or (({count('line', SEPARATORS)}) >= 2 and 6 * ({count('line', SEPARATORS)}) >= k)
                or {' or '.join(f"contains(lower(line), '{x}')" for x in BOILERPLATE)}) as bad
            from l where k > 0),
        g as (select doc_id, cast(count(*) - count(distinct line) as bigint) as n_dup_lines, sum(case when bad then {chars('line')} else 0 end) as lost from j group by doc_id),
        f as (select base.*, coalesce(n_dup_lines, 0) as n_dup_lines, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words, coalesce(lost, 0) as lost
            from base left join g using (doc_id) left join r using (doc_id))
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
            n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed,
            not (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) and 100 * lost <= {MAX_LOST_PERCENT} * word_chars as kept
        from f"""


QUERIES = {"op3_quality_rules": op3_quality_rules}
SQL = {"op3_quality_rules": _sql()}
