"""Scalar text and date functions: Column -> Column, all built-in, so whole-stage code generation keeps them."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom.functions.patterns import MONTHS, TITLE_PREFIXES

WORD = r"[^\x20\x09-\x0D]+"
_SPACE = r"[\x20\x09-\x0D]+"


def words(t: Column) -> Column:
    """Words of a text as an array; none for null or blank."""
    return F.coalesce(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def n_words(t: Column) -> Column:
    return F.coalesce(F.regexp_count(t, F.lit(WORD)), F.lit(0)).cast("long")


def n_chars(t: Column) -> Column:
    return F.coalesce(F.length(t), F.lit(0)).cast("long")


def n_matches(t: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(t, F.lit(pattern)), F.lit(0)).cast("long")


def n_sentences(t: Column) -> Column:
    """Sentence ends followed by a capital, plus one; at least one."""
    return F.lit(1) + n_matches(t, r"[.!?][\x20\x09-\x0D]+[A-ZĂÂÎȘȚŞŢÀ-ÖØ-Þ]")


def squeeze(t: Column) -> Column:
    return F.trim(F.regexp_replace(t, _SPACE, " "))


def truncate_words(t: Column, n: int) -> Column:
    """First n words joined by blanks; texts that are short enough stay as they are."""
    return F.when(n_words(t) <= n, t).otherwise(F.array_join(F.slice(words(t), 1, n), " "))


def truncate_sentence(t: Column, n: int) -> Column:
    """truncate_words with a full stop where the cut text has no end mark."""
    cut = F.array_join(F.slice(words(t), 1, n), " ")
    return F.when(n_words(t) <= n, t).when(cut.rlike(r"[.!?]$"), cut).otherwise(F.concat(cut, F.lit(".")))


def tidy_quotes(t: Column) -> Column:
    """Typographic quotes and dashes to plain ones, blanks squeezed."""
    return squeeze(F.translate(t, "„”“«»’‘–—\u00a0", "\"\"\"\"\"''-- "))


@F.pandas_udf(StringType())
def nfc(t: pd.Series) -> pd.Series:
    """Unicode composition, for which Spark has no built-in."""
    return t.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(StringType())
def nfkc(t: pd.Series) -> pd.Series:
    return t.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def dedup_key(t: Column) -> Column:
    """Lower case, everything but letters, digits and underscores to blanks, squeezed (apply nfkc first where texts need it)."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def short_digest(t: Column, kind: str = "sha1", n: int = 16) -> Column:
    full = {"sha1": F.sha1(t), "md5": F.md5(t), "sha256": F.sha2(t, 256)}[kind]
    return F.substring(full, 1, n)


def trim_tail(t: Column) -> Column:
    """Loose punctuation at the end away, one full stop where no end mark is left."""
    cut = F.trim(F.regexp_replace(squeeze(t), r"[\s,;:/.\-]+$", ""))
    return F.when((cut == "") | cut.rlike(r"[.!?]$"), cut).otherwise(F.concat(cut, F.lit(".")))


def cut_tail_from(t: Column, pattern: str, after: float) -> Column:
    """Cut from the first match on if it starts beyond this share of the text."""
    at = F.length(F.split(t, pattern, 2)[0])
    return F.when(t.rlike(pattern) & (at > F.lit(after) * F.length(t)), F.substring(t, F.lit(1), at)).otherwise(t)


def strip_title_prefix(t: Column, prefixes: Iterable[str] = TITLE_PREFIXES) -> Column:
    """A known prefix away where no lower-case letter follows; a title that is just the prefix stays."""
    return F.regexp_replace(t, "^(?:" + "|".join(prefixes) + r")(?=[^\p{Ll}])[\s:]*(?=.)", "")


def trim_orphan_quotes(t: Column) -> Column:
    """Closing quotes at the end that outnumber the opening ones."""
    for close, open_ in (("”", "„"), ("»", "«")):
        extra = F.greatest(F.lit(0), (F.length(t) - F.length(F.replace(t, F.lit(close), F.lit("")))) - (F.length(t) - F.length(F.replace(t, F.lit(open_), F.lit("")))))
        run = F.length(F.regexp_extract(t, f"({close}*)$", 1))
        t = F.rtrim(F.substring(t, F.lit(1), F.length(t) - F.least(extra, run)))
    return t


def letter_share(t: Column, of_all: bool = True) -> Column:
    """Letters among all characters, or among those that aren't white space; 0 for nothing."""
    base = t if of_all else F.regexp_replace(t, r"\s", "")
    return F.coalesce(F.try_divide(F.length(F.regexp_replace(t, r"[^\p{L}]", "")).cast("double"), F.length(base).cast("double")), F.lit(0.0))


def capital_share(t: Column) -> Column:
    """Words but the first that begin with a capital and aren't all capitals, of those words; 0 under ten words."""
    w = words(t)
    inner = F.slice(w, 2, 1_000_000)
    capital = F.filter(inner, lambda x: x.rlike(r"^\p{Lu}") & (x != F.upper(x)))
    return F.when(F.size(w) >= 10, F.size(capital) / F.size(inner).cast("double")).otherwise(F.lit(0.0))


def matched(t: Column, patterns: dict[str, str]) -> Column:
    """Names of the patterns that a lower-cased text matches, in their order."""
    low = F.lower(t)
    return F.filter(F.array(*[F.when(low.rlike(p), F.lit(n)) for n, p in patterns.items()]), lambda x: x.isNotNull())


def any_of(patterns: Iterable[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def seeds_in(t: Column, seeds: Iterable[str]) -> Column:
    """JSON list of the seeds that a text contains, whatever their case."""
    low = F.lower(t)
    return F.to_json(F.filter(F.array(*[F.when(low.contains(s.lower()), F.lit(s)) for s in seeds]), lambda x: x.isNotNull()))


def ablate(t: Column, pattern: str, by: str = " ") -> Column:
    return F.regexp_replace(t, pattern, by)


def without_words(t: Column, drop: Column) -> Column:
    """A text without the words that, lower-cased and stripped of punctuation, are in the array."""
    return F.array_join(F.filter(words(t), lambda w: ~F.array_contains(drop, F.lower(F.regexp_replace(w, r"^[.,!?;:\"']+|[.,!?;:\"']+$", "")))), " ")


def assemble(title: Column, body: Column) -> Column:
    """Title, a full stop if it has no end mark, and body."""
    return F.concat(title, F.when(title.rlike(r"[.!?]$"), F.lit(" ")).otherwise(F.lit(". ")), body)


def month_date(t: Column) -> Column:
    """'5 martie 2024' anywhere in a text -> '2024-03-05', else null."""
    at = rf"(?i)(\d{{1,2}})\s+({'|'.join(MONTHS)})\s+(\d{{4}})"
    names = F.create_map(*[x for m, i in MONTHS.items() for x in (F.lit(m), F.lit(f"{i:02d}"))])
    day, month, year = (F.regexp_extract(t, at, i) for i in (1, 2, 3))
    return F.when(day != "", F.concat_ws("-", year, names[F.lower(month)], F.lpad(day, 2, "0")))


def dotted_timestamp(t: Column) -> Column:
    """'05.03.2024 10:20' -> timestamp, null where it isn't one."""
    return F.try_to_timestamp(t, F.lit("dd.MM.yyyy HH:mm"))


def day_gap(start: Column, end: Column) -> Column:
    """Days as a fraction."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(86_400_000_000.0)
