"""Line-first cleaning: lines that fail a rule go, then documents that lose too much text. Column expressions only.

Rules of a line that holds a word:

* navigation: three separators of menus or more, and one for four words or more, or nothing but the name of a usual link;
* boilerplate: a notice of rights, licences, cookies or scripts in a line of 160 characters at most;
* punctuation: its last character is no mark that ends a sentence or a list item, a tenth or more of its characters are
  symbols, or it has more exclamation and question marks than words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import bound, stripped, words_of

#: Marks that may end a line of running text.
ENDINGS = (".", "!", "?", "…", ":", ";", "\"", "'", "”", "’", "»", ")", "]", "。", "！", "？")
SYMBOLS = "#*$%&|<>"
SIGNS = SYMBOLS + "~^{}\\="
SEPARATORS = "|»›•·"
MARKS = "!?"
LINKS = (
    r"(?i)^[^a-z0-9]*(?:home|menu|search|log ?in|sign ?in|sign ?up|register|next|previous|back to top|contact us|about us|"
    r"site ?map|skip to content|read more|share this|print this page)[^a-z0-9]*$"
)
NOTICES = (
    r"(?i)(?:all rights reserved|copyright \(c\)|©|terms of (?:use|service)|privacy policy|cookie policy|(?:uses|accept|enable) cookies|"
    r"javascript is (?:disabled|required)|enable javascript|subscribe to (?:our|the) newsletter|lorem ipsum|licensed under|"
    r"released under the|powered by)"
)
NOTICE_CHARS = 160
MOST_LOST = 30
LEAST_WORDS = 50
MOST_REPEATED = 50
SHORT = 3


def _only(text: Column, characters: str) -> Column:
    """The characters of a text that are among the given ones."""
    escaped = "".join("\\" + c for c in characters)
    return F.regexp_replace(text, f"[^{escaped}]+", "")


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _word_chars(text: Column) -> Column:
    return F.length(F.array_join(words_of(text), "")).cast("long")


def repeated_words(words: Column, window: int = SHORT) -> Column:
    """How many words lie in a window of ``window`` words that the text holds twice or more, the first one included.

    Windows are sorted with their places, so equal ones are neighbours; the places of windows with an equal neighbour, in
    order, cover up to ``window`` words each beyond the one before. Windows are told apart by a hash of 64 bits.
    """
    def covered(windows: Column) -> Column:
        def equal_neighbours(s: Column) -> Column:
            same = lambda w, i: F.coalesce(F.get(s, i)["w"] == w, F.lit(False))
            return F.filter(s, lambda x, i: same(x["w"], i - 1) | same(x["w"], i + 1))

        in_order = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        places = F.sort_array(F.transform(bound(in_order, equal_neighbours), lambda x: x["i"]))
        start = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n"))
        step = lambda at, i: F.struct(i.alias("last"), (at["n"] + F.least(F.lit(window), i - at["last"])).alias("n"))
        counted = F.aggregate(places, start, step, lambda at: at["n"])
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(counted)

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(window))))

    return F.when(F.size(words) < window, 0).otherwise(bound(windows(words), covered)).cast("long")


def failed_rule(line: Column) -> Column:
    """The name of the first rule that a line fails, or null. ``line`` is without white space at its ends."""
    def rule(odd: Column) -> Column:
        separators, signs, marks = (_count(odd, c) for c in (SEPARATORS, SIGNS, MARKS))
        n_words = F.size(words_of(line))
        menu = (separators >= 3) & (4 * separators >= n_words)
        loud = (10 * signs >= F.length(line)) | (marks > 0) & (marks > n_words)
        return (
            F.when((odd != "") & menu | F.regexp_like(line, F.lit(LINKS)), "navigation")
            .when((F.length(line) <= NOTICE_CHARS) & F.regexp_like(line, F.lit(NOTICES)), "boilerplate")
            .when(~F.substring(line, -1, 1).isin(*ENDINGS) | (odd != "") & loud, "punctuation")
        )

    return bound(_only(line, SIGNS + SEPARATORS + MARKS), rule)


def cleaned(docs: DataFrame, *, key: str = "doc_id", text: str = "text", most_lost: int = MOST_LOST) -> DataFrame:
    """One row per row of ``docs``: the key, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``base_failed``, ``kept``, ``lost_chars``, ``lines_navigation``, ``lines_boilerplate``, ``lines_punctuation`` and ``cleaned``.

    Words are parted by ASCII white space, lines by line feeds. ``cleaned`` is the text without the lines that fail a
    rule (see the module); lines without a word stay. ``lost_chars`` counts code points of words in removed lines.
    A document fails the base rules with fewer than 50 words, or if over half of its words lie in a window of three words
    that it holds twice or more. It is kept if it does not fail them and loses at most ``most_lost`` per cent of
    ``word_chars``.

    A null text is an empty one: no words, base_failed, not kept, ``cleaned`` empty. A text of any length is judged whole,
    in n log n steps. Rows stand for themselves, so null, tied and repeated keys and repeated rows are all kept. An empty
    table gives no rows. Other columns are not looked at, whatever their names. No shuffle, no Python.
    """
    def judged(line: Column) -> Column:
        rule = lambda inner: F.when(inner != "", failed_rule(inner))
        return F.struct(line.alias("line"), bound(stripped(line), rule).alias("rule"))

    def lines(all_lines: Column) -> Column:
        full = F.filter(all_lines, lambda line: stripped(line) != "")
        dup = bound(full, lambda f: (F.size(f) - F.size(F.array_distinct(f))).cast("long"))
        return F.struct(dup.alias("dup"), F.transform(all_lines, judged).alias("all"))

    def words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), repeated_words(w).alias("repeated"))

    own = docs.select(F.col(key).alias("__id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__x"))
    x = F.col("__x")
    own = own.select(
        "__id", bound(words_of(x), words).alias("__w"), F.length(_only(x, SYMBOLS)).cast("long").alias("n_symbols"),
        bound(F.split(x, "\n", -1), lines).alias("__l"),
    )
    gone = F.filter("__l.all", lambda line: line["rule"].isNotNull())
    lost = F.aggregate(gone, F.lit(0).cast("long"), lambda n, line: n + _word_chars(line["line"]))
    left = F.array_join(F.transform(F.filter("__l.all", lambda line: line["rule"].isNull()), lambda line: line["line"]), "\n")
    n_words, repeated = F.col("__w.n"), F.col("__w.repeated")
    base_failed = (n_words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n_words)
    by_rule = lambda rule: F.size(F.filter("__l.all", lambda line: line["rule"] == rule)).cast("long").alias(f"lines_{rule}")
    out = own.select(
        F.col("__id").alias(key), n_words.alias("n_words"), F.col("__w.chars").alias("word_chars"), "n_symbols", F.col("__l.dup").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"), base_failed.alias("base_failed"), lost.alias("lost_chars"),
        *(by_rule(rule) for rule in ("navigation", "boilerplate", "punctuation")), left.alias("cleaned"),
    )
    return out.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= most_lost * F.col("word_chars")))


def digest(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The counts and the verdict of :func:`cleaned`, without the texts."""
    return cleaned(docs, key=key, text=text).drop("cleaned")
