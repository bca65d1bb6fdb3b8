"""Quality rules, line first (native: DataFrame functions only).

Each line is judged by three rules: punctuation (a line that is shouted, that carries junk symbols, or that
is one or two words and does not end like a sentence), navigation (a line cut up by separators) and
boilerplate (stock phrases of web pages and licences, in four languages). Lines that many documents share are
no sign of it here: copies of clean documents share all of theirs. Lines that fail are removed; a document that loses too much of its
words with them is rejected, as is one that fails the base rules.

Defined results: a null text counts as empty and fails the base rules; ties don't arise (each row is judged alone,
so repeated rows give repeated results); empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick

#: Words are runs of anything but the ASCII blanks.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED = 20
#: Shares are of a line's words.
MAX_JUNK_SHARE = 0.25
MAX_SEPARATOR_SHARE = 0.25
#: A document is rejected if its removed lines hold more than this share of its words.
MAX_LOST_SHARE = 0.5
#: Stock phrases of web pages and licence lines, in the four languages; in any case, but for accents, of which both are named.
BOILERPLATE = "(?i)" + "|".join([
    "lorem ipsum", "all rights reserved", "terms of (use|service)", "privacy policy", "cookie policy", "use of cookies", "enable javascript", "click here to", "sign up for our newsletter",
    "(licensed|released) under (the|cc|a) ",
    "alle rechte vorbehalten", "nutzungsbedingungen", "allgemeine gesch[äÄ]ftsbedingungen", "datenschutzerkl[äÄ]rung", "verwendung von cookies", "newsletter abonnieren",
    "tous droits r[éÉ]serv[éÉ]s", "conditions (g[éÉ]n[éÉ]rales|d.utilisation)", "politique de confidentialit[éÉ]", "utilisation de(s)? cookies", "mentions l[éÉ]gales", "cliquez ici",
    "todos los derechos reservados", "t[éÉ]rminos y condiciones", "pol[íÍ]tica de (privacidad|cookies)", "aviso legal", "uso de cookies", "haga clic aqu[íÍ]",
])
#: A cheap look for any of the phrases, on the lower-cased line.
STOCK = "lorem|reserv|droits|terms of|privacy|cookie|javascript|click here|newsletter|under (?:the|cc|a) |vorbehalten|bedingungen|datenschutz|conditions|confidentialit|mentions l|cliquez|condiciones|privacidad|aviso legal|haga clic"


def bind(value: Column, fn) -> Column:
    """fn of a value that is computed once for each row."""
    return F.transform(F.array(value), fn)[0]


def _count(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words within windows of ``width`` words that occur twice or more in ``words``, the first occurrence included.

    Windows are compared by a 64-bit hash of a hash of each word. Only a text with a repeat sorts its windows.
    """
    n = F.size(words)

    def covered(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def marks(s: Column) -> Column:
            same = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
            hit = F.filter(s, lambda x, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
            at = F.array_sort(F.transform(hit, lambda x: x["i"]))
            gaps = lambda p: F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(width)), F.lit(width)))
            return F.aggregate(bind(at, gaps), F.lit(0), lambda a, x: a + x)

        return bind(ordered, marks)

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(width))))

    def judged(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h))

    hashed = F.transform(words, lambda x: F.xxhash64(x))
    return F.when(n < width, F.lit(0)).otherwise(bind(bind(hashed, windows), judged))


def base_columns(text: Column, words: Column) -> dict[str, Column]:
    """The base counts of whole texts; words: words_of(text)."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return {
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long"),
        "n_dup_lines": bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def line_fails(line: Column) -> Column:
    """True for a line that any of the three rules removes. Each rule first asks what few lines meet, then counts."""
    n_words = F.size(words_of(line))
    junk = line.rlike(r"[#*$%&<>]{2}|!!") & (_count(line, r"[#*$%&<>]{2,}|!!") > MAX_JUNK_SHARE * n_words)
    shouted = ~line.rlike("[a-z]") & line.rlike(r"(?:[A-Z][^A-Z]*){20}")
    short = line.rlike(r"^[\x20\x09-\x0D]*[^\x20\x09-\x0D]+(?:[\x20\x09-\x0D]+[^\x20\x09-\x0D]+)?[\x20\x09-\x0D]*$")
    open_end = short & ~line.rlike(r"""[.!?:;…。！？]["'”’)\]]*[\x20\x09-\x0D]*$""")
    navigation = line.rlike("[|»›•]") & (_count(line, "[|»›•]") > MAX_SEPARATOR_SHARE * n_words)
    return shouted | open_end | junk | navigation | (F.lower(line).rlike(STOCK) & line.rlike(BOILERPLATE))


def lost_words(text: Column) -> Column:
    """Words of the lines that fail."""
    failed = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD) & line_fails(x))
    return F.aggregate(failed, F.lit(0), lambda a, x: a + F.size(words_of(x))).cast("long")


def kept_lines(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(WORD) | ~line_fails(x)), "\n")


def clean_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row for each row of df: id, n_words, base counts, base_failed, lost_words, kept and, if asked, cleaned_text."""
    t = pick(df, doc_id=id_col, text=text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    text, words = F.col("text"), F.col("words")
    split = t.select("doc_id", "text", words_of(text).alias("words"))
    flat = split.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), *(c.alias(k) for k, c in base_columns(text, words).items()),
        repeated_words(words).cast("long").alias("n_repeat_words"), lost_words(text).alias("lost_words"),
        *([kept_lines(text).alias("cleaned_text")] if with_text else []),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    kept = ~failed & (F.col("lost_words") <= MAX_LOST_SHARE * F.col("n_words"))
    return flat.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"),
        "lost_words", *(["cleaned_text"] if with_text else []),
    )


def op2_line_cleaning(spark, sf_dir: str) -> DataFrame:
    return clean_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)


OP2_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
r AS (SELECT row_number() OVER () AS r, * FROM w),
win AS (SELECT r, i, list_slice(words, i, i + 4) AS g FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM r)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, sum(least(coalesce(nxt - i, 5), 5))::BIGINT AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM rep) GROUP BY r),
ln AS (SELECT r, x, len(list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) AS n,
              regexp_replace(x, '[^A-Z]', '', 'g') AS letters FROM (SELECT r, unnest(lines) AS x FROM r)),
bad AS (SELECT r, sum(n)::BIGINT AS lost FROM ln
        WHERE len(regexp_extract_all(x, '[#*$%&<>]{2,}|!!')) > 0.25 * n
           OR (length(letters) >= 20 AND NOT regexp_matches(x, '[a-z]'))
           OR (n < 3 AND NOT regexp_matches(x, '[.!?:;…。！？]["''”’)\]]*[\x20\x09-\x0D]*$'))
           OR len(regexp_extract_all(x, '[|»›•]')) > 0.25 * n
           OR regexp_matches(x, 'BOILERPLATE')
        GROUP BY r),
f AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(cov.n, 0) AS n_repeat_words, coalesce(bad.lost, 0) AS lost_words
      FROM r LEFT JOIN cov USING (r) LEFT JOIN bad USING (r)),
g AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND lost_words <= 0.5 * n_words AS kept, lost_words
FROM g
""".replace("BOILERPLATE", BOILERPLATE)
