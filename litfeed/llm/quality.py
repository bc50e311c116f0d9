"""Line-first quality rules (native: DataFrame functions only, no shuffle).

Each line of a text is judged by punctuation, navigation and boilerplate rules; failing lines are removed;
a document that loses too much of its text, or fails the base rules, is rejected. Punctuation is judged over lines that
belong together: a line that does not end a sentence goes on in the next one, up to a blank line, if that one does not start
with a capital letter or the line is short enough to be wrapped (at most ``WRAPPED`` characters); so hard-wrapped prose is judged like
prose in one line. A sentence has ended if a terminal stands at the line's end, before up to four closing marks and eight
blanks; a line of more than 80 blanks does not end one by itself (a line after it that is blank does).

Edge cases: null text counts as empty (no words, rejected by the base rules); a blank line is neither good nor
bad; rows are independent, so repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litfeed.llm.common import fresh, let, words

#: Rejected beyond this share of its non-blank characters.
MAX_LOST = 0.4
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"

#: A line of so many words without any sentence mark, in it or in the lines it goes on in, is no prose.
UNPUNCTUATED_WORDS = 12
#: Unicode's sentence terminals, the Tibetan shad, marks within sentences; letters of Thai and Lao, which have no such marks.
TERMINAL = (r"!.?։\x{61D}-\x{61F}\x{6D4}\x{700}-\x{702}\x{7F9}\x{837}\x{839}\x{83D}\x{83E}\x{964}\x{965}\x{F0D}\x{F0E}\x{104A}\x{104B}"
            r"\x{1362}\x{1367}\x{1368}\x{166E}\x{1735}\x{1736}\x{17D4}\x{17D5}\x{1803}\x{1809}\x{1944}\x{1945}\x{1AA8}-\x{1AAB}"
            r"\x{1B4E}\x{1B4F}\x{1B5A}\x{1B5B}\x{1B5E}\x{1B5F}\x{1B7D}-\x{1B7F}\x{1C3B}\x{1C3C}\x{1C7E}\x{1C7F}\x{2024}\x{203C}\x{203D}"
            r"\x{2047}-\x{2049}\x{2CF9}-\x{2CFB}\x{2E2E}\x{2E3C}\x{2E53}\x{2E54}。\x{A4FF}\x{A60E}\x{A60F}\x{A6F3}\x{A6F7}\x{A876}\x{A877}"
            r"\x{A8CE}\x{A8CF}\x{A92F}\x{A9C8}\x{A9C9}\x{AA5D}-\x{AA5F}\x{AAF0}\x{AAF1}\x{ABEB}\x{FE12}\x{FE15}\x{FE16}\x{FE52}\x{FE56}"
            r"\x{FE57}！．？｡\x{10A56}\x{10A57}\x{10F55}-\x{10F59}\x{10F86}-\x{10F89}\x{11047}\x{11048}\x{110BE}-\x{110C1}"
            r"\x{11141}-\x{11143}\x{111C5}\x{111C6}\x{111CD}\x{111DE}\x{111DF}\x{11238}\x{11239}\x{1123B}\x{1123C}\x{112A9}\x{113D4}\x{113D5}"
            r"\x{1144B}\x{1144C}\x{115C2}\x{115C3}\x{115C9}-\x{115D7}\x{11641}\x{11642}\x{1173C}-\x{1173E}\x{11944}\x{11946}\x{11A42}\x{11A43}"
            r"\x{11A9B}\x{11A9C}\x{11C41}\x{11C42}\x{11EF7}\x{11EF8}\x{11F43}\x{11F44}\x{16A6E}\x{16A6F}\x{16AF5}\x{16B37}\x{16B38}\x{16B44}"
            r"\x{16D6E}\x{16D6F}\x{16E98}\x{1BC9F}\x{1DA88}")
SENTENCE_MARK = rf"[{TERMINAL}:;…：；؛\x{{37E}}\x{{1364}}-\x{{1366}}\x{{E00}}-\x{{EFF}}]"
#: A line of so many characters may be one of wrapped prose even if the next one starts with a capital letter.
WRAPPED = 132
#: A line break at which no sentence goes on: after its end (and closing quotes or brackets), at a blank line, after a long line
#: before a capital letter.
SENTENCE_BREAK = (rf"\n(?:(?<=[{TERMINAL}…][\p{{Pe}}\p{{Pf}}\"'*_]{{0,4}}[\x20\t\r]{{0,8}}\n)|(?=[\x20\x09-\x0D]*(?:\n|\z))"
                  rf"|(?<=(?:\A|\n)[\x20\x09\x0B-\x0D]{{0,80}}\n)|(?<=[^\n]{{{WRAPPED + 1}}}\n)(?=[^\p{{L}}\p{{N}}\n]{{0,8}}[\p{{Lu}}\p{{Lt}}]))")
#: Share of characters that are marks of markup, code or noise.
MAX_MARKS = 0.15
MARKS = r"[#*$%&|<>{}\[\]=+~^_\\@]"
#: A shouted line: almost every letter upper case, every other word with an exclamation mark.
MAX_UPPER = 0.7
#: Separators between the entries of a menu or breadcrumb, and how many words go to each at most.
SEPARATOR = r"[|»›•→]"
MIN_SEPARATORS, WORDS_PER_ENTRY = 3, 4
#: Phrases of page furniture; a line fails if it has one and is short.
BOILERPLATE = (r"(?i)\b(accept (all )?cookies|we use cookies|this (web)?site uses cookies|cookie (policy|settings)"
               r"|enable javascript|privacy policy|terms (of use|of service|and conditions)|skip to (main )?content"
               r"|sign (in|up)|log ?in|subscribe (now|to our)|share (this|on)|follow us|read more|click here"
               r"|back to top|add to cart|lorem ipsum)\b")
BOILERPLATE_WORDS = 20


def _count(col, pattern: str):
    return F.length(col) - F.length(F.regexp_replace(col, pattern, ""))


def _words_in(line):
    return F.size(F.array_remove(F.split(line, r"[\x20\x09-\x0D]+"), ""))


def unpunctuated(line):
    """Whether one line has many words and no sentence mark."""
    # most lines have a mark that is quickly found
    return ~line.rlike("[.!?:;]") & (_words_in(line) >= UNPUNCTUATED_WORDS) & ~line.rlike(SENTENCE_MARK)


def punctuated(text):
    """For each line of a text whether a sentence mark stands in the lines that it belongs to."""
    blocks = F.split(text, SENTENCE_BREAK)
    return F.flatten(F.transform(blocks, lambda b: F.array_repeat(b.rlike(SENTENCE_MARK), F.size(F.split(b, "\n")))))


def line_fails(line, alone):
    """Whether one (non-blank) line fails a rule; ``alone``: it has many words, and no sentence mark with its neighbours."""
    n, n_chars = _words_in(line), F.length(line)
    upper, lower = _count(line, r"\p{Lu}"), _count(line, r"\p{Ll}")
    noise = _count(line, MARKS) > MAX_MARKS * n_chars
    shouted = (n >= 3) & (upper > MAX_UPPER * (upper + lower)) & (2 * _count(line, "!") >= n)
    separators = _count(line, SEPARATOR)
    navigation = (separators >= MIN_SEPARATORS) & (n <= WORDS_PER_ENTRY * separators)
    boilerplate = (n <= BOILERPLATE_WORDS) & line.rlike(BOILERPLATE)
    return alone | noise | shouted | navigation | boilerplate


def _has_word(line):
    return line.rlike(r"[^\x20\x09-\x0D]")


def measured(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` plus one struct column (its name is returned) with all measures, the verdict and the clean text."""
    out = fresh(docs, "quality")
    keep = docs.columns
    names = {k: fresh(docs, f"q_{k}") for k in ("text", "lines", "alone", "bad", "words", "wins", "covered")}
    c = {k: F.col(f"`{v}`") for k, v in names.items()}
    d = docs.withColumn(names["text"], F.coalesce(F.col(text), F.lit("")))
    d = d.withColumn(names["lines"], F.split(c["text"], "\n"))
    d = d.withColumn(names["words"], words(c["text"]))
    n = F.size(c["words"])
    d = d.withColumn(names["wins"], F.when(n >= WINDOW, let(
        F.transform(c["words"], lambda w: F.xxhash64(w)),
        lambda hashes: F.transform(F.sequence(F.lit(1), F.size(hashes) - WINDOW + 1),
                                   lambda i: F.xxhash64(F.slice(hashes, i, WINDOW))))))
    # windows found twice: sorted by hash, equal neighbours; only texts that have such a window pay for the sort
    repeated = F.size(F.array_distinct(c["wins"])) < F.size(c["wins"])
    by_hash = F.sort_array(F.transform(c["wins"], lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = lambda s: F.sort_array(F.array_compact(F.transform(s, lambda x, k: F.when(
        F.get(s, k - 1)["h"].eqNullSafe(x["h"]) | F.get(s, k + 1)["h"].eqNullSafe(x["h"]), x["i"]))))
    cover = lambda starts: F.aggregate(F.transform(starts, lambda s, k: F.least(
        F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - s, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b)
    d = d.withColumn(names["covered"], F.when(repeated, let(let(by_hash, twice), cover)).otherwise(0))
    # a letter that a rule needs is never blank, so blank lines pass all of them but are excluded for clarity
    # neighbours are looked at only in texts that have a line without marks
    loose = F.transform(c["lines"], unpunctuated)
    d = d.withColumn(names["alone"], let(loose, lambda a: F.when(F.exists(a, lambda x: x), F.zip_with(
        a, punctuated(c["text"]), lambda x, p: x & ~p)).otherwise(a)))
    d = d.withColumn(names["bad"], F.zip_with(c["lines"], c["alone"], lambda x, a: _has_word(x) & line_fails(x, a)))
    full = F.filter(c["lines"], _has_word)
    chars = lambda lines: F.length(F.array_join(lines, ""))
    kept_lines = lambda keep_bad: let(c["bad"], lambda bad: F.filter(
        c["lines"], lambda x, i: F.get(bad, i) == F.lit(keep_bad)))
    any_bad = F.exists(c["bad"], lambda b: b)
    lost = F.when(any_bad, chars(kept_lines(True))).otherwise(0)
    m = F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.translate(c["text"], " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length(c["text"]) - F.length(F.translate(c["text"], SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(full) - F.size(F.array_distinct(full))).cast("long").alias("n_dup_lines"),
        F.coalesce(c["covered"], F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(F.filter(c["bad"], lambda b: b)).cast("long").alias("n_bad_lines"),
        lost.cast("long").alias("lost_chars"),
        chars(c["lines"]).cast("long").alias("line_chars"),
        F.when(any_bad, F.array_join(kept_lines(False), "\n")).otherwise(c["text"]).alias("clean_text"))
    base = lambda q: (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEATED_PERCENT * q["n_words"])
    judged = let(m, lambda q: q.withField("base_failed", base(q)).withField(
        "kept", ~base(q) & (q["lost_chars"] <= MAX_LOST * q["line_chars"])))
    # a generator of one row: filters on its result cannot be pushed into it, so nothing is measured twice
    return d.select(*[F.col(f"`{k}`") for k in keep], F.explode(F.array(judged)).alias(out)), out


def report(docs: DataFrame) -> DataFrame:
    """One row per document: base measures, lines that failed, verdict."""
    d, q = measured(docs.select("doc_id", "text"))
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_bad_lines",
            "lost_chars"]
    return d.select("doc_id", *[F.col(f"{q}.{c}").alias(c) for c in cols])


def cleaned(docs: DataFrame) -> DataFrame:
    """The kept documents with their columns; failed lines are gone from ``text`` and ``n_chars`` follows."""
    d, q = measured(docs)
    text = F.col(f"`{q}`.clean_text")
    changed = F.col(f"`{q}`.n_bad_lines") > 0
    new = {"text": text} | ({"n_chars": F.when(changed, F.length(text).cast("long")).otherwise(F.col("n_chars"))}
                            if "n_chars" in docs.columns else {})
    return d.filter(F.col(f"`{q}`.kept")).withColumns(new).select(*[F.col(f"`{c}`") for c in docs.columns])
