"""Text expressions: cleaning, tokens, n-grams, chunking, durations.

All are native Catalyst expressions (Java regex with Unicode property
classes), so they run inside whole-stage codegen with no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values. Python's Unicode ``[^\w\s]`` written with explicit property
# classes (Java's and RE2's ``\w`` / ``\s`` are ASCII-only), then ``\d+``.
KEEP_CLASS = r"[^\p{L}\p{N}_\p{Z}\t\n\x0B\f\r\x1C-\x1F\x85]"
DIGITS = r"\p{Nd}+"
# Both steps only delete characters, so they collapse into one pass that keeps
# letters, non-decimal numbers, underscore and whitespace.
DROP_ONE_PASS = r"[^\p{L}\p{Nl}\p{No}_\p{Z}\t\n\x0B\f\r\x1C-\x1F\x85]+"
WORD = r"[\p{L}\p{N}_]+"

# The English stop-word list (NLTK corpus, 179 words), in its natural order.
STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're", "you've",
    "you'll", "you'd", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself",
    "she", "she's", "her", "hers", "herself", "it", "it's", "its", "itself", "they", "them",
    "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "that'll",
    "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has",
    "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or",
    "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against",
    "between", "into", "through", "during", "before", "after", "above", "below", "to", "from",
    "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once",
    "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more",
    "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than",
    "too", "very", "s", "t", "can", "will", "just", "don", "don't", "should", "should've", "now",
    "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren", "aren't", "couldn", "couldn't", "didn",
    "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn", "hasn't", "haven", "haven't", "isn",
    "isn't", "ma", "mightn", "mightn't", "mustn", "mustn't", "needn", "needn't", "shan", "shan't",
    "shouldn", "shouldn't", "wasn", "wasn't", "weren", "weren't", "won", "won't", "wouldn",
    "wouldn't",
]


def clean_text(text: Column) -> Column:
    """Drop punctuation and digits, LF to space, lower-case; NULL becomes ''."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), DROP_ONE_PASS, "")
    return F.lower(F.translate(t, "\n", " "))


def tokens(clean: Column) -> Column:
    """Split on single spaces; empty tokens are kept (bigrams/trigrams keep them)."""
    return F.split(clean, " ")


def _window_grams(words: Column, n: int) -> Column:
    """All n-grams of ``words`` joined by a space (empty array when too short).

    Built from shifted slices with ``zip_with`` so the lambda never refers
    back to the whole array: ``words`` must be a column (materialised once),
    not the cleaning expression, or Catalyst would re-evaluate it per token.
    """
    m = F.size(words) - (n - 1)

    def sl(k):
        return F.slice(words, k + 1, F.greatest(m, F.lit(0)))

    out = sl(0)
    for k in range(1, n):
        out = F.zip_with(out, sl(k), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(m > 0, out).otherwise(F.array().cast("array<string>"))


def unigrams(words: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """Words without empty tokens and stop words."""
    return F.filter(words, lambda w: (w != "") & ~w.isin(*stop_words))


def ngrams_tagged(words: Column, max_n: int = 3, stop_words: list[str] = STOP_WORDS,
                  ns: tuple[int, ...] | None = None) -> Column:
    """One array<struct<n int, gram string>> holding uni-, bi- and trigrams of a row."""
    def tag(n):
        return lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram"))

    wanted = ns or tuple(range(1, max_n + 1))
    parts = []
    for n in wanted:
        grams = unigrams(words, stop_words) if n == 1 else _window_grams(words, n)
        parts.append(F.transform(grams, tag(n)))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def not_blank(gram: Column) -> Column:
    """At least one character that is not Unicode white space."""
    return gram.rlike(r"[^\p{Z}\t\n\x0B\f\r\x1C-\x1F\x85]")


def well_formed(gram: Column, n: int) -> Column:
    """Full match of n word-runs separated by single spaces (``$`` would allow a final line end)."""
    return gram.rlike(r"\A" + " ".join([WORD] * n) + r"\z")


def first_chunk(text: Column, size: int = 100) -> Column:
    """First chunk of a space-split text, as a character splitter with separator ' '.

    Tokens are the non-empty pieces between spaces; the chunk is the longest
    run of leading tokens (joined by one space) of at most ``size``
    characters; a first token longer than ``size`` is kept whole. NULL for an
    empty text.
    """
    # Tokens have a character at least, so the first ``size`` / 2 + 1 reach beyond the chunk, and only they are split.
    start = F.regexp_extract(F.coalesce(text, F.lit("")), r"^ *+(?:[^ ]++ *+){0,%d}+" % (size // 2 + 2), 0)
    joined = F.array_join(F.filter(F.split(start, " "), lambda w: w != ""), " ")
    head = F.regexp_extract(joined, r"(?s)^(.{1,%d})(?: |\z)" % size, 1)
    first = F.substring_index(joined, " ", 1)
    return F.when(joined == "", F.lit(None)).when(head != "", head).otherwise(first)


def duration_seconds(d: Column) -> Column:
    """ISO-8601 ``PT#H#M#S`` to seconds; '0' or anything not starting with PT gives 0."""
    pat = r"^PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?"

    def part(i):
        return F.coalesce(F.regexp_extract(d, pat, i).try_cast("bigint"), F.lit(0))

    return F.when(d.rlike("^PT"), part(1) * 3600 + part(2) * 60 + part(3)).otherwise(F.lit(0).cast("bigint"))
