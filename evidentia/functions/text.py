"""Column builders for text: white space, lines, tokens, headings, sentences.

White space is the set that Unicode-aware engines strip and split at; Java's \\s is ASCII only, so the class is spelled out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.functions import fixed_values as V

WS = r"[\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: The same set as characters, to trim by without a pattern.
WS_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: What collapse() has to change: all but lone spaces.
_UNEVEN = rf"{WS}(?:{WS}+|(?<! ))"
EOL = r"\r\n|[\n-\r\x1C-\x1E\x85\u2028\u2029]"
#: Cuts a sentence after its end mark.
SENTENCE_END = rf"(?<=[.!?]){WS}+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lit_array(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WS_CHARS))


def strip_chars(c: Column, chars: str) -> Column:
    """chars: the inside of a character class."""
    return F.regexp_replace(c, rf"\A[{chars}]+|[{chars}]+\z", "")


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, _UNEVEN, " "))


def words(c: Column) -> Column:
    """Split at white space."""
    return F.filter(F.split(collapse(c), " "), lambda w: w != "")


def lines(c: Column) -> Column:
    """Split at line ends; the empty line after a last line end is left out."""
    return let(F.split(c, EOL, -1), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))


def blocks(c: Column) -> Column:
    """Paragraphs: split at blank lines."""
    return F.filter(F.transform(F.split(c, rf"\n{WS}*\n", -1), strip), lambda p: p != "")


def shorten(c: Column, limit: int) -> Column:
    flat = collapse(c)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(rstrip(F.substring(flat, 1, limit - 3)), F.lit("...")))


def compact_lines(c: Column) -> Column:
    """Lines stripped, runs of blank lines as one, none at the ends."""
    return strip(F.regexp_replace(F.array_join(F.transform(lines(c), strip), "\n"), r"\n{3,}", "\n\n"))


def clean_text(c: Column) -> Column:
    return compact_lines(F.replace(c, F.lit("\0"), F.lit(" ")))


def clean_sanitized(c: Column) -> Column:
    """As compact_lines, but lines keep their indentation."""
    return strip(F.regexp_replace(F.array_join(F.transform(lines(c), rstrip), "\n"), r"\n{3,}", "\n\n"))


# --- tokens ---------------------------------------------------------------------------------------------------------------------


def raw_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0)


def terms(c: Column, longer_than: int, stop: list[str]) -> Column:
    """Lower-cased letter and digit runs over a length, without stop words."""
    keep = lambda t: (F.length(t) > longer_than) & (~F.array_contains(lit_array(stop), t) if stop else F.lit(True))
    return F.filter(raw_tokens(c), keep)


def bigrams(tokens: Column, keep: Callable[[Column, Column], Column] | None = None) -> Column:
    """Neighbours, joined by a space; keep(a, b) says which."""

    def join(t: Column) -> Column:
        pairs = F.transform(F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0))), lambda a, i: F.struct(a.alias("a"), F.get(t, i + 1).alias("b")))
        if keep is not None:
            pairs = F.filter(pairs, lambda p: keep(p["a"], p["b"]))
        return F.transform(pairs, lambda p: F.concat_ws(" ", p["a"], p["b"]))

    return let(tokens, join)


def index_terms(c: Column) -> Column:
    """T1, first stage; the index adds bigrams() of it."""
    return terms(c, 3, V.STOP_INDEX)


def rerank_terms(c: Column) -> Column:
    return terms(c, 2, V.STOP_RERANK)


def guard_terms(c: Column) -> Column:
    return terms(c, 2, V.STOP_GUARD)


def graph_words(c: Column) -> Column:
    return terms(c, 3, V.STOP_GRAPH)


def not_digits(t: Column) -> Column:
    return ~t.rlike("^[0-9]+$")


def graph_terms(c: Column) -> Column:
    """T4: the first 18 words that aren't numbers, then the first 12 pairs of neighbours that aren't."""
    return let(graph_words(c), lambda w: F.concat(F.slice(F.filter(w, not_digits), 1, 18), F.slice(bigrams(w, lambda a, b: not_digits(a) & not_digits(b)), 1, 12)))


def trust_terms(c: Column) -> Column:
    return terms(c, 3, V.STOP_TRUST)


def _with_singular(tokens: Column) -> Column:
    one = lambda t: F.when((F.length(t) > 4) & t.endswith("s"), F.array(t, F.substring(t, F.lit(1), F.length(t) - 1))).otherwise(F.array(t))
    return F.flatten(F.transform(tokens, one))


def answer_terms(c: Column) -> Column:
    return _with_singular(terms(c, 3, V.STOP_ANSWER))


def rewrite_terms(c: Column) -> Column:
    return _with_singular(terms(c, 3, []))


def health_terms(c: Column) -> Column:
    """T8: slashes and hyphens part words; of each word the letters and digits stay."""
    w = F.transform(words(F.translate(F.lower(c), "/-", "  ")), lambda t: F.regexp_replace(t, r"[^\p{L}\p{N}]", ""))
    return F.filter(w, lambda t: (F.length(t) > 3) & ~F.array_contains(lit_array(V.STOP_HEALTH), t))


def phrase_terms(c: Column) -> Column:
    return bigrams(terms(c, 3, V.STOP_PHRASES))


# --- headings -------------------------------------------------------------------------------------------------------------------


def _title_words(w: Column) -> Column:
    return F.size(F.filter(w, lambda t: t.rlike(r"^\p{Lu}")))


def _title_rule(w: Column) -> Column:
    return _title_words(w) >= F.greatest(F.lit(1), F.floor(F.size(w) / 2))


def _all_upper(c: Column) -> Column:
    """Some cased letter, and none that is not upper case."""
    return c.rlike(r"\p{Lu}") & ~c.rlike(r"[\p{Ll}\p{Lt}]")


def heading_short(c: Column, most_words: int) -> Column:
    """H1 (9 words) and H3 (10): no end mark; all upper case or mostly title words."""
    return let(words(c), lambda w: (F.size(w) > 0) & (F.size(w) <= most_words) & ~c.rlike(r"[.?!]\z") & (_all_upper(c) | _title_rule(w)))


def heading_marked(c: Column) -> Column:
    """H2: starts with #, or ends with a colon, or at most 8 words, mostly title words."""
    s = strip(c)
    w = words(s)
    return s.startswith("#") | ((F.length(s) > 0) & (F.length(s) <= 90) & (s.endswith(":") | ((F.size(w) <= 8) & _title_rule(w))))


def heading_sized(c: Column, most_words: int | None = None) -> Column:
    """H4 (no word limit) and H5 (10 words): 4 to 90 characters."""
    w = words(c)
    out = (F.length(c) >= 4) & (F.length(c) <= 90) & (_all_upper(c) | _title_rule(w))
    return out if most_words is None else out & (F.size(w) <= most_words)


# --- sentences ------------------------------------------------------------------------------------------------------------------


def sentences(c: Column) -> Column:
    """S1: split after an end mark, over the collapsed text."""
    return F.filter(F.split(collapse(c), SENTENCE_END, -1), lambda s: s != "")


RECORDS = "array<struct<heading:string,sentence:string>>"


def _records(c: Column, is_heading: Callable[[Column, Column], Column], is_empty: Callable[[Column, Column], Column]) -> Column:
    """Sentences with the heading above them; over the whole text if no line gives any. Tests see the line and its unmarked form."""

    def fold(acc: Column, x: Column) -> Column:
        raw, body = x["raw"], x["body"]
        new = F.transform(sentences(body), lambda s: F.struct(acc["heading"].alias("heading"), s.alias("sentence")))
        return (
            F.when(is_empty(raw, body), acc)
            .when(is_heading(raw, body), F.struct(body.alias("heading"), acc["out"].alias("out")))
            .otherwise(F.struct(acc["heading"].alias("heading"), F.concat(acc["out"], new).alias("out")))
        )

    pairs = F.transform(lines(c), lambda x: F.struct(strip(x).alias("raw"), unmarked(x).alias("body")))
    start = F.struct(F.lit("").alias("heading"), F.array().cast(RECORDS).alias("out"))
    whole = F.transform(sentences(c), lambda s: F.struct(F.lit("").alias("heading"), s.alias("sentence")))
    return let(F.aggregate(pairs, start, fold, lambda acc: acc["out"]), lambda out: F.when(F.size(out) > 0, out).otherwise(whole))


def unmarked(x: Column) -> Column:
    """A line without white space and # marks at its ends."""
    return strip(strip_chars(strip(x), "#"))


def answer_records(c: Column) -> Column:
    """S2."""
    return _records(c, lambda raw, body: heading_short(body, 9), lambda raw, body: body == "")


def compress_records(c: Column) -> Column:
    """S3: the heading test sees the line with its # marks."""
    return _records(c, lambda raw, body: heading_marked(raw), lambda raw, body: raw == "")


def instruction_like(c: Column) -> Column:
    lowered = F.lower(strip(c))
    starts = F.lit(False)
    for s in V.INSTRUCTION_STARTS:
        starts = starts | lowered.startswith(s)
    return F.arrays_overlap(guard_terms(c), lit_array(V.INSTRUCTION_MARKERS)) | starts


def guard_sentences(c: Column) -> Column:
    """S4: heading lines only if they look like instructions; parts of three words or more."""
    pairs = F.transform(lines(c), lambda x: F.struct(x.alias("raw"), unmarked(x).alias("body")))
    used = F.filter(pairs, lambda x: (x["body"] != "") & (~heading_marked(x["raw"]) | instruction_like(x["body"])))
    parts = F.filter(F.flatten(F.transform(used, lambda x: sentences(x["body"]))), lambda s: F.size(words(s)) >= 3)
    return F.when(F.size(parts) > 0, parts).otherwise(sentences(c))


def readable_sentences(c: Column) -> Column:
    """S5: no headings; four words or more."""
    bodies = F.filter(F.transform(lines(c), unmarked), lambda x: (x != "") & ~heading_short(x, 9))
    return F.filter(F.flatten(F.transform(bodies, sentences)), lambda s: F.size(words(s)) >= 4)


def supporting_excerpt(c: Column, limit: int = 420) -> Column:
    """Whole sentences up to the limit, the first one whatever its length."""
    found = readable_sentences(c)

    def fold(acc: Column, s: Column) -> Column:
        candidate = F.when(acc["text"] == "", s).otherwise(F.concat_ws(" ", acc["text"], s))
        stop = acc["done"] | ((F.length(candidate) > limit) & (acc["text"] != ""))
        return F.struct(F.when(stop, acc["text"]).otherwise(candidate).alias("text"), stop.alias("done"))

    taken = F.aggregate(found, F.struct(F.lit("").alias("text"), F.lit(False).alias("done")), fold, lambda acc: acc["text"])
    plain = F.array_join(F.filter(F.transform(lines(c), strip), lambda x: x != ""), "\n")
    return F.when(F.size(found) == 0, shorten(plain, limit)).otherwise(shorten(taken, limit))


def first_informative(c: Column) -> Column:
    pieces = F.transform(F.filter(F.split(F.replace(c, F.lit("\n"), F.lit(". ")), r"\.", -1), lambda p: strip(p) != ""), lambda p: strip(strip_chars(p, "# ")))
    return F.coalesce(F.get(F.filter(pieces, lambda p: F.size(words(p)) >= 6), F.lit(0)), c)


def source_name(c: Column) -> Column:
    return strip(F.translate(F.regexp_replace(c, r"(?i)\.(pdf|md|txt|docx)\z", ""), "_-", "  "))


def citation(source: Column, page: Column, chunk_index: Column) -> Column:
    return F.when(page.isNull(), F.concat(source, F.lit(", chunk "), (chunk_index + 1).cast("string"))).otherwise(F.concat(source, F.lit(", page "), page.cast("string")))


def normalize_guard(c: Column) -> Column:
    return strip_chars(collapse(F.lower(c)), r" .!?:;")


def rlike_any(c: Column, pattern: str) -> Column:
    """Java's Unicode classes, without case."""
    return c.rlike(f"(?iU){pattern}")


def has_condition(c: Column) -> Column:
    return F.lower(c).rlike(rf"(?U)\b({'|'.join(V.CONDITION_TERMS)})\b")


def highlight(c: Column) -> Column:
    """Bold facts outside code spans and bold text."""
    kept = r"```.*?```|`[^`]*`|\*\*[^*]+\*\*"
    parts = F.regexp_extract_all(c, F.lit(rf"(?s)(?:{kept})|(?:(?!{kept}).)+"), 0)
    bold = lambda p: F.when(p.startswith("`") | (p.startswith("**") & p.endswith("**")), p).otherwise(F.regexp_replace(p, rf"(?iU)(?<![\w*])({V.FACT})", r"**$1**"))
    return F.array_join(F.transform(parts, bold), "")
