"""Text functions: columns in, columns out. All stay in the JVM but for unicode_normalise."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's \s and \w are Unicode; (?U) makes Java's the same.

#: What (?U)\s matches, character by character.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, body) -> Column:
    """body(x), x evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squash(c: Column) -> Column:
    """Lower case, runs of white space to one blank, ends stripped; marks stay."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def normalise_utterance(c: Column) -> Column:
    """Lower case; apostrophes go; all else but a-z and 0-9 parts words."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "['’`]", ""), "[^a-z0-9]+", " "))


def normalise_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def squeeze(c: Column) -> Column:
    """Runs of three or more of one character become two."""
    return F.regexp_replace(c, r"(.)\1{2,}", "$1$1")


def word_count(c: Column) -> Column:
    # Only the first and the last part can be empty.
    blank = lambda x: F.when(x == "", 1).otherwise(0)
    return let(F.split(c, r"(?U)\s+"), lambda w: F.size(w) - blank(F.get(w, F.lit(0))) - F.when(F.size(w) > 1, blank(F.get(w, F.size(w) - 1))).otherwise(0))


def token_estimate(c: Column) -> Column:
    return (F.lit(1.3) * word_count(c)).cast("int")


def content_hash(c: Column) -> Column:
    return F.substring(F.sha2(c.cast("binary"), 256), 1, 16)


def has_phrase(c: Column, phrases) -> Column:
    """Whether any phrase is in c as whole words. Both normalised."""
    padded = F.concat(F.lit(" "), c, F.lit(" "))
    listed = [p for p in phrases if p]
    return F.exists(F.array(*[F.lit(f" {p} ") for p in listed]), lambda p: F.contains(padded, p)) if listed else F.lit(False)


def truncate(c: Column, most: int, tail: Column) -> Column:
    """The first `most` characters; where `tail` holds, head, ' ... ' and the last third, `most` characters in all."""
    last = most // 3
    both = F.concat(F.substring(c, 1, most - last - 5), F.lit(" ... "), F.right(c, F.lit(last)))
    return F.when(F.char_length(c) <= most, c).when(tail, both).otherwise(F.substring(c, 1, most))


def strip_controls(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def nfkc(c: Column) -> Column:
    """Unicode form NFKC, for which Spark has no function: Arrow batches."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFKC")

    return run(c)


def unicode_normalise(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(nfkc(c), " ", " "), "​", "")
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def has_text(c: Column) -> Column:
    """Whether anything is left when c is stripped."""
    return c.rlike(r"(?U)\S")


def dehyphenate(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)(\w)-\s*\n\s*(\w)", "$1$2")


def ocr_clean(c: Column) -> Column:
    """In this order: a lone l is I; 0 between letters is o; | is I; runs of white space are one blank."""
    c = F.regexp_replace(c, r"(?U)\bl\b", "I")
    c = F.regexp_replace(c, r"(?<=[a-zA-Z])0(?=[a-zA-Z])", "o")
    return F.regexp_replace(F.regexp_replace(c, r"\|", "I"), r"(?U)\s{2,}", " ")


def normalise_block(c: Column, ocr: Column, table: Column | None = None) -> Column:
    """De-hyphenated and normalised; OCR text also cleaned, tables only if `table` says nothing of them."""
    plain = unicode_normalise(dehyphenate(c))
    fix = ocr if table is None else ocr & ~table
    return strip(F.when(fix, ocr_clean(plain)).otherwise(plain))


def digit_key(c: Column) -> Column:
    """What repeated headers and footers have in common: digit runs as #."""
    return F.regexp_replace(strip(c), r"[0-9]+", "#")


def is_page_number(c: Column) -> Column:
    return F.lower(strip(c)).rlike(r"\A(?:page\s+[0-9]+(?:\s+of\s+[0-9]+)?|[0-9]+|[0-9]+\s*/\s*[0-9]+)\z")


def garbled(c: Column) -> Column:
    """Few letters and digits, or hardly any blanks, or very long words. Empty text isn't garbled."""

    def odd(n: Column, words: Column, solid: Column, others: Column) -> Column:
        return (n > 0) & (((solid - others) / solid < 0.5) | ((n > 40) & (words < n / 25)) | (solid / words > 25))

    # The text is stripped and split once; what is neither letter nor digit is counted in its words, without blanks.
    others = lambda s: F.char_length(F.regexp_replace(s, r"(?U)[\p{L}\p{N}]+", ""))
    split = lambda t: let(F.split(t, r"(?U)\s+"), lambda w: F.struct(F.char_length(t).alias("n"), F.size(w).alias("words"), F.array_join(w, "").alias("s")))
    counts = let(let(strip(c), split), lambda x: F.struct(x["n"].alias("n"), x["words"].alias("words"), F.char_length(x["s"]).alias("solid"), others(x["s"]).alias("others")))
    return let(counts, lambda x: odd(x["n"], x["words"], x["solid"], x["others"]))


def dotted_number(c: Column) -> Column:
    """The number of a heading like '1.2 Scope', or ''."""
    return F.regexp_extract(c, r"^\s*([0-9]+(?:\.[0-9]+)+)\.?\s+\S", 1)


def bare_number(c: Column) -> Column:
    """n of a line like '3. Text', or null."""
    return F.try_to_number(F.nullif(F.regexp_extract(c, r"^\s*([0-9]{1,6})[.)]\s+\S", 1), F.lit("")), F.lit("999999")).cast("int")


def is_question(c: Column) -> Column:
    return c.rlike(r"^(?i)\s*(?:q|question)\s*[0-9]*\s*[:.)-]\s*\S")


def is_answer(c: Column) -> Column:
    return c.rlike(r"^(?i)\s*(?:a|ans|answer)\s*[0-9]*\s*[:.)-]\s*\S")


def heading_level(size: Column, body: Column, tiers: Column, number: Column) -> Column:
    """Of a line: the tier whose size is less than 0.3 points away; else, if larger than the body by 12 %, the level below the tiers (3 without any); else, if it has a
    dotted number, below the tiers by dots, three levels more at most; else null."""
    near = F.get(F.filter(F.transform(tiers, lambda t, i: F.when(F.abs(t - F.round(size, 1)) < 0.3, i + 1)), lambda x: x.isNotNull()), F.lit(0))
    dots = F.char_length(F.regexp_replace(number, "[^.]", ""))
    large = F.when(F.round(size, 1) > body * 1.12, F.when(F.size(tiers) > 0, F.size(tiers) + 1).otherwise(3))
    return F.coalesce(near, large, F.when(number != "", F.size(tiers) + 1 + F.least(dots - 1, F.lit(3))))


def overlap_share(a: list[Column], b: list[Column]) -> Column:
    """Share of box a (x0, y0, x1, y1) that lies in box b; 0 for empty boxes."""
    side = lambda i: F.greatest(F.least(a[i + 2], b[i + 2]) - F.greatest(a[i], b[i]), F.lit(0.0))
    area = (a[2] - a[0]) * (a[3] - a[1])
    return F.when(area > 0, side(0) * side(1) / area).otherwise(0.0)


def padded_box(b: list[Column], top: float = 16, side: float = 5, bottom: float = 5) -> list[Column]:
    return [b[0] - side, b[1] - top, b[2] + side, b[3] + bottom]


def rows_to_markdown(rows: Column) -> Column:
    """A table (array of rows of cells) as Markdown: the first row is the header; rows are padded or cut to its width."""
    cell = lambda c: strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"\r?\n", " "))
    width = F.size(F.get(rows, F.lit(0)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), width - 1), lambda i: cell(F.get(r, i))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    head, body = line(F.get(rows, F.lit(0))), F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line)
    return F.when((F.size(rows) > 0) & (width > 0), F.array_join(F.concat(F.array(head, rule), body), "\n")).otherwise("")


def row_mismatch(rows: Column) -> Column:
    return F.exists(rows, lambda r: F.size(r) != F.size(F.get(rows, F.lit(0))))


def real_table(rows: Column) -> Column:
    """More than one row, or one of four columns and four filled cells at least."""
    filled = F.size(F.filter(F.flatten(rows), lambda c: strip(F.coalesce(c, F.lit(""))) != ""))
    return (F.size(rows) > 1) | ((F.size(rows) == 1) & (F.size(F.get(rows, F.lit(0))) >= 4) & (filled >= 4))


def looks_like_date(c: Column) -> Column:
    month = "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
    return F.lower(c).rlike(rf"[0-9]{{1,4}}[-/.][0-9]{{1,2}}[-/.][0-9]{{2,4}}|{month}\.?\s+[0-9]{{1,2}}?,?\s*[0-9]{{4}}|[0-9]{{1,2}}(?:st|nd|rd|th)?\s+{month}\.?,?\s+[0-9]{{4}}")


def date_or_version(c: Column) -> Column:
    """(effective_date, version): which of the two a text is."""
    value = F.nullif(strip(c), F.lit(""))
    return F.struct(F.when(looks_like_date(value), value).alias("effective_date"), F.when(~looks_like_date(value), value).alias("version"))


def id_prefix(c: Column) -> Column:
    s = F.substring(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""), 1, 60)
    return F.when(s == "", "doc").otherwise(s)


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(strip(c), r"(?<=[.!?])\s+"), strip), lambda s: s != "")


def offer_sentence(c: Column, markers) -> Column:
    """The last sentence with an offer, else the last question, else the last; null if there is none."""

    def pick(s: Column) -> Column:
        low = lambda x: F.replace(F.lower(x), F.lit("’"), F.lit("'"))
        offers = F.filter(s, lambda x: F.exists(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(low(x), m)))
        asks = F.filter(s, lambda x: F.endswith(x, F.lit("?")))
        return F.coalesce(F.try_element_at(offers, F.lit(-1)), F.try_element_at(asks, F.lit(-1)), F.try_element_at(s, F.lit(-1)))

    return let(sentences(c), pick)


def invites_reply(c: Column, markers) -> Column:
    """Whether a message ends as a question, closing quotes aside, or holds an offer."""
    low = F.replace(F.lower(strip(c)), F.lit("’"), F.lit("'"))
    return F.rtrim(low).rlike("\\?[\\s\"')*_”]*$") | F.exists(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(low, m))


def display_title(c: Column) -> Column:
    """ALL-CAPS titles in title case."""
    return F.when((F.upper(c) == c) & (F.lower(c) != c), F.initcap(c)).otherwise(c)


def leaf_section(path: Column, title: Column) -> Column:
    leaf = strip(F.element_at(F.split(F.coalesce(path, F.lit("")), " > "), -1))
    return F.when((leaf != "") & (leaf != title), leaf)


def topic_title(c: Column, prefix: str = "", keep_upper: int = 4) -> Column:
    """A title as a topic: cut at ' - ', without brackets, an organisation's prefix, 'policy' at its end; short capitals stay."""
    t = F.regexp_replace(F.get(F.split(c, " - "), F.lit(0)), r"\s*\([^)]*\)", "")
    if prefix:
        t = F.regexp_replace(t, rf"(?i)^\s*{prefix}\s*:?\s*", "")
    t = F.replace(F.regexp_replace(t, r"(?i)\s+(?:policy|policies)\s*$", ""), F.lit("&"), F.lit("and"))
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    upper = lambda w: (F.upper(w) == w) & (F.lower(w) != w) & (F.char_length(w) <= keep_upper)
    return F.array_join(F.transform(words, lambda w: F.when(upper(w), w).otherwise(F.lower(w))), " ")


def title_warnings(title: Column, generic, repeated: Column) -> Column:
    """What is odd about a title: all capitals, a generic phrase, or equal to a line (normalised) on three pages or more."""
    low = F.lower(title)
    return F.filter(
        F.array(
            F.when((F.upper(title) == title) & (low != title), "all_caps"),
            F.when(F.exists(F.array(*[F.lit(g) for g in generic]), lambda g: F.contains(low, g)), "generic_phrase"),
            F.when(F.array_contains(repeated, normalise_title(title)), "repeated_line"),
        ),
        lambda x: x.isNotNull(),
    )


def clean_section(raw: Column, title: Column, generic, skip, spoken: bool) -> Column:
    """A heading as a name: no number in front, no marks behind; null if empty, the title, generic or matching a `skip` pattern."""
    text = strip(raw)
    name = strip(F.regexp_replace(F.regexp_replace(text, r"^\s*[0-9]+(?:\.[0-9]+)*\.?\s+", ""), r"[\s:;,.?!]+$", ""))
    odd = F.lit(False)
    for p in skip:
        odd = odd | text.rlike(f"(?i){p}")
    low = F.lower(name)
    shown = F.lower(name) if spoken else F.initcap(name)
    cased = F.when((F.upper(name) == name) & (low != name), shown).otherwise(name)
    bad = odd | (name == "") | (low == F.lower(strip(title))) | low.isin(*generic)
    return F.when(~bad, F.replace(cased, F.lit("&"), F.lit("and")))


def best_section(path: Column, title: Column, generic, skip, spoken: bool) -> Column:
    """The most specific usable heading of a section path; the title's own part is left out."""
    parts = F.split(F.coalesce(path, F.lit("")), " > ")
    own = F.when(F.lower(strip(F.get(parts, F.lit(0)))) == F.lower(strip(title)), F.slice(parts, 2, F.size(parts))).otherwise(parts)
    return F.try_element_at(F.filter(F.transform(F.reverse(own), lambda p: clean_section(p, title, generic, skip, spoken)), lambda x: x.isNotNull()), F.lit(1))


def join_words(items: Column, last: str = " and ", last_of_many: str | None = None) -> Column:
    """'a, b and c'."""
    n = F.size(items)
    many = last if last_of_many is None else last_of_many
    return F.when(n == 0, "").when(n == 1, F.get(items, F.lit(0))).otherwise(F.concat(F.array_join(F.slice(items, 1, n - 1), ", "), F.when(n > 2, many).otherwise(last), F.element_at(items, -1)))


def split_title(c: Column) -> Column:
    """(text, title): the last [[TITLE: x]] taken out of an answer, 60 characters at most; an unfinished marker at the end goes."""
    titles = F.regexp_extract_all(c, F.lit(r"\[\[TITLE:\s*([^\]]*)\]\]"), F.lit(1))
    rest = strip(F.regexp_replace(F.regexp_replace(c, r"\s*\[\[TITLE:[^\]]*\]\]\s*", " "), r"\s*\[\[[^\]]*\]?\z", ""))
    return F.struct(rest.alias("text"), F.nullif(F.substring(strip(F.try_element_at(titles, F.lit(-1))), 1, 60), F.lit("")).alias("title"))


def json_int(c: Column, path: str) -> Column:
    return F.get_json_object(c, path).try_cast("int")


def merge_maps(a: Column, b: Column) -> Column:
    """Keys of both; b wins."""
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def keyterm_tokens(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0), lambda s, t: s + 2 * F.greatest(word_count(t), F.lit(1)))


def expand_informal(c: Column, forms: dict[str, str]) -> Column:
    """Informal forms in normalised text replaced, longest first, on word boundaries; '' drops them."""
    for k in sorted(forms, key=lambda x: (-len(x), x)):
        c = F.regexp_replace(c, rf"(?<![a-z0-9]){k}(?![a-z0-9])", f" {forms[k]} ")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def render(template: Column, default: str, **fields: Column) -> Column:
    """A template's {fields} filled in; where it is null or has a field of another name, the default's."""

    def fill(t: Column) -> Column:
        for k, v in fields.items():
            t = F.replace(t, F.lit(f"{{{k}}}"), v)
        return t

    names = "|".join(fields) or "(?!)"
    good = template.isNotNull() & ~F.regexp_replace(template, rf"\{{(?:{names})\}}", "").rlike(r"[{}]")
    return F.when(good, fill(template)).otherwise(fill(F.lit(default)))


def chat_message(excerpts: Column, question: Column, reminder: str = "") -> Column:
    """The final user message: numbered excerpts (label, title, text), a reminder, the question."""
    one = lambda e, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), e["title"], F.coalesce(F.concat(F.lit(" [Applies to: "), e["label"], F.lit("]")), F.lit("")), F.lit("\n"), e["text"])
    parts = [F.array_join(F.transform(excerpts, one), "\n\n"), *([F.lit(reminder)] if reminder else []), F.concat(F.lit("Question: "), question)]
    return F.concat_ws("\n\n", *parts)
