"""Column functions on titles and short texts: ages, occasions, audit signals, normal forms."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The largest child age, milestone ages, and the words that tell a child's or a partner's card.
KID_AGE_MAX = 12
MILESTONE_AGES = (18, 21, 30, 40, 50, 60, 70, 80, 90, 100)
KID_WORDS = (
    "kid", "kids", "child", "children", "son", "daughter", "nephew", "niece",
    "grandson", "granddaughter", "toddler", "baby", "boy", "girl", "little one",
    "first birthday", "second birthday", "third birthday",
)
REL_WORDS = (
    "husband", "wife", "boyfriend", "girlfriend", "partner", "fiance", "fiancee",
    "hubby", "wifey", "soulmate", "other half", "love of my life", "for him", "for her",
)
IN_LAW = r"(?U)\b(son|daughter|mother|father|brother|sister)[\s-]+in[\s-]+law\b"
AGE_FORMS = (r"\b(\d{1,3})(?:st|nd|rd|th)\b", r"\bage\s+(\d{1,3})\b", r"\b(\d{1,3})\s*(?:years?|yrs?)\s*old\b", r"\b(?:at|turning)\s+(\d{1,3})\b")
KIDS, MILESTONE, RELATIONSHIP, GENERAL = "birthday/kids", "birthday/milestone", "birthday/relationship", "birthday/general"
BIRTHDAYS = (GENERAL, MILESTONE, KIDS, RELATIONSHIP)
NOT_BIRTHDAY = "not_birthday"


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def ages(text: Column) -> Column:
    """F-01: the distinct ages a text names, sorted."""
    low = F.lower(text)
    found = F.concat(*[F.regexp_extract_all(low, F.lit(p), F.lit(1)) for p in AGE_FORMS])
    return F.array_sort(F.array_distinct(F.transform(found, lambda a: a.cast("int"))))


def occasion_from_age(text: Column) -> Column:
    """F-02: a child's age decides before a milestone; other ages decide nothing."""
    found = ages(text)
    return F.when(F.exists(found, lambda a: a <= KID_AGE_MAX), F.lit(KIDS)).when(F.exists(found, lambda a: a.isin(*MILESTONE_AGES)), F.lit(MILESTONE))


def ages_rule_out_kids(text: Column) -> Column:
    """F-03: some age is named, and none is a child's."""
    found = ages(text)
    return (F.size(found) > 0) & F.forall(found, lambda a: a > KID_AGE_MAX)


def final_occasion(title: Column, top_label: Column, top_score: Column, threshold: float = 0.55) -> Column:
    """F-04: struct of occasion and confidence: a decisive age, else the model's label if sure, with a veto on kids."""
    by_age = occasion_from_age(title)
    sure = top_score >= threshold
    by_model = F.when(top_label == NOT_BIRTHDAY, F.when(sure, F.lit(None).cast("string")).otherwise(GENERAL)).otherwise(F.when(sure, top_label).otherwise(GENERAL))
    chosen = F.when(by_age.isNotNull(), by_age).otherwise(by_model)
    vetoed = F.when((chosen == KIDS) & ages_rule_out_kids(title), F.lit(GENERAL)).otherwise(chosen)
    return F.struct(vetoed.alias("occasion"), F.when(by_age.isNotNull(), F.lit(1.0)).otherwise(top_score).alias("confidence"))


def multilabel(scores: Column) -> Column:
    """F-04: a map of label to score over the known occasions, 0 where the model gave none."""
    return F.map_from_arrays(F.array(*map(F.lit, BIRTHDAYS)), F.array(*[F.coalesce(scores[b], F.lit(0.0)) for b in BIRTHDAYS]))


def once(value: Column, then) -> Column:
    """then(value), with value worked out once however often `then` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def has_phrase(text: Column, *phrases: str) -> Column:
    """F-05: any of some phrases as whole words, by one pattern."""
    return text.rlike(rf"(?U)(?<!\w)(?:{'|'.join(rf'\Q{p}\E' for p in phrases)})(?!\w)")


def signals(title: Column) -> Column:
    """F-06: struct of kid_word, kid_age, adult_age, milestone_age and rel_word."""
    words = F.regexp_replace(F.lower(title), IN_LAW, "inlaw")
    seen = lambda t, found: F.struct(
        has_phrase(t, *KID_WORDS).alias("kid_word"),
        F.exists(found, lambda a: a <= KID_AGE_MAX).alias("kid_age"),
        ((F.size(found) > 0) & F.forall(found, lambda a: a > KID_AGE_MAX)).alias("adult_age"),
        F.exists(found, lambda a: a.isin(*MILESTONE_AGES)).alias("milestone_age"),
        has_phrase(t, *REL_WORDS).alias("rel_word"),
    )
    return once(words, lambda t: once(ages(t), lambda found: seen(t, found)))


def violations(occasion: Column, s: Column) -> Column:
    """F-07: codes of what a title says against its label, in a fixed order."""
    return once(s, lambda seen: _codes(occasion, seen))


def _codes(occasion: Column, s: Column) -> Column:
    kid = s["kid_word"] | s["kid_age"]
    is_ = lambda o: occasion == o
    rules = [
        (is_(KIDS) & s["adult_age"], "kids_but_adult_age"),
        (is_(KIDS) & ~s["adult_age"] & ~kid, "kids_but_no_kid_signal"),
        (is_(MILESTONE) & ~s["milestone_age"], "milestone_but_no_milestone_age"),
        (is_(RELATIONSHIP) & ~s["rel_word"], "relationship_but_no_relationship_word"),
        (is_(GENERAL) & kid, "general_but_kid_signal"),
        (is_(GENERAL) & s["milestone_age"], "general_but_milestone_age"),
        (is_(GENERAL) & s["rel_word"], "general_but_relationship_word"),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code in rules]))


def price(text: Column) -> Column:
    """F-08: struct of price_minor_units (half to even) and currency, both null without a price."""
    form = r"([£$€])\s*([0-9]+(?:[.,][0-9]{1,2})?)"
    symbol, amount = F.nullif(F.regexp_extract(text, form, 1), F.lit("")), F.regexp_replace(F.regexp_extract(text, form, 2), ",", ".")
    money = F.create_map(F.lit("£"), F.lit("GBP"), F.lit("$"), F.lit("USD"), F.lit("€"), F.lit("EUR"))
    return F.struct(F.when(symbol.isNotNull(), F.bround(amount.try_cast("double") * 100).cast("int")).alias("price_minor_units"), money[symbol].alias("currency"))


def digits_only(text: Column) -> Column:
    """F-09: all digits of a text as one number; null without any."""
    return F.nullif(F.regexp_replace(text, "[^0-9]", ""), F.lit("")).try_cast("long")


def first_number(text: Column) -> Column:
    """F-09: the first number of a text; null without any."""
    return F.nullif(F.regexp_extract(text, r"[0-9]+(?:\.[0-9]+)?", 0), F.lit("")).try_cast("double")


PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def normalised(text: Column) -> Column:
    """F-30: lower case, no ASCII punctuation, single blanks, trimmed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), PUNCTUATION, ""), r"\s+", " "))


def caption(text: Column, words: int = 8) -> Column:
    """F-31: quotes and newlines as blanks, the first words."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(text, "[\"'\\n\\r]", " "), r"\s+", " "))
    return F.array_join(F.slice(F.split(clean, " "), 1, words), " ")


def scored_title(title: Column, score: Column) -> Column:
    """F-32: a cleaned title with its score."""
    return F.format_string("%s (score: %.2f)", F.trim(F.regexp_replace(title, r"\s+", " ")), score)


# The greetings of occasion groups.
GREETINGS = {
    "birthday": "Happy Birthday", "christmas": "Merry Christmas", "mothers_day": "Happy Mother's Day", "fathers_day": "Happy Father's Day",
    "valentines_day": "Happy Valentine's Day", "easter": "Happy Easter", "anniversary": "Happy Anniversary", "wedding": "Congratulations",
    "sympathy": "With Sympathy", "thank_you": "Thank You", "congratulations": "Congratulations",
    "new_baby": "Congratulations", "leaving": "Good Luck",
}


def greeting(occasion: Column, names: dict[str, str] = GREETINGS) -> Column:
    """F-33: the greeting of an occasion's group, else its name in title case."""
    group = F.split_part(occasion, F.lit("/"), F.lit(1))
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(known[group], F.initcap(F.replace(group, F.lit("_"), F.lit(" "))))


def rendered(template: str, values: dict[str, Column]) -> Column:
    """F-34: a template with {{name}} replaced by columns; null values are empty."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def slug(text: Column) -> Column:
    """F-35: lower case letters and digits, all else as single hyphens."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def words(text: Column) -> Column:
    """Lower-case words of letters, digits and apostrophes."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9']+)"), F.lit(1))


def overlap_recall(headline: Column, seen: Column) -> Column:
    """F-28: the share of the headline's words (repeats count) that were seen; 0 for an empty headline."""
    h, s = words(headline), words(seen)
    return F.when(F.size(h) == 0, 0.0).otherwise(F.size(F.filter(h, lambda w: F.array_contains(s, w))) / F.size(h))


def word_jaccard(a: Column, b: Column) -> Column:
    """F-29: Jaccard similarity of two texts' word sets; 0 if both are empty."""
    x, y = words(a), words(b)
    n = F.size(F.array_union(x, y))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / n)


def rating(text: Column) -> Column:
    """F-16: the number in [[ ]], else in [ ]; null outside 1..10, without a second chance."""
    double = F.nullif(F.regexp_extract(text, r"\[\[(\d+\.?\d*)\]\]", 1), F.lit(""))
    single = F.nullif(F.regexp_extract(text, r"\[(\d+\.?\d*)\]", 1), F.lit(""))
    value = F.coalesce(double, single).try_cast("double")
    return F.when(value.between(1.0, 10.0), value)


def rescaled(value: Column, low: float, high: float) -> Column:
    """F-17: a rating of low..high as 0..1."""
    return (value - low) / (high - low)


def clamped(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """F-44."""
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def stars(p: Column) -> Column:
    """F-45: significance stars."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def hierarchical(exact: Column, group: Column, default: Column) -> Column:
    """F-37: the subtype's value, else its group's, else a default."""
    return F.coalesce(exact, group, default)


def ocr_text(tokens: Column, least: float = 0.0) -> Column:
    """F-46: struct of text and mean confidence of tokens (array of struct of text and conf) that are not blank and whose
    confidence is a number of at least `least`."""
    kept = F.filter(tokens, lambda t: (F.trim(t["text"]) != "") & (t["conf"].try_cast("double") >= least))
    conf = F.transform(kept, lambda t: t["conf"].try_cast("double"))
    mean = F.aggregate(conf, F.lit(0.0), lambda a, b: a + b) / F.nullif(F.size(conf), F.lit(0))
    return F.struct(F.array_join(F.transform(kept, lambda t: F.trim(t["text"])), " ").alias("text"), mean.alias("conf"))


def wrapped(text: str, most: float, width=len) -> list[str]:
    """F-39: lines of whole words, each as long as fits; a line that would break behind its last comma or semicolon but one
    word breaks there."""
    lines, line = [], ""
    for word in text.split():
        longer = f"{line} {word}" if line else word
        if not line or width(longer) <= most:
            line = longer
            continue
        head, _, last = line.rpartition(" ")
        if head.endswith((",", ";")):
            lines.append(head)
            line = f"{last} {word}"
        else:
            lines.append(line)
            line = word
    return [*lines, line] if line else [text]


def fitted(text: str, box_w: int, box_h: int, advance: float = 0.55, leading: float = 1.2) -> tuple[int, list[str]] | None:
    """F-39: the largest size from 24 to half the box's height (28 at least) at which the wrapped text fits a box, by halving,
    for letters that are `advance` times the size wide; None if none does."""
    lo, hi, best = 24, max(28, box_h // 2), None
    while lo <= hi:
        size = (lo + hi) // 2
        width = lambda s, size=size: len(s) * size * advance
        lines = wrapped(text, box_w, width)
        if len(lines) * size * leading <= box_h and max(map(width, lines)) <= box_w:
            best, lo = (size, lines), size + 1
        else:
            hi = size - 1
    return best


def fitted_lines(text: Column, box_w: int, box_h: int) -> Column:
    """F-39 as a column: struct of size and lines, null where nothing fits. The metric stands in for a font's."""

    @F.pandas_udf("size int, lines array<string>")
    def fit(texts: pd.Series) -> pd.DataFrame:
        got = [fitted(t, box_w, box_h) if isinstance(t, str) else None for t in texts]
        return pd.DataFrame([g or (None, None) for g in got], columns=["size", "lines"]).astype({"size": "Int32"})

    return fit(text)
