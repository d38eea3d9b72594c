"""Column functions: text, lists, dates, affect scores, vectors and bit hashes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of the affect scores, sentinel templates, and the order of classes.
EMOTIONS = ("joy", "anticipation", "disgust", "sadness", "anger", "optimism", "surprise", "pessimism", "fear", "trust", "love")
SENTIMENTS = ("neutral", "positive", "negative")
AFFECT = EMOTIONS + SENTIMENTS
SENTINELS = ("NO_TEMPLATE", "NON_MEME", "NO_MEME", "")
CLASS_ORDER = ("evergreen", "recurring", "faded", "emerging", "bursty")
# Synonym rewrites in the order in which they apply.
SYNONYMS = ((r"\bman\b", "person"), (r"\bguy\b", "person"), (r"\bwoman\b", "person"), (r"\bkid\b", "child"), (r"\bkids\b", "children"), (r"\bchange my mind\b", "person holding sign"))
# The first category whose terms occur in a text counts.
FUNCTION_RULES = (
    ("classification / social sorting", ("alignment", "chart", "categor")),
    ("comparison / hypothetical judgment", ("who would win", "versus", "battle", "compare", "comparison")),
    ("choice / contrast", ("same picture", "difference", "draw 25", "preference", "hotline bling")),
    ("reaction / affect display", ("reaction", "image macro", "uncanny", "panik", "kalm")),
    ("catchphrase / shared reference", ("catchphrase", "there is no war", "quote")),
    ("remixable visual format", ("exploitable", "photoshop", "template")),
)
DEFAULT_FUNCTION = "pop-culture reference"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- text and lists ----------------------------------------------------------------------------


def non_blank(c: Column | str) -> Column:
    """Trimmed text, null if nothing is left."""
    return F.nullif(F.trim(col(c)), F.lit(""))


def build_text(*parts: Column | str, sep: str = " ") -> Column:
    return F.concat_ws(sep, *(non_blank(p) for p in parts))


def norm_key_alnum(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "")


def _squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def norm_words(c: Column | str) -> Column:
    return _squeezed(F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[_-]", " "), r"[^a-z0-9\s]", ""))


def norm_synonyms(c: Column | str, rules: Sequence[tuple[str, str]] = SYNONYMS) -> Column:
    out = _squeezed(F.regexp_replace(F.replace(F.lower(F.trim(col(c))), F.lit("&"), F.lit(" and ")), r"[^a-z0-9\s]", " "))
    for pattern, to in rules:
        out = F.regexp_replace(out, pattern, to)
    return _squeezed(out)


def parse_polymorphic_list(c: Column | str) -> Column:
    """A JSON list, else parts between bars, as trimmed strings without blanks."""
    c = col(c)
    items = F.coalesce(F.from_json(c, "array<string>"), F.split(c, r"\|"))
    return F.coalesce(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def list_to_text(c: Column | str, sep: str = " | ") -> Column:
    return F.array_join(F.filter(F.transform(col(c), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")), sep)


def list_to_json(c: Column | str) -> Column:
    return F.coalesce(F.to_json(col(c)), F.lit("[]"))


def split_multi_value(c: Column | str) -> Column:
    return F.filter(F.transform(F.split(col(c), "[,;/]"), lambda x: F.trim(x)), lambda x: (x != "") & (F.lower(x) != "nan"))


def extract_year(c: Column | str) -> Column:
    return F.nullif(F.regexp_extract(col(c), r"(\d{4})", 1), F.lit("")).cast("int")


def keyword_rules(c: Column | str, rules=FUNCTION_RULES, default: str = DEFAULT_FUNCTION) -> Column:
    text, out = F.lower(col(c)), F
    for label, terms in rules:
        hit = F.lit(False)
        for t in terms:
            hit = hit | F.contains(text, F.lit(t))
        out = out.when(hit, label)
    return out.otherwise(default)


def file_stem(c: Column | str) -> Column:
    return F.regexp_extract(F.element_at(F.split(col(c), "/"), -1), r"^(.*?)(?:\.[^.]*)?$", 1)


def tokenise_letters(c: Column | str, min_length: int = 3, stop: Sequence[str] = ()) -> Column:
    words = F.transform(F.regexp_extract_all(col(c), F.lit(r"([A-Za-z][A-Za-z0-9_'-]+)"), 1), lambda w: F.lower(w))
    return F.filter(words, lambda w: (F.length(w) >= min_length) & ~w.isin(*stop) if stop else F.length(w) >= min_length)


def tokenise_alnum(c: Column | str, min_length: int = 3, stop: Sequence[str] = ()) -> Column:
    """ASCII words without outer quotes, of that length after it, not all digits, no stop words."""
    words = F.transform(F.regexp_extract_all(F.lower(col(c)), F.lit(r"([A-Za-z0-9']+)"), 1), lambda w: F.regexp_replace(w, "^'+|'+$", ""))

    def keep(w: Column) -> Column:
        ok = (F.length(w) >= min_length) & ~w.rlike("^[0-9]+$")
        return ok & ~w.isin(*stop) if stop else ok

    return F.filter(words, keep)


def source_url_pick(image: Column | str, post: Column | str, host: str = "imgur.com", to: str = "https://i.imgur.com/") -> Column:
    """An image URL, else a post URL with an image's extension, else one rewritten for ``host``."""
    image, post = non_blank(image), non_blank(post)
    is_image = F.lower(F.regexp_replace(post, r"[?#].*$", "")).rlike(r"\.(jpg|jpeg|png|gif|webp)$")
    on_host = F.regexp_extract(post, r"^[a-z]+://([^/?#]+)", 1).rlike(rf"(^|\.){host.replace('.', r'\.')}$")
    token = F.element_at(F.split(F.regexp_replace(F.regexp_replace(post, r"[?#].*$", ""), "/+$", ""), "/"), -1)
    direct = F.when(F.lower(F.regexp_replace(image, r"[?#].*$", "")).rlike(r"\.(jpg|jpeg|png|gif|webp)$"), image)
    return F.coalesce(direct, F.when(is_image, post), F.when(on_host, F.concat(F.lit(to), token, F.lit(".jpg"))))


# --- numbers and dates -------------------------------------------------------------------------


def safe_log1p(c: Column | str) -> Column:
    return F.log1p(F.greatest(F.coalesce(col(c).try_cast("double"), F.lit(0.0)), F.lit(0.0)))


def safe_divide(a: Column, b: Column) -> Column:
    return F.when((b != 0) & b.isNotNull(), a / b).otherwise(0.0)


def calendar_parts(c: Column | str) -> dict[str, Column]:
    t = col(c)
    return {"month": F.date_trunc("month", t), "week": F.date_trunc("week", t), "year": F.year(t), "weekday": F.weekday(t), "hour": F.hour(t)}


# --- affect scores -----------------------------------------------------------------------------


def dominant(scores: dict[str, Column | str], missing: str = "unavailable") -> tuple[Column, Column]:
    """Label of the largest score and that score; the first label wins ties, nulls never do."""
    items = [F.struct(col(c).alias("s"), F.lit(-i).alias("o"), F.lit(k).alias("l")) for i, (k, c) in enumerate(scores.items())]
    best = F.array_max(F.filter(F.array(*items), lambda x: x["s"].isNotNull()))
    return F.coalesce(best["l"], F.lit(missing)), best["s"]


def sentiment_balance(positive: Column | str, negative: Column | str) -> Column:
    return F.coalesce(col(positive), F.lit(0.0)) - F.coalesce(col(negative), F.lit(0.0))


def ambivalence(positive: Column | str, negative: Column | str) -> Column:
    p, n = col(positive), col(negative)
    return 2 * F.least(p, n) / F.nullif(p + n, F.lit(0.0))


def score_entropy(*scores: Column | str) -> Column:
    """Entropy of scores as shares, over the logarithm of their number; null if one is null or all are 0."""
    a = F.array(*(col(s) for s in scores))
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    h = F.aggregate(a, F.lit(0.0), lambda s, x: s - F.when(x > 0, x / total * F.log(x / total)).otherwise(0.0))
    return F.when(total > 0, h / F.log(F.lit(float(len(scores)))))


def polarity_label(c: Column | str) -> Column:
    c = col(c)
    return F.when(c >= 0.05, "positive").when(c <= -0.05, "negative").otherwise("neutral")


# --- vectors and hashes ------------------------------------------------------------------------


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used in there."""
    return F.get(F.transform(F.array(value), body), 0)


def l2_normalise(a: Column | str) -> Column:
    def scaled(v: Column) -> Column:
        return let(F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12)), lambda n: F.transform(v, lambda x: x.cast("double") / n))

    return let(col(a), scaled)


def fuse_vectors(a: Column | str, b: Column | str, alpha: float) -> Column:
    left = F.transform(col(a), lambda x: x.cast("double") * F.lit(alpha**0.5))
    right = F.transform(col(b), lambda x: x.cast("double") * F.lit((1 - alpha) ** 0.5))
    return l2_normalise(F.concat(left, right))


def center_bits(bits: Column | str) -> Column:
    return l2_normalise(F.transform(col(bits), lambda x: x * 2 - 1))


def pack_bits(flags: Column) -> Column:
    """An array of up to 64 booleans as one long, the i-th one in bit i."""
    pairs = F.transform(flags, lambda x, i: F.when(x, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def median_bits(values: Column | str) -> Column:
    """Bits of the values above the median of all but the first."""
    v = F.slice(col(values), 1, 64)
    n = F.size(v) - 1

    def middle(rest: Column) -> Column:
        return (F.element_at(rest, F.floor((n + 1) / 2).cast("int")) + F.element_at(rest, F.floor(n / 2).cast("int") + 1)) / 2.0

    median = let(F.array_sort(F.slice(v, 2, 63)), middle)
    return pack_bits(let(median, lambda m: F.transform(v, lambda x: x > m)))


def hamming(a: Column | str, b: Column | str) -> Column:
    return F.bit_count(col(a).bitwiseXOR(col(b)))
