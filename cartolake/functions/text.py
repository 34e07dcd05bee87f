"""Text columns: Turkish folding, names and similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks and what they fold to.
MARKED = "ÇĞİIÖŞÜÂÎÛçğıöşüâîûáàäãåéèëêíìïóòôõúùñý"
PLAIN = "CGiiOSUAIUcgiosuaiuaaaaaeeeeiiioooouuny"


#: Case and plural endings once folded. Vowel harmony gives a closed vowel (i, u) or an open one (a, e); after a vowel y, n or s
#: goes between, and the locative and ablative begin with d or, after a hard consonant, t.
OPEN, CLOSED = "ae", "iu"
ENDINGS = tuple(
    dict.fromkeys(
        ["", "ki"]
        + [c + v + n for c in "dt" for v in OPEN for n in ("", "n", "ki")]
        + [c + v for c in ("", "y") for v in OPEN + CLOSED]
        + [c + v + n for c in ("", "n") for v in CLOSED for n in ("n",)]
        + [f"s{v}" for v in CLOSED]
        + [f"l{v}r{c}" for v in OPEN for c in ("", "i")]
    )
)


def fold(c: Column) -> Column:
    """Lower-case ASCII; the dotted and dotless capital I become i before lower-casing."""
    return F.lower(F.translate(c, MARKED, PLAIN))


def fold_key(c: Column) -> Column:
    """Folded letters and digits of any script, nothing else."""
    return F.regexp_replace(fold(c), r"[^\p{L}\p{N}]+", "")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def words(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"[^\p{L}\p{N}]+"), fold), lambda w: w != "")


def lower_tr(c: Column) -> Column:
    return F.lower(F.replace(F.replace(c, F.lit("İ"), F.lit("i")), F.lit("I"), F.lit("ı")))


def same_name(a: Column, b: Column, least: int = 4) -> Column:
    """Equal, or the shorter (of enough letters) inside the longer."""
    shorter, longer = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return (a == b) | ((F.length(shorter) >= least) & F.contains(longer, shorter))


def shares_token(a: Column, b: Column) -> Column:
    """A common token of 4 letters, or tokens of 5 that are one edit apart."""
    return F.exists(a, lambda x: F.exists(b, lambda y: ((x == y) & (F.length(x) >= 4)) | ((F.length(x) >= 5) & (F.length(y) >= 5) & (F.levenshtein(x, y) <= 1))))


def trigrams(c: Column) -> Column:
    return F.when(F.length(c) < 3, F.array(c)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3)))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones are equal (1)."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def phone_key(c: Column) -> Column:
    digits = F.regexp_replace(c, r"\D", "")
    return F.when(F.length(digits) >= 10, F.right(digits, F.lit(10)))


def shorten(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most - 1)), F.lit("…"))).otherwise(c)


def mask_email(c: Column) -> Column:
    return F.regexp_replace(c, r"^(.)[^@]*(@.*)$", "$1***$2")


def tokens(name: Column, generic: tuple[str, ...]) -> Column:
    """Folded words of a name without those that say what it is, or all of them if no other is left."""
    every = F.filter(F.transform(F.split(name, r"[\s\-&/,.()']+"), fold), lambda w: w != "")
    telling = F.filter(every, lambda w: ~w.isin(*generic))
    return F.when(F.size(telling) == 0, every).otherwise(telling)


#: Vowels, those of the back row, and consonants that harden an ending.
VOWELS, BACK, HARD = "aeıioöuü", "aıou", "fstkçşhp"


def _last_vowel(name: Column) -> Column:
    return F.regexp_extract(lower_tr(F.trim(name)), f"([{VOWELS}])[^{VOWELS}]*$", 1)


def _ends_in(name: Column, letters: str) -> Column:
    return F.contains(F.lit(letters), F.right(lower_tr(F.trim(name)), F.lit(1)))


def ablative(name: Column) -> Column:
    """The name with the ending for "from"."""
    ending = F.when(_last_vowel(name).isin(*BACK), "an").otherwise("en")
    return F.concat(F.trim(name), F.lit("'"), F.when(_ends_in(name, HARD), "t").otherwise("d"), ending)


def genitive(name: Column) -> Column:
    """The name with the ending for "of"."""
    v = _last_vowel(name)
    ending = F.when(v.isin("a", "ı"), "ın").when(v.isin("o", "u"), "un").when(v.isin("ö", "ü"), "ün").otherwise("in")
    return F.concat(F.trim(name), F.lit("'"), F.when(_ends_in(name, VOWELS), "n").otherwise(""), ending)


#: Letters with marks, digits and signs, and the letters that they stand for.
STANDS, STANDS_FOR = "ış$5ğüö0ç1!34@7", "isssguoociieaat"


def capitalised(word: Column) -> Column:
    first = F.left(word, F.lit(1))
    return F.concat(F.when(first == "i", "İ").when(first == "ı", "I").otherwise(F.upper(first)), F.substring(word, 2, 1 << 30))


def clean_name(name: Column, particles: tuple[str, ...]) -> Column:
    """A name as it would be written: null if nothing is left of it."""
    plain = F.trim(F.regexp_replace(name, r"\s+", " "))
    plain = F.trim(F.regexp_replace(plain, '^["«“]+(.*[^"»”])["»”]+$', "$1"))
    letters = F.length(F.regexp_replace(plain, r"[^\p{L}]", ""))
    shouted = ~F.rlike(plain, F.lit(r"\p{Ll}")) & (letters > 4)
    words = F.transform(F.split(lower_tr(plain), " "), lambda w, i: F.when((i > 0) & w.isin(*particles), w).otherwise(capitalised(w)))
    return F.nullif(F.when(~F.rlike(plain, F.lit(r"\p{Lu}")) | shouted, F.array_join(words, " ")).otherwise(plain), F.lit(""))
